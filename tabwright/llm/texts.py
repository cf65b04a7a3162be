"""Words, word hashes and shingles of texts inside Python tasks, and runs of sorted Arrow rows."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0xD1342543DE82EF95)
IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
GROUP_BYTES = 1 << 20
HASH_BYTES = 1 << 18


def split_words(text: bytes) -> list[bytes]:
    """Words between ASCII white space (tab to carriage return, space), A-Z lower-cased."""
    return text.translate(LOWER_ASCII).split()


def id_remainder(doc_id: str | Column, divisor: int) -> Column:
    """crc32 of the id written as text, modulo `divisor`; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % divisor


class _Powers:
    """Powers of an odd 64-bit base and of its inverse, as many as asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up), 1 << 16)
            inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, BASE, dtype=np.uint64)])
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, inverse, dtype=np.uint64)])
        return self.up[:n], self.down[:n]


_powers = _Powers()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd 64-bit base and of its inverse, for hashes of stretches by differences of sums."""
    return _powers.upto(n)


def hash_group(texts: Sequence[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts joined and lower-cased; begin, end and hash of each word in them; words of each text before its first."""
    joined = b" ".join([b"", *texts, b""]).translate(LOWER_ASCII)
    chars = np.frombuffer(joined, dtype=np.uint8)
    space = IS_SPACE[chars]
    begin = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    up, down = _powers.upto(len(chars))
    sums = np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * up)
    values = (sums[end - 1] - sums[begin - 1]) * down[begin] + (end - begin).astype(np.uint64) * MULTIPLIER
    firsts = np.searchsorted(begin, np.cumsum([1, *[1 + len(t) for t in texts]])[:-1])
    return joined, begin, end, scramble(values), firsts


def portions(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most `limit` bytes in `column`; a longer text goes alone, whole.

    What a task makes out of a slice then stays small, however large a batch is.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, stop - at)
            at = stop


def groups_of(texts: Iterable[bytes], limit: int) -> Iterator[list[bytes]]:
    """Consecutive texts of at most `limit` bytes together; a longer one goes alone, whole."""
    group: list[bytes] = []
    size = 0
    for text in texts:
        if group and size + len(text) > limit:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text) + 1
    if group:
        yield group


def word_hashes(texts: Sequence[bytes]) -> Iterator[np.ndarray]:
    """For each text the 64-bit hashes of its words, a polynomial in their bytes, A-Z lower-cased.

    Words are what lies between ASCII white space (tab to carriage return, space).
    """
    for group in groups_of(texts, HASH_BYTES):
        _, _, _, values, firsts = hash_group(group)
        yield from np.split(values, firsts[1:])


def scramble(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the `width`-word shingles; fewer words make one shingle, none make none."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(width, n)
    folded = hashes[: n - width + 1] + np.uint64(width)
    for offset in range(1, width):
        folded = folded * MULTIPLIER
        folded += hashes[offset : n - width + 1 + offset]
    folded = scramble(folded)
    folded.sort()
    return folded[np.r_[True, folded[1:] != folded[:-1]]]


def released(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """`run`, after which the worker gives freed memory back to the system.

    Python workers wait for later tasks, and what their allocators keep counts against the executor.
    """

    def outer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library: it keeps what it keeps
                pass

    return outer


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """Texts as UTF-8; a null text is empty."""
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


def whole_runs(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Tables that hold whole runs of equal keys, from batches sorted by them."""
    held: list[pa.Table] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        starts = run_starts(table, keys)
        if len(starts) > 1:
            cut = int(starts[-1])
            yield pa.concat_tables([*held, table.slice(0, cut)])
            held = [table.slice(cut)]
        elif held and any(held[-1][k][0].as_py() != table[k][0].as_py() for k in keys):
            yield pa.concat_tables(held)
            held = [table]
        else:
            held.append(table)
    if held:
        yield pa.concat_tables(held)


def run_starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Row numbers at which a run of equal (non-null, numeric) keys begins."""
    change = np.zeros(table.num_rows, dtype=bool)
    if table.num_rows:
        change[0] = True
    for key in keys:
        values = table[key].to_numpy()
        change[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(change)
