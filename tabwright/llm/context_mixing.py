"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text is its lower-cased words, each with a space after it, and an end. Each byte is coded as a few
yes/no decisions along a Huffman tree of its predecessor. Every decision is predicted in several
contexts (the tree node itself; two, four and five bytes before; the whole word so far); counts come from all training texts, hashed into tables that grow with the corpus up to a cap (MAX_BITS). The
predictions are mixed in the logistic domain with weights gated by how much the longer contexts have
seen, fitted to all training texts: each decision is predicted from the counts without itself.
Mixtures of several sharpnesses read a text side by side, and after each word those that
predicted it well count for more.

Contexts of bytes begin with the word, so their decisions are the same wherever it stands: training works
on the table of distinct words and their counts, scoring on the distinct words of a window of texts.
Across words each word, and the end, is predicted in the context of the word before it (or of the
beginning): from how often it followed there in all training texts, mixed with the prediction from its
bytes by a share that grows with how often and how variously that context went on. A count gives up a discount for words that have not
followed, which training fixes by leaving each occurrence out (Ney's estimate). Counts of words and of
pairs are exact tables in parts that grow in number with the corpus; hashes stand for the words.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.store import keep, sweep
from tabwright.llm.texts import groups_of, hash_group, released, scramble, text_bytes

END = 10
PAD = bytes([END] * 5)
NODE_BITS = 16
CHUNK_BITS = 14
MAX_BITS = 21
WINDOW_WORDS = 1 << 18
LOCAL_STEPS = 4
FIT_ROUNDS = 8
SETTLED = 0.01
PULL = 10
GROUP_BYTES = 1 << 20
WINDOW_BYTES = 1 << 23
WORD_BYTES = 1 << 16
FLUSH = 1 << 30
SHARPNESS = (0.75, 0.9, 1.0, 1.1)
SCALE = 512
GATES = 16
END_TOKEN = -1
# Hashes that stand for the beginning and the end of a text in pairs, and tokens that one part of the pairs holds.
BEGIN_HASH = 1
END_HASH = 2
PART_TOKENS = 1 << 21
TAUGHT = -1
BLOCKS = "part long, window long, keys binary, times binary"
ANSWERS = "part long, window long, width int, counts binary, totals binary, kinds binary, once long, twice long, hot array<struct<name:long,total:long,kinds:long>>"


@dataclass(frozen=True)
class Code:
    """Huffman trees of all 256 preceding bytes: per (before, byte) the length and place of its path."""

    length: np.ndarray
    start: np.ndarray
    node: np.ndarray
    bit: np.ndarray


@dataclass(frozen=True)
class Model:
    """The code, the predictors' tables (logit and confidence packed in 16 bits), and gated weights."""

    code: Code
    bits: int
    tables: tuple[np.ndarray, ...]
    weights: np.ndarray


def _tree(counts: np.ndarray) -> list[list[tuple[int, int]]]:
    """Paths (inner node, bit) of the 256 bytes under Huffman's tree."""
    heap = [(int(c), s, s) for s, c in enumerate(counts)]
    heapq.heapify(heap)
    children: dict[int, tuple[int, int]] = {}
    fresh = 256
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        children[fresh] = (a[2], b[2])
        heapq.heappush(heap, (a[0] + b[0], fresh, fresh))
        fresh += 1
    paths: list[list[tuple[int, int]]] = [[] for _ in range(256)]
    stack: list[tuple[int, list[tuple[int, int]]]] = [(heap[0][2], [])]
    while stack:
        at, path = stack.pop()
        if at < 256:
            paths[at] = path
        else:
            for bit, child in enumerate(children[at]):
                stack.append((child, [*path, (at - 256, bit)]))
    return paths


def make_code(pairs: np.ndarray) -> Code:
    """Trees from counts of (before, byte); every byte keeps a path in every tree."""
    overall = pairs.sum(axis=0) + 1
    general = (overall * 1_000 // max(1, int(overall.sum()))) + 1
    length, start = np.zeros(65_536, dtype=np.int64), np.zeros(65_536, dtype=np.int64)
    nodes: list[int] = []
    bits: list[int] = []
    for before in range(256):
        for symbol, path in enumerate(_tree(pairs[before] * 4_096 + general)):
            length[before * 256 + symbol] = len(path)
            start[before * 256 + symbol] = len(nodes)
            nodes += [before * 256 + node for node, _ in path]
            bits += [bit for _, bit in path]
    return Code(length, start, np.array(nodes, dtype=np.uint32), np.array(bits, dtype=bool))


def _mixed(values: np.ndarray) -> np.ndarray:
    values = values * np.uint32(0x9E3779B1)
    return (values ^ (values >> np.uint32(15))) * np.uint32(0x85EBCA77)


class Bytes:
    """Bytes of distinct words, each with its closing space, and their contexts."""

    def __init__(self, words: list[bytes]):
        data = np.frombuffer(b"".join([x for w in words for x in (PAD, w)]), dtype=np.uint8)
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        begin = np.cumsum(sizes + len(PAD)) - sizes
        self.sizes = sizes
        self.word = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = np.repeat(begin, sizes) + place
        wide = data.astype(np.uint32)
        two = wide[:-1] + (wide[1:] << np.uint32(8))
        four = two[:-2] + (two[2:] << np.uint32(16))
        weighed = (data[at].astype(np.uint32) + np.uint32(1)) * _mixed(place.astype(np.uint32) + np.uint32(1))
        sums = np.cumsum(weighed, dtype=np.uint32) - weighed
        so_far = sums - np.repeat(sums[np.cumsum(sizes) - sizes], sizes)
        self.pair = (data[at - 1].astype(np.int32) << 8) + data[at]
        last_four = four[at - 4]
        self.contexts = (
            _mixed(two[at - 2] + np.uint32(0x1000000)),
            _mixed(last_four) + np.uint32(3),
            _mixed(_mixed(last_four) + wide[at - 5]),
            _mixed(so_far) + place.astype(np.uint32),
        )


class Words:
    """Distinct words of a group of texts, and which of them each text holds."""

    def __init__(self, texts: list[bytes]):
        joined, begin, end, self.hashes, firsts = hash_group(texts)
        _, first, inverse, self.counts = np.unique(
            self.hashes, return_index=True, return_inverse=True, return_counts=True
        )
        starts, ends = begin[first].tolist(), end[first].tolist()
        self.words = [joined[a:b] + b" " for a, b in zip(starts, ends, strict=True)]
        self.distinct = self.hashes[first]
        self.inverse = inverse
        self.firsts = np.r_[firsts, len(self.hashes)]

    def forget_places(self) -> None:
        """Only the distinct words and their counts are wanted from now on."""
        self.hashes = self.inverse = self.firsts = None

    def summed(self, values: np.ndarray) -> np.ndarray:
        """Sums over the words of each text."""
        total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values[self.inverse], axis=0, dtype=np.float64)])
        return total[self.firsts[1:]] - total[self.firsts[:-1]]


def _decisions(code: Code, group: Bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per decision its node and bit, per byte the number of decisions."""
    many = code.length[group.pair]
    ends = np.cumsum(many)
    path = np.repeat(code.start[group.pair] - (ends - many), many) + np.arange(int(ends[-1]) if len(ends) else 0)
    return code.node[path], code.bit[path], many


def table_bits(bits: int) -> tuple[int, ...]:
    """Sizes of the tables as powers of two; longer contexts get larger ones."""
    return (NODE_BITS, max(CHUNK_BITS, bits - 4), bits - 1, bits, bits + 1)


def _slots(group: Bytes, node: np.ndarray, many: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Places in the tables, as the whole numbers numpy looks up fastest."""
    salted = node * np.uint32(0xC2B2AE3D)
    yield node.astype(np.intp)
    for context, wide in zip(group.contexts, table_bits(bits)[1:], strict=True):
        value = np.repeat(context, many)
        value += salted
        value *= np.uint32(0x27D4EB2F)
        value ^= value >> np.uint32(15)
        value *= np.uint32(0x9E3779B1)
        yield (value >> np.uint32(32 - wide)).astype(np.intp)


def _token_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, word, count): distinct words with their closing space and hash, and the end of a text."""
    held: list[Words] = []
    size, ends = 0, 0

    def counted() -> pa.RecordBatch:
        words = [w for own in held for w in own.words]
        counts = np.concatenate([own.counts for own in held])
        hashes = np.concatenate([own.distinct for own in held])
        found, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        total = np.bincount(inverse, weights=counts, minlength=len(found)).astype(np.int64)
        return _word_rows(found.view(np.int64), [words[i] for i in first.tolist()], total)

    for batch in batches:
        texts = text_bytes(batch.column("text"))
        ends += len(texts)
        for group in groups_of(texts, GROUP_BYTES):
            own = Words(group)
            own.forget_places()
            held.append(own)
            size += len(own.words)
            if size >= WINDOW_WORDS:
                yield counted()
                held, size = [], 0
    if size:
        yield counted()
    if ends:
        yield _word_rows(np.full(1, END_TOKEN), [b"\n"], np.full(1, ends))


def _word_rows(tokens: np.ndarray, words: list[bytes], counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(tokens, pa.int64()), pa.array(words, pa.binary()), pa.array(counts, pa.int64())],
        names=["token", "word", "count"],
    )


def _word_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Words and their counts, of at most WORD_BYTES together; a longer word goes alone, whole."""
    for batch in batches:
        counts, at = batch.column("count").to_numpy().astype(np.float64), 0
        for words in groups_of(text_bytes(batch.column("word")), WORD_BYTES):
            yield words, counts[at : at + len(words)]
            at += len(words)


def _pair_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, n): pairs of neighbouring bytes of the words."""
    pairs = np.zeros(65_536)
    for words, times in _word_groups(batches):
        found = Bytes(words)
        pairs += np.bincount(found.pair, weights=times[found.word], minlength=65_536)
    seen = np.flatnonzero(pairs)
    yield pa.RecordBatch.from_pydict({"pair": seen, "n": pairs[seen].astype(np.int64)})


def _bit_counts(shared: Broadcast, bits: int):
    """(place, seen, ones): counts of a task for CHUNK slots of a table each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code: Code = shared.value
        sizes = [1 << b for b in table_bits(bits)]
        seen = [np.zeros(s, dtype=np.int32) for s in sizes]
        ones = [np.zeros(s, dtype=np.int32) for s in sizes]
        held = 0.0

        def pieces() -> Iterator[pa.RecordBatch]:
            for k in range(len(sizes)):
                for piece in range(max(1, sizes[k] >> CHUNK_BITS)):
                    part = slice(piece << CHUNK_BITS, min(sizes[k], (piece + 1) << CHUNK_BITS))
                    if seen[k][part].any():
                        yield pa.RecordBatch.from_pydict(
                            {
                                "place": np.full(1, k * (1 << 20) + piece),
                                "seen": pa.array([seen[k][part].tobytes()], pa.binary()),
                                "ones": pa.array([ones[k][part].tobytes()], pa.binary()),
                            }
                        )

        for words, times in _word_groups(batches):
            group = Bytes(words)
            node, bit, many = _decisions(code, group)
            weight = np.repeat(times[group.word], many)
            if held + weight.sum() > FLUSH:  # before a slot could pass 32 bits
                yield from pieces()
                for table in (*seen, *ones):
                    table[:] = 0
                held = 0.0
            held += weight.sum()
            weight = weight.astype(np.int32)
            for k, slot in enumerate(_slots(group, node, many, bits)):
                np.add.at(seen[k], slot, weight)
                np.add.at(ones[k], slot[bit], weight[bit])
        yield from pieces()

    return run


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    """Summed counts of one piece, zeros and ones."""
    seen = sum(np.frombuffer(x, dtype=np.int32).astype(np.float64) for x in rows["seen"])
    ones = sum(np.frombuffer(x, dtype=np.int32).astype(np.float64) for x in rows["ones"])
    counts = [(v.astype(np.float32).tobytes()) for v in (seen - ones, ones)]
    return pd.DataFrame({"place": [rows["place"].iloc[0]], "zeros": counts[:1], "ones": counts[1:]})


def _logits(zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logit in steps of 1 / SCALE, and confidence from 0 to 3."""
    steps = np.clip(np.rint(np.log((ones + np.float32(0.4)) / (zeros + np.float32(0.4))) * SCALE), -8_000, 8_000)
    seen = zeros + ones
    return steps, (seen >= 1).astype(np.int16) + (seen >= 8) + (seen >= 64)


def _packed(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logits (14 bits) and confidences (2 bits)."""
    steps, sure = _logits(zeros, ones)
    return (steps.astype(np.int16) << 2) | sure


def _normal_parts(shared: Broadcast, bits: int, start: np.ndarray, steps: int):
    """(parts): per gate the summed Hessians, and Hessians times weights, of a task's logistic regressions.

    Each group of words takes `steps` Newton steps from `start`, on predictions from the counts of all
    others: every decision leaves itself out. With one step the sums are those of a step on all words.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, zeros, ones = shared.value
        inputs = len(zeros)
        even = np.full(inputs, 1 / inputs)
        held = np.zeros((GATES, inputs, inputs + 1))
        for words, times in _word_groups(batches):
            group = Bytes(words)
            node, bit, many = _decisions(code, group)
            weight = np.repeat(times[group.word], many)
            xs = np.empty((len(bit), inputs), dtype=np.float32)
            sure = []
            for k, slot in enumerate(_slots(group, node, many, bits)):
                logits, known = _logits(zeros[k].take(slot) - ~bit, ones[k].take(slot) - bit)
                xs[:, k] = logits * np.float32(1 / SCALE)
                sure.append(known)
            gate = sure[-2] * np.int16(4) + sure[-1]
            order = np.argsort(gate, kind="stable")
            ends = np.cumsum(np.bincount(gate, minlength=GATES))
            for g in range(GATES):
                rows = order[ends[g - 1] if g else 0 : ends[g]]
                if not len(rows):
                    continue
                x, y, w = xs[rows], bit[rows].astype(np.float32), weight[rows]
                beta = start[g]
                for _ in range(steps):
                    p = 1 / (1 + np.exp(-np.clip(x @ beta.astype(np.float32), -20, 20)))
                    hessian = (x.T @ (x * (w * p * (1 - p)).astype(np.float32)[:, None])).astype(np.float64)
                    slope = x.T.astype(np.float64) @ (w * (y - p))
                    moved = hessian @ beta + slope
                    beta = np.linalg.solve(hessian + PULL * np.eye(inputs), moved + PULL * even) if steps > 1 else beta
                held[g, :, :-1] += hessian
                held[g, :, -1] += moved
        yield pa.RecordBatch.from_pydict({"parts": pa.array([held.ravel()], pa.list_(pa.float64()))})

    return run


def _fit_weights(words: DataFrame, code: Code, bits: int, zeros: list[np.ndarray], ones: list[np.ndarray]) -> np.ndarray:
    """Logistic regression of all training decisions on the predictors, one per gate, with a pull to even shares.

    The first round combines the fits of groups of words by their Hessians; the following ones are Newton
    steps on all words until no weight moves by SETTLED.
    """
    inputs = len(zeros)
    even = np.full(inputs, 1 / inputs)
    weights = np.tile(even, (GATES, 1))
    context = words.sparkSession.sparkContext
    shared = context.broadcast((code, zeros, ones))
    for number in range(FIT_ROUNDS):
        run = _normal_parts(shared, bits, weights, 1 if number else LOCAL_STEPS)
        rows = words.select("word", "count").coalesce(context.defaultParallelism).mapInArrow(released(run), "parts array<double>")
        parts = sum((np.array(row["parts"]) for row in rows.collect()), np.zeros(GATES * inputs * (inputs + 1)))
        parts = parts.reshape(GATES, inputs, inputs + 1)
        before = weights
        weights = np.stack([np.linalg.solve(p[:, :-1] + PULL * np.eye(inputs), p[:, -1] + PULL * even) for p in parts])
        if number and np.abs(weights - before).max() < SETTLED:
            break
    shared.unpersist()
    return weights.astype(np.float32)


def _inputs(model: Model, group: Bytes) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Per decision its bit, logits in steps of 1 / SCALE, and gate; per byte the number of decisions."""
    node, bit, many = _decisions(model.code, group)
    found = [table.take(slot) for table, slot in zip(model.tables, _slots(group, node, many, model.bits), strict=True)]
    gate = (found[-2] & np.int16(3)) * np.int16(4) + (found[-1] & np.int16(3))
    return bit, many, [f >> np.int16(2) for f in found], gate.astype(np.intp)


def _word_bits(model: Model, words: list[bytes]) -> np.ndarray:
    """Bits of each word under each sharpness."""
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    out, at = [], 0
    while at < len(words):  # as `groups_of`, without a step per word
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + WORD_BYTES, side="right")))
        out.append(_group_bits(model, words[at:stop]))
        at = stop
    return np.concatenate(out)


def _group_bits(model: Model, words: list[bytes]) -> np.ndarray:
    group = Bytes(words)
    bit, many, values, gate = _inputs(model, group)
    mixed = np.zeros(len(bit), dtype=np.float32)
    for k, value in enumerate(values):
        part = (model.weights[:, k] * np.float32(1 / SCALE)).take(gate)
        part *= value
        mixed += part
    mixed *= np.float32(1) - np.float32(2) * bit
    np.clip(mixed, -25, 25, out=mixed)
    ends = np.cumsum(np.add.reduceat(many, np.r_[0, np.cumsum(group.sizes)[:-1]]))
    starts = np.r_[0, ends[:-1]]
    out = np.empty((len(words), len(SHARPNESS)))
    for k, sharp in enumerate(SHARPNESS):
        out[:, k] = np.add.reduceat(np.log(1 + np.exp(mixed * np.float32(sharp))), starts)
    return out / math.log(2)


def _follows(hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Keys (word before, word) of all words and ends of texts, in order; 32 bits of each hash."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    before = np.insert(short, firsts[:-1], BEGIN_HASH).astype(np.uint64)
    return (before << np.uint64(32)) | np.insert(short, firsts[1:], END_HASH)


@dataclass(frozen=True)
class Routes:
    """To which part a key goes: pairs by the word before, those of frequent (`hot`) words by both; words by themselves."""

    parts: int
    hot: np.ndarray

    def pairs(self, keys: np.ndarray) -> np.ndarray:
        before = keys >> np.uint64(32)
        return (scramble(np.where(self.is_hot(before), keys, before)) % np.uint64(self.parts)).astype(np.int64)

    def words(self, keys: np.ndarray) -> np.ndarray:
        return self.parts + (keys % np.uint64(self.parts)).astype(np.int64)

    def is_hot(self, before: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hot, before)
        return self.hot[np.minimum(at, len(self.hot) - 1)] == before if len(self.hot) else np.zeros(len(before), dtype=bool)


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]]) if len(sorted_values) else np.zeros(0, dtype=np.int64)


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorting is many times faster than the hash table of `np.unique` for such keys."""
    values = np.sort(values)
    return values[_runs(values)]


def _pair_bytes(keys: np.ndarray) -> bytes:
    """Sorted keys as the words before, how many follow each, and these: half the size of the keys."""
    before = (keys >> np.uint64(32)).astype(np.uint32)
    starts = _runs(before)
    many = np.diff(np.r_[starts, len(keys)])
    return np.concatenate([[len(starts)], before[starts], many, keys & np.uint64(0xFFFFFFFF)]).astype(np.uint32).tobytes()


def _pair_keys(block: bytes) -> np.ndarray:
    values = np.frombuffer(block, dtype=np.uint32)
    kinds = int(values[0])
    before = np.repeat(values[1 : 1 + kinds], values[1 + kinds : 1 + 2 * kinds]).astype(np.uint64)
    return (before << np.uint64(32)) | values[1 + 2 * kinds :]


def _dealt(parts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(part, places of its keys in their order)."""
    order = np.argsort(parts, kind="stable")
    starts = _runs(parts[order])
    for start, stop in zip(starts.tolist(), [*starts[1:].tolist(), len(order)], strict=False):
        yield int(parts[order[start]]), order[start:stop]


def _blocks(window: int, keys: np.ndarray, parts: np.ndarray, pairs: bool, times: np.ndarray | None = None) -> pa.RecordBatch:
    rows = [
        (part, (_pair_bytes if pairs else np.ndarray.tobytes)(keys[at]), None if times is None else times[at].astype(np.int64).tobytes())
        for part, at in _dealt(parts)
    ]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([window] * len(rows), pa.int64()),
            pa.array([r[1] for r in rows], pa.binary()),
            pa.array([r[2] for r in rows], pa.binary()),
        ],
        names=["part", "window", "keys", "times"],
    )


def _windows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, list[bytes]]]:
    """(number, its rows, their texts) of windows of at most WINDOW_BYTES; the same rows give the same numbers."""
    before = 0
    for batch in batches:
        at, number = 0, (batch.column("partition")[0].as_py() << 32) + before if batch.num_rows else 0
        for texts in groups_of(text_bytes(batch.column("text")), WINDOW_BYTES):
            yield number, batch.slice(at, len(texts)), texts
            at, number, before = at + len(texts), number + 1, before + 1


def _hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a window, and keys of all its pairs."""
    words, keys = [], []
    for group in groups_of(texts, GROUP_BYTES):
        _, _, _, hashes, firsts = hash_group(group)
        words.append(hashes)
        keys.append(_follows(hashes, np.r_[firsts, len(hashes)]))
    return np.concatenate(words), np.concatenate(keys)


def _taught_pairs(routes: Routes):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in groups_of(text_bytes(batch.column("text")), WINDOW_BYTES):
                keys, times = np.unique(_hashed(texts)[1], return_counts=True)
                yield _blocks(TAUGHT, keys, routes.pairs(keys), True, times)

    return run


def _taught_words(routes: Routes):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("token").to_numpy().view(np.uint64)
            yield _blocks(TAUGHT, keys, routes.words(keys), False, batch.column("count").to_numpy())

    return run


def _asked(routes: Routes):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for window, _, texts in _windows(batches):
            words, keys = (_distinct(found) for found in _hashed(texts))
            yield _blocks(window, keys, routes.pairs(keys), True)
            if len(words):
                yield _blocks(window, words, routes.words(words), False)

    return run


def _numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for window, rows, _ in _windows(batches):
        yield rows.select(["row", "text"]).append_column("window", pa.array(np.full(rows.num_rows, window), pa.int64()))


def _looked_up(sorted_keys: np.ndarray, values: list[np.ndarray], asked: np.ndarray) -> list[np.ndarray]:
    """The values of the keys asked for, 0 where there are none."""
    if not len(sorted_keys):
        return [np.zeros(len(asked), dtype=np.int64) for _ in values]
    at = np.minimum(np.searchsorted(sorted_keys, asked), len(sorted_keys) - 1)
    met = sorted_keys[at] == asked
    return [np.where(met, v[at], 0) for v in values]


def _answered(routes: Routes):
    """Answers of one part to each window: training counts of the keys asked for, in their order.

    With pairs also, of each word before, how often it was followed and by how many words; for hot ones, whose
    pairs lie in many parts, these are 0 in the answer and go with what the part knows of all its pairs.
    """

    def run(table: pa.Table) -> pa.Table:
        part, windows = int(table["part"][0].as_py()), table["window"].to_numpy()
        pairs = part < routes.parts
        taught, asked = (table.filter(pa.array(mask)) for mask in (windows == TAUGHT, windows != TAUGHT))

        def keys_of(block: bytes) -> np.ndarray:
            return _pair_keys(block) if pairs else np.frombuffer(block, dtype=np.uint64)

        nothing = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
        keys = np.concatenate(nothing[0] + [keys_of(x) for x in taught["keys"].to_pylist()])
        times = np.concatenate(nothing[1] + [np.frombuffer(x, dtype=np.int64) for x in taught["times"].to_pylist()])
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
        starts = _runs(keys)
        keys, counts = keys[starts], np.add.reduceat(times, starts) if len(starts) else times
        rows, hot = [], []
        if pairs:
            before = keys >> np.uint64(32)
            starts = _runs(before)
            names, kinds = before[starts], np.diff(np.r_[starts, len(keys)])
            totals = np.add.reduceat(counts, starts) if len(starts) else counts
            apart = routes.is_hot(names)
            hot = [{"name": n, "total": t, "kinds": k} for n, t, k in zip(names[apart].tolist(), totals[apart].tolist(), kinds[apart].tolist(), strict=True)]
            totals, kinds = np.where(apart, 0, totals), np.where(apart, 0, kinds)
            rows.append((part, TAUGHT, 0, None, None, None, int((counts == 1).sum()), int((counts == 2).sum()), hot))
        for window, block in zip(asked["window"].to_pylist(), asked["keys"].to_pylist(), strict=True):
            wanted = keys_of(block)
            (found,) = _looked_up(keys, [counts], wanted)
            width = 4 if found.max(initial=0) < 1 << 32 else 8
            both = [None, None]
            if pairs:
                first = wanted >> np.uint64(32)
                both = [v.astype(np.uint32).tobytes() for v in _looked_up(names, [totals, kinds], first[_runs(first)])]
            rows.append((part, window, width, found.astype(f"u{width}").tobytes(), *both, None, None, None))
        kind = pa.struct([("name", pa.int64()), ("total", pa.int64()), ("kinds", pa.int64())])
        types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(kind)]
        names_ = ["part", "window", "width", "counts", "totals", "kinds", "once", "twice", "hot"]
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names_)

    return run


@dataclass(frozen=True)
class Follow:
    """How pairs become probabilities: the discount of a count, and of hot words how often and by how many they were followed."""

    routes: Routes
    discount: float
    totals: np.ndarray
    kinds: np.ndarray


def _counts_of(rows: list[dict], parts: np.ndarray) -> np.ndarray:
    """Answered counts of keys that were dealt to `parts`, back in the order of the keys."""
    out = np.zeros(len(parts), dtype=np.int64)
    held = {r["part"]: r for r in rows}
    for part, places in _dealt(parts):
        row = held.get(part)
        counts = np.frombuffer(row["counts"], dtype=f"u{row['width']}") if row else ()
        if len(counts) != len(places):
            raise RuntimeError("the documents came in another order when they were read again; write them down first")
        out[places] = counts
    return out


def _pair_answers(follow: Follow, rows: list[dict], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each key the share its count gives the word, and the share left to the word's bytes."""
    parts = follow.routes.pairs(keys)
    counts = _counts_of(rows, parts)
    before = keys >> np.uint64(32)
    (total, kinds) = _looked_up(follow.routes.hot, [follow.totals, follow.kinds], before)
    held = {r["part"]: r for r in rows}
    for part, places in _dealt(parts):
        own = before[places]
        starts = _runs(own)
        many = np.diff(np.r_[starts, len(own)])
        total[places] += np.repeat(np.frombuffer(held[part]["totals"], dtype=np.uint32).astype(np.int64), many)
        kinds[places] += np.repeat(np.frombuffer(held[part]["kinds"], dtype=np.uint32).astype(np.int64), many)
    bottom = np.maximum(total, 1)
    return np.maximum(counts - follow.discount, 0) / bottom, np.where(total > 0, follow.discount * kinds / bottom, 1.0)


def _bits_of(
    model: Model, texts: list[bytes], shares: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None
) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Bits, bytes and word hashes of each text; a word's bits by its bytes are computed once for all texts.

    `shares` gives of pairs the probability of the word after the one before, and the share of the prediction by
    its bytes; without it that is everything. The mixtures start with equal shares; a share is multiplied by what its mixture gave each word
    read, so the product over the text is the mean of the mixtures' probabilities of the text.
    """
    groups = [Words(group) for group in groups_of(texts, GROUP_BYTES)]
    words = [w for own in groups for w in own.words]
    _, first, place = np.unique(np.concatenate([own.distinct for own in groups]), return_index=True, return_inverse=True)
    bits = _word_bits(model, [*(words[i] for i in first.tolist()), b"\n"])
    lengths = np.array([len(w) for w in words], dtype=np.float64)
    ends = np.cumsum([len(own.words) for own in groups])
    keys, after = [], []
    for own, end in zip(groups, ends.tolist(), strict=True):
        keys.append(_follows(own.hashes, own.firsts))
        after.append(np.insert(place[end - len(own.words) : end][own.inverse], own.firsts[1:], len(bits) - 1))
    known, first, pair = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    bits = bits[np.concatenate(after)[first]]
    if shares is not None:
        given, left = shares(known)
        bits -= np.log2(left)[:, None]
        met = np.flatnonzero(given)
        bits[met] = -np.logaddexp2(-bits[met], np.log2(given[met])[:, None])
    total, sizes, hashes, at = [], [], [], 0
    for own, end, mine in zip(groups, ends.tolist(), keys, strict=True):
        starts = own.firsts[:-1] + np.arange(len(own.firsts) - 1)
        total.append(np.add.reduceat(bits[pair[at : at + len(mine)]], starts, axis=0))
        at += len(mine)
        sizes.append(own.summed(lengths[end - len(own.words) : end]) + 1)
        hashes += np.split(own.hashes, own.firsts[1:-1])
    total = np.concatenate(total)
    best = total.min(axis=1)
    mean = np.exp2(best[:, None] - total).mean(axis=1)
    return best - np.log2(mean), np.rint(np.concatenate(sizes)).astype(np.int64), hashes


def _scorer(shared: Broadcast):
    """Score and tokens of each row of a window, how many of the tokens are known, and the sum of their log10 counts."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        model, follow, end_count = shared.value
        rows = answers.to_pylist()
        found, sizes, hashes = _bits_of(model, text_bytes(texts["text"]), lambda keys: _pair_answers(follow, rows, keys))
        lengths = np.array([len(h) for h in hashes], dtype=np.int64)
        words, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        counts = _counts_of(rows, follow.routes.words(words))
        ends = np.cumsum(lengths)

        def summed(values: np.ndarray) -> np.ndarray:
            sums = np.r_[0.0, np.cumsum(values[inverse])]
            return sums[ends] - sums[ends - lengths]

        known = np.rint(summed((counts > 0).astype(np.float64))).astype(np.int64) + int(end_count > 0)
        logged = summed(np.log10(counts + 0.5)) + math.log10(end_count + 0.5)
        return pa.Table.from_arrays(
            [texts["row"], pa.array(found), pa.array(sizes), pa.array(lengths + 1), pa.array(known), pa.array(logged)],
            names=["row", "bits", "bytes", "tokens", "known", "logged"],
        )

    return run


def _table_released(run: Callable[..., pa.Table]):
    """`run` on whole tables, after which the worker gives freed memory back."""

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        return next(released(lambda _: iter([run(left, right)]))([]))

    return two


def score(docs: DataFrame, train: DataFrame, keep_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """`keep_cols` of each row of `docs` with the model's and the word-count baseline's log10 probability.

    Also n_tokens, n_known, train_tokens, bytes and bits_per_byte. All rows of `train`, whole, teach
    the word counts, the pair counts, the bit counts and the mixing weights. `docs` are read twice: a window of them asks
    the parts of the counts, by hashes, and their answers meet the window again; the rows must come in the same order, and a run in
    which they do not ends with an error. Null and empty texts consist of the end alone. Without training rows every prediction is even.
    """
    spark = docs.sparkSession
    texts = train.select(F.col(text_col).cast("string").alias("text"))
    found = texts.mapInArrow(released(_token_counts), "token long, word binary, count long")
    words = keep(found.groupBy("token", "word").agg(F.sum("count").alias("count")))
    size, distinct, end_count = words.agg(
        F.sum("count"), F.count("*"), F.max(F.when(F.col("token") == END_TOKEN, F.col("count")))
    ).first()
    size, end_count = int(size or 0), int(end_count or 0)
    slim = words.select("word", "count")
    pairs = np.zeros(65_536, dtype=np.int64)
    for row in slim.mapInArrow(released(_pair_counts), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        pairs[row["pair"]] = row["n"]
    code = make_code(pairs.reshape(256, 256))
    bits = int(np.clip(math.log2(max(2, int(pairs.sum()))) - 4, 15, MAX_BITS))
    shared = spark.sparkContext.broadcast(code)
    merged = (
        slim.coalesce(spark.sparkContext.defaultParallelism)
        .mapInArrow(released(_bit_counts(shared, bits)), "place long, seen binary, ones binary")
        .groupBy("place")
        .applyInPandas(_summed, "place long, zeros binary, ones binary")
        .collect()
    )
    shared.unpersist()
    zeros, ones = ([np.zeros(1 << b, dtype=np.float32) for b in table_bits(bits)] for _ in range(2))
    for row in merged:
        k, piece = divmod(row["place"], 1 << 20)
        for tables, name in ((zeros, "zeros"), (ones, "ones")):
            part = np.frombuffer(row[name], dtype=np.float32)
            tables[k][piece << CHUNK_BITS : (piece << CHUNK_BITS) + len(part)] = part
    del merged
    weights = _fit_weights(words, code, bits, zeros, ones)
    model = Model(code, bits, tuple(_packed(z, o) for z, o in zip(zeros, ones, strict=True)), weights)
    del zeros, ones
    narrow = docs.select(
        F.struct(*keep_cols).alias("row"), F.col(text_col).cast("string").alias("text"), F.spark_partition_id().alias("partition")
    )
    asked_bytes = int(narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    parts = max(1, -(-max(size, asked_bytes // 5) // PART_TOKENS))
    often = words.where((F.col("count") >= PART_TOKENS // 4) & (F.col("token") != END_TOKEN)).select("token").collect()
    hot = {int(np.int64(r["token"]).view(np.uint64) >> np.uint64(32)) for r in often}
    hot |= {BEGIN_HASH} if end_count >= PART_TOKENS // 4 else set()
    routes = Routes(parts, np.array(sorted(hot), dtype=np.uint64))
    blocks = (
        texts.mapInArrow(released(_taught_pairs(routes)), BLOCKS)
        .unionByName(words.where(F.col("token") != END_TOKEN).select("token", "count").mapInArrow(released(_taught_words(routes)), BLOCKS))
        .unionByName(narrow.mapInArrow(released(_asked(routes)), BLOCKS))
    )
    answers = keep(blocks.groupBy("part").applyInArrow(_answered(routes), ANSWERS))
    del found, blocks
    sweep(spark)
    of_parts = answers.where(F.col("window") == TAUGHT)
    once, twice = (int(n or 0) for n in of_parts.agg(F.sum("once"), F.sum("twice")).first())
    totals, kinds = np.zeros(len(routes.hot), dtype=np.int64), np.zeros(len(routes.hot), dtype=np.int64)
    each_hot = of_parts.select(F.inline("hot")).groupBy("name").agg(F.sum("total").alias("total"), F.sum("kinds").alias("kinds"))
    for row in each_hot.collect():
        at = int(np.searchsorted(routes.hot, np.uint64(row["name"])))
        totals[at], kinds[at] = row["total"], row["kinds"]
    follow = Follow(routes, (once + 1) / (once + 2 * twice + 2), totals, kinds)
    shared = spark.sparkContext.broadcast((model, follow, end_count))
    kind = narrow.schema["row"].dataType.simpleString()
    numbered = narrow.mapInArrow(released(_numbered), f"row {kind}, text string, window long")
    replies = answers.where(F.col("window") != TAUGHT).select("part", "window", "width", "counts", "totals", "kinds")
    columns = "bits double, bytes long, tokens long, known long, logged double"
    scored = keep(
        numbered.groupBy("window").cogroup(replies.groupBy("window")).applyInArrow(_table_released(_scorer(shared)), f"row {kind}, {columns}")
    )
    shared.unpersist()
    each = math.log10(size + 0.5 * (int(distinct or 0) + 1))
    return scored.select(
        "row.*",
        F.col("tokens").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(size).cast("long").alias("train_tokens"),
        (F.col("logged") - F.col("tokens") * F.lit(each)).alias("base_score"),
        (-F.col("bits") * F.lit(math.log10(2))).alias("score"),
        "bytes",
        (F.col("bits") / F.col("bytes")).alias("bits_per_byte"),
    )
