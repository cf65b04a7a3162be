"""Piece encoding and decoding by vectorised merge rounds.

The texts of a slice become one flat array of symbols, cut into words wherever no piece of the
vocabulary spans two neighbouring characters; equal words are merged once. In each round every word
finds its best pair (least rank, then leftmost) by a segmented minimum, all words merge at the same
time, and the arrays are compacted; a word without a pair that merges leaves. All places of the best
rank in a word merge in one round where that provably equals one merge after the other.
"""

from __future__ import annotations

import codecs
import heapq
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, LongType, StringType, StructField, StructType

from tabwright.llm.piece_model import CONTROL, NEVER, NORMAL, SPACE, PieceModel
from tabwright.llm.texts import portions, powers, scramble, text_bytes

SLICE_BYTES = 1 << 20
SLICE_POINTS = 1 << 19
LONG_TIE = 128


def _mark_each_byte(error: UnicodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("tabwright-each-byte", _mark_each_byte)


def as_text(data: bytes) -> str:
    """UTF-8 read as a string; each byte that does not belong becomes U+FFFD."""
    return data.decode("utf-8", "tabwright-each-byte")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)


def in_order(symbols: np.ndarray, model: PieceModel) -> np.ndarray:
    """One word merged pair after pair from a heap: for long runs in which merges of equal rank touch."""
    symbol = symbols.tolist()
    after = [*range(1, len(symbol)), -1]
    before = [-1, *range(len(symbol) - 1)]
    rank, to = model.rank, dict(zip(model.pair_keys.tolist(), model.pair_symbol.tolist(), strict=True))
    heap: list[tuple[int, int, int, int]] = []

    def offer(left: int, right: int) -> None:
        if left >= 0 and right >= 0 and symbol[left] < model.symbols and symbol[right] < model.symbols:
            made = to.get(symbol[left] * model.symbols + symbol[right])
            if made is not None:
                heapq.heappush(heap, (int(rank[made]), left, symbol[left], symbol[right]))

    for i in range(len(symbol) - 1):
        offer(i, i + 1)
    while heap:
        _, left, a, b = heapq.heappop(heap)
        right = after[left]
        if symbol[left] != a or right < 0 or symbol[right] != b:
            continue
        symbol[left], symbol[right] = to[a * model.symbols + b], -1
        after[left] = after[right]
        if after[right] >= 0:
            before[after[right]] = left
        offer(before[left], left)
        offer(left, after[left])
    return np.array([s for s in symbol if s >= 0], dtype=np.int32)


def _alternate(at: np.ndarray) -> np.ndarray:
    """Of places that follow each other directly every second one, from the left: merges cannot overlap."""
    first = np.concatenate([[True], at[1:] != at[:-1] + 1])
    begin = np.maximum.accumulate(np.where(first, at, 0))
    return at[(at - begin) % 2 == 0]


def merge_rounds(symbol: np.ndarray, word: np.ndarray, model: PieceModel) -> tuple[np.ndarray, np.ndarray]:
    """Final symbols of words and the word of each; `word` is ascending and so is the returned one."""
    done_symbols: list[np.ndarray] = []
    done_words: list[np.ndarray] = []

    def pair_at(at: np.ndarray) -> np.ndarray:
        inside = np.minimum(at + 1, len(symbol) - 1)
        same = (at + 1 < len(symbol)) & (word[inside] == word[at])
        return np.where(same, model.merged(symbol[at], symbol[inside]), -1)

    target = pair_at(np.arange(len(symbol)))
    while len(symbol):
        rank = model.rank_of(target)
        starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(symbol)]]))
        best = np.minimum.reduceat(rank, starts)
        if (best == NEVER).any():
            ended = np.repeat(best == NEVER, sizes)
            done_symbols.append(symbol[ended])
            done_words.append(word[ended])
            symbol, word, target, rank = symbol[~ended], word[~ended], target[~ended], rank[~ended]
            best, sizes = best[best != NEVER], sizes[best != NEVER]
            if not len(symbol):
                break
        segment = np.repeat(np.arange(len(best)), sizes)
        chosen = _alternate(np.flatnonzero(rank == best[segment]))
        owner = segment[chosen]
        first = np.concatenate([[True], owner[1:] != owner[:-1]])
        several = np.bincount(owner, minlength=len(best)) > 1
        if several.any():
            apart = _touching(symbol, segment, target, chosen, best, several, model)
            chosen = chosen[first | ~apart[owner]]
            # A long word that can only take one merge a round is finished alone.
            slow = apart & (sizes > LONG_TIE)
            if slow.any():
                for number in np.flatnonzero(slow):
                    left, right = np.searchsorted(segment, [number, number + 1])
                    finished = in_order(symbol[left:right], model)
                    done_symbols.append(finished)
                    done_words.append(np.full(len(finished), word[left]))
                chosen = chosen[~slow[segment[chosen]]]
                left_in = ~slow[segment]
                moved = np.cumsum(left_in) - 1
                symbol, word, target = symbol[left_in], word[left_in], target[left_in]
                chosen = moved[chosen]
                if not len(chosen):
                    continue
        stays = np.ones(len(symbol), dtype=bool)
        stays[chosen + 1] = False
        symbol = symbol.copy()
        symbol[chosen] = target[chosen]
        moved = (np.cumsum(stays) - 1)[chosen]
        symbol, word, target = symbol[stays], word[stays], target[stays]
        changed = np.unique(np.concatenate([moved, np.maximum(moved - 1, 0)]))
        target[changed] = pair_at(changed)
    if not done_words:
        return symbol, word
    words = np.concatenate(done_words)
    order = np.argsort(words, kind="stable")
    return np.concatenate(done_symbols)[order], words[order]


def _touching(
    symbol: np.ndarray,
    segment: np.ndarray,
    target: np.ndarray,
    chosen: np.ndarray,
    best: np.ndarray,
    several: np.ndarray,
    model: PieceModel,
) -> np.ndarray:
    """Words whose merges of this round would make a pair that goes before a later one of them.

    Merged from the left, a place sees the piece just made if that touches it, else the symbol to its
    left, and the unmerged symbol to its right. If every pair it makes ranks behind the round's best,
    no order of merging differs.
    """
    at = chosen[several[segment[chosen]]]
    made = target[at]
    bound = best[segment[at]]
    apart = np.zeros(len(best), dtype=bool)
    previous = np.maximum(at - 1, 0)
    follows = np.concatenate([[False], at[1:] == at[:-1] + 2])
    neighbour = np.where(follows, np.concatenate([[0], made[:-1]]), symbol[previous])
    in_word = (at > 0) & (segment[previous] == segment[at])
    makes = in_word & (model.rank_of(model.merged(neighbour, made)) <= bound)
    apart[segment[at[makes]]] = True
    following = np.minimum(at + 2, len(symbol) - 1)
    in_word = (at + 2 < len(symbol)) & (segment[following] == segment[at])
    makes = in_word & (model.rank_of(model.merged(made, symbol[following])) <= bound)
    apart[segment[at[makes]]] = True
    return apart


def _ids_of(symbol: np.ndarray, word: np.ndarray, model: PieceModel) -> tuple[np.ndarray, np.ndarray]:
    """Ids of symbols and the word of each; a character that is no piece becomes its UTF-8 bytes."""
    known = symbol < model.symbols
    ids = np.where(known, model.symbol_id[np.where(known, symbol, 0)], -1)
    lost = np.flatnonzero(ids < 0)
    if not len(lost):
        return ids, word
    strange = symbol[lost].astype(np.int64)
    codes = strange - model.symbols
    inside = strange < model.symbols
    if inside.any():  # a character of some piece that is no piece itself
        letter = dict(zip(model.char_symbol.tolist(), model.alphabet.tolist(), strict=True))
        codes[inside] = [letter[s] for s in strange[inside].tolist()]
    spelled = [chr(c).encode() for c in codes.tolist()]
    sizes = np.ones(len(ids), dtype=np.int64)
    sizes[lost] = [len(b) for b in spelled]
    out = np.repeat(ids, sizes)
    out[out < 0] = model.byte_ids[np.frombuffer(b"".join(spelled), dtype=np.uint8)]
    return out, np.repeat(word, sizes)


class Encoder:
    """Encodes lists of texts with one model; holds no state between calls."""

    def __init__(self, model: PieceModel) -> None:
        self.model = model
        self.places = model.char_table()

    def _parts(self, text: str) -> list[str]:
        """The text with its prefix and escaped spaces, cut between words where it is very long."""
        if not text:
            return []
        escaped = (SPACE if self.model.dummy_prefix else "") + text.replace(" ", SPACE)
        parts, at, width = [], 0, SLICE_POINTS
        while len(escaped) - at > width:
            places = self.places[_codes(escaped[at : at + width])]
            cut = np.flatnonzero(self.model.cuts(places))[-1]
            if cut:
                parts.append(escaped[at : at + cut])
                at, width = at + int(cut), SLICE_POINTS
            else:
                width *= 2
        return [*parts, escaped[at:]]

    def _group(self, parts: Sequence[str]) -> list[np.ndarray]:
        """Ids of each part; parts are not empty."""
        model = self.model
        codes = _codes("".join(parts))
        ends = np.cumsum([len(p) for p in parts])
        places = self.places[codes]
        cut = model.cuts(places)
        cut[ends[:-1]] = True
        starts = np.flatnonzero(cut)
        sizes = np.diff(np.concatenate([starts, [len(codes)]]))
        symbol = model.symbols_of(codes, places)
        first, which = self._distinct(symbol, starts, sizes)
        own = np.repeat(starts[first] - np.cumsum(sizes[first]) + sizes[first], sizes[first]) + np.arange(sizes[first].sum())
        merged, word = merge_rounds(symbol[own], np.repeat(np.arange(len(first)), sizes[first]), model)
        ids, word = _ids_of(merged, word, model)
        counts = np.bincount(word, minlength=len(first))
        begins = np.cumsum(counts) - counts
        lengths = counts[which]
        stops = np.cumsum(lengths)
        out = ids[np.repeat(begins[which] - stops + lengths, lengths) + np.arange(stops[-1])]
        last_words = np.searchsorted(starts, ends) - 1
        return np.split(out, stops[last_words][:-1])

    @staticmethod
    def _distinct(symbol: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A first word of each distinct one and the distinct one of each word, compared symbol by symbol."""
        up, down = powers(len(symbol))
        sums = np.concatenate([[np.uint64(0)], np.cumsum((symbol.astype(np.uint64) + np.uint64(1)) * up)])
        hashes = scramble((sums[starts + sizes] - sums[starts]) * down[starts])
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        model_start = starts[first][which]
        if np.array_equal(sizes[first][which], sizes):
            same = symbol[np.arange(len(symbol)) + np.repeat(model_start - starts, sizes)] == symbol
            if same.all():
                return first, which
        return np.arange(len(starts)), np.arange(len(starts))

    def encode(self, texts: Sequence[str], ends: bool = True) -> list[np.ndarray]:
        """Ids of each text (int32), between the begin and end ids if `ends`."""
        model = self.model
        parts: list[str] = []
        owners: list[int] = []
        found: list[list[np.ndarray]] = [[] for _ in texts]
        held = 0

        def flush() -> None:
            nonlocal held
            if parts:
                for owner, ids in zip(owners, self._group(parts), strict=True):
                    found[owner].append(ids)
            parts.clear()
            owners.clear()
            held = 0

        for number, text in enumerate(texts):
            for part in self._parts(text):
                if held and held + len(part) > SLICE_POINTS:
                    flush()
                parts.append(part)
                owners.append(number)
                held += len(part)
        flush()
        begin = np.array([model.begin] if ends else [], dtype=np.int32)
        end = np.array([model.end] if ends else [], dtype=np.int32)
        return [np.concatenate([begin, *own, end]).astype(np.int32) for own in found]


def decode_ids(ids: np.ndarray, model: PieceModel) -> str:
    """The text of ids: control ids vanish, runs of byte ids are read as UTF-8, the prefix is dropped.

    A byte that belongs to no character becomes U+FFFD; an id that the model does not have is read
    as the unknown one.
    """
    kinds, surfaces = model.kinds, model.surfaces
    known = [i if 0 <= i < len(kinds) else 0 for i in ids.tolist()] if len(ids) else []
    data = b"".join(map(surfaces.__getitem__, known))
    if model.dummy_prefix:
        lead = next((i for i in known if kinds[i] != CONTROL), None)
        if lead is not None and kinds[lead] == NORMAL and surfaces[lead].startswith(b" "):
            data = data[1:]
    return as_text(data)


def _mapped(df: DataFrame, used: str, fill, new: dict[str, DataType]) -> DataFrame:
    """`df` with new columns that `fill` makes of each slice of the column `used`; any column name may be kept.

    The kept columns travel in one struct, so none of their names can meet another. A column that
    already has the name of a new one is replaced.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in new]
    data = df.select(F.struct(F.lit(0), *kept).alias("kept"), F.col(f"`{used}`").alias("given"))
    places = range(1, len(kept) + 1)
    own = StructType([StructField(f"f{i}", f.dataType) for i, f in enumerate(data.schema["kept"].dataType.fields)])
    names = [c for c in df.columns if c not in new]
    schema = StructType([StructField("kept", own), *[StructField(f"n{i}", t) for i, t in enumerate(new.values())]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = fill()
        for batch in portions(batches, "given", SLICE_BYTES):
            yield pa.record_batch([batch.column("kept"), *made(batch.column("given"))], schema.names)

    found = data.withColumn("kept", F.col("kept").cast(own)).mapInArrow(run, schema)
    return found.select(
        *[F.col(f"kept.f{i}").alias(c) for i, c in zip(places, names, strict=True)],
        *[F.col(f"n{i}").alias(c) for i, c in enumerate(new)],
    )


def encode(
    df: DataFrame, model: PieceModel, text_col: str = "text", ids_col: str = "ids", count_col: str = "n_tokens"
) -> DataFrame:
    """Columns of `df` plus the ids of the whole text, packed as little-endian unsigned 32-bit integers, and their count.

    Begin and end ids are included, so a null or empty text has these two. Every text is encoded,
    of any length: a task holds a slice of at most 1 MB or one text, and works on parts of half a million
    characters of a longer one. Bytes that are no UTF-8 count as U+FFFD each. Equal texts have equal
    ids; repeated rows stay. A column that already has the name of a new one is replaced. Empty
    tables give none.
    """

    def fill():
        encoder = Encoder(model)

        def made(texts: pa.Array) -> list[pa.Array]:
            ids = encoder.encode([as_text(t) for t in text_bytes(texts)])
            packed = [i.astype("<u4").tobytes() for i in ids]
            return [pa.array(packed, pa.binary()), pa.array([len(i) for i in ids], pa.int64())]

        return made

    source = df.withColumn(text_col, F.col(f"`{text_col}`").cast("string"))
    return _mapped(source, text_col, fill, {ids_col: BinaryType(), count_col: LongType()})


def decode(df: DataFrame, model: PieceModel, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Columns of `df` plus the text of its packed ids; null ids give null, none the empty text.

    A column that already has the name of the new one is replaced; a trailing part of an id is ignored.
    """

    def fill():
        def made(packed: pa.Array) -> list[pa.Array]:
            texts = [
                None if p is None else decode_ids(np.frombuffer(p[: len(p) // 4 * 4], dtype="<u4"), model)
                for p in packed.to_pylist()
            ]
            return [pa.array(texts, pa.string())]

        return made

    return _mapped(df, ids_col, fill, {text_col: StringType()})
