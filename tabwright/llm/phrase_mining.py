"""Collocations per language: suffixes routed by their leading words, counted by multikey three-way quicksort.

Each word of a piece starts a suffix of at most four words. Tasks merge equal suffixes, pack them with
the words they use and send them to the route of their two leading words; the route of a pair with a
great share of all suffixes is chosen by three or four words instead, of a quadruple with such a share
by the sender. Within a route the suffix pointers are sorted word by word: every active stretch is
split around a pivot into less, equal and greater, all stretches at once. The weight of an equal part
is the count of its phrase, and a part too light for any frequent phrase is abandoned unsorted.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.llm.store import keep
from tabwright.llm.texts import LOWER_ASCII, MULTIPLIER, portions, powers, released, scramble, text_bytes

DEPTH = 4
UNKNOWN_LANGUAGE = "und"
BREAKS = np.isin(np.arange(256), np.frombuffer(b".,;:!?\x0a\x0b\x0c\x0d", dtype=np.uint8))
GAPS = BREAKS | np.isin(np.arange(256), [0x20, 0x09])
FLUSH_BYTES = 1 << 21
ROUTE_BYTES = 1 << 22
SAMPLE_BYTES = 1 << 14
HOT_SHARE = 4
PACKED = 16_000
PACKED_TYPE = "route long, lang string, whole int, words binary, suffixes binary, counts binary"


class Suffixes:
    """Distinct suffixes of some texts, with the hashes that route them.

    `words`: the distinct words; `ids` (4 rows): the words of each suffix from 1, 0 past its piece's
    end; `count`: how often it occurs; `lang`: place in `languages`.
    """

    def __init__(self, texts: Sequence[bytes], languages: Sequence[str]) -> None:
        encoded = pa.array(languages, pa.string()).dictionary_encode()
        self.languages = encoded.dictionary.to_pylist()
        chars = np.frombuffer(b"\n".join([b"", *texts, b""]).translate(LOWER_ASCII), dtype=np.uint8)
        gap = GAPS[chars]
        begin = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
        end = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
        offsets = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int64)
        buffers = [None, pa.py_buffer(offsets), pa.py_buffer(chars[~gap])]
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), buffers).dictionary_encode()
        self.words = coded.dictionary
        word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32) + np.int32(1)
        piece = np.cumsum(BREAKS[chars], dtype=np.int32)[begin]
        text_of = np.searchsorted(np.cumsum([1, *[1 + len(t) for t in texts]]), begin, side="right") - 1
        lang = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int32)[text_of] if len(begin) else text_of
        del coded, buffers, offsets, chars, gap, begin, end, text_of

        ids = np.zeros((DEPTH, len(word)), dtype=np.int32)
        ids[0] = word
        for k in range(1, DEPTH):
            same = piece[k:] == piece[:-k] if k < len(word) else np.zeros(0, dtype=bool)
            ids[k, : len(same)] = np.where(same, word[k : k + len(same)], 0)
        self.single, self.single_lang, self.single_count = self._singles(word, lang)
        longer = ids[1] > 0
        self.ids, self.lang, self.count = self._distinct(ids[:, longer], lang[longer])
        self._hash_words()

    def _singles(self, word: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        width = len(self.words) + 1
        key, count = np.unique(lang.astype(np.int64) * width + word, return_counts=True)
        return (key % width).astype(np.int32), (key // width).astype(np.int32), count

    def _distinct(self, ids: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Equal suffixes merged: pairs of words are numbered first, so that a suffix is two numbers."""
        width = len(self.words) + 1
        front = (lang.astype(np.int64) * width + ids[0]) * width + ids[1]
        if not len(front):
            return ids, lang, front
        back = ids[2].astype(np.int64) * width + ids[3]
        order = np.lexsort((back, front))
        front, back = front[order], back[order]
        first = np.flatnonzero(np.concatenate([[True], (front[1:] != front[:-1]) | (back[1:] != back[:-1])]))
        kept = order[first]
        return ids[:, kept], lang[kept], np.diff(np.concatenate([first, [len(front)]]))

    def _hash_words(self) -> None:
        ends = np.frombuffer(self.words.buffers()[1], dtype=np.int64)[: len(self.words) + 1] if len(self.words) else np.zeros(1, np.int64)
        data = np.frombuffer(self.words.buffers()[2] or b"", dtype=np.uint8)[: ends[-1]]
        up, down = powers(len(data) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1])])
        values = (sums[ends[1:]] - sums[ends[:-1]]) * down[ends[:-1]] + np.diff(ends).astype(np.uint64) * MULTIPLIER
        self.word_hash = np.concatenate([[np.uint64(0)], scramble(values)])
        names = [int.from_bytes(n.encode()[:8], "big") + len(n) for n in self.languages]
        self.lang_hash = scramble(np.array(names, dtype=np.uint64) * MULTIPLIER)

    def single_hashes(self) -> np.ndarray:
        return scramble(self.lang_hash[self.single_lang] + self.word_hash[self.single])

    def prefix_hashes(self) -> Iterator[np.ndarray]:
        """A hash of the language and the 2, 3 and 4 leading words of each suffix."""
        held = scramble(self.lang_hash[self.lang] + self.word_hash[self.ids[0]])
        for k in range(1, DEPTH):
            held = scramble(held * MULTIPLIER + self.word_hash[self.ids[k]])
            yield held


def _flushes(batches: Iterable[pa.RecordBatch]) -> Iterator[Suffixes]:
    """Suffixes of stretches of about FLUSH_BYTES; a longer text is cut between pieces."""
    texts: list[bytes] = []
    languages: list[str] = []
    held = 0
    for batch in portions(batches, "text", FLUSH_BYTES):
        for text, lang in zip(text_bytes(batch.column("text")), batch.column("lang").to_pylist(), strict=True):
            for part in _parts(text):
                if held and held + len(part) > FLUSH_BYTES:
                    yield Suffixes(texts, languages)
                    texts, languages, held = [], [], 0
                texts.append(part)
                languages.append(lang)
                held += len(part) + 1
    if texts:
        yield Suffixes(texts, languages)


def _parts(text: bytes) -> Iterator[bytes]:
    at = 0
    while len(text) - at > FLUSH_BYTES:
        breaks = np.flatnonzero(BREAKS[np.frombuffer(text, dtype=np.uint8, count=FLUSH_BYTES, offset=at)])
        if len(breaks):
            cut = at + int(breaks[-1]) + 1
        else:  # one piece longer than a stretch: whole up to the next break
            cut = at + FLUSH_BYTES
            while cut < len(text) and not BREAKS[text[cut]]:
                cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def _routes(found: Suffixes, routes: int, hot: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Route of each suffix, and the number of words from which on its phrases are whole there."""
    chosen = np.zeros(len(found.lang), dtype=np.uint64)
    whole = np.full(len(found.lang), DEPTH + 1, dtype=np.int64)
    for depth, (hashes, crowded) in enumerate(zip(found.prefix_hashes(), hot, strict=True), 2):
        at = np.minimum(np.searchsorted(crowded, hashes), max(len(crowded) - 1, 0))
        is_hot = crowded[at] == hashes if len(crowded) else np.zeros(len(hashes), dtype=bool)
        settles = (whole > DEPTH) & ~is_hot
        chosen[settles] = hashes[settles]
        whole[settles] = depth
        last = hashes
    spread = whole > DEPTH
    if spread.any():  # the sender decides: the sum of what it sends differs from sender to sender
        chosen[spread] = scramble(last[spread] + last.sum(dtype=np.uint64))
    return (chosen % np.uint64(routes)).astype(np.int64), whole


def _packed(found: Suffixes, routes: int, hot: Sequence[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows of at most PACKED suffixes of one (route, language, whole), with the words they use."""
    route, whole = _routes(found, routes, hot)
    one = np.zeros((DEPTH, len(found.single)), dtype=np.int32)
    one[0] = found.single
    ids = np.concatenate([one, found.ids], axis=1)
    lang = np.concatenate([found.single_lang, found.lang])
    count = np.concatenate([found.single_count, found.count])
    route = np.concatenate([(found.single_hashes() % np.uint64(routes)).astype(np.int64), route])
    whole = np.concatenate([np.ones(len(found.single), dtype=np.int64), whole])
    group = (route * len(found.languages) + lang) * (DEPTH + 2) + whole
    order = np.argsort(group, kind="stable")
    group = group[order]
    if not len(group):
        return
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    stops = np.concatenate([starts[1:], [len(group)]])
    scratch = np.zeros(len(found.words) + 1, dtype=np.int32)
    words, offsets, rows = [], [0], []
    for start, stop in zip(starts.tolist(), stops.tolist(), strict=True):
        for low in range(start, stop, PACKED):
            at = order[low : min(stop, low + PACKED)]
            own = ids[:, at].ravel()
            places = np.arange(len(own), dtype=np.int32)
            scratch[own] = places
            distinct = own[scratch[own] == places]
            distinct = distinct[distinct > 0]
            scratch[distinct] = np.arange(1, len(distinct) + 1)
            scratch[0] = 0
            words.append(distinct - 1)
            offsets.append(offsets[-1] + len(distinct))
            first = at[0]
            rows.append(
                (
                    int(route[first]),
                    found.languages[lang[first]],
                    int(whole[first]),
                    scratch[own].astype("<u2").tobytes(),
                    count[at].astype("<u4").tobytes(),
                )
            )
    flat = found.words.take(pa.array(np.concatenate(words))).cast(pa.binary())
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat), b" ")
    columns = list(zip(*rows, strict=True))
    yield pa.record_batch(
        {
            "route": pa.array(columns[0], pa.int64()),
            "lang": pa.array(columns[1], pa.string()),
            "whole": pa.array(columns[2], pa.int32()),
            "words": joined,
            "suffixes": pa.array(columns[3], pa.binary()),
            "counts": pa.array(columns[4], pa.binary()),
        }
    )


def equal_parts(
    ids: np.ndarray, weight: np.ndarray, least: int, whole: int, top: int = DEPTH
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pointer to an example, depth, weight) of the phrases of 1 to `top` entries that suffixes begin with.

    Multikey three-way quicksort of pointers: a stretch of suffixes that agree in their first words is
    split by the next one around a pivot; only the equal part goes on to the word after. Parts lighter
    than `least` are abandoned; phrases of fewer than `whole` words may have weight elsewhere, so these
    come whatever they weigh.
    """
    pointer = np.flatnonzero(ids[0] > 0).astype(np.int32)
    size = np.array([len(pointer)])
    depth = np.zeros(1, dtype=np.int64)
    while len(pointer):
        stretch = np.repeat(np.arange(len(size), dtype=np.int32), size)
        key = ids[depth[stretch], pointer]
        starts = np.cumsum(size) - size
        trial = key[starts[:, None] + (size[:, None] * np.arange(1, 6)) // 6]
        pivot = np.sort(trial, axis=1)[:, 2][stretch]
        side = (key >= pivot).astype(np.int8) + (key > pivot)
        part = stretch * np.int32(3) + side
        sizes = np.bincount(part, minlength=3 * len(size)).reshape(-1, 3)
        weights = np.bincount(part, weights=weight[pointer], minlength=3 * len(size)).astype(np.int64).reshape(-1, 3)
        # A suffix that ends before this word begins with no phrase that long.
        ends = np.zeros((len(size), 3), dtype=bool)
        ends[:, 1] = pivot[starts] == 0
        bound = np.where(depth + 1 < whole, 1, least)
        stays = (weights >= bound[:, None]) & (sizes > 0) & ~ends
        kept = [np.flatnonzero((side == s) & stays[stretch, s]) for s in range(3)]
        equal = np.flatnonzero(stays[:, 1])
        found = pointer[kept[1]]
        begins = np.cumsum(sizes[equal, 1]) - sizes[equal, 1]
        if len(equal):
            yield found[begins], depth[equal] + 1, weights[equal, 1]
        deeper = depth[equal] + 1 < top
        if not deeper.all():
            found = found[np.repeat(deeper, sizes[equal, 1])]
            equal = equal[deeper]
        lower, upper = np.flatnonzero(stays[:, 0]), np.flatnonzero(stays[:, 2])
        pointer = np.concatenate([pointer[kept[0]], found, pointer[kept[2]]])
        size = np.concatenate([sizes[lower, 0], sizes[equal, 1], sizes[upper, 2]])
        depth = np.concatenate([depth[lower], depth[equal] + 1, depth[upper]])


def _group_counts(group: pa.Table, least: int) -> Iterator[pa.RecordBatch]:
    """Phrases of one (route, whole) with their counts; and the words of each language, of single words.

    The language stands before the first word, so that one sort serves all languages.
    """
    listed = pc.split_pattern(group["words"].combine_chunks(), b" ")
    flat = listed.flatten().dictionary_encode()
    numbers = flat.indices.to_numpy(zero_copy_only=False).astype(np.int32) + np.int32(1)
    offsets = listed.offsets.to_numpy() - listed.offsets[0].as_py()
    tongue = group["lang"].combine_chunks().dictionary_encode()
    counts = group["counts"].combine_chunks()
    weight = np.concatenate([np.frombuffer(c.as_buffer(), dtype="<u4") for c in counts]).astype(np.float64)
    ids = np.empty((DEPTH + 1, len(weight)), dtype=np.int32)
    at = 0
    for i, (packed, lang) in enumerate(zip(group["suffixes"].combine_chunks(), tongue.indices.to_pylist(), strict=True)):
        table = np.concatenate([np.zeros(1, np.int32), numbers[offsets[i] : offsets[i + 1]]])
        part = table[np.frombuffer(packed.as_buffer(), dtype="<u2").reshape(DEPTH, -1)]
        ids[0, at : at + part.shape[1]] = lang + 1
        ids[1:, at : at + part.shape[1]] = part
        at += part.shape[1]
    languages = tongue.dictionary.to_pylist()
    whole = group["whole"][0].as_py()
    del group, listed, counts, numbers
    if whole == 1:
        held = np.bincount(ids[0], weights=weight, minlength=len(languages) + 1)[1:].astype(np.int64)
        yield _counted(languages, [None] * len(held), np.zeros(len(held)), held)
        ids = ids[:2]
    # Where all pairs are whole, nothing light can hold a phrase: single words are counted elsewhere.
    bound = 1 if whole <= 2 else whole + 1
    shortest = min(whole, 2)
    for example, depth, total in equal_parts(ids, weight, least, bound, len(ids)):
        wanted = depth > shortest
        example, words, total = example[wanted], depth[wanted] - 1, total[wanted]
        if not len(words):
            continue
        used = np.arange(len(ids) - 1)[None, :] < words[:, None]
        spelled = flat.dictionary.take(pa.array(ids[1:, example].T[used] - 1))
        begins = pa.array(np.concatenate([[0], np.cumsum(words)]), pa.int32())
        phrases = pc.binary_join(pa.ListArray.from_arrays(begins, spelled), b" ").cast(pa.string())
        yield _counted([languages[i] for i in (ids[0, example] - 1).tolist()], phrases, words, total)


def _counted(languages: Sequence[str], phrases, words, counts) -> pa.RecordBatch:
    return pa.record_batch(
        {
            "lang": pa.array(languages, pa.string()),
            "phrase": pa.array(phrases, pa.string()),
            "words": pa.array(words, pa.int32()),
            "count": pa.array(counts, pa.int64()),
        }
    )


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of equal (route, whole), from rows sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = list(zip(*[batch.column(c).to_pylist() for c in ("route", "whole")], strict=True))
        start = 0
        for i, key in enumerate([*keys, None]):
            if i == len(keys) or (i > start and key != keys[start]):
                if i > start:
                    if held and last != keys[start]:
                        yield pa.Table.from_batches(held)
                        held = []
                    held.append(batch.slice(start, i - start))
                    last, start = keys[start], i
    if held:
        yield pa.Table.from_batches(held)


def phrase_counts(docs: DataFrame, least: int = 30, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, phrase, words, count) of all phrases of 1 to 4 words with `count` of at least `least`.

    A row with null phrase and 0 words carries the number of words of a language. A-Z are lower-cased;
    a phrase lies within a piece between `.,;:!?` and line breaks; a null language counts as `und`, a
    null text as empty. Copies add up. Other columns are ignored; no documents give no rows.

    Memory: a sender holds the suffixes of 2 MB of text, a receiver those of one route, about 4 MB
    of text in all; routes grow with the corpus and are at least as many as shuffle partitions.
    """
    spark = docs.sparkSession
    texts = docs.select(
        F.col(text_col).cast("string").alias("text"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN_LANGUAGE)).alias("lang"),
    ).where("text <> ''")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    routes = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / ROUTE_BYTES))
    hot = _crowded(texts, routes, size)

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _flushes(batches):
            yield from _packed(found, routes, hot)

    def receive(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            yield from _group_counts(group, least)

    sent = texts.mapInArrow(released(send), PACKED_TYPE).repartitionById(routes, F.col("route").cast("int"))
    found = sent.sortWithinPartitions("route", "whole").mapInArrow(
        released(receive), "lang string, phrase string, words int, count long"
    )
    added = found.groupBy("lang", "phrase", "words").agg(F.sum("count").alias("count"))
    return added.where((F.col("words") == 0) | (F.col("count") >= least))


def _crowded(texts: DataFrame, routes: int, size: int) -> list[np.ndarray]:
    """Hashes of the leading 2, 3 and 4 words that hold over a quarter of a route's share of suffixes.

    Only routing depends on them, so a sample of texts serves; at most four times as many as routes
    per depth can reach that share.
    """
    steps = 1 << 20
    share = min(steps, math.ceil(steps * routes * SAMPLE_BYTES / max(size, 1)))
    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(steps)) < share)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _flushes(batches):
            for depth, hashes in enumerate(found.prefix_hashes(), 2):
                key, count = np.unique(hashes, return_counts=True)
                yield pa.record_batch(
                    {
                        "depth": pa.array(np.full(len(key), depth), pa.int32()),
                        "key": pa.array(key.view(np.int64)),
                        "count": pa.array(count, pa.int64()),
                    }
                )

    counts = keep(
        sample.mapInArrow(released(run), "depth int, key long, count long")
        .groupBy("depth", "key")
        .agg(F.sum("count").alias("count"))
    )
    total = counts.where("depth = 2").agg(F.sum("count")).first()[0] or 0
    rows = counts.where(F.col("count") * routes * HOT_SHARE > max(total, 1)).collect()
    return [np.sort(np.array([r.key for r in rows if r.depth == d], dtype=np.int64).view(np.uint64)) for d in (2, 3, 4)]


def _joined(low: int | Column, size: int | Column) -> Column:
    return F.array_join(F.slice("parts", low, size), " ")


def collocations(
    docs: DataFrame,
    least: int = 30,
    top: int = 2000,
    scale: int = 2_000_000,
    absorb_percent: int = 80,
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """The first `top` phrases of 2 to 4 words of each language by score, with what the score is made of.

    Candidates are phrases with a count `a` of at least `least`. A cut after k words has l and r, the
    counts of both parts, and the score floor(scale * a / (l + r)); the lowest cut counts, of equal
    ones the one with the smallest k. A candidate goes if a longer one that holds its words in a row
    has `absorb_percent` % of its count. Order: score and a descending, phrase by UTF-8 bytes; no
    ties are left, as a phrase occurs once a language. `n` is the number of words of the language.
    Arithmetic is in 38-digit decimals. Null languages are `und`; languages without candidates and
    empty tables give no rows. `top` is the report's length, the only limit.
    """
    counts = keep(phrase_counts(docs, least, text_col, lang_col))
    spelled = counts.where("words > 1").withColumn("parts", F.split("phrase", " "))
    cuts = spelled.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang",
        "phrase",
        "words",
        F.col("count").alias("a"),
        "k",
        _joined(1, F.col("k")).alias("head"),
        _joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"),
    )
    known = counts.where("words > 0")
    heads = known.select("lang", F.col("phrase").alias("head"), F.col("count").alias("l"))
    tails = known.select("lang", F.col("phrase").alias("tail"), F.col("count").alias("r"))
    score = F.expr(f"(cast(a AS decimal(20, 0)) * {scale}BD) div (cast(l AS decimal(20, 0)) + r)")
    scored = (
        cuts.join(heads, ["lang", "head"])
        .join(tails, ["lang", "tail"])
        .groupBy("lang", "phrase", "a")
        .agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    )
    inner = F.expr(
        "flatten(transform(sequence(2, words - 1), s -> transform(sequence(1, words - s + 1),"
        " i -> array_join(slice(parts, i, s), ' '))))"
    )
    longer = (
        spelled.where("words > 2")
        .select("lang", F.col("count"), F.explode(inner).alias("phrase"))
        .groupBy("lang", "phrase")
        .agg(F.max("count").alias("around"))
    )
    absorbed = F.expr(f"cast(around AS decimal(20, 0)) * 100BD >= cast(a AS decimal(20, 0)) * {absorb_percent}BD")
    left = scored.join(longer, ["lang", "phrase"], "left").where(~F.coalesce(absorbed, F.lit(False)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    table = left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    shares = F.pmod(F.xxhash64("phrase"), F.lit(16))
    first = table.withColumn("share", shares).withColumn(
        "place", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))
    )
    ranked = first.where(F.col("place") <= top).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    )
    n = counts.where("words = 0").select("lang", F.col("count").alias("n"))
    return ranked.where(F.col("rank") <= top).join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
