"""Grouped prefix join: documents whose word-shingle sets are alike, exactly, with link counts.

1. Shingles that repeat inside a task come from common lines or copies; their counts order the
   tokens of every set from rare to frequent. Any order gives the same links; a good one keeps
   the prefixes of unrelated documents apart.
2. A set's prefix holds the tokens of which two linked sets must share one. Documents with the
   same prefix and size form one group, and only groups enter the inverted index.
3. Groups under a token are compared by size and by the position of the token. What passes is not
   written as pairs: it only marks two tiles (bounded bundles of alike groups) as worth a look.
   Inside marked tiles, groups stay that share enough prefix tokens with another.
4. These are expanded to the distinct sets of their members and verified whole. Each pair of sets
   lives in exactly one pair of tiles, so links are counted once and never enumerated.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.graph import components
from tabwright.llm.store import keep
from tabwright.llm.texts import portions, released, run_starts, shingles, text_bytes, whole_runs, word_hashes

WINDOW_TOKENS = 2_000_000
LOCAL_REPEATS = 2
ORDERED_TOKENS = 1 << 20
FILTER_BITS = 24
CELL_GROUPS = 1_024
TILE_SETS = 256
TILE_TOKENS = 400_000
SLAB = 2_048
SEEN_KEYS = 500_000
CELL = ("token", "low", "high")
UNIT = ("left", "right")


@dataclass(frozen=True)
class Similarity:
    """Shingles of `words` words; linked when 100 * intersection >= percent * union."""

    words: int = 5
    percent: int = 80

    def prefix(self, n: int) -> int:
        return n + (-self.percent * n) // 100 + 1

    def linked(self, shared: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return 100 * shared >= self.percent * (left + right - shared)

    def needed(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The smallest intersection with which sets of these sizes link."""
        return -(-self.percent * (left + right) // (100 + self.percent))


def _repeated(width: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in portions(batches):
            for hashes in word_hashes(text_bytes(part.column("text"))):
                found = shingles(hashes, width)
                held.append(found)
                size += len(found)
                if size >= WINDOW_TOKENS:
                    yield _counted(held)
                    held, size = [], 0
        if held:
            yield _counted(held)

    return released(run)


def _counted(held: list[np.ndarray]) -> pa.RecordBatch:
    tokens = np.concatenate(held)
    held.clear()
    tokens.sort()
    starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]]) if len(tokens) else np.zeros(0, dtype=np.int64)
    counts = np.diff(np.r_[starts, len(tokens)])
    often = counts >= LOCAL_REPEATS
    return pa.RecordBatch.from_pydict(
        {"token": tokens[starts[often]].view(np.int64), "n": counts[often].astype(np.int64)}
    )


def token_order(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens known to be frequent, sorted, and their ranks (a larger one is more frequent).

    Counts are kept for tokens seen twice in one window of a task. A token in G documents over P
    windows is seen so once G passes about the square root of P, so what is missed is rare. Only
    tokens holding at least a 2^20th of all counted occurrences stay, hence at most 2^20 of them.
    """
    counted = keep(
        texts.mapInArrow(_repeated(width), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    )
    total = counted.agg(F.sum("n")).first()[0] or 0
    table = counted.where(F.col("n") >= F.lit(total / ORDERED_TOKENS)).toPandas()
    tokens = table["token"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], table["n"].to_numpy(dtype=np.int64)[order]


class Order:
    """Tokens from rare to frequent: those not known to be frequent first, each kind by hash or count."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray):
        self.tokens, self.counts = tokens, counts
        self.maybe = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.maybe[tokens >> np.uint64(64 - FILTER_BITS)] = True

    def prefix(self, found: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The first `size` tokens of a set, and into how many chunks the index cuts each one's list."""
        known = self.maybe[found >> np.uint64(64 - FILTER_BITS)]
        likely = found[known]
        at = np.minimum(np.searchsorted(self.tokens, likely), max(len(self.tokens) - 1, 0))
        exact = self.tokens[at] == likely if len(likely) else likely.astype(bool)
        known[known] = exact
        rare = found[~known][:size]
        held = np.ones(len(rare), dtype=np.int64)
        if len(rare) < size:
            often = self.counts[at[exact]]
            place = np.argsort(often, kind="stable")[: size - len(rare)]
            rare = np.concatenate([rare, likely[exact][place]])
            held = np.concatenate([held, -(-often[place] // CELL_GROUPS)])
        return rare, held


def _signed(rule: Similarity, shared):
    """Per row: set size, key of the set, key of (prefix, size), and the prefix with the chunks of each token.

    A task that has just seen the same prefix leaves it out, so copies do not fill the index. Rows
    without an id never enter the index, so they leave theirs out and do not count as seen.
    """
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n", pa.int64()),
            ("set_key", pa.binary()),
            ("gkey", pa.int64()),
            ("prefix", pa.list_(pa.int64())),
            ("chunks", pa.list_(pa.int64())),
        ]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = Order(*shared.value), set()
        for part in portions(batches):
            sizes, set_keys, group_keys, prefixes, chunks = [], [], [], [], []
            named = part.column("doc_id").is_valid().to_pylist()
            for hashes, has_id in zip(word_hashes(text_bytes(part.column("text"))), named, strict=True):
                found = shingles(hashes, rule.words)
                prefix, held = order.prefix(found, rule.prefix(len(found)) if len(found) else 0)
                key = xxhash.xxh64_intdigest(prefix.tobytes(), seed=len(found))
                if key in seen or not has_id:
                    prefix, held = prefix[:0], held[:0]
                if has_id:
                    seen.add(key)
                sizes.append(len(found))
                set_keys.append(xxhash.xxh128_digest(found.tobytes()))
                group_keys.append(key)
                prefixes.append(prefix)
                chunks.append(held)
            if len(seen) > SEEN_KEYS:
                seen.clear()
            offsets = pa.array(np.cumsum([0, *map(len, prefixes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(set_keys, pa.binary()),
                    pa.array(np.array(group_keys, dtype=np.uint64).view(np.int64)),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(prefixes).view(np.int64))),
                    pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(chunks))),
                ],
                schema=schema,
            )

    return released(run)


def _run_pairs(
    rule: Similarity, table: dict[str, np.ndarray], begin: int, end: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, later rows of alike size, which of them pass by position) inside one cell of the index."""
    n, pos, chunk, gkey = (table[c] for c in ("n", "pos", "chunk", "gkey"))
    within = table["low"][begin] == table["high"][begin]
    for i in range(begin, end - 1):
        limit = begin + int(np.searchsorted(n[begin:end], 100 * n[i] // rule.percent, side="right"))
        if limit > i + 1:
            later = np.arange(i + 1, limit)
            met = gkey[later] != gkey[i]
            if not within:
                met &= chunk[later] != chunk[i]
            later = later[met]
            if len(later):
                bound = 1 + np.minimum(n[i] - pos[i] - 1, n[later] - pos[later] - 1)
                yield i, later, bound >= rule.needed(n[i], n[later])


def _columns(table: pa.Table) -> dict[str, np.ndarray]:
    return {c: table[c].to_numpy() for c in table.column_names}


def _candidates(rule: Similarity):
    """Postings with a partner of alike size in their cell.

    `leader` is the smallest group key among the posting's own and the partners it passes with by
    position, null if it passes with none.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for arrow in whole_runs(batches, CELL):
            table = _columns(arrow)
            starts = run_starts(arrow, CELL)
            lengths = np.diff(np.r_[starts, arrow.num_rows])
            n, pos, gkey, chunk = (table[c] for c in ("n", "pos", "gkey", "chunk"))
            leader = gkey.copy()
            kept = np.zeros(arrow.num_rows, dtype=bool)
            passed = np.zeros(arrow.num_rows, dtype=bool)
            one = starts[lengths == 2]
            two = one + 1
            met = (gkey[one] != gkey[two]) & (100 * n[one] >= rule.percent * n[two])
            met &= (table["low"][one] == table["high"][one]) | (chunk[one] != chunk[two])
            one, two = one[met], two[met]
            good = 1 + np.minimum(n[one] - pos[one] - 1, n[two] - pos[two] - 1) >= rule.needed(n[one], n[two])
            for row in (one, two):
                kept[row] = True
                passed[row] = good
                leader[row] = np.minimum(gkey[one], gkey[two])
            for begin, length in zip(starts[lengths > 2].tolist(), lengths[lengths > 2].tolist(), strict=True):
                for i, later, fits in _run_pairs(rule, table, begin, begin + length):
                    kept[i] = kept[later] = True
                    if fits.any():
                        fitting = later[fits]
                        passed[i] = passed[fitting] = True
                        leader[i] = min(leader[i], gkey[fitting].min())
                        leader[fitting] = np.minimum(leader[fitting], gkey[i])
            if kept.any():
                rows = arrow.filter(pa.array(kept))
                rows = rows.append_column("leader", pa.array(leader[kept], mask=~passed[kept]))
                yield from rows.combine_chunks().to_batches()

    return released(run)


def _marked_tiles(rule: Similarity):
    """Pairs of tiles with a pair of groups that may link."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for arrow in whole_runs(batches, CELL):
            table = _columns(arrow)
            tile = table["tile"]
            starts = run_starts(arrow, CELL)
            fresh: list[tuple[int, int]] = []
            for begin, end in zip(starts.tolist(), [*starts[1:].tolist(), arrow.num_rows], strict=True):
                for i, later, fits in _run_pairs(rule, table, begin, end):
                    for other in np.unique(tile[later[fits]]).tolist():
                        pair = (min(int(tile[i]), other), max(int(tile[i]), other))
                        if pair not in seen:
                            seen.add(pair)
                            fresh.append(pair)
            if len(seen) > SEEN_KEYS:
                seen.clear()
            if fresh:
                yield pa.RecordBatch.from_pydict(
                    {"left": np.array([a for a, _ in fresh]), "right": np.array([b for _, b in fresh])}
                )

    return released(run)


def _promising(rule: Similarity):
    """Groups of a tile pair that share enough prefix tokens with one across.

    Of two sets, the one whose prefix ends earlier in the token order has all its common prefix
    tokens in the other's prefix too, so the intersection is at most those plus its own rest.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, UNIT):
            starts = run_starts(table, UNIT)
            for begin, end in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
                rows = table.slice(begin, end - begin)
                n, tile, sets, gkey = (rows[c].to_numpy() for c in ("n", "tile", "sets", "gkey"))
                tokens = [np.array(t, dtype=np.int64) for t in rows["tokens"].to_pylist()]
                rest = n - np.array([rule.prefix(int(x)) for x in n])
                fits = _overlaps(tokens) >= rule.needed(n[:, None], n[None, :]) - np.maximum(
                    rest[:, None], rest[None, :]
                )
                fits &= 100 * np.minimum(n[:, None], n[None, :]) >= rule.percent * np.maximum(n[:, None], n[None, :])
                fits &= gkey[:, None] != gkey[None, :]
                left, right = rows["left"][0].as_py(), rows["right"][0].as_py()
                if left != right:
                    fits &= (tile == left)[:, None] != (tile == left)[None, :]
                good = fits.any(axis=1) | (sets > 1)
                if good.any():
                    yield from rows.select([*UNIT, "tile", "gkey"]).filter(pa.array(good)).to_batches()

    return released(run)


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all pairs, from the tokens that at least two sets hold, in column slabs."""
    m = len(sets)
    shared = np.zeros((m, m), dtype=np.int64)
    tokens = np.concatenate(sets)
    if len(tokens) == 0:
        return shared
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    fresh = np.r_[True, tokens[1:] != tokens[:-1]]
    column = np.cumsum(fresh) - 1
    common = np.bincount(column)[column] > 1
    owner, column = owner[common], column[common]
    if len(column):
        column = np.cumsum(np.r_[False, column[1:] != column[:-1]])
    columns = int(column[-1]) + 1 if len(column) else 0
    for begin in range(0, columns, SLAB):
        a, b = np.searchsorted(column, [begin, begin + SLAB])
        slab = np.zeros((m, min(SLAB, columns - begin)), dtype=np.float32)
        slab[owner[a:b], column[a:b] - begin] = 1
        shared += np.rint(slab @ slab.T).astype(np.int64)
    return shared


def _verified(rule: Similarity):
    """Per set: how many documents its linked sets stand for, and the smallest set linked through this tile pair."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, UNIT):
            starts = run_starts(table, UNIT)
            for begin, end in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
                if end - begin > 1:
                    found = unit(table.slice(begin, end - begin))
                    if found is not None:
                        yield found

    def unit(table: pa.Table) -> pa.RecordBatch | None:
        sets, rep, tile, size, seen = [], [], [], [], set()
        rows = zip(
            *(table[c].to_pylist() for c in ("rep", "tile", "size", "set_key")),
            word_hashes(text_bytes(table["text"])),
            strict=True,
        )
        for one, at, many, key, hashes in rows:
            if (one, key) in seen:
                continue
            found = shingles(hashes, rule.words)
            if xxhash.xxh128_digest(found.tobytes()) == key:
                seen.add((one, key))
                sets.append(found)
                rep.append(one)
                tile.append(at)
                size.append(many)
        if len(sets) < 2:
            return None
        n = np.array([len(s) for s in sets])
        linked = rule.linked(_overlaps(sets), n[:, None], n[None, :])
        np.fill_diagonal(linked, False)
        left, right = table["left"][0].as_py(), table["right"][0].as_py()
        if left != right:
            side = np.array(tile) == left
            linked &= side[:, None] != side[None, :]
        touched = np.flatnonzero(linked.any(axis=1))
        if len(touched) == 0:
            return None
        linked = linked[np.ix_(touched, touched)]
        ids, weight = np.array(rep)[touched], np.array(size)[touched]
        root = ids.copy()
        while True:
            least = np.minimum(root, np.where(linked, root[None, :], np.iinfo(np.int64).max).min(axis=1))
            if (least == root).all():
                break
            root = least
        return pa.RecordBatch.from_pydict({"rep": ids, "links": linked @ weight, "root": root})

    return released(run)


def jaccard_join(
    docs: DataFrame, rule: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, n_links (documents it links to), class_id.

    Links are exact. class_id is the smallest document with the very same shingle set; component_id
    the smallest one reachable by links. Documents without words (empty or null text) and rows
    without an id have no links: their component is their own id, null if they have none. Rows
    that share an id count as one node for components, and each of them as a document for links.
    Other columns of `docs` are not read, so their names cannot clash. An empty table gives none.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared_order = spark.sparkContext.broadcast(token_order(texts.select("text"), rule.words))
    signed = keep(
        texts.mapInArrow(
            _signed(rule, shared_order),
            "doc_id long, n long, set_key binary, gkey long, prefix array<long>, chunks array<long>",
        )
    )
    usable = signed.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = keep(
        usable.groupBy("n", "set_key", "gkey").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"))
    )
    need = _needed(usable, classes, rule)
    verified = keep(
        texts.join(need, F.col("doc_id") == F.col("rep"))
        .select("left", "right", "tile", "rep", "size", "set_key", "text")
        .repartition(*UNIT)
        .sortWithinPartitions(*UNIT)
        .mapInArrow(_verified(rule), "rep long, links long, root long")
    )
    named = (
        classes.join(verified.groupBy("rep").agg(F.sum("links").alias("links")), "rep", "left")
        .join(components(verified, "rep", "root").withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            F.col("n").alias("_n"),
            F.col("set_key").alias("_set"),
            F.col("rep").alias("class_id"),
            F.coalesce("component", "rep").alias("_component"),
            (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("_links"),
        )
    )
    own = signed.select("doc_id", "n", "set_key", F.col("doc_id").isNotNull().alias("named"))
    return own.join(
        named, (F.col("n") == F.col("_n")) & (F.col("set_key") == F.col("_set")) & F.col("named"), "left"
    ).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("_component", "doc_id").alias("component_id"),
        F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("class_id", "doc_id").alias("class_id"),
    )


def _needed(usable: DataFrame, classes: DataFrame, rule: Similarity) -> DataFrame:
    """The sets to verify: one row per set and pair of tiles.

    Only groups with a partner that passes the filters get a tile. It bundles those with the same
    leader (the smallest partner), and a hash cuts it into parts of bounded sets and tokens; a
    group with many sets is cut the same way. The list of a frequent token is cut into chunks,
    and each chunk meets each other one in a cell of its own.
    """
    postings = usable.select(
        "gkey", "n", F.posexplode(F.arrays_zip("prefix", "chunks")).alias("pos", "posting")
    ).select("gkey", "n", F.col("pos").cast("long").alias("pos"), "posting.*")
    cells = (
        postings.withColumn("chunk", F.pmod(F.xxhash64("gkey", F.lit(7)), F.col("chunks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        .select(
            F.col("prefix").alias("token"),
            F.least("chunk", "other").alias("low"),
            F.greatest("chunk", "other").alias("high"),
            "n",
            "pos",
            "chunk",
            "gkey",
        )
    )
    candidates = keep(
        cells.repartition(*CELL)
        .sortWithinPartitions(*CELL, "n")
        .mapInArrow(_candidates(rule), f"{', '.join(f'{c} long' for c in cells.columns)}, leader long")
    )
    crowds = classes.groupBy("gkey").agg(F.count("*").alias("sets"), F.max("n").alias("n"))
    led = candidates.groupBy("gkey").agg(F.min("leader").alias("label"))
    placed = (
        crowds.join(led, "gkey", "left")
        .where(F.col("label").isNotNull() | (F.col("sets") > 1))
        .withColumn("label", F.coalesce("label", "gkey"))
    )
    bundles = lambda sets, tokens: F.greatest(F.ceil(sets / TILE_SETS), F.ceil(tokens / TILE_TOKENS))
    weight = F.col("sets") * F.col("n")
    parts = placed.groupBy("label").agg(bundles(F.sum("sets"), F.sum(weight)).alias("parts"))
    tiles = keep(
        placed.join(parts, "label")
        .withColumn("pieces", F.least(bundles(F.col("sets"), weight), F.col("sets")))
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))
        .withColumn("part", F.pmod(F.xxhash64("gkey", "piece"), F.col("parts")))
        .select("gkey", "n", "piece", "pieces", "sets", F.xxhash64("label", "part").alias("tile"))
    )
    members = (
        classes.join(tiles, "gkey")
        .where(F.pmod(F.xxhash64("set_key"), F.col("pieces")) == F.col("piece"))
        .select("gkey", "rep", "size", "set_key", "tile")
    )
    marked = (
        candidates.drop("leader")
        .join(tiles.select("gkey", "tile"), "gkey")
        .select(*CELL, "n", "pos", "chunk", "gkey", "tile")
        .repartition(*CELL)
        .sortWithinPartitions(*CELL, "n")
        .mapInArrow(_marked_tiles(rule), "left long, right long")
    )
    crowded = tiles.where("sets > 1").select("gkey", "tile").distinct()
    inside = crowded.select("gkey", F.col("tile").alias("left")).join(
        crowded.select("gkey", F.col("tile").alias("right")), "gkey"
    )
    units = keep(marked.unionByName(inside.where("left <= right").select(*UNIT)).distinct())
    lists = candidates.groupBy("gkey").agg(F.collect_set("token").alias("tokens"))
    listed = tiles.join(lists, "gkey", "left").withColumn(
        "tokens", F.coalesce("tokens", F.array().cast("array<long>"))
    )
    return (
        units.withColumn("tile", F.explode(F.array_distinct(F.array(*UNIT))))
        .join(listed.select("tile", "gkey", "n", "sets", "tokens"), "tile")
        .select(*UNIT, "tile", "gkey", "n", "sets", "tokens")
        .repartition(*UNIT)
        .sortWithinPartitions(*UNIT)
        .mapInArrow(_promising(rule), "left long, right long, tile long, gkey long")
        .distinct()
        .join(members, ["gkey", "tile"])
    )
