"""Exact nearest neighbours, and work on pairs of row blocks, with bounded groups.

Rows are placed in cells around pivots drawn from the table, about the root of its size in
number. A first round looks only inside a row's own cell, which bounds how far its k-th neighbour
can be; a second round visits just the cells that can still hold something nearer. Both sides of
a cell are cut into blocks by a hash of the id, so a crowded cell becomes many small groups, and
each group hands on at most k rows per query. Copies of a vector are asked once, and of many
copies only the first few can be anyone's neighbour, so crowds of copies are folded beforehand.

Long vectors let cells rule out little. Where visits were counted to send more rows than a pass of all
base rows by blocks of queries would, the latter is taken: each block stays in one task, which reads the base
as a stream of pieces and keeps k rows per query.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain, groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwright.functions.sampling import SEED, pick
from tabwright.functions.vectors import exact_distance, pairwise, rough_squares, slices, unpack
from tabwright.session import cut_lineage

BLOCK_ROWS = 2_000
MAX_PIVOTS = 8_192
ROWS_PER_PIVOT = 50
# Numbers in the vectors of the visits that a task hands on at once: a wide row may visit every cell.
VISIT_NUMBERS = 500_000
# Numbers that a streamed block of left rows holds in its task, and right rows that come to it at once.
STREAM_NUMBERS = 4_000_000
PIECE_ROWS = 2_000
# How many times the pairs of the visits a pass of all pairs, whose distances come from matrix products, may take.
MORE_PAIRS = 4
NEIGHBOR_SCHEMA = "id long, neighbor long, distance double"


def as_vector(df: DataFrame, columns: Sequence[str], output: str = "vec") -> DataFrame:
    """Number columns as one array of doubles."""
    return df.withColumn(output, F.array(*[F.col(c).cast("double") for c in columns]))


def blocks_for(rows: int, block_rows: int = BLOCK_ROWS) -> int:
    return max(1, math.ceil(rows / block_rows))


def block_sizes(left: DataFrame, right: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(cell, _lb, _rb): into how many blocks each side of a cell is cut; cells with one empty side are left out."""

    def blocks(df, name):
        count = F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int")
        return df.groupBy("cell").agg(F.greatest(F.lit(1), count).alias(name))

    return blocks(left, "_lb").join(blocks(right, "_rb"), "cell")


def block_pairs(
    left: DataFrame,
    right: DataFrame,
    sizes: DataFrame | tuple[int, int],
    work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
    together: Sequence[str] = ("id",),
) -> DataFrame:
    """Run `work` on every (left block, right block) of a cell.

    Both frames have columns id, vec and cell; `sizes` says how often a cell is cut: a table per
    cell, or one pair of numbers when there is a single cell. A group holds about BLOCK_ROWS rows
    a side whatever the size of its cell. Right rows that are alike in the columns `together` stay in one block.
    """

    def cut(df, own, other, mine, theirs, seed, alike=("id",)):
        place = F.pmod(F.xxhash64(F.lit(seed), *alike), F.col(own)).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        if isinstance(sizes, tuple):
            df = df.withColumns({"_lb": F.lit(sizes[0]), "_rb": F.lit(sizes[1])})
        else:
            df = df.join(sizes, "cell")
        out = df.withColumn(mine, place).withColumn(theirs, copies).drop("_lb", "_rb")
        # fresh column identities, so that a frame can be paired with itself
        return out.select(*[F.col(c).alias(c) for c in out.columns])

    keys = ["cell", "_l", "_r"]
    a = cut(left, "_lb", "_rb", "_l", "_r", 1).groupBy(*keys)
    b = cut(right, "_rb", "_lb", "_r", "_l", 2, together).groupBy(*keys)

    def guarded(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame() if x.empty or y.empty else work(x, y)

    return a.cogroup(b).applyInPandas(guarded, schema)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of arrays of equal length, one a row; of whole numbers or not."""
    rows = len(column)
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(rows, -1)


def _pieces(rows: int, block: int | None):
    """Rows as binary pieces (_block, _side, _order, _rows): right ones of `rows` rows for every block, left ones by block."""

    def written(batch: pa.RecordBatch) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        return sink.getvalue().to_pybytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            places = batch.column("_place").to_numpy()
            kept = batch.drop_columns(["_place"])
            if block is None:  # left rows, those of a block together
                order = np.argsort(places, kind="stable")
                starts = np.flatnonzero(np.r_[True, np.diff(places[order]) != 0])
                parts = [(int(places[order[a]]), 0, 0, written(kept.take(pa.array(order[a:b])))) for a, b in zip(starts, [*starts[1:], len(order)], strict=True)]
            else:
                parts = []
                for at in range(0, batch.num_rows, rows):
                    parts.append((block, 1, (int(places[at]) << 33) + number, written(kept.slice(at, rows))))
                    number += 1
            for part in parts:
                yield pa.RecordBatch.from_pydict({n: [v] for n, v in zip(("_block", "_side", "_order", "_rows"), part, strict=True)}, schema=_PIECES)

    return run


_PIECES = pa.schema([("_block", pa.int32()), ("_side", pa.int32()), ("_order", pa.int64()), ("_rows", pa.binary())])


def stream_blocks(df: DataFrame, rows: int, numbers: int) -> int:
    """Blocks of left rows with `numbers` numbers each: as many as their memory needs, or as keep the cores busy."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-rows * numbers // STREAM_NUMBERS), min(2 * cores, blocks_for(rows)))


def streamed(
    left: DataFrame,
    right: DataFrame,
    blocks: int,
    fold: Callable[[pa.Table, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Run `fold` on every block of left rows (by their id) and the pieces of all right rows, in their order.

    A left row is sent once and a right row once per block, packed; what comes out is what `fold` makes of a block
    when it has seen all right rows, so nothing per pair of blocks is written down.
    """
    types = "_block int, _side int, _order long, _rows binary"
    own = left.withColumn("_place", F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(blocks)).cast("int"))
    theirs = right.withColumn("_place", F.spark_partition_id())
    every = theirs.mapInArrow(_pieces(piece_rows, 0), types).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    both = own.mapInArrow(_pieces(piece_rows, None), types).unionByName(every)
    dealt = both.repartitionById(blocks, "_block").sortWithinPartitions("_block", "_side", "_order")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = chain.from_iterable(zip(*[b.column(i).to_pylist() for i in (0, 1, 3)], strict=True) for b in batches)
        for _, block in groupby(rows, key=lambda row: row[0]):
            mine: list[pa.RecordBatch] = []
            first = None
            for _, side, piece in block:
                if side:
                    first = piece
                    break
                mine.append(pa.ipc.open_stream(piece).read_next_batch())
            if mine:
                rest = (piece for _, _, piece in block)
                others = chain([first], rest) if first is not None else iter(())
                yield from fold(pa.Table.from_batches(mine), (pa.ipc.open_stream(p).read_next_batch() for p in others))

    return dealt.mapInArrow(run, schema)


def _place(pivots: np.ndarray):
    """Nearest pivot of each row and the distance to it."""

    def place(frames):
        for frame in frames:
            vectors = unpack(frame["vec"])
            cell, gap = np.zeros(len(frame), dtype="int32"), np.zeros(len(frame))
            for part in slices(len(frame), len(pivots)):
                distances = pairwise(vectors[part], pivots)
                cell[part] = distances.argmin(axis=1)
                gap[part] = distances.min(axis=1)
            yield frame.assign(cell=cell, gap=gap)

    return place


def _visits(pivots: np.ndarray, radius: np.ndarray):
    """Other cells that may hold a row nearer than what the home cell offered.

    A cell is out of reach when its ball around the pivot is, or when the plane halfway between
    the two pivots is: every row of a cell lies on its own pivot's side of it.
    """
    between = np.maximum(pairwise(pivots, pivots), 1e-300)

    def visits(frames):
        for frame in frames:
            vectors, reach = unpack(frame["vec"]), frame["reach"].to_numpy()
            for part in slices(len(frame), len(pivots)):
                distances = pairwise(vectors[part], pivots)
                home = distances.argmin(axis=1)
                own = distances[np.arange(len(distances)), home]
                squares = distances**2
                plane = (squares * (1 - 1e-14) - own[:, None] ** 2 * (1 + 1e-14)) / (2 * between[home])
                near = np.maximum(distances - radius[None, :], plane) <= reach[part, None] * (1 + 1e-9) + 1e-9
                near[np.arange(len(distances)), home] = False
                rows, cells = np.nonzero(near & np.isfinite(radius)[None, :])
                chosen, dealt = frame.iloc[part], max(1, VISIT_NUMBERS // vectors.shape[1])
                for at in range(0, len(rows), dealt):
                    some = rows[at : at + dealt]
                    yield pd.DataFrame(
                        {
                            "id": chosen["id"].to_numpy()[some],
                            "vec": chosen["vec"].to_numpy()[some],
                            "cell": cells[at : at + dealt].astype("int32"),
                        }
                    )

    return visits


def _nearest_in_block(k: int):
    """The k nearest of each left row among the right rows, ties to the smaller id."""

    def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, y = unpack(a["vec"]), unpack(b["vec"])
        ids, theirs = a["id"].to_numpy(), b["id"].to_numpy()
        rough, slack = rough_squares(x, y)
        if k < len(b):
            bar = np.partition(rough, k - 1, axis=1)[:, k - 1] + 2 * slack
            rows, columns = np.nonzero(rough <= bar[:, None])
        else:
            rows, columns = np.nonzero(np.ones_like(rough, dtype=bool))
        distance = exact_distance(x, y, rows, columns)
        order = np.lexsort((theirs[columns], distance, rows))
        rows, columns, distance = rows[order], columns[order], distance[order]
        first = np.searchsorted(rows, rows)
        kept = np.arange(len(rows)) - first < k
        return pd.DataFrame({"id": ids[rows[kept]], "neighbor": theirs[columns[kept]], "distance": distance[kept]})

    return work


def _some_distances(x: np.ndarray, y: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """`exact_distance`, of so many pairs at once that their gaps stay small."""
    out = np.empty(len(rows))
    for part in slices(len(rows), x.shape[1]):
        out[part] = exact_distance(x, y, rows[part], columns[part])
    return out


def _nearest_of_stream(k: int):
    """The k nearest of each left row (id, vec, reach) among all pieces, ties to the smaller id; no k-th is beyond `reach`."""

    def fold(left: pa.Table, pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, ids, bar = matrix(left["vec"]), left["id"].to_numpy(), left["reach"].to_numpy().copy()
        far, near = np.full((len(x), k), np.inf), np.zeros((len(x), k), dtype=np.int64)
        for piece in pieces:
            y, theirs = matrix(piece.column("vec")), piece.column("id").to_numpy()
            for part in slices(len(x), len(y)):
                rough, slack = rough_squares(x[part], y)
                limit = bar[part] ** 2 * (1 + 1e-9) + 2 * slack
                if k < len(y) and np.count_nonzero(rough <= limit[:, None]) > 4 * k * len(rough):
                    limit = np.minimum(limit, np.partition(rough, k - 1, axis=1)[:, k - 1] + 2 * slack)
                rows, columns = np.nonzero(rough <= limit[:, None])
                if not len(rows):
                    continue
                rows += part.start
                distance = _some_distances(x, y, rows, columns)
                asked = rows[np.flatnonzero(np.r_[True, np.diff(rows) != 0])]
                at = np.concatenate([np.repeat(asked, k), rows])
                gaps = np.concatenate([far[asked].ravel(), distance])
                names = np.concatenate([near[asked].ravel(), theirs[columns]])
                order = np.lexsort((names, gaps, at))
                order = order[np.arange(len(at)) - np.searchsorted(at[order], at[order]) < k]
                far[asked], near[asked] = gaps[order].reshape(-1, k), names[order].reshape(-1, k)
                bar[asked] = np.minimum(bar[asked], far[asked, -1])
        for part in slices(len(x), 40 * k):
            found = np.isfinite(far[part])
            yield pa.RecordBatch.from_pydict(
                {"id": np.repeat(ids[part], k)[found.ravel()], "neighbor": near[part][found], "distance": far[part][found]}
            )

    return fold


def _ranked(df: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbor"))
    return df.withColumn("rank", place).where(F.col("rank") <= k)


def _search(queries: DataFrame, base: DataFrame, rows: int, k: int, block_rows: int, max_pivots: int) -> DataFrame:
    """k nearest base rows of each query row, itself included when it is in the base."""
    wanted = min(max_pivots, max(1, round(math.sqrt(rows / ROWS_PER_PIVOT))))
    pivots = unpack([r.vec for r in pick(base, ["id"], wanted, SEED).collect()])
    schema = "id long, vec array<double>, cell int, gap double"
    placed = base.mapInPandas(_place(pivots), schema)
    homes = placed.drop("gap")
    askers = queries.mapInPandas(_place(pivots), schema).drop("gap")
    work = _nearest_in_block(k)
    if len(pivots) == 1:
        sizes = blocks_for(queries.count(), block_rows), blocks_for(rows, block_rows)
        return _ranked(block_pairs(askers, homes, sizes, work, NEIGHBOR_SCHEMA), k)
    first = _ranked(
        block_pairs(askers, homes, block_sizes(askers, homes, block_rows), work, NEIGHBOR_SCHEMA), k
    ).drop("rank")
    first = cut_lineage(first)
    radius = np.full(len(pivots), -np.inf)
    held = np.zeros(len(pivots), dtype=np.int64)
    for row in placed.groupBy("cell").agg(F.max("gap").alias("radius"), F.count(F.lit(1)).alias("n")).collect():
        radius[row.cell], held[row.cell] = row.radius, row.n
    reach = first.groupBy("id").agg(F.max("distance").alias("far"), F.count(F.lit(1)).alias("found"))
    bounded = queries.join(reach, "id", "left").select(
        "id", "vec", F.when(F.col("found") >= k, F.col("far")).otherwise(F.lit(float("inf"))).alias("reach")
    )
    visits = bounded.mapInPandas(_visits(pivots, radius), "id long, vec array<double>, cell int")
    visited = np.zeros(len(pivots), dtype=np.int64)
    for row in visits.groupBy("cell").count().collect():
        visited[row["cell"]] = row["count"]
    met = np.flatnonzero((visited > 0) & (held > 0))
    left_blocks, right_blocks = -(-visited // block_rows), -(-held // block_rows)
    asked = queries.count()
    blocks = stream_blocks(queries, asked, pivots.shape[1] + 2 * k)
    sent = int((visited * right_blocks + held * left_blocks)[met].sum())
    if asked + blocks * rows < sent and asked * rows <= MORE_PAIRS * int((visited * held)[met].sum()):
        return _ranked(streamed(bounded, base, blocks, _nearest_of_stream(k), NEIGHBOR_SCHEMA), k)
    cells = [(int(c), int(left_blocks[c]), int(right_blocks[c])) for c in met]
    sizes = queries.sparkSession.createDataFrame(cells, "cell int, _lb int, _rb int")
    second = block_pairs(visits, homes, sizes, work, NEIGHBOR_SCHEMA)
    return _ranked(first.unionByName(second), k)


def _folded(df: DataFrame, keep: int) -> DataFrame:
    """Of each vector the rows with the smallest ids; more copies cannot be among anyone's nearest."""
    place = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    return df.withColumn("_copy", place).where(F.col("_copy") <= keep).drop("_copy")


def nearest(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    same: bool = False,
    block_rows: int = BLOCK_ROWS,
    max_pivots: int = MAX_PIVOTS,
) -> DataFrame:
    """(id, neighbor, distance, rank) of the k nearest base rows of each query row, exactly.

    Both frames have columns id (long) and vec (array of double). With `same` a row is not its
    own neighbour. Equal distances go to the smaller neighbour id.
    """
    queries, base = queries.select("id", "vec"), base.select("id", "vec")
    reach = k + 1 if same else k
    rows, kinds = base.agg(F.count(F.lit(1)), F.countDistinct(F.xxhash64("vec"))).first()
    asked, asked_kinds = queries.agg(F.count(F.lit(1)), F.countDistinct(F.xxhash64("vec"))).first()
    if rows == 0 or asked == 0:
        return queries.sparkSession.createDataFrame([], NEIGHBOR_SCHEMA + ", rank int")
    known = _folded(base, reach) if kinds < rows else base
    if asked_kinds < asked:
        one = cut_lineage(queries.groupBy("vec").agg(F.min("id").alias("id")))
        found = _search(one, known, rows, reach, block_rows, max_pivots)
        members = queries.join(one.withColumnRenamed("id", "_one"), "vec").select("id", "_one")
        found = found.select(F.col("id").alias("_one"), "neighbor", "distance").join(members, "_one").drop("_one")
    else:
        found = _search(queries, known, rows, reach, block_rows, max_pivots)
    if same:
        found = found.where(F.col("id") != F.col("neighbor"))
    return _ranked(found.select("id", "neighbor", "distance"), k)


def classify_by_neighbors(neighbors: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """(id, label) by majority of the k nearest; among equal counts the class that got there first wins.

    `labels` has columns neighbor and label.
    """
    ranked = neighbors.where(F.col("rank") <= k).join(labels, "neighbor")
    votes = ranked.groupBy("id", "label").agg(F.count(F.lit(1)).alias("votes"), F.max("rank").alias("last"))
    return votes.groupBy("id").agg(
        F.max_by("label", F.struct(F.col("votes"), (-F.col("last")).alias("place"))).alias("label")
    )
