"""Trees, forests and boosting by level-wise histograms, with the tree kept as a table of nodes.

Every feature is cut at about 25 exact order statistics, and a row becomes the numbers of its bins, a
byte a feature, written once. A level of all trees is one pass over these: tasks walk
their rows down the trees so far and add (node, feature, bin) sums for the nodes still growing, Spark
adds those up, and the best cut of each node comes back as one row. A node looks at the root of the
number of features, drawn by a hash of tree and node. Splits go by Gini impurity or squared error,
`x <= threshold` goes left, a missing value goes right.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.functions.columns import quoted
from tabwright.functions.sampling import SEED
from tabwright.functions.statistics import order_stats
from tabwright.session import written

CUTS = 25
CELLS = 4_000_000
MAX_CLASSES = 1_000
NODE_SCHEMA = (
    "tree int, node long, depth int, feature string, threshold double, n double, value double, gain double"
)
# P(draws <= k) of a row that is drawn once on average: n draws with replacement from n rows.
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])


def feature_subset(features: int, tree: int, node: int, seed: int = SEED) -> list[int]:
    """The features that a node may split on: the root of their number, at least one, by a hash."""
    ranked = sorted(range(features), key=lambda f: hashlib.md5(f"{seed}/{tree}/{node}/{f}".encode()).hexdigest())
    return sorted(ranked[: max(1, math.isqrt(features))])


def cut_points(df: DataFrame, features: Sequence[str], cuts: int = CUTS) -> list[list[float]]:
    """For each feature the distinct values at ranks floor(n i / (cuts + 1)), exactly."""
    wanted = tuple(i / (cuts + 1) for i in range(1, cuts + 1))
    numbers = df.select(*[F.col(quoted(f)).cast("double").alias(f"f{i}") for i, f in enumerate(features)])
    found = order_stats(numbers, {f"f{i}": wanted for i in range(len(features))})
    return [sorted({v for v in found[f"f{i}"].values() if v is not None}) for i in range(len(features))]


@dataclass
class Nodes:
    """Nodes of some trees in arrays; heap numbers (children 2i and 2i + 1) name them in tables."""

    features: list[str]
    roots: list[int] = field(default_factory=list)
    tree: list[int] = field(default_factory=list)
    number: list[int] = field(default_factory=list)
    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    n: list[float] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, tree: int, number: int, n: float = 0.0, value: float = 0.0) -> int:
        for column, item in zip(
            (self.tree, self.number, self.feature, self.threshold, self.cut, self.left, self.n, self.value, self.gain),
            (tree, number, -1, 0.0, -1, -1, n, value, 0.0),
            strict=True,
        ):
            column.append(item)
        return len(self.tree) - 1

    def walker(self, binned: bool = False) -> Callable[[np.ndarray, int], np.ndarray]:
        """Rows, as values or as numbers of bins, to the place of the node they end in; a right child lies behind its left one."""
        feature, left = np.array(self.feature), np.array(self.left)
        threshold = np.array(self.cut if binned else self.threshold)

        def walk(x: np.ndarray, root: int) -> np.ndarray:
            at = np.full(len(x), root)
            going = np.flatnonzero(feature[at] >= 0)
            while len(going):
                here = at[going]
                low = x[going, feature[here]] <= threshold[here]
                at[going] = left[here] + ~low
                going = going[feature[at[going]] >= 0]
            return at

        return walk

    def table(self, spark) -> DataFrame:
        rows = [
            (t, i, i.bit_length() - 1, self.features[f] if f >= 0 else None, float(c) if f >= 0 else None, float(n), float(v), float(g))
            for t, i, f, c, n, v, g in zip(
                self.tree, self.number, self.feature, self.threshold, self.n, self.value, self.gain, strict=True
            )
        ]
        return spark.createDataFrame(rows, NODE_SCHEMA)

    @classmethod
    def read(cls, table: DataFrame, features: Sequence[str]) -> Nodes:
        """Nodes from the rows that `table` wrote."""
        nodes = cls(list(features))
        place: dict[tuple[int, int], int] = {}
        for r in sorted(table.collect(), key=lambda r: (r.tree, r.node)):
            at = place[r.tree, r.node] = nodes.add(r.tree, r.node, r.n, r.value)
            nodes.gain[at] = r.gain
            if r.feature is not None:
                nodes.feature[at], nodes.threshold[at] = nodes.features.index(r.feature), r.threshold
            if r.node == 1:
                nodes.roots.append(at)
        for (tree, number), at in place.items():
            if nodes.feature[at] >= 0:
                nodes.left[at] = place[tree, 2 * number]
        return nodes

    def importance(self, top: int = 10) -> list[tuple[str, float]]:
        """Share of the rows that the splits on a feature saw, largest first, without zeros."""
        seen = [0.0] * len(self.features)
        for f, n in zip(self.feature, self.n, strict=True):
            if f >= 0:
                seen[f] += n
        whole = sum(seen)
        shares = [(name, s / whole) for name, s in zip(self.features, seen, strict=True) if s > 0]
        return sorted(shares, key=lambda item: (-item[1], item[0]))[:top]


def _code_type(edges: Sequence[Sequence[float]]) -> str:
    """The smallest whole numbers that hold every bin."""
    return np.min_scalar_type(max([len(e) for e in edges], default=0)).str


def _binned(rows: DataFrame, features: int, edges: Sequence[Sequence[float]]) -> DataFrame:
    """Rows (f0, f1, …, others) as (x, others): x holds the bin of every feature, a missing value lies in the last one."""
    cuts, code = [np.array(e, dtype=float) for e in edges], _code_type(edges)
    names = [f"f{i}" for i in range(features)]
    others = [f for f in rows.schema.fields if f.name not in names]

    def binned(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.empty((batch.num_rows, features), dtype=code)
                for i, name in enumerate(names):
                    x[:, i] = np.searchsorted(cuts[i], batch.column(name).to_numpy(zero_copy_only=False).astype(float))
                cells, width = x.tobytes(), features * x.itemsize
                codes = pa.array([cells[at : at + width] for at in range(0, len(cells), width)], pa.binary())
                yield pa.RecordBatch.from_arrays([codes, *[batch.column(f.name) for f in others]], names=["x", *[f.name for f in others]])

    schema = ", ".join(["x binary", *[f"{f.name} {f.dataType.simpleString()}" for f in others]])
    return written(rows.mapInArrow(binned, schema))


def _matrix(frame: pd.DataFrame, code: str) -> np.ndarray:
    return np.frombuffer(b"".join(frame["x"]), dtype=code).reshape(len(frame), -1)


def draws(keys: np.ndarray, tree: int) -> np.ndarray:
    """How often each row is drawn for a tree, by a hash of its key: 1 on average, Poisson."""
    with np.errstate(over="ignore"):
        mixed = keys.astype(np.uint64) ^ (np.uint64(tree + 1) * np.uint64(0x9E3779B97F4A7C15))
        mixed = (mixed ^ (mixed >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        mixed = (mixed ^ (mixed >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        mixed ^= mixed >> np.uint64(33)
    return np.searchsorted(POISSON, mixed.astype(np.float64) / 2.0**64).astype(float)


def grow(
    rows: DataFrame,
    features: Sequence[str],
    cuts: Sequence[Sequence[float]],
    trees: int,
    sums: int,
    targets: Callable[[pd.DataFrame, int], np.ndarray],
    value: Callable[[np.ndarray], float],
    scored: int,
    max_depth: int,
    min_samples: int,
    bootstrap: bool = False,
    seed: int = SEED,
    first_tree: int = 0,
) -> Nodes:
    """Grow trees side by side on binned rows (x, key, …), level by level.

    `targets(frame, tree)` gives per row `sums` numbers after the leading 1 for the count; the first
    `scored` of them decide splits: gain = (sum of squares of the sums over n, left plus right less
    both) / n, which is the fall of Gini impurity for class marks and of squared error for values.
    `value` turns a node's sums (count first) into its prediction. A node is a leaf at `max_depth`,
    below `min_samples` rows, if all rows share a class, or if no cut gains. Of equal gains the first
    feature and the lowest cut win. The driver holds the nodes and a row per node of a level.
    """
    features = list(features)
    edges = [np.array(c, dtype=float) for c in cuts]
    bins = max([len(c) for c in edges], default=0) + 1
    width = len(feature_subset(len(features), 0, 1))
    nodes = Nodes(features)
    nodes.roots = [nodes.add(first_tree + t, 1) for t in range(trees)]
    active = list(nodes.roots) if max_depth > 0 else []
    names = [f"s{i}" for i in range(sums + 1)]
    if not active:
        return nodes
    while active:
        at_once = max(1, CELLS // (width * bins * (sums + 1)))
        growing, active = active, []
        for start in range(0, len(growing), at_once):
            part = growing[start : start + at_once]
            for slot, row in enumerate(_best_cuts(rows, nodes, part, edges, bins, width, sums, targets, scored, bootstrap, seed, names)):
                at = part[slot]
                whole = np.array(row["whole"] if row else [0.0] * (sums + 1))
                nodes.n[at], nodes.value[at] = float(whole[0]), value(whole)
                pure = scored > 1 and whole[1 : 1 + scored].max() == whole[0]
                if not row or row["best"] is None or whole[0] < min_samples or pure:
                    continue
                best = row["best"]
                if best["gain"] <= 1e-12:
                    continue
                part_left = np.array(best["sums"])
                nodes.feature[at], nodes.threshold[at] = best["feature"], float(edges[best["feature"]][best["bin"]])
                nodes.cut[at] = best["bin"]
                nodes.gain[at] = best["gain"]
                depth = nodes.number[at].bit_length()
                for side, own in enumerate((part_left, whole - part_left)):
                    child = nodes.add(nodes.tree[at], 2 * nodes.number[at] + side, float(own[0]), value(own))
                    if not side:
                        nodes.left[at] = child
                    one_class = scored > 1 and own[1 : 1 + scored].max() == own[0]
                    if depth < max_depth and own[0] >= min_samples and not one_class:
                        active.append(child)
    return nodes


def _best_cuts(rows, nodes, part, edges, bins, width, sums, targets, scored, bootstrap, seed, names) -> list:
    """For each node of `part` its sums and its best cut (None without one), or None if no row reached it."""
    slot_of = np.full(len(nodes.tree), -1)
    slot_of[part] = np.arange(len(part))
    subset = np.array([feature_subset(len(edges), nodes.tree[i], nodes.number[i], seed) for i in part])
    walk, code = nodes.walker(binned=True), _code_type(edges)
    roots = sorted({nodes.roots[nodes.tree[i] - nodes.tree[nodes.roots[0]]] for i in part})
    tree_of = {r: nodes.tree[r] for r in roots}

    def histogram(frames):
        held = np.zeros((sums + 1, len(part) * width * bins))
        for frame in frames:
            if frame.empty:
                continue
            x = _matrix(frame, code)
            for root in roots:
                slot = slot_of[walk(x, root)]
                weight = draws(frame["key"].to_numpy(), tree_of[root]) if bootstrap else np.ones(len(x))
                here = np.flatnonzero((slot >= 0) & (weight > 0))
                if not len(here):
                    continue
                own, w = slot[here], weight[here]
                values = targets(frame, tree_of[root])[here]
                for j in range(width):
                    cell = (own * width + j) * bins + x[here, subset[own, j]]
                    held[0] += np.bincount(cell, weights=w, minlength=held.shape[1])
                    for s in range(sums):
                        held[s + 1] += np.bincount(cell, weights=w * values[:, s], minlength=held.shape[1])
        filled = np.flatnonzero(held[0])
        yield pd.DataFrame(
            {"slot": filled // (width * bins), "j": filled // bins % width, "bin": filled % bins, **dict(zip(names, held[:, filled], strict=True))}
        )

    schema = "slot int, j int, bin int, " + ", ".join(f"{n} double" for n in names)
    added = rows.mapInPandas(histogram, schema).groupBy("slot", "j", "bin").agg(*[F.sum(n).alias(n) for n in names])
    along = Window.partitionBy("slot", "j").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("slot", "j")
    lists = added.select(
        "slot",
        "j",
        "bin",
        F.array(*[F.sum(n).over(along) for n in names]).alias("low"),
        F.array(*[F.sum(n).over(whole) for n in names]).alias("all"),
    )

    def spread(total: Column) -> Column:
        marks = F.slice(total, 2, scored)
        return F.aggregate(marks, F.lit(0.0), lambda a, v: a + v * v) / total[0]

    high = F.zip_with("all", "low", lambda a, b: a - b)
    gains = lists.withColumn("high", high).withColumn(
        "gain", F.when(F.col("high")[0] > 1e-9, (spread(F.col("low")) + spread(F.col("high")) - spread(F.col("all"))) / F.col("all")[0])
    )
    order = F.struct("gain", (-F.col("j")).alias("j"), (-F.col("bin")).alias("bin"), F.col("low").alias("sums"))
    found = gains.groupBy("slot").agg(
        F.max(F.when(F.col("gain").isNotNull(), order)).alias("best"), F.max(F.when(F.col("j") == 0, F.col("all"))).alias("whole")
    )
    out: list = [None] * len(part)
    for r in found.collect():
        best = None
        if r.best is not None:
            best = {"gain": r.best.gain, "feature": int(subset[r.slot, -r.best.j]), "bin": -r.best.bin, "sums": r.best.sums}
        out[r.slot] = {"whole": r.whole, "best": best}
    return out


def _rows(df: DataFrame, features: Sequence[str], label: str, key: str | None) -> DataFrame:
    """(f0, f1, …, y, key) of all rows, those without a label too: cuts are taken from them as well."""
    x = [F.col(quoted(f)).cast("double").alias(f"f{i}") for i, f in enumerate(features)]
    hashed = F.xxhash64(F.col(quoted(key))) if key else F.lit(0).cast("long")
    return df.select(*x, F.col(quoted(label)).cast("double").alias("y"), hashed.alias("key"))


@dataclass
class TreeModel:
    """Trees as data: their nodes and how the trees' values make a prediction.

    `rule`: "mean" of the trees, "votes" for one of `classes`, or "boosted": `start` plus `rate` times
    the trees' sums, one number per class. `losses` are those of boosting, before the first round and
    after every one.
    """

    nodes: Nodes
    rule: str
    classes: list[float] = field(default_factory=list)
    start: list[float] = field(default_factory=lambda: [0.0])
    rate: float = 1.0
    losses: list[float] = field(default_factory=list)

    def _totals(self) -> Callable[[np.ndarray], np.ndarray]:
        """Rows of features to their numbers: one per class where classes are voted or boosted, else one."""
        walk, roots, values = self.nodes.walker(), list(self.nodes.roots), np.array(self.nodes.value)
        rule, classes, start, rate = self.rule, np.array(self.classes), np.array(self.start), self.rate

        def totals(x: np.ndarray) -> np.ndarray:
            if not roots:
                return np.tile(start, (len(x), 1))
            own = np.stack([values[walk(x, r)] for r in roots], axis=1)
            if rule == "votes":
                return np.stack([(own == c).sum(axis=1) for c in classes], axis=1).astype(float)
            if rule == "mean":
                return own.mean(axis=1, keepdims=True)
            return own.reshape(len(x), -1, len(start)).sum(axis=1) * rate + start

        return totals

    def _columns(self) -> Column:
        return F.array(*[F.col(quoted(f)).cast("double") for f in self.nodes.features])

    def predict(self, df: DataFrame) -> DataFrame:
        """`df` with `prediction`: a value, or the class with the highest number, of equal ones the smallest."""
        totals, classes = self._totals(), np.array(self.classes)

        @F.pandas_udf("double")
        def predicted(x: pd.Series) -> pd.Series:
            found = totals(np.array(x.tolist(), dtype=float).reshape(len(x), -1))
            return pd.Series(classes[found.argmax(axis=1)] if len(classes) else found[:, 0])

        return df.withColumn("prediction", predicted(self._columns()))

    def scores(self, df: DataFrame) -> DataFrame:
        """`df` with `scores`: votes or boosted scores per class, or the value alone."""
        totals = self._totals()

        @F.pandas_udf("array<double>")
        def scored(x: pd.Series) -> pd.Series:
            return pd.Series(list(totals(np.array(x.tolist(), dtype=float).reshape(len(x), -1))))

        return df.withColumn("scores", scored(self._columns()))

    def importance(self) -> list[tuple[str, float]]:
        return self.nodes.importance()


def class_values(df: DataFrame, label: str) -> list[float]:
    found = df.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("y")).distinct().limit(MAX_CLASSES + 1)
    classes = sorted(r.y for r in found.collect())
    if len(classes) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} classes")
    return classes


def fit_forest(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    classification: bool,
    trees: int = 1,
    max_depth: int = 8,
    min_samples: int = 2,
    key: str | None = None,
    cuts: int = CUTS,
    seed: int = SEED,
) -> TreeModel:
    """One tree on all rows, or several on rows drawn with replacement: mean value or most votes.

    Draws are a hash of `key`, which several trees need. Of classes with equal votes the smallest
    wins. Rows without a label are left out; without rows the prediction is 0.
    """
    if trees > 1 and key is None:
        raise ValueError("a forest draws rows by their key")
    rows = written(_rows(df, features, label, key))
    edges = cut_points(rows, [f"f{i}" for i in range(len(features))], cuts)
    rows = _binned(rows.where("y IS NOT NULL"), len(features), edges)
    if classification:
        classes = np.array(class_values(df, label) or [0.0])

        def targets(frame, tree):
            return (frame["y"].to_numpy()[:, None] == classes[None, :]).astype(float)

        def value(total):
            return float(classes[int(np.argmax(total[1:]))])

    else:

        def targets(frame, tree):
            return frame["y"].to_numpy()[:, None]

        def value(total):
            return float(total[1] / total[0]) if total[0] else 0.0

    sums = len(classes) if classification else 1
    nodes = grow(rows, features, edges, trees, sums, targets, value, sums, max_depth, min_samples, trees > 1, seed)
    return TreeModel(nodes, "votes" if classification else "mean", classes.tolist() if classification else [])


def _softmax(scores: np.ndarray) -> np.ndarray:
    powers = np.exp(scores - scores.max(axis=1, keepdims=True))
    return powers / powers.sum(axis=1, keepdims=True)


def fit_boosting(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    classification: bool,
    rounds: int = 30,
    learning_rate: float = 0.1,
    max_depth: int = 4,
    min_samples: int = 2,
    cuts: int = CUTS,
    seed: int = SEED,
) -> TreeModel:
    """Boosting on residuals: a tree a round for a value, a tree a class and round for classes.

    Classes start from the logarithm of their shares; a tree is grown on mark less probability and
    its leaves take one Newton step, (K - 1) / K * residuals / sum of p (1 - p). Values start from the
    mean and leaves hold mean residuals. The scores so far are kept with the rows, so a round walks
    only its own trees. `losses`: mean log loss or squared error before the first and after every round.
    """
    classes = np.array(class_values(df, label) or [0.0]) if classification else None
    kinds = len(classes) if classification else 1
    table = written(_rows(df, features, label, None))
    rows = table.where("y IS NOT NULL")
    if classification:
        counts = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
        whole = sum(counts.values())
        start = [math.log(counts[c] / whole) for c in classes] if whole else [0.0]
    else:
        start = [rows.agg(F.avg("y")).first()[0] or 0.0]
    edges = cut_points(table, [f"f{i}" for i in range(len(features))], cuts)
    code = _code_type(edges)
    rows = _binned(rows.withColumn("scores", F.array(*[F.lit(float(s)) for s in start])), len(features), edges)
    everything = Nodes(list(features))
    losses: list[float] = []

    def marks(frame):
        return (frame["y"].to_numpy()[:, None] == classes[None, :]).astype(float)

    def scores_of(frame):
        return np.array(frame["scores"].tolist(), dtype=float).reshape(len(frame), kinds)

    def targets(frame, tree):
        scores = scores_of(frame)
        if not classification:
            return frame["y"].to_numpy()[:, None] - scores
        p = _softmax(scores)[:, tree % kinds]
        return np.stack([marks(frame)[:, tree % kinds] - p, p * (1 - p)], axis=1)

    def value(total):
        if not classification:
            return float(total[1] / total[0]) if total[0] else 0.0
        return float((kinds - 1) / kinds * total[1] / total[2]) if total[2] > 1e-150 else 0.0

    def loss(frames):
        total, n = 0.0, 0
        for frame in frames:
            if len(frame):
                scores = scores_of(frame)
                own = np.log(np.maximum((_softmax(scores) * marks(frame)).sum(axis=1), 1e-300)) if classification else None
                total += -own.sum() if classification else ((frame["y"].to_numpy() - scores[:, 0]) ** 2).sum()
                n += len(frame)
        yield pd.DataFrame({"total": [total], "n": [n]})

    def measured(table):
        total, n = table.mapInPandas(loss, "total double, n long").agg(F.sum("total"), F.sum("n")).first()
        return (total / n) if n else 0.0

    losses.append(measured(rows))
    for number in range(rounds if losses[0] or not classification else 0):
        made = grow(
            rows, features, edges, kinds, 2 if classification else 1, targets, value, 1, max_depth, min_samples,
            seed=seed, first_tree=number * kinds,
        )
        walk, values, roots = made.walker(binned=True), np.array(made.value), list(made.roots)

        def stepped(frames, walk=walk, values=values, roots=roots):
            for frame in frames:
                if len(frame):
                    x = _matrix(frame, code)
                    step = np.stack([values[walk(x, r)] for r in roots], axis=1)
                    yield frame.assign(scores=list(scores_of(frame) + learning_rate * step))

        rows = written(rows.mapInPandas(stepped, rows.schema))
        losses.append(measured(rows))
        shift = len(everything.tree)
        everything.roots += [r + shift for r in made.roots]
        everything.left += [c + shift if c >= 0 else -1 for c in made.left]
        for name in ("tree", "number", "feature", "threshold", "cut", "n", "value", "gain"):
            getattr(everything, name).extend(getattr(made, name))

    return TreeModel(everything, "boosted", classes.tolist() if classification else [], [float(v) for v in start], learning_rate, losses)
