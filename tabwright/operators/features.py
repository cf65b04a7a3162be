"""From a table to model inputs: column choice, encodings, assembly, splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions.columns import categorical_columns, number, numeric_columns, present, quoted
from tabwright.operators.clean import Scale
from tabwright.operators.profile import text_columns

# Name parts that give away the answer or identify the row.
LEAKAGE_PATTERNS = ("id", "_id", "date", "year", "added", "created", "updated")
MAX_WIDE_CATEGORIES = 2_000


def select_features(df: DataFrame, target: str, features: Sequence[str] | None = None) -> DataFrame:
    """The named features and the target, or everything."""
    return df.select(*[quoted(c) for c in features], quoted(target)) if features else df


def exclude(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*names)


def is_leak(name: str, patterns: Sequence[str] = LEAKAGE_PATTERNS) -> bool:
    return any(p in name.lower() for p in patterns)


def drop_leakage(df: DataFrame, target: str, patterns: Sequence[str] = LEAKAGE_PATTERNS):
    """(table, names dropped) by the name rule; the target always stays."""
    leaks = [c for c in df.columns if c != target and is_leak(c, patterns)]
    return df.drop(*leaks), leaks


def leakage_report(df: DataFrame, target: str, patterns: Sequence[str] = LEAKAGE_PATTERNS) -> DataFrame:
    """One row per column: its name, whether it would be dropped, and its row count."""
    rows = [
        F.struct(
            F.lit(c).alias("name"),
            F.lit(is_leak(c, patterns)).alias("dropped"),
            F.col(f"c{i}").alias("n_present"),
        )
        for i, c in enumerate(df.columns)
        if c != target
    ]
    counts = [F.count(present(df, c)).alias(f"c{i}") for i, c in enumerate(df.columns)]
    return df.agg(*counts).select(F.inline(F.array(*rows)))


def numeric_only(df: DataFrame) -> DataFrame:
    return df.select(*[quoted(c) for c in numeric_columns(df)])


def expected_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns a model expects, in its order; absent ones and blanks become 0."""
    return df.select(
        *[
            (F.coalesce(number(df, c), F.lit(0.0)) if c in df.columns else F.lit(0.0)).alias(c)
            for c in columns
        ]
    )


def categories(df: DataFrame, name: str, most: int = MAX_WIDE_CATEGORIES) -> list[str]:
    """Sorted distinct values of a column that is to become columns of its own.

    A table cannot be wider than a few thousand columns: beyond that use `one_hot_long`.
    """
    text = F.coalesce(present(df, name).cast("string"), F.lit(""))
    values = [r[0] for r in df.select(text.alias("v")).distinct().limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"{name} has more than {most} categories: encode it with one_hot_long")
    return sorted(values)


def one_hot(df: DataFrame, encoding: Mapping[str, Sequence[str]]) -> DataFrame:
    """A 0/1 column `name_value` per category but the first; unseen categories give zeros."""
    added = {}
    for name, values in encoding.items():
        text = F.coalesce(present(df, name).cast("string"), F.lit(""))
        for value in values[1:]:
            added[f"{name}_{value}"] = F.when(text == value, 1.0).otherwise(0.0)
    return df.withColumns(added).drop(*encoding)


def one_hot_long(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The same encoding as rows (keys, feature, 1.0), for any number of categories.

    Only the first category per column leaves the executors.
    """
    texts = {c: F.coalesce(present(df, c).cast("string"), F.lit("")) for c in columns}
    first = df.agg(*[F.min(texts[c]).alias(c) for c in columns]).first()
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), texts[c].alias("category")) for c in columns])
    firsts = [(F.col("column") == c) & (F.col("category") == F.lit(first[c])) for c in columns]
    dropped = firsts[0]
    for condition in firsts[1:]:
        dropped = dropped | condition
    return (
        df.select(*[quoted(k) for k in keys], F.inline(pairs))
        .where(~dropped)
        .select(*[quoted(k) for k in keys], F.concat_ws("_", "column", "category").alias("feature"), F.lit(1.0).alias("value"))
    )


def label_index(value: Column, labels: Sequence[str]) -> Column:
    """Place of a text label in its sorted list, NULL for an unseen one."""
    mapping = F.create_map(*[F.lit(x) for i, label in enumerate(labels) for x in (label, float(i))])
    return mapping[value.cast("string")]


def label_text(index: Column, labels: Sequence[str]) -> Column:
    """The label behind an index."""
    return F.get(F.array(*[F.lit(x) for x in labels]), index.cast("int"))


def joined_text(columns: Sequence[str]) -> Column:
    """Text columns as one, blanks as ''."""
    return F.concat_ws(" ", *[F.coalesce(F.col(quoted(c)), F.lit("")) for c in columns])


@dataclass
class Encoder:
    """Everything needed to turn raw rows into the model's feature vector."""

    target: str
    numbers: list[str]
    encoding: dict[str, list[str]]
    texts: list[str] = field(default_factory=list)
    leaks: list[str] = field(default_factory=list)
    labels: list[str] | None = None
    scales: dict[str, Scale] = field(default_factory=dict)

    @property
    def feature_names(self) -> list[str]:
        return [*self.numbers, *[f"{c}_{v}" for c, values in self.encoding.items() for v in values[1:]]]

    def encode(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """`keep` columns plus one double column per feature; absent numbers are 0."""
        features = []
        for c in self.numbers:
            value = F.coalesce(number(df, c), F.lit(0.0)) if c in df.columns else F.lit(0.0)
            features.append((c, value))
        for c, values in self.encoding.items():
            text = F.coalesce(present(df, c).cast("string"), F.lit("")) if c in df.columns else F.lit("")
            features += [(f"{c}_{v}", F.when(text == v, 1.0).otherwise(0.0)) for v in values[1:]]
        scaled = [
            ((value - F.lit(self.scales[n].origin)) / F.lit(self.scales[n].divisor) if n in self.scales else value).alias(n)
            for n, value in features
        ]
        return df.select(*[k if isinstance(k, Column) else quoted(k) for k in keep], *scaled)

    def label(self, df: DataFrame) -> Column:
        target = present(df, self.target)
        return label_index(target, self.labels) if self.labels is not None else target.cast("double")

    def training(self, df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
        """Keys, encoded features and `label`."""
        return self.encode(df, [*[F.col(quoted(k)).alias(f"key_{k}") for k in keys], self.label(df).alias("label")])


def fit_encoder(
    df: DataFrame,
    target: str,
    keys: Sequence[str] = (),
    patterns: Sequence[str] = LEAKAGE_PATTERNS,
) -> Encoder:
    """Learn the encoding: leakage columns and long texts go, categories are listed in order."""
    rest, leaks = drop_leakage(df.drop(*[k for k in keys if k != target]), target, patterns)
    words = [c for c in categorical_columns(rest) if c != target]
    texts = [r.name for r in text_columns(rest.select(*words)).collect() if r.is_text] if words else []
    encoding = {c: categories(rest, c) for c in words if c not in texts}
    labels = None if target in numeric_columns(df) else categories(df.where(present(df, target).isNotNull()), target)
    numbers = [c for c in numeric_columns(rest) if c != target]
    return Encoder(target, numbers, encoding, texts, leaks, labels)


def assemble(df: DataFrame, names: Sequence[str], output: str = "features") -> DataFrame:
    """Numbers first, then dummies, as one vector column."""
    return VectorAssembler(inputCols=list(names), outputCol=output, handleInvalid="keep").transform(df)

