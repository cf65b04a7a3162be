"""CSV in and out, previews, result exports."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.columns import quoted
from tabwright.operators.profile import column_typing, text_number

PREVIEW_ROWS = 5


def read_text(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """Every column as trimmed text, blanks as NULL; rows of the wrong width are dropped.

    The schema comes from the header line alone. Column pruning is off for this read: with it a
    narrow projection would keep rows that a full read drops.
    """
    names = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return _texts(spark).schema(schema).option("quote", quote).option("escape", quote).csv(path)


def _texts(spark: SparkSession):
    return spark.read.options(
        header=True,
        mode="DROPMALFORMED",
        nullValue="",
        ignoreLeadingWhiteSpace=True,
        ignoreTrailingWhiteSpace=True,
        columnPruning=False,
        enforceSchema=True,
    )


def from_text(spark: SparkSession, text: str) -> DataFrame:
    """Pasted CSV text as a table of texts."""
    lines = text.strip().split("\n")
    names = [n.strip() for n in lines[0].split(",")]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return _texts(spark).schema(schema).csv(spark.sparkContext.parallelize(lines))


def typed(df: DataFrame, rule: str = "majority_type") -> DataFrame:
    """Text columns that hold numbers become doubles; by the majority rule stray words become NULL."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    kinds = {r.name: r[rule] for r in column_typing(df, texts).collect()}
    return df.select(
        *[
            text_number(F.col(quoted(c))).alias(c) if kinds.get(c) == "numeric" else F.col(quoted(c))
            for c in df.columns
        ]
    )


def read_inferred(spark: SparkSession, path: str) -> DataFrame:
    """CSV with Spark's own type inference."""
    return spark.read.csv(path, header=True, inferSchema=True)


def load(spark: SparkSession, path: str | None = None, text: str | None = None) -> DataFrame:
    """A typed table from a path of any file system Spark reads, or from pasted text."""
    if text is not None:
        return typed(from_text(spark, text))
    if path is None:
        raise ValueError("either a path or text is needed")
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    return typed(read_text(spark, path))


def preview(df: DataFrame, rows: int = PREVIEW_ROWS) -> tuple[list[str], DataFrame]:
    """Column names and the first rows."""
    return df.columns, df.limit(rows)


def write(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV files with a header; values with commas are quoted."""
    df.write.mode(mode).csv(path, header=True, escape='"')


def write_scored(scored: DataFrame, target: str, path: str, prediction: str = "prediction") -> None:
    """Scored rows with the prediction under `predicted_<target>`, without model-internal columns."""
    inner = [f.name for f in scored.schema if f.dataType.typeName() == "vectorudt"]
    write(scored.drop(*inner).withColumnRenamed(prediction, f"predicted_{target}"), path)


def export_sections(sections: Mapping[str, tuple[DataFrame, Sequence[str], Sequence[str]]]) -> DataFrame:
    """Result tables as one long table (section, key, name, value).

    Each section brings its table, the columns that name a row and the columns to report.
    """

    def long(name: str, df: DataFrame, keys: Sequence[str], values: Iterable[str]) -> DataFrame:
        cells = [
            F.struct(F.lit(v).alias("name"), _shown(df, v).alias("value"))
            for v in values
        ]
        return df.select(
            F.lit(name).alias("section"), F.concat_ws("|", *[F.col(quoted(k)).cast("string") for k in keys]).alias("key"), F.inline(F.array(*cells))
        )

    out = None
    for name, (df, keys, values) in sections.items():
        part = long(name, df, keys, values)
        out = part if out is None else out.unionByName(part)
    return out


def _shown(df: DataFrame, name: str):
    """Numbers with six decimals, everything else as text."""
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.format_string("%.6f", F.col(quoted(name)))
    return F.col(quoted(name)).cast("string")
