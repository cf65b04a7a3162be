"""Typing and cleaning helpers on single columns."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATS = (T.DoubleType, T.FloatType)
NUMBERS = (*FLOATS, T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns with a number type, in schema order."""
    return [f.name for f in df.schema if isinstance(f.dataType, NUMBERS)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BooleanType))]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN read as missing."""
    value = F.col(quoted(name))
    if isinstance(df.schema[name].dataType, FLOATS):
        return F.when(~F.isnan(value), value)
    return value


def number(df: DataFrame, name: str) -> Column:
    """The column as a double, NULL where missing."""
    return present(df, name).cast("double")


def as_rows(items: Sequence[Column]) -> Column:
    """Turn a list of equally typed structs into rows (one `inline` over the single input row)."""
    return F.inline(F.array(*items))


def chunks(items: Iterable, size: int) -> Iterator[list]:
    rest = iter(items)
    while block := list(islice(rest, size)):
        yield block


def clamp(value: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-clamp(z, -500.0, 500.0)))


def ratio(top: Column, bottom: Column, empty: float = 0.0) -> Column:
    """Division that gives `empty` where the divisor is zero or missing."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(float(empty)))


def long_key(df: DataFrame, key: str) -> Column:
    """A key of any type as a long: whole numbers as they are, others by hash, checked to keep keys apart."""
    value = F.col(quoted(key))
    if df.select(value).schema[0].dataType.typeName() in ("byte", "short", "integer", "long"):
        return value.cast("long")
    hashed = F.xxhash64(value)
    keys, hashes = df.agg(F.count_distinct(value), F.count_distinct(F.when(value.isNotNull(), hashed))).first()
    if keys != hashes:
        raise ValueError(f"two values of {key} have the same hash: give the rows a numeric key")
    return hashed
