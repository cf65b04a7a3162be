"""Row numbers and running counts without putting a whole key, or the whole table, in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICES = 128


def _sortable(df: DataFrame, name: str, ascending: bool) -> Column:
    kind = df.schema[name].dataType
    value = F.col(name)
    if isinstance(kind, T.TimestampType):
        value = F.unix_micros(value)
    elif isinstance(kind, T.TimestampNTZType):
        seconds = F.unix_date(value.cast("date")).cast("long") * 86_400 + F.hour(value) * 3_600 + F.minute(value) * 60
        value = seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), value) * 1_000_000).cast("long")
    elif isinstance(kind, T.DateType):
        value = F.unix_date(value)
    elif isinstance(kind, T.StringType):
        # The first six bytes as a number follow the order of the strings; the rest orders inside a slice.
        value = F.conv(F.rpad(F.substring(F.hex(value), 1, 12), 12, "0"), 16, 10)
    value = value.cast("double")
    return value if ascending else -value


def _splits(df: DataFrame, slot: str, slices: int) -> list[float]:
    cuts = df.agg(F.percentile_approx(slot, [i / slices for i in range(1, slices)], 10 * slices)).first()[0]
    return cuts or []


def numbered(
    df: DataFrame,
    order: Sequence[tuple[str, bool]],
    partition_by: Sequence[str] = (),
    name: str = "row_number",
    slices: int = SLICES,
) -> DataFrame:
    """`row_number()` over numeric, time or text columns, cut into slices so that no group is large.

    `order` lists (column, ascending); the last one should make the order unique. Rows fall into
    slices that follow the first order column. A value so frequent that it fills a slice by itself
    is cut again along the second. Numbers are counted inside (key, slice) and moved up by the
    rows of the slices before, which are a few per key.
    """
    first, ascending = order[0]
    frame = df.withColumn("_v", F.coalesce(_sortable(df, first, ascending), F.lit(float("inf"))))
    cuts = _splits(frame, "_v", slices)
    middle = sorted(set(cuts) - {float("inf")}) or [0.0]
    edges = [-float("inf"), *middle, float("inf")]
    frame = Bucketizer(splits=edges, inputCol="_v", outputCol="_b", handleInvalid="keep").transform(frame)
    hot = sorted({cut for cut in cuts if cuts.count(cut) > 1 and cut != float("inf")})
    frame = frame.withColumn("_h", F.lit(0)).withColumn("_t", F.lit(0.0))
    if hot and len(order) > 1:
        second, direction = order[1]
        tied = F.col("_v").isin(hot)
        frame = frame.withColumn("_w", F.when(tied, _sortable(df, second, direction)))
        inner = sorted(set(_splits(frame, "_w", slices)))
        frame = frame.withColumn("_h", F.when(tied, 0).otherwise(1))
        if len(inner) > 1:
            frame = Bucketizer(
                splits=[-float("inf"), *inner, float("inf")], inputCol="_w", outputCol="_t", handleInvalid="keep"
            ).transform(frame.drop("_t"))
            frame = frame.withColumn("_t", F.when(tied, F.col("_t")).otherwise(0.0))
        frame = frame.drop("_w")
    keys = [*partition_by, "_b", "_h", "_t"]
    inside = Window.partitionBy(*keys).orderBy(
        *[F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in order]
    )
    before = Window.partitionBy(*partition_by).orderBy("_b", "_h", "_t").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        frame.groupBy(*keys)
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    joined = frame.alias("f").join(
        offsets.alias("o"), on=[F.col(f"f.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
    )
    picked = joined.select("f.*", "o._before")
    numbers = F.row_number().over(inside).cast("long") + F.col("_before")
    return picked.withColumn(name, numbers).drop("_v", "_b", "_h", "_t", "_before")
