"""Running sums without a sort of all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Intervals of equal width that values are dealt to; only their sums meet in one place.
INTERVALS = 1000


def with_interval(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Rows with ``part``: which of INTERVALS intervals between the least and the greatest value (of each group ``by``) a row is in."""
    by = by or []
    ends = df.groupBy(*by).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    joined = df.join(ends, by) if by else df.crossJoin(F.broadcast(ends))
    at = F.floor((F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * (INTERVALS - 1))
    return joined.withColumn("part", F.when(F.col("__hi") > F.col("__lo"), at).otherwise(F.lit(0)).cast("long")).drop("__lo", "__hi")


def with_sums_below(df: DataFrame, value: str, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """Rows of distinct values (in each group ``by``) with, for each of ``cols``, its sum over all lesser values as ``<col>_below``."""
    by = by or []
    cut = with_interval(df, value, by)
    sums = cut.groupBy(*by, "part").agg(*[F.sum(c).alias(c) for c in cols])
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    over_parts = Window.partitionBy(*by).orderBy("part")
    offsets = sums.select(*by, "part", *[before(c, over_parts).alias(f"__{c}") for c in cols])
    inside = Window.partitionBy(*by, "part").orderBy(value)
    out = cut.join(offsets, [*by, "part"])
    return out.select(*df.columns, *[(F.col(f"__{c}") + before(c, inside)).alias(f"{c}_below") for c in cols])
