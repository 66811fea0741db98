"""Checks of size before a side of a join is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most bytes of stored input whose derived rows are broadcast.
BROADCAST_BYTES = 4 << 20


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a plan's bytes; for a scan with filters, of the files it reads."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(source: DataFrame) -> bool:
    """Whether rows derived from ``source`` may be broadcast."""
    return plan_bytes(source) <= BROADCAST_BYTES


def maybe_broadcast(df: DataFrame, source: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if the table it is derived from is small; else joins are left to Catalyst."""
    return F.broadcast(df) if small(source) else df
