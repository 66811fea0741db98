"""Joins in which one key may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has more than one in so many of the rows; there are fewer hot keys than that.
SHARE = 1024


def hot_keys(counts: DataFrame, key: str, share: int = SHARE) -> DataFrame:
    """Keys of a table of counts (key, n) that have over 1 / ``share`` of all rows: fewer than ``share`` of them, so they can be broadcast."""
    total = counts.agg(F.sum("n").alias("all"))
    return counts.join(F.broadcast(total), F.col("n") * share > F.col("all")).where("n > 1").select(key)


def hot_join(rows: DataFrame, table: DataFrame, key: str, counts: DataFrame, share: int = SHARE) -> DataFrame:
    """Inner join of rows with a table that has each key once; rows of hot keys stay where they are and get theirs by a broadcast of bounded size.

    ``counts`` has the number of rows of each key. Null keys join nothing.
    """
    hot = F.broadcast(hot_keys(counts, key, share))
    few = table.join(hot, key, "left_semi")
    return rows.join(F.broadcast(few), key).unionByName(rows.join(hot, key, "left_anti").join(table, key))
