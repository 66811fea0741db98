"""Connected components of a table of links, by alternating stars.

Each round, every node hands its larger neighbours its smallest one (large star),
then hands that smallest one to the rest of its smaller neighbours (small star). What is
left when nothing changes is a star about each component's smallest node. Minima
come from a pre-aggregated grouping that is joined back, so a hub's links are
never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm.tables import drop_staged, staged


def _sign(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b), root the smallest node it reaches.

    Self links and repeats do no harm; an empty table gives an empty result. Nodes
    must not be null.
    """
    links = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = _sign(links)
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        # large star: v > u gets the smallest of u and its neighbours
        large = both.join(low, both.a == low.u).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: of u's smaller neighbours, all but the smallest get it, and so does u
        small = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        rest = large.join(small, large.a == small.u).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = small.select(F.col("u").alias("a"), F.col("m").alias("b"))
        after = staged(rest.unionByName(own).distinct())
        now = _sign(after)
        drop_staged(links)
        links = after
        if now == before:
            break
        before = now
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
