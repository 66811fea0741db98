"""PDF structure from extracted lines: zones, body size, heading levels, outline matching, paragraphs.

Reading the file is a plug-in's work (no PDF library is assumed); what it must give are lines (artifact, page, line_no, text,
x0, y0, x1, y1, size), an outline (artifact, level, title, page) and page heights (artifact, page, height).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmere.functions.text import char_bigrams, jaccard, padded, title_key
from quillmere.operators.blocks import with_section_path

ZONE, ZONE_MIN = 0.10, 3
SAME_TITLE = 0.85
HEADING_FROM, HEADING_TO, DEPTH = 1.15, 3.0, 10


def zones(lines: DataFrame, heights: DataFrame) -> DataFrame:
    """(artifact, zone, key, size): texts that stand at least three times in the top or bottom tenth, with their most common size."""
    where = F.when(F.col("y0") < F.col("height") * ZONE, "header").when(F.col("y1") > F.col("height") * (1 - ZONE), "footer")
    z = lines.join(heights, ["artifact", "page"]).withColumn("zone", where).where("zone is not null").withColumn("key", title_key(F.regexp_replace("text", r"\d+", "")))
    return z.where("key <> ''").groupBy("artifact", "zone", "key").agg(F.count("*").alias("n"), F.mode("size", True).alias("size")).where(F.col("n") >= ZONE_MIN).drop("n")


def without_zones(lines: DataFrame, heights: DataFrame, outline: DataFrame) -> DataFrame:
    """Lines but running headers, footers and page numbers; a line that the outline names on its page stays."""
    where = F.when(F.col("y0") < F.col("height") * ZONE, "header").when(F.col("y1") > F.col("height") * (1 - ZONE), "footer")
    marked = lines.join(heights, ["artifact", "page"]).withColumn("zone", where).withColumn("key", title_key(F.regexp_replace("text", r"\d+", "")))
    z = zones(lines, heights).select("artifact", "zone", "key", F.lit(True).alias("runs"))
    named = outline.select("artifact", "page", title_key(F.col("title")).alias("full"), F.lit(True).alias("named")).distinct()
    marked = marked.withColumn("full", title_key(F.col("text"))).join(z, ["artifact", "zone", "key"], "left").join(named, ["artifact", "page", "full"], "left")
    number = F.col("zone").isNotNull() & F.col("text").rlike(r"^\s*\d+\s*$")
    return marked.where(F.col("named").isNotNull() | ~(F.coalesce("runs", F.lit(False)) | number)).select(*lines.columns)


def body_size(lines: DataFrame, pages: int = 30) -> DataFrame:
    """(artifact, body): the font size with most characters on the first pages."""
    per = lines.where(F.col("page") < pages).groupBy("artifact", F.round("size", 1).alias("size")).agg(F.sum(F.length("text")).alias("n"))
    return per.groupBy("artifact").agg(F.max_by("size", F.struct("n", -F.col("size"))).alias("body"))


def size_ladder(lines: DataFrame) -> DataFrame:
    """(artifact, size, level): sizes above the body's ranked from the largest, ten levels at most."""
    sizes = lines.join(body_size(lines), "artifact").select("artifact", "body", F.round("size", 1).alias("size")).distinct()
    sizes = sizes.where((F.col("size") >= F.col("body") * HEADING_FROM) & (F.col("size") <= F.col("body") * HEADING_TO))
    return sizes.select("artifact", "size", F.least(F.dense_rank().over(Window.partitionBy("artifact").orderBy(F.desc("size"))), F.lit(DEPTH)).alias("level"))


def outline_index(outline: DataFrame) -> DataFrame:
    return outline.withColumn("key", title_key(F.col("title"))).where("key <> ''").groupBy("artifact", "key", "page").agg(F.min("level").alias("level"))


def outline_matches(lines: DataFrame, outline: DataFrame) -> DataFrame:
    """(artifact, page, line_no, level): lines that the outline names on their page, else its most similar title one page off at most.

    The second is a band join on the page, made an equi-join by dealing each entry to its three pages; only lines without
    an exact match go there.
    """
    keyed = lines.select("artifact", "page", "line_no", title_key(F.col("text")).alias("key")).where("key <> ''")
    index = outline_index(outline)
    exact = keyed.join(index, ["artifact", "key", "page"]).select("artifact", "page", "line_no", "level")
    rest = keyed.join(exact, ["artifact", "page", "line_no"], "left_anti").where(F.length("key") >= 4)
    band = index.where(F.length("key") >= 4).select("artifact", F.explode(F.array(F.col("page") - 1, F.col("page"), F.col("page") + 1)).alias("page"), F.col("key").alias("title"), "level", F.col("page").alias("at"))
    score = jaccard(char_bigrams(F.col("key")), char_bigrams(F.col("title")))
    near = rest.join(band, ["artifact", "page"]).withColumn("score", score).where(F.col("score") >= SAME_TITLE)
    best = near.groupBy("artifact", "page", "line_no").agg(F.max_by("level", F.struct("score", -F.abs(F.col("page") - F.col("at")), -F.col("level"))).alias("level"))
    return exact.unionByName(best)


def level_votes(lines: DataFrame, outline: DataFrame) -> DataFrame:
    """(artifact, size, level, n): how often lines of a size were matched with a level."""
    return lines.join(outline_matches(lines, outline), ["artifact", "page", "line_no"]).groupBy("artifact", F.round("size", 1).alias("size"), "level").agg(F.count("*").alias("n"))


def calibrate(sizes: DataFrame, votes: DataFrame) -> DataFrame:
    """(artifact, size, level) of each heading size: most votes (the shallower of equal ones), else the nearest voted size's level.

    Sizes without any vote in their artifact are not there.
    """
    w = Window.partitionBy("artifact", "size").orderBy(F.desc("n"), F.asc("level"))
    voted = votes.withColumn("r", F.row_number().over(w)).where("r = 1").select("artifact", F.col("size").alias("known"), F.col("level").alias("voted"))
    # a handful of sizes per artifact: joined on the artifact, then the nearest kept
    near = sizes.select("artifact", "size").distinct().join(voted, "artifact")
    return near.groupBy("artifact", "size").agg(F.min_by("voted", F.struct(F.round(F.abs(F.col("size") - F.col("known")), 3), F.col("voted"))).alias("level"))


def heading_levels(lines: DataFrame, outline: DataFrame) -> DataFrame:
    """(artifact, size, level): calibrated by the outline where it has matches, else the size ladder."""
    ladder = size_ladder(lines)
    fixed = calibrate(ladder, level_votes(lines, outline))
    return ladder.withColumnRenamed("level", "rung").join(fixed, ["artifact", "size"], "left").select("artifact", "size", F.coalesce("level", "rung").alias("level"))


def paragraphs(lines: DataFrame) -> DataFrame:
    """Lines of a page sorted by place and merged while size is the same and the gap at most max(1.6 sizes, 6)."""
    w = Window.partitionBy("artifact", "page").orderBy(F.round("y0"), "x0", "line_no")
    gap = F.col("y0") - F.lag("y1").over(w)
    new = F.coalesce((F.round("size", 1) != F.round(F.lag("size").over(w), 1)) | (gap > F.greatest(F.col("size") * 1.6, F.lit(6.0))), F.lit(True))
    rows = lines.withColumn("at", F.row_number().over(w)).withColumn("run", F.sum(new.cast("int")).over(w))
    return rows.groupBy("artifact", "page", "run").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), " ").alias("text"), F.first("size").alias("size"), F.min("line_no").alias("line_no"),
        F.array(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).alias("bbox"),
    )


def pdf_blocks(lines: DataFrame, outline: DataFrame, heights: DataFrame) -> DataFrame:
    """Block rows of PDFs: paragraphs without running parts, headings by outline or size, adjacent repeats of a heading on a page merged to the larger."""
    kept = without_zones(lines, heights, outline)
    levels = heading_levels(kept, outline)
    named = outline_matches(kept, outline).withColumnRenamed("level", "named")
    para = paragraphs(kept).withColumn("rsize", F.round("size", 1))
    rows = para.join(levels.withColumnRenamed("size", "rsize"), ["artifact", "rsize"], "left").join(named, ["artifact", "page", "line_no"], "left").withColumn("level", F.coalesce("named", "level"))
    rows = rows.withColumn("type", F.when(F.col("level").isNotNull() & (F.length("text") <= 200), "heading").when(F.col("text").rlike(r"^\s*([-*•]|\d+[.)])\s+"), "list").otherwise("text"))
    w = Window.partitionBy("artifact").orderBy("page", "run")
    key = title_key(F.col("text"))
    same = lambda f: (F.col("type") == "heading") & f("type").over(w).eqNullSafe(F.lit("heading")) & f(key).over(w).eqNullSafe(key) & f("page").over(w).eqNullSafe(F.col("page"))
    rows = rows.withColumn("weak", (same(F.lag) & (F.col("size") <= F.lag("size").over(w))) | (same(F.lead) & (F.col("size") < F.lead("size").over(w)))).where(~F.col("weak"))
    rows = rows.withColumn("ord", F.row_number().over(w)).withColumn("level", F.when(F.col("type") == "heading", F.least("level", F.lit(6))))
    return with_section_path(rows.select("artifact", "ord", "type", "text", "level", "page", "bbox")).withColumn("block_id", F.concat(F.lit("b"), padded(F.col("ord"))))
