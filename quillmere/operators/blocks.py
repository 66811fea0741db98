"""Blocks: cleaning, heading paths, quality gate and index decisions.

A block row has artifact, block_id, ord, type, text and optionally level, page, section_path,
image_uri.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmere.functions import text as tx

TEXT_TYPES = ("text", "list", "heading")


def line_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each line of a text as a block of type text, in order from 1."""
    return docs.select(F.col(id_col).alias("artifact"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("pos", "text")).select(
        "artifact", (F.col("pos") + 1).alias("ord"), F.lit("text").alias("type"), "text"
    )


def with_section_path(blocks: DataFrame) -> DataFrame:
    """Adds section_path and parent_ord from heading levels, as a stack of headings would.

    For each level the last heading of that level or a smaller one is looked up; it is on the path if its level is just that. A heading's own
    path has the levels above its own.
    """
    w = Window.partitionBy("artifact").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("artifact").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    heading = F.col("type") == "heading"
    out = blocks
    for n in range(1, 7):
        out = out.withColumn(f"__h{n}", F.last(F.when(heading & (F.col("level") <= n), F.struct("level", "text")), True).over(w))
    out = out.withColumn("parent_ord", F.last(F.when(heading, F.col("ord")), True).over(before))
    own = F.when(heading, F.col("level")).otherwise(F.lit(7))
    parts = [F.when((F.col(f"__h{n}.level") == n) & (F.lit(n) < own), F.col(f"__h{n}.text")) for n in range(1, 7)]
    return out.withColumn("section_path", F.array_compact(F.array(*parts))).drop(*[f"__h{n}" for n in range(1, 7)])


def title_of(blocks: DataFrame) -> DataFrame:
    """(artifact, title): the first heading of level 1, else the first heading."""
    h = F.col("type") == "heading"
    return blocks.groupBy("artifact").agg(F.coalesce(F.min_by("text", F.when(h & (F.col("level") == 1), F.col("ord"))), F.min_by("text", F.when(h, F.col("ord")))).alias("title"))


def cleaned_text() -> Column:
    return F.when(F.col("type") == "code", tx.clean_code(F.col("text"))).when(F.col("type") == "formula", F.trim("text")).otherwise(tx.clean_text(F.col("text")))


def clean_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks without contents lists, empties, boilerplate and adjacent repeats, renumbered from 1.

    Contents lists are told before cleaning. Only text and headings are dropped as repeats
    of the block kept before them.
    """
    image = F.col("image_uri").isNotNull() if "image_uri" in blocks.columns else F.lit(False)
    kept = blocks.where(~(F.col("type").isin("text", "list") & tx.is_toc(F.col("text")))).withColumn("text", cleaned_text())
    kept = kept.where((F.col("text") != "") | image).where(~(F.col("type").isin(*TEXT_TYPES) & tx.is_boilerplate(F.col("text"))))
    w = Window.partitionBy("artifact").orderBy("ord")
    prev = F.lag(F.struct("type", "text")).over(w)
    kept = kept.withColumn("prev", prev).where(~(F.col("type").isin("text", "heading") & F.col("prev").isNotNull() & (F.col("prev.type") == F.col("type")) & (F.col("prev.text") == F.col("text")))).drop("prev")
    return kept.withColumn("ord", F.row_number().over(w))


def dropped_toc(blocks: DataFrame) -> DataFrame:
    """(artifact, dropped): block numbers of contents lists, for the record."""
    return blocks.where(F.col("type").isin("text", "list") & tx.is_toc(F.col("text"))).groupBy("artifact").agg(F.array_sort(F.collect_list("ord")).alias("dropped"))


def quality(blocks: DataFrame, artifacts: DataFrame) -> DataFrame:
    """One row per artifact (artifact, title, source_type, mime): metrics, flags, score and status.

    Structural checks look only at what can be missing: pages of PDFs, levels of five headings or more,
    paths below three headings or more.
    """
    has = set(blocks.columns)
    page = F.col("page").isNotNull() if "page" in has else F.lit(False)
    level = F.col("level") if "level" in has else F.lit(None).cast("int")
    pathed = (F.size("section_path") > 0) if "section_path" in has else F.lit(False)
    body = F.coalesce("text", F.lit(""))
    stripped = F.regexp_replace(body, r"^\s+|\s+$", "")
    heading = F.col("type") == "heading"
    # distinct texts by a first grouping, so that none is gathered
    rows = blocks.select("artifact", "type", body.alias("text"), stripped.alias("stripped"), page.alias("paged"), level.alias("level"), pathed.alias("pathed"))
    distinct = rows.where("stripped <> ''").groupBy("artifact", F.md5("stripped").alias("h")).agg(F.count("*").alias("n")).groupBy("artifact").agg(F.count("*").alias("kinds"), F.sum("n").alias("filled"))
    m = rows.groupBy("artifact").agg(
        F.count("*").alias("block_count"),
        (F.sum(F.length("text")) + F.greatest(F.count_if(F.col("text") != "") - 1, F.lit(0))).alias("char_count"),
        F.sum(F.regexp_count("text", F.lit(tx.GARBLED_PATTERN))).alias("garbled"),
        *[F.count_if(F.col("type") == t).alias(f"{t}_block_count") for t in ("code", "formula", "image")],
        F.count_if(F.col("type").isin(*TEXT_TYPES)).alias("text_block_count"),
        F.count_if("paged").alias("with_page"), F.count_if(heading).alias("headings"), F.count_distinct(F.when(heading, F.col("level"))).alias("levels"),
        F.count_if(~heading).alias("others"), F.count_if(~heading & F.col("pathed")).alias("with_path"),
    )
    zero = ["block_count", "char_count", "garbled", "code_block_count", "formula_block_count", "image_block_count", "text_block_count", "with_page", "headings", "levels", "others", "with_path", "kinds", "filled"]
    q = artifacts.join(m, "artifact", "left").join(distinct, "artifact", "left").fillna(0, subset=zero)
    dup = F.when(F.col("filled") > 0, 1.0 - F.col("kinds") / F.col("filled")).otherwise(0.0)
    bad = F.col("garbled") / F.greatest(F.col("char_count"), F.lit(1))
    untitled = F.coalesce("title", F.lit("")) == ""
    structural = {
        "pdf_without_page_numbers": F.lower("mime").contains("pdf") & (F.col("block_count") > 0) & (F.col("with_page") == 0),
        "flat_heading_levels": (F.col("headings") >= 5) & (F.col("levels") <= 1),
        "section_path_all_empty": (F.col("headings") >= 3) & (F.col("others") > 0) & (F.col("with_path") == 0),
    }
    flags = {
        "no_blocks": F.col("block_count") == 0, "very_short_text": F.col("char_count") < 100,
        "low_content": F.col("source_type").isin("url", "local_file") & (F.col("char_count") < 300),
        "high_duplicate_ratio": dup > 0.35, "garbled_text": bad > 0.01, "missing_title": untitled, **structural,
    }
    n_structural = sum((c.cast("int") for c in structural.values()), F.lit(0))
    score = 1.0 - F.when(F.col("char_count") < 100, 0.45).otherwise(0.0) - F.when(F.col("char_count") < 300, 0.15).otherwise(0.0) - dup * 0.30 - F.least(bad * 5, F.lit(0.40)) - F.when(untitled, 0.05).otherwise(0.0) - 0.06 * n_structural
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    status = F.when((F.col("block_count") == 0) | (F.col("char_count") == 0), "reject").when(F.col("score_raw") >= 0.85, "high").when(F.col("score_raw") >= 0.60, "medium").when(F.col("score_raw") >= 0.35, "low").otherwise("reject")
    return (
        q.withColumn("duplicate_ratio", F.round(dup, 4)).withColumn("garbled_ratio", F.round(bad, 6))
        .withColumn("flags", F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in flags.items()])))
        .withColumn("score_raw", score).withColumn("score", F.round("score_raw", 4)).withColumn("status", status)
        .drop("score_raw", "garbled", "with_page", "levels", "others", "with_path", "kinds", "filled")
    )


def index_decision(status: Column) -> Column:
    """Struct of the index decision of a quality status."""

    def tier(name, dense, sparse, w, penalty, review):
        return F.struct(F.lit(name).alias("tier"), F.lit(dense).alias("dense_index"), F.lit(sparse).alias("sparse_index"), F.lit(w).alias("sparse_weight"), F.lit(penalty).alias("rerank_penalty"), F.lit(review).alias("review_required"))

    # What each tier is indexed as.
    return (
        F.when(status == "high", tier("high", True, True, 1.0, 0.0, False))
        .when(status == "medium", tier("medium", True, True, 0.6, 0.0, False))
        .when(status == "low", tier("low", True, False, 0.0, 0.2, True))
        .otherwise(tier("reject", False, False, 0.0, 1.0, True))
    )


def admitted(chunks: DataFrame, kind: str, text_col: str) -> DataFrame:
    """Chunks that go into the dense or sparse index: allowed by their decision and not empty."""
    return chunks.where(F.col(f"index_decision.{kind}_index") & (F.trim(F.coalesce(text_col, F.lit(""))) != ""))


def to_markdown(blocks: DataFrame) -> DataFrame:
    """(artifact, markdown): blocks rendered in order, a blank line between."""
    opt = lambda c: F.coalesce(F.col(c), F.lit("")) if c in blocks.columns else F.lit("")
    level = F.greatest(F.lit(1), F.least(F.coalesce("level", F.lit(1)), F.lit(6))) if "level" in blocks.columns else F.lit(1)
    out = (
        F.when(F.col("type") == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.col("text")))
        .when(F.col("type") == "code", F.concat(F.lit("```"), opt("code_language"), F.lit("\n"), F.col("text"), F.lit("\n```")))
        .when(F.col("type") == "formula", F.concat(F.lit("$$"), F.col("text"), F.lit("$$")))
        .when(F.col("type") == "image", F.concat(F.lit("!["), F.col("text"), F.lit("]("), opt("image_uri"), F.lit(")")))
        .otherwise(F.col("text"))
    )
    return blocks.withColumn("md", out).groupBy("artifact").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "md"))), lambda x: x["md"]), "\n\n").alias("markdown"))
