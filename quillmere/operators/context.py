"""Context for answers: budgeted bodies with headers, citations and backgrounds. Generation itself is a connector's work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmere.params import ContextParams

REFUSAL = "The given material does not answer this question."


def _has(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


# The labels in this module are texts that a context has word for word.
def page_text(df: DataFrame) -> Column:
    a, b, page = (_has(df, c, "int") for c in ("page_start", "page_end", "page"))
    both = a.isNotNull() & b.isNotNull()
    return (
        F.when(both & (a == b), F.concat(F.lit("第 "), a.cast("string"), F.lit(" 页")))
        .when(both, F.concat(F.lit("第 "), a.cast("string"), F.lit("-"), b.cast("string"), F.lit(" 页")))
        .when(page.isNotNull(), F.concat(F.lit("第 "), page.cast("string"), F.lit(" 页")))
        .otherwise(F.lit("页码未知"))
    )


def section_text(df: DataFrame) -> Column:
    path = _has(df, "section_path", "array<string>")
    return F.coalesce(F.nullif(_has(df, "section"), F.lit("")), F.when(F.size(path) > 0, F.array_join(path, " > ")))


def background(df: DataFrame) -> Column:
    """Title, path, headings and URL as far as they are there."""
    title = F.coalesce(F.nullif(_has(df, "title"), F.lit("")), F.nullif(_has(df, "file_name"), F.lit("")))
    path, heads = _has(df, "section_path", "array<string>"), _has(df, "headings", "array<string>")
    return F.concat_ws(
        "；",
        F.concat(F.lit("文档《"), title, F.lit("》")),
        F.when(F.size(path) > 0, F.concat(F.lit("章节路径: "), F.array_join(path, " > "))),
        F.when(F.size(heads) > 0, F.concat(F.lit("本段涵盖小节: "), F.array_join(heads, "、"))),
        F.concat(F.lit("出处: "), F.nullif(_has(df, "url"), F.lit(""))),
    )


def citations(hits: DataFrame, p: ContextParams = ContextParams()) -> DataFrame:
    """Hits (query, rank, text, ...) that get into the context: ``body`` cut to the budget, ``citation`` number, ``locator`` and ``block``.

    The budget counts bodies only. Numbers are places among the hits, so a hit without a body leaves a gap.
    """
    text = F.trim(F.coalesce("text", F.lit("")))
    window = F.trim(F.coalesce(_has(hits, "window_text"), F.lit("")))
    body = text if p.source == "text" else F.when(window != "", window).otherwise(text)
    rows = hits.where(F.col("rank") <= p.context_k).withColumn("whole", body).where("whole <> ''")
    used = F.coalesce(F.sum(F.length("whole")).over(Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("remaining", p.max_context_chars - used).where("remaining > 0")
    rows = rows.withColumn("body", F.substring(F.col("whole"), F.lit(1), F.col("remaining").cast("int")))
    source = F.coalesce(F.nullif(_has(hits, "title"), F.lit("")), F.nullif(_has(hits, "file_name"), F.lit("")), F.lit("unknown"))
    locator = F.concat_ws(" | ", F.concat(F.lit("文档: "), source), F.concat(F.lit("章节: "), F.coalesce(section_text(hits), F.lit("未标注"))), page_text(hits))
    head = F.concat(F.lit("[C"), F.col("rank").cast("string"), F.lit("] "), locator)
    back = background(hits)
    full = F.when(back != "", F.concat(head, F.lit("\n背景: "), back, F.lit("\n\n"), F.col("body"))).otherwise(F.concat(head, F.lit("\n"), F.col("body"))) if p.background else F.concat(head, F.lit("\n"), F.col("body"))
    return rows.withColumn("citation", F.col("rank")).withColumn("locator", locator).withColumn("block", full).drop("whole", "remaining")


def build_context(hits: DataFrame, p: ContextParams = ContextParams()) -> DataFrame:
    """(query, context, context_chars, n_citations): blocks joined by blank lines; context_chars counts bodies."""
    c = citations(hits, p)
    return c.groupBy("query").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("citation", "block"))), lambda x: x["block"]), "\n\n").alias("context"),
        F.sum(F.length("body")).alias("context_chars"), F.count("*").alias("n_citations"),
    )


def prompts(queries: DataFrame, contexts: DataFrame) -> DataFrame:
    """(query, prompt, refusal): a prompt per question; an empty context has the fixed refusal instead."""
    rows = queries.join(contexts, "query", "left")
    empty = F.coalesce("context", F.lit("")) == ""
    ask = F.concat(F.lit("Answer from the material only and cite it as [C1].\n\n"), F.col("context"), F.lit("\n\nQuestion: "), F.col("query_text"))
    return rows.select("query", F.when(~empty, ask).alias("prompt"), F.when(empty, F.lit(REFUSAL)).alias("refusal"))


def expand_parents(hits: DataFrame, chunks: DataFrame, parents: DataFrame) -> DataFrame:
    """Hits (doc is a chunk id) with their parent's text; a parent is kept at its best rank only."""
    of = parents.select("parent_id", F.explode("child_chunk_ids").alias("doc"), F.col("full_text").alias("parent_text"))
    w = Window.partitionBy("query", "parent_id").orderBy("rank")
    return hits.join(of, "doc").withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
