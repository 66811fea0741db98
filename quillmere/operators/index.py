"""Index build: payloads, admission, dense and sparse tables, rebuild and incremental writes, export files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.functions.text import point_id
from quillmere.operators import sparse as sp
from quillmere.operators.blocks import admitted
from quillmere.params import Bm25Params


#: Terms that a search of plain tables hands to their scan.
PUSHED = 1000


def source_name(metadata_name: Column, title: Column, uri: Column) -> Column:
    """Given name, else title, else the last part of the URI's path, else the URI."""
    path = F.try_parse_url(uri, F.lit("PATH"))
    tail = F.element_at(F.filter(F.split(F.coalesce(path, uri), "/"), lambda x: x != ""), -1)
    return F.coalesce(F.nullif(F.trim(metadata_name), F.lit("")), F.nullif(F.trim(title), F.lit("")), tail, uri)


def slim(fragments: Column) -> Column:
    """Fragments without their text, for storage."""
    return F.transform(fragments, lambda f: f.dropFields("text"))


def payloads(chunks: DataFrame, artifacts: DataFrame, exact_ids: bool = True) -> DataFrame:
    """Stored rows of chunks: point id, texts, place and source. ``artifacts``: artifact, title, source_uri, source_type, mime_type."""
    rows = chunks.join(artifacts, "artifact")
    name = source_name(F.lit(None).cast("string"), F.col("title"), F.col("source_uri"))
    return rows.select(
        point_id(F.col("chunk_id"), exact_ids).alias("point_id"), "chunk_id", "artifact", "title", name.alias("file_name"), "source_uri", "source_type", "mime_type", F.array_join("section_path", " > ").alias("section"), "section_path",
        "headings", F.col("number").alias("chunk_index"), F.col("full_text").alias("text"), "sparse_text", "token_count", "char_count", "page_start", "page_end", slim(F.col("fragments")).alias("fragments"),
        "quality_score", "quality_status", "index_decision",
    )


def index_plan(stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dense, sparse) rows to index. A chunk id of another artifact, or one that is there twice, fails when read."""
    ids = stored.groupBy("chunk_id").agg(F.count("*").alias("copies"))
    alien = ~F.startswith(F.col("chunk_id"), F.concat(F.col("artifact").cast("string"), F.lit("_")))
    checked = stored.join(ids, "chunk_id").withColumn("chunk_id", F.when(alien | (F.col("copies") > 1), F.raise_error(F.concat(F.lit("bad chunk id "), F.col("chunk_id")))).otherwise(F.col("chunk_id"))).drop("copies")
    return admitted(checked, "dense", "text"), admitted(checked, "sparse", "sparse_text")


def write_index(dense: DataFrame, sparse: DataFrame, path: str, embed=None, dim: int | None = None, p: Bm25Params = Bm25Params(), apply_weight: bool = True) -> None:
    """Writes dense rows, sparse documents, postings, vocabulary and statistics below ``path``, in place of what was there.

    ``embed``: a function from (rows, text column) to rows with ``vector``; vectors of another length than ``dim`` fail.
    Postings carry the documents' index weight unless ``apply_weight`` is off.
    """
    if embed is not None:
        dense = embed(dense, "text")
        if dim is not None:
            dense = dense.withColumn("vector", F.when(F.size("vector") != dim, F.raise_error(F.lit("wrong vector length"))).otherwise(F.col("vector")))
    dense.write.mode("overwrite").parquet(f"{path}/dense")
    sparse.write.mode("overwrite").parquet(f"{path}/sparse")
    docs = sparse.sparkSession.read.parquet(f"{path}/sparse")
    termed = sp.with_counts(docs, "point_id", "sparse_text")
    stats = sp.corpus_stats(termed)
    tf = sp.term_frequencies(termed)
    post = sp.postings(tf, stats, p)
    if apply_weight:
        w = docs.select(F.col("point_id").alias("doc"), F.col("index_decision.sparse_weight").alias("w"))
        post = post.join(w, "doc").withColumn("weight", F.col("weight") * F.col("w")).drop("w")
    # postings lie by term, so that a filter on terms skips row groups
    post.repartitionByRange("term").sortWithinPartitions("term", "doc").write.mode("overwrite").parquet(f"{path}/postings")
    sp.vocabulary(sp.document_frequencies(tf)).write.mode("overwrite").parquet(f"{path}/vocabulary")
    sp.index_summary(tf, stats).write.mode("overwrite").parquet(f"{path}/stats")


def update_artifacts(rows: DataFrame, path: str) -> None:
    """Replaces the rows of just the artifacts that are in ``rows``, in a table partitioned by artifact."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("artifact").parquet(path)


def search_index(spark, path: str, queries: DataFrame, k: int, query_id: str = "query_id", query_text: str = "query") -> DataFrame:
    """BM25 search of a written index: (query, doc, score, matched, rank). Tables that change or are large are for ``store.IndexStore``."""
    stats = spark.read.parquet(f"{path}/stats").select("n_docs")
    vocab, post = spark.read.parquet(f"{path}/vocabulary"), spark.read.parquet(f"{path}/postings")
    asked = sp.query_terms(queries, query_id, query_text)
    few = [r["term"] for r in asked.select("term").distinct().limit(PUSHED + 1).collect()]
    if len(few) <= PUSHED:  # so many are told to the scan
        post = post.where(F.col("term").isin(few))
    q = asked.join(vocab, "term").crossJoin(F.broadcast(stats)).select("query", "term", (sp.idf(F.col("n_docs"), F.col("df")) * F.col("qtf")).alias("qw"))
    hits = q.join(post, "term").groupBy("query", "doc").agg(F.round(F.sum(F.col("qw") * F.col("weight")), 6).alias("score"), F.array_sort(F.collect_list("term")).alias("matched")).where("score > 0")
    return sp.top_k(hits, k, F.desc("score"), F.asc("doc"))


def export(artifacts: DataFrame, markdown: DataFrame, parents: DataFrame, chunks: DataFrame, path: str) -> None:
    """Export files by artifact: artifact and parent JSON, Markdown text, chunk JSON lines."""
    artifacts.write.mode("overwrite").partitionBy("artifact").json(f"{path}/artifacts")
    markdown.select("artifact", "markdown").write.mode("overwrite").partitionBy("artifact").text(f"{path}/markdown")
    parents.write.mode("overwrite").partitionBy("artifact").json(f"{path}/parents")
    chunks.write.mode("overwrite").partitionBy("artifact").json(f"{path}/chunks")
