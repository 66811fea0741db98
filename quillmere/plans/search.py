"""The search API over a table of documents or chunks: search, context for answers, info and sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.operators import context as ctx
from quillmere.operators import dense as de
from quillmere.operators import hybrid as hy
from quillmere.operators import sparse as sp
from quillmere.params import ContextParams, SearchParams
from quillmere.sources.readers import in_section, sections


class Engine:
    """``docs`` has doc and text, and optionally section, title, url, pages and other columns of citations.

    The offline dense channel is the hashing embedding, which only sees shared words. A batch of queries
    (query, query_text, and optionally dense_query and sparse_query for other texts per channel) is one plan.
    """

    def __init__(self, docs: DataFrame, scorer: str = "lexical"):
        self.docs, self.scorer = docs, scorer

    def _channel(self, queries: DataFrame, column: str) -> DataFrame:
        text = F.coalesce(column, "query_text") if column in queries.columns else F.col("query_text")
        return queries.select("query", text.alias("q"))

    def search(self, queries: DataFrame, p: SearchParams = SearchParams()) -> DataFrame:
        """Hits (query, doc, scores, ranks, shown, rank). The section filter comes before the ranking."""
        docs = in_section(self.docs, p.section) if p.section else self.docs
        dense = de.text_cosine_topk(docs, self._channel(queries, "dense_query"), p.candidate_k, "doc", "text", "query", "q")
        sparse = sp.bm25_topk(docs, self._channel(queries, "sparse_query"), p.candidate_k, doc_id="doc", query_id="query", query_text="q")
        depth = p.rerank_candidate_k if p.rerank else p.top_k
        hits = hy.search_stage(p.mode, dense, sparse, p.rrf_k, depth)
        if p.mode != "hybrid":
            hits = hits.withColumn(f"{p.mode}_score", F.col("score"))
        name = self.scorer if p.rerank else "none"
        out = hy.rerank(hits, queries.select("query", "query_text"), docs.select("doc", "text"), p.top_k, name)
        return out.withColumn("shown", hy.display_score(p.mode))

    def answer_context(self, queries: DataFrame, p: SearchParams = SearchParams(), c: ContextParams = ContextParams()) -> DataFrame:
        """(query, prompt, refusal, context_chars, n_citations): what a generator would be given."""
        hits = self.search(queries, p).select("query", "doc", "rank").join(self.docs, "doc")
        contexts = ctx.build_context(hits, c)
        return ctx.prompts(queries, contexts).join(contexts.drop("context"), "query", "left")

    def info(self) -> DataFrame:
        termed = sp.with_counts(self.docs, "doc", "text")
        return sp.index_summary(sp.term_frequencies(termed), sp.corpus_stats(termed))

    def sections(self) -> DataFrame:
        return sections(self.docs)
