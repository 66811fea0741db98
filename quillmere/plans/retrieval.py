"""Search and evaluation queries: benchmark passages against documents, vectors against vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.functions import text as tx
from quillmere.functions.sizes import maybe_broadcast
from quillmere.functions.tables import new_folder, staged
from quillmere.operators import context as ctx
from quillmere.operators import dense as de
from quillmere.operators import evaluate as ev
from quillmere.operators import hybrid as hy
from quillmere.operators import sparse as sp
from quillmere.operators.store import IndexStore
from quillmere.params import ContextParams
from quillmere.sources.readers import read_table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
DEPTH = 20


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf}/{name}.parquet")


def docs(spark, sf):
    return table(spark, sf, "documents")


def bench(spark, sf):
    return table(spark, sf, "benchmark")


# ---- SQL parts ------------------------------------------------------------

_STOP = "['" + "','".join(tx.STOPWORDS) + "']"
_EDGE = "' .,;:!?()[]{}<>\"''`'"


def _terms(x: str) -> str:
    return (
        f"list_filter(list_transform(regexp_extract_all(lower({x}), '[A-Za-z0-9_][A-Za-z0-9_.:/+\\-]*'), lambda t: trim(t, {_EDGE})), "
        f"lambda t: t <> '' and not regexp_full_match(t, '[0-9]') and regexp_full_match(t, '[a-z0-9_][a-z0-9_.:/+\\-]*') and not list_contains({_STOP}, t))"
    )


_TOKENS = f"terms as (select doc_id as doc, {_terms('text')} as terms from documents), tf as (select doc, any_value(len(terms)) as dl, term, count(*) as tf from (select doc, terms, unnest(terms) as term from terms) group by doc, term), stats as (select count(*) as n, coalesce(avg(len(terms)), 0) as avgdl from terms), df as (select term, count(*) as df, sum(tf)::bigint as cf from tf group by term), qt as (select item_id as query, term, count(*) as qtf from (select item_id, unnest({_terms('text')}) as term from benchmark) group by all)"
_WEIGHT = "tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * greatest(tf.dl, 1) / stats.avgdl))"
_BM25 = f"""{_TOKENS}, scored as (select qt.query, tf.doc, round(sum(ln(1 + (stats.n - df.df + 0.5) / (df.df + 0.5)) * qt.qtf * {_WEIGHT}), 6) as score, string_agg(qt.term, ' ' order by qt.term) as matched
  from qt join df using (term) join tf using (term), stats group by qt.query, tf.doc),
sparse as (select * from (select *, row_number() over (partition by query order by score desc, doc) as rank from scored where score > 0) where rank <= {DEPTH})"""


def _embed(table_: str, id_: str) -> str:
    return f"""(with c as (select doc, token, count(*) as n from (select {id_} as doc, unnest(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda w: lower(w))) as token from {table_}) group by doc, token),
  v as (select doc, ('0x' || substr(md5(token), 1, 8))::bigint % 1024 as bucket, sum(1 + ln(n)) as v from c group by 1, 2)
  select doc, bucket, v / sqrt(sum(v * v) over (partition by doc)) as w from v)"""


_DENSE = f"""de as {_embed('documents', 'doc_id')}, qe as {_embed('benchmark', 'item_id')},
dense as (select * from (select *, row_number() over (partition by query order by score desc, doc) as rank from
  (select q.doc as query, d.doc, round(sum(q.w * d.w), 6) as score from de d join qe q using (bucket) group by 1, 2)) where rank <= {DEPTH})"""
_LISTS = f"{_BM25}, {_DENSE}, both_ as (select coalesce(d.query, s.query) as query, coalesce(d.doc, s.doc) as doc, d.rank as dr, d.score as ds, s.rank as sr, s.score as ss from dense d full join sparse s on d.query = s.query and d.doc = s.doc)"


def _rrf(k: int = 60, wd: float = 1.0, ws: float = 1.0, limit: int = DEPTH) -> str:
    return f"(select * from (select *, row_number() over (partition by query order by score desc, coalesce(dr, 1e9), coalesce(sr, 1e9), doc::varchar) as rank from (select query, doc, dr, ds, sr, ss, round(coalesce({wd}::double / ({k} + dr), 0) + coalesce({ws}::double / ({k} + sr), 0), 9) as score from both_)) where rank <= {limit})"


_UNION = "(select *, row_number() over (partition by query order by coalesce(dr, 0) + coalesce(sr, 0), coalesce(dr, 1e9), coalesce(sr, 1e9)) as rank from both_)"
_LEX = f"list_distinct({_terms('b.text')})"


def _rerank(text: str) -> str:
    return f"""(select query, doc, rerank_score, pre_rank, row_number() over (partition by query order by rerank_score desc, pre_rank) as rank from (
  select r.query, r.doc, r.rank as pre_rank, round(case when len({_LEX}) = 0 then 0 else len(list_intersect({_LEX}, list_distinct({_terms(text)})))::double / len({_LEX}) end, 6) as rerank_score
  from rrf r join documents d on d.doc_id = r.doc join benchmark b on b.item_id = r.query))"""


#: Characters of a text that the reranking stage of the evaluation and of the display scores is given, as a remote model's limit.
GIVEN = 4000
_RERANK = _rerank(f"substr(d.text, 1, {GIVEN})")
_GOLD = "gold as (select b.item_id as query, d.doc_id as doc from benchmark b join documents d on contains(d.text, b.text))"
_STAGES = f"""{_LISTS}, rrf as {_rrf()}, un as {_UNION}, rr as {_RERANK}, {_GOLD},
hits as (select 'dense' as stage, query, doc, rank from dense union all select 'sparse', query, doc, rank from sparse union all select 'union', query, doc, rank from un
  union all select 'rrf', query, doc, rank from rrf union all select 'rerank', query, doc, rank from rr where rank <= 5)"""


def _scores() -> str:
    parts = []
    for k in ev.KS:
        parts += [
            f"(n_{k} > 0)::int::double as hit_{k}", f"round(n_{k}::double / gold_size, 6) as recall_{k}", f"round(coalesce(1.0::double / f_{k}, 0), 6) as mrr_{k}",
            f"round(coalesce(d_{k}, 0) / list_sum(list_transform(range(1, least(gold_size, {k}) + 1), lambda r: 1 / log2(r + 1))), 6) as ndcg_{k}",
        ]
    parts.append(f"round(case when returned = 0 then 0 else n_{ev.KS[0]}::double / returned end, 6) as precision_{ev.KS[0]}")
    cols = ", ".join(f"case when gold_size > 0 then {p.rsplit(' as ', 1)[0]} end as {p.rsplit(' as ', 1)[1]}" for p in parts)
    aggs = ", ".join(f"count(*) filter (g and rank <= {k}) as n_{k}, min(rank) filter (g and rank <= {k}) as f_{k}, sum(case when g and rank <= {k} then 1 / log2(rank + 1) else 0 end) as d_{k}" for k in ev.KS)
    zero = ", ".join(f"coalesce(n_{k}, 0) as n_{k}, f_{k}, d_{k}" for k in ev.KS)
    return f"""{_STAGES}, marked as (select h.*, g.doc is not null as g from hits h left join (select distinct * from gold) g on g.query = h.query and g.doc = h.doc),
  agg as (select stage, query, {aggs}, count(*) filter (rank <= {ev.KS[0]}) as returned from marked group by stage, query),
  pairs as (select stage, item_id as query from (select distinct stage from hits), benchmark),
  joined as (select p.stage, p.query, coalesce(s.n, 0) as gold_size, {zero}, coalesce(returned, 0) as returned from pairs p left join agg using (stage, query) left join (select query, count(distinct doc) as n from gold group by query) s on s.query = p.query),
  scores as (select stage, query, gold_size, {cols} from joined)"""


# ---- Spark parts ----------------------------------------------------------


def sparse_list(spark, sf, k: int = DEPTH) -> DataFrame:
    return sp.bm25_topk(docs(spark, sf), bench(spark, sf), k)


def dense_list(spark, sf, k: int = DEPTH) -> DataFrame:
    return de.text_cosine_topk(docs(spark, sf), bench(spark, sf), k)


def lists(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Both channels' ranked lists, written for the stages made from them: at most DEPTH rows per query."""
    return staged(dense_list(spark, sf)), staged(sparse_list(spark, sf))


def texts(spark, sf):
    return docs(spark, sf).select(F.col("doc_id").alias("doc"), "text")


def asked(spark, sf):
    return bench(spark, sf).select(F.col("item_id").alias("query"), F.col("text").alias("query_text"))


def with_texts(hits, spark, sf, rows) -> DataFrame:
    """Hits with the columns of their documents, ``rows`` (doc, ...): those of a small table of queries go to the documents, not texts to the hits."""
    return rows.join(maybe_broadcast(hits, bench(spark, sf)), "doc")


def gold(spark, sf) -> DataFrame:
    needles = bench(spark, sf).select(F.col("item_id").alias("needle"), F.col("text").alias("needle_text"))
    return ev.find_contained(needles, texts(spark, sf)).select(F.col("needle").alias("query"), "doc")


def reranked(spark, sf, fused, top: int = 5, max_chars: int | None = GIVEN):
    return hy.rerank(fused, asked(spark, sf), texts(spark, sf), top, max_chars=max_chars)


def stage_hits(spark, sf) -> DataFrame:
    d, s = lists(spark, sf)
    fused = staged(hy.rrf(d, s, limit=DEPTH))
    parts = {"dense": d, "sparse": s, "union": hy.union_stage(d, s), "rrf": fused, "rerank": reranked(spark, sf, fused)}
    out = None
    for name, hits in parts.items():
        rows = hits.select(F.lit(name).alias("stage"), "query", "doc", "rank")
        out = rows if out is None else out.unionByName(rows)
    return out


def scores(spark, sf) -> DataFrame:
    return ev.query_scores(staged(stage_hits(spark, sf)), staged(gold(spark, sf)), bench(spark, sf).select(F.col("item_id").alias("query")))


def top_rows(spark, sf) -> DataFrame:
    """(query, answerable, top_score, gap, hit) of the dense channel."""
    d, g = staged(dense_list(spark, sf)), staged(gold(spark, sf))
    answers = g.select("query").distinct().withColumn("answerable", F.lit(True))
    per = ev.query_scores(d.withColumn("stage", F.lit("dense")), g, bench(spark, sf).select(F.col("item_id").alias("query"))).select("query", F.col("hit_5").alias("hit"))
    return hy.margin(d).join(answers, "query", "left").join(per, "query").select("query", F.coalesce("answerable", F.lit(False)).alias("answerable"), "top_score", "gap", "hit")


_TOP = f"{_DENSE}, {_GOLD}, m as (select query, max(score) filter (rank = 1) as top_score, round(max(score) filter (rank = 1) - max(score) filter (rank = 2), 6) as gap from dense group by query), tops as (select m.query, exists (select 1 from gold g where g.query = m.query) as answerable, top_score, gap, case when exists (select 1 from gold g where g.query = m.query) then (exists (select 1 from gold g join dense d on d.query = g.query and d.doc = g.doc where g.query = m.query and d.rank <= 5))::int::double end as hit from m)"


# ---- queries --------------------------------------------------------------


@query(f"with t as (select doc_id, {_terms('text')} as terms from documents) select doc_id, len(terms)::bigint as n_terms, len(list_distinct(terms))::bigint as n_distinct, md5(array_to_string(terms, ' ')) as digest from t")
def q_tokenize(spark, sf):
    t = docs(spark, sf).select("doc_id", tx.analyze(F.col("text")).alias("terms"))
    return t.select("doc_id", F.size("terms").cast("long").alias("n_terms"), F.size(F.array_distinct("terms")).cast("long").alias("n_distinct"), F.md5(F.array_join("terms", " ")).alias("digest"))


@query(f"with {_TOKENS} select term, (row_number() over (order by term) - 1)::bigint as term_id, df, cf from df")
def q_vocab_df(spark, sf):
    return sp.vocabulary(sp.document_frequencies(sp.term_frequencies(sp.with_counts(docs(spark, sf), "doc_id", "text"))))


@query(f"with {_TOKENS} select n as n_docs, round(avgdl, 6) as avgdl, (select count(*) from df) as vocab_size, (select count(*) from tf) as nonzero, round((select count(*) from tf)::double / (n * (select count(*) from df)), 9) as density from stats")
def q_bm25_stats(spark, sf):
    termed = sp.with_counts(docs(spark, sf), "doc_id", "text")
    return sp.index_summary(sp.term_frequencies(termed), sp.corpus_stats(termed)).withColumn("avgdl", F.round("avgdl", 6)).withColumn("density", F.round("density", 9))


@query(f"with {_TOKENS} select doc, term, tf, round({_WEIGHT}, 6) as weight from tf, stats")
def q_bm25_weights(spark, sf):
    termed = sp.with_counts(docs(spark, sf), "doc_id", "text")
    return sp.postings(sp.term_frequencies(termed), sp.corpus_stats(termed)).withColumn("weight", F.round("weight", 6))


@query(f"with {_BM25} select query, doc, score, rank from sparse where rank <= 5")
def q_bm25_topk(spark, sf):
    return sparse_list(spark, sf, 5).select("query", "doc", "score", F.col("rank").cast("long").alias("rank"))


_LEFT = _BM25.replace("from documents", "from (select * from documents where source is distinct from 'src0')")


@query(f"with {_LEFT} select query, doc, score, matched, rank from sparse where rank <= 5")
def q_stored_index(spark, sf):
    """Top 5 from a stored index after three changes: built from all documents but the Spanish ones, German ones in capitals; those two languages written anew as they are; the hot source deleted."""
    rows = docs(spark, sf).select(F.col("doc_id").alias("doc"), F.col("doc_id").cast("string").alias("artifact"), "text", "lang", "source")
    store = IndexStore(spark, new_folder(spark), buckets=16)
    lang = F.coalesce("lang", F.lit("-"))
    store.rebuild(rows.where(lang != "es").withColumn("text", F.when(lang == "de", F.concat(F.upper("text"), F.lit(" old words"))).otherwise(F.col("text"))))
    store.upsert(rows.where(lang.isin("es", "de")))
    snap = store.delete(rows.where("source = 'src0'"))
    return snap.search(bench(spark, sf), 5, "item_id", "text").select("query", "doc", "score", F.array_join("matched", " ").alias("matched"), F.col("rank").cast("long").alias("rank"))


@query(f"with {_BM25} select query, doc, matched from sparse where rank <= 5")
def q_matched_terms(spark, sf):
    return sp.with_matched(sparse_list(spark, sf, 5), docs(spark, sf), bench(spark, sf)).select("query", "doc", F.array_join("matched", " ").alias("matched"))


@query(f"with {_TOKENS} select query, term, qtf from qt where term in (select term from df)")
def q_known_terms(spark, sf):
    tf = sp.term_frequencies(sp.with_counts(docs(spark, sf), "doc_id", "text"))
    return sp.known_terms(sp.query_terms(bench(spark, sf), "item_id", "text"), sp.document_frequencies(tf)).select("query", "term", "qtf")


@query(f"with {_TOKENS} select query, term, qtf from qt where term not in (select term from df)")
def q_oov_terms(spark, sf):
    tf = sp.term_frequencies(sp.with_counts(docs(spark, sf), "doc_id", "text"))
    return sp.unknown_terms(sp.query_terms(bench(spark, sf), "item_id", "text"), sp.document_frequencies(tf)).select("query", "term", "qtf")


@query(f"with {_TOKENS}, ids as (select term, (row_number() over (order by term) - 1)::bigint as term_id from df) select doc, count(*) as n_terms, md5(string_agg(term_id::varchar, ' ' order by term_id)) as digest from tf join ids using (term) group by doc")
def q_sparse_export(spark, sf):
    termed = staged(sp.with_counts(docs(spark, sf), "doc_id", "text"))
    tf = sp.term_frequencies(termed)
    out = sp.sparse_export(sp.postings(tf, sp.corpus_stats(termed)), sp.vocabulary(sp.document_frequencies(tf)))
    return out.select("doc", F.size("vector").cast("long").alias("n_terms"), F.md5(F.array_join(F.transform("vector", lambda x: x["term_id"].cast("string")), " ")).alias("digest"))


_LOOSE = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]{2,}')"


@query(
    f"""with terms as (select doc_id as doc, {_LOOSE} as terms from documents), tf as (select doc, any_value(len(terms)) as dl, term, count(*) as tf from (select doc, terms, unnest(terms) as term from terms) group by doc, term),
    stats as (select count(*) as n, avg(len(terms)) as avgdl from terms), df as (select term, count(*) as df from tf group by term), qt as (select item_id as query, term, count(*) as qtf from (select item_id, unnest({_LOOSE}) as term from benchmark) group by all),
    scored as (select qt.query, tf.doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * qtf * {_WEIGHT}), 6) as score from qt join df using (term) join tf using (term), stats group by 1, 2)
    select * from (select *, row_number() over (partition by query order by score desc, doc) as rank from scored) where rank <= 3"""
)
def q_bm25_loose_topk(spark, sf):
    return sp.bm25_topk(docs(spark, sf), bench(spark, sf), 3, terms=tx.loose_terms).select("query", "doc", "score", F.col("rank").cast("long").alias("rank"))


@query(
    "with q as (select vec_id as query, embedding as e from embeddings where vec_id % 100 = 0), s as (select query, vec_id as doc, round(list_dot_product(e::double[], embedding::double[]) / (sqrt(list_dot_product(e::double[], e::double[])) * sqrt(list_dot_product(embedding::double[], embedding::double[]))), 6) as score from q, embeddings) "
    "select * from (select *, row_number() over (partition by query order by score desc, doc) as rank from s) where rank <= 10"
)
def q_dense_topk(spark, sf):
    """Every vector whose id is divisible by 100 against all vectors."""
    e = table(spark, sf, "embeddings")
    return de.dense_topk(e, e.where("vec_id % 100 = 0"), 10).select("query", "doc", "score", F.col("rank").cast("long").alias("rank"))


@query(f"select doc, bucket, round(w, 6) as w from {_embed('documents', 'doc_id')}")
def q_hash_embed(spark, sf):
    return de.hash_embedding(docs(spark, sf), "doc_id", "text").withColumn("w", F.round("w", 6))


@query(f"with {_DENSE} select query, doc, score, rank from dense where rank <= 5")
def q_hash_cosine_topk(spark, sf):
    return dense_list(spark, sf, 5).select("query", "doc", "score", F.col("rank").cast("long").alias("rank"))


@query(
    "with n as (select label, vec_id, embedding as a, lead(embedding) over (partition by label order by vec_id) as b from embeddings) select label, vec_id, round(1 - list_dot_product(a::double[], b::double[]) / (sqrt(list_dot_product(a::double[], a::double[])) * sqrt(list_dot_product(b::double[], b::double[]))), 6) as distance from n where b is not null"
)
def q_adjacent_distance(spark, sf):
    return de.adjacent_distance(table(spark, sf, "embeddings"), "label", "vec_id", "embedding")


@query(
    "with n as (select label, vec_id, embedding as a, lead(embedding) over (partition by label order by vec_id) as b from embeddings), d as (select label, vec_id, round(1 - list_dot_product(a::double[], b::double[]) / (sqrt(list_dot_product(a::double[], a::double[])) * sqrt(list_dot_product(b::double[], b::double[]))), 6) as x from n where b is not null), s as (select *, abs(x - lag(x) over (partition by label order by vec_id)) as g from d) "
    "select label, round(quantile_cont(x, 0.95), 6) as by_percentile, round(avg(x) + 3 * stddev_pop(x), 6) as by_deviation, round(avg(x) + 1.5 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)), 6) as by_iqr, round(quantile_cont(g, 0.95), 6) as by_gradient from s group by label"
)
def q_breakpoints(spark, sf):
    d = de.adjacent_distance(table(spark, sf, "embeddings"), "label", "vec_id", "embedding").withColumnRenamed("vec_id", "position")
    out = de.breakpoints(d, "label")
    return out.select("label", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query(
    "with x as (select n_chars::double as s, quality as y from labels join documents using (doc_id) where quality is not null), r as (select s, y, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0 as r from x) select round((sum(r) filter (y = 1) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2.0) / (count(*) filter (y = 1) * count(*) filter (y = 0)), 6)::double as auc from r"
)
def q_auc(spark, sf):
    return de.auc(table(spark, sf, "labels").join(docs(spark, sf).select("doc_id", "n_chars"), "doc_id"), "n_chars", "quality")


@query(f"with {_LISTS}, rrf as {_rrf()} select query, doc, dr::bigint as dense_rank, sr::bigint as sparse_rank, score, rank from rrf")
def q_rrf(spark, sf):
    return hy.rrf(*lists(spark, sf), limit=DEPTH).select("query", "doc", F.col("dense_rank").cast("long").alias("dense_rank"), F.col("sparse_rank").cast("long").alias("sparse_rank"), "score", F.col("rank").cast("long").alias("rank"))


@query(f"with {_LISTS}, rrf as {_rrf(wd=0.7, ws=0.3, limit=10)} select query, doc, score, rank from rrf")
def q_rrf_weighted(spark, sf):
    return hy.rrf(*lists(spark, sf), limit=10, weights=(0.7, 0.3)).select("query", "doc", "score", F.col("rank").cast("long").alias("rank"))


@query(f"with {_LISTS} select query, doc, rank from {_UNION}")
def q_union_stage(spark, sf):
    return hy.union_stage(*lists(spark, sf)).select("query", "doc", F.col("rank").cast("long").alias("rank"))


@query(f"with {_LISTS}, rrf as {_rrf()} select query, max(score) filter (rank = 1) as top_score, round(max(score) filter (rank = 1) - max(score) filter (rank = 2), 6) as gap from rrf group by query")
def q_margin(spark, sf):
    return hy.margin(hy.rrf(*lists(spark, sf), limit=DEPTH))


@query(f"with {_LISTS}, rrf as {_rrf()}, rr as {_rerank('d.text')} select query, doc, rerank_score, pre_rank, rank from rr where rank <= 5")
def q_rerank(spark, sf):
    """The fused lists in the order of the query's terms in whole texts."""
    out = reranked(spark, sf, hy.rrf(*lists(spark, sf), limit=DEPTH), max_chars=None)
    return out.select("query", "doc", "rerank_score", F.col("pre_rank").cast("long").alias("pre_rank"), F.col("rank").cast("long").alias("rank"))


@query(f"with {_LISTS}, rrf as {_rrf()}, rr as {_RERANK} select query, doc, round(rerank_score, 6) as shown, rank from rr where rank <= 5")
def q_display_score(spark, sf):
    out = reranked(spark, sf, hy.rrf(*lists(spark, sf), limit=DEPTH))
    return out.select("query", "doc", hy.display_score("hybrid").alias("shown"), F.col("rank").cast("long").alias("rank"))


_GRID = [(5, 10), (5, 60), (20, 10), (20, 60)]


@query(
    f"with {_LISTS}, cut as (select g.c, g.k, query, doc, case when dr <= g.c then dr end as dr, case when sr <= g.c then sr end as sr from both_, (values {', '.join(map(str, _GRID))}) g(c, k)), s as (select *, round(coalesce(1::double / (k + dr), 0) + coalesce(1::double / (k + sr), 0), 9) as score from cut where dr is not null or sr is not null) "
    "select candidate_k, rrf_k, query, doc, score, rank from (select c::int as candidate_k, k::int as rrf_k, query, doc, score, row_number() over (partition by c, k, query order by score desc, coalesce(dr, 1e9), coalesce(sr, 1e9), doc::varchar) as rank from s) where rank <= 5"
)
def q_ranking_grid(spark, sf):
    out = hy.ranking_grid(*lists(spark, sf), [5, 20], [10, 60], 5)
    return out.select("candidate_k", "rrf_k", "query", "doc", "score", F.col("rank").cast("long").alias("rank"))


@query(f"with {_GOLD} select query, doc from gold")
def q_gold_contains(spark, sf):
    return gold(spark, sf)


@query(f"with {_GOLD} select b.item_id as query from benchmark b where b.item_id not in (select query from gold)")
def q_unresolved_gold(spark, sf):
    return bench(spark, sf).select(F.col("item_id").alias("query")).join(gold(spark, sf), "query", "left_anti")


@query(f"with {_scores()} select * from scores")
def q_metrics_per_query(spark, sf):
    return scores(spark, sf)


_CATEGORY = "case when length(b.text) < 200 then 'short' else 'long' end"


@query(
    f"with {_scores()}, c as (select s.*, {_CATEGORY} as category from scores s join benchmark b on b.item_id = s.query) select stage, category, case when grouping(category) = 1 then 'stage' else 'category' end as level, "
    + ", ".join(f"coalesce(round(avg({m}), 4), 0) as {m}, count({m}) as {m}_n" for m in ev.metric_names())
    + " from c group by grouping sets ((stage), (stage, category))"
)
def q_metrics_grouping_sets(spark, sf):
    cat = bench(spark, sf).select(F.col("item_id").alias("query"), F.when(F.length("text") < 200, "short").otherwise("long").alias("category"))
    return ev.summarize_scores(scores(spark, sf).join(cat, "query"))


@query(f"with {_TOP} select threshold, (select count(*) from tops where not answerable and top_score < threshold) as caught, (select count(*) from tops where answerable and top_score < threshold) as wrong from (select distinct top_score as threshold from tops)")
def q_abstention_sweep(spark, sf):
    return ev.abstention_sweep(top_rows(spark, sf).select("answerable", F.col("top_score").alias("score")))


@query(
    f"with {_TOP}, sw as (select threshold, (select count(*) from tops where not answerable and top_score < threshold) as caught, (select count(*) from tops where answerable and top_score < threshold) as wrong from (select distinct top_score as threshold from tops)), e as (select min(top_score) filter (answerable) as lo, max(top_score) filter (not answerable) as hi from tops) "
    "select threshold, caught, lo > hi as separable from sw, e where wrong = 0 and lo is not null and hi is not null order by caught desc, threshold desc limit 1"
)
def q_abstention_best(spark, sf):
    return ev.abstention_best(top_rows(spark, sf).select("answerable", F.col("top_score").alias("score")))


@query(
    f"with {_TOP}, ok as (select *, row_number() over (order by gap, query) as place, count(*) over () as n from tops where gap is not null and hit is not null), x as (select *, place <= n // 2 as low from ok) "
    "select max(n) as n, count(*) filter (low) as low_n, round(avg(hit) filter (low), 4) as low_hit, round(max(gap) filter (low), 4) as low_gap_max, count(*) filter (not low) as high_n, round(avg(hit) filter (not low), 4) as high_hit, round(min(gap) filter (not low), 4) as high_gap_min, round(avg(hit) filter (not low) - avg(hit) filter (low), 4) as delta from x having max(n) >= 6"
)
def q_gap_split(spark, sf):
    return ev.gap_split(top_rows(spark, sf).select("query", "gap", "hit"))


@query(
    f"with {_TOP}, s as (select answerable, top_score as v, row_number() over (partition by answerable order by top_score) - 1 as place, count(*) over (partition by answerable) as n from tops) "
    "select answerable, max(n) as n, min(v) as min, max(v) filter (place = least(floor(n * 0.25), n - 1)) as p25, max(v) filter (place = least(floor(n * 0.5), n - 1)) as p50, max(v) filter (place = least(floor(n * 0.75), n - 1)) as p75, max(v) as max from s group by answerable"
)
def q_dist_summary(spark, sf):
    return ev.distribution(top_rows(spark, sf), "top_score", "answerable")


@query(f"with {_LISTS}, rrf as {_rrf()} select r.query, r.doc from rrf r where not exists (select 1 from dense d where d.query = r.query and d.doc = r.doc) and not exists (select 1 from sparse s where s.query = r.query and s.doc = r.doc)")
def q_pool_invariant(spark, sf):
    d, s = lists(spark, sf)
    return ev.not_in_pools(hy.rrf(d, s, limit=DEPTH), d, s).select("query", "doc")


@query(f"with {_GOLD}, n as (select query, count(distinct doc) as n from gold group by query) select 'stub' as stage, query, 1.0::double as hit_5, 1.0::double as mrr_5, 1.0::double as ndcg_5, round(least(n, 5)::double / n, 6) as recall_5, round(least(n, 20)::double / n, 6) as recall_20, 1.0::double as precision_5 from n")
def q_stub_perfect(spark, sf):
    """A retriever that returns the gold scores 1 everywhere, but for the recall of queries with more gold than k."""
    g = staged(gold(spark, sf))
    hits = sp.top_k(g.withColumn("stage", F.lit("stub")), 1 << 30, F.asc("doc"))
    return ev.query_scores(hits, g, g.select("query").distinct()).select("stage", "query", "hit_5", "mrr_5", "ndcg_5", "recall_5", "recall_20", "precision_5")


@query(f"with {_scores()} select stage, round(avg(recall_5), 4) as recall_5, round(avg(recall_10), 4) as recall_10, round(avg(mrr_20), 4) as mrr_20 from scores where stage in ('rrf', 'rerank') group by stage")
def q_rerank_smoke(spark, sf):
    s = scores(spark, sf).where(F.col("stage").isin("rrf", "rerank"))
    return s.groupBy("stage").agg(*[F.round(F.avg(m), 4).alias(m) for m in ("recall_5", "recall_10", "mrr_20")])


@query(f"with {_BM25}, h as (select s.query, s.rank, contains(d.text, b.text) as ok from sparse s join documents d on d.doc_id = s.doc join benchmark b on b.item_id = s.query) select {_CATEGORY} as kind, count(distinct b.item_id) as n, round(avg(hit), 4) as hit_rate from (select query, max((ok and rank <= 3)::int) as hit from h group by query) x join benchmark b on b.item_id = x.query group by 1")
def q_channel_hit(spark, sf):
    """Share of queries with a hit among the first three that holds the passage, by kind of query."""
    hits = with_texts(sparse_list(spark, sf), spark, sf, texts(spark, sf)).join(asked(spark, sf), "query")
    per = hits.groupBy("query", "query_text").agg(F.max((F.contains("text", "query_text") & (F.col("rank") <= 3)).cast("int")).alias("hit"))
    kind = F.when(F.length("query_text") < 200, "short").otherwise("long")
    return per.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.round(F.avg("hit"), 4).alias("hit_rate"))


@query(
    f"with {_BM25}, h as (select s.query, s.rank, contains(d.text, b.text) as ok from sparse s join documents d on d.doc_id = s.doc join benchmark b on b.item_id = s.query) select query, max(ok::int::double) filter (rank = 1) as top1, max(ok::int::double) filter (rank <= 5) as top5, round(coalesce(1::double / min(rank) filter (ok), 0), 6) as rr, round(avg(ok::int::double), 6) as purity from h group by query"
)
def q_purity(spark, sf):
    hits = with_texts(sparse_list(spark, sf), spark, sf, texts(spark, sf)).join(asked(spark, sf), "query")
    return ev.best_purity(hits, F.contains("text", "query_text"))


_HITS = f"{_BM25}, h as (select s.query, s.rank, trim(d.text, ' ') as body, d.source, d.doc_id from sparse s join documents d on d.doc_id = s.doc where s.rank <= 5 and trim(d.text, ' ') <> ''), u as (select *, 6000 - coalesce(sum(length(body)) over (partition by query order by rank rows between unbounded preceding and 1 preceding), 0) as remaining from h)"


@query(f"with {_HITS} select query, rank as citation, length(substr(body, 1, remaining::bigint))::bigint as body_chars, md5('[C' || rank || '] 文档: ' || source || ' | 章节: 未标注 | 页码未知' || chr(10) || '背景: 文档《' || source || '》' || chr(10) || chr(10) || substr(body, 1, remaining::bigint)) as digest from u where remaining > 0")
def q_citations(spark, sf):
    c = ctx.citations(_hits(spark, sf))
    return c.select("query", F.col("citation").cast("long").alias("citation"), F.length("body").cast("long").alias("body_chars"), F.md5("block").alias("digest"))


@query(f"with {_HITS} select query, sum(length(substr(body, 1, remaining::bigint)))::bigint as context_chars, count(*) as n_citations from u where remaining > 0 group by query")
def q_context_budget(spark, sf):
    return ctx.build_context(_hits(spark, sf), ContextParams()).select("query", F.col("context_chars").cast("long").alias("context_chars"), "n_citations")


def _hits(spark, sf):
    return with_texts(sparse_list(spark, sf, 5), spark, sf, docs(spark, sf).select(F.col("doc_id").alias("doc"), "text", F.col("source").alias("title")))


@query("select 'category' as dimension, 'exact' as value, count(*) as n from benchmark where length(text) < 200 having count(*) > 0 union all select 'category', 'semantic', count(*) from benchmark where length(text) >= 200 having count(*) > 0 union all select 'split', case when item_id % 2 = 0 then 'dev' else 'test' end, count(*) from benchmark group by 2 union all select 'query_lang', 'en', count(*) from benchmark")
def q_qrels_summary(spark, sf):
    return ev.qrels_summary(_qrels(spark, sf))


@query(
    "select item_id::varchar as query_id, unnest(case item_id % 8 when 1 then ['unknown category'] when 2 then ['unanswerable with gold'] when 3 then ['no gold'] when 4 then ['short gold'] when 5 then ['empty query'] when 6 then ['unknown split'] else [] end || case when length(trim(text)) < 8 and item_id % 8 not in (3, 4) then ['short gold'] else [] end || case when length(trim(text)) = 0 and item_id % 8 <> 5 then ['empty query'] else [] end) as problem from benchmark"
)
def q_qrels_violations(spark, sf):
    """Rules that rows break, of which six in eight are broken on purpose."""
    k = F.col("query_id").cast("long") % 8
    text = lambda t: F.array(F.struct(t.alias("text")))
    broken = _qrels(spark, sf).select(
        "query_id", F.when(k == 5, F.lit("  ")).otherwise(F.col("query")).alias("query"), "query_lang",
        F.when(k == 3, F.slice("gold", 1, 0)).when(k == 4, text(F.lit("abc"))).otherwise(F.col("gold")).alias("gold"),
        F.when(k == 1, "odd").when(k == 2, "unanswerable").otherwise(F.col("category")).alias("category"), F.when(k == 6, "train").otherwise(F.col("split")).alias("split"),
    )
    return ev.qrels_violations(broken)


def _qrels(spark, sf):
    b = bench(spark, sf)
    return b.select(
        F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"), F.lit("en").alias("query_lang"), F.array(F.struct(F.col("text").alias("text"))).alias("gold"),
        F.when(F.length("text") < 200, "exact").otherwise("semantic").alias("category"), F.when(F.col("item_id") % 2 == 0, "dev").otherwise("test").alias("split"),
    )
