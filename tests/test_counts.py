"""Words counted in Arrow batches are those of the column functions; searches by blocks of queries are those by joins."""

from collections import Counter

from pyspark.sql import functions as F

from quillmere.functions import text as tx
from quillmere.operators import dense as de
from quillmere.operators import sparse as sp
from quillmere.operators.counts import hash_counter, term_counter

TEXTS = [
    None, "", " .:. ", "The API v2.0: see https://x.example.com/a-b/c+d. End.", "..a:b.. -/x_y:: 7 77 a z _ - + /", "中文文本 的一个词 mixed中文and latin 字", "Ｆｕｌｌ ｗｉｄｔｈ ＡＢＣ１２ ﬁne",
    "İstanbul K kelvin ſharp ß É é ὈΔΥΣΣΕΎΣ", "no break here ​zero", "一个 一 的的 因为所以", "tab\tnew\nline\x0b\x00\x1f\x7f ends", "–dash— ‘q’ “q” • €5 ½ ① ㎏", "a a A b B b. b: .b", "\U0001d400\U0001d401 😀 é",
]


def test_same_words_as_the_columns(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id long, t string")
    for r in df.select("id", tx.analyze(F.col("t")).alias("a"), tx.hash_tokens(F.col("t")).alias("h")).collect():
        assert {k.decode(): n for k, n in term_counter(TEXTS[r.id]).items()} == Counter(r.a), r
        assert {k.decode(): n for k, n in hash_counter(TEXTS[r.id]).items()} == Counter(r.h), r
    got = {r.doc: (r.dl, {x.term: x.tf for x in r.counts}) for r in sp.with_counts(df, "id", "t").collect()}
    assert got == {r.doc: (r.dl, dict(Counter(r.terms))) for r in sp.with_terms(df, "id", "t").collect()}


def test_a_search_takes_no_join_over_documents_and_gives_the_same(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, f"alpha{i % 7} beta{i % 3} gamma {'delta ' * (i % 5)}" if i % 11 else None) for i in range(60)], "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    spark.createDataFrame([(i, f"alpha{i} beta{i} beta{i} delta nowhere{i}") for i in range(9)] + [(9, ""), (10, None), (11, "nowhere")], "item_id long, text string").write.parquet(f"{tmp_path}/q")
    docs, queries = spark.read.parquet(f"{tmp_path}/d"), spark.read.parquet(f"{tmp_path}/q")
    want = sp.top_k(sp.bm25_scores(docs, queries), 4, F.desc("score"), F.asc("doc")).select("query", "doc", "score", "rank").collect()
    out = sp.bm25_topk(docs, queries, 4)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(out.collect()) == sorted(want) and want
    monkeypatch.setattr(sp, "TERMS", 20)  # several blocks of queries
    assert sorted(sp.bm25_topk(docs, queries, 4).collect()) == sorted(want)


def test_embedding_is_made_in_its_row(spark):
    df = spark.createDataFrame([(1, "a a b C c é"), (2, ""), (3, None), (4, "中 文的 x")], "id long, t string")
    out = de.hash_embedding(df, "id", "t")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.doc for r in out.collect()} == {1, 4}
    assert abs(sum(r.w**2 for r in out.where("doc = 1").collect()) - 1) < 1e-12
