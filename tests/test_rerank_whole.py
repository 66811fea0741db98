"""Reranking reads texts to their ends."""

import duckdb

from quillmere.operators import hybrid as hy
from quillmere.plans import catalogue

FILL = "filler words only " * 400
DOCS = [(1, "alpha " + FILL), (2, "alpha " + FILL + "beta gamma"), (3, "alpha beta " + FILL), (4, FILL), (5, "é" * 3996 + " beta alpha gamma")]
ASKED = [(1, "alpha beta gamma"), (2, "gamma"), (3, "nowhere")]


def test_terms_far_down_count_as_in_the_sql(spark, tmp_path):
    con = duckdb.connect()
    for name, rows, key in (("documents", DOCS, "doc_id"), ("benchmark", ASKED, "item_id")):
        spark.createDataFrame(rows, f"{key} long, text string").write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    got = catalogue.QUERIES["q_rerank"](spark, str(tmp_path))
    want = con.sql(catalogue.ORACLE_SQL["q_rerank"])
    rows = {(r["query"], r["doc"]): r["rerank_score"] for r in got.collect()}
    assert rows[1, 2] == rows[1, 5] == rows[2, 2] == 1.0 and rows[1, 1] < rows[1, 3] < 1.0
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_a_limit_is_kept_where_one_is_given(spark):
    h = spark.createDataFrame([(1, 2, 1, 0.9), (1, 3, 2, 0.8)], "query long, doc long, rank int, score double")
    q, d = spark.createDataFrame(ASKED, "query long, query_text string"), spark.createDataFrame(DOCS, "doc long, text string")
    assert [r.doc for r in hy.rerank(h, q, d, 2).orderBy("rank").collect()] == [2, 3]
    assert [r.doc for r in hy.rerank(h, q, d, 2, max_chars=4000).orderBy("rank").collect()] == [3, 2]
