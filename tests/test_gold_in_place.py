"""Needles of a small stored table are looked for where the texts are: the same pairs as by joins, and no join for long ones."""

from quillmere.operators import evaluate as ev
from quillmere.operators import hybrid as hy

TEXTS = [(1, "one two three four five"), (2, "zone two three fours"), (3, "one\ttwo\nthree four"), (4, None), (5, ""), (6, "three four five one two three fourteen")]
LONG = [(1, "one two three"), (2, "two three four"), (3, "e\ttwo\nt"), (4, "one two three"), (5, " three "), (6, "nowhere to be found")]
SHORT = [(7, "two three"), (8, "four"), (9, " two "), (10, ""), (11, None), (12, "   ")]


def stored(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(path)
    return spark.read.parquet(path)


def test_pairs_of_a_stored_table(spark, tmp_path):
    texts = stored(spark, f"{tmp_path}/t", TEXTS, "doc long, text string")
    for name, rows in (("long", LONG), ("both", LONG + SHORT)):
        out = ev.find_contained(stored(spark, f"{tmp_path}/{name}", rows, "needle long, needle_text string"), texts)
        assert sorted(map(tuple, out.collect())) == sorted((n, d) for n, a in rows for d, t in TEXTS if a and t and a.strip() and a in t)
        if name == "long":
            only = stored(spark, f"{tmp_path}/only", [r for r in rows if len(r[1].split()) > 2], "needle long, needle_text string")
            assert "Join" not in ev.find_contained(only, texts)._jdf.queryExecution().executedPlan().toString()


def test_texts_are_not_shuffled_to_be_reranked(spark, tmp_path):
    docs = stored(spark, f"{tmp_path}/d", [(i, f"word{i} other") for i in range(20)], "doc long, text string")
    asked = stored(spark, f"{tmp_path}/q", [(1, "word3 word4"), (2, "")], "query long, query_text string")
    hits = spark.createDataFrame([(1, d, d + 1, 0.5) for d in range(5)] + [(2, 7, 1, 0.1)], "query long, doc long, rank int, score double")
    out = hy.rerank(hits, asked, docs, 3)
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert [(r.query, r.doc, r.rerank_score) for r in out.orderBy("query", "rank").collect()] == [(1, 3, 0.5), (1, 4, 0.5), (1, 0, 0.0), (2, 7, 0.0)]
