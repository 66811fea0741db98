import random

import pytest
from pyspark.sql import functions as F

from quillmere.operators import sparse as sp
from quillmere.operators.store import IndexStore


def rows_of(spark, docs, **more):
    return spark.createDataFrame([(i, a, t) for i, (a, t) in sorted(docs.items())], "doc long, artifact string, text string")


def searched(df):
    return sorted((r["query"], r["rank"], r["doc"], round(r["score"], 5)) for r in df.collect())


def plain(spark, docs, queries, k):
    return searched(sp.bm25_topk(rows_of(spark, docs), queries, k, doc_id="doc", query_id="query_id", query_text="query"))


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(4000)]
    return {i: (f"a{i // 4}", " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(n)}


def test_changes_equal_a_fresh_index(spark, tmp_path):
    docs = corpus(1, 1200)
    store = IndexStore(spark, str(tmp_path / "ix"), buckets=8)
    queries = spark.createDataFrame([(1, "w1 w2 w50"), (2, "w3 w3 unheard"), (3, "w200"), (4, "unheard"), (5, "w1")], "query_id int, query string")
    assert store.snapshot().search(queries, 3).count() == 0
    first = store.rebuild(rows_of(spark, docs))
    assert searched(first.search(queries, 3)) == plain(spark, docs, queries, 3)
    new = {i: (f"a{i // 4}", "w1 w2 " + t) for i, (_, t) in docs.items() if i % 16 < 2}
    second = store.upsert(rows_of(spark, new))
    gone = {i: d for i, d in docs.items() if d[0] not in {a for a, _ in new.values()}} | new
    assert searched(second.search(queries, 3)) == plain(spark, gone, queries, 3)
    third = store.delete(spark.createDataFrame([("a3",), ("a4",)], "artifact string"))
    left = {i: d for i, d in gone.items() if d[0] not in ("a3", "a4")}
    assert third.n_docs == len(left) and searched(third.search(queries, 3)) == plain(spark, left, queries, 3)
    # pinned readers see what they saw
    assert searched(first.search(queries, 3)) == plain(spark, docs, queries, 3)
    whole = store.compact()
    assert searched(whole.search(queries, 3)) == plain(spark, left, queries, 3) and len(whole.manifest["segments"]) == 1
    assert len(store.vacuum()) == 3 and store.versions() == [4] and searched(store.snapshot().search(queries, 3)) == plain(spark, left, queries, 3)


def test_search_reads_its_terms_and_heavy_blocks_only(spark, tmp_path):
    rng = random.Random(5)
    docs = {i: (f"a{i}", " ".join(["common"] * (1 + int(rng.paretovariate(1.2))) + [f"t{rng.randint(0, 300)}" for _ in range(20)])) for i in range(3000)}
    store = IndexStore(spark, str(tmp_path / "ix"), buckets=16)
    snap = store.rebuild(rows_of(spark, docs))
    postings = spark.read.parquet(f"{store.path}/segments/{snap.manifest['segments'][0]['id']}/postings")
    every = len(postings.inputFiles())
    one = spark.createDataFrame([(1, "common")], "query_id int, query string")
    got = snap.search(one, 5)
    assert searched(got) == plain(spark, docs, one, 5)
    # one bucket of 16, and of the list's four tiers not all
    read, there = snap.read_partitions
    assert read < there <= 4
    own = postings.where(F.col("bucket") == postings.where("term = 'common'").first()["bucket"])
    assert own.select(F.input_file_name()).distinct().count() < every / 4
    two = spark.createDataFrame([(1, "common t5"), (2, "t7 t9 common")], "query_id int, query string")
    assert searched(snap.search(two, 5)) == plain(spark, docs, two, 5)


def test_a_change_that_dies_is_not_seen(spark, tmp_path, monkeypatch):
    docs = corpus(2, 40)
    store = IndexStore(spark, str(tmp_path / "ix"), buckets=4)
    queries = spark.createDataFrame([(1, "w1 w2")], "query_id int, query string")
    store.rebuild(rows_of(spark, docs))
    before = searched(store.snapshot().search(queries, 5))
    with monkeypatch.context() as m:
        m.setattr(store.files, "write_new", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.rebuild(rows_of(spark, {0: ("a0", "w1")}))
    assert store.versions() == [1] and searched(IndexStore(spark, store.path).snapshot().search(queries, 5)) == before
    assert len(store.vacuum()) == 1
    # of two changes from one version the second fails
    last = store.snapshot()
    store.delete(spark.createDataFrame([("a0",)], "artifact string"))
    with pytest.raises(RuntimeError, match="another change"):
        store._commit(last, last.manifest["segments"])


def test_rows_are_checked_and_vectors_searched(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "ix"), buckets=2, dim=2)
    twice = spark.createDataFrame([(1, "a", "x y"), (1, "b", "z")], "doc long, artifact string, text string")
    with pytest.raises(Exception, match="repeated id"):
        store.rebuild(twice)
    schema = "doc long, artifact string, text string, weight double, vector array<float>, note string"
    with pytest.raises(Exception, match="wrong vector length"):
        store.rebuild(spark.createDataFrame([(1, "a", "x", 1.0, [1.0], "n")], schema))
    assert store.versions() == []
    snap = store.rebuild(spark.createDataFrame([(1, "a", "alpha beta", 0.6, [1.0, 0.0], "n"), (2, "b", "alpha gamma", 1.0, [0.0, 1.0], "m"), (3, "c", None, None, None, None)], schema))
    assert [(r.doc, r.matched) for r in snap.search(spark.createDataFrame([("q", "alpha")], "query_id string, query string"), 5).orderBy("rank").collect()] == [(2, ["alpha"]), (1, ["alpha"])]
    q = spark.createDataFrame([(7, [1.0, 0.1])], "query long, vector array<float>")
    assert [r.doc for r in snap.dense_topk(q, 2).orderBy("rank").collect()] == [1, 2]
    assert {r.note for r in snap.docs().collect()} == {"n", "m", None}
