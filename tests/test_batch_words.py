"""Words of a batch are looked at together: no text's run reaches into the next one's, and searches lay out numbers, not words."""

import random
import re
import unicodedata
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmere.functions.text import HASH_STOP_CHARS, STOPWORDS
from quillmere.operators import counts as co
from quillmere.operators import dense as de
from quillmere.operators import sparse as sp
from quillmere.plans.retrieval import QUERIES

PIECES = ["a", "b", "A", "B1", "_", ".", ":", "/", "+", "-", " ", "\n", "\x00", "é", "的", "一", "个", "中", "文", "鿿", "䷿", "ꀀ", "İ", "K", "Ａ", "ﬁ", "😀", "the", "7", "豈"]


def plain_terms(text):
    low = unicodedata.normalize("NFKC", text or "").lower()
    out = [t.lstrip(".:/+-").rstrip(".:") for t in re.findall(r"[a-z0-9_.:/+\-]+", low)]
    out += [run[i : i + 2] for run in re.findall("[一-鿿]+", low) for i in range(len(run) - 1)]
    return Counter(t for t in out if t and t not in STOPWORDS and not re.fullmatch("[0-9]", t))


def plain_hash_words(text):
    left = "".join(c for c in text or "" if "一" <= c <= "鿿" and c not in HASH_STOP_CHARS)
    return Counter([w.lower() for w in re.findall("[A-Za-z0-9]+", text or "")] + [left[i : i + 2] for i in range(max(1, len(left) - 1)) if left])


def test_words_of_a_batch_are_those_of_its_texts():
    draw = random.Random(5)
    for _ in range(300):
        texts = [None if draw.random() < 0.1 else "".join(draw.choices(PIECES, k=draw.randint(0, 12))) for _ in range(draw.randint(0, 9))]
        batch = pa.array(["unseen", *texts], pa.string())[1:]  # a slice, as searches take them
        for found, plain in ((co.term_tokens, plain_terms), (co.hash_words, plain_hash_words)):
            line, number, words = found(batch)
            got, names = [Counter() for _ in texts], words.to_pylist()
            assert len(set(names)) == len(names)
            for i, n in zip(line, number, strict=True):
                got[i][names[n]] += 1
            assert got == [plain(t) for t in texts]


def test_a_search_writes_numbers_of_terms_and_no_vectors_of_documents(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, f"alpha{i % 7} beta{i % 3} gamma 中文{'delta ' * (i % 5)}" if i % 11 else None) for i in range(60)], "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    spark.createDataFrame([(i, f"alpha{i} beta{i} delta nowhere{i}") for i in range(9)], "item_id long, text string").write.parquet(f"{tmp_path}/q")
    docs, queries = spark.read.parquet(f"{tmp_path}/d"), spark.read.parquet(f"{tmp_path}/q")
    written = []
    for module in (sp, de):
        monkeypatch.setattr(module, "staged", lambda df, real=module.staged: written.append(real(df)) or written[-1])
    sp.bm25_topk(docs, queries, 4).collect()
    tables = [df for df in written if df.count() == docs.count()]
    assert tables and all(f.dataType in (T.LongType(), T.ArrayType(T.IntegerType())) for df in tables for f in df.schema)
    written.clear()
    got = de.text_cosine_topk(docs, queries, 4).collect()
    assert [df.count() for df in written] == [queries.count()]
    want = de.sparse_cosine_topk(de.hashed(docs, "doc_id", "text"), de.hashed(queries, "item_id", "text"), 4).collect()
    assert sorted(got) == sorted(want) == sorted(de.text_cosine_topk(docs, queries, 4, block=2).collect())
    w = de.hash_embedding(docs, "doc_id", "text").alias("d").join(de.hash_embedding(queries, "item_id", "text").alias("q"), "bucket")
    pairs = {(r.query, r.doc): r.score for r in w.groupBy(F.col("q.doc").alias("query"), F.col("d.doc").alias("doc")).agg(F.round(F.sum(F.col("d.w") * F.col("q.w")), 6).alias("score")).collect()}
    assert got and all(abs(pairs[r.query, r.doc] - r.score) < 1e-9 for r in got)


@pytest.mark.parametrize("name", ["q_margin", "q_union_stage", "q_rrf_weighted"])
def test_queries_of_fused_lists_write_no_words_of_documents(spark, monkeypatch, name):
    sf, written, staged = "/root/testdata/sf0.001", [], sp.staged
    monkeypatch.setattr(sp, "staged", lambda df: written.append(staged(df)) or written[-1])
    assert QUERIES[name](spark, sf).count()
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    tables = [df for df in written if df.count() == n]
    assert tables and all("string" not in df.schema.simpleString() for df in tables)
