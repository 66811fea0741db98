"""Chunks are checked where their documents' lines are: texts are dealt once, and the same chunks and problems come out."""

import random

from pyspark.sql import functions as F

from quillmere.operators import chunk as ch
from quillmere.params import ChunkParams
from quillmere.plans import catalogue

ROWS = [(a, o, str(o), k, t, None if k != "heading" else 1) for a in (1, 2) for o, (k, t) in enumerate([
    ("heading", "Top"), ("text", "One two three. " * 9), ("code", "x = 1\n" * 30), ("heading", "Next"), ("text", " "), ("text", "Four five six seven."), ("image", ""), ("text", "Tail words. " * (4 * a)),
])]


def written(spark):
    """Bytes of shuffles so far, by stage."""
    jvm, store = spark._jvm, spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}


def test_texts_are_dealt_once(spark, tmp_path):
    r = random.Random(1)
    docs = [(i, "\n".join(" ".join("%06x" % r.randrange(1 << 24) for _ in range(40)) + "." for _ in range(20))) for i in range(120)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    before = written(spark)
    assert [tuple(x)[0] for x in catalogue.QUERIES["q_chunk_invariants"](spark, str(tmp_path)).select("problem").collect()] == ["ok"]
    after = written(spark)
    assert 0 < sum(n for k, n in after.items() if k not in before) < 2 * sum(len(t) for _, t in docs)


def test_a_document_without_an_id_is_checked(spark, tmp_path):
    spark.createDataFrame([(1, "Some line of one."), (None, "Other line."), (0, "Third line.")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(x) for x in catalogue.QUERIES["q_chunk_invariants"](spark, str(tmp_path)).select("problem", "n").collect()] == [("ok", 3)]


def test_same_chunks_in_place(spark):
    blocks = spark.createDataFrame(ROWS, "artifact long, ord int, block_id string, type string, text string, level int")
    for size in (5, 20, 200):
        p = ChunkParams(chunk_tokens=size)
        plain, own = ch.chunks(blocks, p), ch.chunks(blocks, p, in_place=True)
        assert own.columns == plain.columns and sorted(map(repr, own.collect())) == sorted(map(repr, plain.collect()))


def test_problems_of_every_chunk(spark):
    blocks = spark.createDataFrame(ROWS, "artifact long, ord int, block_id string, type string, text string, level int")
    p = ChunkParams(chunk_tokens=20)
    c = ch.chunks(blocks, p)
    assert {r.problem for r in ch.chunk_problems(c, blocks, p).collect()} == {None} and ch.chunk_problems(c, blocks, p).count() == c.count()
    other = blocks.withColumn("text", F.when(F.col("ord") == 1, F.replace("text", F.lit("two"), F.lit("2"))).otherwise(F.col("text")))
    tight = ChunkParams(chunk_tokens=10)
    for b, q in ((other, p), (blocks, tight), (other, tight)):
        want = {(r.chunk_id, r.problem) for r in ch.invariant_breaks(c, b, q).groupBy("chunk_id").agg(F.min("problem").alias("problem")).collect()}
        assert want and {(r.chunk_id, r.problem) for r in ch.chunk_problems(c, b, q).collect() if r.problem} == want
    gone = ch.chunk_problems(c, blocks.where("ord <> 1"), p)
    assert gone.where("problem = 'fragment differs'").count() == gone.count() - ch.chunk_problems(c.where(~F.exists("fragments", lambda f: f["block_id"] == "1")), blocks, p).count() > 0
