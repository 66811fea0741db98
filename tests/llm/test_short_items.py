import re

import pytest

from quillmere.llm import queries

SINGLE = "぀-ヿ㐀-䶿一-鿿豈-﫿"


def words(t):
    """An independent cut: single Han and kana characters, else runs of letters and digits."""
    return re.findall(rf"[{SINGLE}]|[^\W_{SINGLE}]+", re.sub("[・゠]", " ", (t or "").lower()))


def brute(t, item):
    d, w = words(t), words(item)
    k = min(5, len(w))
    if not w:
        return 0
    grams = lambda x: {tuple(x[i : i + k]) for i in range(len(x) - k + 1)}
    want = grams(w)
    return len(want & grams(d)) / len(want)


ITEMS = [(1, "Zebra"), (2, "grey whale song"), (3, "one two three four"), (4, "春眠不觉晓，处处闻啼鸟。夜来风雨声"), (5, "古池や蛙飛びこむ水の音"), (6, "..."), (7, "静夜思"), (8, "Ｆｕｌｌ，ｗｉｄｔｈ"), (9, "naïve Été of the long lost summer days"), (10, "𠀀𠀁 字")]
DOCS = [
    (1, "a long text in which a zebra stands among many other animals"),
    (2, "they heard (grey whale) song at night, all of them, and slept"),
    (3, "grey song whale and one two three five four, and more words"),
    (4, "and then one, two, three, four! went on and on to the end"),
    (5, "唐诗选：春眠不觉晓，处处闻啼鸟。夜来风雨声，花落知多少。"),
    (6, "唐诗选：春眠不觉晓处处闻啼鸟夜来风雨多，花落知多少。"),
    (7, "芭蕉の句「古池や蛙飛びこむ水の音」は有名です"),
    (8, "李白的静夜思是名篇"),
    (9, "静夜很思念"),
    (10, "see ｆｕｌｌ、ｗｉｄｔｈ！ letters in here, with words about"),
    (11, "«Naïve» été of the long—lost summer days"),
    (12, "前𠀀𠀁字后 and some"),
    (13, None),
    (14, "zebra"),
    (15, "zebras"),
]


def folder(spark, d):
    spark.createDataFrame(DOCS, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")


def test_short_and_unspaced_items_are_found(spark, tmp_path):
    folder(spark, tmp_path)
    want = {(d, i, round(c, 9)) for d, t in DOCS for i, x in ITEMS if (c := brute(t, x)) >= 0.8}
    got = {(r.doc_id, r.item_id, round(r.containment, 9)) for r in queries.op8_decontaminate(spark, str(tmp_path)).collect()}
    assert got == want
    assert {(1, 1), (2, 2), (4, 3), (5, 4), (6, 4), (7, 5), (8, 7), (10, 8), (11, 9), (12, 10), (14, 1)} == {(d, i) for d, i, _ in want}


def test_pipeline_stage_drops_them(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    folder(spark, tmp_path)
    left = corpus_pipeline.without_benchmark(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert sorted(r.doc_id for r in left.collect()) == [3, 9, 13, 15]
