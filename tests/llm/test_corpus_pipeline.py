import random

import pytest
import sentencepiece

from quillmere.llm import decontaminate, language_id, queries, secret_scan

corpus_pipeline = pytest.importorskip("corpus_pipeline")

PARTS = {"en": ["th", "er", "an", "in", "on", "re", "at", "the", "ing"], "de": ["sch", "ver", "ung", "ein", "ü", "keit", "ge", "be"]}


def near_shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def prose(rng, lang, n):
    return " ".join("".join(rng.choices(PARTS[lang], k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    d = tmp_path_factory.mktemp("sf")
    rows = []
    for i in range(150):
        lang = rng.choice(list(PARTS))
        rows.append((i, prose(rng, lang, rng.randint(20, 200)), lang))
    items = [(k, prose(rng, "en", 30)) for k in range(5)]
    rows += [(200 + i, rows[i][1], rows[i][2]) for i in range(20)]  # exact copies
    rows += [(300 + i, rows[i][1] + " the", rows[i][2]) for i in range(20)]  # near copies
    rows += [(400 + k, prose(rng, "en", 40) + " " + t + " " + prose(rng, "en", 40), "en") for k, t in items]
    rows += [(500, "Жшщ ъыэ " * 60, None), (501, "12345 !!", None), (502, None, "en"), (503, "", "de")]
    rows += [(600 + i, prose(rng, "en", 50) + f" password=abcdefgh{i}jklmnop AKIA" + "ABCDEFGH" * 2 + " " + prose(rng, "en", 20), "en") for i in range(5)]
    rows += [rows[3], (None, prose(rng, "en", 60), "en")]
    spark.createDataFrame([(i, t, x, "s", len(t or "")) for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), rows, items


def test_stages_equal_brute_force(spark, folder):
    sf, rows, items = folder
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cols = docs.columns
    # 1: the models' own decisions, row by row
    first = corpus_pipeline.known_language(spark, docs, sf)
    assert first.columns == cols
    models = language_id.fit(docs.where(~queries.held_out()))
    gone = set()
    for i, t, _ in rows:
        if models.predict([t])[2][0]:
            gone.add(i)
    assert gone == {500, 501, 502, 503}
    left = [r for r in rows if r[0] not in gone]
    assert sorted(r.doc_id or -1 for r in first.collect()) == sorted(i or -1 for i, _, _ in left)
    # 2: single linkage over all pairs
    second = corpus_pipeline.one_of_each(spark, first, sf)
    grams = [near_shingles(t) for _, t, _ in left]
    root = list(range(len(left)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(left)):
        for b in range(a):
            if grams[a] == grams[b] or len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]) - 1e-9:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    groups = {}
    for k, (i, _, _) in enumerate(left):
        groups.setdefault(find(k), []).append(i)
    want = sorted(min((i for i in g if i is not None), default=-1) for g in groups.values())
    assert second.columns == cols
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in second.collect()) == want
    # 3 and on: over what run() gives
    final = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    sets = [decontaminate.shingle_set(t) for _, t in items]
    text = {i: t for i, t, _ in rows}
    clean = {i for i in (None if k == -1 else k for k in want) if not any(len(s & decontaminate.shingle_set(text[i])) >= 0.8 * len(s) for s in sets)}
    assert set(final) == clean and not any(i in final for i in range(400, 405))
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    for i, r in final.items():
        if i is not None and 600 <= i < 605:
            assert r.text.count("[SECRET]") == 2 and "AKIA" not in r.text and "password" not in r.text
        else:
            assert r.text == text[i] and not secret_scan.base_spans(text[i])
        assert r.n_chars == len(r.text) and r.piece_ids == sp.encode(r.text) and r.n_tokens == len(r.piece_ids) and r.round_trip


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_own_columns_come_out_untouched(spark, tmp_path):
    rng = random.Random(3)
    own = ["score", "spans", "redacted", "n_tokens", "piece_ids", "lang_pred", "rejected", "decoded", "row", "a.b", "__leaked", "__text", "sid", "fp"]
    rows = []
    for i in range(60):
        text = prose(rng, rng.choice(list(PARTS)), 60) + (" password=abcdefgh1jklmnop" if i % 10 == 0 else "")
        rows.append((i, text, rng.choice(list(PARTS)), "s", len(text), *[f"{c} of {i}" for c in own]))
    names = ["doc_id", "text", "lang", "source", "n_chars", *own]
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, prose(rng, "en", 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*names, "_n_tokens", "_piece_ids", "round_trip"]
    found = out.collect()
    assert len(found) == 60
    for r in found:
        assert list(r[5 : 5 + len(own)]) == [f"{c} of {r.doc_id}" for c in own]
        assert len(r["_piece_ids"]) == r["_n_tokens"] > 0 and ("[SECRET]" in r.text) == (r.doc_id % 10 == 0)
