import random
import re
import zlib
from collections import Counter
from math import log10

import pytest
from pyspark.sql import functions as F

from quillmere.llm import queries
from quillmere.llm.partial_matching import code_lengths, partial_matching_scores


def stream(text, order):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return words, bytes([0xFE]) * order + b" ".join(words) + b"\xff"


def learned(texts, order):
    seen = {}
    for t in texts:
        _, s = stream(t, order)
        for i in range(order, len(s)):
            for k in range(order + 1):
                seen.setdefault(s[i - k : i], Counter())[s[i]] += 1
    return seen


def probability(seen, context, byte):
    """Escapes with all bytes excluded that longer contexts saw."""
    p, gone = 1.0, set()
    for k in range(len(context) + 1):
        counts = seen.get(context[k:])
        if counts is None:
            continue
        left = {b: n for b, n in counts.items() if b not in gone}
        if left:
            whole = sum(left.values()) + len(left)
            if byte in left:
                return p * left[byte] / whole
            p *= len(left) / whole
        gone |= set(counts)
    return p / max(1, 256 - len(gone))


def brute(rows, order, learn):
    taught = [t for i, t in rows if learn(i)]
    seen, counts = learned(taught, order), Counter()
    for t in taught:
        counts.update([*stream(t, order)[0], None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        words, s = stream(t, order)
        tokens = [*words, None]
        base = sum(log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        score = sum(log10(probability(seen, s[j - order : j], s[j])) for j in range(order, len(s)))
        out.append((i, len(tokens), sum(w in counts for w in tokens), n, base, score))
    return out


def same(got, want):
    key = lambda r: tuple((x is None, x or 0) for x in r[:4]) + (round(r[4], 4), round(r[5], 4))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for a, b in zip(got, want):
        assert a[4:] == pytest.approx(b[4:], abs=1e-6)


def corpus(seed):
    rng = random.Random(seed)
    parts = ["the", "ing", "an", "re", "Ä", "é", "st", "0", "漢字", "-"]
    words = ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(60)]
    rows = [(i, rng.choice([" ", "\t", "\n ", " \x0b"]).join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \n "), (203, "zq" * 3000), (204, "nie gesehen: Ωψ!"), (None, rows[3][1]), rows[5], rows[5], (205, rows[5][1].upper())]
    return rows


@pytest.mark.parametrize("order,block", [(1, 1 << 30), (3, 2000), (4, 500), (6, 4000)])
def test_equals_brute_force(spark, order, block):
    rows = corpus(order)
    learn = lambda i: i is None or zlib.crc32(str(i).encode()) % 3 != 0
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    mark = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 != 0, F.lit(True))
    got = partial_matching_scores(df, mark, keep=["doc_id"], order=order, block_bytes=block)
    same(got.collect(), brute(rows, order, learn))


def test_probabilities_add_up(spark):
    rows = [t for _, t in corpus(9)]
    order = 2
    seen = learned(rows, order)
    contexts = [b"\xfe\xfe", b"th", b"g ", b"zz", b"\xfet", b"q\x00"]
    asked = {(c[0] << 16) | (c[1] << 8) | b: seen.get(c, {}).get(b, 0) for c in contexts for b in range(256)}
    counts = Counter()
    for t in rows:
        _, s = stream(t, order)
        counts.update((s[i - 2] << 16) | (s[i - 1] << 8) | s[i] for i in range(2, len(s)))
    table = {**{g: n for g, n in counts.items()}, **asked}
    got = {r.g: r.x / 1e10 for r in code_lengths(spark.createDataFrame(sorted(table.items()), "g long, n long"), order).collect()}
    for c in contexts:
        assert sum(10 ** got[(c[0] << 16) | (c[1] << 8) | b] for b in range(256)) == pytest.approx(1, abs=1e-6)


def test_nothing_learned_empty_and_names(spark):
    schema = "doc_id long, text string, score string, `a.b` string, g long, block string"
    assert partial_matching_scores(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    df = spark.createDataFrame([(1, "ab", "own", "x", 3, "y"), (2, None, "own", "x", None, "y")], schema)
    out = partial_matching_scores(df, F.lit(False))
    assert out.columns == ["doc_id", "text", "a.b", "g", "block", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].score == pytest.approx(-3 * log10(256)) and rows[1].base_score == pytest.approx(0) and rows[2].n_tokens == 1 and rows[2]["a.b"] == "x"
    with pytest.raises(ValueError):
        partial_matching_scores(df, F.lit(True), order=7)


def test_query_equals_brute_force_and_predicts_better(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op13_partial_matching(spark, sf).collect()
    aside = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    assert all(r.held_out == aside(r.doc_id) for r in got)
    same([(r.doc_id, *r[2:]) for r in got], brute(rows, 4, lambda i: not aside(i)))
    # held-out bytes cost less than by the frequencies of single bytes
    single = Counter(b for i, t in rows if not aside(i) for b in stream(t, 0)[1])
    total = sum(single.values()) + 256
    plain = sum(log10((single[b] + 1) / total) for i, t in rows if aside(i) for b in stream(t, 0)[1])
    assert sum(r.score for r in got if r.held_out) > 0.75 * plain
