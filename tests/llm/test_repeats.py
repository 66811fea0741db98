import hashlib
import random
from collections import Counter

import numpy as np

from quillmere.llm import repeats


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[k : k + length] for r in raw for k in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for k in range(len(r) - length + 1):
            if seen[r[k : k + length]] > 1:
                gone[k : k + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))) == 1)
        kept = np.frombuffer(r, np.uint8)[~gone].tobytes()
        out.append((len(r), int(gone.sum()), len(edges), hashlib.sha256(kept).hexdigest()))
    return out


def test_statistics_equal_brute_force():
    rng = random.Random(1)
    for _ in range(40):
        parts = list({bytes(rng.choices(b"ab\x00\xff", k=rng.randint(1, 22))) for _ in range(rng.randint(1, 6))})
        size = np.array([len(p) + 1 for p in parts])
        text = np.frombuffer(b"\0".join([*parts, b""]), np.uint8).astype(np.uint16) + 1
        ends = np.cumsum(size) - 1
        text[ends] = 0
        index = repeats.RunLengthIndex(text)
        assert index.run_lengths.sum() == len(text) and sorted(index.run_symbols.repeat(index.run_lengths)) == sorted(text)
        ms = index.matching_statistics()
        for i, p in enumerate(parts):
            for a in range(len(p)):
                best = 0
                for j, q in enumerate(parts):
                    for b in range(len(q)):
                        k = 0
                        while (i, a) != (j, b) and a + k < len(p) and b + k < len(q) and p[a + k] == q[b + k]:
                            k += 1
                        best = max(best, k)
                assert ms[ends[i] + 1 - size[i] + a] == best


def fixture(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices(["th", "er", "é", "on", "in", "x"], k=rng.randint(1, 4)))
    body = lambda n: " ".join(word() for _ in range(n))
    common = body(60)
    passages = [body(n) for n in (38, 41, 45, 60, 200)]
    texts = [None, "", "short", "a" * 199, "b" * 200, "c" * 201, "d" * 1000, common]
    for _ in range(30):
        t = body(rng.randint(0, 80))
        for _ in range(rng.randint(0, 2)):
            t += " " + rng.choice(passages) + " " + body(rng.randint(0, 30))
        texts.append(t)
    texts += [body(5) + common + body(rng.randint(0, 60)) for _ in range(25)]
    texts += [texts[10], texts[11], texts[12][5:], texts[13] + "tail", texts[14].replace("th", "er", 1)]
    return texts


def test_removal_equals_brute_force(spark):
    for seed, group, block in ((1, 8192, 2 << 20), (2, 3, 2000), (3, 8192, 500)):
        texts = fixture(seed)
        ids = list(range(len(texts)))
        ids[-1] = None  # an unknown id
        rows = [*zip(ids, texts), (9, texts[9])]  # and a row that is there twice
        df = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, rk string, n_bytes int")
        got = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(df, group=group, index_bytes=block).collect())
        want = sorted(((i if i is not None else -1), *w) for (i, _), w in zip(rows, brute([t for _, t in rows], repeats.LENGTH)))
        assert got == want
        assert sum(w[2] > 0 for w in want) > 30


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.remove_repeats(df).count() == 0


def test_equal_rows_are_linear(spark):
    """Many rows equal in id and text: one set of marks for all of them."""
    rng = random.Random(5)
    text = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(600))
    rows = [(1, text)] * 1000 + [(2, "x" + text[50:900])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    src = df.selectExpr("text", "xxhash64(doc_id, text) rk", "hash(1, doc_id, text) rk2")
    marks = repeats.repeated_spans(src, "text").collect()
    assert len(marks) == 2 and max(len(r.marks) for r in marks) < 80
    got = repeats.remove_repeats(df).groupBy("doc_id", "n_bytes", "n_removed", "n_spans").count().collect()
    assert sorted(map(tuple, got)) == [(1, len(text), len(text), 1, 1000), (2, 851, 850, 1, 1)]


def test_large_anchors_go_through_indexes_again(spark):
    """One passage in texts of different words about it: by cores, and by strings where these are many too."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    passage = " ".join(word() for _ in range(45))
    tails = [" ".join(word() for _ in range(60)) for _ in range(4)]
    texts = [f"{' '.join(word() for _ in range(20))} {passage} {rng.choice(tails) if k % 3 else word()}" for k in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted((i, *w) for i, w in enumerate(brute(texts, repeats.LENGTH)))
    for group in (8192, 20, 2):
        assert sorted(map(tuple, repeats.remove_repeats(df, group=group).collect())) == want
