import random

from quillmere.llm import decontaminate as dc


def brute(docs, items, words=5, share=0.8):
    out = set()
    for d, t in docs:
        own = dc.shingle_set(t, words)
        for i, x in items:
            want = dc.shingle_set(x, words)
            if want and len(want & own) / len(want) >= share - 1e-12:
                out.add((d, i, round(len(want & own) / len(want), 9)))
    return out


def test_matches_equal_brute_force(spark):
    rng = random.Random(1)
    vocab = [f"w{k}" for k in range(40)] + ["Été", "ÉTÉ", "naïve", "x"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice((1, 3, 5, 6, 12, 40, 90))))) for i in range(50)]
    items += [(50, ""), (51, None), (52, "..."), (53, items[4][1]), (54, items[4][1].upper() + "!")]
    docs = []
    for d in range(120):
        body = rng.choices(vocab, k=rng.choice((0, 2, 30, 300)))
        for _ in range(rng.randint(0, 2)):
            part = items[rng.randrange(50)][1].split()
            for _ in range(rng.choice((0, 0, 1, 2, 4))):
                part[rng.randrange(len(part))] = "zz"
            at = rng.randint(0, len(body))
            body[at:at] = part
        docs.append((d, rng.choice([" ", "\n", ", "]).join(body)))
    docs += [(500, None), (501, ""), (502, items[7][1]), (502, items[7][1])]
    df = spark.createDataFrame([(d, t, 9) for d, t in docs], "doc_id long, text string, containment int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert len(want) > 40
    for limit in (8 << 20, 400):
        got = [(r.doc_id, r.item_id, round(r.containment, 9)) for r in dc.contained_items(df, bench, block_bytes=limit).collect()]
        assert set(got) == want
        assert sum(d == 502 for d, _, _ in got) == 2 * sum(d == 502 for d, _, _ in want)
    own = df.withColumnRenamed("containment", "__leaked")
    for limit in (8 << 20, 400):
        kept = dc.without_items(own, bench, block_bytes=limit)
        assert kept.columns == own.columns and {r["__leaked"] for r in kept.collect()} == {9}
        assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in docs if d not in {x for x, _, _ in want})
    assert dc.contained_items(df, bench.limit(0)).count() == 0
    assert dc.contained_items(df.limit(0), bench).count() == 0
    assert dc.without_items(df, bench.limit(0)).count() == len(docs)
