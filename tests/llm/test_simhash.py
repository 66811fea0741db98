import random
from itertools import combinations

import numpy as np
import xxhash

from quillmere.llm import simhash


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_roots(values, most=3):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in combinations(values, 2):
        if (a ^ b).bit_count() <= most:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def near_values(rng, centres, each):
    out = set()
    for _ in range(centres):
        c = rng.getrandbits(64)
        out.add(c)
        for _ in range(each):
            v = c
            for b in rng.sample(range(64), rng.randint(1, 5)):
                v ^= 1 << b
            out.add(v)
    return sorted(out)


def test_fingerprints_equal_brute_force(spark):
    rng = random.Random(3)
    vocab = ["The", "cat", "été", "SAT", "on", "x", "mat", "ünder", "Über"]
    texts = [None, "", " \t\n", "one", "one two", "One two three"]
    texts += [rng.choice([" ", "\n", "\x0b"]).join(rng.choices(vocab, k=rng.randint(1, 60))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    got = {r.doc_id: r.fingerprint for r in simhash.simhash_components(df).collect()}
    assert got == {i: f"{brute_print(t):016x}" for i, t in enumerate(texts)}


def test_links_equal_brute_force(spark):
    rng = random.Random(5)
    values = near_values(rng, 30, 40)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    for cap, most in ((4096, 3), (8, 3), (4096, 6)):  # the second sends most buckets through finer cuts
        want = brute_roots(values, most)
        links = simhash.near_links(fps, most, cap).collect()
        both = [tuple(int(np.int64(x).view(np.uint64)) for x in r) for r in links]
        assert all((a ^ b).bit_count() <= most for a, b in both)
        root = {v: v for v in values}

        def find(v):
            while root[v] != v:
                v = root[v]
            return v

        for a, b in both:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        assert {v: find(v) for v in values} == want


def test_masks_leave_no_close_pair_out():
    rng = random.Random(6)
    for mask in (0, (1 << 32) - 1, rng.getrandbits(64) | rng.getrandbits(64), (1 << 60) - 1):
        masks = simhash.finer_masks(mask)
        free = [b for b in range(64) if not mask >> b & 1]
        assert all(m & mask == mask for m in masks)
        for _ in range(200):
            differ = sum(1 << b for b in rng.sample(free, 3))
            assert any(m & differ == 0 for m in masks)
    assert all(m.bit_count() >= 31 for m in simhash.finer_masks(0)) and len(simhash.finer_masks(0)) == 20


def test_many_values_in_few_free_bits(spark):
    """Groups of which every deal's buckets are large: all values of 9 low bits, under one prefix."""
    fps = spark.range(1 << 9).selectExpr("id + shiftleft(5L, 40) as fp")
    links = simhash.near_links(fps, cap=64)
    from quillmere.llm.components import components

    assert components(links).groupBy("root").count().collect()[0][:] == (5 << 40, 1 << 9)


def test_components_of_documents(spark):
    rng = random.Random(9)
    base = [" ".join(rng.choices([f"w{k}" for k in range(500)], k=400)) for _ in range(6)]
    rows = []
    for k, t in enumerate(base):
        rows += [(10 * k + 3, t), (10 * k + 1, t), (10 * k + 2, t + " tail")]
    rows += [(100, ""), (101, None), (None, base[0]), (3, base[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = simhash.simhash_components(df).collect()
    assert len(out) == len(rows)
    prints = {}
    for i, t in rows:
        prints.setdefault(brute_print(t), []).append(i)
    roots = brute_roots(sorted(prints))
    lows = {}
    for v, ids in prints.items():
        lows.setdefault(roots[v], []).extend(i for i in ids if i is not None)
    want = sorted((i if i is not None else -1, f"{brute_print(t):016x}", min(lows[roots[brute_print(t)]])) for i, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in out) == want
    assert simhash.simhash_components(df.limit(0)).count() == 0
