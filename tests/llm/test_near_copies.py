import random
from itertools import combinations

import numpy as np
import pytest

from quillmere.llm import near_copies as nc


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_firsts(rows, share=0.8):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if x == y or len(x & y) >= share * len(x | y) - 1e-9:
            root[find(a)] = find(b)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(i)
    return sorted(min((i for i in g if i is not None), default=-1) for g in groups.values())


def corpus():
    rng = random.Random(4)
    vocab = [f"W{k}" for k in range(300)] + ["Été", "naïve"]
    line = " ".join(rng.choices(vocab, k=30))  # stands in many texts
    rows = [(1, ""), (2, None), (3, "one two"), (4, "One  two"), (5, "a b c d e"), (6, "a b c d e f")]
    for k in range(25):
        base = rng.choices(vocab, k=rng.choice((6, 12, 40, 150, 400)))
        for c in range(rng.choice((1, 2, 6))):
            words = list(base)
            for _ in range(rng.choice((0, 1, 2, 4)) if c else 0):
                words[rng.randrange(len(words))] = f"e{rng.random()}"
            rows.append((1000 - 20 * k - c, " ".join(words) + (f"\n{line}" if rng.random() < 0.5 else "")))
    base = rng.choices(vocab, k=120)
    for c in range(40):  # a chain: each is near the one before it only
        base[c * 3] = f"chain{c}"
        rows.append((2000 + c, " ".join(base)))
    return rows + [(None, rows[10][1]), rows[12], (None, "only one, without an id, of words that stand nowhere else")]


@pytest.mark.parametrize(("cap", "part"), [(64, 8192), (3, 8192), (2, 7)])
def test_one_of_similar_equals_brute_force(spark, cap, part):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, lang string")
    out = nc.one_of_similar(df, cap=cap, part=part)
    assert out.columns == df.columns
    want = brute_firsts(rows)
    assert len(want) < len(rows) - 40
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in out.collect()) == want
    assert nc.one_of_similar(df.limit(0)).count() == 0


def test_bitmaps_leave_no_similar_pair_out():
    rng = random.Random(3)
    for _ in range(300):
        base = [rng.getrandbits(64) for _ in range(rng.choice((1, 5, 20, 200, 3000)))]
        x, y = set(base), set(base)
        for _ in range(rng.randint(0, len(base) // 8 + 1)):
            y.discard(rng.choice(base))
            y.add(rng.getrandbits(64)) if rng.random() < 0.5 else None
        if not y or len(x & y) < 0.8 * len(x | y):
            continue
        a, b = (np.array(sorted(s), np.uint64) for s in (x, y))
        bits = [np.frombuffer(nc.bitmap(s), np.uint64) for s in (a, b)]
        assert nc._may_be(bits[0][None], np.array([len(a)]), bits[1], len(b), 0.8).all()


def test_large_group_emits_few_pairs(spark):
    """Near copies of one text, many of them not similar to each other: pairs stay in proportion to texts."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = []
    for k in range(400):
        words = list(base)
        for _ in range(rng.randint(1, 4)):
            words[rng.randrange(150)] = f"x{k}y{rng.randrange(99)}"
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "sid long, __t string")
    links = nc.similar_links(df)
    assert links.count() < 4 * len(rows)
    got = nc.components(links).groupBy("root").count().collect()
    assert sorted(r["count"] for r in got)[-1] + len(brute_firsts([*rows])) - 1 == 400


def test_ties_and_clashing_names(spark):
    rows = [(1, "one two three four five six", 9, "b"), (1, "one two three four five six", 7, "a"), (2, "another text of some words here", 5, "c"), (2, "another text of some words here", 5, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __row long, __n string")
    from quillmere.llm import simhash

    for f in (nc.one_of_similar, simhash.representatives):
        runs = [sorted(map(tuple, f(df.repartition(k)).collect())) for k in (1, 3)]
        assert runs[0] == runs[1] and f(df).columns == df.columns
        assert [r[0] for r in runs[0]] == [1, 2] and runs[0][0] in rows and runs[0][1] == rows[2]


def test_stage_finds_copies_of_more_than_three_bits(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from quillmere.llm import simhash

    rng = random.Random(7)
    rows = []
    for k in range(30):
        words = [f"w{rng.randrange(900)}" for _ in range(60)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words, "tail", "of", "five"]))]
    a, b = (simhash.fingerprints([t.encode() for _, t in rows[k::2]]).tolist() for k in (0, 1))
    assert any((x ^ y).bit_count() > 3 for x, y in zip(a, b))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.one_of_each(spark, df, "").collect())
    assert got == brute_firsts(rows) == list(range(0, 60, 2))


def test_bitmaps_tell_long_texts_apart():
    rng = random.Random(6)
    for n, m in ((4000, 4000), (4500, 4000), (3900, 4300), (60000, 60000)):
        same = [rng.getrandbits(64) for _ in range(n // 2)]
        a, b = (np.array(sorted({*same, *(rng.getrandbits(64) for _ in range(k - n // 2))}), np.uint64) for k in (n, m))
        bits = [np.frombuffer(nc.bitmap(s), np.uint64) for s in (a, b)]
        assert len(nc.bitmap(a)) <= nc.BITS[1] // 8
        assert n > nc.BITS[1] or not nc._may_be(bits[0][None], np.array([n]), bits[1], m, 0.8).any()
        near = np.array(sorted({*a.tolist()[: n * 9 // 10], *(rng.getrandbits(64) for _ in range(n // 20))}), np.uint64)
        assert nc._may_be(bits[0][None], np.array([n]), np.frombuffer(nc.bitmap(near), np.uint64), len(near), 0.8).all()


def test_long_texts_in_large_buckets_equal_brute_force(spark):
    """Bitmaps of several widths in one bucket; sizes about a power of two."""
    rng = random.Random(8)
    rows = []
    for k in range(6):
        base = [f"w{rng.randrange(90000)}" for _ in range((900, 1010, 1100, 2040, 2300, 4100)[k])]
        for c in range(7):
            words = list(base)
            for _ in range(c * len(base) // 200):
                words[rng.randrange(len(words))] = f"x{rng.random()}"
            rows.append((10 * k + c, " ".join(["a b c d e f g h", *words, *[f"y{c}{j}" for j in range(6 * c)]])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_firsts(rows)
    assert 6 <= len(want) < len(rows) - 6
    for cap, part in ((64, 8192), (2, 8192), (2, 5)):
        assert sorted(r.doc_id for r in nc.one_of_similar(df, cap=cap, part=part).collect()) == want


def test_texts_move_once(spark):
    """Shuffles of whole texts would each write them again; long texts that share some shingles aren't verified on whole sets."""
    rng = random.Random(12)
    rows = []
    for k in range(150):
        words = ["%x" % rng.getrandbits(64) for _ in range(1500)]
        rows.append((2 * k, " ".join(words)))
        if k % 15 == 0:
            rows.append((2 * k + 1, " ".join([*words[:1490], "other", "end"])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    size = sum(len(t) for _, t in rows)
    stages = spark.sparkContext._jsc.sc().statusStore()

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = stages.stageList(None, False, False, getattr(stages, "stageList$default$4")(), None)
        return sum(found.apply(k).shuffleWriteBytes() for k in range(found.size()))

    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written()
        assert sorted(r.doc_id for r in nc.one_of_similar(df).collect()) == list(range(0, 300, 2))
        assert written() - before < 1.6 * size
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)


@pytest.mark.parametrize("most", [1 << 25, 1 << 15, 40])
def test_members_leave_no_listed_row_out(spark, most):
    from quillmere.llm import members

    rows = spark.range(-3000, 9000).selectExpr("id * 7919 as `k.y`", "id as __block")
    ids = rows.where("__block % 37 = 0").select("`k.y`")
    listed = {r[0] for r in ids.collect()}
    may_be, rest = members.parted(rows, ids, "k.y", most)
    got = {r[0] for r in may_be.collect()}
    assert listed <= got and may_be.columns == rows.columns
    if 4 * len(listed) > most:
        assert rest is None and may_be.count() == rows.count()
    else:
        others = [r[0] for r in rest.collect()]
        assert len(got) < 2 * len(listed) and not got & set(others) and len(got) + len(others) == rows.count()
    plain = rows.withColumnRenamed("k.y", "k")
    assert listed <= {r[0] for r in members.among(plain, ids.withColumnRenamed("k.y", "k"), "k", most).collect()}
    none, every = members.parted(rows, ids.limit(0), "k.y", most)
    assert none.count() == 0 and every.count() == rows.count()
