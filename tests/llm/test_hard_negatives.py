import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmere.llm import hard_negatives as hn
from quillmere.llm import queries


def brute(rows, anchor, positives, negatives, scale=256):
    ok = [(i, lab, [int(np.floor(scale * float(x))) for x in v]) for i, lab, v in rows if None not in (i, lab, v) and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, lab, q in ok:
        if not anchor(i):
            continue
        near = [(-sum(a * b for a, b in zip(q, v)), j, x) for j, x, v in ok if j != i and len(v) == len(q)]
        same, other = sorted(r[:2] for r in near if r[2] == lab), sorted(r[:2] for r in near if r[2] != lab)
        for s, p in same[:positives]:
            hits = [(t, j) for t, j in other if 80 * -s <= 100 * -t <= 100 * -s][:negatives]
            out += [(i, p, r + 1, j, -s, -t) for r, (t, j) in enumerate(hits)]
    return sorted(out)


@pytest.mark.parametrize("seed,cells,block", [(0, 64, 7), (1, 4, 1000), (2, 1, 3)])
def test_equals_brute_force(spark, seed, cells, block):
    rng = random.Random(seed)
    centers = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, rng.randint(0, 4), [float(np.float32(x + rng.gauss(0, 0.2))) for x in rng.choice(centers)]) for i in range(500)]
    rows += [(500 + i, i % 3, [float(rng.randint(0, 1)) for _ in range(6)]) for i in range(200)]  # many ties
    rows += [(700 + i, i % 2, [1.0, float(i)]) for i in range(12)]  # another length
    rows += [rows[0], rows[0], rows[7], (800, None, rows[1][2]), (None, 1, rows[1][2]), (801, 1, None), (810, 1, [float("nan")] * 6), (820, 1, [None] * 6), (830, 1, [float("inf")] * 6), (840, 1, []), (841, 1, []), (842, 2, [])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").repartition(6)
    got = hn.hard_negatives(df, F.col("id") % 10 == 0, cells=cells, block=block)
    want = brute(rows, lambda i: i % 10 == 0, 5, 5)
    assert len(want) > 500 and sorted(map(tuple, got.collect())) == want


def test_bounds_hold_and_save_scores():
    rng = np.random.default_rng(3)
    v = np.floor(256 * rng.normal(0, 0.125, (4000, 64))).astype(np.int64)
    label = rng.integers(0, 8, len(v))
    cells = hn.Cells(v.min(0), v.max(0), v[:500])
    c = cells.of(v)
    q = v[:16]
    low, high = cells.bounds(q, c)
    exact = 2 * (q @ v.T)
    assert (low <= exact).all() and (exact <= high).all()
    ids = np.arange(len(v))
    best = hn.Best(16, 5)
    n = sum(hn.scan_positives(cells, (ids[:16], label[:16], q), (ids[a : a + 1000], label[a : a + 1000], c[a : a + 1000], v[a : a + 1000]), best) for a in range(0, len(v), 1000))
    assert n < 16 * len(v) / 8 / 4


def test_empty_clash_and_range(spark):
    schema = "vec_id long, label int, embedding array<float>, id string, v string, `a.b` int"
    assert hn.hard_negatives(spark.createDataFrame([], schema), F.col("id") % 2 == 0).count() == 0
    df = spark.createDataFrame([(i, i % 2, [1.0, 0.9 if i else 1.0], "x", "y", 1) for i in range(4)], schema)
    assert [tuple(r) for r in hn.hard_negatives(df, F.col("id") == 0).collect()] == brute([(i, i % 2, [1.0, 0.9 if i else 1.0]) for i in range(4)], lambda i: i == 0, 5, 5)
    big = spark.createDataFrame([(0, 1, [3e38])], "vec_id long, label int, embedding array<float>")
    with pytest.raises(Exception, match="after scaling"):
        hn.hard_negatives(big, F.col("id") == 0).count()


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    want = con.sql(queries.ORACLE_SQL["op11_hard_negatives"])
    got = queries.op11_hard_negatives(spark, sf)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
