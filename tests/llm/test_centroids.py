import hashlib
import random

import duckdb
import numpy as np
import pytest

from quillmere.llm import queries
from quillmere.llm.centroids import Bounds, cluster, half_distances, moved, squared


def brute(rows, clusters, rounds, scale, dim):
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return []
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:clusters]
    cents = [v for _, v in start]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(cents))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for k in range(len(cents)):
            mine = [v for (_, v), o in zip(kept, own) if o == k]
            if mine:
                cents[k] = [sum(x) // len(mine) for x in zip(*mine)]
    got = [(i, *nearest(v)) for i, v in kept]
    total = sum(d for _, d, _ in got)
    return [(i, k, d, sum(e for _, e, j in got if j == k), total, hashlib.sha256(",".join(map(str, cents[k])).encode()).hexdigest()) for i, d, k in got]


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    centers = [[rng.uniform(-1, 1) for _ in range(4)] for _ in range(6)]
    rows = [(i, [float(np.float32(x + rng.gauss(0, 0.1 + seed))) for x in rng.choice(centers)]) for i in range(400)]
    rows += [(400 + i, [float(rng.randint(-1, 1)) / 4 for _ in range(4)]) for i in range(200)]  # many ties
    rows += [rows[3], rows[3], (None, rows[5][1]), (700, None), (701, []), (702, [1.0] * 3), (703, [1.0, None, 1.0, 1.0]), (704, [float("nan")] * 4), (705, [float("inf"), 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = [tuple(r) for r in cluster(df, clusters=7, rounds=4, dim=4).collect()]
    assert key(got) == key(brute(rows, 7, 4, 64, 4))


def test_few_rows_none_and_names(spark):
    schema = "vec_id long, embedding array<float>, `a.b` string, cluster string"
    assert cluster(spark.createDataFrame([], schema), dim=2).count() == 0
    df = spark.createDataFrame([(1, [0.5, 1.0], "x", "y"), (2, [0.5, 1.0], "x", "y"), (3, [9.0, 1.0], "z", "y")], schema)
    out = cluster(df, dim=2, keep=["vec_id", "a.b", "cluster"])
    assert out.columns == ["vec_id", "a.b", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    rows = {r.vec_id: r for r in out.collect()}
    assert rows[1].cluster == rows[2].cluster != rows[3].cluster and rows[3]["a.b"] == "z" and rows[1].inertia == 0
    with pytest.raises(Exception, match="after scaling"):
        cluster(spark.createDataFrame([(1, [3e38, 1.0])], "vec_id long, embedding array<float>"), dim=2).count()


def test_bounds_hold_and_save_distances():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-60, 60, (40, 8)) * 9 + rng.integers(-9, 9, (40, 8)) for _ in range(20)])
    cents = x[:12].copy()
    b = Bounds.first(x, 12)
    counts = []
    for _ in range(6):
        b.computed = 0
        b.assign(cents, half_distances(cents))
        counts.append(b.computed)
        d = np.array([squared(x, c) for c in cents]).T
        assert (b.own == d.argmin(1)).all()
        root = np.sqrt(d.astype(float))
        assert (b.u >= root[np.arange(len(x)), b.own]).all() and (b.low <= root).all()
        new = np.array([x[b.own == k].sum(0) // max(1, (b.own == k).sum()) if (b.own == k).any() else cents[k] for k in range(12)])
        b.move(moved(cents, new))
        cents = new
    assert counts[-1] < len(x) * 12 / 4


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    want = con.sql(queries.ORACLE_SQL["op12_centroids"])
    got = queries.op12_centroids(spark, sf)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
