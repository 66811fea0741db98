"""Centroid clustering with Elkan's bounds, exact on integer vectors.

Components become integers. Each vector keeps, from round to round, an upper bound of
the distance to its centroid and a lower bound of the distance to each centroid. A round
first takes the distances between centroids: where half the distance from a vector's
centroid to another one, or the vector's lower bound for that one, is more than the upper
bound, the other one can't be nearer, and its distance is not computed. When centroids
have moved, bounds give way by as much. Bounds are 32-bit floats, rounded outwards at each step,
and pruning is strict, so that a centroid which may be as near is always compared;
comparisons and final distances are sums of integers.

A round is one pass over a staged table in which each row holds its vector and bounds; what
meets in one place are a task's sums by centroid, and the centroids themselves.

Defined results: a vector that is null, has another length, or a null, NaN or infinite component has no row. Repeated
rows each have one. Vectors at one distance from two centroids go to that of the smaller number. Rows whose id is null are
clustered but start no centroid unless there are too few others. With fewer rows than centroids each row starts one; an empty table gives an empty one.
Kept columns named like a result give way to it. A component of 2^27 or more after scaling is an error: squared
distances would not fit into 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmere.llm.batches import column, release_memory
from quillmere.llm.tables import drop_staged, staged

DIM, CLUSTERS, ROUNDS, SCALE = 64, 16, 3, 64
#: Largest size of a component.
MOST = 1 << 27
#: Rows taken at once.
ROWS = 4096


def _up(x: np.ndarray) -> np.ndarray:
    """Float32 values that are no less."""
    return np.nextafter(np.asarray(x, np.float64).astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    """Float32 values that are no more, zero at least."""
    return np.maximum(np.nextafter(np.asarray(x, np.float64).astype(np.float32), np.float32(-np.inf)), np.float32(0))


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


class Bounds:
    """Bounds of rows ``x`` (integers): ``own`` centroid, upper bound ``u``, lower bounds ``low`` of each centroid.

    ``computed`` counts the distances that were computed.
    """

    def __init__(self, x: np.ndarray, own: np.ndarray, u: np.ndarray, low: np.ndarray):
        self.x, self.own, self.u, self.low, self.computed = x, own, u, low, 0

    @classmethod
    def first(cls, x: np.ndarray, k: int) -> "Bounds":
        """Nothing is known: every row is centroid 0's, as far as may be."""
        return cls(x, np.zeros(len(x), np.int64), np.full(len(x), np.inf, np.float32), np.zeros((len(x), k), np.float32))

    def move(self, drift: np.ndarray) -> None:
        """Centroids have moved by no more than ``drift``."""
        self.u = _up(self.u.astype(np.float64) + drift[self.own])
        self.low = _down(self.low.astype(np.float64) - drift)

    def assign(self, centroids: np.ndarray, half: np.ndarray) -> np.ndarray:
        """Gives each row its nearest centroid; ``half`` the distances between centroids, no more than that. Returns the squared distances where they were computed, -1 elsewhere."""
        d2 = np.full(len(self.x), -1, np.int64)
        apart = half + np.diag(np.full(len(half), np.inf))
        open_rows = np.flatnonzero(~(apart.min(1)[self.own] > self.u))
        for c in range(len(centroids)):
            rows = open_rows[self.own[open_rows] != c]
            u, own = self.u[rows], self.own[rows]
            rows = rows[~((self.low[rows, c] > u) | (half[own, c] > u))]
            loose = rows[d2[rows] < 0]
            if len(loose):  # the upper bound becomes the distance
                self._near(loose, self.own[loose], centroids, d2)
                u, own = self.u[rows], self.own[rows]
                rows = rows[~((self.low[rows, c] > u) | (half[own, c] > u))]
            if not len(rows):
                continue
            new = squared(self.x[rows], centroids[c])
            self.computed += len(rows)
            self.low[rows, c] = _down(np.sqrt(new.astype(np.float64)))
            old = d2[rows]
            less = (new < old) | ((new == old) & (c < self.own[rows]))
            won = rows[less]
            self.own[won], d2[won] = c, new[less]
            self.u[won] = _up(np.sqrt(new[less].astype(np.float64)))
        return d2

    def _near(self, rows: np.ndarray, own: np.ndarray, centroids: np.ndarray, d2: np.ndarray) -> None:
        d2[rows] = squared(self.x[rows], centroids[own])
        self.computed += len(rows)
        root = np.sqrt(d2[rows].astype(np.float64))
        self.u[rows] = _up(root)
        self.low[rows, own] = _down(root)


def half_distances(centroids: np.ndarray) -> np.ndarray:
    """Half the distances between centroids, rounded down."""
    d = centroids[:, None, :] - centroids[None, :, :]
    return _down(np.sqrt((d * d).sum(2).astype(np.float64)) / 2)


def moved(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How far each centroid went, rounded up."""
    return _up(np.sqrt(squared(old, new).astype(np.float64))).astype(np.float64)


_STATE = T.StructType([T.StructField("own", T.IntegerType()), T.StructField("u", T.FloatType()), T.StructField("low", T.ArrayType(T.FloatType())), T.StructField("distance", T.LongType())])


def integers(df: DataFrame, vec_col: str, dim: int, scale: int):
    """Rows whose vector is whole, with ``v``: its components as integers."""
    v = F.transform(column(vec_col).cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))))
    ok = column(vec_col).isNotNull() & (F.size(column(vec_col)) == dim) & ~F.exists(column(vec_col).cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    small = ~F.exists(v, lambda x: F.abs(x) >= MOST)
    return df.where(ok), F.when(small, v.cast("array<int>")).otherwise(F.raise_error(F.lit(f"a component is {MOST} or more after scaling")).cast("array<int>"))


def _pass(rows: DataFrame, centroids: np.ndarray, drift: np.ndarray | None, last: bool) -> DataFrame:
    """Rows (r, v and bounds, where there are any) assigned anew; the last pass computes all distances."""
    k, dim = centroids.shape
    shared = rows.sparkSession.sparkContext.broadcast((centroids, half_distances(centroids), drift))

    def run(batches):
        centroids, half, drift = shared.value
        for batch in batches:
            for part in (batch.slice(a, ROWS) for a in range(0, batch.num_rows, ROWS)):
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)
                if drift is None:
                    b = Bounds.first(x, k)
                else:
                    low = part.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                    b = Bounds(x, part.column(2).to_numpy().astype(np.int64), part.column(3).to_numpy().copy(), low)
                    b.move(drift)
                d2 = b.assign(centroids, half)
                if last:
                    left = np.flatnonzero(d2 < 0)
                    d2[left] = squared(x[left], centroids[b.own[left]])
                low = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), pa.array(b.low.ravel()))
                made = [pa.array(b.own.astype(np.int32)), pa.array(b.u), low, pa.array(d2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], names=["r", "v", *_STATE.names])
        release_memory()

    names = ["r", "v"] if drift is None else ["r", "v", "own", "u", "low"]
    return rows.select(*names).mapInArrow(run, T.StructType([*rows.select("r", "v").schema.fields, *_STATE.fields]))


def _means(rows: DataFrame, old: np.ndarray) -> np.ndarray:
    """Exact floors of the means of each centroid's rows; centroids without rows stay."""
    k, dim = old.shape

    def run(batches):
        sums, count = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)
            own = batch.column(0).to_numpy()
            count += np.bincount(own, minlength=k)
            order = np.argsort(own, kind="stable")
            starts = np.flatnonzero(np.diff(own[order], prepend=-1))
            if len(order):
                sums[own[order][starts]] += np.add.reduceat(x[order], starts, axis=0)
        there = np.flatnonzero(count)
        if len(there):
            yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(count[there]), pa.array(sums[there].tolist(), pa.list_(pa.int64()))], names=["own", "n", "sums"])

    parts = rows.select("own", "v").mapInArrow(run, "own int, n long, sums array<long>")
    # sums of many tasks can pass 64 bits before they are divided, so they are added as decimals
    flat = parts.select("own", "n", F.posexplode("sums").alias("at", "s")).groupBy("own", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    new = old.copy()
    for r in flat.collect():  # one row for each centroid and component
        new[r["own"], r["at"]] = int(r["s"]) // r["n"]
    return new


def cluster(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, dim: int = DIM, keep: Sequence[str] | None = None,
) -> DataFrame:
    """Kept columns (the id, if None) with cluster, distance, cluster_inertia, inertia and centroid_sha256 of every whole vector.

    Centroids start as the rows with the smallest SHA-256 of ``1:<id>``, in that order, equal ones by their components.
    """
    keep = [id_col] if keep is None else list(keep)
    results = ["cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    keep = [c for c in keep if c.lower() not in results]
    whole, v = integers(df, vec_col, dim, scale)
    rows = whole.select(F.struct(*[column(c) for c in keep], F.lit(0).alias("__")).alias("r"), v.alias("v"), column(id_col).cast("string").alias("i"))
    digest = F.sha2(F.concat(F.lit("1:"), F.col("i")), 256)
    first = rows.select(digest.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(clusters).collect()
    kinds = df.select(*[column(c) for c in keep]).schema
    out = T.StructType([*kinds.fields, T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType()), T.StructField("cluster_inertia", T.LongType()), T.StructField("inertia", T.LongType()), T.StructField("centroid_sha256", T.StringType())])
    if not first:
        return df.sparkSession.createDataFrame([], out)
    centroids = np.array([r["v"] for r in first], np.int64)
    state = rows.select("r", "v")
    drift, before = None, None
    for _ in range(rounds):
        state = staged(_pass(state, centroids, drift, False))
        if before is not None:
            drop_staged(before)
        new = _means(state, centroids)
        drift, centroids, before = moved(centroids, new), new, state
    final = staged(_pass(state, centroids, drift, True).select("r", F.col("own").alias("cluster"), "distance"))
    if before is not None:
        drop_staged(before)
    totals = final.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()  # a row for each centroid
    every = sum(r["s"] for r in totals)
    named = [(r["cluster"], r["s"], every, hashlib.sha256(",".join(map(str, centroids[r["cluster"]].tolist())).encode()).hexdigest()) for r in totals]
    by = df.sparkSession.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return final.join(F.broadcast(by), "cluster").select(*[F.col("r")[c].alias(c) for c in keep], *results)
