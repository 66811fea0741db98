"""SimHash near-duplicate groups.

A text's fingerprint has a bit set if over half of its shingles' XXH64 values
have it. Two fingerprints link if at most ``most`` (3) bits differ. Pigeonhole:
the 64 bits are cut into ``most`` + 3 blocks, six as a rule; at most ``most`` of them can hold a difference,
so a close pair agrees on some three whole blocks. Each distinct fingerprint is
dealt to the choices of three blocks (20), joined with those of the same 32 or so
bits, and pairs there are verified by their Hamming distance. Only a spanning
forest of each such bucket is kept.

Exact copies meet before that, in a pre-aggregated grouping by fingerprint. A
bucket of over ``BUCKET`` distinct fingerprints is dealt again by the same rule
on the bits that it does not fix, as often as it takes: with every deal half of the free bits are fixed, and
a bucket of ``FREE`` free bits cannot hold over ``BUCKET``. Documents of a fingerprint that holds a large share of all
are joined apart (``hot_join``).

Null and empty texts have fingerprint zero and link like others. Repeated rows
share a component. A null id is never the smallest, and a component of null ids
only has a null id. An empty table gives an empty result. Other columns are not
carried.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmere.llm.batches import append_columns, column, free_name, raw_bytes
from quillmere.llm.components import components
from quillmere.llm.hot import hot_join
from quillmere.llm.tables import staged

SEED = 42
MOST_BITS = 3
#: Fingerprints of a bucket that are compared, and free bits that allow no more.
BUCKET, FREE = 4096, 12


def fingerprints(texts: list[bytes], words: int = 3) -> np.ndarray:
    """Unsigned 64-bit fingerprints."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    values: list[int] = []
    counts = []
    for t in texts:
        parts = t.lower().split()
        n = len(parts)
        if n <= words:
            if n:
                values.append(digest(b" ".join(parts), SEED))
            counts.append(1 if n else 0)
            continue
        joined = b" ".join(parts)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[: n - words] + 1)).tolist()
        values += [digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())]
        counts.append(n - words + 1)
    out = np.zeros(len(texts), np.uint64)
    if not values:
        return out
    count = np.array(counts)
    full = np.flatnonzero(count)
    begin = np.cumsum(count) - count
    bits = np.unpackbits(np.array(values, np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    ones = np.add.reduceat(bits, begin[full], axis=0, dtype=np.int64)
    set_ = 2 * ones > count[full][:, None]
    out[full] = np.packbits(set_, axis=1).view(">u8").reshape(-1).astype(np.uint64)
    return out


def with_fingerprint(docs: DataFrame, text_col: str = "text", words: int = 3, keep: list[str] | None = None) -> DataFrame:
    """Kept columns and ``fp``, the fingerprint as a signed long."""

    def make():
        def run(array: pa.Array):
            data, at = raw_bytes(array)
            texts = [data[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            return [pa.array(fingerprints(texts, words).view(np.int64))]

        return run

    return append_columns(docs, text_col, make, [T.StructField("fp", T.LongType())], keep, limit=1 << 20)


def finer_masks(mask: int, most: int = MOST_BITS) -> list[int]:
    """Masks that fix, beside the bits of ``mask``, three of ``most`` + 3 blocks of those it leaves free."""
    free = [b for b in range(64) if not mask >> b & 1]
    blocks = [sum(1 << int(b) for b in part) for part in np.array_split(np.array(free, int), max(MOST_BITS, most) + 3)]
    keep = len(blocks) - most if most < MOST_BITS else 3
    return sorted({mask | sum(three) for three in combinations(blocks, keep)})


def _deal(most: int):
    """Arrow function from (mask, fp) to (mask, key, fp): the finer buckets of a fingerprint."""
    finer: dict[int, np.ndarray] = {}

    def run(batches):
        for batch in batches:
            mask, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            for m in np.unique(mask).tolist():
                if m not in finer:
                    finer[m] = np.array(finer_masks(m & (1 << 64) - 1, most), np.uint64).view(np.int64)
                own, new = fp[mask == m], finer[m]
                for a in range(0, len(own), 4096):
                    x = np.repeat(own[a : a + 4096], len(new))
                    y = np.tile(new, len(x) // len(new))
                    yield pa.RecordBatch.from_arrays([pa.array(y), pa.array(x & y), pa.array(x)], names=["mask", "key", "fp"])

    return run


def forest(group: np.ndarray, most: int = MOST_BITS) -> list[tuple[int, int]]:
    """Tree links (as indices) that join what lies within ``most`` bits, step by step, in distinct fingerprints."""
    links = []
    left = np.arange(len(group))
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            u = queue.pop()
            near = np.bitwise_count(group[left] ^ group[u]) <= most
            if near.any():
                found = left[near].tolist()
                links += [(u, v) for v in found]
                queue += found
                left = left[~near]
    return links


def _bucket_links(most: int, cap: int):
    """Arrow function over rows (mask, key, fp) sorted by all three; the first two are the bucket.

    Gives the links (a, b) of each bucket, or where it holds more than ``cap`` rows, and not few free bits, these
    again (fingerprint as a, mask as b) for a finer cut. At most one bucket of ``cap`` rows and one batch are held.
    """
    names = ["a", "b", "again"]

    def batch_of(a, b, again):
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), again))], names=names)

    def limit(mask) -> int:
        return cap if 64 - (int(mask) & (1 << 64) - 1).bit_count() > FREE else max(cap, 1 << FREE)

    def links_of(mask, key, fp):
        """Links of whole buckets, and the rows of those that are too large."""
        edges = np.concatenate(([0], np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1, [len(fp)]))
        size = np.diff(edges)
        two = edges[:-1][size == 2]
        near = two[np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= most]
        aa, bb = [fp[near]], [fp[near + 1]]
        for i in np.flatnonzero(size > 2).tolist():
            x = fp[edges[i] : edges[i + 1]]
            if len(x) > limit(mask[edges[i]]):
                yield batch_of(x, mask[edges[i] : edges[i + 1]], True)
                continue
            links = forest(x.view(np.uint64), most)
            if links:
                at = np.array(links)
                aa.append(x[at[:, 0]])
                bb.append(x[at[:, 1]])
        a = np.concatenate(aa)
        if len(a):
            yield batch_of(a, np.concatenate(bb), False)

    def run(batches):
        none = np.zeros(0, np.int64)
        rest = (none, none, none)
        large = None  # the bucket whose rows so far went again
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if large is not None and len(new[0]):
                same = (new[0] == large[0]) & (new[1] == large[1])
                n = len(same) if same.all() else int(np.argmin(same))
                if n:
                    yield batch_of(new[2][:n], new[0][:n], True)
                if n < len(same):
                    large = None
                new = [x[n:] for x in new]
            mask, key, fp = (np.concatenate(x) for x in zip(rest, new))
            if len(fp):  # two deals may lead to one bucket
                once = np.concatenate(([True], (mask[1:] != mask[:-1]) | (fp[1:] != fp[:-1])))
                mask, key, fp = mask[once], key[once], fp[once]
            if not len(fp):
                rest = (mask, key, fp)
                continue
            tail = len(fp) - int(np.argmin(((mask == mask[-1]) & (key == key[-1]))[::-1])) if ((mask != mask[-1]) | (key != key[-1])).any() else 0
            if tail:
                yield from links_of(mask[:tail], key[:tail], fp[:tail])
            rest = (mask[tail:], key[tail:], fp[tail:])
            if len(rest[2]) > limit(rest[0][0]):
                large = (rest[0][0], rest[1][0])
                yield batch_of(rest[2], rest[0], True)
                rest = (none, none, none)
        if len(rest[2]):
            yield from links_of(*rest)

    return run


def near_links(fps: DataFrame, most: int = MOST_BITS, cap: int = BUCKET) -> DataFrame:
    """Links (a, b) whose components are those of all pairs within ``most`` bits in distinct values ``fp``; wider radii have more and shorter keys."""
    rows, links = fps.select(F.lit(0).cast("long").alias("mask"), "fp"), None
    while True:
        dealt = rows.mapInArrow(_deal(most), "mask long, key long, fp long")
        met = staged(dealt.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp").mapInArrow(_bucket_links(most, cap), "a long, b long, again boolean"))
        found = met.where("not again").select("a", "b")
        links = found if links is None else links.unionByName(found)
        rows = met.where("again").select(F.col("b").alias("mask"), F.col("a").alias("fp"))
        if rows.isEmpty():
            return links


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, most: int = MOST_BITS) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id) of every document."""
    src = docs.select(column(id_col).alias("__id"), column(text_col).alias("__t"))
    prints = staged(with_fingerprint(src, "__t", words, keep=["__id"]))
    each = staged(prints.groupBy("fp").agg(F.min("__id").alias("low"), F.count("*").alias("n")))
    comps = staged(components(near_links(each.select("fp"), most)))
    lows = comps.join(each, comps.node == each.fp).groupBy("root").agg(F.min("low").alias("component_low"))
    linked = comps.join(lows, "root").select(F.col("node").alias("fp"), "component_low")
    # a table of its own, so that the join below can be split where one fingerprint has many documents
    known = staged(each.join(linked, "fp", "left").select("fp", F.coalesce("component_low", "low").alias("component_id")))
    return hot_join(prints, known, "fp", each.select("fp", "n")).select(
        F.col("__id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, most: int = MOST_BITS) -> DataFrame:
    """All columns of one document of each component: that of the smallest id, null ids last, then of the smallest hash of all columns; of equal rows one stays."""
    names = [free_name(f"__{n}", docs.columns) for n in ("row", "row2")]
    every = [column(c) for c in docs.columns]
    own = docs.withColumn(names[0], F.xxhash64(*every)).withColumn(names[1], F.xxhash64(F.lit(1), *every))
    src = own.select(column(id_col).alias("id"), column(text_col).alias("__t"), column(names[0]).alias("row"), column(names[1]).alias("row2"))
    prints = staged(with_fingerprint(src, "__t", words, keep=["id", "row", "row2"]))
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "row", "row2")
    each = prints.groupBy("fp").agg(F.min(rank).alias("low"))
    comps = components(near_links(each.select("fp"), most))
    root = each.join(comps, each.fp == comps.node, "left").select(F.coalesce("root", "fp").alias("root"), "low")
    first = root.groupBy("root").agg(F.min("low").alias("low")).select(F.col("low.row").alias(names[0]), F.col("low.row2").alias(names[1]))
    kept = own.join(first, names, "left_semi")
    once = F.row_number().over(Window.partitionBy(*map(column, names)).orderBy(column(names[0])))
    place = free_name("__n", kept.columns)
    return kept.withColumn(place, once).where(column(place) == 1).select(*every)
