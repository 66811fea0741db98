"""Near copies: texts of similar shingle sets, by SimHash blocks and, beyond their radius, by prefixes.

Two texts link if the Jaccard similarity of their sets of ``WORDS``-word shingles is
at least ``SHARE``. Pairs of close SimHash fingerprints (of shingles of as many words) meet first, by the blocks of
``simhash.near_links``, and are verified on their whole sets. Texts of a similarity of 0.8 to 0.9 differ in 4 to 14 of 64 bits,
more than blocks can search for; so an exact prefix search adds the links that are left:

Shingles are put in one order for all texts; two sets of n and m that
are so similar share one of the first n - ceil(share * n) + 1 and m - ceil(share * m) + 1 of
their shingles. Texts are dealt to those; pairs that meet, and whose sizes and places
leave room for the similarity, are counted. Let x be that of the two sets whose prefix ends
first in the order: what its prefix has of the other set is in the other's prefix too, so the two share at
most the number of buckets in which they met and the rest of x. Pairs for which that is enough
are verified on their whole sets. No link is missed.

Any order is right. To keep buckets small, shingles that many texts of a
sample hold come last. A text that is in a pair has a bitmap of about as many
bits as shingles (``BITS`` are the least and most), in which a bit is the parity of the shingles that fall on it: two sets differ in at least as many shingles as their
bitmaps do in bits, so a pair is left out by its bitmaps only if it can't be similar; only the rest is verified on whole sets. Buckets of
over ``BUCKET`` texts don't emit their pairs. As only components are wanted, such a
bucket, in parts of ``PART`` texts at most, first gives a spanning forest of pairs that bitmaps allow; these are verified. What is
still apart then is compared with all of the bucket, part by part, and every pair that bitmaps allow is verified.

Words are what white space parts, ASCII letters in lower case. A text of fewer words is
one shingle; null and empty texts have the same empty set. Texts move only once, to lose their copies; later steps find
the texts of a list of ids where they are (``members``). Texts of equal sets (by a hash of 64 bits)
meet before the search, in a pre-aggregated grouping.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmere.llm.batches import append_columns, column, free_name, raw_bytes, release_memory
from quillmere.llm.components import components
from quillmere.llm.members import among, parted
from quillmere.llm.simhash import MOST_BITS, near_links, with_fingerprint
from quillmere.llm.tables import drop_staged, staged

WORDS, SHARE = 5, 0.8
BUCKET = 64
#: Least and most bits of a bitmap, most texts of a part of a bucket, and forests that are made over different parts of larger ones.
BITS, PART, ROUNDS = (1 << 10, 1 << 15), 8192, 3
SEED = 42
#: One text in so many counts shingles for their order; at most so many shingles are put last.
SAMPLE, LAST = 16, 1 << 17
_P = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hash values of a text's shingles."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    each = np.array([digest(p, SEED) for p in parts], np.uint64)
    size = min(words, len(each))
    h = np.zeros(len(each) - size + 1, np.uint64)
    for k in range(size):
        h = (h ^ h >> np.uint64(29)) * _P + each[k : k + len(h)]
    return np.unique(h ^ h >> np.uint64(32))


def _texts(array: pa.Array) -> list[bytes]:
    data, at = raw_bytes(array)
    return [data[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def _prefix_size(n: int, share: float) -> int:
    return n - int(np.ceil(share * n - 1e-9)) + 1 if n else 0


def _needed(n, m, share: float):
    """Least number of common shingles of similar sets of n and m."""
    return np.ceil(share / (1 + share) * (n + m) - 1e-9)


def _with(docs: DataFrame, name: str, kind: T.DataType, of, words: int, keep: list[str]) -> DataFrame:
    """Kept columns and ``of`` the shingles of ``__t``."""

    def make():
        def run(array: pa.Array):
            from pyspark.sql.pandas.types import to_arrow_type

            return [pa.array([of(shingle_hashes(t, words)) for t in _texts(array)], to_arrow_type(kind))]

        return run

    return append_columns(docs, "__t", make, [T.StructField(name, kind)], keep, limit=1 << 18)


def _digest(h: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(h.tobytes(), SEED)).view(np.int64))


def _prefixes(sets: DataFrame, words: int, share: float) -> DataFrame:
    """(s, sid, n, place): the shingles that each set is dealt to."""
    sample = _with(sets.where(F.pmod("sid", F.lit(SAMPLE)) == 0), "h", T.ArrayType(T.LongType()), lambda h: h.view(np.int64).tolist(), words, ["sid"])
    often = sample.select(F.explode("h").alias("s")).groupBy("s").count().where("count > 2").orderBy(F.desc("count"), "s").limit(LAST).toArrow()
    key, count = often.column(0).to_numpy().view(np.uint64), often.column(1).to_numpy()
    order = np.argsort(key)
    common = sets.sparkSession.sparkContext.broadcast((key[order], count[order]))

    def first(h):
        key, count = common.value
        if len(key) and len(h):
            at = np.minimum(np.searchsorted(key, h), len(key) - 1)
            h = h[np.lexsort((h, np.where(key[at] == h, count[at], 0)))]
        return {"n": len(h), "h": h[: _prefix_size(len(h), share)].view(np.int64).tolist()}

    kind = T.StructType([T.StructField("n", T.LongType()), T.StructField("h", T.ArrayType(T.LongType()))])
    found = _with(sets, "p", kind, first, words, ["sid"])
    return found.select("sid", F.col("p.n").alias("n"), F.posexplode("p.h").alias("place", "s")).select("s", "sid", "n", F.col("place").cast("long").alias("place"))


def _pairs(share: float, cap: int):
    """Arrow function over rows (s, n, sid, place) sorted by s, n.

    Gives the pairs (a, b) in a bucket s that may be similar, and as s the least number of
    buckets in which they meet if they are; of a bucket of over ``cap`` rows these (again, as a row s, n, sid = a, place = b).
    """
    names = ["a", "b", "s", "n", "again"]

    def batch_of(a, b, s, n=None):
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s), pa.array(np.zeros(len(a), np.int64) if n is None else n), pa.array(np.full(len(a), n is not None))], names=names)

    def meetings(n, m):
        return (_needed(n, m, share) - np.ceil(share * np.maximum(n, m) - 1e-9) + 1).astype(np.int64)

    def room(n, place, i, j):
        common = np.minimum(place[i], place[j]) + np.minimum(n[i] - place[i], n[j] - place[j])
        return common >= _needed(n[i], n[j], share)

    def run(batches):
        rest = [np.zeros(0, np.int64)] * 4
        large = None  # the bucket whose rows so far went again
        for batch in _and_end(batches):
            new = rest if batch is None else [np.concatenate((r, batch.column(k).to_numpy(zero_copy_only=False))) for k, r in enumerate(rest)]
            s, n, sid, place = new
            tail = len(s) if batch is None or not len(s) else int(np.searchsorted(s, s[-1]))
            if len(s) - tail > cap:  # the last bucket is large: what is there of it goes again at once
                large, tail = s[-1], len(s)
            rest = [x[tail:] for x in new]
            s, n, sid, place = (x[:tail] for x in new)
            if not tail:
                continue
            edges = np.concatenate(([0], np.flatnonzero(s[1:] != s[:-1]) + 1, [tail]))
            size = np.diff(edges)
            two = edges[:-1][(size == 2) & (s[edges[:-1]] != large if large is not None else True)]
            aa, bb, cc, held = [], [], [], 0

            def add(i, j):
                ok = room(n, place, i, j)
                x, y = sid[i][ok], sid[j][ok]
                aa.append(np.minimum(x, y))
                bb.append(np.maximum(x, y))
                cc.append(meetings(n[i][ok], n[j][ok]))
                return len(x)

            add(two, two + 1)
            for k in np.flatnonzero((size > 2) | (s[edges[:-1]] == large if large is not None else False)).tolist():
                a, b = int(edges[k]), int(edges[k + 1])
                if b - a > cap or s[a] == large:
                    yield batch_of(sid[a:b], place[a:b], s[a:b], n[a:b])
                    continue
                for j in range(a + 1, b):
                    lo = a + int(np.searchsorted(n[a:j], share * n[j] - 1e-9))
                    if lo < j:
                        i = np.arange(lo, j)
                        held += add(i, np.full(len(i), j))
                    if held > 1 << 16:
                        yield batch_of(np.concatenate(aa), np.concatenate(bb), np.concatenate(cc))
                        aa.clear(), bb.clear(), cc.clear()
                        held = 0
            if aa:
                yield batch_of(np.concatenate(aa), np.concatenate(bb), np.concatenate(cc))

    return run


def bitmap(h: np.ndarray) -> bytes:
    """Parities of how many of the shingles fall on each bit; the bits are a power of two, as many as shingles at least within ``BITS``."""
    size = min(BITS[1], max(BITS[0], 1 << max(0, len(h) - 1).bit_length()))
    return np.packbits((np.bincount((h % np.uint64(size)).astype(np.int64), minlength=size) & 1).astype(bool)).tobytes()


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps of the same shingles with fewer bits (``width`` words)."""
    while bits.shape[-1] > width:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def _may_be(bits: np.ndarray, n: np.ndarray, one: np.ndarray, m, share: float) -> np.ndarray:
    """Whether sets with these bitmaps and sizes may be similar to one of m, or each to its own: of n + m, both hold what is needed twice and the rest once."""
    width = min(bits.shape[-1], one.shape[-1])
    apart = np.bitwise_count(_folded(bits, width) ^ _folded(one, width)).sum(1, dtype=np.int64)
    return (apart <= n + m - 2 * _needed(n, m, share)) & (np.minimum(n, m) >= share * np.maximum(n, m) - 1e-9)


class _Bitmaps:
    """Bitmaps of a group's rows, in one table for each width."""

    def __init__(self, values):
        self.width = np.array([len(v) // 8 for v in values], np.int64)
        self.at, self.of = np.zeros(len(values), np.int64), {}
        for w in np.unique(self.width).tolist():
            rows = np.flatnonzero(self.width == w)
            self.at[rows] = np.arange(len(rows))
            self.of[w] = np.frombuffer(b"".join(values[k] for k in rows.tolist()), np.uint64).reshape(-1, w)

    def may_be(self, rows: np.ndarray, n: np.ndarray, u: int, share: float) -> np.ndarray:
        """For each of ``rows``, whether it may be similar to row u."""
        own = int(self.width[u])
        out, one = np.zeros(len(rows), bool), self.of[own][self.at[u]]
        for w, table in self.of.items():  # sizes of similar sets, and so widths, are less than twice and half the other's
            if own <= 2 * w <= 4 * own:
                mine = np.flatnonzero(self.width[rows] == w)
                out[mine] = _may_be(table[self.at[rows[mine]]], n[rows[mine]], one, int(n[u]), share)
        return out


def _pairs_left(share: float):
    """Arrow function over pairs (a, b, n, x, m, y) with sizes and bitmaps: those that bitmaps allow."""

    def run(batches):
        for batch in batches:
            n, m = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 4))
            x, y = (_Bitmaps(batch.column(k).to_pylist()) for k in (3, 5))
            ok = np.zeros(batch.num_rows, bool)
            for v, one in x.of.items():
                for w, two in y.of.items():
                    rows = np.flatnonzero((x.width == v) & (y.width == w))
                    if len(rows):
                        ok[rows] = _may_be(one[x.at[rows]], n[rows], two[y.at[rows]], m[rows], share)
            yield batch.select(["a", "b"]).filter(pa.array(ok))
        release_memory()

    return run


def _groups(batches):
    """Rows (key, n, sid, root, bits, few) sorted by the key, as arrays of whole groups."""
    held = None
    for batch in _and_end(batches):
        if batch is not None:
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2, 3)]
            new.append(np.array([*batch.column(4).to_pylist(), None], object)[:-1])
            new.append(batch.column(5).to_numpy(zero_copy_only=False))
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
        if held is None or not len(held[0]):
            continue
        key = held[0]
        end = len(key) if batch is None else int(np.searchsorted(key, key[-1]))
        edges = np.concatenate(([0], np.flatnonzero(key[1:end] != key[: max(end - 1, 0)]) + 1, [end])) if end else [0]
        for a, b in zip(edges[:-1], edges[1:]):
            n, sid, root, bits, few = (x[a:b] for x in held[1:])
            yield n, sid, root, _Bitmaps(bits), few
        held = [x[end:] for x in held]


def _trees(share: float):
    """Groups of rows to (a, b): a spanning forest of the pairs that bitmaps allow, links between texts of one root left out."""

    def run(batches):
        for n, sid, root, bits, _ in _groups(batches):
            aa, bb = [], []
            left = np.arange(len(n))
            while len(left):
                queue, left = [int(left[0])], left[1:]
                seen = {int(root[queue[0]])}
                while queue and len(left):
                    u = queue.pop()
                    near = (root[left] == root[u]) | bits.may_be(left, n, u, share)
                    for v in left[near].tolist():
                        queue.append(v)
                        if int(root[v]) not in seen:
                            seen.add(int(root[v]))
                            aa.append(min(sid[u], sid[v]))
                            bb.append(max(sid[u], sid[v]))
                    left = left[~near]
            if aa:
                yield pa.RecordBatch.from_arrays([pa.array(aa, pa.int64()), pa.array(bb, pa.int64())], names=["a", "b"])

    return run


def _apart(share: float):
    """Groups of rows to (a, b): all pairs of different roots that bitmaps allow, of a row that is ``few`` and any other."""

    def run(batches):
        for n, sid, root, bits, few in _groups(batches):
            aa, bb = [], []
            for k in np.flatnonzero(few).tolist():
                other = np.flatnonzero((root != root[k]) & (~few | (sid > sid[k])))
                other = other[bits.may_be(other, n, k, share)]
                aa += np.minimum(sid[other], sid[k]).tolist()
                bb += np.maximum(sid[other], sid[k]).tolist()
            if aa:
                yield pa.RecordBatch.from_arrays([pa.array(aa, pa.int64()), pa.array(bb, pa.int64())], names=["a", "b"])

    return run


def _and_end(batches):
    try:
        yield from batches
        yield None
    finally:
        release_memory()


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid")))


def _bitmaps(ids: DataFrame, sets: DataFrame, words: int) -> DataFrame:
    """(sid, n, bits): sizes and bitmaps of the sets with these ids, and of few others."""
    kind = T.StructType([T.StructField("n", T.LongType()), T.StructField("bits", T.BinaryType())])
    return _with(among(sets, ids.distinct(), "sid"), "p", kind, lambda h: {"n": len(h), "bits": bitmap(h)}, words, ["sid"]).select("sid", "p.n", "p.bits")


def _allowed(pairs: DataFrame, bits: DataFrame, share: float) -> DataFrame:
    """The pairs that bitmaps allow."""
    x, y = bits.select(F.col("sid").alias("a"), "n", F.col("bits").alias("x")), bits.select(F.col("sid").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y"))
    return pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "n", "x", "m", "y").mapInArrow(_pairs_left(share), "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, words: int, share: float) -> DataFrame:
    """The pairs whose whole sets are similar."""
    pairs = staged(pairs.select("a", "b"))
    # both joins read one exchange of these, so they need no files
    whole = _with(among(sets, _ends(pairs).distinct(), "sid"), "h", T.ArrayType(T.LongType()), lambda h: h.view(np.int64).tolist(), words, ["sid"])
    both = pairs.join(whole.select(F.col("sid").alias("a"), F.col("h").alias("x")), "a").join(whole.select(F.col("sid").alias("b"), F.col("h").alias("y")), "b")
    counts = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("both"), (F.size("x") + F.size("y")).alias("all"))
    out = staged(counts.where(F.col("both") >= share * (F.col("all") - F.col("both")) - 1e-9).select("a", "b"))
    drop_staged(pairs)
    return out


def close_links(sets: DataFrame, words: int = WORDS, share: float = SHARE, most: int = MOST_BITS) -> DataFrame:
    """Links (a, b) of similar sets whose fingerprints are equal or among the links of close ones."""
    prints = staged(with_fingerprint(sets, "__t", words, keep=["sid"]))
    first = staged(prints.groupBy("fp").agg(F.min("sid").alias("low")))
    same = prints.join(first, "fp").where("sid <> low").select(F.col("low").alias("a"), F.col("sid").alias("b"))
    near = near_links(first.select("fp"), most)
    ends = first.select(F.col("fp").alias("a"), F.col("low").alias("x")), first.select(F.col("fp").alias("b"), F.col("low").alias("y"))
    near = near.join(ends[0], "a").join(ends[1], "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return _verified(same.unionByName(near).distinct(), sets, words, share)


def similar_links(sets: DataFrame, words: int = WORDS, share: float = SHARE, cap: int = BUCKET, part: int = PART) -> DataFrame:
    """Links (a, b) whose components are those of all similar pairs of distinct sets (``sid``, text ``__t``)."""
    schema = "a long, b long, s long, n long, again boolean"
    close = close_links(sets, words, share)
    dealt = _prefixes(sets, words, share).select("s", "n", "sid", "place").repartition("s").sortWithinPartitions("s", "n", "sid")
    first = staged(dealt.mapInArrow(_pairs(share, cap), schema))
    again = first.where("again").select("s", "n", F.col("a").alias("sid"))
    few = first.where("not again").groupBy("a", "b").agg(F.count("*").alias("met"), F.max("s").alias("least"))
    # of a's shingles in large buckets each may be b's as well
    more = again.groupBy(F.col("sid").alias("a")).agg(F.count("*").alias("more"))
    few = staged(few.join(more, "a", "left").where("met + coalesce(more, 0) >= least").join(close, ["a", "b"], "left_anti").select("a", "b"))
    bits = staged(_bitmaps(_ends(few).unionByName(again.select("sid")), sets, words))
    links = close.unionByName(_verified(_allowed(few, bits, share), sets, words, share))
    if not again.isEmpty():
        links = _of_large_buckets(again, bits.select("sid", "bits"), sets, links, words, share, part)
    for table in (first, few, bits):
        drop_staged(table)
    return links


def _of_large_buckets(again: DataFrame, bits: DataFrame, sets: DataFrame, links: DataFrame, words: int, share: float, part: int) -> DataFrame:
    """``links`` with those that the large buckets (s, n, sid) add; ``bits`` are their sets' bitmaps."""
    sizes = staged(again.groupBy("s").agg(F.ceil(F.count("*") / part).cast("long").alias("parts")))
    most = sizes.agg(F.max("parts")).first()[0]

    def rooted():
        """Rows of buckets with more than one root; each row's root, and the root of most of its bucket's rows."""
        known = components(links).select(F.col("node").alias("sid"), "root")
        rows = again.join(known, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        roots = rows.groupBy("s", "root").agg(F.count("*").alias("n_root")).groupBy("s").agg(F.max(F.struct("n_root", "root")).alias("main"), F.count("*").alias("kinds"))
        return rows.join(roots.where("kinds > 1").select("s", F.col("main.root").alias("main")), "s").join(sizes, "s")

    def found(rows, key, few, of):
        # bitmaps are brought to the rows last, so that they are shuffled once
        cols = rows.select("sid", key.alias("key"), "n", "root", few.alias("few")).join(bits, "sid").select("key", "n", "sid", "root", "bits", "few")
        return cols.repartition("key").sortWithinPartitions("key").mapInArrow(of(share), "a long, b long").distinct().join(links, ["a", "b"], "left_anti")

    for k in range(ROUNDS if most > 1 else 1):
        key = F.xxhash64("s", F.pmod(F.xxhash64(F.lit(k), "sid"), F.col("parts")))
        links = links.unionByName(_verified(found(rooted(), key, F.lit(False), _trees), sets, words, share))
    # in each bucket, all but the texts of its largest root are compared with all: where there are parts, they go to each
    few = F.col("root") != F.col("main")
    own = F.array(F.pmod(F.xxhash64("sid"), F.col("parts")))
    spread = rooted().withColumn("part", F.explode(F.when(few, F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(own)))
    links = links.unionByName(_verified(found(spread, F.xxhash64("s", "part"), few, _apart), sets, words, share))
    drop_staged(sizes)
    return links


def one_of_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, share: float = SHARE, cap: int = BUCKET, part: int = PART) -> DataFrame:
    """All columns of one document of each component: that of the smallest id, null ids last, then of the smallest hash of all columns; of equal rows one stays."""
    names = [free_name(f"__{n}", docs.columns) for n in ("row", "row2", "sid")]
    every = [column(c) for c in docs.columns]
    own = docs.withColumn(names[0], F.xxhash64(*every)).withColumn(names[1], F.xxhash64(F.lit(1), *every))
    src = own.select(column(id_col).alias("id"), column(text_col).alias("__t"), column(names[0]).alias("row"), column(names[1]).alias("row2"))
    prints = _with(src, "sid", T.LongType(), _digest, words, ["id", "row", "row2"])
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "row", "row2")
    each = prints.groupBy("sid").agg(F.min(rank).alias("low"))
    low = staged(each)
    picked = low.select(F.col("low.row").alias(names[0]), F.col("low.row2").alias(names[1]), F.col("sid").alias(names[2]))
    held = own.join(picked, names[:2])
    once = F.row_number().over(Window.partitionBy(*map(column, names[:2])).orderBy(column(names[0])))
    place = free_name("__n", held.columns)
    kept = staged(held.withColumn(place, once).where(column(place) == 1).drop(place, *names[:2]))
    comps = staged(components(similar_links(kept.select(column(names[2]).alias("sid"), column(text_col).alias("__t")), words, share, cap, part)))
    ranked = comps.join(low, comps.node == low.sid).select("root", "sid", "low")
    firsts = ranked.groupBy("root").agg(F.min("low").alias("first"))
    gone = staged(ranked.join(firsts, "root").where("low <> first").select(F.col("sid").alias(names[2])))
    may_go, rest = parted(kept, gone, names[2])
    left = may_go.join(gone, names[2], "left_anti")
    return (left if rest is None else left.unionByName(rest)).select(*every)
