"""A stored index: snapshots with a manifest written last, changes by artifact, searches that read their terms' files.

Below the index's folder, ``segments/<id>/`` has the tables of one change, and ``manifests/`` one small file for each version: the list of
its segments, oldest first, and the statistics of what is live. A change writes its segment and then its manifest under the next number,
so that a reader sees all of it or nothing, and one that holds a snapshot goes on reading that version. A segment replaces
the artifacts that it names in all segments before it; nothing is rewritten until ``compact``.

Postings lie in blocks of at most BLOCK documents of one term, heaviest first, with the block's greatest and least values beside the lists, and are
partitioned by a hash bucket of the term and by how far down its list a block is. A search reads only its terms' buckets; it bounds each block's share of a score, finds
a score that k documents have at least, and then reads no lists of blocks, and no files, that can't reach it. What is left holds every posting
of every document among the first k, so results are exact.
"""

from __future__ import annotations

import functools
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmere.functions.sizes import maybe_broadcast
from quillmere.functions.tables import staged
from quillmere.operators import dense as de
from quillmere.operators import sparse as sp
from quillmere.params import Bm25Params

BLOCK, BUCKETS = 128, 64
#: Documents of a shard: a term's list is ranked within each, so that no term is gathered in one task.
SHARD = 1 << 20
#: Tiers of blocks: the first of a list, the next two, the next four and so on, the rest.
TIERS = 4
#: Scores are rounded to six digits, so what is this close may be equal.
SLACK = 2e-6
_STATS = ["max_tf", "min_tf", "max_dl", "min_dl", "max_w", "min_w", "n"]


class _Files:
    """Small files through Hadoop's file systems, which every store that Spark reads has."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        p = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> None:
        """Whole or not at all; fails if the file is there."""
        part = f"manifests/.{uuid.uuid4().hex}"
        stream = self.fs.create(self._path(part), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self.fs.exists(self._path(name)) or not self.fs.rename(self._path(part), self._path(name)):
            self.fs.delete(self._path(part), False)
            raise RuntimeError(f"{name} was written by another change")

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _weight(p: Bm25Params, tf: Column, dl: Column, w: Column, avgdl: float) -> Column:
    return sp.weight(tf, dl, F.lit(max(avgdl, 1e-9)), p) * w


class Snapshot:
    """One version of an index; what it reads doesn't change."""

    def __init__(self, store: "IndexStore", manifest: dict):
        self.store, self.manifest = store, manifest
        self.version, self.n_docs = manifest["version"], manifest["n_docs"]
        self.avgdl = manifest["total_dl"] / self.n_docs if self.n_docs else 0.0
        #: Partitions of postings that the last search read, of all there are in its buckets.
        self.read_partitions: tuple[int, int] | None = None

    def _table(self, segment: dict, name: str) -> DataFrame:
        return self.store.spark.read.parquet(f"{self.store.path}/segments/{segment['id']}/{name}")

    def _replaced(self, k: int) -> DataFrame | None:
        """Artifacts of segment k that later ones replace; None if there are none."""
        later = [self._table(s, "artifacts") for s in self.manifest["segments"][k + 1 :] if s["replaces"]]
        return functools.reduce(DataFrame.unionByName, later).distinct() if later else None

    def docs(self) -> DataFrame | None:
        """Live rows, all columns; None if nothing was ever stored."""
        parts = []
        for k, s in enumerate(self.manifest["segments"]):
            if s["rows"]:
                gone, rows = self._replaced(k), self._table(s, "docs")
                parts.append(rows if gone is None else rows.join(gone, "artifact", "left_anti"))
        return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None

    def dense_topk(self, queries: DataFrame, k: int, id_col: str = "query", vec_col: str = "vector") -> DataFrame:
        """Cosine search of the live rows' vectors."""
        rows = self.docs()
        return de.dense_topk(rows.select("doc", "vector"), queries.select(F.col(id_col).alias("doc"), F.col(vec_col).alias("vector")), k, "doc", "vector")

    def search(self, queries: DataFrame, k: int, query_id: str = "query_id", query_text: str = "query") -> DataFrame:
        """BM25 by the snapshot's statistics: (query, doc, score, matched, rank)."""
        p, buckets = self.store.p, self.manifest["buckets"]
        asked = staged(sp.query_terms(queries, query_id, query_text).withColumn("bucket", _bucket(F.col("term"), buckets)))
        wanted = sorted(r["bucket"] for r in asked.select("bucket").distinct().collect())  # no more than there are buckets
        terms = asked.select("bucket", "term").distinct()
        live = [(i, s) for i, s in enumerate(self.manifest["segments"]) if s["rows"]]
        if not live:
            kind = queries.schema[query_id].dataType.simpleString()
            return queries.sparkSession.createDataFrame([], f"query {kind}, doc {kind}, score double, matched array<string>, rank int")

        def blocks(i, s):
            rows = self._table(s, "postings").where(F.col("bucket").isin(wanted)).withColumn("segment", F.lit(i))
            return rows.join(maybe_broadcast(terms, queries), ["bucket", "term"], "left_semi")

        clean = {i for i, _ in live if self._replaced(i) is None}
        heads = functools.reduce(DataFrame.unionByName, [blocks(i, s).select("segment", "bucket", "tier", "term", "shard", "block", *_STATS) for i, s in live])
        heads = staged(heads.withColumn("whole", F.col("segment").isin(sorted(clean))))
        counts = heads.where("whole").groupBy("term").agg(F.sum("n").alias("df"))
        dirty = [(i, s) for i, s in live if i not in clean]
        if dirty:  # of lists with replaced documents the live ones are counted
            own = [self._postings(blocks(i, s), i).groupBy("term").agg(F.count("*").alias("df")) for i, s in dirty]
            counts = functools.reduce(DataFrame.unionByName, [counts, *own]).groupBy("term").agg(F.sum("df").alias("df"))
        asked = staged(asked.join(counts, "term").select("query", "term", "bucket", (sp.idf(F.lit(self.n_docs), F.col("df")) * F.col("qtf")).alias("qw")))
        # each block's share of a score at the most, and one that so many documents have at least
        most = _weight(p, F.col("max_tf"), F.col("min_dl"), F.col("max_w"), self.avgdl)
        least = F.when(F.col("whole") & (F.col("n") >= k), _weight(p, F.col("min_tf"), F.col("max_dl"), F.col("min_w"), self.avgdl))
        bounds = heads.select("*", most.alias("most"), least.alias("least"))
        by_term = bounds.groupBy("term").agg(F.max("most").alias("most"), F.max("least").alias("least"))
        bars = asked.join(by_term, "term").groupBy("query").agg(F.sum(F.col("qw") * F.col("most")).alias("all"), F.max(F.col("qw") * F.col("least")).alias("bar"))
        tops = asked.join(by_term.select("term", F.col("most").alias("top")), "term").join(bars, "query")
        # what a block must give so that some query can still reach its bar
        needs = tops.groupBy("term").agg(F.min((F.coalesce("bar", F.lit(0.0)) - SLACK - (F.col("all") - F.col("qw") * F.col("top"))) / F.col("qw")).alias("need"))
        kept = staged(bounds.join(needs, "term").where("most >= need").select("segment", "bucket", "tier", "term", "shard", "block"))
        parts = [(r["segment"], r["bucket"], r["tier"]) for r in kept.select("segment", "bucket", "tier").distinct().collect()]  # bounded by segments, buckets and tiers
        self.read_partitions = (len(parts), heads.select("segment", "bucket", "tier").distinct().count())
        hits = []
        for i, s in live:
            mine = [(b, t) for j, b, t in parts if j == i]
            if mine:
                there = functools.reduce(Column.__or__, [(F.col("tier") == t) & F.col("bucket").isin([b for b, u in mine if u == t]) for t in sorted({t for _, t in mine})])
                rows = self._table(s, "postings").where(there).join(kept.where(F.col("segment") == i).drop("segment"), ["bucket", "tier", "term", "shard", "block"], "left_semi")
                hits.append(self._postings(rows, i))
        if not hits:
            return self.docs().select(F.lit(None).cast(asked.schema["query"].dataType).alias("query"), "doc", F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("matched"), F.lit(0).alias("rank")).where("false")
        scored = functools.reduce(DataFrame.unionByName, hits).join(maybe_broadcast(asked.drop("bucket"), queries), "term")
        value = F.round(F.sum(F.col("qw") * _weight(p, F.col("tf"), F.col("dl"), F.col("w"), self.avgdl)), 6)
        found = scored.groupBy("query", "doc").agg(value.alias("score"), F.sort_array(F.collect_list("term")).alias("matched")).where("score > 0")
        return sp.top_k(found, k, F.desc("score"), F.asc("doc"))

    def _postings(self, blocks: DataFrame, k: int) -> DataFrame:
        """(term, doc, tf, dl, w) of the live documents in blocks of segment k."""
        rows = blocks.select("term", F.inline("list"))
        gone = self._replaced(k)
        if gone is None:
            return rows
        return rows.join(self._table(self.manifest["segments"][k], "docs").join(gone, "artifact", "left_semi").select("doc"), "doc", "left_anti").select("term", "doc", "tf", "dl", "w")


class IndexStore:
    """An index below ``path``. One writer at a time succeeds: a change that finds its version's manifest there fails and leaves no trace in any snapshot."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, p: Bm25Params = Bm25Params(), dim: int | None = None):
        self.spark, self.path, self.buckets, self.p, self.dim = spark, path.rstrip("/"), buckets, p, dim
        self.files = _Files(spark, path)

    def versions(self) -> list[int]:
        return [int(n[1:9]) for n in self.files.names("manifests") if n.startswith("v")]

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The version, or the last one; an index without any is empty."""
        there = self.versions()
        if version is None and not there:
            return Snapshot(self, {"version": 0, "segments": [], "n_docs": 0, "total_dl": 0, "buckets": self.buckets})
        return Snapshot(self, json.loads(self.files.read(f"manifests/v{version or there[-1]:08d}.json")))

    def rebuild(self, rows: DataFrame) -> Snapshot:
        """``rows`` in place of all there is: doc, artifact, text, and optionally weight, vector and others. An id that is there twice, or a vector of another length than ``dim``, fails."""
        last = self.snapshot()
        return self._commit(last, [self._segment(rows, None)])

    def upsert(self, rows: DataFrame) -> Snapshot:
        """``rows`` in place of all that their artifacts had."""
        last = self.snapshot()
        return self._commit(last, [*last.manifest["segments"], self._segment(rows, rows.select("artifact").distinct())])

    def delete(self, artifacts: DataFrame) -> Snapshot:
        """Without these artifacts (column artifact)."""
        last = self.snapshot()
        return self._commit(last, [*last.manifest["segments"], self._segment(None, artifacts.select("artifact").distinct())])

    def compact(self) -> Snapshot:
        """The same rows in one segment."""
        last = self.snapshot()
        rows = last.docs()
        return last if rows is None else self._commit(last, [self._segment(rows.drop("dl"), None)])

    def vacuum(self, keep: int = 1) -> list[str]:
        """Removes all but the last ``keep`` versions and the segments that none of these has, such as of changes that failed; no change may be under way. Returns the removed segments."""
        there = self.versions()
        for v in there[:-keep]:
            self.files.delete(f"manifests/v{v:08d}.json")
        used = {s["id"] for v in there[-keep:] for s in self.snapshot(v).manifest["segments"]}
        old = [n for n in self.files.names("segments") if n not in used]
        for name in old:
            self.files.delete(f"segments/{name}")
        return old

    def _segment(self, rows: DataFrame | None, artifacts: DataFrame | None) -> dict:
        name = uuid.uuid4().hex
        root = f"{self.path}/segments/{name}"
        if artifacts is not None:
            artifacts.write.parquet(f"{root}/artifacts")
        if rows is not None:
            self._write_rows(rows, root)
        return {"id": name, "replaces": artifacts is not None, "rows": rows is not None}

    def _write_rows(self, rows: DataFrame, root: str) -> None:
        if self.dim is not None and "vector" in rows.columns:
            rows = rows.withColumn("vector", F.when(F.size("vector") != self.dim, F.raise_error(F.lit("wrong vector length"))).otherwise(F.col("vector")))
        weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in rows.columns else F.lit(1.0)
        termed = sp.with_counts(rows, "doc", "text").select("doc", "dl")
        copies = rows.groupBy("doc").agg(F.count("*").alias("__n"))
        whole = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("repeated id "), F.col("doc").cast("string")))).otherwise(F.col("artifact"))
        rows.join(copies, "doc").withColumn("artifact", whole.cast(rows.schema["artifact"].dataType)).drop("__n").join(termed, "doc").write.parquet(f"{root}/docs")
        docs = self.spark.read.parquet(f"{root}/docs")
        shards = docs.count() // SHARD + 1
        terms = sp.term_frequencies(sp.with_counts(docs, "doc", "text")).join(docs.select("doc", weight.alias("w")), "doc")
        dealt = terms.withColumn("shard", F.pmod(F.xxhash64("doc"), F.lit(shards)).cast("int")).withColumn("bucket", _bucket(F.col("term"), self.buckets))
        average = docs.agg(F.avg("dl")).first()[0] or 1.0
        heavy = _weight(self.p, F.col("tf"), F.col("dl"), F.col("w"), average)
        place = F.row_number().over(Window.partitionBy("bucket", "shard", "term").orderBy(heavy.desc(), "doc")) - 1
        numbered = dealt.withColumn("block", F.floor(place / BLOCK).cast("int")).withColumn("tier", F.least(F.lit(TIERS - 1), F.floor(F.log2(F.col("block") + 1))).cast("int"))
        ends = [f(c).alias(f"{n}_{c}") for c in ("tf", "dl", "w") for n, f in (("max", F.max), ("min", F.min))]
        blocks = numbered.groupBy("bucket", "shard", "tier", "term", "block").agg(*ends, F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("doc", "tf", "dl", "w"))).alias("list"))
        # a file for each bucket, shard and tier, in it terms in order
        blocks.repartition("bucket", "shard").sortWithinPartitions("bucket", "tier", "term", "block").write.partitionBy("bucket", "tier").parquet(f"{root}/postings")

    def _commit(self, last: Snapshot, segments: list[dict]) -> Snapshot:
        manifest = {"version": last.version + 1, "segments": segments, "n_docs": 0, "total_dl": 0, "buckets": self.buckets}
        rows = Snapshot(self, manifest).docs()
        if rows is not None:
            n, total = rows.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
            manifest |= {"n_docs": n, "total_dl": total}
        self.files.write_new(f"manifests/v{manifest['version']:08d}.json", json.dumps(manifest))
        return Snapshot(self, manifest)
