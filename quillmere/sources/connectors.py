"""Calls to outside services as partition functions: batching, pacing, retries, errors as data, deduplication, stored results.

A client is made once per task by a factory and has one method, ``call(list of inputs) -> list of outputs``. What services there
are (embeddings, rerankers, chat, translation, fetching) is the caller's choice; none is bundled.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.functions.tables import staged


class RateLimited(Exception):
    """The service asks to wait; ``after`` seconds if it said how long."""

    def __init__(self, after: float | None = None):
        super().__init__(f"rate limited, after={after}")
        self.after = after


@dataclass(frozen=True)
class CallPolicy:
    batch: int = 20
    attempts: int = 5
    first_wait: float = 1.0
    longest_wait: float = 60.0
    per_minute: float | None = None  # calls of one task, or of all where ``callers`` is set
    callers: int | None = None  # tasks that call at once, however large the cluster is


def paced(call: Callable[[list], list], policy: CallPolicy, sleep=time.sleep, clock=time.monotonic) -> Callable[[list], list]:
    """``call`` with a least time between calls, and retries that wait as told or twice as long each time."""
    gap = 60.0 / policy.per_minute if policy.per_minute else 0.0
    last = [-1e18]

    def run(items: list) -> list:
        wait = policy.first_wait
        for attempt in range(policy.attempts):
            rest = last[0] + gap - clock()
            if rest > 0:
                sleep(rest)
            last[0] = clock()
            try:
                return call(items)
            except RateLimited as e:
                if attempt + 1 == policy.attempts:
                    raise
                sleep(min(e.after if e.after is not None else wait, policy.longest_wait))
                wait = min(2 * wait, policy.longest_wait)
        raise AssertionError("not reached")

    return run


def _called(values: DataFrame, out_type: str, factory: Callable[[], object], policy: CallPolicy) -> DataFrame:
    """(v, r, e) of distinct values (v): results, or null and the error's text."""
    if policy.callers:  # so many partitions, each with its share of the rate
        values = values.repartition(policy.callers)
        policy = replace(policy, per_minute=policy.per_minute / policy.callers if policy.per_minute else None)

    def run(batches):
        client = factory()
        call = paced(client.call, policy)
        for pdf in batches:
            values = pdf["v"].tolist()
            results: list = []
            errors: list = []
            for k in range(0, len(values), policy.batch):
                part = values[k : k + policy.batch]
                try:
                    got = call(part)
                    if len(got) != len(part):
                        raise ValueError("another number of results")
                    results += list(got)
                    errors += [None] * len(part)
                except Exception:
                    for v in part:
                        try:
                            results += list(call([v]))[:1]
                            errors.append(None)
                        except Exception as e:
                            results.append(None)
                            errors.append(str(e)[:200])
            yield pd.DataFrame({"v": pdf["v"], "r": pd.Series(results, index=pdf.index, dtype=object), "e": pd.Series(errors, index=pdf.index, dtype=object)})

    return values.select("v").mapInPandas(run, f"v {values.schema['v'].dataType.simpleString()}, r {out_type}, e string")


def call_each(df: DataFrame, column: str, out: str, out_type: str, factory: Callable[[], object], policy: CallPolicy = CallPolicy()) -> DataFrame:
    """Adds ``out`` and ``out_error`` for each distinct value of ``column``; equal values are called once.

    A batch that comes back with another length is called again item by item; an item that fails has its error's
    text and a null. Null values are not called.
    """
    distinct = df.select(F.col(column).alias("v")).where("v is not null").distinct()
    done = _called(distinct, out_type, factory, policy)
    return df.join(done, df[column] == done["v"], "left").drop("v").withColumnRenamed("r", out).withColumnRenamed("e", f"{out}_error")


def call_cached(
    df: DataFrame, column: str, out: str, out_type: str, factory: Callable[[], object], path: str, scope: str = "", policy: CallPolicy = CallPolicy(), commit_every: int = 100_000,
) -> DataFrame:
    """As ``call_each``, with results kept below ``path``: what is there for ``scope`` (model, version, target language) and a value is not called again.

    Values that are missing are found by an anti join and called in rounds of about ``commit_every``; each round's results are appended before the next begins, so a run that dies
    loses one round at most. Errors are not kept, so they are called again the next time.
    """
    spark = df.sparkSession
    key = lambda v: F.sha2(F.concat(F.lit(scope + "\x00"), v.cast("string")), 256)
    kept = f"k string, r {out_type}"
    there = spark._jvm.org.apache.hadoop.fs.Path(path)

    def known() -> DataFrame:
        # two runs at once may both have called a value
        if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
            return spark.createDataFrame([], kept)
        return spark.read.schema(kept).parquet(path).dropDuplicates(["k"])

    values = df.select(F.col(column).alias("v")).where("v is not null").distinct().withColumn("k", key(F.col("v")))
    missing = staged(values.join(known(), "k", "left_anti"))
    rounds = -(-missing.count() // commit_every)
    failed = spark.createDataFrame([], "k string, e string")
    for i in range(rounds):
        part = missing.where(F.pmod(F.xxhash64("k"), F.lit(rounds)) == i)
        got = staged(_called(part, out_type, factory, policy).select(key(F.col("v")).alias("k"), "r", "e"))
        got.where("e is null").select("k", "r").write.mode("append").parquet(path)
        failed = failed.unionByName(got.where("e is not null").select("k", "e"))
    results = known().select("k", F.col("r").alias(out)).join(failed.withColumnRenamed("e", f"{out}_error"), "k", "full")
    asked = df.withColumn("__k", key(F.col(column)))
    return asked.join(results, asked["__k"] == results["k"], "left").drop("__k", "k")


def allowed_hops(hops: Column) -> Column:
    """Whether every address of a redirect chain may be fetched (see readers.host_problem); an empty chain may not."""
    from quillmere.sources.readers import host_problem

    return F.when(F.size(hops) < 1, False).otherwise(F.forall(hops, lambda u: host_problem(u).isNull()))
