"""Retrieval evaluation: gold lookup, metrics, aggregates, abstention, score gaps, qrels checks.

Metrics of queries without gold are null and leave the means' denominators.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmere.functions.ranges import with_sums_below
from quillmere.functions.sizes import small

KS = (5, 10, 20)
# Categories and splits of a qrels table.
CATEGORIES = ["exact", "semantic", "mixed", "multi_hop", "unanswerable"]
SPLITS = ["dev", "test"]
#: What each stage is made from.
STAGE_NEEDS = {"dense": (), "sparse": (), "union": ("dense", "sparse"), "rrf": ("dense", "sparse"), "rerank": ("rrf",)}


def required_stages(stages) -> set[str]:
    """Stages and all they are made from."""
    need, todo = set(), list(stages)
    while todo:
        s = todo.pop()
        if s not in STAGE_NEEDS:
            raise ValueError(f"unknown stage {s!r}")
        if s not in need:
            need.add(s)
            todo += STAGE_NEEDS[s]
    return need


#: Characters of a piece by which words are looked up.
PIECE = 8


def _words_with(words: DataFrame, heads: DataFrame) -> DataFrame:
    """(needle, key) of words (key) that are, begin or end with, or hold a head (needle, head, kind): joined by pieces of at most PIECE characters, then verified."""
    size = F.least(F.length("head"), F.lit(PIECE))
    piece = F.when(F.col("kind") == "whole", F.col("head")).when(F.col("kind") == "suffix", F.right("head", size)).otherwise(F.left("head", size))
    asked = heads.withColumn("n", F.when(F.col("kind") != "whole", size)).withColumn("piece", piece)
    out = [words.select("key", F.lit("whole").alias("kind"), F.col("key").alias("piece"))]
    for kind, n in asked.where("n is not null").select("kind", "n").distinct().collect():  # three kinds of up to PIECE lengths
        fit = words.where(F.length("key") >= n)
        each = {"prefix": F.left("key", F.lit(n)), "suffix": F.right("key", F.lit(n)), "inner": F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("key") - n + 1), lambda i: F.substring(F.col("key"), i, F.lit(n)))))}[kind]
        out.append(fit.select("key", F.lit(kind).alias("kind"), each.alias("piece")))
    fits = F.when(F.col("kind") == "prefix", F.startswith("key", "head")).when(F.col("kind") == "suffix", F.endswith("key", "head")).otherwise(F.contains("key", "head"))
    return functools.reduce(DataFrame.unionByName, out).join(asked, ["kind", "piece"]).where(fits).select("needle", "key").distinct()


def _in_place(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(needle, doc) for a small table of needles (needle, needle_text, key): they go to the tasks, and each text's own words tell which of them it is searched for."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    by_key: dict[str, list[tuple]] = {}
    for r in needles.select("needle", "needle_text", "key").toLocalIterator():
        by_key.setdefault(r["key"], []).append((r["needle"], r["needle_text"]))
    shared = needles.sparkSession.sparkContext.broadcast(by_key)
    kind = to_arrow_type(needles.schema["needle"].dataType)

    def run(batches):
        held = shared.value
        keys = frozenset(held)
        for b in batches:
            found, rows = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for key in keys.intersection(t.replace("\n", " ").replace("\t", " ").split(" ")) if t else ():
                    some = [n for n, text in held[key] if text in t]
                    found += some
                    rows += [i] * len(some)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(found, kind), b.column(0).take(pa.array(rows, pa.int64()))], names=["needle", "doc"])

    return texts.select("doc", "text").mapInArrow(run, T.StructType([needles.schema["needle"], texts.schema["doc"]]))


def find_contained(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(needle, doc) where a needle (needle, needle_text) is a substring of a text (doc, text).

    A needle without a word is found nowhere. Each other is looked up by its longest inner word, which any text that holds the needle has
    as a whole word too. A needle of one or two words has no inner word: the distinct words of all texts that hold it, or
    end as its first word does, are found, and texts are looked up by those. Either way ids are joined by equal words first, and
    texts are brought back once, to verify the pairs; but needles of a small table that have an inner word are looked for where the texts are.
    """
    word = r"[^ \n\t]+"
    needles = needles.where("length(needle_text) > 0")
    keyed = needles.withColumn("ws", F.regexp_extract_all("needle_text", F.lit(word), F.lit(0)))
    inner = F.slice("ws", 2, F.greatest(F.size("ws") - 2, F.lit(0)))
    key = F.element_at(F.array_sort(F.transform(inner, lambda w: F.struct(-F.length(w), w.alias("w")))), 1)["w"]
    placed = None
    if small(needles):
        placed = _in_place(keyed.where("size(ws) > 2").withColumn("key", key), texts)
        keyed = keyed.where("size(ws) < 3")
        if keyed.where("size(ws) > 0").isEmpty():
            return placed
    words = texts.select("doc", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(word), F.lit(0)))).alias("key"))
    pairs = words.join(keyed.where("size(ws) > 2").select("needle", key.alias("key")), "key").select("needle", "doc")
    led = F.expr("not startswith(needle_text, ws[0])")
    kind = F.when(led & (F.size("ws") == 1), "prefix").when(led, "whole").when(F.size("ws") == 1, "inner").otherwise("suffix")
    short = keyed.where("size(ws) between 1 and 2").select("needle", F.element_at("ws", 1).alias("head"), kind.alias("kind"))
    some = _words_with(words.select("key").distinct(), short)
    pairs = pairs.unionByName(words.join(some, "key").select("needle", "doc")).distinct()
    both = pairs.join(needles.select("needle", "needle_text"), "needle").join(texts.select("doc", "text"), "doc")
    looked_up = both.where(F.contains("text", "needle_text")).select("needle", "doc")
    return looked_up if placed is None else placed.unionByName(looked_up)


def query_scores(hits: DataFrame, gold: DataFrame, queries: DataFrame, ks=KS) -> DataFrame:
    """Per stage and query: hit, recall, mrr, ndcg at each k and precision at the first.

    ``hits`` (stage, query, doc, rank), ``gold`` (query, doc), ``queries`` (query): every pair of a stage and
    a query has a row, with zeros where nothing was returned.
    """
    pairs = hits.select("stage").distinct().crossJoin(queries.select("query").distinct())
    sizes = gold.distinct().groupBy("query").agg(F.count("*").alias("gold_size"))
    marked = hits.join(gold.distinct().withColumn("is_gold", F.lit(True)), ["query", "doc"], "left").withColumn("is_gold", F.coalesce("is_gold", F.lit(False)))
    aggs = []
    for k in ks:
        inside = F.col("is_gold") & (F.col("rank") <= k)
        aggs += [
            F.count_if(inside).alias(f"n_{k}"),
            F.min(F.when(inside, F.col("rank"))).alias(f"first_{k}"),
            F.sum(F.when(inside, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias(f"dcg_{k}"),
        ]
    aggs.append(F.count_if(F.col("rank") <= ks[0]).alias("returned"))
    per = pairs.join(marked.groupBy("stage", "query").agg(*aggs), ["stage", "query"], "left").join(sizes, "query", "left")
    has = F.col("gold_size") > 0
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = []
    for k in ks:
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("gold_size"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + 1.0 / F.log2(r + 1.0))
        out += [
            F.when(has, (zero(f"n_{k}") > 0).cast("double")).alias(f"hit_{k}"),
            F.when(has, F.round(zero(f"n_{k}") / F.col("gold_size"), 6)).alias(f"recall_{k}"),
            F.when(has, F.round(F.coalesce(1.0 / F.col(f"first_{k}"), F.lit(0.0)), 6)).alias(f"mrr_{k}"),
            F.when(has, F.round(F.coalesce(f"dcg_{k}", F.lit(0.0)) / ideal, 6)).alias(f"ndcg_{k}"),
        ]
    precision = F.when(zero("returned") == 0, 0.0).otherwise(zero(f"n_{ks[0]}") / F.col("returned"))
    out.append(F.when(has, F.round(precision, 6)).alias(f"precision_{ks[0]}"))
    return per.select("stage", "query", F.coalesce("gold_size", F.lit(0)).cast("long").alias("gold_size"), *out)


def metric_names(ks=KS) -> list[str]:
    return [f"{m}_{k}" for k in ks for m in ("hit", "recall", "mrr", "ndcg")] + [f"precision_{ks[0]}"]


def summarize_scores(scores: DataFrame, ks=KS) -> DataFrame:
    """Means (four places, 0 if all null) and counts by stage, and by stage and category; ``level`` tells which."""
    aggs = [x for m in metric_names(ks) for x in (F.coalesce(F.round(F.avg(m), 4), F.lit(0.0)).alias(m), F.count(m).alias(f"{m}_n"))]
    out = scores.groupingSets([["stage"], ["stage", "category"]], "stage", "category").agg(F.grouping("category").cast("int").alias("level"), *aggs)
    return out.withColumn("level", F.when(F.col("level") == 1, "stage").otherwise("category"))


def distribution(df: DataFrame, value: str, group: str) -> DataFrame:
    """Per group n, min, p25, p50, p75 and max, each the value at place min(floor(n p), n - 1) of the sorted ones; values are counted first."""
    counts = df.where(F.col(value).isNotNull()).groupBy(group, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("m"))
    sizes = counts.groupBy(group).agg(F.sum("m").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"))
    ranked = with_sums_below(counts, "v", ["m"], [group]).join(sizes.select(group, "n"), group)

    def pick(p):
        at = F.least(F.floor(F.col("n") * p), F.col("n") - 1)
        return F.max(F.when((F.col("m_below") <= at) & (at < F.col("m_below") + F.col("m")), F.col("v")))

    mid = ranked.groupBy(group).agg(pick(0.25).alias("p25"), pick(0.5).alias("p50"), pick(0.75).alias("p75"))
    return sizes.join(mid, group).select(group, F.col("n").cast("long").alias("n"), "min", "p25", "p50", "p75", "max")


def abstention_sweep(rows: DataFrame) -> DataFrame:
    """For each score as a threshold, unanswerable queries below it (caught) and others (wrong). ``rows`` (answerable, score)."""
    counts = rows.where("score is not null").groupBy("score").agg(F.count_if(~F.col("answerable")).alias("neg"), F.count_if("answerable").alias("pos"))
    below = with_sums_below(counts, "score", ["neg", "pos"])
    return below.select(F.col("score").alias("threshold"), F.col("neg_below").cast("long").alias("caught"), F.col("pos_below").cast("long").alias("wrong"))


def abstention_best(rows: DataFrame) -> DataFrame:
    """One row: the threshold that refuses most without a wrong refusal (the higher of equal ones), and whether classes are apart."""
    best = abstention_sweep(rows).where("wrong = 0").agg(F.max(F.struct("caught", "threshold")).alias("b"))
    ends = rows.agg(F.min(F.when(F.col("answerable"), F.col("score"))).alias("lo"), F.max(F.when(~F.col("answerable"), F.col("score"))).alias("hi"))
    both = best.crossJoin(ends).where("lo is not null and hi is not null")
    return both.select("b.threshold", "b.caught", (F.col("lo") > F.col("hi")).alias("separable"))


def gap_split(rows: DataFrame) -> DataFrame:
    """One row: hit rate of the lower floor(n/2) gaps and of the rest; none with under six rows. ``rows`` (query, gap, hit)."""
    ok = rows.where("gap is not null and hit is not null")
    counts = ok.groupBy("gap").agg(F.count("*").alias("m"))
    n = ok.agg(F.count("*").alias("n"))
    tied = F.row_number().over(Window.partitionBy("gap").orderBy("query"))
    ranked = ok.join(with_sums_below(counts, "gap", ["m"]), "gap").withColumn("at", F.col("m_below") + tied).crossJoin(F.broadcast(n))
    low = F.col("at") <= F.floor(F.col("n") / 2)
    rate = lambda c: F.round(F.avg(F.when(c, F.col("hit"))), 4)
    out = ranked.agg(
        F.max("n").cast("long").alias("n"), F.count_if(low).alias("low_n"), rate(low).alias("low_hit"), F.round(F.max(F.when(low, F.col("gap"))), 4).alias("low_gap_max"),
        F.count_if(~low).alias("high_n"), rate(~low).alias("high_hit"), F.round(F.min(F.when(~low, F.col("gap"))), 4).alias("high_gap_min"),
        F.round(F.avg(F.when(~low, F.col("hit"))) - F.avg(F.when(low, F.col("hit"))), 4).alias("delta"),
    )
    return out.where("n >= 6")


def qrels_violations(qrels: DataFrame) -> DataFrame:
    """(query_id, problem) of each rule that a row breaks; gold is an array of structs with ``text``."""
    n = F.coalesce(F.size("gold"), F.lit(0))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    twice = F.count("*").over(Window.partitionBy("query_id")) > 1
    rules = [
        (blank("query_id"), "empty id"), (blank("query"), "empty query"), (~F.col("category").isin(CATEGORIES), "unknown category"), (~F.col("split").isin(SPLITS), "unknown split"),
        ((F.col("category") == "unanswerable") & (n > 0), "unanswerable with gold"), ((F.col("category") != "unanswerable") & (n == 0), "no gold"),
        (F.exists("gold", lambda g: F.length(F.coalesce(F.trim(g["text"]), F.lit(""))) < 8), "short gold"), (F.col("twice"), "repeated id"),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in rules]))
    return qrels.withColumn("twice", twice).select("query_id", F.explode(found).alias("problem"))


def qrels_summary(qrels: DataFrame) -> DataFrame:
    """Counts by category, split and language, as (dimension, value, n)."""
    dims = ["category", "split", "query_lang"]
    return qrels.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dims])).alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))


def not_in_pools(fused: DataFrame, dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """Fused hits that neither channel returned: must be empty."""
    return fused.join(dense.select("query", "doc").unionByName(sparse.select("query", "doc")), ["query", "doc"], "left_anti")


def fingerprint(df: DataFrame, *cols: str) -> DataFrame:
    """One row: row count and an order-free sum of MD5 prefixes of the columns."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    return df.agg(F.count("*").alias("n_rows"), F.sum(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")).alias("digest"))


def corpus_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, old, new, change) of keys in either table: added, removed, changed or same."""
    o, n = old.select(F.col(key), F.col(value).alias("old")), new.select(F.col(key), F.col(value).alias("new"))
    both = o.withColumn("in_old", F.lit(1)).join(n.withColumn("in_new", F.lit(1)), key, "full_outer")
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("changed")
    return both.select(key, "old", "new", change.alias("change"))


def best_purity(hits: DataFrame, wanted: Column) -> DataFrame:
    """Per query: whether the first hit and the first five are wanted, reciprocal rank, and the share that is wanted."""
    ok = wanted.cast("double")
    return hits.groupBy("query").agg(
        F.max(F.when(F.col("rank") == 1, ok)).alias("top1"), F.max(F.when(F.col("rank") <= 5, ok)).alias("top5"),
        F.round(F.coalesce(1.0 / F.min(F.when(wanted, F.col("rank"))), F.lit(0.0)), 6).alias("rr"), F.round(F.avg(ok), 6).alias("purity"),
    )
