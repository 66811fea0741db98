"""Run records around an evaluation: gold slices, manifests, comparison of two corpora, qrels output, Markdown reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.operators.evaluate import find_contained, fingerprint


def slice_span(text: Column, start: Column, end: Column, low: int = 40, high: int = 220) -> Column:
    """The part from a start marker to an end marker's end; null unless both are there once, in order, and the length is right."""
    once = (F.size(F.split(text, F.concat(F.lit("\\Q"), start, F.lit("\\E")), -1)) == 2) & (F.size(F.split(text, F.concat(F.lit("\\Q"), end, F.lit("\\E")), -1)) == 2)
    a, b = F.position(start, text), F.position(end, text)
    n = b + F.length(end) - a
    return F.when(once & (b >= a) & (n >= low) & (n <= high), F.substring(text, a, n))


def manifest(config: dict[str, object], tables: dict[str, DataFrame], keys: dict[str, list[str]]) -> DataFrame:
    """(name, value) rows: the configuration, and each table's row count and order-free fingerprint."""
    spark = next(iter(tables.values())).sparkSession
    out = spark.createDataFrame([(k, str(v)) for k, v in sorted(config.items())] or [("config", "none")], "name string, value string")
    for name, df in tables.items():
        mark = fingerprint(df, *keys[name]).select(F.lit(name).alias("name"), F.concat_ws(":", F.col("n_rows").cast("string"), F.col("digest").cast("string")).alias("value"))
        out = out.unionByName(mark)
    return out


def gold_changes(needles: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """(needle, in_old, in_new): in how many texts of each corpus a gold passage is found."""
    count = lambda t, c: find_contained(needles, t).groupBy("needle").agg(F.count("*").alias(c))
    rows = needles.select("needle").join(count(old, "in_old"), "needle", "left").join(count(new, "in_new"), "needle", "left")
    return rows.fillna(0, subset=["in_old", "in_new"])


def write_qrels(qrels: DataFrame, path: str) -> None:
    """JSON lines in id order."""
    qrels.orderBy("query_id").write.mode("overwrite").json(path)


def markdown_report(summary: DataFrame, metrics: list[str], title: str = "Evaluation", alarm: float = 0.2, failures: dict[str, float] | None = None) -> str:
    """Stage and category tables of a summary (a row per stage and category, so few rows), with a line for stages that failed too often."""
    rows = summary.orderBy("level", "stage", "category").collect()
    out = [f"# {title}", ""]
    for level in ("stage", "category"):
        part = [r for r in rows if r["level"] == level]
        if not part:
            continue
        names = ["stage"] + (["category"] if level == "category" else [])
        out += [f"## By {level}", "", "| " + " | ".join([*names, *metrics]) + " |", "|" + "-|" * (len(names) + len(metrics))]
        out += ["| " + " | ".join([*[str(r[n]) for n in names], *[f"{r[m]:.4f} (n={r[m + '_n']})" for m in metrics]]) + " |" for r in part]
        out.append("")
    out += [f"**{s}: {100 * f:.0f} % of its calls failed; its figures do not count.**" for s, f in sorted((failures or {}).items()) if f > alarm]
    return "\n".join(out)
