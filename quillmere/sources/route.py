"""Routing of payloads to parsers, and the chain of parsers with their fallbacks."""

from __future__ import annotations

import functools
import inspect
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmere.functions.tables import drop_staged, staged
from quillmere.sources.readers import extension

# MIME types of each parser.
HTML_MIMES = ["text/html", "application/xhtml+xml"]
MARKDOWN_MIMES = ["text/markdown", "text/x-markdown"]
OFFICE_MIMES = [
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
]


def _bytes(data: Column, n: int) -> Column:
    return F.lower(F.decode(F.substring(data, 1, n), "ISO-8859-1"))


def route(data: Column, mime: Column, path: Column) -> Column:
    """Struct (parser, confidence, mode, fallbacks): PDF, HTML, Markdown, plain text, office, else ``unsupported``."""
    kind, suffix = F.lower(F.coalesce(mime, F.lit(""))), extension(path)

    def to(parser, confidence, mode=None, fallbacks=()):
        mode = F.lit(None).cast("string") if mode is None else mode
        return F.struct(F.lit(parser).alias("parser"), F.lit(confidence).alias("confidence"), mode.alias("mode"), F.array(*[F.lit(f) for f in fallbacks]).cast("array<string>").alias("fallbacks"))

    head = _bytes(data, 200_000)
    mode = F.when(F.contains(head, F.lit("<pre")) | F.contains(head, F.lit("<code")), "code_heavy").otherwise("article")
    return (
        F.when((kind == "application/pdf") | F.startswith(_bytes(data, 5), F.lit("%pdf-")), to("pdf_lines", 0.98, None, ("pdf_lines_fallback",)))
        .when(kind.isin(HTML_MIMES) | F.contains(_bytes(data, 4096), F.lit("<html")), to("html", 0.95, mode))
        .when(kind.isin(MARKDOWN_MIMES) | suffix.isin("md", "markdown"), to("markdown", 0.99))
        .when((kind == "text/plain") | suffix.isin("txt", "rst"), to("plain", 0.90))
        .when(kind.isin(OFFICE_MIMES) | suffix.isin("docx", "pptx", "xlsx"), to("office", 0.90))
        .otherwise(to("unsupported", 0.0))
    )


#: Parsers by name: functions of rows (artifact, data, ...) to block rows.
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def known_options(f: Callable, options: dict) -> dict:
    """Those of ``options`` that a parser takes, all if it takes any: what a caller sets for one parser does not break another."""
    params = inspect.signature(f).parameters.values()
    if any(p.kind is p.VAR_KEYWORD for p in params):
        return dict(options)
    names = {p.name for p in params if p.kind in (p.POSITIONAL_OR_KEYWORD, p.KEYWORD_ONLY)}
    return {k: v for k, v in options.items() if k in names}


def parser(name: str):
    def add(f):
        PARSERS[name] = f
        return f

    return add


#: Parsers of one payload by name: functions of its bytes to dicts of BLOCK's fields. What they raise becomes the row's error.
ROW_PARSERS: dict[str, Callable[..., list[dict]]] = {}
BLOCK = T.StructType([T.StructField("ord", T.IntegerType()), T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("level", T.IntegerType())])


def row_parser(name: str):
    def add(f):
        ROW_PARSERS[name] = f
        return f

    return add


@row_parser("json")
def json_blocks(data: bytes) -> list[dict]:
    """Blocks of an exported document: ``{"blocks": [{"type", "text", "level"}, ...]}``, or its ``text``."""
    value = json.loads(data)
    if not isinstance(value, dict) or not ("blocks" in value or "text" in value):
        raise ValueError("neither blocks nor text")
    rows = value.get("blocks", [{"type": "text", "text": value.get("text")}])
    return [{"type": b.get("type", "text"), "text": b["text"], "level": b.get("level")} for b in rows if (b["text"] or "").strip()]


def _by_row(rows: DataFrame, options: dict) -> DataFrame:
    """Blocks of rows (artifact, parser, data) of all row parsers in one pass, or a row with what was raised as ``error``."""
    import pyarrow as pa

    kind = rows.schema["artifact"]
    schema = T.StructType([kind, *BLOCK.fields, T.StructField("error", T.StringType())])
    calls = {name: (f, known_options(f, options)) for name, f in ROW_PARSERS.items()}

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for b in batches:
            for artifact, name, data in zip(b.column(0), b.column(1).to_pylist(), b.column(2)):
                f, known = calls[name]
                try:
                    found = [{c: x.get(c) for c in ("type", "text", "level")} | {"ord": i} for i, x in enumerate(f(data.as_py() or b"", **known))]
                    table = pa.RecordBatch.from_pylist([{kind.name: artifact.as_py(), **x, "error": None} for x in found], arrow)
                except Exception as e:  # any failure of a parser is that row's result
                    table = pa.RecordBatch.from_pylist([{kind.name: artifact.as_py(), "error": f"{type(e).__name__}: {e}"}], arrow)
                yield table

    return rows.select("artifact", "parser", "data").mapInArrow(run, schema)


def _parsed(now: DataFrame, names: list[str], options: dict) -> DataFrame:
    """Blocks and errors of one try: each row goes to its own parser only. Text that is not UTF-8 is an error of the parsers of tables."""
    parts = []
    if any(n in ROW_PARSERS for n in names):
        parts.append(_by_row(now.where(F.col("parser").isin(list(ROW_PARSERS))), options))
    good = F.coalesce(F.is_valid_utf8(F.col("data").cast("string")), F.lit(True)) if "data" in now.columns else F.lit(True)
    tables = [n for n in names if n in PARSERS]
    for name in tables:
        parse = PARSERS[name]
        parts.append(parse(now.where((F.col("parser") == name) & good), **known_options(parse, options)).withColumn("error", F.lit(None).cast("string")))
    if tables:
        parts.append(now.where(F.col("parser").isin(tables) & ~good).select("artifact", F.lit("not UTF-8").alias("error")))
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def parse_chain(routed: DataFrame, accept: Callable[[DataFrame], DataFrame], tries: int = 2, options: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(blocks, attempts): rows go to their parser; those that fail, or that ``accept`` (blocks to accepted artifacts) leaves out, go to their next fallback.

    Each parser gets those of ``options`` that it takes. ``routed`` has artifact, parser, fallbacks and data. Of each try the rows and what they gave are written
    once, so that a row is parsed once a try, and only those left are in the next. Attempts (artifact, parser, attempt, outcome, error) end as ``accepted``, ``rejected``,
    ``error`` (with what was raised) or, for a parser that is not installed, ``unsupported``.
    """
    if not PARSERS and not ROW_PARSERS:
        raise ValueError("no parser is installed")
    installed = [*PARSERS, *ROW_PARSERS]
    rest = staged(routed.withColumn("chain", F.concat(F.array("parser"), "fallbacks")))
    found: list[DataFrame] = []
    attempts: list[DataFrame] = []
    for k in range(1, tries + 1):
        now = rest.withColumn("parser", F.try_element_at("chain", F.lit(k))).where("parser is not null")
        names = sorted(r["parser"] for r in now.where(F.col("parser").isin(installed)).select("parser").distinct().collect())  # no more than are installed
        if names:
            parsed = staged(_parsed(now, names, options or {}))
            blocks = parsed.where("error is null").drop("error")
            failed = parsed.where("error is not null").groupBy("artifact").agg(F.min("error").alias("error"))
            good = staged(accept(blocks).select("artifact").distinct().withColumn("ok", F.lit(True)).join(failed, "artifact", "left_anti"))
            tried = now.join(good, "artifact", "left").join(failed, "artifact", "left")
            found.append(blocks.join(good.select("artifact"), "artifact", "left_semi"))
        else:
            tried = now.withColumn("ok", F.lit(None).cast("boolean")).withColumn("error", F.lit(None).cast("string"))
        outcome = F.when(F.col("error").isNotNull(), "error").when(F.col("ok"), "accepted").when(~F.col("parser").isin(installed), "unsupported").otherwise("rejected")
        attempts.append(staged(tried.select("artifact", "parser", F.lit(k).alias("attempt"), outcome.alias("outcome"), "error")))
        if names:
            left = staged(rest.join(good, "artifact", "left_anti"))
            drop_staged(rest)
            rest = left
    if not found:
        found.append(rest.select("artifact", *[F.lit(None).cast(f.dataType).alias(f.name) for f in BLOCK.fields]).where("false"))
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found), functools.reduce(DataFrame.unionByName, attempts)


def attempt_lists(attempts: DataFrame) -> DataFrame:
    """(artifact, attempts, accepted): each artifact's tries in order, with parser, outcome and error, and whether one was accepted."""
    tries = F.array_sort(F.collect_list(F.struct("attempt", "parser", "outcome", "error")))
    return attempts.groupBy("artifact").agg(tries.alias("attempts"), F.max((F.col("outcome") == "accepted").cast("int")).cast("boolean").alias("accepted"))
