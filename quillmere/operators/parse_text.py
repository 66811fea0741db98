"""Markdown and plain text to blocks, with line windows: fences, formulas, headings, lists, images, paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmere.functions.text import padded
from quillmere.operators.blocks import with_section_path
from quillmere.sources.route import parser

_BREAKS = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
_LIST = r"^\s*([-*+]|\d+[.)])\s+"
_WIDE_LIST = r"^\s*([-*+\x{2022}\x{00b7}]|\d+[.)\x{3001}]|[a-zA-Z][.)])\s+"


def _lines(docs: DataFrame, text: str) -> DataFrame:
    return docs.select("artifact", F.posexplode(F.split(F.coalesce(text, F.lit("")), _BREAKS)).alias("line", "raw"))


def _gather(rows: DataFrame) -> DataFrame:
    """Lines of one block (artifact, bid) joined; columns of the first line are kept."""
    return rows.groupBy("artifact", "bid").agg(
        F.min("line").alias("line"), F.min_by("kind", "line").alias("type"), F.min_by("level", "line").alias("level"), F.min_by("code_language", "line").alias("code_language"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "content"))), lambda x: x["content"]), "\n").alias("text"),
    )


def _finish(blocks: DataFrame) -> DataFrame:
    w = Window.partitionBy("artifact").orderBy("line")
    image = F.regexp_extract("text", r"^\s*!\[([^\]]*)\]\(([^)]*)\)\s*$", 2)
    blocks = blocks.withColumn("image_uri", F.when(F.col("type") == "image", image)).withColumn("text", F.when(F.col("type") == "image", F.regexp_extract("text", r"!\[([^\]]*)\]", 1)).otherwise(F.col("text")))
    numbered = blocks.withColumn("ord", F.row_number().over(w)).drop("line", "bid")
    return with_section_path(numbered).withColumn("block_id", F.concat(F.lit("b"), padded(F.col("ord"))))


def parse_markdown(docs: DataFrame, text: str = "text") -> DataFrame:
    """Blocks of Markdown texts (artifact, text). A fence that is not closed runs to the end."""
    w = Window.partitionBy("artifact").orderBy("line")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    fence = F.col("raw").rlike(r"^\s*```")
    rows = _lines(docs, text).withColumn("fence", fence)
    rows = rows.withColumn("fences", F.sum(F.col("fence").cast("int")).over(upto)).withColumn("inside", F.coalesce(F.sum(F.col("fence").cast("int")).over(before), F.lit(0)) % 2 == 1)
    code = F.col("fence") | F.col("inside")
    blank = ~code & ~F.col("raw").rlike(r"\S")
    heading = ~code & F.col("raw").rlike(r"^#{1,6}\s+\S")
    lone = ~code & (F.col("raw").rlike(r"^\s*!\[[^\]]*\]\([^)]*\)\s*$") | F.col("raw").rlike(r"^\s*\$\$.+\$\$\s*$"))
    rows = rows.withColumn("code", code).withColumn("blank", blank).withColumn("heading", heading).withColumn("lone", lone)
    cut = F.col("heading") | F.col("lone") | (F.col("fence") & ~F.col("inside")) | F.coalesce(F.lag(F.col("blank") | F.col("heading") | F.col("lone") | (F.col("fence") & F.col("inside"))).over(w), F.lit(True))
    rows = rows.withColumn("bid", F.sum(cut.cast("int")).over(upto)).where(~F.col("blank"))
    kind = (
        F.when(F.col("code"), "code").when(F.col("heading"), "heading").when(F.col("lone") & F.col("raw").rlike(r"^\s*!"), "image").when(F.col("lone"), "formula")
        .when(F.col("raw").rlike(_LIST), "list").otherwise("text")
    )
    content = F.when(F.col("heading"), F.regexp_replace(F.regexp_replace("raw", r"^#{1,6}\s+", ""), r"\s+#*\s*$", "")).when(F.col("lone") & F.col("raw").rlike(r"^\s*\$\$"), F.trim(F.regexp_replace("raw", r"\$\$", ""))).otherwise(F.col("raw"))
    rows = rows.withColumn("kind", kind).withColumn("content", content).withColumn("level", F.when(F.col("heading"), F.length(F.regexp_extract("raw", "^(#{1,6})", 1))))
    rows = rows.withColumn("code_language", F.when(F.col("fence") & ~F.col("inside"), F.nullif(F.trim(F.regexp_replace("raw", r"^\s*```", "")), F.lit(""))))
    # fence lines stay for the language, but not in the text; formulas over several lines
    rows = rows.withColumn("content", F.when(F.col("fence"), F.lit(None)).otherwise(F.col("content")))
    blocks = _gather(rows)
    wide = (F.col("type") == "text") & F.col("text").rlike(r"(?s)^\s*\$\$.*\$\$\s*$")
    blocks = blocks.withColumn("type", F.when(wide, "formula").otherwise(F.col("type"))).withColumn("text", F.when(wide, F.trim(F.regexp_replace("text", r"\$\$", ""))).otherwise(F.col("text")))
    return _finish(blocks)


def parse_plain(docs: DataFrame, text: str = "text") -> DataFrame:
    """Blocks of plain texts: paragraphs between blank lines, headings by an underline as long as the title; # is no heading."""
    w = Window.partitionBy("artifact").orderBy("line")
    rows = _lines(docs, text)
    under = F.lead("raw").over(w)
    mark = r'^([=\-~^"#*+.])\1{2,}\s*$'
    title = F.col("raw").rlike(r"\S") & ~F.col("raw").rlike(mark) & F.coalesce(under.rlike(mark) & (F.length(F.rtrim(under)) >= F.length(F.rtrim("raw"))), F.lit(False))
    rows = rows.withColumn("heading", title).withColumn("sign", F.when(title, F.substring(under, 1, 1)))
    rows = rows.withColumn("line_of", F.coalesce(F.lag("heading").over(w), F.lit(False))).where(~F.col("line_of"))
    # Levels of underline characters.
    level = F.create_map(*[F.lit(x) for kv in {"=": 1, "-": 2, "~": 3, "^": 4, '"': 5}.items() for x in kv])
    blank = ~F.col("raw").rlike(r"\S")
    cut = F.col("heading") | F.coalesce(F.lag(blank | F.col("heading")).over(w), F.lit(True))
    rows = rows.withColumn("bid", F.sum(cut.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where(F.col("raw").rlike(r"\S"))
    kind = F.when(F.col("heading"), "heading").when(F.col("raw").rlike(_WIDE_LIST), "list").otherwise("text")
    rows = rows.withColumn("kind", kind).withColumn("content", F.when(F.col("heading"), F.trim("raw")).otherwise(F.col("raw"))).withColumn("level", F.when(F.col("heading"), F.coalesce(level[F.col("sign")], F.lit(6)))).withColumn("code_language", F.lit(None).cast("string"))
    return _finish(_gather(rows))


def _decoded(rows: DataFrame) -> DataFrame:
    return rows.select("artifact", F.decode("data", "UTF-8").alias("text"))


@parser("markdown")
def markdown_rows(rows: DataFrame) -> DataFrame:
    return parse_markdown(_decoded(rows))


@parser("plain")
def plain_rows(rows: DataFrame) -> DataFrame:
    return parse_plain(_decoded(rows))


def pack_paragraphs(docs: DataFrame, max_chars: int = 800, text: str = "text") -> DataFrame:
    """Character-budget packing of Markdown paragraphs: a heading or an oversized paragraph flushes, the latter is cut into windows.

    (artifact, chunk, section, text); the budget counts the blank line between paragraphs.
    """
    marked = docs.select("artifact", F.posexplode(F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")).alias("ord", "text"))
    head = F.col("text").rlike(r"^#{1,6}[ \t]+[^\n]+$")
    rows = marked.withColumn("type", F.when(head, "heading").otherwise("text")).withColumn("level", F.when(head, F.length(F.regexp_extract("text", "^(#{1,6})", 1)))).withColumn("text", F.when(head, F.trim(F.regexp_replace("text", "^#{1,6}", ""))).otherwise(F.col("text")))
    rows = with_section_path(rows).withColumn("section", F.array_join("section_path", " > "))
    w = Window.partitionBy("artifact").orderBy("ord")
    rows = rows.withColumn("run", F.sum((F.col("type") == "heading").cast("int")).over(w)).where("type <> 'heading'")
    pieces = F.when(F.length("text") > max_chars, F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / max_chars).cast("int")), lambda i: F.substring(F.col("text"), i * max_chars + 1, F.lit(max_chars)))).otherwise(F.array("text"))
    rows = rows.withColumn("long", F.length("text") > max_chars).select("artifact", "run", "ord", "section", "long", F.posexplode(pieces).alias("part", "text"))
    listed = rows.groupBy("artifact", "run", "section").agg(F.array_sort(F.collect_list(F.struct("ord", "part", "long", "text"))).alias("ps"))
    fold = F.expr(
        f"""aggregate(ps, struct(cast(array() as array<struct<k:int,text:string>>) as out, 0 as k, 0 as size, false as shut), (s, x) -> struct(
            concat(s.out, array(struct(s.k + if(s.size > 0 and (x.long or s.shut or s.size + 2 + length(x.text) > {max_chars}), 1, 0) as k, x.text as text))) as out,
            s.k + if(s.size > 0 and (x.long or s.shut or s.size + 2 + length(x.text) > {max_chars}), 1, 0) as k,
            if(s.size > 0 and (x.long or s.shut or s.size + 2 + length(x.text) > {max_chars}), length(x.text), s.size + if(s.size > 0, 2, 0) + length(x.text)) as size,
            x.long as shut), s -> s.out)"""
    )
    parts = listed.select("artifact", "run", "section", F.posexplode(fold).alias("at", "x"))
    packed = parts.groupBy("artifact", "run", "section", F.col("x.k").alias("k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "x.text"))), lambda y: y["text"]), "\n\n").alias("text"))
    return packed.withColumn("chunk", F.row_number().over(Window.partitionBy("artifact").orderBy("run", "k")) - 1).select("artifact", "chunk", "section", "text")
