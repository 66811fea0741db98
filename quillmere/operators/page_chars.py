"""From a page's characters to its lines: what readers of PDF files give are characters with places, sizes and fonts.

Input (artifact, page, n, text, x0, top, x1, bottom, size, font), one row a character, ``n`` their order in the file. Everything is gaps and islands: places sorted along one
axis, a new island where the next one is further than a tolerance. Windows run over one page's characters, or fewer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Points within which a character is drawn again, characters share a line, and stand in one word.
AGAIN, LINE, WORD = 1.5, 3.0, 3.0

# Parts of the names of fonts whose characters are all as wide.
MONO = ["mono", "courier", "consol", "menlo", "code", "fixed", "typewriter"]


def is_mono(font: Column) -> Column:
    """Whether a font's name says that its characters are all as wide."""
    return F.coalesce(F.lower(font).rlike("|".join(MONO)), F.lit(False))


def islands(rows: DataFrame, by: list[str], value: str, tolerance: float, name: str, then: str = "n") -> DataFrame:
    """Adds ``name``: numbers of runs of ``value`` in each group ``by`` in which no step is over the tolerance."""
    w = Window.partitionBy(*by).orderBy(value, then)
    new = F.coalesce(F.col(value) - F.lag(value).over(w) > tolerance, F.lit(True)).cast("int")
    return rows.withColumn("__new", new).withColumn(name, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def unique_chars(chars: DataFrame, tolerance: float = AGAIN) -> DataFrame:
    """Without characters that were drawn again: of those with one text, font and size whose tops, and then left sides, are one island, the first stays."""
    by = ["artifact", "page", "text", "font", "size"]
    at = islands(islands(chars, by, "top", tolerance, "__y"), [*by, "__y"], "x0", tolerance, "__x")
    first = F.min("n").over(Window.partitionBy(*by, "__y", "__x"))
    return at.withColumn("__first", first).where("n = __first").select(*chars.columns)


def _rounded(c: Column) -> Column:
    return F.bround(c, 1)


def char_lines(chars: DataFrame, line: float = LINE, word: float = WORD) -> DataFrame:
    """(artifact, page, line_no, text, x0, y0, x1, y1, size, font) of a page's characters, from the top.

    Tops that are one island are a line; in it characters go by their left sides, with a blank where there is more room than ``word`` or a blank was drawn. A line has its largest
    size and the font of most of its characters, of two the one that comes first. Lines of blanks are none.
    """
    there = islands(chars.where("text is not null and x0 is not null and top is not null"), ["artifact", "page"], "top", line, "__l")
    by = ["artifact", "page", "__l"]
    w = Window.partitionBy(*by).orderBy("x0", "n")
    drawn = F.trim("text") != ""
    end = F.max(F.when(drawn, F.col("x1"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    parts = there.withColumn("__part", F.concat(F.when(drawn & (F.col("x0") - end > word), " ").otherwise(""), "text")).withColumn("__drawn", drawn)
    fonts = parts.where("__drawn").groupBy(*by, "font").agg(F.count("*").alias("c"), F.min(F.struct("x0", "n")).alias("f"))
    top_font = fonts.groupBy(*by).agg(F.min(F.struct((-F.col("c")).alias("c"), "f", "font")).alias("best")).select(*by, F.col("best.font").alias("font"))
    lists = parts.groupBy(*by).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "n", "__part"))), lambda x: x["__part"]), "").alias("text"),
        *[_rounded(f(F.when(F.col("__drawn"), F.col(c)))).alias(name) for name, c, f in (("x0", "x0", F.min), ("y0", "top", F.min), ("x1", "x1", F.max), ("y1", "bottom", F.max), ("size", "size", F.max))],
    )
    said = lists.withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " "))).where("text <> ''").join(top_font, by)
    number = F.row_number().over(Window.partitionBy("artifact", "page").orderBy(F.bround("y0"), "x0", "__l"))
    return said.withColumn("line_no", number).select("artifact", "page", "line_no", "text", "x0", "y0", "x1", "y1", "size", "font")
