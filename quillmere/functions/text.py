"""Column functions on text: analysis, cleaning, normalisation, guesses. All run in the JVM but ``nfkc``."""

from __future__ import annotations

import functools
import hashlib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The analyzer's patterns, edge characters and stop words.
TERM_PATTERN = r"[A-Za-z0-9_][A-Za-z0-9_.:/+\-]*|[\x{4e00}-\x{9fff}]+"
EDGE_CHARS = " \t\r\n.,;:!?()[]{}<>\"'`，。；：！？（）【】《》"
STOPWORDS = [
    "的", "了", "和", "与", "或", "在", "是", "为", "对", "中", "上", "下",
    "这", "那", "有", "及", "等", "一个", "一种", "以及", "可以", "需要",
    "如果", "因为", "所以", "进行", "通过", "使用",
    "a", "an", "the", "and", "or", "of", "to", "in", "on", "for", "is",
    "are", "be", "as", "by", "with", "from", "this", "that",
]
# Fixed value: characters left out of CJK bigrams of the hashing embedding.
HASH_STOP_CHARS = "的是了在和与及就都也很把被这那有些会能可以为对从到并但而"
# Short texts that are no content, contents entries, garbled characters.
BOILERPLATE_PATTERN = "(?i)(newsletter|subscribe|sign up|delivered monthly|cookie policy|privacy policy|follow us|all rights reserved)"
TOC_ENTRY_PATTERN = r"^\s*[0-9A-Z]+(?:\.[0-9]+)+\.?\s+\S.*?\s+\d+\s*$"
GARBLED_PATTERN = r"[\x{fffd}\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}]"
# Fixed value: where sentences end.
SENTENCE_END = r"(?<=[。！？；])\s*(?=\S)"


def nfkc(col: Column) -> Column:
    """Compatibility form; Spark has no such function, so this one leaves the JVM in Arrow batches."""
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return run(col)


@functools.lru_cache(maxsize=1)
def unstable_pattern(least: int = 32) -> str:
    """One character that the compatibility form may change, alone or with its neighbours.

    Made by a rule: runs of at least ``least`` code points that stay as they are, combine with nothing before them, and so are
    stable, make the class that this one is the complement of; ASCII comes first.
    """
    stable, start = ["\\x00-\\x7f"], None
    for c in range(0x80, 0x10000):
        ch = chr(c)
        same = not 0xD800 <= c <= 0xDFFF and unicodedata.normalize("NFKC", ch) == ch and not unicodedata.combining(ch) and not 0x1100 <= c <= 0x11FF
        if same and start is None:
            start = c
        if not same and start is not None:
            if c - start >= least:
                stable.append(f"\\x{{{start:x}}}-\\x{{{c - 1:x}}}")
            start = None
    marks = "\u2013\u2014\u2018\u2019\u201c\u201d\u2022\u20ac\u00a1\u00a7\u00ab\u00bb\u00bf"
    return f"[^{''.join(stable)}{marks}]"


#: A text of the commonest stable characters: few ranges, so that most texts are told at once.
COMMON = r"^[\x00-\x7f\x{c0}-\x{ff}\x{4e00}-\x{9fff}]*+\z"


def normal_text(text: Column) -> Column:
    """Compatibility form, no-break blanks as blanks, lower case. Only texts with a character that it may change leave the JVM."""
    odd = ~text.rlike(COMMON) & text.rlike(unstable_pattern())
    changed = F.when(odd, F.coalesce(nfkc(F.when(odd, text)), text)).otherwise(text)
    return F.lower(F.replace(changed, F.lit("\u00a0"), F.lit(" ")))


def _pieces(term: Column) -> Column:
    """A CJK run as its bigrams (a run of one stays), anything else as itself."""
    grams = F.when(F.length(term) < 2, F.array(term)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(term) - 1, F.lit(1))), lambda i: F.substring(term, i, F.lit(2))))
    return F.when(term >= "\u4e00", grams).otherwise(F.array(term))


def analyze(text: Column, keep_stopwords: bool = False, cjk: bool = True) -> Column:
    """Index terms of a text: technical tokens whole, CJK runs as bigrams; lower case, edges stripped.

    Texts are taken in their compatibility form. Stop words, single digits and single CJK characters go. Null gives an empty array.
    """
    low = normal_text(F.coalesce(text, F.lit("")))
    raw = F.regexp_extract_all(low, F.lit(TERM_PATTERN), F.lit(0))
    # only texts with such a character pay for looking at each run
    terms = F.when(low.rlike(r"[\x{4e00}-\x{9fff}]"), F.flatten(F.transform(raw, _pieces))).otherwise(raw) if cjk else raw
    terms = F.transform(terms, lambda t: F.btrim(t, F.lit(EDGE_CHARS)))

    def wanted(t: Column) -> Column:
        # the pattern leaves only technical tokens and CJK runs, so short ones alone are looked at
        ok = (F.length(t) > 1) | t.between("a", "z") | (t == "_")
        return ok if keep_stopwords else ok & ~t.isin(STOPWORDS)

    return F.filter(terms, wanted)


def loose_terms(text: Column) -> Column:
    """Terms of the comparison index: letter and digit runs of two characters or more, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]{2,}"), F.lit(0))


def latin_words(text: Column) -> Column:
    """ASCII letter and digit runs, as they stand."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0))


def hash_tokens(text: Column) -> Column:
    """Tokens of the hashing embedding: lower-case ASCII words, and bigrams over the CJK characters that are left."""
    cjk = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x{4e00}-\x{9fff}]|[" + HASH_STOP_CHARS + "]", "")
    n = F.length(cjk)
    grams = F.when(n == 0, F.array().cast("array<string>")).when(n == 1, F.array(cjk)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(cjk, i, F.lit(2))))
    return F.concat(F.transform(latin_words(text), lambda w: F.lower(w)), grams)


def token_len(text: Column) -> Column:
    """Tokens of a text by a plain rule: letter or digit runs, and other visible characters one by one."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")).cast("long")


def clean_text(text: Column) -> Column:
    """Without zero-width marks and HTML comments; blanks collapsed, blank lines at most one, ends stripped."""
    out = F.regexp_replace(text, r"[\x{200b}\x{feff}]", "")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", "")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def clean_code(text: Column) -> Column:
    """Code keeps its blanks: only line ends are made even, and empty lines at the ends go."""
    return F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"^\n+|\n+$", "")


def is_toc(text: Column) -> Column:
    """Whether at least five lines are there and half or more read like a table of contents."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"\S"))
    hits = F.filter(lines, lambda x: x.rlike(TOC_ENTRY_PATTERN))
    return (F.size(lines) >= 5) & (F.size(hits) * 2 >= F.size(lines))


def is_boilerplate(text: Column) -> Column:
    return (F.length(text) < 300) & text.rlike(BOILERPLATE_PATTERN)


# Lines that converted Markdown loses.
DOT_LEADER = r"^[\s.·…]{10,}"
CONTENTS_LINE = r"^.{0,80}\.{3,}\s*\d+\s*$"
IMAGE_MARK = r"(?i)^<!--\s*image\s*-->$"
LONE_NUMBER = r"^\d{1,4}$"


def clean_markdown_lines(text: Column, drop_headings: bool = False) -> Column:
    """Converted Markdown without dot leaders, contents lines, image marks and lone page numbers; runs of blank lines shortened, ends stripped.

    Real images stay. Headings go too with ``drop_headings``.
    """
    lines = F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"), lambda x: F.regexp_replace(x, r"(?U)\s+$", ""))

    def stays(line: Column) -> Column:
        core = F.regexp_replace(line, r"(?U)^\s+", "")
        noise = core.rlike(DOT_LEADER) | core.rlike(CONTENTS_LINE) | core.rlike(IMAGE_MARK) | core.rlike(LONE_NUMBER)
        return ~(noise | core.startswith("#")) if drop_headings else ~noise

    return F.regexp_replace(F.regexp_replace(F.array_join(F.filter(lines, stays), "\n"), r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


# What gold matching takes out, in this order; emphasis in one pass, so that what it uncovers stays.
LINK = r"\[([^\]\[]+)\]\([^)\s]*\)"
EMPHASIS = r"(?sU)\*{1,3}(?=\S)(.+?)(?<=\S)\*{1,3}|(?<!\w)_{1,3}(?=\S)(.+?)(?<=\S)_{1,3}(?!\w)|`{1,3}(?=\S)(.+?)(?<=\S)`{1,3}"


def metric_text(text: Column) -> Column:
    """Text for gold matching: links to their anchors, paired emphasis gone, no blank before punctuation, one blank between words; in this order."""
    out = F.regexp_replace(F.regexp_replace(text, LINK, "$1"), EMPHASIS, "$1$2$3")
    out = F.regexp_replace(out, r"(?U)\s+([,.;:!?])", "$1")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def guess_language(text: Column) -> Column:
    """zh, en, mixed or unknown, by counts of CJK characters and Latin letters."""
    cjk = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[\x{4e00}-\x{9fff}]"))
    latin = F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[A-Za-z]"))
    low, high = F.least(cjk, latin), F.greatest(cjk, latin)
    return F.when(high == 0, "unknown").when(low > high * 0.15, "mixed").when(cjk > latin, "zh").otherwise("en")


def char_bigrams(text: Column) -> Column:
    n = F.length(text)
    return F.array_distinct(F.when(n < 2, F.array(text)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2)))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 for two empty ones."""
    both, any_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(any_ == 0, 0.0).otherwise(both / any_)


def title_key(text: Column) -> Column:
    """Letters and digits of a title in lower case, full-width forms folded."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    plain = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
    return F.lower(F.regexp_replace(F.translate(text, wide, plain), r"[^\p{L}\p{N}]", ""))


def sentences(text: Column) -> Column:
    """Sentences by CJK terminators."""
    return F.split(text, SENTENCE_END)


def padded(number: Column) -> Column:
    """A number of four digits or more."""
    return F.format_string("%04d", number)


def artifact_id(final_uri: Column, uri: Column, sha256: Column) -> Column:
    """doc_ and 12 hex digits of the URI's SHA-256, or of the content's where the picked URI is blank."""
    picked = F.coalesce(F.nullif(final_uri, F.lit("")), uri, F.lit(""))
    return F.concat(F.lit("doc_"), F.when(F.trim(picked) != "", F.substring(F.sha2(F.trim(picked), 256), 1, 12)).otherwise(F.substring(sha256, 1, 12)))


def point_id(chunk_id: Column, exact: bool = True) -> Column:
    """63-bit id of a chunk: eight bytes of BLAKE2b (an Arrow function), or Spark's xxhash64."""
    mask = F.lit((1 << 63) - 1).cast("long")
    if not exact:
        return F.xxhash64(chunk_id).bitwiseAND(mask)
    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big") & ((1 << 63) - 1))

    return run(chunk_id)
