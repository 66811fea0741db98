"""HTML to blocks and page metadata.

The tree walk needs state that columns do not hold, so one Arrow function gives an array of blocks per page;
all else is relational. The main part is the last <article> or <main>, else the body, without navigation, headers, footers,
asides, forms and scripts; block types that are missing there are taken from the whole page.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmere.functions.text import padded
from quillmere.operators.blocks import with_section_path
from quillmere.sources.route import parser

_OUT = frozenset("script style noscript template nav footer aside form button select textarea iframe svg header".split())
_BLOCK = frozenset("html body address article blockquote details div dl dd dt fieldset figure h1 h2 h3 h4 h5 h6 hr li main ol p pre section table ul tr td th figcaption caption".split())
#: Elements that are a block by themselves, however short; text right in any other needs two characters.
_WHOLE = frozenset("p blockquote address details".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Class names that tell a code language by themselves.
_LANGUAGES = {
    "python", "py", "javascript", "js", "typescript", "ts", "java", "go", "rust", "c", "cpp", "csharp", "ruby", "php", "swift", "kotlin", "scala", "bash", "sh", "shell", "zsh", "powershell", "sql",
    "json", "yaml", "yml", "toml", "ini", "xml", "html", "css", "scss", "markdown", "md", "dockerfile", "makefile", "nginx", "text", "plaintext", "diff", "patch",
}
MAX_LINKS, MAX_LINK_TEXT = 20, 200
#: The ampersand of a reference without its semicolon; comments, scripts and styles, where none are decoded, are passed over.
_BARE = re.compile(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1|&(?=(?:[a-z][a-z0-9]*|#[0-9]+|#x[0-9a-f]+)(?![a-z0-9;]))")

BLOCK_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("code_language", T.StringType()),
            T.StructField("image_uri", T.StringType()), T.StructField("caption", T.StringType()), T.StructField("links", T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("href", T.StringType())]))),
            T.StructField("main", T.BooleanType()), T.StructField("quote", T.BooleanType()),
        ]
    )
)


class _Walk(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.blocks: list[dict] = []
        self.parts: list[str] = []
        self.links: list[dict] = []
        self.link: list | None = None
        self.code: list[str] | None = None
        self.language = None
        self.items: list[str] | None = None
        self.depth = 0
        self.rows: list[list[str]] | None = None
        self.figure: dict | None = None
        self.title = None
        self.in_title = False

    def _main(self):
        return any(t in ("article", "main") for t in self.stack)

    def _hidden(self):
        return any(t in _OUT for t in self.stack if not (t == "header" and self._main()))

    def _add(self, kind, text, **more):
        text = text if kind == "code" else re.sub(r"[ \t\r\f\v\xa0]+", " ", re.sub(r"\s*\n\s*", "\n" if kind in ("list", "table") else " ", text)).strip()
        if text or more.get("image_uri"):
            base = {"type": kind, "text": text, "level": None, "code_language": None, "image_uri": None, "caption": None, "links": self.links[:MAX_LINKS], "main": self._main(), "quote": "blockquote" in self.stack}
            self.blocks.append({**base, **more})
        self.links = []

    def _flush(self):
        text = "".join(self.parts)
        self.parts = []
        if not text.strip():
            return
        if self.rows is not None:
            if self.rows and self.rows[-1]:
                self.rows[-1][-1] += " " + text
            return
        if self.items is not None:
            if self.items:
                self.items[-1] += " " + text
            return
        head = next((t for t in reversed(self.stack) if re.fullmatch("h[1-6]", t)), None)
        if head:
            self._add("heading", text, level=int(head[1]))
        elif self.figure is not None and "figcaption" in self.stack:
            self.figure["caption"] = text.strip()
        elif len(text.strip()) >= 2 or any(t in _WHOLE for t in self.stack):
            self._add("text", text)

    def _close(self, tag):
        while self.stack:
            t = self.stack.pop()
            if t == tag:
                break

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if self.code is not None and tag != "code":
            return
        if tag == "title":
            self.in_title = self.title is None
        if tag in _BLOCK and not self._hidden():
            self._flush()
            if "p" in self.stack and tag not in ("html", "body"):
                self._close("p")
            if tag == "li" and "li" in self.stack and self.stack[::-1].index("li") < min((self.stack[::-1].index(x) for x in ("ul", "ol") if x in self.stack), default=99):
                self._close("li")
        if self._hidden():
            if tag not in _VOID:
                self.stack.append(tag)
            return
        if tag == "br":
            self.parts.append("\n" if self.code is None else "\n")
        elif tag in ("ul", "ol"):
            if self.items is None:
                self.items, self.depth = [], 0
            self.depth += 1
        elif tag == "li" and self.items is not None:
            self.items.append("")
        elif tag == "table" and self.rows is None:
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.rows[-1].append("")
        elif tag == "figure":
            self.figure = {}
        elif tag == "img":
            shot = {"image_uri": a.get("src") or "", "caption": a.get("alt") or ""}
            if self.figure is not None:
                self.figure.update(shot)
            elif shot["image_uri"]:
                self._flush()
                self._add("image", shot["caption"], image_uri=shot["image_uri"], caption=shot["caption"] or None)
        elif tag == "a" and a.get("href") and not a["href"].startswith("#"):
            self.link = [a["href"], len(self.parts)]
        if tag == "pre":
            self.code = []
        if tag in ("pre", "code") and self.code is not None:
            for c in (a.get("class") or "").split():
                m = re.match(r"(?:language|lang|highlight)-(\w+)", c)
                if m or c.lower() in _LANGUAGES:
                    self.language = (m[1] if m else c).lower()
        if tag not in _VOID:
            self.stack.append(tag)

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        if tag == "pre" and self.code is not None:
            text, self.code = "".join(self.code).strip("\n"), None
            self._add("code", text, code_language=self.language)
            self.language = None
        if tag not in self.stack:
            return
        if self.code is not None:
            if tag == "code":
                self._close(tag)
            return
        if not self._hidden():
            if tag == "a" and self.link is not None:
                text = re.sub(r"\s+", " ", "".join(self.parts[self.link[1] :])).strip()
                if text:
                    self.links.append({"text": text[:MAX_LINK_TEXT], "href": self.link[0]})
                self.link = None
            if tag in _BLOCK:
                self._flush()
            if tag in ("ul", "ol") and self.items is not None:
                self.depth -= 1
                if self.depth == 0:
                    items, self.items = [re.sub(r"\s+", " ", i).strip() for i in self.items], None
                    self._add("list", "\n".join("- " + i for i in items if i))
            elif tag == "table" and self.rows is not None:
                rows, self.rows = self.rows, None
                self._add("table", "\n".join(" | ".join(re.sub(r"\s+", " ", c).strip() for c in r) for r in rows if any(c.strip() for c in r)))
            elif tag == "figure" and self.figure is not None:
                f, self.figure = self.figure, None
                if f.get("image_uri"):
                    self._add("image", f.get("caption") or "", image_uri=f["image_uri"], caption=f.get("caption"))
        self._close(tag)

    def handle_data(self, data):
        if self.in_title:
            self.title = (self.title or "") + data
        elif self.code is not None:
            self.code.append(data)
        elif not self._hidden() and "head" not in self.stack:
            self.parts.append(data)


def walk(html: str | None, bare: bool = True) -> list[dict]:
    """Blocks of a page in order, main ones marked; missing types of the main part come after it.

    References without their semicolon are decoded as browsers do; without ``bare`` they stay, as in ``unescape``.
    """
    if not html:
        return []
    if not bare:
        html = _BARE.sub(lambda m: "&amp;" if m[0] == "&" else m[0], html)
    w = _Walk()
    w.feed(html)
    w.close()
    w._flush()
    if not any(b["main"] for b in w.blocks):
        return [{**b, "main": True} for b in w.blocks]
    main = [b for b in w.blocks if b["main"]]
    have, seen = {b["type"] for b in main}, {(b["type"], b["text"]) for b in main}
    more = [b for b in w.blocks if not b["main"] and b["type"] in ("list", "table", "code", "image") and b["type"] not in have and (b["type"], b["text"]) not in seen]
    return main + more


def html_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str | None = "url", bare: bool = True) -> DataFrame:
    """Block rows of pages: ord, type, text, level, links and the rest, with section paths and the page's URL on each; ``bare`` as in ``walk``."""
    keep = [id_col] + ([url_col] if url_col else [])
    src = pages.select(*keep, F.col(html_col).alias("__html"))
    schema = T.StructType([*[src.schema[c] for c in keep], T.StructField("blocks", BLOCK_TYPE)])
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(BLOCK_TYPE)

    def run(batches):
        for b in batches:
            made = pa.array([walk(h, bare) for h in b.column(len(keep)).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], made], names=[*keep, "blocks"])

    rows = src.mapInArrow(run, schema).select(F.col(id_col).alias("artifact"), *([F.col(url_col).alias("url")] if url_col else []), F.posexplode("blocks").alias("pos", "b"))
    rows = rows.select("artifact", *(["url"] if url_col else []), (F.col("pos") + 1).alias("ord"), "b.*")
    out = with_section_path(rows)
    # what was taken from outside the main part has no place in it
    return out.withColumn("section_path", F.when(F.col("main"), F.col("section_path")).otherwise(F.array().cast("array<string>"))).withColumn("block_id", F.concat(F.lit("b"), padded(F.col("ord"))))


@parser("html")
def html_rows(rows: DataFrame) -> DataFrame:
    return html_blocks(rows.select("artifact", F.decode("data", "UTF-8").alias("html")), "artifact", "html", None)


def unescape(text: Column) -> Column:
    """The five named references and the blank one; numeric ones stay."""
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def page_title(html: Column) -> Column:
    return F.nullif(F.trim(unescape(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))), F.lit(""))


def meta_content(html: Column, name: str) -> Column:
    """Content of a <meta> with that name or property."""
    tag = F.regexp_extract(html, rf"(?is)<meta[^>]*(?:name|property)=[\"']{re.escape(name)}[\"'][^>]*>", 0)
    return F.nullif(F.trim(unescape(F.regexp_extract(tag, r"(?is)content=[\"']([^\"']*)[\"']", 1))), F.lit(""))


def strip_site(title: Column, site: Column) -> Column:
    """A title without a tail of at most 40 characters after a separator that names the site; four characters must be left."""
    head = F.regexp_extract(title, r"(?s)^(.*)\s+[|\-–—·]\s+(.{1,40})$", 1)
    tail = F.regexp_extract(title, r"(?s)^(.*)\s+[|\-–—·]\s+(.{1,40})$", 2)
    a, b = F.lower(F.regexp_replace(tail, r"\W", "")), F.lower(F.regexp_replace(F.coalesce(site, F.lit("")), r"\W", ""))
    same = (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))
    return F.when(same & (F.length(head) >= 4), head).otherwise(title)


def page_metadata(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """Title (page, then og:title, then the first heading), author, date, site name and URL of each page."""
    h = F.col(html_col)
    site = F.coalesce(meta_content(h, "og:site_name"), F.regexp_replace(F.try_parse_url(F.col(url_col), F.lit("HOST")), r"^www\.|\.\w+$", ""))
    heading = F.nullif(F.trim(unescape(F.regexp_replace(F.regexp_extract(h, r"(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]*>", ""))), F.lit(""))
    title = F.coalesce(strip_site(page_title(h), site), meta_content(h, "og:title"), heading)
    return pages.select(F.col(id_col), title.alias("title"), meta_content(h, "author").alias("author"), meta_content(h, "article:published_time").alias("date"), site.alias("sitename"), F.col(url_col).alias("url"))


def page_links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, position, href, text) of anchors that lead out of the page, the first twenty; text of at most 200 characters."""
    tags = F.filter(F.regexp_extract_all(html_col, F.lit(r"(?is)<a\s[^>]*href=\"[^\"#][^\"]*\"[^>]*>[^<]*</a>"), F.lit(0)), lambda t: t != "")
    rows = pages.select(F.col(id_col), F.posexplode(F.slice(tags, 1, MAX_LINKS)).alias("pos", "tag"))
    return rows.select(id_col, (F.col("pos") + 1).alias("position"), F.regexp_extract("tag", r'(?is)href="([^"]*)"', 1).alias("href"), F.substring(F.regexp_extract("tag", r"(?is)>([^<]*)</a>", 1), 1, MAX_LINK_TEXT).alias("text"))


def numbered(blocks: DataFrame) -> DataFrame:
    """Blocks with ord from 1 again, after rows went."""
    return blocks.withColumn("ord", F.row_number().over(Window.partitionBy("artifact").orderBy("ord")))
