"""Document queries: routing, parsing, cleaning, quality, chunks, PDF structure on inline fixtures, streams' batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmere.functions import text as tx
from quillmere.functions.tables import dealt_by_fewer_keys, staged
from quillmere.operators import blocks as bl
from quillmere.operators import chunk as ch
from quillmere.operators import evaluate as ev
from quillmere.operators import index as ix
from quillmere.operators import page_chars as pc
from quillmere.operators import parse_html as ph
from quillmere.operators import parse_text as pt
from quillmere.operators import pdf_lines as pl
from quillmere.operators import segment as sg
from quillmere.params import ChunkParams
from quillmere.plans.retrieval import docs, table
from quillmere.sources import readers as rd
from quillmere.sources import route as ro
from quillmere.streaming import ingest as st

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def pages(spark, sf):
    return table(spark, sf, "pages")


# ---- SQL parts ------------------------------------------------------------

_LINES = "lines as (select doc_id as artifact, i as ord, string_split(text, chr(10))[i] as text from documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) r(i))"


def _clean(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '[\\x{{200b}}\\x{{feff}}]', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))"


_BOILER = "regexp_matches({0}, '" + tx.BOILERPLATE_PATTERN + "')"
_TOC = f"'{tx.TOC_ENTRY_PATTERN}'"
_TOKEN_LEN = r"len(regexp_extract_all({0}, '[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}]'))"
_CLEAN_LINES = f"{_LINES}, c1 as (select artifact, ord, {_clean('text')} as text from lines), c2 as (select * from c1 where text <> '' and not (length(text) < 300 and {_BOILER.format('text')})), c3 as (select *, lag(text) over (partition by artifact order by ord) as prev from c2), cleaned as (select artifact, row_number() over (partition by artifact order by ord) as ord, text from c3 where prev is null or prev <> text)"


# ---- text -----------------------------------------------------------------


@query(f"select doc_id, md5({_clean('text')}) as digest, length({_clean('text')})::bigint as n_chars from documents")
def q_clean_text(spark, sf):
    c = tx.clean_text(F.col("text"))
    return docs(spark, sf).select("doc_id", F.md5(c).alias("digest"), F.length(c).cast("long").alias("n_chars"))


@query(f"with {_LINES} select artifact, ord::int as ord from lines where length(text) < 300 and {_BOILER.format('text')}")
def q_boilerplate(spark, sf):
    return bl.line_blocks(docs(spark, sf)).where(tx.is_boilerplate(F.col("text"))).select("artifact", "ord")


@query(f"with {_CLEAN_LINES} select artifact, count(*) as n_blocks, md5(string_agg(text, chr(10) order by ord)) as digest from cleaned group by artifact")
def q_adjacent_dedupe(spark, sf):
    """The whole block cleaning on lines: empties, boilerplate and adjacent repeats go."""
    b = bl.clean_blocks(bl.line_blocks(docs(spark, sf)))
    return b.groupBy("artifact").agg(F.count("*").alias("n_blocks"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n")).alias("digest"))


@query(f"with l as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S')) as ls from documents) select doc_id, len(ls) >= 5 and len(list_filter(ls, lambda x: regexp_matches(x, {_TOC}))) * 2 >= len(ls) as toc from l")
def q_toc_flag(spark, sf):
    return docs(spark, sf).select("doc_id", tx.is_toc(F.col("text")).alias("toc"))


@query(r"select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\[([^\]\[]+)\]\([^)\s]*\)', '\1', 'g'), '(?s)\*{1,3}(\S|\S.*?\S)\*{1,3}', '\1', 'g'), '\s+([,.;:!?])', '\1', 'g'), '\s+', ' ', 'g')) as text from (select doc_id, '[a **link** of](https://x/' || doc_id || ') , *' || source || '* then **' || text || '** 2 * 3 * 4' as text from documents)")
def q_metric_normalize(spark, sf):
    """Gold-matching text of documents within a link and star emphasis (marks of the other kinds need look-around, which the SQL lacks: q_metric_emphasis)."""
    marked = F.concat(F.lit("[a **link** of](https://x/"), "doc_id", F.lit(") , *"), "source", F.lit("* then **"), "text", F.lit("** 2 * 3 * 4"))
    return docs(spark, sf).select("doc_id", tx.metric_text(marked).alias("text"))


_SAID = "source || ' of ' || doc_id"


@query(
    f"select doc_id, {_SAID} || ' then ' || lang || ', ' || source || ' but ' || source || '_' || lang || '_' || doc_id || ' stays; ' || lang || ' ' || {_SAID} || '! 2 _ ' || doc_id || ' _ 4 _' || lang || '_' as text "
    "from (select doc_id, coalesce(source, '-') as source, coalesce(lang, '-') as lang from documents)"
)
def q_metric_emphasis(spark, sf):
    """Emphasis by underscores and back quotes, which look around: paired marks go at the edges of words, those within words stay, and what is uncovered stays."""
    d = docs(spark, sf).select("doc_id", F.coalesce("source", F.lit("-")).alias("source"), F.coalesce("lang", F.lit("-")).alias("lang"))
    raw = F.format_string("__%1$s of %2$d__  then _%3$s_ , `%1$s`\nbut %1$s_%3$s_%2$d stays; ___%3$s %1$s of %2$d___ ! 2 _ %2$d _ 4 *_%3$s_*", "source", "doc_id", "lang")
    return d.select("doc_id", tx.metric_text(raw).alias("text"))


_NOISY = "'<!-- Image -->' || chr(10) || '![a chart](b.png)  ' || chr(10) || '1.1. ' || source || ' ..... ' || doc_id || chr(10) || '. . . . . . . chapter' || chr(10) || '  12 ' || chr(10) || '# ' || source || chr(10) || '2.1 Part 7' || chr(10) || text || chr(10) || chr(10) || '   ' || chr(10) || '…………··········' || chr(10) || 'end .. 3'"


@query(
    f"with l as (select doc_id, list_transform(string_split({_NOISY}, chr(10)), lambda x: rtrim(x, ' ' || chr(9))) as ls from documents), k as (select doc_id, list_filter(ls, lambda x: not (trim(x) = '<!-- Image -->' or regexp_matches(ltrim(x), '^[\\s.·…]{{10}}') or (regexp_matches(ltrim(x), '[.][.][.]\\s*[0-9]+$') and regexp_matches(ltrim(x), '^.{{0,80}}[.]{{3,}}\\s*[0-9]+$')) or (length(trim(x)) between 1 and 4 and regexp_full_match(trim(x), '[0-9]+')))) as ls from l) "
    "select doc_id, trim(regexp_replace(array_to_string(ls, chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9)) as text from k"
)
def q_markdown_line_clean(spark, sf):
    """Documents within lines of each kind that the cleaning drops, and such as look alike and stay."""
    lines = ["<!-- Image -->", "![a chart](b.png)  ", ("1.1. ", "source", " ..... ", "doc_id"), ". . . . . . . chapter", "  12 ", ("# ", "source"), "2.1 Part 7", ("", "text"), "", "   ", "…………··········", "end .. 3"]
    cols = [F.lit(x) if isinstance(x, str) else F.concat(*[F.col(v) if k % 2 else F.lit(v) for k, v in enumerate(x)]) for x in lines]
    return docs(spark, sf).select("doc_id", tx.clean_markdown_lines(F.concat_ws("\n", *cols)).alias("text"))


@query("with c as (select doc_id, len(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]')) as z, len(regexp_extract_all(text, '[A-Za-z]')) as l from documents) select doc_id, case when greatest(z, l) = 0 then 'unknown' when least(z, l) > greatest(z, l) * 0.15 then 'mixed' when z > l then 'zh' else 'en' end as language from c")
def q_language_guess(spark, sf):
    return docs(spark, sf).select("doc_id", tx.guess_language(F.col("text")).alias("language"))


@query(f"with {_LINES}, f as (select artifact, ord, text from lines where text <> '') select artifact, ord::int as ord, md5(string_agg(text, ' ') over (partition by artifact order by ord rows between 1 preceding and 1 following)) as digest from f")
def q_sentence_windows(spark, sf):
    rows = bl.line_blocks(docs(spark, sf)).where("text <> ''")
    return ch.sentence_windows(rows, "artifact", "ord", "text", 1).select("artifact", "ord", F.md5("window").alias("digest"))


@query(f"with {_LINES}, f as (select artifact, ord, row_number() over (partition by artifact order by ord) as n, last_value(case when length(text) < 40 then text end ignore nulls) over (partition by artifact order by ord) as h from lines where text <> '') select artifact, ord::int as ord, concat_ws(' | ', h, 'p.' || ((n - 1) // 14 + 1)) as prefix from f")
def q_metadata_prefix(spark, sf):
    rows = bl.line_blocks(docs(spark, sf)).where("text <> ''").withColumn("heading", F.when(F.length("text") < 40, F.col("text")))
    return ch.metadata_prefixes(rows, "artifact", "ord", "heading").select("artifact", "ord", "prefix")


@query(
    f"with recursive {_LINES}, t as (select artifact, row_number() over w as i, ord, length(text) as size, (length(text) % 97) / 97.0::double as dist, sum(length(text)) over w as cum, count(*) over (partition by artifact) as n from lines where text <> '' window w as (partition by artifact order by ord)), "
    "e as (select t.artifact, t.i, t.n, max(u.i) as last, max(u.cum) as cum from t join t u on u.artifact = t.artifact and u.i between t.i and t.i + 1200 and (u.i = t.i or u.cum - t.cum + t.size <= 1200) group by t.artifact, t.i, t.n), "
    "c as (select e.artifact, e.i, case when e.last = e.n then e.n else coalesce(max_by(u.i, u.dist * 1e6 + u.i * 1e-3) filter (u.i > e.i), e.last) end as cut from e join t u on u.artifact = e.artifact and u.i between e.i and e.last and (u.i = e.i or e.cum - u.cum <= 400) group by e.artifact, e.i, e.n, e.last), "
    "walk as (select artifact, i, cut, 0 as chunk from c where i = 1 union all select c.artifact, c.i, c.cut, w.chunk + 1 from walk w join c on c.artifact = w.artifact and c.i = w.cut + 1) "
    "select w.artifact, w.chunk::int as chunk, a.ord::bigint as first, b.ord::bigint as last from walk w join t a on a.artifact = w.artifact and a.i = w.i join t b on b.artifact = w.artifact and b.i = w.cut"
)
def q_length_cuts(spark, sf):
    """Length-first cuts with the choice within a back window; distances are the change in line length."""
    rows = bl.line_blocks(docs(spark, sf)).where("text <> ''").withColumn("distance", (F.length("text") % 97) / 97.0)
    return ch.cut_points(rows, "artifact", "ord", "text", "distance", 1200, 400)


# ---- characters of pages --------------------------------------------------

_CHARS = """laid as (select item_id as artifact, i, substr(text, i + 1, 1) as text, i // 60 as l, i % 60 as c from benchmark, unnest(range(length(text))) t(i)),
drawn as (select artifact, l // 20 as page, i * 3 + d as n, text, c * 5 + 40 + d * 0.75::double + (case when c % 20 > 9 then 4 else 0 end) as x0, (l % 20) * 12 + 50 + (i % 3) * 0.5::double + d * 0.5::double as top, c * 5 + 44.5::double + d * 0.75::double + (case when c % 20 > 9 then 4 else 0 end) as x1,
  case when l % 20 = 0 then 14.0 else 10.0 end::double as size, case when i % 4 = 0 then 'Bold' else 'Plain' end as font from laid, unnest(range(3)) t(d) where d = 0 or (i % 7 = 0 and d = 1) or (i % 14 = 0 and d = 2)),
y as (select *, sum(new) over (partition by artifact, page, text, font, size order by top, n rows unbounded preceding) as yi from (select *, coalesce(top - lag(top) over (partition by artifact, page, text, font, size order by top, n) > 1.5, true)::int as new from drawn)),
x as (select * exclude (new), sum(new) over (partition by artifact, page, text, font, size, yi order by x0, n rows unbounded preceding) as xi from (select * exclude (new), coalesce(x0 - lag(x0) over (partition by artifact, page, text, font, size, yi order by x0, n) > 1.5, true)::int as new from y)),
chars as (select artifact, page, n, text, x0, top, x1, size, font from x qualify n = min(n) over (partition by artifact, page, text, font, size, yi, xi)),
lined as (select * exclude (new), sum(new) over (partition by artifact, page order by top, n rows unbounded preceding) as l from (select *, coalesce(top - lag(top) over (partition by artifact, page order by top, n) > 3, true)::int as new from chars)),
parted as (select *, trim(text) <> '' as seen, max(case when trim(text) <> '' then x1 end) over (partition by artifact, page, l order by x0, n rows between unbounded preceding and 1 preceding) as before from lined),
said as (select artifact, page, l, trim(regexp_replace(string_agg(case when seen and x0 - before > 3 then ' ' else '' end || text, '' order by x0, n), '\\s+', ' ', 'g')) as text, round_even(min(x0) filter (seen), 1) as x0, round_even(min(top) filter (seen), 1) as y0, round_even(max(x1) filter (seen), 1) as x1, round_even(max(size) filter (seen), 1) as size from parted group by artifact, page, l),
fonts as (select artifact, page, l, font from (select artifact, page, l, font, count(*) as c, min((x0, n)) as f from parted where seen group by all) qualify row_number() over (partition by artifact, page, l order by c desc, f) = 1)"""


@query(f"with {_CHARS} select artifact, page::int as page, (row_number() over (partition by artifact, page order by round_even(y0, 0), x0, l))::int as line_no, text, x0, y0, x1, size, font from said join fonts using (artifact, page, l) where text <> ''")
def q_char_lines(spark, sf):
    """Lines of passages laid out as characters on pages, some drawn twice or three times, with wide gaps and uneven tops."""
    i, c, line = F.col("i"), F.col("i") % 60, F.floor(F.col("i") / 60).cast("int")
    laid = table(spark, sf, "benchmark").where("length(text) > 0").select(F.col("item_id").alias("artifact"), "text", F.explode(F.sequence(F.lit(0), F.length("text") - 1)).alias("i"))
    times = F.when(i % 14 == 0, 2).when(i % 7 == 0, 1).otherwise(0)
    drawn = laid.select("artifact", i, F.substring(F.col("text"), i + 1, F.lit(1)).alias("text"), c.alias("c"), line.alias("l"), F.explode(F.sequence(F.lit(0), times)).alias("d"))
    shift = F.col("d") * 0.75 + F.when(F.col("c") % 20 > 9, 4).otherwise(0)
    top = (F.col("l") % 20) * 12 + 50 + (i % 3) * 0.5 + F.col("d") * 0.5
    chars = drawn.select(
        "artifact", F.floor(F.col("l") / 20).cast("int").alias("page"), (i * 3 + F.col("d")).alias("n"), "text", (F.col("c") * 5 + 40 + shift).alias("x0"), top.alias("top"), (F.col("c") * 5 + 44.5 + shift).alias("x1"), (top + 10.0).alias("bottom"),
        F.when(F.col("l") % 20 == 0, 14.0).otherwise(10.0).alias("size"), F.when(i % 4 == 0, "Bold").otherwise("Plain").alias("font"),
    )
    return pc.char_lines(pc.unique_chars(chars)).drop("y1")


# ---- words of CJK text ----------------------------------------------------

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_SIGNS = "".join(chr(0x4E00 + 97 * k) for k in range(26))
_RUNS = f"runs as (select item_id, unnest(rs) as run, unnest(range(len(rs))) as place from (select item_id, regexp_extract_all(replace(translate(lower(text), '{_LETTERS}', '{_SIGNS}'), ' ', ''), '[\\x{{4e00}}-\\x{{9fff}}]+') as rs from benchmark))"
_LEARNED = f"""{_RUNS}, places as (select run, unnest(range(1, length(run) + 1)) as i from runs), grams as (select substr(run, i, k) as gram, k, count(*) as n from places, unnest(range(1, 6)) t(k) where i + k - 1 <= length(run) group by 1, 2),
total as (select coalesce(sum(n), 0)::bigint as total from grams where k = 1), cuts as (select gram, n, substr(gram, 1, c) as a, substr(gram, c + 1) as b from grams, unnest(range(1, 4)) t(c) where k between 2 and 4 and n >= 4 and c < k),
tied as (select cuts.gram, cuts.n from cuts join grams x on x.gram = a join grams y on y.gram = b, total group by cuts.gram, cuts.n having min(cuts.n * total::double / (x.n * y.n)) >= 3),
around as (select gram, max(m) as m from (select substr(gram, 1, k - 1) as gram, n as m from grams where k > 2 and n >= 4 union all select substr(gram, 2), n from grams where k > 2 and n >= 4) group by gram),
words as (select gram as word, n from grams where k = 1 union all select tied.gram, tied.n from tied left join around using (gram) where coalesce(m, 0) <= 0.8::double * tied.n)"""


def _signs(spark, sf):
    """Benchmark passages as CJK text: a sign for each letter, no blanks."""
    return table(spark, sf, "benchmark").select("item_id", F.replace(F.translate(F.lower("text"), _LETTERS, _SIGNS), F.lit(" "), F.lit("")).alias("text"))


@query(f"with {_LEARNED} select word, n::bigint as n from words")
def q_word_dictionary(spark, sf):
    """Words learned from text without blanks."""
    return sg.learn_words(_signs(spark, sf), "text", 4, 4, 3.0)


@query(
    f"""with recursive {_LEARNED}, whole as (select sum(n)::double as whole from words), table_ as (select map(list(word), list(ln(n / whole))) as m, ln(1 / any_value(whole)) as unknown from words, whole),
distinct_runs as (select distinct run, length(run) as len from runs),
dp as (select run, len, len as i, [0.0::double] as tail, 0 as step from distinct_runs union all
  select run, len, i - 1, list_prepend(list_max(c), tail[1:3]), 5 - list_position(list_reverse(c), list_max(c)) from (
    select run, len, i, tail, [coalesce(m[substr(run, i, 1)], unknown) + tail[1], case when i + 1 <= len then m[substr(run, i, 2)] + tail[2] end, case when i + 2 <= len then m[substr(run, i, 3)] + tail[3] end, case when i + 3 <= len then m[substr(run, i, 4)] + tail[4] end] as c
    from dp, table_ where i > 0)),
walk as (select run, i, step from dp where i = 0 union all select dp.run, dp.i, dp.step from walk join dp on dp.run = walk.run and dp.i = walk.i + walk.step where dp.i < dp.len),
split as (select run, string_agg(substr(run, i + 1, step), ' ' order by i) as said, count(*) as n from walk group by run)
select item_id, sum(n)::bigint as n_words, md5(string_agg(said, ' ' order by place)) as digest from runs join split using (run) group by item_id"""
)
def q_word_split(spark, sf):
    """The likeliest words of text without blanks, by the dictionary learned from it."""
    rows = _signs(spark, sf)
    words = sg.Dictionary(sg.learn_words(rows, "text", 4, 4, 3.0))
    found = F.regexp_extract_all(words.spaced(F.col("text")), F.lit(sg.RUN), F.lit(0))
    return rows.select("item_id", found.alias("w")).where(F.size("w") > 0).select("item_id", F.size("w").cast("long").alias("n_words"), F.md5(F.array_join("w", " ")).alias("digest"))


# ---- quality --------------------------------------------------------------

_QUALITY = f"""{_LINES}, m as (select artifact, count(*) as block_count, sum(length(text)) + greatest(count(*) filter (text <> '') - 1, 0) as char_count, count(distinct md5(trim(text))) filter (trim(text) <> '') as kinds, count(*) filter (trim(text) <> '') as filled, sum(len(regexp_extract_all(text, '[\\x{{fffd}}\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]'))) as bad from lines group by artifact),
q as (select m.*, case when filled > 0 then 1.0::double - kinds::double / filled else 0 end as dup, bad::double / greatest(char_count, 1) as g, d.source = 'src0' as untitled from m join documents d on d.doc_id = m.artifact),
s as (select *, greatest(0::double, least(1::double, 1.0::double - (case when char_count < 100 then 0.45::double else 0 end) - (case when char_count < 300 then 0.15::double else 0 end) - dup * 0.30::double - least(g * 5, 0.40::double) - (case when untitled then 0.05::double else 0 end))) as raw from q),
r as (select artifact, block_count, char_count::bigint as char_count, round(dup, 4) as duplicate_ratio, round(g, 6) as garbled_ratio, round(raw, 4) as score, case when block_count = 0 or char_count = 0 then 'reject' when raw >= 0.85 then 'high' when raw >= 0.60 then 'medium' when raw >= 0.35 then 'low' else 'reject' end as status,
array_to_string(list_filter([case when block_count = 0 then 'no_blocks' end, case when char_count < 100 then 'very_short_text' end, case when char_count < 300 then 'low_content' end, case when dup > 0.35 then 'high_duplicate_ratio' end, case when g > 0.01 then 'garbled_text' end, case when untitled then 'missing_title' end], lambda x: x is not null), ',') as flags from s)"""


def _assessed(spark, sf):
    arts = docs(spark, sf).select(F.col("doc_id").alias("artifact"), F.when(F.col("source") != "src0", F.col("source")).alias("title"), F.lit("local_file").alias("source_type"), F.lit("text/plain").alias("mime"))
    return bl.quality(bl.line_blocks(docs(spark, sf)), arts)


@query(f"with {_QUALITY} select * from r")
def q_quality_report(spark, sf):
    return _assessed(spark, sf).select("artifact", F.col("block_count"), F.col("char_count").cast("long").alias("char_count"), "duplicate_ratio", "garbled_ratio", "score", "status", F.array_join("flags", ",").alias("flags"))


_DECISION = "status as tier, status <> 'reject' as dense_index, status in ('high', 'medium') as sparse_index, case status when 'high' then 1.0 when 'medium' then 0.6 else 0.0 end::double as sparse_weight, case status when 'low' then 0.2 when 'reject' then 1.0 else 0.0 end::double as rerank_penalty, status in ('low', 'reject') as review_required"


@query(f"with {_QUALITY} select artifact, {_DECISION} from r")
def q_index_decision(spark, sf):
    return _assessed(spark, sf).select("artifact", bl.index_decision(F.col("status")).alias("d")).select("artifact", "d.*")


@query(f"with {_QUALITY} select status, count(*) filter (status <> 'reject') as dense, count(*) filter (status in ('high', 'medium')) as sparse from r join documents d on d.doc_id = r.artifact where trim(d.text) <> '' group by status having count(*) filter (status <> 'reject') > 0")
def q_admission(spark, sf):
    """Documents admitted to each index, by status."""
    rows = _assessed(spark, sf).select("artifact", "status", bl.index_decision(F.col("status")).alias("index_decision")).join(docs(spark, sf).select(F.col("doc_id").alias("artifact"), "text"), "artifact")
    dense = bl.admitted(rows, "dense", "text").select("status", F.lit(1).alias("d"), F.lit(0).alias("s"))
    sparse = bl.admitted(rows, "sparse", "text").select("status", F.lit(0).alias("d"), F.lit(1).alias("s"))
    return dense.unionByName(sparse).groupBy("status").agg(F.sum("d").alias("dense"), F.sum("s").alias("sparse"))


# ---- sources and pages ----------------------------------------------------


@query("select page_id, 'text/html' as mime_type, octet_length(encode(html))::bigint as size_bytes, sha256(html) as sha256, 'html' as parser, case when contains(lower(html), '<pre') or contains(lower(html), '<code') then 'code_heavy' else 'article' end as mode from pages")
def q_route(spark, sf):
    p = rd.payloads(pages(spark, sf).select("page_id", F.lit("url").alias("source_type"), F.col("url").alias("uri"), F.encode("html", "UTF-8").alias("data"), F.lit("application/octet-stream").alias("declared")))
    r = p.withColumn("r", ro.route(F.col("data"), F.col("mime_type"), F.col("uri")))
    return r.select("page_id", "mime_type", "size_bytes", "sha256", "r.parser", "r.mode")


_ROUTED = [
    ("a", "%PDF-1.7 x", "application/octet-stream", "f.bin", "application/pdf", "pdf_lines"), ("b", "  <!DOCTYPE html><p>", "", "f", "text/html", "html"), ("c", "# T", "", "n.md", "text/markdown", "markdown"), ("d", "plain", "text/plain; charset=x", "n", "text/plain", "plain"),
    ("e", "PK\x03\x04", "", "d.docx", "application/zip", "office"), ("f", "x", "", "a.rst", "text/x-rst", "plain"), ("g", "x", "", "a.bin", "application/octet-stream", "unsupported"), ("h", "x <HTML> y", "", "q.txt", "text/html", "html"),
]


@query(
    "select doc_id, case when kind = 0 then 'json:accepted' when kind = 3 then 'json:error, plain:' || done when kind = 1 then 'office:unsupported, markdown:' || done else 'markdown:' || done end as attempts, "
    "kind = 0 or done = 'accepted' as accepted from (select doc_id, doc_id % 6 % 4 as kind, case when regexp_matches(text, '\\S') then 'accepted' else 'rejected' end as done from documents)"
)
def q_parse_fallbacks(spark, sf):
    """What the chain of parsers tried for each document: some are JSON exports, some only said to be, some of a kind without a parser."""
    kind = F.col("doc_id") % 6 % 4
    export = F.concat(F.lit('{"blocks": [{"type": "text", "text": "of '), F.col("doc_id").cast("string"), F.lit('"}]}'))
    name = F.when(kind.isin(0, 3), "json").when(kind == 1, "office").otherwise("markdown")
    fallbacks = F.when(kind == 3, F.array(F.lit("plain"))).when(kind == 1, F.array(F.lit("markdown"))).otherwise(F.array().cast("array<string>"))
    data = F.encode(F.when(kind == 0, export).otherwise(F.col("text")), "UTF-8")
    routed = docs(spark, sf).select(F.col("doc_id").alias("artifact"), name.alias("parser"), fallbacks.alias("fallbacks"), data.alias("data"))
    _, attempts = ro.parse_chain(routed, lambda b: b.groupBy("artifact").count())
    listed = ro.attempt_lists(attempts)
    return listed.select(F.col("artifact").alias("doc_id"), F.array_join(F.transform("attempts", lambda x: F.concat(x["parser"], F.lit(":"), x["outcome"])), ", ").alias("attempts"), "accepted")


@query("select doc_id, mime_type, parser from documents join (values " + ", ".join(f"({k}, '{r[4]}', '{r[5]}')" for k, r in enumerate(_ROUTED)) + f") t(k, mime_type, parser) on doc_id % {len(_ROUTED)} = k")
def q_route_fixture(spark, sf):
    """Types and parsers of payloads of all kinds; documents are dealt to the kinds by their ids, which stand in the payloads."""
    kinds = spark.createDataFrame([(k, *r[1:4]) for k, r in enumerate(_ROUTED)], "k int, body string, declared string, path string")
    rows = docs(spark, sf).withColumn("k", (F.col("doc_id") % len(_ROUTED)).cast("int")).join(F.broadcast(kinds), "k").withColumn("data", F.encode(F.concat("body", F.lit(" "), F.coalesce("lang", F.lit("-")), "doc_id"), "UTF-8"))
    mime = rd.sniff_mime(F.col("data"), F.col("declared"), F.concat(F.lit("d"), "doc_id", F.lit("/"), "path"))
    return rows.select("doc_id", mime.alias("mime_type"), ro.route(F.col("data"), mime, F.col("path"))["parser"].alias("parser"))


@query("select page_id, 'doc_' || substr(sha256(trim(url)), 1, 12) as artifact from pages")
def q_artifact_id(spark, sf):
    return pages(spark, sf).select("page_id", tx.artifact_id(F.col("url"), F.col("url"), F.sha2("html", 256)).alias("artifact"))


#: Addresses and why they must not be fetched.
_HOSTS = [
    ("http://127.0.0.1/x", "private"), ("https://10.1.2.3:8080/", "private"), ("http://192.168.0.1", "private"), ("http://172.16.9.9/", "private"), ("http://172.32.0.1/", "ok"), ("http://169.254.169.254/latest", "private"),
    ("http://localhost/", "private"), ("http://a.localhost/", "private"), ("http://[::1]/", "private"), ("ftp://example.org/", "scheme"), ("file:///etc/passwd", "scheme"), ("", "scheme"), ("https://Example.org/a", "ok"), ("http://11.0.0.1/", "ok"), ("http://localhost.example.org/", "ok"),
]


@query(
    "with u as (select case page_id % 6 when 0 then url when 1 then 'http://10.' || page_id % 250 || '.0.1/' || page_id when 2 then 'ftp' || substr(url, strpos(url, ':')) when 3 then 'http://localhost:' || page_id || '/' when 4 then 'https://172.' || page_id % 40 || '.1.1/' else 'http://192.168.1.' || page_id % 250 || '/' end as url, page_id from pages) "
    "select case when page_id % 6 = 2 then 'scheme' when page_id % 6 in (1, 3, 5) or (page_id % 6 = 4 and page_id % 40 between 16 and 31) then 'private' else 'ok' end as problem, count(*) as n from u group by 1"
)
def q_host_guard(spark, sf):
    """Addresses of pages, five of six in forms that a guard looks at, by what is wrong with them."""
    k = F.col("page_id") % 6
    made = (
        F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("http://10."), F.col("page_id") % 250, F.lit(".0.1/"), "page_id")).when(k == 2, F.regexp_replace("url", "^[a-z]+:", "ftp:"))
        .when(k == 3, F.concat(F.lit("http://localhost:"), "page_id", F.lit("/"))).when(k == 4, F.concat(F.lit("https://172."), F.col("page_id") % 40, F.lit(".1.1/"))).otherwise(F.concat(F.lit("http://192.168.1."), F.col("page_id") % 250, F.lit("/")))
    )
    return pages(spark, sf).groupBy(F.coalesce(rd.host_problem(made), F.lit("ok")).alias("problem")).agg(F.count("*").alias("n"))


@query("select page_id, problem from pages join (values " + ", ".join(f"({k}, '{v}')" for k, (_, v) in enumerate(_HOSTS)) + f") t(k, problem) on page_id % {len(_HOSTS)} = k")
def q_host_guard_fixture(spark, sf):
    """Addresses of each form that the guard knows, with pages' ids as queries."""
    forms = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(_HOSTS)], "k int, form string")
    rows = pages(spark, sf).withColumn("k", (F.col("page_id") % len(_HOSTS)).cast("int")).join(F.broadcast(forms), "k")
    return rows.select("page_id", F.coalesce(rd.host_problem(F.when(F.col("form") == "", "").otherwise(F.concat("form", F.lit("?page="), "page_id"))), F.lit("ok")).alias("problem"))


@query("select doc_id, source, length(text)::bigint as n_chars from documents where doc_id > 40 order by doc_id limit 25")
def q_scroll(spark, sf):
    """A page of a stored table: the 25 rows after a key."""
    rows = docs(spark, sf).select("doc_id", "source", F.length("text").cast("long").alias("n_chars"))
    return rd.scroll(rows, "doc_id", 40, 25)


@query("select artifact, ord::int as ord, type, (max(case when type = 'heading' then ord end) over (partition by artifact order by ord rows between unbounded preceding and 1 preceding))::int as parent_ord from (select doc_id as artifact, i as ord, case when length(string_split(text, chr(10))[i]) < 40 then 'heading' else 'text' end as type from documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) r(i))")
def q_parent_pointer(spark, sf):
    """Lines with the number of the heading before them; lines of under 40 characters count as headings."""
    lines = bl.line_blocks(docs(spark, sf)).withColumn("type", F.when(F.length("text") < 40, "heading").otherwise("text")).withColumn("level", F.when(F.col("type") == "heading", 1))
    return bl.with_section_path(lines).select("artifact", "ord", "type", F.col("parent_ord").cast("int").alias("parent_ord"))


#: Lines of a page, entries of an outline and the level that each line takes from it: by name, by a similar name a page off at most, or none.
_OUTLINE = [("Chapter One: Getting Started", 1, 0), ("Installation of the Service", 2, 3), ("Configuration and Monitoring", 2, 9)]
_NAMED = [("Chapter One: Getting Started", 0, 1), ("chapter one getting started", 1, 1), ("Installation of the Services", 3, 2), ("Installation of the Services", 4, 2), ("Installation of the Services", 6, None), ("Configuration and Tuning", 9, None), ("Body text of no heading at all", 3, None)]


@query("select * from (values " + ", ".join(f"({k}::int, {v}::int)" for k, (_, _, v) in enumerate(_NAMED) if v) + ") t(line_no, level)")
def q_outline_fuzzy(spark, sf):
    lines = spark.createDataFrame([("a", p, k, t) for k, (t, p, _) in enumerate(_NAMED)], "artifact string, page int, line_no int, text string")
    outline = spark.createDataFrame([("a", n, t, p) for t, n, p in _OUTLINE], "artifact string, level int, title string, page int")
    return pl.outline_matches(lines, outline).select("line_no", F.col("level").cast("int").alias("level"))


@query("select page_id, coalesce(nullif(list_last(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> '')), ''), url) as file_name from pages")
def q_source_name(spark, sf):
    none = F.lit(None).cast("string")
    return pages(spark, sf).select("page_id", ix.source_name(none, none, F.col("url")).alias("file_name"))


_UNESCAPED = "replace(replace(replace(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&middot;', '·'), '&copy;', '©'), '&amp;', '&')"


def _plain(x: str) -> str:
    return "trim(regexp_replace(" + _UNESCAPED.format(f"regexp_replace(regexp_replace({x}, '<br>', chr(10), 'g'), '<[^>]*>', '', 'g')") + ", '\\s+', ' ', 'g'))"


@query(
    "with a as (select page_id, url, regexp_extract(html, '(?s)<article>(.*)</article>', 1) as body from pages), h as (select page_id, url, " + _plain("regexp_extract(body, '(?s)<h1>(.*?)</h1>', 1)") + " as title, string_split(regexp_extract(body, '(?s)</h1>(.*)$', 1), '<p>') as ps from a), "
    "p as (select page_id, url, title, k, " + _plain("ps[k]") + " as text from (select *, unnest(range(1, len(ps) + 1)) as k from h)), r as (select page_id, url, 0 as k, 'heading' as type, title as text, 1 as level, '' as section from h where title <> '' union all select page_id, url, k, 'text', text, null, title from p where text <> '') "
    "select page_id as artifact, row_number() over (partition by page_id order by k)::int as ord, type, text, level::int as level, section, url from r"
)
def q_html_blocks(spark, sf):
    b = ph.html_blocks(pages(spark, sf), bare=False)
    return b.select("artifact", "ord", "type", "text", "level", F.array_join("section_path", " > ").alias("section"), "url")


@query("select page_id, nullif(trim(replace(replace(replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&middot;', '·'), '&copy;', '©'), '&amp;', '&')), '') as title from pages")
def q_html_title(spark, sf):
    return pages(spark, sf).select("page_id", ph.page_title(F.col("html")).alias("title"))


@query(
    "with t as (select page_id, url, html, nullif(trim(" + _UNESCAPED.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)") + "), '') as title, regexp_replace(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '^www\\.|\\.\\w+$', '', 'g') as site from pages), "
    "s as (select *, regexp_extract(title, '(?s)^(.*)\\s+[|\\-–—·]\\s+(.{1,40})$', 1) as head, lower(regexp_replace(regexp_extract(title, '(?s)^(.*)\\s+[|\\-–—·]\\s+(.{1,40})$', 2), '\\W', '', 'g')) as tail, lower(regexp_replace(site, '\\W', '', 'g')) as name from t) "
    "select page_id, coalesce(case when tail <> '' and name <> '' and (contains(tail, name) or contains(name, tail)) and length(head) >= 4 then head else title end, nullif(" + _plain("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)") + ", '')) as title, null::varchar as author, null::varchar as date, site as sitename, url from s"
)
def q_page_metadata(spark, sf):
    return ph.page_metadata(pages(spark, sf))


@query("with t as (select page_id, list_slice(regexp_extract_all(html, '(?is)<a\\s[^>]*href=\"[^\"#][^\"]*\"[^>]*>[^<]*</a>'), 1, 20) as tags from pages), u as (select page_id, unnest(range(1, len(tags) + 1)) as i, tags from t) select page_id, i::int as position, regexp_extract(tags[i], '(?is)href=\"([^\"]*)\"', 1) as href, substr(regexp_extract(tags[i], '(?is)>([^<]*)</a>', 1), 1, 200) as text from u")
def q_html_links(spark, sf):
    return ph.page_links(pages(spark, sf))


@query("select distinct source as section from documents")
def q_sections_distinct(spark, sf):
    return rd.sections(docs(spark, sf).withColumnRenamed("source", "section"))


@query("select doc_id, source as section from documents where contains(source, 'c1')")
def q_section_filter(spark, sf):
    return rd.in_section(docs(spark, sf).withColumnRenamed("source", "section"), "c1").select("doc_id", "section")


@query("with n as (select page_id, lower(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[^\\p{L}\\p{N}]', '', 'g')) as k from pages), g as (select page_id, list_distinct(list_transform(range(1, greatest(length(k), 2)), lambda i: substr(k, i, 2))) as g from n where length(k) >= 4) select a.page_id as left_id, b.page_id as right_id, round(len(list_intersect(a.g, b.g))::double / len(list_distinct(list_concat(a.g, b.g))), 6) as score from g a join g b on b.page_id between a.page_id - 1 and a.page_id + 1 and a.page_id <> b.page_id where len(list_intersect(a.g, b.g))::double / len(list_distinct(list_concat(a.g, b.g))) >= 0.3")
def q_bigram_jaccard(spark, sf):
    """Titles of pages at most one id apart, by character bigrams: a band join dealt to its neighbours' keys."""
    t = pages(spark, sf).select("page_id", tx.title_key(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)).alias("k")).where(F.length("k") >= 4).withColumn("g", tx.char_bigrams(F.col("k")))
    band = t.select(F.explode(F.array(F.col("page_id") - 1, F.col("page_id") + 1)).alias("left_id"), F.col("page_id").alias("right_id"), F.col("g").alias("h"))
    s = t.join(band, t.page_id == band.left_id).withColumn("score", tx.jaccard(F.col("g"), F.col("h"))).where("score >= 0.3")
    return s.select("left_id", "right_id", F.round("score", 6).alias("score"))


@query("select count(*) as n_rows, sum(('0x' || substr(md5(doc_id || chr(31) || text), 1, 8))::bigint)::bigint as digest from documents")
def q_fingerprint(spark, sf):
    return ev.fingerprint(docs(spark, sf), "doc_id", "text")


@query("with o as (select doc_id, md5(text) as v from documents where lang <> 'es'), n as (select doc_id, md5(case when lang = 'de' then upper(text) else text end) as v from documents where lang <> 'fr') select coalesce(o.doc_id, n.doc_id) as doc_id, case when o.doc_id is null then 'added' when n.doc_id is null then 'removed' when o.v = n.v then 'same' else 'changed' end as change from o full join n on o.doc_id = n.doc_id")
def q_corpus_diff(spark, sf):
    """Two states of the corpus: Spanish came, French went, German was rewritten."""
    d = docs(spark, sf)
    old = d.where("lang <> 'es'").select("doc_id", F.md5("text").alias("v"))
    new = d.where("lang <> 'fr'").select("doc_id", F.md5(F.when(F.col("lang") == "de", F.upper("text")).otherwise(F.col("text"))).alias("v"))
    return ev.corpus_diff(old, new, "doc_id", "v").select("doc_id", "change")


# ---- chunks ---------------------------------------------------------------

TURN = ChunkParams(chunk_tokens=400, parent_tokens=700)


def _turns(spark, sf):
    t = table(spark, sf, "conversations")
    return t.select(F.col("conv_id").alias("artifact"), (F.col("turn") + 1).cast("int").alias("ord"), F.lit("text").alias("type"), "text")


_N = _TOKEN_LEN.format("text")
_PACK = f"""recursive_ as (select 1), t as (select conv_id as artifact, text, {_N} as n, length(text) as len, row_number() over (partition by conv_id order by turn) as i from conversations),
p as (select artifact, i, n, len, text, 0 as k, n as open from t where i = 1 union all select t.artifact, t.i, t.n, t.len, t.text, p.k + (p.open + t.n > {TURN.chunk_tokens})::int, case when p.open + t.n > {TURN.chunk_tokens} then t.n else p.open + t.n end from p join t on t.artifact = p.artifact and t.i = p.i + 1),
c as (select artifact, row_number() over (partition by artifact order by k) as number, sum(n)::bigint as token_count, sum(len)::bigint as char_count, md5(string_agg(text, chr(10) || chr(10) order by i)) as digest from p where trim(text) <> '' group by artifact, k)"""


def _line_chunks(sizes: list[int]) -> str:
    """CTEs: ``line_pieces`` and ``line_chunks`` (size, artifact, k, token_count, char_count, n_pieces, full_text, plain) of cleaned document lines, packed by each size."""
    n = _TOKEN_LEN.format
    return f"""{_CLEAN_LINES}, sizes as (select unnest({sizes}) as size), sized as (select size, artifact, ord, text, {n('text')} as n from cleaned, sizes),
sentence as (select *, unnest(range(1, len(ss) + 1)) as a from (select *, regexp_extract_all(text, '(?s).+?(?:[.!?。！？；]+[\\s]*|$)') as ss from sized where n > size)),
part as (select size, artifact, ord, a, case when {n('ss[a]')} > size then regexp_extract_all(ss[a], '(?s)\\s*\\S+\\s*') else [ss[a]] end as us from sentence),
unit as (select size, artifact, ord, u, {n('u')} as n, row_number() over (partition by size, artifact, ord order by a, b) as j from (select *, us[b] as u from (select *, unnest(range(1, len(us) + 1)) as b from part))),
walk as (select size, artifact, ord, j, u, n, 0 as k, n as open from unit where j = 1 union all select t.size, t.artifact, t.ord, t.j, t.u, t.n, w.k + (w.open > 0 and w.open + t.n > t.size)::int, case when w.open > 0 and w.open + t.n > t.size then t.n else w.open + t.n end from walk w join unit t on t.size = w.size and t.artifact = w.artifact and t.ord = w.ord and t.j = w.j + 1),
line_pieces as (select size, artifact, n, text, row_number() over (partition by size, artifact order by ord, k) as i from (select size, artifact, ord, 0 as k, n, text from sized where n <= size union all select size, artifact, ord, k, sum(n)::bigint, string_agg(u, '' order by j) from walk group by size, artifact, ord, k)),
packing as (select *, 0 as k, n as open from line_pieces where i = 1 union all select t.*, w.k + (w.open + t.n > t.size)::int, case when w.open + t.n > t.size then t.n else w.open + t.n end from packing w join line_pieces t on t.size = w.size and t.artifact = w.artifact and t.i = w.i + 1),
line_chunks as (select size, artifact, row_number() over (partition by size, artifact order by k) as k, sum(n)::bigint as token_count, sum(length(text))::bigint as char_count, count(*) as n_pieces, string_agg(text, chr(10) || chr(10) order by i) as full_text, string_agg(text, ' ' order by i) as plain from packing group by size, artifact, k)"""


_PADDED = "lpad({0}::varchar, greatest(4, length({0}::varchar))::int, '0')"
_CHUNK_ID = f"artifact || '_c' || {_PADDED.format('k')}"


def _recursive(sql: str) -> str:
    return "with recursive " + sql.replace("recursive_ as (select 1), ", "")


@query(_recursive(f"{_PACK} select artifact || '_c' || {_PADDED.format('number')} as chunk_id, token_count, char_count, digest from c"))
def q_chunks(spark, sf):
    """Conversation turns packed in order."""
    return ch.chunks(_turns(spark, sf), TURN).select("chunk_id", "token_count", "char_count", F.md5("full_text").alias("digest"))


@query(
    _recursive(
        f"{_PACK}, s as (select artifact, number, token_count, 0 as seg, token_count as total from c where number = 1 union all select c.artifact, c.number, c.token_count, s.seg + (s.total + c.token_count > {TURN.parent_tokens})::int, case when s.total + c.token_count > {TURN.parent_tokens} then c.token_count else s.total + c.token_count end from s join c on c.artifact = s.artifact and c.number = s.number + 1) "
        f"select artifact || '_p' || {_PADDED.format('(seg + 1)')} as parent_id, count(*) as n_chunks, sum(token_count)::bigint as token_count from s group by artifact, seg"
    )
)
def q_parents(spark, sf):
    p = ch.parents(ch.chunks(_turns(spark, sf), TURN), TURN)
    return p.select("parent_id", F.size("child_chunk_ids").cast("long").alias("n_chunks"), "token_count")


LINE = ChunkParams(chunk_tokens=200, parent_tokens=400)


@query(f"with recursive {_line_chunks([200])} select {_CHUNK_ID} as chunk_id, token_count, char_count, md5(full_text) as digest from line_chunks")
def q_chunks_documents(spark, sf):
    """Cleaned document lines in chunks of 200 tokens; long lines are cut at sentences."""
    return ch.chunks(bl.clean_blocks(bl.line_blocks(docs(spark, sf))), LINE).select("chunk_id", "token_count", "char_count", F.md5("full_text").alias("digest"))


@query(f"with recursive {_line_chunks([200])} select 'ok' as problem, count(*) as n from line_chunks")
def q_chunk_invariants(spark, sf):
    """Chunks by what is wrong with them; nothing should be."""
    rows = docs(spark, sf).withColumn("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))  # one without an id is checked too
    b = bl.clean_blocks(bl.line_blocks(rows))
    problems = ch.chunk_problems(ch.chunks(b, LINE, in_place=True), b, LINE)
    with dealt_by_fewer_keys(spark):  # texts are dealt once, by artifact
        return staged(problems.groupBy(F.coalesce("problem", F.lit("ok")).alias("problem")).agg(F.count("*").alias("n")))


@query(f"with {_CLEAN_LINES} select artifact as doc_id, sum(length(text))::bigint as n_chars, true as whole from cleaned group by artifact")
def q_chunk_coverage(spark, sf):
    """Characters of each document's fragments, and whether they hold each block's characters exactly once."""
    b = bl.clean_blocks(bl.line_blocks(docs(spark, sf)))
    got = ch.chunks(b, LINE).select("artifact", F.explode("fragments").alias("f")).groupBy("artifact", "f.block_id").agg(F.sum(F.col("f.end_char") - F.col("f.start_char")).alias("n"), F.min("f.start_char").alias("lo"), F.max("f.end_char").alias("hi"))
    want = b.select("artifact", F.col("ord").cast("string").alias("block_id"), F.length("text").alias("m"))
    both = want.join(got, ["artifact", "block_id"], "left")
    return both.groupBy(F.col("artifact").alias("doc_id")).agg(F.sum("n").alias("n_chars"), F.every(F.coalesce((F.col("n") == F.col("m")) & (F.col("lo") == 0) & (F.col("hi") == F.col("m")), F.lit(False))).alias("whole"))


@query(
    f"with recursive {_line_chunks([100, 200, 400, 800])}, a as (select size, count(*) as n_chunks, sum(token_count)::bigint as tokens, round(avg(token_count), 4) as mean, quantile_cont(token_count, 0.5)::double as median, max(token_count) as greatest, round(avg((token_count >= 0.98 * size)::int), 4) as full_share from line_chunks group by size) "
    "select size::int as size, n_chunks, tokens, mean, median, greatest, full_share, round(mean / lag(mean) over (order by size) - 1, 4) as slope from a"
)
def q_chunk_scan(spark, sf):
    return ch.size_scan(bl.clean_blocks(bl.line_blocks(docs(spark, sf))), [100, 200, 400, 800])


@query(
    f"with recursive {_line_chunks([200, 400, 800])}, a as (select size, count(*) as n from line_chunks group by size), b as (select lag(size) over (order by size) as size_from, size, round(n::double / lag(n) over (order by size) - 1, 4) as change from a) "
    "select size_from::int as size_from, size::int as size, change, (min(size_from) over ())::int as first from b where abs(change) < 0.4"
)
def q_chunk_plateau(spark, sf):
    """Stretches of chunk sizes over which the number of chunks hardly changes (here by less than 40 %)."""
    return ch.plateaus(ch.size_scan(bl.clean_blocks(bl.line_blocks(docs(spark, sf))), [200, 400, 800]), 0.4)


_METRIC = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\[([^\]\[]+)\]\([^)\s]*\)', '\1', 'g'), '(?s)\*{{1,3}}(\S|\S.*?\S)\*{{1,3}}', '\1', 'g'), '\s+([,.;:!?])', '\1', 'g'), '\s+', ' ', 'g'))"


@query(
    f"with recursive {_line_chunks([200])}, c as (select {_CHUNK_ID} as chunk_id, {_METRIC.format('plain')} as text from line_chunks), g as (select item_id, {_METRIC.format('text')} as needle from benchmark), f as (select g.*, c.chunk_id from g left join c on length(needle) >= 8 and contains(c.text, needle)) "
    "select item_id, chunk_id, case when length(needle) < 8 then 'under 8 characters' when chunk_id is null then 'in no chunk' end as problem from f"
)
def q_fragment_lookup(spark, sf):
    """Chunks whose fragments hold a benchmark passage, all of it, by normalised text.

    A passage that no chunk holds has one row without a chunk that names the problem, as has one of
    under 8 normalised characters, which is not looked up.
    """
    text = F.array_join(F.transform(F.filter("fragments", lambda f: f["block_type"] != "image"), lambda f: f["text"]), " ")
    chunks = staged(ch.chunks(bl.clean_blocks(bl.line_blocks(docs(spark, sf))), LINE).select(F.col("chunk_id").alias("doc"), tx.metric_text(text).alias("text")))
    gold = table(spark, sf, "benchmark").select(F.col("item_id").alias("needle"), F.coalesce(tx.metric_text(F.col("text")), F.lit("")).alias("needle_text"))
    found = ev.find_contained(gold.where(F.length("needle_text") >= 8), chunks)
    problem = F.when(F.length("needle_text") < 8, "under 8 characters").when(F.col("doc").isNull(), "in no chunk")
    return gold.join(found, "needle", "left").select(F.col("needle").alias("item_id"), F.col("doc").alias("chunk_id"), problem.alias("problem"))


@query(f"with recursive {_line_chunks([200])} select {_CHUNK_ID} as chunk_id, d.source as file_name, k::int as chunk_index, token_count, n_pieces::int as n_fragments, 'high' as tier from line_chunks c join documents d on d.doc_id = c.artifact")
def q_payloads(spark, sf):
    """Stored rows of chunks (their ids: q_point_ids)."""
    arts = docs(spark, sf).select(F.col("doc_id").alias("artifact"), F.col("source").alias("title"), F.concat(F.lit("file:///"), F.col("doc_id").cast("string")).alias("source_uri"), F.lit("local_file").alias("source_type"), F.lit("text/plain").alias("mime_type"))
    out = ix.payloads(ch.chunks(bl.clean_blocks(bl.line_blocks(docs(spark, sf))), LINE), arts)
    return out.select("chunk_id", "file_name", "chunk_index", "token_count", F.size("fragments").alias("n_fragments"), "index_decision.tier")


@query()
def q_point_ids(spark, sf):
    """Points of all documents' first chunks (DuckDB has no BLAKE2b; the test computes them)."""
    chunk = F.concat(tx.artifact_id(F.lit(None).cast("string"), F.col("doc_id").cast("string"), F.sha2("text", 256)), F.lit("_c"), tx.padded(F.lit(1)))
    return docs(spark, sf).select(chunk.alias("chunk_id")).select("chunk_id", tx.point_id(F.col("chunk_id")).alias("point_id"))


# ---- inline fixtures ------------------------------------------------------

_LEVELS = "case when length(text) < 20 then 1 when length(text) < 40 then 2 when length(text) < 60 then 3 end"


@query(
    f"with {_LINES}, l as (select artifact, ord, text, {_LEVELS} as level from lines), "
    "h as (select *, max(case when level = 1 then ord end) over w as h1, max(case when level = 2 then ord end) over w as h2, max(case when level = 3 then ord end) over w as h3 from l window w as (partition by artifact order by ord rows between unbounded preceding and 1 preceding)) "
    "select artifact, ord::int as ord, list_sum(list_filter([h1, case when h2 > coalesce(h1, 0) and coalesce(level, 9) > 2 then h2 end, case when h3 > greatest(coalesce(h1, 0), coalesce(h2, 0)) and coalesce(level, 9) > 3 then h3 end], lambda x: x is not null and coalesce(level, 9) > 1))::bigint as above from h"
)
def q_section_path(spark, sf):
    """Lines of documents, short ones as headings of three levels, with the sum of the line numbers that stand in their paths."""
    n = F.length("text")
    level = F.when(n < 20, 1).when(n < 40, 2).when(n < 60, 3)
    lines = bl.line_blocks(docs(spark, sf)).withColumn("level", level).withColumn("type", F.when(F.col("level").isNotNull(), "heading").otherwise("text")).withColumn("text", F.col("ord").cast("string"))
    path = bl.with_section_path(lines)
    return path.select("artifact", "ord", F.when(F.size("section_path") > 0, F.aggregate("section_path", F.lit(0).cast("long"), lambda t, x: t + x.cast("long"))).alias("above"))


#: @ stands for a document's language and id.
_MD = "# Top @\n\npara one\nstill one\n\n- a\n- b\n\n```py\nx  =  1\n\ny\n```\n## Sub\n$$a+b$$\n![cap](i.png)\ntail\n```\nopen"
_MD_ROWS = [(1, "heading", "Top @", ""), (2, "text", "para one|still one", "Top @"), (3, "list", "- a|- b", "Top @"), (4, "code", "x  =  1||y", "Top @"), (5, "heading", "Sub", "Top @"), (6, "formula", "a+b", "Top @ > Sub"), (7, "image", "cap", "Top @ > Sub"), (8, "text", "tail", "Top @ > Sub"), (9, "code", "open", "Top @ > Sub")]


_MARK = "coalesce(lang, 'xx') || doc_id"


def _templates(spark, sf, text):
    mark = F.concat(F.coalesce("lang", F.lit("xx")), F.col("doc_id").cast("string"))
    return docs(spark, sf).select(F.col("doc_id").alias("artifact"), F.replace(F.lit(text), F.lit("@"), mark).alias("text"))


@query(f"select doc_id as artifact, ord, type, replace(t.text, '@', {_MARK}) as text, replace(path, '@', {_MARK}) as path from documents, (values " + ", ".join(f"({a}::int, '{b}', '{c}', '{d}')" for a, b, c, d in _MD_ROWS) + ") t(ord, type, text, path)")
def q_markdown_blocks(spark, sf):
    """Blocks of a Markdown text of every kind of line, written for each document."""
    b = pt.parse_markdown(_templates(spark, sf, _MD))
    return b.select("artifact", "ord", "type", F.replace("text", F.lit("\n"), F.lit("|")).alias("text"), F.array_join("section_path", " > ").alias("path"))


_RST = "Title @\n====================\n\nbody @ # no heading\n# comment\n\nSub\n---\n1. one\n2. two\n"
_RST_ROWS = [(1, "heading", "Title @", 1), (2, "text", "body @ # no heading|# comment", None), (3, "heading", "Sub", 2), (4, "list", "1. one|2. two", None)]


@query(f"select doc_id as artifact, ord, type, replace(t.text, '@', {_MARK}) as text, level from documents, (values " + ", ".join(f"({a}::int, '{b}', '{c}', {d if d else 'null'}::int)" for a, b, c, d in _RST_ROWS) + ") t(ord, type, text, level)")
def q_plain_blocks(spark, sf):
    """Blocks of a plain text with underlined titles, written for each document."""
    b = pt.parse_plain(_templates(spark, sf, _RST))
    return b.select("artifact", "ord", "type", F.replace("text", F.lit("\n"), F.lit("|")).alias("text"), "level")


@query(
    f"with recursive {_LINES}, p as (select artifact, ord, trim(text, ' ' || chr(9) || chr(13)) as text from lines where trim(text, ' ' || chr(9) || chr(13)) <> ''), cut as (select artifact, ord, length(text) > 800 as long, unnest(range(0, (length(text) - 1) // 800 + 1)) as b, text from p), "
    "u as (select artifact, long, substr(text, b * 800 + 1, 800) as text, row_number() over (partition by artifact order by ord, b) as i from cut), "
    "walk as (select artifact, i, text, 0 as k, length(text) as size, long as shut from u where i = 1 union all select u.artifact, u.i, u.text, w.k + (u.long or w.shut or w.size + 2 + length(u.text) > 800)::int, case when u.long or w.shut or w.size + 2 + length(u.text) > 800 then length(u.text) else w.size + 2 + length(u.text) end, u.long from walk w join u on u.artifact = w.artifact and u.i = w.i + 1) "
    "select artifact, k::int as chunk, length(string_agg(text, chr(10) || chr(10) order by i))::bigint as n_chars, md5(string_agg(text, chr(10) || chr(10) order by i)) as digest from walk group by artifact, k"
)
def q_pack_paragraphs(spark, sf):
    """Character-budget packing of documents, each line a paragraph."""
    d = docs(spark, sf).select(F.col("doc_id").alias("artifact"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return pt.pack_paragraphs(d).select("artifact", "chunk", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


_SIZES, _VOTES = [26.9, 22.0, 18.0, 14.0, 12.5], [(26.9, 1, 3), (18.0, 3, 2), (18.0, 2, 2), (14.0, 3, 5)]


@query(
    f"with s(size) as (values {', '.join(f'({x}::double)' for x in _SIZES)}), v(size, level, n) as (values {', '.join(f'({a}::double, {b}, {c})' for a, b, c in _VOTES)}), b as (select size, level from (select *, row_number() over (partition by size order by n desc, level) as r from v) where r = 1) "
    "select size, level::int as level from (select s.size, b.level, row_number() over (partition by s.size order by round(abs(s.size - b.size), 3), b.level) as r from s, b) where r = 1"
)
def q_font_levels_nearest(spark, sf):
    sizes = spark.createDataFrame([("a", s) for s in _SIZES], "artifact string, size double")
    votes = spark.createDataFrame([("a", *v) for v in _VOTES], "artifact string, size double, level int, n int")
    return pl.calibrate(sizes, votes).select("size", "level")


_PDF = [(p, k, t, 50.0, y, 300.0, y + s, s) for p in range(4) for k, (t, y, s) in enumerate([("Running head", 20.0, 9.0), (f"Chapter {p}", 120.0, 20.0), ("Body text line one", 160.0, 10.0), ("goes on here.", 172.0, 10.0), (f"Part {p}a", 220.0, 14.0), ("More body, more text.", 250.0, 10.0), (str(p + 1), 780.0, 9.0)])]


def _pdf(spark):
    lines = spark.createDataFrame([("a", *r) for r in _PDF], "artifact string, page int, line_no int, text string, x0 double, y0 double, x1 double, y1 double, size double")
    outline = spark.createDataFrame([("a", 1, "Chapter 0", 0), ("a", 2, "Part 0a", 0), ("a", 1, "Chapter 2", 2)], "artifact string, level int, title string, page int")
    heights = spark.createDataFrame([("a", p, 800.0) for p in range(4)], "artifact string, page int, height double")
    return lines, outline, heights


@query(
    "select * from (select (p * 4 + 1)::int as ord, 'heading' as type, 'Chapter ' || p as text, '' as path from range(4) r(p) union all select (p * 4 + 2)::int, 'text', 'Body text line one goes on here.', 'Chapter ' || p from range(4) r(p) "
    "union all select (p * 4 + 3)::int, 'heading', 'Part ' || p || 'a', 'Chapter ' || p from range(4) r(p) union all select (p * 4 + 4)::int, 'text', 'More body, more text.', 'Chapter ' || p || ' > Part ' || p || 'a' from range(4) r(p))"
)
def q_pdf_blocks(spark, sf):
    b = pl.pdf_blocks(*_pdf(spark))
    return b.select("ord", "type", "text", F.array_join("section_path", " > ").alias("path"))


_A, _B, _C = "doc_id % 5 + 1", "doc_id % 7 + 3", "doc_id % 3 + 10"


@query(f"with s as (select distinct {_A} as a, {_B} as b, {_C} as c from documents) select a || '-' || (a + 2) || ',' || b || ', ' || c || '-' as spec, (p - 1)::int as page from s, unnest(range(1, 13)) t(p) where p between a and a + 2 or p = b or p >= c")
def q_page_range(spark, sf):
    """Pages of the ranges that documents' ids make, of twelve in all."""
    a, b, c = F.col("doc_id") % 5 + 1, F.col("doc_id") % 7 + 3, F.col("doc_id") % 3 + 10
    spec = F.concat(a.cast("string"), F.lit("-"), (a + 2).cast("string"), F.lit(","), b.cast("string"), F.lit(", "), c.cast("string"), F.lit("-"))
    return rd.page_numbers(docs(spark, sf).select(spec.alias("spec"), F.lit(12).alias("total")).distinct())


# ---- events ---------------------------------------------------------------


@query("select date_trunc('hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 6) as total from events group by all")
def q_event_windows(spark, sf):
    out = st.event_windows(table(spark, sf, "events"))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


@query("with s as (select *, coalesce(ts - lag(ts) over (partition by user_id order by ts) >= interval 30 minute, true)::int as new from events), g as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from s) select user_id, min(ts) as session_start, max(ts) + interval 30 minute as session_end, count(*) as n from g group by user_id, k")
def q_event_sessions(spark, sf):
    out = st.sessions(table(spark, sf, "events"))
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")
