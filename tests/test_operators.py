import json
import random

import pytest
from pyspark.sql import functions as F

from quillmere.functions import text as tx
from quillmere.operators import blocks as bl
from quillmere.operators import chunk as ch
from quillmere.operators import context as ctx
from quillmere.operators import dense as de
from quillmere.operators import evaluate as ev
from quillmere.operators import hybrid as hy
from quillmere.operators import index as ix
from quillmere.operators import parse_html as ph
from quillmere.operators import parse_text as pt
from quillmere.operators import pdf_lines as pl
from quillmere.operators import sparse as sp
from quillmere.params import Bm25Params, ChunkParams, ContextParams, SearchParams
from quillmere.plans.search import Engine
from quillmere.sources import readers as rd
from quillmere.sources import route as ro
from quillmere.streaming import ingest as st


def values(spark, expr, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


# ---- text -------------------------------------------------------------------


def test_analyzer(spark):
    rows = [("The ip_vs.conf is at /etc, v1.2: 3 x 负载均衡 和 中",), (None,), ("Ouè 9 10 a-b",)]
    got = values(spark, tx.analyze(F.col("t")), rows, "t string")
    assert got == [["ip_vs.conf", "at", "etc", "v1.2", "x", "负载", "载均", "均衡"], [], ["ou", "10", "a-b"]]
    assert values(spark, tx.analyze(F.col("t")), [("ＡＢＣ１２",), ("ﬁne\u00a0x² É",), ("e\u0301te",)], "t string") == [["abc12"], ["fine", "x2"], ["te"]]


def test_cleaning(spark):
    assert values(spark, tx.clean_text(F.col("t")), [(" a​  b<!-- x\ny -->\n\n\n\nc ",)], "t string") == ["a b\n\nc"]
    assert values(spark, tx.clean_code(F.col("t")), [("\n\n  a  b\r\n\tc\n",)], "t string") == ["  a  b\n\tc"]
    toc = "\n".join(f"{k}.{k}. Part {k} {k}" for k in range(1, 7))
    single = "\n".join(f"{k}. step {k}" for k in range(1, 7))
    assert values(spark, tx.is_toc(F.col("t")), [(toc,), (single,), ("1.1. A 2\n1.2. B 3",), (None,)], "t string") == [True, False, False, False]


def test_metric_text(spark):
    rows = [("**bold** and *it* `code`",), ("doc_a snake_case __x__",), ("[anchor](http://x) , on",), ("2 * 3",), ("**[x](u)**",)]
    assert values(spark, tx.metric_text(F.col("t")), rows, "t string") == ["bold and it code", "doc_a snake_case x", "anchor, on", "2 * 3", "x"]


def test_ids(spark):
    rows = [("https://a/b", "u", "f" * 64), (None, "u", "e" * 64), (" ", "u", "d" * 64), (None, None, "c" * 64)]
    got = values(spark, tx.artifact_id(F.col("a"), F.col("b"), F.col("c")), rows, "a string, b string, c string")
    assert got[2] == "doc_" + "d" * 12 and got[3] == "doc_" + "c" * 12 and got[0] != got[1]
    import hashlib

    want = int.from_bytes(hashlib.blake2b(b"doc_c0001", digest_size=8).digest(), "big") & ((1 << 63) - 1)
    assert values(spark, tx.point_id(F.col("c")), [("doc_c0001",)], "c string") == [want]
    assert values(spark, tx.point_id(F.col("c"), exact=False), [("doc_c0001",)], "c string")[0] >= 0


# ---- blocks and chunks --------------------------------------------------------


def stack_paths(rows):
    stack, out = [], []
    for kind, level, text in rows:
        if kind == "heading":
            while stack and stack[-1][0] >= level:
                stack.pop()
            out.append([t for _, t in stack])
            stack.append((level, text))
        else:
            out.append([t for _, t in stack])
    return out


def test_section_paths_equal_a_stack(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for a in range(40):
        seq = [("heading", rng.randint(1, 6), f"h{k}") if rng.random() < 0.5 else ("text", None, f"t{k}") for k in range(rng.randint(1, 25))]
        for k, (path, (kind, level, text)) in enumerate(zip(stack_paths(seq), seq)):
            rows.append((a, k, kind, text, level))
            want[a, k] = path
    df = spark.createDataFrame(rows, "artifact int, ord int, type string, text string, level int")
    assert {(r.artifact, r.ord): r.section_path for r in bl.with_section_path(df).collect()} == want


def greedy(ps, budget):
    out, k, tokens, held, body = [], 0, 0, 0, False
    for n, heading, oversized in ps:
        if held and ((heading and body) or tokens + n > budget):
            k, tokens, held, body = k + 1, 0, 0, False
        out.append(k)
        tokens, held, body = tokens + n, held + 1, body or not heading
        if oversized:
            k, tokens, held, body = k + 1, 0, 0, False
    return out


def test_packing_equals_a_loop(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for a in range(60):
        ps = []
        for k in range(rng.randint(1, 20)):
            kind = rng.choice(["heading", "text", "code"])
            n = rng.randint(1, 60)
            over = kind == "code" and n > 40
            ps.append((n, kind == "heading", over))
            rows.append((a, "s", k, 0, kind, n, over))
        for k, c in enumerate(greedy(ps, 40)):
            want[a, k] = c
    df = spark.createDataFrame(rows, "artifact int, scope string, ord int, part int, type string, n long, oversized boolean")
    assert {(r.artifact, r.ord): r.pack for r in ch.pack(df, ChunkParams(chunk_tokens=40)).collect()} == want


def test_chunks_of_sections(spark):
    md = "# One\n\nbody one\n\n# Two\n\nbody two. " + "word " * 120 + "\n\n```py\nx = 1\n```\n"
    b = pt.parse_markdown(spark.createDataFrame([("d", md)], "artifact string, text string"))
    p = ChunkParams(chunk_tokens=50, parent_tokens=60)
    rows = ch.chunks(b, p).orderBy("number").collect()
    assert rows[0].headings == ["One"] and rows[0].full_text == "body one" and rows[0].section_path == ["One"]
    assert all(r.token_count <= 50 for r in rows)
    assert rows[1].headings == ["Two"]  # a heading that did not fit with its body goes along
    assert ch.invariant_breaks(ch.chunks(b, p), b, p).count() == 0
    parents = ch.parents(ch.chunks(b, p), p).collect()
    assert sum(len(r.child_chunk_ids) for r in parents) == len(rows) and all(r.token_count <= 60 for r in parents)
    whole = ch.parents(ch.chunks(b, p), ChunkParams(chunk_tokens=50, parent_tokens=0)).collect()
    assert len(whole) == 2
    with pytest.raises(ValueError):
        ChunkParams(chunk_tokens=0)


def test_quality_and_decisions(spark):
    long = "word " * 80
    rows = [("good", 1, "text", long, None), ("dup", 1, "text", "same", None), ("dup", 2, "text", "same", None)]
    rows += [("flat", k, "heading", f"h{k}", 1) for k in range(1, 6)] + [("flat", 6, "text", long, None)]
    blocks = spark.createDataFrame(rows, "artifact string, ord int, type string, text string, level int").withColumn("section_path", F.array().cast("array<string>"))
    arts = spark.createDataFrame([(a, "T", "url", "text/html") for a in ("good", "dup", "flat", "none")], "artifact string, title string, source_type string, mime string")
    got = {r.artifact: r for r in bl.quality(blocks, arts).collect()}
    assert (got["good"].status, got["good"].score, got["good"].flags) == ("high", 1.0, [])
    assert got["dup"].flags == ["very_short_text", "low_content", "high_duplicate_ratio"] and got["dup"].status == "reject"
    assert got["flat"].flags == ["flat_heading_levels", "section_path_all_empty"] and got["flat"].score == 0.88
    assert got["none"].status == "reject" and "no_blocks" in got["none"].flags
    d = bl.quality(blocks, arts).select("artifact", bl.index_decision(F.col("status")).alias("d")).collect()
    assert {r.artifact: (r.d.dense_index, r.d.sparse_index) for r in d}["none"] == (False, False)


def test_cleaning_drops(spark):
    rows = [(1, "text", "a"), (2, "text", "a"), (3, "list", "x"), (4, "list", "x"), (5, "text", " "), (6, "text", "Subscribe now"), (7, "text", "a"), (8, "code", "  c\n"), (9, "text", "\n".join(f"1.{k} P {k}" for k in range(6)))]
    df = spark.createDataFrame([("d", *r) for r in rows], "artifact string, ord int, type string, text string")
    out = bl.clean_blocks(df).orderBy("ord").collect()
    assert [(r.ord, r.text) for r in out] == [(1, "a"), (2, "x"), (3, "x"), (4, "a"), (5, "  c")]
    assert bl.dropped_toc(df).collect()[0].dropped == [9]
    assert bl.to_markdown(bl.clean_blocks(df)).collect()[0].markdown == "a\n\nx\n\nx\n\na\n\n```\n  c\n```"


def test_html_blocks(spark):
    html = '<html><head><title>Page | Site</title><meta property="og:site_name" content="Site"></head><body><nav><ul><li><a href="/x">x</a></li></ul></nav><article><h1>A</h1><p>one <a href="/q">two</a><h2>B</h2><ul><li>i<li>j</ul><pre><code class="language-py">a\n  b</code></pre><figure><img src="i.png"><figcaption>cap</figcaption></figure></article><table><tr><td>outside</td></tr></table></body></html>'
    df = spark.createDataFrame([(1, "http://h/p", html), (2, "u", None)], "page_id int, url string, html string")
    out = ph.html_blocks(df).orderBy("ord").collect()
    assert [(r.type, r.text, r.section_path) for r in out] == [
        ("heading", "A", []), ("text", "one two", ["A"]), ("heading", "B", ["A"]), ("list", "- i\n- j", ["A", "B"]), ("code", "a\n  b", ["A", "B"]), ("image", "cap", ["A", "B"]), ("table", "outside", []),
    ]
    assert out[1].links[0].href == "/q" and out[4].code_language == "py" and all(r.url == "http://h/p" for r in out)
    assert ph.page_metadata(df).orderBy("page_id").first().title == "Page"


def test_pdf_outline_matching(spark):
    lines = spark.createDataFrame([("a", 1, 1, "Load balancing basics", 12.0), ("a", 3, 1, "Load balancing basics", 12.0), ("a", 1, 2, "Load balancing basics and more", 12.0)], "artifact string, page int, line_no int, text string, size double")
    outline = spark.createDataFrame([("a", 2, "Load balancing basics", 0), ("a", 1, "Other", 1)], "artifact string, level int, title string, page int")
    got = pl.outline_matches(lines, outline).collect()
    assert [(r.page, r.line_no, r.level) for r in got] == [(1, 1, 2)]  # one page off; not two; not the longer title


# ---- retrieval ----------------------------------------------------------------


def hits(spark, rows):
    return spark.createDataFrame(rows, "query int, doc int, rank int, score double")


def test_rrf_and_union(spark):
    d = hits(spark, [(1, 10, 1, 0.9), (1, 11, 2, 0.8)])
    s = hits(spark, [(1, 11, 1, 5.0), (1, 12, 2, 4.0)])
    got = [(r.doc, r.rank) for r in hy.rrf(d, s).orderBy("rank").collect()]
    assert got == [(11, 1), (10, 2), (12, 3)]
    assert abs(hy.rrf(d, s).where("doc = 11").first().score - (1 / 62 + 1 / 61)) < 1e-9
    assert [r.doc for r in hy.union_stage(d, s).orderBy("rank").collect()] == [10, 12, 11]
    assert ev.not_in_pools(hy.rrf(d, s), d, s).count() == 0
    m = hy.margin(d).first()
    assert (m.top_score, m.gap) == (0.9, 0.1)
    with pytest.raises(ValueError):
        SearchParams(top_k=51)


def test_rerank(spark):
    h = hits(spark, [(1, 10, 1, 0.9), (1, 11, 2, 0.8)])
    docs = spark.createDataFrame([(10, "nothing here"), (11, "alpha beta")], "doc int, text string")
    q = spark.createDataFrame([(1, "alpha beta")], "query int, query_text string")
    assert [r.doc for r in hy.rerank(h, q, docs, 5).orderBy("rank").collect()] == [11, 10]
    assert [r.doc for r in hy.rerank(h, q, docs, 5, name="none").orderBy("rank").collect()] == [10, 11]


def test_metrics(spark):
    h = spark.createDataFrame([("s", 1, d, k) for k, d in enumerate(["a", "x", "c", "y"], 1)], "stage string, query int, doc string, rank int")
    gold = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "query int, doc string")
    qs = spark.createDataFrame([(1,), (2,)], "query int")
    got = {r["query"]: r for r in ev.query_scores(h, gold, qs, ks=(2, 4)).collect()}
    assert (got[1].recall_2, got[1].recall_4, got[1].mrr_2, got[1].precision_2) == (round(1 / 3, 6), round(2 / 3, 6), 1.0, 0.5)
    assert got[2].hit_2 is None and got[2].gold_size == 0
    out = ev.summarize_scores(ev.query_scores(h, gold, qs, ks=(2, 4)).withColumn("category", F.lit("c")), ks=(2, 4)).where("level = 'stage'").first()
    assert out.hit_2 == 1.0 and out.hit_2_n == 1
    assert ev.required_stages(["rerank"]) == {"rerank", "rrf", "dense", "sparse"}


def test_gap_and_abstention(spark):
    rows = [(k, k / 10, float(k >= 6)) for k in range(12)]
    g = ev.gap_split(spark.createDataFrame(rows, "query int, gap double, hit double")).first()
    assert (g.low_n, g.high_n, g.delta) == (6, 6, 1.0)
    assert ev.gap_split(spark.createDataFrame(rows[:5], "query int, gap double, hit double")).count() == 0
    a = spark.createDataFrame([(True, 0.8), (True, 0.6), (False, 0.5), (False, 0.7)], "answerable boolean, score double")
    best = ev.abstention_best(a).first()
    assert (best.threshold, best.caught, best.separable) == (0.6, 1, False)


def test_qrels_rules(spark):
    rows = [("a", "q", "en", [("long enough",)], "exact", "dev"), ("b", "q", "en", [], "exact", "dev"), ("c", "q", "en", [("long enough",)], "unanswerable", "dev"), ("d", " ", "en", [("x",)], "odd", "no"), ("a", "q", "en", [("long enough",)], "exact", "dev")]
    df = spark.createDataFrame(rows, "query_id string, query string, query_lang string, gold array<struct<text:string>>, category string, split string")
    got = sorted((r.query_id, r.problem) for r in ev.qrels_violations(df).collect())
    assert got == [("a", "repeated id")] * 2 + [("b", "no gold"), ("c", "unanswerable with gold"), ("d", "empty query"), ("d", "short gold"), ("d", "unknown category"), ("d", "unknown split")]


def test_dense_topk_in_blocks(spark):
    rng = random.Random(4)
    rows = [(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    q = df.where("vec_id < 7")
    one = sorted(tuple(r) for r in de.dense_topk(df, q, 4).select("query", "doc", "rank").collect())
    assert one == sorted(tuple(r) for r in de.dense_topk(df, q, 4, batch=2).select("query", "doc", "rank").collect())
    assert all(r[0] == r[1] for r in one if r[2] == 1) and len(one) == 28


def test_context(spark):
    rows = [(1, 1, "x" * 900, "T"), (1, 2, "", "T"), (1, 3, "y" * 900, None)]
    h = spark.createDataFrame(rows, "query int, rank int, text string, title string")
    c = ctx.citations(h, ContextParams(max_context_chars=1000)).orderBy("rank").collect()
    assert [(r.citation, len(r.body)) for r in c] == [(1, 900), (3, 100)]
    assert ctx.build_context(h, ContextParams(max_context_chars=1000)).first().context_chars == 1000
    empty = ctx.prompts(spark.createDataFrame([(9, "q")], "query int, query_text string"), ctx.build_context(h)).first()
    assert empty.prompt is None and empty.refusal == ctx.REFUSAL


# ---- sources, index, streams, engine -------------------------------------------


def test_readers(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\n\nbody")
    (tmp_path / "b.html").write_text("<html><body><p>text here</p></body></html>")
    (tmp_path / "c.xyz").write_bytes(b"%PDF-1.4")
    got = {r.uri.rsplit("/", 1)[1]: (r.mime_type, r.size_bytes) for r in rd.read_files(spark, str(tmp_path)).collect()}
    assert got == {"a.md": ("text/markdown", 9), "b.html": ("text/html", 42), "c.xyz": ("application/pdf", 8)}
    q = tmp_path / "q"
    q.mkdir()
    row = {"query_id": "a", "query": "q", "query_lang": "en", "gold": [{"text": "some gold"}], "category": "exact", "split": "dev"}
    (q / "x.jsonl").write_text("// note\n\n" + json.dumps(row) + "\n")
    assert rd.read_qrels(spark, str(q)).count() == 1
    (q / "y.jsonl").write_text(json.dumps(row) + "\n")
    with pytest.raises(Exception, match="repeated id"):
        rd.read_qrels(spark, str(q)).collect()
    assert rd.read_markdown(spark, str(tmp_path / "a.md")).first().text.startswith("# T")
    assert [r.p for r in spark.createDataFrame([("ftp://x",), ("http://127.0.0.1/",), ("https://a.b/",), ("http://[::1]/",)], "u string").select(rd.host_problem(F.col("u")).alias("p")).collect()] == ["scheme", "private", None, "private"]


def test_bundles(spark, tmp_path):
    for name, chunks in (("one", [{"chunk_id": "doc_1_c0001", "artifact_id": "doc_1", "full_text": "t"}]), ("two", [{"metadata": {"chunk_id": "doc_2_c0001"}, "full_text": "u"}])):
        d = tmp_path / name
        d.mkdir()
        (d / "artifact.json").write_text(json.dumps({"artifact_id": "doc", "title": name}))
        (d / "parents.json").write_text("[]")
        (d / "chunks.jsonl").write_text("\n".join(map(json.dumps, chunks)))
    arts, parents, chunks = rd.read_bundles(spark, str(tmp_path))
    assert arts.count() == 2 and chunks.count() == 2
    assert {r.chunk_id for r in rd.read_chunks(spark, f"{tmp_path}/*/chunks.jsonl").collect()} == {"doc_1_c0001", "doc_2_c0001"}
    (tmp_path / "two" / "chunks.jsonl").write_text("")
    with pytest.raises(Exception, match="no chunks"):
        rd.read_bundles(spark, str(tmp_path))[0].select("n").collect()


def test_parse_chain(spark):
    rows = [("a", b"# T\n\nbody text", "markdown", []), ("b", b"<html><p>some text</p></html>", "html", []), ("c", b"x", "office", ["plain"]), ("d", b" ", "html", ["plain"])]
    df = spark.createDataFrame([(a, bytearray(d), p, f) for a, d, p, f in rows], "artifact string, data binary, parser string, fallbacks array<string>")
    blocks, attempts = ro.parse_chain(df, lambda b: b.groupBy("artifact").count().where("count > 0"))
    assert {r.artifact for r in blocks.select("artifact").distinct().collect()} == {"a", "b", "c"}
    got = {(r.artifact, r.attempt): r.outcome for r in attempts.collect()}
    assert got == {("a", 1): "accepted", ("b", 1): "accepted", ("c", 1): "unsupported", ("c", 2): "accepted", ("d", 1): "rejected", ("d", 2): "rejected"}


def test_parse_chain_takes_failures_as_values(spark):
    calls = spark.sparkContext.accumulator(0)

    def picky(data, limit=3):
        calls.add(1)
        if len(data) > limit:
            raise RuntimeError("too long")
        return [{"type": "text", "text": data.decode()}]

    rows = [(1, b"ok", "picky", ["plain"]), (2, b"too long", "picky", ["plain"]), (3, b"\xff\xfe", "picky", ["plain"]), (4, b"\xff text", "markdown", ["picky", "plain"]), (5, b'{"text": "t"}', "json", []), (6, b"no json", "json", ["nobody"]), (7, None, "picky", []), (8, b"# T", "markdown", [])]
    df = spark.createDataFrame([(a, None if d is None else bytearray(d), p, f) for a, d, p, f in rows], "artifact int, data binary, parser string, fallbacks array<string>").repartition(3)
    try:
        ro.ROW_PARSERS["picky"] = picky
        blocks, attempts = ro.parse_chain(df, lambda b: b.groupBy("artifact").agg(F.max(F.length("text")).alias("n")).where("n > 0"), tries=3, options={"limit": 4, "unknown": 1})
        got = {r.artifact: ([(x.parser, x.outcome) for x in r.attempts], r.accepted) for r in ro.attempt_lists(attempts).collect()}
        errors = {(r.artifact, r.attempt): r.error for r in attempts.where("error is not null").collect()}
        texts = {r.artifact: r.text for r in blocks.collect()}
        blocks.count(), attempts.count()
    finally:
        del ro.ROW_PARSERS["picky"]
    assert got == {
        1: ([("picky", "accepted")], True), 2: ([("picky", "error"), ("plain", "accepted")], True), 3: ([("picky", "error"), ("plain", "error")], False), 4: ([("markdown", "error"), ("picky", "error"), ("plain", "error")], False),
        5: ([("json", "accepted")], True), 6: ([("json", "error"), ("nobody", "unsupported")], False), 7: ([("picky", "rejected")], False), 8: ([("markdown", "accepted")], True),
    }
    assert errors[2, 1] == "RuntimeError: too long" and errors[4, 1] == "not UTF-8" and errors[3, 1].startswith("UnicodeDecodeError") and errors[6, 1].startswith("JSONDecodeError")
    assert texts == {1: "ok", 2: "too long", 5: "t", 8: "T"}
    assert calls.value == 5  # once a row and try, whatever reads the results


def test_index_rebuild_and_search(spark, tmp_path):
    def build(texts):
        docs = spark.createDataFrame([(f"d{k}", t) for k, t in enumerate(texts)], "artifact string, text string")
        blocks = pt.parse_markdown(docs)
        arts = docs.select("artifact", F.lit("T").alias("title"), F.lit("http://h/x.md").alias("source_uri"), F.lit("url").alias("source_type"), F.lit("text/markdown").alias("mime_type"))
        dense, sparse = ix.index_plan(ix.payloads(ch.chunks(blocks), arts))
        ix.write_index(dense, sparse, str(tmp_path))
        return dense, sparse

    dense, sparse = build(["# A\n\nalpha beta", "# B\n\ngamma delta"])
    assert {r.point_id for r in dense.collect()} == {r.point_id for r in sparse.collect()}
    build(["# A\n\nalpha beta"])
    assert spark.read.parquet(f"{tmp_path}/dense").count() == 1  # nothing stale is left
    q = spark.createDataFrame([("q", "alpha"), ("r", "gamma")], "query_id string, query string")
    got = ix.search_index(spark, str(tmp_path), q, 3).collect()
    assert [(r["query"], r.matched) for r in got] == [("q", ["alpha"])]


def test_index_weight(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha")], "id int, t string")
    termed = sp.with_terms(docs, "id", "t")
    tf, stats = sp.term_frequencies(termed), sp.corpus_stats(termed)
    a = {(r.doc, r.term): r.weight for r in sp.postings(tf, stats, Bm25Params()).collect()}
    b = {(r.doc, r.term): r.weight for r in sp.postings(tf, stats, Bm25Params(), F.lit(0.6)).collect()}
    assert all(abs(b[k] - 0.6 * a[k]) < 1e-12 for k in a)


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (1, "a")], "artifact int, text string")
    docs.write.parquet(src)
    q = st.ingest(st.document_stream(spark, src, docs.schema), "artifact", str(tmp_path / "ck"), lambda b: ix.update_artifacts(b, out))
    q.awaitTermination(60)
    assert spark.read.parquet(out).count() == 2
    ix.update_artifacts(spark.createDataFrame([(2, "c")], "artifact int, text string"), out)
    assert sorted((r.artifact, r.text) for r in spark.read.parquet(out).collect()) == [(1, "a"), (2, "c")]
    ev_ = spark.createDataFrame([(1, "2024-01-01 00:10:00", "x", 1.0), (1, "2024-01-01 00:50:00", "x", 2.0), (1, "2024-01-01 02:00:00", "x", 4.0)], "user_id int, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    ev_.write.parquet(str(tmp_path / "ev"))
    stream = st.event_windows(spark.readStream.schema(ev_.schema).parquet(str(tmp_path / "ev")))
    w = stream.writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    w.awaitTermination(60)
    assert sorted((r.n, r.total) for r in spark.table("w").collect()) == [(1, 4.0), (2, 3.0)]
    assert st.sessions(ev_).count() == 3


def test_engine(spark):
    docs = spark.createDataFrame([("d1", "alpha beta gamma", "S1"), ("d2", "alpha delta", "S2"), ("d3", "omega", "S2")], "doc string, text string, section string")
    e = Engine(docs)
    q = spark.createDataFrame([("q", "alpha beta")], "query string, query_text string")
    got = e.search(q, SearchParams(top_k=2)).orderBy("rank").collect()
    assert [r.doc for r in got] == ["d1", "d2"] and got[0].shown is not None
    assert [r.doc for r in e.search(q, SearchParams(mode="sparse", section="S2", rerank=False)).collect()] == ["d2"]
    a = e.answer_context(q, SearchParams(top_k=2)).first()
    assert "[C1]" in a.prompt and a.n_citations == 2
    assert e.info().first().n_docs == 3 and [r.section for r in e.sections().collect()] == ["S1", "S2"]


def test_dense_topk_of_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [0.0, 1.0]), (5, [None, 1.0]), (6, [0.0, 0.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = de.dense_topk(df, df.where("vec_id in (1, 2)"), 5).collect()
    assert sorted((r["query"], r.doc, r.score) for r in got) == [(1, 1, 1.0), (1, 4, 0.0), (1, 6, 0.0)]
    assert de.dense_topk(df.limit(0), df.where("vec_id = 1"), 5).count() == 0
    assert de.dense_topk(df, df.where("vec_id = 2"), 5).count() == 0


def test_hashed_search_takes_any_id(spark):
    docs = spark.createDataFrame([("a", "red apple"), ("b", "green pear"), ("c", ""), ("d", None)], "doc string, text string")
    asked = spark.createDataFrame([("q1", "apple red"), ("q2", "nothing")], "query string, q string")
    for block in (1, 2048):
        got = de.sparse_cosine_topk(de.hashed(docs, "doc", "text"), de.hashed(asked, "query", "q"), 3, block).collect()
        assert [(r["query"], r.doc, r.score) for r in got] == [("q1", "a", 1.0)]


def test_short_needles(spark):
    texts = spark.createDataFrame([(1, "one applesauce two"), (2, "apple"), (3, "sauce boat house"), (4, "the applesau ce")], "doc long, text string")
    needles = [(1, "apple"), (2, "sauce boat"), (3, "ce bo"), (4, " two"), (5, "e b"), (6, "e applesau c")]
    got = ev.find_contained(spark.createDataFrame(needles, "needle long, needle_text string"), texts).collect()
    assert sorted(map(tuple, got)) == sorted((n, d) for n, x in needles for d, t in [(1, "one applesauce two"), (2, "apple"), (3, "sauce boat house"), (4, "the applesau ce")] if x in t)


def test_ids_and_packing_of_long_artifacts(spark):
    """Over 9,999 chunks: ids stay distinct, order stays, and the stream packs as a plain walk does."""
    n = 10_050
    blocks = spark.range(n).select(F.lit("d").alias("artifact"), (F.col("id") + 1).cast("int").alias("ord"), F.lit("text").alias("type"), F.format_string("w%d x y", "id").alias("text"))
    p = ChunkParams(chunk_tokens=3, parent_tokens=9)
    c = ch.chunks(blocks, p).select("chunk_id", "artifact", "scope", "grp", "pack", "number", "full_text", "token_count", "page_start", "page_end")
    rows = sorted(c.collect(), key=lambda r: r.number)
    assert [r.chunk_id for r in rows] == [f"d_c{k:04d}" for k in range(1, n + 1)] and rows[-1].full_text == f"w{n - 1} x y"
    ps = sorted(ch.parents(c, p).collect(), key=lambda r: (len(r.parent_id), r.parent_id))
    assert [r.parent_id for r in ps] == [f"d_p{k:04d}" for k in range(1, n // 3 + 1)] and ps[-1].child_chunk_ids == [f"d_c{k}" for k in range(n - 2, n + 1)]


def test_dense_search_takes_ties_and_most_queries_length(spark):
    rng = random.Random(11)
    rows = [(i, [float(rng.randint(-1, 1)) for _ in range(3)]) for i in range(3000)] + [(5000, [1.0]), (5001, None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    asked = [(1, [1.0]), (2, [1.0, 0.0, 1.0]), (3, [-1.0, 1.0, 0.0])]
    got = [(r["query"], r.doc, r.score) for r in de.dense_topk(vectors, spark.createDataFrame(asked, "vec_id long, embedding array<float>"), 7).orderBy("query", "rank").collect()]
    unit = lambda v: [x / (sum(y * y for y in v) ** 0.5 or 1) for x in v]
    want = []
    for q, v in asked[1:]:
        scored = [(-round(sum(a * b for a, b in zip(unit(v), unit(x))), 6), i) for i, x in rows if x is not None and len(x) == 3]
        want += [(q, i, -s) for s, i in sorted(scored)[:7]]
    assert got == want


def test_short_needles_are_found_in_words(spark):
    rng = random.Random(2)
    letters = "ab\n "
    texts = [(i, "".join(rng.choices(letters + "ab", k=rng.randint(0, 30)))) for i in range(150)] + [(900, "abcdefghijklmnop qrstuv"), (901, None)]
    needles = [(i, "".join(rng.choices(letters, k=rng.randint(1, 5)))) for i in range(120)] + [(500, "bcdefghijklm"), (501, "ghijklmnop q"), (502, " qrstuv"), (503, "cdefghijkx"), (504, "")]
    got = ev.find_contained(spark.createDataFrame(needles, "needle int, needle_text string"), spark.createDataFrame(texts, "doc int, text string"))
    want = {(n, d) for n, x in needles for d, t in texts if t is not None and x.strip(" \n\t") and x in t}
    assert {tuple(r) for r in got.collect()} == want and (501, 900) in want
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_point_ids_of_documents(spark):
    import hashlib

    from quillmere.plans import catalogue

    rows = catalogue.QUERIES["q_point_ids"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200 and len({r.point_id for r in rows}) == 200
    for r in rows:
        assert r.point_id == int.from_bytes(hashlib.blake2b(r.chunk_id.encode(), digest_size=8).digest(), "big") & ((1 << 63) - 1)
