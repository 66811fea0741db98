"""Blocks of pages whose character references lack a semicolon."""

import duckdb

from quillmere.operators.parse_html import walk
from quillmere.plans import catalogue

PAGES = [(1, "https://a.example.com/x", "<html><body><article><h1>Salt &amp; pepper&amp</h1>\n<p>Fish &amp; chips &copy; AT&T &am &quot;so&quot; &lt</p>\n<p>&amp;amp</p></article></body></html>")]


def test_references_without_semicolon_stay_as_in_the_sql(spark, tmp_path):
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = catalogue.QUERIES["q_html_blocks"](spark, str(tmp_path))
    want = con.sql(catalogue.ORACLE_SQL["q_html_blocks"])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
    assert {r["text"] for r in got.collect()} == {"Salt & pepper&amp", 'Fish & chips © AT&T &am "so" &lt', "&amp"}


def test_other_callers_decode_them_and_scripts_stay():
    assert walk("<p>A &copy 2024 &amp</p>")[0]["text"] == "A © 2024 &"
    assert walk("<pre>a &lt b<script>x &lt y</script></pre>", bare=False)[0]["text"] == "a &lt bx &lt y"


SHORT = [(k, "https://a.example.com/x", f"<html><body><article><h1>A</h1>\n<p>{t}</p>\n<p><b>{t}<br><p>one</p></article></body></html>") for k, t in enumerate(["A", "É", "&amp;", "&amp", "&", "", " ", "字", "no"])]


def test_paragraphs_of_one_character_stay_as_in_the_sql(spark, tmp_path):
    spark.createDataFrame(SHORT, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = catalogue.QUERIES["q_html_blocks"](spark, str(tmp_path))
    want = con.sql(catalogue.ORACLE_SQL["q_html_blocks"])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
    assert got.where("artifact = 1 and type = 'text'").count() == 3


def test_a_character_right_in_a_container_is_no_block():
    assert [b["text"] for b in walk("<div>|<p>x</p>|<blockquote>y</blockquote>ab</div>")] == ["x", "y", "ab"]
