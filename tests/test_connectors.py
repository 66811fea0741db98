import pytest
from pyspark.sql import functions as F

from quillmere.operators import reports as rp
from quillmere.sources import connectors as cn


def test_calls_once_per_value_with_errors_as_rows(spark):
    class Doubles:
        def call(self, items):
            if any(x == "bad" for x in items):
                raise ValueError("no")
            if len(items) == 3:
                return ["short"]
            return [x * 2 for x in items]

    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "bad"), (4, None), (5, "b"), (6, "c")], "id int, t string").coalesce(1)
    got = {r.id: (r.out, r.out_error) for r in cn.call_each(df, "t", "out", "string", Doubles, cn.CallPolicy(batch=3)).collect()}
    assert got == {1: ("aa", None), 2: ("aa", None), 3: (None, "no"), 4: (None, None), 5: ("bb", None), 6: ("cc", None)}


def test_results_are_kept_over_runs(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    class Upper:
        def __init__(self, breaks=""):
            self.breaks = breaks

        def call(self, items):
            calls.add(len(items))
            if any(x == self.breaks for x in items):
                raise ValueError("no")
            return [x.upper() for x in items]

    path = str(tmp_path / "cache")
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, "bad")], "id int, t string")
    run = lambda d, scope="m1", breaks="": {r.id: (r.out, r.out_error) for r in cn.call_cached(d, "t", "out", "string", lambda: Upper(breaks), path, scope, cn.CallPolicy(batch=1), 2).collect()}
    assert run(df, breaks="bad") == {1: ("A", None), 2: ("A", None), 3: ("B", None), 4: (None, None), 5: (None, "no")}
    first = calls.value
    assert run(df)[5] == ("BAD", None) and calls.value == first + 1  # only what had failed
    assert run(df) == {1: ("A", None), 2: ("A", None), 3: ("B", None), 4: (None, None), 5: ("BAD", None)} and calls.value == first + 1
    assert run(df, "m2")[1] == ("A", None) and calls.value == first + 4  # another model

    # a run that dies keeps its finished rounds
    class Dies:
        def call(self, items):
            calls.add(len(items))
            if any(x == "w7" for x in items):
                raise SystemExit("lost")
            return [x.upper() for x in items]

    more = spark.createDataFrame([(k, f"w{k}") for k in range(12)], "id int, t string")
    with pytest.raises(Exception):
        cn.call_cached(more, "t", "out", "string", Dies, path, "m3", cn.CallPolicy(batch=1), 2).collect()
    kept = spark.read.parquet(path).count()
    before = calls.value
    assert run(more, "m3")[7] == ("W7", None) and calls.value - before == 12 - (kept - 6)


def test_the_rate_holds_over_tasks(spark):
    class Clock:
        def call(self, items):
            import time

            return [time.time() for _ in items]

    df = spark.createDataFrame([(k, f"v{k}") for k in range(24)], "id int, t string").repartition(4)
    got = sorted(r.at for r in cn.call_each(df, "t", "at", "double", Clock, cn.CallPolicy(batch=1, per_minute=600, callers=2)).collect())
    # ten a second in all, however many tasks could run: in no second more than one call a task over that
    assert max(sum(t <= u < t + 1 for u in got) for t in got) <= 12 and got[-1] - got[0] >= 1.0


def test_pacing_and_retries():
    now, slept, fails = [0.0], [], [cn.RateLimited(7.0), cn.RateLimited(), cn.RateLimited()]

    def sleep(s):
        slept.append(s)
        now[0] += s

    def call(items):
        if fails:
            raise fails.pop(0)
        return items

    run = cn.paced(call, cn.CallPolicy(per_minute=30), sleep, lambda: now[0])
    assert run([1]) == [1]
    assert slept[0] == 7.0 and 1.0 not in slept[:1] and 2.0 in slept
    before = now[0]
    run([2])
    assert now[0] - before >= 2.0
    always = cn.paced(lambda _: (_ for _ in ()).throw(cn.RateLimited()), cn.CallPolicy(attempts=2), lambda s: None, lambda: 0.0)
    with pytest.raises(cn.RateLimited):
        always([1])


def test_hops(spark):
    rows = [(["http://a.b/", "http://10.0.0.1/"],), (["https://a.b/"],), ([],)]
    assert [r.ok for r in spark.createDataFrame(rows, "h array<string>").select(cn.allowed_hops(F.col("h")).alias("ok")).collect()] == [False, True, False]


def test_reports(spark, tmp_path):
    text = "intro START " + "x" * 50 + " END tail"
    rows = [(text, "START", "END"), (text, "x", "END"), (text, "START", "gone"), ("START END", "START", "END")]
    got = [r.s for r in spark.createDataFrame(rows, "t string, a string, b string").select(rp.slice_span(F.col("t"), F.col("a"), F.col("b")).alias("s")).collect()]
    assert got == ["START " + "x" * 50 + " END", None, None, None]
    t = spark.createDataFrame([(1, "a passage of gold text here"), (2, "other")], "doc int, text string")
    m = {r.name: r.value for r in rp.manifest({"k": 5}, {"t": t}, {"t": ["doc", "text"]}).collect()}
    assert m["k"] == "5" and m["t"].startswith("2:")
    assert m == {r.name: r.value for r in rp.manifest({"k": 5}, {"t": t.orderBy(F.desc("doc"))}, {"t": ["doc", "text"]}).collect()}
    needles = spark.createDataFrame([("n", "passage of gold text"), ("m", "nowhere at all")], "needle string, needle_text string")
    assert {r.needle: (r.in_old, r.in_new) for r in rp.gold_changes(needles, t, t.where("doc = 2")).collect()} == {"n": (1, 0), "m": (0, 0)}
    q = spark.createDataFrame([("b", "q"), ("a", "q")], "query_id string, query string")
    rp.write_qrels(q, str(tmp_path / "q"))
    assert spark.read.json(str(tmp_path / "q")).count() == 2
    s = spark.createDataFrame([("stage", "rrf", None, 0.5, 4), ("category", "rrf", "exact", 1.0, 2)], "level string, stage string, category string, hit_5 double, hit_5_n long")
    out = rp.markdown_report(s, ["hit_5"], failures={"rerank": 0.5})
    assert "| rrf | 0.5000 (n=4) |" in out and "| rrf | exact | 1.0000 (n=2) |" in out and "rerank: 50 %" in out


def test_scroll_goes_through_all_rows(spark):
    from quillmere.sources.readers import scroll

    rows, seen, after = spark.range(25).selectExpr("id * 3 as k"), [], None
    while page := [r.k for r in scroll(rows, "k", after, 7).collect()]:
        seen += page
        after = page[-1]
    assert seen == [3 * k for k in range(25)]


def test_parsers_get_the_options_they_take():
    from quillmere.sources.route import known_options

    options = {"max_chars": 5, "other": 1}
    assert known_options(lambda rows, max_chars=8: rows, options) == {"max_chars": 5}
    assert known_options(lambda rows: rows, options) == {}
    assert known_options(lambda rows, **more: rows, options) == options
