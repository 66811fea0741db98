import random
from collections import Counter

from pyspark.sql import functions as F

from quillmere.operators import page_chars as pc
from quillmere.operators import pdf_lines as pl


def runs(items, value, tolerance):
    """Items sorted by a value, cut where it steps over the tolerance."""
    out = []
    for x in sorted(items, key=lambda x: (x[value], x["n"])):
        if out and x[value] - out[-1][-1][value] <= tolerance:
            out[-1].append(x)
        else:
            out.append([x])
    return out


def brute(chars):
    groups, kept = {}, []
    for c in chars:
        groups.setdefault((c["artifact"], c["page"], c["text"], c["font"], c["size"]), []).append(c)
    for g in groups.values():
        kept += [min(x, key=lambda c: c["n"]) for y in runs(g, "top", 1.5) for x in runs(y, "x0", 1.5)]
    pages, out = {}, []
    for c in kept:
        pages.setdefault((c["artifact"], c["page"]), []).append(c)
    for key, page in pages.items():
        found = []
        for line in runs(page, "top", 3.0):
            text, end = "", None
            line = sorted(line, key=lambda c: (c["x0"], c["n"]))
            seen = [c for c in line if c["text"].strip()]
            for c in line:
                if c["text"].strip():
                    text += " " if end is not None and c["x0"] - end > 3.0 else ""
                    end = c["x1"] if end is None else max(end, c["x1"])
                text += c["text"]
            text = " ".join(text.split())
            if text:
                most = Counter(c["font"] for c in seen).most_common()
                font = next(c["font"] for c in seen if dict(most)[c["font"]] == most[0][1])
                box = [min(c["x0"] for c in seen), min(c["top"] for c in seen), max(c["x1"] for c in seen), max(c["bottom"] for c in seen)]
                found.append((text, *[round(b, 1) for b in box], round(max(c["size"] for c in seen), 1), font))
        out += [(*key, k + 1, *x) for k, x in enumerate(sorted(found, key=lambda x: (round(x[2]), x[1])))]
    return sorted(out)


def test_lines_equal_brute_force(spark):
    rng = random.Random(6)
    chars = []
    for k in range(1500):
        x, top = rng.randint(0, 300) * 0.5, rng.randint(0, 9) * 12 + rng.randint(0, 2) * 1.25
        one = {"artifact": rng.choice("ab"), "page": rng.randint(0, 2), "text": rng.choice("ABc .,"), "x0": x, "top": top, "x1": x + 4.0, "bottom": top + 8.0, "size": rng.choice([9.0, 9.0, 12.04]), "font": rng.choice(["F", "G"])}
        for d in range(rng.choice((1, 1, 2, 3))):
            chars.append(one | {"n": len(chars), "x0": x + d * 0.75, "x1": x + d * 0.75 + 4.0, "top": top + d * 0.25})
    names = ["artifact", "page", "n", "text", "x0", "top", "x1", "bottom", "size", "font"]
    schema = "artifact string, page int, n int, text string, x0 double, top double, x1 double, bottom double, size double, font string"
    df = spark.createDataFrame([tuple(c[x] for x in names) for c in chars], schema).repartition(4)
    assert sorted(map(tuple, pc.char_lines(pc.unique_chars(df)).collect())) == brute(chars)
    assert pc.char_lines(pc.unique_chars(df.limit(0))).count() == 0


def test_mono_fonts(spark):
    rows = spark.createDataFrame([("ABC+CourierNew",), ("DejaVuSansMono-Bold",), ("Times",), (None,)], "f string")
    assert [r.m for r in rows.select(pc.is_mono(F.col("f")).alias("m")).collect()] == [True, True, False, False]


def test_lines_go_on_to_blocks(spark):
    rows, n = [], 0
    for page, said in enumerate([("Chapter one", 18.0, 100.0), ("Body text of some length that goes on.", 10.0, 150.0)]):
        text, size, top = said
        for k, ch in enumerate(text):
            rows.append(("d", 0, n, ch, 50.0 + k * size / 2, top, 50.0 + k * size / 2 + size / 2, top + size, size, "F"))
            n += 1
    chars = spark.createDataFrame(rows, "artifact string, page int, n int, text string, x0 double, top double, x1 double, bottom double, size double, font string")
    lines = pc.char_lines(pc.unique_chars(chars))
    outline = spark.createDataFrame([], "artifact string, level int, title string, page int")
    heights = spark.createDataFrame([("d", 0, 800.0)], "artifact string, page int, height double")
    got = pl.pdf_blocks(lines, outline, heights).orderBy("ord").collect()
    assert [(r.type, r.text) for r in got] == [("heading", "Chapter one"), ("text", "Body text of some length that goes on.")]
