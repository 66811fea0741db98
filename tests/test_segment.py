import itertools
import math
import random
import re
from collections import Counter

from quillmere.operators import segment as sg
from quillmere.operators import sparse as sp
from pyspark.sql import functions as F


def paths(run):
    for cuts in itertools.product((0, 1), repeat=max(0, len(run) - 1)):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(run)]
        yield [run[a:b] for a, b in zip(at, at[1:])]


def likeliest(run, counts):
    total = sum(counts.values())

    def log(words):
        out = 0.0
        for w in reversed(words):
            out = (math.log(counts[w] / total) if w in counts else math.log(1 / total) if len(w) == 1 else -math.inf) + out
        return out

    return max(paths(run), key=lambda ws: (log(ws), [len(w) for w in ws]))


def test_split_is_the_likeliest_path():
    rng = random.Random(4)
    chars = "天地人云水火山石"
    counts = {"".join(rng.choices(chars, k=rng.choice((1, 1, 2, 2, 3, 4)))): rng.choice((1, 2, 2, 5, 40)) for _ in range(60)}
    lattice = sg.Lattice(counts)
    for _ in range(300):
        run = "".join(rng.choices(chars + "无", k=rng.randint(1, 9)))
        assert lattice.split(run) == likeliest(run, counts), run
    assert lattice.split("") == []


def learned(texts, longest, least, cohesion, fragment):
    c = Counter()
    for t in texts:
        for run in re.findall("[一-鿿]+", t or ""):
            for k in range(1, longest + 2):
                c.update(run[i : i + k] for i in range(len(run) - k + 1))
    total = sum(n for g, n in c.items() if len(g) == 1)
    out = {g: n for g, n in c.items() if len(g) == 1}
    for g, n in c.items():
        if 1 < len(g) <= longest and n >= least and all(n * total / (c[g[:i]] * c[g[i:]]) >= cohesion for i in range(1, len(g))):
            if not any(m > fragment * n and m >= least for h, m in c.items() if len(h) == len(g) + 1 and (h[1:] == g or h[:-1] == g)):
                out[g] = n
    return out


def made_texts(seed, n=150):
    rng = random.Random(seed)
    chars = [chr(0x4E00 + 37 * k) for k in range(40)]
    words = ["".join(rng.sample(chars, k)) for k in (1, 1, 1, 2, 2, 2, 2, 3, 3, 4) for _ in range(3)]
    return ["".join(rng.choices(words, k=rng.randint(1, 30))) + rng.choice(["", " api v2.0 ", "，"]) + "".join(rng.choices(words, k=3)) for _ in range(n)] + [None, "", "plain text"], words


def test_learned_words_equal_brute_force(spark):
    texts, made = made_texts(1)
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    got = {r.word: r.n for r in sg.learn_words(df, "text", 4, 4, 3.0, 0.8).collect()}
    assert got == learned(texts, 4, 4, 3.0, 0.8)
    assert sum(w in got for w in made if len(w) > 1) > 12


def test_terms_with_domain_words(spark):
    texts, made = made_texts(2)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc long, text string")
    words = sg.learn_words(df, "text", 4, 4, 3.0)
    counts = {r.word: r.n for r in words.collect()}
    own = "".join(made[k] for k in (3, 10))
    d = sg.Dictionary(words, {own: None, "甲乙丙": 7})
    assert own not in counts and sg.Lattice({**counts, own: sg.Lattice(counts).needed(own)}).split(own) == [own]
    text = f"HTTP/2 {own} 的，甲乙丙 the end"
    got = spark.createDataFrame([(text,), (None,), ("no such",)], "t string").select(d.analyze(F.col("t")).alias("x")).collect()
    assert got[0].x == ["http/2", own, "甲乙丙", "end"] and got[1].x == [] and got[2].x == ["no", "such"]
    # as the analyzer of an index: statistics and postings by words
    termed = sp.with_terms(df, "doc", "text", d.analyze)
    terms = {r.term for r in sp.document_frequencies(sp.term_frequencies(termed)).collect()}
    assert {t for t in terms if len(t) > 1 and t > "一"} <= set(counts) | {own}
