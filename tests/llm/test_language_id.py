import random

import numpy as np

from quillmere.llm import language_id as li

PARTS = {
    "en": ["th", "er", "an", "in", "on", "re", "at", "en", "the", "ing", "wh"],
    "de": ["sch", "ver", "ung", "ein", "ü", "keit", "ge", "be", "ß", "und"],
    "es": ["ción", "que", "ar", "os", "ll", "ñ", "mente", "do", "la"],
}


def line(lang, rng, n=40):
    return " ".join("".join(rng.choices(PARTS[lang], k=rng.randint(1, 3))) for _ in range(n))


def rows(n, seed, size=40):
    rng = random.Random(seed)
    return [(i, line(lang, rng, rng.randint(2, size)), lang) for i, lang in enumerate(rng.choices(list(PARTS), k=n))]


def test_held_out_accuracy_and_edge_cases(spark):
    train = spark.createDataFrame(rows(300, 1) + [(None, "x", "en"), (1000, None, "de"), (1001, "", "es"), (1002, "abc", None)], "doc_id long, text string, lang string")
    models = li.fit(train)
    assert models.languages == ["de", "en", "es"]
    test = rows(200, 2)
    odd = [(900, None, "x"), (901, "123 !!", "x"), (902, "", "x"), (903, "中文字符" * 40, "x"), (904, "the " * 20_000, "x")]
    df = spark.createDataFrame([(*r, "clash") for r in test + odd], "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in li.identify(df, models, keep=["doc_id", "lang", "score"]).collect()}
    assert len(got) == len(test) + len(odd)
    assert sum(got[i].lang_pred == lang for i, _, lang in test) >= 0.99 * len(test)
    assert not any(got[i].rejected for i, _, _ in test)
    assert all(0 <= r.score <= 1 for r in got.values())
    for i in (900, 901, 902):
        assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
    assert got[903].rejected and not got[904].rejected
    assert li.identify(df.limit(0), models).count() == 0


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    models = li.fit(df)
    assert [r.lang_pred for r in li.identify(df, models, keep=["doc_id"]).collect()] == ["und"]


def brute(train, texts):
    """Interpolated Kneser-Ney by dictionaries, for one language."""
    pad = " " * (li.ORDER - 1)

    def clean(t):
        out = []
        for c in t.lower():
            if c.isalpha():
                out.append(c)
            elif out and out[-1] != " ":
                out.append(" ")
        return "".join(out)

    counts = [dict() for _ in range(li.ORDER)]
    for t in train:
        s = pad + clean(t)
        for i in range(li.ORDER - 1, len(s)):
            g = s[i - li.ORDER + 1 : i + 1]
            counts[li.ORDER - 1][g] = counts[li.ORDER - 1].get(g, 0) + 1
    for n in range(li.ORDER - 1, 0, -1):
        for g in counts[n]:
            counts[n - 1][g[1:]] = counts[n - 1].get(g[1:], 0) + 1
    disc = []
    for c in counts:
        one, two = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        disc.append(min(0.95, max(0.05, one / (one + 2 * two))) if one + two else 0.5)
    size = len(counts[0]) + 1

    def prob(g):
        if not g:
            return 1 / size
        n = len(g)
        c = counts[n - 1]
        of = {k: v for k, v in c.items() if k[:-1] == g[:-1]}
        whole = sum(of.values())
        if not whole:
            return prob(g[1:])
        return max(c.get(g, 0) - disc[n - 1], 0) / whole + disc[n - 1] * len(of) / whole * prob(g[1:])

    out = []
    for t in texts:
        s = pad + clean(t)
        bits = [-np.log2(prob(s[i - li.ORDER + 1 : i + 1])) for i in range(li.ORDER - 1, len(s))]
        out.append(sum(bits) / len(bits))
    return out


def test_entropies_equal_brute_force():
    rng = random.Random(6)
    train = [line("en", rng, 8) + "!! 3 " for _ in range(6)]
    texts = ["the ingwh", "zzz the", "an", *[line("en", rng, 5) for _ in range(5)], "--the"]
    cps, begin, count = li.symbols(train)
    where = li._scored(begin, count)
    g = li.grams(cps)
    h4, first, n = np.unique(g[3][where], return_index=True, return_counts=True)
    at = where[first]
    models = li.build({"en": (h4, g[2][at], g[1][at], g[0][at], g[2][at - 1], g[1][at - 1], g[0][at - 1], n)})
    bits, _, _ = models.entropies(texts)
    assert np.allclose(bits[:, 0], brute(train, texts), rtol=1e-4)


def test_rejection_does_not_depend_on_other_alphabets(spark):
    rng = random.Random(12)
    latin = rows(300, 1)
    han = [(2000 + k, "".join(chr(0x4E00 + int(rng.paretovariate(0.6)) % 3000) for _ in range(200)), "zh") for k in range(120)]
    models = li.fit(spark.createDataFrame(latin + han, "doc_id long, text string, lang string"))
    assert models.languages == ["de", "en", "es", "zh"]
    drawn = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=400)) for _ in range(20)]
    assert models.predict(drawn)[2].all()
    known = [t for _, t, _ in rows(40, 3)] + ["".join(chr(0x4E00 + int(rng.paretovariate(0.6)) % 3000) for _ in range(200)) for _ in range(10)]
    assert not models.predict(known)[2].any()


def test_many_languages_and_one_id(spark):
    few = spark.createDataFrame([(7, f"{chr(97 + k % 26)}{chr(97 + k // 26)} " * 30, f"x{k:03d}") for k in range(340)], "doc_id long, text string, lang string")
    assert len(li.fit(few, sample=10_000).languages) >= 200
