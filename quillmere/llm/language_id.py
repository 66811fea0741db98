"""Language ID: interpolated Kneser-Ney character models.

One model of order four per language, learned from a labelled sample. Counts of
the highest order are as seen, those of lower orders are of distinct left neighbours;
each order has one discount, estimated from its counts of one and two. The
probabilities of all languages for one n-gram lie side by side in arrays sorted
by the n-gram's hash; a text's symbols are looked up there, backing off where
an n-gram was seen in no language. A text gets the language of the lowest
length-normalised cross-entropy.

Calibration is on a part of the sample that the models do not see: a temperature
for the score (the softest that loses next to no likelihood), and per language the
mean and spread of the cross-entropy. A text is ``rejected`` when its cross-entropy lies
``REJECT`` spreads above what its length allows and is nearer to that of the language's own letters
drawn evenly than to the language's own, or when it has no letter.

Symbols are lower-case letters; all between two letters is one space. Text without
a letter, or null, is ``und`` with score 0. The sample is ``SAMPLE`` rows or ``SAMPLE_BYTES`` of each
language as expected, what is less, drawn by a hash of id and text; counts for its size cover all rows. Any number of
languages is learned; the models' memory grows with it.
Rows without a label or id are not learned from. Repeated rows count as often as
they come. Learning from no row at all leaves every text ``und``. A kept column named like an
output gives way to it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmere.llm.batches import append_columns, column, cut_by_bytes

ORDER = 4
#: Rows and bytes of each language to learn from.
SAMPLE, SAMPLE_BYTES = 300, 4 << 20
REJECT = 8.0
UNKNOWN = "und"
_P = np.uint64(0x9E3779B97F4A7C15)
_SPACE = 32
#: Symbols whose rows of probabilities are held at a time, times the number of languages.
_HELD = 1 << 21


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of texts end to end, each after ORDER-1 spaces; where each begins; symbols without that lead."""
    pad = " " * (ORDER - 1)
    joined = "".join([pad + "\0" + (t or "").lower() for t in texts])
    cps = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    if not len(cps):
        return cps, np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = np.array([len((t or "").lower()) + ORDER for t in texts])
    begin = np.cumsum(sizes) - sizes
    letter = _letters()[cps]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of other symbols stands for the run
    lead = begin[:, None] + np.arange(ORDER - 1)
    keep[lead] = True
    keep[begin + ORDER - 1] = False
    out = np.where(letter, cps, _SPACE)[keep]
    at = np.concatenate(([0], np.cumsum(keep)))
    count = at[begin + sizes] - at[begin] - (ORDER - 1)
    return out, at[begin], count


def grams(cps: np.ndarray) -> list[np.ndarray]:
    """Hashes of the n-grams that end at each symbol, for n of 1 to ORDER; the first n-1 are of no use."""
    h = (cps.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    out, power = [h], np.uint64(1)
    with np.errstate(over="ignore"):
        for n in range(1, ORDER):
            power = power * _P
            g = out[-1].copy()
            g[n:] += h[:-n] * power
            out.append(g)
    return out


def _scored(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Positions of the symbols after each text's lead."""
    first = np.cumsum(count) - count
    return np.repeat(begin + ORDER - 1 - first, count) + np.arange(int(count.sum()))


@dataclass
class Models:
    """Sorted hash arrays and rows of probabilities, a column per language."""

    languages: list[str]
    keys: list[np.ndarray]  # per order
    probs: list[np.ndarray]
    contexts: list[np.ndarray]  # per order above 1
    weights: list[np.ndarray]
    base: np.ndarray
    alphabet: np.ndarray | None = None  # symbols of each language
    temperature: float = 1.0
    mean: np.ndarray | None = None
    within: np.ndarray | None = None  # variance of a symbol's code length
    between: np.ndarray | None = None  # variance of a text's mean

    def _find(self, keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(keys, h)
        at[at == len(keys)] = 0
        return at, keys[at] == h

    def _prob(self, n: int, g: list[np.ndarray], where: np.ndarray) -> np.ndarray:
        """Probabilities of the n-grams that end at ``where``, in every language."""
        if n == 0:
            return np.broadcast_to(self.base, (len(where), len(self.languages)))
        at, hit = self._find(self.keys[n - 1], g[n - 1][where])
        out = self.probs[n - 1][at]
        miss = np.flatnonzero(~hit)
        if len(miss):
            lower = self._prob(n - 1, g, where[miss])
            if n > 1:
                c, seen = self._find(self.contexts[n - 2], g[n - 2][where[miss] - 1])
                lower = lower * np.where(seen[:, None], self.weights[n - 2][c], 1)
            out[miss] = lower
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(texts, languages) bits a symbol, the same of squares, and symbols of each text."""
        cps, begin, count = symbols(texts)
        n_lang = len(self.languages)
        total, squares = np.zeros((2, len(texts), n_lang))
        where = _scored(begin, count)
        if n_lang and len(where):
            g = grams(cps)
            owner = np.repeat(np.arange(len(texts)), count)
            block = max(1024, _HELD // n_lang)
            for a in range(0, len(where), block):
                bits = -np.log2(self._prob(ORDER, g, where[a : a + block]))
                who = owner[a : a + block]
                cut = np.concatenate(([0], np.flatnonzero(np.diff(who)) + 1))
                total[who[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.float64)
                squares[who[cut]] += np.add.reduceat(bits * bits, cut, axis=0, dtype=np.float64)
        n = np.maximum(count, 1)[:, None]
        return total / n, squares / n, count

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether rejected, of each text."""
        bits, _, count = self.entropies(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        best = bits.argmin(1)
        some = count > 0
        rows = np.arange(len(texts))
        low = bits[rows, best]
        score = np.where(some, 1 / np.exp(-self._scaled(bits, low, count)).sum(1), 0)
        spread = np.sqrt(self.within[best] / np.maximum(count, 1) + self.between[best])
        far = np.maximum(REJECT * spread, (np.log2(self.alphabet[best] + 1) - self.mean[best]) / 2)
        rejected = ~some | (low > self.mean[best] + far)
        return [self.languages[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist())], score, rejected

    def _scaled(self, bits, low, count, temperature=None):
        return (bits - low[:, None]) * np.sqrt(np.maximum(count, 1))[:, None] / (temperature or self.temperature)


def build(table: dict[str, tuple[np.ndarray, ...]]) -> Models:
    """Models from each language's distinct n-grams: (hashes of order 4 to 1, contexts of order 3 to 1, counts)."""
    languages = sorted(table)
    stats = []  # per language, per order: (grams, counts, contexts, suffixes, discount)
    for lang in languages:
        *h, count = table[lang]
        full, ctx = h[:ORDER], h[ORDER:]
        levels = [None] * ORDER
        g, c = full[0], count.astype(np.float64)
        idx = np.argsort(g)
        for k in range(ORDER):
            n = ORDER - k
            keys, cnt = g[idx], c[idx]
            one, two = (cnt == 1).sum(), (cnt == 2).sum()
            discount = min(0.95, max(0.05, one / (one + 2 * two))) if one + two else 0.5
            levels[n - 1] = (keys, cnt, ctx[k][idx] if n > 1 else None, full[k + 1][idx] if n > 1 else None, discount)
            if n > 1:
                # the next order's grams are these ones' suffixes; each distinct left neighbour counts one
                suffix = full[k + 1][idx]
                g2, first, num = np.unique(suffix, return_index=True, return_counts=True)
                full = [None if x is None else x[idx][first] for x in full]
                ctx = [x[idx][first] for x in ctx]
                g, c, idx = g2, num.astype(np.float64), np.arange(len(g2))
        stats.append(levels)
    size = len(np.unique(np.concatenate([s[0][0] for s in stats]))) + 1 if stats else 1
    n_lang = len(languages)
    keys, probs, contexts, weights = [], [], [], []
    base = np.full(n_lang, 1 / size, np.float32)
    for n in range(1, ORDER + 1):
        union = np.unique(np.concatenate([s[n - 1][0] for s in stats])) if stats else np.zeros(0, np.uint64)
        p = np.zeros((len(union), n_lang), np.float64)
        if n > 1:
            all_ctx = np.unique(np.concatenate([s[n - 1][2] for s in stats])) if stats else np.zeros(0, np.uint64)
            lam = np.ones((len(all_ctx), n_lang), np.float64)
            union_ctx, union_suf = np.zeros((2, len(union)), np.uint64)
            for s in stats:
                at = np.searchsorted(union, s[n - 1][0])
                union_ctx[at], union_suf[at] = s[n - 1][2], s[n - 1][3]
            in_ctx = np.searchsorted(all_ctx, union_ctx)
            lower = probs[-1][np.searchsorted(keys[-1], union_suf)].astype(np.float64)
        for j, s in enumerate(stats):
            g, c, ctx, _, d = s[n - 1]
            at = np.searchsorted(union, g)
            if n == 1:
                whole = c.sum()
                p[:, j] = d * len(g) / whole / size
                p[at, j] += (c - d) / whole
                base[j] = d * len(g) / whole / size
            else:
                where = np.searchsorted(all_ctx, ctx)
                whole = np.bincount(where, c, len(all_ctx))
                kinds = np.bincount(where, minlength=len(all_ctx))
                lam[:, j] = np.where(whole > 0, d * kinds / np.maximum(whole, 1), 1)
                p[:, j] = lam[in_ctx, j] * lower[:, j]
                p[at, j] += (c - d) / whole[where]
        if n > 1:
            contexts.append(all_ctx)
            weights.append(lam.astype(np.float32))
        keys.append(union)
        probs.append(p.astype(np.float32))
    return Models(languages, keys, probs, contexts, weights, base, np.array([len(s[0][0]) for s in stats]))


_COLUMNS = ["h4", "h3", "h2", "h1", "c3", "c2", "c1"]


def _count_grams(batches):
    """(lang, text) batches to distinct n-grams with their counts."""
    names = ["lang", *_COLUMNS, "n"]
    for batch in batches:
        for part in cut_by_bytes(batch, 1):
            langs = np.array(part.column(0).to_pylist(), object)
            texts = part.column(1).to_pylist()
            for lang in sorted(set(langs)):
                cps, begin, count = symbols([t for t, x in zip(texts, langs) if x == lang])
                where = _scored(begin, count)
                if not len(where):
                    continue
                g = grams(cps)
                h4, first, n = np.unique(g[3][where], return_index=True, return_counts=True)
                at = where[first]
                cols = [h4, g[2][at], g[1][at], g[0][at], g[2][at - 1], g[1][at - 1], g[0][at - 1]]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h4), pa.string()), *[pa.array(c.view(np.int64)) for c in cols], pa.array(n, pa.int64())], names=names)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Models:
    """Learns and calibrates models from labelled rows."""
    src = labelled.select(column(id_col).cast("string").alias("id"), column(text_col).alias("text"), column(lang_col).cast("string").alias("lang")).where("id is not null and lang is not null")
    rows = src.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).orderBy("lang").collect()
    if not rows:
        return build({})
    scale = 1 << 30
    part = [min(1.0, sample / r["n"], SAMPLE_BYTES / max(1, r["bytes"] or 0)) for r in rows]
    share = F.create_map(*[x for r, p in zip(rows, part) for x in (F.lit(r["lang"]), F.lit(-int(-scale * p // 1)))])
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(scale))
    drawn = src.where(draw < share[F.col("lang")]).select("lang", "text", (F.pmod(F.xxhash64(F.lit(1), "id", "text"), F.lit(5)) == 0).alias("aside"))
    schema = "lang string, " + ", ".join(f"{c} long" for c in _COLUMNS) + ", n long"
    counted = drawn.where("not aside").select("lang", "text").mapInArrow(_count_grams, schema)
    got = counted.groupBy("lang", "h4").agg(*[F.first(c).alias(c) for c in _COLUMNS[1:]], F.sum("n").alias("n")).toArrow()
    langs = np.array(got["lang"].to_pylist(), object)
    cols = [got[c].to_numpy() for c in _COLUMNS]
    count = got["n"].to_numpy()
    table = {}
    for lang in sorted(set(langs)):
        mine = langs == lang
        table[lang] = (*[c[mine].view(np.uint64) for c in cols], count[mine])
    models = build(table)
    _calibrate(models, drawn.where("aside").select("lang", "text"))
    return models


def _calibrate(models: Models, aside: DataFrame) -> None:
    """Temperature and spreads, from sums and bounded numbers of rows set aside."""
    n_lang = len(models.languages)

    def measure(batches):
        for batch in batches:
            for part in cut_by_bytes(batch, 1):
                bits, squares, count = models.entropies(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bits.tolist(), pa.list_(pa.float64())), pa.array(squares.tolist(), pa.list_(pa.float64())), pa.array(count, pa.int64())], names=["lang", "bits", "squares", "n"])

    rows = aside.mapInArrow(measure, "lang string, bits array<double>, squares array<double>, n long").where("n > 0").collect()
    models.mean, models.within, models.between = np.full(n_lang, 4.0), np.full(n_lang, 6.0), np.full(n_lang, 0.05)
    at = {x: j for j, x in enumerate(models.languages)}
    rows = [r for r in rows if r["lang"] in at]
    for lang, j in at.items():
        mine = [r for r in rows if r["lang"] == lang]
        n = np.array([r["n"] for r in mine], float)
        if n.sum() < 200:
            continue
        mean = np.array([r["bits"][j] for r in mine])
        square = np.array([r["squares"][j] for r in mine])
        models.mean[j] = (mean * n).sum() / n.sum()
        models.within[j] = max(0.1, (square * n).sum() / n.sum() - models.mean[j] ** 2)
        models.between[j] = max(0.01, float(np.average(np.maximum((mean - models.mean[j]) ** 2 - models.within[j] / n, 0), weights=n)))
    if n_lang > 1 and rows:
        bits = np.array([r["bits"] for r in rows])
        count = np.array([r["n"] for r in rows])
        true = np.array([at[r["lang"]] for r in rows])
        losses = []
        grid = [0.1 * 1.5**k for k in range(16)]
        for t in grid:
            z = models._scaled(bits, bits.min(1), count, t)
            losses.append(float((z[np.arange(len(true)), true] + np.log(np.exp(-z).sum(1))).mean()))
        models.temperature = max(t for t, x in zip(grid, losses) if x <= min(losses) + 0.01)


def identify(docs: DataFrame, models: Models, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Kept columns with lang_pred, score (0 to 1) and rejected, of every whole text."""

    def make():
        def run(array: pa.Array):
            lang, score, rejected = models.predict(array.to_pylist())
            return pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(rejected)

        return run

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return append_columns(docs, text_col, make, fields, keep, limit=1 << 18)
