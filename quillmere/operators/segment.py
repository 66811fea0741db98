"""Words of CJK text: a dictionary learned from the corpus, and the likeliest path through the lattice of its words.

Learning counts all runs' grams of up to ``longest`` + 1 characters. A gram of two characters or more is a word if it is there ``least`` times, if it hangs
together (at each place where it could be cut it is ``cohesion`` times as frequent as its parts would give by chance) and if it is no fragment (no longer gram of one more character, before or after, has
more than ``fragment`` of its places). Everything about it is counts and joins by gram.

A text's words are those whose product of frequencies is greatest: a lattice over each run, walked from its end, with a table of all words' prefixes as the trie.
Single characters that the dictionary lacks count once. Of paths that are as likely the one whose first word is longer is taken.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.functions.text import analyze, normal_text

RUN = r"[\x{4e00}-\x{9fff}]+"
#: Words of a dictionary at most, the most frequent ones: what each task holds.
MOST = 200_000


def _grams(docs: DataFrame, text_col: str, longest: int) -> DataFrame:
    """(gram, n) of all runs' grams of up to that many characters."""
    runs = docs.select(F.explode(F.regexp_extract_all(normal_text(F.coalesce(F.col(text_col), F.lit(""))), F.lit(RUN), F.lit(0))).alias("run"))
    at = F.explode(F.sequence(F.lit(1), F.length("run")))
    # each place once, then its grams: those that reach over the run's end are left out
    tails = runs.groupBy("run").agg(F.count("*").alias("n")).select("n", "run", at.alias("at")).select("n", F.substring(F.col("run"), F.col("at"), F.lit(longest)).alias("tail"))
    lengths = F.explode(F.sequence(F.lit(1), F.length("tail")))
    return tails.groupBy("tail").agg(F.sum("n").alias("n")).select("n", "tail", lengths.alias("k")).select(F.substring(F.col("tail"), F.lit(1), F.col("k")).alias("gram"), "n").groupBy("gram").agg(F.sum("n").alias("n"))


def learn_words(docs: DataFrame, text_col: str, longest: int = 4, least: int = 5, cohesion: float = 20.0, fragment: float = 0.8, most: int = MOST) -> DataFrame:
    """(word, n) of a dictionary: single characters and learned words with their counts."""
    from quillmere.functions.tables import staged

    grams = staged(_grams(docs, text_col, longest + 1).withColumn("k", F.length("gram")))
    total = grams.where("k = 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    asked = grams.where((F.col("k") > 1) & (F.col("k") <= longest) & (F.col("n") >= least))
    cuts = asked.select("gram", "n", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("at")).select("gram", "n", F.substring(F.col("gram"), F.lit(1), F.col("at")).alias("a"), F.expr("substring(gram, at + 1)").alias("b"))
    parts = grams.select("gram", "n").where(F.length("gram") < longest)
    held = cuts.join(parts.select(F.col("gram").alias("a"), F.col("n").alias("n_a")), "a").join(parts.select(F.col("gram").alias("b"), F.col("n").alias("n_b")), "b")
    tied = held.crossJoin(F.broadcast(total)).groupBy("gram", "n").agg(F.min(F.col("n") * F.col("total") / (F.col("n_a") * F.col("n_b"))).alias("c")).where(F.col("c") >= cohesion)
    longer = grams.where((F.col("k") > 2) & (F.col("n") >= least))
    around = longer.select(F.expr("substring(gram, 1, k - 1)").alias("gram"), F.col("n").alias("m")).unionByName(longer.select(F.expr("substring(gram, 2)").alias("gram"), F.col("n").alias("m")))
    inner = around.groupBy("gram").agg(F.max("m").alias("m"))
    words = tied.join(inner, "gram", "left").where(F.coalesce("m", F.lit(0)) <= F.lit(fragment) * F.col("n")).select("gram", "n")
    return grams.where("k = 1").select("gram", "n").unionByName(words).select(F.col("gram").alias("word"), "n").orderBy(F.desc("n"), "word").limit(most)


class Lattice:
    """Words with their counts; ``split`` cuts a run into the likeliest ones."""

    def __init__(self, counts: dict[str, int]):
        self.total = max(1, sum(counts.values()))
        self.log = {w: math.log(n / self.total) for w, n in counts.items() if w and n > 0}
        self.unknown = math.log(1 / self.total)
        self.prefixes = {w[:k] for w in self.log for k in range(1, len(w) + 1)}

    def split(self, run: str) -> list[str]:
        best, step = [0.0] * (len(run) + 1), [1] * len(run)
        for i in range(len(run) - 1, -1, -1):
            top, j = self.log.get(run[i], self.unknown) + best[i + 1], i + 1
            while run[i:j] in self.prefixes and j < len(run):
                j += 1
                log = self.log.get(run[i:j])
                if log is not None and log + best[j] >= top:
                    top, step[i] = log + best[j], j - i
            best[i] = top
        out, i = [], 0
        while i < len(run):
            out.append(run[i : i + step[i]])
            i += step[i]
        return out

    def needed(self, word: str) -> int:
        """The least count with which a word is as likely as the path that it has now."""
        p = sum(self.log.get(w, self.unknown) for w in self.split(word))
        return max(1, math.floor(math.exp(p) * self.total) + 1)


class Dictionary:
    """Learned words (word, n) with domain words, which stay whole: those without a count get the least one that keeps them so.

    The words are collected: there are at most ``most`` of the learned ones, and domain words are a list that people write.
    """

    def __init__(self, words: DataFrame, domain: dict[str, int | None] | None = None):
        counts = {r["word"]: r["n"] for r in words.collect()}
        base = Lattice(counts)
        for word, n in (domain or {}).items():
            counts[word] = max(counts.get(word, 0), n if n is not None else base.needed(word))
        self._shared = words.sparkSession.sparkContext.broadcast(Lattice(counts))

    def spaced(self, text: Column) -> Column:
        """The text with a blank between the words of each CJK run; texts without any don't leave the JVM."""
        shared = self._shared

        @F.pandas_udf("string")
        def run(s: pd.Series) -> pd.Series:
            import re

            known: dict[str, str] = {}

            def words(m):
                run = m.group()
                if run not in known:
                    if len(known) > 1 << 16:
                        known.clear()
                    known[run] = " ".join(shared.value.split(run))
                return known[run]

            return s.map(lambda t: None if t is None else re.sub("[一-鿿]+", words, t))

        odd = text.rlike(r"[\x{4e00}-\x{9fff}]{2}")
        return F.when(odd, F.coalesce(run(F.when(odd, text)), text)).otherwise(text)

    def analyze(self, text: Column, keep_stopwords: bool = False) -> Column:
        """Index terms as of ``functions.text.analyze``, with words in place of bigrams."""
        return analyze(self.spaced(normal_text(F.coalesce(text, F.lit("")))), keep_stopwords, cjk=False)
