"""Language-model scores by prediction by partial matching.

A text is its tokens: letters A-Z in lower case, words between ASCII white space, then an end; what the model predicts are the words' bytes, one space between
two words and the end. The byte-context trie holds, for each context of up to ``order`` bytes (also over words; before the start are pads), how often each byte
followed it in the learning texts. A byte has probability n / (T + D) in a context that saw it n times among T bytes, D of them distinct; else
D / (T + D) is the escape to the context that is one byte shorter, where all bytes that the longer one saw are excluded from n, T and D alike. Below
the empty context all bytes not seen yet are alike. Contexts that were never seen are passed over.

How it runs. Texts are dealt by a hash to blocks of some 16 MB. A block asks for each gram (context and byte) and each word that it holds, once, with its counts in learning
texts; these asks, a few hundredths of the bytes, are all that is counted, joined and sent back. Contexts within a row of the trie are joins and
groupings by (order, context); grams that were never learned, by far the fewest, walk down the orders in one join. Then each block's texts meet its answers. Code lengths are
summed as integers of 1e-10, so that results don't hang on how rows are dealt.

Defined results: null and empty texts are an end alone. With nothing to learn from, every byte has probability 1/256 and every token 0.1 / (0.1 * 1).
Repeated rows each have a row and each are learned from; a null learning mark means no learning. Kept columns named like a result give way to it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmere.llm.batches import column, cut_by_bytes, release_memory
from quillmere.llm.tables import drop_staged, staged

ORDER, BLOCK_BYTES = 4, 16 << 20
END, PAD = 0xFF, 0xFE  # bytes that UTF-8 never has
#: Code lengths are integers of this size.
UNIT = 1e10
#: Bytes of text whose grams are sorted together.
PART = 2 << 20
#: Orders of which the trie is small enough to be broadcast: 65,792 grams at most.
LOW = 1


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of texts laid end to end, A-Z in lower case, and len+1 offsets into them; null counts as empty."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    there = pc.not_equal(pc.binary_length(flat), 0)
    before = np.concatenate(([0], np.cumsum(there.to_numpy(zero_copy_only=False))))
    at = lists.offsets.to_numpy()
    return flat.filter(there).cast(pa.binary()), before[at - at[0]]


class Grams:
    """Grams of texts' words laid end to end: ``keys``, the last byte lowest, and where each text's grams start."""

    def __init__(self, words: pa.Array, at: np.ndarray, order: int):
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), words), b" ").to_pylist()
        pad, end = bytes([PAD]) * order, bytes([END])
        data = np.frombuffer(b"".join([pad + x + end for x in joined]), np.uint8)
        size = np.array([len(x) for x in joined], np.int64) + order + 1
        keys = data.astype(np.int64)
        for k in range(1, order + 1):
            keys[k:] |= np.left_shift(data[:-k], 8 * k, dtype=np.int64)
        begin = np.cumsum(size) - size
        mine = np.ones(len(data), bool)
        mine[(begin[:, None] + np.arange(order)).ravel()] = False
        self.keys = keys[mine]
        self.starts = np.cumsum(size - order) - (size - order)


class Table:
    """Values of distinct keys, in open addressing."""

    _MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2.5 * len(keys)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        place = np.full(1 << bits, -1, np.int64)
        at, left = self._first(keys), np.arange(len(keys))
        while len(left):
            free = left[place[at[left]] < 0]
            place[at[free]] = free
            left = left[place[at[left]] != left]
            at[left] = (at[left] + 1) & self.last
        self.key, self.value = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        self.key[at], self.value[at] = keys, values

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * self._MIX) >> self.shift).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys that are all there."""
        at = self._first(keys)
        off = np.flatnonzero(self.key[at] != keys)
        while len(off):
            at[off] = (at[off] + 1) & self.last
            off = off[self.key[at[off]] != keys[off]]
        return self.value[at]


class _Asks:
    """Distinct grams and words of one block, with their counts in learning texts."""

    def __init__(self, order: int):
        self.order, self.learned, self.words, self.held = order, 0, [], 0
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, texts: pa.Array, learn: bool) -> None:
        words, at = tokens(texts)
        found = words.value_counts()
        n = found.field(1) if learn else pa.array(np.zeros(len(found), np.int64))
        self.words.append(pa.table({"w": found.field(0), "n": n.cast(pa.int64())}))
        self.held += len(found)
        self.learned += len(texts) if learn else 0
        keys, n = np.unique(Grams(words, at, self.order).keys, return_counts=True)
        keys, n = np.concatenate((self.keys, keys)), np.concatenate((self.counts, n if learn else np.zeros(len(n), np.int64)))
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        self.keys, self.counts = keys[first], np.add.reduceat(n, first)
        if self.held > 1 << 19:
            self._settle()

    def _settle(self) -> None:
        if self.words:
            self.words = [pa.concat_tables(self.words).group_by("w").aggregate([("n", "sum")]).select(["w", "n_sum"]).rename_columns(["w", "n"])]
        self.held = 0

    def batches(self, block: int):
        self.words.append(pa.table({"w": pa.array([b""], pa.binary()), "n": pa.array([self.learned], pa.int64())}))  # the end
        self._settle()
        for b in self.words[0].to_batches(1 << 14):
            yield self._batch(block, pa.nulls(len(b), pa.int64()), b.column(0), b.column(1))
        for a in range(0, len(self.keys), 1 << 15):
            keys = self.keys[a : a + (1 << 15)]
            yield self._batch(block, pa.array(keys), pa.nulls(len(keys), pa.binary()), pa.array(self.counts[a : a + (1 << 15)]))

    def _batch(self, block, g, w, n):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), block, np.int32)), g, w, n], names=["block", "g", "w", "n"])


def _asks(rows: DataFrame, order: int) -> DataFrame:
    """(block, g, w, n) of rows (block, learn, t) that are dealt by block."""

    def run(batches):
        asks: dict[int, _Asks] = {}
        for batch in batches:
            for part in cut_by_bytes(batch, 2, PART):
                blocks, learn = part.column(0).to_numpy(), part.column(1).to_numpy(zero_copy_only=False)
                for block in np.unique(blocks).tolist():
                    for mark in (True, False):
                        mine = (blocks == block) & (learn == mark)
                        if mine.any():
                            asks.setdefault(block, _Asks(order)).add(part.column(2).filter(pa.array(mine)), mark)
        for block, found in asks.items():
            yield from found.batches(block)
        asks.clear()
        release_memory()

    return rows.select("block", "learn", "t").mapInArrow(run, "block int, g long, w binary, n long")


def _lower(key: Column, k: Column) -> Column:
    """What a gram or context is one order below: its last k bytes."""
    return key.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (8 * k).cast("int")) - 1)


def trie(grams: DataFrame, order: int) -> tuple[DataFrame, DataFrame]:
    """Learned grams (g, n) as (k, key, n), and contexts (k, ctx, total, kinds, rest, new) of all orders up to ``order``.

    ``rest`` and ``new`` are total and kinds of the context that is one byte shorter without the bytes that this one saw.
    """
    orders = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("g").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("key")) for k in range(order + 1)])).alias("x")
    nodes = staged(grams.select(orders, "n").select("x.k", "x.key", "n").groupBy("k", "key").agg(F.sum("n").alias("n")))
    ctx = nodes.groupBy("k", F.shiftright("key", 8).alias("ctx")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    shorter = nodes.select((F.col("k") + 1).alias("k"), F.col("key").alias("low"), F.col("n").alias("n_low"))
    met = nodes.where("k > 0").select("k", "key", _lower(F.col("key"), F.col("k")).alias("low")).join(shorter, ["k", "low"])
    taken = met.groupBy("k", F.shiftright("key", 8).alias("ctx")).agg(F.sum("n_low").alias("taken"))
    below = ctx.select((F.col("k") + 1).alias("k"), F.col("ctx").alias("low"), F.col("total").alias("total_low"), F.col("kinds").alias("kinds_low"))
    with_low = ctx.join(taken, ["k", "ctx"], "left").withColumn("low", _lower(F.col("ctx"), F.col("k") - 1)).join(below, ["k", "low"], "left")
    return nodes, staged(with_low.select("k", "ctx", "total", "kinds", (F.col("total_low") - F.col("taken")).alias("rest"), (F.col("kinds_low") - F.col("kinds")).alias("new")))


def _escaped(xs: Column) -> Column:
    """log10 of the probability of a byte, from what its contexts say, the longest one first."""

    def step(s: Column, x: Column) -> Column:
        from_longer = s["rest"].isNotNull()
        total, kinds = F.when(from_longer, s["rest"]).otherwise(x["total"]), F.when(from_longer, s["new"]).otherwise(x["kinds"])
        out = F.when(x["n"].isNotNull(), x["n"]).when(total > 0, kinds).otherwise(F.lit(1)) / F.when(x["n"].isNotNull() | (total > 0), total + kinds).otherwise(F.lit(1))
        seen = F.struct(x["n"].isNotNull().alias("done"), (s["log"] + F.log10(out)).alias("log"), x["rest"].alias("rest"), x["new"].alias("new"), x["kinds"].alias("kinds"))
        return F.when(s["done"] | x["total"].isNull(), s).otherwise(seen)

    none = F.lit(None).cast("long")
    start = F.struct(F.lit(False).alias("done"), F.lit(0.0).alias("log"), none.alias("rest"), none.alias("new"), F.lit(0).cast("long").alias("kinds"))
    return F.aggregate(xs, start, step, lambda s: s["log"] - F.when(s["done"], F.lit(0.0)).otherwise(F.log10(F.greatest(F.lit(1), 256 - s["kinds"]))))


def code_lengths(grams: DataFrame, order: int) -> DataFrame:
    """(g, x): the log10 probability of each gram (g, n), n null or 0 if it wasn't learned, in units of 1e-10."""
    seen = F.col("n") > 0
    nodes, contexts = trie(grams.where(seen), order)
    unit = lambda c: F.rint(c * UNIT).cast("long").alias("x")
    own = contexts.where(F.col("k") == order).select("ctx", "total", "kinds")
    known = grams.where(seen).withColumn("ctx", F.shiftright("g", 8)).join(own, "ctx").select("g", unit(F.log10(F.col("n") / (F.col("total") + F.col("kinds")))))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("g").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("key")) for k in range(order + 1)])).alias("x")
    rows = grams.where(~seen).select("g", each).select("g", "x.k", "x.key", F.shiftright("x.key", 8).alias("ctx"))

    def looked_up(rows, low):
        part = "k <= " + str(LOW) if low else "k > " + str(LOW)
        by = F.broadcast if low else (lambda t: t)  # every unlearned gram asks for the shortest contexts
        return rows.where(part).join(by(contexts.where(part)), ["k", "ctx"], "left").join(by(nodes.where(part)), ["k", "key"], "left")

    found = looked_up(rows, True).unionByName(looked_up(rows, False))
    lists = found.groupBy("g").agg(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("depth"), "n", "total", "kinds", "rest", "new"))).alias("xs"))
    return known.unionByName(lists.select("g", unit(_escaped(F.col("xs")))))


_MADE = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])


def _scored(rows: DataFrame, order: int, total: int, unknown: int) -> DataFrame:
    """Results of rows (g, w, x, r, t) dealt by block: answers (g or w, with x) and texts."""

    def run(batches):
        keys, lengths, words, costs, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [pa.array([], pa.binary())], [np.zeros(0, np.int64)], []
        for batch in batches:
            g, w, x = batch.column(0), batch.column(1), batch.column(2)
            told, named = g.is_valid(), w.is_valid()
            keys.append(g.filter(told).to_numpy())
            lengths.append(x.filter(told).to_numpy())
            words.append(w.filter(named))
            costs.append(x.filter(named).to_numpy())
            texts = batch.select([3, 4]).filter(batch.column(4).is_valid())
            if texts.num_rows:
                held.append(texts)
        table, words, costs = Table(np.concatenate(keys), np.concatenate(lengths)), pa.concat_arrays(words), np.concatenate(costs)
        last = pc.index_in(pa.scalar(b"", pa.binary()), value_set=words).as_py()
        for part in (p for batch in held for p in cut_by_bytes(batch, 1, PART)):
            own, at = tokens(part.column(1))
            place = pc.index_in(own, value_set=words).fill_null(-1).to_numpy().astype(np.int64)
            there = np.concatenate(([0], np.cumsum(place >= 0)))
            spent = np.concatenate(([0], np.cumsum(np.where(place >= 0, costs[np.maximum(place, 0)] if len(costs) else 0, unknown))))
            n, known = np.diff(at) + 1, np.diff(there[at]) + (last is not None)
            plain = np.diff(spent[at]) + (unknown if last is None else costs[last])
            found = Grams(own, at, order)
            score = np.add.reduceat(table[found.keys], found.starts)
            made = [pa.array(n), pa.array(known), pa.array(np.full(len(n), total, np.int64)), pa.array(plain / UNIT), pa.array(score / UNIT)]
            yield pa.RecordBatch.from_arrays([part.column(0), *made], names=["r", *_MADE.names])
        release_memory()

    return rows.select("g", "w", "x", "r", "t").mapInArrow(run, T.StructType([rows.schema["r"], *_MADE.fields]))


def partial_matching_scores(docs: DataFrame, learn: Column, text_col: str = "text", keep: Sequence[str] | None = None, order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Kept columns (all, if None) with n_tokens, n_known, train_tokens, base_score and score of every whole text; rows where ``learn`` is true are learned from.

    ``score`` is the model's log10 probability of the text's bytes, ``base_score`` that of its tokens by counts of words with 0.1 added.
    """
    if not 1 <= order <= 6:
        raise ValueError(f"order must be 1 to 6, got {order}")
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in _MADE.names]
    text = column(text_col).cast("string")
    rows = docs.select(F.struct(*[column(c) for c in keep], F.lit(0).alias("__")).alias("r"), F.coalesce(learn, F.lit(False)).alias("learn"), F.coalesce(text, F.lit("")).alias("t"))
    size = docs.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 16).alias("s")).first()["s"] or 0
    blocks = int(size // block_bytes) + 1
    rows = rows.withColumn("block", F.pmod(F.xxhash64("r", "t"), F.lit(blocks)).cast("int"))
    asks = staged(_asks(rows.repartitionById(blocks, "block"), order))
    vocabulary = staged(asks.where("w is not null").groupBy("w").agg(F.sum("n").alias("c")).where("c > 0"))
    total, kinds = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    plain = lambda c: F.log10((c + 0.1) / (total + 0.1 * (kinds + 1)))
    unit = lambda c: F.rint(c * UNIT).cast("long")
    unknown = docs.sparkSession.range(1).select(unit(plain(F.lit(0.0)))).first()[0]
    grams = staged(asks.where("w is null").groupBy("g").agg(F.sum("n").alias("n")))
    lengths = staged(code_lengths(grams, order))
    none = lambda t: F.lit(None).cast(t)
    words = asks.where("w is not null").join(vocabulary.select("w", unit(plain(F.col("c"))).alias("x")), "w").select("block", none("long").alias("g"), "w", "x")
    told = asks.where("w is null").select("block", "g").join(lengths, "g").select("block", "g", none("binary").alias("w"), "x")
    empty = [none("long").alias("g"), none("binary").alias("w"), none("long").alias("x")]
    kind = rows.schema["r"].dataType
    met = rows.select("block", *empty, "r", "t").unionByName(words.unionByName(told).select("block", "g", "w", "x", none(kind).alias("r"), none("string").alias("t")))
    out = staged(_scored(met.repartitionById(blocks, "block"), order, total, unknown))
    for table in (asks, vocabulary, grams, lengths):
        drop_staged(table)
    return out.select(*[F.col("r")[c].alias(c) for c in keep], *_MADE.names)
