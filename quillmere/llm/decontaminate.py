"""Benchmark decontamination: size-partitioned MinHash containment search.

A test item is found in a document if at least ``share`` of the item's distinct
word shingles are in it. Items are short and documents long, so a sketch of a
document says little about one passage; the item's side is sketched instead.
Items are partitioned by their number of shingles, in powers of two. A match may miss
m = floor((1 - share) * size) shingles, size the upper one of the partition; an item's sketch is its
2 * m + 2 smallest hash values (all, if it has fewer), of which a match then has all but m. Documents probe the
sketches of each partition with all of their shingles, so no match of the wanted containment is missed,
and one common shingle makes no candidate. Candidates are verified by exact containment of the shingles' words.

Words are runs of letters, digits and marks, in lower case; a character of a script
that is written without spaces is a word of its own.
Fewer words than ``words`` make one shingle of what there is; an item without a word
matches nothing. With ``short``, an item of fewer words is found wherever these stand in a row:
documents then probe with shingles of its length too. Null texts are empty. Repeated rows of documents are each
looked at, repeated items are one match each. Items are streamed in blocks of bounded size, each broadcast
to one pass over the documents, whose result is written before the next block is read: a benchmark of any size is searched
whole, and one block at a time is held by the driver and the executors.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmere.llm.batches import append_columns, column, free_name, raw_bytes
from quillmere.llm.tables import staged

WORDS, SHARE = 5, 0.8
#: Bytes of item text in one block.
BLOCK_BYTES = 8 << 20
_P = 0x9E3779B97F4A7C15
_INV = pow(_P, -1, 1 << 64)
_WORD = np.zeros(256, bool)
_WORD[[*b"0123456789abcdefghijklmnopqrstuvwxyz"]] = True
#: Scripts written without spaces, as ranges of code points: Thai and Lao, Myanmar, Khmer, kana and bopomofo, Han.
UNSPACED = [(0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFF)]


@functools.lru_cache(1)
def _kinds() -> np.ndarray:
    """Of each code point, 0: no part of a word, 1: part of one, 2: a word of its own, 3: a mark, which goes with what is before it."""
    initial = "".join(unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1))
    letter = np.frombuffer(initial.encode(), np.uint8)
    out = np.isin(letter, [*b"LN"]).astype(np.uint8)
    for a, b in UNSPACED:
        out[a : b + 1] *= 2
    out[letter == ord("M")] = 3
    return out


def _cut(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of each word of UTF-8 texts laid end to end."""
    word = _WORD[data]
    cut = np.zeros(len(data) + 1, bool)  # before which bytes a word ends, whatever follows
    cut[at] = True
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        size = 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
        code = data[lead].astype(np.int64) & (0x7F >> size)
        for k in range(1, 4):
            more = size > k
            code[more] = code[more] << 6 | data[lead[more] + k] & 0x3F
        kind = _kinds()[code]
        for k in range(4):
            part = size > k
            word[lead[part] + k] = kind[part] > 0
        own = kind == 2
        cut[lead[own]] = True
        end = lead[own] + size[own]
        # marks after a character that is a word of its own belong to it
        mark = np.zeros(len(data) + 4, np.uint8)
        mark[lead[kind == 3]] = size[kind == 3]
        while len(end):
            step = mark[end]
            cut[end[step == 0]] = True
            end = end[step > 0] + step[step > 0]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1] | cut[1:-1]
    ends[:-1] &= ~word[1:] | cut[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ h >> np.uint64(32)
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ h >> np.uint64(29)
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ h >> np.uint64(32)


#: Bytes of text handed to one call: what is laid beside a byte is some 30 times as large.
BATCH_BYTES = 1 << 18
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers, from a table that grows to the longest batch."""
    if len(_POWERS.get(base, ())) < n:
        out = np.full(max(n, BATCH_BYTES + 1), base, np.uint64)
        out[0] = 1
        _POWERS[base] = np.multiply.accumulate(out, out=out)
    return _POWERS[base][:n]


class Words:
    """Words of texts laid end to end: starts, ends, text of each and hash."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.start, self.end = _cut(data, at)
        self.text = np.searchsorted(at, self.start, "right") - 1
        # a word's polynomial hash from running sums, shifted to the word's start
        with np.errstate(over="ignore"):
            sums = np.zeros(len(data) + 1, np.uint64)
            np.add(data, np.uint64(1), out=sums[1:])
            sums[1:] *= _powers(_P, len(data))
            np.cumsum(sums, out=sums)
            self.hash = _mix((sums[self.end] - sums[self.start]) * _powers(_INV, len(data) + 1)[self.start])
        self.count = np.bincount(self.text, minlength=len(at) - 1)

    def shingles(self, words: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word of each shingle, in order; with ``whole``, a text of fewer words is one shingle."""
        n = len(self.hash)
        size = np.minimum(self.count[self.text], words)
        first = np.cumsum(self.count) - self.count
        place = np.arange(n) - first[self.text]
        start = np.flatnonzero((place <= self.count[self.text] - size) & (whole | (size == words)))
        with np.errstate(over="ignore"):
            h = np.zeros(len(start), np.uint64)
            for k in range(words):
                there = size[start] > k
                h[there] = h[there] * np.uint64(_P) + self.hash[start[there] + k]
        return _mix(h), start


def normal_words(text: str | None) -> list[str]:
    raw = (text or "").lower().encode()
    start, end = _cut(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    return [raw[a:b].decode() for a, b in zip(start.tolist(), end.tolist())]


def shingle_set(text: str | None, words: int = WORDS) -> set[tuple[str, ...]]:
    parts = normal_words(text)
    if not parts:
        return set()
    return {tuple(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))}


class ItemIndex:
    """Sketches of items, by size partition, and the items' shingles for verification."""

    def __init__(self, items: list[tuple[object, str]], words: int = WORDS, share: float = SHARE, short: bool = False):
        self.words, self.share = words, share
        self.ids, self.texts, self.size, self.needed = [], [], [], []
        keys, owners = [], []
        lower = [(t or "").lower().encode() for _, t in items]
        at = np.concatenate(([0], np.cumsum([len(t) for t in lower]))).astype(np.int64)
        found = Words(np.frombuffer(b"".join(lower), np.uint8), at)
        hashes, start = found.shingles(words)
        owner = found.text[start]
        for k, (i, t) in enumerate(items):
            own = np.unique(hashes[np.searchsorted(owner, k) : np.searchsorted(owner, k + 1)])
            n = len(own)
            if n == 0:
                continue
            upper = 1 << (n - 1).bit_length()  # size partition: over upper/2 and up to upper
            sketch = min(n, 2 * int(np.floor((1 - share) * upper + 1e-9)) + 2)
            keys.append(own[:sketch])
            owners.append(np.full(sketch, len(self.ids)))
            self.needed.append(max(1, sketch - int(np.floor((1 - share) * n + 1e-9))))
            self.ids.append(i)
            self.texts.append(t)
            self.size.append(min(int(found.count[k]), words) if short else words)
        key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        own = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.owner = key[order], own[order]
        # a coarse table of key prefixes lets most probes end at one look
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.key >> np.uint64(42)).astype(np.int64)] = True
        self._sets: dict[int, set] = {}  # of items that were candidates

    def matches(self, data: np.ndarray, at: np.ndarray, texts: list[str]) -> list[tuple[int, int, float]]:
        """(text, item, containment) of each match."""
        if not len(self.key) or not len(data):
            return []
        found = Words(data, at)
        hits = set()  # of values of a sketch, each once a text
        for size in {self.words, *self.size}:
            hashes, start = found.shingles(size, size == self.words)
            probe = np.flatnonzero(self.seen[(hashes >> np.uint64(42)).astype(np.int64)])
            h = hashes[probe]
            lo, hi = np.searchsorted(self.key, h, "left"), np.searchsorted(self.key, h, "right")
            hit = np.flatnonzero(hi > lo)
            for text, a, b in zip(found.text[start[probe[hit]]].tolist(), lo[hit].tolist(), hi[hit].tolist()):
                hits.update((text, place) for place in range(a, b))
        met = Counter((text, int(self.owner[place])) for text, place in hits)
        pairs = [(text, item) for (text, item), n in met.items() if n >= self.needed[item]]
        out, last, own, sets = [], None, {}, self._sets
        for text, item in sorted(pairs):
            if text != last:
                last, own = text, {}
            size = self.size[item]
            if size not in own:
                own[size] = shingle_set(texts[text], size)
            if len(sets) > 4096:
                sets.clear()
            if item not in sets:
                sets[item] = shingle_set(self.texts[item], self.words)
            wanted = sets[item]
            part = len(wanted & own[size]) / len(wanted)
            if part >= self.share - 1e-12:
                out.append((text, item, part))
        return out


def _blocks(items: DataFrame, id_col: str, text_col: str, limit: int):
    """Lists of (id, text) of at most ``limit`` bytes of text, or one item, streamed from the table."""
    block, held = [], 0
    for r in items.select(column(id_col).alias("i"), column(text_col).alias("t")).where("t is not null").toLocalIterator():
        size = len(r["t"].encode())
        if block and held + size > limit:
            yield block
            block, held = [], 0
        block.append((r["i"], r["t"]))
        held += size
    if block:
        yield block


def _passes(items: DataFrame, id_col: str, text_col: str, limit: int, words: int, share: float, short: bool, look) -> list[DataFrame]:
    """``look(index, results so far)`` for each block of items; where there are several, each result is written and its index dropped before the next."""
    sc, blocks, done = items.sparkSession.sparkContext, _blocks(items, id_col, text_col, limit), []
    block, following = next(blocks, []), next(blocks, None)
    while block is not None:
        index = sc.broadcast(ItemIndex(block, words, share, short))
        if following is None and not done:
            return [look(index, done)]
        done.append(staged(look(index, done)))
        index.destroy()
        block, following = following, next(blocks, None)
    return done


def contained_items(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    words: int = WORDS, share: float = SHARE, keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES, short: bool = False,
) -> DataFrame:
    """One row per match: kept columns (the id, if None), item id and containment."""
    keep = [id_col] if keep is None else keep
    kind = items.schema[item_id].dataType
    out_fields = [T.StructField("__found", T.ArrayType(T.StructType([T.StructField(item_id, kind), T.StructField("containment", T.DoubleType())])))]

    def look(index, _):
        def make():
            def run(array: pa.Array):
                texts = [(t or "").lower() for t in array.to_pylist()]
                data, at = raw_bytes(pa.array(texts, pa.string()))
                rows: list[list] = [[] for _ in texts]
                for text, item, part in index.value.matches(data, at, texts):
                    rows[text].append({item_id: index.value.ids[item], "containment": part})
                from pyspark.sql.pandas.types import to_arrow_type

                return [pa.array(rows, to_arrow_type(out_fields[0].dataType))]

            return run

        found = append_columns(docs, text_col, make, out_fields, keep, limit=BATCH_BYTES).where(F.size("__found") > 0)
        return found.select(*[column(c) for c in keep if c.lower() not in (item_id.lower(), "containment")], F.inline("__found"))

    return functools.reduce(DataFrame.unionByName, _passes(items, item_id, item_text, block_bytes, words, share, short, look))


def without_items(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    words: int = WORDS, share: float = SHARE, short: bool = False, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The documents, all columns, in which no item is found; one pass for each block of items."""
    flag = free_name("__leaked", docs.columns)

    def look(index, done):
        def make():
            def run(array: pa.Array):
                texts = [(t or "").lower() for t in array.to_pylist()]
                data, at = raw_bytes(pa.array(texts, pa.string()))
                leaked = np.zeros(len(texts), bool)
                leaked[[t for t, _, _ in index.value.matches(data, at, texts)]] = True
                return [pa.array(leaked)]

            return run

        found = append_columns(done[-1] if done else docs, text_col, make, [T.StructField(flag, T.BooleanType())], limit=BATCH_BYTES)
        return found.where(~column(flag)).drop(flag)

    return _passes(items, item_id, item_text, block_bytes, words, share, short, look)[-1]
