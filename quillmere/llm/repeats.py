"""Suffix-array dedup: bytes that any repeated string of ``LENGTH`` bytes covers.

Method: a run-length index. A run-compressed Burrows-Wheeler transform keeps each run's symbol and
first row, the row that its head is led to by the step to the symbol before (LF), and, as samples at its two ends, how far
the suffixes that these are led to agree with the next ones outside of the run. Matching statistics are streamed from it backwards
from each segment's end: a step over a run's inner row adds one byte to what a suffix and its neighbour agree in, a
step over a run's end takes the sample. A place whose statistic reaches LENGTH starts a repeated string.

One transform of all text can't be built in pieces, so text is dealt first, without
loss. Every string of LENGTH bytes has an anchor, the smallest of the hashes of its
K-byte strings (the leftmost of equal ones); equal strings have equal anchors, at
equal offsets. Consecutive strings of a document with the same anchor make one segment,
and strings can only be equal within segments of one anchor's value:

1. Segments are grouped by anchor and by content hash, pre-aggregated. A content
   that occurs twice is repeated throughout; an anchor with one content only,
   once, has no repeat. Only the rest goes on, one copy of each content.
2. Anchors with up to ``GROUP`` contents are indexed: their segments' text is dealt by
   anchor, and each task builds run-length indexes of blocks of whole anchors. Starts
   are taken relative to the anchor in classes of ``CLASS``; all strings of a class share its
   core, and only classes whose core another segment has are laid into the index, equal ones once.
3. Segments of anchors with more are cut into their classes and dealt again, by anchor, class and core, and go through 1 and 2
   once more. Where over ``GROUP`` different contents share even a core, they are cut into single strings, of which 1 says all:
   each string's hash is counted, pre-aggregated. No group is gathered anywhere.

Content hashes have 64 bits and are compared only within one anchor's hash of 64 bits; rows are told apart by hashes of
96 bits of id and text.

Null is an empty text. Matches never cross documents. Rows that repeat (id and
text) repeat each other's text, and each set of marks is kept once for all of them. An id may be null or repeated. An empty table
gives an empty result; other columns are not carried.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmere.llm.batches import column, cut_by_bytes, raw_bytes
from quillmere.llm.tables import drop_staged, staged

LENGTH, K = 200, 32
#: Contents of one anchor that are indexed together, and bytes of one index.
GROUP, INDEX_BYTES = 8192, 2 << 20
#: Starts relative to the anchor, from K - LENGTH to 0, that are looked at together.
CLASS = 24
_SHIFT = np.uint64(24)
_LOW = np.uint64((1 << 24) - 1)


# ---- anchors --------------------------------------------------------------


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the K bytes that start at each place but the last K-1."""
    n = len(data) - K + 1
    words = np.ndarray((len(data) - 7,), np.uint64, data.tobytes(), 0, (1,))
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, K, 8):
            h ^= words[k : k + n]
            h *= np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive values."""
    step, out = 1, x
    while 2 * step <= w:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    return np.minimum(out[: len(x) - w + 1], out[w - step : w - step + len(x) - w + 1]) if step < w else out


def segments(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first string, number of strings, anchor's place after the first, anchor hash) of each segment of one text; together they hold every string once."""
    windows = len(data) - length + 1
    if windows <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    h = _gram_hashes(data)
    starts, anchors, places = [], [], []
    block = 1 << 22  # places fit the low bits
    for a in range(0, windows, block):
        part = h[a : min(len(h), a + block + length - K)]
        key = part & ~_LOW | np.arange(len(part), dtype=np.uint64)
        place = (_window_min(key, length - K + 1) & _LOW).astype(np.int64) + a
        cut = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
        starts.append(cut + a)
        places.append(place[cut])
        anchors.append(h[place[cut]])
    start = np.concatenate(starts)
    return start, np.diff(np.append(start, windows)), np.concatenate(places) - start, np.concatenate(anchors)


# ---- run-length index -----------------------------------------------------


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Places of all suffixes in order, by doubling from keys of four symbols; ``text`` is uint16, 0 an end."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(4, np.uint16))).astype(np.uint64)
    key = padded[:n] << np.uint64(48) | padded[1 : n + 1] << np.uint64(32) | padded[2 : n + 2] << np.uint64(16) | padded[3 : n + 3]
    order = np.argsort(key)
    new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    rank = np.empty(n, np.int64)
    first = np.flatnonzero(new)
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))
    step = 4
    # only places whose rank is shared are sorted on
    while True:
        size = np.diff(np.append(first, n))
        shared = np.flatnonzero(np.repeat(size > 1, size))
        if not len(shared):
            return order
        at = order[shared]
        nxt = at + step
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        base = rank[at]
        key = base.astype(np.uint64) << np.uint64(32) | second.astype(np.uint64)
        put = np.argsort(key)
        order[shared] = at[put]
        sorted_key = key[put]
        differs = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
        new_first = np.zeros(n, bool)
        new_first[first] = True
        new_first[shared] |= differs
        first = np.flatnonzero(new_first)
        # ranks of the places just sorted
        head = np.searchsorted(first, shared, "right") - 1
        rank[order[shared]] = first[head]
        step *= 2


def _agreement(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols the suffixes at a and b share before either ends its segment."""
    padded = np.concatenate((text, np.zeros(8, np.uint16)))
    words = np.ndarray((len(text) + 5,), np.uint64, padded.tobytes(), 0, (2,))
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    lanes = np.uint64(0x0001000100010001)
    while len(live):
        x, y = words[a[live] + out[live]], words[b[live] + out[live]]
        # a lane counts if it is equal and no end
        diff = x ^ y
        with np.errstate(over="ignore"):
            ends = (x - lanes) & ~x & (lanes << np.uint64(15))
        whole = (diff == 0) & (ends == 0)
        go = live[whole]
        out[go] += 4
        stop = np.flatnonzero(~whole)
        for lane in range(4):
            s = np.uint64(16 * lane)
            lx, ly = x[stop] >> s & np.uint64(0xFFFF), y[stop] >> s & np.uint64(0xFFFF)
            ok = (lx == ly) & (lx != 0)
            out[live[stop[ok]]] += 1
            stop = stop[ok]
        live = go
    return out


class RunLengthIndex:
    """Runs of a Burrows-Wheeler transform with samples at their ends.

    ``text`` holds segments as bytes plus one, each followed by a 0. Nothing of the size of the text is kept
    but the segments' ends: ``run_start``, ``run_symbols`` and ``run_target`` (the row that the step to the symbol
    before leads a run's head to) have an entry a run, and so have the samples ``up`` and ``down``.
    """

    def __init__(self, text: np.ndarray):
        n = len(text)
        order = suffix_order(text)
        last = text[order - 1]
        change = np.flatnonzero(last[1:] != last[:-1]) + 1
        self.size = n
        self.run_start = np.concatenate(([0], change))
        self.run_symbols = last[self.run_start]
        self.run_lengths = np.diff(np.append(self.run_start, n))
        by_symbol = np.argsort(self.run_symbols, kind="stable")
        self.run_target = np.empty_like(self.run_start)
        self.run_target[by_symbol] = np.cumsum(self.run_lengths[by_symbol]) - self.run_lengths[by_symbol]
        head, tail = self.run_target, self.run_target + self.run_lengths - 1
        self.up = np.where(head > 0, _agreement(text, order[head], order[np.maximum(head - 1, 0)]), 0)
        self.down = np.where(tail < n - 1, _agreement(text, order[tail], order[np.minimum(tail + 1, n - 1)]), 0)
        self.ends = np.flatnonzero(text == 0)
        row = np.empty(n, np.int64)
        row[order] = np.arange(n)
        self.end_rows = row[self.ends]

    def matching_statistics(self) -> np.ndarray:
        """For each place, the longest string from there within its segment that stands elsewhere in the collection too.

        All segments are walked at once, from their ends; the longest come first, so those still walked are the first ones.
        """
        out = np.zeros(self.size, np.int64)
        length = np.diff(self.ends, prepend=-1) - 1
        longest = np.argsort(-length, kind="stable")
        at, row = self.ends[longest], self.end_rows[longest]
        live = np.searchsorted(-length[longest], -np.arange(1, int(length.max(initial=0)) + 1), "right")
        up, down = np.zeros((2, len(at)), np.int64)
        for step, n in enumerate(live.tolist(), 1):
            row, up, down = row[:n], up[:n], down[:n]
            run = np.searchsorted(self.run_start, row, "right") - 1
            inner = row - self.run_start[run]
            up = np.where(inner == 0, self.up[run], up + 1)
            down = np.where(inner == self.run_lengths[run] - 1, self.down[run], down + 1)
            row = self.run_target[run] + inner
            out[at[:n] - step] = np.maximum(up, down)
        return out


def repeated_starts(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each of different segments, whether the string at each of its places is in another place of any."""
    size = np.array([len(p) + 1 for p in parts])
    text = np.frombuffer(b"\0".join([*parts, b""]), np.uint8).astype(np.uint16) + 1
    ends = np.cumsum(size) - 1
    text[ends] = 0
    hit = RunLengthIndex(text).matching_statistics() >= length
    begin = ends + 1 - size
    return [hit[a : b - length + 1] for a, b in zip(begin.tolist(), ends.tolist())]


# ---- the operator ---------------------------------------------------------

#: ``place`` holds the first string, the number of strings and the anchor's place after the first, in 48, 8 and 8 bits.
_SEGMENT = "anchor long, content long, rk long, rk2 int, place long"


def _place(start: np.ndarray, strings: np.ndarray, after: np.ndarray) -> np.ndarray:
    return start << 16 | strings << 8 | after


def _segment_rows(length: int):
    names = [f.split()[0] for f in _SEGMENT.split(", ")]

    def run(batches):
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for part in cut_by_bytes(batch, 2):
                data, at = raw_bytes(part.column(2))
                keys, more = (part.column(k).to_numpy(zero_copy_only=False) for k in range(2))
                rows = []
                for i in np.flatnonzero(np.diff(at) >= length).tolist():
                    own = data[at[i] : at[i + 1]]
                    start, count, after, anchor = segments(own, length)
                    raw = own.tobytes()
                    content = np.array([digest(raw[a : a + n + length - 1]) for a, n in zip(start.tolist(), count.tolist())], np.uint64)
                    rows.append((anchor, content, np.full(len(start), keys[i]), np.full(len(start), more[i]), _place(start, count, after)))
                if rows:
                    a, c, k, m, p = (np.concatenate(x) for x in zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), pa.array(k), pa.array(m), pa.array(p)], names=names)

    return run


def _cut_text(length: int):
    """(text, picks) batches to (anchor, content, many, anchor's place, text of the segment)."""

    def run(batches):
        names = ["anchor", "content", "many", "after", "piece"]
        for batch in batches:
            for part in cut_by_bytes(batch, 0):
                data, at = raw_bytes(part.column(0))
                anchors, contents, many, after, pieces = [], [], [], [], []
                for i, picks in enumerate(part.column(1).to_pylist()):
                    raw = data[at[i] : at[i + 1]].tobytes()
                    for p in picks:
                        anchors.append(p["anchor"])
                        contents.append(p["content"])
                        many.append(p["many"])
                        start, strings = p["place"] >> 16, p["place"] >> 8 & 255
                        after.append(p["place"] & 255)
                        pieces.append(raw[start : start + strings + length - 1])
                yield pa.RecordBatch.from_arrays([pa.array(anchors, pa.int64()), pa.array(contents, pa.int64()), pa.array(many, pa.bool_()), pa.array(after, pa.int32()), pa.array(pieces, pa.binary())], names=names)

    return run


def _recut(length: int):
    """Rows (anchor, content, after, piece) to the parts of each class: (of, from, at, anchor, content, after, piece), the first three the segment and the part's place in it."""

    def run(batches):
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        names = ["of", "from", "at", "anchor", "content", "after", "piece"]
        for batch in batches:
            rows = []
            for anchor, content, after, piece in zip(*(batch.column(i).to_pylist() for i in range(4))):
                for (c, core), a, b in classes(after, piece, length):
                    part = piece[a : b + length - 1]
                    rows.append((anchor, content, a, digest(core, (anchor + c) & (1 << 64) - 1), digest(part), after - a, part))
            if rows:
                of, source, at, key, value, after, part = zip(*rows)
                signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(source, pa.int64()), pa.array(at, pa.int32()), signed(key), signed(value), pa.array(after, pa.int32()), pa.array(part, pa.binary())], names=names)

    return run


def _runs(hit: np.ndarray) -> list[list[int]]:
    """[first, end) of each run of true values, flat."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return edge.tolist()


def classes(after: int, piece: bytes, length: int = LENGTH) -> list[tuple[tuple[int, bytes], int, int]]:
    """((class, its core), first, end) of the starts of strings of a segment, whose anchor is ``after`` bytes from its first string."""
    span = length - K
    strings = len(piece) - length + 1
    out = []
    for c in range((span - after) // CLASS, (span - after + strings - 1) // CLASS + 1):
        low = c * CLASS - span + after  # of the class, relative to the segment; may lie before it
        high = min(low + CLASS - 1, after)
        out.append(((c, piece[high : low + length]), max(low, 0), min(high + 1, strings)))
    return out


def shared_parts(group: list[tuple[int, bytes]], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each (anchor's place, segment) of one anchor, [first, end) runs of starts in classes whose core another segment has too."""
    seen: dict[tuple[int, bytes], int] = {}
    keys = []
    for after, piece in group:
        own = classes(after, piece, length)
        for key, _, _ in own:
            seen[key] = seen.get(key, 0) + 1
        keys.append(own)
    out = []
    for own in keys:
        runs: list[tuple[int, int]] = []
        for key, a, b in own:
            if seen[key] > 1:
                if runs and runs[-1][1] == a:
                    runs[-1] = (runs[-1][0], b)
                else:
                    runs.append((a, b))
        out.append(runs)
    return out


def _index_groups(length: int, limit: int):
    """Rows (anchor, content, after, piece) sorted by anchor to (anchor, content, runs of repeated strings)."""

    def run(batches):
        held: list[tuple[int, int, int, bytes]] = []

        def close(rows):
            # parts of segments that another may share, by their text
            owners: dict[bytes, list[tuple[int, int]]] = {}
            first = 0
            while first < len(rows):
                last = first
                while last < len(rows) and rows[last][0] == rows[first][0]:
                    last += 1
                for k, runs in enumerate(shared_parts([r[2:] for r in rows[first:last]], length), first):
                    for a, b in runs:
                        owners.setdefault(rows[k][3][a : b + length - 1], []).append((k, a))
                first = last
            parts = list(owners)
            found: dict[int, list[int]] = {}
            for part, hit in zip(parts, repeated_starts(parts, length) if parts else ()):
                if len(owners[part]) > 1:
                    hit = np.ones(len(hit), bool)
                if hit.any():
                    runs = _runs(hit)
                    for k, a in owners[part]:
                        found.setdefault(k, []).extend(x + a for x in runs)
            keys = list(found)
            return pa.RecordBatch.from_arrays([pa.array([rows[k][0] for k in keys], pa.int64()), pa.array([rows[k][1] for k in keys], pa.int64()), pa.array([found[k] for k in keys], pa.list_(pa.int32()))], names=["anchor", "content", "runs"])

        size = 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held and held[-1][:2] == row[:2]:  # a row of the table that is there twice
                    continue
                if size > limit and held[-1][0] != row[0]:
                    yield close(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield close(held)

    return run


def _string_hashes(length: int):
    """(anchor, content, piece) to a row for each string: its hash and place."""

    def run(batches):
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for a, c, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                n = len(piece) - length + 1
                h = np.array([digest(piece[k : k + length]) for k in range(n)], np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, a)), pa.array(np.full(n, c)), pa.array(h.view(np.int64)), pa.array(np.arange(n, dtype=np.int32))], names=["anchor", "content", "h", "k"])

    return run


def _cover(length: int):
    """(__id, text, marks) to the digest of what is left; marks are flat runs of starts of repeated strings."""

    def run(batches):
        names = ["__id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        for batch in batches:
            for part in cut_by_bytes(batch, 1):
                data, at = raw_bytes(part.column(1))
                rows = []
                for i, marks in enumerate(part.column(2).to_pylist()):
                    own = data[at[i] : at[i + 1]]
                    spans = covered(marks or [], length)
                    left = np.ones(len(own), bool)
                    for a, b in spans:
                        left[a:b] = False
                    kept = own[left] if spans else own
                    rows.append((len(own), len(own) - len(kept), len(spans), hashlib.sha256(kept.tobytes()).hexdigest()))
                cols = list(zip(*rows)) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())], names=names)

    return run


def covered(marks: list[list[int]], length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal [start, end) byte runs that strings starting in the [first, end) runs cover."""
    spans: list[list[int]] = []
    for a, b in sorted((a, b - 1 + length) for row in marks for a, b in zip(row[::2], row[1::2])):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    return [(a, b) for a, b in spans]


def _indexed(pieces: DataFrame, length: int, index_bytes: int) -> DataFrame:
    """(anchor, content, runs of repeated strings) of (anchor, content, after, piece), by indexes of whole anchors."""
    dealt = pieces.select("anchor", "content", "after", "piece").repartition("anchor").sortWithinPartitions("anchor", "content")
    return dealt.mapInArrow(_index_groups(length, index_bytes), "anchor long, content long, runs array<int>")


def _counted(pieces: DataFrame, length: int) -> DataFrame:
    """As ``_indexed``, of pieces cut into single strings."""
    strings = pieces.select("anchor", "content", "piece").mapInArrow(_string_hashes(length), "anchor long, content long, h long, k int")
    twice = strings.groupBy("anchor", "h").count().where("count > 1").select("anchor", "h")
    found = strings.join(twice, ["anchor", "h"], "left_semi").select("anchor", "content", F.array(F.col("k"), F.col("k") + 1).alias("runs"))
    return found.groupBy("anchor", "content").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def _of_large(pieces: DataFrame, length: int, group: int, index_bytes: int) -> DataFrame:
    """(anchor, content, runs) of segments of anchors with many contents, dealt again by the cores of their classes."""
    schema = "of long, from long, at int, anchor long, content long, after int, piece binary"
    parts = staged(pieces.dropDuplicates(["anchor", "content"]).select("anchor", "content", "after", "piece").mapInArrow(_recut(length), schema))
    contents = parts.groupBy("anchor", "content").agg(F.count("*").alias("copies"), F.first("after").alias("after"), F.first("piece").alias("piece"))
    anchors = contents.groupBy("anchor").agg(F.count("*").alias("kinds"), F.max("copies").alias("most")).where("kinds > 1 or most > 1")
    live = staged(contents.join(anchors, "anchor"))
    whole = live.where("copies > 1").select("anchor", "content", F.array(F.lit(0), F.octet_length("piece") - (length - 1)).alias("runs"))
    once = live.where("copies = 1").select("anchor", "content")
    found = _indexed(live.where(F.col("kinds").between(2, group)), length, index_bytes).unionByName(_counted(live.where(F.col("kinds") > group), length))
    known = whole.unionByName(found.join(once, ["anchor", "content"]))
    back = parts.select("of", "from", "at", "anchor", "content").join(known, ["anchor", "content"])
    back = back.select(F.col("of").alias("anchor"), F.col("from").alias("content"), F.transform("runs", lambda x: x + F.col("at")).alias("runs"))
    return back.groupBy("anchor", "content").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def repeated_spans(docs: DataFrame, text_col: str, length: int = LENGTH, group: int = GROUP, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(rk, rk2, marks) of the rows of ``docs`` (rk long, rk2 int, text) with repeated strings: marks are runs of their starts."""
    texts = docs.select("rk", "rk2", column(text_col).alias("text"))
    rows = staged(texts.mapInArrow(_segment_rows(length), _SEGMENT))
    contents = rows.groupBy("anchor", "content").agg(F.count("*").alias("copies"), F.min(F.struct("rk", "rk2", "place")).alias("one"))
    anchors = contents.groupBy("anchor").agg(F.count("*").alias("kinds"), F.max("copies").alias("most"), F.min("copies").alias("least")).where("kinds > 1 or most > 1")
    live = staged(contents.join(anchors.select("anchor", "kinds", "least"), "anchor"))
    # contents with copies are repeated throughout; those alone are compared with the anchor's others
    alone = live.where("kinds > 1 and least = 1").select("anchor", "content", "one.rk", "one.rk2", "one.place", (F.col("kinds") > group).alias("many"))
    picks = alone.groupBy("rk", "rk2").agg(F.collect_list(F.struct("anchor", "content", "place", "many")).alias("picks"))
    pieces = staged(texts.join(picks, ["rk", "rk2"]).select("text", "picks").mapInArrow(_cut_text(length), "anchor long, content long, many boolean, after int, piece binary"))
    some = _indexed(pieces.where("not many"), length, index_bytes)
    large = pieces.where("many")
    if not large.isEmpty():
        some = some.unionByName(_of_large(large, length, group, index_bytes))
    whole = live.where("copies > 1").select("anchor", "content", F.lit(None).cast("array<int>").alias("runs"))
    once = live.where("copies = 1").select("anchor", "content").join(some, ["anchor", "content"])
    known = staged(whole.unionByName(once))
    drop_staged(live)
    drop_staged(pieces)
    start, strings = F.shiftright("place", 16).cast("int"), F.shiftright("place", 8).bitwiseAND(F.lit(255).cast("long")).cast("int")
    marked = rows.join(known, ["anchor", "content"]).select(
        "rk", "rk2", F.when(F.col("runs").isNull(), F.array(start, start + strings)).otherwise(F.transform("runs", lambda x: x + start)).alias("runs")
    )
    marks = staged(marked.groupBy("rk", "rk2").agg(F.collect_set("runs").alias("marks")))
    drop_staged(rows)
    drop_staged(known)
    return marks


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, group: int = GROUP, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    src = docs.select(column(id_col).alias("__id"), column(text_col).cast("string").alias("text"))
    src = src.withColumn("rk", F.xxhash64("__id", "text")).withColumn("rk2", F.hash(F.lit(1), "__id", "text"))
    marks = repeated_spans(src, "text", length, group, index_bytes)
    out = T.StructType([T.StructField("__id", src.schema["__id"].dataType), *[T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept_sha256", T.StringType())])
    joined = src.join(marks, ["rk", "rk2"], "left").select("__id", "text", "marks")
    return joined.mapInArrow(_cover(length), out).withColumnRenamed("__id", id_col)
