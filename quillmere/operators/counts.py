"""Words of texts counted in Arrow batches.

The words are those of ``functions.text.analyze`` and ``hash_tokens``. Spark's functions on arrays take microseconds for each word of a text; here the
bytes of a batch are looked at together, words are Arrow's and numbers, and what leaves a task are counts.
"""

from __future__ import annotations

import functools
import hashlib
import string
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quillmere.functions.text import HASH_STOP_CHARS, STOPWORDS


def _table(chars: str) -> bytes:
    """What bytes.translate takes to leave these ASCII characters, A-Z small, and make every other byte a blank."""
    return bytes(b + 32 if 65 <= b <= 90 and chr(b) in chars else b if b < 128 and chr(b) in chars else 32 for b in range(256))


_INSIDE, _LAST = ".:/+-", ".:"  # of technical tokens, but not at their start; the latter not at their end either
_TECHNICAL = _table(string.ascii_letters + string.digits + "_" + _INSIDE)
_LATIN = _table(string.ascii_letters + string.digits)
_NO_TERMS = pa.array(["", *STOPWORDS, *string.digits], pa.large_string())
_NO_HASH = sorted(map(ord, HASH_STOP_CHARS))
#: Words whose buckets a worker remembers; then it starts anew.
MEMO = 1 << 18
#: Texts whose buckets are one dense block.
TEXTS = 1024


def _bytes(texts: pa.Array):
    """The UTF-8 bytes of all texts of a batch, nulls as empty ones, and where each text starts and the last one ends."""
    import numpy as np

    texts = texts.fill_null("") if texts.null_count else texts
    kind = np.dtype(np.int64 if pa.types.is_large_string(texts.type) else np.int32)
    _, ends, data = texts.buffers()
    at = np.frombuffer(ends, kind, len(texts) + 1, texts.offset * kind.itemsize).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    return bytes(memoryview(data)[at[0] : at[-1]]) if at[-1] > at[0] else b"", at - at[0]


def _latin(data: bytes, at, table: bytes):
    """(line, number, words): text and word of each run of characters that ``table`` leaves, and the different words. Runs end where texts do."""
    import numpy as np

    low = data.translate(table)
    solid = np.frombuffer(low, np.uint8) != 32
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = at[(at > 0) & (at < len(low))]
    first[inner], last[inner - 1] = solid[inner], solid[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    ends = np.concatenate(([0], np.cumsum(end - start))).astype(np.int64)
    runs = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(low.translate(None, b" "))]).dictionary_encode()
    line = np.repeat(np.arange(len(at) - 1), np.diff(np.searchsorted(start, at)))
    return line, runs.indices.to_numpy().astype(np.int64), runs.dictionary


def _cjk(data: bytes, at):
    """(place, line, code) of each character from U+4E00 to U+9FFF, the three bytes from E4 B8 80 to E9 BF BF."""
    import numpy as np

    raw = np.frombuffer(data + b"\0\0", np.uint8)
    p = np.flatnonzero((raw >= 0xE4) & (raw <= 0xE9))
    code = (raw[p].astype(np.int64) & 15) << 12 | (raw[p + 1].astype(np.int64) & 63) << 6 | raw[p + 2].astype(np.int64) & 63
    p, code = (x[(code >= 0x4E00) & (code <= 0x9FFF)] for x in (p, code))
    return p, np.searchsorted(at, p, "right") - 1, code


def _with_grams(line, number, words: pa.Array, more, codes):
    """Words, and the bigrams (two codes of 16 bits; the second 0: one character) of the texts ``more``."""
    import numpy as np

    found, which = np.unique(codes, return_inverse=True)
    pair = np.stack((found >> 16, found & 0xFFFF), axis=1)
    utf8 = np.stack((pair >> 12 | 0xE0, pair >> 6 & 63 | 0x80, pair & 63 | 0x80), axis=2).astype(np.uint8)[pair > 0]
    ends = np.concatenate(([0], np.cumsum(np.where(pair[:, 1] > 0, 6, 3)))).astype(np.int64)
    grams = pa.Array.from_buffers(pa.large_string(), len(found), [None, pa.py_buffer(ends), pa.py_buffer(utf8.tobytes())])
    return np.concatenate((line, more)), np.concatenate((number, which + len(words))), pa.concat_arrays([words, grams])


def term_tokens(texts: pa.Array):
    """(line, number, terms): text and term of each index term of a batch, as ``analyze`` gives them, and the different terms."""
    import numpy as np

    data, at = _bytes(texts)
    if not data.isascii():
        old = texts.to_pylist()
        # of the characters that the compatibility form leaves, this one alone has an ASCII letter as its small form
        new = [t if not t or t.isascii() else unicodedata.normalize("NFKC", t).replace("\u0130", "i\u0307") for t in old]
        if any(a is not b for a, b in zip(old, new, strict=True)):
            data, at = _bytes(pa.array(new, pa.large_string()))
    line, number, words = _latin(data, at, _TECHNICAL)
    words = pc.ascii_rtrim(pc.ascii_ltrim(words, characters=_INSIDE), characters=_LAST)
    if not data.isascii():
        p, lines, code = _cjk(data, at)
        pair = np.flatnonzero((np.diff(p) == 3) & (np.diff(lines) == 0))
        line, number, words = _with_grams(line, number, words, lines[pair], code[pair] << 16 | code[pair + 1])
    terms = words.dictionary_encode()  # some are the same without their edges
    number = np.where(pc.is_in(words, value_set=_NO_TERMS).to_numpy(zero_copy_only=False), -1, terms.indices.to_numpy())[number]
    return line[number >= 0], number[number >= 0], terms.dictionary


def hash_words(texts: pa.Array):
    """(line, number, words): the same for the hashing embedding, as ``hash_tokens`` gives its tokens."""
    import numpy as np

    data, at = _bytes(texts)
    line, number, words = _latin(data, at, _LATIN)
    if not data.isascii():
        _, lines, code = _cjk(data, at)
        kept = ~np.isin(code, _NO_HASH)
        lines, code = lines[kept], code[kept]
        pair = np.flatnonzero(np.diff(lines) == 0)
        lone = np.flatnonzero(np.bincount(lines, minlength=len(texts))[lines] == 1)
        line, number, words = _with_grams(line, number, words, np.concatenate((lines[pair], lines[lone])), np.concatenate((code[pair] << 16 | code[pair + 1], code[lone] << 16)))
    return line, number, words


def _tallied(line, number, size: int):
    """(line, number, n): each pair once and in order, with how often it is there."""
    import numpy as np

    key = np.sort(line * max(1, size) + number)
    head = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
    return *np.divmod(key[head], max(1, size)), np.diff(np.append(head, len(key)))


def _counter(found, text: str | None) -> Counter:
    _, number, words = found(pa.array([text], pa.string()))
    return Counter(w.encode() for w in words.take(pa.array(number)).to_pylist())


def term_counter(text: str | None) -> Counter:
    """Index terms of a text in UTF-8, as ``analyze`` gives them, with their numbers."""
    return _counter(term_tokens, text)


def hash_counter(text: str | None) -> Counter:
    """Tokens of the hashing embedding in UTF-8, as ``hash_tokens`` gives them, with their numbers."""
    return _counter(hash_words, text)


class _Buckets(dict):
    """Buckets of words: the first four bytes of the MD5, modulo the dimension."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = n = int.from_bytes(hashlib.md5(word, usedforsecurity=False).digest()[:4], "big") % self.dim
        return n


@functools.lru_cache(maxsize=2)
def _buckets(dim: int) -> _Buckets:
    return _Buckets(dim)


def bucket_block(texts: pa.Array, dim: int):
    """A row of ``dim`` numbers for each text: in each bucket of its tokens the sum of 1 + ln(tf) over these."""
    import numpy as np

    line, number, words = hash_words(texts)
    line, number, n = _tallied(line, number, len(words))
    # no word has a blank
    listed = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string()).cast(pa.binary())), b" ")[0].as_py().split()
    bucket = np.fromiter(map(_buckets(dim).__getitem__, listed), np.int64, len(words))
    return np.bincount(line * dim + bucket[number], 1.0 + np.log(n), len(texts) * dim).astype(float, copy=False).reshape(len(texts), dim)


def _rows(docs: DataFrame, id_col: str, text_col: str, fields: list[T.StructField], made: Callable[[pa.Array], tuple[list | None, list[pa.Array]]], step: int | None = None) -> DataFrame:
    """(doc, *fields): ``made`` gives, for the texts of a batch (or of ``step`` rows of it), the rows that stay (None: all) and their columns."""
    src = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    names = ["doc", *[f.name for f in fields]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step or max(1, b.num_rows))):
            kept, columns = made(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0) if kept is None else b.column(0).take(pa.array(kept, pa.int64())), *columns], names=names)

    return src.mapInArrow(run, T.StructType([src.schema["doc"], *fields]))


def _ends(line, lines: int):
    """Where the lists of ``lines`` texts start and the last one ends, for their values in order."""
    import numpy as np

    return pa.array(np.searchsorted(line, np.arange(lines + 1)), pa.int32())


_COUNTS = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())]))


def term_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, dl, counts): all documents with their number of terms, and (term, tf) of each term."""
    import numpy as np

    kind = to_arrow_type(_COUNTS)

    def made(texts):
        line, number, words = term_tokens(texts)
        dl = np.bincount(line, minlength=len(texts))
        line, number, n = _tallied(line, number, len(words))
        terms = words.cast(pa.string()).take(pa.array(number))
        pairs = pa.StructArray.from_arrays([terms, pa.array(n, pa.int64())], fields=list(kind.value_type))
        return None, [pa.array(dl, pa.int64()), pa.ListArray.from_arrays(_ends(line, len(texts)), pairs, type=kind)]

    return _rows(docs, id_col, text_col, [T.StructField("dl", T.LongType()), T.StructField("counts", _COUNTS)], made)


def known_counts(docs: DataFrame, id_col: str, text_col: str, known: Broadcast) -> DataFrame:
    """(doc, dl, terms, tfs): all documents with their number of terms; of those in the array ``known`` the places there and how often each is found."""
    import numpy as np

    ints = T.ArrayType(T.IntegerType())
    kind = to_arrow_type(ints)

    def made(texts):
        line, number, words = term_tokens(texts)
        dl = np.bincount(line, minlength=len(texts))
        to = pc.fill_null(pc.index_in(words, value_set=known.value), -1).to_numpy().astype(np.int64)[number]
        line, term, n = _tallied(line[to >= 0], to[to >= 0], len(known.value))
        at = _ends(line, len(texts))
        return None, [pa.array(dl, pa.int64()), *[pa.ListArray.from_arrays(at, pa.array(x, pa.int32()), type=kind) for x in (term, n)]]

    return _rows(docs, id_col, text_col, [T.StructField("dl", T.LongType()), T.StructField("terms", ints), T.StructField("tfs", ints)], made)


def bucket_values(docs: DataFrame, id_col: str, text_col: str, dim: int) -> DataFrame:
    """(doc, buckets, values): for each bucket of a text's tokens, once and in order, the sum of 1 + ln(tf) over its tokens. Texts without a token have no row."""
    import numpy as np

    longs, doubles = T.ArrayType(T.LongType()), T.ArrayType(T.DoubleType())
    kinds = [to_arrow_type(longs), to_arrow_type(doubles)]

    def made(texts):
        block = bucket_block(texts, dim)
        line, bucket = np.nonzero(block)
        kept, size = np.unique(line, return_counts=True)
        at = pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32())
        return kept, [pa.ListArray.from_arrays(at, pa.array(x), type=kind) for x, kind in zip((bucket.astype(np.int64), block[line, bucket]), kinds, strict=True)]

    return _rows(docs, id_col, text_col, [T.StructField("buckets", longs), T.StructField("values", doubles)], made, TEXTS)
