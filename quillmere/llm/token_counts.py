"""Token counts: batch encoding inside Arrow functions, lengths only.

Texts are handed to the tokenizers library in batches of about equal bytes; no
ids leave the worker. A text over ``SPLIT_CHARS`` is cut at safe boundaries and
its parts' lengths are added. A cut before white space that follows an ASCII
letter is safe for byte-level BPE with the usual pre-tokenizer: no pre-token
crosses it, no look-ahead on its left reaches it, and a special string holds no
white space.

Nulls and empty texts have 0 tokens. Repeated rows are counted each. An empty
table gives an empty result. A file whose pre-tokenizer is not the byte-level
one is never split. ``keep`` columns named like an output give way to it.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillmere.llm.batches import append_columns

SPLIT_CHARS = 1 << 16
_SAFE = re.compile(r"(?<=[A-Za-z])(?=[ \n])")
_LOADED: dict[str, tuple] = {}


def safe_parts(text: str, size: int = SPLIT_CHARS) -> list[str]:
    """Pieces of a text cut at the first safe boundary after each ``size`` characters."""
    parts, start = [], 0
    while len(text) - start > size:
        m = _SAFE.search(text, start + size)
        if m is None:
            break
        parts.append(text[start : m.start()])
        start = m.start()
    parts.append(text[start:])
    return parts


def load(path: str):
    """(function from a list of texts to their lengths, whether texts can be cut); kept per process."""
    if path not in _LOADED:
        if path.endswith(".json"):
            import json
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            pre = json.loads(tok.to_str()).get("pre_tokenizer") or {}
            cut = pre.get("type") == "ByteLevel" and bool(pre.get("use_regex", True)) and not pre.get("add_prefix_space", True) and not json.loads(tok.to_str()).get("normalizer")
            _LOADED[path] = (lambda texts: [len(e) for e in tok.encode_batch_fast(texts, add_special_tokens=False)], cut)
        else:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            _LOADED[path] = (lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)], False)
    return _LOADED[path]


def lengths(texts: list[str], path: str) -> list[int]:
    """Tokens of each text."""
    encode, cut = load(path)
    owner, parts = [], []
    for i, t in enumerate(texts):
        for p in safe_parts(t) if cut and len(t) > SPLIT_CHARS else (t,):
            owner.append(i)
            parts.append(p)
    out = [0] * len(texts)
    for i, n in zip(owner, encode(parts) if parts else []):
        out[i] += n
    return out


def token_counts(docs: DataFrame, path: str, text_col: str = "text", limit: int = 512, keep: list[str] | None = None) -> DataFrame:
    """Kept columns with n_bytes, n_tokens and over_limit (n_tokens > limit) of every whole text."""

    def make():
        def run(array: pa.Array):
            # equal texts of a batch are encoded once
            coded = pc.dictionary_encode(pc.fill_null(array, ""))
            per = pa.array(lengths(coded.dictionary.to_pylist(), path), pa.int64())
            n = pc.take(per, coded.indices)
            size = pc.cast(pc.fill_null(pc.binary_length(array), 0), pa.int64())
            return size, n, pc.greater(n, limit)

        return run

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return append_columns(docs, text_col, make, fields, keep, limit=1 << 20)
