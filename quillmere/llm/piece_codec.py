"""SentencePiece encoding and decoding for BPE models with byte fallback.

Method: a merge-type prefix table. For each prefix of a word the table holds
the one token that ends the prefix's encoding. Candidates come from an
Aho-Corasick automaton over the vocabulary; a candidate is the right one if the
token before it (the entry of the prefix it leaves) and it form a compatible
pair, that is, if encoding their joined text gives just these two. Ids are then
recovered backwards from the last prefix.

Words are runs of non-space characters with the space mark before them: no
piece of the model has a mark after another character, so nothing merges across
words. Pieces made only of marks share one lowest score and are applied after
all others, leftmost first; their table is simulated per run length. Characters
outside the vocabulary become byte pieces and end a word's run.

Decoding looks at ids alone: each word's ids give its surface, runs of byte pieces become
characters. Only models that normalise nothing and put a mark first are taken; others are refused.

Nulls are encoded as empty texts, which have no ids and decode to the empty
text. Each word's ids, and the text of each word's ids, are kept for a task in tables of bounded size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillmere.llm.batches import append_columns

MARK = "▁"
#: A run of marks with the word after it, a word at a line's start, or a line end.
_CHUNK = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
#: Words whose ids a task keeps, about 350 bytes each with their texts, and of tasks that return texts and ids as well.
MEMO_WORDS, MEMO_SMALL = 600_000, 100_000
_TAILS = frozenset(".,;:!?")
_LOADED: dict[str, "PieceCodec"] = {}


def load(path: str) -> "PieceCodec":
    if path not in _LOADED:
        _LOADED[path] = PieceCodec(path)
    return _LOADED[path]


class _WordTexts(dict):
    """Text of a word's ids (joined by commas), with a space for each mark; decoded at the first look."""

    def __init__(self, codec: "PieceCodec"):
        self.codec = codec

    def __missing__(self, ids: str) -> str:
        text = self[ids] = self.codec._surface([int(i) for i in ids.split(",")])
        return text


class PieceCodec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.most = MEMO_WORDS

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        check_normalizer(sp.serialized_model_proto())
        n = sp.get_piece_size()
        self.bytes_of = [0] * 256
        pieces: dict[str, int] = {}
        score: dict[int, float] = {}
        self.surface: list[str | None] = [None] * n
        self.byte_value: dict[int, int] = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_value[i] = int(piece[3:5], 16)
                self.bytes_of[self.byte_value[i]] = i
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.surface[i] = "" if sp.is_control(i) else None
            else:
                pieces[piece] = i
                score[i] = sp.get_score(i)
                self.surface[i] = piece.replace(MARK, " ")
        if any(MARK in p.lstrip(MARK) or p.startswith(MARK * 2) and p.strip(MARK) for p in pieces) or any("\n" in p for p in pieces):
            raise ValueError("a piece joins a word with what comes before its mark or with a line end")
        self.mark_ids = {len(p): i for p, i in pieces.items() if not p.strip(MARK)}
        words = {p: i for p, i in pieces.items() if p.strip(MARK) or p == MARK}
        self.chars = {p for p in words if len(p) == 1}
        # Merges are applied by falling score. Pieces that their own characters do not lead to are never made.
        order = sorted((i for p, i in words.items() if len(p) > 1), key=lambda i: -score[i])
        text_of = {i: p for p, i in words.items()}
        self.rank = {words[c]: -1 for c in self.chars}
        self.rank.update({i: r for r, i in enumerate(order)})
        self.split: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        auto = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.size = [0] * n
        for p, i in words.items():
            self.size[i] = len(p)
        self.id_text = [str(i) for i in range(n)]
        for c in self.chars:
            auto.add_word(c, words[c])
        for i in order:
            halves = self._halves(text_of[i], words)
            if halves:
                self.split[i] = halves
                self.joined[halves] = i
                auto.add_word(text_of[i], i)
        auto.make_automaton()
        self.auto, self.words, self.mark = auto, words, words[MARK]
        self.fits: dict[int, bool] = {}
        self.runs: dict[int, list[int]] = {0: []}
        self.known = re.compile("[^" + "".join(re.escape(c) for c in sorted(self.chars)) + "]")
        self.ids_memo: dict[str, str] = {}
        self.text_memo = _WordTexts(self)

    def _halves(self, piece: str, words: dict[str, int]) -> tuple[int, int] | None:
        """The two tokens whose merge makes the piece, found by merging its own characters."""
        if any(c not in words for c in piece):
            return None
        parts = list(piece)
        while len(parts) > 2:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = words.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.rank[i] < best):
                    best, at = self.rank[i], k
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (words[parts[0]], words[parts[1]]) if len(parts) == 2 else None

    def compatible(self, left: int, right: int) -> bool:
        """Whether the joined text of two tokens is encoded as just these two.

        Both are taken apart from the seam outwards, the later merge first; the
        pair fails when a merge over the seam would have come before what made
        the parts that are left.
        """
        rank, split, joined = self.rank, self.split, self.joined
        bound = len(rank) + 1
        a, b = left, right
        while True:
            over = joined.get((a, b))
            if over is not None and rank[over] < bound:
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                # a's last merge was applied at ra; until then its right half stood at the seam
                bound, a = ra, split[a][1]
            else:
                # on equal rank the merge further left comes first, so a's own merge is older
                bound, b = rb + 1 if ra < rb or rb < 0 else rb, split[b][0]

    def _mark_run(self, n: int) -> list[int]:
        """Ids of n marks in a row: equal scores, so the leftmost possible merge comes first."""
        if n not in self.runs:
            ids, sizes = [], self.mark_ids
            parts = []
            # the leftmost part grows as long as a piece of the next size is there, then waits for its neighbour
            rest = n
            while rest or parts:
                k = next((k for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in sizes), None)
                if k is not None:
                    parts[k : k + 2] = [parts[k] + parts[k + 1]]
                elif rest:
                    if len(parts) > 2:
                        ids.append(sizes[parts.pop(0)])
                    parts.append(1)
                    rest -= 1
                else:
                    ids += [sizes[p] for p in parts]
                    parts = []
            self.runs[n] = ids
            if len(self.runs) > 4096:
                self.runs = {0: [], n: ids}
        return self.runs[n]

    def _words(self, chunks: list[str]) -> list[list[int]]:
        """Ids of words: known characters only, a mark at most at the start."""
        text = " ".join(chunks)  # a space is no character of the vocabulary: no match crosses it
        last = [-1] * (len(text) + 1)  # last[e]: token that ends the prefix of its word up to e; -2 stands before a word
        at = 0
        for c in chunks:
            last[at] = -2
            at += len(c) + 1
        fits, size = self.fits, self.size
        for end, tok in self.auto.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            prev = last[end - size[tok]]
            if prev != -2:
                key = prev << 20 | tok
                ok = fits.get(key)
                if ok is None:
                    if len(fits) > 1_000_000:
                        fits.clear()
                    ok = fits[key] = self.compatible(prev, tok)
                if not ok:
                    continue
            last[end] = tok
        out, at = [], 0
        for c in chunks:
            e = at + len(c)
            tok = last[e]
            ids = [tok]
            e -= size[tok]
            while e > at:
                tok = last[e]
                ids.append(tok)
                e -= size[tok]
            ids.reverse()
            out.append(ids)
            at += len(c) + 1
        return out

    def _learn(self, chunks: set[str]) -> None:
        """Puts chunks that are not in the memo into it.

        A chunk that ends in one punctuation mark is the chunk before it and the mark
        if the two tokens at the seam are compatible.
        """
        words, plain, hard, tailed = [], [], [], []
        unknown, two, memo = self.known.search, MARK * 2, self.ids_memo
        for chunk in chunks:
            if unknown(chunk) or chunk.startswith(two):
                hard.append(chunk)
            elif chunk[-1] in _TAILS and len(chunk) > 2:
                tailed.append(chunk)
                if chunk[:-1] not in memo and chunk[:-1] not in chunks:
                    plain.append(chunk[:-1])
            else:
                plain.append(chunk)
        plain = list(dict.fromkeys(plain))
        self._keep(plain, self._words(plain))
        whole = []
        for chunk in tailed:
            tail = self.words.get(chunk[-1], -1)
            ids = memo.get(chunk[:-1])
            if tail >= 0 and ids and self._fit(int(ids[ids.rfind(",") + 1 :]), tail):
                memo[chunk] = f"{ids},{tail}"
            else:
                whole.append(chunk)
        self._keep(whole, self._words(whole))
        plans = []
        for chunk in hard:
            body = chunk.lstrip(MARK)
            marks = len(chunk) - len(body)
            lead = marks - 1 if marks and body else marks
            core = chunk[lead:]
            plan: list = []
            start = 0
            for m in self.known.finditer(core):
                if m.start() > start:
                    plan.append(len(words))
                    words.append(core[start : m.start()])
                plan.append([self.bytes_of[x] for x in m[0].encode()])
                start = m.end()
            if start < len(core):
                plan.append(len(words))
                words.append(core[start:])
            plans.append((lead, plan))
        coded = self._words(words)
        for chunk, (lead, plan) in zip(hard, plans):
            ids = []
            for p in plan:
                ids += coded[p] if isinstance(p, int) else p
            if lead:
                if ids and ids[0] == self.mark:  # its mark stayed alone and so belongs to the run
                    ids = self._mark_run(lead + 1) + ids[1:]
                else:
                    ids = self._mark_run(lead) + ids
            memo[chunk] = ",".join([self.id_text[i] for i in ids])

    def _keep(self, chunks: list[str], coded: list[list[int]]) -> None:
        text_of, memo = self.id_text, self.ids_memo
        for chunk, ids in zip(chunks, coded):
            memo[chunk] = ",".join([text_of[i] for i in ids])

    def _fit(self, left: int, right: int) -> bool:
        key = left << 20 | right
        ok = self.fits.get(key)
        if ok is None:
            ok = self.fits[key] = self.compatible(left, right)
        return ok

    def _surface(self, ids: Sequence[int]) -> str:
        """Text of ids with a space for each mark; bytes that are no UTF-8 become U+FFFD each."""
        out, raw = [], bytearray()
        for i in ids:
            value = self.byte_value.get(i)
            if value is not None:
                raw.append(value)
                continue
            if raw:
                out.append(_decode_bytes(raw))
                raw = bytearray()
            out.append(self.surface[i] if self.surface[i] is not None else " ⁇ ")
        if raw:
            out.append(_decode_bytes(raw))
        return "".join(out)

    def _chunks(self, texts: Sequence[str]) -> list[list[str]]:
        cut = [_CHUNK.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.ids_memo) > self.most:
            self.forget()
        new = set().union(*cut).difference(self.ids_memo)
        if new:
            self._learn(new)
        return cut

    def forget(self) -> None:
        self.ids_memo.clear()
        self.text_memo.clear()

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        """Ids of each text, as the library's encode gives them."""
        out = []
        for cs in self._chunks(texts):
            ids = ",".join([self.ids_memo[c] for c in cs])
            out.append([int(i) for i in ids.split(",")] if ids else [])
        return out

    def decode(self, ids: Sequence[int]) -> str:
        """Text of ids, as the library's decode gives it: the first piece's mark goes, a byte piece's space stays."""
        text = self._surface(ids)
        first = next((i for i in ids if self.surface[i] != ""), None)
        return text[1:] if text.startswith(" ") and first not in self.byte_value else text

    def digests(self, texts: Sequence[str]) -> tuple[list[int], list[str], list[str]]:
        """n ids, SHA-256 of the ids and of the text decoded from them, of each text."""
        counts, of_ids, of_text = [], [], []
        ids_of, text_of = self.ids_memo.__getitem__, self.text_memo.__getitem__
        for cs in self._chunks(texts):
            words = list(map(ids_of, cs))
            ids = ",".join(words)
            # a word never ends inside a character of byte pieces, so its ids are decoded on their own
            text = "".join(map(text_of, words))
            # the first piece's mark goes; a text never starts with a byte piece, as its first word has a mark
            text = text[1:] if text.startswith(" ") else text
            counts.append(ids.count(",") + 1 if ids else 0)
            of_ids.append(hashlib.sha256(ids.encode()).hexdigest())
            of_text.append(hashlib.sha256(text.encode()).hexdigest())
        return counts, of_ids, of_text


def _fields(raw: bytes):
    """(number, value) of a protocol buffer's fields: whole numbers, or bytes of what has a length."""

    def number(k):
        value = shift = 0
        while True:
            value |= (raw[k] & 127) << shift
            k, shift = k + 1, shift + 7
            if raw[k - 1] < 128:
                return value, k

    k = 0
    while k < len(raw):
        key, k = number(k)
        if key & 7 == 0:
            value, k = number(k)
        elif key & 7 == 2:
            size, k = number(k)
            value, k = raw[k : k + size], k + size
        else:
            size = 8 if key & 7 == 1 else 4
            value, k = raw[k : k + size], k + size
        yield key >> 3, value


def check_normalizer(model: bytes) -> None:
    """Raises ValueError unless the model is BPE, leaves texts as they are and puts a mark first."""
    top = {n: v for n, v in _fields(model) if n in (2, 3)}
    trainer, norm = dict(_fields(top.get(2, b""))), dict(_fields(top.get(3, b"")))
    # numbers of the model's format: type 3 (2 is BPE); character map 2, mark first 3, fewer spaces 4, marks for spaces 5
    if trainer.get(3, 1) != 2 or norm.get(2) or not norm.get(3, 1) or norm.get(4, 1) or not norm.get(5, 1):
        raise ValueError("the model is no BPE model, normalises texts, or doesn't put a mark first")


def _decode_bytes(raw: bytearray) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, k = [], 0
        while k < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[k : k + n].decode())
                    k += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                k += 1
        return "".join(out)


def encode_pieces(docs: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Kept columns with ``piece_ids`` array<int> and ``decoded`` text of every whole text.

    Repeated rows each get their result, an empty table gives an empty one, and a
    kept column named like an output gives way to it.
    """

    def make():
        codec = load(path)
        codec.most = MEMO_SMALL

        def run(array: pa.Array):
            ids = codec.encode([t or "" for t in array.to_pylist()])
            return pa.array(ids, pa.list_(pa.int32())), pa.array([codec.decode(x) for x in ids], pa.string())

        run.close = codec.forget
        return run

    fields = [T.StructField("piece_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    return append_columns(docs, text_col, make, fields, keep, limit=1 << 18)


def piece_digests(docs: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """As ``encode_pieces``, with n_tokens, ids_sha256 and decoded_sha256 in place of ids and text."""

    def make():
        codec = load(path)
        codec.most = MEMO_WORDS

        def run(array: pa.Array):
            n, a, b = codec.digests([t or "" for t in array.to_pylist()])
            return pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())

        run.close = codec.forget
        return run

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return append_columns(docs, text_col, make, fields, keep)
