"""Secret scans: three base patterns, and a linear-chain conditional random field that adds to them.

Tokens are runs of non-space bytes. The field tags each as secret begin (B),
inside (I) or outside (O) from its shape, its neighbours and features of the file, and
Viterbi decodes a document's tags. Weights are learned here, by gradient of the
conditional likelihood on generated, labelled lines (``training_lines``); the corpus
is not used.

Decoding is exact without a pass over every token: a token whose score for O
leads by more than any change of transitions can make up is O on the best path,
so only the islands between such tokens are decoded.

Base matches are found per kind, leftmost first, without overlap, and those that fail their length
are dropped. Spans of the field stand beside them, also where they reach over a base span's
end; only those that base spans cover whole are left out, as they add nothing. Redaction takes the
union of all spans. Offsets count code points, ends are exclusive. Null is an empty text and has no span.
Repeated rows get equal results, an empty table an empty one; a kept column
named like an output gives way to it.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillmere.llm.batches import append_columns, raw_bytes

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "crf")
#: Lower-case strings of which one is in every assign match.
_KEYS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
CUE = re.compile(rb"pass(?:word|wd|phrase|code)?|pwd|secret|token|key|api[_-]?key|bearer|credential|auth(?:orization)?|private")
_ASSIGNED = re.compile(rb"(?:" + CUE.pattern + rb")[\"']?[=:]+")
O, B, I = 0, 1, 2

# ---- tokens and features -------------------------------------------------

_CLASS = np.full(256, 4, np.uint8)  # 0 space, 1 lower or non-ASCII, 2 upper, 3 digit, 4 other
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[128:] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_HEX = np.zeros(256, bool)
_HEX[[*b"0123456789abcdef"]] = True
_EDGE = np.zeros(256, bool)  # what may surround a token's core
_EDGE[[*b"\"'`.,;:!?()[]{}<>|*%$&#~"]] = True
_QUOTES = b"\"'`"
_OPENING, _CLOSING = _QUOTES + b"([{<", _QUOTES + b")]}>"
_CODE = np.zeros(256, bool)
_CODE[[*b"=;{}<>_"]] = True

#: Sizes of the feature families, in the order of ``features``.
SIZES = (6, 5, 8, 6, 5, 3, 3, 2, 3, 3)
OFFSETS = np.cumsum((0, *SIZES))[:-1]


class Tokens:
    """Token starts, ends and counts of one block of bytes, with the document of each."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        kind = _CLASS[data]
        word = kind > 0
        # a document's end ends a token
        new = word.copy()
        new[1:] &= ~word[:-1]
        inner = at[1:-1][at[1:-1] < len(data)]
        new[inner] = word[inner]
        last = word.copy()
        last[:-1] &= ~word[1:]
        cut = inner[inner > 0] - 1
        last[cut] = word[cut]
        self.data, self.at, self.kind = data, at, kind
        self.start = np.flatnonzero(new)
        self.end = np.flatnonzero(last) + 1
        self.doc = np.searchsorted(at, self.start, "right") - 1
        odd = np.concatenate(([0], np.cumsum(kind >= 3, dtype=np.int32)))
        self.odd = odd[self.end] - odd[self.start]

    def core(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends without quotes and punctuation about them."""
        a, b = self.start[which].copy(), self.end[which].copy()
        for _ in range(4):
            a += (a < b) & _EDGE[self.data[np.minimum(a, len(self.data) - 1)]]
            b -= (a < b) & _EDGE[self.data[np.maximum(b - 1, 0)]]
        return a, b


def _bucket(x: np.ndarray, cuts: tuple) -> np.ndarray:
    return np.searchsorted(np.asarray(cuts), x, "right")


def cue_tokens(tokens: Tokens, lower: bytes) -> np.ndarray:
    """1 where a token ends in a cue word (apart from punctuation), 2 where one assigns to a cue inside."""
    out = np.zeros(len(tokens.start), np.uint8)
    hits = [m.span() for m in CUE.finditer(lower)] if any(k in lower for k in (b"pass", b"pwd", b"secret", b"token", b"key", b"bearer", b"credential", b"auth", b"private")) else []
    if not hits:
        return out
    a, b = np.array(hits).T
    t = np.searchsorted(tokens.start, a, "right") - 1
    ok = (t >= 0) & (b <= tokens.end[t])
    t, a, b = t[ok], a[ok], b[ok]
    data = tokens.data
    nxt = np.where(b < tokens.end[t], data[np.minimum(b, len(data) - 1)], 32)
    sep = (nxt == ord("=")) | (nxt == ord(":")) | (nxt == ord('"')) | (nxt == ord("'"))
    rest = tokens.end[t] - b
    whole = (rest <= 2) & ((rest == 0) | sep)
    before = (a == tokens.start[t]) | ~np.isin(tokens.kind[np.maximum(a - 1, 0)], (1, 2))
    out[t[before & whole]] = 1
    out[t[before & ~whole & sep]] = 2
    return out


def features(tokens: Tokens, which: np.ndarray, cue: np.ndarray) -> np.ndarray:
    """(tokens, families) indices of the active feature of each family."""
    data, kind = tokens.data, tokens.kind
    a, b = tokens.core(which)
    # after an assignment inside the token only the value's shape counts
    if (cue[which] == 2).any():
        for k in np.flatnonzero(cue[which] == 2).tolist():
            raw = data[a[k] : b[k]].tobytes()
            m = re.match(rb"[^=:]*[=:][\"']*", raw)
            if m and m.end() < len(raw):
                a[k] += m.end()
    size = np.maximum(b - a, 0)
    lo = np.minimum(a, b)
    total = [np.concatenate(([0], np.cumsum(kind == c, dtype=np.int32))) for c in (1, 2, 3, 4)]
    lower, upper, digit, other = (t[b] - t[lo] for t in total)
    hexes = np.concatenate(([0], np.cumsum(_HEX[data], dtype=np.int32)))
    hexes = hexes[b] - hexes[lo]
    turn = np.zeros(len(data), np.int32)
    turn[1:] = kind[1:] != kind[:-1]
    turns = np.concatenate(([0], np.cumsum(turn, dtype=np.int32)))
    turns = np.where(size > 0, turns[b] - turns[np.minimum(lo + 1, b)], 0)
    shape = np.select(
        [size == 0, (digit == 0) & (other == 0), (digit == size), (hexes == size) & (digit > 0), (lower == 0) & (upper > 0) & (digit > 0) & (other == 0), (other == 0) & (digit > 0), (digit > 0) & (other <= 0.2 * size)],
        [0, 1, 2, 3, 4, 5, 6], 7,
    )
    n = len(tokens.start)
    same = lambda j: (j >= 0) & (j < n) & (tokens.doc[np.clip(j, 0, n - 1)] == tokens.doc[which])
    p1, p2, nx = which - 1, which - 2, which + 1
    prev = np.where(same(p1), np.where(cue[np.clip(p1, 0, n - 1)] == 1, 1, 0), 0)
    c1 = np.clip(p1, 0, n - 1)
    sep = same(p1) & (tokens.end[c1] - tokens.start[c1] == 1) & np.isin(data[tokens.start[c1]], (ord("="), ord(":")))
    prev = np.where(sep & same(p2) & (cue[np.clip(p2, 0, n - 1)] == 1), 2, prev)
    prev = np.where((prev == 0) & same(p1) & (tokens.odd[c1] >= 6), 3, prev)
    prev = np.where((prev == 0) & same(p2) & (cue[np.clip(p2, 0, n - 1)] == 1), 4, prev)
    after = np.where(same(nx), np.where(tokens.odd[np.clip(nx, 0, n - 1)] >= 6, 2, 1), 0)
    docs = tokens.at[1:] - tokens.at[:-1]
    code = np.concatenate(([0], np.cumsum(_CODE[data], dtype=np.int32)))
    code = (code[tokens.at[1:]] - code[tokens.at[:-1]]) / np.maximum(docs, 1)
    busy = np.bincount(tokens.doc, tokens.odd > 2, len(docs)) / np.maximum(np.bincount(tokens.doc, minlength=len(docs)), 1)
    doc = tokens.doc[which]
    distinct = _bucket(turns / np.maximum(size, 1), (0.15, 0.35))
    return np.stack(
        [
            _bucket(size, (6, 10, 16, 24, 40)),
            _bucket(digit / np.maximum(size, 1), (0.001, 0.15, 0.35, 0.75)),
            shape,
            _bucket(turns, (1, 2, 4, 7, 12)),
            prev,
            after,
            cue[which],
            (upper > 0) & (lower > 0) & (digit > 0),
            distinct,
            _bucket(np.maximum(code, busy / 10)[doc], (0.01, 0.05)),
        ],
        1,
    ) + OFFSETS


# ---- learning -------------------------------------------------------------


def _word(rng: random.Random) -> str:
    parts = ["th", "er", "an", "in", "on", "re", "at", "en", "ed", "ou", "tion", "ing", "es", "la", "de", "que", "sch", "ver", "ción", "ère", "ü"]
    w = "".join(rng.choices(parts, k=rng.choice((1, 1, 2, 2, 3, 4, 6))))
    return w.capitalize() if rng.random() < 0.12 else w


def _secret(rng: random.Random) -> str:
    both, low = string.ascii_letters + string.digits, string.ascii_lowercase + string.digits
    kind = rng.randrange(7)
    if kind == 0:
        return "".join(rng.choices("0123456789abcdef", k=rng.choice((16, 18, 32, 40, 64))))
    if kind == 1:
        return "AKIA" + "".join(rng.choices(string.ascii_uppercase + string.digits, k=16))
    if kind == 2:
        return rng.choice(("ghp_", "gho_", "sk_live_", "xoxb-", "sk-", "glpat-")) + "".join(rng.choices(both, k=rng.choice((24, 36))))
    if kind == 3:
        return "".join(rng.choices(both + "+/", k=rng.choice((24, 32, 40)))) + rng.choice(("", "=", "=="))
    if kind == 4:
        return ".".join("".join(rng.choices(both + "_-", k=n)) for n in (20, 36, 28))
    if kind == 5:
        return "".join(rng.choices(low, k=rng.randint(14, 30)))
    return "".join(rng.choices(both + "!@#$%^&*", k=rng.randint(12, 20)))


def _harmless(rng: random.Random) -> str:
    d = lambda n: "".join(rng.choices(string.digits, k=n))
    kind = rng.randrange(13)
    if kind == 0:
        return f"{rng.randint(1900, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}"
    if kind == 1:
        return rng.choice(("+1-", "", "(555)")) + f"{d(3)}-{d(3)}-{d(4)}"
    if kind == 2:
        return f"{_word(rng)}.{_word(rng)}{d(rng.randint(0, 3))}@{_word(rng)}.example.com"
    if kind == 3:
        return f"https://{_word(rng)}.example.org/{_word(rng)}/{d(5)}?page={d(1)}"
    if kind == 4:
        return f"{d(3)}.{d(2)}.{d(1)}.{d(3)}"
    if kind == 5:
        return f"{d(3)}-{d(2)}-{d(4)}"
    if kind == 6:
        return d(rng.randint(1, 12))
    if kind == 7:
        return f"v{d(1)}.{d(2)}.{d(1)}"
    if kind == 8:
        return _word(rng) + rng.choice(("***", "&&&", "%%%", "$$$", "###", "!!", "|"))
    if kind == 9:
        return "".join(_word(rng) for _ in range(4))
    if kind == 10:
        return _word(rng).upper() + rng.choice(("", "!!", "_" + _word(rng).upper()))
    if kind == 11:
        return f"{_word(rng)}_{_word(rng)}({_word(rng)}[{d(1)}]);"
    return rng.choice(("|", "=", ":", "-", "2.0.", "3.", "CC", "BY-NC", "4.0."))


def training_lines(n: int = 800, seed: int = 7) -> tuple[list[str], list[list[int]]]:
    """Generated lines and the tag of each of their tokens."""
    rng = random.Random(seed)
    lines, tags = [], []
    for _ in range(n):
        toks: list[tuple[str, int]] = []
        for _ in range(rng.randint(1, 4)):
            toks += [(_word(rng) + rng.choice(("", "", "", ",", ".")), O) for _ in range(rng.randint(0, 4))]
            draw = rng.random()
            if draw < 0.4:
                toks.append((_harmless(rng), O))
                continue
            if draw > 0.85:
                if draw > 0.93:  # a cue without a secret
                    toks += [(rng.choice(("password", "token", "secret", "key")), O), (_word(rng), O)]
                continue
            s = _secret(rng)
            q = rng.choice(("", '"', "'"))
            cue = rng.choice(("password", "passwd", "token", "secret", "api_key", "apikey", "key", "pwd", "access_token", "AUTH_TOKEN"))
            form = rng.randrange(6)
            if form == 0:
                toks.append((f"{cue}{rng.choice('=:')}{q}{s}{q}", B))
            elif form == 1:
                toks += [(cue, O), (rng.choice("=:"), O), (f"{q}{s}{q}", B)]
            elif form == 2:
                toks += [(cue + ":", O), (f"{q}{s}{q}{rng.choice(('', ',', ';'))}", B)]
            elif form == 3:
                toks.append((s + rng.choice(("", "", ".", ",")), B))
            elif form == 4:
                toks += [("Authorization:", O), ("Bearer", O), (s, B)]
            else:
                toks += [(cue + ":", O), (s[: len(s) // 2 + 4], B), (_secret(rng), I)]
        if not toks:
            toks = [(_word(rng), O)]
        lines.append(" ".join(t for t, _ in toks))
        tags.append([k for _, k in toks])
    return lines, tags


class Field:
    """Weights: emission (features, 3) and transition (3, 3); the tag before a document is O."""

    def __init__(self, emit: np.ndarray, step: np.ndarray):
        self.emit, self.step = emit, step
        #: Most that leaving O at one token can gain from the transitions about it.
        self.gain = max(step[p, s] + step[s, q] - step[p, O] - step[O, q] for p in range(3) for s in (B, I) for q in range(3))
        self.gain = max(0.0, float(self.gain), max(float(step[p, s] - step[p, O]) for p in range(3) for s in (B, I)))

    def scores(self, f: np.ndarray) -> np.ndarray:
        out = self.emit[f[:, 0]]
        for j in range(1, f.shape[1]):
            out += self.emit[f[:, j]]
        return out

    def viterbi(self, e: np.ndarray) -> list[int]:
        """Best tags of a run of tokens between tokens tagged O."""
        best = self.step[O] + e[0]
        back = []
        for x in e[1:]:
            m = best[:, None] + self.step
            back.append(m.argmax(0))
            best = m.max(0) + x
        k = int((best + self.step[:, O]).argmax())
        out = [k]
        for row in reversed(back):
            k = int(row[k])
            out.append(k)
        return out[::-1]


@lru_cache(maxsize=1)
def trained_field(rounds: int = 200, rate: float = 0.3, l2: float = 1e-4) -> Field:
    """Weights that maximise the conditional likelihood of the generated lines."""
    lines, tags = training_lines()
    raw = [x.encode() for x in lines]
    at = np.concatenate(([0], np.cumsum([len(x) + 1 for x in raw])))
    blob = b"\n".join(raw) + b"\n"
    data = np.frombuffer(blob, np.uint8)
    toks = Tokens(data, at)
    f = features(toks, np.arange(len(toks.start)), cue_tokens(toks, blob.lower()))
    y = np.concatenate([np.array(t) for t in tags])
    n, width = len(lines), max(map(len, tags))
    sizes = np.array([len(t) for t in tags])
    col = np.arange(len(y)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row = np.repeat(np.arange(n), sizes)
    there = np.arange(width) < sizes[:, None]
    gold = np.zeros((n, width), int)
    gold[row, col] = y
    k = int(sum(SIZES))
    want_e = np.zeros((k, 3))
    for j in range(f.shape[1]):
        np.add.at(want_e, (f[:, j], y), 1)
    want_s = np.zeros((3, 3))
    before = np.where(col > 0, gold[row, np.maximum(col - 1, 0)], O)
    np.add.at(want_s, (before, y), 1)
    emit, step = np.zeros((k, 3)), np.zeros((3, 3))
    ge, gs = np.full_like(emit, 1e-8), np.full_like(step, 1e-8)

    def lse(m, axis):
        top = m.max(axis, keepdims=True)
        return np.log(np.exp(m - top).sum(axis)) + top.squeeze(axis)

    for _ in range(rounds):
        e = np.zeros((n, width, 3))
        e[row, col] = emit[f].sum(1)
        fw = np.zeros((n, width, 3))
        fw[:, 0] = step[O] + e[:, 0]
        for t in range(1, width):
            fw[:, t] = lse(fw[:, t - 1, :, None] + step, 1) + e[:, t]
        bw = np.zeros((n, width, 3))
        for t in range(width - 2, -1, -1):
            nxt = lse((e[:, t + 1] + bw[:, t + 1])[:, None, :] + step, 2)
            bw[:, t] = np.where(there[:, t + 1, None], nxt, 0)
        z = lse(fw[np.arange(n), sizes - 1], 1)
        p = np.exp(fw + bw - z[:, None, None])[row, col]
        have_e = np.zeros((k, 3))
        for j in range(f.shape[1]):
            np.add.at(have_e, f[:, j], p)
        have_s = np.zeros((3, 3))
        have_s[O] += np.exp(step[O] + e[:, 0] + bw[:, 0] - z[:, None]).sum(0)
        for t in range(1, width):
            q = np.exp(fw[:, t - 1, :, None] + step + (e[:, t] + bw[:, t])[:, None, :] - z[:, None, None])
            have_s += q[there[:, t]].sum(0)
        de, d_s = (want_e - have_e) / n - l2 * emit, (want_s - have_s) / n - l2 * step
        ge += de**2
        gs += d_s**2
        emit += rate * de / np.sqrt(ge)
        step += rate * d_s / np.sqrt(gs)
    return Field(emit, step)


# ---- scanning -------------------------------------------------------------


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of base matches, by start and then kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]{16,}", text)]
    return sorted(out)


def _docs_with(lower: bytes, needle: bytes, at: np.ndarray, found: set) -> None:
    k = lower.find(needle)
    while k >= 0:
        d = int(np.searchsorted(at, k, "right")) - 1
        if k + len(needle) <= at[d + 1]:
            found.add(d)
            k = lower.find(needle, int(at[d + 1]))
        else:
            k = lower.find(needle, k + 1)


def field_spans(tokens: Tokens, lower: bytes, field: Field) -> list[tuple[int, int, int]]:
    """(document, start byte, end byte) of each secret that the field tags."""
    n = len(tokens.start)
    if not n:
        return []
    cue = cue_tokens(tokens, lower)
    which = np.arange(n)
    e = field.scores(features(tokens, which, cue))
    loud = e[:, O] - e[:, 1:].max(1) <= field.gain
    which, e = which[loud], e[loud]
    if not len(which):
        return []
    breaks = np.flatnonzero((np.diff(which) > 1) | (np.diff(tokens.doc[which]) > 0)) + 1
    edges = [0, *breaks.tolist(), len(which)]
    out = []
    for a, b in zip(edges, edges[1:]):
        tag = field.viterbi(e[a:b])
        k = 0
        while k < len(tag):
            if tag[k] == O:
                k += 1
                continue
            j = k + 1
            while j < len(tag) and tag[j] == I:
                j += 1
            head, tail = which[a + k], which[a + j - 1]
            begin, end = secret_bounds(tokens.data[tokens.start[head] : tokens.end[tail]].tobytes(), bool(cue[head] == 2), int(tokens.end[head] - tokens.start[head]))
            if end > begin:
                out.append((int(tokens.doc[head]), int(tokens.start[head]) + begin, int(tokens.start[head]) + end))
            k = j
    return out


def secret_bounds(raw: bytes, assigned: bool, first: int) -> tuple[int, int]:
    """Where the secret is within its tokens, of which the first has ``first`` bytes: without the name it is assigned to, quotes, brackets and a sentence's marks.

    What stands in quotes is taken whole, so that marks which belong to a secret stay with it.
    """
    begin, end = 0, len(raw)
    m = _ASSIGNED.search(raw[:first].lower()) if assigned else None
    if m and m.end() < len(raw.rstrip(_CLOSING)):
        begin = m.end()
    while begin < end and raw[begin] in _OPENING:
        begin += 1
    quoted = raw.rfind(raw[begin - 1 : begin], begin) if begin and raw[begin - 1] in _QUOTES else -1
    if quoted > begin:
        return begin, quoted
    while end > begin and (raw[end - 1] in _CLOSING or raw[end - 1] in b".,;:" and end - begin > 1):
        end -= 1
    return begin, end


def scan_block(array: pa.Array, field: Field) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) spans of each text of a block, in code points, sorted."""
    data, at = raw_bytes(array)
    spans: list[list[tuple[int, int, int]]] = [[] for _ in range(len(at) - 1)]
    if not len(data):
        return spans
    blob = data.tobytes()
    lower = blob.lower()
    hit: set[int] = set()
    for key in _KEYS:
        _docs_with(lower, key, at, hit)
    _docs_with(blob, b"AKIA", at, hit)
    hexes = np.concatenate(([False], _HEX[data], [False]))
    step = np.flatnonzero(hexes[1:] != hexes[:-1])
    a, b = step[::2], step[1::2]
    long = b - a >= 16  # a run may go over texts' ends; each text that it touches is looked at
    first, last = (np.searchsorted(at, x, "right") - 1 for x in (a[long], b[long] - 1))
    for x, y in zip(first.tolist(), last.tolist()):
        hit.update(range(x, y + 1))
    tokens = Tokens(data, at)
    added: dict[int, list[tuple[int, int]]] = {}
    for d, x, y in field_spans(tokens, lower, field):
        added.setdefault(d, []).append((x - int(at[d]), y - int(at[d])))
    for d in sorted(hit | added.keys()):
        raw = blob[at[d] : at[d + 1]]
        base = base_spans(raw.decode()) if d in hit else []
        own = []
        for x, y in added.get(d, []):
            x = len(raw[:x].decode())
            y = len(raw[:y].decode())
            if not _covered(x, y, base):
                own.append((x, 3, y))
        spans[d] = sorted(base + own)
    return spans


def _covered(x: int, y: int, base: list[tuple[int, int, int]]) -> bool:
    """Whether base spans, sorted, hold all of [x, y)."""
    for a, _, b in base:
        if a > x:
            break
        x = max(x, b)
    return x >= y


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, redact: str | None = None) -> DataFrame:
    """Kept columns with counts, ``base_sha256``, ``spans`` and, if ``redact`` is given, ``redacted``: the text with it in place of each span."""
    field = trained_field()
    emit, step = field.emit, field.step
    empty = hashlib.sha256(b"").hexdigest()
    fields = [
        *[T.StructField(n, T.LongType()) for n in ("n_assign", "n_access", "n_hex")],
        T.StructField("base_sha256", T.StringType()),
        T.StructField("spans", T.StringType()),
        T.StructField("n_crf", T.LongType()),
        *([T.StructField("redacted", T.StringType())] if redact is not None else []),
    ]

    def make():
        model = Field(emit, step)

        def run(array: pa.Array):
            found = scan_block(array, model)
            counts = [[0] * len(found) for _ in KINDS]
            digest, text = [empty] * len(found), [""] * len(found)
            for d, spans in enumerate(found):
                if spans:
                    for _, k, _ in spans:
                        counts[k][d] += 1
                    text[d] = _joined(spans)
                    digest[d] = hashlib.sha256(_joined([s for s in spans if s[1] < 3]).encode()).hexdigest()
            ints = [pa.array(c, pa.int64()) for c in counts]
            out = [*ints[:3], pa.array(digest), pa.array(text), ints[3]]
            if redact is not None:
                whole = array.to_pylist()
                for d, spans in enumerate(found):
                    if spans:
                        whole[d] = redacted(whole[d], spans, redact)
                out.append(pa.array(whole, pa.string()))
            return out

        return run

    return append_columns(docs, text_col, make, fields, keep, limit=1 << 17)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """The text with ``mark`` in place of each maximal run of overlapping spans."""
    out, done = [], 0
    for a, _, b in spans:
        if a >= done:
            out += [text[done:a], mark]
        done = max(done, b)
    return "".join(out) + text[done:]
