"""License scans: patience alignment of texts with license notices.

Words unique to both a stretch of text and a notice are anchors; the longest
increasing run of their positions is kept, and the gaps between are aligned the
same way, after equal words at their ends are taken off. A notice is found where the
aligned words cover at least ``share`` of its own and all of those that tell it from others (its name, version or clause).

Two kinds of places are looked at. One is a stretch about a key word of the notice, one of its floor((1 -
share) * words) + 1 longest ones, of which a copy that covers enough must hold one; that word is the first anchor, so a notice that
stands twice in a row is found twice though none of its words is unique there. The other is the whole text: runs of ``RUN`` or more
words that it shares with the notice are chained in order, whatever stands between them and however much, as the chain with the
most words and of these the one that starts last; gaps between them are aligned too. Of finds that share words of the text
the one with more aligned words stays.

Words are runs of letters and digits, in lower case. Null and empty texts have no
license. Repeated rows get equal results, an empty table an empty one; a kept
column named like an output gives way to it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillmere.llm.batches import append_columns

SHARE = 0.8
_WORD = re.compile(r"[^\W_]+")

#: Words in a row that make a run, in the search over whole texts.
RUN = 6

# Names, customary notices and whole texts of public licenses. Words in braces tell a license from others.
NOTICES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the {Apache} License, Version {2.0}.",
        'Licensed under the {Apache} License, Version {2.0} (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ],
    "MIT": [
        "Released under the {MIT} License.",
        "Licensed under the {MIT} License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The {above} copyright notice and this permission notice shall be included in all copies or {substantial} portions of the Software.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The {above} copyright notice and this permission notice shall be included in all copies or {substantial} portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "MIT-0": [
        "Licensed under the {MIT No} Attribution License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "GPL-3.0": [
        "This work is licensed under the {GNU General Public License}, version {3}.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version {3} of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version {3} of the License, or (at your option) any later version. This program is distributed in the hope that it "
        "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details.",
    ],
    "GPL-2.0": [
        "This work is licensed under the {GNU General Public License}, version {2}.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version {2} of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version {2} of the License, or (at your option) any later version. This program is distributed in the hope that it "
        "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details.",
    ],
    "LGPL-3.0": [
        "This work is licensed under the {GNU Lesser General Public License}, version {3}.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {Lesser} General Public License as published by the "
        "Free Software Foundation, either version {3} of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {Lesser} General Public License as published by the "
        "Free Software Foundation, either version {3} of the License, or (at your option) any later version. This program is distributed in the hope that it "
        "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU {Lesser} General Public License for more details.",
    ],
    "LGPL-2.1": [
        "This work is licensed under the {GNU Lesser General Public License}, version {2.1}.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {Lesser} General Public License as published by the "
        "Free Software Foundation, either version {2.1} of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {Lesser} General Public License as published by the "
        "Free Software Foundation, either version {2.1} of the License, or (at your option) any later version. This program is distributed in the hope that it "
        "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU {Lesser} General Public License for more details.",
    ],
    "AGPL-3.0": [
        "This work is licensed under the {GNU Affero General Public License}, version {3}.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {Affero} General Public License as published by the "
        "Free Software Foundation, either version {3} of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {Affero} General Public License as published by the "
        "Free Software Foundation, either version {3} of the License, or (at your option) any later version. This program is distributed in the hope that it "
        "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU {Affero} General Public License for more details.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the {Mozilla} Public License, v. {2.0}. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the {Eclipse} Public License {2.0} which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "EUPL-1.2": ["Licensed under the {EUPL}, Version {1.2} only."],
    "BSD-2-Clause": [
        "Licensed under the {BSD 2-Clause} License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED "
        "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
        "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
        "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
        "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
        "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "BSD-3-Clause": [
        "Licensed under the {BSD 3-Clause} License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to {endorse} or {promote} products derived from this "
        "software without specific prior written permission. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED "
        "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
        "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
        "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
        "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
        "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "ISC": [
        "Licensed under the {ISC} License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, {provided} that the above copyright notice and this permission notice appear in all {copies}.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, {provided} that the above copyright notice and this permission notice appear in all {copies}. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
        "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "0BSD": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
        "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "Zlib": [
        "Licensed under the {zlib} License.",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
        "from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it "
        "and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that "
        "you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not "
        "required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may "
        "not be removed or altered from any source distribution.",
    ],
    "BSL-1.0": ["Distributed under the {Boost} Software License, Version {1.0}."],
    "CC-BY-4.0": ["Licensed under {CC BY 4.0}."],
    "CC-BY-SA-4.0": ["Licensed under {CC BY-SA 4.0}."],
    "CC-BY-ND-4.0": ["Licensed under {CC BY-ND 4.0}."],
    "CC-BY-NC-4.0": ["Licensed under {CC BY-NC 4.0}.", "This work is licensed under a Creative Commons Attribution-{NonCommercial 4.0} International License."],
    "CC-BY-NC-SA-4.0": ["Licensed under {CC BY-NC-SA 4.0}."],
    "CC-BY-NC-ND-4.0": ["Licensed under {CC BY-NC-ND 4.0}."],
    "CC0-1.0": ["Released under {CC0 1.0} Universal."],
    "Unlicense": [
        "This is free and {unencumbered} software released into the public domain.",
        "This is free and {unencumbered} software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
        "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that "
        "recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make "
        "this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of "
        "relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    ],
}


def template(text: str) -> tuple[list[str], set[int]]:
    """Words of a notice, and the places of those in braces."""
    words, must = [], set()
    for k, part in enumerate(re.split("[{}]", text.lower())):
        own = _WORD.findall(part)
        if k % 2:
            must.update(range(len(words), len(words) + len(own)))
        words += own
    return words, must


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs, sorted by the first place, whose second places rise."""
    tops: list[int] = []
    ends: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        if at == len(tops):
            tops.append(b)
            ends.append(k)
        else:
            tops[at] = b
            ends[at] = k
        before[k] = ends[at - 1] if at else -1
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def patience(a: list[str], b: list[str], a0: int, a1: int, b0: int, b1: int, out: list[tuple[int, int]]) -> None:
    """Adds aligned places of a[a0:a1] and b[b0:b1] to ``out``."""
    stack = [(a0, a1, b0, b1)]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: i for i, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        pairs = [(i, where[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in where]
        pa_, pb = a0, b0
        anchors = rising(pairs)
        if not anchors:
            continue
        for i, j in [*anchors, (a1, b1)]:
            stack.append((pa_, i, pb, j))
            pa_, pb = i + 1, j + 1
        out += anchors


class Notices:
    """Templates as words, an automaton of their key words, and where their runs of three words stand."""

    def __init__(self, notices: dict[str, list[str]], share: float = SHARE):
        import ahocorasick

        self.share = share
        self.names, self.words, self.must, self.keys, self.threes = [], [], [], {}, {}
        for name, texts in notices.items():
            for t in texts:
                words, must = template(t)
                n = int((1 - share) * len(words) + 1e-9) + 1
                k = len(self.names)
                self.names.append(name)
                self.words.append(words)
                self.must.append(must)
                for i in sorted(range(len(words)), key=lambda i: (-len(words[i]), i))[:n]:
                    self.keys.setdefault(words[i], []).append((k, i))
                if len(words) >= 2 * RUN:
                    for i in range(len(words) - 2):
                        self.threes.setdefault(tuple(words[i : i + 3]), []).append((k, i))
        self.auto = ahocorasick.Automaton()
        for w in self.keys:
            self.auto.add_word(w, w)
        self.auto.make_automaton()

    def _enough(self, k: int, pairs: list[tuple[int, int]]) -> bool:
        return len(pairs) >= self.share * len(self.words[k]) - 1e-9 and self.must[k] <= {j for _, j in pairs}

    def _near_keys(self, words: list[str], wanted: set[str]) -> list[tuple[int, list[tuple[int, int]]]]:
        """(notice, aligned places) about each key word in the text."""
        places: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            if w in wanted:
                places.setdefault(w, []).append(i)
        found = []
        for w, at in places.items():
            for k, i in self.keys[w]:
                notice = self.words[k]
                slack = len(notice) // 2 + 4
                for p in at:
                    lo, hi = max(0, p - i - slack), min(len(words), p + len(notice) - i + slack)
                    pairs = [(p, i)]
                    patience(words, notice, lo, p, 0, i, pairs)
                    patience(words, notice, p + 1, hi, i + 1, len(notice), pairs)
                    if self._enough(k, pairs):
                        found.append((k, sorted(pairs)))
        return found

    def _runs(self, words: list[str], wanted: set[int]) -> dict[int, list[tuple[int, int, int]]]:
        """For each notice wanted, (place in the text, place in the notice, words) of the longest runs of ``RUN`` words or more."""
        open_: dict[tuple[int, int], tuple[int, int]] = {}  # (notice, place less notice's place): first place and place after the last
        out: dict[int, list[tuple[int, int, int]]] = {}

        def close(k, shift, a, b):
            if b - a >= RUN:
                out.setdefault(k, []).append((a, a - shift, b - a))

        for p in range(len(words) - 2):
            for k, i in self.threes.get((words[p], words[p + 1], words[p + 2]), ()):
                if k in wanted:
                    a, b = open_.get((k, p - i), (p, p))
                    if b < p + 2 and a < p:
                        close(k, p - i, a, b)
                        a = p
                    open_[k, p - i] = a, p + 3
        for (k, shift), (a, b) in open_.items():
            close(k, shift, a, b)
        return {k: sorted(runs) for k, runs in out.items()}

    def _over_whole(self, words: list[str], wanted: set[int], found: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, list[tuple[int, int]]]]:
        """(notice, aligned places) of chains of runs, of what finds of the same notice leave."""
        taken: dict[int, set[int]] = {}
        for k, pairs in found:
            taken.setdefault(k, set()).update(p for p, _ in pairs)
        out = []
        for k, runs in self._runs(words, wanted).items():
            own = taken.get(k, set())
            runs = [r for r in runs if r[0] not in own and r[0] + r[2] - 1 not in own]
            notice = self.words[k]
            while sum(n for _, _, n in runs) >= RUN:
                chain = best_chain(runs, len(notice))
                pairs = [(p + x, i + x) for p, i, n in chain for x in range(n)]
                for (p, i, n), (q, j, _) in zip(chain, chain[1:]):
                    patience(words, notice, p + n, q, i + n, j, pairs)
                (p, i, _), (q, j, n) = chain[0], chain[-1]
                patience(words, notice, max(0, p - 2 * i), p, 0, i, pairs)
                patience(words, notice, q + n, min(len(words), q + n + 2 * (len(notice) - j - n)), j + n, len(notice), pairs)
                if not self._enough(k, pairs):
                    break
                out.append((k, sorted(pairs)))
                used = set(chain)
                runs = [r for r in runs if r not in used]
        return out

    def find(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """(license, start, end, coverage) of each notice found, in order."""
        if not text:
            return []
        low = text.lower()
        # a few characters change their length in lower case; then places are looked up in the text itself
        same = len(low) == len(text)
        hits = set()
        for end, w in self.auto.iter(low):
            a, b = end + 1 - len(w), end + 1
            if (a == 0 or not low[a - 1].isalnum()) and (b == len(low) or not low[b].isalnum()):
                hits.add(w)
        if not hits:
            return []
        spans = [m.span() for m in _WORD.finditer(text if not same else low)]
        words = [text[a:b].lower() for a, b in spans] if not same else [low[a:b] for a, b in spans]
        found = self._near_keys(words, hits)
        found += self._over_whole(words, {k for w in hits for k, _ in self.keys[w]}, found)
        ranked = sorted((-len(pairs), -len(pairs) / len(self.words[k]), pairs[0][0], pairs[-1][0], k, n) for n, (k, pairs) in enumerate(found))
        out: list[tuple[str, int, int, float]] = []
        taken: set[int] = set()
        for _, cover, a, b, k, n in ranked:
            own = {p for p, _ in found[n][1]}
            if own.isdisjoint(taken):
                taken |= own
                out.append((self.names[k], spans[a][0], spans[b][1], -cover))
        return sorted(out, key=lambda x: x[1:])


def best_chain(runs: list[tuple[int, int, int]], size: int) -> list[tuple[int, int, int]]:
    """Of runs (place, place in a notice of ``size`` words, words), sorted, those that follow each other in both with the most words; of equal ones the chain that starts last."""
    best: list[tuple[int, int, int]] = [(0, 0, -1)] * (size + 1)  # by words of the notice used: (words, start, run)
    tree = best[:]

    def upto(i):
        top = (0, 0, -1)
        while i > 0:
            top = max(top, tree[i])
            i &= i - 1
        return top

    before, done, values = [-1] * len(runs), [], [(0, 0, -1)] * len(runs)
    ending = sorted(range(len(runs)), key=lambda k: runs[k][0] + runs[k][2])
    at = 0
    for k, (p, i, n) in enumerate(runs):
        while at < len(ending) and runs[ending[at]][0] + runs[ending[at]][2] <= p:
            e = ending[at]
            x = runs[e][1] + runs[e][2]
            while x <= size:
                tree[x] = max(tree[x], values[e])
                x += x & -x
            at += 1
        words, start, prior = upto(i)
        before[k] = prior
        values[k] = (words + n, start if prior >= 0 else p, k)
    k = max(values)[2] if values else -1
    while k >= 0:
        done.append(runs[k])
        k = before[k]
    return done[::-1]


def scan_licenses(docs: DataFrame, text_col: str = "text", notices: dict[str, list[str]] | None = None, share: float = SHARE, keep: list[str] | None = None) -> DataFrame:
    """Kept columns with n_licenses, licenses (name:start:end:coverage, comma-joined, in code points) and best_coverage."""
    notices = NOTICES if notices is None else notices
    fields = [T.StructField("n_licenses", T.LongType()), T.StructField("licenses", T.StringType()), T.StructField("best_coverage", T.DoubleType())]

    def make():
        known = Notices(notices, share)

        def run(array: pa.Array):
            found = [known.find(t) for t in array.to_pylist()]
            return (
                pa.array([len(x) for x in found], pa.int64()),
                pa.array([",".join(f"{n}:{a}:{b}:{c:.4f}" for n, a, b, c in x) for x in found], pa.string()),
                pa.array([round(max((c for *_, c in x), default=0.0), 4) for x in found], pa.float64()),
            )

        return run

    return append_columns(docs, text_col, make, fields, keep)
