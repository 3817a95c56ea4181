"""License texts found by patience alignment.

A stretch of a text and a template are aligned on the words that are unique in both: their longest increasing subsequence gives the
anchors, and the gaps between anchors are aligned in the same way until nothing is unique. Coverage is the share of the template's
words that are aligned. Of a line or notice, the words that name the license and its version must all be aligned.

A template is tried only where it can succeed: its rarest words are so many that a text without any of them covers less than
``least``, and so does a text that has too few of its words, however they stand. It is then aligned with the whole text, which finds it
however much stands between its words, and with windows around each place where a rare word says that it may begin, which finds every
one of repeated notices. A window that has a quarter of the template (``GROWS``) is made twice as wide as long as that aligns a
twentieth more of it (``GAIN``); so a notice that comes once is found however sparse it is, and repeated ones with up to four foreign
words for each of their own.

Defined cases: a null text counts as empty and has no licenses; repeated rows are rows each; a null doc_id stays null; an empty table
gives an empty result; extra columns are ignored. Of findings that overlap, the one with the most aligned words stays, then the one of
best coverage, then the shortest, then the first.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 0.8
GROWS, GAIN = 0.25, 0.05

#: Notices and short licenses, as they are published.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
and limitations under the License.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission.""",
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
above copyright notice and this permission notice appear in all copies.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to
the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions
of the Software.""",
    "MIT-line": "Released under the MIT License.",
    "MPL-2.0-notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "AGPL-3.0-line": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSD-line": "Released under the BSD License.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-2.1-line": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0-line": "This work is licensed under the GNU Lesser General Public License, version 3.",
}

#: Whole texts of short licenses, as they are published; for the others a notice or line stands.
_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING,
BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED
AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
TEMPLATES |= {
    "MIT-text": TEMPLATES["MIT"] + """
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR
ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH
THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-2-Clause-text": TEMPLATES["BSD-2-Clause"] + "\n" + _AS_IS,
    "BSD-3-Clause-text": TEMPLATES["BSD-3-Clause"] + "\n" + _AS_IS,
    "ISC-text": TEMPLATES["ISC"] + """
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not
be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in
the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must
not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense-text": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and
by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our
heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to
this software under copyright law.""",
}

#: The GNU notices are worded alike.
_GNU = {"AGPL-3.0": ("Affero General", "3"), "GPL-2.0": ("General", "2"), "LGPL-2.1": ("Lesser General", "2.1"), "LGPL-3.0": ("Lesser General", "3")}
TEMPLATES |= {f"{k}-notice": TEMPLATES["GPL-3.0-notice"].replace("GNU General", f"GNU {kind}").replace("version 3", f"version {v}") for k, (kind, v) in _GNU.items()}

#: Words that make another license of one whose words are all there.
KINDS = frozenset(("affero", "lesser", "library"))

#: Words by which a license differs from its kin: its name and version. The template's own must all be aligned.
TELLING = frozenset("apache bsd mit isc mpl mozilla gnu general lesser affero library cc by by-nc by-sa by-nd by-nc-sa by-nc-nd 1 1.0 1.1 2 2.0 2.1 2.5 3 3.0 4 4.0".split())

WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def increasing(values: list[int]) -> list[int]:
    """Positions of a longest increasing subsequence of distinct values, by patience sorting."""
    tops: list[int] = []  # the least last value of a subsequence of each length
    at: list[int] = []  # its position
    back: list[int] = []
    for i, v in enumerate(values):
        k = bisect.bisect_left(tops, v)
        back.append(at[k - 1] if k else -1)
        tops[k : k + 1] = [v]
        at[k : k + 1] = [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned positions (in a, in b), ascending in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: i for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1}
        pairs = [(where[w], j) for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1 and w in where]
        anchors = [pairs[i] for i in increasing([i for i, _ in pairs])]
        if anchors:
            out += anchors
            ends = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            todo += [(p[0] + 1, q[0], p[1] + 1, q[1]) for p, q in zip(ends, ends[1:])]
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str], least: float = LEAST):
        self.least = least
        self.templates = {k: words(v) for k, v in templates.items()}
        # only licenses that are named by a line or notice: the numbers in a license's own text are those of its clauses
        self.telling = {k: {j for j, w in enumerate(v) if w in TELLING} if k.endswith(("-line", "-notice")) else set() for k, v in self.templates.items()}
        self.rare: dict[str, set[str]] = {}
        for name, own in self.templates.items():
            need = len(own) - int(-(-least * len(own) // 1)) + 1  # without so many words, coverage stays below least
            times, got, rare = Counter(own), 0, set()
            for w in sorted(times, key=lambda w: (-len(w), w)):
                if got >= need:
                    break
                rare.add(w)
                got += times[w]
            self.rare[name] = rare
        self.counts = {k: Counter(v) for k, v in self.templates.items()}
        self.vocabulary = KINDS.union(*self.templates.values())
        self.any = sorted(set().union(*self.rare.values())) if self.rare else []

    def __call__(self, text: str) -> list[tuple[str, float, int, int]]:
        """(template, coverage, start, end) in characters."""
        lower = text.lower()
        present = {w for w in self.any if w in lower}
        names = [k for k, rare in self.rare.items() if rare & present]
        if not names:
            return []
        # lower() may change lengths in rare scripts; places are those of the text itself
        found = [(m.group().lower(), m.start(), m.end()) for m in WORD.finditer(text)]
        tokens = [w for w, _, _ in found]
        places: dict[str, list[int]] = {}
        for i, w in enumerate(tokens):
            if w in self.vocabulary:
                places.setdefault(w, []).append(i)
        best: set[tuple[int, float, int, int, int, str]] = set()
        for name in names:
            own = self.templates[name]
            if sum(min(k, len(places.get(w, ()))) for w, k in self.counts[name].items()) < self.least * len(own):
                continue
            for pairs in self.alignments(name, tokens, places):
                if not pairs or len(pairs) < self.least * len(own) or not self.telling[name] <= {j for _, j in pairs}:
                    continue
                a, b, met = pairs[0][0], pairs[-1][0], {i for i, _ in pairs}
                if not any(i not in met and a < i < b for w in KINDS for i in places.get(w, ())):
                    best.add((-len(pairs), -len(pairs) / len(own), b + 1 - a, a, b + 1, name))
        taken: list[tuple[int, int, str, float]] = []
        for _, c, _, a, b, name in sorted(best):
            k = bisect.bisect_left(taken, (a,))
            if (k == len(taken) or b <= taken[k][0]) and (not k or taken[k - 1][1] <= a):
                taken.insert(k, (a, b, name, -c))
        return [(name, round(c, 6), found[a][1], found[b - 1][2]) for a, b, name, c in taken]

    def alignments(self, name: str, tokens: list[str], places: dict[str, list[int]]) -> Iterator[list[tuple[int, int]]]:
        """Of the template with the whole text, and with windows where a rare word stands in its place; (in text, in template)."""
        own = self.templates[name]
        n, slack = len(own), max(2, len(own) // 4)
        yield align(tokens, own)
        whole = range(0)  # a stretch that has all of the template
        for begin in sorted({i - j for j, w in enumerate(own) if w in self.rare[name] for i in places.get(w, ())}):
            if begin in whole:
                continue
            low, high = max(0, begin - slack), begin + n + slack
            pairs = [(low + i, j) for i, j in align(tokens[low:high], own)]
            while GROWS * n <= len(pairs) < n and (low or high < len(tokens)):
                width = high - low
                low, high = max(0, low - width // 2), high + width // 2
                wider = [(low + i, j) for i, j in align(tokens[low:high], own)]
                gain = len(wider) - len(pairs)
                pairs = max(pairs, wider, key=len)
                if gain < GAIN * n:
                    break
            if len(pairs) == n and pairs[-1][0] - pairs[0][0] == n - 1:
                whole = range(begin, pairs[-1][0] + 1)
            yield pairs


def _scanned(templates: dict[str, str], least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(templates, least)
        for batch in batches:
            rows = [(doc, *x) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)) if (t := text.as_py()) for x in scan(t)]
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=["doc_id", "license", "coverage", "start", "end"])

    return run


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """doc_id, license, coverage, start, end (characters, end exclusive) of every stretch that covers a template."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_scanned(templates, least), "doc_id long, license string, coverage double, start long, end long")
