"""License scans: winnowed fingerprints of templates pick candidates, banded alignment measures them.

Templates and texts are compared as lower-case words (runs of letters and digits). A place of a text matches a
template of n words when at most e = floor(n * (1 - min_coverage)) word edits (a template word missing or
replaced, a word too many) part them, so that at least min_coverage of the template's words are matched in order.

e edits leave the n words in at most e + 1 unbroken runs, so one run has at least R = ceil((n - e) / (e + 1)) words. Each
template's sequences of g words are hashed and winnowed: of every w neighbours the one with the smallest hash is kept, with
g + w - 1 <= R, so any such place holds a kept sequence; counted over all runs it holds at least
((n - e) - (e + 1) * (g + w - 2)) / w of them. The kept ones form the inverted index, which is small (templates
only) and goes to every task. A text is probed at every place; hits of a template whose diagonals lie within e of each other,
in that number, propose it there, and an alignment in a band e wider on both sides, free to start and end anywhere in
the text, finds the places with at most e edits: exactly those that an alignment without a band finds (the tests
compare them). A match's span runs over the code points of its first to its last matched word, its coverage is
the share of the template's words matched. Of overlapping matches the one with more matched words stays (then with fewer
edits, the earlier, the first template).

Edge cases: a null text counts as empty and matches nothing; null ids and repeated rows pass through row by
row; a text may hold any number of matches; other columns are left out.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, text_or_empty

MIN_COVERAGE = 0.8
#: The longest word sequence hashed, and the most neighbours of which one is kept.
GRAM = 3
WINDOW = 2

_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_TAIL = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GPL = "This program is free software{} you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {}General Public License for more details. You should have received a copy of the GNU {}General Public License along with this program"

#: One-line notices, whole texts of short public licenses, and the notices that longer ones prescribe.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT-line": "Released under the MIT License.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0-line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": _BSD_HEAD + _BSD_NAMES + _BSD_TAIL,
    "GPL-3.0": _GPL.format(":", "", ",", "3", "", ""),
    "GPL-2.0": _GPL.format(";", "", ";", "2", "", ""),
    "AGPL-3.0": _GPL.format(":", "Affero ", ",", "3", "Affero ", "Affero "),
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

_WORDS = re.compile(r"[^\W_]+")


def edits_allowed(n: int, min_coverage: float = MIN_COVERAGE) -> int:
    return int(n * (1 - min_coverage) + 1e-9)


def gram_and_window(n: int, e: int) -> tuple[int, int]:
    """The longest sequences and window that still catch every place within e edits."""
    run = -(-(n - e) // (e + 1))
    gram = min(GRAM, run)
    return gram, min(WINDOW, run - gram + 1)


def hits_needed(n: int, e: int, gram: int, window: int) -> int:
    """How many kept sequences any place within e edits holds at least."""
    return max(1, -(-((n - e) - (e + 1) * (gram + window - 2)) // window))


def winnow(hashes: list[int], window: int = WINDOW) -> list[int]:
    """Positions kept: in each window the rightmost smallest hash."""
    n = len(hashes)
    return sorted({min(range(s, min(s + window, n)), key=lambda i: (hashes[i], -i)) for s in range(max(1, n - window + 1))}) if n else []


def align(template: list[int], words: list[int], low: int, high: int, most: int) -> list[tuple[int, int, int, int]]:
    """Places (matched, edits, first, last) of at most so many edits, one for each end in the text; first and last are
    places of matched words. Cell (i, j) of the table, i template words against a text up to word j, is kept for
    low <= j - i <= high. Edits are minimal, then matched words are most, then the place starts last."""
    n, width = len(words), high - low + 1
    # Cells are (edits, -matched, -first, last); first is -1 before anything is matched.
    outside = (1 << 30, 0, 0, -1)
    above = [(0, 0, 1, -1) if 0 <= low + d <= n else outside for d in range(width)]
    for i, t in enumerate(template):
        row, left = [], outside
        for d in range(width):
            j = i + 1 + low + d  # words of the text used so far
            if not 0 <= j <= n:
                cell = outside
            else:
                s, m, a, b = above[d]
                if j and words[j - 1] == t:
                    cell = (s, m - 1, a if b >= 0 else 1 - j, j - 1)
                else:
                    cell = (s + 1, m, a, b) if j else outside
                if d + 1 < width:
                    s, m, a, b = above[d + 1]
                    cell = min(cell, (s + 1, m, a, b))
                s, m, a, b = left
                cell = min(cell, (s + 1, m, a, b))
            row.append(cell)
            left = cell
        above = row
    return [(-m, s, -a, b) for s, m, a, b in above if s <= most and b >= 0]


class Scanner:
    """An inverted index over winnowed templates, and the scan of one text."""

    def __init__(self, templates: dict[str, str], min_coverage: float = MIN_COVERAGE):
        self.names = list(templates)
        texts = [_WORDS.findall(t.lower()) for t in templates.values()]
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for t in texts for w in t}))}
        self.templates = [[self.vocabulary[w] for w in t] for t in texts]
        self.edits, self.needed = [], []
        self.index: dict[int, dict[tuple[int, ...], list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for k, words in enumerate(self.templates):
            if not words:
                raise ValueError(f"template {self.names[k]} has no words")
            e = edits_allowed(len(words), min_coverage)
            gram, window = gram_and_window(len(words), e)
            self.edits.append(e)
            self.needed.append(hits_needed(len(words), e, gram, window))
            grams = [tuple(words[i : i + gram]) for i in range(len(words) - gram + 1)]
            for i in winnow([xxhash.xxh64_intdigest(repr(g).encode()) for g in grams], window):
                self.index[gram][grams[i]].append((k, i))

    def _bands(self, ids: list[int]) -> list[tuple[int, int, int]]:
        """(template, lowest, highest diagonal) of all proposals."""
        known = np.array(ids, np.int32) > 0
        hits: dict[int, list[int]] = defaultdict(list)
        for gram, index in self.index.items():
            places = len(ids) - gram + 1
            if places < 1:
                continue
            run = known[:places].copy()
            for k in range(1, gram):
                run &= known[k : places + k]
            for p in np.flatnonzero(run).tolist():
                for k, q in index.get(tuple(ids[p : p + gram]), ()):
                    hits[k].append(p - q)
        out = []
        for k, diagonals in hits.items():
            e, at = self.edits[k], np.sort(np.array(diagonals))
            enough = np.searchsorted(at, at + e, side="right") - np.searchsorted(at, at, side="left") >= self.needed[k]
            proposed = np.unique(at[enough]).tolist()
            while proposed:
                cut = next((i for i in range(1, len(proposed)) if proposed[i] - proposed[i - 1] > 2 * e + 1), len(proposed))
                out.append((k, proposed[0] - e, proposed[cut - 1] + e))
                proposed = proposed[cut:]
        return out

    def scan(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """(license, coverage, start, end, matched words) of each match, by start."""
        lower = text.lower()
        known = self.vocabulary.get
        ids = [known(w, 0) for w in _WORDS.findall(lower)]
        found = [(m, s, a, b, k) for k, low, high in self._bands(ids) for m, s, a, b in align(self.templates[k], ids, low, high, self.edits[k])]
        return self._spans(text, lower, len(ids), found)

    def _spans(self, text: str, lower: str, n: int, found: list[tuple[int, int, int, int, int]]) -> list[tuple[str, float, int, int, int]]:
        """Of overlapping places the best ones, with their spans. found: (matched, edits, first, last, template)."""
        kept, taken = [], bytearray(n)
        for m, _, a, b, k in sorted(set(found), key=lambda x: (-x[0], x[1], x[2], x[4], x[3])):
            if not any(taken[a : b + 1]):
                taken[a : b + 1] = b"\1" * (b + 1 - a)
                kept.append((m, a, b, k))
        # Lower case may change a text's length, so places are read from the text itself.
        places = [m.span() for m in _WORDS.finditer(text if len(lower) == len(text) else lower)] if kept else []
        return sorted(((self.names[k], round(m / len(self.templates[k]), 6), places[a][0], places[b][1], m) for m, a, b, k in kept), key=lambda x: (x[2], x[0]))


@lru_cache(4)
def _scanner(items: tuple[tuple[str, str], ...], min_coverage: float) -> Scanner:
    return Scanner(dict(items), min_coverage)


_MATCHES = "matches array<struct<license:string,coverage:double,start:bigint,end:bigint,words:int>>"


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(id, matches) for each row."""
    items = tuple((TEMPLATES if templates is None else templates).items())

    def make():
        scanner = _scanner(items, min_coverage)

        def one(row):
            return row[0], [dict(zip(("license", "coverage", "start", "end", "words"), m)) for m in scanner.scan(row[1])]

        return one

    narrow = docs.select(F.col(id_col).cast("bigint").alias(id_col), text_or_empty(text_col).alias("text"))
    return map_rows(narrow, make, f"{id_col} bigint, {_MATCHES}")
