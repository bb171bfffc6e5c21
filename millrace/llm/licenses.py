"""License scans by patience alignment of texts with license templates."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import word_hashes

# Notices by which public licenses are named, and the whole texts of the short licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "BSD-2-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-short": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}


def align(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Increasing pairs of equal words: unique common words, longest increasing subsequence, then each gap alike.

    Where a gap has no anchor, equal words at its two ends are taken.
    """
    out, todo = [], [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        n, m = Counter(text[a:b]), Counter(template[c:d])
        where = {w: c + k for k, w in enumerate(template[c:d]) if m[w] == 1 and n[w] == 1}
        anchors = [(a + k, where[w]) for k, w in enumerate(text[a:b]) if w in where]
        chain = _longest(anchors)
        x, y = a, c
        for i, j in chain:
            todo.append((x, i, y, j))
            out.append((i, j))
            x, y = i + 1, j + 1
        if chain:
            todo.append((x, b, y, d))
    return sorted(out)


def _longest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest chain in which both numbers increase; pairs come in order of the first."""
    tops: list[int] = []
    place: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        if at:
            back[k] = place[at - 1]
        if at == len(tops):
            tops.append(j)
            place.append(k)
        else:
            tops[at], place[at] = j, k
    out, k = [], place[-1] if place else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float) -> None:
        self.names = sorted(templates)
        self.words = [w.tolist() for w in word_hashes([templates[n].encode() for n in self.names])]
        self.vocabulary = np.unique(np.array([w for t in self.words for w in t], np.uint64))
        self.need = [Counter(t) for t in self.words]
        self.own = [np.isin(self.vocabulary, np.array(t, np.uint64)) for t in self.words]
        self.coverage = coverage

    def scan(self, words: np.ndarray) -> list[tuple[str, float, int, int]]:
        """(template, coverage, first word, last word) of the spans that hold enough of a template, in order of place; none overlap.

        A window of twice the template's length, moved by half of it, holds a whole notice; only windows are aligned
        where the words that both have, in any order, could reach the coverage.  Narrower windows in it tell notices that follow each other apart.
        """
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        known = np.flatnonzero(self.vocabulary[at] == words)
        codes, found = at[known], []
        for name, template, need, own in zip(self.names, self.words, self.need, self.own):
            n = len(template)
            least, step = self.coverage * n, n // 2 + 1
            if len(known) < least:
                continue
            hits = known[own[codes]]
            if len(hits) < least:
                continue
            starts = np.unique(np.concatenate([np.maximum(0, (hits // step - k) * step) for k in range(4)]))
            inside = np.searchsorted(hits, starts + 2 * n) - np.searchsorted(hits, starts)
            for s in starts[inside >= least].tolist():
                part = words[s : s + 2 * n].tolist()
                have = Counter(w for w in part if w in need)
                if sum(min(c, need[w]) for w, c in have.items()) < least:
                    continue
                q = max(1, n // 4)
                for a, b in [(0, 2 * n), *((k * q, k * q + n + q) for k in range(4))]:
                    pairs = align(part[a:b], template)
                    if len(pairs) >= least:
                        found.append((name, len(pairs) / n, s + a + pairs[0][0], s + a + pairs[-1][0], 2 * len(pairs) - n))
        out: list[tuple] = []
        for x in sorted(found, key=lambda x: (-x[4], -x[1], x[3] - x[2], x[0], x[2])):
            if all(x[3] < y[2] or y[3] < x[2] for y in out):
                out.append(x)
        return sorted((x[:4] for x in out), key=lambda x: x[2])


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = 0.8) -> DataFrame:
    """doc_id, license, coverage, first_word, last_word: a row for each span of a whole text that holds `coverage` of a template's words in its order.

    Of spans that overlap, of one template or several, the one wins that has the most words of its template less those that it lacks, then the better covered, then the
    tighter one.  So a license is told from its variants, and a notice that repeats is reported each time.
    Words are lower-cased runs without white space.  Null, empty and unlicensed texts and an empty table give no row; repeated rows and those without doc_id give theirs each.
    """
    templates = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, coverage)
        for b in batches:
            rows = [(i, *x) for i, words in zip(b.column(0).to_pylist(), word_hashes([(t or "").encode() for t in b.column(1).to_pylist()])) for x in scanner.scan(words)]
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=["doc_id", "license", "coverage", "first_word", "last_word"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, license string, coverage double, first_word long, last_word long")
