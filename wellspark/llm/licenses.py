"""License scans by patience alignment.

A template's words are aligned with the whole text: words unique to both sides are anchors, the
longest increasing subsequence of anchors is kept, and the gaps between them are aligned
recursively (runs at a gap's two ends match directly).  Coverage is the share of the template's
words that are aligned; a template is found where coverage reaches ``MIN_COVERAGE``.  Words that
the template doesn't have can't be aligned and are passed over, so an insertion of any length
hides nothing; ``n_inserted`` tells how many words stand between the aligned ones, so that a
reader can set a limit for short notices whose few words a long text may hold far apart.

A text with several copies has no unique words.  The alignment is therefore repeated between the
neighbours of each occurrence of the template's longest unique words, where that word is an
anchor.  Texts that share fewer words with a template than the limit asks are passed over, which
loses nothing.

Words are compared in ASCII lower case without marks around them.  Defined cases: null, empty
and wordless texts have no finding; repeated rows each report; a template found several times in
a text is reported once, at its best place (of equal coverage the one with the fewest inserted
words, then the first), with the number of disjoint places that reach the limit; an empty table
gives no rows; extra columns are ignored, whatever their names; a very long text is aligned whole
(some 200 bytes for each of its words that the template has).
"""

from __future__ import annotations

import bisect
import dataclasses
import functools
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspark.llm import kernel

MIN_COVERAGE = 0.8

#: Wording of public license notices and short public licenses.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "reserved-notice": "All rights reserved.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT '
        "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        'above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL '
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE "
        "LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
        "SOFTWARE."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        'documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" '
        "AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
        "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
        "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; "
        "OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
        "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD-3-Clause-endorsement": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission."
    ),
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain '
        "a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See '
        "the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that "
        "it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details."
    ),
    "GPL-2.0-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that "
        "it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details."
    ),
    "LGPL-2.1-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
        "by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
        "from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must "
        "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
        "appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the "
        "original software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}


def longest_increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence (patience sorting with back pointers)."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect.bisect_left(tops, v)
        if k == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[k], at[k] = v, i
        back[i] = at[k - 1] if k else -1
    out = []
    i = at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Aligned (text place, template place) pairs, ascending in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            out.append((b - 1, d - 1))
            b, d = b - 1, d - 1
        if a >= b or c >= d:
            continue
        left, right = Counter(text[a:b]), Counter(template[c:d])
        where = {w: i for i, w in enumerate(text[a:b], a) if left[w] == 1}
        anchors = [(where[w], j) for j, w in enumerate(template[c:d], c) if right[w] == 1 and w in where]
        chosen = [anchors[k] for k in longest_increasing([i for i, _ in anchors])]
        i, j = a, c
        for x, y in chosen:
            out.append((x, y))
            todo.append((i, x, j, y))
            i, j = x + 1, y + 1
        if chosen:
            todo.append((i, b, j, d))
    return sorted(out)


@dataclasses.dataclass
class Template:
    name: str
    words: list[int]
    #: Aligned words that the limit asks for.
    least: int
    #: The longest words that occur once: any sufficient share of the template's words holds one of these or a repeated word.
    keys: list[int]


@functools.lru_cache(maxsize=1)
def compiled(items: tuple[tuple[str, str], ...], min_coverage: float) -> tuple[list[Template], np.ndarray, np.ndarray]:
    """The templates, all their distinct words (sorted hashes), and how often each template has each word."""
    out = []
    for name, body in items:
        w = kernel.Texts([body.encode()]).words(lower=True, trimmed=True)
        h = w.hash.tolist()
        least = max(1, -(-int(round(min_coverage * 1000)) * len(h) // 1000))
        size = dict(zip(h, (w.stop - w.start).tolist()))
        once = [x for x, n in Counter(h).items() if n == 1]
        out.append(Template(name, h, least, sorted(once, key=lambda x: -size[x])[: len(h) - least + 1]))
    kinds = np.unique(np.array([x for t in out for x in t.words], np.uint64))
    has = np.zeros((len(out), len(kinds)), np.int64)
    for k, t in enumerate(out):
        np.add.at(has[k], np.searchsorted(kinds, np.array(t.words, np.uint64)), 1)
    return out, kinds, has


def scan_words(words: list[int], template: Template) -> tuple[float, int, int, int, int] | None:
    """(coverage, first word, one past the last, disjoint places found, words inserted) of a template at its best place."""
    own = set(template.words)
    at = [i for i, x in enumerate(words) if x in own]
    held = [words[i] for i in at]
    regions = {(0, len(held))}
    for x in template.keys:
        occurs = [i for i, y in enumerate(held) if y == x]
        if len(occurs) > 1:
            regions |= set(zip([0, *(i + 1 for i in occurs[:-1])], [*occurs[1:], len(held)]))
    found = [[(at[a + i], j) for i, j in patience(held[a:b], template.words)] for a, b in sorted(regions) if b - a >= template.least]
    found.append(patience(words, template.words))
    spans = sorted({(-len(p), p[-1][0] + 1 - p[0][0] - len(p), p[0][0], p[-1][0] + 1) for p in found if len(p) >= template.least})
    if not spans:
        return None
    places: list[tuple[int, int]] = []
    for _, _, a, b in sorted(spans, key=lambda s: (s[1], s)):
        k = bisect.bisect(places, (a, b))
        if (k == 0 or places[k - 1][1] <= a) and (k == len(places) or b <= places[k][0]):
            places.insert(k, (a, b))
    n, inserted, a, b = spans[0]
    return -n / len(template.words), a, b, len(places), inserted


def scan(docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """doc_id, license, coverage, start_word, end_word, n_places, n_inserted for each text and template found; one narrow pass."""
    items = tuple((templates or TEMPLATES).items())
    kinds_of = {"doc_id": pa.int64(), "license": pa.string(), "coverage": pa.float64(), "start_word": pa.int64(), "end_word": pa.int64(), "n_places": pa.int64(), "n_inserted": pa.int64()}
    schema = pa.schema(list(kinds_of.items()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, kinds, has = compiled(items, min_coverage)
        for piece, t in kernel.sub_batches(batches):
            w = t.words(lower=True, trimmed=True)
            slot = np.minimum(np.searchsorted(kinds, w.hash), len(kinds) - 1)
            hit = np.flatnonzero(kinds[slot] == w.hash)
            pair, n = np.unique(w.text[hit] * len(kinds) + slot[hit], return_counts=True)
            text, slot = pair // len(kinds), pair % len(kinds)
            ids = piece.column("doc_id").to_pylist()
            rows = []
            for k, template in enumerate(known):  # a text must share enough words
                common = np.bincount(text, weights=np.minimum(n, has[k, slot]), minlength=t.n)
                for d in np.flatnonzero(common >= template.least).tolist():
                    found = scan_words(w.hash[int(w.first[d]) : int(w.last[d])].tolist(), template)
                    if found:
                        rows.append((ids[d], template.name, *found))
            yield kernel.record(schema, *([r[k] for r in rows] for k in range(7)))

    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, license string, coverage double, start_word long, end_word long, n_places long, n_inserted long")
