"""License scans: winnowed template fingerprints pick candidates, alignment decides.

A template's words give overlapping grams of ``GRAM`` words, of whose hashes
winnowing keeps the least of every ``WINDOW`` in a row. An inverted index names the
templates and places of each kept hash. All grams of a document are looked up;
hits on about the same diagonal of a document and a template make a candidate if
they are a fair part of the template's fingerprints. A banded alignment of the
template with the words around finds how many of its words match in order, and from
where to where. Its words and hits go, and the hits that are left are aligned again
until no candidate is left. Matches that cover enough are reported, of overlapping
ones the one with the most matched words.

Spans count code points, ends excluded. Null and empty texts have no matches;
repeated rows are scanned alike; texts are scanned whole; other columns pass through,
and where the input has a column of the result's name, the result's gets underscores
before it.
The index holds the templates only, so its size does not depend on the documents.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import free_name, texts

GRAM = 3
WINDOW = 4
#: Words by which an alignment may leave its diagonal.
BAND = 8
#: In place of the number of a word that a match has taken.
_GONE = -2
#: Part of a template's fingerprints that a candidate has.
CANDIDATE = 0.2
#: Part of a template's words that a reported match has.
COVERAGE = 0.75

# Notices and short licenses as their publishers word them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License",
    "MIT-licensed": "Licensed under the MIT License",
    "MIT-text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies."
    ),
    "BSD-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution."
    ),
    "BSD-2-Clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
        "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, "
        "OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
        "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "BSD-3-Clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without "
        "specific prior written permission. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
        "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, "
        "OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
        "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "ISC-whole-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND '
        "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
        "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "Zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of "
        "this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
        "subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you "
        "use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be "
        "plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "BSL-1.0-text": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license "
        '(the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit '
        "third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including "
        "the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative "
        "works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."
    ),
    "Unlicense-whole-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, "
        "the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the "
        "public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and "
        "future rights to this software under copyright law."
    ),
    "LGPL-2.1-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software "
        "Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT "
        "ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."
    ),
    "GPL-warranty-notice": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "GPL-2.0-notice": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "LGPL-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation"
    ),
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "Unlicense-text": "This is free and unencumbered software released into the public domain",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-long": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "proprietary": "All rights reserved",
}

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = {c: c + 32 for c in range(65, 91)}
_TO_SPACE = bytes(c if chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" or c >= 0x80 else 0x20 for c in range(256))
MATCHES = "array<struct<license:string,start:bigint,end:bigint,matched:int,words:int>>"
_MATCHES = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("matched", pa.int32()), ("words", pa.int32())]))


def _words(text: str) -> list[bytes]:
    return text.encode().lower().translate(_TO_SPACE).split()


def winnowed(hashes: np.ndarray, window: int = WINDOW) -> list[int]:
    """Places of the least hash (the rightmost of equal ones) of every ``window`` in a row."""
    n = len(hashes)
    if n <= window:
        return list(range(n))  # a short template keeps all
    kept = set()
    for at in range(n - window + 1):
        part = hashes[at : at + window]
        kept.add(at + window - 1 - int(part[::-1].argmin()))
    return sorted(kept)


class Index:
    """From the hash of a gram to the templates that have it, and where."""

    def __init__(self, templates: Mapping[str, str] = TEMPLATES) -> None:
        self.number: dict[bytes, int] = {}
        self.templates: list[tuple[str, list[int]]] = []
        self.fingerprints: list[int] = []
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for name, text in templates.items():
            ids = [self.number.setdefault(w, len(self.number)) for w in _words(text)]
            of = np.array(ids, dtype=np.int64)
            grams = _grams(of, min(GRAM, len(of)))
            kept = winnowed(grams)
            for at in kept:
                self.places[int(grams[at])].append((len(self.templates), at))
            self.templates.append((name, ids))
            self.fingerprints.append(len(kept))
        self.hashes = np.array(sorted(self.places), dtype=np.int64)

    def matches(self, docs: list[str]) -> list[list[tuple[str, int, int, int, int]]]:
        """For each text its matches: license, first and last word, matched words, words of the template."""
        split = [_words(d) for d in docs]
        sizes = np.array([len(w) for w in split], dtype=np.int64)
        get = self.number.get
        ids = np.fromiter((get(w, -1) for d in split for w in d), dtype=np.int64, count=int(sizes.sum()))
        out: list[list[tuple[str, int, int, int, int]]] = [[] for _ in docs]
        if len(ids) < GRAM:
            return out
        starts = np.cumsum(sizes) - sizes
        grams = _grams(ids, GRAM)
        near = np.minimum(np.searchsorted(self.hashes, grams), len(self.hashes) - 1)
        known = ids >= 0
        hit = np.flatnonzero((self.hashes[near] == grams) & known[: len(grams)] & known[2 : 2 + len(grams)])
        doc = np.searchsorted(starts, hit, side="right") - 1
        inside = hit + GRAM <= starts[doc] + sizes[doc]
        by_doc: dict[int, list[int]] = defaultdict(list)
        for d, at in zip(doc[inside].tolist(), hit[inside].tolist(), strict=True):
            by_doc[d].append(at - int(starts[d]))
        for d, at in by_doc.items():
            own = ids[starts[d] : starts[d] + sizes[d]].tolist()
            out[d] = self._aligned(own, [(a, int(grams[a + int(starts[d])])) for a in at])
        return out

    def _aligned(self, ids: list[int], hits: list[tuple[int, int]]) -> list[tuple[str, int, int, int, int]]:
        diagonals: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for at, gram in hits:
            for template, place in self.places[gram]:
                diagonals[template].append((at - place, place))
        found = []
        for template, of in diagonals.items():
            of.sort()
            found += self._chained(template, of, ids)
        starts: list[int] = []
        kept: dict[int, tuple[str, int, int, int, int]] = {}
        for matched, _, name, first, last, n in sorted(found, key=lambda f: (-f[0], -f[1], f[2], f[3])):
            k = bisect_left(starts, first)
            if (k == len(starts) or last < starts[k]) and (k == 0 or kept[starts[k - 1]][2] < first):
                starts.insert(k, first)
                kept[first] = (name, first, last, matched, n)
        return [kept[first] for first in starts]

    def _chained(self, template: int, of: list[tuple[int, int]], ids: list[int]) -> list[tuple[int, float, str, int, int, int]]:
        """All matches of a template: a chain of hits is aligned at its median diagonal until nothing more is found there, then the hits on either side of it are chains of their own."""
        name, words = self.templates[template]
        found = []
        free = list(ids)  # words of a match go
        stack = [of]
        while stack:
            group: list[tuple[int, int]] = []
            for diagonal, place in [*stack.pop(), (1 << 60, 0)]:
                if group and diagonal - group[-1][0] > BAND:
                    middle = group[len(group) // 2][0]
                    while len({p for _, p in group}) >= CANDIDATE * self.fingerprints[template]:
                        matched, first, last = align(words, free, middle)
                        if matched < COVERAGE * len(words):
                            stack += [side for side in ([h for h in group if h[0] < middle], [h for h in group if h[0] > middle]) if side]
                            break
                        found.append((matched, matched / len(words), name, first, last, len(words)))
                        free[first : last + 1] = [_GONE] * (last + 1 - first)
                        group = [(d, p) for d, p in group if free[d + p] != _GONE]
                    group = []
                group.append((diagonal, place))
        return found


def _grams(ids: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = np.zeros(max(len(ids) - n + 1, 0), dtype=np.uint64)
        for k in range(n):
            h = (h ^ (ids[k : k + len(h)].astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
    return h.view(np.int64)


def align(template: list[int], ids: list[int], diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """Words of the template matched in order near ``diagonal``, and the first and last matched word of the document.

    Two points a match, one off for each template or document word that is passed by
    between matches; what lies before the first and behind the last is free.
    """
    width = 2 * band + 1
    nothing = (0, 0, -1, -1)  # score, matches, first, last
    above = [nothing] * (width + 1)
    best = nothing
    for i, word in enumerate(template):
        row = [nothing] * (width + 1)
        left = nothing
        for b in range(width):
            j = i + diagonal - band + b
            if not 0 <= j < len(ids):
                left = nothing
                continue
            score, matches, first, last = above[b]
            if ids[j] == word:
                cell = (score + 2, matches + 1, first if matches else j, j)
            else:
                cell = (score - 2, matches, first, last)
            for other in (above[b + 1], left):  # a template word, a document word passed by
                if other[0] - 1 > cell[0]:
                    cell = (other[0] - 1, *other[1:])
            if cell[0] <= 0:
                cell = nothing
            row[b] = left = cell
            if cell[0] > best[0]:
                best = cell
        above = row
    return best[1:]


def license_matches(docs: DataFrame, text: str = "text", name: str = "licenses", templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """``docs`` with an array of matches: license, start and end, words matched, words of the template."""
    name = free_name(docs, name)

    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = Index(templates)
        for batch in batches:
            rows = []
            for part in texts(batch):
                given = [t or "" for t in part]
                for t, found in zip(given, index.matches(given), strict=True):
                    at = [m.span() for m in _WORD.finditer(t.translate(_UPPER))] if found else []
                    rows.append([{"license": n, "start": at[a][0], "end": at[b][1], "matched": m, "words": w} for n, a, b, m, w in found])
            yield pa.array(rows, _MATCHES)

    return docs.withColumn(name, F.arrow_udf(scan, MATCHES)(F.col(text)))
