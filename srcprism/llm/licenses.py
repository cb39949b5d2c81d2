"""License scans by winnowed fingerprints and banded alignment.

Templates are cut into words; the hashes of their runs of ``GRAM`` words are winnowed (the
least of every ``WINDOW`` neighbours is kept) into an inverted index from hash to template
positions. A text's runs of words are looked up in the index: hits near one diagonal propose a
template and where it lies. There the template is aligned with the text within a band around
the diagonal, and the report gives the share of the template's words matched in order and the
span of text they take.

Texts are scanned whole: words that no template has are skipped quickly, so most of a text
costs one dictionary look-up a word.

Edge cases: null and empty texts report nothing; repeated rows report alike; one row per
template occurrence whose coverage reaches ``LEAST``; of occurrences that overlap, the one
with more matched words stays, ties to the earlier template; offsets are code points, ends
exclusive; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

GRAM, WINDOW, SHORT = 3, 3, 20
#: Words that the alignment may drift from its diagonal (a quarter of a short template's), and
#: the coverage reported.
BAND, LEAST = 12, 0.6

_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution. "
)
_BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission. "
)
_BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
    "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
    "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE"
)


def _gnu(name: str, version: str) -> str:
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as "
        f"published by the Free Software Foundation, either version {version} of the License, or (at your option) any "
        "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        f"See the {name} for more details."
    )


def _creative(name: str) -> str:
    return f"This work is licensed under a Creative Commons {name} 4.0 International License."


#: Whole short licenses, the notices that longer ones ask for, and customary lines.
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0",
    "MIT line": "Released under the MIT License",
    "MIT line 2": "Licensed under the MIT License",
    "BSD line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3",
    "GPL-2.0 line": "This work is licensed under the terms of the GNU General Public License, version 2",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0 line": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0 line": "Licensed under CC BY-SA 4.0",
    "CC-BY-4.0": _creative("Attribution"),
    "CC-BY-SA-4.0": _creative("Attribution-ShareAlike"),
    "CC-BY-NC-4.0": _creative("Attribution-NonCommercial"),
    "CC-BY-ND-4.0": _creative("Attribution-NoDerivatives"),
    "CC-BY-NC-SA-4.0": _creative("Attribution-NonCommercial-ShareAlike"),
    "CC-BY-NC-ND-4.0": _creative("Attribution-NonCommercial-NoDerivatives"),
    "CC0-1.0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
        "this work."
    ),
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        f"copies or substantial portions of the Software. {_AS_IS} AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
        "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
        "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE "
        "SOFTWARE."
    ),
    "BSD-2-Clause": _BSD + _BSD_DISCLAIMER,
    "BSD-3-Clause": _BSD + _BSD_NAMES + _BSD_DISCLAIMER,
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
        "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
        "held liable for any damages arising from the use of this software. Permission is granted to anyone to use "
        "this software for any purpose, including commercial applications, and to alter it and redistribute it "
        "freely, subject to the following restrictions: The origin of this software must not be misrepresented; you "
        "must not claim that you wrote the original software. If you use this software in a product, an "
        "acknowledgment in the product documentation would be appreciated but is not required. Altered source "
        "versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "This notice may not be removed or altered from any source distribution."
    ),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software "
        'and accompanying documentation covered by this license (the "Software") to use, reproduce, display, '
        "distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to "
        "permit third-parties to whom the Software is furnished to do so"
    ),
    "GPL-2.0 header": _gnu("GNU General Public License", "2"),
    "GPL-3.0 header": _gnu("GNU General Public License", "3"),
    "LGPL-2.1 header": _gnu("GNU Lesser General Public License", "2.1"),
    "LGPL-3.0 header": _gnu("GNU Lesser General Public License", "3"),
    "AGPL-3.0 header": _gnu("GNU Affero General Public License", "3"),
    "MPL-2.0 header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "EPL-2.0 header": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
        "2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means."
    ),
}

_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Scanner:
    """The templates' vocabulary, index and alignment.

    Of a template of up to SHORT words all runs are indexed: a winnowed few could all be edited.
    """

    def __init__(self, templates: dict[str, str] = TEMPLATES):
        self.names = list(templates)
        self.vocabulary: dict[str, int] = {}
        self.seqs = [
            np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(t)], dtype=np.int64)
            for t in templates.values()
        ]
        if any(len(s) < GRAM for s in self.seqs):
            raise ValueError(f"a template needs {GRAM} words")
        self.bands = [min(BAND, max(1, len(s) // 4)) for s in self.seqs]
        self.index: dict[int, list[tuple[int, int]]] = {}
        for k, seq in enumerate(self.seqs):
            h = self.grams(seq)
            for at in range(len(h)) if len(seq) <= SHORT else self.winnow(h):
                self.index.setdefault(int(h[at]), []).append((k, int(at)))
        self.known = np.array(sorted(self.index), dtype=np.uint64)

    @staticmethod
    def grams(seq: np.ndarray) -> np.ndarray:
        """A hash for each run of GRAM words."""
        h = np.zeros(max(0, len(seq) - GRAM + 1), dtype=np.uint64)
        for j in range(GRAM):
            h = (h ^ seq[j : j + len(h)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    @staticmethod
    def winnow(h: np.ndarray) -> list[int]:
        """Positions of the least hash of every window, the last of equals."""
        if len(h) <= WINDOW:
            return [len(h) - 1 - int(h[::-1].argmin())] if len(h) else []
        kept = {i + WINDOW - 1 - int(h[i : i + WINDOW][::-1].argmin()) for i in range(len(h) - WINDOW + 1)}
        return sorted(kept)

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(template, coverage, start, end) of each occurrence."""
        get = self.vocabulary.get
        seq = np.array([get(w, 0) for w in words(text)], dtype=np.int64)
        runs = np.convolve(seq > 0, np.ones(GRAM, dtype=np.int64), "valid") if len(seq) >= GRAM else np.zeros(0)
        spots = np.flatnonzero(runs == GRAM)
        if not len(spots):
            return []
        h = self.grams(seq)[spots]
        hit = np.isin(h, self.known)
        if not hit.any():
            return []
        found = []
        for k, diagonal in self._candidates(spots[hit], h[hit]):
            got = self._align(self.seqs[k], seq, diagonal, self.bands[k])
            if got and got[0] / len(self.seqs[k]) >= LEAST:
                found.append((got[0], k, got[1], got[2]))
        if not found:
            return []
        kept: list[tuple[int, int, int, int]] = []  # in the order of their places
        for x in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
            i = bisect.bisect_left(kept, x[2], key=lambda y: y[2])
            if (i == 0 or kept[i - 1][3] < x[2]) and (i == len(kept) or x[3] < kept[i][2]):
                kept.insert(i, x)
        places = [m.span() for m in _WORD.finditer(text.lower())] if len(text.lower()) == len(text) else self._places(text)
        return [(self.names[k], n / len(self.seqs[k]), places[a][0], places[b][1]) for n, k, a, b in kept]

    @staticmethod
    def _places(text: str) -> list[tuple[int, int]]:
        """Spans in the text where lower-casing changes lengths."""
        back = [i for i, c in enumerate(text) for _ in c.lower()] + [len(text)]
        return [(back[m.start()], back[m.end() - 1] + 1) for m in _WORD.finditer("".join(c.lower() for c in text))]

    def _candidates(self, spots: np.ndarray, h: np.ndarray) -> list[tuple[int, int]]:
        """(template, diagonal): one for each run of hits that stay within the band."""
        hits = sorted({(k, int(i) - at) for i, g in zip(spots, h, strict=True) for k, at in self.index[int(g)]})
        out: list[tuple[int, int]] = []
        for k, d in hits:
            if not out or out[-1][0] != k or d - out[-1][1] > self.bands[k]:
                out.append((k, d))
        return out

    @staticmethod
    def _align(t: np.ndarray, seq: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int] | None:
        """Longest common subsequence within the band: words matched, first and last place."""
        width = 2 * band + 1
        first = diagonal - band
        best = np.zeros(width, dtype=np.int64)
        begin = np.full(width, -1, dtype=np.int64)
        last = np.full(width, -1, dtype=np.int64)
        for i in range(len(t)):
            # Column b stands for the text's word i + first + b.
            b = np.arange(width)
            at = i + first + b
            inside = (at >= 0) & (at < len(seq))
            same = inside & (seq[np.where(inside, at, 0)] == t[i])
            new = np.where(same, best + 1, np.append(best[1:], 0))
            nb = np.where(same & (begin < 0), at, np.where(same, begin, np.append(begin[1:], -1)))
            nl = np.where(same, at, np.append(last[1:], -1))
            skip = ~same & (best > new)
            new, nb, nl = np.where(skip, best, new), np.where(skip, begin, nb), np.where(skip, last, nl)
            for j in range(1, width):  # a word of the text that the template lacks
                if new[j - 1] > new[j]:
                    new[j], nb[j], nl[j] = new[j - 1], nb[j - 1], nl[j - 1]
            best, begin, last = new, nb, nl
        j = int(best.argmax())
        return (int(best[j]), int(begin[j]), int(last[j])) if best[j] else None


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(doc_id, template, coverage, start, end): one row per occurrence."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        scanner = common.worker_state("licenses", tuple(templates.items()), lambda: Scanner(templates))
        rows = [
            (doc, *x)
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for x in (scanner.scan(text) if text else [])
        ]
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
        return pa.record_batch(list(map(pa.array, columns, kinds)), names=["doc_id", "template", "coverage", "start", "end"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return common.map_batches(rows, each, "doc_id long, template string, coverage double, start long, end long")
