"""License notices in texts: MinHash bands over overlapping windows find templates, exact containment verifies them.

A text is a sequence of words (runs of ASCII letters and digits, in lower case) and of their five-word shingles; a template
of fewer words is one shingle of its own width. Templates are classed by size: those with L shingles, 2^k <= L < 2^(k+1),
are sought in windows of ``2^(k+1) + 2^k / 4`` shingles that begin every ``2^k / 4``, so a copy always lies wholly in one.
A window's set and a template that it holds to 80 % then have a Jaccard similarity of 0.32 or more, and BANDS bands of one
minimum each meet with a probability over ``1 - 0.68^BANDS``, 0.9999. Windows without any shingle of any template have
similarity 0 to all and are passed over. A template matches if the window has at least CONTAINMENT of its shingles.

Templates are few: their index goes to all tasks, and its size is checked. Texts are read once, without a shuffle.

Defined cases: a null or empty text has no matches; a template found in overlapping windows counts once, at its best
place; repeated rows have equal results; an empty table gives an empty result; extra columns are ignored; texts are scanned whole.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles

BANDS = 28
CONTAINMENT = 0.8
GROUP = 512
#: Characters of all templates at most; they are sent to every task.
MAX_TEMPLATE_CHARS = 20_000_000
_WORD = re.compile("[a-z0-9]+")

#: Public licence notices (fixed values).
TEMPLATES: dict[str, str] = {
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "mit-line-under": "Licensed under the MIT License.",
    "mit-line-see": "This project is licensed under the MIT License - see the LICENSE file for details.",
    "apache-2.0-line-under": "Licensed under the Apache License 2.0.",
    "gpl-3.0-line-only": "Licensed under the GNU General Public License v3.0.",
    "gpl-2.0-line": "Licensed under the GNU General Public License v2.0.",
    "lgpl-line": "Licensed under the GNU Lesser General Public License.",
    "agpl-3.0-line": "Licensed under the GNU Affero General Public License v3.0.",
    "bsd-3-clause-line": "Licensed under the BSD 3-Clause License.",
    "mpl-2.0-line": "Licensed under the Mozilla Public License 2.0.",
    "cc-by-4.0-line-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-line-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-line": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "all-rights-reserved": "All rights reserved.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-3-clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "cc0-1.0": "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class Index:
    def __init__(self, templates: dict[str, str], bands: int = BANDS, containment: float = CONTAINMENT):
        if sum(map(len, templates.values())) > MAX_TEMPLATE_CHARS:
            raise ValueError("too many templates to send to every task")
        self.containment, self.names = containment, sorted(templates)
        self.seeds = shingles.seeds(bands, 3)
        self.sets: list[np.ndarray] = []
        #: (words of a shingle, size class) → (band, minimum) → templates
        self.tables: dict[tuple[int, int], dict[tuple[int, int], list[int]]] = defaultdict(lambda: defaultdict(list))
        for t, name in enumerate(self.names):
            words = words_of(templates[name])
            width = min(shingles.WIDTH, len(words))
            own = np.unique(shingles.shingles([words], width)[1]) if words else np.zeros(0, np.uint64)
            self.sets.append(own)
            if len(own):
                for b, m in enumerate(self.minima(own).tolist()):
                    self.tables[width, len(own).bit_length() - 1][b, m].append(t)
        self.known = {w: np.unique(np.concatenate([self.sets[t] for (x, _), table in self.tables.items() if x == w for ts in table.values() for t in ts])) for w in {w for w, _ in self.tables}}
        self.tables = {k: dict(v) for k, v in self.tables.items()}  # type: ignore[assignment]

    def minima(self, h: np.ndarray) -> np.ndarray:
        return shingles.mix(h[None, :] ^ self.seeds[:, None]).min(axis=1)

    @staticmethod
    def windows(n: int, k: int) -> tuple[np.ndarray, int]:
        """Starts of the windows of size class k over n shingles, and their length."""
        step = max(1, (1 << k) // 4)
        length = (2 << k) - 1 + step
        return np.arange(0, max(1, n - length + step), step), length

    def match(self, h: np.ndarray, hit: np.ndarray, width: int, bands: bool = True) -> list[tuple[int, int, int, float]]:
        """(template, first word, end, containment) in one text's shingles. bands=False compares all templates with every window instead."""
        before = np.concatenate([[0], np.cumsum(hit)])
        best: dict[int, list[tuple[int, int, float]]] = defaultdict(list)
        for (w, k), table in self.tables.items():
            if w != width:
                continue
            starts, length = self.windows(len(h), k)
            ends = np.minimum(starts + length, len(h))
            for a, e in zip(*(x[before[ends] > before[starts]].tolist() for x in (starts, ends)), strict=True):
                part = h[a:e]
                if bands:
                    cand = {t for b, m in enumerate(self.minima(part).tolist()) for t in table.get((b, m), ())}
                else:
                    cand = {t for ts in table.values() for t in ts}
                for t in cand:
                    own = self.sets[t]
                    there = own[np.minimum(np.searchsorted(own, part), len(own) - 1)] == part
                    share = len(np.unique(part[there])) / len(own)
                    if share >= self.containment - 1e-9:
                        at = np.flatnonzero(there)
                        best[t].append((a + int(at[0]), a + int(at[-1]) + width, share))
        out = []
        for t, spans in best.items():
            taken: list[tuple[int, int]] = []
            for s, e, share in sorted(spans, key=lambda x: (-x[2], x[1] - x[0], x[0])):
                if all(e <= a or s >= b for a, b in taken):
                    taken.append((s, e))
                    out.append((t, s, e, share))
        return out

    def scan(self, texts: list[str | None], bands: bool = True) -> list[list[dict]]:
        """Matches of each text, by place."""
        hashes, n = shingles.hashed([words_of(t) for t in texts])
        found: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
        for width, known in self.known.items():
            owner, h = shingles.of_hashes(hashes, n, width)
            hit = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
            ends = np.cumsum(np.bincount(owner, minlength=len(texts)))
            for i in np.unique(owner[hit]).tolist():
                a, e = ends[i - 1] if i else 0, ends[i]
                found[i] += self.match(h[a:e], hit[a:e], width, bands)
        return [[{"license": self.names[t], "start": s, "end": e, "containment": c} for t, s, e, c in sorted(x, key=lambda m: (m[1], m[2], m[0]))] for x in found]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, matches array<struct<license, start, end, containment>>) of every row; start and end count words."""
    index = Index(TEMPLATES if templates is None else templates)
    src = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("containment", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, GROUP):
                part = b.slice(i, GROUP)
                yield pa.RecordBatch.from_pydict({id_col: part.column(0), "matches": pa.array(index.scan(part.column(1).to_pylist()), kind)})

    return src.mapInArrow(run, f"`{id_col}` {src.schema[id_col].dataType.simpleString()}, matches array<struct<license: string, start: int, end: int, containment: double>>")
