"""License scans: winnowed fingerprints pick candidates, banded alignment confirms them.

Word trigrams of each template are winnowed into an inverted index; short templates, of which a few edits could hit every winnowed
trigram, keep all, and the shortest their pairs of words too. The index holds the templates only, so its size is
fixed by them, and it travels with the task. Every trigram and pair of a text is looked up in it: a shared passage of
WINDOW + 2 words or more always meets one. Hits of one template that fall on nearby diagonals make a candidate, and a
banded alignment of template and text reports how many template words match, and where.

Words are runs of letters and digits, A-Z lower-cased; other characters of ASCII part them. Nulls and empty texts give
no rows; texts are read whole, however long; every occurrence is a row, so repeated rows and repeated passages repeat, and a passage that
fits several templates (a longer one may hold a shorter one) is a row for each. A null doc_id is kept. An empty
table gives no rows, and other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from linkloom.llm.common import lower_ascii, mix64, utf8, word_hashes

GRAM, WINDOW, BAND, COVERAGE = 3, 3, 6, 0.8
#: Templates up to so many words keep all their trigrams, and all their pairs of words too: a few edits could hit each winnowed one.
WHOLE, PAIRS = 60, 8

#: Public license texts and notices.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "all-rights-reserved": "All rights reserved.",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "gpl-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "lgpl-2.1-header": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "agpl-3.0-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""",
    "mpl-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "bsl-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.""",
}

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start, end and row of each word."""
    solid = np.zeros(len(raw) + 2, bool)
    solid[1:-1] = _WORD_BYTE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets[offsets <= len(raw)]] = True
    starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | edge[:-1]))
    ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | edge[1:])) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return word_hashes(lower_ascii(raw), starts, ends), starts, ends, rows


def grams(hashes: np.ndarray, k: int = GRAM) -> np.ndarray:
    """Hash of every k words in a row; those of different k don't meet."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n])
    return out


def winnow(values: np.ndarray, window: int = WINDOW) -> list[int]:
    """Places of the least value of each window, the rightmost among equals."""
    if not len(values):
        return []
    kept = set()
    for i in range(max(1, len(values) - window + 1)):
        part = values[i : i + window]
        kept.add(i + len(part) - 1 - int(part[::-1].argmin()))
    return sorted(kept)


class TemplateIndex:
    """Fingerprint to (template, place), as sorted arrays. Long templates have their winnowed trigrams, shorter ones all, very short ones
    all pairs of words too."""

    def __init__(self, templates: dict[str, str]):
        self.names, self.words = list(templates), []
        found = []
        for t, text in enumerate(templates.values()):
            raw = np.frombuffer(text.encode(), np.uint8)
            h = words_of(raw, np.array([0, len(raw)]))[0]
            self.words.append(h.tolist())
            g = grams(h)
            found += [(int(g[i]), t, i) for i in (range(len(g)) if len(h) <= WHOLE else winnow(g))]
            if len(h) <= PAIRS:
                found += [(int(x), t, i) for i, x in enumerate(grams(h, 2))]
        found.sort()
        self.keys = np.array([f[0] for f in found], np.uint64)
        self.template = np.array([f[1] for f in found], np.int64)
        self.place = np.array([f[2] for f in found], np.int64)

    def hits(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in g, template and place in it, for every match."""
        at = np.flatnonzero(np.isin(g, self.keys))
        lo, hi = np.searchsorted(self.keys, g[at], "left"), np.searchsorted(self.keys, g[at], "right")
        which = np.repeat(np.arange(len(at)), hi - lo)
        entry = np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[which]
        return at[which], self.template[entry], self.place[entry]


@lru_cache(4)
def index_of(templates: tuple[tuple[str, str], ...]) -> TemplateIndex:
    return TemplateIndex(dict(templates))


def align(template: list[int], text: list[int], shift: int, band: int) -> tuple[int, int, int]:
    """Best local alignment inside the band |j - i - shift| <= band: matched words, first and last + 1 text word.
    A match counts 2; a replaced, missing or added word costs 1. Among equal scores the earliest end wins."""
    best, none = (0, 0, 0, 0), (0, 0, 0)
    before: dict[int, tuple[int, int, int]] = {}
    for i, word in enumerate(template):
        row: dict[int, tuple[int, int, int]] = {}
        for j in range(max(0, i + shift - band), min(len(text), i + shift + band + 1)):
            score, matched, start = before.get(j - 1, none)
            if score <= 0:
                score, matched, start = 0, 0, j
            cell = (score + 2, matched + 1, start) if word == text[j] else (score - 1, matched, start)
            for s, m, st in (before.get(j, none), row.get(j - 1, none)):
                if s - 1 > cell[0]:
                    cell = (s - 1, m, st)
            if cell[0] > 0:
                row[j] = cell
                if cell[0] > best[0]:
                    best = (cell[0], cell[1], cell[2], j + 1)
        before = row
    return best[1:]


def scan_text(index: TemplateIndex, words: np.ndarray, hits: list[tuple[int, int, int]], coverage: float = COVERAGE) -> list[tuple[int, int, int, int]]:
    """(template, matched words, first word, last + 1) of each occurrence in one text. hits: (template, text place, template place)."""
    out: list[tuple[int, int, int, int]] = []
    tried: dict[int, tuple[int, int]] = {}  # template: last start tried, end of the last span found
    for t, at, place in sorted(hits, key=lambda h: (h[0], h[1] - h[2], h[1])):
        m, start = len(index.words[t]), at - place
        band = BAND + m // 10
        last_start, last_end = tried.get(t, (-(1 << 60), 0))
        if at < last_end or last_end <= last_start and start <= last_start + band:
            continue  # inside a span that was found, or inside the band of one that failed
        lo = max(0, last_end, start - band)
        region = words[lo : max(0, start) + m + 2 * band].tolist()
        matched, first, last = align(index.words[t], region, start - lo, band)
        if matched >= coverage * m:
            out.append((t, matched, lo + first, lo + last))
            tried[t] = start, lo + last
        else:
            tried[t] = start, min(last_end, start)
    return sorted(set(out), key=lambda r: (r[2], r[0]))


SCHEMA = "doc_id long, license string, coverage double, matched_words int, template_words int, first_word int, end_word int, first_byte int, end_byte int"


def scan_documents(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    given = tuple((templates or TEMPLATES).items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of(given)
        for whole in batches:
            for batch in pieces(whole):
                raw, offsets = utf8(batch.column("text"))
                h, starts, ends, rows = words_of(raw, offsets)
                found = []
                for k in (2, GRAM):
                    at, template, place = index.hits(grams(h, k))
                    inside = rows[at] == rows[at + k - 1] if len(at) else np.zeros(0, bool)
                    found.append((at[inside], template[inside], place[inside]))
                at, template, place = map(np.concatenate, zip(*found, strict=True))
                first = np.searchsorted(rows, np.arange(len(offsets)))
                ids, cols = batch.column("doc_id").to_pylist(), [[] for _ in range(9)]
                order = np.argsort(rows[at], kind="stable")
                for row in np.unique(rows[at]).tolist():
                    lo, hi = np.searchsorted(rows[at][order], [row, row + 1])
                    base = int(first[row])
                    own = order[lo:hi]
                    found = scan_text(index, h[base : int(first[row + 1])], list(zip(template[own].tolist(), (at[own] - base).tolist(), place[own].tolist(), strict=True)), coverage)
                    for t, matched, a, b in found:
                        m = len(index.words[t])
                        span = int(starts[base + a] - offsets[row]), int(ends[base + b - 1] - offsets[row])
                        for c, v in zip(cols, (ids[row], index.names[t], matched / m, matched, m, a, b, *span), strict=True):
                            c.append(v)
                types = [pa.int64(), pa.string(), pa.float64(), *[pa.int32()] * 6]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def pieces(batch: pa.RecordBatch, column: str = "text", size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about `size` bytes of text each, one row at least."""
    offsets = utf8(batch.column(column))[1]
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
