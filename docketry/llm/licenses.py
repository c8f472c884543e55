"""License scans: notices are aligned with texts by patience alignment.

Words that are unique in a window of the text and in the notice anchor the alignment; the
longest increasing run of anchors is kept and the gaps between them are aligned in the
same way. The share of the notice's words that are aligned is its coverage.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.textbytes import blocks, prefix_sums, range_hashes, token_bounds

WORD = re.compile(r"[A-Za-z0-9\u0080-\U0010ffff]+")


@dataclass(frozen=True)
class Notice:
    """``keys`` are the words that tell the license; all of them have to be aligned."""

    license: str
    keys: str
    text: str


@dataclass(frozen=True)
class Scan:
    coverage: float = 0.8


# Public license notices.
NOTICES = (
    Notice("MIT", "mit license", "Released under the MIT License."),
    Notice("MIT", "mit license", "This project is licensed under the terms of the MIT license."),
    Notice("MIT", "permission granted charge sublicense", (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT '
        "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    )),
    Notice("Apache-2.0", "apache license 2 0", "Licensed under the Apache License, Version 2.0."),
    Notice("Apache-2.0", "apache license 2 0", (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
        "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express '
        "or implied. See the License for the specific language governing permissions and limitations under the License."
    )),
    Notice("GPL-2.0", "gnu general public license 2", "This work is licensed under the GNU General Public License, version 2."),
    Notice("GPL-3.0", "gnu general public license 3", "This work is licensed under the GNU General Public License, version 3."),
    Notice("GPL-2.0-or-later", "gnu general public license 2 later", (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    )),
    Notice("GPL-3.0-or-later", "gnu general public license 3 later", (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    )),
    Notice("LGPL-2.1-or-later", "gnu lesser general public license", (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
        "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    )),
    Notice("MPL-2.0", "mozilla public license 2 0", (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/."
    )),
    Notice("BSD-3-Clause", "redistribution binary endorse promote", (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    )),
    Notice("BSD-2-Clause", "redistribution binary retain reproduce", (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    )),
    Notice("ISC", "permission purpose fee granted", (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    )),
    Notice("CC-BY-4.0", "creative commons attribution 4 0 international", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    Notice("CC-BY-4.0", "cc by 4 0", "Licensed under CC BY 4.0."),
    Notice("CC-BY-NC-4.0", "cc by nc 4 0", "Licensed under CC BY-NC 4.0."),
    Notice("CC-BY-SA-4.0", "cc by sa 4 0", "Licensed under CC BY-SA 4.0."),
)


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs that rises in both places; ``pairs`` rise in the first."""
    tails: list[int] = []
    tops: list[int] = []
    back: list[int] = []
    for k, (_, b) in enumerate(pairs):
        at = bisect_left(tails, b)
        back.append(tops[at - 1] if at else -1)
        tails[at:at + 1] = [b]
        tops[at:at + 1] = [k]
    out, k = [], tops[-1] if tops else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int]]:
    """Pairs of places of equal words, rising in both."""
    found: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: k for k, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = _rising([(k, place[w]) for k, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in place])
        found += anchors
        if anchors:
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            gaps += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(edges, edges[1:])]
    return sorted(found)


def notices_in(text: str, notices: Sequence[tuple[str, list[str], frozenset[str]]], share: float) -> list[dict]:
    """Best match of each license: name, coverage and the span of characters."""
    spans = [(m.start(), m.end()) for m in WORD.finditer(text)]
    words = [text[x:y].lower() for x, y in spans]
    places: dict[str, list[int]] = {}
    wanted = frozenset().union(*(keys for _, _, keys in notices)) if notices else frozenset()
    for k, word in enumerate(words):
        if word in wanted:
            places.setdefault(word, []).append(k)
    best: dict[str, dict] = {}
    for name, notice, keys in notices:
        if not all(k in places for k in keys):
            continue
        size, rarest = len(notice), min(keys, key=lambda k: (len(places[k]), k))
        done = -1
        for spot in places[rarest]:
            if spot < done:
                continue
            low, high = max(0, spot - size - size // 4), min(len(words), spot + size + size // 4 + 1)
            pairs = patience(notice, words[low:high])
            aligned = {notice[i] for i, _ in pairs}
            coverage = len(pairs) / size
            if coverage < share or not keys <= aligned:
                continue
            first, last = low + pairs[0][1], low + pairs[-1][1]
            if last - first + 1 > 1.5 * size:
                continue
            done = last
            if name not in best or (coverage, size) > (best[name]["coverage"], best[name]["n_words"]):
                best[name] = {
                    "license": name, "coverage": coverage, "n_words": size, "start": spans[first][0], "stop": spans[last][1],
                }
    kept: list[dict] = []
    for match in sorted(best.values(), key=lambda m: (-m["coverage"], -m["n_words"], m["license"])):
        # A notice inside a better one's words is part of that.
        if all(match["stop"] <= k["start"] or k["stop"] <= match["start"] for k in kept):
            kept.append(match)
    return kept


def _hash(word: str) -> np.uint64:
    data = np.frombuffer(word.encode(), np.uint8)
    return range_hashes(prefix_sums(data), np.array([0]), np.array([len(data)]))[0]


def scan_licenses(
    docs: DataFrame, notices: Sequence[Notice] = NOTICES, scan: Scan = Scan(), id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id and ``matches``, best first (license, coverage, n_words, start, stop).

    Whole texts are scanned; only texts that hold all key words of some notice are
    aligned, which loses nothing, as every match has to align its key words. Null and
    empty texts have no match, repeated rows and null ids are rows like others, an empty
    table gives no rows, other columns are ignored. Of equal coverages the longer notice,
    then the smaller name comes first.
    """
    prepared = [(n.license, words_of(n.text), frozenset(n.keys.split())) for n in notices]
    numbers = {w: i for i, w in enumerate(sorted(frozenset().union(*(k for _, _, k in prepared))))}
    hashes = np.array([_hash(w) for w in numbers], np.uint64)
    order = np.argsort(hashes)
    ranked = hashes[order]
    needs = [np.array([numbers[w] for w in keys]) for _, _, keys in prepared]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            found: list[list[dict]] = []
            for a, b, data, ends in blocks(column):
                data, starts, stops, first = token_bounds(data, ends)
                made = range_hashes(prefix_sums(data), starts, stops)
                at = np.minimum(np.searchsorted(ranked, made), len(ranked) - 1)
                hit = np.flatnonzero(ranked[at] == made)
                row = np.searchsorted(first, hit, "right") - 1
                has = np.zeros((b - a, len(numbers)), bool)
                has[row, order[at[hit]]] = True
                likely = np.zeros(b - a, bool)
                for need in needs:
                    likely |= has[:, need].all(axis=1)
                found += [notices_in(column[a + i].as_py(), prepared, scan.coverage) if x else [] for i, x in enumerate(likely.tolist())]
            kind = pa.list_(pa.struct([
                ("license", pa.string()), ("coverage", pa.float64()), ("n_words", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()),
            ]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "matches"])

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(
        run, f"doc_id {dict(chosen.dtypes)['doc_id']}, "
        "matches array<struct<license:string,coverage:double,n_words:int,start:int,stop:int>>",
    )
