"""License scans by patience alignment.

A template and a stretch of text are aligned on the words that occur once in both: the longest
increasing subsequence of their places fixes anchors, and the gaps between anchors are aligned the
same way in turn, where more words have become unique; equal ends of a gap match first.

A match needs three things: ``COVERAGE`` of the template's words found a place; these are
``TEXT_COVERAGE`` or more of the words of their stretch; and the words that tell a license from its
kin (name, version, "lesser", "noncommercial") are there, those of its kin not.

Windows of twice the template's length slide over the text once; as a match's stretch is at most
1 / ``TEXT_COVERAGE`` of the template's length, none is too long for a window.  A window in which too
few distinct template words occur is passed by; one whose alignment fails moves on by half the words
it lacks, one that matches to the end of its match.  So a text takes time in proportion to its length.

Defined results: null and empty texts match nothing; rows that repeat give equal rows; whole texts are
read; of matches on overlapping stretches the one with more words stays, then the first template by
name; an empty table gives an empty one; other columns play no part.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, tidied


class Notice(NamedTuple):
    license: str
    text: str
    required: str = ""  # words that must be found
    barred: str = ""  # words that must not stand in the stretch


_KIN = "nc noncommercial sa sharealike nd noderivatives noderivs"
# Notices of public licenses.
NOTICES = (
    Notice("MIT", "Released under the MIT License.", "mit"),
    Notice("MIT", "Licensed under the MIT license.", "mit"),
    Notice("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    Notice("Apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache 2 0"),
    Notice("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.', "apache"),
    Notice("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "", "neither"),
    Notice("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "neither"),
    Notice("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "bsd"),
    Notice("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "waived"),
    Notice("CC-BY-4.0", "Licensed under CC BY 4.0.", "cc by 4 0", _KIN),
    Notice("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "attribution 4 0", _KIN),
    Notice("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", "by sa 4 0", "nc noncommercial"),
    Notice("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "sharealike 4 0", "nc noncommercial"),
    Notice("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", "by nc 4 0", "sa sharealike nd noderivatives"),
    Notice("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "noncommercial 4 0", "sa sharealike nd noderivatives"),
    Notice("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0.", "nc sa 4 0"),
    Notice("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "noncommercial sharealike 4 0"),
    Notice("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "noderivatives 4 0", "nc noncommercial"),
    Notice("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", "gnu general 2", "lesser library affero"),
    Notice("GPL-2.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.", "general 2", "lesser library affero"),
    Notice("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", "gnu general 3", "lesser library affero"),
    Notice("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.", "general 3", "lesser library affero"),
    Notice("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1.", "lesser 2 1"),
    Notice("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3.", "lesser 3"),
    Notice("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3.", "affero 3"),
    Notice("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "mozilla 2 0"),
    Notice("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "unencumbered"),
    Notice("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
)
#: Least share of a template's words that match, and of the stretch's words that do.
COVERAGE, TEXT_COVERAGE = 0.8, 0.6
_WORD = re.compile(r"[a-z0-9]+")


def anchors(a: list[str], b: list[str], a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Places of words that are unique in both ranges, in the longest increasing subsequence."""
    ca, cb = Counter(a[a0:a1]), Counter(b[b0:b1])
    place = {w: j for j, w in enumerate(b[b0:b1], b0) if cb[w] == 1}
    pairs = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if ca[w] == 1 and w in place]
    tails: list[int] = []  # the least last place of an increasing run of each length
    last: list[int] = []  # the pair that has it
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        p = bisect.bisect_left(tails, j)
        tails[p : p + 1] = [j]
        last[p : p + 1] = [k]
        back[k] = last[p - 1] if p else -1
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places of a template's and a stretch's words."""
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        fixed = anchors(a, b, a0, a1, b0, b1)
        if fixed:
            found += fixed
            ends = [(a0 - 1, b0 - 1), *fixed, (a1, b1)]
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(ends, ends[1:])]
    return sorted(found)


class Template:
    def __init__(self, notice: Notice, coverage: float = COVERAGE, text_coverage: float = TEXT_COVERAGE):
        self.name, self.words = notice.license, _WORD.findall(notice.text.lower())
        self.own, self.required, self.barred = frozenset(self.words), frozenset(notice.required.split()), frozenset(notice.barred.split())
        self.need, self.text_coverage = max(1, -int(-coverage * len(self.words) // 1)), text_coverage
        # matched words repeat at most as the template's do
        self.least = max(1, self.need - (len(self.words) - len(self.own)))

    def _stretch(self, pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The pairs without ends that stand far off, while their stretch holds too many other words."""
        a, z = 0, len(pairs)
        while z - a > self.need and z - a < self.text_coverage * (pairs[z - 1][1] - pairs[a][1] + 1):
            if pairs[a + 1][1] - pairs[a][1] >= pairs[z - 1][1] - pairs[z - 2][1]:
                a += 1
            else:
                z -= 1
        return pairs[a:z]

    def matches(self, words: list[str]) -> Iterator[tuple[float, int, int, int]]:
        """(coverage, matched words, first place, last place) in a text's words."""
        hits = [i for i, w in enumerate(words) if w in self.own]
        width, count = 2 * len(self.words), Counter()
        a = z = 0
        while a < len(hits):
            first = hits[a]
            while z < len(hits) and hits[z] < first + width:
                count[words[hits[z]]] += 1
                z += 1
            upto = first + 1
            if len(count) >= self.least:
                pairs = align(self.words, words[first : first + width])
                upto = first + max(1, (self.need - len(pairs)) // 2)
                if len(pairs) >= self.need:
                    pairs = self._stretch(pairs)
                    start, end = first + pairs[0][1], first + pairs[-1][1]
                    inside = words[start : end + 1]
                    matched = {words[first + j] for _, j in pairs}
                    if len(pairs) >= self.text_coverage * len(inside) and self.required <= matched and not self.barred.intersection(inside):
                        yield len(pairs) / len(self.words), len(pairs), start, end
                        upto = end + 1
            while a < len(hits) and hits[a] < upto:
                if a < z:
                    w = words[hits[a]]
                    count[w] -= 1
                    if not count[w]:
                        del count[w]
                a += 1
            z = max(z, a)


def templates(notices: tuple[Notice, ...] = NOTICES, coverage: float = COVERAGE, text_coverage: float = TEXT_COVERAGE) -> list[Template]:
    return [Template(n, coverage, text_coverage) for n in notices]


def scan_text(text: str | None, own: list[Template]) -> list[tuple[str, float, int, int]]:
    """(template, coverage, start, end) of a text's matches by start; positions are code points."""
    low = text.lower() if text else ""
    if len(low) != len(text or ""):
        # a few characters grow in lower case; positions are those of the text
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    have = set(_WORD.findall(low))
    near = [t for t in own if len(have & t.own) >= t.least]
    if not near:
        return []
    spans = [(m.start(), m.end()) for m in _WORD.finditer(low)]
    words = [low[a:b] for a, b in spans]
    found = [(n, t.name, share, spans[i][0], spans[j][1]) for t in near for share, n, i, j in t.matches(words)]
    kept: list[tuple] = []
    starts: list[int] = []  # of those kept, which don't overlap
    for m in sorted(found, key=lambda m: (-m[0], m[1], m[3])):
        k = bisect.bisect(starts, m[3])
        if (not k or kept[k - 1][4] <= m[3]) and (k == len(kept) or m[4] <= kept[k][3]):
            starts.insert(k, m[3])
            kept.insert(k, m)
    return [(name, share, a, b) for _, name, share, a, b in kept]


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", notices: tuple[Notice, ...] = NOTICES, coverage: float = COVERAGE, text_coverage: float = TEXT_COVERAGE) -> DataFrame:
    """key and matches, an array of struct(license, coverage, start, end), of every document."""
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        own = templates(notices, coverage, text_coverage)
        item = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            for a in range(0, b.num_rows, 512):
                part = b.slice(a, 512)
                rows = [[dict(zip(("license", "coverage", "start", "end"), m, strict=True)) for m in scan_text(t, own)] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, item)], names=["k", "matches"])

    plain = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t"))
    return plain.mapInArrow(lambda it: tidied(run(it)), f"k {kind}, matches array<struct<license:string,coverage:double,start:int,end:int>>").withColumnRenamed("k", key)
