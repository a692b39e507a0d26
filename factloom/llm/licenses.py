"""Licence scans: Dice coefficient over word bigrams between normalised regions of a text and licence templates.

A region is any run of a text's words, whatever its lines.  Size bounds prune:
with x and y bigrams the coefficient is at most 2 min(x, y) / (x + y), so a
template is only compared where enough of its bigrams lie close enough together
for a region of an allowed size, and only with such regions.
"""

from __future__ import annotations

import heapq
import os
import re
from bisect import bisect_right
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts

LEAST = 0.8
_WORD = re.compile(r"\w+")

#: Short licence notices and texts, by the licences' SPDX names.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("all-rights-reserved", "All rights reserved."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software '
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies "
        'or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        'permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES '
        "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS "
        "OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code "
        "must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list "
        "of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version.",
    ),
    (
        "GPL-2.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either "
        "version 2 of the License, or (at your option) any later version.",
    ),
    (
        "LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either "
        "version 2.1 of the License, or (at your option) any later version.",
    ),
    (
        "AGPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version.",
    ),
    (
        "EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    ),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def words(text: str) -> list[str]:
    """Normalised words: lower case, runs of letters, digits and underscores; punctuation and layout make no difference."""
    return _WORD.findall(text.lower())


def bigrams(ws: list[str]) -> Counter:
    return Counter(zip(ws, ws[1:]))


def dice(x: Counter, y: Counter) -> float:
    """2 |x and y| / (|x| + |y|) over bigrams with their repeats; 0 if neither has any."""
    total = x.total() + y.total()
    return 2 * (x & y).total() / total if total else 0.0


class Matcher:
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST):
        self.least = least
        self.templates = [(name, bigrams(words(text))) for name, text in templates]
        self.sizes = [x.total() for _, x in self.templates]
        self.of: dict[tuple[str, str], list[int]] = {}
        for n, (_, grams) in enumerate(self.templates):
            for g in grams:
                self.of.setdefault(g, []).append(n)

    def bounds(self, n: int) -> tuple[float, float]:
        """The sizes of regions that can reach the least coefficient with template n."""
        return self.sizes[n] * self.least / (2 - self.least), self.sizes[n] * (2 - self.least) / self.least

    def clusters(self, at: np.ndarray, n: int) -> list[np.ndarray]:
        """The hits of template n, cut where two are further apart than a region's words without a hit can be; those with too few are left out.

        A region of r bigrams with h hits reaches the coefficient if
        2 h >= least (r + size) and h <= size, so it has r - h <= 2 (1 - least) size / least others at most.
        """
        size = self.sizes[n]
        gap = 2 * (1 - self.least) * size / self.least
        parts = np.split(at, np.flatnonzero(np.diff(at) - 1 > gap + 1e-9) + 1)
        return [p for p in parts if len(p) >= self.bounds(n)[0] - 1e-9]

    def regions(self, at: np.ndarray, grams: list[tuple[str, str]], n: int) -> list[tuple[float, int, int]]:
        """(coefficient, first, last bigram) of regions without a common word among the hits ``at`` of template n.

        The likeliest region is taken (of equal ones the longest, then the
        first), then the likeliest of those disjoint from it, and so on.
        """
        size, template = self.sizes[n], self.templates[n][1]
        low, high = self.bounds(n)
        # a hit counts in a region if fewer than the template's number of equal ones lie before it there
        seen: dict[tuple[str, str], list[int]] = {}
        blocked = np.full(len(at), -1)  # the last start at which it no longer counts
        for i, g in enumerate(grams):
            before = seen.setdefault(g, [])
            if len(before) >= template[g]:
                blocked[i] = before[-template[g]]
            before.append(i)

        def best(start: int, stop: int) -> tuple[float, int, int] | None:
            """The likeliest region that begins with a hit and ends before another."""
            end = min(stop, int(np.searchsorted(at, at[start] + high + 1e-9, "right")))
            hits = np.cumsum(blocked[start:end] < start)
            if not len(hits) or hits[-1] < low - 1e-9:
                return None
            lengths = at[start:end] - at[start] + 1
            dice = 2 * hits / (lengths + size)
            k = len(dice) - 1 - int(np.argmax(dice[::-1]))
            return (-float(dice[k]), -int(lengths[k]), start, start + k) if dice[k] >= self.least else None

        heap = [x for s in range(len(at)) if (x := best(s, len(at)))]
        heapq.heapify(heap)
        taken: list[tuple[int, int]] = []  # sorted, disjoint
        out = []
        while heap:
            d, length, s, e = heapq.heappop(heap)
            k = bisect_right(taken, (s, len(at)))
            if k and at[taken[k - 1][1]] + 1 >= at[s]:  # they would share a word
                continue
            stop = int(np.searchsorted(at, at[taken[k][0]] - 1)) if k < len(taken) else len(at)
            if e >= stop:
                if again := best(s, stop):
                    heapq.heappush(heap, again)
                continue
            taken.insert(k, (s, e))
            out.append((-d, int(at[s]), int(at[e])))
        return out

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """``(licence, coefficient, start, end)`` by start; of overlapping regions the likeliest (then the longest, the first) stays."""
        lowered = text.lower()
        same = len(lowered) == len(text)  # some letters become two in lower case: places are then found word by word
        spans = [m.span() for m in _WORD.finditer(lowered)]
        ws = [lowered[a:b] for a, b in spans]
        of = self.of
        pairs = list(zip(ws, ws[1:]))
        places: dict[int, list[int]] = {}
        for i, g in enumerate(pairs):
            for n in of.get(g, ()):
                places.setdefault(n, []).append(i)
        found: dict[tuple[int, int], tuple[float, int]] = {}
        for n, at in places.items():
            if len(at) < self.bounds(n)[0] - 1e-9:
                continue
            for part in self.clusters(np.array(at), n):
                for d, first, last in self.regions(part, [pairs[i] for i in part.tolist()], n):
                    old = found.get((first, last))
                    if old is None or (-d, n) < (-old[0], old[1]):
                        found[first, last] = (d, n)
        kept: list[tuple[int, int]] = []
        for r in sorted(found, key=lambda r: (-found[r][0], r[0] - r[1], r[0])):
            k = bisect_right(kept, r)
            if (not k or kept[k - 1][1] + 1 < r[0]) and (k == len(kept) or r[1] + 1 < kept[k][0]):
                kept.insert(k, r)

        if not same and kept:
            shift = np.cumsum([0] + [len(c.lower()) for c in text])
            back = lambda i: int(np.searchsorted(shift, i, "right")) - 1
        else:
            back = lambda i: i
        return [(self.templates[found[r][1]][0], found[r][0], back(spans[r[0]][0]), back(spans[r[1] + 1][1] - 1) + 1) for r in kept]


def templates_from(folder: str) -> tuple[tuple[str, str], ...]:
    """Further templates: the files of a folder, each a licence's text under its name."""
    out = []
    for name in sorted(os.listdir(folder)):
        path = os.path.join(folder, name)
        if os.path.isfile(path):
            with open(path, encoding="utf-8", errors="replace") as f:
                out.append((name, f.read()))
    return tuple(out)


def scan_licenses(documents: DataFrame, *, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, licenses array<struct<license,dice,start,end>>`` in code points, by start.

    A null or empty text, or one without a match, has an empty array; texts are
    scanned whole; repeated rows give repeated rows; an empty table gives an
    empty table; other columns are not read.
    """
    held: list[Matcher] = []

    def each(keys, texts):
        if not held:
            held.append(Matcher(templates, least))
        return keys, [[{"license": n, "dice": d, "start": a, "end": b} for n, d, a, b in held[0].scan(t)] for t in texts]

    kind = documents.select(key).schema[0].dataType.simpleString()
    return map_texts(documents, each, f"doc_id {kind}, licenses array<struct<license:string,dice:double,start:int,end:int>>", key=key, text=text)
