"""License scans by patience alignment of texts with license templates.

A template and a text are words, lower-cased letters and digits. Regions of a text that may hold a template are
found by its rarer words; in a region, words that occur once in both are anchors, the longest
subsequence of anchors that rises in both is kept, and the gaps between its neighbours are
aligned in the same way; at a gap without anchors, equal words at its two ends are aligned.
Coverage is the share of the template's words that are aligned; regions of at least
`min_coverage` are hits. A hit has its template's name only if the words that tell it from its relatives are aligned and
none of theirs is in it; otherwise it has the name of the family. Of hits that overlap, that with the most aligned words, less a quarter of
the words between them, stays, then that of most coverage.

A text is no candidate for a template only if it lacks so many of its words that the coverage
can't be reached, so nothing is missed by leaving it out. A hit's words lie within two lengths of its template; copies side by side are each found
if each lies within one length, or nearly. Texts stay in their partitions; nothing shuffles.

Defined results: null and empty texts have no hits; texts of any length are searched whole, each place of
a repeated license being a hit; repeated rows are searched alike; an empty table gives an empty result;
`scan` keeps all columns and replaces one named as its result.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructType


MIN_COVERAGE = 0.8
WORD = re.compile(r"[^\W_]+")

#: Grants and notices of public licenses.
TEMPLATES = {
    "MIT-short": "Released under the MIT License.",
    "Apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-short": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

#: Relatives that differ in a few words.
for _short, _name, _version, _digits in (("GPL-2.0", "General", "2", "2"), ("LGPL-3.0", "Lesser General", "3", "3"), ("LGPL-2.1", "Lesser General", "2.1", "2.1"), ("AGPL-3.0", "Affero General", "3", "3")):
    TEMPLATES[f"{_short}-short"] = TEMPLATES["GPL-3.0-short"].replace("General", _name).replace("version 3", f"version {_version}")
    TEMPLATES[_short] = TEMPLATES["GPL-3.0"].replace("General", _name).replace("version 3", f"version {_digits}")
TEMPLATES["BSD-3-Clause"] = TEMPLATES["BSD-2-Clause"] + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
for _kind, _name in {"NC": "NonCommercial", "ND": "NoDerivatives", "NC-SA": "NonCommercial-ShareAlike", "NC-ND": "NonCommercial-NoDerivatives"}.items():
    TEMPLATES[f"CC-BY-{_kind}-4.0"] = TEMPLATES["CC-BY-4.0"].replace("Attribution", f"Attribution-{_name}")
for _kind in ("BY", "BY-SA", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
    TEMPLATES[f"CC-{_kind}-4.0-short"] = f"Licensed under CC {_kind} 4.0."

#: Words that tell relatives apart, by family, and how many words after a hit they may follow.
RELATIVES = {"GPL": ({"lesser", "affero", "library"}, 0), "CC": ({"noncommercial", "noderivatives", "noderivs", "sharealike", "nc", "nd", "sa"}, 0), "BSD": ({"neither"}, 8), "Apache": (set(), 0), "MPL": (set(), 0)}
#: Words of versions, each of which must be aligned.
VERSION = re.compile(r"(?:version|v|International|CC BY[A-Z-]*)[. ]+(\d+(?:\.\d+)?)|(\d+\.\d+) International", re.IGNORECASE)


def family(name: str) -> str | None:
    return next((f for f in RELATIVES if f in name.split("-")[0]), None)


def told(own: list[str], text: str, name: str) -> set[int]:
    """Places of a template's words that tell it from its relatives."""
    if family(name) is None or name not in TEMPLATES or TEMPLATES[name] != text:
        return set()
    places = {i for i, w in enumerate(own) if w in RELATIVES[family(name)][0]}
    if m := VERSION.search(text):
        k = 1 if m[1] else 2
        first = len(words(text[: m.start(k)]))
        places |= set(range(first, first + len(words(m[k]))))
    return places


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence, of pairs sorted by their first number, whose second number rises: by patience piles."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, (_, b) in enumerate(pairs):
        pile = bisect_left(tops, b)
        if pile == len(tops):
            tops.append(b)
            at.append(i)
        else:
            tops[pile] = b
            at[pile] = i
        back.append(at[pile - 1] if pile else -1)
    found, i = [], at[-1] if at else -1
    while i >= 0:
        found.append(pairs[i])
        i = back[i]
    return found[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of equal words in a and b, rising in both."""
    found, gaps = [], [(0, len(a), 0, len(b))]
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
        place = {w: i for i, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = rising([(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in place])
        if not anchors:
            continue
        found += anchors
        x, y = a0, b0
        for i, j in [*anchors, (a1, b1)]:
            gaps.append((x, i, y, j))
            x, y = i + 1, j + 1
    return sorted(found)


def score(pairs: list[tuple[int, int]]) -> float:
    """Pairs less a quarter of the words of the text that lie between them."""
    return len(pairs) - (pairs[-1][1] - pairs[0][1] + 1 - len(pairs)) / 4 if pairs else 0.0


def trimmed(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The run of pairs of the highest score."""
    best, total, first = (0.0, 0, 0), 0.0, 0
    for k, (_, at) in enumerate(pairs):
        total -= (at - pairs[k - 1][1] - 1) / 4 if k else 0
        if total <= 0:
            total, first = 0.0, k
        total += 1
        best = max(best, (total, k + 1, first), key=lambda b: b[0])
    return pairs[best[2] : best[1]]


class Scanner:
    """Finds templates in texts."""

    #: Words too common to start a region.
    COMMON = frozenset("a an and any as at be by for from in is it of on or that the this to with without you".split())

    def __init__(self, templates: tuple[tuple[str, str], ...], min_coverage: float):
        self.min_coverage = min_coverage
        self.parts = []
        for name, text in templates:
            own = words(text)
            counts = Counter(own)
            rare = {w for w in own if w not in self.COMMON}
            self.parts.append((name, own, counts, rare, told(own, text, name), family(name) if TEMPLATES.get(name) == text else None))

    def _regions(self, places: list[int], size: int) -> Iterator[tuple[int, int]]:
        """Spans of a text around rare words that are at most a template's length apart."""
        start = end = None
        for at in places:
            if start is None:
                start = end = at
            elif at - end > size:
                yield start, end
                start = end = at
            else:
                end = at
        if start is not None:
            yield start, end

    def hits(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """License, first character, end character and coverage of each hit."""
        text = text or ""
        spans = [(m.group().lower(), m.start(), m.end()) for m in WORD.finditer(text)]
        have = {w for w, _, _ in spans}
        hits: list[tuple[float, bool, float, int, int, str]] = []
        for name, own, counts, rare, must, kin in self.parts:
            if sum(n for w, n in counts.items() if w in have) < self.min_coverage * len(own):
                continue
            places = [i for i, (w, _, _) in enumerate(spans) if w in rare]
            for first, last in self._regions(places, len(own)):
                for a, b, places in self._within(spans, own, max(0, first - len(own)), min(len(spans), last + len(own) + 1)):
                    doubt = not must <= places or self._strange(spans, own, kin, a, b)
                    hits.append(((b - a + 1 - 5 * len(places)) / 4, doubt, -len(places) / len(own), a, b, f"{kin}-family" if doubt else name))
        kept: list[tuple[int, int, str, float]] = []
        for _, _, coverage, a, b, name in sorted(hits):
            before = bisect_right(kept, (b, len(spans)))  # kept hits are apart, so only the last one that starts by b can overlap
            if not before or kept[before - 1][1] < a:
                kept.insert(before, (a, b, name, -coverage))
        return [(name, spans[a][1], spans[b][2], coverage) for a, b, name, coverage in kept]

    def _strange(self, spans: list[tuple[str, int, int]], own: list[str], kin: str | None, a: int, b: int) -> bool:
        """Whether a hit holds, or is closely followed by, a word of a relative that its template lacks."""
        if kin is None:
            return False
        apart, after = RELATIVES[kin]
        return any(w in apart and w not in own for w, _, _ in spans[a : b + 1 + after])

    def _within(self, spans: list[tuple[str, int, int]], own: list[str], start: int, stop: int) -> list[tuple[int, int, set[int]]]:
        """First and last word of each hit in a region, and which words of the template are aligned.

        Windows are twice the template and move by half of it; one that hits is aligned once
        more from the hit on, in case it cut the hit's end off. In a window that holds two copies no word may be unique, so
        that windows of one template are aligned where none hits, and where there is room for a copy before the hit.
        """
        size, found, at, text = len(own), [], start, [w for w, _, _ in spans[start:stop]]
        need = self.min_coverage * size

        while at < stop:
            here = at - start
            pairs = align(own, text[here : here + 2 * size])
            if hit := len(pairs) >= need:
                again = align(own, text[here : here + pairs[0][1] + 2 * size])
                pairs = self._tight(own, text, here, max(pairs, again, key=len))
            room = pairs[0][1] - here - int(need) if hit else max(1, size // 2) - 1
            if close := self._close(own, text, here, here + room + 1):
                pairs = self._tight(own, text, *close)
            elif not hit:
                at += max(1, size // 2)
                continue
            found.append((start + pairs[0][1], start + pairs[-1][1], {i for i, _ in pairs}))
            at = max(at, start + pairs[-1][1]) + 1
        return [f for f in found if len(f[2]) >= need]

    def _tight(self, own: list[str], text: list[str], place: int, pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Pairs without ends that lie far off, and aligned once more where the whole template should be by either end; places are of the text."""
        whole = [(i, place + j) for i, j in pairs]
        found = [trimmed(whole)]
        for i, j in (found[0][0], found[0][-1]):
            at = max(0, j - i)
            found.append(trimmed([(k, at + m) for k, m in align(own, text[at : j + len(own) - i])]))
        best = max(found, key=score)
        return best if len(best) >= self.min_coverage * len(own) else whole

    def _close(self, own: list[str], text: list[str], start: int, stop: int) -> tuple[int, list[tuple[int, int]]] | None:
        """Where a window of one template that starts in a span hits, and its pairs: the best one of those that overlap the first."""
        size, need, stop = len(own), self.min_coverage * len(own), min(stop, len(text))
        if stop <= start or (Counter(text[start : stop + size - 1]) & Counter(own)).total() < need:
            return None
        early, best, last = set(own[: size - int(need) + 1]), None, stop
        at = start
        while at < last:
            if text[at] in early:
                pairs = align(own, text[at : at + size])
                if len(pairs) >= need and (best is None or score(pairs) > score(best[1])):
                    if best is None:
                        last = min(stop + size // 2, len(text), at + size - int(need) + 1)
                    best = at, pairs
            at += 1
        return best


@functools.lru_cache(maxsize=4)
def scanner(templates: tuple[tuple[str, str], ...], min_coverage: float) -> Scanner:
    return Scanner(templates, min_coverage)


def scan(docs: DataFrame, text_col: str = "text", hits_col: str = "licenses", templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Add an array of hits: license, start, end (code points, end exclusive), coverage."""
    listed = tuple((templates or TEMPLATES).items())
    hit = StructType().add("license", StringType()).add("start", LongType()).add("end", LongType()).add("coverage", DoubleType())
    kind = pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())])

    @F.arrow_udf(ArrayType(hit))
    def found(texts: pa.Array) -> pa.Array:
        use = scanner(listed, min_coverage)
        return pa.array([[dict(zip(("license", "start", "end", "coverage"), h, strict=True)) for h in use.hits(t.as_py())] for t in texts], pa.list_(kind))

    return docs.withColumn(hits_col, found(F.col(f"`{text_col}`")))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id, n_hits, best license, its coverage, and all hits as license:start:end."""
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    out = scan(rows, "_text", "_hits", **options).select("_id", "_hits")
    best = F.array_max(F.transform("_hits", lambda h: F.struct(h.coverage.alias("c"), (h.end - h.start).alias("n"), h.license.alias("l"))))
    names = F.array_join(F.transform("_hits", lambda h: F.concat_ws(":", h.license, h.start.cast("string"), h.end.cast("string"))), ",")
    return out.select(F.col("_id").alias(id_col), F.size("_hits").cast("long").alias("n_hits"), best.l.alias("license"), F.round(best.c, 6).alias("coverage"), names.alias("hits"))
