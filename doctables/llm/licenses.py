"""License notices and texts in documents, by patience alignment with templates.

Words that occur once in the text and once in the template are anchors. The longest increasing run
of anchors is kept, and the gaps between them are aligned in the same way, after equal words at
their edges are taken off. The share of the template's words that find a partner is the coverage.

A stretch is aligned wherever it has enough of a template's words to reach the least coverage, so no
single word decides whether a text is looked at.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctables.llm.common import whole_text

LEAST_COVERAGE = 0.8
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")

# Name, words that must find a partner, and the wording. A name can have several
# wordings. The words are those that tell short notices, or versions of one text, from each other; for
# the other long texts coverage alone decides.
TEMPLATES = (
    ("MIT", "license mit", "released under the MIT License"),
    ("MIT", "license mit", "licensed under the MIT License"),
    (
        "MIT",
        "",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    ("Apache-2.0", "apache license 2.0", "licensed under the Apache License, Version 2.0"),
    (
        "Apache-2.0",
        "",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License.",
    ),
    ("GPL-3.0", "gnu public 3", "this work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "gnu public 2", "this work is licensed under the GNU General Public License, version 2"),
    (
        "GPL-3.0",
        "3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version.",
    ),
    ("LGPL-3.0", "lesser gnu 3", "licensed under the GNU Lesser General Public License, version 3"),
    ("CC-BY-4.0", "cc by 4.0", "licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "cc by-sa 4.0", "licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "cc by-nc 4.0", "licensed under CC BY-NC 4.0"),
    ("MPL-2.0", "mozilla 2.0", "this source code form is subject to the terms of the Mozilla Public License, v. 2.0"),
    (
        "BSD",
        "",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution.",
    ),
    (
        "ISC",
        "",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("Unlicense", "unencumbered domain", "This is free and unencumbered software released into the public domain."),
)


def words_of(text: str) -> list[str]:
    """Lower-case words without signs at their edges; signs alone stay as empty words, so positions
    are those of the text's words."""
    return [_EDGES.sub("", w) for w in text.lower().split()]


@dataclass
class Template:
    name: str
    needed: list[str]
    words: list[str]

    @classmethod
    def of(cls, name: str, needed: str, text: str) -> Template:
        return cls(name, needed.split(), [w for w in words_of(text) if w])


@dataclass
class Found:
    name: str
    start: int
    end: int
    coverage: float
    matched: int = field(compare=False, default=0)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs, sorted by their first part, that also increases in the second, by piles."""
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for i, (_, y) in enumerate(pairs):
        pile = bisect_left(tops, y)
        back.append(ends[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(y)
            ends.append(i)
        else:
            tops[pile], ends[pile] = y, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Partners (position in ``a``, position in ``b``), increasing in both. Empty words match nothing."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {b[j]: j for j in range(b0, b1)}
        anchors = [(i, place[a[i]]) for i in range(a0, a1) if a[i] and once_a[a[i]] == 1 and once_b[a[i]] == 1]
        anchors = _increasing(anchors)
        out += anchors
        if anchors:
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
    return sorted(out)


class Index:
    """The templates' words by number, and how many of each a template has; 0 is any other word."""

    def __init__(self, templates: list[Template], least: float) -> None:
        self.templates = templates
        self.number: dict[str, int] = {}
        for t in templates:
            for w in [*t.words, *t.needed]:
                self.number.setdefault(w, len(self.number) + 1)
        self.counts = np.zeros((len(templates), len(self.number) + 1), dtype=np.int64)
        for row, t in zip(self.counts, templates):
            for w in t.words:
                row[self.number[w]] += 1
        self.needed = [[self.number[w] for w in t.needed] for t in templates]
        # The fewest partners of a notice, and the most words of text over which they can lie.
        self.fewest = np.array([math.ceil(least * len(t.words)) for t in templates], dtype=np.int64)
        self.reach = [int(len(t.words) / least) + 1 for t in templates]

    def windows(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Template and window, such that every notice lies whole in a window of its template."""
        there = np.bincount(ids, minlength=self.counts.shape[1])
        enough = np.minimum(self.counts, there).sum(axis=1) >= np.maximum(self.fewest, 1)
        for k in np.flatnonzero(enough).tolist():
            if not there[self.needed[k]].all():
                continue
            reach, fewest, n = self.reach[k], self.fewest[k], len(ids)
            hit = self.counts[k, ids] > 0
            upto = np.concatenate([[0], np.cumsum(hit)])
            # A notice begins with a partner and has at least the fewest within reach.
            dense = upto[np.minimum(np.arange(n) + reach, n)] - upto[:-1] >= fewest
            step, done = max(1, reach // 10), -1
            for start in np.flatnonzero(dense & hit).tolist():
                if start <= done:
                    continue
                done = start + step
                end = min(n, done + reach)
                inside = np.bincount(ids[start:end], minlength=len(there))
                if np.minimum(inside, self.counts[k]).sum() >= fewest:
                    yield k, start, end


def _filled(pairs: list[tuple[int, int]], fewest: int, least: float) -> list[tuple[int, int]]:
    """The longest run of at least ``fewest`` partners that fills the stretch that it spans; partners
    far from the others are none of its notice."""
    for size in range(len(pairs), max(fewest, 1) - 1, -1):
        for i in range(len(pairs) - size + 1):
            if size >= least * (pairs[i + size - 1][0] + 1 - pairs[i][0]):
                return pairs[i : i + size]
    return []


def scan_text(text: str, templates: list[Template] | Index, least: float = LEAST_COVERAGE) -> list[Found]:
    """Notices of a text: of overlapping ones with one name the one with the most words stays."""
    index = templates if isinstance(templates, Index) else Index(templates, least)
    words = words_of(text)
    number = index.number
    ids = np.fromiter((number.get(w, 0) for w in words), dtype=np.int64, count=len(words))
    found: list[Found] = []
    for k, lo, hi in index.windows(ids):
        t = index.templates[k]
        pairs = _filled(patience(words[lo:hi], t.words), int(index.fewest[k]), least)
        if pairs and {t.words[j] for _, j in pairs}.issuperset(t.needed):
            span = (lo + pairs[0][0], lo + pairs[-1][0] + 1)
            found.append(Found(t.name, *span, round(len(pairs) / len(t.words), 4), len(pairs)))
    found.sort(key=lambda f: (-f.matched, -f.coverage, f.start, f.end))
    kept: list[Found] = []
    for f in found:
        if all(f.name != k.name or f.end <= k.start or f.start >= k.end for k in kept):
            kept.append(f)
    return sorted(kept, key=lambda f: (f.start, f.end, f.name))


def scan(docs: DataFrame, templates: tuple = TEMPLATES, least: float = LEAST_COVERAGE) -> DataFrame:
    """One row per notice: ``doc_id``, ``license``, ``start`` and ``end`` (words), ``coverage``.

    A null or empty text has none. Repeated rows and rows without ``doc_id`` give their rows like
    others; other columns are ignored; an empty table gives no rows.
    """
    known = Index([Template.of(*t) for t in templates], least)
    names = ("license", "start", "end", "coverage")
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("coverage", pa.float64())]))

    @F.arrow_udf("array<struct<license:string,start:int,end:int,coverage:double>>")
    def of(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts:
            found = scan_text(t.as_py(), known, least)
            rows.append([dict(zip(names, (f.name, f.start, f.end, f.coverage))) for f in found])
        return pa.array(rows, kind)

    rows = docs.select("doc_id", F.explode(of.asNondeterministic()(whole_text())).alias("f"))
    return rows.select("doc_id", "f.license", "f.start", "f.end", "f.coverage")
