"""Licence scans by Dice coefficient over word bigrams.

A window of a document is a run of its words, wherever its lines and
paragraphs end; a window and a template are compared by the Dice coefficient
of their sets of word bigrams, after normalisation (lower case, anything but
letters and digits is a gap).  With ``n`` and ``t`` bigrams, ``k`` of them
shared, the coefficient is ``2 k / (n + t)`` and ``k <= n``: a window that
reaches the threshold holds ``ratio * t`` of the template's bigrams at least
and ``t / ratio`` bigrams at most, ``ratio`` being threshold / (2 - threshold).
Documents without so many of a template's bigrams are not searched for it;
in the others the best windows are found exactly, best first.

Per template the windows of a document are the best one, the best one beside
it, and so on down to the threshold.  Windows of several templates that
overlap are readings of the same words: the one with the most evidence stays
(shared bigrams times coefficient), so that neither a notice inside a whole
licence nor the notice of a sister licence is reported on its own.  A window
that stays has the licence of its nearest template.

Defined cases: null or empty texts and texts of one word match nothing; of
equally near templates the first licence by name counts; per document and
licence the earliest window of the best coefficient is reported, of equally
good windows the earliest and shortest; repeated rows are reported once each;
an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import re
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, ragged_gather, share, shared_value, text_slices, texts_of

THRESHOLD = 0.8
WORD = re.compile(r"[^\W_]+")

#: Public licence notices, by SPDX identifier.  More of them,
#: the standard headers and the complete texts are in TEMPLATE_FILE.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file '
                   "except in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
                   'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT '
                   "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
                   "specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            'associated documentation files (the "Software"), to deal in the Software without restriction, '
            "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
            "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
            "furnished to do so, subject to the following conditions: The above copyright notice and this "
            "permission notice shall be included in all copies or substantial portions of the Software."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the "
                "GNU General Public License as published by the Free Software Foundation, either version 3 of "
                "the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International "
                     "License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International "
                     "License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are "
                     "permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE "
                     "file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of "
                "the MPL was not distributed with this file, You can obtain one at "
                "https://mozilla.org/MPL/2.0/."),
)


TEMPLATE_FILE = "license_templates.jsonl"


def all_templates() -> tuple:
    """The notices above and the templates of the data file."""
    lines = resources.files(__package__).joinpath(TEMPLATE_FILE).read_text(encoding="utf-8").splitlines()
    return TEMPLATES + tuple((r["license"], r["text"]) for r in map(json.loads, lines))


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def bigrams(text: str) -> set[tuple[str, str]]:
    words = words_of(text)
    return set(zip(words, words[1:]))


def dice(a: set, b: set) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0


def units(text: str, templates: tuple = TEMPLATES, threshold: float = THRESHOLD) -> list[tuple[int, int, str]]:
    """(first line, lines, words) of the windows that a scan reports on."""
    return TemplateIndex(templates, threshold).units(text)


class Bigrams:
    """The bigrams of one document by position, and where each stood before."""

    def __init__(self, words: list[str]):
        number: dict = {}
        self.codes = np.array([number.setdefault(b, len(number)) for b in zip(words, words[1:])], dtype=np.int64)
        self.number = number
        order = np.argsort(self.codes, kind="stable")
        again = self.codes[order][1:] == self.codes[order][:-1]
        self.before = np.full(len(order), -1, dtype=np.int64)
        self.before[order[1:][again]] = order[:-1][again]
        self.last = np.ones(len(order), dtype=bool)
        self.last[order[:-1][again]] = False
        self.repeats = np.concatenate([[0], np.cumsum(self.before >= 0)])


class Windows:
    """The best disjoint windows of one document for one template."""

    def __init__(self, doc: Bigrams, shared: np.ndarray, size: int, least: float, most: float, threshold: float):
        self.doc, self.size, self.most, self.threshold = doc, size, most, threshold
        self.at = np.flatnonzero(shared)                # a best window begins and ends at a shared bigram
        self.need = max(1, int(np.ceil(least)))
        self.left = np.cumsum(doc.last[self.at][::-1])[::-1]     # distinct shared ones from here on

    def starts(self) -> np.ndarray:
        """Starts from which enough shared bigrams can lie within the size bound."""
        if len(self.at) < self.need:
            return np.zeros(0, dtype=np.int64)
        first, reach = self.at[:len(self.at) - self.need + 1], self.at[self.need - 1:]
        fewest = reach - first + 1 - (self.doc.repeats[reach + 1] - self.doc.repeats[first])
        return np.flatnonzero((fewest <= self.most) & (self.left[:len(first)] >= self.need))

    def best_from(self, a: int, stop: int) -> tuple[float, int, int]:
        """(coefficient, shared bigrams, last position) of the best window
        from start number ``a`` that ends before position ``stop``."""
        s, limit = self.at[a], int(np.searchsorted(self.at, stop))
        c = 2 * self.need + 8
        while True:
            ends = self.at[a:min(a + c, limit)]
            k = np.cumsum(self.doc.before[ends] < s)
            n = np.cumsum(self.doc.before[s:ends[-1] + 1] < s)[ends - s]
            if a + c >= limit or n[-1] > self.most or k[-1] == self.left[a]:
                break
            c *= 2
        scores = np.where(n <= self.most, 2 * k / (n + self.size), 0.0)
        j = int(scores.argmax())
        return float(scores[j]), int(k[j]), int(ends[j])

    def all(self) -> list[tuple[float, int, int, int]]:
        """(coefficient, shared, first, last position), best first.  A start
        waits under a bound of its coefficient and is worked out when no
        other one can be better."""
        waiting = [(-2 * float(self.left[a]) / (float(self.left[a]) + self.size), int(self.at[a]), int(a), None)
                   for a in self.starts()]
        heapq.heapify(waiting)
        taken: list[tuple[int, int]] = []               # first and last words, disjoint
        out = []
        while waiting:
            score, s, a, hit = heapq.heappop(waiting)
            i = bisect_right(taken, (s, len(self.doc.codes) + 1))
            if i and taken[i - 1][1] >= s:
                continue
            stop = taken[i][0] - 1 if i < len(taken) else len(self.doc.codes)
            if s >= stop:
                continue
            if hit is None or hit[1] >= stop:
                score, k, e = self.best_from(a, stop)
                if score >= self.threshold:
                    heapq.heappush(waiting, (-score, s, a, (k, e)))
                continue
            out.append((-score, hit[0], s, hit[1]))
            insort(taken, (s, hit[1] + 1))
        return out


class TemplateIndex:
    """Templates by bigram, with the sizes that a unit may have for each."""

    def __init__(self, templates, threshold: float = THRESHOLD):
        self.names = [name for name, _ in templates]
        sets = [bigrams(text) for _, text in templates]
        self.sizes = [len(s) for s in sets]
        self.threshold = threshold
        # 2 min(n, t) / (n + t) >= threshold
        ratio = threshold / (2 - threshold)
        self.least = [ratio * t - 1e-9 for t in self.sizes]
        self.most = [t / ratio + 1e-9 if ratio else float("inf") for t in self.sizes]
        self.shortest, self.longest = min(self.least, default=0), max(self.most, default=0)
        self.postings: dict = {}
        for i, s in enumerate(sets):
            for b in s:
                self.postings.setdefault(b, []).append(i)
        # the same postings by number, for many texts at once
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for b in self.postings for w in b}))}
        number, width = self.vocabulary, len(self.vocabulary) + 1
        rows = sorted((number[x] * width + number[y], found) for (x, y), found in self.postings.items())
        self.codes = np.array([c for c, _ in rows], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum([len(found) for _, found in rows])]).astype(np.int64)
        self.listed = np.array([i for _, found in rows for i in found], dtype=np.int64)

    def best(self, text: str) -> tuple[str, float] | None:
        """(licence, coefficient) of the template nearest to a text, if any
        reaches the threshold; of equal ones the first name."""
        # a text of n bigrams has more than n words: cheap bounds before any set is built
        if len(text) < 2 * self.shortest:
            return None
        found = bigrams(text)
        n = len(found)
        if not n or n < self.shortest or n > self.longest:
            return None
        shared: Counter = Counter()
        for b in found:
            if b in self.postings:
                shared.update(i for i in self.postings[b] if self.least[i] <= n <= self.most[i])
        scores = sorted((-2 * k / (n + self.sizes[i]), self.names[i]) for i, k in shared.items())
        return (scores[0][1], -scores[0][0]) if scores and -scores[0][0] >= self.threshold else None

    def candidates(self, texts: list[str]) -> np.ndarray:
        """text x template: whether the text has as many of the template's
        bigrams as any window that reaches the threshold."""
        get, ids, ends = self.vocabulary.get, [], []
        for text in texts:
            ids.append(np.array([get(w, 0) for w in words_of(text)] + [0], dtype=np.int64))
            ends.append(len(ids[-1]))
        ids = np.concatenate(ids)
        at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        codes = ids[at] * (len(self.vocabulary) + 1) + ids[at + 1]
        row = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        known = self.codes[row] == codes if len(self.codes) else np.zeros(len(at), dtype=bool)
        text_no = np.searchsorted(np.cumsum(ends), at[known], side="right")
        text_no, row = np.divmod(np.unique(text_no * len(self.codes) + row[known]), max(1, len(self.codes)))
        lengths = self.first[row + 1] - self.first[row]
        cells = np.repeat(text_no, lengths) * len(self.names) + ragged_gather(self.listed, self.first[row], lengths)
        counts = np.bincount(cells, minlength=len(texts) * len(self.names)).reshape(len(texts), len(self.names))
        return (counts > 0) & (counts >= np.array(self.least))

    def windows(self, words: list[str], asked: np.ndarray) -> list[tuple[int, int]]:
        """(first, last word) of the windows that stay, in their order."""
        doc = Bigrams(words)
        holds = {i: np.zeros(len(doc.number), dtype=bool) for i in np.flatnonzero(asked)}
        for b, number in doc.number.items():
            for i in self.postings.get(b, ()):
                if i in holds:
                    holds[i][number] = True
        found = []
        for i, flags in holds.items():
            for score, k, s, e in Windows(doc, flags[doc.codes], self.sizes[i], self.least[i], self.most[i],
                                          self.threshold).all():
                found.append((-k * score, s, e + 1))
        kept: list[tuple[int, int]] = []
        for _, s, e in sorted(found):
            i = bisect_left(kept, (s, s))
            if (i == 0 or kept[i - 1][1] < s) and (i == len(kept) or kept[i][0] > e):
                kept.insert(i, (s, e))
        return kept

    def units(self, text: str, asked: np.ndarray | None = None) -> list[tuple[int, int, str]]:
        """(first line, lines, words) of the windows that stay."""
        asked = self.candidates([text])[0] if asked is None else asked
        if not asked.any():
            return []
        words = words_of(text)
        ends = np.cumsum([len(words_of(line)) for line in text.split("\n")])
        out = []
        for s, e in self.windows(words, asked):
            first, last = np.searchsorted(ends, [s, e], side="right").tolist()
            out.append((first, last - first + 1, " ".join(words[s:e + 1])))
        return out

    def scan(self, text: str, asked: np.ndarray | None = None) -> list[tuple[str, float, int, int]]:
        """(licence, coefficient, first line, lines) of a document."""
        found: dict[str, tuple[float, int, int]] = {}
        for first, n, unit in self.units(text, asked):
            hit = self.best(unit)
            if hit and (hit[0] not in found or hit[1] > found[hit[0]][0]):
                found[hit[0]] = (hit[1], first, n)
        return [(name, *rest) for name, rest in sorted(found.items())]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  templates: tuple | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, license, dice, first_line, n_lines): one row per document row
    and licence found in it.  The templates are a fixed list, all of this
    module and its data file unless others are given."""
    shared = share(docs.sparkSession, TemplateIndex(all_templates() if templates is None else templates, threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared_value(shared)
        for part in text_slices(batches):
            texts = texts_of(part)
            asked = index.candidates(texts)
            ids = part.column(0).to_pylist()
            rows = [(ids[i], *hit) for i in np.flatnonzero(asked.any(axis=1)) for hit in index.scan(texts[i], asked[i])]
            if rows:
                kinds = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                    ["doc_id", "license", "dice", "first_line", "n_lines"])

    return id_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, license string, dice double, first_line int, n_lines int")
