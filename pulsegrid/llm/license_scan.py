"""License scans by patience alignment.

A notice is found by aligning text and template: words that occur once in both are anchors, the longest increasing
subsequence of their places is kept, and the gaps between anchors are aligned in the same way. The share of template words
that are matched is the coverage.

Only stretches around a seed are aligned. If a notice covers a share c of a template, one of any (1 - c) of its words and
one more must be there; the seeds are those that are rarest in the corpus.

Some words decide between licences that are alike otherwise: numbers of versions, and variants (lesser, share-alike, ...).
A template's own ones must all be matched, and a stretch with a variant that the template lacks is another licence.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections import Counter
from bisect import bisect_left
from collections.abc import Iterator, Mapping
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, Shared, Words, pick, table, text_slices, word_hash
from .decontamination import item_words

#: Words of notices that are in wide use; fixed values.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "MIT": (
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL-2.1": (
        "This work is licensed under the GNU Lesser General Public License, version 2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, "
        "either version 2.1 of the License, or (at your option) any later version.",
    ),
    "LGPL-2.0": ("This work is licensed under the GNU Library General Public License, version 2",),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
    ),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC-BY-NC-ND-4.0": ("Licensed under CC BY-NC-ND 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",),
}
#: Words that make another licence of one that is named alike; fixed values.
VARIANTS = frozenset(w.encode() for w in ("lesser", "affero", "attribution", "noncommercial", "nc", "sharealike", "sa", "noderivatives", "noderivs", "nd"))
MIN_COVERAGE = 0.85


def longest_rising(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by the tops of patience piles."""
    tops, top_index, before = [], [], [-1] * len(values)
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        if pile == len(tops):
            tops.append(v)
            top_index.append(i)
        else:
            tops[pile], top_index[pile] = v, i
        before[i] = top_index[pile - 1] if pile else -1
    out, i = [], top_index[-1] if top_index else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Matched places (in a, in b), rising in both. The work list holds gaps, so long texts need no deep recursion."""
    out, gaps = [], [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in place]
        anchors = [anchors[i] for i in longest_rising([j for _, j in anchors])]
        if not anchors:
            continue
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        gaps += [(x + 1, z, y + 1, w) for (x, y), (z, w) in zip(edges[:-1], edges[1:], strict=True)]
    return sorted(out)


def read_templates(path: str) -> dict[str, tuple[str, ...]]:
    """Templates of a JSON file: {name: [text, ...]}. It is read on the driver and has a bound, 4 MB."""
    with open(path, encoding="utf-8") as file:
        raw = file.read((4 << 20) + 1)
    if len(raw) > 4 << 20:
        raise ValueError(f"{path} has more than 4 MB")
    return {name: tuple(texts) for name, texts in json.loads(raw).items()}


def decides(word: bytes) -> bool:
    """Whether a word tells licences of the same wording apart."""
    return word in VARIANTS or word.isdigit()


class Template:
    def __init__(self, name: str, text: str, counts: Mapping[bytes, int], min_coverage: float):
        self.name, self.words = name, item_words(text)
        self.deciding = {self.words.index(w) for w in self.words if decides(w)}
        self.variants = VARIANTS - set(self.words)
        own = Counter(self.words)
        spare, seeds = floor((1 - min_coverage) * len(self.words) + 1e-9), []
        # the words of the seeds are more than may be missing, so that one of them is in any notice
        for w in sorted(own, key=lambda w: (counts.get(w, 0), w)):
            seeds.append(w)
            if sum(own[s] for s in seeds) > spare:
                break
        self.seeds = {w: [i for i, x in enumerate(self.words) if x == w] for w in seeds}
        self.slack = max(3, ceil((1 - min_coverage) * 2 * len(self.words)))

    def find(self, words: list[bytes], places: dict[bytes, list[int]], min_coverage: float) -> Iterator[tuple[float, int, int, str]]:
        """(coverage, first word, end word, name) of the notices around seeds."""
        n, done = len(self.words), -1
        tries = sorted({(p, i) for w, at in self.seeds.items() for p in places.get(w, ()) for i in at})
        for p, i in tries:
            if p < done:
                continue
            if p >= i and words[p - i : p - i + n] == self.words:
                yield 1.0, p - i, p - i + n, self.name
                done = p - i + n
                continue
            slack = self.slack
            while slack >= 0:
                a0 = max(0, done, p - i - slack)
                stretch = words[a0 : p + n - i + slack]
                matched = patience(stretch, self.words)
                if self.fits(stretch, matched, min_coverage):
                    yield len(matched) / n, a0 + matched[0][0], a0 + matched[-1][0] + 1, self.name
                    done = a0 + matched[-1][0] + 1
                    break
                # copies on both sides leave no word that is there once; a narrower stretch holds less of them
                slack = slack // 2 if slack else -1

    def fits(self, stretch: list[bytes], matched: list[tuple[int, int]], min_coverage: float) -> bool:
        """Whether the matched places cover enough of the template, with all words that decide and no others of that kind in between."""
        if not matched or len(matched) < min_coverage * len(self.words) or self.deciding - {j for _, j in matched}:
            return False
        return not self.variants.intersection(stretch[matched[0][0] : matched[-1][0] + 1])


def word_counts(docs: DataFrame, words: list[bytes]) -> dict[bytes, int]:
    """How often each of these words occurs in all texts; one small row for each word and task is shuffled."""
    hashes = np.array([word_hash(w) for w in words], dtype=np.uint64)
    order = np.argsort(hashes)
    known = hashes[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known), dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0)):
                h = Words(data, offsets, ALNUM).hashes
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                total += np.bincount(at[known[at] == h], minlength=len(known))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(known))), pa.array(total)], ["i", "n"])

    rows = docs.select("text").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    return {words[order[r["i"]]]: r["n"] for r in rows}


def scan_licenses(docs: DataFrame, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """License notices in every whole text: doc_id, license, coverage, n_notices, licenses, spans.

    A notice is a stretch that covers min_coverage or more of a template's words (runs of ASCII letters, lower-cased,
    digits and characters beyond ASCII), in order, among them each number and variant word (VARIANTS) of the template where
    it is first there, and no other variant word. Of notices that overlap, the one with most matched words counts.
    license and coverage are those of the best notice (null and 0 without one), licenses the sorted names, spans
    name:start:end in code points. A null or empty text has none. One row for each input row, null and repeated ids
    included; other columns are ignored; an empty table gives no rows. The texts are never shuffled.
    """
    rows = pick(docs, "doc_id", "text")
    flat = [(name, text) for name, texts in templates.items() for text in texts if item_words(text)]
    counts = word_counts(rows, sorted({w for _, text in flat for w in item_words(text)})) if flat else {}
    made = [Template(name, text, counts, min_coverage) for name, text in flat]
    shared = Shared(docs.sparkSession, made)
    names = ["doc_id", "license", "coverage", "n_notices", "licenses", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = shared.value
        seeds = {word_hash(w): w for t in made for w in t.seeds}
        known = np.sort(np.array(list(seeds), dtype=np.uint64))
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1)):
                words = Words(data, offsets, ALNUM)
                found: list[list] = [[] for _ in range(b - a)]
                if len(known) and len(words.hashes):
                    at = np.minimum(np.searchsorted(known, words.hashes), len(known) - 1)
                    hits = np.flatnonzero(known[at] == words.hashes)
                    text = np.searchsorted(words.first, hits, side="right") - 1
                    for t in np.unique(text).tolist():
                        first, end = int(words.first[t]), int(words.first[t + 1])
                        places: dict[bytes, list[int]] = {}
                        for h in hits[text == t].tolist():
                            places.setdefault(words.word(h), []).append(h - first)
                        own = _LazyWords(words, first, end)
                        found[t] = _apart([x for m in made for x in m.find(own, places, min_coverage)])
                out = [_row(words, int(offsets[t]), int(offsets[t + 1]), int(words.first[t]), f) for t, f in enumerate(found)]
                kinds = [pa.string(), pa.float64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))], names)

    return rows.mapInArrow(run, "doc_id long, license string, coverage double, n_notices long, licenses string, spans string")


class _LazyWords:
    """The words of one text, made only where a stretch is looked at."""

    def __init__(self, words: Words, first: int, end: int):
        self.words, self.first, self.n = words, first, end - first

    def __getitem__(self, at: slice) -> list[bytes]:
        return [self.words.word(self.first + i) for i in range(*at.indices(self.n))]


def _apart(found: list) -> list:
    """Of overlapping notices those with the most matched words, in order of place."""
    out: list = []  # in order of place, none over another, so that only neighbours can overlap a new one
    for x in sorted(found, key=lambda x: (-(x[2] - x[1]) * x[0], x[1], x[3])):
        at = bisect_left(out, x[1], key=lambda y: y[1])
        if (at == 0 or out[at - 1][2] <= x[1]) and (at == len(out) or x[2] <= out[at][1]):
            out.insert(at, x)
    return out


def _row(words: Words, start: int, end: int, first: int, found: list) -> tuple:
    if not found:
        return None, 0.0, 0, "", ""
    before = np.concatenate([[0], np.cumsum((words.lowered[start:end] & 0xC0) != 0x80)])
    spans = [f"{name}:{before[words.starts[first + x] - start]}:{before[words.ends[first + y - 1] - start]}" for _, x, y, name in found]
    best = max(found, key=lambda x: (x[0], x[2] - x[1], x[3]))
    return best[3], best[0], len(found), ",".join(sorted({x[3] for x in found})), ",".join(spans)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
