"""License scans: winnowed fingerprints pick candidates, banded alignment reports spans.

Words are compared in lower case with punctuation as white space. Of the ``GRAM``-word
hashes of a text, winnowing keeps the least of every ``WINNOW`` in a row, so two texts that
share ``GRAM + WINNOW - 1`` words in a row share a fingerprint. The templates' fingerprints form an
inverted index (hash to template and place), as large as the template set, and go to every task.
A document's fingerprints found in it vote for a template and a diagonal. Of the voted diagonals, each that lies
more than ``BAND / 2`` past the last centre is the next one, so every vote is well inside a band. The template is aligned with the
stretch of the document in a band of ``BAND`` words to either side of the centre, with free ends; after a
hit, what is left of the stretch is aligned again until nothing reaches the least coverage. Coverage is the share of template words
matched in order; spans are code points of the document, from the first matched word to the last.

A result row is a document and license with coverage of ``LEAST_COVERAGE`` or more: the best
coverage and the spans of all its occurrences, of which overlapping ones count once.

Defined results: null or empty text has no rows; a text without license none; repeated rows give
repeated results; an empty table gives an empty one; other columns are ignored. Where templates
share words, each template that is covered is reported.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framefold.llm.scratch import table
from framefold.llm.words import _LOWER, Words, slices, windows

GRAM = 3
WINNOW = 3
BAND = 8
LEAST_COVERAGE = 0.8
GAP = 0.5

#: License notices by SPDX name. A caller may pass others.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    "MIT": "Released under the MIT License",
    "MIT text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0 notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}

_PLAIN = _LOWER.copy()
_PLAIN[[c for c in range(128) if not chr(c).isalnum()]] = 32


def fingerprints(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of the winnowed word grams of every text of the slice."""
    g = windows(w.hashes(), GRAM)
    n = len(g) - WINNOW + 1
    whole = np.flatnonzero(w.room()[:len(g)] >= GRAM)
    if n <= 0:
        return g[whole], whole
    least = np.arange(n)
    for k in range(1, WINNOW):
        least = np.where(g[np.arange(n) + k] < g[least], np.arange(n) + k, least)
    inside = w.room()[:n] >= GRAM + WINNOW - 1
    short = whole[w.counts[w.doc[whole]] < GRAM + WINNOW - 1]  # texts with fewer grams than a winnowing window keep all
    at = np.unique(np.concatenate([least[inside], short]))
    return g[at], at


class Index:
    """Inverted index of the templates' fingerprints; templates too short for a winnowing window keep all grams."""

    def __init__(self, templates: dict[str, str]):
        self.names = list(templates)
        self.words: list[np.ndarray] = []
        grams, at, of = [], [], []
        for i, text in enumerate(templates.values()):
            for _, _, w in slices(pa.array([text]), translate=_PLAIN):
                self.words.append(w.hashes())
                g, place = (windows(w.hashes(), GRAM), np.arange(max(0, len(w) - GRAM + 1))) if len(w) < GRAM + WINNOW - 1 else fingerprints(w)
                grams.append(g)
                at.append(place)
                of.append(np.full(len(g), i))
        self.gram, self.at, self.of = map(np.concatenate, (grams, at, of))
        order = np.argsort(self.gram, kind="stable")
        self.gram, self.at, self.of = self.gram[order], self.at[order], self.of[order]

    def votes(self, gram: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(template, diagonal) of every pair of equal grams."""
        lo, hi = np.searchsorted(self.gram, gram, "left"), np.searchsorted(self.gram, gram, "right")
        pick = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi, strict=True)]) if len(gram) else lo
        return self.of[pick], np.repeat(place, hi - lo) - self.at[pick]


@lru_cache(maxsize=4)
def index(templates: tuple[tuple[str, str], ...]) -> Index:
    return Index(dict(templates))


def align(template: np.ndarray, words: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """(matched words, first and last matched word) of the best alignment in the band around ``diagonal``.

    A match scores 1, an unmatched word on either side costs GAP; ends in the document are free.
    """
    m, width = len(template), 2 * BAND + 1
    score = np.zeros((m + 1, width + 1))
    score[0] = 0.0
    slope = np.arange(width + 1) * GAP
    # Cell (i, j): i template words used, the next document word is diagonal - BAND + i + j.
    for i in range(1, m + 1):
        at = diagonal - BAND + i - 1 + np.arange(width)
        same = (at >= 0) & (at < len(words)) & (words[np.clip(at, 0, len(words) - 1)] == template[i - 1])
        row = np.full(width + 1, -1e9)
        row[:width] = np.where(same, score[i - 1, :width] + 1, -1e9)
        row[:-1] = np.maximum(row[:-1], score[i - 1, 1:] - GAP)  # template word without partner
        row = np.maximum(row, np.maximum.accumulate(row + slope) - slope)  # document words without partner
        score[i] = row
    j = int(score[m].argmax())
    i, matched, first, last = m, 0, -1, -1
    while i > 0:
        at = diagonal - BAND + i - 1 + j
        if j < width and 0 <= at < len(words) and words[at] == template[i - 1] and abs(score[i, j] - score[i - 1, j] - 1) < 1e-9:
            matched, first, last = matched + 1, at, at if last < 0 else last
            i -= 1
        elif j < width and abs(score[i, j] - score[i - 1, j + 1] + GAP) < 1e-9:
            i, j = i - 1, j + 1
        else:
            j -= 1
    return matched, first, last


def occurrences(ix: Index, gram: np.ndarray, place: np.ndarray, words: np.ndarray, least: float) -> Iterator[tuple[int, float, int, int]]:
    """(template, coverage, first word, last word) of a text's aligned occurrences."""
    of, diagonal = ix.votes(gram, place)
    for t in np.unique(of).tolist():
        m, taken, last = len(ix.words[t]), [], None
        for centre in np.unique(diagonal[of == t]).tolist():
            if last is not None and centre - last <= BAND // 2:
                continue  # well inside the band of the last centre
            last = centre
            left = [(max(0, centre - BAND), min(len(words), centre + m + BAND))]
            for _, i, j in taken:
                left = [part for a, b in left for part in ((a, min(b, i)), (max(a, j + 1), b)) if part[0] < part[1]]
            while left:  # what a found occurrence leaves of the band is aligned again
                a, b = left.pop()
                if b - a < least * m:
                    continue
                matched, i, j = align(ix.words[t], words[a:b], centre - a)
                if matched and matched >= least * m:
                    taken.append((matched / m, a + i, a + j))
                    left += [(a, a + i), (a + j + 1, b)]
        for coverage, i, j in sorted(taken, key=lambda x: x[1]):
            yield t, coverage, i, j


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, least: float = LEAST_COVERAGE) -> DataFrame:
    """(doc_id, license, coverage, n_spans, spans) of every license found; spans are [start, end) code points."""
    key = tuple((templates or TEMPLATES).items())
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index(key)
        for batch in batches:
            ids = batch.column(0)
            rows: list[tuple] = []
            for lo, _, w in slices(batch.column(1), translate=_PLAIN):
                gram, place = fingerprints(w)
                hit = np.isin(gram, ix.gram)
                gram, place = gram[hit], place[hit]
                doc = w.doc[place]
                h = w.hashes() if len(place) else None
                for d in np.unique(doc).tolist():
                    a, b = w.bounds[d], w.bounds[d + 1]
                    found: dict[int, list] = {}
                    for t, coverage, first, last in occurrences(ix, gram[doc == d], place[doc == d] - a, h[a:b], least):
                        found.setdefault(t, []).append((coverage, first, last))
                    if found:
                        raw = batch.column(1)[lo + d].as_py().encode()
                        point = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
                        spot = lambda x: int(point[x - w.offsets[d]])  # noqa: B023, E731
                        for t, each in found.items():
                            spans = [{"start": spot(w.starts[a + i]), "end": spot(w.ends[a + j])} for _, i, j in each]
                            rows.append((ids[lo + d].as_py(), ix.names[t], max(c for c, *_ in each), len(spans), spans))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([
                pa.array(columns[0], ids.type), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.int64()),
                pa.array(columns[4], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], [doc_id, "license", "coverage", "n_spans", "spans"])

    return (docs.select(doc_id, F.col(text).cast("string").alias("text"))
            .mapInArrow(run, f"{doc_id} {kind}, license string, coverage double, n_spans long, spans array<struct<start:int,end:int>>"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``: doc_id, license, coverage, n_spans, spans of every license found."""
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op2_license_scan": op2_license_scan}
ORACLE: dict[str, str] = {}
