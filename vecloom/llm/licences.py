"""Licence scan: normalised text against licence templates by Dice coefficient over word bigrams.

A text is compared as segments: each line, each paragraph (lines up to a blank
one), the whole, and every run of words that is no longer than the template may
match, so a notice is found wherever it lies. A segment and a template are sets of bigrams of lower-case
words; they match from a Dice coefficient of ``threshold`` on. A template of B
bigrams can only match a segment of t/(2-t)*B to (2-t)/t*B, so most templates
fall out by size; segments without a bigram of any template are never counted.
Runs start at a bigram of the template and are counted only if enough of its
bigrams lie within reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.spans import ALNUM, hash_spans, lowered, mix, text_slices, word_spans

#: Licence templates: fixed values.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
        "or promote products derived from this software without specific prior written permission.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
}

#: Cells of a table of runs by bigrams that are counted at once.
WINDOW_CELLS = 1_000_000
_U = np.uint64


def _bigrams(words: np.ndarray) -> np.ndarray:
    return mix(words[:-1] * _U(0x9E3779B97F4A7C15) ^ words[1:])


def compiled(templates: dict[str, list[str]]) -> list[tuple[str, np.ndarray, int]]:
    """Name, sorted distinct bigrams and number of bigrams of every template that has any."""
    out = []
    for name, texts in templates.items():
        for text in texts:
            raw = np.frombuffer(text.encode(), np.uint8)
            low = lowered(raw)
            start, stop, _ = word_spans(low, np.array([len(low)]), ALNUM)
            if len(start) > 1:
                out.append((name, np.unique(_bigrams(hash_spans(low, start, stop))), len(start) - 1))
    return out


def _segments(low: np.ndarray, ends: np.ndarray, start: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """Number of the line, the paragraph and the text of each word; unlike numbers for unlike texts."""
    newline = np.flatnonzero(low == 10)
    line = np.searchsorted(newline, start)
    ink = np.concatenate([[0], np.cumsum(ALNUM[low])])
    at = np.concatenate([[0], newline])
    blank = ink[newline] == ink[at[:-1]] if len(newline) else np.empty(0, bool)
    paragraph = np.searchsorted(newline[blank], start)
    return [line * (len(ends) + 1) + doc, paragraph * (len(ends) + 1) + doc, doc]


def _windows(grams: np.ndarray, doc: np.ndarray, known: np.ndarray, templates: list[tuple[str, np.ndarray, int]], threshold: float) -> Iterator[tuple[int, str, float]]:
    """Text, licence and best Dice coefficient of the runs of words that start at a bigram of a template.

    ``known`` are the positions of bigrams of any template. A run that does not
    start and end with a bigram of its template is never better than one that does.
    """
    before = None
    for name, other, length in templates:
        at = known[np.isin(grams[known], other)]
        end = np.minimum(at + int(length * (2 - threshold) / threshold + 1e-9), np.searchsorted(doc, doc[at], side="right") - 1)
        near = np.searchsorted(at, end) - np.arange(len(at))
        chosen = near >= max(1, len(other) * threshold / (2 - threshold) - 1e-9)
        if not chosen.any():
            continue
        if before is None:  # where each bigram last occurred
            order = np.argsort(grams, kind="stable")
            before = np.full(len(grams), -1)
            same = grams[order[1:]] == grams[order[:-1]]
            before[order[1:][same]] = order[:-1][same]
        hit = np.zeros(len(grams), dtype=bool)
        hit[at] = True
        starts, ends = at[chosen], end[chosen]
        reach = np.arange((ends - starts).max())
        block = max(1, WINDOW_CELLS // len(reach))
        for k in range(0, len(starts), block):
            a = starts[k : k + block, None]
            q = a + reach
            inside = q < ends[k : k + block, None]
            q = np.minimum(q, len(grams) - 1)
            new = inside & (before[q] < a)
            dice = 2 * np.cumsum(new & hit[q], axis=1) / (np.cumsum(new, axis=1) + len(other))
            best = dice.max(axis=1)
            for i in np.flatnonzero(best >= threshold).tolist():
                yield int(doc[a[i, 0]]), name, float(best[i])


def _scan(templates: list[tuple[str, np.ndarray, int]], threshold: float):
    vocabulary = np.unique(np.concatenate([b for _, b, _ in templates]))
    quick = np.zeros(1 << 16, dtype=bool)
    quick[(vocabulary & _U(0xFFFF)).astype(np.int64)] = True
    sizes = np.array([len(b) for _, b, _ in templates])

    def matches(low: np.ndarray, ends: np.ndarray) -> dict[int, dict[str, float]]:
        out: dict[int, dict[str, float]] = {}
        start, stop, doc = word_spans(low, ends, ALNUM)
        if len(start) < 2:
            return out
        grams = _bigrams(hash_spans(low, start, stop))
        maybe = quick[(grams & _U(0xFFFF)).astype(np.int64)]
        known = np.zeros(len(grams), dtype=bool)
        known[maybe] = np.isin(grams[maybe], vocabulary)
        for segment in _segments(low, ends, start, doc):
            inside = segment[:-1] == segment[1:]
            hit = np.unique(segment[:-1][known & inside])
            if not len(hit):
                continue
            rows = np.flatnonzero(inside & np.isin(segment[:-1], hit))
            order = rows[np.argsort(segment[rows], kind="stable")]
            cuts = np.searchsorted(segment[order], hit)
            for k, (a, b) in enumerate(zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True)):
                own = np.unique(grams[order[a:b]])
                for t in np.flatnonzero((len(own) * (2 - threshold) >= sizes * threshold) & (len(own) * threshold <= sizes * (2 - threshold))).tolist():
                    name, other, _ = templates[t]
                    dice = 2 * len(np.intersect1d(own, other, assume_unique=True)) / (len(own) + len(other))
                    if dice >= threshold:
                        best = out.setdefault(int(doc[order[a]]), {})
                        best[name] = max(best.get(name, 0.0), dice)
        within = np.flatnonzero(known & (doc[:-1] == doc[1:]))
        for d, name, dice in _windows(grams, doc, within, templates, threshold):
            best = out.setdefault(d, {})
            best[name] = max(best.get(name, 0.0), dice)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for i, _, data, ends in text_slices(batch.column(1)):
                for d, best in matches(lowered(data), ends).items():
                    found[i + d] = [{"licence": name, "dice": dice} for name, dice in sorted(best.items())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.struct([("licence", pa.string()), ("dice", pa.float64())])))], names=["id", "licences"])

    return run


def find_licences(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """id and licences (array of licence, dice: its best; by name) of every row.

    Null and empty texts and texts of one word have none. Repeated rows each get
    the full answer; texts are scanned whole, however long. An empty table gives
    an empty result. Other columns are ignored, whatever their names. No row moves.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    made = rows.mapInArrow(_scan(compiled(templates or TEMPLATES), threshold), f"id {dict(rows.dtypes)['id']}, licences array<struct<licence:string,dice:double>>")
    return made.withColumnRenamed("id", id_col)
