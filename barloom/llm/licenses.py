"""License scans by patience alignment.

Words unique to both a template and a stretch of text are anchors; the longest increasing subsequence of their places
aligns them, and the gaps between are aligned in the same way. The share of the template's words that are aligned is
its coverage.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import slices, table, words

#: Least coverage of a hit, and how many times a template's words the stretch of text may be long.
COVERAGE, STRETCH = 0.8, 1.5
#: License notices and statements. Fixed values.
TEMPLATES = {
    "apache-2.0-statement": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "mit-statement": "Released under the MIT License",
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "gpl-3.0-statement": "This work is licensed under the GNU General Public License, version 3",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "cc-by-nc-4.0-statement": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0-statement": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}
_WORD = re.compile(r"[^\W_]+")


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places (in a, in b) that patience alignment matches, increasing in both."""
    out = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = [(i, where[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in where]
        if not anchors:
            continue
        # longest increasing subsequence of the places in b
        tops: list[int] = []
        at: list[int] = []
        back = [-1] * len(anchors)
        for k, (_, j) in enumerate(anchors):
            p = bisect_left(tops, j)
            back[k] = at[p - 1] if p else -1
            tops[p : p + 1] = [j]
            at[p : p + 1] = [k]
        chain, k = [], at[-1]
        while k >= 0:
            chain.append(anchors[k])
            k = back[k]
        chain.reverse()
        out += chain
        edges = [(a0 - 1, b0 - 1), *chain, (a1, b1)]
        todo += [(x + 1, x2, y + 1, y2) for (x, y), (x2, y2) in zip(edges, edges[1:])]
    return sorted(out)


class Scanner:
    """Templates as words; those without words match nothing."""

    def __init__(self, templates: list[tuple[str, str]], least: float = COVERAGE):
        self.least = least
        self.templates = [(name, w) for name, w in ((name, _WORD.findall((text or "").lower())) for name, text in templates) if w]
        self.number = {w: i for i, w in enumerate(sorted({w for _, t in self.templates for w in t}))}
        self.weight = np.zeros((len(self.number), len(self.templates)), np.float32)
        for k, (_, t) in enumerate(self.templates):
            for w in t:
                self.weight[self.number[w], k] += 1
        self.need = np.array([math.ceil(least * len(t) - 1e-9) for _, t in self.templates], np.float32)

    def possible(self, texts: pa.Array) -> list[tuple[int, int]]:
        """(text, template) where the text has enough of the template's words, in any order: all others can't match."""
        if not self.templates or not len(texts):
            return []
        code, distinct, begin = words(texts)
        ids = [sorted({self.number[x] for x in _WORD.findall(w.lower()) if x in self.number}) for w in distinct]
        count = np.array([len(x) for x in ids] or [0], np.int64)
        doc = np.repeat(np.arange(len(texts)), np.diff(begin))
        has = np.zeros((len(texts), len(self.number)), np.float32)
        hit = np.flatnonzero(count[code]) if len(code) else np.zeros(0, np.int64)
        pairs = np.unique(doc[hit] * max(len(distinct), 1) + code[hit])
        for p in pairs.tolist():
            d, w = divmod(p, max(len(distinct), 1))
            has[d, ids[w]] = 1
        return [tuple(x) for x in np.argwhere(has @ self.weight >= self.need).tolist()]

    def hits(self, text: str, k: int) -> list[tuple[int, int, float]]:
        """(start, end, coverage) in code points of each stretch of the text that covers template k enough."""
        template = self.templates[k][1]
        places = list(_WORD.finditer(text.lower())) if len(text.lower()) == len(text) else list(_WORD.finditer(text))
        found = [m[0].lower() for m in places]
        inside = np.array([w in set(template) for w in found], bool)
        width = math.ceil(len(template) * STRETCH)
        so_far = np.concatenate([[0], np.cumsum(inside)])
        upto = np.minimum(np.arange(len(found)) + width, len(found))
        start = np.flatnonzero(inside & (so_far[upto] - so_far[:-1] >= self.need[k])).tolist()
        out, done = [], 0
        best: tuple | None = None
        for i in start:
            if i < done:
                continue
            if best and i > best[0]:  # past the stretch that was best: it is final
                out.append(best[1:4])
                done, best = best[4], None
                if i < done:
                    continue
            pairs = align(template, found[i : i + width])
            if len(pairs) >= self.need[k] and (best is None or len(pairs) > best[5]):
                last = i + pairs[-1][1]
                best = (last, places[i + pairs[0][1]].start(), places[last].end(), len(pairs) / len(template), last + 1, len(pairs))
        if best:
            out.append(best[1:4])
        return out


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, start, end, coverage): a row for each stretch of a text that covers a template.

    A stretch has at most STRETCH times the template's words and covers at least `least` of them in order; start and
    end in code points. Stretches of one template don't overlap, those of several may. Texts that are null or without
    words give no rows; rows that repeat give repeated rows; a null id is kept; templates without words match nothing.
    """
    known = list((TEMPLATES if templates is None else dict(templates)).items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(known, least)
        for part in slices(batches):
            out = []
            for d, k in scanner.possible(part["text"]):
                out += [(d, scanner.templates[k][0], *hit) for hit in scanner.hits(part["text"][d].as_py(), k)]
            if out:
                c = list(zip(*out))
                yield pa.RecordBatch.from_arrays([part["id"].take(pa.array(c[0], pa.int64())), pa.array(c[1]), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.float64())], ["id", "license", "start", "end", "coverage"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, license string, start long, end long, coverage double").withColumnRenamed("id", id_col)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
