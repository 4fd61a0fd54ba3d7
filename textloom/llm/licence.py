"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

A multinomial logistic regression over sparse word 1- and 2-grams tells licence families apart and has a class for
anything else. It is trained on variants of the templates (words dropped and added, other years and names) and on paragraphs of a bounded
sample of documents (`sample_docs`). Its probabilities are calibrated by a temperature fitted on variants it hasn't seen. A prediction
counts if its probability reaches `min_probability` and the paragraph holds at least `min_overlap` of the 2-grams of one of the family's templates.

Paragraphs are lines, and joins of neighbouring lines up to a blank one or `JOIN_WORDS` words, for notices that are wrapped; a join has the number of its first line
and counts if it is confirmed. A line that is nothing but a licence's title names it. A line that shares no 2-gram with any template isn't scored.

Defined results: null and empty texts have no paragraphs and no families; very long texts are scanned whole; repeated rows are scanned each; an empty table gives no rows;
extra columns are ignored, whatever their names; ties between families go to the first by name.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import map_texts

#: Notices by which licences are declared.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License",
        "This project is licensed under the terms of the Apache 2.0 license",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
        "Released under the BSD 3-Clause License",
    ],
    "CC-BY": ["This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related rights to this work", "Released under CC0 1.0 Universal"],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Licensed under the GPL version 2 or later",
    ],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License, version 2.1", "Licensed under the LGPL version 3"],
    "MIT": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "This project is licensed under the terms of the MIT license",
    ],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "Proprietary": ["All rights reserved", "Unauthorized copying of this file, via any medium, is strictly prohibited"],
}
#: Lines that are a title as a whole, with "the" before it or not.
TITLES = {
    "Apache-2.0": ["Apache License", "Apache License, Version 2.0", "Apache License 2.0"],
    "BSD": ["BSD License", "BSD 2-Clause License", "BSD 3-Clause License", "New BSD License", "Simplified BSD License"],
    "CC0": ["CC0 1.0 Universal"],
    "GPL": ["GNU General Public License", "GNU General Public License, version 2", "GNU General Public License, version 3"],
    "LGPL": ["GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License, version 3"],
    "MIT": ["MIT License"],
    "MPL": ["Mozilla Public License", "Mozilla Public License, version 2.0", "Mozilla Public License 2.0"],
}
FAMILIES = sorted(TEMPLATES)
#: About twice the longest template.
JOIN_WORDS = 64
SAMPLE_DOCS, VARIANTS = 400, 60
MIN_PROBABILITY, MIN_OVERLAP = 0.5, 0.6
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def words_of(line: bytes) -> list[bytes]:
    return line.translate(_FOLD).split()


def grams(words: list[bytes]) -> set:
    return {*words, *zip(words, words[1:])}


class Classifier:
    def __init__(self, others: list[list[bytes]], seed: int = 11):
        rng = random.Random(seed)
        self.templates = {f: [frozenset(zip(w, w[1:])) for w in map(words_of, (t.encode() for t in TEMPLATES[f]))] for f in FAMILIES}
        self.titles = {(*the, *words_of(t.encode())): f for f, ts in TITLES.items() for t in ts for the in ((), (b"the",))}
        self.pairs = frozenset(x for ts in self.templates.values() for t in ts for x in t)
        rows = [(k, self._variant(words_of(t.encode()), others, rng)) for k, f in enumerate(FAMILIES) for t in TEMPLATES[f] for _ in range(VARIANTS)]
        rows += [(len(FAMILIES), w) for w in others]
        # Not quite licences: loose words of the templates.
        pool = sorted({w for f in FAMILIES for t in TEMPLATES[f] for w in words_of(t.encode())})
        rows += [(len(FAMILIES), [rng.choice(pool) for _ in range(rng.randint(1, 12))]) for _ in range(VARIANTS * len(FAMILIES))]
        rng.shuffle(rows)
        self.index = {g: j for j, g in enumerate(sorted({g for f in FAMILIES for t in TEMPLATES[f] for g in grams(words_of(t.encode()))}, key=repr))}
        cut = len(rows) * 4 // 5
        self.weights = self._fit(*self._rows(rows[:cut]))
        columns, starts, y = self._rows(rows[cut:])
        z = np.add.reduceat(self.weights[columns], starts) if len(y) else np.zeros((0, len(FAMILIES) + 1))
        heat = np.geomspace(0.25, 8, 41)
        self.temperature = float(min(heat, key=lambda t: -np.log(self._soft(z / t)[np.arange(len(y)), y] + 1e-12).mean())) if len(y) else 1.0

    @staticmethod
    def _variant(words, others, rng):
        out = [w for w in words if rng.random() > 0.06]
        if others and rng.random() < 0.5:
            extra = rng.choice(others)
            n = rng.randint(0, min(10, len(extra)))
            out = extra[:n] + out if rng.random() < 0.5 else out + extra[:n]
        return out

    def _rows(self, rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sparse rows: the columns of each, one after another, where each begins, and the classes. The last column is 1 in all of them."""
        columns = [sorted({self.index[g] for g in grams(words) if g in self.index}) + [len(self.index)] for _, words in rows]
        sizes = np.array([len(c) for c in columns], np.int64)
        return np.array([j for c in columns for j in c], np.int64), np.cumsum(sizes) - sizes, np.array([k for k, _ in rows], int)

    @staticmethod
    def _soft(z):
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def _fit(self, columns, starts, y, steps=150, rate=0.5, decay=1e-4):
        w = np.zeros((len(self.index) + 1, len(FAMILIES) + 1))
        target = np.eye(len(FAMILIES) + 1)[y]
        row = np.repeat(np.arange(len(y)), np.diff(np.append(starts, len(columns))))
        by_column = np.argsort(columns, kind="stable")
        used, first = np.unique(columns[by_column], return_index=True)
        speed = np.zeros_like(w)
        for _ in range(steps if len(y) else 0):
            off = target - self._soft(np.add.reduceat(w[columns], starts))
            step = np.zeros_like(w)
            step[used] = np.add.reduceat(off[row[by_column]], first) / len(y)
            speed = 0.9 * speed + step - decay * w
            w += rate * speed
        return w

    def predict(self, words: list[bytes]) -> tuple[str | None, float, float]:
        """(family or None for unknown, its probability, overlap with its nearest template)."""
        row = [self.index[g] for g in grams(words) if g in self.index]
        z = self.weights[row].sum(axis=0) + self.weights[-1]
        p = self._soft(z[None] / self.temperature)[0]
        k = int(p.argmax())
        if k == len(FAMILIES):
            return None, float(p[k]), 0.0
        mine = set(zip(words, words[1:]))
        return FAMILIES[k], float(p[k]), max(len(t & mine) / len(t) for t in self.templates[FAMILIES[k]])

    def _joined(self, lines: list[list[bytes]], sure: set[int], min_probability: float, min_overlap: float) -> list[tuple[int, str, float, float]]:
        """The confirmed joins of neighbouring lines: of those from one line, the shortest."""
        out, done = [], -1
        for n, first in enumerate(lines):
            if n <= done or n in sure or self.pairs.isdisjoint(zip(first, first[1:] + (lines[n + 1][:1] if n + 1 < len(lines) else []))):
                continue
            words = list(first)
            for m in range(n + 1, len(lines)):
                if not lines[m] or m in sure or len(words) >= JOIN_WORDS:
                    break
                words += lines[m]
                mine = set(zip(words, words[1:]))
                if not any(len(t & mine) >= min_overlap * len(t) for ts in self.templates.values() for t in ts):
                    continue
                family, p, overlap = self.predict(words)
                if family and p >= min_probability and overlap >= min_overlap:
                    out.append((n, family, p, overlap))
                    done = m
                    break
        return out

    def scan(self, text: bytes, min_probability: float = MIN_PROBABILITY, min_overlap: float = MIN_OVERLAP) -> list[tuple[int, str, float, float]]:
        """(paragraph number, family, probability, overlap) of the paragraphs that share a 2-gram with a template and aren't unknown."""
        words = words_of(text)
        if self.pairs.isdisjoint(zip(words, words[1:])):
            return []
        out = []
        lines = [words_of(line) for line in text.split(b"\n")]
        for n, ws in enumerate(lines):
            if title := self.titles.get(tuple(ws)):
                out.append((n, title, 1.0, 1.0))
            elif not self.pairs.isdisjoint(zip(ws, ws[1:])):
                family, p, overlap = self.predict(ws)
                if family:
                    out.append((n, family, p, overlap))
        sure = {n for n, _, p, overlap in out if p >= min_probability and overlap >= min_overlap}
        joined = self._joined(lines, sure, min_probability, min_overlap)
        return sorted(out + joined) if joined else out


def train(docs: DataFrame, text: str = "text", id_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> Classifier:
    """With all paragraphs of the `sample_docs` documents with the smallest hashes as what isn't a licence, unless they look like one."""
    # The hashes are chosen first, so that only the sample's texts come to the driver; repeated rows are one.
    hashed = docs.where(F.col(text).isNotNull()).select(F.xxhash64(F.col(id_col), F.col(text)).alias("h"), F.col(text).alias("t"))
    cut = hashed.select("h").distinct().orderBy("h").limit(sample_docs).agg(F.max("h")).first()[0]
    rows = hashed.where(F.col("h") <= F.lit(cut)).groupBy("h").agg(F.min("t").alias("t")).orderBy("h").collect() if cut is not None else []
    lines = [words_of(x) for _, t in rows for x in t.encode().split(b"\n")]
    telling = {b"license", b"licensed", b"licence", b"licenced", b"rights", b"copyright", b"gnu", b"mozilla", b"permission"}
    return Classifier([w for w in lines if w and telling.isdisjoint(w)])


def scan_licences(docs: DataFrame, model: Classifier, text: str = "text", carry: list[str] | None = None, min_probability: float = MIN_PROBABILITY, min_overlap: float = MIN_OVERLAP) -> DataFrame:
    """carry's columns, `families` (confirmed, in order of name), `paragraphs` (their numbers) and the best unconfirmed prediction, `suspected`."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: list[bytes]) -> dict:
        out: dict[str, list] = {"families": [], "paragraphs": [], "probability": [], "suspected": []}
        for t in texts:
            found = held.value.scan(t, min_probability, min_overlap)
            sure = [x for x in found if x[2] >= min_probability and x[3] >= min_overlap]
            rest = sorted((x for x in found if x not in sure), key=lambda x: (-x[2], x[1]))
            out["families"].append(sorted({x[1] for x in sure}))
            out["paragraphs"].append([x[0] for x in sure])
            out["probability"].append(round(max((x[2] for x in sure), default=0.0), 6))
            out["suspected"].append(rest[0][1] if rest else None)
        return out

    schema = T.StructType([T.StructField("families", T.ArrayType(T.StringType())), T.StructField("paragraphs", T.ArrayType(T.LongType())), T.StructField("probability", T.DoubleType()), T.StructField("suspected", T.StringType())])
    return map_texts(docs, carry or ["doc_id"], text, run, schema)
