"""Licence scans: a trained paragraph classifier over word n-grams names the family; a template confirms it."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import id_and_text, mixed, tune
from .labelled import TRAIN_BYTES, first_texts

#: Notices by which each family is known, in common wordings: fixed values.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Licensed under the Apache License, Version 2.0."),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the BSD License.", "Use of this source code is governed by a BSD-style license."),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."),
    "cc-by-nc": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."),
    "cc-by-sa": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.", "Released under CC0 1.0 Universal."),
    "gpl": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This work is licensed under the GNU General Public License, version 3."),
    "lgpl": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.", "Licensed under the GNU Lesser General Public License, version 2.1."),
    "mit": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.", "Released under the MIT License.", "Licensed under the MIT license."),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "Released into the public domain under the Unlicense."),
    "proprietary": ("Copyright. All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited.", "All rights reserved. No part of this publication may be reproduced without permission."),
}
#: SPDX names of each family: "SPDX-License-Identifier: MIT" is a template, too.
SPDX = {
    "apache-2.0": ("Apache-2.0",), "bsd": ("BSD-2-Clause", "BSD-3-Clause", "0BSD"), "cc-by": ("CC-BY-4.0", "CC-BY-3.0"), "cc-by-nc": ("CC-BY-NC-4.0",), "cc-by-sa": ("CC-BY-SA-4.0", "CC-BY-SA-3.0"), "cc0": ("CC0-1.0",),
    "gpl": ("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"), "lgpl": ("LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"),
    "mit": ("MIT",), "mpl-2.0": ("MPL-2.0",), "unlicense": ("Unlicense",),
}
TEMPLATES = {f: (*t, *(f"SPDX-License-Identifier: {x}" for x in SPDX.get(f, ()))) for f, t in TEMPLATES.items()}
UNKNOWN = "unknown"
FAMILIES = (UNKNOWN, *TEMPLATES)
#: Buckets of the hashed words and pairs; words of a paragraph's piece and between the starts of two pieces.
BUCKETS, LONGEST, STEP = 1 << 16, 96, 32
#: Documents whose paragraphs are examples of text without a licence, at most; share of a template that confirms it.
PLAIN_DOCS, CONFIRM = 800, 0.5
#: Words of texts that are looked at together: a memory bound.
WORDS_AT_ONCE, REMEMBERED = 1 << 16, 500_000
#: Comment marks at either end of a line.
_MARKS = re.compile(rb"^\s*(?:(?:<!--|//+|/\*+!?|\*+/?|#+!?|--+|;+|%+|>+|dnl\b)\s*)+|\s*(?:\*+/|-->|\*+)\s*$")
_EDGE = b".,;:!?\"'()[]{}<>"
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def normal(words: list[bytes]) -> list[bytes]:
    return [w for w in (x.lower().strip(_EDGE) for x in words) if w]


class Words:
    """Hashes of words in their normal form; 0 for what is all punctuation. Frequent words are hashed once."""

    def __init__(self):
        self.seen: dict[bytes, int] = {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        for w in set(words).difference(self.seen):
            x = w.lower().strip(_EDGE)
            self.seen[w] = xxhash.xxh3_64_intdigest(x) or 1 if x else 0
        return np.fromiter(map(self.seen.__getitem__, words), np.uint64, len(words))


class Layout:
    """A text's words without comment marks and bare punctuation, and its pieces: each line, and each run of lines up to
    one that is blank but for comment marks, both cut into overlapping pieces of LONGEST words where they are longer."""

    def __init__(self, text: bytes, words: Words):
        raw, line_of, lines, runs, begun = [], [], [], [], 0
        for k, line in enumerate(text.split(b"\n")):
            own = _MARKS.sub(b"", line).split()
            if own:
                lines.append((len(raw), len(raw) + len(own)))
                raw += own
                line_of += [k] * len(own)
            elif begun < len(raw):
                runs.append((begun, len(raw)))
                begun = len(raw)
        if begun < len(raw):
            runs.append((begun, len(raw)))
        found = words.hashes(raw)
        on = found != 0
        place = np.concatenate([[0], np.cumsum(on)])
        self.raw, self.where, self.h = raw, np.flatnonzero(on), found[on]
        self.line_of = np.array(line_of, np.int64)[on]
        starts, ends = [], []
        for part, whole in ((lines, True), (runs, False)):
            for i, j in place[np.array(part, np.int64).reshape(-1, 2)].tolist():
                for at in range(i, max(i + 1, j - LONGEST + STEP), STEP):
                    end = min(j, at + LONGEST)
                    if end > at and (whole or self.line_of[at] < self.line_of[end - 1]):
                        starts.append(at)
                        ends.append(end)
        self.starts, self.ends = np.array(starts, np.int64), np.array(ends, np.int64)

    def words(self, start: int, end: int) -> list[bytes]:
        return normal([self.raw[i] for i in self.where[start:end].tolist()])


def buckets(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word, and of each pair of neighbours."""
    one = (h % np.uint64(BUCKETS)).astype(np.int64)
    return one, (mixed(h[:-1] * _PAIR + h[1:]) % np.uint64(BUCKETS)).astype(np.int64)


class LicenceModel:
    """Multinomial logistic regression over words and pairs, with a class for no known licence. Probabilities are
    calibrated on examples that the weights were not fitted on, by a temperature and a shift of the unknown class."""

    def __init__(self):
        self.weights, self.bias = np.zeros((BUCKETS, len(FAMILIES)), np.float32), np.zeros(len(FAMILIES))
        self.temperature, self.shift = 1.0, 0.0

    @staticmethod
    def _positives(pool: list[bytes], times: int, rng: random.Random) -> Iterator[tuple[int, list[bytes]]]:
        """Templates with words dropped, cut, and set among words of plain text."""
        for k, family in enumerate(FAMILIES[1:], 1):
            for t in TEMPLATES[family]:
                words = normal(t.encode().split())
                for _ in range(times):
                    some = words if len(words) < 4 else [w for w in words if rng.random() > rng.choice((0, 0, 0.1, 0.2))] or words
                    if rng.random() < 0.3 and len(some) > 12:
                        cut = rng.randrange(len(some) - 10)
                        some = some[cut : cut + rng.randrange(10, 40)]
                    before, after = rng.choices(pool, k=rng.choice((0, 0, 2, 12, 30))), rng.choices(pool, k=rng.choice((0, 0, 2, 12, 30)))
                    yield k, [*before, *some, *after]

    @staticmethod
    def _negatives(plain: list[list[bytes]], rng: random.Random) -> Iterator[tuple[int, list[bytes]]]:
        """Plain paragraphs, sentences among them that speak of licences, and words of templates in no order."""
        cues = sorted({w for f in TEMPLATES.values() for t in f for w in normal(t.encode().split())})
        for words in plain:
            yield 0, words
            if rng.random() < 0.3:
                yield 0, [*words[:10], *rng.choices(cues, k=2), *words[10:20]]
        for _ in range(300):
            yield 0, rng.choices(cues, k=rng.randrange(1, 12))

    def fit(self, plain: list[list[bytes]], epochs: int = 8, rate: float = 0.3, batch: int = 2048, seed: int = 11) -> LicenceModel:
        """plain: paragraphs; four in five train the unknown class, the others serve to calibrate."""
        rng, words = random.Random(seed), Words()
        plain = [x for x in map(normal, plain) if x]
        held, taught = plain[::5], [p for i, p in enumerate(plain) if i % 5]
        pool = [w for p in taught for w in p] or [b"lorem"]
        bags = [*self._positives(pool, 60, rng), *self._negatives(taught, rng)]
        rng.shuffle(bags)
        square = np.full(self.weights.shape, 1e-6, np.float32)
        square_bias = np.full(len(FAMILIES), 1e-6)
        packed = []
        for at in range(0, len(bags), batch):
            some = bags[at : at + batch]
            cols = [np.concatenate(buckets(words.hashes(x))) for _, x in some]
            n = np.array([len(c) for c in cols])
            flat, row = np.concatenate(cols), np.repeat(np.arange(len(some)), n)
            order = np.argsort(flat, kind="stable")
            first = np.flatnonzero(np.diff(flat[order], prepend=-1))
            packed.append((flat, np.cumsum(n) - n, (1 / np.sqrt(n)).astype(np.float32), row[order], flat[order][first], first, np.eye(len(FAMILIES))[[k for k, _ in some]]))
        for _ in range(epochs):
            for flat, start, scale, row, own, first, target in packed:
                z = np.add.reduceat(self.weights[flat], start) * scale[:, None] + self.bias
                d = (self._softmax(z) - target) / len(target)
                g = np.add.reduceat((d * scale[:, None]).astype(np.float32)[row], first)
                square[own] += g * g
                self.weights[own] -= rate * g / np.sqrt(square[own])
                square_bias += d.sum(0) ** 2
                self.bias -= rate * d.sum(0) / np.sqrt(square_bias)
        checks = [*self._positives([w for p in held for w in p] or pool, 10, rng), *self._negatives(held, rng)]
        self._calibrate(np.stack([self.raw(words.hashes(x)) for _, x in checks]), np.array([k for k, _ in checks]))
        return self

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def _calibrate(self, z: np.ndarray, y: np.ndarray) -> None:
        """The temperature and shift of the least log loss."""

        def loss(t: float, c: float) -> float:
            self.temperature, self.shift = t, c
            return -float(np.log(np.maximum(self.probabilities(z)[np.arange(len(y)), y], 1e-300)).mean())

        best = min(((loss(t, c), t, c) for t in np.geomspace(0.25, 4, 25) for c in np.linspace(-3, 3, 25)), key=lambda x: x[0])
        _, self.temperature, self.shift = best

    def raw(self, h: np.ndarray) -> np.ndarray:
        """Scores of one piece."""
        return self.scores(h, np.array([0]), np.array([len(h)]))[0]

    def scores(self, h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Scores of pieces of a row of words: differences of running sums, so that overlapping pieces cost nothing more."""
        one, two = buckets(h)
        each, before = self.weights[one], np.concatenate([np.zeros((1, len(FAMILIES)), np.float32), self.weights[two]])
        upto = np.concatenate([np.zeros((1, len(FAMILIES))), np.cumsum(each + before, axis=0, dtype=np.float64)])
        return (upto[ends] - upto[starts] - before[starts]) / np.sqrt(2 * (ends - starts) - 1)[:, None] + self.bias

    def probabilities(self, z: np.ndarray) -> np.ndarray:
        z = z.copy()
        z[:, 0] += self.shift
        return self._softmax(z / self.temperature)

    def claims(self, texts: list[Layout]) -> Iterator[tuple[int, int, int, str, float]]:
        """Text, start, end, family and probability of each piece that is likelier some family's than unknown."""
        sizes = np.cumsum([0, *(len(x.h) for x in texts)])
        of = np.repeat(np.arange(len(texts)), [len(x.starts) for x in texts])
        starts, ends = (np.concatenate([getattr(x, side) + at for x, at in zip(texts, sizes, strict=False)]) if texts else np.empty(0, np.int64) for side in ("starts", "ends"))
        if not len(starts):
            return
        p = self.probabilities(self.scores(np.concatenate([x.h for x in texts]), starts, ends))
        best = p.argmax(1)
        for k in np.flatnonzero(best).tolist():
            at = int(sizes[of[k]])
            yield int(of[k]), int(starts[k]) - at, int(ends[k]) - at, FAMILIES[best[k]], float(p[k, best[k]])


_PAIRS = {f: [(len(w), set(zip(w, w[1:], strict=False))) for w in (normal(x.encode().split()) for x in t)] for f, t in TEMPLATES.items()}
_ALL_PAIRS = {p for t in _PAIRS.values() for _, pairs in t for p in pairs}


def plain_text(words: list[bytes]) -> bool:
    """Whether a paragraph holds little of any template."""
    return _ALL_PAIRS.isdisjoint(zip(words, words[1:], strict=False)) or max(containment(words, f) for f in TEMPLATES) < 0.3


def containment(words: list[bytes], family: str) -> float:
    """Largest share of a template's word pairs in a span of twice its length that slides over the words."""
    own, best = list(zip(words, words[1:], strict=False)), 0.0
    distinct = set(own)
    for n, pairs in _PAIRS[family]:
        if len(pairs & distinct) <= best * len(pairs):
            continue
        for at in range(0, max(1, len(own) - n), max(1, n // 2)):
            best = max(best, len(pairs.intersection(own[at : at + 2 * n])) / len(pairs))
    return best


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = TRAIN_BYTES) -> LicenceModel:
    """The model. All paragraphs of a bounded sample of documents (PLAIN_DOCS, the first by a hash of the id, of
    most_bytes together) that hold no template's pairs of words serve as plain text."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    words, plain = Words(), []
    for t in first_texts(texts, PLAIN_DOCS, most_bytes):
        x = Layout(t, words)
        plain += [x.words(i, j) for i, j in zip(x.starts.tolist(), x.ends.tolist(), strict=True)]
    return LicenceModel().fit(list(filter(plain_text, plain)))


def found_in(x: Layout, claims: list[tuple[int, int, str, float]]) -> list[dict]:
    """What a text's claims say: of pieces of one family that share lines the one that holds most of a template counts,
    the narrower if equal; a piece within the lines of another family's goes if that holds more of its template."""
    out: list[tuple[int, int, dict]] = []
    for start, end, family, p in claims:
        first, last = int(x.line_of[start]), int(x.line_of[end - 1])
        c = containment(x.words(start, end), family)
        same = [y for y in out if y[2]["family"] == family and y[0] <= last and first <= y[1]]
        if all(y[2]["containment"] < c or (y[2]["containment"] == c and first == last) for y in same):
            out = [y for y in out if y not in same]
            out.append((first, last, {"line": first, "family": family, "probability": p, "containment": c, "confirmed": c >= CONFIRM}))
    return [y for first, last, y in out if not any(a <= first and last <= b and z["containment"] > y["containment"] for a, b, z in out)]


def scan(docs: DataFrame, model: LicenceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, families (sorted, confirmed by a template), and found: first line, family, probability,
    containment, confirmed of every paragraph that the classifier claims (a line, or lines without a blank one between
    them; every one of every whole text is judged).

    Null and empty texts have none. Repeated rows are scanned each; a null id stays null; an empty table gives no rows;
    other columns are ignored.
    """
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("line", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("containment", pa.float64()), ("confirmed", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, words = shared.value, Words()

        def judged(texts: list[Layout]) -> Iterator[list[dict]]:
            claims: list[list] = [[] for _ in texts]
            for k, *claim in own.claims(texts):
                claims[k].append(claim)
            for x, y in zip(texts, claims, strict=True):
                yield found_in(x, y)

        for b in batches:
            found, held, size = [], [], 0
            for text in b.column(1):
                held.append(Layout(text.as_py(), words))
                size += len(held[-1].h)
                if size > WORDS_AT_ONCE:
                    found += judged(held)
                    held, size = [], 0
            found += judged(held)
            families = [sorted({x["family"] for x in f if x["confirmed"]}) for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(families, pa.list_(pa.string())), pa.array(found, kind)], names=["doc_id", "families", "found"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, families array<string>, found array<struct<line:long,family:string,probability:double,containment:double,confirmed:boolean>>")
