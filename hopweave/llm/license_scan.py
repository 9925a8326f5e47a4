"""License scan with a trained paragraph classifier.

A paragraph is a line with words; neighbouring lines that only together hold a notice, as when it is wrapped, are one more
(see `_wrapped`). Its distinct words and pairs of neighbouring words, lower-cased and without punctuation at their ends, are hashed into `2**BITS` places of a sparse logistic regression over the licence families
and one class for everything else. It is trained here on the families' own sentences (below), with words left out, put
before and behind, and on other text: shuffled words, sentences about law and licences in general, and word salad. The
unknown class is calibrated: temperature and threshold are set on variations kept from training. A prediction counts
once a sentence of its family confirms it: at least `ALIKE` of the sentence's word pairs stand in the paragraph.

All paragraphs of all texts are scored; where the sum of each feature's best advantage for any family, which is an
upper bound, does not reach the unknown class, the softmax is left out.

Nulls and the like: null and empty texts have no paragraphs; rows are judged one by one, so null ids and repeated rows
are returned as they are; extra columns are ignored; an empty table gives no rows. A text is held whole by a task, at
about 60 bytes a byte.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textcore import BYTE, BYTES_BASE, U64, Chunk, Rolling, as_bytes, chunks, mix

BITS, ALIKE, OTHER = 16, 0.6, "unknown"
#: Sentences by which public licences announce themselves, by family.
FAMILIES: dict[str, list[str]] = {
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "isc": ["Licensed under the ISC License.", "Released under the ISC license.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Released under the Apache License 2.0.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "gpl-3": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "Released under the GNU General Public License version 3.", "Licensed under the GNU GPL v3."],
    "gpl-2": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU GPL v2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"],
    "lgpl": ["Licensed under the GNU Lesser General Public License.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"],
    "agpl": ["Licensed under the GNU Affero General Public License.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "bsd": ["Licensed under the BSD 3-Clause License.", "Released under the BSD License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "proprietary": ["All rights reserved.", "Copyright (c) 2020 The Authors. All rights reserved.", "No part of this publication may be reproduced without the prior written permission of the publisher."],
}
GENERAL = [
    "The driver was licensed to operate heavy machinery.", "A new law on copyright was discussed in public.", "The license plate of the car was lost.", "He obtained a copy of the work from the library.", "She has the right to use this file and the source of the data.",
    "The software version was released in public under pressure.", "The terms of the work were general and free.", "Permission was granted to any person with a ticket.", "This program is about the foundation of a free school.", "The conditions of use are met in the following form.",
    "You may use the phone at work.", "It is under the table, without any file.", "The publication was reserved for the authors of the book.", "Attribution of the painting is disputed by international experts.", "Commercial work in the city is common.",
]
STRIP = re.compile(rb"^[^0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff]+$")
OUT = "doc_id long, n_paragraphs long, n_licensed long, families string, best_score double"
FOUND = "doc_id long, start long, end long, family string, score double, alike double"


def _words(text: bytes) -> list[bytes]:
    return [w for w in (STRIP.sub(b"", w) for w in text.lower().split()) if w]


def _placed(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start, end and line of each word without the punctuation at its ends."""
    lines = np.flatnonzero(c.data == 10)
    # ends of words without punctuation
    plain = (c.data >= 48) & (c.data <= 57) | (c.data >= 97) & (c.data <= 122) | (c.data >= 128)
    at = np.flatnonzero(plain)
    a, b = np.searchsorted(at, c.start), np.searchsorted(at, c.end)
    some = b > a
    start, end = at[a[some]], at[b[some] - 1] + 1
    h = Rolling(BYTE[c.data], BYTES_BASE).runs(start, end)
    return h, start, end, np.searchsorted(lines, start)


def _ids(h: np.ndarray, start: np.ndarray, end: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Paragraph and feature of each word and pair, and where paragraphs start and end (in the chunk's bytes)."""
    new = np.ones(len(line), dtype=bool)
    new[1:] = line[1:] != line[:-1]
    para = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    pair = np.flatnonzero(~new)
    mask = U64((1 << BITS) - 1)
    ids = np.r_[h & mask, mix(h[pair - 1] * U64(3) + h[pair]) & mask].astype(np.int64)
    paras = np.r_[para, para[pair]]
    last = np.r_[first[1:], len(start)][: len(first)] - 1
    return paras, ids, start[first], end[last] if len(first) else end


def _pairs(text: bytes) -> set[tuple[bytes, bytes]]:
    w = _words(text)
    return set(zip(w, w[1:])) or {(x, b"") for x in w}


@dataclass
class Classifier:
    names: list[str]
    weights: np.ndarray
    bias: np.ndarray
    best: np.ndarray
    temperature: float
    threshold: float

    def chances(self, paras: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
        """Of each paragraph, for each family and the unknown class (last)."""
        y = np.tile(self.bias, (n, 1))
        for k in range(len(self.bias)):
            y[:, k] += np.bincount(paras, self.weights[ids, k], minlength=n)
        y /= self.temperature
        y = np.exp(y - y.max(axis=1, keepdims=True))
        return y / y.sum(axis=1, keepdims=True)


def _distinct(paras: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(paras << BITS | ids)
    return key >> BITS, key & ((1 << BITS) - 1)


def _examples(r: np.random.Generator, times: int) -> tuple[list[bytes], np.ndarray]:
    names = list(FAMILIES)
    salad = sorted({w for s in [*sum(FAMILIES.values(), []), *GENERAL] for w in s.split()})
    texts, labels = [], []
    syllables = ["th", "on", "er", "an", "re", "ou", "la", "de", "que", "ti", "ed", "es"]
    noise = lambda n: ["".join(r.choice(syllables, r.integers(1, 4))) for _ in range(n)]
    for k, name in enumerate(names):
        for s in FAMILIES[name]:
            texts.append(s.encode())
            labels.append(k)
            for _ in range(times):
                w = [x for x in s.split() if r.random() > 0.04] or s.split()
                w = noise(r.integers(0, 3) * r.integers(0, 5)) + w + noise(r.integers(0, 3) * r.integers(0, 5))
                texts.append(" ".join(w).encode())
                labels.append(k)
    for i in range(len(texts) * 2):
        kind = i % 4
        s = GENERAL[i % len(GENERAL)].split()
        w = [x for x in s if r.random() > 0.1] if kind == 0 else list(r.choice(salad, r.integers(1, 16))) if kind == 1 else noise(r.integers(1, 60)) if kind == 2 else noise(4) + list(r.choice(["the", "of", "and", "is", "to", "under", "a", "work", "this"], 6))
        texts.append(" ".join(w).encode())
        labels.append(len(names))
    return texts, np.array(labels)


def _matrix(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    rows, ids = [], []
    for c in chunks([t.replace(b"\n", b" ") for t in texts]):
        c.words(lower=True)
        p, i, start, _ = _ids(*_placed(c))
        rows.append(c.rows[c.owner(start, c.lo)][p])
        ids.append(i)
    return _distinct(np.concatenate(rows), np.concatenate(ids))


@lru_cache(1)
def classifier() -> Classifier:
    """Trained once a process, the same everywhere."""
    r = np.random.default_rng(5)
    texts, labels = _examples(r, 40)
    row, ids = _matrix(texts)
    used, col = np.unique(ids, return_inverse=True)
    k = len(FAMILIES) + 1
    held = r.random(len(texts)) < 0.2
    want = np.zeros((len(texts), k))
    want[np.arange(len(texts)), labels] = 1
    w, b = np.zeros((len(used), k)), np.zeros(k)
    square = np.full(w.shape, 1e-3)
    keep = ~held[row]
    row, col = row[keep], col[keep]
    by = np.argsort(col, kind="stable")
    cut = np.searchsorted(col[by], np.arange(len(used)))
    has = np.diff(np.r_[cut, len(by)]) > 0
    for _ in range(120):
        y = np.zeros((len(texts), k))
        for j in range(k):
            y[:, j] = b[j] + np.bincount(row, w[col, j], minlength=len(texts))
        p = np.exp(y - y.max(axis=1, keepdims=True))
        g = (p / p.sum(axis=1, keepdims=True) - want) * ~held[:, None] / (~held).sum()
        d = np.zeros_like(w)
        d[has] = np.add.reduceat(g[row[by]], cut[has])
        d += 1e-5 * w
        square += d * d
        w -= 0.3 * d / np.sqrt(square)
        b -= 3.0 * g.sum(axis=0)
    weights = np.zeros((1 << BITS, k), dtype=np.float32)
    weights[used] = w
    found = Classifier([*FAMILIES, OTHER], weights, b, (weights[:, :-1] - weights[:, -1:]).max(axis=1), 1.0, 0.5)
    # calibration on what training has not seen
    back = np.flatnonzero(held)
    hrow, hids = _matrix([texts[i] for i in back])
    loss = {}
    for t in (0.5, 0.7, 1.0, 1.5, 2.0, 3.0):
        found.temperature = t
        p = found.chances(hrow, hids, len(back))
        loss[t] = -np.log(p[np.arange(len(back)), labels[back]] + 1e-12).mean()
    found.temperature = min(loss, key=loss.get)
    p = found.chances(hrow, hids, len(back))
    guess, top = p[:, :-1].argmax(axis=1), p[:, :-1].max(axis=1)
    right = {t: ((top >= t) & (guess == labels[back]) | (top < t) & (labels[back] == k - 1)).mean() for t in np.arange(0.3, 0.96, 0.05)}
    found.threshold = float(max(right, key=lambda t: (right[t], -abs(t - 0.5))))
    return found


@lru_cache(1)
def _sentences() -> tuple[list[tuple[str, set]], list[int], np.ndarray, list[list[int]]]:
    """Family and word pairs of each sentence, how many of them confirm it, all pairs' hashes, and the sentences of each."""
    known = [(name, s) for name, many in FAMILIES.items() for s in many]
    where: dict[int, list[int]] = {}
    for t, (_, s) in enumerate(known):
        c = Chunk([0], [s.encode()])
        c.words(lower=True)
        h = _placed(c)[0]
        for x in np.unique(mix(h[:-1] * U64(3) + h[1:])).tolist():
            where.setdefault(x, []).append(t)
    own = [(name, _pairs(s.encode())) for name, s in known]
    keys = sorted(where)
    return own, [int(np.ceil(ALIKE * len(s) - 1e-9)) for _, s in own], np.array(keys, dtype=U64), [where[k] for k in keys]


def _wrapped(m: Classifier, h: np.ndarray, start: np.ndarray, end: np.ndarray, line: np.ndarray, doc: np.ndarray, data: bytes) -> list[tuple[int, int, str, float, float, set]]:
    """Start, end, family, score, likeness and confirming pairs of windows of neighbouring lines with words that only together confirm a sentence.

    A window begins as the fewest lines with ALIKE of a sentence's pairs and grows while a next line has more of them. It
    counts if the chance of the unknown class leaves the threshold to the families; the likest sentence names the family.
    """
    own, need, keys, where = _sentences()
    if len(h) < 2:
        return []
    pair = mix(h[:-1] * U64(3) + h[1:])
    at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
    apart = (doc[1:] != doc[:-1]) | (line[1:] - line[:-1] > 1)
    run = np.cumsum(np.r_[False, apart])
    hit = np.flatnonzero((keys[at] == pair) & ~apart)
    by: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for k, r, a, b in zip(at[hit].tolist(), run[hit].tolist(), line[hit].tolist(), line[hit + 1].tolist(), strict=True):
        for t in where[k]:
            by.setdefault((r, t), []).append((k, a, b))
    spans = set()
    for (_, t), got in by.items():
        if got[0][1] == got[-1][2] or len({k for k, _, _ in got}) < need[t]:
            continue
        times: dict[int, int] = {}
        lo = 0
        for hi, (k, _, b) in enumerate(got):
            times[k] = times.get(k, 0) + 1
            while times[got[lo][0]] > 1 or len(times) > need[t]:
                times[got[lo][0]] -= 1
                if not times[got[lo][0]]:
                    del times[got[lo][0]]
                lo += 1
            if len(times) == need[t]:
                have, a, i, j = set(times), got[lo][1], lo - 1, hi + 1
                for step in (1, -1):
                    while True:
                        more, n = set(), j if step == 1 else i
                        while 0 <= n < len(got) and (got[n][2] <= b + 1 if step == 1 else got[n][1] >= a - 1):
                            more.add(got[n][0])
                            n += step
                        if more <= have:
                            break
                        have |= more
                        a, b, i, j = (a, b + 1, i, n) if step == 1 else (a - 1, b, n, j)
                if a < b:
                    spans.add((a, b))
    scored = []
    for a, b in sorted(spans):
        x, y = int(np.searchsorted(line, a)), int(np.searchsorted(line, b, side="right"))
        ids = np.unique(np.r_[h[x:y], pair[x : y - 1]] & U64((1 << BITS) - 1)).astype(np.int64)
        p = m.chances(np.zeros(len(ids), dtype=np.int64), ids, 1)[0]
        mine = _pairs(data[start[x] : end[y - 1]])
        alike, _, name, held = max(((len(mine & s) / len(s), len(mine & s), name, mine & s) for name, s in own), key=lambda z: z[:2])
        if alike >= ALIKE and 1 - p[-1] >= m.threshold:
            scored.append((int(start[x]), int(end[y - 1]), name, float(1 - p[-1]), alike, held))
    out: list[tuple] = []
    for w in sorted(scored, key=lambda w: (-w[4], -len(w[5]), w[1] - w[0], w[0])):
        if all(w[1] <= o[0] or o[1] <= w[0] for o in out):
            out.append(w)
    return out


def scan_texts(texts: list[bytes | None]) -> tuple[np.ndarray, list[list[tuple[int, int, str, float, float]]]]:
    """Numbers of paragraphs, and (start, end, family, score, likeness) of the licensed ones, of each text."""
    m = classifier()
    pairs = {name: [_pairs(s.encode()) for s in FAMILIES[name]] for name in FAMILIES}
    count = np.zeros(len(texts), dtype=np.int64)
    found: list[list[tuple[int, int, str, float, float]]] = [[] for _ in texts]
    wide: list[list[tuple]] = [[] for _ in texts]
    for c in chunks(texts):
        c.words(lower=True)
        placed = _placed(c)
        paras, ids, start, end = _ids(*placed)
        if not len(start):
            continue
        doc = c.owner(start, c.lo)
        np.add.at(count, c.rows[doc], 1)
        bound = np.bincount(paras, np.maximum(m.best[ids], 0), minlength=len(start)) + (m.bias[:-1] - m.bias[-1]).max()
        # the family's margin over the unknown class is under what the threshold needs
        likely = bound >= m.temperature * np.log(m.threshold / (1 - m.threshold + 1e-12))
        data = c.data.tobytes()
        for a, b, *x in _wrapped(m, *placed, c.owner(placed[1], c.lo), data):
            k = int(c.owner(np.array([a]), c.lo)[0])
            base = int(c.lo[k])
            wide[int(c.rows[k])].append((a - base, b - base, *x))
        if not likely.any():
            continue
        keep = likely[paras]
        number = np.cumsum(likely) - 1
        row, col = _distinct(number[paras[keep]], ids[keep])
        p = m.chances(row, col, int(likely.sum()))
        for i, at in enumerate(np.flatnonzero(likely).tolist()):
            k = int(p[i, :-1].argmax())
            if p[i, k] >= m.threshold:
                mine = _pairs(data[start[at] : end[at]])
                alike = max(len(mine & s) / len(s) for s in pairs[m.names[k]])
                if alike >= ALIKE:
                    base = int(c.lo[doc[at]])
                    found[int(c.rows[doc[at]])].append((int(start[at]) - base, int(end[at]) - base, m.names[k], float(p[i, k]), alike))
    for i, windows in enumerate(wide):
        for a, b, family, score, alike, held in windows:
            # a line goes where the window explains what it was confirmed by
            inside = [x for x in found[i] if x[0] < b and a < x[1]]
            mine = {x: max((_pairs(texts[i][x[0] : x[1]]) & s for s in pairs[x[2]]), key=len) for x in inside}
            if not any(x[2] == family and (x[4] >= alike or len(mine[x]) >= len(held)) for x in inside):
                found[i] = sorted([x for x in found[i] if x not in mine or not (x[2] == family or mine[x] < held)] + [(a, b, family, score, alike)])
    return count, found


def _per_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, found = scan_texts(as_bytes(batch.column("text")))
        families = [",".join(sorted({x[2] for x in f})) for f in found]
        best = [max((x[3] for x in f), default=0.0) for f in found]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array([len(f) for f in found], pa.int64()), pa.array(families, pa.string()), pa.array(best, pa.float64())], ["doc_id", "n_paragraphs", "n_licensed", "families", "best_score"])


def _per_paragraph(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, found = scan_texts(as_bytes(batch.column("text")))
        rows = [(d, *x) for d, f in zip(batch.column("doc_id").to_pylist(), found, strict=True) for x in f]
        cols = list(zip(*rows, strict=True)) or [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(cols, kinds, strict=True)], ["doc_id", "start", "end", "family", "score", "alike"])


def license_paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, start and end (bytes of the text), family, score and likeness of each licensed paragraph."""
    return docs.select("doc_id", "text").mapInArrow(_per_paragraph, FOUND)


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs, n_licensed, families (sorted, comma-joined) and best_score of every document."""
    return docs.select("doc_id", "text").mapInArrow(_per_document, OUT)
