"""Licence scans: a trained paragraph classifier names the licence family, templates confirm it.

A paragraph is a run of lines that hold words; comment marks don't count as words, so a notice that is wrapped over
commented lines is one paragraph. Every line of it, and every window of WINDOW words of it and of half as many, half a
window apart, is classified. The classifier is multinomial logistic regression on sparse hashed word 1- to 3-grams. It
is trained here, on the notices of each family (TEMPLATES): whole or windows of them, varied by dropped words and by
words of the corpus around them, against windows of a bounded sample of documents (SAMPLE and LINES, parameters; taken
by hash from anywhere in a text) and against shuffled words of the notices, which are class 'unknown'. A temperature
calibrates the probabilities; it is fitted on new variations, and on whole notices that a first training doesn't see,
the last of each family that has several. Where the families together are below `least`, the class is unknown, else the
likeliest family. A prediction is confirmed if some notice of the family has at least `alike` of its word bigrams in the
words around the window, as many on either side as that notice has. Scoring reads every whole text, however long, and is
one pass without a shuffle.

Defined cases: null or empty texts hold no licence. Rows that repeat a doc_id are scanned one by one. Of equally similar
windows, the first is given. Without documents the classifier is trained on the notices alone. An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Documents of the sample, lines that each gives at most (of at most CHARS characters), words of a window, bits of the n-gram hash.
SAMPLE, LINES, CHARS, WINDOW, BITS = 1000, 6, 400, 40, 18
UNKNOWN = "unknown"
#: How texts give notice of the common public licences.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "This project is released under the Apache 2.0 license.",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    ],
    "bsd": [
        "This software is licensed under the BSD 3-Clause License.",
        "Released under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GPL v3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under the GPL v2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "Licensed under the LGPL v2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "agpl": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "Licensed under the AGPL v3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "mpl-2.0": [
        "Licensed under the Mozilla Public License 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "isc": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-nd": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "cc0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Released under the Unlicense.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
}
CLASSES = [UNKNOWN, *TEMPLATES]
_WORDISH = np.zeros(256, np.uint8)
for _k in (*range(48, 58), *range(97, 123)):
    _WORDISH[_k] = _k
for _k in range(65, 91):
    _WORDISH[_k] = _k + 32
_WORDISH[128:] = np.arange(128, 256)
_WORDISH[ord("-")], _WORDISH[ord(".")] = ord("-"), 32
_WORDISH[_WORDISH == 0] = 32


def _words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and hashes of the words (letters, digits, hyphens; lower case) of a block of paragraphs, and their bounds."""
    plain = _WORDISH[data]
    starts, ends, _ = C.words(plain, at)
    letters = np.r_[0, np.cumsum((plain != 32) & (plain != 45))]
    real = letters[ends] > letters[starts]  # hyphens alone mark comments
    starts, ends = starts[real], ends[real]
    return starts, C.span_hash(C.prefix_hash(plain), starts, ends), np.searchsorted(starts, at)


def _grams(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(words, 3) weight rows of the 1-, 2- and 3-gram that ends at each word; row 0 where it would cross a paragraph."""
    first = np.repeat(bounds[:-1], np.diff(bounds))
    place = np.arange(len(h)) - first
    out, g = np.zeros((len(h), 3), np.int64), np.zeros(len(h), np.uint64)
    for k in range(3):
        before = np.zeros(len(h), np.uint64)
        before[k:] = h[: len(h) - k] if k else h
        g = C.mix(g * np.uint64(C.BASE) + before + np.uint64(k))
        out[:, k] = np.where(place >= k, 1 + (g >> np.uint64(64 - BITS)).astype(np.int64), 0)
    return out


def _bigrams(h: np.ndarray) -> set[int]:
    return set(C.mix(h[:-1] * np.uint64(C.BASE) + h[1:]).tolist()) if len(h) > 1 else set(h.tolist())


def _packed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64)


def _examples(paragraphs: list[str], notices: list[tuple[int, str]], copies: int = 30, seed: int = 7) -> tuple[list[str], np.ndarray]:
    """Varied notices (class, text) and what isn't one, with their classes; no example has more than WINDOW words."""
    draw = np.random.default_rng(seed)
    filler = [w for p in paragraphs for w in p.split()] or ["text", "of", "some", "kind"]
    some = lambda n: [filler[i] for i in draw.integers(0, len(filler), n)]
    texts, y = [], []
    for k, notice in notices:
        every = notice.split()
        for c in range(copies):
            at = int(draw.integers(0, max(1, len(every) - WINDOW + 1)))
            words = every[at : at + WINDOW]
            kept = words if c % 2 else [w for w in words if draw.random() > 0.08] or words
            free = max(0, WINDOW - len(kept)) if c % 3 == 1 else min(12, max(0, WINDOW - len(kept)))
            before = int(draw.integers(0, free + 1))
            texts.append(" ".join((some(before) if c % 3 else []) + kept + (some(free - before) if c % 3 == 1 else [])))
            y.append(k)
            if c % 3 == 0:
                shuffled = list(words)
                draw.shuffle(shuffled)
                texts.append(" ".join(some(8) + shuffled[: len(shuffled) // 2 + 1] + some(8)))
                y.append(0)
    for p in paragraphs:
        texts.append(" ".join(p.split()[:WINDOW]))
        y.append(0)
    return texts, np.array(y)


def _features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Weight rows of all n-grams of the texts, and which text each is of (sorted)."""
    data, at = _packed(texts)
    _, h, bounds = _words(data, at)
    return _grams(h, bounds).ravel(), np.repeat(np.arange(len(texts)), 3 * np.diff(bounds))


def _train(texts: list[str], y: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights by hashed n-gram, and biases: gradient steps scaled by the gradients so far."""
    flat, owner = _features(texts)
    used, index = np.unique(flat, return_inverse=True)
    k = len(CLASSES)
    w, b = np.zeros((len(used), k), np.float32), np.zeros(k, np.float32)
    gw, gb = np.full((len(used), k), 1e-6, np.float32), np.full(k, 1e-6, np.float32)
    one = np.zeros((len(texts), k), np.float32)
    one[np.arange(len(texts)), y] = 1
    some, begin = np.unique(owner, return_index=True)
    by_gram = np.argsort(index, kind="stable")
    gram_begin = np.searchsorted(index[by_gram], np.arange(len(used)))
    gram_owner = owner[by_gram]
    for _ in range(rounds):
        z = np.zeros((len(texts), k), np.float32)
        z[some] = np.add.reduceat(w[index], begin, axis=0)
        z += b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        d = p - one
        g = np.add.reduceat(d[gram_owner], gram_begin, axis=0) + np.float32(1e-3) * w
        gw += g * g
        w -= np.float32(0.15) * g / np.sqrt(gw)
        s = d.sum(axis=0)
        gb += s * s
        b -= np.float32(0.15) * s / np.sqrt(gb)
    full = np.zeros(((1 << BITS) + 1, k), np.float32)
    full[used] = w
    full[0] = 0
    return full, b


def held_out_logits(paragraphs: list[str], rounds: int, varied: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds and classes of what a training doesn't see: the last notice of each family of several, and every fifth paragraph; with varied, also new variations of the notices that it sees."""
    every = [(k, i, t) for k, name in enumerate(CLASSES[1:], 1) for i, t in enumerate(TEMPLATES[name])]
    last = {name: len(TEMPLATES[name]) - 1 for name in TEMPLATES if len(TEMPLATES[name]) > 2}
    held = [(k, t) for k, i, t in every if last.get(CLASSES[k]) == i]
    seen = [(k, t) for k, i, t in every if last.get(CLASSES[k]) != i]
    w, b = _train(*_examples([p for i, p in enumerate(paragraphs) if i % 5 != 4], seen), rounds)
    texts, y = _examples([p for i, p in enumerate(paragraphs) if i % 5 == 4], held + seen * varied, copies=9, seed=8)
    flat, owner = _features(texts)
    z = np.zeros((len(texts), len(CLASSES)))
    np.add.at(z, owner, w[flat])
    return z + b, y


def fit(paragraphs: list[str], rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Weights by hashed n-gram, and biases, divided by the fitted temperature."""
    templates = _template_sets()
    every = [b for sets in templates.values() for b, _ in sets]
    own = map(_bigrams, _hash_each(paragraphs))
    clear = [p for p, o in zip(paragraphs, own, strict=True) if not any(len(b & o) >= min(0.5 * len(b), 8) for b in every)]  # a part of a notice is no example of what isn't one
    z, y = held_out_logits(clear, rounds, varied=True)
    best, t = np.inf, 1.0
    for c in np.geomspace(0.25, 8, 25):
        s = z / c
        s -= s.max(axis=1, keepdims=True)
        loss = -(s[np.arange(len(s)), y] - np.log(np.exp(s).sum(axis=1))).mean()
        if loss < best - 1e-9:
            best, t = loss, c
    w, b = _train(*_examples(clear, [(k, x) for k, name in enumerate(CLASSES[1:], 1) for x in TEMPLATES[name]]), rounds)
    return w / np.float32(t), (b / t).astype(np.float32)


def _hash_each(texts: list[str]) -> list[np.ndarray]:
    data, at = _packed(texts)
    _, h, bounds = _words(data, at)
    return [h[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _template_sets_of(notices: list[str]) -> list[tuple[set[int], int]]:
    return [(_bigrams(h), len(h)) for h in _hash_each(notices)]


def _template_sets() -> dict[str, list[tuple[set[int], int]]]:
    """By family: the bigrams and the number of words of each notice."""
    return {name: _template_sets_of(notices) for name, notices in TEMPLATES.items()}


def confirm(h: np.ndarray, lo: int, hi: int, first: int, last: int, sets: list[tuple[set[int], int]]) -> tuple[float, int]:
    """The greatest share of a notice's bigrams that is in one stretch of words around [lo, hi) within [first, last), and the word at which that begins."""
    best = (0.0, lo)
    for grams, n in sets:
        a, b = max(first, lo - n), min(last, hi + n)
        own = C.mix(h[a : b - 1] * np.uint64(C.BASE) + h[a + 1 : b]) if b - a > 1 else h[a:b]
        hit = [i for i, x in enumerate(own.tolist()) if x in grams]
        # the notice's own length and a quarter: room for words that were put in
        span, j = n + n // 4 + 1, 0
        for i, at in enumerate(hit):
            while hit[j] < at - span:
                j += 1
            share = len({int(own[k]) for k in hit[j : i + 1]}) / len(grams)
            if share > best[0]:
                best = (share, a + hit[j])
    return best


def scan(docs: DataFrame, sample: int = SAMPLE, least: float = 0.5, alike: float = 0.7, lines: int = LINES) -> DataFrame:
    """doc_id, paragraph (the line in which the notice begins), family, probability, similarity, confirmed: the most similar place of each family that is predicted in a paragraph."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chosen = C.cut(C.bounded_sample(texts.where("text is not null and doc_id is not null").select("doc_id"), "doc_id", sample).select(F.col("doc_id").alias("d")).distinct(), "license-sample")
    by_hash = F.slice(F.array_sort(F.transform(F.split("text", "\n"), lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("x")))), 1, lines)
    part = F.transform(by_hash, lambda s: F.substring(s["x"], (F.pmod(s["h"], F.greatest(F.length(s["x"]) - CHARS, F.lit(1))) + 1).cast("int"), F.lit(CHARS)))
    some = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("d")).groupBy("doc_id").agg(F.min(part).alias("l")).toPandas().sort_values("doc_id")
    weights, bias = fit([x for l in some["l"] for x in l if x.strip()])  # noqa: E741
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((weights, bias))  # as large as 2**BITS and the classes, whatever the corpus
    sets = _template_sets()

    def run(batches):
        from .quality import lines as line_spans

        weights, bias = shared.value
        for part, data, at in C.blocks(batches):
            line_at, _, lb = line_spans(data, at)
            starts, h, bounds = _words(data, np.r_[line_at, len(data)] if len(line_at) else at)
            count = np.diff(bounds)
            doc_of = np.repeat(np.arange(part.num_rows), np.diff(lb))
            full = count > 0
            # a paragraph begins at a line with words that follows none of its document
            opens = full & np.r_[True, ~full[:-1] | (doc_of[1:] != doc_of[:-1])] if len(full) else full
            p_first = np.flatnonzero(opens)
            p_bounds = np.r_[bounds[:-1][opens], bounds[-1]]
            grams = _grams(h, p_bounds)
            score = weights[grams[:, 0]] + weights[grams[:, 1]] + weights[grams[:, 2]]
            sums = np.zeros((len(h) + 1, score.shape[1]))
            np.cumsum(score, axis=0, out=sums[1:])
            size = np.diff(p_bounds)
            spans = []
            for wide in (WINDOW, WINDOW // 2):
                windows = np.maximum(1, -(-(size - wide) // (wide // 2)) + 1)
                para = np.repeat(np.arange(len(size)), windows)
                k = np.arange(len(para)) - np.repeat(np.cumsum(windows) - windows, windows)
                w0 = p_bounds[para] + k * (wide // 2)
                spans.append((para, w0, np.minimum(w0 + wide, p_bounds[para + 1])))
            own = np.flatnonzero(full & (count <= WINDOW))
            spans.append((np.searchsorted(p_first, own, "right") - 1, bounds[own], bounds[own + 1]))
            para, w0, w1 = (np.concatenate(x) for x in zip(*spans, strict=True))
            z = sums[w1] - sums[w0] + bias
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            top = 1 + p[:, 1:].argmax(axis=1)
            best: dict[tuple[int, int], tuple] = {}
            hits = np.flatnonzero(p[:, 0] <= 1 - least)
            for i in sorted(hits, key=lambda i: w0[i]):
                q, f = int(para[i]), int(top[i])
                same, word = confirm(h, int(w0[i]), int(w1[i]), int(p_bounds[q]), int(p_bounds[q + 1]), sets[CLASSES[f]])
                got = (same, float(p[i, f]), word)
                if (q, f) not in best or got[:2] > best[q, f][:2]:
                    best[q, f] = got
            rows = sorted(best)
            line = np.array([np.searchsorted(bounds, best[x][2], "right") - 1 for x in rows], np.int64)
            doc = doc_of[line] if len(line) else line
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(doc)), pa.array(line - lb[doc]), pa.array([CLASSES[f] for _, f in rows], pa.string()), pa.array([best[x][1] for x in rows], pa.float64()), pa.array([best[x][0] for x in rows], pa.float64()), pa.array([best[x][0] >= alike for x in rows], pa.bool_())],
                names=["doc_id", "paragraph", "family", "probability", "similarity", "confirmed"],
            )

    return texts.mapInArrow(run, "doc_id long, paragraph long, family string, probability double, similarity double, confirmed boolean")
