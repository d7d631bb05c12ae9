"""Licence scan: a trained paragraph classifier, confirmed against templates.

A paragraph is a line that holds a word, or a run of lines that were wrapped: lines
without a blank one between them, of which each but the last ends without the mark of
a sentence's end. A softmax regression over hashed word 1- and 2-grams that occur in
licence templates tells the families and an unknown class apart. It is trained on
perturbed windows of the templates against paragraphs of the corpus, at most
``background``, chosen by their hashes. A temperature fitted on held-out paragraphs
calibrates the probabilities. A family stands when it is likelier than all else
together and enough of a template's word pairs is in the paragraph, or of the
paragraph's in a template. A run stands for its lines where it holds more of the
templates than any of them; neighbouring statements of one family are one.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brackwater.llm import words as W
from brackwater.sources.shared import spread

BACKGROUND = 2000
BITS = 18
CONFIRM = 0.6
LEAST_WORDS = 8
ENDS, QUOTES, SPACES = (np.isin(np.arange(256), list(marks)) for marks in (b".!?", b"\"')]", b" \t\v\f\r\n"))

#: Notices by which texts state their licence, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "SPDX-License-Identifier: MIT",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Released under the Apache 2.0 license.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "BSD": (
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD 2-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "ISC": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
        "SPDX-License-Identifier: ISC",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 2.",
        "Released under the GPL version 3 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "LGPL": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "See the GNU Lesser General Public License for more details.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "SPDX-License-Identifier: LGPL-3.0-only",
    ),
    "AGPL": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "See the GNU Affero General Public License for more details.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "EPL": (
        "Licensed under the Eclipse Public License, version 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "CDDL": (
        "Licensed under the Common Development and Distribution License, version 1.0.",
        "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: CDDL-1.0",
    ),
    "Zlib": (
        "Released under the zlib license.",
        "This software is provided 'as-is', without any express or implied warranty.",
        "In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
        "SPDX-License-Identifier: Zlib",
    ),
    "Boost": (
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software.",
        "SPDX-License-Identifier: BSL-1.0",
    ),
    "Artistic": (
        "Released under the Artistic License 2.0.",
        "This is free software, licensed under The Artistic License 2.0 (GPL Compatible).",
        "This program is free software; you can redistribute it and/or modify it under the same terms as Perl itself.",
        "SPDX-License-Identifier: Artistic-2.0",
    ),
    "EUPL": (
        "Licensed under the European Union Public Licence, version 1.2.",
        "Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission, subsequent versions of the EUPL (the \"Licence\"); you may not use this work except in compliance with the Licence.",
        "SPDX-License-Identifier: EUPL-1.2",
    ),
    "OFL": (
        "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of the Font Software, to use, study, copy, merge, embed, modify, redistribute, and sell modified and unmodified copies of the Font Software.",
        "SPDX-License-Identifier: OFL-1.1",
    ),
    "PSF": (
        "Licensed under the Python Software Foundation License, version 2.",
        "PSF hereby grants Licensee a nonexclusive, royalty-free, world-wide license to reproduce, analyze, test, perform and/or display publicly, prepare derivative works, distribute, and otherwise use Python alone or in any derivative version.",
        "SPDX-License-Identifier: PSF-2.0",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "CC-BY-ND": (
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-ND-4.0",
    ),
    "CC0": (
        "Released under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ),
    "WTFPL": (
        "Released under the Do What The Fuck You Want To Public License.",
        "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
        "SPDX-License-Identifier: WTFPL",
    ),
    "Proprietary": (
        "All rights reserved.",
        "Copyright. All rights reserved. No part of this work may be reproduced without the prior written permission of the publisher.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
    ),
}
FAMILIES = list(TEMPLATES)
#: Sentences that speak of such things and are no licence.
OTHER = (
    "You need a license to drive a car in this country.",
    "The city licensed two new markets under the terms of the general plan.",
    "He released the first version of the program in public.",
    "The right to copy is reserved for all members of the public.",
    "Copyright is a right that the law gives to the author of a work.",
    "Version 2.0 of the software was released under a new name.",
    "The foundation published a general report on free software.",
    "The library is free and the files are included.",
    "SPDX-License-Identifier: LicenseRef-Internal-7",
    "See the report for more details.",
)


@dataclass(frozen=True)
class Model:
    """Rows of weights for the features that count, the bias, the temperature, held-out figures."""

    index: np.ndarray
    weight: np.ndarray  # features x (families + unknown)
    bias: np.ndarray
    temperature: float
    held_out: dict


@dataclass(frozen=True)
class Words:
    """The words of some texts and the lines that hold any: the offset of each line's first word (and the end), its row, its number there, and the run that it is of."""

    hashes: np.ndarray
    first: np.ndarray
    row: np.ndarray
    line: np.ndarray
    run: np.ndarray


def read(array: pa.Array) -> Words:
    """Words, lines and runs of wrapped lines."""
    raw, at = W.folded(array)
    starts, ends, first = W.spans(raw, at, W.WORD_BYTE)
    empty = np.zeros(0, np.int64)
    if not len(starts):
        return Words(np.zeros(0, np.uint64), np.zeros(1, np.int64), empty, empty, empty)
    newlines = np.flatnonzero(raw == 10)
    row = np.repeat(np.arange(len(array)), np.diff(first))
    line = np.searchsorted(newlines, starts) - np.searchsorted(newlines, at[row])
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (line[1:] != line[:-1])]))
    row, line = row[new], line[new]
    # the last mark before the line's end, behind quotes and brackets
    stop = np.append(newlines, raw.size)[np.searchsorted(newlines, starts[new])]
    stop = np.minimum(stop, at[row + 1])
    solid = np.maximum.accumulate(np.where(SPACES[raw], -1, np.arange(raw.size)))
    last = solid[stop - 1]
    last = np.where(QUOTES[raw[last]], solid[np.maximum(last - 1, 0)], last)
    wraps = (row[1:] == row[:-1]) & (line[1:] == line[:-1] + 1) & ~ENDS[raw[last]][:-1]
    return Words(W.span_hashes(raw, starts, ends), np.append(new, len(starts)), row, line, np.cumsum(np.concatenate([[True], ~wraps])) - 1)


def grams(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, paragraph) of the words and word pairs of each paragraph, which begin at these words."""
    shift = np.uint64(64 - BITS)
    pair, of = W.pair_hashes(words, first, 1, 77)
    return np.concatenate([words >> shift, pair >> shift]).astype(np.int64), np.concatenate([np.repeat(np.arange(len(first) - 1), np.diff(first)), of])


def word_list(text: str) -> list[int]:
    """The word hashes of one text."""
    return W.word_hashes(pa.array([text]))[0].tolist()


def similarity(paragraph: list[int], family: str) -> tuple[int, float]:
    """How many word pairs the paragraph shares with the templates that it holds enough of, over those of a family; and the largest share of a template's pairs in it, or of its pairs in a template."""
    own, held, best = set(zip(paragraph, paragraph[1:])), set(), 0.0
    for t in _template_pairs(family):
        both = own & t
        best = max(best, len(both) / len(t))
        if len(both) >= CONFIRM * len(t):
            held |= both
        if len(paragraph) >= LEAST_WORDS:
            best = max(best, len(both) / max(1, len(own)))
    return len(held), best


_pairs: dict[str, list[set]] = {}


def _template_pairs(family: str) -> list[set]:
    if family not in _pairs:
        _pairs[family] = [set(zip(w, w[1:])) for w in map(word_list, TEMPLATES[family])]
    return _pairs[family]


def training_texts(background: list[str], seed: int = 5) -> tuple[list[str], np.ndarray]:
    """Perturbed windows of templates, in and out of other text, and paragraphs that are none."""
    draw = np.random.default_rng(seed)
    plain = [w for p in background for w in p.split()] or ["lorem", "ipsum"]
    texts, labels = [], []

    def noise(k: int) -> list[str]:
        return [plain[int(i)] for i in draw.integers(0, len(plain), k)]

    for c, family in enumerate(FAMILIES):
        for template in TEMPLATES[family]:
            words = template.split()
            for copy in range(40):
                part = words
                if len(words) > 14 and copy % 2:
                    a = int(draw.integers(0, len(words) - 10))
                    part = words[a : a + int(draw.integers(10, len(words) - a + 1))]
                part = [w for w in part if draw.random() > 0.05] if copy % 4 else list(part)
                if copy % 3 == 1:
                    part = noise(int(draw.integers(1, 8))) + part + noise(int(draw.integers(0, 8)))
                texts.append(" ".join(part))
                labels.append(c)
    every = [w for f in FAMILIES for t in TEMPLATES[f] for w in t.split()]
    unknown = [*background, *(o for o in OTHER for _ in range(30))]
    for _ in range(600):  # the words of notices, torn apart
        mixed = [every[int(i)] for i in draw.integers(0, len(every), int(draw.integers(2, 12)))] + noise(int(draw.integers(0, 20)))
        unknown.append(" ".join(mixed[int(i)] for i in draw.permutation(len(mixed))))
    return texts + unknown, np.array(labels + [len(FAMILIES)] * len(unknown))


def fit_texts(background: list[str], epochs: int = 8, rate: float = 0.3, batch: int = 16) -> Model:
    """Adagrad on four fifths, temperature and figures from the last fifth."""
    texts, labels = training_texts(background)
    each = [word_list(t) for t in texts]
    first = np.concatenate([[0], np.cumsum([len(w) for w in each])])
    feature, row = grams(np.array([h for w in each for h in w], np.uint64), first)
    notices = [word_list(t) for f in FAMILIES for t in TEMPLATES[f]]
    known = np.unique(grams(np.array([h for w in notices for h in w], np.uint64), np.concatenate([[0], np.cumsum([len(w) for w in notices])]))[0])
    place = np.minimum(np.searchsorted(known, feature), len(known) - 1)
    hit = known[place] == feature
    x = np.zeros((len(texts), len(known) + 1), np.float32)
    x[row[hit], place[hit]] = 1
    x[:, -1] = 0.3  # the bias learns more slowly
    k = len(FAMILIES) + 1
    weight, squares = np.zeros((x.shape[1], k), np.float32), np.full((x.shape[1], k), 1e-6, np.float32)
    order = np.argsort(W.stream(3, len(texts)))
    held, train = order[::5], np.delete(order, np.arange(0, len(order), 5))
    for epoch in range(epochs):
        mixed = train[np.argsort(W.stream(50 + epoch, len(train)))]
        for a in range(0, len(mixed), batch):
            part = mixed[a : a + batch]
            z = x[part] @ weight
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), labels[part]] -= 1
            g = x[part].T @ p
            squares += g * g
            weight -= rate * g / np.sqrt(squares)
    z, y = x[held] @ weight, labels[held]

    def loss(t: float) -> float:
        s = z / t - (z / t).max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    temperature = float(min(np.geomspace(0.25, 8, 41), key=loss))
    figures = {"rows": len(texts), "accuracy": float((z.argmax(axis=1) == y).mean()), "loss": loss(temperature)}
    return Model(known, weight[:-1], weight[-1] * np.float32(0.3), temperature, figures)


def fit(docs: DataFrame, background: int = BACKGROUND) -> Model:
    """Fit with at most ``background`` lines, of as many documents of the corpus, as the unknown class.

    Both are chosen by their hashes and taken whole. Paragraphs that hold four fifths of a template are
    left out of it. Null texts give none.
    """
    # so many rows have a hash in this share of all hashes, that each task gives few texts to choose from
    share = min(1.0, (background + 10 * math.isqrt(background) + 10) / max(1, docs.count()))
    low = F.pmod(F.xxhash64("text"), F.lit(1 << 32)) <= F.lit(int(share * (1 << 32)))
    kept = docs.select("text").where("text is not null").where(low).orderBy(F.xxhash64("text"), "text").limit(background)
    paragraphs = kept.select(F.explode(F.split("text", "\n")).alias("p")).where(F.length(F.trim("p")) > 0).distinct()
    texts = sorted(r.p for r in paragraphs.orderBy(F.xxhash64("p"), "p").limit(background).collect())
    return fit_texts([t for t in texts if max(similarity(word_list(t), f)[1] for f in FAMILIES) < 0.8])


def judged(words: np.ndarray, first: np.ndarray, model: Model, place: np.ndarray) -> dict[int, tuple[str, float, int, float]]:
    """paragraph -> (family, probability, pairs shared with templates, similarity) of those that the classifier and the templates take for a licence."""
    feature, paragraph = grams(words, first)
    at = place[feature]
    hit = np.flatnonzero(at >= 0)
    if not len(hit):
        return {}
    cells = np.unique(paragraph[hit] << 32 | at[hit])
    of, column = cells >> 32, cells & 0xFFFFFFFF
    cut = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    z = (np.add.reduceat(model.weight[column], cut, axis=0) + model.bias) / model.temperature
    z = np.exp(z - z.max(axis=1, keepdims=True))
    p = z / z.sum(axis=1, keepdims=True)
    best = p[:, :-1].argmax(axis=1)
    found = {}
    for k in np.flatnonzero(p[np.arange(len(p)), best] > 0.5):
        par = int(of[cut[k]])
        held, like = similarity(words[first[par] : first[par + 1]].tolist(), FAMILIES[best[k]])
        if like >= CONFIRM:
            found[par] = (FAMILIES[best[k]], float(p[k, best[k]]), held, like)
    return found


def touched(words: list[int], first: list[int], family: str) -> tuple[int, int]:
    """The first and the last line that holds a word of a pair of the family's templates that the lines hold enough of."""
    pairs = list(zip(words, words[1:]))
    share = [(len(t.intersection(pairs)) / len(t), t) for t in _template_pairs(family)]
    enough = min(CONFIRM, max(s for s, _ in share))
    known = set().union(*(t for s, t in share if s >= enough))
    at = [k for k, pair in enumerate(pairs) if pair in known]
    return bisect_right(first, at[0]) - 1, bisect_right(first, at[-1] + 1) - 1


def scan_batch(array: pa.Array, model: Model, place: np.ndarray) -> list[tuple[int, int, int, str, float, float]]:
    """(row, line, lines, family, probability, similarity) of the statements of a licence."""
    w = read(array)
    if not len(w.hashes):
        return []
    by_line = judged(w.hashes, w.first, model, place)
    cut = np.flatnonzero(np.concatenate([[True], w.run[1:] != w.run[:-1]]))
    end = np.append(cut[1:], len(w.run))
    many = np.flatnonzero(end - cut > 1)
    # runs of several lines only, each a paragraph of its own
    bounds = np.stack([w.first[cut[many]], w.first[end[many]]], axis=1)
    inside = np.zeros(len(w.hashes) + 1, np.int64)
    np.add.at(inside, bounds[:, 0], 1)
    np.add.at(inside, bounds[:, 1], -1)
    by_run = judged(w.hashes[np.cumsum(inside[:-1]) > 0], np.concatenate([[0], np.cumsum(bounds[:, 1] - bounds[:, 0])]), model, place) if len(many) else {}
    spans = {k: (k, *found) for k, found in by_line.items()}  # first line -> (last line, family, ...)
    for r, found in by_run.items():
        a, b = int(cut[many[r]]), int(end[many[r]])
        if found[2] > max((by_line[k][2] for k in range(a, b) if k in by_line), default=0):
            for k in range(a, b):
                spans.pop(k, None)
            words = w.hashes[w.first[a] : w.first[b]].tolist()
            lo, hi = touched(words, (w.first[a:b] - w.first[a]).tolist(), found[0])
            spans[a + lo] = (a + hi, *found)
    out: list[list] = []
    for k in sorted(spans):
        last, family, p, _, s = spans[k]
        if out and out[-1][0] == w.row[k] and out[-1][3] == family and out[-1][6] == k - 1:
            old = out[-1]
            old[2], old[4], old[5], old[6] = int(w.line[last]) - old[1] + 1, max(old[4], p), max(old[5], s), last
        else:
            out.append([int(w.row[k]), int(w.line[k]), int(w.line[last] - w.line[k]) + 1, family, p, s, last])
    return [tuple(o[:6]) for o in out]


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, line, lines, family, probability, similarity) of each statement of a licence: its first line from 0, and how many lines it spans.

    Null and empty texts state none, very long ones are read whole. Of families of one
    probability the first of FAMILIES is taken. Null ids and repeated rows are carried
    along, an empty table gives an empty result, other columns are not read.
    """
    W.bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kinds = [("line", T.IntegerType()), ("lines", T.IntegerType()), ("family", T.StringType()), ("probability", T.DoubleType()), ("similarity", T.DoubleType())]
    out = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(*k) for k in kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        place = np.full(1 << BITS, -1, np.int64)
        place[m.index] = np.arange(len(m.index))
        for batch in batches:
            for a, b in W.slices(batch.column(1)):
                found = scan_batch(batch.column(1).slice(a, b - a), m, place)
                if found:
                    row, line, many, family, p, s = zip(*found)
                    own = batch.column(0).slice(a, b - a).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([own, pa.array(line, pa.int32()), pa.array(many, pa.int32()), pa.array(family), pa.array(p), pa.array(s)], out.names)

    return docs.select("doc_id", "text").mapInArrow(run, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence statements in the whole documents table."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    return scan(docs, fit(docs))
