import random
import textwrap

import numpy as np
import pyarrow as pa
import pytest

from brackwater.llm import licences


@pytest.fixture(scope="module")
def fitted(spark, docs_of, words):
    rows = []
    for k in range(200):
        text = [" ".join(words(30, 100 * k + j)) for j in range(4)]
        if k % 4 == 0:
            family = licences.FAMILIES[k // 4 % len(licences.FAMILIES)]
            text.insert(k % 5, licences.TEMPLATES[family][0])
        rows.append((k, "\n".join(text)))
    docs = docs_of(rows)
    return docs, licences.fit(docs)


def test_templates_are_found_where_they_stand(fitted):
    docs, model = fitted
    got = {(r.doc_id, r.line, r.family) for r in licences.scan(docs, model).collect()}
    want = {(k, k % 5, licences.FAMILIES[k // 4 % len(licences.FAMILIES)]) for k in range(0, 200, 4)}
    assert got == want


MIT = " ".join(licences.TEMPLATES["MIT"][k] for k in (3,))
APACHE = " ".join(licences.TEMPLATES["Apache-2.0"][k] for k in (1, 2, 4, 5))
GPL = " ".join(licences.TEMPLATES["GPL"][k] for k in (3, 4, 5))


@pytest.mark.parametrize("family, notice", [("MIT", MIT), ("Apache-2.0", APACHE), ("GPL", GPL)])
@pytest.mark.parametrize("width", [40, 72, 10_000])
def test_wrapped_notices_are_one_statement(fitted, words, family, notice, width):
    before, after = [" ".join(words(9, 900 + k)) for k in range(3)], [" ".join(words(9, 950))]
    own = textwrap.wrap(notice, width)
    for marks in ("", "# ", " * "):
        text = "\n".join([*before, *(marks + x for x in own), *after])
        found = scan_text(text, fitted[1])
        assert [(line, lines, f) for line, lines, f, *_ in found] == [(3, len(own), family)]
        assert found[0][4] == 1.0


def scan_text(text, model):
    place = np.full(1 << licences.BITS, -1, np.int64)
    place[model.index] = np.arange(len(model.index))
    return [f[1:] for f in licences.scan_batch(pa.array([text]), model, place)]


def test_every_notice_is_its_family(fitted):
    wrong = []
    for family in licences.FAMILIES:
        for t in licences.TEMPLATES[family]:
            got = [f for _, _, f, *_ in scan_text(t, fitted[1])]
            if got != [family]:
                wrong.append((family, t, got))
    # what several families share word for word may be told for any of them
    assert len(wrong) <= 0.03 * sum(map(len, licences.TEMPLATES.values())), wrong


def naive(text, model):
    """family and figures of each line, by loops over its words."""
    out = {}
    for n, line in enumerate(text.split("\n")):
        w = licences.word_list(line)
        if not w:
            continue
        pairs = [int(licences.W.pair_hashes(np.array(p, np.uint64), np.array([0, 2]), 1, 77)[0][0]) for p in zip(w, w[1:])]
        columns = {int(np.searchsorted(model.index, h >> 64 - licences.BITS)) for h in [*w, *pairs] if (h >> 64 - licences.BITS) in set(model.index.tolist())}
        if not columns:
            continue
        z = (model.weight[sorted(columns)].sum(axis=0) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        best = int(p[:-1].argmax())
        held, like = licences.similarity(w, licences.FAMILIES[best])
        if p[best] > 0.5 and like >= licences.CONFIRM:
            out[n] = (licences.FAMILIES[best], float(p[best]), like)
    return out


def test_lines_are_those_of_the_naive_way(fitted, words):
    d = random.Random(4)
    every = [t for f in licences.FAMILIES for t in licences.TEMPLATES[f]]
    for k in range(60):
        lines = [" ".join(words(d.randint(1, 12), 60_000 + 10 * k + j)) + "." for j in range(4)]
        lines.insert(d.randint(0, 4), d.choice(every).rstrip(".:") + ".")
        text = "\n".join(lines)
        want = naive(text, fitted[1])
        got = {line: (f, p, s) for line, lines_, f, p, s in scan_text(text, fitted[1])}
        assert got.keys() == want.keys()
        assert all(got[n][0] == want[n][0] and np.allclose(got[n][1:], want[n][1:], atol=1e-5) for n in want)


def test_held_out_paragraphs(fitted):
    assert fitted[1].held_out["accuracy"] >= 0.97
    assert fitted[1].held_out["loss"] < 0.2


def test_changed_notices_and_sentences_that_are_none(docs_of, fitted):
    rows = [
        (1, "this program is free software: you may redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3"),
        (2, "You need a licence to fish here, and the general public is free to watch."),
        (3, "Licensed  under the apache license, version 2.0"),
        (4, "The MIT group held a press conference about permission to build."),
        (5, "SPDX-License-Identifier: ISC"), (6, "// SPDX-License-Identifier: EPL-2.0\nint main()"), (7, "SPDX-License-Identifier: LicenseRef-Own"),
    ]
    got = {r.doc_id: r.family for r in licences.scan(docs_of(rows), fitted[1]).collect()}
    assert got == {1: "GPL", 3: "Apache-2.0", 5: "ISC", 6: "EPL"}


def test_odd_rows(docs_of, fitted, words, clash):
    long = " ".join(words(60_000, 4)) + "\nReleased under the MIT License."
    rows = [(1, None), (2, ""), (3, "\n\n"), (None, "Released under the MIT License."), (4, "Released under the MIT License."), (4, "Released under the MIT License."), (5, long)]
    got = sorted((str(r.doc_id), r.line, r.family) for r in licences.scan(clash(docs_of(rows)), fitted[1]).collect())
    assert got == [("4", 0, "MIT"), ("4", 0, "MIT"), ("5", 1, "MIT"), ("None", 0, "MIT")]
    empty = docs_of(rows).where("false")
    assert licences.scan(empty, licences.fit(empty)).count() == 0
