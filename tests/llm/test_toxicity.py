import math
import random

import numpy as np
import pyarrow as pa
import pytest

from brackwater.llm import toxicity


@pytest.fixture(scope="module")
def judged(spark, docs_of, words):
    d = random.Random(5)
    bad = [f"{a} {b}" for a in ("vile", "rotten", "filthy") for b in ("scum", "vermin", "swine")]
    rows, toxic = [], {}
    for k in range(900):
        text = words(d.randint(20, 80), 20_000 + k)
        toxic[k] = k % 5 == 0
        for _ in range(3 if toxic[k] else 0):
            text.insert(d.randrange(len(text)), d.choice(bad))
        rows.append((k, " ".join(text)))
    labels = spark.createDataFrame([(k, 1, int(toxic[k])) for k in range(600)], "doc_id long, quality int, toxic int")
    return docs_of(rows), labels, toxic


def test_documents_that_it_never_saw(judged):
    docs, labels, toxic = judged
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.toxic for r in toxicity.score(docs, model).collect()}
    right = sum(got[k] == toxic[k] for k in range(600, 900))
    assert right >= 0.97 * 300
    assert 0 < len(model.index) < 5000  # few of 2**20 coordinates
    assert model.held_out["accuracy"] >= 0.95


def test_reject_agrees_with_score(judged, clash):
    docs, labels, _ = judged
    model = toxicity.fit(docs, labels)
    wide = clash(docs)
    left = toxicity.reject(wide, model)
    assert left.columns == wide.columns
    scored = toxicity.score(wide, model)
    assert scored.columns == ["doc_id", "toxicity", "toxic"]
    clean = {r.doc_id for r in scored.collect() if not r.toxic}
    assert clean == {r.doc_id for r in toxicity.score(docs, model).collect() if not r.toxic}
    assert {r.doc_id for r in left.select("doc_id").collect()} == clean


def test_the_bound_on_training_rows_is_a_parameter(judged):
    docs, labels, _ = judged
    assert toxicity.fit(docs, labels, max_train=100).held_out["rows"] == 100


def test_odd_rows(spark, judged, docs_of, words):
    docs, labels, _ = judged
    labels = labels.unionAll(spark.createDataFrame([(None, 1, 1), (1, None, None), (0, 1, 0)], labels.schema))
    model = toxicity.fit(docs, labels)
    long = " ".join(words(60_000, 1) + ["vile scum rotten vermin filthy swine vile vermin rotten scum"])
    rows = [(1, None), (2, ""), (3, "x"), (3, "x"), (None, "vile scum, rotten vermin and filthy swine"), (4, long)]
    got = sorted((str(r.doc_id), r.toxic) for r in toxicity.score(docs_of(rows), model).collect())
    assert got == [("1", False), ("2", False), ("3", False), ("3", False), ("4", True), ("None", True)]


def naive_ftrl(examples, labels, bias, epochs, alpha, beta, l1, l2):
    """The published algorithm, coordinate by coordinate."""
    z, n = {}, {}

    def weight(i):
        zi, penalty = z.get(i, 0.0), 0.0 if i == bias else l1
        if abs(zi) <= penalty:
            return 0.0
        return -(zi - math.copysign(penalty, zi)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    for epoch in range(epochs):
        for k in np.argsort(toxicity.W.stream(epoch + 1, len(examples))):
            w = {i: weight(i) for i in examples[k].tolist()}
            g = 1 / (1 + math.exp(-sum(w.values()))) - labels[k]
            for i, wi in w.items():
                old = n.get(i, 0.0)
                n[i] = old + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(old)) / alpha * wi
    return {i: w for i in z if (w := weight(i))}


def test_weights_are_those_of_the_naive_algorithm():
    rng = np.random.default_rng(3)
    bits = 8
    examples = [np.append(np.unique(rng.integers(0, 256, 12)), 256).astype(np.int32) for _ in range(150)]
    labels = np.array([float(e[0] < 12) for e in examples])
    for l2 in (0.0, 0.5):
        w, b = toxicity.ftrl(examples, labels, bits, 3, 0.3, 1.0, 0.8, l2)
        want = naive_ftrl(examples, labels, 256, 3, 0.3, 1.0, 0.8, l2)
        assert math.isclose(b, want.pop(256), rel_tol=1e-9)
        assert set(np.flatnonzero(w).tolist()) == set(want) and 0 < len(want) < 250
        assert all(math.isclose(w[i], x, rel_tol=1e-9) for i, x in want.items())


def test_features_are_words_pairs_and_skip_pairs():
    text = "One two, THREE four five"
    words = toxicity.W.word_hashes(pa.array([w for w in text.split()]))[0]
    index, row = toxicity.features(pa.array([text, None, "", "six"]))
    pairs = [toxicity.W.pair_hashes(words[[i, i + gap]], np.array([0, 2]), 1, gap)[0][0] for gap in (1, 2, 3) for i in range(5 - gap)]
    six = toxicity.W.word_hashes(pa.array(["six"]))[0]
    want = sorted(int(h >> np.uint64(44)) for h in [*words, *pairs])
    assert sorted(index[row == 0].tolist()) == want
    assert index[row == 3].tolist() == [int(six[0] >> np.uint64(44))] and set(row.tolist()) == {0, 3}


def test_repeated_ids_are_one_training_row(judged, clash):
    docs, labels, _ = judged
    model, again = toxicity.fit(docs, labels), toxicity.fit(clash(docs.unionAll(docs).unionAll(docs)), labels)
    assert again.held_out["rows"] == model.held_out["rows"] == 600
    assert np.array_equal(again.index, model.index) and np.allclose(again.weight, model.weight)


def test_no_labels_reject_nothing(judged):
    docs, labels, _ = judged
    for none in (labels.where("false"), labels.where("toxic = 0"), labels.where("toxic = 1")):
        assert toxicity.reject(docs, toxicity.fit(docs, none)).count() == docs.count()
    assert toxicity.score(docs.where("false"), toxicity.fit(docs.where("false"), labels)).count() == 0
