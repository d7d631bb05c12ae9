import random

import numpy as np
import pyarrow as pa

from brackwater.llm import decontaminate as D
from brackwater.llm import words as W


def hashed(text):
    return W.word_hashes(pa.array([text]))[0]


def plain_distance(item, text):
    """Least edits of item to any passage of text, by the textbook."""
    row = [0] * (len(text) + 1)
    for t in item:
        new = [row[0] + 1]
        for j, u in enumerate(text):
            new.append(min(row[j] + (t != u), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def edit(words, k, seed):
    d, out = random.Random(seed), list(words)
    for _ in range(k):
        at = d.randrange(len(out))
        kind = d.randrange(3)
        if kind == 0:
            out[at] = f"edit{d.randrange(999)}"
        elif kind == 1:
            out.insert(at, f"more{d.randrange(999)}")
        else:
            del out[at]
    return out


def test_distance_is_the_textbook_one():
    rng = np.random.default_rng(1)
    for _ in range(30):
        item, text = (rng.integers(1, 6, n).astype(np.uint64) for n in (8, 40))
        assert D.best_match(item, text)[0] == plain_distance(item.tolist(), text.tolist())


def test_found_items_are_those_of_brute_force(spark, docs_of, words):
    items = [(k, " ".join(words(6 + 3 * k, 300 + k))) for k in range(30)]
    rows = []
    for k in range(90):
        text = words(150, 900 + k)
        if k % 2:
            item = items[k % 30][1].split()
            at = random.Random(k).randrange(140)
            text[at:at] = edit(item, int(0.1 * (k % 4) * len(item)), k)
        rows.append((k, " ".join(text)))
    got = {(r.doc_id, r.item_id): r.distance for r in D.find(docs_of(rows), bench(spark, items)).collect()}
    want = {}
    for doc, text in rows:
        for item, it in items:
            x = hashed(it)
            d = D.best_match(x, hashed(text))[0]
            if d <= D.allowed(len(x), D.EDITS):
                want[doc, item] = d
    assert set(got) <= set(want)
    assert len(set(got) & set(want)) >= 0.9 * len(want)
    exact = {p for p, d in want.items() if d == 0}
    assert exact <= set(got)
    left = {r.doc_id for r in D.reject(docs_of(rows), bench(spark, items)).collect()}
    assert left == {doc for doc, _ in rows} - {doc for doc, _ in got}


def test_odd_rows(spark, docs_of, clash):
    items = bench(spark, [(1, "alpha beta gamma delta epsilon"), (1, "alpha beta gamma delta epsilon"), (2, None), (3, ""), (None, "one two three four"), (4, "word")])
    rows = [(1, "so alpha beta gamma delta epsilon it is"), (1, "so alpha beta gamma delta epsilon it is"), (2, None), (3, ""), (None, "one two three four"), (5, "nothing here"), (6, "a word"), (7, "Alpha, BETA; gamma\ndelta epsilon")]
    got = sorted((str(r.doc_id), str(r.item_id)) for r in D.find(docs_of(rows), items).collect())
    assert got == sorted([("1", "1"), ("1", "1"), ("None", "None"), ("6", "4"), ("7", "1")])
    docs = clash(docs_of(rows))
    left = D.reject(docs, items)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 5]


def test_empty_tables(spark, docs_of):
    docs, items = docs_of(["a b c d e"]), bench(spark, [(1, "a b c d e")])
    assert D.find(docs.where("false"), items).count() == 0
    assert D.find(docs, items.where("false")).count() == 0
    assert D.reject(docs, items.where("false")).count() == 1


def test_very_long_text(spark, docs_of, words):
    text = words(60_000, 1)
    item = text[59_900:59_960]
    assert D.find(docs_of([" ".join(text)]), bench(spark, [(9, " ".join(item))])).first().distance == 0


def test_walks_reach_the_recall():
    """Of fresh pairs at the largest distance, not those that the number of walks was chosen by."""
    draw = np.random.default_rng(12345)
    for size in (8, 16, 32, 64, 128):
        walks, k, pairs = D.walks_for(size, D.EDITS, D.RECALL), D.allowed(size, D.EDITS), 200
        if not walks:
            continue
        base = [draw.integers(1, 1 << 62, size).astype(np.uint64) for _ in range(pairs)]
        other = [np.concatenate([D.edited(b, k, draw), draw.integers(1, 1 << 62, size).astype(np.uint64)])[:size] for b in base]
        x, y = (D.walk_keys(np.concatenate(t), np.arange(pairs) * size, size, walks) for t in (base, other))
        assert (x == y).any(axis=1).mean() >= D.RECALL - 0.05, size


def test_long_items_with_many_edits_are_found(words):
    for n in (200, 400, 800):
        k = D.allowed(n, D.EDITS)
        items = [words(n, 4000 + n + t) for t in range(20)]
        index = D.prepare([" ".join(i) for i in items])
        filters = D._filters(index)
        got = 0
        for t, item in enumerate(items):
            text = " ".join(words(150, 5000 + t) + edit(item, k, 6000 + n + t) + words(150, 7000 + t))
            found = D.matches(*W.word_hashes(pa.array([text])), index, filters)
            assert all(i == t and d <= k for _, i, d, _ in found)
            got += len(found)
        assert got >= D.RECALL * len(items), n


def test_walks_are_told_where_they_fall_short():
    for size in (512, 1024):
        assert D.walks_for(size, D.EDITS, D.RECALL) == 0
    assert D.walks_for(16, D.EDITS, D.RECALL) > 0
