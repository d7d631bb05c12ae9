import random

import numpy as np
import pyarrow as pa

from brackwater.llm import linededup


def brute(rows, min_words=linededup.MIN_WORDS):
    """doc_id -> lines to drop, by the longest common run of every pair of places."""
    places = []  # in the order of the corpus; one text for each id here
    for doc, text in sorted((r for r in set(rows) if r[1] is not None), key=lambda r: r[0]):
        own = [(n, line.strip()) for n, line in enumerate(text.split("\n")) if line.strip()]
        places += [(doc, i, n, line, own) for i, (n, line) in enumerate(own)]
    drop = {}
    for q, (doc, i, _, line, own) in enumerate(places):
        best = 0
        for doc2, i2, _, line2, own2 in places[:q]:
            if line2 == line:
                n = 0
                while i + n < len(own) and i2 + n < len(own2) and own[i + n][1] == own2[i2 + n][1]:
                    n += 1
                best = max(best, n)
        if best and sum(len(x.split()) for _, x in own[i : i + best]) >= min_words:
            drop.setdefault(doc, set()).update(n for n, _ in own[i : i + best])
    return drop


def line(words, seed, n=12):
    return " ".join(words(n, seed))


def corpus(words):
    d = random.Random(2)
    passage = [[line(words, 100 * p + k) for k in range(6)] for p in range(4)]
    common = [line(words, 7000 + k, 4) for k in range(5)]
    rows = []
    for doc in range(40):
        parts = [line(words, 10_000 + 50 * doc + k) for k in range(d.randint(1, 6))]
        if doc % 3 == 0:
            p = passage[doc % 4]
            a = d.randint(0, 1)
            parts[d.randint(0, len(parts)) : 0] = p[a : 6 - d.randint(0, 1)]
        if doc % 4 == 1:
            parts.insert(0, d.choice(common))  # repeated, but short
        if doc % 11 == 5:
            parts += parts  # within one document
        if doc % 13 == 6:
            parts += [parts[0]] * 12  # overlapping copies
        rows.append((doc, "\n".join(x + ("\n" if d.random() < 0.2 else "") for x in parts)))
    rows += [(40, rows[3][1]), (41, rows[0][1] + "\n")]
    return rows


def test_lines_are_those_of_brute_force(docs_of, words):
    rows = corpus(words)
    got = {r.doc_id: set(r.lines) for r in linededup.repeated_lines(docs_of(rows)).collect()}
    assert got == brute(rows)


def test_rounds_without_a_broadcast(docs_of, words, monkeypatch):
    monkeypatch.setattr(linededup, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(linededup, "FEW_ROWS", 0)
    rows = corpus(words)
    assert {r.doc_id: set(r.lines) for r in linededup.repeated_lines(docs_of(rows)).collect()} == brute(rows)


def naive_runs(places, lcp):
    out = []
    for p in range(len(places)):
        best = 0
        for q in range(len(places)):
            if places[q] < places[p]:
                best = max(best, min(lcp[min(p, q) + 1 : max(p, q) + 1]))
        out.append(best)
    return out


def test_ranges_of_the_array_give_what_the_whole_gives():
    d = random.Random(9)
    for trial in range(300):
        n = d.randint(1, 40)
        places = [(True, k // 3, 0, k) for k in range(n)]
        if trial % 3:
            d.shuffle(places)
        lcp = np.array([0] + [d.choice((0, 1, 1, 2, 5, 9)) for _ in range(n - 1)])
        cuts = sorted(d.sample(range(1, n), d.randint(0, min(5, n - 1)))) if n > 1 else []
        parts = [(places[a:b], lcp[a:b]) for a, b in zip([0, *cuts], [*cuts, n])]
        known = linededup.chains([(k, *linededup.edges(*x)) for k, x in enumerate(parts)])
        got = np.concatenate([linededup.longest_previous(*x, *known[k]) for k, x in enumerate(parts)])
        assert got.tolist() == naive_runs(places, lcp)


def test_many_ranges(docs_of, words):
    rows = corpus(words)
    assert {r.doc_id: set(r.lines) for r in linededup.repeated_lines(docs_of(rows), ranges=7).collect()} == brute(rows)


def test_a_line_that_is_everywhere(docs_of, words):
    """One line is a third of all lines, some of its neighbours repeat too."""
    common, blocks = line(words, 1), ["\n".join(line(words, 10 * b + k) for k in range(3)) for b in range(3)]
    d, rows = random.Random(3), []
    for doc in range(60):
        parts = [line(words, 5000 + 100 * doc + k) for k in range(4)] + [d.choice(blocks)]
        rows.append((doc, "\n".join(x for part in parts for x in (part, common))))
    assert {r.doc_id: set(r.lines) for r in linededup.repeated_lines(docs_of(rows), 40, ranges=5).collect()} == brute(rows, 40)


def test_runs_are_covered_whatever_the_batches():
    d = random.Random(6)
    rows = []
    for doc in range(30):
        n = d.randint(1, 40)
        rows += [(doc, 100 - doc, i, 2 * i, d.randint(1, 9), d.choice((0, 0, 0, d.randint(1, n - i)))) for i in range(n)]
    names = ["doc", "d", "i", "line", "words", "run"]
    want = set()
    for doc, key, i, _, _, run in rows:
        own = [r for r in rows if r[0] == doc and i <= r[2] < i + run]
        if run and sum(r[4] for r in own) >= 20:
            want.update(r[:5] for r in own)
    table = pa.table({n: pa.array([r[k] for r in rows]) for k, n in enumerate(names)})
    for size in (1, 7, 64, 5000):
        got = {tuple(r.values()) for b in linededup.covered(iter(table.to_batches(size)), 20) for r in b.to_pylist()}
        assert got == want and want


def test_other_columns_may_have_any_name(docs_of, words, clash):
    rows = corpus(words)
    got = {r.doc_id: set(r.lines) for r in linededup.repeated_lines(clash(docs_of(rows))).collect()}
    assert got == brute(rows)


def test_dedup_follows_the_lines(docs_of, words, clash):
    rows = corpus(words)
    docs = clash(docs_of(rows))
    left = linededup.dedup(docs)
    assert left.columns == docs.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in left.collect()}
    drop = brute(rows)
    for doc, text in rows:
        kept = [x for n, x in enumerate(text.split("\n")) if n not in drop.get(doc, ())]
        if doc not in drop:
            assert got[doc] == (text, len(text))
        elif any(x.strip() for x in kept):
            assert [x for x in got[doc][0].split("\n") if x.strip()] == [x for x in kept if x.strip()]
            assert got[doc][1] == len(got[doc][0])
        else:
            assert doc not in got


def test_odd_rows(docs_of, words):
    long = "\n".join(line(words, k) for k in range(8))
    rows = [(1, long), (1, long), (2, None), (3, ""), (4, " \n\n"), (None, "solo"), (5, "x\r\n" + long.replace("\n", "\r\n")), (6, long)]
    found = {r.doc_id: r.lines for r in linededup.repeated_lines(docs_of(rows)).collect()}
    assert found == {5: list(range(1, 9)), 6: list(range(8))}  # the repeated row is the first copy itself
    left = sorted(((r.doc_id or -1), r.text or "-") for r in linededup.dedup(docs_of(rows)).collect())
    assert [i for i, _ in left] == [-1, 1, 1, 2, 3, 4, 5]


def test_empty_table_and_one_that_repeats_nothing(docs_of):
    docs = docs_of(["a b c", "d e f"])
    assert linededup.repeated_lines(docs).count() == 0
    assert linededup.dedup(docs).count() == 2
    assert linededup.dedup(docs.where("false")).count() == 0


def test_very_long_repetition(docs_of):
    """One line thousands of times: prefix doubling settles it, and one copy stays."""
    rows = [(0, "\n".join(["the same ten words of one line again and again"] * 3000))]
    got = linededup.repeated_lines(docs_of(rows)).first()
    assert got.lines == list(range(1, 3000))


def test_without():
    assert linededup.without("a\n\nb\n\nc", [2]) == "a\n\nc" or linededup.without("a\n\nb\n\nc", [2]) == "a\n\n\nc"
    assert linededup.without("a\nb", [0, 1]) == ""
