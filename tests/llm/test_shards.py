import random

import numpy as np

from brackwater.llm import shards


def least_capacity(sizes, k):
    """By dynamic programming over every cut."""
    n = len(sizes)
    run = [0]
    for s in sizes:
        run.append(run[-1] + s)
    best = [0] + [float("inf")] * n
    for _ in range(k):
        best = [0] + [min(max(best[j], run[i] - run[j]) for j in range(i + 1)) for i in range(1, n + 1)]
    return best[n]


def test_capacity_is_the_least_and_groups_stay_whole(docs_of):
    d = random.Random(3)
    texts = ["t" * d.randint(0, 300) + str(k) for k in range(60)]
    rows = [(k, d.choice(texts) if k % 3 == 0 else texts[k % 60]) for k in range(200)]
    for count in (1, 3, 7, 64):
        got = shards.assign(docs_of(rows), count).collect()
        assert len(got) == len(rows)
        groups = {}
        for r in got:
            groups.setdefault(r.first_id, set()).add((r.group_bytes, r.shard))
        assert all(len(g) == 1 for g in groups.values())
        order = [next(iter(groups[f])) for f in sorted(groups)]
        capacity = got[0].capacity
        assert capacity == least_capacity([s for s, _ in order], count)
        placed = [s for _, s in order]
        assert placed == sorted(placed) and placed[-1] < count  # contiguous
        loads = {}
        for size, shard in order:
            loads[shard] = loads.get(shard, 0) + size
        assert max(loads.values()) <= capacity


def test_blocks_hold_any_number_of_groups(docs_of, monkeypatch):
    monkeypatch.setattr(shards, "BLOCK", 4)
    monkeypatch.setattr(shards, "BLOCKS_HELD", 2)
    rows = [(k, "x" * (k % 7) + str(k)) for k in range(90)]
    got = sorted((r.first_id, r.group_bytes, r.shard, r.capacity) for r in shards.assign(docs_of(rows), 5).collect())
    assert got[0][3] == least_capacity([g[1] for g in got], 5)


def test_few_reads_find_the_capacity():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 5000, 40_000)
    sizes[7] = 900_000
    blocks = np.array_split(sizes, 400)
    reads = []

    def fetch(wanted):
        reads.append(wanted)
        return {k: blocks[k] for k in wanted}

    held = shards.Sizes(np.array([b.sum() for b in blocks]), np.array([len(b) for b in blocks]), fetch)
    capacity = shards.smallest_capacity(held, int(sizes.max()), 64)

    def shards_for(c):
        used, load = 1, 0
        for x in sizes.tolist():
            used, load = (used, load + x) if load + x <= c else (used + 1, x)
        return used

    assert shards_for(capacity) <= 64 < shards_for(capacity - 1)
    assert len(reads) < 40


def test_odd_rows(docs_of, clash):
    rows = [(1, None), (2, None), (3, ""), (None, "abc"), (4, "abc"), (5, "de"), (5, "de"), (6, "ü")]
    long = [(1, "x" * 3_000_000), (2, "a"), (3, "b"), (4, "x" * 3_000_000), (5, "c")]
    assert [(r.doc_id, r.shard, r.capacity) for r in shards.assign(docs_of(long), 2).orderBy("doc_id").collect()] == [(1, 0, 6_000_000), (2, 1, 6_000_000), (3, 1, 6_000_000), (4, 0, 6_000_000), (5, 1, 6_000_000)]
    got = {(r.doc_id, r.first_id, r.group_bytes) for r in shards.assign(clash(docs_of(rows)), 3).collect()}
    assert got == {(1, 1, 0), (2, 1, 0), (3, 3, 0), (None, None, 6), (4, None, 6), (5, 5, 4), (6, 6, 2)}
    assert shards.assign(docs_of(rows)).count() == 8
    assert shards.assign(docs_of(rows).where("false")).count() == 0
