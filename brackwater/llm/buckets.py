"""From the buckets of a locality-sensitive hash to the pairs that are worth verifying.

A bucket of thousands of copies has millions of pairs, of which a few thousand settle
the group. So a pair is left out where both of its members are surely copies of one
leader of the bucket; every other pair that may hold is given. Buckets come to a task
whole, sorted, and pairs are judged by arrays, never one at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SMALL = 48
CHUNK = 1 << 16
Judge = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _fan(first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, value): for each k the many[k] numbers from first[k] on."""
    owner = np.repeat(np.arange(len(many)), many)
    return owner, np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())


def small_pairs(starts: np.ndarray, sizes: np.ndarray, judge: Judge) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of buckets of few rows, all at once."""
    cost = np.cumsum(sizes * (sizes - 1) // 2)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(cost, (cost[a - 1] if a else 0) + CHUNK, "right")))
        of, rows = _fan(starts[a:b], sizes[a:b])
        end = (starts[a:b] + sizes[a:b])[of]
        k, j = _fan(rows + 1, end - rows - 1)
        i = rows[k]
        leads = i == starts[a:b][of[k]]
        may, sure = judge(i, j)
        tied = np.zeros(int(rows[-1]) + 1 - int(rows[0]), bool)
        tied[j[leads & sure] - rows[0]] = True
        keep = may & (leads | ~(tied[i - rows[0]] & tied[j - rows[0]]))
        yield i[keep], j[keep]
        a = b


def large_pairs(start: int, size: int, judge: Judge) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of one bucket: leaders and who is surely tied to them, then the pairs across what they tie."""
    left = np.arange(start, start + size)
    units, singles = [], []
    poor = 0
    while len(left) and poor < 64:  # when leaders tie few, what is left is taken one by one
        leader, rest = left[0], left[1:]
        tied = []
        for a in range(0, len(rest), CHUNK):
            part = rest[a : a + CHUNK]
            may, sure = judge(np.full(len(part), leader), part)
            yield np.full(int((sure & may).sum()), leader), part[sure & may]
            tied.append(sure)
        sure = np.concatenate(tied) if tied else np.zeros(0, bool)
        poor = 0 if sure.sum() * 100 > len(rest) else poor + 1
        if sure.any():
            units.append(np.concatenate([[leader], rest[sure]]))
        else:
            singles.append(leader)
        left = rest[~sure]
    alone = np.concatenate([np.array(singles, np.int64), left])
    rows = np.concatenate([*units, alone]) if units else alone
    bounds = np.cumsum([len(u) for u in units]).astype(np.int64)
    # row r meets all rows behind its unit
    behind = np.concatenate([np.repeat(bounds, [len(u) for u in units]) if units else np.zeros(0, np.int64), len(rows) - len(alone) + np.arange(1, len(alone) + 1)])
    many = len(rows) - behind
    total = np.cumsum(many)
    a = 0
    while a < len(rows):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + CHUNK, "right")))
        k, at = _fan(behind[a:b], many[a:b])
        for c in range(0, len(k), CHUNK):
            i, j = rows[a + k[c : c + CHUNK]], rows[at[c : c + CHUNK]]
            may, _ = judge(np.minimum(i, j), np.maximum(i, j))
            yield i[may], j[may]
        a = b


def bucket_pairs(batches: Iterator[pa.RecordBatch], judge_of: Callable[[pa.RecordBatch], Judge], set_size: int | None = None) -> Iterator[pa.RecordBatch]:
    """(a, b) of rows (key, node, ...) sorted by key: the pairs of nodes in one bucket that may hold, a before b in it.

    judge_of() gives, for some rows, the function that says of row pairs which may hold
    and which surely do. A pair that several buckets have comes as often, or, where
    ``set_size`` is the column of the nodes' sizes, as (a, b, n, many): a is the larger
    node, n the size of the smaller, and many says in how many buckets they are.
    """
    held: list[pa.RecordBatch] = []

    def settle(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        key, node = part.column(0).to_numpy(), part.column(1).to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        judge = judge_of(part)
        few = sizes <= SMALL

        def every() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            yield from small_pairs(starts[few & (sizes > 1)], sizes[few & (sizes > 1)], judge)
            for k in np.flatnonzero(~few):
                yield from large_pairs(int(starts[k]), int(sizes[k]), judge)

        for i, j in every():
            if len(i):
                if set_size is not None:
                    n = part.column(set_size).to_numpy()
                    swap = (n[i] < n[j]) | ((n[i] == n[j]) & (node[i] < node[j]))
                    i, j = np.where(swap, j, i), np.where(swap, i, j)
                    _, at, many = np.unique(np.stack([node[i], node[j]]), axis=1, return_index=True, return_counts=True)
                    i, j = i[at], j[at]
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (node[i], node[j], n[j], many)], ["a", "b", "n", "many"])
                    continue
                pairs = np.unique(np.stack([node[np.minimum(i, j)], node[np.maximum(i, j)]]), axis=1)
                pairs = pairs[:, pairs[0] != pairs[1]]
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if len(parts) > 1 else parts[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        cut = int(np.searchsorted(key, key[-1])) if key[0] <= key[-1] else 0  # where the last bucket begins
        if cut:
            yield from settle(joined([*held, batch.slice(0, cut)]))
            held = [batch.slice(cut)]
        elif held and held[-1].column(0)[0].as_py() != key[0]:
            yield from settle(joined(held))
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield from settle(joined(held))
