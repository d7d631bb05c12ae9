import numpy as np
import pytest

from brackwater.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], SCHEMA)


def brute(x, cosine):
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(float)
    near = u @ u.T >= cosine
    group = np.arange(len(x))
    for _ in range(len(x)):
        new = np.where(near, group[None, :], len(x)).min(axis=1)
        if (new == group).all():
            break
        group = new
    return {k: int(g) for k, g in enumerate(group) if (group == g).sum() > 1}


@pytest.mark.parametrize("dim", [16, 64])
def test_groups_are_those_of_brute_force(spark, dim):
    rng = np.random.default_rng(dim)
    base = rng.normal(size=(300, dim))
    copies = base[rng.integers(0, 300, 150)] + rng.normal(scale=0.08, size=(150, dim))
    many = base[0] + rng.normal(scale=0.05, size=(90, dim))
    x = np.concatenate([base, copies, many, base[:5]]).astype(np.float32)
    got = {r.vec_id: r.group_id for r in embeddings.groups(table(spark, list(enumerate(x.tolist())))).collect()}
    want = brute(x.astype(float), embeddings.COSINE)
    assert set(got) <= set(want)
    assert sum(got.get(k) == g for k, g in want.items()) >= 0.97 * len(want)


def test_odd_rows(spark):
    v, w = [1.0, 2.0, 3.0], [1.0, 2.0, 3.001]
    rows = [(1, v), (1, v), (2, w), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [0.0, 0.0, 0.0]), (7, [1.0, None, 2.0]), (8, [1.0, None, 2.0]),
            (9, [float("inf"), 1.0, 1.0]), (10, [float("nan"), 1.0, 1.0]), (None, v), (11, v + [1.0]), (12, [-1.0, 5.0, 0.0])]
    wide = table(spark, rows).selectExpr("*", "1 as node", "2 as key", "3 as component", "4 as v")
    got = {(r.vec_id, r.group_id, r.kept) for r in embeddings.groups(wide).collect()}
    assert got == {(1, 1, True), (2, 1, False), (None, 1, False)}
    assert embeddings.groups(table(spark, rows).where("false")).count() == 0


def test_tables_follow_the_recall():
    bits, tables = embeddings.layout(1_000_000, 0.95, 0.97)
    same = (1 - np.arccos(0.95) / np.pi) ** bits
    assert 1 - (1 - same) ** tables >= 0.97
