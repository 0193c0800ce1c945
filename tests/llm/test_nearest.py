import math

import numpy as np
import pytest

from sparkweave.llm import nearest


def brute(queries, candidates, k):
    ok = lambda x: x and all(v is not None and math.isfinite(v) for v in x) and any(x)
    out = []
    for q, x in {i: v for i, v in queries}.items():
        if not ok(x):
            continue
        near = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y, strict=True))), i) for i, y in candidates if ok(y) and i != q and i is not None and len(y) == len(x))[:k]
        out += [(q, r + 1, i, pytest.approx(d, rel=1e-12)) for r, (d, i) in enumerate(near)]
    return sorted(out, key=lambda r: r[:2])


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as n", "2 as ids", "3 as group")


def test_exact_with_ties_nulls_and_other_lengths(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(3000)]
    rows += [(5000 + i, rows[0][1]) for i in range(15)] + [(6000, None), (6001, [0.0] * 16), (6002, [None] * 16), (6003, [float("nan")] * 16), (6004, [1.0, 2.0]), (6100, [1.0, 2.5]), (None, rows[1][1])]
    queries = [r for r in rows if r[0] is not None and r[0] % 100 == 0]
    got = [tuple(r) for r in nearest.search(frame(spark, queries), frame(spark, rows), 10).collect()]
    assert sorted(got) == brute(queries, rows, 10)


def test_fewer_candidates_than_k_and_none(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0])]
    got = [tuple(r)[:3] for r in nearest.search(frame(spark, rows[:1]), frame(spark, rows), 10).collect()]
    assert got == [(0, 1, 1), (0, 2, 1)]
    assert nearest.search(frame(spark, []), frame(spark, rows)).count() == 0
    assert nearest.search(frame(spark, rows[:1]), frame(spark, [])).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(40, 32)) * 3, rng.normal(size=(50, 32))
    (cx, sx, nx, rx), (cy, sy, ny, ry) = nearest.quantise(x), nearest.quantise(y)
    error = nx[:, None] * ry + rx[:, None] * ny + rx[:, None] * ry
    assert (np.abs(x @ y.T - (cx.astype(float) @ cy.astype(float).T) * sx[:, None] * sy) <= error + 1e-9).all()
