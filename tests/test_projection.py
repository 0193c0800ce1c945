"""Projections against brute force, with lists in parts and sums in steps."""

import random

import pytest

from sparkweave.model import Graph
from sparkweave.operators import transforms as t


def brute(ties):
    hubs, want = {}, {}
    for hub, item in set(ties):
        hubs.setdefault(hub, []).append(item)
    for hub, items in hubs.items():
        if hub is not None:
            for a in items:
                for b in items:
                    if a is not None and b is not None and a < b:
                        n, w = want.get((a, b), (0, 0.0))
                        want[a, b] = (n + 1, w + 1 / (len(items) - 1))
    return want


@pytest.mark.parametrize("pairs,part", [(1 << 20, 256), (8, 3)])
def test_shared_hubs(spark, monkeypatch, pairs, part):
    monkeypatch.setattr(t, "PAIRS", pairs)
    monkeypatch.setattr(t, "PART", part)
    monkeypatch.setattr(t, "TASK_PAIRS", 50)
    rng = random.Random(part)
    ties = sorted({(f"h{rng.randrange(30)}", rng.randrange(25)) for _ in range(260)}) + [("h1", None), (None, 3), (None, 4), ("lone", 7)]
    want = brute(ties)
    got = t.shared_hubs(spark.createDataFrame(ties, "hub string, item bigint")).collect()
    assert len(got) == len(want)
    for r in got:
        n, w = want[r["a"], r["b"]]
        assert r["shared"] == n and r["weight"] == pytest.approx(w)


def test_projection_gives_the_rows_of_its_plan(spark):
    rng = random.Random(7)
    edges = sorted({(f"c{rng.randrange(40)}", f"s{rng.randrange(15)}") for _ in range(200)}) + [("c1", "c2"), ("c3", "c3")]
    graph = Graph.rows(spark, edges)
    assert sorted(map(tuple, t.projection(graph, "s%").collect())) == sorted(map(tuple, t.PROJECTION(graph, side="s%").collect()))
    assert t.projection(Graph.rows(spark, [], nodes=["s1"]), "s%").isEmpty()


def test_pairs_are_not_shuffled_one_by_one(spark):
    """A hub of 3,000 items has 4,498,500 pairs; no more rows than its ties in parts are dealt."""
    ties = spark.range(3000).selectExpr("'h' AS hub", "id AS item")
    found = t.shared_hubs(ties)
    assert found.count() == 3000 * 2999 // 2
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow", 1)[1]
