"""Chains, rings and lists that are larger than what is done without contraction first."""

import random

import pytest
from pyspark.sql import functions as F

from sparkweave.model import Graph
from sparkweave.operators import orders
from sparkweave.operators.cohesion import spanning_forest
from sparkweave.operators.trails import undirected_trails
from sparkweave.plans import components


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(components, "FEW", 60)
    monkeypatch.setattr(orders, "FEW", 60)


def _writes(monkeypatch, module):
    """Names and rows of the tables that a module writes."""
    seen, write = [], module.materialise

    def noted(df, name):
        made = write(df, name)
        seen.append((name, made.count()))
        return made

    monkeypatch.setattr(module, "materialise", noted)
    return seen


def _mixed():
    """A chain, a ring and a star whose names are shuffled, with their components."""
    names = [f"n{i:03d}" for i in range(240)]
    random.Random(5).shuffle(names)
    chain, ring, star = names[:100], names[100:180], names[180:]
    edges = list(zip(chain, chain[1:])) + list(zip(ring, ring[1:] + ring[:1])) + [(star[0], x) for x in star[1:]]
    return edges, {n: min(part) for part in (chain, ring, star) for n in part}


def test_components_of_contracted_edges(spark, small, monkeypatch):
    edges, expected = _mixed()
    seen = _writes(monkeypatch, components)
    rows = edges + [(None, "n000"), ("n001", None), ("n002", "n002"), edges[0], edges[0][::-1]]
    found = components.star_components(spark.createDataFrame(rows, "a string, b string"), "a", "b").collect()
    assert len(found) == len(expected)
    assert {r["id"]: r["component"] for r in found} == expected
    # Rounds get smaller: edges of all rounds together are a few times those of the first.
    assert sum(n for name, n in seen if name == "stars") < 3.5 * len(edges)


def test_ranks_of_shortened_lists(spark, small, monkeypatch):
    ids = list(range(400))
    random.Random(7).shuffle(ids)
    lists = [ids[:300], ids[300:399], ids[399:]]
    rows, expected = [], {}
    for one in lists:
        total = 0
        for x, nxt in reversed(list(zip(one, one[1:] + [None]))):
            total += x % 7
            expected[x] = (one[-1], total)
            rows.append((x, nxt, x % 7))
    seen = _writes(monkeypatch, orders)
    found = orders.ranked(spark.createDataFrame(rows, "id long, next long, w long"), "w").collect()
    assert len(found) == 400
    assert {r["id"]: (r["last"], r["w"]) for r in found} == expected
    # Doubling alone writes all elements in each of its rounds.
    assert sum(n for _, n in seen) < 4.5 * len(ids)


def test_lists_that_leave_the_table_and_rings(spark, small):
    away = [(i, i + 1, 1) for i in range(50)]
    ring = [(100 + i, 100 + (i + 1) % 30, 1) for i in range(30)]
    found = {r["id"]: (r["last"], r["w"]) for r in orders.ranked(spark.createDataFrame(away + ring, "id long, next long, w long"), "w").collect()}
    assert {k: v for k, v in found.items() if k < 50} == {i: (49, 50 - i) for i in range(50)}
    assert len(found) == 80


def test_forest_of_a_large_graph(spark, small):
    edges, expected = _mixed()
    weighted = [(a, b, float(i % 9)) for i, (a, b) in enumerate(edges)]
    forest = spanning_forest(Graph.rows(spark, weighted)).collect()
    ring = {tuple(sorted(e[:2])): e[2] for e in weighted[99:179]}
    left = set(ring) - {(r["src"], r["dst"]) for r in forest}
    assert len(forest) == len({(r["src"], r["dst"]) for r in forest}) == 237
    assert left == {max(ring, key=lambda e: (ring[e], e))}


def test_trail_of_a_large_graph(spark, small):
    r = random.Random(3)
    walk = [r.randrange(40) for _ in range(101)]
    steps = spark.createDataFrame([(i, str(a), str(b)) for i, (a, b) in enumerate(zip(walk, walk[1:]))], "id long, src string, dst string")
    trail = undirected_trails(steps).orderBy("position").collect()
    assert sorted(t["id"] for t in trail) == list(range(100))
    assert all(x["dst"] == y["src"] for x, y in zip(trail, trail[1:]))
    assert steps.join(spark.createDataFrame(trail).toDF("c", "p", "id", "s", "d"), "id").where(~((F.col("src") == F.col("s")) & (F.col("dst") == F.col("d")) | (F.col("src") == F.col("d")) & (F.col("dst") == F.col("s")))).isEmpty()
