"""Communities and two-sided searches on small graphs with known answers."""

from __future__ import annotations

from itertools import combinations

import pytest

from sparkweave.errors import Missing
from sparkweave.model import Graph
from sparkweave.operators import communities, paths


def _barbell(spark):
    sides = [(a, b) for group in ("abcd", "efgh") for a, b in combinations(group, 2)]
    return Graph.rows(spark, [*sides, ("d", "e")], nodes=["lonely"])


def test_louvain_finds_two_cliques_and_lone_nodes(spark):
    got = {r["id"]: r["community"] for r in communities.louvain(_barbell(spark)).collect()}
    assert got == {**dict.fromkeys("abcd", "a"), **dict.fromkeys("efgh", "e"), "lonely": "lonely"}
    empty = communities.louvain(Graph.rows(spark, [], nodes=["x", "y"]))
    assert sorted(map(tuple, empty.collect())) == [("x", "x"), ("y", "y")]


def test_the_busiest_edge_goes_first(spark):
    steps, best = communities.girvan_newman(_barbell(spark), 2)
    first = steps.orderBy("step").first()
    assert (first["src"], first["dst"], first["betweenness"]) == ("d", "e", 16.0)
    assert first["modularity"] == pytest.approx(12 / 13 - 2 * 13**2 / (4 * 13**2), abs=1e-6)
    assert {r["id"]: r["community"] for r in best.collect()}["h"] == "e"
    assert communities.girvan_newman(Graph.rows(spark, [], nodes=["x"]))[0].count() == 0


def test_shares_over_edges_add_up_to_all_distances(spark):
    graph = _barbell(spark)
    total = sum(r["betweenness"] for r in communities.edge_betweenness(graph).collect())
    assert total == pytest.approx(paths.all_pairs(graph).where("src < dst").agg({"dist": "sum"}).first()[0])


def test_two_sides_meet_on_a_shortest_route(spark):
    ring = Graph.rows(spark, [(f"n{i}", f"n{(i + 1) % 9}") for i in range(9)], True)
    assert communities.two_sided(ring, "n2", "n1").first()["hops"] == 8
    assert communities.two_sided(ring, "n4", "n4").first()["hops"] == 0
    parted = Graph.rows(spark, [("a", "b"), ("c", "d")])
    assert communities.two_sided(parted, "a", "d").count() == 0
    with pytest.raises(Missing):
        communities.two_sided(parted, "a", "z")
