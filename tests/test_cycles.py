"""Blocks, spectra, flows, matchings and classes on small graphs with known answers."""

from __future__ import annotations

import math
import random
from itertools import combinations

import pytest

from sparkweave.errors import Invalid
from sparkweave.model import Graph
from sparkweave.operators import blocks, classes, flows, matrices
from sparkweave.sources.tables import CHAINS


def test_two_triangles_at_one_node_are_two_blocks(spark):
    g = Graph.rows(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("c", "e"), ("e", "f")])
    assert sorted(r["id"] for r in blocks.cut_nodes(g).collect()) == ["c", "e"]
    assert [tuple(r) for r in blocks.bridges(g).collect()] == [("e", "f")]
    assert {r["block"] for r in blocks.blocks(g).collect()} == {"a|b", "c|d", "e|f"}
    assert blocks.blocks(Graph.rows(spark, [], nodes=["x"])).count() == 0


def test_second_tree_equals_all_trees(spark):
    edges = [("a", "b", 1), ("b", "c", 2), ("c", "d", 4), ("a", "d", 5), ("a", "c", 2.5), ("b", "d", 7)]

    def joins(pick):
        group = {n: n for n in "abcd"}
        for s, d, _ in pick:
            old, new = group[s], group[d]
            group = {k: new if v == old else v for k, v in group.items()}
        return len(set(group.values())) == 1

    totals = sorted(sum(e[2] for e in p) for p in combinations(edges, 3) if joins(p))
    assert tuple(blocks.second_tree(Graph.rows(spark, edges)).first()) == (totals[0], totals[1])


def test_readings_of_named_shapes(spark):
    square = Graph.rows(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("a", "d")])
    assert matrices.tree_counts(square).first()["n_trees"] == 4
    assert sorted(round(r["value"], 6) + 0.0 for r in matrices.laplacian_spectrum(square).collect()) == [0, 2, 2, 4]
    assert matrices.energy(square).first()["energy"] == pytest.approx(4)
    assert {round(r["resistance"], 6) for r in matrices.resistances(square).collect()} == {0.75}
    assert {(r["a"] + r["b"]): round(r["commute"], 6) for r in matrices.commute_times(square).collect()}["ac"] == 8.0
    k5 = Graph.rows(spark, [(str(i), str(j)) for i in range(5) for j in range(i)], nodes=["lonely"])
    assert {r["component"]: r["n_trees"] for r in matrices.tree_counts(k5).collect()} == {"0": 125, "lonely": 1}


def test_flow_equals_the_least_cut_of_random_networks(spark):
    rng = random.Random(4)
    arcs = [(str(i), str(j), rng.randint(1, 9)) for i in range(6) for j in range(6) if i != j and rng.random() < 0.45]
    g = Graph.rows(spark, arcs, directed=True, nodes=[str(i) for i in range(6)])
    sent, _ = flows.maximum_flow(g, "0", "5")
    value = sum(r["flow"] * (r["src"] == "0") - r["flow"] * (r["dst"] == "0") for r in sent.collect())
    cuts = [sum(w for a, b, w in arcs if a in s and b not in s) for k in range(5) for m in combinations("1234", k) for s in [{"0", *m}]]
    assert value == min(cuts) == sum(r["w"] for r in flows.minimum_cut(g, "0", "5").collect())
    with pytest.raises(Invalid):
        flows.maximum_flow(g, "0", "0")


def test_matching_equals_all_subsets(spark):
    rng = random.Random(7)
    for _ in range(2):
        edges = sorted({(f"l{rng.randrange(5)}", f"r{rng.randrange(5)}") for _ in range(11)})
        best = max(k for k in range(6) for p in combinations(edges, k) if len({x for x, _ in p}) == k == len({y for _, y in p}))
        got = [tuple(r) for r in flows.matching(spark.createDataFrame(edges, "l string, r string")).collect()]
        assert set(got) <= set(edges) and len(got) == best == len({x for x, _ in got}) == len({y for _, y in got})


def test_greedy_colours_in_order_and_chordal_rounds(spark):
    rng = random.Random(9)
    edges = [(i, j) for i in range(12) for j in range(i) if rng.random() < 0.35]
    near = {str(i): set() for i in range(12)}
    for i, j in edges:
        near[str(i)].add(str(j))
        near[str(j)].add(str(i))
    want = {}
    for n in sorted(near, key=lambda n: (-len(near[n]), n)):
        want[n] = next(c for c in range(12) if c not in {want.get(x) for x in near[n]})
    assert {r["id"]: r["colour"] for r in classes.colouring(Graph.rows(spark, edges, nodes=list(near))).collect()} == want
    cycle = Graph.rows(spark, [(i, (i + 1) % 5) for i in range(5)])
    assert classes.elimination(cycle).count() == 0
    assert classes.INDUCED_PATHS(cycle).count() == 5
    assert math.isclose(sum(r["value"] for r in matrices.adjacency_spectrum(cycle).collect()), 0, abs_tol=1e-9)


def test_chains_are_joined_by_the_place_of_the_other_end(spark):
    """a run's customers are not compared in pairs; the rows are those of the text."""
    rows = spark.range(400).selectExpr("id AS c_custkey", "CAST(id % 2 AS INT) AS c_nationkey", "'a' AS c_mktsegment")
    found = spark.sql(CHAINS.plan, customer=rows)
    assert sorted(found.collect()) == sorted(spark.sql(CHAINS.text, customer=rows).collect())
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert len(joins) == 1 and "(r#" in joins[0] and " OR " not in joins[0]


def test_components_that_share_a_call_are_solved_apart(spark, monkeypatch):
    """small components share calls; answers are those of each alone."""
    edges = [(f"p{i}.{j}", f"p{i}.{j + 1}") for i in range(30) for j in range(1 + i % 4)] + [("x", "y"), ("y", "z"), ("x", "z")]
    graph = Graph.rows(spark, edges, nodes=["lonely"])
    plan = matrices.tree_counts(graph)
    assert "__call" in plan._jdf.queryExecution().optimizedPlan().toString()
    trees = {r["component"]: r["n_trees"] for r in plan.collect()}
    assert trees == {"lonely": 1, "x": 3} | {f"p{i}.0": 1 for i in range(30)}
    monkeypatch.setattr(matrices, "CELLS", 1)
    assert {r["component"]: r["n_trees"] for r in matrices.tree_counts(graph).collect()} == trees
    ends = {r["component"]: round(r["value"], 6) for r in matrices.laplacian_spectrum(graph).where("k = 1").collect()}
    assert ends["x"] == 3 and ends["p0.0"] == 2 and ends["p1.0"] == 1 and "lonely" not in ends
