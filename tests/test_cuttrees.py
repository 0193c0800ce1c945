"""Cut trees, edge colourings, orders of little width and samples against enumeration."""

import itertools
import random

import pytest

from sparkweave.errors import Invalid
from sparkweave.model import Graph
from sparkweave.operators import chance, cuttrees, shifts, widths


def cut_weights(names, edges):
    """The lightest cut between every pair, over all sides."""
    best = {}
    for k in range(1, len(names)):
        for side in itertools.combinations(names, k):
            weight = sum(w for a, b, w in edges if (a in side) != (b in side))
            for a, b in itertools.product(side, set(names) - set(side)):
                pair = min(a, b), max(a, b)
                best[pair] = min(weight, best.get(pair, float("inf")))
    return best


@pytest.mark.parametrize(("seed", "at_once"), [(1, 64), (2, 3)])
def test_cut_trees_know_all_pairs(spark, seed, at_once):
    rng = random.Random(seed)
    names = [f"v{i}" for i in range(8)]
    edges = [(a, b, float(rng.randint(1, 9))) for a, b in itertools.combinations(names[:7], 2) if rng.random() < 0.45]
    graph = Graph.rows(spark, edges, nodes=names)
    tree, side = cuttrees.cut_tree(graph, at_once)
    rows = {r["id"]: r for r in tree.collect()}
    assert set(rows) == set(names) and [v for v in names if rows[v]["parent"] is None] == ["v0"]
    want = cut_weights(names, edges)
    assert {(r["a"], r["b"]): r["min_cut"] for r in cuttrees.pair_cuts(tree).collect()} == want
    inside = {r["id"] for r in side.collect()}
    assert 0 < len(inside) < len(names)
    assert sum(w for a, b, w in edges if (a in inside) != (b in inside)) == min(want.values())


def test_lightest_cut_of_two_groups_and_of_nothing(spark):
    groups = [(f"{g}{i}", f"{g}{j}", 5) for g in "ab" for i, j in itertools.combinations(range(4), 2)]
    found, side = cuttrees.lightest_cut(Graph.rows(spark, [*groups, ("a0", "b0", 2), ("a1", "b1", 1)]))
    assert tuple(found.first()) == (3.0, 4, 3.0)
    assert len({r["id"][0] for r in side.collect()}) == 1
    tree, side = cuttrees.cut_tree(Graph.rows(spark, [("a", "a", 3)]))
    assert [tuple(r) for r in tree.collect()] == [("a", None, None)] and side.isEmpty()
    with pytest.raises(Invalid):
        cuttrees.lightest_cut(Graph.rows(spark, [], nodes=["a"]))


def colours_of(spark, edges):
    found = [tuple(r) for r in shifts.edge_colouring(Graph.rows(spark, edges)).collect()]
    assert sorted(r[:2] for r in found) == sorted((min(e), max(e)) for e in edges)
    met = [(v, c) for a, b, c in found for v in (a, b)]
    assert len(met) == len(set(met)) and min(c for *_, c in found) >= 0
    return len({c for *_, c in found})


def busiest(edges):
    return max(sum(v in e for e in edges) for e in edges for v in e)


def test_two_sides_take_as_many_shifts_as_the_busiest_node_has_edges(spark):
    rng = random.Random(5)
    part = [(f"a{i}", f"b{j}") for i in range(6) for j in range(5) if rng.random() < 0.6]
    assert colours_of(spark, part) == busiest(part)


def test_other_graphs_are_coloured_near_their_degree(spark):
    rng = random.Random(6)
    names = [f"v{i}" for i in range(6)]
    edges = [e for e in itertools.combinations(names, 2) if rng.random() < 0.7]
    assert busiest(edges) <= colours_of(spark, edges) <= busiest(edges) + 2
    assert colours_of(spark, [("a", "b"), ("b", "c"), ("a", "c")]) == 3
    assert shifts.edge_colouring(Graph.rows(spark, [], nodes=["a"])).isEmpty()
    with pytest.raises(Invalid):
        shifts.edge_colouring(Graph.rows(spark, [("a", "a")]))


def least_separation(names, edges):
    def live(order):
        at = {v: i for i, v in enumerate(order)}
        return max(sum(at[v] <= t and any(at[w] > t for e in edges if v in e for w in e) for v in names) for t in range(len(names)))

    return live, min(live(o) for o in itertools.permutations(names))


def test_separations_and_path_widths(spark):
    rng = random.Random(3)
    names = [f"v{i}" for i in range(7)]
    edges = [e for e in itertools.combinations(names, 2) if rng.random() < 0.4]
    graph = Graph.rows(spark, edges, nodes=names)
    live, want = least_separation(names, edges)
    order = rng.sample(names, 7)
    placed = spark.createDataFrame([(v, i) for i, v in enumerate(order)], "id string, position bigint")
    assert widths.separation(graph, placed).first()[0] == live(order)
    assert widths.exact_pathwidth(graph).first()[0] == want
    row = widths.pathwidth(graph).first()
    assert row["least"] <= want <= row["width"]
    chain, full = [(f"p{i}", f"p{i + 1}") for i in range(6)], list(itertools.combinations("abcde", 2))
    for edges, width in ((chain, 1), (full, 4)):
        assert tuple(widths.pathwidth(Graph.rows(spark, edges)).first()) == (width, width, True)
    assert widths.exact_pathwidth(Graph.rows(spark, [], nodes=["a", "b"])).first()[0] == 0
    with pytest.raises(Invalid):
        widths.exact_pathwidth(graph, most=6)


def test_samples_keep_what_they_drew(spark):
    rng = random.Random(4)
    edges = [e for e in itertools.combinations([f"v{i:02}" for i in range(12)], 2) if rng.random() < 0.3]
    graph = Graph.rows(spark, edges)
    near = {v: {w for e in edges if v in e for w in e} for e in edges for v in e}
    ball, front = {"v00"}, {"v00"}
    for _ in range(2):
        front = {w for v in front for w in near[v]}
        ball |= front
    found = chance.snowball(graph, "v00", 2)
    assert {r["id"] for r in found.nodes.collect()} == ball
    assert {(r["src"], r["dst"]) for r in found.edges.collect()} == {e for e in edges if set(e) <= ball}
    degree = {v: sum(v in e for e in edges) for v in near}
    row = chance.degree_bias(graph, found).first()
    assert row["n_sampled"] == len(ball)
    assert row["mean_sampled"] == pytest.approx(sum(degree[v] for v in ball) / len(ball)) and row["mean_all"] == pytest.approx(2 * len(edges) / len(near))
    some = chance.sample_nodes(graph, 0.5, 1)
    kept = {r["id"] for r in some.nodes.collect()}
    assert 0 < len(kept) < len(near) and {(r["src"], r["dst"]) for r in some.edges.collect()} == {e for e in edges if set(e) <= kept}
    tied = chance.sample_edges(graph, 0.5, 1)
    drawn = {(r["src"], r["dst"]) for r in tied.edges.collect()}
    assert 0 < len(drawn) < len(edges) and drawn <= set(edges) and {r["id"] for r in tied.nodes.collect()} == {v for e in drawn for v in e}


def test_groups_of_friends_cluster_more_than_their_shuffles(spark):
    cliques = [(f"k{g}{i}", f"k{g}{j}") for g in range(6) for i, j in itertools.combinations(range(4), 2)]
    row = chance.null_model(Graph.rows(spark, cliques), samples=2, rounds=3).first()
    assert row["observed"] == 1.0 and row["mean"] < 0.8
