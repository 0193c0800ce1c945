"""Routes to a goal, floors, separators and trees against brute force on small graphs."""

from __future__ import annotations

import random
from itertools import combinations, product

import pytest

from sparkweave.errors import Invalid
from sparkweave.model import Graph
from sparkweave.operators import flows, goals, trees


def _walk(arcs, source, target):
    """All loopless routes with their costs."""
    out, stack = [], [(source, (source,), 0)]
    while stack:
        at, way, cost = stack.pop()
        if at == target:
            out.append((cost, way))
            continue
        stack += [(b, (*way, b), cost + w) for a, b, w in arcs if a == at and b not in way]
    return sorted(out)


def test_routes_from_one_end_and_both_ends_are_cheapest(spark):
    rng = random.Random(14)
    arcs = [(str(i), str(j), rng.randint(1, 9)) for i in range(7) for j in range(7) if i != j and rng.random() < 0.3]
    g = Graph.rows(spark, arcs, directed=True, nodes=[str(i) for i in range(8)])
    want = _walk(arcs, "0", "6")
    for rows in (goals.towards(g, "0", "6"), goals.from_both_ends(g, "0", "6")):
        steps = sorted(tuple(r) for r in rows.collect())
        assert steps[-1][2] == want[0][0] and (want[0][0], tuple(s[1] for s in steps)) in want
    assert goals.towards(g, "0", "7").count() == goals.from_both_ends(g, "0", "7").count() == 0
    assert [tuple(r) for r in goals.towards(g, "3", "3").collect()] == [(0, "3", 0.0)]
    steps = goals.explain(g, "0", "6").orderBy("step").collect()
    way = ("0", *(r["dst"] for r in steps))
    assert steps[-1]["total"] == want[0][0]
    for r in steps:
        around = [c for c, other in want if (r["src"], r["dst"]) not in zip(other, other[1:])]
        assert r["slack"] == (around[0] - want[0][0] if around else float("inf")), way


def _one_way(rng, nodes, share):
    """Some pairs of nodes, each with one direction."""
    return [tuple(rng.sample(p, 2)) for p in combinations(nodes, 2) if rng.random() < share]


def _sides(nodes):
    return [set(c) for k in range(len(nodes) + 1) for c in combinations(nodes, k)]


def test_routes_of_a_flow_add_up(spark):
    rng = random.Random(31)
    nodes = [f"x{i}" for i in range(7)]
    room = {e: float(rng.randint(1, 9)) for e in _one_way(rng, nodes, 0.7)}
    first, last = nodes[0], nodes[-1]
    least = min(sum(w for (a, b), w in room.items() if a in s | {first} and b not in s | {first}) for s in _sides(nodes[1:-1]))
    sent = flows.maximum_flow(Graph.rows(spark, [(a, b, w) for (a, b), w in room.items()], directed=True, nodes=nodes), first, last)[0]
    used = {}
    for r in goals.flow_routes(sent, first, last).collect():
        assert r["way"][0] == first and r["way"][-1] == last and len(set(r["way"])) == len(r["way"])
        for e in zip(r["way"], r["way"][1:], strict=False):
            used[e] = used.get(e, 0.0) + r["flow"]
    assert sum(x for e, x in used.items() if e[0] == first) == pytest.approx(least)
    assert all(x <= room[e] + 1e-9 for e, x in used.items())


def test_circulations_meet_floors_or_are_refused(spark):
    """Hoffman: one exists if no set of nodes must let out more than can come in."""
    seen = set()
    for seed in (3, 10):
        rng = random.Random(seed)
        nodes = [f"x{i}" for i in range(5)]
        bounds = {}
        for e in _one_way(rng, nodes, 0.9):
            floor = rng.choice([0, 0, 0, 1, 2])
            bounds[e] = (float(floor), float(floor + rng.randint(0, 6)))
        exists = all(sum(f for (a, b), (f, _) in bounds.items() if a in s and b not in s) <= sum(c for (a, b), (_, c) in bounds.items() if a not in s and b in s) for s in _sides(nodes))
        rows = spark.createDataFrame([(*e, *fc) for e, fc in bounds.items()], "src string, dst string, floor double, capacity double")
        seen.add(exists)
        if not exists:
            with pytest.raises(Invalid):
                goals.circulation(rows)
            continue
        found = {(r["src"], r["dst"]): r["flow"] for r in goals.circulation(rows).collect()}
        assert set(found) == set(bounds) and all(bounds[e][0] - 1e-6 <= x <= bounds[e][1] + 1e-6 for e, x in found.items())
        assert all(abs(sum(x * ((a == v) - (b == v)) for (a, b), x in found.items())) < 1e-6 for v in nodes)
    assert seen == {True, False}


def test_separators_are_smallest_and_equal_disjoint_routes(spark):
    rng = random.Random(3)
    edges = [(str(i), str(j)) for i in range(7) for j in range(i) if (i, j) != (6, 0) and rng.random() < 0.5]
    g = Graph.rows(spark, edges, nodes=[str(i) for i in range(7)])
    both = [(a, b, 1) for a, b in edges] + [(b, a, 1) for a, b in edges]

    def parts(gone):
        return not _walk([e for e in both if e[0] not in gone and e[1] not in gone], "0", "6")

    least = min(k for k in range(6) for s in combinations("12345", k) if parts(set(s)))
    found = {r["id"] for r in goals.separator(g, "0", "6").collect()}
    assert len(found) == least and parts(found)
    assert goals.disjoint_routes(g, "0", "6").first()["node_disjoint"] == least
    with pytest.raises(Invalid):
        goals.separator(g, edges[0][0], edges[0][1])


def test_pruefer_codes_follow_the_definition(spark):
    rng = random.Random(8)
    edges = [(f"n{i}", f"n{rng.randrange(i)}") for i in range(1, 12)]
    left, want = list(edges), []
    while len(left) > 1:
        ends = [x for e in left for x in e]
        leaf = min(x for x in ends if ends.count(x) == 1)
        edge = next(e for e in left if leaf in e)
        want.append(edge[0] if edge[1] == leaf else edge[1])
        left.remove(edge)
    assert [r["id"] for r in trees.prufer_code(Graph.rows(spark, edges)).orderBy("position").collect()] == want
    assert trees.prufer_code(Graph.rows(spark, [("a", "b")])).count() == 0
    assert trees.prufer_code(Graph.rows(spark, [])).count() == 0


def test_centroids_of_a_path_halve(spark):
    path = Graph.rows(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "g")], nodes=["z"])
    assert {r["id"]: r["level"] for r in trees.centroid_levels(path).collect()} == {"d": 0, "z": 0, "b": 1, "f": 1, "a": 2, "c": 2, "e": 2, "g": 2}
    with pytest.raises(Invalid):
        trees.centroid_levels(Graph.rows(spark, [("a", "b"), ("b", "c"), ("a", "c")]))


def test_arborescences_with_cycles_are_lightest(spark):
    rng = random.Random(2)
    for _ in range(2):
        arcs = [(str(i), str(j), rng.randint(1, 9) + (20 if i == 0 else 0)) for i in range(6) for j in range(1, 6) if i != j and rng.random() < 0.6] + [("0", "1", 30)]
        arcs = list({(a, b): (a, b, w) for a, b, w in arcs}.values())
        into = [[e for e in arcs if e[1] == str(j)] for j in range(1, 6)]

        def spans(pick):
            seen = {"0"}
            for _ in pick:
                seen |= {b for a, b, _ in pick if a in seen}
            return len(seen) == 6

        best = min(sum(e[2] for e in pick) for pick in product(*into) if spans(pick))
        got = [tuple(r) for r in trees.arborescence(Graph.rows(spark, arcs, directed=True), "0").collect()]
        assert len(got) == 5 and spans(got) and sum(e[2] for e in got) == best
    with pytest.raises(Invalid):
        trees.arborescence(Graph.rows(spark, [("0", "1"), ("2", "3"), ("3", "2")], directed=True), "0")


def test_steiner_trees_join_their_terminals_within_twice_the_least(spark):
    rng = random.Random(6)
    edges = [(str(i), str(j), rng.randint(1, 9)) for i in range(8) for j in range(i) if rng.random() < 0.45] + [("0", "7", 9)]
    edges = list({(a, b): (a, b, w) for a, b, w in edges}.values())
    ends = {"0", "3", "6"}

    def joined(pick):
        seen = {"0"}
        for _ in pick:
            seen |= {x for a, b, _ in pick for x in (a, b) if a in seen or b in seen}
        return ends <= seen

    best = min(sum(e[2] for e in p) for k in range(1, 6) for p in combinations(edges, k) if joined(p))
    got = [tuple(r) for r in trees.steiner_tree(Graph.rows(spark, edges), spark.createDataFrame([(e,) for e in ends], "id string")).collect()]
    assert joined(got) and best <= sum(e[2] for e in got) <= 2 * best
    degree = [x for a, b, _ in got for x in (a, b)]
    assert all(x in ends for x in degree if degree.count(x) == 1)


def test_level_order_and_greedy_domination_follow_the_queue(spark):
    rng = random.Random(11)
    names = [str(i) for i in range(10, 24)]
    edges = [(a, b) for a, b in combinations(names, 2) if rng.random() < 0.15]
    near = {n: {b if a == n else a for a, b in edges if n in (a, b)} for n in names}
    order = []
    at = 0
    while len(order) < len(names):
        if at == len(order):
            order.append(min((n for n in names if n not in order), key=lambda n: (len(near[n]), n)))
        order += sorted(near[order[at]] - set(order), key=lambda n: (len(near[n]), n))
        at += 1
    g = Graph.rows(spark, edges, nodes=names)
    assert [r["id"] for r in trees.level_order(g).orderBy("position").collect()] == order
    bare, chosen = set(names), set()
    while bare:
        best = min(names, key=lambda n: (-len((near[n] | {n}) & bare), n))
        chosen.add(best)
        bare -= near[best] | {best}
    assert {r["id"] for r in trees.dominating_set(g).collect()} == chosen
