"""Readings of all pairs of packed graphs, against brute force and against rounds of joins."""

import random

import pytest

from sparkweave.model import Graph
from sparkweave.operators import packed, paths, ranking


def random_arcs(nodes, m, seed):
    rng = random.Random(seed)
    return sorted({(f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}") for _ in range(m)})


def _written(monkeypatch, *modules):
    """Rows of the tables that modules write."""
    seen = []
    for module in modules:

        def noted(df, name, write=module.materialise):
            made = write(df, name)
            seen.append((name, made.count()))
            return made

        monkeypatch.setattr(module, "materialise", noted)
    return seen


@pytest.mark.parametrize("step, part, cells", [(1, 30, 1), (7, 100, 500), (1 << 16, 1 << 23, 1 << 23)])
def test_walks_of_all_pairs_are_not_written(spark, monkeypatch, step, part, cells):
    """hubs, sinks, loops, several parts, blocks and batches; no table but the graph is written."""
    for name, value in (("STEP", step), ("PART", part), ("CELLS", cells), ("ROWS", 50)):
        monkeypatch.setattr(packed, name, value)
    arcs = sorted({*random_arcs(80, 300, 4), *((f"n{i}", "hub") for i in range(80)), *(("hub", f"n{i}") for i in range(80)), ("n1", "sink")})
    seen = _written(monkeypatch, ranking, packed)
    for length in (1, 3, 4):
        now = {(a, a): 1 for a, _ in arcs}
        for _ in range(length):
            more = {}
            for (a, b), n in now.items():
                for x, c in arcs:
                    if x == b:
                        more[a, c] = more.get((a, c), 0) + n
            now = more
        got = ranking.walk_counts(Graph.rows(spark, arcs, True), length).collect()
        assert len(got) == len(now) and {(r["src"], r["dst"]): r["walks"] for r in got} == now
    assert max(n for _, n in seen) <= len(arcs) and "walks" not in dict(seen)


def test_walks_of_small_graphs(spark):
    graph = Graph.rows(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "c"), ("b", "d")], True, ["lone"])
    got = {(r["src"], r["dst"]): r["walks"] for r in ranking.walk_counts(graph, 2).collect()}
    assert got == dict.fromkeys([tuple(x) for x in ("ac", "ad", "ba", "bc", "ca", "cb", "cc")], 1)
    assert ranking.walk_counts(Graph.rows(spark, [], True, ["a"]), 3).count() == 0


@pytest.mark.parametrize("part, step, cells", [(40, 3, 1), (1 << 23, 1 << 16, 1 << 23)])
def test_hops_of_all_pairs_are_not_written(spark, monkeypatch, part, step, cells):
    """several parts and words, a tail of many hops, a sink and a lone node; no written table has a row for each node and word."""
    for name, value in (("PART", part), ("STEP", step), ("CELLS", cells)):
        monkeypatch.setattr(packed, name, value)
    tail = [(f"t{i}", f"t{i + 1}") for i in range(20)]
    arcs = sorted({*random_arcs(130, 400, 6), *tail, ("n1", "t0"), ("n2", "n2")})
    ids = sorted({x for e in arcs for x in e} | {"lone"})
    out = {a: [y for x, y in arcs if x == a] for a in ids}
    seen = _written(monkeypatch, paths, packed)
    got = {r["id"]: r for r in paths._hop_sums(Graph.rows(spark, arcs, True, ["lone"]).written()).collect()}
    for o in ids:
        hops, front = {o: 0}, [o]
        while front:
            near = {b for a in front for b in out[a]} - hops.keys()
            hops |= dict.fromkeys(near, hops[front[0]] + 1)
            front = sorted(near)
        far = [h for h in hops.values() if h]
        assert (o in got) == bool(far)
        if far:
            assert (got[o]["r"], got[o]["total"]) == (len(far), sum(far)) and got[o]["inverse"] == pytest.approx(sum(1 / h for h in far))
    assert max(n for _, n in seen) <= len(arcs)
