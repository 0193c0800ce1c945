"""Components of few edges, which are answered for within a task, against what tables give."""

import random

import pytest

from sparkweave.model import Graph
from sparkweave.operators import blocks


def _mixed(parts=25):
    """Many small random components with loops, rings that share nodes, and twigs."""
    rng = random.Random(9)
    edges = []
    for c in range(parts):
        size = rng.randint(2, 9)
        edges += sorted({tuple(sorted(rng.sample([f"x{c:02}.{i}" for i in range(size)], 2))) for _ in range(size + 1)})
    return [(a, b, float(rng.randint(1, 6))) for a, b in edges] + [("x00.0", "x00.0", 1.0), ("only", "only", 1.0)]


def _separated(edges):
    """Blocks by their definition: edges at a node are together if a way that avoids the node joins their other ends."""
    pairs = {(a, b) for a, b, _ in edges if a != b}
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    name = {p: p for p in pairs}

    def find(p):
        while name[p] != p:
            p = name[p]
        return p

    for v, ends in near.items():
        for a in ends:
            seen, front = {a}, [a]
            while front:
                front = [y for y in {y for x in front for y in near[x]} if y != v and y not in seen]
                seen |= set(front)
            for b in ends & seen:
                p, q = sorted((find(tuple(sorted((v, a)))), find(tuple(sorted((v, b))))))
                name[q] = p
    return {p: "|".join(find(p)) for p in pairs}


def test_blocks_of_small_components_need_no_tour(spark, monkeypatch):
    """F5, F6, F7, F8."""
    edges = _mixed()
    graph = Graph.rows(spark, edges, nodes=["lone"])
    want = _separated(edges)
    monkeypatch.setattr(blocks, "SMALL", 20)
    monkeypatch.setattr(blocks, "CALL", 30)
    monkeypatch.setattr(blocks, "blocks_of", None)
    assert {(r["src"], r["dst"]): r["block"] for r in blocks.blocks(graph).collect()} == want
    sizes, of = {}, {}
    for p, k in want.items():
        sizes[k] = sizes.get(k, 0) + 1
        for x in p:
            of.setdefault(x, set()).add(k)
    cuts = {x for x, k in of.items() if len(k) > 1}
    assert {tuple(r) for r in blocks.bridges(graph).collect()} == {p for p, k in want.items() if sizes[k] == 1}
    assert sorted(r["id"] for r in blocks.cut_nodes(graph).collect()) == sorted(cuts)
    assert sorted(tuple(r) for r in blocks.block_cut_tree(graph).collect()) == sorted((k, x) for x in cuts for k in of[x])


def test_blocks_of_small_and_large_components(spark, monkeypatch):
    edges = _mixed(6) + [(f"r{i:02}", f"r{(i + 1) % 30:02}", 1.0) for i in range(30)] + [("r00", "tail", 1.0), ("r03", "r17", 1.0)]
    edges = [(*sorted(e[:2]), e[2]) for e in edges]
    monkeypatch.setattr(blocks, "SMALL", 15)
    got = blocks.blocks(Graph.rows(spark, edges)).collect()
    assert {(r["src"], r["dst"]): r["block"] for r in got} == _separated(edges) and len(got) == len(_separated(edges))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_second_trees_of_small_components_need_no_tour(spark, monkeypatch, seed):
    """as tables give it, also where some components are large, and null where no edge can be swapped."""
    rng = random.Random(seed)
    edges = _mixed(12) + [(f"r{i:02}", f"r{(i + 1) % 25:02}", float(rng.randint(1, 9))) for i in range(25)] + [("r00", "r11", 4.0)]
    graph = Graph.rows(spark, [(*sorted(e[:2]), e[2]) for e in edges])
    by_tour = blocks._swaps_by_tour
    monkeypatch.setattr(blocks, "_swaps_by_tour", None)
    alone = tuple(blocks.second_tree(graph).first())
    monkeypatch.setattr(blocks, "SMALL", 30)
    monkeypatch.setattr(blocks, "CALL", 20)
    assert tuple(blocks.second_tree(graph).first()) == alone
    monkeypatch.setattr(blocks, "_swaps_by_tour", by_tour)
    for most in (0, 20):
        monkeypatch.setattr(blocks, "SMALL", most)
        assert tuple(blocks.second_tree(graph).first()) == alone
    assert tuple(blocks.second_tree(Graph.rows(spark, [("a", "b", 2.0), ("c", "c", 1.0)])).first()) == (2.0, None)
