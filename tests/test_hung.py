"""Trees hung on a root by one tour, against a search, also where ranks are found by shortened lists."""

import random

import pytest

from sparkweave.errors import Invalid
from sparkweave.model import Graph
from sparkweave.operators import orders, tours


@pytest.mark.parametrize("few", [200_000, 10])
def test_hung_by_one_ranking(spark, monkeypatch, few):
    monkeypatch.setattr(orders, "FEW", few)
    calls = []
    ranked = orders.ranked
    monkeypatch.setattr(tours, "ranked", lambda *given: calls.append(1) or ranked(*given))
    rng = random.Random(few)
    parent = {f"n{k}": f"n{rng.randrange(k)}" for k in range(1, 40)}
    found = {r["id"]: r for r in tours.hung(Graph.rows(spark, list(parent.items())), "n0").collect()}
    below = {n: {n} for n in ["n0", *parent]}
    for n in parent:
        up = parent[n]
        while up:
            below[up].add(n)
            up = parent.get(up)
    assert {n: r["parent"] for n, r in found.items()} == {"n0": None, **parent} and len(calls) == 1
    for n, r in found.items():
        assert r["size"] == len(below[n])
        assert sorted(found[m]["place"] for m in below[n]) == list(range(r["place"], r["place"] + r["size"]))
    with pytest.raises(Invalid):
        tours.hung(Graph.rows(spark, [("a", "b"), ("c", "d")]), "a")


def _chains(parent, root):
    """Heads, positions and lengths by a walk over the tree."""
    below = {n: 1 for n in [root, *parent]}
    depth = {root: 0}

    def deep(n):
        if n not in depth:
            depth[n] = deep(parent[n]) + 1
        return depth[n]

    for n in sorted(parent, key=deep, reverse=True):
        below[parent[n]] += below[n]
    children = {}
    for n, up in parent.items():
        children.setdefault(up, []).append(n)
    heavy = {up: min(c, key=lambda x: (-below[x], x)) for up, c in children.items()}
    found = {}
    for leaf in below.keys() - heavy.keys():
        chain = [leaf]
        while chain[-1] in parent and heavy[parent[chain[-1]]] == chain[-1]:
            chain.append(parent[chain[-1]])
        found |= {n: (chain[-1], k, len(chain)) for k, n in enumerate(reversed(chain))}
    return found


def _got(frame):
    return {r["id"]: (r["head"], r["position"], r["length"]) for r in frame.collect()}


def test_leaves_are_taken_away_before_a_tour(spark, monkeypatch):
    """a bushy tree needs no tour, and only chains of more than one node are ranked; what has few leaves is toured with the sizes of those taken."""
    tours_made, lists = [], []
    hung, ranked = tours.hung, tours.ranked
    monkeypatch.setattr(tours, "hung", lambda graph, root: tours_made.append(graph.nodes.count()) or hung(graph, root))
    monkeypatch.setattr(tours, "ranked", lambda links, *w: lists.append(links.count()) or ranked(links, *w))
    bushy = {f"r{i}": "w" for i in range(3)} | {f"n{i}": f"r{i % 3}" for i in range(7)} | {f"c{i:02}": f"n{i % 7}" for i in range(60)}
    assert _got(tours.heavy_paths(Graph.rows(spark, list(bushy.items())), "w")) == _chains(bushy, "w")
    assert not tours_made and lists[0] == 1 + 3 + 7 + 7
    # Two long paths that part in the middle, with twigs on the first of their nodes.
    long = {f"p{i:02}": f"p{i - 1:02}" for i in range(1, 40)} | {f"q{i:02}": f"q{i - 1:02}" if i else "p10" for i in range(30)} | {f"t{i}": f"p{i % 4:02}" for i in range(12)}
    assert _got(tours.heavy_paths(Graph.rows(spark, list(long.items())), "p00")) == _chains(long, "p00")
    assert len(tours_made) == 1 and tours_made[0] < len(long)


@pytest.mark.parametrize("edges, root", [([("a", "b"), ("c", "d")], "a"), ([("a", "b"), ("b", "c"), ("c", "a"), ("d", "e")], "d"), ([("a", "b")], "x"), ([("a", "b"), ("b", "b")], "a"), ([("a", "b"), ("c", "c"), ("d", "c")], "a")])
def test_what_is_not_one_tree_is_refused(spark, edges, root):
    with pytest.raises(Invalid):
        tours.heavy_paths(Graph.rows(spark, edges), root)
