"""Elimination orders against exact treewidths by subsets of nodes."""

import itertools
import random
from functools import cache

import pytest

from sparkweave.errors import Invalid
from sparkweave.model import Graph
from sparkweave.operators import widths


def exact_width(names, edges):
    near = {v: {b for a, b in [*edges, *[(b, a) for a, b in edges]] if a == v} for v in names}

    def reached(gone, v):
        """Neighbours of v once ``gone`` are eliminated: nodes that v reaches through them."""
        seen, stack, found = {v}, [v], set()
        while stack:
            for w in near[stack.pop()]:
                if w not in seen:
                    seen.add(w)
                    if w in gone:
                        stack.append(w)
                    else:
                        found.add(w)
        return len(found)

    @cache
    def best(gone):
        if not gone:
            return 0
        return min(max(best(gone - {v}), reached(gone - {v}, v)) for v in gone)

    return best(frozenset(names))


@pytest.mark.parametrize("seed", [1, 2])
def test_width_bounds_hold_the_exact_width(spark, seed):
    rng = random.Random(seed)
    names = [f"v{i}" for i in range(9)]
    edges = [e for e in itertools.combinations(names, 2) if rng.random() < 0.4]
    graph = Graph.rows(spark, edges, nodes=names)
    row = widths.treewidth(graph).first()
    want = exact_width(names, edges)
    assert row["least"] <= want <= row["width"] <= want + 1
    taken, filled = widths.elimination(graph)
    turns = {r["id"]: (r["turn"], r["degree"]) for r in taken.collect()}
    whole = [*edges, *[(r["src"], r["dst"]) for r in filled.collect()]]
    assert set(turns) == set(names) and len(whole) == len(set(whole)) and not [1 for a, b in whole if turns[a][0] == turns[b][0]]
    # In the filled graph each node's later neighbours are tied to each other, and they are as many as was said.
    for v in names:
        later = [w for w in names if (min(v, w), max(v, w)) in whole and turns[w][0] > turns[v][0]]
        assert len(later) == turns[v][1] and all(p in whole for p in itertools.combinations(sorted(later), 2))


def test_widths_of_plain_shapes(spark):
    ring = [(f"r{i}", f"r{(i + 1) % 7}") for i in range(7)]
    full = list(itertools.combinations("abcde", 2))
    tree = [("t0", "t1"), ("t1", "t2"), ("t1", "t3"), ("t3", "t4")]
    for edges, width in ((tree, 1), (ring, 2), (full, 4)):
        row = widths.treewidth(Graph.rows(spark, edges)).first()
        assert (row["width"], row["least"], row["exact"]) == (width, width, True)
    assert widths.treewidth(Graph.rows(spark, [("a", "a")], nodes=["b"])).first()["width"] == 0
    with pytest.raises(Invalid):
        widths.treewidth(Graph.rows(spark, []))
