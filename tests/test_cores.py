"""Core numbers against plain peeling."""

from __future__ import annotations

import random

from sparkweave.model import Graph
from sparkweave.operators import cohesion


def _peeled(edges: list[tuple[str, str]]) -> dict[str, int]:
    near: dict[str, set[str]] = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    core, k = {}, 0
    while near:
        least = min(near, key=lambda n: len(near[n]))
        k = max(k, len(near[least]))
        core[least] = k
        for other in near.pop(least):
            near[other].discard(least)
    return core


def test_late_rounds_look_only_at_nodes_that_a_neighbour_fell_below(spark, monkeypatch):
    """a path falls from its ends, so a round touches few nodes; a hub and random edges beside it keep their cores."""
    rng = random.Random(5)
    edges = [(f"p{i:02}", f"p{i + 1:02}") for i in range(24)] + [("hub", f"l{i}") for i in range(30)]
    edges += sorted({tuple(sorted((f"r{rng.randrange(12)}", f"r{12 + rng.randrange(12)}"))) for _ in range(60)})
    sizes, write = {}, cohesion.materialise

    def noted(df, name):
        found = write(df, name)
        sizes.setdefault(name, []).append(found.count())
        return found

    monkeypatch.setattr(cohesion, "materialise", noted)
    found = {r["id"]: r["core"] for r in cohesion.core_numbers(Graph.rows(spark, [*edges, ("loop", "loop")], nodes=["lonely"])).collect()}
    assert found == _peeled(edges) | {"lonely": 0, "loop": 0}
    assert sizes["touched"] and max(sizes["touched"]) < len(found) / 4
