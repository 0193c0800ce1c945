"""Feedback sets, spanners and eigenvectors against plain searches and dense matrices."""

import itertools
import random

import numpy as np
import pytest

from sparkweave.errors import Invalid
from sparkweave.model import Graph
from sparkweave.operators import krylov, ranking, sparse


def acyclic(nodes, arcs):
    left, arcs = set(nodes), set(arcs)
    while True:
        ends = {v for v in left if not any(b == v for _, b in arcs)}
        if not ends:
            return not left
        left -= ends
        arcs = {(a, b) for a, b in arcs if a not in ends}


def forest(nodes, edges):
    top = {v: v for v in nodes}

    def find(v):
        while top[v] != v:
            v = top[v]
        return v

    for a, b in edges:
        x, y = find(a), find(b)
        if x == y:
            return False
        top[x] = y
    return True


def lengths(nodes, edges):
    far = {(a, b): 0.0 if a == b else float("inf") for a in nodes for b in nodes}
    for a, b, w in edges:
        far[a, b] = far[b, a] = min(far[a, b], w)
    for v, a, b in itertools.product(nodes, repeat=3):
        far[a, b] = min(far[a, b], far[a, v] + far[v, b])
    return far


@pytest.mark.parametrize("seed", [1, 2])
def test_feedback_arcs_leave_no_cycle(spark, seed):
    rng = random.Random(seed)
    names = [f"v{i}" for i in range(7)]
    arcs = rng.sample([(a, b) for a in names for b in names if a != b], 13)
    gone = {(r["src"], r["dst"]) for r in sparse.feedback_arcs(Graph.rows(spark, arcs, True, names)).collect()}
    fewest = next(k for k in range(len(arcs)) if any(acyclic(names, set(arcs) - set(cut)) for cut in itertools.combinations(arcs, k)))
    assert gone <= set(arcs) and acyclic(names, set(arcs) - gone)
    assert fewest <= len(gone) <= len(arcs) / 2


def test_feedback_arcs_of_plain_shapes(spark):
    ring = [(f"r{i}", f"r{(i + 1) % 6}") for i in range(6)]
    line = [("a", "b"), ("b", "c"), ("a", "c")]
    found = sparse.feedback_arcs(Graph.rows(spark, [*ring, *line, ("z", "z")], True)).collect()
    assert len(found) == 2 and ("z", "z") in {(r["src"], r["dst"]) for r in found}
    assert sparse.feedback_arcs(Graph.rows(spark, [], True)).collect() == []
    with pytest.raises(Invalid):
        sparse.feedback_arcs(Graph.rows(spark, line))


def test_feedback_nodes_leave_a_forest(spark):
    rng = random.Random(4)
    names = [f"v{i}" for i in range(8)]
    edges = rng.sample(list(itertools.combinations(names, 2)), 14)
    gone = {r["id"] for r in sparse.feedback_nodes(Graph.rows(spark, edges, nodes=names)).collect()}

    def left(cut):
        return forest(set(names) - set(cut), [e for e in edges if not set(e) & set(cut)])

    fewest = next(k for k in range(9) if any(left(cut) for cut in itertools.combinations(names, k)))
    assert left(gone) and fewest <= len(gone) <= fewest + 2
    # Two rings that share a node, a tree, and a loop.
    shapes = [("h", "a"), ("a", "b"), ("b", "h"), ("h", "c"), ("c", "d"), ("d", "h"), ("s", "t"), ("t", "u"), ("z", "z")]
    assert {r["id"] for r in sparse.feedback_nodes(Graph.rows(spark, shapes)).collect()} == {"h", "z"}


@pytest.mark.parametrize("k", [1, 2, 3])
def test_spanners_keep_distances(spark, k):
    rng = random.Random(k)
    names = [f"v{i:02d}" for i in range(24)]
    edges = [(a, b, float(rng.randrange(1, 9))) for a, b in itertools.combinations(names, 2) if rng.random() < 0.6]
    kept = [tuple(r) for r in sparse.spanner(Graph.rows(spark, edges), k).collect()]
    assert len(kept) == len(set(kept)) and set(kept) <= set(edges)
    assert (len(kept) == len(edges)) if k == 1 else (len(kept) < len(edges))
    before, after = lengths(names, edges), lengths(names, kept)
    assert all(after[p] <= (2 * k - 1) * before[p] + 1e-9 for p in before)


def test_spanners_refuse_what_they_cannot_keep(spark):
    with pytest.raises(Invalid):
        sparse.spanner(Graph.rows(spark, [("a", "b", -1.0)]), 2)
    with pytest.raises(Invalid):
        sparse.spanner(Graph.rows(spark, [("a", "b")], True), 2)
    assert sparse.spanner(Graph.rows(spark, [("a", "a", 2.0)], nodes=["c"]), 2).collect() == []


def dense(names, edges):
    at = {v: i for i, v in enumerate(names)}
    matrix = np.zeros((len(names), len(names)))
    for a, b in edges:
        matrix[at[a], at[b]] = matrix[at[b], at[a]] = 1.0
    return matrix


def test_eigenpairs_with_repeats(spark):
    """A full graph has one eigenvalue many times; a block finds it as often as it is wide."""
    rng = random.Random(9)
    full = list(itertools.combinations([f"k{i}" for i in range(6)], 2))
    names = [f"r{i:02d}" for i in range(14)]
    other = [e for e in itertools.combinations(names, 2) if rng.random() < 0.4]
    graph = Graph.rows(spark, [*full, *other], nodes=names).written()
    every = sorted(r["id"] for r in graph.nodes.collect())
    matrix = dense(every, [*full, *other])
    for largest in (True, False):
        found, values, residuals = krylov.eigenpairs(graph.nodes, krylov.neighbours(graph), 4, largest)
        want = np.linalg.eigvalsh(matrix)
        assert np.allclose(values, want[::-1][:4] if largest else want[:4], atol=1e-7) and max(residuals) < 1e-6
        rows = {r["id"]: r for r in found.collect()}
        vectors = np.array([[rows[v][f"v{i}"] for i in range(4)] for v in every])
        assert np.allclose(vectors.T @ vectors, np.eye(4), atol=1e-7)
        assert np.allclose(matrix @ vectors, vectors * values, atol=1e-6)


def test_leading_eigenvector_of_the_modularity_matrix(spark):
    rng = random.Random(5)
    names = [f"v{i:02d}" for i in range(16)]
    edges = [(a, b) for a, b in itertools.combinations(names, 2) if rng.random() < (0.7 if (a < "v08") == (b < "v08") else 0.1)]
    matrix = dense(names, edges)
    degree = matrix.sum(0)
    values, vectors = np.linalg.eigh(matrix - np.outer(degree, degree) / degree.sum())
    rows = {r["id"]: r for r in krylov.leading_eigenvector(Graph.rows(spark, edges, nodes=names)).collect()}
    up = vectors[:, -1] > 0
    want = {v: min(w for w, s in zip(names, up, strict=True) if s == t) for v, t in zip(names, up, strict=True)}
    assert {v: rows[v]["side"] for v in names} == want
    assert abs(rows["v00"]["eigenvalue"] - values[-1]) < 1e-7 and rows["v00"]["worth"]
    # A full graph has no seam.
    whole = krylov.leading_eigenvector(Graph.rows(spark, list(itertools.combinations("abcde", 2)))).collect()
    assert {(r["side"], r["worth"]) for r in whole} == {("a", False)}
    with pytest.raises(Invalid):
        krylov.leading_eigenvector(Graph.rows(spark, [], nodes=["a"]))


def test_spectral_clusters(spark):
    groups = [[f"{g}{i}" for i in range(n)] for g, n in (("a", 5), ("b", 4), ("c", 6))]
    inner = [e for g in groups for e in itertools.combinations(g, 2)]
    want = {v: g[0] for g in groups for v in g}
    for edges in (inner, [*inner, ("a1", "b1"), ("b2", "c1")]):
        assert {r["id"]: r["cluster"] for r in krylov.spectral_clusters(Graph.rows(spark, edges), 3).collect()} == want
    one = krylov.spectral_clusters(Graph.rows(spark, inner), 1).collect()
    assert {r["cluster"] for r in one} == {"a0"}
    with pytest.raises(Invalid):
        krylov.spectral_clusters(Graph.rows(spark, [("a", "b")]), 3)


def test_scores_that_still_move_are_refused(spark):
    graph = Graph.rows(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")])
    with pytest.raises(Invalid):
        ranking.eigenvector(graph, most=2)
    assert ranking.eigenvector(graph, rounds=2).count() == 4
