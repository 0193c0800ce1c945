"""Readings by linear algebra, each connected component within one task.

The matrices of a graph are block diagonal over its components, so spectra,
determinants and solves are computed for each component apart, by numpy, and
the number of components may grow without bound.  A component of more than
``MOST`` nodes is refused.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.errors import Invalid
from sparkweave.model import Graph
from sparkweave.operators.cohesion import components
from sparkweave.session import materialise, share_code, tidy

#: Nodes of a component at most, and cells of matrices that one call solves.
MOST, CELLS = 1500, 100_000

#: Columns of a component's answer, all of one length.
Answer = Callable[[str, list[str], np.ndarray, np.ndarray, np.ndarray], dict[str, Sequence]]


def _each(graph: Graph, answer: Answer, schema: str, weighted: bool = False) -> DataFrame:
    """``answer(component, names, adjacency, s, d)`` for each component, ``s`` and ``d`` being its edges' ends by place; loops are left out.

    Small components share a task call, ``CELLS`` cells of their matrices or about so many, since a call costs more than a small solve.
    """
    graph.need(directed=False)
    share_code(graph.spark)
    graph = graph.written()
    named = materialise(components(graph), "components")
    largest, cells = named.groupBy("component").count().agg(F.max("count"), F.sum(F.col("count").cast("double") ** 2)).first()
    if (largest or 0) > MOST:
        raise Invalid(f"components of at most {MOST} nodes are solved; one has {largest}")
    edges = graph.edges.where("src <> dst").join(named.withColumnRenamed("id", "src"), "src").select("component", "src", "dst", "w")
    rows = edges.union(named.select("component", "id", F.lit(None).cast("string"), F.lit(0.0)))
    dealt = rows.withColumn("__call", F.pmod(F.xxhash64("component"), F.lit(int((cells or 0) // CELLS) + 1)))
    columns = [c.split()[0] for c in schema.split(", ")]

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["component", "src"])
        component, src, dst, w = (part[c].to_numpy() for c in ("component", "src", "dst", "w"))
        node = part["dst"].isna().to_numpy()
        found: dict[str, list] = {c: [] for c in columns}
        first = np.flatnonzero(np.concatenate([[True], component[1:] != component[:-1]])).tolist()
        for x, y in zip(first, [*first[1:], len(part)], strict=True):
            own = ~node[x:y]
            names = src[x:y][~own].tolist()
            at = {n: i for i, n in enumerate(names)}
            s, d = (np.array([at[n] for n in ends[x:y][own]], dtype=int) for ends in (src, dst))
            a = np.zeros((len(names), len(names)))
            a[s, d] = a[d, s] = w[x:y][own] if weighted else 1.0
            for c, values in answer(component[x], names, a, s, d).items():
                found[c] += list(values)
        return pd.DataFrame(found)

    return dealt.groupBy("__call").applyInPandas(solve, schema)


def _laplacian(a: np.ndarray) -> np.ndarray:
    return np.diag(a.sum(1)) - a


def _values(kind: Callable[[np.ndarray], np.ndarray]) -> Answer:
    def answer(component: str, names: list[str], a: np.ndarray, s: np.ndarray, d: np.ndarray) -> dict[str, Sequence]:
        values = np.linalg.eigvalsh(kind(a))
        return {"component": [component] * len(values), "k": range(len(values)), "value": values.tolist()}

    return answer


@tidy
def laplacian_spectrum(graph: Graph) -> DataFrame:
    """``component``, ``k``, ``value``: eigenvalues of each component's unweighted Laplacian, the smallest (0) first."""
    return _each(graph, _values(_laplacian), "component string, k int, value double")


@tidy
def adjacency_spectrum(graph: Graph) -> DataFrame:
    """``component``, ``k``, ``value``: eigenvalues of each component's unweighted adjacency, the smallest first."""
    return _each(graph, _values(lambda a: a), "component string, k int, value double")


@tidy
def energy(graph: Graph) -> DataFrame:
    """``component``, ``energy`` (sum of absolute eigenvalues), ``estrada``, ``radius``, ``walks2`` and ``walks3`` (closed walks)."""
    x = F.col("value")
    return adjacency_spectrum(graph).groupBy("component").agg(F.sum(F.abs(x)).alias("energy"), F.sum(F.exp(x)).alias("estrada"), F.max(F.abs(x)).alias("radius"), F.sum(x * x).alias("walks2"), F.sum(x * x * x).alias("walks3"))


@tidy
def eigenpairs(graph: Graph) -> DataFrame:
    """``component``, ``k``, ``value``, ``id``, ``x``: unit eigenvectors of the weighted adjacency; the sign makes the first part that is not 0 positive."""

    def answer(component: str, names: list[str], a: np.ndarray, s: np.ndarray, d: np.ndarray) -> dict[str, Sequence]:
        values, vectors = np.linalg.eigh(a)
        big = np.abs(vectors) > 1e-9
        vectors = vectors * np.sign(vectors[big.argmax(0), np.arange(len(names))])
        n = len(names)
        return {"component": [component] * (n * n), "k": np.repeat(np.arange(n), n).tolist(), "value": np.repeat(values, n).tolist(), "id": names * n, "x": vectors.T.reshape(-1).tolist()}

    return _each(graph, answer, "component string, k int, value double, id string, x double", weighted=True)


@tidy
def fiedler_sides(graph: Graph) -> DataFrame:
    """``component``, ``id``, ``side``, ``connectivity``: each component cut by the sign of its Fiedler vector; its smallest node is on side 0."""

    def answer(component: str, names: list[str], a: np.ndarray, s: np.ndarray, d: np.ndarray) -> dict[str, Sequence]:
        if len(names) < 2:
            return {"component": [component] * len(names), "id": names, "side": [0] * len(names), "connectivity": [0.0] * len(names)}
        values, vectors = np.linalg.eigh(_laplacian(a))
        side = vectors[:, 1] > 1e-9
        return {"component": [component] * len(names), "id": names, "side": (side != side[0]).astype(int).tolist(), "connectivity": [float(values[1])] * len(names)}

    return _each(graph, answer, "component string, id string, side int, connectivity double")


@tidy
def tree_counts(graph: Graph) -> DataFrame:
    """``component``, ``n_trees``: spanning trees of each component, the determinant of its Laplacian without one row, unweighted."""

    def answer(component: str, names: list[str], a: np.ndarray, s: np.ndarray, d: np.ndarray) -> dict[str, Sequence]:
        sign, log = np.linalg.slogdet(_laplacian(a)[1:, 1:]) if len(names) > 1 else (1.0, 0.0)
        return {"component": [component], "n_trees": [float(np.rint(sign * np.exp(log)))]}

    return _each(graph, answer, "component string, n_trees double")


@tidy
def resistances(graph: Graph) -> DataFrame:
    """``src``, ``dst``, ``resistance``: between the ends of every edge, weights being conductances."""

    def answer(component: str, names: list[str], a: np.ndarray, s: np.ndarray, d: np.ndarray) -> dict[str, Sequence]:
        inverse = np.linalg.pinv(_laplacian(a))
        return {"src": [names[i] for i in s], "dst": [names[i] for i in d], "resistance": (inverse[s, s] + inverse[d, d] - 2 * inverse[s, d]).tolist()}

    return _each(graph, answer, "src string, dst string, resistance double", weighted=True)


@tidy
def hitting_times(graph: Graph) -> DataFrame:
    """``a``, ``b``, ``hitting``: expected steps of an unweighted walk from a to b, for all ordered pairs of a component, by one solve for each b."""

    def answer(component: str, names: list[str], a: np.ndarray, s: np.ndarray, d: np.ndarray) -> dict[str, Sequence]:
        n = len(names)
        found: dict[str, list] = {"a": [], "b": [], "hitting": []}
        for b in range(n):
            rest = [i for i in range(n) if i != b]
            if rest:
                h = np.linalg.solve(np.eye(n - 1) - (a / a.sum(1, keepdims=True))[np.ix_(rest, rest)], np.ones(n - 1))
                found["a"] += [names[i] for i in rest]
                found["b"] += [names[b]] * len(rest)
                found["hitting"] += h.tolist()
        return found

    return _each(graph, answer, "a string, b string, hitting double")


@tidy
def commute_times(graph: Graph) -> DataFrame:
    """``a``, ``b``, ``commute``: hitting times there and back, for pairs a < b."""
    h = materialise(hitting_times(graph), "hitting")
    return h.where("a < b").join(h.toDF("b", "a", "back"), ["a", "b"]).select("a", "b", (F.col("hitting") + F.col("back")).alias("commute"))
