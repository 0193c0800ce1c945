"""Eigenvectors of graphs by blocks of Krylov vectors: no matrix is formed and no task holds a component.

A basis is a table with a row for each node and a column for each vector.  A
step multiplies the newest vectors by the operator (joins), and makes the
answers orthogonal to the basis, twice.  Inner products are sums over the
tasks' own; what comes to the driver is as long as the basis is wide, whatever
the number of nodes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweave.errors import Invalid
from sparkweave.model import Graph
from sparkweave.session import discard, materialise, tidy

#: Directions shorter than this, as a share of the longest, hold nothing new.
NOTHING = 1e-10
#: A residual below this, as a share of the largest eigenvalue met, is as good as none.
EXACT = 1e-10


def products(vectors: DataFrame, left: list[str], right: list[str]) -> np.ndarray:
    """The inner products of the columns ``left`` with the columns ``right``."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(left), len(right)))
        for batch in batches:
            a, b = ([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names] for names in (left, right))
            total += np.stack(a) @ np.stack(b).T
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "x"])

    found = np.zeros((len(left), len(right)))
    names = list(dict.fromkeys([*left, *right]))
    for r in vectors.select(*names).mapInArrow(part, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
        found[r["i"], r["j"]] = r["x"]
    return found


def _mixed(columns: list[str], by: np.ndarray) -> Column:
    return sum((F.col(c) * float(x) for c, x in zip(columns, by, strict=True) if x), F.lit(0.0))


def _directions(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combinations that make vectors of these inner products orthonormal, and the inner products' square roots; empty where nothing is left."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    keep = values > max(values.max(initial=0.0), 1.0) * NOTHING**2 * 1e4
    return vectors[:, keep] / np.sqrt(values[keep]), values[keep]


@tidy
def eigenpairs(nodes: DataFrame, apply: Callable[[DataFrame, list[str]], DataFrame], k: int, largest: bool = True, steps: int = 24, block: int | None = None) -> tuple[DataFrame, list[float], list[float]]:
    """``id, v0 .. `` of the ``k`` outermost eigenvectors of a symmetric operator, their eigenvalues and the lengths of their residuals.

    ``apply(vectors, columns)`` gives ``id`` and the images of those columns.
    A block of ``k`` starting vectors finds eigenvalues that occur up to ``k``
    times.  Steps end when all residuals vanish or nothing new comes; residuals
    tell how near the answer is otherwise.  Fewer nodes than ``k`` give as many
    vectors as nodes.
    """
    n, block = nodes.count(), block or k
    if k < 1 or not n:
        raise Invalid("eigenvectors are asked for in a number of at least one, of a graph with nodes")
    start = nodes.select("id", *[(F.pmod(F.xxhash64(F.lit(i), "id"), F.lit(2_000_003)) / 1_000_001.5 - 1).alias(f"w{i}") for i in range(min(block, n))])
    base, basis, fresh = materialise(start, "krylov"), [], [f"w{i}" for i in range(min(block, n))]
    blocks: list[list[str]] = []
    small = np.zeros((0, 0))
    values = mixes = residuals = None
    while True:
        # Twice made orthogonal: what rounding left the first time goes the second time.
        first = products(base, basis, fresh) if basis else np.zeros((0, len(fresh)))
        cleared = [(F.col(c) - _mixed(basis, first[:, i])).alias(c) for i, c in enumerate(fresh)]
        base2 = base.select("id", *basis, *cleared)
        gram = products(base2, [*basis, *fresh], fresh)
        second, gram = gram[: len(basis)], gram[len(basis) :]
        gram = gram - second.T @ second
        if blocks:
            width = len(blocks[-1])
            grown = np.zeros((len(basis), len(basis)))
            grown[: len(small), : len(small)] = small
            grown[:, -width:] = first + second
            grown[-width:, :] = (first + second).T
            small = (grown + grown.T) / 2
            values, mixes = np.linalg.eigh(small)
            pick = (np.argsort(-values) if largest else np.argsort(values))[:k]
            tail = mixes[-width:, pick]
            residuals = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", tail, gram, tail), 0))
            if len(pick) == min(k, n) and residuals.max() <= EXACT * max(1.0, np.abs(values).max()) or len(blocks) >= steps:
                break
        turn, _ = _directions(gram)
        turn = turn[:, : n - len(basis)]
        if not turn.shape[1]:
            break
        names = [f"q{len(basis) + i}" for i in range(turn.shape[1])]
        ready = base2.select("id", *basis, *[(F.col(c) - _mixed(basis, second[:, i])).alias(c) for i, c in enumerate(fresh)])
        ready = materialise(ready.select("id", *basis, *[_mixed(fresh, turn[:, i]).alias(q) for i, q in enumerate(names)]), "krylov")
        images = apply(ready, names).toDF("id", *[f"w{i}" for i in range(len(names))])
        new = materialise(ready.join(images, "id"), "krylov")
        for table in (base, ready):
            discard(nodes.sparkSession, table)
        base, basis, fresh = new, [*basis, *names], [f"w{i}" for i in range(len(names))]
        blocks.append(names)
    pick = (np.argsort(-values) if largest else np.argsort(values))[:k]
    found = base.select("id", *[_mixed(basis, mixes[:, p]).alias(f"v{i}") for i, p in enumerate(pick)])
    return materialise(found, "eigenvectors"), [float(values[p]) for p in pick], [float(r) for r in residuals]


def neighbours(graph: Graph) -> Callable[[DataFrame, list[str]], DataFrame]:
    """Of every node the sums of columns over its neighbours, loops left out."""
    arcs = graph.arcs.where("src <> dst").select("src", "dst")

    def apply(vectors: DataFrame, columns: list[str]) -> DataFrame:
        got = arcs.join(vectors.select(F.col("id").alias("src"), *columns), "src").groupBy(F.col("dst").alias("id")).agg(*[F.sum(c).alias(c) for c in columns])
        return graph.nodes.join(got, "id", "left").select("id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in columns])

    return apply


def _plain(graph: Graph) -> tuple[Graph, DataFrame]:
    """The graph and ``id``, ``k``: every node's number of neighbours."""
    graph = graph.written()
    graph.need(directed=False)
    count = graph.arcs.where("src <> dst").groupBy(F.col("src").alias("id")).agg(F.count("*").cast("double").alias("k"))
    return graph, materialise(graph.nodes.join(count, "id", "left").select("id", F.coalesce("k", F.lit(0.0)).alias("k")), "degrees")


@tidy
def leading_eigenvector(graph: Graph, steps: int = 24) -> DataFrame:
    """``id``, ``x``, ``side``, ``eigenvalue``, ``residual``, ``worth``: the sign of the modularity matrix's leading eigenvector parts the nodes.

    The matrix is adjacency less degree times degree over twice the edges: a
    product is a join and one sum over the table.  ``side`` is the smallest node
    on the node's own side; where the eigenvalue is not positive no split is
    worth it (``worth``) and all nodes have one side.  Weights and loops do not count.
    """
    graph, degree = _plain(graph)
    twice = degree.agg(F.sum("k")).first()[0] or 0.0
    if not twice:
        raise Invalid("a graph without edges has no modularity")
    near = neighbours(graph)

    def apply(vectors: DataFrame, columns: list[str]) -> DataFrame:
        share = vectors.join(degree, "id").agg(*[(F.sum(F.col(c) * F.col("k")) / twice).alias(f"s_{c}") for c in columns])
        return near(vectors, columns).join(degree, "id").crossJoin(F.broadcast(share)).select("id", *[(F.col(c) - F.col("k") * F.col(f"s_{c}")).alias(c) for c in columns])

    found, (value, *_), (residual, *_) = eigenpairs(graph.nodes, apply, 1, steps=steps)
    worth = value > 1e-9
    # Entries of rounding's size belong to the side of those not above zero.
    up = (F.col("v0") > 1e-9) if worth else F.lit(False)
    sides = found.groupBy(up.alias("up")).agg(F.min("id").alias("side"))
    return materialise(found.select("id", F.col("v0").alias("x"), up.alias("up")).join(F.broadcast(sides), "up").select("id", "x", "side", F.lit(value).alias("eigenvalue"), F.lit(residual).alias("residual"), F.lit(worth).alias("worth")), "sides")


def _gap(columns: list[str], centre: list[float]) -> Column:
    return sum(((F.col(c) - float(x)) * (F.col(c) - float(x)) for c, x in zip(columns, centre, strict=True)), F.lit(0.0))


@tidy
def spectral_clusters(graph: Graph, k: int, steps: int = 24, most: int = 100) -> DataFrame:
    """``id``, ``cluster`` (its smallest node): k-means of the nodes' entries in the k smallest Laplacian eigenvectors, rows of length 1.

    Centres start at the smallest node and then at the node farthest from all
    centres before (ties to the smaller name), and move until no node changes
    its centre; more than ``most`` moves are refused.  Only centres, k times k
    numbers, are on the driver.
    """
    graph, degree = _plain(graph)
    if not 1 <= k <= graph.nodes.count():
        raise Invalid("the number of clusters lies between one and the number of nodes")
    near = neighbours(graph)

    def apply(vectors: DataFrame, columns: list[str]) -> DataFrame:
        sums = near(vectors, columns).toDF("id", *[f"n_{c}" for c in columns])
        return vectors.select("id", *columns).join(degree, "id").join(sums, "id").select("id", *[(F.col("k") * F.col(c) - F.col(f"n_{c}")).alias(c) for c in columns])

    found, values, _ = eigenpairs(graph.nodes, apply, k, largest=False, steps=steps)
    columns = [f"v{i}" for i in range(len(values))]
    size = F.sqrt(_gap(columns, [0.0] * len(columns)))
    points = materialise(found.select("id", *[F.when(size > 1e-12, F.col(c) / size).otherwise(F.col(c)).alias(c) for c in columns]), "points")
    row = points.orderBy("id").first()
    centres = [[row[c] for c in columns]]
    while len(centres) < k:
        # Distances that rounding tells apart count as equal.
        far = F.round(F.least(*gaps), 9) if len(gaps := [_gap(columns, c) for c in centres]) > 1 else F.round(gaps[0], 9)
        row = points.withColumn("far", far).orderBy(F.desc("far"), "id").first()
        centres.append([row[c] for c in columns])
    before = None
    for _ in range(most):
        near_to = F.array_min(F.array(*[F.struct(F.round(_gap(columns, c), 12).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]))["i"]
        placed = points.withColumn("label", near_to)
        told = {r["label"]: r for r in placed.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("who"), *[F.avg(c).alias(c) for c in columns]).collect()}
        now = {i: (r["n"], r["who"]) for i, r in told.items()}
        if now == before:
            names = placed.groupBy("label").agg(F.min("id").alias("cluster"))
            return materialise(placed.select("id", "label").join(F.broadcast(names), "label").select("id", "cluster"), "clusters")
        before = now
        centres = [[told[i][c] for c in columns] if i in told else centre for i, centre in enumerate(centres)]
    raise Invalid(f"centres still move after {most} rounds")
