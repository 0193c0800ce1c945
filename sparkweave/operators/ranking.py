"""Scores by repeated multiplication with the arcs: one join and one aggregation a round.

A fixed number of ``rounds`` or a ``tolerance`` ends the loop.  Each round's
vector is written, so the plan stays short.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.errors import Invalid
from sparkweave.model import Graph
from sparkweave.operators import packed
from sparkweave.operators.orders import numbered
from sparkweave.session import discard, materialise, tidy


def _loop(start: DataFrame, step, rounds: int | None, tolerance: float, most: int, square: bool = False) -> DataFrame:
    """Apply ``step`` to (id, x) until the summed change falls below ``tolerance`` or for ``rounds``.

    Where no number of rounds is given, a vector that still moves after ``most`` of them is refused.
    """
    now = materialise(start, "vector")
    for _ in range(rounds if rounds is not None else most):
        new = materialise(step(now), "vector")
        if rounds is None:
            moved = new.join(now.withColumnRenamed("x", "y"), "id").agg(F.sum(F.abs(F.col("x") - F.col("y")))).first()[0] or 0.0
        discard(now.sparkSession, now)
        now = new
        if rounds is None and moved < tolerance:
            return now
    if rounds is None:
        raise Invalid(f"scores still move after {most} rounds")
    return now


@tidy
def pagerank(graph: Graph, seeds: DataFrame | None = None, damping: float = 0.85, rounds: int | None = None, tolerance: float = 1e-9, most: int = 500) -> DataFrame:
    """``id``, ``rank``: unweighted PageRank; teleports and dangling mass go to all nodes, or to ``seeds(id)``."""
    graph = graph.written()
    arcs = graph.arcs.select("src", "dst")
    home = (graph.nodes if seeds is None else graph.nodes.join(seeds.select("id").distinct(), "id")).select("id")
    n = home.count()
    if not n:
        raise Invalid("there is no node to start from")
    out = arcs.groupBy("src").agg(F.count("*").alias("k"))
    links = materialise(arcs.join(out, "src"), "links")
    base = materialise(graph.nodes.join(home.withColumn("h", F.lit(1.0 / n)), "id", "left").select("id", F.coalesce("h", F.lit(0.0)).alias("h")), "home")
    dangling = base.join(out.select(F.col("src").alias("id")), "id", "left_anti").select("id")

    def step(now: DataFrame) -> DataFrame:
        lost = now.join(dangling, "id").agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("lost"))
        got = links.join(now.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("x") / F.col("k")).alias("in"))
        return base.join(got, "id", "left").crossJoin(F.broadcast(lost)).select("id", ((1 - damping) * F.col("h") + damping * (F.coalesce("in", F.lit(0.0)) + F.col("lost") * F.col("h"))).alias("x"))

    return _loop(base.select("id", F.col("h").alias("x")), step, rounds, tolerance, most).select("id", F.round("x", 6).alias("rank"))


def _norm(v: DataFrame) -> DataFrame:
    size = v.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("s"))
    return v.crossJoin(F.broadcast(size)).select("id", F.when(F.col("s") > 0, F.col("x") / F.col("s")).otherwise(0.0).alias("x"))


def _times(arcs: DataFrame, nodes: DataFrame, v: DataFrame, weighted: bool = False) -> DataFrame:
    """For every node the sum of v over its predecessors."""
    value = F.col("x") * F.col("w") if weighted else F.col("x")
    got = arcs.join(v.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(value).alias("x"))
    return nodes.join(got, "id", "left").select("id", F.coalesce("x", F.lit(0.0)).alias("x"))


@tidy
def hits(graph: Graph, rounds: int | None = None, tolerance: float = 1e-10, most: int = 1000) -> DataFrame:
    """``id``, ``hub``, ``authority``: each normalised every round, hubs from the new authorities."""
    graph = graph.written()
    graph.need(directed=True)
    n = max(graph.nodes.count(), 1)
    back = graph.reverse.arcs

    def step(hub: DataFrame) -> DataFrame:
        return _norm(_times(back, graph.nodes, _norm(_times(graph.arcs, graph.nodes, hub))))

    hub = _loop(graph.nodes.select("id", F.lit(1.0 / math.sqrt(n)).alias("x")), step, rounds, tolerance, most)
    authority = _norm(_times(graph.arcs, graph.nodes, hub))
    return hub.withColumnRenamed("x", "hub").join(authority.withColumnRenamed("x", "authority"), "id").select("id", F.round("hub", 5).alias("hub"), F.round("authority", 5).alias("authority"))


@tidy
def spectral_radius(graph: Graph, rounds: int = 60) -> float:
    """The largest eigenvalue of the adjacency of a graph, by power iteration on A + 1 (bipartite graphs included)."""
    graph = graph.written()
    n = max(graph.nodes.count(), 1)

    def step(v: DataFrame) -> DataFrame:
        return _norm(_times(graph.arcs, graph.nodes, v).union(v).groupBy("id").agg(F.sum("x").alias("x")))

    v = _loop(graph.nodes.select("id", F.lit(1.0 / math.sqrt(n)).alias("x")), step, rounds, 0.0, rounds)
    image = _times(graph.arcs, graph.nodes, v).withColumnRenamed("x", "y")
    return float(v.join(image, "id").agg(F.sum(F.col("x") * F.col("y"))).first()[0] or 0.0)


@tidy
def katz(graph: Graph, alpha: float = 0.1, beta: float = 1.0, rounds: int | None = None, tolerance: float = 1e-10, most: int = 500, guard: bool = True) -> DataFrame:
    """``id``, ``katz``: beta + alpha * predecessors, L2-normalised; alpha at or over 1 / radius is refused."""
    graph = graph.written()
    if guard:
        radius = spectral_radius(graph)
        if radius > 0 and alpha >= 1 / radius:
            raise Invalid(f"alpha {alpha} is not below 1 / {radius:.4g}")
    start = graph.nodes.select("id", F.lit(beta).alias("x"))
    v = _loop(start, lambda now: _times(graph.arcs, graph.nodes, now).select("id", (F.lit(beta) + alpha * F.col("x")).alias("x")), rounds, tolerance, most)
    return _norm(v).select("id", F.round("x", 6).alias("katz"))


@tidy
def eigenvector(graph: Graph, rounds: int | None = None, tolerance: float = 1e-10, most: int = 1000) -> DataFrame:
    """``id``, ``eigenvector``: the leading eigenvector of an undirected, connected graph that is not bipartite."""
    graph = graph.written()
    graph.need(directed=False)
    n = max(graph.nodes.count(), 1)
    start = graph.nodes.select("id", F.lit(1.0 / math.sqrt(n)).alias("x"))
    return _loop(start, lambda v: _norm(_times(graph.arcs, graph.nodes, v)), rounds, tolerance, most).select("id", F.round("x", 6).alias("eigenvector"))


@tidy
def fiedler(graph: Graph, rounds: int = 300) -> DataFrame:
    """``id``, ``x``, ``side``: power iteration on c - L, the constant vector removed; the sign of x splits the nodes."""
    graph = graph.written()
    graph.need(directed=False, least=2)
    degree = graph.arcs.where("src <> dst").groupBy(F.col("src").alias("id")).agg(F.count("*").cast("double").alias("d"))
    top = 2 * float(degree.agg(F.max("d")).first()[0] or 1.0)
    nodes = materialise(graph.nodes.join(degree, "id", "left").select("id", F.coalesce("d", F.lit(0.0)).alias("d")), "degrees")
    arcs = graph.arcs.where("src <> dst")

    def centred(v: DataFrame) -> DataFrame:
        return v.crossJoin(F.broadcast(v.agg(F.avg("x").alias("m")))).select("id", (F.col("x") - F.col("m")).alias("x"))

    def step(v: DataFrame) -> DataFrame:
        image = _times(arcs, nodes.select("id"), v).withColumnRenamed("x", "ax")
        return _norm(centred(v.join(nodes, "id").join(image, "id").select("id", ((top - F.col("d")) * F.col("x") + F.col("ax")).alias("x"))))

    start = _norm(centred(nodes.select("id", (F.pmod(F.xxhash64("id"), F.lit(10007)) / 10007.0).alias("x"))))
    # Several steps go between two writes, as each is one join over the arcs.
    v = _loop(start, lambda x: step(step(x)), max(1, rounds // 2), 0.0, rounds)
    return v.select("id", "x", (F.col("x") > 0).alias("side"))


def algebraic_connectivity(graph: Graph, vector: DataFrame) -> float:
    """The Rayleigh quotient of a vector (id, x): the sum of squared differences along edges over its squared norm."""
    a, b = vector.select(F.col("id").alias("src"), F.col("x").alias("xs")), vector.select(F.col("id").alias("dst"), F.col("x").alias("xd"))
    top = graph.edges.join(a, "src").join(b, "dst").agg(F.sum((F.col("xs") - F.col("xd")) ** 2)).first()[0] or 0.0
    return float(top / vector.agg(F.sum(F.col("x") ** 2)).first()[0])


@tidy
def simrank(graph: Graph, decay: float = 0.8, rounds: int = 5) -> DataFrame:
    """``a``, ``b``, ``simrank`` of pairs a < b with a score above 0, after ``rounds`` rounds."""
    graph = graph.written()
    arcs = graph.arcs.select("src", "dst")
    into = arcs.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("k"))
    own = graph.nodes.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("s"))
    now = materialise(own, "pairs")
    left, right = arcs.select(F.col("src").alias("a"), F.col("dst").alias("x")), arcs.select(F.col("src").alias("b"), F.col("dst").alias("y"))
    for _ in range(rounds):
        got = now.join(left, "a").groupBy("x", "b").agg(F.sum("s").alias("s")).join(right, "b").where("x <> y").groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("s").alias("s"))
        scaled = got.join(into.toDF("a", "ka"), "a").join(into.toDF("b", "kb"), "b").select("a", "b", (decay * F.col("s") / F.col("ka") / F.col("kb")).alias("s"))
        new = materialise(scaled.unionByName(own), "pairs")
        discard(graph.spark, now)
        now = new
    return now.where("a < b").select("a", "b", F.round("s", 6).alias("simrank"))


@tidy
def walk_counts(graph: Graph, length: int) -> DataFrame:
    """``src``, ``dst``, ``walks``: exact numbers of walks of ``length`` arcs, by repeated sparse products.

    There may be a row for every pair of nodes, so these are never written: a
    task multiplies for some first nodes at a time while its rows are read
    (``packed.walks``). Where sums may pass 64 bits, products are tables.
    """
    graph = graph.written()
    # Names become numbers for the products; sums are long unless there may be too many walks for that.
    names = materialise(numbered(graph.nodes, "id", name="k").select("id", (F.col("k") - 1).alias("k")), "numbers")
    step = materialise(graph.arcs.join(names.toDF("src", "mid"), "src").join(names.toDF("dst", "b"), "dst").select("mid", "b"), "steps")
    most = step.groupBy("mid").count().agg(F.max("count")).first()[0] or 0
    if 0 < length and 0 < most**length < 1 << 63:
        return packed.walks(step.withColumnRenamed("mid", "a"), names, names.count(), length)
    kind = "bigint" if most**length < 1 << 63 else "decimal(38,0)"
    now = step.groupBy(F.col("mid").alias("a"), "b").agg(F.count("*").cast(kind).alias("walks"))
    # Walks are dealt by their first node before the product, so its many rows are added up where they are made.
    tasks = int(graph.spark.conf.get("spark.sql.shuffle.partitions"))
    for _ in range(length - 1):
        now = materialise(now.withColumnRenamed("b", "mid").repartition(tasks, "a").join(step, "mid").groupBy("a", "b").agg(F.sum("walks").cast(kind).alias("walks")), "walks")
    now = now.join(names.toDF("src", "a"), "a").join(names.toDF("dst", "b"), "b")
    return now.select("src", "dst", F.col("walks").cast("bigint").alias("walks"))


@tidy
def walk_kernel(first: Graph, second: Graph, decay: float = 0.1, depth: int = 10) -> float:
    """Sum over lengths of decay ** length times the common walks, on the pairs of nodes; arcs are joined one side at a time."""
    a, b = first.arcs.select(F.col("src").alias("x"), F.col("dst").alias("x2")), second.arcs.select(F.col("src").alias("y"), F.col("dst").alias("y2"))
    now = first.nodes.select(F.col("id").alias("x")).crossJoin(second.nodes.select(F.col("id").alias("y"))).withColumn("c", F.lit(1.0))
    total = float(now.count())
    for k in range(1, depth + 1):
        half = now.join(a, "x").groupBy(F.col("x2").alias("x"), "y").agg(F.sum("c").alias("c"))
        now = materialise(half.join(b, "y").groupBy("x", F.col("y2").alias("y")).agg(F.sum("c").alias("c")), "walks")
        total += decay**k * float(now.agg(F.coalesce(F.sum("c"), F.lit(0.0))).first()[0])
    return total
