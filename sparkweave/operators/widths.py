"""Widths of orders: bounds of a graph's treewidth by elimination, and of its pathwidth by nodes still live, with the core bound below both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.model import Graph
from sparkweave.operators.cohesion import core_numbers
from sparkweave.operators.orders import numbered
from sparkweave.operators.trees import level_order
from sparkweave.session import discard, materialise, tidy


@tidy
def elimination(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """``id``, ``turn``, ``degree``: nodes by the round that takes them out and their neighbours then; and ``src``, ``dst`` of the edges filled in.

    Taking a node out ties its neighbours to each other.  A bound starts at the
    smallest degree and rises only where no node is within it.  Each round
    takes out, all at once, the nodes within the bound that come before all
    their neighbours within it, by degree and then by hash; no two are
    neighbours, so each one's degree is what it would be one after the other,
    and the greatest degree is the order's width.  Filled-in edges are as many
    as the method needs: on dense graphs up to all pairs.
    """
    graph = graph.written()
    graph.need(directed=False)
    arcs = materialise(graph.arcs.where("src <> dst").select("src", "dst"), "arcs")
    alone = graph.nodes.join(arcs.select(F.col("src").alias("id")), "id", "left_anti").select("id", F.lit(0).alias("turn"), F.lit(0).cast("bigint").alias("degree"))
    taken, filled, bound, turn = materialise(alone, "taken"), None, 0, 0
    while not arcs.isEmpty():
        turn += 1
        degree = materialise(arcs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("k")), "degrees")
        bound = max(bound, degree.agg(F.min("k")).first()[0])
        within = degree.where(F.col("k") <= bound).select("id", F.struct("k", F.xxhash64("id").alias("h"), "id").alias("rank"))
        beaten = arcs.join(within.toDF("src", "a"), "src").join(within.toDF("dst", "b"), "dst").where("b < a").select(F.col("src").alias("id"))
        out = materialise(within.join(beaten, "id", "left_anti").select("id", F.lit(turn).alias("turn"), F.col("rank.k").alias("degree")), "taken")
        ends = arcs.join(out.select(F.col("id").alias("src")), "src", "left_semi")
        pairs = ends.join(ends.select("src", F.col("dst").alias("other")), "src").where("dst <> other").select(F.col("dst").alias("src"), F.col("other").alias("dst")).distinct()
        ids = out.select("id")
        rest = arcs.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst")
        new = materialise(pairs.join(rest, ["src", "dst"], "left_anti").select("src", "dst"), "filled")
        # A node whose last neighbour goes is left with none.
        after = materialise(rest.unionByName(new), "arcs")
        bare = materialise(degree.select("id").join(ids, "id", "left_anti").join(after.select(F.col("src").alias("id")), "id", "left_anti").select("id", F.lit(turn + 1).alias("turn"), F.lit(0).cast("bigint").alias("degree")), "taken")
        taken, made = taken.unionByName(out).unionByName(bare), new.where("src < dst")
        filled = made if filled is None else filled.unionByName(made)
        for table in (arcs, degree):
            discard(graph.spark, table)
        arcs = after
    return materialise(taken, "taken"), materialise(graph.edges.where("false").select("src", "dst") if filled is None else filled, "filled")


@tidy
def treewidth(graph: Graph) -> DataFrame:
    """``width``, ``least``, ``n_fill``, ``exact``: the treewidth is at most ``width`` and at least ``least``, the greatest core number.

    ``exact`` where both agree, as on trees, rings and full graphs.  A graph without nodes is refused.
    """
    graph = graph.written()
    graph.need(directed=False, least=1)
    taken, filled = elimination(graph)
    low = core_numbers(graph).agg(F.max("core").cast("bigint").alias("least"))
    width = taken.agg(F.max("degree").alias("width"))
    fill = filled.agg(F.count("*").alias("n_fill"))
    return materialise(width.crossJoin(low).crossJoin(fill).select("width", "least", "n_fill", (F.col("width") == F.col("least")).alias("exact")), "width")


@tidy
def separation(graph: Graph, order: DataFrame) -> DataFrame:
    """``separation``: the most nodes of an order ``(id, position)`` from 0 that, at one cut, still have a neighbour to come.

    A node is live from its own place to its last neighbour's.  Before the place
    at which some are let go, all that came earlier are live but those let go
    before, so one numbering by last places gives every such cut.
    """
    graph.need(directed=False)
    far = graph.arcs.where("src <> dst").join(order.toDF("dst", "there"), "dst").groupBy(F.col("src").alias("id")).agg(F.max("there").alias("there"))
    last = order.join(far, "id", "left").select("id", F.greatest("position", F.coalesce("there", "position")).alias("last"))
    let_go = numbered(last, "last", "id").groupBy("last").agg((F.min("place") - 1).alias("before"))
    # At the cut ahead of place p, p nodes are placed.
    return let_go.agg(F.coalesce(F.max(F.col("last") - F.col("before")), F.lit(0)).cast("bigint").alias("separation"))


@tidy
def pathwidth(graph: Graph) -> DataFrame:
    """``width``, ``least``, ``exact``: the pathwidth is at most the better separation of the level order and its reverse, and at least the greatest core number.

    A graph without nodes is refused; one without edges has width 0.
    """
    graph = graph.written()
    graph.need(directed=False, least=1)
    order = materialise(level_order(graph), "order")
    back = order.crossJoin(order.agg(F.max("position").alias("top"))).select("id", (F.col("top") - F.col("position")).alias("position"))
    width = separation(graph, order).unionByName(separation(graph, back)).agg(F.min("separation").alias("width"))
    low = core_numbers(graph).agg(F.max("core").cast("bigint").alias("least"))
    return materialise(width.crossJoin(low).select("width", "least", (F.col("width") == F.col("least")).alias("exact")), "width")


@tidy
def exact_pathwidth(graph: Graph, most: int = 16) -> DataFrame:
    """``width``: the least separation of all orders, over all sets of at most ``most`` nodes; more are refused.

    A row is a set of nodes placed so far, spread over the tasks; the best way
    to a set of k + 1 nodes is the best of those to its parts of k.
    """
    graph = graph.written()
    graph.need(directed=False, least=1, most=most)
    names = [r["id"] for r in graph.nodes.orderBy("id").collect()]
    bit = {v: i for i, v in enumerate(names)}
    near = [0] * len(names)
    for row in graph.arcs.where("src <> dst").select("src", "dst").collect():
        near[bit[row["src"]]] |= 1 << bit[row["dst"]]
    live = " + ".join(f"if((s & {1 << i}) <> 0 and ({m} & ~s) <> 0, 1, 0)" for i, m in enumerate(near))
    steps = "array(" + ", ".join(str(1 << i) for i in range(len(names))) + ")"
    now = graph.spark.createDataFrame([(0, 0)], "s int, width int")
    for _ in names:
        grown = now.select("s", "width", F.explode(F.expr(f"filter({steps}, b -> (s & b) = 0)")).alias("b")).select((F.col("s").bitwiseOR(F.col("b"))).alias("s"), "width")
        now = grown.groupBy("s").agg(F.min("width").alias("width")).select("s", F.greatest("width", F.expr(live)).alias("width"))
    return now.select(F.col("width").cast("bigint").alias("width"))
