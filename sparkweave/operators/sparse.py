"""Fewer edges for a purpose: feedback sets that break all cycles, and spanners that keep distances within a factor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.errors import Invalid
from sparkweave.model import Graph
from sparkweave.plans.components import star_components
from sparkweave.session import discard, materialise, tidy


@tidy
def feedback_order(graph: Graph) -> DataFrame:
    """``id``, ``front``, ``turn``: nodes of a digraph peeled from both ends of an order that few arcs run against.

    Each round places all sources at the front and all sinks at the back; where
    there is neither, every connected part places the node whose arcs out and
    in differ most (ties to more arcs, then the larger name) at the end that
    costs fewer arcs.  Front nodes come by rising ``turn``, then back nodes by
    falling ``turn``; nodes of one end and turn share no arc.  Rounds go with
    the depth of the order and the choices within one part.
    """
    graph = graph.written()
    graph.need(directed=True)
    arcs = materialise(graph.arcs.where("src <> dst").select("src", "dst"), "arcs")
    left, placed, turn = materialise(graph.nodes.select("id"), "open"), None, 0
    while not left.isEmpty():
        turn += 1
        out = arcs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("o"))
        into = arcs.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("i"))
        zero = F.lit(0)
        own = materialise(left.join(out, "id", "left").join(into, "id", "left").select("id", F.coalesce("o", zero).alias("o"), F.coalesce("i", zero).alias("i")), "degrees")
        gone = own.where("o = 0 or i = 0").select("id", (F.col("i") == 0).alias("front"))
        if gone.isEmpty():
            part = star_components(arcs, "src", "dst")
            best = F.max(F.struct(F.abs(F.col("o") - F.col("i")).alias("gap"), (F.col("o") + F.col("i")).alias("all"), "id", (F.col("o") >= F.col("i")).alias("front")))
            gone = own.join(part, "id").groupBy("component").agg(best.alias("b")).select("b.id", "b.front")
        gone = materialise(gone.withColumn("turn", F.lit(turn)), "placed")
        placed = gone if placed is None else placed.unionByName(gone)
        ids = gone.select("id")
        rest = materialise(arcs.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"), "arcs")
        still = materialise(left.join(ids, "id", "left_anti"), "open")
        for table in (arcs, left, own):
            discard(graph.spark, table)
        arcs, left = rest, still
    return placed if placed is not None else graph.nodes.select("id", F.lit(True).alias("front"), F.lit(0).alias("turn"))


@tidy
def feedback_arcs(graph: Graph) -> DataFrame:
    """``src``, ``dst``, ``w``: arcs without which a digraph has no cycle, loops among them.

    Of the others at most half are taken, since each choice costs the fewer of
    a node's arcs in and out.  An acyclic graph loses none.
    """
    graph = graph.written()
    order = materialise(feedback_order(graph), "order")
    # Greater keys come later: the front by its turn, the back against it.
    key = F.when(F.col("front"), F.col("turn")).otherwise(F.lit(1 << 40) - F.col("turn"))
    at = order.select("id", key.alias("key"))
    both = graph.edges.join(at.toDF("src", "a"), "src").join(at.toDF("dst", "b"), "dst")
    return materialise(both.where("a > b or src = dst").select("src", "dst", "w"), "feedback")


@tidy
def feedback_nodes(graph: Graph) -> DataFrame:
    """``id`` of nodes without which an undirected graph is a forest.

    Nodes with a loop go first.  Then nodes of at most one neighbour are
    peeled off, round by round, and every connected part that is left gives up
    the node with the most neighbours (ties to the smaller name).  Never fewer
    than the fewest; a forest gives none.
    """
    graph = graph.written()
    graph.need(directed=False)
    loops = materialise(graph.edges.where("src = dst").select(F.col("src").alias("id")), "taken")
    plain = graph.edges.where("src <> dst").select("src", "dst")
    taken, gone = loops, loops
    arcs = materialise(plain.union(plain.select("dst", "src")), "arcs")
    while True:
        rest = materialise(arcs.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti").select("src", "dst"), "arcs")
        discard(graph.spark, arcs)
        arcs = rest
        if arcs.isEmpty():
            return taken
        own = materialise(arcs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("k")), "degrees")
        gone = own.where("k = 1").select("id")
        if gone.isEmpty():
            part = star_components(arcs.where("src < dst"), "src", "dst")
            # The greatest degree, then the smallest name.
            top = own.join(part, "id").groupBy("component").agg(F.min(F.struct((-F.col("k")).alias("k"), "id")).alias("b"))
            gone = materialise(top.select("b.id"), "taken")
            taken = taken.unionByName(gone)


def _sampled(centre: str, turn: int, chance: float):
    """Whether a cluster is kept: the first 32 bits of a digest of its centre and the turn against ``chance``."""
    return F.substring(F.md5(F.concat(F.col(centre), F.lit(f"|{turn}")).cast("binary")), 1, 8) < F.lit(f"{min(int((1 << 32) * chance), (1 << 32) - 1):08x}")


@tidy
def spanner(graph: Graph, k: int) -> DataFrame:
    """``src``, ``dst``, ``w``: edges among which every distance is at most ``2 k - 1`` times what it was.

    Clusters are thinned ``k - 1`` times.  A node of a dropped cluster joins
    the nearest kept cluster beside it by its lightest edge, and keeps one
    lightest edge to each cluster that is nearer; without a kept cluster beside
    it, one to every cluster.  In the end each node keeps its lightest edge to every cluster
    left.  About k * n^(1 + 1 / k) edges stay; every round is a few joins on
    all nodes at once.  Edges are compared by weight, then ends; weights must
    not be negative; loops go.
    """
    graph = graph.written()
    graph.need(directed=False)
    if k < 1:
        raise Invalid("the stretch is at least one")
    if not graph.edges.where("w is null or isnan(w) or w < 0").isEmpty():
        raise Invalid("weights must not be negative")
    n = max(graph.nodes.count(), 1)
    edges = materialise(graph.edges.where("src <> dst").select("src", "dst", "w"), "edges")
    home = materialise(graph.nodes.select("id", F.col("id").alias("centre")), "clusters")
    kept = []

    def beside(edges: DataFrame, home: DataFrame) -> DataFrame:
        """``id``, ``to``, ``e``: each node's lightest edge to every cluster next to it."""
        e = F.struct("w", "src", "dst")
        ends = edges.select(F.col("src").alias("id"), F.col("dst").alias("far"), e.alias("e")).union(edges.select("dst", "src", e))
        return ends.join(home.toDF("far", "to"), "far").groupBy("id", "to").agg(F.min("e").alias("e"))

    for turn in range(1, k):
        stays = home.select("centre").distinct().where(_sampled("centre", turn, n ** (-1.0 / k)))
        inside = materialise(home.join(stays, "centre", "left_semi").select("id", "centre"), "clusters")
        loose = home.join(inside.select("id"), "id", "left_anti").select("id")
        links = materialise(beside(edges, home).join(loose, "id", "left_semi").join(stays.select(F.col("centre").alias("to"), F.lit(True).alias("stays")), "to", "left"), "links")
        joined = materialise(links.where("stays").groupBy("id").agg(F.min(F.struct("e", "to")).alias("b")).select("id", F.col("b.e").alias("best"), F.col("b.to").alias("centre")), "joined")
        taken = materialise(links.join(joined.select("id", "best"), "id", "left").where("best is null or e <= best").select("id", "to", "e"), "taken")
        kept.append(taken.select("e.src", "e.dst", "e.w"))
        after = materialise(inside.unionByName(joined.select("id", "centre")), "clusters")
        # Links that are decided go, and so do edges within a cluster.
        was = edges.join(home.toDF("src", "cs"), "src").join(home.toDF("dst", "cd"), "dst")
        done = taken.select("id", "to")
        rest = was.join(done.toDF("src", "cd"), ["src", "cd"], "left_anti").join(done.toDF("dst", "cs"), ["dst", "cs"], "left_anti").select("src", "dst", "w")
        rest = rest.join(after.toDF("src", "cs"), "src").join(after.toDF("dst", "cd"), "dst").where("cs <> cd").select("src", "dst", "w")
        edges, home = materialise(rest, "edges"), after
    kept.append(beside(edges, home).select("e.src", "e.dst", "e.w"))
    found = kept[0]
    for more in kept[1:]:
        found = found.unionByName(more)
    return materialise(found.distinct(), "spanner")
