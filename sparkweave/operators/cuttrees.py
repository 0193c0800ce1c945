"""Lightest cuts between all pairs of nodes as one tree, from batches of flows computed together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.model import Graph
from sparkweave.operators.flows import maximum_flow
from sparkweave.operators.paths import relax
from sparkweave.session import discard, materialise, tidy

#: Flows that run together, each on a copy of the graph: the copies' rows are this many times the arcs.
AT_ONCE = 64
_CUT = "|"


def _flows(arcs: DataFrame, batch: list[tuple[str, str]]) -> tuple[dict[int, float], DataFrame]:
    """The greatest flow of every pair of ``batch``, and ``k``, ``id`` of its smallest source side.

    Every pair has a copy of the graph; one more source and sink tie the copies
    to one network, so that one run of pushes fills all of them.  What enters a
    copy is bounded by the weight at its source, which no flow exceeds.
    """
    spark = arcs.sparkSession
    pairs = F.broadcast(spark.createDataFrame([(k, v, p) for k, (v, p) in enumerate(batch)], "k int, v string, p string"))
    named = lambda c: F.concat_ws(_CUT, F.col("k").cast("string"), F.col(c))
    copies = arcs.crossJoin(pairs.select("k")).select(named("src").alias("src"), named("dst").alias("dst"), "w")
    room = arcs.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("w"))
    into = room.join(pairs, F.col("id") == F.col("v")).select(F.lit("from").alias("src"), named("v").alias("dst"), "w")
    out = room.join(pairs, F.col("id") == F.col("p")).select(named("p").alias("src"), F.lit("to").alias("dst"), "w")
    # Both ends are nodes even where no pair has an edge at one of them.
    nodes = spark.createDataFrame([("from",), ("to",)], "id string")
    sent, side = maximum_flow(Graph.of(copies.unionByName(into).unionByName(out), True, nodes), "from", "to")
    place = lambda c: F.substring_index(c, _CUT, 1).cast("int")
    values = {k: 0.0 for k in range(len(batch))} | {r["k"]: r["flow"] for r in sent.where("src = 'from'").select(place("dst").alias("k"), "flow").collect()}
    inside = side.where("id <> 'from'").select(place("id").alias("k"), F.expr(f"substring(id, instr(id, '{_CUT}') + 1)").alias("id"))
    return values, inside.unionByName(pairs.select("k", F.col("v").alias("id"))).distinct()


@tidy
def cut_tree(graph: Graph, at_once: int = AT_ONCE) -> tuple[DataFrame, DataFrame]:
    """``id``, ``parent``, ``weight`` of a tree, and ``id`` of one side of the graph's lightest cut.

    The lightest cut between two nodes weighs as much as the lightest tree edge
    between them.  All nodes hang under the smallest one at first.  A round cuts
    ``at_once`` nodes from their parents; a node is settled unless it lies on
    the side of one settled before it under the same parent, and what lies on
    such a side and is not settled is hung there.  So the rounds go with the
    tree's depth and with nodes by ``at_once``, not with one flow after the
    other; nodes less one flows are needed in any case.  The tree answers
    weights; only the side that is returned is said to be a cut itself.  One
    node alone has a tree of itself and no side; its parent and weight are null.
    A part of its own hangs at weight 0.  Negative weights are refused.
    """
    graph = graph.written()
    graph.need(directed=False, least=1)
    spark = graph.spark
    arcs = materialise(graph.arcs.where("src <> dst").select("src", "dst", "w"), "arcs")
    root = graph.nodes.agg(F.min("id")).first()[0]
    hung = F.when(F.col("id") != root, F.lit(root))
    tree = materialise(graph.nodes.select("id", hung.alias("parent"), F.lit(None).cast("double").alias("weight")), "tree")
    best, side = None, materialise(graph.nodes.where("false").select("id"), "side")
    while True:
        # As many rows as there are flows at once.
        batch = [(r["id"], r["parent"]) for r in tree.where("parent is not null and weight is null").orderBy(F.xxhash64("id"), "id").limit(at_once).collect()]
        if not batch:
            return tree, side
        values, found = _flows(arcs, batch)
        inside = materialise(found, "sides")
        at = {v: k for k, (v, _) in enumerate(batch)}
        members = spark.createDataFrame([(v,) for v in at], "id string")
        within: dict[int, set[int]] = {}
        # No more rows than flows at once by flows at once.
        for row in inside.join(F.broadcast(members), "id").collect():
            within.setdefault(row["k"], set()).add(at[row["id"]])
        settled: list[int] = []
        for k, (_, parent) in enumerate(batch):
            if not any(batch[j][1] == parent and k in within[j] for j in settled):
                settled.append(k)
        done = spark.createDataFrame([(k, batch[k][0], batch[k][1], float(values[k])) for k in settled], "k int, v string, p string, value double")
        moved = inside.join(F.broadcast(done), "k").groupBy("id", F.col("p").alias("parent")).agg(F.min(F.struct("k", "v")).alias("first"))
        own = done.select(F.col("v").alias("id"), "value")
        after = tree.join(F.broadcast(own), "id", "left").join(moved, ["id", "parent"], "left")
        free = F.col("weight").isNull() & F.col("value").isNull()
        new = materialise(after.select("id", F.when(free & F.col("first").isNotNull(), F.col("first.v")).otherwise(F.col("parent")).alias("parent"), F.coalesce("weight", "value").alias("weight")), "tree")
        lightest = min(settled, key=lambda k: (values[k], k))
        if best is None or values[lightest] < best:
            best = values[lightest]
            side = materialise(inside.where(F.col("k") == lightest).select("id"), "side")
        for table in (tree, inside):
            discard(spark, table)
        tree = new


@tidy
def pair_cuts(tree: DataFrame) -> DataFrame:
    """``a``, ``b``, ``min_cut`` for all pairs a < b of a cut tree's nodes: the lightest edge between them. A row for each pair."""
    ties = Graph.of(tree.where("parent is not null").select(F.col("id").alias("src"), F.col("parent").alias("dst"), F.col("weight").alias("w")), nodes=tree.select("id"))
    seeds = tree.select("id", F.col("id").alias("origin"), F.lit(float("inf")).alias("dist"))
    found = relax(ties, seeds, kind="wide")
    return found.where("origin < id").select(F.col("origin").alias("a"), F.col("id").alias("b"), F.col("dist").alias("min_cut"))


@tidy
def lightest_cut(graph: Graph, at_once: int = AT_ONCE) -> tuple[DataFrame, DataFrame]:
    """``weight``, ``n_side``, ``crossing`` (what the side's edges weigh) of the lightest cut that parts a graph, and ``id`` of its side.

    A graph of fewer than two nodes is refused.
    """
    graph = graph.written()
    graph.need(directed=False, least=2)
    tree, side = cut_tree(graph, at_once)
    here, there = side.select(F.col("id").alias("src")), side.select(F.col("id").alias("dst"))
    crossing = graph.arcs.where("src <> dst").join(here, "src", "left_semi").join(there, "dst", "left_anti").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("crossing"))
    row = tree.agg(F.min("weight").alias("weight")).crossJoin(side.agg(F.count("*").alias("n_side"))).crossJoin(crossing)
    return materialise(row.select("weight", "n_side", "crossing"), "lightest"), side
