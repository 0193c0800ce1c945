"""All maximal cliques: the branches of a search with pivots as rows, every round one level deeper for all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.model import Graph
from sparkweave.operators.cohesion import core_numbers
from sparkweave.operators.orders import numbered
from sparkweave.session import discard, materialise, tidy


@tidy
def maximal_cliques(graph: Graph) -> DataFrame:
    """``members`` (sorted), ``size`` of every maximal clique; a node without neighbours is one of its own.

    Nodes are ordered by core number, so a branch begins with a node and its
    later neighbours as candidates, at most as many as the greatest core, and
    its earlier ones as excluded.  A branch goes on with the candidates that
    are no neighbours of its pivot, the candidate or excluded node with most
    candidates around; a branch with neither candidates nor excluded is a
    maximal clique.  Rounds are as many as the largest clique has nodes.
    """
    graph = graph.need(directed=False).written()
    arcs = materialise(graph.arcs.where("src <> dst").select(F.col("src").alias("v"), F.col("dst").alias("u")), "arcs")
    order = materialise(numbered(core_numbers(graph), "core", "id", name="k").select("id", "k"), "order")
    states = materialise(order.select(F.col("k").alias("state"), F.array("id").alias("members")), "states")
    around = arcs.join(order.toDF("v", "state"), "v").join(order.toDF("u", "ku"), "u")
    # Candidates and excluded of a state in one table.
    held = materialise(around.select("state", "u", (F.col("ku") > F.col("state")).alias("candidate")), "held")
    found = None
    while not states.isEmpty():
        done = materialise(states.join(held.select("state").distinct(), "state", "left_anti").select("members"), "cliques")
        found = done if found is None else found.unionByName(done)
        candidates = held.where("candidate").select("state", "u")
        near = candidates.withColumnRenamed("u", "v").join(arcs, "v").join(held.select("state", "u"), ["state", "u"]).groupBy("state", "u").agg(F.count("*").alias("n"))
        pivot = near.groupBy("state").agg(F.max_by("u", F.struct("n", "u")).alias("pivot"))
        beside = pivot.join(arcs, pivot["pivot"] == arcs["v"]).select("state", "u")
        branch = candidates.join(beside, ["state", "u"], "left_anti").join(states, "state")
        branch = materialise(branch.select("state", F.col("u").alias("v"), F.array_append("members", F.col("u")).alias("members"), F.monotonically_increasing_id().alias("new")), "branches")
        # Of two branches of a state the later one excludes the node of the earlier one.
        taken = held.join(branch.select("state", F.col("v").alias("u"), F.lit(True).alias("branched")), ["state", "u"], "left")
        inner = branch.select("state", "v", "new").join(arcs, "v").join(taken, ["state", "u"])
        later = F.col("branched").isNotNull() & (F.col("u") < F.col("v"))
        after = materialise(inner.select(F.col("new").alias("state"), "u", (F.col("candidate") & ~later).alias("candidate")), "held")
        for table in (states, held):
            discard(graph.spark, table)
        states, held = branch.select(F.col("new").alias("state"), "members"), after
    if found is None:
        return graph.nodes.select(F.array("id").alias("members"), F.lit(1).alias("size"))
    return found.select(F.array_sort("members").alias("members"), F.size("members").alias("size"))
