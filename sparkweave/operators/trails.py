"""Euler trails: circuits of a pairing at every node, merged along a spanning forest, ranked as one list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.errors import Invalid
from sparkweave.model import Graph
from sparkweave.operators.cohesion import spanning_forest
from sparkweave.operators.orders import numbered, ranked
from sparkweave.plans.components import star_components
from sparkweave.session import materialise, tidy


def _parts(arcs: DataFrame) -> DataFrame:
    """``node``, ``component`` of every end of an arc."""
    ends = arcs.select(F.col("src").alias("node")).union(arcs.select("dst")).distinct()
    found = star_components(arcs.select("src", "dst"), "src", "dst")
    return materialise(ends.join(found.withColumnRenamed("id", "node"), "node", "left").select("node", F.coalesce("component", "node").alias("component")), "parts")


@tidy
def directed_trails(arcs: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """``component``, ``position`` (from 1), ``id``, ``src``, ``dst``: a trail over all ``arcs(id, src, dst)`` of each component, once each.

    Arcs may be parallel and may be loops; ids are distinct.  A component whose
    nodes all have as many arcs in as out gives a circuit from its smallest id,
    one with a node of one more out and a node of one more in a trail from the
    former to the latter; any other is refused.  ``parts(node, component)`` are
    the components, if they are at hand.
    """
    arcs = materialise(arcs.select("id", F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")), "arcs")
    parts = _parts(arcs) if parts is None else parts
    net = arcs.select(F.col("src").alias("node"), F.lit(1).alias("x")).union(arcs.select("dst", F.lit(-1))).groupBy("node").agg(F.sum("x").alias("x")).where("x <> 0").join(parts, "node")
    odd = materialise(net.groupBy("component").agg(F.count("*").alias("n"), F.max("x").alias("most"), F.min("x").alias("least"), F.max_by("node", "x").alias("start"), F.min_by("node", "x").alias("end")), "odd")
    if not odd.where("n <> 2 or most <> 1 or least <> -1").isEmpty():
        raise Invalid("some component has no trail over all its arcs")
    # An arc from end to start closes an open trail.
    closed = arcs.select("id", "src", "dst", F.lit(False).alias("added")).unionByName(odd.select(F.lit(None).cast(dict(arcs.dtypes)["id"]).alias("id"), F.col("end").alias("src"), F.col("start").alias("dst"), F.lit(True).alias("added")))
    every = materialise(numbered(closed, "id", "src", name="k").join(parts.withColumnRenamed("node", "src"), "src"), "every")
    # As many arcs come in as go out, so both stand at the same places if sorted by node.
    come = numbered(every.select("dst", "k"), "dst", "k").select("place", "k", F.col("dst").alias("node"))
    go = numbered(every.select("src", "k"), "src", "k").select("place", F.col("k").alias("next"))
    paired = materialise(come.join(go, "place").select("k", "node", "next"), "pairs")
    circuit = materialise(paired.select("k").join(star_components(paired, "k", "next").toDF("k", "circuit"), "k", "left").select("k", F.coalesce("circuit", "k").alias("circuit")), "circuits")
    # Circuits and the nodes that they pass, one arc for each; a spanning forest tells where they are merged.
    met = materialise(paired.join(circuit, "k").groupBy(F.col("circuit").cast("string").alias("circuit"), "node").agg(F.min("k").alias("k")), "met")
    tree = spanning_forest(Graph.of(met.select(F.concat(F.lit("c"), "circuit").alias("src"), F.concat(F.lit("n"), "node").alias("dst"))))
    chosen = tree.select(F.substr("src", F.lit(2)).alias("circuit"), F.substr("dst", F.lit(2)).alias("node"))
    turned = materialise(numbered(met.join(chosen, ["circuit", "node"], "left_semi").select("node", "k"), "node", "k", name="at"), "turned")
    span = turned.groupBy("node").agg(F.min("at").alias("first"), F.max("at").alias("end"))
    following = turned.join(span, "node").select("k", F.when(F.col("at") == F.col("end"), F.col("first")).otherwise(F.col("at") + 1).alias("at"))
    swapped = following.join(turned.select("at", F.col("k").alias("other")), "at").join(paired.select(F.col("k").alias("other"), F.col("next").alias("new")), "other").select("k", "new")
    whole = materialise(paired.join(swapped, "k", "left").select("k", F.coalesce("new", "next").alias("next")), "whole")
    # Trails begin after the added arc, circuits at their smallest.
    first = every.groupBy("component").agg(F.max(F.when(F.col("added"), F.col("k"))).alias("added"), F.min("k").alias("least"))
    cut = first.select(F.coalesce("added", "least").alias("next"), F.lit(True).alias("stop"))
    links = whole.join(cut, "next", "left").select(F.col("k").alias("id"), F.when(F.col("stop").isNull(), F.col("next")).alias("next"), F.lit(1).cast("bigint").alias("left"))
    rank = ranked(links, "left").select(F.col("id").alias("k"), "left")
    size = every.where(~F.col("added")).groupBy("component").agg(F.count("*").alias("n"))
    return every.where(~F.col("added")).join(rank, "k").join(size, "component").select("component", (F.col("n") + 1 - F.col("left")).alias("position"), "id", "src", "dst")


@tidy
def undirected_trails(edges: DataFrame) -> DataFrame:
    """The same over ``edges(id, src, dst)`` that may be walked either way; ``src`` and ``dst`` are as walked.

    A component with more than two nodes of odd degree is refused.  Ends of
    edges are paired at every node; each circuit of the pairing is there in both
    directions, of which that of the smaller name is kept.
    """
    edges = materialise(edges.select("id", F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")), "edges")
    parts = _parts(edges)
    degree = edges.select(F.col("src").alias("node")).union(edges.select("dst")).groupBy("node").agg(F.count("*").alias("d")).where("d % 2 = 1").join(parts, "node")
    odd = materialise(degree.groupBy("component").agg(F.count("*").alias("n"), F.min("node").alias("a"), F.max("node").alias("b")), "odd")
    if not odd.where("n <> 2").isEmpty():
        raise Invalid("some component has more than two nodes of odd degree")
    closed = edges.unionByName(odd.select(F.lit(None).cast(dict(edges.dtypes)["id"]).alias("id"), F.col("b").alias("src"), F.col("a").alias("dst")))
    every = materialise(numbered(closed, "id", "src", name="k"), "every")
    # State 2 k walks an edge as given, 2 k + 1 the other way; a state ends at one node and begins at the other.
    ends = every.select(F.col("src").alias("node"), (2 * F.col("k")).alias("leaves"), (2 * F.col("k") + 1).alias("comes")).union(every.select("dst", 2 * F.col("k") + 1, 2 * F.col("k")))
    placed = materialise(numbered(ends, "node", "leaves"), "ends")
    # Degrees are even, so partners stand at 1 and 2, at 3 and 4, ...
    mate = placed.select(F.when(F.col("place") % 2 == 1, F.col("place") + 1).otherwise(F.col("place") - 1).alias("place"), "comes")
    steps = materialise(placed.select("place", "leaves").join(mate, "place").select("comes", "leaves"), "steps")
    ring = star_components(steps, "comes", "leaves").toDF("state", "ring")
    states = materialise(steps.select(F.col("comes").alias("state")).join(ring, "state", "left").select("state", F.coalesce("ring", "state").alias("ring")), "rings")
    kept = states.groupBy(F.expr("state div 2").alias("k")).agg(F.min_by("state", "ring").alias("state"))
    walked = every.join(kept, "k").select("k", "id", *[F.when(F.col("state") % 2 == 0, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (("src", "dst"), ("dst", "src"))])
    walked = materialise(walked.where("id is not null"), "walked")
    return directed_trails(walked.select("id", "src", "dst"), parts)
