"""Maximum flow by pushes, bipartite matching and path covers by augmenting rounds of joins, with no cap on size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from sparkweave.errors import Invalid
from sparkweave.model import Graph
from sparkweave.session import discard, materialise, tidy

#: Capacities at or below this count as used up.
NOTHING = 1e-9


def widest_way(residual: DataFrame, source: str, sink: str) -> tuple[Row | None, DataFrame]:
    """The widest of the shortest ways along ``residual(src, dst, left)``, or None; and ``id`` of the nodes reached until then."""
    seen = residual.sparkSession.createDataFrame([(source, [], float("inf"))], "id string, way array<struct<src:string,dst:string>>, width double")
    level = seen
    while True:
        step = level.join(residual.where(F.col("left") > NOTHING).withColumnRenamed("src", "id"), "id")
        far = step.join(seen.select(F.col("id").alias("dst")), "dst", "left_anti").select("dst", F.least("width", "left").alias("width"), F.array_append("way", F.struct(F.col("id").alias("src"), F.col("dst"))).alias("way"))
        level = materialise(far.groupBy(F.col("dst").alias("id")).agg(F.max(F.struct("width", "way")).alias("x")).select("id", "x.way", "x.width"), "level")
        if level.isEmpty():
            return None, seen.select("id")
        found = level.where(F.col("id") == sink).first()
        seen = seen.unionByName(level)
        if found is not None:
            return found, seen.select("id")


def levels(arcs: DataFrame, starts: list[str]) -> DataFrame:
    """``id``, ``d``: hops along ``arcs(src, dst)`` from the nearest of the ``starts``."""
    seen = arcs.sparkSession.createDataFrame([(s, 0) for s in starts], "id string, d int")
    front, d = seen, 0
    while True:
        d += 1
        met = arcs.join(front.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        front = materialise(met.join(seen, "id", "left_anti").select("id", F.lit(d).alias("d")), "level")
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)


#: Runs of arcs into which the arcs of one node are cut, so that a hub's are summed by many tasks.
RUNS = 64


def dealt_out(arcs: DataFrame, have: str, room: str, key: str = "dst") -> DataFrame:
    """``src``, ``key``, ``sent``: what each node has, given to its arcs, told apart by ``key``, in turn as far as they have room."""
    cut = arcs.withColumn("run", F.pmod(F.xxhash64(key), F.lit(RUNS)))
    run = Window.partitionBy("src", "run").orderBy(key)
    before = cut.groupBy("src", "run").agg(F.sum(room).alias("all"))
    start = before.select("src", "run", F.coalesce(F.sum("all").over(Window.partitionBy("src").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("start"))
    upto = cut.withColumn("upto", F.sum(room).over(run) - F.col(room)).join(start, ["src", "run"])
    return upto.select("src", key, F.least(F.col(room), F.greatest(F.col(have) - F.col("start") - F.col("upto"), F.lit(0.0))).alias("sent")).where(F.col("sent") > NOTHING)


#: Rounds of pushes between two exact computations of heights.
AGAIN = 8


@tidy
def maximum_flow(graph: Graph, source: str, sink: str) -> tuple[DataFrame, DataFrame]:
    """``src, dst, flow`` of the arcs that carry flow, and ``id`` of the smallest source side of a minimum cut.

    The source fills its arcs.  In every round all nodes that hold more than
    they sent push it at once along arcs that lead one step down, and those
    that still hold something rise above their lowest neighbour; every few
    rounds heights become exact distances to the sink, or to the source where
    it is out of reach.  So many ways are filled together, and the rounds do not
    go with the number of ways.  Edges carry flow either way.
    """
    graph = graph.need(nodes=(source, sink)).written()
    if source == sink:
        raise Invalid("source and sink are one node")
    given = materialise(graph.arcs.where("src <> dst").select("src", "dst", F.col("w").alias("left")), "capacity")
    if not given.where("left < 0").isEmpty():
        raise Invalid("capacities must not be negative")
    spark, n = graph.spark, graph.nodes.count()
    both = given.unionByName(given.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0.0).alias("left"))).groupBy("src", "dst").agg(F.sum("left").alias("left"))
    full = F.when(F.col("src") == source, F.lit(0.0)).otherwise(F.col("left"))
    out = given.where(F.col("src") == source).select(F.col("dst").alias("src"), F.lit(source).alias("dst"), F.col("left").alias("more"))
    residual = materialise(both.join(out, ["src", "dst"], "left").select("src", "dst", (full + F.coalesce("more", F.lit(0.0))).alias("left")), "residual")
    filled = out.select(F.col("src").alias("id"), F.col("more").alias("x"))
    held = materialise(graph.nodes.join(filled, "id", "left").select("id", F.coalesce("x", F.lit(0.0)).alias("x")), "held")

    def exact(residual: DataFrame, held: DataFrame) -> DataFrame:
        back = materialise(residual.where(F.col("left") > NOTHING).select(F.col("dst").alias("src"), F.col("src").alias("dst")), "back")
        low, high = levels(back.where(F.col("src") != source), [sink]), levels(back.where(F.col("src") != sink), [source])
        height = F.when(F.col("id") == source, F.lit(n)).otherwise(F.coalesce("d", F.col("e") + n, F.lit(2 * n)))
        return materialise(held.select("id", "x").join(low, "id", "left").join(high.withColumnRenamed("d", "e"), "id", "left").select("id", "x", height.cast("int").alias("h")), "heights")

    turn = 0
    while True:
        inner = ~F.col("id").isin(source, sink) & (F.col("x") > NOTHING)
        if held.where(inner).isEmpty():
            break
        if turn % AGAIN == 0:
            held = exact(residual, held)
        turn += 1
        down = residual.where(F.col("left") > NOTHING).join(held.where(inner).select(F.col("id").alias("src"), "x", "h"), "src").join(held.select(F.col("id").alias("dst"), F.col("h").alias("hd")), "dst").where("h = hd + 1")
        push = materialise(dealt_out(down.select("src", "dst", "x", "left"), "x", "left"), "pushes")
        turned = push.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("sent").alias("got"))
        zero = F.lit(0.0)
        after = materialise(residual.join(push, ["src", "dst"], "left").join(turned, ["src", "dst"], "left").select("src", "dst", (F.col("left") - F.coalesce("sent", zero) + F.coalesce("got", zero)).alias("left")), "residual")
        change = push.select(F.col("src").alias("id"), (-F.col("sent")).alias("y")).union(push.select("dst", "sent")).groupBy("id").agg(F.sum("y").alias("y"))
        now = held.join(change, "id", "left").select("id", "h", (F.col("x") + F.coalesce("y", zero)).alias("x"))
        lowest = after.where(F.col("left") > NOTHING).join(held.select(F.col("id").alias("dst"), F.col("h").alias("hd")), "dst").groupBy(F.col("src").alias("id")).agg(F.min("hd").alias("low"))
        rise = F.when(inner, F.greatest("h", F.coalesce(F.col("low") + 1, F.col("h")))).otherwise(F.col("h"))
        new = materialise(now.join(lowest, "id", "left").select("id", "x", rise.alias("h")), "heights")
        for table in (residual, held, push):
            discard(spark, table)
        residual, held = after, new
    sent = given.join(residual.withColumnRenamed("left", "now"), ["src", "dst"]).select("src", "dst", F.round(F.col("left") - F.col("now"), 9).alias("flow")).where(F.col("flow") > NOTHING)
    side = levels(materialise(residual.where(F.col("left") > NOTHING).select("src", "dst"), "open"), [source])
    return materialise(sent, "sent"), materialise(side.select("id"), "side")


@tidy
def minimum_cut(graph: Graph, source: str, sink: str) -> DataFrame:
    """``src``, ``dst``, ``w``: arcs from the smallest source side of a minimum cut to the rest; their weights add up to the greatest flow."""
    side = materialise(maximum_flow(graph, source, sink)[1], "side")
    out = graph.arcs.where("src <> dst").join(side.withColumnRenamed("id", "src"), "src", "left_semi")
    return out.join(side.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst", "w")


@tidy
def matching(edges: DataFrame) -> DataFrame:
    """``l``, ``r``: a greatest matching of the bipartite graph ``edges(l, r)``.

    In every phase a forest grows from the free left nodes along shortest
    alternating ways, each right node in one tree; every tree that reaches a
    free right node gives a way, and all ways are switched at once.
    """
    spark = edges.sparkSession
    edges = materialise(edges.select(F.col("l").cast("string").alias("l"), F.col("r").cast("string").alias("r")).distinct(), "edges")
    now = spark.createDataFrame([], "l string, r string")
    while True:
        level = edges.select("l").distinct().join(now, "l", "left_anti").select("l", F.col("l").alias("root"))
        seen = spark.createDataFrame([], "r string, l string, root string")
        ends = None
        while ends is None:
            step = edges.join(level, "l").join(seen.select("r"), "r", "left_anti")
            new = materialise(step.groupBy("r").agg(F.min(F.struct("root", "l")).alias("x")).select("r", "x.l", "x.root"), "forest")
            if new.isEmpty():
                return now
            seen = seen.unionByName(new)
            free = new.join(now.select("r"), "r", "left_anti")
            if not free.isEmpty():
                ends = free.groupBy("root").agg(F.min("r").alias("r"))
            level = new.select("r", "root").join(now, "r").select("l", "root")
        parent = seen.select("r", "l")
        at, taken = ends.select("r"), None
        while True:
            back = materialise(at.join(parent, "r").select("l", "r"), "way")
            taken = back if taken is None else taken.unionByName(back)
            at = back.select("l").join(now, "l").select("r")
            if at.isEmpty():
                break
        now = materialise(now.join(taken.select("l"), "l", "left_anti").unionByName(taken), "matching")


@tidy
def path_cover(graph: Graph, chains: bool = False) -> DataFrame:
    """``src``, ``dst``: the arcs of a cover of an acyclic graph's nodes by fewest paths without a common node.

    With ``chains`` the paths run over the closure, so their number is the width of the order.
    """
    from sparkweave.operators.paths import closure

    graph.need(directed=True)
    arcs = closure(graph) if chains else graph.arcs
    return matching(arcs.select(F.col("src").alias("l"), F.col("dst").alias("r"))).toDF("src", "dst")


@tidy
def edge_cover(edges: DataFrame) -> DataFrame:
    """``l``, ``r``: fewest edges that touch every node of the bipartite graph: a greatest matching and one edge for each node left."""
    found = materialise(matching(edges), "matched")
    rows = edges.select(F.col("l").cast("string").alias("l"), F.col("r").cast("string").alias("r")).distinct()
    left = rows.join(found.select("l"), "l", "left_anti").groupBy("l").agg(F.min("r").alias("r")).select("l", "r")
    right = rows.join(found.select("r"), "r", "left_anti").groupBy("r").agg(F.min("l").alias("l")).select("l", "r")
    return found.unionByName(left).unionByName(right)
