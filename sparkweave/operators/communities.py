"""Communities by local moves and by edges taken away, and hop searches from both ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.model import Graph
from sparkweave.operators.cohesion import components, modularity
from sparkweave.operators.paths import shortest_path_counts
from sparkweave.session import materialise, tidy


def _quality(links: DataFrame, now: DataFrame, total: float) -> float:
    """Weighted modularity of labels (id, label, k) over ``links(a, b, w)`` in both directions."""
    inside = links.join(now.select(F.col("id").alias("a"), F.col("label").alias("la")), "a").join(now.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b").where("la = lb").agg(F.sum("w")).first()[0] or 0.0
    volume = now.groupBy("label").agg(F.sum("k").alias("v")).agg(F.sum(F.col("v") * F.col("v"))).first()[0] or 0.0
    return inside / total - volume / total**2


def _moves(links: DataFrame, total: float) -> DataFrame:
    """``id``, ``label`` after rounds in which nodes move to the neighbouring community of most gain.

    Rounds alternate between moves to smaller and to larger labels, so that
    neighbours do not swap places.  A round that lowers the modularity is undone
    and tried with half the nodes; both directions without a move end the rounds.
    """
    now = materialise(links.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k")).select("id", F.col("id").alias("label"), "k"), "moves")
    value = _quality(links, now, total)
    turn, idle, share = 0, 0, 1.0
    while idle < 2:
        volume = materialise(now.groupBy(F.col("label").alias("to")).agg(F.sum("k").alias("v")), "volume")
        tied = links.where("a <> b").join(now.select(F.col("id").alias("b"), F.col("label").alias("to")), "b").groupBy(F.col("a").alias("id"), "to").agg(F.sum("w").alias("inside"))
        options = materialise(now.join(tied, "id").join(volume, "to").select("id", "label", "to", "k", "inside", "v"), "options")
        own = options.where("to = label").select("id", F.col("inside").alias("held"))
        stay = now.join(volume.withColumnRenamed("to", "label"), "label").join(own, "id", "left").select("id", "k", (F.coalesce("held", F.lit(0.0)) - F.col("k") * (F.col("v") - F.col("k")) / total).alias("stay"))
        gain = F.col("inside") - F.col("k") * F.col("v") / total
        way = F.col("to") < F.col("label") if turn % 2 == 0 else F.col("to") > F.col("label")
        best = options.where(way).groupBy("id").agg(F.max(gain).alias("gain"), F.min_by("to", F.struct((-gain).alias("g"), "to")).alias("new"))
        better = best.join(stay, "id").where(F.col("gain") > F.col("stay") + 1e-12 * F.col("k"))
        if share < 1:
            better = better.where(F.pmod(F.xxhash64("id", F.lit(turn), F.lit(share)), F.lit(1 << 20)) < int(share * (1 << 20)))
        new = materialise(now.join(better.select("id", "new"), "id", "left").select("id", F.coalesce("new", "label").alias("label"), "k", F.col("new").isNotNull().alias("moved")), "moves")
        if new.where("moved").isEmpty():
            turn, idle, share = turn + 1, idle + 1, 1.0
            continue
        got = _quality(links, new, total)
        if got < value - 1e-12:
            share /= 2
            if share < 0.05:
                turn, idle, share = turn + 1, idle + 1, 1.0
            continue
        now, value = new.select("id", "label", "k"), got
        turn, idle, share = turn + 1, 0, 1.0
    return now.select("id", "label")


@tidy
def louvain(graph: Graph) -> DataFrame:
    """``id``, ``community`` (its smallest node): weighted local moves, then the same among communities, until none moves.

    Nodes without an edge are communities of their own; weights must not be
    negative.  A community is a row of links and volumes, never a gathered list.
    """
    graph = graph.written()
    graph.need(directed=False)
    edges = graph.edges
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "w").union(edges.select("dst", "src", "w"))
    links = materialise(both.groupBy("a", "b").agg(F.sum("w").alias("w")), "links")
    total = links.agg(F.sum("w")).first()[0] or 0.0
    placed = materialise(graph.nodes.select("id", F.col("id").alias("label")), "labels")
    while total:
        labels = materialise(_moves(links, total), "labels")
        if labels.where("id <> label").isEmpty():
            break
        placed = materialise(placed.join(labels.toDF("label", "new"), "label", "left").select("id", F.coalesce("new", "label").alias("label")), "labels")
        merged = links.join(labels.toDF("a", "la"), "a").join(labels.toDF("b", "lb"), "b")
        links = materialise(merged.groupBy(F.col("la").alias("a"), F.col("lb").alias("b")).agg(F.sum("w").alias("w")), "links")
    name = placed.groupBy("label").agg(F.min("id").alias("community"))
    return placed.join(name, "label").select("id", "community")


@tidy
def edge_betweenness(graph: Graph) -> DataFrame:
    """``src``, ``dst``, ``betweenness``: shares of the shortest hop routes of all pairs that run over each edge; undirected pairs count once."""
    graph = graph.written()
    counted = materialise(shortest_path_counts(graph), "counted")
    arcs = graph.arcs.where("src <> dst").select("src", "dst")
    depth = int(counted.agg(F.max("dist")).first()[0] or 0)
    level = counted.where(F.col("dist") == depth).select("origin", "id", "sigma", F.lit(0.0).alias("delta"))
    done = graph.spark.createDataFrame([], "src string, dst string, share double")
    for d in range(depth - 1, -1, -1):
        below = level.select("origin", F.col("id").alias("dst"), F.col("sigma").alias("cs"), "delta")
        here = counted.where(F.col("dist") == d).select("origin", F.col("id").alias("src"), "sigma")
        share = materialise(here.join(arcs, "src").join(below, ["origin", "dst"]).select("origin", "src", "dst", (F.col("sigma") / F.col("cs") * (1 + F.col("delta"))).alias("share")), "shares")
        done = done.unionByName(share.groupBy("src", "dst").agg(F.sum("share").alias("share")))
        sent = share.groupBy("origin", "src").agg(F.sum("share").alias("delta"))
        level = here.join(sent, ["origin", "src"], "left").select("origin", F.col("src").alias("id"), "sigma", F.coalesce("delta", F.lit(0.0)).alias("delta"))
    ends = [F.col("src"), F.col("dst")] if graph.directed else [F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")]
    half = 1.0 if graph.directed else 0.5
    total = done.select(*ends, "share").groupBy("src", "dst").agg(F.sum("share").alias("s"))
    return graph.edges.select("src", "dst").join(total, ["src", "dst"], "left").select("src", "dst", F.round(F.coalesce(F.col("s") * half, F.lit(0.0)), 6).alias("betweenness"))


@tidy
def girvan_newman(graph: Graph, removals: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``step, src, dst, betweenness, modularity`` of the edges taken away, and ``id, community`` of the best partition met.

    Each step takes the edge of most shortest routes, ties to the greatest pair;
    modularity is that of the components in the whole graph.  Loops stay.
    """
    graph = graph.written()
    graph.need(directed=False)
    now = Graph(graph.nodes, materialise(graph.edges.where("src <> dst"), "edges"), False)
    steps, best = [], None
    while removals is None or len(steps) < removals:
        top = edge_betweenness(now).orderBy(F.desc("betweenness"), F.desc("src"), F.desc("dst")).first()
        if top is None:
            break
        now = Graph(graph.nodes, materialise(now.edges.where((F.col("src") != top["src"]) | (F.col("dst") != top["dst"])), "edges"), False)
        labels = materialise(components(now).withColumnRenamed("component", "label"), "labels")
        value = modularity(graph, labels)
        steps.append((len(steps) + 1, top["src"], top["dst"], top["betweenness"], round(value, 6)))
        if best is None or value > best[0] + 1e-12:
            best = (value, labels)
    found = best[1] if best is not None else components(graph).withColumnRenamed("component", "label")
    return graph.spark.createDataFrame(steps, "step int, src string, dst string, betweenness double, modularity double"), found.select("id", F.col("label").alias("community"))


@tidy
def two_sided(graph: Graph, source: str, target: str) -> DataFrame:
    """``hops``, ``meeting``, ``expanded``: the smaller of two frontiers grows until they meet; no row if they never do.

    Levels are grown whole, so the first meeting is on a shortest route; ties go to the smallest node.
    """
    graph = graph.written()
    graph.need(nodes=(source, target))
    spark = graph.spark
    ways = [graph.arcs.select("src", "dst"), graph.arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))]
    seen = [spark.createDataFrame([(n, 0)], "id string, d int") for n in (source, target)]
    front, size, depth, expanded = list(seen), [1, 1], [0, 0], 0
    while True:
        met = seen[0].join(seen[1].withColumnRenamed("d", "e"), "id").agg(F.min(F.struct((F.col("d") + F.col("e")).alias("hops"), "id")).alias("m")).first()["m"]
        if met is not None:
            return spark.createDataFrame([(met["hops"], met["id"], expanded)], "hops int, meeting string, expanded int")
        at = 0 if size[0] <= size[1] else 1
        if not size[at]:
            return spark.createDataFrame([], "hops int, meeting string, expanded int")
        expanded += size[at]
        depth[at] += 1
        step = ways[at].join(front[at].select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        front[at] = materialise(step.join(seen[at], "id", "left_anti").select("id", F.lit(depth[at]).alias("d")), "front")
        size[at] = front[at].count()
        seen[at] = seen[at].unionByName(front[at])
