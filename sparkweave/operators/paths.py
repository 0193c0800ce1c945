"""Traversal and distances: one relaxation loop serves them all.

Every round joins only the rows that changed with the arcs, keeps the better
value of each (origin, node), and writes what it keeps, so lineage does not
grow and a lost executor costs one round.  Distances of unreachable nodes are
missing rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkweave.errors import Cyclic, Invalid, Negative
from sparkweave.model import Graph
from sparkweave.operators import packed
from sparkweave.operators.orders import numbered
from sparkweave.session import discard, materialise, tidy


@tidy
def relax(graph: Graph, seeds: DataFrame, weight: str = "w", kind: str = "min", rounds: int | None = None) -> DataFrame:
    """``origin``, ``id``, ``dist``, ``via``: the best value from every seed row (origin, id, dist).

    ``kind``: ``min`` adds weights and keeps the least, ``max`` adds and keeps
    the greatest (the graph must be acyclic), ``wide`` takes the least weight of
    a route and keeps the greatest.  More rounds than nodes mean a cycle that
    improves for ever, which is refused.  ``rounds`` stops after so many hops.
    """
    graph = graph.written()
    spark = graph.spark
    arcs = graph.arcs.select("src", "dst", F.expr(weight).alias("w"))
    best = materialise(seeds.select("origin", "id", F.col("dist").cast("double").alias("dist"), F.lit(None).cast("string").alias("via")), "best")
    front = best
    limit = rounds if rounds is not None else graph.nodes.count() + 1
    value = F.least("dist", "w") if kind == "wide" else F.col("dist") + F.col("w")
    pick = F.min if kind == "min" else F.max
    turn = 0
    while turn < limit:
        turn += 1
        reached = front.join(arcs, F.col("id") == F.col("src")).select("origin", F.col("dst").alias("id"), value.alias("new"), F.col("src").alias("from"))
        # Ties go to the smallest predecessor.
        order = F.struct("new", "from") if kind == "min" else F.struct((-F.col("new")).alias("v"), "from")
        top = reached.groupBy("origin", "id").agg(pick("new").alias("new"), F.min_by("from", order).alias("from"))
        held = best.select("origin", "id", F.col("dist").alias("old"))
        better = "old is null or new < old" if kind == "min" else "old is null or new > old"
        front = materialise(top.join(held, ["origin", "id"], "left").where(better).select("origin", "id", F.col("new").alias("dist"), F.col("from").alias("via")), "front")
        if front.isEmpty():
            break
        kept = best.join(front.select("origin", "id"), ["origin", "id"], "left_anti").unionByName(front)
        new = materialise(kept, "best")
        discard(spark, best)
        best = new
    else:
        if rounds is None:
            raise (Negative if kind == "min" else Cyclic)("a cycle improves for ever")
    return best


def _from(graph: Graph, source: str, start: float = 0.0) -> DataFrame:
    graph.need(nodes=(source,))
    return graph.spark.createDataFrame([(source, source, start)], "origin string, id string, dist double")


def _all(graph: Graph) -> DataFrame:
    return graph.nodes.select(F.col("id").alias("origin"), "id", F.lit(0.0).alias("dist"))


@tidy
def bfs(graph: Graph, source: str, rounds: int | None = None) -> DataFrame:
    """Hops and parent (the smallest neighbour one hop nearer) of all nodes reached."""
    graph = graph.written()
    found = relax(graph, _from(graph, source), "1D", rounds=rounds)
    return found.select("id", F.col("dist").cast("bigint").alias("hops"), F.col("via").alias("parent"))


@tidy
def distances(graph: Graph, source: str, allow_negative: bool = False) -> DataFrame:
    """Weighted distances from one node; a negative weight is refused unless allowed, a negative cycle always."""
    graph = graph.written()
    if not allow_negative and not graph.edges.where("w < 0").isEmpty():
        raise Negative("an edge has a negative weight")
    return relax(graph, _from(graph, source)).select("id", "dist", F.col("via").alias("parent"))


def zero_one(graph: Graph, source: str) -> DataFrame:
    """Distances where every weight is 0 or 1; others are refused."""
    if not graph.edges.where("w not in (0, 1)").isEmpty():
        raise Invalid("every weight must be 0 or 1")
    return distances(graph, source)


@tidy
def widest(graph: Graph, source: str) -> DataFrame:
    """The greatest bottleneck width of a route to each node; infinite at the source."""
    graph = graph.written()
    return relax(graph, _from(graph, source, float("inf")), kind="wide").select("id", F.col("dist").alias("width"), F.col("via").alias("parent"))


@tidy
def all_pairs(graph: Graph, weighted: bool = False) -> DataFrame:
    """``src``, ``dst``, ``dist`` of every ordered pair that a route joins, itself included."""
    graph = graph.written()
    return relax(graph, _all(graph), "w" if weighted else "1D").select(F.col("origin").alias("src"), F.col("id").alias("dst"), "dist")


def route(found: DataFrame, source: str, target: str) -> list[str]:
    """The nodes of the route that parents lead back along; empty if there is none. A route is short: it is walked on the driver."""
    parents, path = {}, [target]
    frontier = target
    while frontier != source:
        if frontier not in parents:
            row = found.where(F.col("id") == frontier).select("parent").first()
            if row is None or row[0] is None:
                return []
            parents[frontier] = row[0]
        frontier = parents[frontier]
        path.append(frontier)
    return path[::-1]


@tidy
def dag_paths(graph: Graph, source: str) -> DataFrame:
    """Shortest and longest distances from one node of an acyclic digraph."""
    graph = graph.written()
    topological_layers(graph)
    least = distances(graph, source, allow_negative=True).select("id", F.col("dist").alias("shortest"))
    most = relax(graph, _from(graph, source), kind="max").select("id", F.col("dist").alias("longest"))
    return least.join(most, "id")


@tidy
def topological_layers(graph: Graph) -> DataFrame:
    """``id``, ``layer``: the longest chain before each node; a cycle is refused."""
    graph = graph.written()
    graph.need(directed=True)
    starts = graph.nodes.join(graph.edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
    if starts.isEmpty() and not graph.nodes.isEmpty():
        raise Cyclic("every node has a predecessor")
    found = relax(graph, starts.select(F.lit("all").alias("origin"), "id", F.lit(0.0).alias("dist")), "1D", kind="max")
    if found.count() < graph.nodes.count():
        raise Cyclic("some nodes lie on a cycle that no start reaches")
    return found.select("id", F.col("dist").cast("bigint").alias("layer"))


@tidy
def topological_order(graph: Graph) -> DataFrame:
    """A valid order: by layer, then by name."""
    graph = graph.written()
    return topological_layers(graph).withColumn("position", F.row_number().over(Window.orderBy("layer", "id")) - 1)


@tidy
def closure(graph: Graph) -> DataFrame:
    """``src``, ``dst``: all pairs joined by a route of at least one arc."""
    graph = graph.written()
    arcs = graph.arcs
    first = arcs.select(F.col("src").alias("origin"), F.col("dst").alias("id"), F.lit(1.0).alias("dist")).distinct()
    return relax(graph, first, "1D").select(F.col("origin").alias("src"), F.col("id").alias("dst")).distinct()


@tidy
def reduction(graph: Graph) -> DataFrame:
    """The arcs of an acyclic digraph that no longer route replaces."""
    graph = graph.written()
    topological_layers(graph)
    reach = closure(graph)
    longer = graph.edges.select("src", F.col("dst").alias("mid")).join(reach.toDF("mid", "dst"), "mid").select("src", "dst").distinct()
    return graph.edges.join(longer, ["src", "dst"], "left_anti")


@tidy
def eccentricities(graph: Graph, weighted: bool = False) -> DataFrame:
    """``id``, ``eccentricity``, ``center``, ``periphery``; a node that does not reach all others has none."""
    graph = graph.written()
    pairs = all_pairs(graph, weighted)
    n = graph.nodes.count()
    ecc = pairs.groupBy(F.col("src").alias("id")).agg(F.max("dist").alias("e"), F.count("*").alias("n")).select("id", F.when(F.col("n") == n, F.col("e")).alias("eccentricity"))
    ends = ecc.agg(F.min("eccentricity").alias("low"), F.max("eccentricity").alias("high"))
    return ecc.crossJoin(F.broadcast(ends)).select("id", "eccentricity", F.coalesce(F.col("eccentricity") == F.col("low"), F.lit(False)).alias("center"), F.coalesce(F.col("eccentricity") == F.col("high"), F.lit(False)).alias("periphery"))


def _hop_sums(graph: Graph) -> DataFrame:
    """``id``, ``r``, ``total``, ``inverse``: how many others each node reaches, and the sums of their hops and of one by their hops.

    No pair is written or shuffled (``packed.hop_sums``).
    """
    names = materialise(numbered(graph.nodes, "id", name="k").select("id", (F.col("k") - 1).alias("k")), "numbers")
    arcs = graph.arcs.where("src <> dst").join(names.toDF("src", "a"), "src").join(names.toDF("dst", "b"), "dst").select("a", "b")
    sums = materialise(packed.hop_sums(materialise(arcs, "arcs"), names.count()), "sums")
    return names.join(sums, "k").select("id", "r", "total", "inverse")


@tidy
def distance_centrality(graph: Graph, weighted: bool = False) -> DataFrame:
    """Closeness scaled by the share reached, and harmonic centrality, along out-arcs."""
    graph = graph.written()
    n = graph.nodes.count()
    if weighted:
        pairs = all_pairs(graph, weighted).where("src <> dst")
        s = pairs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("r"), F.sum("dist").alias("total"), F.sum(F.when(F.col("dist") > 0, 1.0 / F.col("dist"))).alias("inverse"))
    else:
        s = _hop_sums(graph)
    zero = F.lit(0.0)
    return graph.nodes.join(s, "id", "left").select("id", F.round(F.coalesce(F.when(F.col("total") > 0, F.col("r") / (n - 1) * F.col("r") / F.col("total")), zero), 6).alias("closeness"), F.round(F.coalesce(F.col("inverse") / (n - 1), zero), 6).alias("harmonic"))


@tidy
def wiener(graph: Graph, weighted: bool = False) -> DataFrame:
    """Sum, mean and Harary sum of the distances of all unordered pairs; null sum if a pair is not joined."""
    graph = graph.written()
    graph.need(directed=False)
    n = graph.nodes.count()
    pairs = n * (n - 1) // 2
    got = all_pairs(graph, weighted).where("src < dst").agg(F.count("*").alias("n"), F.sum("dist").alias("total"), F.sum(1.0 / F.col("dist")).alias("harary"))
    return got.select(F.when(F.col("n") == pairs, F.round("total", 6)).alias("wiener"), F.when(F.col("n") == pairs, F.round(F.col("total") / F.lit(max(pairs, 1)), 6)).alias("mean_distance"), F.round(F.coalesce("harary", F.lit(0.0)), 6).alias("harary"))


@tidy
def shortest_path_counts(graph: Graph, pairs: DataFrame | None = None) -> DataFrame:
    """``origin``, ``id``, ``dist``, ``sigma``: hops and how many shortest routes there are, level by level."""
    graph = graph.written()
    hops = materialise(pairs if pairs is not None else relax(graph, _all(graph), "1D").select("origin", "id", "dist"), "hops")
    arcs = graph.arcs.select("src", "dst")
    depth = int(hops.agg(F.max("dist")).first()[0] or 0)
    level = hops.where("dist = 0").withColumn("sigma", F.lit(1.0))
    done = level
    for d in range(1, depth + 1):
        step = level.select("origin", F.col("id").alias("src"), "sigma").join(arcs, "src").groupBy("origin", F.col("dst").alias("id")).agg(F.sum("sigma").alias("sigma"))
        level = materialise(hops.where(F.col("dist") == d).join(step, ["origin", "id"]), "level")
        done = done.unionByName(level)
    return done


@tidy
def betweenness(graph: Graph, normalised: bool = False) -> DataFrame:
    """Shares of shortest routes through each node (``betweenness``), and their number (``stress``).

    Forward counts and backward shares go level by level for all origins at
    once; undirected pairs count once.
    """
    graph = graph.written()
    graph.need(least=3)
    counted = materialise(shortest_path_counts(graph), "counted")
    arcs = graph.arcs.select("src", "dst")
    depth = int(counted.agg(F.max("dist")).first()[0] or 0)
    zero = counted.where(F.col("dist") == depth).select("origin", "id", "dist", "sigma", F.lit(0.0).alias("delta"), F.lit(0.0).alias("below"))
    level, done = zero, zero
    for d in range(depth - 1, -1, -1):
        child = level.select("origin", F.col("id").alias("dst"), F.col("sigma").alias("cs"), F.col("delta").alias("cd"), F.col("below").alias("cb"))
        here = counted.where(F.col("dist") == d)
        share = here.join(arcs, F.col("id") == F.col("src")).join(child, ["origin", "dst"]).groupBy("origin", "id").agg(F.sum(F.col("sigma") / F.col("cs") * (1 + F.col("cd"))).alias("delta"), F.sum(1 + F.col("cb")).alias("below"))
        level = materialise(here.join(share, ["origin", "id"], "left").select("origin", "id", "dist", "sigma", F.coalesce("delta", F.lit(0.0)).alias("delta"), F.coalesce("below", F.lit(0.0)).alias("below")), "level")
        done = done.unionByName(level)
    total = done.where("origin <> id").groupBy("id").agg(F.sum("delta").alias("b"), F.sum(F.col("sigma") * F.col("below")).alias("s"))
    n = graph.nodes.count()
    half = 1.0 if graph.directed else 0.5
    scale = half * (1.0 / ((n - 1) * (n - 2)) / half if normalised else 1.0)
    zero_ = F.lit(0.0)
    return graph.nodes.join(total, "id", "left").select("id", F.round(F.coalesce(F.col("b") * scale, zero_), 6).alias("betweenness"), F.round(F.coalesce(F.col("s") * half, zero_), 6).alias("stress"))


@tidy
def girth(graph: Graph) -> DataFrame:
    """Length of the shortest cycle of an undirected graph; null if there is none."""
    graph = graph.written()
    graph.need(directed=False)
    hops = materialise(relax(graph, _all(graph), "1D"), "hops")
    x = hops.select("origin", F.col("id").alias("src"), F.col("dist").alias("dx"), F.col("via").alias("px"))
    y = hops.select("origin", F.col("id").alias("dst"), F.col("dist").alias("dy"), F.col("via").alias("py"))
    cross = graph.edges.join(x, "src").join(y, ["origin", "dst"]).where("src <> dst and not (px <=> dst) and not (py <=> src)")
    return cross.agg(F.min(F.col("dx") + F.col("dy") + 1).cast("bigint").alias("girth"))


@tidy
def arbitrage(rates: DataFrame) -> DataFrame:
    """Whether going round some exchange cycle of ``rates(src, dst, rate)`` gains: a negative cycle of -ln(rate)."""
    if not rates.where("rate <= 0 or rate is null").isEmpty():
        raise Invalid("every rate must be positive")
    graph = Graph.of(rates.select("src", "dst", (-F.log("rate")).alias("w")), True)
    # Rates that differ by rounding are no gain.
    graph = Graph(graph.nodes, graph.edges.withColumn("w", F.col("w") + 1e-12), True)
    try:
        relax(graph, graph.nodes.select(F.lit("all").alias("origin"), "id", F.lit(0.0).alias("dist")))
        gain = False
    except Negative:
        gain = True
    return rates.sparkSession.createDataFrame([(gain,)], "arbitrage boolean")


@tidy
def k_center(graph: Graph, k: int) -> DataFrame:
    """Farthest-first centres: the node of least eccentricity, then always the node farthest from those chosen."""
    graph = graph.written()
    graph.need(directed=False)
    pairs = materialise(all_pairs(graph), "pairs")
    if pairs.count() < graph.nodes.count() ** 2:
        raise Invalid("the graph is not connected")
    first = pairs.groupBy("src").agg(F.max("dist").alias("e")).orderBy("e", "src").first()["src"]
    chosen = [first]
    while len(chosen) < k:
        near = pairs.where(F.col("src").isin(chosen)).groupBy("dst").agg(F.min("dist").alias("d"))
        far = near.orderBy(F.desc("d"), "dst").first()
        if far is None or far["d"] == 0:
            break
        chosen.append(far["dst"])
    return pairs.where(F.col("src").isin(chosen)).groupBy(F.col("dst").alias("id")).agg(F.min_by("src", F.struct("dist", "src")).alias("center"), F.min("dist").alias("dist"))


@tidy
def vitality(graph: Graph) -> DataFrame:
    """Closeness vitality: what the sum of all distances loses without each node; null if its loss cuts the graph.

    Every node gives a scenario, all relaxed together with the scenario in the origin's name.
    """
    graph = graph.written()
    graph.need(directed=False)
    n = graph.nodes.count()
    whole = all_pairs(graph).agg(F.sum("dist")).first()[0] or 0.0
    gone = graph.nodes.select(F.col("id").alias("gone"))
    sep = "\x00"
    arcs = graph.arcs.crossJoin(gone).where("src <> gone and dst <> gone")
    tag = F.concat(F.col("gone"), F.lit(sep))
    scenario = Graph(gone.crossJoin(graph.nodes).where("id <> gone").select(F.concat(tag, F.col("id")).alias("id")), arcs.select(F.concat(tag, "src").alias("src"), F.concat(tag, "dst").alias("dst"), "w"), True)
    pairs = all_pairs(scenario).select(F.split("src", sep)[0].alias("id"), "dist")
    left = pairs.groupBy("id").agg(F.sum("dist").alias("total"), F.count("*").alias("n"))
    return graph.nodes.join(left, "id", "left").select("id", F.when(F.col("n") == (n - 1) ** 2, F.round((F.lit(whole) - F.col("total")) / 2, 6)).alias("vitality"))


@tidy
def yen(graph: Graph, source: str, target: str, k: int, most: int = 1_000_000) -> DataFrame:
    """The k cheapest loopless routes, ordered by cost and nodes: routes grow by joins.

    Without negative weights an unfinished route goes once k finished ones cost
    less.  More than ``most`` unfinished routes are refused.
    """
    graph = graph.written()
    graph.need(nodes=(source, target))
    arcs = graph.arcs.select("src", "dst", "w")
    bounded = arcs.where("w < 0").isEmpty()
    grown = graph.spark.createDataFrame([(source, [source], 0.0)], "at string, path array<string>, cost double")
    done = None
    while True:
        grown = materialise(grown.join(arcs, F.col("at") == F.col("src")).where("not array_contains(path, dst)").select(F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path"), (F.col("cost") + F.col("w")).alias("cost")), "routes")
        hit = grown.where(F.col("at") == target)
        done = hit if done is None else done.unionByName(hit)
        grown = grown.where(F.col("at") != target)
        best = done.orderBy("cost").select("cost").take(k) if bounded else []
        if bounded and len(best) == k:
            # Equal costs are ordered by nodes, so equal routes stay.
            grown = grown.where(F.col("cost") <= (best[-1]["cost"] if k else float("-inf")))
        left = grown.count()
        if not left:
            break
        if left > most:
            raise Invalid(f"more than {most} unfinished routes")
    ranked = done.withColumn("rank", F.row_number().over(Window.orderBy("cost", "path")))
    return ranked.where(F.col("rank") <= k).select("rank", "path", F.round("cost", 6).alias("cost"))
