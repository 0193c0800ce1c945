"""Routes towards a goal and what they hang on; networks with floors, routes of a flow, and nodes that part two others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.errors import Invalid, Negative
from sparkweave.model import Graph
from sparkweave.operators import blocks
from sparkweave.operators.cohesion import components
from sparkweave.operators.flows import NOTHING, maximum_flow, minimum_cut, widest_way
from sparkweave.operators.paths import distances, relax, route
from sparkweave.session import materialise, tidy

_LABELS = "id string, dist double, parent string"


def _better(front: DataFrame, arcs: DataFrame, held: DataFrame) -> DataFrame:
    """Labels that arcs from ``front`` improve, ties to the smallest predecessor."""
    step = front.join(arcs, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), (F.col("dist") + F.col("w")).alias("dist"), F.col("src").alias("parent"))
    top = step.groupBy("id").agg(F.min(F.struct("dist", "parent")).alias("x")).select("id", "x.dist", "x.parent")
    return top.join(held.select("id", F.col("dist").alias("old")), "id", "left").where("old is null or dist < old").drop("old")


def _merged(held: DataFrame, new: DataFrame) -> DataFrame:
    return materialise(held.join(new.select("id"), "id", "left_anti").unionByName(new), "labels")


def _steps(spark, names: list[str], total: DataFrame) -> DataFrame:
    """``step``, ``id``, ``dist`` along a route."""
    rows = spark.createDataFrame(list(enumerate(names)), "step int, id string")
    return rows.join(total.select("id", "dist"), "id").select("step", "id", "dist")


@tidy
def towards(graph: Graph, source: str, target: str, heuristic: DataFrame | None = None) -> DataFrame:
    """``step``, ``id``, ``dist``: a cheapest route, no rows if there is none.

    ``heuristic(id, h)`` must never exceed what is left to the target; missing
    rows count as 0.  A label whose cost and heuristic reach the best route
    known is not followed, so a good heuristic spares most of the graph.
    """
    graph = graph.written()
    graph.need(nodes=(source, target))
    if not graph.edges.where("w < 0").isEmpty():
        raise Negative("an edge has a negative weight")
    spark = graph.spark
    arcs = materialise(graph.arcs.where("src <> dst").select("src", "dst", "w"), "arcs")
    guess = heuristic if heuristic is not None else spark.createDataFrame([], "id string, h double")
    guess = materialise(guess.select("id", "h"), "heuristic")
    held = front = spark.createDataFrame([(source, 0.0, None)], _LABELS)
    best = 0.0 if source == target else float("inf")
    while True:
        hopeful = _better(front, arcs, held).join(guess, "id", "left").where(F.col("dist") + F.coalesce("h", F.lit(0.0)) < best).select("id", "dist", "parent")
        front = materialise(hopeful, "front")
        if front.isEmpty():
            return _steps(spark, route(held, source, target), held)
        held = _merged(held, front)
        met = front.where(F.col("id") == target).first()
        best = met["dist"] if met else best
        front = front.where(F.col("id") != target)


@tidy
def from_both_ends(graph: Graph, source: str, target: str) -> DataFrame:
    """``step``, ``id``, ``dist``: a cheapest route found from both ends, no rows if there is none.

    Some arc of a cheapest route leads from the half near the source to the
    half near the target, so labels beyond half of the best meeting known are
    kept but not followed.
    """
    graph = graph.written()
    graph.need(nodes=(source, target))
    if not graph.edges.where("w < 0").isEmpty():
        raise Negative("an edge has a negative weight")
    spark = graph.spark
    ahead = materialise(graph.arcs.where("src <> dst").select("src", "dst", "w"), "arcs")
    back = ahead.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    held = [spark.createDataFrame([(n, 0.0, None)], _LABELS) for n in (source, target)]
    front, best, at = list(held), float("inf"), None
    while True:
        for side, arcs in enumerate((ahead, back)):
            front[side] = materialise(_better(front[side].where(F.col("dist") * 2 <= best), arcs, held[side]), "front")
            held[side] = _merged(held[side], front[side])
        met = held[0].join(held[1].select("id", F.col("dist").alias("rest")), "id").orderBy(F.col("dist") + F.col("rest"), "id").first()
        if met and met["dist"] + met["rest"] < best:
            best, at = met["dist"] + met["rest"], met["id"]
        if front[0].isEmpty() and front[1].isEmpty():
            break
    if at is None:
        return spark.createDataFrame([], "step int, id string, dist double")
    first, second = route(held[0], source, at), route(held[1], target, at)[::-1]
    total = held[0].select("id", "dist").where(F.col("id").isin(first)).union(held[1].where(F.col("id").isin(second[1:])).select("id", F.lit(best) - F.col("dist")))
    return _steps(spark, first + second[1:], total)


@tidy
def explain(graph: Graph, source: str, target: str) -> DataFrame:
    """``step`` (from 1), ``src``, ``dst``, ``w``, ``total``, ``slack`` of a cheapest route; no rows if there is none.

    ``slack`` is what a route without that edge costs more, infinite if none is
    left.  All such detours are relaxed in one loop over a copy of the graph
    for each edge of the route.
    """
    graph = graph.written()
    found = materialise(distances(graph, source), "distances")
    graph.need(nodes=(target,))
    names = route(found, source, target)
    spark = graph.spark
    pairs = spark.createDataFrame([(str(i + 1), a, b) for i, (a, b) in enumerate(zip(names, names[1:]))], "step string, a string, b string")
    closed = "(src = a and dst = b)" + ("" if graph.directed else " or (src = b and dst = a)")
    copies = graph.arcs.crossJoin(F.broadcast(pairs)).where(f"not ({closed})")
    name = lambda c: F.concat("step", F.lit(":"), F.col(c))
    many = Graph.of(copies.select(name("src").alias("src"), name("dst").alias("dst"), "w"), True)
    seeds = pairs.select(F.col("step").alias("origin"), F.concat("step", F.lit(":" + source)).alias("id"), F.lit(0.0).alias("dist"))
    detours = relax(many, seeds).where(F.col("id") == F.concat("origin", F.lit(":" + target))).select(F.col("origin").alias("step"), F.col("dist").alias("around"))
    ends = found.select(F.col("id").alias("b"), F.col("dist").alias("total")).join(pairs, "b").join(found.select(F.col("id").alias("a"), F.col("dist").alias("before")), "a")
    whole = found.where(F.col("id") == target).select(F.col("dist").alias("whole"))
    rows = ends.join(detours, "step", "left").crossJoin(F.broadcast(whole))
    slack = F.coalesce(F.col("around") - F.col("whole"), F.lit(float("inf")))
    return rows.select(F.col("step").cast("int").alias("step"), F.col("a").alias("src"), F.col("b").alias("dst"), (F.col("total") - F.col("before")).alias("w"), "total", slack.alias("slack"))


@tidy
def flow_routes(sent: DataFrame, source: str, sink: str) -> DataFrame:
    """``place`` (from 1), ``way``, ``flow``: routes from source to sink that add up to the flow ``sent(src, dst, flow)``, the widest of the shortest first.

    Flow that runs in circles is on no route.
    """
    spark = sent.sparkSession
    left, found = materialise(sent.select("src", "dst", F.col("flow").alias("left")), "flow"), []
    while True:
        way, _ = widest_way(left, source, sink)
        if way is None:
            return spark.createDataFrame(found, "place int, way array<string>, flow double")
        found.append((len(found) + 1, [source, *(e["dst"] for e in way["way"])], way["width"]))
        used = spark.createDataFrame([(e["src"], e["dst"], way["width"]) for e in way["way"]], "src string, dst string, used double")
        left = materialise(left.join(used, ["src", "dst"], "left").select("src", "dst", (F.col("left") - F.coalesce("used", F.lit(0.0))).alias("left")).where(F.col("left") > NOTHING), "flow")


@tidy
def circulation(arcs: DataFrame) -> DataFrame:
    """``src``, ``dst``, ``flow`` between ``floor`` and ``capacity`` of every row of ``arcs(src, dst, floor, capacity)``, what enters a node leaving it.

    A new source gives every node what floors bring to it and a new sink takes
    what they carry off; if not all of that flows, no circulation exists, which
    is refused.  So are pairs of opposite arcs and floors above capacities.
    """
    arcs = materialise(arcs.select(F.col("src").cast("string"), F.col("dst").cast("string"), F.col("floor").cast("double"), F.col("capacity").cast("double")), "arcs")
    opposite = arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    if not arcs.where("floor > capacity or floor < 0").isEmpty() or not arcs.join(opposite, ["src", "dst"], "left_semi").isEmpty():
        raise Invalid("floors must lie between 0 and capacity, and arcs must not be opposite")
    owed = arcs.select(F.col("dst").alias("id"), F.col("floor").alias("x")).union(arcs.select("src", -F.col("floor"))).groupBy("id").agg(F.sum("x").alias("x"))
    node = lambda c: F.concat(F.lit("n"), F.col(c))
    rows = arcs.select(node("src").alias("src"), node("dst").alias("dst"), (F.col("capacity") - F.col("floor")).alias("w"))
    give = owed.where("x > 0").select(F.lit("source").alias("src"), node("id").alias("dst"), F.col("x").alias("w"))
    take = owed.where("x < 0").select(node("id").alias("src"), F.lit("target").alias("dst"), (-F.col("x")).alias("w"))
    ends = arcs.sparkSession.createDataFrame([("source",), ("target",)], "id string")
    sent = materialise(maximum_flow(Graph.of(rows.union(give).union(take), True, ends), "source", "target")[0], "flow")
    asked = give.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    if sent.where("src = 'source'").agg(F.coalesce(F.sum("flow"), F.lit(0.0))).first()[0] < asked - 1e-6:
        raise Invalid("no circulation meets the floors")
    more = sent.where("src <> 'source' and dst <> 'target'").select(F.substring("src", 2, 1 << 30).alias("src"), F.substring("dst", 2, 1 << 30).alias("dst"), "flow")
    return arcs.join(more, ["src", "dst"], "left").select("src", "dst", (F.col("floor") + F.coalesce("flow", F.lit(0.0))).alias("flow"))


def _split(graph: Graph, a: str, b: str, link: float) -> Graph:
    """Every node as an arc of capacity 1 from its entry to its exit; ``a`` and ``b`` let all through."""
    n = float(graph.nodes.count())
    through = graph.nodes.select(F.concat("id", F.lit("<")).alias("src"), F.concat("id", F.lit(">")).alias("dst"), F.when(F.col("id").isin(a, b), n).otherwise(1.0).alias("w"))
    links = graph.arcs.where("src <> dst").select(F.concat("src", F.lit(">")).alias("src"), F.concat("dst", F.lit("<")).alias("dst"), F.lit(link or n).alias("w"))
    return Graph.of(through.union(links), True)


@tidy
def separator(graph: Graph, a: str, b: str) -> DataFrame:
    """``id``: fewest nodes without which no route leads from ``a`` to ``b``; neighbours are refused."""
    graph = graph.written()
    graph.need(nodes=(a, b))
    if a == b or not graph.arcs.where((F.col("src") == a) & (F.col("dst") == b)).isEmpty():
        raise Invalid("no set of nodes parts a node from itself or a neighbour")
    cut = minimum_cut(_split(graph, a, b, 0.0), a + ">", b + "<")
    return cut.select(F.expr("substring(src, 1, length(src) - 1)").alias("id"))


@tidy
def disjoint_routes(graph: Graph, a: str, b: str) -> DataFrame:
    """``edge_disjoint``, ``node_disjoint``: how many routes from ``a`` to ``b`` share no edge, and no node between."""
    graph = graph.written()
    graph.need(nodes=(a, b))
    unit = Graph(graph.nodes, graph.edges.withColumn("w", F.lit(1.0)), graph.directed)
    counts = []
    for g, s, t in ((unit, a, b), (_split(graph, a, b, 1.0), a + ">", b + "<")):
        sent = maximum_flow(g, s, t)[0]
        net = F.sum(F.when(F.col("src") == s, F.col("flow")).when(F.col("dst") == s, -F.col("flow")))
        counts.append(int(round(sent.agg(F.coalesce(net, F.lit(0.0))).first()[0])))
    return graph.spark.createDataFrame([tuple(counts)], "edge_disjoint int, node_disjoint int")


@tidy
def without_each(graph: Graph) -> DataFrame:
    """``id``, ``before``, ``after``: the pieces of the graph with and without each node.

    A node holds together as many pieces as it has blocks, so the blocks answer
    for all nodes at once.
    """
    graph = graph.written()
    graph.need(directed=False)
    named = components(graph).select("component").distinct().agg(F.count("*").alias("before"))
    edges = blocks.blocks(graph)
    held = edges.select("block", F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.countDistinct("block").alias("k"))
    return graph.nodes.join(held, "id", "left").crossJoin(F.broadcast(named)).select("id", "before", (F.col("before") - 1 + F.coalesce("k", F.lit(0))).alias("after"))
