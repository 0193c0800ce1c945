"""Components, cores, trees and colourings by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkweave.errors import Invalid
from sparkweave.model import Graph
from sparkweave.operators.orders import numbered
from sparkweave.operators.paths import relax
from sparkweave.plans.components import star_components
from sparkweave.session import discard, materialise, tidy


@tidy
def components(graph: Graph) -> DataFrame:
    """``id``, ``component``: undirected (for digraphs weak) components named by their smallest node."""
    graph = graph.written()
    found = star_components(graph.edges.select("src", "dst"), "src", "dst")
    return graph.nodes.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


@tidy
def strong_components(graph: Graph) -> DataFrame:
    """``id``, ``component``: strong components, each named by its smallest node.

    Nodes that no arc enters or leaves among those still open are components of
    their own.  For the rest every node learns the smallest name that reaches
    it and the smallest that it reaches; where the two agree on one name, the
    component of that name is complete.
    """
    graph = graph.written()
    graph.need(directed=True)
    arcs = materialise(graph.arcs.where("src <> dst").select("src", "dst"), "arcs")
    open_nodes, done = materialise(graph.nodes, "open"), None

    def settle(rows: DataFrame) -> None:
        nonlocal done
        done = rows if done is None else done.unionByName(rows)

    def spread(links: DataFrame, nodes: DataFrame) -> DataFrame:
        now = materialise(nodes.select("id", F.col("id").alias("low")), "low")
        while True:
            got = links.join(now.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("low").alias("new"))
            new = materialise(now.join(got, "id", "left").select("id", F.least("low", F.coalesce("new", "low")).alias("low"), (F.col("new") < F.col("low")).alias("moved")), "low")
            still = new.where("moved").isEmpty()
            now = new.select("id", "low")
            if still:
                return now

    while not open_nodes.isEmpty():
        inner = arcs.join(open_nodes.withColumnRenamed("id", "src"), "src", "left_semi").join(open_nodes.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")
        inner = materialise(inner, "arcs")
        both = inner.select(F.col("src").alias("id")).intersect(inner.select("dst"))
        trimmed = open_nodes.join(both, "id", "left_anti")
        if not trimmed.isEmpty():
            settle(materialise(trimmed.select("id", F.col("id").alias("component")), "strong"))
            open_nodes = materialise(open_nodes.join(both, "id", "left_semi"), "open")
            continue
        ahead = spread(inner, open_nodes)
        behind = spread(inner.select(F.col("dst").alias("src"), F.col("src").alias("dst")), open_nodes).withColumnRenamed("low", "back")
        met = materialise(ahead.join(behind, "id").where("low = back").select("id", F.col("low").alias("component")), "strong")
        settle(met)
        open_nodes = materialise(open_nodes.join(met, "id", "left_anti"), "open")
    return done if done is not None else graph.nodes.select("id", F.col("id").alias("component"))


@tidy
def condensation(graph: Graph) -> DataFrame:
    """Arcs between strong components with their numbers."""
    graph = graph.written()
    found = strong_components(graph)
    s, d = found.toDF("src", "from"), found.toDF("dst", "to")
    return graph.edges.join(s, "src").join(d, "dst").where("`from` <> `to`").groupBy(F.col("from").alias("src"), F.col("to").alias("dst")).agg(F.count("*").alias("n_arcs"))


@tidy
def two_colouring(graph: Graph) -> DataFrame:
    """``id``, ``component``, ``side`` (hops from the component's smallest node, odd or even), ``odd``: an odd cycle runs there."""
    graph = graph.written()
    graph.need(directed=False)
    comp = materialise(components(graph), "components")
    seeds = comp.where("id = component").select("id", F.col("id").alias("origin"), F.lit(0.0).alias("dist"))
    parity = relax(graph, seeds, "1D").select("id", (F.col("dist") % 2).cast("int").alias("side"))
    bad = graph.edges.join(parity.toDF("src", "a"), "src").join(parity.toDF("dst", "b"), "dst").where("a = b").select(F.col("src").alias("id")).join(comp, "id").select("component", F.lit(True).alias("odd")).distinct()
    return comp.join(parity, "id").join(bad, "component", "left").select("id", "component", "side", F.coalesce("odd", F.lit(False)).alias("odd"))


@tidy
def core_numbers(graph: Graph) -> DataFrame:
    """``id``, ``core``: each node's estimate falls to the h-index of its neighbours' estimates until nothing changes.

    Nodes are numbers within.  Neighbours count by their estimates, none above
    the node's own, so a hub has a row for each estimate and not for each
    neighbour.  A round looks only at nodes that a neighbour fell below, once
    few nodes fall.
    """
    graph = graph.written()
    graph.need(directed=False)
    named = materialise(numbered(graph.nodes, "id", name="k"), "names")
    edges = graph.edges.where("src <> dst").join(named.toDF("src", "s"), "src").join(named.toDF("dst", "d"), "dst").select("s", "d")
    edges = materialise(edges, "edges")
    arcs = edges.union(edges.select("d", "s"))
    degree = arcs.groupBy(F.col("s").alias("k")).agg(F.count("*").alias("core"))
    # Nodes without a neighbour are settled at 0.
    now = materialise(degree.withColumn("old", F.lit(None).cast("bigint")), "core")
    n = moved = now.count()
    while moved:
        own, seen = now.select(F.col("k").alias("s"), F.col("core").alias("own")), now.select(F.col("k").alias("d"), "core")
        if moved * 8 < n:
            fell = now.where("old > core").select(F.col("k").alias("d"), "core", "old")
            own = materialise(arcs.join(fell, "d").join(own, "s").where("core < own and own <= old").select("s", "own").distinct(), "touched")
        counted = arcs.join(own, "s").join(seen, "d").groupBy("s", "own", F.least("own", "core").alias("v")).agg(F.count("*").alias("c"))
        upto = F.sum("c").over(Window.partitionBy("s").orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        h = counted.select(F.col("s").alias("k"), F.least("v", upto).alias("h")).groupBy("k").agg(F.max("h").alias("h"))
        new = materialise(now.drop("old").join(h, "k", "left").select("k", F.coalesce("h", "core").alias("core"), F.col("core").alias("old")), "core")
        moved = new.where("old > core").count()
        discard(graph.spark, now)
        now = new
    return named.join(now, "k", "left").select("id", F.coalesce("core", F.lit(0)).cast("bigint").alias("core"))


@tidy
def truss_numbers(graph: Graph) -> DataFrame:
    """``src``, ``dst``, ``truss``: the largest k such that the edge lies in k - 2 triangles of edges of truss k."""
    graph.need(directed=False)
    left = materialise(graph.edges.where("src <> dst").select("src", "dst"), "edges")
    k, done = 3, None
    while not left.isEmpty():
        both = left.union(left.select("dst", "src"))
        two = left.join(both.toDF("src", "via"), "src").join(both.toDF("dst", "via"), ["dst", "via"])
        support = two.groupBy("src", "dst").count()
        strong = materialise(support.where(F.col("count") >= k - 2).select("src", "dst"), "edges")
        weak = materialise(left.join(strong, ["src", "dst"], "left_anti").withColumn("truss", F.lit(k - 1)), "truss")
        if weak.isEmpty():
            k += 1
        else:
            done = weak if done is None else done.unionByName(weak)
            left = strong
    return done if done is not None else left.withColumn("truss", F.lit(2))


@tidy
def spanning_forest(graph: Graph) -> DataFrame:
    """Boruvka: every component takes its cheapest edge to another (ties by weight, then names) until none is left."""
    graph = graph.written()
    graph.need(directed=False)
    edges = graph.edges.where("src <> dst").select("src", "dst", "w")
    # Edges between components, with the names of these.
    cross = edges.select("src", "dst", "w", F.col("src").alias("a"), F.col("dst").alias("b"))
    taken = None
    while True:
        ends = cross.select("a", "b", F.struct("w", "src", "dst").alias("e")).union(cross.select(F.col("b").alias("a"), F.col("a").alias("b"), F.struct("w", "src", "dst")))
        best = materialise(ends.groupBy("a").agg(F.min(F.struct("e", "b")).alias("e")).select("e.e.src", "e.e.dst", "e.e.w", F.least("a", "e.b").alias("a"), F.greatest("a", "e.b").alias("b")).distinct(), "forest")
        if best.isEmpty():
            break
        more = best.select("src", "dst", "w")
        taken = more if taken is None else taken.unionByName(more)
        # Every component that an edge leaves has taken one, so all have a new name.
        named = materialise(star_components(best, "a", "b"), "components")
        moved = cross.join(named.toDF("a", "x"), "a").join(named.toDF("b", "y"), "b").where("x <> y")
        cross = materialise(moved.select("src", "dst", "w", F.col("x").alias("a"), F.col("y").alias("b")), "cross")
    return taken if taken is not None else edges.limit(0)


@tidy
def cyclomatic(graph: Graph) -> DataFrame:
    """``n_nodes``, ``n_edges``, ``n_components``, ``cyclomatic``: m - n + c."""
    graph = graph.written()
    n, m, c = graph.nodes.count(), graph.edges.count(), components(graph.shadow).select("component").distinct().count()
    return graph.spark.createDataFrame([(n, m, c, m - n + c)], "n_nodes bigint, n_edges bigint, n_components bigint, cyclomatic bigint")


@tidy
def eulerian(graph: Graph) -> DataFrame:
    """Whether a trail, or a circuit, walks every edge once: odd nodes (or unbalanced ones) and one carrying component."""
    graph = graph.written()
    own = components(graph.shadow)
    carry = graph.edges.select(F.col("src").alias("id")).union(graph.edges.select("dst")).distinct().join(own, "id").select("component").distinct().count()
    out = graph.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("o"))
    into = graph.edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("i"))
    zero = F.lit(0)
    b = graph.nodes.join(out, "id", "left").join(into, "id", "left").select((F.coalesce("o", zero) + F.coalesce("i", zero)).alias("d"), (F.coalesce("o", zero) - F.coalesce("i", zero)).alias("x"))
    if graph.directed:
        odd, fits = "x <> 0", F.coalesce(F.max(F.abs("x")), zero) <= 1
    else:
        odd, fits = "d % 2 = 1", F.lit(True)
    return b.agg(F.count(F.when(F.expr(odd), 1)).alias("odd_nodes"), fits.alias("fits")).select("odd_nodes", (F.lit(carry <= 1) & (F.col("odd_nodes") == 0)).alias("circuit"), (F.lit(carry <= 1) & F.col("odd_nodes").isin(0, 2) & F.col("fits")).alias("trail"))


@tidy
def label_propagation(graph: Graph, rounds: int = 10) -> DataFrame:
    """``id``, ``label``: every round each node takes the commonest label of its neighbours and itself, ties to the smallest."""
    graph = graph.written()
    now = materialise(graph.nodes.select("id", F.col("id").alias("label")), "labels")
    arcs = graph.arcs.select("src", "dst").union(graph.nodes.select("id", "id"))
    for _ in range(rounds):
        votes = arcs.join(now.toDF("src", "label"), "src").groupBy(F.col("dst").alias("id"), "label").count()
        pick = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("count"), "label"))
        new = materialise(votes.withColumn("r", pick).where("r = 1").select("id", "label"), "labels")
        still = new.join(now.withColumnRenamed("label", "old"), "id").where("label <> old").isEmpty()
        now = new
        if still:
            break
    return now


@tidy
def modularity(graph: Graph, labels: DataFrame) -> float:
    """Unweighted modularity of a partition (id, label)."""
    graph = graph.written()
    graph.need(directed=False)
    m = graph.edges.count()
    if not m:
        return 0.0
    inside = graph.edges.join(labels.toDF("src", "a"), "src").join(labels.toDF("dst", "b"), "dst").where("a = b").count()
    volume = graph.arcs.groupBy(F.col("src").alias("id")).count().join(labels, "id").groupBy("label").agg(F.sum("count").alias("v")).agg(F.sum(F.col("v").cast("double") ** 2)).first()[0] or 0.0
    return inside / m - volume / (4.0 * m * m)


@tidy
def clique_percolation(graph: Graph, k: int = 3) -> DataFrame:
    """``id``, ``community``: k-cliques that share k - 1 nodes belong together; a node may be in several."""
    graph = graph.written()
    graph.need(directed=False)
    if k < 2:
        raise Invalid("a clique of a community has two nodes at least")
    edges = graph.edges.where("src < dst").select("src", "dst")
    cliques = edges.select(F.array("src", "dst").alias("c"))
    for _ in range(k - 2):
        grown = cliques.withColumn("end", F.element_at("c", -1)).join(edges, F.col("end") == F.col("src")).select("c", F.col("dst").alias("new"))
        wide = grown.withColumn("m", F.explode("c")).join(edges, (F.col("m") == F.col("src")) & (F.col("new") == F.col("dst"))).groupBy("c", "new").count()
        cliques = materialise(wide.where(F.col("count") == F.size("c")).select(F.concat("c", F.array("new")).alias("c")), "cliques")
    named = cliques.withColumn("clique", F.array_join("c", "\x00"))
    faces = named.select("clique", F.explode(F.transform("c", lambda x: F.array_join(F.array_remove("c", x), "\x00"))).alias("face"))
    # Cliques that share a face are tied to that face, never to each other in pairs.
    tied = faces.select(F.concat(F.lit("c:"), "clique").alias("a"), F.concat(F.lit("f:"), "face").alias("b"))
    found = star_components(tied, "a", "b").withColumnRenamed("component", "root")
    members = named.select(F.concat(F.lit("c:"), "clique").alias("id"), "c").join(found, "id").select(F.explode("c").alias("id"), "root").distinct()
    low = members.groupBy("root").agg(F.min("id").alias("low"), F.min("root").alias("r"))
    return members.join(low.select("root"), "root").select("id", F.dense_rank().over(Window.orderBy("root")).alias("community"))


@tidy
def weisfeiler_lehman(graph: Graph, rounds: int = 3) -> DataFrame:
    """``digest`` of the graph: colours refined by their neighbours' sorted colours, hashed with SHA-256."""
    graph = graph.written()
    arcs = graph.arcs.select("src", "dst")
    colour = graph.nodes.join(arcs.groupBy(F.col("src").alias("id")).count(), "id", "left").select("id", F.substring(F.sha2(F.concat(F.lit("deg:"), F.coalesce("count", F.lit(0)).cast("string")), 256), 1, 16).alias("c"))
    for _ in range(rounds):
        near = arcs.join(colour.toDF("dst", "nc"), "dst").groupBy(F.col("src").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("nc")), ",").alias("ns"))
        colour = materialise(colour.join(near, "id", "left").select("id", F.substring(F.sha2(F.concat("c", F.lit("|"), F.coalesce("ns", F.lit(""))), 256), 1, 16).alias("c")), "colours")
    n, m = graph.nodes.count(), graph.edges.count()
    body = colour.agg(F.array_join(F.array_sort(F.collect_list("c")), ",").alias("all"))
    return body.select(F.substring(F.sha2(F.concat(F.lit(f"{n}:{m}:"), "all"), 256), 1, 16).alias("digest"))
