"""Codes and centres of trees, trees that join or reach given nodes, orders by levels, and dominating sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkweave.errors import Invalid
from sparkweave.model import Graph
from sparkweave.operators import orders, tours
from sparkweave.operators.cohesion import components, spanning_forest, strong_components
from sparkweave.operators.paths import relax
from sparkweave.session import discard, materialise, tidy


@tidy
def prufer_code(graph: Graph) -> DataFrame:
    """``position`` (from 1), ``id``: the Pruefer sequence of a tree; two nodes or fewer have an empty one.

    With the greatest name as root, the smallest leaf goes first again and
    again exactly if nodes go by the greatest name below them, and from that
    name upwards.  Anything but a tree is refused.
    """
    graph = graph.written()
    root = graph.nodes.agg(F.max("id")).first()[0]
    if root is None:
        return graph.spark.createDataFrame([], "position int, id string")
    if graph.edges.count() != graph.nodes.count() - 1:
        raise Invalid("a tree has one edge less than nodes")
    found = materialise(tours.tour(graph, graph.spark.createDataFrame([(root,)], "id string")), "tour")
    top = tours.under(found.select("id", "parent", F.col("id").alias("top")), {"top": F.max})
    deep = found.select(F.col("id").alias("top"), F.col("depth").alias("below"))
    leaves = found.where("parent is not null").join(top, "id").join(deep, "top").select("top", (F.col("below") - F.col("depth")).alias("up"), "parent")
    placed = orders.numbered(leaves, "top", "up", name="position").select(F.col("position").cast("int").alias("position"), F.col("parent").alias("id"))
    return placed.where(F.col("position") <= graph.nodes.count() - 2)


@tidy
def centroid_levels(graph: Graph) -> DataFrame:
    """``id``, ``level``: the round in which a node is a centroid of its piece and leaves; the pieces halve, so rounds are few.

    A centroid is the node whose removal leaves the smallest largest piece,
    ties by name.  Every component must be a tree.
    """
    graph = graph.written()
    graph.need(directed=False)
    left, done, level = Graph(materialise(graph.nodes, "nodes"), materialise(graph.edges, "edges"), False), None, 0
    while not left.nodes.isEmpty():
        named = materialise(components(left), "components")
        if not level and left.edges.count() != left.nodes.count() - named.select("component").distinct().count():
            raise Invalid("a component has a cycle")
        found = materialise(tours.tour(Graph(left.nodes, left.edges, False, True)).where("parent is not null").select("id", "parent", F.col("size").alias("s")), "tour")
        size = named.groupBy("component").agg(F.count("*").alias("n"))
        below = found.select("id", "s")
        under = found.groupBy(F.col("parent").alias("id")).agg(F.max("s").alias("most"))
        held = named.join(size, "component").join(below, "id", "left").join(under, "id", "left")
        worst = F.greatest(F.coalesce("most", F.lit(0)), F.col("n") - F.coalesce("s", "n"))
        new = materialise(held.groupBy("component").agg(F.min(F.struct(worst.alias("worst"), "id")).alias("x")).select("x.id", F.lit(level).alias("level")), "centroids")
        done = new if done is None else done.unionByName(new)
        rest = left.without(new)
        left, level = Graph(materialise(rest.nodes, "nodes"), materialise(rest.edges, "edges"), False), level + 1
    return done if done is not None else graph.nodes.select("id", F.lit(0).alias("level"))


@tidy
def steiner_tree(graph: Graph, terminals: DataFrame) -> DataFrame:
    """``src``, ``dst``, ``w``: a tree that joins the nodes of ``terminals(id)``, at most twice as heavy as the lightest.

    Every node belongs to its nearest terminal; edges between two regions give
    the lightest link of the two terminals, and a spanning tree of links is
    unfolded to routes.  A spanning tree of those loses its leaves that are no
    terminals.  Terminals in different components get a tree each.
    """
    graph = graph.written()
    graph.need(directed=False)
    ends = materialise(terminals.select("id").distinct().join(graph.nodes, "id", "left_semi"), "terminals")
    # One origin for all seeds: the nearest terminal is found by walking back.
    near = materialise(relax(graph, ends.select(F.lit("any").alias("origin"), "id", F.lit(0.0).alias("dist"))).select("id", "dist", "via"), "near")
    home = ends.select("id", F.col("id").alias("home"))
    rest = near.where("via is not null").select("id", "via")
    while True:
        new = materialise(rest.join(home.toDF("via", "home"), "via").select("id", "home").join(home.select("id"), "id", "left_anti"), "home")
        if new.isEmpty():
            break
        home = home.unionByName(new)
    at = materialise(near.join(home, "id").select("id", "dist", "home"), "near")
    cross = graph.edges.join(at.toDF("src", "da", "a"), "src").join(at.toDF("dst", "db", "b"), "dst").where("a <> b")
    links = materialise(cross.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min(F.struct((F.col("da") + F.col("w") + F.col("db")).alias("cost"), "src", "dst", "w")).alias("e")), "links")
    chosen = spanning_forest(Graph.of(links.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("e.cost").alias("w"))))
    taken = links.join(chosen.select(F.col("src").alias("a"), F.col("dst").alias("b")), ["a", "b"], "left_semi").select("e.src", "e.dst", "e.w")
    back = near.where("via is not null").select("id", "via")
    reach, steps = taken.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), None
    while True:
        step = materialise(reach.join(back, "id"), "steps")
        if step.isEmpty():
            break
        steps = step if steps is None else steps.unionByName(step)
        reach = step.select(F.col("via").alias("id")).distinct()
    used = taken
    if steps is not None:
        named = steps.select(F.least("id", "via").alias("src"), F.greatest("id", "via").alias("dst")).distinct()
        used = used.unionByName(graph.edges.join(named, ["src", "dst"], "left_semi").select("src", "dst", "w")).distinct()
    tree = materialise(spanning_forest(Graph.of(used)), "tree")
    while True:
        degree = tree.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").count()
        loose = materialise(degree.where("count = 1").select("id").join(ends, "id", "left_anti"), "loose")
        if loose.isEmpty():
            return tree
        tree = materialise(tree.join(loose.toDF("src"), "src", "left_anti").join(loose.toDF("dst"), "dst", "left_anti").select("src", "dst", "w"), "tree")


@tidy
def arborescence(graph: Graph, root: str) -> DataFrame:
    """``src``, ``dst``, ``w``: the lightest set of arcs by which ``root`` reaches every node.

    Every node takes its lightest arc in; each cycle of such arcs becomes one
    node whose arcs in cost what they add, and so on until no cycle is left.
    Unfolded, a cycle gives up the arc whose head another arc enters.  A node
    that the root cannot reach is refused.
    """
    graph = graph.written()
    graph.need(directed=True, nodes=(root,))
    arcs = materialise(graph.arcs.where(F.col("src") != F.col("dst")).where(F.col("dst") != root).select("src", "dst", "w", F.col("src").alias("s"), F.col("dst").alias("t")), "arcs")
    nodes, levels = materialise(graph.nodes, "nodes"), []
    while True:
        best = materialise(arcs.groupBy("dst").agg(F.min(F.struct("w", "s", "t", "src")).alias("x")).select("x.src", "dst", "x.w", "x.s", "x.t"), "best")
        if best.count() < nodes.count() - 1:
            raise Invalid("the root does not reach every node")
        named = materialise(strong_components(Graph(nodes, best.select("src", "dst", "w"), True)), "cycles")
        rings = materialise(named.groupBy("component").count().where("count > 1").select("component"), "rings")
        levels.append((arcs, best, named.join(rings, "component").select("id")))
        if rings.isEmpty():
            break
        cost = best.join(named.toDF("dst", "b"), "dst").join(rings.toDF("b"), "b", "left_semi").select("dst", F.col("w").alias("less"))
        moved = arcs.join(named.toDF("src", "a"), "src").join(named.toDF("dst", "b"), "dst").where("a <> b").join(cost, "dst", "left")
        arcs = materialise(moved.select(F.col("a").alias("src"), F.col("b").alias("dst"), (F.col("w") - F.coalesce("less", F.lit(0.0))).alias("w"), "s", "t"), "arcs")
        nodes = materialise(named.select(F.col("component").alias("id")).distinct(), "nodes")
    picked = levels[-1][1].select("s", "t")
    for arcs, best, ringed in reversed(levels[:-1]):
        # Arcs taken one level up stand here under this level's heads; a ring keeps its other arcs.
        entered = arcs.join(picked, ["s", "t"], "left_semi").select("dst")
        kept = best.join(ringed.toDF("dst"), "dst", "left_semi").join(entered, "dst", "left_anti").select("s", "t")
        picked = materialise(picked.unionByName(kept), "picked")
    return graph.edges.join(picked.toDF("src", "dst"), ["src", "dst"], "left_semi").select("src", "dst", "w")


@tidy
def level_order(graph: Graph) -> DataFrame:
    """``id``, ``position`` (from 0): the Cuthill-McKee order; reversed it is the usual ordering of sparse matrices.

    A component starts at its node of smallest degree; a level follows in the
    order of the first neighbour placed before it, then degree, then name.
    Components follow each other in the order of their starts.  A level is
    ordered by one sort within its component.
    """
    graph = graph.written()
    graph.need(directed=False)
    arcs = materialise(graph.arcs.where("src <> dst").select("src", "dst"), "arcs")
    degree = graph.nodes.join(arcs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d")), "id", "left").select("id", F.coalesce("d", F.lit(0)).alias("d"))
    about = materialise(components(graph).join(degree, "id"), "about")
    start = about.groupBy("component").agg(F.min(F.struct("d", "id")).alias("x"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = materialise(start.select("component", "x.id", before.alias("base")), "starts")
    level = start.select("id", "component", F.col("base").alias("position"))
    done = level
    while True:
        met = arcs.join(level.select(F.col("id").alias("src"), "component", "position"), "src").groupBy(F.col("dst").alias("id"), "component").agg(F.min("position").alias("first"))
        new = met.join(done.select("id"), "id", "left_anti").join(about.select("id", "d"), "id")
        last = level.groupBy("component").agg(F.max("position").alias("last"))
        place = F.row_number().over(Window.partitionBy("component").orderBy("first", "d", "id"))
        level = materialise(new.join(last, "component").select("id", "component", (F.col("last") + place).alias("position")), "level")
        if level.isEmpty():
            return done.select("id", "position")
        done = done.unionByName(level)


@tidy
def bandwidth(graph: Graph, order: DataFrame) -> DataFrame:
    """``bandwidth``: the longest edge in an order ``(id, position)``; 0 without edges."""
    ends = graph.edges.join(order.toDF("src", "a"), "src").join(order.toDF("dst", "b"), "dst")
    return ends.agg(F.coalesce(F.max(F.abs(F.col("a") - F.col("b"))), F.lit(0)).alias("bandwidth"))


@tidy
def dominating_set(graph: Graph) -> DataFrame:
    """``id``: the greedy dominating set, most newly covered nodes first, ties by name.

    A choice changes gains two hops away at most, so every node that is first
    within two hops is chosen in the same round; the set is the sequential one.
    """
    graph = graph.written()
    graph.need(directed=False)
    self_ = graph.nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"))
    near = materialise(graph.arcs.where("src <> dst").select("src", "dst").unionByName(self_), "near")
    bare, chosen = materialise(graph.nodes, "bare"), graph.spark.createDataFrame([], "id string")
    while True:
        open_ = near.join(bare.toDF("dst"), "dst", "left_semi")
        gain = materialise(open_.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("g")), "gain")
        # Two nodes compete if some uncovered node is near both: first its best, then whoever is best of all.
        key = F.struct((-F.col("g")).alias("g"), F.col("src").alias("id"))
        best = open_.join(gain.toDF("src", "g"), "src").groupBy("dst").agg(F.min(key).alias("top"))
        beaten = open_.join(best, "dst").where("top.id <> src").select("src")
        new = materialise(gain.select("id").join(beaten.toDF("id"), "id", "left_anti"), "chosen")
        if new.isEmpty():
            return chosen
        chosen = chosen.unionByName(new)
        rest = materialise(bare.join(near.join(new.toDF("src"), "src", "left_semi").select(F.col("dst").alias("id")), "id", "left_anti"), "bare")
        discard(graph.spark, bare)
        bare = rest
