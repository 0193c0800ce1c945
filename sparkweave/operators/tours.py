"""Trees by Euler tours and jumps that double: no loop is as long as a tree is deep.

A tour runs along every edge of a tree once down and once up.  Its successor
table follows from the order of the neighbours at each node, its positions from
list ranking, and parents, depths, sizes and clocks from the positions.  What
gathers over subtrees or along ways up doubles its reach in every round, with
one row for each node.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweave.errors import Invalid
from sparkweave.model import Graph
from sparkweave.operators.cohesion import components, spanning_forest
from sparkweave.operators.orders import numbered, ranked, summed
from sparkweave.plans.components import star_components
from sparkweave.session import materialise, tidy


def _walked(graph: Graph, roots: DataFrame | None, named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``component``, ``root`` of every tree; and ``src``, ``dst``, ``left``, ``other``: each arc's rank from the end of a tour, and that of the way back.

    The neighbours of a node go round: those after the one that the tour came from are the first.
    """
    tops = named.where("id = component").select("component", F.col("id").alias("root"))
    if roots is not None:
        tops = materialise(named.join(roots.select("id").distinct(), "id").select("component", F.col("id").alias("root")), "roots")
        if tops.count() != named.select("component").distinct().count() or not tops.groupBy("component").count().where("count > 1").isEmpty():
            raise Invalid("every tree needs one root")
    if graph.edges.count() != graph.nodes.count() - named.select("component").distinct().count():
        raise Invalid("the graph is not a forest")
    arcs = materialise(numbered(graph.arcs.select("src", "dst"), "src", "dst"), "arcs")
    ends = materialise(arcs.groupBy("src").agg(F.min("place").alias("first"), F.max("place").alias("end")), "ends")
    # After u -> v comes the arc that follows v -> u among those of v, which go round.
    back = arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("place").alias("id"))
    turn = arcs.select("src", "dst", F.col("place").alias("back")).join(back, ["src", "dst"]).join(ends, "src").select("id", "src", F.when(F.col("back") == F.col("end"), F.col("first")).otherwise(F.col("back") + 1).alias("next"))
    starts = tops.join(ends, tops["root"] == ends["src"]).select(F.col("first").alias("next"), F.lit(True).alias("start"))
    links = turn.join(starts, "next", "left").select("id", F.when(F.col("start").isNull(), F.col("next")).alias("next"), F.lit(1).cast("bigint").alias("left"))
    left = ranked(links, "left")
    at = materialise(arcs.join(left.select(F.col("id").alias("place"), "left"), "place").select("src", "dst", "left"), "tour")
    return tops, at.join(at.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("left").alias("other")), ["src", "dst"])


@tidy
def hung(graph: Graph, root: str) -> DataFrame:
    """``id``, ``parent``, ``size``, ``place`` of the one tree that the graph must be: as ``tour`` but for the order of siblings, which is any, at half of its cost.

    Nodes of a subtree have places that follow each other, its top the first.
    """
    graph = graph.need(directed=False).written()
    tops, both = _walked(graph, graph.spark.createDataFrame([(root,)], "id string"), materialise(components(graph), "trees"))
    # The way down an edge comes before the way up; between them are two arcs for each node below.
    down = both.where(F.col("left") > F.col("other")).select(F.col("dst").alias("id"), F.col("src").alias("parent"), ((F.col("left") - F.col("other") + 1) / 2).cast("bigint").alias("size"), (-F.col("left")).alias("at"))
    n = F.lit(graph.nodes.count()).cast("bigint")
    top = tops.select(F.col("root").alias("id"), F.lit(None).cast("string").alias("parent"), n.alias("size"), (-2 * n).alias("at"))
    return materialise(numbered(down.unionByName(top), "at").drop("at"), "hung")


@tidy
def tour(graph: Graph, roots: DataFrame | None = None, named: DataFrame | None = None) -> DataFrame:
    """The depth-first tour of a forest: ``id``, ``parent``, ``root``, ``depth``, ``enter``, ``leave``, ``place``, ``size``.

    Neighbours are visited by name.  The clock of ``enter`` and ``leave`` starts
    at 1 in every tree and ticks at each; ``place`` counts nodes from 1 in the
    order in which they are entered, ``size`` the nodes of the subtree.  Trees
    hang on the nodes of ``roots(id)``, by default on their smallest nodes.
    Cycles, loops, and trees with no root or several, are refused.  ``named`` is
    the table of ``components``, if it is at hand.
    """
    graph = graph.need(directed=False).written()
    named = materialise(components(graph), "trees") if named is None else named
    tops, both = _walked(graph, roots, named)
    # The way down an edge comes before the way up.
    child = materialise(numbered(both.where(F.col("left") > F.col("other")).select(F.col("src").alias("parent"), F.col("dst").alias("id")), "parent", "id", name="k"), "children")
    return _timed(named.join(tops, "component").select("id", "root"), child)


def _timed(nodes: DataFrame, child: DataFrame) -> DataFrame:
    """The tour of ``nodes(id, root)`` in which children come in the order of ``child(id, parent, k)``, ``k`` being consecutive among siblings."""
    span = child.groupBy(F.col("parent").alias("of")).agg(F.min("k").alias("first"), F.max("k").alias("end"))
    # Element 2 k goes down to a node, element 2 k + 1 up from it.
    down = child.join(span.select(F.col("of").alias("id"), "first"), "id", "left").select((2 * F.col("k")).alias("id"), F.coalesce(2 * F.col("first"), 2 * F.col("k") + 1).alias("next"), F.lit(0).cast("bigint").alias("ups"))
    above = child.select(F.col("id").alias("parent"), F.col("k").alias("kp"))
    up = child.join(span.select(F.col("of").alias("parent"), "end"), "parent").join(above, "parent", "left").select((2 * F.col("k") + 1).alias("id"), F.when(F.col("k") < F.col("end"), 2 * F.col("k") + 2).otherwise(2 * F.col("kp") + 1).alias("next"), F.lit(1).cast("bigint").alias("ups"))
    done = materialise(ranked(down.union(up).withColumn("left", F.lit(1).cast("bigint")), "left", "ups").select("id", "left", "ups"), "ranks")
    entered = done.where("id % 2 = 0").select((F.col("id") / 2).cast("bigint").alias("k"), "left", "ups")
    left = done.where("id % 2 = 1").select(((F.col("id") - 1) / 2).cast("bigint").alias("k"), F.col("left").alias("after"))
    placed = child.join(entered, "k").join(left, "k").select("id", "parent", "left", "ups", "after")
    size = nodes.groupBy("root").agg(F.count("*").alias("n"))
    whole = nodes.join(size, "root").join(placed, "id", "left")
    n, top = F.col("n"), F.col("parent").isNull()
    # A tour of n nodes has 2 n - 2 steps, half of them up.
    enter = F.when(top, F.lit(1)).otherwise(2 * n - F.col("left"))
    leave = F.when(top, 2 * n).otherwise(2 * n - F.col("after"))
    depth = F.when(top, F.lit(0)).otherwise(enter - 1 - 2 * (n - 1 - F.col("ups")))
    timed = whole.select("id", "parent", "root", depth.cast("bigint").alias("depth"), enter.cast("bigint").alias("enter"), leave.cast("bigint").alias("leave"))
    return timed.select("*", ((F.col("enter") + F.col("depth") + 1) / 2).cast("bigint").alias("place"), ((F.col("leave") - F.col("enter") + 1) / 2).cast("bigint").alias("size"))


@tidy
def climbed(rows: DataFrame, gather: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """``id`` and what ``gather`` makes of its columns along the way from each node to its root, both included.

    ``rows(id, parent, columns)``; every function joins what is nearer with what
    is farther.  Rounds go with the logarithm of the depth.
    """
    now = materialise(rows.select("id", F.col("parent").alias("up"), *gather), "ways")
    while not now.where("up is not null").isEmpty():
        above = now.select(F.col("id").alias("up"), F.col("up").alias("__up"), *[F.col(c).alias(f"__{c}") for c in gather])
        met = now.join(above, "up", "left")
        now = materialise(met.select("id", F.col("__up").alias("up"), *[F.when(F.col(f"__{c}").isNull(), F.col(c)).otherwise(join(F.col(c), F.col(f"__{c}"))).alias(c) for c, join in gather.items()]), "ways")
    return now.drop("up")


@tidy
def under(rows: DataFrame, gather: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """``id`` and aggregates of its columns over each node's subtree, itself included.

    ``rows(id, parent, columns)``; the aggregates must not mind repeats
    (least, greatest).  In every round a node takes what its descendants of one
    distance have gathered, so reach doubles.
    """
    now = materialise(rows.select("id", F.col("parent").alias("up"), *gather), "below")
    while not now.where("up is not null").isEmpty():
        given = now.where("up is not null").select(F.col("up").alias("id"), *gather)
        merged = now.select("id", *gather).unionByName(given).groupBy("id").agg(*[f(F.col(c)).alias(c) for c, f in gather.items()])
        jump = now.select("id", "up").join(now.select(F.col("id").alias("up"), F.col("up").alias("next")), "up", "left").select("id", F.col("next").alias("up"))
        now = materialise(merged.join(jump, "id"), "below")
    return now.drop("up")


@tidy
def depth_first(graph: Graph, source: str) -> DataFrame:
    """``id``, ``parent``, ``discover``, ``finish``, ``preorder``, ``postorder`` of the tree of ``source``, neighbours by name.

    The clock starts at 1; orders count from 1.  Other trees of the forest are left out.
    """
    graph = graph.need(directed=False, nodes=(source,)).written()
    own = materialise(components(graph), "trees")
    named = own.where(F.col("component") == own.where(F.col("id") == source).first()["component"])
    part = graph.edges.join(named.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst", "w")
    found = tour(Graph(named.select("id"), part, False, True), graph.spark.createDataFrame([(source,)], "id string"), named)
    # Of the ticks until a node is left half, less its depth, are departures.
    return found.select("id", "parent", F.col("enter").alias("discover"), F.col("leave").alias("finish"), F.col("place").alias("preorder"), ((F.col("leave") - F.col("depth")) / 2).cast("bigint").alias("postorder"))


@tidy
def subtree_values(graph: Graph, root: str, values: DataFrame) -> DataFrame:
    """``id``, ``total``, ``largest`` of ``values(id, value)`` over each subtree; nodes without a value count 0.

    The total of a subtree is a difference of running sums over the nodes as they are entered.
    """
    found = hung(graph, root)
    held = materialise(found.join(values.select("id", F.col("value").cast("double").alias("value")), "id", "left").select("id", "parent", "place", "size", F.coalesce("value", F.lit(0.0)).alias("value")), "values")
    sums = materialise(summed(held.select("place", F.col("value").alias("upto")), "place", "upto"), "sums")
    last = sums.select(F.col("place").alias("last"), F.col("upto").alias("most"))
    total = held.withColumn("last", F.col("place") + F.col("size") - 1).join(sums, "place").join(last, "last")
    top = under(held, {"value": F.max}).select("id", F.col("value").alias("largest"))
    return total.select("id", (F.col("most") - F.col("upto") + F.col("value")).alias("total")).join(top, "id").select("id", F.round("total", 6).alias("total"), "largest")


@tidy
def _sized(graph: Graph, root: str) -> DataFrame:
    """``id``, ``parent``, ``size`` of the one tree that the graph must be.

    Leaves are taken away with their parents and sizes while they are one in
    eight of the nodes that are left, so all rounds together cost a few times
    the first; what has few leaves is hung by a tour, and its sizes are sums over ranges.
    """
    graph = graph.need(directed=False).written()
    one = F.lit(1).cast("bigint")
    n = graph.nodes.count()
    # Other graphs are refused below.
    tree = graph.edges.count() == n - 1 and not graph.nodes.where(F.col("id") == root).isEmpty()
    edges, nodes, done = graph.edges.select("src", "dst"), graph.nodes.select("id", one.alias("size")), []
    while tree and n > 1:
        both = edges.union(edges.select("dst", "src"))
        leaves = both.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"), F.min("dst").alias("parent")).where((F.col("n") == 1) & (F.col("id") != root))
        gone = materialise(leaves.join(nodes, "id").select("id", "parent", "size"), "leaves")
        taken = gone.count()
        if taken * 8 < n:
            break
        done.append(gone)
        ids = gone.select("id")
        edges = materialise(edges.join(ids.toDF("src"), "src", "left_anti").join(ids.toDF("dst"), "dst", "left_anti").select("src", "dst"), "edges")
        rest = nodes.join(ids, "id", "left_anti").union(gone.select("parent", "size"))
        nodes, n = materialise(rest.groupBy("id").agg(F.sum("size").alias("size")), "nodes"), n - taken
    if tree and n == 1:
        found = nodes.select("id", F.lit(None).cast("string").alias("parent"), "size")
    else:
        held = materialise(hung(Graph(nodes.select("id"), edges.withColumn("w", F.lit(1.0)), False, True), root).withColumnRenamed("size", "n").join(nodes, "id"), "hung")
        sums = materialise(summed(held.select("place", F.col("size").alias("upto")), "place", "upto"), "sums")
        last = sums.select(F.col("place").alias("last"), F.col("upto").alias("most"))
        found = held.withColumn("last", F.col("place") + F.col("n") - 1).join(sums, "place").join(last, "last").select("id", "parent", (F.col("most") - F.col("upto") + F.col("size")).alias("size"))
    for gone in done:
        found = found.unionByName(gone)
    return materialise(found, "sized")


@tidy
def heavy_paths(graph: Graph, root: str) -> DataFrame:
    """``id``, ``head``, ``position``, ``length``: the heavy-light chains of a tree.

    A node's chain goes on to the child of the largest subtree, ties by name;
    positions count from 0 at the chain's head.  A way up meets as many chains
    as the logarithm of the tree's size at most.
    """
    found = _sized(graph, root)
    heavy = materialise(found.where("parent is not null").groupBy("parent").agg(F.min_by("id", F.struct((-F.col("size")).alias("s"), "id")).alias("id")), "heavy")
    # Nodes that no heavy edge meets are chains of their own; only the others are ranked.
    heads = heavy.select(F.col("parent").alias("id")).join(heavy.select("id"), "id", "left_anti").select("id", F.lit(None).cast("string").alias("next"))
    links = materialise(heavy.select("id", F.col("parent").alias("next")).unionByName(heads), "links")
    chain = materialise(ranked(links.withColumn("steps", F.lit(1).cast("bigint")), "steps").select("id", F.col("last").alias("head"), (F.col("steps") - 1).alias("position")), "chains")
    one = F.lit(1).cast("bigint")
    alone = found.select("id").join(links.select("id"), "id", "left_anti").select("id", F.col("id").alias("head"), (one - 1).alias("position"), one.alias("length"))
    return chain.join(chain.groupBy("head").agg(F.count("*").alias("length")), "head").select("id", "head", "position", "length").unionByName(alone)


@tidy
def jumps(rows: DataFrame, gather: dict[str, Callable[[Column, Column], Column]] | None = None) -> list[DataFrame]:
    """Tables ``id``, ``up``, columns: where 1, 2, 4, ... steps up lead, and what ``gather`` makes of the columns of the steps taken.

    ``rows(id, parent, columns)``: a column belongs to the step from a node to its parent.
    """
    gather = gather or {}
    tables = [materialise(rows.where("parent is not null").select("id", F.col("parent").alias("up"), *gather), "jump")]
    while True:
        now = tables[-1]
        more = now.select(F.col("id").alias("up"), F.col("up").alias("__up"), *[F.col(c).alias(f"__{c}") for c in gather])
        new = materialise(now.join(more, "up").select("id", F.col("__up").alias("up"), *[f(F.col(c), F.col(f"__{c}")).alias(c) for c, f in gather.items()]), "jump")
        if new.isEmpty():
            return tables
        tables.append(new)


@tidy
def common_ancestors(found: DataFrame, pairs: DataFrame, cost: DataFrame | None = None) -> DataFrame:
    """``a``, ``b``, ``lca``, ``distance`` for ``pairs(a, b)``, and ``largest`` of ``cost(id, value)`` on the way.

    ``found`` is a ``tour``.  ``value`` belongs to the edge above a node.  Pairs
    of different trees, and of nodes not there, give no row; repeated pairs count once.
    """
    steps = found.select("id", "parent") if cost is None else found.select("id", "parent").join(cost.select("id", F.col("value").cast("double").alias("value")), "id", "left")
    gather = {} if cost is None else {"value": lambda a, b: F.greatest(a, b)}
    up = jumps(steps, gather)
    at = found.select("id", "root", "depth", "enter", "leave")
    ends = pairs.select("a", "b").distinct().join(at.toDF("a", "ra", "da", "ea", "la"), "a").join(at.toDF("b", "rb", "db", "eb", "lb"), "b").where("ra = rb")
    # Each side climbs while what it reaches does not hold the other end.
    interval = at.select(F.col("id").alias("up"), F.col("enter").alias("e"), F.col("leave").alias("l"))
    best = None
    for x, y, mine, other in (("a", "b", "ea", "eb"), ("b", "a", "eb", "ea")):
        now = ends.select("a", "b", F.col(x).alias("at"), F.col(other).alias("other"), *([F.lit(None).cast("double").alias("most")] if cost is not None else []))
        above = F.col("e") <= F.col("other")
        for k, table in enumerate(reversed(up)):
            step = now.join(table.withColumnsRenamed({"id": "at", "value": "v"}), "at", "left").join(interval, "up", "left")
            moves = F.col("up").isNotNull() & ~(above & (F.col("l") > F.col("other")))
            now = step.select("a", "b", F.when(moves, F.col("up")).otherwise(F.col("at")).alias("at"), "other", *([F.when(moves, F.greatest("most", "v")).otherwise(F.col("most")).alias("most")] if cost is not None else []))
            if k % 4 == 3:
                now = materialise(now, "climb")
        # One step more unless the start already holds the other end.
        own = at.select(F.col("id").alias("at"), F.col("enter").alias("e"), F.col("leave").alias("l"))
        last = now.join(own, "at").join(up[0].withColumnsRenamed({"id": "at", "value": "v"}), "at", "left")
        holds = above & (F.col("l") > F.col("other"))
        side = last.select("a", "b", F.when(holds, F.col("at")).otherwise(F.col("up")).alias("lca"), *([F.when(holds, F.col("most")).otherwise(F.greatest("most", "v")).alias(f"most_{x}")] if cost is not None else []))
        side = materialise(side, "side")
        best = side if best is None else best.join(side.drop("lca"), ["a", "b"]) if cost is not None else best
    depth = at.select(F.col("id").alias("lca"), F.col("depth").alias("dl"))
    out = best.join(ends.select("a", "b", "da", "db"), ["a", "b"]).join(depth, "lca").select("a", "b", "lca", (F.col("da") + F.col("db") - 2 * F.col("dl")).alias("distance"), *([F.greatest("most_a", "most_b").alias("largest")] if cost is not None else []))
    return out


@tidy
def blocks_of(graph: Graph, named: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``src``, ``dst``, ``at``: a name of the block of every edge but loops; and the ``tour`` of a spanning forest.

    With places of entry as numbers, the least and greatest number that edges
    outside the forest reach from a subtree tell which forest edges lie on a
    cycle together; those that are tied, directly or through others, are a block.
    ``named`` is the table of ``components``, if it is at hand.
    """
    graph = graph.need(directed=False).written()
    edges = graph.edges.where("src <> dst").select("src", "dst")
    forest = materialise(spanning_forest(Graph(graph.nodes, edges.withColumn("w", F.lit(1.0)), False, True)).select("src", "dst", F.lit(1.0).alias("w")), "forest")
    found = materialise(tour(Graph(graph.nodes, forest, False, True), named=materialise(components(graph), "trees") if named is None else named), "tour")
    # Numbers of all trees on one line.
    bases = numbered(found.where("parent is null").select("root", F.col("size").alias("n")), "root", name="k")
    line = ranked(bases.select((-F.col("k")).alias("id"), F.when(F.col("k") > 1, 1 - F.col("k")).alias("next"), F.col("n").alias("upto")), "upto")
    base = bases.join(line.select((-F.col("id")).alias("k"), "upto"), "k").select("root", (F.col("upto") - F.col("n")).alias("base"))
    at = materialise(found.join(base, "root").select("id", "parent", "root", "depth", (F.col("place") + F.col("base")).alias("p"), "size"), "numbers")
    others = materialise(edges.join(forest.select("src", "dst"), ["src", "dst"], "left_anti"), "others")
    p = at.select("id", "p", "size")
    far = others.join(p.toDF("src", "ps", "ss"), "src").join(p.toDF("dst", "pd", "sd"), "dst")
    far = materialise(far, "far")
    reach = far.select(F.col("src").alias("id"), F.col("pd").alias("to")).union(far.select("dst", "ps")).groupBy("id").agg(F.min("to").alias("low"), F.max("to").alias("high"))
    own = at.join(reach, "id", "left").select("id", "parent", F.least("p", F.coalesce("low", "p")).alias("low"), F.greatest("p", F.coalesce("high", "p")).alias("high"))
    spread = materialise(under(own, {"low": F.min, "high": F.max}), "reach")
    inner = at.where("parent is not null").select("id", "parent").join(at.select(F.col("id").alias("parent"), F.col("parent").alias("above"), F.col("p").alias("pp"), F.col("size").alias("sp")), "parent").where("above is not null").join(spread, "id")
    # A forest edge is named by its lower node.
    tied = inner.where("low < pp or high >= pp + sp").select(F.col("id").alias("a"), F.col("parent").alias("b"))
    across = far.where("ps + ss <= pd or pd + sd <= ps").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    joined = star_components(materialise(tied.union(across), "tied"), "a", "b")
    lower = at.where("parent is not null").select(F.least("id", "parent").alias("src"), F.greatest("id", "parent").alias("dst"), "id")
    outer = far.select("src", "dst", F.when(F.col("ps") > F.col("pd"), F.col("src")).otherwise(F.col("dst")).alias("id"))
    placed = lower.union(outer).join(joined, "id", "left").select("src", "dst", F.coalesce("component", "id").alias("at"))
    return materialise(placed, "blocks"), found
