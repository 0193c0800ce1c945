"""Searches that grow partial answers by joins, and trees by levels.

A partial answer is a row; every round joins it with what may come next and
filters.  All branches of a round run in parallel; caps refuse what would grow
beyond bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkweave.errors import Invalid
from sparkweave.model import Graph
from sparkweave.operators import tours
from sparkweave.operators.cohesion import strong_components
from sparkweave.operators.paths import relax, topological_layers
from sparkweave.session import materialise, tidy


def embeddings(graph: Graph, pattern: list[tuple[str, str]], induced: bool = False) -> DataFrame:
    """A row for every embedding of a pattern (pairs of names): one column a pattern node, joined edge by edge."""
    names: list[str] = []
    left = list(pattern)
    found: DataFrame | None = None
    arcs = graph.arcs.where("src <> dst").select("src", "dst")
    while left:
        pick = next((e for e in left if not names or e[0] in names or e[1] in names), None)
        if pick is None:
            raise Invalid("the pattern must be connected")
        left.remove(pick)
        a, b = pick if not names or pick[0] in names else pick[::-1]
        step = arcs if (a, b) == pick or not graph.directed else arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        if found is None:
            found, names = step.toDF(a, b), [a, b]
        elif a in names and b in names:
            found = found.join(step.toDF(a, b), [a, b], "left_semi")
        else:
            found = found.join(step.toDF(a, b), a)
            for other in names:
                found = found.where(F.col(other) != F.col(b))
            names.append(b)
    if induced:
        tied = {frozenset(e) for e in pattern}
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                if frozenset((a, b)) not in tied:
                    found = found.join(arcs.toDF(a, b), [a, b], "left_anti")
                    if graph.directed:
                        found = found.join(arcs.toDF(b, a), [a, b], "left_anti")
    return found.select(*names)


@tidy
def hamiltonian(graph: Graph, cycle: bool = False, most: int = 14) -> DataFrame:
    """``n_walks``: routes that visit every node once (and return); paths grow one node a round."""
    graph = graph.written()
    graph.need(most=most, least=1)
    n = graph.nodes.count()
    arcs = graph.arcs.where("src <> dst").select("src", "dst")
    starts = graph.nodes.orderBy("id").limit(1) if cycle else graph.nodes
    grown = starts.select(F.col("id").alias("here"), F.array("id").alias("path"))
    for _ in range(n - 1):
        grown = materialise(grown.join(arcs, F.col("here") == F.col("src")).where("not array_contains(path, dst)").select(F.col("dst").alias("here"), F.concat("path", F.array("dst")).alias("path")), "paths")
    if cycle:
        grown = grown.join(arcs, F.col("here") == F.col("src")).where("dst = path[0]")
    return grown.agg(F.count("*").alias("n_walks"))


@tidy
def shortest_tour(graph: Graph, most: int = 12) -> DataFrame:
    """``tour_cost``: the cheapest round trip through all nodes of a complete graph.

    States are (visited set, last node); of each only the cheapest is kept, so
    there are at most n * 2 ** n rows in a round.
    """
    graph = graph.written()
    graph.need(directed=False, least=3, most=most)
    n = graph.nodes.count()
    if graph.edges.where("src <> dst").count() != n * (n - 1) // 2:
        raise Invalid("a tour needs a complete graph")
    number = graph.nodes.withColumn("b", (F.row_number().over(Window.orderBy("id")) - 1).cast("bigint"))
    arcs = materialise(graph.arcs.join(number.toDF("src", "a"), "src").join(number.toDF("dst", "b"), "dst").select("a", "b", "w"), "arcs")
    now = graph.spark.createDataFrame([(1, 0, 0.0)], "seen bigint, here bigint, cost double")
    for _ in range(n - 1):
        bit = F.expr("shiftleft(1L, cast(b as int))")
        now = materialise(now.join(arcs, F.col("here") == F.col("a")).where(F.col("seen").bitwiseAND(bit) == 0).groupBy(F.col("seen").bitwiseOR(bit).alias("seen"), F.col("b").alias("here")).agg(F.min(F.col("cost") + F.col("w")).alias("cost")), "tours")
    return now.join(arcs.where("b = 0"), F.col("here") == F.col("a")).agg(F.round(F.min(F.col("cost") + F.col("w")), 6).alias("tour_cost"))


@tidy
def linear_extensions(graph: Graph, most: int = 20) -> DataFrame:
    """``n_orders`` of an acyclic digraph: sets of placed nodes grow by any node whose predecessors are placed."""
    graph = graph.written()
    graph.need(directed=True, most=most)
    n = graph.nodes.count()
    number = graph.nodes.withColumn("b", (F.row_number().over(Window.orderBy("id")) - 1).cast("int"))
    bit = F.expr("shiftleft(1L, b)")
    before = graph.edges.join(number.toDF("src", "b"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(bit).alias("need"))
    nodes = materialise(number.join(before, "id", "left").select(bit.alias("bit"), F.coalesce("need", F.lit(0)).alias("need")), "nodes")
    now = graph.spark.createDataFrame([(0, 1)], "placed bigint, ways bigint").withColumn("ways", F.col("ways").cast("decimal(38,0)"))
    for _ in range(n):
        step = now.join(F.broadcast(nodes), (F.col("placed").bitwiseAND(F.col("bit")) == 0) & (F.col("placed").bitwiseAND(F.col("need")) == F.col("need")))
        now = materialise(step.groupBy(F.col("placed").bitwiseOR(F.col("bit")).alias("placed")).agg(F.sum("ways").cast("decimal(38,0)").alias("ways")), "orders")
    return now.agg(F.coalesce(F.sum("ways"), F.lit(0)).cast("bigint").alias("n_orders"))


@tidy
def colourings(graph: Graph, colours: int, most: int = 14) -> DataFrame:
    """``n_colourings`` proper ones with so many colours, node by node; only the colours of placed nodes are kept."""
    graph = graph.written()
    graph.need(directed=False, most=most)
    order = [r["id"] for r in graph.nodes.orderBy("id").collect()]
    edges = {(r["src"], r["dst"]) for r in graph.edges.where("src <> dst").collect()}
    palette = graph.spark.range(colours).select(F.col("id").cast("int").alias("colour"))
    now = graph.spark.createDataFrame([(1,)], "ways bigint")
    placed: list[str] = []
    for i, node in enumerate(order):
        now = now.crossJoin(palette.withColumnRenamed("colour", f"c{i}"))
        for j, other in enumerate(order[:i]):
            if (min(node, other), max(node, other)) in edges and f"c{j}" in placed:
                now = now.where(F.col(f"c{i}") != F.col(f"c{j}"))
        placed.append(f"c{i}")
        # A node whose neighbours are all placed needs no colour any more.
        placed = [f"c{j}" for j, a in enumerate(order[: i + 1]) if f"c{j}" in placed and any((min(a, b), max(a, b)) in edges for b in order[i + 1 :])]
        now = materialise(now.groupBy(*placed).agg(F.sum("ways").cast("bigint").alias("ways")), "colours")
    return now.agg(F.coalesce(F.sum("ways"), F.lit(0)).cast("bigint").alias("n_colourings"))


@tidy
def chromatic_number(graph: Graph, most: int = 12) -> int:
    """The fewest colours of a proper colouring."""
    graph = graph.written()
    k = 0 if graph.nodes.isEmpty() else 1
    while k and colourings(graph, k, most).first()[0] == 0:
        k += 1
    return k


@tidy
def isomorphic(first: Graph, second: Graph, most: int = 9) -> bool:
    """Whether some renaming makes the graphs equal: embeddings of all edges of the first in the second, node by node."""
    first, second = first.written(), second.written()
    first.need(most=most)
    if first.directed != second.directed or first.nodes.count() != second.nodes.count() or first.edges.count() != second.edges.count():
        return False
    order = [r["id"] for r in first.nodes.orderBy("id").collect()]
    arcs = {(r["src"], r["dst"]) for r in first.arcs.collect()}
    there = materialise(second.arcs.select("src", "dst"), "there")
    now = None
    for i, node in enumerate(order):
        new = second.nodes.select(F.col("id").alias(f"n{i}"))
        now = new if now is None else now.crossJoin(new)
        for j in range(i):
            now = now.where(F.col(f"n{i}") != F.col(f"n{j}"))
            for a, b, x, y in ((node, order[j], i, j), (order[j], node, j, i)):
                now = now.join(there.toDF(f"n{x}", f"n{y}"), [f"n{x}", f"n{y}"], "left_semi" if (a, b) in arcs else "left_anti")
        now = materialise(now, "maps")
        if now.isEmpty():
            return False
    return now is None or not now.isEmpty()


@tidy
def rooted(graph: Graph, root: str) -> DataFrame:
    """``id``, ``parent``, ``depth`` of a tree; anything but a tree is refused."""
    graph = graph.written()
    graph.need(directed=False, nodes=(root,))
    n = graph.nodes.count()
    if graph.edges.count() != n - 1:
        raise Invalid("a tree has one edge less than nodes")
    seed = graph.spark.createDataFrame([(root, root, 0.0)], "origin string, id string, dist double")
    found = relax(graph, seed, "1D").select("id", F.col("via").alias("parent"), F.col("dist").cast("int").alias("depth"))
    if found.count() != n:
        raise Invalid("the graph is not connected")
    return found


@tidy
def ancestors(tree: DataFrame) -> DataFrame:
    """``id``, ``ancestor``, ``up``: all ancestors with their distance, itself included, by doubling jumps."""
    now = materialise(tree.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("up")).union(tree.where("parent is not null").select("id", "parent", F.lit(1))), "up")
    reach = 1
    deepest = int(tree.agg(F.max("depth")).first()[0] or 0)
    while reach < deepest:
        jump = now.toDF("ancestor", "above", "more")
        now = materialise(now.join(jump, "ancestor").select("id", F.col("above").alias("ancestor"), (F.col("up") + F.col("more")).alias("up")).distinct(), "up")
        reach *= 2
    return now


@tidy
def lowest_common_ancestors(graph: Graph, root: str, pairs: DataFrame | None = None) -> DataFrame:
    """``a``, ``b``, ``lca``, ``distance`` of ``pairs(a, b)``, by default of every pair a < b, as many as that is."""
    graph = graph.written()
    found = materialise(tours.tour(graph, graph.spark.createDataFrame([(root,)], "id string")), "tour")
    if pairs is None:
        pairs = graph.nodes.toDF("a").join(graph.nodes.toDF("b"), F.col("a") < F.col("b"))
    return tours.common_ancestors(found, pairs)


@tidy
def subtree_sizes(graph: Graph, root: str) -> DataFrame:
    """``id``, ``size``, ``depth``: nodes below and at each node."""
    return tours.tour(graph, graph.spark.createDataFrame([(root,)], "id string")).select("id", "size", F.col("depth").cast("int").alias("depth"))


@tidy
def tree_hash(graph: Graph, root: str) -> DataFrame:
    """``id``, ``shape``: bracket strings from the leaves up; equal strings are equal rooted shapes."""
    graph = graph.written()
    tree = materialise(rooted(graph, root), "tree")
    deepest = int(tree.agg(F.max("depth")).first()[0] or 0)
    done = tree.where(F.lit(False)).select("id", "parent", F.lit("").alias("shape"))
    for depth in range(deepest, -1, -1):
        below = done.groupBy("parent").agg(F.array_join(F.array_sort(F.collect_list("shape")), "").alias("inner"))
        level = tree.where(F.col("depth") == depth).select("id", "parent").join(below.withColumnRenamed("parent", "id"), "id", "left")
        done = materialise(done.unionByName(level.select("id", "parent", F.concat(F.lit("("), F.coalesce("inner", F.lit("")), F.lit(")")).alias("shape"))), "shapes")
    return done.select("id", "shape")


@tidy
def tree_path_maxima(graph: Graph, root: str, values: DataFrame) -> DataFrame:
    """``a``, ``b``, ``largest``: the largest of ``values(id, value)`` on the path between every pair a < b."""
    graph = graph.written()
    up = ancestors(rooted(graph, root))
    lca = lowest_common_ancestors(graph, root).select("a", "b", "lca")
    chain = up.select("id", "ancestor", "up")
    def side(end: str) -> DataFrame:
        on = lca.join(chain.toDF(end, "node", "u"), end).join(chain.toDF("node", "lca", "v"), ["node", "lca"])
        return on.select("a", "b", "node")
    return side("a").union(side("b")).join(values.toDF("node", "value"), "node").groupBy("a", "b").agg(F.max("value").alias("largest"))


@tidy
def two_sat(clauses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``variable``, ``value`` of an assignment that meets all clauses (v1, b1, v2, b2), and ``variable`` of those that cannot have a value.

    A clause says that v1 is b1 or v2 is b2.  Who misses one half must keep the
    other; variables whose two values force each other have none, and then no
    assignment is given.  Else each takes the value that is forced last.
    """
    def literal(v: str, b: str) -> F.Column:
        return F.concat(F.when(F.col(b).cast("boolean"), F.lit("+")).otherwise(F.lit("-")), F.col(v).cast("string"))

    def opposite(x: str) -> F.Column:
        return F.translate(F.substr(x, F.lit(1), F.lit(1)), "+-", "-+")

    flip = lambda x: F.concat(opposite(x), F.substr(x, F.lit(2)))
    pair = materialise(clauses.select(literal("v1", "b1").alias("x"), literal("v2", "b2").alias("y")).distinct(), "clauses")
    forced = pair.select(flip("x").alias("src"), F.col("y").alias("dst")).union(pair.select(flip("y"), F.col("x")))
    names = pair.select(F.explode(F.array("x", "y", flip("x"), flip("y"))).alias("id"))
    graph = Graph.of(forced, True, names).written()
    strong = materialise(strong_components(graph), "strong")
    by = strong.select(F.substr("id", F.lit(2)).alias("variable"), F.substr("id", F.lit(1), F.lit(1)).alias("sign"), "component")
    both = by.where("sign = '+'").select("variable", F.col("component").alias("yes")).join(by.where("sign = '-'").select("variable", F.col("component").alias("no")), "variable")
    clash = materialise(both.where("yes = no").select("variable"), "clash")
    if not clash.isEmpty():
        return clash.select("variable", F.lit(None).cast("boolean").alias("value")).limit(0), clash
    between = graph.edges.join(strong.toDF("src", "a"), "src").join(strong.toDF("dst", "b"), "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    layer = materialise(topological_layers(Graph.of(between, True, strong.select(F.col("component").alias("id")))), "layers")
    # Layers, and names within one, put all components in one order along the arcs.
    at = both.join(layer.toDF("yes", "ly"), "yes").join(layer.toDF("no", "ln"), "no")
    return at.select("variable", (F.col("ly") > F.col("ln")).alias("above"), (F.col("ly") == F.col("ln")).alias("level"), "yes", "no").select("variable", F.when(F.col("level"), F.col("yes") > F.col("no")).otherwise(F.col("above")).alias("value")), clash


@tidy
def stable_matching(preferences: DataFrame) -> DataFrame:
    """``proposer``, ``acceptor``: the proposers' best stable matching of ``preferences(side, who, rank, whom)``.

    In each round every free proposer asks the next on the list, and every
    acceptor keeps the best of all who ever asked; proposers with no one left
    stay alone.
    """
    own = materialise(preferences.where("side = 'proposer'").select(F.col("who").alias("p"), "rank", F.col("whom").alias("a")), "own")
    taste = preferences.where("side = 'acceptor'").select(F.col("who").alias("a"), F.col("whom").alias("p"), F.col("rank").alias("taste"))
    asked = materialise(own.select("p", F.lit(0).alias("turn")).distinct(), "asked")
    first = int(own.agg(F.min("rank")).first()[0] or 0)
    asked = materialise(asked.select("p", F.lit(first).alias("turn")), "asked")
    held = None
    for _ in range(own.count() + 1):
        asks = own.join(asked, "p").where("rank <= turn").join(taste, ["a", "p"])
        best = asks.groupBy("a").agg(F.min_by("p", "taste").alias("p"))
        held = materialise(best, "held")
        free = asked.join(held.select("p"), "p", "left_anti")
        last = own.groupBy("p").agg(F.max("rank").alias("end"))
        moved = free.join(last, "p").where("turn < end").select("p", (F.col("turn") + 1).alias("turn"))
        if moved.isEmpty():
            break
        asked = materialise(asked.join(moved.select("p"), "p", "left_anti").unionByName(moved), "asked")
    return held.select(F.col("p").alias("proposer"), F.col("a").alias("acceptor"))


@tidy
def dominators(graph: Graph, entry: str) -> DataFrame:
    """``id``, ``dominator``: every node that all routes from the entry to ``id`` pass; each node's loss is one scenario."""
    graph = graph.written()
    graph.need(directed=True, nodes=(entry,))
    reach = relax(graph, graph.spark.createDataFrame([("all", entry, 0.0)], "origin string, id string, dist double"), "1D").select("id")
    gone = reach.where(F.col("id") != entry).select(F.col("id").alias("gone"))
    tag = F.concat("gone", F.lit("\x00"))
    arcs = graph.arcs.join(reach.withColumnRenamed("id", "src"), "src", "left_semi").crossJoin(gone).where("src <> gone and dst <> gone").select(F.concat(tag, "src").alias("src"), F.concat(tag, "dst").alias("dst"), "w")
    nodes = gone.crossJoin(reach).where("id <> gone").select(F.concat(tag, "id").alias("id"))
    left = relax(Graph(nodes, arcs, True), gone.select("gone", F.concat(tag, F.lit(entry)).alias("id"), F.lit(0.0).alias("dist")).withColumnRenamed("gone", "origin"), "1D")
    still = left.select(F.col("origin").alias("dominator"), F.split("id", "\x00")[1].alias("id"))
    lost = gone.withColumnRenamed("gone", "dominator").crossJoin(reach).where("id <> dominator").join(still, ["dominator", "id"], "left_anti")
    return lost.select("id", "dominator").union(reach.where(F.col("id") != entry).select("id", F.lit(entry)))
