"""Bridges, cut nodes, blocks and second trees from the cycles that a rooted forest closes.

Components of few edges are answered for within a task, many of them in one
call.  Of others blocks follow from a tour of a spanning forest
(``tours.blocks_of``); a forest edge on no cycle is a bridge.  A basis of cycles lists the cycles themselves,
along a breadth-first forest, so that they are short.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.model import Graph
from sparkweave.operators.cohesion import components, spanning_forest
from sparkweave.operators.tours import blocks_of, common_ancestors, tour
from sparkweave.session import materialise, share_code, tidy

#: Components of more edges are left to tables; a call of a task gets about so many edges of smaller ones.
SMALL, CALL = 1_000, 50_000


def rooted(edges: DataFrame, component: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``id, parent`` of a breadth-first forest along ``edges(src, dst)``, and ``id, step``: the forest edges from the root to ``id``.

    A forest edge is named by its lower end.  Roots are the nodes that name
    their component.  The steps are as many as nodes times the forest's depth.
    """
    arcs = materialise(edges.select("src", "dst").union(edges.select("dst", "src")), "arcs")
    level = component.where("id = component").select("id")
    seen, way = level, None
    parents = edges.sparkSession.createDataFrame([], "id string, parent string")
    ways = edges.sparkSession.createDataFrame([], "id string, step string")
    while True:
        met = arcs.join(level.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        new = materialise(met.join(seen, "id", "left_anti"), "level")
        if new.isEmpty():
            return parents, ways
        own = new.select("id", F.col("id").alias("step"))
        if way is not None:
            own = own.union(new.join(way.toDF("parent", "step"), "parent").select("id", "step"))
        way = materialise(own, "ways")
        parents, ways, level = parents.union(new.select("id", "parent")), ways.union(way), new.select("id")
        seen = seen.union(level)


def _tree(parents: DataFrame) -> DataFrame:
    return parents.select(F.least("id", "parent").alias("src"), F.greatest("id", "parent").alias("dst"), F.col("id").alias("step"))


def covers(others: DataFrame, ways: DataFrame) -> DataFrame:
    """``src, dst, step``: the forest edges between the ends of each edge of ``others``."""
    ends = others.select("src", "dst", F.explode(F.array("src", "dst")).alias("id"))
    return ends.join(ways, "id").groupBy("src", "dst", "step").agg(F.count("*").alias("n")).where("n = 1").select("src", "dst", "step")


@tidy
def _parted(graph: Graph) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``call``, ``src``, ``dst``, ``w``: edges of components of at most ``SMALL``, a component in one call; the edges of all others; and their ``id``, ``component``. Loops are left out."""
    share_code(graph.spark)
    edges = graph.edges.where("src <> dst").select("src", "dst", "w")
    n = edges.count()
    named = graph.nodes.select("id", F.col("id").alias("component")).limit(0)
    if n <= SMALL:
        return edges.select(F.lit(0).cast("bigint").alias("call"), "src", "dst", "w"), edges.limit(0), named
    found = materialise(components(graph), "components")
    edges = materialise(edges.join(found.withColumnRenamed("id", "src"), "src"), "parted")
    large = materialise(edges.groupBy("component").count().where(F.col("count") > SMALL).select("component"), "large")
    rest = edges.limit(0)
    if not large.isEmpty():
        rest, edges = materialise(edges.join(large, "component"), "rest"), edges.join(large, "component", "left_anti")
        named = materialise(found.join(large, "component").select("id", "component"), "named")
    return edges.select(F.pmod(F.xxhash64("component"), F.lit(n // CALL + 1)).alias("call"), "src", "dst", "w"), rest.select("src", "dst", "w"), named


def _biconnected(ends: list[tuple[int, int]], n: int) -> list[int]:
    """Of each edge between ``n`` nodes the first edge of its block, by one depth-first search."""
    near: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for e, (a, b) in enumerate(ends):
        near[a].append((b, e))
        near[b].append((a, e))
    entered, low, block, open_edges, clock = [0] * n, [0] * n, [-1] * len(ends), [], 0
    for root in range(n):
        if entered[root]:
            continue
        clock += 1
        entered[root] = low[root] = clock
        way = [(root, -1, iter(near[root]))]
        while way:
            v, via, others = way[-1]
            for w, e in others:
                if not entered[w]:
                    clock += 1
                    entered[w] = low[w] = clock
                    open_edges.append(e)
                    way.append((w, e, iter(near[w])))
                    break
                if e != via and entered[w] < entered[v]:
                    open_edges.append(e)
                    low[v] = min(low[v], entered[w])
            else:
                way.pop()
                if way:
                    u = way[-1][0]
                    low[u] = min(low[u], low[v])
                    if low[v] >= entered[u]:
                        at = len(open_edges) - 1
                        while open_edges[at] != via:
                            at -= 1
                        own = open_edges[at:]
                        del open_edges[at:]
                        first = min(own)
                        for e in own:
                            block[e] = first
    return block


def _numbered(part: pd.DataFrame) -> tuple[list[tuple[int, int]], int]:
    """The ends of a call's edges as numbers, and of how many nodes."""
    codes, names = pd.factorize(pd.concat([part["src"], part["dst"]]))
    return list(zip(codes[: len(part)].tolist(), codes[len(part) :].tolist(), strict=True)), len(names)


@tidy
def blocks(graph: Graph) -> DataFrame:
    """``src``, ``dst``, ``block``: each edge's block, named by its smallest edge as ``src|dst``; loops are in none."""
    graph = graph.need(directed=False).written()
    small, rest, named = _parted(graph)

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["src", "dst"], ignore_index=True)
        first = part.loc[_biconnected(*_numbered(part)), ["src", "dst"]].reset_index(drop=True)
        return pd.DataFrame({"src": part["src"], "dst": part["dst"], "block": first["src"] + "|" + first["dst"]})

    found = small.groupBy("call").applyInPandas(solve, "src string, dst string, block string")
    if named.isEmpty():
        return found
    placed, _ = blocks_of(Graph(named.select("id"), rest, False, True), named)
    least = placed.groupBy("at").agg(F.min(F.struct("src", "dst")).alias("f")).select("at", F.concat("f.src", F.lit("|"), "f.dst").alias("block"))
    return found.unionByName(placed.join(least, "at").select("src", "dst", "block"))


@tidy
def bridges(graph: Graph) -> DataFrame:
    """``src``, ``dst``: edges whose loss parts their ends, the blocks of one edge."""
    graph = graph.written()
    placed = materialise(blocks(graph), "blocks")
    return placed.join(placed.groupBy("block").count().where("count = 1"), "block").select("src", "dst")


@tidy
def two_edge_components(graph: Graph) -> DataFrame:
    """``id``, ``component`` after all bridges are taken away."""
    graph = graph.written()
    rest = graph.edges.join(bridges(graph), ["src", "dst"], "left_anti")
    return components(Graph(graph.nodes, rest.select("src", "dst", "w"), False))


def _nodes_of(placed: DataFrame) -> DataFrame:
    return placed.select(F.explode(F.array("src", "dst")).alias("id"), "block").distinct()


@tidy
def cut_nodes(graph: Graph) -> DataFrame:
    """``id``: nodes in two blocks or more; their loss parts their component."""
    graph = graph.written()
    return _nodes_of(blocks(graph)).groupBy("id").count().where("count > 1").select("id")


@tidy
def block_cut_tree(graph: Graph) -> DataFrame:
    """``block``, ``id``: the cut nodes of each block."""
    graph = graph.written()
    inside = materialise(_nodes_of(blocks(graph)), "inside")
    return inside.join(inside.groupBy("id").count().where("count > 1").select("id"), "id").select("block", "id")


@tidy
def cycle_basis(graph: Graph) -> DataFrame:
    """``cycle``, ``src``, ``dst``: a fundamental cycle for each edge outside a breadth-first forest, named by that edge."""
    graph = graph.written()
    graph.need(directed=False)
    edges = graph.edges.where("src <> dst").select("src", "dst")
    parents, ways = rooted(edges, materialise(components(graph), "components"))
    tree = materialise(_tree(parents), "tree")
    others = materialise(edges.join(tree, ["src", "dst"], "left_anti"), "others")
    cycle = F.concat("src", F.lit("|"), "dst").alias("cycle")
    way = covers(others, ways).select(cycle, "step").join(tree, "step").select("cycle", "src", "dst")
    return way.union(others.select(cycle, "src", "dst"))


def _swaps(ends: list[tuple[int, int]], w: list[float], n: int) -> tuple[float, float | None]:
    """The weight of the least spanning forest of edges between ``n`` nodes, and by how much the cheapest swap of one edge for another adds to it.

    Edges come in the order of their weights. The heaviest forest edge between
    two nodes is the one that joined their parts; it is found along parts that
    hang below larger ones, each by the edge that joined them.
    """
    up, size, by = list(range(n)), [1] * n, [0.0] * n
    total, gain = 0.0, None

    def tops(x: int) -> list[int]:
        way = [x]
        while up[way[-1]] != way[-1]:
            way.append(up[way[-1]])
        return way

    for (a, b), own in zip(ends, w, strict=True):
        left, right = tops(a), tops(b)
        if left[-1] != right[-1]:
            x, y = sorted((left[-1], right[-1]), key=lambda r: size[r])
            up[x], by[x] = y, own
            size[y] += size[x]
            total += own
        else:
            both = set(left) & set(right)
            more = own - max(by[x] for x in (*left, *right) if x not in both)
            gain = more if gain is None else min(gain, more)
    return total, gain


@tidy
def second_tree(graph: Graph) -> DataFrame:
    """``first``, ``second``: total weights of the least spanning forest and of the next one; null where there is one forest only.

    The next forest swaps one edge: an edge outside against the heaviest forest
    edge between its ends, which in large components jumps that double find.
    """
    graph = graph.need(directed=False).written()
    small, rest, named = _parted(graph)

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("w", ignore_index=True)
        ends, n = _numbered(part)
        return pd.DataFrame([_swaps(ends, part["w"].tolist(), n)], columns=["first", "gain"], dtype="float64")

    found = small.groupBy("call").applyInPandas(solve, "first double, gain double").select("first", F.nanvl("gain", F.lit(None).cast("double")).alias("gain"))
    if not named.isEmpty():
        found = found.unionByName(_swaps_by_tour(Graph(named.select("id"), rest, False, True), named))
    both = found.agg(F.coalesce(F.sum("first"), F.lit(0.0)).alias("first"), F.min("gain").alias("gain"))
    return both.select(F.round("first", 6).alias("first"), F.round(F.col("first") + F.col("gain"), 6).alias("second"))


def _swaps_by_tour(graph: Graph, named: DataFrame) -> DataFrame:
    """``first``, ``gain``: what ``_swaps`` gives, by tables; ``named`` is the table of ``components``."""
    least = materialise(spanning_forest(graph).select("src", "dst", "w"), "forest")
    found = materialise(tour(Graph(graph.nodes, least, False, True), named=named), "tour")
    upper = found.where("parent is not null").select("id", F.least("id", "parent").alias("src"), F.greatest("id", "parent").alias("dst")).join(least, ["src", "dst"]).select("id", F.col("w").alias("value"))
    others = materialise(graph.edges.join(least, ["src", "dst"], "left_anti").select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("w").alias("own")), "others")
    most = common_ancestors(found, others, upper).select("a", "b", "largest")
    gain = others.join(most, ["a", "b"]).agg(F.min(F.col("own") - F.col("largest")).alias("gain"))
    return least.agg(F.sum("w").alias("first")).crossJoin(gain)
