"""Queries of routes towards a goal, networks with floors, separating nodes, and trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkweave.errors import Invalid
from sparkweave.model import Graph
from sparkweave.operators import goals as g
from sparkweave.operators import trees as t
from sparkweave.operators.flows import maximum_flow
from sparkweave.operators.paths import bfs, distances
from sparkweave.plans.catalogue import register
from sparkweave.plans.communities import _BELOW, _ends
from sparkweave.plans.cycles import _BITS, _SIDES
from sparkweave.plans.travel import _AT, _MIN, relax_sql
from sparkweave.sources.tables import MARKETS, TRADE, TRADE_DAG, TRADE_TIES, TREE


def _arrives(steps: DataFrame, graph: Graph) -> DataFrame:
    """``id`` and ``dist`` at the end of a route, and whether every step is an arc of the graph that costs what the route says."""
    place = Window.orderBy("step")
    pairs = steps.select(F.lag("id").over(place).alias("src"), F.col("id").alias("dst"), (F.col("dist") - F.lag("dist").over(place)).alias("cost"))
    real = pairs.where("src is not null").join(graph.arcs, ["src", "dst"], "left").agg(F.coalesce(F.min(F.coalesce(F.abs(F.col("w") - F.col("cost")) < 1e-6, F.lit(False))), F.lit(True)).alias("sound"))
    return steps.orderBy(F.desc("step")).limit(1).select("id", "dist").crossJoin(real)


_TO_LAST = " SELECT id, d AS dist, TRUE AS sound FROM done WHERE id = (SELECT max(id) FROM nodes)"


@register("astar_trade", relax_sql(TRADE, _AT.format(0), *_MIN) + _TO_LAST)
def _astar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hops left to the goal, each as cheap as the cheapest arc, never exceed what is left."""
    graph = TRADE.graph(spark, sf_dir)
    first, last = _ends(graph)
    least = graph.edges.agg(F.min("w")).first()[0]
    left = bfs(graph.reverse, last).select("id", (F.col("hops") * F.lit(least)).alias("h"))
    return _arrives(g.towards(graph, first, last, left), graph)


register("bidijkstra_ties", relax_sql(TRADE_TIES, _AT.format(0), *_MIN) + _TO_LAST)(lambda s, d: (lambda graph: _arrives(g.from_both_ends(graph, *_ends(graph)), graph))(TRADE_TIES.graph(s, d)))

_FIRST = f"WITH RECURSIVE {TRADE_DAG.sql()}, root AS (SELECT src AS id FROM edges ORDER BY CAST(src AS INT) LIMIT 1)"


def _from_root(graph: Graph) -> tuple[str, DataFrame]:
    """The start of smallest number and what it reaches."""
    root = graph.edges.orderBy(F.col("src").cast("int")).first()["src"]
    return root, distances(graph, root)


@register("pathexplain_dag", f"""{_FIRST}, walk(id, c) AS (SELECT id, 0e0 FROM root UNION ALL SELECT e.dst, walk.c + e.w FROM walk JOIN edges e ON e.src = walk.id),
o AS (SELECT c, row_number() OVER (ORDER BY c) AS r FROM walk WHERE id = (SELECT id FROM walk ORDER BY CAST(id AS INT) DESC LIMIT 1))
SELECT min(c) AS dist, coalesce(min(CASE WHEN r = 2 THEN c END), CAST('Infinity' AS DOUBLE)) AS runner_up FROM o""")
def _explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest route to the greatest number and the next one, which avoids some edge of it."""
    graph = TRADE_DAG.graph(spark, sf_dir)
    root, reached = _from_root(graph)
    last = reached.orderBy(F.col("id").cast("int").desc()).first()["id"]
    return g.explain(graph, root, last).agg(F.max("total").alias("dist"), (F.max("total") + F.min("slack")).alias("runner_up"))


register("arborescence_dag", f"""{_FIRST}, reach(id) AS (SELECT id FROM root UNION SELECT e.dst FROM reach JOIN edges e ON e.src = reach.id)
SELECT src, dst, w FROM edges WHERE src IN (SELECT id FROM reach) QUALIFY row_number() OVER (PARTITION BY dst ORDER BY w, src) = 1""")(
    lambda s, d: (lambda graph: (lambda root, reached: t.arborescence(graph.induced(reached), root))(*_from_root(graph)))(TRADE_DAG.graph(s, d))
)


@register("flowdecomposition_markets", f"{_SIDES} SELECT round(v, 6) AS value, TRUE AS sound FROM best")
def _routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = maximum_flow(MARKETS.graph(spark, sf_dir), "r0", "r1")[0]
    ways = g.flow_routes(sent, "r0", "r1")
    steps = ways.select("flow", F.explode(F.arrays_zip(F.expr("slice(way, 1, size(way) - 1)").alias("src"), F.expr("slice(way, 2, size(way) - 1)").alias("dst"))).alias("e"))
    used = steps.groupBy("e.src", "e.dst").agg(F.sum("flow").alias("used")).join(sent, ["src", "dst"], "left")
    within = used.agg(F.coalesce(F.min(F.coalesce(F.col("used") <= F.col("flow") + 1e-6, F.lit(False))), F.lit(True)).alias("sound"))
    return ways.agg(F.round(F.coalesce(F.sum("flow"), F.lit(0.0)), 6).alias("value")).crossJoin(within)


#: Regions in a ring: trade with the next carries a floor of nine tenths, trade with the one after it none.
_RING = """SELECT CAST(x AS STRING) AS src, CAST(y AS STRING) AS dst, CASE WHEN (y - x + 5) % 5 = 1 THEN 0.9e0 * w ELSE 0e0 END AS floor, w AS capacity FROM (
SELECT a.n_regionkey AS x, b.n_regionkey AS y, CAST(count(*) AS DOUBLE) AS w FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {supplier} s ON l.l_suppkey = s.s_suppkey
JOIN {nation} a ON a.n_nationkey = c.c_nationkey JOIN {nation} b ON b.n_nationkey = s.s_nationkey WHERE (b.n_regionkey - a.n_regionkey + 5) % 5 IN (1, 2) GROUP BY 1, 2) AS trade"""
_RING_TABLES = ("lineitem", "orders", "customer", "supplier", "nation")


#: By Hoffman a circulation exists if no set of nodes must let out more than can come in.
@register("circulation_regions", f"""WITH ring AS ({_RING.format(**{n: n for n in _RING_TABLES})}), masks AS (SELECT range AS m FROM range(32)),
sides AS (SELECT m, sum(CASE WHEN (m >> CAST(src AS INT)) & 1 = 1 AND (m >> CAST(dst AS INT)) & 1 = 0 THEN floor ELSE 0 END) AS leaving, sum(CASE WHEN (m >> CAST(src AS INT)) & 1 = 0 AND (m >> CAST(dst AS INT)) & 1 = 1 THEN capacity ELSE 0 END) AS entering FROM masks CROSS JOIN ring GROUP BY m)
SELECT bool_and(leaving <= entering + 1e-6) AS feasible, bool_and(leaving <= entering + 1e-6) AS sound FROM sides""")
def _circulates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a circulation exists, and whether the one found keeps its bounds and leaves what enters."""
    arcs = spark.sql(_RING, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in _RING_TABLES})
    try:
        found = g.circulation(arcs)
    except Invalid:
        return spark.createDataFrame([(False, False)], "feasible boolean, sound boolean")
    bounds = found.join(arcs, ["src", "dst"]).agg(F.min(F.col("flow").between(F.col("floor") - 1e-6, F.col("capacity") + 1e-6)).alias("within"))
    net = found.select(F.col("src").alias("id"), F.col("flow").alias("x")).union(found.select("dst", -F.col("flow"))).groupBy("id").agg(F.sum("x").alias("x")).agg(F.min(F.abs("x") < 1e-6).alias("even"))
    return bounds.crossJoin(net).select(F.lit(True).alias("feasible"), (F.col("within") & F.col("even")).alias("sound"))


#: Segments have ties with regions only, so the first two are no neighbours.
_PAIR = f"""WITH RECURSIVE {MARKETS.sql()}, {_BITS}, pair AS (SELECT min(id) AS a, (SELECT id FROM nodes WHERE NOT regexp_matches(id, '^r[0-9]$') ORDER BY id LIMIT 1 OFFSET 1) AS b FROM nodes WHERE NOT regexp_matches(id, '^r[0-9]$')),
bits AS (SELECT x.b AS a, y.b AS b FROM pair JOIN o x ON x.id = pair.a JOIN o y ON y.id = pair.b),
hit(m, id) AS (SELECT m, pair.a FROM masks CROSS JOIN pair CROSS JOIN bits WHERE (m >> bits.a) & 1 = 0 AND (m >> bits.b) & 1 = 0 UNION SELECT hit.m, e.dst FROM hit JOIN arcs e ON e.src = hit.id JOIN o ON o.id = e.dst WHERE (hit.m >> o.b) & 1 = 0),
small AS (SELECT min(bit_count(m)) AS size FROM (SELECT m FROM hit CROSS JOIN pair GROUP BY m, pair.b HAVING NOT bool_or(id = pair.b)) AS parted),
cuts AS (SELECT m, sum(CASE WHEN (m >> x.b) & 1 = 1 AND (m >> y.b) & 1 = 0 THEN 1 ELSE 0 END) AS n FROM masks CROSS JOIN bits JOIN arcs e ON TRUE JOIN o x ON x.id = e.src JOIN o y ON y.id = e.dst WHERE (m >> bits.a) & 1 = 1 AND (m >> bits.b) & 1 = 0 GROUP BY m)"""


def _two(graph: Graph) -> list[str]:
    return [r["id"] for r in graph.nodes.where("not id rlike '^r[0-9]$'").orderBy("id").limit(2).collect()]


@register("vertexseparator_markets", f"{_PAIR} SELECT CAST(size AS BIGINT) AS size, TRUE AS parted FROM small")
def _parted(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = MARKETS.graph(spark, sf_dir)
    a, b = _two(graph)
    found = g.separator(graph, a, b)
    reached = bfs(graph.without(found), a)
    return found.agg(F.count("*").alias("size")).crossJoin(reached.agg((F.count(F.when(F.col("id") == b, 1)) == 0).alias("parted")))


register("menger_markets", f"{_PAIR} SELECT CAST((SELECT min(n) FROM cuts) AS INTEGER) AS edge_disjoint, CAST(size AS INTEGER) AS node_disjoint FROM small")(
    lambda s, d: (lambda graph: g.disjoint_routes(graph, *_two(graph)))(MARKETS.graph(s, d))
)
register("scenario_removals", f"""WITH RECURSIVE {TREE.sql()}, reach(gone, origin, id) AS (SELECT n.id, x.id, x.id FROM nodes n JOIN nodes x ON x.id <> n.id UNION SELECT r.gone, r.origin, a.dst FROM reach r JOIN arcs a ON a.src = r.id WHERE a.dst <> r.gone),
low AS (SELECT gone, origin, min(id) AS low FROM reach GROUP BY gone, origin) SELECT gone AS id, CAST(1 AS BIGINT) AS before, count(DISTINCT low) AS after FROM low GROUP BY gone""")(lambda s, d: g.without_each(TREE.graph(s, d)))

#: The definition: the smallest leaf goes, and its neighbour is written down.
register("prufer_tree", f"""WITH RECURSIVE {TREE.sql()}, walk(k, gone, code) AS (SELECT 0, CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]) UNION ALL
SELECT k + 1, list_append(gone, min(id)), list_append(code, arg_min(near, id)) FROM (SELECT walk.k, walk.gone, walk.code, a.src AS id, min(a.dst) AS near FROM walk JOIN arcs a ON NOT list_contains(walk.gone, a.src) AND NOT list_contains(walk.gone, a.dst) WHERE walk.k < (SELECT count(*) FROM nodes) - 2 GROUP BY walk.k, walk.gone, walk.code, a.src HAVING count(*) = 1) AS leaf GROUP BY k, gone, code)
SELECT CAST(i.range AS INTEGER) AS position, code[i.range] AS id FROM (SELECT code FROM walk ORDER BY k DESC LIMIT 1) AS done JOIN range(1, 1000) i ON i.range <= len(code)""")(lambda s, d: t.prufer_code(TREE.graph(s, d)))
#: A centroid of a tree whose inner nodes all have two or more leaves is its root.
register("centroid_tree", f"WITH RECURSIVE {TREE.sql()}, down(id, up, depth) AS (SELECT 'world', CAST(NULL AS STRING), 0 UNION ALL SELECT a.dst, d.id, d.depth + 1 FROM down d JOIN arcs a ON a.src = d.id WHERE a.dst IS DISTINCT FROM d.up) SELECT id, depth AS level FROM down")(lambda s, d: t.centroid_levels(TREE.graph(s, d)))
#: In a tree the edges that part terminals join them.
register("steiner_nations", f"""{_BELOW}, ends AS (SELECT id FROM nodes WHERE regexp_matches(id, '^n[0-9]+$') AND CAST(substr(id, 2) AS INT) % 4 = 1),
held AS (SELECT d.id, d.up, count(ends.id) AS c FROM under u JOIN down d ON d.id = u.id LEFT JOIN ends ON ends.id = u.low WHERE d.up IS NOT NULL GROUP BY d.id, d.up)
SELECT e.src, e.dst, e.w FROM held JOIN edges e ON e.src = least(held.id, held.up) AND e.dst = greatest(held.id, held.up) WHERE c > 0 AND c < (SELECT count(*) FROM ends)""")(
    lambda s, d: (lambda graph: t.steiner_tree(graph, graph.nodes.where("id rlike '^n[0-9]+$' and cast(substr(id, 2) as int) % 4 = 1")))(TREE.graph(s, d))
)

#: The queue of the definition, node by node: neighbours not yet placed follow by degree and name.
_QUEUE = f"""WITH RECURSIVE {TRADE_TIES.sql()}, deg AS (SELECT n.id, count(a.dst) AS d FROM nodes n LEFT JOIN arcs a ON a.src = n.id AND a.dst <> n.id GROUP BY n.id), every AS (SELECT list(id ORDER BY d, id) AS l FROM deg),
near AS (SELECT a.src AS id, list(a.dst ORDER BY deg.d, a.dst) AS l FROM arcs a JOIN deg ON deg.id = a.dst GROUP BY a.src),
walk(k, ord) AS (SELECT 0, every.l[1:1] FROM every UNION ALL SELECT CASE WHEN walk.k < len(walk.ord) THEN walk.k + 1 ELSE walk.k END, list_concat(walk.ord, CASE WHEN walk.k < len(walk.ord) THEN list_filter(coalesce(near.l, CAST([] AS VARCHAR[])), lambda x: NOT list_contains(walk.ord, x)) ELSE list_filter(every.l, lambda x: NOT list_contains(walk.ord, x))[1:1] END)
  FROM walk CROSS JOIN every LEFT JOIN near ON near.id = walk.ord[walk.k + 1] WHERE walk.k < len(every.l)),
placed AS (SELECT ord[i.range] AS id, i.range - 1 AS position FROM (SELECT ord FROM walk ORDER BY k DESC, len(ord) DESC LIMIT 1) AS w JOIN range(1, 1000) i ON i.range <= len(ord))"""
register("cuthillmckee_ties", f"{_QUEUE} SELECT id, position FROM placed")(lambda s, d: t.level_order(TRADE_TIES.graph(s, d)))
register("bandwidth_ties", f"{_QUEUE} SELECT max(abs(x.position - y.position)) AS bandwidth FROM edges e JOIN placed x ON x.id = e.src JOIN placed y ON y.id = e.dst")(
    lambda s, d: (lambda graph: t.bandwidth(graph, t.level_order(graph)))(TRADE_TIES.graph(s, d))
)
_GAIN = "len(list_filter(h.l, lambda x: NOT list_contains(w.cov, x)))"
register("dominatingset_greedy", f"""WITH RECURSIVE {TREE.sql()}, near AS (SELECT src, dst FROM arcs UNION SELECT id, id FROM nodes), whole AS (SELECT src, list(dst) AS l FROM near GROUP BY src),
walk(k, cov, chosen) AS (SELECT 0, CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]) UNION ALL SELECT k + 1, list_concat(cov, l), list_append(chosen, src) FROM (SELECT w.k, w.cov, w.chosen, h.src, h.l, {_GAIN} AS gain, row_number() OVER (ORDER BY {_GAIN} DESC, h.src) AS r FROM walk w CROSS JOIN whole h) AS tried WHERE r = 1 AND gain > 0)
SELECT unnest(chosen) AS id FROM (SELECT chosen FROM walk ORDER BY k DESC LIMIT 1) AS done""")(lambda s, d: t.dominating_set(TREE.graph(s, d)))
