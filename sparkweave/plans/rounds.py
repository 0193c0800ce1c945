"""Queries of tours, trails, maximal cliques, flows by pushes, and flows and assignments by prices.

Networks of stock are stated so that their answers have a closed form: what a
year leaves over goes to later years only, and what is moved along a line of
regions is the sum of what is missing up to each border.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.model import Graph
from sparkweave.operators import cliques, networks, search, tours, trails
from sparkweave.operators.flows import maximum_flow
from sparkweave.plans.catalogue import register, table
from sparkweave.plans.searches import _costs
from sparkweave.sources.tables import CHAINS, TRADE_TIES, Source

#: The world, its regions, their nations, and the customers of those.
HIERARCHY = Source(False, ("region", "nation", "customer"), """SELECT 'world' AS src, concat('r', CAST(r_regionkey AS STRING)) AS dst, 1.0e0 AS w FROM {region}
UNION ALL SELECT concat('r', CAST(n_regionkey AS STRING)), concat('n', CAST(n_nationkey AS STRING)), 1.0e0 FROM {nation}
UNION ALL SELECT concat('n', CAST(c_nationkey AS STRING)), concat('c', CAST(c_custkey AS STRING)), 1.0e0 FROM {customer}""")

#: Every node with the names on its way from the world, and every pair of a node and one above it.
_WAYS = f"""WITH RECURSIVE {HIERARCHY.sql()}, way(id, up, names, d) AS (SELECT 'world', CAST(NULL AS STRING), [CAST('' AS STRING)], 0 UNION ALL SELECT a.dst, w.id, list_append(w.names, a.dst), w.d + 1 FROM way w JOIN arcs a ON a.src = w.id WHERE a.dst IS DISTINCT FROM w.up),
above AS (SELECT id, CASE WHEN u = '' THEN 'world' ELSE u END AS top FROM (SELECT id, unnest(names) AS u FROM way)), sizes AS (SELECT top AS id, count(*) AS n FROM above GROUP BY top)"""

#: Who is entered k-th at depth d has seen 2 k - d - 1 ticks, and as many again as nodes below when left.
register("dfs_hierarchy", f"""{_WAYS}, numbered AS (SELECT w.id, w.up, w.d, s.n, row_number() OVER (ORDER BY w.names) AS k FROM way w JOIN sizes s ON s.id = w.id)
SELECT id, up AS parent, 2 * k - d - 1 AS discover, 2 * k - d - 2 + 2 * n AS finish, k AS preorder, k + n - 1 - d AS postorder FROM numbered""")(lambda s, d: tours.depth_first(HIERARCHY.graph(s, d), "world"))


@register("eulertour_balances", f"""{_WAYS}, held AS (SELECT concat('c', CAST(c_custkey AS STRING)) AS id, CAST(c_acctbal AS DOUBLE) AS v FROM customer)
SELECT a.top AS id, round(sum(coalesce(h.v, 0e0)), 2) AS total, max(coalesce(h.v, 0e0)) AS largest FROM above a LEFT JOIN held h ON h.id = a.id GROUP BY a.top""")
def _balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_acctbal").cast("double").alias("value"))
    return tours.subtree_values(HIERARCHY.graph(spark, sf_dir), "world", held).select("id", F.round("total", 2).alias("total"), "largest")


register("hld_chains", f"""{_WAYS}, heavy AS (SELECT up, id FROM (SELECT w.up, w.id, row_number() OVER (PARTITION BY w.up ORDER BY s.n DESC, w.id) AS r FROM way w JOIN sizes s ON s.id = w.id WHERE w.up IS NOT NULL) WHERE r = 1),
chain(id, head, position) AS (SELECT w.id, w.id, 0 FROM way w WHERE w.id NOT IN (SELECT id FROM heavy) UNION ALL SELECT h.id, c.head, c.position + 1 FROM chain c JOIN heavy h ON h.up = c.id)
SELECT id, head, CAST(position AS BIGINT) AS position, count(*) OVER (PARTITION BY head) AS length FROM chain""")(lambda s, d: tours.heavy_paths(HIERARCHY.graph(s, d), "world"))


@register("lca_neighbours", f"""{_WAYS}, pair AS (SELECT concat('c', CAST(x.c_custkey AS STRING)) AS a, concat('c', CAST(y.c_custkey AS STRING)) AS b FROM customer x JOIN customer y ON y.c_custkey = x.c_custkey + 1)
SELECT p.a, p.b, arg_max(x.top, w.d) AS lca, CAST(max(wa.d) + max(wb.d) - 2 * max(w.d) AS BIGINT) AS distance FROM pair p JOIN above x ON x.id = p.a JOIN above y ON y.id = p.b AND y.top = x.top JOIN way w ON w.id = x.top JOIN way wa ON wa.id = p.a JOIN way wb ON wb.id = p.b GROUP BY p.a, p.b""")
def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose keys follow each other."""
    key = table(spark, sf_dir, "customer").select("c_custkey")
    after = key.select((F.col("c_custkey") - 1).alias("c_custkey"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("b"))
    return search.lowest_common_ancestors(HIERARCHY.graph(spark, sf_dir), "world", key.join(after, "c_custkey").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("a"), "b"))


def _acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every day the steps from a user to the user who acts next, the days' users apart."""
    return spark.sql("""SELECT id, src, dst FROM (SELECT event_id AS id, concat(CAST(CAST(ts AS DATE) AS STRING), '|', CAST(user_id AS STRING)) AS src,
concat(CAST(CAST(ts AS DATE) AS STRING), '|', CAST(lead(user_id) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS STRING)) AS dst FROM {events}) WHERE dst IS NOT NULL""", events=table(spark, sf_dir, "events"))


def _walked(found: DataFrame, arcs: DataFrame, directed: bool) -> DataFrame:
    """``day``, ``n_arcs``, ``sound``: whether each day's trail takes every arc once, and every step begins where the one before ends."""
    after = found.select("component", (F.col("position") + 1).alias("position"), F.col("dst").alias("at"))
    same = (F.col("src") == F.col("s")) & (F.col("dst") == F.col("d"))
    turned = (F.col("src") == F.col("d")) & (F.col("dst") == F.col("s"))
    steps = found.join(after, ["component", "position"], "left").join(arcs.toDF("id", "s", "d"), "id")
    fits = (same if directed else same | turned) & ((F.col("position") == 1) | (F.coalesce("at", F.lit("")) == F.col("src")))
    return steps.groupBy(F.substr("component", F.lit(1), F.lit(10)).alias("day")).agg(F.count("*").alias("n_arcs"), (F.min(fits) & (F.count_distinct("id") == F.count("*")) & (F.max("position") == F.count("*"))).alias("sound"))


#: The events of a day are a trail themselves, so one is there.
_DAYS = "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) - 1 AS n_arcs, TRUE AS sound FROM events WHERE ts IS NOT NULL GROUP BY 1 HAVING count(*) > 1"
register("eulerdirected_days", _DAYS)(lambda s, d: (lambda a: _walked(trails.directed_trails(a), a, True))(_acts(s, d)))
register("eulerian_days", _DAYS)(lambda s, d: (lambda a: _walked(trails.undirected_trails(a), a, False))(_acts(s, d)))


def _listed(found: DataFrame) -> DataFrame:
    return found.select(F.array_join("members", ",").alias("members"), "size")


def _cliques_sql(source: Source) -> str:
    """Cliques grown by greater names; those that no node can join are maximal."""
    return f"""WITH RECURSIVE {source.sql()}, near AS (SELECT src, list(dst) AS l FROM arcs WHERE src <> dst GROUP BY src),
c(m, rest) AS (SELECT [n.id], list_filter(coalesce(near.l, CAST([] AS VARCHAR[])), lambda x: x > n.id) FROM nodes n LEFT JOIN near ON near.src = n.id
  UNION ALL SELECT list_append(c.m, x.x), list_filter(c.rest, lambda y: y > x.x AND list_contains(near.l, y)) FROM c, unnest(c.rest) AS x(x) JOIN near ON near.src = x.x)
SELECT array_to_string(m, ',') AS members, CAST(len(m) AS INTEGER) AS size FROM c LEFT JOIN near ON near.src = m[1] WHERE NOT EXISTS (SELECT 1 FROM near a WHERE len(list_intersect(a.l, c.m)) = len(c.m))"""


register("bronkerbosch_cliques", _cliques_sql(TRADE_TIES))(lambda s, d: _listed(cliques.maximal_cliques(TRADE_TIES.graph(s, d))))
register("bronkerbosch_chains", f"""WITH {CHAINS.sql()}, tri AS (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM edges x JOIN edges y ON y.src = x.dst JOIN edges z ON z.src = x.src AND z.dst = y.dst)
SELECT concat(a, ',', b, ',', c) AS members, 3 AS size FROM tri UNION ALL SELECT concat(e.src, ',', e.dst), 2 FROM edges e WHERE NOT EXISTS (SELECT 1 FROM tri t WHERE (e.src, e.dst) IN ((t.a, t.b), (t.b, t.c), (t.a, t.c)))""")(lambda s, d: _listed(cliques.maximal_cliques(CHAINS.graph(s, d))))

_STOCK = """SELECT l_suppkey AS s, year(l_shipdate) AS y, CAST(count(CASE WHEN month(l_shipdate) <= 6 THEN 1 END) AS DOUBLE) AS came, CAST(count(CASE WHEN month(l_shipdate) > 6 THEN 1 END) AS DOUBLE) AS asked FROM {lineitem} GROUP BY l_suppkey, year(l_shipdate)"""


def _stock(spark: SparkSession, sf_dir: str) -> Graph:
    """A supplier's lines of a year's first half can serve those of its second half and of all later years."""
    years = spark.sql(f"SELECT s, y, came, asked, lead(y) OVER (PARTITION BY s ORDER BY y) AS later, sum(came) OVER (PARTITION BY s) AS whole FROM ({_STOCK})", lineitem=table(spark, sf_dir, "lineitem"))
    at = F.concat(F.col("s").cast("string"), F.lit("|"), F.col("y").cast("string"))
    rows = years.select(F.lit("from").alias("src"), at.alias("dst"), F.col("came").alias("w")).union(years.select(at, F.lit("to"), "asked"))
    return Graph.of(rows.union(years.where("later is not null").select(at, F.concat(F.col("s").cast("string"), F.lit("|"), F.col("later").cast("string")), "whole")), True)


@register("pushrelabel_stock", f"""WITH years AS ({_STOCK.format(lineitem="lineitem")}), runs AS (SELECT s, y, sum(came) OVER w AS a, sum(asked) OVER w AS b FROM years WINDOW w AS (PARTITION BY s ORDER BY y)),
served AS (SELECT s, max(b) - greatest(0e0, max(b - a)) AS v FROM runs GROUP BY s) SELECT sum(v) AS value, sum(v) AS cut, TRUE AS sound FROM served""")
def _served(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can be served, what the arcs of a cut can carry, and whether the flow keeps its bounds and loses nothing on the way."""
    graph = _stock(spark, sf_dir).written()
    sent, side = maximum_flow(graph, "from", "to")
    across = graph.edges.join(side.toDF("src"), "src", "left_semi").join(side.toDF("dst"), "dst", "left_anti").agg(F.sum("w").alias("cut"))
    within = sent.join(graph.edges, ["src", "dst"], "left").agg(F.min(F.col("flow") <= F.col("w") + 1e-6).alias("within"))
    net = sent.select(F.col("src").alias("id"), F.col("flow").alias("x")).union(sent.select("dst", -F.col("flow"))).groupBy("id").agg(F.sum("x").alias("x"))
    ends = net.agg(F.max(F.when(F.col("id") == "from", F.col("x"))).alias("value"), F.max(F.when(~F.col("id").isin("from", "to"), F.abs("x"))).alias("lost"))
    return ends.crossJoin(across).crossJoin(within).select("value", "cut", (F.col("within") & (F.col("lost") < 1e-6)).alias("sound"))


_LINE = """SELECT x.r, CAST(count(CASE WHEN x.sold THEN 1 END) AS DOUBLE) AS came, CAST(count(CASE WHEN NOT x.sold THEN 1 END) AS DOUBLE) AS asked FROM (
SELECT n.n_regionkey AS r, TRUE AS sold FROM {lineitem} l JOIN {supplier} s ON s.s_suppkey = l.l_suppkey JOIN {nation} n ON n.n_nationkey = s.s_nationkey
UNION ALL SELECT n.n_regionkey, FALSE FROM {lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey JOIN {customer} c ON c.c_custkey = o.o_custkey JOIN {nation} n ON n.n_nationkey = c.c_nationkey) x GROUP BY x.r"""
_LINE_TABLES = ("lineitem", "orders", "customer", "supplier", "nation")


@register("mincostflow_regions", f"""WITH line AS ({_LINE.format(**{t: t for t in _LINE_TABLES})}), gap AS (SELECT r, sum(came - asked) OVER (ORDER BY r) AS g FROM line)
SELECT (SELECT sum(came) FROM line) AS sent, sum(abs(g)) AS cost, TRUE AS tight FROM gap""")
def _moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines go from the regions of their suppliers to those of their buyers over neighbouring regions, each border at a cost of 1."""
    line = spark.sql(_LINE, **{t: table(spark, sf_dir, t) for t in _LINE_TABLES})
    at, whole = F.concat(F.lit("r"), F.col("r").cast("string")), F.lit(1e12)
    after = line.select((F.col("r") - 1).alias("r"), F.concat(F.lit("r"), F.col("r").cast("string")).alias("b")).join(line.select("r", at.alias("a")), "r")
    free, one = F.lit(0.0), F.lit(1.0)
    arcs = line.select(F.lit("from").alias("src"), at.alias("dst"), F.col("came").alias("capacity"), free.alias("cost")).union(line.select(at, F.lit("to"), "asked", free)).union(after.select("a", "b", whole, one)).union(after.select("b", "a", whole, one))
    found = networks.minimum_cost_flow(arcs, "from", "to", unit=1.0)
    return found.agg(F.sum(F.when(F.col("src") == "from", F.col("flow"))).alias("sent"), F.sum(F.col("flow") * F.col("cost")).alias("cost"), F.min("tight").alias("tight"))


@register("hungarian_regions", """WITH RECURSIVE seen AS (SELECT n.n_regionkey AS w, c.c_mktsegment AS j, CAST(count(*) AS DOUBLE) AS c FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY 1, 2),
w AS (SELECT w, row_number() OVER (ORDER BY w) AS i FROM (SELECT DISTINCT n_regionkey AS w FROM nation)), j AS (SELECT j, row_number() OVER (ORDER BY j) - 1 AS b FROM (SELECT DISTINCT c_mktsegment AS j FROM customer)),
walk(i, m, t) AS (SELECT 0, 0, 0e0 UNION ALL SELECT walk.i + 1, walk.m | (1 << CAST(j.b AS INT)), walk.t + coalesce(s.c, 0e0) FROM walk JOIN w ON w.i = walk.i + 1 CROSS JOIN j LEFT JOIN seen s ON s.w = w.w AND s.j = j.j WHERE (walk.m >> CAST(j.b AS INT)) & 1 = 0)
SELECT min(t) AS cost, (SELECT count(*) FROM w) AS n_pairs, TRUE AS tight FROM walk WHERE i = (SELECT count(*) FROM w)""")
def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return networks.assignment(_costs(spark, sf_dir), unit=1.0).agg(F.sum("cost").alias("cost"), F.count("*").alias("n_pairs"), F.min("tight").alias("tight"))


#: The even keys meet all clauses.
@register("twosat_nations", """SELECT TRUE AS satisfied, count(*) AS n_variables FROM (SELECT DISTINCT c_nationkey FROM customer)""")
def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of customers: of two with consecutive keys at least one is in, and of two whose keys differ by three not both."""
    key = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).distinct()
    near = lambda gap, b: key.select(F.col("k").alias("v1")).join(key.select((F.col("k") - gap).alias("v1"), F.col("k").alias("v2")), "v1").select("v1", F.lit(b).alias("b1"), "v2", F.lit(b).alias("b2"))
    own = key.select(F.col("k").alias("v1"), F.lit(True).alias("b1"), F.col("k").alias("v2"), F.lit(False).alias("b2"))
    clauses = near(1, True).union(near(3, False)).union(own).select(F.col("v1").cast("string").alias("v1"), "b1", F.col("v2").cast("string").alias("v2"), "b2")
    value, _ = search.two_sat(clauses)
    v1, v2 = value.toDF("v1", "x1"), value.toDF("v2", "x2")
    met = clauses.join(v1, "v1", "left").join(v2, "v2", "left").agg(F.coalesce(F.min((F.col("x1") == F.col("b1")) | (F.col("x2") == F.col("b2"))), F.lit(False)).alias("satisfied"))
    return met.crossJoin(value.agg(F.count("*").alias("n_variables")))
