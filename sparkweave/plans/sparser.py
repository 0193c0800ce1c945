"""Queries of feedback sets, spanners, widths, exchange cycles and eigenvectors that part a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.model import Graph
from sparkweave.operators import cohesion, krylov, paths, sparse, widths
from sparkweave.plans.catalogue import register, table
from sparkweave.sources.tables import CHAINS, PURCHASES, TRADE_DAG, Source

_RUN = "SELECT c_custkey AS k, c_nationkey AS n, c_mktsegment AS m, CAST(floor((row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) - 1) / 7e0) AS INT) AS q, (row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) - 1) % 7 AS r FROM {customer}"
#: Customers of one nation and segment in rings of up to seven, each the next one's source; the first also the third's.
RINGS = Source(True, ("customer",), f"""WITH c AS ({_RUN}), e AS (SELECT n, m, q, max(r) AS top FROM c GROUP BY n, m, q)
SELECT concat('c', CAST(x.k AS STRING)) AS src, concat('c', CAST(y.k AS STRING)) AS dst, 1e0 AS w FROM c x JOIN c y ON x.n = y.n AND x.m = y.m AND x.q = y.q JOIN e ON e.n = x.n AND e.m = x.m AND e.q = x.q
WHERE y.r = x.r + 1 OR (x.r = 0 AND y.r = 2) OR (x.r = e.top AND y.r = 0 AND e.top > 0)""")


def _broken(graph: Graph) -> DataFrame:
    """How many arcs there are and go, and whether what is left has layers."""
    graph = graph.written()
    gone = sparse.feedback_arcs(graph)
    rest = Graph(graph.nodes, graph.edges.join(gone.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", "w"), True)
    layers = paths.topological_layers(rest).agg((F.count("*") == graph.nodes.count()).alias("acyclic"))
    return graph.edges.agg(F.count("*").alias("n_arcs")).crossJoin(gone.agg(F.count("*").alias("n_feedback"))).crossJoin(layers)


#: All rings of a run pass its last arc, so one arc for each run of two or more is fewest.
register("feedbackarcset_rings", f"""WITH {RINGS.sql()}, run AS (SELECT n, m, q FROM ({_RUN.format(customer="customer")}) GROUP BY n, m, q HAVING count(*) > 1)
SELECT (SELECT count(*) FROM edges) AS n_arcs, (SELECT count(*) FROM run) AS n_feedback, TRUE AS acyclic""")(lambda s, d: _broken(RINGS.graph(s, d)))
register("feedbackarcset_dag", f"WITH {TRADE_DAG.sql()} SELECT count(*) AS n_arcs, CAST(0 AS BIGINT) AS n_feedback, TRUE AS acyclic FROM edges")(lambda s, d: _broken(TRADE_DAG.graph(s, d)))



#: A part of the chains has one cycle at most, so it gives up one node where it has as many edges as nodes.
@register("feedbackvertexset_chains", f"""WITH RECURSIVE {CHAINS.sql()}, reach(id, root) AS (SELECT id, id FROM nodes UNION SELECT a.dst, r.root FROM reach r JOIN arcs a ON a.src = r.id), part AS (SELECT id, min(root) AS p FROM reach GROUP BY id),
held AS (SELECT p, count(*) AS n FROM part GROUP BY p), tied AS (SELECT p, count(*) AS m FROM edges JOIN part ON part.id = src GROUP BY p)
SELECT held.p AS component, CAST(tied.m - held.n + 1 AS BIGINT) AS n_nodes, TRUE AS forest FROM held JOIN tied ON tied.p = held.p WHERE tied.m >= held.n""")
def _fewest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes each part with a cycle gives up, and whether nothing but a forest is left."""
    graph = CHAINS.graph(spark, sf_dir).written()
    gone = sparse.feedback_nodes(graph)
    forest = cohesion.cyclomatic(graph.without(gone)).select((F.col("cyclomatic") == 0).alias("forest"))
    return gone.join(cohesion.components(graph), "id").groupBy("component").agg(F.count("*").alias("n_nodes")).crossJoin(forest)


#: Clusters of the second round are the nodes that the digest keeps, and those that join one.
register("spanner_purchases", f"""WITH {PURCHASES.sql()}, bound AS (SELECT printf('%08x', CAST(floor(4294967296 * power(count(*), -0.5e0)) AS BIGINT)) AS b FROM nodes), kept AS (SELECT id FROM nodes, bound WHERE substr(md5(concat(id, '|1')), 1, 8) < b),
near AS (SELECT a.src AS v, a.dst AS u, a.w, least(a.src, a.dst) AS x, greatest(a.src, a.dst) AS y FROM arcs a), best AS (SELECT v, u, w, x, y FROM near WHERE v NOT IN (SELECT id FROM kept) AND u IN (SELECT id FROM kept) QUALIFY row_number() OVER (PARTITION BY v ORDER BY w, x, y) = 1),
own AS (SELECT n.* FROM near n LEFT JOIN best b ON b.v = n.v WHERE n.v NOT IN (SELECT id FROM kept) AND (b.v IS NULL OR (n.w, n.x, n.y) <= (b.w, b.x, b.y))),
home AS (SELECT id, id AS c FROM kept UNION ALL SELECT v, u FROM best), open AS (SELECT n.v, n.u, n.w, n.x, n.y, h.c FROM near n JOIN home g ON g.id = n.v JOIN home h ON h.id = n.u WHERE g.c <> h.c AND NOT EXISTS (SELECT 1 FROM own o WHERE o.x = n.x AND o.y = n.y)),
last AS (SELECT x, y, w FROM open QUALIFY row_number() OVER (PARTITION BY v, c ORDER BY w, x, y) = 1)
SELECT x AS src, y AS dst, w FROM own UNION SELECT x, y, w FROM last""")(lambda s, d: sparse.spanner(PURCHASES.graph(s, d), 2))

_CUSTOMERS = "SELECT c.c_custkey AS k, n.n_regionkey AS r FROM {customer} c JOIN {nation} n ON n.n_nationkey = c.c_nationkey"


def _parted(part: str) -> Source:
    """Customers tied to the five desks of their part, and the first desks of parts that follow each other tied."""
    return Source(False, ("customer", "nation"), f"""WITH c AS (SELECT k, {part} AS p FROM ({_CUSTOMERS})), parts AS (SELECT DISTINCT p FROM c), desk AS (SELECT DISTINCT k % 5 AS i FROM c)
SELECT concat('c', CAST(c.k AS STRING)) AS src, concat('d', CAST(c.p AS STRING), '-', CAST(desk.i AS STRING)) AS dst, 1e0 AS w FROM c CROSS JOIN desk
UNION ALL SELECT concat('d', CAST(x.p AS STRING), '-0'), concat('d', CAST(y.p AS STRING), '-0'), 1e0 FROM parts x JOIN parts y ON y.p = x.p + 1""")


REGIONS = _parted("r")
SIDES = _parted("CASE WHEN r < 2 THEN 0 ELSE 1 END")


def _smallest(source: Source, name: str) -> str:
    """Every node with the smallest one of its part: a customer's desk names the part, and so does a desk's own name."""
    return f"""WITH {source.sql()}, placed AS (SELECT id, CASE WHEN id LIKE 'd%' THEN split_part(id, '-', 1) ELSE (SELECT min(split_part(a.dst, '-', 1)) FROM arcs a WHERE a.src = nodes.id) END AS p FROM nodes)
SELECT id, min(id) OVER (PARTITION BY p) AS {name} FROM placed"""


register("spectralclustering_regions", _smallest(REGIONS, "cluster"))(lambda s, d: krylov.spectral_clusters(REGIONS.graph(s, d), 5))
register("leadingeigenvector_sides", f"SELECT id, side, TRUE AS worth FROM ({_smallest(SIDES, 'side')})")(lambda s, d: krylov.leading_eigenvector(SIDES.graph(s, d)).select("id", "side", "worth"))

#: Parts of the chains are trees, or have one cycle of three, which fills nothing, or of four, which fills one edge.
register("treewidth_chains", f"""WITH RECURSIVE {CHAINS.sql()}, reach(id, root) AS (SELECT id, id FROM nodes UNION SELECT a.dst, r.root FROM reach r JOIN arcs a ON a.src = r.id), part AS (SELECT id, min(root) AS p FROM reach GROUP BY id),
held AS (SELECT p, count(*) AS n FROM part GROUP BY p), tied AS (SELECT p, count(*) AS m FROM edges JOIN part ON part.id = src GROUP BY p), rings AS (SELECT count(*) AS c FROM held JOIN tied ON tied.p = held.p WHERE tied.m >= held.n),
triangles AS (SELECT count(*) AS c FROM edges x JOIN edges y ON y.src = x.dst JOIN edges z ON z.src = x.src AND z.dst = y.dst)
SELECT CAST(CASE WHEN rings.c > 0 THEN 2 ELSE 1 END AS BIGINT) AS width, CAST(CASE WHEN rings.c > 0 THEN 2 ELSE 1 END AS BIGINT) AS least, rings.c - triangles.c AS n_fill, TRUE AS exact FROM rings, triangles""")(lambda s, d: widths.treewidth(CHAINS.graph(s, d)))


#: Rates of one worth for each nation gain on no way round; one rate that is a hundredth too good gains.
@register("arbitrage_nations", "SELECT market, market = 'skewed' AS arbitrage FROM (VALUES ('fair'), ('skewed')) AS m(market)")
def _gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation's coin is worth what its customers have on average; the best rate of the smallest nation is once fair and once too good."""
    worth = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.avg(F.abs(F.col("c_acctbal").cast("double"))).alias("v")).where("v > 0")
    src, dst = worth.toDF("a", "va"), worth.toDF("b", "vb")
    rates = src.join(dst, F.col("a") != F.col("b")).select(F.col("a").cast("string").alias("src"), F.col("b").cast("string").alias("dst"), (F.col("vb") / F.col("va")).alias("rate"))
    odd = rates.agg(F.min(F.struct("src", "dst")).alias("o"))
    skewed = rates.crossJoin(F.broadcast(odd)).select("src", "dst", F.when(F.struct("src", "dst") == F.col("o"), F.col("rate") * 1.01).otherwise(F.col("rate")).alias("rate"))
    both = [paths.arbitrage(r).select(F.lit(m).alias("market"), "arbitrage") for m, r in (("fair", rates), ("skewed", skewed))]
    return both[0].unionByName(both[1])
