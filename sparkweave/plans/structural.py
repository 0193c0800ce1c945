"""Queries of structural readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.operators import structure as s
from sparkweave.operators.transforms import shared_hubs
from sparkweave.plans.catalogue import declare, register, table
from sparkweave.sources.tables import MARKETS, PURCHASES, TRADE, TRADE_TIES, TREE, USERS

_TIES = """WITH purchases AS (
  SELECT DISTINCT CAST(o.o_custkey AS BIGINT) AS customer, CAST(l.l_suppkey AS BIGINT) AS supplier
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
degrees AS (SELECT customer, count(*) AS k FROM purchases GROUP BY customer)
SELECT a.supplier AS a, b.supplier AS b, round(sum(1.0 / (d.k - 1)), 6) AS w
FROM purchases a JOIN purchases b ON a.customer = b.customer AND a.supplier < b.supplier
JOIN degrees d ON d.customer = a.customer
GROUP BY a.supplier, b.supplier ORDER BY w DESC, a, b LIMIT 10"""


@register("bipartiteprojection_ties", _TIES)
def _ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-ten report: the feature is the limit."""
    lineitem, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    purchases = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("customer"), F.col("l_suppkey").alias("supplier")).distinct()
    pairs = shared_hubs(purchases.toDF("hub", "item"))
    return pairs.select("a", "b", F.round("weight", 6).alias("w")).orderBy(F.desc("w"), "a", "b").limit(10)


register("assortativity_purchases", f"WITH {PURCHASES.sql()} SELECT * FROM ({s.assortativity.sql()}) AS result")(lambda k, d: s.degree_correlation(PURCHASES.graph(k, d)))
for name, operator, source in (
    ("graph_degrees", s.degrees, PURCHASES),
    ("graph_degrees_directed", s.degrees, USERS),
    ("degreedistribution_histogram", s.degree_histogram, PURCHASES),
    ("assortativity_directed", s.assortativity, USERS),
    ("entropy_readings", s.entropy, PURCHASES),
    ("triangles_nodes", s.triangles, TRADE_TIES),
    ("triangles_clustering", s.clustering, TRADE_TIES),
    ("cyclecount_counts", s.cycle_count, TRADE_TIES),
    ("graphlets_orbits", s.graphlets, TRADE_TIES),
    ("richclub_levels", s.rich_club, TRADE_TIES),
    ("coreperiphery_prefixes", s.core_periphery, TRADE_TIES),
    ("neighborhood_constraint", s.constraint, TRADE_TIES),
    ("linkprediction_scores", s.link_prediction, TRADE_TIES),
    ("centralization_degree", s.degree_centralization, PURCHASES),
    ("quadcensus_shapes", s.quad_census, TRADE_TIES),
    ("triadcensus_classes", s.triad_census, TRADE),
    ("splitgraph_identity", s.split_graph, MARKETS),
    ("graphsummary_size", s.summary, PURCHASES),
    ("graphsummary_tree", s.summary, TREE),
):
    declare(name, operator, source)
declare("degreedistribution_stats", s.degree_stats, PURCHASES, kmin=1)
declare("graphstats_tail", s.degree_stats, USERS, kmin=20)
