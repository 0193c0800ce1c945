"""Queries of searches, trees, files and seeded models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.model import Graph
from sparkweave.operators import chance as c
from sparkweave.operators import cohesion as co
from sparkweave.operators import search as s
from sparkweave.plans.catalogue import register
from sparkweave.plans.travel import hops_sql
from sparkweave.sources import files
from sparkweave.sources.tables import MARKETS, TRADE, TRADE_DAG, TRADE_TIES, TREE

_TRI = f"WITH {TRADE_TIES.sql()} SELECT x.src AS a, x.dst AS b, y.dst AS c FROM arcs x JOIN arcs y ON y.src = x.dst JOIN arcs z ON z.src = y.dst AND z.dst = x.src WHERE x.src <> x.dst AND y.src <> y.dst AND x.src <> y.dst"
register("subgraphmatch_triangles", _TRI)(lambda k, d: s.embeddings(TRADE_TIES.graph(k, d), [("a", "b"), ("b", "c"), ("c", "a")]))
register("hamiltonian_paths", f"WITH RECURSIVE {MARKETS.sql()}, w(here, path) AS (SELECT id, [id] FROM nodes UNION ALL SELECT a.dst, list_append(w.path, a.dst) FROM w JOIN arcs a ON a.src = w.here WHERE NOT list_contains(w.path, a.dst)) SELECT count(*) AS n_walks FROM w WHERE len(path) = (SELECT count(*) FROM nodes)")(lambda k, d: s.hamiltonian(MARKETS.graph(k, d)))
register("chromaticpolynomial_three", f"""WITH RECURSIVE {MARKETS.sql()}, o AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS b FROM nodes), m AS (SELECT range AS m FROM range(CAST(power(3, (SELECT count(*) FROM nodes)) AS BIGINT))),
bad AS (SELECT DISTINCT m FROM m CROSS JOIN edges e JOIN o x ON x.id = e.src JOIN o y ON y.id = e.dst WHERE (m // CAST(power(3, x.b) AS BIGINT)) % 3 = (m // CAST(power(3, y.b) AS BIGINT)) % 3)
SELECT CAST((SELECT count(*) FROM m) - (SELECT count(*) FROM bad) AS BIGINT) AS n_colourings""")(lambda k, d: s.colourings(MARKETS.graph(k, d), 3))
register("chromatic_number")(lambda k, d: k.createDataFrame([(s.chromatic_number(MARKETS.graph(k, d)),)], "chromatic_number int"))
register("isomorphism_self")(lambda k, d: (lambda g: k.createDataFrame([(s.isomorphic(g, g),)], "isomorphic boolean"))(_regions(k, d).written()))
register("lca_pairs", hops_sql(TREE) + """, up AS (SELECT n.id, h.id AS ancestor, CAST(h.d AS INT) AS up FROM nodes n JOIN hops h ON h.origin = n.id JOIN hops r ON r.origin = 'world' AND r.id = n.id JOIN hops q ON q.origin = 'world' AND q.id = h.id WHERE q.d + h.d = r.d)
SELECT x.id AS a, y.id AS b, arg_min(x.ancestor, x.up + y.up) AS lca, CAST(min(x.up + y.up) AS BIGINT) AS distance FROM up x JOIN up y ON x.ancestor = y.ancestor AND x.id < y.id GROUP BY x.id, y.id""")(lambda k, d: s.lowest_common_ancestors(TREE.graph(k, d), "world"))
register("eulertour_subtrees", hops_sql(TREE) + """, deep AS (SELECT id, d FROM hops WHERE origin = 'world')
SELECT n.id, count(*) AS size, CAST(x.d AS INTEGER) AS depth FROM nodes n JOIN deep x ON x.id = n.id JOIN hops h ON h.origin = n.id JOIN deep y ON y.id = h.id AND y.d = x.d + h.d GROUP BY n.id, x.d""")(lambda k, d: s.subtree_sizes(TREE.graph(k, d), "world"))
register("treehash_shapes")(lambda k, d: s.tree_hash(TREE.graph(k, d), "world"))
register("hld_pathmaxima")(lambda k, d: s.tree_path_maxima(TREE.graph(k, d), "world", TREE.graph(k, d).nodes.select("id", F.length("id").alias("value"))))
register("dominators_trade")(lambda k, d: (lambda g: s.dominators(g, g.nodes.agg(F.min("id")).first()[0]))(TRADE_DAG.graph(k, d)))


def _regions(spark: SparkSession, sf_dir: str) -> Graph:
    """The five regions of the market graph."""
    g = MARKETS.graph(spark, sf_dir)
    return g.induced(g.nodes.where("id rlike '^r[0-9]$'"))


@register("tsp_regions")
def _tour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions are made complete: those without a tie are as far as the sum of all ties."""
    g = _regions(spark, sf_dir)
    far = float(g.edges.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]) + 1
    pairs = g.nodes.toDF("src").crossJoin(g.nodes.toDF("dst")).where("src < dst").join(g.edges, ["src", "dst"], "left").select("src", "dst", F.coalesce("w", F.lit(far)).alias("w"))
    return s.shortest_tour(Graph.of(pairs))


register("toposortcount_regions")(lambda k, d: s.linear_extensions(Graph.of(_regions(k, d).edges, True)))


def _costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What serving each segment from each region costs: the customers there are, by region and segment."""
    nation, customer = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "customer"))
    seen = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").cast("string").alias("worker"), F.col("c_mktsegment").alias("job")).agg(F.count("*").cast("double").alias("cost"))
    full = nation.select(F.col("n_regionkey").cast("string").alias("worker")).distinct().crossJoin(customer.select(F.col("c_mktsegment").alias("job")).distinct())
    return full.join(seen, ["worker", "job"], "left").na.fill(0.0, ["cost"])


@register("stablematching_regions")
def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions like segments by their customers there, and segments like regions the same way."""
    from pyspark.sql import Window

    costs = _costs(spark, sf_dir)
    mine = F.row_number().over(Window.partitionBy("worker").orderBy(F.desc("cost"), "job"))
    theirs = F.row_number().over(Window.partitionBy("job").orderBy(F.desc("cost"), "worker"))
    a = costs.select(F.lit("proposer").alias("side"), F.col("worker").alias("who"), mine.alias("rank"), F.col("job").alias("whom"))
    return s.stable_matching(a.union(costs.select(F.lit("acceptor"), F.col("job"), theirs, F.col("worker"))))


@register("graphio_roundtrip")
def _text(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = TRADE.graph(spark, sf_dir)
    return files.read_edge_list(files.edge_lines(g)).edges.select("src", "dst", "w")


@register("labelpropagation_modularity")
def _modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = MARKETS.graph(spark, sf_dir)
    return spark.createDataFrame([(round(co.modularity(g, co.label_propagation(g)), 6),)], "modularity double")


register("percolation_trade")(lambda k, d: c.percolation(TRADE_TIES.graph(k, d), [0.0, 0.3, 1.0], trials=5))
register("randomwalk_shares")(lambda k, d: (lambda g: c.walk_shares(g, c.random_walks(g, g.nodes.agg(F.min("id")).first()[0], 20, 50)))(TRADE_TIES.graph(k, d).written()))
register("covertime_walks")(lambda k, d: (lambda g: c.cover_times(g, c.random_walks(g, "r0", 30, 20)))(MARKETS.graph(k, d).written()))
register("epidemic_trials")(lambda k, d: (lambda g: c.epidemic(g, g.nodes.agg(F.min("id")).first()[0], 0.3, 0.5, trials=5))(TRADE_TIES.graph(k, d)))
register("edgeswap_degrees", f"WITH {TRADE_TIES.sql()} SELECT src AS id, CAST(count(*) AS BIGINT) AS degree FROM arcs GROUP BY src")(lambda k, d: c.edge_swaps(TRADE_TIES.graph(k, d), 4).arcs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree")))
register("generators_sizes")(lambda k, d: k.createDataFrame([("erdos_renyi", c.erdos_renyi(k, 60, 0.1).edges.count()), ("watts_strogatz", c.watts_strogatz(k, 60, 4, 0.1).edges.count()), ("barabasi_albert", c.barabasi_albert(k, 60, 2).edges.count())], "model string, n_edges long"))
