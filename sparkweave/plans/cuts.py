"""Queries of cut trees, shifts, path widths and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.operators import chance, cuttrees, exact, shifts, widths
from sparkweave.plans.catalogue import register
from sparkweave.plans.rounds import HIERARCHY
from sparkweave.sources.tables import CHAINS, MARKETS, SEGMENTS, TRADE_TIES, Source

#: The tree's answers are held against the lightest of all sides.
register("gomoryhu_tree", f"WITH {MARKETS.sql()} SELECT * FROM ({exact.pair_cuts.sql()}) AS result")(lambda s, d: cuttrees.pair_cuts(cuttrees.cut_tree(MARKETS.graph(s, d))[0]).select("a", "b", F.round("min_cut", 6).alias("min_cut")))


@register("stoerwagner_sides", f"WITH {MARKETS.sql()} SELECT min_cut AS weight, min_cut AS crossing, TRUE AS parted FROM ({exact.global_min_cut.sql()}) AS result")
def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the lightest cut weighs, what leaves its side, and whether both sides have nodes."""
    graph = MARKETS.graph(spark, sf_dir).written()
    row, side = cuttrees.lightest_cut(graph)
    sizes = graph.nodes.agg(F.count("*").alias("n"))
    return row.crossJoin(sizes).select(F.round("weight", 6).alias("weight"), F.round("crossing", 6).alias("crossing"), ((F.col("n_side") > 0) & (F.col("n_side") < F.col("n"))).alias("parted"))


def _shifts(name: str, source: Source) -> None:
    """On two sides, or a tree, the busiest node alone says how many shifts there are."""
    register(name, f"""WITH {source.sql()}, d AS (SELECT src, count(*) AS k FROM arcs GROUP BY src)
SELECT (SELECT count(*) FROM edges) AS n_edges, max(k) AS n_shifts, max(k) AS busiest, TRUE AS proper FROM d""")(lambda s, d: shifts.schedule(source.graph(s, d)))


_shifts("edgecoloring_segments", SEGMENTS)
_shifts("edgecoloring_hierarchy", HIERARCHY)

#: A width is enough where all nodes are reached by sets that leave no more of them live.
register("pathwidth_exact", f"""WITH RECURSIVE {MARKETS.sql()}, o AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS b FROM nodes), near AS (SELECT x.b, CAST(sum(1 << y.b) AS BIGINT) AS m FROM (SELECT DISTINCT src, dst FROM arcs WHERE src <> dst) a JOIN o x ON x.id = a.src JOIN o y ON y.id = a.dst GROUP BY x.b),
total AS (SELECT (1 << count(*)) - 1 AS whole, count(*) AS n FROM o), sets AS (SELECT unnest(range(0, whole + 1)) AS s FROM total),
live AS (SELECT s, count(*) FILTER (WHERE (s >> near.b) & 1 = 1 AND (near.m & (total.whole - s)) <> 0) AS k FROM sets CROSS JOIN near CROSS JOIN total GROUP BY s),
reach(k, s) AS (SELECT unnest(range(0, n)), CAST(0 AS BIGINT) FROM total UNION SELECT r.k, l.s FROM reach r JOIN o ON (r.s >> o.b) & 1 = 0 JOIN live l ON l.s = r.s + (1 << o.b) AND l.k <= r.k)
SELECT CAST(min(k) AS BIGINT) AS width FROM reach JOIN total ON s = whole""")(lambda s, d: widths.exact_pathwidth(MARKETS.graph(s, d)))

#: Parts of the chains are trees, or have one cycle of three or four.
register("pathwidth_chains", f"""WITH RECURSIVE {CHAINS.sql()}, reach(id, root) AS (SELECT id, id FROM nodes UNION SELECT a.dst, r.root FROM reach r JOIN arcs a ON a.src = r.id), part AS (SELECT id, min(root) AS p FROM reach GROUP BY id),
held AS (SELECT p, count(*) AS n FROM part GROUP BY p), tied AS (SELECT p, count(*) AS m FROM edges JOIN part ON part.id = src GROUP BY p), rings AS (SELECT count(*) AS c FROM held JOIN tied ON tied.p = held.p WHERE tied.m >= held.n)
SELECT CAST(CASE WHEN c > 0 THEN 2 ELSE 1 END AS BIGINT) AS width, CAST(CASE WHEN c > 0 THEN 2 ELSE 1 END AS BIGINT) AS least, TRUE AS exact FROM rings""")(lambda s, d: widths.pathwidth(CHAINS.graph(s, d)))

#: The world, the other regions, and nations and customers near the first one.
@register("sampling_snowball", f"""WITH RECURSIVE {HIERARCHY.sql()}, ball(id, h) AS (SELECT 'r0', 0 UNION SELECT a.dst, h + 1 FROM ball JOIN arcs a ON a.src = ball.id WHERE h < 2), kept AS (SELECT DISTINCT id FROM ball), d AS (SELECT src AS id, count(*) AS k FROM arcs GROUP BY src)
SELECT (SELECT count(*) FROM kept) AS n_sampled, (SELECT count(*) FROM edges WHERE src IN (SELECT id FROM kept) AND dst IN (SELECT id FROM kept)) AS n_edges,
(SELECT round(avg(k), 6) FROM d WHERE id IN (SELECT id FROM kept)) AS mean_sampled, (SELECT round(avg(k), 6) FROM d) AS mean_all""")
def _ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything within two steps of the first region, and how much busier it is than the rest."""
    graph = HIERARCHY.graph(spark, sf_dir).written()
    found = chance.degree_bias(graph, chance.snowball(graph, "r0", 2))
    return found.select("n_sampled", "n_edges", F.round("mean_sampled", 6).alias("mean_sampled"), F.round("mean_all", 6).alias("mean_all"))


#: Drawn at random, so there is no SQL; tests hold the model against shuffles of cliques.
register("nullmodel_ties")(lambda s, d: chance.null_model(TRADE_TIES.graph(s, d)))
