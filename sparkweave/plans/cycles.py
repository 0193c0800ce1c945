"""Queries of blocks, spectra and solves by component, flows, matchings, colourings and graph classes.

The SQL goes back to definitions: an edge is in a cycle if its ends stay
connected without it; spectra are held against traces and closed forms.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.operators import blocks as b
from sparkweave.operators import classes as k
from sparkweave.operators import flows as f
from sparkweave.operators import matrices as m
from sparkweave.operators.cohesion import components
from sparkweave.plans.catalogue import register
from sparkweave.plans.loops import _OFF, _SPREAD
from sparkweave.sources.tables import CHAINS, MARKETS, SEGMENTS, TRADE_DAG, TRADE_TIES, TREE

_RINGS = f"WITH RECURSIVE {CHAINS.sql()}{_OFF}{_SPREAD}, name AS (SELECT id, min(component) AS component FROM low GROUP BY id)"
#: The one cycle of a component, if any, is the block of its edges.
_BLOCKS = f"""{_RINGS}, first AS (SELECT n.component, min(row(r.src, r.dst)) AS e FROM ring r JOIN name n ON n.id = r.src GROUP BY n.component),
block AS (SELECT e.src, e.dst, CASE WHEN r.src IS NULL THEN e.src || '|' || e.dst ELSE f.e[1] || '|' || f.e[2] END AS block
  FROM edges e JOIN name n ON n.id = e.src LEFT JOIN ring r ON r.src = e.src AND r.dst = e.dst LEFT JOIN first f ON f.component = n.component)"""
_CUT = "past(g, id) AS (SELECT src, min(dst) FROM arcs GROUP BY src UNION SELECT p.g, a.dst FROM past p JOIN arcs a ON a.src = p.id WHERE a.dst <> p.g), cut AS (SELECT DISTINCT a.src AS id FROM arcs a LEFT JOIN past p ON p.g = a.src AND p.id = a.dst WHERE p.g IS NULL)"

register("articulation_bridges", f"{_RINGS} SELECT src, dst FROM edges e WHERE NOT EXISTS (SELECT 1 FROM ring r WHERE r.src = e.src AND r.dst = e.dst)")(lambda s, d: b.bridges(CHAINS.graph(s, d)))
register("articulation_cuts", f"WITH RECURSIVE {CHAINS.sql()}, {_CUT} SELECT id FROM cut")(lambda s, d: b.cut_nodes(CHAINS.graph(s, d)))
register("biconnected_blocks", f"{_BLOCKS} SELECT src, dst, block FROM block")(lambda s, d: b.blocks(CHAINS.graph(s, d)))
register("biconnected_tree", f"{_BLOCKS}, {_CUT} SELECT DISTINCT k.block, c.id FROM block k JOIN cut c ON c.id IN (k.src, k.dst)")(lambda s, d: b.block_cut_tree(CHAINS.graph(s, d)))
register("biconnected_ties", f"WITH RECURSIVE {TRADE_TIES.sql()}, {_CUT} SELECT id FROM cut")(lambda s, d: b.cut_nodes(TRADE_TIES.graph(s, d)))
register("cyclebasis_edges", f"{_RINGS} SELECT src, dst FROM ring")(lambda s, d: b.cycle_basis(CHAINS.graph(s, d)).select("src", "dst"))

_SIZES = "deg AS (SELECT src AS id, CAST(count(*) AS DOUBLE) AS d FROM arcs GROUP BY src), size AS (SELECT n.component, CAST(count(*) AS DOUBLE) AS n, sum(g.d) / 2 AS m, sum(g.d * g.d) AS sq FROM name n JOIN deg g ON g.id = n.id GROUP BY n.component), ringed AS (SELECT n.component, count(*) AS len FROM ring r JOIN name n ON n.id = r.src GROUP BY n.component)"


@register("laplacianspectrum_moments", f"{_RINGS}, {_SIZES} SELECT component, round(2 * m, 6) AS trace, round(sq + 2 * m, 6) AS squares, CAST(1 AS BIGINT) AS zeros FROM size")
def _moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("value")
    return m.laplacian_spectrum(CHAINS.graph(spark, sf_dir)).groupBy("component").agg(F.round(F.sum(x), 6).alias("trace"), F.round(F.sum(x * x), 6).alias("squares"), F.count(F.when(x < 1e-8, 1)).alias("zeros"))


def _paths(rows: DataFrame, graph_rows: DataFrame) -> DataFrame:
    """Components without a cycle: paths."""
    tree = graph_rows.groupBy("component").agg(F.max("n_trees").alias("t")).where("t = 1").select("component")
    return rows.join(tree, "component")


register("laplacianspectrum_paths", f"{_RINGS}, {_SIZES}, p AS (SELECT component, n FROM size WHERE m = n - 1) SELECT component, CAST(i.range AS INTEGER) AS k, round(2 - 2 * cos(pi() * i.range / n), 6) AS value FROM p JOIN range(5) i ON i.range < n")(
    lambda s, d: (lambda g: _paths(m.laplacian_spectrum(g), m.tree_counts(g)).select("component", "k", (F.round("value", 6) + 0.0).alias("value")))(CHAINS.graph(s, d))
)
register("graphenergy_paths", f"{_RINGS}, {_SIZES} SELECT component, round(sum(abs(2 * cos(pi() * i.range / (n + 1)))), 6) AS energy, round(max(2 * cos(pi() * i.range / (n + 1))), 6) AS radius FROM size JOIN range(1, 6) i ON i.range <= n WHERE m = n - 1 GROUP BY component")(
    lambda s, d: (lambda g: _paths(m.energy(g), m.tree_counts(g)).select("component", F.round("energy", 6).alias("energy"), F.round("radius", 6).alias("radius")))(CHAINS.graph(s, d))
)
register("graphenergy_walks", f"{_RINGS}, {_SIZES} SELECT s.component, round(2 * m, 6) AS walks2, CASE WHEN r.len = 3 THEN 6e0 ELSE 0e0 END AS walks3 FROM size s LEFT JOIN ringed r ON r.component = s.component")(
    lambda s, d: m.energy(CHAINS.graph(s, d)).select("component", F.round("walks2", 6).alias("walks2"), F.abs(F.round("walks3", 6)).alias("walks3"))
)
register("kirchhoff_chains", f"{_RINGS}, {_SIZES} SELECT s.component, CAST(coalesce(r.len, 1) AS DOUBLE) AS n_trees FROM size s LEFT JOIN ringed r ON r.component = s.component")(lambda s, d: m.tree_counts(CHAINS.graph(s, d)))
register("resistance_edges", f"""{_RINGS}, whole AS (SELECT n.component, sum(1 / e.w) AS s FROM ring r JOIN edges e ON e.src = r.src AND e.dst = r.dst JOIN name n ON n.id = r.src GROUP BY n.component)
SELECT e.src, e.dst, round(CASE WHEN r.src IS NULL THEN 1 / e.w ELSE (1 / e.w) * (t.s - 1 / e.w) / t.s END, 6) AS resistance FROM edges e JOIN name n ON n.id = e.src LEFT JOIN ring r ON r.src = e.src AND r.dst = e.dst LEFT JOIN whole t ON t.component = n.component""")(
    lambda s, d: m.resistances(CHAINS.graph(s, d)).select("src", "dst", F.round("resistance", 6).alias("resistance"))
)
register("commutetime_edges", f"""{_RINGS}, {_SIZES} SELECT e.src AS a, e.dst AS b, round(2 * z.m * CASE WHEN r.src IS NULL THEN 1e0 ELSE (g.len - 1) / CAST(g.len AS DOUBLE) END, 6) AS commute
FROM edges e JOIN name n ON n.id = e.src JOIN size z ON z.component = n.component LEFT JOIN ring r ON r.src = e.src AND r.dst = e.dst LEFT JOIN ringed g ON g.component = n.component""")(
    lambda s, d: (lambda g: m.commute_times(g).join(g.edges.toDF("a", "b", "w"), ["a", "b"], "left_semi").select("a", "b", F.round("commute", 6).alias("commute")))(CHAINS.graph(s, d))
)


@register("symmetriceigen_residuals", f"{_RINGS} SELECT component, CAST(count(*) AS BIGINT) AS n_values, 0e0 AS residual, CAST(count(*) AS DOUBLE) AS lengths FROM name GROUP BY component")
def _residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far A x is from the value times x, summed over a component, and the squared lengths of its vectors."""
    g = CHAINS.graph(spark, sf_dir)
    pairs = m.eigenpairs(g)
    image = pairs.join(g.arcs.select(F.col("src").alias("id"), F.col("dst").alias("to"), "w"), "id").groupBy("component", "k", F.col("to").alias("id")).agg(F.sum(F.col("w") * F.col("x")).alias("y"))
    both = pairs.join(image, ["component", "k", "id"])
    return both.groupBy("component").agg(F.countDistinct("k").alias("n_values"), F.round(F.sum(F.abs(F.col("y") - F.col("value") * F.col("x"))), 6).alias("residual"), F.round(F.sum(F.col("x") * F.col("x")), 6).alias("lengths"))


#: The Fiedler vector of a path changes its sign in the middle, where an odd path has a zero.
register("spectral_sides", f"{_RINGS}, {_SIZES} SELECT component, round(2 - 2 * cos(pi() / n), 6) AS connectivity, CAST(floor(n / 2) AS BIGINT) AS smaller FROM size WHERE m = n - 1")(
    lambda s, d: (lambda g: _paths(m.fiedler_sides(g), m.tree_counts(g)).groupBy("component").agg(F.round(F.max("connectivity"), 6).alias("connectivity"), F.least(F.sum("side"), F.count("*") - F.sum("side")).alias("smaller")))(CHAINS.graph(s, d))
)

_BITS = "o AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS b FROM nodes), masks AS (SELECT range AS m FROM range(CAST(power(2, (SELECT count(*) FROM nodes)) AS BIGINT)))"
_SIDES = f"WITH {MARKETS.sql()}, {_BITS}, ends AS (SELECT (SELECT b FROM o WHERE id = 'r0') AS s, (SELECT b FROM o WHERE id = 'r1') AS t), cuts AS (SELECT m, sum(e.w) AS v, bit_count(m) AS n FROM masks CROSS JOIN ends JOIN arcs e ON TRUE JOIN o x ON x.id = e.src JOIN o y ON y.id = e.dst WHERE (m >> s) & 1 = 1 AND (m >> t) & 1 = 0 AND (m >> x.b) & 1 = 1 AND (m >> y.b) & 1 = 0 GROUP BY m), best AS (SELECT arg_min(m, row(v, n)) AS m, min(v) AS v FROM cuts)"
register("mincut_edges", f"{_SIDES} SELECT e.src, e.dst, e.w FROM arcs e JOIN o x ON x.id = e.src JOIN o y ON y.id = e.dst CROSS JOIN best WHERE (m >> x.b) & 1 = 1 AND (m >> y.b) & 1 = 0")(lambda s, d: f.minimum_cut(MARKETS.graph(s, d), "r0", "r1"))


@register("edmondskarp_flow", f"{_SIDES} SELECT round(v, 6) AS value, TRUE AS conserved, TRUE AS within FROM best")
def _flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = MARKETS.graph(spark, sf_dir)
    sent = f.maximum_flow(g, "r0", "r1")[0]
    net = sent.select(F.col("src").alias("id"), F.col("flow").alias("x")).union(sent.select("dst", -F.col("flow"))).groupBy("id").agg(F.sum("x").alias("x"))
    caps = sent.join(g.arcs, ["src", "dst"], "left").agg(F.coalesce(F.min(F.col("flow") <= F.col("w") + 1e-6), F.lit(True)).alias("within"))
    return net.agg(F.round(F.coalesce(F.sum(F.when(F.col("id") == "r0", F.col("x"))), F.lit(0.0)), 6).alias("value"), F.coalesce(F.min(F.col("id").isin("r0", "r1") | (F.abs("x") < 1e-6)), F.lit(True)).alias("conserved")).crossJoin(caps)


_COVER = "(SELECT min(bit_count(m)) FROM masks WHERE NOT EXISTS (SELECT 1 FROM edges e JOIN o x ON x.id = e.src JOIN o y ON y.id = e.dst WHERE (m >> x.b) & 1 = 0 AND (m >> y.b) & 1 = 0))"


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SEGMENTS.graph(spark, sf_dir).edges.select(F.when(F.col("src").rlike("^r[0-9]"), F.col("src")).otherwise(F.col("dst")).alias("l"), F.when(F.col("src").rlike("^r[0-9]"), F.col("dst")).otherwise(F.col("src")).alias("r"))


def _sound(found: DataFrame, edges: DataFrame) -> DataFrame:
    """The size of a matching and whether it is one of the graph's."""
    real = found.join(edges, ["l", "r"], "left_semi")
    return real.agg(F.count("*").alias("size"), ((F.countDistinct("l") == F.count("*")) & (F.countDistinct("r") == F.count("*"))).alias("sound"))


register("hopcroftkarp_segments", f"WITH {SEGMENTS.sql()}, {_BITS} SELECT CAST({_COVER} AS BIGINT) AS size, TRUE AS sound")(lambda s, d: (lambda e: _sound(f.matching(e), e))(_sides(s, d)))
register("edgecover_segments", f"WITH {SEGMENTS.sql()}, {_BITS} SELECT CAST((SELECT count(*) FROM nodes) - {_COVER} AS BIGINT) AS size, CAST((SELECT count(*) FROM nodes) AS BIGINT) AS covered")(
    lambda s, d: (lambda c: c.agg(F.count("*").alias("size")).crossJoin(c.select(F.explode(F.array("l", "r")).alias("id")).agg(F.countDistinct("id").alias("covered"))))(f.edge_cover(_sides(s, d)))
)
#: Antichains are sets of nodes none of which reaches another; by Dilworth the largest is as many as the fewest chains.
_EARLY = f"WITH RECURSIVE {TRADE_DAG.sql()}, reach(src, dst) AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON e.src = r.dst), few AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS b FROM (SELECT id FROM nodes ORDER BY id LIMIT 12)), masks AS (SELECT range AS m FROM range(CAST(power(2, (SELECT count(*) FROM few)) AS BIGINT)))"


@register("pathcover_chains", f"{_EARLY} SELECT CAST((SELECT max(bit_count(m)) FROM masks WHERE NOT EXISTS (SELECT 1 FROM reach r JOIN few x ON x.id = r.src JOIN few y ON y.id = r.dst WHERE (m >> x.b) & 1 = 1 AND (m >> y.b) & 1 = 1)) AS BIGINT) AS n_chains")
def _width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The width of the order among the twelve smallest names: nodes less the arcs of a chain cover."""
    from sparkweave.model import Graph
    from sparkweave.operators.paths import closure

    g = TRADE_DAG.graph(spark, sf_dir)
    few = g.nodes.orderBy("id").limit(12)
    part = Graph(g.nodes, closure(g).withColumn("w", F.lit(1.0)), True).induced(few)
    return part.nodes.agg(F.count("*").alias("n")).crossJoin(f.path_cover(part).agg(F.count("*").alias("k"))).select((F.col("n") - F.col("k")).alias("n_chains"))


register("coloring_greedy", f"""WITH RECURSIVE {TRADE_TIES.sql()}, deg AS (SELECT n.id, count(a.dst) AS d FROM nodes n LEFT JOIN arcs a ON a.src = n.id GROUP BY n.id), o AS (SELECT id, CAST(row_number() OVER (ORDER BY d DESC, id) AS INTEGER) AS r FROM deg),
near AS (SELECT y.r, list(x.r) AS early FROM arcs a JOIN o x ON x.id = a.src JOIN o y ON y.id = a.dst WHERE x.r < y.r GROUP BY y.r),
walk(k, cols) AS (SELECT 0, CAST([] AS BIGINT[]) UNION ALL SELECT w.k + 1, list_append(w.cols, list_min(list_filter(range(0, 60), lambda c: NOT list_contains(list_transform(coalesce(n.early, CAST([] AS INTEGER[])), lambda i: w.cols[i]), c)))) FROM walk w LEFT JOIN near n ON n.r = w.k + 1 WHERE w.k < (SELECT count(*) FROM nodes))
SELECT o.id, w.cols[o.r] AS colour FROM o CROSS JOIN (SELECT cols FROM walk ORDER BY k DESC LIMIT 1) w""")(lambda s, d: k.colouring(TRADE_TIES.graph(s, d)))
register("chordal_chains", f"{_RINGS}, {_SIZES} SELECT s.component, coalesce(r.len, 0) <> 4 AS chordal FROM size s LEFT JOIN ringed r ON r.component = s.component")(
    lambda s, d: (lambda g: components(g).join(k.elimination(g), "id", "left").groupBy("component").agg((F.count("*") == F.count("round")).alias("chordal")))(CHAINS.graph(s, d))
)
_QUAD = "SELECT w.id AS a, x.id AS b, y.id AS c, z.id AS d FROM nodes w JOIN nodes x ON w.id < x.id JOIN nodes y ON x.id < y.id JOIN nodes z ON y.id < z.id"
register("cograph_paths", f"""WITH {TRADE_TIES.sql()}, four AS (SELECT a, b, c, d, row_number() OVER () AS q FROM ({_QUAD}) t), inside AS (SELECT f.q, e.src, e.dst FROM four f JOIN edges e ON e.src <> e.dst AND e.src IN (f.a, f.b, f.c, f.d) AND e.dst IN (f.a, f.b, f.c, f.d)),
deg AS (SELECT q, id, count(*) AS d FROM (SELECT q, src AS id FROM inside UNION ALL SELECT q, dst FROM inside) t GROUP BY q, id), shape AS (SELECT q, list_sort(list(d)) AS s FROM deg GROUP BY q) SELECT CAST(count(*) AS BIGINT) AS n_paths, count(*) = 0 AS cograph FROM shape WHERE s = [1, 1, 2, 2]""")(
    lambda s, d: k.INDUCED_PATHS(TRADE_TIES.graph(s, d)).agg(F.count("*").alias("n_paths"), (F.count("*") == 0).alias("cograph"))
)
#: Threshold graphs meet the degree conditions of Erdos and Gallai with equality.
_EQUAL = "d AS (SELECT n.id, count(a.dst) AS d FROM nodes n LEFT JOIN arcs a ON a.src = n.id GROUP BY n.id), o AS (SELECT d, row_number() OVER (ORDER BY d DESC, id) AS r FROM d), t AS (SELECT x.r, sum(CASE WHEN y.r <= x.r THEN y.d END) AS top, x.r * (x.r - 1) + coalesce(sum(CASE WHEN y.r > x.r THEN least(y.d, x.r) END), 0) AS most FROM o x CROSS JOIN o y WHERE x.d >= x.r - 1 GROUP BY x.r) SELECT '{0}' AS graph, bool_and(top = most) AS threshold FROM t"
register("thresholdgraph_tests", " UNION ALL ".join(f"SELECT * FROM (WITH {s.sql()}, {_EQUAL.format(n)}) AS {n}" for n, s in (("ties", TRADE_TIES), ("tree", TREE), ("segments", SEGMENTS))))(
    lambda s, d: reduce(DataFrame.union, [k.ALTERNATING(g.graph(s, d)).agg(F.lit(n).alias("graph"), (F.count("*") == 0).alias("threshold")) for n, g in (("ties", TRADE_TIES), ("tree", TREE), ("segments", SEGMENTS))])
)
_PAIRS = "SELECT c.c_custkey AS id, n.n_regionkey AS a, c.c_mktsegment AS b FROM {customer} c JOIN {nation} n ON n.n_nationkey = c.c_nationkey"
register("partitioncompare_customers", f"""WITH p AS ({_PAIRS.format(customer="customer", nation="nation")}), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM p),
j AS (SELECT CAST(count(*) AS DOUBLE) AS t, count(CASE WHEN (x.a = y.a) = (x.b = y.b) THEN 1 END) AS agree, count(CASE WHEN x.a = y.a AND x.b = y.b THEN 1 END) AS in_both, count(CASE WHEN x.a = y.a OR x.b = y.b THEN 1 END) AS in_any FROM p x JOIN p y ON x.id < y.id),
h AS (SELECT (SELECT -sum(q * ln(q)) FROM (SELECT count(*) / n.n AS q FROM p CROSS JOIN n GROUP BY a, n.n) t) AS ha, (SELECT -sum(q * ln(q)) FROM (SELECT count(*) / n.n AS q FROM p CROSS JOIN n GROUP BY b, n.n) t) AS hb, (SELECT -sum(q * ln(q)) FROM (SELECT count(*) / n.n AS q FROM p CROSS JOIN n GROUP BY a, b, n.n) t) AS hab)
SELECT round(agree / t, 6) AS rand, round(in_both / CAST(in_any AS DOUBLE), 6) AS jaccard, round(2 * (ha + hb - hab) / (ha + hb), 6) AS nmi FROM j CROSS JOIN h""")(
    lambda s, d: k.PARTITIONS(s, pairs=s.sql(_PAIRS, customer=s.read.parquet(f"{d}/customer.parquet"), nation=s.read.parquet(f"{d}/nation.parquet")))
)
