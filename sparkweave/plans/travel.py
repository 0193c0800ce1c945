"""Queries of distances and routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkweave.model import Graph
from sparkweave.operators import paths as p
from sparkweave.plans.catalogue import register
from sparkweave.sources.tables import TRADE, TRADE_DAG, TRADE_TIES, TREE, USERS, Source


def hops_sql(source: Source, deep: int = 9) -> str:
    """Hop distances of all pairs, as a recursive table ``hops(origin, id, d)``."""
    return f"""WITH RECURSIVE {source.sql()}, walk(origin, id, d) AS (SELECT id, id, 0 FROM nodes UNION SELECT walk.origin, a.dst, walk.d + 1 FROM walk JOIN arcs a ON a.src = walk.id WHERE walk.d < {deep}),
hops AS (SELECT origin, id, CAST(min(d) AS DOUBLE) AS d FROM walk GROUP BY origin, id)"""


def relax_sql(source: Source, start: str, pick: str, new: str, keep: str, rounds: int = 26) -> str:
    """Values after ``rounds`` rounds of relaxation, as ``done(id, d)``; a node stays by a step of value ``keep``."""
    return f"""WITH RECURSIVE {source.sql()}, step AS (SELECT src, dst, CAST(w AS DOUBLE) AS w FROM arcs UNION ALL SELECT id, id, {keep} FROM nodes),
walk(k, id, d) AS ({start} UNION ALL SELECT walk.k + 1, s.dst, {pick}({new}) FROM walk JOIN step s ON s.src = walk.id WHERE walk.k < {rounds} GROUP BY walk.k + 1, s.dst),
done AS (SELECT id, d FROM walk WHERE k = {rounds})"""


_AT = "SELECT 0, (SELECT min(id) FROM nodes), CAST({0} AS DOUBLE)"


def _first(graph: Graph) -> str:
    """The start of a query: the graph's smallest name."""
    return graph.nodes.agg(F.min("id")).first()[0] or ""


_MIN = ("min", "walk.d + s.w", "0e0")

register("bfs_hops", hops_sql(USERS, 7) + " SELECT id, CAST(d AS BIGINT) AS hops FROM hops WHERE origin = (SELECT min(id) FROM nodes)")(lambda s, d: (lambda g: p.bfs(g, _first(g)))(USERS.graph(s, d)).select("id", "hops"))
register("dijkstra_distances", relax_sql(TRADE, _AT.format(0), *_MIN) + " SELECT id, d AS dist FROM done")(lambda s, d: (lambda g: p.distances(g, _first(g)))(TRADE.graph(s, d)).select("id", "dist"))
register("bellmanford_distances", relax_sql(TRADE_TIES, _AT.format(0), *_MIN) + " SELECT id, d AS dist FROM done")(lambda s, d: (lambda g: p.distances(g, _first(g), allow_negative=True))(TRADE_TIES.graph(s, d)).select("id", "dist"))
register("widestpath_widths", relax_sql(TRADE, _AT.format("'Infinity'"), "max", "least(walk.d, s.w)", "CAST('Infinity' AS DOUBLE)") + " SELECT id, d AS width FROM done WHERE id <> (SELECT min(id) FROM nodes)")(lambda s, d: (lambda g: p.widest(g, _first(g)).select("id", "width").where(F.col("id") != _first(g)))(TRADE.graph(s, d)))
register("floydwarshall_pairs", relax_sql(TRADE, "SELECT 0, struct_pack(o := id, i := id), 0e0 FROM nodes", "min", "walk.d + s.w", "0e0").replace("s.dst, min", "struct_pack(o := walk.id.o, i := s.dst), min").replace("ON s.src = walk.id", "ON s.src = walk.id.i").replace("GROUP BY walk.k + 1, s.dst", "GROUP BY walk.k + 1, struct_pack(o := walk.id.o, i := s.dst)") + " SELECT id.o AS src, id.i AS dst, d AS dist FROM done")(lambda s, d: p.all_pairs(TRADE.graph(s, d), True))
register("dagpaths_longest", relax_sql(TRADE_DAG, _AT.format(0), "max", "walk.d + s.w", "0e0") + " SELECT id, d AS longest FROM done")(lambda s, d: (lambda g: p.dag_paths(g, _first(g)))(TRADE_DAG.graph(s, d)).select("id", "longest"))
register("toposort_layers", f"""WITH RECURSIVE {TRADE_DAG.sql()}, walk(id, d) AS (SELECT id, 0 FROM nodes WHERE id NOT IN (SELECT dst FROM edges) UNION SELECT e.dst, walk.d + 1 FROM walk JOIN edges e ON e.src = walk.id)
SELECT id, CAST(max(d) AS BIGINT) AS layer FROM walk GROUP BY id""")(lambda s, d: p.topological_layers(TRADE_DAG.graph(s, d)))
_REACH = ", reach(src, dst) AS (SELECT src, dst FROM arcs UNION SELECT reach.src, a.dst FROM reach JOIN arcs a ON a.src = reach.dst)"
register("transitiveclosure_pairs", f"WITH RECURSIVE {TRADE_DAG.sql()}{_REACH} SELECT src, dst FROM reach")(lambda s, d: p.closure(TRADE_DAG.graph(s, d)))
register("transitiveclosure_reduction", f"WITH RECURSIVE {TRADE_DAG.sql()}{_REACH} SELECT src, dst, w FROM edges e WHERE NOT EXISTS (SELECT 1 FROM edges f JOIN reach r ON r.src = f.dst WHERE f.src = e.src AND r.dst = e.dst)")(lambda s, d: p.reduction(TRADE_DAG.graph(s, d)).select("src", "dst", "w"))
_ECC = """, ecc AS (SELECT origin AS id, CASE WHEN count(*) = (SELECT count(*) FROM nodes) THEN max(d) END AS eccentricity FROM hops GROUP BY origin)
SELECT id, eccentricity, coalesce(eccentricity = (SELECT min(eccentricity) FROM ecc), FALSE) AS center, coalesce(eccentricity = (SELECT max(eccentricity) FROM ecc), FALSE) AS periphery FROM ecc"""
register("diameter_eccentricities", hops_sql(TRADE_TIES) + _ECC)(lambda s, d: p.eccentricities(TRADE_TIES.graph(s, d)))
register("graphcenter_tree", hops_sql(TREE) + _ECC)(lambda s, d: p.eccentricities(TREE.graph(s, d)))
_CLOSE = """, n AS (SELECT count(*) - 1 AS n FROM nodes), s AS (SELECT origin, count(*) AS r, sum(d) AS total, sum(1 / d) AS inverse FROM hops WHERE origin <> id GROUP BY origin)
SELECT id, round(coalesce(r / CAST(n AS DOUBLE) * r / total, 0e0), 6) AS closeness, round(coalesce(inverse / n, 0e0), 6) AS harmonic FROM nodes CROSS JOIN n LEFT JOIN s ON s.origin = nodes.id"""
register("closeness_users", hops_sql(USERS, 7) + _CLOSE)(lambda s, d: p.distance_centrality(USERS.graph(s, d)))
register("harmonic_trade", hops_sql(TRADE_TIES) + _CLOSE)(lambda s, d: p.distance_centrality(TRADE_TIES.graph(s, d)))
register("wienerindex_tree", hops_sql(TREE) + " SELECT round(sum(d), 6) AS wiener, round(avg(d), 6) AS mean_distance, round(sum(1 / d), 6) AS harary FROM hops WHERE origin < id")(lambda s, d: p.wiener(TREE.graph(s, d)))
_SIGMA = """, counted(origin, id, d, sigma) AS (SELECT id, id, 0e0, 1e0 FROM nodes UNION ALL SELECT c.origin, a.dst, c.d + 1, sum(c.sigma) FROM counted c JOIN arcs a ON a.src = c.id JOIN hops h ON h.origin = c.origin AND h.id = a.dst AND h.d = c.d + 1 GROUP BY c.origin, a.dst, c.d + 1)
SELECT n.id, round({half} * coalesce(sum(x.sigma * y.sigma / z.sigma), 0e0), 6) AS betweenness, round({half} * coalesce(sum(x.sigma * y.sigma), 0e0), 6) AS stress
FROM nodes n LEFT JOIN counted x ON x.id = n.id AND x.origin <> n.id LEFT JOIN counted y ON y.origin = n.id AND y.id <> n.id LEFT JOIN counted z ON z.origin = x.origin AND z.id = y.id
WHERE x.origin IS NULL OR (x.origin <> y.id AND x.d + y.d = z.d) GROUP BY n.id"""
register("betweenness_shares", hops_sql(TREE) + _SIGMA.format(half="0.5e0") + " HAVING count(z.id) > 0 UNION ALL SELECT id, 0e0, 0e0 FROM nodes WHERE id NOT IN (SELECT src FROM arcs GROUP BY src HAVING count(*) > 1)")(lambda s, d: p.betweenness(TREE.graph(s, d)))
register("stresscentrality_trade")(lambda s, d: p.betweenness(TRADE_TIES.graph(s, d)))
register("girth_trade", hops_sql(TRADE_TIES) + " SELECT CAST(CASE WHEN EXISTS (SELECT 1 FROM arcs x JOIN arcs y ON y.src = x.dst JOIN arcs z ON z.src = y.dst AND z.dst = x.src WHERE x.src <> x.dst AND y.src <> y.dst AND z.src <> z.dst) THEN 3 END AS BIGINT) AS girth")(lambda s, d: p.girth(TRADE_TIES.graph(s, d)))
register("kcenter_trade")(lambda s, d: p.k_center(TRADE_TIES.graph(s, d), 3))
register("vitality_tree")(lambda s, d: p.vitality(TREE.graph(s, d)))
register("yen_routes", f"""WITH RECURSIVE {TREE.sql()}, walk(here, path, cost) AS (SELECT 'n0', ['n0'], 0e0 UNION ALL SELECT a.dst, list_append(walk.path, a.dst), walk.cost + a.w FROM walk JOIN arcs a ON a.src = walk.here WHERE NOT list_contains(walk.path, a.dst) AND walk.here <> 'n8' AND len(walk.path) <= 8)
SELECT CAST(row_number() OVER (ORDER BY cost, path) AS INTEGER) AS rank, array_to_string(path, '>') AS path, round(cost, 6) AS cost FROM walk WHERE here = 'n8'""")(lambda s, d: p.yen(TREE.graph(s, d), "n0", "n8", 3).withColumn("path", F.array_join("path", ">")))
