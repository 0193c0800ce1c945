"""Exact answers to hard questions on small graphs, by enumeration as a plan.

Every subset of at most ``most`` nodes is one row of ``spark.range(2 ** n)``;
edges are tested by bits, and one aggregation gives each subset's value.  The
subsets are spread over the executors and nothing but the best is kept.  Node
k of the order by name is bit k.
"""

from __future__ import annotations

from sparkweave.model import Declared

#: Subsets by adding bits one at a time: the number of rows doubles with every node.
_MASKS = """o AS (SELECT id, CAST(row_number() OVER (ORDER BY id) - 1 AS INT) AS b FROM {nodes}), total AS (SELECT CAST(power(2, count(*)) AS BIGINT) AS n FROM o),
digits AS (SELECT 0 AS d UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3), base AS (SELECT CAST(a.d + 4 * b.d + 16 * c.d AS BIGINT) AS v FROM digits a CROSS JOIN digits b CROSS JOIN digits c),
masks AS (SELECT x.v + 64 * y.v + 4096 * z.d AS m FROM base x CROSS JOIN base y CROSS JOIN digits z CROSS JOIN total WHERE x.v + 64 * y.v + 4096 * z.d < total.n),
e AS (SELECT x.b AS a, y.b AS b, s.w FROM {edges} s JOIN o x ON x.id = s.src JOIN o y ON y.id = s.dst WHERE s.src <> s.dst),
inside AS (SELECT m, CAST(sum((m >> e.a) & 1 & (m >> e.b)) AS BIGINT) AS k, CAST(sum(((m >> e.a) & 1) | ((m >> e.b) & 1)) AS BIGINT) AS touched, CAST(sum(((m >> e.a) & 1) ^ ((m >> e.b) & 1)) AS BIGINT) AS crossing,
  sum(CASE WHEN ((m >> e.a) & 1) <> ((m >> e.b) & 1) THEN e.w ELSE 0e0 END) AS cut, count(*) AS edges FROM masks CROSS JOIN e GROUP BY m)"""
# The bit operators of the two dialects differ only in exclusive or.
_MASKS = _MASKS.replace("CAST(sum(((m >> e.a) & 1) ^ ((m >> e.b) & 1)) AS BIGINT)", "CAST(sum(CASE WHEN ((m >> e.a) & 1) <> ((m >> e.b) & 1) THEN 1 ELSE 0 END) AS BIGINT)")

#: Heaviest cut, and the edges that cross it.
max_cut = Declared(f"WITH {_MASKS} SELECT round(max(cut), 6) AS max_cut FROM inside", directed=False, most=14)
#: Smallest set of nodes that touches every edge.
vertex_cover = Declared(f"WITH {_MASKS} SELECT CAST(min(bit_count(m)) AS BIGINT) AS vertex_cover FROM inside WHERE touched = edges", directed=False, most=14)
#: Largest set without an edge, and the largest with all of them.
independence = Declared(f"WITH {_MASKS} SELECT CAST(max(CASE WHEN k = 0 THEN bit_count(m) END) AS BIGINT) AS independence_number, CAST(max(CASE WHEN k = bit_count(m) * (bit_count(m) - 1) / 2 THEN bit_count(m) END) AS BIGINT) AS clique_number FROM inside", directed=False, most=14)
#: Independent sets of every size: the coefficients of the independence polynomial.
independence_polynomial = Declared(f"WITH {_MASKS} SELECT CAST(bit_count(m) AS INT) AS size, CAST(count(*) AS BIGINT) AS n_sets FROM inside WHERE k = 0 GROUP BY 1", directed=False, most=14)
#: Smallest conductance of a side, weights as volume.
cheeger = Declared(f"""WITH {_MASKS}, vol AS (SELECT m, sum(e.w * (((m >> e.a) & 1) + ((m >> e.b) & 1))) AS v, sum(2 * e.w) AS total FROM masks CROSS JOIN e GROUP BY m)
SELECT round(min(i.cut / least(v.v, v.total - v.v)), 6) AS cheeger FROM inside i JOIN vol v ON v.m = i.m WHERE v.v > 0 AND v.v < v.total""", directed=False, most=14)
#: Cheapest cut into halves of equal size.
bisection = Declared(f"WITH {_MASKS} SELECT round(min(cut), 6) AS bisection FROM inside CROSS JOIN (SELECT count(*) AS c FROM o) z WHERE bit_count(m) = floor(z.c / 2)", directed=False, most=14)
#: Weight of the lightest cut that parts the graph at all.
global_min_cut = Declared(f"WITH {_MASKS} SELECT round(min(cut), 6) AS min_cut, min(crossing) AS edge_connectivity FROM inside CROSS JOIN total WHERE m > 0 AND m < total.n - 1", directed=False, most=14)
#: Lightest cut between every pair, which a cut tree answers too.
pair_cuts = Declared(f"WITH {_MASKS} SELECT x.id AS a, y.id AS b, round(min(cut), 6) AS min_cut FROM inside CROSS JOIN o x JOIN o y ON x.id < y.id WHERE ((m >> x.b) & 1) <> ((m >> y.b) & 1) GROUP BY x.id, y.id", directed=False, most=12)
#: Largest flow between two nodes, which is the lightest cut with one on each side.
max_flow = Declared(f"WITH {_MASKS} SELECT round(min(cut), 6) AS max_flow, min(crossing) AS disjoint_routes FROM inside JOIN o x ON x.id = {{source}} JOIN o y ON y.id = {{sink}} WHERE ((m >> x.b) & 1) = 1 AND ((m >> y.b) & 1) = 0", directed=False, most=14)
_CLOSED = """near AS (SELECT x.b AS a, sum(DISTINCT CAST(power(2, y.b) AS BIGINT)) AS nb FROM (SELECT src, dst FROM {arcs} UNION SELECT id, id FROM {nodes}) s JOIN o x ON x.id = s.src JOIN o y ON y.id = s.dst GROUP BY x.b)"""
#: Smallest set whose members and neighbours are all nodes.
dominating_set = Declared(f"""WITH {_MASKS}, {_CLOSED}, seen AS (SELECT m, count(*) AS n FROM masks JOIN near ON (m & CAST(near.nb AS BIGINT)) <> 0 GROUP BY m)
SELECT CAST(min(bit_count(m)) AS BIGINT) AS domination_number FROM seen WHERE n = (SELECT count(*) FROM o)""", directed=False, most=14)
#: Matchings of every size, as independent sets of edges.
_EDGE_MASKS = """numbered AS (SELECT src, dst, CAST(row_number() OVER (ORDER BY src, dst) - 1 AS INT) AS k FROM {edges} WHERE src <> dst), total AS (SELECT CAST(power(2, count(*)) AS BIGINT) AS n FROM numbered),
digits AS (SELECT 0 AS d UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3), base AS (SELECT CAST(a.d + 4 * b.d + 16 * c.d AS BIGINT) AS v FROM digits a CROSS JOIN digits b CROSS JOIN digits c),
masks AS (SELECT x.v + 64 * y.v + 4096 * z.v AS m FROM base x CROSS JOIN base y CROSS JOIN base z CROSS JOIN total WHERE x.v + 64 * y.v + 4096 * z.v < total.n),
clash AS (SELECT a.k AS a, b.k AS b FROM numbered a JOIN numbered b ON a.k < b.k AND (a.src = b.src OR a.src = b.dst OR a.dst = b.src OR a.dst = b.dst)),
bad AS (SELECT DISTINCT m FROM masks JOIN clash ON ((m >> clash.a) & 1) = 1 AND ((m >> clash.b) & 1) = 1),
fine AS (SELECT masks.m FROM masks LEFT JOIN bad ON bad.m = masks.m WHERE bad.m IS NULL)"""
matchings = Declared(f"WITH {_EDGE_MASKS} SELECT CAST(bit_count(m) AS INT) AS size, CAST(count(*) AS BIGINT) AS n_matchings FROM fine GROUP BY 1", directed=False, most_edges=18)
maximum_matching = Declared(f"WITH {_EDGE_MASKS}, best AS (SELECT max(bit_count(m)) AS k FROM fine), c AS (SELECT count(*) AS n FROM {{nodes}}) SELECT CAST(k AS BIGINT) AS matching_number, CAST(n - k AS BIGINT) AS edge_cover_number, CAST(CASE WHEN 2 * k = n THEN (SELECT count(*) FROM fine WHERE bit_count(m) = k) ELSE 0 END AS BIGINT) AS perfect_matchings FROM best CROSS JOIN c", directed=False, most_edges=18)
