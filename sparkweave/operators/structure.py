"""Readings of degrees, ties and small patterns, nearly all of them one declarative plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.model import Declared, Graph
from sparkweave.session import materialise, tidy

_DEG = "deg AS (SELECT n.id, CAST(count(a.dst) AS BIGINT) AS d FROM {nodes} n LEFT JOIN {arcs} a ON a.src = n.id GROUP BY n.id)"
#: Undirected simple edges, oriented from the end of smaller degree: work on hubs stays bounded.
_ORIENTED = """ranked AS (
  SELECT e.src AS a, e.dst AS b, x.d AS da, y.d AS db FROM {edges} e JOIN deg x ON x.id = e.src JOIN deg y ON y.id = e.dst WHERE e.src <> e.dst),
up AS (SELECT CASE WHEN da < db OR (da = db AND a < b) THEN a ELSE b END AS lo, CASE WHEN da < db OR (da = db AND a < b) THEN b ELSE a END AS hi FROM ranked),
tri AS (SELECT p.lo AS x, p.hi AS y, q.hi AS z FROM up p JOIN up q ON p.lo = q.lo AND p.hi < q.hi JOIN {edges} e ON e.src = least(p.hi, q.hi) AND e.dst = greatest(p.hi, q.hi)),
corners AS (SELECT x AS id FROM tri UNION ALL SELECT y FROM tri UNION ALL SELECT z FROM tri),
per AS (SELECT id, count(*) AS t FROM corners GROUP BY id)"""

#: Degree (out-degree on digraphs), in-degree and strength of every node.
degrees = Declared("""
SELECT n.id, CAST(coalesce(o.d, 0) AS BIGINT) AS degree, CAST(coalesce(i.d, 0) AS BIGINT) AS in_degree, round(coalesce(o.s, 0.0e0), 6) AS strength
FROM {nodes} n LEFT JOIN (SELECT src, count(*) AS d, sum(w) AS s FROM {arcs} GROUP BY src) o ON o.src = n.id
LEFT JOIN (SELECT dst, count(*) AS d FROM {arcs} GROUP BY dst) i ON i.dst = n.id""")

#: Histogram of degrees with the share of nodes at or above each.
degree_histogram = Declared(f"""WITH {_DEG}, h AS (SELECT d AS degree, count(*) AS n FROM deg GROUP BY d)
SELECT degree, CAST(n AS BIGINT) AS n_nodes, round(sum(n) OVER (ORDER BY degree DESC) / sum(n) OVER (), 6) AS ccdf FROM h""")

#: Moments, dispersion, branching factor and the maximum-likelihood tail exponent from ``kmin`` on.
degree_stats = Declared(f"""WITH {_DEG}
SELECT round(avg(d), 6) AS mean, round(var_pop(d), 6) AS variance, round(CASE WHEN avg(d) > 0 THEN var_pop(d) / avg(d) ELSE 0.0e0 END, 6) AS dispersion,
  max(d) AS largest, round(CASE WHEN avg(d) > 0 THEN (avg(d * d) - avg(d)) / avg(d) ELSE 0.0e0 END, 6) AS branching,
  var_pop(d) > 3 * avg(d) AS heavy_tailed,
  round(CASE WHEN count(CASE WHEN d >= {{kmin}} THEN 1 END) >= 5 THEN 1 + count(CASE WHEN d >= {{kmin}} THEN 1 END) / sum(CASE WHEN d >= {{kmin}} THEN ln(d / ({{kmin}} - 0.5e0)) END) END, 6) AS exponent
FROM deg""")

#: Pearson correlation of the degrees at the two ends of an edge; null where one side does not vary.
assortativity = Declared(f"""WITH {_DEG}, p AS (SELECT CAST(x.d AS DOUBLE) AS a, CAST(y.d AS DOUBLE) AS b FROM {{arcs}} r JOIN deg x ON x.id = r.src JOIN deg y ON y.id = r.dst),
m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(a * b) AS ab, var_pop(a) AS va, var_pop(b) AS vb FROM p)
SELECT CASE WHEN va > 1e-12 AND vb > 1e-12 THEN round((ab - ma * mb) / sqrt(va * vb), 6) END AS assortativity FROM m""")


@tidy
def degree_correlation(graph: Graph) -> DataFrame:
    """The row of ``assortativity`` on an undirected graph, by exact sums: edges meet the degrees of one end only, and what they add up to those of the other."""
    edges = materialise(graph.need(directed=False).edges.select("src", "dst"), "edges")
    ends = edges.select(F.col("src").alias("id")).union(edges.where("src <> dst").select("dst"))
    degree = materialise(ends.groupBy("id").agg(F.count("*").alias("d")), "degrees")
    # An edge is two arcs, a loop is one.
    twice = F.when(F.col("src") == F.col("dst"), 1).otherwise(2)
    beside = edges.join(degree.toDF("src", "ds"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(twice * F.col("ds")).alias("s"))
    whole = F.col("d").cast("decimal(19,0)")
    n, a, aa = degree.agg(F.sum("d"), F.sum(whole * F.col("d")), F.sum((whole * F.col("d")).cast("decimal(38,0)") * F.col("d"))).first()
    ab = beside.join(degree, "id").agg(F.sum(whole * F.col("s"))).first()[0]
    found = None
    if n:
        n, a, aa, ab = int(n), int(a), int(aa), int(ab)
        spread = n * aa - a * a
        found = round((n * ab - a * a) / spread, 6) if spread / n**2 > 1e-12 else None
    return graph.spark.createDataFrame([(found,)], "assortativity double")


#: Entropies in bits: of the degrees, of a random step, and of the stationary walk.
entropy = Declared("""WITH s AS (SELECT n.id, count(a.dst) AS d, coalesce(sum(a.w), 0.0e0) AS s FROM {nodes} n LEFT JOIN {arcs} a ON a.src = n.id GROUP BY n.id),
t AS (SELECT sum(s) AS total, count(*) AS n FROM s),
h AS (SELECT d, count(*) AS c FROM s GROUP BY d),
step AS (SELECT a.src, -sum((a.w / s.s) * log2(a.w / s.s)) AS choice FROM {arcs} a JOIN s ON s.id = a.src WHERE s.s > 0 AND a.w > 0 GROUP BY a.src)
SELECT round((SELECT -sum((h.c / t.n) * log2(h.c / t.n)) FROM h CROSS JOIN t), 6) + 0.0e0 AS degree_entropy,
  round((SELECT coalesce(sum(s.s / t.total * step.choice), 0.0e0) FROM step JOIN s ON s.id = step.src CROSS JOIN t), 6) + 0.0e0 AS walk_entropy_rate,
  round((SELECT coalesce(-sum(s.s / t.total * log2(s.s / t.total)), 0.0e0) FROM s CROSS JOIN t WHERE s.s > 0), 6) + 0.0e0 AS structural_entropy""", directed=False)

#: Triangles at every node with local clustering.
triangles = Declared(f"""WITH {_DEG}, {_ORIENTED}
SELECT deg.id, CAST(coalesce(per.t, 0) AS BIGINT) AS triangles, round(CASE WHEN d > 1 THEN 2.0e0 * coalesce(per.t, 0) / (d * (d - 1)) ELSE 0.0e0 END, 6) AS clustering
FROM deg LEFT JOIN per ON per.id = deg.id""", directed=False)

#: Triangle total, average clustering over all nodes, transitivity and density.
clustering = Declared(f"""WITH {_DEG}, {_ORIENTED},
local AS (SELECT d, coalesce(t, 0) AS t, CASE WHEN d > 1 THEN 2.0e0 * coalesce(t, 0) / (d * (d - 1)) ELSE 0.0e0 END AS c FROM deg LEFT JOIN per ON per.id = deg.id)
SELECT CAST(sum(t) / 3 AS BIGINT) AS triangles, round(avg(c), 6) AS average_clustering,
  round(CASE WHEN sum(d * (d - 1)) > 0 THEN 2.0e0 * sum(t) / sum(d * (d - 1)) ELSE 0.0e0 END, 6) AS transitivity,
  round(CASE WHEN count(*) > 1 THEN sum(d) / (1.0e0 * count(*) * (count(*) - 1)) ELSE 0.0e0 END, 6) AS density
FROM local""", directed=False)

#: Triangles and four-cycles, the latter from pairs with common neighbours.
cycle_count = Declared(f"""WITH {_DEG}, {_ORIENTED},
two AS (SELECT p.src AS a, q.src AS b, count(*) AS c FROM {{arcs}} p JOIN {{arcs}} q ON p.dst = q.dst AND p.src < q.src WHERE p.src <> p.dst AND q.src <> q.dst GROUP BY p.src, q.src)
SELECT CAST((SELECT count(*) FROM tri) AS BIGINT) AS triangles, CAST((SELECT coalesce(sum(c * (c - 1) / 2), 0) / 2 FROM two) AS BIGINT) AS four_cycles""", directed=False)

#: Orbits of every node: degree, end and middle of an open path of three nodes, corner of a triangle.
graphlets = Declared(f"""WITH {_DEG}, {_ORIENTED},
ends AS (SELECT a.src AS id, sum(deg.d - 1) AS e FROM {{arcs}} a JOIN deg ON deg.id = a.dst GROUP BY a.src)
SELECT deg.id, d AS degree, CAST(coalesce(e, 0) - 2 * coalesce(t, 0) AS BIGINT) AS path_end, CAST(d * (d - 1) / 2 - coalesce(t, 0) AS BIGINT) AS path_middle, CAST(coalesce(t, 0) AS BIGINT) AS corner
FROM deg LEFT JOIN ends ON ends.id = deg.id LEFT JOIN per ON per.id = deg.id""", directed=False)

#: Edges among nodes of more than k neighbours against all possible, for every k that leaves two.
rich_club = Declared(f"""WITH {_DEG}, levels AS (SELECT DISTINCT d - 1 AS k FROM deg WHERE d > 0),
rich AS (SELECT k, count(*) AS n FROM levels JOIN deg ON deg.d > k GROUP BY k HAVING count(*) > 1),
among AS (SELECT k, count(*) AS m FROM levels JOIN (SELECT least(x.d, y.d) AS low FROM {{edges}} e JOIN deg x ON x.id = e.src JOIN deg y ON y.id = e.dst WHERE e.src <> e.dst) p ON p.low > k GROUP BY k)
SELECT rich.k, rich.n AS n_rich, CAST(coalesce(m, 0) AS BIGINT) AS edges_among, round(2.0e0 * coalesce(m, 0) / (1.0e0 * n * (n - 1)), 6) AS phi
FROM rich LEFT JOIN among ON among.k = rich.k""", directed=False)

#: Correlation of every degree-ordered prefix, taken as core, with the ideal core and periphery; the best is ranked 1.
core_periphery = Declared(f"""WITH {_DEG}, o AS (SELECT id, row_number() OVER (ORDER BY d DESC, id) AS r FROM deg), t AS (SELECT count(*) AS n, (SELECT count(*) FROM {{edges}} WHERE src <> dst) AS m FROM deg),
last AS (SELECT least(x.r, y.r) AS first_end, count(*) AS c FROM {{edges}} e JOIN o x ON x.id = e.src JOIN o y ON y.id = e.dst WHERE e.src <> e.dst GROUP BY least(x.r, y.r)),
cum AS (SELECT o.r AS size, sum(coalesce(c, 0)) OVER (ORDER BY o.r) AS touching FROM o LEFT JOIN last ON last.first_end = o.r),
s AS (SELECT size, 1.0e0 * touching AS hit, n * (n - 1) / 2.0e0 AS pairs, n * (n - 1) / 2.0e0 - (n - size) * (n - size - 1) / 2.0e0 AS ideal, 1.0e0 * m AS m FROM cum CROSS JOIN t WHERE size < n),
scored AS (SELECT size, CASE WHEN m > 0 AND m < pairs AND ideal < pairs THEN (hit / pairs - (m / pairs) * (ideal / pairs)) / sqrt((m / pairs) * (1 - m / pairs) * (ideal / pairs) * (1 - ideal / pairs)) ELSE 0.0e0 END AS c FROM s)
SELECT size AS core_size, round(c, 6) AS correlation FROM scored""", directed=False)

#: Burt's constraint and effective size of every node that has ties.
constraint = Declared("""WITH s AS (SELECT src, sum(w) AS s FROM {arcs} GROUP BY src), p AS (SELECT a.src AS i, a.dst AS j, a.w / s.s AS p FROM {arcs} a JOIN s ON s.src = a.src WHERE a.src <> a.dst),
via AS (SELECT x.i, y.j, sum(x.p * y.p) AS q FROM p x JOIN p y ON x.j = y.i JOIN p z ON z.i = x.i AND z.j = y.j GROUP BY x.i, y.j),
c AS (SELECT p.i, sum(power(p.p + coalesce(via.q, 0.0e0), 2)) AS c FROM p LEFT JOIN via ON via.i = p.i AND via.j = p.j GROUP BY p.i),
r AS (SELECT x.i, count(*) AS ties FROM p x JOIN p y ON y.i = x.j JOIN p z ON z.i = x.i AND z.j = y.j GROUP BY x.i),
k AS (SELECT i, count(*) AS k FROM p GROUP BY i)
SELECT c.i AS id, round(c.c, 6) AS ego_constraint, round(k.k - coalesce(r.ties, 0) / (1.0e0 * k.k), 6) AS effective_size
FROM c JOIN k ON k.i = c.i LEFT JOIN r ON r.i = c.i""", directed=False)

#: Scores of absent pairs that share a neighbour; pairs that share none score 0 and are left out.
link_prediction = Declared(f"""WITH {_DEG}, two AS (SELECT p.src AS u, q.src AS v, count(*) AS common, sum(1.0e0 / ln(deg.d)) AS adar
  FROM {{arcs}} p JOIN {{arcs}} q ON p.dst = q.dst AND p.src < q.src JOIN deg ON deg.id = p.dst WHERE p.src <> p.dst AND q.src <> q.dst GROUP BY p.src, q.src)
SELECT u, v, CAST(common AS BIGINT) AS common, round(common / (1.0e0 * (x.d + y.d - common)), 6) AS jaccard, round(adar, 6) AS adamic_adar, x.d * y.d AS preferential
FROM two JOIN deg x ON x.id = u JOIN deg y ON y.id = v WHERE NOT EXISTS (SELECT 1 FROM {{edges}} e WHERE e.src = two.u AND e.dst = two.v)""", directed=False)

#: Freeman's centralisation of degrees against the star.
degree_centralization = Declared(f"""WITH {_DEG}, t AS (SELECT max(d) AS top, count(*) AS n, sum(d) AS total FROM deg)
SELECT round(CASE WHEN n < 3 THEN 0.0e0 ELSE (top * n - total) / (1.0e0 * (n - 1) * (n - 2)) END, 6) AS degree_centralization FROM t""", directed=False)

#: Induced four-node shapes; work grows with the number of quadruples, hence the cap.
quad_census = Declared("""WITH pairs AS (SELECT src, dst FROM {edges} WHERE src < dst),
k AS (SELECT a.id AS a, b.id AS b, c.id AS c, d.id AS d FROM {nodes} a JOIN {nodes} b ON a.id < b.id JOIN {nodes} c ON b.id < c.id JOIN {nodes} d ON c.id < d.id),
bits AS (SELECT k.*, CASE WHEN e1.src IS NULL THEN 0 ELSE 1 END AS ab, CASE WHEN e2.src IS NULL THEN 0 ELSE 1 END AS ac, CASE WHEN e3.src IS NULL THEN 0 ELSE 1 END AS ad,
  CASE WHEN e4.src IS NULL THEN 0 ELSE 1 END AS bc, CASE WHEN e5.src IS NULL THEN 0 ELSE 1 END AS bd, CASE WHEN e6.src IS NULL THEN 0 ELSE 1 END AS cd
  FROM k LEFT JOIN pairs e1 ON e1.src = a AND e1.dst = b LEFT JOIN pairs e2 ON e2.src = a AND e2.dst = c LEFT JOIN pairs e3 ON e3.src = a AND e3.dst = d
  LEFT JOIN pairs e4 ON e4.src = b AND e4.dst = c LEFT JOIN pairs e5 ON e5.src = b AND e5.dst = d LEFT JOIN pairs e6 ON e6.src = c AND e6.dst = d),
shape AS (SELECT ab + ac + ad + bc + bd + cd AS m, greatest(ab + ac + ad, ab + bc + bd, ac + bc + cd, ad + bd + cd) AS top, least(ab + ac + ad, ab + bc + bd, ac + bc + cd, ad + bd + cd) AS low FROM bits)
SELECT CASE WHEN m = 6 THEN 'complete' WHEN m = 5 THEN 'diamond' WHEN m = 4 AND top = 2 THEN 'cycle' WHEN m = 4 THEN 'paw'
  WHEN m = 3 AND top = 3 THEN 'claw' WHEN m = 3 AND low = 1 THEN 'path' ELSE 'disconnected' END AS shape, CAST(count(*) AS BIGINT) AS n
FROM shape GROUP BY 1""", directed=False, most=40)

#: The sixteen classes of triples by mutual, asymmetric and null dyads; connected triples are joined, the rest subtracted.
triad_census = Declared("""WITH d AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(CASE WHEN src < dst THEN 1 ELSE 0 END) AS f, sum(CASE WHEN src > dst THEN 1 ELSE 0 END) AS r FROM {arcs} WHERE src <> dst GROUP BY 1, 2),
k AS (SELECT x.id AS a, y.id AS b, z.id AS c FROM {nodes} x JOIN {nodes} y ON x.id < y.id JOIN {nodes} z ON y.id < z.id),
t AS (SELECT coalesce(p.f, 0) AS ab, coalesce(p.r, 0) AS ba, coalesce(q.f, 0) AS ac, coalesce(q.r, 0) AS ca, coalesce(s.f, 0) AS bc, coalesce(s.r, 0) AS cb
  FROM k LEFT JOIN d p ON p.a = k.a AND p.b = k.b LEFT JOIN d q ON q.a = k.a AND q.b = k.c LEFT JOIN d s ON s.a = k.b AND s.b = k.c),
m AS (SELECT *, ab * ba + ac * ca + bc * cb AS mutual, (CASE WHEN ab <> ba THEN 1 ELSE 0 END) + (CASE WHEN ac <> ca THEN 1 ELSE 0 END) + (CASE WHEN bc <> cb THEN 1 ELSE 0 END) AS asym,
  ab + ac AS oa, ba + bc AS ob, ca + cb AS oc, ba + ca AS ia, ab + cb AS ib, ac + bc AS ic FROM t),
code AS (SELECT CASE
  WHEN mutual = 0 AND asym = 0 THEN '003' WHEN mutual = 0 AND asym = 1 THEN '012' WHEN mutual = 1 AND asym = 0 THEN '102'
  WHEN mutual = 0 AND asym = 2 THEN CASE WHEN greatest(oa, ob, oc) = 2 THEN '021D' WHEN greatest(ia, ib, ic) = 2 THEN '021U' ELSE '021C' END
  WHEN mutual = 1 AND asym = 1 THEN CASE WHEN greatest(ia, ib, ic) = 2 THEN '111D' ELSE '111U' END
  WHEN mutual = 0 AND asym = 3 THEN CASE WHEN oa = 1 AND ob = 1 AND oc = 1 THEN '030C' ELSE '030T' END
  WHEN mutual = 2 AND asym = 0 THEN '201'
  WHEN mutual = 1 AND asym = 2 THEN CASE WHEN (oa = 2 AND ia = 0) OR (ob = 2 AND ib = 0) OR (oc = 2 AND ic = 0) THEN '120D' WHEN (ia = 2 AND oa = 0) OR (ib = 2 AND ob = 0) OR (ic = 2 AND oc = 0) THEN '120U' ELSE '120C' END
  WHEN mutual = 2 AND asym = 1 THEN '210' ELSE '300' END AS triad FROM m)
SELECT triad, CAST(count(*) AS BIGINT) AS n FROM code GROUP BY triad""")

#: Hammer and Simeone's identity: whether the graph is split, and the size of its clique.
split_graph = Declared(f"""WITH {_DEG}, o AS (SELECT d, row_number() OVER (ORDER BY d DESC, id) AS i FROM deg), c AS (SELECT coalesce(max(CASE WHEN d >= i - 1 THEN i END), 0) AS m FROM o)
SELECT CAST(m AS BIGINT) AS core_size, coalesce(sum(CASE WHEN i <= m THEN d ELSE 0 END), 0) = m * (m - 1) + coalesce(sum(CASE WHEN i > m THEN d ELSE 0 END), 0) AS is_split FROM o CROSS JOIN c GROUP BY m""", directed=False)

#: Graph size, density and degree range in one row.
summary = Declared(f"""WITH {_DEG}
SELECT CAST(count(*) AS BIGINT) AS n_nodes, CAST((SELECT count(*) FROM {{edges}}) AS BIGINT) AS n_edges, min(d) AS least_degree, round(avg(d), 6) AS mean_degree, max(d) AS largest_degree,
  CAST(sum(CASE WHEN d = 0 THEN 1 ELSE 0 END) AS BIGINT) AS isolated, CAST((SELECT count(*) FROM {{edges}} WHERE src = dst) AS BIGINT) AS loops FROM deg""")
