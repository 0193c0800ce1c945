"""Queries of communities, searches from both ends, and distances with small or negative weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkweave.model import Graph
from sparkweave.operators import communities as c
from sparkweave.operators import paths as p
from sparkweave.plans.catalogue import register
from sparkweave.plans.travel import _AT, _MIN, hops_sql, relax_sql
from sparkweave.sources.tables import TRADE, TRADE_DAG, TREE, USERS, Source

#: Customers of one nation and segment in full groups of five, each tied to the next by less than chance.
_RUNS = "SELECT c_custkey AS k, c_nationkey AS n, c_mktsegment AS m, CAST(floor((row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) - 1) / 5e0) AS INT) AS q, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS r, count(*) OVER () AS total FROM {customer}"
GROUPS = Source(False, ("customer",), f"""WITH c AS ({_RUNS})
SELECT concat('c', CAST(x.k AS STRING)) AS src, concat('c', CAST(y.k AS STRING)) AS dst, CASE WHEN x.q = y.q THEN 1e0 ELSE 1e0 / x.total END AS w FROM c x JOIN c y ON x.n = y.n AND x.m = y.m
WHERE (x.q = y.q AND x.r < y.r) OR (y.r = x.r + 1 AND x.q <> y.q)""")
#: A group of one hangs on the group before it.
register("louvain_groups", f"""WITH {GROUPS.sql()}, c AS ({_RUNS.format(customer='customer')}), size AS (SELECT n, m, q, count(*) AS s FROM c GROUP BY n, m, q),
home AS (SELECT concat('c', CAST(c.k AS STRING)) AS id, c.n, c.m, CASE WHEN size.s = 1 AND c.q > 0 THEN c.q - 1 ELSE c.q END AS q FROM c JOIN size ON size.n = c.n AND size.m = c.m AND size.q = c.q)
SELECT id, min(id) OVER (PARTITION BY n, m, q) AS community FROM home WHERE id IN (SELECT id FROM nodes)""")(lambda s, d: c.louvain(GROUPS.graph(s, d)))

#: In a tree the routes over an edge join the nodes below it with all others.
_BELOW = f"WITH RECURSIVE {TREE.sql()}, down(id, up) AS (SELECT 'world', CAST(NULL AS STRING) UNION ALL SELECT a.dst, d.id FROM down d JOIN arcs a ON a.src = d.id WHERE a.dst IS DISTINCT FROM d.up), under(id, low) AS (SELECT id, id FROM down UNION ALL SELECT d.up, u.low FROM under u JOIN down d ON d.id = u.id WHERE d.up IS NOT NULL), sized AS (SELECT least(d.id, d.up) AS src, greatest(d.id, d.up) AS dst, CAST(count(*) * ((SELECT count(*) FROM nodes) - count(*)) AS DOUBLE) AS betweenness FROM under u JOIN down d ON d.id = u.id WHERE d.up IS NOT NULL GROUP BY d.id, d.up)"
register("edgebetweenness_tree", f"{_BELOW} SELECT src, dst, round(betweenness, 6) AS betweenness FROM sized")(lambda s, d: c.edge_betweenness(TREE.graph(s, d)))
#: Taking one region's edge leaves the next region's the busiest.
register("girvannewman_tree", f"{_BELOW} SELECT CAST(row_number() OVER (ORDER BY betweenness DESC, src DESC, dst DESC) AS INTEGER) AS step, src, dst FROM sized QUALIFY step <= 3")(lambda s, d: c.girvan_newman(TREE.graph(s, d), 3)[0].select("step", "src", "dst"))


def _ends(graph: Graph) -> tuple[str, str]:
    return tuple(graph.nodes.agg(F.min("id"), F.max("id")).first())


register("bidirectional_hops", hops_sql(USERS, 7) + " SELECT CAST(d AS INTEGER) AS hops FROM hops WHERE origin = (SELECT min(id) FROM nodes) AND id = (SELECT max(id) FROM nodes)")(lambda s, d: (lambda g: c.two_sided(g, *_ends(g)).select("hops"))(USERS.graph(s, d)))

#: Of a digraph without cycles weights may fall below nothing.
_LOWER = "CAST(w AS DOUBLE) - 50e0"


def _lower(graph: Graph) -> Graph:
    return Graph(graph.nodes, graph.edges.withColumn("w", F.col("w") - 50.0), True)


def _pairs_sql(source: Source, weight: str) -> str:
    ends = "struct_pack(o := walk.id.o, i := s.dst)"
    text = relax_sql(source, "SELECT 0, struct_pack(o := id, i := id), 0e0 FROM nodes", *_MIN).replace("CAST(w AS DOUBLE)", weight)
    return text.replace("s.dst, min", f"{ends}, min").replace("ON s.src = walk.id", "ON s.src = walk.id.i").replace("GROUP BY walk.k + 1, s.dst", f"GROUP BY walk.k + 1, {ends}")


register("johnson_pairs", _pairs_sql(TRADE_DAG, _LOWER) + " SELECT id.o AS src, id.i AS dst, d AS dist FROM done")(lambda s, d: p.all_pairs(_lower(TRADE_DAG.graph(s, d)), True))
register("spfa_distances", relax_sql(TRADE_DAG, _AT.format(0), *_MIN).replace("CAST(w AS DOUBLE)", _LOWER) + " SELECT id, d AS dist FROM done")(
    lambda s, d: (lambda g: p.distances(g, _ends(g)[0], allow_negative=True).select("id", "dist"))(_lower(TRADE_DAG.graph(s, d)))
)
register("zeroonebfs_distances", relax_sql(TRADE, _AT.format(0), *_MIN).replace("CAST(w AS DOUBLE)", "CAST(w % 2 AS DOUBLE)") + " SELECT id, d AS dist FROM done")(
    lambda s, d: (lambda g: p.zero_one(Graph(g.nodes, g.edges.withColumn("w", F.col("w") % 2), True), _ends(g)[0]).select("id", "dist"))(TRADE.graph(s, d))
)
