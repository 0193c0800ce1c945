"""Queries of iterative scores and of cohesion."""

from __future__ import annotations

from sparkweave.operators import blocks as b
from sparkweave.operators import cohesion as c
from sparkweave.operators import ranking as r
from sparkweave.plans.catalogue import register
from sparkweave.plans.travel import hops_sql
from sparkweave.sources.tables import CHAINS, MARKETS, PURCHASES, TRADE, TRADE_TIES, TREE, TURNS, USERS, Source


def rank_sql(source: Source, home: str, rounds: int) -> str:
    """PageRank after ``rounds`` rounds; ``home`` gives (id, h). Dangling mass goes through rows to every home."""
    return f"""WITH RECURSIVE {source.sql()}, home AS ({home}), outs AS (SELECT src, count(*) AS k FROM arcs GROUP BY src),
flow AS (SELECT a.src, a.dst, 1e0 / o.k AS p FROM arcs a JOIN outs o ON o.src = a.src UNION ALL SELECT n.id, h.id, h.h FROM nodes n CROSS JOIN home h WHERE n.id NOT IN (SELECT src FROM outs)),
walk(k, id, x) AS (SELECT 0, n.id, coalesce(h.h, 0e0) FROM nodes n LEFT JOIN home h ON h.id = n.id
  UNION ALL SELECT y.k, y.id, sum(y.x) FROM (SELECT w.k + 1 AS k, f.dst AS id, 0.85e0 * w.x * f.p AS x FROM walk w JOIN (SELECT src, dst, p FROM flow) f ON f.src = w.id WHERE w.k < {rounds}
    UNION ALL SELECT w.k + 1, h.id, 0.15e0 * w.x * h.h FROM walk w CROSS JOIN home h WHERE w.k < {rounds}) y GROUP BY y.k, y.id)
SELECT n.id, round(coalesce(w.x, 0e0), 6) AS rank FROM nodes n LEFT JOIN walk w ON w.id = n.id AND w.k = {rounds}"""


_SPREAD = ", low(id, component) AS (SELECT id, id FROM nodes UNION SELECT a.dst, low.component FROM low JOIN (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges) a ON a.src = low.id)"
_OFF = ", off(gs, gd, id) AS (SELECT src, dst, src FROM edges UNION SELECT o.gs, o.gd, a.dst FROM off o JOIN arcs a ON a.src = o.id WHERE NOT (least(a.src, a.dst) = o.gs AND greatest(a.src, a.dst) = o.gd)), ring AS (SELECT DISTINCT gs AS src, gd AS dst FROM off WHERE id = gd)"
_REACH = ", reach(src, dst) AS (SELECT id, id FROM nodes UNION SELECT reach.src, a.dst FROM reach JOIN arcs a ON a.src = reach.dst), strong AS (SELECT x.src AS id, min(x.dst) AS component FROM reach x JOIN reach y ON y.src = x.dst AND y.dst = x.src GROUP BY x.src)"

register("pagerank_users", rank_sql(USERS, "SELECT id, 1e0 / (SELECT count(*) FROM nodes) AS h FROM nodes", 20))(lambda s, d: r.pagerank(USERS.graph(s, d), rounds=20))
register("personalizedpagerank_users", rank_sql(USERS, "SELECT id, 0.5e0 AS h FROM nodes WHERE id IN ('1', '2')", 20))(lambda s, d: r.pagerank(USERS.graph(s, d), s.createDataFrame([("1",), ("2",)], "id string"), rounds=20))
register("hits_users")(lambda s, d: r.hits(USERS.graph(s, d), rounds=15))
register("katz_users", f"""WITH RECURSIVE {USERS.sql()}, walk(k, id, x) AS (SELECT 0, id, 1e0 FROM nodes UNION ALL SELECT y.k, y.id, sum(y.x) FROM (SELECT w.k + 1 AS k, a.dst AS id, 0.01e0 * w.x AS x FROM walk w JOIN arcs a ON a.src = w.id WHERE w.k < 15
  UNION ALL SELECT DISTINCT w.k + 1, n.id, 1e0 FROM walk w CROSS JOIN nodes n WHERE w.k < 15) y GROUP BY y.k, y.id)
SELECT id, round(x / (SELECT sqrt(sum(x * x)) FROM walk WHERE k = 15), 6) AS katz FROM walk WHERE k = 15""")(lambda s, d: r.katz(USERS.graph(s, d), alpha=0.01, rounds=15, guard=False))
register("eigenvector_trade")(lambda s, d: r.eigenvector(TRADE_TIES.graph(s, d), rounds=30))
register("simrank_trade", f"""WITH RECURSIVE {TRADE.sql()}, ins AS (SELECT dst AS id, count(*) AS k FROM arcs GROUP BY dst),
walk(k, a, b, s) AS (SELECT 0, id, id, 1e0 FROM nodes UNION ALL SELECT y.k, y.a, y.b, sum(y.s) FROM (SELECT w.k + 1 AS k, p.dst AS a, q.dst AS b, 0.8e0 * w.s / (i.k * j.k) AS s
  FROM walk w JOIN arcs p ON p.src = w.a JOIN arcs q ON q.src = w.b JOIN ins i ON i.id = p.dst JOIN ins j ON j.id = q.dst WHERE p.dst <> q.dst AND w.k < 4
  UNION ALL SELECT DISTINCT w.k + 1, n.id, n.id, 1e0 FROM walk w CROSS JOIN nodes n WHERE w.k < 4) y GROUP BY y.k, y.a, y.b)
SELECT a, b, round(s, 6) AS simrank FROM walk WHERE k = 4 AND a < b""")(lambda s, d: r.simrank(TRADE.graph(s, d), rounds=4))
register("walkcount_three", f"WITH {USERS.sql()} SELECT x.src, z.dst, CAST(count(*) AS BIGINT) AS walks FROM arcs x JOIN arcs y ON y.src = x.dst JOIN arcs z ON z.src = y.dst GROUP BY x.src, z.dst")(lambda s, d: r.walk_counts(USERS.graph(s, d), 3))
register("walkkernel_trade")(lambda s, d: s.createDataFrame([(round(r.walk_kernel(TREE.graph(s, d), MARKETS.graph(s, d), depth=4), 6),)], "kernel double"))
register("connectedcomponents_purchases", f"WITH RECURSIVE {PURCHASES.sql()}, first(id) AS (SELECT min(id) FROM nodes UNION SELECT a.dst FROM first f JOIN arcs a ON a.src = f.id) SELECT n.id, CASE WHEN f.id IS NOT NULL THEN (SELECT min(id) FROM first) END AS component FROM nodes n LEFT JOIN first f ON f.id = n.id")(lambda s, d: c.components(PURCHASES.graph(s, d)))
register("connectedcomponents_chains", f"WITH RECURSIVE {CHAINS.sql()}{_SPREAD} SELECT id, min(component) AS component FROM low GROUP BY id")(lambda s, d: c.components(CHAINS.graph(s, d)))
register("weaklyconnected_turns", f"WITH RECURSIVE {TURNS.sql()}{_SPREAD} SELECT id, min(component) AS component FROM low GROUP BY id")(lambda s, d: c.components(TURNS.graph(s, d)))
register("tarjanscc_trade", f"WITH RECURSIVE {TRADE.sql()}{_REACH} SELECT id, component FROM strong")(lambda s, d: c.strong_components(TRADE.graph(s, d)))
register("kosarajuscc_turns", f"WITH RECURSIVE {TURNS.sql()}{_REACH} SELECT id, component FROM strong")(lambda s, d: c.strong_components(TURNS.graph(s, d)))
register("condensation_trade", f"WITH RECURSIVE {TRADE.sql()}{_REACH} SELECT x.component AS src, y.component AS dst, CAST(count(*) AS BIGINT) AS n_arcs FROM edges e JOIN strong x ON x.id = e.src JOIN strong y ON y.id = e.dst WHERE x.component <> y.component GROUP BY x.component, y.component")(lambda s, d: c.condensation(TRADE.graph(s, d)))
register("bipartite_tree", hops_sql(TREE) + ", root AS (SELECT min(id) AS id FROM nodes) SELECT h.id, root.id AS component, CAST(CAST(h.d AS BIGINT) % 2 AS INTEGER) AS side, FALSE AS odd FROM hops h JOIN root ON root.id = h.origin")(lambda s, d: c.two_colouring(TREE.graph(s, d)))
register("kcore_trade")(lambda s, d: c.core_numbers(TRADE_TIES.graph(s, d)))
register("kcore_purchases")(lambda s, d: c.core_numbers(PURCHASES.graph(s, d)))
register("ktruss_trade")(lambda s, d: c.truss_numbers(TRADE_TIES.graph(s, d)))
register("bipartite_chains", f"WITH RECURSIVE {CHAINS.sql()}{_SPREAD}, root AS (SELECT id, min(component) AS component FROM low GROUP BY id), par(id, p) AS (SELECT id, 0 FROM root WHERE id = component UNION SELECT a.dst, 1 - par.p FROM par JOIN arcs a ON a.src = par.id), met AS (SELECT r.component FROM par JOIN root r ON r.id = par.id GROUP BY r.component, r.id HAVING count(*) > 1) SELECT id, component, component IN (SELECT component FROM met) AS odd FROM root")(lambda s, d: c.two_colouring(CHAINS.graph(s, d)).select("id", "component", "odd"))
register("boruvka_tree", f"WITH {TREE.sql()} SELECT src, dst, w FROM edges")(lambda s, d: c.spanning_forest(TREE.graph(s, d)))
_HEAVIEST = f"WITH RECURSIVE {CHAINS.sql()}{_OFF}{_SPREAD}, name AS (SELECT id, min(component) AS component FROM low GROUP BY id), heavy AS (SELECT n.component, max(row(e.w, e.src, e.dst)) AS e, max(e.w) AS top, list_sort(list(e.w), 'DESC')[2] AS next FROM ring r JOIN edges e ON e.src = r.src AND e.dst = r.dst JOIN name n ON n.id = r.src GROUP BY n.component)"
register("kruskal_chains", f"{_HEAVIEST} SELECT src, dst, w FROM edges WHERE row(w, src, dst) NOT IN (SELECT e FROM heavy)")(lambda s, d: c.spanning_forest(CHAINS.graph(s, d)))
register("reversedelete_chains", f"{_HEAVIEST} SELECT src, dst, w FROM edges WHERE row(w, src, dst) IN (SELECT e FROM heavy)")(lambda s, d: (lambda g: g.edges.join(c.spanning_forest(g), ["src", "dst"], "left_anti").select("src", "dst", "w"))(CHAINS.graph(s, d)))
register("secondbestmst_chains", f"{_HEAVIEST}, first AS (SELECT (SELECT sum(w) FROM edges) - (SELECT sum(top) FROM heavy) AS f) SELECT round(f, 6) AS first, round(f + (SELECT min(top - next) FROM heavy), 6) AS second FROM first")(lambda s, d: b.second_tree(CHAINS.graph(s, d)))
register("kruskal_trade")(lambda s, d: c.spanning_forest(TRADE_TIES.graph(s, d)))
_LOST = ", walk(gone, id, low) AS (SELECT g.id, n.id, n.id FROM nodes g JOIN nodes n ON n.id <> g.id UNION SELECT w.gone, a.dst, w.low FROM walk w JOIN arcs a ON a.src = w.id WHERE a.dst <> w.gone), piece AS (SELECT gone, id, min(low) AS low FROM walk GROUP BY gone, id)"
register("articulation_nodes", f"WITH RECURSIVE {TREE.sql()}{_LOST} SELECT gone AS id FROM piece GROUP BY gone HAVING count(DISTINCT low) > 1")(lambda s, d: b.cut_nodes(TREE.graph(s, d)))
register("twoedgeconnected_trade", f"WITH RECURSIVE {TRADE_TIES.sql()}{_OFF}, low(id, component) AS (SELECT id, id FROM nodes UNION SELECT a.dst, low.component FROM low JOIN (SELECT src, dst FROM ring UNION SELECT dst, src FROM ring) a ON a.src = low.id) SELECT id, min(component) AS component FROM low GROUP BY id")(lambda s, d: b.two_edge_components(TRADE_TIES.graph(s, d)))
register("cyclebasis_number", f"WITH RECURSIVE {TRADE_TIES.sql()}{_SPREAD}, n AS (SELECT count(*) AS n FROM nodes), m AS (SELECT count(*) AS m FROM edges), k AS (SELECT count(DISTINCT c) AS k FROM (SELECT id, min(component) AS c FROM low GROUP BY id)) SELECT CAST(n AS BIGINT) AS n_nodes, CAST(m AS BIGINT) AS n_edges, CAST(k AS BIGINT) AS n_components, CAST(m - n + k AS BIGINT) AS cyclomatic FROM n, m, k")(lambda s, d: c.cyclomatic(TRADE_TIES.graph(s, d)))
register("eulerian_tree", f"WITH {TREE.sql()}, g AS (SELECT src, count(*) AS d FROM arcs GROUP BY src) SELECT CAST(count(CASE WHEN d % 2 = 1 THEN 1 END) AS BIGINT) AS odd_nodes, count(CASE WHEN d % 2 = 1 THEN 1 END) = 0 AS circuit, count(CASE WHEN d % 2 = 1 THEN 1 END) IN (0, 2) AS trail FROM g")(lambda s, d: c.eulerian(TREE.graph(s, d)))
register("eulerdirected_trade")(lambda s, d: c.eulerian(TRADE.graph(s, d)))
register("labelpropagation_markets")(lambda s, d: c.label_propagation(MARKETS.graph(s, d)))
register("cliquepercolation_trade")(lambda s, d: c.clique_percolation(TRADE_TIES.graph(s, d), 3))
_WL = "{c} AS (SELECT n.id, substr(sha256({p}.c || '|' || coalesce(string_agg(q.c, ',' ORDER BY q.c), '')), 1, 16) AS c FROM nodes n JOIN {p} ON {p}.id = n.id LEFT JOIN arcs a ON a.src = n.id LEFT JOIN {p} q ON q.id = a.dst GROUP BY n.id, {p}.c)"
register("wlhash_digest", f"WITH {PURCHASES.sql()}, c0 AS (SELECT n.id, substr(sha256('deg:' || CAST(count(a.dst) AS STRING)), 1, 16) AS c FROM nodes n LEFT JOIN arcs a ON a.src = n.id GROUP BY n.id), {_WL.format(c='c1', p='c0')}, {_WL.format(c='c2', p='c1')}, {_WL.format(c='c3', p='c2')} SELECT substr(sha256((SELECT CAST(count(*) AS STRING) FROM nodes) || ':' || (SELECT CAST(count(*) AS STRING) FROM edges) || ':' || string_agg(c, ',' ORDER BY c)), 1, 16) AS digest FROM c3")(lambda s, d: c.weisfeiler_lehman(PURCHASES.graph(s, d)))
