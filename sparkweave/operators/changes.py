"""Two graphs against each other, and graphs that change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkweave.errors import Invalid
from sparkweave.model import Graph, Plan


def _pair(plan: Plan, first: Graph, second: Graph, **values: object) -> DataFrame:
    if first.directed != second.directed:
        raise Invalid("one graph is directed and the other is not")
    frames = {"a_nodes": first.nodes, "a_edges": first.edges, "b_nodes": second.nodes, "b_edges": second.edges}
    return plan(first.spark, **{k: v for k, v in frames.items() if "{" + k + "}" in plan.text}, **values)


_RULES = {"sum": "coalesce(a.w, 0e0) + coalesce(b.w, 0e0)", "max": "greatest(a.w, b.w)", "min": "least(a.w, b.w)", "first": "coalesce(a.w, b.w)"}


def merge_plan(how: str, rule: str = "sum") -> Plan:
    """Edges of the union, intersection, difference or symmetric difference; clashing weights by ``rule``."""
    if rule not in _RULES:
        raise Invalid(f"'{rule}' is no rule for weights; there are {', '.join(_RULES)}")
    where = {"union": "TRUE", "intersection": "a.src IS NOT NULL AND b.src IS NOT NULL", "difference": "b.src IS NULL", "symmetric": "a.src IS NULL OR b.src IS NULL"}
    if how not in where:
        raise Invalid(f"'{how}' is no way to merge; there are {', '.join(where)}")
    return Plan(f"SELECT coalesce(a.src, b.src) AS src, coalesce(a.dst, b.dst) AS dst, {_RULES[rule]} AS w FROM {{a_edges}} a FULL OUTER JOIN {{b_edges}} b ON a.src = b.src AND a.dst = b.dst WHERE {where[how]}")


def merge(first: Graph, second: Graph, how: str = "union", rule: str = "sum") -> Graph:
    """The merged graph; a difference keeps all nodes of the first, an intersection the common ones."""
    edges = _pair(merge_plan(how, rule), first, second)
    nodes = {"union": first.nodes.union(second.nodes).distinct(), "intersection": first.nodes.intersect(second.nodes), "difference": first.nodes, "symmetric": first.nodes.union(second.nodes).distinct()}[how]
    return Graph(nodes, edges, first.directed)


#: Edges and nodes gained, lost and shared, with similarity and churn.
DIFF = Plan("""WITH e AS (SELECT CASE WHEN a.src IS NULL THEN 1 ELSE 0 END AS gained, CASE WHEN b.src IS NULL THEN 1 ELSE 0 END AS lost FROM {a_edges} a FULL OUTER JOIN {b_edges} b ON a.src = b.src AND a.dst = b.dst),
n AS (SELECT CASE WHEN a.id IS NULL THEN 1 ELSE 0 END AS joined, CASE WHEN b.id IS NULL THEN 1 ELSE 0 END AS gone FROM {a_nodes} a FULL OUTER JOIN {b_nodes} b ON a.id = b.id),
se AS (SELECT coalesce(sum(gained), 0) AS g, coalesce(sum(lost), 0) AS l, count(*) AS m FROM e), sn AS (SELECT coalesce(sum(joined), 0) AS j, coalesce(sum(gone), 0) AS o FROM n)
SELECT CAST(g AS BIGINT) AS edges_added, CAST(l AS BIGINT) AS edges_removed, CAST(m - g - l AS BIGINT) AS edges_shared, CAST(j AS BIGINT) AS nodes_joined, CAST(o AS BIGINT) AS nodes_left,
  round(CASE WHEN m > 0 THEN (m - g - l) / (1e0 * m) ELSE 1e0 END, 6) AS similarity, round(CASE WHEN m > 0 THEN (g + l) / (1e0 * m) ELSE 0e0 END, 6) AS churn FROM se CROSS JOIN sn""")

#: Degrees before and after, over the nodes of both.
SHIFTS = Plan("""WITH x AS (SELECT id, count(*) AS d FROM (SELECT src AS id FROM {a_edges} UNION ALL SELECT dst FROM {a_edges} WHERE src <> dst) t GROUP BY id),
y AS (SELECT id, count(*) AS d FROM (SELECT src AS id FROM {b_edges} UNION ALL SELECT dst FROM {b_edges} WHERE src <> dst) t GROUP BY id)
SELECT coalesce(x.id, y.id) AS id, CAST(coalesce(x.d, 0) AS BIGINT) AS before, CAST(coalesce(y.d, 0) AS BIGINT) AS after, CAST(coalesce(y.d, 0) - coalesce(x.d, 0) AS BIGINT) AS change FROM x FULL OUTER JOIN y ON x.id = y.id""")

#: The sum of differences between the two sorted degree sequences.
DEGREE_GAP = Plan("""WITH x AS (SELECT n.id, count(e.id) AS d FROM {a_nodes} n LEFT JOIN (SELECT src AS id FROM {a_edges} UNION ALL SELECT dst FROM {a_edges} WHERE src <> dst) e ON e.id = n.id GROUP BY n.id),
y AS (SELECT n.id, count(e.id) AS d FROM {b_nodes} n LEFT JOIN (SELECT src AS id FROM {b_edges} UNION ALL SELECT dst FROM {b_edges} WHERE src <> dst) e ON e.id = n.id GROUP BY n.id),
p AS (SELECT d, row_number() OVER (ORDER BY d DESC) AS r FROM x), q AS (SELECT d, row_number() OVER (ORDER BY d DESC) AS r FROM y)
SELECT CAST(coalesce(sum(abs(coalesce(p.d, 0) - coalesce(q.d, 0))), 0) AS BIGINT) AS degree_gap FROM p FULL OUTER JOIN q ON p.r = q.r""")


def diff(before: Graph, after: Graph) -> DataFrame:
    return _pair(DIFF, before, after)


def degree_shifts(before: Graph, after: Graph) -> DataFrame:
    return _pair(SHIFTS, before, after)


def degree_gap(first: Graph, second: Graph) -> DataFrame:
    return _pair(DEGREE_GAP, first, second)


def same_graph(first: Graph, second: Graph) -> bool:
    """Equal kinds, names, edges and weights."""
    return first.directed == second.directed and first.nodes.exceptAll(second.nodes).isEmpty() and second.nodes.exceptAll(first.nodes).isEmpty() and first.edges.exceptAll(second.edges).isEmpty() and second.edges.exceptAll(first.edges).isEmpty()


def relabel(graph: Graph, names: DataFrame) -> Graph:
    """Nodes renamed by ``names(id, new)``; a missing or shared new name is refused."""
    joined = graph.nodes.join(names, "id", "left")
    if not joined.where("new is null").isEmpty():
        raise Invalid("a node has no new name")
    if not joined.groupBy("new").count().where("count > 1").isEmpty():
        raise Invalid("two nodes get one name")
    s, d = names.toDF("src", "a"), names.toDF("dst", "b")
    edges = graph.edges.join(s, "src").join(d, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), "w")
    return Graph.of(edges, graph.directed, joined.select(F.col("new").alias("id")))


#: Names by rank: the largest degree first, then by name.
CANONICAL = Plan("""WITH d AS (SELECT n.id, count(a.dst) AS d FROM {nodes} n LEFT JOIN {arcs} a ON a.src = n.id GROUP BY n.id)
SELECT id, CAST(row_number() OVER (ORDER BY d DESC, id) - 1 AS STRING) AS new FROM d""")


def canonical_names(graph: Graph) -> DataFrame:
    return CANONICAL(graph.spark, nodes=graph.nodes, arcs=graph.arcs)


#: Rules of a contract by name: each gives a row for every breach.
CONTRACT = {
    "no_self_loops": "SELECT 'no_self_loops' AS rule, src AS what FROM {edges} WHERE src = dst",
    "no_isolated": "SELECT 'no_isolated' AS rule, id AS what FROM {nodes} n WHERE NOT EXISTS (SELECT 1 FROM {arcs} a WHERE a.src = n.id OR a.dst = n.id)",
    "weights_between": "SELECT 'weights_between' AS rule, concat(src, ' ', dst) AS what FROM {edges} WHERE w < {low} OR w > {high}",
    "whole_weights": "SELECT 'whole_weights' AS rule, concat(src, ' ', dst) AS what FROM {edges} WHERE w <> floor(w)",
    "at_most": "SELECT 'at_most' AS rule, CAST(count(*) AS STRING) AS what FROM {nodes} HAVING count(*) > {limit}",
}


def validate(graph: Graph, rules: dict[str, dict[str, float]], enforce: bool = False) -> DataFrame:
    """``rule``, ``what`` for every breach of the named rules; ``enforce`` raises on the first."""
    breaches = graph.spark.createDataFrame([], "rule string, what string")
    frames = graph.frames()
    for name, values in rules.items():
        if name not in CONTRACT:
            raise Invalid(f"'{name}' is no rule; there are {', '.join(CONTRACT)}")
        text = CONTRACT[name]
        breaches = breaches.unionByName(graph.spark.sql(text, **{k: v for k, v in frames.items() if "{" + k + "}" in text}, **values))
    if enforce and (first := breaches.orderBy("rule", "what").first()):
        raise Invalid(f"{first['rule']}: {first['what']}")
    return breaches


def fingerprint(graph: Graph) -> DataFrame:
    """``digest``: 16 hex digits over kind, names and edges, from the hashes of the rows; their order does not matter.

    Rows are hashed where they are and the hashes are added in a wide decimal, so no list is gathered.
    """
    wide = "decimal(38,0)"
    n = graph.nodes.agg(F.coalesce(F.sum(F.xxhash64("id").cast(wide)), F.lit(0).cast(wide)).alias("n"))
    e = graph.edges.agg(F.coalesce(F.sum(F.xxhash64("src", "dst", "w").cast(wide)), F.lit(0).cast(wide)).alias("e"))
    return n.crossJoin(e).select(F.substring(F.sha2(F.concat_ws(":", F.lit(str(graph.directed)), "n", "e"), 256), 1, 16).alias("digest"))


#: Snapshots ``steps(snap, src, dst)``: edges kept and nodes that came or went, from each to the next.
SEQUENCE = Plan("""WITH e AS (SELECT DISTINCT snap, src, dst FROM {steps}), n AS (SELECT snap, src AS id FROM e UNION SELECT snap, dst FROM e), s AS (SELECT snap, lead(snap) OVER (ORDER BY snap) AS nxt FROM (SELECT DISTINCT snap FROM e) t),
k AS (SELECT s.snap, count(*) AS total, count(f.src) AS kept FROM s JOIN e ON e.snap = s.snap LEFT JOIN e f ON f.snap = s.nxt AND f.src = e.src AND f.dst = e.dst WHERE s.nxt IS NOT NULL GROUP BY s.snap),
c AS (SELECT s.snap, count(*) AS both, (SELECT count(*) FROM n) AS z FROM s JOIN n x ON x.snap = s.snap JOIN n y ON y.snap = s.nxt AND y.id = x.id GROUP BY s.snap),
m AS (SELECT snap, count(*) AS n FROM n GROUP BY snap)
SELECT s.snap, round(kept / (1e0 * total), 6) AS persistence, CAST(p.n + q.n - 2 * coalesce(c.both, 0) AS BIGINT) AS node_churn
FROM s JOIN k ON k.snap = s.snap JOIN m p ON p.snap = s.snap JOIN m q ON q.snap = s.nxt LEFT JOIN c ON c.snap = s.snap""")

#: Edges that every snapshot has.
CORE = Plan("SELECT src, dst FROM {steps} GROUP BY src, dst HAVING count(DISTINCT snap) = (SELECT count(DISTINCT snap) FROM {steps})")

#: Links ``links(u, v, t0, t1)`` that are open at a moment, ends included.
SNAPSHOT = Plan("SELECT DISTINCT least(u, v) AS src, greatest(u, v) AS dst FROM {links} WHERE t0 <= {at} AND t1 >= {at}")

#: Time that links spend in a window, summed over each pair; links that only touch it are left out, moments inside count 0.
AGGREGATE = Plan("""SELECT least(u, v) AS src, greatest(u, v) AS dst, sum(CAST(least(t1, {hi}) - greatest(t0, {lo}) AS DOUBLE)) AS w FROM {links}
WHERE t0 <= {hi} AND t1 >= {lo} AND (least(t1, {hi}) > greatest(t0, {lo}) OR t0 = t1) GROUP BY 1, 2""")


def earliest_arrival(contacts: DataFrame, source: str, start: float = 0.0, directed: bool = False) -> DataFrame:
    """``id``, ``arrival``: the earliest time at which each node can be reached along contacts (u, v, t0, t1), waiting allowed.

    A contact is usable from the later of its start and the arrival at its
    tail, until its end.  Only nodes whose arrival improved are joined again.
    """
    from sparkweave.session import materialise

    links = contacts.select("u", "v", "t0", "t1")
    if not directed:
        links = links.union(links.select("v", "u", "t0", "t1"))
    spark = contacts.sparkSession
    best = spark.createDataFrame([(source, start)], "id string, arrival double")
    front = best
    while not front.isEmpty():
        step = front.join(links, F.col("id") == F.col("u")).where("arrival <= t1").groupBy("v").agg(F.min(F.greatest("arrival", F.col("t0").cast("double"))).alias("new"))
        front = materialise(step.join(best, F.col("v") == F.col("id"), "left").where("arrival is null or new < arrival").select(F.col("v").alias("id"), F.col("new").alias("arrival")), "front")
        best = materialise(best.join(front.select("id"), "id", "left_anti").unionByName(front), "arrival")
    return best


def replay(log: DataFrame, upto: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (id) and edges (src, dst, w) after the events ``log(seq, kind, a, b, w)`` up to a number.

    The last word on each key counts: an edge lives if it was added after its
    last removal and after the last removal of either end.
    """
    rows = log if upto is None else log.where(F.col("seq") <= upto)
    last = Window.partitionBy("id").orderBy(F.desc("seq"))
    node_events = rows.where("kind in ('add_node', 'remove_node')").select("seq", "kind", F.col("a").alias("id"))
    nodes = node_events.withColumn("r", F.row_number().over(last)).where("r = 1 and kind = 'add_node'").select("id")
    gone = node_events.where("kind = 'remove_node'").groupBy("id").agg(F.max("seq").alias("gone"))
    pair = Window.partitionBy("src", "dst").orderBy(F.desc("seq"))
    edge_events = rows.where("kind in ('add_edge', 'remove_edge')").select("seq", "kind", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "w")
    live = edge_events.withColumn("r", F.row_number().over(pair)).where("r = 1 and kind = 'add_edge'")
    kept = live.join(gone.toDF("src", "g1"), "src", "left").join(gone.toDF("dst", "g2"), "dst", "left").where("seq > coalesce(g1, -1) and seq > coalesce(g2, -1)")
    return nodes, kept.select("src", "dst", F.coalesce("w", F.lit(1.0)).alias("w"))
