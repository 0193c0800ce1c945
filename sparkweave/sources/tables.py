"""Graphs derived from relational tables, each one query over whole tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from sparkweave.model import Graph


@dataclass(frozen=True)
class Source:
    """``text`` gives (src, dst, w) from the named tables.

    ``plan``, where given, is the same rows for Spark, stated so that every join has whole keys
    and no table is shuffled twice.  ``once`` says that no pair of ends comes twice.  A ``brief``
    graph is as large at every size of the tables, so it is written, and derived only once.
    """

    directed: bool
    tables: tuple[str, ...]
    text: str
    plan: str | None = None
    once: bool = False
    brief: bool = False

    def graph(self, spark: SparkSession, sf_dir: str) -> Graph:
        frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in self.tables}
        found = Graph.of(spark.sql(self.plan or self.text, **frames), self.directed, once=self.once)
        return found.written() if self.brief else found

    def sql(self) -> str:
        """Common table expressions ``nodes``, ``edges``, ``arcs`` of the same graph."""
        rows = self.text.format(**{t: t for t in self.tables})
        ends = "src, dst" if self.directed else "least(src, dst) AS src, greatest(src, dst) AS dst"
        arcs = "SELECT src, dst, w FROM edges" + ("" if self.directed else " UNION ALL SELECT dst, src, w FROM edges WHERE src <> dst")
        return f"""source_rows AS ({rows}),
edges AS (SELECT src, dst, max(w) AS w FROM (SELECT {ends}, w FROM source_rows) GROUP BY src, dst),
nodes AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges), arcs AS ({arcs})"""


_FLOW = """flow AS (SELECT CAST(c.c_nationkey AS STRING) AS src, CAST(s.s_nationkey AS STRING) AS dst, CAST(count(*) AS DOUBLE) AS w
  FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {supplier} s ON l.l_suppkey = s.s_suppkey
  WHERE c.c_nationkey <> s.s_nationkey GROUP BY c.c_nationkey, s.s_nationkey)"""
#: The same rows: a line has its supplier's nation before it meets its order, which has its customer's, so lines are shuffled once.
_FLOW_PLAN = """flow AS (SELECT CAST(o.n AS STRING) AS src, CAST(l.n AS STRING) AS dst, CAST(count(*) AS DOUBLE) AS w
  FROM (SELECT l_orderkey AS k, s_nationkey AS n FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey) l JOIN (SELECT o_orderkey AS k, c_nationkey AS n FROM {orders} JOIN {customer} ON o_custkey = c_custkey) o ON l.k = o.k
  WHERE o.n <> l.n GROUP BY o.n, l.n)"""
_FLOW_TABLES = ("lineitem", "orders", "customer", "supplier")



def _top(rows: str, share: float, where: str = "TRUE") -> str:
    """The ``share`` of the rows of a table with the largest weights, ties by name: as many at every size of the data."""
    return f"SELECT src, dst, w FROM (SELECT *, row_number() OVER (ORDER BY w DESC, src, dst) AS place, count(*) OVER () AS n FROM {rows}) AS ranked WHERE place <= {share}e0 * n AND {where}"


#: Nations joined by what customers of one buy from suppliers of the other: the largest 27 in 100 of the (at most 600) flows.
_TRADE = _top("flow", 0.27)
TRADE = Source(True, _FLOW_TABLES, f"WITH {_FLOW} {_TRADE}", f"WITH {_FLOW_PLAN} {_TRADE}", brief=True)
_TIES = f"ties AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, sum(w) AS w FROM flow GROUP BY 1, 2) {_top('ties', 0.29)}"
TRADE_TIES = Source(False, _FLOW_TABLES, f"WITH {_FLOW}, {_TIES}", f"WITH {_FLOW_PLAN}, {_TIES}", brief=True)
#: Upstream arcs of the same trade: from the smaller nation key to the larger, so there is no cycle.
_DAG = _top("flow", 0.27, "CAST(src AS INT) < CAST(dst AS INT)")
TRADE_DAG = Source(True, _FLOW_TABLES, f"WITH {_FLOW} {_DAG}", f"WITH {_FLOW_PLAN} {_DAG}", brief=True)
#: Customers of one nation and segment in runs of five; of four runs one closes a triangle and one a square, so there are many components, bridges and cycles.
CHAINS = Source(False, ("customer",), """WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, c_mktsegment AS m, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS r FROM {customer})
SELECT concat('c', CAST(x.k AS STRING)) AS src, concat('c', CAST(y.k AS STRING)) AS dst, 1.0e0 + (x.k * 31 + y.k * 17) % 101 AS w FROM c x JOIN c y ON x.n = y.n AND x.m = y.m
WHERE (y.r = x.r + 1 AND x.r % 5 <> 0) OR (x.r % 20 = 1 AND y.r = x.r + 2) OR (x.r % 20 = 6 AND y.r = x.r + 3)""",
# The place of the other end is a key of the join, so no two customers of a run are compared in vain.
plan="""WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, c_mktsegment AS m, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS r FROM {customer}),
x AS (SELECT k, n, m, explode(filter(array(CASE WHEN r % 5 <> 0 THEN r + 1 END, CASE WHEN r % 20 = 1 THEN r + 2 END, CASE WHEN r % 20 = 6 THEN r + 3 END), t -> t IS NOT NULL)) AS r FROM c)
SELECT concat('c', CAST(x.k AS STRING)) AS src, concat('c', CAST(y.k AS STRING)) AS dst, 1.0e0 + (x.k * 31 + y.k * 17) % 101 AS w FROM x JOIN c y ON x.n = y.n AND x.m = y.m AND x.r = y.r""")
#: Regions and market segments, tied where a region has at least as many customers in a segment as the mean: two sides.
SEGMENTS = Source(False, ("nation", "customer"), """WITH s AS (SELECT n.n_regionkey AS x, c.c_mktsegment AS y, CAST(count(*) AS DOUBLE) AS w FROM {customer} c JOIN {nation} n ON n.n_nationkey = c.c_nationkey GROUP BY n.n_regionkey, c.c_mktsegment)
SELECT concat('r', CAST(x AS STRING)) AS src, y AS dst, w FROM s WHERE w >= (SELECT avg(w) FROM s)""")
#: Users who act one after the other on the same day.
USERS = Source(True, ("events",), """WITH o AS (SELECT user_id, lead(user_id) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS nxt FROM {events})
SELECT CAST(user_id AS STRING) AS src, CAST(nxt AS STRING) AS dst, CAST(count(*) AS DOUBLE) AS w FROM o WHERE nxt IS NOT NULL AND user_id <> nxt GROUP BY user_id, nxt""")
#: Customers and the suppliers whose goods they bought.
PURCHASES = Source(False, ("lineitem", "orders"), """SELECT concat('c', CAST(o.o_custkey AS STRING)) AS src, concat('s', CAST(l.l_suppkey AS STRING)) AS dst, CAST(count(*) AS DOUBLE) AS w
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey GROUP BY o.o_custkey, l.l_suppkey""", once=True)
#: A root, its regions, and their nations.
TREE = Source(False, ("region", "nation"), """SELECT 'world' AS src, concat('r', CAST(r_regionkey AS STRING)) AS dst, 1.0e0 AS w FROM {region}
UNION ALL SELECT concat('r', CAST(n_regionkey AS STRING)), concat('n', CAST(n_nationkey AS STRING)), 1.0e0 + n_nationkey FROM {nation}""")
#: Turns of conversations, each pointing to the next.
TURNS = Source(True, ("conversations",), """SELECT concat(CAST(a.conv_id AS STRING), ':', CAST(a.turn AS STRING)) AS src, concat(CAST(b.conv_id AS STRING), ':', CAST(b.turn AS STRING)) AS dst, 1.0e0 AS w
FROM {conversations} a JOIN {conversations} b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.conv_id IS NOT NULL""")
#: Ten nodes for exact enumeration: regions and market segments, tied where customers are many, and regions by trade.
_RR = """rr AS (SELECT least(a.n_regionkey, b.n_regionkey) AS x, greatest(a.n_regionkey, b.n_regionkey) AS y, CAST(count(*) AS DOUBLE) AS w
  FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {supplier} s ON l.l_suppkey = s.s_suppkey
  JOIN {nation} a ON a.n_nationkey = c.c_nationkey JOIN {nation} b ON b.n_nationkey = s.s_nationkey WHERE a.n_regionkey <> b.n_regionkey GROUP BY 1, 2)"""
_RR_PLAN = """rr AS (SELECT least(o.r, l.r) AS x, greatest(o.r, l.r) AS y, CAST(count(*) AS DOUBLE) AS w
  FROM (SELECT l_orderkey AS k, n_regionkey AS r FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON n_nationkey = s_nationkey) l
  JOIN (SELECT o_orderkey AS k, n_regionkey AS r FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON n_nationkey = c_nationkey) o ON l.k = o.k WHERE o.r <> l.r GROUP BY 1, 2)"""
_MARKETS = """rs AS (SELECT n.n_regionkey AS x, c.c_mktsegment AS y, CAST(count(*) AS DOUBLE) AS w FROM {customer} c JOIN {nation} n ON n.n_nationkey = c.c_nationkey GROUP BY n.n_regionkey, c.c_mktsegment)
SELECT concat('r', CAST(x AS STRING)) AS src, concat('r', CAST(y AS STRING)) AS dst, w FROM rr WHERE w >= (SELECT avg(w) FROM rr)
UNION ALL SELECT concat('r', CAST(x AS STRING)), y, w FROM rs WHERE w >= (SELECT avg(w) FROM rs)"""
MARKETS = Source(False, (*_FLOW_TABLES, "nation", "region"), f"WITH {_RR},\n{_MARKETS}", f"WITH {_RR_PLAN},\n{_MARKETS}", brief=True)
