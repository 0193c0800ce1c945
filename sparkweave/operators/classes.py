"""Greedy colouring, graph classes by forbidden parts, and the comparison of partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkweave.model import Declared, Graph, Plan
from sparkweave.session import discard, materialise, tidy


@tidy
def colouring(graph: Graph) -> DataFrame:
    """``id``, ``colour`` (from 0): the greedy colouring in the order of falling degree, then name.

    A node is coloured in the round in which all its neighbours before it in
    that order are, so many are coloured at once and the result is the
    sequential one.
    """
    graph = graph.written()
    graph.need(directed=False)
    arcs = graph.arcs.where("src <> dst").select("src", "dst")
    degree = materialise(graph.nodes.join(arcs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d")), "id", "left").select("id", F.coalesce("d", F.lit(0)).alias("d")), "degrees")
    both = arcs.join(degree.toDF("src", "ds"), "src").join(degree.toDF("dst", "dd"), "dst")
    before = materialise(both.where("dd > ds or (dd = ds and dst < src)").select(F.col("src").alias("id"), F.col("dst").alias("earlier")), "before")
    done = graph.spark.createDataFrame([], "id string, colour bigint")
    left = degree.select("id")
    while True:
        waits = before.join(left.withColumnRenamed("id", "earlier"), "earlier", "left_semi").select("id")
        ready = left.join(waits, "id", "left_anti")
        used = before.join(ready, "id", "left_semi").join(done.withColumnRenamed("id", "earlier"), "earlier").select("id", "colour").distinct()
        # In a sorted run of colours the smallest missing one is how many stand at their own place.
        nth = F.row_number().over(Window.partitionBy("id").orderBy("colour")) - 1
        taken = used.withColumn("nth", nth).where("colour = nth").groupBy("id").agg(F.count("*").alias("colour"))
        new = materialise(ready.join(taken, "id", "left").select("id", F.coalesce("colour", F.lit(0)).cast("bigint").alias("colour")), "colours")
        if new.isEmpty():
            return done
        done, left = done.unionByName(new), materialise(left.join(new, "id", "left_anti"), "left")


@tidy
def elimination(graph: Graph) -> DataFrame:
    """``id``, ``round``, ``ahead``: nodes whose neighbours are all joined leave, round by round, with their neighbours left; the others stay out.

    A component is chordal if all its nodes leave; its clique number is then the greatest ``ahead`` and one.
    """
    graph = graph.written()
    graph.need(directed=False)
    edges = materialise(graph.edges.where("src <> dst").select("src", "dst"), "edges")
    nodes, out, k = materialise(graph.nodes, "nodes"), None, 0
    while True:
        arcs = edges.union(edges.select("dst", "src"))
        degree = arcs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d"))
        closed = edges.join(arcs.toDF("src", "via"), "src").join(arcs.toDF("dst", "via"), ["dst", "via"]).groupBy(F.col("via").alias("id")).agg(F.count("*").alias("t"))
        all_ = nodes.join(degree, "id", "left").join(closed, "id", "left").select("id", F.coalesce("d", F.lit(0)).alias("d"), F.coalesce("t", F.lit(0)).alias("t"))
        gone = materialise(all_.where("2 * t = d * (d - 1)").select("id", F.lit(k).alias("round"), F.col("d").alias("ahead")), "gone")
        if gone.isEmpty():
            return out if out is not None else gone
        out = gone if out is None else out.unionByName(gone)
        ids = gone.select("id")
        new = materialise(edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"), "edges")
        nodes, k = materialise(nodes.join(ids, "id", "left_anti"), "nodes"), k + 1
        discard(graph.spark, edges)
        edges = new


#: Ways a-b-c-d without another edge among the four; there is none in a cograph.
INDUCED_PATHS = Declared(
    "SELECT x.src AS a, x.dst AS b, y.dst AS c, z0.dst AS d FROM {arcs} x JOIN {arcs} y ON y.src = x.dst JOIN {arcs} z0 ON z0.src = y.dst "
    "LEFT ANTI JOIN {arcs} p ON p.src = x.src AND p.dst = y.dst LEFT ANTI JOIN {arcs} q ON q.src = x.dst AND q.dst = z0.dst LEFT ANTI JOIN {arcs} r ON r.src = x.src AND r.dst = z0.dst "
    "WHERE x.src < z0.dst AND x.src <> y.dst AND x.dst <> z0.dst AND x.src <> x.dst AND y.src <> y.dst AND z0.src <> z0.dst",
    directed=False,
)
#: Two edges a-b and c-d with neither a-c nor b-d; there is none in a threshold graph.
ALTERNATING = Declared(
    "SELECT x.src AS a, x.dst AS b, y.src AS c, y.dst AS d FROM {arcs} x JOIN {arcs} y ON x.src < y.src AND x.dst <> y.dst AND x.src <> y.dst AND x.dst <> y.src "
    "LEFT ANTI JOIN {arcs} p ON p.src = x.src AND p.dst = y.src LEFT ANTI JOIN {arcs} q ON q.src = x.dst AND q.dst = y.dst WHERE x.src <> x.dst AND y.src <> y.dst",
    directed=False,
)

#: Two partitions of the same names, ``pairs(id, a, b)``: shares of agreeing pairs, and mutual information over the mean entropy.
PARTITIONS = Plan(
    """WITH cell AS (SELECT a, b, CAST(count(*) AS DOUBLE) AS n FROM {pairs} GROUP BY a, b),
ra AS (SELECT a, sum(n) AS n FROM cell GROUP BY a), rb AS (SELECT b, sum(n) AS n FROM cell GROUP BY b),
s AS (SELECT (SELECT sum(n) FROM cell) AS n, (SELECT sum(n * (n - 1) / 2) FROM cell) AS same, (SELECT sum(n * (n - 1) / 2) FROM ra) AS pa, (SELECT sum(n * (n - 1) / 2) FROM rb) AS pb),
e AS (SELECT s.*, (SELECT -sum(r.n / s.n * ln(r.n / s.n)) FROM ra r CROSS JOIN s) AS ha, (SELECT -sum(r.n / s.n * ln(r.n / s.n)) FROM rb r CROSS JOIN s) AS hb,
  (SELECT sum(c.n / s.n * ln(c.n * s.n / (x.n * y.n))) FROM cell c JOIN ra x ON x.a = c.a JOIN rb y ON y.b = c.b CROSS JOIN s) AS mi FROM s)
SELECT round(1 - (pa + pb - 2 * same) / (n * (n - 1) / 2), 6) AS rand, round(CASE WHEN pa + pb = same THEN 1.0e0 ELSE same / (pa + pb - same) END, 6) AS jaccard,
round(CASE WHEN ha + hb = 0 THEN 1.0e0 ELSE 2 * mi / (ha + hb) END, 6) AS nmi FROM e"""
)
