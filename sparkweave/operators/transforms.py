"""New graphs from graphs and from other tables."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkweave.errors import Invalid
from sparkweave.model import Declared, Graph, Plan
from sparkweave.operators.orders import numbered, summed
from sparkweave.session import materialise, share_code, tidy

#: All pairs of nodes without an edge.
complement = Declared("SELECT a.id AS src, b.id AS dst FROM {nodes} a JOIN {nodes} b ON a.id < b.id WHERE NOT EXISTS (SELECT 1 FROM {edges} e WHERE e.src = a.id AND e.dst = b.id)", directed=False)

#: Pairs of edges that share an end: the edges become nodes, named by both ends.
line_graph = Declared("""WITH i AS (SELECT src AS id, src, dst FROM {edges} UNION ALL SELECT dst, src, dst FROM {edges} WHERE src <> dst)
SELECT DISTINCT x.src AS a_src, x.dst AS a_dst, y.src AS b_src, y.dst AS b_dst FROM i x JOIN i y ON x.id = y.id AND (x.src < y.src OR (x.src = y.src AND x.dst < y.dst))""", directed=False)

#: One-mode projection onto the nodes whose name begins with ``side``: shared hubs, plain and by Newman's 1 / (k - 1). ``projection`` gives its rows.
PROJECTION = Declared("""WITH k AS (SELECT src AS hub, count(*) AS k FROM {arcs} WHERE src NOT LIKE '{side}%' GROUP BY src)
SELECT x.dst AS a, y.dst AS b, CAST(count(*) AS BIGINT) AS shared, round(sum(1e0 / (k.k - 1)), 6) AS newman
FROM {arcs} x JOIN {arcs} y ON x.src = y.src AND x.dst < y.dst JOIN k ON k.hub = x.src GROUP BY x.dst, y.dst""".replace("'{side}%'", "{side}"), directed=False)

#: Pairs that one call of ``_counted`` adds up at once, and those of a task of ``shared_hubs``.
PAIRS, TASK_PAIRS = 1 << 20, 10_000_000
#: A part of a long list of neighbours holds at most this many.
PART = 256


def _merged(keys: np.ndarray, shared: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal keys added up, in ascending order."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(shared[order], first), np.add.reduceat(weight[order], first)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of rows ``a``, ``bs``, ``share`` in the order of ``a``; of an ``a`` that goes on the sums so far are kept, one for each partner."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size, most = 0, PAIRS

    def given(keys: np.ndarray, shared: np.ndarray, weight: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(keys), PAIRS):
            part = slice(k, k + PAIRS)
            yield pa.RecordBatch.from_pydict({"a": (keys[part] >> 32).astype(np.int32), "b": (keys[part] & 0xFFFFFFFF).astype(np.int32), "shared": shared[part], "weight": weight[part]})

    for batch in batches:
        if not batch.num_rows:
            continue
        bs = batch["bs"]
        n = np.diff(bs.offsets.to_numpy())
        keys = np.repeat(batch["a"].to_numpy().astype(np.int64) << 32, n) | bs.flatten().to_numpy()
        held.append((keys, np.ones(len(keys), np.int64), np.repeat(batch["share"].to_numpy(), n)))
        size += len(keys)
        if size >= most:
            keys, shared, weight = _merged(*map(np.concatenate, zip(*held)))
            done = np.searchsorted(keys, keys[-1] >> 32 << 32)
            yield from given(keys[:done], shared[:done], weight[:done])
            held, size = [(keys[done:], shared[done:], weight[done:])], len(keys) - done
            # What one node has gathered is looked at again only when it has doubled.
            most = max(PAIRS, 2 * size)
    if size:
        yield from given(*_merged(*map(np.concatenate, zip(*held))))


@tidy
def shared_hubs(ties: DataFrame) -> DataFrame:
    """``a``, ``b``, ``shared``, ``weight``: for any two items of distinct rows ``ties(hub, item)`` their common hubs and the sum of 1 / (k - 1), k being a hub's rows.

    Items are numbered in their order, and a hub sends each of its items one list
    of those after it, in parts, to the task of that item. So rows are as many as
    ties, lists hold four bytes for a pair, and a task adds up its items one after
    the other: it holds the partners of one item, not the pairs of all.
    """
    spark = ties.sparkSession
    share_code(spark)
    ties = materialise(ties.select("hub", "item"), "ties")
    names = materialise(numbered(ties.where("item is not null").select("item").distinct(), "item", name="k").select("item", F.col("k").cast("int").alias("k")), "numbers")
    lists = ties.where("hub is not null").join(names, "item", "left").groupBy("hub").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("k")).alias("items")).where("size(items) > 1")
    lists = materialise(lists.select("items", (1.0 / (F.col("n") - 1)).alias("share")), "lists")
    pairs = lists.agg(F.sum(F.size("items").cast("bigint") * (F.size("items") - 1) / 2)).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(pairs) // TASK_PAIRS + 1)
    later = lists.select("share", "items", F.posexplode("items").alias("i", "a")).where("i + 1 < size(items)")
    parts = later.select("a", "share", "items", F.explode(F.sequence(F.col("i") + 2, F.size("items"), F.lit(PART))).alias("begin"))
    dealt = parts.select("a", "share", F.slice("items", F.col("begin"), PART).alias("bs")).repartition(tasks, "a").sortWithinPartitions("a")
    counted = dealt.mapInArrow(_counted, "a int, b int, shared bigint, weight double")
    found = counted.join(names.toDF("__a", "a"), "a").join(names.toDF("__b", "b"), "b")
    return found.select(F.col("__a").alias("a"), F.col("__b").alias("b"), "shared", "weight")


def projection(graph: Graph, side: str) -> DataFrame:
    """The rows of ``PROJECTION``, no pair of one hub being shuffled by itself; ``side`` is a pattern of LIKE."""
    graph.need(directed=False)
    ties = graph.arcs.where(~F.col("src").like(side)).select(F.col("src").alias("hub"), F.col("dst").alias("item"))
    return shared_hubs(ties).select("a", "b", "shared", F.round("weight", 6).alias("newman"))


#: Sparse Laplacian: weighted degrees on the diagonal, negated weights beside it.
laplacian = Declared("""SELECT n.id AS i, n.id AS j, coalesce(sum(CASE WHEN a.dst <> a.src THEN a.w END), 0e0) AS x FROM {nodes} n LEFT JOIN {arcs} a ON a.src = n.id GROUP BY n.id
UNION ALL SELECT src, dst, -w FROM {arcs} WHERE src <> dst""", directed=False)

#: Trace of the squared and cubed adjacency with what they count.
matrix_traces = Declared("""SELECT CAST((SELECT count(*) FROM {arcs} x JOIN {arcs} y ON y.src = x.dst AND y.dst = x.src) AS BIGINT) AS trace_2,
CAST((SELECT count(*) FROM {arcs} x JOIN {arcs} y ON y.src = x.dst JOIN {arcs} z ON z.src = y.dst AND z.dst = x.src) AS BIGINT) AS trace_3""")

#: Scores of a tournament and its kings, who reach all others in two steps.
tournament = Declared("""WITH s AS (SELECT n.id, count(a.dst) AS score FROM {nodes} n LEFT JOIN {arcs} a ON a.src = n.id GROUP BY n.id),
r AS (SELECT src, dst FROM {arcs} UNION SELECT x.src, y.dst FROM {arcs} x JOIN {arcs} y ON y.src = x.dst WHERE x.src <> y.dst), k AS (SELECT src, count(*) AS n FROM r GROUP BY src)
SELECT s.id, CAST(score AS BIGINT) AS score, coalesce(k.n, 0) = (SELECT count(*) - 1 FROM {nodes}) AS king FROM s LEFT JOIN k ON k.src = s.id""", directed=True)

#: Every tree edge with the sizes of its two sides, whose products add up to the Wiener index.
PRODUCTS = {
    "cartesian": "SELECT e.src AS a, n.id AS b, e.dst AS c, n.id AS d FROM {a_edges} e CROSS JOIN {b_nodes} n UNION ALL SELECT n.id, e.src, n.id, e.dst FROM {b_edges} e CROSS JOIN {a_nodes} n",
    "tensor": "SELECT x.src AS a, y.src AS b, x.dst AS c, y.dst AS d FROM {a_edges} x CROSS JOIN {b_edges} y UNION ALL SELECT x.src, y.dst, x.dst, y.src FROM {a_edges} x CROSS JOIN {b_edges} y",
}
PRODUCTS["strong"] = f"{PRODUCTS['cartesian']} UNION ALL {PRODUCTS['tensor']}"


def product_plan(kind: str) -> Plan:
    """Edges of the Cartesian, tensor or strong product; a node is a pair (a, b), kept as two columns."""
    if kind not in PRODUCTS:
        raise Invalid(f"'{kind}' is no product; there are {', '.join(PRODUCTS)}")
    return Plan(PRODUCTS[kind])


def product(first: Graph, second: Graph, kind: str = "cartesian") -> DataFrame:
    frames = {"a_nodes": first.nodes, "a_edges": first.edges, "b_nodes": second.nodes, "b_edges": second.edges}
    plan = product_plan(kind)
    return plan(first.spark, **{k: v for k, v in frames.items() if "{" + k + "}" in plan.text})


#: Closed intervals ``intervals(name, lo, hi)`` that overlap; both sides are cut into cells of ``cell`` so that the join has a key.
OVERLAPS = Plan("""WITH c AS (SELECT name, lo, hi, CAST(floor(lo / {cell}) AS BIGINT) AS first_cell, CAST(floor(hi / {cell}) AS BIGINT) AS last_cell FROM {intervals})
SELECT least(a.name, b.name) AS src, greatest(a.name, b.name) AS dst FROM c a JOIN c b ON a.name <> b.name AND b.lo BETWEEN a.lo AND a.hi AND (a.lo < b.lo OR a.name < b.name)""")


def interval_graph(spark: SparkSession, intervals: DataFrame, cell: float) -> DataFrame:
    """``src``, ``dst`` of overlapping intervals: each goes to every cell it touches, so the join is on the cell."""
    placed = intervals.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor(F.col("hi") / cell))))
    a, b = placed.toDF("na", "la", "ha", "cell"), placed.toDF("nb", "lb", "hb", "cell")
    # A pair is found in the cell where the later of the two begins.
    pairs = a.join(b, "cell").where("na < nb and lb <= ha and la <= hb").where(F.col("cell") == F.floor(F.greatest("la", "lb") / cell))
    return pairs.select(F.col("na").alias("src"), F.col("nb").alias("dst"))


@tidy
def interval_degrees(intervals: DataFrame) -> DataFrame:
    """``id``, ``degree``: how many other closed intervals ``intervals(name, lo, hi)``, ``lo`` at most ``hi``, each overlaps; those that overlap none are left out.

    Of all intervals those that begin after its end or end before its start
    miss one, so sums over the ends tell how many are left and no pair is made.
    """
    kept = materialise(intervals.where("name is not null and lo is not null and hi is not null"), "intervals")
    ends = kept.select(F.col("lo").alias("x"), F.lit(1).alias("begun"), F.lit(0).alias("ended")).union(kept.select("hi", F.lit(0), F.lit(1)))
    points = ends.groupBy("x").agg(F.sum("begun").alias("begun"), F.sum("ended").alias("ended"))
    upto = summed(points.withColumn("last", F.col("ended")), "x", "begun", "ended")
    begun, ended = upto.select(F.col("x").alias("hi"), "begun"), upto.select(F.col("x").alias("lo"), (F.col("ended") - F.col("last")).alias("ended"))
    return kept.join(begun, "hi").join(ended, "lo").select(F.col("name").alias("id"), (F.col("begun") - F.col("ended") - 1).alias("degree")).where("degree > 0")


#: The largest number of intervals open at once.
DEPTH = Plan("""WITH e AS (SELECT lo AS x, 0 AS kind, 1 AS step FROM {intervals} UNION ALL SELECT hi, 1, -1 FROM {intervals})
SELECT CAST(coalesce(max(d), 0) AS BIGINT) AS depth FROM (SELECT sum(step) OVER (ORDER BY x, kind ROWS UNBOUNDED PRECEDING) AS d FROM e) t""")

#: Pairs of a permutation ``permutation(pos, value)`` in wrong order.
INVERSIONS = Plan("SELECT a.value AS src, b.value AS dst FROM {permutation} a JOIN {permutation} b ON a.pos < b.pos AND a.value > b.value")

#: Rows that one task of ``inversion_count`` takes, at least.
BLOCK = 1 << 14


def _inversions(values: np.ndarray) -> int:
    """Pairs in wrong order, bit by bit of the ranks: ones that stand before zeros of the same higher bits."""
    rank, total = np.argsort(np.argsort(values, kind="stable"), kind="stable"), 0
    for k in range(len(rank).bit_length()):
        placed = rank[np.argsort(rank >> (k + 1), kind="stable")]
        bit = placed >> k & 1
        before = np.cumsum(bit) - bit
        # Ones before the first row of the same higher bits do not count.
        start = np.searchsorted(placed >> (k + 1), placed >> (k + 1))
        total += int((before - before[start])[bit == 0].sum())
    return total


@tidy
def inversion_count(permutation: DataFrame) -> DataFrame:
    """``inversions``: the number of pairs of ``permutation(pos, value)`` in wrong order, no pair being made.

    Places and ranks are cut into blocks.  Pairs within a block of places, and
    pairs of different blocks of places within a block of ranks, are counted in
    a task for each block; all others differ in both blocks, and sums over the
    blocks' sizes count them.  A block has the root of the number of rows, so
    there are no more pairs of blocks than rows.
    """
    spark = permutation.sparkSession
    share_code(spark)
    rows = numbered(permutation.where("pos is not null and value is not null").select("pos", "value"), "pos", "value", name="p")
    rows = numbered(rows, "value", "p", name="v").select("p", "v")
    rows = materialise(rows, "ranks")
    size = max(BLOCK, math.isqrt(rows.count()) + 1)
    rows = rows.select("p", "v", F.expr(f"(p - 1) div {size}").alias("pb"), F.expr(f"(v - 1) div {size}").alias("vb"))

    def within(block: pa.Table) -> pa.Table:
        return pa.table({"n": [_inversions(block["v"].to_numpy()[np.argsort(block["p"].to_numpy())])]})

    def between(block: pa.Table) -> pa.Table:
        return pa.table({"n": [_inversions(block["v"].to_numpy()[np.lexsort((block["v"].to_numpy(), block["pb"].to_numpy()))])]})

    cells = rows.groupBy("pb", "vb").agg(F.count("*").alias("n"))
    grid = rows.select("pb").distinct().crossJoin(rows.select("vb").distinct()).join(cells, ["pb", "vb"], "left").select("pb", "vb", F.coalesce("n", F.lit(0)).alias("n"))
    earlier = grid.withColumn("e", F.coalesce(F.sum("n").over(Window.partitionBy("vb").orderBy("pb").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    greater = F.coalesce(F.sum("e").over(Window.partitionBy("pb").orderBy(F.desc("vb")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    far = earlier.select((F.col("n") * greater).alias("n"))
    counted = rows.select("pb", "p", "v").groupBy("pb").applyInArrow(within, "n bigint").union(rows.select("vb", "pb", "v").groupBy("vb").applyInArrow(between, "n bigint")).union(far)
    return materialise(counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("inversions")), "inversions")


#: Erdos and Gallai's test of a degree list ``degrees(d)``.
GRAPHICAL = Plan("""WITH o AS (SELECT CAST(d AS BIGINT) AS d, row_number() OVER (ORDER BY d DESC) AS k FROM {degrees}),
s AS (SELECT a.k, sum(CASE WHEN b.k <= a.k THEN b.d ELSE 0 END) AS taken, a.k * (a.k - 1) + sum(CASE WHEN b.k > a.k THEN least(b.d, a.k) ELSE 0 END) AS room FROM o a CROSS JOIN o b GROUP BY a.k)
SELECT (SELECT coalesce(sum(d), 0) % 2 = 0 AND coalesce(min(d), 0) >= 0 FROM o) AND NOT EXISTS (SELECT 1 FROM s WHERE taken > room) AS graphical""")


def hypercube(spark: SparkSession, dimension: int) -> DataFrame:
    """``src``, ``dst`` (numbers) that differ in one bit."""
    if not 0 <= dimension <= 40:
        raise Invalid("a hypercube has 0 to 40 dimensions")
    bits = F.sequence(F.lit(0), F.lit(max(dimension - 1, 0)))
    return spark.range(1 << dimension).select(F.col("id").alias("src"), F.explode(bits).alias("b")).select("src", F.expr("src ^ shiftleft(1L, b)").alias("dst")).where("src < dst").where(F.lit(dimension > 0))


def gray_code(spark: SparkSession, dimension: int) -> DataFrame:
    """``position``, ``code``: neighbours in the order differ in one bit."""
    return spark.range(1 << dimension).select(F.col("id").alias("position"), F.expr("id ^ shiftright(id, 1)").alias("code"))


def factory(spark: SparkSession, shape: str, n: int, m: int = 0, prefix: str = "") -> Graph:
    """Named shapes: complete, cycle, path, star, wheel, grid, complete_bipartite, petersen, by arithmetic on ranges."""
    least = {"complete": 1, "cycle": 3, "path": 1, "star": 1, "wheel": 3, "grid": 1, "complete_bipartite": 1, "petersen": 0}
    if shape not in least:
        raise Invalid(f"'{shape}' is no shape; there are {', '.join(least)}")
    if n < least[shape]:
        raise Invalid(f"a {shape} needs a size of at least {least[shape]}")
    one = spark.range(n).select(F.col("id").alias("i"))
    name = lambda c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    rows = {
        "complete": lambda: one.crossJoin(one.toDF("j")).where("i < j"),
        "cycle": lambda: one.select("i", ((F.col("i") + 1) % n).alias("j")),
        "path": lambda: one.where(F.col("i") < n - 1).select("i", (F.col("i") + 1).alias("j")),
        "star": lambda: one.select(F.lit(-1).cast("bigint").alias("i"), F.col("i").alias("j")),
        "wheel": lambda: one.select("i", ((F.col("i") + 1) % n).alias("j")).union(one.select(F.lit(-1).cast("bigint"), "i")),
        "grid": lambda: spark.range(n * n).select(F.col("id").alias("i")).select("i", F.explode(F.array(F.when((F.col("i") % n) < n - 1, F.col("i") + 1), F.when(F.col("i") < n * (n - 1), F.col("i") + n))).alias("j")).where("j is not null"),
        "complete_bipartite": lambda: one.crossJoin(spark.range(m).select((F.col("id") + n).alias("j"))),
        "petersen": lambda: spark.range(5).select(F.explode(F.array(F.struct(F.col("id").alias("i"), ((F.col("id") + 1) % 5).alias("j")), F.struct(F.col("id"), F.col("id") + 5), F.struct(F.col("id") + 5, (F.col("id") + 2) % 5 + 5))).alias("e")).select("e.i", "e.j"),
    }[shape]()
    hub = F.lit(f"{prefix}hub")
    named = rows.select(F.when(F.col("i") < 0, hub).otherwise(name("i")).alias("src"), name("j").alias("dst"))
    extra = spark.range(n * n if shape == "grid" else n).select(name("id").alias("id")) if shape not in ("petersen",) else None
    return Graph.of(named, False, extra)
