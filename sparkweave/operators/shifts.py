"""Edge colouring: every edge gets a shift in which neither of its ends has another edge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.errors import Invalid
from sparkweave.model import Graph
from sparkweave.operators.cohesion import two_colouring
from sparkweave.operators.orders import numbered
from sparkweave.plans.components import star_components
from sparkweave.session import discard, materialise, tidy

#: Rounds of free shifts go on while a round places one in so many of the edges that are left.
SLOW = 10
#: Rounds that may place nothing, on other shifts each, before one is added.
PATIENCE = 4
_ENDS = ["src", "dst"]


def _ends(edges: DataFrame) -> DataFrame:
    """``node`` and ``edges``' columns, a row for each end."""
    return edges.select(F.col("src").alias("node"), *edges.columns).unionByName(edges.select(F.col("dst").alias("node"), *edges.columns))


def _turns(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``turn``, from 0, within their node; nodes are never gathered, whatever their number of rows."""
    placed = numbered(rows, "node", *order)
    first = placed.groupBy("node").agg(F.min("place").alias("first"))
    return placed.join(first, "node").withColumn("turn", F.col("place") - F.col("first")).drop("place", "first")


def _offers(left: DataFrame, done: DataFrame, shifts: int, step: int) -> DataFrame:
    """``src``, ``dst``, ``tight``, ``a``, ``b``: for every edge left a shift of ``shifts`` free at ``src`` and one free at ``dst``.

    The edges left at a node are offered free shifts of its own, one after the
    other from one drawn for the node and the step.  The k-th free shift is k
    and the shifts taken that have no more than k free ones before them.
    """
    taken = _ends(done).groupBy("node").agg(F.count("*").alias("taken"))
    lots = _ends(left.select(*_ENDS)).withColumn("lot", F.xxhash64(F.lit(step), "src", "dst", "node"))
    nodes = lots.groupBy("node").agg(F.count("*").alias("waits")).join(taken, "node", "left").withColumn("spare", F.lit(shifts) - F.coalesce("taken", F.lit(0)))
    about = nodes.select("node", "spare", F.pmod(F.xxhash64(F.lit(step), "node"), "spare").alias("from"), F.greatest(F.pmod(F.xxhash64(F.lit(step), "node"), "spare") + F.col("waits") - F.col("spare"), F.lit(0)).alias("wrapped"))
    key = F.pmod(F.col("turn") + F.col("from"), "spare")
    # Keys that went past the last free shift come first; the others follow them.
    own = F.when(F.col("key") < F.col("wrapped"), F.col("key")).otherwise(F.col("key") - F.col("from") + F.col("wrapped"))
    waiting = _turns(lots, "lot", *_ENDS).join(about, "node").withColumn("key", key).select("node", "key", own.alias("own"), *_ENDS)
    none = F.lit(None).cast("string")
    used = _turns(_ends(done), "shift").select("node", (F.col("shift") - F.col("turn")).alias("key"), F.lit(-1).cast("bigint").alias("own"), none.alias("src"), none.alias("dst"))
    merged = _turns(used.unionByName(waiting).withColumn("kind", F.col("src").isNotNull()), "key", "kind").where("kind")
    free = merged.select(*_ENDS, "node", (F.col("key") + F.col("turn") - F.col("own")).alias("shift"))
    both = free.groupBy(*_ENDS).agg(F.max(F.when(F.col("node") == F.col("src"), F.col("shift"))).alias("a"), F.max(F.when(F.col("node") == F.col("dst"), F.col("shift"))).alias("b"))
    return materialise(left.join(both, _ENDS).select(*_ENDS, "tight", "a", "b"), "offers")


def _first(rows: DataFrame, keys: list[str], locks: list[list]) -> DataFrame:
    """The rows that come first, by ``rank``, at each of their locks, named by columns of ``keys``."""
    asked = None
    for lock in locks:
        one = rows.select(*[c.alias(k) for c, k in zip(lock, keys, strict=True)], "rank")
        asked = one if asked is None else asked.unionByName(one)
    best = asked.groupBy(*keys).agg(F.min("rank").alias("top"))
    for lock in locks:
        top = best.select(*[F.col(k).alias(f"__{k}") for k in keys], "top")
        same = [c == F.col(f"__{k}") for c, k in zip(lock, keys, strict=True)]
        met = same[0]
        for s in same[1:]:
            met = met & s
        rows = rows.join(top, met & (F.col("rank") == F.col("top")), "left_semi")
    return rows


def _placed(offers: DataFrame, done: DataFrame) -> DataFrame:
    """``src``, ``dst``, ``shift``: edges that take what their busier end offers, where the other end is free then too."""
    shift, other = F.when(F.col("tight"), F.col("a")).otherwise(F.col("b")), F.when(F.col("tight"), F.col("dst")).otherwise(F.col("src"))
    asked = offers.select(*_ENDS, shift.alias("shift"), other.alias("node"), F.struct(F.xxhash64("src", "dst").alias("h"), "src", "dst").alias("rank"))
    free = asked.join(_ends(done).select("node", "shift"), ["node", "shift"], "left_anti")
    return _first(free, ["node", "shift"], [[F.col("src"), F.col("shift")], [F.col("dst"), F.col("shift")]]).select(*_ENDS, "shift")


def _switched(offers: DataFrame, done: DataFrame, step: int) -> tuple[DataFrame, DataFrame]:
    """Edges placed after their far end's chain has changed its two shifts, and all edges placed before as they are then.

    The edges of two shifts form paths and even rings.  Where ``a`` is free at
    ``src`` and ``b`` at ``dst``, changing ``a`` and ``b`` on the path that
    starts at ``dst`` frees ``a`` there, unless it ends at ``src``.  Pairs of
    shifts without a common one change in one round, so an edge is in one chain
    at most; of the edges that ask for a chain, or end on it, one has its way.
    """
    pairs = offers.groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.count("*").alias("n"))
    ranked = pairs.select("lo", "hi", F.struct((-F.col("n")).alias("n"), F.xxhash64(F.lit(step), "lo", "hi").alias("h"), "lo", "hi").alias("rank"))
    chosen = materialise(_first(ranked, ["shift"], [[F.col("lo")], [F.col("hi")]]).select("lo", "hi"), "pairs")
    name = lambda c: F.concat_ws("|", "lo", "hi", c)
    of = chosen.select("lo", "hi", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("shift"))
    links = materialise(done.join(of, "shift").select(*_ENDS, "shift", "lo", "hi", name("src").alias("x"), name("dst").alias("y")), "links")
    chain = materialise(star_components(links, "x", "y"), "chains")
    asked = offers.withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b")).join(chosen, ["lo", "hi"]).select(*_ENDS, "a", name("src").alias("x"), name("dst").alias("y"))
    near, far = chain.toDF("x", "u"), chain.toDF("y", "v")
    ends = asked.join(near, "x", "left").join(far, "y", "left").select(*_ENDS, "a", F.coalesce("u", "x").alias("u"), F.coalesce("v", "y").alias("v"))
    able = ends.where("u <> v").withColumn("rank", F.struct(F.xxhash64(F.lit(step), "src", "dst").alias("h"), "src", "dst"))
    won = materialise(_first(able, ["chain"], [[F.col("u")], [F.col("v")]]).select(*_ENDS, "a", "v"), "won")
    turned = links.join(chain.toDF("x", "v"), "x").join(won.select("v"), "v", "left_semi").select(*_ENDS, (F.col("lo") + F.col("hi") - F.col("shift")).alias("other"))
    after = done.join(turned, _ENDS, "left").select(*_ENDS, F.coalesce("other", "shift").alias("shift"))
    return won.select(*_ENDS, F.col("a").alias("shift")), after


@tidy
def edge_colouring(graph: Graph) -> DataFrame:
    """``src``, ``dst``, ``shift`` (from 0): no two edges of one node have the same shift.

    A graph without odd cycles takes as many shifts as its busiest node has
    edges, which is fewest.  Others begin with one more; where chains of two
    shifts do not get on, one is added, so there the number is an upper bound.
    Rounds give edges free shifts while that gets on, then change chains of two
    shifts, which without odd cycles always places one.  Loops take no shift and
    are refused; no edges give no rows.
    """
    graph = graph.written()
    graph.need(directed=False)
    spark = graph.spark
    if not graph.edges.where("src = dst").isEmpty():
        raise Invalid("a loop meets itself at its node and takes no shift")
    degree = materialise(_ends(graph.edges.select(*_ENDS)).groupBy("node").agg(F.count("*").alias("d")), "degrees")
    shifts = degree.agg(F.coalesce(F.max("d"), F.lit(0))).first()[0]
    if not two_colouring(graph).where("odd").isEmpty():
        shifts += 1
    sized = graph.edges.join(degree.toDF("src", "x"), "src").join(degree.toDF("dst", "y"), "dst")
    left = materialise(sized.select(*_ENDS, (F.col("x") >= F.col("y")).alias("tight")), "left")
    done = materialise(graph.edges.where("false").select(*_ENDS, F.lit(0).cast("bigint").alias("shift")), "shifts")
    step, simple, stuck, n = 0, True, 0, left.count()
    while n:
        step += 1
        offers = _offers(left, done, shifts, step)
        new, before = (_placed(offers, done), done) if simple else _switched(offers, done, step)
        new = materialise(new, "placed")
        after = materialise(before.unionByName(new), "shifts")
        rest = materialise(left.join(new.select(*_ENDS), _ENDS, "left_anti").select(*_ENDS, "tight"), "left")
        m = rest.count()
        if simple:
            simple = (n - m) * SLOW > n
        else:
            stuck = stuck + 1 if m == n else 0
            if stuck == PATIENCE:
                shifts, stuck = shifts + 1, 0
        for table in (left, done, offers, new):
            discard(spark, table)
        left, done, n = rest, after, m
    return done


@tidy
def schedule(graph: Graph) -> DataFrame:
    """``n_edges``, ``n_shifts``, ``busiest`` (most edges of a node), ``proper``: an edge colouring and whether it is one."""
    graph = graph.written()
    found = edge_colouring(graph)
    ends = _ends(found).groupBy("node").agg(F.count("*").alias("n"), F.countDistinct("shift").alias("k"))
    shape = ends.agg(F.coalesce(F.max("n"), F.lit(0)).alias("busiest"), F.coalesce(F.bool_and(F.col("n") == F.col("k")), F.lit(True)).alias("proper"))
    return materialise(found.agg(F.count("*").alias("n_edges"), F.countDistinct("shift").alias("n_shifts")).crossJoin(shape), "schedule")
