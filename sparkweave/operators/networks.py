"""Cheapest flows and assignments by prices: rounds of bids and pushes at falling tolerances.

Every node, or job, has a price.  A round lets all who hold something act at
once on the prices of the round before, which keeps the solution within a
tolerance of complementary slackness; the tolerance falls until it is too small
for a cheaper solution to exist.  Costs are counted in whole units, so this end
is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.errors import Invalid
from sparkweave.model import Graph
from sparkweave.operators.flows import NOTHING, dealt_out, matching, maximum_flow
from sparkweave.operators.orders import numbered
from sparkweave.session import discard, materialise, tidy

#: How much the tolerance falls from one phase to the next.
FALL = 8


def _scaled(cost: str, unit: float, n: int):
    """A cost in units, times one more than the number of nodes: then a tolerance of 1 tells optimal solutions from others."""
    return (F.round(F.col(cost) / F.lit(unit)).cast("bigint") * F.lit(n + 1)).cast("bigint")


@tidy
def minimum_cost_flow(arcs: DataFrame, source: str, sink: str, amount: float | None = None, unit: float = 1e-3) -> DataFrame:
    """``src``, ``dst``, ``flow``, ``cost``, ``reduced``, ``tight`` of every arc: the cheapest way to send ``amount`` (by default all that can be sent).

    ``arcs(src, dst, capacity, cost)``: capacities not negative, costs per unit
    of flow of any sign, in steps of ``unit``; parallel arcs are kept apart.
    ``reduced`` is the cost at the final prices of the ends and ``tight`` says
    that it fits the flow, to the tolerance: full arcs do not cost more than
    nothing, empty ones not less, others neither.  More than can be sent is refused.
    """
    rows = materialise(numbered(arcs.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), F.col("capacity").cast("double").alias("capacity"), F.col("cost").cast("double").alias("cost")), "src", "dst", "cost", "capacity", name="arc"), "arcs")
    if not rows.where("capacity < 0 or capacity is null or cost is null or src is null or dst is null").isEmpty():
        raise Invalid("capacities must not be negative, and nothing null")
    network = Graph.of(rows.where("src <> dst").groupBy("src", "dst").agg(F.sum("capacity").alias("w")), True).written()
    most = maximum_flow(network, source, sink)[0].where((F.col("src") == source) | (F.col("dst") == source)).agg(F.sum(F.when(F.col("src") == source, F.col("flow")).otherwise(-F.col("flow")))).first()[0] or 0.0
    amount = most if amount is None else float(amount)
    if amount > most + NOTHING or amount < 0:
        raise Invalid(f"{amount} was asked for, and {most} can be sent")
    n = network.nodes.count()
    own = rows.withColumn("c", _scaled("cost", unit, n))
    there = own.select("arc", "src", "dst", F.col("capacity").alias("left"), "c")
    back = own.select((-F.col("arc")).alias("arc"), F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0.0).alias("left"), (-F.col("c")).alias("c"))
    residual = materialise(there.unionByName(back), "residual")
    zero = F.lit(0.0)
    supply = F.when(F.col("id") == source, F.lit(amount)).when(F.col("id") == sink, F.lit(-amount)).otherwise(zero)
    held = materialise(network.nodes.select("id", supply.alias("x"), F.lit(0).cast("bigint").alias("p")), "held")

    def priced(residual: DataFrame, held: DataFrame) -> DataFrame:
        at = held.select("id", "x", "p")
        return residual.where(F.col("left") > NOTHING).join(at.toDF("src", "x", "ps"), "src").join(at.select(F.col("id").alias("dst"), F.col("p").alias("pd")), "dst").withColumn("reduced", F.col("c") + F.col("ps") - F.col("pd"))

    def moved(push: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Both tables after ``push(src, arc, sent)``; the first is written."""
        turned = push.select((-F.col("arc")).alias("arc"), F.col("sent").alias("got"))
        new = materialise(residual.join(push.select("arc", "sent"), "arc", "left").join(turned, "arc", "left").select("arc", "src", "dst", (F.col("left") - F.coalesce("sent", zero) + F.coalesce("got", zero)).alias("left"), "c"), "residual")
        to = residual.select("arc", "dst").join(push.select("arc", "sent"), "arc")
        change = push.select(F.col("src").alias("id"), (-F.col("sent")).alias("y")).union(to.select("dst", "sent")).groupBy("id").agg(F.sum("y").alias("y"))
        return new, held.join(change, "id", "left").select("id", (F.col("x") + F.coalesce("y", zero)).alias("x"), "p")

    step, full = max(int(residual.agg(F.max(F.abs("c"))).first()[0] or 0), 1), True
    while True:
        # A phase begins with all that is too cheap filled; then who holds something pushes it on.
        cheap = priced(residual, held).where("reduced < 0")
        if full:
            push = cheap.select("src", "arc", F.col("left").alias("sent"))
        else:
            push = dealt_out(cheap.where(F.col("x") > NOTHING).select("src", "arc", "x", "left"), "x", "left", "arc")
        push = materialise(push, "pushes")
        new, now = moved(push)
        # Who still holds something and has no cheap arc left lowers the price until one is.
        stuck = priced(new, now).where(F.col("x") > NOTHING).groupBy(F.col("src").alias("id")).agg(F.min("reduced").alias("least"), F.max(F.col("pd") - F.col("c")).alias("best")).where("least >= 0")
        after = materialise(now.join(stuck, "id", "left").select("id", "x", F.coalesce(F.col("best") - F.lit(step), F.col("p")).alias("p")), "held")
        for table in (residual, held, push):
            discard(arcs.sparkSession, table)
        residual, held, full = new, after, False
        if held.where(F.col("x") > NOTHING).isEmpty():
            if step == 1:
                break
            step, full = max(1, step // FALL), True
    flow = residual.where("arc < 0").select((-F.col("arc")).alias("arc"), F.round("left", 9).alias("flow"))
    price = held.select("id", "p")
    whole = own.join(flow, "arc").join(price.toDF("src", "ps"), "src").join(price.toDF("dst", "pd"), "dst")
    reduced = F.col("c") + F.col("ps") - F.col("pd")
    tight = ((F.col("flow") > NOTHING) & (reduced > 1)) | ((F.col("flow") < F.col("capacity") - NOTHING) & (reduced < -1))
    return whole.select("src", "dst", "flow", "cost", F.round(reduced / (n + 1) * unit, 9).alias("reduced"), (~tight).alias("tight"))


@tidy
def assignment(costs: DataFrame, unit: float = 1e-3) -> DataFrame:
    """``worker``, ``job``, ``cost``, ``price``, ``tight``: the cheapest pairing of all workers and jobs of ``costs(worker, job, cost)``.

    In every round each worker without a job bids for the one worth most to it
    at the prices of the round before, by as much more as it is worth than the
    next; the highest bid takes a job and its price, and who had it is free
    again.  Costs count in steps of ``unit``; pairs that are not listed cannot
    be made.  ``tight`` says that no other job was worth more to the worker, to
    the tolerance.  As many workers as jobs, and some full pairing, must be there.
    """
    spark = costs.sparkSession
    rows = costs.select(F.col("worker").cast("string").alias("worker"), F.col("job").cast("string").alias("job"), F.col("cost").cast("double").alias("cost")).groupBy("worker", "job").agg(F.min("cost").alias("cost"))
    rows = materialise(rows, "costs")
    n, jobs = rows.select("worker").distinct().count(), rows.select("job").distinct().count()
    if n != jobs:
        raise Invalid(f"there are {n} workers for {jobs} jobs")
    if rows.count() < n * n and matching(rows.select(F.col("worker").alias("l"), F.col("job").alias("r"))).count() < n:
        raise Invalid("the listed pairs do not give every worker a job")
    worth = materialise(rows.withColumn("v", -_scaled("cost", unit, n)), "worth")
    price = materialise(rows.select("job").distinct().withColumn("price", F.lit(0).cast("bigint")), "prices")
    ends = worth.agg(F.max("v").alias("high"), F.min("v").alias("low")).first()
    spread = int(ends["high"] - ends["low"]) if n else 0
    step = max(1, spread // FALL)
    while n:
        taken = spark.createDataFrame([], "job string, worker string")
        while True:
            free = worth.join(taken.select("worker"), "worker", "left_anti").join(price, "job").withColumn("gain", F.col("v") - F.col("price"))
            top = free.groupBy("worker").agg(F.max("gain").alias("gain"), F.min_by("job", F.struct((-F.col("gain")).alias("g"), "job")).alias("best"))
            other = free.join(top.select("worker", "best"), "worker").where("job <> best").groupBy("worker").agg(F.max("gain").alias("next"))
            # The only job of a worker is worth any price.
            more = F.col("gain") - F.coalesce("next", F.col("gain") - F.lit(spread)) + F.lit(step)
            bids = top.join(other, "worker", "left").join(price.withColumnRenamed("job", "best"), "best").select(F.col("best").alias("job"), "worker", (F.col("price") + more).alias("bid"))
            won = materialise(bids.groupBy("job").agg(F.max(F.struct("bid", "worker")).alias("b")).select("job", "b.worker", "b.bid"), "bids")
            if won.isEmpty():
                break
            now = materialise(taken.join(won.select("job"), "job", "left_anti").unionByName(won.select("job", "worker")), "taken")
            new = materialise(price.join(won.select("job", "bid"), "job", "left").select("job", F.coalesce("bid", "price").alias("price")), "prices")
            discard(spark, price)
            taken, price = now, new
        if step == 1:
            break
        step = max(1, step // FALL)
    if not n:
        return rows.select("worker", "job", "cost", F.lit(0.0).alias("price"), F.lit(True).alias("tight"))
    best = worth.join(price, "job").groupBy("worker").agg(F.max(F.col("v") - F.col("price")).alias("most"))
    pairs = worth.join(taken, ["worker", "job"]).join(price, "job").join(best, "worker")
    return pairs.select("worker", "job", "cost", F.round(F.col("price") / (n + 1) * unit, 9).alias("price"), (F.col("most") - F.col("v") + F.col("price") <= 1).alias("tight"))
