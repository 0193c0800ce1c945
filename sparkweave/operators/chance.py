"""Seeded stochastic models: every draw is a hash of seed, trial and name, so results do not depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkweave.errors import Invalid
from sparkweave.model import Graph
from sparkweave.operators.paths import bfs
from sparkweave.plans.components import star_components
from sparkweave.session import materialise, tidy


def draw(seed: int, *what: Column | str) -> Column:
    """A number in [0, 1) for each value of ``what``."""
    return F.pmod(F.xxhash64(F.lit(seed), *[F.col(w) if isinstance(w, str) else w for w in what]), F.lit(1 << 53)) / float(1 << 53)


def erdos_renyi(spark: SparkSession, n: int, p: float, seed: int = 0) -> Graph:
    """Every pair of n nodes with chance p."""
    if not 0 <= p <= 1 or n < 0:
        raise Invalid("a size is not negative and a chance lies between 0 and 1")
    one = spark.range(n)
    pairs = one.select(F.col("id").alias("i")).crossJoin(one.select(F.col("id").alias("j"))).where("i < j").where(draw(seed, "i", "j") < p)
    return Graph.of(pairs.select(F.col("i").cast("string").alias("src"), F.col("j").cast("string").alias("dst")), False, one.select(F.col("id").cast("string")))


def watts_strogatz(spark: SparkSession, n: int, k: int, beta: float, seed: int = 0) -> Graph:
    """A ring of k neighbours each, every edge's far end moved with chance beta; moves that hit a loop stay."""
    if k % 2 or k >= n or k < 2:
        raise Invalid("the ring needs an even number of neighbours below its size")
    ring = spark.range(n).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(1), F.lit(k // 2))).alias("s"))
    there = F.floor(draw(seed + 1, "i", "s") * n)
    far = F.when((draw(seed, "i", "s") < beta) & (there != F.col("i")), there).otherwise((F.col("i") + F.col("s")) % n)
    return Graph.of(ring.select(F.col("i").cast("string").alias("src"), far.cast("string").alias("dst")), False, spark.range(n).select(F.col("id").cast("string")))


@tidy
def barabasi_albert(spark: SparkSession, n: int, m: int, seed: int = 0, generations: int = 40) -> Graph:
    """Preferential attachment: every new edge copies a random end of an earlier edge, or its target.

    An end chosen among all earlier ends is chosen by degree.  The first m + 1
    nodes are complete; following copies back about halves the open edges
    every round.
    """
    if m < 1 or n <= m:
        raise Invalid("each node brings at least one edge, and there are more nodes than that")
    core = spark.range(m + 1).select(F.col("id").alias("i")).crossJoin(spark.range(m + 1).select(F.col("id").alias("j"))).where("i < j")
    core = materialise(core.withColumn("g", F.row_number().over(Window.orderBy("i", "j")).cast("bigint") - 1), "core")
    c = m * (m + 1) // 2

    def pick(edge: str) -> Column:
        """The slot that an edge copies: one of the two ends of an edge before its node's own."""
        return F.floor(draw(seed, edge) * 2 * (c + F.floor((F.col(edge) - c) / m) * m)).cast("bigint")

    edges = spark.range(m + 1, n).select(F.col("id").alias("node"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("s")).select("node", (c + (F.col("node") - m - 1) * m + F.col("s")).cast("bigint").alias("e"))
    open_, done = edges.select("node", pick("e").alias("at")), core.select(F.col("i").alias("node"), F.col("j").alias("to"))
    for _ in range(generations):
        placed = open_.withColumn("g", F.floor(F.col("at") / 2).cast("bigint")).join(F.broadcast(core), "g", "left")
        to = F.when(F.col("i").isNotNull(), F.when(F.col("at") % 2 == 0, F.col("i")).otherwise(F.col("j"))).when(F.col("at") % 2 == 0, F.floor((F.col("g") - c) / m) + m + 1)
        placed = materialise(placed.withColumn("to", to.cast("bigint")), "open")
        done = done.unionByName(placed.where("to is not null").select("node", "to"))
        open_ = placed.where("to is null").select("node", pick("g").alias("at"))
        if open_.isEmpty():
            break
    return Graph.of(done.where("node <> to").select(F.col("node").cast("string").alias("src"), F.col("to").cast("string").alias("dst")), False, spark.range(n).select(F.col("id").cast("string")))


def percolation(graph: Graph, chances: list[float], trials: int = 10, seed: int = 0) -> DataFrame:
    """``p``, ``giant``: the mean share of nodes in the largest piece when every edge stays with chance p; all trials at once."""
    graph.need(directed=False, least=1)
    n = graph.nodes.count()
    cases = graph.spark.createDataFrame([(p, t) for p in chances for t in range(trials)], "p double, t int")
    kept = graph.edges.crossJoin(cases).where(draw(seed, "src", "dst", "t") < F.col("p"))
    tag = F.concat(F.col("p").cast("string"), F.lit("|"), F.col("t").cast("string"), F.lit("|"))
    found = star_components(kept.select(F.concat(tag, "src").alias("a"), F.concat(tag, "dst").alias("b")), "a", "b")
    size = found.groupBy("component").count().select(F.split("component", r"\|")[0].alias("p"), F.split("component", r"\|")[1].alias("t"), "count")
    top = size.groupBy("p", "t").agg(F.max("count").alias("top"))
    full = cases.select(F.col("p").cast("string").alias("p"), F.col("t").cast("string").alias("t")).join(top, ["p", "t"], "left")
    return full.groupBy(F.col("p").cast("double").alias("p")).agg(F.round(F.avg(F.coalesce("top", F.lit(1)) / n), 6).alias("giant"))


@tidy
def random_walks(graph: Graph, start: str, steps: int, walks: int, seed: int = 0) -> DataFrame:
    """``walk``, ``step``, ``id``: all walks advance together, one join a step; a node without neighbours ends its walk."""
    graph = graph.written()
    graph.need(nodes=(start,))
    near = graph.arcs.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1).withColumn("k", F.count("*").over(Window.partitionBy("src"))).select("src", "dst", "r", "k")
    near = materialise(near, "near")
    degree = near.select("src", "k").distinct()
    now = materialise(graph.spark.range(walks).select(F.col("id").alias("walk"), F.lit(0).alias("step"), F.lit(start).alias("id")), "walk")
    trail = now
    for step in range(1, steps + 1):
        picked = now.join(degree, F.col("id") == F.col("src")).select("walk", "src", F.floor(draw(seed, "walk", F.lit(step)) * F.col("k")).cast("int").alias("r"))
        now = materialise(picked.join(near, ["src", "r"]).select("walk", F.lit(step).alias("step"), F.col("dst").alias("id")), "walk")
        trail = trail.unionByName(now)
    return trail


def walk_shares(graph: Graph, trail: DataFrame) -> DataFrame:
    """``id``, ``visited``, ``stationary``: shares of visits against degree over twice the edges."""
    total = trail.count()
    seen = trail.groupBy("id").count().withColumnRenamed("count", "v")
    arcs = graph.arcs.count()
    degree = graph.arcs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d"))
    return graph.nodes.join(seen, "id", "left").join(degree, "id", "left").select("id", F.round(F.coalesce("v", F.lit(0)) / total, 6).alias("visited"), F.round(F.coalesce("d", F.lit(0)) / max(arcs, 1), 6).alias("stationary"))


def cover_times(graph: Graph, trail: DataFrame) -> DataFrame:
    """``walk``, ``cover``: the step at which a walk has seen every node; null if it has not."""
    n = graph.nodes.count()
    first = trail.groupBy("walk", "id").agg(F.min("step").alias("first"))
    return first.groupBy("walk").agg(F.when(F.count("*") == n, F.max("first")).alias("cover"))


@tidy
def epidemic(graph: Graph, start: str, beta: float, gamma: float, trials: int = 10, rounds: int = 50, seed: int = 0) -> DataFrame:
    """``trial``, ``infected``, ``peak``: SIR rounds of all trials together until none is infectious."""
    graph = graph.written()
    graph.need(nodes=(start,))
    now = materialise(graph.spark.range(trials).select(F.col("id").alias("trial"), F.lit(start).alias("id")), "infectious")
    ever, peaks = now, now.groupBy("trial").count()
    for step in range(rounds):
        hit = now.join(graph.arcs, F.col("id") == F.col("src")).where(draw(seed, "trial", F.lit(step), "src", "dst") < beta).select("trial", F.col("dst").alias("id")).distinct()
        new = hit.join(ever.select("trial", "id"), ["trial", "id"], "left_anti")
        stay = now.where(draw(seed + 1, "trial", F.lit(step), "id") >= gamma)
        now = materialise(stay.select("trial", "id").union(new.select("trial", "id")), "infectious")
        if now.isEmpty():
            break
        ever = materialise(ever.select("trial", "id").union(now.select("trial", "id")).distinct(), "ever")
        peaks = peaks.union(now.groupBy("trial").count())
    return ever.groupBy("trial").agg(F.count("*").alias("infected")).join(peaks.groupBy("trial").agg(F.max("count").alias("peak")), "trial")


def sample_nodes(graph: Graph, share: float, seed: int = 0) -> Graph:
    """The part on nodes kept with chance ``share``."""
    return graph.induced(graph.nodes.where(draw(seed, "id") < share))


def sample_edges(graph: Graph, share: float, seed: int = 0) -> Graph:
    """Edges kept with chance ``share``, with their ends."""
    return Graph.of(graph.edges.where(draw(seed, "src", "dst") < share), graph.directed)


@tidy
def snowball(graph: Graph, start: str, hops: int) -> Graph:
    """The part on nodes within ``hops`` of ``start``, which must be a node."""
    graph = graph.written()
    return graph.induced(materialise(bfs(graph, start, rounds=hops).select("id"), "ball"))


def degree_bias(graph: Graph, sample: Graph) -> DataFrame:
    """``n_sampled``, ``n_edges``, ``mean_sampled``, ``mean_all``: mean degree in the whole graph of a sample's nodes and of all nodes.

    Means are null where there is no node.
    """
    degree = graph.arcs.where("src <> dst").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d"))
    whole = graph.nodes.join(degree, "id", "left").select("id", F.coalesce("d", F.lit(0)).alias("d"))
    drawn = whole.join(sample.nodes, "id", "left_semi").agg(F.count("*").alias("n_sampled"), F.avg("d").alias("mean_sampled"))
    return drawn.crossJoin(sample.edges.agg(F.count("*").alias("n_edges"))).crossJoin(whole.agg(F.avg("d").alias("mean_all"))).select("n_sampled", "n_edges", "mean_sampled", "mean_all")


@tidy
def edge_swaps(graph: Graph, rounds: int = 10, seed: int = 0) -> Graph:
    """Degree-preserving shuffles: in each round edges are paired at random and swap far ends where that makes no loop or double edge.

    Swaps of a round that would make the same new edge, or one that is there,
    are left out, so every degree stays.
    """
    graph = graph.written()
    graph.need(directed=False)
    now = materialise(graph.edges.select("src", "dst", "w"), "edges")
    for step in range(rounds):
        n = max(now.count() // 2, 1)
        # Pairs meet in random cells; of a cell with more than two edges the first two by hash swap.
        cell = F.floor(draw(seed + step, "src", "dst") * n).cast("bigint")
        order = Window.partitionBy("cell").orderBy(F.xxhash64(F.lit(seed - step), "src", "dst"))
        ranked = now.withColumn("cell", cell).withColumn("r", F.row_number().over(order))
        p = ranked.where("r = 1").select("cell", F.col("src").alias("a"), F.col("dst").alias("b"), F.col("w").alias("w1"))
        q = ranked.where("r = 2").select("cell", F.col("src").alias("c"), F.col("dst").alias("d"), F.col("w").alias("w2"))
        swap = p.join(q, "cell").where("a <> d and c <> b and a <> c and b <> d")
        made = swap.select("cell", F.least("a", "d").alias("src"), F.greatest("a", "d").alias("dst")).union(swap.select("cell", F.least("c", "b"), F.greatest("c", "b")))
        clash = made.join(now, ["src", "dst"]).select("cell").union(made.withColumn("n", F.count("*").over(Window.partitionBy("src", "dst"))).where("n > 1").select("cell")).distinct()
        fine = materialise(swap.join(clash, "cell", "left_anti"), "swaps")
        gone = fine.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(fine.select("c", "d"))
        new = fine.select(F.least("a", "d").alias("src"), F.greatest("a", "d").alias("dst"), F.col("w1").alias("w")).union(fine.select(F.least("c", "b"), F.greatest("c", "b"), "w2"))
        now = materialise(now.join(gone, ["src", "dst"], "left_anti").select("src", "dst", "w").union(new), "edges")
    return Graph(graph.nodes, now, False)


@tidy
def null_model(graph: Graph, samples: int = 5, seed: int = 0, rounds: int = 10) -> DataFrame:
    """``reading``, ``observed``, ``mean``, ``deviation``, ``z`` of transitivity against degree-preserving shuffles."""
    from sparkweave.operators.structure import clustering

    observed = clustering(graph).first()["transitivity"]
    twins = [clustering(edge_swaps(graph, rounds, seed + 1000 * i)).first()["transitivity"] for i in range(max(samples, 2))]
    mean = sum(twins) / len(twins)
    spread = (sum((x - mean) ** 2 for x in twins) / (len(twins) - 1)) ** 0.5
    return graph.spark.createDataFrame([("transitivity", float(observed), mean, spread, (observed - mean) / spread if spread else None)], "reading string, observed double, mean double, deviation double, z double")
