"""Connected components of an edge table: contraction while it is large, then alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.session import discard, materialise, share_code, tidy

#: Tables of more edges are contracted before stars alternate.
FEW = 200_000


def _signature(stars: DataFrame) -> tuple:
    return tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def _contracted(stars: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """``u``, ``to``: each node with that of its neighbours and itself which comes first by a hash; and the edges between the nodes so chosen.

    A node is chosen by few others on a chain and by many where it has many
    neighbours; on chains and rings half of the nodes are left. Any choice among
    the neighbours is right; the hash, another in every round, makes it a good one.
    """
    both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(stars.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    first = both.groupBy("u").agg(F.min_by("v", F.xxhash64(F.lit(turn), "v")).alias("v"))
    own = F.xxhash64(F.lit(turn), "u") <= F.xxhash64(F.lit(turn), "v")
    labels = materialise(first.select("u", F.when(own, F.col("u")).otherwise(F.col("v")).alias("to")), "labels")
    moved = stars.join(labels.toDF("hi", "x"), "hi").join(labels.toDF("lo", "y"), "lo").where("x <> y")
    return labels, materialise(moved.select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct(), "stars")


@tidy
def star_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``id``, ``component`` for every end of an edge; the component is its smallest id.

    A table of more than ``FEW`` edges is contracted first: neighbours become one
    node, and every round has a part of the rows of the one before, so all rounds
    together cost a few times the first. Large-star and small-star steps then
    alternate until what is left stands still (the number of rounds grows with the
    logarithm of the longest chain).  Each round joins the edges with one row for each node, so a node with many
    neighbours is split by the skewed-join rule, never gathered.  Null ends and
    self-loops do not link; they give no row unless another edge does.
    """
    spark = edges.sparkSession
    share_code(spark)
    stars = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(f"`{a}` is not null and `{b}` is not null and hi <> lo").distinct()
    stars = materialise(stars, "stars")
    levels: list[DataFrame] = []
    while stars.count() > FEW:
        labels, new = _contracted(stars, len(levels))
        levels.append(labels)
        discard(spark, stars)
        stars = new
    before = _signature(stars)
    while before[0]:
        both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(stars.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        root = large.groupBy("hi").agg(F.min("lo").alias("m"))
        near = large.join(root, "hi")
        small = near.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").union(root.select("hi", F.col("m").alias("lo"))).distinct()
        new = materialise(small, "stars")
        after = _signature(new)
        discard(spark, stars)
        stars = new
        if after == before:
            break
        before = after
    roots = stars.select(F.col("lo").alias("id")).distinct().select("id", F.col("id").alias("component"))
    found = stars.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionByName(roots)
    if not levels:
        return found
    for labels in reversed(levels):
        # A node chosen that has no edge left is a component's last one.
        named = labels.join(found.toDF("to", "component"), "to", "left").select(F.col("u").alias("id"), F.coalesce("component", "to").alias("component"))
        found = materialise(named, "components")
    least = found.groupBy("component").agg(F.min("id").alias("least"))
    return materialise(found.join(least, "component").select("id", F.col("least").alias("component")), "components")
