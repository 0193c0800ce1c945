"""Places in a total order, and ranks in linked lists, with no group or table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweave.session import discard, materialise, tidy

#: Longer lists are shortened before jumps double.
FEW = 200_000


@tidy
def numbered(rows: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """``rows`` with their place, from 1, in the order of the named columns, nulls first.

    Rows are dealt by ranges; a task numbers its range, and the sizes of the
    ranges before, one row for each task, are added.
    """
    dealt = materialise(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", before.alias("__before"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + own).drop("__part", "__before")


@tidy
def summed(rows: DataFrame, order: str, *weights: str) -> DataFrame:
    """``rows`` with the sums of ``weights`` over all rows up to their own in the order of a column of distinct values, dealt as in ``numbered``."""
    dealt = materialise(rows.repartitionByRange(order).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("__part").agg(*[F.sum(w).alias(w) for w in weights])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", *[F.coalesce(F.sum(w).over(before), F.lit(0)).alias(f"__{w}") for w in weights])
    own = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.join(F.broadcast(offsets), "__part")
    return placed.select(*[c for c in rows.columns if c not in weights], *[(F.col(f"__{w}") + F.sum(w).over(own)).alias(w) for w in weights])


def _spliced(now: DataFrame, weights: tuple[str, ...], turn: int) -> tuple[DataFrame, DataFrame]:
    """Lists without the elements that were taken out, up to two after each of a half of all, and rows ``id``, ``next``, ``last``, weights of these."""

    def stays(c: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(turn), c), F.lit(2)) == 0

    other = now.where(~stays("id"))
    kept = now.where(stays("id"))
    for k in ("1", "2"):
        # An element that stays matches none, so it stands for a join that is not wanted, and no key is frequent.
        key = F.when(F.col("next").isNotNull() & ~stays("next"), F.col("next")).otherwise(F.col("id"))
        taken = other.select(F.col("id").alias(f"id{k}"), F.col("next").alias("__next"), F.col("last").alias(f"last{k}"), *[F.col(w).alias(f"{w}{k}") for w in weights])
        kept = kept.withColumn("__key", key).join(taken, F.col("__key") == F.col(f"id{k}"), "left")
        kept = kept.withColumn("next", F.when(F.col(f"id{k}").isNull(), F.col("next")).otherwise(F.col("__next"))).drop("__key", "__next")
    kept = materialise(kept, "spliced")
    rest = materialise(other.join(kept.select(F.explode(F.array("id1", "id2")).alias("id")).where("id is not null"), "id", "left_anti"), "rest")
    whole = [(F.col(w) + F.coalesce(f"{w}1", F.lit(0)) + F.coalesce(f"{w}2", F.lit(0))).alias(w) for w in weights]
    live = kept.select("id", "next", F.coalesce("last2", "last1", "last").alias("last"), *whole).unionByName(rest.select("id", "next", "last", *weights))
    first = kept.where("id1 is not null").select(F.col("id1").alias("id"), "next", F.coalesce("last2", "last1").alias("last"), *[(F.col(f"{w}1") + F.coalesce(f"{w}2", F.lit(0))).alias(w) for w in weights])
    return live, first.unionByName(kept.where("id2 is not null").select(F.col("id2").alias("id"), "next", F.col("last2").alias("last"), *[F.col(f"{w}2").alias(w) for w in weights]))


@tidy
def ranked(links: DataFrame, *weights: str) -> DataFrame:
    """``id`` and the sums of ``weights`` from each element of lists to its list's end, itself included; ``last`` is that end.

    ``links(id, next, weights)``: an element without a next one ends a list, and
    none is the next one of two.  While there are more than ``FEW``, three in eight
    are taken out in every round, so all rounds cost a few times the first; they
    come back in turn.  On what is left jumps double, twice between two writes.
    Elements of rings have no end; their sums mean nothing.
    """
    now = materialise(links.select("id", "next", F.col("id").alias("last"), *weights), "links")
    gone: list[DataFrame] = []
    while now.count() > FEW:
        now, taken = _spliced(now, weights, len(gone))
        gone.append(taken)
    found = _doubled(now, weights)
    for taken in reversed(gone):
        ahead = found.select(F.col("id").alias("__key"), F.col("last").alias("__last"), *[F.col(w).alias(f"__{w}") for w in weights])
        met = taken.withColumn("__key", F.coalesce("next", "id")).join(ahead, "__key", "left")
        back = met.select("id", F.coalesce("__last", "last").alias("last"), *[(F.col(w) + F.coalesce(f"__{w}", F.lit(0))).alias(w) for w in weights])
        found = found.unionByName(materialise(back, "ranks"))
    return found


def _doubled(now: DataFrame, weights: tuple[str, ...]) -> DataFrame:
    """``ranked`` by jumps that double; each round has one row for each element."""

    def jump(now: DataFrame) -> DataFrame:
        ahead = now.select(F.col("id").alias("next"), F.col("next").alias("__next"), F.col("last").alias("__last"), *[F.col(w).alias(f"__{w}") for w in weights])
        return now.join(ahead, "next", "left").select("id", F.col("__next").alias("next"), F.coalesce("__last", "last").alias("last"), *[(F.col(w) + F.coalesce(f"__{w}", F.lit(0))).alias(w) for w in weights])

    longest, reach = now.count(), 1
    while reach < longest:
        new = materialise(jump(jump(now)), "jumps")
        if reach > 1:
            discard(now.sparkSession, now)
        now, reach = new, reach * 4
    return now.select("id", "last", *weights)
