"""Bounded, repeatable samples of labelled rows to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweave.session import materialise


def per_value(rows: DataFrame, label: str, most: int, salt: Column, total: int = 100_000) -> DataFrame:
    """About ``most`` rows of each label value, chosen by the hash ``salt`` and not by order.

    Rows with a null label are left out.  ``total`` bounds the rows of all
    values: with more values each gets fewer rows, one at least on average, and
    with more values than that the less frequent ones get theirs by chance.
    """
    labelled = rows.where(F.col(label).isNotNull())
    counts = materialise(labelled.groupBy(F.col(label).alias("v")).agg(F.count("*").alias("n")), "values")
    share = F.lit(float(min(most, total / max(counts.count(), 1))))
    space = 1 << 30
    chance = F.pmod(F.xxhash64(salt), F.lit(space))
    rates = counts.select("v", (share / F.col("n") * space + 1).cast("bigint").alias("below"))
    sampled = labelled.alias("r").join(rates.alias("c"), F.col(f"r.`{label}`") == F.col("c.v")).where(chance < F.col("below"))
    return sampled.select("r.*")
