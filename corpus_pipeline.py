"""A training-corpus pipeline over ``documents``: five stages, each a whole pass over what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All but the
last return the columns of ``documents``, and further columns that ``docs`` has,
whatever their names.  Every stage gives an empty table for an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.llm import bpe, decontaminate, langcnn, similar, toxicity
from sparkweave.session import discard, materialise

#: Documents without a letter go, and those of which no language takes this share of the text.
LEAST_LANGUAGE = 0.3
#: Documents at least this likely to be toxic go.
TOXIC = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language can be told; null and empty texts and texts without a letter go, repeated rows are judged each."""
    network = langcnn.fit(docs)
    names = docs.columns
    # Answers get names that no column of the documents has.
    found = langcnn.predict(docs.select(F.struct(*[f"`{c}`" for c in names]).alias("__row"), F.col("text").alias("text")), network)
    kept = found.where((F.col("lang_pred") != langcnn.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE))
    return kept.select("__row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit on the labels of the documents at hand and drop what is likely toxic.

    Where no document has a label nothing can be told, and all stay; a null text scores as an empty one.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    names = docs.columns
    fitted = toxicity.fit(docs.select("doc_id", "text"), labels)
    if not fitted[0].any():
        return docs
    scored = toxicity.score(docs.select(F.struct(*[f"`{c}`" for c in names]).alias("__row"), F.col("text").alias("text")), fitted)
    return scored.where(F.col("score") < TOXIC).select("__row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity of 0.8 or more.

    It is the one of the smallest id.  Null and empty texts and null ids stay.
    """
    return similar.deduplicate(docs, similar.Rule(width=5, num=80, den=100))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, its numbers and names changed or not, each row by its own text; null texts stay."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every kept text, with digests of the ids and of what they decode to; a null text has none."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN).drop("text")


STAGES = [
    ("language identification", language_id),
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("byte-level BPE", encode),
]

#: The trained and hashed stages have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, "stage")
            if i:
                discard(spark, before)
    return docs
