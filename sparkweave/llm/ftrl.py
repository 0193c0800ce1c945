"""Logistic regression over hashed features by follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from sparkweave.session import discard, materialise, share_code

#: Features of rows: (flat feature numbers, flat values, first feature of each row).
Features = tuple[np.ndarray, np.ndarray, np.ndarray]
Extract = Callable[[np.ndarray, np.ndarray], Features]

#: Labelled documents that one task learns from, and the parts of a weight that are added up.
ROWS, UNIT = 4000, float(1 << 40)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray, size: int, alpha: float, l1: float, l2: float, epochs: int = 3, beta: float = 1.0, seed: int = 3) -> np.ndarray:
    """Per-coordinate FTRL-proximal; the last weight is the intercept, which is not regularised."""
    z, n, w = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    rng = np.random.default_rng(seed)
    bias = np.array([size])
    one = np.ones(1)

    def leader(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        shrunk = np.where(at == size, zi, np.sign(zi) * np.maximum(np.abs(zi) - l1, 0))
        return -shrunk / ((beta + np.sqrt(n[at])) / alpha + l2)

    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = np.concatenate([rows[i][0], bias]), np.concatenate([rows[i][1], one])
            now = leader(at)
            g = (sigmoid(now @ x) - labels[i]) * weights[i] * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * now
            n[at] += g * g
    w[:] = leader(np.arange(size + 1))
    return w.astype(np.float32)


def features_of(texts: pa.Array, extract: Extract) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct features and their summed values."""
    from sparkweave.llm import bytesnp

    rows = []
    buf, offs = bytesnp.flat(texts)
    for a, b in bytesnp.slices(offs):
        at, value, first = extract(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
        row = np.repeat(np.arange(b - a), np.diff(first))
        cell, back = np.unique(row.astype(np.int64) << 32 | at, return_inverse=True)
        places, summed = (cell & 0xFFFFFFFF).astype(np.int32), np.bincount(back, value, len(cell)).astype(np.float32)
        ends = np.searchsorted(cell >> 32, np.arange(b - a + 1)).tolist()
        # Rows are views of flat arrays.
        rows += [(places[x:y], summed[x:y]) for x, y in zip(ends, ends[1:], strict=False)]
    return rows


def labelled(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``__key``, ``__label``, ``__text`` of every labelled document.

    A document with several label rows takes their mean, 0.5 counting as 1;
    null ids, null labels and labels of no document of ``docs`` are left out,
    so that the labels of documents kept from ``docs`` decide nothing.  Of
    documents with one id the smallest text is used.
    """
    docs = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg((F.avg(label) >= 0.5).cast("int").alias("__label"))
    return docs.join(known, "__key").groupBy("__key", "__label").agg(F.min("__text").alias("__text"))


def fit(docs: DataFrame, labels: DataFrame, label: str, extract: Extract, size: int, key: str = "doc_id", text: str = "text", **how: float) -> np.ndarray:
    """Weights fitted on all ``labelled`` documents; zeros where there is none."""
    share_code(docs.sparkSession)
    texts = materialise(labelled(docs, labels, label, key, text), "labelled")
    weights = fit_on(texts, extract, size, **how)
    discard(docs.sparkSession, texts)
    return weights


def fit_on(texts: DataFrame, extract: Extract, size: int, **how: float) -> np.ndarray:
    """Weights fitted on all rows of ``texts``: the mean of the weights that tasks find, each on about ``ROWS`` rows dealt by hash; zeros without rows.

    A task holds its rows and one weight for each feature, and the driver the
    mean, however many rows there are.
    """
    total = texts.count()
    if not total:
        return np.zeros(size + 1, dtype=np.float32)
    tasks = -(-total // ROWS)
    dealt = texts.withColumn("__task", F.pmod(F.xxhash64(F.col("__key").cast("string")), F.lit(tasks)))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("__key").combine_chunks()
        y = rows["__label"].to_numpy().astype(float)
        w = train(features_of(rows["__text"].chunk(0), extract), y, np.ones(len(y)), size, **how)
        at = np.union1d(np.flatnonzero(w), [size])
        return pa.table({"at": pa.array(at.astype(np.int32)), "w": pa.array(np.rint(w[at] * UNIT).astype(np.int64))})

    # Whole numbers add up alike in any order.
    got = dealt.groupBy("__task").applyInArrow(run, "at int, w bigint").groupBy("at").agg(F.sum("w").alias("w"), F.count("*").alias("n")).toPandas()
    found = np.zeros(size + 1)
    found[got["at"]] = got["w"]
    return (found / (UNIT * got.loc[got["at"] == size, "n"].iloc[0])).astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray, extract: Extract, text: str = "text") -> DataFrame:
    """Append ``score``, the probability of label 1: the sparse dot product of a text's features and the weights.

    A null or empty text scores by the intercept.  A column named ``score`` is replaced.
    """
    share_code(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    kept = docs.select(*[f"`{c}`" for c in docs.columns if c != "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sparkweave.llm import bytesnp

        w = sent.value
        for batch in batches:
            buf, offs = bytesnp.flat(batch.column(batch.schema.get_field_index(text)))
            z = np.full(batch.num_rows, float(w[-1]))
            for a, b in bytesnp.slices(offs):
                at, value, first = extract(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                if len(at):
                    z[a:b] += np.bincount(np.repeat(np.arange(b - a), np.diff(first)), w[at] * value, b - a)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sigmoid(z))], names=[*batch.schema.names, "score"])

    return kept.mapInArrow(run, StructType([*kept.schema, StructField("score", DoubleType())]))
