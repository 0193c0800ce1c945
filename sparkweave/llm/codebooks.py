"""Vector code compression: each part of a vector is replaced by the number of its nearest codebook entry.

Vectors become integers, are cut into equal parts, and are packed where they
are read into blocks that hold one dimension after the other.  In every round
each task assigns the parts of its blocks, distances growing dimension by
dimension, and tallies them with ``np.add.at`` into int64 tensors of sums and
counts; the tensors, whose size does not depend on the data, meet in a
reduction tree.  All arithmetic is on integers, so neither blocks nor the shape
of the tree change a result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweave.session import materialise, share_code

#: Parts of a vector, entries of a codebook, rounds, and what components are multiplied by.
PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors in a block: distances of a part to all entries stay in a core's cache.
BLOCK = 4096
#: A label with more than this share of all rows meets its sum by broadcast; there are at most as many such labels.
FREQUENT = 1000


def usable(vector: Column) -> Column:
    """Vectors that take part: not null or empty, no component null or not finite."""
    x = vector.cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return F.coalesce((F.size(x) > 0) & fine, F.lit(False))


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)``; values whose squared distances could overflow are refused."""
    out = np.floor(scale * x)
    if out.size and np.abs(out).max() >= np.sqrt(2.0**60 / x.shape[1]):
        raise ValueError("a component is too large for exact distances")
    return out.astype(np.int64)


def distances(part: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances (entries, vectors) of a columnar part (dimensions, vectors) to the rows of ``entries``."""
    total = np.zeros((len(entries), part.shape[1]), np.int64)
    for j in range(len(part)):
        step = part[j][None, :] - entries[:, j][:, None]
        total += step * step
    return total


def _blocks(rows: DataFrame, scale: int, label_type: str) -> DataFrame:
    """Rows (id, label, x) as blocks: ``ids``, ``labels``, and the integers one dimension after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(a, BLOCK)
                n = piece.num_rows
                x = piece.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
                lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), c) for c in (piece.column(0), piece.column(1))]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([np.ascontiguousarray(integers(x, scale).T).tobytes()], pa.binary())], names=["ids", "labels", "x"])

    return rows.mapInArrow(run, f"ids array<{dict(rows.dtypes)['id']}>, labels array<{label_type}>, x binary")


def first_entries(rows: DataFrame, parts: int, entries: int, scale: int) -> np.ndarray:
    """The parts of the vectors (id, x) of the smallest ids, as (part, entry, dimension); null ids come last, ties go by the vector."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    x = integers(np.array([r["x"] for r in first], np.float64), scale)
    return x.reshape(len(first), parts, -1).transpose(1, 0, 2)


def train(blocks: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """Codebooks after ``rounds`` rounds over ``blocks(x)``; entries without a part stay as they are."""
    parts, entries, width = books.shape
    held = blocks.select("x").rdd.map(lambda row: np.frombuffer(row["x"], np.int64).reshape(parts, width, -1))

    def merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return a[0] + b[0], a[1] + b[1]

    for _ in range(rounds):
        now = books

        def tally(total: tuple[np.ndarray, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            sums, counts = total[0].copy(), total[1].copy()
            for p in range(parts):
                nearest = distances(x[p], now[p]).argmin(0)
                np.add.at(sums[p], nearest, x[p].T)
                np.add.at(counts[p], nearest, 1)
            return sums, counts

        sums, counts = held.treeAggregate((np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)), tally, merge)  # noqa: B023  runs in this round
        books = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)
    return books


def encode(blocks: DataFrame, books: np.ndarray, key_type: str, label_type: str) -> DataFrame:
    """``id``, ``label``, ``code``, ``error`` of every vector of ``blocks``."""
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = np.frombuffer(batch.column(2)[i].as_buffer(), np.int64).reshape(parts, width, -1)
                n = x.shape[2]
                codes, error = np.zeros((n, parts), np.uint8), np.zeros(n, np.int64)
                for p in range(parts):
                    d = distances(x[p], books[p])
                    codes[:, p] = d.argmin(0)
                    error += d.min(0)
                text = codes.tobytes().hex()
                code = pa.array([text[k : k + 2 * parts] for k in range(0, len(text), 2 * parts)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, batch.column(1)[i].values, code, pa.array(error)], names=["id", "label", "code", "error"])

    return blocks.select("ids", "labels", "x").mapInArrow(run, f"id {key_type}, label {label_type}, code string, error bigint")


def decode(code: str, books: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The vector that a code stands for."""
    return np.concatenate([books[p, i] for p, i in enumerate(bytes.fromhex(code))]) / scale


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the errors of all rows of the same label added up; null labels are one.

    Labels of many rows are few, so their sums are broadcast; no other label has
    rows enough to burden a task.
    """
    sums = materialise(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label-errors")
    rows = sums.agg(F.sum("n")).first()[0] or 0
    frequent = F.broadcast(sums.where(F.col("n") * FREQUENT >= rows).select(F.col("label").alias("of"), "label_error"))
    rare = sums.where(F.col("n") * FREQUENT < rows).select(F.col("label").alias("of"), "label_error")
    same = F.col("label").eqNullSafe(F.col("of"))
    return coded.join(frequent, same).drop("of").unionByName(coded.join(frequent, same, "left_anti").join(rare, same).drop("of"))


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """``key``, ``code``, ``error``, ``label_error`` of every usable vector, and the codebooks (part, entry, dimension).

    Codebooks start as the vectors of the smallest ids; fewer vectors give fewer
    entries.  Unusable vectors (see ``usable``) take no part, nor do those whose
    length ``parts`` does not divide or is not that of the smallest id.  Null ids
    are kept and come after all others; repeated rows count each.  An empty
    table gives no rows and empty codebooks.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code of two hex digits needs 1 to 256 entries")
    spark = vectors.sparkSession
    share_code(spark)
    rows = vectors.where(usable(F.col(vector))).select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("x")).where(F.size("x") % parts == 0)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "x").select(F.size("x").alias("n")).first()
    key_type, label_type = (dict(rows.dtypes)[c] for c in ("id", "label"))
    if first is None:
        return spark.createDataFrame([], f"`{key}` {key_type}, code string, error bigint, label_error bigint"), np.zeros((parts, 0, 0), np.int64)
    rows = rows.where(F.size("x") == first["n"])
    blocks = materialise(_blocks(rows, scale, label_type), "blocks")
    books = train(blocks, first_entries(rows, parts, entries, scale), rounds)
    coded = materialise(encode(blocks, books, key_type, label_type), "codes")
    return with_label_errors(coded).select(F.col("id").alias(key), "code", "error", "label_error"), books
