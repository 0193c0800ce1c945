"""Exact nearest neighbours by a block matrix join with int8 tiles.

Queries and candidates are packed into blocks of quantised vectors with the
exact norms of what quantisation left out.  A tile (query block, candidate
block) is one integer matrix product; by Cauchy-Schwarz it bounds every
distance from below and above.  Pairs whose lower bound is above the k-th
smallest upper bound cannot be among the k nearest; all others are computed
again in double precision from the original vectors and merged by heaps, first
over the candidate blocks of a group, then over groups.

Candidates are packed where they are read and moved once, by group; a query
block is sent to every group.  Both kinds of block have a fixed size.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkweave.session import materialise, share_code

#: Vectors in a block of queries and of candidates, and candidate blocks aimed at for a group.
QUERY_BLOCK, BLOCK, GROUP_BLOCKS = 256, 1024, 16
_BLOCK = "ids binary, vectors binary, codes binary, scale binary, norm binary, rest binary, n int"


def usable(vector: Column) -> Column:
    """Vectors that take part: not null or empty, all components finite, not all zero."""
    x = vector.cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return F.coalesce((F.size(x) > 0) & fine & F.exists(x, lambda v: v != 0), F.lit(False))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, exact norms of the decoded vectors and of the remainders."""
    top = np.abs(x).max(1)
    scale = np.where(top > 0, top / 127.0, 1.0)
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    decoded = codes * scale[:, None]
    return codes, scale, np.sqrt((decoded**2).sum(1)), np.sqrt(((x - decoded) ** 2).sum(1))


def _pack(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(ids: np.ndarray, x: np.ndarray) -> list[bytes | int]:
            codes, scale, norm, rest = quantise(x)
            return [ids.tobytes(), x.tobytes(), codes.tobytes(), scale.tobytes(), norm.tobytes(), rest.tobytes(), len(ids)]

        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def flush(dim: int, all_of_it: bool) -> Iterator[pa.RecordBatch]:
            ids, x = (np.concatenate(p) for p in zip(*held[dim], strict=True))
            stop = len(ids) if all_of_it else len(ids) // size * size
            rows = [block(ids[i : i + size], x[i : i + size]) for i in range(0, stop, size)]
            held[dim] = [(ids[stop:], x[stop:])]
            for row in rows:
                yield pa.RecordBatch.from_arrays([*(pa.array([v], pa.binary()) for v in row[:-1]), pa.array([row[-1]], pa.int32())], names=["ids", "vectors", "codes", "scale", "norm", "rest", "n"])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            lists = batch.column(1)
            flat, sizes = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(lists.offsets.to_numpy())
            starts = np.concatenate([[0], np.cumsum(sizes)])
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                held.setdefault(dim, []).append((ids[rows], flat[starts[rows][:, None] + np.arange(dim)]))
                if sum(len(i) for i, _ in held[dim]) >= size:
                    yield from flush(dim, False)
        for dim in list(held):
            yield from flush(dim, True)

    return run


def tile(q: dict, c: dict, k: int, self_too: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Surviving pairs of a tile: query places, candidate ids, exact distances."""
    # Integer products up to 127 * 127 * dim are exact in single precision below 2 ** 24.
    kind = np.float32 if q["codes"].shape[1] < 1000 else np.float64
    product = (q["codes"].astype(kind) @ c["codes"].astype(kind).T).astype(np.float64) * q["scale"][:, None] * c["scale"][None, :]
    error = q["norm"][:, None] * c["rest"][None, :] + q["rest"][:, None] * c["norm"][None, :] + q["rest"][:, None] * c["rest"][None, :]
    square = (q["vectors"] ** 2).sum(1)[:, None] + (c["vectors"] ** 2).sum(1)[None, :]
    slack = error * 2 + 1e-9 * square
    near = square - 2 * product
    if not self_too:
        same = q["ids"][:, None] == c["ids"][None, :]
        near = np.where(same, np.inf, near)
    if near.shape[1] > k:
        bound = np.partition(near + slack, k - 1, 1)[:, k - 1]
    else:
        bound = np.full(len(near), np.inf)
    qi, ci = np.nonzero((near - slack <= bound[:, None]) & np.isfinite(near))
    total = np.zeros(len(qi))
    # Summed component by component, so that the result does not depend on how pairs are grouped.
    for j in range(q["vectors"].shape[1]):
        d = q["vectors"][qi, j] - c["vectors"][ci, j]
        total += d * d
    return qi, c["ids"][ci], np.sqrt(total)


def _unpack(row: dict) -> dict:
    n = row["n"]
    x = np.frombuffer(row["vectors"], np.float64).reshape(n, -1)
    return {"ids": np.frombuffer(row["ids"], np.int64), "vectors": x, "codes": np.frombuffer(row["codes"], np.int8).reshape(n, -1), **{k: np.frombuffer(row[k], np.float64) for k in ("scale", "norm", "rest")}}


def search(queries: DataFrame, candidates: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", self_too: bool = False) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the k nearest by Euclidean distance, exactly.

    Ties go to the smaller id.  Unusable vectors (see ``usable``) and null ids
    take no part; vectors of another length than the query's are no candidates.
    Repeated ids are separate candidates; a query never finds its own id unless
    ``self_too``; of query rows that share an id the smallest vector is searched.  Fewer candidates than k give fewer rows.
    """
    spark = queries.sparkSession
    share_code(spark)

    def packed(rows: DataFrame, size: int) -> DataFrame:
        fine = rows.where(usable(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("x"))
        return fine.mapInArrow(_pack(size), _BLOCK).withColumn("dim", (F.octet_length("codes") / F.col("n")).cast("int"))

    c = materialise(packed(candidates, BLOCK).withColumn("block", F.monotonically_increasing_id()), "blocks")
    blocks = c.count()
    groups = max(1, -(-blocks // GROUP_BLOCKS))
    # Queries come together first, so that their blocks are full.
    fine = queries.where(usable(F.col(vector))).groupBy(key).agg(F.min(vector).alias(vector))
    parts = max(1, fine.count() // (4 * QUERY_BLOCK))
    q = materialise(packed(fine.repartition(parts), QUERY_BLOCK).withColumn("qblock", F.monotonically_increasing_id()), "queries")
    left = q.select(*[F.col(x).alias(f"q_{x}") for x in ("ids", "vectors", "codes", "scale", "norm", "rest", "n")], "dim", "qblock", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    right = c.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")).drop("block")
    pairs = left.hint("merge").join(right, ["group", "dim"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list[tuple[float, int]]] = {}
        now = None

        def emit() -> Iterator[pa.RecordBatch]:
            if heaps:
                flat = [(i, -d, -v) for i, heap in heaps.items() for d, v in heap]
                ids, dist, vec = zip(*flat, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vec, pa.int64()), pa.array(dist, pa.float64())], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for row in batch.to_pylist():
                if now != (row["group"], row["qblock"]):
                    yield from emit()
                    heaps, now = {}, (row["group"], row["qblock"])
                a = _unpack({x[2:]: v for x, v in row.items() if x.startswith("q_")})
                qi, vec, dist = tile(a, _unpack(row), k, self_too)
                for i, v, d in zip(a["ids"][qi].tolist(), vec.tolist(), dist.tolist(), strict=True):
                    heap = heaps.setdefault(i, [])
                    if len(heap) < k:
                        heapq.heappush(heap, (-d, -v))
                    elif (-d, -v) > heap[0]:
                        heapq.heapreplace(heap, (-d, -v))
        yield from emit()

    found = pairs.mapInArrow(run, "query_id bigint, vec_id bigint, score double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
