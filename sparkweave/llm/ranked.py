"""Ranked lexical search by windowed bucket scoring.

Documents are read once: each gives its length and, for every term that some
query may hold, how often it occurs.  These narrow rows are dealt by ranges of
ids, so a task meets the documents of a fixed window of ids together and turns
them into postings, terms to places in the window.  A query adds the scores of
its terms' postings into an array of one cell for each place, which fits a
core's cache, and marks the places it touched in a bit set; these are harvested
into a heap of the best.

The terms of the queries are put into a bit filter of fixed size that goes to
every task, so only postings that may be asked for leave the scan.  With more
queries more terms pass, none is lost.  Queries reach the tasks in batches of
bounded size, each a pass over the written rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkweave.llm import bytesnp
from sparkweave.llm.filters import bit_filter, passes
from sparkweave.session import discard, materialise, share_code

#: Ids in a window, and most documents scored together where ids repeat.
WINDOW = 4096
#: Terms of the queries of a batch, with repeats, on average.
BATCH_TERMS = 1 << 20


def terms(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of the rows, and each row's first term."""
    starts, ends, first = bytesnp.words(buf, offs, bytesnp.ALNUM)
    return bytesnp.span_hash(bytesnp.LOWER[buf], starts, ends), first


def _query_terms(queries: DataFrame) -> DataFrame:
    """``query``, ``term``: the terms of each row of (query, text), once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = bytesnp.flat(batch.column(1))
            for a, b in bytesnp.slices(offs):
                hashes, first = terms(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                row = np.repeat(np.arange(a, b), np.diff(first))
                order = np.lexsort((hashes, row))
                row, hashes = row[order], hashes[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[new])), pa.array(hashes[new].view(np.int64))], names=["query", "term"])

    return queries.select("query", "text").mapInArrow(run, "query bigint, term bigint")


def _cut(data: np.ndarray, stops: np.ndarray) -> pa.Array:
    """One binary value for each run of ``data`` that ends at ``stops``."""
    offs = np.concatenate([[0], stops * data.itemsize]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(stops), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(data))])


def _documents(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """``id``, ``n``, ``terms``, ``tfs`` of every row of (id, text) with a term; terms that pass the filter, ascending, with their numbers."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = bytesnp.flat(batch.column(1))
            for a, b in bytesnp.slices(offs):
                hashes, first = terms(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                size = np.diff(first)
                row = np.repeat(np.arange(b - a), size)
                asked = passes(sent.value, hashes)
                row, hashes = row[asked], hashes[asked]
                order = np.lexsort((hashes, row))
                row, hashes = row[order], hashes[order]
                new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])])) if len(row) else np.zeros(0, np.int64)
                tf = np.diff(np.append(new, len(row)))
                row, hashes = row[new], hashes[new]
                own = np.flatnonzero(size)
                stops = np.searchsorted(row, own, "right")
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own + a)), pa.array(size[own]), _cut(hashes, stops), _cut(tf.astype(np.int32), stops)], names=["id", "n", "terms", "tfs"])

    return docs.mapInArrow(run, "id bigint, n bigint, terms binary, tfs binary")


def _frequencies(rows: DataFrame) -> DataFrame:
    """``term``, ``df``: in how many of the documents each term is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64)
            term, n = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(n)], names=["term", "df"])

    return rows.select("terms").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


@dataclass
class Batch:
    """Queries as runs of ``places`` into the ascending ``terms``, and what the scores need."""

    names: list[int]
    first: np.ndarray
    places: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    documents: int
    length: int

    @classmethod
    def of(cls, query: np.ndarray, term: np.ndarray, df: np.ndarray, documents: int, length: int) -> Batch:
        order = np.argsort(query, kind="stable")
        names, first = np.unique(query[order], return_index=True)
        distinct, at = np.unique(term, return_index=True)
        weights = np.array([weight(documents, d) for d in df[at].tolist()], np.int64)
        return cls(names.tolist(), np.append(first, len(query)), np.searchsorted(distinct, term[order]), distinct, weights, documents, length)


class Best:
    """The best documents of every query of a batch met so far; equal scores go by ascending id, null last."""

    def __init__(self, batch: Batch, k: int) -> None:
        self.batch, self.k = batch, k
        self.heaps: list[list[tuple[int, bool, int]]] = [[] for _ in batch.names]

    def window(self, ids: list[int | None], n: np.ndarray, terms: list[bytes], tfs: list[bytes]) -> None:
        """Score the documents of a window, given as they were read, for all queries."""
        b, size = self.batch, len(ids)
        found, tf = np.frombuffer(b"".join(terms), np.int64), np.frombuffer(b"".join(tfs), np.int32).astype(np.int64)
        slot = np.repeat(np.arange(size), [len(t) // 8 for t in terms])
        at = np.minimum(np.searchsorted(b.terms, found), len(b.terms) - 1)
        asked = np.flatnonzero(b.terms[at] == found)
        # Postings: the places of a term come together, ascending.
        asked = asked[np.argsort(at[asked], kind="stable")]
        at, slot, tf = at[asked], slot[asked], tf[asked]
        norm = 10 + (90 * n * b.documents) // b.length
        add = b.weights[at] * ((1_000_000_000 * tf) // (1000 * tf + 8 * norm[slot]))
        stop = np.searchsorted(at, np.arange(len(b.terms) + 1)).tolist()
        touched: dict[int, np.ndarray] = {}
        bucket, mark = np.zeros(size, np.int64), np.zeros(size, bool)
        for q, heap in enumerate(self.heaps):
            occupied = None
            for t in b.places[b.first[q] : b.first[q + 1]].tolist():
                i, j = stop[t], stop[t + 1]
                if i == j:
                    continue
                here = slot[i:j]
                bucket[here] += add[i:j]
                if t not in touched:
                    mark[here] = True
                    touched[t] = np.packbits(mark)
                    mark[here] = False
                occupied = touched[t] if occupied is None else occupied | touched[t]
            if occupied is None:
                continue
            place = np.flatnonzero(np.unpackbits(occupied, count=size))
            score = bucket[place]
            bucket[place] = 0
            least = heap[0][0] if len(heap) == self.k else 1
            fit = score >= least
            if fit.sum() > self.k:
                fit &= score >= np.partition(score, -self.k)[-self.k]
            for p, s in zip(place[fit].tolist(), score[fit].tolist(), strict=True):
                entry = (s, ids[p] is not None, -(ids[p] or 0))
                if len(heap) < self.k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)

    def rows(self) -> Iterator[tuple[int, int | None, int]]:
        for name, heap in zip(self.batch.names, self.heaps, strict=True):
            for score, known, other in heap:
                yield name, -other if known else None, score


def _score(rows: DataFrame, batch: Batch, k: int) -> DataFrame:
    """``query``, ``id``, ``score``: the best of every task, of rows that come in the order of their ids."""
    sent = rows.sparkSession.sparkContext.broadcast(batch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(sent.value, k)
        held: list[tuple] = []
        now: int | None = None

        def close() -> None:
            if held:
                ids, n, terms, tfs = zip(*held, strict=True)
                best.window(list(ids), np.array(n, np.int64), list(terms), list(tfs))
                held.clear()

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                window = None if row[0] is None else row[0] // WINDOW
                if window != now or len(held) == WINDOW:
                    close()
                    now = window
                held.append(row)
        close()
        found = list(best.rows())
        if found:
            query, ids, score = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.int64())], names=["query", "id", "score"])

    return rows.select("id", "n", "terms", "tfs").mapInArrow(run, "query bigint, id bigint, score bigint")


def search(docs: DataFrame, queries: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", batch_terms: int = BATCH_TERMS) -> DataFrame:
    """``item``, ``rank`` (from 1), ``key``, ``score``: the k documents of the highest scores above 0, equal scores by ascending id.

    Null texts and texts without a term match nothing and do not count.  Rows of
    one id are documents of their own, and so are rows with a null id, which come
    last among equal scores; every row of ``queries`` is a query of its own,
    whatever its id.  A term is known by a 64-bit hash.  Empty tables give no rows.
    """
    spark = docs.sparkSession
    share_code(spark)
    asked = materialise(queries.select(F.monotonically_increasing_id().alias("query"), F.col(item).alias("item"), F.col(item_text).alias("text")), "queries")
    wanted = materialise(_query_terms(asked), "terms")
    bits = bit_filter(wanted)
    found = _documents(docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")), bits)
    found = materialise(found, "documents")
    whole = found.agg(F.count("*").alias("documents"), F.sum("n").alias("length")).first()
    df = materialise(_frequencies(found).join(wanted.select("term").distinct(), "term", "left_semi"), "frequencies")
    weighed = materialise(wanted.join(df, "term").select("query", "term", "df"), "weighed")
    # Ranges of ids, cut further by a hash where many rows share one.
    dealt = found.repartitionByRange("id", F.xxhash64("terms")).sortWithinPartitions("id")
    batches = max(1, -(-weighed.count() // batch_terms))
    if batches > 1:
        dealt = materialise(dealt, "windows")
    best = None
    for i in range(batches):
        part = weighed.where(F.pmod(F.xxhash64("query"), F.lit(batches)) == i).toPandas()
        if not len(part):
            continue
        batch = Batch.of(part["query"].to_numpy(np.int64), part["term"].to_numpy(np.int64), part["df"].to_numpy(np.int64), whole["documents"], whole["length"])
        got = materialise(_score(dealt, batch, k), "scores")
        best = got if best is None else best.unionByName(got)
    types = dict(queries.dtypes)
    if best is None:
        return spark.createDataFrame([], f"`{item}` {types[item]}, rank int, `{key}` bigint, score bigint")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last()))
    ranked = best.withColumn("rank", place).where(F.col("rank") <= k)
    named = ranked.join(asked.select("query", "item"), "query")
    for table in (found, wanted, df, weighed):
        discard(spark, table)
    return named.select(F.col("item").alias(item), "rank", F.col("id").alias(key), "score")
