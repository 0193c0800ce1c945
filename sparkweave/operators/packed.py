"""Readings of all pairs in which no table of pairs is shuffled or written: tasks read the arcs part by part.

The arcs lie in the shared folder in parts of bounded size, each with the arcs
into a range of nodes. A task answers for a bounded number of first nodes at a
time, goes through the parts for these, and keeps a few numbers for each node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame

from sparkweave.session import materialise, share_code

#: Arcs of one part at most, or about so many, and of one step of a task; rows of one batch.
PART, STEP, ROWS = 1 << 23, 1 << 16, 1 << 16
#: Numbers that a task holds at a time: as many first nodes as nodes fit into them.
CELLS = 1 << 23


def parts(arcs: DataFrame, by: str) -> DataFrame:
    """``arcs(a, b)``, numbers from 0, written in files by ranges of ``b``, each in the order of ``by``."""
    rows = arcs.selectExpr("CAST(a AS INT) AS a", "CAST(b AS INT) AS b")
    dealt = rows.repartitionByRange(max(1, -(-arcs.count() // PART)), "b")
    return materialise(dealt.sortWithinPartitions(by, "b" if by == "a" else "a"), "parts")


def _read(file: str, *columns: str) -> list[pa.ChunkedArray]:
    fs, path = pafs.FileSystem.from_uri(file)
    return pq.read_table(path, columns=list(columns), filesystem=fs, use_threads=False).columns


class _Parts:
    """In a task: of every part the other ends in the order of ``by``, and where those of each of ``n`` nodes begin. The part read last is kept."""

    def __init__(self, files: list[str], by: str, n: int) -> None:
        self.files, self.by, self.n = files, by, n
        self.kept: tuple[str | None, tuple] = None, ()

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for file in self.files:
            if file != self.kept[0]:
                self.kept = None, ()
                key, other = (x.to_numpy() for x in _read(file, self.by, "b" if self.by == "a" else "a"))
                self.kept = file, (other, np.concatenate([[0], np.cumsum(np.bincount(key, minlength=self.n))]))
            yield self.kept[1]


def _tasks(table: DataFrame, units: int) -> int:
    """How many tasks share ``units`` pieces of work."""
    spark = table.sparkSession
    share_code(spark)
    return max(1, min(4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), units))


def _product(near: np.ndarray, times: np.ndarray, to: np.ndarray, first: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Where one more arc leads from ``near``, and how many walks end there if ``times`` end at ``near``."""
    total = np.zeros(len(first) - 1, np.int64)
    begin = first[near]
    n = first[near + 1] - begin
    upto = np.cumsum(n)
    # A step is cut before the node whose arcs would pass its end, so it has ``step`` arcs, or those of one node, at most.
    x = 0
    while x < len(near):
        y = max(x + 1, int(np.searchsorted(upto, upto[x] - n[x] + step, "right")))
        own = n[x:y]
        ends = np.cumsum(own)
        at = np.arange(ends[-1]) + np.repeat(begin[x:y] - ends + own, own)
        np.add.at(total, to[at], np.repeat(times[x:y], own))
        x = y
    found = np.flatnonzero(total)
    return found, total[found]


def walks(arcs: DataFrame, names: DataFrame, n: int, length: int) -> DataFrame:
    """``src``, ``dst``, ``walks`` of ``length`` arcs along ``arcs(a, b)``, made as they are read; ``names(id, k)`` are the ``n`` nodes, from 0.

    A node's arcs are shuffled to a task, which follows them and adds up the
    walks before it gives their rows. Sums must fit 64 bits.
    """
    table = parts(arcs, "a")
    files, named = table.inputFiles(), names.inputFiles()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ks = (pa.chunked_array([c for t in x for c in t.chunks]) for x in zip(*[_read(f, "id", "k") for f in named], strict=True))
        ids = ids.take(pa.array(np.argsort(ks.to_numpy()))).combine_chunks()
        read = _Parts(files, "a", n)
        held: list[tuple[int, np.ndarray, np.ndarray]] = []

        def given() -> Iterator[pa.RecordBatch]:
            src = np.repeat([a for a, _, _ in held], [len(near) for _, near, _ in held])
            dst, times = (np.concatenate([h[k] for h in held]) for k in (1, 2))
            held.clear()
            for x in range(0, len(src), ROWS):
                y = x + ROWS
                yield pa.record_batch([ids.take(pa.array(src[x:y])), ids.take(pa.array(dst[x:y])), pa.array(times[x:y])], ["src", "dst", "walks"])

        for block in _blocks(batches, max(1, CELLS // n)):
            # Parts are ranges of the ends, so what they give is joined end to end.
            for _ in range(length - 2):
                found = [[] for _ in block]
                for to, first in read:
                    for (_, near, times), more in zip(block, found, strict=True):
                        more.append(_product(near, times, to, first, STEP))
                block = [(a, *(np.concatenate(x) for x in zip(*more, strict=True))) for (a, _, _), more in zip(block, found, strict=True)]
            for last in read if length > 1 else [None]:
                for a, near, times in block:
                    got = _product(near, times, *last, STEP) if last else (near, times)
                    held.append((a, *got))
                    if sum(len(h[1]) for h in held) >= ROWS:
                        yield from given()
        if held:
            yield from given()

    origins = table.join(names.selectExpr("CAST(k AS INT) AS a", "id"), "a").select("a", "b")
    return origins.repartition(_tasks(table, -(-n // 64)), "a").sortWithinPartitions("a", "b").mapInArrow(run, "src string, dst string, walks bigint")


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[tuple[int, np.ndarray, np.ndarray]]]:
    """Of rows ``a``, ``b`` in their order, lists of ``most`` of the ``a``, each with its ``b`` and as many ones."""
    block: list[tuple[int, np.ndarray, np.ndarray]] = []
    a, held = None, []
    for batch in batches:
        x, y = (batch.column(k).to_numpy() for k in (0, 1))
        cuts = [0, *(np.flatnonzero(x[1:] != x[:-1]) + 1).tolist(), len(x)] if len(x) else []
        for i, j in zip(cuts, cuts[1:]):
            if a is not None and x[i] != a:
                block.append(_ends(a, held))
                held = []
                if len(block) >= most:
                    yield block
                    block = []
            a = int(x[i])
            held.append(y[i:j].copy())
    if held:
        yield [*block, _ends(a, held)]


def _ends(a: int, held: list[np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
    return a, *np.unique(np.concatenate(held), return_counts=True)


def hop_sums(arcs: DataFrame, n: int) -> DataFrame:
    """``k``, ``r``, ``total``, ``inverse`` along ``arcs(a, b)`` between ``n`` nodes, from 0: how many others each node ``k`` that has an arc reaches, and the sums of their hops and of one by their hops.

    Origins are bits: a task keeps 64 of them in a number for each node, for as
    many such words as fit, and goes through the parts once for each hop.
    """
    table = parts(arcs, "b")
    files, most = table.inputFiles(), max(1, CELLS // (4 * n + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _Parts(files, "b", n)
        for batch in batches:
            words = batch.column(0).to_numpy()
            for x in range(0, len(words), most):
                k, r, total, inverse = _hops(words[x : x + most], read, n, STEP)
                yield pa.record_batch([pa.array(k), pa.array(r), pa.array(total), pa.array(inverse)], ["k", "r", "total", "inverse"])

    words = -(-n // 64)
    return table.sparkSession.range(0, words, 1, _tasks(table, words)).mapInArrow(run, "k bigint, r bigint, total bigint, inverse double")


def _hops(words: np.ndarray, read: _Parts, n: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sums of ``hop_sums`` for the origins of ``words``, those with a node to reach."""
    k = (words[:, None] * 64 + np.arange(64)).ravel()
    own = k < n
    fresh = np.zeros((len(words), n), "<u8")
    fresh[np.repeat(np.arange(len(words)), 64)[own], k[own]] = np.left_shift(np.uint64(1), (k[own] % 64).astype(np.uint64))
    seen = fresh.copy()
    r, total, inverse = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64), np.zeros(len(k))
    live, hops = np.arange(len(words)), 0
    while len(live):
        hops += 1
        got = np.zeros((len(words), n), "<u8")
        for src, first in read:
            to = np.flatnonzero(first[1:] > first[:-1])
            # As many ends at a time as have about ``step`` arcs, or one.
            cuts = np.unique([0, *np.searchsorted(first[to], np.arange(step, len(src), step)).tolist(), len(to)])
            for i, j in zip(cuts, cuts[1:]):
                begin = first[to[i]]
                near, at = src[begin : first[to[j - 1] + 1]], first[to[i:j]] - begin
                for w in live:
                    got[w, to[i:j]] = np.bitwise_or.reduceat(fresh[w][near], at)
        fresh = got & ~seen
        seen |= fresh
        live = np.flatnonzero(fresh.any(axis=1))
        for w in live:
            came = np.unpackbits(fresh[w][fresh[w] != 0].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            at = slice(64 * w, 64 * w + 64)
            r[at] += came
            total[at] += hops * came
            inverse[at] += came / hops
    found = r > 0
    return k[found], r[found], total[found], inverse[found]
