"""Brown class-based n-grams: exchange clustering and smoothed class perplexity.

Passes over the corpus, all on Spark:

1. counts of every word (and of the end token) of the training documents;
2. bigram counts over the ``vocab`` most frequent words, among which words are
   exchanged between classes until the likelihood stands still;
3. contexts of all other words that occur twice or more: each goes to the class
   that raises the likelihood of its neighbours' classes most, so classes cover
   the whole vocabulary, and the table of classes grows with it;
4. class bigrams of the whole corpus, words outside the ``hot`` most frequent
   ones getting their classes by a join;
5. scores, the same way.

Words are known by a 64-bit hash.  Every word and every document counts;
``vocab`` and ``hot`` bound what the driver and a task hold, not what is learnt.
Words that occur once form one class with one unseen word, with emissions by
their own counts, so the model is a distribution over all words and that one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from sparkweave.llm import bytesnp
from sparkweave.session import discard, materialise, share_code

#: The hash that stands for the end token; no word hashes to it in practice.
END = -1
#: Added to counts of words and to class transitions.
EMIT, MOVE = 0.1, 0.5


@dataclass(frozen=True)
class Model:
    """All that a task needs: hot words with counts and classes, and the class tables."""

    hot: np.ndarray  # sorted uint64 hashes
    count: np.ndarray  # their counts
    word_class: np.ndarray  # their classes
    move: np.ndarray  # log10 P(class | class before)
    size: np.ndarray  # tokens of each class
    total: int
    distinct: int
    rare_total: int
    rare_distinct: int

    @property
    def rare(self) -> int:
        """The class of words that occur once and of unseen ones."""
        return len(self.size) - 2

    @property
    def end(self) -> int:
        return len(self.size) - 1


def _tokens(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of a batch with the hashes of their words and each row's first word."""
    buf, offs = bytesnp.flat(batch.column(batch.schema.get_field_index(column)))
    for a, b in bytesnp.slices(offs):
        part = bytesnp.LOWER[buf[offs[a] : offs[b]]]
        starts, ends, first = bytesnp.words(part, offs[a : b + 1] - offs[a], bytesnp.NOT_SPACE)
        yield a, b, bytesnp.span_hash(part, starts, ends), first


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word`` (hash), ``n``: tokens of every word of all documents, and of the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.full(batch.num_rows, np.uint64(END & (1 << 64) - 1))]
            found += [h for _, _, h, _ in _tokens(batch, text)]
            word, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    return docs.select(text).mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _symbols(hashes: np.ndarray, first: np.ndarray, vocab: np.ndarray) -> np.ndarray:
    """The token sequence of the rows: vocabulary places, then one number for other words and one for the end.

    The sequence starts with an end, so that every row has one before it.
    """
    place = np.searchsorted(vocab, hashes)
    place[place == len(vocab)] = 0
    known = vocab[place] == hashes if len(vocab) else np.zeros(len(hashes), bool)
    place = np.where(known, place, len(vocab))
    return np.concatenate([[len(vocab) + 1], np.insert(place, first[1:], len(vocab) + 1)])


def bigrams(docs: DataFrame, vocab: np.ndarray, text: str = "text") -> DataFrame:
    """``a``, ``b``, ``n``: counts of neighbouring symbols; at most (len(vocab) + 2) squared rows."""
    sent = docs.sparkSession.sparkContext.broadcast(vocab)
    width = len(vocab) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, _, hashes, first in _tokens(batch, text):
                symbols = _symbols(hashes, first, sent.value)
                found.append(symbols[:-1] * width + symbols[1:])
            pair, n = np.unique(np.concatenate([*found, np.zeros(0, np.int64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair // width, pa.int32()), pa.array(pair % width, pa.int32()), pa.array(n.astype(np.int64))], names=["a", "b", "n"])

    return docs.select(text).mapInArrow(run, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _contexts(table: DataFrame, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every symbol, how often each class follows it and stands before it."""
    spark, k = table.sparkSession, int(classes.max()) + 1
    of = F.broadcast(spark.createDataFrame(pd.DataFrame({"at": np.arange(len(classes), dtype=np.int32), "c": classes.astype(np.int32)})))
    right = table.join(of, F.col("b") == F.col("at")).groupBy(F.col("a").alias("s"), "c").agg(F.sum("n").alias("n"), F.lit(0).alias("side"))
    left = table.join(of, F.col("a") == F.col("at")).groupBy(F.col("b").alias("s"), "c").agg(F.sum("n").alias("n"), F.lit(1).alias("side"))
    cells = right.unionByName(left).select(((F.col("side") * len(classes) + F.col("s")) * k + F.col("c")).alias("at"), "n").toArrow()
    out = np.zeros(2 * len(classes) * k)
    for part in cells.to_batches():
        out[part.column(0).to_numpy()] = part.column(1).to_numpy()
    out = out.reshape(2, len(classes), k)
    return out[0], out[1]


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def likelihood(right: np.ndarray, classes: np.ndarray) -> float:
    """The part of the class bigrams' log likelihood that depends on the classes."""
    table = np.zeros((right.shape[1], right.shape[1]))
    np.add.at(table, classes, right)
    return float(_xlogx(table).sum() - _xlogx(table.sum(1)).sum() - _xlogx(table.sum(0)).sum())


def exchange(right: np.ndarray, left: np.ndarray, classes: np.ndarray, movable: np.ndarray, rest: float = 0.5, seed: int = 0) -> np.ndarray:
    """One round: every movable word may go to the class that raises the likelihood of the class bigrams most.

    Gains are taken from the tables of the round's start; a word moves with
    probability ``rest``, so that neighbours do not swap places for ever.
    """
    k = right.shape[1]
    member = np.zeros((len(classes), k))
    member[np.arange(len(classes)), classes] = 1
    table = member.T @ right
    follows, before = table.sum(1), table.sum(0)
    rng = np.random.default_rng(seed)
    out = classes.copy()
    base_rows = _xlogx(table)
    for w in np.flatnonzero(movable):
        if rng.random() > rest:
            continue
        c = classes[w]
        r, l = right[w], left[w]
        nr, nl = r.sum(), l.sum()
        # Without w: its row and column leave class c.
        row_c, col_c = table[c] - r, table[:, c] - l
        lost = (_xlogx(np.maximum(row_c, 0)) - base_rows[c]).sum() + (_xlogx(np.maximum(col_c, 0)) - base_rows[:, c]).sum() - (_xlogx(np.maximum(follows[c] - nr, 0)) - _xlogx(follows[c])) - (_xlogx(np.maximum(before[c] - nl, 0)) - _xlogx(before[c]))
        gain = (_xlogx(table + r) - base_rows).sum(1) + (_xlogx(table + l[:, None]) - base_rows).sum(0) - (_xlogx(follows + nr) - _xlogx(follows)) - (_xlogx(before + nl) - _xlogx(before)) + lost
        gain[c] = 0
        gain[k - 2 :] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] > 1e-9:
            out[w] = best
    return out


def _cluster(pairs: DataFrame, start: np.ndarray, movable: np.ndarray, least: float = 1e-2) -> tuple[np.ndarray, np.ndarray]:
    """Exchange rounds until one gains less than ``least`` of what all have gained; the classes and their bigram table.

    A round that lowers the likelihood is undone and fewer words move in the next.
    """
    now, (right, left) = start, _contexts(pairs, start)
    first = value = likelihood(right, now)
    rest, seed = 0.5, 0
    while rest > 0.05:
        new = exchange(right, left, now, movable, rest, seed)
        seed += 1
        if (new == now).all():
            break
        r, l = _contexts(pairs, new)
        got = likelihood(r, new)
        if got < value:
            rest /= 2
            continue
        small = got - value < least * (got - first)
        now, right, left, value = new, r, l, got
        if small:
            break
    table = np.zeros((right.shape[1], right.shape[1]))
    np.add.at(table, now, right)
    return now, table


def _neighbours(hashes: np.ndarray, first: np.ndarray, known: np.ndarray, classes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The place in ``known`` of every token, its class and those before and after it, -1 where it is not known; rows begin and stop with an end."""
    place = np.searchsorted(known, hashes)
    place[place == len(known)] = 0
    own = np.where(known[place] == hashes, classes[place], -1) if len(known) else np.full(len(hashes), -1)
    path = np.concatenate([[end], np.insert(own, first[1:], end)])
    at = 1 + np.arange(len(own)) + np.repeat(np.arange(len(first) - 1), np.diff(first))
    return place, own, path[at - 1], path[at + 1]


def _key(word: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """One number for a word and a cell, alike for like ones; words are hashes, so others rarely share it."""
    return word ^ (cell.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _tally(word: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, cell) and how often each occurs; one that shares its sorting key with another may come in parts."""
    order = np.argsort(_key(word, cell))
    w, c = word[order], cell[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (c[1:] != c[:-1])
    heads = np.flatnonzero(new)
    return w[heads], c[heads], np.diff(np.append(heads, len(w)))


class _Tallies:
    """Gathers words and cells and tallies them when there are ``most`` of them."""

    def __init__(self, most: int = 1 << 20) -> None:
        self.most, self.held, self.size = most, [], 0

    def add(self, word: np.ndarray, cell: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        self.held.append((word, cell))
        self.size += len(word)
        if self.size >= self.most:
            yield from self.rest()

    def rest(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if self.size:
            yield _tally(*(np.concatenate(x) for x in zip(*self.held)))
        self.held, self.size = [], 0


def contexts(docs: DataFrame, known: np.ndarray, classes: np.ndarray, k: int, text: str = "text") -> DataFrame:
    """``word``, ``cell`` (class before times k + 2, plus class after; k where not known), ``n`` of every word outside ``known``."""
    sent = docs.sparkSession.sparkContext.broadcast((known, classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = _Tallies()

        def rows(word: np.ndarray, cell: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(cell), pa.array(n.astype(np.int64))], names=["word", "cell", "n"])

        for batch in batches:
            for _, _, hashes, first in _tokens(batch, text):
                _, own, before, after = _neighbours(hashes, first, *sent.value, k + 1)
                new = own < 0
                before, after = (np.where(x < 0, k, x)[new] for x in (before, after))
                for got in tallies.add(hashes[new], (before * (k + 2) + after).astype(np.int32)):
                    yield rows(*got)
        for got in tallies.rest():
            yield rows(*got)

    return docs.select(text).mapInArrow(run, "word bigint, cell int, n bigint")


def assign(found: DataFrame, table: np.ndarray, k: int) -> DataFrame:
    """``word``, ``cls`` of every word of ``contexts`` that occurs twice or more: the class in which its neighbours are likeliest.

    This is the exchange gain of a word that enters a class, its own counts being
    small against the class's.  Ties go to the first class.
    """
    smooth = table[:k] + MOVE * (table[:k].sum(0) + 1) / (table.sum() + 1)
    after = np.log(smooth / smooth.sum(1, keepdims=True))
    smooth = table[:, :k].T + MOVE * (table[:, :k].sum(1) + 1) / (table.sum() + 1)
    before = np.log(smooth / smooth.sum(1, keepdims=True))
    sent = found.sparkSession.sparkContext.broadcast((before.T, after.T))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = sent.value
        held = [np.zeros(0, np.int64)] * 3

        def close(word: np.ndarray, cell: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(word):
                heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
                total = np.add.reduceat(n, heads)
                gain = np.add.reduceat((gains[0][cell // (k + 2)] + gains[1][cell % (k + 2)]) * n[:, None], heads)
                often = total > 1
                yield pa.RecordBatch.from_arrays([pa.array(word[heads][often]), pa.array(gain.argmax(1)[often].astype(np.int32))], names=["word", "cls"])

        for batch in batches:
            rows = [np.concatenate([h, batch.column(i).to_numpy().astype(np.int64)]) for i, h in enumerate(held)]
            # The last word may go on in the next batch.
            cut = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
            held = [r[cut:] for r in rows]
            yield from close(*(r[:cut] for r in rows))
        yield from close(*held)

    return found.repartition("word").sortWithinPartitions("word").mapInArrow(run, "word bigint, cls int")


_TOKEN = "array<struct<word:bigint,before:int,after:int,n:int>>"
_PAIR = "array<struct<word:bigint,next:bigint>>"


def class_bigrams(docs: DataFrame, known: np.ndarray, of: np.ndarray, classes: DataFrame, k: int, text: str = "text") -> np.ndarray:
    """Counts of class bigrams over all of ``docs``; words outside ``known`` get their classes from ``classes(word, cls)``, others are of class k."""
    sent = docs.sparkSession.sparkContext.broadcast((known, of))
    size = k + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        names = ["word", "next", "cell", "n"]
        tallies = _Tallies()

        def single(word: np.ndarray, cell: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.nulls(len(word), pa.int64()), pa.array(cell), pa.array(n.astype(np.int64))], names=names)

        for batch in batches:
            for _, _, hashes, first in _tokens(batch, text):
                _, own, before, after = _neighbours(hashes, first, *sent.value, k + 1)
                fine = own >= 0
                # Every bigram is taken with its second token; the end's with the token before it.
                both = fine & (before >= 0)
                total += np.bincount(before[both] * size + own[both], minlength=size * size)
                last = fine & (after == k + 1)
                total += np.bincount(own[last] * size + k + 1, minlength=size * size)
                empty = int((np.diff(first) == 0).sum())
                total[(k + 1) * size + k + 1] += empty
                new = ~fine
                # A token that is not known, beside known ones: cells before, then cells after.
                ahead, behind = new & (before >= 0), new & (after >= 0)
                for got in tallies.add(np.concatenate([hashes[ahead], hashes[behind]]), np.concatenate([before[ahead], size + after[behind]]).astype(np.int32)):
                    yield single(*got)
                two = np.flatnonzero(new & (after < 0))
                yield pa.RecordBatch.from_arrays([pa.array(hashes[two].view(np.int64)), pa.array(hashes[two + 1].view(np.int64)), pa.nulls(len(two), pa.int32()), pa.array(np.ones(len(two), np.int64))], names=names)
        for got in tallies.rest():
            yield single(*got)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.int64()), pa.array(at.astype(np.int32)), pa.array(total[at])], names=names)

    found = materialise(docs.select(text).mapInArrow(run, "word bigint, next bigint, cell int, n bigint"), "steps")
    rest = F.lit(k)
    one = found.where("word is not null and next is null").groupBy("word", "cell").agg(F.sum("n").alias("n")).join(classes, "word", "left").withColumn("cls", F.coalesce("cls", rest))
    one = one.select(F.when(F.col("cell") < size, F.col("cell") * size + F.col("cls")).otherwise(F.col("cls") * size + F.col("cell") - size).alias("cell"), "n")
    two = found.where("next is not null").groupBy("word", "next").agg(F.sum("n").alias("n")).join(classes, "word", "left").join(classes.toDF("next", "then"), "next", "left")
    two = two.select((F.coalesce("cls", rest) * size + F.coalesce("then", rest)).alias("cell"), "n")
    known_ = found.where("word is null").select("cell", "n")
    got = known_.unionByName(one).unionByName(two).groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    discard(docs.sparkSession, found)
    out = np.zeros(size * size)
    out[got["cell"]] = got["n"]
    return out.reshape(size, size)


def _frequent(counts: DataFrame, hot: int) -> Column:
    """Which words are the ``hot`` most frequent ones, by a threshold from the counts of counts; of those on it a share by hash.

    Only counts of counts and the words asked for come to the driver, not the first words of every partition.
    """
    left, edge, share = hot, 1, 1.0
    for r in counts.where(F.col("word") != END).groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).toLocalIterator():
        edge, share = r["n"], min(1.0, left / r["words"])
        left -= r["words"]
        if left <= 0:
            break
    on = F.pmod(F.col("word"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    return (F.col("word") != END) & ((F.col("n") > edge) | ((F.col("n") == edge) & on))


def fit(docs: DataFrame, text: str = "text", classes: int = 48, vocab: int = 4096, hot: int = 65536) -> tuple[Model, DataFrame]:
    """Cluster and count on all of ``docs``; also the written table ``word, n, cls`` (null for words that occur once).

    No documents, or only empty ones, give a model that knows no word.
    """
    share_code(docs.sparkSession)
    spark = docs.sparkSession
    counts = materialise(word_counts(docs, text), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    wanted = _frequent(counts, hot)
    top = counts.where(wanted).toPandas().sort_values(["n", "word"], ascending=[False, True])
    words = top["word"].to_numpy(np.int64).view(np.uint64)
    n = top["n"].to_numpy(np.int64)
    often = int((n[:vocab] > 1).sum())
    inner = np.sort(words[:often])
    rank = np.argsort(np.argsort(words[:often]))
    # Words of like frequency start together.
    start = np.zeros(len(inner) + 2, dtype=np.int64)
    start[rank] = np.arange(len(inner)) * classes // max(len(inner), 1)
    start[-2:] = classes, classes + 1
    pairs = materialise(bigrams(docs, inner, text), "bigrams")
    now, table = _cluster(pairs, start, np.arange(len(start)) < len(inner))
    discard(spark, pairs)
    placed = spark.createDataFrame(pd.DataFrame({"word": inner.view(np.int64), "cls": now[: len(inner)].astype(np.int32)}), "word bigint, cls int")
    placed = placed.unionByName(assign(contexts(docs, inner, now[: len(inner)], classes, text), table, classes))
    known = materialise(counts.join(placed, "word", "left"), "classes")
    discard(spark, counts)
    top = known.where(wanted).toPandas()
    words, n = top["word"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(words)
    at = top["cls"].fillna(classes).to_numpy().astype(np.int64)
    moves = class_bigrams(docs, words[order], at[order], known.where("cls is not null").select("word", "cls"), classes, text)
    arrive = moves.sum(0)
    prior = (arrive + MOVE) / (arrive.sum() + MOVE * len(arrive))
    move = np.log10((moves + MOVE * len(arrive) * prior) / (moves.sum(1, keepdims=True) + MOVE * len(arrive)))
    size = np.zeros(classes + 2, dtype=np.int64)
    rare = 0
    for r in known.groupBy(F.when(F.col("word") == END, classes + 1).otherwise(F.coalesce("cls", F.lit(classes))).alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        size[r["c"]] = r["n"]
        rare = r["words"] if r["c"] == classes else rare
    return Model(words[order], n[order], at[order], move, size, int(total), int(distinct), int(size[classes]), int(rare)), known


def score(docs: DataFrame, model: Model, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``row``, ``key``, ``n_tokens``, ``n_known``, ``base_score``, ``score`` of every row of ``docs``.

    A null or empty text is the end alone.  Rows that repeat, null keys
    included, are scored each: rows are told apart by ``row``.
    """
    spark = docs.sparkSession
    share_code(spark)
    sent = spark.sparkContext.broadcast(model)
    unit = np.log10(model.total + EMIT * (model.distinct + 1))
    # Words of the rare class share its mass with one unseen word.
    rare_unit = float(np.log10(model.rare_total + EMIT * (model.rare_distinct + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        class_unit = np.log10(np.maximum(m.size, 1).astype(float))
        # Of every hot word, and of a last one that stands for none.
        hot_emit = np.append(np.log10(m.count + EMIT), 0.0)
        hot_full = np.append(np.where(m.word_class == m.rare, hot_emit[:-1] - rare_unit, np.log10(np.maximum(m.count, 1)) - class_unit[m.word_class]), 0.0)
        for batch in batches:
            keys = batch.column(0)
            for a, b, hashes, first in _tokens(batch, text):
                rows, per = b - a, np.diff(first)
                place, own, before, after = _neighbours(hashes, first, m.hot, m.word_class, m.end)
                fine = own >= 0
                row = np.repeat(np.arange(rows), per)
                place = np.where(fine, place, len(m.hot))
                emit, full = hot_emit[place], hot_full[place]
                full += np.where(fine & (before >= 0), m.move[before, own], 0.0) + np.where(fine & (after == m.end), m.move[own, m.end], 0.0)
                base, total, hot_n = (np.bincount(row, x, rows) if len(row) else np.zeros(rows) for x in (emit, full, fine))
                total += np.where(per == 0, m.move[m.end, m.end], 0.0)
                # Words that the table lacks, with the classes beside them (-1: not known either), and pairs of such words.
                new = ~fine
                cell = (before[new] + 1) * (len(m.size) + 1) + after[new] + 1
                r, h = row[new], hashes[new]
                # Rows first; what shares the rest of a key only comes in more parts, which are summed later.
                order = np.argsort((r.astype(np.uint64) << np.uint64(40)) | (_key(h, cell) >> np.uint64(24)))
                r, h, cell = r[order], h[order], cell[order]
                head = np.ones(len(r), bool)
                head[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1]) | (cell[1:] != cell[:-1])
                heads = np.flatnonzero(head)
                times = np.diff(np.append(heads, len(r)))
                offsets = np.concatenate([[0], np.cumsum(np.bincount(r[heads], minlength=rows))]).astype(np.int32)
                parts = [pa.array(h[heads].view(np.int64)), *(pa.array(x.astype(np.int32)) for x in (cell[heads] // (len(m.size) + 1) - 1, cell[heads] % (len(m.size) + 1) - 1, times))]
                rare = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(parts, ["word", "before", "after", "n"]))
                two = np.flatnonzero(new & (after < 0))
                offsets = np.concatenate([[0], np.cumsum(np.bincount(row[two], minlength=rows))]).astype(np.int32)
                couple = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(hashes[two].view(np.int64)), pa.array(hashes[two + 1].view(np.int64))], ["word", "next"]))
                yield pa.RecordBatch.from_arrays([keys[a:b], pa.array(per + 1, pa.int64()), pa.array(hot_n.astype(np.int64)), pa.array(base), pa.array(total), rare, couple], names=["k", "n_tokens", "hot_known", "base", "full", "rare", "couple"])

    kind = docs.select(key).schema[0].dataType
    schema = StructType([StructField("k", kind), *StructType.fromDDL(f"n_tokens bigint, hot_known bigint, base double, full double, rare {_TOKEN}, couple {_PAIR}")])
    first = materialise(docs.select(key, text).mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    rest, width = model.rare, len(model.size)

    def constant(values: np.ndarray) -> Column:
        # One literal instead of one for each number keeps plans small.
        return F.split(F.lit(" ".join(map(repr, values.tolist()))), " ").cast("array<double>")

    table, units = constant(model.move.reshape(-1)), constant(np.log10(np.maximum(model.size, 1).astype(float)))

    def step(x: Column, y: Column) -> Column:
        return F.when((x >= 0) & (y >= 0), F.element_at(table, x * width + y + 1)).otherwise(0.0)

    asked = first.select("row", F.explode("rare").alias("w")).select("row", "w.*")
    cold = known.where(F.col("word") != END).withColumnRenamed("n", "seen")
    cls = F.coalesce("cls", F.lit(rest))
    log = F.log10(F.coalesce("seen", F.lit(0)) + F.lit(EMIT))
    own = F.when(F.col("cls").isNull(), log - rare_unit).otherwise(F.log10("seen") - F.element_at(units, cls + 1))
    # One partial sum for each row and task, then one for each row.
    met = asked.join(cold, "word", "left").groupBy("row").agg(
        F.sum(F.col("n") * log).alias("rare_log"),
        F.sum(F.col("n") * (own + step(F.col("before"), cls) + step(cls, F.col("after")))).alias("rare_full"),
        F.sum(F.when(F.col("seen").isNotNull(), F.col("n")).otherwise(0)).alias("rare_known"),
    )
    pairs = first.select("row", F.explode("couple").alias("w")).select("row", "w.*")
    of = known.where("cls is not null").select("word", "cls")
    linked = pairs.join(of, "word", "left").join(of.toDF("next", "then"), "next", "left").groupBy("row").agg(F.sum(step(cls, F.coalesce("then", F.lit(rest)))).alias("couples"))
    zero = F.lit(0.0)
    end_log = float(np.log10(model.size[-1] + EMIT))
    return first.drop("rare", "couple").join(met, "row", "left").join(linked, "row", "left").select(
        "row",
        F.col("k").alias(key),
        "n_tokens",
        (F.col("hot_known") + F.coalesce("rare_known", F.lit(0)) + F.lit(int(model.size[-1] > 0))).cast("bigint").alias("n_known"),
        F.lit(model.total).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_log", zero) + F.lit(end_log) - F.col("n_tokens") * F.lit(float(unit))).alias("base_score"),
        (F.col("full") + F.coalesce("rare_full", zero) + F.coalesce("couples", zero)).alias("score"),
    )
