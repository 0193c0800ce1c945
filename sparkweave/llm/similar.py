"""N-gram Jaccard join by parity sketches.

A text's set is its distinct word shingles.  XOR-ing the hash of every member
into one block of a sketch gives its parity blocks: a member changes one block,
so the blocks in which two sketches differ are at most as many as the symmetric
difference of their sets.  Two sets of sizes a and b with Jaccard similarity t
differ in at most (1-t)(a+b)/(1+t) members, so of more blocks than that some
must agree.  Sizes are cut into bands; within a band all sketches have as many
blocks as its largest pair needs, and texts are joined on (band, block, value).
Pairs are then held against bit sketches, in which every member toggles one
bit and whose Hamming distance bounds the symmetric difference from below, and
those left are verified on the sets.

``SPARE`` further blocks are added, and every text leaves out as many of its
own: those with the fewest members, which agree most easily.  Of the blocks on which
two similar texts agree the fullest comes after all others in the order of
both, so neither leaves it out.

Texts with equal sets are one class; only classes are joined.  The result is
the components of the links, so a pair whose classes are already connected
needs no check: the classes of a bucket are first tried against its smallest
and largest one, and only where components still meet among the others of a
bucket are these compared among themselves, in tiles of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.llm import bytesnp
from sparkweave.plans.components import star_components
from sparkweave.session import discard, materialise, share_code

#: Ratio of a band's largest size to its smallest; share of spare blocks.
BAND, SPARE = 1.2, 0.1
#: Rows of a part of a bucket; a tile holds two parts.
TILE = 2048
#: Classes that a task remembers having sent, so that copies are not sent again.
REMEMBER = 1_000_000


@dataclass(frozen=True)
class Rule:
    """Shingles of ``width`` words; linked when ``den`` * intersection >= ``num`` * union."""

    width: int = 5
    num: int = 80
    den: int = 100

    def apart(self, total: int | np.ndarray) -> int | np.ndarray:
        """The largest symmetric difference of linked sets whose sizes add up to ``total``."""
        return (self.den - self.num) * total // (self.den + self.num)

    def edges(self, most: int) -> np.ndarray:
        """First sizes of the bands up to ``most``; band k holds sizes from edge k to edge k + 1 less one."""
        out, x = [1], 1.0
        while out[-1] <= most:
            x *= max(BAND, self.den / self.num * 1.01)
            out.append(max(out[-1] + 1, math.ceil(x)))
        return np.array(out, dtype=np.int64)

    def blocks(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each band the number of blocks and how many of them may be left out; 0 blocks if only equal sets link."""
        least = edges[1:] - 1
        apart = self.apart(least + least * self.den // self.num)
        spare = np.ceil(apart * SPARE).astype(np.int64)
        return np.where(apart > 0, apart + 1 + spare, 0), spare


def _sets(buf: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingle hashes in order, and each row's first."""
    lower = bytesnp.LOWER[buf]
    starts, ends, first = bytesnp.words(lower, offs, bytesnp.NOT_SPACE)
    hashes, first = bytesnp.shingle_hash(bytesnp.span_hash(lower, starts, ends), first, width)
    rows = len(offs) - 1
    row = np.repeat(np.arange(rows, dtype=np.uint64), np.diff(first))
    # One sort by the row and the high bits of the hash; members of one row that share those are put in order after it.
    bits = np.uint64(max(rows - 1, 1).bit_length())
    order = np.argsort(row << (np.uint64(64) - bits) | hashes >> bits)
    h, r = hashes[order], row[order].astype(np.int64)
    for i in np.flatnonzero((h[1:] < h[:-1]) & (r[1:] == r[:-1])).tolist():
        while i >= 0 and r[i] == r[i + 1] and h[i] > h[i + 1]:
            h[i], h[i + 1] = h[i + 1], h[i]
            i -= 1
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[new], r[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(r, minlength=rows))])


def _classes(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit name of each row's set (0 for an empty one)."""
    n = np.diff(first)
    if not len(h):
        return np.zeros(len(n), np.uint64)
    padded = np.append(h, np.uint64(0))
    total = np.add.reduceat(padded, first[:-1])
    both = np.bitwise_xor.reduceat(padded, first[:-1])
    return np.where(n > 0, bytesnp.mix(total + bytesnp.mix(both + n.astype(np.uint64))) | np.uint64(1), np.uint64(0))


def _keys(h: np.ndarray, first: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Join keys of every row's sketch blocks in each of its bands, and the rows of the keys."""
    n = np.diff(first)
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    edges = rule.edges(int(n.max()))
    blocks, spare = rule.blocks(edges)
    band = np.searchsorted(edges, n, "right") - 1
    keys, rows = [], []
    for lower in range(len(edges) - 1):
        # A set also joins every band below of which a set may be similar; small sizes have narrow bands.
        own = band - lower
        take = (n > 0) & (own >= 0)
        if lower:
            take &= (edges[np.maximum(own, 0) + 1] - 1) * rule.den >= rule.num * n
            if not take.any():
                break
        own = np.where(take, own, 0)
        take &= blocks[own] > 0
        picked = np.flatnonzero(take)
        if not len(picked):
            continue
        m = blocks[own[picked]]
        start = np.concatenate([[0], np.cumsum(m)])
        member = np.repeat(np.arange(len(picked)), n[picked])
        at = np.repeat(first[:-1][picked], n[picked]) + np.arange(n[picked].sum()) - np.repeat(np.concatenate([[0], np.cumsum(n[picked])])[:-1], n[picked])
        x = h[at]
        place = start[:-1][member] + ((x >> np.uint64(16)) % m[member].astype(np.uint64)).astype(np.int64)
        value = np.zeros(start[-1], np.uint64)
        np.bitwise_xor.at(value, place, x)
        owner = np.repeat(np.arange(len(picked)), m)
        nth = np.arange(start[-1]) - start[:-1][owner]
        name = bytesnp.mix((own[picked][owner].astype(np.uint64) << np.uint64(32)) + nth.astype(np.uint64) + np.uint64(0x9E3779B9))
        # Blocks with the fewest members are left out; the order depends on a block's place and members only.
        held = np.minimum(np.bincount(place, minlength=start[-1]), 255).astype(np.uint64)
        order = np.argsort(owner.astype(np.uint64) << np.uint64(40) | held << np.uint64(32) | nth.astype(np.uint64))
        keep = order[nth >= spare[own[picked]][owner]]
        keys.append(bytesnp.mix(value[keep] ^ name[keep]))
        rows.append(picked[owner[keep]])
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(rows)


def sketch(h: np.ndarray) -> np.ndarray:
    """A parity sketch of two to four bits for each member, a power of two of 64-bit words."""
    words = 1 << max(2, math.ceil(math.log2(max(len(h), 1) / 32 + 1)))
    out = np.zeros(words, np.uint64)
    x = bytesnp.mix(h)
    np.bitwise_xor.at(out, ((x >> np.uint64(6)) & np.uint64(words - 1)).astype(np.int64), np.uint64(1) << (x & np.uint64(63)))
    return out


def hamming(a: np.ndarray, b: np.ndarray) -> int:
    """Distance of two sketches; the longer one is folded to the other's length first."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) != len(b):
        a = np.bitwise_xor.reduce(a.reshape(-1, len(b)), 0)
    return int(np.bitwise_count(a ^ b).sum())


def _read(docs: DataFrame, text: str, rule: Rule, what: str, kept: np.ndarray | None = None) -> DataFrame:
    """``keys``: (cls, key); ``light``: (cls, n, sketch); ``sets``: (cls, n, members) — once for each class and task.

    ``kept`` is a bit filter (of fixed size) of the keys, or of the classes, that are wanted.
    """
    sent = docs.sparkSession.sparkContext.broadcast(kept) if kept is not None else None

    def passes(values: np.ndarray) -> np.ndarray:
        if sent is None:
            return np.ones(len(values), bool)
        place = (values & np.uint64(len(sent.value) * 8 - 1)).astype(np.int64)
        return (sent.value[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            buf, offs = bytesnp.flat(batch.column(0))
            for a, b in bytesnp.slices(offs):
                h, first = _sets(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], rule.width)
                cls = _classes(h, first)
                new = np.zeros(b - a, bool)
                for i, c in enumerate(cls.tolist()):
                    if c and c not in done:
                        new[i] = True
                        if len(done) < REMEMBER:
                            done.add(c)
                if what == "keys":
                    keys, row = _keys(h, first, rule)
                    use = new[row] & passes(keys)
                    keys, row = keys[use], row[use]
                    yield pa.RecordBatch.from_arrays([pa.array(cls[row].view(np.int64)), pa.array(keys.view(np.int64))], names=["cls", "key"])
                else:
                    rows = np.flatnonzero(new & passes(cls))
                    for i in range(0, len(rows), 200):
                        part = [h[first[j] : first[j + 1]] for j in rows[i : i + 200]]
                        body = [(sketch(x) if what == "light" else x).tobytes() for x in part]
                        yield pa.RecordBatch.from_arrays([pa.array(cls[rows[i : i + 200]].view(np.int64)), pa.array([len(x) for x in part], pa.int64()), pa.array(body, pa.binary())], names=["cls", "n", "body"])

    schema = "cls bigint, key bigint" if what == "keys" else "cls bigint, n bigint, body binary"
    return docs.select(text).mapInArrow(run, schema)


def _bit_filter(values: DataFrame, column: str, count: int) -> np.ndarray:
    """A bit for each value's low bits; between 1 and 16 MB, however many values there are."""
    bits = min(1 << 27, max(1 << 20, 1 << (count * 8).bit_length()))
    low = F.col(column).bitwiseAND(F.lit(bits - 1))
    got = values.select((low / 32).cast("int").alias("cell"), F.pmod(low, F.lit(32)).cast("int").alias("bit")).groupBy("cell").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    out = np.zeros(bits // 32, np.uint32)
    for batch in got.toArrow().to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy().astype(np.uint32)
    return out.view(np.uint8)


def classes(docs: DataFrame, rule: Rule, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_shingles``, ``cls`` (null without shingles) of every row."""
    share_code(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = bytesnp.flat(batch.column(1))
            for a, b in bytesnp.slices(offs):
                h, first = _sets(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], rule.width)
                cls = _classes(h, first)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(np.diff(first).astype(np.int64)), pa.array(cls.view(np.int64), mask=cls == 0)], names=["k", "n_shingles", "cls"])

    return docs.select(key, text).mapInArrow(run, f"k {dict(docs.dtypes)[key]}, n_shingles bigint, cls bigint").withColumnRenamed("k", key)


def _near(pairs: DataFrame, light: DataFrame, rule: Rule) -> DataFrame:
    """Rows (a, b, shared) of classes whose sketches are close enough."""
    both = pairs.join(light.toDF("a", "na", "sa"), "a").join(light.toDF("b", "nb", "sb"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = rule.apart(batch.column(3).to_numpy() + batch.column(4).to_numpy())
            fine = pa.array([hamming(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) <= d for x, y, d in zip(batch.column(5).to_pylist(), batch.column(6).to_pylist(), most.tolist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(fine) for i in range(3)], names=["a", "b", "shared"])

    sized = both.where((F.least("na", "nb") * rule.den) >= F.greatest("na", "nb") * rule.num)
    return sized.select("a", "b", "shared", "na", "nb", "sa", "sb").mapInArrow(run, "a bigint, b bigint, shared bigint")


def _verified(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of classes that are linked by the exact rule."""
    full = sets.select("cls", "body")
    both = pairs.select("a", "b").join(full.toDF("a", "ma"), "a").join(full.toDF("b", "mb"), "b").select("a", "b", "ma", "mb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                same = len(np.intersect1d(p, q, assume_unique=True))
                fine.append(rule.den * same >= rule.num * (len(p) + len(q) - same))
            fine = pa.array(fine, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(fine), batch.column(1).filter(fine)], names=["a", "b"])

    return both.mapInArrow(run, "a bigint, b bigint")


def _open(held: DataFrame) -> DataFrame:
    """``key``, ``size`` of the buckets of ``held`` in which components meet."""
    met = held.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("size"))
    return met.where("x <> y").select("key", "size")


def _tiles(held: DataFrame, light: DataFrame, rule: Rule, forest: bool) -> DataFrame:
    """Close pairs (a, b) across components within buckets (key, cls, component).

    A bucket of more than ``TILE`` rows is cut into parts, and every two parts
    meet in a tile of their own; a task holds one tile.  Pairs are compared
    where they meet and only close ones leave; with ``forest`` only the nearest
    ones that would join a tile's components, fewer than it has rows.
    """
    sizes = _open(held)
    parts = F.ceil(F.col("size") / TILE).cast("int")
    own = F.pmod(F.xxhash64("cls"), parts).cast("int")
    rows = held.join(sizes, "key").join(light.toDF("cls", "n", "sketch"), "cls").withColumn("parts", parts).withColumn("own", own)
    placed = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "cls", "component", "n", "sketch")
    dealt = placed.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")

    def compare(t: dict[str, list]) -> Iterator[pa.RecordBatch]:
        raw = [np.frombuffer(v, np.uint64) for v in t["sketch"]]
        # Folding never makes a distance larger than the sets' difference.
        words = min(map(len, raw))
        arr = np.stack([np.bitwise_xor.reduce(v.reshape(-1, words), 0) for v in raw])
        n, cls, comp, own = (np.array(t[k]) for k in ("n", "cls", "component", "own"))
        left, right = np.flatnonzero(own == t["x"][0]), np.flatnonzero(own == t["y"][0])
        label = np.unique(comp, return_inverse=True)[1]
        for i in range(0, len(left), 32):
            rows_ = left[i : i + 32]
            apart = np.bitwise_count(arr[rows_][:, None, :] ^ arr[right][None, :, :]).sum(2, dtype=np.int64)
            a, b = np.nonzero((apart <= rule.apart(n[rows_][:, None] + n[right][None, :])) & (label[rows_][:, None] != label[right][None, :]))
            if forest:
                joins = []
                for k in np.argsort(apart[a, b], kind="stable").tolist():
                    one, other = label[rows_[a[k]]], label[right[b[k]]]
                    if one != other:
                        label[label == other] = one
                        joins.append(k)
                a, b = a[joins], b[joins]
            p, q = cls[rows_][a], cls[right][b]
            if len(p):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "x", "y", "own", "cls", "component", "n", "sketch"]
        now, held_rows = None, {k: [] for k in names}
        for batch in batches:
            columns = {k: batch.column(i).to_pylist() for i, k in enumerate(names)}
            for i in range(batch.num_rows):
                tile = (columns["key"][i], columns["x"][i], columns["y"][i])
                if tile != now:
                    if now is not None and len(held_rows["key"]) > 1:
                        yield from compare(held_rows)
                    now, held_rows = tile, {k: [] for k in names}
                for k in names:
                    held_rows[k].append(columns[k][i])
        if len(held_rows["key"]) > 1:
            yield from compare(held_rows)

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


class _Tables:
    """Written tables, to be deleted together after their last reader."""

    def __init__(self) -> None:
        self.written: list[DataFrame] = []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.written.append(materialise(df, name))
        return self.written[-1]

    def discard(self) -> None:
        for df in self.written:
            discard(df.sparkSession, df)


def links(docs: DataFrame, rule: Rule, text: str = "text") -> DataFrame:
    """``id``, ``component`` for every class that is linked to another one."""
    spark = docs.sparkSession
    share_code(spark)
    kept = _Tables()
    ends = kept(_read(docs, text, rule, "keys").groupBy("key").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi"), "buckets")
    count = ends.count()
    if not count:
        kept.discard()
        return spark.createDataFrame([], "id bigint, component bigint")
    members = kept(_read(docs, text, rule, "keys", _bit_filter(ends, "key", count)).join(ends, "key").distinct(), "members")
    involved = members.select("cls").distinct()

    def read(what: str, classes_: DataFrame) -> DataFrame:
        found = _read(docs, text, rule, what, _bit_filter(classes_, "cls", classes_.count()))
        return kept(found.join(classes_, "cls", "left_semi").groupBy("cls").agg(F.any_value("n").alias("n"), F.any_value("body").alias("body")), what)

    def grown(component: DataFrame | None, links_: DataFrame) -> DataFrame:
        """The components with further links."""
        more = materialise(links_, "links")
        new = star_components(more if component is None else more.unionByName(component.toDF("a", "b")), "a", "b")
        for used in (more, component):
            if used is not None:
                discard(spark, used)
        return new

    light = read("light", involved)
    # Every class with the smallest and the largest class of its buckets.
    ended = members.select("cls", F.explode(F.array("lo", "hi")).alias("end")).where("cls <> end")
    near = kept(_near(ended.groupBy(F.least("cls", "end").alias("a"), F.greatest("cls", "end").alias("b")).agg(F.count("*").alias("shared")), light, rule), "near")
    ids = near.select(F.col("a").alias("cls")).union(near.select("b")).distinct()
    sets = read("sets", ids)
    # First the end that a class shares the most blocks with, then the ends that are still in other components.
    sided = near.select(F.col("a").alias("x"), "a", "b", "shared").union(near.select("b", "a", "b", "shared"))
    best = sided.groupBy("x").agg(F.max_by(F.struct("a", "b"), F.struct("shared", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
    component = grown(None, _verified(best, sets, rule))

    def named(column: str) -> DataFrame:
        return component.toDF(column, f"c_{column}")

    rest = near.join(best, ["a", "b"], "left_anti").join(named("a"), "a", "left").join(named("b"), "b", "left").where("coalesce(c_a, a) <> coalesce(c_b, b)")
    component = grown(component, _verified(rest, sets, rule))
    # What remains: classes in one bucket, neither its smallest nor its largest, and in different components.
    # First the pairs that would join components, so that a large group of near copies is one component
    # before all its pairs are looked at.
    tried = near.select("a", "b")
    for forest in (True, False):
        named_ = component.withColumnRenamed("id", "cls")
        inner = members.where("cls <> lo and cls <> hi").select("key", "cls")
        held = kept(inner.join(named_, "cls", "left").select("key", "cls", F.coalesce("component", "cls").alias("component")), "held")
        more = kept(_tiles(held, light, rule, forest).join(tried, ["a", "b"], "left_anti"), "near")
        if more.isEmpty():
            continue
        new = more.select(F.col("a").alias("cls")).union(more.select("b")).distinct().join(ids, "cls", "left_anti")
        if not new.isEmpty():
            new = kept(new, "new")
            sets, ids = sets.unionByName(read("sets", new)), ids.unionByName(new)
        component = grown(component, _verified(more, sets, rule))
        tried = tried.unionByName(more)
    kept.discard()
    return component


def join(docs: DataFrame, rule: Rule | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_shingles``, ``component_id`` of every row.

    The component of a row is the smallest key that links reach from it (its
    own key if none); equal sets are linked.  Null and empty texts have no
    shingle and stand alone.  Null keys are passed over for the smallest key;
    a component of null keys only has a null component id.  Rows may repeat.
    """
    rule = rule or Rule()
    own = materialise(classes(docs, rule, key, text), "classes")
    component = links(docs, rule, text).withColumnRenamed("id", "cls")
    smallest = own.where("cls is not null").groupBy("cls").agg(F.min(key).alias("low"))
    low = smallest.join(component, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    group = low.groupBy("component").agg(F.min("low").alias("component_id"))
    named = low.join(group, "component").select("cls", "component_id")
    return own.join(named, "cls", "left").select(key, "n_shingles", F.coalesce("component_id", key).alias("component_id"))


def deduplicate(docs: DataFrame, rule: Rule | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component: that of the smallest key; all columns of ``docs``.

    Rows without shingles and rows with a null key stay.  Of rows that repeat
    the kept key, one with the smallest text stays (null last).
    An empty table gives an empty one; columns may have any name.
    """
    found = join(docs, rule, key, text)
    # Few keys need a look: those that are not their component's smallest, and those that repeat.
    looked = found.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min("component_id").alias("low"), F.count("*").alias("n")).where("low <> k or n > 1")
    looked = materialise(looked, "looked")
    discard(docs.sparkSession, found)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    marked = docs.select(F.col(f"`{key}`").alias("k"), row).join(looked, "k", "left").where("low is null or low = k")
    once = marked.where("n is null").select("row")
    body = F.col(f"row.`{text}`")
    again = marked.where("n > 1").groupBy("k").agg(F.min_by("row", F.struct(body.isNull(), body)).alias("row")).select("row")
    return once.unionByName(again).select("row.*")
