"""Benchmark decontamination by template windows.

Both sides are turned into templates: numbers, names and units become typed
placeholders, all other words are kept in lower case.  Windows of a few
template words are joined by their hashes, so a question whose numbers or
names were changed still meets its source.  A run of matched windows (one item
and one text at one distance) counts only if its slots are consistent: equal
values of the item stand against equal values of the text, and different
against different.

A window short of literal words is widened, to either side, until it holds
``LITERALS`` of them; an item that has fewer is one window of all its words.
Windows short of literals are also joined on their exact values, so that a copy
matches whatever it is made of.  A capital word that begins a sentence may be a
name or not: windows that hold one are joined in both forms.

The windows of the benchmark are put into a bit filter of fixed size that goes
to every task, so only windows that may match leave the scan; the join that
follows decides.  The filter's size does not depend on either side, and with a
larger benchmark more windows pass it, none is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkweave.llm import bytesnp
from sparkweave.session import materialise, share_code

#: Template words in a window; shorter items are one window of all their words.
WIDTH = 5
#: Words of a window that must not be placeholders, and the share of an item's words in matched windows that makes a leak.
LITERALS, COVERAGE = 3, 0.5
FILTER_BITS = 1 << 23

# Units, and numbers written as words.
UNITS = "mm cm m km in ft mi mg g kg lb lbs oz ml l s sec secs min mins h hr hrs hour hours minute minutes second seconds day days week weeks month months year years mph kph kmh percent dollar dollars usd eur euro euros cent cents meter meters metre metres kilometer kilometers mile miles inch inches foot feet gram grams kilogram kilograms pound pounds liter liters litre litres degree degrees watt watts volt volts hz khz mhz ghz kb mb gb tb"
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"


def _hashes(words: str) -> np.ndarray:
    buf, offs = bytesnp.flat(pa.array(words.split()))
    return np.sort(bytesnp.span_hash(buf, offs[:-1], offs[1:]))


_UNITS, _NUMBERS = _hashes(UNITS), _hashes(NUMBERS)
_NUM, _NAME, _UNIT = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_STOP = np.zeros(256, bool)
_STOP[[0x21, 0x2E, 0x3F, 0x3A, 0x0A, 0x0D]] = True
_POINT = np.zeros(256, bool)
_POINT[[0x2C, 0x2E]] = True


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


def template(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template words, whether each is a placeholder, the values behind them, each row's first word, and whether a word may be a name that begins a sentence.

    A number is digits (with points and commas inside) or a number word, a
    unit is a unit word right after a number, a name is a word with a capital
    and a small letter that does not begin a sentence.
    """
    n = len(buf)
    inside = bytesnp.ALNUM[buf]
    if n > 2:
        inside[1:-1] |= _POINT[buf[1:-1]] & _DIGIT[buf[:-2]] & _DIGIT[buf[2:]]
        edges = offs[(offs > 0) & (offs < n)]
        inside[edges] &= bytesnp.ALNUM[buf[edges]]
        inside[edges - 1] &= bytesnp.ALNUM[buf[edges - 1]]
    table = np.zeros(2, bool)
    table[1] = True
    starts, ends, first = bytesnp.words(inside.astype(np.uint8), offs, table)
    lower = bytesnp.LOWER[buf]
    value = bytesnp.span_hash(lower, starts, ends)
    if not len(value):
        return value, np.zeros(0, bool), value, first, np.zeros(0, bool)
    plain = np.concatenate([[0], np.cumsum(_DIGIT[buf] | _POINT[buf])])
    number = (plain[ends] - plain[starts] == ends - starts) | _among(value, _NUMBERS)
    row_start = np.zeros(len(value), bool)
    row_start[first[:-1][first[:-1] < len(value)]] = True
    unit = np.zeros(len(value), bool)
    unit[1:] = number[:-1] & _among(value[1:], _UNITS) & ~row_start[1:]
    stops = np.concatenate([[0], np.cumsum(_STOP[buf])])
    opens = row_start.copy()
    opens[1:] |= stops[starts[1:]] > stops[ends[:-1]]
    second = np.where(ends - starts > 1, buf[np.minimum(starts + 1, n - 1)], 0)
    capital = _UPPER[buf[starts]] & ~_UPPER[second] & (ends - starts > 1) & ~number & ~unit
    name = capital & ~opens
    word = np.where(number, _NUM, np.where(unit, _UNIT, np.where(name, _NAME, value)))
    return word, number | unit | name, value, first, capital & opens


#: Kinds of windows: with enough literals; all words of an item with fewer; exact values where literals are few.
ENOUGH, WHOLE, EXACT = 0, 1, 2
#: Forms of a window: without a capital word that begins a sentence; with one, as a word; with one, as a name.
EITHER, WORD, NAME = 0, 1, 2


def _window(words: np.ndarray, at: np.ndarray, width: int, kind: int) -> np.ndarray:
    """Hashes of the windows of ``width`` words that begin at ``at``."""
    acc = np.full(len(at), 0x165667B19E3779F9 + width + (kind == EXACT) * (1 << 32), dtype=np.uint64)
    for j in range(width):
        acc = (acc ^ words[at + j]) * np.uint64(0x9FB21C651E98DF25)
        acc ^= acc >> np.uint64(31)
    return bytesnp.mix(acc)


def _plan(literal: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
    """The (kind, width) of all windows that items with these counts of literals have."""
    size, found = np.diff(first), {(EXACT, WIDTH)}
    row = np.repeat(np.arange(len(size)), size)
    start = np.arange(first[-1])
    ahead = np.maximum(np.searchsorted(literal, literal[start] + LITERALS) - start, WIDTH)
    found |= {(ENOUGH, w) for w in np.unique(ahead[start + ahead <= first[row + 1]]).tolist()}
    end = start + 1
    back = np.maximum(end + 1 - np.searchsorted(literal, literal[end] - LITERALS, "right"), WIDTH)
    found |= {(ENOUGH, w) for w in np.unique(back[end - back >= first[row]]).tolist()}
    few = (size > 0) & ((size < WIDTH) | (literal[first[1:]] - literal[first[:-1]] < LITERALS))
    return sorted(found | {(k, w) for w in np.unique(size[few]).tolist() for k in ((WHOLE, EXACT) if w < WIDTH else (WHOLE,))})


_KEY = ["hash bigint", "kind int", "form int", "width int", "at int", "n_words int", "slot array<boolean>", "value array<bigint>"]


def _windows(rows: DataFrame, key: str, text: str, plan: list[tuple[int, int]] | None, bits: np.ndarray | None) -> DataFrame:
    """Windows of every text: those of items (without a plan), or of each (kind, width) of ``plan``."""
    sent = rows.sparkSession.sparkContext.broadcast(bits) if bits is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            buf, offs = bytesnp.flat(batch.column(1))
            for a, b in bytesnp.slices(offs):
                words, slot, value, first, opening = template(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                size = np.diff(first)
                opened = np.concatenate([[0], np.cumsum(opening)])
                for form in (WORD, NAME):
                    if form == NAME:
                        words, slot = np.where(opening, _NAME, words), slot | opening
                    literal = np.concatenate([[0], np.cumsum(~slot)])
                    for kind, width in plan or _plan(literal, first):
                        if form == NAME and kind == EXACT:
                            continue
                        count = np.maximum(size - width + 1, 0)
                        if not plan and (kind == WHOLE or width < WIDTH):
                            count = (size == width).astype(np.int64)
                        row = np.repeat(np.arange(b - a), count)
                        shift = np.concatenate([[0], np.cumsum(count)])[:-1]
                        at = first[:-1][row] + np.arange(count.sum()) - shift[row]
                        if form == NAME:
                            held = opened[at + width] > opened[at]
                            row, at = row[held], at[held]
                        n = literal[at + width] - literal[at]
                        if kind == ENOUGH:
                            fits = n >= LITERALS
                            if width > WIDTH:
                                fits &= (literal[at + width - 1] - literal[at] < LITERALS) | (literal[at + width] - literal[at + 1] < LITERALS)
                        elif kind == WHOLE:
                            fits = (n >= 1) & ((n < LITERALS) | (width < WIDTH))
                        else:
                            fits = n < LITERALS if width == WIDTH else n == 0
                        row, at = row[fits], at[fits]
                        hashes = _window(value if kind == EXACT else words, at, width, kind)
                        if sent is not None:
                            place = (hashes % np.uint64(FILTER_BITS)).astype(np.int64)
                            passes = (sent.value[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
                            row, at, hashes = row[passes], at[passes], hashes[passes]
                        if not len(at):
                            continue
                        span = at[:, None] + np.arange(width)
                        lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * width), pa.array(v[span].reshape(-1))) for v in (slot, value.view(np.int64))]
                        forms = np.where((opened[at + width] > opened[at]) & (kind != EXACT), form, EITHER)
                        ints = [pa.array(np.asarray(v, np.int32)) for v in (np.full(len(at), kind), forms, np.full(len(at), width), at - first[:-1][row], size[row])]
                        yield pa.RecordBatch.from_arrays([keys.take(pa.array(row + a)), pa.array(hashes.view(np.int64)), *ints, *lists], names=["key", "hash", "kind", "form", "width", "at", "n_words", "slot", "value"])

    kind_ = dict(rows.dtypes)[key]
    return rows.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, ", ".join([f"key {kind_}", *_KEY]))


def _filter(items: DataFrame) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The bit filter of the items' windows (fixed size) and the kinds and widths that occur."""
    cells = items.select((F.pmod("hash", F.lit(FILTER_BITS)) / 32).cast("int").alias("cell"), F.pmod("hash", F.lit(32)).cast("int").alias("bit"))
    # pmod of the signed hash equals the unsigned remainder, the size being a power of two.
    got = cells.groupBy("cell").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS // 32, dtype=np.uint32)
    out[got["cell"]] = got["bits"].to_numpy(np.int64).astype(np.uint32)
    plan = sorted((r["kind"], r["width"]) for r in items.select("kind", "width").distinct().collect())
    return out.view(np.uint8), plan


def _named(rows: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """``name`` and ``text``: rows are told apart by id and text, so that those of one id, or of none, do not mix."""
    return rows.select(F.struct(F.col(key).alias("id"), F.xxhash64(text).alias("part")).alias(name), F.col(text).alias("text"))


def _found(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``key``, ``item``, ``matched_words``, ``item_words``, ``changed`` for every document and item, as ``_named`` gives them, that share a consistent run."""
    share_code(docs.sparkSession)
    left = _windows(items, "item", "text", None, None).withColumnsRenamed({"key": "item", "form": "item_form", "at": "item_at", "n_words": "item_words", "slot": "item_slot", "value": "item_value"}).dropDuplicates(["item", "item_at", "width", "kind", "item_form"])
    left = materialise(left, "items")
    bits, plan = _filter(left)
    right = _windows(docs, "key", "text", plan or [(ENOUGH, WIDTH)], bits).withColumnRenamed("n_words", "doc_words")
    # A run is taken once with the words that begin sentences as words, once as names.
    forms = F.filter(F.array(F.lit(WORD), F.lit(NAME)), lambda f: ((F.col("form") == EITHER) | (F.col("form") == f)) & ((F.col("item_form") == EITHER) | (F.col("item_form") == f)))
    pair = right.join(left.drop("item_slot", "kind"), ["hash", "width"]).withColumn("run", F.col("at") - F.col("item_at")).withColumn("as", F.explode(forms))
    # Written once: the texts are read and cut into windows a single time.
    pair = materialise(pair, "pairs")
    # Slots of a run: an item value has one text value and the reverse.
    runs = ["key", "item", "run", "as"]
    slots = pair.select(*runs, "item_words", "width", "item_at", F.explode(F.arrays_zip("slot", "item_value", "value")).alias("s")).where("s.slot").select(*runs, F.col("s.item_value").alias("iv"), F.col("s.value").alias("dv")).distinct()
    per = slots.groupBy(*runs).agg(F.count("*").alias("n"), F.countDistinct("iv").alias("ni"), F.countDistinct("dv").alias("nd"), F.sum((F.col("iv") != F.col("dv")).cast("int")).alias("changed"))
    wrong = per.where((F.col("n") != F.col("ni")) | (F.col("n") != F.col("nd"))).select(*runs)
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"q.{c}")) for c in runs]
    good = pair.select(*runs, "item_words", "width", "item_at").alias("p").join(wrong.alias("q"), same[0] & same[1] & same[2] & same[3], "left_anti")
    placed = good.select("key", "item", "item_words", "width", "item_at").distinct()
    by_item = Window.partitionBy("key", "item").orderBy("item_at").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max(F.col("item_at") + F.col("width")).over(by_item), F.lit(0))
    covered = placed.withColumn("new", F.greatest(F.col("item_at") + F.col("width") - F.greatest(F.col("item_at"), reach), F.lit(0)))
    total = covered.groupBy("key", "item").agg(F.sum("new").alias("matched_words"), F.max("item_words").alias("item_words"))
    changed = per.groupBy("key", "item").agg(F.max("changed").alias("changed"))
    c = changed.alias("c")
    t = total.alias("t")
    out = t.join(c, F.col("t.key").eqNullSafe(F.col("c.key")) & F.col("t.item").eqNullSafe(F.col("c.item")), "left")
    return out.select("t.key", "t.item", F.col("t.matched_words").cast("bigint").alias("matched_words"), F.col("t.item_words").cast("bigint").alias("item_words"), F.coalesce("c.changed", F.lit(0)).cast("bigint").alias("changed"))


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and item that share a consistent run of template windows.

    Columns: ``key``, ``item``, ``matched_words``, ``item_words``, ``coverage``,
    ``changed_slots`` (placeholders whose values differ) and ``leak``
    (coverage of at least ``COVERAGE``).  Null or empty texts match nothing;
    null ids are kept as ids; documents, and items, of one id and different
    texts are told apart (a row each); repeated rows give one result row.
    """
    found = _found(_named(docs, key, text, "key"), _named(benchmark, item, item_text, "item"))
    share = F.col("matched_words") / F.col("item_words")
    return found.select(F.col("key.id").alias(key), F.col("item.id").alias(item), "matched_words", "item_words", F.round(share, 6).alias("coverage"), F.col("changed").alias("changed_slots"), (share >= COVERAGE).alias("leak"))


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a leak, whatever their ids; other rows of the same id stay."""
    found = _found(_named(docs, key, text, "key"), _named(benchmark, item, item_text, "item"))
    leaks = found.where(F.col("matched_words") / F.col("item_words") >= COVERAGE).select("key").distinct().alias("l")
    same = F.col(f"d.`{key}`").eqNullSafe(F.col("l.key.id")) & (F.xxhash64(F.col(f"d.`{text}`")) == F.col("l.key.part"))
    return docs.alias("d").join(leaks, same, "left_anti")
