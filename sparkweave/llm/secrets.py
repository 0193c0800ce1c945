"""Secret scans: patterns, and values in a credential context that are costly to guess.

The cost of a value is what the cheapest way to guess it takes: a dynamic
program over its places finds the segmentation of least cost into words, dates,
repeats, keyboard walks, sequences and characters tried by brute force.  Costs
are logarithms (base 10) of guesses, so those of segments add up.  A word costs
as its rarity in all documents: the words that values may hold are counted
over the whole corpus, and words of a fixed share of it or more are known.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.llm import bytesnp
from sparkweave.llm.filters import bit_filter, passes
from sparkweave.session import discard, materialise, share_code

#: Values at least this costly (log10 of guesses) are secrets.
COSTLY = 10.0
#: Words that make up one in so many of the corpus, or more, are known; so there are at most as many.
RARE = 100_000
#: Lengths of words that are looked up.
SHORTEST, LONGEST = 3, 24
#: Cost of beginning a segment that is not brute force, of a word's other case, and of each letter written as a sign.
BEGIN, CASE, SIGN = 0.5, 0.3, 0.3
#: Guesses for a date of 120 years, for the keys of a keyboard, and for another direction of a walk.
DATE, YEAR, KEYS, TURN = math.log10(365 * 120), math.log10(120), math.log10(47), math.log10(5)

#: Kinds of spans in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "guess")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")

# Words before a credential; the most used passwords; keyboard rows.
CONTEXT = "password passwd passphrase passcode pwd secret token apikey api_key api-key access_key access-key accesskey private_key private-key credential credentials authorization bearer pin"
USUAL = "password admin root user guest login welcome letmein qwerty monkey dragon master shadow superman batman trustno secret test default changeme iloveyou princess sunshine football baseball charlie michael summer winter spring autumn love hello freedom whatever ninja starwars computer hunter killer pepper ginger cookie cheese flower access private public temp demo example sample none null true false"
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")

_WORDS = sorted(CONTEXT.split(), key=len, reverse=True)
_CONTEXT = re.compile(r"(?:" + "|".join(map(re.escape, _WORDS)) + r""")["']?\s{0,8}(?::=|=>|[:=]|\bis\b)\s{0,8}(?:(?:basic|bearer)\x20+)?(?:"([^"\s]{4,})"|'([^'\s]{4,})'|([^\s"'`,;<>(){}|]{4,}))|\bbearer\x20+([^\s"'`,;<>(){}|]{4,})""", re.IGNORECASE | re.ASCII)
_USERINFO = re.compile(r"://[^\s/:@]{1,256}:([^\s/@]{4,})@")
_LEET = str.maketrans({"0": "o", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"})
_DATES = (
    re.compile(r"(?=((\d{1,2})([-/._ ]?)(\d{1,2})\3((?:19|20)?\d\d)))", re.ASCII),
    re.compile(r"(?=(((?:19|20)\d\d)([-/._ ]?)(\d{1,2})\3(\d{1,2})))", re.ASCII),
)
_YEAR = re.compile(r"(?=((?:19|20)\d\d))", re.ASCII)


def _adjacent() -> dict[str, dict[str, int]]:
    """Neighbours of a key and the directions in which they lie; every row stands half a key to the right of the one above."""
    place = {c: (y, 2 * x + y) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
    steps = [(0, -2), (0, 2), (-1, -1), (-1, 1), (1, -1), (1, 1)]
    return {a: {b: steps.index((v[0] - u[0], v[1] - u[1])) for b, v in place.items() if (v[0] - u[0], v[1] - u[1]) in steps} for a, u in place.items()}


_ADJACENT = _adjacent()


def _brute(c: str) -> float:
    """A character tried by brute force."""
    if "0" <= c <= "9":
        return 1.0
    if c.isascii() and c.isalpha():
        return math.log10(26)
    return math.log10(33) if c.isascii() else 2.0


def plain(value: str) -> tuple[str, str]:
    """A value in lower case with signs read as letters; a 1 may be either of two."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in value).translate(_LEET)
    return low.replace("1", "i"), low.replace("1", "l")


class Guess:
    """The guess cost of values, with words and their costs."""

    def __init__(self, words: dict[str, float]) -> None:
        self.words = {w: math.log10(i + 2) for i, w in enumerate(USUAL.split())}
        for word, cost in words.items():
            self.words[word] = min(cost, self.words.get(word, math.inf))
        self.seen: dict[str, float] = {}

    def _word_cost(self, written: str, word: str) -> float | None:
        cost = self.words.get(word)
        if cost is None:
            return None
        upper = sum("A" <= c <= "Z" for c in written)
        signs = sum(a != b for a, b in zip(written.lower(), word, strict=True))
        cost += SIGN * signs
        if upper and (upper == len(written) or upper == 1 and "A" <= written[0] <= "Z"):
            cost += CASE
        elif upper:
            cost += math.log10(math.comb(len(written), upper)) + CASE
        return cost

    def segments(self, value: str) -> Iterator[tuple[int, int, float]]:
        """All segments (start, end, cost) that a segmentation may use."""
        n = len(value)
        for i, c in enumerate(value):
            yield i, i + 1, _brute(c)
        forms = plain(value)
        for form in forms[: 1 + (forms[0] != forms[1])]:
            letters = re.compile(r"[a-z]+")
            for run in letters.finditer(form):
                for i in range(run.start(), run.end() - SHORTEST + 1):
                    for j in range(i + SHORTEST, min(run.end(), i + LONGEST) + 1):
                        cost = self._word_cost(value[i:j], form[i:j])
                        if cost is not None:
                            yield i, j, BEGIN + cost
        for found in _YEAR.finditer(value):
            yield found.start(), found.end(1), BEGIN + YEAR
        for k, pattern in enumerate(_DATES):
            for found in pattern.finditer(value):
                first, last = int(found[2] if k == 0 else found[4]), int(found[4] if k == 0 else found[5])
                if 1 <= min(first, last) <= 12 and 1 <= max(first, last) <= 31:
                    yield found.start(), found.end(1), BEGIN + DATE + (0.6 if found[3] else 0.0)
        # Repeats of a unit of up to eight characters, from each phase of a run to its last whole unit.
        for u in range(1, min(8, n // 2) + 1):
            i = u
            while i < n:
                if value[i] != value[i - u]:
                    i += 1
                    continue
                start = i - u
                while i < n and value[i] == value[i - u]:
                    i += 1
                for a in range(start, min(start + u, i)):
                    times = (i - a) // u
                    if times >= 2 and times * u >= 3:
                        yield a, a + times * u, BEGIN + sum(map(_brute, value[a : a + u])) + math.log10(times)
        low = value.lower() if value.isascii() else "".join(c.lower() if c.isascii() else c for c in value)
        yield from self._runs(low, lambda a, b: _ADJACENT.get(a, {}).get(b), lambda run, turns: KEYS + math.log10(run) + TURN * turns, 4)
        yield from self._runs(low, self._next, lambda run, turns: math.log10(26) + math.log10(run) + CASE, 3, turning=False)

    @staticmethod
    def _next(a: str, b: str) -> int | None:
        """The direction of a sequence of letters or digits."""
        same = a.isascii() and b.isascii() and (a.isdigit() and b.isdigit() or a.isalpha() and b.isalpha())
        return ord(b) - ord(a) if same and abs(ord(b) - ord(a)) == 1 else None

    @staticmethod
    def _runs(low: str, step, cost, least: int, turning: bool = True) -> Iterator[tuple[int, int, float]]:
        """Maximal runs of steps, whole or short of one or two characters at the end."""
        i, n = 0, len(low)
        while i < n - 1:
            way = step(low[i], low[i + 1])
            if way is None:
                i += 1
                continue
            j, turns, ends = i + 1, [0], way
            while j + 1 < n and (new := step(low[j], low[j + 1])) is not None and (turning or new == ends):
                turns.append(turns[-1] + (new != ends))
                ends = new
                j += 1
            for end in range(max(i + least, j - 1), j + 2):
                yield i, end, BEGIN + cost(end - i, turns[end - i - 2])
            i = j

    def cost(self, value: str) -> float:
        """The least cost of a segmentation; 0 for an empty value."""
        got = self.seen.get(value)
        if got is None:
            best = [0.0] + [math.inf] * len(value)
            for i, j, cost in sorted(self.segments(value)):
                if best[i] + cost < best[j]:
                    best[j] = best[i] + cost
            got = best[-1]
            if len(self.seen) >= 50_000:
                self.seen.clear()
            if len(value) <= 256:
                self.seen[value] = got
        return got


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of assignments, access keys and hexadecimal runs, leftmost and without overlap for each kind."""
    low = text.lower()
    found = []
    if any(w in low for w in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        # A short value ends a match too, so that nothing within it begins another.
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return found


def values(text: str) -> list[tuple[int, int]]:
    """(start, end) of the values in a credential context: after its words, or as the password of an address."""
    low, found = text.lower(), set()
    if any(w in low for w in _WORDS):
        for m in _CONTEXT.finditer(text):
            k = next(k for k in (1, 2, 3, 4) if m[k] is not None)
            end = m.end(k)
            if k > 2:
                end -= len(m[k]) - len(m[k].rstrip(".!?:"))
            if end - m.start(k) >= 4:
                found.add((m.start(k), end))
    if "://" in low:
        found |= {(m.start(1), m.end(1)) for m in _USERINFO.finditer(text)}
    return sorted(found)


def _listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


_FOUND = "n_assign bigint, n_access bigint, n_hex bigint, base string, starts array<bigint>, ends array<bigint>, texts array<string>"


def _scan(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Base spans, and the values in a credential context, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                piece = batch.slice(a, 256)
                out: list[list] = [[] for _ in range(7)]
                for body in piece.column(1).to_pylist():
                    body = body or ""
                    spans, held = base_spans(body), values(body)
                    for column, value in zip(out, [*(sum(s[2] == k for s in spans) for k in KINDS[:3]), _listed(spans), [s for s, _ in held], [e for _, e in held], [body[s:e] for s, e in held]], strict=True):
                        column.append(value)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], names=["key", "n_assign", "n_access", "n_hex", "base", "starts", "ends", "texts"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {dict(docs.dtypes)[key]}, {_FOUND}")


def _asked(found: DataFrame) -> DataFrame:
    """``term``: hashes of all runs of letters that a segment of a value may be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = [f for texts in batch.column(0).to_pylist() for t in texts for f in set(plain(t))]
            buf, offs = bytesnp.flat(pa.array(forms, pa.string()))
            inside = np.zeros(256, bool)
            inside[97:123] = True
            starts, ends, _ = bytesnp.words(buf, offs, inside)
            for n in range(SHORTEST, LONGEST + 1):
                count = np.maximum(ends - starts - n + 1, 0)
                shift = np.concatenate([[0], np.cumsum(count)])
                at = np.repeat(starts, count) + np.arange(shift[-1]) - np.repeat(shift[:-1], count)
                for a in range(0, len(at), 1 << 18):
                    part = at[a : a + (1 << 18)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(bytesnp.span_hash(buf, part, part + n)).view(np.int64))], names=["term"])

    return found.where(F.size("texts") > 0).select("texts").mapInArrow(run, "term bigint")


def word_costs(docs: DataFrame, bits: np.ndarray, text: str = "text") -> dict[str, float]:
    """Costs of the words of all ``docs`` that pass the filter and make up one in ``RARE`` words or more."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside = np.zeros(256, bool)
        inside[97:123] = True
        total = 0
        for batch in batches:
            buf, offs = bytesnp.flat(batch.column(0))
            for a, b in bytesnp.slices(offs):
                x = bytesnp.LOWER[buf[offs[a] : offs[b]]]
                starts, ends, _ = bytesnp.words(x, offs[a : b + 1] - offs[a], inside)
                total += len(starts)
                fits = (ends - starts >= SHORTEST) & (ends - starts <= LONGEST)
                starts, ends = starts[fits], ends[fits]
                hashes = bytesnp.span_hash(x, starts, ends)
                asked = passes(sent.value, hashes)
                starts, ends = starts[asked], ends[asked]
                _, at, n = np.unique(hashes[asked], return_index=True, return_counts=True)
                data = x.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([data[s:e].decode() for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], pa.string()), pa.array(n.astype(np.int64))], names=["word", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([""], pa.string()), pa.array([total], pa.int64())], names=["word", "n"])

    counts = materialise(docs.select(text).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "words")
    whole = counts.where("word = ''").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    known = counts.where(F.col("word") != "").where(F.col("n") * RARE >= whole).collect()
    discard(docs.sparkSession, counts)
    return {r["word"]: math.log10(whole / r["n"]) for r in known}


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", costly: float = COSTLY) -> DataFrame:
    """``key``, ``n_assign``, ``n_access``, ``n_hex``, ``base``, ``spans`` and ``top_cost`` of every row of ``docs``.

    Spans are ``kind:start:end`` in code points, ends exclusive, by start and
    then by kind, joined by commas: ``base`` has the patterns, ``spans`` also the
    values of a credential context (kind ``guess``) that cost ``costly`` or more;
    ``top_cost`` is the greatest cost of a value, null where there is none.
    Null texts are empty; null and repeated ids are rows of their own.
    """
    spark = docs.sparkSession
    share_code(spark)
    found = materialise(_scan(docs, key, text), "found")
    asked = materialise(_asked(found), "asked")
    words = word_costs(docs, bit_filter(asked), text)
    discard(spark, asked)
    sent = spark.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guess = Guess(sent.value)
        for batch in batches:
            spans, top = [], []
            for base, starts, ends, texts in zip(*(batch.column(i).to_pylist() for i in (4, 5, 6, 7)), strict=True):
                costs = [guess.cost(t) for t in texts]
                parts = [s.split(":") for s in base.split(",")] if base else []
                held = [(int(a), int(b), k) for k, a, b in parts]
                spans.append(_listed(held + [(a, b, "guess") for a, b, c in zip(starts, ends, costs, strict=True) if c >= costly]))
                top.append(max(costs, default=None))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(spans, pa.string()), pa.array(top, pa.float64())], names=["key", "n_assign", "n_access", "n_hex", "base", "spans", "top_cost"])

    done = found.mapInArrow(run, f"key {dict(docs.dtypes)[key]}, n_assign bigint, n_access bigint, n_hex bigint, base string, spans string, top_cost double")
    return done.withColumnRenamed("key", key)

