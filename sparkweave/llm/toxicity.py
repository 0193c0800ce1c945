"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

Spans that a writer may have disguised (signs or digits among letters, a
letter three times running, letters spaced out) become lattices: each sign may
stand for letters or for nothing, a run for one or two of its letter, a space
between lone letters for nothing.  Viterbi decoding finds the reading that is
likeliest under a character trigram model of the corpus.  All other text has
one reading and stays as it is.

A reading counts word by word: one that changes what is written must give a
word that labelled documents hold as it is, long enough for the signs read as
letters; else what is written stays.  So numbers, versions, formulas and
hyphens are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.llm import bytesnp, filters, ftrl
from sparkweave.session import discard, materialise, share_code

BITS = 18
#: Kinds of bytes in the character model: 0 for all that ends a word, 1-26 letters, then bytes beyond ASCII.
KINDS = 44
_KIND = np.zeros(256, dtype=np.int64)
_KIND[97:123] = np.arange(1, 27)
_KIND[128:] = 27 + np.arange(128) % 17

# What signs may stand for.
READINGS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "aeiou"}
#: Signs that may also stand for nothing between letters.
SILENT = ".-_*~'^/|,"
#: Channel costs (nats): a sign read as a letter, dropped, kept as it is; a run of a letter cut to one or two.
READ, DROP, KEEP, CUT = 1.0, 1.5, 6.0, 0.5
#: Signs that also punctuate: the cost of keeping one before and after a span's first and last letter.
EDGE = {"(": (2.0, 2.0), "!": (KEEP, 0.0), "|": (5.0, 1.0), "+": (5.0, 1.0), "*": (1.0, 0.0)}
#: Cost of keeping a digit at the end that follows another one, and a gap between lone letters; what a run of one sign beside a word costs more to read.
NUMBER, GAP, BESIDE = 0.5, 2.0, 4.0

#: Letters that a word must have if signs were read: of any kind, one that numbers and formulas use among them, a digit at its start or end.
FEWEST, FEWEST_DIGIT, FEWEST_EDGE = 3, 4, 5

_SIGN = np.zeros(256, dtype=bool)
_SIGN[[ord(c) for c in {*READINGS, *SILENT}]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
#: Bytes of a word: letters, digits and all beyond ASCII.
_WORD = bytesnp.ALNUM
_READ = np.zeros(256, dtype=bool)
_READ[[ord(c) for c in READINGS]] = True
_SIGNS = {*READINGS, *SILENT}
_SPACE = "\t\n\v\f\r "


def character_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Trigrams of byte kinds over all of ``docs``; the table has ``KINDS`` cubed cells."""
    share_code(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(KINDS**3, dtype=np.int64)
        for batch in batches:
            buf, offs = bytesnp.flat(batch.column(0))
            for a, b in bytesnp.slices(offs):
                # Every row begins after two word ends and closes with one; no trigram reaches over rows.
                own = offs[a : b + 1] - offs[a]
                kind = np.insert(_KIND[bytesnp.LOWER[buf[offs[a] : offs[b]]]], np.repeat(own, 2), 0)
                three = (kind[:-2] * KINDS + kind[1:-1]) * KINDS + kind[2:]
                total += np.bincount(three, minlength=KINDS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "n"])

    got = docs.select(text).mapInArrow(run, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(KINDS**3)
    out[got["at"]] = got["n"]
    return out.reshape(KINDS, KINDS, KINDS)


def character_model(counts: np.ndarray) -> np.ndarray:
    """Costs (-ln) of a kind after two others, smoothed by shorter contexts."""
    one = counts.sum((0, 1)) + 1
    one /= one.sum()
    two = counts.sum(0) + 5 * one
    two /= two.sum(1, keepdims=True)
    three = counts + 5 * two
    return -np.log(three / three.sum(2, keepdims=True))


class Decoder:
    """Viterbi decoding of spans, with the readings of spans seen lately."""

    def __init__(self, model: np.ndarray, known: np.ndarray | None = None, most: int = 100_000) -> None:
        """``known`` is a bit filter of the words that readings may give; without one any word may be read."""
        self.cost = model.tolist()
        self.known = known
        self.seen: dict[bytes, bytes] = {}
        self.most = most

    def lattice(self, span: bytes) -> list[list[tuple[bytes, float]]]:
        """For each place the strings that may stand there, with channel costs."""
        return [options for _, options in self.places(span)]

    def places(self, span: bytes) -> list[tuple[bytes, list[tuple[bytes, float]]]]:
        """What is written at each place, and what it may stand for."""
        out, i, text = [], 0, span.decode(errors="surrogateescape")
        letters = [k for k, c in enumerate(text) if c.isalpha()]
        head, tail = (letters[0], letters[-1]) if letters else (len(text), -1)
        gaps = [len(g) for g in re.findall(r"[\t-\r ]+", text)]
        while i < len(text):
            c = text[i]
            run = 1
            while i + run < len(text) and text[i + run] == c:
                run += 1
            if "a" <= c <= "z" and run >= 3:
                out.append((c.encode() * run, [(c.encode(), CUT), (c.encode() * 2, CUT)]))
                i += run
                continue
            if c in _SPACE:
                while i + run < len(text) and text[i + run] in _SPACE:
                    run += 1
                # A gap wider than the narrowest one parts words.
                out.append((text[i : i + run].encode(), [(b" ", 0.0)] if run > min(gaps) else [(b" ", GAP), (b"", 0.0)]))
                i += run
                continue
            edge = i < head or i > tail
            if edge and run >= (2 if c == "!" else 3) and c in _SIGNS and not c.isdigit():
                # Rather a rule or an exclamation beside a word than one or two letters.
                out.append((c.encode() * run, [(c.encode() * run, 0.0), *[(x.encode() * k, READ + BESIDE) for x in READINGS.get(c, "") for k in (1, 2)]]))
                i += run
                continue
            keep = KEEP if c in READINGS or c in SILENT and not edge else 0.0
            if c in EDGE and edge:
                keep = EDGE[c][i > tail]
            elif i > tail + 1 and c.isdigit() and text[i - 1].isdigit():
                keep = NUMBER
            own = c.encode(errors="surrogateescape")
            options = [(own, keep)]
            options += [(x.encode(), READ + (0.7 if c == "*" else 0.0)) for x in READINGS.get(c, "")]
            if c in SILENT and not edge:
                options.append((b"", DROP))
            out.append((own, options))
            i += 1
        return out

    def best(self, lattice: list[list[tuple[bytes, float]]]) -> list[bytes]:
        """The string at each place of the likeliest reading."""
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for options in [*lattice, [(b" ", 0.0)]]:
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, path) in states.items():
                for string, extra in options:
                    x, y, total = a, b, cost + extra
                    for byte in string:
                        k = int(_KIND[byte])
                        total += self.cost[x][y][k]
                        x, y = y, k
                    if (x, y) not in new or total < new[x, y][0]:
                        new[x, y] = (total, (path, string))
            states = new
        path, parts = min(states.values(), key=lambda s: s[0])[1], []
        while path is not None:
            path, string = path
            parts.append(string)
        return parts[:0:-1]

    def fits(self, written: list[bytes], read: list[bytes]) -> bool:
        """Whether the places of one word may be read so."""
        word = b"".join(read)
        if len(word) < FEWEST and any(not r and not w.isspace() for w, r in zip(written, read, strict=True)):
            return False
        signs = [(k, w) for k, (w, r) in enumerate(zip(written, read, strict=True)) if r and w != r and not w.isalpha()]
        if signs:
            digits = [k for k, w in signs if w.isdigit() or w in (b"+", b"(", b"|")]
            ends = {0, len(read) - 1}
            fewest = FEWEST_EDGE if any(k in ends and written[k].isdigit() for k in digits) else FEWEST_DIGIT if digits else FEWEST
            if len(word) < fewest or any(48 <= c < 58 for c in word):
                return False
        return self.known is None or bool(filters.passes(self.known, np.array([bytesnp.word_hash(word)], np.uint64))[0])

    def restore(self, span: bytes) -> bytes:
        got = self.seen.get(span)
        if got is None:
            places = self.places(span)
            written, read = [w for w, _ in places], self.best([o for _, o in places])
            out, a = [], 0
            for b in range(len(read) + 1):
                # A word ends at a string kept as it is that is no part of one, and at a gap between words.
                if b == len(read) or read[b] and not _WORD[read[b][0]]:
                    same = written[a:b] == read[a:b]
                    out += read[a:b] if same or self.fits(written[a:b], read[a:b]) else written[a:b]
                    out += read[b : b + 1]
                    a = b + 1
            got = b"".join(out)
            if len(self.seen) >= self.most:
                self.seen.clear()
            if len(span) <= 64:
                self.seen[span] = got
        return got


def suspicious(x: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of lower-cased rows that may be disguised; they do not overlap."""
    starts, ends, first = bytesnp.words(x, offs, bytesnp.NOT_SPACE)
    if not len(starts):
        return starts, ends
    n = len(x)
    letter, sign = _LETTER[x], _SIGN[x]
    odd = np.zeros(n + 1, bool)
    # A sign with a letter right after it; a word that holds a letter and a sign that may stand for one.
    odd[: n - 1] = sign[:-1] & letter[1:]
    if n > 2:
        odd[: n - 2] |= letter[:-2] & (x[:-2] == x[1:-1]) & (x[1:-1] == x[2:])
    count = np.concatenate([[0], np.cumsum(odd[:n])])
    letters, reads = (np.concatenate([[0], np.cumsum(k)]) for k in (letter, _READ[x]))
    marked = (count[ends] > count[starts]) | (letters[ends] > letters[starts]) & (reads[ends] > reads[starts])
    # Runs of three lone letters and signs or more, in one row, letters being most of them: rows of numbers are none.
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    lone = (ends - starts == 1) & (letter[starts] | sign[starts])
    group = np.cumsum(np.concatenate([[True], (lone[1:] != lone[:-1]) | (row[1:] != row[:-1])])) - 1
    size = np.bincount(group)
    joined = lone & (size[group] >= 3) & (2 * np.bincount(group, letter[starts])[group] > size[group])
    head = np.flatnonzero(joined & np.concatenate([[True], group[1:] != group[:-1]]))
    tail = np.flatnonzero(joined & np.concatenate([group[1:] != group[:-1], [True]]))
    single = np.flatnonzero(marked & ~joined)
    s, e = np.concatenate([starts[single], starts[head]]), np.concatenate([ends[single], ends[tail]])
    order = np.argsort(s)
    return s[order], e[order]


#: Signs at a span's ends that are punctuation and stand for no letter.
_EDGES = b".,;:?\"')[]{}<>#%&-_~^/"


def restore(buf: np.ndarray, offs: np.ndarray, decoder: Decoder) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased rows with disguised spans replaced by their likeliest readings."""
    x = bytesnp.LOWER[buf]
    starts, ends = suspicious(x, offs)
    if not len(starts):
        return x, offs
    data, parts, at, grown = x.tobytes(), [], 0, np.zeros(len(starts), np.int64)
    for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        span = data[a:b]
        left = a + len(span) - len(span.lstrip(_EDGES))
        right = max(left, b - (len(span) - len(span.rstrip(_EDGES))))
        if right - left < 3:
            continue
        new = decoder.restore(data[left:right])
        parts += [data[at:left], new]
        grown[i] = len(new) - (right - left)
        at = right
    parts.append(data[at:])
    shift = np.concatenate([[0], np.cumsum(grown)])
    return np.frombuffer(b"".join(parts), np.uint8), offs + shift[np.searchsorted(starts, offs)]


class Extract:
    """The distinct words and word beginnings of the restored text."""

    def __init__(self, model: np.ndarray, known: np.ndarray | None = None) -> None:
        self.model, self.known = model, known
        self.decoder: Decoder | None = None

    def __getstate__(self) -> dict:
        return {"model": self.model, "known": self.known, "decoder": None}

    def __call__(self, buf: np.ndarray, offs: np.ndarray) -> ftrl.Features:
        if self.decoder is None:
            self.decoder = Decoder(self.model, self.known)
        x, o = restore(buf, offs, self.decoder)
        starts, ends, first = bytesnp.words(x, o, bytesnp.ALNUM)
        shift = np.uint64(64 - BITS)
        whole = bytesnp.span_hash(x, starts, ends)
        begin = bytesnp.span_hash(x, starts, np.minimum(ends, starts + 4))
        five = bytesnp.span_hash(x, starts, np.minimum(ends, starts + 5))
        at = np.stack([bytesnp.mix(whole) >> shift, bytesnp.mix(begin + np.uint64(1)) >> shift, bytesnp.mix(five + np.uint64(2)) >> shift], 1).reshape(-1).astype(np.int64)
        # A feature counts once for each text, so that long texts do not drift by common words.
        row = np.repeat(np.arange(len(first) - 1), np.diff(first) * 3)
        cell = np.unique(row.astype(np.int64) << 32 | at)
        return cell & 0xFFFFFFFF, np.ones(len(cell)), np.searchsorted(cell >> 32, np.arange(len(first)))


def plain_words(texts: DataFrame, text: str) -> DataFrame:
    """``term``: hashes of the words of ``FEWEST`` letters or more that are written in letters alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = bytesnp.flat(batch.column(0))
            for a, b in bytesnp.slices(offs):
                x = bytesnp.LOWER[buf[offs[a] : offs[b]]]
                starts, ends, _ = bytesnp.words(x, offs[a : b + 1] - offs[a], bytesnp.ALNUM)
                digits = np.concatenate([[0], np.cumsum((x >= 48) & (x < 58))])
                fine = (ends - starts >= FEWEST) & (digits[ends] == digits[starts])
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(bytesnp.span_hash(x, starts[fine], ends[fine])).view(np.int64))], names=["term"])

    return texts.select(text).mapInArrow(run, "term bigint")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> tuple[np.ndarray, Extract]:
    """The character model over all of ``docs``, the words of all labelled documents, and the weights fitted on all of them.

    Null texts are empty, null and repeated ids are as in ``ftrl.labelled``;
    without a labelled document all weights are 0, and every text scores 0.5.
    """
    spark = docs.sparkSession
    share_code(spark)
    texts = materialise(ftrl.labelled(docs, labels, label), "labelled")
    reader = Extract(character_model(character_counts(docs)), filters.bit_filter(plain_words(texts, "__text")))
    weights = ftrl.fit_on(texts, reader, 1 << BITS, alpha=1.0, l1=4.0, l2=0.1, epochs=4)
    discard(spark, texts)
    return weights, reader


def score(docs: DataFrame, fitted: tuple[np.ndarray, Extract], text: str = "text") -> DataFrame:
    """``docs`` with ``score``, the probability of label 1; null and empty texts score alike."""
    return ftrl.score(docs, fitted[0], fitted[1], text)
