"""Quality classifier: hashed word n-grams, FTRL logistic regression, sparse dot products.

The n-grams run over two sequences of a text's words: the lower-cased words, a
word that repeats the one before it being replaced by one mark, and the words'
shapes (runs of capitals, small letters, digits, and other signs as they are).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from sparkweave.llm import bytesnp, ftrl

BITS = 18
#: Unigrams and bigrams of words, then of shapes.
SALTS = np.random.default_rng(41).integers(1, 1 << 63, 4, dtype=np.uint64) | np.uint64(1)
_REPEAT = np.uint64(0x5DEECE66D)

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[48:58], _SHAPE[65:91], _SHAPE[97:123], _SHAPE[0x09:0x0E] = 48, 65, 97, 32


def _ngrams(tokens: np.ndarray, first: np.ndarray, salts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and rows of the unigrams and bigrams of each row."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    pair = bytesnp.mix(tokens[:-1] * salts[1] + tokens[1:]) if len(tokens) else tokens
    inside = row[:-1] == row[1:]
    shift = np.uint64(64 - BITS)
    return np.concatenate([bytesnp.mix(tokens * salts[0]) >> shift, pair[inside] >> shift]).astype(np.int64), np.concatenate([row, row[:-1][inside]])


def extract(buf: np.ndarray, offs: np.ndarray) -> ftrl.Features:
    lower = bytesnp.LOWER[buf]
    starts, ends, first = bytesnp.words(lower, offs, bytesnp.NOT_SPACE)
    tokens = bytesnp.span_hash(lower, starts, ends)
    again = np.zeros(len(tokens), bool)
    again[1:] = tokens[1:] == tokens[:-1]
    again[first[:-1][first[:-1] < len(tokens)]] = False
    tokens = np.where(again, _REPEAT, tokens)
    # Shapes: letters outside ASCII are left out, runs of one kind collapse.
    shape = _SHAPE[buf]
    keep = buf < 128
    keep[1:] &= (shape[1:] != shape[:-1]) | ~(buf[:-1] < 128)
    keep[offs[:-1][offs[:-1] < len(buf)]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    small, small_offs = shape[keep], kept[offs]
    s, e, f = bytesnp.words(small, small_offs, bytesnp.NOT_SPACE)
    parts = [_ngrams(tokens, first, SALTS[:2]), _ngrams(bytesnp.span_hash(small, s, e), f, SALTS[2:])]
    at, row = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(row, kind="stable")
    n = np.bincount(row, minlength=len(offs) - 1)
    value = (1.0 / np.sqrt(np.maximum(n, 1)))[row]
    return at[order], value[order], np.concatenate([[0], np.cumsum(n)])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> np.ndarray:
    return ftrl.fit(docs, labels, label, extract, 1 << BITS, alpha=0.2, l1=0.05, l2=0.1, epochs=4)


def score(docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    return ftrl.score(docs, weights, extract, text)
