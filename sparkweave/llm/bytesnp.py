"""Vectorised text primitives on Arrow string columns.

A batch of texts is one flat ``uint8`` array plus document offsets; tokens are
pairs of byte positions found by a class table, hashed by a prefix-sum
polynomial, so no per-token Python runs.  Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Random values of the 256 bytes, from a fixed seed.
_BYTE = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)

_BYTES = _BYTE.tolist()

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words are maximal runs of anything but space and the five ASCII controls 09-0D.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Words are maximal runs of ASCII letters and digits and of non-ASCII characters.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the result."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class _Powers:
    """Powers of the base and of its inverse, grown on demand and kept per worker."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << max(16, (n - 1).bit_length())
            for name, factor in (("up", _BASE), ("down", _INVERSE)):
                full = np.full(size, factor & _M64, dtype=np.uint64)
                full[0] = 1
                setattr(cls, name, np.multiply.accumulate(full))
        return cls.up[:n], cls.down[:n]


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.chunk(0) if texts.num_chunks else pa.array([], pa.large_string())
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of whole rows of about ``most`` bytes (one row may be longer)."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def words(buf: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside`` bytes within rows, and each row's first token."""
    n = len(buf)
    mask = inside[buf]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    before = np.empty(n, dtype=bool)
    after = np.empty(n, dtype=bool)
    if n:
        before[0], after[-1] = False, False
        before[1:], after[:-1] = mask[:-1], mask[1:]
        starts = np.flatnonzero(mask & ~(before & ~edge[:n]))
        ends = np.flatnonzero(mask & ~(after & ~edge[1:])) + 1
    else:
        starts = ends = np.zeros(0, np.int64)
    return starts, ends, np.searchsorted(starts, offs)


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; equal spans hash alike wherever they stand."""
    n = len(buf)
    up, down = _Powers.upto(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[buf] * up[:n], out=total[1:])
    raw = (total[ends] - total[starts]) * down[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hash(word: bytes) -> int:
    """What ``span_hash`` gives for one word, without arrays."""
    up, _ = _Powers.upto(len(word) + 1)
    x = sum(_BYTES[b] * p for b, p in zip(word, up[: len(word)].tolist(), strict=True)) + len(word) * 0xD6E8FEB86659FD93 & _M64
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD & _M64
    x ^= x >> 33
    x = x * 0xC4CEB9FE1A85EC53 & _M64
    return x ^ x >> 33


def shingle_hash(tokens: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every row's runs of ``width`` tokens (all tokens if fewer), and each row's first shingle.

    Rows without tokens have no shingle.
    """
    n = np.diff(first)
    count = np.where(n == 0, 0, np.maximum(n - width + 1, 1))
    out_first = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(n)), count)
    at = first[:-1][row] + (np.arange(out_first[-1]) - out_first[:-1][row])
    stop = first[1:][row]
    acc = np.full(len(at), 0x2545F4914F6CDD1D, dtype=np.uint64)
    padded = np.concatenate([tokens, np.zeros(width, np.uint64)])
    for j in range(width):
        part = np.where(at + j < stop, padded[at + j], np.uint64(0x51ED270B))
        acc = (acc ^ part) * np.uint64(0x9FB21C651E98DF25)
        acc ^= acc >> np.uint64(29)
    return mix(acc), out_first
