"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece exactly one token can stand last in its
encoding.  Storing that token for each prefix gives the encoding by walking
back, lets bytes be appended without touching what is stored, and lets an edit
be re-encoded from the first changed byte on.

Whether ``left`` may stand before ``right`` is decided from the merge order
alone: both tokens are taken apart in the reverse order of their merges, and
the pair is impossible if at any point a merge across the cut would have come
first.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from sparkweave.session import share_code

#: Pieces whose encodings a worker keeps, in each of two generations.
CACHE = 200_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and numbers."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, Path(path).read_bytes().splitlines())}


class PrefixEncoder:
    """The vocabulary, its merge tree and the encodings of pieces seen lately."""

    def __init__(self, ranks: dict[bytes, int], cache: int = CACHE) -> None:
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        #: Tokens by their bytes read backwards; the key -1 holds the token that begins here.
        self.endings: dict = {}
        for token, rank in ranks.items():
            node = self.endings
            for byte in reversed(token):
                node = node.setdefault(byte, {})
            node[-1] = rank
        self.longest = max(map(len, ranks), default=0)
        self.parts: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.seen: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.cache = cache

    def _split(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes ``token``; a token made by none is its own halves."""
        if token not in self.parts:
            data = self.tokens[token]
            found = (token, token)
            for cut in range(1, len(data)):
                left, right = self.ranks.get(data[:cut]), self.ranks.get(data[cut:])
                if left is not None and right is not None and left < token and right < token and self.compatible(left, right, token):
                    found = (left, right)
                    break
            self.parts[token] = found
        return self.parts[token]

    def compatible(self, left: int, right: int, below: int | None = None) -> bool:
        """Whether ``left`` then ``right`` is stable under all merges (of rank under ``below``)."""
        key = (left, right)
        if below is None and key in self.pairs:
            return self.pairs[key]
        bound = below if below is not None else 1 << 62
        a, b, ok = left, right, True
        while True:
            joined = self.ranks.get(self.tokens[a] + self.tokens[b])
            if joined is not None and joined < bound:
                ok = False
                break
            # Undo the later of the two merges; what crosses the cut must come no earlier than it.
            whole_a, whole_b = len(self.tokens[a]) == 1, len(self.tokens[b]) == 1
            if whole_a and whole_b:
                break
            if not whole_a and (whole_b or a > b):
                inner = self._split(a)[1]
                if inner == a:
                    break
                bound, a = min(bound, a), inner
            else:
                inner = self._split(b)[0]
                if inner == b:
                    break
                bound, b = min(bound, b + 1), inner
        if below is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            self.pairs[key] = ok
        return ok

    def extend(self, data: bytes, last: list[int], upto: int | None = None) -> list[int]:
        """Fill ``last`` (the last token of each prefix) from its length up to ``upto``."""
        endings, pairs, compatible = self.endings, self.pairs, self.compatible
        for end in range(len(last) + 1, (len(data) if upto is None else upto) + 1):
            # Tokens that end here, the shortest first.
            node, at, found = endings, end, []
            while at:
                at -= 1
                node = node.get(data[at])
                if node is None:
                    break
                if -1 in node:
                    found.append((node[-1], at))
            while found:
                token, at = found.pop()
                if not at:
                    last.append(token)
                    break
                key = (last[at - 1], token)
                ok = pairs.get(key)
                if compatible(*key) if ok is None else ok:
                    last.append(token)
                    break
            else:
                raise ValueError(f"byte {data[end - 1]} is not in the vocabulary")
        return last

    @staticmethod
    def walk(last: list[int], tokens: dict[int, bytes], end: int | None = None) -> list[int]:
        """The encoding that a prefix table stands for."""
        out, at = [], len(last) if end is None else end
        while at:
            out.append(last[at - 1])
            at -= len(tokens[out[-1]])
        return out[::-1]

    def piece(self, data: bytes) -> bytes:
        """Little-endian 32-bit ids of one piece; a piece that is a token is that token."""
        got = self.seen.get(data)
        if got is None:
            got = self.older.get(data)
            if got is None:
                whole = self.ranks.get(data)
                ids = [whole] if whole is not None else self.walk(self.extend(data, []), self.tokens)
                got = struct.pack(f"<{len(ids)}I", *ids)
            if len(self.seen) >= self.cache:
                # Pieces not met again while the store filled are forgotten.
                self.seen, self.older = {}, self.seen
            if len(data) <= 256:
                self.seen[data] = got
        return got

    def append(self, data: bytes, last: list[int], more: bytes) -> tuple[bytes, list[int]]:
        """Exact append inside a piece: stored prefixes stay as they are."""
        data += more
        return data, self.extend(data, last)

    def edit(self, data: bytes, last: list[int], start: int, stop: int, new: bytes) -> tuple[bytes, list[int]]:
        """Replace bytes ``start:stop``; prefixes are computed again from there until the table agrees with the old one.

        A prefix's token depends on the tokens of the prefixes that are shorter
        by up to the longest token.  Where so many neighbouring prefixes beyond
        the edit agree, all that follow agree.
        """
        data, old, shift = data[:start] + new + data[stop:], last, start + len(new) - stop
        last, end = last[:start], start + len(new)
        self.extend(data, last, end)
        same = 0
        while end < len(data) and same < self.longest:
            end += 1
            self.extend(data, last, end)
            same = same + 1 if last[end - 1] == old[end - 1 - shift] else 0
        return data, last + old[end - shift :]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_ENCODERS: dict[str, PrefixEncoder] = {}


def encoder(path: str) -> PrefixEncoder:
    """The worker's encoder of a vocabulary file, loaded once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PrefixEncoder(load_ranks(path))
    return _ENCODERS[path]


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", keep_ids: bool = True) -> DataFrame:
    """Append ``bpe_ids`` (if ``keep_ids``), ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` to ``docs``.

    Null and empty texts have no token and the digests of nothing.  Columns of
    ``docs`` with those names are replaced.  Repeated rows are encoded each.
    Every whole text is encoded; memory is one Arrow batch and the piece store.
    """
    share_code(docs.sparkSession)
    added = [("bpe_ids", "array<int>")] * keep_ids + [("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    names = {name for name, _ in added}
    kept = docs.select(*[f"`{c}`" for c in docs.columns if c not in names])
    schema = StructType([*kept.schema, *StructType.fromDDL(", ".join(f"{n} {t}" for n, t in added))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        split = regex.compile(pattern).findall
        piece = coder.piece
        for batch in batches:
            counts, ids, digests, decoded = [], [], [], []
            for value in batch.column(batch.schema.get_field_index(text)):
                parts = [p.encode() for p in split(value.as_py() or "")]
                seen = coder.seen
                packed = b"".join([seen.get(p) or piece(p) for p in parts])
                counts.append(len(packed) // 4)
                if keep_ids:
                    ids.append(np.frombuffer(packed, "<i4"))
                digests.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(coder.decode(packed)).hexdigest())
            columns = list(batch.columns)
            if keep_ids:
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.zeros(0, "<i4")]))))
            columns += [pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *(n for n, _ in added)])

    return kept.mapInArrow(run, schema)
