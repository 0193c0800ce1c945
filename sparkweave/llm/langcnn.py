"""Language identification by a byte convolutional network in numpy.

Text is cut into windows of ``WINDOW`` bytes, the last one padded.  Filters of
several widths slide over byte embeddings, the largest answer of each filter
in a window goes to a softmax layer, and a text's languages are the mean of
its windows' probabilities.  Convolution over bytes is a sum of table rows:
for filter width w, place j has a table of one row for each byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from sparkweave.llm import bytesnp
from sparkweave.session import discard, materialise, share_code

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
#: No answer is possible for a text without a letter.
UNKNOWN = "und"
#: Characters of the pieces that labelled texts are cut into for training, and pieces of one language and of all.
PIECE, PIECES_PER_LANGUAGE, PIECES = 200, 1600, 100_000

#: Bytes fold to 64 kinds: case is dropped, ASCII that is no letter is grouped, others keep their low bits.
_KIND = np.zeros(256, dtype=np.int64)
_KIND[1:] = 1
_KIND[48:58] = 2
_KIND[97:123] = _KIND[65:91] = np.arange(3, 29)
_KIND[128:] = 29 + np.arange(128) % 35
KINDS = 64


@dataclass(frozen=True)
class Network:
    languages: list[str]
    tables: list[np.ndarray]  # for each width: (width, KINDS, FILTERS)
    bias: np.ndarray  # (len(WIDTHS) * FILTERS,)
    out: np.ndarray  # (features, languages)
    out_bias: np.ndarray

    def pair_tables(self) -> list[list[np.ndarray]]:
        """Tables over two neighbouring bytes at once: half the look-ups."""
        return [[(t[j][:, None, :] + t[j + 1][None, :, :]).reshape(KINDS * KINDS, -1) if j + 1 < len(t) else t[j] for j in range(0, len(t), 2)] for t in self.tables]

    def features(self, kinds: np.ndarray) -> np.ndarray:
        """The largest answer of each filter in each window; ``kinds``: (windows, WINDOW)."""
        n = len(kinds)
        flat = kinds.reshape(-1)
        padded = np.concatenate([flat, np.zeros(max(WIDTHS), np.int64)])
        pairs = padded[:-1] * KINDS + padded[1:]
        found = []
        for width, tables in zip(WIDTHS, self.pair_tables(), strict=True):
            acc = None
            for i, table in enumerate(tables):
                index = (pairs if 2 * i + 1 < width else padded)[2 * i : 2 * i + len(flat)]
                got = table[index]
                acc = got if acc is None else np.add(acc, got, out=acc)
            # Filters do not reach past a window's end.
            found.append(acc.reshape(n, WINDOW, -1)[:, : WINDOW - width + 1].max(1))
        return np.maximum(np.concatenate(found, 1) + self.bias, 0)

    def probabilities(self, kinds: np.ndarray) -> np.ndarray:
        z = self.features(kinds) @ self.out + self.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def windows(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte kinds in whole windows (padded by 0), and each window's row."""
    sizes = np.diff(offs)
    count = -(-sizes // WINDOW)
    row = np.repeat(np.arange(len(sizes)), count)
    first = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(first[-1] * WINDOW, dtype=np.int64)
    shift = first[:-1] * WINDOW - offs[:-1]
    out[np.arange(len(buf)) + np.repeat(shift, sizes)] = _KIND[buf]
    return out.reshape(-1, WINDOW), row


def train(texts: list[str], languages: list[str], epochs: int = 12, rate: float = 0.01, seed: int = 7) -> Network:
    """Adam on softmax cross-entropy; gradients of a filter go to the place that gave its maximum."""
    names = sorted(set(languages)) or [UNKNOWN]
    rng = np.random.default_rng(seed)
    buf, offs = bytesnp.flat(pa.array(texts, pa.string()))
    kinds, row = windows(buf, offs)
    target = np.array([names.index(x) for x in languages], dtype=np.int64)[row] if len(row) else np.zeros(0, np.int64)
    size = len(WIDTHS) * FILTERS
    params = [rng.normal(0, 0.3, (w, KINDS, FILTERS)).astype(np.float32) for w in WIDTHS] + [np.zeros(size, np.float32), rng.normal(0, 0.1, (size, len(names))).astype(np.float32), np.zeros(len(names), np.float32)]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(kinds))
        for a in range(0, len(order), 64):
            take = order[a : a + 64]
            x, y = kinds[take], target[take]
            grads = [np.zeros_like(p) for p in params]
            tops, feats = [], []
            padded = np.concatenate([x, np.zeros((len(x), max(WIDTHS)), np.int64)], 1)
            for table, width in zip(params, WIDTHS, strict=False):
                acc = sum(table[j][padded[:, j : j + WINDOW]] for j in range(width))[:, : WINDOW - width + 1]
                tops.append(acc.argmax(1))
                feats.append(acc.max(1))
            raw = np.concatenate(feats, 1) + params[-3]
            feat = np.maximum(raw, 0)
            z = feat @ params[-2] + params[-1]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            grads[-2][:] = feat.T @ p
            grads[-1][:] = p.sum(0)
            back = (p @ params[-2].T) * (raw > 0)
            grads[-3][:] = back.sum(0)
            for i, width in enumerate(WIDTHS):
                own = back[:, i * FILTERS : (i + 1) * FILTERS]
                for j in range(width):
                    at = np.take_along_axis(padded, tops[i] + j, 1)
                    np.add.at(grads[i][j], (at, np.arange(FILTERS)[None, :]), own)
            step += 1
            for p_, g, m in zip(params, grads, moments, strict=True):
                m[0] = 0.9 * m[0] + 0.1 * g
                m[1] = 0.99 * m[1] + 0.01 * g * g
                p_ -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-7)
    return Network(names, params[: len(WIDTHS)], params[-3], params[-2], params[-1])


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Network:
    """Train on about ``PIECES_PER_LANGUAGE`` pieces of each language, chosen by hash from all pieces of all its texts.

    Whole texts are cut into pieces of ``PIECE`` characters, so every part of
    every text is as likely to be chosen as any other.  ``PIECES`` bounds the
    pieces of all languages: with more than ``PIECES`` languages, rare ones get
    theirs by chance and may be left out.  Null or empty texts and null
    languages teach nothing; rows that repeat count once, those without an id
    are told apart by their texts.  Without labelled text every answer is ``und``.
    """
    id_ = F.col(key).cast("string")
    cut = docs.where((F.length(text) > 0) & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.coalesce(id_, F.col(text))).alias("salt"), F.ceil(F.length(text) / PIECE).cast("int").alias("n"))
    counts = materialise(cut.groupBy(F.col("lang").alias("v")).agg(F.sum("n").alias("all")), "values")
    share, space = float(min(PIECES_PER_LANGUAGE, PIECES / max(counts.count(), 1))), 1 << 30
    rates = counts.select("v", (F.lit(share) / F.col("all") * space + 1).cast("bigint").alias("below"))
    # Pieces are cut before rows are made of them, so no row carries a whole text along.
    drawn = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.pmod(F.xxhash64("salt", i), F.lit(space)) < F.col("below"))
    pieces = F.transform(drawn, lambda i: F.substring(F.col("text"), i * PIECE + 1, F.lit(PIECE)))
    rows = cut.join(rates, F.col("lang") == F.col("v")).select("lang", F.explode(pieces).alias("t")).distinct().toPandas()
    discard(docs.sparkSession, counts)
    rows = rows.sort_values(["lang", "t"])
    return train(rows["t"].tolist(), rows["lang"].tolist())


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, network: Network, text: str = "text") -> DataFrame:
    """Append ``lang_pred`` and ``score``, the mean probability of that language over all windows.

    Texts that are null or have no letter get ``und`` and score 0.  Columns of
    those names are replaced.  Ties go to the first language by name.
    """
    share_code(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(network)
    columns = [c for c in docs.columns if c not in ("lang_pred", "score")]
    letter = max(columns, key=len) + "_letter"
    kept = docs.select(*[f"`{c}`" for c in columns], has_letter(F.col(text)).alias(letter))
    schema = StructType([*list(kept.schema)[:-1], StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Network = sent.value
        for batch in batches:
            buf, offs = bytesnp.flat(batch.column(batch.schema.get_field_index(text)))
            letter = np.asarray(batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False), dtype=bool)
            best, score = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for a, b in bytesnp.slices(offs, 1 << 17):
                total, seen = np.zeros((b - a, len(net.languages))), np.zeros(b - a)
                kinds, row = windows(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                for i in range(0, len(kinds), 512):
                    np.add.at(total, row[i : i + 512], net.probabilities(kinds[i : i + 512]))
                seen = np.maximum(np.bincount(row, minlength=b - a), 1)
                mean = total / seen[:, None]
                best[a:b], score[a:b] = mean.argmax(1), np.minimum(mean.max(1), 1.0)
            names = np.array([*net.languages, UNKNOWN], dtype=object)
            pred = names[np.where(letter, best, len(net.languages))]
            columns = [*batch.columns[:-1], pa.array(pred.tolist(), pa.string()), pa.array(np.where(letter, score, 0.0))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return kept.mapInArrow(run, schema)
