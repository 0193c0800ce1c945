"""Deterministic sharded WARC writer and reader.

Records are dealt to shards by ranges of their id and digest, cut where the
bytes before them pass multiples of a shard's size, sorted within a shard, and
written as one gzip member each.  A file is closed once its compressed size passes a
bound and the next one begins.  Every task writes under temporary names that
no other attempt uses and returns manifest rows; a second job renames what the
winning attempts wrote, and the manifest table is written last.  The same
input gives the same files, byte for byte.

Equal payloads are stored once, with the record of the largest id; the others
are revisit records that name it.  Only ids and digests are grouped for that:
the decisions are sorted in beside the pages, so a payload is shuffled once.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import math
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkweave.session import discard, materialise, scratch, share_code

#: A file is closed when its compressed size passes this.
ROLL = 8 << 20
#: Payload bytes aimed at for a shard, shards at most, and bytes that a record counts beside its payload.
SHARD, SHARDS, HEADERS = 32 << 20, 20_000, 512
#: Date of every record, so that files do not depend on when they are made.
DATE = "2000-01-01T00:00:00Z"
_MANIFEST = "temporary string, final string, shard bigint, roll bigint, records bigint, bytes bigint, sha256 string"
_RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, file string, payload binary"


def digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record: headers and digests regenerated, block empty for a revisit."""
    block = b"" if revisit else payload
    name = "null" if page is None else str(page)
    seed = hashlib.sha1(f"{name}\n{url}".encode() + payload).hexdigest()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.UUID(seed[:32])}>",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {''.join(c for c in url if c.isprintable()).strip()}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"X-Page-Id: {name}",
        f"X-Payload-Length: {len(payload)}",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {'null' if refers_to is None else refers_to}"] if revisit else []),
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without a time stamp."""
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=6, mtime=0) as z:
        z.write(data)
    return out.getvalue()


def _bounds(ids: DataFrame) -> list[tuple[int, str]]:
    """The (page, digest) at which each shard but the first begins, by bytes up to it in that order.

    Shards of ``SHARD`` bytes, larger only where there would be more than
    ``SHARDS``.  Sums over ranges of the order are put together, so the bounds
    are exact and do not depend on how the ranges were chosen.
    """
    spark = ids.sparkSession
    cost = ids.groupBy("place", "sha").agg(F.sum(F.col("size") + HEADERS).alias("bytes"))
    ranged = materialise(cost.repartitionByRange("place", "sha").withColumn("part", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("part").agg(F.sum("bytes").alias("bytes"), F.min(F.struct("place", "sha")).alias("head")).orderBy("head").collect()
    total = sum(r["bytes"] for r in sums)
    bytes_ = max(SHARD, -(-total // SHARDS))
    before, rows = 0, []
    for r in sums:
        rows.append((r["part"], before))
        before += r["bytes"]
    if total <= bytes_:
        discard(spark, ranged)
        return []
    offsets = spark.createDataFrame(rows, "part int, before bigint")
    upto = F.sum("bytes").over(Window.partitionBy("part").orderBy("place", "sha").rowsBetween(Window.unboundedPreceding, -1))
    at = ranged.withColumn("upto", F.coalesce(upto, F.lit(0))).join(offsets, "part").withColumn("shard", F.floor((F.col("before") + F.col("upto")) / F.lit(bytes_)))
    heads = at.groupBy("shard").agg(F.min(F.struct("place", "sha")).alias("head")).orderBy("shard").select("head.*").collect()
    discard(spark, ranged)
    return [(r["place"], r["sha"]) for r in heads[1:]]


def _shard(bounds: list[tuple[int, str]]) -> Column:
    """The shard of a row by its ``place`` and ``sha``: bounds are looked up in blocks, then within one block."""

    def begun(array: Column) -> Column:
        return F.size(F.filter(array, lambda b: (b["place"] < F.col("place")) | ((b["place"] == F.col("place")) & (b["sha"] <= F.col("sha")))))

    def literal(rows: list[tuple[int, str]]) -> Column:
        return F.array(*[F.struct(F.lit(p).cast("bigint").alias("place"), F.lit(x).alias("sha")) for p, x in rows])

    if not bounds:
        return F.lit(0).cast("bigint")
    width = max(1, math.isqrt(len(bounds)))
    blocks = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    block = begun(literal([x[0] for x in blocks]))
    inner = F.element_at(F.array(*[literal(x) for x in blocks]), F.greatest(block, F.lit(1)))
    return F.when(block == 0, 0).otherwise((block - 1) * width + begun(inner)).cast("bigint")


def _writer(root: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        attempt = uuid.uuid4().hex
        out, done = None, []
        state: dict = {}

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append([state[k] for k in ("temporary", "final", "shard", "roll", "records", "bytes")] + [state["sha"].hexdigest()])
                out = None

        decided, written = None, False
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                shard, page, kind, url, html, sha, resp = (c[i].as_py() for c in columns)
                if kind == 0:
                    # The decision about this id's payload comes before its pages.
                    decided, written = (shard, page, sha, resp), False
                    continue
                payload = (html or "").encode()
                told = decided is not None and decided[:3] == (shard, page, sha)
                revisit = told and (decided[3] != page or written)
                written = told
                data = member(record(page, url, payload, decided[3] if revisit else None, revisit))
                if out is not None and (state["shard"] != shard or state["bytes"] >= ROLL):
                    roll = state["roll"] + 1 if state["shard"] == shard else 0
                    close()
                elif out is None:
                    roll = 0
                if out is None:
                    name = f"pages-{shard:06d}-{roll:04d}.warc.gz"
                    state = {"temporary": f"{base}/_temporary-{attempt}-{name}", "final": f"{base}/{name}", "shard": shard, "roll": roll, "records": 0, "bytes": 0, "sha": hashlib.sha256()}
                    out = fs.open_output_stream(state["temporary"], compression=None)
                out.write(data)
                state["records"] += 1
                state["bytes"] += len(data)
                state["sha"].update(data)
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*done, strict=True)], names=["temporary", "final", "shard", "roll", "records", "bytes", "sha256"])

    return run


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Write every row of ``pages`` as a record under ``path``; the manifest's rows.

    Of equal payloads of ``least`` bytes or more, the record with the largest
    id is the response; among rows that repeat that id the first.  Null html is
    an empty payload; a null id sorts first, keeps its record, and never beats
    another id.  Ids may be any 64-bit numbers.  An empty table gives an empty
    manifest.
    """
    spark = pages.sparkSession
    share_code(spark)
    rows = pages.select(F.col(key).cast("bigint").alias("page"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    # Null ids stand with the smallest one.
    rows = rows.withColumn("place", F.coalesce("page", F.lit(-1 << 63))).withColumn("sha", F.sha1(payload))
    ids = materialise(rows.select("page", "place", "sha", F.octet_length(payload).cast("bigint").alias("size")), "ids")
    bounds = _bounds(ids)
    shard = _shard(bounds).alias("shard")
    groups = ids.where(F.col("size") >= least).groupBy("sha").agg(F.max("page").alias("resp"), F.count("*").alias("n")).where("n > 1")
    decided = ids.join(groups, "sha").select("page", "place", "sha", "resp").distinct()
    null = F.lit(None)
    both = decided.select(shard, "page", F.lit(0).alias("kind"), null.cast("string").alias("url"), null.cast("string").alias("html"), "sha", "resp").unionByName(
        rows.select(shard, "page", F.lit(1).alias("kind"), "url", "html", "sha", null.cast("bigint").alias("resp"))
    )
    dealt = both.repartitionByRange(len(bounds) + 1, "shard").sortWithinPartitions("shard", "page", "sha", "kind", "url")
    root = path if "://" in path else f"file://{path}"
    fs, base = pafs.FileSystem.from_uri(root)
    fs.create_dir(base, recursive=True)
    staged = f"{path}/_staged"
    dealt.mapInArrow(_writer(root), _MANIFEST).write.parquet(staged)
    discard(spark, ids)

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for old, new in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                # Done again after a lost task, the rename finds its work done.
                if store.get_file_info(old).type != pafs.FileType.NotFound:
                    store.move(old, new)
            yield batch

    spark.read.parquet(staged).mapInArrow(commit, _MANIFEST).drop("temporary").write.parquet(f"{path}/_manifest")
    for info in fs.get_file_info(pafs.FileSelector(base)):
        if info.base_name.startswith("_temporary-"):
            fs.delete_file(info.path)
    return spark.read.parquet(f"{path}/_manifest")


def _parse(stream: io.BufferedReader) -> Iterator[tuple[dict[str, str], bytes]]:
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, stream.read(int(headers["content-length"]))


def read(spark: SparkSession, manifest: DataFrame, path: str, payloads: bool = True) -> DataFrame:
    """The records of the manifest's files; digests and sizes are computed from what was read.

    A response whose payload does not fit its digest raises.
    """
    share_code(spark)
    root = path if "://" in path else f"file://{path}"

    def number(value: str | None) -> int | None:
        return None if value in (None, "null") else int(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(root)
        fields = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "payload"]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with gzip.open(fs.open_input_file(name), "rb") as stream:
                    for h, block in _parse(io.BufferedReader(stream, 1 << 20)):
                        revisit = h["warc-type"] == "revisit"
                        stated = h["warc-payload-digest"].removeprefix("sha1:")
                        if not revisit and digest(block) != stated:
                            raise ValueError(f"{name}: payload of {h['x-page-id']} does not fit its digest")
                        rows.append((number(h["x-page-id"]), h.get("warc-target-uri"), int(h["x-payload-length"]) if revisit else len(block), stated, h["warc-type"], number(h.get("x-refers-to-page-id")), name, block if payloads else None))
                        held += len(block) if payloads else 200
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), fields, strict=True)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), fields, strict=True)], names=names)

    files = manifest.select("final")
    # A task for each few files: names spread by their hash, not by how the manifest happens to be stored.
    return files.repartition(max(1, min(2000, manifest.count())), "final").mapInArrow(run, _RECORD)


def roundtrip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write to a fresh place in the shared folder and read back."""
    path = scratch(pages.sparkSession, "warc")
    return read(pages.sparkSession, write(pages, path, least=least), path, payloads=False)
