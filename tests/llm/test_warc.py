import base64
import hashlib
from pathlib import Path

from sparkweave.llm import warc

PAGES = [(1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (3, None, None), (4, "http://a/4", ""), (5, "http://a/5\r\nX: y", "é" * 5000), (9, "http://a/9", "<p>one</p>"), (9, "http://a/9", "<p>one</p>"), (None, "http://n", "<p>one</p>"), (7, "u", "WARC/1.1\r\n\r\n")]


def made(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as shard", "2 as sha")


def expected(rows, least=0):
    resp = {}
    for p, _, h in rows:
        resp[h or ""] = max(resp.get(h or "", -1), -1 if p is None else p)
    out, heads = [], set()
    for p, _, h in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (h or "").encode()
        first = p == resp[h or ""] and (p, h or "") not in heads
        heads.add((p, h or ""))
        single = sum((x[2] or "") == (h or "") for x in rows) == 1 or len(data) < least
        response = single or first
        out.append((p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else resp[h or ""]))
    return sorted(out, key=str)


def test_round_trip(spark):
    got = [tuple(r) for r in warc.roundtrip(made(spark, PAGES)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=str) == expected(PAGES)


def test_least_size_of_revisits(spark):
    got = [tuple(r) for r in warc.roundtrip(made(spark, PAGES), least=100).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=str) == expected(PAGES, 100)


def test_same_files_every_time_and_payloads_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SHARD", 3000)
    rows = [(i, f"http://x/{i}", f"<p>{i}</p>" * 50) for i in range(40)]
    sums = []
    for name, parts in (("a", 1), ("b", 3)):
        path = str(tmp_path / name)
        manifest = warc.write(made(spark, rows).repartition(parts), path)
        files = sorted(Path(path).glob("*.warc.gz"))
        sums.append([(f.name, hashlib.sha256(f.read_bytes()).hexdigest()) for f in files])
        assert len(files) > 1 and sorted((Path(r["final"]).name, r["sha256"]) for r in manifest.collect()) == sums[-1]
        assert not list(Path(path).glob("_temporary*"))
        back = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read(spark, manifest, path).collect()}
        assert back == {i: h for i, _, h in rows}
    assert sums[0] == sums[1]


def test_empty_table(spark):
    assert warc.roundtrip(made(spark, [])).count() == 0


def test_ids_far_apart_and_one_hot_id_are_cut_into_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SHARD", 20_000)
    rows = [(i, None, f"<p>{i}</p>" * 100) for i in range(30)] + [(2**62, None, "far"), (-(2**63) + 1, None, "low"), (2**63 - 1, None, "top"), (None, None, "none")]
    rows += [(12, f"u{i}", f"<q>{i}</q>" * 200) for i in range(40)]
    path = str(tmp_path / "w")
    manifest = warc.write(made(spark, rows), path)
    shards = manifest.groupBy("shard").sum("records").collect()
    assert len(shards) >= 5 and max(r[1] for r in shards) <= 30
    got = [tuple(r) for r in warc.read(spark, manifest, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=str) == expected(rows)


def test_a_shard_rolls_by_compressed_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ROLL", 2000)
    rows = [(i, f"http://x/{i}", hashlib.sha256(str(i).encode()).hexdigest() * 10) for i in range(60)]
    manifest = warc.write(made(spark, rows), str(tmp_path / "r")).orderBy("roll").collect()
    assert {r["shard"] for r in manifest} == {0} and [r["roll"] for r in manifest] == list(range(len(manifest))) and len(manifest) > 3
    assert all(r["bytes"] >= 2000 for r in manifest[:-1]) and sum(r["records"] for r in manifest) == 60


def test_bounds_are_looked_up_in_order(spark):
    bounds = [(i * 10, "m") for i in range(23)]
    rows = [(p, x) for p in range(-5, 260, 5) for x in ("a", "m", "z")]
    got = spark.createDataFrame(rows, "place long, sha string").select("place", "sha", warc._shard(bounds).alias("shard")).collect()
    assert all(r["shard"] == sum(b <= (r["place"], r["sha"]) for b in bounds) for r in got)
