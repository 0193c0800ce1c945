import hashlib
import math

import numpy as np

from sparkweave.llm import codebooks as c
from sparkweave.llm import queries


def brute(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * v) for v in x], label) for i, x, label in rows if x is not None and len(x) and len(x) % parts == 0 and all(v is not None and math.isfinite(v) for v in x)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(order[0][1])]
    w = len(order[0][1]) // parts
    cut = lambda x, p: x[p * w : (p + 1) * w]
    books = [[cut(x, p) for _, x, _ in order[:entries]] for p in range(parts)]
    apart = lambda a, b: sum((u - v) ** 2 for u, v in zip(a, b, strict=True))
    place = lambda part, book: min(range(len(book)), key=lambda e: (apart(part, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            held = [[] for _ in books[p]]
            for _, x, _ in kept:
                held[place(cut(x, p), books[p])].append(cut(x, p))
            books[p] = [[sum(v) // len(h) for v in zip(*h, strict=True)] if h else old for h, old in zip(held, books[p], strict=True)]
    out = []
    for i, x, label in kept:
        codes = [place(cut(x, p), books[p]) for p in range(parts)]
        out.append([i, "".join(f"{k:02x}" for k in codes), sum(apart(cut(x, p), books[p][k]) for p, k in enumerate(codes)), label])
    total = {label: sum(r[2] for r in out if r[3] == label) for label in {r[3] for r in out}}
    flat = ",".join(str(v) for book in books for entry in book for v in entry)
    return sorted([(i, code, error, total[label]) for i, code, error, label in out], key=repr), hashlib.sha256(flat.encode()).hexdigest()


def frame(spark, rows):
    # Columns that the operator uses inside are there already.
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").selectExpr("*", "1 as id", "2 as x", "'c' as code", "3 as error", "4 as n")


def test_equals_the_definition(spark):
    rng = np.random.default_rng(5)
    far = np.repeat(rng.normal(size=(7, 16)), 60, 0)
    rows = [(i * 3 % 421, [float(np.float32(v)) for v in far[i] + rng.normal(size=16) * 0.05], None if i % 7 == 0 else "hot" if i % 3 == 0 else f"l{i % 11}") for i in range(420)]
    rows += rows[:5] + [(None, rows[9][1], "l1"), (900, None, "l1"), (901, [], "l1"), (902, [None] * 16, "l1"), (903, [math.nan] * 16, "l1"), (904, [math.inf] * 16, "hot"), (905, [0.0] * 16, "hot"), (906, [1.0] * 8, "hot"), (907, [1.0] * 15, "hot")]
    coded, books = c.compress(frame(spark, rows))
    want, digest = brute(rows)
    assert sorted([tuple(r) for r in coded.collect()], key=repr) == want
    assert c.digest(books) == digest and coded.columns == ["vec_id", "code", "error", "label_error"]


def test_rare_and_frequent_labels_meet_their_sums(spark):
    rows = spark.createDataFrame([(str(i) if i % 2 else None, i) for i in range(5000)], "label string, error long")
    got = {(r["label"], r["error"]): r["label_error"] for r in c.with_label_errors(rows).collect()}
    assert len(got) == 5000 and got[None, 0] == sum(range(0, 5000, 2)) and got["7", 7] == 7


def test_ties_few_vectors_and_none(spark):
    rows = [(3, [1.0] * 8, "a"), (1, [1.0] * 8, "a"), (2, [-0.00001] * 8, None)]
    coded, books = c.compress(frame(spark, rows))
    want, digest = brute(rows)
    assert sorted([tuple(r) for r in coded.collect()], key=repr) == want and c.digest(books) == digest
    none, books = c.compress(frame(spark, []))
    assert none.count() == 0 and c.digest(books) == hashlib.sha256(b"").hexdigest()


def test_codes_stand_for_near_vectors(spark):
    rows = [(i, [float(i % 4)] * 16, "a") for i in range(40)]
    coded, books = c.compress(frame(spark, rows))
    for r in coded.collect():
        assert np.abs(c.decode(r["code"], books) - r["vec_id"] % 4).max() < 1e-3 and r["error"] == 0


def test_too_large_components_are_refused():
    try:
        c.integers(np.full((1, 8), 1e30), 4096)
    except ValueError:
        return
    raise AssertionError("accepted")


def test_query_equals_the_definition(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.op11_part_codebooks(spark, sf)
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, digest = brute(rows)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted([tuple(r)[:4] for r in got.collect()], key=repr) == want and {r[4] for r in got.collect()} == {digest}
