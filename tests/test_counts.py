"""Counts of pairs that are never made, against brute force."""

import random

import pytest

from sparkweave.model import Graph
from sparkweave.operators import paths, ranking
from sparkweave.operators import transforms as t
from sparkweave.operators.communities import louvain
from sparkweave.session import materialise


def test_interval_degrees(spark):
    rng = random.Random(5)
    rows = [(f"i{k}", float(lo := rng.randint(0, 90)), float(lo + rng.randint(0, 9))) for k in range(150)] + [("alone", 500.0, 600.0), (None, 1.0, 2.0)]
    named = rows[:-1]
    want = {n: k for n, lo, hi in named if (k := sum(m != n and lo <= h and l <= hi for m, l, h in named))}
    got = t.interval_degrees(spark.createDataFrame(rows, "name string, lo double, hi double"))
    assert {r["id"]: r["degree"] for r in got.collect()} == want and "alone" not in want


def test_interval_degrees_of_many_that_all_overlap(spark):
    rows = spark.range(300_000).selectExpr("CAST(id AS STRING) AS name", "CAST(id AS DOUBLE) AS lo", "1e6 AS hi")
    assert [r["degree"] for r in t.interval_degrees(rows).select("degree").distinct().collect()] == [299_999]


@pytest.mark.parametrize("block", [4, 64, 1 << 14])
def test_inversions(spark, monkeypatch, block):
    monkeypatch.setattr(t, "BLOCK", block)
    rng = random.Random(block)
    values = [rng.randint(0, 120) for _ in range(200)]
    want = sum(values[i] > values[j] for i in range(200) for j in range(i + 1, 200))
    rows = [(3 * i, v) for i, v in enumerate(values)] + [(None, 1), (7, None)]
    rng.shuffle(rows)
    assert t.inversion_count(spark.createDataFrame(rows, "pos long, value long")).collect() == [(want,)]


def test_inversions_of_many_rows(spark):
    rows = spark.range(500_000).selectExpr("id AS pos", "-id AS value")
    assert t.inversion_count(rows).first()[0] == 500_000 * 499_999 // 2
    assert t.inversion_count(rows.limit(0)).first()[0] == 0


def random_arcs(nodes, m, seed):
    rng = random.Random(seed)
    return sorted({(f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}") for _ in range(m)})


def test_hop_sums_write_no_pairs(spark, monkeypatch):
    arcs = random_arcs(150, 300, 2)
    graph = Graph.rows(spark, arcs, True, ["lone"])
    ids = [r["id"] for r in graph.nodes.collect()]
    want = {}
    for o in ids:
        hops, front = {o: 0}, [o]
        while front:
            front = [b for b in {b for a, b in arcs if a in front} if b not in hops]
            hops |= dict.fromkeys(front, max(hops.values()) + 1)
        far = [h for h in hops.values() if h]
        want[o] = (round(len(far) / (len(ids) - 1) * len(far) / sum(far), 6) if far else 0.0, round(sum(1 / h for h in far) / (len(ids) - 1), 6))
    monkeypatch.setattr(paths, "all_pairs", None)
    got = {r["id"]: (r["closeness"], r["harmonic"]) for r in paths.distance_centrality(graph).collect()}
    assert got.keys() == want.keys() and all(got[o] == pytest.approx(want[o], abs=2e-6) for o in ids)
    assert {r["closeness"] for r in paths.distance_centrality(Graph.rows(spark, [], True, ["a", "b"])).collect()} == {0.0}


def test_walks_are_added_up_as_numbers(spark, monkeypatch):
    arcs, kinds = random_arcs(30, 150, 3), []
    monkeypatch.setattr(ranking, "materialise", lambda df, name: kinds.append((name, dict(df.dtypes))) or materialise(df, name))
    want = {}
    for a, b in arcs:
        for c in (d for x, d in arcs if x == b):
            for e in (d for x, d in arcs if x == c):
                want[a, e] = want.get((a, e), 0) + 1
    got = ranking.walk_counts(Graph.rows(spark, arcs, True), 3)
    assert {(r["src"], r["dst"]): r["walks"] for r in got.collect()} == want
    assert all(kind == {"a": "bigint", "b": "bigint", "walks": "bigint"} for name, kind in kinds if name == "walks")
    # Too many for a long sum on the way are summed as decimals.
    eight = Graph.rows(spark, [(a, b) for a in "abcdefgh" for b in "abcdefgh"], True)
    assert {r["walks"] for r in ranking.walk_counts(eight, 21).collect()} == {2**60}


def test_small_weights_count_beside_large_ones(spark):
    got = louvain(Graph.rows(spark, [("a", "b", 1.0), ("x", "y", 1e13)]))
    assert {r["id"]: r["community"] for r in got.collect()} == {"a": "a", "b": "a", "x": "x", "y": "x"}
