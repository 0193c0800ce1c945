"""Graphs of tables: plans for Spark against their text, also with null keys, and that brief graphs are derived once."""

import shutil

import pytest
from pyspark.sql import functions as F

from sparkweave.model import Graph
from sparkweave.operators import search
from sparkweave.plans.searches import _regions
from sparkweave.sources.tables import MARKETS, PURCHASES, TRADE, TRADE_DAG, TRADE_TIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def holed(spark, tmp_path_factory):
    """The small tables, some keys of lines and orders being null."""
    folder = tmp_path_factory.mktemp("holed")
    for t in ("customer", "supplier", "nation", "region"):
        shutil.copy(f"{SF}/{t}.parquet", folder)
    for t, keys in (("lineitem", ("l_orderkey", "l_suppkey")), ("orders", ("o_orderkey", "o_custkey"))):
        rows = spark.read.parquet(f"{SF}/{t}.parquet")
        rows = rows.select(*[F.when(F.xxhash64(F.lit(k), *rows.columns) % 7 != 0, F.col(k)).alias(k) if k in keys else F.col(k) for k in rows.columns])
        rows.write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


@pytest.mark.parametrize("source", [TRADE, TRADE_TIES, TRADE_DAG, MARKETS, PURCHASES])
def test_plan_gives_the_rows_of_the_text(spark, holed, source):
    frames = {t: spark.read.parquet(f"{holed}/{t}.parquet") for t in source.tables}
    want = Graph.of(spark.sql(source.text, **frames), source.directed)
    got = source.graph(spark, holed)
    for a, b in ((got.edges, want.edges), (got.nodes, want.nodes)):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("source", [TRADE, TRADE_TIES, TRADE_DAG, MARKETS])
def test_brief_graphs_are_read_from_what_was_written(spark, source):
    graph = source.graph(spark, SF)
    assert graph.stored and not any(SF in f for f in graph.edges.inputFiles() + graph.nodes.inputFiles())


def test_isomorphism_reads_written_graphs(spark, monkeypatch):
    seen = []
    need = Graph.need
    monkeypatch.setattr(Graph, "need", lambda graph, **given: seen.append(graph.stored) or need(graph, **given))
    regions = _regions(spark, SF)
    assert search.isomorphic(regions, regions) and seen == [True]
    assert not search.isomorphic(regions, Graph.rows(spark, [], nodes=[r["id"] for r in regions.nodes.collect()]))
