"""Registered graph queries against their SQL in DuckDB, and small graphs with known answers."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
from sparkweave.errors import Invalid, Missing
from sparkweave.model import Graph
from sparkweave.operators import paths, search, structure
from sparkweave.plans import catalogue
from sparkweave.sources import files

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: A query of each module; the driver compares all of them.
COMPARED = ["graph_degrees", "triangles_clustering", "transitiveclosure_pairs", "katz_users", "weaklyconnected_turns", "stoerwagner_cut", "graphdiff_counts", "eventlog_replay", "factories_grid", "lca_pairs"]


def _plain(rows):
    return sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", COMPARED)
def test_same_rows_as_the_sql(spark, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = con.execute(catalogue.oracle_sql()[name])
    at = [d[0] for d in got.description]
    assert sorted(at) == columns
    order = [at.index(c) for c in columns]
    assert _plain(df.select(*columns).collect()) == _plain([tuple(r[i] for i in order) for r in got.fetchall()])


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_complete_graph_has_every_triangle(spark):
    k5 = Graph.rows(spark, [(i, j) for i in range(5) for j in range(i)])
    row = structure.clustering(k5).first()
    assert (row["triangles"], row["transitivity"], row["density"]) == (10, 1.0, 1.0)


def test_triangle_has_six_colourings_with_three_colours(spark):
    triangle = Graph.rows(spark, [("a", "b"), ("b", "c"), ("a", "c")])
    assert search.colourings(triangle, 3).first()[0] == 6
    assert search.colourings(triangle, 2).first()[0] == 0


def test_refusals(spark):
    line = Graph.rows(spark, [("a", "b"), ("b", "c")])
    with pytest.raises(Missing):
        line.need(nodes=("z",))
    with pytest.raises(Invalid):
        line.need(directed=True)
    with pytest.raises(Invalid):
        search.hamiltonian(line, most=2)
    with pytest.raises(Invalid):
        files.read_edge_list(spark.createDataFrame([("a b 1",)], "value string"))


def test_edge_list_round_trip(spark):
    graph = Graph.rows(spark, [("a", "b", 2.5), ("b", "c")], True, ["lonely"])
    back = files.read_edge_list(files.edge_lines(graph))
    assert back.directed
    assert sorted(map(tuple, back.edges.select("src", "dst", "w").collect())) == [("a", "b", 2.5), ("b", "c", 1.0)]
    assert sorted(r["id"] for r in back.nodes.collect()) == ["a", "b", "c", "lonely"]


def test_yen_keeps_long_routes_and_refuses_too_many(spark):
    line = [(f"n{i}", f"n{i + 1}", 1.0) for i in range(11)]
    graph = Graph.of(spark.createDataFrame([*line, ("n0", "n11", 20.0), ("n0", "n5", 9.0)], "src string, dst string, w double"), True)
    got = sorted((r["rank"], len(r["path"]), r["cost"]) for r in paths.yen(graph, "n0", "n11", 2).collect())
    assert got == [(1, 12, 11.0), (2, 8, 15.0)]
    assert [r["cost"] for r in paths.yen(graph, "n0", "n11", 5).orderBy("rank").collect()] == [11.0, 15.0, 20.0]
    with pytest.raises(Invalid):
        paths.yen(graph, "n0", "n11", 2, most=1)
