"""Graphs in files: edge-list text, JSON, DOT and Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.errors import Invalid
from sparkweave.model import Graph


def read_edge_list(lines: DataFrame) -> Graph:
    """Parse lines (value): a line ``directed`` or ``undirected``, names, or edges with an optional weight.

    ``#`` begins a comment; blank lines are skipped.  A line of more than three
    fields, a weight that is no number, or not exactly one kind is refused.
    """
    clean = lines.select(F.trim(F.regexp_replace(F.col("value"), r"(^|\s)#.*$", "")).alias("v")).where("v <> ''").select(F.split("v", r"\s+").alias("f"))
    kinds = [r[0] for r in clean.where("size(f) = 1 and f[0] in ('directed', 'undirected')").select(F.element_at("f", 1)).limit(2).collect()]
    if len(kinds) != 1:
        raise Invalid("the text must say once whether it is directed or undirected")
    rest = clean.where("not (size(f) = 1 and f[0] in ('directed', 'undirected'))")
    bad = rest.where("size(f) > 3 or (size(f) = 3 and try_cast(f[2] as double) is null)").first()
    if bad is not None:
        raise Invalid(f"no edge or name: {' '.join(bad['f'])}")
    edges = rest.where("size(f) > 1").select(F.expr("f[0]").alias("src"), F.expr("f[1]").alias("dst"), F.when(F.size("f") == 3, F.expr("try_cast(try_element_at(f, 3) as double)")).otherwise(1.0).alias("w"))
    return Graph.of(edges, kinds[0] == "directed", rest.where("size(f) = 1").select(F.expr("f[0]").alias("id")))


def edge_lines(graph: Graph) -> DataFrame:
    """Lines (value) that ``read_edge_list`` reads back; write them with ``.write.text``."""
    spark = graph.spark
    head = spark.createDataFrame([("directed" if graph.directed else "undirected",)], "value string")
    ends = graph.edges.select(F.col("src").alias("id")).union(graph.edges.select("dst"))
    alone = graph.nodes.join(ends.distinct(), "id", "left_anti").select(F.col("id").alias("value"))
    return head.union(alone).union(graph.edges.select(F.concat_ws(" ", "src", "dst", F.col("w").cast("string"))))


def json_lines(graph: Graph) -> DataFrame:
    """One JSON object (value) for each name and edge."""
    nodes = graph.nodes.select(F.to_json(F.struct(F.lit("node").alias("kind"), "id")).alias("value"))
    return nodes.union(graph.edges.select(F.to_json(F.struct(F.lit("edge").alias("kind"), "src", "dst", "w")).alias("value")))


def read_json(lines: DataFrame, directed: bool = False) -> Graph:
    """Read what ``json_lines`` gives; an object of another kind is refused."""
    rows = lines.select(F.from_json("value", "kind string, id string, src string, dst string, w double").alias("r")).select("r.*")
    if not rows.where("kind is null or kind not in ('node', 'edge')").isEmpty():
        raise Invalid("a line is neither a node nor an edge")
    return Graph.of(rows.where("kind = 'edge'"), directed, rows.where("kind = 'node'"))


def dot_lines(graph: Graph, name: str = "graph") -> DataFrame:
    """Lines (value) of a DOT file, in order of a column ``at``."""
    arrow, kind = ("->", "digraph") if graph.directed else ("--", "graph")
    quote = lambda c: F.concat(F.lit('"'), F.regexp_replace(c, '"', '\\\\"'), F.lit('"'))
    spark = graph.spark
    head = spark.createDataFrame([(0, f'{kind} "{name}" {{'), (3, "}")], "at int, value string")
    nodes = graph.nodes.select(F.lit(1).alias("at"), F.concat(F.lit("  "), quote("id"), F.lit(";")).alias("value"))
    edges = graph.edges.select(F.lit(2).alias("at"), F.concat(F.lit("  "), quote("src"), F.lit(f" {arrow} "), quote("dst"), F.lit(" [label="), F.col("w").cast("string"), F.lit("];")).alias("value"))
    return head.union(nodes).union(edges)


def save(graph: Graph, path: str) -> None:
    """Parquet: ``nodes``, ``edges`` and a one-row ``kind``; the only lossless form for any name."""
    graph.nodes.write.parquet(f"{path}/nodes")
    graph.edges.write.parquet(f"{path}/edges")
    graph.spark.createDataFrame([(graph.directed,)], "directed boolean").write.parquet(f"{path}/kind")


def load(spark: SparkSession, path: str) -> Graph:
    directed = spark.read.parquet(f"{path}/kind").first()["directed"]
    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"), directed)
