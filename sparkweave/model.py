"""Graphs as two DataFrames, and operators declared as one SQL text over them."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.errors import Invalid, Missing
from sparkweave.session import materialise


class Graph:
    """``nodes(id)`` and ``edges(src, dst, w)``; undirected edges are stored once, smaller name first.

    Names are strings and order as strings.  Repeated edges keep their largest
    weight.  Rows with a null end are refused by ``check``, not dropped.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, directed: bool = False, stored: bool = False, ends_only: bool = False) -> None:
        self.nodes, self.edges, self.directed, self.stored, self.ends_only = nodes, edges, directed, stored, ends_only

    @classmethod
    def of(cls, edges: DataFrame, directed: bool = False, nodes: DataFrame | None = None, once: bool = False) -> Graph:
        """A graph of rows (src, dst[, w]); ``nodes`` adds isolated names, ``once`` says that no pair of ends comes twice."""
        src, dst = F.col("src").cast("string"), F.col("dst").cast("string")
        w = F.col("w").cast("double") if "w" in edges.columns else F.lit(1.0)
        ends = [src, dst] if directed else [F.least(src, dst), F.greatest(src, dst)]
        rows = edges.select(ends[0].alias("src"), ends[1].alias("dst"), w.alias("w"))
        rows = rows if once else rows.groupBy("src", "dst").agg(F.max("w").alias("w"))
        named = rows.select(F.col("src").alias("id")).union(rows.select("dst"))
        if nodes is not None:
            named = named.union(nodes.select(F.col("id").cast("string")))
        return cls(named.distinct(), rows, directed, ends_only=nodes is None)

    @classmethod
    def rows(cls, spark: SparkSession, edges: list[tuple], directed: bool = False, nodes: list[str] | None = None) -> Graph:
        """A small graph from literal rows."""
        full = [(*e, 1.0)[:3] for e in edges]
        made = spark.createDataFrame([(str(a), str(b), float(w)) for a, b, w in full], "src string, dst string, w double")
        extra = spark.createDataFrame([(n,) for n in nodes or []], "id string")
        return cls.of(made, directed, extra)

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    @property
    def arcs(self) -> DataFrame:
        """Both directions of undirected edges; a loop once."""
        if self.directed:
            return self.edges
        return self.edges.union(self.edges.where("src <> dst").select("dst", "src", "w"))

    @property
    def reverse(self) -> Graph:
        return Graph(self.nodes, self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"), self.directed, self.stored)

    @property
    def shadow(self) -> Graph:
        """The graph without directions."""
        return Graph.of(self.edges, False, self.nodes) if self.directed else self

    def induced(self, kept: DataFrame) -> Graph:
        """The part on the nodes of ``kept(id)``."""
        ids = kept.select("id").distinct()
        inside = self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return Graph(self.nodes.join(ids, "id", "left_semi"), inside.select("src", "dst", "w"), self.directed)

    def without(self, gone: DataFrame) -> Graph:
        """The graph without the nodes of ``gone(id)``."""
        return self.induced(self.nodes.join(gone.select("id"), "id", "left_anti"))

    def need(self, *, directed: bool | None = None, nodes: tuple[str, ...] = (), least: int = 0, most: int | None = None) -> Graph:
        """Refuse what an operator is not defined on."""
        if directed is not None and directed != self.directed:
            raise Invalid("this operator needs " + ("a directed" if directed else "an undirected") + " graph")
        if least or most is not None:
            n = self.nodes.count()
            if n < least:
                raise Invalid(f"this operator needs at least {least} nodes; the graph has {n}")
            if most is not None and n > most:
                raise Invalid(f"this operator is exact and stops at {most} nodes; the graph has {n}")
        if nodes:
            here = {r["id"] for r in self.nodes.where(F.col("id").isin(list(nodes))).collect()}
            for name in nodes:
                if name not in here:
                    raise Missing(f"'{name}' is not a node of the graph")
        return self

    def written(self) -> Graph:
        """The graph as two written tables, so that the rounds of a loop do not derive it from its sources again."""
        if self.stored:
            return self
        edges = materialise(self.edges, "edges")
        nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct() if self.ends_only else self.nodes
        return Graph(materialise(nodes, "nodes"), edges, self.directed, True)

    def frames(self) -> dict[str, DataFrame]:
        return {"nodes": self.nodes, "edges": self.edges, "arcs": self.arcs}


@dataclass(frozen=True)
class Declared:
    """An operator that is one declarative plan over ``nodes``, ``edges`` and ``arcs``.

    ``directed`` restricts the graphs that it takes; ``most`` and ``most_edges``
    are the caps of an exact enumeration, beyond which it refuses.
    """

    text: str
    directed: bool | None = None
    most: int | None = None
    most_edges: int | None = None

    def __call__(self, graph: Graph, **values: Any) -> DataFrame:
        graph.need(directed=self.directed, most=self.most)
        if self.most_edges is not None and graph.edges.count() > self.most_edges:
            raise Invalid(f"this operator is exact and stops at {self.most_edges} edges")
        frames = graph.frames()
        used = {k: v for k, v in frames.items() if "{" + k + "}" in self.text}
        return graph.spark.sql(self.text, **used, **values)

    def sql(self, **values: Any) -> str:
        """The same plan as plain SQL over tables of those names."""
        plain = {k: (f"'{v}'" if isinstance(v, str) else v) for k, v in values.items()}
        return self.text.format(nodes="nodes", edges="edges", arcs="arcs", **plain)


@dataclass(frozen=True)
class Plan:
    """An operator over other tables than a graph's."""

    text: str

    def __call__(self, spark: SparkSession, **frames: Any) -> DataFrame:
        return spark.sql(self.text, **frames)

    def sql(self, **values: Any) -> str:
        return self.text.format(**values)
