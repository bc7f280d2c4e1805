"""Graphs as vertex and edge DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Graph:
    """``vertices``: id, label, and what has been added. ``edges``: eid, src, dst, weight;
    no self-loops, no repeated pairs. Parameters of a graph are never changed."""

    vertices: DataFrame
    edges: DataFrame
    directed: bool = False
    title: str = ""
    extra: dict = field(default_factory=dict)

    @property
    def adj(self) -> DataFrame:
        """id, nbr, weight, eid: every edge from both ends. A mutual pair of a directed graph
        makes two entries at each end."""
        e = self.edges
        return e.select(F.col("src").alias("id"), F.col("dst").alias("nbr"), "weight", "eid").unionAll(e.select(F.col("dst").alias("id"), F.col("src").alias("nbr"), "weight", "eid"))

    @cached_property
    def size(self) -> int:
        return self.vertices.count()

    @cached_property
    def n_edges(self) -> int:
        return self.edges.count()

    def cached(self) -> Graph:
        return Graph(self.vertices.cache(), self.edges.cache(), self.directed, self.title, self.extra)

    def memory_bytes(self) -> int:
        """Size of the flat arrays that such a graph would fill."""
        n, m = self.size, self.n_edges
        return 24 * n + 16 * m + 4 * (n + 1) + 12 * 2 * m


def canonical(edges: DataFrame, directed: bool) -> DataFrame:
    """eid, src, dst, weight without self-loops and repeats; of repeats the first's weight
    counts. ``edges`` has src, dst, weight, eid; pairs of undirected graphs become (least, greatest)."""
    e = edges.where("src <> dst")
    if not directed:
        e = e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight", "eid")
    return e.groupBy("src", "dst").agg(F.min_by("weight", "eid").alias("weight"), F.min("eid").alias("eid")).select("eid", "src", "dst", "weight")


def ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).unionAll(edges.select(F.col("dst").alias("id"))).distinct()


def build(edges: DataFrame, directed: bool, vertices: DataFrame | None = None, title: str = "") -> Graph:
    """A graph of ``edges`` (src, dst, optionally weight and eid). Without ``vertices`` (id,
    optionally label), these are the edges' ends, also of self-loops."""
    if "weight" not in edges.columns:
        edges = edges.withColumn("weight", F.lit(1.0))
    if "eid" not in edges.columns:
        edges = edges.withColumn("eid", F.xxhash64("src", "dst"))
    if vertices is None:
        vertices = ends(edges)
    if "label" not in vertices.columns:
        vertices = vertices.withColumn("label", F.col("id").cast("string"))
    return Graph(vertices, canonical(edges.withColumn("weight", F.col("weight").cast("double")), directed), directed, title)


def induced(graph: Graph, members: DataFrame) -> Graph:
    """The subgraph between ``members`` (id). Parallel edges collapse to the first weight."""
    keep = members.select("id").distinct()
    e = graph.edges.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return Graph(graph.vertices.join(keep, "id", "left_semi"), canonical(e, False), False, graph.title)


def on_known(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """``edges`` with both ends among ``vertices``."""
    v = vertices.select("id")
    return edges.join(v.withColumnRenamed("id", "src"), "src", "left_semi").join(v.withColumnRenamed("id", "dst"), "dst", "left_semi")
