"""Graph files: edge lists, Matrix Market, GML, GraphML. All text is read by Spark."""

from __future__ import annotations

import os
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Graph, build
from ..plans.iterate import cut, ranked

EXTENSIONS = {".mtx": "mtx", ".gml": "gml", ".graphml": "graphml", ".csv": "edges", ".tsv": "edges", ".edges": "edges", ".edge": "edges", ".el": "edges", ".txt": "edges"}
#: Changes of direction that one edge list may announce.
MOST_HINTS = 1000


def read_graph(spark: SparkSession, path: str) -> Graph:
    """Reads ``path`` as its extension says."""
    kind = EXTENSIONS.get(os.path.splitext(path)[1].lower())
    if kind is None:
        raise NotImplementedError(f"unknown graph format: {path}")
    graph = {"mtx": read_matrix_market, "gml": read_gml, "graphml": read_graphml, "edges": read_edge_list}[kind](spark, path)
    graph.title = os.path.splitext(os.path.basename(path))[0]
    return graph


def find_graph_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, extension of the readable files below ``folder``, by extension and path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    ext = F.lower(F.concat(F.lit("."), F.element_at(F.split("path", r"\."), -1)))
    return files.withColumn("extension", ext).where(F.col("extension").isin(*EXTENSIONS)).orderBy("extension", "path")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """line, text of one file. A line's number is its block's first byte and its place in the block:
    it grows along the file, as no line is shorter than a byte."""
    text = spark.read.text(path)
    if len(text.inputFiles()) > 1:
        raise ValueError(f"{path}: a graph is read from one file")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return text.select((F.col("_metadata.file_block_start") + place).alias("line"), F.trim(F.regexp_replace("value", r"\r$", "")).alias("text"))


def read_edge_list(spark: SparkSession, path: str) -> Graph:
    """Fields split at blanks, tabs, commas and semicolons; two names and maybe a weight (1
    without, 0 if it isn't a number). Ids by first appearance. Comments (#, %, //) that say
    directed or undirected hold for the edges below; the last one for the graph."""
    lines = _lines(spark, path)
    comment = F.col("text").rlike(r"^(#|%|//)")
    says = F.lower("text")
    hint = F.when(says.contains("undirected"), False).when(says.contains("directed"), True)
    hints = [(r["line"], r["h"]) for r in lines.where(comment).select("line", hint.alias("h")).where("h is not null").orderBy("line").limit(MOST_HINTS + 1).collect()]
    if len(hints) > MOST_HINTS:
        raise ValueError(f"{path}: over {MOST_HINTS} comments on direction")
    fields = F.filter(F.split("text", r"[ \t,;]+"), lambda x: x != "")
    rows = lines.where(~comment & (F.col("text") != "")).select("line", fields.alias("f")).where(F.size("f") >= 2)
    weight = F.when(F.size("f") > 2, F.coalesce(F.expr("try_cast(f[2] as double)"), F.lit(0.0))).otherwise(1.0)
    directed = F.lit(False)
    for line, flag in hints:
        directed = F.when(F.col("line") > line, F.lit(flag)).otherwise(directed)
    rows = cut(rows.select("line", F.col("f")[0].alias("a"), F.col("f")[1].alias("b"), weight.alias("weight"), directed.alias("directed")))
    names = rows.select(F.col("a").alias("label"), (F.col("line") * 2).alias("at")).unionAll(rows.select("b", F.col("line") * 2 + 1)).groupBy("label").agg(F.min("at").alias("at"))
    nodes = cut(ranked(names, "at", name="id").select("id", "label"))
    one, two = (nodes.select(F.col("id").alias(i), F.col("label").alias(n)) for i, n in (("src", "a"), ("dst", "b")))
    e = rows.join(one, "a").join(two, "b").select("src", "dst", "weight", F.col("line").alias("eid"), "directed").where("src <> dst")
    swap = ~F.col("directed") & (F.col("src") > F.col("dst"))
    e = e.select(F.when(swap, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(swap, F.col("src")).otherwise(F.col("dst")).alias("dst"), "weight", "eid")
    e = e.groupBy("src", "dst").agg(F.min_by("weight", "eid").alias("weight"), F.min("eid").alias("eid"))
    return Graph(nodes, e.select("eid", "src", "dst", "weight"), bool(hints and hints[-1][1]))


def read_matrix_market(spark: SparkSession, path: str) -> Graph:
    """Coordinate files; ``symmetric`` is undirected, all else directed; ids from 0; nodes
    without edges stay."""
    lines = _lines(spark, path)
    banner = lines.orderBy("line").limit(1).collect()
    parts = banner[0]["text"].lower().split() if banner else []
    if len(parts) < 5 or parts[0] != "%%matrixmarket":
        raise ValueError(f"{path}: no Matrix Market banner")
    if parts[2] != "coordinate":
        raise ValueError(f"{path}: only coordinate files hold a graph, this is {parts[2]}")
    body = lines.where(~F.col("text").startswith("%") & (F.col("text") != ""))
    head = body.orderBy("line").first()
    rows, columns, entries = (int(x) for x in head["text"].split()[:3])
    f = F.split("text", r"\s+")
    weight = F.lit(1.0) if parts[3] == "pattern" else F.coalesce(F.expr(r"try_cast(split(text, '\\s+')[2] as double)"), F.lit(1.0))
    cells = body.where(F.col("line") > head["line"])
    if cells.count() > entries:
        cells = ranked(cells, "line").where(F.col("rank") < entries)
    e = cells.select((f[0].cast("long") - 1).alias("src"), (f[1].cast("long") - 1).alias("dst"), weight.alias("weight"), F.col("line").alias("eid"))
    return build(e, parts[4] != "symmetric", spark.range(max(rows, columns)).select("id", F.col("id").cast("string").alias("label")))


GML_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|#[^\n]*|[\[\]]|[^\s\[\]"#]+')


def _gml_tree(tokens: list[str], at: int = 0) -> tuple[list, int]:
    """(key, value or block) pairs up to the closing bracket."""
    out = []
    while at < len(tokens) and tokens[at] != "]":
        key = tokens[at].lower()
        if at + 1 < len(tokens) and tokens[at + 1] == "[":
            inside, at = _gml_tree(tokens, at + 2)
            out.append((key, inside))
            at += 1
        else:
            out.append((key, tokens[at + 1] if at + 1 < len(tokens) else ""))
            at += 2
    return out, at


def parse_gml(text: str) -> tuple[bool, list, list]:
    """directed, nodes (id, label), edges (source, target, weight) of the first graph."""
    plain = lambda x: x[1:-1].replace('\\"', '"') if x[:1] == '"' else x
    number = lambda x, kind, other: kind(x) if re.fullmatch(r"[+-]?\d+(\.\d*)?([eE][+-]?\d+)?", x) else other
    tree, _ = _gml_tree([t for t in GML_TOKEN.findall(text) if t[0] != "#"])
    graph = next((v for k, v in tree if k == "graph" and isinstance(v, list)), [])
    nodes, edges, directed = {}, [], False
    for key, block in graph:
        if key == "directed":
            directed = plain(block) == "1"
        elif isinstance(block, list):
            values = {k: plain(v) for k, v in block if not isinstance(v, list)}
            if key == "node":
                nodes[values.get("id", "")] = values.get("label") or values.get("id", "")
            elif key == "edge":
                w = values.get("weight", values.get("value"))
                edges.append((values.get("source"), values.get("target"), 1.0 if w is None else number(w, float, 0.0)))
    return directed, list(nodes.items()), edges


def read_gml(spark: SparkSession, path: str) -> Graph:
    """The first graph of each file; nested blocks are skipped, edges to unknown ids dropped."""

    def rows(frames):
        for frame in frames:
            for text in frame["value"]:
                directed, nodes, edges = parse_gml(text)
                out = [("graph", i, str(directed), None, None) for i in (0,)]
                out += [("node", i, a, b, None) for i, (a, b) in enumerate(nodes)]
                out += [("edge", i, a, b, w) for i, (a, b, w) in enumerate(edges)]
                yield pd.DataFrame(out, columns=["kind", "at", "a", "b", "weight"])

    parsed = cut(spark.read.text(path, wholetext=True).mapInPandas(rows, "kind string, at long, a string, b string, weight double"))
    nodes = parsed.where("kind = 'node'").select(F.col("at").alias("id"), F.col("b").alias("label"), F.col("a").alias("key"))
    directed = any(r["a"] == "True" for r in parsed.where("kind = 'graph'").collect())
    return _keyed(nodes, parsed.where("kind = 'edge'").select("a", "b", "weight", F.col("at").alias("eid")), directed)


def _keyed(nodes: DataFrame, edges: DataFrame, directed: bool) -> Graph:
    """A graph of nodes (id, label, key) and edges between keys (a, b); others are dropped."""
    one, two = (nodes.select(F.col("id").alias(i), F.col("key").alias(n)) for i, n in (("src", "a"), ("dst", "b")))
    return build(edges.join(one, "a").join(two, "b").select("src", "dst", "weight", "eid"), directed, nodes.select("id", "label"))


def read_graphml(spark: SparkSession, path: str) -> Graph:
    """The file's first graph. The first node key named label or name gives labels, the first edge key named weight or
    value weights; edges to unknown ids are dropped. An edge's own ``directed`` decides how it is de-duplicated."""

    def tags(tag: str, schema: str) -> DataFrame:
        return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path).withColumn("at", F.monotonically_increasing_id())

    data = "data array<struct<_key:string,_VALUE:string>>"
    keys = tags("key", "_id string, `_for` string, `_attr.name` string")

    def key(kind: str, names: tuple) -> str | None:
        found = keys.where(F.col("_for").isin(kind, "all") & F.lower("`_attr.name`").isin(*names)).orderBy("at").limit(1).collect()
        return found[0]["_id"] if found else None

    def datum(name: str | None):
        return F.get(F.filter("data", lambda d: d["_key"] == F.lit(name)), F.lit(0))["_VALUE"]

    node_kind, edge_kind = f"_id string, _label string, {data}", f"_source string, _target string, _directed string, {data}"
    graphs = tags("graph", "_edgedefault string").orderBy("at").limit(2).collect()
    if not graphs:
        raise ValueError(f"{path}: no graph in it")
    directed = graphs[0]["_edgedefault"] == "directed"
    if len(graphs) == 1:
        found, linked = tags("node", node_kind), tags("edge", edge_kind)
    else:  # the first graph is read as one row, as its nodes and edges must be told from the others'
        struct = lambda kind: "array<struct<" + kind.replace(" string", ":string").replace("data array", "data:array") + ">>"
        first = tags("graph", f"node {struct(node_kind)}, edge {struct(edge_kind)}").orderBy("at").limit(1)
        found, linked = (first.select(F.posexplode(c).alias("at", "n")).select(F.col("at").cast("long").alias("at"), "n.*") for c in ("node", "edge"))
    if found.groupBy("_id").count().where("count > 1").limit(1).count():
        raise ValueError(f"{path}: a node id is repeated")
    label = F.coalesce("_label", datum(key("node", ("label", "name"))), "_id")
    nodes = cut(ranked(found.select("at", F.col("_id").alias("key"), F.trim(label).alias("label")), "at", name="id"))
    w = datum(key("edge", ("weight", "value")))
    weight = F.when(w.isNull(), 1.0).otherwise(F.coalesce(F.expr("try_cast(w as double)"), F.lit(0.0)))
    edges = linked.withColumn("w", w)
    own = F.when(F.col("_directed").isNull(), F.lit(directed)).otherwise(F.lower("_directed") == "true")
    edges = edges.select(F.col("_source").alias("a"), F.col("_target").alias("b"), weight.alias("weight"), F.col("at").alias("eid"), own.alias("own"))
    one, two = (nodes.select(F.col("id").alias(i), F.col("key").alias(n)) for i, n in (("src", "a"), ("dst", "b")))
    e = edges.join(one, "a").join(two, "b").where("src <> dst")
    swap = ~F.col("own") & (F.col("src") > F.col("dst"))
    e = e.select(F.when(swap, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(swap, F.col("src")).otherwise(F.col("dst")).alias("dst"), "weight", "eid")
    e = e.groupBy("src", "dst").agg(F.min_by("weight", "eid").alias("weight"), F.min("eid").alias("eid"))
    return Graph(nodes.select("id", "label"), e.select("eid", "src", "dst", "weight"), directed)


def with_labels(graph: Graph, path: str) -> Graph:
    """``graph`` with the labels of a text file, one a line in the order of the ids; vertices beyond keep theirs."""
    names = ranked(_lines(graph.vertices.sparkSession, path).withColumnRenamed("text", "name"), "line", name="id").select("id", "name")
    others = [c for c in graph.vertices.columns if c not in ("id", "label")]
    return Graph(graph.vertices.join(names, "id", "left").select("id", F.coalesce("name", "label").alias("label"), *others), graph.edges, graph.directed, graph.title)


def write_edges(graph: Graph, path: str, kind: str = "parquet") -> None:
    """The edges as a table, one folder."""
    graph.edges.write.format(kind).mode("error").save(path)


__all__ = ["EXTENSIONS", "find_graph_files", "parse_gml", "read_edge_list", "read_gml", "read_graph", "read_graphml", "read_matrix_market", "with_labels", "write_edges"]
