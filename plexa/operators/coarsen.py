"""Matching, contraction and hierarchies."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Graph
from ..plans.iterate import cut, ranked


#: Edges up to which a matching is made on the driver, which saves many small jobs.
SMALL = 50_000


class Strategy(Enum):
    RANDOM = "random"
    HEM = "hem"
    HEMSR = "hemsr"
    HEMSRDEG = "hemsrdeg"


def match(graph: Graph, strategy: Strategy = Strategy.HEM, seed: int = 42, threshold: float = 2.0) -> DataFrame:
    """id, partner (itself if alone): a maximal matching.

    In rounds, every free vertex points at its best free neighbour (heaviest edge, or by
    chance for RANDOM; ties by a hash that both ends agree on); mutual choices match. HEMSR
    then pairs free vertices that share a heaviest matched neighbour; HEMSRDEG only across
    neighbours of at least ``threshold`` times the mean degree."""
    a, b = F.least("id", "nbr"), F.greatest("id", "nbr")
    chance = F.xxhash64(a, b, F.lit(seed))
    weight = F.lit(0.0) if strategy is Strategy.RANDOM else F.col("weight")
    near = cut(graph.adj.where("id <> nbr").withColumn("key", F.struct(weight.alias("w"), chance.alias("h"), a.alias("a"), b.alias("b"))).groupBy("id", "nbr").agg(F.max("key").alias("key"), F.max("weight").alias("weight")))
    left, done = near, None
    if graph.n_edges <= SMALL:  # the rounds' result is that of taking the best edges first
        mate: dict[int, int] = {}
        for r in near.where("id < nbr").orderBy(F.desc("key")).select("id", "nbr").collect():
            if r["id"] not in mate and r["nbr"] not in mate:
                mate[r["id"]], mate[r["nbr"]] = r["nbr"], r["id"]
        done = graph.vertices.sparkSession.createDataFrame(list(mate.items()), "id long, partner long") if mate else None
    while graph.n_edges > SMALL:
        choice = left.groupBy("id").agg(F.max_by("nbr", "key").alias("partner"))
        back = choice.select(F.col("id").alias("partner"), F.col("partner").alias("id"))
        pairs = cut(choice.join(back, ["id", "partner"]))
        if pairs.isEmpty():
            break
        done = pairs if done is None else cut(done.unionAll(pairs))
        taken = pairs.select("id")
        left = cut(left.join(taken, "id", "left_anti").join(taken.withColumnRenamed("id", "nbr"), "nbr", "left_anti"))
    if done is None:
        return graph.vertices.select("id", F.col("id").alias("partner"))
    if strategy in (Strategy.HEMSR, Strategy.HEMSRDEG):
        free = graph.vertices.select("id").join(done, "id", "left_anti")
        via = near.join(free, "id", "left_semi").join(done.select(F.col("id").alias("nbr")), "nbr", "left_semi")
        if strategy is Strategy.HEMSRDEG:
            mean = 2.0 * graph.n_edges / max(1, graph.size)
            big = graph.adj.groupBy(F.col("id").alias("nbr")).agg(F.count("*").alias("d")).where(F.col("d") >= threshold * mean)
            via = via.join(big, "nbr", "left_semi")
        hub = via.groupBy("id").agg(F.max_by("nbr", F.struct("key")).alias("hub"), F.max("weight").alias("w"))
        order = F.row_number().over(_by_hub())
        seat = hub.withColumn("n", order)
        couple = seat.groupBy("hub", F.floor((F.col("n") - 1) / 2).alias("c")).agg(F.min_by("id", "n").alias("x"), F.max_by("id", "n").alias("y")).where("x <> y")
        more = couple.select(F.col("x").alias("id"), F.col("y").alias("partner")).unionAll(couple.select("y", "x"))
        done = cut(done.unionAll(more))
    return graph.vertices.select("id").join(done, "id", "left").select("id", F.coalesce("partner", "id").alias("partner"))


def _by_hub():
    from pyspark.sql import Window

    return Window.partitionBy("hub").orderBy(F.desc("w"), "id")


def fine_to_coarse(matching: DataFrame) -> DataFrame:
    """fine_id, coarse_id: pairs and singles numbered by their least id."""
    first = matching.select("id", F.least("id", "partner").alias("first"))
    number = ranked(first.select("first").distinct(), "first", name="coarse_id")
    return first.join(number, "first").select(F.col("id").alias("fine_id"), "coarse_id")


def contract(graph: Graph, mapping: DataFrame) -> Graph:
    """The graph of ``mapping`` (fine_id, coarse_id): inner edges go, parallel ones are summed,
    vertices get vweight, the sum of the fine ones (1 each without)."""
    one, two = (mapping.select(F.col("fine_id").alias(n), F.col("coarse_id").alias(c)) for n, c in (("src", "a"), ("dst", "b")))
    e = graph.edges.join(one, "src").join(two, "dst").where("a <> b")
    e = e.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum("weight").alias("weight"), F.min("eid").alias("eid"))
    w = F.col("vweight") if "vweight" in graph.vertices.columns else F.lit(1.0)
    v = graph.vertices.join(mapping, F.col("id") == F.col("fine_id")).groupBy(F.col("coarse_id").alias("id")).agg(F.sum(w).alias("vweight"))
    return Graph(v.withColumn("label", F.col("id").cast("string")), e.select("eid", "src", "dst", "weight"), False, graph.title)


def hierarchy(graph: Graph, least: int = 50, stall: float = 0.8, levels: int = 64, strategy: Strategy = Strategy.HEM, seed: int = 42, threshold: float = 2.0) -> list[tuple[Graph, DataFrame]]:
    """(coarse graph, fine_to_coarse) by level, while over ``least`` vertices remain and a level
    keeps at most ``stall`` of them."""
    out, now = [], graph
    while now.size > least and len(out) < levels:
        mapping = cut(fine_to_coarse(match(now, strategy, seed + len(out), threshold)))
        coarse = contract(now, mapping)
        coarse = Graph(cut(coarse.vertices), cut(coarse.edges), False, graph.title)
        if coarse.size > stall * now.size:
            break
        out.append((coarse, mapping))
        now = coarse
    return out


def map_up(levels: list, ids: DataFrame, start: int, to: int) -> DataFrame:
    """id, coarse: where vertices of level ``start`` are at level ``to`` (0: the graph itself)."""
    out = ids.select("id", F.col("id").alias("coarse"))
    for _, mapping in levels[start:to]:
        out = out.join(mapping, out["coarse"] == mapping["fine_id"]).select("id", F.col("coarse_id").alias("coarse"))
    return out


def map_down(levels: list, ids: DataFrame, start: int, to: int) -> DataFrame:
    """id, fine: all vertices of level ``to`` below vertices of level ``start``."""
    out = ids.select("id", F.col("id").alias("fine"))
    for _, mapping in reversed(levels[to:start]):
        out = out.join(mapping, out["fine"] == mapping["coarse_id"]).select("id", F.col("fine_id").alias("fine"))
    return out


def level_table(graph: Graph, levels: list, current: int = 0) -> list[dict]:
    """level, nodes, edges, bytes, is_current of the graph and its levels."""
    return [{"level": i, "nodes": g.size, "edges": g.n_edges, "bytes": g.memory_bytes(), "is_current": i == current} for i, g in enumerate([graph, *(g for g, _ in levels)])]
