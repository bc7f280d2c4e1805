"""Node metrics: id, value (double) of every vertex."""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import Graph
from ..plans.iterate import cut, drop
from .whole import Whole, fits, whole

NAMES = ("degree", "indegree", "outdegree", "pagerank", "betweenness", "clustering", "kcore", "in_out_ratio", "reciprocity")
DAMPING = 0.85
ROUNDS = 20
#: Tasks that the sources of shortest paths are dealt to, where each holds the graph.
SEARCHES = 48
#: Pairs of source and vertex that searches level by level store at a time.
REACHED = 50_000_000


def _filled(graph: Graph, found: DataFrame) -> DataFrame:
    """``found`` (id, value), and 0 for the other vertices."""
    return graph.vertices.select("id").join(found, "id", "left").select("id", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))


def _counted(graph: Graph, ends: DataFrame) -> DataFrame:
    return _filled(graph, ends.groupBy("id").agg(F.count("*").alias("value")))


def degree(graph: Graph) -> DataFrame:
    """Entries in the adjacency; a mutual pair counts twice."""
    return _counted(graph, graph.adj.select("id"))


def indegree(graph: Graph) -> DataFrame:
    return _counted(graph, graph.edges.select(F.col("dst").alias("id"))) if graph.directed else degree(graph)


def outdegree(graph: Graph) -> DataFrame:
    return _counted(graph, graph.edges.select(F.col("src").alias("id"))) if graph.directed else degree(graph)


def in_out(graph: Graph) -> DataFrame:
    """id, indegree, outdegree, in one pass over the edges."""
    both = graph.edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(graph.edges.select(F.col("dst").alias("id"), F.lit(0), F.lit(1)))
    sums = both.groupBy("id").agg(F.sum("i").alias("indegree"), F.sum("o").alias("outdegree"))
    if not graph.directed:
        total = F.col("indegree") + F.col("outdegree")
        sums = sums.select("id", total.alias("indegree"), total.alias("outdegree"))
    return graph.vertices.select("id").join(sums, "id", "left").fillna(0, ["indegree", "outdegree"])


def in_out_ratio(graph: Graph) -> DataFrame:
    """(out - in) / (out + in); 0 if isolated or undirected."""
    total = F.col("indegree") + F.col("outdegree")
    ratio = F.when(total > 0, (F.col("outdegree") - F.col("indegree")) / F.greatest(total, F.lit(1))).otherwise(0.0)
    return in_out(graph).select("id", (ratio if graph.directed else F.lit(0.0)).alias("value"))


def mutual(graph: Graph) -> DataFrame:
    """The edges, with ``mutual``: whether the reverse edge exists."""
    back = graph.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("mutual"))
    return graph.edges.join(back, ["src", "dst"], "left").withColumn("mutual", F.coalesce("mutual", F.lit(False)))


def reciprocity(graph: Graph) -> DataFrame:
    """Share of a vertex's out-edges whose reverse exists; 0 without any; 1 if undirected."""
    if not graph.directed:
        return graph.vertices.select("id", F.lit(1.0).alias("value"))
    return _filled(graph, mutual(graph).groupBy(F.col("src").alias("id")).agg(F.avg(F.col("mutual").cast("double")).alias("value")))


def pagerank(graph: Graph, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """A fixed number of rounds from 1/n; the mass of vertices without out-edges is spread
    evenly; weights don't count. Undirected graphs give the degree. Edges stay
    partitioned by source; lineage is cut every round, as a round reads the last one thrice."""
    if not graph.directed:
        return degree(graph)
    n = graph.size
    if not n:
        return graph.vertices.select("id", F.lit(0.0).alias("value"))
    out = outdegree(graph).withColumnRenamed("value", "out")
    rank = cut(out.withColumn("value", F.lit(1.0 / n)))
    links = graph.edges.select("src", "dst").repartition("src").cache()
    for _ in range(rounds):
        loose = rank.where("out = 0").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("loose"))
        flow = links.join(rank.where("out > 0").select(F.col("id").alias("src"), (F.col("value") / F.col("out")).alias("part")), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("part").alias("flow"))
        new = (1 - damping) / n + damping * (F.coalesce("flow", F.lit(0.0)) + F.col("loose") / n)
        old, rank = rank, cut(rank.select("id", "out").join(flow, "id", "left").crossJoin(F.broadcast(loose)).select("id", "out", new.alias("value")))  # loose: one row
        drop(old)
    links.unpersist()
    return rank.select("id", "value")


def betweenness(graph: Graph, sources: DataFrame | None = None) -> DataFrame:
    """Shortest paths through each vertex, over all sources, on the undirected multigraph (an
    undirected pair counts from both ends; not normalised).

    ``sources`` (id): only paths from these. A graph that fits a task (``whole``) is broadcast, and
    a task searches from its sources one by one. Otherwise blocks of sources search at once, level
    by level; a level is a stored frontier keyed by (source, id), and a block reaches at most
    ``REACHED`` of those. Both give the same sums, but for their last digits."""
    if sources is None:
        sources = graph.vertices.select("id")
    if fits(graph):
        return _filled(graph, _between(graph, sources))
    from ..plans.iterate import ranked

    near = graph.adj.groupBy("id", "nbr").agg(F.count("*").alias("m")).cache()  # m: parallel entries
    block = max(1, REACHED // max(1, graph.size))
    known = cut(ranked(sources, "id").select("id", F.floor(F.col("rank") / block).alias("block")))
    total = None
    for k in range((known.agg(F.max("block")).first()[0] or 0) + 1):
        found = _between_levels(near, known.where(F.col("block") == k).select("id"))
        old, total = total, cut((found if total is None else total.unionAll(found)).groupBy("id").agg(F.sum("value").alias("value")))
        drop(old, found)
    near.unpersist()
    drop(known)
    return _filled(graph, total)


def _between_levels(near: DataFrame, sources: DataFrame) -> DataFrame:
    """As ``_between``, a stored table; ``near``: id, nbr, m."""
    seen = cut(sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("level"), F.lit(1.0).alias("paths")))
    levels = [seen]
    while True:
        step = levels[-1].join(near, "id").groupBy("source", F.col("nbr").alias("id")).agg(F.sum(F.col("paths") * F.col("m")).alias("paths"))
        front = cut(step.join(seen, ["source", "id"], "left_anti").select("source", "id", F.lit(len(levels)).alias("level"), "paths"))
        if front.isEmpty():
            break
        levels.append(front)
        seen = seen.unionAll(front)
    last, below = front, None
    share = []
    for front, above in zip(levels[:0:-1], levels[-2::-1], strict=True):
        own = front if below is None else front.join(below, ["source", "id"], "left")
        own = own.withColumn("flow", F.lit(0.0) if below is None else F.coalesce("flow", F.lit(0.0)))
        own = cut(own.select("source", "id", "level", "paths", "flow"))
        share.append(own)
        upper = above.select("source", F.col("id").alias("nbr"), F.col("paths").alias("above"))
        down = own.join(near, "id").join(upper, ["source", "nbr"])
        below = down.groupBy("source", F.col("nbr").alias("id")).agg(F.sum(F.col("above") * F.col("m") / F.col("paths") * (1 + F.col("flow"))).alias("flow"))
    flows = sources.select("id", F.lit(0.0).alias("flow"))
    for part in share:
        flows = flows.unionAll(part.select("id", "flow"))
    found = cut(flows.groupBy("id").agg(F.sum("flow").alias("value")))
    drop(last, *levels, *share)
    return found


def _between(graph: Graph, sources: DataFrame) -> DataFrame:
    """id, value of the vertices on shortest paths from ``sources`` (id)."""
    known = whole(graph)
    shared = graph.vertices.sparkSession.sparkContext.broadcast((known.ids, known.start, known.near))

    def search(batches):
        graph, total = Whole(*shared.value), 0.0
        for batch in batches:
            total = total + graph.between(np.searchsorted(graph.ids, batch.column("id").to_numpy()))
        some = np.flatnonzero(total)
        if len(some):
            yield pa.RecordBatch.from_pydict({"id": graph.ids[some], "value": total[some]})

    found = sources.select(F.col("id").cast("long").alias("id")).repartition(SEARCHES).mapInArrow(search, "id long, value double")
    found = cut(found.groupBy("id").agg(F.sum("value").alias("value")))
    shared.destroy()
    return found


def pairs(graph: Graph) -> DataFrame:
    """a, b (a < b), m: neighbouring pairs and how many edges join them."""
    return graph.edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("m"))


def triangles(graph: Graph) -> DataFrame:
    """x, y, z with mxy, mxz, myz (parallel edges) of every triangle, once.

    Pairs point from the end of smaller degree to the other, so hubs open no wedges."""
    p = pairs(graph)
    deg = p.select(F.col("a").alias("id")).unionAll(p.select("b")).groupBy("id").agg(F.count("*").alias("d"))
    known = p.join(deg.select(F.col("id").alias("a"), F.col("d").alias("da")), "a").join(deg.select(F.col("id").alias("b"), F.col("d").alias("db")), "b")
    up = F.struct("da", "a") < F.struct("db", "b")
    out = known.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("y"), "m")
    wedge = out.select("x", "y", F.col("m").alias("mxy")).join(out.select("x", F.col("y").alias("z"), F.col("m").alias("mxz")), "x").where("y < z")
    return wedge.join(p.select(F.col("a").alias("y"), F.col("b").alias("z"), F.col("m").alias("myz")), ["y", "z"])


def clustering(graph: Graph) -> DataFrame:
    """2 t / (k (k - 1)): k entries of the neighbour list, repeats included; t pairs of them that
    are neighbours. 0 for k < 2."""
    t = triangles(graph)
    at = lambda v, a, b: t.select(F.col(v).alias("id"), (F.col(a) * F.col(b)).alias("t"))
    sums = at("x", "mxy", "mxz").unionAll(at("y", "mxy", "myz")).unionAll(at("z", "mxz", "myz")).groupBy("id").agg(F.sum("t").alias("t"))
    value = F.when(F.col("k") < 2, 0.0).otherwise(2.0 * F.coalesce("t", F.lit(0)) / F.greatest(F.col("k") * (F.col("k") - 1), F.lit(1.0)))
    return degree(graph).withColumnRenamed("value", "k").join(sums, "id", "left").select("id", value.alias("value"))


def kcore(graph: Graph) -> DataFrame:
    """Core numbers on the multigraph: vertices start at their degree and take the largest h
    with h neighbour entries of at least h, until nothing changes."""
    adj = graph.adj.select("id", "nbr").repartition("nbr").cache()
    core = cut(degree(graph))
    while True:
        seen = adj.join(core.select(F.col("id").alias("nbr"), F.col("value").alias("v")), "nbr").groupBy("id", "v").agg(F.count("*").alias("c"))
        top = F.sum("c").over(Window.partitionBy("id").orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, 0))
        h = seen.withColumn("h", F.least(F.col("v"), top.cast("double"))).groupBy("id").agg(F.max("h").alias("h"))
        new = cut(core.join(h, "id", "left").select("id", F.least("value", F.coalesce("h", F.lit(0.0))).alias("value"), F.col("value").alias("was")))
        drop(core)
        core = new.select("id", "value")
        if new.where("value <> was").isEmpty():
            adj.unpersist()
            return core


REGISTRY: dict[str, Callable[[Graph], DataFrame]] = {
    "degree": degree, "indegree": indegree, "outdegree": outdegree, "pagerank": pagerank, "betweenness": betweenness,
    "clustering": clustering, "kcore": kcore, "in_out_ratio": in_out_ratio, "reciprocity": reciprocity,
}


def metric(graph: Graph, name: str) -> DataFrame:
    if name not in REGISTRY:
        raise ValueError(f"unknown metric {name!r}; known: {', '.join(REGISTRY)}")
    return REGISTRY[name](graph)


def wide(graph: Graph, names=NAMES) -> DataFrame:
    """id and a column for each metric."""
    out = graph.vertices.select("id")
    for name in names:
        out = out.join(metric(graph, name).withColumnRenamed("value", name), "id")
    return out
