"""Colours of vertices, edges and density pixels, as structs r, g, b, a."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Graph
from ..operators import metrics

# The palettes and stops that results must equal.
PALETTE = (
    (102, 194, 255), (255, 128, 102), (128, 230, 128), (255, 204, 77), (204, 153, 255), (255, 153, 204),
    (102, 230, 204), (255, 179, 102), (153, 204, 255), (230, 230, 128), (204, 128, 255), (128, 204, 179),
)
SEQUENTIAL = ((68, 1, 84), (59, 82, 139), (33, 145, 140), (94, 201, 98), (253, 231, 37))
HEAT = ((10, 10, 20), (180, 30, 30), (240, 160, 30), (255, 255, 200))
DIVERGING = ((59, 130, 246), (240, 240, 240), (239, 68, 68))
EDGE, MUTUAL, ONE_WAY, BRIDGE = (120, 130, 150), (60, 180, 80, 120), (220, 80, 60, 90), (255, 200, 40, 200)
RAMPS = {
    "thermal": ((0, 0, 0), (0, 0, 180), (0, 220, 235), (255, 255, 0), (255, 255, 255)),
    "viridis": ((68, 1, 84), (160.5, 116, 158), (253, 231, 0)),
    "grayscale": ((0, 0, 0), (255, 255, 255)),
    "cyan": ((0, 0, 0), (0, 229.5, 255)),
}
NODE_MODES = ("community", "degree", "in_out_ratio", "betweenness", "pagerank", "clustering", "kcore")
EDGE_MODES = ("uniform", "community", "weight", "reciprocity", "bridge")
LEGENDS = {
    "community": ("categorical", "Community", None, None),
    "degree": ("sequential", "Degree", "Low", "High"),
    "in_out_ratio": ("diverging", "In/Out Ratio", "Out", "In"),
    "betweenness": ("heat", "Betweenness", "Low", "High"),
    "pagerank": ("heat", "PageRank", "Low", "High"),
    "clustering": ("sequential", "Clustering", "0", "1"),
    "kcore": ("sequential", "K-Core", "Low", "High"),
}


def rgba(r, g, b, a=255) -> Column:
    whole = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("int")
    return F.struct(whole(r).alias("r"), whole(g).alias("g"), whole(b).alias("b"), whole(a).alias("a"))


def sampled(t: Column, stops) -> Column:
    """The colour at t (0 to 1) between evenly spaced stops, cut to whole numbers."""
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)) * (len(stops) - 1)
    low = F.least(x.cast("int"), F.lit(len(stops) - 2))
    part = x - low
    tables = [F.array(*(F.lit(float(s[c])) for s in stops)) for c in range(3)]
    return rgba(*(F.get(v, low) + (F.get(v, low + 1) - F.get(v, low)) * part for v in tables))


def palette(community: Column, alpha: int = 255) -> Column:
    at = F.pmod(community, F.lit(len(PALETTE))).cast("int")
    return rgba(*(F.get(F.array(*(F.lit(p[c]) for p in PALETTE)), at) for c in range(3)), alpha)


def legend(mode: str) -> dict:
    kind, label, low, high = LEGENDS.get(mode, ("categorical", mode, None, None))
    return {"type": kind, "label": label, "low": low, "high": high}


def _share(values: DataFrame, t) -> DataFrame:
    """id, t of values and their maximum (one row; 1 where it isn't positive)."""
    most = values.agg(F.max("value").alias("m")).select(F.when(F.col("m") > 0, F.col("m")).otherwise(1.0).alias("m"))
    return values.crossJoin(F.broadcast(most)).select("id", t(F.col("value"), F.col("m")).alias("t"))


def node_colors(graph: Graph, mode: str, community: DataFrame | None = None, values: DataFrame | None = None) -> DataFrame:
    """id, color. Unknown modes are coloured by community (one community without any given).
    ``values`` (id, value): the graph's pagerank or betweenness, if it was found before."""
    if mode == "degree" or not graph.directed and mode in ("pagerank", "in_out_ratio"):
        by = _share(metrics.degree(graph), lambda v, m: F.log(v + 1) / F.log(m + 1))
        return by.select("id", sampled(F.col("t"), SEQUENTIAL).alias("color"))
    if mode == "in_out_ratio":
        both = metrics.in_out(graph)
        total = F.col("indegree") + F.col("outdegree")
        t = (F.coalesce(F.try_divide(F.col("outdegree") - F.col("indegree"), total), F.lit(0.0)) + 1) / 2
        return both.select("id", sampled(t, DIVERGING).alias("color"))
    if mode in ("pagerank", "betweenness"):
        return _share(metrics.metric(graph, mode) if values is None else values, lambda v, m: F.sqrt(v / m)).select("id", sampled(F.col("t"), HEAT).alias("color"))
    if mode == "clustering":
        return metrics.clustering(graph).select("id", sampled(F.col("value"), SEQUENTIAL).alias("color"))
    if mode == "kcore":
        return _share(metrics.kcore(graph), lambda v, m: v / m).select("id", sampled(F.col("t"), SEQUENTIAL).alias("color"))
    found = community if community is not None else graph.vertices.select("id", F.lit(0).alias("community"))
    return found.select("id", palette(F.col("community")).alias("color"))


def edge_colors(graph: Graph, mode: str, community: DataFrame | None = None) -> DataFrame:
    """src, dst, color. Unknown modes are uniform."""
    e = graph.edges
    if mode == "community" and community is not None:
        one, two = (community.select(F.col("id").alias(n), F.col("community").alias(c)) for n, c in (("src", "a"), ("dst", "b")))
        color = F.when(F.col("a") == F.col("b"), palette(F.col("a"), 80)).otherwise(rgba(*EDGE, 35))
        return e.join(one, "src").join(two, "dst").select("src", "dst", color.alias("color"))
    if mode == "weight":
        span = e.agg(F.min("weight").alias("lo"), F.max("weight").alias("hi"))
        width = F.when(F.col("hi") - F.col("lo") < 1e-12, 1.0).otherwise(F.col("hi") - F.col("lo"))
        t = (F.col("weight") - F.col("lo")) / width
        return e.crossJoin(F.broadcast(span)).select("src", "dst", rgba(*EDGE, 40 + (t * 140).cast("int")).alias("color"))  # span: one row
    if mode == "reciprocity" and graph.directed:
        return metrics.mutual(graph).select("src", "dst", F.when(F.col("mutual"), rgba(*MUTUAL)).otherwise(rgba(*ONE_WAY)).alias("color"))
    if mode == "bridge":
        from ..operators.communities import bridges

        found = bridges(graph).select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(True).alias("bridge"))
        both = e.join(found, (F.least("src", "dst") == F.col("a")) & (F.greatest("src", "dst") == F.col("b")), "left")
        return both.select("src", "dst", F.when(F.col("bridge"), rgba(*BRIDGE)).otherwise(rgba(*EDGE, 60)).alias("color"))
    return e.select("src", "dst", rgba(*EDGE, 60).alias("color"))


def density_colors(grid: DataFrame, ramp: str = "thermal", log_scale: bool = True, gamma: float = 0.5, floor: float = 0.15) -> DataFrame:
    """``grid`` (px, py, density) with color; any density over 0 is lifted to the floor."""
    gamma, floor = min(max(gamma, 0.1), 5.0), min(max(floor, 0.0), 0.9)
    most = grid.agg(F.max("density").alias("m"))
    t = F.log(1 + F.col("density")) / F.log(1 + F.col("m")) if log_scale else F.col("density") / F.col("m")
    at = F.least(((floor + (1 - floor) * F.pow(t, F.lit(gamma))) * 255).cast("int"), F.lit(255))
    return grid.crossJoin(F.broadcast(most)).select("px", "py", "density", at.alias("lut"), sampled(at / 255.0, RAMPS.get(ramp, RAMPS["thermal"])).alias("color"))  # most: one row
