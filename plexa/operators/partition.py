"""Balanced bisection and k-way partitions, multilevel.

Coarsening, projection, gains and cuts are DataFrame plans. The coarsest graph is
split on the driver, where levels of bounded size are refined as well. On larger levels
refinement moves batches of vertices that aren't neighbours, in the order of their
gain, and a pass falls back to its best point.
"""

from __future__ import annotations

import heapq
import random
from collections import deque
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import Graph, induced
from ..plans.iterate import cut, drop, ranked
from .coarsen import SMALL, Strategy, hierarchy

#: Vertices up to which a level is refined on the driver; up to twice as many the coarsest is split there.
DRIVER = 2000
#: Batches of a refinement pass, and how many without gain end it.
BATCHES = 8
STALL = 2
#: Moves of a batch that has no positive gain.
CLIMB = 8


@dataclass(frozen=True)
class Options:
    split: float = 0.5
    tolerance: float = 0.25
    strategy: Strategy = Strategy.HEMSRDEG
    coarse_limit: int = 64
    levels: int = 64
    qp_rounds: int = 10
    fm_passes: int = 4
    seed: int = 42
    threshold: float = 2.0


def edge_cut(graph: Graph, side: DataFrame, name: str = "side") -> DataFrame:
    """One row, edge_cut: the weight of edges whose ends differ in ``name``."""
    one, two = (side.select(F.col("id").alias(n), F.col(name).alias(c)) for n, c in (("src", "a"), ("dst", "b")))
    e = graph.edges.join(one, "src").join(two, "dst")
    return e.agg(F.coalesce(F.sum(F.when(F.col("a") != F.col("b"), F.col("weight"))), F.lit(0.0)).alias("edge_cut"))


def part_sizes(parts: DataFrame, k: int, name: str = "part") -> DataFrame:
    """part, size; empty parts too."""
    counts = parts.groupBy(F.col(name).cast("int").alias("part")).agg(F.count("*").alias("size"))
    return parts.sparkSession.range(k).select(F.col("id").cast("int").alias("part")).join(counts, "part", "left").fillna(0, ["size"])


def imbalance(side: DataFrame) -> DataFrame:
    """size_a, size_b, imbalance (2 max / n)."""
    n, b = F.count("*"), F.coalesce(F.sum(F.col("side").cast("long")), F.lit(0))
    return side.agg((n - b).alias("size_a"), b.alias("size_b"), n.alias("n")).select("size_a", "size_b", F.coalesce(F.try_divide(2.0 * F.greatest("size_a", "size_b"), "n"), F.lit(0.0)).alias("imbalance"))


def gains(graph: Graph, side: DataFrame) -> DataFrame:
    """id, side, gain (weight across minus weight within), boundary (has a neighbour across)."""
    other = side.select(F.col("id").alias("nbr"), F.col("side").alias("there"))
    seen = graph.adj.join(side, "id").join(other, "nbr")
    across = F.col("side") != F.col("there")
    return seen.groupBy("id", "side").agg(F.sum(F.when(across, F.col("weight")).otherwise(-F.col("weight"))).alias("gain"), F.max(across).alias("boundary"))


def max_weight(graph: Graph) -> DataFrame:
    """id, d: the largest incident weight, at least 0."""
    found = graph.adj.groupBy("id").agg(F.greatest(F.max("weight"), F.lit(0.0)).alias("d"))
    return graph.vertices.select("id").join(found, "id", "left").fillna(0.0, ["d"])


def qp_gradient(graph: Graph, x: DataFrame) -> DataFrame:
    """id, gradient: (x - 1/2) d + sum of w (1/2 - x of the neighbour). ``x``: id, x."""
    pull = graph.adj.join(x.select(F.col("id").alias("nbr"), F.col("x").alias("there")), "nbr").groupBy("id").agg(F.sum(F.col("weight") * (0.5 - F.col("there"))).alias("pull"))
    return x.join(max_weight(graph), "id").join(pull, "id", "left").select("id", ((F.col("x") - 0.5) * F.col("d") + F.coalesce("pull", F.lit(0.0))).alias("gradient"))


def _weights(graph: Graph) -> DataFrame:
    return graph.vertices.select("id", (F.col("vweight") if "vweight" in graph.vertices.columns else F.lit(1.0)).alias("vweight"))


def _facts(graph: Graph, side: DataFrame) -> tuple[float, float, float]:
    """Cut, weight of side B, weight of all."""
    w = side.join(_weights(graph), "id").agg(F.sum(F.when(F.col("side"), F.col("vweight")).otherwise(0.0)).alias("b"), F.sum("vweight").alias("n")).first()
    return edge_cut(graph, side).first()[0], w["b"] or 0.0, w["n"] or 0.0


def qp_refine(graph: Graph, side: DataFrame, options: Options) -> DataFrame:
    """x in [0, 1], boundary vertices begun at 1/4 and 3/4, the others fixed. A round is a gradient
    step and a push of free vertices to the bound that lowers the cost (of free neighbours
    the one of least hash at a time), each followed by a shift of all free x that brings the
    weight of B back into its limits. Then x > 1/2 is B, and if its weight is out of the limits,
    the vertices with x nearest 1/2 change sides until it isn't. Kept if the cut doesn't grow."""
    before, b, n = _facts(graph, side)
    target = (1 - options.split) * n
    low, high = min(b, max(0.0, target * (1 - options.tolerance))), max(b, min(n, target * (1 + options.tolerance)))
    edge = gains(graph, side).where("boundary").select("id", F.lit(True).alias("edge"))
    start = F.when(F.col("edge"), F.when(F.col("side"), 0.75).otherwise(0.25)).otherwise(F.col("side").cast("double"))
    scale = max_weight(graph).withColumnRenamed("d", "scale")
    rows = side.join(edge, "id", "left").join(scale, "id").join(_weights(graph), "id")
    x = cut(rows.select("id", start.alias("x"), F.coalesce("edge", F.lit(False)).alias("free"), "scale", "vweight"))
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    marks = [k / 32 for k in range(-32, 33)]

    def moved(x: DataFrame, to) -> DataFrame:
        """``x`` with ``to`` as the new x, shifted back into the limits."""
        new = cut(x.withColumn("x", to).select("id", "x", "free", "scale", "vweight"))
        at = lambda m: F.sum(F.col("vweight") * F.when(F.col("free"), clip(F.col("x") + m)).otherwise(F.col("x")))
        weights = [w or 0.0 for w in new.agg(*(at(m) for m in marks)).first()]
        want = min(max(weights[32], low), high)
        if want == weights[32]:
            return new
        k = next((i for i in range(1, len(marks)) if weights[i] >= want), len(marks) - 1)
        share = (want - weights[k - 1]) / (weights[k] - weights[k - 1]) if weights[k] > weights[k - 1] else 0.0
        shift = marks[k - 1] + min(max(share, 0.0), 1.0) / 32
        return new.withColumn("x", F.when(F.col("free"), clip(F.col("x") + shift)).otherwise(F.col("x")))

    for _ in range(options.qp_rounds):
        step = x.join(qp_gradient(graph, x.select("id", "x")), "id")
        down = clip(F.col("x") - F.coalesce(F.try_divide("gradient", 4 * F.col("scale")), F.lit(0.0)))
        old, x = x, moved(step, F.when(F.col("free"), down).otherwise(F.col("x")))
        free = x.where("free and x > 0 and x < 1").select("id", F.xxhash64("id").alias("h"))
        rival = graph.adj.select("id", "nbr").join(free.withColumnRenamed("id", "nbr"), "nbr").groupBy("id").agg(F.min("h").alias("rival"))
        turn = free.join(rival, "id", "left").where("rival is null or h < rival").select("id", F.lit(True).alias("turn"))
        step = x.join(qp_gradient(graph, x.select("id", "x")), "id").join(turn, "id", "left")
        cost = lambda d: F.col("gradient") * d + 0.5 * F.col("scale") * d * d
        to0, to1 = cost(-F.col("x")), cost(1 - F.col("x"))
        bound = F.when(F.least(to0, to1) >= 0, F.col("x")).when(to0 <= to1, 0.0).otherwise(1.0)
        last, x = x, moved(step, F.when(F.col("turn"), bound).otherwise(F.col("x")))
        drop(old, last)
    placed = x.select("id", "x", "vweight", (F.col("x") > 0.5).alias("side"))
    heavy = placed.agg(F.sum(F.when(F.col("side"), F.col("vweight")).otherwise(0.0))).first()[0] or 0.0
    if not low <= heavy <= high:
        over = heavy > high
        order = F.col("x").asc() if over else F.col("x").desc()
        line = ranked(placed.where(F.col("side") == over), order, F.col("id").asc())
        flip = _first(line, heavy - high if over else low - heavy, reach=True).where("first").select("id", F.lit(True).alias("flip"))
        placed = placed.join(flip, "id", "left").withColumn("side", F.coalesce(F.col("side") != F.col("flip"), F.col("side")))
    new = cut(placed.select("id", "side"))
    after, _, _ = _facts(graph, new)
    return new if after <= before else side


def _first(placed: DataFrame, weight: float, reach: bool = False) -> DataFrame:
    """id, first: whether the vertices up to here (by rank) weigh at most ``weight``; with
    ``reach``, whether those before weigh less, so that the first ones reach it."""
    part = placed.withColumn("_p", F.floor(F.col("rank") / 100_000))
    sums = part.groupBy("_p").agg(F.sum("vweight").alias("s")).withColumn("o", F.coalesce(F.sum("s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    run = F.sum("vweight").over(Window.partitionBy("_p").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return part.withColumn("r", run).join(sums.select("_p", "o"), "_p").select("id", (F.col("r") + F.col("o") - (F.col("vweight") if reach else 0.0) < weight + (-1e-9 if reach else 1e-9)).alias("first"))


def fm_refine(graph: Graph, side: DataFrame, options: Options) -> DataFrame:
    """Passes of batches. A batch moves the unlocked boundary vertices whose gain is larger than
    that of every unlocked boundary neighbour, best first, as far as the balance allows; where
    no gain is positive, the ``CLIMB`` best of them. What has moved is locked. A pass goes on for up to ``BATCHES`` batches
    and falls back to the best point on its way (least imbalance, then least cut)."""
    now, b, n = _facts(graph, side)
    target = (1 - options.split) * n
    low, high = target * (1 - options.tolerance), target * (1 + options.tolerance)
    off = lambda w: max(low - w, w - high, 0.0)
    weights = _weights(graph)
    for _ in range(options.fm_passes):
        best = (off(b), now, b, side)
        begun, locked, still = best[:2], None, 0
        for _ in range(BATCHES):
            g = gains(graph, side).select("id", "side", "gain", "boundary", F.xxhash64("id").alias("h"))
            if off(b):  # repair: vertices of the heavy side, best gains first, also from inside
                chosen = side.where(F.col("side") == (b > high)).join(g.select("id", "gain"), "id", "left").fillna(0.0, ["gain"])
            else:
                g = cut(g.where("boundary") if locked is None else g.where("boundary").join(locked, "id", "left_anti"))
                rival = graph.adj.select("id", "nbr").distinct().join(g.select(F.col("id").alias("nbr"), F.struct("gain", "h").alias("k")), "nbr").groupBy("id").agg(F.max("k").alias("rival"))
                chosen = g.join(rival, "id", "left").where(F.col("rival").isNull() | (F.struct("gain", "h") > F.col("rival")))
            placed = cut(ranked(chosen.select("id", "side", "gain").join(weights, "id"), F.desc("gain"), F.col("id").asc()))
            if not off(b):
                some = not placed.where("gain > 0").isEmpty()
                placed = placed.where("gain > 0") if some else placed.where(F.col("rank") < CLIMB)
            kept = None
            for flag in (False, True):  # from A to B, and back
                room = (target - b if not flag else b - target) if off(b) else (high - b if not flag else b - low)
                if room > 0:
                    some = placed.where(F.col("side") == flag)
                    picked = some.join(_first(some, room), "id").where("first").select("id")
                    kept = picked if kept is None else kept.unionAll(picked)
            if kept is None:
                break
            kept = cut(kept)
            if kept.isEmpty():
                break
            locked = kept if locked is None else cut(locked.unionAll(kept))
            flip = kept.select("id", F.lit(True).alias("flip"))
            side = cut(side.join(flip, "id", "left").select("id", F.when(F.col("flip"), ~F.col("side")).otherwise(F.col("side")).alias("side")))
            now, b, _ = _facts(graph, side)
            still = 0 if (off(b), now) < best[:2] else still + 1
            if not still:
                best = (off(b), now, b, side)
            if still >= STALL:
                break
        _, now, b, side = best
        if best[:2] >= begun:
            break
    return side


class Small:
    """A graph of bounded size on the driver."""

    def __init__(self, graph: Graph, options: Options):
        self.options = options
        self.v = {r["id"]: r["vweight"] for r in _weights(graph).collect()}
        self.near: dict[int, dict[int, float]] = {i: {} for i in self.v}
        self.edges = [(r["src"], r["dst"], r["weight"]) for r in graph.edges.select("src", "dst", "weight").collect()]
        for a, b, w in self.edges:
            self.near[a][b] = self.near[a].get(b, 0) + w
            self.near[b][a] = self.near[b].get(a, 0) + w
        self.ids, self.total = sorted(self.v), sum(self.v.values())
        self.target = options.split * self.total
        self.low, self.high = self.target * (1 - options.tolerance), self.target * (1 + options.tolerance)

    def grow(self, seed: int) -> set[int]:
        """Breadth-first until the target's weight is reached."""
        inside, waiting, todo, weight = set(), iter(self.ids), deque([seed]), 0.0
        while weight < self.target:
            i = todo.popleft() if todo else next((j for j in waiting if j not in inside), None)
            if i is None:
                break
            if i not in inside and (not inside or weight + self.v[i] <= max(1.1 * self.target, self.target + min(self.v.values()))):
                inside.add(i)
                weight += self.v[i]
                todo.extend(sorted(j for j in self.near[i] if j not in inside))
        return inside

    def refined(self, inside: set[int]) -> tuple[float, float, set[int]]:
        """(imbalance, cut, side A) after passes of single moves, each kept up to its best point."""
        inside, v, near, total = set(inside), self.v, self.near, self.total
        off_of = lambda w: max(self.low - w, w - self.high, 0.0)
        for _ in range(self.options.fm_passes):
            gain = {i: sum(w if (j in inside) != (i in inside) else -w for j, w in near[i].items()) for i in self.ids}
            weight, cost, locked, moves = sum(v[i] for i in inside), 0.0, set(), []
            off = off_of(weight)
            best, best_at, still = (off, 0.0), 0, 0
            heap = [(-gain[i], i) for i in self.ids if off or any((j in inside) != (i in inside) for j in near[i])]
            heapq.heapify(heap)
            while heap and still < 50:
                g, i = heapq.heappop(heap)
                if i in locked or -g != gain[i]:
                    continue
                to = weight + (-v[i] if i in inside else v[i])
                now = off_of(to)
                if now > off or not 0 < to < total:
                    continue
                locked.add(i)
                cost -= gain[i]
                inside ^= {i}
                weight, off = to, now
                moves.append(i)
                for j, w in near[i].items():
                    gain[j] += -2 * w if (j in inside) == (i in inside) else 2 * w
                    if j not in locked:
                        heapq.heappush(heap, (-gain[j], j))
                still += 1
                if (off, cost) < best:
                    best, best_at, still = (off, cost), len(moves), 0
            for i in moves[best_at:]:
                inside ^= {i}
            if not best_at:
                break
        weight = sum(v[i] for i in inside)
        return off_of(weight), sum(w for a, b, w in self.edges if (a in inside) != (b in inside)), inside


def _sides(graph: Graph, inside: set[int], ids) -> DataFrame:
    return graph.vertices.sparkSession.createDataFrame([(i, i not in inside) for i in ids], "id long, side boolean")


def initial(graph: Graph, options: Options) -> DataFrame:
    """The best of growths from several seeds and of random fills, each refined by passes of single
    moves; on the driver, for a graph of bounded size."""
    small = Small(graph, options)
    ids, v = small.ids, small.v
    rng = random.Random(options.seed)
    tries = [small.grow(seed) for seed in rng.sample(ids, min(4, len(ids))) + [max(ids, key=lambda i: (len(small.near[i]), -i))]]
    for _ in range(4):
        inside, weight = set(), 0.0
        for i in rng.sample(ids, len(ids)):
            if weight < small.target and weight + v[i] <= 1.1 * small.target:
                inside.add(i)
                weight += v[i]
        tries.append(inside)
    found = [small.refined(s or {ids[0]}) for s in tries]
    found = [f for f in found if 0 < len(f[2]) < len(ids)] or [(0.0, 0.0, set(ids[: max(1, len(ids) // 2)]))]
    return _sides(graph, min(found, key=lambda f: f[:2])[2], ids)


def refine(graph: Graph, side: DataFrame, options: Options) -> DataFrame:
    """``side`` refined: single moves on the driver up to ``DRIVER`` vertices, rounds of batches beyond."""
    if graph.size <= DRIVER and graph.n_edges <= SMALL:
        small = Small(graph, options)
        return _sides(graph, small.refined({r["id"] for r in side.where("not side").collect()})[2], small.ids)
    return fm_refine(graph, qp_refine(graph, side, options), options)


def bisect(graph: Graph, options: Options | None = None) -> DataFrame:
    """id, side (false: A). Empty and single-vertex graphs are all A.

    Coarsened to ``coarse_limit`` vertices or until a level keeps over 85%; split there; refined
    at every level on the way back."""
    options = options or Options()
    if graph.size < 2:
        return graph.vertices.select("id", F.lit(False).alias("side"))
    levels = hierarchy(graph, options.coarse_limit, 0.85, options.levels, options.strategy, options.seed, options.threshold)
    graphs = [graph, *(g for g, _ in levels)]
    if graphs[-1].size <= 2 * DRIVER and graphs[-1].n_edges <= 2 * SMALL:
        side = cut(initial(graphs[-1], options))
    else:  # it coarsened no further: fill A in hash order, and refine that
        placed = ranked(_weights(graphs[-1]).withColumn("h", F.xxhash64("id", F.lit(options.seed))), "h", "id")
        total = placed.agg(F.sum("vweight")).first()[0]
        side = cut(_first(placed, options.split * total).select("id", (~F.col("first")).alias("side")))
        side = refine(graphs[-1], side, options)
    for fine, (_, mapping) in zip(reversed(graphs[:-1]), reversed(levels), strict=True):
        side = refine(fine, cut(mapping.join(side, mapping["coarse_id"] == side["id"]).select(F.col("fine_id").alias("id"), "side")), options)
    return side


def k_way(graph: Graph, k: int, options: Options | None = None) -> DataFrame:
    """id, part: the largest part is split until there are k, or none of two vertices."""
    parts = cut(graph.vertices.select("id", F.lit(0).alias("part")))
    for new in range(1, k):
        top = parts.groupBy("part").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "part").first()
        if top is None or top["n"] < 2:
            break
        members = parts.where(F.col("part") == top["part"]).select("id")
        sub = induced(graph, members)
        sub = Graph(cut(sub.vertices), cut(sub.edges), False)
        side = bisect(sub, options or replace(Options()))
        to = side.where("side").select("id", F.lit(new).alias("to"))
        parts = cut(parts.join(to, "id", "left").select("id", F.coalesce("to", "part").alias("part")))
    return parts
