"""Components and communities."""

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Graph
from ..plans.iterate import cut, drop, ranked
from .coarsen import SMALL


def components(graph: Graph) -> DataFrame:
    """id, component (least id): least labels spread over edges and then over labels."""
    near = cut(graph.adj.select("id", "nbr").distinct())
    label = cut(graph.vertices.select("id", F.col("id").alias("component")))
    while True:
        best = near.join(label.select(F.col("id").alias("nbr"), F.col("component").alias("c")), "nbr").groupBy("id").agg(F.min("c").alias("c"))
        step = label.join(best, "id", "left").select("id", F.col("component").alias("was"), F.least("component", F.coalesce("c", "component")).alias("to"))
        jump = label.select(F.col("id").alias("to"), F.col("component").alias("next"))
        new = cut(step.join(jump, "to").select("id", "was", F.least("to", "next").alias("component")))
        drop(label)
        label = new.select("id", "component")
        if new.where("component <> was").isEmpty():
            drop(near)
            return label


def _parity():
    return F.pmod(F.xxhash64("id"), F.lit(2))


def _small_propagation(graph: Graph, sweeps: int) -> DataFrame:
    """The sweeps of ``label_propagation``, on the driver."""
    near: dict[int, list[int]] = {}
    for r in graph.adj.select("id", "nbr").collect():
        near.setdefault(r["id"], []).append(r["nbr"])
    half = {r["id"]: r["h"] for r in graph.vertices.select("id", _parity().alias("h")).collect()}
    label = {i: i for i in half}
    for _ in range(sweeps):
        moved = False
        for h in (0, 1):
            new = {}
            for i in (i for i in near if half[i] == h):
                votes = Counter(label[j] for j in near[i])
                new[i] = max(votes, key=lambda l, i=i, votes=votes: (votes[l], l == label[i], -l))
            moved |= any(label[i] != l for i, l in new.items())
            label |= new
        if not moved:
            break
    return graph.vertices.sparkSession.createDataFrame(list(label.items()), "id long, label long")


def label_propagation(graph: Graph, sweeps: int = 50) -> DataFrame:
    """id, community (0 to K-1, by first vertex).

    A sweep updates first the vertices of even hash, then those of odd hash, so that
    neighbours don't swap labels for ever. A vertex takes the most frequent label
    among its neighbour entries, and keeps its own if that is among them; else the least
    wins. Ends when a sweep changes nothing. Graphs of at most ``SMALL`` edges take the same
    sweeps on the driver, with the same labels."""
    if graph.n_edges <= SMALL:
        return renumbered(_small_propagation(graph, sweeps), "label")
    adj = cut(graph.adj.select("id", "nbr"))
    label = cut(graph.vertices.select("id", F.col("id").alias("label")))
    for _ in range(sweeps):
        before = label
        for half in (0, 1):
            votes = adj.where(_parity() == half).join(label.select(F.col("id").alias("nbr"), F.col("label").alias("l")), "nbr").groupBy("id", "l").agg(F.count("*").alias("n"))
            own = votes.join(label, "id").withColumn("stay", F.col("l") == F.col("label"))
            best = own.groupBy("id").agg(F.max_by("l", F.struct("n", "stay", -F.col("l"))).alias("best"))
            old, label = label, cut(label.join(best, "id", "left").select("id", F.coalesce("best", "label").alias("label")))
            if old is not before:
                drop(old)
        still = label.join(before.withColumnRenamed("label", "was"), "id").where("label <> was").isEmpty()
        drop(before)
        if still:
            break
    drop(adj)
    return renumbered(label, "label")


def renumbered(labels: DataFrame, name: str, to: str = "community") -> DataFrame:
    """id and ``to``: the labels as 0, 1, ... in the order of their least id."""
    first = ranked(labels.groupBy(name).agg(F.min("id").alias("first")), "first", name=to)
    return labels.join(first.select(name, to), name).select("id", to)


def largest(labels: DataFrame, n: int = 6, name: str = "community") -> DataFrame:
    """The n largest communities and their sizes."""
    return labels.groupBy(name).agg(F.count("*").alias("size")).orderBy(F.desc("size"), name).limit(n)


def bfs_tree(graph: Graph, roots: DataFrame) -> DataFrame:
    """id, root, level, parent: level by level from ``roots`` (id); of several parents the least id."""
    near = cut(graph.adj.select("id", "nbr").distinct())
    tree = front = cut(roots.select("id", F.col("id").alias("root"), F.lit(0).alias("level"), F.lit(None).cast("long").alias("parent")))
    while True:
        step = front.join(near, "id").select(F.col("nbr").alias("to"), "root", "level", "id").join(tree.select(F.col("id").alias("to")), "to", "left_anti")
        new = cut(step.groupBy("to").agg(F.min_by(F.struct("root", "level", "id"), "id").alias("p")).select(F.col("to").alias("id"), "p.root", (F.col("p.level") + 1).alias("level"), F.col("p.id").alias("parent")))
        if new.isEmpty():
            drop(near, new)
            return tree
        old, tree = tree, cut(tree.unionAll(new))
        drop(old, front if front is not old else None)
        front = new


def bridges(graph: Graph) -> DataFrame:
    """src, dst (src < dst) of the simple graph's bridges.

    Every edge outside a breadth-first forest gets 128 random bits (of a hash of its ends), every
    vertex the exclusive or of those at it. Summed likewise over a subtree, level by level
    from the deepest, an edge with both ends inside cancels out: the sum is 0 where no such edge
    leaves the subtree, that is where the forest edge above it is a bridge (another sum is 0 by
    a chance of 2**-128)."""
    simple = cut(graph.edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    whole = Graph(simple.select(F.col("src").alias("id")).unionAll(simple.select("dst")).distinct(), simple.select(F.xxhash64("src", "dst").alias("eid"), "src", "dst", F.lit(1.0).alias("weight")))
    tree = bfs_tree(whole, components(whole).select(F.col("component").alias("id")).distinct())
    limbs = tree.where("parent is not null").select(F.least("id", "parent").alias("src"), F.greatest("id", "parent").alias("dst"))
    others = simple.join(limbs, ["src", "dst"], "left_anti").select("src", "dst", F.xxhash64("src", "dst", F.lit(1)).alias("x"), F.xxhash64("src", "dst", F.lit(2)).alias("y"))
    at = others.select(F.col("src").alias("id"), "x", "y").unionAll(others.select("dst", "x", "y")).groupBy("id").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    own = cut(tree.join(at, "id", "left").fillna(0, ["x", "y"]))
    found = below = None
    for level in range(own.agg(F.max("level")).first()[0] or 0, 0, -1):
        here = own.where(F.col("level") == level).select("id", "parent", "x", "y")
        if below is not None:
            here = here.join(below.select(F.col("id").alias("child"), F.col("x").alias("u"), F.col("y").alias("v")), F.col("id") == F.col("child"), "left").fillna(0, ["u", "v"])
            here = here.select("id", "parent", F.col("x").bitwiseXOR(F.col("u")).alias("x"), F.col("y").bitwiseXOR(F.col("v")).alias("y"))
        here = cut(here)
        part = here.where("x = 0 and y = 0").select(F.least("id", "parent").alias("src"), F.greatest("id", "parent").alias("dst"))
        found = part if found is None else found.unionAll(part)
        drop(below)
        below = cut(here.groupBy(F.col("parent").alias("id")).agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")))
    drop(below)
    return found if found is not None else limbs
