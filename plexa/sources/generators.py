"""Generated graphs: ids from 0, unit weights. Randomness is a hash of ids and seed, so a lost
task makes the same rows again."""

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Graph, build


#: Edges up to which a graph that grows step by step is made, on the driver.
MOST = 1_000_000


def uniform(*parts) -> Column:
    """A number in [0, 1) that follows from ``parts``."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / float(1 << 53)


def _graph(spark: SparkSession, n: int, edges: DataFrame, title: str) -> Graph:
    return build(edges, False, spark.range(n).select("id", F.col("id").cast("string").alias("label")), title)


def _pairs(spark: SparkSession, n: int) -> DataFrame:
    """All src < dst, row by row: each source makes its own targets."""
    return spark.range(max(0, n - 1)).select(F.col("id").alias("src"), F.explode(F.sequence(F.col("id") + 1, F.lit(n - 1).cast("long"))).alias("dst"))


def complete(spark: SparkSession, n: int) -> Graph:
    return _graph(spark, n, _pairs(spark, n), f"K{n}")


def erdos_renyi(spark: SparkSession, n: int, p: float, seed: int = 42) -> Graph:
    """Each pair with probability p."""
    chosen = _pairs(spark, n).where(uniform("src", "dst", F.lit(seed)) < min(max(p, 0.0), 1.0))
    return _graph(spark, n, chosen, f"ER({n},{p})")


def star(spark: SparkSession, n: int) -> Graph:
    return _graph(spark, n, spark.range(1, n).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst")), f"star{n}")


def ring_lattice(spark: SparkSession, n: int, k: int) -> Graph:
    """Each vertex joined to its k/2 next on either side."""
    near = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(max(1, k // 2)))).alias("j")) if k > 1 else spark.range(0).select(F.col("id").alias("src"), F.lit(1).alias("j"))
    return _graph(spark, n, near.select("src", ((F.col("src") + F.col("j")) % n).alias("dst")), f"ring({n},{k})")


def barabasi_albert(spark: SparkSession, n: int, m: int, seed: int = 42) -> Graph:
    """A clique of m + 1, then each vertex joins m others, drawn by degree. Each step needs the
    one before, so it runs on the driver, for n * m up to ``MOST``."""
    if not 1 <= m < n:
        raise ValueError("needs 1 <= m < n")
    if n * m > MOST:
        raise ValueError(f"over {MOST} edges are not grown on the driver")
    rng = random.Random(seed)
    edges = [(i, j) for i in range(m + 1) for j in range(i + 1, m + 1)]
    ends = [v for e in edges for v in e]
    for v in range(m + 1, n):
        chosen: set[int] = set()
        for _ in range(100 * m):
            if len(chosen) == m:
                break
            chosen.add(rng.choice(ends))
        for u in sorted(chosen):
            edges.append((u, v))
            ends += (u, v)
    return _graph(spark, n, spark.createDataFrame(edges, "src long, dst long"), f"BA({n},{m})")


def watts_strogatz(spark: SparkSession, n: int, k: int, beta: float, seed: int = 42) -> Graph:
    """A ring lattice whose edges are rewired with probability beta. A rewired edge must be
    new, so this runs on the driver, for n * k / 2 up to ``MOST``."""
    if k % 2 or not 2 <= k < n:
        raise ValueError("needs an even k with 2 <= k < n")
    if n * k // 2 > MOST:
        raise ValueError(f"over {MOST} edges are not rewired on the driver")
    rng = random.Random(seed)
    edges = {(min(i, (i + j) % n), max(i, (i + j) % n)) for i in range(n) for j in range(1, k // 2 + 1)}
    for a, b in sorted(edges):
        if rng.random() < beta:
            edges.discard((a, b))
            for _ in range(2 * n):
                c = rng.randrange(n)
                if c != a and (min(a, c), max(a, c)) not in edges:
                    edges.add((min(a, c), max(a, c)))
                    break
            else:
                edges.add((a, b))
    return _graph(spark, n, spark.createDataFrame(sorted(edges), "src long, dst long"), f"WS({n},{k},{beta})")
