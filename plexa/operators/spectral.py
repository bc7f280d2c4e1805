"""Laplacian and its eigenvalues."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Graph
from ..plans.iterate import cut, drop, ranked
from .whole import fits, whole

#: Vertices up to which eigenvalues are worked out densely on the driver.
DENSE = 2000
LIMIT = 8000
#: Vectors that the Krylov basis of a larger graph holds, and Ritz vectors that a restart keeps.
BASIS = 40
KEPT = 15
#: Vertices up to which the driver holds the basis, if it holds the graph.
HERE = 400_000


def laplacian(graph: Graph) -> DataFrame:
    """i, j, value of degree minus adjacency, unweighted, parallel edges counted."""
    adj = graph.adj
    off = adj.groupBy(F.col("id").alias("i"), F.col("nbr").alias("j")).agg((-F.count("*")).cast("double").alias("value"))
    diagonal = adj.groupBy(F.col("id").alias("i")).agg(F.count("*").cast("double").alias("value")).select("i", F.col("i").alias("j"), "value")
    return off.unionAll(diagonal)


def product(graph: Graph, x: DataFrame) -> DataFrame:
    """id, value of the Laplacian times x (id, value)."""
    there = x.select(F.col("id").alias("nbr"), F.col("value").alias("there"))
    flow = graph.adj.join(there, "nbr").groupBy("id").agg(F.sum("there").alias("s"), F.count("*").alias("d"))
    return x.join(flow, "id", "left").select("id", (F.coalesce("d", F.lit(0)) * F.col("value") - F.coalesce("s", F.lit(0.0))).alias("value"))


def rayleigh(graph: Graph, x: DataFrame) -> DataFrame:
    """One row, quotient: x L x / x x, by edges."""
    one, two = (x.select(F.col("id").alias(n), F.col("value").alias(c)) for n, c in (("src", "a"), ("dst", "b")))
    energy = graph.edges.join(one, "src").join(two, "dst").agg(F.coalesce(F.sum((F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))), F.lit(0.0)).alias("e"))
    norm = x.agg(F.sum(F.col("value") * F.col("value")).alias("n"))
    return energy.crossJoin(norm).select(F.coalesce(F.try_divide("e", "n"), F.lit(0.0)).alias("quotient"))


def _dense(graph: Graph) -> tuple[list[int], np.ndarray]:
    ids = [r["id"] for r in graph.vertices.select("id").orderBy("id").collect()]
    at = {v: k for k, v in enumerate(ids)}
    out = np.zeros((len(ids), len(ids)))
    for r in laplacian(graph).collect():
        out[at[r["i"]], at[r["j"]]] = r["value"]
    return ids, out


def eigenvalues(graph: Graph) -> list[float]:
    """All eigenvalues, ascending; for at most ``LIMIT`` vertices."""
    if graph.size > LIMIT:
        raise ValueError(f"over {LIMIT} vertices")
    return np.linalg.eigvalsh(_dense(graph)[1]).tolist() if graph.size else []


def _dots(held: DataFrame, m: int) -> tuple[np.ndarray, float, float]:
    """Of held (id, v, value): products of value with the ``m`` vectors in v, its mean and its sum of squares."""
    row = held.agg(*(F.sum(F.col("v")[i] * F.col("value")) for i in range(m)), F.avg("value"), F.sum(F.col("value") * F.col("value"))).first()
    return np.array(row[:m], float), row[m], row[m + 1]


def _combined(weights: np.ndarray):
    """Column: the vectors in v, added up with ``weights``."""
    return sum((F.col("v")[i] * float(w) for i, w in enumerate(weights)), F.lit(0.0))


def _lanczos(graph: Graph, rounds: int, tolerance: float) -> DataFrame:
    """id, value of the lowest Ritz vector beside the constant one, by Lanczos rounds with full
    orthogonalisation and thick restarts, until its residual is within ``tolerance``."""
    n = graph.size
    start = cut(graph.vertices.select("id", (F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / float(1 << 20)).alias("value")))
    mean = start.agg(F.avg("value")).first()[0]
    norm = start.agg(F.sqrt(F.sum((F.col("value") - mean) * (F.col("value") - mean)))).first()[0]
    basis = cut(start.select("id", F.array((F.col("value") - mean) / norm).alias("v")))
    matrix = np.zeros((0, 0))
    for _ in range(rounds):
        while True:
            m = len(matrix) + 1
            flow = product(graph, basis.select("id", F.col("v")[m - 1].alias("value")))
            raw = cut(basis.join(flow, "id"))
            first, mean, _ = _dots(raw, m)
            held = cut(raw.select("id", "v", (F.col("value") - _combined(first) - mean).alias("value")))
            drop(raw, basis)
            again, mean, squares = _dots(held, m)
            rest = np.sqrt(max(0.0, squares - again @ again - n * mean * mean))
            matrix = np.pad(matrix, (0, 1))
            matrix[:, -1] = matrix[-1, :] = first + again
            values, vectors = np.linalg.eigh(matrix)
            if rest * abs(vectors[-1, 0]) <= tolerance:
                return cut(held.select("id", _combined(vectors[:, 0]).alias("value")))
            new = (F.col("value") - _combined(again) - mean) / float(rest)
            if m == BASIS:
                break
            basis = cut(held.select("id", F.concat("v", F.array(new)).alias("v")))
            drop(held)
        basis = cut(held.select("id", F.array(*(_combined(vectors[:, k]) for k in range(KEPT)), new).alias("v")))
        drop(held)
        matrix = np.diag(values[:KEPT])
    raise RuntimeError(f"no eigenvector within {tolerance} after {rounds} restarts")


def _lanczos_here(graph: Graph, rounds: int, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """The rounds of ``_lanczos`` for a graph that fits the driver: ids, values."""
    known = whole(graph)
    n = len(known.ids)
    basis = np.zeros((BASIS, n))
    x = np.random.default_rng(n).random(n)
    x -= x.mean()
    basis[0] = x / np.linalg.norm(x)
    matrix = np.zeros((0, 0))
    for _ in range(rounds):
        while True:
            m = len(matrix) + 1
            x = known.laplacian(basis[m - 1])
            first = basis[:m] @ x
            x -= first @ basis[:m] + x.mean()
            again = basis[:m] @ x
            x -= again @ basis[:m] + x.mean()
            rest = np.linalg.norm(x)
            matrix = np.pad(matrix, (0, 1))
            matrix[:, -1] = matrix[-1, :] = first + again
            values, vectors = np.linalg.eigh(matrix)
            if rest * abs(vectors[-1, 0]) <= tolerance:
                return known.ids, vectors[:, 0] @ basis[:m]
            if m == BASIS:
                break
            basis[m] = x / rest
        basis[:KEPT] = vectors[:, :KEPT].T @ basis
        basis[KEPT] = x / rest
        matrix = np.diag(values[:KEPT])
    raise RuntimeError(f"no eigenvector within {tolerance} after {rounds} restarts")


def _signed(spark, ids, vector: np.ndarray) -> DataFrame:
    """id, value, the first entry that isn't 0 positive."""
    lead = vector[np.flatnonzero(np.abs(vector) > 1e-9)[:1]]
    if len(lead) and lead[0] < 0:
        vector = -vector
    return spark.createDataFrame(pa.table({"id": pa.array(ids, pa.int64()), "value": pa.array(vector, pa.float64())}))


def fiedler(graph: Graph, rounds: int = 60, tolerance: float = 1e-8) -> DataFrame:
    """id, value: an eigenvector of the second smallest eigenvalue, its first entry that isn't 0
    positive. Large graphs: Lanczos rounds, each a join, or on the driver if it holds the graph; an error if ``rounds`` restarts leave a
    residual over ``tolerance``."""
    n = graph.size
    spark = graph.vertices.sparkSession
    if n < 2:
        return spark.createDataFrame([], "id long, value double")
    if n <= DENSE:
        ids, matrix = _dense(graph)
        return _signed(spark, ids, np.linalg.eigh(matrix)[1][:, 1])
    if n <= HERE and fits(graph):
        return _signed(spark, *_lanczos_here(graph, rounds, tolerance))
    x = _lanczos(graph, rounds, tolerance)
    lead = x.where(F.abs("value") > 1e-9).agg(F.min_by("value", "id")).first()[0]
    return x.select("id", (-F.col("value")).alias("value")) if (lead or 0.0) < 0 else x


def algebraic_connectivity(graph: Graph) -> float:
    """The second smallest eigenvalue; 0 below two vertices."""
    if graph.size < 2:
        return 0.0
    if graph.size <= DENSE:
        return max(0.0, eigenvalues(graph)[1])
    return rayleigh(graph, fiedler(graph)).first()[0]


def order(graph: Graph, by: DataFrame | None = None) -> DataFrame:
    """id, position by the Fiedler vector; ``by``: that vector, if it is known."""
    return ranked(fiedler(graph) if by is None else by, "value", "id", name="position").select("id", "position")
