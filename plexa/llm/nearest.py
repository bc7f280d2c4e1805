"""Exact top-k inner products by a pivot-distance index.

Vectors get one more component that makes all norms equal, so that the largest
inner product is the smallest distance. The index keys every vector by its
nearest pivot and its distance to it, and is range-partitioned and sorted by
that key; a pivot that is nearest to many vectors spans many partitions. A
query expands a pivot's annuli from its own distance outwards and stops once
the triangle inequality shows that no vector further out can beat its k-th
best. Pivots and first bounds come from a bounded sample; every row is indexed
and the result is exact.

Components x become floor(256 * x). Null vectors, and those that hold a null or
a non-finite component, take no part. Vectors that are shorter than others
count as filled up with zeros. Equal scores go to the smaller vec_id. A row is
never its own result, nor is another row of the same vec_id. Rows of one vec_id
are one vector: as a query the least of them, as a result the one of the
highest score. No vectors give no rows. Other columns are not looked at.

Queries are answered in blocks of bounded size. A block holds queries of the same
pivots; the distances at which these can find anything bound a range of the sorted
index for each pivot, and files outside of all ranges are not read.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import stored

K = 5
#: Queries that one pass over the index answers; so many vectors are broadcast at most.
BLOCK = 2048
SAMPLE = 2048
PIVOTS = 32
ANNULUS = 512
#: Vectors of a partition of the index.
PART = 8192


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array of double, floor(256 * x)) of the vectors that take part."""
    fine = "embedding is not null and vec_id is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(cast(x as double)) < double('Infinity'))"
    return vectors.where(fine).selectExpr("cast(vec_id as long) vec_id", "transform(embedding, x -> cast(floor(256D * cast(x as double)) as double)) v")


def _matrix(column, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = values
    return out


def _lifted(x: np.ndarray, top: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(0, top - np.einsum("ij,ij->i", x, x)))
    return np.concatenate([x, rest[:, None]], 1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b) - 2 * a @ b.T
    return np.sqrt(np.maximum(0, square))


def pivots(sample: np.ndarray, count: int = PIVOTS, rounds: int = 8) -> np.ndarray:
    """Centres of ``sample`` by Lloyd's rounds."""
    points = np.unique(sample, axis=0)
    centres = points[:: max(1, len(points) // count)][:count].copy()
    for _ in range(rounds):
        near = _distances(points, centres).argmin(1)
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = points[near == c].mean(0)
    return centres


class Best:
    """The k best (score, smaller id) of each of some queries."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.score = np.full((len(ids), k), -np.inf)
        self.found = np.zeros((len(ids), k), np.int64)
        self.real = np.zeros((len(ids), k), bool)

    def offer(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray, least: np.ndarray) -> None:
        """``scores`` of ``ids`` for the queries numbered ``queries``; those under ``least`` don't matter."""
        good = (scores >= np.maximum(least, self.score[queries, -1])[:, None]) & (ids != self.ids[queries, None])
        q, c = np.nonzero(good)
        if not len(q):
            return
        mine = np.unique(queries[q])
        of = np.concatenate([queries[q], np.repeat(mine, self.k)])
        score = np.concatenate([scores[q, c], self.score[mine].ravel()])
        found = np.concatenate([ids[c], self.found[mine].ravel()])
        real = np.concatenate([np.ones(len(q), bool), self.real[mine].ravel()])
        order = np.lexsort((-score, found, ~real, of))  # of a vector that came more than once the best counts
        of, score, found, real = of[order], score[order], found[order], real[order]
        once = ~real | np.concatenate([[True], (of[1:] != of[:-1]) | (found[1:] != found[:-1])])
        of, score, found, real = of[once], score[once], found[once], real[once]
        order = np.lexsort((found, -score, of))
        of, score, found, real = of[order], score[order], found[order], real[order]
        mine, at = np.unique(of, return_index=True)
        self.score[mine], self.real[mine] = -np.inf, False
        rank = np.arange(len(of)) - np.repeat(at, np.diff(at, append=len(of)))
        top = rank < self.k
        self.score[of[top], rank[top]] = score[top]
        self.found[of[top], rank[top]] = found[top]
        self.real[of[top], rank[top]] = real[top]


class Index(tuple):
    """(table, width, largest squared norm, pivots, sample)."""


def build(vectors: DataFrame, count: int = PIVOTS, sample: int = SAMPLE) -> Index | None:
    """The index of all of ``vectors``, stored; None if there are none."""
    spark = vectors.sparkSession
    rows = valid(vectors)
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("top")).first()
    if not facts["n"]:
        return None
    width, top = facts["width"], float(facts["top"])
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    known = _matrix(got.column("v"), width)
    shared = spark.sparkContext.broadcast(pivots(_lifted(known, top), count))

    def keyed(batches):
        for batch in batches:
            d = _distances(_lifted(_matrix(batch.column("v"), width), top), shared.value)
            near = d.argmin(1)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(near)), near]), batch.column("vec_id"), batch.column("v")], ["pivot", "dist", "vec_id", "v"])

    keys = rows.mapInArrow(keyed, "pivot int, dist double, vec_id long, v array<double>")
    parts = math.ceil(facts["n"] / PART)
    table = stored(keys.repartitionByRange(parts, "pivot", "dist", "vec_id").sortWithinPartitions("pivot", "dist"), "pivots")
    return Index((table, width, top, shared, (got.column("vec_id").to_numpy(), known)))


def search(index: Index, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best. ``queries``: vec_id and v,
    answered in blocks of bounded size, each a pass over the files of the index that can hold results."""
    table, width, top, shared, (sample_ids, sample) = index
    spark = table.sparkSession

    def nearest(batches):
        for batch in batches:
            q = _matrix(batch.column("v"), width)
            near = _distances(np.concatenate([q, np.zeros((len(q), 1))], 1), shared.value).argmin(1)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), batch.column("vec_id"), batch.column("v")], ["pivot", "vec_id", "v"])

    once = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    once = stored(once.select("vec_id", "v").mapInArrow(nearest, "pivot int, vec_id long, v array<double>"), "queries")
    # a pivot of many queries has blocks of its own; those of few share one
    blocks, room = [], 0
    for row in once.groupBy("pivot").agg(F.count("*").alias("n")).orderBy("pivot").collect():
        parts = math.ceil(row["n"] / (BLOCK * 3 / 4))
        if parts > 1:
            blocks += [(F.col("pivot") == row["pivot"]) & (F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == k) for k in range(parts)]
            room = 0
        elif room >= row["n"]:
            blocks[-1], room = blocks[-1] | (F.col("pivot") == row["pivot"]), room - row["n"]
        else:
            blocks.append(F.col("pivot") == row["pivot"])
            room = BLOCK - row["n"]
    found = None
    for chosen in blocks:
        own = once.where(chosen).orderBy("vec_id").toArrow()
        ids, q = own.column("vec_id").to_numpy(), _matrix(own.column("v"), width)
        best = Best(ids, k)
        best.offer(np.arange(len(ids)), q @ sample.T, sample_ids, np.full(len(ids), -np.inf))
        block = spark.sparkContext.broadcast((ids, q, best.score[:, -1].copy()))

        def expand(batches, block=block):
            ids, q, least = block.value
            centres = shared.value
            lifted = np.concatenate([q, np.zeros((len(q), 1))], 1)
            to_pivot = _distances(lifted, centres)
            square = np.einsum("ij,ij->i", q, q) + top
            best = Best(ids, k)
            everyone = np.arange(len(ids))
            for batch in batches:
                x, vec, dist = _matrix(batch.column("v"), width), batch.column("vec_id").to_numpy(), batch.column("dist").to_numpy()
                pivot = batch.column("pivot").to_numpy()
                borders = [0, *(np.flatnonzero(np.diff(pivot)) + 1), len(pivot)]
                for start, end in zip(borders, borders[1:], strict=False):
                    if start == end:
                        continue
                    d, dq = dist[start:end], to_pivot[:, pivot[start]]
                    low = np.arange(0, end - start, ANNULUS)
                    high = np.minimum(low + ANNULUS, end - start)
                    inner = np.minimum.reduceat(d, low)
                    outer = np.maximum.reduceat(d, low)
                    gap = np.maximum(0, np.maximum(inner - dq[:, None], dq[:, None] - outer))
                    order = gap.argsort(1, kind="stable")
                    for step in range(len(low)):
                        at = order[:, step]
                        reach = np.sqrt(np.maximum(0, square - 2 * np.maximum(least, best.score[:, -1]))) * (1 + 1e-9) + 1e-6
                        alive = gap[everyone, at] <= reach
                        if not alive.any():
                            break
                        for a in np.unique(at[alive]):
                            who = np.flatnonzero(alive & (at == a))
                            rows = slice(start + low[a], start + high[a])
                            best.offer(who, q[who] @ x[rows].T, vec[rows], least[who])
            who, place = np.nonzero(best.real)
            yield pa.RecordBatch.from_arrays([pa.array(ids[who]), pa.array(best.found[who, place]), pa.array(best.score[who, place].astype(np.int64))], ["query_id", "vec_id", "score"])

        # what a query can reach beside a pivot, from its distance to it and its k-th best in the sample
        away = _distances(np.concatenate([q, np.zeros((len(q), 1))], 1), shared.value)
        reach = np.sqrt(np.maximum(0, np.einsum("ij,ij->i", q, q) + top - 2 * best.score[:, -1])) * (1 + 1e-9) + 1e-6
        low, high = (away - reach[:, None]).min(0), (away + reach[:, None]).max(0)
        within = None
        for c in range(len(low)):
            if np.isfinite(high[c]):
                inside = (F.col("pivot") == c) & F.col("dist").between(float(low[c]), float(high[c]))
                within = inside if within is None else within | inside
        part = (table if within is None else table.where(within)).mapInArrow(expand, "query_id long, vec_id long, score long")
        found = part if found is None else found.unionAll(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, every: int = 50, k: int = K) -> DataFrame:
    """``search`` over ``vectors`` for its own rows whose vec_id is divisible by ``every``."""
    index = build(vectors)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return search(index, index[0].where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "v"), k)
