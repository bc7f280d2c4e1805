"""Spectra of a metric's sorted values, and moving averages."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.iterate import ranked


#: Values that one task transforms at a time, about.
TASK = 1 << 18


def spectrum(data: DataFrame, sort: bool = True, value: str = "value") -> DataFrame:
    """index, frequency, magnitude of the first half of the transform of the values without their
    mean, filled up with zeros to a power of two; magnitudes by its length. No rows below
    four values.

    The length is cut in two factors: the values are laid out as a table, its columns
    transformed, turned by their place, and then its rows. So a task holds some columns or
    rows, about the square root of the length each, never all values."""
    spark, n = data.sparkSession, data.count()
    kind = "index long, frequency double, magnitude double"
    if n < 4:
        return spark.createDataFrame([], kind)
    bits = (n - 1).bit_length()
    size, high = 1 << bits, 1 << (bits // 2)
    wide = size // high
    columns, rows = max(1, TASK // high), max(1, TASK // wide)
    order = [F.col("v").asc()] if sort else [F.col("id").asc()]
    placed = ranked(data.select(F.col(value).cast("double").alias("v"), *([] if sort else ["id"])), *order)
    mean = data.agg(F.avg(F.col(value).cast("double"))).first()[0]
    cells = placed.select((F.col("rank") % wide).alias("column"), F.floor(F.col("rank") / wide).alias("row"), (F.col("v") - mean).alias("re"))

    def down(frame: pd.DataFrame) -> pd.DataFrame:
        first = frame["column"].iloc[0] // columns * columns
        count = min(columns, wide - first)
        x = np.zeros((high, count))
        x[frame["row"], frame["column"] - first] = frame["re"]
        row, column = np.meshgrid(np.arange(high), first + np.arange(count), indexing="ij")
        y = np.fft.fft(x, axis=0) * np.exp(-2j * np.pi * row * column / size)
        return pd.DataFrame({"row": row.ravel(), "column": column.ravel(), "re": y.real.ravel(), "im": y.imag.ravel()})

    def across(frame: pd.DataFrame) -> pd.DataFrame:
        first = frame["row"].iloc[0] // rows * rows
        count = min(rows, high - first)
        x = np.zeros((count, wide), complex)
        x[frame["row"] - first, frame["column"]] = frame["re"] + 1j * frame["im"]
        y = np.abs(np.fft.fft(x, axis=1)) / size
        index = (first + np.arange(count))[:, None] + high * np.arange(wide)
        kept = index < size // 2
        return pd.DataFrame({"index": index[kept], "frequency": index[kept] / size, "magnitude": y[kept]})

    turned = cells.groupBy(F.floor(F.col("column") / columns)).applyInPandas(down, "row long, column long, re double, im double")
    return turned.groupBy(F.floor(F.col("row") / rows)).applyInPandas(across, kind)


def peaks(spectrum_: DataFrame, threshold: float = 0.1, most: int = 10) -> DataFrame:
    """The inner indexes over ``threshold`` of the largest magnitude and at least as large as both
    neighbours, largest first."""
    m = spectrum_.select("index", "frequency", "magnitude")
    left, right = (m.select((F.col("index") + d).alias("index"), F.col("magnitude").alias(n)) for d, n in ((1, "left"), (-1, "right")))
    top = m.agg(F.max("magnitude").alias("top"))
    near = m.join(left, "index").join(right, "index").crossJoin(F.broadcast(top))  # one row
    return near.where((F.col("magnitude") > threshold * F.col("top")) & (F.col("magnitude") >= F.col("left")) & (F.col("magnitude") >= F.col("right"))).orderBy(F.desc("magnitude"), "index").limit(most).select("index", "frequency", "magnitude")


def ema(samples: Column, alpha: float = 0.1) -> Column:
    """The moving average after all of an array of samples: the first, then old (1 - alpha) + new alpha."""
    return F.aggregate(F.slice(samples, 2, F.greatest(F.size(samples) - 1, F.lit(0))), F.get(samples, F.lit(0)), lambda a, x: a * (1 - alpha) + x * alpha)


def running(data: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``data`` with ``total``: the running sum by key."""
    return data.withColumn("total", F.sum(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
