"""The bounded queue of interaction events, in batches and as a stream."""

import json
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.iterate import cut

#: Events kept of each window.
KEPT = 200
TYPES = ("level_changed", "selection_changed", "click", "double_click", "key_down", "resize", "window_closed")


def newest(events: DataFrame, key: str, order, kept: int = KEPT) -> DataFrame:
    """The ``kept`` newest events of each key, oldest first by ``place``."""
    seen = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    rows = events.withColumn("_n", F.row_number().over(seen)).where(F.col("_n") <= kept)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).drop("_n")


def averaged(events: DataFrame, key: str, order, value: str, alpha: float = 0.1) -> DataFrame:
    """key, ema: the moving average of each key's values in order: the first, then old (1 - alpha) +
    new alpha.

    Events are range-partitioned by key and order. Each partition reduces a key's events to
    their number and weighted sum, and those few rows a key are put together, so a key with
    most of the events spans many tasks."""
    names = [str(c) for c in order]
    rows = events.select(F.col(key).alias("_key"), F.col(value).cast("double").alias("_value"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(names)])
    by = [f"_o{i}" for i in range(len(names))]
    parts = cut(rows.repartitionByRange("_key", *by).withColumn("_part", F.spark_partition_id()))
    age = F.row_number().over(Window.partitionBy("_part", "_key").orderBy(*[F.desc(c) for c in by])) - 1
    decay = lambda n: F.pow(F.lit(1 - alpha), n)
    runs = parts.withColumn("_age", age).groupBy("_key", "_part").agg(F.sum(alpha * decay(F.col("_age")) * F.col("_value")).alias("_sum"), F.count("*").alias("_n"), F.max_by("_value", "_age").alias("_first"))
    later = Window.partitionBy("_key").orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_later", F.coalesce(F.sum("_n").over(later), F.lit(0)))
    whole = runs.groupBy("_key").agg(F.sum(F.col("_sum") * decay(F.col("_later"))).alias("_sum"), F.sum("_n").alias("_n"), F.min_by("_first", "_part").alias("_first"))
    return whole.select(F.col("_key").alias(key), (F.col("_sum") + decay(F.col("_n")) * F.col("_first")).alias("ema"))  # the first weighs 1, not alpha


def drained(stream: DataFrame, key: str = "window", kept: int = KEPT) -> DataFrame:
    """For a stream with ``key``, timestamp (epoch ms) and any other columns: each trigger drains
    the queue. It gives the key, how many events came since the last one, the newest kept of
    them as JSON, oldest first, and how many have come in all; the queue is then empty."""
    columns = [c for c in stream.columns if c != key]

    def update(group, frames, state):
        queue, came = [], 0
        for frame in frames:
            came += len(frame)
            queue = sorted(queue + json.loads(frame[columns].to_json(orient="records")), key=lambda e: e["timestamp"])[-kept:]
        total = came + (state.get[0] if state.exists else 0)
        state.update((total,))
        yield pd.DataFrame({key: [group[0]], "came": [came], "queue": [json.dumps(queue)], "total": [total]})

    return stream.groupBy(key).applyInPandasWithState(update, f"{key} string, came long, queue string, total long", "total long", "update", "NoTimeout")


class Queue:
    """The newest ``kept`` events of each window, on the driver; what is drained is gone."""

    def __init__(self, kept: int = KEPT):
        self.kept = kept
        self.waiting: dict[str, deque] = {}

    def post(self, window: str, type_: str, timestamp: int, **more) -> None:
        if type_ not in TYPES:
            raise ValueError(f"unknown event {type_!r}")
        self.waiting.setdefault(window, deque(maxlen=self.kept)).append({"window": window, "type": type_, "timestamp": timestamp, **more})

    def drain(self, window: str) -> list[dict]:
        return list(self.waiting.pop(window, ()))
