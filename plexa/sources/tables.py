"""Graphs derived from the star-schema tables. Edges that take a join or a sort of a large table are
stored once, as the operators read them again and again."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import Graph, build
from ..plans.iterate import cut, drop

#: Added to part keys where they share a vertex space with suppliers.
PART_OFFSET = 1_000_000_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def following(events: DataFrame) -> DataFrame:
    """src, dst: each event's user and the next event's, over all events in (ts, event_id) order.

    The next event is looked up within a range partition; a partition's last event takes the
    first user of the next partition, so only one row a partition meets in one task."""
    e = cut(events.select("user_id", "ts", "event_id").repartitionByRange("ts", "event_id").withColumn("part", F.spark_partition_id()), clean=True)
    order = F.struct("ts", "event_id")
    inside = e.withColumn("next", F.lead("user_id").over(Window.partitionBy("part").orderBy("ts", "event_id")))
    parts = e.groupBy("part").agg(F.min_by("user_id", order).alias("first"), F.max_by("user_id", order).alias("src"))
    between = parts.withColumn("dst", F.lead("first").over(Window.orderBy("part"))).select("src", "dst")
    return inside.select(F.col("user_id").alias("src"), F.col("next").alias("dst")).unionAll(between).where("dst is not null")


def succession(spark: SparkSession, sf_dir: str) -> Graph:
    """Directed: user -> user of the next event. The pairs are distinct and no loops, so they are the
    edges as they stand: no reader of the graph shuffles them again."""
    steps = following(_table(spark, sf_dir, "events"))
    pairs = cut(steps.where("src <> dst").distinct(), clean=True)
    drop(steps)  # the ordered events
    edges = pairs.select(F.xxhash64("src", "dst").alias("eid"), "src", "dst", F.lit(1.0).alias("weight"))
    return Graph(build(pairs, True).vertices, edges, True, "succession")


def copurchase(spark: SparkSession, sf_dir: str, least: int = 2) -> Graph:
    """Undirected: parts that share at least ``least`` orders; weight: the orders shared."""
    item = _table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p")).distinct()
    pairs = item.select("l_orderkey", F.col("p").alias("src")).join(item.select("l_orderkey", F.col("p").alias("dst")), "l_orderkey").where("src < dst")
    edges = pairs.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight")).where(F.col("weight") >= least)
    return build(cut(edges), False, title="copurchase")


def trade(spark: SparkSession, sf_dir: str, targets: int = 3) -> Graph:
    """Directed: supplier nation -> its ``targets`` largest other customer nations; weight: the
    price sum. Nations are a fixed, small table."""
    item, orders = _table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "orders")
    supplier, customer = _table(spark, sf_dir, "supplier"), _table(spark, sf_dir, "customer")
    flow = (
        item.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("s_nationkey").cast("long").alias("src"), F.col("c_nationkey").cast("long").alias("dst"))
        .agg((F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")) / 100.0).alias("weight")).where("src <> dst")
    )
    best = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst"))
    nation = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("label"))
    return build(flow.withColumn("n", best).where(F.col("n") <= targets).drop("n"), True, nation, "trade")


def supply(spark: SparkSession, sf_dir: str) -> Graph:
    """Undirected and bipartite: supplier - part."""
    pairs = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + PART_OFFSET).alias("dst")).distinct()
    return build(pairs, False, title="supply")
