"""Helpers for plans that loop, and for global ranks."""

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``, which all executors share.

    A temporary folder stands in only where driver and executors are one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = "file://" + os.path.join(tempfile.gettempdir(), "plexa-checkpoints")
    spark.sparkContext.setCheckpointDir(path)
    return path


#: Spark removes the shuffle files of a query once it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, clean: bool = False) -> DataFrame:
    """``df`` written to the shared folder and read again; ``clean``: the shuffle files of the write go with it.

    The new plan is a scan: its lineage is one table, which outlives lost executors, and its
    size is that of the files. A checkpoint would keep the old plan's size estimate, which
    doubles in length each time a loop joins a table with what it was made from."""
    spark = df.sparkSession
    path = f"{folder(spark)}/plexa-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    if clean:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if clean:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame | None) -> None:
    """Deletes tables made by ``cut`` that no plan still in use reads."""
    for table in tables:
        files = table.inputFiles() if table is not None else []
        if not files:
            continue
        spark = table.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(os.path.dirname(files[0]))
        if at.getName().startswith("plexa-"):
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def ranked(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """``df`` with ``name``: the row's place (from 0) in the total order ``order``.

    Rows are range-partitioned and numbered within their partition; the partitions'
    offsets (one row each) are all that meets in one task. Rows that ``order`` can't tell
    apart stay in one partition, so an order over values that recur should go on to a key."""
    parts = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_size"))
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn("_place", place).join(F.broadcast(offsets.select("_part", "_offset")), "_part").withColumn(name, (F.col("_place") + F.col("_offset")).cast("long")).drop("_part", "_place", "_offset")


def cumulated(counts: DataFrame, key: str, weight: str, name: str) -> DataFrame:
    """``counts`` (one row a key) with ``name``: the sum of ``weight`` over all smaller keys."""
    parts = cut(counts.repartitionByRange(key).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.sum(weight).alias("_size"))
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum(weight).over(Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("_inside", inside).join(F.broadcast(offsets.select("_part", "_offset")), "_part").withColumn(name, F.col("_inside") + F.col("_offset")).drop("_part", "_inside", "_offset")
