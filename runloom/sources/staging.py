"""Written intermediate tables in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where that is unset (tests, one machine) a folder of our own."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.runloom.dir", None)
    if not known:
        known = f"file://{tempfile.mkdtemp(prefix='runloom-')}"
        spark.conf.set("spark.runloom.dir", known)
    return known.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, order: str, number: str) -> DataFrame:
    """df with the dense rank of the distinct values of ``order``, from 0, without bringing them to one task: values are
    range-partitioned and sorted, and each partition counts on from those before it."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = df.select(order).distinct().repartitionByRange(n, order).sortWithinPartitions(order)
    local = staged(values.withColumn("local", F.monotonically_increasing_id()).withColumn("part", F.shiftright("local", 33)), "ranks")
    counts = local.groupBy("part").agg(F.count("*").alias("size"))
    before = counts.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = local.join(before, "part").select(order, (F.col("before") + F.col("local").bitwiseAND((1 << 33) - 1)).alias(number))
    return df.join(numbered, order)
