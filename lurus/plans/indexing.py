"""Consecutive row numbers without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lurus.plans.session import checkpointed


def row_index(df: DataFrame, *by: str, name: str = "i") -> DataFrame:
    """Adds 0, 1, 2, ... in the order of the columns, which must identify rows. Range partitions are numbered each by itself; the offsets are one row a partition."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id())
    rows = checkpointed(parts.withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.col("_part").cast("long"), 33)))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    return rows.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + F.col("_at")).drop("_part", "_at", "_offset")
