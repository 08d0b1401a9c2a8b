"""Gapless numbers over a whole table without sorting it in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import cut


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "ordinal", start: int = 1) -> DataFrame:
    """Adds ``name``: start, start + 1, ... in the given order, which should be total.

    Rows are split by range, the ranges are written, each range is numbered on its own and moved on by the
    rows before it; only one count per range is gathered. An empty table stays empty.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    ranged = cut(df.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = counts.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_part").orderBy(*keys)
    placed = ranged.withColumn("_k", F.row_number().over(within)).join(F.broadcast(offsets), F.col("_part") == F.col("_p"))
    return placed.withColumn(name, (F.col("_offset") + F.col("_k") - 1 + F.lit(start)).cast("bigint")).drop("_part", "_k", "_p", "_offset")
