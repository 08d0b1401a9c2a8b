"""A database behind JDBC as a sink and source."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, url: str, table: str, mode: str = "append", connections: int = 8, batch: int = 10_000, options: Mapping[str, str] | None = None) -> None:
    """Writes rows to a table over at most ``connections`` connections, ``batch`` rows a round trip.

    Each partition is a transaction of its own, so a task that is tried again after its commit brings its rows twice: facts are keyed
    by ``Fact_ID`` for that reason, and dimensions are written whole. ``overwrite`` empties the table and keeps its definition.
    """
    if connections <= 0 or batch <= 0:
        raise ValueError("connections and batch must be positive")
    writer = df.coalesce(connections).write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", batch).option("truncate", "true")
    writer.options(**dict(options or {})).mode(mode).save()


def read_table(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8, options: Mapping[str, str] | None = None) -> DataFrame:
    """A table, read in ``partitions`` ranges of a numeric ``key`` between its ``bounds`` where these are given; rows outside are read too."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**dict(options or {}))
    if key is not None and bounds is not None:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return reader.load()
