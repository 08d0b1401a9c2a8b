"""Monthly files dropped into a folder, resolved as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ledgerloom.plans.pipeline import resolve_all


def resolve_stream(spark: SparkSession, folder: str, schema: StructType, dimensions: dict[str, DataFrame], out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Each micro-batch of new parquet files is resolved like a monthly file, by the whole cascade, and written under its batch number.

    A batch that is run again overwrites its own output, so every file counts exactly once.
    """
    def load(rows: DataFrame, batch: int) -> None:
        resolve_all(rows, dimensions, learn=False)[0].write.mode("overwrite").parquet(f"{out}/batch={batch}")

    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
