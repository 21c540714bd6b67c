"""Vintages and windows from a stream of events, with bounded state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema: str, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def tumbling(events: DataFrame, at: str, keys: Sequence[str], width: str, late: str) -> DataFrame:
    """(keys, start, n, total) of tumbling windows of a stream with a `value`; rows later than `late` after the newest are left out, and state goes with them."""
    return events.withWatermark(at, late).groupBy(*keys, F.window(at, width).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(*keys, F.col("w.start").alias("start"), "n", "total")


def first_versions(events: DataFrame, at: str, keys: Sequence[str], late: str) -> DataFrame:
    """Rows of a stream, each key once within the time that late rows may take."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there now, append it to Parquet at path, and stop; a later call goes on from the checkpoint."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
