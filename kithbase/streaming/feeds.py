"""Changes and presence as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.enums import online


def presence_overlay(events: DataFrame, key: str, time: str, state: str, lateness: str = "1 hour") -> DataFrame:
    """The latest state of each key as a streaming aggregate; state older than the watermark is dropped for keys without news only in append-free modes (use update or complete)."""
    last = F.max_by(F.col(state), F.col(time))
    return events.withWatermark(time, lateness).groupBy(key).agg(last.alias("presenceState"), F.max(time).alias("modified")).withColumn("isOnline", online(F.col("presenceState")))


def change_feed(changes: DataFrame, time: str, kind: str, window: str = "1 minute", lateness: str = "10 minutes") -> DataFrame:
    """Notifications batched by window: how many of each kind, and their ids."""
    return changes.withWatermark(time, lateness).groupBy(F.window(time, window), kind).agg(F.count(F.lit(1)).alias("n"), F.collect_set("contactId").alias("contactIds"))


def into_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Writes every micro-batch as a new version of the overlay; a batch that runs twice overwrites itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(put).start()
