"""Streaming wrappers: keyed upserts by micro-batch, and the latest state of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plinth.operators.tables import Store

# States of an index job in their order.
STATES = ("pending", "indexing", "ready", "failed")


def upsert_stream(stream: DataFrame, store: Store, table: str, order: str, checkpoint: str) -> StreamingQuery:
    """Every micro-batch is merged into ``table``; a batch that runs again gives the same table."""

    def merge(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.upsert(table, batch, F.col(order).desc())

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def latest_state(events: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """The last value of each key; works on a stream (update or complete mode) and on a table alike."""
    return events.groupBy(key).agg(F.max(F.struct(F.col(at).alias("at"), F.col(value).alias("value"))).alias("last")).select(key, F.col("last.at").alias(at), F.col("last.value").alias(value))


def windowed_counts(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events of each type in tumbling windows; late rows count within ``delay``."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def numbered_events(events: DataFrame, by: str, *order) -> DataFrame:
    """Ordered events with a sequence number within each key, as they go to a client."""
    from plinth.operators.ranking import ranked

    return ranked(events, [by], *order, name="seq")
