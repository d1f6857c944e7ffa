from __future__ import annotations

from pyspark.sql import functions as F

from plinth.operators.tables import Store
from plinth.streaming.jobs import event_stream, latest_state, upsert_stream, windowed_counts


def test_upserts_like_a_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.select(F.lit("r").alias("repository_id"), F.concat(F.lit("f"), (F.col("event_id") % 7).cast("string")).alias("file_id"), F.col("event_type").alias("relative_path"), F.lit("python").alias("language"), F.lit(".py").alias("extension"), F.col("event_id").alias("size_bytes"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "db"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    upsert_stream(stream, store, "source_files", "size_bytes", str(tmp_path / "cp")).awaitTermination()
    assert store.read("source_files").count() == 7


def test_latest_state_of_a_stream(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    q = latest_state(event_stream(spark, str(tmp_path / "in"), events.schema), "user_id", "ts", "event_type").writeStream.outputMode("complete").format("memory").queryName("states").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("states").collect()} == {tuple(r) for r in latest_state(events, "user_id", "ts", "event_type").collect()}


def test_windows(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert windowed_counts(events).agg(F.sum("n")).first()[0] == events.count()
