"""Structured Streaming over the same operators: new documents into chunks, traces into windowed statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quernstone.operators import chunking

DOCUMENTS = "doc_id bigint, title string, folder string, source string, loader string, lang string, text string, n_chars bigint, content string, created_at timestamp_ntz"
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def chunk_stream(documents: DataFrame, path: str, checkpoint: str, size: int = 900, overlap: int = 120) -> StreamingQuery:
    """Chunks of arriving documents, appended to ``path``; a repeated batch writes its own folder again, so the result
    stays exactly once when an executor or the driver is lost."""

    def write(batch: DataFrame, number: int) -> None:
        chunking.chunks(batch, "doc_id", "content", size, overlap).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def trace_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Number and mean value of events by type and tumbling window; events later than ``late`` are left out."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    g = timed.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    return g.select(F.col("w.start").alias("hour"), "event_type", "n", "mean_value")


def distinct_events(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events without repeated deliveries of an id within the watermark."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])
