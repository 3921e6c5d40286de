"""Streaming ingest: payloads that arrive in a folder become records of the store, a batch at a time; and windowed counts.

Preparing payloads is stateless. Versions, near duplicates and pruning depend on what is stored, so each micro-batch
goes through the same upsert as a batch; a batch that ran before changes nothing, as its checksums are stored already.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import schema


def payload_stream(spark: SparkSession, folder: str, form: str = "json") -> DataFrame:
    return spark.readStream.schema(schema.PAYLOAD).format(form).load(folder)


def ingest_stream(service, payloads: DataFrame, checkpoint: str, once: bool = False):
    """A running query that upserts every micro-batch of payloads into the service's store."""

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("seq", F.coalesce("seq", F.monotonically_increasing_id()))
        service.upsert_frame(rows)

    w = payloads.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events and the sum of their values by window and type, with a bound on lateness; for streams and tables alike."""
    x = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return x.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
