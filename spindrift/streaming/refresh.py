"""Structured Streaming on top of the batch refresh: a stream of listings keeps a snapshot of the metadata. An addition of
this package; batch semantics are those of operators.sync."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import sync


def event_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """(start, event_type, n) of a stream (ts, event_type), by event time, with a bound for late rows."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n")


def refreshing(listings: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """A writer that merges every batch of listings (project, source, external_id, ordinal, title, url, modified_at) into
    the snapshots under `folder`. Each batch writes its own snapshot and counters, named by its number, from the one
    before; a batch that is repeated after a failure writes the same again."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        listing = sync.first_seen(batch)
        before = f"{folder}/snapshot-{number - 1}"
        if number:
            stored = spark.read.parquet(before)
        else:
            stored = listing.select(*sync.KEY, "title", "url", "modified_at").withColumn("document_id", F.lit(None).cast("string")).withColumn("last_synced_at", F.current_timestamp()).where("false")
        changes = sync.diff(stored, listing)
        sync.counters(changes).write.mode("overwrite").parquet(f"{folder}/counters-{number}")
        sync.merged(stored, listing, F.current_timestamp()).write.mode("overwrite").parquet(f"{folder}/snapshot-{number}")

    return listings.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
