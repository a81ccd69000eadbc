"""Mapping reads as they arrive: an extension, in place of reading by chunks.

Reads stream in as Parquet files and meet a fixed index; each micro-batch is mapped like a batch and written for its
epoch, so a batch that is tried again replaces its own output. Counts of contacts are kept as a table of partial counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadloom.operators.mapping import anchor_hits, best_target, colinear, contacts, majority_strand, target_support, zip_mates


def stream_reads(spark: SparkSession, path: str, schema: str = "read_idx long, seq string", files: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def map_stream(reads: DataFrame, index: DataFrame, k: int, out: str, checkpoint: str) -> StreamingQuery:
    """Maps each micro-batch and writes it under its epoch in out; ends when the input is used up."""

    def batch(df: DataFrame, epoch: int) -> None:
        best_target(target_support(colinear(majority_strand(anchor_hits(df, index, k))), k)).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return reads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def contact_stream(mates: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """From a stream of mapped pairs (read_idx, target1, same1, target2, same2), the partial contact counts of each epoch."""

    def batch(df: DataFrame, epoch: int) -> None:
        sides = [df.select("read_idx", F.col(f"target{i}").alias("target"), F.col(f"same{i}").alias("same")) for i in (1, 2)]
        contacts(zip_mates(*sides)).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return mates.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def total_contacts(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out).groupBy("i", "j").agg(F.sum("fwd").alias("fwd"), F.sum("bwd").alias("bwd"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events (ts, event_type) counted by window, with a watermark for late ones."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
