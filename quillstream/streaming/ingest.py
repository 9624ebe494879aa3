"""The batch operators as streams: files are taken as they come and merged per micro-batch. Beyond what the lake needs, windows over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..operators import changefeed, merge


def follow(spark: SparkSession, folder: str, schema: str, checkpoint: str, each: Callable[[DataFrame, int], None], fmt: str = "parquet", per_trigger: int = 100) -> None:
    """Everything that a folder holds now, in micro-batches, each handed over once; what was seen is remembered in ``checkpoint``."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(fmt).load(folder)
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def fold_changes(spark: SparkSession, folder: str, schema: str, table: str, checkpoint: str, key: str, seq: str, op: str, payload: list[str], usable: Column | None = None, buckets: int = 256) -> DataFrame:
    """A table kept current from a folder of change files. A micro-batch reads and writes the buckets that it touches; one that is delivered again changes nothing, for equal sequences lose."""
    state = changefeed.Buckets(spark, table, buckets)
    follow(spark, folder, schema, checkpoint, lambda batch, _epoch: state.apply(changefeed.changes(batch, key, seq, op, payload, usable)) and None)
    now = state.read()
    return changefeed.changes(spark.createDataFrame([], schema), key, seq, op, payload) if now is None else now


def once_only(spark: SparkSession, folder: str, schema: str, table: str, checkpoint: str, keys: list[str], order: list[Column]) -> DataFrame:
    """At-least-once files to exactly-once rows: per batch the first of each key, and of those the ones not stored yet."""

    def each(batch: DataFrame, _epoch: int) -> None:
        new = merge.keep_first(batch, keys, order)
        try:
            new = merge.insert_only(storage.current(spark, table), new, keys)
        except FileNotFoundError:
            pass
        storage.publish(new, table)

    follow(spark, folder, schema, checkpoint, each)
    return storage.current(spark, table)


def windowed_counts(events: DataFrame, at: str, by: str, width: str = "1 hour", lateness: str = "72 hours") -> DataFrame:
    """Counts by window and kind with a cut-off for lateness; works on streams and tables alike."""
    return events.withWatermark(at, lateness).groupBy(F.window(at, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def sessions(events: DataFrame, at: str, by: str, gap: str = "30 minutes", lateness: str = "72 hours") -> DataFrame:
    """Sessions of each key: events less than ``gap`` apart belong together."""
    return events.withWatermark(at, lateness).groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")
