"""Live counters: events by day and action, kept current with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions.time import ZONE
from tallyhouse.operators.versions import Tables


def read_events(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """The events table as a stream; ts becomes an instant, as watermarks need one (the session zone is UTC)."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """(window, event_type, n) per Chicago day, as wall time; days are final once the watermark has passed them."""
    walled = events.withColumn("wall", F.from_utc_timestamp("ts", ZONE)).withWatermark("wall", late)
    return walled.groupBy(F.window("wall", "1 day"), "event_type").agg(F.count("*").alias("n"))


def run_counts(events: DataFrame, path: str, checkpoint: str) -> None:
    """Take what is there, append finished days to a Parquet table at path, and stop."""
    q = daily_counts(events).select(F.col("window.start").alias("day"), "event_type", "n").writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def count_into(tables: Tables, name: str = "counters", writer: str = "counters") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that adds a batch of events (ts as an instant, event_type, user_id) to the counter table (user_id, day, event_type, n).

    The batch is summed up first, then joined with the counters it touches; the next snapshot is committed with the batch's number, so a batch that is replayed after a
    failure changes nothing.
    """

    def add(batch: DataFrame, number: int) -> None:
        new = batch.withColumn("day", F.to_date(F.from_utc_timestamp("ts", ZONE))).groupBy("user_id", "day", "event_type").agg(F.count("*").alias("n"))

        def change(old: dict[str, DataFrame | None]) -> dict[str, DataFrame]:
            rows = new if old[name] is None else old[name].unionByName(new)
            return {name: rows.groupBy("user_id", "day", "event_type").agg(F.sum("n").alias("n"))}

        tables.update(change, [name], writer, number)

    return add


def run_counters(events: DataFrame, tables: Tables, checkpoint: str) -> None:
    """Add what is there to the counter table, batch by batch, and stop."""
    events.writeStream.foreachBatch(count_into(tables)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
