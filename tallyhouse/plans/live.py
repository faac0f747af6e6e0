"""Streams over the events, run until they have taken all that is there, and what they leave."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.operators.versions import Tables
from tallyhouse.plans.base import Registered, query
from tallyhouse.plans.engagement import QUERIES as ENGAGEMENT
from tallyhouse.sources.shared import shared_folder
from tallyhouse.streaming.counters import read_events, run_counters
from tallyhouse.streaming.limiter import run_limiter

QUERIES: dict[str, Registered] = {}


@query(QUERIES, ENGAGEMENT["hit_limiter"].sql.replace("SELECT event_id, user_id, ts, n, n <= 30 AS allowed FROM f", "SELECT event_id, user_id, n, n <= 30 AS allowed FROM f"))
def live_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limiter as live state, over the events as a stream: 30 hits per user in 60 minutes."""
    out = shared_folder(spark, "limiter")
    hits = read_events(spark, sf_dir).select(F.col("user_id").cast("string").alias("bucket"), F.col("event_id").alias("id"), "ts")
    run_limiter(spark, hits, f"{out}/counted", f"{out}/checkpoint", 30)
    return spark.read.parquet(f"{out}/counted").select(F.col("id").alias("event_id"), F.col("bucket").cast("bigint").alias("user_id"), "n", "allowed")


@query(QUERIES, "SELECT user_id, CAST(timezone('America/Chicago', timezone('UTC', ts)) AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def live_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counter table that a stream of events keeps, one versioned snapshot a batch."""
    out = shared_folder(spark, "counters")
    tables = Tables(spark, f"{out}/tables")
    run_counters(read_events(spark, sf_dir).select("user_id", "event_type", "ts"), tables, f"{out}/checkpoint")
    return tables.read("counters")
