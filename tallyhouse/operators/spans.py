"""Spans of days: guards, expansion, islands and merged intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXPANSION_DAYS = 14


def guarded_end(start: Column, end: Column) -> Column:
    """end, or null if it lies before start."""
    return F.when(end >= start, end)


def covered_days(start: Column, end: Column, most: int = EXPANSION_DAYS) -> Column:
    """The days of a span; a span of more than `most` days is its first day only."""
    last = F.coalesce(end, start)
    return F.when(F.datediff(last, start) + 1 <= most, F.sequence(start, F.greatest(start, last))).otherwise(F.array(start))


def islands(rows: DataFrame, keys: list[str], day: str, gap: int = 1) -> DataFrame:
    """(keys, start_day, end_day, n_days): runs of distinct days at most `gap` apart."""
    order = Window.partitionBy(*keys).orderBy(day)
    days = rows.select(*keys, day).distinct()
    fresh = F.coalesce((F.datediff(F.col(day), F.lag(day).over(order)) > gap).cast("int"), F.lit(1))
    numbered = days.withColumn("__new", fresh).withColumn("__run", F.sum("__new").over(order))
    return numbered.groupBy(*keys, "__run").agg(F.min(day).alias("start_day"), F.max(day).alias("end_day"), F.count("*").alias("n_days")).drop("__run")


def merged(rows: DataFrame, keys: list[str], start: str, end: str, gap: int = 0) -> DataFrame:
    """(keys, start_day, end_day, n_spans): spans joined while the next starts at most `gap` days after all before have ended."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce((F.datediff(F.col(start), reach) > gap).cast("int"), F.lit(1))
    numbered = rows.withColumn("__new", fresh).withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*keys, "__run").agg(F.min(start).alias("start_day"), F.max(end).alias("end_day"), F.count("*").alias("n_spans")).drop("__run")
