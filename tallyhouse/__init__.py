"""Spark-native analytics over time-stamped listings, counters and feeds."""
