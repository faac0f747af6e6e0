"""Wall time in America/Chicago: every comparison of days happens in that frame."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "America/Chicago"


def wall(ts: Column) -> Column:
    """A TIMESTAMP_NTZ in UTC as TIMESTAMP_NTZ wall time."""
    return F.convert_timezone(F.lit("UTC"), F.lit(ZONE), ts)


def day(ts: Column) -> Column:
    """The Chicago calendar day of a TIMESTAMP_NTZ in UTC."""
    return F.to_date(wall(ts))
