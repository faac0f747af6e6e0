"""Integer vectors, for operators whose centroids must be exact whatever the order of addition."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components are held between minus and plus this after scaling, so that squared distances and sums stay exact in 64 bits.
LIMIT = 1 << 23


def finite(vector: str) -> Column:
    """Whether the vector is there and none of its components is null, infinite or not a number."""
    return F.expr(f"`{vector}` IS NOT NULL AND NOT exists(`{vector}`, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity'))")


def scaled(vector: str, scale: int) -> Column:
    """Each component x as the integer floor(scale * x), x as double, held within LIMIT."""
    return F.expr(f"transform(`{vector}`, x -> cast(floor(greatest({-float(LIMIT)}D, least({float(LIMIT)}D, {float(scale)}D * cast(x AS double)))) AS int))")


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of an Arrow list column, all `width` long, as 64-bit integers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def common_length(rows: DataFrame, vector: str, divisor: int = 1) -> int:
    """The most frequent length of the vectors that is a multiple of divisor, the smaller of equals; 0 if there is none."""
    sizes = rows.groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n")).where((F.col("d") > 0) & (F.col("d") % divisor == 0))
    first = sizes.orderBy(F.desc("n"), "d").first()
    return first["d"] if first else 0


def sums_by(rows: DataFrame, key: str, value: str, name: str, salts: int = 32) -> DataFrame:
    """rows with `name`: the sum of `value` over the rows of equal `key`, nulls together.

    The sums, a row a key, are small beside rows; each is repeated for every salt, so that a key which holds a third of all rows is
    joined in as many tasks, whatever join Spark picks.
    """
    totals = rows.groupBy(F.col(key).alias("__key")).agg(F.sum(value).alias(name)).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("__s", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    return salted.join(totals, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__s") == F.col("__salt"))).drop("__key", "__salt", "__s")
