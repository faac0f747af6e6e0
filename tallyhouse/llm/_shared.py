"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space: what separates words in every operator here.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only a session that runs in one JVM may go without the setting; it gets a temporary folder.
    """
    global _local_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local") or spark.conf.get("spark.master", "local").startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="tallyhouse-")
        atexit.register(shutil.rmtree, _local_dir, ignore_errors=True)
    return f"file://{_local_dir}"


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, removed when the session ends."""
    path = f"{shared_dir(spark)}/tallyhouse/{label}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    Cuts the lineage without relying on any executor's memory or disk.
    """
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows and bytes of an Arrow batch. Every operator uses the same bound, so it doesn't matter which of them has set it.
BATCH_ROWS, BATCH_BYTES = 500, "8m"


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches between JVM and Python by rows and bytes, as texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def parts(spark: SparkSession, amount: int, each: int) -> int:
    """Partitions for an amount of rows or bytes: `each` a partition, but no fewer than the session's shuffles have."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-amount // each))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unit(*cols: Column | str, seed: int = 0) -> Column:
    """A uniform number in (0, 1) that depends on the columns alone: 52 bits of an MD5 digest."""
    text = F.concat_ws("\x1f", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("\x1e")) for c in cols])
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def with_next(rows: DataFrame, order: list[str], each: int = 1_000_000) -> DataFrame:
    """rows with `next`: a struct of the columns `order` of the row that follows in that order (null first), after the last the first.

    Narrow rows with distinct keys. Spark draws the borders of the ranges from a sample of the keys, so an outlying key makes no
    range longer; within each a window looks ahead, and a row a range joins them. The result doesn't depend on the ranges.
    """
    keys = [F.col(c).asc_nulls_first() for c in order]
    count = parts(rows.sparkSession, rows.count(), each)
    placed = materialise(rows.repartitionByRange(count, *keys).withColumn("__range", F.spark_partition_id()), "ordered")
    key = F.struct(*order)
    firsts = placed.groupBy("__range").agg(F.min(key).alias("first"))
    after = firsts.select(F.col("__range").alias("__of"), F.coalesce(F.lead("first").over(Window.orderBy("__range")), F.min("first").over(Window.partitionBy())).alias("__then"))
    inside = placed.withColumn("next", F.lead(key).over(Window.partitionBy("__range").orderBy(*keys)))
    # a row a range: as many as there are partitions
    joined = inside.join(F.broadcast(after), F.col("__range") == F.col("__of"))
    return joined.withColumn("next", F.coalesce("next", "__then")).drop("__range", "__of", "__then")
