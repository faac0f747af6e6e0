"""Folders that driver and executors share, and small files in them, by whatever file system the address names."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: str | None = None


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder under the session's spark.checkpoint.dir, removed when the session ends; a session in one JVM may go without the setting."""
    global _own
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if _own is None:
            _own = tempfile.mkdtemp(prefix="tallyhouse-")
            atexit.register(shutil.rmtree, _own, ignore_errors=True)
        top = f"file://{_own}"
    path = f"{top.rstrip('/')}/tallyhouse/{label}-{uuid.uuid4().hex}"
    system, at = file_system(spark, path)
    system.deleteOnExit(at)
    return path


def file_system(spark: SparkSession, path: str):
    """(file system, path) of an address, as Hadoop has them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def read_text(spark: SparkSession, path: str) -> str:
    system, at = file_system(spark, path)
    stream = system.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file whole or not at all; False if there is one already."""
    system, at = file_system(spark, path)
    system.mkdirs(at.getParent())
    draft = spark._jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{uuid.uuid4().hex}")
    stream = system.create(draft, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if not system.exists(at) and system.rename(draft, at):
        return True
    system.delete(draft, False)
    return False


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no folder."""
    system, at = file_system(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(at)) if system.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    system, at = file_system(spark, path)
    system.delete(at, True)
