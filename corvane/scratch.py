"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for tables that cut lineage.

    It is the session's ``spark.checkpoint.dir``. Where that is unset, a local
    master gets a folder of its own; a cluster without the setting is an error,
    because its executors could not see each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "root" not in _OWN:
        _OWN["root"] = tempfile.mkdtemp(prefix="corvane-")
        atexit.register(shutil.rmtree, _OWN["root"], ignore_errors=True)
    return "file://" + _OWN["root"]


def _located(spark: SparkSession, path: str):
    """The file system and path of Hadoop's library."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _located(spark, path)
    return system.exists(target)


def delete(spark: SparkSession, path: str) -> None:
    system, target = _located(spark, path)
    system.delete(target, True)


class Scratch:
    """Parquet tables in the shared folder; they cut lineage and outlive executors.

    ``save`` writes and rereads a table, ``append`` adds rows to one that ``table``
    reads, ``drop`` removes one that nothing reads any more. What a returned DataFrame
    still reads stays until the driver ends, whose file system then deletes it.
    """

    RELEASE_SECONDS = 2.0
    _released = 0.0

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{scratch_root(spark)}/corvane/{label}-{uuid.uuid4().hex[:12]}"
        self.names: set[str] = set()
        self.schemas: dict = {}

    def append(self, df: DataFrame, name: str) -> None:
        df.write.mode("append").parquet(f"{self.path}/{name}")
        if not self.names:
            system, target = _located(self.spark, self.path)
            system.deleteOnExit(target)
        self.names.add(name)
        self.schemas[name] = df.schema
        self.release()

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.path}/{name}")

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.append(df, name)
        return self.table(name)

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, f"{self.path}/{name}")
            self.names.discard(name)

    def result(self, df: DataFrame) -> DataFrame:
        """Saves what an operator returns and removes all else."""
        out = self.save(df, "result")
        self.drop(*(self.names - {"result"}))
        return out

    def release(self) -> None:
        """Let Spark's cleaner remove the shuffle files of finished jobs, once in a while."""
        if time.monotonic() - Scratch._released < self.RELEASE_SECONDS:
            return
        Scratch._released = time.monotonic()
        gc.collect()
        self.spark._jvm.System.gc()
