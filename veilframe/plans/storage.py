"""Cutting lineage by written tables in the folder that all executors share.

Such tables may hold clear text. scratch() removes those written within it; the others go when the session's process
ends, and none outlives it.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: The tables of each scratch() that is open, innermost last.
_OPEN: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset: a folder of our own in local mode (tests), else an error, as no other folder is known to be shared."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="veilframe-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        root = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _place(spark: SparkSession, path: str):
    """The file system that holds a path, and the path in it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed at the end of scratch(), or of the process: a folder is made there, as the JVM's hook looks for what is there now."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    fs, p = _place(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again; the table is removed at the end of scratch(), or of the process."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that operators write within it are removed at its end, also after an error; results must have been written or collected by then."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            fs, p = _place(spark, path)
            fs.delete(p, True)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its scan has fewer splits, as a small table in one file has; larger ones stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
