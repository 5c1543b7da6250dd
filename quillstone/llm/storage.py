"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from quillstone.sources.staging import shared_root


def modest(spark: SparkSession, size: str = "4m") -> None:
    """Smaller Arrow batches for the scans of texts, as a batch is held several times over: in the
    executor, in the pipe and in the Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def fresh(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder, with its file system, deleted when the driver's JVM ends."""
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.deleteOnExit(target)
    # Readers outside Spark must not take a path of the default file system for a local one.
    return re.sub("^file:/(?!/)", "file:///", system.makeQualified(target).toString())


def spare(frame: DataFrame, name: str) -> str:
    """`name`, or with underscores before it a name that no column of `frame` has in any case."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def cut(frame: DataFrame, label: str = "step") -> DataFrame:
    """The frame written as a table in the shared folder and read back: its lineage ends there,
    so later stages neither recompute it nor depend on the executors that made it."""
    spark = frame.sparkSession
    path = fresh(spark, label)
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
