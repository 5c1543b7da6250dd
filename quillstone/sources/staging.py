"""Staging tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a temporary one in local mode and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not hasattr(shared_root, "own"):
            shared_root.own = tempfile.mkdtemp(prefix="quillstone-")
        root = f"file://{shared_root.own}"
    return root.rstrip("/")


def staged(frame: DataFrame, label: str = "staged") -> DataFrame:
    """The frame written once and read back, for values that must not be computed twice, such as the
    numbers of partitions; the table goes when the driver's JVM ends."""
    spark = frame.sparkSession
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
