"""Versioned snapshots: immutable directories of Parquet tables and a pointer to the current one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_snapshot(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> str:
    """Writes the tables under a new version, then the pointer; readers see either version whole."""
    version = uuid.uuid4().hex
    for name, frame in tables.items():
        frame.write.parquet(f"{root}/versions/{version}/{name}")
    names = ",".join(sorted(tables))
    last = current(spark, root)
    row = spark.createDataFrame([((last[0] if last else 0) + 1, version, names)], "n long, version string, tables string")
    row.coalesce(1).write.mode("append").json(f"{root}/pointer")
    return version


def current(spark: SparkSession, root: str, version: str | None = None):
    """(number, version, table names) of a snapshot, the latest by default; None without any."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/pointer")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    rows = spark.read.schema("n long, version string, tables string").json(f"{root}/pointer")
    rows = rows if version is None else rows.where(F.col("version") == version)
    row = rows.orderBy(F.desc("n")).first()
    return (row.n, row.version, row.tables.split(",")) if row else None


def read_snapshot(spark: SparkSession, root: str, version: str | None = None) -> dict[str, DataFrame]:
    found = current(spark, root, version)
    if found is None:
        raise FileNotFoundError(f"no snapshot in {root}")
    return {name: spark.read.parquet(f"{root}/versions/{found[1]}/{name}") for name in found[2]}


def export(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").parquet(path)


def verify(spark: SparkSession, path: str, frame: DataFrame, *key: str) -> bool:
    """Whether the exported rows are those of the frame, by count and an order-free sum of row hashes."""
    def digest(f: DataFrame):
        return f.agg(F.count("*"), F.sum(F.xxhash64(*sorted(f.columns)).cast("decimal(38,0)"))).first()

    return tuple(digest(spark.read.parquet(path))) == tuple(digest(frame))
