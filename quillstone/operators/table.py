"""Typed tables: filters, order, limit, joins, row changes and maintenance as DataFrame rewrites.

A managed table carries _rowid (from 1) and _deleted beside its fields.  Every
operation returns a new DataFrame; nothing is collected unless rows are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions.text import within_bytes

#: Field types by name.
TYPES = {
    "int32": T.IntegerType(), "int64": T.LongType(), "uint64": T.DecimalType(20, 0), "float": T.FloatType(), "double": T.DoubleType(),
    "string": T.StringType(), "varstring": T.StringType(), "bool": T.BooleanType(),
}
OPERATORS = {"eq": lambda c, v: c == v, "gt": lambda c, v: c > v, "lt": lambda c, v: c < v, 0: lambda c, v: c == v, 1: lambda c, v: c > v, 2: lambda c, v: c < v}
INSERT, UPDATE, DELETE = 1, 2, 3
#: Ids of a range that one task numbers anew.
RANGE_IDS = 1_000_000


class ResultTooLarge(Exception):
    """A query has more rows than the table's max_rows."""


def where_clause(**conditions) -> Column:
    """age=25, age__gt=25, age__lt=25, all of them; no condition is true."""
    tests = []
    for name, value in conditions.items():
        field, _, op = name.partition("__")
        if op and op not in OPERATORS:
            raise ValueError(f"unknown operator {op}")
        tests.append(OPERATORS[op or "eq"](F.col(field), value))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def where_list(conditions: list[dict]) -> Column:
    """[{field, value, op}], op one of =, >, < or 0, 1, 2; an unknown op is equality."""
    names = {"=": 0, ">": 1, "<": 2}
    return reduce(lambda a, b: a & b, [OPERATORS.get(names.get(c.get("op", 0), c.get("op", 0)), OPERATORS[0])(F.col(c["field"]), c["value"]) for c in conditions], F.lit(True))


def schema_of(fields: dict[str, str]) -> T.StructType:
    """Fields by type name; an id is put first when missing."""
    fields = fields if "id" in fields else {"id": "int64", **fields}
    return T.StructType([T.StructField(n, TYPES[t.split("(")[0]], False) for n, t in fields.items()])


def fixed_string(text: Column, size: int) -> Column:
    """A string field of `size` bytes keeps size - 1 of them, on a character boundary."""
    return within_bytes(text, size - 1)


def managed(frame: DataFrame, *order: str) -> DataFrame:
    """`frame` with _rowid in the given total order and _deleted false.

    The numbering counts rows per range partition and adds up the counts, so no task sees all rows."""
    from quillstone.operators.ranking import numbered

    return numbered(frame, *order, name="_rowid").withColumn("_deleted", F.lit(False))


def live(table: DataFrame) -> DataFrame:
    return table.where(~F.col("_deleted"))


def scan(table: DataFrame) -> DataFrame:
    """All live rows without the bookkeeping columns."""
    return live(table).drop("_rowid", "_deleted")


def select(frame: DataFrame, condition: Column | None = None, order: str | None = None, ascending: bool = True, limit: int = 0, offset: int = 0, tie: tuple[str, ...] = ()) -> DataFrame:
    """Filter, order by one field (ties by `tie`), skip and cut; a limit of 0 is none."""
    out = frame if condition is None else frame.where(condition)
    if order:
        out = out.orderBy(F.asc(order) if ascending else F.desc(order), *tie)
    if offset:
        out = out.offset(offset)
    return out.limit(limit) if limit else out


def guarded(frame: DataFrame, max_rows: int) -> DataFrame:
    """`frame`, or ResultTooLarge with more than max_rows rows; only max_rows + 1 rows are looked at."""
    if frame.limit(max_rows + 1).count() > max_rows:
        raise ResultTooLarge(f"more than {max_rows} rows")
    return frame


def within(frame: DataFrame, max_rows: int) -> DataFrame:
    """One row, within: whether the guard would let the frame pass."""
    return frame.limit(max_rows + 1).agg((F.count("*") <= max_rows).alias("within"))


def stream(frame: DataFrame) -> Iterator:
    """Rows one by one, a partition at a time; stop by leaving the loop."""
    return frame.toLocalIterator(prefetchPartitions=True)


def named(frame: DataFrame, table: str, separator: str = ".") -> DataFrame:
    """Columns as <table>.<field>."""
    return frame.select(*(F.col(f"`{c}`").alias(f"{table}{separator}{c}") for c in frame.columns))


def equi_join(left: DataFrame, left_name: str, left_key: str, right: DataFrame, right_name: str, right_key: str, separator: str = "_") -> DataFrame:
    """Every matching pair of rows, columns by table; Spark picks the join strategy from sizes."""
    a, b = named(left, left_name, separator), named(right, right_name, separator)
    return a.join(b, F.col(f"`{left_name}{separator}{left_key}`") == F.col(f"`{right_name}{separator}{right_key}`"))


def chain_join(first: DataFrame, first_name: str, *steps: tuple[str, DataFrame, str, str], separator: str = "_") -> DataFrame:
    """Joins in turn: (column of the result so far, frame, its table name, its key)."""
    out = named(first, first_name, separator)
    for column, frame, name, key in steps:
        out = out.join(named(frame, name, separator), F.col(f"`{column}`") == F.col(f"`{name}{separator}{key}`"))
    return out


def insert(table: DataFrame, rows: DataFrame, *order: str) -> DataFrame:
    """`rows` numbered after the largest _rowid, in the given order."""
    top = table.agg(F.coalesce(F.max("_rowid"), F.lit(0)).alias("_top"))
    fresh = managed(rows, *order).crossJoin(F.broadcast(top)).withColumn("_rowid", F.col("_rowid") + F.col("_top")).drop("_top")
    return table.unionByName(fresh)


def update(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Live rows replaced by those of `rows` (with _rowid and all fields); ids that are absent or deleted change nothing."""
    fields = [c for c in table.columns if c not in ("_rowid", "_deleted")]
    new = rows.select("_rowid", F.lit(True).alias("_new"), *(F.col(c).alias(f"_new_{c}") for c in fields))
    hit = F.coalesce(F.col("_new"), F.lit(False)) & ~F.col("_deleted")
    return table.join(new, "_rowid", "left").select("_rowid", "_deleted", *(F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in fields)).select(*table.columns)


def delete(table: DataFrame, ids: DataFrame | Column) -> DataFrame:
    """Marks rows as deleted, by a condition or by a frame of _rowid."""
    if isinstance(ids, Column):
        return table.withColumn("_deleted", F.col("_deleted") | F.coalesce(ids, F.lit(False)))
    gone = ids.select("_rowid", F.lit(True).alias("_gone")).distinct()
    return table.join(gone, "_rowid", "left").withColumn("_deleted", F.col("_deleted") | F.coalesce("_gone", F.lit(False))).drop("_gone")


def compact(table: DataFrame) -> DataFrame:
    """Deleted rows dropped and ids dense again, in the old order.

    Old ids are dense, so ranges of them are even without sampling: a row's new id is its place among the kept rows
    of its range after the kept rows of the ranges before.  One shuffle by range; a row a range meets in one task."""
    kept = live(table)
    top = kept.agg(F.max("_rowid")).first()[0] or 0
    span = min(RANGE_IDS, max(1, -(-top // int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    ranged = kept.withColumn("_range", F.floor((F.col("_rowid") - 1) / span))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("_range").agg(F.count("*").alias("_c")).select("_range", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy("_rowid"))
    numbered = ranged.withColumn("_place", place).join(F.broadcast(before), "_range")
    return numbered.withColumn("_rowid", F.col("_place") + F.col("_before")).select(*table.columns)


def deleted_ratio(table: DataFrame) -> DataFrame:
    """deleted_ratio over all ids given out."""
    return table.agg((F.count_if(F.col("_deleted")) / F.max("_rowid")).alias("deleted_ratio"))


def compact_due(table: DataFrame, threshold: float = 0.3) -> bool:
    """Whether the share of deleted ids reaches the threshold; 0 or less never does."""
    ratio = deleted_ratio(table).first().deleted_ratio
    return threshold > 0 and ratio is not None and ratio >= threshold


def log_records(rows: DataFrame, op: int, first_lsn: int, *order: str) -> DataFrame:
    """lsn, op, body (the row as JSON), crc of changed rows, numbered from first_lsn in the given order."""
    from quillstone.operators.ranking import numbered

    body = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    made = numbered(rows, *order, name="_lsn").select((F.col("_lsn") + first_lsn - 1).alias("lsn"), F.lit(op).alias("op"), body.alias("body"))
    return made.withColumn("crc", F.crc32(F.col("body").cast("binary")))


def append_log(log_path: str, records: DataFrame) -> None:
    """Appends log_records; files of one append become visible together, when its job commits."""
    records.write.mode("append").parquet(log_path)


def logged_rows(log: DataFrame, schema: str) -> DataFrame:
    """lsn, op and the fields of the sound records of a log (lsn, op, body, crc)."""
    return valid_log(log).select("lsn", "op", F.from_json("body", schema).alias("_r")).select("lsn", "op", "_r.*")


def replay(log: DataFrame, *key: str) -> DataFrame:
    """The rows that a change log (lsn, op 1 insert, 2 update, 3 delete, fields) leaves: the last change of
    each key, deletions dropped.  Replaying twice gives the same rows; of records with one lsn, one counts."""
    last = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("lsn"), F.desc("op")))
    return log.withColumn("_n", last).where("_n = 1").drop("_n").where(F.col("op") != DELETE)


def valid_log(log: DataFrame, body: str = "body", crc: str = "crc") -> DataFrame:
    """Records whose CRC-32 is that of their body."""
    return log.where(F.crc32(F.col(body).cast("binary")) == F.col(crc))


def check(frame: DataFrame) -> DataFrame:
    """rows, max_rowid, deleted, sound: whether the counters fit together."""
    return frame.agg(
        F.count("*").alias("rows"), F.coalesce(F.max("_rowid"), F.lit(0)).alias("max_rowid"), F.count_if(F.col("_deleted")).alias("deleted"),
        ((F.count("*") <= F.coalesce(F.max("_rowid"), F.lit(0))) & (F.count("*") == F.count_distinct("_rowid"))).alias("sound"),
    )


class Table:
    """One registered table of a Database."""

    def __init__(self, database: Database, name: str, fields: dict[str, str] | None, frame: DataFrame):
        self.database, self.name, self.fields, self.frame = database, name, fields, frame

    def _store(self, frame: DataFrame) -> None:
        self.frame = frame
        self.database._store(self.name, frame)
        if self.database.auto_compact > 0 and compact_due(frame, self.database.auto_compact):
            self.frame = compact(frame)
            self.database._store(self.name, self.frame)

    def insert(self, **values) -> int:
        return self.insert_batch([values])[0]

    def insert_batch(self, rows: list[dict]) -> list[int]:
        """Rows in the order given; returns their ids, which also become the field id where there is one."""
        top = self.frame.agg(F.coalesce(F.max("_rowid"), F.lit(0)).alias("t")).first().t
        ids = [int(top) + i + 1 for i in range(len(rows))]
        spark, kinds = self.frame.sparkSession, {f.name: f.dataType for f in self.frame.schema}
        blank = {"string": "", "boolean": False, "double": 0.0, "float": 0.0}
        made = []
        for i, row in zip(ids, rows, strict=True):
            full = {n: row.get(n, blank.get(t.simpleString(), 0)) for n, t in kinds.items() if not n.startswith("_")}
            if "id" in full and not row.get("id"):
                full["id"] = i
            for n, t in (self.fields or {}).items():
                if t.startswith("string(") and isinstance(full[n], str):
                    full[n] = full[n].encode()[: int(t[7:-1]) - 1].decode(errors="ignore")
            made.append(tuple(i if n == "_rowid" else False if n == "_deleted" else full[n] for n in kinds))
        self._store(self.frame.unionByName(spark.createDataFrame(made, self.frame.schema)))
        return ids

    def find(self, row_id: int):
        """The live row with that id, or None."""
        return live(self.frame).where(F.col("_rowid") == row_id).drop("_rowid", "_deleted").first()

    def where(self, **conditions) -> DataFrame:
        return guarded(scan(self.frame).where(where_clause(**conditions)), self.database.max_rows)

    def select(self, **options) -> DataFrame:
        return guarded(select(live(self.frame), tie=("_rowid",), **options).drop("_rowid", "_deleted"), self.database.max_rows)

    def update(self, row_id: int, **values) -> bool:
        """Changes fields of a live row; False if there is none."""
        if self.find(row_id) is None:
            return False
        hit = F.col("_rowid") == row_id
        self._store(self.frame.select(*(F.when(hit, F.lit(values[c])).otherwise(F.col(c)).cast(t.dataType).alias(c) if c in values else F.col(c) for c, t in ((f.name, f) for f in self.frame.schema))))
        return True

    def delete(self, row_id: int) -> bool:
        if self.find(row_id) is None:
            return False
        self._store(delete(self.frame, F.col("_rowid") == row_id))
        return True

    def count(self) -> int:
        return live(self.frame).count()

    def compact(self) -> int:
        """Drops deleted rows; returns how many."""
        gone = self.frame.where("_deleted").count()
        if gone and self.count():
            self.frame = compact(self.frame)
            self.database._store(self.name, self.frame)
        return gone

    def create_index(self, *fields: str) -> None:
        """Sorts the stored rows by up to four fields, so that row groups can be skipped; answers never change."""
        if not 1 <= len(fields) <= 4:
            raise ValueError("an index has one to four fields")
        self.frame = self.frame.sortWithinPartitions(*fields)
        self.database._store(self.name, self.frame)


class Database:
    """A registry of tables with single-level transactions and snapshots on a path."""

    def __init__(self, spark: SparkSession, path: str | None = None, max_rows: int = 10_000, auto_compact: float = 0.3):
        self.spark, self.path, self.max_rows, self.auto_compact = spark, path, max_rows, auto_compact
        self.tables: dict[str, Table] = {}
        self._saved: dict[str, DataFrame] | None = None

    def _store(self, name: str, frame: DataFrame) -> None:
        frame.createOrReplaceTempView(name)

    def register(self, name: str, fields: dict[str, str] | None = None, frame: DataFrame | None = None, order: tuple[str, ...] = ()) -> Table:
        """A new table, empty by field types or over a frame; a name can be taken once."""
        if name in self.tables:
            raise ValueError(f"table {name} exists")
        if frame is None:
            schema = T.StructType([T.StructField("_rowid", T.LongType()), *(T.StructField(f.name, f.dataType) for f in schema_of(fields)), T.StructField("_deleted", T.BooleanType())])
            frame = self.spark.createDataFrame([], schema)
        else:
            frame = managed(frame, *(order or tuple(frame.columns)))
        self.tables[name] = Table(self, name, fields, frame)
        self._store(name, frame)
        return self.tables[name]

    def table(self, name: str) -> Table | None:
        return self.tables.get(name)

    def drop(self, name: str) -> bool:
        self.spark.catalog.dropTempView(name)
        return self.tables.pop(name, None) is not None

    def begin(self) -> None:
        if self._saved is not None:
            raise RuntimeError("a transaction is open")
        self._saved = {n: t.frame for n, t in self.tables.items()}

    def commit(self) -> None:
        self._saved = None

    def rollback(self) -> None:
        """Back to the frames at begin; tables registered since are dropped."""
        for name in list(self.tables):
            if name not in (self._saved or {}):
                self.drop(name)
        for name, frame in (self._saved or {}).items():
            self.tables[name].frame = frame
            self._store(name, frame)
        self._saved = None

    def checkpoint(self) -> str:
        """Writes all tables as a new snapshot and returns its version."""
        from quillstone.sources.snapshots import write_snapshot

        return write_snapshot(self.spark, self.path, {n: t.frame for n, t in self.tables.items()})

    def restore(self, version: str | None = None) -> None:
        """Tables of a snapshot, the latest without a version."""
        from quillstone.sources.snapshots import read_snapshot

        for name, frame in read_snapshot(self.spark, self.path, version).items():
            self.tables[name] = Table(self, name, None, frame)
            self._store(name, frame)

    def close(self) -> None:
        for name in list(self.tables):
            self.drop(name)
