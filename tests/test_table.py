"""The table layer on the small fixtures of its model."""

import pytest
from pyspark.sql import functions as F

from quillstone.operators import table as T
from quillstone.sources.snapshots import read_snapshot, verify, write_snapshot


@pytest.fixture
def users(spark):
    db = T.Database(spark)
    table = db.register("users", {"id": "int64", "name": "string(32)", "age": "int32", "city": "string(32)"})
    table.insert_batch([{"name": n, "age": a, "city": c} for n, a, c in (("Alice", 25, "Beijing"), ("Alice", 30, "Shanghai"), ("Bob", 25, "Beijing"), ("Bob", 30, "Shanghai"))])
    yield table
    db.close()


def test_where_returns_all_matches(users):
    assert users.count() == 4
    assert users.where(name="Alice").count() == 2
    assert users.where(name="Alice", age__gt=25).count() == 1
    assert users.where(age__lt=25).count() == 0


def test_update_and_delete(users):
    assert users.update(1, name="Carol")
    assert users.where(name="Alice").count() == 1
    assert users.delete(2)
    assert users.where(name="Alice").count() == 0
    assert users.count() == 3
    assert not users.delete(99999) and not users.update(99999, age=1)
    assert users.find(0) is None and users.find(99999) is None


def test_order_limit_offset(users):
    assert [r.id for r in users.select(order="age", ascending=False, limit=2, offset=1).collect()] == [4, 1]
    assert users.select(order="age", offset=100).collect() == []


def test_compaction_renumbers_and_keeps_content(users):
    users.database.auto_compact = 0
    users.delete(2)
    assert users.compact() == 1
    rows = users.frame.orderBy("_rowid").collect()
    assert [r._rowid for r in rows] == [1, 2, 3] and [r.name for r in rows] == ["Alice", "Bob", "Bob"]
    assert users.compact() == 0


def test_auto_compaction(spark):
    db = T.Database(spark, auto_compact=0.3)
    t = db.register("auto", {"id": "int64", "v": "double"})
    t.insert_batch([{"v": float(i)} for i in range(3)])
    t.delete(1)
    assert t.frame.where("_deleted").count() == 0 and t.count() == 2
    db.close()


def test_guard_and_registration(spark):
    db = T.Database(spark, max_rows=0)
    t = db.register("g", {"id": "int64", "name": "string"})
    assert t.where().collect() == []
    t.insert(name="Test")
    with pytest.raises(T.ResultTooLarge):
        t.where()
    with pytest.raises(ValueError):
        db.register("g", {"id": "int64"})
    assert db.drop("g") and not db.drop("g") and db.table("g") is None


def test_transactions(users):
    db = users.database
    db.begin()
    users.delete(1)
    db.register("other", {"id": "int64"})
    with pytest.raises(RuntimeError):
        db.begin()
    db.rollback()
    assert users.count() == 4 and db.table("other") is None
    db.begin()
    users.delete(1)
    db.commit()
    assert users.count() == 3


def test_joins_return_every_pair(spark):
    people = spark.createDataFrame([(1, "Alice", 10), (2, "Bob", 10), (3, "Eve", 20)], "id long, name string, dept long")
    depts = spark.createDataFrame([(10, "a"), (10, "b"), (30, "c")], "id long, name string")
    assert T.equi_join(people, "p", "dept", depts, "d", "id").count() == 4
    assert T.named(depts, "d").columns == ["d.id", "d.name"]


def test_replay_is_idempotent(spark):
    log = spark.createDataFrame([(1, 1, 7, "a"), (2, 2, 7, "b"), (3, 1, 8, "c"), (4, 3, 8, "c"), (2, 2, 7, "b")], "lsn long, op int, key long, v string")
    once = T.replay(log, "key")
    assert [(r.key, r.v) for r in once.collect()] == [(7, "b")]
    assert T.replay(once, "key").collect() == once.collect()


def test_snapshots(spark, users, tmp_path):
    root = f"file://{tmp_path}"
    first = write_snapshot(spark, root, {"users": users.frame})
    write_snapshot(spark, root, {"users": users.frame.where("_rowid > 1")})
    assert read_snapshot(spark, root)["users"].count() == 3
    assert read_snapshot(spark, root, first)["users"].count() == 4
    users.frame.write.parquet(f"{root}/copy")
    assert verify(spark, f"{root}/copy", users.frame) and not verify(spark, f"{root}/copy", users.frame.where("_rowid > 1"))


def test_numbering_over_many_partitions(spark):
    from quillstone.operators.ranking import numbered

    rows = numbered(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")), "v", name="n", partitions=13)
    assert rows.where("n <> v + 1").count() == 0 and rows.count() == 1000
