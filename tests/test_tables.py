"""Stored tables: which files a write touches, and batches that run again."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import mutate
from lodestone.operators.tables import StoredTable


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"s{k % 4}" if k % 9 else None, k * 1.0) for k in range(80)], "id bigint, source string, x double")
    return StoredTable.create(rows, f"file://{tmp_path}/t", ["source"])


def files(table):
    return {r[0] for r in table.read().select(F.input_file_name()).distinct().collect()}


def rows(table):
    return {r.id: (r.source, r.x) for r in table.read().collect()}


def upsert(old, new):
    return mutate.upsert(old, new, "id")


def test_an_upsert_rewrites_the_partition_it_touches(spark, table):
    before, had = files(table), rows(table)
    assert table.merge(spark.createDataFrame([(1, "s1", -1.0), (101, "s1", -2.0)], "id bigint, source string, x double"), "id", upsert)
    after = files(table)
    assert {f.split("source=")[1].split("/")[0] for f in before ^ after} == {"s1"} and len(before - after) == 1
    assert rows(table) == had | {1: ("s1", -1.0), 101: ("s1", -2.0)}


def test_rows_that_move_leave_their_partition(spark, table):
    had = rows(table)
    alone = spark.createDataFrame([(200, "lone", 1.0)], "id bigint, source string, x double")
    table.merge(alone, "id", upsert)
    table.merge(alone.withColumn("source", F.lit(None).cast("string")), "id", upsert)  # its partition is empty now
    assert rows(table) == had | {200: (None, 1.0)} and table.read().count() == 81
    assert not any("source=lone" in f for f in files(table))


def test_a_batch_that_runs_again_changes_nothing(spark, table):
    more = spark.createDataFrame([(2, "s2", 5.0)], "id bigint, source string, x double")
    add = lambda old, new: old.join(new.select("id", F.col("x").alias("y")), "id", "left").select("id", "source", (F.col("x") + F.coalesce("y", F.lit(0.0))).alias("x"))
    assert table.merge(more, "id", add, batch=7) and rows(table)[2] == ("s2", 7.0)
    before = files(table)
    assert not table.merge(more, "id", add, batch=7) and files(table) == before and rows(table)[2] == ("s2", 7.0)


def test_a_batch_that_broke_off_counts_once(spark, table, monkeypatch):
    more = spark.createDataFrame([(2, "s2", 5.0)], "id bigint, source string, x double")
    add = lambda old, new: old.join(new.select("id", F.col("x").alias("y")), "id", "left").select("id", "source", (F.col("x") + F.coalesce("y", F.lit(0.0))).alias("x"))
    place = StoredTable._place
    for broken in (lambda self, name: (_ for _ in ()).throw(OSError("lost before")), lambda self, name: (place(self, name), (_ for _ in ()).throw(OSError("lost after")))):
        monkeypatch.setattr(StoredTable, "_place", broken)
        with pytest.raises(OSError, match="lost"):
            table.merge(more, "id", add, batch=1)
    monkeypatch.setattr(StoredTable, "_place", place)
    assert table.merge(more, "id", add, batch=1) and rows(table)[2] == ("s2", 7.0)
