"""A stored table of which a write touches the partitions it concerns, and a batch counts once."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Most partitions that a table may have: its columns are of few values.
PARTITIONS = 10_000


@dataclass
class StoredTable:
    """Parquet files under ``path``/rows by the columns ``by``; batches that were merged, under ``path``/batches.

    A batch is staged whole, then put in place, then noted. One that breaks off is run again: before it
    is staged, from the table as it was; after that, from what was staged, which puts the same files in
    place. A batch that was noted changes nothing. Writers of a table take turns.
    """

    spark: SparkSession
    path: str
    by: Sequence[str]
    schema: StructType

    @classmethod
    def create(cls, rows: DataFrame, path: str, by: Sequence[str]) -> StoredTable:
        table = cls(rows.sparkSession, path, list(by), rows.schema)
        table._partitioned(rows).parquet(f"{path}/rows")
        return table

    def _partitioned(self, rows: DataFrame):
        # a partition is split among tasks where it is large
        return rows.select(*self.schema.names).hint("rebalance", *self.by).write.partitionBy(*self.by)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows").select(*self.schema.names)

    def _exists(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _delete(self, name: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def of(self, partitions: DataFrame) -> DataFrame:
        """The rows of the given partitions; others' files aren't opened."""
        found = partitions.select(*self.by).distinct().limit(PARTITIONS + 1).collect()
        if len(found) > PARTITIONS:
            raise ValueError(f"{self.by} have more than {PARTITIONS} values")
        wanted = F.lit(False)
        for r in found:
            one = F.lit(True)
            for c in self.by:
                one = one & F.col(c).eqNullSafe(F.lit(r[c]))
            wanted = wanted | one
        return self.read().where(wanted)

    def touched(self, incoming: DataFrame, key: str) -> DataFrame:
        """Partitions that the rows go to, and those that hold their keys; of the table, keys alone are read."""
        held = self.read().select(key, *self.by).join(incoming.select(key).distinct(), key, "left_semi").select(*self.by)
        return (incoming.select(*self.by).unionByName(held) if set(self.by) <= set(incoming.columns) else held).distinct()

    def merge(self, incoming: DataFrame, key: str, change: Callable[[DataFrame, DataFrame], DataFrame], batch: int | str | None = None) -> bool:
        """Put ``change(rows, incoming)`` in place of the rows of the partitions that ``incoming`` touches;
        whether that was done now. ``batch`` names the batch."""
        name = f"batches/{batch}" if batch is not None else "batches/none"
        if batch is not None and self._exists(f"{name}/noted"):
            return False
        if batch is None or not self._exists(f"{name}/staged/_SUCCESS"):
            self.touched(incoming, key).write.mode("overwrite").parquet(f"{self.path}/{name}/partitions")
            parts = self.spark.read.parquet(f"{self.path}/{name}/partitions")
            change(self.of(parts), incoming).select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/{name}/staged")
        self._place(name)
        if batch is not None:
            self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{name}/noted")
        self._delete(f"{name}/staged")
        return True

    def _place(self, name: str) -> None:
        parts, staged = self.spark.read.parquet(f"{self.path}/{name}/partitions"), self.spark.read.schema(self.schema).parquet(f"{self.path}/{name}/staged")
        self._partitioned(staged).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.path}/rows")
        # what is empty now isn't overwritten
        on = [F.col(f"p.{c}").eqNullSafe(F.col(f"s.{c}")) for c in self.by]
        empty = parts.alias("p").join(staged.select(*self.by).distinct().alias("s"), on, "left_anti")
        if empty.limit(1).count():
            for folder in {r[0].rpartition("/")[0] for r in self.of(empty).select(F.input_file_name()).distinct().collect()}:
                self._delete("rows" + folder.partition(f"{self.path.partition(':')[2].rstrip('/') or self.path}/rows")[2])
