"""Reads of the multi-tenant store: point lookups, lists, searches and their counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.files import work_path
from ..sources.frames import live


def by_id(df: DataFrame, key, column: str = "id") -> DataFrame:
    return live(df).where(F.col(column) == key)


def contains_any(word: str, *columns: str) -> Column:
    """The word is in one of the columns, whatever the case of ASCII letters."""
    return reduce(Column.__or__, [F.lower(F.coalesce(c, F.lit(""))).contains(word.strip().lower()) for c in columns])


def newest(df: DataFrame, order: str, limit: int | None = None, key: str = "id", **equal) -> DataFrame:
    """Rows with the given values, newest first; ties by key. None means any value."""
    for column, value in equal.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    df = df.orderBy(F.desc(order), F.desc(key))
    return df if limit is None else df.limit(limit)


def search(df: DataFrame, word: str, user_id: str, limit: int, **tags) -> DataFrame:
    found = live(df).where((F.col("user_id") == user_id) & contains_any(word, "title", "company", "raw_text"))
    return newest(found, "crawled_at", limit, **tags)


def visible(df: DataFrame, user_id: str, word: str | None = None, source: str | None = None) -> DataFrame:
    """Own and public postings."""
    found = live(df).where((F.col("user_id") == user_id) | F.col("is_public"))
    if source:
        found = found.where(F.col("source") == source)
    return found.where(contains_any(word, "title", "company", "raw_text", "position_tag")) if word else found


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column) != "").distinct().orderBy(column)


def first_by(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key, in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def cached(df: DataFrame, position: str, industry: str, function: str | None, now: Column) -> DataFrame:
    """Cache entry for the place: the function's own before the general one, then the newest."""
    found = df.where((F.col("position") == position) & (F.col("industry") == industry) & (F.col("expires_at") > now))
    found = found.where(F.col("function").isNull() | F.col("function").eqNullSafe(F.lit(function)))
    return found.orderBy(F.col("function").isNotNull().desc(), F.desc("updated_at"), F.desc("id")).limit(1)


def closure(tree: DataFrame) -> DataFrame:
    """id, root, depth of every row of ``tree`` (id, parent_id). A row whose parent is missing is a root.
    A row on a cycle is its own root, and one under a cycle has the row of the cycle that it reaches
    first; depth then counts from there.
    """
    known = tree.select(F.col("id").alias("parent_id"), F.lit(True).alias("known")).where("parent_id is not null").distinct()
    rows = tree.select("id", "parent_id").join(known, "parent_id", "left").select("id", F.when(F.col("known"), F.col("parent_id")).alias("parent_id"))
    found, rest = climb(rows)
    if rest is None:
        return found
    # far up from rows without a root there are cycles, and all rows of these
    cycles = rest.select("at").distinct().select(F.col("at").alias("id"), F.lit(True).alias("round"))
    left = rows.join(rest.select("id"), "id", "left_semi").join(cycles, "id", "left")
    under, _ = climb(left.select("id", F.when(F.col("round").isNull(), F.col("parent_id")).alias("parent_id")))
    return found.unionByName(under)


def climb(tree: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """id, root, depth of the rows that have a root, by pointer doubling, and the rows without one (id,
    at: a row far above), if there are any.

    Each round joins rows with what their ancestor points to, so that pointers are twice as long,
    and is written as a table; after log2(depth) rounds all are at their roots.
    """
    spark, path = tree.sparkSession, work_path(tree.sparkSession, "closure")
    rows = tree.select("id", F.coalesce("parent_id", "id").alias("at"), F.col("parent_id").isNotNull().cast("int").alias("depth"), F.col("parent_id").isNull().alias("done"))
    schema, reach, n = rows.schema, 1, None
    for k in count():
        rows.write.parquet(f"{path}/{k}")
        rows = spark.read.schema(schema).parquet(f"{path}/{k}")
        n = rows.count() if n is None else n
        found = rows.where("done").select("id", F.col("at").alias("root"), "depth")
        if rows.where("not done").isEmpty():
            return found, None
        if reach > n:  # pointers longer than there are rows go round in a cycle
            return found, rows.where("not done").select("id", "at")
        above = rows.select(F.col("id").alias("above"), F.col("at").alias("next"), F.col("depth").alias("more"), F.col("done").alias("ends"))
        longer = rows.where("not done").join(above, F.col("at") == F.col("above")).select("id", F.col("next").alias("at"), (F.col("depth") + F.col("more")).alias("depth"), F.col("ends").alias("done"))
        rows, reach = rows.where("done").unionByName(longer), 2 * reach
