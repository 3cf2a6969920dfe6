"""Writes of the store as whole-table transformations: each returns the table after the write."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import first_by


def last_of_key(incoming: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row for each key: the last in the given order, as the last write wins; any without an order."""
    return first_by(incoming, [key], *[o.desc() for o in order]) if order else incoming.dropDuplicates([key])


def surviving_ids(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """id, stored_id: of each incoming row, the id under which its key is stored after an insert that
    ignores known keys. A null key is stored as it comes."""
    names = list(keys)
    null = F.lit(False)
    for c in names:
        null = null | F.col(f"n.{c}").isNull()
    stored = insert_ignore(existing.select("id", *names), incoming.select("id", *names), names, *order).dropna(subset=names)
    stored = stored.groupBy(*names).agg(F.min("id").alias("stored_id"))
    both = incoming.select("id", *names).alias("n").join(stored.alias("s"), names, "left")
    return both.select("n.id", F.when(null, F.col("n.id")).otherwise(F.col("stored_id")).alias("stored_id"))


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """Add rows whose key is new; of several, the first in the given order. Null keys never conflict."""
    known = [c for c in keys]
    unkeyed = incoming.where(" or ".join(f"`{k}` is null" for k in known))
    keyed = first_by(incoming.dropna(subset=known), known, *order)
    fresh = keyed.join(existing.select(*known).distinct(), known, "left_anti")
    return existing.unionByName(fresh.select(*existing.columns)).unionByName(unkeyed.select(*existing.columns))


def insert_replace(existing: DataFrame, incoming: DataFrame, key: str, defaults: dict[str, Column], *order: Column) -> DataFrame:
    """Incoming rows replace those of their key whole; columns that they lack get their defaults. The last
    of repeated keys counts."""
    incoming = last_of_key(incoming, key, *order)
    full = incoming.select(*[F.col(c) if c in incoming.columns else defaults.get(c, F.lit(None)).cast(existing.schema[c].dataType).alias(c) for c in existing.columns])
    return existing.join(incoming.select(key), key, "left_anti").select(*existing.columns).unionByName(full)


def upsert(existing: DataFrame, incoming: DataFrame, key: str, keep: Sequence[str] = (), *order: Column) -> DataFrame:
    """Insert or update by key; a null in the columns to ``keep`` leaves the old value. The last of
    repeated keys counts."""
    old, new = existing.alias("o"), last_of_key(incoming, key, *order).alias("n")
    hit = F.col(f"n.{key}").isNotNull()
    columns = [F.coalesce(f"n.{key}", f"o.{key}").alias(key)]
    for c in existing.columns:
        if c == key:
            continue
        if c not in incoming.columns:
            columns.append(F.col(f"o.{c}").alias(c))
        elif c in keep:
            columns.append(F.coalesce(f"n.{c}", f"o.{c}").alias(c))
        else:
            columns.append(F.when(hit, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(*columns)


def update(existing: DataFrame, updates: DataFrame, key: str, columns: Sequence[str], *order: Column) -> DataFrame:
    """Set columns of the rows that ``updates`` has, nulls included. The last of repeated keys counts."""
    new = last_of_key(updates, key, *order).select(F.col(key), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in columns])
    both = existing.join(new, key, "left")
    return both.select(*[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in existing.columns])


def compare_and_set(existing: DataFrame, updates: DataFrame, key: str, guard: str, columns: Sequence[str]) -> DataFrame:
    """Set columns where ``guard`` still is ``expected`` (null equals null); ``changed`` tells where."""
    new = updates.select(F.col(key), F.col("expected"), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in columns])
    both = existing.join(new, key, "left").withColumn("changed", F.coalesce(F.col("_hit"), F.lit(False)) & F.col(guard).eqNullSafe(F.col("expected")))
    return both.select(*[F.when(F.col("changed"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in existing.columns], "changed")


def soft_delete(parents: DataFrame, children: DataFrame, gone: DataFrame, link: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """Stamp the parents named by ``gone`` (id) and their live children."""
    ids = gone.select("id").distinct()
    flagged = parents.join(ids.withColumn("_gone", F.lit(True)), "id", "left")
    stamped = flagged.withColumn("deleted_at", F.when(F.col("_gone") & F.col("deleted_at").isNull(), at).otherwise(F.col("deleted_at"))).select(*parents.columns)
    below = children.join(ids.select(F.col("id").alias(link), F.lit(True).alias("_gone")), link, "left")
    return stamped, below.withColumn("deleted_at", F.when(F.col("_gone") & F.col("deleted_at").isNull(), at).otherwise(F.col("deleted_at"))).select(*children.columns)


def older_than(df: DataFrame, column: str, days: int, now: Column) -> DataFrame:
    """What is left when rows more than ``days`` days old (fractions count) are deleted."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(column).cast("timestamp"))) / F.lit(86_400_000_000.0)
    return df.where(~F.coalesce(age > days, F.lit(False)))


def set_exclusive(df: DataFrame, target: Column, flag: str) -> DataFrame:
    """The flag is set on the target alone."""
    return df.withColumn(flag, F.coalesce(target, F.lit(False)))


def clone_version(source: DataFrame, overrides: DataFrame, next_id: Column) -> DataFrame:
    """New rows from those that ``overrides`` (source_id, columns to change) names: version up by one, parent set."""
    both = source.alias("s").join(overrides.alias("o"), F.col("s.id") == F.col("o.source_id"))
    out = []
    for c in source.columns:
        if c == "id":
            out.append(next_id.alias("id"))
        elif c == "version":
            out.append((F.coalesce("s.version", F.lit(1)) + 1).alias("version"))
        elif c == "parent_id":
            out.append(F.col("s.id").alias("parent_id"))
        elif c in overrides.columns:
            out.append(F.coalesce(f"o.{c}", f"s.{c}").alias(c))
        else:
            out.append(F.col(f"s.{c}").alias(c))
    return both.select(*out)


def append_indexed(existing: DataFrame, incoming: DataFrame, group: str, order: Sequence[str], index: str) -> DataFrame:
    """Append rows, numbered within their group from the greatest index on."""
    top = existing.groupBy(group).agg(F.max(index).alias("_top"))
    numbered = incoming.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    placed = numbered.join(top, group, "left").withColumn(index, (F.coalesce("_top", F.lit(-1)) + F.col("_n")).cast("int"))
    return existing.unionByName(placed.select(*existing.columns))


def coerced(value: Column, kind: str) -> Column:
    """Stored text as a column of another store takes it: json (text that is no JSON becomes a JSON
    string), array (what is no list becomes its only entry), bool, or as it is."""
    parsed = F.try_parse_json(value)
    if kind == "json":
        quoted = F.to_json(F.array(value))
        return F.when(value.isNull() | parsed.isNotNull(), value).otherwise(F.substr(quoted, F.lit(2), F.length(quoted) - 2))
    if kind == "array":
        is_list = F.coalesce(F.schema_of_variant(parsed).startswith("ARRAY"), F.lit(False))
        return F.when(value.isNull(), None).when(is_list, F.from_json(value, "array<string>")).otherwise(F.array(value))
    return value.cast("boolean") if kind == "bool" else value


def copy_shared_columns(source: DataFrame, target: DataFrame, key: str, kinds: dict[str, str] | None = None, **fill: Column) -> DataFrame:
    """Append to ``target`` the rows of new keys, by the columns that both have; ``kinds`` says how
    columns are coerced, nulls and empty texts may be filled."""
    shared = [c for c in target.columns if c in source.columns]

    def one(c: str) -> Column:
        value = coerced(F.col(c), kinds[c]) if kinds and c in kinds else F.col(c)
        value = F.coalesce(F.nullif(value, F.lit("")), fill[c]) if c in fill else value
        return value.cast(target.schema[c].dataType).alias(c)

    rows = source.select(*map(one, shared))
    return target.unionByName(rows.join(target.select(key), key, "left_anti"), allowMissingColumns=True)


def merge_sources(parts: dict[str, DataFrame], address: Callable[[Column], Column]) -> DataFrame:
    """One table of several sources, by a common address.

    ``parts`` maps the label of a source to its rows (id, url, title and others; columns that a source lacks
    are null). Addresses are normalised first; rows without one don't enter. Of rows with one address stays that
    of the first source in order, and there of the smallest id. ``source`` becomes the label, whatever it was;
    empty and null titles become Unknown.
    """
    rows = None
    for place, (label, part) in enumerate(parts.items()):
        part = part.withColumns({"url": address(F.col("url")), "title": F.coalesce(F.nullif("title", F.lit("")), F.lit("Unknown")), "source": F.lit(label), "_place": F.lit(place)}).where("url <> ''")
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    return first_by(rows, ["url"], F.asc("_place"), F.asc("id")).drop("_place")
