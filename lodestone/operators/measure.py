"""Ranking metrics over judged lists (query_id, rank, score), one row for each query and rank."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RELEVANT = 3


def per_query(ranked: DataFrame, score: Column, k: int = 10, *more: str) -> DataFrame:
    """query_id, dcg, idcg, n_relevant within k, first_relevant over the whole list, by query_id and the columns
    ``more``. Relevance is binary, so that the best order is known from the number of relevant rows."""
    rows = ranked.select("query_id", *more, "rank", (score >= RELEVANT).cast("int").alias("rel"))
    best = F.array(*[F.lit(sum(1 / math.log2(i + 2) for i in range(n))) for n in range(k + 1)])
    return rows.groupBy("query_id", *more).agg(
        F.sum(F.when(F.col("rank") <= k, F.col("rel") / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"), F.get(best, F.least(F.sum("rel"), F.lit(k)).cast("int")).alias("idcg"),
        F.sum(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0)).alias("n_relevant"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first_relevant"),
    )


def ndcg(dcg: Column, idcg: Column) -> Column:
    return F.when(idcg == 0, 0.0).otherwise(dcg / idcg)


def metrics(queries: DataFrame, k: int = 10, *by: str) -> DataFrame:
    """NDCG, density, MRR and hit rate, over all queries or by columns."""
    rounded = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 4)
    return queries.groupBy(*by).agg(
        F.count("*").alias("n_queries"), rounded(F.avg(ndcg(F.col("dcg"), F.col("idcg")))).alias("ndcg"), rounded(F.avg(F.col("n_relevant") / k)).alias("recall"),
        rounded(F.avg(F.coalesce(1 / F.col("first_relevant"), F.lit(0.0)))).alias("mrr"), rounded(F.avg((F.col("n_relevant") > 0).cast("int"))).alias("hit_rate"),
    )


def spearman(df: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """Rank correlation within each value of ``by``; 0 where one side is constant."""
    pairs = df.groupBy(by, x, y).agg(F.count("*").alias("n"))  # ranks are equal where values are

    def ranks(c: str) -> Column:
        whole = Window.partitionBy(by)
        upto = F.sum("n").over(whole.orderBy(c).rangeBetween(Window.unboundedPreceding, 0))
        return upto - (F.sum("n").over(Window.partitionBy(by, c)) - 1) / 2

    rows = pairs.select(by, F.col("n").alias("w"), ranks(x).alias("rx"), ranks(y).alias("ry"))
    total = lambda *f: F.sum(reduce(Column.__mul__, map(F.col, ("w", *f))))
    n, sx, sy = total(), total("rx"), total("ry")
    cov = n * total("rx", "ry") - sx * sy
    spread = (n * total("rx", "rx") - sx * sx) * (n * total("ry", "ry") - sy * sy)
    return rows.groupBy(by).agg(n.alias("n"), F.when(spread > 0, cov / F.sqrt(F.greatest(spread, F.lit(1e-12)))).otherwise(0.0).alias("rho"))


def quota(df: DataFrame, strata: list[str], size: Column, most: int, *order: Column) -> DataFrame:
    """At most ``size`` rows of each stratum, in the given (seeded) order; short strata give all. No
    size exceeds ``most``, so each partition is pruned to that before the shuffle."""
    numbered = df.withColumn("_n", F.row_number().over(Window.partitionBy(*strata).orderBy(*order))).where(F.col("_n") <= most)
    return numbered.where(F.col("_n") <= size).drop("_n")


def numbered(df: DataFrame, by: str, part: Column, *order: str) -> DataFrame:
    """``df`` with number, from 1 on within each value of ``by``, in the given order, of which ``part`` is
    a range. Rows are numbered within ranges and moved on by the counts of the ranges before, so that no
    task holds all of a hot value."""
    rows = df.withColumn("_part", part)
    counts = rows.groupBy(by, "_part").agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = counts.select(by, "_part", before.alias("_before"))
    local = rows.withColumn("number", F.row_number().over(Window.partitionBy(by, "_part").orderBy(*order)))
    return local.join(moved, [by, "_part"]).withColumn("number", F.col("number") + F.col("_before")).drop("_part", "_before")


def quantile(counts: DataFrame, by: str, value: str, share: float) -> DataFrame:
    """by, n, mean, quantile (interpolated) from counts (n) of distinct values; nulls don't count."""
    upto = F.sum(F.when(F.col(value).isNotNull(), F.col("n"))).over(Window.partitionBy(by).orderBy(F.col(value).asc_nulls_last()))
    rows = counts.withColumn("upto", upto)
    known = F.when(F.col(value).isNotNull(), F.col("n"))
    whole = counts.groupBy(by).agg(F.sum("n").alias("n"), F.sum(known).alias("known"), (F.sum(F.col(value) * F.col("n")) / F.sum(known)).alias("mean"))
    place = (F.col("known") - 1) * share
    at = rows.select(by, value, "upto").join(whole, by).withColumns({"low": F.floor(place), "high": F.ceil(place), "place": place})
    found = at.groupBy(by).agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.min(F.when(F.col("upto") > F.col("low"), F.col(value))).alias("a"), F.min(F.when(F.col("upto") > F.col("high"), F.col(value))).alias("b"), F.first(F.col("place") - F.col("low")).alias("part"))
    return found.select(by, "n", "mean", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("quantile"))


def clamped_scaling(steps: Column) -> Column:
    """m, low, high of the steps one after the other, each of which scales by m and clamps to low and high."""
    start = F.struct(F.lit(1.0).alias("m"), F.lit(0.0).alias("low"), F.lit(float("inf")).alias("high"))

    def then(a: Column, b: Column) -> Column:
        clamp = lambda x: F.least(F.greatest(x, b["low"]), b["high"])
        return F.struct((a["m"] * b["m"]).alias("m"), clamp(a["low"] * b["m"]).alias("low"), clamp(a["high"] * b["m"]).alias("high"))

    return F.aggregate(steps, start, then)


def seeded(column: str, seed: int) -> Column:
    """A place in a seeded order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(column).cast("string")))


def preserved(before: DataFrame, after: DataFrame, key: str, by: str) -> DataFrame:
    """``by``, n, kept, lost, lost_ids (the first LOST_IDS by key), score of the rows of a snapshot: a row is
    lost if it is missing afterwards or differs in any column that it had; two points of ten for each."""
    columns = before.columns
    gone = before.alias("b").join(after.select(*[c for c in columns if c in after.columns], F.lit(True).alias("_there")).alias("a"), key, "left")
    same = F.coalesce(F.col("_there"), F.lit(False))
    for c in columns:
        if c != key:
            same = same & (F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}")) if c in after.columns else F.lit(False))
    told = gone.select(F.col(f"b.{by}").alias(by), key, (~same).alias("_lost"))
    first = F.row_number().over(Window.partitionBy(by).orderBy(key))
    ids = told.where("_lost").withColumn("_n", first).where(F.col("_n") <= LOST_IDS).groupBy(F.col(by).alias("_by")).agg(F.sort_array(F.collect_list(key)).alias("lost_ids"))
    counts = told.groupBy(by).agg(F.count("*").alias("n"), F.count_if(~F.col("_lost")).alias("kept"), F.count_if("_lost").alias("lost"))
    out = counts.join(ids, F.col(by).eqNullSafe(F.col("_by")), "left")
    return out.select(by, "n", "kept", "lost", F.coalesce("lost_ids", F.array()).alias("lost_ids"), F.greatest(F.lit(0.0), 10.0 - 2.0 * F.col("lost")).alias("score"))


#: Ids of lost rows that a report lists.
LOST_IDS = 5

#: Relative error of a quantile read off a sketch.
ERROR = 0.01


def sketch(rows: DataFrame, by: list[str], value: str, error: float = ERROR) -> DataFrame:
    """Counts of the values of each group by bucket (the columns ``by``, bucket, n): a sketch of quantiles.

    A bucket is as wide as the error on either side of its middle allows, so a group has some hundreds,
    however many rows it has. Values of zero and less are one bucket, null; nulls aren't counted.
    Sketches of parts of a group merge by adding up, in any order.
    """
    base = math.log((1 + error) / (1 - error))
    bucket = F.when(F.col(value) > 0, F.ceil(F.log(value) / base))
    return rows.where(F.col(value).isNotNull()).groupBy(*by, bucket.cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def merge_sketches(parts: DataFrame, by: list[str]) -> DataFrame:
    """The sketch of groups that are unions of the parts', by fewer columns."""
    return parts.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))


def sketch_quantile(sketched: DataFrame, by: list[str], share: float, error: float = ERROR) -> DataFrame:
    """The columns ``by``, n and quantile: the value that a ``share`` of the values don't exceed, within the
    error of the exact one of that rank; 0 where it isn't over zero."""
    order = Window.partitionBy(*by).orderBy(F.asc_nulls_first("bucket"))
    total = F.sum("n").over(Window.partitionBy(*by))
    upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    reached = sketched.withColumns({"total": total, "upto": upto}).where(F.col("upto") >= F.ceil(F.col("total") * share))
    growth = (1 + error) / (1 - error)
    value = F.coalesce(2 * F.pow(F.lit(growth), F.col("bucket")) / (growth + 1), F.lit(0.0))
    return reached.groupBy(*by).agg(F.max("total").alias("n"), F.min(value).alias("quantile"))


def overlap_verdict(query: Column, text: Column) -> Column:
    """4 if at least two, and two fifths, of the query's words are in the text, 3 if any is, else 2. Words are
    told apart by white space, those of one letter never count as found; cases don't matter."""
    words = F.array_distinct(F.filter(F.split(F.lower(query), r"\s+"), lambda x: x != ""))
    low = F.lower(text)
    n = F.size(F.filter(words, lambda x: (F.length(x) > 1) & low.contains(x)))
    return F.when(n >= F.greatest(F.lit(2.0), 0.4 * F.size(words)), 4).when(n >= 1, 3).otherwise(2)
