"""Classification of texts against a three-level taxonomy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from .store import first_by

HEAD_CHARS, LEAST_COSINE = 200, 0.6


def flatten(spark: SparkSession, tree: dict[str, dict[str, list[str]]]) -> DataFrame:
    """industry, function, position, ord of a nested taxonomy; it is small and fixed."""
    rows = [(i, f, p) for i, functions in tree.items() for f, positions in functions.items() for p in positions]
    return spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "industry string, function string, position string, ord int")


def last_by_name(taxonomy: DataFrame) -> DataFrame:
    """One row for each position; of several the last."""
    return first_by(taxonomy, ["position"], F.desc("ord"))


def by_rule(texts: DataFrame, taxonomy: DataFrame, key: str) -> DataFrame:
    """The longest position name that the text holds; ties by order. texts: key, text."""
    names = F.broadcast(last_by_name(taxonomy))  # a taxonomy is small
    found = texts.join(names, F.col("text").contains(F.col("position")))
    return first_by(found, [key], F.desc(F.length("position")), F.asc("ord")).select(key, "industry", "function", "position")


def by_tfidf(texts: DataFrame, taxonomy: DataFrame, key: str, least: float = LEAST_COSINE) -> DataFrame:
    """The position of greatest TF-IDF cosine, of at least ``least``; the first wins ties. Counts are
    over all names, repeated ones included."""
    total = taxonomy.agg(F.count("*").alias("total"))
    words = taxonomy.select(F.explode(F.array_distinct(tokens(F.col("position")))).alias("token"))
    idf = words.groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total)).select("token", (F.log((F.col("total") + 1) / (F.col("df") + 1)) + 1).alias("idf"))  # one row

    def weights(rows: DataFrame, by: list[str]) -> DataFrame:
        counted = rows.groupBy(*by, "token").agg(F.count("*").alias("tf")).join(F.broadcast(idf), "token")
        return counted.withColumn("w", F.col("tf") * F.col("idf")).select(*by, "token", "w")

    def norm(w: DataFrame, by: list[str]) -> DataFrame:
        return w.groupBy(*by).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))

    names = last_by_name(taxonomy)
    a = weights(names.select("position", F.explode(tokens(F.col("position"))).alias("token")), ["position"])
    b = weights(texts.select(key, F.explode(tokens(F.col("text"))).alias("token")), [key])
    dots = b.join(F.broadcast(a.withColumnRenamed("w", "v")), "token").groupBy(key, "position").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    scored = dots.join(norm(b, [key]), key).join(F.broadcast(norm(a, ["position"]).withColumnRenamed("norm", "other")), "position")
    scored = scored.withColumn("score", F.round(F.col("dot") / (F.col("norm") * F.col("other")), 9)).where(F.col("score") >= least).join(F.broadcast(names), "position")
    return first_by(scored, [key], F.desc("score"), F.asc("ord")).select(key, "industry", "function", "position", "score")


def classify(texts: DataFrame, taxonomy: DataFrame, key: str) -> DataFrame:
    """key, layer (1 rule, 2 similarity, null none) and the three tags of every text."""
    one = by_rule(texts, taxonomy, key).withColumn("layer", F.lit(1))
    two = by_tfidf(texts.join(one, key, "left_anti"), taxonomy, key).drop("score").withColumn("layer", F.lit(2))
    return texts.select(key).join(one.unionByName(two), key, "left").select(key, "layer", "industry", "function", "position")
