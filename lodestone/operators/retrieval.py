"""Retrieval over chunk vectors: exact cosine, soft weights, thresholds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import sigmoid
from ..sources.folder import small_batches
from .vectors import QUERY_BLOCK, similar, top

#: Ranking multipliers of chunk types, and of the industry asked for.
TYPE_WEIGHT = {"responsibility": 1.2, "requirement": 1.3, "overview": 0.8, "nice_to_have": 0.5, "full": 1.0}
SAME_INDUSTRY = 1.2
RERANK_SHARE = 0.7


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of other length; a zero norm counts as 1."""
    norm = lambda v: F.when(dot(v, v) == 0, 1.0).otherwise(F.sqrt(dot(v, v)))
    return F.when(F.size(a) == F.size(b), dot(a, b) / (norm(a) * norm(b))).otherwise(0.0)


def candidates_wanted(k: int, rerank: bool) -> int:
    return max(5 * k, 50) if rerank else max(3 * k, k)


def type_weight(kind: Column) -> Column:
    out = F.lit(1.0)
    for name, value in TYPE_WEIGHT.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def weighted(candidates: DataFrame, k: int, least: float, industry: str | None = None, rerank: Column | None = None) -> DataFrame:
    """Weigh candidates, take k, then drop those under the threshold (only without rerank scores)."""
    boost = F.when(F.col("industry_tag") == F.lit(industry), SAME_INDUSTRY).otherwise(1.0) if industry else F.lit(1.0)
    soft = F.col("similarity") * type_weight(F.col("chunk_type")) * boost
    ranked = soft if rerank is None else RERANK_SHARE * rerank + (1 - RERANK_SHARE) * soft
    found = top(candidates.drop("rank").withColumn("ranked_score", ranked), k, "ranked_score")
    return found if rerank is not None else found.where(F.col("similarity") >= least)


def scorer(model: Callable[[], Callable[[list[str], list[str]], list[float]]]) -> Callable[[Column, Column], Column]:
    """Pandas UDF of an injected cross-encoder: ``model()`` is built once a worker and maps pairs of a
    query's and a chunk's text to logits."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        ready = model()
        for asked, said in batches:
            yield pd.Series(ready(asked.fillna("").tolist(), said.fillna("").tolist()), dtype="float64")

    return score


def shared_words() -> Callable[[list[str], list[str]], list[float]]:
    """Stand-in model: words that both texts hold, less two."""
    return lambda asked, said: [len(set(a.lower().split()) & set(b.lower().split())) - 2.0 for a, b in zip(asked, said, strict=True)]


def reranked(candidates: DataFrame, k: int, score: Column) -> DataFrame:
    """The max(4k, 20) candidates of greatest logit (4 places), with rerank_score and its logistic."""
    scored = candidates.drop("rank").withColumn("rerank_score", F.round(score, 4))
    return top(scored, max(4 * k, 20), "rerank_score").drop("rank").withColumn("rerank_norm", F.round(sigmoid(F.col("rerank_score")), 4))


def retrieve(chunks: DataFrame, queries: DataFrame, k: int, least: float = 0.55, chunk_type: str | None = None, user_id: str | None = None, position: str | None = None, industry: str | None = None, score: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Best chunks of each query (query_id, query_text, vector).

    chunks: id (of one row each), chunk_index, chunk_type, user_id, position_tag, industry_tag, chunk_text, embedding.
    Filters come first. With a scorer, more candidates are fetched, reranked, and the threshold isn't
    used. Queries without a vector fall back to a search of their text, with scores of 0.
    """
    for column, value in (("chunk_type", chunk_type), ("user_id", user_id), ("position_tag", position)):
        if value is not None:
            chunks = chunks.where(F.col(column) == value)
    near = similar(chunks.drop("chunk_text"), queries.where("vector is not null"), candidates_wanted(k, score is not None))
    if score is None:
        found = weighted(near, k, least, industry)
    else:
        # texts of candidates alone are fetched, and reach the model in batches of bounded size
        small_batches(chunks.sparkSession)
        asked = near.join(chunks.select("id", "chunk_text"), "id").join(queries.select("query_id", "query_text"), "query_id")
        found = weighted(reranked(asked, k, score(F.col("query_text"), F.col("chunk_text"))), k, least, industry, F.col("rerank_norm"))
    columns = ["query_id", "id", "chunk_type", F.round("similarity", 4).alias("similarity"), F.round("ranked_score", 4).alias("ranked_score")]
    return found.select(*columns).unionByName(like(chunks, queries.where("vector is null"), k))


def like(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The first k chunks, by index, that hold the text of a query; in blocks of queries."""
    blocks, out = max(1, -(-queries.count() // QUERY_BLOCK)), None
    for b in range(blocks):
        asked = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).select("query_id", F.lower("query_text").alias("asked"))  # about QUERY_BLOCK rows
        found = chunks.join(F.broadcast(asked), F.lower("chunk_text").contains(F.col("asked"))).where("asked <> ''")
        w = Window.partitionBy("query_id").orderBy("chunk_index", "id")
        part = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "id", "chunk_type", F.lit(0.0).alias("similarity"), F.lit(0.0).alias("ranked_score"))
        out = part if out is None else out.unionByName(part)
    return out
