"""Exact dedup by content-defined chunk recipes, with DataFrame functions only.

1. A text without white space is cut into chunks at its own marks: a chunk ends at the first
   sentence mark after MIN_CHARS, and after MAX_CHARS at the latest. An edit moves only the cuts
   near it, so that copies and revisions share chunks.
2. Each distinct chunk moves once, into a dictionary keyed by a 64-bit hash and the chunk itself.
   A hash with several chunks is a collision; its chunks are told apart by rank. So the
   identifiers are verified against the characters, not only by hash.
3. A document is its recipe, the ordered list of its chunk identifiers. Recipes are grouped with a
   map-side combine; the texts do not move again.

Nulls count as empty; documents without any character besides white space are equal to each other.
Ties of length go to the smallest doc_id, a null doc_id comes last. Rows that repeat the keeper's
doc_id and length are kept with it, as the id names one document; rows that repeat its doc_id but
are shorter aren't. Long texts are many chunks. An empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, pick, spool

MIN_CHARS, MAX_CHARS = 512, 4096
#: Recipes that several documents share are broadcast if they hold at most so many identifiers.
BROADCAST_IDS = 4_000_000
SPACES = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def chunks(text: Column, least: int = MIN_CHARS, most: int = MAX_CHARS) -> Column:
    """Content-defined chunks of ``text``, in order; no characters are lost."""
    cut = f"(?s).{{{least},{most - 1}}}?[.!?:;。]|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(cut), F.lit(0))


def chunk_hash(chunk: Column, bits: int = 64) -> Column:
    """``bits`` under 64 make collisions, for tests."""
    return F.xxhash64(chunk) if bits == 64 else F.pmod(F.xxhash64(chunk), F.lit(1 << bits))


def collisions(cut: DataFrame, bits: int) -> DataFrame | None:
    """hash, chunk, rank of the chunks whose hash belongs to several chunks; None if there are none."""
    distinct = cut.select(F.explode("chunks").alias("chunk")).select(chunk_hash(F.col("chunk"), bits).alias("h"), "chunk").distinct()
    shared = spool(distinct.groupBy("h").count().where("count > 1").select("h"), "op5-shared-hashes")
    if not shared.limit(1).count():
        return None
    found = distinct.join(shared, "h", "left_semi").groupBy("h").agg(F.sort_array(F.collect_list("chunk")).alias("found"))
    return spool(found.select("h", F.posexplode("found").alias("rank", "chunk")), "op5-collisions")


def deduplicate(docs: DataFrame, bits: int = 64, least: int = MIN_CHARS, most: int = MAX_CHARS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_chunks of every row of ``docs``."""
    rows = pick(docs, doc_id="bigint", text="string").select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_chars"), normalised(F.col("text")).alias("norm"))
    cut = rows.select("doc_id", "n_chars", F.sha2("norm", 256).alias("text_sha256"), chunks(F.col("norm"), least, most).alias("chunks"))
    clash = collisions(cut, bits)
    if clash is not None:
        recipes = ranked(cut, clash, bits)
    else:
        recipes = cut.select("doc_id", "n_chars", "text_sha256", F.transform("chunks", lambda c: chunk_hash(c, bits)).alias("recipe"), F.lit(None).cast("array<int>").alias("ranks"))
    recipes = spool(recipes, "op5-recipes")
    groups = recipes.groupBy("recipe", "ranks").agg(
        F.count("*").alias("group_size"),
        F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("unnamed"), "doc_id")).alias("best"),
    )
    several = spool(groups.where("group_size > 1").select("recipe", "ranks", "group_size", F.col("best.doc_id").alias("keep_id"), (-F.col("best.less")).alias("keep_chars")), "op5-groups")
    # ranks is null unless hashes collided
    n, ids = several.agg(F.count("*"), F.coalesce(F.sum(F.size("recipe") + F.greatest(F.size(F.coalesce("ranks", F.array().cast("array<int>"))), F.lit(0))), F.lit(0))).first()
    on = several.withColumnsRenamed({"recipe": "r_recipe", "ranks": "r_ranks"})
    small = n <= BROADCAST_ROWS and ids <= BROADCAST_IDS
    found = recipes.join(F.broadcast(on) if small else on, [F.col("recipe") == F.col("r_recipe"), F.col("ranks").eqNullSafe(F.col("r_ranks"))], "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | F.col("doc_id").eqNullSafe(keep) & (F.col("n_chars") == F.col("keep_chars"))).alias("kept"), "text_sha256", F.size("recipe").alias("n_chunks"),
    )


def ranked(cut: DataFrame, clash: DataFrame, bits: int) -> DataFrame:
    """Recipes where some hashes stand for several chunks: each chunk gets its rank by a join on the
    chunk itself, and the lists are put together again by document."""
    keyed = cut.withColumn("row", F.monotonically_increasing_id())
    keyed = spool(keyed, "op5-rows")
    parts = keyed.select("row", F.posexplode("chunks").alias("at", "chunk")).withColumn("h", chunk_hash(F.col("chunk"), bits))
    parts = parts.join(clash, ["h", "chunk"], "left").withColumn("rank", F.coalesce("rank", F.lit(0)))
    lists = parts.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "h", "rank"))).alias("parts"))
    empty = F.array().cast("array<struct<at:int,h:bigint,rank:int>>")
    both = keyed.drop("chunks").join(lists, "row", "left").withColumn("parts", F.coalesce("parts", empty))
    return both.select("doc_id", "n_chars", "text_sha256", F.col("parts.h").alias("recipe"), F.col("parts.rank").alias("ranks"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents
), g AS (
  SELECT doc_id, t, n, count(*) OVER (PARTITION BY t) AS group_size, max(n) OVER (PARTITION BY t) AS most,
         first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id NULLS LAST) AS keep_id
  FROM d
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id IS NOT DISTINCT FROM keep_id AND n = most AS kept, sha256(t) AS text_sha256 FROM g
"""
