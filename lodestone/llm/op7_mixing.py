"""Mixing sources to target weights, with DataFrame functions only.

1. Tokens are counted over all documents and summed by leaf of the tree domain / language / source.
   A leaf can give its tokens MAX_EPOCHS times.
2. The budget is dealt from the root down. At each node children get shares by weight; a child whose
   subtree holds less than its share gives all it has, and its siblings take up the shortage. As a
   node's own share is fixed before, only what all siblings lack reaches its ancestors. This is
   water filling, in closed form by windows over the few rows of the tree.
3. A leaf passes through whole epochs and then takes a prefix of one more, in the seeded order of
   that epoch: the longest that its remaining quota holds. The prefix is found by radix selection:
   sums by leaf and the next 12 bits of the order, five times, so no leaf is ever sorted. Running
   sums go by 64 buckets at a time, first of their upper and then of their lower six bits.

Tokens are words, unless ``docs`` is given with a token column. Null and empty texts have no tokens;
they follow their place in the order. A null language or source is a leaf of its own, named ''; a null
doc_id has a place as others. Repeated rows share their place, and a place is taken whole or not. Very long
texts count all their tokens; one that is longer than what is left of a quota ends the prefix before it. Further columns are
ignored by ``mix`` and kept by ``mixed_rows``; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, discard, spool

SEED, MAX_EPOCHS, BUDGET_PERCENT = 17, 2, 60
DOMAIN_WEIGHTS = {"web": 5, "books": 3, "forum": 2}
LANG_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 1}
SOURCE_WEIGHTS: dict[str, int] = {}
#: Weight of what the tables above don't name.
OTHER_WEIGHT = 1
#: The order has 60 bits, of which each round fixes 12.
ORDER_BITS, ROUND_BITS = 60, 12
LEAF = ["domain", "lang", "source"]


def domain_of(source: Column) -> Column:
    """Domain of a source: its closing number modulo 3, other where it has none."""
    n = F.regexp_extract(source, r"(\d{1,9})$", 1).try_cast("bigint") % 3
    return F.when(n == 0, "web").when(n == 1, "books").when(n == 2, "forum").otherwise("other")


def weight(name: Column, table: dict[str, int]) -> Column:
    out = F.lit(OTHER_WEIGHT)
    for key, value in table.items():
        out = F.when(name == key, value).otherwise(out)
    return out.cast("bigint")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def order_key(doc_id: Column, epoch: Column, seed: int) -> Column:
    """60-bit place of a document in the order of an epoch."""
    name = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, ORDER_BITS // 4), 16, 10).cast("bigint")


def share_out(children: DataFrame, node: list[str], weight_of: str, held: str, given: str, out: str) -> DataFrame:
    """Add ``out``: each child's part of its node's ``given``, by water filling."""
    whole = Window.partitionBy(*node) if node else Window.partitionBy(F.lit(1))
    rising = whole.orderBy(F.col(held) / F.col(weight_of), *LEAF[: len(node) + 1])
    before, after = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    rest = F.col(given) - F.coalesce(F.sum(held).over(before), F.lit(0))
    share = F.floor(rest * F.col(weight_of) / F.sum(weight_of).over(after))
    full = children.withColumn("full", F.col(held) <= share)
    taken = F.coalesce(F.sum(F.when(F.col("full"), F.col(held))).over(whole), F.lit(0))
    open_ = F.sum(F.when(~F.col("full"), F.col(weight_of))).over(whole)
    full = full.withColumns({"taken": taken, "open": open_})
    return full.withColumn(out, F.when(F.col("full"), F.col(held)).otherwise(F.expr(f"(({given} - taken) * {weight_of}) div open"))).drop("full", "taken", "open")


def quotas(leaves: DataFrame, budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """domain, lang, source, tokens, quota, epochs (whole ones), rest (tokens of the prefix)."""
    held = leaves.withColumn("held", F.col("tokens") * max_epochs)
    total = leaves.agg(F.expr(f"(coalesce(sum(tokens), 0) * {budget_percent}) div 100").alias("b0"))
    langs = held.groupBy("domain", "lang").agg(F.sum("held").alias("held_l"))
    domains = langs.groupBy("domain").agg(F.sum("held_l").alias("held_d"))
    domains = domains.withColumn("w", weight(F.col("domain"), DOMAIN_WEIGHTS)).crossJoin(F.broadcast(total))  # total is one row
    domains = share_out(domains, [], "w", "held_d", "b0", "b1").select("domain", "b1")
    langs = langs.withColumn("w", weight(F.col("lang"), LANG_WEIGHTS)).join(domains, "domain")
    langs = share_out(langs, ["domain"], "w", "held_l", "b1", "b2").select("domain", "lang", "b2")
    held = held.withColumn("w", weight(F.col("source"), SOURCE_WEIGHTS)).join(langs, ["domain", "lang"])
    held = share_out(held, ["domain", "lang"], "w", "held", "b2", "quota")
    whole = F.when(F.col("tokens") > 0, F.expr("quota div tokens")).otherwise(F.lit(0)).cast("bigint")
    return held.select(*LEAF, "tokens", F.col("quota").cast("bigint"), whole.alias("epochs"), (F.col("quota") - whole * F.col("tokens")).cast("bigint").alias("rest"))


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def first_over(sums: DataFrame) -> DataFrame:
    """Leaf, bucket, rest: the first bucket of each leaf at which its running sum exceeds its rest,
    and what is left of the rest before that bucket."""
    running = F.sum("n").over(Window.partitionBy(*LEAF).orderBy("bucket"))
    over = sums.withColumn("upto", running).where("upto > rest")
    first = over.groupBy(*LEAF).agg(F.min(F.struct("bucket", (F.col("rest") - F.col("upto") + F.col("n")).alias("rest"))).alias("m"))
    return first.select(*LEAF, "m.bucket", "m.rest")


def cutoffs(places: DataFrame, plan: DataFrame, n_leaves: int) -> DataFrame:
    """``plan`` with cut: the place at which a leaf's prefix first exceeds its rest. Places before are taken."""
    at = plan.select(*LEAF, F.lit(0).cast("bigint").alias("cut"), "rest")
    for shift in range(ORDER_BITS - ROUND_BITS, -1, -ROUND_BITS):
        known = ORDER_BITS - ROUND_BITS - shift
        inside = places.join(small(at, n_leaves), LEAF)
        if known:
            inside = inside.where(F.shiftrightunsigned("key", shift + ROUND_BITS) == F.shiftrightunsigned("cut", shift + ROUND_BITS))
        sums = spool(inside.groupBy(*LEAF, F.shiftrightunsigned("key", shift).alias("bucket")).agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest")), "op7-sums")
        half = ROUND_BITS // 2
        upper = first_over(sums.groupBy(*LEAF, F.shiftrightunsigned("bucket", half).alias("bucket")).agg(F.sum("n").alias("n"), F.first("rest").alias("rest")))
        lower = sums.drop("rest").join(small(upper.withColumnRenamed("bucket", "upper"), n_leaves), LEAF).where(F.shiftrightunsigned("bucket", half) == F.col("upper"))
        before, at = at, spool(first_over(lower).select(*LEAF, F.shiftleft("bucket", shift).alias("cut"), "rest"), "op7-cut")
        discard(sums, *([before] if known else []))
    return plan.join(at.select(*LEAF, "cut"), LEAF, "left")


def places_of(docs: DataFrame, tokens: Column | None = None) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens: a narrow table of all documents."""
    source, lang = F.coalesce(F.col("`source`").cast("string"), F.lit("")), F.coalesce(F.col("`lang`").cast("string"), F.lit(""))
    n = word_count(F.col("`text`").cast("string")) if tokens is None else tokens.cast("bigint")
    return docs.select(F.col("`doc_id`").cast("bigint").alias("doc_id"), domain_of(source).alias("domain"), lang.alias("lang"), source.alias("source"), n.alias("n_tokens"))


def decided(docs: DataFrame, tokens: Column | None = None, seed: int = SEED, budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS) -> tuple[DataFrame, DataFrame, int]:
    """The narrow table, the plan with cutoffs, and the number of leaves."""
    narrow = spool(places_of(docs, tokens), "op7-places")
    leaves = spool(narrow.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens")), "op7-leaves")
    plan = spool(quotas(leaves, budget_percent, max_epochs), "op7-plan")
    n_leaves = plan.count()
    keyed = narrow.join(small(plan.select(*LEAF, "epochs"), n_leaves), LEAF).withColumn("key", order_key(F.col("doc_id"), F.col("epochs"), seed))
    cut = spool(cutoffs(keyed, plan, n_leaves), "op7-cutoffs")
    discard(leaves)
    return narrow, cut, n_leaves


def copies_of(rows: DataFrame, plan: DataFrame, n_leaves: int, seed: int = SEED) -> DataFrame:
    """``rows`` (with the leaf's columns and doc_id) and copies, how often each is taken."""
    both = rows.join(small(plan.select(*LEAF, "epochs", "cut"), n_leaves), LEAF)
    last = F.col("cut").isNotNull() & (order_key(F.col("doc_id"), F.col("epochs"), seed) < F.col("cut"))
    return both.withColumn("copies", (F.col("epochs") + F.when(last, 1).otherwise(0)).cast("bigint")).drop("epochs", "cut")


def mix(docs: DataFrame, tokens: Column | None = None, seed: int = SEED, budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, copies of every row of ``docs``."""
    narrow, plan, n_leaves = decided(docs, tokens, seed, budget_percent, max_epochs)
    return copies_of(narrow, plan, n_leaves, seed).select("doc_id", *LEAF, "n_tokens", "copies")


def mixed_rows(docs: DataFrame, tokens: Column | None = None, seed: int = SEED, budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as it is taken."""
    _, plan, n_leaves = decided(docs, tokens, seed, budget_percent, max_epochs)
    source, lang = F.coalesce(F.col("`source`").cast("string"), F.lit("")), F.coalesce(F.col("`lang`").cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col("`doc_id`").cast("bigint").alias("doc_id"), domain_of(source).alias("domain"), lang.alias("lang"), source.alias("source"))
    taken = copies_of(rows, plan, n_leaves, seed).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


def _case(name: str, table: dict[str, int]) -> str:
    return f"CASE {name} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + f" ELSE {OTHER_WEIGHT} END" if table else str(OTHER_WEIGHT)


def _fill(rows: str, node: str, w: str, held: str, given: str, out: str, order: str) -> str:
    part = f"PARTITION BY {node}" if node else ""
    return f"""
  SELECT *, CASE WHEN is_full THEN {held} ELSE (({given} - coalesce(sum(CASE WHEN is_full THEN {held} END) OVER ({part}), 0)) * {w})
                // sum(CASE WHEN NOT is_full THEN {w} END) OVER ({part}) END AS {out}
  FROM (SELECT *, {held} <= floor((({given} - coalesce(sum({held}) OVER ({part} ORDER BY {held} / {w}, {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * {w})::DOUBLE
                / sum({w}) OVER ({part} ORDER BY {held} / {w}, {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS is_full FROM ({rows}))"""


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens,
         CASE try_cast(nullif(regexp_extract(coalesce(source, ''), '(\d{{1,9}})$', 1), '') AS BIGINT) % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'books' WHEN 2 THEN 'forum' ELSE 'other' END AS domain
  FROM documents
), leaves AS (
  SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * {MAX_EPOCHS} AS BIGINT) AS held FROM d GROUP BY ALL
), l AS (SELECT domain, lang, CAST(sum(held) AS BIGINT) AS held_l FROM leaves GROUP BY ALL
), dm AS (SELECT domain, CAST(sum(held_l) AS BIGINT) AS held_d FROM l GROUP BY ALL
), q1 AS ({_fill(f"SELECT *, {_case('domain', DOMAIN_WEIGHTS)} AS w, (SELECT CAST((sum(tokens) * {BUDGET_PERCENT}) // 100 AS BIGINT) FROM leaves) AS b0 FROM dm", "", "w", "held_d", "b0", "b1", "domain")}
), q2 AS ({_fill(f"SELECT l.*, {_case('lang', LANG_WEIGHTS)} AS w, b1 FROM l JOIN q1 USING (domain)", "domain", "w", "held_l", "b1", "b2", "domain, lang")}
), q3 AS ({_fill(f"SELECT leaves.*, {_case('source', SOURCE_WEIGHTS)} AS w, b2 FROM leaves JOIN q2 USING (domain, lang)", "domain, lang", "w", "held", "b2", "quota", "domain, lang, source")}
), p AS (
  SELECT domain, lang, source, CASE WHEN tokens > 0 THEN quota // tokens ELSE 0 END AS epochs, quota - CASE WHEN tokens > 0 THEN quota // tokens ELSE 0 END * tokens AS rest FROM q3
), k AS (
  SELECT d.*, p.epochs, p.rest, CAST('0x' || substr(md5('{SEED}:' || CAST(CAST(p.epochs AS BIGINT) AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, {ORDER_BITS // 4}) AS BIGINT) AS place
  FROM d JOIN p USING (domain, lang, source)
), s AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM k
)
SELECT doc_id, domain, lang, source, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(epochs + CASE WHEN upto <= rest AND (max(upto) OVER (PARTITION BY domain, lang, source)) > rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM s
"""
