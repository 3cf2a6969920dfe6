"""Audit of how filters interact: what each removes at each place of each order, by source.

1. One pass over the texts gives each row its failures as flags. Equal texts are told by SHA-256; a
   digest that several rows have gets its smallest doc_id by a grouped sum, so that a hot text moves
   as digests alone, combined before the shuffle.
2. The orders of the filters form a trie. A walk goes down it depth-first: each state is a persisted
   DataFrame of the rows that survive the filters so far, made from its parent's by one more filter,
   and one grouped count over it gives what each further filter actually removes, an edge of the trie.
3. Survivors don't depend on the order of the filters behind them, so a state is entered once for each
   unordered set: 2**n states and n * 2**(n-1) edges for n! orders. At most n - 1 frames are persisted
   at a time; a lost executor's part is made again from the table of flags.
4. The orders' rows are looked up in the edges, and what a filter removes over all orders is the sum of
   its edges, each times the number of orders through it.

Null texts count as empty, a null source is the empty part. Rows without a doc_id are no copy of
another and have no labels. Repeated rows count each and aren't copies of each other, as neither id is
smaller. Texts are judged whole, whatever their length. Labels of one doc_id that differ count as set if
any is. An empty table gives no rows. Further columns are ignored, also those named as the flags.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, discard, join_spooled, pick, shared_dir, spool

WORD = r"[^\x20\x09-\x0D]+"
#: Words needed, percent of words that must be distinct, percent of capitals allowed.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
CAPITALS, MARKS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "[#$%&*|]"
FILTERS = ("A", "B", "C", "D", "E")
LOSSES = ("good", "toxic")
#: Files that the counts of a state are written to.
FILES = 4


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part and one boolean for each filter that a row of ``docs`` fails; spooled."""
    rows = pick(docs, doc_id="bigint", text="string", source="string").select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    n_chars = F.char_length("text")
    told = rows.select(
        "doc_id", "part", words.alias("words"), F.sha2("text", 256).alias("digest"),
        (100 * (n_chars - F.char_length(F.translate("text", CAPITALS, ""))) > MOST_CAPITALS * n_chars).alias("C"), F.col("text").rlike(MARKS).alias("D"),
    )
    n_words = F.size("words")
    flags = spool(told.select("doc_id", "part", F.unhex("digest").alias("digest"), (n_words < LEAST_WORDS).alias("A"), (100 * F.size(F.array_distinct("words")) < LEAST_DISTINCT * n_words).alias("B"), "C", "D"), "op11-flags")
    seen = flags.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))
    repeated = spool(seen.where("n > 1").select("digest", "least"), "op11-repeated")
    out = join_spooled(flags, repeated, "digest").select("doc_id", "part", "A", "B", "C", "D", F.coalesce(F.col("least") < F.col("doc_id"), F.lit(False)).alias("E"))
    return spool(out, "op11-failures")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with the booleans good and toxic of their doc_id, false where there is no label."""
    said = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).where("doc_id is not null")
    said = said.groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    few = labels.count() <= BROADCAST_ROWS
    out = rows.join(F.broadcast(said) if few else said, "doc_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in LOSSES})


def edges(rows: DataFrame, filters: Sequence[str], losses: Sequence[str] = ()) -> DataFrame:
    """part, state, filter, alive, removed and one count for each loss: of the rows that survive the
    filters of ``state`` (their names in order of ``filters``), those that ``filter`` removes.

    rows: part, one boolean for each filter (fails it) and for each loss. Parts without survivors have
    no row of that state.
    """
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/op11-edges-{uuid.uuid4().hex}"
    done: set[frozenset[str]] = set()

    # counts of all filters in every state, so that the compiled code of one serves all
    sums = [F.count("*").alias("alive"), *[F.count_if(f).alias(f) for f in filters], *[F.count_if(F.col(f) & F.col(x)).alias(f"{f}_{x}") for f in filters for x in losses]]

    def count(state: frozenset[str], alive: DataFrame) -> None:
        out = alive.groupBy("part").agg(*sums).withColumn("state", F.lit("".join(f for f in filters if f in state)))
        out.coalesce(FILES).write.mode("append").parquet(path)

    def walk(state: frozenset[str], alive: DataFrame) -> None:
        done.add(state)
        count(state, alive)
        for f in filters:
            after = state | {f}
            if f in state or after in done or len(after) == len(filters):
                continue
            survivors = alive.where(~F.col(f)).persist(StorageLevel.MEMORY_AND_DISK)
            walk(after, survivors)
            survivors.unpersist()

    walk(frozenset(), rows)
    each = F.array(*[F.struct(F.lit(f).alias("filter"), F.col(f).alias("removed"), *[F.col(f"{f}_{x}").alias(x) for x in losses]) for f in filters])
    return spark.read.parquet(path).select("part", "state", "alive", F.explode(each).alias("e")).select("part", "state", "alive", "e.*").where(~F.col("state").contains(F.col("filter")))


def audit(rows: DataFrame, filters: Sequence[str] = FILTERS, losses: Mapping[str, str] | None = None) -> DataFrame:
    """One row for each part, filter_order and step, with kept, removed, redundant, unique_fails, the
    losses (column of ``rows`` to name of the result) and shapley. Filters are single letters."""
    losses = {x: f"{x}_lost" for x in LOSSES} if losses is None else losses
    spark, n = rows.sparkSession, len(filters)
    found = edges(rows, filters, list(losses))
    name = lambda state: "".join(f for f in filters if f in state)
    every = [(name(s), f) for k in range(n) for s in itertools.combinations(filters, k) for f in filters if f not in s]
    places = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(f).alias("filter")) for s, f in every])
    parts = found.where("state = ''").select("part").distinct()
    whole = parts.select("part", F.explode(places).alias("e")).select("part", "e.*").join(found, ["part", "state", "filter"], "left")
    whole = whole.fillna(0, ["alive", "removed", *losses])
    through = F.element_at(F.array(*[F.lit(math.factorial(k) * math.factorial(n - 1 - k)) for k in range(n)]), F.length("state") + 1)
    own = Window.partitionBy("part", "filter")
    whole = whole.select(
        "*", F.max(F.when(F.col("state") == "", F.col("removed"))).over(own).alias("fails"), F.max(F.when(F.length("state") == n - 1, F.col("removed"))).over(own).alias("unique_fails"),
        F.sum(F.col("removed") * through).over(own).alias("shapley"),
    )
    # n! orders of n steps: 600 rows for five filters
    steps = [("".join(o), k + 1, name(o[:k]), o[k]) for o in itertools.permutations(filters) for k in range(n)]
    orders = spark.createDataFrame(steps, "filter_order string, step int, state string, filter string")
    return whole.join(F.broadcast(orders), ["state", "filter"]).select(
        "part", "filter_order", "step", (F.col("alive") - F.col("removed")).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails",
        *[F.col(x).alias(y) for x, y in losses.items()], "shapley",
    )


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of FILTERS over whole ``docs``, with the good and the toxic documents of ``labels``."""
    flags = failures(docs)
    rows = spool(labelled(flags, labels).drop("doc_id"), "op11-rows")
    discard(flags)
    return audit(rows)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d
), l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, (CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN least < doc_id THEN 'E' ELSE '' END) AS fails,
    coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM w LEFT JOIN l USING (doc_id)
), g AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE toxic) AS n_toxic FROM f GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT o, s AS step, substr(o, s, 1) AS x, substr(o, 1, s - 1) AS before FROM orders, range(1, 6) r(s)
), hit AS (
  SELECT part, o, step, x, n, n_good, n_toxic, contains(fails, x) AS failing, length(translate(fails, before, '')) < length(fails) AS earlier, fails = x AS only_ FROM g, steps
), e AS (
  SELECT part, o, step, x, coalesce(sum(n) FILTER (WHERE NOT earlier AND NOT failing), 0) AS kept, coalesce(sum(n) FILTER (WHERE NOT earlier AND failing), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE earlier AND failing), 0) AS redundant, coalesce(sum(n) FILTER (WHERE only_), 0) AS unique_fails,
    coalesce(sum(n_good) FILTER (WHERE NOT earlier AND failing), 0) AS good_lost, coalesce(sum(n_toxic) FILTER (WHERE NOT earlier AND failing), 0) AS toxic_lost
  FROM hit GROUP BY part, o, step, x
)
SELECT part, o AS filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM e
"""
