"""Audit of how sources diverge: of each language and source the terms that it has more of than its
language, and the distance of each two sources of a language.

1. Tasks count terms and documents that hold them by (lang, source); the counts are summed over all
   documents. A language keeps the terms that enough of its documents hold. What is left are postings:
   (lang, source, term) with the count there and in the language.
2. p of a term is 1 + floor(10**9 * (count + 5) / (N + 5 * V)), all in whole numbers. It rises with
   the count, so that a bucket of a group's postings of like counts has the bound p(largest count) -
   q(smallest count in the language) on what its terms exceed their language by.
3. The top terms of a group are searched best-first: buckets of the greatest bounds are evaluated until
   no bucket that was left out has a bound of the k-th value found or more. So ties are whole.
4. Distances come from the postings, in blocks of sources and shards of terms: a task sums the
   differences of the terms that its blocks hold, in bounded matrices. A term that neither of two
   sources holds differs by what p is without a count; these are added by their number.

Null texts, langs and sources count as ''. Groups whose documents hold no kept term have all p alike and
distances to the others, and no rows of part `term`. A lang of one source has no rows of part `pair`.
Repeated rows, with or without a doc_id, count each. Long texts are counted whole. An empty table gives
no rows. Further columns are ignored. Ties are ranked by the item's UTF-8 bytes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, join_spooled, pick, spool

#: Documents of a language that must hold a term, what is added to a count, the scale of p.
LEAST_DOCS, ADDED, THOUSANDS = 30, 5, 3
TOP = 50
#: Terms that a task holds before it gives them out; rows of an Arrow batch.
HELD, ROWS = 1_000_000, 1 << 16
#: Sources of a block, about; postings of a shard of two blocks, about; terms of a matrix.
BLOCK, SHARD, WIDE = 256, 50_000, 2048
#: Buckets of counts for each doubling.
FINE = 4

_GAPS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and characters beyond ASCII, with A-Z in lower case."""
    return text.translate(_GAPS).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, count, docs. A group has a row of an empty term, so that none is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}
        for batch in batches:
            lang, source, text = (batch.column(c).cast(pa.large_binary()).to_pylist() for c in ("lang", "source", "text"))
            for key0, key1, said in zip(lang, source, text, strict=True):
                total, having = held.setdefault((key0, key1), (Counter(), Counter()))
                found = terms(said)
                total.update(found)
                having.update(set(found))
            if sum(len(x) for x, _ in held.values()) > HELD:
                yield from given(held)
                held.clear()
        yield from given(held)

    def given(held: dict[tuple[bytes, bytes], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (total, having) in held.items():
            total[b""] = having[b""] = 0
            found = list(total.items())
            for at in range(0, len(found), ROWS):
                some = found[at : at + ROWS]
                n = len(some)
                columns = [pa.array([x] * n, pa.binary()).cast(pa.string()) for x in (lang, source)] + [pa.array([t for t, _ in some], pa.binary()).cast(pa.string()), pa.array([c for _, c in some], pa.int64()), pa.array([having[t] for t, _ in some], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "count", "docs"])

    rows = pick(docs, lang="string", source="string", text="string").fillna("")
    parts = rows.mapInArrow(run, "lang string, source string, term string, count bigint, docs bigint")
    return parts.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def share(count: str, total: str, v: str) -> Column:
    """p of a count of ``total`` with ``v`` terms; names of columns or numbers. Whole numbers throughout,
    three digits of the quotient at a time, so that up to 9 * 10**15 occurrences don't overflow."""
    most, left, out = f"greatest({total} + {ADDED} * {v}, 1)", f"({count} + {ADDED})", "0L"
    for _ in range(THOUSANDS):
        out, left = f"({out} * 1000 + ({left} * 1000) div {most})", f"(({left} * 1000) % {most})"
    return F.expr(f"1 + {out}")


def whole_share(count: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The same for arrays; ``most`` is the total with ADDED * v."""
    most, left, out = np.maximum(most, 1), count + ADDED, np.zeros(np.broadcast_shapes(count.shape, most.shape), np.int64)
    for _ in range(THOUSANDS):
        out, left = out * 1000 + left * 1000 // most, left * 1000 % most
    return out + 1


def postings(docs: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """Postings of kept terms (lang, source, term, count, n: count in the lang, bucket), and groups (lang,
    source, total, v, lang_total, blocks, shards). Both spooled."""
    counts = spool(term_counts(docs), "op13-counts")
    kept = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("count").alias("n"), F.sum("docs").alias("docs"))
    kept = spool(kept.where(F.col("docs") >= least_docs).drop("docs"), "op13-terms")
    bucket = F.floor(FINE * F.log2("count")).cast("int")
    posted = spool(join_spooled(counts.where("term <> ''").drop("docs"), kept, ["lang", "term"], "inner").withColumn("bucket", bucket), "op13-postings")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_total"))
    sums = posted.groupBy("lang", "source").agg(F.sum("count").alias("total"), F.count("*").alias("n_terms"))
    groups = counts.where("term = ''").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0)
    # few numbers of a lang, by a sum that is combined before the shuffle
    sizes = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.sum("n_terms").alias("rows"))
    sizes = sizes.select("lang", "blocks", F.greatest(F.lit(1), F.ceil(2 * F.col("rows") / F.col("blocks") / SHARD)).cast("int").alias("shards"))
    groups = spool(groups.drop("n_terms").join(sizes, "lang"), "op13-groups")
    discard(counts, kept)
    return posted, groups


def top_terms(posted: DataFrame, groups: DataFrame, k: int = TOP) -> DataFrame:
    """lang, source, item, value, rank: of each group the k kept terms that exceed their lang's p most."""
    key = ["lang", "source"]
    n_groups = groups.count()
    of = groups.select(*key, "total", "v", "lang_total")
    sums = posted.groupBy(*key, "bucket").agg(F.count("*").alias("n_terms"), F.max("count").alias("most"), F.min("n").alias("fewest"))
    bound = share("most", "total", "v") - share("fewest", "lang_total", "v")
    bounds = join_spooled(sums, of, key, "inner", n_groups).select(*key, "bucket", "n_terms", bound.alias("bound"))
    bounds = spool(bounds.where("bound > 0"), "op13-bounds")
    best_first = Window.partitionBy(*key).orderBy(F.desc("bound"), "bucket")
    ranked = Window.partitionBy(*key).orderBy(F.desc("value"), "item")
    unseen, found, wanted = bounds, None, k
    while True:
        before = F.coalesce(F.sum("n_terms").over(best_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        told = spool(unseen.withColumn("now", before < wanted), "op13-order")
        now = spool(told.where("now").select(*key, "bucket"), "op13-now")
        if (n := now.count()) == 0:
            break
        rows = join_spooled(posted, now, [*key, "bucket"], "inner", n)
        over = share("count", "total", "v") - share("n", "lang_total", "v")
        values = join_spooled(rows, of, key, "inner", n_groups).select(*key, F.col("term").alias("item"), over.alias("value")).where("value > 0")
        both = values if found is None else found.drop("rank").unionByName(values)
        found = spool(both.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k), "op13-found")
        kth = found.where(F.col("rank") == k).select(*key, F.col("value").alias("kth"))
        left = join_spooled(told.where("not now"), kth, key, "left", n_groups)
        unseen, wanted = left.where("kth is null or bound >= kth").select(*key, "bucket", "n_terms", "bound"), 4 * wanted
    return now.select(*key, F.lit("").alias("item"), F.lit(0).cast("bigint").alias("value"), F.lit(0).alias("rank")) if found is None else found


def distances(posted: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: of each two sources of a lang the sum of differences of p, both ways."""
    key, n_groups = ["lang", "source"], groups.count()
    of = groups.select(*key, (F.col("total") + ADDED * F.col("v")).alias("most"), F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block"), "blocks", "shards")
    said = join_spooled(posted.select(*key, "term", "count"), of, key, "inner", n_groups).withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int"))
    silent = of.select("*", F.lit(None).cast("string").alias("term"), F.lit(0).cast("bigint").alias("count"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    rows = said.unionByName(silent).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("lang", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "shard", "block", "source", "most", "term", "count")
    schema = "lang string, source string, item string, value bigint, n_terms bigint"
    parts = rows.groupBy("lang", "low", "high", "shard").applyInArrow(differences, schema)
    sums = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("n_terms").alias("n_terms"))
    silence = groups.select(*key, "v", share("0L", "total", "v").alias("p0"))
    theirs = silence.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    both = join_spooled(join_spooled(sums, silence, key, "inner", n_groups), theirs, ["lang", "item"], "inner", n_groups)
    value = F.col("value") + (F.col("v") - F.col("n_terms")) * F.abs(F.col("p0") - F.col("q0"))
    ways = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    return both.select("lang", F.explode(ways).alias("way"), value.alias("value")).select("lang", "way.source", "way.item", "value")


def differences(table: pa.Table) -> pa.Table:
    """Sums of differences of each source of the lower block and each of the higher one, over the terms
    of this shard that either block holds, of which n_terms is the number."""
    lang, low, high = (table.column(c)[0].as_py() for c in ("lang", "low", "high"))
    codes = table.column("source").combine_chunks().dictionary_encode()
    order = np.argsort(pc.rank(codes.dictionary).to_numpy())  # by name, so that all shards name a pair alike
    sources, at = codes.dictionary.take(pa.array(order)), np.argsort(order)[codes.indices.to_numpy()]
    most, block = np.zeros(len(sources), np.int64), np.zeros(len(sources), np.int64)
    most[at], block[at] = table.column("most").to_numpy(), table.column("block").to_numpy()
    low_at, high_at = np.flatnonzero(block == low), np.flatnonzero(block == high)
    said = np.flatnonzero(~pc.is_null(table.column("term")).to_numpy(zero_copy_only=False))
    words = table.column("term").combine_chunks().take(pa.array(said)).dictionary_encode()
    term, n_terms = words.indices.to_numpy(), len(words.dictionary)
    order = np.argsort(term, kind="stable")
    term, who = term[order], at[said][order]
    p = whole_share(table.column("count").to_numpy()[said][order], most[who])
    silent = whole_share(np.zeros(len(sources), np.int64), most)
    sums = np.zeros((len(low_at), len(high_at)), np.int64)
    for begin in range(0, n_terms, WIDE):
        width = min(WIDE, n_terms - begin)
        lo, hi = np.searchsorted(term, [begin, begin + width])
        matrix = np.repeat(silent[:, None], width, axis=1)
        matrix[who[lo:hi], term[lo:hi] - begin] = p[lo:hi]
        theirs = matrix[high_at]
        for k, mine in enumerate(low_at):
            sums[k] += np.abs(theirs - matrix[mine]).sum(axis=1)
    a, b = (x.reshape(-1) for x in np.meshgrid(low_at, high_at, indexing="ij"))
    use = np.flatnonzero(a < b) if low == high else np.arange(len(a))
    return pa.table({"lang": pa.array([lang] * len(use), pa.string()), "source": sources.take(pa.array(a[use])), "item": sources.take(pa.array(b[use])), "value": pa.array(sums.reshape(-1)[use]), "n_terms": pa.array(np.full(len(use), n_terms, np.int64))})


def audit(docs: DataFrame, k: int = TOP, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    posted, groups = postings(docs, least_docs)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = distances(posted, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
    over = top_terms(posted, groups, k).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(over)


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), t AS (
  SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 30
), l AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM t GROUP BY lang
), c AS (
  SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN t USING (lang, term) GROUP BY ALL
), g AS (
  SELECT lang, source, coalesce(v, 0) AS v, coalesce(l.total, 0) AS lang_total, coalesce(s.total, 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN l USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) s USING (lang, source)
), p AS (
  SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * v) AS p, 1 + (1000000000::HUGEINT * (t.n + 5)) // (lang_total + 5 * v) AS q
  FROM g JOIN t USING (lang) LEFT JOIN c USING (lang, source, term)
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y USING (lang, term) GROUP BY ALL) f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
), found AS (
  SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
