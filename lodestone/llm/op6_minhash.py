"""MinHash near-dedup with tensored banding.

1. Each text becomes a sketch: the size and a 128-bit digest of its set of distinct word shingles,
   two small collections of TUPLES minhash pairs, and a parity bitmap.
2. Documents with equal sets form a class, of which one takes part from here on.
3. Table keys are formed by combining a pair of the first collection with a pair of the second:
   TUPLES**2 tables of four minhashes out of 4 * TUPLES minhashes. A half key that no other
   document has can't be part of a shared table key, so those go before keys are combined.
   Similarity 0.75 is missed by a share of 2 * (1 - 0.75**2)**TUPLES, below 2e-5 at 14.
4. In each bucket members are paired with its smallest member. Bitmaps give a lower bound of the
   symmetric difference, which drops pairs that can't be similar enough without loss.
5. Pairs left are confirmed on the full sets, from the texts, and give components. Pairs of one
   document are dealt into groups, to each of which its text goes once. Members of buckets
   that hold several components may still be linked across these; such pairs are found by prefix and
   position filters on the full sets, which lose none, and confirmed likewise.

A document without words has no shingles and is linked with nothing; one with fewer words than a
shingle has one shingle, its whole sequence. Null texts count as empty. Rows with a null doc_id take
no part: they return their size, a null component and kept true. Rows that repeat a doc_id count as
one document; each row is returned. Very long texts enter whole, each with the set of all its shingles
in one task. There are no ties: the smallest doc_id of a component stays, and a similarity of exactly the
threshold links. Further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, discard, join_spooled, pick, spool
from .words import Words, mix, slices, words_of

WORDS, PERCENT, TUPLES = 5, 75, 14
#: Pairs of one document that are confirmed in one group.
PAIR_ROWS = 1000
#: Holders of a shingle that one task pairs with those of its prefix side.
HOLDERS = 1000

SKETCH = "doc_id bigint, n_shingles bigint, set_id binary, first array<bigint>, second array<bigint>, bitmap binary"


def shingle_sets(words: Words, size: int = WORDS) -> Iterator[np.ndarray]:
    """The set of each text, as sorted distinct 64-bit hashes."""
    grams = words.grams(size)
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        n = int(b - a)
        if n >= size:
            yield np.unique(grams[a : b - size + 1])
        elif n:
            short = Words(words.data, words.starts[a:b], words.ends[a:b], words.hashes[a:b], np.array([0, n]))
            yield short.grams(n)
        else:
            yield np.empty(0, np.uint64)


def parity_bitmap(shingles: np.ndarray) -> np.ndarray:
    """Bits that an odd number of shingles fall on; their count is the next power of two over twice the set."""
    bits = max(64, 1 << int(2 * len(shingles) - 1).bit_length())
    at = (shingles & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little")


_ONES = np.array([bin(x).count("1") for x in range(256)], np.uint8)


def least_difference(a: bytes, b: bytes) -> int:
    """Lower bound of the size of the symmetric difference of two sets, from their bitmaps."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):  # positions are low bits, so halves fold
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(_ONES[x ^ y].sum())


def minhashes(shingles: np.ndarray, n: int) -> np.ndarray:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64))[:, None]
    mul, add = seeds[:n] | np.uint64(1), seeds[n:]
    least = np.full(n, 2**64 - 1, np.uint64)
    for i in range(0, len(shingles), 2048):
        least = np.minimum(least, (shingles[None, i : i + 2048] * mul + add).min(axis=1))
    return least


def half_keys(least: np.ndarray, tuples: int) -> tuple[list[int], list[int]]:
    pairs = least.reshape(2 * tuples, 2)
    keys = mix(mix(pairs[:, 0]) + pairs[:, 1] + np.arange(2 * tuples, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    keys = keys.view(np.int64).tolist()
    return keys[:tuples], keys[tuples:]


def sketches(docs: DataFrame, size: int = WORDS, tuples: int = TUPLES) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, ids, first, second, bitmaps = [], [], [], [], []
            for s in shingle_sets(words_of(batch.column("text"), lower=True), size):
                sizes.append(len(s))
                if len(s):
                    a, b = half_keys(minhashes(s, 4 * tuples), tuples)
                    ids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    bitmaps.append(parity_bitmap(s).tobytes())
                else:
                    a = b = None
                    ids.append(None)
                    bitmaps.append(None)
                first.append(a)
                second.append(b)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(first, longs), pa.array(second, longs), pa.array(bitmaps, pa.binary())],
                names=["doc_id", "n_shingles", "set_id", "first", "second", "bitmap"],
            )

    return pick(docs, doc_id="bigint", text="string").mapInArrow(run, SKETCH)


def table_keys(reps: DataFrame) -> DataFrame:
    """rep, key: the table keys of ``reps`` that may be shared."""
    halves = reps.select("rep", F.explode("first").alias("half"), F.lit(True).alias("a")).unionByName(reps.select("rep", F.explode("second").alias("half"), F.lit(False).alias("a")))
    shared = spool(halves.groupBy("half").count().where("count > 1").select("half"), "op6-halves")
    left = join_spooled(halves, shared, "half", "left_semi")
    lists = left.groupBy("rep").agg(F.collect_list(F.when(F.col("a"), F.col("half"))).alias("x"), F.collect_list(F.when(~F.col("a"), F.col("half"))).alias("y"))
    pairs = lists.select("rep", F.explode("x").alias("x"), "y").select("rep", "x", F.explode("y").alias("y"))
    return pairs.select("rep", F.xxhash64("x", "y").alias("key"))


def plausible(pairs: DataFrame, reps: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose sizes and bitmaps allow the similarity."""
    side = reps.select("rep", "n_shingles", "bitmap")
    both = pairs.join(side.toDF("a", "na", "bits_a"), "a").join(side.toDF("b", "nb", "bits_b"), "b")
    both = both.where((100 * F.col("na") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("na")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            # |A ^ B| <= (|A| + |B|) * (100 - p) / (100 + p)
            ok = [least_difference(x, y) * (100 + percent) <= (m + n) * (100 - percent) for x, y, m, n in zip(f.bits_a, f.bits_b, f.na, f.nb, strict=True)]
            yield f.loc[ok, ["a", "b"]]

    return both.select("a", "b", "na", "nb", "bits_a", "bits_b").mapInPandas(run, "a bigint, b bigint")


def confirmed(pairs: DataFrame, docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets have the similarity.

    The text of each b goes to the task of its a, and the text of a only once for PAIR_ROWS pairs, into
    which the pairs of an a are dealt, so that a hot one is in many tasks. Pairs are looked up where
    texts are read if they are few; else each text of a pair is shuffled once more.
    """
    hot = spool(pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIR_ROWS).alias("parts")).where("parts > 1"), "op6-hot")
    pairs = spool(join_spooled(pairs, hot, "a").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), "parts"), F.lit(0)).alias("part")), "op6-dealt")
    n = pairs.count()
    few = lambda df: F.broadcast(df) if n <= BROADCAST_ROWS else df
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = pick(docs, doc_id="bigint", text="string")
    texts = spool(texts.join(few(ids), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "op6-texts")
    leads = pairs.select("a", "part").distinct().withColumn("b", F.lit(None).cast("bigint"))
    rows = leads.withColumn("doc_id", F.col("a")).unionByName(pairs.select("a", "part", "b", F.col("b").alias("doc_id")))
    rows = texts.join(few(rows), "doc_id").select("a", "part", "b", "text").repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = np.empty(0, np.uint64)
        for batch in slices(batches):
            keep = []
            for b, s in zip(batch.column("b").to_pylist(), shingle_sets(words_of(batch.column("text"), lower=True), size), strict=True):
                if b is None:  # a's own row comes first
                    lead = s
                    keep.append(False)
                else:
                    common = len(np.intersect1d(lead, s, assume_unique=True))
                    keep.append(100 * common >= percent * (len(s) + len(lead) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, "a bigint, b bigint")


def pairs_apart(members: DataFrame, docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """All pairs a, b of ``members`` (rep, component) of different components that may be similar
    enough, by prefix and position filters, which lose none.

    Shingles are ordered by how many members have them. Two sets that are similar enough share one
    among the first of each, and what follows the first shared one must suffice for the overlap. So
    a passage of many documents pairs none of them, as it comes last. Holders of a shingle meet by class
    of size, and those of a frequent one are dealt to tasks by HOLDERS.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [s.view(np.int64) for s in shingle_sets(words_of(batch.column("text"), lower=True), size)]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["rep", "n", "shingles"])

    texts = pick(docs, doc_id="bigint", text="string").withColumnRenamed("doc_id", "rep")
    sets = join_spooled(texts, members.select("rep"), "rep", "left_semi").mapInArrow(run, "rep bigint, n bigint, shingles array<bigint>")
    rows = sets.select("rep", "n", F.explode("shingles").alias("shingle"))
    known = spool(rows.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1"), "op6-df")
    lists = join_spooled(rows, known, "shingle", "inner").groupBy("rep").agg(F.first("n").alias("n"), F.sort_array(F.collect_set(F.struct("df", "shingle"))).alias("known"))
    # prefixes for partners of any size, and for partners at least as large
    probe, index = f"n - ({percent} * n + 99) div 100 + 1", f"n - (2 * {percent} * n + 99 + {percent}) div (100 + {percent}) + 1"
    rest = F.expr(f"slice(known, 1, greatest(0, cast({probe} - n + size(known) as int)))")
    heads = lists.select("rep", "n", (F.col("n") - F.size("known")).alias("unknown"), F.expr(index).alias("index"), F.posexplode(rest).alias("k", "s"))
    heads = join_spooled(heads.select("rep", "n", "index", (F.col("unknown") + F.col("k")).alias("at"), "s.shingle"), members, "rep", "inner")
    heads = spool(heads, "op6-heads")
    held = heads.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n_holders"))
    split = spool(held.where("low < high").select("shingle", F.ceil(F.col("n_holders") / HOLDERS).cast("int").alias("parts")), "op6-split")
    # of a pair the larger set is in the size class of the smaller one, or in the next, as classes are as wide as sizes may differ
    classed = F.floor(F.log(F.col("n").cast("double")) / math.log(1.001 * 100 / percent)).cast("int")
    heads = spool(join_spooled(heads, split, "shingle", "inner").withColumn("class", classed), "op6-split-heads")
    x = heads.select("shingle", "class", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part"), F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("at").alias("at_b"), F.col("component").alias("cb"))
    y = heads.where("at < index").withColumn("class", F.explode(F.array("class", F.col("class") + 1))).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    y = y.select("shingle", "class", "part", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("at").alias("at_a"), F.col("component").alias("ca"))
    fits = f"ca <> cb and (na < nb or na = nb and a < b) and 100 * na >= {percent} * nb and (100 + {percent}) * least(na - at_a, nb - at_b) >= {percent} * (na + nb)"
    return x.join(y, ["shingle", "class", "part"]).where(fits).select("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of every node of the undirected links (a, b).

    Large-star and small-star rounds, each a table in the shared folder, until neither changes links.
    """
    edges = spool(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc")
    digest = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    mark = edges.agg(F.count("*"), digest).first()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = spool(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-least")
        large = join_spooled(both.where("v > u"), least, "u", "inner").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = spool(large, "cc-large")
        least2 = spool(large.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
        small = join_spooled(large, least2, "u", "inner")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        small = spool(small, "cc")
        discard(edges, least, large, least2)
        edges, before = small, mark
        mark = edges.agg(F.count("*"), digest).first()
        if mark == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def near_duplicates(docs: DataFrame, size: int = WORDS, percent: int = PERCENT, tuples: int = TUPLES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs``."""
    sketch = spool(sketches(docs, size, tuples), "op6-sketches")
    named = sketch.where("doc_id is not null and set_id is not null")
    classes = named.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    classes = spool(classes, "op6-classes")
    shared_sets = spool(classes.where("n > 1").select("set_id", "rep"), "op6-shared-sets")
    reps = join_spooled(named, classes.select("set_id", F.col("rep").alias("doc_id")), ["set_id", "doc_id"], "left_semi")
    reps = spool(reps.dropDuplicates(["set_id"]).withColumnRenamed("doc_id", "rep").drop("set_id"), "op6-reps")

    keys = spool(table_keys(reps), "op6-keys")
    leaders = keys.groupBy("key").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).where("lead < last").select("key", "lead")
    leaders = spool(leaders, "op6-leaders")
    n_leaders = leaders.count()
    members = spool(join_spooled(keys, leaders, "key", "inner", n_leaders), "op6-members")
    discard(keys)
    pairs = spool(plausible(members.where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct(), reps, percent), "op6-pairs")
    links = spool(confirmed(pairs, docs, size, percent), "op6-links")
    labels = spool(components(links), "op6-labels")
    at = join_spooled(members.withColumnRenamed("rep", "node"), labels, "node").select("key", F.col("node").alias("rep"), F.coalesce("component", "node").alias("component"))
    at = spool(at, "op6-at")
    mixed = spool(at.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key"), "op6-mixed")
    apart = spool(join_spooled(at, mixed, "key", "left_semi").select("rep", "component").distinct(), "op6-apart")
    discard(members, at, mixed)
    more = spool(plausible(pairs_apart(apart, docs, size, percent), reps, percent), "op6-more")
    if more.limit(1).count():
        found = spool(confirmed(more, docs, size, percent), "op6-links")
        labels = spool(components(links.unionByName(found)), "op6-labels")
    n_labels = labels.count()
    out = join_spooled(sketch.select("doc_id", "n_shingles", "set_id"), shared_sets, "set_id").withColumn("node", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")))
    out = join_spooled(out, labels, "node", "left", n_labels)
    found = F.coalesce("component", "node")
    return out.select("doc_id", "n_shingles", found.alias("component_id"), F.coalesce(F.col("doc_id") == found, F.lit(True)).alias("kept"))


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT row, doc_id, array_to_string(w[i:i + {WORDS - 1}], ' ') AS shingle FROM (SELECT row, doc_id, w, unnest(range(1, greatest(2, len(w) - {WORDS - 2}))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT row, doc_id, count(*) AS n FROM s GROUP BY ALL
), links AS (
  SELECT DISTINCT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, x.row AS ra, y.row AS rb, count(*) AS common FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.row = ra JOIN n nb ON nb.row = rb WHERE 100 * common >= {PERCENT} * (na.n + nb.n - common)
), reach(node, other) AS (
  SELECT DISTINCT doc_id, doc_id FROM d WHERE doc_id IS NOT NULL UNION SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.other
), least AS (
  SELECT node, min(other) AS component_id FROM reach GROUP BY node
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least.component_id, coalesce(d.doc_id = least.component_id, true) AS kept
FROM d LEFT JOIN n ON n.row = d.row LEFT JOIN least ON least.node = d.doc_id
"""
