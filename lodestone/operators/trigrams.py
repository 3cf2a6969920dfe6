"""Substring search through postings of trigrams: candidates by intersection, then verified.

A trigram is three bytes in a row of a lower-case text in UTF-8, as a number: a text that holds another
holds all of its trigrams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import work_table

#: Folders that postings are dealt to by a hash of the trigram; a search opens those of its trigrams.
BUCKETS = 64
#: Trigrams of a query that are intersected, rarest first; queries of a block.
RAREST, QUERY_BLOCK = 4, 4096
#: Bytes of text that are worked on at once.
SLICE_BYTES = 1 << 20
#: Tasks that write a folder, so that a frequent trigram isn't one task's.
WRITERS = 4


def distinct_grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Place of the text, and trigram, of each distinct trigram of each text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, off, data = texts.buffers()
    if data is None:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    code = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].astype(np.int64)
    code = (code[:-2] << 16) | (code[1:-1] << 8) | code[2:]
    ends = np.repeat(offsets[1:] - offsets[0], np.diff(offsets))[: len(code)]
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))[: len(code)]
    whole = np.arange(len(code)) + 3 <= ends
    found = np.unique((text[whole] << 24) | code[whole])
    return found >> 24, found & ((1 << 24) - 1)


def grams(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """The columns ``key`` (a bigint) and gram: a row for each distinct trigram of a row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, at = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0)), dtype=np.int64), 0
            while at < batch.num_rows:
                upto = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES, "right")))
                row, gram = distinct_grams(batch.column("text").slice(at, upto - at))
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(at, upto - at).take(pa.array(row)), pa.array(gram)], names=[key, "gram"])
                at = upto

    return rows.select(F.col(key).cast("bigint").alias(key), F.lower(text).alias("text")).mapInArrow(run, f"{key} bigint, gram bigint")


def bucket(gram: str) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


@dataclass
class TrigramIndex:
    """Postings (gram, id) and how many rows hold each trigram (gram, n), both by bucket, under ``path``."""

    path: str

    def read(self, spark: SparkSession, part: str, buckets: list[int]) -> DataFrame:
        kinds = {"postings": "gram bigint, id bigint, bucket int", "counts": "gram bigint, n bigint, bucket int"}
        return spark.read.schema(kinds[part]).parquet(f"{self.path}/{part}").where(F.col("bucket").isin(buckets))


def build_trigrams(rows: DataFrame, path: str) -> TrigramIndex:
    """Index the rows (id, text). Null texts and ids have no postings; rows that share an id count as one."""
    posted = grams(rows.where("id is not null"), "id", F.col("text")).withColumn("bucket", bucket("gram"))
    dealt = posted.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(WRITERS)))
    dealt.sortWithinPartitions("bucket", "gram", "id").write.partitionBy("bucket").parquet(f"{path}/postings")
    held = rows.sparkSession.read.schema("gram bigint, id bigint, bucket int").parquet(f"{path}/postings")
    held.groupBy("bucket", "gram").agg(F.count("*").alias("n")).repartition("bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/counts")
    return TrigramIndex(path)


def candidates(index: TrigramIndex, asked: DataFrame) -> DataFrame:
    """query_id, id of the rows that hold the RAREST rarest trigrams of each query (query_id, asked: at
    least three characters), a block of them."""
    spark = asked.sparkSession
    wanted = work_table(grams(asked, "query_id", F.col("asked")).withColumn("bucket", bucket("gram")), "asked-grams")
    buckets = [r[0] for r in wanted.select("bucket").distinct().collect()]  # BUCKETS at most
    counts = index.read(spark, "counts", buckets).join(F.broadcast(wanted.select("gram").distinct()), "gram", "left_semi").select("gram", "n")
    of = wanted.join(counts, "gram", "left").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram", "bucket"))).alias("g"))
    rare = of.where("g[0].n > 0").select("query_id", F.slice("g", 1, RAREST).alias("g"))  # a trigram that no row holds: no result
    rare = work_table(rare.select("query_id", F.size("g").alias("n_grams"), F.posexplode("g").alias("place", "g")).select("query_id", "n_grams", "place", "g.gram", "g.bucket"), "rare-grams")  # RAREST rows for each query
    buckets = [r[0] for r in rare.select("bucket").distinct().collect()]
    hits = index.read(spark, "postings", buckets).join(F.broadcast(rare.drop("bucket")), "gram")
    every = hits.groupBy("query_id", "id").agg(F.bit_or(F.expr("shiftleft(1, place)")).alias("held"), F.max("n_grams").alias("n_grams"))
    return every.where("held = shiftleft(1, n_grams) - 1").select("query_id", "id")


def holds(columns: list[str]) -> Column:
    return reduce(Column.__or__, [F.lower(F.coalesce(c, F.lit(""))).contains(F.col("asked")) for c in columns])


def search(index: TrigramIndex, rows: DataFrame, queries: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of ``rows`` (id and others, of which the index holds ``columns``) with query_id, for each
    row and query (query_id, query_text) whose text is in one of the columns, whatever its case.

    A row is compared with the queries alone whose trigrams it holds. Texts under three bytes, which have none,
    are compared with all rows, all such queries at once. Empty and null texts find nothing.
    """
    asked = queries.select("query_id", F.lower("query_text").alias("asked")).where("asked <> ''")
    n, out = max(1, -(-asked.count() // QUERY_BLOCK)), None
    for b in range(n):
        block = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b)
        long, short = block.where(F.octet_length("asked") >= 3), block.where(F.octet_length("asked") < 3)
        near = candidates(index, long).join(F.broadcast(long), "query_id")
        part = rows.join(near, "id").where(holds(columns))
        if short.limit(1).count():
            part = part.unionByName(rows.join(F.broadcast(short), holds(columns)).select(*part.columns))
        out = part if out is None else out.unionByName(part)
    return out.drop("asked")
