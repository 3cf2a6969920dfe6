"""Toxicity by maximum-scoring segments.

1. Over all documents, words and their leading bytes (PREFIXES) are counted by hashed bucket: in how
   many documents, and in how many labelled toxic and clean ones. Log-odds of toxic against clean
   get a Dirichlet prior in proportion to the counts over the whole corpus, and a z-score. A word
   scores the log-odds of its most specific bucket with |z| of Z_LEAST or more, less DRIFT; its kth
   occurrence in a document scores a kth of the log-odds, as words come in bursts.
2. One scan finds all maximal-scoring segments of each text in linear time.
3. Segment scores are made comparable across lengths by extreme-value statistics: lambda solves
   sum(p * exp(lambda * s)) = 1 over the corpus, and a segment of score S in n words is worth
   lambda * S - ln(n). Those worth over 0 are significant; a document's statistic is their sum, or
   else the worth of its best segment. It becomes a probability by monotone regression on labelled
   documents that the counts left out.

Labels come from rows whose crc32(doc_id) mod 4 isn't HELD_OUT; of these CALIBRATION calibrates and
the rest counts. At most LABEL_ROWS labelled rows are used, by hash of doc_id. Null and empty texts
have no segment and get the rate of documents without any. Without labels, or with labels of one
kind, every score is that rate, or 0. Null labels are ignored; repeated labels all count. A null
doc_id isn't held out. Repeated rows are scored each. Very long texts
are scanned whole, in one pass; equal segments count each, and a document's score doesn't depend on which of
several best ones is named. Equal statistics get equal scores. Further columns are ignored by ``scores`` and
kept by ``clean_rows``; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, discard, pick, spool
from .words import PUNCTUATION, Words, hash_words, slices, words_of

FOLDS, HELD_OUT, CALIBRATION = 4, 2, 3
LABEL_ROWS = BROADCAST_ROWS
#: Levels of a word: itself, then its leading bytes. Each has 2**BITS buckets.
PREFIXES, BITS = (6, 5, 4), 20
PRIOR, Z_LEAST, LEAST_TOXIC, DRIFT = 10_000.0, 3.0, 4, 0.5
#: Bins of the statistic, from LOWEST up; the first is for documents without any segment.
LOWEST, BIN, BINS = -20.0, 0.5, 120
THRESHOLD = 0.3


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS, F.lit(0))


def levels(words: Words) -> Iterator[np.ndarray]:
    """Bucket of every word, from the most specific level on."""
    shift = np.uint64(64 - BITS)
    yield (words.hashes >> shift).astype(np.int64)
    for k, n in enumerate(PREFIXES, 1):
        yield (hash_words(words.data, words.starts, np.minimum(words.starts + n, words.ends)) >> shift).astype(np.int64) + (k << BITS)


def training(labels: DataFrame, rows: int = LABEL_ROWS) -> DataFrame:
    """doc_id, toxic, calibrates of at most about ``rows`` labelled rows outside the held-out fold."""
    used = pick(labels, doc_id="bigint", toxic="int").where((fold(F.col("doc_id")) != HELD_OUT) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    used = used.select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"), (fold(F.col("doc_id")) == CALIBRATION).alias("calibrates"))
    n = used.count()
    if n > rows:
        used = used.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * (rows / n)))
    return spool(used, "op8-labels")


def counts(docs: DataFrame, train: DataFrame) -> DataFrame:
    """bucket, toxic, clean, corpus: in how many documents of each kind it is."""
    told = train.where("not calibrates").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = pick(docs, doc_id="bigint", text="string").join(F.broadcast(told), "doc_id", "left")  # LABEL_ROWS at most
    size = (len(PREFIXES) + 1) << BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, size), np.int32)
        for batch in slices(batches):
            words = words_of(batch.column("text"), lower=True, gaps=PUNCTUATION)
            kind = batch.column("toxic").fill_null(2).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows, dtype=np.int64), np.diff(words.first))
            for bucket in levels(words):
                pairs = np.unique(row * size + bucket)
                of, bucket = kind[pairs // size], pairs % size
                np.add.at(sums[2], bucket, 1)
                for k in (0, 1):
                    if len(mine := bucket[of == k]):
                        np.add.at(sums[k], mine, 1)
        seen = np.flatnonzero(sums[2])
        for at in range(0, len(seen), 1 << 16):
            part = seen[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), *[pa.array(sums[k][part].astype(np.int64)) for k in (1, 0, 2)]], names=["bucket", "toxic", "clean", "corpus"])

    found = texts.select("text", "toxic").mapInArrow(run, "bucket bigint, toxic bigint, clean bigint, corpus bigint")
    return found.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("toxic", "clean", "corpus")])


@dataclass
class Model:
    """Log-odds of the buckets that tell (at most (len(PREFIXES) + 1) << BITS), and lambda."""

    buckets: np.ndarray
    odds: np.ndarray
    scale: float

    def dense(self) -> np.ndarray:
        out = np.full((len(PREFIXES) + 1) << BITS, np.nan, np.float32)
        out[self.buckets] = self.odds
        return out


def learn(counted: DataFrame) -> Model:
    level = F.shiftright("bucket", BITS)
    totals = counted.groupBy(level.alias("level")).agg(*[F.sum(c).alias(f"all_{c}") for c in ("toxic", "clean", "corpus")])
    rows = counted.withColumn("level", level).join(F.broadcast(totals), "level")  # a row for each level
    prior = PRIOR * F.col("corpus") / F.col("all_corpus")
    a, b = F.col("toxic") + prior, F.col("clean") + prior
    odds = F.log(a / (F.col("all_toxic") + PRIOR - a)) - F.log(b / (F.col("all_clean") + PRIOR - b))
    z = odds / F.sqrt(1 / a + 1 / b)
    told = (F.abs("z") >= Z_LEAST) & ((F.col("z") < 0) | (F.col("toxic") >= LEAST_TOXIC))
    rows = spool(rows.select("bucket", "level", "corpus", "all_corpus", "toxic", odds.alias("odds"), z.alias("z")).where(told), "op8-odds")
    got = rows.select("bucket", F.col("odds").cast("float")).toPandas()  # at most (len(PREFIXES) + 1) << BITS rows
    hist = rows.where("level = 0").groupBy(F.round("odds", 1).alias("s")).agg((F.sum("corpus") / F.first("all_corpus")).alias("p")).toPandas()
    discard(rows)
    s, p = np.append(hist.s.to_numpy(float), 0.0) - DRIFT, np.append(hist.p.to_numpy(float), 1 - hist.p.sum())
    low, high = 0.0, 4.0
    if (p * s).sum() >= 0 or not (s > 0).any():
        low = high = 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(mid * s)).sum() < 1 else (low, mid)
    return Model(got.bucket.to_numpy(np.int64), got.odds.to_numpy(np.float32), (low + high) / 2)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of a sequence, in linear time."""
    hits = np.flatnonzero(scores > 0)
    if not len(hits):
        return []
    upto = np.concatenate([[0.0], np.cumsum(scores)])
    # start, end, sum before it, sum with it, the last segment with a smaller sum before it (or -1)
    found: list[list] = []
    for i in hits.tolist():
        new = [i, i + 1, float(upto[i]), float(upto[i + 1])]
        k = len(found) - 1
        while k >= 0 and found[k][2] >= new[2]:
            k = found[k][4]
        while k >= 0 and found[k][3] < new[3]:
            new = [found[k][0], new[1], found[k][2], new[3]]
            link = found[k][4]
            del found[k:]
            k = link
        found.append([*new, k])
    return [(a, b, r - x) for a, b, x, r, _ in found]


def word_scores(words: Words, dense: np.ndarray) -> np.ndarray:
    out = np.full(len(words.hashes), np.nan, np.float32)
    for bucket in levels(words):
        out = np.where(np.isnan(out), dense[bucket], out)
    out = np.nan_to_num(out)
    hits = np.flatnonzero(out > 0)
    text = np.searchsorted(words.first, hits, "right")
    order = np.lexsort((hits, words.hashes[hits], text))
    text, word = text[order], words.hashes[hits][order]
    new = np.ones(len(hits), bool)
    new[1:] = (text[1:] != text[:-1]) | (word[1:] != word[:-1])
    at = np.arange(len(hits))
    out[hits[order]] /= at - np.maximum.accumulate(np.where(new, at, 0)) + 1
    return out - np.float32(DRIFT)


def read_text(scores: np.ndarray, scale: float) -> tuple[float | None, list[dict]]:
    """A text's statistic (none without a segment) and its significant segments."""
    if not (scores > 0).any():
        return None, []
    found, length = segments(scores.astype(np.float64)), np.log(len(scores))
    held = [{"start": x, "end": y, "score": s, "bits": w} for x, y, s in found if (w := scale * s - length) > 0]
    return sum(h["bits"] for h in held) if held else float(scale * max(s for _, _, s in found) - length), held


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """``docs``, of which text becomes statistic (null without a segment) and segments (start, end in
    words; score; bits), significant ones only."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("bits", pa.float64())]))
    kept = [f for f in docs.schema if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense, scale = shared.value.dense(), shared.value.scale
        for batch in slices(batches):
            words = words_of(batch.column("text"), lower=True, gaps=PUNCTUATION)
            scores = word_scores(words, dense)
            stats, lists = zip(*[read_text(scores[a:b], scale) for a, b in zip(words.first[:-1], words.first[1:], strict=True)], strict=True)
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(stats, pa.float64()), pa.array(lists, kind)], names=[*[f.name for f in kept], "statistic", "segments"])

    said = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "statistic double", "segments array<struct<start:bigint,end:bigint,score:double,bits:double>>"])
    return docs.mapInArrow(run, said)


def bin_of(statistic: Column) -> Column:
    return F.when(statistic.isNull(), 0).otherwise(F.greatest(F.lit(1), F.least(F.lit(BINS), 1 + F.floor((statistic - LOWEST) / BIN)))).cast("int")


def calibrated(scanned: DataFrame) -> list[float]:
    """Share of toxic documents by bin of the statistic, made monotone by pooling neighbours. scanned:
    statistic and toxic of the calibrating documents."""
    rows = scanned.groupBy(bin_of(F.col("statistic")).alias("bin")).agg(F.sum("toxic").alias("n"), F.count("*").alias("m")).collect()  # BINS + 1 at most
    n, m = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for r in rows:
        n[r.bin], m[r.bin] = r.n, r.m
    pools: list[list[float]] = []
    for k in range(BINS + 1):
        pools.append([n[k], m[k], 1])
        while len(pools) > 1 and (pools[-1][1] == 0 or pools[-2][1] == 0 or pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]):
            x = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], x, strict=True)]
    return [float(a / b) if b else 0.0 for a, b, size in pools for _ in range(int(size))]


def trained(docs: DataFrame, labels: DataFrame) -> tuple[Model, list[float]]:
    """The model, and the score of every bin of the statistic."""
    train = training(labels)
    counted = spool(counts(docs, train), "op8-counts")
    model = learn(counted)
    known = pick(docs, doc_id="bigint", text="string").join(F.broadcast(train.where("calibrates").select("doc_id", "toxic")), "doc_id")  # LABEL_ROWS at most
    rates = calibrated(scan(known, model))
    discard(train, counted)
    return model, rates


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, segments, statistic of every row of ``docs``."""
    model, rates = trained(docs, labels)
    found = scan(pick(docs, doc_id="bigint", text="string"), model)
    score = F.element_at(F.array(*[F.lit(x) for x in rates]), bin_of(F.col("statistic")) + 1)
    return found.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"), "segments", "statistic")


def clean_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic. Each is judged by itself, where it is read, so
    that one with a null or repeated doc_id goes by its own text."""
    model, rates = trained(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast((model, np.array(rates)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, rates = shared.value
        dense = model.dense()
        for batch in slices(batches):
            words = words_of(batch.column("text"), lower=True, gaps=PUNCTUATION)
            scored, clean = word_scores(words, dense), []
            for a, b in zip(words.first[:-1], words.first[1:], strict=True):
                statistic, _ = read_text(scored[a:b], model.scale)
                at = 0 if statistic is None else max(1, min(BINS, 1 + int(np.floor((statistic - LOWEST) / BIN))))
                clean.append(rates[at] < THRESHOLD)
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
