"""Quality classifier from weak labels.

1. Overlapping heuristic labellers each call a document good or junk, or abstain. Those that look for
   one defect abstain where they don't find it, as a document without that one may have another.
2. Their votes are counted by pattern over all documents, at most 3**len(LABELLERS) of them, and
   expectation-maximisation on these counts estimates how often each labeller says what about good
   and junk documents, and from that each pattern's posterior.
3. Posteriors of all documents train a linear scorer over hashed features: weighted counts by bucket
   give naive-Bayes log-odds. A document's mean log-odds become a probability by monotone regression
   on the posteriors, by bin. Documents of KEEP and more are kept.

Null and empty texts get no features and the posterior of their votes (all abstain). Null doc_ids and
repeated rows are scored as others. Very long texts are read whole. Equal scores are kept or dropped alike,
that of exactly KEEP is kept. Further columns are ignored; an empty table gives no rows. No
labels are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, spool
from .words import Words, hash_words, mix, slices, texts_of, words_of

LABELLERS = ("symbols", "capitals", "bars", "repeats", "variety", "words", "prose", "letters")
ABSTAIN, GOOD, JUNK = 0, 1, 2
ROUNDS, SMOOTH = 50, 1.0
BITS, BIN, BINS = 18, 0.02, 400
KEEP = 0.5

#: Classes of bytes for word shapes: lower and upper letters, digits, sentence marks, other ASCII, the rest.
_SHAPE = np.array([ord("a") if chr(b).islower() else ord("A") if chr(b).isupper() else ord("0") if chr(b).isdigit() else ord(".") if chr(b) in ".,;:?!'\"-" else b if b < 128 else ord("a") for b in range(256)], np.uint8)


def _counts(data: np.ndarray, offsets: np.ndarray, chars: str | None = None, low: int = 0, high: int = 0) -> np.ndarray:
    hit = np.isin(data, np.frombuffer(chars.encode(), np.uint8)) if chars else (data >= low) & (data <= high)
    upto = np.concatenate([[0], np.cumsum(hit)])
    return upto[offsets[1:]] - upto[offsets[:-1]]


def _vote(good: np.ndarray, junk: np.ndarray) -> np.ndarray:
    return np.where(junk, JUNK, np.where(good, GOOD, ABSTAIN)).astype(np.int8)


def votes(column: pa.Array, words: Words) -> np.ndarray:
    """One row of votes for each text."""
    data, offsets = texts_of(column)
    n = np.diff(words.first)
    some, per = n > 0, 1 / np.maximum(n, 1)
    text = np.repeat(np.arange(len(n)), n)
    same = np.zeros(len(text), bool)
    same[1:] = (words.hashes[1:] == words.hashes[:-1]) & (text[1:] == text[:-1])
    repeats = np.bincount(text, same, len(n)) * per
    kinds = np.lexsort((words.hashes, text))
    h, t = words.hashes[kinds], text[kinds]
    new = np.ones(len(t), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    variety = np.bincount(t, new, len(n)) / np.maximum(n, 1) ** 0.9
    upper, lower = _counts(data, offsets, low=65, high=90), _counts(data, offsets, low=97, high=122)
    letters = upper + lower
    caps = upper / np.maximum(letters, 1)
    symbols, bars, marks = (_counts(data, offsets, c) * per for c in ("#$%&*@^~<>{}=+\\", "|", ".!?"))
    length = np.bincount(text, words.ends - words.starts, len(n)) * per
    letters_share = (letters + _counts(data, offsets, low=128, high=255)) / np.maximum(offsets[1:] - offsets[:-1], 1)
    no, prose = np.zeros(len(n), bool), (n > 20) & (marks > 0.02) & (marks < 0.4)
    return np.stack([
        _vote(no, symbols > 0.3),
        _vote(no, (letters > 20) & (caps > 0.4)),
        _vote(no, bars > 0.1),
        _vote(no, (n > 20) & (repeats > 0.15)),
        _vote(no, (n > 40) & (variety < 0.3)),
        _vote((length > 3) & (length < 9) & (symbols < 0.02) & (repeats < 0.03), some & ((length < 2) | (length > 20))),
        _vote(prose & (bars == 0) & (symbols < 0.02) & (caps < 0.4), (n > 40) & (marks < 0.004)),
        _vote((letters_share > 0.75) & (caps < 0.12) & (bars == 0), some & (letters_share < 0.6)),
    ], axis=1)


def buckets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Text and bucket of every feature: words, shapes of words, shapes of neighbours, repetitions."""
    shift = np.uint64(64 - BITS)
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    if not len(text):
        return text, text
    shape = hash_words(_SHAPE[words.data], words.starts, np.minimum(words.starts + 12, words.ends))
    next_ = text[1:] == text[:-1]
    same = words.hashes[1:] == words.hashes[:-1]
    pair = mix(shape[1:] * np.uint64(3) + shape[:-1] + np.uint64(7) + same.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.concatenate([text, text, text[1:][next_]]), (np.concatenate([words.hashes, shape, pair[next_]]) >> shift).astype(np.int64)


def code(v: np.ndarray) -> np.ndarray:
    return v.astype(np.int64) @ 3 ** np.arange(len(LABELLERS))


def expectation_maximisation(patterns: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of good of each pattern; and for each labeller the shares of its votes, by class."""
    said = np.stack([patterns // 3**j % 3 for j in range(len(LABELLERS))], 1)
    good, junk = (said == GOOD).sum(1), (said == JUNK).sum(1)
    post = (good + 1.0) / (good + 2 * junk + 2.0)
    shares = np.zeros((len(LABELLERS), 2, 3))
    for _ in range(ROUNDS):
        weight = np.stack([post * count, (1 - post) * count])
        for j in range(len(LABELLERS)):
            for y in (0, 1):
                shares[j, y] = np.bincount(said[:, j], weight[y], 3) + SMOOTH
        shares /= shares.sum(2, keepdims=True)
        prior = (weight.sum(1) + SMOOTH) / (weight.sum() + 2 * SMOOTH)
        log = np.log(prior)[:, None] + sum(np.log(shares[j][:, said[:, j]]) for j in range(len(LABELLERS)))
        post = 1 / (1 + np.exp(np.clip(log[1] - log[0], -500, 500)))
    return post, shares


def voted(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(code(votes(batch.column("text"), words_of(batch.column("text")))))], names=["pattern"])

    return docs.mapInArrow(run, "pattern bigint")


def weak_labels(docs: DataFrame) -> dict[int, float]:
    """Posterior of good by pattern of votes, of the patterns that occur."""
    rows = voted(docs).groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect()  # 3**8 at most
    patterns, count = np.array([r.pattern for r in rows], np.int64), np.array([r.n for r in rows], float)
    post, _ = expectation_maximisation(patterns, count)
    return dict(zip(patterns.tolist(), post.tolist(), strict=True))


def _posteriors(batch: pa.RecordBatch, words: Words, post: dict[int, float]) -> np.ndarray:
    return np.array([post[p] for p in code(votes(batch.column("text"), words)).tolist()])


def train(docs: DataFrame, post: dict[int, float]) -> np.ndarray:
    """Log-odds by bucket: weights of the linear scorer, 2**BITS of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 << BITS))
        for batch in slices(batches):
            words = words_of(batch.column("text"))
            good = _posteriors(batch, words, post)
            text, bucket = buckets(words)
            n = np.maximum(np.bincount(text, minlength=len(good)), 1)  # each document weighs one
            for k, w in enumerate((good / n, (1 - good) / n)):
                sums[k] += np.bincount(bucket, w[text], 1 << BITS)
        seen = np.flatnonzero(sums.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(sums[0][seen]), pa.array(sums[1][seen])], names=["bucket", "good", "junk"])

    found = docs.mapInArrow(run, "bucket bigint, good double, junk double").groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("junk").alias("junk"))
    got = found.toPandas()  # 2**BITS rows at most
    good, junk = np.zeros(1 << BITS), np.zeros(1 << BITS)
    good[got.bucket], junk[got.bucket] = got.good, got.junk
    prior = (good + junk + 1e-9) / max(good.sum() + junk.sum(), 1e-9)
    a, b = good + prior, junk + prior
    return np.log(a / a.sum()) - np.log(b / b.sum())


def classify(docs: DataFrame, keep: float = KEEP) -> DataFrame:
    """doc_id, posterior (of the weak labels), score, kept of every row of ``docs``."""
    docs = pick(docs, doc_id="bigint", text="string")
    spark = docs.sparkSession
    post = weak_labels(docs)
    shared = spark.sparkContext.broadcast((post, train(docs, post).astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        post, weights = shared.value
        for batch in slices(batches):
            words = words_of(batch.column("text"))
            good = _posteriors(batch, words, post)
            text, bucket = buckets(words)
            n = np.bincount(text, minlength=len(good))
            raw = np.bincount(text, weights[bucket], len(good)) / np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(good), pa.array(raw, mask=n == 0)], names=["doc_id", "posterior", "raw"])

    found = spool(docs.mapInArrow(run, "doc_id bigint, posterior double, raw double"), "op9-raw")
    at = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(F.col("raw") / BIN) + BINS // 2)).cast("int")
    rows = found.where("raw is not null").groupBy(at.alias("bin")).agg(F.sum("posterior").alias("good"), F.count("*").alias("n")).collect()  # BINS at most
    good, n = np.zeros(BINS), np.zeros(BINS)
    for r in rows:
        good[r.bin], n[r.bin] = r.good, r.n
    rate = F.array(*[F.lit(x) for x in monotone(good, n)])
    score = F.coalesce(F.element_at(rate, at + 1), F.col("posterior"))
    return found.select("doc_id", "posterior", score.alias("score"), (score >= keep).alias("kept"))


def monotone(good: np.ndarray, n: np.ndarray) -> list[float]:
    """Rising shares by bin, by pooling neighbours."""
    pools: list[list[float]] = []
    for a, b in zip(good, n, strict=True):
        pools.append([a, b, 1])
        while len(pools) > 1 and (pools[-1][1] == 0 or pools[-2][1] == 0 or pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]):
            x = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], x, strict=True)]
    return [float(a / b) if b else 0.0 for a, b, size in pools for _ in range(int(size))]
