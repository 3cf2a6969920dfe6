"""Benchmark decontamination: BM25 over an inverted index of test items with block-max WAND.

1. Test items are indexed: BM25 impacts of their words, divided by the score that the item gives
   itself, so that one threshold holds for every item. Postings go in blocks of items with the
   greatest impact of each block. Statistics are taken over all items; an index holds about
   SHARD_BYTES of items and is built by the task that holds these. The driver takes PASS_SHARDS
   indexes at a time, whatever the benchmark's size, and each such pass reads the documents once.
2. Every document is cut into passages of twice the longest item's words, half overlapping, and
   each passage is a query. Sums of greatest impacts by word, then by block, drop passages that
   can't reach the threshold; of the rest, WAND with block maxima retrieves all items above it.
3. A retrieved item counts when the passage also holds enough of the word triples of its question
   (the first two thirds of its words, rounded up) and of its answer (the rest). A question or answer
   of fewer than three words is looked for as one run of its own length; items of one or two words
   have no answer. Items of more than PART_WORDS are only retrieved by their parts: question and
   answer are the whole item's, and are looked for in the passage with as many words before and
   after it as the item is longer.

Words are lower-cased (A-Z). Items of one word and more are indexed; null and empty documents or
items match nothing. Benchmark rows that repeat an item_id with the same words count once; rows that
share an item_id (null too) but not the words are items of their own, each reported. Repeated rows of
documents, and those with a null doc_id, are answered each. Of passages with equal scores that with most
overlap is given, then the first. Long texts are many passages. Without items or documents there are no rows. Further columns are
ignored by ``matches`` and kept by ``clean_rows``.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, pick, spool
from .words import Words, slices, words_of

THRESHOLD, OVERLAP = 0.5, 0.5
K1, B = 1.2, 0.75
#: Items of a block, and of the smaller ones into which blocks are cut.
BLOCKS = (8, 2)
MIN_PASSAGE = 64
#: Cells of passages by blocks that are summed at once.
CELLS = 1 << 20
#: Bytes of word hashes in an index, and indexes that one pass over the documents takes along.
SHARD_BYTES, PASS_SHARDS = 16 << 20, 4
#: Items above this many words are retrieved by even parts of at most so many, each with its own threshold.
PART_WORDS = 256

MATCH = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("at", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])
MATCH_SQL = "doc_id bigint, item_id bigint, at bigint, score double, question_overlap double, answer_overlap double"


@dataclass
class Blocks:
    """Greatest impacts by block: of term t they are entries begin[t] to begin[t + 1], by rising block."""

    size: int
    begin: np.ndarray
    blocks: np.ndarray
    most: np.ndarray


@dataclass
class Index:
    """Postings of the terms (sorted hashes): of term t they are entries begin[t] to begin[t + 1] of
    parts and impacts, by rising part. levels: their blocks, from the largest."""

    terms: np.ndarray
    begin: np.ndarray
    parts: np.ndarray
    impacts: np.ndarray
    most: np.ndarray
    levels: list[Blocks]
    #: of every part the number of its item
    item: np.ndarray
    #: of every item its id, its words beyond the longest part, and of question and answer the words
    #: of a run and the hashes of the runs
    ids: list[int | None]
    beyond: list[int]
    runs: list[tuple[tuple[int, np.ndarray], ...]]


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, words (hashes in order) of every item with words, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = words_of(batch.column("text"), lower=True)
            some = np.flatnonzero(np.diff(words.first))
            lists = pa.array([words.hashes[words.first[i] : words.first[i + 1]].view(np.int64) for i in some], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(some)), lists], names=["item_id", "words"])

    return pick(benchmark, item_id="bigint", text="string").mapInArrow(run, "item_id bigint, words array<bigint>").distinct()


def runs_of(h: np.ndarray, n: int = 3) -> np.ndarray:
    """Hashes of the runs of n words; of all words where these are fewer, none without words."""
    n = min(n, len(h))
    out = np.zeros(len(h) - n + 1 if n else 0, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD1342543DE82EF95) + h[k : k + len(out)]
    return out


def parts_of(n: int) -> list[tuple[int, int]]:
    """Even parts of at most PART_WORDS of n words."""
    cuts = np.linspace(0, n, -(-n // PART_WORDS) + 1).astype(int).tolist()
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def build_index(rows: list[tuple[int | None, np.ndarray]], df: dict[int, int], n_items: int, mean: float) -> Index:
    """rows: item id and word hashes; df: in how many of all items a word is."""
    postings: dict[int, list[tuple[int, float]]] = {}
    item: list[int] = []
    beyond, runs = [], []
    for i, (_, h) in enumerate(rows):
        cut = -(-2 * len(h) // 3)
        beyond.append(max(0, len(h) - PART_WORDS))
        runs.append(tuple((min(3, len(x)), np.unique(runs_of(x))) for x in (h[:cut], h[cut:])))
        for a, b in parts_of(len(h)):
            terms, tf = np.unique(h[a:b], return_counts=True)
            idf = np.array([np.log(1 + (n_items - df[int(t)] + 0.5) / (df[int(t)] + 0.5)) for t in terms])
            impact = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * (b - a) / mean))
            for t, x in zip(terms.tolist(), (impact / impact.sum()).tolist(), strict=True):
                postings.setdefault(t, []).append((len(item), x))
            item.append(i)
    terms = np.array(sorted(postings), np.uint64)
    lists = [postings[t] for t in terms.tolist()]
    begin = np.cumsum([0, *map(len, lists)])
    parts = np.array([k for x in lists for k, _ in x], np.int64)
    impacts = np.array([v for x in lists for _, v in x])
    term, levels = np.repeat(np.arange(len(lists)), np.diff(begin)), []
    for size in BLOCKS:
        n = len(item) // size + 1
        keys, at = np.unique(term * n + parts // size, return_index=True)
        levels.append(Blocks(size, np.searchsorted(keys, np.arange(len(lists) + 1) * n), keys % n, np.maximum.reduceat(impacts, at)))
    return Index(terms, begin, parts, impacts, np.maximum.reduceat(impacts, begin[:-1]), levels, np.array(item), [i for i, _ in rows], beyond, runs)


def wand(index: Index, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
    """All parts whose impacts over ``terms`` sum to the threshold at least, by block-max WAND."""
    top = index.levels[0]
    # single values are read much faster from a memoryview than from the array
    parts, impacts, begin, most = (memoryview(x) for x in (index.parts, index.impacts, index.begin, index.most))
    block_begin, blocks, block_most = (memoryview(x) for x in (top.begin, top.blocks, top.most))

    def peak(term: int, block: int) -> float:
        k = bisect_left(blocks, block, block_begin[term], block_begin[term + 1])
        return block_most[k] if k < block_begin[term + 1] and blocks[k] == block else 0.0

    # part at the cursor, cursor, end, greatest impact, term
    heads = [[parts[begin[t]], begin[t], begin[t + 1], most[t], t] for t in terms.tolist()]
    found, least = [], threshold - 1e-9
    while heads:
        heads.sort(key=itemgetter(0))
        total, pivot = 0.0, -1
        for k, c in enumerate(heads):
            total += c[3]
            if total >= least:
                pivot = k
                break
        if pivot < 0:
            break
        at = heads[pivot][0]
        while pivot + 1 < len(heads) and heads[pivot + 1][0] == at:
            pivot += 1
        block = at // top.size
        # the block's own maxima, before any posting is scored
        good = sum(peak(c[4], block) for c in heads[: pivot + 1]) >= least
        upto = at
        if not good:
            upto = (block + 1) * top.size
            if pivot + 1 < len(heads):
                upto = max(at + 1, min(upto, heads[pivot + 1][0]))
        score = 0.0
        for c in heads[: pivot + 1]:
            c[1] = bisect_left(parts, upto, c[1], c[2])
            if good and c[1] < c[2] and parts[c[1]] == at:
                score += impacts[c[1]]
                c[1] += 1
            c[0] = parts[c[1]] if c[1] < c[2] else -1
        if good and score >= least:
            found.append((at, score))
        heads = [c for c in heads if c[0] >= 0]
    return found


def passages(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and end of each passage: size words, half overlapping, the last to the text's end."""
    step, n = size // 2, np.diff(first)
    count = np.where(n > 0, np.maximum(1, -(-(n - step) // step)), 0)
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = first[text] + k * step
    return text, start, np.minimum(start + size, first[text + 1])


def candidates(index: Index, ids: np.ndarray, start: np.ndarray, end: np.ndarray, threshold: float) -> list[tuple[int, np.ndarray]]:
    """Passages, with their distinct terms, in which some block of each level can reach the
    threshold. ids: the term of each word, negative if it isn't in the index."""
    out, n_terms, least = [], len(index.terms), threshold - 1e-9
    step = max(16, min(4096, CELLS // (len(index.item) // BLOCKS[-1] + 1)))
    for lo in range(0, len(start), step):
        a, b = start[lo : lo + step], end[lo : lo + step]
        size = b - a
        row = np.repeat(np.arange(len(a)), size)
        word = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - a, size)
        term = ids[word]
        keys = np.unique((row * n_terms + term)[term >= 0])
        row, term = keys // n_terms, keys % n_terms
        left = np.bincount(row, index.most[term], len(a))[row] >= least
        row, term, above = row[left], term[left], None
        for level in index.levels:
            n_blocks = len(index.item) // level.size + 1
            n = level.begin[term + 1] - level.begin[term]
            entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - level.begin[term], n)
            cell = np.repeat(row, n) * n_blocks + level.blocks[entry]
            sums = np.bincount(cell, level.most[entry], len(a) * n_blocks)
            if above is not None:  # only within blocks of the level above that are left
                sums[~np.repeat(above, above_size // level.size, axis=1)[:, :n_blocks].reshape(-1)] = 0
            above, above_size = sums.reshape(len(a), n_blocks) >= least, level.size
            left = above.any(axis=1)[row]
            row, term = row[left], term[left]
        good = np.unique(row)
        bounds = np.searchsorted(row, [good, good + 1])
        out += [(lo + int(p), term[x:y]) for p, x, y in zip(good, bounds[0], bounds[1], strict=True)]
    return out


def better(new: tuple[float, float], old: tuple[float, float]) -> bool:
    """Greater, or as great and greater in the second value."""
    return new[0] > old[0] + 1e-9 or new[0] > old[0] - 1e-9 and new[1] > old[1] + 1e-9


def held_items(index: Index, words: Words, passage_words: int, threshold: float, overlap: float) -> list[tuple[int, tuple]]:
    """Text number and (item_id, at, score, question_overlap, answer_overlap) of every text and item
    that it holds, from the first of its best passages."""
    ids = np.searchsorted(index.terms, words.hashes)
    ids[index.terms[np.minimum(ids, len(index.terms) - 1)] != words.hashes] = -1
    text, start, end = passages(words.first, passage_words)
    best: dict[tuple[int, int], tuple] = {}
    for p, terms in candidates(index, ids, start, end, threshold):
        held: dict[tuple[int, int], np.ndarray] = {}  # runs in reach, by words around the passage and of a run
        for part, score in wand(index, terms, threshold):
            item, overlaps = int(index.item[part]), []
            more = index.beyond[item]
            for n, x in index.runs[item]:
                if (more, n) not in held:
                    lo, hi = max(words.first[text[p]], start[p] - more), min(words.first[text[p] + 1], end[p] + more)
                    held[more, n] = np.unique(runs_of(words.hashes[lo:hi], n))
                overlaps.append(float(np.isin(x, held[more, n]).mean()) if len(x) else 1.0)
            q, a = overlaps
            key = (int(text[p]), item)
            if q >= overlap and a >= overlap and (key not in best or better((score, q + a), (best[key][2], sum(best[key][3:])))):
                best[key] = (index.ids[item], int(start[p] - words.first[text[p]]), score, q, a)
    return [(key[0], best[key]) for key in sorted(best)]


def indexes(benchmark: DataFrame, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame | None, int, int]:
    """A table (shard, index), the number of shards, and the words of a passage."""
    items = spool(items_of(benchmark), "op1-items")
    size = F.size("words")
    n, total, mean, longest = items.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0)), F.avg(size), F.max(size)).first()
    if not n:
        return None, 0, 0
    shards = -(-8 * total // shard_bytes)
    mine = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "words"), F.lit(shards)).cast("int"))
    df = items.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    used = mine.select("shard", F.explode("words").alias("term")).distinct().join(df, "term").select(F.col("shard").alias("of"), "term", "df")

    def build(key: tuple, rows: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        df = dict(zip(counts["term"].to_numpy(np.int64).view(np.uint64).tolist(), counts["df"].tolist(), strict=True))
        listed = [(None if pd.isna(i) else int(i), np.asarray(w, np.int64).view(np.uint64)) for i, w in zip(rows["item_id"], rows["words"], strict=True)]
        listed.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1].tobytes()))
        return pd.DataFrame({"shard": [key[0]], "index": [pickle.dumps(build_index(listed, df, n, mean))]})

    # an item_id is text here, as pandas has no whole numbers beside nulls
    left = mine.select("shard", F.col("item_id").cast("string").alias("item_id"), "words")
    built = left.groupBy("shard").cogroup(used.groupBy("of")).applyInPandas(build, "shard int, index binary")
    out = spool(built, "op1-indexes")
    discard(items)
    return out, shards, max(MIN_PASSAGE, 2 * min(longest, PART_WORDS))


def passes(benchmark: DataFrame, shard_bytes: int = SHARD_BYTES, pass_shards: int = PASS_SHARDS) -> Iterator[tuple]:
    """A broadcast list of pickled indexes for each pass, the words of a passage, and whether more follow."""
    table, shards, passage_words = indexes(benchmark, shard_bytes)
    for k in range(0, shards, pass_shards):
        rows = table.where(F.col("shard").between(k, k + pass_shards - 1)).orderBy("shard").collect()  # PASS_SHARDS at most
        more = k + pass_shards < shards
        if not more:
            discard(table)
        yield benchmark.sparkSession.sparkContext.broadcast([bytes(r["index"]) for r in rows]), passage_words, more


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, shard_bytes: int = SHARD_BYTES, pass_shards: int = PASS_SHARDS) -> DataFrame:
    """doc_id, item_id, at (first word of the best passage), score, question_overlap, answer_overlap
    of every document and item that it holds."""
    spark = docs.sparkSession
    texts, out = pick(docs, doc_id="bigint", text="string"), None
    for shared, passage_words, more in passes(benchmark, shard_bytes, pass_shards):

        def run(batches: Iterator[pa.RecordBatch], shared=shared, passage_words=passage_words) -> Iterator[pa.RecordBatch]:
            loaded = [pickle.loads(x) for x in shared.value]
            for batch in slices(batches):
                words = words_of(batch.column("text"), lower=True)
                found = [f for index in loaded for f in held_items(index, words, passage_words, threshold, overlap)]
                names = batch.column("doc_id").to_pylist()
                columns = zip(*[(names[t], *v) for t, v in found], strict=True) if found else [[]] * len(MATCH)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, MATCH, strict=True)], schema=MATCH)

        found = texts.mapInArrow(run, MATCH_SQL)
        if more or out is not None:  # one pass after the other
            found = spool(found, "op1-matches")
            shared.unpersist()
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], MATCH_SQL) if out is None else out


def clean_rows(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, shard_bytes: int = SHARD_BYTES, pass_shards: int = PASS_SHARDS) -> DataFrame:
    """The rows of ``docs`` that hold no item. Each is judged by itself, where it is read."""
    bounded_batches(docs.sparkSession)
    for shared, passage_words, more in passes(benchmark, shard_bytes, pass_shards):

        def run(batches: Iterator[pa.RecordBatch], shared=shared, passage_words=passage_words) -> Iterator[pa.RecordBatch]:
            loaded = [pickle.loads(x) for x in shared.value]
            for batch in slices(batches):
                words, clean = words_of(batch.column("text"), lower=True), np.ones(batch.num_rows, bool)
                for index in loaded:
                    clean[[t for t, _ in held_items(index, words, passage_words, threshold, overlap)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
        if more:
            docs = spool(docs, "op1-clean")
            shared.unpersist()
    return docs
