"""Substring dedup by sparse suffix trees in groups of common prefixes.

A window is WINDOW consecutive words; a word goes if a window over it also starts in a document with
a smaller doc_id.

1. Suffixes are grouped by their prefixes. Of each window's ANCHOR-word sequences the one of smallest
   hash is its anchor, so that equal windows have equal anchors at equal places: a group's prefix is
   an anchor (about a fifth of all words begin one), and its suffixes are those that begin at the
   windows which the anchor stands for.
2. Anchors are counted by document, with a map-side combine. Those of one document can't be part of
   a repeat; a Bloom filter of FILTER_BITS at most keeps what may be shared. What it lets through
   besides costs shuffle, not results, so one filter and one pass serve any number of anchors.
3. Prefixes of more suffixes than GROUP_ROWS allows are lengthened to WINDOW words. Then a group is one node
   of the tree and needs only its smallest doc_id, which is summed before it is shuffled. Such nodes
   are told by two hashes of 64 bits. A second filter tells which prefixes these are; an anchor that
   it takes by mistake is only worked on in this way.
4. Each other group fits into memory. Its suffixes are sorted, the longest common prefixes of
   neighbours are taken, and the intervals in which these are WINDOW words or more are the tree's deep
   internal nodes: each is a repeat, its leaves are where it starts, and all leaves but those of the
   smallest doc_id are covered. Words are compared by 40 bits each, a window thus by 520. Suffixes
   end with the last window of their anchor, so that the next anchor's group carries a repeat on.
5. Covered windows are merged into ranges by document, which are the maximal repeated passages, and
   cut out of the texts.

Null texts have no words. A null doc_id neither covers nor is covered. Rows that share a doc_id don't
cover each other; each loses what smaller doc_ids have. Further columns are ignored; an empty table
gives no rows. Very long texts are many suffixes; equal texts are equal leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, discard, join_spooled, pick, spool
from .words import Words, slices, words_of

WINDOW, ANCHOR = 13, 5
#: A prefix of more suffixes than a SHAREth of all is lengthened, but none of up to the first number and
#: all of more than the second, whose suffixes still fit into memory.
GROUP_ROWS, SHARE = (1000, 20_000), 2000
#: Greatest size of a filter; KEY_BITS for each anchor in it.
FILTER_BITS, KEY_BITS = 29, 16
#: Bytes by which a word is compared in a group; words of a suffix at most.
CODE, SUFFIX_WORDS = 5, 2 * WINDOW - ANCHOR
CHUNK_ROWS = 40_000
#: Runs of words of one Arrow batch.
BATCH_RUNS = 1 << 16
#: Nodes under lengthened prefixes that are looked up in memory.
NODES = 1_000_000
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)


def anchors(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each anchor, in order: its text, its word, and the first and last window it stands for."""
    g, n = words.grams(ANCHOR), len(words.hashes)
    none = np.empty(0, np.int64)
    if n < WINDOW:
        return none, none, none, none
    m = n - WINDOW + 1
    least, at = g[:m].copy(), np.zeros(m, np.int64)
    for k in range(1, WINDOW - ANCHOR + 1):
        less = g[k : k + m] < least
        least[less] = g[k : k + m][less]
        at[less] = k
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))[:m]
    start = np.flatnonzero(np.arange(m) + WINDOW <= words.first[text + 1])
    if not len(start):
        return none, none, none, none
    where, text = start + at[start], text[start]
    new = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | (text[1:] != text[:-1])]))
    last = np.append(new[1:], len(start)) - 1
    return text[new], where[new], start[new], start[last]


def anchor_keys(docs: DataFrame) -> DataFrame:
    """anchor, doc_id, n: the distinct anchors of each document, and how often it has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = words_of(batch.column("text"))
            text, where, _, _ = anchors(words)
            key = words.grams(ANCHOR)[where].view(np.int64)
            order = np.lexsort((key, text))
            key, text = key[order], text[order]
            new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (text[1:] != text[:-1])])) if len(key) else np.empty(0, np.int64)
            n = np.diff(np.append(new, len(key)))
            yield pa.RecordBatch.from_arrays([pa.array(key[new]), batch.column("doc_id").take(pa.array(text[new])), pa.array(n)], names=["anchor", "doc_id", "n"])

    return docs.mapInArrow(run, "anchor bigint, doc_id bigint, n bigint")


def bloom(shared: DataFrame, n: int, most_bits: int) -> np.ndarray:
    """Filter over n anchors of KEY_BITS each and 2**most_bits at most, put together from blocks of
    2**16 bits."""
    bits = min(most_bits, max(16, (n * KEY_BITS).bit_length()))
    slot = F.col("anchor").bitwiseAND(F.lit((1 << bits) - 1))
    rows = shared.select(F.shiftright(slot, 16).alias("block"), slot.bitwiseAND(F.lit(0xFFFF)).cast("int").alias("bit")).distinct()

    def block(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        on = np.zeros(1 << 16, np.uint8)
        on[frame["bit"].to_numpy()] = 1
        return pd.DataFrame({"block": [key[0]], "on": [np.packbits(on, bitorder="little").tobytes()]})

    out = np.zeros(max(1, 1 << bits >> 3), np.uint8)
    for r in rows.groupBy("block").applyInPandas(block, "block bigint, on binary").toLocalIterator():
        part = np.frombuffer(r.on, np.uint8)[: len(out)]
        out[r.block << 13 : (r.block << 13) + len(part)] = part
    return out


SUFFIX = "anchor bigint, doc_id bigint, text_key int, start int, words binary"


class Chosen:
    """The anchors of a slice that the first filter keeps, without or only with those of the second."""

    def __init__(self, shared, words: Words, hot: bool) -> None:
        text, where, first, last = anchors(words)
        key = words.grams(ANCHOR)[where]

        def on(bits: np.ndarray) -> np.ndarray:
            slot = key & np.uint64(len(bits) * 8 - 1)
            return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1

        held = on(shared.value[0]) & (on(shared.value[1]) == hot)
        self.key, self.text, self.first, self.last = key[held].view(np.int64), text[held], first[held], last[held]

    def windows(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Both hashes, text and first word of each window that the anchors stand for."""
        n = self.last - self.first + 1
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - self.first, n)
        return words.grams_at(at, WINDOW).view(np.int64), words.grams_at(at, WINDOW, _OTHER).view(np.int64), np.repeat(self.text, n), at


def suffixes(docs: DataFrame, shared) -> DataFrame:
    """The suffixes of each anchor that the filter keeps, as one run: its first word in the text and
    the words from there to the end of the last window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = words_of(batch.column("text"))
            x, all_codes = Chosen(shared, words, False), np.ascontiguousarray(words.hashes.view(np.uint8).reshape(-1, 8)[:, :CODE])
            for k in range(0, len(x.key), BATCH_RUNS):
                key, text, first, last = (a[k : k + BATCH_RUNS] for a in (x.key, x.text, x.first, x.last))
                size = last - first + WINDOW
                index = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - first, size)
                codes = all_codes[index].reshape(-1)
                ends = np.concatenate([[0], np.cumsum(size) * CODE]).astype(np.int32)
                column = pa.Array.from_buffers(pa.binary(), len(key), [None, pa.py_buffer(ends), pa.py_buffer(codes)])
                start, at = pa.array((first - words.first[text]).astype(np.int32)), pa.array(text)
                yield pa.RecordBatch.from_arrays([pa.array(key), batch.column("doc_id").take(at), batch.column("text_key").take(at), start, column], names=["anchor", "doc_id", "text_key", "start", "words"])

    return docs.mapInArrow(run, SUFFIX)


def long_nodes(docs: DataFrame, shared) -> DataFrame:
    """node, other, least: the windows under lengthened prefixes that several documents have, with the
    smallest doc_id; summed in each slice before rows leave it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = words_of(batch.column("text"))
            node, other, text, _ = Chosen(shared, words, True).windows(words)
            doc = batch.column("doc_id").to_numpy()[text]
            order = np.lexsort((doc, other, node))
            node, other, doc = node[order], other[order], doc[order]
            new = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (other[1:] != other[:-1])])) if len(node) else np.empty(0, np.int64)
            ends = np.append(new[1:], len(node)) - 1 if len(node) else new
            yield pa.RecordBatch.from_arrays([pa.array(node[new]), pa.array(other[new]), pa.array(doc[new]), pa.array(doc[ends])], names=["node", "other", "least", "most"])

    found = docs.mapInArrow(run, "node bigint, other bigint, least bigint, most bigint")
    return found.groupBy("node", "other").agg(F.min("least").alias("least"), F.max("most").alias("most")).where("least < most").select("node", "other", "least")


def covered_by_nodes(docs: DataFrame, shared, nodes: DataFrame) -> DataFrame:
    """doc_id, text_key, starts: the covered windows under lengthened prefixes, one row for a text.

    Up to NODES nodes are looked up where the documents are read; more, or any that share their
    first hash, are joined by window.
    """
    spark = docs.sparkSession
    n = nodes.count()
    table = nodes.orderBy("node").toArrow() if n <= NODES else None
    if table is None or n > 1 and bool((np.diff(table.column("node").to_numpy()) == 0).any()):

        def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                words = words_of(batch.column("text"))
                node, other, text, at = Chosen(shared, words, True).windows(words)
                of, start = pa.array(text), pa.array((at - words.first[text]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(other), batch.column("doc_id").take(of), batch.column("text_key").take(of), start], names=["node", "other", "doc_id", "text_key", "start"])

        rows = docs.mapInArrow(listed, "node bigint, other bigint, doc_id bigint, text_key int, start int")
        return join_spooled(rows, nodes, ["node", "other"], "inner", n).where("doc_id > least").groupBy("doc_id", "text_key").agg(F.collect_set("start").alias("starts"))
    known = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("node", "other", "least")))

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, others, least = known.value
        for batch in slices(batches):
            words = words_of(batch.column("text"))
            node, other, text, at = Chosen(shared, words, True).windows(words)
            k = np.minimum(np.searchsorted(nodes, node), max(0, len(nodes) - 1))
            doc = batch.column("doc_id").to_numpy()
            hit = (nodes[k] == node) & (others[k] == other) & (doc[text] > least[k]) if len(nodes) else np.zeros(len(node), bool)
            text, start = text[hit], (at[hit] - words.first[text[hit]]).astype(np.int32)
            new = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(text) else np.empty(0, np.int64)
            starts = pa.ListArray.from_arrays(pa.array(np.append(new, len(text)).astype(np.int32)), pa.array(start))
            yield pa.RecordBatch.from_arrays([pa.array(doc[text[new]]), batch.column("text_key").take(pa.array(text[new])), starts], names=["doc_id", "text_key", "starts"])

    return docs.mapInArrow(looked_up, "doc_id bigint, text_key int, starts array<int>")


def common_prefixes(sorted_: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Of sorted suffixes (rows of SUFFIX_WORDS * CODE bytes) the words that each shares with the one before."""
    same = (sorted_[1:] == sorted_[:-1]).reshape(len(sorted_) - 1, SUFFIX_WORDS, CODE).all(axis=2)
    upto = np.where(same.all(axis=1), SUFFIX_WORDS, np.argmin(same, axis=1))
    return np.concatenate([[0], np.minimum(upto, np.minimum(n_words[1:], n_words[:-1]))])


def deep_nodes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Leaves of the tree of all suffixes of ``column`` (runs of words), in sorted order: of each its
    run and its place in the run, the deep internal node that it is under (a leaf without one is a
    node of its own), and the words that it shares with the leaf before."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.concatenate([np.frombuffer(column.buffers()[2], np.uint8), np.zeros(SUFFIX_WORDS * CODE, np.uint8)])
    n = np.diff(ends) // CODE - WINDOW + 1
    run = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    begin = ends[run] + place * CODE
    n_words = (ends[run + 1] - begin) // CODE
    leaves = np.lib.stride_tricks.sliding_window_view(data, SUFFIX_WORDS * CODE)[begin]
    leaves[np.arange(SUFFIX_WORDS * CODE)[None, :] >= (n_words * CODE)[:, None]] = 0  # what follows belongs to other runs
    order = np.argsort(leaves.view(f"S{SUFFIX_WORDS * CODE}").reshape(-1), kind="stable")
    shared = common_prefixes(leaves[order], n_words[order])
    return run[order], place[order], np.cumsum(shared < WINDOW) - 1, shared


def covered_by_tree(doc: np.ndarray, column: pa.Array) -> np.ndarray:
    """Of each run a bit mask of its windows that also start in a smaller document."""
    run, place, node, _ = deep_nodes(column)
    starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    least = np.minimum.reduceat(doc[run], starts)
    out = np.zeros(len(doc), np.int64)
    hit = doc[run] > least[node]
    np.bitwise_or.at(out, run[hit], 1 << place[hit])
    return out


def covered_in_groups(rows: DataFrame) -> DataFrame:
    """doc_id, text_key, start, mask of runs with covered windows, by groups of one anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def work(table: pa.Table) -> pa.RecordBatch:
            batch = table.combine_chunks().to_batches()[0]
            mask = covered_by_tree(batch.column("doc_id").to_numpy(), batch.column("words"))
            some = pa.array(mask > 0)
            return pa.RecordBatch.from_arrays([*[batch.column(c).filter(some) for c in ("doc_id", "text_key", "start")], pa.array(mask[mask > 0].astype(np.int32))], names=["doc_id", "text_key", "start", "mask"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= CHUNK_ROWS:
                table = pa.Table.from_batches(held)
                key = table.column("anchor").to_numpy()
                cut = int(np.searchsorted(key, key[-1]))  # the last group may go on
                if cut:
                    yield work(table.slice(0, cut))
                held = table.slice(cut).to_batches()
        if sum(b.num_rows for b in held):
            yield work(pa.Table.from_batches(held))

    return rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "doc_id bigint, text_key int, start int, mask int")


def ranges(covered: DataFrame) -> DataFrame:
    """doc_id, text_key, cuts: the maximal repeated passages of each text, ranges of words as start,
    end, start, end, ..."""
    marks = F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "mask"))).alias("marks")
    lists = covered.groupBy("doc_id", "text_key").agg(marks, F.flatten(F.collect_set("starts")).alias("starts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, starts, out = batch.column("marks"), batch.column("starts"), []
            for i in range(len(marks)):
                part = marks[i].values
                start, mask = (part.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1))
                whole = starts[i].values.to_numpy(zero_copy_only=False).astype(np.int64)
                at = np.unique(np.concatenate([whole, *[start[mask >> k & 1 == 1] + k for k in range(WINDOW)]]))
                gap = np.flatnonzero(np.diff(at) > WINDOW)
                begin, end = at[np.concatenate([[0], gap + 1])], at[np.concatenate([gap, [len(at) - 1]])] + WINDOW
                out.append(np.stack([begin, end], 1).reshape(-1).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "text_key", "cuts"])

    return lists.mapInArrow(run, "doc_id bigint, text_key int, cuts array<int>")


def cut_out(docs: DataFrame, cuts: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text of every row of ``docs``."""
    n, size = cuts.agg(F.count("*"), F.coalesce(F.sum(F.size("cuts")), F.lit(0))).first()
    small = n <= BROADCAST_ROWS and size <= 10 * BROADCAST_ROWS
    both = docs.join(F.broadcast(cuts) if small else cuts, ["doc_id", "text_key"], "left").select("doc_id", "text", "cuts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n_words, removed, kept = [], [], []
            for text, cuts in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("cuts").to_pylist(), strict=True):
                words = (text or b"").split()
                n_words.append(len(words))
                for a, b in sorted(zip((cuts or [])[::2], (cuts or [])[1::2], strict=True), reverse=True):
                    del words[a:b]
                removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return both.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, text. Rows that share a doc_id are told apart by a hash of the text."""
    return pick(docs, doc_id="bigint", text="string").select("doc_id", F.hash("text").alias("text_key"), "text")


def repeats(docs: DataFrame, group_rows: tuple[int, int] = GROUP_ROWS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, text_key, cuts: the passages of each text that smaller doc_ids have, as ranges of words."""
    named = keyed(docs).where("doc_id is not null")
    keys = anchor_keys(named).groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.sum("n").alias("n"))
    shared = spool(keys.where("least < most").select("anchor", "n"), "op10-anchors")
    n, total = shared.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    hot = F.col("n") > min(group_rows[1], max(group_rows[0], total // SHARE))
    n_hot = shared.where(hot).count()
    chosen = docs.sparkSession.sparkContext.broadcast((bloom(shared, n, filter_bits), bloom(shared.where(hot), n_hot, filter_bits)))
    found = covered_in_groups(suffixes(named, chosen)).withColumn("starts", F.lit(None).cast("array<int>"))
    if n_hot:
        nodes = spool(long_nodes(named, chosen), "op10-nodes")
        long = covered_by_nodes(named, chosen, nodes)
        found = found.unionByName(long.select("doc_id", "text_key", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("mask"), "starts"))
    covered = spool(found, "op10-covered")
    cuts = spool(ranges(covered), "op10-cuts")
    chosen.unpersist()
    discard(shared, covered)
    return cuts


def remove_repeats(docs: DataFrame, group_rows: tuple[int, int] = GROUP_ROWS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text of every row of ``docs``."""
    return cut_out(keyed(docs), repeats(docs, group_rows, filter_bits))


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents
), windows AS (
  SELECT row, doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS words FROM (SELECT row, doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW} AND doc_id IS NOT NULL)
), covered AS (
  SELECT row, i FROM windows QUALIFY doc_id > min(doc_id) OVER (PARTITION BY words)
), gone AS (
  SELECT DISTINCT row, unnest(range(i, i + {WINDOW})) AS pos FROM covered
), kept AS (
  SELECT row, string_agg(x, ' ' ORDER BY pos) AS text, count(*) AS n FROM (SELECT row, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS pos FROM d) ANTI JOIN gone USING (row, pos) GROUP BY row
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (row)
"""
