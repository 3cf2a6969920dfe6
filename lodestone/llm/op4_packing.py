"""Token-id output: best-fit-decreasing packing into rows of a fixed length.

1. Each text is encoded with a public vocabulary, whose file the driver reads and broadcasts, and
   closed by an end token. A document longer than
   a row is split into pieces of a row's length and a rest; nothing is dropped.
2. Pieces of one input split, up to GROUP_TOKENS at a time, are packed where they were read, so no
   text or token is shuffled. Pieces go in order of falling length, each into the row with the least
   room that holds it; a segment tree over room sizes finds that row in logarithmic time.
3. A packed row is its token ids (little-endian, padded), the cumulative segment lengths as
   attention kernels take them, the offsets at which positions start again from 0, and for each
   segment the document, its input row's own number, the number of its piece and the piece's first
   token in the document.

Null and empty texts are encoded as the end token alone. Null doc_ids are kept as null. Repeated rows
are packed each, under row numbers of their own. Further columns are ignored; no documents give no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick
from .words import slices

ROW_TOKENS, GROUP_TOKENS = 2048, 1 << 22
VOCABULARY, END_TOKEN = "/opt/tokenizers/byte_bpe_50k.tiktoken", 50256
#: Fixed value: how byte-level BPE vocabularies of this kind split a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

PACKED = pa.schema([
    ("pack_id", pa.int64()), ("n_tokens", pa.int32()), ("token_ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())), ("position_resets", pa.list_(pa.int32())),
    ("doc_ids", pa.list_(pa.int64())), ("row_nos", pa.list_(pa.int64())), ("piece_nos", pa.list_(pa.int32())), ("piece_starts", pa.list_(pa.int64())),
])
SCHEMA = "pack_id bigint, n_tokens int, token_ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<bigint>, row_nos array<bigint>, piece_nos array<int>, piece_starts array<bigint>"

_encodings: dict = {}


def vocabulary_of(spark: SparkSession, path: str) -> Broadcast:
    """Name and lines of the vocabulary file, which only the driver has to see; some MB at most."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast((path, f.read()))


def encoding(shared: Broadcast, pattern: str = PATTERN):
    """The vocabulary, built once a worker."""
    path, lines = shared.value
    if path not in _encodings:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        _encodings[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


class Rooms:
    """Rows by the room left in them; a segment tree over rooms finds the least that suffices."""

    def __init__(self, most: int) -> None:
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: dict[int, list[int]] = {}

    def put(self, room: int, row: int) -> None:
        self.rows.setdefault(room, []).append(row)
        self._add(room, 1)

    def _add(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return (room, row) with the least room of ``least`` or more."""
        node = least + self.leaves
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._add(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Rows of indices of ``lengths``, each of at most ``size`` together; equal lengths in order."""
    rooms, rows = Rooms(size), []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        room, row = rooms.take(n) or (size, len(rows))
        if row == len(rows):
            rows.append([])
        rows[row].append(i)
        if room > n:
            rooms.put(room - n, row)
    return rows


def pack(docs: DataFrame, row_tokens: int = ROW_TOKENS, vocabulary: str = VOCABULARY, end_token: int = END_TOKEN, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Packed rows, as SCHEMA has them."""
    kind = np.dtype("<u2" if end_token < 1 << 16 else "<u4")
    shared = vocabulary_of(docs.sparkSession, vocabulary)

    def packed(group: list[tuple[int | None, np.ndarray]], at: int, first: int) -> pa.RecordBatch:
        pieces = [(k, n, a) for k, (_, ids) in enumerate(group) for n, a in enumerate(range(0, len(ids), row_tokens))]
        lengths = np.array([min(row_tokens, len(group[k][1]) - a) for k, _, a in pieces])
        cols: list[list] = [[] for _ in PACKED]
        for row, held in enumerate(best_fit_decreasing(lengths, row_tokens)):
            line, ends = np.full(row_tokens, end_token, kind), np.cumsum([0, *lengths[held]])
            for i, x in zip(held, ends, strict=False):
                k, _, a = pieces[i]
                line[x : x + lengths[i]] = group[k][1][a : a + lengths[i]]
            values = (at + row, int(ends[-1]), line.tobytes(), ends, ends[:-1], [group[pieces[i][0]][0] for i in held], [first + pieces[i][0] for i in held], [pieces[i][1] for i in held], [pieces[i][2] for i in held])
            for c, v in zip(cols, values, strict=True):
                c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, PACKED, strict=True)], schema=PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, first = encoding(shared), TaskContext.get().partitionId() << 40
        at = first
        group: list[tuple[int | None, np.ndarray]] = []
        held = 0
        for batch in slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.array([*code.encode_ordinary(text or ""), end_token], kind)
                group.append((doc_id, ids))
                held += len(ids)
                if held >= group_tokens:
                    yield (out := packed(group, at, first))
                    group, held, at, first = [], 0, at + out.num_rows, first + len(group)
        if group:
            yield packed(group, at, first)

    return pick(docs, doc_id="bigint", text="string").mapInArrow(run, SCHEMA)


def unpack(rows: DataFrame, row_tokens: int = ROW_TOKENS, vocabulary: str = VOCABULARY, end_token: int = END_TOKEN) -> DataFrame:
    """doc_id, text of every packed row: the inverse of ``pack``."""
    kind = np.dtype("<u2" if end_token < 1 << 16 else "<u4")
    shared = vocabulary_of(rows.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                for k, doc in enumerate(r["doc_ids"]):
                    a, b = r["cu_seqlens"][k : k + 2]
                    out.append((doc, r["row_nos"][k], r["piece_nos"][k], r["token_ids"][a * kind.itemsize : b * kind.itemsize]))
            kinds = (("doc_id", pa.int64()), ("row", pa.int64()), ("piece", pa.int32()), ("ids", pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoding(shared)
        for batch in batches:
            texts = [code.decode(np.frombuffer(b"".join(x["ids"] for x in parts), kind)[:-1].tolist()) for parts in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    parts = rows.mapInArrow(run, "doc_id bigint, row bigint, piece int, ids binary").groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("piece", "ids"))).alias("parts"))
    return parts.mapInArrow(joined, "doc_id bigint, text string")
