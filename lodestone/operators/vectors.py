"""Nearest vectors by cosine: an exact scan in blocks of queries, and an index of cells of which few are read."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window

from ..sources.files import work_table

#: Vectors of a block of queries, which is sent to all tasks; each block is one pass over the rows.
QUERY_BLOCK = 4096
#: Pairs of a query and a row that are compared at once, and pairs that a task may keep.
PAIRS, KEPT = 1 << 20, 1 << 18
#: What a product of matrices may be off by.
SLACK = 1e-9


def matrix(column: pa.Array, width: int) -> tuple[pa.Array, np.ndarray]:
    """Which vectors have this width, and these as rows; values aren't boxed."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), width), False)
    values = pc.list_flatten(column.filter(fits)).cast(pa.float64())
    return fits, values.to_numpy(zero_copy_only=False).reshape(pc.sum(fits).as_py() or 0, width)


def lengths(rows: np.ndarray) -> np.ndarray:
    """Norms; a zero norm counts as 1."""
    norm = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    return np.where(norm == 0, 1.0, norm)


@dataclass
class Block:
    """Queries that are compared together: their ids, their vectors as rows (0 for those of another
    width than the longest), and which are of that width."""

    ids: np.ndarray
    rows: np.ndarray
    same: np.ndarray

    @classmethod
    def of(cls, queries: DataFrame) -> Block:
        got = queries.select(F.col("query_id").cast("bigint"), F.col("vector").cast("array<double>")).toArrow()  # about QUERY_BLOCK rows
        vectors = got.column("vector").combine_chunks()
        width = pc.max(pc.list_value_length(vectors)).as_py() or 0
        fits, known = matrix(vectors, width)
        same = fits.to_numpy(zero_copy_only=False)
        rows = np.zeros((len(same), width))
        rows[same] = known
        return cls(got.column("query_id").to_numpy(), rows, same)


def slices(batch: pa.RecordBatch, block: Block) -> Iterator[pa.RecordBatch]:
    """Rows in pieces that give at most PAIRS pairs with a block."""
    step = max(1, PAIRS // max(1, len(block.ids)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def block_size(k: int | None) -> int:
    """Queries of a block: as many as a task can keep the k best rows of."""
    return max(1, min(QUERY_BLOCK, KEPT // (k or 1)))


def blocks(queries: DataFrame, size: int = QUERY_BLOCK) -> Iterator[Block]:
    n = max(1, -(-queries.count() // size))
    for b in range(n):
        yield Block.of(queries if n == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b))


class Best:
    """The k best rows of each query, and of each value of ``by``, among all that a task has seen.

    Products of matrices choose candidates; those that come near the k-th are computed again pair by
    pair, so that equal vectors are equally similar and ties go by id. Of other columns only the rows in
    hand are kept.
    """

    def __init__(self, block: Block, k: int, columns: list[str], by: str | None, weight: str | None) -> None:
        self.block, self.k, self.columns, self.by, self.weight = block, k, columns, by, weight
        self.norm = lengths(block.rows)
        self.unit = block.rows / self.norm[:, None]
        self.groups: dict[object, int] = {}
        self.bars: dict[int, np.ndarray] = {}
        self.pairs = [np.empty(0, t) for t in (np.int64, np.int64, float, float, np.int64, np.int64)]  # query, group, value, similarity, id, row
        self.rows: pa.Table | None = None

    def add(self, batch: pa.RecordBatch, asked: np.ndarray | None = None) -> None:
        """Compare rows with all queries, or with those numbered ``asked``."""
        asked = np.arange(len(self.block.ids)) if asked is None else asked
        fits, rows = matrix(batch.column("embedding"), self.block.rows.shape[1])
        if not len(rows) or not len(asked):
            return
        kept = batch.select(self.columns).filter(fits)
        norm = lengths(rows)
        times = kept.column(self.weight).to_numpy() if self.weight else np.ones(len(rows))
        said = kept.column(self.by).to_pylist() if self.by else [0] * len(rows)
        group = np.array([self.groups.setdefault(x, len(self.groups)) for x in said])
        near = (self.unit[asked] @ (rows / norm[:, None]).T) * times
        near[~self.block.same[asked]] = 0.0
        near[np.isnan(near)] = -np.inf
        found = []
        for g in np.unique(group):
            mine = np.flatnonzero(group == g)
            value = near[:, mine]
            bar = self.bars.get(g, np.full(len(self.block.ids), -np.inf))[asked]
            if len(mine) > self.k:
                bar = np.maximum(bar, -np.partition(-value, self.k - 1, axis=1)[:, self.k - 1])
            q, r = np.nonzero(value >= bar[:, None] - SLACK)
            found.append((asked[q], mine[r], np.full(len(q), g)))
        q, r, g = (np.concatenate(x) for x in zip(*found, strict=True))
        exact = np.einsum("ij,ij->i", self.block.rows[q], rows[r]) / (self.norm[q] * norm[r])
        exact[~self.block.same[q]] = 0.0
        before = 0 if self.rows is None else self.rows.num_rows
        fresh = (q, g, exact * times[r], exact, kept.column("id").to_numpy()[r], r + before)
        self._merge([np.concatenate(x) for x in zip(self.pairs, fresh, strict=True)], pa.Table.from_batches([kept]))

    def _merge(self, pairs: list[np.ndarray], rows: pa.Table) -> None:
        q, g, value, _, key, _ = pairs
        order = np.lexsort((key, -value, g, q))
        first = np.ones(len(order), bool)
        first[1:] = (q[order][1:] != q[order][:-1]) | (g[order][1:] != g[order][:-1])
        place = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        self.pairs = [x[order[place < self.k]] for x in pairs]
        q, g, value = self.pairs[:3]
        for x in np.unique(g):
            mine = g == x
            n, low = np.bincount(q[mine], minlength=len(self.block.ids)), np.full(len(self.block.ids), np.inf)
            np.minimum.at(low, q[mine], value[mine])
            self.bars[x] = np.where(n >= self.k, low, -np.inf)
        used, self.pairs[5] = np.unique(self.pairs[5], return_inverse=True)
        self.rows = pa.concat_tables([*([] if self.rows is None else [self.rows]), rows]).take(pa.array(used)).combine_chunks()

    def batches(self, names: list[str]) -> Iterator[pa.RecordBatch]:
        if self.rows is None:
            return
        q, _, _, similarity, _, at = self.pairs
        out = self.rows.take(pa.array(at)).append_column("query_id", pa.array(self.block.ids[q])).append_column("similarity", pa.array(similarity))
        yield from out.rename_columns(names).combine_chunks().to_batches(1 << 16)


def every_pair(batch: pa.RecordBatch, block: Block, columns: list[str], names: list[str]) -> pa.RecordBatch:
    fits, rows = matrix(batch.column("embedding"), block.rows.shape[1])
    kept, n = batch.select(columns).filter(fits), len(block.ids)
    q, r = np.repeat(np.arange(n), len(rows)), np.tile(np.arange(len(rows)), n)
    near = (np.einsum("ij,kj->ik", block.rows, rows) / (lengths(block.rows)[:, None] * lengths(rows)[None, :])).reshape(-1)
    near[~block.same[q]] = 0.0
    return pa.RecordBatch.from_arrays([*kept.take(pa.array(r)).columns, pa.array(block.ids[q]), pa.array(near)], names=names)


def result_schema(rows: DataFrame) -> StructType:
    return StructType([*[f for f in rows.schema if f.name not in ("embedding", "cell")], StructField("query_id", LongType()), StructField("similarity", DoubleType())])


def similar(chunks: DataFrame, queries: DataFrame, k: int | None, by: str | None = None, weight: str | None = None) -> DataFrame:
    """``chunks`` without embedding, with query_id and similarity: of each query (query_id, vector) the k
    best rows, ties by id; for k of None all rows. ``by`` names a column of few values, of each of which
    the k best are wanted, ``weight`` one by which similarities are multiplied to rank rows.

    Queries go in blocks of QUERY_BLOCK, or fewer where k is large, and rows in pieces, so that what a task holds
    depends on neither's number. Each task gives out the k best of all its rows for each query,
    once, and these are merged. 0 for queries of another width than the widest; rows of another width
    are left out; a zero norm counts as 1.
    """
    spark, out, schema = chunks.sparkSession, None, result_schema(chunks)
    columns, size = schema.names[:-2], block_size(k)
    several = queries.count() > size
    for block in blocks(queries, size):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best = Best(shared.value, k, columns, by, weight) if k else None
            for whole in batches:
                for piece in slices(whole, shared.value):
                    if best:
                        best.add(piece)
                    else:
                        yield every_pair(piece, shared.value, columns, schema.names)
            if best:
                yield from best.batches(schema.names)

        part = chunks.mapInArrow(run, schema)
        if k is not None:
            ranked = part.withColumn("_by", F.col("similarity") * (F.col(weight) if weight else F.lit(1.0)))
            part = top(ranked, k, "_by", ["query_id", by] if by else "query_id").drop("rank", "_by")
        if several:
            part = work_table(part, "similar")
            shared.unpersist()
        out = part if out is None else out.unionByName(part)
    return out


def top(scored: DataFrame, k: int, score: str = "similarity", by: str | list[str] = "query_id", key: str = "id") -> DataFrame:
    """The k best of each query; ties by key. Spark prunes each partition to k before the shuffle."""
    w = Window.partitionBy(by).orderBy(F.desc(score), F.asc(key))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Of an index: most cells, rows of the sample for each cell, rounds of learning; stored rows that are
#: searched for to learn how many cells a query must read, neighbours of each, and the share of these
#: that must be found.
CELLS, SAMPLE, ROUNDS = 4096, 64, 10
TRIED, NEIGHBOURS, RECALL = 128, 10, 0.95


@dataclass
class CellIndex:
    """An inverted file of vectors: rows stored by cell under ``path``, with the centre of each cell (unit
    vectors, at most CELLS of them) and the least cosine of its rows with it; ``probes`` is the number of
    cells that a query reads."""

    path: str
    probes: int
    number: np.ndarray
    centres: np.ndarray
    least: np.ndarray
    schema: StructType

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> CellIndex:
        got = spark.read.parquet(f"{path}/cells").orderBy("cell").toArrow()
        centres = np.array(got.column("centre").to_pylist(), float).reshape(len(got), -1 if len(got) else 0)
        return cls(path, max(got.column("probes").to_pylist(), default=1), got.column("cell").to_numpy(), centres, got.column("least").to_numpy(), StructType.fromJson(json.loads(spark.read.parquet(f"{path}/schema").first()[0])))

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{self.path}/rows")


def build_index(chunks: DataFrame, path: str, cells: int | None = None) -> CellIndex:
    """Write an index of ``chunks`` (id, embedding and whatever else) to ``path`` and open it.

    Cells are learned by k-means over unit vectors of a sample of SAMPLE rows for each cell, chosen by a
    hash of the id; every row is stored, in the cell of the nearest centre. As many cells as the root of
    the number of rows unless told. The nearest rows of TRIED stored ones, by an exact scan, tell how many
    cells must be read for a share of RECALL. A hot cell is written by several tasks. Vectors of another width than
    the first one of the sample are left out, as they resemble nothing; a zero vector goes to any cell.
    """
    spark = chunks.sparkSession
    n = chunks.count()
    cells = max(1, min(CELLS, round(n**0.5))) if cells is None else cells
    some = chunks.where("embedding is not null").select("id", F.col("embedding").cast("array<double>").alias("v")).orderBy(F.xxhash64("id"), "id").limit(SAMPLE * cells)
    some = work_table(some, "vector-sample")
    width = (some.select(F.size("v").alias("n")).groupBy("n").count().orderBy(F.desc("count"), "n").first() or [1])[0]
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    units = some.where(F.size("v") == width).withColumn("norm", norm).where("norm > 0").select(array_to_vector(F.transform("v", lambda x: x / F.col("norm"))).alias("features"))
    learned = KMeans(k=cells, maxIter=ROUNDS, seed=1).fit(units).clusterCenters() if cells > 1 and units.limit(2).count() > 1 else [np.ones(width)]
    centres = np.array(learned, float).reshape(-1, width)
    centres = centres / lengths(centres)[:, None]
    shared = spark.sparkContext.broadcast(centres)
    schema = StructType([*chunks.schema, StructField("cell", LongType()), StructField("near", DoubleType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits, rows = matrix(batch.column("embedding"), width)
            near = (rows / lengths(rows)[:, None]) @ shared.value.T
            cell = near.argmax(axis=1) if len(rows) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.filter(fits).columns, pa.array(cell, pa.int64()), pa.array(near[np.arange(len(cell)), cell])], names=schema.names)

    placed = work_table(chunks.mapInArrow(assign, schema), "vector-cells")
    placed.drop("near").hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/rows")
    spark.createDataFrame([(placed.drop("near").schema.json(),)], "schema string").coalesce(1).write.parquet(f"{path}/schema")
    held = placed.groupBy("cell").agg(F.min("near").alias("least"), F.count("*").alias("n"))
    known = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cell bigint, centre array<double>")
    held = held.withColumn("probes", F.lit(probes_wanted(placed, centres)))
    held.join(F.broadcast(known), "cell").coalesce(1).write.parquet(f"{path}/cells")  # at most CELLS rows
    return CellIndex.open(spark, path)


def probes_wanted(placed: DataFrame, centres: np.ndarray) -> int:
    """The least number of nearest cells that hold a share of RECALL of the neighbours of a sample."""
    tried = placed.select(F.col("id").alias("query_id"), F.col("embedding").alias("vector")).orderBy(F.xxhash64("query_id", F.lit(1)), "query_id").limit(TRIED)
    block = Block.of(tried)
    if not block.rows.size:
        return 1
    rows = placed.select("id", F.col("cell").alias("home"), "embedding")
    got = similar(rows, tried, NEIGHBOURS + 1).where("id <> query_id").select("query_id", "home").toArrow()  # TRIED * NEIGHBOURS rows
    place = np.argsort(np.argsort(-(block.rows / lengths(block.rows)[:, None]) @ centres.T, axis=1), axis=1)
    of = {int(i): k for k, i in enumerate(block.ids)}
    ranks = sorted(place[of[q], c] for q, c in zip(got.column("query_id").to_pylist(), got.column("home").to_pylist(), strict=True))
    return int(ranks[min(len(ranks) - 1, int(np.ceil(RECALL * len(ranks))))]) + 1 if ranks else 1


def probed(index: CellIndex, rows: DataFrame, block: Block, probes: np.ndarray, k: int, schema: StructType) -> DataFrame:
    """The k best rows of each query among the cells that ``probes`` (queries by cells) marks; only these
    cells' files are read."""
    spark, columns = rows.sparkSession, schema.names[:-2]
    asked = {int(index.number[c]): np.flatnonzero(probes[:, c]) for c in np.flatnonzero(probes.any(axis=0))}
    shared = spark.sparkContext.broadcast((block, asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, asked = shared.value
        best = Best(block, k, columns, None, None)
        for whole in batches:
            for cell in pc.unique(whole.column("cell")).to_pylist():
                mine = whole.filter(pc.equal(whole.column("cell"), cell))
                for piece in slices(mine, block):
                    best.add(piece, asked[cell])
        yield from best.batches(schema.names)

    return top(rows.where(F.col("cell").isin(sorted(asked))).mapInArrow(run, schema), k).drop("rank")


def search_index(index: CellIndex, queries: DataFrame, k: int, probes: int | None = None, where: str | None = None, exact: bool = False) -> DataFrame:
    """The stored columns, query_id and similarity of the k best rows of each query (query_id, vector)
    among the cells whose centres are nearest, ``probes`` of them or as many as the index has learned;
    ``where`` filters rows first.

    ``exact`` goes on to every cell that could hold a better row: a row within an angle of its centre is
    no nearer to the query than the difference of the two angles. So the rows are those of ``similar``.
    """
    spark = queries.sparkSession
    rows = index.rows(spark)
    rows, schema, out = rows.where(where) if where else rows, result_schema(rows), None
    for block in blocks(queries, block_size(k)):
        near = (block.rows / lengths(block.rows)[:, None]) @ index.centres.T if block.rows.shape[1] == index.centres.shape[1] else np.zeros((len(block.ids), len(index.number)))
        first = np.zeros(near.shape, bool)
        if near.size:
            chosen = np.argsort(-near, axis=1, kind="stable")[:, : probes or index.probes]
            np.put_along_axis(first, chosen, True, axis=1)
        part = probed(index, rows, block, first, k, schema)
        if exact:
            part = work_table(part, "probed")
            kth = dict(part.groupBy("query_id").agg(F.min("similarity").alias("s"), F.count("*").alias("n")).where(F.col("n") >= k).select("query_id", "s").collect())  # a row for each query of the block
            angle = np.arccos(np.clip(near, -1, 1)) - np.arccos(np.clip(index.least, -1, 1))[None, :]
            bound = np.where(block.same[:, None], np.cos(np.maximum(angle, 0)), 1.0)
            more = ~first & (bound >= np.array([kth.get(int(i), -2.0) for i in block.ids])[:, None] - 1e-6)
            part = top(part.unionByName(probed(index, rows, block, more, k, schema)), k).drop("rank") if more.any() else part
        out = part if out is None else out.unionByName(part)
    return out
