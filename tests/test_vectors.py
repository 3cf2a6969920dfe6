"""Nearest vectors: what a task gives out, the index against the exact scan."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.operators import vectors as V
from lodestone.plans import retrieve
from lodestone.sources import frames as S


def brute(rows, asked, k):
    """Of each query the k best ids, by pairs; equal vectors are equally similar."""
    out = {}
    for q, v in asked:
        near = {}
        for i, r in rows:
            key = tuple(r)
            if key not in near:
                a, b = np.array(v, float), np.array(r, float)
                near[key] = float(a @ b / ((np.linalg.norm(a) or 1) * (np.linalg.norm(b) or 1)))
        out[q] = [i for _, i in sorted((-round(near[tuple(r)], 12), i) for i, r in rows)][:k]
    return out


def test_a_task_gives_out_k_rows_of_each_query():
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-2, 3, 4).tolist()) for i in range(3000)]  # many equal ones
    asked = rng.integers(-2, 3, (6, 4)).astype(float)
    best = V.Best(V.Block(np.arange(6), asked, np.ones(6, bool)), 5, ["id"], None, None)
    order = rng.permutation(3000)
    for part in np.array_split(order, 7):
        best.add(pa.record_batch({"id": pa.array([rows[i][0] for i in part]), "embedding": pa.array([rows[i][1] for i in part], pa.list_(pa.float32()))}))
        assert len(best.pairs[0]) <= 6 * 5 and best.rows.num_rows <= 6 * 5
    out = pa.Table.from_batches(list(best.batches(["id", "query_id", "similarity"]))).to_pylist()
    got = {q: [r["id"] for r in sorted((r for r in out if r["query_id"] == q), key=lambda r: (-round(r["similarity"], 12), r["id"]))] for q in range(6)}
    assert got == brute(rows, list(enumerate(asked.tolist())), 5)


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    chunks = S.chunks(spark, "/root/testdata/sf0.1").select("id", "chunk_type", "embedding")
    return chunks, V.build_index(chunks, f"file://{tmp_path_factory.mktemp('index')}")


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, set()).add(r.id)
    return out


def test_recall_of_the_index(spark, index):
    chunks, cells = index
    asked = retrieve.queries(spark, "/root/testdata/sf0.1")
    want, got = found(V.similar(chunks, asked, 10)), found(V.search_index(cells, asked, 10))
    assert len(want) == 40 and cells.rows(spark).count() == chunks.count()
    recall = sum(len(want[q] & got.get(q, set())) for q in want) / sum(map(len, want.values()))
    assert recall >= 0.9, recall
    assert found(V.search_index(cells, asked, 10, exact=True)) == want
    some = "chunk_type = 'requirement'"
    assert found(V.search_index(cells, asked, 10, where=some, exact=True)) == found(V.similar(chunks.where(some), asked, 10))


def test_only_probed_cells_are_read(spark, index):
    _, cells = index
    asked = retrieve.queries(spark, "/root/testdata/sf0.1").where("query_id = 100")
    block = V.Block.of(asked)
    near = block.rows @ cells.centres.T
    first = np.zeros(near.shape, bool)
    first[0, np.argsort(-near[0])[:3]] = True
    rows = cells.rows(spark)
    read = V.probed(cells, rows, block, first, 5, V.result_schema(rows))
    plan = read._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan
    some = rows.where(F.col("cell").isin([int(cells.number[c]) for c in np.flatnonzero(first[0])]))
    files = lambda df: df.select(F.input_file_name()).distinct().count()
    assert files(some) < files(rows) / 4
    assert some.count() < rows.count() / 4 and read.count() == 5


def test_index_of_odd_vectors(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [0.6, 0.8]), (5, [0.6, 0.8]), (6, [-1.0, 0.0])], "id bigint, embedding array<float>")
    asked = spark.createDataFrame([(9, [2.0, 0.0])], "query_id bigint, vector array<float>")
    index = V.build_index(rows, f"file://{tmp_path}/a", 2)
    got = [(r.id, round(r.similarity, 6)) for r in V.search_index(index, asked, 4, exact=True).orderBy(F.desc("similarity"), "id").collect()]
    assert got == [(1, 1.0), (5, 0.6), (5, 0.6), (2, 0.0)]
    none = V.build_index(rows.limit(0), f"file://{tmp_path}/b")
    assert V.search_index(none, asked, 4).count() == V.search_index(none, asked, 4, exact=True).count() == 0
