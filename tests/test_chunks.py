"""Chunks of long and odd texts."""

import time

from lodestone.operators import chunking as C


def test_a_long_text_is_chunked_in_linear_time(spark):
    lines = [["- a bullet of some length", "", "Requirements:", "prose that goes on. And on! And on?", "more of it"][k % 5] for k in range(100_000)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "word " * 200_000), (3, None), (4, " \t "), (5, "short")], "id int, raw_text string")
    C.chunk_documents(docs).where("id > 2").count()  # the workers are up
    began = time.perf_counter()
    got = {r["id"]: r["n"] for r in C.chunk_documents(docs).groupBy("id").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert time.perf_counter() - began < 20
    # each bullet, and the two lines after each heading together; a text without sentence marks stays whole
    assert got == {1: 40_000, 2: 1, 5: 1}


def test_chunks_keep_what_units_hold():
    text = "intro line here\n岗位职责：\n• first duty of all\n2. second duty of all\n\nRequirements\n" + "A sentence of words. " * 60
    units = list(C.units_of(text))
    assert [u[:2] for u in units] == [("overview", None), ("responsibility", "岗位职责："), ("responsibility", "岗位职责："), ("requirement", "Requirements")]
    pieces = list(C.packed(units[-1][2]))
    assert all(len(p) <= C.MOST for p in pieces) and " ".join(pieces) == units[-1][2]
