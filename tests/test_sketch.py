"""Sketches of quantiles: their error, and that they merge."""

import math
import random

import pytest

from lodestone.operators import measure as M


@pytest.mark.parametrize("share", [0.01, 0.5, 0.95, 1.0])
def test_quantiles_of_merged_sketches(spark, share):
    rng = random.Random(7)
    rows = [(k % 9, "ab"[k % 2], rng.choice([rng.lognormvariate(3, 3), rng.random(), 5.0, 0.0, -1.0, None])) for k in range(6000)] + [(1, "zero", 0.0), (1, "null", None)]
    days = M.sketch(spark.createDataFrame(rows, "day int, model string, ms double"), ["day", "model"], "ms")
    got = {r.model: (r.n, r.quantile) for r in M.sketch_quantile(M.merge_sketches(days, ["model"]), ["model"], share).collect()}
    assert set(got) == {"a", "b", "zero"} and got["zero"] == (1, 0.0)
    for model in "ab":
        known = sorted(v for _, m, v in rows if m == model and v is not None)
        exact = known[math.ceil(share * len(known)) - 1]
        assert got[model][0] == len(known)
        assert abs(got[model][1] - max(exact, 0)) <= M.ERROR * max(exact, 0) * (1 + 1e-9)
    assert days.groupBy("model").count().where("count > 9 * 2500").count() == 0


def test_drafts_that_an_upgrade_changes_are_lost(spark):
    before = spark.createDataFrame([(1, "a", 1.0), (2, "a", None), (3, None, 1.0), (4, None, 2.0), (5, "b", 1.0)], "id int, status string, total double")
    after = spark.createDataFrame([(1, "a", 1.0), (2, "a", 0.0), (3, "x", 1.0), (5, "b", 1.0), (9, "b", 0.0)], "id int, status string, total double")
    got = {r.status: tuple(r)[1:] for r in M.preserved(before, after, "id", "status").collect()}
    assert got == {"a": (2, 1, 1, [2], 8.0), None: (2, 0, 2, [3, 4], 6.0), "b": (1, 1, 0, [], 10.0)}
    gone = {r.status: r.lost for r in M.preserved(before, after.drop("total"), "id", "status").collect()}
    assert gone == {"a": 2, None: 2, "b": 1}  # a column that is gone is lost in each
