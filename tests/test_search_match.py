"""Text search by trigrams and the matching of skills, against all pairs."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestone.operators import matching, trigrams
from lodestone.sources import frames


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcé职𝔘") for _ in range(rng.randint(1, 4))) for _ in range(40)]
    return [None, "", "ab", "ABC abc", "x" * 20_000, "the " * 5000, *[" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(150)]]


def test_search_by_trigrams(spark, texts, tmp_path):
    rows = spark.createDataFrame([(k, t, "Title Ab" if k % 9 == 0 else None) for k, t in enumerate(texts)] + [(3, "abc again", None)], "id bigint, text string, title string")
    rng = random.Random(4)
    asked = ["", None, "a", "AB", "职", "𝔘", "bc", "the t", "xxxx", "zzz", "title a", "Abc a", *[t[k : k + rng.randint(2, 9)] for t in texts[6:60] for k in [rng.randint(0, len(t))]]]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id bigint, query_text string")
    index = trigrams.build_trigrams(rows.select("id", F.concat_ws("\n", "text", "title").alias("text")), f"file://{tmp_path}/t")
    got = sorted((r.query_id, r.id, r.text or "") for r in trigrams.search(index, rows, queries, ["text", "title"]).collect())
    want = sorted((q, r.id, r.text or "") for q, a in enumerate(asked) for r in rows.collect() if a and (a.lower() in (r.text or "").lower() or a.lower() in (r.title or "").lower()))
    assert got == want


def test_only_folders_of_asked_trigrams_are_read(spark, texts, tmp_path):
    rows = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    index = trigrams.build_trigrams(rows, f"file://{tmp_path}/t")
    near = trigrams.candidates(index, spark.createDataFrame([(1, "the t")], "query_id bigint, asked string"))
    assert [r.id for r in near.collect()] == [5]
    assert "PartitionFilters: [bucket" in near._jdf.queryExecution().toString()
    folders = lambda buckets: {int(r[0].split("bucket=")[1].split("/")[0]) for r in index.read(spark, "postings", buckets).select(F.input_file_name()).distinct().collect()}
    assert folders([1, 2]) <= {1, 2} and len(folders(list(range(64)))) > 10


def test_index_without_rows(spark, tmp_path):
    rows = spark.createDataFrame([], "id bigint, text string")
    index = trigrams.build_trigrams(rows, f"file://{tmp_path}/t")
    assert trigrams.search(index, rows, spark.createDataFrame([(1, "abc"), (2, "a")], "query_id bigint, query_text string"), ["text"]).count() == 0


def pairs(resumes, jobs, least):
    """All pairs, by the rule."""
    out = []
    for i, has, years in resumes:
        has = {s.lower() for s in has or [] if s is not None}
        for j, wants in jobs:
            wants = {s.lower() for s in wants or [] if s is not None}
            score = int(len(has & wants) / len(wants) * 100) if wants else 50
            score = min(score + 10, 100) if (years or 0) >= 3 else max(score - 10, 0) if (years or 0) < 1 else score
            if score >= least:
                out.append((i, j, score, sorted(has & wants), sorted(wants - has)))
    return sorted(out)


@pytest.mark.parametrize("least", [70, 75, 100])
def test_matches_are_all_pairs_that_reach_the_score(spark, least):
    rng = random.Random(least)
    skill = lambda: rng.choice(["SQL", "sql", "Java", *[f"s{int(rng.paretovariate(1))}" for _ in range(3)], "职"])
    resumes = [(k, None if k % 31 == 0 else [skill() for _ in range(rng.randint(0, 12))] + [None] * (k % 2), [None, 0, 1, 2, 3, 9][k % 6]) for k in range(120)]
    jobs = [(k, None if k % 29 == 0 else [skill() for _ in range(rng.randint(0, 9))]) for k in range(120)]
    found = matching.matches(spark.createDataFrame(resumes, "id bigint, skills array<string>, years int"), spark.createDataFrame(jobs, "id bigint, skills array<string>"), least)
    got = sorted((r.resume_id, r.job_id, r.score, list(r.matched), list(r.missing)) for r in found.collect())
    assert got == pairs(resumes, jobs, least) and got


def test_matches_are_no_cross_join(spark):
    frame = spark.createDataFrame([(1, ["a"], 3)], "id bigint, skills array<string>, years int")
    plan = matching.matches(frame, frame)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    with pytest.raises(ValueError, match="without skills"):
        matching.matches(frame, frame, 60)


def shuffled(spark) -> dict[int, int]:
    """Bytes of shuffle files that each stage wrote."""
    empty = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, empty, spark._jvm.java.util.ArrayList())
    return {(s := stages.apply(k)).stageId(): s.shuffleWriteBytes() for k in range(stages.size())}


def work_tables(spark) -> set[Path]:
    return set(Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")).glob("*-*"))


def test_resumes_go_along_with_their_skills_in_passes(spark, monkeypatch):
    """No stage shuffles every resume's skills once for each of them, and tables that nothing reads any more are gone."""
    monkeypatch.setattr(matching, "PASS_ROWS", 8_000, raising=False)
    rng = random.Random(5)
    resumes = [(k, [f"Skill {s}" for s in rng.sample(range(20_000), 40)], k % 5) for k in range(2_000)]
    jobs = [(k, [s.upper() for s in rng.sample(resumes[k % 2_000][1], 1 + k % 6)] + ["nobody's"] * (k % 9 == 0)) for k in range(4_000)]
    before, tables = set(shuffled(spark)), work_tables(spark)
    # as on large tables: nothing is broadcast, and rows of a resume seldom stand together, where they would be packed as one
    conf = {"spark.sql.shuffle.partitions": "100", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    usual = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    found = matching.matches(spark.createDataFrame(resumes, "id bigint, skills array<string>, years int"), spark.createDataFrame(jobs, "id bigint, skills array<string>"))
    got = sorted((r.resume_id, r.job_id, r.score, list(r.matched), list(r.missing)) for r in found.collect())
    for k, v in usual.items():
        spark.conf.set(k, v)
    has = {}
    for i, skills, _ in resumes:
        for s in skills:
            has.setdefault(s.lower(), set()).add(i)
    near = {j: set().union(*[has.get(s.lower(), set()) for s in wants]) for j, wants in jobs}
    assert got == sorted(x for job in jobs for x in pairs([resumes[i] for i in near[job[0]]], [job], 70)) and len(got) > 4_000
    own = 40 * 4 * 2_000 * 40  # numbers of four bytes
    written = [n for k, n in shuffled(spark).items() if k not in before]
    assert max(written) < own / 3
    assert {t.name.split("-")[0] for t in work_tables(spark) - tables} == {"jobs", "pairs"}


def test_matches_without_rows(spark):
    none = spark.createDataFrame([], "id bigint, skills array<string>, years int")
    some = spark.createDataFrame([(1, ["a"], 3)], none.schema)
    assert [matching.matches(a, b).count() for a, b in ((none, none), (some, none), (none, some), (some, some))] == [0, 0, 0, 1]


def test_people_and_jobs_are_named_after_they_are_gathered(spark, tmp_path):
    """The same rows as by collecting names, repeated and null keys included."""
    orders = [(1, 7), (1, 7), (2, 7), (3, 8), (4, None), (5, 9), (None, 9), (6, 10)]
    lines = [(1, 2), (1, 2), (1, 3), (2, 3), (2, 4), (3, None), (4, 5), (5, 6), (5, None), (None, 8), (9, 1)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    people = {r.id: (sorted(r.skills), r.years) for r in frames.people(spark, str(tmp_path)).collect()}
    assert people == {7: (["TOOL 2", "TOOL 4", "Tool 3"], 2), 8: ([], 1), None: (["Tool 5"], 1), 9: (["TOOL 6"], 1)}
    jobs = {r.id: sorted(r.skills) for r in frames.jobs(spark, str(tmp_path)).collect()}
    assert jobs == {1: ["tool 2", "tool 3"], 2: ["tool 3", "tool 4"], 3: [], 4: ["tool 5"], 5: ["tool 6"], None: ["tool 8"], 9: ["TOOL 1"]}
