"""Work and memory of queries that must grow no faster than the tables."""

import io
import random
import time
import zipfile
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import TimerValues

from lodestone.functions import postings as P
from lodestone.operators import vectors as V
from lodestone.plans import retrieve, rules, texts
from lodestone.sources import files, folder, frames, replies
from lodestone.streaming import logs

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_each_section_is_searched_once(spark):
    rows = spark.createDataFrame([("Requirements:\n- knows SQL well\n\n",)], "t string")
    said = rows.select(P.requirements(F.col("t")).alias("r"), P.preferred(F.col("t")).alias("p"))
    assert said.first() == (["SQL", "knows SQL well"], [])
    for pattern in (*P.ENGLISH_SECTIONS, *P.PREFERRED_SECTIONS):
        assert plan(said).count(f"regexp_extract(t#{plan(said).split('t#')[1].split()[0].rstrip(',)]')}, {pattern}, 1)") <= 1
    assert plan(said).count("regexp_extract(") == len(P.ENGLISH_SECTIONS) + len(P.PREFERRED_SECTIONS)


def test_a_text_is_searched_for_marked_patterns_alone(spark):
    odd = ["5年以上 Go语言，精通SQL。", "no mark", None, "语言x语言", "aあ语言语言bc语言", "123456789语言 12345678语言1语言ab语言", "框架a框架", "x" * 30 + "编程" + "y" * 30 + "编程z", "a b中间件", "_1中间件中间件"]
    rows = spark.createDataFrame([(t,) for t in odd], "t string")
    said = rows.select(P.skills_by_rule(F.col("t")).alias("s"))
    plain = rows.select(F.array_distinct(F.concat(*[P.found(F.col("t"), p) for p in P.SKILL_PATTERNS])).alias("s"))
    assert [r.s for r in said.collect()] == [r.s for r in plain.collect()]
    assert said.first().s == ["5", "S", "Go语言"]
    for mark, pattern in zip(P.SKILL_MARKS, P.SKILL_PATTERNS, strict=True):
        assert mark in pattern and f", {mark})" in plan(said)


def test_lines_of_a_posting_are_looked_at_once(spark):
    """20,000 headings of 40,000 lines: a second or two, and minutes if each line looks at all lines."""
    n = 20_000
    rows = spark.range(1).select(F.concat(F.lit(" - early \n"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.concat(F.when(k % 2 == 0, "职责").otherwise("要求"), F.lit("\n- "), k)), "\n")).alias("t"))
    began = time.monotonic()
    said = rows.select(P.duties_and_needs(F.col("t")).alias("s")).first().s
    assert time.monotonic() - began < 20
    assert said.responsibilities == ["early", *map(str, range(2, n + 1, 2))] and said.requirements == [*map(str, range(1, n, 2))]
    texts = [("",), (None,), ("要求",), ("- \n-\n职责\n3、\t x\x0b\nplain\n任职\n职责 要求\n12.y",)]
    said = [r.s for r in spark.createDataFrame(texts, "t string").select(P.duties_and_needs(F.col("t")).alias("s")).collect()]
    assert [(s.responsibilities, s.requirements) for s in said] == [([], []), (None, None), ([], []), (["x", "y"], [])]


def test_a_field_of_a_reply_is_read_once(spark):
    said = '{"id": 7, "job_detail": {"job_name": " Dev ", "company": "x", "company_name": "Acme", "salary_low": 5, "salary_high": 9.5, "requirements": "5年以上 SQL语言", "description": "优先 Go"}}'
    rows = spark.createDataFrame([(said,), ("{}",), (None,), ('{"href": "http://x", "companyFullName": "F", "label": "a,, b"}',)], "t string")
    boss, lagou = (rows.select(f(F.col("t")).alias("r")).select("r.*") for f in (replies.boss_posting, replies.lagou_posting))
    assert tuple(boss.first()) == ("Dev", "Acme", "", "5-9.5", "", "", "优先 Go\n5年以上 SQL语言", ["5", "SQL语言"], ["优先", "Go"], "https://www.zhipin.com/job/detail/7.html")
    assert [r.company for r in lagou.collect()] == ["Unknown", "Unknown", "Unknown", "F"] and lagou.collect()[3].skills_required == ["a", "b"]
    for made, paths in ((boss, ("job_detail", "requirements", "description", "area")), (lagou, ("positionName", "jobDesc", "positionAdvantage"))):
        assert [plan(made).count(f", $.{p})") for p in paths] == [1] * len(paths)


def test_a_small_file_is_dealt_to_all_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    for rows in (rules.postings(spark, DATA), texts.scan_http_json(spark, DATA)):
        assert rows.rdd.getNumPartitions() >= cores


def test_ranked_lists_are_dealt_by_their_number(spark, monkeypatch):
    assert retrieve.two_ndcgs(spark, DATA)._jdf.queryExecution().executedPlan().toString().count("Window") == 1  # of the rank
    monkeypatch.setattr(frames, "spread", lambda df, key, rows, spread=frames.spread: spread(df, key, rows // 10_000))
    assert frames.ranked(spark, DATA).rdd.getNumPartitions() == -(-frames.table(spark, DATA, "lineitem").count() // 100)


def test_what_a_task_compares_and_keeps_is_bounded(spark, monkeypatch):
    block = V.Block(np.arange(4096), np.ones((4096, 2)), np.ones(4096, bool))
    batch = pa.RecordBatch.from_pydict({"id": list(range(10_000))})
    assert sum(p.num_rows for p in V.slices(batch, block)) == 10_000
    assert max(p.num_rows for p in V.slices(batch, block)) * 4096 <= V.PAIRS
    assert V.block_size(200) * 200 <= V.KEPT and V.block_size(None) == V.QUERY_BLOCK
    rows = spark.range(300).selectExpr("id", "array(cast(id % 17 as double), cast(id % 5 as double) + 1) AS embedding")
    asked = rows.where("id % 10 = 0").selectExpr("id AS query_id", "embedding AS vector")
    said = lambda k: sorted((r.query_id, r.id, round(r.similarity, 12)) for r in V.similar(rows, asked, k).collect())
    want = {k: said(k) for k in (7, None)}
    monkeypatch.setattr(V, "PAIRS", 100)
    monkeypatch.setattr(V, "KEPT", 70)
    assert {k: said(k) for k in (7, None)} == want


def test_texts_go_in_batches_of_bounded_size(spark, tmp_path):
    conf = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(conf)
    folder.write_folder(spark.createDataFrame([(f"{k}.docx", "x" * 3_000_000) for k in range(3)], "file_name string, text string").select("file_name", files.encode_docx("text").alias("content")), f"file://{tmp_path}/f")
    assert spark.conf.get(conf) == str(folder.BATCH_BYTES)
    packed = io.BytesIO((tmp_path / "f" / "0.docx").read_bytes())
    assert zipfile.is_zipfile(packed) and len(packed.getvalue()) < folder.BATCH_BYTES // 100
    reader = folder.FolderReader({"path": f"file://{tmp_path}/f"}, folder.READERS)
    assert [b.num_rows for s in reader.partitions() for b in reader.read(s)] == [2, 1]


def test_means_of_scores_are_exact(spark, tmp_path):
    """The mean of the three is 116.65; in doubles it falls short of it in whatever order they are added."""
    rows = [(k, 1, "O", 0.0) for k in (100, 101, 102)] + [(k, 2, "O", x) for k, x in ((300, 293861.39), (303, 332733.97), (306, 373154.64))]
    made = spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double")
    made.selectExpr("*", "timestamp_ntz '2024-01-01 00:00:00' AS o_orderdate").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    assert {r.user_id: r["mean"] for r in retrieve.history_lookup_default(spark, str(tmp_path)).collect()}[1] == 116.7


class Handle:
    """State of one user in memory, with the calls to it."""

    def __init__(self):
        self.calls, self.kept, self.timers = 0, {}, []

    def getValueState(self, name, *_):  # noqa: N802
        return Kept(self, name)

    getListState = getValueState  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.append(at)


class Kept:
    def __init__(self, handle, name):
        self.handle, self.name = handle, name

    def get(self):
        self.handle.calls += 1
        return self.handle.kept.get(self.name, [] if self.name == "waiting" else None)

    def put(self, value):
        self.handle.calls += 1
        self.handle.kept[self.name] = value

    update = put

    def appendList(self, value):  # noqa: N802
        self.put(self.handle.kept.get(self.name, []) + value)

    def clear(self):
        self.handle.calls += 1
        self.handle.kept.pop(self.name, None)


def test_a_user_costs_few_calls_to_the_state():
    handle, minute = Handle(), 60_000_000
    processor = logs.InOrder("until bigint", (-1,), logs.block(30), ("user_id", "event_id"))
    processor.init(handle)
    come = lambda now, rows: [r.event_id for r in processor.handleInputRows((7,), iter([Row(us=m * minute, event_id=k, bad=bad) for k, m, bad in rows]), TimerValues(now, 0))]
    # 500 events, of which the first errs; those from an hour before the last wait
    assert come(0, [(k, k, k == 0) for k in range(500)]) == [*range(1, 30)]
    assert handle.calls <= 7 and len(handle.kept["waiting"]) == 61
    handle.calls = 0
    assert come(1000, [(500, 500, False)]) == [] and handle.calls <= 3 and len(handle.timers) == 1
    # the timer is put off by what came since; then it gives out what waits
    assert list(processor.handleExpiredTimer((7,), TimerValues(logs.IDLE, 0), None)) == [] and handle.timers[1:] == [logs.IDLE + 1000]
    handle.calls = 0
    assert come(2000, [(-1, logs.FAR_US // minute + 1, False)]) == [] and handle.calls <= 6 and "waiting" not in handle.kept
    assert processor.place()[0].upto == (500 * minute, 500)


def test_a_log_is_taken_in_few_batches(spark, tmp_path, monkeypatch):
    rows = spark.range(30).selectExpr("id AS event_id", "timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(id AS int)) AS ts", "id % 2 AS user_id", "if(id = 0, 'error', 'view') AS event_type", "0d AS value", "'' AS props")
    rows.repartition(12).write.parquet(f"{tmp_path}/events.parquet")
    batches = []
    drained = logs.drain
    monkeypatch.setattr(logs, "drain", lambda *a, **k: batches.append(drained(*a, **k)) or batches[0])
    assert sorted(r.event_id for r in logs.blocked(spark, f"{tmp_path}/event[s].parquet").collect()) == [*range(2, 30, 2)]
    names = {f.split("/batch=")[1].split("/")[0] for f in batches[0].inputFiles()}
    assert len(names) <= logs.BATCHES + 1


MINUTE = 60_000_000


def shards(handle, **times):
    """A shard over state in memory; and what it gives of events (user, event_id, minute, failed), or of a timer, at a time."""
    processor = logs.Shards(logs.InOrder("until bigint", (-1,), logs.block(30), ("user_id", "event_id"), **times))
    handle.kept["users"] = []
    processor.init(handle)

    def give(now, rows=None, key=(3,)):
        handle.calls = 0
        frame = pd.DataFrame([(u, m * MINUTE, k, bad) for u, k, m, bad in rows or []], columns=["user_id", "us", "event_id", "bad"])
        # an Arrow batch ends within a user's rows
        got = processor.handleExpiredTimer(key, TimerValues(now, 0), None) if rows is None else processor.handleInputRows(key, iter([frame[: len(frame) // 2], frame[len(frame) // 2 :]]), TimerValues(now, 0))
        return [(r.user_id, r.event_id, r.late_id) for f in got for r in f.itertuples()]

    return give


def test_users_of_a_shard_cost_the_calls_of_one():
    handle = Handle()
    give = shards(handle)
    rows = [(u, 1000 * u + m, m, m == 0) for m in range(500) for u in range(100)]
    assert sorted(give(0, rows)) == [(u, 1000 * u + m, None) for u in range(100) for m in range(1, 30)]
    assert handle.calls <= 3 and len(handle.timers) == 1
    # one user goes on, one has a late event, and the rest stay as they are; no timer is added
    kept = {u: tuple(r) for u, *r in handle.kept["users"]}
    big = (1 << 62) + 1
    assert give(1000, [(7, big, 500, False), (8, big, 100, True)]) == [(8, None, big)]
    assert handle.calls <= 3 and len(handle.timers) == 1
    assert {u for u, *r in handle.kept["users"] if tuple(r) != kept[u]} == {7, 8}
    end = [(u, -1, logs.FAR_US // MINUTE + 1, False) for u in range(100)]
    assert give(2000, end) == [] and handle.calls <= 3
    assert {u: r[2][:2] for u, *r in handle.kept["users"]} == {u: (500 * MINUTE, big) if u == 7 else (499 * MINUTE, 1000 * u + 499) for u in range(100)}
    assert not any(r[-1] for r in handle.kept["users"])
    # rows without a user are a user of their own
    handle.kept["users"] = []
    assert [(u is None, k) for u, k, _ in give(3000, [(0, 1, 0, True), (0, 2, 1, False), (0, 3, logs.FAR_US // MINUTE + 1, False)], (logs.NOBODY,))] == [(True, 2)]


def test_users_of_a_shard_have_their_own_timers():
    handle = Handle()
    give = shards(handle, idle=10, ttl=100)
    assert give(0, [(1, 1, 0, True), (1, 2, 1, False)]) == [] and handle.timers == [10]
    assert give(5, [(2, 3, 0, True), (2, 4, 1, False)]) == [] and handle.timers == [10]
    # the timer of one ends its wait alone, and the next is set
    assert give(11) == [(1, 2, None)] and handle.timers == [10, 15]
    assert give(16) == [(2, 4, None)] and handle.timers == [10, 15, 111]
    # a state leaves after its time, though its shard has no events
    assert give(112) == [] and [r[0] for r in handle.kept["users"]] == [2] and handle.timers[3:] == [116]
    assert give(117) == [] and not handle.kept.get("users")
    # and a user starts anew: an event of before is not late
    handle.kept["users"] = []
    assert give(200, [(1, 9, 0, True)]) == [] and handle.kept["users"][0][0] == 1


def test_a_log_shares_keys_and_gives_the_same(spark, tmp_path, monkeypatch):
    """Users with events in many files, out of order and late, without a user, and with numbers beyond a double's."""
    rng, far = random.Random(7), 1 << 60
    rows = [(far + k, datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(3000)), None if k % 11 == 0 else far + k % 23, "error" if rng.random() < 0.2 else "view", 0.0, "") for k in range(1500)]
    for n in range(3):
        spark.createDataFrame(rows[n::3], logs.EVENTS).coalesce(1).write.parquet(f"{tmp_path}/{n}")
    monkeypatch.setattr(logs, "USERS", 5)
    started, asked = logs.started, []
    monkeypatch.setattr(logs, "started", lambda *a: asked.append(a[3]) or started(*a))
    got = {r.user_id: r.delay for r in logs.adaptive_delay(spark, f"{tmp_path}/*/*.parquet").collect()}
    assert 4 <= asked[0] <= 6
    want = {}
    for user in {r[2] for r in rows}:
        own = sorted((r[1], r[0], r[3] == "error") for r in rows if r[2] == user)
        want[user] = logs.Delay.take(logs.Delay.START, own)[0][0]
    assert got == want
