"""Events that come late, state that leaves, batches that run again."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodestone.sources.files import work_path
from lodestone.streaming import logs

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
START = datetime(2024, 1, 1)


def put(spark, path, name, rows):
    """A file of events: event_id, minutes after START, user_id, failed."""
    spark.createDataFrame([(k, START + timedelta(minutes=m), u, "error" if bad else "view", 0.0, '{"k": 2}') for k, m, u, bad in rows], SCHEMA).coalesce(1).write.parquet(f"{path}/{name}")


def late_log(spark, path):
    """Three files; the third has an error and an event of five hours before."""
    put(spark, path, "a", [(1, 0, 7, False), (2, 180, 8, False)])
    put(spark, path, "b", [(3, 300, 7, False), (4, 364, 8, True), (5, 370, 8, False)])
    put(spark, path, "c", [(100, 60, 7, True), (101, 65, 7, False), (6, 375, 8, False)])
    return f"{path}/*/*.parquet"


def test_late_events_count(spark, tmp_path):
    path = late_log(spark, tmp_path)
    assert sorted(r.event_id for r in logs.blocked(spark, path).collect()) == [5, 6, 101]
    # four of five, or less, succeed once there is an error among them
    want, last = {}, {}
    for _, u, bad in sorted([(0, 7, False), (180, 8, False), (300, 7, False), (364, 8, True), (370, 8, False), (60, 7, True), (65, 7, False), (375, 8, False)]):
        last[u] = [*last.get(u, []), not bad][-10:]
        share, x = sum(last[u]) / len(last[u]), want.get(u, 2.0)
        want[u] = min(60.0, x * 1.5) if share < 0.8 else max(1.0, x * 0.9) if share > 0.95 else x
    assert {r.user_id: round(r.delay, 9) for r in logs.adaptive_delay(spark, path).collect()} == {u: round(x, 9) for u, x in want.items()}


def test_late_failures_and_usage_count(spark, tmp_path):
    put(spark, tmp_path, "a", [(1, 5, 1, True)])
    put(spark, tmp_path, "b", [(2, 6000, 1, True)])
    put(spark, tmp_path, "c", [(3, 7, 1, True), (4, 8, 1, False)])
    path = f"{tmp_path}/*/*.parquet"
    assert {r.failures for r in logs.lockouts(spark, path, 2).collect()} == {2} and logs.lockouts(spark, path, 2).count() == 13
    assert sorted((str(r.day), r.calls, r.tokens) for r in logs.daily_usage(spark, path).collect()) == [("2024-01-01", 3, 6), ("2024-01-05", 1, 2)]


def test_state_leaves(spark, tmp_path):
    """What waits is given out by a timer of processing time, and state is gone after its time."""
    put(spark, tmp_path, "a", [(1, 0, 7, True), (2, 1, 7, False)])
    processor = logs.InOrder("until bigint", (-1,), logs.block(30), ("user_id", "event_id"), idle=1, ttl=1)
    out = work_path(spark, "state-leaves")
    rows = logs.outcomes(logs.events(spark, f"{tmp_path}/*/*.parquet"))

    def run():
        stream = logs.started(rows, "user_id bigint, event_id bigint", processor)
        logs.until_done(stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{out}-state").option("path", out), spark)
        return sorted((r.event_id, r.late_id) for r in spark.read.parquet(out).collect())

    assert run() == []  # both wait
    state = spark.read.format("statestore").option("path", f"{out}-state").option("stateVarName", "waiting").option("flattenCollectionTypes", "true").load()
    assert state.count() == 2
    put(spark, tmp_path, "b", [(3, 2, 8, False)])
    run()
    put(spark, tmp_path, "c", [(4, 3, 8, False)])
    run()
    left = {v: spark.read.format("statestore").option("path", f"{out}-state").option("stateVarName", v).load().where("key.user_id = 7").count() for v in ("state", "upto")}
    assert left == {"state": 0, "upto": 0}


def test_a_timer_ends_the_wait(spark, tmp_path):
    put(spark, tmp_path, "a", [(1, 0, 7, True), (2, 1, 7, False)])
    processor = logs.InOrder("until bigint", (-1,), logs.block(30), ("user_id", "event_id"), idle=1)
    out = work_path(spark, "timer")
    rows = logs.outcomes(logs.events(spark, f"{tmp_path}/*/*.parquet"))
    for name, more in (("b", [(3, 2, 8, False)]), ("c", [(0, -1, 7, False), (4, 3, 7, False)]), (None, None)):
        stream = logs.started(rows, "user_id bigint, event_id bigint", processor)
        logs.until_done(stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{out}-state").option("path", out), spark)
        if name:
            put(spark, tmp_path, name, more)
    got = spark.read.parquet(out)
    assert [r.event_id for r in got.where("late_us is null and event_id is not null").collect()] == [2]  # given out without any later event of the user
    assert [r.late_id for r in got.where("late_us is not null").collect()] == [0]


def test_batches_that_run_again_count_once(spark, tmp_path):
    put(spark, tmp_path, "a", [(k, k, k % 3, k % 2 == 0) for k in range(20)])
    first = logs.daily_usage(spark, f"{tmp_path}/*/*.parquet")
    assert first.agg(F.sum("calls")).first()[0] == 20


def test_the_store_counts_a_batch_once(spark, tmp_path):
    put(spark, tmp_path, "a", [(k, k, k % 3, k % 2 == 0) for k in range(20)])
    put(spark, tmp_path, "b", [(k, k, 9, True) for k in range(5)])
    table = logs.user_store(spark, f"{tmp_path}/*/*.parquet")
    want = [(0, 7, 4), (1, 7, 3), (2, 6, 3), (9, 5, 5)]
    assert sorted((r.user_id, r.events, r.failures) for r in table.read().collect()) == want
    again = spark.createDataFrame([(9, 1, 5, 5)], "user_id bigint, shard int, events bigint, failures bigint")
    assert not table.merge(again, "user_id", logs.added, 1)
    assert sorted((r.user_id, r.events, r.failures) for r in table.read().collect()) == want
