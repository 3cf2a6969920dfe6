"""Structured Streaming over the logs: append, windows, and state by key."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import datetime
from itertools import groupby
from operator import itemgetter
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from ..operators.tables import StoredTable
from ..sources.files import work_path, work_table
from ..sources.frames import calls_of

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def events(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """Stream of events from Parquet files that arrive at ``path``."""
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def closing(spark: SparkSession, path: str) -> DataFrame:
    """Stream of the rows that end a log, from files at ``path``."""
    spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(path))
    return spark.readStream.schema(EVENTS).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def until_done(writer: DataStreamWriter, spark: SparkSession) -> None:
    """Run a stream until everything available is processed.

    Batches without data are off for it: with timers of processing time the engine plans them without end.
    """
    conf = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "false")
    try:
        query = writer.trigger(availableNow=True).start()  # has a copy of the settings from here on
    finally:
        spark.conf.set(conf, before)
    query.awaitTermination()


#: Maps the state of a user and its due events (microseconds, event_id, failed) to the new state and rows.
Take = Callable[[tuple, list[tuple]], tuple[tuple, list[tuple]]]


def drain(stream: DataFrame, name: str, mode: str, end: tuple[str, DataFrame] | None = None) -> DataFrame:
    """Run until everything available is processed; return what was written.

    Output goes to a folder for each batch, so that a batch that is run again is written once. ``end`` is
    the path that ``closing`` reads and rows to put there after all data: the stream then goes on, so
    that what waits is given out.
    """
    spark = stream.sparkSession
    path = work_path(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    for last in (False, True) if end else (True,):
        if last and end:
            end[1].withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.mode("append").parquet(end[0])
        until_done(stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-state").foreachBatch(write), spark)
    return spark.read.schema(", ".join([*[f"`{c}` {t}" for c, t in stream.dtypes], "batch int"])).parquet(path).select(*stream.columns)


def calls(spark: SparkSession, path: str) -> DataFrame:
    return calls_of(events(spark, path))


def append_log(spark: SparkSession, path: str) -> DataFrame:
    """The log as it is appended."""
    return drain(calls(spark, path).select("id", "created_at", "operation", "status", "total_tokens"), "stream-log", "append")


def merged(stream: DataFrame, name: str, by: Sequence[Column | str], **counts: Column) -> DataFrame:
    """Sums by key over a whole stream: each batch writes its own sums, in a folder that a repeated batch
    writes anew, and a read adds them up. So nothing waits, nothing is late, and no state is held."""
    path = work_path(stream.sparkSession, name)

    def sums(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*by).agg(*[f.alias(c) for c, f in counts.items()])

    def write(batch: DataFrame, number: int) -> None:
        sums(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.option("checkpointLocation", f"{path}-state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    keys = [c for c in sums(stream).columns if c not in counts]
    parts = stream.sparkSession.read.schema(", ".join([*[f"`{c}` {t}" for c, t in sums(stream).dtypes], "batch int"])).parquet(path)
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])


def daily_usage(spark: SparkSession, path: str) -> DataFrame:
    """Calls and tokens by user and day, however late they come."""
    found = merged(calls(spark, path).withColumn("day", F.to_date("created_at")), "stream-usage", ["day", "user_id"], calls=F.count("*"), tokens=F.coalesce(F.sum("total_tokens"), F.lit(0)))
    return found.select("day", "user_id", "calls", "tokens")


def lockouts(spark: SparkSession, path: str, failures: int, length: str = "15 minutes", step: str = "1 minute") -> DataFrame:
    """Users and windows with as many failures, however late they come."""
    bad = calls(spark, path).where("status = 'error'").select("user_id", F.window("created_at", length, step).alias("w"))
    counted = merged(bad.select("user_id", F.col("w.end").alias("until")), "stream-lockout", ["user_id", "until"], failures=F.count("*"))
    return counted.where(F.col("failures") >= failures)


#: Time that events of a user wait for earlier ones, in microseconds of their own time; milliseconds of
#: processing after which a user's last events wait no longer; and after which the state of a user without
#: events leaves.
WAIT, IDLE, TTL = 3_600_000_000, 600_000, 30 * 86_400_000
#: Batches that a whole log is taken in, at most: a user's state is read and written in each.
BATCHES = 4
#: Users of a log that share a key of its state, and events of a log for each key, about; the key of rows without a user.
USERS, ROWS, NOBODY = 64, 20_000, -1
#: A row of this time ends the log.
FAR = datetime(9998, 1, 1)
FAR_US = 253_000_000_000_000_000


class Place(NamedTuple):
    """Where a user stands: the last event folded; the oldest and the latest that wait; the milliseconds at
    which the last one came; whether a timer is set."""

    upto: tuple[int, int]
    oldest: int
    latest: int
    seen: int
    timed: bool


class Event(NamedTuple):
    us: int
    event_id: int
    bad: bool | None


#: Both as the state has them.
PLACE, EVENT = "us bigint, event_id bigint, oldest bigint, latest bigint, seen bigint, timed boolean", "us bigint, event_id bigint, bad boolean"
NOWHERE = Place((-(1 << 62), 0), FAR_US, -(1 << 62), -(1 << 62), False)


class InOrder(StatefulProcessor):
    """State by user over events in the order of their time, whatever the order in which they come.

    ``start`` is the state of a new user (as ``state_schema`` has it), and ``take`` maps it and the events
    that are due (time in microseconds, event_id, failed) to the new state and rows.

    Events wait until the user's own later events are WAIT ahead (twice, at most), or for IDLE of processing time. The
    engine has no watermark, so that it drops none: an event before what was folded already comes out
    as a late row. A user's state leaves after ``ttl`` without events, and the user starts anew.

    Each call to the state crosses to the engine and back, so a user costs few of them: what a batch brings
    is folded from memory and only what goes on waiting is stored, and one timer at a time is set, which on
    its expiry is put off by what came since.
    """

    def __init__(self, state_schema: str, start: tuple, take: Take, columns: Sequence[str], idle: int = IDLE, ttl: int = TTL) -> None:
        self.state_schema, self.start, self.take, self.columns, self.idle, self.ttl = state_schema, start, take, [*columns, *LATE_COLUMNS], idle, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", EVENT)  # the timer empties it
        self.state = handle.getValueState("state", self.state_schema, self.ttl)
        self.upto = handle.getValueState("upto", PLACE, self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        come = [(r.us, r.event_id, r.bad) for r in rows]
        now, (at, known) = timerValues.getCurrentProcessingTimeInMs(), self.place()
        late, wait = [r for r in come if r[:2] <= at.upto], [r for r in come if r[:2] > at.upto and r[0] < FAR_US]
        stored = at.oldest < FAR_US or not known
        if wait:
            at = at._replace(oldest=min(at.oldest, min(wait)[0]), latest=max(at.latest, max(wait)[0]), seen=now)
        ended = max((r[0] for r in come), default=0) >= FAR_US
        given: list[tuple] = []
        # the list is read once it spans twice the time, so that a row is read about twice
        if ended or at.latest - at.oldest > 2 * WAIT:
            at, given = self.fold(at, FAR_US if ended else at.latest - WAIT, wait, stored)
        elif wait:
            self.waiting.appendList(wait)
        if at.oldest < FAR_US and not at.timed:
            self.handle.registerTimer(now + self.idle)
            at = at._replace(timed=True)
        if wait or ended:
            self.keep(at)
        yield from self.told(key, given, late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        at, _ = self.place()
        if at.seen + self.idle > timerValues.getCurrentProcessingTimeInMs():
            if at.oldest < FAR_US:
                self.handle.registerTimer(at.seen + self.idle)
            else:
                self.keep(at._replace(timed=False))
            return
        at, given = self.fold(at, FAR_US, [], True)
        self.keep(at._replace(timed=False))
        yield from self.told(key, given, [])

    def place(self) -> tuple[Place, bool]:
        """Where the user stands, and whether that is known."""
        kept = self.upto.get()
        return (Place((kept[0], kept[1]), *kept[2:]), True) if kept else (NOWHERE, False)

    def keep(self, at: Place) -> None:
        self.upto.update((*at.upto, *at[1:]))

    def fold(self, at: Place, until: int, wait: list[tuple], stored: bool) -> tuple[Place, list[tuple]]:
        """The new place, and the rows that events before ``until`` give, of ``wait`` and those that were stored."""
        old = list(map(tuple, self.waiting.get())) if stored else []
        waiting = sorted(old + wait)
        due, rest = [r for r in waiting if r[0] < until], [r for r in waiting if r[0] >= until]
        if rest:
            self.waiting.put(rest)
        elif old:
            self.waiting.clear()
        at = at._replace(oldest=rest[0][0], latest=rest[-1][0]) if rest else at._replace(oldest=NOWHERE.oldest, latest=NOWHERE.latest)
        if not due:
            return at, []
        state, rows = self.take(self.state.get() or self.start, due)
        self.state.update(state)
        return at._replace(upto=due[-1][:2]), rows

    def told(self, key: tuple, rows: list[tuple], late: list[tuple]) -> Iterator[Row]:
        n = len(self.columns) - 1 - len(LATE_COLUMNS)
        made = Row(*self.columns)
        yield from (made(key[0], *r, None, None, None) for r in rows)
        yield from (made(key[0], *[None] * n, *r) for r in late)

    def close(self) -> None:
        pass


class Cell:
    """A value or list of one user in memory, with the calls of the engine's."""

    def __init__(self, value: tuple | list | None = None) -> None:
        self.value = value

    def get(self) -> tuple | list | None:
        return self.value

    def update(self, value: tuple | list | None) -> None:
        self.value = value

    put = update

    def appendList(self, more: list) -> None:  # noqa: N802
        self.value = [*self.value, *more]

    def clear(self) -> None:
        self.value = []


class User:
    """What a shard keeps of one user: the milliseconds at which it was last used, its timer, and its state, which
    an ``InOrder`` takes for its own."""

    def __init__(self, used: int = 0, timer: int | None = None, upto: tuple | None = None, state: tuple | None = None, waiting: Sequence[tuple] = ()) -> None:
        self.used, self.timer = used, timer
        self.kept = {"upto": Cell(upto and tuple(upto)), "state": Cell(state and tuple(state)), "waiting": Cell(list(map(tuple, waiting)))}

    def getValueState(self, name: str, *_) -> Cell:  # noqa: N802
        return self.kept[name]

    getListState = getValueState  # noqa: N815

    def registerTimer(self, at: int) -> None:  # noqa: N802
        self.timer = at


class Shards(StatefulProcessor):
    """``one`` for many users under one key (the shard).

    A group of rows and each call to the state cost more than to fold the events of a user. So a shard reads
    and writes its users as one list, and ``one`` folds them one after another from memory. One timer, at
    least, is set for the first user that has one or whose state has to leave.
    """

    def __init__(self, one: InOrder) -> None:
        self.one = one

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.users = handle.getListState("users", f"user_id bigint, used bigint, timer bigint, upto struct<{PLACE}>, state struct<{self.one.state_schema}>, waiting array<struct<{EVENT}>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, users = timerValues.getCurrentProcessingTimeInMs(), self.known(timerValues)
        before, found = self.due(users), []
        come = pd.concat(rows).sort_values("user_id", kind="stable")
        # a null time or id is an error here, no event that is left out
        events = map(Event, come["us"].astype("int64").tolist(), come["event_id"].astype("int64").tolist(), come["bad"].tolist())
        for user, own in groupby(zip(come["user_id"].tolist(), events, strict=True), itemgetter(0)):
            mine = users.setdefault(user, User())
            mine.used = now
            self.one.init(mine)
            found += self.one.handleInputRows(self.named(key, user), map(itemgetter(1), own), timerValues)
        self.keep(users, before)
        yield from self.told(found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, users, found = timerValues.getCurrentProcessingTimeInMs(), self.known(timerValues), []
        for user, mine in users.items():
            if mine.timer is not None and mine.timer <= now:
                mine.timer, mine.used = None, now
                self.one.init(mine)
                found += self.one.handleExpiredTimer(self.named(key, user), timerValues, expiredTimerInfo)
        self.keep(users, None)
        yield from self.told(found)

    def named(self, key: tuple, user: int) -> tuple:
        return (None if key[0] == NOBODY else user,)

    def known(self, timerValues) -> dict[int, User]:  # noqa: N803
        """The users of the shard, without state that has to leave; what waits stays for its timer."""
        users, left = {}, timerValues.getCurrentProcessingTimeInMs() - self.one.ttl
        for user, used, timer, upto, state, waiting in self.users.get():
            if used > left:
                users[user] = User(used, timer, upto, state, waiting)
            elif waiting:
                users[user] = User(used, timer, waiting=waiting)
        return users

    def due(self, users: dict[int, User]) -> int | None:
        return min((u.used + self.one.ttl if u.timer is None else u.timer for u in users.values()), default=None)

    def keep(self, users: dict[int, User], before: int | None) -> None:
        """Write the users; set a timer if they need one before ``before``, for which one is set."""
        if not users:
            self.users.clear()
            return
        self.users.put([(user, u.used, u.timer, *[u.kept[n].get() for n in ("upto", "state", "waiting")]) for user, u in users.items()])
        first = self.due(users)
        if before is None or first < before:
            self.handle.registerTimer(first)

    def told(self, rows: list[Row]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=self.one.columns, dtype=object)  # whole numbers beside nulls

    def close(self) -> None:
        pass


#: Columns of a late row, null in others.
LATE_COLUMNS = ("late_us", "late_id", "late_bad")


def outcomes(rows: DataFrame) -> DataFrame:
    return rows.select("user_id", F.unix_micros("ts").alias("us"), "event_id", (F.col("event_type") == "error").alias("bad"))


def started(rows: DataFrame, schema: str, processor: InOrder, shards: int = 0) -> DataFrame:
    """The stream of what a processor gives out of ``rows`` (user_id, us, event_id, bad).

    Users have their own keys, of which a small batch touches few, or share as many as ``shards`` says, which a
    batch that holds most users passes far faster.
    """
    # RocksDB alone holds such state; set for the session, as streams that run at once share it
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = f"{schema}, late_us bigint, late_id bigint, late_bad boolean"
    if not shards:
        return rows.groupBy("user_id").transformWithState(processor, schema, "Append", "ProcessingTime")
    # pandas has no whole numbers beside nulls, so that rows without a user have a shard of their own
    shard = F.when(F.col("user_id").isNull(), NOBODY).otherwise(F.pmod(F.xxhash64("user_id"), F.lit(shards)))
    rows = rows.select(shard.alias("shard"), F.coalesce("user_id", F.lit(0)).alias("user_id"), "us", "event_id", "bad")
    return rows.groupBy("shard").transformWithStateInPandas(Shards(processor), schema, "Append", "ProcessingTime")


def in_order(spark: SparkSession, path: str, name: str, schema: str, processor: InOrder) -> DataFrame:
    """The rows that a processor gives out over the whole log.

    Late rows are a part of what the stream writes. Users that have any are folded again from their
    whole log, and these rows replace what the stream gave.
    """
    end = work_path(spark, f"{name}-end")
    log = spark.read.schema(EVENTS).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    last = log.select(F.lit(-1).cast("bigint").alias("event_id"), F.lit(FAR).alias("ts"), "user_id").distinct()
    files = -(-len(log.inputFiles()) // BATCHES)
    users, count = log.agg(F.approx_count_distinct("user_id"), F.count("*")).first()
    shards = max(1, -(-users // USERS), -(-count // ROWS))
    rows = outcomes(events(spark, path, files).unionByName(closing(spark, end)))
    written = drain(started(rows, schema, processor, shards), name, "append", end=(end, last))
    late = work_table(written.where("late_us is not null").select("user_id").distinct(), f"{name}-late")
    out = written.where("late_us is null").drop(*LATE_COLUMNS)
    if not late.limit(1).count():
        return out
    return out.join(late, "user_id", "left_anti").unionByName(replayed(outcomes(log.join(late, "user_id", "left_semi")), schema, processor))


def replayed(rows: DataFrame, schema: str, processor: InOrder) -> DataFrame:
    """What a processor would give of rows (user_id, us, event_id, bad) in their order: a task folds its
    sorted users one after another and holds one state."""
    start, take = processor.start, processor.take

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, state = None, start
        for frame in frames:
            found = []
            for own, mine in frame.groupby("user_id", sort=False, dropna=False):
                if own != user:
                    user, state = own, start
                state, given = take(state, list(zip(mine["us"].tolist(), mine["event_id"].tolist(), mine["bad"].tolist(), strict=True)))
                found += [(own, *r) for r in given]
            yield pd.DataFrame(found, columns=processor.columns[: -len(LATE_COLUMNS)])

    return rows.repartition("user_id").sortWithinPartitions("user_id", "us", "event_id").mapInPandas(run, schema)


class Delay:
    """Times 1.5 while under 0.8 of the last ten succeed, times 0.9 while over 0.95 do, within 1 and 60."""

    SCHEMA, START, COLUMNS = "delay double, n bigint, last array<boolean>", (2.0, 0, []), ("user_id", "delay", "n")

    @staticmethod
    def take(state: tuple, due: list[tuple]) -> tuple[tuple, list[tuple]]:
        delay, n, last = state[0], state[1], list(state[2])
        for _, _, bad in due:
            last = [*last, not bad][-10:]
            share, n = sum(last) / len(last), n + 1
            delay = min(60.0, delay * 1.5) if share < 0.8 else max(1.0, delay * 0.9) if share > 0.95 else delay
        return (delay, n, last), [(delay, n)]


def adaptive_delay(spark: SparkSession, path: str) -> DataFrame:
    """user_id, delay after all outcomes, in the order of their time."""
    found = in_order(spark, path, "stream-delay", "user_id bigint, delay double, n bigint", InOrder(Delay.SCHEMA, Delay.START, Delay.take, Delay.COLUMNS))
    return found.groupBy("user_id").agg(F.max_by("delay", "n").alias("delay"))


def block(minutes: int) -> Take:
    """Events that fall into a block which an error before them opened: blocked-until state."""

    def take(state: tuple, due: list[tuple]) -> tuple[tuple, list[tuple]]:
        until, hit = state[0], []
        for us, event_id, bad in due:
            if us < until:
                hit.append((event_id,))
            if bad:
                until = us + minutes * 60_000_000
        return (until,), hit

    return take


def blocked(spark: SparkSession, path: str, minutes: int = 30) -> DataFrame:
    """event_id of events in a block of their user."""
    return in_order(spark, path, "stream-blocked", "user_id bigint, event_id bigint", InOrder("until bigint", (-1,), block(minutes), ("user_id", "event_id"))).select("event_id")


#: Partitions of the table of users.
SHARDS = 8


def added(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows by user with their numbers added up."""
    return old.unionByName(new).groupBy("user_id", "shard").agg(F.sum("events").alias("events"), F.sum("failures").alias("failures"))


def user_store(spark: SparkSession, path: str, table: StoredTable | None = None) -> StoredTable:
    """Events and failures of each user in a stored table, which each batch adds to once, even if it runs
    again; only the shards of its users are written."""
    schema = "user_id bigint, shard int, events bigint, failures bigint"
    table = table or StoredTable.create(spark.createDataFrame([], schema), work_path(spark, "user-store"), ["shard"])
    rows = events(spark, path).select("user_id", F.pmod("user_id", F.lit(SHARDS)).cast("int").alias("shard"), F.lit(1).cast("bigint").alias("events"), (F.col("event_type") == "error").cast("bigint").alias("failures"))

    def put(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy("user_id", "shard").agg(F.sum("events").alias("events"), F.sum("failures").alias("failures"))
        table.merge(work_table(sums, "user-batch"), "user_id", added, number)

    until_done(rows.writeStream.option("checkpointLocation", f"{table.path}-state").foreachBatch(put), spark)
    return table


def incremental_index(spark: SparkSession, path: str, attempt: Callable[[DataFrame], Column], retries: int = 3) -> DataFrame:
    """event_id, state (done or given up), retry_count of the events that were still to be indexed.

    Each batch picks what has retries left and goes on until all of it is done or given up;
    ``attempt`` tells for a frame of event_id and retry_count which rows succeed.
    """
    todo = events(spark, path).select("event_id", (F.col("event_id") % 5).cast("int").alias("retry_count")).where(F.col("retry_count") < retries)
    out = work_path(spark, "stream-index")

    def index(batch: DataFrame, number: int) -> None:
        left = batch
        for k in range(retries):
            tried = work_table(left.withColumn("ok", attempt(left)), "tried")
            state = F.when(F.col("ok"), "done").when(F.col("retry_count") + 1 >= retries, "given up")
            ended = tried.select("event_id", state.alias("state"), (F.col("retry_count") + F.when(F.col("ok"), 0).otherwise(1)).alias("retry_count")).where("state is not null")
            ended.write.mode("overwrite").parquet(f"{out}/batch={number}/round={k}")
            left = tried.where(~F.col("ok") & (F.col("retry_count") + 1 < retries)).select("event_id", (F.col("retry_count") + 1).alias("retry_count"))

    query = todo.writeStream.option("checkpointLocation", f"{out}-state").trigger(availableNow=True).foreachBatch(index).start()
    query.awaitTermination()
    return spark.read.schema("event_id bigint, state string, retry_count int").parquet(f"{out}/batch=*/round=*")
