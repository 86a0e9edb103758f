"""Structured Streaming jobs. Every job has a batch twin in ``operators``."""

from __future__ import annotations

import uuid
from collections import Counter, deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ledgerlens.operators import ledger, stats
from ledgerlens.operators.sessions import BULK_WAIT, CHAT_LIMIT, COOLDOWN, MULTI_WAIT, OWNER_WAIT, SINGLE_WAIT, USER_LIMIT, WINDOW, _kept_from

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table of a folder as a stream, with the schema of the batch table."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def read_rows(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A folder of parquet files as a stream, at most ``files`` of them a micro-batch."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def event_time(rows: DataFrame, column: str, delay: str) -> DataFrame:
    """Watermarks need an instant; wall clocks of the tables are UTC."""
    return rows.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def run(stream: DataFrame, path: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> None:
    """Process everything available and stop; the checkpoint beside the output makes a rerun continue."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/_job").trigger(availableNow=True)
    query: StreamingQuery = writer.foreachBatch(each).start() if each else writer.format("parquet").start(f"{path}/rows")
    query.awaitTermination()


def _ordered(rows: Iterator[pd.DataFrame], *columns: str) -> list[np.ndarray]:
    """The columns of all of a key's rows of this micro-batch, by time and then by number.

    Rows come in Arrow batches of any order, so they are put in order together, as plain integers.
    """
    parts = [[batch[c].to_numpy("int64") for c in columns] for batch in rows]
    whole = [np.concatenate(x) for x in zip(*parts)]
    order = np.lexsort((whole[1], whole[0]))
    return [x[order] for x in whole]


#: Rows of one output batch, of one waiting piece, and of the pieces put in order at a time.
SLICE, PIECE, AT_ONCE = 10_000, 1 << 15, 1 << 20


def _in_order(rows: np.ndarray) -> np.ndarray:
    return rows[np.lexsort(rows.T[::-1])]


# -- state stores -----------------------------------------------------------------------------


class InOrder(StatefulProcessor):
    """Rows of a key by time and number across micro-batches: they wait until the watermark has passed them.

    ``columns`` are integers and begin with ``at`` (microseconds) and ``seq``. Rows wait in sorted pieces of PIECE rows,
    each one value of the state under its first time, so that a key's rows cost one call a piece and only pieces that are
    due are read. A timer at the time of the first waiting row releases all rows before the watermark, in order; another
    one at ``wakes`` lets idle state go.
    """

    columns = ("at", "seq")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "first long, id string", "rows binary")
        self.setup(handle)

    def setup(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def release(self, key, rows: np.ndarray, mark: int) -> Iterator[pd.DataFrame]:
        """Act on rows in order; ``mark`` is a time in microseconds, which no later row lies before."""
        raise NotImplementedError

    def wakes(self) -> int | None:
        """When, in microseconds, what is remembered of the key can be dropped or closed."""
        raise NotImplementedError

    def _hold(self, rows: np.ndarray) -> None:
        for i in range(0, len(rows), PIECE):
            part = rows[i : i + PIECE]
            self.waiting.updateValue((int(part[0, 0]), uuid.uuid4().hex), (part.tobytes(),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, held, size = None, [], 0
        for batch in rows:
            if not len(batch):
                continue
            held.append(np.column_stack([batch[c].to_numpy("int64") for c in self.columns]))
            size += len(batch)
            at = int(held[-1][:, 0].min())
            first = at if first is None else min(first, at)
            if size >= AT_ONCE:
                self._hold(_in_order(np.concatenate(held)))
                held, size = [], 0
        if held:
            self._hold(_in_order(np.concatenate(held)))
        if first is not None:
            self.handle.registerTimer(first // 1000)
        return iter(())

    def _due(self, due: list[tuple], mark: int) -> Iterator[tuple[np.ndarray, int]]:
        """Rows of the due pieces before ``mark`` in order, some pieces at a time, each with the time the next ones begin at."""
        held, size = [], 0
        for i, piece in enumerate(due):
            rows = np.frombuffer(self.waiting.getValue(piece)[0], "int64").reshape(-1, len(self.columns))
            self.waiting.removeKey(piece)
            passed = int(np.searchsorted(rows[:, 0], mark, side="left"))
            self._hold(rows[passed:])
            held.append(rows[:passed])
            size += passed
            upto = due[i + 1][0] if i + 1 < len(due) else mark
            if size >= AT_ONCE or i + 1 == len(due):
                rows = _in_order(np.concatenate(held))
                ready = int(np.searchsorted(rows[:, 0], upto, side="left"))
                yield rows[:ready], upto
                held, size = [rows[ready:]], 0

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        mark = watermark * 1000
        pieces = sorted(self.waiting.keys()) if self.waiting.exists() else []
        due = [x for x in pieces if x[0] < mark]
        for rows, upto in self._due(due, mark):
            yield from self.release(key, rows, upto)
        if not due:
            yield from self.release(key, np.empty((0, len(self.columns)), "int64"), mark)
        left = [x[0] for x in self.waiting.keys()] if due and self.waiting.exists() else []
        if left:
            self.handle.registerTimer(min(left) // 1000)
        wake = self.wakes()
        if wake is not None and wake // 1000 + 1 > watermark:
            self.handle.registerTimer(wake // 1000 + 1)

    def close(self) -> None:
        pass


class PhotoBatcher(InOrder):
    """Open photo batch of a chat; a timer closes it when its wait has passed."""

    columns = ("at", "seq", "owner", "bulk")

    def setup(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "first long, last long, photos long, wait long")

    def release(self, key, rows, mark):
        state, closed = self.open.get() if self.open.exists() else None, []
        single, multi, own, many = (round(x * 1_000_000) for x in (SINGLE_WAIT, MULTI_WAIT, OWNER_WAIT, BULK_WAIT))
        for at, _, owner, bulk in rows.tolist():
            if state is not None and at - state[1] > state[3]:
                closed.append(state)
                state = None
            photos = 1 if state is None else state[2] + 1
            wait = many if bulk else own if owner else multi if photos > 1 else single
            state = (at if state is None else state[0], at, photos, wait)
        if state is not None and state[1] + state[3] < mark:
            closed.append(state)
            state = None
        if state is not None:
            self.open.update(state)
        elif self.open.exists():
            self.open.clear()
        for i in range(0, len(closed), SLICE):
            part = [(key[0], *x[:3]) for x in closed[i : i + SLICE]]
            yield pd.DataFrame(part, columns=["chat_id", "first_at", "last_at", "photos"])

    def wakes(self):
        state = self.open.get() if self.open.exists() else None
        return None if state is None else state[1] + state[3]


#: Stands for a missing user: photos without one count together.
NOBODY = -(1 << 63)


class OrderedLimiter(InOrder):
    """The rate limit across micro-batches: accepted photos of the last window of a chat, dropped when it has passed."""

    columns = ("at", "seq", "user_id")

    def setup(self, handle: StatefulProcessorHandle) -> None:
        self.accepted = handle.getListState("accepted", "at long, user_id long")

    def release(self, key, rows, mark):
        recent = deque(sorted(self.accepted.get())) if self.accepted.exists() else deque()
        of_user = Counter(user for _, user in recent)
        verdicts = []

        def forget(at):
            while recent and recent[0][0] < at - WINDOW * 1_000_000:
                of_user[recent.popleft()[1]] -= 1

        for at, seq, user in rows.tolist():
            forget(at)
            verdict = "chat_limit" if len(recent) >= CHAT_LIMIT else "user_limit" if of_user[user] >= USER_LIMIT else "accepted"
            if verdict == "accepted":
                recent.append((at, user))
                of_user[user] += 1
            verdicts.append((key[0], seq, verdict))
        forget(mark)
        if recent:
            self.accepted.put(list(recent))
        elif self.accepted.exists():
            self.accepted.clear()
        for i in range(0, len(verdicts), SLICE):
            yield pd.DataFrame(verdicts[i : i + SLICE], columns=["chat_id", "seq", "verdict"])

    def wakes(self):
        return max(self.accepted.get())[0] + WINDOW * 1_000_000 if self.accepted.exists() else None


class Gate(InOrder):
    """Lets an event of a key through if the last one let through lies a gap back; remembers one time for one gap."""

    def __init__(self, keys: tuple[str, ...], gap: int, strict: bool):
        self.keys, self.gap, self.strict = keys, gap, strict

    def setup(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at long")

    def release(self, key, rows, mark):
        last = self.last.get()[0] if self.last.exists() else None
        at = np.ascontiguousarray(rows[:, 0])
        start = 0 if last is None else int(np.searchsorted(at, last + self.gap, side="right" if self.strict else "left"))
        out = rows[_kept_from(at, start, self.gap, self.strict)]
        if len(out):
            last = int(out[-1, 0])
        if last is not None and last + self.gap < mark:  # whatever comes passes
            last = None
        if last is not None:
            self.last.update((last,))
        elif self.last.exists():
            self.last.clear()
        for i in range(0, len(out), SLICE):
            part = out[i : i + SLICE]
            yield pd.DataFrame({**dict(zip(self.keys, ([k] * len(part) for k in key))), "at": part[:, 0], "seq": part[:, 1]})

    def wakes(self):
        return self.last.get()[0] + self.gap if self.last.exists() else None


class PhotoLimiter(StatefulProcessor):
    """Accepted photos of the last window of a chat: at most the chat limit of entries."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.accepted = handle.getListState("accepted", "at long, user_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        recent = deque(sorted((at, user) for at, user in self.accepted.get())) if self.accepted.exists() else deque()
        of_user = Counter(user for _, user in recent)
        verdicts = []
        ats, seqs, users = _ordered(rows, "at", "seq", "user_id")
        for at, seq, user in zip(ats.tolist(), seqs.tolist(), users.tolist()):
            while recent and recent[0][0] < at - WINDOW * 1_000_000:
                of_user[recent.popleft()[1]] -= 1
            if len(recent) >= CHAT_LIMIT:
                verdict = "chat_limit"
            elif of_user[user] >= USER_LIMIT:
                verdict = "user_limit"
            else:
                verdict = "accepted"
                recent.append((at, user))
                of_user[user] += 1
            verdicts.append((key[0], seq, verdict))
            if len(verdicts) == SLICE:
                yield pd.DataFrame(verdicts, columns=["chat_id", "seq", "verdict"])
                verdicts = []
        yield pd.DataFrame(verdicts, columns=["chat_id", "seq", "verdict"])
        self.accepted.put([(int(at), int(user)) for at, user in recent])

    def close(self) -> None:
        pass


class CooldownGate(StatefulProcessor):
    """Last time an event of the key was let through."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        ats, seqs = _ordered(rows, "at", "seq")
        out = []
        for at, seq in zip(ats.tolist(), seqs.tolist()):
            if last is None or at - last >= COOLDOWN * 1_000_000:
                last = at
                out.append((key[0], seq))
        for i in range(0, len(out), SLICE):
            yield pd.DataFrame(out[i : i + SLICE], columns=["chat_id", "seq"])
        if last is not None:
            self.last.update((int(last),))

    def close(self) -> None:
        pass


def _stateful(stream: DataFrame, processor: StatefulProcessor, schema: str, time_mode: str, *keys: str) -> DataFrame:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return stream.groupBy(*(keys or ("chat_id",))).transformWithStateInPandas(processor, schema, "Append", time_mode)


def photo_batch_stream(photos: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Exact photo batches of ``photos(chat_id, ts, at, seq, owner, bulk)``, however the photos are spread over micro-batches."""
    schema = "chat_id long, first_at long, last_at long, photos long"
    timed = event_time(photos, "ts", delay)
    flags = {c: F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in ("owner", "bulk")}
    return _stateful(timed.withColumns(flags), PhotoBatcher(), schema, "EventTime")


def simple_batch_stream(photos: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Photo batches by a per-photo gap, without Python: the part of the rule that ignores batch size."""
    gap = F.when(F.col("bulk"), "12 seconds").when(F.col("owner"), "50 milliseconds").otherwise("3 seconds")
    return event_time(photos, "ts", delay).groupBy("chat_id", F.session_window("ts", gap)).agg(F.count("*").alias("photos"))


def limit_stream(photos: DataFrame) -> DataFrame:
    """Verdicts as in the batch twin; photos of owners are accepted and not counted."""
    if "owner" in photos.columns:
        owned = F.coalesce("owner", F.lit(False))
        exempt = photos.where(owned).select("chat_id", "seq", F.lit("accepted").alias("verdict"))
        return exempt.unionByName(limit_stream(photos.where(~owned).drop("owner")))
    return _stateful(photos, PhotoLimiter(), "chat_id long, seq long, verdict string", "None")


def cooldown_stream(events: DataFrame) -> DataFrame:
    return _stateful(events, CooldownGate(), "chat_id long, seq long", "None")


def ordered_limit_stream(photos: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """``limit_stream`` of ``photos(chat_id, user_id, seq, ts, at)`` that may come in any order within ``delay``."""
    known = event_time(photos, "ts", delay).withColumn("user_id", F.coalesce("user_id", F.lit(NOBODY)))
    return _stateful(known, OrderedLimiter(), "chat_id long, seq long, verdict string", "EventTime")


def ordered_cooldown_stream(events: DataFrame, delay: str = "10 minutes", seconds: int = COOLDOWN) -> DataFrame:
    """``cooldown_stream`` of ``events(chat_id, seq, ts, at)`` in any order within ``delay``; state leaves after the gap."""
    gate = Gate(("chat_id",), seconds * 1_000_000, strict=False)
    return _stateful(event_time(events, "ts", delay), gate, "chat_id long, at long, seq long", "EventTime").drop("at")


def rolling_entry_stream(sightings: DataFrame, delay: str = "1 hour", hours: int = 24) -> DataFrame:
    """Times a code of ``sightings(card, seq, ts)`` enters the rolling list, as in the batch twin, to the second."""
    timed = event_time(sightings, "ts", delay).withColumn("at", F.floor(F.unix_micros("ts") / 1_000_000) * 1_000_000)
    gate = Gate(("card",), hours * 3_600_000_000, strict=True)
    found = _stateful(timed, gate, "card string, at long, seq long", "EventTime", "card")
    return found.select("card", F.timestamp_micros("at").cast("timestamp_ntz").alias("entered_at"))


def sent_notice_stream(notices: DataFrame, delay: str = "1 hour", hours: int = 24) -> DataFrame:
    """Notices of ``notices(chat_id, image_id, seq, ts, at)`` to send: the first of an image of a chat, then once its entry has expired."""
    gate = Gate(("chat_id", "image_id"), hours * 3_600_000_000, strict=False)
    schema = "chat_id long, image_id string, at long, seq long"
    return _stateful(event_time(notices, "ts", delay), gate, schema, "EventTime", "chat_id", "image_id").drop("at")


# -- built-in state ---------------------------------------------------------------------------


def rolling_stream(sightings: DataFrame, hours: int = 24) -> DataFrame:
    """First sighting of a code per rolling day; repeats neither pass nor extend it.

    State leaves when the watermark passes, so a sighting shortly after the day may still be dropped;
    the batch twin is exact.
    """
    return event_time(sightings, "ts", f"{hours} hours").dropDuplicatesWithinWatermark(["card"])


def once_stream(messages: DataFrame, delay: str = "7 days") -> DataFrame:
    """Each (chat, message) once while redeliveries arrive within the delay."""
    return event_time(messages, "ts", delay).dropDuplicatesWithinWatermark(["chat_id", "message_id"])


def high_water_stream(messages: DataFrame) -> DataFrame:
    return messages.groupBy("chat_id").agg(F.max("message_id").alias("message_id"))


def relay_stream(relays: DataFrame, replies: DataFrame, days: int = 30, delay: str = "1 hour") -> DataFrame:
    """Replies joined to their relayed message while it is remembered."""
    left = event_time(relays, "created_at", delay).withColumnRenamed("relay_id", "id")
    right = event_time(replies, "reply_ts", delay)
    alive = F.expr(f"id = relay_id AND reply_ts >= created_at AND reply_ts <= created_at + INTERVAL {days} DAYS")
    return right.join(left, alive)


def daily_window_stream(records: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Images per local day and chat, emitted once when the day has closed."""
    local = event_time(records.withColumn("local_ts", F.col("ts") + F.expr("INTERVAL 8 HOURS")), "local_ts", delay)
    return local.groupBy(F.window("local_ts", "1 day").alias("w"), "chat_id").agg(F.count("*").alias("images")).select(
        F.to_date("w.start").alias("day"), "chat_id", "images"
    )


# -- micro-batch jobs with tables -------------------------------------------------------------


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table another run may have written; empty if none has."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _carried(spark: SparkSession, path: str, epoch: int, schema: str) -> DataFrame:
    """What the micro-batch before this one left in its own folder; the first one finds nothing."""
    return spark.read.schema(schema).parquet(f"{path}/batch={epoch - 1}") if epoch else spark.createDataFrame([], schema)


def high_water_job(path: str) -> Callable[[DataFrame, int], None]:
    """Upsert the chats a micro-batch raised into the table of all chats; each batch writes its own version of it."""

    def upsert(batch: DataFrame, epoch: int) -> None:
        known = _carried(batch.sparkSession, path, epoch, "chat_id long, message_id long")
        merged = known.unionByName(batch.select("chat_id", "message_id")).groupBy("chat_id").agg(F.max("message_id").alias("message_id"))
        merged.write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return upsert


def newest_version(spark: SparkSession, path: str) -> DataFrame:
    """The last version that ``high_water_job`` wrote."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    last = rows.agg(F.max("batch").alias("batch"))
    return rows.join(last, "batch").drop("batch")


def daily_report_job(path: str) -> Callable[[DataFrame, int], None]:
    """Append records by day and publish each day's statistics once a later day has begun.

    A micro-batch may close several days; all that it touches or closes are published, a late record's day anew. Both
    writes are keyed by batch or day: a repeated micro-batch overwrites its own files.
    """

    def publish(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").partitionBy("dt").parquet(f"{path}/records/batch={epoch}")
        last = _carried(spark, f"{path}/newest", epoch, "dt date")  # open until now
        last.unionByName(batch.select("dt")).agg(F.max("dt").alias("dt")).write.mode("overwrite").parquet(f"{path}/newest/batch={epoch}")
        newest = spark.read.parquet(f"{path}/newest/batch={epoch}").first()["dt"]
        if newest is None:
            return
        touched = batch.select("dt").unionByName(last).where("dt IS NOT NULL").distinct()
        days = [r["dt"] for r in touched.where(F.col("dt") < F.lit(newest)).collect()]  # few: days of one micro-batch
        if not days:
            return
        records = spark.read.option("basePath", f"{path}/records").parquet(f"{path}/records/batch=*")
        counts = stats.daily_counts(records.where(F.col("dt").isin(days)))
        counts.withColumn("day", F.col("dt")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{path}/reports")

    return publish


def alert_job(entries: DataFrame, closed: DataFrame, path: str, run_id: str) -> DataFrame:
    """One scheduled alert run: claims are stored before anything is sent, so a rerun sends nothing twice."""
    spark = entries.sparkSession
    sent = stored(spark, path, "chat_id long, accounting_date string")
    due = ledger.overdue_alerts(entries, closed, sent)
    due.withColumn("run_id", F.lit(run_id)).write.mode("append").parquet(path)
    return spark.read.parquet(path).where((F.col("run_id") == run_id) & (F.col("status") == "sending"))


def change_feed_job(path: str) -> Callable[[DataFrame, int], None]:
    """Push rows above the stored version cursor, then move the cursor.

    Files need not come in version order: a row at or below the cursor is late, not old, and is pushed unless an
    earlier batch has pushed the same id and version. Only the part of the feed in the late rows' range is read for that.
    """

    def push(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        cursor = _carried(spark, f"{path}/cursor", epoch, "version long").agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]
        fresh, late = batch.where(F.col("change_version") > cursor), batch.where(F.col("change_version") <= cursor)
        span = late.agg(F.min("change_version").alias("a"), F.max("change_version").alias("z")).first()
        if span["a"] is not None:
            feed = spark.read.option("basePath", f"{path}/feed").parquet(f"{path}/feed/batch=*")
            pushed = feed.where((F.col("batch") < epoch) & F.col("change_version").between(span["a"], span["z"])).select("id", "change_version")
            fresh = fresh.unionByName(late.join(pushed, ["id", "change_version"], "left_anti"))
        fresh.write.mode("overwrite").parquet(f"{path}/feed/batch={epoch}")
        top = fresh.agg(F.greatest(F.max("change_version"), F.lit(cursor)).alias("version"))
        top.write.mode("overwrite").parquet(f"{path}/cursor/batch={epoch}")

    return push
