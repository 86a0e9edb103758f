"""Stateful operators against brute force, and streams against their batch twins."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import sessions
from ledgerlens.session import shared_folder
from ledgerlens.streaming import jobs

START = datetime(2024, 1, 1)


def _photos(spark, count=900, seed=3, dense=False):
    rng, at, rows = random.Random(seed), 0.0, []
    for seq in range(count):
        at += rng.choice([0.05, 0.3, 0.5, 1.5, 2.5, 4.0, 70.0] if not dense and rng.random() < 0.5 else [0.1, 0.2])
        rows.append((rng.choice([-1, -1, -1, -2]), rng.choice([1, 1, 1, 2, 3]), seq, START + timedelta(microseconds=int(at * 1e6)), rng.random() < 0.05, rng.random() < 0.02))
    return rows, spark.createDataFrame(rows, "chat_id long, user_id long, seq long, ts timestamp_ntz, owner boolean, bulk boolean")


def test_photo_batches_follow_the_waits(spark):
    rows, df = _photos(spark)
    state, want = {}, {}
    for chat, _, seq, ts, owner, bulk in rows:
        first, last, size, wait = state.get(chat, (None, None, 0, 0))
        if first is None or (ts - last).total_seconds() > wait + 1e-9:
            first, size = seq, 0
        size += 1
        wait = sessions.BULK_WAIT if bulk else sessions.OWNER_WAIT if owner else sessions.MULTI_WAIT if size > 1 else sessions.SINGLE_WAIT
        state[chat] = (first, ts, size, wait)
        want[seq] = first
    assert {r["seq"]: r["batch_start"] for r in sessions.photo_batches(df).collect()} == want


def _brute_limit(rows, window, chat_limit, user_limit):
    seen, verdicts = defaultdict(list), {}
    for chat, user, seq, ts, owner, _ in rows:
        if owner:  # neither limited nor counted
            verdicts[seq] = "accepted"
            continue
        recent = [x for x in seen[chat] if x[0] >= ts - timedelta(seconds=window)]
        if len(recent) >= chat_limit:
            verdicts[seq] = "chat_limit"
        elif sum(1 for _, u in recent if u == user) >= user_limit:
            verdicts[seq] = "user_limit"
        else:
            verdicts[seq] = "accepted"
            recent.append((ts, user))
        seen[chat] = recent
    return verdicts


@pytest.mark.parametrize("limits", [(60, 80, 50), (10, 8, 5), (5, 4, 4)])
def test_rate_limit_equals_the_ordered_walk(spark, limits):
    rows, df = _photos(spark, 1200, 11)
    got = {r["seq"]: r["verdict"] for r in sessions.rate_limit(df, *limits).collect()}
    want = _brute_limit(rows, *limits)
    assert got == want
    if limits[0] < 60:
        assert len(set(want.values())) == 3 or limits[1] == limits[2]


def test_cooldown_and_rolling_list(spark):
    rows, df = _photos(spark, 600, 5)
    last, want = {}, set()
    for chat, _, seq, ts, *_ in rows:
        if chat not in last or ts - last[chat] >= timedelta(seconds=300):
            last[chat] = ts
            want.add(seq)
    assert {r["seq"] for r in sessions.cooldown(df, "chat_id").collect()} == want
    cards = spark.createDataFrame([("a", START), ("a", START + timedelta(hours=23)), ("a", START + timedelta(hours=24)), ("a", START + timedelta(hours=24, seconds=1)), ("b", START)], "card string, ts timestamp_ntz")
    got = {(r["card"], r["entered_at"]) for r in sessions.rolling_distinct(cards).collect()}
    assert got == {("a", START), ("a", START + timedelta(hours=24, seconds=1)), ("b", START)}


def _stream_of(spark, df, name, parts=1):
    folder = f"{shared_folder(spark)}/test-{name}-{random.randrange(1 << 60):x}"
    df.coalesce(parts).write.parquet(f"{folder}/input")
    return folder, jobs.read_rows(spark, f"{folder}/input")


def test_limit_and_cooldown_streams_equal_batch(spark):
    rows, df = _photos(spark, 500, 17, dense=True)
    timed = df.withColumn("at", sessions.micros(F.col("ts"))).withColumn("user_id", F.lit(1).cast("long"))
    folder, stream = _stream_of(spark, timed, "limit")
    jobs.run(jobs.limit_stream(stream.select("chat_id", "user_id", "seq", "at", "owner")), folder)
    got = {r["seq"]: r["verdict"] for r in spark.read.parquet(f"{folder}/rows").collect()}
    assert got == {r["seq"]: r["verdict"] for r in sessions.rate_limit(timed).collect()}
    assert "user_limit" in got.values()
    folder, stream = _stream_of(spark, timed, "cool")
    jobs.run(jobs.cooldown_stream(stream.select("chat_id", "seq", "at")), folder)
    assert {r["seq"] for r in spark.read.parquet(f"{folder}/rows").collect()} == {r["seq"] for r in sessions.cooldown(df, "chat_id").collect()}


def test_photo_batch_stream_equals_closed_batches(spark):
    rows, df = _photos(spark, 300, 23)
    timed = df.withColumn("at", sessions.micros(F.col("ts"))).select("chat_id", "ts", "at", "seq", "owner", "bulk")
    folder, stream = _stream_of(spark, timed, "batches")
    jobs.run(jobs.photo_batch_stream(stream), folder)
    got = {(r["chat_id"], r["first_at"], r["photos"]) for r in spark.read.parquet(f"{folder}/rows").collect()}
    spans = sessions.batch_spans(df).select("chat_id", sessions.micros(F.col("first_ts")).alias("first_at"), "photos", sessions.micros(F.col("last_ts")).alias("last_at")).collect()
    assert got <= {(r["chat_id"], r["first_at"], r["photos"]) for r in spans}
    newest = max(r["last_at"] for r in spans)
    closed = {(r["chat_id"], r["first_at"], r["photos"]) for r in spans if r["last_at"] < newest - 30_000_000}
    assert closed <= got


def test_relay_stream_equals_batch(spark):
    from ledgerlens.plans.sessions import relays

    events = spark.range(400).select(F.col("id").alias("event_id"), (F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("ts"), (F.col("id") % 9).alias("user_id"))
    sent, asked = relays(events)
    asked = asked.withColumn("relay_id", F.col("reply_id") - F.col("reply_id") % 4 * 30)
    folder, left = _stream_of(spark, sent, "sent")
    _, right = _stream_of(spark, asked, "asked")
    jobs.run(jobs.relay_stream(left, right, 3), folder)
    got = {(r["reply_id"], r["target_user"]) for r in spark.read.parquet(f"{folder}/rows").collect()}
    assert got == {(r["reply_id"], r["target_user"]) for r in sessions.relay_targets(sent, asked, 3).collect()} and got


def test_change_feed_pushes_each_version_once(spark):
    folder, stream = _stream_of(spark, spark.range(100).select("id", (F.col("id") + 1).alias("change_version")), "feed", 1)
    jobs.run(stream, folder, each=jobs.change_feed_job(folder))
    spark.range(50, 150).select("id", (F.col("id") + 1).alias("change_version")).coalesce(1).write.mode("append").parquet(f"{folder}/input")
    jobs.run(jobs.read_rows(spark, f"{folder}/input"), folder, each=jobs.change_feed_job(folder))
    rows = spark.read.option("basePath", f"{folder}/feed").parquet(f"{folder}/feed/batch=*")
    assert rows.count() == 150 and rows.select("id").distinct().count() == 150


def _walk(times, gap, strict):
    kept = []
    for at in sorted(set(times)):
        if not kept or (at - kept[-1] > gap if strict else at - kept[-1] >= gap):
            kept.append(at)
    return kept


@pytest.mark.parametrize("strict, block", [(False, 16), (True, 16), (False, 1 << 16)])
def test_gap_folds_in_blocks_equal_the_walk(spark, strict, block):
    rng, rows = random.Random(9), []
    shapes = {
        "steady": [i * 7 for i in range(250)],  # never idle, many steps a block
        "dense": [rng.randint(0, 700) for _ in range(400)],  # a step jumps over blocks
        "mixed": [i * 40 + rng.choice([0, 1, 30, 100]) for i in range(60)] + [90_000, 90_001, 90_100, 190_000],
        "ties": [100 * i for i in range(50)] + [100 * i + 1 for i in range(50)], "one": [5], "far": [0, 10**12, 2 * 10**12],
    }
    for key, times in shapes.items():
        rows += [(key, at) for at in times * 2]
    got = defaultdict(list)
    for r in sessions._spaced(spark.createDataFrame(rows, "key string, at long"), "key", 100, strict, block).collect():
        got[r["key"]].append(r["at"])
    assert {k: sorted(v) for k, v in got.items()} == {k: _walk(v, 100, strict) for k, v in shapes.items()}


def test_exits_follow_the_walk_out_of_a_block():
    import numpy as np

    at = np.array(sorted(random.Random(1).sample(range(2000), 300)))
    for strict in (False, True):
        for start, asked in enumerate(sessions._exits(at, 50, strict)):
            assert asked == at[sessions._kept_from(at, start, 50, strict)[-1]] + 50


@pytest.mark.parametrize("rounds, limits, dense", [(0, (20, 30, 12), True), (4, (10, 8, 5), False)])
def test_rate_limit_in_parts_equals_the_ordered_walk(spark, monkeypatch, rounds, limits, dense):
    monkeypatch.setattr(sessions, "ROUNDS", rounds)
    rows, df = _photos(spark, 400, 5, dense)
    got = {r["seq"]: r["verdict"] for r in sessions.rate_limit(df, *limits, block=64).collect()}
    assert got == _brute_limit(rows, *limits)
    assert set(got.values()) == {"accepted", "chat_limit", "user_limit"}


def _run_with_progress(stream, path):
    """Run to the end; rows of state before and after, by the last progress."""
    query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{path}/_job").trigger(availableNow=True).format("parquet").start(f"{path}/rows")
    query.awaitTermination()
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def test_state_leaves_with_the_watermark(spark):
    """Two keys and then silence of theirs: what they left in the state is gone when the watermark has passed."""
    at = [1, 2, 3, 400, 401]
    busy = [(chat, s * 1_000_000 + chat, s * 10 + chat, "img") for s in at for chat in (1, 2)]
    late = [(9, 100_000 * 1_000_000, 99, "img")]
    kind = "chat_id long, at long, seq long, image_id string"
    for make in (lambda x: jobs.ordered_cooldown_stream(x, "1 second"), lambda x: jobs.sent_notice_stream(x, "1 second", 1)):
        folder = f"{shared_folder(spark)}/test-state-{random.randrange(1 << 60):x}"
        for part in (busy[:6], busy[6:], late):
            rows = spark.createDataFrame(part, kind).withColumns({"ts": F.timestamp_micros("at"), "user_id": F.lit(1).cast("long")})
            rows.coalesce(1).write.mode("append").parquet(f"{folder}/input")
        left = _run_with_progress(make(jobs.read_rows(spark, f"{folder}/input", 1)), folder)
        rows = spark.read.parquet(f"{folder}/rows")
        assert rows.where("chat_id < 9").count() >= 2
        assert left[-1] < max(left)
        # Only the waiting row of the last chat and its timer are left.
        assert left[-1] <= 4


def test_daily_job_closes_days_across_batches(spark):
    from datetime import date

    folder = f"{shared_folder(spark)}/test-days-{random.randrange(1 << 60):x}"
    days = [[1, 1], [2, 4], [1], [5]]  # one list a micro-batch; the third is late
    n = 0
    for batch in days:
        rows = [(date(2024, 1, d), 1, 7, "t", "u", n := n + 1, f"f{n}", f"r{n}", ["L"], []) for d in batch]
        schema = "dt date, chat_id long, user_id long, chat_title string, username string, message_id long, file_unique_id string, record_path string, final_long array<string>, final_short array<string>"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/input")
        jobs.run(jobs.read_rows(spark, f"{folder}/input", 1), folder, each=jobs.daily_report_job(folder))
        done = spark.read.option("basePath", f"{folder}/reports").parquet(f"{folder}/reports").groupBy("dt").agg(F.sum("images").alias("n")).collect() if batch != [1, 1] else []
    assert {r["dt"].day: r["n"] for r in done} == {1: 3, 2: 1, 4: 1}


def test_high_water_and_feed_go_on_after_a_restart(spark):
    folder = f"{shared_folder(spark)}/test-marks-{random.randrange(1 << 60):x}"
    for ids in ([1, 2, 3], [8], [5, 2]):
        spark.createDataFrame([(i % 2, i) for i in ids], "chat_id long, message_id long").coalesce(1).write.mode("append").parquet(f"{folder}/input")
        jobs.run(jobs.high_water_stream(jobs.read_rows(spark, f"{folder}/input", 1)), folder, "update", jobs.high_water_job(f"{folder}/table"))
    assert {tuple(r) for r in jobs.newest_version(spark, f"{folder}/table").collect()} == {(0, 8), (1, 5)}
    feed = f"{shared_folder(spark)}/test-late-{random.randrange(1 << 60):x}"
    for versions in ([5, 6], [1, 2], [2, 7], [6, 8]):  # late ones once, whatever the batch before them held
        spark.createDataFrame([(v, v) for v in versions], "id long, change_version long").coalesce(1).write.mode("append").parquet(f"{feed}/input")
        jobs.run(jobs.read_rows(spark, f"{feed}/input", 1), feed, each=jobs.change_feed_job(feed))
    rows = spark.read.option("basePath", f"{feed}/feed").parquet(f"{feed}/feed/batch=*")
    assert sorted(r["change_version"] for r in rows.collect()) == [1, 2, 5, 6, 7, 8]


@pytest.mark.parametrize("make", [
    lambda x: jobs.ordered_cooldown_stream(x, "1 second"), lambda x: jobs.ordered_limit_stream(x, "1 second"),
    lambda x: jobs.sent_notice_stream(x, "1 second"), lambda x: jobs.photo_batch_stream(x, "1 second"),
])
def test_waiting_rows_are_few_values_of_the_state(spark, make):
    """Rows of one chat and image that the watermark has not passed yet: a piece and its timers, not a value a row."""
    rows = spark.range(3000).select(
        F.lit(1).cast("long").alias("chat_id"), F.lit("img").alias("image_id"), F.col("id").alias("seq"), (F.col("id") * 100).alias("at"), F.lit(5).cast("long").alias("user_id"),
        F.lit(False).alias("owner"), F.lit(False).alias("bulk"), F.timestamp_micros(F.col("id") * 100).alias("ts"),
    )
    folder, stream = _stream_of(spark, rows, "pieces")
    assert max(_run_with_progress(make(stream), folder)) <= 4


class _Values(dict):
    """State of one key, in memory."""

    exists, keys = (lambda self: bool(self)), (lambda self: iter(list(dict.keys(self))))
    get = lambda self: self["v"]
    update = put = lambda self, v: self.__setitem__("v", v)
    getValue, updateValue, removeKey = dict.__getitem__, dict.__setitem__, dict.__delitem__


class _Handle:
    def __init__(self):
        self.timers = set()

    def getMapState(self, *_):
        return _Values()

    getValueState = getListState = getMapState

    def registerTimer(self, at):
        self.timers.add(at)


@pytest.mark.parametrize("piece, at_once", [(4, 16), (32, 8), (1 << 15, 1 << 20)])
@pytest.mark.parametrize("strict", [False, True])
def test_pieces_are_released_in_order(monkeypatch, piece, at_once, strict):
    """Rows in any order, in pieces that overlap and straddle the watermark, give the walk over them all."""
    import pandas as pd

    monkeypatch.setattr(jobs, "PIECE", piece)
    monkeypatch.setattr(jobs, "AT_ONCE", at_once)
    rng = random.Random(piece)
    times = [rng.randrange(400) * 500 for _ in range(500)]  # ties, half milliseconds
    gate, handle, got = jobs.Gate(("chat_id",), 3_000, strict), _Handle(), []
    gate.init(handle)
    rows = sorted(((at, i) for i, at in enumerate(times)), key=lambda x: x[0] + rng.randrange(20_000))

    class Mark:
        def __init__(self, at):
            self.getCurrentWatermarkInMs = lambda: at

    seen = 0
    for i in range(0, len(rows), 125):
        part = pd.DataFrame(rows[i : i + 125], columns=["at", "seq"])
        list(gate.handleInputRows((1,), iter([part[:50], part[50:]]), None))
        seen = max(seen, part["at"].max())
        mark = (seen - 20_000) // 1000 if i + 125 < len(rows) else 10**6
        for at in sorted(t for t in handle.timers if t <= mark):
            handle.timers.discard(at)
            for frame in gate.handleExpiredTimer((1,), Mark(mark), None):
                got += frame[["at", "seq"]].values.tolist()
    first = {at: min(i for i, t in enumerate(times) if t == at) for at in times}
    assert got == [[at, first[at]] for at in _walk(times, 3_000, strict)]
    assert not gate.waiting and not gate.last


def test_short_blocks_leave_together():
    """Keys with a row or two each cost no batch of their own; blocks that span batches stay whole."""
    import pandas as pd

    rows = [(f"k{i}", i, 0, i) for i in range(500)] + [("m", 1000, 0, 1000 + j * 30) for j in range(40)] + [("n", 1000, b, 1000 + b) for b in range(3)]
    whole = pd.DataFrame(rows, columns=["key", "stretch", "block", "at"])
    batches = [whole[i : i + 130].reset_index(drop=True) for i in range(0, len(whole), 130)]
    frames = list(sessions._keep(iter(batches), 100, False))
    assert len(frames) <= len(batches) + 1
    got = defaultdict(list)
    for key, at in (x for f in frames for x in f.values.tolist()):
        got[key].append(at)
    assert got["m"] == _walk([1000 + j * 30 for j in range(40)], 100, False) and got["n"] == [1000, 1001, 1002]
    assert all(got[f"k{i}"] == [i] for i in range(500))
    asked = pd.concat(list(sessions._ask(iter(batches), 100, False)))
    assert len(asked) == len(whole) and asked["asked"].iloc[0] == 100
