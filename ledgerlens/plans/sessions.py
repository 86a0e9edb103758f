"""Stateful queries: batch twins, and streams run to the end of the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.codes import split_list
from ledgerlens.operators import ledger, sessions
from ledgerlens.plans.registry import query
from ledgerlens.plans.stats import ALL_IMAGES_SQL
from ledgerlens.session import shared_folder
from ledgerlens.sources.views import Tables
from ledgerlens.streaming import jobs


def _out(t: Tables, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


PHOTO_SQL = """
ph AS (SELECT -(1000 + user_id % 5) AS chat_id, event_id AS seq, user_id, user_id % 50 = 0 AS owner, user_id % 100 = 0 AS bulk,
  TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' SECOND * CAST(floor(event_id * 2 / 5) AS INT) + INTERVAL '1' MILLISECOND * CAST(event_id * 7919 % 380 AS INT) AS ts FROM @events)"""


def photos(t: Tables) -> DataFrame:
    return t.sql(f"WITH {PHOTO_SQL.replace('MILLISECOND', 'SECOND').replace('CAST(event_id * 7919 % 380 AS INT)', '((event_id * 7919 % 380) / 1000.0BD)')} SELECT * FROM ph")


@query(
    "R1_photo_batches",
    f"""WITH {PHOTO_SQL}, l AS (SELECT *, lag(ts) OVER w AS pts, lag(owner) OVER w AS po, lag(bulk) OVER w AS pb FROM ph WINDOW w AS (PARTITION BY chat_id ORDER BY seq)),
    g AS (SELECT *, epoch_us(ts) - epoch_us(pts) AS gap FROM l),
    c AS (SELECT *, CASE WHEN pts IS NULL THEN false WHEN pb THEN gap <= 12000000 WHEN po THEN gap <= 50000 WHEN gap <= 600000 THEN true WHEN gap > 3000000 THEN false END AS clear FROM g),
    s AS (SELECT *, last_value(clear IGNORE NULLS) OVER (PARTITION BY chat_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM c),
    b AS (SELECT *, last_value(CASE WHEN NOT coalesce(clear, held, false) THEN seq END IGNORE NULLS) OVER (PARTITION BY chat_id ORDER BY seq) AS batch_start FROM s)
    SELECT chat_id, batch_start, count(*) AS photos, min(ts) AS first_ts, max(ts) AS last_ts FROM b GROUP BY chat_id, batch_start""",
)
def r1(t: Tables) -> DataFrame:
    return sessions.batch_spans(photos(t))


def bursts(t: Tables) -> DataFrame:
    """Photos of one chat squeezed into bursts that exceed the limits."""
    at = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'") + F.make_dt_interval(
        mins=F.floor(F.col("event_id") / 700).cast("int") * 7, secs=((F.col("event_id") % 700) * F.lit(0.2)).cast("decimal(12,6)")
    )
    return t.events.select((-(F.col("user_id") % 2)).alias("chat_id"), (F.col("user_id") % 3).alias("user_id"), F.col("event_id").alias("seq"), at.alias("ts"))


BURST_SQL = """
b AS (SELECT -(user_id % 2) AS chat_id, user_id % 3 AS user_id, event_id AS seq, event_id // 700 * 420000000 + event_id % 700 * 200000 AS micros, row_number() OVER (PARTITION BY user_id % 2 ORDER BY event_id) AS k FROM @events)"""


@query(
    "R2_rate_limit",
    f"""WITH RECURSIVE {BURST_SQL},
    st AS (SELECT DISTINCT chat_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(m BIGINT, u BIGINT)[]) AS recent, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS verdict FROM b UNION ALL
      SELECT chat_id, k, CASE WHEN verdict = 'accepted' THEN list_append(live, {{'m': micros, 'u': user_id}}) ELSE live END, seq, verdict FROM (
        SELECT *, CASE WHEN len(live) >= {sessions.CHAT_LIMIT} THEN 'chat_limit' WHEN len(list_filter(live, lambda r: r.u = user_id)) >= {sessions.USER_LIMIT} THEN 'user_limit' ELSE 'accepted' END AS verdict
        FROM (SELECT b.*, list_filter(st.recent, lambda r: r.m >= b.micros - {sessions.WINDOW} * 1000000) AS live FROM st JOIN b ON b.chat_id = st.chat_id AND b.k = st.k + 1) AS x) AS y)
    SELECT chat_id, seq, verdict FROM st WHERE k > 0""",
)
def r2(t: Tables) -> DataFrame:
    return sessions.rate_limit(bursts(t))


def kept_sql(rows: str, gap: int) -> str:
    """Kept times of each key of ``e(key, t0)``: from one kept time to the first at least ``gap`` microseconds later."""
    return f"""e AS ({rows}), s AS (SELECT DISTINCT key, t0 FROM e),
    n AS (SELECT key, t0, min(t0) OVER (PARTITION BY key ORDER BY t0 RANGE BETWEEN {gap} FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM s),
    k AS (SELECT key, min(t0) AS t0 FROM s GROUP BY key UNION ALL SELECT n.key, n.nxt FROM k JOIN n ON n.key = k.key AND n.t0 = k.t0 WHERE n.nxt IS NOT NULL)"""


JOINED_SQL = """SELECT -(user_id % 30) AS key, epoch_us(ts) AS t0, event_id AS seq, concat('T', event_id) AS title, user_id FROM @events
    WHERE event_id % 5 <> 0 AND event_id % 4 = 0"""


@query(
    "R3_rolling_distinct",
    f"""WITH RECURSIVE {kept_sql("SELECT card AS key, epoch_us(date_trunc('second', ts)) AS t0 FROM (SELECT ts, short_card AS card FROM rolling_event UNION ALL SELECT ts, concat('hot', user_id % 3) FROM @events) AS x", 86_401_000_000)}
    SELECT key AS card, make_timestamp(t0) AS entered_at FROM k""",
)
def r3(t: Tables) -> DataFrame:
    repeats = t.rolling_event.select("ts", F.col("short_card").alias("card")).unionByName(
        t.events.select("ts", F.concat(F.lit("hot"), (F.col("user_id") % 3).cast("string")).alias("card"))
    )
    return sessions.rolling_distinct(repeats)


@query("R3_rolling_stream", "SELECT DISTINCT short_card AS card FROM rolling_event")
def r3b(t: Tables) -> DataFrame:
    out = _out(t, "rolling")
    source = t.rolling_event.select("ts", F.col("short_card").alias("card"))
    source.write.parquet(f"{out}/input")
    stream = jobs.read_rows(t.spark, f"{out}/input")
    jobs.run(jobs.rolling_stream(stream), out)
    return t.spark.read.parquet(f"{out}/rows").select("card").distinct()


@query(
    "R4_daily_window_stream",
    """SELECT CAST(ts + INTERVAL '8' HOUR AS DATE) AS day, -(1000 + user_id % 5) AS chat_id, count(*) AS images FROM @events
    WHERE CAST(ts + INTERVAL '8' HOUR AS DATE) < (SELECT max(CAST(ts + INTERVAL '8' HOUR - INTERVAL '1' HOUR AS DATE)) FROM @events) GROUP BY ALL""",
)
def r4(t: Tables) -> DataFrame:
    out = _out(t, "daily")
    events = jobs.read_table(t.spark, t.folder, "events").select("ts", (-(F.col("user_id") % 5 + 1000)).alias("chat_id"))
    jobs.run(jobs.daily_window_stream(events), out)
    return t.spark.read.parquet(f"{out}/rows")


@query(
    "R4_daily_report_job",
    f"""WITH {ALL_IMAGES_SQL.replace('audit_delivery', 'audit_record')} SELECT dt, chat_id, user_id, chat_title, username, images, long_codes, short_codes
    FROM daily WHERE dt < (SELECT max(dt) FROM audit_record)""",
)
def r4b(t: Tables) -> DataFrame:
    out = _out(t, "report")
    rows = t.audit_record.withColumn("final_long", split_list(F.col("final_long"))).withColumn("final_short", split_list(F.col("final_short")))
    rows.select("dt", "chat_id", "user_id", "chat_title", "username", "message_id", "file_unique_id", "record_path", "final_long", "final_short").write.parquet(
        f"{out}/input"
    )
    jobs.run(jobs.read_rows(t.spark, f"{out}/input"), out, each=jobs.daily_report_job(out))
    return t.spark.read.option("basePath", f"{out}/reports").parquet(f"{out}/reports").drop("day")


@query(
    "R5_alert_claims",
    """SELECT chat_id, accounting_date, 'sending' AS status FROM (SELECT chat_id, CAST(CAST(created_at AS DATE) AS STRING) AS accounting_date, sum(CASE WHEN kind = 'income' THEN CAST(0 AS DECIMAL(18,2)) ELSE -amount END) AS b
    FROM ledger_input WHERE voided_at IS NULL GROUP BY ALL) AS s WHERE b < 0""",
)
def r5(t: Tables) -> DataFrame:
    zero = F.lit(0).cast("decimal(18,2)")
    entries = t.ledger_input.withColumns({
        "accounting_date": F.date_format("created_at", "yyyy-MM-dd"), "fee_amount": zero, "payable_amount": zero, "payable_usdt": zero, "net_amount": F.col("amount"),
    })
    closed = entries.select("chat_id", "accounting_date").distinct().withColumn("cutoff_at", F.lit(None).cast("timestamp_ntz"))
    out = _out(t, "alerts")
    first = jobs.alert_job(entries, closed, out, "run-1").select("chat_id", "accounting_date", "status")
    again = jobs.alert_job(entries, closed, out, "run-2").select("chat_id", "accounting_date", "status")
    return first.unionByName(again)


COOLED_SQL = kept_sql("SELECT user_id % 7 AS key, event_id AS seq, ts, epoch_us(ts) AS t0 FROM @events", sessions.COOLDOWN * 1_000_000)


@query("R6_cooldown_gate", f"WITH RECURSIVE {COOLED_SQL} SELECT key AS chat_id, min(seq) AS seq, min(ts) AS ts FROM e JOIN k USING (key, t0) GROUP BY key, t0")
def r6(t: Tables) -> DataFrame:
    events = t.events.select((F.col("user_id") % 7).alias("chat_id"), F.col("event_id").alias("seq"), "ts")
    return sessions.cooldown(events, "chat_id")


@query("R6_cooldown_stream", f"WITH RECURSIVE {COOLED_SQL} SELECT key AS chat_id, min(seq) AS seq FROM e JOIN k USING (key, t0) GROUP BY key, t0")
def r6b(t: Tables) -> DataFrame:
    out = _out(t, "cooldown")
    events = jobs.read_table(t.spark, t.folder, "events")
    stream = events.select((F.col("user_id") % 7).alias("chat_id"), F.col("event_id").alias("seq"), sessions.micros(F.col("ts")).alias("at"))
    jobs.run(jobs.cooldown_stream(stream), out)
    return t.spark.read.parquet(f"{out}/rows")


def relays(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    sent = events.select(F.col("event_id").alias("relay_id"), F.col("ts").alias("created_at"), F.col("user_id").alias("target_user"))
    asked = events.select(F.col("event_id").alias("reply_id"), (F.col("event_id") - F.col("event_id") % 4 * 900).alias("relay_id"), F.col("ts").alias("reply_ts"))
    return sent, asked


@query(
    "R7_relay_targets",
    """SELECT r.event_id AS reply_id, s.event_id AS relay_id, s.user_id AS target_user FROM @events AS r JOIN @events AS s ON s.event_id = r.event_id - r.event_id % 4 * 900
    WHERE r.ts >= s.ts AND r.ts <= s.ts + INTERVAL '5' DAY""",
)
def r7(t: Tables) -> DataFrame:
    sent, asked = relays(t.events)
    return sessions.relay_targets(sent, asked, 5).select("reply_id", "relay_id", "target_user")


NOTICE_SQL = kept_sql("SELECT concat('img', user_id % 40) AS key, event_id AS seq, epoch_us(ts) AS t0 FROM @events WHERE event_type <> 'view'", 24 * 3_600_000_000)


@query("R7_sent_notices", f"WITH RECURSIVE {NOTICE_SQL} SELECT key AS image_id, min(seq) AS seq FROM e JOIN k USING (key, t0) GROUP BY key, t0")
def r7b(t: Tables) -> DataFrame:
    image = F.concat(F.lit("img"), (F.col("user_id") % 40).cast("string"))
    notices = t.events.where("event_type <> 'view'").select(image.alias("image_id"), F.col("event_id").alias("seq"), "ts")
    return sessions.sent_notices(notices).select("image_id", "seq")


@query("R8_high_water", "SELECT -(1000 + user_id % 5) AS chat_id, max(event_id) AS message_id FROM @events GROUP BY 1")
def r8(t: Tables) -> DataFrame:
    return sessions.high_water(t.events.select((-(F.col("user_id") % 5 + 1000)).alias("chat_id"), F.col("event_id").alias("message_id")))


@query("R9_once_stream", "SELECT DISTINCT chat_id, message_id FROM ledger_delivery")
def r9(t: Tables) -> DataFrame:
    out = _out(t, "once")
    t.ledger_delivery.select("chat_id", "message_id", "ts", "delivery").write.parquet(f"{out}/input")
    jobs.run(jobs.once_stream(jobs.read_rows(t.spark, f"{out}/input")), out)
    return t.spark.read.parquet(f"{out}/rows").select("chat_id", "message_id")


@query("R10_change_feed", "SELECT id, change_version FROM card_record")
def r10(t: Tables) -> DataFrame:
    out = _out(t, "feed")
    # Several files, one a micro-batch, whose versions overlap.
    t.card_record.select("id", "change_version").repartition(4, "id").write.parquet(f"{out}/input")
    jobs.run(jobs.read_rows(t.spark, f"{out}/input", 1), out, each=jobs.change_feed_job(out))
    return t.spark.read.option("basePath", f"{out}/feed").parquet(f"{out}/feed/batch=*").select("id", "change_version")


@query(
    "R11_joined_chats",
    f"""WITH RECURSIVE {kept_sql(JOINED_SQL, sessions.COOLDOWN * 1_000_000)},
    j AS (SELECT e.key, min(seq) AS seq, arg_min(title, seq) AS title, arg_min(user_id, seq) AS user_id FROM e JOIN k USING (key, t0) GROUP BY e.key, t0),
    a AS (SELECT key, seq, title, user_id, 1 AS joined FROM j UNION ALL SELECT -(user_id % 35), event_id, NULL, user_id, 0 FROM @events WHERE event_id % 9 = 2)
    SELECT key AS chat_id, arg_max(title, seq) FILTER (joined = 1) AS title, arg_min(user_id, seq) FILTER (user_id <> 0) AS owner_id, CAST(sum(joined) AS BIGINT) AS joins FROM a GROUP BY key""",
)
def r11(t: Tables) -> DataFrame:
    kind = F.col("event_id") % 4
    changes = t.events.select(
        (-(F.col("user_id") % 30)).alias("chat_id"), F.col("event_id").alias("seq"), "ts", F.when(F.col("event_id") % 5 == 0, "private").otherwise("supergroup").alias("chat_type"),
        F.when(kind < 2, "left").otherwise("member").alias("old_status"), F.when(kind % 2 == 0, "member").otherwise("kicked").alias("new_status"),
        F.concat(F.lit("T"), F.col("event_id").cast("string")).alias("title"), "user_id",
    )
    additions = t.events.where("event_id % 9 = 2").select((-(F.col("user_id") % 35)).alias("chat_id"), F.col("event_id").alias("seq"), "user_id")
    return sessions.joined_chats(changes, additions)


# -- streams over several files, one a micro-batch, whose rows overlap in time --------------------------


SLICES, STRAY = 4, 120


def _sliced(t: Tables, rows: DataFrame, out: str, name: str = "input") -> DataFrame:
    """``rows`` with a ``seq`` as a stream of SLICES files; some of the last rows of each come a file late."""
    end = rows.agg(F.max("seq").alias("seq")).first()["seq"] or 0
    stray = max(1, min(STRAY, end // 200))
    slices = F.least(F.floor((F.col("seq") + F.col("seq") * 37 % stray) * SLICES / (end + 1)), F.lit(SLICES - 1))
    for i in range(SLICES):  # one after the other: a file source reads by age
        rows.where(slices == i).coalesce(1).write.mode("append").parquet(f"{out}/{name}")
    return jobs.read_rows(t.spark, f"{out}/{name}", 1)


#: What the watermark has passed once all is read: times before the newest less the delay.
PASSED_SQL = "micros // 1000 < (SELECT max(micros) // 1000 - {delay} FROM {rows})"
STEADY_SQL = """
ph AS (SELECT -(1000 + user_id % 5) AS chat_id, event_id AS seq, user_id % 50 = 0 AS owner, user_id % 100 = 0 AS bulk, 1704067200000000 + event_id * 400000 + event_id * 7919 % 380 * 1000 AS micros FROM @events)"""


def steady_photos(t: Tables) -> DataFrame:
    """Photos whose times rise with their numbers, 0.02 to 0.8 seconds apart."""
    at = F.lit(1_704_067_200_000_000) + F.col("event_id") * 400_000 + F.col("event_id") * 7919 % 380 * 1000
    return t.events.select(
        (-(F.col("user_id") % 5 + 1000)).alias("chat_id"), F.col("event_id").alias("seq"), at.alias("at"), F.timestamp_micros(at).alias("ts"),
        (F.col("user_id") % 50 == 0).alias("owner"), (F.col("user_id") % 100 == 0).alias("bulk"),
    )


@query(
    "R1_batch_stream",
    f"""WITH {STEADY_SQL}, l AS (SELECT *, micros - lag(micros) OVER w AS gap, lag(owner) OVER w AS po, lag(bulk) OVER w AS pb FROM ph WINDOW w AS (PARTITION BY chat_id ORDER BY seq)),
    c AS (SELECT *, CASE WHEN gap IS NULL THEN false WHEN pb THEN gap <= 12000000 WHEN po THEN gap <= 50000 WHEN gap <= 600000 THEN true WHEN gap > 3000000 THEN false END AS clear FROM l),
    s AS (SELECT *, last_value(clear IGNORE NULLS) OVER (PARTITION BY chat_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM c),
    b AS (SELECT *, last_value(CASE WHEN NOT coalesce(clear, held, false) THEN seq END IGNORE NULLS) OVER (PARTITION BY chat_id ORDER BY seq) AS start FROM s),
    d AS (SELECT chat_id, start, min(micros) AS first_at, max(micros) AS last_at, count(*) AS photos, CASE WHEN arg_max(bulk, seq) THEN 12000000 WHEN arg_max(owner, seq) THEN 50000 WHEN count(*) > 1 THEN 3000000 ELSE 600000 END AS wait FROM b GROUP BY ALL)
    SELECT chat_id, first_at, last_at, photos FROM d WHERE last_at + wait < ((SELECT max(micros) FROM ph) // 1000 - 120000) * 1000""",
)
def r1s(t: Tables) -> DataFrame:
    out = _out(t, "batches")
    jobs.run(jobs.photo_batch_stream(_sliced(t, steady_photos(t), out), "2 minutes"), out)
    return t.spark.read.parquet(f"{out}/rows")


@query(
    "R2_limit_stream",
    f"""WITH RECURSIVE {BURST_SQL},
    st AS (SELECT DISTINCT chat_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(m BIGINT, u BIGINT)[]) AS recent, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS verdict FROM b UNION ALL
      SELECT chat_id, k, CASE WHEN verdict = 'accepted' THEN list_append(live, {{'m': micros, 'u': user_id}}) ELSE live END, seq, verdict FROM (
        SELECT *, CASE WHEN len(live) >= {sessions.CHAT_LIMIT} THEN 'chat_limit' WHEN len(list_filter(live, lambda r: r.u = user_id)) >= {sessions.USER_LIMIT} THEN 'user_limit' ELSE 'accepted' END AS verdict
        FROM (SELECT b.*, list_filter(st.recent, lambda r: r.m >= b.micros - {sessions.WINDOW} * 1000000) AS live FROM st JOIN b ON b.chat_id = st.chat_id AND b.k = st.k + 1) AS x) AS y)
    SELECT st.chat_id, st.seq, verdict FROM st JOIN b USING (seq) WHERE st.k > 0 AND {PASSED_SQL.format(delay=600_000, rows="b")}""",
)
def r2s(t: Tables) -> DataFrame:
    out = _out(t, "limit")
    stream = _sliced(t, bursts(t).withColumn("at", sessions.micros(F.col("ts"))), out)
    jobs.run(jobs.ordered_limit_stream(stream), out)
    return t.spark.read.parquet(f"{out}/rows")


RETURNING_SQL = kept_sql("SELECT concat('hot', event_id % 40) AS key, epoch_us(date_trunc('second', ts)) AS t0, epoch_us(ts) AS micros FROM @events", 86_401_000_000)


@query(
    "R3_rolling_entries",
    f"WITH RECURSIVE {RETURNING_SQL} SELECT DISTINCT key AS card, make_timestamp(t0) AS entered_at FROM k JOIN e USING (key, t0) WHERE t0 // 1000 < (SELECT max(micros) // 1000 - 43200000 FROM e)",
)
def r3s(t: Tables) -> DataFrame:
    out = _out(t, "entries")
    codes = t.events.select(F.concat(F.lit("hot"), (F.col("event_id") % 40).cast("string")).alias("card"), F.col("event_id").alias("seq"), "ts")
    jobs.run(jobs.rolling_entry_stream(_sliced(t, codes, out), "12 hours"), out)
    return t.spark.read.parquet(f"{out}/rows")


ORDERED_SQL = kept_sql("SELECT user_id % 7 AS key, event_id AS seq, epoch_us(ts) AS t0 FROM @events", sessions.COOLDOWN * 1_000_000)


@query(
    "R6_ordered_cooldown_stream",
    f"""WITH RECURSIVE {ORDERED_SQL} SELECT key AS chat_id, min(seq) AS seq FROM e JOIN k USING (key, t0)
    WHERE t0 // 1000 < (SELECT max(t0) // 1000 - 43200000 FROM e) GROUP BY key, t0""",
)
def r6s(t: Tables) -> DataFrame:
    out = _out(t, "cooldown")
    events = t.events.select((F.col("user_id") % 7).alias("chat_id"), F.col("event_id").alias("seq"), "ts", sessions.micros(F.col("ts")).alias("at"))
    jobs.run(jobs.ordered_cooldown_stream(_sliced(t, events, out), "12 hours"), out)
    return t.spark.read.parquet(f"{out}/rows")


@query(
    "R7_relay_stream",
    """SELECT r.event_id AS reply_id, s.event_id AS relay_id, s.user_id AS target_user FROM @events AS r JOIN @events AS s ON s.event_id = r.event_id - r.event_id % 4 * 900
    WHERE r.ts >= s.ts AND r.ts <= s.ts + INTERVAL '5' DAY""",
)
def r7s(t: Tables) -> DataFrame:
    out = _out(t, "relay")
    sent, asked = relays(t.events)
    left = _sliced(t, sent.withColumn("seq", F.col("relay_id")), out, "sent").drop("seq")
    right = _sliced(t, asked.withColumn("seq", F.col("reply_id")), out, "asked").drop("seq")
    jobs.run(jobs.relay_stream(left, right, 5, "12 hours"), out)
    return t.spark.read.parquet(f"{out}/rows").select("reply_id", "relay_id", "target_user")


STREAMED_NOTICE_SQL = kept_sql("SELECT concat(user_id % 3, '/img', user_id % 40) AS key, user_id % 3 AS chat_id, concat('img', user_id % 40) AS image_id, event_id AS seq, epoch_us(ts) AS t0 FROM @events", 24 * 3_600_000_000)


@query(
    "R7_notice_stream",
    f"""WITH RECURSIVE {STREAMED_NOTICE_SQL} SELECT chat_id, image_id, min(seq) AS seq FROM e JOIN k USING (key, t0)
    WHERE t0 // 1000 < (SELECT max(t0) // 1000 - 43200000 FROM e) GROUP BY chat_id, image_id, t0""",
)
def r7n(t: Tables) -> DataFrame:
    out = _out(t, "notices")
    image = F.concat(F.lit("img"), (F.col("user_id") % 40).cast("string"))
    notices = t.events.select((F.col("user_id") % 3).alias("chat_id"), image.alias("image_id"), F.col("event_id").alias("seq"), "ts", sessions.micros(F.col("ts")).alias("at"))
    jobs.run(jobs.sent_notice_stream(_sliced(t, notices, out), "12 hours"), out)
    return t.spark.read.parquet(f"{out}/rows")


@query("R8_high_water_stream", "SELECT -(1000 + user_id % 5) AS chat_id, max(event_id) AS message_id FROM @events GROUP BY 1")
def r8s(t: Tables) -> DataFrame:
    out = _out(t, "marks")
    seen = t.events.select((-(F.col("user_id") % 5 + 1000)).alias("chat_id"), F.col("event_id").alias("message_id"), F.col("event_id").alias("seq"))
    stream = jobs.high_water_stream(_sliced(t, seen, out))
    jobs.run(stream, out, "update", jobs.high_water_job(f"{out}/table"))
    return jobs.newest_version(t.spark, f"{out}/table")
