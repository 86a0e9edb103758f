"""Audit-record queries: scans, windows, deduplication, daily statistics, repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.codes import split_list
from ledgerlens.operators import stats
from ledgerlens.plans.registry import query
from ledgerlens.sources.views import Tables

IMAGES_SQL = """
img AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dt, chat_id, message_id, file_unique_id ORDER BY record_path) AS r
        FROM audit_delivery WHERE user_id % 13 <> 5) AS x WHERE r = 1),
codes AS (SELECT dt, chat_id, user_id, record_path, 'long' AS code_type, unnest(split(final_long, ',')) AS code, generate_subscripts(split(final_long, ','), 1) AS pos FROM img
          UNION ALL SELECT dt, chat_id, user_id, record_path, 'short', unnest(split(final_short, ',')), generate_subscripts(split(final_short, ','), 1) FROM img),
credit AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dt, code_type, upper(trim(code)) ORDER BY record_path, pos) AS r FROM codes WHERE trim(code) <> '') AS x WHERE r = 1),
c AS (SELECT dt, chat_id, user_id, count(*) FILTER (code_type = 'long') AS l, count(*) FILTER (code_type = 'short') AS s FROM credit GROUP BY ALL),
g AS (SELECT dt, chat_id, user_id, min_by(chat_title, record_path) AS chat_title, min_by(username, record_path) AS username, count(*) AS images FROM img GROUP BY dt, chat_id, user_id),
daily AS (SELECT g.*, coalesce(l, 0) AS long_codes, coalesce(s, 0) AS short_codes FROM g LEFT JOIN c ON c.dt = g.dt AND c.chat_id = g.chat_id AND c.user_id = g.user_id)"""

ALL_IMAGES_SQL = IMAGES_SQL.replace(" WHERE user_id % 13 <> 5", "")


def audit_rows(t: Tables, name: str = "audit_delivery") -> DataFrame:
    rows = getattr(t, name)
    return rows.withColumn("final_long", split_list(F.col("final_long"))).withColumn("final_short", split_list(F.col("final_short")))


def daily(t: Tables) -> DataFrame:
    rows = audit_rows(t)
    skipped = t.events.where(F.col("user_id") % 13 == 5).select("user_id").distinct()
    return stats.daily_counts(stats.exclude_users(rows, skipped))


@query("A2_daily_stats", f"WITH {IMAGES_SQL} SELECT dt, chat_id, user_id, chat_title, username, images, long_codes, short_codes FROM daily")
def a2(t: Tables) -> DataFrame:
    return daily(t)


@query("T2_report_order", f"WITH {ALL_IMAGES_SQL} SELECT dt, chat_title, username, images FROM daily ORDER BY dt, lower(chat_title), lower(username), chat_id, user_id")
def t2(t: Tables) -> DataFrame:
    return stats.report_order(stats.daily_counts(audit_rows(t))).select("dt", "chat_title", "username", "images")


@query(
    "A2_rollup",
    f"""WITH {ALL_IMAGES_SQL} SELECT dt, chat_id, CAST(sum(images) AS BIGINT) AS images, CAST(sum(long_codes) AS BIGINT) AS long_codes, CAST(sum(short_codes) AS BIGINT) AS short_codes
    FROM daily GROUP BY GROUPING SETS ((dt, chat_id), (dt))""",
)
def a2b(t: Tables) -> DataFrame:
    return stats.rolled_up(stats.daily_counts(audit_rows(t)))


@query("A3_chat_view", f"WITH {IMAGES_SQL} SELECT dt, user_id, username, images, long_codes, short_codes FROM daily WHERE chat_id = -1002 AND images > 0")
def a3(t: Tables) -> DataFrame:
    rows = audit_rows(t)
    skipped = t.events.where(F.col("user_id") % 13 == 5).select("user_id").distinct()
    shown = stats.daily_counts(stats.exclude_users(rows, skipped)).where((F.col("chat_id") == -1002) & (F.col("images") > 0))
    return shown.select("dt", "user_id", "username", "images", "long_codes", "short_codes")


@query("W2_unique_images", f"WITH {ALL_IMAGES_SQL} SELECT record_path, dt, chat_id, user_id FROM img")
def w2(t: Tables) -> DataFrame:
    return stats.unique_images(t.audit_delivery).select("record_path", "dt", "chat_id", "user_id")


@query("W3_first_credit", f"WITH {ALL_IMAGES_SQL} SELECT dt, code_type, upper(trim(code)) AS code, record_path, user_id FROM credit")
def w3(t: Tables) -> DataFrame:
    images = stats.unique_images(audit_rows(t))
    return stats.first_credit(stats.code_rows(images)).select("dt", "code_type", "code", "record_path", "user_id")


@query("P5_exclude_users", "SELECT message_id, user_id FROM audit_record WHERE user_id NOT IN (SELECT user_id FROM @events WHERE user_id % 13 = 5)")
def p5(t: Tables) -> DataFrame:
    skipped = t.events.where(F.col("user_id") % 13 == 5)
    return stats.exclude_users(t.audit_record, skipped).select("message_id", "user_id")


@query(
    "P3_time_window",
    "SELECT message_id FROM audit_record WHERE ts + INTERVAL '8' HOUR >= TIMESTAMP '2024-01-03 12:00:00' AND ts + INTERVAL '8' HOUR <= TIMESTAMP '2024-01-09 18:30:00'",
)
def p3(t: Tables) -> DataFrame:
    # Local bounds shifted to UTC, so the range reaches the scan.
    start, end = (F.expr(f"TIMESTAMP_NTZ '{at}' - INTERVAL 8 HOURS") for at in ("2024-01-03 12:00:00", "2024-01-09 18:30:00"))
    return stats.in_window(t.audit_record, F.col("ts"), start, end).select("message_id")


@query(
    "P4_time_range_commands",
    """WITH c AS (SELECT event_id, ts, date_trunc('day', ts + INTERVAL '8' HOUR) AS d, ts + INTERVAL '8' HOUR AS now, event_id % 8 AS k,
      lpad(CAST(user_id % 26 AS STRING), 2, '0') AS h, lpad(CAST(event_id % 60 AS STRING), 2, '0') AS m, CAST(user_id % 26 AS INT) AS hi, CAST(event_id % 60 AS INT) AS mi FROM @events),
    r AS (SELECT *, d + INTERVAL '1' HOUR * hi + INTERVAL '1' MINUTE * mi AS a, d + INTERVAL '18' HOUR AS b, hi > 23 AS badh FROM c),
    e AS (SELECT *, CASE WHEN k = 7 THEN 'bad_format' WHEN k = 6 THEN 'bad_format' WHEN k IN (0, 5) THEN NULL WHEN badh THEN 'bad_format'
       WHEN a > now THEN 'start_after_now' WHEN k IN (2, 4) AND b > now THEN 'end_after_now' WHEN k IN (2, 4) AND b <= a THEN 'end_not_after_start' WHEN k IN (1, 3) AND now <= a THEN 'end_not_after_start' END AS error FROM r)
    SELECT event_id, error, CASE WHEN error IS NULL THEN CASE WHEN k IN (0, 5) THEN d ELSE a END END AS start_at,
      CASE WHEN error IS NULL THEN CASE WHEN k IN (2, 4) THEN b ELSE now END END AS end_at FROM e""",
)
def p4(t: Tables) -> DataFrame:
    clock = F.concat(F.lpad((F.col("user_id") % 26).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.col("event_id") % 60).cast("string"), 2, "0"))
    kind = F.col("event_id") % 8
    text = (
        F.when(kind == 0, "/统计").when(kind == 1, F.concat(F.lit("/统计"), clock)).when(kind == 2, F.concat(F.lit("/统计"), clock, F.lit("-18:00")))
        .when(kind == 3, F.concat(F.lit("/统计@bot "), clock)).when(kind == 4, F.concat(F.lit(" /统计 "), clock, F.lit(" - 18:00")))
        .when(kind == 5, "/统计@bot").when(kind == 6, "/统计1:00-2:00-3:00").otherwise("统计12:00")
    )
    return stats.parse_ranges(t.events.select("event_id", "ts", text.alias("text"))).drop("ts", "text")


@query(
    "F10_record_time",
    """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN date_trunc('second', ts) WHEN event_id % 4 = 1 THEN date_trunc('second', ts) + INTERVAL '1' HOUR
    WHEN event_id % 4 = 2 AND event_id % 60 < 50 THEN CAST(ts AS DATE) + INTERVAL '9' HOUR + INTERVAL '30' MINUTE + INTERVAL '1' SECOND * CAST(event_id % 60 AS INT) END AS at FROM @events""",
)
def f10(t: Tables) -> DataFrame:
    kind, shape = F.col("event_id") % 4, "yyyy-MM-dd HH:mm:ss"
    second = F.col("event_id") % 60
    rows = t.events.select(
        "event_id", "ts", F.when(kind == 0, F.date_format("ts", shape)).when(kind == 1, "not a time").alias("message_text"),
        F.when(kind == 1, F.date_format(F.col("ts") + F.expr("INTERVAL 1 HOUR"), shape)).alias("created_text"),
        F.when(kind == 2, F.concat(F.lit("0930"), F.when(second < 50, F.lpad(second.cast("string"), 2, "0")).otherwise("75"), F.lit("_1_x")))
        .otherwise("plain").alias("folder"),
    )
    at = stats.record_time(F.col("message_text"), F.col("created_text"), F.col("folder"), F.to_date("ts"))
    return rows.select("event_id", at.alias("at"))


@query(
    "S2_latest_phase",
    """SELECT chat_id, message_id, file_unique_id, status, final_long FROM (SELECT *, row_number() OVER (PARTITION BY chat_id, message_id, file_unique_id ORDER BY phase_ts DESC) AS r FROM audit_phase) AS x WHERE r = 1""",
)
def s2(t: Tables) -> DataFrame:
    return stats.latest_phase(t.audit_phase).select("chat_id", "message_id", "file_unique_id", "status", "final_long")


@query(
    "W4_later_sightings",
    """SELECT chat_id, code_type, code, dt, message_id, first_ts, first_username FROM (SELECT *, row_number() OVER w AS r, first_value(ts) OVER w AS first_ts, first_value(username) OVER w AS first_username
    FROM code_sighting WINDOW w AS (PARTITION BY chat_id, code_type, code, dt ORDER BY message_id)) AS x WHERE r > 1""",
)
def w4(t: Tables) -> DataFrame:
    later = stats.later_sightings(t.code_sighting, ["chat_id", "code_type", "code", "dt"], "message_id")
    return later.select("chat_id", "code_type", "code", "dt", "message_id", "first_ts", "first_username")


@query(
    "W5_duplicate_flag",
    """SELECT id, NOT is_deleted AND final_card <> '' AND coalesce(sum(CASE WHEN NOT is_deleted AND final_card <> '' THEN 1 ELSE 0 END)
    OVER (PARTITION BY lower(final_card), CAST(message_date + INTERVAL '8' HOUR AS DATE)), 0) > 1 AS is_duplicate FROM card_record""",
)
def w5(t: Tables) -> DataFrame:
    return stats.flag_duplicates(t.card_record).select("id", "is_duplicate")


def occurrences(t: Tables) -> DataFrame:
    rows = stats.code_rows(audit_rows(t, "audit_record"))
    return rows.select(
        "batch_id", "code_type", "code", (F.col("message_id") % 3 + 1).alias("image_index"),
        (F.col("message_id") * 8 + F.col("pos") + F.when(F.col("code_type") == "short", 4).otherwise(0)).alias("sort_id"),
    )


OCC_SQL = """
o AS (SELECT batch_id, code_type, code, message_id % 3 + 1 AS image_index, message_id * 8 + pos - 1 + CASE WHEN code_type = 'short' THEN 4 ELSE 0 END AS sort_id FROM (
  SELECT batch_id, message_id, 'long' AS code_type, unnest(split(final_long, ',')) AS code, generate_subscripts(split(final_long, ','), 1) AS pos FROM audit_record
  UNION ALL SELECT batch_id, message_id, 'short', unnest(split(final_short, ',')), generate_subscripts(split(final_short, ','), 1) FROM audit_record) AS u WHERE code <> ''),
f AS (SELECT *, row_number() OVER w AS r, first_value(image_index) OVER w AS first_image, count(*) OVER (PARTITION BY batch_id, code_type, code) AS shown FROM o WINDOW w AS (PARTITION BY batch_id, code_type, code ORDER BY sort_id))"""


@query(
    "W6_batch_output",
    f"WITH {OCC_SQL} SELECT batch_id, code_type, code, image_index, shown, row_number() OVER (PARTITION BY batch_id, code_type ORDER BY sort_id) AS line_no FROM f WHERE r = 1",
)
def w6(t: Tables) -> DataFrame:
    return stats.batch_output(occurrences(t)).select("batch_id", "code_type", "code", "image_index", "shown", "line_no")


@query("W6_batch_repeats", f"WITH {OCC_SQL} SELECT batch_id, code_type, code, first_image, image_index AS later_image, sort_id FROM f WHERE r > 1")
def w6b(t: Tables) -> DataFrame:
    return stats.batch_repeats(occurrences(t))


@query(
    "W12_numbered_codes",
    """WITH l AS (SELECT message_id, raw_text, status, CASE WHEN final_long = '' THEN [] ELSE split(final_long, ',') END AS a, CASE WHEN final_short = '' THEN [] ELSE split(final_short, ',') END AS s,
      CASE WHEN raw_long = '' THEN [] ELSE split(raw_long, ',') END AS raw FROM audit_record),
    n AS (SELECT message_id, unnest(a || s) AS final_card, generate_subscripts(a || s, 1) AS card_index, len(a) AS la, raw FROM l)
    SELECT message_id, CAST(card_index AS BIGINT) AS card_index, CASE WHEN card_index <= la THEN 'long' ELSE 'short' END AS card_type, final_card,
      CASE WHEN card_index <= la AND card_index <= len(raw) THEN raw[card_index] ELSE final_card END AS ocr_original_card FROM n
    UNION ALL SELECT message_id, 1, 'unknown', '', '' FROM l WHERE len(a || s) = 0 AND (contains(raw_text, 'S07'))""",
)
def w12(t: Tables) -> DataFrame:
    from ledgerlens.operators.inventory import number_codes

    rows = audit_rows(t, "audit_record").withColumn("raw_long", split_list(F.col("raw_long"))).withColumn("raw_short", F.col("final_short"))
    return number_codes(rows).select("message_id", "card_index", "card_type", "final_card", "ocr_original_card")


@query(
    "T6_arrival_order",
    "SELECT CASE WHEN event_id % 10 < 9 THEN event_id END AS message_id, event_id * 7 % 10007 AS seq FROM @events ORDER BY message_id NULLS LAST, seq",
)
def t6(t: Tables) -> DataFrame:
    rows = t.events.select(F.when(F.col("event_id") % 10 < 9, F.col("event_id")).alias("message_id"), (F.col("event_id") * 7 % 10007).alias("seq"))
    return stats.arrival_order(rows)


@query("T5_recipient_pages", "SELECT c_custkey AS user_id, CAST((row_number() OVER (ORDER BY c_custkey) - 1) // 50 AS BIGINT) AS page FROM @customer")
def t5(t: Tables) -> DataFrame:
    return stats.pages(t.customer.select(F.col("c_custkey").alias("user_id")), "user_id")


@query(
    "T4_limit_short_codes",
    """WITH c AS (SELECT event_id, [code_s, code_s || '?', reverse(code_s), substr(code_a, 8, 14)] AS cs, CASE WHEN event_id % 5 > 0 THEN event_id % 5 END AS k FROM audit_base),
    x AS (SELECT *, list_filter(cs, lambda c: NOT ends_with(c, '?')) AS exact FROM c)
    SELECT event_id, array_to_string(CASE WHEN k IS NULL OR len(cs) <= k THEN cs WHEN len(exact) >= k THEN exact[1:k] ELSE cs[1:k] END, ',') AS codes FROM x""",
)
def t4(t: Tables) -> DataFrame:
    marked = t.audit_base.select(
        "event_id", F.array("code_s", F.concat("code_s", F.lit("?")), F.reverse("code_s"), F.substr("code_a", F.lit(8), F.lit(14))).alias("codes"),
        F.when(F.col("event_id") % 5 > 0, (F.col("event_id") % 5).cast("int")).alias("expected"),
    )
    return marked.select("event_id", F.concat_ws(",", stats.limit_codes(F.col("codes"), F.col("expected"))).alias("codes"))
