"""Ledger queries: postings, settings, periods, bills, voids, alerts and the replay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import commands
from ledgerlens.functions.money import accounting_day, day_range, display, money, rate, scaled
from ledgerlens.operators import ledger
from ledgerlens.operators.blocks import Running, running
from ledgerlens.plans.registry import money_sql, query
from ledgerlens.sources.views import Tables

POSTED_SQL = """
posted AS (
  SELECT *, CASE WHEN kind = 'income' THEN amount_c - fee_c ELSE amount_c END AS payable_c,
         CASE WHEN kind = 'income' THEN (2 * (amount_c - fee_c) * 10000 + rate4) // (2 * rate4) ELSE amount_c END AS usdt_c
  FROM (SELECT *, CASE WHEN kind = 'income' THEN (2 * amount_c * fee4 + 1000000) // 2000000 ELSE 0 END AS fee_c,
               strftime(CAST(created_at + INTERVAL '8' HOUR - INTERVAL '1' HOUR * CAST(abs(chat_id) % 24 AS INT) AS DATE), '%Y-%m-%d') AS accounting_date
        FROM (SELECT *, CAST(amount * 100 AS BIGINT) AS amount_c FROM ledger_input) AS a) AS b)"""

TOTALS_SQL = f"""
  {money_sql("coalesce(sum(amount_c) FILTER (kind = 'income'), 0)")} AS income,
  {money_sql("coalesce(sum(fee_c) FILTER (kind = 'income'), 0)")} AS fees,
  {money_sql("coalesce(sum(payable_c) FILTER (kind = 'income'), 0)")} AS payable_amount,
  {money_sql("coalesce(sum(usdt_c) FILTER (kind = 'income'), 0)")} AS income_usdt,
  {money_sql("coalesce(sum(usdt_c) FILTER (kind = 'payout'), 0)")} AS payout_usdt,
  count(*) AS entry_count,
  {money_sql("coalesce(sum(usdt_c) FILTER (kind = 'income'), 0) - coalesce(sum(usdt_c) FILTER (kind = 'payout'), 0)")} AS balance_usdt"""


def rated(rows: DataFrame) -> DataFrame:
    """Integer rate and fee units of the views to decimals."""
    return rows.withColumn("rate", rate(scaled(F.col("rate4"), 4))).withColumn("fee_percent", rate(scaled(F.col("fee4"), 4)))


def posted(t: Tables) -> DataFrame:
    entries = ledger.post_entries(rated(t.ledger_input))
    return entries.withColumn(
        "accounting_date", accounting_day(F.col("created_at"), (F.abs("chat_id") % 24).cast("int"))
    )


@query(
    "L1_post_entries",
    f"""WITH {POSTED_SQL} SELECT id, chat_id, kind, {money_sql("amount_c")} AS amount, {money_sql("fee_c")} AS fee_amount,
    {money_sql("payable_c")} AS payable_amount, {money_sql("usdt_c")} AS payable_usdt, {money_sql("usdt_c")} AS net_amount FROM posted""",
)
def l1(t: Tables) -> DataFrame:
    return posted(t).select("id", "chat_id", "kind", "amount", "fee_amount", "payable_amount", "payable_usdt", "net_amount")


@query("A1_ledger_summary", f"WITH {POSTED_SQL} SELECT chat_id, {TOTALS_SQL} FROM posted WHERE voided_at IS NULL GROUP BY chat_id")
def a1(t: Tables) -> DataFrame:
    return ledger.summarize(posted(t), ["chat_id"])


@query(
    "A1_period_totals",
    f"WITH {POSTED_SQL} SELECT chat_id, accounting_date, {TOTALS_SQL} FROM posted WHERE voided_at IS NULL GROUP BY chat_id, accounting_date",
)
def a1_period(t: Tables) -> DataFrame:
    return ledger.summarize(posted(t), ["chat_id", "accounting_date"])


@query(
    "P1_select_entries",
    f"""WITH {POSTED_SQL} SELECT id, kind, {money_sql("amount_c")} AS amount, accounting_date, created_at FROM posted
    WHERE chat_id = -3 AND voided_at IS NULL AND created_at >= TIMESTAMP '1996-01-01' AND created_at < TIMESTAMP '1999-01-01'
    ORDER BY id LIMIT 500""",
)
def p1(t: Tables) -> DataFrame:
    picked = ledger.select_entries(
        posted(t), -3, start_at=F.expr("TIMESTAMP_NTZ '1996-01-01'"), end_at=F.expr("TIMESTAMP_NTZ '1999-01-01'"), limit=500
    )
    return picked.select("id", "kind", "amount", "accounting_date", "created_at")


def _settings(t: Tables) -> DataFrame:
    return ledger.setting_verdicts(rated(t.setting_event))


VERDICT_SQL = """CASE WHEN rate4 <= 0 THEN 'rate_not_positive' WHEN fee4 < 0 THEN 'fee_negative' WHEN fee4 >= 1000000 THEN 'fee_not_below_100'
    WHEN reset_hour < 0 OR reset_hour > 23 THEN 'reset_hour_out_of_range' END"""


@query("P15_setting_verdicts", f"SELECT seq, chat_id, {VERDICT_SQL} AS reject_reason FROM setting_event WHERE coalesce(rate4, fee4, reset_hour) IS NOT NULL")
def p15(t: Tables) -> DataFrame:
    given = F.coalesce("rate4", "fee4", F.col("reset_hour").cast("long")).isNotNull()
    return _settings(t).where(given).select("seq", "chat_id", "reject_reason")


@query(
    "P15_posting_verdicts",
    """SELECT reject_reason, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'P' THEN 'kind_unknown'
    WHEN (o_orderkey % 100) < 50 AND o_orderkey % 3 = 0 THEN 'amount_zero' END AS reject_reason FROM @orders) AS s GROUP BY reject_reason""",
)
def p15b(t: Tables) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "P", "gift").otherwise("income")
    amount = F.when(F.col("o_orderkey") % 3 == 0, scaled(F.col("o_orderkey") % 100, 4)).otherwise(F.lit(1))
    checked = ledger.posting_verdicts(t.orders.select(kind.alias("kind"), amount.alias("amount")))
    return checked.groupBy("reject_reason").agg(F.count("*").alias("n"))


@query(
    "P16_legacy_backfill",
    f"""WITH {POSTED_SQL}, legacy AS (SELECT id, kind, amount_c, usdt_c, payable_c, (2 * amount_c * 10000 + rate4) // (2 * rate4) AS conv_c, id % 3 AS m FROM posted)
    SELECT id, '0.0000' AS fee_percent, '0.00' AS fee_amount,
    {money_sql("CASE WHEN m = 0 OR kind = 'income' AND m = 1 THEN amount_c WHEN m = 1 THEN 0 ELSE payable_c END")} AS payable_amount,
    {money_sql("CASE WHEN m = 2 THEN usdt_c WHEN kind = 'income' AND m < 2 THEN conv_c WHEN m = 0 THEN NULL ELSE 0 END")} AS payable_usdt,
    {money_sql("CASE WHEN m = 2 THEN usdt_c WHEN kind = 'income' THEN conv_c WHEN m = 0 THEN amount_c ELSE 0 END")} AS net_amount FROM legacy""",
)
def p16(t: Tables) -> DataFrame:
    kept = lambda c: F.when(F.col("id") % 3 == 1, "0.00").when(F.col("id") % 3 == 2, F.col(c).cast("string"))
    old = posted(t).select(
        "id", "kind", F.col("amount").cast("string").alias("amount"), "rate",
        F.lit("").alias("fee_percent"), F.lit(None).cast("string").alias("fee_amount"),
        kept("payable_amount").alias("payable_amount"), kept("payable_usdt").alias("payable_usdt"), kept("net_amount").alias("net_amount"),
    )
    filled = ledger.backfill_legacy(old)
    return filled.select(
        "id", "fee_percent", "fee_amount",
        *[F.col(c).cast("decimal(28,2)").alias(c) for c in ("payable_amount", "payable_usdt", "net_amount")],
    )


@query(
    "F8_rounding",
    """SELECT CAST(o_orderkey AS BIGINT) AS id, CAST((2 * k + 10) // 20 AS BIGINT) AS half_up_units,
    CAST(CASE WHEN k % 10 <> 5 THEN (2 * k + 10) // 20 WHEN (k // 10) % 2 = 0 THEN k // 10 ELSE k // 10 + 1 END AS BIGINT) AS half_even_units
    FROM (SELECT o_orderkey, CAST(o_totalprice * 100 + 0.5 AS BIGINT) // 7 AS k0, o_orderkey * 5 AS k FROM @orders) AS s""",
)
def f8(t: Tables) -> DataFrame:
    value = scaled(F.col("o_orderkey") * 5, 3)
    cents = lambda c: (c * 100).cast("long")
    return t.orders.select(
        F.col("o_orderkey").alias("id"), cents(money(value)).alias("half_up_units"), cents(display(value)).alias("half_even_units")
    )


@query(
    "F9_accounting_days",
    """SELECT id, strftime(CAST(created_at + INTERVAL '8' HOUR - INTERVAL '1' HOUR * reset_hour AS DATE), '%Y-%m-%d') AS accounting_date,
    CAST(created_at + INTERVAL '8' HOUR - INTERVAL '1' HOUR * reset_hour AS DATE) + INTERVAL '1' HOUR * reset_hour - INTERVAL '8' HOUR AS day_start
    FROM ledger_input""",
)
def f9(t: Tables) -> DataFrame:
    hour = F.col("reset_hour")
    days = t.ledger_input.withColumn("accounting_date", accounting_day(F.col("created_at"), hour))
    return days.select("id", "accounting_date", day_range(F.to_date("accounting_date"), hour)[0].alias("day_start"))


@query(
    "F7_parse_commands",
    """WITH c AS (SELECT message_id, chat_id, trim(replace(text, '：', ':')) AS x FROM ledger_message),
    v AS (SELECT *, CASE WHEN x IN ('开启记账','打开记账','启用记账','开启') THEN 'enable' WHEN x IN ('关闭记账','停止记账','停用记账','暂停记账','暂停') THEN 'disable'
      WHEN starts_with(x, '日切') OR starts_with(x, '设置日切') THEN 'set_cutoff' WHEN x IN ('今日账单','账单','账目','查账','/bill') THEN 'bill_today'
      WHEN starts_with(x, '添加操作员') OR starts_with(x, '添加权限') THEN 'add_operator'
      WHEN starts_with(x, '汇率') OR starts_with(x, '设置汇率') THEN 'set_rate' WHEN starts_with(x, '设置费率') OR starts_with(x, '费率') THEN 'set_fee'
      WHEN x IN ('撤销','撤销账单','回滚','/undo') THEN 'undo' WHEN x IN ('清账','清空','清空账单','清除账单','/clear') THEN 'clear'
      WHEN x[1] IN ('+', '-') OR starts_with(x, '/in') OR starts_with(x, '入款') OR starts_with(x, '收款') OR starts_with(x, '上分') OR starts_with(x, '下发') THEN 'entry' END AS verb0,
      CASE WHEN x[1] IN ('+', '-') THEN x[1] ELSE substr(x, 1, 2) END AS prefix FROM c),
    p AS (SELECT *, trim(substr(x, length(prefix) + 1)) AS tail,
      CASE WHEN prefix = '下发' THEN '(?s)^(.*?)(-?[0-9]+(?:\\.[0-9]+)?)(.*)$' ELSE '(?s)^(.*?)([0-9]+(?:\\.[0-9]+)?)(.*)$' END AS pat FROM v),
    n AS (SELECT *, CASE WHEN prefix = '下发' THEN regexp_extract(tail, '(?s)^(.*?)(-?[0-9]+(?:\\.[0-9]+)?)(.*)$', 2)
      ELSE regexp_extract(tail, '(?s)^(.*?)([0-9]+(?:\\.[0-9]+)?)(.*)$', 2) END AS digits,
      CASE WHEN prefix = '下发' THEN regexp_extract(tail, '(?s)^(.*?)(-?[0-9]+(?:\\.[0-9]+)?)(.*)$', 1) || regexp_extract(tail, '(?s)^(.*?)(-?[0-9]+(?:\\.[0-9]+)?)(.*)$', 3)
      ELSE regexp_extract(tail, '(?s)^(.*?)([0-9]+(?:\\.[0-9]+)?)(.*)$', 1) || regexp_extract(tail, '(?s)^(.*?)([0-9]+(?:\\.[0-9]+)?)(.*)$', 3) END AS rest FROM p)
    SELECT message_id, chat_id,
      CASE WHEN verb0 = 'entry' THEN CASE WHEN digits = '' THEN NULL WHEN CAST(digits AS DECIMAL(28,10)) = 0 THEN 'show_bill' ELSE 'entry' END ELSE verb0 END AS verb,
      CASE WHEN verb0 IN ('set_cutoff', 'set_rate', 'set_fee') THEN CAST(nullif(regexp_extract(x, '(-?[0-9]+(?:\\.[0-9]+)?)', 1), '') AS DECIMAL(28,10)) END AS setting_value,
      CASE WHEN verb0 = 'entry' AND digits <> '' THEN CASE WHEN prefix = '下发' THEN 'payout' ELSE 'income' END END AS kind,
      CASE WHEN verb0 = 'entry' AND digits <> '' THEN CASE WHEN prefix = '-' THEN -CAST(digits AS DECIMAL(28,10)) ELSE CAST(digits AS DECIMAL(28,10)) END END AS amount,
      CASE WHEN verb0 = 'entry' AND digits <> '' THEN trim(rest, ' -:，,') END AS note
    FROM n""",
)
def f7(t: Tables) -> DataFrame:
    parsed = commands.parse_messages(t.ledger_message.select("message_id", "chat_id", "text"))
    return parsed.drop("text")


@query(
    "F15_entry_attribution",
    """SELECT message_id, CASE WHEN reply_user_id IS NOT NULL THEN CASE WHEN length(reply_username) > 0 THEN concat('@', reply_username) ELSE CAST(reply_user_id AS STRING) END
    WHEN message_id % 4 = 0 THEN 'typed' WHEN display_name <> '' THEN display_name WHEN username <> '' THEN concat('@', username) ELSE CAST(user_id AS STRING) END AS attribution
    FROM ledger_message""",
)
def f15(t: Tables) -> DataFrame:
    reply = F.when(
        F.col("reply_user_id").isNotNull(), commands.actor_label(F.col("reply_username"), F.lit(""), F.col("reply_user_id"))
    )
    actor = commands.actor_name(F.col("username"), F.col("display_name"), F.col("user_id"))
    note = F.when(F.col("message_id") % 4 == 0, "typed").otherwise("")
    return t.ledger_message.select("message_id", commands.entry_attribution(note, actor, reply).alias("attribution"))


@query(
    "J4_idempotent_insert",
    """SELECT chat_id, message_id, delivery, text FROM ledger_delivery AS d
    WHERE delivery = 1 AND NOT EXISTS (SELECT 1 FROM ledger_message AS e WHERE e.message_id % 5 = 0 AND e.chat_id = d.chat_id AND e.message_id = d.message_id)""",
)
def j4(t: Tables) -> DataFrame:
    known = t.ledger_message.where(F.col("message_id") % 5 == 0)
    fresh = ledger.insert_new(known, t.ledger_delivery, ["chat_id", "message_id"], "delivery")
    return fresh.select("chat_id", "message_id", F.col("delivery").cast("int").alias("delivery"), "text")


@query(
    "J5_permitted_commands",
    """WITH o AS (SELECT chat_id, coalesce(max_by(owner_id, seq) FILTER (owner_replace AND owner_id IS NOT NULL), min_by(owner_id, seq) FILTER (owner_id IS NOT NULL)) AS owner_id FROM setting_event GROUP BY chat_id),
    m AS (SELECT *, last_value(CASE WHEN op <> 'seen' THEN op = 'add_operator' END IGNORE NULLS) OVER (PARTITION BY chat_id, user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS granted FROM member_event)
    SELECT m.chat_id, m.user_id, m.seq FROM m LEFT JOIN o ON o.chat_id = m.chat_id WHERE coalesce(granted, false) OR m.user_id = o.owner_id""",
)
def j5(t: Tables) -> DataFrame:
    owners = ledger.chat_owners(t.setting_event)
    held = ledger.operators_at(t.member_event, "seq").join(owners, "chat_id", "left")
    return held.where(F.col("is_operator") | (F.col("user_id") == F.col("owner_id"))).select("chat_id", "user_id", "seq")


_LAST = "OVER (PARTITION BY chat_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(
    "J6_settings_in_force",
    f"""SELECT seq, chat_id, last_value(rate4 IGNORE NULLS) {_LAST} AS rate4_in_force, last_value(fee4 IGNORE NULLS) {_LAST} AS fee4_in_force,
    last_value(ledger_enabled IGNORE NULLS) {_LAST} AS ledger_enabled_in_force
    FROM (SELECT seq, chat_id, CASE WHEN rate4 > 0 THEN rate4 END AS rate4, CASE WHEN fee4 >= 0 AND fee4 < 1000000 THEN fee4 END AS fee4, ledger_enabled FROM setting_event) AS s""",
)
def j6(t: Tables) -> DataFrame:
    log = t.setting_event.select(
        "seq", "chat_id", F.when(F.col("rate4") > 0, F.col("rate4")).alias("rate4"),
        F.when((F.col("fee4") >= 0) & (F.col("fee4") < 1000000), F.col("fee4")).alias("fee4"), "ledger_enabled",
    )
    held = ledger.settings_in_force(log, ["chat_id"], "seq", ["rate4", "fee4", "ledger_enabled"])
    return held.select("seq", "chat_id", "rate4_in_force", "fee4_in_force", "ledger_enabled_in_force")


@query(
    "J14_user_by_handle",
    """WITH known AS (SELECT chat_id, lower(ltrim(username, '@')) AS handle, user_id, display_name, updated_at, seq FROM chat_profile),
    asked AS (SELECT DISTINCT chat_id, lower(ltrim(upper(username), '@')) AS handle FROM chat_profile)
    SELECT a.chat_id, a.handle, k.user_id, k.display_name FROM asked AS a JOIN (
      SELECT *, row_number() OVER (PARTITION BY chat_id, handle ORDER BY updated_at DESC, seq DESC) AS r FROM known WHERE handle <> '') AS k
    ON k.chat_id = a.chat_id AND k.handle = a.handle AND k.r = 1""",
)
def j14(t: Tables) -> DataFrame:
    asked = t.chat_profile.select("chat_id", F.upper("username").alias("handle"))
    return ledger.find_by_handle(t.chat_profile, asked)


@query(
    "J7_correction_lookup",
    """WITH asked AS (SELECT DISTINCT chat_id, wrong_code FROM code_correction UNION SELECT -1009, wrong_code FROM code_correction),
    latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chat_id, code_type, wrong_code ORDER BY seq DESC) AS r FROM code_correction) AS x WHERE r = 1)
    SELECT chat_id, wrong_code, correct_code FROM (SELECT a.chat_id, a.wrong_code, l.correct_code,
      row_number() OVER (PARTITION BY a.chat_id, a.wrong_code ORDER BY CASE WHEN l.chat_id = a.chat_id THEN 0 ELSE 1 END, l.seq DESC) AS r2
      FROM asked AS a JOIN latest AS l ON l.wrong_code = a.wrong_code AND l.code_type = 'long') AS y WHERE r2 = 1""",
)
def j7(t: Tables) -> DataFrame:
    from ledgerlens.operators.inventory import lookup_corrections

    stored = ledger.latest_rows(t.code_correction, ["chat_id", "code_type", "wrong_code"], ["seq"])
    own = t.code_correction.select("chat_id", "wrong_code")
    foreign = t.code_correction.select(F.lit(-1009).cast("long").alias("chat_id"), "wrong_code")
    asked = own.union(foreign).distinct().withColumn("code_type", F.lit("long"))
    return lookup_corrections(asked, stored).select("chat_id", "wrong_code", "correct_code")


PRICE_SQL = """CAST(CASE WHEN seq % 9 = 0 THEN NULL WHEN seq % 5 = 0 THEN json_extract_string(body, '$.data[0].usdCny') ELSE json_extract_string(body, '$.data.sell[0].price') END AS DECIMAL(12,4))"""


@query(
    "J13_price_in_force",
    f"""WITH log AS (SELECT seq * 2 AS seq, chat_id, true AS snap, {PRICE_SQL} AS price, NULL AS manual FROM (SELECT seq, -(1 + feed_id) AS chat_id, body FROM order_book) AS b
      UNION ALL SELECT seq * 2 + 1, chat_id, false, NULL, CASE WHEN rate4 > 0 THEN rate4 END FROM setting_event),
    s AS (SELECT *, last_value(CASE WHEN snap THEN seq END IGNORE NULLS) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS snap_seq FROM log),
    j AS (SELECT s.seq, s.chat_id, s.manual, p.price FROM s LEFT JOIN log AS p ON p.snap AND p.seq = s.snap_seq WHERE NOT s.snap),
    a AS (SELECT *, CASE WHEN manual IS NOT NULL THEN CAST(manual AS BIGINT) ELSE CAST(price * 10000 AS BIGINT) END AS applied4 FROM j),
    h AS (SELECT *, last_value(CASE WHEN applied4 IS NOT NULL THEN seq END IGNORE NULLS) OVER (PARTITION BY chat_id ORDER BY seq) AS hit FROM a)
    SELECT h.seq, h.chat_id, coalesce(k.applied4, 10000) AS rate4, coalesce(k.manual IS NULL AND k.seq IS NOT NULL, false) AS is_realtime, h.applied4 IS NULL AS kept_old
    FROM h LEFT JOIN a AS k ON k.seq = h.hit""",
)
def j13(t: Tables) -> DataFrame:
    from ledgerlens.sources.payloads import first_price

    feed = t.order_book.select(
        (F.col("seq") * 2).alias("seq"), (-(F.col("feed_id") + 1)).alias("chat_id"), F.lit(True).alias("is_snapshot"), first_price(F.col("body")).alias("price"),
        F.lit(None).cast("decimal(12,4)").alias("manual_rate"),
    )
    orders = rated(t.setting_event).select(
        (F.col("seq") * 2 + 1).alias("seq"), "chat_id", F.lit(False).alias("is_snapshot"), F.lit(None).cast("decimal(12,4)").alias("price"),
        F.when(F.col("rate") > 0, F.col("rate")).alias("manual_rate"),
    )
    ruled = ledger.price_in_force(feed.unionByName(orders))
    return ruled.select("seq", "chat_id", (F.col("rate") * 10000).cast("long").alias("rate4"), "is_realtime", "kept_old")


@query(
    "A7_people_reached",
    """SELECT user_id, username, display_name, is_bot, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, seq DESC) AS r
    FROM (SELECT user_id, username, display_name, is_bot, ts AS updated_at, seq FROM member_event WHERE user_id <> 0 AND NOT is_bot) AS m) AS x WHERE r = 1""",
)
def a7(t: Tables) -> DataFrame:
    people = ledger.people_reached(t.member_event.withColumnRenamed("ts", "updated_at"))
    return people.select("user_id", "username", "display_name", "is_bot", "updated_at")


@query(
    "A8_active_members",
    """SELECT chat_id, count(*) AS members_all, count(*) FILTER (updated_at >= TIMESTAMP '2024-02-13') AS members_7d, count(*) FILTER (updated_at >= TIMESTAMP '2024-01-21') AS members_30d
    FROM chat_profile WHERE user_id <> 0 AND NOT is_bot GROUP BY chat_id""",
)
def a8(t: Tables) -> DataFrame:
    return ledger.active_members(t.chat_profile, F.expr("TIMESTAMP_NTZ '2024-02-20 15:30:00'"))


@query(
    "W1_active_numbers",
    f"""WITH {POSTED_SQL} SELECT id, chat_id, accounting_date, row_number() OVER (PARTITION BY chat_id ORDER BY id) AS chat_no,
    row_number() OVER (PARTITION BY chat_id, accounting_date ORDER BY id) AS scope_no FROM posted WHERE voided_at IS NULL""",
)
def w1(t: Tables) -> DataFrame:
    return ledger.number_live(posted(t), ["accounting_date"]).select("id", "chat_id", "accounting_date", "chat_no", "scope_no")


@query(
    "W1_entry_for_number",
    """WITH n AS (SELECT id, chat_id, row_number() OVER (PARTITION BY chat_id ORDER BY id) AS chat_no FROM ledger_input WHERE voided_at IS NULL)
    SELECT chat_id, chat_no, id FROM n""",
)
def w1b(t: Tables) -> DataFrame:
    one = F.lit(1).cast("long")
    numbered = running(ledger.live(t.ledger_input), ["chat_id"], "id", [Running("chat_no", "sum", one)])
    return numbered.select("chat_id", "chat_no", "id")


@query(
    "T1_recent_per_kind",
    """SELECT chat_id, kind, id, recency FROM (SELECT *, row_number() OVER (PARTITION BY chat_id, kind ORDER BY id DESC) AS recency FROM ledger_input WHERE voided_at IS NULL) AS x WHERE recency <= 3""",
)
def t1(t: Tables) -> DataFrame:
    return ledger.recent_per_kind(t.ledger_input, ["chat_id", "kind"]).select("chat_id", "kind", "id", "recency")


@query(
    "W8_chat_owner",
    """SELECT chat_id, coalesce(max_by(owner_id, seq) FILTER (owner_replace AND owner_id IS NOT NULL), min_by(owner_id, seq) FILTER (owner_id IS NOT NULL)) AS owner_id FROM setting_event GROUP BY chat_id""",
)
def w8(t: Tables) -> DataFrame:
    return ledger.chat_owners(t.setting_event)


@query(
    "W9_void_by_message",
    """SELECT id, chat_id FROM ledger_input AS e WHERE voided_at IS NULL AND EXISTS (SELECT 1 FROM ledger_message AS m WHERE m.chat_id = e.chat_id AND m.reply_message_id = e.source_message_id)""",
)
def w9(t: Tables) -> DataFrame:
    undo = t.ledger_message.where("reply_message_id IS NOT NULL")
    return ledger.void_by_message(t.ledger_input, undo).select("id", "chat_id")


@query(
    "W9_last_live_entry",
    "SELECT chat_id, max(id) AS id FROM ledger_input WHERE voided_at IS NULL GROUP BY chat_id",
)
def w9b(t: Tables) -> DataFrame:
    return ledger.live(t.ledger_input).groupBy("chat_id").agg(F.max("id").alias("id"))


@query(
    "W9_void_last_commands",
    """WITH RECURSIVE l AS (SELECT -(user_id % 20 + 1) AS chat_id, event_id AS seq, CASE WHEN event_type <> 'error' THEN event_id END AS entry_id FROM @events),
    n AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY seq) AS i FROM l),
    w AS (SELECT chat_id, 0::BIGINT AS i, 0::BIGINT AS seq, true AS pushed, NULL::BIGINT AS voided_id, []::BIGINT[] AS stack FROM n GROUP BY chat_id
      UNION ALL SELECT n.chat_id, n.i, n.seq, n.entry_id IS NOT NULL, CASE WHEN n.entry_id IS NULL THEN w.stack[len(w.stack)] END,
        CASE WHEN n.entry_id IS NOT NULL THEN list_append(w.stack, n.entry_id) ELSE w.stack[1:greatest(len(w.stack) - 1, 0)] END
      FROM w JOIN n ON n.chat_id = w.chat_id AND n.i = w.i + 1)
    SELECT chat_id, seq, voided_id FROM w WHERE NOT pushed""",
)
def w9c(t: Tables) -> DataFrame:
    log = t.events.select(
        (-(F.col("user_id") % 20 + 1)).alias("chat_id"), F.col("event_id").alias("seq"),
        F.when(F.col("event_type") != "error", F.col("event_id")).alias("entry_id"),
    )
    return ledger.void_last(log)


def _changes(t: Tables) -> DataFrame:
    """Cut-over changes; the first ten log rows of a chat come before its first entry."""
    log = running(t.setting_event, ["chat_id"], "seq", [Running("n", "sum", F.lit(1).cast("long"))])
    return log.where("reset_hour IS NOT NULL").select("chat_id", "seq", "ts", "reset_hour", (F.col("n") > 10).alias("has_entries"))


STATE_SQL = """
n0 AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY seq) AS n FROM setting_event),
c0 AS (SELECT chat_id, seq, ts, ts + INTERVAL '8' HOUR AS wall, reset_hour AS h, n > 10 AS has_entries,
       coalesce(lag(reset_hour) OVER (PARTITION BY chat_id ORDER BY seq), 3) AS oh FROM n0 WHERE reset_hour BETWEEN 0 AND 23),
c1 AS (SELECT *, CASE WHEN has_entries THEN CASE WHEN date_trunc('day', wall) + INTERVAL '1' HOUR * h <= wall
       THEN date_trunc('day', wall) + INTERVAL '1' HOUR * h + INTERVAL '1' DAY ELSE date_trunc('day', wall) + INTERVAL '1' HOUR * h END END AS b FROM c0 WHERE h <> oh),
c2 AS (SELECT *, lag(b) OVER (PARTITION BY chat_id ORDER BY seq) AS ob FROM c1),
c3 AS (SELECT *, coalesce(wall < ob, false) AS waiting, strftime(CAST(wall - INTERVAL '1' HOUR * oh AS DATE), '%Y-%m-%d') AS d0,
       strftime(CAST(wall - INTERVAL '1' HOUR * oh AS DATE) - 1, '%Y-%m-%d') AS d1 FROM c2),
c4 AS (SELECT *, last_value(CASE WHEN waiting THEN NULL WHEN wall < ob + INTERVAL '1' DAY THEN strftime(ob, '%Y-%m-%dT%H:%M:%S+08:00') ELSE d0 END IGNORE NULLS)
       OVER (PARTITION BY chat_id ORDER BY seq) AS kc FROM c3),
c5 AS (SELECT *, lag(kc) OVER (PARTITION BY chat_id ORDER BY seq) AS pkc FROM c4),
states AS (SELECT chat_id, seq, h, b, kc, last_value(CASE WHEN waiting THEN NULL WHEN wall < ob + INTERVAL '1' DAY THEN pkc
       WHEN wall < ob + INTERVAL '2' DAY THEN strftime(ob, '%Y-%m-%dT%H:%M:%S+08:00') ELSE d1 END IGNORE NULLS) OVER (PARTITION BY chat_id ORDER BY seq) AS kp FROM c5)"""


@query(
    "L2_cutoff_states",
    f"WITH {STATE_SQL} SELECT chat_id, seq, CAST(h AS INT) AS reset_hour, b AS boundary, kc AS kept_current, kp AS kept_previous FROM states",
)
def l2(t: Tables) -> DataFrame:
    states = ledger.cutoff_states(_changes(t))
    return states.select("chat_id", "seq", "reset_hour", "boundary", "kept_current", "kept_previous")


@query(
    "L3_assign_periods",
    f"""WITH {STATE_SQL},
    held AS (SELECT e.chat_id, e.seq, e.ts + INTERVAL '8' HOUR AS wall, s.h, s.b, s.kc, s.kp FROM setting_event AS e ASOF LEFT JOIN states AS s ON s.chat_id = e.chat_id AND s.seq < e.seq)
    SELECT chat_id, seq, CASE WHEN wall < b THEN kc WHEN wall < b + INTERVAL '1' DAY THEN strftime(b, '%Y-%m-%dT%H:%M:%S+08:00')
      ELSE strftime(CAST(wall - INTERVAL '1' HOUR * coalesce(h, 3) AS DATE), '%Y-%m-%d') END AS accounting_date,
    CASE WHEN wall < b THEN kp WHEN wall < b + INTERVAL '1' DAY THEN kc WHEN wall < b + INTERVAL '2' DAY THEN strftime(b, '%Y-%m-%dT%H:%M:%S+08:00')
      ELSE strftime(CAST(wall - INTERVAL '1' HOUR * coalesce(h, 3) AS DATE) - 1, '%Y-%m-%d') END AS previous_date FROM held""",
)
def l3(t: Tables) -> DataFrame:
    events = t.setting_event.select("chat_id", "seq", "ts")
    return ledger.assign_periods(events, ledger.cutoff_states(_changes(t))).select("chat_id", "seq", "accounting_date", "previous_date")


@query(
    "L4_bill_rows",
    f"""WITH {POSTED_SQL}, latest AS (SELECT chat_id, max(accounting_date) AS accounting_date FROM posted GROUP BY chat_id)
    SELECT p.chat_id, p.id, p.kind, {money_sql("amount_c")} AS amount, row_number() OVER (PARTITION BY p.chat_id, p.accounting_date ORDER BY p.id) AS scope_no
    FROM posted AS p JOIN latest AS l ON l.chat_id = p.chat_id AND l.accounting_date = p.accounting_date WHERE voided_at IS NULL""",
)
def l4(t: Tables) -> DataFrame:
    entries = posted(t)
    current = entries.groupBy("chat_id").agg(F.max("accounting_date").alias("accounting_date"))
    rows = ledger.live(entries).join(current, ["chat_id", "accounting_date"])
    numbered = running(rows, ["chat_id", "accounting_date"], "id", [Running("scope_no", "sum", F.lit(1).cast("long"))])
    return numbered.select("chat_id", "id", "kind", F.col("amount").cast("decimal(28,2)").alias("amount"), "scope_no")


@query(
    "L4_bill_totals",
    f"""WITH {POSTED_SQL}, latest AS (SELECT chat_id, max(accounting_date) AS accounting_date FROM posted GROUP BY chat_id)
    SELECT p.chat_id, p.accounting_date, {TOTALS_SQL} FROM posted AS p JOIN latest AS l ON l.chat_id = p.chat_id AND l.accounting_date = p.accounting_date
    WHERE voided_at IS NULL GROUP BY p.chat_id, p.accounting_date""",
)
def l4b(t: Tables) -> DataFrame:
    entries = posted(t)
    current = entries.groupBy("chat_id").agg(F.max("accounting_date").alias("accounting_date"))
    return ledger.summarize(entries.join(current, ["chat_id", "accounting_date"]), ["chat_id", "accounting_date"])


@query(
    "L5_overdue_alerts",
    f"""WITH {POSTED_SQL}, days AS (SELECT DISTINCT chat_id, accounting_date FROM posted)
    SELECT d.chat_id, d.accounting_date, {money_sql("coalesce(b, 0)")} AS balance_usdt, CASE WHEN coalesce(b, 0) < 0 THEN 'sending' ELSE 'skipped' END AS status
    FROM days AS d LEFT JOIN (SELECT chat_id, accounting_date, sum(CASE WHEN kind = 'income' THEN usdt_c ELSE -usdt_c END) AS b FROM posted WHERE voided_at IS NULL GROUP BY ALL) AS s
    ON s.chat_id = d.chat_id AND s.accounting_date = d.accounting_date WHERE d.chat_id % 3 <> 0 OR d.accounting_date >= '1997'""",
)
def l5(t: Tables) -> DataFrame:
    entries = posted(t)
    closed = entries.select("chat_id", "accounting_date").distinct().withColumn("cutoff_at", F.lit(None).cast("timestamp_ntz"))
    sent = closed.where((F.col("chat_id") % 3 == 0) & (F.col("accounting_date") < "1997"))
    return ledger.overdue_alerts(entries, closed, sent).select("chat_id", "accounting_date", "balance_usdt", "status")


@query(
    "L6_clear_report",
    """WITH m AS (SELECT chat_id, message_id, text = '清账' AS is_clear, message_id % 17 > 0 AS is_live FROM ledger_message),
    e AS (SELECT *, coalesce(sum(CASE WHEN is_clear THEN 1 ELSE 0 END) OVER (PARTITION BY chat_id ORDER BY message_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM m)
    SELECT chat_id, CAST(epoch AS BIGINT) AS epoch, count(*) FILTER (NOT is_clear AND is_live) AS live_rows, count(*) FILTER (NOT is_clear) AS all_rows, max(is_clear) AS cleared FROM e GROUP BY chat_id, epoch""",
)
def l6(t: Tables) -> DataFrame:
    log = t.ledger_message.select(
        "chat_id", F.col("message_id").alias("seq"), (F.col("text") == "清账").alias("is_clear"), (F.col("message_id") % 17 > 0).alias("is_live")
    )
    return ledger.clear_report(log)


def replayed(t: Tables) -> DataFrame:
    owners = t.ledger_message.groupBy("chat_id").agg(F.min("user_id").alias("owner_id"))
    return ledger.replay(t.ledger_delivery, owners)


@query("L7_ledger_replay")
def l7(t: Tables) -> DataFrame:
    return replayed(t)


@query("L7_replayed_bills")
def l7b(t: Tables) -> DataFrame:
    return ledger.summarize(replayed(t), ["chat_id", "accounting_date"])
