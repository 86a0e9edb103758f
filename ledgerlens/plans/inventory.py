"""Inventory queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators import inventory, ledger, stats
from ledgerlens.plans.registry import query
from ledgerlens.sources.views import Tables

NAMED_SQL = """
named AS (SELECT r.*, coalesce(nullif(ca.display_name, ''), r.chat_title) AS display_chat_name, coalesce(nullif(ua.display_name, ''), r.user_name) AS display_user_name,
  NOT is_deleted AND sum(CASE WHEN NOT is_deleted THEN 1 ELSE 0 END) OVER (PARTITION BY lower(final_card), CAST(message_date + INTERVAL '8' HOUR AS DATE)) > 1 AS is_duplicate
  FROM card_record AS r LEFT JOIN chat_alias AS ca ON ca.chat_id = r.chat_id LEFT JOIN user_alias AS ua ON ua.user_id = r.user_id)"""


def named(t: Tables) -> DataFrame:
    return inventory.display_names(stats.flag_duplicates(t.card_record), t.chat_alias, t.user_alias)


@query("J1_display_names", f"WITH {NAMED_SQL} SELECT id, display_chat_name, display_user_name FROM named")
def j1(t: Tables) -> DataFrame:
    return inventory.display_names(t.card_record, t.chat_alias, t.user_alias).select("id", "display_chat_name", "display_user_name")


LABEL_SQL = """
labelled AS (SELECT c.id, c.final_card, c.denomination, coalesce((SELECT max_by(p.denomination, length(p.prefix)) FROM prefix_rule AS p
  WHERE starts_with(upper(trim(c.final_card)), p.prefix) AND starts_with(upper(trim(c.final_card)), 'S07')), '未分类') AS rule_label FROM card_record AS c)"""


@query("J2_longest_prefix", f"WITH {LABEL_SQL} SELECT id, rule_label FROM labelled")
def j2(t: Tables) -> DataFrame:
    return inventory.classify_by_prefix(t.card_record, t.prefix_rule).select("id", "rule_label")


@query(
    "J3_rule_backfill",
    """SELECT id, CASE WHEN denomination = '未分类' AND starts_with(upper(final_card), 'S0725') THEN '2500' ELSE denomination END AS denomination FROM card_record""",
)
def j3(t: Tables) -> DataFrame:
    return inventory.apply_new_rule(t.card_record, " s0725", "2500").select("id", "denomination")


@query(
    "P2_inventory_search",
    f"""WITH {NAMED_SQL} SELECT id, final_card, display_chat_name FROM named WHERE NOT is_deleted AND NOT is_redeemed AND NOT is_viewed AND NOT is_stocked AND is_duplicate AND change_version > 500
    AND (final_card ILIKE '%a2%' OR ocr_original_card ILIKE '%a2%' OR chat_title ILIKE '%a2%' OR user_name ILIKE '%a2%' OR user_handle ILIKE '%a2%' OR display_chat_name ILIKE '%a2%' OR display_user_name ILIKE '%a2%')
    ORDER BY message_date, message_id, image_index, display_order, id LIMIT 2000""",
)
def p2(t: Tables) -> DataFrame:
    found = inventory.search(named(t), redeemed=False, unread_only=True, duplicates_only=True, after_version=500, text=" a2 ")
    return found.select("id", "final_card", "display_chat_name")


@query(
    "P14_retention",
    """SELECT id, coalesce(stamp < TIMESTAMP '2024-01-20 00:00:00', false) AS purged FROM (SELECT id, CASE WHEN id % 9 > 0 THEN date_trunc('second', message_date + INTERVAL '8' HOUR) END AS stamp FROM card_record) AS s""",
)
def p14(t: Tables) -> DataFrame:
    text = F.when(F.col("id") % 9 > 0, F.date_format("message_date", "yyyy-MM-dd HH:mm:ss")).otherwise("unreadable")
    rows = t.card_record.select("id", text.alias("stamp"))
    at = F.try_to_timestamp("stamp", F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz") + F.expr("INTERVAL 8 HOURS")
    kept, purged = inventory.retain(rows, at, F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'"))
    return kept.select("id", F.lit(False).alias("purged")).union(purged.select("id", F.lit(True)))


@query(
    "A4_chat_counts",
    """SELECT r.chat_id, coalesce(nullif(ca.display_name, ''), max(r.chat_title)) AS display_chat_name, count(*) AS card_count
    FROM card_record AS r LEFT JOIN chat_alias AS ca ON ca.chat_id = r.chat_id WHERE NOT is_deleted GROUP BY r.chat_id, ca.display_name""",
)
def a4(t: Tables) -> DataFrame:
    return inventory.chat_counts(t.card_record, t.chat_alias)


STATUS_SQL = """count(*) AS total, count(*) FILTER (d = '11200') AS label_11200, count(*) FILTER (d = '5500') AS label_5500, count(*) FILTER (d = '未分类') AS unclassified,
  count(*) FILTER (is_redeemed) AS redeemed, count(*) FILTER (is_invalid) AS invalid, count(*) - count(*) FILTER (is_redeemed) - count(*) FILTER (is_invalid) AS valid,
  count(*) FILTER (is_stocked) AS stocked, count(*) - count(*) FILTER (is_stocked) AS pending_stock"""


@query(
    "A5_status_counts",
    f"""WITH {LABEL_SQL} SELECT c.chat_id, {STATUS_SQL} FROM (SELECT card_record.*, CASE WHEN card_record.denomination = '未分类' THEN rule_label ELSE card_record.denomination END AS d
    FROM card_record JOIN labelled ON labelled.id = card_record.id) AS c WHERE NOT is_deleted GROUP BY c.chat_id""",
)
def a5(t: Tables) -> DataFrame:
    ruled = inventory.classify_by_prefix(t.card_record, t.prefix_rule)
    label = F.when(F.col("denomination") == inventory.UNCLASSIFIED, F.col("rule_label")).otherwise(F.col("denomination"))
    return inventory.status_counts(ruled.withColumn("denomination", label), ("chat_id",))


@query(
    "A6_health",
    """SELECT max(message_date) FILTER (trim(final_card) <> '' AND NOT is_ocr_failed AND NOT is_invalid) AS last_valid_at,
    count(*) FILTER (CAST(message_date + INTERVAL '8' HOUR AS DATE) = DATE '2024-01-17') AS today_new FROM card_record WHERE NOT is_deleted""",
)
def a6(t: Tables) -> DataFrame:
    return inventory.health(t.card_record, F.lit("2024-01-17").cast("date"))


@query(
    "W7_latest_profiles",
    """SELECT chat_id, user_id, username, display_name, ts FROM (SELECT *, row_number() OVER (PARTITION BY chat_id, user_id ORDER BY ts DESC, seq DESC) AS r FROM member_event) AS x WHERE r = 1""",
)
def w7(t: Tables) -> DataFrame:
    return ledger.latest_rows(t.member_event, ["chat_id", "user_id"], ["ts", "seq"]).select("chat_id", "user_id", "username", "display_name", "ts")


@query(
    "W7_current_operators",
    """SELECT chat_id, user_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY chat_id, user_id ORDER BY seq DESC) AS r FROM member_event WHERE op <> 'seen') AS x WHERE r = 1 AND op = 'add_operator'""",
)
def w7b(t: Tables) -> DataFrame:
    return inventory.current_operators(t.member_event).select("chat_id", "user_id", "seq")


PATCH_SQL = """
p AS (SELECT e.*, r.is_redeemed AS st, last_value(CASE WHEN NOT coalesce(redeemed AND stocked, false) THEN redeemed END IGNORE NULLS)
  OVER (PARTITION BY record_id ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM patch_event AS e JOIN card_record AS r ON r.id = e.record_id),
v AS (SELECT *, NOT coalesce(stocked AND coalesce(redeemed, held, st), false) AS accepted FROM p),
d AS (SELECT v.*, coalesce(deleted <> coalesce(last_value(deleted IGNORE NULLS) OVER (PARTITION BY record_id ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), r.is_deleted), false) AS flips
  FROM v JOIN card_record AS r ON r.id = v.record_id WHERE accepted),
a AS (SELECT record_id, version, upper(trim(final_card)) AS fc, denomination AS dn, redeemed AS rd, invalid AS iv, deleted AS dl, coalesce(stocked, CASE WHEN redeemed THEN false END) AS sk,
  coalesce(viewed, CASE WHEN stocked THEN true END) AS vw,
  flips OR final_card IS NOT NULL OR denomination IS NOT NULL OR redeemed IS NOT NULL OR invalid IS NOT NULL OR stocked IS NOT NULL OR viewed IS NOT NULL AS moves FROM d),
f AS (SELECT record_id, max_by(fc, version) FILTER (fc IS NOT NULL) AS fc, max_by(dn, version) FILTER (dn IS NOT NULL) AS dn, max_by(rd, version) FILTER (rd IS NOT NULL) AS rd,
  max_by(iv, version) FILTER (iv IS NOT NULL) AS iv, max_by(dl, version) FILTER (dl IS NOT NULL) AS dl, max_by(sk, version) FILTER (sk IS NOT NULL) AS sk, max_by(vw, version) FILTER (vw IS NOT NULL) AS vw,
  max_by(false, version) FILTER (fc <> '') AS ok, max(version) FILTER (moves) AS ver FROM a GROUP BY record_id)"""


@query("W10_patch_verdicts", f"WITH {PATCH_SQL} SELECT record_id, version, accepted FROM v")
def w10(t: Tables) -> DataFrame:
    return inventory.patch_verdicts(t.card_record, t.patch_event).select("record_id", "version", "accepted")


@query(
    "W10_inventory_state",
    f"""WITH {PATCH_SQL} SELECT r.id, coalesce(fc, r.final_card) AS final_card, coalesce(dn, r.denomination) AS denomination, coalesce(rd, r.is_redeemed) AS is_redeemed, coalesce(sk, r.is_stocked) AS is_stocked,
    coalesce(vw, r.is_viewed) AS is_viewed, coalesce(iv, r.is_invalid) AS is_invalid, coalesce(dl, r.is_deleted) AS is_deleted, coalesce(ok, r.is_ocr_failed) AS is_ocr_failed, coalesce(ver, r.change_version) AS change_version
    FROM card_record AS r LEFT JOIN f ON f.record_id = r.id""",
)
def w10b(t: Tables) -> DataFrame:
    state = inventory.apply_patches(t.card_record, t.patch_event)
    return state.select(
        "id", "final_card", "denomination", "is_redeemed", "is_stocked", "is_viewed", "is_invalid", "is_deleted", "is_ocr_failed", "change_version"
    )


@query(
    "W10_cleared_chats",
    f"""WITH {PATCH_SQL}, c AS (SELECT r.id AS record_id, e.event_id * 2 + 1 AS version FROM card_record AS r JOIN @events AS e ON e.event_id % 97 = 5 AND r.chat_id = -(1000 + e.user_id % 5)),
    g AS (SELECT record_id, version * 2 AS version, deleted, final_card IS NOT NULL OR denomination IS NOT NULL OR redeemed IS NOT NULL OR invalid IS NOT NULL OR stocked IS NOT NULL OR viewed IS NOT NULL AS sets FROM v WHERE accepted
      UNION ALL SELECT record_id, version, true, false FROM c),
    x AS (SELECT g.*, sets OR coalesce(g.deleted <> coalesce(last_value(g.deleted IGNORE NULLS) OVER (PARTITION BY record_id ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), r.is_deleted), false) AS moves
      FROM g JOIN card_record AS r ON r.id = g.record_id)
    SELECT r.id, coalesce(max_by(x.deleted, x.version) FILTER (x.deleted IS NOT NULL), any_value(r.is_deleted)) AS is_deleted, coalesce(max(x.version) FILTER (moves), any_value(r.change_version)) AS change_version
    FROM card_record AS r LEFT JOIN x ON x.record_id = r.id GROUP BY r.id""",
)
def w10c(t: Tables) -> DataFrame:
    clears = t.events.where("event_id % 97 = 5").select((-(F.col("user_id") % 5) - 1000).alias("chat_id"), (F.col("event_id") * 2 + 1).alias("version"))
    patches = t.patch_event.withColumn("version", F.col("version") * 2)
    return inventory.apply_patches(t.card_record, patches, clears).select("id", "is_deleted", "change_version")


@query(
    "W11_display_orders",
    "SELECT id, row_number() OVER (PARTITION BY chat_id ORDER BY id) * 1024 AS new_order FROM card_record",
)
def w11(t: Tables) -> DataFrame:
    return inventory.display_orders(t.card_record, ["chat_id"], "id").select("id", "new_order")


@query(
    "W11_manual_ids",
    """SELECT name, first_seq, -900000000000000000 - row_number() OVER (ORDER BY first_seq) + 1 AS manual_id FROM (SELECT user_name AS name, min(id) AS first_seq FROM card_record WHERE source_type = 'MANUAL' GROUP BY user_name) AS s""",
)
def w11b(t: Tables) -> DataFrame:
    names = t.card_record.where("source_type = 'MANUAL'").select(F.col("user_name").alias("name"), F.col("id").alias("seq"))
    return inventory.manual_ids(names)


@query(
    "S12_changes_since",
    """SELECT 'record' AS entity, id AS entity_id, change_version FROM card_record WHERE NOT is_deleted AND change_version > 9000 UNION ALL
    SELECT 'chat_alias', chat_id, change_version FROM chat_alias WHERE change_version > 9000 UNION ALL SELECT 'user_alias', user_id, change_version FROM user_alias WHERE change_version > 9000""",
)
def s12(t: Tables) -> DataFrame:
    return inventory.changes_since(t.card_record, t.chat_alias, t.user_alias, 9000)
