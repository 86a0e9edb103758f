"""Operational tables derived from the driver tables.

Every view is one SQL text that Spark and DuckDB both accept, so a query and its
oracle start from the same rows. Base tables are written ``@events``. Lists are
comma-joined text here; the operators split them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.session import spread

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def _body(seed: str) -> str:
    """Upper-case characters without 0, 1, O and I, derived from a hash."""
    return f"upper(translate(md5(CAST({seed} AS STRING)), '01', 'gh'))"


def _long(seed: str) -> str:
    body = _body(seed)
    return (
        f"concat('S07', lpad(CAST(200 + ({seed}) % 170 AS STRING), 3, '0'), '-', substr({body}, 1, 4), '-',"
        f" substr({body}, 5, 4), '-', substr({body}, 9, 5))"
    )


def _short(seed: str) -> str:
    body = _body(f"'s' || CAST({seed} AS STRING)")
    return f"concat('X', substr({body}, 1, 3), '-', substr({body}, 5, 4), '-', substr({body}, 9, 4))"


_K2 = "CAST(floor(event_id / 2) AS BIGINT)"
_K5 = "CAST(floor(event_id / 5) AS BIGINT)"

VIEWS: dict[str, str] = {
    # One row per processed image. Codes repeat between neighbours, every 11th has one
    # character changed, error events have none.
    "audit_base": f"""
        SELECT event_id, ts, user_id, event_type, value,
               {_long(_K2)} AS code_a, {_long(_K2 + " + 1")} AS code_b, {_short(_K5)} AS code_s
        FROM @events""",
    "audit_record": """
        SELECT event_id AS message_id,
               concat('f', CAST(event_id - event_id % 2 * (event_id % 3) AS STRING)) AS file_unique_id,
               -(1000 + user_id % 5) AS chat_id,
               concat('Group ', CAST(user_id % 5 AS STRING)) AS chat_title,
               user_id, concat('User', CAST(user_id AS STRING)) AS username,
               ts, CAST(ts + INTERVAL '8' HOUR AS DATE) AS dt,
               CAST(floor(event_id / 3) AS BIGINT) AS batch_id,
               concat('rec', lpad(CAST(event_id AS STRING), 12, '0')) AS record_path,
               CASE WHEN event_type = 'error' THEN '' WHEN event_id % 3 = 0 THEN concat(code_a, ',', code_b)
                    ELSE code_a END AS raw_long,
               CASE WHEN event_type = 'error' THEN ''
                    WHEN event_id % 11 = 0 THEN concat(substr(code_a, 1, 21), 'Z')
                    WHEN event_id % 3 = 0 THEN concat(code_a, ',', code_b)
                    ELSE code_a END AS final_long,
               CASE WHEN event_type = 'error' OR event_id % 4 > 0 THEN '' ELSE code_s END AS final_short,
               CASE WHEN event_type = 'error' THEN 'failed' ELSE 'complete' END AS status,
               event_id % 9 AS uncertain_count,
               CASE WHEN event_id % 13 = 0 THEN concat('PENDING ', code_a, ' TAIL') ELSE code_a END AS raw_text
        FROM audit_base""",
    # Two deliveries of some images: every 7th is repeated under the same message and file.
    "audit_delivery": """
        SELECT * FROM audit_record
        UNION ALL
        SELECT message_id, file_unique_id, chat_id, chat_title, user_id, username, ts, dt, batch_id,
               concat(record_path, 'b') AS record_path, raw_long, final_long, final_short, status,
               uncertain_count, raw_text
        FROM audit_record WHERE message_id % 7 = 0""",
    "audit_phase": """
        SELECT chat_id, message_id, file_unique_id, ts AS phase_ts, 'staged' AS status, dt, '' AS final_long
        FROM audit_record
        UNION ALL
        SELECT chat_id, message_id, file_unique_id, ts + INTERVAL '5' SECOND AS phase_ts, status, dt, final_long
        FROM audit_record WHERE message_id % 10 < 9""",
    "code_sighting": """
        SELECT event_id AS message_id, -(1000 + user_id % 5) AS chat_id, concat('Group ', CAST(user_id % 5 AS STRING)) AS chat_title,
               user_id, concat('User', CAST(user_id AS STRING)) AS username, ts,
               CAST(ts + INTERVAL '8' HOUR AS DATE) AS dt, 'long' AS code_type,
               CASE WHEN event_id % 11 = 0 THEN concat(substr(code_a, 1, 21), 'Z') ELSE code_a END AS code
        FROM audit_base WHERE event_type <> 'error'
        UNION ALL
        SELECT event_id AS message_id, -(1000 + user_id % 5) AS chat_id, concat('Group ', CAST(user_id % 5 AS STRING)) AS chat_title,
               user_id, concat('User', CAST(user_id AS STRING)) AS username, ts,
               CAST(ts + INTERVAL '8' HOUR AS DATE) AS dt, 'short' AS code_type, code_s AS code
        FROM audit_base WHERE event_type <> 'error' AND event_id % 4 = 0""",
    # Ledger postings: income from orders, payout from the lines of an order.
    "posting": """
        SELECT o_orderkey * 2 AS id, -(1 + o_custkey % 20) AS chat_id, 'income' AS kind,
               CAST(o_totalprice AS DECIMAL(18,2)) AS amount, o_custkey AS operator_id, o_orderkey, o_orderdate
        FROM @orders
        UNION ALL
        SELECT o_orderkey * 2 + 1 AS id, -(1 + o_custkey % 20) AS chat_id, 'payout' AS kind,
               CAST(q AS DECIMAL(18,2)) AS amount, o_custkey AS operator_id, o_orderkey, o_orderdate
        FROM @orders JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM @lineitem GROUP BY l_orderkey) AS lines
             ON l_orderkey = o_orderkey""",
    "ledger_input": """
        SELECT id, chat_id, kind, amount, operator_id,
               CAST(o_orderkey % 23 AS INT) AS reset_hour,
               CAST(65000 + o_orderkey % 97 * 37 AS BIGINT) AS rate4,
               CAST(o_orderkey % 41 * 2500 AS BIGINT) AS fee4,
               concat('note', CAST(o_orderkey % 7 AS STRING)) AS note,
               concat('Op ', CAST(operator_id AS STRING)) AS operator_name,
               id + 7 AS source_message_id,
               o_orderdate + INTERVAL '1' HOUR * CAST(o_orderkey % 24 AS INT) AS created_at,
               CASE WHEN o_orderkey % 17 = 0 THEN o_orderdate + INTERVAL '2' DAY END AS voided_at
        FROM posting""",
    "chat_profile": """
        SELECT -(1 + c_custkey % 20) AS chat_id, c_custkey AS user_id,
               CASE WHEN c_custkey % 9 = 0 THEN '' WHEN c_custkey % 2 = 0
                    THEN concat('@', c_name) ELSE c_name END AS username,
               concat(c_mktsegment, ' ', CAST(c_nationkey AS STRING)) AS display_name,
               c_custkey % 29 = 0 AS is_bot, c_acctbal,
               TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * CAST(c_custkey % 1200 AS INT) AS updated_at,
               c_custkey AS seq
        FROM @customer""",
    # Profile and membership changes: several versions per (chat, user).
    "member_event": """
        SELECT -(1 + user_id % 20) AS chat_id, user_id, event_id AS seq, ts,
               concat('user', CAST((user_id + event_id % 2) AS STRING)) AS username,
               concat('Name ', CAST(event_id % 6 AS STRING)) AS display_name,
               user_id % 31 = 0 AS is_bot,
               CASE WHEN event_type = 'signup' THEN 'add_operator' WHEN event_type = 'error' THEN 'remove_operator'
                    ELSE 'seen' END AS op
        FROM @events""",
    "setting_event": """
        SELECT -(1 + user_id % 20) AS chat_id, event_id AS seq, ts, user_id,
               CASE WHEN event_id % 5 = 0 THEN CAST(60000 + event_id % 999 * 20 - 500 * (event_id % 200) AS BIGINT) END AS rate4,
               CASE WHEN event_id % 7 = 0 THEN CAST(event_id % 130 * 10000 - 30000 AS BIGINT) END AS fee4,
               CASE WHEN event_id % 11 = 0 THEN CAST(event_id % 27 AS INT) - 1 END AS reset_hour,
               CASE WHEN event_id % 13 = 0 THEN event_id % 26 = 0 END AS ledger_enabled,
               CASE WHEN event_id % 17 = 0 THEN user_id END AS owner_id,
               event_id % 51 = 0 AS owner_replace
        FROM @events""",
    # Chat messages that carry ledger commands.
    "ledger_message": """
        SELECT -(1 + o_custkey % 20) AS chat_id, o_orderkey + 1 AS message_id,
               TIMESTAMP '2024-03-01 00:00:00' + INTERVAL '1' MINUTE * CAST(o_orderkey AS INT) AS ts,
               o_custkey AS user_id,
               CASE WHEN o_custkey % 3 = 0 THEN '' ELSE concat('user', CAST(o_custkey AS STRING)) END AS username,
               CASE WHEN o_custkey % 4 = 0 THEN '' ELSE concat('Name ', CAST(o_custkey AS STRING)) END AS display_name,
               CASE WHEN o_orderkey % 50 = 0 THEN concat('设置汇率 ', CAST(CAST(6 + o_orderkey % 20 * 0.05 AS DECIMAL(8,2)) AS STRING))
                    WHEN o_orderkey % 50 = 10 THEN concat('设置费率', CAST(o_orderkey % 13 AS STRING))
                    WHEN o_orderkey % 50 = 20 THEN concat('设置日切 ', CAST(o_orderkey % 24 AS STRING), '点')
                    WHEN o_orderkey % 50 = 30 THEN '撤销'
                    WHEN o_orderkey % 2000 = 40 THEN '清账'
                    WHEN o_orderkey % 500 = 45 THEN '关闭记账'
                    WHEN o_orderkey % 500 = 165 THEN '开启记账'
                    WHEN o_orderkey % 50 = 47 THEN '添加操作员'
                    WHEN o_orderkey % 50 = 48 THEN '今日账单'
                    WHEN o_orderkey % 10 = 3 THEN concat('下发 ', CAST(o_orderkey % 800 AS STRING), ' bob')
                    WHEN o_orderkey % 10 = 4 THEN concat('-', CAST(CAST(o_totalprice / 10 AS DECIMAL(18,1)) AS STRING))
                    WHEN o_orderkey % 10 = 5 THEN concat('入款', CAST(o_orderkey % 700 AS STRING), ' -', o_orderpriority)
                    WHEN o_orderkey % 10 = 6 THEN concat('hello ', o_orderstatus)
                    WHEN o_orderkey % 10 = 7 THEN '+0'
                    ELSE concat(' +', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING), ' ', o_orderpriority) END AS text,
               CASE WHEN o_orderkey % 50 = 30 THEN o_orderkey - 60 * (o_orderkey % 3) END AS reply_message_id,
               CASE WHEN o_orderkey % 100 = 80 THEN concat('#', CAST(o_orderkey % 9 AS STRING)) END AS reply_text,
               CASE WHEN o_orderkey % 50 = 47 OR o_orderkey % 40 = 1 THEN o_custkey + 1 END AS reply_user_id,
               CASE WHEN o_orderkey % 50 = 47 OR o_orderkey % 40 = 1 THEN concat('friend', CAST(o_custkey + 1 AS STRING)) END AS reply_username
        FROM @orders""",
    # The same log with every 13th message delivered twice.
    "ledger_delivery": """
        SELECT *, 1 AS delivery FROM ledger_message
        UNION ALL
        SELECT *, 2 AS delivery FROM ledger_message WHERE message_id % 13 = 0""",
    "card_record": """
        SELECT message_id * 4 + pos AS id, chat_id, chat_title, user_id, username AS user_name,
               concat('a', CAST(user_id % 30 AS STRING)) AS user_handle,
               message_id, ts AS message_date, CAST(1 + message_id % 4 AS INT) AS image_index,
               CAST(pos AS INT) AS card_index, CAST(pos * 1024 AS BIGINT) AS display_order, code_type AS card_type,
               code AS ocr_original_card, CASE WHEN message_id % 23 = 0 THEN lower(code) ELSE code END AS final_card,
               CASE WHEN message_id % 19 = 0 THEN 'special' ELSE '未分类' END AS denomination,
               CASE WHEN message_id % 29 = 0 THEN 'MANUAL' ELSE 'OCR' END AS source_type,
               message_id % 6 = 0 AS is_stocked, message_id % 8 = 1 AS is_redeemed, message_id % 21 = 0 AS is_invalid,
               message_id % 37 = 0 AS is_ocr_failed, message_id % 2 = 0 AS is_viewed, message_id % 41 = 0 AS is_deleted,
               message_id * 4 + pos AS change_version
        FROM (SELECT *, CASE WHEN code_type = 'long' THEN 1 ELSE 3 END AS pos FROM code_sighting) AS numbered""",
    "patch_event": """
        SELECT event_id AS version, CAST(floor(event_id / 3) AS BIGINT) * 4 + 1 AS record_id, ts,
               CASE WHEN event_id % 10 = 0 THEN concat(' s07', CAST(event_id AS STRING), ' ') END AS final_card,
               CASE WHEN event_id % 9 = 0 THEN concat('d', CAST(event_id % 4 AS STRING)) END AS denomination,
               CASE WHEN event_id % 4 = 0 THEN event_id % 8 = 0 END AS stocked,
               CASE WHEN event_id % 5 = 0 THEN event_id % 10 = 0 END AS redeemed,
               CASE WHEN event_id % 6 = 1 THEN event_id % 12 = 1 END AS invalid,
               CASE WHEN event_id % 7 = 2 THEN event_id % 14 = 2 END AS viewed,
               CASE WHEN event_id % 20 = 3 THEN event_id % 40 = 3 END AS deleted
        FROM @events""",
    "prefix_rule": """
        SELECT 'S07' AS prefix, 'base' AS denomination UNION ALL SELECT 'S0730', '300' UNION ALL
        SELECT 'S07304', '304' UNION ALL SELECT 'S0736', '360' UNION ALL SELECT 'S07368', '11200' UNION ALL
        SELECT 'S07362', '11200' UNION ALL SELECT 'S07367', '5500' UNION ALL SELECT 'S07361', '5500'""",
    "chat_alias": """
        SELECT DISTINCT chat_id, CASE WHEN chat_id % 2 = 0 THEN concat('Alias ', CAST(-chat_id AS STRING)) ELSE '' END AS display_name,
               -chat_id AS change_version
        FROM audit_record""",
    "user_alias": """
        SELECT user_id, CASE WHEN user_id % 3 = 0 THEN concat('Nick ', CAST(user_id AS STRING)) ELSE '' END AS display_name,
               max(event_id) AS change_version
        FROM @events GROUP BY user_id""",
    "code_correction": """
        SELECT -(1000 + event_id % 3) AS chat_id, 'long' AS code_type,
               concat(substr(code_a, 1, 21), 'Z') AS wrong_code,
               CASE WHEN event_id % 2 = 0 THEN code_a ELSE code_b END AS correct_code, event_id AS seq
        FROM audit_base""",
    # Documents with codes in several noisy spellings appended.
    "noisy_text": f"""
        SELECT doc_id, lang, source, n_chars,
               concat(text, CASE
                 WHEN doc_id % 6 = 0 THEN concat('\n', {_long("doc_id")}, ' ', {_long("doc_id + 1")}, '\n', {_long("doc_id")})
                 WHEN doc_id % 6 = 1 THEN concat('\n卡号: ', {_short("doc_id")}, '\n密码: ', {_short("doc_id + 1")})
                 WHEN doc_id % 6 = 2 THEN concat('\n5O7', substr({_long("doc_id")}, 4, 19), ' end')
                 WHEN doc_id % 6 = 3 THEN concat('\n', replace({_long("doc_id")}, '-', ' '), '\n', replace({_long("doc_id + 2")}, '-', ''))
                 WHEN doc_id % 6 = 4 THEN concat('\n', substr({_long("doc_id")}, 1, 16), '\n', substr({_long("doc_id")}, 17, 6), '\n', {_short("doc_id")})
                 ELSE '' END) AS text
        FROM @documents""",
    # Nested worker responses as JSON text, one per image.
    "worker_payload": """
        SELECT event_id AS image_id, -(1000 + user_id % 5) AS chat_id, ts,
               concat('{"texts":[{"text":"', code_a, '","score":0.9', CAST(event_id % 10 AS STRING), '},',
                      '{"text":"line ', CAST(event_id AS STRING), '","score":0.5}],',
                      '"cards":[{"text":"', code_a, '","score":0.9', CAST(event_id % 10 AS STRING), '}',
                      CASE WHEN event_id % 3 = 0 THEN concat(',{"text":"', code_b, '","score":0.8', CAST(event_id % 7 AS STRING), '},',
                      '{"text":"', code_b, '","score":0.9', CAST(event_id % 4 AS STRING), '}') ELSE '' END, '],',
                      '"ocr_original":{"cards":[{"text":"', code_a, '","score":0.9', CAST(event_id % 8 AS STRING), '}]},',
                      '"ocr_enhanced":{"cards":[{"text":"',
                      CASE WHEN event_id % 5 = 0 THEN concat(substr(code_a, 1, 21), 'Z') ELSE code_a END,
                      '","score":0.9', CAST(event_id % 9 AS STRING), '}]},',
                      '"latency_ms":', CAST(20 + event_id % 700 AS STRING), '}') AS payload
        FROM audit_base""",
    "service_call": """
        SELECT event_id, ts, user_id % 4 AS provider_id, event_type <> 'error' AS ok,
               CAST(20 + event_id % 700 AS BIGINT) AS latency_ms,
               event_id % 3 = 0 AS enhanced_used, event_id % 8 = 0 AS cache_hit,
               event_type = 'error' AND event_id % 2 = 0 AS fallback
        FROM @events""",
    # Labelled evaluation cases, one manifest row may repeat a case id.
    "audit_case": f"""
        SELECT d.doc_id AS seq, concat('case', CAST(CAST(floor(d.doc_id / 2) AS BIGINT) * 2 + d.doc_id % 2 * (d.doc_id % 3) AS STRING)) AS case_id,
               d.source AS profile,
               CASE WHEN l.doc_id IS NULL THEN 'unknown' WHEN l.toxic = 1 OR l.quality = 0 THEN 'confirmed_error'
                    ELSE 'confirmed_match' END AS status,
               CASE WHEN d.doc_id % 4 = 0 THEN 'wrong_char,missing,missing' WHEN d.doc_id % 4 = 1 THEN 'extra' ELSE '' END AS error_types,
               md5(d.text) AS content_md5,
               CASE WHEN d.doc_id % 5 = 4 THEN '' WHEN d.doc_id % 5 = 3 THEN concat({_long("d.doc_id")}, ',', {_long("d.doc_id + 1")})
                    ELSE {_long("d.doc_id")} END AS expected_long,
               CASE WHEN d.doc_id % 7 = 0 THEN {_short("d.doc_id")} ELSE '' END AS expected_short
        FROM @documents AS d LEFT JOIN @labels AS l ON l.doc_id = d.doc_id""",
    "benchmark_result": f"""
        SELECT doc_id AS seq, concat('case', CAST(doc_id AS STRING)) AS name, source AS profile,
               concat({_long("doc_id")}, ',', {_long("doc_id + 1")}) AS expected_long,
               CASE WHEN doc_id % 3 = 0 THEN {_short("doc_id")} ELSE '' END AS expected_short,
               CASE WHEN doc_id % 6 = 0 THEN concat({_long("doc_id + 1")}, ',', {_long("doc_id")})
                    WHEN doc_id % 6 = 1 THEN {_long("doc_id")}
                    WHEN doc_id % 6 = 2 THEN concat({_long("doc_id")}, ',', {_long("doc_id + 9")})
                    ELSE concat({_long("doc_id")}, ',', {_long("doc_id + 1")}) END AS actual_long,
               CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN {_short("doc_id")}
                    WHEN doc_id % 10 = 1 THEN {_long("doc_id + 1")} ELSE '' END AS actual_short,
               CAST(10 + n_chars % 977 AS BIGINT) AS elapsed_ms
        FROM @documents""",
    # Predicted and confirmed codes of learning batches.
    "learning_pair": """
        SELECT CAST(floor(event_id / 40) AS BIGINT) AS batch_id, event_id AS seq, concat('font', CAST(user_id % 12 AS STRING)) AS font_hash,
               CASE WHEN floor(event_id / 2) % 17 = 0 THEN concat(substr(code_a, 1, 7), 'QQQQ-QQQQ-QQQQQ')
                    WHEN event_id % 11 = 0 THEN concat(substr(code_a, 1, 8), 'ZZ', substr(code_a, 11, 12))
                    WHEN event_id % 5 = 0 THEN concat(substr(code_a, 1, 21), 'Z') ELSE code_a END AS predicted,
               CASE WHEN event_id % 13 > 0 THEN code_a END AS truth, ts
        FROM audit_base""",
    "rolling_event": """
        SELECT event_id, ts, concat('img', CAST(event_id AS STRING)) AS image_id, code_a AS card,
               CASE WHEN event_id % 4 = 0 THEN concat(lower(code_a), ' ') ELSE code_a END AS raw_candidate,
               code_s AS short_card
        FROM audit_base WHERE event_type <> 'error'""",
    # Readings of one image by several sources, as scalars the plans assemble into structs.
    "evidence": """
        SELECT event_id AS image_id, code_a, code_b, code_s, event_id % 6 >= 3 AS two,
               CASE WHEN event_id % 5 = 0 THEN concat(substr(code_a, 1, 21), 'Z') ELSE code_a END AS variant_a,
               CASE WHEN event_id % 4 = 0 THEN code_b ELSE code_a END AS cloud_a,
               (980 + event_id % 3 * 5) / 1000.0E0 AS s1, (940 + event_id % 7 * 10) / 1000.0E0 AS s2,
               (970 + event_id % 5 * 6) / 1000.0E0 AS s3, (860 + event_id % 9 * 10) / 1000.0E0 AS s4,
               CASE WHEN event_id % 10 = 9 THEN 3 WHEN event_id % 10 = 8 THEN NULL WHEN event_id % 6 >= 3 THEN 2 ELSE 1 END AS expected,
               CASE WHEN event_id % 12 = 11 THEN 1 ELSE 0 END AS uncertain, event_id % 14 = 13 AS conflict, event_id % 15 = 14 AS unresolved,
               event_id % 4 = 1 AS strip_only, CAST(100 + event_id % 900 AS INT) AS width, CAST(40 + event_id % 600 AS INT) AS height,
               CAST(60 + event_id % 50 AS INT) AS variance
        FROM audit_base""",
    "order_book": """
        SELECT event_id AS seq, ts, CAST(user_id % 20 AS BIGINT) AS feed_id,
               CASE WHEN event_id % 9 = 0 THEN '{"data":{"sell":[]}}'
                    WHEN event_id % 5 = 0 THEN concat('{"data":[{"usdCny":"7.', CAST(event_id % 90 + 10 AS STRING), '"}]}')
                    ELSE concat('{"data":{"sell":[{"price":"7.', CAST(event_id % 80 + 10 AS STRING), '"},{"price":"7.',
                         CAST(event_id % 70 + 10 AS STRING), '"},{"size":"3"},{"price":"7.', CAST(event_id % 60 + 10 AS STRING), '"}]}}') END AS body
        FROM @events""",
}

_VIEW_WORD = re.compile(r"\b(" + "|".join(sorted(VIEWS, key=len, reverse=True)) + r")\b")
_BASE_REF = re.compile(r"@(" + "|".join(BASE_TABLES) + r")\b")


def _dependencies(sql: str, found: dict[str, None] | None = None) -> dict[str, None]:
    found = {} if found is None else found
    for name in dict.fromkeys(_VIEW_WORD.findall(sql)):
        if name not in found:
            _dependencies(VIEWS[name], found)
            found[name] = None
    return found


def with_views(sql: str) -> str:
    """``sql`` preceded by the views it mentions, as one WITH statement."""
    parts = [f"{name} AS ({VIEWS[name]})" for name in _dependencies(sql)]
    body = sql.strip()
    if not parts:
        return body
    if opening := re.match(r"(?i)with\s+(recursive\s)?", body):
        return opening[0] + ",\n".join(parts) + ",\n" + body[opening.end() :]
    return "WITH " + ",\n".join(parts) + "\n" + body


def duckdb_sql(sql: str) -> str:
    return _BASE_REF.sub(r"\1", with_views(sql))


class Tables:
    """Attribute access to the driver tables and the derived views of one folder."""

    def __init__(self, spark: SparkSession, folder: str, costly: bool = False):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.costly = costly

    @property
    def wide(self) -> Tables:
        """The same tables for row work that costs more than moving the rows."""
        return Tables(self.spark, self.folder, costly=True)

    def base(self, name: str) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread(rows) if self.costly else rows

    def sql(self, text: str) -> DataFrame:
        full = with_views(text)
        used = dict.fromkeys(_BASE_REF.findall(full))
        frames = {f"t_{name}": self.base(name) for name in used}
        escaped = full.replace("{", "{{").replace("}", "}}")
        return self.spark.sql(_BASE_REF.sub(r"{t_\1}", escaped), **frames)

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.sql(f"SELECT * FROM {name}")
        if name in BASE_TABLES:
            return self.base(name)
        raise AttributeError(name)
