"""Evaluation, service figures, price payloads and file sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import codes
from ledgerlens.operators import evaluation, learning
from ledgerlens.plans.codes import joined
from ledgerlens.plans.learning import CASE_SQL, case_rows
from ledgerlens.plans.registry import query
from ledgerlens.session import shared_folder
from ledgerlens.sources import files, payloads
from ledgerlens.sources.views import Tables


def results(t: Tables, name: str = "benchmark_result") -> DataFrame:
    columns = ("expected_long", "expected_short", "actual_long", "actual_short")
    return getattr(t, name).withColumns({c: codes.split_list(F.col(c)) for c in columns})


def _summary_sql(keys: str, group: str, rows: str = "benchmark_result", mark: str = "") -> str:
    return f"""
lists{mark} AS (SELECT *, list_filter(split(expected_long, ',') || split(expected_short, ','), lambda x: x <> '') AS e, list_filter(split(actual_long, ',') || split(actual_short, ','), lambda x: x <> '') AS a FROM {rows}),
o{mark} AS (SELECT *, len(list_filter(e, lambda x: NOT list_contains(a, x))) AS miss, len(list_filter(a, lambda x: NOT list_contains(e, x))) AS fp, actual_long <> '' AND actual_short <> '' AS mix FROM lists{mark}),
su{mark} AS (SELECT {keys} count(*) AS cases, CAST(sum(len(e)) AS BIGINT) AS expected_codes, CAST(sum(miss) AS BIGINT) AS missing_codes, CAST(sum(fp) AS BIGINT) AS false_codes, count(*) FILTER (mix) AS type_mix_cases,
  count(*) FILTER (a <> e) AS order_mismatch_cases, count(*) FILTER (miss = 0 AND fp = 0 AND a = e) AS exact_matches, CAST(sum(len(e)) - sum(miss) AS BIGINT) AS correct_codes,
  list_sort(list(elapsed_ms)) AS ms FROM o{mark} {group}),
sm{mark} AS (SELECT *, CAST((ms[(cases - 1) // 2 + 1] + ms[cases // 2 + 1]) * 0.5 AS DECIMAL(20,1)) AS p50_ms, ms[least(cases - 1, cases * 95 // 100) + 1] AS p95_ms,
  CAST(round(correct_codes / (correct_codes + false_codes), 6) AS DECIMAL(20,6)) AS "precision", CAST(round(correct_codes / expected_codes, 6) AS DECIMAL(20,6)) AS recall FROM su{mark})"""


SUMMARY_COLUMNS = "cases, expected_codes, missing_codes, false_codes, type_mix_cases, order_mismatch_cases, exact_matches, correct_codes, p50_ms, p95_ms, \"precision\", recall"


@query("A9_benchmark_summary", f"WITH {_summary_sql('', '')} SELECT {SUMMARY_COLUMNS} FROM sm")
def a9(t: Tables) -> DataFrame:
    return evaluation.benchmark_summary(results(t), [])


@query("A9_benchmark_by_profile", f"WITH {_summary_sql('profile,', 'GROUP BY profile')} SELECT profile, {SUMMARY_COLUMNS} FROM sm")
def a9b(t: Tables) -> DataFrame:
    return evaluation.benchmark_summary(results(t), ["profile"])


def _gate_sql(changed: str) -> str:
    """The gate between the stored results and those with some columns replaced."""
    worse = "".join(
        f", CASE WHEN c.{column} > b.{column} THEN '{reason}' END"
        for column, reason in (
            ("false_codes", "false_positives_increased"), ("missing_codes", "missing_cards_increased"), ("type_mix_cases", "type_mix_increased"),
            ("order_mismatch_cases", "order_regressed"),
        )
    )
    by_profile = ("profile,", "GROUP BY profile")
    return f"""WITH changed AS (SELECT * REPLACE ({changed}) FROM benchmark_result), {_summary_sql(*by_profile)}, {_summary_sql(*by_profile, "changed", "2")},
    r AS (SELECT c.profile, concat_ws(',', CASE WHEN c.cases <> b.cases OR c.expected_codes <> b.expected_codes THEN 'benchmark_scope_changed' END{worse},
      CASE WHEN c.exact_matches <= b.exact_matches THEN 'no_exact_match_improvement' END,
      CASE WHEN c.p95_ms > greatest(b.p95_ms * 1.5, b.p95_ms + 500) THEN 'p95_latency_regressed' END) AS reasons FROM sm2 AS c JOIN sm AS b USING (profile))
    SELECT profile, reasons = '' AS approved, reasons FROM r"""


def _gate(t: Tables, changed: dict) -> DataFrame:
    base = evaluation.benchmark_summary(results(t), ["profile"])
    gate = evaluation.promotion(base, evaluation.benchmark_summary(results(t).withColumns(changed), ["profile"]), ["profile"])
    return gate.select("profile", "approved", joined(F.col("reasons")).alias("reasons"))


@query(
    "A13_promotion_gate",
    _gate_sql("CASE WHEN seq % 3 = 1 THEN expected_short ELSE actual_long END AS actual_long, CASE WHEN length(profile) % 2 = 0 OR seq % 4 = 0 THEN elapsed_ms * 3 + 600 ELSE elapsed_ms END AS elapsed_ms"),
)
def a13(t: Tables) -> DataFrame:
    """A candidate that puts short codes among the long ones and is slower on some profiles."""
    slower = (F.length("profile") % 2 == 0) | (F.col("seq") % 4 == 0)
    return _gate(t, {
        "actual_long": F.when(F.col("seq") % 3 == 1, F.col("expected_short")).otherwise(F.col("actual_long")),
        "elapsed_ms": F.when(slower, F.col("elapsed_ms") * 3 + 600).otherwise(F.col("elapsed_ms")),
    })


@query("A13_promotion_gate_improved", _gate_sql("CASE WHEN seq % 6 = 0 THEN expected_long ELSE actual_long END AS actual_long"))
def a13b(t: Tables) -> DataFrame:
    return _gate(t, {"actual_long": F.when(F.col("seq") % 6 == 0, F.col("expected_long")).otherwise(F.col("actual_long"))})


@query(
    "A10_worker_summary",
    """WITH c AS (SELECT provider_id, count(*) AS cases, count(*) FILTER (event_id % 5 > 0) AS exact_matches, count(*) FILTER (NOT ok) AS request_errors, count(*) FILTER (enhanced_used) AS enhanced_count, count(*) FILTER (cache_hit) AS cache_hits,
      list_sort(list(latency_ms) FILTER (ok)) AS ms, count(*) FILTER (ok) AS n FROM (SELECT * FROM service_call) AS s GROUP BY provider_id),
    w AS (SELECT *, ms[(n - 1) * 50 // 100 + 1] * (100 - (n - 1) * 50 % 100) + ms[least((n - 1) * 50 // 100 + 1, n - 1) + 1] * ((n - 1) * 50 % 100) AS h50,
      ms[(n - 1) * 95 // 100 + 1] * (100 - (n - 1) * 95 % 100) + ms[least((n - 1) * 95 // 100 + 1, n - 1) + 1] * ((n - 1) * 95 % 100) AS h95 FROM c)
    SELECT provider_id, cases, exact_matches, request_errors, enhanced_count, cache_hits, CAST(round_even(exact_matches / cases, 4) AS DECIMAL(20,4)) AS exact_rate, CAST(round_even(enhanced_count / cases, 4) AS DECIMAL(20,4)) AS enhanced_rate,
      CAST(round_even(h50 / 100, 0) AS BIGINT) AS p50_linear, CAST(round_even(h95 / 100, 0) AS BIGINT) AS p95_linear FROM w""",
)
def a10(t: Tables) -> DataFrame:
    calls = t.service_call.withColumn("exact", F.col("event_id") % 5 > 0).withColumn("error", ~F.col("ok"))
    return evaluation.worker_summary(calls, ["provider_id"])


@query(
    "A12_policy_candidates",
    f"""WITH {CASE_SQL}, g AS (SELECT profile, count(*) FILTER (status <> 'needs_review') AS confirmed, count(*) FILTER (status = 'confirmed_error') AS errors, count(*) FILTER (status = 'needs_review') AS reviews, count(*) AS n FROM nc GROUP BY profile)
    SELECT profile, confirmed, errors, reviews, CAST(coalesce(round_even(errors / nullif(confirmed, 0), 6), 0) AS DECIMAL(20,6)) AS error_rate, confirmed >= 5 AND errors >= 3 AND reviews * 10 <= n * 6 AS eligible,
    concat_ws(',', CASE WHEN confirmed < 5 THEN 'insufficient_confirmed_samples' END, CASE WHEN errors < 3 THEN 'insufficient_confirmed_errors' END, CASE WHEN reviews * 10 > n * 6 THEN 'too_many_ambiguous_samples' END) AS reasons FROM g""",
)
def a12(t: Tables) -> DataFrame:
    rows = evaluation.policy_candidates(learning.normalize_cases(case_rows(t)), 5, 3, 0.6)
    return rows.withColumn("reasons", joined(F.col("reasons")))


@query(
    "A14_service_days",
    """SELECT CAST(ts + INTERVAL '8' HOUR AS DATE) AS day, count(*) AS calls, count(*) FILTER (ok) AS success, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (fallback) AS fallbacks,
    CAST(coalesce(sum(latency_ms) FILTER (ok) // nullif(count(*) FILTER (ok), 0), 0) AS BIGINT) AS avg_latency_ms, CAST(round_even(count(*) FILTER (ok AND cache_hit) * 100 / count(*), 1) AS DECIMAL(5,1)) AS cache_hit_percent,
    CAST(round_even(count(*) FILTER (ok AND enhanced_used) * 100 / count(*), 1) AS DECIMAL(5,1)) AS enhanced_percent FROM service_call GROUP BY 1""",
)
def a14(t: Tables) -> DataFrame:
    return evaluation.service_days(t.service_call)


@query("A15_worker_counters", "SELECT provider_id, count(*) AS runs, CAST(sum(latency_ms) AS BIGINT) AS total_ms, CAST(sum(latency_ms) // count(*) AS BIGINT) AS average_ms FROM service_call GROUP BY provider_id")
def a15(t: Tables) -> DataFrame:
    return evaluation.worker_counters(t.service_call, ["provider_id"])


def rolling_rows(t: Tables) -> DataFrame:
    row = lambda kind, card, raw: t.rolling_event.select("ts", "image_id", F.lit(kind).alias("kind"), F.col(card).alias("card"), codes.clean(F.col(raw)).alias("canonical"))
    return row("long", "card", "raw_candidate").unionByName(row("short", "short_card", "short_card"))


@query(
    "A16_cache_figures",
    """WITH r AS (SELECT ts, image_id, 'long' AS kind, card, upper(trim(raw_candidate)) AS canonical FROM rolling_event UNION ALL SELECT ts, image_id, 'short', short_card, short_card FROM rolling_event),
    w AS (SELECT * FROM r WHERE ts > TIMESTAMP '2024-01-19 12:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00')
    SELECT count(DISTINCT image_id) AS images, count(DISTINCT card) AS codes, count(DISTINCT CASE WHEN kind = 'long' THEN card END) AS long_codes, count(DISTINCT CASE WHEN kind = 'short' THEN card END) AS short_codes,
    count(canonical) - count(DISTINCT canonical) AS repeats FROM w""",
)
def a16(t: Tables) -> DataFrame:
    day = rolling_rows(t).where("ts > TIMESTAMP_NTZ '2024-01-19 12:00:00' AND ts <= TIMESTAMP_NTZ '2024-01-20 12:00:00'")
    return evaluation.cache_figures(day)


@query(
    "S6_price_levels",
    """WITH p AS (SELECT seq, [json_extract_string(body, '$.data.sell[0].price'), json_extract_string(body, '$.data.sell[1].price'), json_extract_string(body, '$.data.sell[2].price'), json_extract_string(body, '$.data.sell[3].price')] AS l,
      json_extract_string(body, '$.data[0].usdCny') AS f FROM order_book),
    q AS (SELECT seq, CASE WHEN len(list_filter(l, lambda x: x IS NOT NULL)) > 0 THEN list_filter(l, lambda x: x IS NOT NULL) WHEN f IS NOT NULL THEN [f] ELSE [] END AS levels FROM p)
    SELECT seq, unnest(levels[1:2]) AS price0, generate_subscripts(levels[1:2], 1) - 1 AS level FROM q""".replace("unnest(levels[1:2]) AS price0", "CAST(unnest(levels[1:2]) AS DECIMAL(18,8)) AS price"),
)
def s6(t: Tables) -> DataFrame:
    levels = t.order_book.select("seq", F.posexplode(payloads.price_levels(F.col("body"), 2)).alias("level", "price"))
    return levels.select("seq", F.col("level").cast("long").alias("level"), "price")


@query(
    "S7_first_filled_source",
    """SELECT kind, card FROM (SELECT DISTINCT 'short' AS kind, short_card AS card FROM rolling_event) AS s""",
)
def s7(t: Tables) -> DataFrame:
    rolling = t.rolling_event
    empty = rolling.where("card = 'none'").select(F.lit("none").alias("kind"), F.col("card"))
    short = rolling.select(F.lit("short").alias("kind"), F.col("short_card").alias("card")).distinct()
    long = rolling.select(F.lit("long").alias("kind"), "card").distinct()
    return files.first_filled([empty, short, long])


@query(
    "S8_nested_codes",
    """SELECT event_id AS record_id, unnest([code_a, code_b, code_s]) AS code, 'unknown_font' AS font_hash, CAST(unnest([0, 1, 2]) AS INT) AS pos FROM audit_base""",
)
def s8(t: Tables) -> DataFrame:
    record = F.to_json(
        F.struct(
            F.col("code_a").alias("card"), F.array(F.col("code_b"), F.lit("noise")).alias("cards"),
            F.array(F.struct(F.col("code_s").alias("value"), F.array("code_a").alias("ocr_cards"))).alias("candidate_list"),
        )
    )
    found = files.nested_codes(t.audit_base.select(F.col("event_id").alias("record_id"), record.alias("body")))
    return found.drop("font_template")


@query(
    "S3_case_manifests",
    "SELECT profile, case_id, status, expected_long FROM audit_case",
)
def s3(t: Tables) -> DataFrame:
    folder = _folder(t, "manifests")
    cases = case_rows(t).select(
        "profile", F.struct("case_id", "status", "error_types", F.col("expected_long"), "expected_short", F.col("content_md5").alias("image_hash")).alias("case")
    )
    files.write_json(cases.select("profile", F.array("case").alias("cases")), folder)
    found = files.read_manifests(t.spark, folder)
    return found.select("profile", "case_id", "status", joined(F.col("expected_long")).alias("expected_long"))


def _folder(t: Tables, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "S1_audit_scan",
    "SELECT message_id, chat_id, user_id, username, final_long FROM audit_record WHERE dt = DATE '2024-01-10'",
)
def s1(t: Tables) -> DataFrame:
    folder = _folder(t, "audit")
    rows = t.audit_record
    source = F.struct("chat_id", "chat_title", "user_id", "username")
    files.write_audit(
        rows.select("dt", "message_id", "file_unique_id", source.alias("source"), codes.split_list(F.col("final_long")).alias("final_cards"), "status"), folder
    )
    found = files.read_audit(t.spark, folder, "2024-01-10")
    return found.select("message_id", "chat_id", "user_id", "username", joined(F.col("final_long")).alias("final_long"))


@query("S4_benchmark_manifest", "SELECT name, profile, expected_long FROM benchmark_result")
def s4(t: Tables) -> DataFrame:
    folder = _folder(t, "benchmark")
    case = F.struct("name", codes.split_list(F.col("expected_long")).alias("expected_long"))
    files.write_json(t.benchmark_result.select("profile", F.array(case).alias("cases")), folder)
    cases = files.require_cases(files.read_manifests(t.spark, folder))
    return cases.select("name", "profile", joined(F.col("expected_long")).alias("expected_long"))


@query("S9_hashed_files")
def s9(t: Tables) -> DataFrame:
    """Content hashes of the table files themselves."""
    hashed = files.hash_files(t.spark, t.folder, "*.parquet")
    return hashed.select(F.substring_index("path", "/", -1).alias("file"), "length", "content_hash")


@query(
    "S10_report_sink",
    "SELECT source AS profile, count(*) AS docs FROM @documents GROUP BY source",
)
def s10(t: Tables) -> DataFrame:
    folder = _folder(t, "reports")
    files.write_json(t.documents.groupBy(F.col("source").alias("profile")).agg(F.count("*").alias("docs")), folder)
    return t.spark.read.schema("profile string, docs long").json(folder)


@query(
    "S11_training_sink",
    """SELECT concat('images/', content_md5, '.png') AS file, upper(expected_long) AS label FROM (SELECT *, row_number() OVER (PARTITION BY content_md5 ORDER BY seq) AS r FROM audit_case) AS x
    WHERE r = 1 AND expected_long <> '' AND NOT contains(expected_long, ',') AND expected_short = ''""",
)
def s11(t: Tables) -> DataFrame:
    folder = _folder(t, "training")
    files.write_training(learning.training_split(case_rows(t).withColumnRenamed("content_md5", "content_hash")), folder)
    return t.spark.read.schema("file string, label string").option("sep", "\t").csv(f"{folder}/labels")


@query(
    "S9_content_hashes",
    """SELECT source, CAST(octet_length(encode(string_agg(doc_id, chr(10) ORDER BY doc_id))) + 1 AS BIGINT) AS length, sha256(string_agg(doc_id, chr(10) ORDER BY doc_id) || chr(10)) AS content_hash
    FROM (SELECT source, CAST(doc_id AS VARCHAR) AS doc_id FROM @documents) AS d GROUP BY source""",
)
def s9b(t: Tables) -> DataFrame:
    """One file a source with the ids of its documents, hashed as bytes."""
    folder = _folder(t, "hashed")
    ids = t.documents.groupBy("source").agg(F.concat_ws("\n", F.sort_array(F.collect_list(F.col("doc_id").cast("string")))).alias("value"))
    ids.write.partitionBy("source").text(folder)
    hashed = files.hash_files(t.spark, folder, "*.txt")
    return hashed.select(F.regexp_extract("path", "source=([^/]+)/", 1).alias("source"), "length", "content_hash")


@query(
    "S8_nested_anywhere",
    """SELECT event_id AS record_id, unnest([code_b, code_s, code_a]) AS code, unnest(['f1', 'unknown_font', 'unknown_font']) AS font_hash, unnest(['t1', NULL, NULL]) AS font_template, CAST(unnest([0, 1, 2]) AS INT) AS pos
    FROM audit_base WHERE code_a <> code_b""",
)
def s8b(t: Tables) -> DataFrame:
    """A list in a list as the root, results of results, a font of its own, repeats and keys that do not count."""
    own = F.struct(F.col("code_b").alias("best_candidate"), F.lit("f1").alias("font_hash"), F.lit("t1").alias("font_template"), F.col("code_a").alias("other"))
    deep = F.struct(F.array(F.struct(F.array(own).alias("results"))).alias("results"))
    plain = F.struct(F.array(F.array(F.col("code_s"), F.lit("noise")), F.array("code_a", "code_b")).alias("cards"))
    body = F.concat(F.lit("[[ "), F.to_json(deep), F.lit("],\n ["), F.to_json(plain), F.lit("] ]"))
    return files.nested_codes(t.wide.audit_base.where("code_a <> code_b").select(F.col("event_id").alias("record_id"), body.alias("body")))


@query("S1_indented_audit", "SELECT message_id, chat_id, user_id, username, final_long FROM audit_record WHERE dt = DATE '2024-01-10'")
def s1b(t: Tables) -> DataFrame:
    """Records as the writer of the audit indents them, one file each, short codes under their other name."""
    folder = _folder(t, "indented")
    rows = t.audit_record.where("dt = DATE '2024-01-10'")
    record = F.struct("message_id", F.struct("chat_id", "chat_title", "user_id", "username").alias("source"), codes.split_list(F.col("final_long")).alias("final_cards"))
    body = F.to_json(record, {"pretty": "true"})
    files.write_each(rows.select(F.lit("2024-01-10").alias("dt"), "message_id", body.alias("value")), "message_id", ["dt"], folder)
    found = files.read_audit(t.spark, folder, "2024-01-10")
    return found.select("message_id", "chat_id", "user_id", "username", joined(F.col("final_long")).alias("final_long"))


@query("S3_indented_manifests", "SELECT profile, case_id, status, expected_long FROM audit_case")
def s3b(t: Tables) -> DataFrame:
    """One indented manifest a profile, hashes and codes under their other names."""
    folder = _folder(t, "manifest")
    cases = case_rows(t).select("profile", F.struct("case_id", "status", F.col("expected_long").alias("expected_pubg"), F.col("content_md5").alias("image_sha256")).alias("case"))
    manifests = cases.groupBy("profile").agg(F.collect_list("case").alias("cases"))
    body = F.to_json(F.struct(F.lit(1).alias("schema_version"), "profile", "cases"), {"pretty": "true"})
    manifests.select(F.md5("profile").alias("name"), body.alias("value")).write.partitionBy("name").text(folder)
    found = files.read_manifests(t.spark, folder)
    return found.select("profile", "case_id", "status", joined(F.col("expected_long")).alias("expected_long"))
