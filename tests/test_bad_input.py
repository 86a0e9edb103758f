"""Rows that must not fail a job or be lost: numbers out of range, odd prefixes, small Arrow batches."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerlens import session
from ledgerlens.functions import commands
from ledgerlens.operators import inventory, ledger, sessions
from ledgerlens.sources import payloads
from ledgerlens.streaming import jobs


def test_numbers_out_of_range(spark):
    texts = ["+12345678901234567890123", "+5", "设置汇率 123456789", "设置汇率 12345678901234567890123", "-0"]
    rows = commands.parse_messages(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "seq long, text string")).orderBy("seq").collect()
    assert [r["verb"] for r in rows] == [commands.BAD_NUMBER, "entry", "set_rate", commands.BAD_NUMBER, "show_bill"]
    assert spark.range(1).select(commands.entry_number(F.lit("#99999999999999999999")).alias("n")).first()["n"] is None


def test_prices_that_are_no_numbers(spark):
    bodies = ['{"data": {"sell": [{"price": "n/a"}, {"price": "7.1"}]}}', '{"data": [{"usdCny": "none"}]}', "broken"]
    rows = spark.createDataFrame([(b,) for b in bodies], "body string").select(payloads.price_levels(F.col("body")).alias("v")).collect()
    assert [[float(x) for x in r["v"]] for r in rows] == [[7.1], [], []]


def test_blank_legacy_amounts(spark):
    columns = ("kind", "amount", "rate", "fee_percent", "fee_amount", "payable_amount", "payable_usdt", "net_amount")
    rows = [("income", "100", "5", "", "", "", "", ""), ("income", "x", "0", "", "", "", "", "y")]
    got = ledger.backfill_legacy(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))).collect()
    assert [r["net_amount"] for r in got] == ["20.00", "y"]


def test_more_prefix_lengths_than_a_code_has_characters(spark):
    rules = [("S0730", "good")] + [("S0" + "9" * n, "long") for n in range(20, 45)]
    records = spark.createDataFrame([("S07304-AAAA-BBBB-CCCCC",)], "final_card string")
    labelled = inventory.classify_by_prefix(records, spark.createDataFrame(rules, "prefix string, denomination string"))
    assert labelled.first()["rule_label"] == "good"


def test_empty_patch_keeps_the_version(spark):
    fields = "final_card string, denomination string, redeemed boolean, stocked boolean, viewed boolean, invalid boolean, deleted boolean"
    records = spark.createDataFrame(
        [(i, "A", "x", False, False, False, False, False, False, 1) for i in (1, 2, 3)],
        "id long, final_card string, denomination string, is_redeemed boolean, is_stocked boolean, is_viewed boolean, is_invalid boolean, is_deleted boolean, is_ocr_failed boolean, change_version long",
    )
    nothing = (None,) * 6
    patches = spark.createDataFrame([(1, 5, *nothing, None), (2, 6, *nothing, False), (3, 7, *nothing, True), (3, 8, *nothing, True)], f"record_id long, version long, {fields}")
    got = {r["id"]: r["change_version"] for r in inventory.apply_patches(records, patches).collect()}
    assert got == {1: 1, 2: 1, 3: 7}


def _events(n, seed):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    rows = [(1 + i % 3 // 2, i, start + timedelta(seconds=rng.randint(0, 2000)), rng.randint(1, 2)) for i in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.fixture
def small_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    yield
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_streams_do_not_depend_on_arrow_batches(spark, tmp_path, small_batches):
    frame = spark.createDataFrame(_events(400, 1), "chat_id long, seq long, ts timestamp_ntz, user_id long")
    timed = frame.withColumn("at", sessions.micros(F.col("ts")))
    timed.coalesce(1).write.parquet(f"{tmp_path}/input")
    stream = jobs.read_rows(spark, f"{tmp_path}/input")
    jobs.run(jobs.cooldown_stream(stream.select("chat_id", "seq", "at")), f"{tmp_path}/gate")
    gate = {(r["chat_id"], r["seq"]) for r in spark.read.parquet(f"{tmp_path}/gate/rows").collect()}
    assert gate == {(r["chat_id"], r["seq"]) for r in sessions.cooldown(frame, "chat_id").collect()}
    jobs.run(jobs.limit_stream(stream.select("chat_id", "seq", "at", "user_id")), f"{tmp_path}/limit")
    verdicts = {(r["chat_id"], r["seq"]): r["verdict"] for r in spark.read.parquet(f"{tmp_path}/limit/rows").collect()}
    want, recent = {}, {}
    for chat, seq, ts, user in sorted(_events(400, 1), key=lambda e: (e[2], e[1])):
        kept = [x for x in recent.get(chat, []) if x[0] >= ts - timedelta(seconds=sessions.WINDOW)]
        if len(kept) >= sessions.CHAT_LIMIT:
            verdict = "chat_limit"
        elif sum(u == user for _, u in kept) >= sessions.USER_LIMIT:
            verdict = "user_limit"
        else:
            verdict = "accepted"
            kept.append((ts, user))
        recent[chat] = kept
        want[chat, seq] = verdict
    assert verdicts == want


def test_report_publishes_every_closed_day(spark, tmp_path):
    columns = "dt date, chat_id long, user_id long, chat_title string, username string, message_id long, file_unique_id string, record_path string, final_long array<string>, final_short array<string>"
    day = lambda d, n: (datetime(2024, 1, d).date(), 1, 1, "t", "u", n, f"f{n}", f"r{n}", ["S07304-AAAA-BBBB-CCCCC"], [])
    publish = jobs.daily_report_job(str(tmp_path))
    publish(spark.createDataFrame([day(1, 1), day(2, 2), day(3, 3)], columns), 0)
    days = lambda: {r["dt"].day: r["images"] for r in spark.read.parquet(f"{tmp_path}/reports").collect()}
    assert days() == {1: 1, 2: 1}
    publish(spark.createDataFrame([day(6, 4), day(2, 5)], columns), 1)
    assert days() == {1: 1, 2: 2, 3: 1}


def test_grants_need_the_ledger_on(spark):
    columns = "chat_id long, seq long, verb string, user_id long, is_owner boolean, reply_user_id long"
    log = [(-1, 1, "disable", 1, True, None), (-1, 2, "add_operator", 1, True, 9), (-1, 3, "enable", 9, False, None), (-1, 4, "enable", 1, True, None), (-1, 5, "add_operator", 1, True, 8), (-1, 6, "disable", 8, False, None), (-1, 7, "add_operator", 1, True, 7), (-1, 8, "enable", 8, False, None)]
    got = ledger.resolve_grants(spark.createDataFrame(log, columns)).collect()
    assert sorted(r["seq"] for r in got) == [1, 4, 5, 6, 8]


def test_shared_folder_must_be_set_on_a_cluster():
    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        conf, sparkContext = {}, Context

    with pytest.raises(ValueError):
        session.shared_folder(Session)


def test_owner_photos_are_not_counted(spark):
    start = datetime(2024, 1, 1)
    rows = [(1, i, start + timedelta(milliseconds=i), 5 if i % 2 else 6, i % 2 == 0) for i in range(40)]
    frame = spark.createDataFrame(rows, "chat_id long, seq long, ts timestamp_ntz, user_id long, owner boolean")
    got = {r["seq"]: r["verdict"] for r in sessions.rate_limit(frame, 60, 10, 8).collect()}
    assert got == {i: "accepted" if i % 2 == 0 or i < 16 else "user_limit" for i in range(40)}


def test_running_without_keys_over_many_blocks(spark, monkeypatch):
    from ledgerlens.operators import blocks

    monkeypatch.setattr(blocks, "BLOCK", 3)
    specs = [blocks.Running("s", "sum", F.col("id")), blocks.Running("l", "last", F.when(F.col("id") % 7 == 0, F.col("id")), inclusive=False), blocks.Running("m", "max", -F.col("id"))]
    rows = blocks.running(spark.range(100), [], "id", specs, block=4).orderBy("id").collect()
    for i, r in enumerate(rows):
        assert (r["s"], r["m"], r["l"]) == (i * (i + 1) // 2, 0, None if i == 0 else (i - 1) // 7 * 7)


def test_longest_prefix_by_either_route(spark):
    from ledgerlens.operators import inventory

    rules = spark.createDataFrame([("S07", "a"), ("S0730", "b"), ("S07304-A", "c"), ("S07304-AAAA-BBBB-CCCCC", "d"), ("S07304-AAAA-BBBB-CCCCCX", "e"), ("X", "f")], "prefix string, denomination string")
    codes = ["S07304-AAAA-BBBB-CCCCC", " s07304-abbb-bbbb-ccccc", "S0731", "S0730", "XYZ", "", None, "S0731", "S07"]
    records = spark.createDataFrame(list(enumerate(codes)), "id long, final_card string")
    want = ["d", "c", "a", "b", inventory.UNCLASSIFIED, inventory.UNCLASSIFIED, inventory.UNCLASSIFIED, "a", "a"]
    for small in (inventory.SMALL_RULES, 1):
        out = inventory.classify_by_prefix(records, rules, small=small)
        assert out.columns == ["id", "final_card", "rule_label"]
        assert [r["rule_label"] for r in out.orderBy("id").collect()] == want
    assert {r["rule_label"] for r in inventory.classify_by_prefix(records, rules.limit(0)).collect()} == {inventory.UNCLASSIFIED}
