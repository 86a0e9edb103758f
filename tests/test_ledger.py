"""Ledger goldens and invariants."""

from datetime import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerlens.functions import commands
from ledgerlens.operators import ledger
from ledgerlens.operators.blocks import Running, attach_stats, running

UTC8 = 8


def test_fee_and_rate_snapshots(spark):
    rows = [(1, "income", Decimal("50000"), Decimal("10"), Decimal("10")), (2, "income", Decimal("50000"), Decimal("6.8"), Decimal("10")), (3, "payout", Decimal("488"), Decimal("6.8"), Decimal("10"))]
    df = spark.createDataFrame(rows, "id int, kind string, amount decimal(18,2), rate decimal(12,4), fee_percent decimal(12,4)")
    got = {r["id"]: (r["fee_amount"], r["payable_amount"], r["payable_usdt"]) for r in ledger.post_entries(df).collect()}
    assert got[1] == (Decimal("5000.00"), Decimal("45000.00"), Decimal("4500.00"))
    assert got[2] == (Decimal("5000.00"), Decimal("45000.00"), Decimal("6617.65"))
    assert got[3] == (Decimal("0.00"), Decimal("488.00"), Decimal("488.00"))


def _utc(y, m, d, h, minute=0):
    from datetime import timedelta

    return datetime(y, m, d, h, minute) - timedelta(hours=UTC8)


def test_moved_cutoff_keeps_the_open_period(spark):
    changes = spark.createDataFrame([(-1, 5, _utc(2026, 9, 13, 4), 12, True)], "chat_id long, seq long, ts timestamp_ntz, reset_hour int, has_entries boolean")
    states = ledger.cutoff_states(changes)
    events = [(-1, 1, _utc(2026, 9, 13, 2)), (-1, 2, _utc(2026, 9, 13, 3)), (-1, 6, _utc(2026, 9, 13, 11)), (-1, 7, _utc(2026, 9, 13, 12)), (-1, 8, _utc(2026, 9, 14, 13)), (-1, 9, _utc(2026, 9, 15, 13))]
    df = spark.createDataFrame(events, "chat_id long, seq long, ts timestamp_ntz")
    got = {r["seq"]: (r["accounting_date"], r["previous_date"]) for r in ledger.assign_periods(df, states).collect()}
    assert got[1] == ("2026-09-12", "2026-09-11")
    assert got[2] == ("2026-09-13", "2026-09-12")
    assert got[6] == ("2026-09-13", "2026-09-12")
    assert got[7] == ("2026-09-13T12:00:00+08:00", "2026-09-13")
    assert got[8] == ("2026-09-14", "2026-09-13T12:00:00+08:00")
    assert got[9] == ("2026-09-15", "2026-09-14")
    chats = spark.createDataFrame([(-1,)], "chat_id long")
    due = F.lit(_utc(2026, 9, 13, 9)).cast("timestamp_ntz")
    closed = ledger.closed_periods(states, chats, due).first()
    assert (closed["accounting_date"], closed["cutoff_at"]) == ("2026-09-12", datetime(2026, 9, 13, 3))
    later = ledger.closed_periods(states, chats, F.lit(_utc(2026, 9, 14, 9)).cast("timestamp_ntz")).first()
    assert later["cutoff_at"] == datetime(2026, 9, 13, 12)


def _messages(spark, texts):
    rows = [
        (-1, i, _utc(2026, 9, 9, 10, i % 60), who, f"u{who}", f"User {who}", text, reply, reply_text, who_reply, f"u{who_reply}" if who_reply else None, 1)
        for i, (who, text, reply, reply_text, who_reply) in enumerate(texts, start=1)
    ]
    return spark.createDataFrame(
        rows + [rows[1]],
        "chat_id long, message_id long, ts timestamp_ntz, user_id long, username string, display_name string, text string, reply_message_id long, reply_text string, "
        "reply_user_id long, reply_username string, delivery int",
    )


def test_replay_applies_settings_voids_and_permissions(spark):
    plain = lambda who, text: (who, text, None, None, None)
    texts = [
        plain(7, "设置汇率 10"), plain(7, "+50000 first"), plain(9, "设置汇率 2"), (7, "添加操作员", None, None, 9), plain(9, "设置费率 10"),
        plain(7, "+50000"), plain(7, "下发 488 bob"), plain(7, "-20"), (7, "撤销", 6, None, None), (7, "撤销", None, "#2", None),
        plain(7, "关闭记账"), plain(7, "+1"), plain(7, "开启"), plain(7, "入款300，x"), plain(7, "+0"),
    ]
    owners = spark.createDataFrame([(-1, 7)], "chat_id long, owner_id long")
    rows = {r["id"]: r for r in ledger.replay(_messages(spark, texts), owners).collect()}
    assert sorted(rows) == [2, 6, 7, 8, 14]
    assert rows[2]["payable_usdt"] == Decimal("5000.00")
    assert rows[6]["payable_usdt"] == Decimal("4500.00")
    assert rows[6]["voided_at"] is not None
    # After the first undo the live entries are 2, 7, 8: number two is the payout.
    assert rows[7]["voided_at"] is not None and rows[8]["voided_at"] is None
    assert rows[8]["amount"] == Decimal("-20.00") and rows[14]["note"] == "x" and rows[7]["note"] == "bob" and rows[6]["note"] == "User 7"


def test_clear_restarts_the_ledger(spark):
    plain = lambda text: (7, text, None, None, None)
    owners = spark.createDataFrame([(-1, 7)], "chat_id long, owner_id long")
    texts = [plain("+10"), plain("+20"), plain("清账"), plain("+30"), (7, "撤销", None, "#1", None), plain("+40")]
    rows = {r["id"]: r["voided_at"] is None for r in ledger.replay(_messages(spark, texts), owners).collect()}
    assert rows == {4: False, 6: True}


def test_command_notes(spark):
    cases = {"+50 - hello": ("income", Decimal("50"), "hello"), "/income 100": ("income", Decimal("100"), "come"), "下发-5 x": ("payout", Decimal("-5"), "x"), "上分 １２．5": ("income", Decimal("12"), "．5")}
    df = spark.createDataFrame([(t,) for t in cases], "text string")
    got = {r["text"]: (r["kind"], r["amount"].normalize() + 0, r["note"]) for r in commands.parse_messages(df).collect()}
    assert {k: (a, float(b), c) for k, (a, b, c) in got.items()} == {k: (a, float(b), c) for k, (a, b, c) in cases.items()}


def test_void_last_walks_backwards(spark):
    log = [(1, "a"), (2, "b"), (3, None), (4, None), (5, None), (6, "c"), (7, "d"), (8, None), (9, "e"), (10, None), (11, None)]
    rows = [(-1, seq, seq if e else None) for seq, e in log]
    df = spark.createDataFrame(rows, "chat_id long, seq long, entry_id long")
    got = {r["seq"]: r["voided_id"] for r in ledger.void_last(df).collect()}
    assert got == {3: 2, 4: 1, 5: None, 8: 7, 10: 9, 11: 6}


def test_running_matches_a_plain_window_across_blocks(spark):
    from pyspark.sql import Window

    df = spark.range(500).select((F.col("id") % 2).alias("k"), (F.col("id") * 3).alias("seq"), F.when(F.col("id") % 7 == 0, F.col("id")).alias("v"))
    specs = [Running("s", "sum", F.col("v")), Running("m", "max", F.col("v"), inclusive=False), Running("l", "last", F.col("v"), inclusive=False)]
    w = Window.partitionBy("k").orderBy("seq")
    want = df.select(
        "seq", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s"), F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("m"),
        F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("l"),
    )
    got = running(df, ["k"], "seq", specs, block=16).select("seq", "s", "m", "l")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_salted_stats_join_keeps_every_row(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    stats = df.groupBy("k").agg(F.count("*").alias("n"))
    got = attach_stats(df, stats, ["k"], "n", hot_rows=20)
    assert got.count() == 1000 and got.where("n IS NULL").count() == 0
    assert got.where("k = 0").select("n").distinct().count() == 1


def test_voided_ranks_select_like_a_list():
    import random

    from ledgerlens.operators.ledger import VoidedRanks

    for seed, most in ((1, 40), (2, 5000), (3, 2048)):
        rng, gone, live = random.Random(seed), VoidedRanks(), list(range(1, most + 1))
        for _ in range(min(most - 1, 1500)):
            if rng.random() < 0.7:
                number = rng.randint(1, len(live))
                rank = gone.nth_live(number)
                assert rank == live[number - 1]
            else:
                rank = rng.choice(live)
            assert rank not in gone
            gone.add(rank)
            live.remove(rank)
            assert rank in gone
        assert gone.nth_live(len(live) + 7) == most + 7
