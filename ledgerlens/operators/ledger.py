"""Ledger: postings, settings in force, accounting periods, bills, voids, closed balances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import commands
from ledgerlens.functions.money import MONEY, local_iso, local_time, money, rate
from ledgerlens.operators.blocks import Running, first_per_key, running
from ledgerlens.session import cut

# Verbs that change the ledger.
STATE_VERBS = ("enable", "disable", "set_cutoff", "set_rate", "set_fee", "add_operator", "remove_operator", "undo", "clear", "entry")
DEFAULT_RATE, DEFAULT_FEE, DEFAULT_RESET_HOUR = "1.0000", "0.0000", 3


# -- settings ---------------------------------------------------------------------------------


def setting_verdicts(settings: DataFrame) -> DataFrame:
    """Add ``reject_reason``; a null reason means every given value is acceptable."""
    fee, hour, new_rate = F.col("fee_percent"), F.col("reset_hour"), F.col("rate")
    return settings.withColumn(
        "reject_reason",
        F.when(new_rate <= 0, "rate_not_positive")
        .when(fee < 0, "fee_negative")
        .when(fee >= 100, "fee_not_below_100")
        .when((hour < 0) | (hour > 23), "reset_hour_out_of_range"),
    )


def posting_verdicts(postings: DataFrame) -> DataFrame:
    """Reject unknown kinds and amounts that round to zero."""
    return postings.withColumn(
        "reject_reason",
        F.when(~F.col("kind").isin("income", "payout"), "kind_unknown").when(
            money(F.col("amount")) == 0, "amount_zero"
        ),
    )


def settings_in_force(log: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """For each log row the latest value of every setting given strictly before it."""
    specs = [Running(f"{c}_in_force", "last", F.col(c), inclusive=False) for c in columns]
    return running(log, keys, order, specs)


def chat_owners(events: DataFrame) -> DataFrame:
    """First owner wins unless a replacement names a newer one."""
    owner, seq = F.col("owner_id"), F.col("seq")
    replaced = F.max_by(owner, F.when(F.col("owner_replace") & owner.isNotNull(), seq))
    first = F.min_by(owner, F.when(owner.isNotNull(), seq))
    return events.groupBy("chat_id").agg(F.coalesce(replaced, first).alias("owner_id"))


def operators_at(log: DataFrame, order: str) -> DataFrame:
    """Add ``is_operator``: the user's latest add / remove before the row was an add."""
    change = F.when(F.col("op").isin("add_operator", "remove_operator"), F.col("op") == "add_operator")
    return running(log, ["chat_id", "user_id"], order, [Running("is_operator", "last", change, inclusive=False)]).withColumn(
        "is_operator", F.coalesce("is_operator", F.lit(False))
    )


def price_in_force(log: DataFrame) -> DataFrame:
    """Use-realtime commands take the newest feed snapshot; an empty snapshot keeps the old rate.

    ``log`` holds snapshots (``is_snapshot`` with a nullable ``price``) and commands (``chat_id``,
    ``manual_rate`` or null for a realtime command), ordered by ``seq``.
    """
    snapshot = F.when(F.col("is_snapshot"), F.struct(F.col("price")))
    priced = running(log, [], "seq", [Running("snapshot", "last", snapshot, inclusive=False)]).where("NOT is_snapshot")
    realtime = F.col("manual_rate").isNull()
    applied = F.coalesce(F.col("manual_rate"), rate(F.col("snapshot.price")))
    state = F.when(applied.isNotNull(), F.struct(applied.alias("rate"), realtime.alias("is_realtime")))
    ruled = running(priced, ["chat_id"], "seq", [Running("state", "last", state)])
    return ruled.select(
        "seq",
        "chat_id",
        F.coalesce("state.rate", F.lit(DEFAULT_RATE).cast("decimal(12,4)")).alias("rate"),
        F.coalesce("state.is_realtime", F.lit(False)).alias("is_realtime"),
        applied.isNull().alias("kept_old"),
    )


# -- postings ---------------------------------------------------------------------------------


def post_entries(postings: DataFrame) -> DataFrame:
    """Snapshot fee, payable and settlement amounts; payouts pass through."""
    income = F.col("kind") == "income"
    amount = money(F.col("amount"))
    fee = F.when(income, money(amount * F.col("fee_percent") / 100)).otherwise(F.lit(0).cast(MONEY))
    with_fee = postings.withColumn("amount", amount).withColumn("fee_amount", fee)
    payable = money(F.col("amount") - F.col("fee_amount"))
    usdt = F.when(income, money(F.col("payable_amount") / F.col("rate"))).otherwise(F.col("payable_amount"))
    return with_fee.withColumn("payable_amount", payable).withColumn("payable_usdt", usdt).withColumn(
        "net_amount", F.col("payable_usdt")
    )


def backfill_legacy(entries: DataFrame) -> DataFrame:
    """Fill missing snapshot columns of old rows from kind, amount and rate (text columns)."""
    income = F.col("kind") == "income"
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    zero = lambda c: blank(c) | (F.col(c) == "0.00")
    converted = money(F.col("amount").try_cast(MONEY) / F.nullif(F.col("rate").try_cast("decimal(12,4)"), F.lit(0))).cast("string")
    no_net = F.coalesce(F.col("net_amount").try_cast(MONEY), F.lit(0)) == 0
    return entries.select(
        *[c for c in entries.columns if c not in ("fee_percent", "fee_amount", "payable_amount", "payable_usdt", "net_amount")],
        F.when(blank("fee_percent"), "0.0000").otherwise(F.col("fee_percent")).alias("fee_percent"),
        F.when(blank("fee_amount"), "0.00").otherwise(F.col("fee_amount")).alias("fee_amount"),
        F.when(income & zero("payable_amount"), F.col("amount"))
        .when(blank("payable_amount"), F.col("amount"))
        .otherwise(F.col("payable_amount"))
        .alias("payable_amount"),
        F.when(income & zero("payable_usdt") & no_net, converted)
        .when(zero("payable_usdt"), F.col("net_amount"))
        .otherwise(F.col("payable_usdt"))
        .alias("payable_usdt"),
        F.when(income & zero("net_amount"), converted)
        .when(blank("net_amount"), F.col("amount"))
        .otherwise(F.col("net_amount"))
        .alias("net_amount"),
    )


def insert_new(existing: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of ``incoming`` whose receipt key is new; repeats inside the batch keep the first."""
    fresh = incoming.join(existing.select(*keys), keys, "left_anti")
    return first_per_key(fresh, keys, [order])


def select_entries(
    entries: DataFrame,
    chat_id: int,
    *,
    start_at: Column | None = None,
    end_at: Column | None = None,
    accounting_date: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Live entries of a chat in id order; the time range is half open."""
    picked = entries.where((F.col("chat_id") == chat_id) & F.col("voided_at").isNull())
    if start_at is not None:
        picked = picked.where(F.col("created_at") >= start_at)
    if end_at is not None:
        picked = picked.where(F.col("created_at") < end_at)
    if accounting_date is not None:
        picked = picked.where(F.col("accounting_date") == accounting_date)
    picked = picked.orderBy("id")
    return picked if limit is None else picked.limit(limit)


def live(entries: DataFrame) -> DataFrame:
    return entries.where(F.col("voided_at").isNull())


def summarize(entries: DataFrame, keys: list[str]) -> DataFrame:
    """Totals per key over live entries, as exact decimals."""
    income = F.col("kind") == "income"
    total = lambda flag, c: F.coalesce(F.sum(F.when(flag, F.col(c))), F.lit(0)).cast("decimal(28,2)")
    return (
        live(entries)
        .groupBy(*keys)
        .agg(
            total(income, "amount").alias("income"),
            total(income, "fee_amount").alias("fees"),
            total(income, "payable_amount").alias("payable_amount"),
            total(income, "payable_usdt").alias("income_usdt"),
            total(~income, "net_amount").alias("payout_usdt"),
            F.count("*").alias("entry_count"),
        )
        .withColumn("balance_usdt", (F.col("income_usdt") - F.col("payout_usdt")).cast("decimal(28,2)"))
    )


# -- accounting periods -----------------------------------------------------------------------


def _at_hour(wall: Column, hour: Column) -> Column:
    return F.date_trunc("day", wall).cast("timestamp_ntz") + F.make_dt_interval(hours=hour)


def _shift(wall: Column, days: int) -> Column:
    return wall + F.expr(f"INTERVAL {days} DAY")


def _day_text(wall: Column, hour: Column, back: int = 0) -> Column:
    return F.date_format(F.date_sub(F.to_date(wall - F.make_dt_interval(hours=hour)), back), "yyyy-MM-dd")


def next_cutoff(wall: Column, hour: Column) -> Column:
    """First cut-over strictly after a business-zone wall clock."""
    today = _at_hour(wall, hour)
    return F.when(today <= wall, _shift(today, 1)).otherwise(today)


def period_keys(wall: Column, hour: Column, boundary: Column, kept_current: Column, kept_previous: Column) -> tuple[Column, Column]:
    """Current and previous period key; a moved cut-over keeps the open period until its boundary."""
    day, before = _day_text(wall, hour), _day_text(wall, hour, 1)
    current = (
        F.when(wall < boundary, kept_current).when(wall < _shift(boundary, 1), local_iso(boundary)).otherwise(day)
    )
    previous = (
        F.when(wall < boundary, kept_previous)
        .when(wall < _shift(boundary, 1), kept_current)
        .when(wall < _shift(boundary, 2), local_iso(boundary))
        .otherwise(before)
    )
    return current, previous


def cutoff_states(changes: DataFrame) -> DataFrame:
    """State after each effective cut-over change of ``changes(chat_id, seq, ts, reset_hour, has_entries)``.

    A change made while an earlier one is still pending keeps the period that was open then, so the
    kept keys are carried forward over the change log.
    """
    key = ["chat_id"]
    valid = changes.where(F.col("reset_hour").between(0, 23)).withColumn("wall", local_time(F.col("ts")))
    seen = running(valid, key, "seq", [Running("old_hour", "last", F.col("reset_hour"), inclusive=False)])
    seen = seen.withColumn("old_hour", F.coalesce("old_hour", F.lit(DEFAULT_RESET_HOUR))).where("reset_hour <> old_hour")
    moved = seen.withColumn("boundary", F.when(F.col("has_entries"), next_cutoff(F.col("wall"), F.col("reset_hour"))))
    pending = running(
        cut(moved), key, "seq", [Running("prior", "last", F.struct("boundary"), inclusive=False)]
    ).withColumn("old_boundary", F.col("prior.boundary"))
    wall, old, hour = F.col("wall"), F.col("old_boundary"), F.col("old_hour")
    waiting = F.coalesce(wall < old, F.lit(False))
    current, previous = period_keys(wall, hour, old, F.lit(None).cast("string"), F.lit(None).cast("string"))
    closed = F.when(~waiting, _shift(next_cutoff(wall, hour), -1))
    kept = running(
        cut(pending),
        key,
        "seq",
        [
            Running("kept_current", "last", F.when(~waiting, current)),
            Running("before_current", "last", F.when(~waiting, current), inclusive=False),
            Running("closed_at", "last", closed),
        ],
    )
    own_previous = F.when(
        ~waiting, F.when(old.isNotNull() & (wall < _shift(old, 1)), F.col("before_current")).otherwise(previous)
    )
    done = running(cut(kept), key, "seq", [Running("kept_previous", "last", own_previous)])
    return cut(done.select("chat_id", "seq", "ts", "reset_hour", "boundary", "kept_current", "kept_previous", "closed_at"))


STATE = ("reset_hour", "boundary", "kept_current", "kept_previous", "closed_at")


def assign_periods(events: DataFrame, states: DataFrame) -> DataFrame:
    """Add ``accounting_date`` and ``previous_date`` to events by the cut-over in force at their seq."""
    columns = [c for c in events.columns if c not in STATE]
    log = events.select(*columns).unionByName(states.select("chat_id", "seq", F.struct(*STATE).alias("__state")), allowMissingColumns=True)
    held = running(log, ["chat_id"], "seq", [Running("__held", "last", F.col("__state"), inclusive=False)])
    held = held.where(F.col("__state").isNull())
    hour = F.coalesce(F.col("__held.reset_hour"), F.lit(DEFAULT_RESET_HOUR))
    current, previous = period_keys(
        local_time(F.col("ts")), hour, F.col("__held.boundary"), F.col("__held.kept_current"), F.col("__held.kept_previous")
    )
    return held.select(*columns, current.alias("accounting_date"), previous.alias("previous_date"))


def closed_periods(states: DataFrame, chats: DataFrame, due: Column) -> DataFrame:
    """Latest closed period and its cut-over per chat at the UTC instant ``due``."""
    latest = states.where(F.col("ts") <= due).groupBy("chat_id").agg(F.max_by(F.struct(*STATE), "seq").alias("s"))
    joined = chats.join(latest, "chat_id", "left")
    wall = local_time(due)
    hour = F.coalesce(F.col("s.reset_hour"), F.lit(DEFAULT_RESET_HOUR))
    boundary = F.col("s.boundary")
    _, previous = period_keys(wall, hour, boundary, F.col("s.kept_current"), F.col("s.kept_previous"))
    waiting = F.coalesce(wall < boundary, F.lit(False))
    cutoff = F.when(waiting, F.col("s.closed_at")).otherwise(_shift(next_cutoff(wall, hour), -1))
    return joined.select("chat_id", previous.alias("accounting_date"), cutoff.alias("cutoff_at")).where("cutoff_at IS NOT NULL")


def overdue_alerts(entries: DataFrame, closed: DataFrame, sent: DataFrame) -> DataFrame:
    """Closed balances not yet handled; negative ones are alerts, the others are marked skipped."""
    keys = ["chat_id", "accounting_date"]
    open_keys = closed.join(sent.select(*keys), keys, "left_anti")
    totals = summarize(entries, keys).select(*keys, "balance_usdt")
    balance = F.coalesce("balance_usdt", F.lit(0)).cast("decimal(28,2)")
    return open_keys.join(totals, keys, "left").select(
        *keys, "cutoff_at", balance.alias("balance_usdt"), F.when(balance < 0, "sending").otherwise("skipped").alias("status")
    )


# -- numbering, voids, clears -----------------------------------------------------------------


def number_live(entries: DataFrame, scope: list[str]) -> DataFrame:
    """Live entries numbered inside their chat (``chat_no``) and inside ``scope`` (``scope_no``)."""
    one = F.lit(1).cast("long")
    numbered = running(live(entries), ["chat_id"], "id", [Running("chat_no", "sum", one)])
    return running(numbered, ["chat_id", *scope], "id", [Running("scope_no", "sum", one)])


def recent_per_kind(entries: DataFrame, keys: list[str], limit: int = 3) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("id")))
    return live(entries).withColumn("recency", rank.cast("long")).where(F.col("recency") <= limit)


def void_by_message(entries: DataFrame, commands_: DataFrame) -> DataFrame:
    """Live entries whose source message a void command replied to."""
    target = commands_.select("chat_id", F.col("reply_message_id").alias("source_message_id")).distinct()
    return live(entries).join(target, ["chat_id", "source_message_id"], "left_semi")


def void_last(log: DataFrame) -> DataFrame:
    """Entry id each "void last" command removes, repeated commands walking backwards.

    ``log(chat_id, seq, entry_id)``; a null ``entry_id`` is a command. Pushes and pops meet at the
    same stack level, so the match is the latest push on that level.
    """
    step = F.when(F.col("entry_id").isNotNull(), 1).otherwise(-1).cast("long")
    depth = running(log, ["chat_id"], "seq", [Running("__d", "sum", step)])
    floor = running(cut(depth), ["chat_id"], "seq", [Running("__m", "min", F.col("__d"))])
    height = F.col("__d") - F.least(F.col("__m"), F.lit(0))
    levelled = floor.withColumn("__h", height)
    before = running(cut(levelled), ["chat_id"], "seq", [Running("__before", "last", F.col("__h"), inclusive=False)])
    level = F.when(F.col("entry_id").isNotNull(), F.col("__h")).otherwise(F.coalesce("__before", F.lit(0)))
    matched = running(
        cut(before.withColumn("__level", level)),
        ["chat_id", "__level"],
        "seq",
        [Running("voided_id", "last", F.col("entry_id"), inclusive=False)],
    )
    found = F.when(F.col("__level") > 0, F.col("voided_id"))
    return matched.where("entry_id IS NULL").select("chat_id", "seq", found.alias("voided_id"))


def clear_epochs(log: DataFrame) -> DataFrame:
    """Add ``epoch``: the number of clear commands of the chat before the row."""
    return running(log, ["chat_id"], "seq", [Running("epoch", "sum", F.col("is_clear").cast("long"), inclusive=False)])


def clear_report(log: DataFrame) -> DataFrame:
    """Per chat and epoch: live rows, and whether a clear removed them."""
    numbered = clear_epochs(log)
    return numbered.groupBy("chat_id", "epoch").agg(
        F.count_if(~F.col("is_clear") & F.col("is_live")).alias("live_rows"),
        F.count_if(~F.col("is_clear")).alias("all_rows"),
        F.max("is_clear").alias("cleared"),
    )


# -- people -----------------------------------------------------------------------------------


def latest_rows(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Upsert: the newest version of every key."""
    return first_per_key(events, keys, [F.desc(c) for c in order])


def people_reached(profiles: DataFrame) -> DataFrame:
    """Distinct human users with their newest profile."""
    people = profiles.where((F.col("user_id") != 0) & ~F.col("is_bot"))
    return latest_rows(people, ["user_id"], ["updated_at", "seq"])


def active_members(profiles: DataFrame, now: Column, days: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Members per chat: all, and seen since the start of the UTC day ``days`` ago."""
    people = profiles.where((F.col("user_id") != 0) & ~F.col("is_bot"))
    counts = [F.count("*").alias("members_all")]
    for span in days:
        since = F.date_trunc("day", now).cast("timestamp_ntz") - F.expr(f"INTERVAL {span} DAY")
        counts.append(F.count_if(F.col("updated_at") >= since).alias(f"members_{span}d"))
    return people.groupBy("chat_id").agg(*counts)


def find_by_handle(profiles: DataFrame, handles: DataFrame) -> DataFrame:
    """Newest known user for each (chat, handle); handles match without ``@`` and case."""
    clean = lambda c: F.lower(F.regexp_replace(c, "^@+", ""))
    known = profiles.withColumn("handle", clean("username")).where("handle <> ''")
    newest = latest_rows(known, ["chat_id", "handle"], ["updated_at", "seq"]).select("chat_id", "handle", "user_id", "display_name")
    asked = handles.select("chat_id", clean("handle").alias("handle")).distinct()
    return asked.join(newest, ["chat_id", "handle"])


# -- replay -----------------------------------------------------------------------------------


def replay(messages: DataFrame, owners: DataFrame) -> DataFrame:
    """Message log to ledger entries with snapshots, period, voids and clears applied.

    Order is ``message_id`` per chat. Repeated deliveries are dropped first; commands count only
    while the ledger is on and, where needed, from owners or operators.
    """
    parsed = commands.parse_messages(messages.where(commands.may_be_command(F.col("text"))))
    reply = F.when(F.col("reply_user_id").isNotNull(), commands.actor_label(F.col("reply_username"), F.lit(""), F.col("reply_user_id")))
    actor = commands.actor_name(F.col("username"), F.col("display_name"), F.col("user_id"))
    narrow = parsed.select(
        "chat_id", "message_id", "delivery", "ts", "user_id", "verb", "setting_value", "kind", "amount", "reply_user_id", "reply_message_id",
        F.when(F.col("verb") == "entry", commands.entry_attribution(F.col("note"), actor, reply)).alias("note"),
        commands.entry_number(F.col("reply_text")).alias("entry_no"),
    )
    once = first_per_key(narrow, ["chat_id", "message_id"], ["delivery"]).withColumnRenamed("message_id", "seq").drop("delivery")
    once = once.where(F.col("verb").isin(*STATE_VERBS))
    owned = once.join(owners, "chat_id", "left").withColumn("is_owner", F.coalesce(F.col("user_id") == F.col("owner_id"), F.lit(False)))
    return _apply_commands(cut(owned.drop("owner_id")))


def _apply_commands(parsed: DataFrame) -> DataFrame:
    allowed = _with_permissions(parsed)
    switch = F.when(F.col("effective") & F.col("verb").isin("enable", "disable"), F.col("verb") == "enable")
    gated = running(allowed, ["chat_id"], "seq", [Running("enabled", "last", switch, inclusive=False)])
    gated = gated.withColumn("enabled", F.coalesce("enabled", F.lit(True)))
    usable = F.col("enabled") & F.col("allowed") & (F.col("chat_id") < 0)
    value = F.col("setting_value").try_cast("decimal(12,4)")
    new_rate = F.when(usable & (F.col("verb") == "set_rate") & (value > 0), value)
    new_fee = F.when(usable & (F.col("verb") == "set_fee") & (value >= 0) & (value < 100), value)
    posted = F.col("enabled") & (F.col("verb") == "entry") & (money(F.col("amount")) != 0)
    cleared = F.col("enabled") & F.col("allowed") & (F.col("verb") == "clear")
    log = running(
        cut(gated),
        ["chat_id"],
        "seq",
        [
            Running("rate", "last", new_rate, inclusive=False),
            Running("fee_percent", "last", new_fee, inclusive=False),
            Running("epoch", "sum", cleared.cast("long"), inclusive=False),
        ],
    )
    log = running(cut(log.withColumn("posted", posted)), ["chat_id", "epoch"], "seq", [Running("rank", "sum", F.col("posted").cast("long"))])
    log = cut(log)
    whole = F.col("setting_value") == F.floor(F.col("setting_value"))
    changes = log.where((F.col("verb") == "set_cutoff") & F.col("allowed") & whole).select(
        "chat_id", "seq", "ts", F.col("setting_value").try_cast("int").alias("reset_hour"),
        (F.col("rank") > 0).alias("has_entries"),
    )
    rows = log.where("posted").select(
        "chat_id", "seq", "ts", "epoch", "rank", "kind", "amount",
        F.coalesce("rate", F.lit(DEFAULT_RATE).cast("decimal(12,4)")).alias("rate"),
        F.coalesce("fee_percent", F.lit(DEFAULT_FEE).cast("decimal(12,4)")).alias("fee_percent"),
        "note", F.col("user_id").alias("operator_id"),
    )
    entries = assign_periods(post_entries(rows), cutoff_states(changes)).withColumn("id", F.col("seq"))
    asked = log.where(F.col("enabled") & (F.col("verb") == "undo")).select(
        "chat_id", "epoch", "seq", "ts", "reply_message_id", F.col("rank").alias("entries_before"), "entry_no",
    )
    by_message = rows.select("chat_id", "epoch", F.col("seq").alias("reply_message_id"), F.col("rank").alias("message_rank"))
    undos = asked.join(by_message, ["chat_id", "epoch", "reply_message_id"], "left")
    voids = resolve_undos(undos).select("chat_id", "epoch", "rank", F.col("ts").alias("voided_at"))
    last_epoch = log.groupBy("chat_id").agg(F.sum(cleared.cast("long")).alias("last_epoch"))
    return (
        entries.join(voids, ["chat_id", "epoch", "rank"], "left")
        .join(last_epoch, "chat_id")
        .where("epoch = last_epoch")
        .drop("epoch", "last_epoch", "rank")
    )


def _with_permissions(parsed: DataFrame) -> DataFrame:
    """``allowed`` holds as of the message; ``effective`` marks switches and grants that took effect.

    Operators are added or removed by owners through replies, while the ledger is on.
    """
    acted = resolve_grants(parsed)
    parsed = parsed.join(acted, ["chat_id", "seq"], "left").withColumn("effective", F.coalesce("effective", F.lit(False)))
    grants = parsed.where(F.col("effective") & F.col("verb").isin("add_operator", "remove_operator"))
    marks = grants.select("chat_id", F.col("reply_user_id").alias("user_id"), "seq", (F.col("verb") == "add_operator").alias("grant"))
    log = parsed.withColumn("is_message", F.lit(True)).unionByName(marks, allowMissingColumns=True)
    held = running(log, ["chat_id", "user_id"], "seq", [Running("granted", "last", F.col("grant"), inclusive=False)])
    return held.where("is_message").withColumn("allowed", F.col("is_owner") | F.coalesce("granted", F.lit(False))).drop(
        "grant", "granted", "is_message"
    )


def resolve_grants(parsed: DataFrame) -> DataFrame:
    """(chat_id, seq, effective) of the switches and grants that took effect.

    A grant needs the ledger on, and an operator's switch needs an earlier grant, so the two kinds depend on each
    other. Only these commands, a small part of all messages, stream through their chat's task in order; the
    state is the switch and the set of operators.
    """
    import pandas as pd

    verbs = ("enable", "disable", "add_operator", "remove_operator")

    def walk(batches):
        chat, on, operators = None, True, set()
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.chat_id != chat:
                    chat, on, operators = row.chat_id, True, set()
                if row.verb in ("enable", "disable"):
                    acts = row.is_owner or row.user_id in operators
                    on = row.verb == "enable" if acts else on
                else:
                    acts = on and row.is_owner and not pd.isna(row.reply_user_id)
                    if acts:
                        (operators.add if row.verb == "add_operator" else operators.discard)(int(row.reply_user_id))
                if acts:
                    out.append((row.chat_id, row.seq, True))
            yield pd.DataFrame(out, columns=["chat_id", "seq", "effective"])

    log = parsed.where(F.col("verb").isin(*verbs)).select("chat_id", "seq", "verb", "user_id", "is_owner", "reply_user_id")
    ordered = log.repartition("chat_id").sortWithinPartitions("chat_id", "seq")
    return ordered.mapInPandas(walk, "chat_id long, seq long, effective boolean")


class VoidedRanks:
    """Voided ranks with rank and select, in blocks of WIDTH ranks.

    A block is one bit a rank, kept only once something in it is voided; a binary indexed tree sums the voided ranks of
    the blocks. Adding and finding take logarithmic time and the whole takes at most about one bit an entry.
    """

    WIDTH = 1024

    def __init__(self):
        self.bits: dict[int, int] = {}
        self.sums = [0]

    def __contains__(self, rank: int) -> bool:
        block, place = divmod(rank - 1, self.WIDTH)
        return self.bits.get(block, 0) >> place & 1 == 1

    def add(self, rank: int) -> None:
        block, place = divmod(rank - 1, self.WIDTH)
        while len(self.sums) <= block + 1:
            at, step, total = len(self.sums), 1, 0
            while step < at & -at:
                total += self.sums[at - step]
                step *= 2
            self.sums.append(total)
        self.bits[block] = self.bits.get(block, 0) | 1 << place
        at = block + 1
        while at < len(self.sums):
            self.sums[at] += 1
            at += at & -at

    def nth_live(self, number: int) -> int:
        """The rank of the live entry with this number."""
        at, step = 0, 1 << len(self.sums).bit_length()
        while step:
            if at + step < len(self.sums):
                live = step * self.WIDTH - self.sums[at + step]
                if live < number:
                    at, number = at + step, number - live
            step //= 2
        bits, low, width = self.bits.get(at, 0), 0, self.WIDTH
        if at + 1 >= len(self.sums):
            return at * self.WIDTH + number
        while width > 1:
            half = width // 2
            live = half - (bits & (1 << half) - 1).bit_count()
            if live < number:
                number, low, bits, width = number - live, low + half, bits >> half, width - half
            else:
                width = half
        return at * self.WIDTH + low + 1


def resolve_undos(undos: DataFrame) -> DataFrame:
    """Rank of the entry each undo voids, per chat and clear epoch.

    A replied message wins while its entry is live; else ``entry_no`` counts the live entries of
    that moment. Numbers depend on earlier voids, so the undo commands alone (never the entries)
    stream through their chat's task in order; the state is ``VoidedRanks``.
    """
    import pandas as pd

    def walk(batches):
        key, gone = None, VoidedRanks()
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if (row.chat_id, row.epoch) != key:
                    key, gone = (row.chat_id, row.epoch), VoidedRanks()
                rank = 0
                if not pd.isna(row.message_rank):
                    rank = 0 if int(row.message_rank) in gone else int(row.message_rank)
                if not rank and not pd.isna(row.entry_no) and row.entry_no > 0:
                    rank = gone.nth_live(int(row.entry_no))
                if 0 < rank <= row.entries_before:
                    gone.add(rank)
                    out.append((row.chat_id, row.epoch, row.seq, row.ts, rank))
            yield pd.DataFrame(out, columns=["chat_id", "epoch", "seq", "ts", "rank"])

    columns = ["chat_id", "epoch", "seq", "ts", "message_rank", "entry_no", "entries_before"]
    ordered = undos.select(*columns).repartition("chat_id", "epoch").sortWithinPartitions("chat_id", "epoch", "seq")
    return ordered.mapInPandas(walk, "chat_id long, epoch long, seq long, ts timestamp_ntz, rank long")
