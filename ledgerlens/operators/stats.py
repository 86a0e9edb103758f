"""Audit-record statistics: time ranges, image and code deduplication, daily counts, repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.codes import clean
from ledgerlens.functions.money import local_time
from ledgerlens.operators.blocks import attach_stats, first_per_key, running_number


def latest_phase(phases: DataFrame) -> DataFrame:
    """Staged, completed and failed writes of one image collapse to the newest."""
    return first_per_key(phases, ["chat_id", "message_id", "file_unique_id"], [F.desc("phase_ts")])


def record_time(message_text: Column, created_text: Column, path: Column, day: Column) -> Column:
    """Local record time: message time, creation time, else ``HHMMSS`` of the record folder."""
    shape = r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"
    parse = lambda c: F.when(
        F.trim(c).rlike(shape), F.try_to_timestamp(F.trim(c), F.lit("yyyy-M-d H:m:s")).cast("timestamp_ntz")
    )
    folder = F.regexp_extract(F.split_part(path, F.lit("_"), F.lit(1)), r"^(\d{6})$", 1)
    stamp = F.try_to_timestamp(
        F.concat(F.date_format(day, "yyyyMMdd"), folder), F.lit("yyyyMMddHHmmss")
    ).cast("timestamp_ntz")
    return F.coalesce(parse(message_text), parse(created_text), F.when(folder != "", stamp))


def in_window(records: DataFrame, at: Column, start: Column, end: Column) -> DataFrame:
    """Both ends belong to the window; rows without a time do not."""
    return records.where(at.between(start, end))


def exclude_users(records: DataFrame, users: DataFrame) -> DataFrame:
    """Drop listed users. Applied before any deduplication, so they never take a code's credit."""
    return records.join(users.select("user_id").distinct(), "user_id", "left_anti")


def parse_ranges(commands: DataFrame) -> DataFrame:
    """Add ``start_at``, ``end_at`` (local time) and ``error`` to ``commands(text, ts, ...)``."""
    text = F.trim("text")
    after = F.trim(F.substr(text, F.lit(4), F.length(text)))
    unnamed = F.when(F.contains(F.col("__after"), F.lit(" ")), F.trim(F.regexp_extract("__after", r"^\S*? (.*)$", 1))).otherwise("")

    def clock(at: int) -> Column:
        piece = F.trim(F.get("__parts", F.lit(at)))
        valid = piece.rlike(r"^([01]?\d|2[0-3]):[0-5]?\d$")
        hour, minute = F.split_part(piece, F.lit(":"), F.lit(1)), F.split_part(piece, F.lit(":"), F.lit(2))
        return F.when(valid, F.col("__midnight") + F.make_dt_interval(hours=hour.cast("int"), mins=minute.cast("int")))

    staged = commands.withColumns({"__now": local_time(F.col("ts")), "__after": after, "__known": text.startswith("/统计")})
    staged = staged.withColumns({
        "__arg": F.when(F.col("__after").startswith("@"), unnamed).otherwise(F.col("__after")),
        "__midnight": F.date_trunc("day", "__now").cast("timestamp_ntz"),
    })
    staged = staged.withColumn("__parts", F.split("__arg", "-"))
    empty, size = F.col("__arg") == "", F.size("__parts")
    staged = staged.withColumns({
        "__start": F.when(empty, F.col("__midnight")).otherwise(clock(0)),
        "__end": F.when(empty | (size == 1), F.col("__now")).otherwise(clock(1)),
    })
    start, end, now = F.col("__start"), F.col("__end"), F.col("__now")
    staged = staged.withColumn(
        "error",
        F.when(~F.col("__known") | (~empty & ((size > 2) | start.isNull() | end.isNull())), "bad_format")
        .when(~empty & (start > now), "start_after_now")
        .when(~empty & (end > now), "end_after_now")
        .when(~empty & (end <= start), "end_not_after_start"),
    )
    fine = F.col("error").isNull()
    return staged.select(
        *commands.columns, F.when(fine, start).alias("start_at"), F.when(fine, end).alias("end_at"), "error"
    )


def unique_images(records: DataFrame) -> DataFrame:
    """First record per (day, chat, message, file); records without ids always stay."""
    named = (F.coalesce("message_id", F.lit(0)) != 0) | (F.trim(F.coalesce("file_unique_id", F.lit(""))) != "")
    key = F.when(named, F.concat_ws("|", F.coalesce("message_id", F.lit(0)).cast("string"), F.trim(F.coalesce("file_unique_id", F.lit("")))))
    keyed = records.withColumn("image_key", F.coalesce(key, F.concat(F.lit("path|"), F.col("record_path"))))
    return first_per_key(keyed, ["dt", "chat_id", "image_key"], ["record_path"]).drop("image_key")


def code_rows(records: DataFrame) -> DataFrame:
    """One row per listed code, long before short, with its position in the image."""
    typed = lambda name, c: F.transform(
        F.coalesce(F.col(c), F.array().cast("array<string>")),
        lambda code, at: F.struct(F.lit(name).alias("code_type"), at.cast("long").alias("pos"), clean(code).alias("code")),
    )
    listed = F.explode(F.concat(typed("long", "final_long"), typed("short", "final_short")))
    keep = [c for c in records.columns if c not in ("final_long", "final_short")]
    return records.select(*keep, listed.alias("__c")).select(*keep, "__c.*").where(F.col("code") != "")


def first_credit(codes: DataFrame) -> DataFrame:
    """The first record of a day that shows a code gets the credit for it."""
    return first_per_key(codes, ["dt", "code_type", "code"], ["record_path", "pos"])


def daily_counts(records: DataFrame) -> DataFrame:
    """Images, long and short codes per (day, chat, user)."""
    images = unique_images(records)
    credit = first_credit(code_rows(images))
    keys = ["dt", "chat_id", "user_id"]
    none = F.lit(None).cast("string")
    events = images.select(
        *keys, "record_path", "chat_title", "username", F.lit(1).alias("image"), F.lit(0).alias("long"), F.lit(0).alias("short")
    ).unionByName(
        credit.select(
            *keys, none.alias("record_path"), none.alias("chat_title"), none.alias("username"), F.lit(0).alias("image"),
            (F.col("code_type") == "long").cast("int").alias("long"), (F.col("code_type") == "short").cast("int").alias("short"),
        )
    )
    return events.groupBy(*keys).agg(
        F.min_by("chat_title", "record_path").alias("chat_title"),
        F.min_by("username", "record_path").alias("username"),
        F.sum("image").alias("images"),
        F.sum("long").alias("long_codes"),
        F.sum("short").alias("short_codes"),
    )


def report_order(stats: DataFrame) -> DataFrame:
    return stats.orderBy("dt", F.lower("chat_title"), F.lower("username"), "chat_id", "user_id")


def rolled_up(stats: DataFrame) -> DataFrame:
    """Chat and day totals on top of the per-user counts."""
    return stats.rollup("dt", "chat_id").agg(
        F.sum("images").alias("images"), F.sum("long_codes").alias("long_codes"), F.sum("short_codes").alias("short_codes")
    ).where("dt IS NOT NULL")


def later_sightings(sightings: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Every sighting after the first of its key, with who saw it first and when."""
    firsts = sightings.groupBy(*keys).agg(
        F.min(F.struct(order, "ts", "username")).alias("first"), F.count("*").alias("sightings")
    )
    seen = attach_stats(sightings, firsts.where("sightings > 1"), keys, "sightings")
    return seen.where(F.col(order) > F.col(f"first.{order}")).select(
        *sightings.columns, F.col("first.ts").alias("first_ts"), F.col("first.username").alias("first_username")
    )


def flag_duplicates(records: DataFrame) -> DataFrame:
    """True when another live record holds the same code, ignoring case, on the same local day."""
    keyed = records.withColumn("__code", F.lower("final_card")).withColumn("__day", F.to_date(local_time(F.col("message_date"))))
    usable = keyed.where(~F.col("is_deleted") & (F.col("final_card") != ""))
    counts = usable.groupBy("__code", "__day").agg(F.count("*").alias("__n")).where("__n > 1")
    joined = attach_stats(keyed, counts, ["__code", "__day"], "__n")
    live = ~F.col("is_deleted") & F.col("__n").isNotNull()
    return joined.withColumn("is_duplicate", live).drop("__code", "__day", "__n")


def batch_output(occurrences: DataFrame) -> DataFrame:
    """Codes of a batch in print order: kept once, numbered, with the image that showed them first.

    ``sort_id`` is a unique integer that follows (batch, image, y, x).
    """
    firsts = occurrences.groupBy("batch_id", "code_type", "code").agg(
        F.min(F.struct("sort_id", "image_index")).alias("f"), F.count("*").alias("shown")
    )
    kept = firsts.select("batch_id", "code_type", "code", F.col("f.sort_id").alias("sort_id"), F.col("f.image_index").alias("image_index"), "shown")
    return running_number(kept, ["batch_id", "code_type"], "sort_id", "line_no")


def batch_repeats(occurrences: DataFrame) -> DataFrame:
    """Later images of a batch that repeat a code: one row per repeat."""
    keys = ["batch_id", "code_type", "code"]
    firsts = occurrences.groupBy(*keys).agg(F.min(F.struct("sort_id", "image_index")).alias("f"), F.count("*").alias("shown"))
    joined = attach_stats(occurrences, firsts.where("shown > 1"), keys, "shown")
    return joined.where(F.col("sort_id") > F.col("f.sort_id")).select(
        *keys, F.col("f.image_index").alias("first_image"), F.col("image_index").alias("later_image"), "sort_id"
    )


def arrival_order(records: DataFrame) -> DataFrame:
    return records.orderBy(F.col("message_id").asc_nulls_last(), "seq")


def pages(recipients: DataFrame, order: str, size: int = 50) -> DataFrame:
    """Page number of each recipient in ``order`` (a unique integer)."""
    numbered = running_number(recipients, [], order, "__n")
    return numbered.withColumn("page", F.floor((F.col("__n") - 1) / size)).drop("__n")


def limit_codes(codes: Column, expected: Column, fuzzy_mark: str = "?") -> Column:
    """At most ``expected`` codes: exact ones first when there are enough, else the head of the list."""
    exact = F.filter(codes, lambda c: ~c.endswith(fuzzy_mark))
    head = F.when(F.size(exact) >= expected, F.slice(exact, F.lit(1), expected)).otherwise(F.slice(codes, F.lit(1), expected))
    return F.when(expected.isNull() | (F.size(codes) <= expected), codes).otherwise(head)
