"""Code inventory: rules, names, corrections, patches, retention and status counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.codes import needs_manual_row
from ledgerlens.functions.money import local_day
from ledgerlens.operators.blocks import Running, first_per_key, running, running_number

# Fixed values of the inventory protocol.
UNCLASSIFIED = "未分类"
ORDER_GAP = 1024
MANUAL_ID_BASE = -900_000_000_000_000_000
SEARCH_CAP = 10000
CODE_LENGTH = 22


def lookup_corrections(asked: DataFrame, stored: DataFrame) -> DataFrame:
    """Correction per asked (chat, type, wrong code): the chat's own, else the newest of any chat.

    ``stored`` has one row per (chat, type, wrong code), so both joins keep the asked row count.
    """
    own = stored.select("chat_id", "code_type", "wrong_code", F.col("correct_code").alias("own_code"))
    newest = stored.groupBy("code_type", "wrong_code").agg(F.max_by("correct_code", "seq").alias("newest_code"))
    found = asked.join(own, ["chat_id", "code_type", "wrong_code"], "left").join(newest, ["code_type", "wrong_code"])
    return found.withColumn("correct_code", F.coalesce("own_code", "newest_code")).drop("own_code", "newest_code")


def display_names(records: DataFrame, chats: DataFrame, users: DataFrame) -> DataFrame:
    """Alias when one is set, else the original chat or user name."""
    chat = chats.select("chat_id", F.nullif("display_name", F.lit("")).alias("__chat"))
    user = users.select("user_id", F.nullif("display_name", F.lit("")).alias("__user"))
    named = records.join(chat, "chat_id", "left").join(user, "user_id", "left")
    return named.select(
        *records.columns,
        F.coalesce("__chat", "chat_title").alias("display_chat_name"),
        F.coalesce("__user", "user_name").alias("display_user_name"),
    )


#: Up to so many rules are joined one length at a time, so that Spark can broadcast them and rows stay where they are.
SMALL_RULES = 10_000


def classify_by_prefix(records: DataFrame, rules: DataFrame, code: str = "final_card", lengths: tuple[int, ...] | None = None, small: int = SMALL_RULES) -> DataFrame:
    """Label of the longest rule prefix of a long code; longer rules than codes match none. Never a cross join.

    Few rules are equi joined once for each of their lengths, without multiplying rows. Many rules meet all prefixes
    of the distinct codes in one join, of which the longest hit goes back to the rows.
    """
    total = 0
    if lengths is None:
        found = rules.groupBy(F.length("prefix").alias("n")).count().where(F.col("n").between(1, CODE_LENGTH)).collect()
        lengths, total = tuple(row["n"] for row in found), sum(row["count"] for row in found)
    out = records.withColumn("__code", F.upper(F.trim(F.col(code))))
    if total > small:
        codes = out.select("__code").where(F.col("__code").startswith("S07")).distinct()
        tried = codes.withColumn("__prefix", F.explode(F.array(*[F.left("__code", F.lit(n)) for n in lengths])))
        named = rules.select(F.col("prefix").alias("__prefix"), F.col("denomination").alias("__label"))
        hits = tried.join(named, "__prefix").groupBy("__code").agg(F.max_by("__label", F.length("__prefix")).alias("__label"))
        labelled = out.join(hits, "__code", "left")
        return labelled.select(*records.columns, F.coalesce("__label", F.lit(UNCLASSIFIED)).alias("rule_label"))
    labels = []
    for n in sorted(lengths, reverse=True):
        name = f"__label{n}"
        sized = rules.where(F.length("prefix") == n).select(F.col("prefix").alias("__prefix"), F.col("denomination").alias(name))
        out = out.join(sized, F.left(F.col("__code"), F.lit(n)) == F.col("__prefix"), "left").drop("__prefix")
        labels.append(name)
    label = F.when(F.col("__code").startswith("S07"), F.coalesce(*labels)) if labels else F.lit(None).cast("string")
    return out.withColumn("rule_label", F.coalesce(label, F.lit(UNCLASSIFIED))).drop("__code", *labels)


def apply_new_rule(records: DataFrame, prefix: str, label: str) -> DataFrame:
    """A new prefix rule relabels only rows nobody classified yet."""
    rule = prefix.strip().upper()
    if not rule.startswith("S07"):
        raise ValueError("prefix rules only cover long codes")
    hit = (F.col("denomination") == UNCLASSIFIED) & F.upper("final_card").startswith(rule)
    return records.withColumn("denomination", F.when(hit, label).otherwise(F.col("denomination")))


def search(
    records: DataFrame,
    *,
    chat_id: int | None = None,
    denomination: str | None = None,
    stocked: bool | None = None,
    redeemed: bool | None = None,
    duplicates_only: bool = False,
    unread_only: bool = False,
    text: str = "",
    after_version: int = 0,
    limit: int = 2000,
) -> DataFrame:
    """Inventory search over rows that already carry their display names."""
    checks: list[Column] = [~F.col("is_deleted")]
    if after_version > 0:
        checks.append(F.col("change_version") > after_version)
    for name, wanted in (("chat_id", chat_id), ("denomination", denomination), ("is_stocked", stocked), ("is_redeemed", redeemed)):
        if wanted is not None:
            checks.append(F.col(name) == F.lit(wanted))
    if duplicates_only:
        checks.append(F.col("is_duplicate"))
    if unread_only:
        checks.append(~F.col("is_viewed") & ~F.col("is_stocked"))
    if text.strip():
        fields = ("final_card", "ocr_original_card", "chat_title", "user_name", "user_handle", "display_chat_name", "display_user_name")
        hit = F.lit(False)
        for name in fields:
            hit = hit | F.col(name).ilike(f"%{text.strip()}%")
        checks.append(hit)
    picked = records
    for check in checks:
        picked = picked.where(check)
    order = ("message_date", "message_id", "image_index", "display_order", "id")
    return picked.orderBy(*order).limit(max(1, min(limit, SEARCH_CAP)))


def retain(records: DataFrame, at: Column, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """Rows to keep and rows to purge; a row without a readable time stays."""
    old = F.coalesce(at < cutoff, F.lit(False))
    return records.where(~old), records.where(old)


def chat_counts(records: DataFrame, chats: DataFrame) -> DataFrame:
    """Live rows per chat with the alias or the latest title."""
    counts = records.where(~F.col("is_deleted")).groupBy("chat_id").agg(F.max("chat_title").alias("chat_title"), F.count("*").alias("card_count"))
    alias = chats.select("chat_id", F.nullif("display_name", F.lit("")).alias("__alias"))
    named = counts.join(alias, "chat_id", "left")
    return named.select("chat_id", F.coalesce("__alias", "chat_title").alias("display_chat_name"), "card_count")


def status_counts(records: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Status totals of live rows, exact at any size."""
    label = F.col("denomination")
    flag = lambda c: F.count_if(F.col(c))
    total = F.count("*")
    return records.where(~F.col("is_deleted")).groupBy(*keys).agg(
        total.alias("total"),
        F.count_if(label == "11200").alias("label_11200"),
        F.count_if(label == "5500").alias("label_5500"),
        F.count_if(label == UNCLASSIFIED).alias("unclassified"),
        flag("is_redeemed").alias("redeemed"),
        flag("is_invalid").alias("invalid"),
        (total - flag("is_redeemed") - flag("is_invalid")).alias("valid"),
        flag("is_stocked").alias("stocked"),
        (total - flag("is_stocked")).alias("pending_stock"),
    )


def health(records: DataFrame, today: Column) -> DataFrame:
    """Latest usable code and rows of the local day."""
    usable = (F.trim("final_card") != "") & ~F.col("is_ocr_failed") & ~F.col("is_invalid")
    return records.where(~F.col("is_deleted")).agg(
        F.max(F.when(usable, F.col("message_date"))).alias("last_valid_at"),
        F.count_if(local_day(F.col("message_date")) == today).alias("today_new"),
    )


def patch_verdicts(records: DataFrame, patches: DataFrame) -> DataFrame:
    """Patches of known records with ``accepted``: stocking a redeemed code is refused as a whole.

    Only redeemed flags of accepted patches count, and a patch that both redeems and stocks is
    refused on its own, so the state before a patch is the latest other redeemed flag.
    """
    start = records.select(F.col("id").alias("record_id"), F.col("is_redeemed").alias("__start"))
    known = patches.join(start, "record_id")
    clash = F.coalesce(F.col("redeemed") & F.col("stocked"), F.lit(False))
    held = running(known, ["record_id"], "version", [Running("__held", "last", F.when(~clash, F.col("redeemed")), inclusive=False)])
    redeemed = F.coalesce("redeemed", "__held", "__start")
    accepted = ~F.coalesce(F.col("stocked") & redeemed, F.lit(False))
    return held.withColumn("accepted", accepted).drop("__held", "__start")


def _clears_ahead(good: DataFrame, clears: DataFrame) -> DataFrame:
    """Add ``__clear``, the version of the next clear of the record's chat after each patch."""
    marks = clears.select("chat_id", "version", F.col("version").alias("__at"))
    both = good.unionByName(marks, allowMissingColumns=True).withColumn("__back", -F.col("version"))
    ahead = running(both, ["chat_id"], "__back", [Running("__clear", "last", F.col("__at"), inclusive=False)])
    return ahead.where("__at IS NULL").drop("__at", "__back")


def apply_patches(records: DataFrame, patches: DataFrame, clears: DataFrame | None = None) -> DataFrame:
    """Final inventory state: every field takes its newest accepted value, with the implied changes.

    Redeeming clears the stock flag, stocking marks the row viewed, an edited code is no longer failed. A patch
    that sets nothing, or only puts the deleted flag where it stands already, does not move the change version.
    ``clears(chat_id, version)`` delete all live rows of a chat at once; patches and clears share one sequence of
    versions. A clear is never paired with all rows of its chat: a row only needs the first clear after each of its
    deleted flags.
    """
    good = patch_verdicts(records, patches).where("accepted")
    chat = [] if clears is None else ["chat_id"]
    standing = records.select(F.col("id").alias("record_id"), *chat, F.col("is_deleted").alias("__deleted"))
    good = good.join(standing, "record_id")
    none = F.lit(None).cast("long")
    if clears is None:
        good, records = good.withColumn("__clear", none), records.withColumn("__first_clear", none)
    else:
        first = clears.groupBy("chat_id").agg(F.min("version").alias("__first_clear"))
        good = _clears_ahead(good, clears).join(first, "chat_id", "left")
        records = records.join(first, "chat_id", "left")
    first_clear = F.col("__first_clear") if clears is not None else none
    flag = F.col("deleted").isNotNull()
    before = Running("__before", "last", F.when(flag, F.struct("deleted", "__clear")), inclusive=False)
    good = running(good, ["record_id"], "version", [before])
    if clears is None:
        good = good.withColumn("__next", none)
    else:
        good = running(good.withColumn("__back", -F.col("version")), ["record_id"], "__back", [Running("__next", "last", F.when(flag, F.col("version")), inclusive=False)])
    cleared = lambda deleted, clear: deleted | F.coalesce(clear < F.col("version"), F.lit(False))
    was = F.when(F.col("__before").isNull(), cleared(F.col("__deleted"), first_clear)).otherwise(cleared(F.col("__before.deleted"), F.col("__before.__clear")))
    flips = F.coalesce(F.col("deleted") != was, F.lit(False))
    given = ("final_card", "denomination", "redeemed", "invalid", "stocked", "viewed")
    good = good.withColumn("__moves", flips | F.coalesce(*[F.when(F.col(c).isNotNull(), True) for c in given], F.lit(False)))
    new_code = F.upper(F.trim("final_card"))
    hit = ~F.col("deleted") & (F.col("__next").isNull() | (F.col("__clear") < F.col("__next")))
    assigned = good.select(
        F.col("record_id").alias("id"), "version", "__moves", F.when(flag, F.struct("deleted", "__clear")).alias("flag"), F.when(hit, F.col("__clear")).alias("__hit"),
        new_code.alias("final_card"), "denomination", "redeemed", "invalid", "deleted",
        F.coalesce("stocked", F.when(F.col("redeemed"), False)).alias("stocked"),
        F.coalesce("viewed", F.when(F.col("stocked"), True)).alias("viewed"),
        F.when(new_code != "", False).alias("failed"),
    )
    fields = ("final_card", "denomination", "redeemed", "invalid", "deleted", "stocked", "viewed", "failed", "flag")
    newest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("version"))).alias(f"__{c}") for c in fields]
    folded = assigned.groupBy("id").agg(
        F.max(F.when(F.col("__moves"), F.col("version"))).alias("__version"), F.max("__hit").alias("__hit"),
        F.min(F.when(F.col("flag").isNotNull(), F.col("version"))).alias("__first_flag"), *newest,
    )
    joined = records.join(folded, "id", "left")
    target = {
        "final_card": "final_card", "denomination": "denomination", "redeemed": "is_redeemed", "invalid": "is_invalid",
        "deleted": "is_deleted", "stocked": "is_stocked", "viewed": "is_viewed", "failed": "is_ocr_failed",
    }
    updates = {column: F.coalesce(f"__{field}", column) for field, column in target.items()}
    last_clear = F.when(F.col("__flag").isNull(), F.col("__first_clear")).otherwise(F.col("__flag.__clear"))
    updates["is_deleted"] = updates["is_deleted"] | last_clear.isNotNull()
    # The first clear of all moves a row that was live from the start.
    at_first = ~F.col("is_deleted") & (F.col("__first_flag").isNull() | (F.col("__first_clear") < F.col("__first_flag")))
    moved = F.greatest("__version", "__hit", F.when(at_first, F.col("__first_clear")))
    updates["change_version"] = F.coalesce(moved, "change_version")
    return joined.withColumns(updates).select(*[c for c in records.columns if c != "__first_clear"])


def current_operators(events: DataFrame) -> DataFrame:
    """Membership after adds and removals: a removal is a tombstone."""
    changes = events.where(F.col("op").isin("add_operator", "remove_operator"))
    newest = first_per_key(changes, ["chat_id", "user_id"], [F.desc("seq")])
    return newest.where("op = 'add_operator'")


def display_orders(records: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Gap-spaced positions, so a row can be inserted between two others."""
    numbered = running_number(records, keys, order, "__n")
    return numbered.withColumn("new_order", F.col("__n") * ORDER_GAP).drop("__n")


def manual_ids(names: DataFrame, order: str = "seq") -> DataFrame:
    """Synthetic ids counting down from the base in order of first appearance of a name."""
    firsts = names.groupBy("name").agg(F.min(order).alias("first_seq"))
    numbered = running_number(firsts, [], "first_seq", "__n")
    return numbered.select("name", "first_seq", (F.lit(MANUAL_ID_BASE) - F.col("__n") + 1).alias("manual_id"))


def number_codes(images: DataFrame) -> DataFrame:
    """Codes of an image numbered long before short, beside the raw reading at the same position.

    An image without codes leaves one empty row when its text looks like a damaged code.
    """
    pair = lambda kind, final, raw: F.transform(
        F.col(final),
        lambda code, at: F.struct(F.lit(kind).alias("card_type"), code.alias("final_card"), F.coalesce(F.get(F.col(raw), at), code).alias("ocr_original_card")),
    )
    empty = F.array(F.struct(F.lit("unknown").alias("card_type"), F.lit("").alias("final_card"), F.lit("").alias("ocr_original_card")))
    listed = F.concat(pair("long", "final_long", "raw_long"), pair("short", "final_short", "raw_short"))
    rows = F.when(F.size(listed) > 0, listed).when(needs_manual_row(F.col("raw_text")), empty)
    keep = [c for c in images.columns if c not in ("final_long", "final_short", "raw_long", "raw_short")]
    flat = images.select(*keep, F.posexplode(rows).alias("__at", "__r"))
    return flat.select(*keep, (F.col("__at") + 1).cast("long").alias("card_index"), "__r.*")


def changes_since(records: DataFrame, chats: DataFrame, users: DataFrame, version: int) -> DataFrame:
    """Everything newer than a version cursor: inventory rows and both alias tables."""
    newer = F.col("change_version") > version
    part = lambda df, kind, key: df.where(newer).select(F.lit(kind).alias("entity"), F.col(key).alias("entity_id"), "change_version")
    live = records.where(~F.col("is_deleted"))
    return part(live, "record", "id").unionByName(part(chats, "chat_alias", "chat_id")).unionByName(part(users, "user_alias", "user_id"))
