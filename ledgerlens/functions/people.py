"""Identities, labels, links, addresses and hash keys of messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ADDRESS = r"(?<![A-Za-z0-9])(T[1-9A-HJ-NP-Za-km-z]{33})(?![A-Za-z0-9])"


def address(text: Column) -> Column:
    """First wallet address in a message."""
    return F.nullif(F.regexp_extract(F.trim(text), ADDRESS, 1), F.lit(""))


def is_address(text: Column) -> Column:
    return F.trim(text).rlike(r"^T[1-9A-HJ-NP-Za-km-z]{33}$")


def _person(user: Column) -> Column:
    name = F.concat_ws(
        " ", *[F.when(F.length(user[part]) > 0, F.trim(user[part])) for part in ("first_name", "last_name")]
    )
    return F.when(
        user.isNotNull(),
        F.struct(user["id"].alias("actor_id"), F.coalesce(user["username"], F.lit("")).alias("username"), name.alias("display_name")),
    )


def actor(from_user: Column, sender_chat: Column, origin_user: Column, origin_name: Column) -> Column:
    """Visible sender: the user, else the sending chat, else the forward origin's user or hidden name."""
    handle = F.coalesce(sender_chat["username"], F.lit(""))
    title = F.coalesce(F.nullif(sender_chat["title"], F.lit("")), F.nullif(handle, F.lit("")), sender_chat["id"].cast("string"))
    chat = F.when(sender_chat.isNotNull(), F.struct(sender_chat["id"].alias("actor_id"), handle.alias("username"), title.alias("display_name")))
    hidden = F.when(
        F.trim(origin_name) != "",
        F.struct(F.lit(0).cast("long").alias("actor_id"), F.lit("").alias("username"), F.trim(origin_name).alias("display_name")),
    )
    return F.coalesce(_person(from_user), chat, _person(origin_user), hidden)


def label(who: Column) -> Column:
    named = F.coalesce(F.nullif(who["display_name"], F.lit("")), who["actor_id"].cast("string"))
    return F.when(who["username"] != "", F.concat(F.lit("@"), who["username"])).otherwise(named)


def handle_only(source_user: Column) -> Column:
    """``@handle`` of a user label, else its first ``|`` part."""
    found = F.regexp_extract(source_user, r"@[A-Za-z0-9_]+", 0)
    parts = F.filter(F.transform(F.split(source_user, r"\|"), lambda x: F.trim(x)), lambda p: p != "")
    return F.coalesce(F.nullif(found, F.lit("")), F.get(parts, F.lit(0)), F.lit("Unknown"))


def font_hash(sample: Column, kind: Column, size: int = 12) -> Column:
    """Deterministic key of a text sample: kind and a hash prefix of its squeezed upper-case form."""
    squeezed = F.regexp_replace(F.upper(sample), r"\s+", "")
    return F.concat(F.lower(F.coalesce(kind, F.lit("ocr"))), F.lit("_font_"), F.left(F.sha2(squeezed, 256), F.lit(size)))


def message_link(chat_kind: Column, handle: Column, chat_id: Column, message_id: Column) -> Column:
    """Public link by handle or numeric chat id; empty for private chats and unlinkable ids."""
    name = F.regexp_replace(F.coalesce(handle, F.lit("")), "^@+", "")
    number = F.regexp_extract(chat_id, r"^-100(\d+)$", 1)
    at = message_id.cast("string")
    return (
        F.when((chat_kind == "private") | (F.coalesce(message_id, F.lit(0)) <= 0), "")
        .when(name != "", F.concat(F.lit("https://t.me/"), name, F.lit("/"), at))
        .when(number != "", F.concat(F.lit("https://t.me/c/"), number, F.lit("/"), at))
        .otherwise("")
    )
