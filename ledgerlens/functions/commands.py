"""Ledger chat commands as typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Command words of the chat protocol.
ENABLE_WORDS = ("开启记账", "打开记账", "启用记账", "开启")
DISABLE_WORDS = ("关闭记账", "停止记账", "停用记账", "暂停记账", "暂停")
CUTOFF_PREFIXES = ("日切", "设置日切", "/set_cutoff")
BILL_TODAY_WORDS = ("今日账单", "账单", "账目", "查账", "/bill")
BILL_YESTERDAY_WORDS = ("昨日账单", "昨天账单", "/yesterday")
BILL_FULL_WORDS = ("完整账单", "全部账单", "总账单", "/fullbill")
ADD_OPERATOR_PREFIXES = ("添加操作员", "添加权限")
REMOVE_OPERATOR_PREFIXES = ("删除操作员", "删除权限")
RATE_PREFIXES = ("汇率", "设置汇率")
FEE_PREFIXES = ("设置费率", "/set_fee", "费率")
UNDO_WORDS = ("撤销", "撤销账单", "回滚", "/undo")
CLEAR_WORDS = ("清账", "清空", "清空账单", "清除账单", "/clear")
INCOME_PREFIXES = ("/in", "/income", "入款", "收款", "上分")
PAYOUT_PREFIX = "下发"
NOTE_TRIM = " -:，,"

UNSIGNED = r"(?s)^(.*?)(\d+(?:\.\d+)?)(.*)$"
SIGNED = r"(?s)^(.*?)(-?\d+(?:\.\d+)?)(.*)$"
# Full-width digits and colon fold to ASCII before parsing.
FULLWIDTH = "０１２３４５６７８９："
ASCII = "0123456789:"


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, FULLWIDTH, ASCII), r"^\s+|\s+$", "")


def _is(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("^(?:" + "|".join(words) + ")$")


def _starts(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("^(?:" + "|".join(words) + ")")


def verb(text: Column) -> Column:
    """Command verb of a normalised message; null when it is not a command."""
    return (
        F.when(_is(text, ENABLE_WORDS), "enable")
        .when(_is(text, DISABLE_WORDS), "disable")
        .when(_starts(text, CUTOFF_PREFIXES), "set_cutoff")
        .when(_is(text, BILL_TODAY_WORDS), "bill_today")
        .when(_is(text, BILL_YESTERDAY_WORDS), "bill_yesterday")
        .when(_is(text, BILL_FULL_WORDS), "bill_full")
        .when(_starts(text, ADD_OPERATOR_PREFIXES), "add_operator")
        .when(_starts(text, REMOVE_OPERATOR_PREFIXES), "remove_operator")
        .when(_starts(text, RATE_PREFIXES), "set_rate")
        .when(_starts(text, FEE_PREFIXES), "set_fee")
        .when(_is(text, UNDO_WORDS), "undo")
        .when(_is(text, CLEAR_WORDS), "clear")
        .when(entry_prefix(text) != "", "entry")
    )


def entry_prefix(text: Column) -> Column:
    """Leading sign or entry word; empty when there is none."""
    return F.regexp_extract(text, r"^(\+|-|" + "|".join(INCOME_PREFIXES) + f"|{PAYOUT_PREFIX})", 1)


def may_be_command(text: Column) -> Column:
    """One cheap pattern that lets every command through; chatter stops here, at the scan."""
    words = (*ENABLE_WORDS, *DISABLE_WORDS, *CUTOFF_PREFIXES, *ADD_OPERATOR_PREFIXES, *REMOVE_OPERATOR_PREFIXES, *RATE_PREFIXES, *FEE_PREFIXES, *UNDO_WORDS, *CLEAR_WORDS)
    return text.rlike(r"^\s*(?:[+-]|" + "|".join((*words, *INCOME_PREFIXES, PAYOUT_PREFIX)) + ")")


def number_after(text: Column) -> Column:
    """First signed number of a setting command; null if it is too long to be one."""
    found = F.regexp_extract(text, SIGNED, 2)
    return F.when(found != "", found.try_cast("decimal(28,10)"))


#: Reject reason of commands with a number out of range.
BAD_NUMBER = "bad_number"


def parse_messages(messages: DataFrame, text: str = "text") -> DataFrame:
    """Add verb, setting_value, kind, amount and note. Steps are staged so each pattern runs once.

    A command whose number is longer than any amount gets the verb ``BAD_NUMBER``, which no operator acts on.
    """
    column = F.col
    staged = messages.withColumn("__clean", normalized(column(text)))
    staged = staged.withColumns({"__verb": verb(column("__clean")), "__prefix": entry_prefix(column("__clean"))})
    tail = F.trim(F.substr("__clean", F.length("__prefix") + 1, F.length("__clean")))
    staged = staged.withColumns({
        "__tail": F.when(column("__verb") == "entry", tail), "__payout": column("__prefix") == PAYOUT_PREFIX,
        "setting_value": F.when(column("__verb").isin("set_cutoff", "set_rate", "set_fee"), number_after(column("__clean"))),
    })
    # Text before, inside and after the number; a single part when there is no number.
    mark = lambda pattern: F.regexp_replace("__tail", pattern, "$1\u0001$2\u0001$3")
    staged = staged.withColumn("__parts", F.split(F.when(column("__payout"), mark(SIGNED)).otherwise(mark(UNSIGNED)), "\u0001"))
    part = lambda i: F.get("__parts", F.lit(i))
    staged = staged.withColumns({"__amount": part(1).try_cast("decimal(28,10)"), "__number": part(1), "__rest": F.concat(part(0), part(2))})
    amount, entry = column("__amount"), column("__amount").isNotNull()
    found = F.when(amount == 0, "show_bill").when(entry, "entry").when(column("__number").isNotNull(), BAD_NUMBER)
    setting = column("__verb").isin("set_cutoff", "set_rate", "set_fee") & column("setting_value").isNull() & column("__clean").rlike(r"\d")
    return staged.select(
        *messages.columns,
        F.when(column("__verb") == "entry", found).when(setting, BAD_NUMBER).otherwise(column("__verb")).alias("verb"),
        "setting_value",
        F.when(entry, F.when(column("__payout"), "payout").otherwise("income")).alias("kind"),
        F.when(column("__prefix") == "-", -amount).otherwise(amount).alias("amount"),
        F.when(entry, F.btrim("__rest", F.lit(NOTE_TRIM))).alias("note"),
    )


def entry_number(reply_text: Column) -> Column:
    """Entry number quoted as ``#n`` in a replied bill."""
    found = F.regexp_extract(reply_text, r"#(\d+)", 1)
    return F.when(found != "", found.try_cast("long"))


def actor_label(username: Column, display_name: Column, user_id: Column) -> Column:
    return F.when(F.length(username) > 0, F.concat(F.lit("@"), username)).otherwise(
        F.coalesce(F.nullif(display_name, F.lit("")), user_id.cast("string"))
    )


def actor_name(username: Column, display_name: Column, user_id: Column) -> Column:
    """Display name, else the label."""
    return F.coalesce(F.nullif(display_name, F.lit("")), actor_label(username, display_name, user_id))


def entry_attribution(note: Column, actor: Column, reply_actor: Column) -> Column:
    """A replied user is credited first, then a typed note, then the sender."""
    return F.coalesce(reply_actor, F.nullif(note, F.lit("")), actor)
