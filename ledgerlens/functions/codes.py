"""Voucher codes: shapes, validity, normalisation and distances as column expressions.

A long code is ``S07xxx-XXXX-XXXX-XXXXX``, a short code ``XXXX-XXXX-XXXX``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code shapes.
LONG = r"^S07[A-Z0-9]{3}-[A-Z0-9]{4}-[A-Z0-9]{4}-[A-Z0-9]{5}$"
LONG_STRICT = r"^S07[0-9]{3}-[A-Z0-9]{4}-[A-Z0-9]{4}-[A-Z0-9]{5}$"
SHORT = r"^[A-Z0-9]{4}-[A-Z0-9]{4}-[A-Z0-9]{4}$"
LONG_PREFIX = r"S07[0-9]{3}"
LONG_LENGTH = 19

# Full-width letters, digits and dashes, and what they stand for.
FULLWIDTH = "ＳＯＱＤＩＬＴＺＢＧ０１２３４５６７８９—–－ー＿：；"
FULLWIDTH_ASCII = "SOQDILTZBG0123456789----_:;"
# Dash look-alikes.
DASHES = "‐‑‒–—―_"


def clean(code: Column) -> Column:
    return F.upper(F.trim(code))


def is_long(code: Column) -> Column:
    return code.rlike(LONG)


def is_long_strict(code: Column) -> Column:
    return code.rlike(LONG_STRICT)


def is_short(code: Column) -> Column:
    return code.rlike(SHORT)


def code_type(code: Column) -> Column:
    """long, short or null."""
    cleaned = clean(code)
    return F.when(is_long(cleaned), "long").when(is_short(cleaned), "short")


def compact(code: Column) -> Column:
    return F.replace(code, F.lit("-"), F.lit(""))


def body(code: Column) -> Column:
    """Everything after the first group, without dashes."""
    return F.replace(F.substring_index(code, "-", -3), F.lit("-"), F.lit(""))


def has_forbidden_body(code: Column) -> Column:
    """A strict long code whose body holds a character real codes never use."""
    return is_long_strict(code) & body(code).rlike("[01OI]")


def reject_reason(code: Column, kind: Column) -> Column:
    """Why a code is not valid for its declared kind; null when valid. The reasons are fixed values."""
    cleaned = clean(code)
    parts = F.split(cleaned, "-")
    sizes = F.transform(parts, F.length)
    wordy = F.forall(parts, lambda p: p.rlike(r"^[\p{L}\p{N}]+$"))
    same = lambda *n: sizes == F.array(*[F.lit(x) for x in n])
    long_reason = (
        F.when(is_long(cleaned), None)
        .when(~cleaned.startswith("S07"), "pubg_prefix_not_s07")
        .when(F.size(parts) != 4, "pubg_group_count_invalid")
        .when(~same(6, 4, 4, 5), "pubg_group_length_invalid")
        .when(~wordy, "pubg_charset_invalid")
        .otherwise("pubg_format_invalid")
    )
    short_reason = (
        F.when(is_short(cleaned), None)
        .when(F.size(parts) != 3, "psn_group_count_invalid")
        .when(~same(4, 4, 4), "psn_group_length_invalid")
        .when(~wordy, "psn_charset_invalid")
        .otherwise("psn_format_invalid")
    )
    unknown = F.when(code_type(code).isNull(), "unknown_card_type")
    return F.when(kind == "long", long_reason).when(kind == "short", short_reason).otherwise(unknown)


def fold_text(text: Column) -> Column:
    """Upper case, full-width folding, a damaged first letter restored, labels split from codes."""
    folded = F.translate(F.upper(text), FULLWIDTH, FULLWIDTH_ASCII)
    # The misread first letter and the labels before codes.
    restored = F.regexp_replace(folded, r"(?<![A-Z0-9])9([0ODQU][7TIL/?][0-9ODQUILTZEA$SGB]{3})", "S$1")
    return F.regexp_replace(restored, r"((?:密码|卡号|CDK|CDKEY)\s*\d*[:：]?)\s*([SP5$][0ODQU][7TIL/?])", "$1 $2")


def squeeze_text(text: Column) -> Column:
    """Upper case, dash look-alikes to ``-`` and all white space removed."""
    return F.regexp_replace(F.translate(F.upper(text), DASHES, "-" * len(DASHES)), r"\s+", "")


def _mismatches(left: Column, right: Column) -> Column:
    differ = F.zip_with(F.split(left, ""), F.split(right, ""), lambda a, b: a != b)
    return F.array_size(F.filter(differ, lambda x: x))


def hamming(left: Column, right: Column) -> Column:
    """Differing positions; unequal lengths count as the longer length."""
    return F.when(F.length(left) != F.length(right), F.greatest(F.length(left), F.length(right))).otherwise(
        _mismatches(left, right)
    )


def hamming_overlap(left: Column, right: Column) -> Column:
    """Differing positions of the common length."""
    size = F.least(F.length(left), F.length(right))
    return _mismatches(F.left(left, size), F.left(right, size))


def similarity(left: Column, right: Column) -> Column:
    """Percent of equal positions, two decimals; zero for unequal lengths."""
    size = F.length(left)
    share = F.round((size - _mismatches(left, right)).cast("decimal(9,0)") * 100 / size, 2).cast("decimal(5,2)")
    return F.when(size == F.length(right), share).otherwise(F.lit(0).cast("decimal(5,2)"))


def likely_same(left: Column, right: Column) -> Column:
    """Within three substitutions, or one insertion plus small edits."""
    a, b = compact(left), compact(right)
    gap = F.abs(F.length(a) - F.length(b))
    return F.when(gap == 0, _mismatches(a, b) <= 3).when(gap == 1, F.levenshtein(a, b) <= 2).otherwise(F.lit(False))


def almost_same(left: Column, right: Column) -> Column:
    a, b = compact(left), compact(right)
    return (F.length(a) == F.length(b)) & (_mismatches(a, b) <= 1)


def same_slot(left: Column, right: Column) -> Column:
    """Two readings of one printed code: three equal groups, two and a near third, or three substitutions."""
    group = lambda c, i: F.split_part(c, F.lit("-"), F.lit(i))
    first_two = (group(left, 1) == group(right, 1)) & (group(left, 2) == group(right, 2))
    near = (hamming(group(left, 3), group(right, 3)) <= 1) | (group(left, 3) == group(right, 3))
    return is_long(left) & is_long(right) & ((first_two & near) | (hamming(compact(left), compact(right)) <= 3))


def unique_valid(codes: Column, valid) -> Column:
    """Ordered distinct codes that satisfy ``valid``."""
    return F.array_distinct(F.filter(codes, valid))


def split_list(text: Column) -> Column:
    """Comma-joined text to an array without blanks."""
    return F.filter(F.split(text, ","), lambda x: x != "")


def needs_manual_row(text: Column) -> Column:
    """Text that looks like a damaged code, so an empty result still deserves a row."""
    # Shapes of damaged codes.
    shapes = (
        r"(?i)(?<![A-Z0-9])S0?7[A-Z0-9]{3}(?:[-\s_]+[A-Z0-9]{2,8}){1,4}",
        r"(?i)(?<![A-Z0-9])S0?7[A-Z0-9]{3}(?![A-Z0-9])",
        r"(?i)(?<![A-Z0-9])(?:[A-Z0-9]{4,6}[-\s_]){2,3}[A-Z0-9]{4,6}(?![A-Z0-9])",
    )
    return text.rlike(shapes[0]) | text.rlike(shapes[1]) | text.rlike(shapes[2])
