"""Candidate spellings of damaged codes, their scores and the best choice, per text row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions import codes
from ledgerlens.functions.extract import bind

# Letters read for digits, and the damaged long-code prefixes.
LETTERS, DIGITS = "OILSB", "01158"
DAMAGED_PREFIXES = ("507", "SO7", "S0T")
WINDOWS = {
    "long": r"[A-Z0-9]{6}-[A-Z0-9]{4}-[A-Z0-9]{4}-[A-Z0-9]{5}",
    "short": r"[A-Z0-9]{4}-[A-Z0-9]{4}-[A-Z0-9]{4}",
}
SEPARATED = r"[A-Z0-9]{4,6}(?:-[A-Z0-9]{4,5}){2,3}"
CANDIDATE = "array<struct<code: string, changes: array<string>>>"


def raw_candidates(text: Column, kind: str) -> Column:
    """Code-shaped windows of the squeezed text."""
    return bind(codes.squeeze_text(text), lambda squeezed: F.array_distinct(
        F.concat(*[F.regexp_extract_all(squeezed, F.lit(p), F.lit(0)) for p in (WINDOWS[kind], SEPARATED)])
    ))


def first_of_each(candidates: Column) -> Column:
    return bind(candidates, lambda items: bind(
        F.transform(items, lambda x: x["code"]), lambda names: F.filter(items, lambda x, i: F.array_position(names, x["code"]) == i + 1)
    ))


def _candidate(code: Column, *changes: Column) -> Column:
    listed = F.array(*changes) if changes else F.array().cast("array<string>")
    return F.struct(code.alias("code"), listed.alias("changes"))


def expanded(raw: Column, kind: str) -> Column:
    """Each raw code with its prefix repaired, and the look-alike swaps of its first two eligible positions."""
    if kind != "long":
        return first_of_each(F.transform(raw, lambda c: _candidate(c)))

    def spread(code: Column) -> Column:
        prefix = F.left(code, F.lit(3))
        damaged = code.rlike(r"^[A-Z0-9]{6}(-[A-Z0-9]+){3}$") & prefix.isin(*DAMAGED_PREFIXES)
        repaired = _candidate(F.concat(F.lit("S07"), F.substr(code, F.lit(4), F.length(code))), F.concat(prefix, F.lit("->S07@0")))
        spots = F.filter(F.sequence(F.lit(1), F.length(code)), lambda i: F.contains(F.lit(LETTERS), F.substr(code, i, F.lit(1))))
        return bind(spots, lambda at: variants(code, F.get(at, F.lit(0)), F.get(at, F.lit(1)), damaged, repaired))

    def variants(code: Column, one: Column, two: Column, damaged: Column, repaired: Column) -> Column:
        letter = lambda at: F.substr(code, at, F.lit(1))
        digit = lambda at: F.translate(letter(at), LETTERS, DIGITS)
        swap = lambda text, at: F.concat(F.left(text, at - 1), digit(at), F.substr(text, at + 1, F.length(code)))
        note = lambda at: F.concat(letter(at), F.lit("->"), digit(at), F.lit("@"), (at - 1).cast("string"))
        return F.array_compact(
            F.array(
                F.when(damaged, repaired),
                _candidate(code),
                F.when(two.isNotNull(), _candidate(swap(code, two), note(two))),
                F.when(one.isNotNull(), _candidate(swap(code, one), note(one))),
                F.when(two.isNotNull(), _candidate(swap(swap(code, one), two), note(one), note(two))),
            )
        )

    return first_of_each(F.flatten(F.transform(raw, spread)))


def is_valid(code: Column, kind: str) -> Column:
    return codes.is_long(code) if kind == "long" else codes.is_short(code)


def score(candidate: Column, kind: str, learned: Column | None = None) -> Column:
    """Valid shape, few changes and a learned reading raise the score."""
    n = F.size(candidate["changes"])
    base = F.when(is_valid(candidate["code"], kind), 100).otherwise(0) + F.when(n == 0, 10).otherwise(-5 * n)
    if learned is None:
        return base
    return base + F.when(learned >= 3, F.least(learned, F.lit(20))).otherwise(0)


def audit_list(text: Column, kind: str) -> Column:
    """All candidates of a text, raw readings first; a raw reading keeps its place when repeated."""
    return bind(_read(text, kind), _listed)


def _read(text: Column, kind: str) -> Column:
    """``struct<raw, spread>``: the raw codes of a text and their spellings."""
    return bind(raw_candidates(text, kind), lambda raw: F.struct(raw.alias("raw"), expanded(raw, kind).alias("spread")))


def _listed(pair: Column) -> Column:
    return first_of_each(F.concat(F.transform(pair["raw"], lambda c: _candidate(c)), pair["spread"]))


def best(text: Column, kind: str) -> Column:
    """Best valid candidate: score, then fewer changes, then the greater text. Later spellings replace raw ones."""
    return bind(_read(text, kind), lambda pair: _best(pair, kind))


def _best(pair: Column, kind: str) -> Column:
    def rank(spread_codes: Column) -> Column:
        kept_raw = F.filter(F.transform(pair["raw"], lambda c: _candidate(c)), lambda x: ~F.array_contains(spread_codes, x["code"]))
        return F.array_max(
            F.transform(
                F.filter(F.concat(kept_raw, pair["spread"]), lambda x: is_valid(x["code"], kind)),
                lambda x: F.struct(score(x, kind).alias("score"), (-F.size(x["changes"])).alias("fewer"), x["code"].alias("code")),
            )
        )

    return bind(F.transform(pair["spread"], lambda x: x["code"]), rank)


def selected(text: Column, kind: str = "long") -> Column:
    """Valid candidates with near-identical ones reduced to the better scored, the best choice included."""
    def add(kept: Column, item: Column) -> Column:
        same = F.transform(kept, lambda k: codes.likely_same(item["code"], k["code"]))
        return bind(F.array_position(same, F.lit(True)), lambda at: F.when(
            at > 0, F.transform(kept, lambda k, i: F.when((i + 1 == at) & (item["score"] > k["score"]), item).otherwise(k))
        ).otherwise(F.concat(kept, F.array(item))))

    def choose(pair: Column, top: Column) -> Column:
        scored = F.transform(
            F.filter(_listed(pair), lambda x: is_valid(x["code"], kind)),
            lambda x: F.struct(x["code"].alias("code"), F.when(x["code"] == top["code"], top["score"]).otherwise(score(x, kind)).alias("score")),
        )
        kept = F.aggregate(scored, F.array().cast("array<struct<code: string, score: int>>"), add)
        return bind(F.transform(kept, lambda k: k["code"]), lambda listed: F.when(
            top.isNull() | F.array_contains(listed, top["code"]), listed
        ).otherwise(F.concat(listed, F.array(top["code"]))))

    return bind(_read(text, kind), lambda pair: bind(_best(pair, kind), lambda top: choose(pair, top)))


def correction_counts(chosen: Column, legacy: Column) -> Column:
    """Codes beyond the plain reader and codes one character away from one of its codes."""
    near = F.filter(chosen, lambda c: F.exists(legacy, lambda k: (k != c) & (F.length(k) == F.length(c)) & (codes.hamming(codes.compact(k), codes.compact(c)) == 1)))
    added = F.filter(chosen, lambda c: ~F.array_contains(legacy, c))
    return F.struct(
        F.size(added).alias("fixed"), F.size(F.array_distinct(added)).alias("missing"), F.size(near).alias("confused")
    )


def profile_score(code: Column, changes: Column, kind: str, profile: Column, font_hash: Column, user_id: Column) -> Column:
    """Score against a learned font profile ``struct<font_hash, enabled, user_id, pairs, positions>``."""
    n = F.size(changes)
    trusted = F.coalesce(profile["enabled"], F.lit(False))
    parts = lambda c: F.struct(F.split_part(F.split_part(c, F.lit("@"), F.lit(1)), F.lit("->"), F.lit(1)).alias("w"), F.split_part(F.split_part(c, F.lit("@"), F.lit(1)), F.lit("->"), F.lit(2)).alias("c"), F.split_part(c, F.lit("@"), F.lit(2)).alias("p"))
    pair = lambda c: F.concat(parts(c)["w"], F.lit(">"), parts(c)["c"])
    at = lambda c: F.concat(parts(c)["p"], F.lit(":"), pair(c))
    hits = F.filter(
        F.transform(
            changes,
            lambda c: F.when(F.array_contains(profile["positions"], at(c)), 50).when(F.array_contains(profile["pairs"], pair(c)), 30).otherwise(0),
        ),
        lambda s: s > 0,
    )
    rule = F.coalesce(F.get(hits, F.lit(0)), F.lit(0))
    learned = F.when(profile["font_hash"] == font_hash, 40).otherwise(0) + F.when(profile["user_id"] == user_id, 25).otherwise(0) + rule
    size = F.when(n == 1, 10).when(n > 1, -50).otherwise(0)
    return F.when(is_valid(code, kind), F.lit(20) + size + F.when(trusted, learned).when(n > 0, -50).otherwise(0)).otherwise(-100)
