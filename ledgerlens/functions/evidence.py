"""Agreement of several readings of one image, as row-local column expressions.

A reading is a struct with ``cards``, ``short``, ``raw_text`` and ``uncertain``; the primary reading
also has ``expected``, ``conflict``, ``unresolved``, the variants ``original`` / ``enhanced`` and their
line-by-line rebuilds (arrays of ``struct<code, score>``), and the second engine's ``cpu`` scores,
``cpu_review`` flag and ``cpu_reasons``. One image is one row, so nothing here shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions import codes
from ledgerlens.functions.extract import bind, found, has_long_trace

# Score floors of the agreement rules.
CLEAR, STRONG, SUPPORT, CPU_FLOOR = 0.985, 0.97, 0.95, 0.90
ALONE = r"(?<![A-Z0-9])S07[0-9]{3}-[A-Z0-9]{4}-[A-Z0-9]{4}-[A-Z0-9]{5}(?![A-Z0-9])"
STRINGS = "array<string>"
SCORED = "array<struct<code: string, score: double>>"


def _one(cards: Column) -> Column:
    return F.get(cards, F.lit(0))


def _empty(array: Column) -> Column:
    return F.coalesce(F.size(array), F.lit(0)) <= 0


def _names(scored: Column) -> Column:
    return F.transform(scored, lambda s: F.upper(s["code"]))


def _count(array: Column, value: Column) -> Column:
    return F.size(F.filter(array, lambda x: x == value))


def _all(array: Column, test) -> Column:
    return F.coalesce(F.forall(array, test), F.lit(True))


def _sure(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def raw_codes(text: Column) -> Column:
    return found(F.upper(F.coalesce(text, F.lit(""))), ALONE)


def _single(reading: Column) -> Column:
    card = F.upper(_one(reading["cards"]))
    ok = (F.size(reading["cards"]) == 1) & _empty(reading["short"]) & codes.is_long_strict(card)
    return F.when(ok, card)


def exact_agreement(remote: Column, cloud: Column) -> Column:
    """One equal code from both sources and no other complete code in either text."""
    card, other = _single(remote), _single(cloud)
    seen = F.concat(raw_codes(remote["raw_text"]), raw_codes(cloud["raw_text"]))
    return F.when((card == other) & _all(seen, lambda c: c == card), card)


def ordered_within(parts: Column, whole: Column, same=lambda a, b: a == b) -> Column:
    """``parts`` appear in ``whole`` in order (greedy, each entry used once)."""
    size = F.size(whole)

    def step(at: Column, part: Column) -> Column:
        hits = F.filter(F.transform(whole, lambda w, i: F.when((i >= at) & same(w, part), i)), lambda i: i.isNotNull())
        return F.when(at > size, at).otherwise(F.coalesce(F.get(hits, F.lit(0)) + 1, size + 1))

    return F.aggregate(parts, F.lit(0), step) <= size


def close(a: Column, b: Column) -> Column:
    return codes.hamming(codes.compact(a), codes.compact(b)) <= 1


def _groups_equal(a: Column, b: Column, n: int) -> Column:
    return F.substring_index(a, "-", n) == F.substring_index(b, "-", n)


def sections(text: Column) -> Column:
    """Lines of a merged text under its ``[REMOTE]`` and ``[OCRSPACE]`` headings."""
    start = F.struct(F.lit("").alias("now"), F.array().cast(STRINGS).alias("remote"), F.array().cast(STRINGS).alias("cloud"))

    def step(state: Column, line: Column) -> Column:
        bare = F.trim(line)
        heading = bare.startswith("[") & bare.endswith("]")
        add = lambda name, label: F.when(~heading & (state["now"] == label), F.concat(state[name], F.array(line))).otherwise(state[name])
        now = F.when(heading, F.substr(bare, F.lit(2), F.length(bare) - 2)).otherwise(state["now"])
        return F.struct(now.alias("now"), add("remote", "REMOTE").alias("remote"), add("cloud", "OCRSPACE").alias("cloud"))

    return F.aggregate(F.split(F.upper(F.coalesce(text, F.lit(""))), "\n"), start, step)


def repeated_agreement(remote: Column, parts: Column, candidates: Column, wrap_only: bool = False) -> Column:
    """One code that the primary source shows twice and the cloud does not contradict.

    ``parts`` is ``sections`` of the merged text; ``candidates`` are extra cloud codes, used instead of
    the cloud lines when any is complete.
    """
    card = F.upper(_one(remote["cards"]))
    usable = (F.size(remote["cards"]) == 1) & _empty(remote["short"])
    suspect = r"(?<![A-Z0-9])[A-Z0-9](07[0-9]{3}-[A-Z0-9]{4}-[A-Z0-9]{4}-[A-Z0-9]{5})(?![A-Z0-9])"
    seen = F.transform(found(F.array_join(parts["remote"], "\n"), suspect, 1), lambda s: F.concat(F.lit("S"), s))
    given = F.filter(F.transform(candidates, F.upper), codes.is_long_strict)
    cloud = F.when(F.size(given) > 0, given).otherwise(found(F.array_join(parts["cloud"], "\n"), ALONE))
    flat = codes.compact(card)
    squeezed = F.transform(parts["remote"], lambda line: F.regexp_replace(line, "[^A-Z0-9]", ""))
    wraps = F.size(
        F.filter(
            F.transform(
                squeezed,
                lambda line, i: (F.regexp_extract(line, r"(S07[0-9]{3}.*)$", 1) != "")
                & (F.regexp_extract(line, r"(S07[0-9]{3}.*)$", 1) != flat)
                & (F.concat(F.regexp_extract(line, r"(S07[0-9]{3}.*)$", 1), F.get(squeezed, i + 1)) == flat),
            ),
            _sure,
        )
    )
    both = F.array_contains(_names(remote["original"]), card) & F.array_contains(_names(remote["enhanced"]), card)
    twice = wraps >= 2
    confirmed = twice if wrap_only else twice | (_count(seen, card) >= 2) | _sure(both)
    slot = lambda c: (c == card) | codes.same_slot(c, card) | _groups_equal(c, card, 2)
    peak = lambda scores: F.array_max(F.transform(F.filter(scores, lambda s: F.upper(s["code"]) == card), lambda s: s["score"]))
    strong = _sure((peak(remote["original"]) >= STRONG) & (peak(remote["enhanced"]) >= STRONG))
    tails = _all(cloud, lambda c: _groups_equal(c, card, 3) & (c != card))
    agreed = twice | (_count(cloud, card) >= 1) | (strong & tails)
    ok = usable & confirmed & (F.size(cloud) > 0) & _all(seen, lambda c: c == card) & _all(cloud, slot) & agreed
    return F.when(_sure(ok), card)


def _reasons_within(reading: Column, *allowed: str) -> Column:
    return _all(reading["cpu_reasons"], lambda r: r.isin(*allowed))


def complete_dual_variant(remote: Column) -> Column:
    """All expected codes rebuilt identically and confidently from both variants."""
    cards = F.transform(remote["cards"], F.upper)
    first, second = remote["original_rebuilt"], remote["enhanced_rebuilt"]
    paired = F.zip_with(first, second, lambda a, b: (F.least(a["score"], b["score"]) >= SUPPORT) & (F.greatest(a["score"], b["score"]) >= STRONG))
    cpu = _names(remote["cpu"])
    ignorable = _all(
        remote["cpu"],
        lambda c: F.array_contains(cards, F.upper(c["code"]))
        | ((c["score"] < CPU_FLOOR) & (F.size(F.filter(cards, lambda k: _groups_equal(k, F.upper(c["code"]), 2))) == 1)),
    )
    ok = (
        (F.size(cards) >= 2) & _empty(remote["short"]) & (remote["uncertain"] == 0) & ~remote["conflict"] & (remote["expected"] == F.size(cards))
        & _all(cards, codes.is_long_strict) & (_names(first) == cards) & (_names(second) == cards) & _all(paired, lambda p: p)
        & (_empty(cpu) | ordered_within(cpu, cards) | ignorable)
        & _reasons_within(remote, "marker_count_mismatch", "marker_without_code")
    )
    return F.when(_sure(ok), cards)


def dual_variant(remote: Column, cloud: Column) -> Column:
    """Both variants agree on every code and the cloud reads an ordered, nearly equal part of them."""
    cards, other = F.transform(remote["cards"], F.upper), F.transform(cloud["cards"], F.upper)
    high = lambda scores: ~_empty(scores) & _all(scores, lambda s: s["score"] >= STRONG)
    ok = (
        (F.size(cards) >= 2) & F.size(other).between(2, F.size(cards)) & _empty(remote["short"]) & _empty(cloud["short"])
        & (remote["uncertain"] == 0) & (cloud["uncertain"] == 0) & (_empty(remote["cpu"]) | ordered_within(_names(remote["cpu"]), cards))
        & _reasons_within(remote, "marker_count_mismatch") & (remote["expected"].isNull() | (remote["expected"] == F.size(cards)))
        & _all(F.concat(cards, other), codes.is_long_strict) & (_names(remote["original_rebuilt"]) == cards) & (_names(remote["enhanced_rebuilt"]) == cards)
        & high(remote["original_rebuilt"]) & high(remote["enhanced_rebuilt"]) & ordered_within(other, cards, close)
    )
    return F.when(_sure(ok), cards)


def cloud_completes_slot(remote: Column, cloud: Column) -> Column:
    """The cloud adds exactly one code, read twice, where a confident variant misread one character."""
    cards, other = F.transform(remote["cards"], F.upper), F.transform(cloud["cards"], F.upper)
    extra = F.filter(other, lambda c: ~F.array_contains(cards, c))
    card = _one(extra)
    printed = F.filter(F.transform(F.split(F.upper(F.coalesce(cloud["raw_text"], F.lit(""))), "\n"), lambda x: F.trim(x)), codes.is_long_strict)
    bad = lambda c: codes.body(c).rlike("[01OI]")
    anchored = F.exists(
        F.concat(remote["original_rebuilt"], remote["enhanced_rebuilt"]),
        lambda s: (s["score"] >= STRONG) & _groups_equal(F.upper(s["code"]), card, 3)
        & (codes.hamming(codes.compact(F.upper(s["code"])), codes.compact(card)) == 1) & bad(F.upper(s["code"])),
    )
    ok = (
        (F.size(cards) >= 2) & (F.size(other) == F.size(cards) + 1) & (remote["expected"] == F.size(other)) & _empty(remote["short"]) & _empty(cloud["short"])
        & (cloud["uncertain"] == 0) & _all(F.concat(cards, other), codes.is_long_strict) & ~F.exists(other, bad) & ordered_within(cards, other)
        & (F.size(extra) == 1) & (_count(printed, card) >= 2) & anchored
    )
    return F.when(_sure(ok), other)


def _exact_score(scores: Column, card: Column) -> Column:
    only = F.get(scores, F.lit(0))
    return F.when((F.size(scores) == 1) & (F.upper(only["code"]) == card), only["score"])


def one_position_apart(a: Column, b: Column) -> Column:
    return (F.length(a) == F.length(b)) & (codes.hamming_overlap(a, b) == 1)


def confirmed_clear(remote: Column) -> Column:
    """Both variants and the second engine read the same single code with high scores."""
    card = F.upper(_one(remote["cards"]))
    first, second = _exact_score(remote["original"], card), _exact_score(remote["enhanced"], card)
    only_strip = remote["cpu_review"] & (remote["cpu_reasons"] == F.array(F.lit("thin_strip")))
    a, b = F.get(remote["original"], F.lit(0)), F.get(remote["enhanced"], F.lit(0))
    ac, bc = F.upper(a["code"]), F.upper(b["code"])
    chosen = F.when(ac == card, a["score"]).otherwise(b["score"])
    resolved = (
        remote["cpu_review"] & F.array_contains(remote["cpu_reasons"], "variant_conflict") & _reasons_within(remote, "variant_conflict", "thin_strip")
        & (_exact_score(remote["cpu"], card) >= CPU_FLOOR) & (F.size(remote["original"]) == 1) & (F.size(remote["enhanced"]) == 1)
        & ((ac == card) | (bc == card)) & (ac != bc) & one_position_apart(ac, bc) & (F.least(a["score"], b["score"]) >= STRONG) & (chosen >= CLEAR)
    )
    supported = F.when(only_strip, (F.least(first, second) >= STRONG) & (F.greatest(first, second) >= CLEAR) & first.isNotNull() & second.isNotNull()).otherwise(
        (first >= CLEAR) & (second >= CLEAR)
    )
    plain = (~remote["unresolved"] | only_strip) & supported
    ok = (
        (F.size(remote["cards"]) == 1) & _empty(remote["short"]) & (remote["uncertain"] == 0) & ~remote["conflict"]
        & (remote["expected"].isNull() | (remote["expected"] == 1)) & codes.is_long_strict(card) & (_names(remote["cpu"]) == F.array(card))
        & (_sure(resolved) | _sure(plain))
    )
    return F.when(_sure(ok), card)


def variants_conflict(original: Column, enhanced: Column, review: Column) -> Column:
    """Both variants read codes and differ, unless a review settled on one of them.

    ``original`` and ``enhanced`` are ordered code arrays; ``review`` is
    ``struct<resolved, review_card, selected_card, reason>``.
    """
    picked = F.upper(review["selected_card"])
    settled = review["resolved"] & (F.upper(review["review_card"]) == picked) & (
        F.array_contains(F.concat(original, enhanced), picked) | (review["reason"] == "roi_cpu_confirmation")
    )
    return ~_sure(settled) & (F.size(original) > 0) & (F.size(enhanced) > 0) & (original != enhanced)


def cloud_resolves_conflict(remote: Column, cloud: Column) -> Column:
    """The cloud supports the higher scored enhanced reading of a one-position conflict."""
    a, b, c = F.get(remote["original"], F.lit(0)), F.get(remote["enhanced"], F.lit(0)), F.upper(_one(cloud["cards"]))
    ok = (
        remote["conflict"] & (F.size(remote["original"]) == 1) & (F.size(remote["enhanced"]) == 1) & (F.size(cloud["cards"]) == 1)
        & _empty(remote["short"]) & _empty(cloud["short"]) & (cloud["uncertain"] == 0) & codes.is_long_strict(a["code"]) & codes.is_long_strict(b["code"])
        & codes.is_long_strict(c) & (c == b["code"]) & (b["score"] > a["score"]) & one_position_apart(a["code"], b["code"])
    )
    return _sure(ok)


def repeated_cloud_slot(remote: Column, cloud: Column) -> Column:
    """A single cloud code printed twice while every primary reading shares its first three groups."""
    card = F.upper(_one(cloud["cards"]))
    printed = raw_codes(cloud["raw_text"])
    evidence = F.array_distinct(F.concat(F.transform(remote["cards"], F.upper), raw_codes(remote["raw_text"])))
    ok = (
        (F.size(cloud["cards"]) == 1) & codes.is_long_strict(card) & (_count(printed, card) >= 2) & _all(printed, lambda c: c == card)
        & (F.size(evidence) > 0) & _all(evidence, lambda c: codes.is_long_strict(c) & _groups_equal(c, card, 3))
    )
    return F.when(_sure(ok), card)


def thin_strip_choice(remote: Column, cloud: Column) -> Column:
    """Which reading a single-line image keeps, and whether the two still conflict."""
    cloud_ok = (F.size(cloud["cards"]) == 1) & _empty(cloud["short"]) & (cloud["uncertain"] == 0) & codes.is_long_strict(_one(cloud["cards"]))
    remote_ok = (F.size(remote["cards"]) == 1) & _empty(remote["short"]) & codes.is_long_strict(_one(remote["cards"]))
    agree = (remote["cards"] == cloud["cards"]) | repeated_cloud_slot(remote, cloud).isNotNull()
    pick = F.when(~_sure(cloud_ok), "remote").when(~_sure(remote_ok), "cloud").when(agree, "cloud").otherwise("remote")
    return F.struct(pick.alias("source"), (_sure(cloud_ok) & _sure(remote_ok) & ~agree).alias("conflict"))


def cloud_same_slot(remote: Column, cloud: Column) -> Column:
    """A different complete cloud reading of the same single slot."""
    a, b = _one(remote["cards"]), _one(cloud["cards"])
    one_each = (F.size(remote["cards"]) == 1) & (F.size(cloud["cards"]) == 1)
    ok = one_each & (a != b) & codes.is_long_strict(a) & codes.is_long_strict(b) & codes.same_slot(a, b)
    return F.when(_sure(ok), b)


def strip_candidate(originals: Column, remote: Column, cloud: Column, from_cloud: Column) -> Column:
    """Code a second reading confirms for a conflicting single-line image."""
    clear = confirmed_clear(remote)
    fits = clear.isNotNull() & _all(originals, lambda o: (o == clear) | codes.same_slot(o, clear))
    near = lambda cards: F.array_distinct(F.filter(cards, lambda c: codes.is_long_strict(c) & F.exists(originals, lambda o: codes.same_slot(c, o))))
    theirs = near(cloud["cards"])
    shared = F.array_intersect(near(remote["cards"]), theirs)
    alone = from_cloud & (F.size(originals) > 0) & (F.size(theirs) == 1) & _all(originals, lambda o: codes.same_slot(o, _one(theirs)))
    return F.when(fits, clear).when(F.size(shared) == 1, _one(shared)).when(_sure(alone), _one(theirs))


def drop_conflict(cards: Column, originals: Column, expected: Column, uncertain: Column) -> Column:
    """Unconfirmed conflicting codes are withheld and counted as uncertain."""
    return F.struct(
        F.filter(cards, lambda c: ~F.array_contains(originals, c)).alias("cards"),
        F.greatest(F.coalesce(expected, F.lit(0)), F.size(originals)).alias("expected"),
        (uncertain + 1).alias("uncertain"),
    )


def cpu_scores(cpu: Column) -> Column:
    """Codes of a strict second engine with the score of the first line that shows them."""
    active = cpu["enabled"] & ~cpu["shadow_only"] & cpu["can_affect_result"] & (cpu["confirmation_mode"] == "strict") & cpu["review_required"]
    pattern = F.lit(r"S07[0-9]{3}-[A-Z0-9]{4}-[A-Z0-9]{4}-[A-Z0-9]{5}")
    seen = F.flatten(
        F.transform(
            cpu["lines"],
            lambda line: F.transform(
                F.regexp_extract_all(F.replace(F.upper(line["raw_text"]), F.lit(" "), F.lit("")), pattern, F.lit(0)),
                lambda c: F.struct(c.alias("code"), F.coalesce(line["score"], F.lit(0.0)).alias("score")),
            ),
        )
    )
    firsts = bind(seen, lambda listed: bind(
        F.transform(listed, lambda x: x["code"]), lambda names: F.filter(listed, lambda x, i: F.array_position(names, x["code"]) == i + 1)
    ))
    return F.when(_sure(active), firsts).otherwise(F.array().cast(SCORED))


def cpu_review_needed(cpu: Column, roi_resolved: Column) -> Column:
    active = cpu["enabled"] & ~cpu["shadow_only"] & cpu["can_affect_result"] & (cpu["confirmation_mode"] == "strict")
    return _sure(active & cpu["review_required"]) & ~_sure(roi_resolved)


def structural_review_resolved(reasons: Column, rebuilt: Column, markers: Column, unresolved: Column, uncertain: Column) -> Column:
    only = (F.size(reasons) > 0) & F.forall(reasons, lambda r: r.isin("marker_without_code", "marker_count_mismatch"))
    return _sure(only & (markers > 0) & (rebuilt == markers) & ~unresolved & (uncertain == 0))


def apply_confirmed(cards: Column, confirmed: Column) -> Column:
    """Replace a code by the only confirmed reading of its slot; confirmed leftovers are appended."""
    return bind(F.struct(cards.alias("cards"), confirmed.alias("confirmed")), lambda x: _apply_confirmed(x["cards"], x["confirmed"]))


def _apply_confirmed(cards: Column, confirmed: Column) -> Column:
    start = F.struct(F.array().cast(STRINGS).alias("cards"), F.array().cast(STRINGS).alias("used"), F.lit(0).alias("resolved"))

    def step(state: Column, card: Column) -> Column:
        fits = F.filter(confirmed, lambda c: ~F.array_contains(state["used"], c) & codes.likely_same(card, c))
        return bind(fits, lambda one: replace(state, card, one))

    def replace(state: Column, card: Column, fits: Column) -> Column:
        unique = F.size(fits) == 1
        pick = F.when(unique, _one(fits)).otherwise(card)
        return F.struct(
            F.concat(state["cards"], F.array(pick)).alias("cards"),
            F.when(unique, F.concat(state["used"], fits)).otherwise(state["used"]).alias("used"),
            (state["resolved"] + F.when(pick != card, 1).otherwise(0)).alias("resolved"),
        )

    def append(done: Column) -> Column:
        # An original that a replacement overwrote later in the list no longer counts as present.
        left = F.array_distinct(F.filter(confirmed, lambda c: ~F.array_contains(done["used"], c) & ~F.array_contains(done["cards"], c)))
        return bind(left, lambda rest: F.struct(F.concat(done["cards"], rest).alias("cards"), (done["resolved"] + F.size(rest)).alias("resolved")))

    replaced = bind(F.aggregate(cards, start, step), append)
    untouched = F.struct(cards.alias("cards"), F.lit(0).alias("resolved"))
    appended = F.struct(confirmed.alias("cards"), F.size(confirmed).alias("resolved"))
    return F.when(F.size(confirmed) == 0, untouched).when(F.size(cards) == 0, appended).otherwise(replaced)


def merge_near(primary: Column, secondary: Column) -> Column:
    """Primary codes stay; a secondary code near a kept one is suppressed and counted."""
    kept = codes.unique_valid(primary, codes.is_long_strict)
    more = codes.unique_valid(secondary, codes.is_long_strict)
    start = F.struct(kept.alias("cards"), F.lit(0).alias("suppressed"))

    def step(state: Column, card: Column) -> Column:
        present = F.array_contains(state["cards"], card)
        near = F.exists(state["cards"], lambda k: codes.likely_same(card, k))
        return bind(F.when(present, "present").when(near, "near").otherwise("new"), lambda how: F.struct(
            F.when(how == "new", F.concat(state["cards"], F.array(card))).otherwise(state["cards"]).alias("cards"),
            (state["suppressed"] + F.when(how == "near", 1).otherwise(0)).alias("suppressed"),
        ))

    return F.aggregate(more, start, step)


def settle(cards: Column) -> Column:
    """Near-identical codes reduce to the first; codes with impossible body characters are dropped and counted."""
    def drop(merged: Column) -> Column:
        clean = F.filter(merged["cards"], lambda c: ~codes.has_forbidden_body(c))
        return bind(clean, lambda kept: F.struct(kept.alias("cards"), (merged["suppressed"] + F.size(merged["cards"]) - F.size(kept)).alias("uncertain")))

    return bind(merge_near(F.array().cast(STRINGS), cards), drop)


def blocked_slots(lines: Column) -> Column:
    """First three groups of long codes whose last group is cut off in a text line."""
    pattern = r"S07[A-Z0-9]{3}[^A-Z0-9]+[A-Z0-9]{4}[^A-Z0-9]+[A-Z0-9]{4}(?:[^A-Z0-9]+[A-Z0-9]{0,4})?"
    seen = F.flatten(F.transform(lines, lambda t: found(F.replace(F.upper(t), F.lit("_"), F.lit("-")), pattern)))
    return F.array_distinct(F.transform(seen, lambda m: F.regexp_replace(m, r"^(S07[A-Z0-9]{3})[^A-Z0-9]+([A-Z0-9]{4})[^A-Z0-9]+([A-Z0-9]{4}).*$", "$1-$2-$3")))


def merge_with_worker(text_codes: Column, worker_codes: Column, lines: Column) -> Column:
    """Codes rebuilt from text first; a worker code joins unless it conflicts. Dropped codes carry a reason."""
    return bind(blocked_slots(lines), lambda blocked: _merge_with_worker(text_codes, worker_codes, blocked))


def _merge_with_worker(text_codes: Column, worker_codes: Column, blocked: Column) -> Column:
    none = F.array().cast("array<struct<code: string, reason: string>>")
    start = F.struct(codes.unique_valid(text_codes, codes.is_long).alias("cards"), none.alias("dropped"))
    slot = lambda c: F.substring_index(c, "-", 3)

    def step(state: Column, card: Column) -> Column:
        present = F.array_contains(state["cards"], card)
        cut = F.array_contains(blocked, slot(card)) & ~F.exists(state["cards"], lambda k: slot(k) == slot(card))
        clash = F.exists(state["cards"], lambda k: codes.same_slot(card, k))
        reason = F.when(cut, "incomplete_text_line").when(clash, "line_wrap_conflict")
        return bind(F.when(present, "present").when(reason.isNotNull(), reason), lambda why: F.struct(
            F.when(why.isNotNull(), state["cards"]).otherwise(F.concat(state["cards"], F.array(card))).alias("cards"),
            F.when(why != "present", F.concat(state["dropped"], F.array(F.struct(card.alias("code"), why.alias("reason"))))).otherwise(state["dropped"]).alias("dropped"),
        ))

    return F.aggregate(codes.unique_valid(worker_codes, codes.is_long), start, step)


def best_variant(original: Column, enhanced: Column) -> Column:
    """Variant with the higher weighted score; ties keep the original.

    A variant is ``struct<codes, texts, avg_score, max_score>``.
    """
    def overlap(a: Column, b: Column) -> Column:
        share = lambda x, y: F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
        any_code = F.size(F.array_union(a["codes"], b["codes"])) > 0
        any_text = F.size(F.array_union(a["texts"], b["texts"])) > 0
        return F.when(any_code, share(a["codes"], b["codes"])).when(any_text, share(a["texts"], b["texts"])).otherwise(0.0)

    def weigh(v: Column, agreement: Column) -> Column:
        size = F.size(v["codes"])
        factor = F.when(size == 0, F.lit(-0.5)).otherwise(F.least(size, F.lit(20)) / 20)
        return v["avg_score"] * 45 + v["max_score"] * 20 + factor * 20 + agreement * 15

    first, second = weigh(original, overlap(original, enhanced)), weigh(enhanced, overlap(enhanced, original))
    return F.struct(
        F.when(second > first, "enhanced").otherwise("original").alias("variant"),
        F.round(first, 6).alias("original_score"), F.round(second, 6).alias("enhanced_score"),
    )


def original_recovery(original: Column, enhanced: Column, markers: Column, selected: Column) -> Column:
    """The untouched image rebuilt every slot with high scores while the enhanced one lost a slot."""
    cards = _names(original)
    ok = (
        (markers >= 2) & (selected < markers) & (F.size(original) == markers) & (F.size(enhanced) < markers)
        & _all(original, lambda s: s["score"] >= STRONG) & (F.size(F.array_distinct(cards)) == markers)
    )
    return F.when(_sure(ok), cards).otherwise(F.array().cast(STRINGS))


def third_reading_confirms(first: Column, second: Column, third: Column, lines: Column) -> Column:
    """Three readings differ in one position and exactly one confident line supports only the third."""
    size = F.length(first)
    varied = F.size(
        F.filter(
            F.sequence(F.lit(1), F.greatest(size, F.lit(1))),
            lambda i: F.size(F.array_distinct(F.array(*[F.substr(c, i, F.lit(1)) for c in (first, second, third)]))) > 1,
        )
    )
    tail = lambda c: F.substr(c, F.lit(2), F.length(c))
    texts = F.transform(F.filter(lines, lambda x: x["score"] >= CPU_FLOOR), lambda x: F.regexp_replace(F.upper(x["raw_text"]), r"\s+", ""))
    backing = F.filter(texts, lambda x: F.contains(x, tail(third)))
    rivals = F.exists(backing, lambda x: ((first != third) & F.contains(x, tail(first))) | ((second != third) & F.contains(x, tail(second))))
    shaped = codes.is_long_strict(first) & codes.is_long_strict(second) & codes.is_long_strict(third)
    return _sure(shaped & (varied == 1) & (F.size(backing) == 1) & ~rivals)


def one_type(long_codes: Column, short: Column, folded: Column) -> Column:
    """Short codes survive only without long codes and without their traces in the text."""
    return F.when((F.size(long_codes) > 0) | has_long_trace(folded), F.array().cast(STRINGS)).otherwise(short)


# -- review rules -----------------------------------------------------------------------------


def dominant_repeat(reading: Column) -> Column:
    """The only code is printed at least twice and more often than any one-character variant."""
    card = F.upper(_one(reading["cards"]))
    printed = raw_codes(reading["raw_text"])
    rivals = F.filter(printed, lambda c: c != card)
    close_all = _all(rivals, lambda c: codes.hamming(codes.compact(c), codes.compact(card)) == 1)
    top = F.coalesce(F.array_max(F.transform(F.array_distinct(rivals), lambda r: _count(rivals, r))), F.lit(0))
    return _sure((F.size(reading["cards"]) == 1) & _empty(reading["short"]) & (_count(printed, card) >= 2) & close_all & (_count(printed, card) > top))


def all_repeated(reading: Column) -> Column:
    cards = F.transform(reading["cards"], F.upper)
    printed = raw_codes(reading["raw_text"])
    same = F.array_sort(F.array_distinct(printed)) == F.array_sort(F.array_distinct(cards))
    return _sure((F.size(cards) > 0) & _empty(reading["short"]) & same & F.forall(cards, lambda c: _count(printed, c) >= 2))


def review_reason(remote: Column, short_expected: Column, parts: Column) -> Column:
    """Why a person must look at the image; repeated evidence suppresses the request."""
    expected = F.greatest(F.coalesce(remote["expected"], F.lit(0)), F.coalesce(short_expected, F.lit(0)))
    actual = F.size(remote["cards"]) + F.size(remote["short"])
    none = F.array().cast(STRINGS)
    trusted = (expected <= 1) & (repeated_agreement(remote, parts, none).isNotNull() | dominant_repeat(remote))
    return (
        F.when(trusted, None)
        .when(remote["unresolved"], "unresolved_fragment")
        .when((expected > 0) & (actual < expected), "fewer_than_expected")
        .when((remote["uncertain"] > 0) & ~all_repeated(remote), "conflict")
    )


def cpu_risk_reasons(best: Column, original: Column, enhanced: Column, recovered: Column, width: Column, height: Column) -> Column:
    """Reasons to ask the second engine. Readings are ``struct<texts array<string>, cards array<struct<code, score>>>``."""
    valid = lambda r: F.filter(r["cards"], lambda c: codes.is_long_strict(F.upper(c["code"])))
    names = lambda r: F.array_sort(F.array_distinct(_names(valid(r))))
    texts = F.transform(best["texts"], F.upper)
    complete = F.array_distinct(F.flatten(F.transform(texts, lambda t: found(t, ALONE))))
    bare = F.filter(texts, lambda t: F.size(found(t, ALONE)) == 0)
    loose = r"(?<![A-Z0-9])(?:S07[0-9]{3}|50[0-9]{4})(?![0-9])"
    partial = F.aggregate(bare, F.lit(0), lambda acc, t: acc + F.size(found(t, loose)))
    markers, have = F.size(complete) + partial, F.size(names(best))
    lowest = F.array_min(F.transform(valid(best), lambda c: c["score"]))
    return F.array_compact(
        F.array(
            F.when((markers > 0) & (have == 0), "marker_without_code").when(markers > have, "marker_count_mismatch"),
            F.when((F.size(names(original)) > 0) & (F.size(names(enhanced)) > 0) & (names(original) != names(enhanced)), "variant_conflict"),
            F.when(lowest < CPU_FLOOR, "low_confidence"),
            F.when(recovered, "line_recovered"),
            F.when((markers > 0) & (height > 0) & (width / height >= 3.0), "thin_strip"),
        )
    )


def enhance_reason(cards: Column, lines: Column, width: Column, height: Column, variance: Column) -> Column:
    """Why an image needs the enhanced pass. ``cards`` and ``lines`` are arrays of ``struct<text, score>``.

    The reasons and the limits they name are fixed values.
    """
    names = F.transform(cards, lambda c: F.trim(c["text"]))
    unique = F.filter(cards, lambda c, i: (F.trim(c["text"]) != "") & (F.array_position(names, F.trim(c["text"])) == i + 1))
    long_only = F.filter(unique, lambda c: F.trim(c["text"]).startswith("S07"))
    card, score = F.trim(F.get(long_only, F.lit(0))["text"]), F.coalesce(F.get(long_only, F.lit(0))["score"], F.lit(0.0))
    sizes = lambda t: F.transform(F.split(F.replace(t, F.lit(" "), F.lit("")), "-"), F.length)
    whole = r"S07[0-9]{3}-[A-Z0-9]{4}-[A-Z0-9]{4}-[A-Z0-9]{5}"
    incomplete = F.exists(
        lines,
        lambda x: x["text"].rlike(codes.LONG_PREFIX) & ~x["text"].rlike(whole)
        & ((F.size(sizes(x["text"])) != 4) | (F.slice(sizes(x["text"]), F.lit(2), F.lit(3)) != F.array(F.lit(4), F.lit(4), F.lit(5)))),
    )
    shown = F.transform(lines, lambda x: F.struct(found(F.upper(x["text"]), whole).alias("c"), x["score"].alias("score")))
    rival = F.exists(shown, lambda x: F.exists(x["c"], lambda c: c != card))
    repeats = F.size(F.filter(shown, lambda x: F.array_contains(x["c"], card) & (x["score"] >= CLEAR)))
    return (
        F.when(F.size(unique) == 0, "original_cards=0")
        .when(F.size(long_only) != F.size(unique), "non_pubg_or_mixed_cards")
        .when(F.size(long_only) != 1, "multi_card_image")
        .when(incomplete, "incomplete_pubg_line")
        .when(score < CLEAR, "card_score<0.985")
        .when(~_sure(rival) & (repeats >= 2), "not_needed")
        .when((F.coalesce(width, F.lit(0)) <= 0) | (F.coalesce(height, F.lit(0)) <= 0), "image_metrics_unavailable")
        .when(width < 350, "width<350")
        .when(height > 500, "height>500")
        .when(variance < 80, "image_variance<80")
        .otherwise("not_needed")
    )


def queue_reasons(flagged: Column, quality: Column, rejects: Column, candidates: Column, best: Column) -> Column:
    """Reasons of the review queue (fixed values); an empty array means the record needs no review."""
    clash = (candidates > 1) & (F.coalesce(best, F.lit("")) == "")
    return F.array_compact(
        F.array(
            F.when(flagged, "needs_review"), F.when(quality < 70, "low_quality_image"), F.when(rejects > 0, "validator_failed"), F.when(clash, "ocr_conflict")
        )
    )
