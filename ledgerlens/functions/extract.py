"""Code extraction from text as column expressions.

Every reader is a handful of ``regexp_extract_all`` passes and array functions, so extraction stays
inside the scan of the text table: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions import codes

TEXTS = "array<string>"
# Character classes and the misread forms of the first group.
SPACE = r"\s\u0085   -     　"
SEP = rf"[{SPACE}\-_|:：；;,.，。]"
DASHES = rf"[\-+_{SPACE}‐‑‒–—―－]"
FIRST = r"[SP5$][0ODQU][7TIL/?][0-9ODQUILTZEA$SGB]{3}"
AN = "[A-Z0-9]"
END = r"(?![A-Z0-9])"
# Look-alike letters inside the digits of the first group.
DIGIT_LETTERS = "ODQUILTZEAS$GB"
DIGIT_VALUES = "00001112345568"
# Known misread codes and their true form.
KNOWN_FIXES = {
    "S07304-9M8Q-Y7UW-78220": "S07304-9M8Q-Y7UW-78Z2U",
    "S07304-8MP5-4TY9-VDVR6": "S07304-8MP5-4TYS-VDVR6",
    "S07304-4U60-U5L1-GLXUV": "S07304-4U6Q-U5LL-GLXUV",
}
# First groups seen in practice.
KNOWN_PREFIXES = (
    "S07304", "S07234", "S07303", "S07240", "S07292", "S07298", "S07213", "S07291", "S07205", "S07239", "S07228", "S07286",
)


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def rewrite(matches: Column, pattern: str, replacement: str) -> Column:
    return F.transform(matches, lambda m: F.regexp_replace(m, pattern, replacement))


def lines_of(text: Column) -> Column:
    return F.split(text, r"\r\n|[\n\r\u000B\u000C\u001C-\u001E\u0085  ]")


def known_fix(code: Column) -> Column:
    fixed = F.when(F.lit(False), code)
    for wrong, right in KNOWN_FIXES.items():
        fixed = fixed.when(code == wrong, right)
    return fixed.otherwise(code)


def repair_first(code: Column) -> Column:
    """Undo the usual misreadings in the first six characters."""
    head = F.translate(F.left(code, F.lit(1)), "5$P9", "SSSS")
    second = F.translate(F.substr(code, F.lit(2), F.lit(1)), "ODQU", "0000")
    third = F.translate(F.substr(code, F.lit(3), F.lit(1)), "TIL/?", "77777")
    digits = F.translate(F.substr(code, F.lit(4), F.lit(3)), DIGIT_LETTERS, DIGIT_VALUES)
    return F.concat(head, second, third, digits, F.substr(code, F.lit(7), F.length(code)))


def settled(candidates: Column) -> Column:
    """Repaired, known fixes applied, strictly valid, ordered distinct."""
    fixed = F.transform(F.transform(candidates, repair_first), known_fix)
    return F.array_distinct(F.filter(fixed, codes.is_long_strict))


def noisy_long(text: Column) -> Column:
    """Long codes in folded text: separated, prefix cut off, glued to noise, compact, or spread over lines."""
    return bind(text, _noisy_long)


def _noisy_long(folded: Column) -> Column:
    groups = rf"({FIRST}){SEP}+({AN}{{4}}){SEP}+({AN}{{4}}){SEP}+({AN}{{5}})"
    tail9 = rf"({FIRST}){SEP}+({AN}{{4}}){SEP}+({AN}{{4}})({AN}{{5}})"
    cut = rf"(7[0-9]{{3}}){SEP}+({AN}{{4}}){SEP}+({AN}{{4}}){SEP}+({AN}{{5}})"
    solid = rf"({FIRST})({AN}{{4}})({AN}{{4}})({AN}{{5}})"
    spread = rf"({FIRST})((?:{SEP}*{AN}){{13}})"
    alone, four = "(?<![A-Z])", "$1-$2-$3-$4"
    none = F.array().cast(TEXTS)
    # Both readings hold the character they are filtered by; most texts lack it.
    barred = F.when(folded.contains("|"), F.filter(found(folded, alone + groups), lambda m: m.contains("|"))).otherwise(none)
    loose = F.when(folded.contains("|") | folded.contains("\n"), F.filter(
        found(folded, alone + spread),
        lambda m: F.regexp_replace(m, f"^{FIRST}", "").rlike(r"[\n|]"),
    )).otherwise(none)
    squeezed = F.transform(loose, lambda m: F.concat(F.left(m, F.lit(6)), F.regexp_replace(F.substr(m, F.lit(7), F.length(m)), "[^A-Z0-9]", "")))
    likely = folded.rlike(rf"{FIRST}|7[0-9]{{3}}")
    passes = settled(
        F.concat(
            rewrite(found(folded, alone + groups + END), f"^{groups}$", four),
            rewrite(found(folded, "(?<![A-Z0-9])" + cut + END), f"^{cut}$", f"S0{four}"),
            rewrite(barred, f"^{groups}$", four),
            rewrite(found(folded, alone + solid + END), f"^{solid}$", four),
            rewrite(found(folded, alone + tail9 + END), f"^{tail9}$", four),
            rewrite(squeezed, rf"^(.{{6}})({AN}{{4}})({AN}{{4}})({AN}{{5}})$", four),
        )
    )
    return F.when(likely, passes).otherwise(none)


def strict_codes(text: Column) -> Column:
    """Codes printed exactly: long ones, then short ones standing alone."""
    upper = F.upper(text)
    long = found(upper, r"S07[A-Z0-9]{3}-[A-Z0-9]{4}-[A-Z0-9]{4}-[A-Z0-9]{5}")
    short = found(upper, r"(?<![A-Z0-9-])[A-Z0-9]{4}-[A-Z0-9]{4}-[A-Z0-9]{4}(?![A-Z0-9-])")
    return F.array_distinct(F.concat(long, F.filter(short, lambda c: ~c.startswith("S07"))))


def confirmed_codes(text: Column) -> Column:
    """Codes a person typed: long ones with any dash or blank between groups, then the strict ones."""
    groups = rf"S07{AN}{{3}}{DASHES}+{AN}{{4}}{DASHES}+{AN}{{4}}{DASHES}+{AN}{{5}}"
    loose = rewrite(found(F.upper(text), groups), f"{DASHES}+", "-")
    return F.array_distinct(F.concat(F.filter(loose, codes.is_long), strict_codes(text)))


def loosely_written(text: Column) -> Column:
    """Codes only the tolerant reader finds."""
    return F.array_except(confirmed_codes(text), strict_codes(text))


def has_long_trace(text: Column) -> Column:
    """Text of an image with long codes, even damaged ones."""
    return bind(text, _has_long_trace)


def _has_long_trace(folded: Column) -> Column:
    squeezed = F.regexp_replace(folded, "[^A-Z0-9$]", "")
    no_cut = ~folded.rlike(r"(?<![A-Z0-9])7[0-9]{3}")
    masked = F.when(no_cut, F.regexp_replace(folded, r"(?<![A-Z0-9])7[A-Z0-9]{3}", "XXXX")).otherwise(folded)
    # Separators and first groups that leave a trace.
    wide = rf"[{SPACE}\-_|:：；;,.，。/\\]+"
    four_groups = rf"(?<![A-Z0-9])7{AN}{{3}}{wide}{AN}{{4}}{wide}{AN}{{4}}{wide}{AN}{{4,5}}(?![A-Z0-9-])"
    tails = "|".join(p[1:] for p in KNOWN_PREFIXES)
    known = rf"S07|507304|907304|SO7304|\$07304|[S59$](?:{tails})|SO(?:{'|'.join(p[2:] for p in KNOWN_PREFIXES)})|S0[A-Z0-9]304"
    return folded.contains("S07") | (folded.contains("7") & (masked.rlike(four_groups) | squeezed.rlike(known)))


def restore_layout(folded: Column) -> Column:
    """A short code glued to its next label, or with its first group split over two lines."""
    apart = F.regexp_replace(folded, r"([A-Z0-9]{4}-[A-Z0-9]{4}-[A-Z0-9]{4})(?=PSN\d)", "$1 ")
    follow = r"(?=[\s_]*-[\s_]*[A-Z0-9]{4}[\s_]*-[\s_]*[A-Z0-9]{4}(?![A-Z0-9-]))"
    joined = apart
    for left, right in ((1, 3), (2, 2), (3, 1)):
        joined = F.regexp_replace(joined, rf"(?<![A-Z0-9-])([A-Z0-9]{{{left}}})\r?\n([A-Z0-9]{{{right}}}){follow}", "$1$2")
    return joined


def inside_any(short: Column, long_codes: Column) -> Column:
    """The short code is part of one of the long codes, with or without dashes."""
    return F.exists(long_codes, lambda c: F.contains(c, short) | F.contains(codes.compact(c), codes.compact(short)))


def inside_long_token(short: Column, folded: Column) -> Column:
    tokens = F.transform(found(folded, r"[A-Z0-9][A-Z0-9-]{14,}[A-Z0-9]"), lambda t: F.btrim(t, F.lit("-")))
    return F.exists(tokens, lambda t: (t != short) & (F.contains(t, short) | F.contains(codes.compact(t), codes.compact(short))))


# Groups of short codes, and the labels before them.
SHORT_GROUPS = r"([A-Z0-9]{4})[\s_]*-[\s_]*([A-Z0-9]{4})[\s_]*-[\s_]*([A-Z0-9]{4})"
NOT_LONGER = r"(?![\s_]*-[\s_]*[A-Z0-9])"
LABEL = r"(?:卡\s*号|密\s*码)"


def _usable_short(candidates: Column, text: Column, long_codes: Column) -> Column:
    return F.array_distinct(
        F.filter(candidates, lambda c: ~c.startswith("S07") & ~inside_long_token(c, text) & ~inside_any(c, long_codes))
    )


def labelled_short(text: Column, long_codes: Column) -> Column:
    """First short code behind each label, on its line or the next one."""
    parts = found(text, rf"{LABEL}((?:(?!{LABEL})[\s\S])*)", 1)
    code = lambda line: F.regexp_replace(F.regexp_extract(line, SHORT_GROUPS + NOT_LONGER, 0), r"[\s_]", "")
    behind = F.transform(
        parts,
        lambda p: F.coalesce(
            F.nullif(code(F.get(lines_of(p), F.lit(0))), F.lit("")), F.nullif(code(F.coalesce(F.get(lines_of(p), F.lit(1)), F.lit(""))), F.lit(""))
        ),
    )
    return _usable_short(F.filter(behind, lambda c: c.isNotNull()), text, long_codes)


def free_short(text: Column, long_codes: Column) -> Column:
    alone = rf"(?<![A-Z0-9-]){SHORT_GROUPS}{NOT_LONGER}(?![A-Z0-9-])"
    return _usable_short(rewrite(found(text, alone), r"[\s_]", ""), text, long_codes)


def without_long_lines(text: Column) -> Column:
    return F.array_join(F.filter(lines_of(text), lambda line: ~line.contains("S07")), "\n")


def short_codes(folded: Column) -> Column:
    """Short codes of an image: none beside long-code traces, labelled ones first, else free ones."""
    def read(laid_out: Column) -> Column:
        facts = F.struct(without_long_lines(laid_out).alias("text"), noisy_long(laid_out).alias("long"))
        return bind(facts, lambda f: bind(
            labelled_short(f["text"], f["long"]), lambda named: F.when(F.size(named) > 0, named).otherwise(free_short(f["text"], f["long"]))
        ))

    return bind(
        folded, lambda text: F.when(has_long_trace(text) | ~text.contains("-"), F.array().cast(TEXTS)).otherwise(bind(restore_layout(text), read))
    )


def needs_cloud_reading(text: Column) -> Column:
    """A complete code whose first letter was read as a digit."""
    return F.upper(text).rlike(r"(?<![A-Z0-9])50[0-9]{4}-[A-Z0-9]{4}-[A-Z0-9]{4}-[A-Z0-9]{5}(?![A-Z0-9])")


# -- wrapped lines ----------------------------------------------------------------------------

LINE = "struct<has_prefix: boolean, trace: boolean, found: array<string>, tail: string, whole: string, text: string>"


def line_facts(lines: Column) -> Column:
    """What each line shows: codes, a prefix, a trace, and its characters from the prefix on."""
    def facts(folded: Column) -> Column:
        start = F.regexp_extract(folded, rf"({codes.LONG_PREFIX}[\s\S]*)$", 1)
        return F.struct(
            folded.rlike(codes.LONG_PREFIX).alias("has_prefix"),
            has_long_trace(folded).alias("trace"),
            noisy_long(folded).alias("found"),
            F.regexp_replace(start, "[^A-Z0-9]", "").alias("tail"),
            F.regexp_replace(folded, "[^A-Z0-9]", "").alias("whole"),
            folded.alias("text"),
        )

    return F.transform(F.transform(F.filter(lines, lambda line: F.trim(line) != ""), codes.fold_text), facts)


def _assembled(compact_text: Column) -> Column:
    dash = lambda c: F.when(c != "", known_fix(F.regexp_replace(c, r"^(.{6})(.{4})(.{4})(.{5})$", "$1-$2-$3-$4")))
    return bind(F.regexp_extract(compact_text, rf"({codes.LONG_PREFIX}[A-Z0-9]{{13}})", 1), dash)


def wrapped_lines(facts: Column, positioned: Column | bool = False) -> Column:
    """Codes and an unresolved flag from line facts: a code cut by line breaks is joined with up to three
    following lines until it has its 19 characters; another prefix or a too long tail stops the join."""
    placed = positioned if isinstance(positioned, Column) else F.lit(positioned)
    return bind(facts, lambda seen: _wrapped_lines(seen, placed))


def _wrapped_lines(facts: Column, positioned: Column) -> Column:
    size = F.size(facts)
    prefixes = F.size(F.filter(facts, lambda f: f["has_prefix"]))
    fallback_ok = (prefixes == 1) & ~positioned
    nothing = F.lit(None).cast("string")

    def split_prefix(first: Column, following: Column) -> Column:
        hit = F.regexp_replace(first["text"], "[^A-Z0-9-]", "").rlike(r"S073$")
        shape = rf"(?s)^\s*([0-9]{{2}}){SEP}+({AN}{{4}}){SEP}+({AN}{{4}}){SEP}+({AN}{{5}})(?![A-Z0-9]).*$"
        return F.when(hit & following["text"].rlike(shape), known_fix(F.regexp_replace(following["text"], shape, "S073$1-$2-$3-$4")))

    def at(index: Column) -> Column:
        return F.get(facts, index)

    def join_step(state: Column, nxt: Column) -> Column:
        open_ = ~state["done"]
        missing = F.lit(codes.LONG_LENGTH) - F.length(state["text"])
        too_long = (missing > 0) & (F.length(nxt["whole"]) > missing)
        joined = F.when(missing > 0, F.concat(state["text"], nxt["whole"])).otherwise(state["text"])
        stop = nxt["has_prefix"] | too_long
        grown = F.when(open_ & ~stop, joined).otherwise(state["text"])
        return bind(F.struct(grown.alias("text"), F.when(open_ & ~stop, _assembled(joined)).alias("made")), lambda g: F.struct(
            g["text"].alias("text"),
            F.coalesce(state["code"], g["made"]).alias("code"),
            (state["pending"] | (open_ & stop)).alias("pending"),
            (state["done"] | stop | g["made"].isNotNull()).alias("done"),
        ))

    def per_line(fact: Column, index: Column) -> Column:
        start = F.struct(fact["tail"].alias("text"), nothing.alias("code"), F.lit(False).alias("pending"), F.lit(False).alias("done"))
        ended = F.aggregate(F.slice(facts, index + 2, F.lit(3)), start, join_step)
        calm = F.struct(F.lit("").alias("text"), nothing.alias("code"), F.lit(False).alias("pending"), F.lit(False).alias("done"))
        return bind(F.when(fact["trace"] & (F.size(fact["found"]) == 0) & (fact["tail"] != ""), ended).otherwise(calm), lambda joined: settle_line(fact, index, joined))

    def settle_line(fact: Column, index: Column, joined: Column) -> Column:
        one, two = at(index + 1), at(index + 2)
        first_split = split_prefix(fact, one)
        blocked = F.coalesce(one["has_prefix"] | one["trace"], F.lit(True))
        split = F.coalesce(first_split, F.when(~blocked, split_prefix(fact, two)))
        before = at(F.when(index > 0, index - 1))
        tail_room = F.lit(codes.LONG_LENGTH) - F.length(fact["tail"])
        back = F.when(
            fallback_ok & ~before["has_prefix"] & (F.length(before["whole"]) <= F.greatest(tail_room, F.lit(0))),
            _assembled(F.concat(fact["tail"], before["whole"])),
        )
        wrapped = fact["trace"] & (F.size(fact["found"]) == 0)
        usable = wrapped & (fact["tail"] != "")
        own = F.when(usable, F.coalesce(joined["code"], back))
        return bind(F.struct(own.alias("own"), F.when(wrapped, split).alias("split")), lambda made: F.struct(
            F.concat(fact["found"], F.array_compact(F.array(made["split"], made["own"]))).alias("codes"),
            (usable & joined["pending"] & made["own"].isNull()).alias("unresolved"),
        ))

    return F.when(
        size > 0,
        bind(F.transform(facts, per_line), lambda rows: F.struct(
            F.array_distinct(F.flatten(F.transform(rows, lambda r: r["codes"]))).alias("codes"),
            F.exists(rows, lambda r: r["unresolved"]).alias("unresolved"),
        )),
    )


def rebuilt_scores(lines: Column) -> Column:
    """Complete codes of one reading with the lowest score of the lines they were joined from.

    ``lines`` is an ordered array of ``struct<text, score>``.
    """
    clean = F.transform(lines, lambda line: F.struct(codes.fold_text(line["text"]).alias("t"), F.coalesce(line["score"], F.lit(0.0)).alias("score")))
    return bind(clean, _rebuilt_scores)


def _rebuilt_scores(clean: Column) -> Column:
    strict = rf"^{codes.LONG_PREFIX}[A-Z0-9]{{13}}$"
    dash = lambda c: F.when(c.rlike(strict), F.regexp_replace(c, r"^(.{6})(.{4})(.{4})(.{5})$", "$1-$2-$3-$4"))

    def step(state: Column, nxt: Column) -> Column:
        return bind(F.regexp_replace(nxt["t"], "[^A-Z0-9]", ""), lambda fragment: grow(state, nxt, fragment))

    def grow(state: Column, nxt: Column, fragment: Column) -> Column:
        stop = nxt["t"].rlike(codes.LONG_PREFIX) | (fragment == "")
        joined = F.concat(state["text"], fragment)
        live = ~state["done"] & ~stop
        return bind(F.when(live, dash(joined)), lambda made: F.struct(
            F.when(live, joined).otherwise(state["text"]).alias("text"),
            F.when(live, F.least(state["score"], nxt["score"])).otherwise(state["score"]).alias("score"),
            F.coalesce(state["code"], made).alias("code"),
            (state["done"] | stop | made.isNotNull() | (F.length(joined) > codes.LONG_LENGTH)).alias("done"),
        ))

    def per_line(line: Column, index: Column) -> Column:
        start = F.regexp_replace(F.regexp_extract(line["t"], rf"({codes.LONG_PREFIX}[\s\S]*)$", 1), "[^A-Z0-9]", "")

        def walk(text: Column) -> Column:
            state = F.struct(text.alias("text"), line["score"].alias("score"), dash(text).alias("code"), ((text == "") | dash(text).isNotNull()).alias("done"))
            done = F.aggregate(F.slice(clean, index + 2, F.lit(3)), state, step)
            return F.when(text != "", bind(done, lambda d: F.struct(d["code"].alias("code"), d["score"].alias("score"))))

        return bind(start, walk)

    complete = F.filter(F.transform(clean, per_line), lambda r: r["code"].isNotNull())
    return bind(complete, lambda rows: bind(
        F.transform(rows, lambda x: x["code"]), lambda names: F.filter(rows, lambda r, i: F.array_position(names, r["code"]) == i + 1)
    ))


# -- marker slots -----------------------------------------------------------------------------


def _anchors(lines: Column) -> Column:
    """Marker anchors of all lines as arrays of groups, prefix first."""
    # Parts of a code on a line, and a misread first group.
    part = r"\s*-\s*([A-Z0-9]{1,5})"
    suspicious = r"(?<![A-Z0-9])SJ7[0-9]{3}"

    def line_anchors(line: Column, index: Column, prefix_pattern: str) -> Column:
        whole = found(line, rf"{prefix_pattern}(?:{part}(?:{part}(?:{part})?)?)?")
        groups = F.transform(whole, lambda m: F.transform(F.split(F.trim(m), "-"), lambda g: F.trim(g)))
        following = F.slice(lines, index + 2, F.lit(3))
        continued = rf"^\s*[A-Z0-9]{{1,5}}(?:\s*-\s*[A-Z0-9]{{1,5}}){{0,2}}\s*$"

        def extend(anchor: Column) -> Column:
            start = F.struct(F.slice(anchor, F.lit(2), F.lit(3)).alias("g"), F.lit(False).alias("stop"))

            def step(state: Column, nxt: Column) -> Column:
                bad = F.contains(nxt, F.element_at(anchor, 1)) | F.contains(nxt, F.lit("S07")) | ~nxt.rlike(continued)
                more = F.transform(F.split(F.trim(nxt), "-"), lambda g: F.trim(g))
                fits = F.size(state["g"]) + F.size(more) <= 3
                go = ~state["stop"] & ~bad & fits & (F.size(state["g"]) < 3)
                return F.struct(
                    F.when(go, F.concat(state["g"], more)).otherwise(state["g"]).alias("g"),
                    (state["stop"] | bad | ~fits | (F.size(state["g"]) >= 3)).alias("stop"),
                )

            def close(grown: Column) -> Column:
                size = lambda i: F.length(F.get(grown, F.lit(i)))
                complete = (F.size(grown) == 3) & (size(0) == 4) & (size(1) == 4) & size(2).isin(4, 5)
                return F.when(F.coalesce(complete, F.lit(False)), F.concat(F.slice(anchor, F.lit(1), F.lit(1)), grown)).otherwise(anchor)

            return F.when(F.size(anchor) < 4, bind(F.aggregate(following, start, step)["g"], close)).otherwise(anchor)

        return F.transform(groups, extend)

    def suspicious_ok(anchor: Column) -> Column:
        sizes = F.transform(anchor, F.length)
        return (F.size(anchor) == 4) & (F.element_at(sizes, 2) == 4) & (F.element_at(sizes, 3) == 4) & F.element_at(sizes, 4).isin(4, 5)

    plain = F.flatten(F.transform(lines, lambda line, i: line_anchors(line, i, codes.LONG_PREFIX)))
    doubtful = F.filter(
        F.flatten(F.transform(lines, lambda line, i: line_anchors(line, i, suspicious))),
        lambda a: F.when(F.size(a) == 4, suspicious_ok(a)).otherwise(False),
    )
    renamed = F.transform(
        doubtful, lambda a: F.concat(F.array(F.concat(F.lit("S0"), F.substr(F.element_at(a, 1), F.lit(3), F.lit(4)))), F.slice(a, F.lit(2), F.lit(3)))
    )
    return F.concat(plain, renamed)


def _one_missing(left: Column, right: Column) -> Column:
    """Same prefix and one body group that lost one character in one of the readings."""
    full = lambda a: (F.length(F.get(a, F.lit(1))) == 4) & (F.length(F.get(a, F.lit(2))) == 4) & (F.length(F.get(a, F.lit(3))) == 5)

    def lost(group_full: Column, group_cut: Column) -> Column:
        drops = [F.concat(F.left(group_full, F.lit(i)), F.substr(group_full, F.lit(i + 2), F.lit(4))) == group_cut for i in range(4)]
        return (F.length(group_cut) == 3) & (drops[0] | drops[1] | drops[2] | drops[3])

    def differ(complete: Column, cut: Column) -> Column:
        g = lambda a, i: F.get(a, F.lit(i))
        same = [g(complete, i) == g(cut, i) for i in (1, 2, 3)]
        return (~same[0] & same[1] & same[2] & lost(g(complete, 1), g(cut, 1))) | (same[0] & ~same[1] & same[2] & lost(g(complete, 2), g(cut, 2)))

    both = (F.size(left) == 4) & (F.size(right) == 4) & (F.get(left, F.lit(0)) == F.get(right, F.lit(0)))
    hit = F.when(full(left) & ~full(right), differ(left, right)).when(full(right) & ~full(left), differ(right, left)).otherwise(F.lit(False))
    return F.coalesce(both & hit, F.lit(False))


def marker_count(text: Column) -> Column:
    """Number of code slots a text shows, complete or not; readings of one slot count once. Null if none."""
    counted = bind(bind(lines_of(codes.fold_text(text)), _anchors), _slots)
    return F.when(F.upper(text).rlike("[S9Ｓ９]"), counted)


def _slots(anchors: Column) -> Column:
    # Longest anchors first, ties in text order.
    of_size = lambda n: F.filter(anchors, lambda a: F.size(a) == n)
    ordered = F.concat(of_size(4), of_size(3), of_size(2), of_size(1))

    def same(left: Column, right: Column) -> Column:
        long_enough = (F.size(left) >= 3) & (F.size(right) >= 3)
        return long_enough & ((F.slice(left, F.lit(1), F.lit(3)) == F.slice(right, F.lit(1), F.lit(3))) | _one_missing(left, right))

    kept = F.aggregate(
        ordered, F.array().cast("array<array<string>>"),
        lambda acc, a: F.when(F.exists(acc, lambda k: same(a, k)), acc).otherwise(F.concat(acc, F.array(a))),
    )
    return F.nullif(F.size(kept), F.lit(0))
