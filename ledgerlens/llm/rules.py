"""Learned quality rules: an ordered decision list over statistics of a document, with DataFrame functions only.

Statistics are array expressions over one row and are written once. Sequential covering then grows one conjunction of
thresholds at a time on two thirds of the labelled rows, prunes it on the rest, keeps it if it still tells junk from
text there, and goes on with the rows it does not cover. Each step is one small aggregation over (feature, bin); only
its counts reach the driver. The list is applied as nested conditional expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import may_learn, pick
from ledgerlens.session import cut

#: Bound of the training sample: expected labelled rows, taken by a hash of the id.
SAMPLE = 40_000
MAX_RULES, MAX_CONDITIONS, CUTS = 12, 4, 32
#: A pruned rule stays if it covers so many labelled rows outside its growing part, so many of them junk.
LEAST_COVER, LEAST_PRECISION = 3, 0.8
#: Words of a window that is looked for twice in a text; at most so many percent of the words may lie in such windows.
WINDOW, MOST_REPEATED, LEAST_WORDS = 8, 30, 20

BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MARKS = ".,;:!?"
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_marks", "n_digits", "n_capitals", "longest"]


def _number(text: Column, characters: str) -> Column:
    return F.regexp_count(text, F.lit(f"[{characters}]"))


def _bind(value: Column, body) -> Column:
    """``body(value)``, the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _halves(words: Column) -> Column:
    """Hashes of all windows of WINDOW / 2 words."""
    half = WINDOW // 2
    chain = lambda h: F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, half)]))
    cut_off = F.greatest(F.size(words) - (half - 1), F.lit(0))
    return F.slice(_bind(F.transform(words, lambda w: F.xxhash64(w)), chain), 1, cut_off)


def _repeated(halves: Column) -> Column:
    """Words inside windows whose hash occurs twice or more, from the hashes of half windows."""
    half = WINDOW // 2
    joined = F.zip_with(halves, F.slice(halves, half + 1, F.size(halves)), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))
    windows = F.filter(joined, lambda h: h.isNotNull())
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(places: Column) -> Column:
        following = F.slice(places, 2, F.size(places))
        gains = F.zip_with(places, following, lambda p, q: F.least(F.coalesce(q - p, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(gains, F.lit(0).cast("long"), lambda total, x: total + x)

    def twice(s: Column) -> Column:
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        hit = F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))
        return _bind(F.sort_array(F.transform(hit, lambda x: x["i"])), covered)

    return _bind(ordered, twice)


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Replace the text by the columns of STATISTICS (long). Null, empty and blank texts have 0 everywhere.

    Windows of a text are compared by 64-bit hashes, those of a whole window only where a half repeats. Work and memory
    of a row follow the length of its text.
    """
    others = [c for c in docs.columns if c != text_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*others, text.alias("__text"), F.btrim(text, F.lit(BLANK)).alias("__trim"))
    words = F.when(F.col("__trim") != "", F.split("__trim", r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))
    lines = F.filter(F.split("__text", "\n"), lambda x: F.btrim(x, F.lit(BLANK)) != "")
    rows = rows.select(*others, "__text", words.alias("__words"), lines.alias("__lines"))
    rows = rows.withColumn("__halves", _halves(F.col("__words")))
    tokens, halves = F.col("__text"), F.col("__halves")
    counts = {
        "n_words": F.size("__words"),
        "word_chars": F.char_length(tokens) - _number(tokens, r"\x20\x09-\x0D"),
        "n_symbols": _number(tokens, SYMBOLS),
        "n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")),
        "n_repeat_words": F.when(F.size(F.array_distinct(halves)) < F.size(halves), _repeated(halves)).otherwise(0),
        "n_lines": F.size("__lines"),
        "n_distinct": F.size(F.array_distinct("__words")),
        "n_marks": _number(tokens, MARKS),
        "n_digits": _number(tokens, "0-9"),
        "n_capitals": _number(tokens, "A-Z"),
        "longest": F.coalesce(F.array_max(F.transform("__words", F.char_length)), F.lit(0)),
    }
    return rows.select(*others, *[counts[name].cast("long").alias(name) for name in STATISTICS])


def base_failed() -> Column:
    """Too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)


def features() -> dict[str, Column]:
    """What conditions speak of, from the columns of STATISTICS."""
    return {
        "words": F.col("n_words").cast("double"), "chars_a_word": _share("word_chars", "n_words"), "symbols_a_word": _share("n_symbols", "n_words"),
        "dup_lines": _share("n_dup_lines", "n_lines"), "repeated_words": _share("n_repeat_words", "n_words"), "distinct_words": _share("n_distinct", "n_words"),
        "marks_a_word": _share("n_marks", "n_words"), "digits_a_char": _share("n_digits", "word_chars"), "capitals_a_char": _share("n_capitals", "word_chars"),
        "words_a_line": _share("n_words", "n_lines"), "longest": F.col("longest").cast("double"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    limit: float

    def holds(self) -> Column:
        value = features()[self.feature]
        return value > self.limit if self.above else value <= self.limit


@dataclass(frozen=True)
class Rule:
    """Junk if all conditions hold; ``junk`` of ``covered`` labelled rows said so when it was learned."""

    conditions: tuple[Condition, ...]
    covered: int
    junk: int

    def holds(self) -> Column:
        return reduce(and_, [c.holds() for c in self.conditions])

    def __str__(self) -> str:
        return " and ".join(f"{c.feature} {'>' if c.above else '<='} {c.limit:.6g}" for c in self.conditions)


def _gain(p1: int, n1: int, p0: int, n0: int) -> float:
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0))) if p1 else 0.0


def _inside(conditions: list[tuple[int, bool, int]]) -> Column:
    """Conditions over the column ``bins``: (feature, above, last bin below the cut)."""
    tests = [F.get("bins", F.lit(f)) > b if above else F.get("bins", F.lit(f)) <= b for f, above, b in conditions]
    return reduce(and_, tests, F.lit(True))


def _bin(value: Column, cuts: list[float]) -> Column:
    """Number of cuts below the value."""
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda c: c < value))


def _best(rows: DataFrame, names: list[str], cuts: list[list[float]], known: list) -> tuple | None:
    """The condition of most information gain over the growing rows that all known conditions cover."""
    cell = F.posexplode("bins").alias("feature", "bin")
    found = rows.where((F.col("part") > 0) & _inside(known)).select("junk", cell).groupBy("feature", "bin").agg(
        F.count_if("junk").alias("p"), F.count_if(~F.col("junk")).alias("n")).collect()
    table = {(r["feature"], r["bin"]): (r["p"], r["n"]) for r in found}
    best, most = None, 1e-9
    for f in range(len(names)):
        own = [table.get((f, b), (0, 0)) for b in range(len(cuts[f]) + 1)]
        p0, n0 = sum(x[0] for x in own), sum(x[1] for x in own)
        if not p0 or not n0:
            continue
        p = n = 0
        for b in range(len(cuts[f])):
            p, n = p + own[b][0], n + own[b][1]
            for above, p1, n1 in ((False, p, n), (True, p0 - p, n0 - n)):
                gain = _gain(p1, n1, p0, n0)
                if gain > most:
                    best, most = (f, above, b), gain
    return best


def _prune(rows: DataFrame, known: list) -> tuple[list, int, int]:
    """The prefix of the conditions that is worth most on the rows kept for pruning, with its counts there."""
    sums = []
    for size in range(1, len(known) + 1):
        inside = _inside(known[:size])
        sums += [F.count_if(inside & F.col("junk")).alias(f"p{size}"), F.count_if(inside & ~F.col("junk")).alias(f"n{size}")]
    counts = rows.where(F.col("part") == 0).agg(*sums).first()
    worth = lambda k: (counts[f"p{k}"] - counts[f"n{k}"]) / max(counts[f"p{k}"] + counts[f"n{k}"], 1)
    size = max(range(1, len(known) + 1), key=lambda k: (worth(k), -k))
    return known[:size], counts[f"p{size}"], counts[f"n{size}"]


def learn(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE) -> list[Rule]:
    """The ordered list, from about ``sample`` labelled rows that may be learned from and pass the base rules.

    Null ids and labels are left out; label 1 and more is text, less is junk. Without junk the list is empty. Cuts are
    quantiles of the sample; at equal gain the first feature, cut and direction wins, so a rerun learns the same list.
    """
    known = pick(labels, id_col, label_col).where(may_learn(F.col(id_col)) & F.col(label_col).isNotNull())
    n = known.count()
    picked = known.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < min(1.0, sample / max(n, 1)) * (1 << 20))
    rows = pick(stats, id_col, *STATISTICS).where(~base_failed()).join(picked, id_col)
    values = features()
    names = list(values)
    part = F.pmod(F.xxhash64(F.lit("part"), id_col), F.lit(3))
    rows = cut(rows.select((F.col(label_col) < 1).alias("junk"), part.alias("part"), F.array(*values.values()).alias("x")))
    shares = [i / (CUTS + 1) for i in range(1, CUTS + 1)]
    # Quantiles of each class, so that a rare class has cuts of its own.
    quantiles = [F.percentile_approx(F.get("x", F.lit(f)), shares, 10_000).alias(f"q{f}") for f in range(len(names))]
    found = rows.groupBy("junk").agg(*quantiles).collect()
    cuts = [sorted({v for r in found for v in r[f"q{f}"] or []}) for f in range(len(names))]
    bins = [_bin(F.get("x", F.lit(f)), own) for f, own in enumerate(cuts)]
    rows = cut(rows.select("junk", "part", F.array(*bins).alias("bins")))
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        conditions: list[tuple] = []
        while len(conditions) < MAX_CONDITIONS and (best := _best(rows, names, cuts, conditions)):
            conditions.append(best)
        if not conditions:
            break
        conditions, p, n = _prune(rows, conditions)
        if p + n < LEAST_COVER or p < LEAST_PRECISION * (p + n):
            break
        rules.append(Rule(tuple(Condition(names[f], above, cuts[f][b]) for f, above, b in conditions), p + n, p))
        rows = rows.where(~_inside(conditions))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, from 1; 0 if none does."""
    out = F.lit(0)
    for i, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(rule.holds(), i).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """Per row of ``docs``: its id, STATISTICS, ``base_failed``, ``rule`` (number of the rule that holds, 0 for none) and ``kept``.

    Other columns of ``docs`` and ``labels`` are not read, whatever their names. Repeated rows get a row each, null
    and empty texts fail the base rules, an empty table gives an empty one, and without labels only the base rules judge.
    """
    stats = cut(statistics(pick(docs, id_col, text_col), text_col))
    rules = learn(stats, labels, id_col, label_col, sample)
    out = stats.withColumns({"base_failed": base_failed(), "rule": verdict(rules)})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
