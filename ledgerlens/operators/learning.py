"""Learning from confirmed codes: windows, diffs, character rules, templates, corrections, data sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import codes
from ledgerlens.functions.extract import bind
from ledgerlens.operators.blocks import first_per_key, running_number
from ledgerlens.operators.fuzzy import nearest_template
from ledgerlens.operators.graph import components
from ledgerlens.session import cut

# Thresholds and pairs of the correction rules.
TEMPLATE_SAMPLES = 100
RULE_COUNT, STRICT_RULE_COUNT = 3, 10
AMBIGUOUS = ("2Z", "Z2")
SAFE_SWAPS = (
    "9S", "S9", "96", "69", "0O", "O0", "1I", "I1", "5S", "S5", "8B", "B8", "39", "93", "JU",
)
CONFIRMED = ("confirmed_match", "confirmed_error")
UNKNOWN_FONT = "unknown_font"


def truth_sets(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Shared, missing and extra distinct codes per batch."""
    side = lambda df, name: df.where("code IS NOT NULL").select("batch_id", "code", F.lit(name).alias("side"))
    both = side(predicted, 1).unionByName(side(truth, 2)).groupBy("batch_id", "code").agg(F.bit_or("side").alias("seen"))
    return both.groupBy("batch_id").agg(
        F.count_if(F.col("seen") == 3).alias("both_count"), F.count_if(F.col("seen") == 2).alias("missing_count"), F.count_if(F.col("seen") == 1).alias("extra_count")
    )


def _apart(left: Column, right: Column) -> Column:
    a, b = codes.compact(left), codes.compact(right)
    return F.when(F.length(a) == F.length(b), codes.hamming(a, b))


def learning_window(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Slice of each batch's ordered distinct predictions that starts at its first confirmed code.

    The start is the equal prediction, else the nearest one within two characters (earliest on a
    tie); the slice is as long as the confirmed list. ``predicted`` and ``truth`` have
    (batch_id, seq, code).
    """
    once = first_per_key(predicted, ["batch_id", "code"], ["seq"])
    numbered = running_number(once, ["batch_id"], "seq", "idx")
    goals = truth.where("code IS NOT NULL").groupBy("batch_id", "code").agg(F.min("seq").alias("seq"))
    goals = goals.groupBy("batch_id").agg(F.min_by("code", "seq").alias("first_truth"), F.count("*").alias("truths"))
    near = numbered.join(goals, "batch_id").withColumn("apart", _apart(F.col("code"), F.col("first_truth")))
    starts = near.where(F.col("apart") <= 2).groupBy("batch_id").agg(F.min(F.struct("apart", "idx")).alias("s"))
    span = goals.join(starts, "batch_id").select("batch_id", F.col("s.idx").alias("start"), "truths")
    return numbered.join(span, "batch_id").where((F.col("idx") >= F.col("start")) & (F.col("idx") < F.col("start") + F.col("truths"))).drop("start", "truths")


BUCKET_PAIRS = 1_000_000


def _thirds(code: Column) -> Column:
    """Three cuts of a compact code; two substitutions leave at least one intact."""
    flat = codes.compact(code)
    third = F.ceil(F.length(flat) / 3).cast("int")
    return F.transform(
        F.sequence(F.lit(0), F.lit(2)), lambda i: F.concat_ws(":", F.length(flat).cast("string"), i.cast("string"), F.substr(flat, i * third + 1, third))
    )


def _wiped(code: Column) -> Column:
    """The compact code with every pair of positions wiped: two substitutions share exactly such a key."""
    flat = codes.compact(code)
    size = F.length(flat)
    wipe = lambda text, i: F.concat(F.left(text, i - 1), F.lit("*"), F.substr(text, i + 1, size))
    firsts = F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.transform(F.sequence(i + 1, size), lambda j: F.xxhash64(wipe(wipe(flat, i), j))))
    return F.flatten(firsts)


def close_pairs(truth: DataFrame, predicted: DataFrame, bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """Pairs of one batch that differ in one or two characters.

    Codes meet through an intact third. A bucket that would compare too many pairs is left out of
    that join and its codes meet through two wiped positions, where a key holds at most one code per
    pair of characters.
    """
    left = truth.select("batch_id", F.col("code").alias("truth"), F.col("seq").alias("t"))
    right = predicted.select("batch_id", F.col("code").alias("predicted"), F.col("seq").alias("p"))
    by_third = cut(left.withColumn("key", F.explode(_thirds(F.col("truth")))))
    other = cut(right.withColumn("key", F.explode(_thirds(F.col("predicted")))))
    sizes = by_third.groupBy("batch_id", "key").agg(F.count("*").alias("a")).join(other.groupBy("batch_id", "key").agg(F.count("*").alias("b")), ["batch_id", "key"])
    crowded = cut(sizes.where(F.col("a") * F.col("b") > bucket_pairs).select("batch_id", "key"))
    apart = _apart(F.col("truth"), F.col("predicted"))
    near = lambda pairs: pairs.withColumn("apart", apart).where(F.col("apart").between(1, 2)).select("batch_id", "truth", "t", "predicted", "p", "apart")
    keep = lambda rows: rows.join(crowded, ["batch_id", "key"], "left_anti")
    pick = lambda rows, *names: rows.join(crowded, ["batch_id", "key"], "left_semi").select("batch_id", *names).distinct()
    plain = near(keep(by_third).join(keep(other), ["batch_id", "key"]))
    a = pick(by_third, "truth", "t").withColumn("mask", F.explode(_wiped(F.col("truth"))))
    b = pick(other, "predicted", "p").withColumn("mask", F.explode(_wiped(F.col("predicted"))))
    return plain.unionByName(near(a.join(b, ["batch_id", "mask"]))).distinct()


#: Rounds in which all free first candidates choose at once, before chains are walked.
ROUNDS = 4


def _chosen_in_order(pairs: DataFrame) -> DataFrame:
    """The serial choice, one component of the confirmed codes that share predictions at a time."""
    shared = pairs.groupBy("batch_id", "p").agg(F.min("t").alias("b"))
    links = pairs.join(shared, ["batch_id", "p"]).select("batch_id", F.col("t").alias("a"), "b")
    alone = links.where("a = b").select("batch_id", F.col("a").alias("node"))
    named = components(links.where("a <> b"), ["batch_id"])
    named = named.unionByName(alone.distinct().join(named.select("batch_id", "node"), ["batch_id", "node"], "left_anti").withColumn("component", F.col("node")))
    rows = pairs.join(named.withColumnRenamed("node", "t"), ["batch_id", "t"])

    def walk(batches):
        key, used, done = None, set(), None
        for batch in batches:
            keep = []
            for row in batch[["batch_id", "component", "t", "p"]].itertuples(index=False):
                if row[:2] != key:
                    key, used, done = row[:2], set(), None
                fits = row.t != done and row.p not in used
                if fits:
                    used.add(row.p)
                    done = row.t
                keep.append(fits)
            yield batch.loc[keep, ["batch_id", "t", "p", "truth", "predicted"]]

    names = ["batch_id", "component"]
    ordered = rows.repartition(*names).sortWithinPartitions(*names, "t", "apart", "p")
    kinds = pairs.select("batch_id", "t", "p", "truth", "predicted").schema
    return ordered.mapInPandas(walk, kinds)


def diff_with_truth(predicted: DataFrame, truth: DataFrame, bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """Outcome per code: correct, confused (nearest free prediction within two characters), missing, false_positive.

    Confirmed codes choose in order and a prediction is used once. In a few rounds every confirmed code chooses that
    is the first candidate of all predictions it could take; what longer chains leave is told apart into connected
    components, each of which chooses in order in one pass. Only close pairs are touched.
    """
    shown = predicted.groupBy("batch_id", "code").agg(F.min("seq").alias("seq"))
    goals = truth.where("code IS NOT NULL").groupBy("batch_id", "code").agg(F.min("seq").alias("seq"))
    joined = goals.join(shown.select("batch_id", "code", F.lit(True).alias("hit")), ["batch_id", "code"], "left")
    correct = joined.where("hit").select("batch_id", F.col("code").alias("truth"), F.col("code").alias("predicted"), F.lit("correct").alias("outcome"))
    open_truth = cut(joined.where("hit IS NULL").drop("hit"))
    free = cut(shown.join(goals.select("batch_id", "code"), ["batch_id", "code"], "left_anti"))
    pairs = cut(close_pairs(open_truth, free, bucket_pairs))
    choices, left = [], True
    for _ in range(ROUNDS):
        left = not pairs.isEmpty()
        if not left:
            break
        first = pairs.groupBy("batch_id", "p").agg(F.min("t").alias("first_t"))
        ready = pairs.join(first, ["batch_id", "p"]).groupBy("batch_id", "t").agg(
            F.bool_and(F.col("first_t") == F.col("t")).alias("ready"), F.min(F.struct("apart", "p", "truth", "predicted")).alias("c")
        ).where("ready")
        picks = cut(ready.select("batch_id", "t", F.col("c.p").alias("p"), F.col("c.truth").alias("truth"), F.col("c.predicted").alias("predicted")))
        choices.append(picks)
        pairs = cut(pairs.join(picks.select("batch_id", "t"), ["batch_id", "t"], "left_anti").join(picks.select("batch_id", "p"), ["batch_id", "p"], "left_anti"))
    if left:
        choices.append(_chosen_in_order(pairs))
    chosen = reduce(DataFrame.unionByName, choices) if choices else pairs.select("batch_id", "t", "p", "truth", "predicted")
    label = lambda df, truth_col, predicted_col, name: df.select(
        "batch_id", truth_col.alias("truth"), predicted_col.alias("predicted"), F.lit(name).alias("outcome")
    )
    none = F.lit(None).cast("string")
    missing = open_truth.join(chosen.select("batch_id", F.col("truth").alias("code")), ["batch_id", "code"], "left_anti")
    spare = free.join(chosen.select("batch_id", F.col("predicted").alias("code")), ["batch_id", "code"], "left_anti")
    return (
        correct.unionByName(label(chosen, F.col("truth"), F.col("predicted"), "confused"))
        .unionByName(label(missing, F.col("code"), none, "missing"))
        .unionByName(label(spare, none, F.col("code"), "false_positive"))
    )


def character_events(pairs: DataFrame) -> DataFrame:
    """One row per differing position of equally long (predicted, truth) pairs."""
    letters = F.zip_with(F.split("predicted", ""), F.split("truth", ""), lambda w, c: F.struct(w.alias("wrong"), c.alias("correct")))
    same = pairs.where(F.length("predicted") == F.length("truth"))
    flat = same.select("font_hash", "seq", "ts", F.posexplode(letters).alias("position", "p"))
    return flat.where("p.wrong <> p.correct").select(
        "font_hash", "seq", "ts", F.col("position").cast("long").alias("position"), F.col("p.wrong").alias("wrong"), F.col("p.correct").alias("correct")
    )


def learned_rules(events: DataFrame) -> DataFrame:
    """Counted rules per font: character pairs, and pairs at a position. Long format, one row per rule."""
    pair = F.concat("wrong", F.lit(">"), "correct")
    rule = F.explode(
        F.array(
            F.struct(F.lit("pair").alias("kind"), pair.alias("key")),
            F.struct(F.lit("position").alias("kind"), F.concat(F.col("position").cast("string"), F.lit(":"), pair).alias("key")),
        )
    )
    return events.select("font_hash", "seq", rule.alias("r")).groupBy("font_hash", "r.kind", "r.key").agg(
        F.count("*").alias("n"), F.min("seq").alias("first_seq")
    )


def merge_profiles(updates: DataFrame) -> DataFrame:
    """Profile headers after all updates: summed samples, best confidence, enabled only if never disabled, newest source."""
    return updates.groupBy("font_hash").agg(
        F.sum("sample_count").alias("sample_count"), F.max("confidence").alias("confidence"), F.bool_and("enabled").alias("enabled"),
        F.max_by("card_type", F.when(F.col("card_type").isNotNull(), F.col("seq"))).alias("card_type"),
        F.max_by("source_user_id", F.when(F.col("source_user_id").isNotNull(), F.col("seq"))).alias("source_user_id"), F.max("ts").alias("last_seen"),
    )


def missing_rules(outcomes: DataFrame) -> DataFrame:
    """Missing codes are learned once each, under the unknown font."""
    return outcomes.where("outcome = 'missing'").select(F.lit(UNKNOWN_FONT).alias("font_hash"), F.concat(F.lit("missing:"), "truth").alias("key")).distinct()


def templates(profiles: DataFrame, rules: DataFrame, samples: int = TEMPLATE_SAMPLES) -> DataFrame:
    """Template header of every font with enough samples."""
    ripe = profiles.where(F.col("sample_count") >= samples)
    suffix = F.upper(F.left(F.substring_index("font_hash", "_", -1), F.lit(6)))
    return ripe.select(
        F.concat(F.upper("card_type"), F.lit("_FONT_"), suffix).alias("name"), "font_hash", "card_type", F.col("sample_count").alias("samples"),
        F.least(F.lit(99.9), F.lit(95.0) + F.least(F.col("sample_count"), F.lit(100)) / 20).alias("confidence"), "enabled",
    )


def best_rules(rules: DataFrame) -> DataFrame:
    """Most frequent correction per wrong character, and per position and wrong character; the earlier rule wins a tie."""
    wrong = F.split_part("key", F.lit(">"), F.lit(1))
    top = rules.withColumn("wrong_key", wrong).groupBy("font_hash", "kind", "wrong_key").agg(
        F.max(F.struct("n", (-F.col("first_seq")).alias("earlier"), "key")).alias("t"), F.min("first_seq").alias("first_seq")
    )
    return top.select("font_hash", "kind", "wrong_key", F.split_part(F.col("t.key"), F.lit(">"), F.lit(2)).alias("correct"), F.col("t.n").alias("n"), "first_seq")


def rule_book(best: DataFrame) -> DataFrame:
    """Rules of a font as two ordered arrays: by ``places`` and by ``letters``.

    A rule that another rule of the same place can lead to is marked ``chained``. The arrays are
    bounded by positions times characters.
    """
    at, by_place = F.split_part("wrong_key", F.lit(":"), F.lit(1)).cast("int"), F.col("kind") == "position"
    place = F.struct("first_seq", at.alias("position"), F.split_part("wrong_key", F.lit(":"), F.lit(2)).alias("wrong"), "correct", "n")
    letter = F.struct("first_seq", F.col("wrong_key").alias("wrong"), "correct", "n")
    books = best.groupBy("font_hash").agg(
        F.array_sort(F.collect_list(F.when(by_place, place))).alias("places"), F.array_sort(F.collect_list(F.when(~by_place, letter))).alias("letters")
    )
    return books.withColumn("places", with_chains(F.col("places")))


def gated_rules(rows: DataFrame, profiles: DataFrame, templates: DataFrame, books: DataFrame) -> DataFrame:
    """Rows with ``font_places`` of their own font, ``template_places`` / ``template_letters`` of the nearest template, and ``similarity``.

    A profile lends its rules if it is enabled and meant for long codes or any code, a template if it is enabled and
    more than 95 percent similar. Without rules the arrays are empty: such a code stays as it is.
    """
    own = profiles.where(F.col("enabled") & F.coalesce(F.col("card_type") == "long", F.lit(True)) & (F.col("font_hash") != UNKNOWN_FONT)).select("font_hash")
    own = own.join(books, "font_hash").select("font_hash", F.col("places").alias("font_places"))
    near = nearest_template(profiles.select("font_hash"), templates)
    by_template = books.select(F.col("font_hash").alias("template_hash"), F.col("places").alias("template_places"), F.col("letters").alias("template_letters"))
    near = near.join(by_template, "template_hash", "left").select("font_hash", "similarity", "template_places", "template_letters")
    held = profiles.select("font_hash").join(own, "font_hash", "left").join(near, "font_hash", "left")
    joined = rows.join(held, "font_hash", "left")
    place, letter = books.schema["places"].dataType, books.schema["letters"].dataType
    empty = {"font_places": place, "template_places": place, "template_letters": letter}
    return joined.withColumns({name: F.coalesce(name, F.array().cast(kind)) for name, kind in empty.items()})


def with_chains(places: Column) -> Column:
    return F.transform(
        places,
        lambda r: F.struct(
            r["first_seq"].alias("first_seq"), r["position"].alias("position"), r["wrong"].alias("wrong"), r["correct"].alias("correct"), r["n"].alias("n"),
            F.exists(places, lambda q: (q["position"] == r["position"]) & (q["correct"] == r["wrong"])).alias("chained"),
        ),
    )


def _swap(code: Column, rule: Column) -> Column:
    at = rule["position"]
    fixed = F.concat(F.left(code, at), rule["correct"], F.substr(code, at + 2, F.length(code)))
    return F.when(F.substr(code, at + 1, F.lit(1)) == rule["wrong"], fixed).otherwise(code)


def _applied(code: Column, places: Column, usable) -> Column:
    """Place rules in learned order; rules that cannot touch this code are skipped up front."""
    touching = F.filter(places, lambda r: usable(r) & (r["chained"] | (F.substr(code, r["position"] + 1, F.lit(1)) == r["wrong"])))
    return F.coalesce(F.aggregate(touching, code, _swap), code)


def _clear_pair(rule: Column) -> Column:
    return ~F.concat(rule["wrong"], rule["correct"]).isin(*AMBIGUOUS)


def corrected_by_template(code: Column, places: Column, letters: Column) -> Column:
    """Place rules in learned order; an invalid code also takes the letter rules. Kept only if valid."""
    letter = lambda ch: F.coalesce(F.get(F.filter(letters, lambda r: (r["wrong"] == ch) & _clear_pair(r)), F.lit(0))["correct"], ch)
    spelled = lambda text: F.array_join(F.transform(F.split(text, ""), letter), "")
    valid = lambda c: codes.is_long(F.upper(F.trim(c)))
    fixed = bind(_applied(code, places, _clear_pair), lambda text: F.when(valid(code), text).otherwise(spelled(text)))
    return bind(fixed, lambda out: F.when(valid(out), out).otherwise(code))


def safe_correction(code: Column, places: Column, similarity: Column, quality: Column, confidence: Column, conflicts: Column, has_font: Column) -> Column:
    """Guarded correction: only clear images, matched templates and rules seen at least ten times. Reasons are fixed values."""
    changed = _applied(code, places, lambda r: (r["n"] >= STRICT_RULE_COUNT) & _clear_pair(r))
    valid = lambda c: codes.is_long(F.upper(F.trim(c)))

    def decide(new: Column) -> Column:
        reason = (
            F.when((quality < 70) | (conflicts >= 2), "needs_review_low_quality_or_conflict")
            .when(valid(code) & (confidence >= 90) & (conflicts == 0) & ~has_font, "normal_font_protected")
            .when(~has_font, "no_font_template")
            .when(F.coalesce(similarity, F.lit(0)) < 95, "template_not_matched")
            .when(new == code, "no_eligible_rule")
            .when(~valid(new), "validator_rejected_correction")
            .otherwise("template_correction_applied")
        )
        return bind(reason, lambda why: F.struct(
            F.when(why == "template_correction_applied", new).otherwise(code).alias("code"), why.alias("reason"),
            why.isin("needs_review_low_quality_or_conflict", "validator_rejected_correction").alias("needs_review"),
        ))

    return bind(changed, decide)


def normalized_prefix(code: Column) -> Column:
    """A damaged first letter or digit of the most common prefix."""
    clean = F.upper(F.trim(code))
    first = F.when(clean.rlike("^[95$]07304"), F.concat(F.lit("S"), F.substr(clean, F.lit(2), F.length(clean)))).otherwise(clean)
    return F.when(first.rlike("^S[O0]7304"), F.concat(F.lit("S07"), F.substr(first, F.lit(4), F.length(first)))).otherwise(first)


def corrected_by_font(code: Column, places: Column) -> Column:
    """Learned place rules seen three times and limited to known look-alikes; the shape must stay valid."""
    usable = lambda r: (r["n"] >= RULE_COUNT) & F.concat(r["wrong"], r["correct"]).isin(*SAFE_SWAPS)
    kept = lambda start: bind(_applied(start, places, usable), lambda out: F.when(codes.is_long(out), out).otherwise(start))
    return bind(normalized_prefix(code), lambda start: F.when(codes.is_long(start), kept(start)).otherwise(code))


# -- case tables ------------------------------------------------------------------------------


def normalize_cases(cases: DataFrame) -> DataFrame:
    """First case per id; unknown states become needs_review, error types sorted and distinct."""
    named = cases.where(F.trim("case_id") != "").withColumn("case_id", F.trim("case_id"))
    first = first_per_key(named, ["case_id"], ["seq"])
    state = F.when(F.col("status").isin(*CONFIRMED, "needs_review"), F.col("status")).otherwise("needs_review")
    profile = F.coalesce(F.nullif(F.trim("profile"), F.lit("")), F.lit("unspecified"))
    kinds = F.array_sort(F.array_distinct(F.filter(F.transform("error_types", lambda x: F.trim(x)), lambda e: e != "")))
    return first.withColumns({"status": state, "profile": profile, "error_types": kinds})


def gold_cases(cases: DataFrame) -> DataFrame:
    """Confirmed cases, once per content; a declared hash that differs from the content fails the job."""
    declared = F.lower(F.trim(F.coalesce("declared_hash", F.lit(""))))
    wrong = (declared != "") & (declared != F.col("content_hash"))
    checked = cases.where(F.col("status").isin(*CONFIRMED)).withColumn(
        "content_hash", F.when(wrong, F.raise_error(F.concat(F.lit("content hash mismatch: "), "case_id")).cast("string")).otherwise(F.col("content_hash"))
    )
    first = first_per_key(checked, ["content_hash"], ["seq"])
    return first.withColumn("case_id", F.coalesce(F.nullif(F.trim("case_id"), F.lit("")), F.left("content_hash", F.lit(16))))


def training_split(cases: DataFrame) -> DataFrame:
    """Unique contents: a single long code becomes a label, everything else waits for annotation."""
    unique = first_per_key(cases, ["content_hash"], ["seq"])
    single = (F.size("expected_long") == 1) & (F.size("expected_short") == 0)
    return unique.withColumns({
        "target": F.when(single, "label").otherwise("annotate"), "label": F.when(single, F.upper(F.get("expected_long", F.lit(0)))),
        "reason": F.when(~single, "not_single_long"),
    })


def upsert_models(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Imported templates replace stored ones by name; a missing enabled flag keeps the stored one."""
    kept = current.join(incoming.select("name"), "name", "left_anti")
    old = current.select("name", F.col("enabled").alias("__old"))
    merged = incoming.join(old, "name", "left").withColumn("enabled", F.coalesce("enabled", "__old", F.lit(True))).drop("__old")
    return kept.unionByName(merged)
