"""Near-match joins with blocking keys, and containment filters. No cross joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import codes
from ledgerlens.functions.extract import inside_any
from ledgerlens.session import cut


def _masked(code: Column, first: Column, last: Column) -> Column:
    """The code with one position wiped, for every position from ``first`` to ``last``."""
    size = F.length(code)
    return F.transform(
        F.sequence(first, last), lambda i: F.concat(F.left(code, i - 1), F.lit("*"), F.substr(code, i + 1, size))
    )


#: Codes with one half in common that are compared with each other; more meet under masks.
HALF_CODES = 64


def near_duplicates(found: DataFrame, existing: DataFrame, threshold: float = 95.0, half_codes: int = HALF_CODES) -> DataFrame:
    """Pairs of one source and type that differ in exactly one character and are similar enough.

    Codes are made distinct first. Two codes with one difference have one half in common, so they meet under it. Where
    more than ``half_codes`` codes share a half, their other half is masked at each position: a masked key holds at most
    one row per character of the alphabet whatever the repetition in the data.
    """
    side = lambda rows, bit: rows.select("source", codes.clean(F.col("code")).alias("code"), F.lit(bit).alias("bit"))
    both = side(found, 3) if found is existing else side(found, 1).unionByName(side(existing, 2))
    known = both.groupBy("source", "code").agg(F.bit_or("bit").alias("sides"))
    size = F.length("code")
    typed = known.withColumn("code_type", codes.code_type(F.col("code"))).where("code_type IS NOT NULL")
    # Codes too short to reach the threshold with one difference need no keys.
    typed = cut(typed.where(F.round((size - 1) * 100 / size, 2) >= threshold))
    middle = F.floor(size / 2).cast("int")
    halves = F.array(
        F.struct(F.left("code", middle).alias("same"), (middle + 1).alias("first"), size.alias("last")),
        F.struct(F.concat(F.lit("*"), F.substr("code", middle + 1, size)).alias("same"), F.lit(1).alias("first"), middle.alias("last")),
    )
    halved = typed.select("source", "code_type", "code", "sides", F.inline(halves))
    key = F.xxhash64("source", "code_type", "same")
    crowded = halved.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > half_codes).select("key")
    apart = halved.withColumn("key", key)
    group = ["source", "code_type", "same"]
    few = apart.join(crowded, "key", "left_anti")
    masked = apart.join(crowded, "key", "left_semi").withColumn("same", F.explode(_masked(F.col("code"), F.col("first"), F.col("last"))))
    groups = few.select(*group, "code", "sides").unionByName(masked.select(*group, "code", "sides"))
    groups = groups.groupBy(*group).agg(F.collect_list(F.struct("code", "sides")).alias("near")).where(F.size("near") > 1)
    one = lambda a, b: F.levenshtein(a["code"], b["code"], 1) == 1
    pairs = F.flatten(F.transform(
        F.filter("near", lambda a: a["sides"].bitwiseAND(1) > 0),
        lambda a: F.transform(F.filter("near", lambda b: (b["sides"].bitwiseAND(2) > 0) & (F.length(a["code"]) == F.length(b["code"])) & one(a, b)), lambda b: F.struct(a["code"].alias("code"), b["code"].alias("existing_code"))),
    ))
    listed = groups.select("source", "code_type", F.explode(pairs).alias("p")).select("source", "code_type", "p.*")
    similar = codes.similarity(F.col("code"), F.col("existing_code"))
    return listed.withColumn("similarity", similar).where(F.col("similarity") >= threshold)


def slot_conflicts(cards: Column) -> Column:
    """Pairs of different codes of one image that are readings of the same printed code."""
    pairs = F.flatten(
        F.transform(
            cards,
            lambda left, i: F.transform(
                F.filter(F.slice(cards, i + 2, F.size(cards)), lambda right: (left != right) & codes.same_slot(left, right)),
                lambda right: F.struct(left.alias("left"), right.alias("right")),
            ),
        )
    )
    return pairs


def drop_contained(short: Column, long_codes: Column) -> Column:
    """Short codes that are not part of a long code of the same image."""
    return F.filter(short, lambda s: ~inside_any(s, long_codes))


def _segments(text: Column) -> Column:
    """Equal cuts of a hash, one more than the positions that may differ, for its own length and longer partners' lengths.

    Of two hashes the longer one has n characters; above 95 percent at most ceil(n / 20) - 1 positions differ, missing
    ones included, so one of the cuts made for n is the same in both.
    """
    size = F.length(text)
    spare = lambda n: F.greatest(F.ceil(n / 20).cast("int") - 1, F.lit(0))
    lengths = F.filter(F.sequence(size, size + F.floor(size / 19).cast("int") + 1), lambda n: n - size <= spare(n))
    cut_at = lambda n, i: F.floor(n * i / (spare(n) + 1)).cast("int")
    cuts = lambda n: F.transform(
        F.sequence(F.lit(0), spare(n)),
        lambda i: F.concat_ws(":", n.cast("string"), i.cast("string"), F.substr(text, cut_at(n, i) + 1, cut_at(n, i + 1) - cut_at(n, i))),
    )
    return F.flatten(F.transform(lengths, cuts))


def hash_core(font_hash: Column) -> Column:
    return F.substring_index(font_hash, "_", -1)


def core_similarity(left: Column, right: Column) -> Column:
    longest = F.greatest(F.length(left), F.length(right), F.lit(1))
    overlap = F.least(F.length(left), F.length(right))
    same = overlap - codes.hamming_overlap(left, right)
    return F.round(same.cast("decimal(9,0)") * 100 / longest, 2).cast("decimal(5,2)")


def nearest_template(fonts: DataFrame, templates: DataFrame, threshold: float = 95.0) -> DataFrame:
    """Best enabled template per distinct font hash, strictly above the threshold; ties by name.

    Above 95 percent fewer than one position in twenty differs, so at least one of the cuts in ``_segments`` is
    identical: an equi join on them finds every match.
    """
    if threshold < 95:
        raise ValueError("segment blocking needs a threshold of at least 95")
    left = fonts.select("font_hash").distinct().withColumn("core", hash_core(F.col("font_hash")))
    right = templates.where("enabled").select("name", F.col("font_hash").alias("template_hash")).withColumn(
        "template_core", hash_core(F.col("template_hash"))
    )
    segmented = left.withColumn("segment", F.explode(_segments(F.col("core"))))
    pairs = segmented.join(right.withColumn("segment", F.explode(_segments(F.col("template_core")))), "segment")
    score = F.when(F.col("font_hash") == F.col("template_hash"), F.lit(100).cast("decimal(5,2)")).otherwise(
        core_similarity(F.col("core"), F.col("template_core"))
    )
    scored = pairs.withColumn("similarity", score).where(F.col("similarity") > threshold)
    best = scored.groupBy("font_hash").agg(F.min(F.struct((-F.col("similarity")).alias("order"), "name", "template_hash")).alias("b"))
    return best.select("font_hash", F.col("b.name").alias("template"), F.col("b.template_hash").alias("template_hash"), (-F.col("b.order")).cast("decimal(5,2)").alias("similarity"))


def recover_prefix(lines: Column, existing: Column) -> Column:
    """Codes whose prefix has one misread digit, rewritten to the image's majority prefix.

    The majority needs two votes; the earliest prefix wins a tie.
    """
    prefixes = F.filter(F.transform(existing, lambda c: F.split_part(c, F.lit("-"), F.lit(1))), lambda p: p.rlike("^S07[0-9]{3}$"))
    distinct = F.array_distinct(prefixes)
    votes = F.transform(distinct, lambda p, i: F.struct(F.size(F.filter(prefixes, lambda q: q == p)).alias("n"), (-i).alias("first"), p.alias("prefix")))
    top = F.array_max(votes)
    pattern = r"(?<![A-Z0-9])[A-Z][0-9]{5}-[A-Z0-9]{4}-[A-Z0-9]{4}-[A-Z0-9]{5}(?![A-Z0-9])"
    seen = F.flatten(F.transform(lines, lambda line: F.regexp_extract_all(F.upper(line), F.lit(pattern), F.lit(0))))
    damaged = F.filter(
        seen,
        lambda c: ~c.rlike("^S07[0-9]{3}") & c.startswith("S0") & (codes.hamming(F.left(c, F.lit(6)), top["prefix"]) == 1),
    )
    rewritten = F.transform(damaged, lambda c: F.concat(top["prefix"], F.substr(c, F.lit(7), F.length(c))))
    return F.when(top["n"] >= 2, F.array_except(F.array_distinct(rewritten), existing)).otherwise(F.array().cast("array<string>"))


def majority_prefix(rows: DataFrame) -> DataFrame:
    """Most frequent prefix per image with at least two votes; the earliest wins a tie."""
    votes = rows.groupBy("image_id", "prefix").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    best = votes.groupBy("image_id").agg(F.max_by(F.struct("prefix", "n"), F.struct("n", -F.col("first"))).alias("b"))
    return best.where("b.n >= 2").select("image_id", F.col("b.prefix").alias("prefix"), F.col("b.n").alias("votes"))


def voted_codes(rows: DataFrame, minimum: int) -> DataFrame:
    """Codes read at least ``minimum`` times in an image, in first-seen order."""
    votes = rows.groupBy("image_id", "code").agg(F.count("*").alias("votes"), F.min("pos").alias("first_pos"))
    return votes.where(F.col("votes") >= minimum)
