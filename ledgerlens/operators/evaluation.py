"""Evaluation and service figures: benchmark summaries, exact percentiles, policy gates, daily KPIs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.money import local_day
from ledgerlens.operators.blocks import Running, running
from ledgerlens.operators.learning import CONFIRMED


def ranked_values(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct integer values per key with how many rows are at or below them."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("__n"))
    return running(counts, keys, value, [Running("__upto", "sum", F.col("__n"))])


def percentiles(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact median, nearest-rank p95 and interpolated p50 / p95 of an integer column.

    Works on counted distinct values, so one key may hold any number of rows.
    """
    if not keys:
        return percentiles(rows.withColumn("__all", F.lit(0)), ["__all"], value).drop("__all")
    ranked = ranked_values(rows, keys, value)
    size = rows.groupBy(*keys).agg(F.count("*").alias("__size"))
    joined = ranked.join(size, keys)
    last = F.col("__size") - 1
    at = lambda rank: F.min(F.when(F.col("__upto") > rank, F.col(value)))
    floor = lambda share: F.floor(last * share / 100)
    ranks = {
        "m0": F.floor(last / 2), "m1": F.floor(F.col("__size") / 2), "near95": F.least(last, F.floor(F.col("__size") * 95 / 100)),
        "lo50": floor(50), "hi50": F.least(floor(50) + 1, last), "lo95": floor(95), "hi95": F.least(floor(95) + 1, last),
    }
    picked = joined.groupBy(*keys).agg(*[at(rank).alias(name) for name, rank in ranks.items()], F.first("__size").alias("size"))
    weight = lambda share: F.pmod((F.col("size") - 1) * share, F.lit(100))

    def mixed(share: int) -> Column:
        hundredths = F.col(f"lo{share}") * (100 - weight(share)) + F.col(f"hi{share}") * weight(share)
        return F.bround(hundredths.cast("decimal(30,0)") / 100, 0).cast("long")

    return picked.select(
        *keys, "size", ((F.col("m0") + F.col("m1")).cast("decimal(20,0)") / 2).cast("decimal(20,1)").alias("median"), F.col("near95").alias("p95_nearest"),
        mixed(50).alias("p50_linear"), mixed(95).alias("p95_linear"),
    )


def ratio(part: Column, whole: Column, empty: float, scale: int) -> Column:
    return F.when(whole == 0, F.lit(empty)).otherwise(F.bround(part.cast("decimal(20,0)") / whole, scale)).cast(f"decimal(20,{scale})")


def case_outcomes(results: DataFrame) -> DataFrame:
    """Missing and false codes, type mix and order of every benchmark case (arrays in, counts out)."""
    staged = results.withColumn("expected", F.concat("expected_long", "expected_short")).withColumn("actual", F.concat("actual_long", "actual_short"))
    return staged.withColumns({
        "missing": F.size(F.filter("expected", lambda c: ~F.array_contains("actual", c))), "false_codes": F.size(F.filter("actual", lambda c: ~F.array_contains("expected", c))),
        "mixed": (F.size("actual_long") > 0) & (F.size("actual_short") > 0), "in_order": F.col("actual") == F.col("expected"), "expected_codes": F.size("expected"),
    })


def benchmark_summary(results: DataFrame, keys: list[str]) -> DataFrame:
    """Quality counts, precision, recall and latency of a benchmark run."""
    if not keys:
        return benchmark_summary(results.withColumn("__all", F.lit(0)), ["__all"]).drop("__all")
    cases = case_outcomes(results)
    exact = (F.col("missing") == 0) & (F.col("false_codes") == 0) & F.col("in_order")
    counts = cases.groupBy(*keys).agg(
        F.count("*").alias("cases"), F.sum("expected_codes").alias("expected_codes"), F.sum("missing").alias("missing_codes"), F.sum("false_codes").alias("false_codes"),
        F.count_if("mixed").alias("type_mix_cases"), F.count_if(~F.col("in_order")).alias("order_mismatch_cases"), F.count_if(exact).alias("exact_matches"),
    ).withColumn("correct_codes", F.col("expected_codes") - F.col("missing_codes"))
    times = percentiles(results, keys, "elapsed_ms").select(*keys, F.col("median").alias("p50_ms"), F.col("p95_nearest").alias("p95_ms"))
    return counts.join(times, keys).withColumns({
        "precision": ratio(F.col("correct_codes"), F.col("correct_codes") + F.col("false_codes"), 1.0, 6), "recall": ratio(F.col("correct_codes"), F.col("expected_codes"), 1.0, 6),
    })


def worker_summary(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Worker benchmark: exact and enhanced rates, errors, interpolated latency over answered calls."""
    if not keys:
        return worker_summary(calls.withColumn("__all", F.lit(0)), ["__all"]).drop("__all")
    counts = calls.groupBy(*keys).agg(
        F.count("*").alias("cases"), F.count_if("exact").alias("exact_matches"), F.count_if("error").alias("request_errors"),
        F.count_if("enhanced_used").alias("enhanced_count"), F.count_if("cache_hit").alias("cache_hits"),
    ).withColumns({"exact_rate": ratio(F.col("exact_matches"), F.col("cases"), 0.0, 4), "enhanced_rate": ratio(F.col("enhanced_count"), F.col("cases"), 0.0, 4)})
    times = percentiles(calls.where(~F.col("error")), keys, "latency_ms").select(*keys, "p50_linear", "p95_linear")
    return counts.join(times, keys, "left").fillna(0, ["p50_linear", "p95_linear"])


def quality_report(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall and F1 from per-code outcomes."""
    correct = F.count_if(F.col("outcome") == "correct")
    counts = outcomes.groupBy(*keys).agg(
        correct.alias("correct"), F.count("predicted").alias("predicted"), F.count("truth").alias("total")
    )
    f1 = F.when(F.col("correct") == 0, 0).otherwise(2 * F.col("correct").cast("decimal(20,0)") / (F.col("predicted") + F.col("total")))
    return counts.withColumns({
        "precision": ratio(F.col("correct"), F.col("predicted"), 0.0, 4), "recall": ratio(F.col("correct"), F.col("total"), 0.0, 4),
        "f1": F.bround(f1, 4).cast("decimal(20,4)"),
    })


def top_rules(rules: DataFrame, limit: int = 10) -> DataFrame:
    """Most frequent rules; equal counts in key order."""
    return rules.groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(limit)


def policy_candidates(cases: DataFrame, confirmed_floor: int = 20, error_floor: int = 3, review_share: float = 0.25) -> DataFrame:
    """Per profile: confirmed, error and review counts and why it is not eligible (fixed values)."""
    sure = F.count_if(F.col("status").isin(*CONFIRMED))
    errors = F.count_if(F.col("status") == "confirmed_error")
    review = F.count_if(F.col("status") == "needs_review")
    counts = cases.groupBy("profile").agg(sure.alias("confirmed"), errors.alias("errors"), review.alias("reviews"), F.count("*").alias("cases"))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("confirmed") < confirmed_floor, "insufficient_confirmed_samples"), F.when(F.col("errors") < error_floor, "insufficient_confirmed_errors"),
            F.when(F.col("reviews") > F.col("cases") * review_share, "too_many_ambiguous_samples"),
        )
    )
    return counts.select(
        "profile", "confirmed", "errors", "reviews", ratio(F.col("errors"), F.col("confirmed"), 0.0, 6).alias("error_rate"),
        (F.size(reasons) == 0).alias("eligible"), reasons.alias("reasons"),
    )


def promotion(baseline: DataFrame, candidate: DataFrame, keys: list[str], slack: float = 1.5) -> DataFrame:
    """Compare two summaries; an empty reason list approves the candidate. Reasons are fixed values."""
    columns = ["cases", "expected_codes", "false_codes", "missing_codes", "type_mix_cases", "order_mismatch_cases", "exact_matches", "p95_ms"]
    old = baseline.select(*keys, *[F.col(c).alias(f"old_{c}") for c in columns])
    both = candidate.join(old, keys)
    worse = lambda c: F.col(c) > F.col(f"old_{c}")
    scope = (F.col("cases") != F.col("old_cases")) | (F.col("expected_codes") != F.col("old_expected_codes"))
    slow = F.col("p95_ms") > F.greatest(F.col("old_p95_ms") * slack, F.col("old_p95_ms") + 500)
    reasons = F.array_compact(
        F.array(
            F.when(scope, "benchmark_scope_changed"), F.when(worse("false_codes"), "false_positives_increased"), F.when(worse("missing_codes"), "missing_cards_increased"),
            F.when(worse("type_mix_cases"), "type_mix_increased"), F.when(worse("order_mismatch_cases"), "order_regressed"),
            F.when(F.col("exact_matches") <= F.col("old_exact_matches"), "no_exact_match_improvement"), F.when(slow, "p95_latency_regressed"),
        )
    )
    return both.select(*keys, (F.size(reasons) == 0).alias("approved"), reasons.alias("reasons"))


def service_days(calls: DataFrame) -> DataFrame:
    """Calls, outcomes, average latency of successes and rates per local day."""
    good = F.col("ok")
    won = F.count_if(good)
    total = F.sum(F.when(good, F.col("latency_ms")))
    share = lambda flag: F.bround((F.count_if(good & F.col(flag)) * 100).cast("decimal(20,0)") / F.count("*"), 1).cast("decimal(5,1)")
    return calls.groupBy(local_day(F.col("ts")).alias("day")).agg(
        F.count("*").alias("calls"), won.alias("success"), F.count_if(~good).alias("failed"), F.count_if("fallback").alias("fallbacks"),
        F.when(won > 0, F.floor(total / won)).otherwise(0).cast("long").alias("avg_latency_ms"), share("cache_hit").alias("cache_hit_percent"),
        share("enhanced_used").alias("enhanced_percent"),
    )


def worker_counters(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Runs, total and truncated average time; negative times count as zero."""
    spent = F.sum(F.greatest("latency_ms", F.lit(0)))
    return calls.groupBy(*keys).agg(F.count("*").alias("runs"), spent.alias("total_ms"), F.floor(spent / F.count("*")).cast("long").alias("average_ms"))


def cache_figures(rolling: DataFrame) -> DataFrame:
    """Images, distinct codes by type and repeated raw readings of the rolling day."""
    return rolling.agg(
        F.countDistinct("image_id").alias("images"), F.countDistinct("card").alias("codes"),
        F.countDistinct(F.when(F.col("kind") == "long", F.col("card"))).alias("long_codes"),
        F.countDistinct(F.when(F.col("kind") == "short", F.col("card"))).alias("short_codes"),
        (F.count("canonical") - F.countDistinct("canonical")).alias("repeats"),
    )


def rule_totals(profiles: DataFrame, rules: DataFrame) -> DataFrame:
    """Learning totals: samples, rules, corrected characters, missing codes, newest learning time."""
    facts = profiles.select(F.lit("profile").alias("kind"), F.col("sample_count").alias("n"), "enabled", "last_seen").unionByName(
        rules.select("kind", "n"), allowMissingColumns=True
    )
    is_profile = F.col("kind") == "profile"
    total = lambda flag: F.coalesce(F.sum(F.when(flag, F.col("n"))), F.lit(0))
    return facts.agg(
        F.count_if(is_profile).alias("profiles"), F.count_if("enabled").alias("enabled_profiles"), total(is_profile).alias("samples"), F.max("last_seen").alias("last_seen"),
        F.count_if(~is_profile).alias("rules"), total(F.col("kind") == "pair").alias("characters"), total(F.col("kind") == "missing").alias("missing"),
    )


def template_accuracy(templates: DataFrame) -> DataFrame:
    weight = F.sum(F.col("confidence").cast("decimal(6,2)") * F.col("samples"))
    return templates.agg(F.coalesce(F.bround(weight / F.sum("samples"), 2), F.lit(0)).cast("decimal(8,2)").alias("accuracy"))
