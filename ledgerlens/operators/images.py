"""The route of one image: primary and cloud readings to final codes. One image is one row, nothing shuffles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import candidates, codes, evidence, extract
from ledgerlens.functions.extract import bind
from ledgerlens.session import cut

STRINGS = "array<string>"


def _outcome(rule: str, found: Column, uncertain: Column | None = None, short: Column | None = None, review: Column | None = None) -> Column:
    return F.struct(
        F.lit(rule).alias("rule"), found.alias("codes"), (F.array().cast(STRINGS) if short is None else short).alias("short"),
        (F.lit(0) if uncertain is None else uncertain).cast("int").alias("uncertain"), (F.lit(False) if review is None else review).alias("review"),
    )


def _some(rule: str, found: Column) -> Column:
    """The outcome of a rule that names one code, or null."""
    return bind(found, lambda code: F.when(code.isNotNull(), _outcome(rule, F.array(code))))


def _several(rule: str, found: Column) -> Column:
    return bind(found, lambda cards: F.when(F.size(cards) > 0, _outcome(rule, cards)))


def complement_reason(remote: Column) -> Column:
    """Why the cloud is asked to complete the primary reading, or null."""
    listed = F.size(remote["cards"])
    return (
        F.when(remote["unresolved"], "unresolved_fragment")
        .when(extract.needs_cloud_reading(remote["raw_text"]), "recovered_prefix")
        .when(remote["expected"] > listed, "marker_count_above_codes")  # before the costly count
        .when(extract.marker_count(remote["raw_text"]) > listed, "marker_count_above_codes")
    )


def _strip(remote: Column, cloud: Column, parts: Column) -> Column:
    """A single-line image: a clear code, the cloud's repeated code, or one of both readings, marked where they disagree."""
    none = F.array().cast(STRINGS)

    def chosen(pick: Column) -> Column:
        from_cloud = pick["source"] == "cloud"
        side = remote.withField("cards", F.when(from_cloud, cloud["cards"]).otherwise(remote["cards"])).withField("short", F.when(from_cloud, cloud["short"]).otherwise(remote["short"]))
        agreed = _some("strip_repeated", evidence.repeated_agreement(side, parts, none))
        uncertain = F.when(from_cloud, cloud["uncertain"]).otherwise(remote["uncertain"])
        kept = _outcome("strip_reading", side["cards"], uncertain, side["short"], pick["conflict"])
        return F.when(from_cloud | pick["conflict"], F.coalesce(agreed, kept))

    return F.coalesce(
        _some("strip_clear", evidence.confirmed_clear(remote)), _some("strip_cloud_slot", evidence.repeated_cloud_slot(remote, cloud)),
        bind(evidence.thin_strip_choice(remote, cloud), chosen),
    )


def _merged(remote: Column, cloud: Column) -> Column:
    """Codes of both sources without guessing: second-engine replacements first, else the longer list leads."""
    confirmed = F.filter(F.transform(remote["cpu"], lambda c: c["code"]), lambda c: F.array_contains(cloud["cards"], c))
    lead = F.size(cloud["cards"]) >= F.size(remote["cards"])

    def merge(done: Column) -> Column:
        first = F.when(done["resolved"] > 0, done["cards"]).when(lead, cloud["cards"]).otherwise(remote["cards"])
        second = F.when((done["resolved"] == 0) & lead, remote["cards"]).otherwise(cloud["cards"])
        return bind(evidence.merge_near(first, second), settle)

    def settle(merged: Column) -> Column:
        clash = F.greatest(merged["suppressed"] - F.when(evidence.cloud_resolves_conflict(remote, cloud), 1).otherwise(0), F.lit(0))
        return bind(evidence.settle(merged["cards"]), lambda settled: finish(settled, clash))

    def finish(settled: Column, clash: Column) -> Column:
        text = F.concat_ws("\n", remote["raw_text"], cloud["raw_text"])
        short = evidence.one_type(settled["cards"], F.array_distinct(F.concat(remote["short"], cloud["short"])), codes.fold_text(text))
        uncertain = remote["uncertain"] + cloud["uncertain"] + clash + settled["uncertain"]
        return F.when((F.size(settled["cards"]) > 0) | (F.size(short) > 0), _outcome("merged", settled["cards"], uncertain, short))

    return bind(evidence.apply_confirmed(remote["cards"], confirmed), merge)


def _completed(remote: Column, cloud: Column, strip: Column, reason: Column, parts: Column) -> Column:
    """The first rule that applies to an image whose primary reading the cloud is asked to complete, or null."""
    return F.coalesce(
        _some("exact", evidence.exact_agreement(remote, cloud)),
        _several("cloud_slot", evidence.cloud_completes_slot(remote, cloud)),
        _several("dual_variant_cloud", evidence.dual_variant(remote, cloud)),
        # Only strips may take their evidence from lines that are not neighbours.
        F.when(strip, _some("repeated", evidence.repeated_agreement(remote, parts, cloud["cards"])))
        .otherwise(_some("repeated", evidence.repeated_agreement(remote, parts, cloud["cards"], wrap_only=True))),
        F.when(reason == "recovered_prefix", _some("prefix_review", evidence.cloud_same_slot(remote, cloud))),
        _merged(remote, cloud),
    )


def route_images(rows: DataFrame) -> DataFrame:
    """``rows(image_id, remote, cloud, strip)`` to the outcome of each image: rule, codes, short, uncertain, review.

    The first rule that applies decides. Images leave by gates, cheap ones first, so that only strips and images whose
    ``complement_reason`` asks for the cloud meet the costly rules; what a gate computes is a column of the next step.
    ``review`` asks for a second look at an image whose two readings of a single line disagree.
    """
    remote, cloud, strip, outcome = F.col("remote"), F.col("cloud"), F.col("strip"), F.col("o")
    text = F.concat(F.lit("[REMOTE]\n"), F.trim(remote["raw_text"]), F.lit("\n[OCRSPACE]\n"), F.trim(cloud["raw_text"]))
    base = rows.select("image_id", "remote", "cloud", F.coalesce(strip, F.lit(False)).alias("strip"), evidence.sections(text).alias("parts"))
    base = cut(base.withColumn("dual", evidence.complete_dual_variant(remote)))
    strips = cut(base.where(strip).withColumn("o", _strip(remote, cloud, F.col("parts"))))
    rest = base.where(~strip).unionByName(strips.where(outcome.isNull()).drop("o"))
    sure = F.coalesce(F.size("dual") > 0, F.lit(False))
    dual = rest.where(sure).withColumn("o", _outcome("dual_variant", F.col("dual")))
    rest = cut(rest.where(~sure).withColumn("reason", complement_reason(remote)))
    asked = rest.where("reason IS NOT NULL").withColumn("o", _completed(remote, cloud, strip, F.col("reason"), F.col("parts")))
    asked = cut(asked.drop("reason"))
    short = evidence.one_type(remote["cards"], remote["short"], codes.fold_text(remote["raw_text"]))
    plain = rest.where("reason IS NULL").drop("reason").unionByName(asked.where(outcome.isNull()).drop("o"))
    plain = plain.withColumn("o", _outcome("primary", remote["cards"], remote["uncertain"], short))
    parts = [strips.where(outcome.isNotNull()), dual, asked.where(outcome.isNotNull()), plain]
    return reduce(DataFrame.unionByName, [x.select("image_id", "o.*") for x in parts])


def _engine(text: Column) -> Column:
    """``struct<cards, uncertain>`` of one engine's text: wrapped lines where codes leave a trace, else the loose readers."""

    def read(folded: Column) -> Column:
        return bind(extract.has_long_trace(folded), lambda trace: bind(
            F.when(trace, extract.wrapped_lines(extract.line_facts(extract.lines_of(text)))),
            lambda wrapped: settle(F.when(trace, wrapped["codes"]).otherwise(F.concat(candidates.selected(text), extract.noisy_long(folded))), wrapped),
        ))

    def settle(listed: Column, wrapped: Column) -> Column:
        return bind(evidence.settle(listed), lambda settled: F.struct(
            settled["cards"].alias("cards"), (settled["uncertain"] + F.coalesce(wrapped["unresolved"].cast("int"), F.lit(0))).alias("uncertain"),
        ))

    return bind(codes.fold_text(text), read)


def assemble(engines: DataFrame) -> DataFrame:
    """``engines(image_id, texts)`` to one outcome per image, without a shuffle.

    Each engine's codes are settled, engines merge first-wins, and short codes come from the joined text if no engine
    has a long one.
    """
    read = engines.select("image_id", "texts", F.transform("texts", _engine).alias("e"))
    rows = read.select("image_id", "texts", F.flatten(F.transform("e", lambda r: r["cards"])).alias("all"), F.aggregate("e", F.lit(0).cast("long"), lambda n, r: n + r["uncertain"]).alias("uncertain"))
    rows = rows.withColumns({
        "merged": evidence.merge_near(F.array().cast(STRINGS), F.col("all")),
        "short": F.when(F.size("all") == 0, extract.short_codes(codes.fold_text(F.array_join("texts", "\n")))),
    })
    none = F.array().cast(STRINGS)
    return rows.select("image_id", F.col("merged.cards").alias("codes"), F.coalesce("short", none).alias("short"), (F.col("uncertain") + F.col("merged.suppressed")).alias("uncertain"))
