"""Multi-source evidence queries: one image per row, readings assembled as structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import candidates, codes, evidence, extract
from ledgerlens.operators import images
from ledgerlens.plans.codes import joined
from ledgerlens.plans.registry import query
from ledgerlens.sources import payloads
from ledgerlens.sources.views import Tables

STRINGS, SCORED = "array<string>", "array<struct<code: string, score: double>>"


def _list(two: Column, first: str, second: str) -> Column:
    return F.when(two, F.array(first, second)).otherwise(F.array(first))


def _scored(two: Column, *pairs: tuple[str, str]) -> Column:
    items = [F.struct(F.col(code).alias("code"), F.col(score).alias("score")) for code, score in pairs]
    return F.when(two, F.array(*items)).otherwise(F.array(items[0]))


def readings(t: Tables) -> DataFrame:
    """Primary and cloud readings of every image."""
    two, rows = F.col("two"), t.wide.evidence
    none = F.array().cast(STRINGS)
    odd = F.col("image_id") % 7 == 0
    remote_text = F.when(odd, F.concat_ws("\n", "code_a", "code_b")).otherwise(F.concat_ws("\n", "code_a", "code_a"))
    remote = F.struct(
        _list(two, "code_a", "code_b").alias("cards"), none.alias("short"), remote_text.alias("raw_text"), F.col("uncertain"), F.col("expected"),
        F.col("conflict"), F.col("unresolved"),
        F.array(F.struct(F.col("code_a").alias("code"), F.col("s1").alias("score"))).alias("original"),
        F.array(F.struct(F.col("variant_a").alias("code"), F.col("s3").alias("score"))).alias("enhanced"),
        _scored(two, ("code_a", "s1"), ("code_b", "s2")).alias("original_rebuilt"),
        _scored(two, ("variant_a", "s3"), ("code_b", "s1")).alias("enhanced_rebuilt"),
        F.when(two, F.array().cast(SCORED)).otherwise(F.array(F.struct(F.col("code_a").alias("code"), F.col("s4").alias("score")))).alias("cpu"),
        (F.col("strip_only") | (F.col("variant_a") != F.col("code_a"))).alias("cpu_review"),
        F.array_compact(F.array(F.when((F.col("variant_a") != F.col("code_a")) & ~two, "variant_conflict"), F.when(F.col("strip_only") & ~two, "thin_strip"))).alias("cpu_reasons"),
    )
    cloud_text = F.concat_ws("\n", "cloud_a", F.when(F.col("image_id") % 3 == 0, F.col("cloud_a")))
    cloud = F.struct(
        _list(two, "cloud_a", "code_b").alias("cards"), none.alias("short"), cloud_text.alias("raw_text"), F.lit(0).alias("uncertain"),
    )
    return rows.withColumn("remote", remote).withColumn("cloud", cloud)




def _remote() -> Column:
    return F.col("remote")


def _cloud() -> Column:
    return F.col("cloud")


def _sections() -> Column:
    text = F.concat(F.lit("[REMOTE]\n"), F.col("remote.raw_text"), F.lit("\n[OCRSPACE]\n"), F.col("cloud.raw_text"))
    return evidence.sections(text)


@query("E1_exact_agreement", "SELECT image_id, CASE WHEN NOT two AND cloud_a = code_a AND (image_id % 7 <> 0 OR code_a = code_b) THEN code_a END AS code FROM evidence")
def e1(t: Tables) -> DataFrame:
    return readings(t).select("image_id", evidence.exact_agreement(_remote(), _cloud()).alias("code"))


#: The cloud's code may stand for the primary one: equal, two equal groups, or three substitutions.
SLOT_SQL = "(cloud_a = code_a OR substr(cloud_a, 1, 11) = substr(code_a, 1, 11) OR hamming(cloud_a, code_a) <= 3)"


@query(
    "E2_repeated_agreement",
    f"""SELECT image_id, CASE WHEN NOT two AND (image_id % 7 <> 0 OR code_a = code_b) AND {SLOT_SQL} AND (cloud_a = code_a
      OR (variant_a = code_a AND s1 >= 0.97 AND s3 >= 0.97 AND substr(cloud_a, 1, 16) = substr(code_a, 1, 16))) THEN code_a END AS code, CAST(NULL AS VARCHAR) AS wrapped_code FROM evidence""",
)
def e2(t: Tables) -> DataFrame:
    rows = readings(t).withColumn("parts", _sections())
    none = F.array().cast(STRINGS)
    return rows.select(
        "image_id", evidence.repeated_agreement(_remote(), F.col("parts"), none).alias("code"),
        evidence.repeated_agreement(_remote(), F.col("parts"), none, wrap_only=True).alias("wrapped_code"),
    )


@query(
    "E3_complete_dual_variant",
    """SELECT image_id, CASE WHEN two AND uncertain = 0 AND NOT conflict AND expected = 2 AND variant_a = code_a AND least(s1, s3) >= 0.95 AND greatest(s1, s3) >= 0.97 AND least(s2, s1) >= 0.95 AND greatest(s2, s1) >= 0.97
    THEN concat(code_a, ',', code_b) END AS codes FROM evidence""",
)
def e3(t: Tables) -> DataFrame:
    return readings(t).select("image_id", joined(evidence.complete_dual_variant(_remote())).alias("codes"))


@query(
    "E3_dual_variant_with_cloud",
    """SELECT image_id, CASE WHEN two AND uncertain = 0 AND coalesce(expected, 2) = 2 AND variant_a = code_a AND cloud_a = code_a AND least(s1, s2, s3) >= 0.97 THEN concat(code_a, ',', code_b) END AS codes FROM evidence""",
)
def e3b(t: Tables) -> DataFrame:
    return readings(t).select("image_id", joined(evidence.dual_variant(_remote(), _cloud())).alias("codes"))


@query(
    "E4_ordered_subsets",
    """WITH e AS (SELECT *, [code_a, code_b, code_s, cloud_a] AS w FROM evidence),
    n AS (SELECT *, list_position(list_transform(w, lambda x: CASE WHEN length(x) = length(variant_a) THEN hamming(x, variant_a) <= 1 ELSE false END), true) AS nth FROM e)
    SELECT image_id, coalesce(list_position(w[list_position(w, code_b) + 1:], cloud_a), 0) > 0 AS exact,
    coalesce(list_position(list_transform(w[nth + 1:], lambda x: CASE WHEN length(x) = length(code_b) THEN hamming(x, code_b) <= 1 ELSE false END), true), 0) > 0 AS within_one,
    coalesce(list_position(w[list_position(w, code_b) + 1:], code_a), 0) > 0 AS reversed FROM n""",
)
def e4(t: Tables) -> DataFrame:
    whole = F.array("code_a", "code_b", "code_s", "cloud_a")
    return t.wide.evidence.select(
        "image_id",
        evidence.ordered_within(F.array("code_b", "cloud_a"), whole).alias("exact"),
        evidence.ordered_within(F.array("variant_a", "code_b"), whole, evidence.close).alias("within_one"),
        evidence.ordered_within(F.array("code_b", "code_a"), whole).alias("reversed"),
    )


@query("E5_cloud_completes_slot", "SELECT image_id, CASE WHEN image_id % 2 = 0 THEN concat(code_a, ',', code_b, ',', substr(code_a, 1, 17), '22222') END AS codes FROM evidence")
def e5(t: Tables) -> DataFrame:
    rows = readings(t)
    third = F.concat(F.left("code_a", F.lit(17)), F.lit("22222"))
    damaged = F.concat(F.left("code_a", F.lit(17)), F.lit("2222O"))
    full = F.array("code_a", "code_b", third)
    remote = F.struct(
        F.array("code_a", "code_b").alias("cards"), F.array().cast(STRINGS).alias("short"), F.col("remote.raw_text"), F.lit(0).alias("uncertain"), F.lit(3).alias("expected"),
        F.col("remote.original_rebuilt"), F.array(F.struct(damaged.alias("code"), F.col("s3").alias("score"))).alias("enhanced_rebuilt"),
    )
    cloud = F.struct(
        full.alias("cards"), F.array().cast(STRINGS).alias("short"), F.lit(0).alias("uncertain"),
        F.concat_ws("\n", "code_a", third, F.when(F.col("image_id") % 2 == 0, third)).alias("raw_text"),
    )
    return rows.withColumn("remote3", remote).withColumn("cloud3", cloud).select(
        "image_id", joined(evidence.cloud_completes_slot(F.col("remote3"), F.col("cloud3"))).alias("codes")
    )


@query(
    "E6_confirmed_clear",
    """SELECT image_id, CASE WHEN NOT two AND uncertain = 0 AND NOT conflict AND coalesce(expected, 1) = 1 AND (
      (variant_a <> code_a AND s4 >= 0.90 AND least(s1, s3) >= 0.97 AND s1 >= 0.985)
      OR (variant_a = code_a AND CASE WHEN strip_only THEN least(s1, s3) >= 0.97 AND greatest(s1, s3) >= 0.985 ELSE NOT unresolved AND s1 >= 0.985 AND s3 >= 0.985 END)) THEN code_a END AS code FROM evidence""",
)
def e6(t: Tables) -> DataFrame:
    return readings(t).select("image_id", evidence.confirmed_clear(_remote()).alias("code"))


@query(
    "E7_variant_conflicts",
    """WITH c AS (SELECT *, image_id % 3 > 0 AND code_a <> variant_a AS clash, NOT two AND image_id % 3 = 0 AND substr(code_a, 1, 16) = substr(cloud_a, 1, 16) AND (image_id % 7 <> 0 OR substr(code_b, 1, 16) = substr(cloud_a, 1, 16)) AS again FROM evidence),
    d AS (SELECT *, NOT two AND uncertain = 0 AND NOT clash AND coalesce(expected, 1) = 1 AND ((variant_a <> code_a AND s4 >= 0.90 AND least(s1, s3) >= 0.97 AND s1 >= 0.985)
      OR (variant_a = code_a AND CASE WHEN strip_only THEN least(s1, s3) >= 0.97 AND greatest(s1, s3) >= 0.985 ELSE NOT unresolved AND s1 >= 0.985 AND s3 >= 0.985 END)) AS clear FROM c)
    SELECT image_id, clash, clash AND s3 > s1 AS cloud_resolves, CASE WHEN again THEN cloud_a END AS repeated_slot, CASE WHEN NOT two AND (code_a = cloud_a OR again) THEN 'cloud' ELSE 'remote' END AS strip_source,
      NOT two AND code_a <> cloud_a AND NOT again AS strip_conflict, CASE WHEN NOT two AND variant_a <> code_a THEN variant_a END AS same_slot,
      CASE WHEN clear THEN code_a WHEN variant_a = code_a OR (two AND variant_a = code_b) OR image_id % 2 = 0 THEN variant_a END AS strip_code, CASE WHEN two AND code_b <> code_a THEN code_b ELSE '' END AS kept FROM d""",
)
def e7(t: Tables) -> DataFrame:
    rows = readings(t)
    review = F.struct(
        (F.col("image_id") % 3 == 0).alias("resolved"), F.col("code_a").alias("review_card"), F.col("code_a").alias("selected_card"), F.lit("").alias("reason")
    )
    facts = rows.withColumn("clash", evidence.variants_conflict(F.array("code_a"), F.array("variant_a"), review))
    remote = F.col("remote").withField("conflict", F.col("clash"))
    facts = facts.withColumn("remote", remote).withColumn("strip", evidence.thin_strip_choice(_remote(), _cloud()))
    swapped = F.col("cloud").withField("cards", F.array("variant_a"))
    return facts.select(
        "image_id", "clash", evidence.cloud_resolves_conflict(_remote(), swapped).alias("cloud_resolves"),
        evidence.repeated_cloud_slot(_remote(), _cloud()).alias("repeated_slot"), F.col("strip.source").alias("strip_source"), F.col("strip.conflict").alias("strip_conflict"),
        evidence.cloud_same_slot(_remote(), swapped).alias("same_slot"),
        evidence.strip_candidate(F.array("code_a"), _remote(), swapped, F.col("image_id") % 2 == 0).alias("strip_code"),
        joined(evidence.drop_conflict(F.col("remote.cards"), F.array("code_a"), F.col("expected"), F.col("uncertain"))["cards"]).alias("kept"),
    )


@query(
    "E8_second_engine",
    """WITH a AS (SELECT *, image_id % 9 > 0 AND image_id % 8 > 0 AS act, cloud_a = code_b AS more FROM evidence)
    SELECT image_id, CASE WHEN act THEN concat(variant_a, ',', code_b) ELSE '' END AS cpu_codes, act AS review, CASE WHEN NOT act THEN code_a WHEN more THEN concat(variant_a, ',', code_b) ELSE variant_a END AS codes,
    CASE WHEN act THEN CAST(variant_a <> code_a AS INT) + CAST(more AS INT) ELSE 0 END AS resolved, coalesce(expected = 2 AND NOT unresolved AND uncertain = 0, false) AS structure_ok FROM a""",
)
def e8(t: Tables) -> DataFrame:
    cpu = F.struct(
        F.lit(True).alias("enabled"), (F.col("image_id") % 9 == 0).alias("shadow_only"), F.lit(True).alias("can_affect_result"), F.lit("strict").alias("confirmation_mode"),
        (F.col("image_id") % 8 > 0).alias("review_required"),
        F.array(F.struct(F.concat(F.lit("id "), F.col("variant_a")).alias("raw_text"), F.col("s4").alias("score")), F.struct(F.lower("code_b").alias("raw_text"), F.col("s2").alias("score"))).alias("lines"),
    )
    rows = t.wide.evidence.withColumn("cpu", cpu).withColumn("scores", evidence.cpu_scores(F.col("cpu")))
    confirmed = F.array_intersect(F.transform("scores", lambda s: s["code"]), F.array("variant_a", "cloud_a"))
    applied = rows.withColumn("done", evidence.apply_confirmed(F.array("code_a"), confirmed))
    return applied.select(
        "image_id", joined(F.transform("scores", lambda s: s["code"])).alias("cpu_codes"), evidence.cpu_review_needed(F.col("cpu"), F.lit(False)).alias("review"),
        joined(F.col("done.cards")).alias("codes"), F.col("done.resolved").alias("resolved"),
        evidence.structural_review_resolved(F.array(F.lit("marker_count_mismatch")), F.lit(2), F.col("expected"), F.col("unresolved"), F.col("uncertain")).alias("structure_ok"),
    )


@query(
    "E9_greedy_merge",
    """WITH v AS (SELECT *, variant_a <> code_a AS apart FROM evidence)
    SELECT image_id, concat(code_a, ',', code_b) AS merged, CAST(apart AS INT) AS suppressed, code_a AS worker_codes, concat_ws(',', CASE WHEN apart THEN 'line_wrap_conflict' END, 'incomplete_text_line') AS dropped,
    code_a AS settled, 1 + CAST(apart AS INT) AS uncertain FROM v""",
)
def e9(t: Tables) -> DataFrame:
    lines = F.array(F.concat(F.left("code_b", F.lit(16)), F.lit("-"), F.substr("code_b", F.lit(18), F.lit(2))))
    rows = t.wide.evidence.select(
        "image_id", evidence.merge_near(F.array("code_a"), F.array("variant_a", "code_b")).alias("m"),
        evidence.merge_with_worker(F.array("code_a"), F.array("variant_a", "code_b", "code_a"), lines).alias("w"),
        evidence.settle(F.array("code_a", "variant_a", F.regexp_replace("code_b", "..$", "0O"))).alias("s"),
    )
    return rows.select(
        "image_id", joined(F.col("m.cards")).alias("merged"), F.col("m.suppressed").alias("suppressed"), joined(F.col("w.cards")).alias("worker_codes"),
        joined(F.transform("w.dropped", lambda d: d["reason"])).alias("dropped"), joined(F.col("s.cards")).alias("settled"), F.col("s.uncertain").alias("uncertain"),
    )


@query(
    "E11_best_variant",
    """WITH v AS (SELECT image_id, s1, s3, s2, CASE WHEN variant_a = code_a THEN 1.0E0 ELSE 0.0E0 END AS agree FROM evidence),
    w AS (SELECT image_id, s1 * 45 + s2 * 20 + 1 / 20.0E0 * 20 + agree * 15 AS a, s3 * 45 + s1 * 20 + 1 / 20.0E0 * 20 + agree * 15 AS b FROM v)
    SELECT image_id, CASE WHEN b > a THEN 'enhanced' ELSE 'original' END AS variant, round(a, 6) AS original_score, round(b, 6) AS enhanced_score FROM w""",
)
def e11(t: Tables) -> DataFrame:
    variant = lambda code, avg, top: F.struct(F.array(code).alias("codes"), F.array(F.lit("x")).alias("texts"), F.col(avg).alias("avg_score"), F.col(top).alias("max_score"))
    best = evidence.best_variant(variant("code_a", "s1", "s2"), variant("variant_a", "s3", "s1"))
    return t.wide.evidence.select("image_id", best.alias("b")).select("image_id", "b.*")


@query("E12_original_recovery", "SELECT image_id, 2 AS original_codes, 1 AS enhanced_codes, CASE WHEN least(s1, s3) >= 0.97 THEN concat(code_a, ',', code_b) ELSE '' END AS recovered FROM evidence")
def e12(t: Tables) -> DataFrame:
    line = lambda text, score: F.struct(text.alias("text"), F.col(score).alias("score"))
    split = F.array(
        line(F.left("code_a", F.lit(12)), "s1"), line(F.substr("code_a", F.lit(13), F.lit(10)), "s3"), line(F.concat(F.lit("no "), F.col("code_b")), "s1")
    )
    lost = F.array(line(F.col("code_a"), "s1"), line(F.left("code_b", F.lit(16)), "s1"))
    rows = t.wide.evidence.select("image_id", extract.rebuilt_scores(split).alias("a"), extract.rebuilt_scores(lost).alias("b"))
    recovered = evidence.original_recovery(F.col("a"), F.col("b"), F.lit(2), F.lit(1))
    return rows.select("image_id", F.size("a").alias("original_codes"), F.size("b").alias("enhanced_codes"), joined(recovered).alias("recovered"))


@query(
    "E13_third_reading",
    """SELECT image_id, variant_a <> code_a AND substr(code_a, 22, 1) NOT IN ('Y') AND image_id % 3 > 0 AND s4 >= 0.9 AS confirmed FROM evidence""",
)
def e13(t: Tables) -> DataFrame:
    third = F.overlay("code_a", F.lit("Y"), 22, 1)
    lines = F.array(
        F.struct(F.when(F.col("image_id") % 3 > 0, F.concat(F.lit(" "), third)).otherwise("nothing").alias("raw_text"), F.col("s4").alias("score"))
    )
    different = F.col("variant_a") != F.col("code_a")
    confirmed = different & evidence.third_reading_confirms(F.col("code_a"), F.col("variant_a"), third, lines)
    return t.wide.evidence.select("image_id", confirmed.alias("confirmed"))


@query("E14_engine_assembly")
def e14(t: Tables) -> DataFrame:
    engines = t.wide.evidence.select(
        "image_id",
        F.array(
            F.concat(F.lit("text "), F.col("code_a"), F.lit(" tail")), F.concat(F.col("variant_a"), F.lit("\n"), F.col("code_b")),
            F.when(F.col("image_id") % 4 == 0, F.concat(F.lit("卡号: "), F.col("code_s"))).otherwise("empty"),
        ).alias("texts"),
    )
    return images.assemble(engines).select("image_id", joined(F.col("codes")).alias("codes"), joined(F.col("short")).alias("short_codes"), "uncertain")


@query("J12_image_sources")
def j12(t: Tables) -> DataFrame:
    """Payload evidence joined with the cloud reading of the image, then the route of ``operators.images``."""
    parsed = t.wide.worker_payload.select("image_id", F.from_json("payload", payloads.WORKER).alias("p")).select(
        "image_id", payloads.scored_codes(F.col("p.cards")).alias("selected"), payloads.scored_codes(F.col("p.ocr_original.cards")).alias("first"),
        payloads.scored_codes(F.col("p.ocr_enhanced.cards")).alias("second"),
    )
    both = parsed.join(readings(t).select("image_id", "remote", "cloud", "strip_only"), "image_id")
    remote = F.col("remote").withField("cards", F.transform("selected", lambda s: s["code"])).withField("original", F.col("first")).withField("enhanced", F.col("second"))
    routed = images.route_images(both.select("image_id", remote.alias("remote"), "cloud", F.col("strip_only").alias("strip")))
    return routed.select("image_id", "rule", joined(F.col("codes")).alias("codes"), "uncertain", "review")


@query(
    "S5_worker_evidence",
    """WITH c AS (SELECT image_id, 'selected' AS source, payload -> '$.cards' AS x FROM worker_payload UNION ALL SELECT image_id, 'original', payload -> '$.ocr_original.cards' FROM worker_payload
      UNION ALL SELECT image_id, 'enhanced', payload -> '$.ocr_enhanced.cards' FROM worker_payload),
    u AS (SELECT image_id, source, unnest(CAST(x AS STRUCT("text" VARCHAR, score DOUBLE)[])) AS e, generate_subscripts(CAST(x AS STRUCT("text" VARCHAR, score DOUBLE)[]), 1) - 1 AS pos FROM c)
    SELECT image_id, source, e.text AS code, min(pos) AS pos, max(e.score) AS score FROM u GROUP BY ALL""",
)
def s5(t: Tables) -> DataFrame:
    return payloads.worker_evidence(t.worker_payload)


@query(
    "P11_review_reason",
    """SELECT image_id, CASE WHEN coalesce(expected, 0) <= 1 AND NOT two AND (image_id % 7 <> 0 OR code_a = code_b) THEN NULL WHEN unresolved THEN 'unresolved_fragment'
      WHEN coalesce(expected, 0) > CASE WHEN two THEN 2 ELSE 1 END THEN 'fewer_than_expected'
      WHEN uncertain > 0 AND NOT (code_a = code_b OR (image_id % 7 <> 0 AND NOT two)) THEN 'conflict' END AS reason FROM evidence""",
)
def p11(t: Tables) -> DataFrame:
    rows = readings(t).withColumn("parts", _sections())
    return rows.select("image_id", evidence.review_reason(_remote(), F.lit(None).cast("int"), F.col("parts")).alias("reason"))


@query(
    "P12_cpu_risk_reasons",
    """SELECT image_id, concat_ws(',', CASE WHEN image_id % 3 = 0 THEN 'marker_count_mismatch' END, CASE WHEN variant_a <> code_a THEN 'variant_conflict' END, CASE WHEN s4 < 0.9 THEN 'low_confidence' END,
    CASE WHEN unresolved THEN 'line_recovered' END, CASE WHEN CAST(width AS DOUBLE) / height >= 3.0 THEN 'thin_strip' END) AS reasons FROM evidence""",
)
def p12(t: Tables) -> DataFrame:
    reading = lambda code, score: F.struct(
        F.array(F.col("code_a"), F.when(F.col("image_id") % 3 == 0, "S07304-AB").otherwise("total")).alias("texts"),
        F.array(F.struct(F.col(code).alias("code"), F.col(score).alias("score"))).alias("cards"),
    )
    reasons = evidence.cpu_risk_reasons(
        reading("code_a", "s4"), reading("code_a", "s1"), reading("variant_a", "s1"), F.col("unresolved"), F.col("width"), F.col("height")
    )
    return t.wide.evidence.select("image_id", joined(reasons).alias("reasons"))


@query(
    "P13_enhance_reason",
    """SELECT image_id, CASE WHEN image_id % 11 = 0 THEN 'original_cards=0' WHEN image_id % 11 = 1 THEN 'non_pubg_or_mixed_cards' WHEN two THEN 'multi_card_image' WHEN image_id % 11 = 2 THEN 'incomplete_pubg_line' WHEN s1 < 0.985 THEN 'card_score<0.985'
    WHEN image_id % 11 = 3 THEN 'not_needed' WHEN width < 350 THEN 'width<350' WHEN height > 500 THEN 'height>500' WHEN variance < 80 THEN 'image_variance<80' ELSE 'not_needed' END AS reason FROM evidence""",
)
def p13(t: Tables) -> DataFrame:
    kind = F.col("image_id") % 11
    item = lambda text: F.struct(text.alias("text"), F.col("s1").alias("score"))
    cards = (
        F.when(kind == 0, F.array(item(F.lit(" ")))).when(kind == 1, F.array(item(F.col("code_a")), item(F.col("code_s"))))
        .when(F.col("two"), F.array(item(F.col("code_a")), item(F.col("code_b")))).otherwise(F.array(item(F.col("code_a"))))
    )
    lines = F.when(kind == 2, F.array(item(F.lit("S07304-AB")))).when(kind == 3, F.array(item(F.col("code_a")), item(F.col("code_a")))).otherwise(F.array(item(F.col("code_a"))))
    return t.wide.evidence.select("image_id", evidence.enhance_reason(cards, lines, F.col("width"), F.col("height"), F.col("variance")).alias("reason"))


@query(
    "P10_review_queue",
    """SELECT image_id, reasons FROM (SELECT image_id, concat_ws(',', CASE WHEN conflict THEN 'needs_review' END, CASE WHEN variance < 70 THEN 'low_quality_image' END, CASE WHEN image_id % 9 = 0 THEN 'validator_failed' END,
    CASE WHEN two AND expected = 3 THEN 'ocr_conflict' END) AS reasons FROM evidence) AS s WHERE reasons <> '' ORDER BY image_id DESC LIMIT 100""",
)
def p10(t: Tables) -> DataFrame:
    reasons = evidence.queue_reasons(
        F.col("conflict"), F.col("variance"), (F.col("image_id") % 9 == 0).cast("int"), F.when(F.col("two"), 2).otherwise(1),
        F.when(F.col("expected") == 3, "").otherwise(F.col("code_a")),
    )
    queue = t.wide.evidence.select("image_id", joined(reasons).alias("reasons")).where("reasons <> ''")
    return queue.orderBy(F.desc("image_id")).limit(100)
