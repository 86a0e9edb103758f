"""Learning and data set queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import candidates, codes
from ledgerlens.operators import evaluation, fuzzy, learning
from ledgerlens.plans.codes import joined
from ledgerlens.plans.registry import query
from ledgerlens.sources.views import Tables


def sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    pairs = t.learning_pair
    return pairs.select("batch_id", "seq", F.col("predicted").alias("code")), pairs.select("batch_id", "seq", F.col("truth").alias("code"))


@query("Q1_candidate_expansion")
def q1(t: Tables) -> DataFrame:
    found = t.wide.noisy_text.select("doc_id", F.posexplode(candidates.audit_list(F.col("text"), "long")).alias("pos", "c"))
    return found.select("doc_id", "pos", F.col("c.code").alias("code"), joined(F.col("c.changes")).alias("changes"))


@query(
    "Q2_best_candidate",
    """WITH c AS (SELECT event_id, concat(substr(code_a, 1, 7), translate(substr(code_a, 8, 15), '58', 'SB')) AS x FROM audit_base),
    p AS (SELECT event_id, x, list_filter(range(1, 23), lambda i: contains('OILSB', substr(x, i, 1))) AS spots FROM c)
    SELECT event_id, x AS code, 110 AS score FROM p""",
)
def q2(t: Tables) -> DataFrame:
    text = F.concat(F.left("code_a", F.lit(7)), F.translate(F.substr("code_a", F.lit(8), F.lit(15)), "58", "SB"))
    rows = t.wide.audit_base.select("event_id", candidates.best(F.concat(F.lit(" "), text, F.lit(" ")), "long").alias("b"))
    return rows.select("event_id", F.col("b.code").alias("code"), F.col("b.score").alias("score"))


@query(
    "Q2_candidate_scores",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 100 END + CASE event_id % 4 WHEN 0 THEN 10 ELSE -5 * (event_id % 4) END + CASE WHEN event_id % 30 >= 3 THEN least(event_id % 30, 20) ELSE 0 END AS score,
    CASE WHEN event_id % 3 = 0 THEN -100 ELSE 20 + CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 10 ELSE -50 END + CASE WHEN event_id % 5 > 0 THEN CASE WHEN event_id % 2 = 0 THEN 40 ELSE 0 END + CASE WHEN event_id % 4 > 0 THEN 50 ELSE 0 END
      WHEN event_id % 4 > 0 THEN -50 ELSE 0 END END AS font_score FROM @events""",
)
def q2b(t: Tables) -> DataFrame:
    n = (F.col("event_id") % 4).cast("int")
    code = F.when(F.col("event_id") % 3 == 0, "broken").otherwise(F.col("code_a"))
    changes = F.slice(F.array(F.lit("8->B@9"), F.lit("5->S@8"), F.lit("0->O@2")), F.lit(1), n)
    candidate = F.struct(code.alias("code"), changes.alias("changes"))
    profile = F.struct(
        F.when(F.col("event_id") % 2 == 0, "fontA").otherwise("fontB").alias("font_hash"), (F.col("event_id") % 5 > 0).alias("enabled"), F.lit(-1).cast("long").alias("user_id"),
        F.array(F.lit("5>S")).alias("pairs"), F.array(F.lit("9:8>B")).alias("positions"),
    )
    return t.wide.audit_base.select(
        "event_id", candidates.score(candidate, "long", F.col("event_id") % 30).cast("long").alias("score"),
        candidates.profile_score(code, changes, "long", profile, F.lit("fontA"), F.col("user_id")).cast("long").alias("font_score"),
    )


@query("Q12_correction_counts")
def q12(t: Tables) -> DataFrame:
    from ledgerlens.functions import extract

    texts = t.wide.noisy_text.withColumns({
        "legacy": extract.noisy_long(codes.fold_text(F.col("text"))), "chosen": candidates.selected(F.col("text")),
    })
    counted = texts.withColumn("c", candidates.correction_counts(F.col("chosen"), F.col("legacy")))
    return counted.groupBy("source").agg(*[F.sum(f"c.{name}").alias(name) for name in ("fixed", "missing", "confused")])


@query(
    "Q3_learning_window",
    """WITH p AS (SELECT batch_id, predicted AS code, min(seq) AS seq FROM learning_pair GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY seq) AS idx FROM p),
    h AS (SELECT batch_id, truth AS code, min(seq) AS seq FROM learning_pair WHERE truth IS NOT NULL GROUP BY ALL), g AS (SELECT batch_id, min_by(code, seq) AS ft, count(*) AS truths FROM h GROUP BY batch_id),
    s AS (SELECT n.batch_id, min_by(idx, hamming(n.code, ft) * 1000000 + idx) AS start, any_value(truths) AS truths FROM n JOIN g ON g.batch_id = n.batch_id WHERE hamming(n.code, ft) <= 2 GROUP BY n.batch_id)
    SELECT n.batch_id, n.code, n.seq, n.idx FROM n JOIN s ON s.batch_id = n.batch_id WHERE idx >= start AND idx < start + truths""",
)
def q3(t: Tables) -> DataFrame:
    predicted, truth = sides(t)
    return learning.learning_window(predicted, truth).select("batch_id", "code", "seq", "idx")


def diffed(t: Tables) -> DataFrame:
    predicted, truth = sides(t)
    return learning.diff_with_truth(predicted, truth)


#: Confirmed codes choose one after the other; the state of a batch is the list of predictions already used.
DIFF_SQL = """
sh AS (SELECT batch_id, predicted AS code, min(seq) AS p FROM learning_pair GROUP BY ALL), go AS (SELECT batch_id, truth AS code, min(seq) AS t FROM learning_pair WHERE truth IS NOT NULL GROUP BY ALL),
op AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY t) AS k FROM go ANTI JOIN sh USING (batch_id, code)), fr AS (SELECT * FROM sh ANTI JOIN go USING (batch_id, code)),
ca AS (SELECT op.batch_id, k, op.code AS truth, list(fr.code ORDER BY hamming(op.code, fr.code), p) FILTER (fr.code IS NOT NULL) AS c
  FROM op LEFT JOIN fr ON fr.batch_id = op.batch_id AND hamming(op.code, fr.code) <= 2 GROUP BY ALL),
st AS (SELECT DISTINCT batch_id, CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS VARCHAR) AS truth, CAST(NULL AS VARCHAR) AS predicted FROM op UNION ALL
  SELECT batch_id, k, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, truth, pick FROM (
    SELECT ca.batch_id, ca.k, st.used, ca.truth, list_filter(ca.c, lambda x: NOT list_contains(st.used, x))[1] AS pick FROM st JOIN ca ON ca.batch_id = st.batch_id AND ca.k = st.k + 1) AS x),
df AS (SELECT batch_id, code AS truth, code AS predicted, 'correct' AS outcome FROM go JOIN sh USING (batch_id, code)
  UNION ALL SELECT batch_id, truth, predicted, CASE WHEN predicted IS NULL THEN 'missing' ELSE 'confused' END FROM st WHERE k > 0
  UNION ALL SELECT batch_id, NULL, fr.code, 'false_positive' FROM fr ANTI JOIN (SELECT batch_id, predicted AS code FROM st WHERE predicted IS NOT NULL) AS u USING (batch_id, code))"""


@query("Q4_truth_diff", f"WITH RECURSIVE {DIFF_SQL} SELECT batch_id, truth, predicted, outcome FROM df")
def q4(t: Tables) -> DataFrame:
    return diffed(t)


EVENT_SQL = """
ev AS (SELECT font_hash, seq, ts, i - 1 AS position, substr(predicted, i, 1) AS wrong, substr(truth, i, 1) AS correct FROM (
  SELECT *, unnest(range(1, 23)) AS i FROM learning_pair WHERE truth IS NOT NULL AND length(predicted) = 22) AS u WHERE substr(predicted, i, 1) <> substr(truth, i, 1)),
ru AS (SELECT font_hash, kind, key, count(*) AS n, min(seq) AS first_seq FROM (SELECT font_hash, seq, 'pair' AS kind, wrong || '>' || correct AS key FROM ev
  UNION ALL SELECT font_hash, seq, 'position', CAST(position AS STRING) || ':' || wrong || '>' || correct FROM ev) AS r GROUP BY ALL)"""


def events(t: Tables) -> DataFrame:
    return learning.character_events(t.wide.learning_pair.where("truth IS NOT NULL"))


@query("Q5_character_rules", f"WITH {EVENT_SQL} SELECT font_hash, kind, key, n, first_seq FROM ru")
def q5(t: Tables) -> DataFrame:
    return learning.learned_rules(events(t))


PROFILE_SQL = "pr AS (SELECT font_hash, seq, ts, CASE WHEN seq % 3 = 0 THEN 'long' END AS card_type, CASE WHEN seq % 5 = 0 THEN seq END AS source_user_id, CASE WHEN seq % 2 = 0 THEN 0.9 ELSE 0.5 END AS confidence, seq % 4001 <> 4000 AS enabled FROM learning_pair)"


def profile_updates(t: Tables) -> DataFrame:
    seq = F.col("seq")
    return t.learning_pair.select(
        "font_hash", "seq", "ts", F.when(seq % 3 == 0, "long").alias("card_type"), F.when(seq % 5 == 0, seq).alias("source_user_id"),
        F.when(seq % 2 == 0, 0.9).otherwise(0.5).cast("decimal(2,1)").alias("confidence"), (seq % 4001 != 4000).alias("enabled"), F.lit(1).cast("long").alias("sample_count"),
    )


@query(
    "Q5_merged_profiles",
    f"""WITH {PROFILE_SQL} SELECT font_hash, count(*) AS sample_count, CAST(max(confidence) AS DECIMAL(2,1)) AS confidence, bool_and(enabled) AS enabled, max_by(card_type, seq) FILTER (card_type IS NOT NULL) AS card_type,
    max_by(source_user_id, seq) FILTER (source_user_id IS NOT NULL) AS source_user_id, max(ts) AS last_seen FROM pr GROUP BY font_hash""",
)
def q5b(t: Tables) -> DataFrame:
    return learning.merge_profiles(profile_updates(t))


@query("Q5_missing_rules", f"WITH RECURSIVE {DIFF_SQL} SELECT DISTINCT 'unknown_font' AS font_hash, 'missing:' || truth AS key FROM df WHERE outcome = 'missing'")
def q5c(t: Tables) -> DataFrame:
    return learning.missing_rules(diffed(t))


BEST_SQL = f"""{EVENT_SQL}, be AS (SELECT font_hash, kind, split_part(key, '>', 1) AS wrong_key, split_part(key, '>', 2) AS correct, n, min(first_seq) OVER (PARTITION BY font_hash, kind, split_part(key, '>', 1)) AS first_seq,
  row_number() OVER (PARTITION BY font_hash, kind, split_part(key, '>', 1) ORDER BY n DESC, first_seq, key DESC) AS r FROM ru)"""


@query("Q6_best_rules", f"WITH {BEST_SQL} SELECT font_hash, kind, wrong_key, correct, n, first_seq FROM be WHERE r = 1")
def q6(t: Tables) -> DataFrame:
    return learning.best_rules(learning.learned_rules(events(t)))


@query(
    "Q6_templates",
    f"""WITH {PROFILE_SQL}, h AS (SELECT font_hash, count(*) AS c, bool_and(enabled) AS enabled FROM pr GROUP BY font_hash)
    SELECT concat('LONG_FONT_', upper(substr(font_hash, 1, 6))) AS name, font_hash, c AS samples, least(99.9E0, 95.0E0 + least(c, 100) / 20.0E0) AS confidence, enabled FROM h WHERE c >= 100""",
)
def q6b(t: Tables) -> DataFrame:
    heads = learning.merge_profiles(profile_updates(t))
    return learning.templates(heads, learning.learned_rules(events(t))).select("name", "font_hash", "samples", "confidence", "enabled")


def ruled(t: Tables) -> DataFrame:
    """Predictions beside the rules of their font's profile and of the nearest template; one bounded row per font."""
    rules = learning.learned_rules(events(t))
    book, heads = learning.rule_book(learning.best_rules(rules)), learning.merge_profiles(profile_updates(t))
    pairs = t.wide.learning_pair
    return learning.gated_rules(pairs, heads, learning.templates(heads, rules), book)


def _folded_sql(rules: str) -> str:
    """The prediction after the place rules ``place:wrong>correct`` of a list, one after the other."""
    place, wrong, correct = "CAST(split_part(r, ':', 1) AS INT) + 1", "substr(split_part(r, ':', 2), 1, 1)", "split_part(r, '>', 2)"
    step = f"CASE WHEN substr(a, {place}, 1) = {wrong} THEN substr(a, 1, {place} - 1) || {correct} || substr(a, {place} + 1) ELSE a END"
    return f"list_reduce(list_prepend(predicted, coalesce({rules}, CAST([] AS VARCHAR[]))), lambda a, r: {step})"


SAFE_SQL = ", ".join(f"'{pair}'" for pair in learning.SAFE_SWAPS)
# Every prediction of the table has the shape of a long code before and after its corrections.
RULED_SQL = f"""{BEST_SQL}, {PROFILE_SQL},
h AS (SELECT font_hash, count(*) >= 100 AND bool_and(enabled) AS matched, bool_and(enabled) AND coalesce(max_by(card_type, seq) FILTER (card_type IS NOT NULL), 'long') = 'long' AS lends FROM pr GROUP BY font_hash),
pl AS (SELECT font_hash, n, first_seq, wrong_key || '>' || correct AS rule, CAST(split_part(wrong_key, ':', 1) AS INT) AS place, split_part(wrong_key, ':', 2) || correct AS pair FROM be WHERE r = 1 AND kind = 'position'),
bk AS (SELECT font_hash, list(rule ORDER BY first_seq, place, pair) FILTER (pair NOT IN ('2Z', 'Z2')) AS sure, list(rule ORDER BY first_seq, place, pair) FILTER (pair NOT IN ('2Z', 'Z2') AND n >= 10) AS strict,
  list(rule ORDER BY first_seq, place, pair) FILTER (pair IN ({SAFE_SQL}) AND n >= 3) AS swaps FROM pl GROUP BY font_hash),
rows_ AS (SELECT lp.seq, lp.predicted, lp.font_hash, matched, CASE WHEN matched THEN sure END AS sure, CASE WHEN matched THEN strict END AS strict, CASE WHEN lends THEN swaps END AS swaps
  FROM learning_pair AS lp JOIN h ON h.font_hash = lp.font_hash LEFT JOIN bk ON bk.font_hash = lp.font_hash),
done AS (SELECT *, {_folded_sql("sure")} AS by_template, {_folded_sql("swaps")} AS by_font, {_folded_sql("strict")} AS fixed FROM rows_),
why AS (SELECT *, CASE WHEN seq % 10 = 0 THEN 'needs_review_low_quality_or_conflict' WHEN font_hash = 'font3' THEN 'no_font_template' WHEN NOT matched THEN 'template_not_matched' WHEN fixed = predicted THEN 'no_eligible_rule'
  ELSE 'template_correction_applied' END AS reason FROM done)"""


@query(
    "Q7_template_corrections",
    f"WITH {RULED_SQL} SELECT seq, by_template, by_font, CASE WHEN reason = 'template_correction_applied' THEN fixed ELSE predicted END AS safe_code, reason FROM why",
)
def q7(t: Tables) -> DataFrame:
    rows = ruled(t)
    safe = learning.safe_correction(
        F.col("predicted"), F.col("template_places"), F.col("similarity"), F.when(F.col("seq") % 10 == 0, 50).otherwise(90), F.lit(80), F.lit(0), F.col("font_hash") != "font3"
    )
    fixed = rows.select(
        "seq", "predicted", learning.corrected_by_template(F.col("predicted"), F.col("template_places"), F.col("template_letters")).alias("by_template"),
        learning.corrected_by_font(F.col("predicted"), F.col("font_places")).alias("by_font"), safe.alias("s"),
    )
    return fixed.select("seq", "by_template", "by_font", F.col("s.code").alias("safe_code"), F.col("s.reason").alias("reason"))


def font_tables(t: Tables) -> tuple[DataFrame, DataFrame]:
    base = F.concat(F.lit("long_font_"), F.md5("source"))
    fonts = t.documents.select(F.when(F.col("doc_id") % 3 == 0, F.overlay(base, F.lit("x"), 12, 1)).when(F.col("doc_id") % 3 == 1, F.overlay(base, F.lit("zzz"), 15, 3)).otherwise(base).alias("font_hash"))
    stored = t.documents.select(F.concat(F.lit("T_"), "source").alias("name"), base.alias("font_hash"), (F.col("source") != "src7").alias("enabled")).distinct()
    return fonts, stored


@query(
    "J11_nearest_template",
    """WITH b AS (SELECT doc_id, source, concat('long_font_', md5(source)) AS base FROM @documents),
    f AS (SELECT DISTINCT CASE WHEN doc_id % 3 = 0 THEN concat(substr(base, 1, 11), 'x', substr(base, 13)) WHEN doc_id % 3 = 1 THEN concat(substr(base, 1, 14), 'zzz', substr(base, 18)) ELSE base END AS font_hash FROM b),
    te AS (SELECT DISTINCT concat('T_', source) AS name, base AS th FROM b WHERE source <> 'src7'),
    p AS (SELECT font_hash, name, CASE WHEN font_hash = th THEN 100 ELSE round((32 - hamming(substr(font_hash, 11), substr(th, 11))) * 100.0 / 32, 2) END AS sim FROM f JOIN te ON true)
    SELECT font_hash, name AS template, CAST(sim AS DECIMAL(5,2)) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY font_hash ORDER BY sim DESC, name) AS r FROM p WHERE sim > 95) AS x WHERE r = 1""",
)
def j11(t: Tables) -> DataFrame:
    return fuzzy.nearest_template(*font_tables(t)).drop("template_hash")


CASE_SQL = """
nc AS (SELECT * FROM (SELECT case_id, seq, coalesce(nullif(trim(profile), ''), 'unspecified') AS profile, CASE WHEN status IN ('confirmed_match', 'confirmed_error', 'needs_review') THEN status ELSE 'needs_review' END AS status, error_types,
  row_number() OVER (PARTITION BY trim(case_id) ORDER BY seq) AS r FROM audit_case) AS x WHERE r = 1)"""


def case_rows(t: Tables) -> DataFrame:
    rows = t.audit_case
    return rows.withColumns({c: codes.split_list(F.col(c)) for c in ("error_types", "expected_long", "expected_short")})


@query("Q10_normalised_cases", f"WITH {CASE_SQL} SELECT case_id, profile, status, array_to_string(list_sort(list_distinct(list_filter(split(error_types, ','), lambda e: e <> ''))), ',') AS error_types FROM nc")
def q10(t: Tables) -> DataFrame:
    return learning.normalize_cases(case_rows(t)).select("case_id", "profile", "status", joined(F.col("error_types")).alias("error_types"))


@query(
    "Q8_gold_cases",
    """SELECT case_id, content_md5 AS content_hash, profile, expected_long FROM (SELECT *, row_number() OVER (PARTITION BY content_md5 ORDER BY seq) AS r FROM audit_case WHERE status IN ('confirmed_match', 'confirmed_error')) AS x WHERE r = 1""",
)
def q8(t: Tables) -> DataFrame:
    gold = learning.gold_cases(case_rows(t).withColumnsRenamed({"content_md5": "content_hash"}).withColumn("declared_hash", F.when(F.col("seq") % 2 == 0, F.upper("content_hash"))))
    return gold.select("case_id", "content_hash", "profile", joined(F.col("expected_long")).alias("expected_long"))


@query(
    "Q9_training_split",
    """SELECT case_id, target, CASE WHEN target = 'label' THEN upper(expected_long) END AS label, CASE WHEN target = 'annotate' THEN 'not_single_long' END AS reason FROM (
    SELECT *, CASE WHEN expected_long <> '' AND NOT contains(expected_long, ',') AND expected_short = '' THEN 'label' ELSE 'annotate' END AS target, row_number() OVER (PARTITION BY content_md5 ORDER BY seq) AS r FROM audit_case) AS x WHERE r = 1""",
)
def q9(t: Tables) -> DataFrame:
    return learning.training_split(case_rows(t).withColumnRenamed("content_md5", "content_hash")).select("case_id", "target", "label", "reason")


@query(
    "Q11_model_import",
    """WITH te AS (SELECT DISTINCT concat('T_', source) AS name, source <> 'src7' AS enabled FROM @documents)
    SELECT name, CASE WHEN length(name) = 6 THEN 5 ELSE 1 END AS samples, CASE WHEN name = 'T_src3' THEN false ELSE enabled END AS enabled FROM te UNION ALL SELECT 'T_new', 7, true""",
)
def q11(t: Tables) -> DataFrame:
    _, stored = font_tables(t)
    current = stored.select("name", F.lit(1).alias("samples"), "enabled")
    changed = current.where("length(name) = 6 AND name <> 'T_src3'").select("name", F.lit(5).alias("samples"), F.lit(None).cast("boolean").alias("enabled"))
    off = current.where("name = 'T_src3'").select("name", F.lit(5).alias("samples"), F.lit(False).alias("enabled"))
    new = current.where("name = 'T_src1'").select(F.lit("T_new").alias("name"), F.lit(7).alias("samples"), F.lit(None).cast("boolean").alias("enabled"))
    return learning.upsert_models(current, changed.unionByName(off).unionByName(new))


@query(
    "A11_quality_report",
    f"""WITH RECURSIVE {DIFF_SQL}, c AS (SELECT batch_id, count(*) FILTER (outcome = 'correct') AS correct, count(predicted) AS predicted, count(truth) AS total FROM df GROUP BY batch_id)
    SELECT batch_id, correct, predicted, total, CAST(coalesce(round_even(correct / nullif(predicted, 0), 4), 0) AS DECIMAL(20,4)) AS "precision", CAST(coalesce(round_even(correct / nullif(total, 0), 4), 0) AS DECIMAL(20,4)) AS recall,
    CAST(CASE WHEN correct = 0 THEN 0 ELSE round_even(2 * correct / (predicted + total), 4) END AS DECIMAL(20,4)) AS f1 FROM c""",
)
def a11(t: Tables) -> DataFrame:
    return evaluation.quality_report(diffed(t), ["batch_id"])


@query("T3_top_rules", f"WITH {EVENT_SQL} SELECT key, CAST(sum(n) AS BIGINT) AS n FROM ru WHERE kind = 'pair' GROUP BY key ORDER BY n DESC, key LIMIT 10")
def t3(t: Tables) -> DataFrame:
    return evaluation.top_rules(learning.learned_rules(events(t)).where("kind = 'pair'"))


@query(
    "A19_rule_totals",
    f"""WITH RECURSIVE {BEST_SQL}, {PROFILE_SQL}, {DIFF_SQL}, mi AS (SELECT count(DISTINCT truth) AS n FROM df WHERE outcome = 'missing'), h AS (SELECT font_hash, count(*) AS c, bool_and(enabled) AS en, max(ts) AS ls FROM pr GROUP BY font_hash)
    SELECT (SELECT count(*) FROM h) AS profiles, (SELECT count(*) FROM h WHERE en) AS enabled_profiles, (SELECT CAST(sum(c) AS BIGINT) FROM h) AS samples, (SELECT max(ls) FROM h) AS last_seen,
    (SELECT count(*) FROM ru) + (SELECT n FROM mi) AS rules, (SELECT CAST(sum(n) AS BIGINT) FROM ru WHERE kind = 'pair') AS characters, (SELECT n FROM mi) AS missing""",
)
def a19(t: Tables) -> DataFrame:
    missing = learning.missing_rules(diffed(t)).select("font_hash", F.lit("missing").alias("kind"), "key", F.lit(1).cast("long").alias("n"))
    rules = learning.learned_rules(events(t)).unionByName(missing, allowMissingColumns=True)
    return evaluation.rule_totals(learning.merge_profiles(profile_updates(t)), rules)


@query(
    "A19_template_accuracy",
    f"""WITH {PROFILE_SQL}, h AS (SELECT count(*) AS c FROM pr GROUP BY font_hash HAVING count(*) >= 100)
    SELECT CAST(coalesce(round(sum(CASE WHEN c >= 98 THEN 9990 ELSE 9500 + c * 5 END * c) / (100.0 * sum(c)), 2), 0) AS DECIMAL(8,2)) AS accuracy FROM h""",
)
def a19b(t: Tables) -> DataFrame:
    heads = learning.merge_profiles(profile_updates(t))
    return evaluation.template_accuracy(learning.templates(heads, heads))


@query(
    "A11_set_quality",
    """WITH p AS (SELECT DISTINCT batch_id, predicted FROM learning_pair), h AS (SELECT DISTINCT batch_id, truth FROM learning_pair WHERE truth IS NOT NULL),
    c AS (SELECT coalesce(p.batch_id, h.batch_id) AS batch_id, count(*) FILTER (predicted IS NOT NULL AND truth IS NOT NULL) AS correct, count(predicted) AS predicted, count(truth) AS total FROM p FULL JOIN h ON h.batch_id = p.batch_id AND h.truth = p.predicted GROUP BY 1)
    SELECT batch_id, correct, predicted, total, CAST(coalesce(round_even(correct / nullif(predicted, 0), 4), 0) AS DECIMAL(20,4)) AS "precision", CAST(coalesce(round_even(correct / nullif(total, 0), 4), 0) AS DECIMAL(20,4)) AS recall,
    CAST(CASE WHEN correct = 0 THEN 0 ELSE round_even(2 * correct / (predicted + total), 4) END AS DECIMAL(20,4)) AS f1 FROM c""",
)
def a11b(t: Tables) -> DataFrame:
    predicted, truth = sides(t)
    seen = lambda rows, bit: rows.where("code IS NOT NULL").select("batch_id", "code", F.lit(bit).alias("bit"))
    both = seen(predicted, 1).unionByName(seen(truth, 2)).groupBy("batch_id", "code").agg(F.bit_or("bit").alias("b"))
    outcomes = both.select(
        "batch_id", F.when(F.col("b") != 2, F.col("code")).alias("predicted"), F.when(F.col("b") != 1, F.col("code")).alias("truth"),
        F.when(F.col("b") == 3, "correct").otherwise("other").alias("outcome"),
    )
    return evaluation.quality_report(outcomes, ["batch_id"])


@query(
    "Q7_normalised_prefix",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN concat('S07304', substr(code_a, 7)) WHEN 1 THEN concat('S07304', substr(code_a, 7)) WHEN 2 THEN code_a ELSE concat('X07304', substr(code_a, 7)) END AS code FROM audit_base""",
)
def q7b(t: Tables) -> DataFrame:
    kind, rest = F.col("event_id") % 4, F.substr("code_a", F.lit(7), F.lit(16))
    damaged = (
        F.when(kind == 0, F.concat(F.lit(" 907304"), rest)).when(kind == 1, F.concat(F.lit("so7304"), rest)).when(kind == 2, F.col("code_a")).otherwise(F.concat(F.lit("X07304"), rest))
    )
    return t.audit_base.select("event_id", learning.normalized_prefix(damaged).alias("code"))
