"""Code queries: normalisation, extraction from text, validity, set operations, near matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import codes, extract, people
from ledgerlens.operators import fuzzy
from ledgerlens.plans.registry import query
from ledgerlens.plans.stats import audit_rows
from ledgerlens.sources.views import Tables


def joined(array: Column) -> Column:
    return F.array_join(array, ",")


@query(
    "F1_normalise_text",
    """SELECT doc_id, md5(regexp_replace(translate(upper(replace(text, 'ß', 'ss')), '‐‑‒–—―_', '-------'), '\\s+', '', 'g')) AS squeezed,
    md5(regexp_replace(translate(upper(replace(replace(text, 'ß', 'ss'), '5O7', '９O7')), 'ＳＯＱＤＩＬＴＺＢＧ０１２３４５６７８９—–－ー＿：；', 'SOQDILTZBG0123456789----_:;'), '(^|[^A-Z0-9])9([0ODQU][7TIL/?][0-9ODQUILTZEA$SGB]{3})', '\\1S\\2', 'g')) AS folded
    FROM noisy_text""",
)
def f1(t: Tables) -> DataFrame:
    # The two engines spell the capital of this letter differently, so both sides write it out.
    text = F.replace(F.col("text"), F.lit("ß"), F.lit("ss"))
    return t.wide.noisy_text.select(
        "doc_id", F.md5(codes.squeeze_text(text)).alias("squeezed"), F.md5(codes.fold_text(F.replace(text, F.lit("5O7"), F.lit("９O7")))).alias("folded")
    )


# Twins without look-around: a short code stands alone if it is a whole run of letters, digits and dashes.
RE2_DASHES = extract.DASHES.replace("\\u0085", "\\x{85}")
LOOSE_RE = f"S07[A-Z0-9]{{3}}{RE2_DASHES}+[A-Z0-9]{{4}}{RE2_DASHES}+[A-Z0-9]{{4}}{RE2_DASHES}+[A-Z0-9]{{5}}"
CONFIRMED_SQL = f"""
up AS (SELECT *, upper(replace(text, 'ß', 'ss')) AS u FROM typed),
li AS (SELECT *, list_concat(list_filter(list_transform(regexp_extract_all(u, '{LOOSE_RE}'), lambda x: regexp_replace(x, '{RE2_DASHES}+', '-', 'g')), lambda x: regexp_matches(x, '{codes.LONG}')),
  list_concat(regexp_extract_all(u, 'S07[A-Z0-9]{{3}}-[A-Z0-9]{{4}}-[A-Z0-9]{{4}}-[A-Z0-9]{{5}}'),
  list_filter(regexp_extract_all(u, '[A-Z0-9-]+'), lambda x: regexp_matches(x, '{codes.SHORT}') AND NOT starts_with(x, 'S07')))) AS l FROM up)"""


@query(
    "F2_confirmed_codes",
    f"""WITH typed AS (SELECT doc_id, text FROM noisy_text), {CONFIRMED_SQL},
    co AS (SELECT doc_id, unnest(l) AS code, generate_subscripts(l, 1) AS i FROM li), fi AS (SELECT doc_id, code, min(i) AS i FROM co GROUP BY ALL)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS pos, code, CASE WHEN regexp_matches(code, '{codes.LONG}') THEN 'long' WHEN regexp_matches(code, '{codes.SHORT}') THEN 'short' END AS code_type FROM fi""",
)
def f2(t: Tables) -> DataFrame:
    found = F.posexplode(extract.confirmed_codes(F.col("text"))).alias("pos", "code")
    return t.wide.noisy_text.select("doc_id", found).withColumn("code_type", codes.code_type(F.col("code")))


@query(
    "F2_codes_by_source",
    f"""WITH typed AS (SELECT source, text FROM noisy_text UNION ALL SELECT role, text FROM @conversations UNION ALL SELECT 'page', html FROM @pages), {CONFIRMED_SQL}
    SELECT source, CAST(sum(len(list_distinct(l))) AS BIGINT) AS codes, CAST(sum(greatest(coalesce(len(list_distinct(l)), 0), 1)) AS BIGINT) AS rows FROM li GROUP BY source""",
)
def f2b(t: Tables) -> DataFrame:
    turns = t.wide.conversations.select(F.col("role").alias("source"), "text")
    pages = t.wide.pages.select(F.lit("page").alias("source"), F.col("html").alias("text"))
    texts = t.wide.noisy_text.select("source", "text").unionByName(turns).unionByName(pages)
    found = texts.select("source", F.explode_outer(extract.confirmed_codes(F.col("text"))).alias("code"))
    return found.groupBy("source").agg(F.count("code").alias("codes"), F.count("*").alias("rows"))


@query("F3_noisy_long_codes")
def f3(t: Tables) -> DataFrame:
    folded = t.wide.noisy_text.select("doc_id", codes.fold_text(F.col("text")).alias("text"))
    return folded.select("doc_id", F.posexplode(extract.noisy_long(F.col("text"))).alias("pos", "code"))


@query("F4_short_codes")
def f4(t: Tables) -> DataFrame:
    folded = t.wide.noisy_text.select("doc_id", codes.fold_text(F.col("text")).alias("text"))
    return folded.select("doc_id", F.posexplode(extract.short_codes(F.col("text"))).alias("pos", "code"))


@query("F5_wrapped_lines")
def f5(t: Tables) -> DataFrame:
    facts = t.wide.noisy_text.select("doc_id", extract.line_facts(extract.lines_of(F.col("text"))).alias("facts"))
    rebuilt = facts.select("doc_id", extract.wrapped_lines(F.col("facts")).alias("w"))
    return rebuilt.select("doc_id", joined(F.col("w.codes")).alias("codes"), F.col("w.unresolved").alias("unresolved"))


@query("F6_marker_slots")
def f6(t: Tables) -> DataFrame:
    return t.wide.noisy_text.select("doc_id", extract.marker_count(F.col("text")).alias("slots"))


@query(
    "P9_needs_manual_row",
    r"""SELECT doc_id, regexp_matches(text, '(?i)(?:^|[^A-Z0-9])S0?7[A-Z0-9]{3}(?:[-\s_]+[A-Z0-9]{2,8}){1,4}') OR regexp_matches(text, '(?i)(?:^|[^A-Z0-9])S0?7[A-Z0-9]{3}(?:[^A-Z0-9]|$)')
      OR regexp_matches(text, '(?i)(?:^|[^A-Z0-9])(?:[A-Z0-9]{4,6}[-\s_]){2,3}[A-Z0-9]{4,6}(?:[^A-Z0-9]|$)') AS needs_row FROM noisy_text""",
)
def p9(t: Tables) -> DataFrame:
    return t.wide.noisy_text.select("doc_id", codes.needs_manual_row(F.col("text")).alias("needs_row"))


@query("P17_second_source_reason")
def p17(t: Tables) -> DataFrame:
    facts = t.wide.noisy_text.select(
        "doc_id", "text", extract.wrapped_lines(extract.line_facts(extract.lines_of(F.col("text")))).alias("w"), extract.marker_count(F.col("text")).alias("slots")
    )
    reason = (
        F.when(F.col("w.unresolved"), "unresolved_fragment")
        .when(extract.needs_cloud_reading(F.col("text")), "recovered_prefix")
        .when(F.col("slots") > F.size("w.codes"), "marker_count_above_codes")
    )
    return facts.select("doc_id", reason.alias("reason"))


@query(
    "U2_loosely_written",
    f"""WITH typed AS (SELECT doc_id, text FROM noisy_text), {CONFIRMED_SQL}, co AS (SELECT DISTINCT doc_id, unnest(l) AS code FROM li),
    st AS (SELECT doc_id, unnest(list_concat(regexp_extract_all(u, 'S07[A-Z0-9]{{3}}-[A-Z0-9]{{4}}-[A-Z0-9]{{4}}-[A-Z0-9]{{5}}'), regexp_extract_all(u, '[A-Z0-9-]+'))) AS code FROM up)
    SELECT doc_id, code FROM co ANTI JOIN st USING (doc_id, code)""",
)
def u2(t: Tables) -> DataFrame:
    return t.wide.noisy_text.select("doc_id", F.explode(extract.loosely_written(F.col("text"))).alias("code"))


VARIED_SQL = """
varied AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN code_a WHEN 1 THEN code_s WHEN 2 THEN lower(code_a) WHEN 3 THEN concat('X', code_a) WHEN 4 THEN concat(code_a, '-AB') WHEN 5 THEN replace(code_a, '-', '')
  WHEN 6 THEN concat(substr(code_a, 1, 21), '?') ELSE concat(substr(code_s, 1, 13), 'ab') END AS code, CASE WHEN event_id % 3 = 0 THEN 'short' ELSE 'long' END AS kind FROM audit_base)"""
LONG_RE, SHORT_RE = "^S07[A-Z0-9]{3}-[A-Z0-9]{4}-[A-Z0-9]{4}-[A-Z0-9]{5}$", "^[A-Z0-9]{4}-[A-Z0-9]{4}-[A-Z0-9]{4}$"


def varied(t: Tables) -> DataFrame:
    return t.sql(f"WITH {VARIED_SQL} SELECT * FROM varied")


@query(
    "P6_reject_reasons",
    f"""WITH {VARIED_SQL}, c AS (SELECT *, upper(trim(code)) AS x, split(upper(trim(code)), '-') AS g FROM varied)
    SELECT event_id, CASE WHEN kind = 'long' THEN CASE WHEN regexp_matches(x, '{LONG_RE}') THEN NULL WHEN NOT starts_with(x, 'S07') THEN 'pubg_prefix_not_s07' WHEN len(g) <> 4 THEN 'pubg_group_count_invalid'
      WHEN length(g[1]) <> 6 OR length(g[2]) <> 4 OR length(g[3]) <> 4 OR length(g[4]) <> 5 THEN 'pubg_group_length_invalid' WHEN regexp_matches(replace(x, '-', ''), '[^A-Z0-9]') THEN 'pubg_charset_invalid' ELSE 'pubg_format_invalid' END
    ELSE CASE WHEN regexp_matches(x, '{SHORT_RE}') THEN NULL WHEN len(g) <> 3 THEN 'psn_group_count_invalid' WHEN length(g[1]) <> 4 OR length(g[2]) <> 4 OR length(g[3]) <> 4 THEN 'psn_group_length_invalid'
      WHEN regexp_matches(replace(x, '-', ''), '[^A-Z0-9]') THEN 'psn_charset_invalid' ELSE 'psn_format_invalid' END END AS reject_reason FROM c""",
)
def p6(t: Tables) -> DataFrame:
    return varied(t).select("event_id", codes.reject_reason(F.col("code"), F.col("kind")).alias("reject_reason"))


@query(
    "P7_code_type",
    f"""WITH {VARIED_SQL} SELECT code_type, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(upper(trim(code)), '{LONG_RE}') THEN 'long' WHEN regexp_matches(upper(trim(code)), '{SHORT_RE}') THEN 'short' END AS code_type FROM varied) AS s GROUP BY code_type""",
)
def p7(t: Tables) -> DataFrame:
    return varied(t).groupBy(codes.code_type(F.col("code")).alias("code_type")).agg(F.count("*").alias("n"))


@query(
    "P8_forbidden_body",
    """SELECT event_id, regexp_matches(substr(c, 8), '[01OI]') AS forbidden FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN concat(substr(code_a, 1, 20), 'O', substr(code_a, 22, 1)) ELSE code_a END AS c FROM audit_base) AS s""",
)
def p8(t: Tables) -> DataFrame:
    changed = F.when(F.col("event_id") % 7 == 0, F.overlay("code_a", F.lit("O"), 21, 1)).otherwise(F.col("code_a"))
    return t.audit_base.select("event_id", codes.has_forbidden_body(changed).alias("forbidden"))


@query(
    "U3_ordered_union",
    """SELECT message_id, array_to_string(list_filter(u, lambda x, i: list_position(u, x) = i), ',') AS codes FROM (
    SELECT message_id, list_filter(split(raw_long, ',') || split(final_long, ','), lambda x: regexp_matches(x, '^S07[0-9]{3}-[A-Z0-9]{4}-[A-Z0-9]{4}-[A-Z0-9]{5}$')) AS u FROM audit_record) AS s""",
)
def u3(t: Tables) -> DataFrame:
    both = F.concat(codes.split_list(F.col("raw_long")), codes.split_list(F.col("final_long")))
    return t.audit_record.select("message_id", joined(codes.unique_valid(both, codes.is_long_strict)).alias("codes"))


@query(
    "U4_confirmed_by_both",
    """SELECT message_id, array_to_string(list_filter(split(raw_long, ','), lambda x: list_contains(split(final_long, ','), x)), ',') AS codes FROM audit_record""",
)
def u4(t: Tables) -> DataFrame:
    both = F.array_intersect(codes.split_list(F.col("raw_long")), codes.split_list(F.col("final_long")))
    return t.audit_record.select("message_id", joined(both).alias("codes"))


@query(
    "U1_truth_sets",
    """WITH p AS (SELECT DISTINCT batch_id, predicted FROM learning_pair), h AS (SELECT DISTINCT batch_id, truth FROM learning_pair WHERE truth IS NOT NULL)
    SELECT coalesce(p.batch_id, h.batch_id) AS batch_id, count(*) FILTER (predicted IS NOT NULL AND truth IS NOT NULL) AS both_count, count(*) FILTER (predicted IS NULL) AS missing_count, count(*) FILTER (truth IS NULL) AS extra_count
    FROM p FULL JOIN h ON h.batch_id = p.batch_id AND h.truth = p.predicted GROUP BY 1""",
)
def u1(t: Tables) -> DataFrame:
    from ledgerlens.operators.learning import truth_sets

    pairs = t.learning_pair
    return truth_sets(pairs.select("batch_id", F.col("predicted").alias("code")), pairs.select("batch_id", F.col("truth").alias("code")))


PAIR_SQL = "SELECT event_id, code_a, CASE WHEN event_id % 4 = 0 THEN code_a WHEN event_id % 4 = 1 THEN concat(substr(code_a, 1, 10), 'ZZ', substr(code_a, 13, 10)) WHEN event_id % 4 = 2 THEN substr(code_a, 1, 21) ELSE code_b END AS other FROM audit_base"


@query(
    "F11_distances",
    f"""WITH p AS ({PAIR_SQL}), d AS (SELECT *, length(code_a) = length(other) AS same_len,
      len(list_filter(range(1, 23), lambda i: i <= least(length(code_a), length(other)) AND substr(code_a, i, 1) <> substr(other, i, 1))) AS mism,
      replace(code_a, '-', '') AS ca, replace(other, '-', '') AS cb FROM p)
    SELECT event_id, CAST(CASE WHEN same_len THEN mism ELSE greatest(length(code_a), length(other)) END AS BIGINT) AS hamming, CAST(mism AS BIGINT) AS hamming_overlap,
      CAST(CASE WHEN same_len THEN round((22 - mism) * 100.0 / 22, 2) ELSE 0 END AS DECIMAL(5,2)) AS similarity,
      CASE WHEN length(ca) = length(cb) THEN hamming(ca, cb) <= 3 WHEN abs(length(ca) - length(cb)) = 1 THEN levenshtein(ca, cb) <= 2 ELSE false END AS likely_same FROM d""",
)
def f11(t: Tables) -> DataFrame:
    a, b = F.col("code_a"), F.col("other")
    return t.sql(PAIR_SQL).select(
        "event_id", codes.hamming(a, b).cast("long").alias("hamming"), codes.hamming_overlap(a, b).cast("long").alias("hamming_overlap"),
        codes.similarity(a, b).alias("similarity"), codes.likely_same(a, b).alias("likely_same"),
    )


@query(
    "J8_near_duplicates",
    """WITH c AS (SELECT DISTINCT concat('chat', CAST(chat_id AS STRING)) AS source, code_type, code FROM code_sighting)
    SELECT a.source, a.code_type, a.code, b.code AS existing_code, CAST(95.45 AS DECIMAL(5,2)) AS similarity FROM c AS a JOIN c AS b ON b.source = a.source AND b.code_type = a.code_type AND a.code <> b.code
    AND length(a.code) = length(b.code) AND hamming(a.code, b.code) = 1 AND a.code_type = 'long'""",
)
def j8(t: Tables) -> DataFrame:
    seen = t.code_sighting.select(F.concat(F.lit("chat"), F.col("chat_id").cast("string")).alias("source"), "code")
    return fuzzy.near_duplicates(seen, seen)


@query(
    "J9_slot_conflicts",
    """WITH a AS (SELECT image_id, x[1] AS l, x[2] AS r FROM (SELECT event_id AS image_id, [code_a, CASE WHEN event_id % 3 = 0 THEN concat(substr(code_a, 1, 21), 'Z') WHEN event_id % 3 = 1 THEN concat(substr(code_a, 1, 15), 'Q', substr(code_a, 17, 6)) ELSE code_b END] AS x FROM audit_base) AS s)
    SELECT image_id, l AS left_code, r AS right_code FROM a WHERE l <> r AND (split_part(l, '-', 1) = split_part(r, '-', 1) AND split_part(l, '-', 2) = split_part(r, '-', 2) AND hamming(split_part(l, '-', 3), split_part(r, '-', 3)) <= 1
      OR hamming(replace(l, '-', ''), replace(r, '-', '')) <= 3)""",
)
def j9(t: Tables) -> DataFrame:
    kind = F.col("event_id") % 3
    other = F.when(kind == 0, F.overlay("code_a", F.lit("Z"), 22, 1)).when(kind == 1, F.overlay("code_a", F.lit("Q"), 16, 1)).otherwise(F.col("code_b"))
    pairs = t.audit_base.select(F.col("event_id").alias("image_id"), F.explode(fuzzy.slot_conflicts(F.array("code_a", other))).alias("p"))
    return pairs.select("image_id", F.col("p.left").alias("left_code"), F.col("p.right").alias("right_code"))


@query(
    "J10_contained_short_codes",
    """WITH s AS (SELECT event_id AS image_id, code_a, [code_s, concat(substr(code_a, 8, 9), '-', substr(code_a, 18, 4)), substr(replace(code_a, '-', ''), 3, 4) || '-' || substr(replace(code_a, '-', ''), 7, 4) || '-' || substr(replace(code_a, '-', ''), 11, 4)] AS shorts FROM audit_base)
    SELECT image_id, array_to_string(list_filter(shorts, lambda x: NOT contains(code_a, x) AND NOT contains(replace(code_a, '-', ''), replace(x, '-', ''))), ',') AS kept FROM s""",
)
def j10(t: Tables) -> DataFrame:
    flat = codes.compact(F.col("code_a"))
    cut = lambda c, at, n: F.substr(c, F.lit(at), F.lit(n))
    shorts = F.array(
        "code_s", F.concat(cut(F.col("code_a"), 8, 9), F.lit("-"), cut(F.col("code_a"), 18, 4)), F.concat_ws("-", cut(flat, 3, 4), cut(flat, 7, 4), cut(flat, 11, 4))
    )
    return t.audit_base.select(F.col("event_id").alias("image_id"), joined(fuzzy.drop_contained(shorts, F.array("code_a"))).alias("kept"))


def readings(t: Tables) -> DataFrame:
    rows = F.posexplode(F.array("code_a", "code_b", F.when(F.col("event_id") % 2 == 0, F.col("code_a")).otherwise(F.col("code_b")), "code_a"))
    return t.audit_base.select(F.col("event_id").alias("image_id"), rows.alias("pos", "code"))


READ_SQL = "r AS (SELECT event_id AS image_id, unnest(x) AS code, generate_subscripts(x, 1) - 1 AS pos FROM (SELECT event_id, [code_a, code_b, CASE WHEN event_id % 2 = 0 THEN code_a ELSE code_b END, code_a] AS x FROM audit_base) AS s)"


@query("A17_voted_codes", f"WITH {READ_SQL} SELECT image_id, code, count(*) AS votes, min(pos) AS first_pos FROM r GROUP BY image_id, code HAVING count(*) >= 2")
def a17(t: Tables) -> DataFrame:
    return fuzzy.voted_codes(readings(t), 2)


@query(
    "A18_majority_prefix",
    f"""WITH {READ_SQL}, v AS (SELECT image_id, split_part(code, '-', 1) AS prefix, count(*) AS votes, min(pos) AS f FROM r GROUP BY ALL)
    SELECT image_id, prefix, votes FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY votes DESC, f) AS k FROM v) AS s WHERE k = 1 AND votes >= 2""",
)
def a18(t: Tables) -> DataFrame:
    return fuzzy.majority_prefix(readings(t).withColumn("prefix", F.split_part("code", F.lit("-"), F.lit(1))))


@query(
    "E10_recovered_prefixes",
    """SELECT event_id AS image_id, CASE WHEN event_id % 3 = 0 THEN concat(substr(code_a, 1, 6), substr(code_b, 7, 16)) ELSE '' END AS recovered FROM audit_base""",
)
def e10(t: Tables) -> DataFrame:
    damaged = F.concat(F.lit("noise S08"), F.substr("code_a", F.lit(4), F.lit(3)), F.substr("code_b", F.lit(7), F.lit(16)))
    lines = F.array(F.when(F.col("event_id") % 3 == 0, damaged).otherwise("nothing here"))
    existing = F.array("code_a", F.concat(F.left("code_a", F.lit(6)), F.lit("-2222-3333-44444")))
    return t.audit_base.select(F.col("event_id").alias("image_id"), joined(fuzzy.recover_prefix(lines, existing)).alias("recovered"))


@query(
    "F12_addresses",
    """SELECT chat_id, count(*) AS messages, count(address) AS with_address, count(DISTINCT address) AS addresses FROM (
    SELECT -(1000 + user_id % 5) AS chat_id, CASE WHEN event_id % 6 = 0 THEN concat('T', translate(substr(md5(CAST(user_id AS STRING)) || md5('x' || CAST(user_id AS STRING)), 1, 33), '0', '1')) END AS address FROM @events) AS s GROUP BY chat_id""",
)
def f12(t: Tables) -> DataFrame:
    rows = t.sql(
        """SELECT -(1000 + user_id % 5) AS chat_id, concat('pay to ', CASE WHEN event_id % 6 = 0 THEN concat('T', translate(substr(md5(CAST(user_id AS STRING)) || md5('x' || CAST(user_id AS STRING)), 1, 33), '0', '1')) ELSE 'TnotAnAddress' END, ' now') AS text FROM @events"""
    )
    found = rows.withColumn("address", people.address(F.col("text")))
    return found.groupBy("chat_id").agg(F.count("*").alias("messages"), F.count("address").alias("with_address"), F.countDistinct("address").alias("addresses"))


@query(
    "F13_identities",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN user_id WHEN 1 THEN -user_id WHEN 2 THEN user_id + 5 WHEN 3 THEN 0 END AS actor_id,
    CASE event_id % 5 WHEN 0 THEN CASE WHEN user_id % 2 = 0 THEN concat('@u', CAST(user_id AS STRING)) ELSE 'Ann Lee' END WHEN 1 THEN 'Channel' WHEN 2 THEN CAST(user_id + 5 AS STRING) WHEN 3 THEN 'Hidden' END AS label FROM @events""",
)
def f13(t: Tables) -> DataFrame:
    kind = F.col("event_id") % 5
    none = F.lit(None)
    user = lambda on, uid, name, first, last: F.when(on, F.struct(uid.alias("id"), name.alias("username"), first.alias("first_name"), last.alias("last_name")))
    rows = t.events.select(
        "event_id",
        user(kind == 0, F.col("user_id"), F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))), F.lit("Ann "), F.lit("Lee")).alias("from_user"),
        F.when(kind == 1, F.struct((-F.col("user_id")).alias("id"), F.lit("").alias("username"), F.lit("Channel").alias("title"))).alias("sender_chat"),
        user(kind == 2, F.col("user_id") + 5, none.cast("string"), none.cast("string"), none.cast("string")).alias("origin_user"),
        F.when(kind == 3, " Hidden ").alias("origin_name"),
    )
    actor = people.actor(F.col("from_user"), F.col("sender_chat"), F.col("origin_user"), F.col("origin_name"))
    return rows.select("event_id", actor.alias("a")).select("event_id", F.col("a.actor_id"), people.label(F.col("a")).alias("label"))


@query(
    "F14_hash_keys",
    """SELECT doc_id, concat('long_font_', substr(sha256(regexp_replace(upper(source || ' ' || lang), '\\s+', '', 'g')), 1, 12)) AS font_hash FROM @documents""",
)
def f14(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", people.font_hash(F.concat_ws(" ", "source", "lang"), F.lit("long")).alias("font_hash"))


@query(
    "F16_message_links",
    """SELECT event_id, CASE WHEN event_type = 'error' OR event_id = 0 THEN '' WHEN user_id % 3 = 0 THEN concat('https://t.me/', 'grp', CAST(user_id AS STRING), '/', CAST(event_id AS STRING))
    WHEN user_id % 3 = 1 THEN concat('https://t.me/c/', CAST(user_id AS STRING), '/', CAST(event_id AS STRING)) ELSE '' END AS link FROM @events""",
)
def f16(t: Tables) -> DataFrame:
    kind = F.col("user_id") % 3
    handle = F.when(kind == 0, F.concat(F.lit("@grp"), F.col("user_id").cast("string")))
    chat = F.when(kind == 1, F.concat(F.lit("-100"), F.col("user_id").cast("string"))).otherwise((-F.col("user_id")).cast("string"))
    chat_kind = F.when(F.col("event_type") == "error", "private").otherwise("supergroup")
    return t.events.select("event_id", people.message_link(chat_kind, handle, chat, F.col("event_id")).alias("link"))


@query("E15_one_type_per_image", """SELECT message_id, final_long, CASE WHEN final_long <> '' OR contains(raw_text, 'S07') THEN '' ELSE final_short END AS final_short FROM audit_record""")
def e15(t: Tables) -> DataFrame:
    from ledgerlens.functions.evidence import one_type

    rows = audit_rows(t, "audit_record")
    kept = one_type(F.col("final_long"), F.col("final_short"), codes.fold_text(F.col("raw_text")))
    return rows.select("message_id", joined(F.col("final_long")).alias("final_long"), joined(kept).alias("final_short"))
