"""The corpus queries and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import collocations, decontaminate, language, licenses, main_text, media, mixing, quality, ranked, rules, simhash, substrings, warc
from ledgerlens.llm.common import held_out, pick, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


@query("op1_warc_derivatives")
def op1(spark, folder):
    pages = pick(table(spark, folder, "pages"), "page_id", "url", "html")
    out = warc.derivatives(warc.responses(pages))
    return out.select(
        "page_id", "warc_type", "record_id", "refers_to", "target_uri", "source_block_digest", "source_payload_digest", "block_digest", "content_length",
        F.length("record").cast("long").alias("record_bytes"), F.sha2("record", 256).alias("record_sha256"), "error",
    )


@query("op2_boosted_quality")
def op2(spark, folder):
    scored = quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op3_wu_manber_decontamination", """
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
doc_words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w
  FROM documents),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
  FROM item_words, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM windows),
found AS (
  SELECT DISTINCT doc_id, i, size, item_id
  FROM (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS win
        FROM doc_words, sizes, unnest(range(1, len(w) - size + 2)) AS t(i)) JOIN windows USING (size, win)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n FROM found, unnest(range(i, i + size)) AS t(p) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hits.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)""")
def op3(spark, folder):
    out = decontaminate.decontaminate(pick(table(spark, folder, "documents"), "doc_id", "text"), table(spark, folder, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op4_super_kmer_dedup", """
WITH docs AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
wins AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win FROM docs, unnest(range(1, len(w) - 11)) AS t(i)),
firsts AS (SELECT win, min(doc_id) AS first_doc FROM wins GROUP BY win),
gone AS (SELECT DISTINCT doc_id, p FROM wins JOIN firsts USING (win), unnest(range(i, i + 13)) AS t(p) WHERE first_doc < doc_id),
places AS (SELECT doc_id, p, w[p] AS word FROM docs, unnest(range(1, len(w) + 1)) AS t(p)),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS body, count(*) AS n
  FROM places ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)""")
def op4(spark, folder):
    out = substrings.remove_repeats(pick(table(spark, folder, "documents"), "doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query("op5_media_columns")
def op5(spark, folder):
    out = media.media_columns(pick(table(spark, folder, "documents"), "doc_id", "text"), keep_media=False)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "duration", "keyframes")


@query("op6_systematic_mix", mixing.mix_sql())
def op6(spark, folder):
    out = mixing.mix(pick(table(spark, folder, "documents"), "doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


@query("op7_rank_order_language")
def op7(spark, folder):
    docs = pick(table(spark, folder, "documents"), "doc_id", "text", "lang")
    out = language.identify(docs.select("doc_id", "text"), language.train(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op8_minhash_licenses")
def op8(spark, folder):
    return licenses.scan_licenses(pick(table(spark, folder, "documents"), "doc_id", "text"))


@query("op9_main_text")
def op9(spark, folder):
    out = main_text.main_text(pick(table(spark, folder, "pages"), "page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query("op10_pivot_simhash")
def op10(spark, folder):
    return simhash.components_of_documents(pick(table(spark, folder, "documents"), "doc_id", "text"))


@query("op11_decision_list_rules")
def op11(spark, folder):
    out = rules.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


@query("op12_dual_tree_search", """
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS d, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, row_number() OVER () AS q, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
sizes AS (SELECT doc_id, d, CAST(len(w) AS BIGINT) AS n FROM docs WHERE len(w) > 0),
total AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sizes),
tfs AS (SELECT d, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT d, unnest(w) AS t FROM docs) GROUP BY d, t),
weights AS (
  SELECT t, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS weight
  FROM (SELECT t, CAST(count(*) AS BIGINT) AS df FROM tfs GROUP BY t), total),
wanted AS (SELECT q, t, count(*) AS times FROM (SELECT q, unnest(w) AS t FROM items) GROUP BY q, t),
scores AS (
  SELECT q, d, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM wanted JOIN weights USING (t) JOIN tfs USING (t) JOIN sizes USING (d), total GROUP BY q, d),
ranks AS (
  SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score
  FROM scores JOIN items USING (q) JOIN sizes USING (d) WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM ranks WHERE rank <= 10""")
def op12(spark, folder):
    return ranked.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op13_setm_collocations", """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, CAST(count(*) AS BIGINT) AS f
  FROM words, unnest([1, 2, 3]) AS s(k), unnest(range(1, len(w) - k + 2)) AS t(i) GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.w, c.place, x.f AS l, y.f AS r, (CAST(1000000 AS HUGEINT) * a * a) // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS place FROM candidates) AS c
  JOIN grams AS x ON x.lang = c.lang AND x.k = c.place AND x.phrase = array_to_string(c.w[1:c.place], ' ')
  JOIN grams AS y ON y.lang = c.lang AND y.k = c.k - c.place AND y.phrase = array_to_string(c.w[c.place + 1:], ' ')),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, k, phrase ORDER BY score, place) = 1),
longer AS (
  SELECT lang, array_to_string(w[s:s + 1], ' ') AS phrase, max(a) AS most
  FROM candidates, unnest([1, 2]) AS t(s) WHERE k = 3 GROUP BY ALL),
best AS (
  SELECT weakest.* FROM weakest LEFT JOIN longer ON weakest.k = 2 AND weakest.lang = longer.lang AND weakest.phrase = longer.phrase
  WHERE coalesce(most, 0) * 100 < a * 50),
ranks AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranks JOIN totals USING (lang) WHERE rank <= 2000""")
def op13(spark, folder):
    return collocations.collocations(table(spark, folder, "documents"))
