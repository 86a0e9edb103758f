"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Within a source every document expects the same number of copies, target over source size. Prefix sums of these
expectations plus one random offset per source are cut at the integers: a document is emitted once for each integer
its stretch crosses. Documents are put in order of size class first, so that the copies of every class, and with them
the words taken, come near their share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.session import cut

#: Most copies of a document, and most a target may be of its source's size.
MAX_REPEAT = 3
#: Words as runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SIZE_CLASSES_PER_DOUBLING = 8


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _targets(sources: DataFrame, max_repeat: int) -> DataFrame:
    """Water-filling over one row per source: the level L solves sum(min(L * weight, cap)) = all words."""
    weight = (F.row_number().over(W.orderBy("key")) - 1) % 3 + 1
    rows = sources.withColumns({"weight": weight.cast("double"), "cap": (F.col("source_size") * max_repeat).cast("double")})
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), "key")
    before, after, every = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing), W.partitionBy()
    rows = rows.withColumns({
        "place": F.row_number().over(by_ratio),
        "capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "open": F.sum("weight").over(after),
        "total": F.sum("source_size").over(every).cast("double"),
    })
    rows = rows.withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
    # By ratio of cap to weight, the first source that its level does not fill sets the level for all.
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))
    rows = rows.withColumn("final", F.min(fits).over(every)["level"])
    return rows.select("key", "source_size", F.least(F.col("final") * F.col("weight"), F.col("cap")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42, max_repeat: int = MAX_REPEAT, whole: bool = False) -> DataFrame:
    """Per document: id, source, ``size`` in words, ``source_size``, ``target`` of its source, ``copies`` and ``taken`` words.

    With ``whole`` all columns of ``docs`` instead of id and source, but for those that bear one of the five names.

    Null and empty texts have size 0 and may be copied at no cost in words; a null source is a source of its own, last
    in order; a source without words has target 0 and no copies. Repeated rows count each. Empty tables give no rows.
    The sources' table has one row per source. Prefix sums run over size classes of a source, then over 256 hash
    blocks of a class, then inside a block, so a hot source or size is never one task.
    """
    made = ("size", "source_size", "target", "copies", "taken")
    others = [i for i, c in enumerate(docs.columns) if c.lower() not in made] if whole else []
    numbered = docs.toDF(*[f"__d{i}" for i in range(len(docs.columns))])
    own = lambda name: F.col(f"__d{docs.columns.index(name)}")
    sized = numbered.select(own(id_col).alias("doc_id"), own(source_col).alias("source"), n_words(own(text_col)).alias("size"), *[f"__d{i}" for i in others])
    sized = sized.withColumns({
        # Sorts by code point, null last.
        "key": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("t")),
        "class": F.floor(F.log2(F.col("size") + 1.0) * SIZE_CLASSES_PER_DOUBLING).cast("int"),
        "block": F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 2),
    })
    sized = cut(sized)
    order = W.partitionBy("key").orderBy("class").rowsBetween(W.unboundedPreceding, -1)
    classes = sized.groupBy("key", "class").agg(F.count(F.lit(1)).alias("n"))
    classes = classes.select("key", "class", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("class_before"))
    order = W.partitionBy("key", "class").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = sized.groupBy("key", "class", "block").agg(F.count(F.lit(1)).alias("n"))
    blocks = blocks.select("key", "class", "block", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("block_before"))
    sources = sized.groupBy("key").agg(F.sum("size").alias("source_size"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.col("key"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rates = _targets(sources, max_repeat).select("key", "source_size", "target", offset.alias("offset"), rate.alias("rate"))
    starts = blocks.join(classes.join(rates, "key"), ["key", "class"])
    rank = F.row_number().over(W.partitionBy("key", "class", "block").orderBy("size", "doc_id"))
    out = sized.withColumn("rank", rank).join(starts, ["key", "class", "block"])
    place = (F.col("class_before") + F.col("block_before") + F.col("rank")).cast("double")
    upto, before = F.floor(F.col("rate") * place + F.col("offset")), F.floor(F.col("rate") * (place - 1.0) + F.col("offset"))
    copies = (upto - before).cast("long")
    kept = [F.col(f"__d{i}").alias(docs.columns[i]) for i in others] if whole else ["doc_id", "source"]
    return out.select(*kept, "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix_sql() -> str:
    """The same question in DuckDB's SQL, over the table ``documents``."""
    return f"""
WITH sized AS (
  SELECT doc_id, coalesce('s' || source, 't') AS key,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
docs AS (
  SELECT *, CAST(floor(log2(size + 1.0::DOUBLE) * {SIZE_CLASSES_PER_DOUBLING}) AS INT) AS class,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 2) AS block FROM sized),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY class, block, size, doc_id NULLS FIRST) AS place FROM docs),
sources AS (
  SELECT key, CAST(sum(size) AS BIGINT) AS source_size, ((row_number() OVER (ORDER BY key) - 1) % 3 + 1)::DOUBLE AS weight,
         (sum(size) * {MAX_REPEAT})::DOUBLE AS cap FROM docs GROUP BY key),
steps AS (
  SELECT *, row_number() OVER o AS nth, coalesce(sum(cap) OVER (ORDER BY cap / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS capped,
         sum(weight) OVER (ORDER BY cap / weight, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
         CAST(sum(source_size) OVER () AS DOUBLE) AS total
  FROM sources WINDOW o AS (ORDER BY cap / weight, key)),
levels AS (SELECT *, (total - capped) / open AS level FROM steps),
rates AS (
  SELECT key, source_size, least((SELECT arg_min(level, nth) FROM levels WHERE level * weight <= cap) * weight, cap) AS target,
         ('0x' || substr(md5('42/' || key), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS off FROM levels),
sampled AS (
  SELECT doc_id, size, source_size, target, off, place, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate
  FROM ranked JOIN rates USING (key))
SELECT doc_id, size, source_size, target,
       CAST((floor(rate * place + off) - floor(rate * (place - 1) + off)) * size AS BIGINT) AS taken
FROM sampled"""
