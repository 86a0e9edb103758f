"""JSON payload readers as column expressions and row explosions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOOK = "data struct<sell: array<struct<price: string>>>"
RATE_PAYLOAD = "data array<struct<usdCny: string>>"
PRICE = "decimal(18,8)"
CODE = "struct<text: string, score: double>"
WORKER = (
    "texts array<struct<text: string, score: double, box: array<double>>>, "
    f"cards array<{CODE}>, "
    "ocr_original struct<texts: array<struct<text: string, score: double, box: array<double>>>, "
    f"cards: array<{CODE}>>, "
    "ocr_enhanced struct<texts: array<struct<text: string, score: double, box: array<double>>>, "
    f"cards: array<{CODE}>>, "
    "latency_ms long, cached boolean, enhanced_used boolean"
)


def price_levels(body: Column, limit: int = 5) -> Column:
    """First ``limit`` levels with a readable price, in book order; the fallback payload gives one level."""
    book = F.from_json(body, BOOK)
    priced = F.filter(book["data"]["sell"], lambda level: level["price"].try_cast(PRICE).isNotNull())
    levels = F.transform(F.slice(priced, 1, limit), lambda level: level["price"].try_cast(PRICE))
    fallback = F.from_json(body, RATE_PAYLOAD)["data"][0]["usdCny"].try_cast(PRICE)
    return F.when(F.size(levels) > 0, levels).when(fallback.isNotNull(), F.array(fallback)).otherwise(
        F.array().cast(f"array<{PRICE}>")
    )


def first_price(body: Column) -> Column:
    return F.get(price_levels(body), 0)


def scored_codes(cards: Column) -> Column:
    """Distinct codes of one reading in order, each with its best score."""
    given = F.filter(F.coalesce(cards, F.array().cast(f"array<{CODE}>")), lambda c: c["text"] != "")
    best = lambda code: F.array_max(F.transform(F.filter(given, lambda c: c["text"] == code), lambda c: c["score"]))
    return F.transform(F.array_distinct(F.transform(given, lambda c: c["text"])), lambda code: F.struct(code.alias("code"), best(code).alias("score")))


def worker_evidence(payloads: DataFrame) -> DataFrame:
    """One row per image, source and code with its position and best score."""
    parsed = payloads.withColumn("p", F.from_json("payload", WORKER))
    source = lambda name, cards: F.transform(
        F.coalesce(cards, F.array().cast(f"array<{CODE}>")),
        lambda card, at: F.struct(F.lit(name).alias("source"), at.cast("long").alias("pos"), card["text"].alias("code"), card["score"].alias("score")),
    )
    rows = F.concat(
        source("selected", F.col("p.cards")), source("original", F.col("p.ocr_original.cards")), source("enhanced", F.col("p.ocr_enhanced.cards"))
    )
    flat = parsed.select("image_id", F.explode(rows).alias("e")).select("image_id", "e.*").where(F.col("code") != "")
    return flat.groupBy("image_id", "source", "code").agg(F.min("pos").alias("pos"), F.max("score").alias("score"))
