"""Ordered computations that survive a hot key.

A plain window over a chat puts the whole chat into one task. Here the order column (a unique
integer) is cut into blocks: rows are windowed inside (key, block), block totals are windowed per
key, and the carried total is joined back. A task sees at most ``block`` rows of one key plus one
row per block. Without keys the block totals are cut into blocks once more, so that the one task at
the top sees a row for each 65,536 blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16
HOT_ROWS = 1 << 22
_B, _START = "__block", Window.unboundedPreceding


@dataclass(frozen=True)
class Running:
    """One running value: ``how`` is sum, min, max or last (last non-null)."""

    out: str
    how: str
    value: Column
    inclusive: bool = True


def _local(spec: Running, column: Column, window) -> Column:
    if spec.how == "last":
        return F.last(column, ignorenulls=True).over(window)
    return getattr(F, spec.how)(column).over(window)


def _combine(spec: Running, local: Column, carried: Column) -> Column:
    if spec.how == "sum":
        return F.coalesce(local, F.lit(0)) + F.coalesce(carried, F.lit(0))
    if spec.how == "min":
        return F.least(local, carried)
    if spec.how == "max":
        return F.greatest(local, carried)
    return F.coalesce(local, carried)


def running(df: DataFrame, keys: list[str], order: str, specs: list[Running], block: int = BLOCK) -> DataFrame:
    """Add running values over ``keys`` in ``order``; exclusive specs stop before the row."""
    values = {f"__v{i}": spec.value for i, spec in enumerate(specs)}
    tagged = df.withColumns({_B: F.floor(F.col(order) / block), **values})
    totals = []
    for i, spec in enumerate(specs):
        value = F.col(f"__v{i}")
        if spec.how == "last":
            totals.append(F.max_by(value, F.when(value.isNotNull(), F.col(order))).alias(f"__t{i}"))
        else:
            totals.append(getattr(F, spec.how)(value).alias(f"__t{i}"))
    per_block = tagged.groupBy(*keys, _B).agg(*totals)
    carried = _carried(per_block, keys, specs)
    inside = Window.partitionBy(*keys, _B).orderBy(order)
    local = {
        f"__l{i}": _local(spec, F.col(f"__v{i}"), inside.rowsBetween(_START, 0 if spec.inclusive else -1))
        for i, spec in enumerate(specs)
    }
    joined = tagged.withColumns(local).join(carried, [*keys, _B], "left")
    out = {spec.out: _combine(spec, F.col(f"__l{i}"), F.col(f"__c{i}")) for i, spec in enumerate(specs)}
    return joined.select(*[F.col(c) for c in df.columns if c not in out], *[c.alias(n) for n, c in out.items()])


def _carried(per_block: DataFrame, keys: list[str], specs: list[Running]) -> DataFrame:
    """What each block gets from the blocks before it."""
    if keys:
        before = Window.partitionBy(*keys).orderBy(_B).rowsBetween(_START, -1)
        return per_block.select(*keys, _B, *[_local(spec, F.col(f"__t{i}"), before).alias(f"__c{i}") for i, spec in enumerate(specs)])
    tagged = per_block.withColumn("__top", F.floor(F.col(_B) / BLOCK))
    totals = []
    for i, spec in enumerate(specs):
        value = F.col(f"__t{i}")
        totals.append((F.max_by(value, F.when(value.isNotNull(), F.col(_B))) if spec.how == "last" else getattr(F, spec.how)(value)).alias(f"__u{i}"))
    before = Window.orderBy("__top").rowsBetween(_START, -1)
    tops = tagged.groupBy("__top").agg(*totals)
    tops = tops.select("__top", *[_local(spec, F.col(f"__u{i}"), before).alias(f"__d{i}") for i, spec in enumerate(specs)])
    inside = Window.partitionBy("__top").orderBy(_B).rowsBetween(_START, -1)
    own = tagged.select(_B, "__top", *[_local(spec, F.col(f"__t{i}"), inside).alias(f"__e{i}") for i, spec in enumerate(specs)])
    return own.join(tops, "__top").select(_B, *[_combine(spec, F.col(f"__e{i}"), F.col(f"__d{i}")).alias(f"__c{i}") for i, spec in enumerate(specs)])


def running_number(df: DataFrame, keys: list[str], order: str, out: str, block: int = BLOCK) -> DataFrame:
    """1-based position of each row inside its key."""
    return running(df, keys, order, [Running(out, "sum", F.lit(1).cast("long"))], block)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """First row per key. The rank filter is also applied before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def attach_stats(df: DataFrame, stats: DataFrame, keys: list[str], weight: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join per-key ``stats`` back to ``df``; keys with more than ``hot_rows`` rows are salted.

    At most rows / hot_rows hot keys exist; Spark broadcasts them if their size allows. Where a key is cut does not
    change the result.
    """
    hot = stats.where(F.col(weight) > hot_rows).select(
        *keys, F.ceil(F.col(weight) / hot_rows).cast("long").alias("__salts")
    )
    spread = F.pmod(F.xxhash64(*df.columns), F.col("__salts"))
    left = df.join(hot, keys, "left").withColumn("__salt", F.coalesce(spread, F.lit(0)).cast("long"))
    copies = F.sequence(F.lit(0), F.when(F.col(weight) > hot_rows, F.ceil(F.col(weight) / hot_rows) - 1).otherwise(0))
    right = stats.withColumn("__salt", F.explode(copies)).withColumn("__salt", F.col("__salt").cast("long"))
    return left.drop("__salts").join(right, [*keys, "__salt"], "left").drop("__salt")
