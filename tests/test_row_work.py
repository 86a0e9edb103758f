"""Costly row work: even tasks, and shared values computed once."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import candidates, codes, evidence, extract
from ledgerlens.operators import images
from ledgerlens.session import shared_folder, spread
from ledgerlens.sources.views import Tables


def test_rows_of_one_row_group_are_dealt_evenly(spark):
    """A file's splits may all but one be empty; tasks of row work hold about as many rows each, and none is lost."""
    folder = f"{shared_folder(spark)}/test-group"
    spark.range(40_000).coalesce(1).write.mode("overwrite").parquet(folder)
    with_splits = spark.read.option("maxPartitionBytes", 1000).parquet(folder)
    dealt = spread(with_splits, 1000)
    sizes = [r["n"] for r in dealt.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 40_000 and dealt.distinct().count() == 40_000
    assert len(sizes) == 40 and max(sizes) <= 1300
    assert spread(spark.range(0)).count() == 0


def _plan(df):
    return df._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("body", [
    lambda x: evidence.settle(x), lambda x: evidence.apply_confirmed(F.array("b"), x), lambda x: evidence.apply_confirmed(x, F.array("b")),
])
def test_lists_of_codes_are_computed_once(spark, body):
    rows = spark.createDataFrame([("S07304-ABCD-EFGH-JKLMN,S07304-ABCD-EFGH-JKLMZ", "S07304-ABCD-EFGH-JKLMZ")], "a string, b string")
    assert _plan(rows.select(body(F.split("a", ",")).alias("x"))).count("split(a#") == 1


def test_candidates_squeeze_a_text_once(spark):
    rows = spark.createDataFrame([("5O7304-ABCD-EFGH-JKLMN",)], "a string")
    assert _plan(rows.select(candidates.selected(F.col("a")).alias("x"))).count("upper(a#") == 1


def test_mismatches_merges_and_nulls(spark):
    a, b, c = "S07304-ABCD-EFGH-JKLMN", "S07304-ABCD-EFGH-JKLMZ", "S07234-QRST-QRST-QRSTV"
    bad = "S07234-0RST-QRST-QRSTV"
    row = spark.createDataFrame([(a, b, c, bad, None)], "a string, b string, c string, bad string, none string").select(
        codes.hamming(F.col("a"), F.col("b")).alias("one"), codes.hamming(F.col("a"), F.col("none")).alias("null"), codes.hamming(F.lit("ab"), F.lit("abc")).alias("long"),
        codes.hamming_overlap(F.lit("ab"), F.lit("acd")).alias("overlap"),
        evidence.merge_near(F.array("a", "a"), F.array("b", "c", "a")).alias("near"), evidence.settle(F.array("a", "b", "c", "bad")).alias("settled"),
        evidence.settle(F.array("bad", "a")).alias("dropped"), evidence.apply_confirmed(F.array("a"), F.array("b", "c")).alias("done"),
        extract.noisy_long(F.lit(f"x|{a.replace('-', '|')}|")).alias("barred"), extract.noisy_long(F.lit(a[:16] + "\n" + a[17:20] + "\n" + a[20:])).alias("lines"),
    ).first()
    assert (row["one"], row["null"], row["long"], row["overlap"]) == (1, None, 3, 1)
    assert tuple(row["near"]) == ([a, c], 1) and tuple(row["settled"]) == ([a, c], 2) and tuple(row["dropped"]) == ([a], 1)
    assert tuple(row["done"]) == ([b, c], 2)
    assert row["barred"] == [a] and row["lines"] == [a]


def test_the_tables_for_row_work_are_spread(spark, tmp_path):
    spark.range(50_000).select(F.col("id").alias("event_id")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    assert Tables(spark, str(tmp_path)).wide.events.rdd.getNumPartitions() >= 4
    assert images.assemble(spark.createDataFrame([(1, ["text S07304-ABCD-EFGH-JKLMN tail"])], "image_id long, texts array<string>")).first()["codes"] == ["S07304-ABCD-EFGH-JKLMN"]
