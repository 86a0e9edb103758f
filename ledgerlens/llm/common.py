"""Helpers the corpus operators share: tables, column shielding, hold-out rule, Arrow batches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import configure

#: Rows of an Arrow batch. Texts can be long, so batches stay small; results never depend on it.
BATCH_ROWS = "512"


def tuned(spark: SparkSession) -> SparkSession:
    configure(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") != BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{folder}/{name}.parquet")


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def shield(df: DataFrame, *names: str) -> DataFrame:
    """Keep the named columns and rename all others by position, so that no extra column can clash."""
    for name in names:
        if name not in df.columns:
            raise ValueError(f"column {name} is missing")
    keep = {df.columns.index(name) for name in names}
    return df.toDF(*[c if i in keep else f"__c{i}" for i, c in enumerate(df.columns)])


def unshield(df: DataFrame, columns: list[str], *names: str) -> DataFrame:
    """Undo ``shield``: the given columns under their old names, all others dropped."""
    keep = {columns.index(name) for name in names}
    return df.select(*[F.col(c if i in keep else f"__c{i}").alias(c) for i, c in enumerate(columns)])


def pick(df: DataFrame, *names: str) -> DataFrame:
    return shield(df, *names).select(*names)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5, is 0. A null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def may_learn(doc_id: Column) -> Column:
    """Rows a model may learn from: the remainder is known and not 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def raw(column) -> list:
    """A string or binary Arrow column as bytes or None."""
    return column.cast(pa.binary()).to_pylist()


def with_columns(batch: pa.RecordBatch, drop: tuple[str, ...], **columns) -> pa.RecordBatch:
    """The batch without ``drop``, with further columns at its end."""
    kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n not in drop]
    return pa.RecordBatch.from_arrays([c for _, c in kept] + list(columns.values()), names=[n for n, _ in kept] + list(columns))


#: A-Z become a-z; digits, letters and bytes above 0x7F are word bytes, all else separates.
FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def folded_words(data: bytes | None) -> list[bytes]:
    return data.translate(FOLD).split() if data else []
