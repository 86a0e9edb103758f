"""Benchmark decontamination: Wu-Manber search for all windows of the benchmark items.

Block shift tables (two words a block) skip positions where no window can end, suffix-hash buckets select the windows
to test, and a direct comparison confirms each occurrence. Words are numbers and all tables are flat arrays, some 30
bytes a word of the benchmark.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections import defaultdict
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import folded_words, raw, shield, with_columns

WINDOW = 10
#: Benchmark text in one pattern block; a larger benchmark is searched in several passes.
BLOCK_BYTES = 16 << 20
#: Words of a window's end that its bucket is chosen by.
SUFFIX = 4
_MIX, _WORD = 0x9E3779B97F4A7C15, (1 << 64) - 1


class _Table:
    """Values by 64-bit key: keys in order of their slot, the first of each slot in ``offsets``."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(1, int(len(keys)).bit_length())
        self.shift = 64 - bits
        slots = (keys.astype(np.uint64) * np.uint64(_MIX)) >> np.uint64(self.shift)
        order = np.argsort(slots, kind="stable")
        self.keys, self.values = array("q", keys[order].tobytes()), array("i", values[order].astype(np.int32).tobytes())
        self.offsets = array("i", np.searchsorted(slots[order], np.arange((1 << bits) + 1)).astype(np.int32).tobytes())

    def slot(self, key: int) -> range:
        at = (key * _MIX & _WORD) >> self.shift
        return range(self.offsets[at], self.offsets[at + 1])


def _suffixes(ids: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words that end with each word; the same as ``_suffix``. The first ones mean nothing."""
    h = np.zeros(len(ids), np.uint64)
    for back in range(size - 1, -1, -1):
        h = (h ^ np.roll(ids, back).astype(np.uint64)) * np.uint64(_MIX)
    return (h >> np.uint64(1)).astype(np.int64)


def _suffix(ids: array) -> int:
    h = 0
    for x in ids:
        h = (h ^ x) * _MIX & _WORD
    return h >> 1


class WuManber:
    """The windows of ``length`` words of items of at least so many words; items are arrays of word numbers."""

    def __init__(self, length: int, names: list[str], items: list[np.ndarray], n_words: int):
        self.length, self.block, self.tail, self.n_words, self.names = length, min(2, length), min(SUFFIX, length), n_words, names
        self.skip = length - self.block + 1
        sizes = np.array([len(x) for x in items], np.int64)
        ids = np.concatenate([np.zeros(0, np.int64), *items])
        self.begins = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64).tolist()
        self.words = array("i", ids.astype(np.int32).tobytes())
        end = np.arange(len(ids)) - np.repeat(self.begins, sizes) + 1  # words of the item up to here
        # A block that ends a window allows no step; before the first window it allows one to that window's end.
        keys = np.roll(ids, 1) * n_words + ids if self.block == 2 else ids
        keys, steps = keys[end >= self.block], np.maximum(length - end, 0)[end >= self.block]
        order = np.lexsort((steps, keys))
        keys, steps = keys[order], steps[order]
        first = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
        self.steps = _Table(keys[first], steps[first])
        ends = np.flatnonzero(end >= length)
        self.buckets = _Table(_suffixes(ids, self.tail)[ends], ends - length + 1)

    def search(self, text: array):
        """Yield (end, item) for each occurrence of a window in an array of word numbers, -1 for others; ends ascending."""
        n, end, m, two, base = len(text), self.length, self.length, self.block == 2, self.n_words
        keys, values, slot, skip = self.steps.keys, self.steps.values, self.steps.slot, self.skip
        starts, selected, words = self.buckets.values, self.buckets.keys, self.words
        while end <= n:
            last = text[end - 1]
            before = text[end - 2] if two else 0
            if last < 0 or before < 0:
                end += skip
                continue
            key = before * base + last if two else last
            step = skip
            for i in slot(key):
                if keys[i] == key:
                    step = values[i]
                    break
            if step:
                end += step
                continue
            h = _suffix(text[end - self.tail : end])
            found = None
            for i in self.buckets.slot(h):
                if selected[i] == h:
                    start = starts[i]
                    found = text[end - m : end] if found is None else found
                    if words[start : start + m] == found:
                        yield end, self.names[bisect_right(self.begins, start) - 1]
            end += 1


class Matchers:
    """The numbers of the items' words, and a machine for each window length among the items."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int = WINDOW):
        self.numbers: dict[bytes, int] = {}
        by_length: dict[int, dict] = defaultdict(dict)
        for item, data in items:
            text = folded_words(data)
            if text:
                ids = np.fromiter((self.numbers.setdefault(w, len(self.numbers)) for w in text), np.int64, len(text))
                by_length[min(window, len(text))][item, ids.tobytes()] = ids  # repeated items count once
        self.machines = [WuManber(size, [x[0] for x in own], list(own.values()), max(len(self.numbers), 1)) for size, own in sorted(by_length.items())]

    def ids(self, text: list[bytes]) -> array:
        return array("i", map(self.numbers.get, text, repeat(-1)))


def _mark(text: list[bytes], patterns: Matchers, mask: bytes | None, items: list[str] | None):
    marks, found = bytearray(mask) if mask else None, set(items or ())
    ids = patterns.ids(text)
    for machine in patterns.machines:
        m = machine.length
        for end, item in machine.search(ids):
            if marks is None:
                marks = bytearray(len(text))
            marks[end - m : end] = b"\x01" * m
            found.add(item)
    return marks, found


def _spans(marks: bytearray) -> list[dict]:
    out, start = [], marks.find(1)
    while start >= 0:
        end = marks.find(0, start)
        end = len(marks) if end < 0 else end
        out.append({"first": start, "last": end - 1})
        start = marks.find(1, end)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Add ``n_words``, ``n_hit``, ``item_ids`` (sorted as strings) and ``spans`` (word ranges) to each document.

    Null and empty texts have no words: zero counts, empty lists. Repeated items count once, items with a null id are
    skipped, an empty benchmark hits nothing. Other columns of ``docs`` pass through; they must not bear the four names
    above. The benchmark is the stated query set: it goes to the tasks in blocks of at most ``block_bytes`` of text
    (or one item), one chained pass over the rows for each block, with no shuffle.
    """
    spark = docs.sparkSession
    queries = shield(benchmark, *({id_col, text_col})).select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("words")).where("item IS NOT NULL AND words IS NOT NULL")
    size = queries.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // block_bytes))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    out = docs.withColumns({"__mask": F.lit(None).cast("binary"), "__items": F.lit(None).cast("array<string>")})
    results = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("item_ids", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])))]
    for block in range(blocks):
        rows = queries.where(F.col("block") == block).select("item", F.col("words").cast("binary").alias("words")).toLocalIterator()
        patterns = spark.sparkContext.broadcast(Matchers([(r["item"], bytes(r["words"])) for r in rows], window))
        last = block == blocks - 1

        def scan(batches, patterns=patterns, last=last, text_col=text_col):
            for batch in batches:
                masks, items, counts, hits, spans = [], [], [], [], []
                columns = (raw(batch.column(text_col)), batch.column("__mask").to_pylist(), batch.column("__items").to_pylist())
                for data, mask, held in zip(*columns):
                    text = folded_words(data)
                    marks, found = _mark(text, patterns.value, mask, held)
                    items.append(sorted(found))
                    if last:
                        counts.append(len(text))
                        hits.append(marks.count(1) if marks else 0)
                        spans.append(_spans(marks) if marks else [])
                    else:
                        masks.append(bytes(marks) if marks else None)
                if last:
                    pair = pa.struct([("first", pa.int32()), ("last", pa.int32())])
                    yield with_columns(batch, ("__mask", "__items"), n_words=pa.array(counts, pa.int64()), n_hit=pa.array(hits, pa.int64()), item_ids=pa.array(items, pa.list_(pa.string())), spans=pa.array(spans, pa.list_(pair)))
                else:
                    yield with_columns(batch, ("__mask", "__items"), __mask=pa.array(masks, pa.binary()), __items=pa.array(items, pa.list_(pa.string())))

        kept = [f for f in out.schema.fields if f.name not in ("__mask", "__items")]
        state = [out.schema["__mask"], out.schema["__items"]]
        out = out.mapInArrow(scan, T.StructType(kept + (results if last else state)))
    return out
