"""Phrase collocations by SETM relational mining.

The occurrence relation is persisted in blocks of one language: the words of its pieces in order, with gaps between
pieces, so that adjacent positions of a piece are adjacent places. Round k merge-joins the relation of frequent
phrases of k - 1 words with itself at the next place, group-counts the phrases of k words over all blocks, semi-joins
the occurrences with the frequent groups and persists them for the next length. The semi-join reads the frequent
groups as a bitmap of bounded size: what it lets pass by chance is counted exactly and falls at the threshold.
Groups are counted in buckets of packed, sorted phrases, so that a shuffled row is many phrases.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import partitions, pick, raw, tuned
from ledgerlens.session import cut

MIN_COUNT, MAX_WORDS, LIMIT = 10, 3, 2000
#: A phrase goes if a longer candidate around it has so many percent of its occurrences.
ABSORBED = 50
#: Words of a block, words held over all languages of a task, words grouped at once, bytes of a long text split at once.
BLOCK_WORDS, HELD_WORDS, GROUP_WORDS, CHUNK = 1 << 17, 1 << 19, 1 << 18, 1 << 18
#: Words whose phrases share a bucket, and the most buckets.
BUCKET_WORDS, MOST_BUCKETS = 1 << 20, 1 << 20
#: Bits of the bitmap of frequent groups: 16 a group, at most 128 MB in all.
LEAST_BITS, MOST_BITS = 16, 30
BITMAP_ROW = 32768
UNKNOWN = "und"

#: A-Z become a-z, tab a blank, the piece separators the byte A, which no other byte becomes.
_GAP = b"A"
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 65 if 10 <= b <= 13 or b in b".,;:!?" else b for b in range(256))

_RELATION = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("codes", T.BinaryType()), T.StructField("places", T.BinaryType())])
_BLOCKS = T.StructType([
    T.StructField("lang", T.StringType()), T.StructField("vocab", T.ArrayType(T.StringType())), T.StructField("counts", T.ArrayType(T.LongType())), *_RELATION,
])
_PACKED = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("words", T.BinaryType()), T.StructField("counts", T.BinaryType())])


class _Codes(dict):
    """Words of a block to 1, 2, .. in order of appearance; the gap is 0."""

    def __init__(self):
        super().__init__({_GAP: 0})

    def __missing__(self, word):
        self[word] = code = len(self)
        return code


def _chunks(data: bytes):
    """A folded text cut at gaps, so that a very long one is not split into words at once."""
    start = 0
    while len(data) - start > CHUNK:
        end = data.rfind(_GAP, start, start + CHUNK)
        end = data.find(_GAP, start + CHUNK) if end <= start else end
        if end < 0:
            break
        yield data[start:end]
        start = end
    yield data[start:]


class _Block:
    def __init__(self):
        self.codes, self.parts, self.size = _Codes(), [], 0

    def add(self, data: bytes) -> None:
        words = data.replace(_GAP, b" A ").split()
        part = np.fromiter(map(self.codes.__getitem__, words), np.int32, len(words))
        self.parts += [part, np.zeros(1, np.int32)]
        self.size += len(part) + 1

    def row(self, lang: str, seed: int) -> dict | None:
        codes = _single_gaps(np.concatenate(self.parts))
        if not len(codes):
            return None
        words = list(self.codes)[1:]
        start = xxhash.xxh64_intdigest(lang.encode(), seed)
        ids = np.array([xxhash.xxh64_intdigest(w, start) for w in words], np.uint64)
        counts = np.bincount(codes, minlength=len(self.codes))[1:]
        return {"lang": lang, "vocab": [w.decode() for w in words], "counts": counts.tolist(), **_packed(ids.view(np.int64), codes, None)}


def _single_gaps(codes: np.ndarray) -> np.ndarray:
    """One gap between pieces, none at the end."""
    gap = codes == 0
    return codes[~(gap & np.append(gap[1:], True))]


def _packed(ids: np.ndarray, codes: np.ndarray, places: np.ndarray | None) -> dict:
    """A block as bytes: hashes of the vocabulary, codes in 2 or 4 bytes, places as bits (none: all words)."""
    bits = None
    if places is not None:
        marks = np.zeros(len(codes), bool)
        marks[places] = True
        bits = np.packbits(marks).tobytes()
    return {"ids": ids.tobytes(), "codes": codes.astype(np.uint16 if len(ids) < 1 << 16 else np.uint32).tobytes(), "places": bits}


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    ids = np.frombuffer(row["ids"], np.int64)
    codes = np.frombuffer(row["codes"], np.uint16 if len(ids) < 1 << 16 else np.uint32).astype(np.int32)
    bits = row["places"]
    return ids, codes, None if bits is None else np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=len(codes)))


def _batch(rows: list[dict], schema: T.StructType) -> pa.RecordBatch:
    kinds = {T.LongType(): pa.int64(), T.StringType(): pa.string(), T.BinaryType(): pa.binary()}
    kind = lambda t: pa.list_(kinds[t.elementType]) if isinstance(t, T.ArrayType) else kinds[t]
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], kind(f.dataType)) for f in schema], names=schema.names)


def occurrences(docs: DataFrame, seed: int, text_col: str = "text", lang_col: str = "lang", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Blocks of one language: ``vocab`` (words in order of appearance) with ``counts`` and ``ids`` (hashes of language
    and word), and ``codes``, the places of the vocabulary (from 1) of all words in order, 0 between pieces.
    """

    def scan(batches):
        held: dict[str, _Block] = {}

        def done(langs):
            rows = [row for lang in langs if (row := held.pop(lang).row(lang, seed))]
            return [_batch(rows, _BLOCKS)] if rows else []

        for batch in batches:
            for data, lang in zip(raw(batch.column(0)), batch.column(1).to_pylist()):
                if not data:
                    continue
                lang = UNKNOWN if lang is None else lang
                for part in _chunks(data.translate(_FOLD)):
                    block = held.setdefault(lang, _Block())
                    block.add(part)
                    if block.size >= block_words:
                        yield from done([lang])
                    elif sum(b.size for b in held.values()) >= HELD_WORDS:
                        yield from done(list(held))
        yield from done(list(held))

    return docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).mapInArrow(scan, _BLOCKS)


def _position(words: list, bits: int):
    """Bit of a phrase, from the 64-bit hashes of its words; Spark columns and numpy arrays alike."""
    mask = (1 << bits) - 1
    if isinstance(words[0], Column):
        shifted = [F.shiftrightunsigned(w, 5 * j % 32) for j, w in enumerate(words)]
        return reduce(lambda a, b: a.bitwiseXOR(b), shifted).bitwiseAND(F.lit(mask).cast("long"))
    shifted = [w.view(np.uint64) >> np.uint64(5 * j % 32) for j, w in enumerate(words)]
    return (reduce(np.bitwise_xor, shifted) & np.uint64(mask)).astype(np.int64)


def _columns(k: int) -> list[str]:
    return [f"w{j}" for j in range(k)]


class Bitmap:
    """Phrases of k words that may be frequent: all that are, and a few by chance."""

    def __init__(self, groups: DataFrame, k: int):
        self.bits = min(MOST_BITS, max(LEAST_BITS, (16 * groups.count()).bit_length()))
        place = _position([F.col(c) for c in _columns(k)], self.bits) + F.lit(1)
        rows = groups.groupBy(F.bitmap_bucket_number(place).alias("row")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
        self.data = np.zeros(max(1 << self.bits, BITMAP_ROW) // 8, np.uint8)
        for r in rows.toLocalIterator():
            at = (r["row"] - 1) * (BITMAP_ROW // 8)
            self.data[at : at + BITMAP_ROW // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)

    def holds(self, words: list[np.ndarray]) -> np.ndarray:
        place = _position(words, self.bits)
        return (self.data[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def _adjacent(places: np.ndarray, length: int) -> np.ndarray:
    """Merge join of a sorted relation with itself at the next place."""
    present = np.zeros(length + 1, bool)
    present[places] = True
    return places[present[places + 1]]


def _grouped(columns: list[np.ndarray], size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of columns with values under ``size``, and how often each comes."""
    if len(columns) == 1 or float(size) ** len(columns) < 2.0**62:
        key = reduce(lambda k, c: k * size + c, columns[1:], columns[0].astype(np.int64))
        key, n = np.unique(key, return_counts=True)
        out = []
        for _ in columns:
            key, rest = np.divmod(key, size)
            out.append(rest)
        return out[::-1], n
    order = np.lexsort(columns[::-1])
    ordered = [c[order] for c in columns]
    fresh = np.append(True, reduce(np.logical_or, [c[1:] != c[:-1] for c in ordered]))[: len(order)]
    starts = np.flatnonzero(fresh)
    return [c[starts] for c in ordered], np.diff(np.append(starts, len(order)))


def _candidates(row: dict, k: int, words: Bitmap) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, codes, and places where a phrase of k words may be frequent: k - 1 of its words are so at both ends."""
    ids, codes, places = _unpacked(row)
    if places is None:  # all words: infrequent ones become gaps
        keep = np.append(False, words.holds([ids]))
        codes = np.where(keep[codes], codes, 0)
        places = np.flatnonzero(codes)
    return ids, codes, _adjacent(places, len(codes))


def _rows(batches):
    """Rows of the relation; their bytes stay in the batch."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].as_buffer() for name in _RELATION.names}


def _counted(relation: DataFrame, k: int, words: Bitmap, buckets: int, min_count: int) -> DataFrame:
    """Phrases of k words with at least ``min_count`` occurrences: columns w0 .. and n.

    Phrases are summed over about GROUP_WORDS words, dealt to buckets by their hashes, and travel as one row a bucket;
    a bucket's rows are summed together. A phrase is at most one entry of each such row, however often it occurs.
    """
    held = relation.sparkSession.sparkContext.broadcast(words)
    schema = T.StructType([*[T.StructField(c, T.LongType()) for c in _columns(k)], T.StructField("n", T.LongType())])

    def flush(blocks):
        known, fresh = np.unique(np.concatenate([ids for ids, _, _ in blocks]), return_inverse=True)
        at, phrases = 0, [[] for _ in range(k)]
        for ids, codes, starts in blocks:
            recode = fresh[at : at + len(ids)]
            at += len(ids)
            for j in range(k):
                phrases[j].append(recode[codes[starts + j] - 1])
        found, n = _grouped([np.concatenate(p) for p in phrases], max(len(known), 1))
        found = [known[w] for w in found]
        bucket = _position(found, MOST_BITS) % buckets
        order = np.argsort(bucket, kind="stable")  # phrases stay sorted inside a bucket
        found, n, bucket = [w[order] for w in found], n[order], bucket[order]
        ends = np.append(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket))
        start, rows = 0, []
        for end in ends.tolist():
            if end > start:
                packed = np.concatenate([w[start:end] for w in found]).tobytes()
                rows.append({"bucket": int(bucket[start]), "words": packed, "counts": n[start:end].astype(np.int64).tobytes()})
            start = end
        return [_batch(rows, _PACKED)] if rows else []

    def scan(batches):
        blocks, size = [], 0
        for row in _rows(batches):
            ids, codes, starts = _candidates(row, k, held.value)
            if len(starts):
                blocks.append((ids, codes, starts))
                size += len(starts)
            if size >= GROUP_WORDS:
                yield from flush(blocks)
                blocks, size = [], 0
        if blocks:
            yield from flush(blocks)

    def summed(rows):
        counts = np.concatenate([np.frombuffer(c, np.int64) for _, c in rows])
        columns = [np.concatenate(x) for x in zip(*(np.frombuffer(w, np.int64).reshape(k, -1) for w, _ in rows))]
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
        starts = np.flatnonzero(np.append(True, reduce(np.logical_or, [c[1:] != c[:-1] for c in columns])))
        n = np.add.reduceat(counts[order], starts)
        keep = n >= min_count
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (*[c[starts] for c in columns], n)], names=schema.names)

    def merge(batches):
        last, rows = None, []
        for batch in batches:
            for i, bucket in enumerate(batch.column("bucket").to_pylist()):
                words, counts = (batch.column(name)[i].as_buffer() for name in ("words", "counts"))
                if bucket != last and rows:
                    yield summed(rows)
                    rows = []
                last = bucket
                rows.append((words, counts))
        if rows:
            yield summed(rows)

    packed = relation.select(*_RELATION.names).mapInArrow(scan, _PACKED)
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(merge, schema)


def _extended(relation: DataFrame, k: int, words: Bitmap, frequent: Bitmap) -> DataFrame:
    """The relation of frequent phrases of k words from that of k - 1; words outside of them become gaps."""
    held = relation.sparkSession.sparkContext.broadcast((words, frequent))

    def scan(batches):
        for row in _rows(batches):
            ids, codes, starts = _candidates(row, k, held.value[0])
            if len(starts):
                starts = starts[held.value[1].holds([ids[codes[starts + j] - 1] for j in range(k)])]
            if not len(starts):
                continue
            inside, marks = np.zeros(len(codes) + 1, bool), np.zeros(len(codes) + 1, np.int32)
            marks[starts] = 1
            for j in range(k):
                inside[starts + j] = True
            keep = inside[:-1] | np.append(False, inside[:-2])  # words of the phrases, and one gap behind a run of them
            codes = np.where(inside[:-1], codes, 0)[keep]
            places = np.flatnonzero(marks[:-1][keep])
            used, fresh = np.unique(codes, return_inverse=True)
            if used[0]:  # no gap at all
                used, fresh = np.append(0, used), fresh + 1
            yield _batch([_packed(ids[used[1:] - 1], fresh.astype(np.int32), places)], _RELATION)

    return relation.select(*_RELATION.names).mapInArrow(scan, _RELATION)


def _persisted(docs: DataFrame, text_col: str, lang_col: str, block_words: int) -> tuple[DataFrame, DataFrame]:
    """The occurrence relation, and its words with the hashes w0, which no two words of the corpus share."""
    spark = docs.sparkSession
    for salt in range(100):
        seed = spark.range(1).select(F.xxhash64(F.lit(salt)).alias("s")).first()["s"] & (1 << 64) - 1
        blocks = cut(occurrences(docs, seed, text_col, lang_col, block_words))
        vocabulary = blocks.select("lang", F.explode(F.arrays_zip("vocab", "counts")).alias("x"))
        words = vocabulary.groupBy("lang", F.col("x.vocab").alias("word")).agg(F.sum("x.counts").alias("n"))
        words = cut(words.withColumn("w0", F.xxhash64(F.lit(salt), "lang", "word")))
        if not words.groupBy("w0").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
            return blocks, words
    raise ValueError("no hash tells all words apart")


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS,
    limit: int = LIMIT, absorbed: int = ABSORBED, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Per language its first ``limit`` phrases: lang, rank, phrase, a, l, r, n, score.

    Phrases have 2 to ``max_words`` words within a piece and at least ``min_count`` (1 or more) occurrences. Null and
    empty texts have no words, a null language is ``und``, repeated rows count each, an empty table gives no rows.
    Other columns are not read, whatever their names. Per language, ``n`` counts all words. Ties of score and ``a`` go
    by the bytes of the phrase, so ranks are unique.
    """
    tuned(docs.sparkSession)
    relation, words = _persisted(pick(docs, *dict.fromkeys([text_col, lang_col])), text_col, lang_col, block_words)
    totals = cut(words.groupBy("lang").agg(F.sum("n").alias("total")))
    frequent = {1: cut(words.where(F.col("n") >= min_count))}
    size = totals.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n")).first()["n"]
    buckets = min(MOST_BUCKETS, max(8 * partitions(words), size // BUCKET_WORDS))
    known = Bitmap(frequent[1], 1)
    for k in range(2, max_words + 1):
        frequent[k] = cut(_counted(relation, k, known, buckets, min_count))
        if k < max_words:
            relation = cut(_extended(relation, k, known, Bitmap(frequent[k], k)))
    scored = [_scored(frequent, k, absorbed if k < max_words else None) for k in range(2, max_words + 1)]
    scored = reduce(DataFrame.unionByName, scored)
    best = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    top = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
    return top.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def _scored(frequent: dict[int, DataFrame], k: int, absorbed: int | None) -> DataFrame:
    """Frequent phrases of k words with their weakest cut, those that a longer phrase absorbs left out."""
    names = _columns(k)
    rows = frequent[k].withColumnRenamed("n", "a")
    if absorbed is not None:
        longer = frequent[k + 1]
        parts = [longer.select(*[F.col(f"w{j + shift}").alias(f"w{j}") for j in range(k)], "n") for shift in (0, 1)]
        most = parts[0].unionByName(parts[1]).groupBy(*names).agg(F.max("n").alias("longest"))
        rows = rows.join(most, names, "left").where(F.coalesce(F.col("longest"), F.lit(0)) * 100 < F.col("a") * absorbed)
    for j in range(k):  # words, their language, and the counts of single words
        own = ["lang"] if j == 0 else []
        one = frequent[1].select(*own, F.col("w0").alias(f"w{j}"), F.col("word").alias(f"s{j}"), F.col("n").alias(f"f{j}_{j + 1}"))
        rows = rows.join(one, f"w{j}")
    for size in range(2, k):
        for start in sorted({0, k - size}):
            own = [F.col(f"w{j}").alias(f"w{start + j}") for j in range(size)]
            part = frequent[size].select(*own, F.col("n").alias(f"f{start}_{start + size}"))
            rows = rows.join(part, [f"w{start + j}" for j in range(size)])
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    cuts = []
    for at in range(1, k):
        left, right = f"f0_{at}", f"f{at}_{k}"
        score = F.call_function("div", wide("a") * wide("a") * F.lit(1_000_000).cast("decimal(7,0)"), wide(left) * wide(right))
        cuts.append(F.struct(score.alias("score"), F.lit(at).alias("at"), F.col(left).alias("l"), F.col(right).alias("r")))
    weakest = F.array_min(F.array(*cuts))
    phrase = F.concat_ws(" ", *[f"s{j}" for j in range(k)])
    rows = rows.select("lang", "a", phrase.alias("phrase"), weakest.alias("c"))
    return rows.select("lang", "phrase", "a", "c.l", "c.r", "c.score")
