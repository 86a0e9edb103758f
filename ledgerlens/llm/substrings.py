"""Substring dedup by super-k-mer partitioning.

A window is K consecutive words. Its minimiser is the least of its M-word grams in a fixed order; consecutive windows
with one minimiser travel as one packed string of words (a super-k-mer) to the bucket of that minimiser, where the
windows of all strings are sorted and those that meet are compared word by word.

Texts are taken in homes, stretches of about HOME_BYTES of one task. A home sends each distinct string once, with the
least id it has there, so that a passage shared by a third of all documents is one string a home, not one a document;
the bucket answers to the home, again once a string. What a home remembers travels beside the strings. Grams that
fill more than HOT_SHARE of the corpus come last in the order, so that a common line does not gather the windows
around it in one bucket. Neither choice changes the result.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import partitions, raw, with_columns
from ledgerlens.session import cut

K, M = 13, 3
HOME_BYTES = 8 << 20
BUCKETS_PER_PARTITION = 8
#: A gram is hot if it makes more than this share of all grams; at most 1 / share grams are.
HOT_SHARE = 2.0**-16
NO_ID = np.iinfo(np.int64).max
HOT_BIT = np.uint64(1 << 63)
PACKED = "kind int, bucket long, home long, blob binary"


def _grams(words: list[bytes]) -> np.ndarray:
    """Hash (63 bits) of each M-word gram, by its start. Grams that collide share a bucket, nothing else."""
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    n = len(h) - M + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(M):
        out = (out ^ h[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out >> np.uint64(1)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (width - span)], values[width - span :]) if width > span else values


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each size, one after the other."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    return np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(int(sizes.sum()))


def _pack(*arrays) -> bytes:
    parts = [x if isinstance(x, bytes) else np.ascontiguousarray(x, np.int64).tobytes() for x in arrays]
    body = struct.pack(f"<{len(parts) + 1}q", len(parts), *map(len, parts)) + b"".join(parts)
    return zstandard.ZstdCompressor(level=3).compress(body)


def _unpack(blob: bytes, text: int = -1) -> list:
    body = zstandard.ZstdDecompressor().decompress(blob)
    n = struct.unpack_from("<q", body)[0]
    sizes = struct.unpack_from(f"<{n}q", body, 8)
    out, at = [], 8 * (n + 1)
    for i, size in enumerate(sizes):
        out.append(body[at : at + size] if i == text else np.frombuffer(body, np.int64, size // 8, at))
        at += size
    return out


def _homes(batches):
    """(number in the task, ids, keys, texts) of each home; ids that are null sort last."""
    number, ids, keys, texts, size = 0, [], [], [], 0
    for batch in batches:
        for one, key, data in zip(batch.column("id").to_pylist(), batch.column("key").to_pylist(), raw(batch.column("text"))):
            ids.append(NO_ID if one is None else one)
            keys.append(key)
            texts.append(data or b"")
            size += len(texts[-1])
            if size >= HOME_BYTES or len(ids) >= HOME_BYTES >> 6:
                yield number, ids, keys, texts
                number, ids, keys, texts, size = number + 1, [], [], [], 0
    if ids:
        yield number, ids, keys, texts


def _hot_grams(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of the grams above HOT_SHARE of all grams, counted over the whole corpus.

    A gram above a share of the whole is above it in some home, so homes report only those; the rest add nothing.
    """

    def scan(batches):
        for _, _, _, texts in _homes(batches):
            grams = _grams([w for t in texts for w in t.split()])
            values, counts = np.unique(grams, return_counts=True)
            often = counts >= max(2, len(grams) * HOT_SHARE)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(values[often].astype(np.int64), -1)), pa.array(np.append(counts[often], len(grams)))], names=["gram", "n"])

    counted = docs.select("id", "key", "text").mapInArrow(scan, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counted = cut(counted)
    total = counted.where("gram = -1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    hot = counted.where((F.col("gram") >= 0) & (F.col("n") > max(total * HOT_SHARE, 2))).select("gram")
    return np.sort(np.array([r["gram"] for r in hot.toLocalIterator()], np.int64).astype(np.uint64))


def _send(texts: list[bytes], ids: list[int], hot: np.ndarray, buckets: int):
    """The strings of one home by bucket, and what the home has to remember."""
    words, counts = [], []
    for t in texts:
        own = t.split()
        words += own
        counts.append(len(own))
    counts = np.array(counts, np.int64)
    bases = np.concatenate(([0], np.cumsum(counts)[:-1]))
    doc = np.repeat(np.arange(len(texts)), np.maximum(counts - K + 1, 0))
    starts = _ragged(bases, np.maximum(counts - K + 1, 0))  # of all windows, in order
    if not len(starts):
        return [], None
    grams = _grams(words)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, grams), len(hot) - 1)
        grams = np.where(hot[at] == grams, grams | HOT_BIT, grams)
    least = _sliding_min(grams, K - M + 1)[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(starts)))
    known: dict[bytes, int] = {}
    join = b" ".join
    sid = np.fromiter((known.setdefault(join(words[a : a + n]), len(known)) for a, n in zip(starts[first].tolist(), (sizes + K - 1).tolist())), np.int64, len(first))
    ids = np.array(ids, np.int64)
    mins = np.full(len(known), NO_ID)
    np.minimum.at(mins, sid, ids[doc[first]])
    length, bucket = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
    length[sid] = sizes
    bucket[sid] = ((least[first] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(20)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    cuts = np.append(np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(order))
    place = np.zeros(len(known), np.int64)
    strings, sent = list(known), []
    for a, b in zip(cuts[:-1], cuts[1:]):
        own = order[a:b]
        place[own] = np.arange(b - a)
        sent.append((int(bucket[own[0]]), _pack(mins[own], b"\n".join([strings[i] for i in own.tolist()]))))
    per_doc = np.bincount(doc[first], minlength=len(texts))
    return sent, (bucket, place, length, mins, sid, per_doc)


def _meet(homes: list[int], blobs: list[bytes]):
    """Of all strings of a bucket: for each home the windows that start in a smaller id than the home knows."""
    mins, home, local, words, counts = [], [], [], [], []
    for h, blob in zip(homes, blobs):
        own, text = _unpack(blob, text=1)
        mins.append(own)
        home.append(np.full(len(own), h))
        local.append(np.arange(len(own)))
        for line in text.split(b"\n"):
            line = line.split()
            counts.append(len(line))
            words += line
    mins, home, local, counts = np.concatenate(mins), np.concatenate(home), np.concatenate(local), np.array(counts, np.int64)
    seen: dict[bytes, int] = {}
    for w in words:
        if w not in seen:
            seen[w] = len(seen)
    code = np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
    del words, seen
    bases = np.concatenate(([0], np.cumsum(counts)[:-1]))
    string, offset = np.repeat(np.arange(len(counts)), counts - K + 1), _ragged(np.zeros(len(counts), np.int64), counts - K + 1)
    starts = bases[string] + offset
    h = np.zeros(len(code) - K + 1, np.uint64)
    for i in range(K):
        h = (h ^ code[i : i + len(h)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    h = h[starts]
    order = np.argsort(h, kind="stable")
    # Only windows whose hash repeats can meet; they are sorted exactly, by their words.
    h = h[order]
    twin = np.zeros(len(h), bool)
    twin[1:] = h[1:] == h[:-1]
    twin[:-1] |= twin[1:]
    order = order[twin]
    if not len(order):
        return
    table = np.stack([code[starts[order] + i] for i in range(K)])
    exact = np.lexsort(table[::-1])
    order, table = order[exact], table[:, exact]
    new = np.ones(len(order), bool)
    new[1:] = (table[:, 1:] != table[:, :-1]).any(axis=0)
    least = np.minimum.reduceat(mins[string[order]], np.flatnonzero(new))[np.cumsum(new) - 1]
    told = least < mins[string[order]]
    order, least = order[told], least[told]
    by_home = np.argsort(home[string[order]], kind="stable")
    order, least = order[by_home], least[by_home]
    at = home[string[order]]
    cuts = np.append(np.flatnonzero(np.diff(at, prepend=-1)), len(at))
    for a, b in zip(cuts[:-1], cuts[1:]):
        own = order[a:b]
        yield int(at[a]), _pack(local[string[own]], offset[own], least[a:b])


def _cover(home_blob: bytes, answers: list[tuple[int, bytes]]):
    """(id, key, covered word ranges) of each text of a home that loses words."""
    ids, keys, bucket, place, length, mins, sid, per_doc = _unpack(home_blob)
    base = np.concatenate(([0], np.cumsum(length)[:-1]))
    least = np.repeat(mins, length)
    order = np.argsort(bucket, kind="stable")  # by bucket, then by place
    first = dict(zip(*[x.tolist() for x in np.unique(bucket[order], return_index=True)]))
    for b, blob in answers:
        local, offset, told = _unpack(blob)
        at = base[order[first[b] + local]] + offset
        least[at] = np.minimum(least[at], told)
    doc = np.repeat(np.arange(len(ids)), per_doc)
    sizes = length[sid]
    gone = least[_ragged(base[sid], sizes)] < np.repeat(ids[doc], sizes)
    windows = np.bincount(doc, weights=sizes, minlength=len(ids)).astype(np.int64)
    ends = np.cumsum(windows)
    for d in np.unique(np.repeat(doc, sizes)[gone]).tolist():
        hit = np.flatnonzero(gone[ends[d] - windows[d] : ends[d]])
        new = np.flatnonzero(np.diff(hit, prepend=-K - 1) > K)
        last = np.append(hit[new[1:] - 1], hit[-1]) + K
        yield int(ids[d]), int(keys[d]), np.stack([hit[new], last], axis=1).ravel()


def _by_key(batches, *columns):
    """Rows of equal first column, which stand together: (value, lists of the other columns)."""
    now, rows = None, []
    for batch in batches:
        for value, *rest in zip(*[batch.column(c).to_pylist() for c in columns]):
            if value != now and rows:
                yield now, rows
                rows = []
            now = value
            rows.append(rest)
    if rows:
        yield now, rows


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """From (id, key, text) to (id, key, ranges): begin and end, in words, of what smaller ids have already.

    Rows that lose nothing have no row here; repeated rows give repeated rows.
    """
    buckets = BUCKETS_PER_PARTITION * partitions(docs)
    hot = docs.sparkSession.sparkContext.broadcast(_hot_grams(docs))
    schema = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("home", pa.int64()), ("blob", pa.binary())])

    def rows(found):
        columns = list(zip(*found)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def send(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId() << 32
        for number, ids, keys, texts in _homes(batches):
            home = task + number
            sent, memory = _send(texts, ids, hot.value, buckets)
            if memory:
                # The home's memory goes round the buckets and meets their answers afterwards.
                away = int(xxhash.xxh64_intdigest(struct.pack("<q", home)) % buckets)
                sent.append((-1 - away, _pack(np.array(ids, np.int64), np.array(keys, np.int64), *memory)))
                for i in range(0, len(sent), 256):
                    yield rows([(0 if b >= 0 else 1, b if b >= 0 else -1 - b, home, blob) for b, blob in sent[i : i + 256]])

    def meet(batches):
        for bucket, found in _by_key(batches, "bucket", "kind", "home", "blob"):
            strings = [x for x in found if x[0] == 0]
            yield rows([(1, -1, home, blob) for kind, home, blob in found if kind])
            if strings:
                yield rows([(2, bucket, home, blob) for home, blob in _meet([x[1] for x in strings], [x[2] for x in strings])])

    def cover(batches):
        for home, found in _by_key(batches, "home", "kind", "bucket", "blob"):
            memory = next(blob for kind, _, blob in found if kind == 1)
            out = list(_cover(memory, [(b, blob) for kind, b, blob in found if kind == 2]))
            ids = pa.array([None if x[0] == NO_ID else x[0] for x in out], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.list_(pa.int64()))], names=["id", "key", "ranges"])

    n = partitions(docs)
    packed = docs.select("id", "key", "text").mapInArrow(send, PACKED)
    packed = packed.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, PACKED)
    return packed.repartition(n, "home").sortWithinPartitions("home").mapInArrow(cover, "id long, key long, ranges array<long>")


#: Words as ``bytes.split`` finds them.
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def _cut_out(data: bytes, spans: list[int]) -> bytes:
    """The text without the words of the spans: each goes with the white space behind it, all else stays as it is."""
    places = [m.start() for m in WORDS.finditer(data)] + [len(data)]
    parts, at = [], 0
    for begin, end in zip(spans[::2], spans[1::2]):
        parts.append(data[at : places[begin]])
        at = places[end]
    return b"".join([*parts, data[at:]])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", as_written: bool = False) -> DataFrame:
    """Add ``n_words``, ``n_removed`` and ``kept_text`` (kept words joined by one space) to each row.

    With ``as_written`` the kept text is the text itself without the words that go, line breaks and all.

    A word goes if a window of K words covers it whose words also start in a row with a smaller id. Null ids count as
    larger than all others and equal ids never remove from each other. Null and empty texts have no words; rows of
    fewer than K words lose nothing; an empty table gives an empty one. Other columns pass through; they must not bear
    the three names above. Rows that lose words are joined back by id and a hash of the text.
    """
    keyed = docs.withColumn("__key", F.xxhash64(id_col, text_col))
    ranges = repeated_ranges(keyed.select(F.col(id_col).cast("long").alias("id"), F.col("__key").alias("key"), F.col(text_col).alias("text")))
    ranges = cut(ranges).groupBy("id", "key").agg(F.first("ranges").alias("__ranges"))
    joined = keyed.join(ranges, F.col(id_col).eqNullSafe(F.col("id")) & (F.col("__key") == F.col("key")), "left").drop("id", "key", "__key")
    kept = [f for f in joined.schema.fields if f.name != "__ranges"]

    def apply(batches):
        for batch in batches:
            counts, removed, texts = [], [], []
            for data, spans in zip(raw(batch.column(text_col)), batch.column("__ranges").to_pylist()):
                words = data.split() if data else []
                counts.append(len(words))
                if as_written:
                    removed.append(sum(spans[1::2]) - sum(spans[::2]) if spans else 0)
                    texts.append(_cut_out(data, spans) if spans else data or b"")
                    continue
                for begin, end in reversed(list(zip(spans[::2], spans[1::2])) if spans else []):
                    del words[begin:end]
                removed.append(counts[-1] - len(words))
                texts.append(b" ".join(words))
            yield with_columns(batch, ("__ranges",), n_words=pa.array(counts, pa.int64()), n_removed=pa.array(removed, pa.int64()), kept_text=pa.array(texts, pa.binary()).cast(pa.string()))

    out = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())]
    return joined.mapInArrow(apply, T.StructType(kept + out))
