"""SimHash near-dedup: pivot distance tables discard pairs of fingerprints, survivors are verified.

Distinct fingerprints meet under keys of equal bit blocks: at most 3 of the BLOCKS bit blocks of a linked pair differ,
so some choice of BLOCKS - 3 blocks agrees. Inside a key a table of Hamming distances to many reference
fingerprints is made; a pair whose distances to one pivot differ by more than 3 cannot link (triangle inequality).
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import partitions, raw, with_columns
from ledgerlens.llm.components import components
from ledgerlens.session import cut

SHINGLE = 3
SEED = 42
MAX_BITS = 3
#: Bit blocks of the common keys, of which all but MAX_BITS agree: 10 keys of about 26 bits for 5 blocks, 20 of 32 for 6,
#: 35 of 37 for 7, 56 of 40 for 8. The least number is taken that leaves about PER_KEY random fingerprints a key or fewer.
BLOCKS, PER_KEY = (5, 6, 7, 8), 16
#: A key with more distinct fingerprints than this is searched by the fine keys: 560 keys of 52 bits, so at most 4,096
#: different fingerprints can ever meet under one. It is result-neutral; a pair is found either way.
CROWD, FINE_BLOCKS = 4096, 16
PIVOTS = np.random.default_rng(20240607).integers(0, 1 << 64, 16, dtype=np.uint64)


def fingerprint(data: bytes | None) -> int:
    """64 bits, each set if it is set in over half of the shingles' hashes; 0 without words."""
    text = data.lower().split() if data else []
    if not text:
        return 0
    if len(text) <= SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(text), SEED)
    line = b" ".join(text)
    ends = np.cumsum(np.fromiter(map(len, text), np.int64, len(text)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(line[a:b], SEED) for a, b in zip(starts[: -SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist())]
    ones = np.zeros(64, np.int64)
    every = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    for i in range(0, len(every), 1 << 16):
        ones += np.unpackbits(every[i : i + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Replace the text by ``fp``, the fingerprint as a signed long. Null and empty texts have fingerprint 0."""
    kept = [f for f in docs.schema.fields if f.name != text_col]

    def scan(batches):
        for batch in batches:
            values = np.array([fingerprint(x) for x in raw(batch.column(text_col))], np.uint64).view(np.int64)
            yield with_columns(batch, (text_col,), fp=pa.array(values, pa.int64()))

    return docs.mapInArrow(scan, T.StructType(kept + [T.StructField("fp", T.LongType())]))


def _masks(blocks: int) -> list[int]:
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    bits = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(x) for x in itertools.combinations(bits, blocks - MAX_BITS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keyed(fps: DataFrame, blocks: int) -> DataFrame:
    """One row for each fingerprint and choice of agreeing blocks. The key is the masked value with the choice."""
    masks = [_signed(m) for m in _masks(blocks)]
    choice = F.posexplode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("choice", "mask")
    return fps.select("fp", choice).select("choice", F.col("fp").bitwiseAND(F.col("mask")).alias("bits"), "fp")


def _groups_links(choice: np.ndarray, bits: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within equal (choice, bits); rows of a group stand together. One link joins two linked sets, not all pairs."""
    n = len(fp)
    if n < 2:
        return fp[:0], fp[:0]
    new = np.ones(n, bool)
    new[1:] = (choice[1:] != choice[:-1]) | (bits[1:] != bits[:-1])
    group = np.cumsum(new)
    size = np.bincount(group)[group]
    group, fp = group[size > 1], fp[size > 1]
    if not len(fp):
        return fp, fp
    far = np.bitwise_count(fp.view(np.uint64)[:, None] ^ PIVOTS[None, :]).astype(np.int16)  # the pivot table
    order = np.lexsort((far[:, 0], group))
    group, fp, far = group[order], fp[order], far[order]
    label, left, right = np.arange(len(fp)), [], []
    for step in range(1, len(fp)):
        near = np.flatnonzero((group[step:] == group[:-step]) & (far[step:, 0] - far[:-step, 0] <= MAX_BITS))
        if not len(near):
            break  # rows are sorted by the first pivot: further apart, the difference only grows
        near = near[label[near] != label[near + step]]
        near = near[np.abs(far[near] - far[near + step]).max(axis=1, initial=0) <= MAX_BITS]
        near = near[np.bitwise_count(fp[near].view(np.uint64) ^ fp[near + step].view(np.uint64)) <= MAX_BITS]
        for i in near.tolist():
            a, b = i, i + step
            while label[a] != a:
                a = label[a]
            while label[b] != b:
                b = label[b]
            if a != b:
                label[max(a, b)] = min(a, b)
                left.append(i)
                right.append(i + step)
        if len(near):
            while (label[label] != label).any():
                label = label[label]
    return fp[left], fp[right]


def _near_pairs(keyed: DataFrame) -> DataFrame:
    """Links among the fingerprints of each key. Rows stream through sorted by key; a task holds a batch and one key."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def scan(batches):
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                part = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
                held = part if held is None else [np.concatenate(x) for x in zip(held, part)]
                if len(held[0]) < 1 << 15:
                    continue
                same = (held[0] == held[0][-1]) & (held[1] == held[1][-1])
                upto = int(np.argmax(same))  # the last key may go on in the next batch
            elif held is None:
                break
            else:
                upto = len(held[0])
            done, held = [x[:upto] for x in held], [x[upto:] for x in held]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _groups_links(*done)], schema=schema)

    dealt = keyed.repartition(partitions(keyed), "choice", "bits").sortWithinPartitions("choice", "bits", "fp")
    return dealt.mapInArrow(scan, "a long, b long")


def blocks_for(n: int) -> int:
    """Bit blocks for ``n`` distinct fingerprints."""
    return next((b for b in BLOCKS if n <= PER_KEY << (64 * (b - MAX_BITS) // b)), BLOCKS[-1])


def links(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) whose components equal those of all pairs of ``fp`` with at most MAX_BITS differing bits."""
    fps = cut(fps.select("fp").distinct())
    keyed = _keyed(fps, blocks_for(fps.count()))
    crowded = cut(keyed.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).drop("n"))
    if crowded.isEmpty():
        return _near_pairs(keyed)
    common = _near_pairs(keyed.join(crowded, ["choice", "bits"], "left_anti"))
    dense = keyed.join(crowded, ["choice", "bits"], "left_semi").select("fp").distinct()
    return common.unionByName(_near_pairs(_keyed(dense, FINE_BLOCKS)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``fp``, ``text_key`` and ``group_fp`` (equal for linked rows) of the near-duplicate classes.

    Texts without words share fingerprint 0 and are linked. Repeated rows each get their row. An empty table gives an
    empty one. Fingerprints are made once and kept in the shared folder; only distinct ones are compared.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    rows = cut(fingerprints(rows))
    roots = cut(components(links(rows)).select(F.col("node").alias("fp"), "root"))
    return rows.join(roots, "fp", "left").select("doc_id", "text_key", "fp", F.coalesce("root", "fp").alias("group_fp"))


def components_of_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``fingerprint`` (hex) and ``component_id``, the least id of its class (null if all ids are null).

    The least ids are found among distinct fingerprints and written, so that the one join of all rows has plain tables
    on both sides and Spark can split a hot fingerprint.
    """
    rows = near_duplicates(docs, id_col, text_col)
    classes = cut(rows.groupBy("fp", "group_fp").agg(F.min("doc_id").alias("least")))
    roots = cut(classes.groupBy("group_fp").agg(F.min("least").alias("component_id")))
    named = cut(classes.join(roots, "group_fp").select("fp", "component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return rows.select("doc_id", "fp").join(named, "fp").select("doc_id", hexed, "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row with the least id (nulls last) of each class, whole. Of repeated rows one stays."""
    marked = docs.withColumn("__key", F.xxhash64(text_col))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "text_key")
    first = near_duplicates(docs, id_col, text_col).groupBy("group_fp").agg(F.min(order).alias("first"))
    first = first.select(F.when(~F.col("first.none"), F.col("first.id")).alias("__id"), F.col("first.text_key").alias("__first")).distinct()
    out = marked.join(first, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__first")), "left_semi")
    rank = F.row_number().over(W.partitionBy(id_col, "__key").orderBy(id_col))
    return out.withColumn("__rank", rank).where("__rank = 1").drop("__rank", "__key")
