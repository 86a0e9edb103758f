"""Ranked lexical search by dual trees.

Items and documents become vectors over the items' terms: an item holds the weights of its terms, a document the impact
of each term in it, and the score is their product. A node of either tree holds the coordinate maxima of all vectors
below it, so the product of two nodes bounds every score between them; where it is below the weakest kth score
of the node's items, the whole batch of documents is passed over. The search starts from kth scores over a hash sample
of the documents, which can only be too low, so nothing that ranks is ever lost.
"""

from __future__ import annotations

import math
from bisect import insort
from collections import Counter
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import folded_words, raw, shield, tuned
from ledgerlens.session import cut

TOP = 10
#: Text and number of the items searched in one pass; a larger benchmark takes several.
BLOCK_BYTES, BLOCK_ITEMS = 1 << 18, 512
#: Children of a node in the items' and in the documents' tree, and numbers in a matrix of documents by terms.
ITEM_FAN, DOC_FAN, MATRIX = 4, 8, 1 << 23
#: One in so many documents gives the first kth scores.
SEED_SHARE = 32
#: Fixed values of the score, in 64-bit integers: impact = SCALE * tf div (1000 * tf + 8 * m), m = 25 + 75 * n * N div L.
SCALE, SATURATION, LENGTH, LENGTH_SHARE, LENGTH_REST = 1_000_000_000, 1000, 8, 75, 25


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


@dataclass
class Node:
    """Items below, and the maxima of their coordinates as sorted terms and values."""

    members: np.ndarray
    terms: np.ndarray
    values: np.ndarray
    children: list[Node] = field(default_factory=list)


def item_order(items: list[Counter]) -> list[int]:
    """Items with the same common terms side by side, so that nodes are tight."""
    held = Counter(t for item in items for t in item)
    common = {t: i for i, (t, _) in enumerate(sorted(held.items(), key=lambda x: (-x[1], x[0])))}
    return sorted(range(len(items)), key=lambda i: (sorted(common[t] for t in items[i])[:8], i))


def item_tree(items: list[Counter], weights: np.ndarray) -> Node:
    """``items`` count term numbers; leaves are single items, in ``item_order``. Products stay exact: floats where all
    sums are below 2^53, else 64-bit integers."""
    most = max((sum(n * int(weights[t]) for t, n in item.items()) for item in items), default=0)
    kind = np.float64 if most * (SCALE // SATURATION) < 1 << 53 else np.int64
    level = []
    for i in item_order(items):
        terms = np.array(sorted(items[i]), np.int64)
        level.append(Node(np.array([i]), terms, np.array([items[i][t] * int(weights[t]) for t in terms], kind)))
    while len(level) > 1:
        level = [_parent(level[i : i + ITEM_FAN]) for i in range(0, len(level), ITEM_FAN)]
    return level[0]


def _parent(children: list[Node]) -> Node:
    if len(children) == 1:
        return children[0]
    terms = np.unique(np.concatenate([c.terms for c in children]))
    values = np.zeros(len(terms), children[0].values.dtype)
    for c in children:
        at = np.searchsorted(terms, c.terms)
        values[at] = np.maximum(values[at], c.values)
    return Node(np.concatenate([c.members for c in children]), terms, values, children)


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    m = LENGTH_REST + LENGTH_SHARE * n * n_docs // n_terms
    return SCALE * tf // (SATURATION * tf + LENGTH * m)


class Search:
    """The best documents of each item so far, over as many batches of documents as come."""

    def __init__(self, tree: Node, n_items: int, top: int, known: np.ndarray):
        self.tree, self.top = tree, top
        self.best: list[list] = [[] for _ in range(n_items)]  # (-score, id is null, id), best first
        self.limit = np.maximum(known, 1)
        self.pairs = 0

    def add(self, vectors: np.ndarray, ids: list) -> None:
        """Documents as rows of impacts. Their tree is made here: similar rows side by side, then maxima of DOC_FAN."""
        levels = [vectors]
        while len(levels[-1]) > DOC_FAN:
            below = levels[-1]
            starts = np.arange(0, len(below), DOC_FAN)
            levels.append(np.maximum.reduceat(below, starts, axis=0))
        self._visit(self.tree, levels, len(levels) - 1, np.arange(len(levels[-1])), ids)

    def _visit(self, node: Node, levels: list, depth: int, rows: np.ndarray, ids: list) -> None:
        bounds = levels[depth][rows[:, None], node.terms].astype(node.values.dtype) @ node.values
        self.pairs += len(rows)
        rows, bounds = (x[bounds >= self.limit[node.members].min()] for x in (rows, bounds))
        if not len(rows):
            return
        if depth == 0 and not node.children:  # a document and an item: the bound is the score
            self._keep(int(node.members[0]), rows, bounds, ids)
            return
        if depth:
            rows = rows[np.argsort(-bounds, kind="stable")]
            rows = (rows[:, None] * DOC_FAN + np.arange(DOC_FAN)).ravel()
            rows = rows[rows < len(levels[depth - 1])]
        for child in node.children or [node]:
            self._visit(child, levels, max(depth - 1, 0), rows, ids)

    def _keep(self, item: int, rows: np.ndarray, scores: np.ndarray, ids: list) -> None:
        best = self.best[item]
        for at in np.argsort(-scores, kind="stable"):
            score = int(scores[at])
            if score < self.limit[item]:
                break
            found = ids[rows[at]]
            entry = (-score, found is None, found)
            if len(best) == self.top:
                if entry >= best[-1]:
                    continue
                best.pop()
            insort(best, entry)
            if len(best) == self.top:
                self.limit[item] = max(self.limit[item], -best[-1][0])


def _vectors(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """Per document ``n`` (all its terms), and of the given terms its ``terms``, ascending, with their ``tfs``."""
    held = docs.sparkSession.sparkContext.broadcast(terms)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))])

    def scan(batches):
        find, size = held.value.get, max(len(held.value), 1)
        for batch in batches:
            lengths, found = [], []
            for i, data in enumerate(raw(batch.column("text"))):
                words = folded_words(data)
                codes = np.fromiter(map(find, words, repeat(-1)), np.int64, len(words))
                lengths.append(len(words))
                found.append(codes[codes >= 0] + i * size)
            key, tf = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
            row, term = np.divmod(key, size)
            offsets = pa.array(np.searchsorted(row, np.arange(len(lengths) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (term, tf)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths, pa.int64()), *lists], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(scan, schema)


def _searched(vectors: DataFrame, tree: Node, weights: np.ndarray, n_items: int, n_docs: int, n_terms: int, top: int, known: np.ndarray) -> DataFrame:
    """The best documents of each item in each task, none that ``known`` kth scores rule out."""
    held = vectors.sparkSession.sparkContext.broadcast((tree, weights, known))
    schema = T.StructType([T.StructField("item", T.IntegerType()), vectors.schema["doc_id"], T.StructField("score", T.LongType())])

    def scan(batches):
        tree, weights, known = held.value
        search = Search(tree, n_items, top, known)
        height = max(DOC_FAN, MATRIX // max(len(weights), 1))
        kind = None
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            ids = batch.column("doc_id").to_pylist()
            n = batch.column("n").to_numpy(zero_copy_only=False)
            lists = batch.column("terms")
            offsets, terms = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            tfs = batch.column("tfs").values.to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = np.diff(offsets)
            value = np.zeros(len(tfs), np.int64)
            span = slice(offsets[0], offsets[-1])
            value[span] = impacts(tfs[span], np.repeat(n, sizes), n_docs, n_terms)
            # Documents are put side by side by their heaviest term, one batch of Arrow at a time.
            filled = np.flatnonzero(sizes)
            heavy = value[span] * weights[terms[span]]
            row = np.repeat(np.arange(len(ids)), sizes)
            order = np.lexsort((-heavy, row))
            first = order[np.searchsorted(row, filled)]
            filled = filled[np.lexsort((-heavy[first], terms[span][first]))]
            for start in range(0, len(filled), height):
                own = filled[start : start + height]
                matrix = np.zeros((len(own), len(weights)), np.int32)
                at = np.concatenate([np.arange(offsets[i], offsets[i + 1]) for i in own])
                matrix[np.repeat(np.arange(len(own)), sizes[own]), terms[at]] = value[at]
                search.add(matrix, [ids[i] for i in own])
        rows = [(item, found, -score) for item, best in enumerate(search.best) for score, _, found in best]
        if rows:
            items, found, scores = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int32()), pa.array(found, kind), pa.array(scores, pa.int64())], names=schema.names)

    return vectors.mapInArrow(scan, schema)


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    top: int = TOP, block_bytes: int = BLOCK_BYTES, block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """Per item its ``top`` documents with a score above 0: item_id, rank, doc_id, score.

    Every row of ``items`` is an item and every row of ``docs`` a document, repeated ones too; equal scores go by
    ascending id, null last. Null and empty texts have no terms: such items get no rows, such documents none. Other
    columns are not read, whatever their names. Items are the stated query set and go to the tasks in blocks of at most
    about ``block_bytes`` of text and ``block_items`` rows, one pass over the documents each.
    """
    spark = tuned(docs.sparkSession)
    texts = shield(docs, *dict.fromkeys([id_col, text_col])).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    queries = shield(items, *dict.fromkeys([item_col, item_text_col])).select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("words"))
    queries = queries.where(F.octet_length("words") > 0)
    size = queries.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    blocks = max(1, -(-size["bytes"] // block_bytes), -(-size["rows"] // block_items))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)))
    out = None
    for block in range(blocks):
        rows = queries.where(F.col("block") == block).select("item_id", F.col("words").cast("binary").alias("words")).collect()
        rows = sorted(((r["item_id"], bytes(r["words"])) for r in rows), key=lambda r: (r[0] is None, str(r[0]), r[1]))
        counted = [(item, Counter(folded_words(words))) for item, words in rows]
        counted = [(item, words) for item, words in counted if words]
        if not counted and (block < blocks - 1 or out is not None):
            continue
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(counted)], T.StructType([T.StructField("item", T.IntegerType()), queries.schema["item_id"]]))
        best = _best_of(texts, [words for _, words in counted], top).join(F.broadcast(names), "item")
        best = best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", F.col("score").cast("long").alias("score"))
        out = best if out is None else out.unionByName(best)
    return out


def _best_of(texts: DataFrame, items: list[Counter], top: int) -> DataFrame:
    order = item_order(items)
    terms: dict[bytes, int] = {}
    for i in order:
        for word in items[i]:
            terms.setdefault(word, len(terms))
    vectors = cut(_vectors(texts, terms))
    total = vectors.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    n_docs, n_terms = total["docs"], max(total["terms"], 1)
    df = np.zeros(len(terms), np.int64)
    for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        df[r["term"]] = r["count"]
    weights = np.array([weight(int(x), n_docs) for x in df], np.int64)
    coded = [Counter({terms[w]: n for w, n in item.items()}) for item in items]
    none = np.zeros(len(items), np.int64)
    tree = item_tree(coded, weights) if items else Node(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    run = lambda rows, known: _searched(rows, tree, weights, max(len(items), 1), n_docs, n_terms, top, known)
    known = none if items else np.zeros(1, np.int64)
    sample = vectors.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(SEED_SHARE)) == 0)
    for r in _ranked(run(sample, known), top).where(F.col("rank") == top).select("item", "score").collect():
        known[r["item"]] = r["score"]
    return _ranked(run(vectors, known.copy()), top)
