"""Quality classifier: histogram gradient-boosted trees over statistics of a document.

Statistics are made once for all texts. The trees are fitted on a bounded sample of labelled rows, flattened into
arrays, and all rows of a batch walk a tree together, one level at a step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import may_learn, pick, raw, with_columns
from ledgerlens.session import cut

#: Bound of the training sample: expected labelled rows, taken by a hash of the id.
SAMPLE = 40_000
TREES, DEPTH, BINS, RATE, SMOOTH, LEAST_ROWS = 80, 4, 64, 0.15, 1.0, 10

_LOWER, _UPPER, _DIGIT = bytes(range(97, 123)), bytes(range(65, 91)), bytes(range(48, 58))
_SPACE, _HIGH = b" \t\n\r\x0b\x0c", bytes(range(128, 256))
_STOP, _LOUD, _TABLE = b".", b"!?", b"|\t;"
_PUNCTUATION = b",.;:!?'\"()-"
_SYMBOL = bytes(b for b in range(33, 127) if b not in _LOWER + _UPPER + _DIGIT + _PUNCTUATION)
_CLASSES = (_LOWER, _UPPER, _DIGIT, _SPACE, _HIGH, _STOP, _LOUD, _TABLE, _PUNCTUATION, _SYMBOL)
#: log sizes, class shares, word shape, repetition and lines, in the order of ``statistics``.
N_FEATURES = 3 + len(_CLASSES) + 10


def statistics(data: bytes | None) -> list[float]:
    """N_FEATURES numbers of a text; all 0 for null and empty texts."""
    if not data:
        return [0.0] * N_FEATURES
    size = len(data)
    shares = [(size - len(data.translate(None, c))) / size for c in _CLASSES]
    words = data.split()
    n = max(len(words), 1)
    distinct = len(set(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    pairs = len(set(zip(words, words[1:]))) / max(len(words) - 1, 1)
    lines = data.split(b"\n")
    filled = [x for x in lines if x.strip()]
    m = max(len(filled), 1)
    ended = sum(x.rstrip()[-1:] in (b".", b"!", b"?", b":", b'"') for x in filled)
    return [
        float(np.log1p(size)), float(np.log1p(len(words))), float(np.log1p(len(filled))), *shares,
        float(lengths.mean()) if len(words) else 0.0, float(lengths.std()) if len(words) else 0.0, float(lengths.max(initial=0)),
        distinct / n, pairs, len(set(filled)) / m, ended / m, size / m, n / m,
        shares[1] / max(shares[0] + shares[1], 1e-9),
    ]


@dataclass
class Trees:
    """All trees as flat arrays; a leaf points to itself. ``edges`` turn numbers into bins."""

    edges: list[np.ndarray]
    roots: np.ndarray
    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1).astype(np.int16)

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins, rows = self.bins(x), np.arange(len(x))
        total = np.full(len(x), self.base)
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                below = bins[rows, self.feature[node]] <= self.limit[node]
                node = np.where(below, self.left[node], self.right[node])
            total += self.value[node]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Logistic boosting; splits are chosen from histograms of gradients over at most BINS bins a feature."""
    if not len(x):
        x, y = np.zeros((0, N_FEATURES)), np.zeros(0)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    model = Trees(edges, *[np.zeros(0, np.int64)] * 5, np.zeros(0), 0.0, depth)
    mean = min(max((y.sum() + 1) / (len(y) + 2), 1e-4), 1 - 1e-4)
    model.base = float(np.log(mean / (1 - mean)))
    bins, margin = model.bins(x), np.full(len(x), model.base)
    nodes: list[list] = []
    roots = []
    for _ in range(trees if len(x) else 0):
        p = 1 / (1 + np.exp(-margin))
        slope, curve = p - y, p * (1 - p)
        roots.append(len(nodes))
        open_nodes = [(_new(nodes), np.arange(len(x)))]
        for level in range(depth + 1):
            following = []
            for node, rows in open_nodes:
                g, h = slope[rows].sum(), curve[rows].sum()
                nodes[node][4] = -RATE * g / (h + SMOOTH)
                split = _split(bins, rows, slope, curve, g, h) if level < depth else None
                if split is None:
                    margin[rows] += nodes[node][4]
                    continue
                feature, limit = split
                below = bins[rows, feature] <= limit
                left, right = _new(nodes), _new(nodes)
                nodes[node][:4] = feature, limit, left, right
                following += [(left, rows[below]), (right, rows[~below])]
            open_nodes = following
    if nodes:
        flat = np.array([n[:4] for n in nodes], np.int64)
        model.feature, model.limit, model.left, model.right = flat.T.copy()
        model.value = np.array([n[4] for n in nodes])
    model.roots = np.array(roots, np.int64)
    return model


def _new(nodes: list) -> int:
    at = len(nodes)
    nodes.append([0, 0, at, at, 0.0])
    return at


def _split(bins, rows, slope, curve, g, h):
    if len(rows) < 2 * LEAST_ROWS:
        return None
    own, features = bins[rows], bins.shape[1]
    cell = (own + np.arange(features) * BINS).ravel()
    sums = [np.bincount(cell, weights=np.repeat(v, features) if v is not None else None, minlength=features * BINS).reshape(features, BINS).cumsum(axis=1) for v in (slope[rows], curve[rows], None)]
    gl, hl, nl = sums
    gain = gl**2 / (hl + SMOOTH) + (g - gl) ** 2 / (h - hl + SMOOTH) - g**2 / (h + SMOOTH)
    gain = np.where((nl >= LEAST_ROWS) & (len(rows) - nl >= LEAST_ROWS), gain, -1.0)
    best = int(gain.argmax())
    return divmod(best, BINS) if gain.flat[best] > 1e-6 else None


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Replace the text by ``stats``, an array of N_FEATURES doubles."""
    kept = [f for f in docs.schema.fields if f.name != text_col]

    def scan(batches):
        for batch in batches:
            stats = pa.array([statistics(x) for x in raw(batch.column(text_col))], pa.list_(pa.float64()))
            yield with_columns(batch, (text_col,), stats=stats)

    return docs.mapInArrow(scan, T.StructType([*kept, T.StructField("stats", T.ArrayType(T.DoubleType()))]))


def train(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE) -> Trees:
    """Fit on about ``sample`` labelled rows whose id may be learned from; null labels and ids are left out."""
    known = pick(labels, id_col, label_col).where(may_learn(F.col(id_col)) & F.col(label_col).isNotNull())
    n = known.count()
    picked = known.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < min(1.0, sample / max(n, 1)) * (1 << 20))
    rows = stats.select(id_col, "stats").join(picked, id_col).select(id_col, label_col, "stats").toPandas()
    rows = rows.sort_values([id_col, label_col], kind="stable")
    x = np.array(rows["stats"].tolist(), np.float64).reshape(-1, N_FEATURES)
    return fit(x, (rows[label_col].to_numpy() >= 1).astype(np.float64))


def score(stats: DataFrame, model: Trees) -> DataFrame:
    """Replace ``stats`` by ``score``, the probability of label 1. Without trees it is the mean label."""
    held = stats.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in stats.schema.fields if f.name != "stats"]

    def scan(batches):
        for batch in batches:
            x = batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)
            yield with_columns(batch, ("stats",), score=pa.array(held.value.score(x), pa.float64()))

    return stats.mapInArrow(scan, T.StructType([*kept, T.StructField("score", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Per row of ``docs``: id and ``score``. Texts are read once; their statistics stay in the shared folder.

    Null and empty texts have statistics 0 and a score like any other; repeated rows get a row each; with no labels
    every score is one half; an empty table gives an empty one.
    """
    stats = cut(features(pick(docs, id_col, text_col), text_col))
    return score(stats, train(stats, labels, id_col, sample=sample))
