"""Language identification by rank-order n-gram profiles and out-of-place distance.

Grams are 1 to 3 characters of a word between two blanks, packed into one integer of 21 bits a character.
"""

from __future__ import annotations

import sys
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.llm.common import may_learn, with_columns

#: Grams in a language's profile, and most frequent grams of a document compared with it.
PROFILE = 400
#: Bound of the training sample: expected documents for each language, taken by a hash of the id.
SAMPLE = 2000
#: Most languages that are learned, the ones with most rows: a bound of the labelled rows. Stray labels are no languages.
MAX_LANGUAGES = 2000
UNDETERMINED = "und"


@cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of a text's words (runs of letters, lower case), ascending, and their counts."""
    none = np.zeros(0, np.int64)
    if not text:
        return none, none
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    letter = _letters()[code]
    if not letter.any():
        return none, none
    code[~letter] = 32
    letter[1:] |= letter[:-1]  # a word and one blank after it
    code = np.concatenate(([32], code[letter], [32]))
    blank = code == 32
    if blank[-2]:
        code, blank = code[:-1], blank[:-1]
    pairs = (code[:-1] << 21) | code[1:]
    triples = ((pairs[:-1] << 21) | code[2:])[~blank[1:-1]]
    keys = np.sort(np.concatenate([code[~blank], pairs, triples]))
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.diff(np.append(first, len(keys)))


def most_frequent(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The PROFILE most frequent grams, by count, then by gram."""
    if len(keys) > PROFILE:
        enough = counts >= np.partition(counts, -PROFILE)[-PROFILE]
        keys, counts = keys[enough], counts[enough]
    return keys[np.lexsort((keys, -counts))[:PROFILE]]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> dict[str, list[int]]:
    """Profiles: for each language its PROFILE most frequent grams, ties by gram.

    Learned from rows with text and language whose id may be learned from, about ``sample`` of each of the MAX_LANGUAGES
    most frequent languages. Grams are
    counted in the tasks and summed by Spark; the driver gets PROFILE rows a language.
    """
    known = docs.where(may_learn(F.col(id_col))).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    if not sizes:
        return {}
    rate = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, sample / r["count"])))])
    picked = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < rate[F.col("lang")] * (1 << 20))

    def count(batches):
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for lang in sorted(set(langs)):
                found = [grams(t) for t, x in zip(texts, langs) if x == lang]
                keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
                total = np.bincount(at, weights=np.concatenate([n for _, n in found]), minlength=len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys, pa.int64()), pa.array(total, pa.int64())], names=["lang", "gram", "n"])

    counted = picked.select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    profiles: dict[str, list[int]] = {}
    for r in counted.withColumn("rank", rank).where(F.col("rank") <= PROFILE).orderBy("lang", "rank").toLocalIterator():
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


class Ranker:
    """Out-of-place distances of texts to the profiles."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.languages = sorted(profiles)
        self.grams = np.unique(np.array([g for x in self.languages for g in profiles[x]], np.int64))
        self.rank = np.full((len(self.grams), len(self.languages)), -1, np.int64)
        for i, x in enumerate(self.languages):
            self.rank[np.searchsorted(self.grams, np.array(profiles[x], np.int64)), i] = np.arange(len(profiles[x]))

    def __call__(self, text: str | None) -> tuple[str, float]:
        top = most_frequent(*grams(text))
        if not len(self.grams) or not len(top):
            return UNDETERMINED, 0.0
        at = np.minimum(np.searchsorted(self.grams, top), len(self.grams) - 1)
        known = np.flatnonzero(self.grams[at] == top)
        rank = self.rank[at[known]]
        far = np.where(rank < 0, PROFILE, np.abs(rank - known[:, None])).sum(axis=0) + PROFILE * (len(top) - len(known))
        best = int(far.argmin())
        return self.languages[best], 1.0 - float(far[best]) / (PROFILE * len(top))


def identify(docs: DataFrame, profiles: dict[str, list[int]], text_col: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (1 less the distance's share of the greatest possible one) to each row.

    ``und`` with score 0 if the text is null, empty or has no letter, or if nothing was learned. Of equal distances the
    first language by name wins. Other columns pass through; they must not bear the two names. Whole texts are ranked.
    """
    held = docs.sparkSession.sparkContext.broadcast(profiles)

    def scan(batches):
        rank = Ranker(held.value)
        for batch in batches:
            found = [rank(x) for x in batch.column(text_col).to_pylist()]
            yield with_columns(batch, (), lang_pred=pa.array([x[0] for x in found], pa.string()), score=pa.array([x[1] for x in found], pa.float64()))

    return docs.mapInArrow(scan, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
