"""Statistics and decision lists against a direct reading, with odd rows."""

import random
import re
from collections import Counter

from ledgerlens.llm import rules
from ledgerlens.llm.common import may_learn, pick
from pyspark.sql import functions as F
from samples import ODD, random_texts

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(text):
    words = BLANK.findall(text or "")
    lines = [x for x in (text or "").split("\n") if BLANK.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often, inside = Counter(windows), set()
    for i, window in enumerate(windows):
        if often[window] > 1:
            inside |= set(range(i, i + 8))
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(inside)


def texts_with_repeats():
    rng = random.Random(3)
    texts = random_texts(rng, 40, 30, 0, 80) + ODD
    texts += ["a b c d e f g h " * 3, "x # y\n\nx # y\r\n x # y\nx # y", "one two three four five six seven eight\n" * 2, "a b c d e f g h i a b c d e f g h", "\n\n \n", "# \t#\x0c<>"]
    passage = " ".join(f"p{i}" for i in range(11))
    return texts + [f"{t or ''} {passage}\n{passage} end" for t in texts[:20]]


def test_statistics_by_hand(spark, docs):
    texts = texts_with_repeats()
    rows = rules.statistics(pick(docs(texts), "doc_id", "text")).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in rules.STATISTICS[:5]) for r in rows] == [by_hand(t) for t in texts]
    for r, text in zip(rows, texts):
        words = BLANK.findall(text or "")
        assert (r["n_distinct"], r["longest"]) == (len(set(words)), max(map(len, words), default=0))


def labelled(spark, n=900):
    """Text, symbol junk and list junk with labels, the last of which needs two conditions."""
    rng = random.Random(5)
    texts, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 7))) for _ in range(rng.randint(25, 60))]
        kind = i % 6
        if kind == 0:
            words = [w + "###" for w in words]
        if kind == 1:
            words = words[:22] + [f"fill{j % 9}" for j in range(63)]
            rng.shuffle(words)
        texts.append(" ".join(words))
        labels.append((i, int(kind > 1), 0))
    return texts, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_list_tells_held_out_junk(spark, docs):
    texts, labels = labelled(spark)
    out = rules.judge(docs(texts), labels).join(labels, "doc_id")
    held = out.where(~may_learn(F.col("doc_id"))).collect()
    assert len(held) > 100 and not any(r["base_failed"] for r in held)
    assert sum(r["kept"] == bool(r["quality"]) for r in held) >= 0.98 * len(held)
    assert {r["rule"] for r in held if not r["kept"]} >= {1, 2}


def test_rules_are_learned_alike_and_without_held_out_labels(spark, docs):
    texts, labels = labelled(spark, 300)
    stats = rules.statistics(pick(docs(texts), "doc_id", "text"))
    first = rules.learn(stats, labels)
    turned = labels.withColumn("quality", F.when(may_learn(F.col("doc_id")), F.col("quality")).otherwise(1 - F.col("quality")))
    assert first and first == rules.learn(stats, turned.orderBy(F.rand(1)))
    assert all(r.junk >= rules.LEAST_PRECISION * r.covered and len(r.conditions) <= rules.MAX_CONDITIONS for r in first)
    assert "symbols_a_word > " in " ".join(map(str, first))


def test_odd_tables_and_no_python(spark, docs):
    texts = texts_with_repeats()
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (None, 0, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    wild = docs(texts + texts[:3], [*range(len(texts)), 0, 1, None]).toDF("doc_id", "text", "n_words", "kept", "bins")
    for own in (labels, labels.limit(0)):
        out = rules.judge(wild, own)
        rows = out.collect()
        assert len(rows) == len(texts) + 3 and out.columns == ["doc_id", *rules.STATISTICS, "base_failed", "rule", "kept"]
        for r in rows:
            assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
            assert r["kept"] == (not r["base_failed"])
    assert rules.judge(wild.limit(0), labels).count() == 0
    plan = rules.statistics(pick(wild, "doc_id", "text"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_first_rule_wins(spark):
    a = rules.Rule((rules.Condition("words", False, 5.0),), 3, 3)
    b = rules.Rule((rules.Condition("words", False, 9.0), rules.Condition("dup_lines", True, 0.5)), 3, 3)
    assert str(b) == "words <= 9 and dup_lines > 0.5"
    rows = [[n, 0, 0, dup, 0, 4, 0, 0, 0, 0, 0] for n, dup in ((3, 0), (5, 3), (8, 3), (8, 2), (10, 3))]
    stats = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in rules.STATISTICS))
    assert [r[0] for r in stats.select(rules.verdict([a, b])).collect()] == [1, 1, 2, 0, 0]
    assert [r[0] for r in stats.select(rules.verdict([])).collect()] == [0] * 5
