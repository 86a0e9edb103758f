"""Dual-tree search and collocations against brute force, with odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np

from ledgerlens.llm import collocations, ranked
from samples import ODD, random_texts

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


def folded(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def ranked_by_hand(docs, items, top=10):
    terms = [(i, Counter(TERM.findall(folded(t)))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in terms]
    n_docs, n_terms = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in items:
        found = []
        for (doc, own), n in zip(terms, sizes):
            score = 0
            for t, times in Counter(TERM.findall(folded(text))).items():
                tf = own.get(t, 0)
                if tf:
                    m = 100 - 75 + (75 * n * n_docs) // n_terms
                    score += times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                found.append((-score, doc is None, doc if doc is not None else 0))
        out += [(item, rank, None if null else doc, -score) for rank, (score, null, doc) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


def test_search_equals_brute_force(spark, docs, monkeypatch):
    rng = random.Random(11)
    texts = random_texts(rng, 250, 300, 0, 60) + ODD + ["tie tie, TIE"] * 25
    items = [*enumerate(random_texts(rng, 30, 300, 1, 25)), (5, "tie word Word"), (90, None), (91, ""), (92, "never seen"), (93, "tie"), (93, "Ünïcode 漢字 ½"), (None, "x tie")]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    ids[3] = None
    ids[7] = ids[8]
    benchmark = spark.createDataFrame(items, ITEMS)
    expected = ranked_by_hand(list(zip(ids, texts)), items)
    frame = docs(texts, ids).toDF("doc_id", "text", "score", "rank", "item_id")
    monkeypatch.setattr(ranked, "MATRIX", 1 << 12)  # several batches of documents a task
    for options in ({}, {"block_bytes": 600}, {"block_items": 7}):
        got = ranked.search(frame, benchmark, **options)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=str) == expected
    assert ranked.search(frame, benchmark.limit(0)).count() == 0
    assert ranked.search(frame.limit(0), benchmark).count() == 0
    assert ranked.search(frame.where("text = ''"), benchmark).count() == 0
    short = ranked.search(frame, benchmark, top=2)
    assert sorted(map(tuple, short.collect()), key=str) == [r for r in expected if r[1] <= 2]


def test_bounds_pass_over_batches_and_lose_nothing():
    rng = np.random.default_rng(2)
    n_terms, n_items, n_docs = 200, 24, 640
    weights = rng.integers(1, 5000, n_terms)
    group = np.repeat(np.arange(8), n_docs // 8)  # documents of eight subjects, as items
    vectors = np.zeros((n_docs, n_terms), np.int32)
    for i in range(n_docs):
        terms = rng.choice(np.arange(25) + 25 * group[i], 12, replace=False)
        vectors[i, terms] = rng.integers(1, 900_000, 12)
    items = [Counter({int(t): int(rng.integers(1, 3)) for t in rng.choice(np.arange(25) + 25 * (i % 8), 6, replace=False)}) for i in range(n_items)]
    tree = ranked.item_tree(items, weights)
    search = ranked.Search(tree, n_items, 5, np.zeros(n_items, np.int64))
    for start in range(0, n_docs, 160):
        search.add(vectors[start : start + 160], list(range(start, start + 160)))
    for i, item in enumerate(items):
        scores = sum(n * int(weights[t]) * vectors[:, t].astype(np.int64) for t, n in item.items())
        best = sorted((-int(s), False, d) for d, s in enumerate(scores) if s > 0)[:5]
        assert search.best[i] == best
    assert search.pairs < n_items * n_docs / 2


def test_large_weights_use_integers():
    tree = ranked.item_tree([Counter({0: 10**9})], np.array([20_000]))
    assert tree.values.dtype == np.int64
    assert ranked.item_tree([Counter({0: 3})], np.array([20_000])).values.dtype == np.float64


def phrases_by_hand(rows, min_count, max_words, limit, absorbed=50):
    counts, totals = {}, Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded(text)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for k in range(1, max_words + 1):
                for i in range(len(words) - k + 1):
                    key = (lang or "und", tuple(words[i : i + k]))
                    counts[key] = counts.get(key, 0) + 1
    found = {}
    candidates = {x: a for x, a in counts.items() if len(x[1]) > 1 and a >= min_count}
    inside = {}
    for (lang, words), a in candidates.items():
        for size in range(2, len(words)):
            for i in range(len(words) - size + 1):
                key = (lang, words[i : i + size])
                inside[key] = max(inside.get(key, 0), a)
    for (lang, words), a in candidates.items():
        if 100 * inside.get((lang, words), 0) >= absorbed * a:
            continue
        cuts = [(1000000 * a * a // (counts[lang, words[:k]] * counts[lang, words[k:]]), k, counts[lang, words[:k]], counts[lang, words[k:]]) for k in range(1, len(words))]
        score, _, left, right = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    out = []
    for lang, own in found.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(own)[:limit], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def spoken(rng):
    words = ["of", "the", "a", "Vier", "straße", "漢字", "#x", "y\x00z", "é", "long-word", "b", "c", "d"]
    texts = []
    for _ in range(120):
        picked = rng.choices(words, [9, 9, 6, 3, 3, 2, 2, 1, 2, 2, 3, 3, 3], k=rng.randint(0, 60))
        texts.append("".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ; "]) for w in picked))
    return texts + ["New York City is big. " * 15, "new york minute " * 3] + ODD


def test_collocations_equal_brute_force(spark, docs, monkeypatch):
    texts = spoken(random.Random(4))
    langs = ["en" if i % 3 else None if i % 2 else "und" for i in range(len(texts))]
    frame = spark.createDataFrame([(i, t, x, 1) for i, (t, x) in enumerate(zip(texts, langs))], "doc_id long, text string, lang string, n long")
    for min_count, max_words, limit, block in ((10, 3, 2000, 1 << 17), (3, 4, 40, 50), (2, 2, 2000, 200)):
        got = collocations.collocations(frame, min_count=min_count, max_words=max_words, limit=limit, block_words=block)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == phrases_by_hand(zip(langs, texts), min_count, max_words, limit)
    monkeypatch.setattr(collocations, "CHUNK", 40)
    monkeypatch.setattr(collocations, "HELD_WORDS", 60)
    got = collocations.collocations(frame.toDF("doc_id", "text", "lang", "score"))
    assert sorted(map(tuple, got.collect())) == phrases_by_hand(zip(langs, texts), 10, 3, 2000)
    assert collocations.collocations(frame.limit(0)).count() == 0
    assert collocations.collocations(frame.where("text IS NULL OR text = ''")).count() == 0


def test_shared_hashes_take_another_salt(spark, docs, monkeypatch):
    """Hashes of Spark and of the tasks are the same; where two words share one, all is read again with another salt."""
    frame = docs(["a b c a", "b ä 漢字 a", None])
    _, words = collocations._persisted(frame, "text", "lang", 100)
    assert {(r["lang"], r["word"]): r["n"] for r in words.collect()}["en", "a"] == 2
    ids = {}
    salts = []

    def occurrences(docs, seed, *rest, run=collocations.occurrences):
        salts.append(seed)
        blocks = run(docs, seed, *rest)
        for r in blocks.collect():
            ids[seed] = ids.get(seed, set()) | set(np.frombuffer(r["ids"], np.int64).tolist())
        return blocks

    monkeypatch.setattr(collocations, "occurrences", occurrences)
    real = collocations.F.xxhash64
    monkeypatch.setattr(collocations.F, "xxhash64", lambda *c: real(*c).bitwiseAND(1) if len(c) == 3 and len(salts) < 2 else real(*c))
    _, words = collocations._persisted(frame, "text", "lang", 100)
    assert len(salts) == 2 and {r["w0"] for r in words.collect()} == ids[salts[1]]


def test_groups_and_bitmap(spark):
    rng = np.random.default_rng(1)
    for size in (50, 1 << 40):
        columns = [rng.integers(0, 50, 3000) for _ in range(3)]
        words, n = collocations._grouped(columns, size)
        assert dict(zip(zip(*map(list, words)), n)) == Counter(zip(*map(list, columns)))
    pairs = rng.integers(-(2**63), 2**63 - 1, (4000, 2))
    groups = spark.createDataFrame([tuple(map(int, p)) for p in pairs[:2000]], "w0 long, w1 long")
    found = collocations.Bitmap(groups, 2).holds([pairs[:, 0], pairs[:, 1]])
    assert found[:2000].all() and found[2000:].mean() < 0.2
