"""Operators on words and fingerprints against brute force, with odd rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerlens.llm import decontaminate, licenses, mixing, simhash, substrings
from ledgerlens.llm.common import pick, shield, unshield
from ledgerlens.llm.components import components
from samples import ODD, random_texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def folded(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_shield_keeps_clashing_columns(spark):
    frame = spark.range(2).selectExpr("id AS doc_id", "'t' AS text", "1 AS TEXT2", "2 AS n_hit").toDF("doc_id", "text", "TEXT", "n_hit")
    assert pick(frame, "doc_id", "text").columns == ["doc_id", "text"]
    assert unshield(shield(frame, "text"), frame.columns, "text").columns == frame.columns
    with pytest.raises(ValueError):
        pick(frame, "none")


def test_decontamination_equals_brute_force(spark, docs):
    rng = random.Random(1)
    items = random_texts(rng, 12, 60, 3, 25) + [None, "", "one two", "short", "Straße 漢字"]
    texts = random_texts(rng, 60, 60) + ODD
    for i in range(30):
        own = (items[i % 12] or "").upper().split()
        texts[i] += " . " + ", ".join(own[rng.randint(0, 3) :]) + " tail"
    texts += ["a STRASSE one, two! short", "straße 漢字 one/two"]
    benchmark = spark.createDataFrame([*enumerate(items), (0, items[0]), (None, texts[0])], "item_id long, text string")
    expected = []
    for text in texts:
        words, hit, found = folded(text), set(), set()
        for item, body in enumerate(items):
            own = folded(body)
            size = min(10, len(own))
            windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if size else set()
            for i in range(len(words) - size + 1):
                if tuple(words[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    found.add(str(item))
        expected.append((len(words), len(hit), sorted(found)))
    for block_bytes in (decontaminate.BLOCK_BYTES, 300):  # one pass, and several
        rows = decontaminate.decontaminate(docs(texts), benchmark, block_bytes=block_bytes).orderBy("doc_id").collect()
        assert [(r["n_words"], r["n_hit"], r["item_ids"]) for r in rows] == expected
        assert all(sum(s["last"] - s["first"] + 1 for s in r["spans"]) == r["n_hit"] for r in rows)
    assert sum(x[1] > 0 for x in expected) > 20
    empty = decontaminate.decontaminate(docs(texts[:3]), benchmark.limit(0)).collect()
    assert [r["n_hit"] for r in empty] == [0, 0, 0]
    assert decontaminate.decontaminate(docs([]), benchmark).count() == 0


def kept_words(rows):
    first = {}
    for i, text in rows:
        words = BLANK.findall(text or "")
        for a in range(len(words) - 12):
            first.setdefault(tuple(words[a : a + 13]), []).append(np.inf if i is None else i)
    out = []
    for i, text in rows:
        words, gone = BLANK.findall(text or ""), set()
        for a in range(len(words) - 12):
            if min(first[tuple(words[a : a + 13])]) < (np.inf if i is None else i):
                gone |= set(range(a, a + 13))
        out.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("homes", [1, 5])
def test_substring_dedup_equals_brute_force(spark, docs, homes):
    rng = random.Random(2)
    texts = random_texts(rng, 80, 500, 0, 90)
    passage = " ".join(f"p{i}" for i in range(55))
    for i in range(0, 80, 3):
        at = rng.randint(0, len(texts[i]))
        texts[i] = texts[i][:at] + " " + passage + " " + texts[i][at:]
    texts += [texts[3], texts[3], passage, "the the " * 40, "the the " * 30, *ODD[:5], *ODD[6:], "x " * 3000, "x " * 2500]
    ids = [*range(len(texts) - 2), 5, None]
    got = substrings.remove_repeats(docs(texts, ids).repartition(homes)).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got), key=str) == kept_words(list(zip(ids, texts)))
    assert substrings.remove_repeats(docs([])).count() == 0
    assert substrings.remove_repeats(docs(["a b"])).first()["kept_text"] == "a b"


def test_hot_grams_do_not_change_the_result(docs):
    texts = [f"begin{i} " + "one very common line of text here now " * 3 + f"end{i} " * 15 for i in range(60)]
    keyed = docs(texts).select(F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("key"), "text")
    assert len(substrings._hot_grams(keyed))
    got = substrings.remove_repeats(docs(texts)).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got), key=str) == kept_words(list(enumerate(texts)))


def test_mixing_comes_near_targets(spark, docs):
    rng = random.Random(3)
    texts = random_texts(rng, 900, 50, 0, 80) + [None, "", "x " * 3000]
    frame = docs(texts)
    rows = mixing.mix(frame).collect()
    assert len(rows) == len(texts)
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert r["size"] == len(BLANK.findall(texts[r["doc_id"]] or "")) and 0 <= r["taken"] <= 3 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = (r["target"], r["source_size"])
    total = sum(sizes.values())
    caps = {s: 3 * n for s, n in sizes.items()}
    weights, want = {"a": 1, "b": 2, None: 3}, {}
    free, rest = dict(weights), float(total)
    while free:  # share, cap, share the excess
        level = rest / sum(free.values())
        over = [s for s in free if level * weights[s] > caps[s]]
        want |= {s: float(caps[s]) for s in over} if over else {s: level * w for s, w in free.items()}
        rest -= sum(caps[s] for s in over)
        free = {s: w for s, w in free.items() if s not in over} if over else {}
    for s in sizes:
        assert target[s] == (pytest.approx(want[s]), sizes[s])
        assert abs(taken[s] - want[s]) <= 0.02 * want[s] + 3000
    assert sorted(map(str, mixing.mix(frame.repartition(7)).collect())) == sorted(map(str, rows))
    assert mixing.mix(docs([])).count() == 0
    assert [tuple(r)[2:] for r in mixing.mix(docs([None, ""], [None, None])).collect()] == [(0, 0, 0.0, 0, 0)] * 2


def simhash_by_hand(text):
    words = BLANK.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(rows):
    rows = [(i, simhash_by_hand(t)) for i, t in rows]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (rows[a][1] ^ rows[b][1]).bit_count() <= 3:
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    least = {}
    for (i, _), x in zip(rows, label):
        least[x] = min((v for v in (least.get(x), i) if v is not None), default=None)
    return sorted(((i, f"{fp:016x}", least[x]) for (i, fp), x in zip(rows, label)), key=str)


@pytest.mark.parametrize("crowd", [simhash.CROWD, 2])
def test_simhash_components_equal_brute_force(spark, docs, crowd, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(simhash.links, "__defaults__", (crowd,))
    texts = random_texts(rng, 60, 300, 150, 200)
    for i in range(60):
        words = texts[i].split()
        for k in range(i % 4):
            words[(k * 41 + i) % len(words)] = f"new{i}{k}"
        texts.append(" ".join(words))
    texts += [texts[0], texts[0].upper(), *ODD]
    ids = [*range(len(texts) - 1), 7]
    got = simhash.components_of_documents(docs(texts, ids)).collect()
    want = components_by_hand(list(zip(ids, texts)))
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=str) == want
    assert len({x[2] for x in want}) < len(want) - 20
    assert simhash.components_of_documents(docs([])).count() == 0
    assert simhash.components_of_documents(docs(["a", "a"], [None, None])).collect()[0]["component_id"] is None


def test_one_of_each_keeps_whole_rows(docs):
    rows = docs(["same text here", "same text here", "other words entirely", "other words entirely", None], [4, 2, None, None, 9])
    kept = simhash.one_of_each(rows.withColumn("extra", F.lit(1))).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == [("2", "same text here"), ("9", None), ("None", "other words entirely")]
    assert all(r["extra"] == 1 for r in kept)


def test_links_of_random_bits(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.int64)
    fps = np.unique(np.concatenate([base] + [base ^ (np.int64(1) << rng.integers(0, 63, 40)) ^ (np.int64(1) << rng.integers(0, 63, 40)) for _ in range(20)]))
    links = simhash.links(spark.createDataFrame([(int(x),) for x in fps], "fp long"))
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    label = {int(x): int(x) for x in fps}
    changed = True
    while changed:
        changed = False
        for a in label:
            for b in label:
                if label[b] < label[a] and (a ^ b).bit_count() <= 3 and (a >= 0) == (b >= 0):
                    label[a], changed = label[b], True
    assert {x: roots.get(x, x) for x in label} == label


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000 + i, 1000) for i in range(100)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1000, 1100), 1000)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def contained(words, name):
    own = folded(licenses.TEMPLATES[name])
    want = {tuple(own[i : i + 5]) for i in range(len(own) - 4)}
    return len(want & {tuple(words[i : i + 5]) for i in range(len(words) - 4)}) / len(want)


def test_licenses_found_and_verified(spark, docs):
    rng = random.Random(6)
    names = sorted(licenses.TEMPLATES)
    texts = random_texts(rng, 40, 200, 50, 300)
    for i, name in enumerate(names * 2):
        body = licenses.TEMPLATES[name].split()
        if i >= len(names) and len(body) > 30:
            body[len(body) // 2] = "changed"
        texts[i] += "\n\n" + " ".join(body) + "\n" + texts[i + 1][:200]
    texts += [*ODD, "Licensed under the Apache"]
    rows = licenses.scan_licenses(docs(texts).select("doc_id", "text")).collect()
    found = {(r["doc_id"], r["license"]) for r in rows}
    for i, text in enumerate(texts):
        words = folded(text)
        for name in names:
            share = contained(words, name)
            assert share >= 0.8 - 1e-9 if (i, name) in found else share < 0.8
    assert all(r["containment"] >= 0.8 for r in rows)
    assert len(found) >= 2 * len(names)
    assert licenses.scan_licenses(docs([]).select("doc_id", "text")).count() == 0


def test_band_settings():
    for similarity in (0.3, 0.5, 0.8):
        for rows in (1, 2, 4):
            bands = licenses.bands_needed(similarity, rows)
            assert 1 - (1 - similarity**rows) ** bands >= licenses.RETRIEVAL


def test_digest_of_no_words():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_patterns_take_little_memory_and_steps_are_safe():
    """Every step of the search is at most the one to the next occurrence; tables take some bytes a word."""
    rng = random.Random(8)
    items = [(str(i), t.encode()) for i, t in enumerate(random_texts(rng, 60, 40, 1, 60))]
    items += [("twice", items[0][1]), ("0", items[0][1]), ("same", b"a a a a a a a a a a a a"), ("none", b" . ")]
    patterns = decontaminate.Matchers(items)
    assert [m.length for m in patterns.machines] == sorted({min(10, len(decontaminate.folded_words(t))) for _, t in items} - {0})
    for text in [t for _, t in items[::5]] + [b"x " * 9 + items[1][1] + b" y " + items[2][1], b"a " * 40]:
        words = decontaminate.folded_words(text)
        for machine in patterns.machines:
            m, want = machine.length, set()
            for name, body in items:
                own = decontaminate.folded_words(body)
                if own and min(10, len(own)) == m:
                    windows = {tuple(own[i : i + m]) for i in range(len(own) - m + 1)}
                    want |= {(i + m, name) for i in range(len(words) - m + 1) if tuple(words[i : i + m]) in windows}
            assert set(machine.search(patterns.ids(words))) == want
    import pickle

    large = [(str(i), t.encode()) for i, t in enumerate(random_texts(rng, 2000, 5000, 90, 110))]
    n_words = sum(len(t.split()) for _, t in large)
    patterns = decontaminate.Matchers(large)
    assert len(pickle.dumps(patterns)) < 40 * n_words


def test_blocks_follow_the_number_of_fingerprints(spark, monkeypatch):
    assert [simhash.blocks_for(n) for n in (0, 10**6, 10**9, 10**11, 10**13, 10**15)] == [5, 5, 6, 7, 8, 8]
    rng = random.Random(6)
    fps = [rng.getrandbits(64) for _ in range(150)]
    for i in range(60):
        fps.append(fps[rng.randrange(len(fps))] ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    signed = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    near = {frozenset((a, b)) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    root = {f: f for f in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in map(sorted, near):
        root[find(a)] = find(b)
    want = {f: find(f) for f in signed}
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    for blocks in (6, 8):
        monkeypatch.setattr(simhash, "BLOCKS", (blocks,))
        got = {r["node"]: r["root"] for r in components(simhash.links(frame)).collect()}
        groups = lambda roots: {frozenset(f for f in signed if roots.get(f, f) == r) for r in set(roots.values())}
        assert groups({f: got.get(f, f) for f in signed}) == groups(want)
    assert len(near) > 30
