"""Daily statistics, learning and evaluation goldens, checked against brute force where order matters."""

import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import candidates
from ledgerlens.operators import evaluation, fuzzy, learning, stats


def _audit(spark, rows):
    day = datetime.date(2026, 7, 13)
    data = [(day, path, -1001, "G", user, name, msg, "", long, short) for path, user, name, msg, long, short in rows]
    return spark.createDataFrame(
        data, "dt date, record_path string, chat_id long, chat_title string, user_id long, username string, message_id long, file_unique_id string, final_long array<string>, final_short array<string>"
    )


def test_first_record_takes_the_credit(spark):
    a, d, s1, s2 = "S07336-AAAA-BBBB-CCCCC", "S07336-DDDD-EEEE-FFFFF", "AAAA-BBBB-CCCC", "DDDD-EEEE-FFFF"
    rows = _audit(spark, [("001", 10, "alice", 0, [a, a], []), ("002", 10, "alice", 0, [d], [s1]), ("003", 20, "bob", 0, [], [s2]), ("004", 20, "bob", 0, [a.lower()], [s1])])
    got = {r["username"]: (r["images"], r["long_codes"], r["short_codes"]) for r in stats.daily_counts(rows).collect()}
    assert got == {"alice": (2, 2, 1), "bob": (2, 0, 1)}


def test_filters_run_before_deduplication(spark):
    a = "S07336-AAAA-BBBB-CCCCC"
    rows = _audit(spark, [("001", 10, "alice", 5, [a], []), ("002", 20, "bob", 6, [a], []), ("003", 20, "bob", 6, [a], [])])
    skipped = spark.createDataFrame([(10,)], "user_id long")
    got = {r["username"]: (r["images"], r["long_codes"]) for r in stats.daily_counts(stats.exclude_users(rows, skipped)).collect()}
    assert got == {"bob": (1, 1)}


def test_near_duplicates_warn_for_one_character(spark):
    found = spark.createDataFrame([("s", "S07541-G3W8-THJ9-PM83Y"), ("s", "AAAA-BBBB-CCCC")], "source string, code string")
    old = spark.createDataFrame([("s", "s07541-g3w8-thj9-pm83x"), ("t", "S07541-G3W8-THJ9-PM83Z"), ("s", "AAAA-BBBB-CCCD")], "source string, code string")
    rows = fuzzy.near_duplicates(found, old).collect()
    assert [(r["code"], r["existing_code"], r["similarity"]) for r in rows] == [("S07541-G3W8-THJ9-PM83Y", "S07541-G3W8-THJ9-PM83X", Decimal("95.45"))]


def test_near_duplicates_of_few_and_of_crowded_halves(spark):
    """Many codes share their first or their last half; either route finds the pairs of a comparison of all."""
    import random

    rng = random.Random(5)
    head = ["S07541-G3W8", "S07541-G3W9", "S07999-AAAA"]
    tails = ["-THJ9-PM83" + c for c in "ABCDEF"] + ["-THJ" + c + "-PM83A" for c in "AB"] + ["-" + "".join(rng.choices("AB", k=4)) + "-" + "".join(rng.choices("AB", k=5)) for _ in range(30)]
    rows = [(rng.choice(["s", "t", None]), rng.choice(head) + rng.choice(tails)) for _ in range(400)]
    found, old = rows[:250], rows[200:]
    want = {(s, a, b) for s, a in found for z, b in old if s == z and sum(x != y for x, y in zip(a, b, strict=True)) == 1}
    frame = lambda x: spark.createDataFrame(x, "source string, code string")
    for half_codes in (1, 3, fuzzy.HALF_CODES):
        got = [(r["source"], r["code"], r["existing_code"]) for r in fuzzy.near_duplicates(frame(found), frame(old), half_codes=half_codes).collect()]
        assert len(got) == len(want) and set(got) == want
    one = frame(rows)
    assert fuzzy.near_duplicates(one, one).count() == len({(s, a, b) for s, a in rows for z, b in rows if s == z and sum(x != y for x, y in zip(a, b, strict=True)) == 1})
    apart = frame([("s", f"S07541-G3W{c}-THJ9-PM8{c}X") for c in "ABCD"])
    plan = fuzzy.near_duplicates(apart, apart)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate inline" in plan and "LeftAnti" in plan  # masks only where a half is crowded


def _brute_diff(predicted, truth):
    flat = lambda c: c.replace("-", "")
    apart = lambda a, b: sum(x != y for x, y in zip(flat(a), flat(b))) if len(flat(a)) == len(flat(b)) else 99
    shown, goals = list(dict.fromkeys(predicted)), list(dict.fromkeys(truth))
    out = {(t, t, "correct") for t in goals if t in shown}
    free = [p for p in shown if p not in goals]
    used = set()
    for t in [t for t in goals if t not in shown]:
        near = [(apart(t, p), i, p) for i, p in enumerate(free) if p not in used and 1 <= apart(t, p) <= 2]
        if near:
            _, _, p = min(near)
            used.add(p)
            out.add((t, p, "confused"))
        else:
            out.add((t, None, "missing"))
    return out | {(None, p, "false_positive") for p in free if p not in used}


@pytest.mark.parametrize("bucket_pairs", [1_000_000, 4])
def test_truth_diff_equals_serial_choice(spark, bucket_pairs):
    rng = random.Random(7)
    letters = "AB"
    make = lambda: "S07304-" + "".join(rng.choice(letters) for _ in range(3)) + "A-BBBB-CCC" + "".join(rng.choice(letters) for _ in range(2))
    rows, want = [], {}
    for batch in range(12):
        predicted, truth = [make() for _ in range(14)], [make() for _ in range(10)]
        rows += [(batch, i, p, "p") for i, p in enumerate(predicted)] + [(batch, i, t, "t") for i, t in enumerate(truth)]
        want[batch] = _brute_diff(predicted, truth)
    df = spark.createDataFrame(rows, "batch_id long, seq long, code string, side string")
    got = learning.diff_with_truth(df.where("side = 'p'").drop("side"), df.where("side = 't'").drop("side"), bucket_pairs).collect()
    for batch in want:
        assert {(r["truth"], r["predicted"], r["outcome"]) for r in got if r["batch_id"] == batch} == want[batch]


def test_learning_window_starts_at_the_nearest_first_code(spark):
    codes = ["S07304-AAAA-BBBB-CCCC2", "S07304-9M8Q-Y7UW-7822U", "S07304-XXXX-YYYY-ZZZZ2", "S07304-QQQQ-RRRR-SSSSS"]
    predicted = spark.createDataFrame([(1, i, c) for i, c in enumerate(codes)], "batch_id long, seq long, code string")
    truth = spark.createDataFrame([(1, 0, "S07304-9M8Q-Y7UW-78Z2U"), (1, 1, "S07304-XXXX-YYYY-ZZZZ2")], "batch_id long, seq long, code string")
    assert [r["code"] for r in learning.learning_window(predicted, truth).orderBy("idx").collect()] == codes[1:3]


def test_character_rules_name_the_position(spark):
    rows = [("font_a", 1, datetime.datetime(2026, 1, 1), "S07304-9M8Q-Y7UW-7822U", "S07304-9M8Q-Y7UW-78Z2U")]
    pairs = spark.createDataFrame(rows, "font_hash string, seq long, ts timestamp_ntz, predicted string, truth string")
    rules = {(r["kind"], r["key"]): r["n"] for r in learning.learned_rules(learning.character_events(pairs)).collect()}
    assert rules == {("pair", "2>Z"): 1, ("position", "19:2>Z"): 1}


def test_template_rules_skip_ambiguous_pairs(spark):
    best = spark.createDataFrame(
        [("f", "position", "19:2", "Z", 12, 1), ("f", "position", "7:9", "S", 12, 2), ("f", "position", "7:S", "Q", 12, 3), ("f", "pair", "?", "K", 3, 4)],
        "font_hash string, kind string, wrong_key string, correct string, n long, first_seq long",
    )
    df = spark.createDataFrame([("f", "S07304-9M8Q-Y7UW-7822U"), ("f", "S07304-9M8?-Y7UW-7822U")], "font_hash string, code string").join(learning.rule_book(best), "font_hash")
    got = {r[0]: (r[1], r[2]) for r in df.select(
        "code", learning.corrected_by_template(F.col("code"), F.col("places"), F.col("letters")), learning.corrected_by_font(F.col("code"), F.col("places"))
    ).collect()}
    assert got == {
        "S07304-9M8Q-Y7UW-7822U": ("S07304-QM8Q-Y7UW-7822U", "S07304-SM8Q-Y7UW-7822U"),
        "S07304-9M8?-Y7UW-7822U": ("S07304-QM8K-Y7UW-7822U", "S07304-9M8?-Y7UW-7822U"),
    }


def test_nearest_template(spark):
    fonts = spark.createDataFrame([("3f9ab2",), ("abcdef",)], "font_hash string")
    stored = spark.createDataFrame([("FONT_A", "3f9ab2", True), ("FONT_B", "4a8bc1", True)], "name string, font_hash string, enabled boolean")
    assert {r["font_hash"]: r["template"] for r in fuzzy.nearest_template(fonts, stored).collect()} == {"3f9ab2": "FONT_A"}


def test_candidates_repair_prefix_and_digits(spark):
    df = spark.createDataFrame([("x 5O7304-AAAA-BBBB-CCCCC",), ("507304-AAAA-2222-CCCCC",)], "text string")
    listed = [[c["code"] for c in r[0]] for r in df.select(candidates.audit_list(F.col("text"), "long")).collect()]
    assert listed[0][:2] == ["X5O730", "5O7304-AAAA-BBBB-CCCCC"] or "507304-AAAA-BBBB-CCCCC" in listed[0]
    assert "S07304-AAAA-2222-CCCCC" in listed[1]


def test_policy_thresholds(spark):
    rows = [(i, f"c{i}", "p", "confirmed_error" if i < 3 else "confirmed_match") for i in range(20)] + [(20, "c20", "q", "needs_review")]
    df = spark.createDataFrame(rows, "seq long, case_id string, profile string, status string")
    got = {r["profile"]: (r["eligible"], r["reasons"]) for r in evaluation.policy_candidates(df).collect()}
    assert got == {"p": (True, []), "q": (False, ["insufficient_confirmed_samples", "insufficient_confirmed_errors", "too_many_ambiguous_samples"])}


def test_percentiles_match_their_definitions(spark):
    values = [3, 900, 14, 14, 77, 500, 2, 61, 8, 45, 45, 12, 6, 1000, 32, 18, 99, 120, 5, 7, 11]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    row = evaluation.percentiles(df, [], "v").first()
    ordered = sorted(values)
    n = len(ordered)
    line = lambda p: round(ordered[int((n - 1) * p)] * (1 - ((n - 1) * p) % 1) + ordered[min(int((n - 1) * p) + 1, n - 1)] * (((n - 1) * p) % 1))
    assert (row["median"], row["p95_nearest"]) == (Decimal(ordered[n // 2]), ordered[int(n * 0.95)])
    assert (row["p50_linear"], row["p95_linear"]) == (line(0.5), line(0.95))


def test_components_of_any_shape(spark):
    import random

    from ledgerlens.operators.graph import components

    rng = random.Random(8)
    path = [(1, i, i + 1) for i in range(200)]
    star = [(2, 500, i) for i in range(100)]
    loose = [(3, rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)]
    links = path + star + loose + [(1, 7, 7), (4, 1, 2), (4, 2, 1)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for key, a, b in links:
        parent[root((key, a))] = root((key, b))
    rows = components(spark.createDataFrame(links, "batch_id long, a long, b long"), ["batch_id"]).collect()
    assert {(r["batch_id"], r["node"]) for r in rows} == set(parent) and len(rows) == len(parent)
    named = {}
    for r in rows:
        named.setdefault((r["batch_id"], r["component"]), set()).add(root((r["batch_id"], r["node"])))
    assert all(len(x) == 1 for x in named.values()) and len(named) == len({root(x) for x in parent})


def test_long_chains_of_choices_end_in_order(spark, monkeypatch):
    """Each confirmed code is close to two predictions, so a choice depends on all before it."""
    letters = "ABCDEFGHJKLMNPQRSTUVWXYZ23456789"
    flat = lambda i: "".join(letters[(i >> 5 * k) % 32] for k in range(2))
    body = lambda i: f"AA{flat(i)}-BBBB-CCCC"
    pairs = [(7, t, p, body(100 + t), body(500 + p), apart) for t in range(60) for p, apart in ((t, 1), (t + 1, 1), (t + 2, 2))]
    pairs += [(8, 1, 1, body(1), body(2), 1)]
    want, used, done = set(), set(), set()
    for batch, t, p, _, _, apart in sorted(pairs, key=lambda x: (x[0], x[1], x[5], x[2])):
        if (batch, t) not in done and (batch, p) not in used:
            want.add((batch, t, p))
            used.add((batch, p))
            done.add((batch, t))
    frame = spark.createDataFrame(pairs, "batch_id long, t long, p long, truth string, predicted string, apart int")
    assert {(r["batch_id"], r["t"], r["p"]) for r in learning._chosen_in_order(frame).collect()} == want
    assert learning._chosen_in_order(frame.limit(0)).count() == 0
