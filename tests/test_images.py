"""One golden case for each branch of the image route, the learning gates and clears of whole chats."""

from pyspark.sql import functions as F
from test_evidence import REMOTE, reading

from ledgerlens.operators import evaluation, fuzzy, images, inventory, learning, sessions

A, B, C = "S07304-AAAA-BBBB-CCCCC", "S07531-K4ED-EQTB-QCFYK", "S07532-6XAW-QTR5-S5X49"
NEAR = "S07304-AAAA-BBBB-CCCC2"
SHORT = "XABC-DEFG-HJKL"


def test_route_branches(spark):
    gpu = dict(original=[(A, 0.99)], enhanced=[(A, 0.99)], cpu=[(A, 0.95)])
    other = dict(unresolved=True)
    cases = [
        (reading(A, A, expected=1), reading(B, B), False, ("primary", [A], [], False)),
        (reading(A, A, expected=1, **gpu), reading(B, B), True, ("strip_clear", [A], [], False)),
        (reading(A, A, expected=1), reading(NEAR, f"{NEAR}\n{NEAR}"), True, ("strip_cloud_slot", [NEAR], [], False)),
        (reading(A, A, expected=1), reading(B, B), True, ("strip_reading", [A], [], True)),
        (reading(A, A, **other), reading(A, A), False, ("exact", [A], [], False)),
        (reading(A, f"{A}\n{B}", **other), reading([B, C], f"{B}\n{C}"), False, ("merged", [B, C, A], [], False)),
        (reading([A, B], f"{A}\n{B}", expected=3), reading([C], C), False, ("merged", [A, B, C], [], False)),
        (reading(NEAR, NEAR, cpu=[(A, 0.9)], **other), reading([A, C], f"{A}\n{C}"), False, ("merged", [A, C], [], False)),
        (reading(A, "507304-AAAA-BBBB-CCCCC"), reading(NEAR, NEAR), False, ("prefix_review", [NEAR], [], False)),
        (reading([], "", **other), reading([], "", short=[SHORT]), False, ("merged", [], [SHORT], False)),
        (reading([], "", **other), reading([], ""), False, ("primary", [], [], False)),
    ]
    import re

    nested = re.sub(r"(?<=, )(\w+) ", r"\1: ", REMOTE.replace("cards array", "cards: array"))
    rows = [(i, remote, cloud, strip) for i, (remote, cloud, strip, _) in enumerate(cases)]
    got = images.route_images(spark.createDataFrame(rows, f"image_id int, remote struct<{nested}>, cloud struct<{nested}>, strip boolean")).collect()
    assert {r["image_id"]: (r["rule"], r["codes"], r["short"], r["review"]) for r in got} == {i: want for i, (*_, want) in enumerate(cases)}


def test_learning_gates(spark):
    heads = spark.createDataFrame(
        [("f_aaaa", True, None, 150), ("f_bbbb", False, "long", 150), ("f_cccc", True, "short", 20), ("unknown_font", True, None, 20)],
        "font_hash string, enabled boolean, card_type string, sample_count long",
    )
    rules = spark.createDataFrame([(f, "position", "20:Z>2", 12, 1) for f in ("f_aaaa", "f_bbbb", "f_cccc", "unknown_font")], "font_hash string, kind string, key string, n long, first_seq long")
    rows = heads.select("font_hash")
    got = learning.gated_rules(rows, heads, learning.templates(heads, rules), learning.rule_book(learning.best_rules(rules))).collect()
    held = {r["font_hash"]: (len(r["font_places"]), len(r["template_places"]), r["similarity"] is not None) for r in got}
    assert held == {"f_aaaa": (1, 1, True), "f_bbbb": (0, 0, False), "f_cccc": (0, 0, False), "unknown_font": (0, 0, False)}


def test_nearest_template_equals_all_pairs(spark):
    """Hashes of different lengths with up to three differing characters, against every template."""
    import itertools
    import random

    rng = random.Random(5)
    fonts, stored = [], []
    for size in (1, 12, 19, 20, 21, 32, 40, 41, 64):
        core = "".join(rng.choice("0123456789abcdef") for _ in range(size))
        stored.append((f"T{size}", f"k_{core}", True))
        for changes in range(4):
            x = list(core)
            for i in rng.sample(range(size), min(changes, size)):
                x[i] = "z"
            fonts += [f"k_{''.join(x)}", f"k_{''.join(x)}y", f"k_{''.join(x)[: size - 1]}"]

    def similarity(a, b):
        if a == b:
            return 100.0
        a, b = a.rsplit("_", 1)[-1], b.rsplit("_", 1)[-1]
        return round(sum(x == y for x, y in zip(a, b)) * 100 / max(len(a), len(b), 1), 2)

    want = {}
    for font, (name, template, _) in itertools.product(set(fonts), stored):
        if similarity(font, template) > 95:
            want[font] = min(want.get(font, (0.0, "~")), (-similarity(font, template), name))
    found = fuzzy.nearest_template(spark.createDataFrame([(f,) for f in fonts], "font_hash string"), spark.createDataFrame(stored, "name string, font_hash string, enabled boolean"))
    assert {r["font_hash"]: (-float(r["similarity"]), r["template"]) for r in found.collect()} == want


def test_missing_codes_and_notices(spark):
    heads = spark.createDataFrame([("f", 3, True, None)], "font_hash string, sample_count long, enabled boolean, last_seen timestamp_ntz")
    rules = spark.createDataFrame([("f", "pair", "5>S", 4), ("unknown_font", "missing", f"missing:{A}", 1), ("unknown_font", "missing", f"missing:{B}", 1)], "font_hash string, kind string, key string, n long")
    total = evaluation.rule_totals(heads, rules).first()
    assert (total["rules"], total["characters"], total["missing"]) == (3, 4, 2)
    at = lambda h: f"2024-01-{1 + h // 24:02d} {h % 24:02d}:00:00"
    notices = spark.createDataFrame([("a", 1, at(0)), ("a", 2, at(23)), ("a", 3, at(24)), ("b", 4, at(1))], "image_id string, seq long, t string")
    sent = sessions.sent_notices(notices.select("image_id", "seq", F.col("t").cast("timestamp_ntz").alias("ts")))
    assert sorted(r["seq"] for r in sent.collect()) == [1, 3, 4]


def test_inviter_outside_cooldown(spark):
    schema = "chat_id long, seq long, ts timestamp_ntz, chat_type string, old_status string, new_status string, title string, user_id long"
    from datetime import datetime

    changes = spark.createDataFrame([(1, 5, datetime(2024, 1, 1), "group", "left", "member", "One", 0)], schema)
    additions = spark.createDataFrame([(1, 7, 42), (1, 3, 0), (2, 4, 9)], "chat_id long, seq long, user_id long")
    got = {r["chat_id"]: (r["title"], r["owner_id"], r["joins"]) for r in sessions.joined_chats(changes, additions).collect()}
    assert got == {1: ("One", 42, 1), 2: (None, 9, 0)}


def test_clears_are_not_counted_twice(spark):
    """A clear moves live rows only; a restored row can be cleared again."""
    record = "id long, chat_id long, final_card string, denomination string, is_redeemed boolean, is_invalid boolean, is_deleted boolean, is_stocked boolean, is_viewed boolean, is_ocr_failed boolean, change_version long"
    row = lambda i, deleted: (i, 7, A, "d", False, False, deleted, False, False, False, 0)
    records = spark.createDataFrame([row(1, False), row(2, True), row(3, False), row(4, False)], record)
    patch = "version long, record_id long, final_card string, denomination string, stocked boolean, redeemed boolean, invalid boolean, viewed boolean, deleted boolean"
    flag = lambda v, r, deleted: (v, r, None, None, None, None, None, None, deleted)
    patches = spark.createDataFrame([flag(15, 1, False), flag(25, 3, True), flag(5, 4, True)], patch)
    clears = spark.createDataFrame([(7, 10), (7, 20), (8, 30)], "chat_id long, version long")
    got = {r["id"]: (r["is_deleted"], r["change_version"]) for r in inventory.apply_patches(records, patches, clears).collect()}
    assert got == {1: (True, 20), 2: (True, 0), 3: (True, 10), 4: (True, 5)}
