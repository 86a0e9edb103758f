"""Golden agreement cases."""

from pyspark.sql import functions as F

from ledgerlens.functions import evidence

SCORED = "array<struct<code: string, score: double>>"
REMOTE = (
    f"cards array<string>, short array<string>, raw_text string, uncertain int, expected int, conflict boolean, unresolved boolean, original {SCORED}, "
    f"enhanced {SCORED}, original_rebuilt {SCORED}, enhanced_rebuilt {SCORED}, cpu {SCORED}, cpu_review boolean, cpu_reasons array<string>"
)


def reading(card, text="", **more):
    base = dict(
        cards=[card] if isinstance(card, str) else list(card), short=[], raw_text=text, uncertain=0, expected=None, conflict=False, unresolved=False,
        original=[], enhanced=[], original_rebuilt=[], enhanced_rebuilt=[], cpu=[], cpu_review=False, cpu_reasons=[],
    )
    return {**base, **more}


def frame(spark, rows):
    nested = REMOTE.replace("cards array", "cards: array")
    import re

    nested = re.sub(r"(?<=, )(\w+) ", r"\1: ", nested)
    return spark.createDataFrame(rows, f"k int, remote struct<{nested}>, cloud struct<{nested}>")


def test_repeated_agreement(spark):
    a, b, c, d = "S07511-KW3M-PL8D-VZ6HT", "S07512-DD4K-RM2X-HJ9PN", "S07513-TT7B-QQ5N-M3C9L", "S07514-PF92-6XKC-R4VWQ"
    gpu = lambda x, s, y, t: dict(original=[(x, s)], enhanced=[(y, t)])
    wrapped = f"{d[:19]}\n{d[19:]}"
    merged = lambda remote, cloud: "[REMOTE]\n" + "\n".join(remote) + "\n[OCRSPACE]\n" + "\n".join(cloud)
    cases = [
        # Seen twice; the cloud has it and a misread tail.
        (a, merged([a, a], [a, a, a[:17] + "UZ6HT"]), {}, a),
        # Misread first letters of one code; the cloud also misreads its third group.
        (b, merged(["5" + b[1:], "9" + b[1:]], [b, b[:12] + "NM2X" + b[16:], b[:12] + "NM2X-HJ8PN"]), {}, b),
        # Two different codes; one sight only.
        (b, merged(["5" + b[1:], "8" + b[1:12] + "WXYZ-LKJHG"], [b]), {}, None),
        (a, merged([a], [a]), {}, None),
        # Both variants are sure and the cloud differs in the last group; one is not sure; another third group.
        (c, merged([c], [c[:17] + "03C91", c[:17] + "M3C9K"]), gpu(c, 0.982, c, 0.991), c),
        (c, merged([c], [c[:17] + "M3C9K"]), gpu(c, 0.96, c, 0.99), None),
        (c, merged([c], [c[:12] + "WXYZ" + c[16:]]), gpu(c, 0.99, c, 0.99), None),
        # Wrapped onto the next line: twice, once, and with a line between.
        (d, merged([wrapped, wrapped], [d, d[:12] + "VWQR-6XKC4"]), {}, d),
        (d, merged([wrapped], [d]), {}, None),
        (d, merged([f"{d[:19]}\nBETWEEN\n{d[19:]}"] * 2, [d]), {}, None),
        # The cloud shows a code of another slot.
        (a, merged([a, a], [a, a, a[:7] + "WXYZ-LKJH-GFDSA"]), {}, None),
    ]
    rows = [(i, reading(card, text, **more), reading(card)) for i, (card, text, more, _) in enumerate(cases)]
    parts = evidence.sections(F.col("remote.raw_text"))
    got = frame(spark, rows).withColumn("parts", parts).select(
        "k", evidence.repeated_agreement(F.col("remote"), F.col("parts"), F.array().cast("array<string>")).alias("code")
    )
    assert {r["k"]: r["code"] for r in got.collect()} == {i: want for i, (*_, want) in enumerate(cases)}


def test_exact_agreement_and_competitor(spark):
    card = "S07515-8NRC-T45Z-BX2JD"
    rows = [(0, reading(card, f"{card[:20]}\n{card[20:]}"), reading(card, "nothing")), (1, reading(card, card), reading(card, f"{card}\n{card[:-1]}7"))]
    got = frame(spark, rows).select("k", evidence.exact_agreement(F.col("remote"), F.col("cloud")).alias("c")).collect()
    assert {r["k"]: r["c"] for r in got} == {0: card, 1: None}


def test_worker_merge_reasons(spark):
    whole, shifted = "S07521-MM38-KD57-TT69B", "S07521-MM38-KD5G-7TT69"  # a letter slipped in, the last one fell off
    other, glued = "S07522-CC41-DD52-EE63F", "S07522-94LK-NN88-PES07"  # the last letters are the next code's first
    lines = ["first " + glued[:17], glued[17:19]]
    first, second = "S07523-ZZ3N-5CWH-GTRVK", "S07523-QF8Z-BPLM-BR6WV"
    cases = [
        ([whole], [shifted, whole], [], [whole], ["line_wrap_conflict"]),
        ([other], [glued], lines, [other], ["incomplete_text_line"]),
        ([], [glued], lines, [], ["incomplete_text_line"]),
        ([first], [second, first], [], [first, second], []),
    ]
    rows = [(i, t, w, lines) for i, (t, w, lines, _, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "k int, t array<string>, w array<string>, lines array<string>")
    got = df.select("k", evidence.merge_with_worker(F.col("t"), F.col("w"), F.col("lines")).alias("m")).collect()
    assert {r["k"]: (r["m"]["cards"], [d["reason"] for d in r["m"]["dropped"]]) for r in got} == {i: (c, r) for i, (*_, c, r) in enumerate(cases)}


def test_apply_confirmed_replaces_unique_slot(spark):
    a, near, other = "S07304-AAAA-BBBB-CCCCC", "S07304-AAAA-BBBB-CCCC2", "S07304-XXXX-YYYY-ZZZZZ"
    df = spark.createDataFrame([(1, [a], [near, other]), (2, [a], [])], "k int, cards array<string>, ok array<string>")
    got = {r["k"]: r["d"] for r in df.select("k", evidence.apply_confirmed(F.col("cards"), F.col("ok")).alias("d")).collect()}
    assert (got[1]["cards"], got[1]["resolved"]) == ([near, other], 2)
    assert (got[2]["cards"], got[2]["resolved"]) == ([a], 0)


def test_ordered_subsets(spark):
    df = spark.createDataFrame([(["a", "c"], ["a", "b", "c"]), (["c", "a"], ["a", "b", "c"]), (["a", "a"], ["a", "b"])], "p array<string>, w array<string>")
    assert [r[0] for r in df.select(evidence.ordered_within(F.col("p"), F.col("w"))).collect()] == [True, False, False]
