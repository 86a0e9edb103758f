"""Golden readings of text: exact ordered codes, unresolved fragments and marker counts."""

from pyspark.sql import functions as F

from ledgerlens.functions import codes, evidence, extract, people

LONG_TEXTS = {
    "first S07411-QK8D-7WMV-3RTEX and S07411-QK8D-7WMV-3RTEX again\nnext S07412-ZZ9C-HYVN-4GFKA": ["S07411-QK8D-7WMV-3RTEX", "S07412-ZZ9C-HYVN-4GFKA"],
    "507415-J8WM-C2XRDDVH9": ["S07415-J8WM-C2XR-DDVH9"],
    "s07418-n4kt-ruxa-ygz7c": ["S07418-N4KT-RUXA-YGZ7C"],
    "S07420-XJ4R-D9AH-C7Q4N": ["S07420-XJ4R-D9AH-C7Q4N"],
    "无卡 just words, total 15": [],
}

WRAPPED = {
    "卡号：S07431-KV8N-TTQA-\nWC4ZE\n密码：\n卡号：S07431-RX7M-E3HJ-\nGGD9A": (["S07431-KV8N-TTQA-WC4ZE", "S07431-RX7M-E3HJ-GGD9A"], False),
    "S07433-CMU4-9KAV-\nXY\nS07433-LTR8-VVEQ-\nH4KNM": (["S07433-LTR8-VVEQ-H4KNM"], True),
    "卡号：S07435-AHT7-\nZMXC-8RKWD": (["S07435-AHT7-ZMXC-8RKWD"], False),
    "面值： S073\n36-KHJR-X4TN-WE9VC": (["S07336-KHJR-X4TN-WE9VC"], False),
    "面值： S074\nQ9-KHJR-X4TN-WE9VC": ([], False),
    "HELLO\nS07439-RRWX-KC3D-\nS07440-MNTV-AKEJ-": ([], True),
    "卡号：S07441-GMJT-D8XK-\nVWZNCLONGER": ([], True),
    "HX9TM\n信息： 卡号： S07443-ENCK-V7WD-": (["S07443-ENCK-V7WD-HX9TM"], False),
}

MARKERS = {
    "S07451-TKVA-MR8C-ZHJ4W\nS07451-TKVA-MR8C-\nZHJ4W": 1,
    "S07452-NXCE-K9RV-DTWH8\nS07453-VGAM-R7KC-JZX4T": 2,
    "S07454-KDJC-\nXHMN-W9TRE\nS07455-": 2,
    "no code": None,
}

SHORT_TEXTS = {
    "QWRT-KX7M-9VNC": ["QWRT-KX7M-9VNC"],
    "x9ABC2-DEF3-GHJ4": [],
    "pins\nHK4T-ZZ9C-MMWX": ["HK4T-ZZ9C-MMWX"],
    "K7RM-VV4X-C9TD\nW3NN-EHKJ-8RAX": ["K7RM-VV4X-C9TD", "W3NN-EHKJ-8RAX"],
    "1234-QRST-UVWX": ["1234-QRST-UVWX"],
    "K8W\n4-RRTM-CXVN": ["K8W4-RRTM-CXVN"],
    "K8W\nplain words\n4-RRTM-CXVN": [],
    "S07461-HTKC-MVRX-EWZ9A\nHTKC-MVRX-EWZ9": [],
    "卡号：CVNM-RKTX-WZ4H 密码\nEEHJ-8899-KKMN": ["CVNM-RKTX-WZ4H", "EEHJ-8899-KKMN"],
}


def _apply(spark, texts, column):
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    return {r["text"]: r["value"] for r in rows.select("text", column(F.col("text")).alias("value")).collect()}


def test_noisy_long_codes(spark):
    assert _apply(spark, LONG_TEXTS, lambda t: extract.noisy_long(codes.fold_text(t))) == LONG_TEXTS


def test_wrapped_lines(spark):
    got = _apply(spark, WRAPPED, lambda t: extract.wrapped_lines(extract.line_facts(extract.lines_of(t))))
    assert {t: (v["codes"], v["unresolved"]) for t, v in got.items()} == WRAPPED


def test_marker_counts(spark):
    assert _apply(spark, MARKERS, extract.marker_count) == MARKERS


def test_short_codes(spark):
    assert _apply(spark, SHORT_TEXTS, lambda t: extract.short_codes(codes.fold_text(t))) == SHORT_TEXTS


def test_typed_codes_with_loose_separators(spark):
    text = "\n S07471-KMX4 RTVN-9HCJA备注\n S07471-ZHWD-KKTR+8MNXC备注\n"
    want = ["S07471-KMX4-RTVN-9HCJA", "S07471-ZHWD-KKTR-8MNXC"]
    assert _apply(spark, [text], extract.confirmed_codes)[text] == want
    assert _apply(spark, [text], extract.loosely_written)[text] == want


def test_validity_and_types(spark):
    cases = {
        "s07481-k4rt-mxc8-vwz9h": ("long", None), "T07481-K4RT-MXC8-VWZ9H": (None, "pubg_prefix_not_s07"), "S07481-K4RT-MXC8": (None, "pubg_group_count_invalid"),
        "S07481-K4R-MXC8-VWZ9H": (None, "pubg_group_length_invalid"), "S07481-K4R?-MXC8-VWZ9H": (None, "pubg_charset_invalid"), "AAAA-BBBB-CCCC": ("short", "pubg_prefix_not_s07"),
    }
    got = _apply(spark, cases, lambda t: F.struct(codes.code_type(t).alias("k"), codes.reject_reason(t, F.lit("long")).alias("r")))
    assert {k: (v["k"], v["r"]) for k, v in got.items()} == cases


def test_prefix_recovery(spark):
    from ledgerlens.operators.fuzzy import recover_prefix

    existing = F.array(F.lit("S07336-MWKX-R8TC-ZVN4D"), F.lit("S07336-HJTA-W9XE-KMC7R"))
    line = "卡号：S01336-TTXM-CWVK-8ZHRD"
    assert _apply(spark, [line], lambda t: recover_prefix(F.array(t), existing))[line] == ["S07336-TTXM-CWVK-8ZHRD"]
    one = F.array(F.lit("S07336-MWKX-R8TC-ZVN4D"))
    assert _apply(spark, [line], lambda t: recover_prefix(F.array(t), one))[line] == []


def test_links_and_handles(spark):
    cases = {"@ann | 12": "@ann", "Bob | 7": "Bob", " ": "Unknown"}
    assert _apply(spark, cases, people.handle_only) == cases
    row = spark.range(1).select(
        people.message_link(F.lit("supergroup"), F.lit(None).cast("string"), F.lit("-1001234"), F.lit(5)).alias("a"),
        people.message_link(F.lit("private"), F.lit("x"), F.lit("1"), F.lit(5)).alias("b"),
    ).first()
    assert (row["a"], row["b"]) == ("https://t.me/c/1234/5", "")


def test_one_type_per_image(spark):
    row = spark.range(1).select(
        evidence.one_type(F.array().cast("array<string>"), F.array(F.lit("AAAA-BBBB-CCCC")), F.lit("TOTAL 5")).alias("kept"),
        evidence.one_type(F.array().cast("array<string>"), F.array(F.lit("AAAA-BBBB-CCCC")), F.lit("S07304")).alias("trace"),
    ).first()
    assert (row["kept"], row["trace"]) == (["AAAA-BBBB-CCCC"], [])
