"""File sources and sinks."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import learning
from ledgerlens.sources import files


def test_audit_scan_skips_broken_records_and_prunes_days(spark, tmp_path):
    for day, name, body in (
        ("2026-07-13", "a.json", json.dumps({"message_id": 1, "source": {"chat_id": -1, "user_id": 2, "username": "x"}, "final_cards": ["c"]})),
        ("2026-07-13", "b.json", "{broken"), ("2026-07-14", "c.json", json.dumps({"message_id": 3})),
    ):
        folder = tmp_path / f"dt={day}"
        folder.mkdir(exist_ok=True)
        (folder / name).write_text(body)
    rows = files.read_audit(spark, str(tmp_path), "2026-07-13").collect()
    assert [(r["message_id"], r["chat_id"], r["final_long"], r["final_short"]) for r in rows] == [(1, -1, ["c"], [])]
    assert {r["user_id"] for r in files.read_audit(spark, str(tmp_path)).collect()} == {0, 2}
    plan = files.read_audit(spark, str(tmp_path), "2026-07-13")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan


def test_hashes_manifests_and_training_sink(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    row = files.hash_files(spark, str(tmp_path), "*.bin").first()
    assert row["content_hash"] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    with pytest.raises(ValueError):
        files.require_cases(spark.range(0))
    cases = spark.createDataFrame(
        [(1, "c1", "p", "h1", ["a"], []), (2, "c2", "p", "h1", ["a"], []), (3, "c3", "p", "h2", ["a", "b"], [])],
        "seq long, case_id string, profile string, content_hash string, expected_long array<string>, expected_short array<string>",
    )
    files.write_training(learning.training_split(cases), str(tmp_path / "out"))
    assert [tuple(r) for r in spark.read.option("sep", "\t").csv(str(tmp_path / "out/labels")).collect()] == [("images/h1.png", "A")]
    assert spark.read.json(str(tmp_path / "out/annotate")).count() == 1


def test_mounted_files_are_hashed_without_the_binary_reader(spark, tmp_path):
    """A file longer than the reader takes is refused as soon as the reader meets its bytes."""
    import hashlib

    bodies = {"long.bin": b"ab" * 5000, "a b%.bin": b"xyz" * 1000}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 100)
    try:
        rows = files.hash_files(spark, str(tmp_path), "*.bin", piece=512).collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    want = {(len(b), hashlib.sha256(b).hexdigest()) for b in bodies.values()}
    assert len(rows) == 2 and {(r["length"], r["content_hash"]) for r in rows} == want


def test_gold_cases_reject_a_wrong_hash(spark):
    cases = spark.createDataFrame([(1, "c", "confirmed_match", "aa", "bb")], "seq long, case_id string, status string, content_hash string, declared_hash string")
    with pytest.raises(Exception, match="content hash mismatch"):
        learning.gold_cases(cases).collect()
    good = learning.gold_cases(cases.withColumn("declared_hash", F.lit(" AA "))).collect()
    assert [r["case_id"] for r in good] == ["c"]


def test_indented_records_give_the_rows_of_lines(spark, tmp_path):
    records = [{"message_id": i, "source": {"chat_id": -i, "user_id": i}, "final_cards": [f"c{i}"], "final_psn_cards": [f"s{i}", "x\ny"]} for i in range(4)]
    lines, tree, hive = tmp_path / "lines" / "dt=2026-07-13", tmp_path / "tree", tmp_path / "hive" / "dt=2026-07-13"
    lines.mkdir(parents=True)
    hive.mkdir(parents=True)
    (lines / "part-0.json").write_text("\n".join(json.dumps(r) for r in records) + "\n\n")
    for i, r in enumerate(records):
        folder = tree / "2026-07-13" / f"120000_{i}_photo"
        folder.mkdir(parents=True)
        (folder / "record.json").write_text(json.dumps(r, ensure_ascii=False, indent=2))
        (hive / f"{i}.json").write_text("﻿" + json.dumps(r, indent=2) if i == 2 else json.dumps(r, indent=4))
    (tree / "2026-07-14" / "x").mkdir(parents=True)
    (tree / "2026-07-14" / "x" / "record.json").write_text(json.dumps({"message_id": 9}, indent=2))
    want = [(i, -i, [f"c{i}"], [f"s{i}", "x\ny"]) for i in range(4)]
    for root in (tmp_path / "lines", tree, tmp_path / "hive"):
        found = files.read_audit(spark, str(root), "2026-07-13")
        assert sorted((r["message_id"], r["chat_id"], r["final_long"], r["final_short"]) for r in found.collect()) == want
        assert found.count() == 4
    assert files.read_audit(spark, str(tree)).count() == 5


def test_a_file_a_key_without_a_directory_a_file(spark, tmp_path):
    rows = spark.range(300).selectExpr("'2026-07-13' AS dt", "nullif(id, 299) AS k", "concat('{', char(10), ' \"message_id\": ', id, char(10), '}') AS value")
    folder = tmp_path / "out"
    files.write_each(rows.unionByName(rows.where("k = 7")), "k", ["dt"], str(folder), task_files=100)
    written = list(folder.rglob("*.txt"))
    assert len(written) == 300
    assert len({p.parent for p in written}) <= spark.sparkContext.defaultParallelism
    assert all(p.parent.parent.name == "dt=2026-07-13" for p in written)
    found = files.read_audit(spark, str(folder), "2026-07-13")
    assert sorted(r["message_id"] for r in found.collect()) == list(range(300))  # of two documents in a file the first


def test_the_driver_lists_no_folder_of_many_files(spark, tmp_path):
    for day in (13, 14, 15):
        folder = tmp_path / f"dt=2026-07-{day}" / "folder=0"
        folder.mkdir(parents=True)
        for i in range(6000):
            (folder / f"{i}.json").write_text(f'{{\n  "message_id": {day * 10000 + i}\n}}')
    found = files.read_audit(spark, str(tmp_path), "2026-07-13")
    assert len(found.inputFiles()) < 1000
    assert sorted(r["message_id"] for r in found.collect()) == list(range(130000, 136000))


@pytest.mark.parametrize("layout", ["dt={}", "dt={}/folder=7", "{}/record", "region=x/dt={}"])
def test_both_ways_to_list_give_the_same_documents(spark, tmp_path, layout):
    root = tmp_path / "a b%20" / "2026-07 é"
    for day in ("2026-07-13", "2026-07-14"):
        folder = root / layout.format(day)
        folder.mkdir(parents=True)
        names = ["plain.json", "sp ace.json", "%25 #?&;+~é漢\u00a0.json", "_hidden.json", ".hidden.json", "late._COPYING_", "_a=b.json"]
        for i, name in enumerate(names):
            (folder / name).write_text(json.dumps({"message_id": i, "source": {"chat_id": -i}}, indent=2))
        (folder / "bom.json").write_text("\ufeff" + json.dumps({"message_id": 20}, indent=4))
        (folder / "bytes.json").write_bytes(b'{"message_id": 21, "raw_text": "\xff\xfe"}\r\n{"message_id": 22}')
        (folder / "packed.json.gz").write_bytes(gzip.compress(b'{\n"message_id": 23\n}'))
        (folder / "large [1].json").write_text("\n".join(json.dumps({"message_id": 30 + i, "raw_text": "x" * 100}) for i in range(9)) + "\nnoise\n\n")
        (folder / "broken.json").write_text('{\n"message_id": 2,')
        (folder / "blank.json").write_text(" \n")
        (folder / "empty.json").write_text("")
        (folder / "nothing.json").symlink_to(folder / "gone.json")
        (folder / "linked.json").symlink_to(folder / "plain.json")
    for day in (None, "2026-07-13"):
        seen = []
        for listed in (0, files.LISTED):
            documents = files.audit_documents(spark, str(root), day, listed=listed, document_bytes=800)
            if day is not None:
                documents = documents.where(F.col("dt") == F.lit(day).cast("date"))
            rows = documents.orderBy("record_path", "pos").select("record_path", F.col("dt").cast("string"), F.to_json("record"), "problem", "rejected").collect()
            seen.append([tuple(r) for r in rows])
        assert seen[0] == seen[1] and len(seen[0]) == (40 if day is None else 20)
    assert files.mounted(spark, f"file://{tmp_path}//a/../b/") == f"{tmp_path}/b" and files.mounted(spark, "hdfs://h/b") is None
    assert files.mounted(spark, str(tmp_path)) == str(tmp_path) and files.mounted(spark, "b") is None and files.mounted(spark, "file://h/b") is None


def test_files_are_written_where_spark_would_write_them(spark, tmp_path):
    days = ["2026-07-13", "a/b=c %{x}", "", None, "é '\"#*:?\\[]^"]
    rows = spark.createDataFrame([(i, days[i % 5], f"t{i}é") for i in range(40)], "k long, dt string, value string")
    files.write_each(rows, "k", ["dt"], str(tmp_path / "own"))
    rows.select("value", "dt").write.partitionBy("dt").text(str(tmp_path / "spark"))

    def folders(root):
        return {p.name for p in root.iterdir() if p.is_dir()}

    assert folders(tmp_path / "own") == folders(tmp_path / "spark")
    back = [spark.read.text(str(tmp_path / root), wholetext=root == "own").select("dt", F.trim(F.regexp_replace("value", "\n", ""))) for root in ("own", "spark")]
    assert sorted(map(tuple, back[0].collect()), key=str) == sorted(map(tuple, back[1].collect()), key=str)
    assert not list((tmp_path / "own").rglob("*.crc"))  # a second file for each cost as much as the first
    with pytest.raises(FileExistsError):
        files.write_each(rows, "k", ["dt"], str(tmp_path / "own"))
    with pytest.raises(Exception, match="no such day"):
        files.write_each(rows.withColumn("value", F.when(F.col("k") == 39, F.raise_error(F.lit("no such day"))).otherwise(F.col("value"))), "k", ["dt"], str(tmp_path / "failed"))
    assert not list((tmp_path / "failed").rglob("*"))


def test_unreadable_documents_go_aside_with_a_reason(spark, tmp_path):
    bodies = {
        "good.json": json.dumps({"message_id": 1}, indent=2), "cut.json": '{\n  "message_id": 2,\n  "source"', "list.json": "[\n1,\n2\n]", "blank.json": " \n\n",
        "lines.json": '{"message_id": 3}\n{"message_id": \n{"message_id": 4}\nnoise', "late.json": 'noise\n{"message_id": 5}', "empty.json": "", "kind.json": '{"message_id": "six"}\n{"message_id": 7, "final_cards": null}',
    }
    for name, body in bodies.items():
        (tmp_path / name).write_text(body)
    for limit in (files.DOCUMENT_BYTES, 0):  # whole files; lines only, as for files that are too large
        documents = files.json_documents(spark, str(tmp_path), files.AUDIT, document_bytes=limit)
        good = {r["record"]["message_id"] for r in documents.where("problem IS NULL").collect()}
        refused = {(r["record_path"].rsplit("/", 1)[1], r["problem"], r["rejected"]) for r in files.rejected(documents).collect()}
        if limit:
            assert good == {1, 3, 4, 5, 7}
            assert refused == {
                ("cut.json", "unreadable document", bodies["cut.json"]), ("list.json", "unreadable document", bodies["list.json"]),
                ("lines.json", "unreadable line", '{"message_id": '), ("lines.json", "unreadable line", "noise"), ("late.json", "unreadable line", "noise"),
                ("kind.json", "field of another type", '{"message_id": "six"}'),
            }
            assert {r["problem"]: r["rejects"] for r in files.reject_counts(documents).collect()} == {"unreadable document": 2, "unreadable line": 3, "field of another type": 1}
        else:
            assert good == {3, 4, 5, 7} and ("good.json", "unreadable line", "{") in refused


def test_manifests_under_both_names(spark, tmp_path):
    case = {"case_id": "a", "status": "confirmed_match", "image_sha256": "ab", "expected_pubg": ["L"], "expected_psn": ["S"]}
    (tmp_path / "one.json").write_text(json.dumps({"schema_version": 1, "profile": "p", "cases": [case, {**case, "case_id": "b", "profile": "q"}]}, indent=2))
    (tmp_path / "two.json").write_text(json.dumps({"cases": [{"case_id": "c", "image_hash": "cd", "expected_long": ["M"], "expected_short": []}]}))
    (tmp_path / "none.json").write_text(json.dumps({"cases": []}, indent=2))
    rows = files.read_manifests(spark, str(tmp_path)).orderBy("case_id").collect()
    assert [(r["profile"], r["case_id"], r["image_hash"], r["expected_long"], r["expected_short"], r["place"]) for r in rows] == [
        ("p", "a", "ab", ["L"], ["S"], 0), ("q", "b", "ab", ["L"], ["S"], 1), (None, "c", "cd", ["M"], [], 0),
    ]
    (tmp_path / "one.json").write_text("{")
    (tmp_path / "two.json").write_text("{")
    with pytest.raises(ValueError):
        files.require_cases(files.read_manifests(spark, str(tmp_path)))


CODES = [f"{a}{a}K{b}-7QRW-T{b}ZP" for a in "CDFH" for b in "MNVX"]


def _harvest(value, out):
    """A recursive walk: the order and the fonts to meet."""
    if isinstance(value, str):
        out += [(c, "unknown_font", None) for c in CODES if c in value]
    elif isinstance(value, list):
        for x in value:
            _harvest(x, out)
    elif isinstance(value, dict):
        font = str(value.get("font_hash") or "unknown_font")
        template = value.get("font_template") if isinstance(value.get("font_template"), str) else None
        for key in files.LEAF_KEYS:
            if isinstance(value.get(key), str):
                out += [(c, font, template) for c in CODES if c in value[key]]
        for key in files.NESTED_KEYS:
            _harvest(value.get(key), out)


def _random_json(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.25:
        return rng.choice([*CODES, "noise", "see " + rng.choice(CODES), 5, None, True])
    if kind < 0.5:
        return [_random_json(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    keys = [*files.LEAF_KEYS, *files.NESTED_KEYS, "other", "font_hash", "font_template"]
    body = {}
    for key in rng.sample(keys, rng.randint(1, 6)):
        body[key] = rng.choice(["f1", "", 7, None]) if key.startswith("font") else _random_json(rng, depth - 1)
    return body


def test_nested_codes_equal_a_recursive_walk(spark):
    import random

    rng = random.Random(2)
    values = [_random_json(rng, 6) for _ in range(150)]
    values += [{"results": [[[{"card": CODES[0], "font_hash": "f", "font_template": "t"}]]]}, [[CODES[1]], [CODES[2], [CODES[1]]]], CODES[3], {"other": {"cards": [CODES[4]]}}, {"cards": {"unknown": CODES[5], "value": CODES[6]}}, None, []]
    bodies = [(i, json.dumps(v, indent=i % 3 or None)) for i, v in enumerate(values)] + [(900, "{broken"), (901, None), (902, "")]
    rows = files.nested_codes(spark.createDataFrame(bodies, "record_id long, body string")).orderBy("record_id", "pos").collect()
    want = []
    for i, v in enumerate(values):
        found, seen = [], set()
        _harvest(v, found)
        for code, font, template in found:
            if code not in seen:
                want.append((i, len(seen), code, font, template))
                seen.add(code)
    assert [(r["record_id"], r["pos"], r["code"], r["font_hash"], r["font_template"]) for r in rows] == want
    assert len(want) > 100


def test_levels_of_nesting_are_walked_in_one_pass(spark):
    """Depths around the number of levels of a pass, in few passes however deep the body is."""
    bodies = [(depth, '{"results": [' * depth + json.dumps(CODES[depth % len(CODES)]) + "]}" * depth) for depth in range(12)]
    records = spark.createDataFrame(bodies, "record_id long, body string")
    want = [(depth, CODES[depth % len(CODES)], 0) for depth, _ in bodies]
    for levels in (1, 2, 3, files.LEVELS):
        before = _finished_jobs(spark)
        rows = files.nested_codes(records, levels)
        passes = _finished_jobs(spark) - before
        assert sorted((r["record_id"], r["code"], r["pos"]) for r in rows.collect()) == want
    assert passes <= 12  # a write and a look for a rest, for each of 3 passes; one a level would need 46


def _finished_jobs(spark):
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
