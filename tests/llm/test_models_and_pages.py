"""Models on held-out rows, media round trips, WARC links, page text, and the pipeline."""

import gzip
import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
import corpus_pipeline
from ledgerlens.llm import language, main_text, media, quality, queries, warc
from ledgerlens.llm.common import held_out, tuned
from samples import ODD

FOLDER = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"



def canon(value):
    return repr(round(value, 6)) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    frame = queries.QUERIES[name](spark, FOLDER)
    result = con.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(frame.columns)
    assert sorted(tuple(canon(r[c]) for c in names) for r in frame.collect()) == sorted(tuple(map(canon, r)) for r in result.fetchall())


def test_all_registered():
    names = set(entry_module.queries())
    assert {"pipeline", *queries.QUERIES} <= names
    assert sorted(int(x[2:].split("_")[0]) for x in queries.QUERIES) == list(range(1, 14))


def test_language_on_held_out_rows(spark):
    docs = tuned(spark).read.parquet(f"{LARGER}/documents.parquet")
    rows = queries.QUERIES["op7_rank_order_language"](spark, LARGER).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert len(held) > 100 and sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def grams_by_hand(text):
    out = {}
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        padded = f" {word} "
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                gram = padded[i : i + n]
                if gram != " ":
                    key = 0
                    for c in gram:
                        key = key << 21 | ord(c)
                    out[key] = out.get(key, 0) + 1
    return out


@pytest.mark.parametrize("text", ["The  cat, the hat", "é", "a b", "x1y_z ½ 漢字 ok", "-a", "Ünïcode " * 50])
def test_grams(text):
    keys, counts = language.grams(text)
    assert dict(zip(keys.tolist(), counts.tolist())) == grams_by_hand(text)


def test_language_of_odd_rows(docs):
    profiles = language.train(docs(["the cat and the dog", "le chat et le chien"] * 10))
    assert set(profiles) == {"en", "fr"}
    rows = language.identify(docs(["le chien", *ODD]), profiles).orderBy("doc_id").collect()
    assert rows[0]["lang_pred"] == "fr"
    assert [r["lang_pred"] for r in rows[1:4]] == ["und"] * 3 and rows[1]["score"] == 0.0
    assert language.train(docs([])) == {} and language.train(docs(["a"]).withColumn("lang", F.lit(None).cast("string"))) == {}
    assert language.identify(docs(["abc"]), {}).first()["lang_pred"] == "und"


def test_quality_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    rows = queries.QUERIES["op2_boosted_quality"](spark, LARGER).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r["score"] for r in rows if r["quality"]], [r["score"] for r in rows if not r["quality"]]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_trees_fit_and_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, quality.N_FEATURES))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] < 0)).astype(float)
    model = quality.fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97
    bins, margin = model.bins(x[:20]), np.full(20, model.base)
    for root in model.roots:  # one row at a time
        for row in range(20):
            node = root
            while model.left[node] != node:
                node = (model.left if bins[row, model.feature[node]] <= model.limit[node] else model.right)[node]
            margin[row] += model.value[node]
    assert np.allclose(model.margin(x[:20]), margin)


def test_quality_of_odd_rows(spark, docs):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    rows = quality.classify(docs(ODD, [*range(9), None]), labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.classify(docs([]), labels).count() == 0
    assert quality.classify(docs(["a"]), labels.limit(0)).first()["score"] == 0.5


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 4096, 4097, 64 * 64 * 3 + 5])
def test_media_round_trip(size):
    payload = media.padded(bytes(i * 7 % 256 for i in range(size)))
    stored = media.encode(payload)
    info, back = media.read(stored)
    assert back == payload and len(payload) % 64 == 0 and len(payload) >= max(64, size)
    frames = len(payload) // 64
    assert info["keys"].tolist() == list(range(0, frames, 16)) and info["duration"] == pytest.approx(len(payload) / 8000)
    assert all(stored[o : o + 64] == payload[k * 64 : k * 64 + 64] for k, o in zip(info["keys"], info["offsets"][info["keys"]]))


def test_media_rejects_broken_files():
    stored = media.encode(bytes(640))
    for broken in (stored[:50], stored[:-10], stored.replace(b"stsz", b"xxxx"), b"\0\0\0\x04ftyp"):
        with pytest.raises(ValueError):
            media.read(broken)


def test_media_columns(docs):
    rows = media.media_columns(docs(ODD).select("doc_id", "text")).orderBy("doc_id").collect()
    for text, r in zip(ODD, rows):
        data = (text or "").encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest() and r["media_bytes"] == len(r["media"])
        assert all(len(r["media"]) >= o + s for o, s in zip(r["key_offsets"], r["key_sizes"]))
    assert rows[7][1:] == rows[8][1:]  # equal texts


PAGE = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><header><p>Site name</p></header><nav><a href="/">Home</a></nav>
<div class="cookie-notice">We use cookies</div><aside>Side words here</aside><article><header><h1>Title &amp;  more</h1></header><p>First <b>bold</b>
 words &lt;here&gt; and then some.<p>Second paragraph with an <a href="x">inner link</a> and words.<div class="ad">Buy this now</div><p>Third&nbsp;one.</p>
<form><p>Enter mail</p></form></article><section class="comments"><p>A reader said something very long that is not the article at all.</p></section><footer>Contact us</footer></body></html>"""
TEXT = "Title & more First bold words <here> and then some. Second paragraph with an inner link and words. Third one."


def test_main_text(spark):
    tuned(spark)
    plain = PAGE.replace("<article>", "<div>").replace("</article>", "</div>").replace("<header><h1>", "<h1>").replace("</h1></header>", "</h1>")
    rows = [(0, PAGE), (1, PAGE), (2, plain), (3, None), (4, ""), (5, "just words"), (6, "<nav><a>x</a></nav>"), (7, "<p>cut off <b"), (8, "a < b &am"), (9, "<!-- open")]
    frame = spark.createDataFrame(rows, "page_id long, html string").withColumn("text2", F.lit(1))
    got = {r["page_id"]: r["text"] for r in main_text.main_text(frame).collect()}
    assert got == {0: TEXT, 1: TEXT, 2: TEXT, 3: "", 4: "", 5: "just words", 6: "", 7: "cut off", 8: "a < b &am", 9: ""}
    assert main_text.main_text(frame.limit(0)).count() == 0


def test_lists_stay_and_link_lists_go(spark):
    tuned(spark)
    page = PAGE.replace("<div class=\"ad\">", "<ul><li>item one here</li><li>item two</li></ul><div class=\"ad\">").replace("<p>Third&nbsp;one.</p>", "<ul><li>last item of all</li></ul>")
    wrapped = "<body><div class='content has-sidebar'><p>Words of the text that stay.</p></div><ul><li><a href=x>more links</a></li><li><a href=y>and others</a></li></ul></body>"
    rows = [(i, PAGE) for i in range(5)] + [(8, page), (9, wrapped)]
    got = {r["page_id"]: r["text"] for r in main_text.main_text(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    assert got[8] == TEXT.replace(" Third one.", " item one here item two last item of all")
    assert got[9] == "Words of the text that stay."


def test_articles_in_articles_are_comments(spark):
    tuned(spark)
    comment = "<section><h2>Replies</h2><article><p>A reader says a great many words that are not the text.</p></article></section></article>"
    page = PAGE.replace("</article>", comment.replace("<h2>Replies</h2>", ""))
    rows = [(i, PAGE) for i in range(5)] + [(8, page)]
    got = {r["page_id"]: r["text"] for r in main_text.main_text(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    assert got[8] == got[0] == TEXT


def test_coded_bodies():
    body = "<p>one two</p>".encode() * 40
    raw_deflate = zlib.compressobj(wbits=-15)
    chunked = b"".join(b"%x;q=1\r\n" % len(x) + x + b"\r\n" for x in (body[:100], body[100:])) + b"0\r\n\r\n"
    cases = [
        ({}, body), ({"transfer-encoding": "chunked"}, chunked), ({"transfer-encoding": "chunked"}, body), ({"content-encoding": "gzip"}, gzip.compress(body)),
        ({"content-encoding": "gzip"}, body), ({"content-encoding": "deflate"}, zlib.compress(body)), ({"content-encoding": "deflate"}, raw_deflate.compress(body) + raw_deflate.flush()),
        ({"content-encoding": "identity"}, body),
    ]
    for http, stored in cases:
        assert warc.entity(http, stored) == body
        fields = "".join(f"{k}: {v}\r\n" for k, v in http.items()).encode()
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n" + fields + b"\r\n" + stored
        meta, text = warc.derive(warc.build({"WARC-Type": "response", "WARC-Record-ID": "<urn:x>"}, block))
        assert warc.parse(text["record"])[1] == b"one two\n" * 40 and meta["source_payload_digest"] == warc.digest(stored)


def test_best_region_equals_brute_force():
    weights = {"p": 1.0, "li": -1.0, "<p>": -0.45, "<li>": -2.0, "<ul>": -1.0}
    items = [("p", 3), ("li", 2), ("li", 4), ("p", 5), ("p", 1), ("li", 9), ("p", 2)]
    page = "".join(f"<{t}>{' '.join(f'{t}{i}' for i in range(n))}</{t}>" for t, n in items)
    parsed, _ = main_text.parse(page)
    scores = [n * weights.get(f, -main_text.TAG) for f, _, n in main_text._features(parsed)]
    best = max(((sum(scores[a:b]), -a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)))
    region = parsed[-best[1] : best[2]]
    assert main_text.extract(page, weights) == " ".join(x[3] for x in region if x[0] == "block")


def test_warc_links_and_digests(spark):
    tuned(spark)
    pages = spark.createDataFrame([(1, "http://a.b/ c", PAGE), (2, None, None), (2, None, None), (None, "u", "")], "page_id long, url string, html string")
    sources = {}
    for r in warc.responses(pages).collect():
        headers, block = warc.parse(bytes(r["record"]))
        sources[headers["warc-record-id"]] = (headers, block)
        assert headers["warc-block-digest"] == warc.digest(block)
    rows = warc.derivatives(warc.responses(pages)).collect()
    assert sorted(r["warc_type"] for r in rows) == ["conversion"] * 4 + ["metadata"] * 4
    for r in rows:
        headers, body = warc.parse(bytes(r["record"]))
        source, block = sources[r["refers_to"]]
        assert headers["warc-refers-to"] == source["warc-record-id"] and headers["warc-record-id"] == r["record_id"] != r["refers_to"]
        assert headers["warc-block-digest"] == r["block_digest"] == warc.digest(body) and len(body) == r["content_length"]
        assert headers["x-source-payload-digest"] == source["warc-payload-digest"] == r["source_payload_digest"]
        assert headers["warc-target-uri"] == source["warc-target-uri"] and headers["warc-date"] == source["warc-date"]
        if r["warc_type"] == "metadata":
            assert f"source-block-digest: {source['warc-block-digest']}" in body.decode() and "payload-digest-valid: true" in body.decode()
    text = next(r for r in rows if r["page_id"] == 1 and r["warc_type"] == "conversion")
    assert warc.parse(bytes(text["record"]))[1].decode().split("\n")[:2] == ["Site name", "Home"]
    odd = [None, b"", b"nonsense", warc.build({"WARC-Type": "request"}, b"x"), b"WARC/1.1\r\nContent-Length: 99\r\n\r\nshort"]
    got = warc.derivatives(spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "k long, record binary")).collect()
    assert sorted(r["k"] for r in got if r["warc_type"] == "error") == [0, 1, 2, 4] and len(got) == 4
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


def test_pipeline_against_its_operators(spark, docs):
    passage = " ".join(f"q{i}" for i in range(60))
    body = "the cat and the dog went to the house of the old man with words "
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet").first()["text"]
    texts = [body + "one", body + "one", None, "", "12 34", passage + " alpha " + " ".join(f"r{i}" for i in range(40)), passage + " beta " + " ".join(f"s{i}" for i in range(40)), "intro " + bench + " outro"]
    frame = docs(texts).withColumn("score", F.lit("clash")).withColumn("N_HIT", F.lit(None).cast("string"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, FOLDER)
        rows = frame.collect()
        kept[name] = {r["doc_id"]: r for r in rows}
        assert len(kept[name]) == len(rows)
        if name != "mixing":
            assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "N_HIT"]
    assert set(kept["language_id"]) == {0, 1, 5, 6, 7} and set(kept["near_dedup"]) == {0, 5, 6, 7}
    assert kept["substring_dedup"][6]["text"].startswith("beta") and kept["substring_dedup"][6]["n_chars"] == len(kept["substring_dedup"][6]["text"])
    assert kept["substring_dedup"][5]["text"] == texts[5]
    assert set(kept["decontamination"]) == set(kept["mixing"]) == {0, 5, 6}


def test_pipeline_of_an_empty_table(spark, docs):
    frame = docs([])
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, FOLDER)
        assert frame.count() == 0


def test_held_out_rule(spark):
    rows = spark.range(100).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in rows)
