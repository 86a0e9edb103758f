"""WARC records with coded bodies of several members and with repeated headers."""

import gzip

from ledgerlens.llm import warc


def records(stored, fields=b"", **more):
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n" + fields + b"\r\n" + stored
    meta, text = warc.derive(warc.build({"WARC-Type": "response", "WARC-Record-ID": "<urn:x>", **more}, block))
    return warc.parse(meta["record"])[1].decode(), warc.parse(text["record"])[1].decode()


def test_all_members_of_a_body():
    coded, parts = b"Content-Encoding: gzip\r\n", [gzip.compress(b"<p>word %d</p>" % i) for i in range(3)]
    want = "word 0\nword 1\nword 2\n"
    for stored in (b"".join(parts), b"".join(parts) + b"\0" * 8):
        meta, text = records(stored, coded)
        assert text == want and "truncated" not in meta
    meta, text = records(b"".join(parts)[:-12], coded)
    assert text.startswith("word 0\nword 1\n") and "payload-coding-truncated: true" in meta


def test_all_headers_of_the_source():
    more = {"WARC-Truncated": "length", "WARC-Warcinfo-ID": "<urn:info>", "WARC-Concurrent-To": "<urn:a>\r\nWARC-Concurrent-To: <urn:b>"}
    meta, text = records(b"<p>one</p>", b"Set-Cookie: a=1\r\nSet-Cookie: b=2\r\nVia: x\r\nVia: y\r\n", **more)
    lines = meta.split("\r\n")
    for line in ("http-header-set-cookie: a=1", "http-header-set-cookie: b=2", "http-header-via: x", "http-header-via: y"):
        assert lines.count(line) == 1
    for line in ("warc-truncated: length", "warc-warcinfo-id: <urn:info>", "warc-concurrent-to: <urn:a>", "warc-concurrent-to: <urn:b>", "warc-type: response"):
        assert lines.count(f"source-header-{line}") == 1
    assert text == "one\n"


def test_bare_line_feeds_and_bytes_of_headers():
    for end in (b"\r\n", b"\n"):
        head = end.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html", b"X-Name: Caf\xe9", b"X-Other: caf\xc3\xa9", b"X-Long: one" + end + b"  two"])
        block = head + end + end + b"<p>words</p>\n\n<p>more</p>"
        rows = warc.derive(warc.build({"WARC-Type": "response", "WARC-Record-ID": "<urn:x>"}, block))
        meta, text = (warc.parse(r["record"])[1] for r in rows)
        assert text == b"words\nmore\n"
        assert b"http-header-x-name: Caf\xe9\r\n" in meta and b"http-header-x-other: caf\xc3\xa9\r\n" in meta
        assert b"http-header-x-long: one two\r\n" in meta
        assert b"http-header-names: Content-Type, X-Name, X-Other, X-Long\r\n" in meta
    record = b"WARC/1.0\nWARC-Type: response\nWARC-Record-ID: <urn:y>\nWARC-Target-URI: http://x/\xe9\nContent-Length: %d\n\n" % len(block) + block
    meta, text = warc.derive(record)
    assert warc.parse(text["record"])[1] == b"words\nmore\n"
    assert text["target_uri"] == "http://x/�" and b"WARC-Target-URI: http://x/\xe9\r\n" in text["record"]


def test_byte_order_marks():
    page = "<p>Grün 漢字</p>"
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        for kind in (b"text/html; charset=latin-1", b"text/html"):
            block = b"HTTP/1.1 200 OK\r\nContent-Type: " + kind + b"\r\n\r\n" + mark + page.encode(name)
            text = warc.derive(warc.build({"WARC-Type": "response", "WARC-Record-ID": "<urn:x>"}, block))[1]
            assert warc.parse(text["record"])[1].decode() == "Grün 漢字\n"


def test_names_that_clash_give_way(spark):
    from ledgerlens.llm.common import tuned

    tuned(spark)
    pages = spark.createDataFrame([(1, "http://u", "<p>a b</p>", "x", "y")], "page_id long, url string, html string, record string, error string")
    made = warc.responses(pages)
    assert made.columns == ["page_id", "error", "record"]
    rows = warc.derivatives(made).collect()
    assert [r["warc_type"] for r in rows] == ["metadata", "conversion"] and rows[0]["error"] is None
    assert warc.derivatives(made).columns == ["page_id", *warc.FIELDS]


def test_derivatives_by_hand(spark):
    """Headers, text, links and digests of whole records against a direct reading, a very long page among them."""
    import base64
    import hashlib

    from ledgerlens.llm.common import tuned

    tuned(spark)
    sha1 = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    bodies = ["<h1>Top</h1><p>one  two</p>", "", None, "<p>" + "word " * 200_000 + "</p>", "<p>tie</p>", "<p>tie</p>"]
    pages = spark.createDataFrame([(i, f"http://u/{i}", b) for i, b in enumerate(bodies)], "page_id long, url string, html string")
    rows = warc.derivatives(warc.responses(pages)).orderBy("page_id", "warc_type").collect()
    assert len(rows) == 12
    texts = ["Top\none two\n", "", "", ("word " * 200_000).strip() + "\n", "tie\n", "tie\n"]
    for i, text in enumerate(texts):
        made, meta = rows[2 * i], rows[2 * i + 1]
        payload = (bodies[i] or "").encode()
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
        for row in (made, meta):
            assert row["target_uri"] == f"http://u/{i}" and row["source_payload_digest"] == sha1(payload) and row["source_block_digest"] == sha1(block)
            head, _, rest = bytes(row["record"]).partition(b"\r\n\r\n")
            body = rest[: row["content_length"]]
            assert rest[row["content_length"] :] == b"\r\n\r\n" and row["block_digest"] == sha1(body)
            assert f"WARC-Refers-To: {row['refers_to']}\r\n".encode() in head and f"WARC-Record-ID: {row['record_id']}\r\n".encode() in head
        assert bytes(made["record"]).partition(b"\r\n\r\n")[2][:-4].decode() == text
        assert f"payload-length: {len(payload)}\r\nsource" not in bytes(meta["record"]).decode()
        assert f"http-header-content-length: {len(payload)}\r\n" in bytes(meta["record"]).decode() and "payload-digest-valid: true" in bytes(meta["record"]).decode()
