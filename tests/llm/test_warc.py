from __future__ import annotations

import base64
import gzip
import hashlib
import html
import random
import uuid
import zlib

import zstandard

from tallyspark.llm.warc import build_derivatives, responses_of_pages, serialised, split_http

SCHEMA = "id long, record_id string, target_uri string, date string, block binary, block_digest string, payload_digest string, header string"
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\nX-Long: a\r\n b\r\n"


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def records(spark, rows):
    df = build_derivatives(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA), "id")
    return {(r["id"], r["warc_type"]): r for r in df.withColumn("bytes", serialised(df)).collect()}


def test_records_keep_what_they_derive_from(spark):
    body = "<title>T &amp; é</title><p>caf\xe9</p><a href='/x?a=1&amp;b=2'>l</a>".encode("latin-1")
    packed = gzip.compress(body)
    chunked = b"%x\r\n%s\r\n%x;e\r\n%s\r\n0\r\n\r\n" % (5, body[:5], len(body) - 5, body[5:])
    rows = [
        (1, "<urn:a>", "http://a/", "2020-01-01T00:00:00Z", HEAD + b"\r\n" + body, "sha1:STATED", None),
        (2, "<urn:b>", "http://b/", None, HEAD + b"Content-Encoding: gzip\r\n\r\n" + packed, None, "md5:stated"),
        (3, "<urn:c>", None, "d", HEAD + b"Transfer-Encoding: chunked\r\n\r\n" + chunked, None, None),
    ]
    got = records(spark, rows)
    assert len(got) == 6
    for i, (rid, uri, date, block) in {r[0]: r[1:5] for r in rows}.items():
        for kind in ("metadata", "conversion"):
            r = got[(i, kind)]
            data = r["block"].encode()
            head, _, rest = bytes(r["bytes"]).partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            assert rest == data + b"\r\n\r\n" and fields["Content-Length"] == str(len(data))
            assert fields["WARC-Type"] == kind and fields["WARC-Refers-To"] == rid == r["refers_to"]
            assert fields.get("WARC-Refers-To-Target-URI") == uri and fields.get("WARC-Refers-To-Date") == date
            assert fields["WARC-Block-Digest"] == sha1(data) and fields["WARC-Record-ID"] == r["record_id"]
        assert got[(i, "conversion")]["block"] == "café\nl" or "café" in got[(i, "conversion")]["block"]
        lines = got[(i, "metadata")]["block"].split("\r\n")
        assert "http-header-x-long: a b" in lines and "outlink: /x?a=1&b=2" in lines and "title: T & é" in lines or i != 1
        assert f"source-block-digest: {'sha1:STATED' if i == 1 else sha1(block)}" in lines
        assert f"source-payload-digest: {'md5:stated' if i == 2 else sha1(split_http(block)[2])}" in lines
    assert len({r["record_id"] for r in got.values()}) == 6


def test_odd_rows(spark):
    rows = [(1, "<r>", "u", "d", None, None, None), (2, None, "u", "d", b"x", None, None), (3, "<s>", "u", "d", b"no head", None, None), (4, "<t>", "u", "d", HEAD + b"Content-Encoding: gzip\r\n\r\nnot gzip", None, None), (5, "<v>", "u", "d", b"HTTP/1.1 200 OK\r\nContent-Type: a; charset=nope\r\n\r\n" + b"w " * 200_000, None, None)]
    got = records(spark, rows)
    assert {k[0] for k in got} == {1, 3, 4, 5}
    assert got[(1, "conversion")]["block"] == "" and got[(3, "conversion")]["block"] == "no head" and got[(4, "conversion")]["block"] == "not gzip"
    assert len(got[(5, "conversion")]["block"].split()) == 200_000
    empty = spark.createDataFrame([], SCHEMA)
    assert build_derivatives(empty, "id").count() == 0


def test_pages_give_the_same_ids_each_time(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (2, None, None), (None, "u", "b")], "page_id long, url string, html string")
    twice = [sorted(r["record_id"] for r in build_derivatives(responses_of_pages(pages), "page_id").collect()) for _ in range(2)]
    assert twice[0] == twice[1] and len(twice[0]) == 8 and len(set(twice[0])) == 6


def test_hostile_heads_and_bodies(spark):
    """Charsets that are no text encodings, chunk sizes that go back, unknown packings: each has its text or none."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=%s\r\n%s\r\n"
    raw = zlib.compressobj(wbits=-15)
    bodies = [
        (head % (b"idna", b"") + b"plain \xc3\xa9", "plain é"),
        (head % (b"undefined", b"") + b"plain", "plain"),
        (head % (b"base64", b"") + b"plain", "plain"),
        (head % (b"utf-7", b"") + b"a+2AA-b", "a\ufffdb"),
        (head % (b"unicode_escape", b"") + b"a\\ud800b", "a\ufffdb"),
        (head % (b"utf-8", b"Transfer-Encoding: chunked\r\n") + b"-6\r\nabc\r\n", "-6 abc"),
        (head % (b"utf-8", b"Transfer-Encoding: chunked\r\n") + b"1_0\r\nabc", "1_0 abc"),
        (head % (b"utf-8", b"Transfer-Encoding: chunked\r\n") + b"3\r\nabc", "abc"),
        (head % (b"utf-8", b"Transfer-Encoding: chunked\r\n") + b"fffffffff\r\nabc\r\n0\r\n", "abc 0"),
        (head % (b"utf-8", b"Content-Encoding: br\r\n") + b"\x8b\x02\x80noise", ""),
        (head % (b"utf-8", b"Content-Encoding: deflate\r\n") + raw.compress(b"raw text") + raw.flush(), "raw text"),
        (head % (b"utf-8", b"Content-Encoding: zstd\r\n") + zstandard.compress(b"zstd text"), "zstd text"),
    ]
    got = records(spark, [(i, f"<r{i}>", "u", "d", body, None, None) for i, (body, _) in enumerate(bodies)])
    assert [got[(i, "conversion")]["block"] for i in range(len(bodies))] == [text for _, text in bodies]


def plain_records(record_id, uri, date, status, headers, page_text, title, links, block, payload):
    """Both records, spelled out from the format."""
    fields = [("status", status), *((f"http-header-{n.lower()}", v) for n, v in headers), ("source-block-digest", sha1(block)), ("source-payload-digest", sha1(payload)), ("title", title)]
    fields += [("text-characters", str(len(page_text))), ("text-words", str(len(page_text.split()))), *(("outlink", x) for x in links)]
    metadata = "".join(f"{n}: {v}\r\n" for n, v in fields if v)
    for kind, kind_type, text in (("metadata", "application/warc-fields", metadata), ("conversion", "text/plain; charset=utf-8", page_text)):
        own = sha1(text.encode())
        rid = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, record_id + ' ' + kind)}>"
        lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Refers-To: {record_id}"]
        lines += [f"WARC-Refers-To-Target-URI: {uri}", f"WARC-Refers-To-Date: {date}", f"WARC-Block-Digest: {own}", f"WARC-Payload-Digest: {sha1(payload) if kind == 'metadata' else own}"]
        lines += [f"Content-Type: {kind_type}", f"Content-Length: {len(text.encode())}", "", text]
        yield kind, ("\r\n".join(lines) + "\r\n\r\n").encode()


def test_records_against_the_format(spark):
    """Whole records, byte for byte, of random pages against ones spelled out from the format."""
    r = random.Random(4)
    rows, want = [], {}
    for i in range(30):
        words = [r.choice(["alpha", "béta", "γ", "x &amp; y"]) for _ in range(r.randrange(6))]
        links = [f"/p?{r.randrange(99)}" for _ in range(r.randrange(3))]
        title = r.choice(["", "A title", "T &lt;b&gt;"])
        html_text = (f"<title>{title}</title>" if title else "") + "".join(f"<p>{w}</p>" for w in words) + "".join(f'<a href="{x}">l</a> ' for x in links)
        headers = [("Content-Type", "text/html; charset=utf-8"), *[(f"X-{k}", str(r.randrange(9))) for k in range(r.randrange(3))]]
        payload = html_text.encode()
        block = b"HTTP/1.1 200 OK\r\n" + "".join(f"{n}: {v}\r\n" for n, v in headers).encode() + b"\r\n" + payload
        text = "\n".join([html.unescape(w) for w in words] + ([" ".join("l" for _ in links)] if links else []))
        rows.append((i, f"<urn:{i}>", f"http://h/{i}", "2020-01-01T00:00:00Z", block, None, None))
        for kind, data in plain_records(f"<urn:{i}>", f"http://h/{i}", "2020-01-01T00:00:00Z", "HTTP/1.1 200 OK", headers, text, html.unescape(title), links, block, payload):
            want[(i, kind)] = data
    assert {k: bytes(v["bytes"]) for k, v in records(spark, rows).items()} == want
