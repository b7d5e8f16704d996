from __future__ import annotations

import base64
import gzip
import hashlib

import pytest

from corpuscle.llm import warc as W
from corpuscle.llm.common import new_path

PAGES = [(5, "http://a/5", "same é"), (3, "http://a/3", "same é"), (4, None, "same é"), (7, "http://a/7", ""), (8, "http://a/8", None), (9, "http://a/9", "unique " * 500), (None, "http://a/n", "unique 2"), (10, "x\r\nWARC-Type: no", "\r\n\r\nWARC/1.1\r\n\x1f")]


@pytest.mark.parametrize("size", [1, 37, 700, 1 << 23])
def test_round_trip(spark, size):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(2)
    folder = new_path(spark, "test-warc")
    files = W.write_warc(W.decide(pages), folder)
    got = {r["page_id"]: r for r in W.read_warc(files, folder, size, with_payload=True).collect()}
    assert len(got) == len(PAGES)
    for page_id, url, html in PAGES:
        raw = (html or "").encode()
        r = got[page_id]
        assert r["payload_bytes"] == len(raw)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        refers = {5: 3, 4: 3, 8: 7}.get(page_id)
        assert (r["record_type"], r["refers_to"]) == ("revisit" if refers else "response", refers)
        if not refers:
            assert bytes(r["payload"]) == raw
        assert r["url"] == (url.replace("\r", "%0D").replace("\n", "%0A") if url else None)


def test_files_are_plain_gzip(spark):
    folder = new_path(spark, "test-warc")
    files = W.write_warc(W.decide(spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)), folder).collect()
    assert sum(f["records"] for f in files) == len(PAGES)
    raw = b"".join(gzip.decompress(open(f["path"], "rb").read()) for f in files)
    assert raw.count(b"WARC-Record-ID") == len(PAGES) and raw.startswith(b"WARC/1.1\r\n")


def test_false_magic_is_skipped():
    import io

    one, two = W.gzip_member(W.record(1, "u", b"a", None)), W.gzip_member(W.record(2, "u", b"b", None))
    data = W.MAGIC + b"junk" + one + W.gzip_member(b"no record") + two
    found = [W.parse_record(r)["headers"]["x-page"] for _, r in W.members(io.BytesIO(data), 0, len(data))]
    assert found == ["1", "2"]
    second = data.index(two)
    assert [W.parse_record(r)["headers"]["x-page"] for _, r in W.members(io.BytesIO(data), second, len(data))] == ["2"]
    assert list(W.members(io.BytesIO(data), second + 1, len(data))) == []


def test_least_payload(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    assert {r["page_id"]: r["refers_to"] for r in W.decide(pages, 3).collect()} == {1: None, 2: None, 3: None, 4: 3}


def test_archives_of_other_tools(spark, tmp_path):
    """Records of all types, with headers that ours never lack or have."""
    def rec(kind, block, *headers):
        return gzip.compress("\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", *headers, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>x</p>"
    whole = "Content-Type: application/http; msgtype=response"
    data = [
        rec("warcinfo", b"software: y\r\n", "Content-Type: application/warc-fields"),
        rec("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "WARC-Target-URI: http://a/", "Content-Type: application/http; msgtype=request"),
        rec("response", http, "WARC-Target-URI: http://a/", whole, "WARC-Payload-Digest: sha1:ANOTHERDIGEST"),
        rec("metadata", b"fetchTimeMs: 3\r\n\r\nmore", "WARC-Target-URI:", "\thttp://a/"),
        rec("revisit", b"HTTP/1.1 304 Not Modified\r\n\r\n", whole, "WARC-Payload-Digest: sha1:ABC"),
        rec("resource", b"plain"),
    ]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(data))
    files = spark.createDataFrame([(str(tmp_path / "x.warc.gz"), sum(map(len, data)))], "path string, bytes long")
    got = W.read_warc(files, f"file://{tmp_path}", 64, with_payload=True).orderBy("offset").collect()
    assert [r["record_type"] for r in got] == ["warcinfo", "request", "response", "metadata", "revisit", "resource"]
    assert [bytes(r["payload"]) for r in got] == [b"software: y\r\n", b"", b"<p>x</p>", b"fetchTimeMs: 3\r\n\r\nmore", b"", b"plain"]
    assert got[2]["payload_digest"] == W.digest32(b"<p>x</p>") and got[4]["payload_digest"] == "ABC"
    assert [r["payload_bytes"] for r in got] == [13, 0, 8, 22, None, 5]
    assert got[3]["url"] == "http://a/" and {r["page_id"] for r in got} == {None}


def test_a_changed_payload_of_ours_is_found(spark, tmp_path):
    raw = W.record(1, "u", b"right", None).replace(b"right", b"wrong")
    (tmp_path / "x.warc.gz").write_bytes(W.gzip_member(raw))
    with pytest.raises(ValueError, match="digest"):
        W.described(W.parse_record(raw), "x")
