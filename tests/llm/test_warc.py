"""WARC derivatives: round trips, links and edge cases."""

import gzip
import json

from splatlake.llm import warc
from splatlake.llm.htmltext import default_model

PAGE = b"<html><head><title>T &amp; t</title></head><body><nav><a href='/m'>Menu</a></nav><article><h1>Head line of it</h1><p>Some words that stand here for a text, and more of them.</p><p>And a second block of words, which ends here.</p></article><footer>&copy; x</footer></body></html>"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nX-Y: z\r\n\r\n"


def test_files(spark, tmp_path):
    source = {"WARC-Type": "response", "WARC-Record-ID": "<urn:uuid:1>", "WARC-Target-URI": "http://a/", "WARC-Date": "2020-01-01T00:00:00Z", "Content-Length": str(len(HTTP + PAGE))}
    other = {"WARC-Type": "request", "WARC-Record-ID": "<urn:uuid:2>", "Content-Length": "3"}
    plain = warc.serialize(other, b"GET") + warc.serialize(source, HTTP + PAGE)
    (tmp_path / "a.warc").write_bytes(plain)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(warc.serialize(other, b"GET")) + gzip.compress(warc.serialize(source, HTTP + PAGE)))
    (tmp_path / "c.warc").write_bytes(plain[:-40])
    rows = warc.read_warc(spark, str(tmp_path / "[ab].warc*"))
    assert rows.count() == 4 and [dict(r["headers"])["WARC-Type"] for r in warc.read_warc(spark, str(tmp_path / "c.warc")).collect()] == ["request", "unreadable"]
    out = [(dict(r["headers"]), bytes(r["content"])) for r in warc.build(rows).collect()]
    assert len(out) == 4 and len({h["WARC-Record-ID"] for h, _ in out}) == 2
    for h, content in out:
        assert h["WARC-Refers-To"] == "<urn:uuid:1>" and h["WARC-Block-Digest"] == warc.digest(content) and int(h["Content-Length"]) == len(content)
        assert list(warc.parse_records(warc.serialize(h, content))) == [(h, content)]
    kinds = {h["WARC-Type"]: (h, c) for h, c in out}
    assert kinds["metadata"][0]["WARC-Concurrent-To"] == kinds["conversion"][0]["WARC-Record-ID"]
    meta = json.loads(kinds["metadata"][1])
    assert meta["HTML-Metadata"] == {"Title": "T & t", "Links": [{"path": "a@/href", "url": "/m"}]} and ["X-Y", "z"] in meta["HTTP-Response-Metadata"]["Headers"]
    assert meta["Envelope"]["WARC-Header-Metadata"] == source and kinds["conversion"][1].decode().startswith("Head line of it\n\nSome words")


def test_edges(spark):
    model = default_model()
    for content in (b"", b"no header", HTTP, HTTP + b"\xff\xfe<p", b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89PNG", HTTP.replace(b"html", b"html; charset=nope") + PAGE):
        meta, text = warc.derive_all([({"WARC-Type": "response"}, content)], model)
        assert meta[0]["WARC-Type"] == "metadata" and text[0]["WARC-Type"] == "conversion" and json.loads(meta[1])
    rows = spark.createDataFrame([({"WARC-Type": "response"}, None), (None, b"x"), ({"WARC-Type": "response"}, bytearray(HTTP + PAGE))], warc.SCHEMA)
    assert warc.build(rows, model).count() == 4 and warc.build(rows.where("false"), model).count() == 0
    pages = spark.createDataFrame([(1, "http://a", PAGE.decode(), 7), (2, None, None, 7)], "page_id long, url string, html string, headers int")
    out = warc.build(warc.pages_as_responses(pages), model).collect()
    assert sorted(dict(r["headers"])["X-Page-ID"] for r in out) == ["1", "1", "2", "2"]
