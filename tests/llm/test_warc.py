import base64
import hashlib

import pytest

from wattlink.llm import warc as W

HTML = ["<p>é漢🙂</p>" * 50, "", None, "plain", "plain", "<pre>" + W.END + W.VERSION + W.CRLF + "WARC-Type: response" + W.END + "x</pre>",
        "\r\n\r\n", "0\r\n\r\n", "plain", "y" * 5000, W.END + W.VERSION + W.CRLF]
SCHEMA = "page_id long, url string, html string, payload string"


def pages(spark):
    rows = [(i * 2, f"http://h/{i}\r\n x", h, "mine") for i, h in enumerate(HTML)] + [(None, None, "plain", None), (None, "u", "alone", None)]
    return spark.createDataFrame(rows, SCHEMA)


def b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.mark.parametrize("options", [{}, {"chunk_bytes": 7, "segment_bytes": 100}, {"chunk_bytes": 1000, "segment_bytes": 33}])
@pytest.mark.parametrize("split", [1 << 27, 900])
def test_round_trip(spark, options, split):
    path = W.write(pages(spark).coalesce(2), **options)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        raw = {r["page_id"]: r for r in W.read(spark, path).where("page_id IS NOT NULL").collect()}
        got = W.page_records(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert len(got) == len(HTML) + 2
    first = {}
    for i, h in enumerate(HTML):
        first.setdefault(h or "", i * 2)
    named = {r["page_id"]: r for r in got if r["page_id"] is not None}
    for i, h in enumerate(HTML):
        r, page_id = named[i * 2], i * 2
        own = first[h or ""] == page_id
        assert (r["payload_bytes"], r["payload_digest"]) == (len((h or "").encode()), b32(h))
        assert (r["record_type"], r["refers_to"]) == (("response", None) if own else ("revisit", first[h or ""]))
        assert raw[page_id]["complete"] and (raw[page_id]["payload"] == (h or "").encode() if own else raw[page_id]["payload"] is None)
        assert raw[page_id]["verified"] or not own
    nameless = sorted((r["record_type"], r["refers_to"], r["payload_digest"]) for r in got if r["page_id"] is None and r["record_type"] == "response")
    assert (len(nameless), [r["record_type"] for r in got if r["page_id"] is None].count("response")) in {(1, 1), (2, 2)}


def test_lost_and_wrong_segments_are_not_accepted(spark, tmp_path):
    def record(number, body, total=None, origin="<urn:a>", declared=None):
        lines = ["WARC/1.1", f"WARC-Type: {'response' if number == 1 else 'continuation'}", f"WARC-Record-ID: {origin if number == 1 else f'<urn:a:{number}>'}",
                 f"WARC-Segment-Number: {number}"]
        lines += [f"WARC-Segment-Origin-ID: {origin}"] if number > 1 else []
        lines += [f"WARC-Segment-Total-Length: {total}"] if total is not None else []
        return "\r\n".join([*lines, f"Content-Length: {len(body)}"]) + "\r\n\r\n" + body + "\r\n\r\n"

    head = "HTTP/1.1 200 OK\r\n\r\n"
    n = len(head)
    text = record(2, "cd", n + 6, "<urn:x>") + record(1, head + "ab", origin="<urn:x>") + record(3, "ef", n + 6, "<urn:x>")
    text += record(1, head, origin="<urn:lost>") + record(3, "b", n + 2, "<urn:lost>") + record(1, head, origin="<urn:short>") + record(2, "b", 99, "<urn:short>")
    (tmp_path / "a.warc").write_bytes(text.encode())
    got = {r["record_id"]: r for r in W.read(spark, str(tmp_path)).collect()}
    assert got["<urn:x>"]["complete"] and got["<urn:x>"]["payload"] == b"abcdef"
    for lost in ("<urn:lost>", "<urn:short>"):
        assert not got[lost]["complete"] and got[lost]["payload"] is None


def test_broken_chunks():
    assert W.dechunked(b"3\r\nabc\r\n2;x=1\r\nde\r\n0\r\n\r\n") == b"abcde"
    for bad in (b"", b"zz\r\n", b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabc\r\n", b"-1\r\na\r\n0\r\n\r\n"):
        assert W.dechunked(bad) is None


def test_empty_table(spark):
    assert W.page_records(spark, W.write(pages(spark).limit(0))).count() == 0
