"""WARC round trip and the splittable reader."""

from __future__ import annotations

import gzip
import io
import random
import zlib

import pytest

from bedcensus.llm import warc as W
from bedcensus.session import scratch_path
from compare import assert_same
from oracle_check import duck

SF = "/root/testdata/sf0.01"


def test_query_equals_sql(spark):
    assert_same(W.op5_warc(spark, SF), duck(SF), W.OP5_SQL, "op5")


def test_round_trip_of_payloads(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r["page_id"]: (r["url"], r["html"]) for r in pages.collect()}
    rows = W.archive_pages(pages, scratch_path(spark, "t-warc"), range_bytes=4096).collect()
    assert len(rows) == len(want)
    for r in rows:
        url, html = want[r["page_id"]]
        assert r["url"] == url and r["payload_bytes"] == len(html.encode())
        if r["record_type"] == "response":
            assert r["html"] == html
        else:
            assert want[r["refers_to"]][1] == html and r["refers_to"] > r["page_id"]


@pytest.mark.parametrize("step", [1, 7, 100, 10_000])
def test_ranges_own_each_record_once(step):
    rng = random.Random(step)
    decoy = W.MAGIC + b"\x00" * 7  # magic that decodes to nothing
    fake = gzip.compress(b"not a record")
    data, starts = b"", []
    for i in range(12):
        starts.append(len(data))
        noise = bytes(rng.randrange(256) for _ in range(300)) + decoy + W.MAGIC * 3
        head = f"WARC/1.1\r\nWARC-Type: resource\r\nX-N: {i}\r\nContent-Length: {len(noise)}\r\n\r\n".encode()
        z = zlib.compressobj(0, zlib.DEFLATED, 31)  # stored: the decoys stay visible
        data += z.compress(head + noise + b"\r\n\r\n") + z.flush() + (fake if i % 3 == 0 else b"")
    got = [
        (at, fields["x-n"])
        for a in range(0, len(data), step)
        for at, fields, _ in W.records_in_range(io.BytesIO(data), len(data), a, min(a + step, len(data)))
    ]
    assert got == [(s, str(i)) for i, s in enumerate(starts)]


def test_small_read_buffer(monkeypatch):
    monkeypatch.setattr(W, "READ_BYTES", 5)
    member = W.make_record(3, "u\r\nx", "päyload" * 50, "00" * 20, "response", None)
    data = member * 4
    got = list(W.records_in_range(io.BytesIO(data), len(data), 0, len(data)))
    assert [at for at, _, _ in got] == [len(member) * i for i in range(4)]
    assert got[0][1]["warc-target-uri"] == "u%0D%0Ax"


def test_archives_are_plain_gzip():
    record = W.make_record(1, None, "x", "00" * 20, "revisit", 5)
    text = gzip.decompress(record)
    assert text.startswith(b"WARC/1.1\r\n") and b"WARC-Refers-To: <urn:x-page:5:" in text and text.endswith(b"\r\n\r\n\r\n\r\n")


def test_edges(spark):
    big, other = "é" * 600, "z" * 1000
    pages = spark.createDataFrame(
        [(1, "a", big, 0), (2, "b", big, 0), (2, "b2", big, 0), (None, "c", big, 0), (3, None, None, 0), (4, "d", "", 0), (5, "e", "x", 0), (6, "f", "x", 0), (None, "g", other, 0), (None, "h", other, 0), (7, "i", "y" * 999, 0), (8, "j", "y" * 999, 0)],
        "page_id bigint, url string, html string, Record_Type int",
    )
    rows = W.archive_pages(pages, scratch_path(spark, "t-warc")).collect()
    got = {(r["page_id"], r["url"]): (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in rows}
    assert len(rows) == 12
    assert got[1, "a"] == (1200, "revisit", 2) and got[None, "c"] == (1200, "revisit", 2)
    assert got[2, "b"] == got[2, "b2"] == (1200, "response", None)
    assert got[3, None] == (0, "response", None)
    assert all(got[k][1] == "response" for k in [(5, "e"), (6, "f"), (None, "g"), (None, "h"), (7, "i"), (8, "j")])
    assert W.archive_pages(pages.limit(0), scratch_path(spark, "t-warc")).count() == 0


def records(data):
    return [f["warc-record-id"] for _, f, _ in W.records_in_range(io.BytesIO(data), len(data), 0, len(data))]


def test_candidates_are_checked_by_their_headers():
    good = [W.make_record(i, "u", "text " * 40, "00" * 20, "response", None) for i in range(3)]
    odd = [b"WARC/ as text", b"WARC/1.1\r\nno blank line", b"WARC/1.1\r\nWARC-Type: x\r\nContent-Length: 99\r\n\r\nshort", b"WARC/1.1\r\nWARC-Type: x\r\nContent-Length: -1\r\n\r\n", b"WARC/1.1\r\nContent-Length: 0\r\n\r\n"]
    data = b"".join(g + gzip.compress(o) for g, o in zip(good, odd)) + b"".join(map(gzip.compress, odd[3:]))
    assert records(data) == records(b"".join(good)) and len(records(data)) == 3


def test_a_cut_off_record_is_an_error():
    member = W.make_record(1, "u", "some text " * 40, "00" * 20, "response", None)
    with pytest.raises(ValueError, match="ends inside the record at offset"):
        records(member + member[:-9])


def test_page_ids_are_integers(spark):
    pages = spark.createDataFrame([("a", "u", "x")], "page_id string, url string, html string")
    with pytest.raises(TypeError, match="page_id must be an integer"):
        W.archive_pages(pages, scratch_path(spark, "t-warc"))
