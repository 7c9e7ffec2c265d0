import gzip
import hashlib

import pytest

from shoal.llm.arc_to_warc import (arc_record, pages_through_warc, read_arc, read_warc_records, record_id, split_http, version_block,
                                   warc_date, warc_record)

SCHEMA = "page_id long, url string, html string, archive string, record string, page string"


def table(spark, rows):
    return spark.createDataFrame([(i, u, h, "a", "r", "p") for i, u, h in rows], SCHEMA)


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("packed", [False, True])
def test_arc_round_trip(version, packed):
    bodies = [b"", b"plain", b"lines\n\nand URL 0.0.0.0 lines 12\n", "naïve 日本".encode(), b"\r\n\r\n", b"x" * 100000]
    data = version_block(version, "a.arc", "19990101000000") + b"\n"
    for k, b in enumerate(bodies):
        data += arc_record(f"http://e.org/a b/{k}\n", k, b, version, "20010203040506", "a.arc", len(data)) + b"\n"
    got = list(read_arc(gzip.compress(data) if packed else data))
    assert [split_http(doc)[1] for _, _, doc in got] == bodies
    assert [p for p, _, _ in got] == [1, 2, 3, 4, 5, 6]
    assert got[0][1]["URL"] == "http://e.org/a%20b/0%0A" and got[0][1]["Archive-date"] == "20010203040506"
    with pytest.raises(ValueError):
        list(read_arc(data[:-50]))


def test_warc_record_round_trip():
    fields = {"URL": "http://e.org/", "Archive-date": "2001020304", "Content-type": "text/html", "IP-address": "1.2.3.4"}
    head, body = b"HTTP/1.0 200 OK\r\nContent-Length: 3\r\n\r\n", b"abc"
    digest = hashlib.sha256(body).hexdigest()
    rid = record_id(1, 2, fields, digest)
    assert rid == record_id(1, 2, dict(fields), digest) and rid != record_id(1, 3, fields, digest)
    data = b"".join(warc_record(fields, rid, digest, head, b, r) + b"\r\n\r\n" for b, r in ((body, None), (body, ("7", "id"))))
    (f, block), (g, again) = read_warc_records(data)
    assert block == head + body and f["warc-type"] == "response" and f["warc-date"] == "2001-02-03T04:00:00Z"
    assert f["warc-ip-address"] == "1.2.3.4" and f["warc-target-uri"] == "http://e.org/"
    assert again == head and g["warc-type"] == "revisit" and g["warc-refers-to"] == "<urn:uuid:id>"
    assert warc_date("20010203040506") == "2001-02-03T04:05:06Z"


def test_pages(spark):
    same = "<p>" + "same payload " * 20 + "</p>"
    rows = [(1, "http://a", "<p>one</p>"), (2, "http://b", None), (3, None, ""), (9, "http://c", same), (5, "http://d", same), (7, "", same),
            (None, "http://e", same), (4, "u", "short"), (6, "u", "short"), (8, "http://日本", "naïve \r\n\r\nWARC/1.1\r\n " * 30),
            (10, "x", "y" * 300000), (11, "x", "z" * 100), (12, "x", "z" * 100), (12, "x", "z" * 100), (13, "x", "é" * 49 + "a"), (14, "x", "é" * 49 + "a")]
    got = pages_through_warc(table(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    for i, _, h in rows:
        b = (h or "").encode()
        assert all((r.payload_bytes, r.payload_digest) == (len(b), hashlib.sha256(b).hexdigest()) for r in by[i])
    assert by[5][0].record_type == "response" and by[5][0].refers_to is None
    assert {(r.record_type, r.refers_to) for k in (9, 7, None) for r in by[k]} == {("revisit", 5)}
    assert {r.record_type for k in (4, 6, 13, 14) for r in by[k]} == {"response"}
    assert by[11][0].record_type == "response" and sorted(r.record_type for r in by[12]) == ["revisit"] * 2
    assert len({r.record_id for r in got}) == len(rows)
    assert pages_through_warc(table(spark, [])).count() == 0
