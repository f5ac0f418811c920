import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from bandlake.llm.arc_to_warc import ArcRecord, arc_files, arc_round_trip, convert_archives, gzip_member, read_arc, read_archives, read_arcs, read_warc, warc_record, write_arc, write_archives


@given(st.lists(st.tuples(st.text("abc/:?é", min_size=1), st.binary(max_size=60)), max_size=6), st.sampled_from([1, 2]))
def test_arc_round_trip_of_either_version(items, version):
    records = [ArcRecord(f"http://{u}", "1.2.3.4", "20010203040506", "text/html", d, "404" if version == 2 else "") for u, d in items]
    arc = write_arc(records, version)
    assert list(read_arc(arc)) == records == list(read_arc(gzip_member(arc[:40]) + gzip_member(arc[40:])))


def test_bad_archives():
    good = write_arc([ArcRecord("http://a", "1.1.1.1", "20010203040506", "text/html", b"xyz")], 1)
    for bad in (b"", b"junk", good[:-3], good.replace(b"Archive-date", b"Archive-time"), good.replace(b"html 3", b"html x")):
        with pytest.raises(ValueError):
            list(read_arc(bad))


def test_records():
    r = ArcRecord("http://a", "1.1.1.1", "2001", "text/html", b"HTTP/1.1 200 OK\r\n\r\npay", "203")
    (h, block), (g, none) = read_warc(gzip_member(warc_record(r, 5)) + gzip_member(warc_record(r, 9, 5)))
    assert h["warc-type"] == "response" and block == r.document and h["warc-date"] == "2001-01-01T00:00:00Z"
    assert g["warc-type"] == "revisit" and none == b"HTTP/1.1 200 OK\r\n\r\n" and g["warc-refers-to"] == h["warc-record-id"]
    assert h["warc-payload-digest"] == "sha256:" + hashlib.sha256(b"pay").hexdigest() == g["warc-payload-digest"]
    assert h["x-arc-result-code"] == "203" and g["x-refers-to-page-id"] == "5"


def test_pages(spark):
    long = "é" * 60
    rows = [(3, "http://x", long, 1), (1, "http://y z", long, 2), (2, None, None, 3), (4, "u", "", 4), (5, "u", "é" * 49 + "a", 5), (6, "u", "é" * 49 + "a", 6), (7, "u", "z" * 300000, 7), (8, "u", long, 8), (8, "u", long, 8), (1, "http://y z", long, 2)]
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in arc_round_trip(spark, spark.createDataFrame(rows, "page_id long, url string, html string, date int")).collect())
    assert got == [(1, 120, "response", None)] * 2 + [(2, 0, "response", None), (3, 120, "revisit", 1), (4, 0, "response", None), (5, 99, "response", None), (6, 99, "response", None), (7, 300000, "response", None)] + [(8, 120, "revisit", 1)] * 2
    assert arc_round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_repeated_null_and_large_ids(spark):
    p, q, u, big = "p" * 150, "q" * 150, "u" * 240, (1 << 60) + 7
    rows = [(1, p), (2, q), (5, p), (5, u), (6, p), (6, q), (None, p), (None, "n" * 120), (None, "n" * 120), (0, "z" * 130), (big, p), (-big, "m" * 110), (big, "m" * 110), (-(1 << 63), "w" * 101), ((1 << 63) - 1, "w" * 101)]
    found = arc_round_trip(spark, spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string")).collect()
    low = {h: min((i for i, x in rows if x == h and i is not None), default=None) for _, h in rows}
    want = sorted(((i, hashlib.sha256(h.encode()).hexdigest(), "response" if low[h] is None or i == low[h] else "revisit", None if i == low[h] else low[h]) for i, h in rows), key=str)
    assert sorted(((r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in found), key=str) == want
    # every payload is in one record at least
    assert {r.stored_digest for r in found} - {None} == {hashlib.sha256(h.encode()).hexdigest() for _, h in rows}


def test_files_of_a_folder(spark, tmp_path):
    same = b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\n" + b"s" * 200
    one = [ArcRecord("http://a/1", "1.1.1.1", "19990101", "text/html", same), ArcRecord("http://a/2", "1.1.1.1", "19990102000000", "image/png", b"\x00\nraw\n\n")]
    two = [ArcRecord("http://b/1", "2.2.2.2", "20000101000000", "text/html", same.replace(b"1.0 200", b"1.0 404"), "404")]
    (tmp_path / "one.arc").write_bytes(write_arc(one, 1))
    (tmp_path / "two.arc.gz").write_bytes(gzip_member(write_arc(two, 2)))
    (tmp_path / "notes.txt").write_bytes(b"no archive")
    files = arc_files(spark, str(tmp_path))
    assert sorted((r.url, r.code, bytes(r.document)) for r in read_arcs(files).collect()) == sorted((r.url, r.code, r.document) for r in one + two)
    found = {r.url: r for r in read_archives(write_archives(convert_archives(files, number=True), str(tmp_path / "warc"))).collect()}
    assert sorted(r.record_type for r in found.values()) == ["resource", "response", "revisit"] and found["http://a/2"].record_type == "resource"
    a, b = found["http://a/1"], found["http://b/1"]
    assert {a.refers_to, b.refers_to} == {None, min(a.page_id, b.page_id)} and a.payload_digest == b.payload_digest and b.date == "2000-01-01T00:00:00Z"


def test_foreign_archives(spark, tmp_path):
    """Heads with bare line ends, content types and URLs with blanks, and headers of the kind this library writes with other values."""
    page = b"<html>" + b"x" * 150
    heads = [b"HTTP/1.0 200 OK\nServer: x\n\n", b"HTTP/1.0 200 OK\r\nX-Page-ID: home\r\nX-Bandlake-Page-ID: home\r\n\r\n", b"HTTP/1.0 200 OK\r\nX-Bandlake-Page-ID: 99999999999999999999\r\n\n", b"HTTP/1.0 200 OK\r\nX-Page-ID: 7\r\n\r\n"]
    records = [ArcRecord(f"http://a/{i} b 5.6.7.8 x", "1.2.3.4" if i else "2001:db8::1", "20010203040506", "text/html; charset=x", h + page + bytes([65 + i]), "200") for i, h in enumerate(heads)]
    for version in (1, 2):
        (tmp_path / f"v{version}.arc").write_bytes(write_arc(records, version))
    got = list(read_arc((tmp_path / "v1.arc").read_bytes()))
    assert [(r.url, r.ip, r.date, r.content_type, r.document) for r in got] == [(r.url, r.ip, r.date, r.content_type, r.document) for r in records]
    assert list(read_arc((tmp_path / "v2.arc").read_bytes())) == records
    rows = read_archives(write_archives(convert_archives(arc_files(spark, str(tmp_path)), number=True), str(tmp_path / "warc"))).collect()
    assert len(rows) == 8 and {r.payload_digest for r in rows} == {hashlib.sha256(page + bytes([65 + i])).hexdigest() for i in range(4)}
    assert {r.payload_bytes for r in rows} == {len(page) + 1} and sorted(r.record_type for r in rows) == ["response"] * 4 + ["revisit"] * 4
    plain = read_arcs(arc_files(spark, str(tmp_path))).collect()
    assert {r.page_id for r in plain} == {None}


def test_written_archives_can_be_deleted(spark):
    from bandlake.llm.components import delete_written

    delete_written(spark)
    assert arc_round_trip(spark, spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string")).count() == 1
    assert delete_written(spark) == 4
