import hashlib
import io

from packwright.llm.arc_warc import Archives, ArcRecord, arc_entry, arc_head, archive_round_trip, convert_arcs, open_archive, read_arc, read_warc, warc_date, warc_record
from packwright.llm.files import new_folder, write_whole


def expected(rows, least=100):
    sizes = {}
    for i, _, html in rows:
        data = (html or "").encode()
        if len(data) >= least and i is not None:
            sizes.setdefault(data, []).append(i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        first = min(sizes[data]) if data in sizes and i is not None else i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if i == first else "revisit", None if i == first else first))
    return sorted(out, key=str)


LONG = "é" * 80
ROWS = [(1, "http://a.test/ b", LONG), (2, None, LONG), (3, "http://c.test/", None), (4, "", "short"), (5, "http://d.test/", "short"), (7, "http://e.test/", "x" * 100), (6, "http://f.test/", "x" * 100), (6, "http://f.test/", "x" * 100), (None, "http://g.test/", LONG), (8, "http://h.test/", "\r\n\r\nHTTP/1.1 " * 9000), (9, "http://i.test/", "y" * 99), (10, "http://j.test/", "y" * 99)]


def test_round_trip(spark):
    pages = spark.createDataFrame([(*r, "clash") for r in ROWS], "page_id long, url string, html string, record_type string").repartition(3)
    got = sorted((tuple(r) for r in archive_round_trip(pages, Archives(roll_bytes=5000)).collect()), key=str)
    assert got == expected(ROWS)
    assert archive_round_trip(pages.limit(0)).count() == 0


def test_hot_payload(spark):
    rows = [(i, f"http://x.test/{i}", LONG if i % 3 == 0 else f"{i} " * 60) for i in range(1, 300)]
    got = sorted((tuple(r) for r in archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)).collect()), key=str)
    assert got == expected(rows)


def test_both_versions_read_the_same():
    for version in (1, 2):
        data = arc_head("f.arc", version, Archives()) + arc_entry(5, "http://a.test/x", "<p>ü</p>", version, 0, "f.arc", Archives())
        records = list(read_arc(io.BytesIO(data)))
        assert [r.number for r in records] == [0, 1]
        assert (records[1].url, records[1].date, records[1].mime, records[1].page_id, records[1].split()[1]) == ("http://a.test/x", "20240101000000", "text/html", 5, "<p>ü</p>".encode())


def test_foreign_archive(spark):
    """An archive of another origin: a URL with a space, a DNS record, no trailing newline, plain bytes."""
    block = b"1 0 Other\nURL IP-address Archive-date Content-type Archive-length\n\n"
    body = b"HTTP/1.0 200 OK\r\n\r\nhello"
    data = b"filedesc://o.arc 0.0.0.0 19970102030405 text/plain %d\n" % len(block) + block
    data += b"\ndns:a.test 1.2.3.4 19970102030406 text/dns 4\nabcd\nhttp://a.test/x y 1.2.3.4 199701020304 text/html %d\n" % len(body) + body
    folder = new_folder(spark, "foreign")
    write_whole(f"{folder}/o.arc", [data])
    warc = convert_arcs(spark.createDataFrame([(f"{folder}/o.arc",)], "path string"), f"{folder}/warc").first()
    assert warc["n"] == 2
    kinds = [(f["WARC-Type"], f.get("WARC-Target-URI"), f["WARC-Date"], len(b)) for f, b in read_warc(open_archive(warc["path"]))]
    assert kinds[1:] == [("resource", "dns:a.test", "1997-01-02T03:04:06Z", 4), ("response", "http://a.test/x y", "1997-01-02T03:04:00Z", len(body))] and kinds[0][0] == "warcinfo"


def test_truncated_archive_is_reported():
    data = arc_head("f.arc", 1, Archives()) + arc_entry(5, "http://a.test/", "abc", 1, 0, "f.arc", Archives())[:-1]
    try:
        list(read_arc(io.BytesIO(data)))
    except ValueError as e:
        assert "ends after" in str(e)
    else:
        raise AssertionError


def test_record_fields():
    record = ArcRecord(1, "http://a.test/", "1.2.3.4", "20010203040506", "text/html", b"HTTP/1.1 200 OK\r\nX-Page-Id: 9\r\n\r\nbody")
    ((fields, block),) = read_warc(io.BytesIO(warc_record(record, (3, "http://b.test/"))))
    assert fields["WARC-Type"] == "revisit" and fields["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(b"body").hexdigest() and block.endswith(b"\r\n\r\n")
    assert fields == read_warc(io.BytesIO(warc_record(record, (3, "http://b.test/")))).__next__()[0]
    assert warc_date("199701") == "1997-01-01T00:00:00Z" and warc_date("19970102") == "1997-01-02T00:00:00Z"
    assert warc_date("2024") == "2024-01-01T00:00:00Z" and warc_date("20240000000000") == "2024-01-01T00:00:00Z"


def test_heads_that_end_with_a_plain_line_feed():
    for head in (b"HTTP/1.0 200 OK\nServer: x\n\n", b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\n", b"HTTP/1.0 200 OK\nServer: x\r\n\n"):
        record = ArcRecord(1, "http://a.test/", "1.2.3.4", "2001", "text/html", head + b"<p>\r\n\r\nbody\n\n")
        assert record.split() == (head, b"<p>\r\n\r\nbody\n\n")
        ((fields, block),) = read_warc(io.BytesIO(warc_record(record)))
        assert fields["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(b"<p>\r\n\r\nbody\n\n").hexdigest() and block == record.body
