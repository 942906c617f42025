"""ARC to WARC: parsing of both versions, the round trip, revisits, odd rows."""

import hashlib

from edgeloom.llm import archives as ar


def test_parse_both_versions():
    for version in (1, 2):
        data = ar.arc_head(version, "x.arc", "20010203") + ar.arc_record(version, "http://a/b c", "1.2.3.4", "20010203040506", "text/html", b"HTTP/1.0 200 OK\r\n\r\nbody\nmore")
        data += ar.arc_record(version, "http://d", "1.2.3.4", "2001", "text/plain", b"")
        got = list(ar.parse_arc(data))
        assert [r["URL"] for r in got] == ["http://a/b%20c", "http://d"]
        assert ar.split_http(got[0]["block"]) == (b"HTTP/1.0 200 OK\r\n\r\n", b"body\nmore")
        assert got[0]["Archive-date"] == "20010203040506" and got[1]["block"] == b""
        assert len(list(ar.parse_arc(data[:-5]))) >= 1  # a cut file keeps what is complete
    assert list(ar.parse_arc(b"nonsense")) == [] and list(ar.parse_arc(b"")) == []


def test_parse_line_with_spaces_and_no_head():
    line = b"http://a/b c 1.2.3.4 20010203040506 text/html 4\nabcd\n"
    got = list(ar.parse_arc(ar.arc_head(1, "x", "2001") + line))
    assert (got[0]["URL"], got[0]["block"]) == ("http://a/b c", b"abcd")


def test_dates():
    assert ar.iso_date("20010203040506") == "2001-02-03T04:05:06Z"
    assert ar.iso_date("2001") == "2001-01-01T00:00:00Z"


def test_round_trip(spark):
    big, other = "é" * 700, "x" * 1000
    rows = [(1, "http://a/", big), (2, "http://b/", big), (7, None, big), (3, "u v", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""),
            (8, "w", other), (8, "w", other), (9, "w", "x" * 999), (10, "w", "x" * 999), (None, "n", big), (11, "z", "WARC/1.0\r\n\r\n" * 200 + "\n\n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'q' as digest").repartition(3)
    got = sorted((tuple(r) for r in ar.page_archive(df).collect()), key=str)
    want = []
    for k, _, t in rows:
        data = (t or "").encode()
        same = [a for a, _, b in rows if b == t and a is not None]
        revisit = k is not None and len(data) >= 1000 and k < max(same)
        want.append((k, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None))
    assert got == sorted(want, key=str)
    assert ar.page_archive(df.limit(0)).count() == 0


def test_records_are_repeatable_and_complete(spark):
    df = spark.createDataFrame([(1, "http://a/", "text " * 300)], "page_id long, url string, html string")
    a, b = (ar.convert(ar.pages_as_arc(df)).collect() for _ in range(2))
    assert a == b and a[0].record_id.startswith("<urn:uuid:")
    head, block = next(ar.parse_warc(ar.warc_record(a[0].url, a[0].ip, a[0].date, bytes(a[0].http), bytes(a[0].payload), a[0].record_id, None, "1")))
    assert ar.header(head, "WARC-Type") == "response" and block.endswith(b"text ")


def test_files_are_bounded_by_bytes(spark, tmp_path):
    rows = [(k, f"http://h/{k}", chr(97 + k % 26) * 3000) for k in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = str(tmp_path / "w")
    ar.write_warc(ar.with_revisits(ar.convert(ar.pages_as_arc(df))).coalesce(1), path, file_bytes=30_000)
    files = spark.read.format("binaryFile").load(path).collect()
    sizes = [sum(len(h) + len(b) for h, b in ar.parse_warc(bytes(f.content))) for f in files]
    assert len(files) >= 4 and max(sizes) <= 30_000
    back = ar.read_warc(spark, path).collect()
    assert sorted(r.page_id for r in back) == list(range(40))
    ar.write_warc(ar.with_revisits(ar.convert(ar.pages_as_arc(df))), path + "2", file_bytes=10)
    assert ar.read_warc(spark, path + "2").count() == 40
