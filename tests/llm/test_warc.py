import gzip
import hashlib

import pytest

from cohortfold.llm import queries, warc
from cohortfold.llm.shared import Scratch

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string"


def write(spark, rows, schema=SCHEMA, **options):
    path = Scratch(spark).path("archives")
    warc.write_archives(spark.createDataFrame(rows, schema), path, **options)
    return path


def expected(rows, least=1000):
    """page_id, bytes, digest, type, refers_to of each row, in plain Python."""
    told = [(page, (html or "").encode()) for page, _, html, *_ in rows]
    largest = {}
    for page, data in told:
        if len(data) >= least:
            largest[data] = max(largest.get(data, -1), -1 if page is None else page)
    out, seen = [], set()
    for page, data in told:
        kept = largest.get(data)
        is_kept = kept is None or (-1 if page is None else page) == kept and (kept, data) not in seen
        if kept is not None and is_kept:
            seen.add((kept, data))
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "response" if is_kept else "revisit", None if is_kept or kept == -1 else kept))
    return sorted(out, key=repr)


def result(spark, path):
    rows = warc.resolved(warc.read_archives(spark, path)).collect()
    assert all(r["status"] == "ok" for r in rows)
    whole = lambda v: None if v is None else int(v)
    return sorted([(whole(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], whole(r["refers_to"])) for r in rows], key=repr)


def test_query_against_plain_python(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    found = sorted([tuple(r) for r in queries.op13_warc(spark, SF).collect()], key=repr)
    assert found == expected(rows)


def test_copies_nulls_and_marks(spark):
    long = "é" * 600 + "\r\n\r\n"
    rows = [(i, f"http://a.b/{i}", long) for i in range(40)] + [(i, "u", "short") for i in range(50, 53)]
    rows += [(60, None, None), (61, "http://x/ \r\nWARC-Type: y", ""), (None, "u", "z" * 2000), (62, "u", "y" * 2000), (63, "u", "y" * 2000), (63, "u", "y" * 2000)]
    rows += [(70, "u", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 30), (71, "u", "WARC/1.0\r\n" * 300 + "0\r\n\r\n")]
    rows += [(80, "u", "w" * 100_000), (81, "u", "".join(map(chr, range(1, 3000))) + "\U0001f600")]
    assert result(spark, write(spark, rows, segment_bytes=700, chunk_bytes=64)) == expected(rows)
    assert result(spark, write(spark, rows)) == expected(rows)


def test_null_ids_among_copies(spark):
    rows = [(None, "u", "q" * 1500), (None, "u", "q" * 1500)]
    assert result(spark, write(spark, rows)) == expected(rows)
    rows.append((5, "u", "q" * 1500))
    assert result(spark, write(spark, rows)) == expected(rows)


def test_fields_come_back(spark):
    path = write(spark, [(3, "http://a.b/c?d=é e", "x" * 3000)], segment_bytes=500, date="2020-02-03T04:05:06Z")
    row = warc.read_archives(spark, path).collect()
    assert len(row) == 1
    assert (row[0]["type"], row[0]["date"], row[0]["target_uri"], row[0]["page_id"]) == ("response", "2020-02-03T04:05:06Z", "http://a.b/c?d=%C3%A9%20e", "3")
    assert bytes(row[0]["payload"]) == b"x" * 3000 and row[0]["stated_digest"] == hashlib.sha1(b"x" * 3000).hexdigest()


def test_no_rows_and_clashing_columns(spark):
    assert result(spark, write(spark, [])) == []
    rows = [(1, "u", "x" * 1200, "a", 1, True), (2, "u", "x" * 1200, "b", 2, False)]
    path = write(spark, rows, SCHEMA + ", digest string, row int, revisits boolean")
    assert result(spark, path) == expected(rows)


def record(kind, ident, block, *fields, version=b"1.0"):
    head = [b"WARC/" + version, b"WARC-Type: " + kind, b"WARC-Record-ID: <" + ident + b">", *fields, b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


HTTP = b"Content-Type: application/http; msgtype=response"


def segment(ident, number, block, total=None):
    kind = b"response" if number == 1 else b"continuation"
    fields = [HTTP, b"WARC-Segment-Number: %d" % number]
    fields += [b"WARC-Segment-Origin-ID: <" + ident + b">"] * (number > 1) + ([b"WARC-Segment-Total-Length: %d" % total] if total else [])
    return record(kind, ident if number == 1 else ident + b"-%d" % number, block, *fields)


@pytest.fixture
def foreign(tmp_path):
    """Records as other tools write them, over two files."""
    whole = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: gzip, Chunked\r\n\r\n4;x=y\r\nwxyz\r\n00A\r\n0123456789\r\n0\r\nTrailer: v\r\n\r\n"
    cut = [whole[:30], whole[30:70], whole[70:]]
    other = record(b"response", b"inner", b"HTTP/1.1 200 OK\r\n\r\n" + b"n", HTTP)
    first = [
        record(b"warcinfo", b"info", b"software: x\r\n"),
        segment(b"a", 3, cut[2], len(whole)),
        record(b"response", b"plain", b"HTTP/1.1 200 OK\r\n\r\nbody", b"warc-target-uri:\r\n http://folded", HTTP),
        record(b"response", b"holds", b"HTTP/1.1 200 OK\r\n\r\n" + other + b"tail", HTTP, version=b"1.1"),
        segment(b"lost", 1, b"HTTP/1.1 200 OK\r\n\r\n12"), segment(b"lost", 3, b"56", 24),
        segment(b"wrong", 2, b"34", 99), segment(b"open", 1, b"HTTP/1.1 200 OK\r\n\r\n12"),
    ]
    second = [
        segment(b"a", 1, cut[0]), segment(b"a", 2, cut[1]), segment(b"a", 2, cut[1]), segment(b"wrong", 1, b"HTTP/1.1 200 OK\r\n\r\n12"),
        record(b"response", b"broken", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nab", HTTP),
        record(b"response", b"short", b"HTTP/1.1 200 OK\r\n\r\n" + b"s" * 50, HTTP)[:-20],
    ]
    (tmp_path / "one.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in first))
    (tmp_path / "two.warc").write_bytes(b"".join(second))
    return str(tmp_path)


def test_records_of_others(spark, foreign):
    found = {r["record_id"][1:-1]: (r["status"], None if r["payload"] is None else bytes(r["payload"])) for r in warc.read_archives(spark, foreign).collect()}
    other = record(b"response", b"inner", b"HTTP/1.1 200 OK\r\n\r\n" + b"n", HTTP)
    assert found == {
        "info": ("ok", b"software: x\r\n"), "plain": ("ok", b"body"), "a": ("ok", b"wxyz0123456789"), "holds": ("ok", other + b"tail"),
        "lost": ("segments missing", None), "open": ("segments missing", None), "wrong": ("wrong total length", None),
        "broken": ("bad framing", None), "short": ("truncated", None),
    }
    assert "http://folded" in [r["target_uri"] for r in warc.read_archives(spark, foreign).collect()]


def test_splits_fall_anywhere(spark):
    rows = [(i, "u", f"{i} " + "\r\n" * (i % 7) + "text " * (i % 90)) for i in range(300)]
    path = Scratch(spark).path("archives")
    warc.write_archives(spark.createDataFrame(rows, SCHEMA), path + "/gz", segment_bytes=300, chunk_bytes=50)
    # the same records in plain files, read in splits of a few hundred bytes
    spark.read.option("lineSep", "\r\nWARC/1.").text(path + "/gz").createOrReplaceTempView("pieces")
    text = spark.sql("SELECT CASE WHEN startswith(value, 'WARC/1.') THEN value ELSE concat('WARC/1.', value) END AS value FROM pieces")
    text.selectExpr("regexp_replace(value, '\\r\\n\\r\\n$', '\\r\\n') AS value").write.option("lineSep", "\r\n").text(path + "/plain")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "997")
    try:
        assert result(spark, path + "/plain") == expected(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
