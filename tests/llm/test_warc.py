import hashlib

import pytest

from orderloom.llm import warc

SCHEMA = "page_id bigint, url string, html string, file string"


def expected(rows):
    groups = {}
    for page_id, _, html, *_ in rows:
        groups.setdefault(html or "", []).append(page_id)
    out = []
    for page_id, _, html, *_ in rows:
        raw = (html or "").encode()
        top = max(groups[html or ""])
        again = len(raw) >= 1000 and page_id != top
        out.append((page_id, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", top if again else None))
    return sorted(out)


def inner(n, body):
    return f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: {n}\r\n\r\n{body}\r\n\r\n"


@pytest.fixture
def rows():
    big = "x" * 1500
    evil = ["WARC/1.0\r\n", "a WARC/1.0\r\nno header", inner(3, "abc"), inner(3, "abcdef"), inner(5, "abcde") + inner(2, "ab"), "WARC/1.0\r\nWARC/1.0\r\nContent-Length: 5\r\n\r\n"]
    bodies = [big, big, big, "y" * 999, "y" * 999, "", None, "é" * 500, "é" * 500, "é" * 499, "é" * 499, *evil, "q\r\n\r\nz", evil[2] * 300, evil[2] * 300]
    return [(i, None if i == 3 else f"http://x/{i} \n{i}", b, "clash") for i, b in enumerate(bodies)]


@pytest.mark.parametrize("split", ["128m", "700b"])
def test_round_trip(spark, rows, split):
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = warc.op8_warc(spark.createDataFrame(rows, SCHEMA).coalesce(2))
        assert sorted(map(tuple, got.collect())) == expected(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)


def test_empty(spark):
    assert warc.op8_warc(spark.createDataFrame([], SCHEMA)).collect() == []


def test_null_id_and_repeated_row(spark):
    rows = [(None, "u", "z" * 1200, ""), (5, "u", "z" * 1200, ""), (5, "u", "z" * 1200, "")]
    got = warc.op8_warc(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.page_id or -1, r.record_type, r.refers_to) for r in got) == [(-1, "revisit", 5), (5, "response", None), (5, "response", None)]


def test_payloads_come_back(spark, rows, tmp_path):
    path = f"file://{tmp_path}/a"
    warc.write_warc(warc.with_types(spark.createDataFrame(rows, SCHEMA)), path)
    back = warc.read_warc(spark, path, payloads=True).where("type = 'response'").collect()
    want = {r[0]: (r[2] or "").encode() for r in rows}
    for r in back:
        assert bytes(r.payload) == want[int(r.record_id[10:-1])]
