import hashlib

import pytest

from tablewright.llm import warc
from tablewright.session import fresh_path

MANY = "<p>" + "x" * 1200


def pages():
    fake = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [(1, "http://a/1", MANY), (7, "http://a/7", MANY), (3, "http://a/3", MANY), (4, "http://a/4", "short"), (5, "http://a/5", "short")]
    rows += [(10, "http://b\r\nX: y", f"before {fake}{fake} after WARC/1.1\r\n"), (11, None, None), (12, "", ""), (13, "http://ü/é", "é\r\n\r\nü" * 700)]
    rows += [(14, "u", fake * 60), (15, "u", "WARC/1."), (16, "u", "y" * 400_000), (17, "u", fake), (18, "u", fake * 60)]
    return rows


def expected(rows):
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        original = max(p for p, _, h in rows if (h or "") == (html or ""))
        again = len(body) >= 1000 and page != original
        out.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", original if again else None))
    return sorted(out)


@pytest.fixture(scope="module")
def archive(spark):
    path = fresh_path(spark, "test-archives")
    df = spark.createDataFrame([(*r, 1) for r in pages()], "page_id long, url string, html string, digest int").coalesce(2)
    warc.write(df, path, "page_id", "url", "html")
    return path


def page(name):
    return int(name.removeprefix("<urn:page:").rstrip(">")) if name else None


def test_round_trip(spark, archive):
    got = sorted(
        (page(r.record_id), r.stated_length if r.record_type == "revisit" else r.length, r.stated_digest if r.record_type == "revisit" else r.digest, r.record_type, page(r.refers_to))
        for r in warc.read(spark, archive).collect()
    )
    assert got == expected(pages())


def test_payloads(spark, archive):
    got = {page(r.record_id): (r.payload, r.digest) for r in warc.read(spark, archive, payload=True).collect() if r.record_type == "response"}
    for number, _, html in pages():
        if number in got:
            assert got[number] == (html or "", hashlib.sha1((html or "").encode()).hexdigest())


def test_small_splits_give_the_same_records(spark, archive):
    whole = sorted(map(tuple, warc.read(spark, archive).drop("file").collect()), key=repr)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert sorted(map(tuple, warc.read(spark, archive).drop("file").collect()), key=repr) == whole
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_truncated_record_is_left_out(spark):
    path = fresh_path(spark, "test-archives")
    good = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    spark.createDataFrame([(good + good.replace("page:1", "page:2")[:-6],)], "value string").coalesce(1).write.option("lineSep", "\r\n").text(path)
    assert [page(r.record_id) for r in warc.read(spark, path).collect()] == [1]


def test_empty_table(spark):
    path = fresh_path(spark, "test-archives")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), path, "page_id", "url", "html")
    assert warc.read(spark, path).count() == 0


def test_changed_splits_fail_rather_than_lose_pieces(spark, archive, monkeypatch):
    from pyspark.sql import functions as F

    real, calls = warc._pieces, []

    def pieces(*args):
        calls.append(1)
        found = real(*args)
        return found if len(calls) == 1 else found.withColumn("piece", F.col("piece") + F.when(F.col("piece") % 5 == 0, 1 << 20).otherwise(0))

    monkeypatch.setattr(warc, "_pieces", pieces)
    with pytest.raises(Exception, match="splits changed"):
        warc.read(spark, archive).select("digest").collect()
    assert len(calls) == 2
