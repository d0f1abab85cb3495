import base64
import hashlib
import struct

import duckdb
import pytest
import zstandard

from pyspark.sql import functions as F

from ledgerloom.llm import warc


def page(i, text, kind="response"):
    payload = text.encode()
    return warc.record(i, "http://x/", payload, kind, hashlib.sha1(payload).hexdigest(), 9 if kind == "revisit" else None, len(payload))


def archive(*raw, known=b""):
    c = zstandard.ZstdCompressor(**({"dict_data": zstandard.ZstdCompressionDict(known)} if known else {}))
    return warc.dictionary_frame(known) + b"".join(c.compress(r) + warc.EMPTY_FRAME.encode() for r in raw)


def test_frames_of_any_kind():
    for n in (0, 1, 255, 256, 70_000, 300_000, 3_000_000):
        for options in ({}, {"write_checksum": True}, {"write_content_size": False}):
            data = zstandard.ZstdCompressor(**options).compress(bytes(n // 2) + hashlib.sha512(str(n).encode()).digest() * (n // 128))
            assert warc.frame_size(memoryview(data + b"tail"), 0) == len(data)


def test_records_and_dictionary():
    samples = [f"<html><p>page {i} of {i * 7919 % 1000}</p>{i * 'ab'}</html>".encode() * 20 for i in range(400)]
    known = warc.train_dictionary(samples)
    assert known
    for words in (known, zstandard.ZstdCompressor().compress(known)):
        data = archive(page(1, "é" * 10), page(None, ""), page(3, "z" * 5000, "revisit"), known=known)
        data = warc.dictionary_frame(words) + data[8 + len(known) :]
        found = list(warc.records(data))
        assert [h["warc-type"] for h, _ in found] == ["response", "response", "revisit"]
        assert found[0][1].decode() == "é" * 10 and found[2][1] == b""


@pytest.mark.parametrize(
    "data",
    [
        archive(page(1, "abc"))[:-12],
        b"junk" * 5,
        archive(page(1, "abc").replace(b"Content-Length: 62", b"Content-Length: 63")),
        archive(page(1, "abc").replace(b"WARC-Date", b"WARC-Time")),
        archive(page(1, "abc").replace(b"WARC/1.1", b"WARC/9.9")),
        archive(page(1, "abc") + page(2, "abc")),
        archive(page(1, "abc").replace(b"abc", b"abd")),
        archive(page(1, "abc")) + warc.dictionary_frame(b"x"),
        archive(page(1, "abc").replace(b"WARC-Type: response", b"WARC-Type response")),
        struct.pack("<IB", warc.MAGIC, 0),
    ],
)
def test_bad_archives(data):
    with pytest.raises(warc.ArchiveError):
        list(warc.records(data))


def test_round_trip(spark, tmp_path):
    long = "x" * 1200
    rows = [(1, "u", long), (2, "u", long), (3, "u", "short"), (4, "u", "short"), (5, None, None), (None, "u", long), (6, "u\r\nX: 1", "é" * 400), (7, "v", "é" * 600), (8, "v", "é" * 600), (7, "v", "é" * 600), (None, "w", "q" * 2000), (None, "w", "q" * 2000), (9, "big", "<p>" * 400_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", __import__("pyspark").sql.functions.lit(1))
    found = warc.round_trip(df, str(tmp_path / "a")).collect()
    assert len(found) == len(rows)
    of = {}
    for r in found:
        of.setdefault(r.page_id, []).append(r)
    assert of[1][0].record_type == "revisit" and of[1][0].refers_to == 2 and of[2][0].record_type == "response"
    assert {of[i][0].record_type for i in (3, 4, 5, 6, 8, 9)} == {"response"}
    assert [r.refers_to for r in of[7]] == [8, 8]
    assert sorted(r.record_type for r in of[None]) == ["response", "response", "revisit"]
    for i, _, text in rows:
        payload = (text or "").encode()
        for r in of[i]:
            if i is not None:
                assert r.payload_bytes == len(payload) and r.payload_digest == hashlib.sha1(payload).hexdigest()
            if r.record_type == "response" and i is not None:
                assert bytes(r.payload) == payload
    assert warc.query(df.where("false")).count() == 0


def test_whole_small_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    copies = pages.union(pages.selectExpr("page_id + 1000000 as page_id", "url", "html"))
    want = {}
    rows = copies.collect()
    for r in rows:
        k = hashlib.sha1((r.html or "").encode()).hexdigest()
        want[k] = max(want.get(k, -1), r.page_id)
    for r in warc.query(copies).collect():
        head = want[r.payload_digest] if r.payload_bytes >= 1000 else r.page_id
        assert r.record_type == ("response" if head == r.page_id else "revisit")
        assert r.refers_to == (None if head == r.page_id else head)


def test_training_rows_do_not_hang_on_the_order(spark, monkeypatch):
    monkeypatch.setattr(warc, "DICT_ROWS", 20)
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{i}</p>") for i in range(200)], "page_id long, url string, html string")
    one, two = (warc.training_rows(pages.coalesce(1).orderBy(by)) for by in (F.asc("page_id"), F.desc("page_id")))
    assert one == two and len(one) == 20
    with_all = warc.training_rows(pages.where("page_id < 20"))
    assert sorted(one) != sorted(with_all)


def foreign(kind, body, *more, version=b"WARC/1.0"):
    lines = [b"warc-type: " + kind, b"WARC-RECORD-ID: <urn:uuid:" + hashlib.md5(body + kind).hexdigest().encode() + b">", b"WARC-Date: 2020-01-01T00:00:00Z", *more, b"Content-length: " + str(len(body)).encode()]
    return version + b"\r\n" + b"\r\n".join(lines) + b"\r\n\r\n" + body + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    http = b"Content-Type: application/http; msgtype=response"
    text = b"<p>hello</p>"
    sha = base64.b32encode(hashlib.sha1(text).digest())
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n4\r\n<p>h\r\n8;x=1\r\nello</p>\r\n0\r\n\r\n"
    plain = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" + text
    first = foreign(b"response", plain, http, b"WARC-Target-URI: http://a/", b"WARC-Payload-Digest: sha1:" + sha)
    name = b"<urn:uuid:" + hashlib.md5(plain + b"response").hexdigest().encode() + b">"
    raw = [
        foreign(b"warcinfo", b"software: x\r\n", b"Content-Type: application/warc-fields", b"WARC-Filename: a", b"WARC-Concurrent-To: <a>", b"WARC-Concurrent-To: <b>"),
        first,
        foreign(b"response", chunked, http, b"WARC-Payload-Digest: sha1:" + sha, version=b"WARC/1.1"),
        foreign(b"response", chunked, http, b"WARC-Payload-Digest: sha1:" + hashlib.sha1(chunked.split(b"\r\n\r\n", 1)[1]).hexdigest().encode()),
        foreign(b"revisit", b"HTTP/1.1 200 OK\r\n\r\n", http, b"WARC-Refers-To: " + name, b"WARC-Payload-Digest: sha1:" + sha),
        foreign(b"metadata", b"x: y", b"X-Long: a\r\n b"),
        foreign(b"request", b"GET / HTTP/1.1\r\n\r\n", b"Content-Type: application/http; msgtype=request"),
    ]
    (tmp_path / "a.warc.zst").write_bytes(archive(*raw))
    found = warc.with_lengths(warc.read(spark, str(tmp_path / "a.warc.zst"))).collect()
    assert sorted(r.record_type for r in found) == ["metadata", "request", "response", "response", "response", "revisit", "warcinfo"]
    assert all(r.page_id is None and r.record_id.startswith("<urn:uuid:") for r in found)
    assert [bytes(r.payload) for r in found if r.record_type == "response"] == [text] * 3
    revisit = next(r for r in found if r.record_type == "revisit")
    assert revisit.payload_bytes == len(text) and revisit.payload_digest == hashlib.sha1(text).hexdigest() and revisit.refers_to_id == name.decode()
    assert {r.record_type: bytes(r.payload) for r in found}["metadata"] == b"x: y"
    bad = archive(foreign(b"response", plain, http, b"WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(b"?").digest())))
    with pytest.raises(warc.ArchiveError):
        list(warc.records(bad))


def test_a_very_long_page(spark, tmp_path):
    df = spark.sql("select 1L as page_id, 'u' as url, repeat('<p>0123456789</p>', 3000000) as html, 'x' as digest, 1 as kind")
    (row,) = warc.round_trip(df, str(tmp_path / "a")).select("payload_bytes", "record_type").collect()
    assert tuple(row) == (51_000_000, "response")


def test_sql(spark):
    db = duckdb.connect()
    db.execute("create view pages as select * from '/root/testdata/sf0.01/pages.parquet'")
    want = sorted(db.execute(warc.ORACLE_SQL).fetchall(), key=repr)
    out = warc.query(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    assert sorted(map(tuple, out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr) == want


def test_archives_are_closed_by_their_bytes(spark, tmp_path):
    """One payload copied 10,000 times, all dealt to one partition: many small archives, each with its dictionary, and every record has a name of its own."""
    rows = [(i, f"http://x/{i}", "copy " * 300) for i in range(10_000)] + [(10_000 + i, None, f"page {i} " * 200) for i in range(50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path, roll = str(tmp_path / "warc"), 20_000
    warc.write(warc.decide(pages).coalesce(1), path, warc.train_dictionary(warc.training_rows(pages)), roll)
    files = [f for f in (tmp_path / "warc").iterdir() if f.name.startswith("part-")]
    assert len(files) > 20 and all(f.stat().st_size < roll + 40_000 for f in files)
    found = warc.read(spark, path).cache()
    assert found.count() == found.select("record_id").distinct().count() == len(rows)
    assert found.where("record_type = 'revisit' and refers_to = 9999").count() == 9_999
    heads = found.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"))
    assert found.where("record_type = 'revisit'").join(heads, "refers_to_id", "left_anti").count() == 0
    assert {r.page_id for r in found.collect()} == set(range(10_050))
    found.unpersist()
