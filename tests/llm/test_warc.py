import base64
import glob
import gzip
import hashlib

from pyspark.sql import functions as F

from evidentia.llm import warc

PAGES = [(1, "http://a/1", "same"), (5, "http://a/5", "same"), (3, "http://b/ 3\r\nX: y", "same"), (4, None, None), (6, "u", ""), (7, "u", "<p>été 字</p>\r\n\r\nWARC/1.1"),
         (None, "n", "same"), (None, "n", "alone"), (8, "long", "x" * 300_000), (9, "twice", "twice"), (9, "twice", "twice")]


def brute(rows, least):
    out = []
    for page, _, text in rows:
        raw = (text or "").encode()
        group = [p for p, _, t in rows if (t or "") == (text or "") and p is not None]
        first = max(group, default=None) if len(raw) >= least else None
        revisit = first is not None and page != first
        out.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha1", F.lit("x")).withColumn("response", F.lit(1))


def test_round_trip(spark, monkeypatch):
    for least in (0, 4, 5):
        for gap, size in ((warc.GAP_BYTES, warc.RANGE_BYTES), (0, 100)):
            monkeypatch.setattr(warc, "GAP_BYTES", gap)
            monkeypatch.setattr(warc, "RANGE_BYTES", size)
            got = warc.round_trip(pages(spark, PAGES).repartition(3), least)
            assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(PAGES, least)


def test_archive_is_valid_and_small_files_follow(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "FILE_BYTES", 500)
    index = warc.write(pages(spark, PAGES), str(tmp_path))
    files = glob.glob(f"{tmp_path}/*.warc.gz")
    assert len(files) > 1
    whole = b"".join(gzip.open(f).read() for f in files)
    assert whole.count(b"\r\n\r\n") >= 2 * len(PAGES)
    for r in index.collect():
        with open(f"{tmp_path}/{r['file']}", "rb") as f:
            f.seek(r["offset"])
            fields, http, payload = warc.parsed(f.read(r["length"]))
        assert fields.get("X-Page-ID") == (None if r["page_id"] is None else str(r["page_id"])) and fields["WARC-Payload-Digest"] == f"sha1:{r['payload_digest']}"
        assert len(payload) == (int(http["Content-Length"]) if fields["WARC-Type"] == "response" else 0)


def test_selected_records_are_read_by_merged_ranges(spark, tmp_path):
    many = [(i, f"u{i}", f"page {i} " * 50) for i in range(200)]
    index = warc.write(pages(spark, many).coalesce(1), str(tmp_path))
    got = warc.ranges(index).collect()
    assert len(got) == 1 and len(got[0]["records"]) == 200
    some = index.filter("page_id % 50 = 7")
    assert sorted(r["page_id"] for r in warc.read(some, str(tmp_path)).collect()) == [7, 57, 107, 157]


def test_empty_table(spark):
    assert warc.round_trip(pages(spark, [])).count() == 0
