"""WARC archives: round trips, push-down, foreign members and plain files."""

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from loomseg.llm import warc
from loomseg.llm.shared import fresh_path

SCHEMA = "page_id long, url string, html string, payload string"
BIG = "é" * 600


def _rows():
    rows = [(i, f"http://x/{i}", BIG if i in (3, 8, 5) else f"page {i}", "clash") for i in range(10)]
    rows += [(20, None, None, None), (21, "u", "", None), (None, "n", "y" * 1000, None), (30, "n", "y" * 1000, None), (31, "m", "small", None), (32, "m", "small", None)]
    rows += [(40, "a", "z" * 2000, None), (40, "a", "z" * 2000, None), (None, "b", "w" * 1500, None), (None, "b", "w" * 1500, None)]
    return rows


def test_round_trip(spark):
    out = fresh_path(spark, "w")
    got = warc.archive_pages(spark.createDataFrame(_rows(), SCHEMA), out)
    seen = sorted((r.record_id, r.record_type, r.refers_to, r.payload_length, r.payload_digest, None if r.payload is None else bytes(r.payload)) for r in got.collect())
    last = {BIG: 8, "y" * 1000: 30, "z" * 2000: 40}
    want = []
    for i, _, html, _ in _rows():
        b = (html or "").encode()
        to = last.get(html)
        again = to is not None and i != to
        want.append((f"<urn:page:{'null' if i is None else i}>", "revisit" if again else "response", f"<urn:page:{to}>" if again else None, len(b), "sha1:" + hashlib.sha1(b).hexdigest(), None if again else b))
    assert seen == sorted(want, key=lambda x: (x[0], x[1], str(x[2]), x[3]))
    some = got.filter("record_type = 'revisit' AND refers_to LIKE '<urn:page:8%'")
    assert sorted(r.record_id for r in some.collect()) == ["<urn:page:3>", "<urn:page:5>"]
    heads = spark.read.format("warc").option("path", out).option("payload", "false").load()
    assert heads.count() == len(_rows()) and heads.filter("payload IS NOT NULL").count() == 0


def test_unwanted_payloads_are_not_decoded(monkeypatch, tmp_path):
    for i, ext in ((0, "a.warc.gz"), (1, "b.warc"), (2, "c.warc.gz")):
        recs = [warc.record({"record_id": f"<{i}-{k}>", "record_type": t}, b"p" * 9000) for k, t in enumerate(("response", "warcinfo", "response"))]
        data = b"".join({0: warc.member, 1: bytes, 2: gzip.compress}[i](r) for r in recs)
        (tmp_path / ext).write_bytes(data)
    decoded = []
    for cls in (warc._Member, warc._Plain):
        monkeypatch.setattr(cls, "block", lambda self, f=cls.block: decoded.append(1) or f(self))
    reader = warc.WarcReader({"path": str(tmp_path)})
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "warcinfo"), warc.EqualTo(("payload_length",), 5)]))
    assert len(left) == 1
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["record_id"] for r in rows] == ["<0-1>", "<1-1>", "<2-1>"] and len(decoded) == 3
    assert all(r["payload"] == b"p" * 9000 for r in rows)


def test_partitions_are_packed(tmp_path):
    for i in range(7):
        (tmp_path / f"{i}.warc").write_bytes(warc.record({"record_id": f"<{i}>", "record_type": "response"}, b"x" * 500))
    n = len(warc.record({"record_id": "<0>", "record_type": "response"}, b"x" * 500))
    parts = warc.WarcReader({"path": str(tmp_path), "splitbytes": str(3 * n)}).partitions()
    assert [len(p.paths) for p in parts] == [3, 3, 1]


def test_empty(spark):
    assert warc.archive_pages(spark.createDataFrame([], SCHEMA), fresh_path(spark, "w")).count() == 0


def test_overwriting_keeps_what_was_until_the_commit(spark, tmp_path):
    warc.register(spark)
    out = str(tmp_path / "w")
    rows = lambda lo, hi: spark.range(lo, hi).selectExpr("concat('<urn:page:', id, '>') AS record_id", "'response' AS record_type", "CAST(NULL AS STRING) AS target_uri", "CAST(NULL AS STRING) AS refers_to", "'sha1:x' AS payload_digest", "1L AS payload_length", "CAST('a' AS BINARY) AS payload")
    count = lambda: spark.read.format("warc").option("path", out).load().count()
    rows(0, 5).write.format("warc").mode("overwrite").option("path", out).save()
    bad = rows(0, 9).withColumn("payload_length", F.expr("CASE WHEN record_id LIKE '%7%' THEN CAST(raise_error('stop') AS BIGINT) ELSE 1L END"))
    with pytest.raises(Exception, match="stop"):
        bad.write.format("warc").mode("overwrite").option("path", out).save()
    assert count() == 5
    rows(0, 3).write.format("warc").mode("overwrite").option("path", out).save()
    assert count() == 3
