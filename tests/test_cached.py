"""The cache as a data source: verified bytes, partitions, all or nothing."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from quillstone.sources import cached

URL = "https://www.sec.gov/Archives/edgar/data/1/{}.htm"


def written(spark, folder, rows, mode="append"):
    frame = spark.createDataFrame(rows, "source_url string, content binary").repartition(3)
    frame.write.format("quillstone_cache").mode(mode).option("path", folder).save()


def read(spark, folder, **options):
    return {r["source_url"]: r for r in spark.read.format("quillstone_cache").option("path", folder).options(**options).load().collect()}


def test_round_trip_and_partitions(spark, tmp_path, monkeypatch):
    cached.register(spark)
    folder = str(tmp_path / "cache")
    rows = [(URL.format(i), bytearray(f"filing {i} ".encode() * 50)) for i in range(12)]
    written(spark, folder, rows)
    got = read(spark, folder)
    assert {u: bytes(r["content"]) for u, r in got.items()} == {u: bytes(c) for u, c in rows}
    assert all(r["reason"] is None and r["byte_count"] == len(r["content"]) and r["content_sha256"] == hashlib.sha256(r["content"]).hexdigest() for r in got.values())
    assert not [n for n in os.listdir(folder) if n.startswith("_")]
    monkeypatch.setattr(cached, "PART_BYTES", 1000)
    parts = cached.CachedReader(folder, False).partitions()
    assert len(parts) >= 6 and sum(len(p.names) for p in parts) == 12
    written(spark, folder, [(rows[0][0], bytearray(b"newer"))])
    assert bytes(read(spark, folder)[rows[0][0]]["content"]) == b"newer"
    written(spark, folder, [(URL.format("x"), bytearray(b"only"))], "overwrite")
    assert set(read(spark, folder)) == {URL.format("x")}


def test_bytes_that_do_not_hold_are_no_rows(spark, tmp_path):
    cached.register(spark)
    folder = str(tmp_path / "cache")
    rows = [(URL.format(i), bytearray(f"filing {i}".encode())) for i in range(7)]
    written(spark, folder, rows)
    names = [os.path.join(folder, hashlib.sha256(u.encode()).hexdigest()) for u, _ in rows]

    def restated(i, **other):
        meta = json.loads(open(names[i] + cached.META).read()) | other
        open(names[i] + cached.META, "w").write(json.dumps(meta))

    open(names[0], "ab").write(b"!")
    open(names[1], "wb").write(b"filinG 1")
    os.remove(names[2])
    restated(3, source_url=URL.format("other"))
    restated(4, format_version=2)
    open(names[5] + cached.META, "w").write("not json")
    assert set(read(spark, folder)) == {rows[6][0]}
    reasons = [r["reason"] for r in spark.read.format("quillstone_cache").option("path", folder).option("all", "true").load().collect()]
    assert sorted(filter(None, reasons)) == ["byte count differs", "checksum differs", "no content", "other format version", "statement is not JSON", "statement of another address"] and reasons.count(None) == 1


def test_a_failing_task_publishes_nothing(spark, tmp_path):
    cached.register(spark)
    folder = str(tmp_path / "cache")
    written(spark, folder, [(URL.format("kept"), bytearray(b"kept"))])
    before = sorted(os.listdir(folder))
    for bad in (("https://example.com/x", bytearray(b"x")), (URL.format("empty"), bytearray(b""))):
        with pytest.raises(Exception, match="not allowed|no content"):
            written(spark, folder, [(URL.format(i), bytearray(b"new")) for i in range(20)] + [bad])
        assert sorted(os.listdir(folder)) == before
    assert set(read(spark, folder)) == {URL.format("kept")}
    assert spark.read.format("quillstone_cache").option("path", str(tmp_path / "none")).load().where(F.lit(True)).count() == 0
