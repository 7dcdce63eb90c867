"""Requests released by timers, against the plain order."""

import datetime
import random

from pyspark.sql import functions as F

from quillstone.streaming import slots, throttle

BASE = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


def plain(requests, spacing):
    """{request: go_at} of (host, request, second) rows, in order of time and request."""
    out, last = {}, {}
    for host, request, second in sorted(requests, key=lambda r: (r[2], r[1])):
        stamp = BASE.timestamp() + second
        last[host] = stamp if host not in last else max(stamp, last[host] + spacing)
        out[request] = round(last[host], 3)
    return out


def run(spark, tmp_path, files, spacing=0.25):
    folder = str(tmp_path / "in")
    for rows in files:
        made = spark.createDataFrame([(h, i, BASE + datetime.timedelta(seconds=s)) for h, i, s in rows], "host string, request_id long, ts timestamp")
        made.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("host string, request_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(folder)
    with slots.rocks(spark):
        query = throttle.released(stream, spacing=spacing).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    return {r["request_id"]: round(r["go_at"], 3) for r in spark.read.parquet(str(tmp_path / "out")).collect()}


def test_requests_of_several_batches_go_in_order_of_time(spark, tmp_path):
    """A later micro-batch brings earlier requests, within the watermark; the last ones wait for the watermark."""
    first = [("a", 1, 2.0), ("a", 2, 0.5), ("b", 3, 1.0), ("a", 9, 2.0)]
    second = [("a", 4, 0.1), ("a", 5, 1.9), ("b", 6, 1.1)]
    end = [("z", 99, 3600.0)]
    got = run(spark, tmp_path, [first, second, end])
    assert got == plain(first + second, 0.25) and 99 not in got


def test_a_hot_host_in_parts(spark, tmp_path, monkeypatch):
    """100,000 requests of one host within a minute: released in order, parts of bounded size in state."""
    rng = random.Random(1)
    rows = [("hot" if i % 20 else f"h{i % 7}", i, rng.randrange(60_000) / 1000) for i in range(100_000)]
    got = run(spark, tmp_path, [rows, [("z", 10**6, 7200.0)]], spacing=0.01)
    assert got == plain(rows, 0.01)
    gone = spark.read.parquet(str(tmp_path / "out")).where("host = 'hot'").agg(F.max("go_at") - F.min("go_at")).first()[0]
    assert gone >= 0.01 * (sum(r[0] == "hot" for r in rows) - 1) - 1e-3


def test_only_the_last_release_of_a_host_is_its_state(spark, tmp_path):
    """A queue that crosses seconds and micro-batches: requests are sums by second before they meet their host, whose state is one row, not a row for each second or request."""
    rng = random.Random(2)
    first = [(rng.choice("ab"), i, rng.randrange(20_000) / 1000) for i in range(600)]
    second = [(rng.choice("ab"), i, 40 + rng.randrange(20_000) / 1000) for i in range(600, 1200)]
    for rows in (first, second, [("z", 9999, 3600.0)]):
        made = spark.createDataFrame([(h, i, BASE + datetime.timedelta(seconds=s)) for h, i, s in rows], "host string, request_id long, ts timestamp")
        made.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("host string, request_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    with slots.rocks(spark, 2):
        query = throttle.released(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r["request_id"]: round(r["go_at"], 3) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == plain(first + second, 0.25)
    operators = [o for p in query.recentProgress for o in p["stateOperators"] if o["operatorName"].startswith("transformWithState")]
    assert operators and max(o["numRowsTotal"] for o in operators) <= 3
    assert {o["numShufflePartitions"] for o in operators} == {2} and spark.conf.get("spark.sql.shuffle.partitions") == parts
