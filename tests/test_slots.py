"""Ingestion as a stream: a run that is killed and resumed, broken filings, repeated and replaced content."""

import pytest
from pyspark.sql import functions as F

from quillstone.operators import ingestion
from quillstone.streaming import slots as streams

CIK = {"AAPL": "320193", "MSFT": "789019", "AMZN": "1018724"}


def html(ticker, year, more="", kind="10-K"):
    fields = {"documenttype": kind, "documentfiscalyearfocus": year, "entitycentralindexkey": CIK[ticker]}
    head = "".join(f'<ix:nonNumeric name="dei:{k}" contextRef="c">{v}</ix:nonNumeric>' for k, v in fields.items())
    return f"<html><body>{head}<p>Item 1. Business of {ticker} in {year}</p><p>{more}</p></body></html>"


def filings():
    return [(t, y, f"{t}-{y}", CIK[t].zfill(10), f"{y + 1}-02-01", html(t, y)) for t in sorted(CIK) for y in (2022, 2023, 2024)]


def land(spark, folder, rows):
    """One file for each filing."""
    for row in rows:
        spark.createDataFrame([row], streams.LANDED).coalesce(1).write.mode("append").parquet(folder)


def told(spark, folder):
    found = streams.states(spark, folder, ingestion.slots(spark))
    return {(r["ticker"], r["fiscal_year"]): (r["state"], r["reason"], r["attempt"]) for r in found.collect()}, streams.status(found)


def read_rows(query):
    return sum(p["numInputRows"] for p in query.recentProgress)


def test_a_killed_run_resumes_where_it_was(spark, tmp_path):
    landing, folder = str(tmp_path / "landing"), str(tmp_path / "run")
    land(spark, landing, filings())

    def killed(number):
        if number == 4:
            raise RuntimeError("killed")

    query = streams.start(spark, landing, folder, per_trigger=1, each=killed)
    with pytest.raises(Exception, match="killed"):
        query.awaitTermination()
    found, status = told(spark, folder)
    assert sorted(s for s, *_ in found.values()) == ["completed"] * 4 + ["pending"] * 5 and status == "acquisition_incomplete"
    query = streams.start(spark, landing, folder, per_trigger=1)
    query.awaitTermination()
    assert read_rows(query) == 5
    found, status = told(spark, folder)
    assert set(found.values()) == {("completed", None, 1)} and len(found) == 9 and status == "completed"
    kept = streams.blocks(spark, folder, streams.states(spark, folder, ingestion.slots(spark)))
    assert kept.groupBy("document_id").count().select(F.min("count"), F.max("count"), F.count("*")).first()[:] == (1, 1, 9)
    query = streams.start(spark, landing, folder)
    query.awaitTermination()
    assert read_rows(query) == 0


def test_a_broken_filing_leaves_the_others_complete(spark, tmp_path):
    """A reader that raises, a missing download, another company's filing and a wrong year: each is a row; corrected content completes its slot."""
    landing, folder = str(tmp_path / "landing"), str(tmp_path / "run")
    rows = filings()
    broken = {0: "BROKEN", 1: None, 2: html("MSFT", 2024), 3: html("AMZN", 2019), 4: html("AMZN", 2023, kind="10-K/A")}
    land(spark, landing, [(*r[:5], broken.get(i, r[5])) for i, r in enumerate(rows)])

    def reader(content):
        if content == "BROKEN":
            raise ValueError("no filing")
        return streams.read_filing(content)

    streams.start(spark, landing, folder, reader).awaitTermination()
    found, status = told(spark, folder)
    reasons = ["unreadable: ValueError", "not downloaded", "CIK differs", "fiscal year differs", "not an annual report"]
    assert [found[r[:2]][:2] for r in rows] == [("failed", why) for why in reasons] + [("completed", None)] * 4 and status == "acquisition_incomplete"
    land(spark, landing, rows[:5])
    land(spark, landing, [rows[8], (*rows[7][:5], html("MSFT", 2023, "restated"))])
    streams.start(spark, landing, folder, reader).awaitTermination()
    found, status = told(spark, folder)
    assert status == "completed" and [found[r[:2]][2] for r in rows] == [2] * 5 + [1, 1, 2, 1]
    kept = streams.blocks(spark, folder, streams.states(spark, folder, ingestion.slots(spark)))
    assert [r["text"] for r in kept.where("document_id = 'MSFT-2023' AND text LIKE 'restated%'").collect()] == ["restated"]
