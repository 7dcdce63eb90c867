"""Views, sources of filings, model interfaces, settings, and the engine end to end."""

import datetime
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quillstone.functions import models
from quillstone.operators import engine, views
from quillstone.settings import Settings
from quillstone.sources import filings


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(i, *v) if isinstance(v, tuple) else (i, v) for i, v in enumerate(values)], "i int, " + ", ".join(f"{n} string" for n in ("a", "b")[: len(values[0]) if isinstance(values[0], tuple) else 1])).orderBy("i").select(column).collect()]


def test_numbers_for_display(spark):
    assert one(spark, views.numeric(F.col("a")), " 1e3 ", "", "0x1", "NaN", "Infinity", ".5", None) == [1000.0, None, None, None, None, 0.5, None]
    pairs = [("-5000000000", "USD"), ("6.08", "USD/shares"), ("-0.001", "percentage"), ("12.345", "percentage"), ("x", "USD"), ("7", "EUR")]
    assert one(spark, views.shown(F.col("a"), F.col("b")), *pairs) == ["-$5.00B", "$6.08/share", "0.00%", "12.34%", "Unavailable", "7 EUR"]
    assert one(spark, views.label(F.col("a"), {"eps": "EPS"}), "eps", "net_income") == ["EPS", "Net Income"]
    assert one(spark, views.abstention(F.col("a")), "timeout", "some_category", "Plain words.", None) == ["The request took too long.", "Some Category.", "Plain words.", "The data and evidence at hand do not support an answer."]


def test_digest_and_schema(spark):
    a, b = one(spark, views.canonical_digest(F.col("a")), '{"b": 1, "a": "é"}', '{"a":"\\u00e9","b":1}')
    assert a == b == hashlib.sha256(json.dumps({"a": "é", "b": 1}).encode()).hexdigest()
    assert one(spark, views.canonical_digest(F.col("a")), "{") == [None]
    assert views.without_keys({"maxLength": 1, "a": [{"maxLength": 2, "b": 3}]}, frozenset(["maxLength"])) == {"a": [{"b": 3}]}


def test_projections(spark):
    calc = spark.createDataFrame([("c", "growth", "20", [("f", "AAPL", "secret")])], "calculation_id string, metric string, value string, inputs array<struct<fact_id:string,ticker:string,private:string>>")
    assert json.loads(views.compact(calc).toJSON().first()) == {"calculation_id": "c", "metric": "growth", "value": "20", "inputs": [{"fact_id": "f", "ticker": "AAPL"}]}
    facts = spark.createDataFrame([("AAPL", 2024, "revenue", "5", "USD", "us-gaap:Revenues", "A-1", None, "2024-09-28")], "ticker string, fiscal_year int, metric string, value string, unit string, concept string, accession_number string, period_start string, period_end string")
    assert views.fact_records(facts).first()["text"] == "AAPL FY2024 revenue = 5 USD; period None to 2024-09-28"
    row = facts.select(views.present(F.struct(*facts.columns), ["ticker", "period_start"]).alias("m")).first()
    assert row["m"] == {"ticker": "AAPL"}
    said = facts.select(views.messages("rules", F.lit("q"), F.array("value"), F.array().cast("array<string>")).alias("m")).first()["m"]
    assert json.loads(json.loads(said)[1]["content"]) == {"question": "q", "evidence": ["5"], "calculations": []}
    audits = spark.createDataFrame([("a", "2024", "failed", []), ("b", "2025", "completed", [("T", 2024, "ok", "s", None, "x")])], "run_id string, started_at string, status string, slots array<struct<ticker:string,fiscal_year:int,status:string,stages:string,error_category:string,extra:string>>")
    last = views.audit_summary(audits).first()
    assert last["run_id"] == "b" and "extra" not in last["slots"][0].asDict()
    traces = spark.createDataFrame([("p", "m"), ("p", "m"), (None, None)], "provider string, model string")
    assert [tuple(r) for r in views.provider_counts(traces).collect()] == [("p", "m", 2)]


def test_pages_are_clamped(spark):
    rows = spark.range(25)
    assert [r["id"] for r in views.page(rows, ["id"], 10, 99).collect()] == [20, 21, 22, 23, 24] and views.page(rows.where("false"), ["id"], 10, 0).count() == 0


def test_submissions(spark):
    table = {"accessionNumber": ["a"], "filingDate": ["d"], "reportDate": ["r"], "form": ["10-K"], "primaryDocument": ["p"]}
    main = lambda cik, t: json.dumps({"cik": cik, "filings": {"recent": t, "files": []}})
    rows = [
        ("u/CIK0000000001.json", main("1", table), "0000000001"), ("u/CIK0000000001-submissions-001.json", json.dumps(table), "0000000001"), ("u/CIK0000000002.json", main("3", table), "0000000002"),
        ("u/odd.json", json.dumps(table), "0000000001"), ("u/CIK0000000009-submissions-001.json", json.dumps(table), "0000000001"), ("u/CIK0000000004.json", main("4", {**table, "form": []}), "0000000004"),
    ]
    raw = spark.createDataFrame(rows, "url string, content string, cik string")
    good, bad = filings.submissions(raw)
    assert good.count() == 2 and {(r["cik"], r["reason"]) for r in bad.collect()} == {("0000000002", "entity differs"), ("0000000001", "unexpected archive name"), ("0000000001", "archive of another entity"), ("0000000004", "lengths differ")}
    assert len(filings.source_hashes(raw).where("cik = '0000000001'").first()["hashes"]) == 4


def test_fetcher():
    now, slept, answers = [0.0], [], [(503, {}, b""), (429, {"Retry-After": "90"}, b""), (200, {}, b"ok")]

    def sleep(s):
        slept.append(s)
        now[0] += s

    got = filings.Fetcher(lambda url: answers.pop(0), clock=lambda: now[0], sleep=sleep)
    assert got.get("https://www.sec.gov/a") == b"ok" and 60.0 in slept and 0.5 in slept
    with pytest.raises(ValueError, match="not allowed"):
        got.get("https://evil.com/")
    with pytest.raises(OSError, match="404"):
        filings.Fetcher(lambda url: (404, {}, b""), sleep=sleep, clock=lambda: now[0]).get("https://data.sec.gov/x")
    assert filings.retry_after("Thu, 01 Jan 1970 00:00:30 GMT", 10) == 20 and filings.retry_after("junk", 0) is None


class Fake:
    def __init__(self, name, *results):
        self.name, self.model, self.results, self.calls = name, "m", list(results), 0

    def generate(self, messages, seconds):
        self.calls += 1
        r = self.results.pop(0)
        if isinstance(r, str):
            raise models.ProviderFailure(r, self.name)
        return r


def test_fallback_policy():
    quiet = {"sleep": lambda s: None, "clock": lambda: 0.0}
    a, b = Fake("a", "timeout", "rate_limit", "provider_unavailable"), Fake("b", [{"text": "x"}])
    assert models.WithFallback(a, b, **quiet).generate([]) == ([{"text": "x"}], "b") and a.calls == 3
    a, b = Fake("a", "authentication"), Fake("b", [])
    with pytest.raises(models.ProviderFailure, match="authentication"):
        models.WithFallback(a, b, **quiet).generate([])
    assert b.calls == 0
    ticks = iter(range(0, 1000, 50))
    with pytest.raises(models.ProviderFailure):
        models.WithFallback(Fake("a", "timeout", "timeout", "timeout"), None, clock=lambda: next(ticks), sleep=lambda s: None).generate([])
    assert [models.category_of(s) for s in (429, 401, 500, None, 400)] == ["rate_limit", "authentication", "provider_unavailable", "provider_unavailable", "invalid_request"]
    assert [models.backoff(i, 1, 5) for i in range(4)] == [1, 2, 4, 5]


def test_settings():
    assert Settings.read({"QUILL_CHUNK_TOKENS": "50", "QUILL_CHUNK_OVERLAP": "5"}).chunk_tokens == 50 and Settings().input_tokens == 32_768 - 4_048
    for bad in ({"QUILL_CHUNK_OVERLAP": "700"}, {"QUILL_FINAL_CHUNKS": "0"}, {"QUILL_ABSTAIN_BELOW": "2"}, {"QUILL_REQUEST_SECONDS": "100"}, {"QUILL_FALLBACK": "extractive"}):
        with pytest.raises(ValueError):
            Settings.read(bad)


OBS = "cik long, concept string, unit string, val string, start string, end string, fy int, fp string, form string, accn string, dimensions map<string,string>"


def test_reports_are_resolved_and_reconciled(spark):
    reports = spark.createDataFrame([("AAPL-A-1", "AAPL", "0000320193", 2024, "10-K", "A-1", "2024-12-31")], "document_id string, ticker string, cik string, fiscal_year int, filing_type string, accession_number string, period_end string")
    seen = spark.createDataFrame([(320193, "Revenues", "USD", "100", "2024-01-01", "2024-12-31", 2024, "FY", "10-K", "A-1", None), (320193, "Assets", "USD", "50", None, "2024-12-31", 2024, "FY", "10-K", "A-1", None), (320193, "Liabilities", "USD", "9", None, "2024-12-31", 2024, "FY", "10-K", "A-1", None)], OBS)
    d = datetime.date
    ctx = lambda kind: ("0000320193", kind, d(2024, 1, 1) if kind == "duration" else None, d(2024, 12, 31), False)
    inline = spark.createDataFrame([("AAPL-A-1", "us-gaap:Revenues", "parsed", "100.0", "USD", False, ctx("duration")), ("AAPL-A-1", "us-gaap:Assets", "parsed", "51", "USD", False, ctx("instant"))], "document_id string, concept string, status string, value string, unit string, hidden boolean, context struct<cik:string,kind:string,period_start:date,period_end:date,dimensional:boolean>").withColumn("value", F.col("value").cast("decimal(38,6)"))
    facts, issues = engine.resolve_reports(seen, reports, inline)
    assert [(r["metric"], r["value"]) for r in facts.collect()] == [("revenue", "100")]
    found = {r["metric"]: (r["stage"], r["status"], r["reason"]) for r in issues.collect()}
    assert len(found) == 10 and found["assets"][1] == "conflict" and found["liabilities"] == ("reconciliation", "not_verified", "no observation in scope") and found["eps"] == ("resolution", "unresolved", "no annual observation")


def test_engine(spark):
    d = datetime.date
    facts = spark.createDataFrame([("AAPL", "1", y, m, v, "USD", d(y, 1, 1), d(y, 12, 31), f"A-{y}", m) for y, m, v in ((2023, "revenue", "100"), (2024, "revenue", "120"), (2024, "operating_income", "30"))], "ticker string, cik string, fiscal_year int, metric string, value string, unit string, period_start date, period_end date, accession_number string, concept string")
    chunks = spark.createDataFrame([("AAPL", 2024, 1, "Item 1A — Risk Factors", "supply chain risks explain apple suppliers in 2024"), ("AAPL", 2024, 2, "Front matter", "cover page"), ("AAPL", 2023, 3, "Item 1A — Risk Factors", "old supply chain risks")], "ticker string, fiscal_year int, doc_id int, section string, text string")
    vectors = models.embed(chunks).drop("text", "section")
    asked = ["Apple operating margin in 2024", "Apple revenue growth 2023 to 2024", "Explain Apple supply chain risks in 2024", "Explain Microsoft risks in 2024", "Apple net income in 2024", "What of it?"]
    questions = spark.createDataFrame([(i, q, [], []) for i, q in enumerate(asked)], "query_id int, question string, tickers array<string>, years array<int>")
    got = {r["query_id"]: r for r in engine.ask(questions, facts, chunks, vectors).collect()}
    assert got[0]["answer"].endswith("AAPL · operating margin: 25.00%") and got[0]["grounded"]
    assert got[1]["answer"].endswith("AAPL · growth: 20.00%") and got[1]["n_calculations"] == 1
    assert not got[2]["abstained"] and got[2]["citations"] == ["EVIDENCE_2_001"] and not got[2]["grounded"]
    assert got[3]["reason"] == "no evidence for MSFT:2024" and got[4]["reason"] == "unavailable: AAPL 2024 net_income" and got[5]["abstained"]
    refused = engine.ask(questions.where("query_id = 2"), facts, chunks, vectors, synthesize=lambda r: engine.extractive(r).withColumn("text", F.lit("Revenue rose 5%."))).first()
    assert refused["abstained"] and refused["answer"] == "Unable to provide a validated answer." and refused["evidence_ids"] == []
    uncited = engine.ask(questions.where("query_id = 2"), facts, chunks, vectors, synthesize=lambda r: engine.extractive(r).withColumn("citation_ids", F.array(F.lit("EVIDENCE_9_001")))).first()
    assert uncited["reason"].startswith("unknown citation")
