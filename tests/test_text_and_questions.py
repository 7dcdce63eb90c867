"""Text, XBRL, retrieval, routing, evidence, evaluation, constraints, sources and streams, by examples."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from quillstone.functions import markup
from quillstone.operators import checks, evaluation, evidence, ingestion, retrieval, routing, text, xbrl
from quillstone.sources import artifacts
from quillstone.streaming import events as streams

IX = (
    '<html xmlns:ix="http://www.xbrl.org/2013/inlineXBRL" xmlns:xbrli="http://www.xbrl.org/2003/instance" xmlns:us-gaap="http://fasb.org/us-gaap/2024" xmlns:iso4217="http://www.xbrl.org/2003/iso4217" xmlns:ixt="http://www.xbrl.org/inlineXBRL/transformation/2020-02-12">'
    '<xbrli:context id="c"><xbrli:entity><xbrli:identifier scheme="http://www.sec.gov/CIK">320193</xbrli:identifier></xbrli:entity><xbrli:period><xbrli:startDate>2024-01-01</xbrli:startDate><xbrli:endDate>2024-12-31</xbrli:endDate></xbrli:period></xbrli:context>'
    '<xbrli:unit id="u"><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unit>%s</html>'
)
FACT = '<ix:nonFraction name="us-gaap:Revenues" contextRef="c" unitRef="u" format="ixt:numdotdecimal" scale="6">1,234.50</ix:nonFraction>'


def test_inline_facts():
    one = xbrl.observations_of(IX % FACT)[0]
    assert (one["status"], one["value"], one["concept"], one["unit"], one["scale"], one["hidden"]) == ("parsed", "1234500000.00", "us-gaap:Revenues", "USD", 6, False)
    assert one["context"]["kind"] == "duration" and one["context"]["cik"] == "0000320193" and not one["context"]["dimensional"]
    assert xbrl.observations_of(IX % f"<ix:hidden>{FACT}</ix:hidden>")[0]["hidden"] and xbrl.observations_of(IX % f'<div style="DISPLAY : none">{FACT}</div>')[0]["hidden"]
    for bad, why in ((FACT.replace("us-gaap:R", "own:R"), "undeclared prefix"), (FACT.replace('"u"', '"x"'), "unknown unit"), (FACT.replace("ixt:numdot", "ixt:other"), "unsupported transformation"), (FACT.replace("1,234.50", "12,34"), "unsupported presentation"), (FACT.replace('"6"', '"19"'), "invalid scale")):
        assert xbrl.observations_of(IX % bad)[0]["reason"] == why
    doubled = IX.replace("<xbrli:unit", '<xbrli:context id="c"></xbrli:context><xbrli:unit') % FACT
    assert xbrl.observations_of(doubled)[0]["reason"] == "id occurs twice"


@pytest.mark.parametrize(("shown", "fmt", "value"), [("1,234.50", "numdotdecimal", "1234.50"), ("1.234,50", "numcommadecimal", "1234.50"), ("1 234.50", "numdotdecimal", "1234.50"), ("1\xa0234.50", "numdotdecimal", "1234.50"), (".50", "", "0.50"), ("-25", "", "-25"), ("1 2", "numdotdecimal", None), ("12,34", "numdotdecimal", None), ("(100)", "", None), ("—", "", None), ("1,234 567", "numdotdecimal", None)])
def test_numbers(shown, fmt, value):
    if value is None:
        with pytest.raises(xbrl.Unreadable):
            xbrl.number_of(shown, fmt)
    else:
        assert xbrl.number_of(shown, fmt) == value
        assert xbrl.number_of(shown.lstrip("-"), fmt, sign="-") == "-" + value.lstrip("-")


def test_identity(spark):
    html = "".join(f'<ix:nonNumeric name="dei:{k}">{v}</ix:nonNumeric>' for k, v in {"DocumentType": "10-K", "AmendmentFlag": "false", "DocumentFiscalYearFocus": "2024", "DocumentFiscalPeriodFocus": "FY", "DocumentPeriodEndDate": "September 28 , 2024", "EntityCentralIndexKey": "320193"}.items())
    rows = [("D", html), ("E", html.replace("10-K", "10-Q")), ("F", html.replace("September", "October")), ("G", html + '<b name="dei:DocumentType">10-K/A</b>'), ("H", html.replace("320193", "1"))]
    reports = spark.createDataFrame([(k, "0000320193", 2024, "2024-09-28", "2024-11-01") for k, _ in rows], "document_id string, cik string, fiscal_year int, period_end string, filing_date string")
    got = xbrl.identity_error(xbrl.identities(spark.createDataFrame(rows, "k string, raw string"), "k", "raw"), reports)
    assert {r["document_id"]: r["reason"] for r in got.collect()} == {"D": None, "E": "not an annual report", "F": "period end differs", "G": "identity field missing or stated in several ways", "H": "CIK differs"}


def test_blocks_and_sections(spark):
    page = "<nav>n</nav><p>Intro</p><h2>Item 1A. Risk Factors</h2><div><p>One</p><p>One</p></div><table><tr><td>Item 7.</td><td>MD&amp;A</td></tr><tr><td>a</td><td>b</td></tr></table><p style='display: none'>x</p><p>Two</p>"
    rows = text.carry_sections(text.html_blocks(spark.createDataFrame([("D", page)], "k string, h string"), "k", "h")).orderBy("ord").collect()
    assert [(r["text"], r["section"], r["is_table"]) for r in rows] == [
        ("Intro", "Front matter", False), ("Item 1A. Risk Factors", "Item 1A — Risk Factors", False), ("One", "Item 1A — Risk Factors", False), ("Item 7. | MD&A\na | b", "Item 7 — MD&A a b", True), ("Two", "Item 7 — MD&A a b", False),
    ]


def test_chunks_of_long_runs_do_not_count_the_rest_each_time():
    """What is counted grows with the text, not with its square; the ranges are those of a plain version."""
    counted = [0]

    def count(piece):
        counted[0] += len(piece)
        return len(piece.split())

    long = "some words here " * 4_000
    ranges = list(text.split_text(long, 50, 10, count))
    assert len(ranges) > 290 and counted[0] < 400 * len(long) and ranges[0][0] == 0 and ranges[-1][1] == len(long)
    assert all(len(long[a:b].split()) <= 50 for a, b in ranges) and all(b1 > b0 and a1 < b0 for (_, b0), (a1, b1) in zip(ranges, ranges[1:]))


def test_statements():
    from quillstone.operators import views

    assert "revenue" in views.compared_metrics() and "revenue_growth" not in views.compared_metrics()


def test_chunk_examples():
    assert list(text.split_text("a b c d e", 5, 2, text.words)) == [(0, 9)]
    words = " ".join(f"w{i}" for i in range(30))
    parts = [words[a:b].split() for a, b in text.split_text(words, 10, 2, text.words)]
    assert parts[0][-2:] == parts[1][:2] and parts[-1][-1] == "w29" and all(len(p) <= 10 for p in parts)
    with pytest.raises(ValueError):
        list(text.split_text("a", 2, 2, text.words))


def test_chunks_keep_their_sources(spark):
    rows = [("D", i, " ".join(f"t{i}x{j}" for j in range(7)), f"b{i}", "S" if i < 4 else "T", False) for i in range(6)] + [("D", 9, "r1 | a\nr2 | b\nr3 | c", "tab", "T", True)]
    blocks = spark.createDataFrame(rows, "document_id string, ord int, text string, location string, section string, is_table boolean")
    got = text.chunk(blocks, 10, 3).collect()
    source = {r[3]: r[2] for r in rows}
    for r in got:
        assert r["token_count"] <= 10 and len({s["location"] for s in r["source_spans"]}) == len(r["source_spans"])
        assert " ".join("\n".join(source[s["location"]][s["character_start"] : s["character_end"]] for s in r["source_spans"]).split()) == " ".join(r["text"].split())
    covered = {(s["location"], p) for r in got for s in r["source_spans"] for p in range(s["character_start"], s["character_end"])}
    assert all((loc, p) in covered for loc, t in source.items() for p, c in enumerate(t) if not c.isspace())
    assert len({r["chunk_id"] for r in got}) == len(got) and any(s["table_row_start"] == 1 for r in got for s in r["source_spans"])


def test_normalize(spark):
    assert spark.createDataFrame([("ﬁ  x\n",), (None,)], "t string").select(text.normalize(F.col("t"))).collect()[0][0] == "fi x"


def test_rrf_example(spark):
    rows = [(1, 1, "A", 1, 1), (1, 1, "A", 2, 1), (1, 1, "A", 3, 2), (1, 1, "B", 1, 2), (1, 1, "B", 2, 3)]
    out = retrieval.rrf(spark.createDataFrame(rows, "query_id int, scope int, list string, rank int, doc_id int"))
    assert {r["doc_id"]: round(r["score"], 9) for r in out.collect()} == {1: round(1 / 61, 9), 2: round(1 / 63 + 1 / 61, 9), 3: round(1 / 62, 9)}


def test_promotion(spark):
    rows = [("g", 1, 0.9, False, True), ("g", 2, 0.2, True, False), ("g", 3, 0.1, True, False), ("h", 4, 0.9, False, True), ("i", 5, 0.9, True, False), ("i", 6, 0.8, False, True), ("j", 7, 0.2, True, False)]
    out = retrieval.threshold_or_promote(spark.createDataFrame(rows, "scope string, doc_id int, score double, relevant boolean, wrong boolean").withColumn("query_id", F.lit(1)))
    assert {r["doc_id"]: r["how"] for r in out.collect()} == {2: "promoted", 4: "threshold", 5: "threshold"}


def test_interleave(spark):
    rows = [("a", 1, 1, "x"), ("a", 2, 2, "y"), ("b", 3, 1, "x"), ("b", 4, 2, "z"), ("c", 5, 1, "w")]
    out = retrieval.interleave(spark.createDataFrame(rows, "scope string, doc_id int, rank int, text string").withColumn("query_id", F.lit(1)), "scope", ["text"], 4)
    assert [r["doc_id"] for r in out.orderBy("position").collect()] == [1, 5, 2, 4]


def route(spark, question, tickers=(), years=()):
    return routing.route(spark.createDataFrame([(1, question, list(tickers), list(years))], "query_id int, question string, tickers array<string>, years array<int>")).first()


@pytest.mark.parametrize(
    ("question", "kind", "path", "metric", "years"),
    [
        ("What was Apple revenue in FY2024?", "FACT", "structured", "revenue", [2024]), ("Microsoft operating margin in 2024", "CALCULATION", "structured", "operating_margin", [2024]), ("AAPL revenue 2022-2024", "COMPARISON", "structured", "revenue", [2022, 2023, 2024]),
        ("AAPL revenue growth from 2022 to 2024", "CALCULATION", "structured", "revenue", [2022, 2024]), ("Which company had the highest revenue growth between 2022 and 2024?", "MULTI_DOCUMENT", "structured", "revenue", [2022, 2024]),
        ("Explain Apple supply chain risks in 2024", "RISK", "rag", None, [2024]), ("Discuss Amazon net sales in 2023", "EXPLANATION", "mixed", "revenue", [2023]), ("Apple cash in 2024", "UNSUPPORTED", "abstain", None, [2024]), ("Apple free cash flow margin 2023", "CALCULATION", "structured", "fcf_margin", [2023]),
    ],
)
def test_routes(spark, question, kind, path, metric, years):
    r = route(spark, question)
    assert (r["question_type"], r["path"], r["metric"], r["years"]) == (kind, path, metric, years)


@pytest.mark.parametrize(
    ("question", "reason"),
    [
        ("Tesla revenue 2024", "company outside the corpus"), ("Should I buy Apple in 2024", "predictions and advice are unsupported"), ("Apple revenue fy24", "use four-digit fiscal years"), ("Apple revenue 2024 to 2022", "year range is reversed"), ("Apple revenue 2019", "year outside the corpus"),
        ("Apple quarterly revenue 2024", "only consolidated annual metrics are available"), ("revenue 2024", "name a company"), ("Apple revenue", "name a fiscal year"), ("Apple growth 2022 to 2024", "name the metric of the calculation"), ("Apple revenue growth 2024", "growth needs two distinct years"), ("Apple in 2024", "neither a metric nor a narrative intent"),
    ],
)
def test_refusals(spark, question, reason):
    assert route(spark, question)["reason"] == reason


def test_selectors_are_used_where_the_question_names_none(spark):
    r = route(spark, "revenue please", ["MSFT", "AAPL", "MSFT"], [2024, 2022, 2024])
    assert r["tickers"] == ["MSFT", "AAPL"] and r["years"] == [2022, 2024]


@pytest.mark.parametrize(("prose", "years", "category"), [("Suppliers are diverse.", (), "qualitative_or_reference"), ("As its 2024 Form 10-K tells, Item 1A lists risks.", (2024,), "qualitative_or_reference"), ("In fiscal year 2023 demand shifted.", (), "ambiguous"), ("Sales rose.", (), "ambiguous"), ("about 5 %", (), "quantitative"), ("three sites", (), "ambiguous"), ("paid ¥", (), "quantitative"), ("https://x.y", (), "prohibited_external_reference"), ("½ of it", (), "ambiguous"), (None, (), "ambiguous"), ("a\x00b", (), "ambiguous")])
def test_prose(prose, years, category):
    assert evidence.narrative_category(prose, set(years)) == category


def test_claims_together(spark):
    rows = [("r", 1, "Revenue is described.", []), ("r", 2, "Headcount grew.", []), ("s", 1, "Suppliers vary.", [])]
    out = evidence.unsafe_requests(spark.createDataFrame(rows, "request_id string, claim int, text string, allowed_years array<int>"))
    assert [r["request_id"] for r in out.collect()] == ["r"]


def test_each_text_is_judged_once(spark, monkeypatch):
    """200 claims of two texts, one of them without years: the guard sees three rows."""
    seen, whole = [], evidence.narrative
    monkeypatch.setattr(evidence, "narrative", lambda claims: seen.append(claims.count()) or whole(claims))
    rows = [(f"r{i % 50}", i, ("Revenue is described.", "Headcount grew.")[i % 4 == 1], None if i % 4 == 3 else []) for i in range(200)]
    out = evidence.unsafe_requests(spark.createDataFrame(rows, "request_id string, claim int, text string, allowed_years array<int>"))
    assert {r["request_id"] for r in out.collect()} == {f"r{i}" for i in range(1, 50, 2)} and seen == [3]


def test_citations(spark):
    registry = spark.createDataFrame([("r", "E1", "A", 2024), ("r", "E2", "B", 2024)], "request_id string, evidence_id string, ticker string, fiscal_year int")
    claims = spark.createDataFrame([("r", 1, "t", ["E1"]), ("r", 2, " ", ["E1"]), ("r", 3, "t", []), ("r", 4, "t", ["E9"])], "request_id string, claim int, text string, citation_ids array<string>")
    assert sorted(r["claim"] for r in evidence.citation_errors(claims, registry).collect()) == [2, 3, 4]
    asked = registry.select("request_id", "ticker", "fiscal_year")
    assert [r["ticker"] for r in evidence.uncovered(asked, claims, registry).collect()] == ["B"]
    ids = evidence.register(spark.createDataFrame([("r", i) for i in range(12)], "request_id string, ord int"))
    assert sorted(r["evidence_id"] for r in ids.collect())[-1] == "EVIDENCE_r_012"
    batch = spark.createDataFrame([("E1", "x"), ("E3", "y"), ("E3", "z"), ("E4", "")], "evidence_id string, text string")
    assert {(r["evidence_id"], r["reason"]) for r in evidence.append_once(registry, batch).collect()} == {("E1", "exists"), ("E3", "occurs twice"), ("E4", "no text")}


def test_budget(spark):
    rows = [("q", 1, "a", 0.9, 50), ("q", 2, "a", 0.8, 30), ("q", 3, "b", 0.1, 40), ("q", 4, "a", 0.7, 30)]
    records = spark.createDataFrame(rows, "query_id string, doc_id int, g string, score double, chars int")
    keep = lambda n: sorted(r["doc_id"] for r in evidence.fit_budget(records, n, ["query_id"], ["g"], F.col("chars")).collect())
    assert keep(1000) == [1, 2, 3, 4] and keep(120) == [1, 2, 3] and keep(90) == [1, 3]
    assert not evidence.fit_budget(records, 10, ["query_id"], ["g"], F.col("chars")).first()["fits"]


def test_retrieval_metrics(spark):
    ranking = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (1, "b", 3), (1, "c", 4), (2, "z", 1), (3, "q", 1)], "query_id int, doc_id string, rank int")
    relevant = spark.createDataFrame([(1, "b"), (1, "x"), (2, "none")], "query_id int, doc_id string")
    got = {r["query_id"]: r for r in evaluation.retrieval_metrics(ranking, relevant).collect()}
    assert (got[1]["recall_5"], got[1]["precision_5"], got[1]["mrr"], got[1]["hit"]) == (0.5, 0.2, 0.5, 1.0) and got[2]["mrr"] == 0 and got[3]["mrr"] is None
    mean = evaluation.macro(evaluation.retrieval_metrics(ranking, relevant), ["mrr"]).first()
    assert mean["mrr"] == 0.25 and mean["mrr_n"] == 2


def test_bags(spark):
    one = spark.createDataFrame([("q", "1.0"), ("q", "1.00"), ("r", "2")], "k string, v string").withColumn("v", F.col("v").cast("decimal(20,4)"))
    two = spark.createDataFrame([("q", "1"), ("r", "2.000")], "k string, v string").withColumn("v", F.col("v").cast("decimal(20,4)"))
    assert {r["k"]: r["correct"] for r in evaluation.structured_correctness(one, two, ["v"], "k").collect()} == {"q": False, "r": True}
    responses = spark.createDataFrame([("a", ["E1"], ["E1"], [["E1"]], False), ("b", ["E1"], ["E2"], [["E2"]], False), ("c", [], [], [], True), ("d", ["E1"], ["E1"], [[]], False)], "request_id string, evidence_ids array<string>, citations array<string>, finding_citations array<array<string>>, abstained boolean")
    assert {r["request_id"]: r["valid"] for r in evaluation.citation_validity(responses).collect()} == {"a": True, "b": False, "c": None, "d": False}


def test_checks(spark):
    rows = spark.createDataFrame([(1, 5), (1, 6), (2, None)], "k int, v int")
    bad = checks.all_of(checks.duplicates(rows, "k", ["k"]), checks.row_violations(rows, "v", F.col("k"), [(F.col("v").isNull(), "no value"), (F.col("v") > 5, "large")]))
    assert {(r["key"], r["check"], r["reason"]) for r in checks.first_of(bad).collect()} == {("1", "k", "occurs twice"), ("2", "v", "no value")}
    with pytest.raises(checks.Violated):
        checks.require_empty(bad)
    checks.require_empty(bad.where("false"))


def test_manifest(spark):
    good = ("AAPL", "0000320193", 2024, "10-K", "acquired", "0000320193-24-000123", "AAPL-0000320193-24-000123", "a.htm", "2024-11-01", "2024-09-28", "https://www.sec.gov/Archives/edgar/data/320193/000032019324000123/a.htm", "a" * 64, 5, 7, "v")
    schema = "ticker string, cik string, fiscal_year int, filing_type string, status string, accession_number string, document_id string, primary_document string, filing_date string, period_end string, source_url string, content_sha256 string, content_byte_count long, block_count int, pipeline_version string"
    slots = spark.createDataFrame([("AAPL", 2024), ("MSFT", 2024)], "ticker string, fiscal_year int")
    assert [(r["check"], r["key"], r["reason"]) for r in checks.manifest(spark.createDataFrame([good], schema), slots, "v").collect()] == [("slots", "MSFT|2024", "missing")]
    names = [x.split()[0] for x in schema.split(", ")]
    for field, value, reason in (("status", "failed", "not an acquired annual report"), ("pipeline_version", "w", "other pipeline version"), ("content_sha256", "zz", "invalid checksum"), ("filing_date", "2024-01-01", "filed before the period ended"), ("block_count", 0, "empty content"), ("primary_document", "a.pdf", "invalid primary document")):
        row = tuple(value if n == field else v for n, v in zip(names, good, strict=True))
        assert reason in [r["reason"] for r in checks.manifest(spark.createDataFrame([row], schema), slots.limit(1), "v").collect()]


def test_urls(spark):
    rows = {"https://www.sec.gov/a": None, "http://www.sec.gov/a": "not https", "https://u:p@www.sec.gov/": "credentials", "https://www.sec.gov:443/": "port", "https://evil.com/": "host is not allowed", "https://www.sec.gov/a?b": "query", "https://www.sec.gov/a#b": "fragment", "x": "no host"}
    got = spark.createDataFrame([(u,) for u in rows], "u string").select("u", checks.url_error(F.col("u"), ["www.sec.gov"]).alias("r")).collect()
    assert {r["u"]: r["r"] for r in got} == rows


def test_candidates_and_transpose(spark):
    rows = [("AAPL", "0000320193-24-000123", "2024-11-01", "2024-09-28", "10-K", "a.htm")] * 2 + [("AAPL", "0000320193-23-000106", "2023-11-03", "2023-09-30", "10-K/A", "b.htm"), ("AAPL", "bad", "2023-11-03", "2023-09-30", "10-K", "b.htm"), ("AAPL", "0000320193-22-000108", "2022-10-28", "", "10-K", "c.htm"), ("MSFT", "0000950170-24-087843", "x", "2024-06-30", "10-K", "d.htm"), ("MSFT", "0000950170-24-087843", "y", "2024-06-30", "10-K", "d.htm")]
    good, bad = ingestion.candidate_filings(spark.createDataFrame(rows, "ticker string, accessionNumber string, filingDate string, reportDate string, form string, primaryDocument string"), ["ticker"])
    assert [(r["accessionNumber"], r["fiscal_year"]) for r in good.collect()] == [("0000320193-24-000123", 2024)] and [r["ticker"] for r in bad.collect()] == ["MSFT"]
    table = spark.createDataFrame([(1, ["a", "b"], [1, 2]), (2, ["a"], [1, 2]), (3, None, [1])], "k int, x array<string>, y array<int>")
    rows_, refused = ingestion.transpose(table, ["k"], ["x", "y"])
    assert [(r["x"], r["y"]) for r in rows_.orderBy("ord").collect()] == [("a", 1), ("b", 2)] and {r["k"]: r["reason"] for r in refused.collect()} == {2: "lengths differ", 3: "column missing"}
    assert ingestion.slots(spark).count() == 9
    flags = spark.createDataFrame([("a", True), ("b", False)], "component string, ready boolean")
    assert ingestion.readiness(flags).first()["missing"] == ["b"]


def test_artifacts(spark, tmp_path):
    one = spark.createDataFrame([(1,)], "x int")
    artifacts.publish({"t": one}, str(tmp_path / "p"), "v1")
    artifacts.publish({"t": one.withColumn("x", F.lit(2))}, str(tmp_path / "p"), "v2")
    assert artifacts.published(spark, str(tmp_path / "p"), "t").first()["x"] == 2 and artifacts.published(spark, str(tmp_path / "p"), "t", "v1").first()["x"] == 1
    with pytest.raises(ValueError):
        artifacts.published(spark, str(tmp_path / "p"), "t", "v9")
    assert artifacts.read_json(spark, str(tmp_path / "none"), "x int", default=one).count() == 1
    (tmp_path / "bad.json").write_text("{oops")
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST"):
        artifacts.read_json(spark, str(tmp_path / "bad.json"), "x int").collect()
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "f").write_bytes(b"abc")
    sha = "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    meta = spark.createDataFrame([("f", 1, sha, 3)], "path string, format int, sha256 string, byte_count long")
    assert artifacts.cached_bytes(spark, str(tmp_path / "c"), meta).first()["usable"]
    assert artifacts.cached_bytes(spark, str(tmp_path / "c"), meta.withColumn("byte_count", F.lit(4))).first()["reason"] == "length differs"
    with pytest.raises(ValueError):
        artifacts.write_guarded(one, str(tmp_path / "s"), str(tmp_path / "s/"))


def test_streams(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, m // 60, m % 60)
    rows = [(i, at(m), "e", float(i)) for i, m in enumerate([0, 5, 61, 62, 130])] + [(0, at(1), "e", 0.0)]
    batch = spark.createDataFrame(rows, "event_id int, ts timestamp, event_type string, value double")
    batch.write.parquet(str(tmp_path / "in"))
    stream = streams.read_folder(spark, str(tmp_path / "in"), batch.schema)
    query = streams.windowed(stream, "1 hour").writeStream.format("memory").queryName("windows").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, streams.windowed(batch, "1 hour").collect()))
    seen: list[int] = []
    streams.run_batches(streams.insert_once(stream, "event_id"), lambda df, _: seen.extend(r["event_id"] for r in df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert sorted(seen) == [0, 1, 2, 3, 4]
    assert streams.sessions(batch.withColumn("user_id", F.lit(1)), "30 minutes").count() == 3


def test_section_carry_reads_whole_texts(spark, tmp_path):
    """Against brute force: headings of other roles keep their titles, and long texts that begin like one are none."""
    from quillstone.plans import text as plans

    turns = [(1, 0, "assistant", "Item 7. Discussion of results"), (1, 1, "assistant", "Item 7 " + "goes on and on " * 300), (1, 2, "user", "hello"), (1, 3, "system", "Item 3. " + "t" * 150), (2, 0, "assistant", "Item 1 " + "x" * 300), (2, 1, "assistant", "plain")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    expected, last = {}, {}
    for conv, turn, role, shown in turns:
        shown = f"Item {turn % 9 + 1}. user" if role == "user" else shown
        if (found := re.match(r"Item (\d+)[.]?\s*(.*)", shown)) and len(shown.strip()) < 250:
            last[conv] = f"Item {found[1]} — {found[2] if len(found[2]) < 120 else ''}"
        expected[conv, turn] = last.get(conv, "Front matter")
    assert {(r["conv_id"], r["turn"]): r["section"] for r in plans.section_carry(spark, str(tmp_path)).collect()} == expected
    assert expected[1, 1] == "Item 7 — Discussion of results" and expected[2, 1] == "Front matter"


def test_tasks_grow_with_rows(spark):
    """4 cores: at least 8 tasks, and no more than so many rows in one."""
    from quillstone.session import spread

    assert spread(spark.range(1000).coalesce(1), 100).rdd.getNumPartitions() == 10 and spread(spark.range(10).coalesce(1), 100).rdd.getNumPartitions() == 8


def test_plain_pages_need_no_parser(monkeypatch):
    """A page of plain tags and text is cut at its tags; any other goes through the parser; both give one tree."""
    dump = lambda e: e if isinstance(e, str) else (e.full, e.attrs, e.ns, [dump(c) for c in e.children])

    def parsed(page):
        builder = markup._Builder()
        builder.feed(page)
        builder.close()
        return builder.root

    plain = [IX % FACT, "<P Class='a&amp;b' class=\"c\">x &lt; y<br/><td>1<td>2</td ></P>tail &am", '<a:b xmlns:a="u"><a:c/>\n</a:b></i>', "", "a > b"]
    odd = ["a < b<p>", "<!-- <b> --><p>x", '<a b="1>2">x</a>', "<script>a</b></script><p>", "<a b=c>x", '<a b="1"c="2">', "<p", "<?x?>y", "</p a>"]
    for page in plain:
        assert dump(markup._quick(page)) == dump(parsed(page))
    for page in odd:
        assert markup._quick(page) is None and dump(markup.parse(page)) == dump(parsed(page))
    monkeypatch.setattr(markup._Builder, "feed", None)
    assert xbrl.observations_of(IX % FACT)[0]["status"] == "parsed"
