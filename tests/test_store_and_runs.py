"""The fact store, indexes, contexts, borders, runs, ledgers and command lines, by small examples."""

import datetime
import json
import threading

import pytest
from pyspark.sql import functions as F

from quillstone import __main__ as cli
from quillstone.functions import models
from quillstone.operators import context, engine, facts, index, ingestion, responses, retrieval, runs, store, text, views
from quillstone.operators.checks import Violated
from quillstone.sources import artifacts
from quillstone.streaming import events as streams

D = datetime.date
REPORT = "document_id string, ticker string, company string, cik string, fiscal_year int, filing_type string, accession_number string, period_end string"
FACT = "document_id string, ticker string, cik string, fiscal_year int, metric string, concept string, value string, unit string, kind string, period_start date, period_end date, accession_number string"
CONTEXT = "struct<cik:string,kind:string,period_start:date,period_end:date,dimensional:boolean>"
POLICIES = {"resolution_policy": "1", "reconciliation_policy": "1"}
A1 = "0000320193-24-000001"


def a_store(spark, value="100", stored_version=None, record=None, candidate_value=None, seen="100", policy="1"):
    reports = spark.createDataFrame([(f"AAPL-{A1}", "AAPL", "Apple", "0000320193", 2024, "10-K", A1, "2024-12-31")], REPORT)
    facts_ = spark.createDataFrame([(f"AAPL-{A1}", "AAPL", "0000320193", 2024, "assets", "us-gaap:Assets", value, "USD", "instant", None, D(2024, 12, 31), A1)], FACT)
    facts_ = facts_.withColumn("concept", F.lit("Assets"))
    observed = spark.createDataFrame([(f"AAPL-{A1}", "us-gaap:Assets", "parsed", seen, "USD", False, ("0000320193", "instant", None, D(2024, 12, 31), False))], f"document_id string, concept string, status string, value string, unit string, hidden boolean, context {CONTEXT}").withColumn("value", F.col("value").cast("decimal(38,6)"))
    candidate = F.struct(*(F.col(c) for c in store.CANDIDATE_FIELDS))
    grid = [m for m, *_ in facts.METRICS]
    of = facts_.withColumn("value", F.lit(candidate_value or value)).select("document_id", "metric", candidate.alias("candidate"))
    records = spark.createDataFrame([(f"AAPL-{A1}", m, "matched" if m == "assets" else "unresolved", None if m == "assets" else "no annual observation", 1 if m == "assets" else None, 0 if m == "assets" else None) for m in grid], "document_id string, metric string, status string, reason string, eligible long, blockers long")
    records = records.join(of, ["document_id", "metric"], "left")
    if record:
        records = records.withColumn("status", F.when(F.col("metric") == "assets", record).otherwise(F.col("status")))
    version = stored_version or store.digest(reports).first()["digest"]
    meta = spark.createDataFrame([(version, policy, "1")], "corpus_version string, resolution_policy string, reconciliation_policy string")
    return {"reports": reports, "facts": facts_, "issues": spark.createDataFrame([], "document_id string, ticker string, fiscal_year int, metric string"), "observations": observed, "records": records, "meta": meta}


def test_store_serves_what_withstands_all_checks(spark):
    good = a_store(spark)
    assert store.violations(good, POLICIES).collect() == [] and store.validated_facts(good, POLICIES).count() == 1
    blocked = good | {"issues": spark.createDataFrame([("x", "AAPL", 2024, "assets")], "document_id string, ticker string, fiscal_year int, metric string")}
    assert store.validated_facts(blocked, POLICIES).count() == 0


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        ({"stored_version": "other"}, "store and corpus disagree"), ({"policy": "0"}, "resolution_policy is missing or outdated"), ({"seen": "101"}, "inline evidence does not validate the fact"), ({"record": "conflict"}, "record is not matched"),
        ({"candidate_value": "99"}, "fact differs from its candidate"), ({"value": "-5", "seen": "-5"}, "negative value"), ({"value": "many", "seen": "1"}, "value is not a finite decimal"),
    ],
)
def test_store_violations(spark, change, reason):
    broken = a_store(spark, **change)
    assert reason in {r["reason"] for r in store.violations(broken, POLICIES).collect()} and store.validated_facts(broken, POLICIES).count() == 0


def test_store_keys(spark):
    one = a_store(spark)
    lacks = one | {"records": one["records"].where("metric <> 'eps'")}
    assert [(r["key"], r["reason"]) for r in store.version_violations(lacks, POLICIES).collect()] == [(f"AAPL-{A1}|eps", "missing")]
    twice = one | {"records": one["records"].union(one["records"].where("metric = 'eps'"))}
    assert [r["reason"] for r in store.version_violations(twice, POLICIES).collect()] == ["occurs twice"]
    two = one["reports"].union(one["reports"].withColumn("document_id", F.lit("other")))
    assert store.validated_facts(one | {"reports": two}, POLICIES).count() == 0
    digest = lambda df: store.digest(df).first()["digest"]
    assert digest(two.repartition(3)) == digest(two.orderBy(F.desc("document_id"))) != digest(one["reports"]) and store.digest(two.limit(0)).first()["n"] == 0


def test_entities_and_gaps(spark):
    rows = [("a", "AAPL", "Apple", "320193", 2024, "10-K", A1, "2024-12-31"), ("b", "TSLA", "Tesla", "1", 2024, "10-K", A1, "2024-12-31"), ("c", "AAPL", "Apple", "5", 2024, "10-K", A1, "2024-12-31"), ("d", "AAPL", "Aple", "320193", 2024, "10-K", A1, "2024-12-31"), ("e", "AAPL", "Apple", "320193", 2024, "10-Q", A1, "2024-12-31"), ("f", "AAPL", "Apple", "320193", None, "10-K", A1, "2024-12-31"), ("g", "AAPL", "Apple", "320193", 2024, "10-K", "1", "2024-12-31"), ("h", "AAPL", "Apple", "320193", 2024, "10-K", A1, "soon")]
    got = {r["document_id"]: r["reason"] for r in store.entity_errors(spark.createDataFrame(rows, REPORT), ingestion.companies(spark)).collect()}
    assert got == {"b": "unsupported company", "c": "CIK is not the company's", "d": "name is not the company's", "e": "not an annual report", "f": "no fiscal year", "g": "invalid accession number", "h": "invalid period end"}
    found = spark.createDataFrame([(320193,), (9,), (0,)], "cik long")
    assert {r["stated"]: r["reason"] for r in store.cik_of(found, spark.createDataFrame(rows[:1], REPORT)).collect()} == {"9": "entity of no report", "0": "invalid CIK"}


CHUNKS = [("AAPL:2024", 1, "Item 1A — Risk Factors", "supply chain risks of apple suppliers"), ("AAPL:2024", 2, "Front matter", "cover page"), ("MSFT:2024", 3, "Item 7 — MD&A", "cloud revenue and margins discussion")]


def test_index_is_built_published_and_loaded(spark, tmp_path):
    chunks = spark.createDataFrame(CHUNKS, "scope string, doc_id long, section string, text string")
    built = index.build(chunks)
    assert index.violations(built, 64).collect() == []
    folder, config = str(tmp_path / "index"), {"chunk_tokens": 700}
    index.publish(built, folder, "v1", config, "corpus")
    loaded = index.load(spark, folder, config, "corpus")
    question = spark.createDataFrame([("q", "supply chain risks")], "query_id string, query string")
    only = spark.createDataFrame([("q", "AAPL:2024")], "query_id string, scope string")
    got = index.search(loaded, question, only).collect()
    assert [(r["doc_id"], r["scope"]) for r in got] == [(1, "AAPL:2024")]
    assert index.search(loaded, question, only, min_score=0.5).count() == 0  # the floor on fused scores
    for other, why in (({"chunk_tokens": 1}, "incompatible configuration"), (config, "disagree")):
        with pytest.raises(ValueError, match=why):
            index.load(spark, folder, other, "corpus" if other is not config else "another")
    part = next((tmp_path / "index" / "version=v1" / "terms").glob("*.parquet"))
    part.write_bytes(part.read_bytes()[:-1] + b"x")
    part.with_name(f".{part.name}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="checksum differs"):
        index.load(spark, folder, config, "corpus")
    assert [r["scope"] for r in index.scopes(chunks).collect()] == ["AAPL:2024", "MSFT:2024"]
    with pytest.raises(Violated, match="no tokens"):
        index.publish(index.build(chunks.withColumn("text", F.lit("..."))), folder, "v2", config, "corpus")
    assert index.manifest_errors({"config": {}}, {}, "c")[0].startswith("incompatible policy")


def test_scores_of_an_index_are_those_of_the_chunks(spark):
    chunks = spark.createDataFrame([(f"s{i % 2}", i, "x", " ".join(["risk", "cloud", "bank"][: 1 + i % 3])) for i in range(12)], "scope string, doc_id long, section string, text string")
    asked = spark.createDataFrame([(1, "risk cloud cloud"), (2, "bank")], "query_id int, query string")
    rows = lambda df: sorted(map(tuple, df.select("query_id", "scope", "doc_id", "score").collect()))
    assert rows(retrieval.bm25_of_index(index.build(chunks), asked)) == rows(retrieval.bm25(chunks, asked))
    only = spark.createDataFrame([(1, "s0"), (2, "s1")], "query_id int, scope string")
    assert {r[:2] for r in rows(retrieval.bm25_of_index(index.build(chunks), asked, only))} <= {(1, "s0"), (2, "s1")}


def test_questions_that_cannot_be_searched(spark):
    asked = spark.createDataFrame([(1, "fine"), (2, " "), (3, "word " * 600), (4, "many"), (5, "lost"), (6, "nowhere")], "query_id int, query string")
    pairs = [(i, "s0") for i in (1, 2, 3)] + [(4, f"s{k}") for k in range(7)] + [(5, "other")]
    known = spark.createDataFrame([(f"s{k}",) for k in range(7)], "scope string")
    got = {r["query_id"]: r["reason"] for r in retrieval.question_errors(asked, spark.createDataFrame(pairs, "query_id int, scope string"), known).collect()}
    assert got == {2: "blank question", 3: "question too long for the reranker", 4: "more scopes than final places", 5: "unknown scope", 6: "no scope"}


def test_section_boost_of_untitled_items(spark):
    rows = spark.createDataFrame([("Item 1 — ",), ("Item 1",), ("Item 1.",), ("Item 1 — Business",)], "section string")
    found = F.array(F.lit("business"))
    assert [round(r[0], 2) for r in rows.select(retrieval.section_boost(found, F.col("section"))).collect()] == [0.2, 0.2, 0.0, 0.35]


def test_context_keeps_facts_and_best_chunks_within_both_budgets(spark):
    rows = [("q", "E1", "f", "A", 2024, 1.0, "f1", "fact text"), ("q", "E2", None, "A", 2024, 0.9, "1", "x" * 100), ("q", "E3", None, "A", 2024, 0.8, "2", "y" * 100), ("q", "E4", None, "B", 2024, 0.1, "3", "z" * 100), ("q", "E5", None, "B", 2024, 0.05, "4", "é" * 100)]
    records = spark.createDataFrame(rows, "query_id string, evidence_id string, fact_id string, ticker string, fiscal_year int, score double, doc_id string, text string")
    asked = spark.createDataFrame([("q", "why?", "[]")], "query_id string, question string, calculations string")
    kept = lambda **b: sorted(r["evidence_id"] for r in context.prepare(records, asked, **b).collect())
    assert kept() == ["E1", "E2", "E3", "E4", "E5"] and kept(characters=330) == ["E1", "E2", "E3", "E4"] and kept(characters=229) == ["E1", "E2", "E4"]
    one = context.prepare(records, asked).collect()
    size = {r["evidence_id"]: len(r["record"].encode()) + 1 for r in one}
    spent = context.summary(context.prepare(records, asked), asked).first()["token_estimate"] - sum(size.values())
    assert kept(tokens=spent + sum(size.values()) - 1) == ["E1", "E2", "E3", "E4"] and kept(tokens=spent + sum(size[e] for e in ("E1", "E2", "E4"))) == ["E1", "E2", "E4"]
    tight = context.prepare(records, asked, characters=10)
    assert not any(r["fits"] for r in tight.collect()) and context.summary(tight, asked, characters=10).first()["reason"] == "evidence exceeds the character budget"
    record = json.loads(next(r["record"] for r in one if r["evidence_id"] == "E1"))
    assert record["application_metadata"]["fact_id"] == "f" and record["untrusted_document_text"] == "fact text" and record["untrusted_document_metadata"] == {}
    assert context.input_budget(131_072, fallback_window=32_768) == 28_720


def test_engine_uses_an_index_and_facts_as_evidence(spark):
    found = spark.createDataFrame([("AAPL", "1", 2024, "revenue", "120", "USD", D(2024, 1, 1), D(2024, 12, 31), "A-2024", "Revenues")], "ticker string, cik string, fiscal_year int, metric string, value string, unit string, period_start date, period_end date, accession_number string, concept string")
    rows = [("AAPL", 2024, 1, "Item 1A — Risk Factors", "supply chain risks explain apple suppliers"), ("MSFT", 2024, 2, "Item 1A — Risk Factors", "supply chain risks explain microsoft suppliers")]
    chunks = spark.createDataFrame(rows, "ticker string, fiscal_year int, doc_id int, section string, text string")
    built = engine.build_index(chunks)
    asked = ["Apple revenue in 2024", "Explain Apple and Microsoft supply chain risks in 2024", "Explain why Apple revenue moved with supply chain risks in 2024"]
    questions = spark.createDataFrame([(i, q, [], []) for i, q in enumerate(asked)], "query_id int, question string, tickers array<string>, years array<int>")
    ask = lambda **how: {r["query_id"]: r for r in engine.ask(questions, found, built["chunks"], built["vectors"], index=built, **how).collect()}
    got = ask()
    assert got[0]["evidence_ids"] == ["EVIDENCE_0_001"] == got[0]["citations"] and got[0]["grounded"]
    assert not got[1]["abstained"] and len(got[1]["citations"]) == 2
    assert got[2]["path"] == "mixed" and got[2]["evidence_ids"] == ["EVIDENCE_2_001", "EVIDENCE_2_002"] and got[2]["citations"] == ["EVIDENCE_2_002"] and "$120.00" in got[2]["answer"]
    partial = ask(synthesize=lambda r: engine.extractive(r).where("claim = 1 OR query_id <> 1"))
    assert partial[1]["reason"] == "citations do not cover MSFT:2024" and partial[1]["abstained"]
    assert ask(tokens=1_500)[1]["reason"] == "evidence and calculations exceed the input budget; narrow the question"


class Echo:
    """A provider that cites the first evidence it is given, or fails."""

    def __init__(self, name, failure=None):
        self.name, self.model, self.failure = name, "m", failure

    def generate(self, messages, seconds):
        if self.failure:
            raise models.ProviderFailure(self.failure, self.name)
        evidence = json.loads(messages[1]["content"])["evidence"]
        ids = [json.loads(e)["application_metadata"]["evidence_id"] for e in evidence]
        return [{"text": "The filing describes suppliers.", "citation_ids": ids}]


def test_engine_with_a_provider(spark):
    none = spark.createDataFrame([], "ticker string, cik string, fiscal_year int, metric string, value string, unit string, period_start date, period_end date, accession_number string, concept string")
    chunks = spark.createDataFrame([("AAPL", 2024, 1, "Item 1A — Risk Factors", "supply chain risks explain apple suppliers")], "ticker string, fiscal_year int, doc_id int, section string, text string")
    questions = spark.createDataFrame([(0, "Explain Apple supply chain risks in 2024", [], [])], "query_id int, question string, tickers array<string>, years array<int>")
    ask = lambda p: engine.ask(questions, none, chunks, models.embed(chunks).drop("text", "section"), synthesize=engine.by_provider(p)).first()
    quiet = {"retries": 0}
    assert ask(models.WithFallback(Echo("a", "timeout"), Echo("b"), **quiet))["answer"] == "The filing describes suppliers."
    assert ask(models.WithFallback(Echo("a", "authentication"), Echo("b"), **quiet))["reason"] == "provider: authentication"


def test_chat_provider():
    sent = []

    def transport(address, headers, body, seconds):
        sent.append((address, headers, body["model"], body["stream"]))
        return replies.pop(0)

    said = json.dumps({"choices": [{"message": {"content": json.dumps({"claims": [{"text": "t", "citation_ids": ["E"]}]})}}]})
    replies = [(200, said), (429, ""), (None, ""), (200, "junk"), (200, said.replace("citation_ids", "ids")), (200, said.replace('"t\\"', 'NaN'))]
    p = models.ChatProvider("a", "m", "https://api.example.com/v1", transport, key="k")
    assert p.generate([{"role": "user", "content": "x"}], 5) == [{"text": "t", "citation_ids": ["E"]}] and sent[0][1] == {"Authorization": "Bearer k"}
    for category in ("rate_limit", "provider_unavailable", "malformed_response", "structured_output_validation_failed"):
        with pytest.raises(models.ProviderFailure, match=category):
            p.generate([], 5)
    with pytest.raises(models.ProviderFailure, match="context_too_large"):
        models.ChatProvider("a", "m", "http://localhost:1/", transport, input_tokens=2_000).generate([{"role": "user", "content": "x" * 2_000}], 5)
    for bad in ("http://api.example.com/", "https://u:p@api.example.com/", "https://api.example.com/?a=b", "ftp://x/"):
        with pytest.raises(ValueError, match="not allowed"):
            models.ChatProvider("a", "m", bad, transport)


def test_windows_of_encoders_and_rerankers(spark):
    vectors = {"a b": [1.0, 0.0], "c": [0.0, 2.0]}
    assert models.pooled_embedding("a b c", vectors.__getitem__, 2) == pytest.approx([0.5**0.5, 0.5**0.5])
    with pytest.raises(ValueError, match="no unit vector"):
        models.pooled_embedding("a b", lambda t: [float("nan"), 1.0], 2)
    prefixed = models.embed(spark.createDataFrame([("x",)], "text string"), prefix=models.QUERY_PREFIX).first()["embedding"]
    assert prefixed == pytest.approx(models.embed(spark.createDataFrame([(models.QUERY_PREFIX + "x",)], "text string")).first()["embedding"])
    rows = spark.createDataFrame([("q", "abc"), ("q", "z")], "query string, text string")
    assert [r[0] for r in rows.select(models.pair_reranker(lambda pairs: [float(len(t)) for _, t in pairs])(F.col("query"), F.col("text"))).collect()] == [3.0, 1.0]
    with pytest.raises(Exception, match="invalid reranker output"):
        rows.select(models.pair_reranker(lambda pairs: [float("inf")] * len(pairs))(F.col("query"), F.col("text"))).collect()
    stored = {}
    receipts = models.model_receipts(["m", "m", "n"], lambda n: n.encode(), stored.__setitem__)
    assert [r["name"] for r in receipts] == ["m", "n"] and stored == {"m": b"m", "n": b"n"} and receipts[0]["byte_count"] == 1
    with pytest.raises(ValueError, match="empty"):
        models.model_receipts(["m"], lambda n: b"", stored.__setitem__)


def test_publication_follows_turns_and_checksums(spark, tmp_path):
    folder = str(tmp_path / "out")
    for n, version in ((1, "b"), (2, "a")):
        artifacts.publish({"t": spark.range(n)}, folder, version, {"k": n})
    assert artifacts.published(spark, folder, "t", verify=True).count() == 2 and artifacts.published(spark, folder, "t", "b").count() == 1
    assert artifacts.manifest(spark, folder)["config"] == {"k": 2}
    with pytest.raises(ValueError, match="not published"):
        artifacts.published(spark, folder, "t", "c")
    tables, error = artifacts.load_guarded(spark, folder, ["t", "u"])
    assert tables == {} and error == "tables are missing: u"
    next((tmp_path / "out" / "version=a" / "t").glob("*.parquet")).unlink()
    assert {r["reason"] for r in artifacts.file_violations(spark, folder, "a").collect()} == {"missing"}
    assert artifacts.load_guarded(spark, str(tmp_path / "none"), ["t"]) == ({}, "artifacts are unreadable or malformed: nothing is published")


def test_ledger_lets_one_of_two_writers_in(spark, tmp_path):
    ledger = artifacts.Ledger(spark, str(tmp_path / "evidence"), "evidence_id string, text string")
    check = lambda there, batch: batch.join(there, "evidence_id", "left_semi").select("evidence_id")
    batch = lambda *ids: spark.createDataFrame([(i, "t") for i in ids], "evidence_id string, text string")
    assert ledger.append(batch("a", "b"), check) == 0 and ledger.append(batch("c"), check) == 1
    with pytest.raises(ValueError, match="a"):
        ledger.append(batch("a", "d"), check)
    assert sorted(r["evidence_id"] for r in ledger.read().collect()) == ["a", "b", "c"]
    both, outcomes = threading.Barrier(2), []

    def slow(there, new):
        found = check(there, new)
        found.count()
        if not both.broken and len(outcomes) == 0 and both.n_waiting < 2:
            try:
                both.wait(20)
            except threading.BrokenBarrierError:
                pass
            both.abort()
        return found

    def write():
        try:
            outcomes.append(ledger.append(batch("x"), slow))
        except ValueError:
            outcomes.append("refused")

    threads = [threading.Thread(target=write) for _ in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(map(str, outcomes)) == ["2", "refused"] and ledger.read().where("evidence_id = 'x'").count() == 1


def test_cache_of_sources(spark, tmp_path):
    folder = str(tmp_path / "cache")
    rows = lambda *r: spark.createDataFrame([(u, bytearray(c)) for u, c in r], "url string, content binary")
    artifacts.store_sources(rows(("u1", b"old"), ("u2", b"two")), folder)
    artifacts.store_sources(rows(("u1", b"new")), folder)
    assert {r["url"]: bytes(r["content"]) for r in artifacts.cached_sources(spark, folder).collect()} == {"u1": b"new", "u2": b"two"}


FILING = (
    '<html xmlns:ix="http://www.xbrl.org/2013/inlineXBRL" xmlns:xbrli="http://www.xbrl.org/2003/instance" xmlns:us-gaap="http://fasb.org/us-gaap/2024" xmlns:iso4217="http://www.xbrl.org/2003/iso4217" xmlns:ixt="http://www.xbrl.org/inlineXBRL/transformation/2020-02-12">'
    '{dei}<xbrli:context id="c"><xbrli:entity><xbrli:identifier scheme="http://www.sec.gov/CIK">320193</xbrli:identifier></xbrli:entity><xbrli:period><xbrli:instant>2024-09-28</xbrli:instant></xbrli:period></xbrli:context>'
    '<xbrli:unit id="u"><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unit><h2>Item 1A. Risk Factors</h2><p>Assets <ix:nonFraction name="us-gaap:Assets" contextRef="c" unitRef="u" format="ixt:numdotdecimal" scale="0">50</ix:nonFraction></p></html>'
)
DEI = {"DocumentType": "10-K", "AmendmentFlag": "false", "DocumentFiscalYearFocus": "2024", "DocumentFiscalPeriodFocus": "FY", "DocumentPeriodEndDate": "2024-09-28", "EntityCentralIndexKey": "320193"}


def filing(**other):
    return FILING.format(dei="".join(f'<ix:nonNumeric name="dei:{k}">{v}</ix:nonNumeric>' for k, v in (DEI | other).items()))


def test_ingestion_run(spark, tmp_path):
    """Nothing is published before the slot has exactly one filing that states its identity; then everything is, and the store validates."""
    slots = ingestion.slots(spark).where("ticker = 'AAPL' AND fiscal_year = 2024")
    columns = "ticker string, accessionNumber string, filingDate string, reportDate string, form string, primaryDocument string"
    rows = [("AAPL", A1, "2024-11-01", "2024-09-28", "10-K", "a.htm"), ("AAPL", "0000320193-24-000002", "2024-11-01", "2024-09-28", "10-K", "b.htm"), ("AAPL", "0000320193-24-000003", "2024-11-01", "2024-09-28", "10-K/A", "c.htm")]
    filings = spark.createDataFrame(rows, columns)
    url = lambda accession, name: f"https://www.sec.gov/Archives/edgar/data/320193/{accession.replace('-', '')}/{name}"
    contents = spark.createDataFrame([(url(A1, "a.htm"), filing()), (url("0000320193-24-000002", "b.htm"), filing(DocumentFiscalYearFocus="2023"))], "source_url string, content string")
    seen = spark.createDataFrame([(320193, "Assets", "USD", "50", None, "2024-09-28", 2024, "FY", "10-K", A1, None)], "cik long, concept string, unit string, val string, start string, end string, fy int, fp string, form string, accn string, dimensions map<string,string>")
    folder = str(tmp_path / "corpus")
    reports, rejected = runs.acquired(filings, contents, slots)
    assert [r["accession_number"] for r in reports.collect()] == [A1] and [(r["accession_number"], r["reason"]) for r in rejected.collect()] == [("0000320193-24-000002", "fiscal year differs")]
    assert runs.ingest(spark, filings, contents.limit(0), seen, folder, "r0", "v0", slots) == "acquisition_incomplete"
    assert {(r["stage"], r["state"]) for r in runs.Audit(spark, f"{folder}/_audit", "r0").read().collect()} == {("run", "acquisition_incomplete"), ("identity", "failed")}
    published = []
    assert runs.ingest(spark, filings, contents, seen, folder, "r1", "v1", slots, POLICIES, index=published.append) == "completed_with_unresolved_metrics"
    assert published[0].where("section LIKE 'Item 1A%'").count() == 2
    tables, error = store.load(spark, folder)
    assert error is None and store.version_violations(tables, POLICIES).collect() == []
    stages = {r["stage"]: r["state"] for r in runs.Audit(spark, f"{folder}/_audit", "r1").read().collect()}
    assert stages["publication"] == "completed" and stages["index"] == "completed" and stages["run"] == "completed_with_unresolved_metrics"
    assert [(r["metric"], r["value"]) for r in tables["facts"].collect()] == [("assets", "50")]
    assert store.reconciliation_violations(tables).collect() == [] and store.validated_facts(tables, POLICIES).count() == 1


def test_evaluation_modes(spark):
    with pytest.raises(ValueError, match="choose"):
        runs.graded(*(spark.range(1).withColumnRenamed("id", "query_id") for _ in range(6)), allow_llm=True, retrieval_only=True)
    empty = spark.createDataFrame([], "status string, recall_5 double, recall_10 double, precision_5 double, mrr double, hit double, structured double, unsupported_abstention double, false_abstention double, citation double, routing double, latency_ms double, retrieval_ms double")
    none = runs.evaluated(empty).first()
    assert none["status"] == "not_yet_evaluated" and none["routing_type_agreement"] is None and none["n_dataset"] == 0 and none["completeness"] is None


def test_evaluations_and_references_are_kept(spark, tmp_path):
    row = spark.createDataFrame([(0.5,)], "mrr double")
    for turn, value in ((0, 0.1), (1, 0.9)):
        runs.write_evaluation(row.withColumn("mrr", F.lit(value)), str(tmp_path / "e"), f"r{turn}", turn)
    assert runs.latest_evaluation(spark, str(tmp_path / "e")).first()["mrr"] == 0.9
    source, prepared = spark.range(3), spark.range(2)
    runs.write_references(prepared, source, str(tmp_path / "r"), "v1")
    rows, meta = runs.references(spark, str(tmp_path / "r"))
    assert rows.count() == 2 and meta["source_digest"] == store.digest(source).first()["digest"]


def test_review_marks_come_back(spark):
    offered = runs.packet(spark.createDataFrame([(1, 10, "a"), (1, 11, "b"), (2, 20, "c")], "query_id int, doc_id long, text string"), "v1")
    marked = offered.withColumn("relevant", F.col("doc_id") != 11)
    dataset = spark.createDataFrame([(1, [], "unreviewed", None), (2, [], "unreviewed", None)], "query_id int, doc_ids array<long>, retrieval_annotation_status string, index_signature string")
    out, bad = runs.apply_packet(dataset, offered, marked.where("doc_id <> 20"), "v1")
    got = {r["query_id"]: (r["doc_ids"], r["retrieval_annotation_status"]) for r in out.collect()}
    assert got == {1: ([10], "reviewed"), 2: ([], "unreviewed")} and [(r["doc_id"], r["reason"]) for r in bad.collect()] == [(20, "candidate left out")]
    chunks = spark.createDataFrame([(10, "A", 2024)], "doc_id long, ticker string, fiscal_year int")
    asked = spark.createDataFrame([(1, [10, 10], "v1", "A", 2024), (2, [10, 99], "v1", "A", 2024)], "query_id int, doc_ids array<long>, index_signature string, ticker string, fiscal_year int")
    relevant, refused = runs.reviewed_labels(asked, chunks, "v1")
    assert [tuple(r) for r in relevant.collect()] == [(1, 10)] and {r["reason"] for r in refused.collect()} == {"unknown chunk"}


def test_borders(spark):
    assert responses.health("x") == {"status": "ok", "service": "x", "health_scope": "liveness"}
    assert responses.provider_flags("k", "m", True, None) == {"primary_configured": True, "fallback_enabled": True, "fallback_configured": False}
    parts = spark.createDataFrame([("corpus", True), ("facts", False)], "component string, ready boolean")
    one = responses.status(parts, {"primary_configured": True}).first()
    assert one["knowledge_state"] == "corpus_only" and not one["rag_ready"] and not one["narrative_ready"] and one["checked_at"].endswith("+00:00")
    expected = spark.createDataFrame([("B", 2024), ("A", 2023)], "ticker string, fiscal_year int")
    assert [(r["ticker"], r["acquired"]) for r in responses.reports(None, expected, 1).collect()] == [("A", False)]
    record = F.struct(F.lit("x").alias("a"))
    assert spark.range(1).select(responses.projected(record, ["a"], ["a", "b"]).alias("r")).first()["r"].asDict() == {"a": "x", "b": None}
    analytics = spark.createDataFrame([("A", 2024, "complete", {"m": "1"}), ("A", 2024, "odd", None)], "ticker string, fiscal_year int, status string, values map<string,string>")
    evidence = spark.createDataFrame([("E1", "t"), ("E2", " ")], "evidence_id string, text string")
    calculations = spark.createDataFrame([("c", "growth", "NaN", [1])], "calculation_id string, metric string, value string, inputs array<int>")
    assert {(r["check"], r["reason"]) for r in responses.envelope_violations(analytics, evidence, calculations).collect()} == {("analytics", "occurs twice"), ("analytics", "unknown status"), ("evidence", "no text"), ("calculation", "value is not a finite decimal")}
    assert {r["reason"] for r in responses.question_violations(spark.createDataFrame([], "question_id string, question_type string, question string")).collect()} == {"no questions"}
    assert views.canonical_digest(F.lit("1")) is not None


def test_numbers_that_json_does_not_have(spark):
    rows = spark.createDataFrame([('{"a": NaN}',), ('{"a": [Infinity]}',), ('{"a": 1e999}',), ('{"b": 1, "a": 2}',), ('{"a":2,"b":1}',)], "j string")
    got = [r[0] for r in rows.select(views.canonical_digest(F.col("j"))).collect()]
    assert got[:3] == [None] * 3 and got[3] == got[4] is not None


def test_pages_of_documents(spark):
    files = spark.createDataFrame([("d", bytearray(b"one\x0c\x0cthree")), ("e", None)], "k string, raw binary")
    got = text.page_blocks(files, "k", "raw", lambda b: b.decode().split("\x0c")).collect()
    assert [(r["document_id"], r["location"], r["text"]) for r in got] == [("d", "page-1", "one"), ("d", "page-3", "three")]


def test_throttled_stream(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, 0) + datetime.timedelta(seconds=s)
    schema = "host string, request_id int, ts timestamp"
    folder = str(tmp_path / "in")
    for rows in ([("a", 1, at(0)), ("a", 2, at(0)), ("b", 3, at(5))], [("a", 4, at(0)), ("a", 5, at(9))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = streams.throttled(stream).writeStream.format("memory").queryName("throttled").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    base = at(0).timestamp()
    got = {r["request_id"]: round(r["go_at"] - base, 2) for r in spark.table("throttled").collect()}
    assert got[3] == 5.0 and got[5] == 9.0 and sorted(got[i] for i in (1, 2, 4)) == [0.0, 0.25, 0.5]


def test_command_lines(spark, tmp_path, capsys):
    path = lambda n: str(tmp_path / n)
    spark.createDataFrame([(0, "Apple revenue in 2024", [], [], None, None)], "query_id int, question string, tickers array<string>, years array<int>, annotation_status string, reviewed_version string").write.parquet(path("q"))
    spark.createDataFrame([("AAPL", "1", 2024, "revenue", "120", "USD", D(2024, 1, 1), D(2024, 12, 31), "A", "Revenues")], "ticker string, cik string, fiscal_year int, metric string, value string, unit string, period_start date, period_end date, accession_number string, concept string").write.parquet(path("f"))
    chunks = spark.createDataFrame([("AAPL", 2024, 1, "Item 1", "explain apple words in 2024")], "ticker string, fiscal_year int, doc_id int, section string, text string")
    chunks.write.parquet(path("c"))
    models.embed(chunks).drop("text", "section").write.parquet(path("v"))
    assert cli.run(["ask", "--questions", path("q"), "--facts", path("f"), "--chunks", path("c"), "--vectors", path("v"), "--output", path("a")], spark) == 0
    assert "$120.00" in spark.read.parquet(path("a")).first()["answer"]
    assert cli.run(["prepare", "--questions", path("q"), "--facts", path("f"), "--output", path("p"), "--version", "v1"], spark) == 0
    assert runs.references(spark, path("p"))[0].first()["reference"] == "derived"
    artifacts.publish({"reports": spark.createDataFrame([("d", 2024)], "document_id string, fiscal_year int")}, path("corpus"), "v1")
    assert cli.run(["index", "--chunks", path("c"), "--corpus", path("corpus"), "--index", path("i"), "--version", "v1"], spark) == 0
    assert artifacts.published(spark, path("i"), "postings", verify=True).count() == 5
    review = ["export-review", "--questions", path("q2"), "--chunks", path("c"), "--vectors", path("v"), "--output", path("packet"), "--signature", "s"]
    spark.createDataFrame([(0, "Explain Apple words in 2024", [], [])], "query_id int, question string, tickers array<string>, years array<int>").write.parquet(path("q2"))
    assert cli.run(review, spark) == 0 and spark.read.parquet(path("packet")).first()["relevant"] is None
    marked = spark.read.parquet(path("packet")).withColumn("relevant", F.lit(True))
    marked.write.parquet(path("marked"))
    spark.createDataFrame([(0, [], "unreviewed", None)], "query_id int, doc_ids array<int>, retrieval_annotation_status string, index_signature string").write.parquet(path("set"))
    apply = lambda signature, out: cli.run(["apply-review", "--dataset", path("set"), "--original", path("packet"), "--labelled", path("marked"), "--output", path(out), "--signature", signature], spark)
    assert apply("s", "done") == 0 and spark.read.parquet(path("done")).first()["doc_ids"] == [1]
    assert apply("t", "no") == 1 and "another index" in capsys.readouterr().err and apply("s", "set") == 1
    with pytest.raises(SystemExit):
        cli.run(["nothing"], spark)


def test_words_or_windows_that_cancel_out_still_have_a_vector(spark):
    codes = {}
    for n in range(2_000):  # two words of one dimension and opposite signs
        code = models._word_code(f"w{n}")
        codes.setdefault(code % 64, {}).setdefault(code >> 63, f"w{n}")
    one, other = (next(v for v in codes.values() if len(v) == 2)[k] for k in (0, 1))
    texts = [f"{one} {other}", one, " ".join([one] * 380 + [other] * 380), " ", "", None]
    got = [r["embedding"] for r in models.embed(spark.createDataFrame([(t,) for t in texts], "text string")).collect()]
    assert got[0] == got[1] == got[2] and sum(abs(x) for x in got[0]) == 1
    assert got[3] == got[4] == got[5] == [0.0] * 64
    with pytest.raises(ValueError, match="no unit vector"):
        models.pooled_embedding("a b", lambda t: [0.0, 0.0], 2)
