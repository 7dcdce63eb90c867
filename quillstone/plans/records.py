"""Queries of records and their rules: reports, identities, chunks, labels, claims, audits and streams, made of the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.operators import checks, evaluation, evidence, facts, ingestion, store, views, xbrl
from quillstone.operators import text as texts
from quillstone.plans import text as text_plans
from quillstone.session import own_dir, table
from quillstone.sources import filings
from quillstone.streaming import events as streams
from quillstone.streaming import slots, throttle

_RULE = ("check", "key", "reason")


def company_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The companies and years that a corpus is expected to have."""
    return ingestion.slots(spark).select("ticker", "company", "cik", F.col("fiscal_year").cast("long").alias("fiscal_year"))


def report_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as filings: the document's id and address."""
    o = table(spark, sf_dir, "orders")
    number = F.concat_ws("-", F.lpad(F.col("o_custkey").cast("string"), 10, "0"), F.lpad((F.year("o_orderdate") % 100).cast("string"), 2, "0"), F.lpad((F.col("o_orderkey") % 1_000_000).cast("string"), 6, "0"))
    rows = o.select("o_orderkey", F.lit("AAPL").alias("ticker"), F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("cik"), number.alias("accessionNumber"), F.lit("r.htm").alias("primaryDocument"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("reportDate"), F.lit("2000-01-01").alias("filingDate"), F.lit("10-K").alias("form"))
    return ingestion.report_metadata(rows).select("o_orderkey", "document_id", "source_url", "period_end")


def one_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' years as slots, their orders as candidates: one is right, several are not."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").cast("long").alias("fiscal_year"))
    return ingestion.exactly_one(o, ["o_custkey", "fiscal_year"])


def manifest_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a corpus manifest with wrong states, versions, names, dates, checksums and counts here and there."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    number = F.concat_ws("-", F.lpad(k.cast("string"), 10, "0"), F.lit("24"), F.lpad((k % 1_000_000).cast("string"), 6, "0"))
    rows = o.select(
        k.cast("string").alias("ticker"), F.year("o_orderdate").alias("fiscal_year"), F.when(k % 31 == 1, "failed").otherwise("acquired").alias("status"), F.lit("10-K").alias("filing_type"), F.when(k % 31 == 2, "0").otherwise("1").alias("pipeline_version"),
        F.when(k % 31 == 3, "x").otherwise(number).alias("accession_number"), F.when(k % 31 == 4, "a/b.htm").otherwise("a.htm").alias("primary_document"), F.lpad(k.cast("string"), 10, "0").alias("cik"),
        F.when(k % 31 == 7, F.add_months("o_orderdate", 12)).otherwise(F.to_date("o_orderdate")).cast("string").alias("period_end"), F.when(k % 31 == 8, F.lit("1980-01-01")).otherwise("2030-01-01").alias("filing_date"), F.when(k % 31 == 9, "no").otherwise(F.sha2(k.cast("string"), 256)).alias("content_sha256"),
        F.when(k % 31 == 10, 0).otherwise(5).alias("content_byte_count"), F.lit(3).alias("block_count"), k.alias("k"),
    )
    rows = rows.withColumn("document_id", F.when(F.col("k") % 31 == 5, "other").otherwise(F.concat_ws("-", "ticker", "accession_number"))).withColumn("source_url", F.when(F.col("k") % 31 == 6, "http://x/").otherwise(checks.archive_url()))
    slots = rows.where("k % 31 <> 11").select("ticker", "fiscal_year")
    return checks.manifest(rows, slots, "1").where("reason <> 'occurs twice'").select("check", "reason").groupBy("check", "reason").agg(F.count("*").alias("n"))


def stated_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates as filings write them: in four forms, with spaces around commas, and as something else."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 6
    forms = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "MMMM d , yyyy")).when(k == 2, F.date_format("o_orderdate", "MMM d, yyyy")).when(k == 3, F.date_format("o_orderdate", "M/d/yyyy")).when(k == 4, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise("the day after")
    return o.select("o_orderkey", xbrl.dei_date(forms).cast("string").alias("stated"))


def identity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as filings whose stated identity breaks one rule or another against their report."""
    o = table(spark, sf_dir, "orders")
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    stated = o.select(
        k.cast("string").alias("document_id"), F.when(k % 13 == 2, "10-Q").otherwise("10-K").alias("documenttype"), F.when(k % 13 == 3, "true").otherwise("False").alias("amendmentflag"), F.when(k % 13 == 4, "Q1").otherwise("FY").alias("documentfiscalperiodfocus"),
        F.when(k % 13 == 5, F.lit("1900")).otherwise(F.year(day).cast("string")).alias("documentfiscalyearfocus"), F.when(k % 13 == 6, "soon").otherwise(F.date_format(day, "MMMM d, yyyy")).alias("documentperiodenddate"), F.when(k % 13 == 0, F.lit(None)).when(k % 13 == 1, "7").otherwise(F.col("o_custkey").cast("string")).alias("entitycentralindexkey"),
    )
    reports = o.select(k.cast("string").alias("document_id"), F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("cik"), F.year(day).alias("fiscal_year"), F.when(k % 13 == 7, F.date_add(day, 1)).otherwise(day).cast("string").alias("period_end"), F.when(k % 13 == 8, F.date_sub(day, 5)).otherwise(F.date_add(day, 5)).cast("string").alias("filing_date"))
    return xbrl.identity_error(stated, reports)


def inline_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many observations of each order's filing could be read."""
    seen = text_plans.inline_observations(spark, sf_dir).withColumnRenamed("o_orderkey", "document_id")
    return xbrl.summary(seen).withColumnRenamed("document_id", "o_orderkey")


def fact_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reports with one stored fact each, of wrong provenance, concepts, units, values, signs or periods here and there."""
    o = table(spark, sf_dir, "orders")
    k, year = F.col("o_orderkey"), F.year("o_orderdate")
    day = lambda m, d: F.make_date(year, F.lit(m), F.lit(d))
    reports = o.select(k.cast("string").alias("document_id"), F.lit("T").alias("ticker"), year.alias("fiscal_year"), F.lit("A").alias("accession_number"), day(12, 31).cast("string").alias("period_end"))
    rows = o.select(
        k.cast("string").alias("document_id"), F.lit("revenue").alias("metric"), F.when(k % 7 == 1, "U").otherwise("T").alias("ticker"), year.alias("fiscal_year"), F.lit("A").alias("accession_number"), day(12, 31).alias("period_end"), F.when(k % 7 == 2, "Assets").otherwise("Revenues").alias("concept"),
        F.when(k % 7 == 3, "EUR").otherwise("USD").alias("unit"), F.lit("duration").alias("kind"), F.when(k % 7 == 4, "much").when(k % 7 == 5, "-1").otherwise("1").alias("value"), F.when(k % 7 == 6, day(11, 1)).otherwise(day(1, 1)).alias("period_start"),
    )
    return checks.facts(rows, reports, facts.metric_dimension(spark)).groupBy("check", "reason").agg(F.count("*").alias("n"))


def unblocked_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as facts, without those of an order or of a supplier and year that have an open issue for the same flag."""
    x = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_suppkey").alias("ticker"), F.year("l_shipdate").alias("fiscal_year"), F.col("l_returnflag").alias("metric"), "l_partkey")
    issues = table(spark, sf_dir, "lineitem").where("l_quantity = 50").select(F.col("l_orderkey").alias("document_id"), F.when(F.col("l_linenumber") == 1, F.col("l_suppkey")).alias("ticker"), F.year("l_shipdate").alias("fiscal_year"), F.col("l_returnflag").alias("metric"))
    return facts.unblocked(x, issues).groupBy("ticker", "fiscal_year", "metric").agg(F.count("*").alias("n"), F.sum("l_partkey").alias("parts"))


def rank_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances as decimal strings, some signed or with more digits than needed, ranked exactly within a nation."""
    c = table(spark, sf_dir, "customer")
    plain = F.col("c_acctbal").cast("decimal(18,2)").cast("string")
    value = F.when(F.col("c_custkey") % 4 == 0, F.concat(plain, F.lit("000"))).when(F.col("c_custkey") % 10 == 1, F.lit(None)).otherwise(plain)
    rows = c.select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("entity"), value.alias("value"))
    return facts.rank_competition(rows, ["nation"]).select("nation", "entity", F.col("rank").cast("long").alias("rank"))


def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words each chunk of 200 words with 40 of overlap has, over documents as one block each."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.lit(0).alias("ord"), texts.collapse_space(F.col("text")).alias("text"), F.lit("s").alias("section"), F.lit(False).alias("is_table"), F.lit("all").alias("location"))
    return texts.chunk(docs.where("text <> ''"), 200, 40).select(F.col("document_id").alias("doc_id"), F.col("n").cast("long").alias("n"), F.col("token_count").cast("long").alias("token_count"), "location")


def chunk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of their sources, some unknown, changed, blank, too long, or with spans that cannot be."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    span = F.struct(F.lit("a").alias("location"), F.when(k % 11 == 4, 5).otherwise(0).alias("character_start"), F.lit(3).alias("character_end"))
    rows = d.select(
        F.concat(F.col("source"), F.when(k % 11 == 1, "?").otherwise("")).alias("document_id"), k.cast("string").alias("chunk_id"), F.when(k % 11 == 2, "x").otherwise(F.col("source")).alias("ticker"), F.when(k % 11 == 3, " ").otherwise("words").alias("text"),
        F.when(k % 11 == 5, 900).otherwise(10).alias("token_count"), F.when(k % 11 == 6, F.array().cast("array<struct<location:string,character_start:int,character_end:int>>")).otherwise(F.array(span)).alias("source_spans"), F.when(k % 11 == 7, "b").otherwise("a").alias("location"),
    )
    sources = d.select(F.col("source").alias("document_id"), F.col("source").alias("ticker")).distinct().union(spark.createDataFrame([("nothing", "nothing")], "document_id string, ticker string"))
    return checks.chunks(rows, sources, ["ticker"], 700).select(*_RULE)


def citation_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as answers: whether their citations are sound, null for those that abstain."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    ids = F.when(k % 5 == 1, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    rows = o.select(k.cast("string").alias("request_id"), ids.alias("evidence_ids"), F.when(k % 5 == 2, F.array(F.lit("c"))).otherwise(F.array(F.lit("b"))).alias("citations"), F.when(k % 5 == 3, F.array(F.array().cast("array<string>"))).otherwise(F.array(F.array(F.lit("a")))).alias("finding_citations"), (F.col("o_orderstatus") == "P").alias("abstained"))
    rows = rows.withColumn("citations", F.when(F.col("request_id").cast("long") % 5 == 1, F.array(F.lit("a"))).otherwise(F.col("citations")))
    return evaluation.citation_validity(rows).select("request_id", F.col("valid").cast("string").alias("valid"))


def label_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality labels as review labels of documents, of another index, of unknown documents, out of scope, missing or at odds."""
    x = table(spark, sf_dir, "labels")
    k = F.col("doc_id")
    rows = x.select(F.lit("q").alias("question_id"), F.when(k % 9 == 1, k + 10_000_000).otherwise(k).alias("doc_id"), F.when(k % 9 != 3, F.col("quality") == 1).alias("relevant"), F.when(k % 9 == 0, "v0").otherwise("v1").alias("index_signature"), F.when(k % 9 == 2, "x").otherwise("T").alias("ticker"), F.lit(2024).alias("fiscal_year"))
    rows = rows.union(rows.where("doc_id % 9 = 4").withColumn("relevant", ~F.col("relevant")))
    known = table(spark, sf_dir, "documents").select("doc_id", F.lit("T").alias("ticker"), F.lit(2024).alias("fiscal_year"))
    return evaluation.label_errors(rows, known, "v1").select("doc_id", "reason").distinct()


def trace_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by length within their language, in turns over the languages of each source."""
    longest = Window.partitionBy("source", "lang").orderBy(F.desc("n_chars"), "doc_id")
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), "lang", "doc_id", F.row_number().over(longest).alias("rank"))
    return evaluation.traces(d, "lang").select("query_id", "doc_id", F.col("position").cast("long").alias("position"))


def macro_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "events").select("event_type", F.when(F.col("value") > 20, F.round("value", 4).cast("decimal(18,4)")).alias("v"))
    return evaluation.macro(x, ["v"], ["event_type"]).select("event_type", F.round(F.col("v").cast("double"), 4).alias("v"), "v_n")


def claims_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as claims of an answer: one tells an amount, another a movement; together they are refused."""
    x = table(spark, sf_dir, "lineitem")
    said = F.when(F.col("l_returnflag") == "R", "Revenue is described.").when(F.col("l_returnflag") == "A", "Headcount grew.").otherwise("Suppliers vary.")
    rows = x.select(F.col("l_orderkey").cast("string").alias("request_id"), F.col("l_linenumber").alias("claim"), said.alias("text"), F.array().cast("array<int>").alias("allowed_years"))
    return evidence.unsafe_requests(rows)


def abstention_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of events as reasons of abstention, in words."""
    x = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "click", "timeout").when(F.col("event_type") == "error", "some_category").when(F.col("event_type") == "view", F.lit(None)).otherwise("Plain words.").alias("reason"))
    return x.select("event_id", views.abstention(F.col("reason")).alias("said"))


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every metric with its statement and its label."""
    rows = spark.createDataFrame([(m,) for ms in views.STATEMENTS.values() for m in ms] + [("other_metric",)], "metric string")
    return rows.select("metric", views.statement_of(F.col("metric")).alias("statement"), views.label(F.col("metric"), {"eps": "EPS"}).alias("label"))


def present_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields that a customer's record has, by name."""
    c = table(spark, sf_dir, "customer")
    one = F.struct(F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")).alias("nation"), F.col("c_mktsegment").alias("segment"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"))
    got = c.select("c_custkey", views.present(one, ["nation", "segment", "balance"]).alias("m"))
    return got.select("c_custkey", F.array_join(F.array_sort(F.map_keys("m")), ",").alias("fields"), F.col("m")["segment"].alias("segment"))


def last_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs: the last one by date and then by key, with its lines as slots."""
    slot = F.struct(F.col("l_returnflag").alias("ticker"), F.col("l_linenumber").alias("fiscal_year"), F.col("l_linestatus").alias("status"), F.lit("s").alias("stages"), F.lit(None).cast("string").alias("error_category"), F.col("l_partkey").alias("other"))
    slots = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(slot)).alias("slots"))
    runs = table(spark, sf_dir, "orders").join(slots, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("started_at"), "slots")
    out = views.audit_summary(runs)
    return out.select("run_id", "status", F.size("slots").cast("long").alias("n_slots"), F.array_join("slots.ticker", "").alias("flags"))


def source_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source as files of a company: their checksums by address, in order."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("cik"), F.concat(F.lit("u/"), F.col("doc_id").cast("string")).alias("url"), "text")
    found = filings.source_hashes(d.withColumnRenamed("text", "content"))
    return found.select("cik", F.size("hashes").cast("long").alias("n"), F.sha2(F.array_join(F.transform(F.map_entries("hashes"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";"), 256).alias("all"))


def entity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reports of three companies, with wrong names, numbers, forms and dates here and there."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    rows = o.select(
        k.alias("document_id"), F.when(k % 8 == 1, "TSLA").otherwise("AAPL").alias("ticker"), F.when(k % 8 == 2, "Aple").otherwise("Apple").alias("company"), F.when(k % 8 == 3, "1").otherwise("320193").alias("cik"), F.when(k % 8 == 4, F.lit(None)).otherwise(2024).cast("int").alias("fiscal_year"), F.when(k % 8 == 5, "8-K").otherwise("10-K").alias("filing_type"),
        F.when(k % 8 == 6, "1").otherwise("0000320193-24-000001").alias("accession_number"), F.when(k % 8 == 7, "soon").otherwise("2024-09-28").alias("period_end"),
    )
    return store.entity_errors(rows, ingestion.companies(spark))


def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of evidence, each user and kind let in once, written batch by batch to the shared folder and read back."""
    folder = f"{own_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema
    table(spark, sf_dir, "events").repartition(2).write.parquet(f"{folder}/in")
    keyed = streams.read_folder(spark, f"{folder}/in", schema).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.concat_ws("-", F.col("user_id").cast("string"), "event_type"))
    run = streams.run_batches(streams.insert_once(keyed, "k", "3650 days"), lambda df, n: df.select("k").write.mode("append").parquet(f"{folder}/out"), f"{folder}/checkpoint")
    run.awaitTermination()
    return spark.read.schema("k string").parquet(f"{folder}/out")


def slot_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as slots of a streamed ingestion in two runs from one checkpoint: filings that are missing, of another company or year, or no annual
    report fail their slots; the second run brings the right filing of those of another company and reads nothing again."""
    folder = f"{own_dir(spark)}/slots-{uuid.uuid4().hex}"
    kind = F.col("s_suppkey") % 5
    cik, year = F.lpad(F.col("s_suppkey").cast("string"), 10, "0"), 2024

    def landed(own: Column, stated: Column, form: Column) -> DataFrame:
        field = lambda name, value: F.concat(F.lit(f'<ix:nonNumeric name="dei:{name}">'), value, F.lit("</ix:nonNumeric>"))
        page = F.concat(F.lit("<html><body>"), field("DocumentType", form), field("DocumentFiscalYearFocus", stated), field("EntityCentralIndexKey", own), F.lit("<p>"), F.col("s_name"), F.lit("</p></body></html>"))
        ticker = F.concat(F.lit("S"), F.col("s_suppkey"))
        return table(spark, sf_dir, "supplier").select(ticker.alias("ticker"), F.lit(year).alias("fiscal_year"), ticker.alias("document_id"), cik.alias("cik"), F.lit("2025-02-01").alias("filing_date"), F.when(kind > 0, page).alias("content"))

    first = landed(F.when(kind == 1, F.lit("1")).otherwise(cik), F.when(kind == 2, "2020").otherwise("2024"), F.when(kind == 3, "10-K/A").otherwise("10-K"))
    first.repartition(4).write.parquet(f"{folder}/landing")
    slots.start(spark, f"{folder}/landing", folder, per_trigger=2).awaitTermination()
    landed(cik, F.lit("2024"), F.lit("10-K")).where(F.col("document_id").substr(2, 20).cast("long") % 5 == 1).write.mode("append").parquet(f"{folder}/landing")
    slots.start(spark, f"{folder}/landing", folder, per_trigger=2).awaitTermination()
    every = table(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("ticker"), F.lit(year).alias("fiscal_year"))
    found = slots.states(spark, folder, every)
    held = slots.blocks(spark, folder, found).groupBy("ticker").agg(F.max("text").alias("text"))
    return found.join(held, "ticker", "left").select("ticker", "state", "reason", F.col("attempt").cast("long").alias("attempt"), "text")


def timed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests to a host for each kind of event, released 500 ms apart at least as the watermark passes them; a last request an hour later lets the watermark pass them all."""
    folder = f"{own_dir(spark)}/requests-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("host"), F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"))
    end = events.agg(F.max("ts").alias("ts")).select(F.lit("end").alias("host"), F.lit(-1).cast("long").alias("request_id"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"))
    events.write.parquet(f"{folder}/in")
    end.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = streams.read_folder(spark, f"{folder}/in", events.schema, per_trigger=1_000_000)  # at once: events come in no order of time
    with slots.rocks(spark, 2 * spark.sparkContext.defaultParallelism):
        run = throttle.released(stream, spacing=0.5).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("host string, request_id long, go_at double").parquet(f"{folder}/out").select("host", "request_id", F.round(F.col("go_at") * 1000).cast("long").alias("go_at_ms"))


_ALL = (
    company_slots, report_metadata, one_candidate, manifest_rules, stated_dates, identity_rules, inline_summary, fact_rules, unblocked_facts, rank_strings, chunk_counts, chunk_rules, citation_forms, label_rules, trace_order, macro_means, claims_together, abstention_texts, statements,
    present_fields, last_audit, source_hashes, entity_rules, stream_once, slot_runs, timed_requests,
)
QUERIES = {f.__name__: f for f in _ALL}
_STATEMENT_SQL = ", ".join(f"('{m}', '{name}', '{'EPS' if m == 'eps' else m.replace('_', ' ').title()}')" for name, ms in views.STATEMENTS.items() for m in ms) + ", ('other_metric', NULL, 'Other Metric')"
ORACLE_SQL = {
    "slot_runs": """SELECT 'S' || s_suppkey AS ticker, CASE WHEN s_suppkey % 5 IN (1, 4) THEN 'completed' ELSE 'failed' END AS state, CASE s_suppkey % 5 WHEN 0 THEN 'not downloaded' WHEN 2 THEN 'fiscal year differs' WHEN 3 THEN 'not an annual report' END AS reason,
  CAST(CASE WHEN s_suppkey % 5 = 1 THEN 2 ELSE 1 END AS BIGINT) AS attempt, CASE WHEN s_suppkey % 5 IN (1, 4) THEN s_name END AS text FROM supplier""",
    "timed_requests": """SELECT host, request_id, CAST(round(i * 500 + max(epoch_us(ts) / 1000.0 - i * 500) OVER (PARTITION BY host ORDER BY i ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS go_at_ms
FROM (SELECT event_type AS host, event_id AS request_id, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events)""",
    "company_slots": "SELECT ticker, company, cik, fiscal_year FROM (VALUES ('AAPL', 'Apple', '0000320193'), ('MSFT', 'Microsoft', '0000789019'), ('AMZN', 'Amazon', '0001018724')) AS c(ticker, company, cik) CROSS JOIN (SELECT unnest([2022, 2023, 2024]) AS fiscal_year)",
    "report_metadata": """SELECT o_orderkey, 'AAPL-' || a AS document_id, 'https://www.sec.gov/Archives/edgar/data/' || o_custkey || '/' || replace(a, '-', '') || '/r.htm' AS source_url, strftime(o_orderdate, '%Y-%m-%d') AS period_end
FROM (SELECT *, lpad(CAST(o_custkey AS VARCHAR), 10, '0') || '-' || lpad(CAST(year(o_orderdate) % 100 AS VARCHAR), 2, '0') || '-' || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') AS a FROM orders)""",
    "one_candidate": "SELECT o_custkey, year(o_orderdate) AS fiscal_year, count(*) AS n, CASE WHEN count(*) > 1 THEN 'several candidates' END AS reason FROM orders GROUP BY ALL",
    "manifest_rules": """SELECT "check", reason, count(*) AS n FROM (SELECT 'report' AS "check", CASE o_orderkey % 31 WHEN 1 THEN 'not an acquired annual report' WHEN 2 THEN 'other pipeline version' WHEN 3 THEN 'invalid accession number' WHEN 4 THEN 'invalid primary document' WHEN 5 THEN 'document id is not derived' WHEN 6 THEN 'source address is not derived'
  WHEN 7 THEN 'period ends in another year' WHEN 8 THEN 'filed before the period ended' WHEN 9 THEN 'invalid checksum' WHEN 10 THEN 'empty content' END AS reason FROM orders
  UNION ALL SELECT 'slots', 'unexpected' FROM orders WHERE o_orderkey % 31 = 11) WHERE reason IS NOT NULL GROUP BY ALL""",
    "stated_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 5 THEN strftime(o_orderdate, '%Y-%m-%d') END AS stated FROM orders",
    "identity_rules": """SELECT CAST(o_orderkey AS VARCHAR) AS document_id, CASE o_orderkey % 13 WHEN 0 THEN 'identity field missing or stated in several ways' WHEN 1 THEN CASE WHEN o_custkey <> 7 THEN 'CIK differs' END WHEN 2 THEN 'not an annual report' WHEN 3 THEN 'amendment' WHEN 4 THEN 'not a full year' WHEN 5 THEN 'fiscal year differs'
  WHEN 6 THEN 'period end is no date' WHEN 7 THEN 'period end differs' WHEN 8 THEN 'filed before the period ended' END AS reason FROM orders""",
    "inline_summary": "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END AS parsed_count, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS unresolved_count FROM orders",
    "fact_rules": """SELECT "check", reason, count(*) AS n FROM (SELECT 'fact' AS "check", CASE o_orderkey % 7 WHEN 1 THEN 'provenance differs' WHEN 2 THEN 'concept is not one of the metric' WHEN 3 THEN 'unit or kind differs' WHEN 4 THEN 'value is not a finite decimal' WHEN 5 THEN 'negative value' WHEN 6 THEN 'not an annual period' END AS reason FROM orders
  UNION ALL SELECT 'key', 'missing' FROM orders, range(10)) WHERE reason IS NOT NULL GROUP BY ALL""",
    "unblocked_facts": """WITH i AS (SELECT l_orderkey, l_suppkey, l_linenumber, year(l_shipdate) AS y, l_returnflag FROM lineitem WHERE l_quantity = 50)
SELECT l_suppkey AS ticker, year(l_shipdate) AS fiscal_year, l_returnflag AS metric, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS parts FROM lineitem x WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.l_orderkey = x.l_orderkey AND i.l_returnflag = x.l_returnflag)
  AND NOT EXISTS (SELECT 1 FROM i WHERE i.l_linenumber = 1 AND i.l_suppkey = x.l_suppkey AND i.y = year(x.l_shipdate) AND i.l_returnflag = x.l_returnflag) GROUP BY ALL""",
    "rank_strings": "SELECT c_nationkey AS nation, c_custkey AS entity, rank() OVER (PARTITION BY c_nationkey ORDER BY CAST(c_acctbal AS DECIMAL(18,2)) DESC) AS rank FROM customer WHERE c_custkey % 4 = 0 OR c_custkey % 10 <> 1",
    "chunk_counts": r"""WITH d AS (SELECT doc_id, len(list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) AS w FROM documents),
c AS (SELECT doc_id, w, unnest(range(0, CASE WHEN w <= 200 THEN 1 ELSE 1 + CAST(ceil((w - 200) / 160.0) AS BIGINT) END)) AS n FROM d WHERE w > 0)
SELECT doc_id, n, least(200, w - n * 160) AS token_count, 'all' AS location FROM c""",
    "chunk_rules": """SELECT 'chunk' AS "check", CAST(doc_id AS VARCHAR) AS key, CASE doc_id % 11 WHEN 1 THEN 'unknown document' WHEN 2 THEN 'metadata differ from the source' WHEN 3 THEN 'no text' WHEN 4 THEN 'malformed span' WHEN 5 THEN 'over the token budget' WHEN 6 THEN 'no source span' ELSE 'location differs from spans' END AS reason
FROM documents WHERE doc_id % 11 BETWEEN 1 AND 7 UNION ALL SELECT 'coverage', 'nothing', 'source without a chunk'""",
    "citation_forms": "SELECT CAST(o_orderkey AS VARCHAR) AS request_id, CASE WHEN o_orderstatus <> 'P' THEN CASE WHEN o_orderkey % 5 IN (1, 2, 3) THEN 'false' ELSE 'true' END END AS valid FROM orders",
    "label_rules": """SELECT DISTINCT CASE WHEN doc_id % 9 = 1 THEN doc_id + 10000000 ELSE doc_id END AS doc_id, CASE doc_id % 9 WHEN 0 THEN 'reviewed against another index' WHEN 1 THEN 'unknown chunk' WHEN 2 THEN 'chunk out of scope' WHEN 3 THEN 'not labelled' ELSE 'conflicting labels' END AS reason FROM labels
WHERE doc_id % 9 < 5""",
    "trace_order": """WITH r AS (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents)
SELECT source AS query_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY rank, lang, doc_id) AS position FROM r""",
    "macro_means": "SELECT event_type, round(CAST(sum(CASE WHEN value > 20 THEN CAST(round(value, 4) AS DECIMAL(18,4)) END) AS DOUBLE) / count(*) FILTER (value > 20), 4) AS v, count(*) FILTER (value > 20) AS v_n FROM events GROUP BY 1",
    "claims_together": """SELECT CAST(l_orderkey AS VARCHAR) AS request_id, 'narrative holds numbers, changes or addresses' AS reason FROM lineitem GROUP BY l_orderkey HAVING bool_or(l_returnflag = 'R') AND bool_or(l_returnflag = 'A')""",
    "abstention_texts": """SELECT event_id, CASE event_type WHEN 'click' THEN 'The request took too long.' WHEN 'error' THEN 'Some Category.' WHEN 'view' THEN 'The data and evidence at hand do not support an answer.' ELSE 'Plain words.' END AS said FROM events""",
    "statements": f"SELECT metric, statement, label FROM (VALUES {_STATEMENT_SQL}) AS v(metric, statement, label)",
    "present_fields": "SELECT c_custkey, concat_ws(',', CASE WHEN c_acctbal > 0 THEN 'balance' END, CASE WHEN c_custkey % 2 = 0 THEN 'nation' END, 'segment') AS fields, c_mktsegment AS segment FROM customer",
    "last_audit": """WITH l AS (SELECT l_orderkey, count(*) AS n, string_agg(l_returnflag, '' ORDER BY l_returnflag, l_linenumber, l_linestatus, l_partkey) AS flags FROM lineitem GROUP BY 1)
SELECT o_orderkey AS run_id, o_orderstatus AS status, n AS n_slots, flags FROM orders JOIN l ON o_orderkey = l_orderkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1""",
    "source_hashes": "SELECT source AS cik, count(*) AS n, sha256(string_agg('u/' || doc_id || '=' || sha256(text), ';' ORDER BY 'u/' || doc_id)) AS \"all\" FROM documents GROUP BY source",
    "entity_rules": """SELECT o_orderkey AS document_id, CASE o_orderkey % 8 WHEN 1 THEN 'unsupported company' WHEN 2 THEN 'name is not the company''s' WHEN 3 THEN 'CIK is not the company''s' WHEN 4 THEN 'no fiscal year' WHEN 5 THEN 'not an annual report' WHEN 6 THEN 'invalid accession number' ELSE 'invalid period end' END AS reason FROM orders WHERE o_orderkey % 8 <> 0""",
    "stream_once": "SELECT DISTINCT user_id || '-' || event_type AS k FROM events",
}
