"""Whole runs: acquisition and publication of a corpus, and the evaluation of answers against references.

A run is a few plans over all slots or all questions. What fails in one slot is a row with a reason; publication is a gate at the end.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import engine, evaluation, ingestion, store, text, xbrl
from quillstone.operators import facts as fact_ops
from quillstone.session import settled, utc_now
from quillstone.sources import artifacts


def acquired(filings: DataFrame, contents: DataFrame, slots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reports, rejected) out of filings (ticker, accessionNumber, filingDate, reportDate, form, primaryDocument) and contents
    (source_url, content string): for every slot (ticker, company, cik, fiscal_year) the one candidate whose content states the slot's identity.

    A slot without exactly one such candidate has no report; rejected rows (ticker, fiscal_year, accession_number, reason) say why."""
    candidates, clashing = ingestion.candidate_filings(filings, ["ticker"])
    known = ingestion.report_metadata(candidates.join(slots, ["ticker", "fiscal_year"])).orderBy("ticker", "fiscal_year", "accession_number")
    fetched = settled(known.join(contents.select("source_url", "content"), "source_url", "left"), "fetched")
    stated = xbrl.identities(fetched.where("content IS NOT NULL"), "document_id", "content")
    errors = xbrl.identity_error(stated, fetched.select("document_id", "cik", "fiscal_year", "period_end", "filing_date"))
    judged = fetched.join(errors, "document_id", "left").withColumn("reason", F.when(F.col("content").isNull(), "not downloaded").otherwise(F.col("reason")))
    judged = settled(judged, "judged")
    good = judged.where("reason IS NULL").drop("reason")
    single = ingestion.exactly_one(good, ["ticker", "fiscal_year"]).where("n = 1").select("ticker", "fiscal_year")
    reports = good.join(single, ["ticker", "fiscal_year"], "left_semi").withColumns({"status": F.lit("acquired"), "content_sha256": F.sha2("content", 256), "content_byte_count": F.octet_length("content").cast("long")})
    several = good.join(single, ["ticker", "fiscal_year"], "left_anti").select("ticker", "fiscal_year", "accession_number", F.lit("several candidates").alias("reason"))
    rejected = judged.where("reason IS NOT NULL").select("ticker", "fiscal_year", "accession_number", "reason").union(several)
    rejected = rejected.union(clashing.select("ticker", F.lit(None).cast("int"), "accessionNumber", "reason"))
    return reports, rejected


@dataclass
class Audit:
    """The record of a run: one row for each change of a stage, appended when it happens; the last row of a stage is its state."""

    spark: SparkSession
    folder: str
    run_id: str

    def note(self, stage: str, state: str, detail: str = "", slots: DataFrame | None = None) -> None:
        """Appends a state, for each slot (ticker, fiscal_year) where slots are given."""
        base = slots.select("ticker", "fiscal_year") if slots is not None else self.spark.range(1).select(F.lit(None).cast("string").alias("ticker"), F.lit(None).cast("int").alias("fiscal_year"))
        turn = F.lit(len(self._turns))
        self._turns.append(stage)
        row = base.select(F.lit(self.run_id).alias("run_id"), turn.alias("turn"), "ticker", F.col("fiscal_year").cast("int"), F.lit(stage).alias("stage"), F.lit(state).alias("state"), F.lit(detail).alias("detail"), utc_now().alias("updated_at"))
        row.coalesce(1).write.mode("append").parquet(self.folder)

    def __post_init__(self) -> None:
        self._turns: list[str] = []

    def read(self) -> DataFrame:
        """The last state of each stage and slot of this run."""
        rows = self.spark.read.parquet(self.folder).where(F.col("run_id") == self.run_id)
        return rows.groupBy("ticker", "fiscal_year", "stage").agg(F.max_by(F.struct("state", "detail", "updated_at"), "turn").alias("s")).select("ticker", "fiscal_year", "stage", "s.*")


def ingest(spark: SparkSession, filings: DataFrame, contents: DataFrame, seen: DataFrame, folder: str, run_id: str, version: str, slots: DataFrame | None = None, policies: dict[str, str] | None = None, index: Callable[[DataFrame], None] | None = None) -> str:
    """Acquires every slot, reads and reconciles its facts, and publishes the corpus if no slot is missing; returns the run's status.

    seen: company-facts observations. Tables: reports, blocks, observations, records, facts, issues, meta. `index` is called with the
    published blocks' sections at the end. Each stage is noted in the audit at folder/_audit, failures too."""
    audit = Audit(spark, f"{folder}/_audit", run_id)
    slots = slots if slots is not None else ingestion.slots(spark)
    policies = policies or {}
    audit.note("run", "running")
    try:
        reports, rejected = acquired(filings, contents, slots)
        reports = settled(reports, "reports")
        missing = slots.select("ticker", "fiscal_year").join(reports, ["ticker", "fiscal_year"], "left_anti")
        missing = settled(missing, "missing")
        audit.note("identity", "completed", slots=reports)
        audit.note("identity", "failed", slots=missing)
        if not missing.isEmpty():
            rejected.coalesce(1).write.mode("append").parquet(f"{folder}/_rejected/run_id={run_id}")
            audit.note("run", "acquisition_incomplete")
            return "acquisition_incomplete"
        blocks = text.carry_sections(text.html_blocks(reports, "document_id", "content"))
        inline = settled(xbrl.observations(reports, "document_id", "content"), "inline")
        audit.note("inline_extraction", "completed", slots=reports)
        typed = inline.withColumn("value", F.col("value").try_cast("decimal(38,6)"))
        facts, issues, records = (settled(t, "resolved") for t in resolved(seen, reports, typed))
        audit.note("inline_reconciliation", "completed", slots=reports)
        manifest = settled(reports.drop("content"), "manifest")
        stamp = store.digest(manifest).select(F.col("digest").alias("corpus_version"), *(F.lit(v).alias(k) for k, v in sorted(policies.items())))
        audit.note("publication", "in_progress")
        artifacts.publish({"reports": manifest, "blocks": blocks, "observations": typed, "records": records, "facts": facts, "issues": issues, "meta": stamp}, folder, version)
        audit.note("publication", "completed")
        if index is not None:
            audit.note("index", "in_progress")
            index(artifacts.published(spark, folder, "blocks", version))
            audit.note("index", "completed")
        state = "completed" if issues.isEmpty() else "completed_with_unresolved_metrics"
        audit.note("run", state)
        return state
    except Exception as error:
        audit.note("run", "failed", type(error).__name__)
        raise


def resolved(seen: DataFrame, reports: DataFrame, inline: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, issues, records): the three ways a metric of a report can go, and for each metric the record of its reconciliation."""
    facts, issues = engine.resolve_reports(seen, reports, inline)
    spark = seen.sparkSession
    inputs = facts.select("document_id", "metric", store.qualified(F.col("concept")).alias("concept"), F.col("value").try_cast("decimal(38,6)").alias("value"), "unit", "cik", "kind", "period_start", "period_end")
    checked = fact_ops.reconcile(inputs, inline)
    candidate = facts.select("document_id", "metric", F.struct(*(F.col(c) for c in store.CANDIDATE_FIELDS)).alias("candidate"))
    grid = reports.select("document_id").crossJoin(F.broadcast(fact_ops.metric_dimension(spark).select("metric").distinct()))  # documents by eleven metrics
    records = grid.join(checked, ["document_id", "metric"], "left").join(candidate, ["document_id", "metric"], "left")
    said = issues.select("document_id", "metric", F.col("status").alias("i_status"), F.col("reason").alias("i_reason"))
    records = records.join(said, ["document_id", "metric"], "left")
    return facts, issues, records.select("document_id", "metric", F.coalesce("status", "i_status").alias("status"), F.coalesce("reason", "i_reason").alias("reason"), "eligible", "blockers", "candidate")


# What is measured, of which the last three never are, and what each is a mean over.
METRICS = {
    "structured_regression_correctness": "structured", "unsupported_abstention_correctness": "unsupported_abstention", "false_abstention_on_structured_references": "false_abstention",
    "citation_id_validity": "citation", "routing_type_agreement": "routing", "mean_total_latency_ms": "answer_requests_executed", "mean_retrieval_attempt_latency_ms": "retrieval_requests_attempted",
    "semantic_groundedness": None, "narrative_correctness": None, "completeness": None,
}


def graded(dataset: DataFrame, responses: DataFrame, expected: DataFrame, actual: DataFrame, rankings: DataFrame, relevant: DataFrame, allow_llm: bool = False, retrieval_only: bool = False) -> DataFrame:
    """One record for each question of a dataset, with its status and what could be measured; null where nothing could.

    dataset (query_id, question_type); responses (query_id, question_type, path, abstained, evidence_ids, citations, finding_citations, provider,
    model, fallback_used, latency_ms, retrieval_ms): what the engine said. expected and actual (query_id, kind, ticker, metric, unit, fiscal_year,
    value decimal, period_start): facts and calculations. rankings (query_id, rank, doc_id), null where retrieval failed; relevant: reviewed labels."""
    if allow_llm and retrieval_only:
        raise ValueError("choose generation or retrieval alone")
    keys = [c for c in expected.columns if c != "query_id"]
    same = evaluation.structured_correctness(actual.select("query_id", *keys), expected, keys, "query_id").join(expected.select("query_id").distinct(), "query_id", "left_semi").select("query_id", F.col("correct").cast("double").alias("exact"))
    valid = evaluation.citation_validity(responses.withColumn("request_id", F.col("query_id").cast("string"))).select(F.col("request_id").alias("v_id"), F.col("valid").cast("double").alias("valid"))
    scores = evaluation.retrieval_metrics(rankings.where("doc_id IS NOT NULL"), relevant).select("query_id", F.col("recall_5"), "recall_10", "precision_5", "mrr", "hit")
    labelled, ranked = relevant.select("query_id").distinct().withColumn("labelled", F.lit(True)), rankings.where("doc_id IS NOT NULL").select("query_id").distinct().withColumn("ranked", F.lit(True))
    r = responses.withColumnsRenamed({"question_type": "actual_type"})
    rows = dataset.select("query_id", "question_type").join(r, "query_id", "left").join(same, "query_id", "left").join(valid, F.col("query_id").cast("string") == F.col("v_id"), "left")
    rows = rows.join(scores, "query_id", "left").join(labelled, "query_id", "left").join(ranked, "query_id", "left")
    rag = F.coalesce(F.col("path").isin("rag", "mixed"), F.lit(False))
    status = (
        F.when(F.col("labelled").isNull(), "skipped_no_reviewed_retrieval_labels").when(~rag, "skipped_non_retrieval_route").when(F.col("ranked").isNull(), "retrieval_failed").otherwise("retrieval_executed")
        if retrieval_only else F.when(rag & F.lit(not allow_llm), "skipped_llm_disabled").when(F.col("actual_type").isNull(), "failed").otherwise("executed")
    )
    rows = rows.withColumn("status", status)
    ran, searched = F.col("status") == "executed", F.col("status").isin("retrieval_executed", "retrieval_failed")
    unsupported = F.col("question_type") == "UNSUPPORTED"
    measured = ran & F.col("labelled") & F.col("ranked") | (F.col("status") == "retrieval_executed")
    keep = lambda when, c: F.when(when, c)
    return rows.select(
        "query_id", "question_type", "actual_type", "status", (F.col("actual_type") == F.col("question_type")).cast("double").alias("routing"),
        keep(ran & ~unsupported, F.col("exact")).alias("structured"), keep(ran & unsupported, (F.col("abstained") & (F.col("actual_type") == "UNSUPPORTED") & (F.col("path") == "abstain")).cast("double")).alias("unsupported_abstention"),
        keep(ran & ~unsupported & F.col("exact").isNotNull(), F.col("abstained").cast("double")).alias("false_abstention"), keep(ran, F.col("valid")).alias("citation"),
        *(keep(measured, F.col(c)).alias(c) for c in ("recall_5", "recall_10", "precision_5", "mrr", "hit")), keep(ran, F.col("latency_ms")).alias("latency_ms"), keep(searched, F.col("retrieval_ms")).alias("retrieval_ms"),
        keep(ran, F.col("provider")).alias("provider"), keep(ran, F.col("model")).alias("model"), keep(ran, F.col("fallback_used")).alias("fallback_used"),
    )


def evaluated(records: DataFrame) -> DataFrame:
    """One row over graded records: every metric with its denominator, null where nothing was measured, and the run's status."""
    mean = {"structured": "structured_regression_correctness", "unsupported_abstention": "unsupported_abstention_correctness", "false_abstention": "false_abstention_on_structured_references", "citation": "citation_id_validity", "routing": "routing_type_agreement"}
    ran, searched = F.col("status") == "executed", F.col("status").isin("retrieval_executed", "retrieval_failed")
    out = records.agg(
        *(F.avg(c).alias(f"retrieval_{c}") for c in ("recall_5", "recall_10", "precision_5", "mrr", "hit")), *(F.avg(c).alias(m) for c, m in mean.items()),
        *(F.lit(None).cast("double").alias(m) for m, d in METRICS.items() if d is None), F.avg("latency_ms").alias("mean_total_latency_ms"), F.avg("retrieval_ms").alias("mean_retrieval_attempt_latency_ms"),
        F.count("mrr").alias("n_retrieval_scored"), *(F.count(c).alias(f"n_{c}") for c in mean), F.count_if(ran).alias("n_answer_requests_executed"), F.count_if(searched).alias("n_retrieval_requests_attempted"), F.count("*").alias("n_dataset"),
    )
    return out.withColumn("status", F.when(F.col("n_answer_requests_executed") + F.col("n_retrieval_requests_attempted") > 0, "completed").otherwise("not_yet_evaluated"))


def stage_latency(stages: DataFrame) -> DataFrame:
    """(stage, mean, observations) of (query_id, stage, ms)."""
    return stages.groupBy("stage").agg(F.avg("ms").alias("mean"), F.count("ms").alias("observations"))


def provider_responses(records: DataFrame) -> DataFrame:
    """(provider, model, fallback_used, response_count), in order."""
    some = records.where("provider IS NOT NULL").select("provider", F.coalesce("model", F.lit("")).alias("model"), F.coalesce("fallback_used", F.lit(False)).alias("fallback_used"))
    return some.groupBy("provider", "model", "fallback_used").agg(F.count("*").alias("response_count")).orderBy("provider", "model", "fallback_used")


def reviewed_labels(dataset: DataFrame, chunks: DataFrame, signature: str) -> tuple[DataFrame, DataFrame]:
    """(relevant, refused) of a dataset's reviewed labels (query_id, doc_ids array, index_signature, ticker, fiscal_year): each id once, of this index,
    known and in scope; one bad id refuses its question's labels."""
    labels = dataset.select(F.col("query_id").alias("question_id"), F.explode(F.array_distinct("doc_ids")).alias("doc_id"), F.lit(True).alias("relevant"), "index_signature", "ticker", "fiscal_year")
    refused = evaluation.label_errors(labels, chunks, signature)
    good = labels.join(refused.select("question_id").distinct(), "question_id", "left_anti")
    return good.select(F.col("question_id").alias("query_id"), "doc_id"), refused


def packet(candidates: DataFrame, signature: str) -> DataFrame:
    """A review packet of candidates (query_id, position, doc_id, text, …): each with the checksum of its excerpt and the index it is from, unlabelled."""
    return candidates.withColumns({"relevant": F.lit(None).cast("boolean"), "excerpt_sha256": F.sha2("text", 256), "index_signature": F.lit(signature)})


def apply_packet(dataset: DataFrame, original: DataFrame, labelled: DataFrame, signature: str) -> tuple[DataFrame, DataFrame]:
    """(dataset with the ids that reviewers marked, violations): every candidate labelled once, no excerpt changed, none added or left out, and
    of this index. With a violation the question stays as it was."""
    keys = ["query_id", "doc_id"]
    was = original.select(*keys, F.col("excerpt_sha256").alias("was"), F.lit(True).alias("offered"))
    joined = was.join(labelled.select(*keys, "relevant", F.sha2("text", 256).alias("now"), F.col("index_signature").alias("signed"), F.lit(True).alias("returned")), keys, "full_outer")
    clash = labelled.groupBy(*keys).agg((F.count_distinct("relevant") > 1).alias("clash"))
    joined = joined.join(clash, keys, "left")
    reason = (
        F.when(F.col("offered").isNull(), "not a candidate").when(F.col("returned").isNull(), "candidate left out").when(~F.col("signed").eqNullSafe(F.lit(signature)), "reviewed against another index")
        .when(~F.col("was").eqNullSafe(F.col("now")), "excerpt was changed").when(F.col("relevant").isNull(), "not labelled").when(F.col("clash"), "conflicting labels")
    )
    bad = joined.select(*keys, reason.alias("reason")).where("reason IS NOT NULL").distinct()
    good = labelled.where("relevant").join(bad.select("query_id").distinct(), "query_id", "left_anti").groupBy("query_id").agg(F.array_sort(F.collect_set("doc_id")).alias("marked"))
    out = dataset.join(good, "query_id", "left").withColumn("retrieval_annotation_status", F.when(F.col("marked").isNotNull(), "reviewed").otherwise(F.col("retrieval_annotation_status")))
    out = out.withColumn("index_signature", F.when(F.col("marked").isNotNull(), F.lit(signature)).otherwise(F.col("index_signature"))).withColumn("doc_ids", F.coalesce("marked", "doc_ids")).drop("marked")
    return out, bad


def write_evaluation(row: DataFrame, folder: str, run_id: str, turn: int) -> None:
    """Adds an evaluation under its run; `latest_evaluation` follows the turn."""
    row.withColumns({"run_id": F.lit(run_id), "turn": F.lit(turn).cast("long"), "created_at": utc_now()}).coalesce(1).write.mode("append").parquet(folder)


def latest_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(folder)
    return rows.agg(F.max_by(F.struct(*rows.columns), F.struct("turn", "run_id")).alias("r")).where("r IS NOT NULL").select("r.*")


def write_references(prepared: DataFrame, source: DataFrame, folder: str, version: str) -> None:
    """Prepared references with the digests of what they were made from and of themselves; what is there already is never replaced."""
    one, two = store.digest(source).first()["digest"], store.digest(prepared).first()["digest"]
    artifacts.publish({"references": prepared}, folder, version, {"source_digest": one, "prepared_digest": two})


def references(spark: SparkSession, folder: str, version: str | None = None) -> tuple[DataFrame, dict]:
    """(references, metadata), after their digest has been compared."""
    found = artifacts.manifest(spark, folder, version)
    rows = artifacts.published(spark, folder, "references", found["version"], verify=True)
    if store.digest(rows).first()["digest"] != found["config"]["prepared_digest"]:
        raise ValueError("references differ from those prepared")
    return rows, json.loads(json.dumps(found["config"]))
