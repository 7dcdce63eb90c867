"""What crosses the engine's border: answers, questions, references, evidence, reports and status, each with its rules.

A rule gives violation rows; nothing is repaired. The functions stand for the service's endpoints, over batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators import facts as fact_ops
from quillstone.operators.checks import REQUEST_ID, all_of, duplicates, first_reason, row_violations, set_difference
from quillstone.session import utc_now

# Kinds of questions.
QUESTION_TYPES = ("FACT", "COMPARISON", "CALCULATION", "MULTI_DOCUMENT", "EXPLANATION", "RISK", "UNSUPPORTED")


def response_violations(responses: DataFrame, requests: DataFrame) -> DataFrame:
    """Answers (request_id, abstained, grounded, evidence_ids, citations) to requests (request_id): each to a request, of a valid form, not
    both abstained and grounded, with evidence of its own request, each piece once, and citations among it."""
    prefix = F.concat(F.lit("EVIDENCE_"), F.col("request_id"), F.lit("_"))
    ids, cited = F.coalesce("evidence_ids", F.array().cast("array<string>")), F.coalesce("citations", F.array().cast("array<string>"))
    rules = [
        (~F.coalesce(F.col("request_id").rlike(REQUEST_ID), F.lit(False)), "malformed request id"), (F.col("abstained").isNull() | F.col("grounded").isNull(), "invalid form"), (F.col("abstained") & F.col("grounded"), "abstained and grounded"),
        (F.exists(ids, lambda x: x.isNull()), "evidence without an id"), (F.size(F.array_distinct(ids)) != F.size(ids), "evidence occurs twice"),
        (F.exists(ids, lambda x: ~x.startswith(prefix)), "evidence of another request"), (F.size(F.array_except(cited, ids)) > 0, "unknown citation"),
    ]
    return all_of(set_difference(responses, requests, "request", ["request_id"]), duplicates(responses, "request", ["request_id"]), row_violations(responses, "response", F.col("request_id"), rules))


def question_violations(questions: DataFrame, most: int = 2_000) -> DataFrame:
    """An evaluation set (question_id, question_type, question): ids that are there and unique, known types, questions that can be asked."""
    rules = [(F.coalesce("question_id", F.lit("")) == "", "no id"), (~F.coalesce(F.col("question_type").isin(*QUESTION_TYPES), F.lit(False)), "unknown type"), (F.trim(F.coalesce("question", F.lit(""))) == "", "blank question"), (F.char_length("question") > most, "question too long")]
    empty = questions.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("questions").alias("check"), F.lit("").alias("key"), F.lit("no questions").alias("reason"))
    return all_of(empty, duplicates(questions, "question", ["question_id"]), row_violations(questions, "question", F.coalesce("question_id", F.lit("")), rules))


def reference_violations(references: DataFrame) -> DataFrame:
    """Expected facts and calculations (question_id, ord, ticker, metric, unit, fiscal_year, value string, years, period_start string): identity,
    a year, a finite number, and for growth how many years it spans."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    rules = [
        (blank("ticker") | blank("metric") | blank("unit"), "no identity or unit"), (~F.coalesce(F.col("fiscal_year").between(1, 9999), F.lit(False)), "invalid fiscal year"), (fact_ops.native(F.col("value")).isNull(), "value is not a finite decimal"),
        (F.col("years") <= 0, "invalid number of years"), (F.col("metric").isin("growth", "cagr") & F.col("years").isNull(), "growth without its years"), (F.col("period_start").isNotNull() & blank("period_start"), "invalid period start"),
    ]
    return row_violations(references, "reference", F.concat_ws("|", "question_id", F.col("ord").cast("string")), rules)


def projected(record: Column, have: list[str], fields: list[str], kind: str = "string") -> Column:
    """The named fields of a struct that has `have`; those it lacks are null."""
    return F.struct(*((record[f] if f in have else F.lit(None)).cast(kind).alias(f) for f in fields))


def evidence_by_id(ledger: DataFrame, wanted: DataFrame) -> DataFrame:
    """(evidence_id, record columns, reason) of ids asked for: the stored record if its id is well-formed and echoed and its text is not blank."""
    w = wanted.select(F.col("evidence_id").alias("asked")).distinct()
    joined = w.join(ledger, F.col("asked") == F.col("evidence_id"), "left")
    reason = first_reason([(~F.col("asked").rlike(r"^EVIDENCE_[0-9A-Za-z]+_[0-9]{3,}$"), "malformed id"), (F.col("evidence_id").isNull(), "not found"), (F.trim(F.coalesce("text", F.lit(""))) == "", "record has no text")])
    out = joined.withColumn("reason", reason)
    return out.select(F.col("asked").alias("evidence_id"), *(F.when(F.col("reason").isNull(), F.col(c)).alias(c) for c in ledger.columns if c != "evidence_id"), "reason")


def reports(manifest: DataFrame | None, expected: DataFrame, most: int | None = None) -> DataFrame:
    """The acquired reports in order, or the expected ones, marked so, where nothing is published; the first `most` for an overview."""
    found = manifest.withColumn("acquired", F.lit(True)) if manifest is not None else expected.withColumn("acquired", F.lit(False))
    ordered = found.orderBy("ticker", "fiscal_year")
    return ordered.limit(most) if most is not None else ordered


def report_rows(reports: DataFrame, analytics: DataFrame) -> DataFrame:
    """Reports with their company's and year's figures, where there are any."""
    return reports.join(analytics, ["ticker", "fiscal_year"], "left")


def health(service: str) -> dict:
    """That the service runs; nothing about what it can answer."""
    return {"status": "ok", "service": service, "health_scope": "liveness"}


def status(parts: DataFrame, provider: dict[str, bool], spark_time: bool = True) -> DataFrame:
    """One row of readiness out of parts (component, ready): which parts are missing, what can be asked, and the state to show.

    provider: whether the primary's and the fallback's settings are complete. `knowledge_state` climbs from empty over facts to all."""
    has = lambda name: F.coalesce(F.bool_or((F.col("component") == name) & F.col("ready")), F.lit(False))
    names = ("corpus", "index", "models", "facts", "coverage")
    one = parts.agg(*(has(n).alias(n) for n in names))
    missing = F.array_compact(F.array(*(F.when(~F.col(n), F.lit(n)) for n in names)))
    rag = F.col("corpus") & F.col("index") & F.col("models") & F.col("facts")
    state = F.when(~F.col("corpus"), "empty").when(~F.col("facts"), "corpus_only").when(~rag, "facts_only").when(~F.col("coverage"), "partial").otherwise("complete")
    out = one.select(*names, missing.alias("missing"), (F.size(missing) == 0).alias("ready"), rag.alias("rag_ready"), state.alias("knowledge_state"), *(F.lit(v).alias(k) for k, v in sorted(provider.items())))
    out = out.withColumn("narrative_ready", F.col("rag_ready") & F.lit(provider.get("primary_configured", False)))
    return out.withColumn("checked_at", utc_now()) if spark_time else out


def provider_flags(primary_key: str | None, primary_model: str | None, fallback_enabled: bool = False, fallback_model: str | None = None) -> dict[str, bool]:
    """Whether the providers' settings are complete; a key is not tried here."""
    return {"primary_configured": bool(primary_key and primary_model), "fallback_enabled": fallback_enabled, "fallback_configured": bool(fallback_enabled and fallback_model)}


def envelope_violations(analytics: DataFrame, evidence: DataFrame, calculations: DataFrame) -> DataFrame:
    """What a reader of the engine's tables checks before showing them: one row for each company and year, known states, evidence with its
    id and text, calculations with finite values and inputs."""
    a = [(F.col("ticker").isNull() | F.col("fiscal_year").isNull(), "no company or year"), (~F.coalesce(F.col("status").isin("complete", "partial", "unavailable", "not_initialized"), F.lit(False)), "unknown status"), (F.col("values").isNull(), "no values")]
    e = [(F.coalesce("evidence_id", F.lit("")) == "", "no id"), (F.trim(F.coalesce("text", F.lit(""))) == "", "no text")]
    c = [(F.coalesce("metric", F.lit("")) == "", "no metric"), (fact_ops.native(F.col("value")).isNull(), "value is not a finite decimal"), (F.coalesce(F.size("inputs"), F.lit(0)) < 1, "no inputs")]
    return all_of(
        duplicates(analytics, "analytics", ["ticker", "fiscal_year"]), row_violations(analytics, "analytics", F.concat_ws("|", "ticker", F.col("fiscal_year").cast("string")), a),
        duplicates(evidence, "evidence", ["evidence_id"]), row_violations(evidence, "evidence", F.coalesce("evidence_id", F.lit("")), e), row_violations(calculations, "calculation", F.coalesce("calculation_id", F.lit("")), c),
    )
