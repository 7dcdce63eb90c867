"""What a viewer of the data needs: search, labels, display, charts, pages, projections for providers, audit summaries."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions.decimals import NUMBER
from quillstone.functions.shipping import ship
from quillstone.operators.facts import display as money


def search(rows: DataFrame, text: str, columns: list[str], **equal: object) -> DataFrame:
    """Rows of which some column holds the text, whatever its case, with the given columns equal (None: any)."""
    out = rows.where(F.lower(F.concat_ws(" ", *columns)).contains(text.strip().lower())) if text.strip() else rows
    for name, value in equal.items():
        if value is not None:
            out = out.where(F.col(name) == F.lit(value))
    return out


def numeric(value: Column) -> Column:
    """A double for a decimal string; null for blanks, hex, NaN and infinities."""
    found = F.when(F.trim(value).rlike(NUMBER), F.trim(value).try_cast("double"))
    return F.when(~F.isnan(found) & (F.abs(found) < float("inf")), found)


def measured_fraction(value: Column, denominator: Column) -> Column:
    """A share from 0 to 1 that was measured over a positive whole number of cases, else null."""
    return F.when(value.between(0, 1) & (denominator > 0) & (denominator == F.floor(denominator)), value)


def label(value: Column, known: dict[str, str] | None = None) -> Column:
    named = F.create_map(*(F.lit(x) for pair in (known or {"": ""}).items() for x in pair))
    return F.coalesce(F.try_element_at(named, value), F.initcap(F.replace(value, F.lit("_"), F.lit(" "))))


def shown(value: Column, unit: Column) -> Column:
    """A value for a reader: -$5.00B, $6.08/share, 12.34%; other units as they are; Unavailable for what is no number."""
    number = numeric(value)
    absolute = F.abs(number)
    sign = F.when(number < 0, "-").otherwise("")
    two = F.format_number(F.bround(absolute, 2), 2)
    out = (
        F.when(unit == "percentage", F.concat(F.when(F.bround(number, 2) == 0, "").otherwise(sign), two, F.lit("%"))).when(unit == "USD/shares", F.concat(sign, F.lit("$"), two, F.lit("/share")))
        .when(unit == "USD", F.concat(sign, money(absolute.cast("string"), F.lit("USD")))).otherwise(F.concat_ws(" ", value, unit))
    )
    return F.when(number.isNull(), "Unavailable").otherwise(out)


#: The metrics of each statement, in the order in which a reader sees them; what is derived stands last.
STATEMENTS = {
    "income": ["revenue", "gross_profit", "operating_income", "net_income", "eps", "operating_margin", "net_margin"], "balance": ["assets", "liabilities", "equity", "cash"],
    "cash_flow": ["operating_cash_flow", "capex", "free_cash_flow", "fcf_margin"], "growth": ["revenue_growth", "revenue_cagr"],
}


def statement_of(metric: Column) -> Column:
    """The statement that a metric belongs to, null for one of none."""
    known = F.create_map(*(F.lit(x) for name, metrics in STATEMENTS.items() for m in metrics for x in (m, name)))
    return F.try_element_at(known, metric)


def compared_metrics() -> list[str]:
    """The metrics that companies are compared by: all but growth, which has its own view."""
    return [m for name, metrics in STATEMENTS.items() if name != "growth" for m in metrics]


#: What a reader is told about a failure category.
FAILURES = {
    "model_or_endpoint_unavailable": "The text model could not be reached; evidence that was found can still be read.", "authentication": "The text provider refused the credentials.", "missing_api_key": "No text provider is set up; facts and calculations work without one.",
    "rate_limit": "The text provider's limit is reached; wait before asking again.", "timeout": "The request took too long.", "provider_unavailable": "The text provider is unavailable for now.", "context_budget_exceeded": "The evidence that must stay does not fit the budget.",
    "structured_output_validation_failed": "The provider's answer did not have the required form.", "malformed_response": "The provider's answer could not be read.", "output_token_limit": "The answer was cut off.", "primary_and_fallback_failed": "Neither provider gave a valid answer.",
}


def abstention(reason: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in FAILURES.items() for x in pair))
    return F.when(reason.isNull(), "The data and evidence at hand do not support an answer.").otherwise(F.coalesce(F.try_element_at(known, reason), F.when(reason.rlike("^[a-z]+(_[a-z]+)+$"), F.concat(label(reason), F.lit("."))).otherwise(reason)))


def bars(rows: DataFrame, by: list[str], value: str = "value", height: float = 40.0, least: float = 6.0, blank: float = 4.0) -> DataFrame:
    """`height` of each value in its group, the greatest (1 at least) filling it; missing values get a stub."""
    top = F.greatest(F.max(F.col(value)).over(Window.partitionBy(*by)), F.lit(1.0))
    return rows.withColumn("height", F.when(F.col(value).isNull(), blank).otherwise(F.greatest(F.lit(least), F.abs(F.col(value)) / top * height)))


def grid(cells: DataFrame, rows: DataFrame, columns: DataFrame, on: list[str]) -> DataFrame:
    """Every cell of two small dimensions, with its value or null."""
    return rows.crossJoin(F.broadcast(columns)).join(cells, on, "left")  # dimensions of a chart


def domain(rows: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Per group: missing values, least and greatest, and whether a baseline at zero is crossed."""
    return rows.groupBy(*by).agg(F.count_if(F.col(value).isNull()).alias("missing"), F.min(value).alias("low"), F.max(value).alias("high"), F.coalesce(F.bool_or(F.col(value) < 0), F.lit(False)).alias("negative"))


def page(rows: DataFrame, order: list[str], size: int, number: int) -> DataFrame:
    """Page `number` from 1, held within the pages there are."""
    pages = max(1, -(-rows.count() // size))
    return rows.orderBy(*order).offset((min(max(number, 1), pages) - 1) * size).limit(size)


def recent(opened: DataFrame, by: str, key: str, at: str, most: int = 50) -> DataFrame:
    """The `most` last opened keys of each reader, each once."""
    last = opened.groupBy(by, key).agg(F.max(at).alias(at))
    return last.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(at), key))).where(F.col("n") <= most)


def present(row: Column, fields: list[str]) -> Column:
    """The named fields of a struct that are not null, as a map of strings."""
    return F.map_filter(F.create_map(*(x for f in fields for x in (F.lit(f), row[f].cast("string")))), lambda _, v: v.isNotNull())


# What a provider gets to see of calculations.
CALCULATION_FIELDS = ["calculation_id", "calculation_policy_version", "ticker", "fiscal_year", "metric", "value", "unit", "formula", "years", "decimal_precision"]
INPUT_FIELDS = ["fact_id", "ticker", "cik", "fiscal_year", "accession_number", "metric", "concept", "value", "unit", "period_start", "period_end"]


def compact(calculations: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Calculations and their inputs cut to the fields above, where they exist; `keep` columns go along."""
    has = [f.name for f in calculations.schema["inputs"].dataType.elementType.fields]
    return calculations.select(*keep, *(c for c in CALCULATION_FIELDS if c in calculations.columns), F.transform("inputs", lambda x: F.struct(*(x[f].alias(f) for f in INPUT_FIELDS if f in has))).alias("inputs"))


def fact_records(facts: DataFrame) -> DataFrame:
    """Facts as evidence: where they stand and what they say."""
    where = F.concat(F.coalesce("taxonomy", F.lit("us-gaap")) if "taxonomy" in facts.columns else F.lit("us-gaap"), F.lit(":"), "concept", F.lit(" / "), "accession_number", F.lit(" / "), F.col("period_end").cast("string"))
    said = F.concat("ticker", F.lit(" FY"), F.col("fiscal_year").cast("string"), F.lit(" "), "metric", F.lit(" = "), "value", F.lit(" "), "unit", F.lit("; period "), F.coalesce(F.col("period_start").cast("string"), F.lit("None")), F.lit(" to "), F.col("period_end").cast("string"))
    return facts.withColumns({"section": F.lit("Company facts, reconciled with inline XBRL"), "subsection": F.col("concept"), "location": where, "text": said})


def messages(system: str, question: Column, evidence: Column, calculations: Column) -> Column:
    """The messages to a provider, as JSON: instructions, then question and records as data."""
    user = F.to_json(F.struct(question.alias("question"), evidence.alias("evidence"), calculations.alias("calculations")))
    return F.to_json(F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content"))))


def without_keys(schema: object, dropped: frozenset[str]) -> object:
    """A JSON schema without constraint keys that a provider does not know, at any depth."""
    if isinstance(schema, dict):
        return {k: without_keys(v, dropped) for k, v in schema.items() if k not in dropped}
    return [without_keys(v, dropped) for v in schema] if isinstance(schema, list) else schema


def _refused(constant: str) -> None:
    raise ValueError(f"{constant} is not a finite number")


def canonical_digest(value: Column) -> Column:
    """SHA-256 of a JSON text in canonical form: keys sorted, ASCII, numbers as read; null for text that is no JSON or holds NaN or infinity."""
    ship(SparkSession.active())

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            try:
                return hashlib.sha256(json.dumps(json.loads(text, parse_constant=_refused), sort_keys=True, allow_nan=False).encode()).hexdigest()
            except (TypeError, ValueError):
                return None

        return texts.map(one)

    return run(value)


def provider_counts(traces: DataFrame) -> DataFrame:
    return traces.where("provider IS NOT NULL").groupBy("provider", "model").agg(F.count("*").alias("n")).orderBy("provider", "model")


def audit_summary(audits: DataFrame) -> DataFrame:
    """The last run's audit (run_id, status, started_at, …, slots array of structs) with each slot cut to five fields."""
    keep = ["run_id", "status", "started_at", "finished_at", "updated_at", "corpus_version", "publication", "index", "pipeline_version", "resolution_policy_version", "reconciliation_policy_version", "accepted_fact_count", "unavailable_metric_count", "error_category"]
    whole = F.struct(*audits.columns)
    last = audits.agg(F.max_by(whole, F.struct("started_at", "run_id")).alias("r")).where("r IS NOT NULL").select("r.*")
    slot = lambda s: F.struct(*(s[c].alias(c) for c in ("ticker", "fiscal_year", "status", "stages", "error_category")))
    return last.select(*(c for c in keep if c in audits.columns), F.transform("slots", slot).alias("slots"))
