"""Constraints as queries: a check gives rows (check, key, reason) of what breaks it, in order of precedence."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The forms of identifiers.
ACCESSION, HTML_NAME, SHA256, REQUEST_ID, CIK = r"^\d{10}-\d{2}-\d{6}$", r"^[^/\\]+\.html?$", r"^[0-9a-f]{64}$", r"^[0-9a-f]{32}$", r"^\d{10}$"


class Violated(ValueError):
    """Raised by require_empty with the first violations."""


def first_reason(rules: Sequence[tuple[Column, str]]) -> Column:
    """The reason of the first rule that is true, or null; a rule that is null counts as false."""
    return F.coalesce(*(F.when(rule, F.lit(why)) for rule, why in rules))


def row_violations(rows: DataFrame, check: str, key: Column, rules: Sequence[tuple[Column, str]]) -> DataFrame:
    return rows.select(F.lit(check).alias("check"), key.cast("string").alias("key"), first_reason(rules).alias("reason")).where("reason IS NOT NULL")


def duplicates(rows: DataFrame, check: str, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(check).alias("check"), F.concat_ws("|", *keys).alias("key"), F.lit("occurs twice").alias("reason"))


def set_difference(actual: DataFrame, expected: DataFrame, check: str, keys: list[str]) -> DataFrame:
    """Keys of one side that the other lacks."""
    a, e = actual.select(*keys).distinct(), expected.select(*keys).distinct()
    name = F.concat_ws("|", *keys).alias("key")
    missing = e.join(a, keys, "left_anti").select(F.lit(check).alias("check"), name, F.lit("missing").alias("reason"))
    return missing.union(a.join(e, keys, "left_anti").select(F.lit(check).alias("check"), name, F.lit("unexpected").alias("reason")))


def all_of(*parts: DataFrame) -> DataFrame:
    """The violations of several checks, numbered by precedence."""
    return reduce(DataFrame.union, (p.withColumn("priority", F.lit(i)) for i, p in enumerate(parts)))


def first_of(violations: DataFrame) -> DataFrame:
    """The one reported for each key: of the check that comes first."""
    return violations.groupBy("key").agg(F.min_by(F.struct("check", "reason"), F.struct("priority", "reason")).alias("v")).select("key", "v.check", "v.reason")


def require_empty(violations: DataFrame) -> None:
    found = violations.limit(5).collect()
    if found:
        raise Violated("; ".join(f"{r['check']} {r['key']}: {r['reason']}" for r in found))


def manifest(reports: DataFrame, slots: DataFrame, version: str) -> DataFrame:
    """A corpus manifest: exact slots, identity, identifiers, dates, checksums and counts, versions."""
    key = F.col("document_id")
    rules = [
        (~F.col("status").eqNullSafe(F.lit("acquired")) | ~F.col("filing_type").eqNullSafe(F.lit("10-K")), "not an acquired annual report"),
        (~F.col("pipeline_version").eqNullSafe(F.lit(version)), "other pipeline version"),
        (~F.coalesce(F.col("accession_number").rlike(ACCESSION), F.lit(False)), "invalid accession number"),
        (~F.coalesce(F.col("primary_document").rlike(HTML_NAME), F.lit(False)), "invalid primary document"),
        (~key.eqNullSafe(F.concat_ws("-", "ticker", "accession_number")), "document id is not derived"),
        (~F.col("source_url").eqNullSafe(archive_url()), "source address is not derived"),
        (F.col("period_end").try_cast("date").isNull() | F.col("filing_date").try_cast("date").isNull(), "invalid date"),
        (F.year(F.col("period_end").try_cast("date")) != F.col("fiscal_year"), "period ends in another year"),
        (F.col("filing_date").try_cast("date") < F.col("period_end").try_cast("date"), "filed before the period ended"),
        (~F.coalesce(F.col("content_sha256").rlike(SHA256), F.lit(False)), "invalid checksum"),
        (~F.coalesce((F.col("content_byte_count") > 0) & (F.col("block_count") > 0), F.lit(False)), "empty content"),
    ]
    return all_of(set_difference(reports, slots, "slots", ["ticker", "fiscal_year"]), duplicates(reports, "slot", ["ticker", "fiscal_year"]), duplicates(reports, "document", ["document_id"]), row_violations(reports, "report", key, rules))


def archive_url() -> Column:
    return F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), F.col("cik").try_cast("long").cast("string"), F.lit("/"), F.replace("accession_number", F.lit("-"), F.lit("")), F.lit("/"), F.col("primary_document"))


def chunks(rows: DataFrame, sources: DataFrame, fields: list[str], budget: int) -> DataFrame:
    """Chunks against their sources: known document with equal fields, every source covered, unique ids, budget, spans."""
    s = sources.select("document_id", *(F.col(f).alias(f"s_{f}") for f in fields), F.lit(True).alias("known"))
    joined = rows.join(s, "document_id", "left")
    differs = reduce(lambda a, b: a | b, (~F.col(f).eqNullSafe(F.col(f"s_{f}")) for f in fields), F.lit(False))
    spans = F.col("source_spans")
    rules = [
        (F.col("known").isNull(), "unknown document"), (differs, "metadata differ from the source"), (F.trim(F.coalesce("text", F.lit(""))) == "", "no text"),
        (~F.coalesce((F.col("token_count") > 0) & (F.col("token_count") <= budget), F.lit(False)), "over the token budget"), (F.coalesce(F.size(spans), F.lit(0)) < 1, "no source span"),
        (F.exists(spans, lambda x: (x["character_start"] < 0) | (x["character_start"] >= x["character_end"])), "malformed span"),
        (~F.col("location").eqNullSafe(F.array_join(F.array_distinct(F.transform(spans, lambda x: x["location"])), ", ")), "location differs from spans"),
    ]
    covered = sources.select("document_id").join(rows.select("document_id").distinct(), "document_id", "left_anti").select(F.lit("coverage").alias("check"), F.col("document_id").alias("key"), F.lit("source without a chunk").alias("reason"))
    return all_of(row_violations(joined, "chunk", F.col("chunk_id"), rules), duplicates(rows, "chunk", ["chunk_id"]), covered)


def facts(rows: DataFrame, reports: DataFrame, dimension: DataFrame) -> DataFrame:
    """Stored facts: exact key set, provenance of their report, concept and unit of their metric, value, sign and period."""
    keys = reports.select("document_id").crossJoin(F.broadcast(dimension.select("metric").distinct()))  # documents by eleven metrics
    dims = F.broadcast(dimension.select("metric", "concept", F.col("unit").alias("m_unit"), F.col("kind").alias("m_kind"), "nonnegative"))
    own = reports.select("document_id", *(F.col(c).alias(f"r_{c}") for c in ("ticker", "fiscal_year", "accession_number", "period_end")), F.lit(True).alias("known"))
    joined = rows.join(own, "document_id", "left").join(dims, ["metric", "concept"], "left")
    value = F.col("value").try_cast("decimal(38,6)")
    days = F.datediff("period_end", "period_start")
    rules = [
        (F.col("known").isNull(), "unknown document"),
        (~(F.col("ticker").eqNullSafe(F.col("r_ticker")) & F.col("fiscal_year").eqNullSafe(F.col("r_fiscal_year")) & F.col("accession_number").eqNullSafe(F.col("r_accession_number")) & F.col("period_end").eqNullSafe(F.col("r_period_end").try_cast("date"))), "provenance differs"),
        (F.col("m_unit").isNull(), "concept is not one of the metric"), (~F.col("unit").eqNullSafe(F.col("m_unit")) | ~F.col("kind").eqNullSafe(F.col("m_kind")), "unit or kind differs"), (value.isNull(), "value is not a finite decimal"),
        (F.col("nonnegative") & (value < 0), "negative value"), ((F.col("kind") == "duration") & ~F.coalesce(days.between(350, 380), F.lit(False)), "not an annual period"), ((F.col("kind") == "instant") & F.col("period_start").isNotNull(), "instant with a start"),
    ]
    return all_of(duplicates(rows, "key", ["document_id", "metric"]), set_difference(rows, keys, "key", ["document_id", "metric"]), row_violations(joined, "fact", F.concat_ws("|", "document_id", "metric"), rules))


def term_statistics(stats: DataFrame, posts: DataFrame) -> DataFrame:
    """Stored index statistics: finite idf, document frequency equal to the postings', positive counts."""
    real = posts.groupBy("scope", "term").agg(F.count("*").alias("real"), F.min("tf").alias("least"))
    joined = stats.join(real, ["scope", "term"], "full_outer")
    rules = [(F.col("idf").isNull() | F.isnan("idf") | (F.abs("idf") == float("inf")), "idf is not finite"), (~F.col("df").eqNullSafe(F.col("real")), "document frequency differs"), (F.col("least") < 1, "count is not positive")]
    return row_violations(joined, "term", F.concat_ws("|", "scope", "term"), rules)


def url_error(url: Column, hosts: Sequence[str]) -> Column:
    """Why an address is not allowed: https only, listed hosts, no credentials, port, query or fragment."""
    part = lambda what: F.try_parse_url(url, F.lit(what))
    authority = F.coalesce(part("AUTHORITY"), F.lit(""))
    return first_reason([
        (F.coalesce(part("HOST"), F.lit("")) == "", "no host"), (part("PROTOCOL") != "https", "not https"), (authority.contains("@"), "credentials"), (authority.rlike(r":\d*$"), "port"),
        (~F.lower(part("HOST")).isin(*hosts), "host is not allowed"), (part("QUERY").isNotNull() | url.contains("?"), "query"), (part("REF").isNotNull() | url.contains("#"), "fragment"),
    ])
