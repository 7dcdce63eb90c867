"""Acquisition: submissions to candidate filings, slots, audits and readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.operators.checks import ACCESSION, archive_url
from quillstone.operators.routing import COMPANIES, YEARS


def transpose(columns: DataFrame, keys: list[str], arrays: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of columnar arrays, and the (keys, reason) of those that lack a column or whose lengths differ, which give no rows."""
    sizes = [F.coalesce(F.size(F.col(a)), F.lit(-1)) for a in arrays]
    bad = F.when(F.least(*sizes) < 0, "column missing").when(F.least(*sizes) != F.greatest(*sizes), "lengths differ") if len(arrays) > 1 else F.when(sizes[0] < 0, "column missing")
    marked = columns.withColumn("reason", bad)
    zipped = F.arrays_zip(*(F.col(a) for a in arrays))
    rows = marked.where("reason IS NULL").select(*keys, F.posexplode(zipped).alias("ord", "z")).select(*keys, "ord", *(F.col("z")[a].alias(a) for a in arrays))
    return rows, marked.where("reason IS NOT NULL").select(*keys, "reason")


def companies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COMPANIES, "ticker string, company string, cik string")


def slots(spark: SparkSession) -> DataFrame:
    """The grid of companies and years."""
    return companies(spark).select("*", F.explode(F.array(*map(F.lit, YEARS))).alias("fiscal_year"))


def candidate_filings(filings: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Annual reports (by, accessionNumber, filingDate, reportDate, form, primaryDocument): identical rows once, and conflicts.

    Amendments, blank or invalid dates and malformed accession numbers are no candidates; rows of one accession number that
    differ are a conflict, not a choice.
    """
    date = F.col("reportDate").try_cast("date")
    good = filings.where((F.col("form") == "10-K") & date.isNotNull() & F.col("accessionNumber").rlike(ACCESSION))
    once = good.select(*by, "accessionNumber", "filingDate", "reportDate", "form", "primaryDocument").distinct().withColumn("fiscal_year", F.year(F.col("reportDate").try_cast("date")))
    many = F.count("*").over(Window.partitionBy(*by, "accessionNumber"))
    counted = once.withColumn("n", many)
    conflicts = counted.where("n > 1").select(*by, "accessionNumber").distinct().withColumn("reason", F.lit("conflicting rows"))
    return counted.where("n = 1").drop("n"), conflicts


def report_metadata(filings: DataFrame) -> DataFrame:
    """Document id and source address of candidate filings joined with their company."""
    named = filings.withColumnsRenamed({"accessionNumber": "accession_number", "primaryDocument": "primary_document", "reportDate": "period_end", "filingDate": "filing_date", "form": "filing_type"})
    return named.withColumn("document_id", F.concat_ws("-", "ticker", "accession_number")).withColumn("source_url", archive_url())


def exactly_one(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, reason): a slot needs exactly one validated candidate."""
    return candidates.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("reason", F.when(F.col("n") > 1, "several candidates"))


def slot_summary(reconciled: DataFrame) -> DataFrame:
    """Per document: resolved, matched and unavailable metrics and whether it is complete."""
    out = reconciled.groupBy("document_id").agg(F.count_if(F.col("value").isNotNull()).alias("resolved"), F.count_if(F.col("status") == "matched").alias("matched"), F.count_if(F.col("value").isNull()).alias("unavailable"))
    return out.withColumn("state", F.when(F.col("unavailable") == 0, "completed").otherwise("partial"))


def coverage(stored: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """One row: stored rows, distinct valid keys, invalid rows, expected keys, and a status."""
    valid = stored.where("valid").select(*keys).distinct().join(expected, keys, "left_semi")
    one = stored.agg(F.count("*").alias("stored"), F.count_if(~F.col("valid")).alias("invalid")).crossJoin(valid.agg(F.count("*").alias("validated"))).crossJoin(expected.agg(F.count("*").alias("expected")))
    return one.withColumn("status", F.when(F.col("stored") == 0, "not_initialized").when(F.col("invalid") > 0, "invalid").when(F.col("validated") == F.col("expected"), "complete").otherwise("partial"))


def readiness(flags: DataFrame) -> DataFrame:
    """(component, ready) rows as one row: whether all are ready, and the sorted names of those that are not."""
    return flags.agg(F.coalesce(F.bool_and("ready"), F.lit(False)).alias("ready"), F.array_sort(F.collect_list(F.when(~F.col("ready"), F.col("component")))).alias("missing"))


def latest(rows: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The last row of each key, by time and then the tie-break."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in rows.columns if c != key)), F.struct(at, tie)).alias("r")).select(key, "r.*")


def canonical_id(*parts: Column, length: int = 24) -> Column:
    """A stable identity of parts, null parts kept apart from empty ones."""
    return F.left(F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts)), 256), F.lit(length))
