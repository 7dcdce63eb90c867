"""The validated fact store: versions, provenance, recomputed reconciliation, and the facts that withstand all of it.

Validation is one plan over the whole store, not a check per lookup. Each rule gives violation rows (check, key, reason); the
facts that are served are those without a violation and without an open issue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import facts as fact_ops
from quillstone.operators.checks import ACCESSION, CIK, all_of, duplicates, first_reason, row_violations, set_difference
from quillstone.operators.checks import facts as fact_violations
from quillstone.sources.artifacts import load_guarded

TABLES = ["reports", "facts", "issues", "observations", "records", "meta"]
#: What a published fact and the candidate that was reconciled must share.
CANDIDATE_FIELDS = ["ticker", "cik", "fiscal_year", "accession_number", "concept", "unit", "period_start", "period_end", "value"]


def load(spark: SparkSession, folder: str, version: str | None = None) -> tuple[dict[str, DataFrame], str | None]:
    """(tables, load_error) of a published store."""
    return load_guarded(spark, folder, TABLES, version)


def digest(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row (digest, n): a checksum of a table that depends neither on the order of rows nor on partitions, and merges by sums.

    Four sums over parts of each row's SHA-256 are taken modulo nothing (decimals of 38 digits hold them) and hashed together."""
    names = sorted(columns or rows.columns)
    hashed = rows.select(F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256).alias("h"))
    lane = lambda i: F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)"))
    sums = hashed.agg(F.count("*").alias("n"), *(lane(i).alias(f"s{i}") for i in range(4)))
    return sums.select(F.sha2(F.concat_ws("|", F.col("n").cast("string"), *(F.coalesce(F.col(f"s{i}").cast("string"), F.lit("")) for i in range(4))), 256).alias("digest"), "n")


def entity_errors(reports: DataFrame, companies: DataFrame) -> DataFrame:
    """(document_id, reason) of reports whose company, form, year, accession number or period is not what the list of companies has."""
    known = companies.select(F.col("ticker").alias("k_ticker"), F.col("company").alias("k_company"), F.col("cik").alias("k_cik"))
    joined = reports.join(known, F.col("ticker") == F.col("k_ticker"), "left")
    reason = first_reason([
        (F.col("k_ticker").isNull(), "unsupported company"), (~normalized_cik(F.col("cik")).eqNullSafe(F.col("k_cik")), "CIK is not the company's"), (~F.col("company").eqNullSafe(F.col("k_company")), "name is not the company's"),
        (~F.col("filing_type").eqNullSafe(F.lit("10-K")), "not an annual report"), (F.col("fiscal_year").isNull(), "no fiscal year"), (~F.coalesce(F.col("accession_number").rlike(ACCESSION), F.lit(False)), "invalid accession number"),
        (F.col("period_end").try_cast("date").isNull(), "invalid period end"),
    ])
    return joined.select("document_id", reason.alias("reason")).where("reason IS NOT NULL")


def normalized_cik(cik: Column, ascii_only: bool = True) -> Column:
    """Ten digits of a positive CIK of one to ten digits, else null. The lenient form also takes other scripts' decimal digits and spaces around."""
    text = cik.cast("string") if ascii_only else F.trim(cik.cast("string"))
    if not ascii_only:
        zeros = [0x660, 0x6F0, 0x966, 0x9E6, 0xFF10]  # first digits of scripts whose ten digits follow each other
        text = F.translate(text, "".join(chr(z + i) for z in zeros for i in range(10)), "0123456789" * len(zeros))
    good = text.rlike("^[0-9]{1,10}$") & (text.try_cast("long") > 0)
    return F.when(good, F.lpad(text, 10, "0"))


def version_violations(store: dict[str, DataFrame], policies: dict[str, str]) -> DataFrame:
    """Whether the store is of the corpus it names and of the current policies, and covers its documents and every metric.

    meta: one row (corpus_version, and one column a policy)."""
    meta, reports = store["meta"], store["reports"]
    actual = digest(reports).select(F.col("digest").alias("actual"))
    rules = [(F.coalesce("corpus_version", F.lit("")) == "", "no corpus version"), (F.col("corpus_version") != F.col("actual"), "store and corpus disagree")]
    rules += [(~F.col(name).eqNullSafe(F.lit(value)), f"{name} is missing or outdated") for name, value in policies.items()]
    stated = row_violations(meta.crossJoin(actual), "version", F.coalesce("corpus_version", F.lit("")), rules)  # one row by one row
    one = meta.agg(F.count("*").alias("n")).where("n <> 1").select(F.lit("version").alias("check"), F.lit("meta").alias("key"), F.lit("not one row").alias("reason"))
    documents = set_difference(store["observations"].select("document_id"), reports, "observations", ["document_id"]).where("reason = 'unexpected'")
    dimension = fact_ops.metric_dimension(meta.sparkSession).select("metric").distinct()
    expected = reports.select("document_id").distinct().crossJoin(F.broadcast(dimension))  # documents by eleven metrics
    return all_of(one, stated, documents, duplicates(store["records"], "record", ["document_id", "metric"]), set_difference(store["records"], expected, "record", ["document_id", "metric"]))


def qualified(concept: Column) -> Column:
    """A concept with its taxonomy, as observations have it."""
    return F.when(concept.contains(":"), concept).otherwise(F.concat(F.lit("us-gaap:"), concept))


def reconciliation_violations(store: dict[str, DataFrame]) -> DataFrame:
    """Facts whose reconciliation, computed anew from the filings' own observations, is not what was stored.

    records: (document_id, metric, status, reason, eligible, blockers, candidate struct of CANDIDATE_FIELDS)."""
    facts, records = store["facts"], store["records"]
    inputs = facts.select("document_id", "metric", qualified(F.col("concept")).alias("concept"), F.col("value").try_cast("decimal(38,6)").alias("value"), "unit", "cik", "kind", F.col("period_start").try_cast("date").alias("period_start"), F.col("period_end").try_cast("date").alias("period_end"))
    now = fact_ops.reconcile(inputs, store["observations"]).select("document_id", "metric", *(F.col(c).alias(f"now_{c}") for c in ("status", "reason", "eligible", "blockers")))
    joined = facts.join(now, ["document_id", "metric"], "left").join(records.select("document_id", "metric", "status", F.col("reason").alias("r_reason"), "eligible", "blockers", "candidate", F.lit(True).alias("linked")), ["document_id", "metric"], "left")
    differs = F.lit(False)
    for field in CANDIDATE_FIELDS:
        differs = differs | ~F.col(field).cast("string").eqNullSafe(F.col("candidate")[field].cast("string"))
    said = [~F.col(a).eqNullSafe(F.col(b)) for a, b in (("status", "now_status"), ("r_reason", "now_reason"), ("eligible", "now_eligible"), ("blockers", "now_blockers"))]
    rules = [
        (F.col("linked").isNull(), "no reconciliation record"), (~F.col("status").eqNullSafe(F.lit("matched")), "record is not matched"), (~F.col("now_status").eqNullSafe(F.lit("matched")), "inline evidence does not validate the fact"),
        (F.col("candidate").isNull(), "record lacks its candidate"), (differs, "fact differs from its candidate"), (said[0] | said[1] | said[2] | said[3], "stored result is inconsistent"),
    ]
    return row_violations(joined, "reconciliation", F.concat_ws("|", "document_id", "metric"), rules)


def violations(store: dict[str, DataFrame], policies: dict[str, str]) -> DataFrame:
    """All violations, in order of precedence: version, facts, reconciliation."""
    dimension = fact_ops.metric_dimension(store["meta"].sparkSession)
    parts = [version_violations(store, policies).drop("priority"), fact_violations(store["facts"], store["reports"], dimension).where("reason <> 'missing'").drop("priority"), reconciliation_violations(store)]
    return all_of(*(p.select("check", "key", "reason") for p in parts))


def validated_facts(store: dict[str, DataFrame], policies: dict[str, str]) -> DataFrame:
    """The facts to be served: none if the version is broken; else those of exactly one report each, without a violation or an open issue."""
    broken = version_violations(store, policies).limit(1).select(F.lit(True).alias("broken"))
    dimension = fact_ops.metric_dimension(store["meta"].sparkSession)
    bad = fact_violations(store["facts"], store["reports"], dimension).where("reason <> 'missing'").select("key").union(reconciliation_violations(store).select("key")).distinct()
    single = store["reports"].groupBy("ticker", "fiscal_year").agg(F.count("*").alias("n")).where("n = 1").select("ticker", "fiscal_year")
    facts = store["facts"].withColumn("key", F.concat_ws("|", "document_id", "metric")).join(bad, "key", "left_anti").drop("key").join(single, ["ticker", "fiscal_year"], "left_semi")
    return fact_ops.unblocked(facts, store["issues"]).join(broken, F.lit(True), "left_anti")


def stamped(calculations: DataFrame, version: Column) -> DataFrame:
    """Calculations with the scope of their last year's input and the corpus they were made from; the id covers both."""
    last = F.element_at("inputs", -1)
    out = calculations.withColumns({"ticker": last["ticker"], "fiscal_year": last["fiscal_year"], "corpus_version": version})
    return out.withColumn("calculation_id", F.left(F.sha2(F.to_json(F.struct("corpus_version", "inputs", "metric")), 256), F.lit(24)))


def input_gaps(calculations: DataFrame, fields: list[str]) -> DataFrame:
    """(calculation_id, reason) of calculations of which an input lacks one of the fields that make it authoritative."""
    has = [f.name for f in calculations.schema["inputs"].dataType.elementType.fields]
    absent = [f for f in fields if f not in has]
    lacks = F.exists("inputs", lambda x: F.greatest(F.lit(False), *(x[f].isNull() for f in fields if f in has)))
    reason = F.when(F.lit(bool(absent)), F.lit(f"inputs have no {', '.join(absent)}")).when(F.coalesce(F.size("inputs"), F.lit(0)) < 1, "no inputs").when(lacks, "input lacks its identity")
    return calculations.select("calculation_id", reason.alias("reason")).where("reason IS NOT NULL")


def cik_of(companyfacts: DataFrame, reports: DataFrame) -> DataFrame:
    """(cik, reason) of company-facts documents whose own CIK is malformed or that of no report: they are another company's."""
    own = companyfacts.select(F.col("cik").cast("string").alias("stated"), normalized_cik(F.col("cik")).alias("cik"))
    known = reports.select(normalized_cik(F.col("cik")).alias("cik")).distinct().withColumn("known", F.lit(True))
    joined = own.join(known, "cik", "left")
    return joined.select("stated", first_reason([(~F.coalesce(F.col("cik").rlike(CIK), F.lit(False)), "invalid CIK"), (F.col("known").isNull(), "entity of no report")]).alias("reason")).where("reason IS NOT NULL")
