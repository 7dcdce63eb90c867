"""Queries of constraints, acquisition and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import checks, ingestion
from quillstone.session import table
from quillstone.streaming import events as streams


def missing_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without lines, and lines without an order."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("orderkey"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"))
    return checks.set_difference(lines, orders, "lines", ["orderkey"])


def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that share order and number, and documents that share a text."""
    docs = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("h"))
    return checks.duplicates(table(spark, sf_dir, "lineitem"), "line", ["l_orderkey", "l_linenumber"]).union(checks.duplicates(docs, "text", ["h"]))


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as stored facts of documents."""
    stored = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").isin(0, 1).alias("valid"))
    return ingestion.coverage(stored, table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])


def row_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that an order breaks."""
    orders = table(spark, sf_dir, "orders")
    rules = [(F.col("o_totalprice") < 1000, "small"), (F.col("o_orderstatus") == "P", "pending"), (F.year("o_orderdate") == 1996, "old")]
    return checks.row_violations(orders, "order", F.col("o_orderkey"), rules)


def candidate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as filings: annual ones, once each, with conflicts marked."""
    orders = table(spark, sf_dir, "orders")
    number = F.concat(F.lpad((F.col("o_custkey") % 500).cast("string"), 10, "0"), F.lit("-"), F.lpad((F.year("o_orderdate") % 100).cast("string"), 2, "0"), F.lit("-"), F.lpad(F.month("o_orderdate").cast("string"), 6, "0"))
    form = F.when(F.col("o_orderstatus") == "P", "10-K/A").otherwise("10-K")
    filings = orders.select(F.lit("x").alias("ticker"), number.alias("accessionNumber"), F.lit("2002-01-01").alias("filingDate"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("reportDate"), form.alias("form"), F.lit("a.htm").alias("primaryDocument"))
    good, bad = ingestion.candidate_filings(filings, ["ticker"])
    return good.select("accessionNumber", "reportDate", F.col("fiscal_year").cast("long").alias("fiscal_year"), F.lit(None).cast("string").alias("reason")).union(bad.select("accessionNumber", F.lit(None), F.lit(None), "reason"))


def transpose_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each order as arrays, and back as rows."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("a"))
    columnar = lines.select("l_orderkey", F.col("a.l_linenumber").alias("l_linenumber"), F.col("a.l_partkey").alias("l_partkey"), F.col("a.l_quantity").alias("l_quantity"))
    rows, _ = ingestion.transpose(columnar, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_quantity"])
    return rows.drop("ord")


def digest_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", ingestion.canonical_id(F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")).alias("id"))


def url_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    host = F.lower(F.regexp_extract("url", r"^\w+://([^/?#:]+)", 1))
    return pages.select("page_id", F.when(host.endswith("example.net"), "host is not allowed").otherwise(checks.url_error(F.col("url"), ["never"])).alias("reason"))


def slot_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents, lines as metrics: values are unavailable for returned lines."""
    lines = table(spark, sf_dir, "lineitem")
    value = F.when(F.col("l_returnflag") != "R", F.col("l_quantity"))
    rows = lines.select(F.col("l_orderkey").alias("document_id"), value.alias("value"), F.when(value.isNotNull() & (F.col("l_linestatus") == "O"), "matched").otherwise("not_verified").alias("status"))
    return ingestion.slot_summary(rows)


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.windowed(table(spark, sf_dir, "events"), "1 hour")
    return out.select("start", "event_type", "n", F.round(F.col("total").cast("double"), 4).alias("total"))


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.sessions(table(spark, sf_dir, "events"), "30 minutes").select("user_id", "start", "n")


def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtotals of quantities by return flag and line status (beyond the facts' own roll-ups)."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.cube("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"), F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


QUERIES = {f.__name__: f for f in (missing_slots, duplicate_keys, coverage, row_rules, candidate_filter, transpose_columns, digest_ids, url_guard, slot_states, event_windows, event_sessions, grouping_sets)}
ORACLE_SQL = {
    "missing_slots": """SELECT 'lines' AS "check", CAST(o_orderkey AS VARCHAR) AS key, 'missing' AS reason FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT DISTINCT 'lines', CAST(l_orderkey AS VARCHAR), 'unexpected' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""",
    "duplicate_keys": """SELECT 'line' AS "check", l_orderkey || '|' || l_linenumber AS key, 'occurs twice' AS reason FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'text', sha256(text), 'occurs twice' FROM documents GROUP BY text HAVING count(*) > 1""",
    "coverage": """SELECT s.stored, s.invalid, v.validated, e.expected, CASE WHEN stored = 0 THEN 'not_initialized' WHEN invalid > 0 THEN 'invalid' WHEN validated = expected THEN 'complete' ELSE 'partial' END AS status
FROM (SELECT count(*) AS stored, count(*) FILTER (quality NOT IN (0, 1)) AS invalid FROM labels) s, (SELECT count(DISTINCT doc_id) AS validated FROM labels WHERE quality IN (0, 1) AND doc_id IN (SELECT doc_id FROM documents)) v, (SELECT count(*) AS expected FROM documents) e""",
    "row_rules": """SELECT 'order' AS "check", CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN o_totalprice < 1000 THEN 'small' WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'old' END AS reason
FROM orders WHERE o_totalprice < 1000 OR o_orderstatus = 'P' OR year(o_orderdate) = 1996""",
    "candidate_filter": """WITH f AS (SELECT DISTINCT lpad(CAST(o_custkey % 500 AS VARCHAR), 10, '0') || '-' || lpad(CAST(year(o_orderdate) % 100 AS VARCHAR), 2, '0') || '-' || lpad(CAST(month(o_orderdate) AS VARCHAR), 6, '0') AS a,
  strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders WHERE o_orderstatus <> 'P'), n AS (SELECT a, count(*) AS n, min(d) AS d FROM f GROUP BY a)
SELECT a AS "accessionNumber", CASE WHEN n = 1 THEN d END AS "reportDate", CASE WHEN n = 1 THEN CAST(left(d, 4) AS BIGINT) END AS fiscal_year, CASE WHEN n > 1 THEN 'conflicting rows' END AS reason FROM n""",
    "transpose_columns": "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem",
    "digest_ids": "SELECT o_orderkey, left(sha256(o_orderkey || '|' || o_custkey || '|' || o_orderstatus), 24) AS id FROM orders",
    "url_guard": r"""SELECT page_id, CASE WHEN lower(regexp_extract(url, '^\w+://([^/?#:]+)', 1)) LIKE '%example.net' THEN 'host is not allowed' WHEN url NOT LIKE 'https:%' THEN 'not https' ELSE 'host is not allowed' END AS reason FROM pages""",
    "slot_states": """SELECT l_orderkey AS document_id, count(*) FILTER (l_returnflag <> 'R') AS resolved, count(*) FILTER (l_returnflag <> 'R' AND l_linestatus = 'O') AS matched, count(*) FILTER (l_returnflag = 'R') AS unavailable,
CASE WHEN count(*) FILTER (l_returnflag = 'R') = 0 THEN 'completed' ELSE 'partial' END AS state FROM lineitem GROUP BY 1""",
    "event_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(CAST(sum(CAST(round(value, 6) AS DECIMAL(28,6))) AS DOUBLE), 4) AS total FROM events GROUP BY ALL",
    "event_sessions": """WITH e AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""",
    "grouping_sets": "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, count(*) AS n, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
}
