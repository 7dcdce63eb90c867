"""Queries of the views over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import guards, views
from quillstone.session import table


def search_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.search(table(spark, sf_dir, "part"), " BRAND#1 ", ["p_name", "p_brand", "p_type"], p_size=7).select("p_partkey", "p_brand")


def shown_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account balances as a reader sees them."""
    rows = table(spark, sf_dir, "customer")
    unit = F.when(F.col("c_nationkey") % 3 == 0, "percentage").when(F.col("c_nationkey") % 3 == 1, "USD/shares").otherwise("EUR")
    value = F.when(F.col("c_custkey") % 50 != 0, F.col("c_acctbal").cast("decimal(18,2)").cast("string"))
    return rows.select("c_custkey", views.shown(value, unit).alias("shown"))


def chart_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("g"), F.when(F.col("s_suppkey") % 9 != 0, F.col("s_acctbal")).alias("value"))
    return views.bars(rows, ["g"]).select("s_suppkey", F.round("height", 6).alias("height"))


def chart_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("g"), F.when(F.col("s_suppkey") % 9 != 0, F.col("s_acctbal")).alias("value"))
    return views.domain(rows, ["g"])


def chart_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by status and priority, with empty cells."""
    orders = table(spark, sf_dir, "orders")
    cells = orders.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return views.grid(cells, orders.select("o_orderstatus").distinct(), orders.select("o_orderpriority").distinct(), ["o_orderstatus", "o_orderpriority"]).select("o_orderstatus", "o_orderpriority", "n")


def page_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of orders (the feature is the limit)."""
    return views.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 100, 3)


def recently_opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 50 event types and values of each user, each once."""
    rows = table(spark, sf_dir, "events").select("user_id", F.concat_ws("-", "event_type", F.floor("value").cast("string")).alias("key"), "ts")
    return views.recent(rows, "user_id", "key", "ts").select("user_id", "key", F.col("n").cast("long").alias("n"))


def canonical_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", views.canonical_digest(F.col("props")).alias("digest"))


def props_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number in each event's properties, which two of every eight state rightly; the others as text, null, not at all, in a list, as no JSON, or not themselves there."""
    n = F.get_json_object("props", "$.k")
    made = [F.concat(F.lit('{"k": "'), n, F.lit('"}')), F.lit('{"k": null}'), F.lit('{"j": 1}'), F.concat(F.lit("["), n, F.lit("]")), F.lit('{"k": ')]
    props = F.lit(None).cast("string")
    for i, text in enumerate(made):
        props = F.when(F.col("event_id") % 8 == i, text).otherwise(props)
    props = F.when(F.col("event_id") % 8 > 5, F.col("props")).otherwise(props)
    return guards.guarded(table(spark, sf_dir, "events").select("event_id", props.alias("props")), "props", {"k": ("$.k", "whole", "bigint")}).select("event_id", "k_state", F.col("k").cast("string").alias("k"))


def fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("v"), F.count("*").alias("n"))
    return rows.select("l_suppkey", F.round(views.measured_fraction(F.round("v", 9) * 12, F.col("n")), 6).alias("share"))


QUERIES = {f.__name__: f for f in (search_rows, shown_values, chart_bars, chart_domain, chart_grid, page_of_orders, recently_opened, canonical_digests, props_guard, fractions)}
ORACLE_SQL = {
    "canonical_digests": """SELECT event_id, sha256('{"k": ' || CAST(json_extract(props, '$.k') AS BIGINT) || '}') AS digest FROM events""",
    "props_guard": """SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'wrong type' WHEN 1 THEN 'null' WHEN 2 THEN 'absent' WHEN 3 THEN 'absent' WHEN 4 THEN 'no document' WHEN 5 THEN 'no document' ELSE 'ok' END AS k_state,
  CASE WHEN event_id % 8 > 5 THEN json_extract_string(props, '$.k') END AS k FROM events""",
    "search_rows": "SELECT p_partkey, p_brand FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'brand#1') AND p_size = 7",
    "shown_values": """WITH v AS (SELECT c_custkey, c_nationkey % 3 AS k, CASE WHEN c_custkey % 50 <> 0 THEN CAST(c_acctbal AS DECIMAL(18,2)) END AS v FROM customer),
f AS (SELECT *, CASE WHEN v < 0 THEN '-' ELSE '' END AS s, regexp_replace(printf('%.2f', abs(v)), '(\\d)(\\d{3}\\.)', '\\1,\\2') AS a FROM v)
SELECT c_custkey, CASE WHEN v IS NULL THEN 'Unavailable' WHEN k = 0 THEN s || a || '%' WHEN k = 1 THEN s || '$' || a || '/share' ELSE v || ' EUR' END AS shown FROM f""",
    "chart_bars": """SELECT s_suppkey, round(CASE WHEN v IS NULL THEN 4.0 ELSE greatest(6.0, abs(v) / greatest(max(v) OVER (PARTITION BY g), 1.0) * 40) END, 6)::DOUBLE AS height
FROM (SELECT s_suppkey, s_nationkey AS g, CASE WHEN s_suppkey % 9 <> 0 THEN s_acctbal END AS v FROM supplier)""",
    "chart_domain": """SELECT g, count(*) FILTER (v IS NULL) AS missing, min(v) AS low, max(v) AS high, coalesce(bool_or(v < 0), false) AS negative FROM (SELECT s_nationkey AS g, CASE WHEN s_suppkey % 9 <> 0 THEN s_acctbal END AS v FROM supplier) GROUP BY g""",
    "chart_grid": "SELECT s.o_orderstatus, p.o_orderpriority, n FROM (SELECT DISTINCT o_orderstatus FROM orders) s CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) p LEFT JOIN (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) c USING (o_orderstatus, o_orderpriority)",
    "page_of_orders": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 200",
    "recently_opened": """SELECT user_id, key, n FROM (SELECT user_id, key, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, key) AS n FROM (SELECT user_id, event_type || '-' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS key, max(ts) AS ts FROM events GROUP BY ALL)) WHERE n <= 50""",
    "fractions": "SELECT l_suppkey, round(CASE WHEN v BETWEEN 0 AND 1 THEN v END, 6) AS share FROM (SELECT l_suppkey, round(avg(l_discount), 9) * 12 AS v FROM lineitem GROUP BY 1)",
}
