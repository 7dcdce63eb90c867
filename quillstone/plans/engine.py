"""The whole question engine over the test tables: segments of customers stand for companies, order years in turn for fiscal years."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import models
from quillstone.operators import engine, routing
from quillstone.session import table

#: Segments stand for the corpus' companies; order years from 1992 on stand in turn for its three fiscal years.
_SEGMENTS = {"AUTOMOBILE": "AAPL", "BUILDING": "MSFT", "FURNITURE": "AMZN", "HOUSEHOLD": "AAPL", "MACHINERY": "MSFT"}


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticker = F.create_map(*(F.lit(x) for pair in _SEGMENTS.items() for x in pair))[F.col("c_mktsegment")]
    money = lambda x: F.sum(F.round(x, 4).cast("decimal(18,4)")).cast("decimal(38,4)")
    year = F.lit(routing.YEARS[0]) + (F.year("o_orderdate") - 1992) % 3
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", ticker.alias("ticker"), year.alias("fiscal_year"))
    lines = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    price, disc = F.col("l_extendedprice"), F.col("l_discount")
    sums = lines.groupBy("ticker", "fiscal_year").agg(money(price * (1 - disc)).alias("revenue"), money(price * (1 - disc) * 0.5).alias("operating_income"), money(price * disc).alias("net_income"), money(price * 0.25).alias("operating_cash_flow"), money(price * F.col("l_tax")).alias("capex"))
    long = sums.unpivot(["ticker", "fiscal_year"], ["revenue", "operating_income", "net_income", "operating_cash_flow", "capex"], "metric", "v")
    date = lambda m, d: F.make_date("fiscal_year", F.lit(m), F.lit(d))
    return long.select("ticker", F.col("ticker").alias("cik"), "fiscal_year", "metric", F.col("v").cast("string").alias("value"), F.lit("USD").alias("unit"), date(1, 1).alias("period_start"), date(12, 31).alias("period_end"), F.concat_ws("-", "ticker", "fiscal_year").alias("accession_number"), F.col("metric").alias("concept"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a chunk of one of nine filings."""
    tickers = F.array(*(F.lit(c[0]) for c in routing.COMPANIES))
    section = F.when(F.col("doc_id") % 5 == 0, "Front matter").when(F.col("doc_id") % 2 == 0, "Item 1A — Risk Factors").otherwise("Item 7 — Management Discussion")
    return table(spark, sf_dir, "documents").select(F.get(tickers, (F.col("doc_id") % 3).cast("int")).alias("ticker"), (2022 + (F.floor(F.col("doc_id") / 3) % 3)).cast("int").alias("fiscal_year"), "doc_id", section.alias("section"), "text")


def engine_ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = ["Apple revenue in 2023", "Microsoft operating margin in 2023", "Which company had the highest revenue growth between 2022 and 2024?", "Amazon free cash flow 2022 to 2024", "Explain Apple supply chain risks in 2023", "Discuss why Microsoft revenue and the cloud business matter in 2024", "Apple assets in 2024", "Tesla revenue 2024", "Amazon operating margin growth 2022 to 2024"]
    asked = spark.createDataFrame(list(enumerate(questions)), "query_id int, question string").withColumns({"tickers": F.array().cast("array<string>"), "years": F.array().cast("array<int>")})
    chunks = _chunks(spark, sf_dir)
    vectors = models.embed(chunks).drop("text", "section")  # made for the filings that are asked for, as these are filtered first
    out = engine.ask(asked, _facts(spark, sf_dir), chunks, vectors)
    return out.withColumns({"evidence_ids": F.array_join("evidence_ids", ","), "citations": F.array_join("citations", ",")})


def reference_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(0, "Apple revenue in 2023", None, None), (1, "Tesla revenue 2024", None, None), (2, "Explain Apple risks in 2023", None, None), (3, "Explain Apple risks in 2024", "reviewed", "v1"), (4, "MSFT net margin 2022", "reviewed", "v0"), (5, "Apple assets in 2024", None, None)]
    asked = spark.createDataFrame(rows, "query_id int, question string, annotation_status string, reviewed_version string").withColumns({"tickers": F.array().cast("array<string>"), "years": F.array().cast("array<int>")})
    out = engine.prepare_references(asked, _facts(spark, sf_dir), "v1").select("query_id", "question_type", "reference", F.explode_outer("expected").alias("x"))
    return out.select("query_id", "question_type", "reference", "x.ticker", F.col("x.fiscal_year").cast("long").alias("fiscal_year"), "x.metric", F.round(F.col("x.value").cast("double"), 6).alias("value"), "x.unit")


def index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the index of all nine filings."""
    return engine.build_index(_chunks(spark, sf_dir))["terms"].select("scope", "term", "df", F.round("idf", 6).alias("idf"))


QUERIES = {f.__name__: f for f in (engine_ask, reference_answers, index_terms)}
_FACTS_SQL = """WITH o AS (SELECT o_orderkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'AAPL' WHEN 'HOUSEHOLD' THEN 'AAPL' WHEN 'FURNITURE' THEN 'AMZN' ELSE 'MSFT' END AS ticker, 2022 + (year(o_orderdate) - 1992) % 3 AS fiscal_year FROM orders JOIN customer ON o_custkey = c_custkey),
l AS (SELECT ticker, fiscal_year, sum(CAST(round(l_extendedprice * (1 - l_discount), 4) AS DECIMAL(18,4))) AS revenue, sum(CAST(round(l_extendedprice * l_discount, 4) AS DECIMAL(18,4))) AS net_income FROM lineitem JOIN o ON l_orderkey = o_orderkey GROUP BY ALL)
"""
ORACLE_SQL = {
    "reference_answers": _FACTS_SQL + """, e AS (SELECT 0 AS query_id, ticker, fiscal_year, 'revenue' AS metric, CAST(revenue AS DOUBLE) AS value, 'USD' AS unit FROM l WHERE ticker = 'AAPL' AND fiscal_year = 2023
  UNION ALL SELECT 4, ticker, fiscal_year, unnest(['revenue', 'net_income', 'net_margin']), unnest([CAST(revenue AS DOUBLE), CAST(net_income AS DOUBLE), CAST(net_income AS DOUBLE) / CAST(revenue AS DOUBLE) * 100]), unnest(['USD', 'USD', 'percentage']) FROM l WHERE ticker = 'MSFT' AND fiscal_year = 2022)
SELECT q.query_id, question_type, reference, ticker, fiscal_year, metric, round(value, 6) AS value, unit
FROM (VALUES (0, 'FACT', 'derived'), (1, 'UNSUPPORTED', 'policy'), (2, 'RISK', 'unresolved'), (3, 'RISK', 'reviewed'), (4, 'CALCULATION', 'derived'), (5, 'FACT', 'unresolved')) AS q(query_id, question_type, reference) LEFT JOIN e ON e.query_id = q.query_id""",
    "index_terms": """WITH c AS (SELECT ['AAPL', 'MSFT', 'AMZN'][doc_id % 3 + 1] || ':' || (2022 + (doc_id // 3) % 3) AS scope, doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
df AS (SELECT scope, term, count(*) AS df FROM (SELECT DISTINCT scope, doc_id, unnest(w) AS term FROM c) GROUP BY ALL),
raw AS (SELECT df.*, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df JOIN (SELECT scope, count(*) AS n FROM c GROUP BY 1) USING (scope))
SELECT scope, term, df, round(CASE WHEN raw < 0 THEN 0.25 * m ELSE raw END, 6) AS idf FROM raw JOIN (SELECT scope, sum(CAST(round(raw, 9) AS DECIMAL(28,9)))::DOUBLE / count(*) AS m FROM raw GROUP BY 1) USING (scope)""",
}
