"""Queries of the fact operators over orders and line items: nations as entities, order years as fiscal years."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.operators import facts as ops
from quillstone.session import table

METRICS = ["revenue", "gross_profit", "operating_income", "net_income", "operating_cash_flow", "capex"]
BASE_YEAR = 1995


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums in DECIMAL(38,4) for each nation and year: one aggregation over the fact table, dimensions joined after the partial sums' keys."""
    money = lambda x: F.round(x, 4).cast("decimal(18,4)")
    price, disc, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", money(price * (1 - disc)).alias("net"), money(price).alias("gross"), money(price * tax).alias("tax"), money(price * disc).alias("off"), F.col("l_returnflag").alias("flag"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("fiscal_year"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("entity"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    total = lambda x: F.sum(x).cast("decimal(38,4)")
    sums = joined.groupBy("c_nationkey", "fiscal_year").agg(
        total("net").alias("revenue"), total("gross").alias("gross_profit"), total(F.col("net") - F.col("tax")).alias("operating_income"), total("off").alias("net_income"),
        total(F.when(F.col("flag") != "R", F.col("net"))).alias("operating_cash_flow"), total("tax").alias("capex"),
    )
    return sums.join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).drop("c_nationkey", "n_nationkey")  # one row a nation


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wide(spark, sf_dir).unpivot(["entity", "fiscal_year"], METRICS, "metric", "value")


_WIDE_SQL = """
WITH l AS (SELECT l_orderkey, CAST(round(l_extendedprice * (1 - l_discount), 4) AS DECIMAL(18,4)) AS net, CAST(round(l_extendedprice, 4) AS DECIMAL(18,4)) AS gross,
                  CAST(round(l_extendedprice * l_tax, 4) AS DECIMAL(18,4)) AS tax, CAST(round(l_extendedprice * l_discount, 4) AS DECIMAL(18,4)) AS off, l_returnflag AS flag FROM lineitem),
wide AS (SELECT n_name AS entity, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year, CAST(sum(net) AS DECIMAL(38,4)) AS revenue, CAST(sum(gross) AS DECIMAL(38,4)) AS gross_profit,
                CAST(sum(net - tax) AS DECIMAL(38,4)) AS operating_income, CAST(sum(off) AS DECIMAL(38,4)) AS net_income,
                CAST(sum(CASE WHEN flag <> 'R' THEN net END) AS DECIMAL(38,4)) AS operating_cash_flow, CAST(sum(tax) AS DECIMAL(38,4)) AS capex
         FROM l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
facts AS (SELECT entity, fiscal_year, unnest(['revenue', 'gross_profit', 'operating_income', 'net_income', 'operating_cash_flow', 'capex']) AS metric,
                 unnest([revenue, gross_profit, operating_income, net_income, operating_cash_flow, capex]) AS value FROM wide)
"""


def annual_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).select("entity", "fiscal_year", "metric", F.col("value").cast("string").alias("value"))


def growth_yoy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.growth(_facts(spark, sf_dir))
    return out.select("entity", "fiscal_year", "metric", F.round("growth", 6).alias("growth"), F.col("growth_reason").alias("reason"))


def growth_cagr(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.growth(_facts(spark, sf_dir), base_year=BASE_YEAR)
    return out.select("entity", "fiscal_year", "metric", F.round("cagr", 6).alias("cagr"), F.col("cagr_reason").alias("reason"))


def metric_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.derived(_wide(spark, sf_dir))
    return out.select("entity", "fiscal_year", F.col("free_cash_flow").cast("string").alias("free_cash_flow"), *(F.round(c, 6).alias(c) for c in ("operating_margin", "net_margin", "fcf_margin")))


def decimal38_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margins and growth with 38 significant digits, as strings."""
    wide = ops.derived38(_wide(spark, sf_dir)).select("entity", "fiscal_year", "operating_margin", "net_margin", "fcf_margin")
    grown = ops.growth(_facts(spark, sf_dir).where(F.col("metric") == "revenue"), base_year=BASE_YEAR, precise=True)
    return wide.join(grown.select("entity", "fiscal_year", "growth", "cagr"), ["entity", "fiscal_year"])


def decimal38_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margins and growth of all metrics with 38 significant digits, by long division in column expressions: no Python in the plan."""
    wide = ops.derived38(_wide(spark, sf_dir)).unpivot(["entity", "fiscal_year"], ["operating_margin", "net_margin", "fcf_margin"], "metric", "percent")
    grown = ops.growth(_facts(spark, sf_dir), precise=True)
    return wide.union(grown.select("entity", "fiscal_year", F.concat("metric", F.lit(" growth")).alias("metric"), F.col("growth").alias("percent")))


def decimal38_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same strings of 38 digits, rounded to nine places, beside what doubles give."""
    out = decimal38_ratios(spark, sf_dir)
    return out.select("entity", "fiscal_year", *(F.round(F.col(c).cast("decimal(38,20)"), 9).cast("double").alias(c) for c in ("operating_margin", "net_margin", "fcf_margin", "growth", "cagr")))


def availability_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _facts(spark, sf_dir)
    years = facts.select("fiscal_year").distinct()
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("entity"))
    grid = F.broadcast(years)
    metrics = F.array(*map(F.lit, [*METRICS, "eps"]))
    grid = names.join(grid, how="cross").select("entity", "fiscal_year", F.explode(metrics).alias("metric"))  # a grid of dimensions: nations by years by metrics
    return ops.availability(grid, facts, ["entity", "fiscal_year"]).select("entity", "fiscal_year", "metric", F.col("value").cast("string").alias("value"), "reason")


def analytics_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = availability_map(spark, sf_dir)
    out = ops.analytics(cells, ["entity", "fiscal_year"])
    text = lambda m: F.array_join(F.transform(F.array_sort(F.map_keys(m)), lambda k: F.concat(k, F.lit("="), F.col(m)[k])), ";")
    return out.select("entity", "fiscal_year", text("values").alias("available"), text("unavailable_metrics").alias("unavailable"), "status")


def rank_competition(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.rank_competition(_facts(spark, sf_dir), ["fiscal_year", "metric"])
    return out.select("entity", "fiscal_year", "metric", F.col("rank").cast("long").alias("rank"))


def growth_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    grown = growth_yoy(spark, sf_dir).where("growth IS NOT NULL").select("entity", "fiscal_year", "metric", F.col("growth").alias("value"))
    return ops.leaders(grown, ["fiscal_year", "metric"]).select("fiscal_year", "metric", "leaders", F.col("value").alias("growth"))


def resolver_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as slots, line states as candidate values: one distinct value resolves, several conflict, none is missing."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_linestatus").alias("n"), F.min("l_linestatus").alias("v"), F.count("*").alias("agreeing"))
    slots = table(spark, sf_dir, "orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    reason = F.when(F.col("n").isNull(), "no annual observation").when(F.col("n") > 1, "conflicting observations")
    return slots.select("o_orderkey", F.when(reason.isNull(), F.col("v")).alias("value"), F.coalesce("agreeing", F.lit(0)).cast("long").alias("agreeing"), reason.alias("reason"))


def reconcile_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' greatest line number (the fact) against their line count (the observation), by the reconciliation ladder."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").cast("decimal(38,0)").alias("fact"), F.count("*").cast("decimal(38,0)").alias("seen"), (F.count("*") > F.count_distinct("l_linenumber")).alias("twice"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    both = orders.join(per, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    facts = both.select(F.col("o_orderkey").alias("document_id"), F.lit("lines").alias("metric"), F.lit("Lines").alias("concept"), F.col("fact").alias("value"), F.lit("USD").alias("unit"), F.lit("1").alias("cik"), F.lit("instant").alias("kind"), F.lit(None).cast("date").alias("period_start"), F.lit("2000-12-31").cast("date").alias("period_end"))
    ctx = F.struct(F.lit("1").alias("cik"), F.lit("instant").alias("kind"), F.lit(None).cast("date").alias("period_start"), F.lit("2000-12-31").cast("date").alias("period_end"), F.lit(False).alias("dimensional"))
    seen = per.select(F.col("l_orderkey").alias("document_id"), F.lit("Lines").alias("concept"), F.explode(F.when(F.col("twice"), F.array(F.lit("parsed"), F.lit("unresolved"))).otherwise(F.array(F.lit("parsed")))).alias("status"), F.col("seen").alias("value"), F.lit("USD").alias("unit"), F.lit(False).alias("hidden"), ctx.alias("context"))
    out = ops.reconcile(facts, seen)
    return out.select(F.col("document_id").alias("o_orderkey"), F.col("eligible").cast("long").alias("eligible"), F.col("blockers").cast("long").alias("blockers"), "status", "reason")


def display_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", ops.display(F.col("o_totalprice"), F.lit("USD")).alias("shown"))


def date_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by days between order and shipment, and whether that would be an annual period."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    days = F.datediff("l_shipdate", "o_orderdate")
    return lines.groupBy(days.cast("long").alias("days")).agg(F.count("*").alias("n_lines"), F.bool_or(ops.is_annual(F.col("o_orderdate"), F.col("l_shipdate"))).alias("annual"))


def calculation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth requests for consecutive years of each nation's revenue, checked and computed with 38 digits."""
    facts = _facts(spark, sf_dir).where(F.col("metric") == "revenue")
    year = F.col("fiscal_year")
    one = F.struct(F.col("entity").alias("ticker"), F.col("entity").alias("cik"), "metric", F.col("value").cast("string").alias("value"), F.lit("USD").alias("unit"), "fiscal_year", F.make_date(year, F.lit(1), F.lit(1)).alias("period_start"), F.make_date(year, F.lit(12), F.lit(31)).alias("period_end"), F.concat("entity", year.cast("string")).alias("accession_number"))
    own = Window.partitionBy("entity").orderBy("fiscal_year")
    pairs = facts.select("entity", "fiscal_year", one.alias("f")).withColumn("before", F.lag("f").over(own))
    asked = pairs.select("entity", "fiscal_year", F.lit("growth").alias("metric"), F.filter(F.array("before", "f"), lambda x: x.isNotNull()).alias("inputs"))
    return ops.calculate(asked).select("entity", "fiscal_year", F.round(F.col("value").cast("double"), 6).alias("growth"), "error")


_LADDER_SQL = """
SELECT o_orderkey, CAST(CASE WHEN n IS NULL THEN 0 ELSE 1 END AS BIGINT) AS eligible, CAST(CASE WHEN n > d THEN 1 ELSE 0 END AS BIGINT) AS blockers,
       CASE WHEN n IS NOT NULL AND m <> n THEN 'conflict' WHEN n IS NULL OR n > d THEN 'not_verified' ELSE 'matched' END AS status,
       CASE WHEN n IS NOT NULL AND m <> n THEN 'inline value differs' WHEN n > d THEN 'observation in scope cannot be compared' WHEN n IS NULL THEN 'no observation in scope' END AS reason
FROM orders LEFT JOIN (SELECT l_orderkey, max(l_linenumber) AS m, count(*) AS n, count(DISTINCT l_linenumber) AS d FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey
"""

_GROWN = """, grown AS (SELECT entity, fiscal_year, metric, value, CASE WHEN lag(fiscal_year) OVER w = fiscal_year - 1 THEN lag(value) OVER w END AS base FROM facts WINDOW w AS (PARTITION BY entity, metric ORDER BY fiscal_year)),
yoy AS (SELECT entity, fiscal_year, metric, round(CASE WHEN base > 0 THEN (CAST(value AS DOUBLE) - CAST(base AS DOUBLE)) / CAST(base AS DOUBLE) * 100 END, 6) AS growth,
       CASE WHEN value IS NULL THEN 'value unavailable' WHEN base IS NULL THEN 'no value for the year before' WHEN base <= 0 THEN 'base is not positive' END AS reason FROM grown)
"""

_CELLS = """, cells AS (SELECT g.entity, g.fiscal_year, g.metric, CAST(f.value AS VARCHAR) AS value, CASE WHEN f.value IS NULL THEN 'not reported' END AS reason
FROM (SELECT n_name AS entity, fiscal_year, metric FROM nation, (SELECT DISTINCT fiscal_year FROM facts), (SELECT unnest(['revenue', 'gross_profit', 'operating_income', 'net_income', 'operating_cash_flow', 'capex', 'eps']) AS metric)) g
LEFT JOIN facts f ON f.entity = g.entity AND f.fiscal_year = g.fiscal_year AND f.metric = g.metric)
"""

QUERIES = {f.__name__: f for f in (annual_facts, growth_yoy, growth_cagr, metric_ratios, decimal38_ratios, decimal38_native, decimal38_rounded, availability_map, analytics_rows, rank_competition, growth_leaders, resolver_agreement, reconcile_status, display_format, date_span, calculation_errors)}
ORACLE_SQL = {
    "annual_facts": _WIDE_SQL + "SELECT entity, fiscal_year, metric, CAST(value AS VARCHAR) AS value FROM facts",
    "growth_yoy": _WIDE_SQL + _GROWN + "SELECT * FROM yoy",
    "growth_cagr": _WIDE_SQL + f"""SELECT f.entity, f.fiscal_year, f.metric,
  round(CASE WHEN b.value > 0 AND f.value > 0 AND f.fiscal_year > {BASE_YEAR} THEN (pow(CAST(f.value AS DOUBLE) / CAST(b.value AS DOUBLE), 1 / (f.fiscal_year - {BASE_YEAR})) - 1) * 100 END, 6) AS cagr,
  CASE WHEN f.fiscal_year <= {BASE_YEAR} THEN 'not after the base year' WHEN b.value IS NULL THEN 'no value for the base year' WHEN b.value <= 0 OR f.value <= 0 THEN 'values are not positive' END AS reason
FROM facts f LEFT JOIN facts b ON b.entity = f.entity AND b.metric = f.metric AND b.fiscal_year = {BASE_YEAR}""",
    "metric_ratios": _WIDE_SQL + """SELECT entity, fiscal_year, CAST(operating_cash_flow - capex AS VARCHAR) AS free_cash_flow,
  round(CASE WHEN revenue > 0 THEN CAST(operating_income AS DOUBLE) / CAST(revenue AS DOUBLE) * 100 END, 6) AS operating_margin,
  round(CASE WHEN revenue > 0 THEN CAST(net_income AS DOUBLE) / CAST(revenue AS DOUBLE) * 100 END, 6) AS net_margin,
  round(CASE WHEN revenue > 0 THEN CAST(operating_cash_flow - capex AS DOUBLE) / CAST(revenue AS DOUBLE) * 100 END, 6) AS fcf_margin FROM wide""",
    # Quotients of HUGEINT in pieces of 19 digits, 57 places in all, then cut to 38 digits, half up; no sum of the tables comes to lie in the middle.
    "decimal38_native": _WIDE_SQL + """,
asked AS (SELECT entity, fiscal_year, unnest(['operating_margin', 'net_margin', 'fcf_margin']) AS metric, unnest([operating_income, net_income, operating_cash_flow - capex]) AS a, revenue AS b FROM wide
  UNION ALL SELECT f.entity, f.fiscal_year, f.metric || ' growth', f.value - p.value, p.value FROM facts f LEFT JOIN facts p ON p.entity = f.entity AND p.metric = f.metric AND p.fiscal_year = f.fiscal_year - 1),
whole AS (SELECT entity, fiscal_year, metric, a < 0 AS below, CAST(replace(CAST(abs(a) AS VARCHAR), '.', '') AS HUGEINT) AS a, CAST(replace(CAST(b AS VARCHAR), '.', '') AS HUGEINT) AS b FROM asked),
d0 AS (SELECT *, a // b AS q0, (a % b) * 10000000000000000000 AS r0 FROM whole WHERE b > 0),
d1 AS (SELECT *, r0 // b AS q1, (r0 % b) * 10000000000000000000 AS r1 FROM d0),
d2 AS (SELECT *, r1 // b AS q2, (r1 % b) * 10000000000000000000 AS r2 FROM d1),
d3 AS (SELECT *, ltrim(q0 || lpad(CAST(q1 AS VARCHAR), 19, '0') || lpad(CAST(q2 AS VARCHAR), 19, '0') || lpad(CAST(r2 // b AS VARCHAR), 19, '0'), '0') AS s, r2 % b = 0 AS ends FROM d2),
cut AS (SELECT *, CASE WHEN ends AND length(rtrim(s, '0')) <= 38 THEN s ELSE CAST(CAST(left(s, 38) AS HUGEINT) + CAST(substr(s, 39, 1) >= '5' AS INTEGER) AS VARCHAR) || repeat('0', length(s) - 38) END AS c FROM d3),
-- 57 places less the two of the percentage; an exact ratio keeps its own places and two zeros for the hundred before them
placed AS (SELECT *, lpad(c, CAST(greatest(length(c), 56) AS INTEGER), '0') AS l, CASE WHEN ends AND length(rtrim(s, '0')) <= 38 THEN greatest(0, 57 - (length(s) - length(rtrim(s, '0')))) ELSE 55 - (length(s) - 38) END AS n FROM cut)
SELECT w.entity, w.fiscal_year, w.metric, CASE WHEN w.a = 0 AND w.b > 0 THEN '0' ELSE CASE WHEN p.below THEN '-' ELSE '' END || left(l, length(l) - 55) || CASE WHEN n > 0 THEN '.' || left(right(l, 55), n) ELSE '' END END AS percent
FROM whole w LEFT JOIN placed p USING (entity, fiscal_year, metric)""",
    "decimal38_rounded": _WIDE_SQL + f"""SELECT w.entity, w.fiscal_year, round(CAST(operating_income AS DOUBLE) / CAST(w.revenue AS DOUBLE) * 100, 9) AS operating_margin, round(CAST(net_income AS DOUBLE) / CAST(w.revenue AS DOUBLE) * 100, 9) AS net_margin,
  round(CAST(operating_cash_flow - capex AS DOUBLE) / CAST(w.revenue AS DOUBLE) * 100, 9) AS fcf_margin, round(CAST(w.revenue - p.revenue AS DOUBLE) / CAST(p.revenue AS DOUBLE) * 100, 9) AS growth,
  round(CASE WHEN w.fiscal_year > {BASE_YEAR} THEN (pow(CAST(w.revenue AS DOUBLE) / CAST(b.revenue AS DOUBLE), 1 / (w.fiscal_year - {BASE_YEAR})) - 1) * 100 END, 9) AS cagr
FROM wide w LEFT JOIN (SELECT entity, fiscal_year, revenue FROM wide) p ON p.entity = w.entity AND p.fiscal_year = w.fiscal_year - 1 LEFT JOIN (SELECT entity, revenue FROM wide WHERE fiscal_year = {BASE_YEAR}) b ON b.entity = w.entity""",
    "availability_map": _WIDE_SQL + _CELLS + "SELECT * FROM cells",
    "analytics_rows": _WIDE_SQL + _CELLS + """SELECT entity, fiscal_year, coalesce(string_agg(metric || '=' || value, ';' ORDER BY metric) FILTER (value IS NOT NULL), '') AS available,
  coalesce(string_agg(metric || '=' || reason, ';' ORDER BY metric) FILTER (value IS NULL), '') AS unavailable,
  CASE WHEN count(*) = count(value) THEN 'complete' WHEN count(value) = 0 THEN 'unavailable' ELSE 'partial' END AS status FROM cells GROUP BY entity, fiscal_year""",
    "rank_competition": _WIDE_SQL + "SELECT entity, fiscal_year, metric, rank() OVER (PARTITION BY fiscal_year, metric ORDER BY value DESC) AS rank FROM facts WHERE value IS NOT NULL",
    "growth_leaders": _WIDE_SQL + _GROWN + """SELECT fiscal_year, metric, string_agg(entity, ', ' ORDER BY entity) AS leaders, max(growth) AS growth
FROM (SELECT *, rank() OVER (PARTITION BY fiscal_year, metric ORDER BY growth DESC) AS r FROM yoy WHERE growth IS NOT NULL) WHERE r = 1 GROUP BY fiscal_year, metric""",
    "resolver_agreement": """SELECT o_orderkey, CASE WHEN n = 1 THEN v END AS value, coalesce(c, 0) AS agreeing, CASE WHEN n IS NULL THEN 'no annual observation' WHEN n > 1 THEN 'conflicting observations' END AS reason
FROM orders LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_linestatus) AS n, min(l_linestatus) AS v, count(*) AS c FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""",
    "reconcile_status": _LADDER_SQL,
    "display_format": """WITH c AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders),
k AS (SELECT o_orderkey, c, CASE WHEN abs(c) >= 100000000000 THEN 1000000000 WHEN abs(c) >= 100000000 THEN 1000000 WHEN abs(c) >= 100000 THEN 1000 ELSE 1 END AS part FROM c),
h AS (SELECT *, c // part AS q, c % part AS r FROM k),
n AS (SELECT *, q + CASE WHEN 2 * r > part OR (2 * r = part AND q % 2 = 1) THEN 1 ELSE 0 END AS e FROM h)
SELECT o_orderkey, printf('$%d.%02d', e // 100, e % 100) || CASE part WHEN 1000000000 THEN 'B' WHEN 1000000 THEN 'M' WHEN 1000 THEN 'K' ELSE '' END AS shown FROM n""",
    "date_span": """SELECT datediff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS days, count(*) AS n_lines, bool_or(datediff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) BETWEEN 350 AND 380) AS annual
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
    "calculation_errors": _WIDE_SQL + """SELECT entity, fiscal_year, round(CASE WHEN p IS NOT NULL THEN (CAST(value AS DOUBLE) - CAST(p AS DOUBLE)) / CAST(p AS DOUBLE) * 100 END, 6) AS growth,
  CASE WHEN p IS NULL THEN 'growth needs two values of one metric' END AS error
FROM (SELECT *, lag(value) OVER (PARTITION BY entity ORDER BY fiscal_year) AS p FROM facts WHERE metric = 'revenue')""",
}
