"""Queries of routing, evidence, citations, prose guard and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import evaluation, evidence, ingestion, retrieval, routing
from quillstone.session import table

PROSE = [
    ("The company relies on suppliers in several regions.", [], "qualitative_or_reference"), ("Risks are described in Item 1A of the 2024 Form 10-K.", [2024], "qualitative_or_reference"), ("Demand changed in 2023 again.", [2023], "qualitative_or_reference"),
    ("Demand changed in 2023.", [2024], "ambiguous"), ("Revenue grew.", [], "ambiguous"), ("Costs were 5%.", [], "quantitative"), ("It paid $ to suppliers.", [], "quantitative"), ("See www.example.com for details.", [], "prohibited_external_reference"),
    ("Two suppliers dominate.", [], "ambiguous"), ("", [], "ambiguous"), ("COVID-19 disrupted supply.", [], "qualitative_or_reference"), ("There were 12 sites.", [], "ambiguous"), ("Sales doubled.", [], "quantitative"), ("zero​width", [], "ambiguous"),
    ("The FY2024 filing discusses supply-chain risks.", [2024], "qualitative_or_reference"), ("Net income declined by half.", [], "quantitative"), ("Revenue grew three times.", [], "quantitative"), ("Revenue rose threefold.", [], "quantitative"),
    ("Margin increased by fifteen basis points.", [], "quantitative"), ("The ratio was 3:2.", [], "quantitative"), ("The range was 10–20.", [], "quantitative"), ("Cash was €50.", [], "quantitative"), ("The identifier is ABC123.", [], "ambiguous"),
    ("Revenue was the highest.", [], "ambiguous"), ("The FY2030 filing discusses risks.", [2024], "ambiguous"), ("There were Ⅷ suppliers.", [], "ambiguous"), ("See [filing](report.html).", [], "prohibited_external_reference"), ("See //example.com/report.", [], "prohibited_external_reference"),
    ("See example.invalid/report.", [], "prohibited_external_reference"), ("Pricing pressure and public-health disruptions were disclosed.", [], "qualitative_or_reference"),
]


PHRASES = ["What was {c}'s revenue in {b}?", "{c} net income growth from {a} to {b}", "CAGR of {c} operating income between {a} and {b}", "Explain {c}'s supply chain risks in {b}", "Compare all companies on free cash flow margin for {a}", "{c} fy{a} to fy{b} gross profit", "Should I buy {c} in {b}?", "{c} quarterly revenue in {b}", "revenue growth {b} to {a} of {c}", "Describe why {c} revenue changed in {b}", "What about {c} in {b}?", "fy24 assets of {c}", "{c} capex {a}-{b}"]
ASKED = [p.format(c=c, a=a, b=b) for p in PHRASES for c in ("Apple", "MSFT", "amazon", "Tesla", "nobody") for a, b in ((2022, 2024), (2023, 2024), (2019, 2022))]


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for every company, phrase and pair of years, keyed by position."""
    return spark.createDataFrame(list(enumerate(ASKED)), "query_id int, question string").withColumns({"tickers": F.array().cast("array<string>"), "years": F.array().cast("array<int>")})


def router_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = routing.route(_questions(spark, sf_dir))
    return out.select("query_id", "question", "question_type", "path", F.array_join("tickers", ",").alias("tickers"), F.array_join(F.transform("years", lambda y: y.cast("string")), ",").alias("years"), "metric", "operation", "reason")


def narrative_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = spark.createDataFrame([(i, t, y, e) for i, (t, y, e) in enumerate(PROSE)], "claim int, text string, allowed_years array<int>, expected string")
    return evidence.narrative(claims).select("claim", "expected", "category")


def narrative_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The guard over every conversation turn."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.array(F.lit(2024)).alias("allowed_years"))
    return evidence.narrative(turns).select("conv_id", "turn", "category")


def evidence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("request_id"), F.col("doc_id").alias("ord"))
    return evidence.register(rows).select("doc_id", "evidence_id")


def citation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as claims that cite their customer; customers with a negative balance are not registered."""
    registry = table(spark, sf_dir, "customer").where("c_acctbal >= 0").select(F.lit("r").alias("request_id"), F.col("c_custkey").cast("string").alias("evidence_id"))
    claims = table(spark, sf_dir, "orders").select(F.lit("r").alias("request_id"), F.col("o_orderkey").alias("claim"), F.col("o_orderpriority").alias("text"), F.array(F.col("o_custkey").cast("string")).alias("citation_ids"))
    return evidence.citation_errors(claims, registry).select("claim", "reason")


def coverage_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments and nations that were asked for and that no customer of an urgent order of 490,000 or more covers."""
    customers = table(spark, sf_dir, "customer")
    registry = customers.select(F.lit("r").alias("request_id"), F.col("c_custkey").cast("string").alias("evidence_id"), F.col("c_mktsegment").alias("ticker"), F.col("c_nationkey").alias("fiscal_year"))
    claims = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' AND o_totalprice >= 490000").select(F.lit("r").alias("request_id"), F.array(F.col("o_custkey").cast("string")).alias("citation_ids"))
    asked = customers.select(F.lit("r").alias("request_id"), F.col("c_mktsegment").alias("ticker")).distinct().crossJoin(F.broadcast(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("fiscal_year"))))  # segments by nations
    return evidence.uncovered(asked, claims, registry).select(F.col("ticker").alias("segment"), F.col("fiscal_year").alias("nation"))


def context_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source within 50,000 characters; the longest of each language in it stays in any case."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    out = evidence.fit_budget(rows, 50_000, ["source"], ["lang"], F.col("n_chars"), relevance="n_chars")
    return out.select("doc_id", "source", F.col("kept_always").alias("protected"), "fits")


def retrieval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rankings of documents by length within a source, against those labelled good."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), "doc_id", F.col("n_chars").cast("double").alias("score"))
    ranked = retrieval.top_k(docs, 20, by=("query_id",))
    good = docs.join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id").select("query_id", "doc_id")
    out = evaluation.retrieval_metrics(ranked.select("query_id", "doc_id", "rank"), good)
    return out.select("query_id", *(F.round(c, 9).alias(c) for c in ("recall_5", "recall_10", "precision_5", "mrr", "hit")))


def multiset_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands by size against brands by size of parts that were sold fifty at a time, as bags."""
    part = table(spark, sf_dir, "part")
    sold = part.join(table(spark, sf_dir, "lineitem").where("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey")).distinct(), "p_partkey", "left_semi")
    out = evaluation.multiset_difference(sold, part, ["p_size"], ["p_brand"])
    return out.select("p_brand", "p_size", "side", F.col("n").cast("long").alias("n"))


def structured_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_brand", F.col("p_retailprice").cast("decimal(18,2)").alias("price"))
    other = table(spark, sf_dir, "part").where("p_size <> 7").select("p_brand", F.col("p_retailprice").cast("decimal(18,2)").alias("price"))
    return evaluation.structured_correctness(other, part, ["price"], "p_brand")


def eval_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("status"), F.when(F.col("value") > 20, F.round("value", 6).cast("decimal(18,6)")).alias("latency_ms"))
    return evaluation.rollup(rows).select("status", "n", F.round(F.col("mean_latency").cast("double"), 4).alias("mean_latency"), "n_latency", F.round("share", 9).alias("share"))


def audit_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return ingestion.latest(rows, "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


QUERIES = {f.__name__: f for f in (router_labels, narrative_class, narrative_documents, evidence_ids, citation_check, coverage_missing, context_reduce, retrieval_scores, multiset_equality, structured_correct, eval_rollup, audit_latest)}
def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _said(*words: str) -> str:
    return "(" + " OR ".join(f"contains(said, ' {w} ')" for w in words) + ")"


def _matches(words: list[str]) -> str:
    return "regexp_matches(t, '\\b(?:" + "|".join(words) + ")\\b')"


_METRIC_SQL = "CASE " + " ".join(f"WHEN {_said(*words)} THEN '{metric}'" for metric, words in routing.METRIC_WORDS.items()) + " END"
_NAMED_SQL = "list_filter([" + ", ".join(f"CASE WHEN {_said(ticker.lower(), name.lower())} THEN '{ticker}' END" for ticker, name, _ in routing.COMPANIES) + "], lambda x: x IS NOT NULL)"
_EVERY_SQL = "[" + ", ".join(f"'{c[0]}'" for c in routing.COMPANIES) + "]"
_ROUTER_SQL = rf"""WITH q AS (SELECT query_id, question, lower(question) AS t, regexp_extract_all(lower(question), '[\p{{L}}\p{{N}}_]+|[^\s\p{{L}}\p{{N}}_]') AS toks FROM (VALUES {", ".join(f"({i}, {_sql(q)})" for i, q in enumerate(ASKED))}) AS v(query_id, question)),
s AS (SELECT *, ' ' || array_to_string(toks, ' ') || ' ' AS said, list_filter(toks, lambda x: x <> 'fy') AS w, list_transform(list_filter(toks, lambda x: regexp_full_match(x, '(fy)?(19|20)[0-9][0-9]')), lambda x: CAST(right(x, 4) AS INT)) AS stated FROM q),
r AS (SELECT *, [{{'a': CAST(right(w[i], 4) AS INT), 'b': CAST(right(w[i + 2], 4) AS INT)}} FOR i IN range(1, len(w) + 1) IF regexp_full_match(w[i], '(fy)?(19|20)[0-9][0-9]') AND regexp_full_match(w[i + 2], '(fy)?(19|20)[0-9][0-9]')
    AND (w[i + 1] IN ('-', '–', '—', 'to', 'through', 'until') OR w[i + 1] = 'and' AND i > 1 AND w[i - 1] = 'between')] AS ranges,
  CASE WHEN contains(said, ' cagr ') OR contains(said, ' compound annual ') THEN 'cagr' WHEN contains(said, ' growth ') THEN 'growth' END AS operation,
  len(list_filter(toks, lambda x: regexp_matches(x, '^fy[0-9][0-9]([^0-9]|$)'))) > 0 OR regexp_matches(said, ' fy ([''’] )?[0-9][0-9]([^0-9]|$)') AS short,
  {_METRIC_SQL} AS metric0, {_NAMED_SQL} AS named, {_matches(routing.NARRATIVE)} AS narrative FROM s),
y AS (SELECT *, CASE WHEN {_matches(routing.EVERYONE)} THEN {_EVERY_SQL} ELSE named END AS tickers, coalesce(len(list_filter(ranges, lambda x: x.a > x.b)) > 0, false) AS backwards FROM r),
z AS (SELECT *, list_sort(list_distinct(CASE WHEN short THEN [] WHEN operation IS NULL AND NOT backwards THEN list_concat(stated, flatten(list_transform(ranges, lambda x: CAST(generate_series(x.a, x.b) AS INT[])))) ELSE stated END)) AS years FROM y),
e AS (SELECT *, CASE WHEN {_matches(routing.FOREIGN)} THEN 'company outside the corpus' WHEN {_matches(routing.ADVICE)} THEN 'predictions and advice are unsupported' WHEN short THEN 'use four-digit fiscal years' WHEN backwards THEN 'year range is reversed'
  WHEN len(list_filter(years, lambda x: x NOT IN (2022, 2023, 2024))) > 0 THEN 'year outside the corpus' WHEN {_matches(routing.REFUSED)} THEN 'only consolidated annual metrics are available' WHEN len(tickers) = 0 THEN 'name a company' WHEN len(years) = 0 THEN 'name a fiscal year'
  WHEN operation IS NOT NULL AND metric0 IS NULL THEN 'name the metric of the calculation' WHEN operation IS NOT NULL AND len(years) <> 2 THEN 'growth needs two distinct years' WHEN metric0 IS NULL AND NOT narrative THEN 'neither a metric nor a narrative intent' END AS reason FROM z)
SELECT query_id, question, CASE WHEN reason IS NOT NULL THEN 'UNSUPPORTED' WHEN narrative THEN CASE WHEN regexp_matches(t, '\brisks?\b') THEN 'RISK' ELSE 'EXPLANATION' END WHEN len(tickers) > 1 AND operation IS NOT NULL THEN 'MULTI_DOCUMENT'
  WHEN operation IS NOT NULL OR coalesce(metric0 IN {routing.DERIVED}, false) THEN 'CALCULATION' WHEN len(tickers) > 1 OR len(years) > 1 THEN 'COMPARISON' ELSE 'FACT' END AS question_type,
  CASE WHEN reason IS NOT NULL THEN 'abstain' WHEN metric0 IS NOT NULL AND narrative THEN 'mixed' WHEN narrative THEN 'rag' ELSE 'structured' END AS path,
  array_to_string(tickers, ',') AS tickers, array_to_string(years, ',') AS years, CASE WHEN reason IS NULL THEN metric0 END AS metric, CASE WHEN reason IS NULL THEN operation END AS operation, reason FROM e"""
ORACLE_SQL = {
    "router_labels": _ROUTER_SQL,
    "narrative_class": "SELECT claim, expected, expected AS category FROM (VALUES " + ", ".join(f"({i}, '{e}')" for i, (_, _, e) in enumerate(PROSE)) + ") AS v(claim, expected)",
    "evidence_ids": "SELECT doc_id, 'EVIDENCE_' || lang || '_' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS evidence_id FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents)",
    "citation_check": "SELECT o_orderkey AS claim, 'unknown citation ' || o_custkey AS reason FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)",
    "coverage_missing": """SELECT s.segment, n_nationkey AS nation FROM (SELECT DISTINCT c_mktsegment AS segment FROM customer) s, nation
WHERE NOT EXISTS (SELECT 1 FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' AND o_totalprice >= 490000 AND c_mktsegment = s.segment AND c_nationkey = n_nationkey)""",
    "context_reduce": """WITH a AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) = 1 AS protected FROM documents),
b AS (SELECT *, sum(CASE WHEN protected THEN n_chars ELSE 0 END) OVER (PARTITION BY source) AS fixed, sum(n_chars) OVER (PARTITION BY source, protected ORDER BY n_chars DESC, doc_id DESC ROWS UNBOUNDED PRECEDING) AS upto FROM a)
SELECT doc_id, source, protected, fixed <= 50000 AS fits FROM b WHERE protected OR fixed + upto <= 50000""",
    "retrieval_scores": """WITH r AS (SELECT source AS query_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
g AS (SELECT source AS query_id, doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
n AS (SELECT query_id, count(*) AS n FROM g GROUP BY 1),
h AS (SELECT query_id, count(*) FILTER (rank <= 5) AS a5, count(*) FILTER (rank <= 10) AS a10, min(rank) AS best FROM r JOIN g USING (query_id, doc_id) WHERE rank <= 20 GROUP BY 1)
SELECT q.query_id, round(coalesce(a5, 0) / n, 9) AS recall_5, round(coalesce(a10, 0) / n, 9) AS recall_10, CASE WHEN n IS NOT NULL THEN round(coalesce(a5, 0) / 5, 9) END AS precision_5,
  CASE WHEN n IS NOT NULL THEN round(coalesce(1 / best, 0), 9) END AS mrr, CASE WHEN n IS NOT NULL THEN CASE WHEN best IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END END AS hit
FROM (SELECT DISTINCT query_id FROM r) q LEFT JOIN n ON q.query_id = n.query_id LEFT JOIN h ON q.query_id = h.query_id""",
    "multiset_equality": """WITH d AS (SELECT p_brand, p_size, count(*) FILTER (p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)) - count(*) AS d FROM part GROUP BY ALL)
SELECT p_brand, p_size, 'missing' AS side, -d AS n FROM d WHERE d <> 0""",
    "structured_correct": "SELECT p_brand, count(*) FILTER (p_size = 7) = 0 AS correct FROM part GROUP BY p_brand",
    "eval_rollup": """SELECT event_type AS status, count(*) AS n, round(CAST(sum(CASE WHEN value > 20 THEN CAST(round(value, 6) AS DECIMAL(18,6)) END) AS DOUBLE) / count(*) FILTER (value > 20), 4) AS mean_latency,
count(*) FILTER (value > 20) AS n_latency, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM events GROUP BY event_type""",
    "audit_latest": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1",
}
