"""Evaluation: retrieval metrics, exact multiset equality, roll-ups with nulls for what was not measured, review labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators.retrieval import interleave


def retrieval_metrics(ranking: DataFrame, relevant: DataFrame) -> DataFrame:
    """recall@5, recall@10, precision@5 (over five always), reciprocal rank and hit of each query (query_id, rank, doc_id).

    A document found twice counts where it came first, later ranks moving up; queries without a relevant document have nulls.
    """
    first = ranking.groupBy("query_id", "doc_id").agg(F.min("rank").alias("r"))
    placed = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("r", "doc_id")))
    hits = placed.join(relevant.select("query_id", "doc_id").distinct().withColumn("hit", F.lit(True)), ["query_id", "doc_id"])
    found = hits.groupBy("query_id").agg(F.count_if(F.col("rank") <= 5).alias("at5"), F.count_if(F.col("rank") <= 10).alias("at10"), F.min("rank").alias("best"))
    n = relevant.groupBy("query_id").agg(F.count_distinct("doc_id").alias("n"))
    every = ranking.select("query_id").union(relevant.select("query_id")).distinct().join(n, "query_id", "left").join(found, "query_id", "left")
    measured = F.col("n").isNotNull()
    zero = lambda c: F.coalesce(c, F.lit(0))
    return every.select(
        "query_id", F.when(measured, zero("at5") / F.col("n")).alias("recall_5"), F.when(measured, zero("at10") / F.col("n")).alias("recall_10"), F.when(measured, zero("at5") / 5).alias("precision_5"),
        F.when(measured, F.coalesce(1 / F.col("best"), F.lit(0.0))).alias("mrr"), F.when(measured, (zero("best") > 0).cast("double")).alias("hit"),
    )


def macro(rows: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Means over what was measured, with how many rows were; null where none was."""
    aggs = [a for c in columns for a in (F.avg(c).alias(c), F.count(c).alias(f"{c}_n"))]
    return rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)


def multiset_difference(actual: DataFrame, expected: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Rows (by, keys, side, n) that one bag has more often than the other, by grouped counts; equal bags give none.

    Numbers among the keys must be decimals, so that 100 and 100.0 are one value.
    """
    tally = actual.select(*by, *keys, F.lit(1).alias("d")).union(expected.select(*by, *keys, F.lit(-1)))
    odd = tally.groupBy(*by, *keys).agg(F.sum("d").alias("d")).where("d <> 0")
    return odd.select(*by, *keys, F.when(F.col("d") > 0, "unexpected").otherwise("missing").alias("side"), F.abs("d").alias("n"))


def structured_correctness(actual: DataFrame, expected: DataFrame, keys: list[str], by: str) -> DataFrame:
    """(by, correct) for every group on either side."""
    groups = actual.select(by).union(expected.select(by)).distinct()
    wrong = multiset_difference(actual, expected, keys, [by]).select(by).distinct().withColumn("wrong", F.lit(True))
    return groups.join(wrong, by, "left").select(by, F.col("wrong").isNull().alias("correct"))


def rollup(results: DataFrame, latency: str = "latency_ms") -> DataFrame:
    """One row for each status: count, share, mean latency over measured rows and their number."""
    out = results.groupBy("status").agg(F.count("*").alias("n"), F.avg(latency).alias("mean_latency"), F.count(latency).alias("n_latency"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row a status


def traces(ranked: DataFrame, group: str, limit: int | None = None) -> DataFrame:
    """The order in which evidence of several groups was offered: interleaved by rank, first occurrences kept."""
    return interleave(ranked, group, ["doc_id"], limit)


def citation_validity(responses: DataFrame) -> DataFrame:
    """(request_id, valid): null where abstained; evidence ids unique, citations among them, every finding cited."""
    unique = F.size(F.array_distinct("evidence_ids")) == F.size("evidence_ids")
    inside = F.size(F.array_except("citations", "evidence_ids")) == 0
    cited = F.forall("finding_citations", lambda f: F.size(f) > 0)
    return responses.select("request_id", F.when(~F.col("abstained"), unique & inside & cited).alias("valid"))


def label_errors(labels: DataFrame, chunks: DataFrame, signature: str) -> DataFrame:
    """(question_id, doc_id, reason) of review labels (question_id, doc_id, relevant, index_signature, ticker, fiscal_year)."""
    known = chunks.select("doc_id", F.col("ticker").alias("c_ticker"), F.col("fiscal_year").alias("c_year"))
    joined = labels.join(known, "doc_id", "left")
    clash = labels.groupBy("question_id", "doc_id").agg((F.count_distinct("relevant") > 1).alias("clash"))
    reason = (
        F.when(~F.col("index_signature").eqNullSafe(F.lit(signature)), "reviewed against another index").when(F.col("c_ticker").isNull(), "unknown chunk")
        .when((F.col("c_ticker") != F.col("ticker")) | (F.col("c_year") != F.col("fiscal_year")), "chunk out of scope").when(F.col("relevant").isNull(), "not labelled").when(F.col("clash"), "conflicting labels")
    )
    return joined.join(clash, ["question_id", "doc_id"]).select("question_id", "doc_id", reason.alias("reason")).where("reason IS NOT NULL")
