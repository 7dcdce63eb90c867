"""The best k documents of each query by BM25 without scoring everything: postings by impact, a first threshold, exact pruning.

An impact index holds, for each scope and term, its postings in ``LEVELS`` levels of falling gain, and the number and greatest gain of
each level; and each document's own terms with their gains. A batch of queries is one plan:

1. Levels of the query's terms are small rows. Those with fewest postings (rare terms, and the few strongest postings of others) are
   read until ``SEEDS`` postings are met; the best documents by them are scored in full. The k-th score is a threshold that the answer reaches.
2. Levels are left out, from the one with most postings for the least gain on, while what they could add to a document stays below
   ``SHARE`` of the threshold. A document that stands in left-out levels alone cannot reach the threshold.
3. Postings of the other levels are read and summed. A document goes on if its sum and the greatest gains it may have in left-out levels
   reach the threshold.
4. Documents that are left are scored in full from their own terms, in blocks of documents against blocks of queries.

The answer is that of the plain formula: bounds only decide what need not be read. Scores within ``MARGIN`` of the threshold count as
reaching it, as they may round to it. Rows are dealt by (query, scope), by term or by document; nothing grows on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.shipping import ship
from quillstone.operators import retrieval as ops
from quillstone.operators.blocks import rounded
from quillstone.session import settled, small

LEVELS, SEEDS, SHARE, MARGIN = 32, 200, 0.5, 1e-4
#: Queries and documents that meet in a task at once.
QUERY_BLOCK, PACK_ROWS = 512, 1024
_ON = ["query_id", "scope"]


def counted(chunks: DataFrame) -> dict[str, DataFrame]:
    """postings, terms and lengths of chunks (scope, doc_id, text), whose text is read once."""
    posts = settled(ops.postings(chunks), "postings")
    n = chunks.groupBy("scope").agg(F.count("*").alias("n"))
    avg = posts.groupBy("scope").agg(F.sum("tf").alias("all")).join(n, "scope").select("scope", (F.col("all") / F.col("n")).alias("avgdl"))
    terms = ops.with_idf(posts.groupBy("scope", "term").agg(F.count("*").alias("df")), n)
    return {"postings": posts, "terms": terms, "lengths": posts.groupBy("scope", "doc_id").agg(F.sum("tf").alias("dl")).join(avg, "scope")}


def impacts(index: dict[str, DataFrame], k1: float = ops.K1, b: float = ops.B) -> dict[str, DataFrame]:
    """impacts (scope, term, level, doc_id, gain), levels (scope, term, level, n, top) and documents (scope, doc_id, terms) of an index."""
    rows = index["postings"].join(index["terms"].select("scope", "term", "idf"), ["scope", "term"]).join(index["lengths"].select("scope", "doc_id", "dl", "avgdl"), ["scope", "doc_id"])
    gain = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    level = F.when(F.col("idf") > 0, F.least(F.lit(LEVELS - 1), F.floor((1 - F.col("gain") / (F.col("idf") * (k1 + 1))) * LEVELS))).otherwise(0)
    found = settled(rows.withColumn("gain", gain).select("scope", "term", level.cast("int").alias("level"), "doc_id", "gain"), "impacts")
    levels = settled(found.groupBy("scope", "term", "level").agg(F.count("*").alias("n"), F.max("gain").alias("top")), "levels")
    documents = settled(found.groupBy("scope", "doc_id").agg(F.collect_list(F.struct("term", "gain")).alias("terms")), "documents")
    return {"impacts": found, "levels": levels, "documents": documents}


def _read(index: dict[str, DataFrame], wanted: DataFrame) -> DataFrame:
    """The postings of wanted levels (query_id, scope, term, level, …), a row for each query."""
    return index["impacts"].join(small(wanted), ["scope", "term", "level"])


def planned(index: dict[str, DataFrame], asked: DataFrame, k: int = ops.TOP_K, share: float = SHARE) -> DataFrame:
    """(query_id, scope, term, level, n, qtf, theta, read, rest, spared): which levels of asked (query_id, term, qtf[, scope]) are read.

    rest is what left-out levels may add to a document at most, spared how much of it is this term's."""
    own = ["scope", "term"] if "scope" in asked.columns else ["term"]
    items = settled(index["levels"].join(small(asked), own).withColumn("bound", F.greatest(F.lit(0.0), F.col("top")) * F.col("qtf")), "items")
    by_n = Window.partitionBy(*_ON).orderBy("n", "term", "level").rowsBetween(Window.unboundedPreceding, -1)
    seeds = items.withColumn("before", F.coalesce(F.sum("n").over(by_n), F.lit(0))).where(F.col("before") < SEEDS).select(*_ON, "term", "level", "qtf")
    first = _read(index, seeds).groupBy(*_ON, "doc_id").agg(F.sum(F.col("gain") * F.col("qtf")).alias("score"))
    best = exact(index, asked, ops.top_k(first, 2 * k).select(*_ON, "doc_id"), k)
    theta = ops.top_k(best, k).where(F.col("rank") == k).select(*_ON, F.greatest(F.lit(0.0), F.col("score") - MARGIN).alias("theta"))
    down = Window.partitionBy(*_ON, "term").orderBy("level")
    costed = items.join(small(settled(theta, "theta")), _ON, "left").withColumn("theta", F.coalesce("theta", F.lit(0.0)))
    costed = costed.withColumn("cost", F.col("bound") - F.coalesce(F.lead("bound").over(down), F.lit(0.0)))
    # A level may be left out once all weaker ones of its term are: its worth is at most theirs, so that they come first.
    worth = F.min(F.when(F.col("cost") > 0, F.col("n") / F.col("cost")).otherwise(F.lit(float("inf")))).over(Window.partitionBy(*_ON, "term").orderBy(F.desc("level")))
    so_far = F.sum("cost").over(Window.partitionBy(*_ON).orderBy(F.desc("worth"), "term", F.desc("level")).rowsBetween(Window.unboundedPreceding, 0))
    costed = costed.withColumn("worth", worth).withColumn("read", so_far > share * F.col("theta"))
    left = F.when(F.col("read"), 0.0).otherwise(F.col("cost"))
    return costed.withColumn("rest", F.sum(left).over(Window.partitionBy(*_ON))).withColumn("spared", F.sum(left).over(Window.partitionBy(*_ON, "term"))).select(*_ON, "term", "level", "n", "qtf", "theta", "read", "rest", "spared")


def candidates(index: dict[str, DataFrame], plan: DataFrame) -> DataFrame:
    """(query_id, scope, doc_id) of the documents that may reach the threshold of a plan."""
    wanted = plan.where("read").select(*_ON, "term", "level", "qtf", "theta", "rest", "spared")
    sums = _read(index, wanted).groupBy(*_ON, "doc_id").agg((F.sum(F.col("gain") * F.col("qtf")) + F.first("rest") - F.sum("spared")).alias("most"), F.first("theta").alias("theta"))
    return sums.where(F.col("most") >= F.col("theta") - MARGIN).select(*_ON, "doc_id")


def exact(index: dict[str, DataFrame], asked: DataFrame, pairs: DataFrame, k: int | None = None, digits: int | None = None) -> DataFrame:
    """(query_id, scope, doc_id, score) of pairs (query_id, scope, doc_id), rounded to `digits`; with k, a task hands on the best k of each query and scope.

    A row is a document with the queries of one block that it meets; packs of such rows meet the block's terms."""
    spark = pairs.sparkSession
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    terms = asked.select("query_id", "term", "qtf").distinct().groupBy("query_id").agg(F.collect_list(F.struct("term", "qtf")).alias("terms"))
    n = asked.agg(F.approx_count_distinct("query_id")).first()[0]
    block = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-n // QUERY_BLOCK)))).cast("int").alias("at")
    blocks = ops.packed(terms.select(block, "query_id", "terms").repartition("at").sortWithinPartitions("at"), 2 * QUERY_BLOCK, "at").withColumnRenamed("block", "asked")
    tasks = max(2, spark.sparkContext.defaultParallelism)
    met = pairs.select("scope", "doc_id", block, "query_id").groupBy("scope", "doc_id", "at").agg(F.collect_list("query_id").alias("asks"))
    rows = index["documents"].join(met, ["scope", "doc_id"]).select("at", "scope", "doc_id", "terms", "asks")
    dealt = rows.repartition("at", F.pmod(F.hash("doc_id"), F.lit(tasks))).sortWithinPartitions("at")
    meeting = ops.packed(dealt, PACK_ROWS, "at").join(F.broadcast(blocks) if n <= ops.BROADCAST_QUERIES else blocks, "at").select("block", "asked")
    kinds = {"query_id": asked.schema["query_id"].dataType, "scope": index["documents"].schema["scope"].dataType, "doc_id": index["documents"].schema["doc_id"].dataType}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, queries, words = None, {}, pa.array([], pa.string())
        for batch in batches:
            for pack, asks in zip(batch.column("block"), batch.column("asked"), strict=True):
                if last is None or not asks.equals(last):
                    last, (queries, words) = asks, _numbered(pa.ipc.open_stream(asks.as_buffer()).read_all())
                out = _scored(pa.ipc.open_stream(pack.as_buffer()).read_all().combine_chunks(), queries, words, digits)
                if out.num_rows:
                    yield from (ops.best_rows([out], k) if k else out).combine_chunks().to_batches()

    return meeting.mapInArrow(run, ", ".join(f"{name} {kind.simpleString()}" for name, kind in kinds.items()) + ", score double")


def _numbered(asks: pa.Table) -> tuple[dict, pa.Array]:
    """{query: (numbers, counts)} of a block's terms, and the words by number."""
    lists = asks.column("terms").combine_chunks()
    flat = lists.flatten()
    coded = flat.field("term").dictionary_encode()
    ids, counts, ends = coded.indices.to_numpy(), flat.field("qtf").to_numpy().astype(np.float64), np.cumsum(lists.value_lengths().to_numpy())
    return {q: (ids[e - m : e], counts[e - m : e]) for q, e, m in zip(asks.column("query_id").to_pylist(), ends, np.diff(ends, prepend=0), strict=True)}, coded.dictionary


def _scored(rows: pa.Table, queries: dict, words: pa.Array, digits: int | None) -> pa.Table:
    lists = rows.column("terms").combine_chunks()
    flat = lists.flatten()
    ids, gains = pc.index_in(flat.field("term"), value_set=words).fill_null(-1).to_numpy(), flat.field("gain").to_numpy()
    ends, dense = np.cumsum(lists.value_lengths().to_numpy()), np.zeros(len(words))
    who, at, scores, start = [], [], [], 0
    for i, (end, asks) in enumerate(zip(ends, rows.column("asks").to_pylist(), strict=True)):
        here = ids[start:end] >= 0
        mine, start = (ids[start:end][here], gains[start:end][here]), end
        dense[mine[0]] = mine[1]
        for q in asks:
            of, counts = queries[q]
            scores.append(np.rint(dense[of] * counts * 1e9).sum() / 1e9)  # summed as decimals with nine digits
        who += asks
        at += [i] * len(asks)
        dense[mine[0]] = 0
    take = pa.array(at, pa.int64())
    values = np.array(scores, np.float64) if digits is None else rounded(np.array(scores, np.float64), digits)
    return pa.table([pa.array(who), rows.column("scope").take(take), rows.column("doc_id").take(take), pa.array(values)], ["query_id", "scope", "doc_id", "score"])


def search(index: dict[str, DataFrame], queries: DataFrame, k: int = ops.TOP_K, scopes: DataFrame | None = None, digits: int | None = None, share: float = SHARE) -> DataFrame:
    """(query_id, scope, doc_id, score, rank 1..k) of queries (query_id, query), scores above zero only; in scopes (query_id, scope) where given."""
    asked = ops.query_terms(queries)
    asked = settled(asked if scopes is None else asked.join(scopes.select("query_id", "scope").distinct(), "query_id"), "asked")
    plan = settled(planned(index, asked, k, share), "plan")
    return ops.top_k(exact(index, asked, candidates(index, plan), k, digits), k, positive=True)
