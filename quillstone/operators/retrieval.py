"""Lexical and dense retrieval over batches of queries: BM25, cosine, rank fusion, boosts, thresholds and scope-covering selection.

Chunks are rows (scope, doc_id, text); queries are rows (query_id, query). Everything is keyed by (query_id, scope), so a batch
of questions is one plan. Statistics of BM25 are local to a scope. Scores are rounded before ranking, as float sums depend on
their order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.models import overlap_logit
from quillstone.functions.shipping import ship
from quillstone.session import settled, small

# Defaults of the ranking formula and of the retrieval steps.
K1, B, EPSILON = 1.5, 0.75, 0.25
TOP_K, RRF_K, RERANK_K, FINAL_K, ABSTAIN_BELOW, PROMOTE_FLOOR = 20, 60, 8, 6, 0.25, 0.15
DIGITS = 9
#: Rows of vectors and of queries that meet in one matrix product, query vectors that a broadcast may hold, and results that a task may.
VECTOR_BLOCK, QUERY_BLOCK, BROADCAST_QUERIES, HELD_ROWS = 4096, 512, 50_000, 4_000_000
#: Questions whose words are looked for in documents one by one; beyond it blocks of questions meet blocks of documents.
FEW_QUERIES = 64


def lexical(text: Column) -> Column:
    """The runs of a-z and 0-9 of the lower-cased text; splitting at what stands between them is faster than extracting them."""
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def postings(chunks: DataFrame) -> DataFrame:
    """(scope, doc_id, term, tf); terms are combined before the shuffle."""
    return chunks.select("scope", "doc_id", F.explode(lexical(F.col("text"))).alias("term")).groupBy("scope", "doc_id", "term").agg(F.count("*").alias("tf"))


def document_frequencies(chunks: DataFrame) -> DataFrame:
    """(scope, term, df), counted from each document's distinct terms without dealing documents out by id."""
    return chunks.select("scope", F.explode(F.array_distinct(lexical(F.col("text")))).alias("term")).groupBy("scope", "term").agg(F.count("*").alias("df"))


def term_stats(chunks: DataFrame) -> DataFrame:
    """(scope, term, df, idf), a negative idf replaced by EPSILON times the scope's mean idf."""
    return with_idf(document_frequencies(chunks), chunks.groupBy("scope").agg(F.count("*").alias("n")))


def with_idf(df: DataFrame, n: DataFrame) -> DataFrame:
    """(scope, term, df, idf) of counts (scope, term, df) and numbers of documents (scope, n)."""
    raw = df.join(n, "scope").withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.groupBy("scope").agg((F.sum(F.round("raw", 9).cast("decimal(28,9)")).cast("double") / F.count("*")).alias("mean"))
    return raw.join(mean, "scope").select("scope", "term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def doc_stats(chunks: DataFrame) -> DataFrame:
    """(scope, doc_id, dl, avgdl)."""
    sized = chunks.select("scope", "doc_id", F.size(lexical(F.col("text"))).alias("dl"))
    return sized.join(mean_length(chunks), "scope")


def mean_length(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("scope").agg((F.sum(F.size(lexical(F.col("text")))) / F.count("*")).alias("avgdl"))


def bm25(chunks: DataFrame, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, scope, doc_id, score): only documents with a query term; others score zero. Repeated query terms count again.

    Documents are cut to the batch's terms (broadcast if few) before anything is dealt out; only statistics of terms are counted from all.
    """
    terms = query_terms(queries)
    asked = small(terms.select("term").distinct())
    tokens = chunks.select("scope", "doc_id", lexical(F.col("text")).alias("w")).select("scope", "doc_id", F.size("w").alias("dl"), F.explode("w").alias("term"))
    hits = tokens.join(asked, "term").groupBy("scope", "doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    idf = term_stats(chunks).join(asked, "term").select("scope", "term", "idf")
    hits = hits.join(mean_length(chunks), "scope").join(idf, ["scope", "term"])
    return _summed(hits.join(small(terms), "term"), k1, b)


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(lexical(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def _summed(hits: DataFrame, k1: float, b: float) -> DataFrame:
    """(query_id, scope, doc_id, score) of hits (…, tf, idf, dl, avgdl, qtf)."""
    gain = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = hits.withColumn("gain", F.round(gain * F.col("qtf"), DIGITS).cast(f"decimal(28,{DIGITS})"))
    return scored.groupBy("query_id", "scope", "doc_id").agg(F.sum("gain").cast("double").alias("score"))


def bm25_of_index(index: dict[str, DataFrame], queries: DataFrame, scopes: DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """The same scores from an index's tables: postings, terms and lengths are read, nothing is tokenised or counted anew.

    Only postings of the batch's terms, and of its scopes where scopes (query_id, scope) are given, go on."""
    terms = query_terms(queries)
    asked, on = (terms.join(scopes, "query_id"), ["scope", "term"]) if scopes is not None else (terms, ["term"])
    hits = index["postings"].join(small(asked.select(*on).distinct()), on)
    hits = hits.join(index["terms"].select("scope", "term", "idf"), ["scope", "term"]).join(index["lengths"], ["scope", "doc_id"])
    return _summed(hits.join(small(asked), on), k1, b)


def packed(rows: DataFrame, n: int, by: str | None = None, form: Callable[[pa.Table], pa.Table] | None = None) -> DataFrame:
    """Blocks of at most n rows, each one Arrow stream in a binary column; with `by`, of rows that stand together and agree in it. `form` makes of a
    block's rows the table that is kept."""
    ship(rows.sparkSession)
    schema = "block binary" if by is None else f"{by} {rows.schema[by].dataType.simpleString()}, block binary"

    def pack(table: pa.Table) -> pa.RecordBatch:
        out, kept = pa.BufferOutputStream(), table if form is None else form(table)
        with pa.ipc.new_stream(out, kept.schema) as stream:
            stream.write_table(kept)
        block = pa.array([out.getvalue().to_pybytes()], pa.binary())
        return pa.RecordBatch.from_arrays([block], ["block"]) if by is None else pa.RecordBatch.from_arrays([table.column(by).slice(0, 1).combine_chunks(), block], [by, "block"])

    def runs(batch: pa.RecordBatch) -> Iterator[tuple[object, pa.RecordBatch]]:
        if by is None:
            yield None, batch
            return
        values = batch.column(by).to_pylist()
        lo = 0
        for i in range(1, len(values) + 1):
            if i == len(values) or values[i] != values[lo]:
                yield values[lo], batch.slice(lo, i - lo)
                lo = i

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for value, part in runs(batch):
                if held and value != last:
                    yield pack(pa.Table.from_batches(held))
                    held, size = [], 0
                last, lo = value, 0
                while lo < part.num_rows:
                    held.append(part.slice(lo, n - size))
                    lo, size = lo + held[-1].num_rows, size + held[-1].num_rows
                    if size == n:
                        yield pack(pa.Table.from_batches(held))
                        held, size = [], 0
        if held:
            yield pack(pa.Table.from_batches(held))

    return rows.mapInArrow(run, schema)


def matrices(table: pa.Table, column: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, matrix) of the vectors of each length; vectors with a null in them give NaN."""
    vectors = table.column(column).combine_chunks()
    sizes = np.asarray(vectors.value_lengths().fill_null(-1))
    for size in np.unique(sizes[sizes >= 0]):
        rows = np.flatnonzero(sizes == size)
        yield int(size), rows, np.asarray(vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(rows), size)


def matrix_of(table: pa.Table, column: str) -> np.ndarray:
    """The vectors of a column of vectors of one length, as rows."""
    return next((x for _, _, x in matrices(table, column)), np.zeros((0, 0)))


def best_of_blocks(vectors: pa.Table, queries: pa.Table, k: int, floors: dict[object, np.ndarray] | None = None) -> Iterator[pa.Table]:
    """(query_id, scope, doc_id, score) of the best k vectors of each scope; vectors are ordered by doc_id. With floors (scope: the k-th best score that a
    query has already), only of those that reach them."""
    coded = vectors.column("scope").combine_chunks().dictionary_encode()
    scopes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    asked = {size: (rows, matrix) for size, rows, matrix in matrices(queries, "embedding")}
    for size, rows, matrix in matrices(vectors, "embedding"):
        if size not in asked:
            continue
        q_rows, q_matrix = asked[size]
        with np.errstate(all="ignore"):
            scores = np.round(matrix @ q_matrix.T, 6) + 0.0
        scores[~np.isfinite(scores)] = -np.inf
        for scope in np.unique(scopes[rows]):
            of = np.flatnonzero(scopes[rows] == scope)
            floor = (floors or {}).get(coded.dictionary[int(scope)].as_py() if scope >= 0 else None)
            at, col = _leading(scores[of], k, None if floor is None else floor[q_rows])
            q, v = pa.array(q_rows[col]), pa.array(rows[of[at]])
            cols = [queries.column("query_id").take(q), vectors.column("scope").take(v), vectors.column("doc_id").take(v), pa.array(scores[of[at], col], pa.float64())]
            yield pa.table(cols, ["query_id", "scope", "doc_id", "score"])


def _leading(scores: np.ndarray, k: int, floor: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the best k of each column from its floor on; of ties the first rows. Columns are cut before anything is sorted."""
    n = len(scores)
    good = scores > -np.inf if floor is None else (scores > -np.inf) & (scores >= floor)
    many = np.flatnonzero(np.count_nonzero(good, axis=0) > k)
    if len(many):
        some = np.ascontiguousarray(scores[:, many].T)
        good[:, many] &= (some >= np.partition(some, n - k, axis=1)[:, n - k, None]).T
    at, col = np.nonzero(good)
    turn = np.lexsort((at, -scores[at, col], col))
    at, col = at[turn], col[turn]
    sizes = np.bincount(col, minlength=scores.shape[1])
    kept = np.arange(len(col)) - np.repeat(np.cumsum(sizes) - sizes, sizes) < k
    return at[kept], col[kept]


def floors_of(best: pa.Table, queries: pa.Table, k: int) -> dict[object, np.ndarray]:
    """The k-th best scores that the queries of a block have in each scope, of rows as `best_rows` gives them; where there are fewer, minus infinity."""
    q = pc.index_in(best.column("query_id").combine_chunks(), value_set=queries.column("query_id").combine_chunks()).to_numpy(zero_copy_only=False)
    scopes = best.column("scope").combine_chunks().dictionary_encode()
    code, score = scopes.indices.fill_null(-1).to_numpy(zero_copy_only=False), best.column("score").to_numpy()
    last = np.flatnonzero(np.r_[(q[1:] != q[:-1]) | (code[1:] != code[:-1]), True]) if len(q) else q
    full = last[np.diff(np.r_[-1, last]) >= k].astype(int)
    out = {}
    for c in np.unique(code[full]):
        out[scopes.dictionary[int(c)].as_py() if c >= 0 else None] = found = np.full(queries.num_rows, -np.inf)
        found[q[full[code[full] == c]]] = score[full[code[full] == c]]
    return out


def best_rows(tables: list[pa.Table], k: int) -> pa.Table:
    """The best k rows of each (query_id, scope)."""
    rows = pa.concat_tables(tables)
    rows = rows.take(pc.sort_indices(rows, [("query_id", "ascending"), ("scope", "ascending"), ("score", "descending"), ("doc_id", "ascending")]))
    code = lambda name: rows.column(name).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    q, scope = code("query_id"), code("scope")
    first = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (scope[1:] != scope[:-1])][: len(q)])
    turn = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return rows.filter(pa.array(turn < k))


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP_K, scopes: DataFrame | None = None) -> DataFrame:
    """(query_id, scope, doc_id, score, rank 1..k) of unit vectors, for sets of queries that grow with the vectors.

    Blocks of queries meet blocks of vectors in matrix products: all against all, or with scopes (query_id, scope) only blocks
    of one scope, by a join on it. A task keeps the best k of each query and
    scope over its vectors, so that what is dealt out grows with the queries and tasks; beyond HELD_ROWS it hands on what it has.
    Up to BROADCAST_QUERIES the queries are broadcast, beyond it the blocks are a Cartesian product. Vectors of other lengths
    or that are not finite give no score.
    """
    spark = vectors.sparkSession
    n = queries.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    tasks = max(2, spark.sparkContext.defaultParallelism)
    if scopes is None:
        asked = packed(queries.select("query_id", "embedding").repartition(blocks), QUERY_BLOCK).withColumnRenamed("block", "asked")
        dealt = vectors.select("scope", "doc_id", "embedding").repartition(tasks)
        pairs = packed(dealt, VECTOR_BLOCK).crossJoin(F.broadcast(asked) if n <= BROADCAST_QUERIES else asked)
    else:
        own = queries.select("query_id", "embedding").join(scopes.select("query_id", "scope").distinct(), "query_id")
        asked = packed(own.repartition(blocks, "scope").sortWithinPartitions("scope"), QUERY_BLOCK, "scope").withColumnRenamed("block", "asked")
        some = vectors.select("scope", "doc_id", "embedding").join(small(scopes.select("scope").distinct()), "scope", "left_semi")
        dealt = some.repartition(tasks, "scope", F.pmod(F.hash("doc_id"), F.lit(tasks))).sortWithinPartitions("scope")  # a large scope is dealt to all tasks
        pairs = packed(dealt, VECTOR_BLOCK, "scope").join(F.broadcast(asked) if n <= BROADCAST_QUERIES else asked, "scope").select("block", "asked")
    kinds = {"query_id": queries.schema["query_id"].dataType, "scope": vectors.schema["scope"].dataType, "doc_id": vectors.schema["doc_id"].dataType}
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    most = HELD_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, pa.Table] = {}
        floors: dict[bytes, dict[object, np.ndarray]] = {}
        for batch in batches:
            for block, asks in zip(batch.column("block"), batch.column("asked"), strict=True):
                rows = pa.ipc.open_stream(block.as_buffer()).read_all().sort_by("doc_id")
                of = pa.ipc.open_stream(asks.as_buffer()).read_all()
                key = hashlib.blake2b(asks.as_buffer(), digest_size=16).digest()
                found = [t for t in best_of_blocks(rows, of, k, floors.get(key)) if t.num_rows]
                if not found:
                    continue
                held[key] = best_rows([held[key], *found] if key in held else found, k)
                floors[key] = floors_of(held[key], of, k)
                if sum(t.num_rows for t in held.values()) > most:
                    for best in held.values():
                        yield from best.combine_chunks().to_batches()
                    held, floors = {}, {}
        for best in held.values():
            yield from best.combine_chunks().to_batches()

    schema = ", ".join(f"{name} {kind.simpleString()}" for name, kind in kinds.items()) + ", score double"
    return top_k(pairs.mapInArrow(run, schema), k)


def top_k(scored: DataFrame, k: int = TOP_K, positive: bool = False, by: tuple[str, ...] = ("query_id", "scope")) -> DataFrame:
    """rank 1..k by (score descending, doc_id); positive drops scores of zero or less after the cut."""
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)
    return ranked.where("score > 0") if positive else ranked


def rrf(rankings: DataFrame, k: int = RRF_K, by: tuple[str, ...] = ("query_id", "scope")) -> DataFrame:
    """Rank fusion of rows (list, rank, doc_id): the sum of 1 / (k + rank), of first occurrences in each list."""
    first = rankings.groupBy(*by, "list", "doc_id").agg(F.min("rank").alias("rank"))
    fused = first.groupBy(*by, "doc_id").agg(F.sum(F.round(F.lit(1.0) / (k + F.col("rank")), 12).cast("decimal(20,12)")).cast("double").alias("score"))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "doc_id")))


# What a question's words add to the query, in this order.
EXPANSIONS = [
    (["cybersecurity", "cyber security"], "Item 1C Cybersecurity risk management"),
    (["risk factor"], "Item 1A Risk Factors"),
    (["business description"], "Item 1 Business Company Background products services operations"),
    (["cloud+business"], "Item 1 Business Item 7 Management Discussion cloud services Azure AWS"),
    (["supply chain"], "Item 1A Risk Factors supply chain suppliers manufacturing outsourcing partners"),
    (["climate"], "Item 1A Risk Factors climate environmental sustainability"),
    (["competition", "competitive"], "Item 1A Risk Factors competition competitive market"),
]


def _has(text: Column, word: str) -> Column:
    out = F.lit(True)
    for part in word.split("+"):
        out = out & text.contains(part)
    return out


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | _has(text, word)
    return out


def expand_query(question: Column) -> Column:
    """The question with the section words that its intents call for."""
    low = F.lower(question)
    parts = [F.when(_any(low, words), F.lit(add)) for words, add in EXPANSIONS]
    item_1a = _any(low, ["risk factor", "supply chain", "climate", "competition", "competitive"])
    parts.append(F.when(low.contains("risk") & ~item_1a, F.lit("Item 1A Risk Factors")))
    busy = _any(low, ["risk", "cybersecurity", "supply chain", "climate", "competition", "cloud", "business description"])
    parts.append(F.when(low.contains("business") & ~busy, F.lit("Item 1 Business")))
    return F.concat_ws(" ", question, *parts)


def intents(question: Column) -> Column:
    low = F.lower(question)
    found = [
        F.when(_any(low, ["cybersecurity", "cyber security"]), "cybersecurity"),
        F.when(low.contains("risk factor"), "risk_factors").when(low.contains("risk"), "risk"),
        F.when(low.contains("business description"), "business_description"), F.when(low.contains("business"), "business"),
        F.when(_has(low, "cloud+business"), "cloud_business").when(low.contains("cloud"), "cloud"),
        F.when(low.contains("supply chain"), "supply_chain"), F.when(low.contains("climate"), "climate"), F.when(_any(low, ["competition", "competitive"]), "competition"),
    ]
    return F.array_compact(F.array(*found))


def section_boost(found: Column, section: Column) -> Column:
    """The sum of what a section gains or loses for the intents of a question."""
    low = F.lower(F.coalesce(section, F.lit("")))
    is_any = lambda *names: F.arrays_overlap(found, F.array(*map(F.lit, names)))
    add = lambda when, x: F.when(when, F.lit(x)).otherwise(F.lit(0.0))
    lettered = low.contains("item 1a") | low.contains("item 1b") | low.contains("item 1c")
    item_1 = low.contains("item 1")
    return (
        add(is_any("risk_factors", "risk", "supply_chain", "climate", "competition") & (low.contains("risk factor") | low.contains("item 1a")), 0.25)
        + add(is_any("cybersecurity") & (low.contains("item 1c") | low.contains("cybersecurity")), 0.30)
        + F.when(is_any("business_description", "business"), F.when(item_1 & low.contains("business"), F.when(lettered, 0.0).otherwise(0.35)).when(F.trim(low).isin("item 1", "item 1 —"), 0.20).otherwise(0.0)).otherwise(0.0)
        + add(is_any("cloud_business", "cloud") & low.contains("business") & item_1 & ~lettered, 0.25)
        + add(is_any("cloud_business", "cloud") & (low.contains("item 7") | low.contains("md&a") | (low.contains("management") & low.contains("discussion"))), 0.20)
        + add(is_any("cloud_business", "cloud") & low.contains("cloud"), 0.15)
        + add(is_any("supply_chain") & (low.contains("supply chain") | low.contains("supplier")), 0.10)
        + add((F.size(found) > 0) & low.contains("front matter"), -0.35)
    )


def boosted(score: Column, boost: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score + boost))


def sigmoid(logit: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), logit))))


def pooled_scores(windows: DataFrame, keys: list[str]) -> DataFrame:
    """The greatest logit over a text's windows, through the sigmoid."""
    return windows.groupBy(*keys).agg(sigmoid(F.max("logit")).alias("score"))


def threshold_or_promote(ranked: DataFrame, below: float = ABSTAIN_BELOW, floor: float = PROMOTE_FLOOR, k: int = RERANK_K, by: tuple[str, ...] = ("query_id", "scope")) -> DataFrame:
    """Eligible rows of (score, relevant, wrong): those over the threshold, without wrong sections where the group has a relevant
    one; where that leaves none, the best k relevant rows over the floor."""
    group = Window.partitionBy(*by)
    rows = ranked.withColumn("over", F.col("score") >= below).withColumn("any_relevant", F.max(F.col("relevant").cast("int")).over(group) == 1)
    rows = rows.withColumn("right", F.col("over") & ~(F.col("any_relevant") & F.col("wrong"))).withColumn("left", F.sum(F.col("right").cast("int")).over(group)).withColumn("n_over", F.sum(F.col("over").cast("int")).over(group))
    spare = F.col("relevant") & (F.col("score") >= floor)
    rows = rows.withColumn("turn", F.row_number().over(group.orderBy(F.desc(spare), F.desc("score"), "doc_id"))).withColumn("spares", F.sum(spare.cast("int")).over(group))
    promoted = (F.col("n_over") > 0) & (F.col("left") == 0) & spare & (F.col("turn") <= k)
    unchanged = (F.col("n_over") > 0) & (F.col("left") == 0) & (F.col("spares") == 0) & F.col("over")
    return rows.where(F.col("right") | promoted | unchanged).withColumn("how", F.when(F.col("right"), "threshold").when(promoted, "promoted").otherwise("unfiltered")).drop("over", "any_relevant", "right", "left", "n_over", "turn", "spares")


def interleave(ranked: DataFrame, group: str, dedupe: list[str], limit: int | None = FINAL_K, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Round-robin over groups by rank, the first of rows equal in `dedupe` kept, at most `limit` a query (None: all)."""
    once = ranked.withColumn("n", F.row_number().over(Window.partitionBy(*by, *dedupe).orderBy("rank", group, "doc_id"))).where("n = 1").drop("n")
    out = once.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy("rank", group, "doc_id")))
    return out.where(F.col("position") <= limit) if limit is not None else out


def mean_pool(vectors: DataFrame, keys: list[str], column: str = "embedding") -> DataFrame:
    """The mean of unit vectors of each key, made a unit vector again: dimension-wise sums, combined before the shuffle."""
    dims = vectors.select(*keys, F.posexplode(column).alias("dim", "x")).groupBy(*keys, "dim").agg((F.sum(F.round(F.col("x").cast("double"), 9).cast("decimal(28,9)")).cast("double") / F.count("*")).alias("x"))
    mean = dims.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("mean"))
    size = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda s, x: s + x * x))
    return mean.select(*keys, F.when(size > 0, F.transform("mean", lambda x: x / size)).alias(column))


def token_windows(tokens: Column, size: int | Column = 380) -> Column:
    """Consecutive windows of `size` tokens; no window for no token. Give it a column of tokens: an expression is computed anew for each window."""
    size = F.lit(size) if isinstance(size, int) else size
    starts = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1, size)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(tokens, i + 1, size))


def reranked(shortlist: DataFrame, reranker: Callable[[Column, Column], Column] = overlap_logit, size: int | Column = 380) -> DataFrame:
    """shortlist (query_id, query, scope, doc_id, text) with the score of its best window: the reranker's logit of the query and each
    window of `size` tokens, the greatest through the sigmoid. A text without a token is one empty window."""
    size = size if isinstance(size, Column) else F.lit(size)
    if reranker is overlap_logit:
        return _by_overlap(shortlist, size)
    words = shortlist.select("query_id", "scope", "doc_id", "query", size.alias("size"), lexical(F.col("text")).alias("words"))
    windows = words.select("query_id", "scope", "doc_id", "query", token_windows(F.col("words"), F.col("size")).alias("windows"))
    windows = windows.withColumn("windows", F.when(F.size("windows") > 0, F.transform("windows", lambda w: F.array_join(w, " "))).otherwise(F.array(F.lit(""))))
    logits = windows.select("query_id", "scope", "doc_id", "query", F.explode_outer("windows").alias("window")).select("query_id", "scope", "doc_id", reranker(F.col("query"), F.col("window")).alias("logit"))
    return shortlist.join(pooled_scores(logits, ["query_id", "scope", "doc_id"]), ["query_id", "scope", "doc_id"])


def _by_overlap(shortlist: DataFrame, size: Column) -> DataFrame:
    """The same by `overlap_logit`, whose words are those of `lexical`: a question's words are taken once for a text, not for each of its windows, and rows stay whole."""
    words = shortlist.select(*shortlist.columns, size.alias("_size"), F.array_distinct(lexical(F.col("query"))).alias("_asked"), lexical(F.col("text")).alias("_words"))
    windows = F.when(F.size("_words") > 0, token_windows(F.col("_words"), F.col("_size"))).otherwise(F.array(F.array().cast("array<string>")))
    shared = F.array_max(F.transform(windows, lambda w: F.size(F.array_intersect("_asked", w))))
    logit = shared / F.greatest(F.size("_asked"), F.lit(1)) * 8 - 4
    return words.select(*shortlist.columns, sigmoid(logit).alias("score"))


# Tokens that query and text share in a reranker, those that mark their ends, and the least and most of a window.
PAIR_TOKENS, SPECIAL_TOKENS, LEAST_WINDOW, MOST_WINDOW = 512, 3, 32, 350


def rerank_window(query: Column) -> Column:
    """Tokens of text that fit beside the query; null where fewer than LEAST_WINDOW do, so that the question must be narrowed."""
    left = F.least(F.lit(MOST_WINDOW), PAIR_TOKENS - SPECIAL_TOKENS - F.size(lexical(query)))
    return F.when(left >= LEAST_WINDOW, left)


def question_errors(queries: DataFrame, scopes: DataFrame, known: DataFrame, limit: int = FINAL_K) -> DataFrame:
    """(query_id, reason) of questions (query_id, query) that cannot be searched: blank, too long for the reranker, without a scope, with one
    that is not in known (scope), or with more scopes than places in the final context."""
    counted = scopes.join(known.select("scope").distinct().withColumn("known", F.lit(True)), "scope", "left").groupBy("query_id").agg(F.count_distinct("scope").alias("n"), F.bool_and(F.coalesce("known", F.lit(False))).alias("all_known"))
    reason = (
        F.when(F.trim(F.coalesce("query", F.lit(""))) == "", "blank question").when(F.col("n").isNull(), "no scope").when(~F.col("all_known"), "unknown scope")
        .when(F.col("n") > limit, "more scopes than final places").when(rerank_window(expand_query(F.col("query"))).isNull(), "question too long for the reranker")
    )
    return queries.join(counted, "query_id", "left").select("query_id", reason.alias("reason")).where("reason IS NOT NULL")


def shortlisted(lexical_scores: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = TOP_K, scopes: DataFrame | None = None, min_score: float = 0.0, rerank_k: int = RERANK_K) -> DataFrame:
    """(query_id, scope, doc_id, rank): lexical and dense top k in each scope, fused, from the fused score `min_score` on."""
    lexical_top = top_k(lexical_scores, k, positive=True).withColumn("list", F.lit("lexical"))
    dense_top = dense_top_k(vectors, queries, k, scopes).withColumn("list", F.lit("dense"))
    fused = rrf(lexical_top.unionByName(dense_top)).where((F.col("rank") <= rerank_k) & (F.col("score") >= min_score))
    return fused.drop("score")


def chosen(shortlist: DataFrame, reranker: Callable[[Column, Column], Column] = overlap_logit, final: int | None = FINAL_K, below: float = ABSTAIN_BELOW) -> DataFrame:
    """The final context of shortlist (query_id, query, found, scope, doc_id, section, text): reranked, boosted by section, put under the
    threshold, scopes interleaved."""
    boost = section_boost(F.col("found"), F.col("section"))
    scored = reranked(shortlist, reranker, F.coalesce(rerank_window(F.col("query")), F.lit(LEAST_WINDOW)))
    scored = scored.withColumn("score", F.round(boosted(F.col("score"), boost), DIGITS)).withColumn("relevant", boost > 0).withColumn("wrong", F.lower(F.coalesce("section", F.lit(""))).contains("front matter"))
    kept = threshold_or_promote(scored, below)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "scope").orderBy(F.desc("score"), "doc_id")))
    return interleave(kept, "scope", ["scope", "text"], final).select("query_id", "position", "scope", "doc_id", "score", "how")


def retrieve(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = TOP_K, scopes: DataFrame | None = None, reranker: Callable[[Column, Column], Column] = overlap_logit, index: dict[str, DataFrame] | None = None, min_score: float = 0.0, below: float = ABSTAIN_BELOW) -> DataFrame:
    """Hybrid retrieval of a batch: queries (query_id, query, embedding). Lexical and dense top k in each scope, fused; the first
    RERANK_K of each scope reranked against the expanded query, boosted by section and put under the threshold; scopes
    interleaved, FINAL_K a query.
    scopes (query_id, scope) names which scopes a query may look at; without it, all. With `index` (postings, terms, lengths) nothing
    is counted anew; only the texts of the shortlist are read. More than FEW_QUERIES to all scopes are scored in blocks, with the same results: their
    words in all documents are not made rows."""
    expanded = queries.select("query_id", expand_query(F.col("query")).alias("query"), intents(F.col("query")).alias("found"))
    asked = expanded.select("query_id", "query")
    if index is not None:
        lexical_scores = bm25_of_index(index, asked, scopes)
    elif scopes is None and queries.limit(FEW_QUERIES + 1).count() > FEW_QUERIES:
        from quillstone.operators import blocks  # which is made of this module's parts

        lexical_scores = blocks.top_k(blocks.from_chunks(chunks), term_stats(chunks), asked, k)
    else:
        own = chunks if scopes is None else chunks.join(small(scopes.select("scope").distinct()), "scope", "left_semi")
        lexical_scores = bm25(own, asked)
        if scopes is not None:
            lexical_scores = lexical_scores.join(scopes.select("query_id", "scope"), ["query_id", "scope"], "left_semi")
    short = settled(shortlisted(lexical_scores, vectors, queries, k, scopes, min_score), "shortlist")
    shortlist = chunks.select("scope", "doc_id", "section", "text").join(small(short), ["scope", "doc_id"]).join(expanded, "query_id")
    return chosen(settled(shortlist, "shortlisted"), reranker, below=below)
