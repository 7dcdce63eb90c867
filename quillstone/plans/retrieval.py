"""Queries of the retrieval operators: documents with their language as scope, embeddings with their label as scope."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import blocks, cells, segments
from quillstone.operators import retrieval as ops
from quillstone.session import small, table

QUESTIONS = [("q1", "the and risk of supply chain"), ("q2", "licensed under the apache license"), ("q3", "und der die cloud business"), ("q4", "la que de los the the")]


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("scope"), "doc_id", "text")


def _questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "query_id string, query string")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("scope"), F.col("vec_id").alias("doc_id"), "embedding")


def term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = ops.postings(_chunks(spark, sf_dir))
    return posts.groupBy("scope", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"), F.max("tf").alias("most"))


def term_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.term_stats(_chunks(spark, sf_dir)).select("scope", "term", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ops.bm25(_chunks(spark, sf_dir), _questions(spark)).withColumn("score", F.round("score", 5))
    return ops.top_k(scored, positive=True).select("query_id", "scope", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector against all vectors: the best 20 of each label."""
    return ops.dense_top_k(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir)).select("query_id", "scope", "doc_id", "score")


def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rankings of each customer segment: by balance and by key."""
    c = table(spark, sf_dir, "customer").select(F.lit(1).alias("query_id"), F.col("c_mktsegment").alias("scope"), F.col("c_custkey").alias("doc_id"), "c_acctbal")
    one = ops.top_k(c.withColumn("score", F.col("c_acctbal"))).withColumn("list", F.lit("balance"))
    two = ops.top_k(c.withColumn("score", -F.col("doc_id").cast("double"))).withColumn("list", F.lit("key"))
    cols = ["query_id", "scope", "list", "rank", "doc_id"]
    return ops.rrf(one.select(*cols).union(two.select(*cols))).select("scope", "doc_id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a section by language, and a score from their length."""
    section = F.when(F.col("lang") == "en", "Item 1A. Risk Factors").when(F.col("lang") == "fr", "Item 1. Business").when(F.col("lang") == "de", "Front Matter").otherwise("Item 7. MD&A")
    return table(spark, sf_dir, "documents").select(F.lit(1).alias("query_id"), F.col("source").alias("scope"), "doc_id", section.alias("section"), F.round((F.col("n_chars") % 1000) / 1000.0, 3).alias("base"))


def boost_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.intents(F.lit("supply chain risk of the cloud business"))
    rows = _sections(spark, sf_dir)
    score = F.round(ops.boosted(F.col("base"), ops.section_boost(found, F.col("section"))), 6)
    return rows.select("doc_id", "section", score.alias("score"), (score >= ops.ABSTAIN_BELOW).alias("eligible"))


def promote_or_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sections(spark, sf_dir).select("query_id", "scope", "doc_id", F.col("base").alias("score"), F.col("section").startswith("Item 1A").alias("relevant"), (F.col("section") == "Front Matter").alias("wrong"))
    return ops.threshold_or_promote(rows, below=0.99, floor=0.15).select("scope", "doc_id", "how")


def interleave_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector against all vectors: labels in turn, six a query."""
    found = ops.dense_top_k(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir))
    return ops.interleave(found, "scope", ["scope", "doc_id"]).select("query_id", F.col("position").cast("long").alias("position"), "scope", "doc_id")


def mean_pool_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.mean_pool(_vectors(spark, sf_dir), ["scope"])
    return out.select("scope", F.posexplode("embedding").alias("dim", "x")).select("scope", F.col("dim").cast("long").alias("dim"), F.round("x", 5).alias("x"))


def sigmoid_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = table(spark, sf_dir, "events").select("user_id", (F.col("value") / 10).alias("logit"))
    return ops.pooled_scores(windows, ["user_id"]).select("user_id", F.round("score", 9).alias("score"))


def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", ops.lexical(F.col("text")).alias("words"))
    rows = words.select("doc_id", ops.token_windows(F.col("words")).alias("w"))
    # An outer explode: for the other one Spark asks beforehand whether there are windows, and makes them all anew for that.
    return rows.select("doc_id", F.posexplode_outer("w").alias("n", "w")).where("n IS NOT NULL").select("doc_id", F.col("n").cast("long").alias("n"), F.size("w").cast("long").alias("n_tokens"), F.element_at("w", 1).alias("first"), F.element_at("w", -1).alias("last"))


def expand_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expansion and intents of questions made of each segment's name and fixed words."""
    words = F.array(*map(F.lit, ["cyber security", "risk factor", "risk", "business", "cloud", "cloud business", "supply chain", "climate", "competitive", "business description", "plain"]))
    q = table(spark, sf_dir, "customer").select("c_mktsegment").distinct().select("c_mktsegment", F.explode(words).alias("word")).select(F.concat(F.lit("What about "), "word", F.lit(" for "), F.lower("c_mktsegment"), F.lit("?")).alias("question"))
    return q.select("question", ops.expand_query(F.col("question")).alias("expanded"), F.array_join(ops.intents(F.col("question")), ",").alias("intents"))


def _embedded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Chunks and vectors of all documents, each with the vector whose number is that of the document modulo the number of vectors. Texts are not
    dealt out for that: only ids meet vectors."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = vectors.agg(F.max("vec_id") + 1).first()[0]
    section = F.when(F.col("lang") == "en", "Item 1A. Risk Factors").otherwise("Item 1. Business")
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("scope"), "doc_id", "text", section.alias("section"), (F.col("doc_id") % n).alias("vec_id"))
    chunks = docs.join(small(vectors.select("vec_id")), "vec_id", "left_semi").select("scope", "doc_id", "text", "section")
    return chunks, docs.select("scope", "doc_id", "vec_id").join(vectors, "vec_id").select("scope", "doc_id", "embedding")


def hybrid_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four questions, with vectors 1 to 4 as theirs, to all documents."""
    chunks, vectors = _embedded(spark, sf_dir)
    asked = _questions(spark).select(F.regexp_extract("query_id", r"\d+", 0).cast("long").alias("vec_id"), "query_id", "query").join(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id")
    found = ops.retrieve(chunks, vectors, asked.drop("vec_id"))
    return found.withColumn("position", F.col("position").cast("long"))


def bm25_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four questions to an index's tables instead of the documents."""
    chunks = _chunks(spark, sf_dir)
    tables = {"postings": ops.postings(chunks), "terms": ops.term_stats(chunks), "lengths": ops.doc_stats(chunks)}
    scored = ops.bm25_of_index(tables, _questions(spark)).withColumn("score", F.round("score", 5))
    return ops.top_k(scored, positive=True).select("query_id", "scope", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def scoped_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector against the vectors of its own label alone: blocks of one label meet."""
    asked = _every_hundredth(table(spark, sf_dir, "embeddings"), "vec_id")
    scopes = asked.select(F.col("vec_id").alias("query_id"), F.col("label").alias("scope"))
    found = ops.dense_top_k(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir), scopes=scopes)
    return found.select("query_id", "scope", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def _every_hundredth(frame: DataFrame, key: str) -> DataFrame:
    """The queries of the searches: rows whose id is divisible by 100."""
    return frame.where(F.col(key) % 100 == 0)


def _vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _every_hundredth(table(spark, sf_dir, "embeddings"), "vec_id").select(F.col("vec_id").alias("query_id"), "embedding")


def dense_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector against an index of all vectors: the best 20 of each label, exactly."""
    vectors = _vectors(spark, sf_dir)
    centroids = cells.fit(vectors)
    found = cells.search(cells.build(vectors, centroids), _vector_queries(spark, sf_dir), centroids)
    return found.select("query_id", "scope", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth document as a question to all documents: the best 20 of each language."""
    asked = _every_hundredth(table(spark, sf_dir, "documents"), "doc_id").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    chunks = _chunks(spark, sf_dir)
    found = blocks.top_k(blocks.from_chunks(chunks), ops.term_stats(chunks), asked, digits=5)
    return found.select("query_id", "scope", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth document, with its vector, as a question to all documents."""
    chunks, vectors = _embedded(spark, sf_dir)
    asked = _every_hundredth(chunks, "doc_id").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    own = _every_hundredth(vectors, "doc_id").select(F.col("doc_id").alias("query_id"), "embedding")
    return ops.retrieve(chunks, vectors, asked.join(own, "query_id"))


def _grown(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """An index that grew: two segments of all documents by parity, a third with new editions of every eleventh, and every seventh removed."""
    chunks = _chunks(spark, sf_dir)
    parts = [segments.segment(chunks.where(F.pmod("doc_id", F.lit(2)) == k), f"half{k}") for k in (0, 1)]
    newer = chunks.where("doc_id % 11 = 5").withColumn("text", F.concat("text", F.lit(" revised edition")))
    index = segments.replace(segments.joined(*parts), segments.segment(newer, "editions"))
    return segments.live(segments.remove(index, chunks.where("doc_id % 7 = 3")))


def segmented_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the grown index, from the counts of its segments."""
    return _grown(spark, sf_dir)["terms"].select("scope", "term", "df", F.round("idf", 6).alias("idf"))


def segmented_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth document as a question to the grown index: the best 20 of each language."""
    asked = _every_hundredth(table(spark, sf_dir, "documents"), "doc_id").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    index = _grown(spark, sf_dir)
    found = blocks.top_k(blocks.from_index(index), index["terms"], asked, digits=5)
    return found.select("query_id", "scope", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


_QUESTIONS_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in QUESTIONS) + ") AS q(query_id, query)"
#: The questions with what their intents add, their vectors, and what English and other sections gain.
_EXPANDED_SQL = """(VALUES ('q1', 'the and risk of supply chain Item 1A Risk Factors supply chain suppliers manufacturing outsourcing partners', 1, 0.25, 0.0), ('q2', 'licensed under the apache license', 2, 0.0, 0.0),
  ('q3', 'und der die cloud business Item 1 Business Item 7 Management Discussion cloud services Azure AWS', 3, 0.0, 0.60), ('q4', 'la que de los the the', 4, 0.0, 0.0)) AS x(query_id, query, probe, boost_en, boost_other)"""
_POSTS_SQL = """
WITH toks AS (SELECT lang AS scope, doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
posts AS (SELECT scope, doc_id, term, count(*) AS tf FROM (SELECT scope, doc_id, unnest(w) AS term FROM toks) GROUP BY ALL),
df AS (SELECT scope, term, count(*) AS df, sum(tf) AS total, max(tf) AS most FROM posts GROUP BY ALL),
raw AS (SELECT df.*, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df JOIN (SELECT scope, count(*) AS n FROM toks GROUP BY 1) USING (scope)),
idf AS (SELECT scope, term, df, CASE WHEN raw < 0 THEN 0.25 * m ELSE raw END AS idf FROM raw JOIN (SELECT scope, sum(CAST(round(raw, 9) AS DECIMAL(28,9)))::DOUBLE / count(*) AS m FROM raw GROUP BY 1) USING (scope))
"""
_DENSE_SQL = """
WITH s AS (SELECT q.vec_id AS query_id, d.label AS scope, d.vec_id AS doc_id, round(list_inner_product(d.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings d, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id, scope ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 20)
"""
_SECTION_SQL = "WITH s AS (SELECT source AS scope, doc_id, CASE lang WHEN 'en' THEN 'Item 1A. Risk Factors' WHEN 'fr' THEN 'Item 1. Business' WHEN 'de' THEN 'Front Matter' ELSE 'Item 7. MD&A' END AS section, round((n_chars % 1000) / 1000.0, 3)::DOUBLE AS base FROM documents)"

_BM25_SQL = _POSTS_SQL + f""", dl AS (SELECT scope, doc_id, len(w) AS dl, avg(len(w)) OVER (PARTITION BY scope) AS avgdl FROM toks),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS term FROM {_QUESTIONS_SQL}) GROUP BY ALL),
g AS (SELECT query_id, scope, doc_id, round(sum(CAST(round(idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)) * qtf, 9) AS DECIMAL(28,9)))::DOUBLE, 5) AS score
      FROM posts JOIN qt USING (term) JOIN idf USING (scope, term) JOIN dl USING (scope, doc_id) GROUP BY ALL)
SELECT query_id, scope, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, scope ORDER BY score DESC, doc_id) AS rank FROM g) WHERE rank <= 20 AND score > 0"""
_HYBRID_SQL = _POSTS_SQL + f""", dl AS (SELECT scope, doc_id, w, len(w) AS dl, avg(len(w)) OVER (PARTITION BY scope) AS avgdl FROM toks),
q AS (SELECT *, list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')) AS words, least(350, 512 - 3 - len(regexp_extract_all(lower(query), '[a-z0-9]+'))) AS size FROM {_EXPANDED_SQL}),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS term FROM q) GROUP BY ALL),
g AS (SELECT query_id, scope, doc_id, sum(CAST(round(idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)) * qtf, 9) AS DECIMAL(28,9)))::DOUBLE AS score FROM posts JOIN qt USING (term) JOIN idf USING (scope, term) JOIN dl USING (scope, doc_id) GROUP BY ALL),
lex AS (SELECT query_id, scope, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, scope ORDER BY score DESC, doc_id) AS rank FROM g) WHERE rank <= 20 AND score > 0),
v AS (SELECT lang AS scope, doc_id, embedding FROM documents JOIN embeddings ON doc_id % (SELECT max(vec_id) + 1 FROM embeddings) = vec_id),
den AS (SELECT query_id, scope, doc_id, row_number() OVER (PARTITION BY query_id, scope ORDER BY round(list_inner_product(v.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) DESC, doc_id) AS rank FROM v, q JOIN embeddings e ON e.vec_id = q.probe QUALIFY rank <= 20),
summed AS (SELECT query_id, scope, doc_id, sum(CAST(round(1.0::DOUBLE / (60 + rank), 12) AS DECIMAL(20,12))) AS score FROM (SELECT * FROM lex UNION ALL SELECT * FROM den) GROUP BY query_id, scope, doc_id),
fused AS (SELECT query_id, scope, doc_id FROM summed QUALIFY row_number() OVER (PARTITION BY query_id, scope ORDER BY score DESC, doc_id) <= 8),
wins AS (SELECT query_id, scope, doc_id, boost_en, boost_other, words, w[s + 1 : s + size] AS win FROM (SELECT query_id, scope, doc_id, boost_en, boost_other, words, w, size, unnest(range(0, greatest(len(w), 1), size)) AS s FROM fused JOIN q USING (query_id) JOIN dl USING (scope, doc_id))),
scored AS (SELECT query_id, scope, doc_id, round(greatest(0, least(1, 1 / (1 + exp(-max(len(list_intersect(words, win)) / len(words) * 8 - 4))) + any_value(CASE scope WHEN 'en' THEN boost_en ELSE boost_other END))), 9) AS score FROM wins GROUP BY query_id, scope, doc_id),
kept AS (SELECT s.*, text, row_number() OVER (PARTITION BY query_id, s.scope ORDER BY score DESC, doc_id) AS rank FROM scored s JOIN documents d USING (doc_id) WHERE score >= 0.25),
once AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY query_id, scope, text ORDER BY rank, scope, doc_id) = 1)
SELECT query_id, position, scope, doc_id, score, 'threshold' AS how FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, scope, doc_id) AS position FROM once) WHERE position <= 6"""
QUERIES = {f.__name__: f for f in (term_frequencies, term_idf, bm25_topk, dense_topk, rrf_fuse, boost_threshold, promote_or_filter, interleave_select, mean_pool_embedding, sigmoid_pool, token_windows, expand_questions, hybrid_retrieve, bm25_index, scoped_search, dense_search, bm25_search, hybrid_search, segmented_terms, segmented_search)}
_WORDS = ["cyber security", "risk factor", "risk", "business", "cloud", "cloud business", "supply chain", "climate", "competitive", "business description", "plain"]
_EXPAND_SQL = f"""WITH q AS (SELECT 'What about ' || word || ' for ' || lower(s) || '?' AS question FROM (SELECT DISTINCT c_mktsegment AS s FROM customer), (SELECT unnest({_WORDS}) AS word)), l AS (SELECT question, lower(question) AS t FROM q)
SELECT question, concat_ws(' ', question, CASE WHEN contains(t, 'cyber security') OR contains(t, 'cybersecurity') THEN 'Item 1C Cybersecurity risk management' END, CASE WHEN contains(t, 'risk factor') THEN 'Item 1A Risk Factors' END,
  CASE WHEN contains(t, 'business description') THEN 'Item 1 Business Company Background products services operations' END, CASE WHEN contains(t, 'cloud') AND contains(t, 'business') THEN 'Item 1 Business Item 7 Management Discussion cloud services Azure AWS' END,
  CASE WHEN contains(t, 'supply chain') THEN 'Item 1A Risk Factors supply chain suppliers manufacturing outsourcing partners' END, CASE WHEN contains(t, 'climate') THEN 'Item 1A Risk Factors climate environmental sustainability' END,
  CASE WHEN contains(t, 'compet') THEN 'Item 1A Risk Factors competition competitive market' END, CASE WHEN contains(t, 'risk') AND NOT contains(t, 'risk factor') THEN 'Item 1A Risk Factors' END, CASE WHEN contains(t, 'about business for') THEN 'Item 1 Business' END) AS expanded,
  concat_ws(',', CASE WHEN contains(t, 'cyber security') THEN 'cybersecurity' END, CASE WHEN contains(t, 'risk factor') THEN 'risk_factors' WHEN contains(t, 'risk') THEN 'risk' END, CASE WHEN contains(t, 'business description') THEN 'business_description' END, CASE WHEN contains(t, 'business') THEN 'business' END,
  CASE WHEN contains(t, 'cloud') AND contains(t, 'business') THEN 'cloud_business' WHEN contains(t, 'cloud') THEN 'cloud' END, CASE WHEN contains(t, 'supply chain') THEN 'supply_chain' END, CASE WHEN contains(t, 'climate') THEN 'climate' END, CASE WHEN contains(t, 'compet') THEN 'competition' END) AS intents FROM l"""
_SEARCH_SQL = _DENSE_SQL.replace("SELECT q.vec_id AS query_id", "SELECT q.vec_id AS query_id, q.label AS own")
_BM25_SEARCH_SQL = _BM25_SQL.replace(_QUESTIONS_SQL, "(SELECT doc_id AS query_id, text AS query FROM documents WHERE doc_id % 100 = 0)")
#: The documents of the grown index.
_GROWN_SQL = "(SELECT doc_id, lang, CASE WHEN doc_id % 11 = 5 THEN text || ' revised edition' ELSE text END AS text FROM documents WHERE doc_id % 7 <> 3)"
ORACLE_SQL = {
    "segmented_terms": _POSTS_SQL.replace("FROM documents", f"FROM {_GROWN_SQL}") + "SELECT scope, term, df, round(idf, 6) AS idf FROM idf",
    "segmented_search": _BM25_SEARCH_SQL.replace("AS w FROM documents", f"AS w FROM {_GROWN_SQL}"),
    "expand_questions": _EXPAND_SQL,
    "hybrid_retrieve": _HYBRID_SQL,
    "dense_search": _DENSE_SQL + "SELECT query_id, scope, doc_id, score, rank FROM top",
    "scoped_search": _SEARCH_SQL + "SELECT query_id, scope, doc_id, score, rank FROM top WHERE own = scope",
    "term_frequencies": _POSTS_SQL + "SELECT scope, term, df, CAST(total AS BIGINT) AS total, most FROM df",
    "term_idf": _POSTS_SQL + "SELECT scope, term, df, round(idf, 6) AS idf FROM idf",
    "bm25_topk": _BM25_SQL,
    "bm25_search": _BM25_SEARCH_SQL,
    "bm25_index": _BM25_SQL,
    "dense_topk": _DENSE_SQL + "SELECT query_id, scope, doc_id, score FROM top",
    "rrf_fuse": """WITH r AS (SELECT c_mktsegment AS scope, c_custkey AS doc_id, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS a, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS b FROM customer),
f AS (SELECT scope, doc_id, round(sum(round(1.0::DOUBLE / (60 + r), 12)), 9) AS score FROM (SELECT scope, doc_id, a AS r FROM r WHERE a <= 20 UNION ALL SELECT scope, doc_id, b FROM r WHERE b <= 20) GROUP BY ALL)
SELECT scope, doc_id, score, row_number() OVER (PARTITION BY scope ORDER BY score DESC, doc_id) AS rank FROM f""",
    "boost_threshold": _SECTION_SQL + """ SELECT doc_id, section, x AS score, x >= 0.25 AS eligible FROM (SELECT doc_id, section,
  round(greatest(0, least(1, base + CASE section WHEN 'Item 1A. Risk Factors' THEN 0.25 WHEN 'Item 1. Business' THEN 0.35 + 0.25 WHEN 'Front Matter' THEN -0.35 ELSE 0.20 END))::DOUBLE, 6) AS x FROM s)""",
    "promote_or_filter": _SECTION_SQL + """, f AS (SELECT *, section LIKE 'Item 1A%' AS relevant, section = 'Front Matter' AS wrong, base >= 0.99 AS over FROM s),
g AS (SELECT *, over AND NOT (bool_or(relevant) OVER w AND wrong) AS ok, bool_or(over) OVER w AS any_over, relevant AND base >= 0.15 AS spare FROM f WINDOW w AS (PARTITION BY scope)),
h AS (SELECT *, bool_or(ok) OVER w AS any_ok, bool_or(spare) OVER w AS any_spare, row_number() OVER (PARTITION BY scope ORDER BY spare DESC, base DESC, doc_id) AS turn FROM g WINDOW w AS (PARTITION BY scope))
SELECT scope, doc_id, CASE WHEN ok THEN 'threshold' WHEN spare AND turn <= 8 THEN 'promoted' ELSE 'unfiltered' END AS how FROM h
WHERE ok OR (any_over AND NOT any_ok AND spare AND turn <= 8) OR (any_over AND NOT any_ok AND NOT any_spare AND over)""",
    "interleave_select": _DENSE_SQL + "SELECT query_id, p AS position, scope, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, scope, doc_id) AS p FROM top) WHERE p <= 6",
    "mean_pool_embedding": """WITH d AS (SELECT label AS scope, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
m AS (SELECT scope, dim, sum(CAST(round(x::DOUBLE, 9) AS DECIMAL(28,9)))::DOUBLE / count(*) AS x FROM d GROUP BY ALL)
SELECT scope, dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY scope)), 5) AS x FROM m""",
    "sigmoid_pool": "SELECT user_id, round(1 / (1 + exp(-greatest(-60, least(60, max(value / 10))))), 9) AS score FROM events GROUP BY user_id",
    "token_windows": """WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(0, len(w), 380)) AS s FROM t)
SELECT doc_id, s // 380 AS n, least(380, len(w) - s) AS n_tokens, w[s + 1] AS first, w[least(s + 380, len(w))] AS last FROM i""",
}
