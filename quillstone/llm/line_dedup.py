"""Line deduplication by distinct-site spread: lines that stand on many sites are boilerplate.

Lines are trimmed and hashed to 64 bits. Lines that occur too rarely to reach ``MIN_SITES`` sites are out after one grouped
count. For the rest a HyperLogLog sketch of the sites is made for each line hash; sketches merge by aggregation, so a line of
a third of all documents is combined before any shuffle. Estimates far from the threshold decide; lines within ``SIGMAS``
standard errors (and one site) of it get exact distinct counts. A line on at least MIN_SITES sites stays where it occurs
first (by doc_id, then place) and goes everywhere else.

All of it is DataFrame operations. Defined results: null text stays null with no lines; blank lines are never counted or
removed; a null source is no site; rows that repeat a document are treated alike; null ids are allowed; text without a
removed line is returned as it was, to the byte.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.shared import materialize, maybe_broadcast, table

MIN_SITES, LG_K, SIGMAS = 8, 10, 4.0


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, site, pos, h) of every line that is not blank."""
    split = docs.select("doc_id", F.xxhash64("text").alias("digest"), F.col("source").alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return split.withColumn("line", F.trim("line")).where("line <> ''").select("doc_id", "digest", "site", "pos", F.xxhash64("line").alias("h"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> tuple[DataFrame, DataFrame]:
    """(h, sites, first) of the lines on at least min_sites sites, and all occurrences of frequent lines."""
    every = lines(docs)
    frequent = materialize(every.select("h").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites).select("h"), "frequent")
    placed = materialize(every.join(maybe_broadcast(frequent, frequent.count(), 1_000_000), "h"), "placed")
    spread = placed.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("estimate"), F.min(F.struct("doc_id", "digest", "pos")).alias("first"))
    margin = SIGMAS * 1.04 / 2 ** (LG_K / 2) * min_sites + 1
    spread = materialize(spread.where(F.col("estimate") >= min_sites - margin), "spread")
    near = spread.where(F.col("estimate") <= min_sites + margin).select("h", "first")
    exact = placed.where("site IS NOT NULL").join(maybe_broadcast(near, near.count()), "h").groupBy("h", "site").agg(F.first("first").alias("first"))
    exact = exact.groupBy("h").agg(F.count("*").alias("sites"), F.first("first").alias("first")).where(F.col("sites") >= min_sites)
    far = spread.where(F.col("estimate") > min_sites + margin).select("h", F.col("estimate").alias("sites"), "first")
    return far.union(exact.select("h", "sites", "first")), placed


def cleaned(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """All columns of docs with `text` cleaned, and n_lines and n_removed as q_lines and q_removed."""
    bad, placed = boilerplate(docs, min_sites)
    bad = materialize(bad, "boilerplate")
    gone = placed.join(maybe_broadcast(bad, bad.count()), "h").where(~F.struct("doc_id", "digest", "pos").eqNullSafe(F.col("first")))
    gone = materialize(gone.groupBy(F.col("doc_id").alias("q_id"), F.col("digest").alias("q_digest")).agg(F.collect_set("pos").alias("q_gone")), "gone")
    # One plan at every size: the documents are dealt by id once and meet their removed lines in a hash table of each partition.
    joined = docs.join(gone.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(gone["q_id"]) & (F.xxhash64(docs["text"]) == gone["q_digest"]), "left")
    # The struct is bound once for each row, so that lines are split once and picked by place: linear in the lines, however many go.
    bound = F.array(F.struct(F.split("text", "\n").alias("lines"), F.col("q_gone").alias("gone")))
    kept = F.transform(bound, lambda s: F.transform(F.array_except(F.sequence(F.lit(0), F.size(s["lines"]) - 1), s["gone"]), lambda i: F.get(s["lines"], i)))[0]
    text = F.when(F.col("q_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))
    return joined.select(*(docs[c] for c in docs.columns if c != "text"), text.alias("q_text"), n_lines.cast("long").alias("q_lines"), F.coalesce(F.size("q_gone"), F.lit(0)).cast("long").alias("q_removed"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_removed, text) for every document."""
    out = cleaned(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", F.col("q_lines").alias("n_lines"), F.col("q_removed").alias("n_removed"), F.col("q_text").alias("text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their boilerplate lines; n_chars follows the text. Documents of which nothing is left go."""
    out = cleaned(docs)
    left = (F.col("q_removed") == 0) | (F.trim("q_text") != "")
    changed = {"text": F.col("q_text"), "n_chars": F.when(F.col("q_removed") > 0, F.char_length("q_text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return out.where(left | F.col("q_text").isNull()).select(*((changed[c] if changed.get(c) is not None else F.col(c)).alias(c) for c in docs.columns))


ORACLE = f"""
WITH split AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
ls AS (SELECT doc_id, source, unnest(ls) AS raw, generate_subscripts(ls, 1) AS pos FROM split),
bad AS (SELECT trim(raw) AS line FROM ls WHERE trim(raw) <> '' GROUP BY 1 HAVING count(DISTINCT source) >= {MIN_SITES}),
first AS (SELECT trim(raw) AS line, min(doc_id * 1000000 + pos) AS place FROM ls WHERE trim(raw) IN (SELECT line FROM bad) GROUP BY 1),
marked AS (SELECT ls.doc_id, pos, raw, first.line IS NOT NULL AND ls.doc_id * 1000000 + pos <> place AS gone FROM ls LEFT JOIN first ON trim(raw) = first.line),
put AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(put.text, d.text) END AS text
FROM documents d LEFT JOIN put ON d.doc_id = put.doc_id
"""
