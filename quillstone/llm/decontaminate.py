"""Benchmark decontamination: an exact containment join of item windows into documents, by prefix filter.

Words are those of the A-Z-lower-cased text. An item's windows are its runs of WINDOW consecutive words, or all of it where
it is shorter. A window's shingles are its runs of three words (of all its words, if fewer). Shingles are ordered by rarity,
counted over the whole corpus; since a document must hold every shingle of a window, the rarest one alone is the necessary
prefix, and windows with a shingle that occurs nowhere are out. Document positions are joined with these prefixes; a
candidate is kept if the window fits between the document's ends (length and position bounds), and verified word by word.

All of it is DataFrame operations. The keys of the benchmark are broadcast if their counted number allows; otherwise the
same joins shuffle positions with the few words around each, and Spark splits the partitions of frequent shingles.

Defined results: null text has no words; rows that repeat a document each get the same result; null ids are allowed (a null
item_id hits words but is not listed); an empty benchmark leaves every document clean; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import shared
from quillstone.llm.shared import ascii_lower, materialize, maybe_broadcast, table

WINDOW, SHINGLE = 10, 3
#: Whatever stands between words; splitting at it is many times faster than extracting matches of its complement.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """(item_id, window, len): each window as its words joined by spaces, which no word holds."""
    found = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0)))
    return found.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, width))).alias("w")).select("item_id", F.array_join("w", " ").alias("window"), F.size("w").alias("len")).distinct()


def window_shingles(wins: DataFrame) -> DataFrame:
    """(window, len, k, at, key): the hashed shingles of distinct windows with their places."""
    w = F.split("window", " ")
    k = F.least(F.col("len"), F.lit(SHINGLE))
    placed = wins.select("window", "len").distinct().select("window", "len", k.alias("k"), w.alias("w"), F.explode(F.sequence(F.lit(0), F.col("len") - k)).alias("at"))
    word = lambda i: F.get("w", F.col("at") + i)
    key = F.when(F.col("k") == 1, F.xxhash64(word(0))).when(F.col("k") == 2, F.xxhash64(word(0), word(1))).otherwise(F.xxhash64(word(0), word(1), word(2)))
    return placed.select("window", "len", "k", "at", key.alias("key"))


def positions(docs: DataFrame, k: int, keep: list[str], width: int | None = None) -> DataFrame:
    """Every position of every document with the key of its k-word shingle, the document's words `w` and their number `n`; with a width only
    the words that a window of that width around the position may have, the first of which is the document's word `base`."""
    found = docs.select(*keep, words(F.col("text")).alias("w"))  # shorter texts make keys of fewer words, which no window of k has
    shifted = [F.col("w")] + [F.slice("w", i + 1, F.size("w")) for i in range(1, k)]
    zipped = F.arrays_zip(*(s.alias(f"s{i}") for i, s in enumerate(shifted)))
    placed = found.select(*keep, "w", F.posexplode(zipped).alias("pos", "s"))
    key = F.xxhash64(*(F.col("s")[f"s{i}"] for i in range(k))).alias("key")
    if width is None:
        return placed.select(*keep, "w", F.size("w").alias("n"), F.lit(0).alias("base"), "pos", key)
    base = F.greatest(F.col("pos") - (width - k), F.lit(0))
    return placed.select(*keep, F.slice("w", base + 1, 2 * width - k).alias("w"), F.size("w").alias("n"), base.alias("base"), "pos", key)


def matches(docs: DataFrame, wins: DataFrame) -> DataFrame:
    """(doc_id, digest, start, end, window): every occurrence of a window in a document, verified."""
    grams = materialize(window_shingles(wins), "grams")
    lengths = [r["k"] for r in grams.select("k").distinct().orderBy("k").collect()]  # at most 1, 2 and 3
    keyed = docs.select("doc_id", F.xxhash64("text").alias("digest"), "text")
    out = None
    for k in lengths:
        own = grams.where(F.col("k") == k)
        keys = own.select("key").distinct()
        counted = positions(keyed.select("text"), k, []).select("key").join(maybe_broadcast(keys, keys.count()), "key").groupBy("key").agg(F.count("*").alias("n"))
        rarest = own.join(counted, "key", "left").groupBy("window", "len").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "at")).alias("m"))
        prefix = materialize(rarest.where("m.n > 0").select("window", "len", "m.key", "m.at"), "prefix")
        n_prefix = prefix.count()
        # A broadcast prefix filters positions where they are made; else positions are dealt out, each with the few words around it.
        width = None if n_prefix <= shared.BROADCAST_ROWS else wins.agg(F.max("len")).first()[0]
        found = positions(keyed, k, ["doc_id", "digest"], width).join(maybe_broadcast(prefix, n_prefix), "key")
        start = F.col("pos") - F.col("at")
        found = found.where((start >= 0) & (start + F.col("len") <= F.col("n"))).where(F.array_join(F.slice("w", F.greatest(start - F.col("base"), F.lit(0)) + 1, F.col("len")), " ") == F.col("window"))
        found = found.select("doc_id", "digest", start.cast("long").alias("start"), (start + F.col("len")).cast("long").alias("end"), "window")
        out = found if out is None else out.union(found)
    if out is None:
        out = keyed.where("false").select("doc_id", "digest", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), F.lit("").alias("window"))
    return materialize(out, "matches")


def contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """For each document: n_words, n_hit, n_items, items_sha256, contaminated, and the merged hit spans in words."""
    wins = materialize(windows(items.select("item_id", "text"), width), "windows")
    found = matches(docs, wins)
    step = lambda a, x: F.struct(F.greatest(a["reach"], x["end"]).alias("reach"), (a["hit"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(x["start"], a["reach"]))).alias("hit"))
    zero = F.struct(F.lit(0).cast("long").alias("reach"), F.lit(0).cast("long").alias("hit"))
    hits = found.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("hit_windows"))
    hits = hits.select(F.col("doc_id").alias("h_id"), F.col("digest").alias("h_digest"), F.aggregate("hit_windows", zero, step)["hit"].alias("n_hit"), "hit_windows")
    listed = found.select("doc_id", "digest", "window").distinct().join(maybe_broadcast(wins.select("window", "item_id"), wins.count()), "window").where("item_id IS NOT NULL")
    listed = listed.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    listed = listed.select(F.col("doc_id").alias("i_id"), F.col("digest").alias("i_digest"), "items")
    sized = docs.select("doc_id", F.xxhash64("text").alias("digest"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    both = hits.join(listed, F.col("h_id").eqNullSafe(F.col("i_id")) & (F.col("h_digest") == F.col("i_digest")), "left")
    joined = sized.join(both, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("digest") == F.col("h_digest")), "left")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0).cast("long")) > 0).alias("contaminated"), "hit_windows", "items",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hit_windows", "items")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which a window of the benchmark occurs; the rest keep their columns."""
    wins = materialize(windows(table(spark, sf_dir, "benchmark").select("item_id", "text")), "windows")
    hit = matches(docs, wins).select(F.col("doc_id").alias("hit_id"), "digest").distinct()
    hit = materialize(hit, "hit")
    return docs.join(maybe_broadcast(hit, hit.count()), docs["doc_id"].eqNullSafe(hit["hit_id"]) & (F.xxhash64(docs["text"]) == hit["digest"]), "left_anti").select(*docs.columns)


_SQL_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLE = f"""
WITH b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, array_to_string(w[i + 1 : i + 10], ' ') AS win, least(len(w), 10) AS n
         FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM wins),
grams AS (SELECT doc_id, i, n, array_to_string(w[i + 1 : i + n], ' ') AS win
          FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, grams.n, item_id FROM grams JOIN wins USING (win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS sha
           FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id LEFT JOIN listed ON d.doc_id = listed.doc_id
"""
