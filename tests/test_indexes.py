"""Indexes that leave work out or grow: the answers stay those of the plain formulas, and the work that is left is counted."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.operators import cells, pruned, segments
from quillstone.operators import retrieval as ops

CHUNKS = "scope string, doc_id long, text string"


def zipf_corpus(n=3000, seed=1):
    """Texts of frequent and rare words, with ties, empty texts and a small scope in which every word is frequent."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(4000)]
    weights = [1 / (i + 1) for i in range(4000)]
    rows = [("a", i, " ".join(rng.choices(vocab, weights, k=rng.randint(5, 60)))) for i in range(n)]
    rows += [("b", 10_000 + i, "w0 w1 w2" if i % 2 else "w0 w1") for i in range(30)]
    rows += [("a", 20_000, ""), ("a", 20_001, None), ("c", 20_002, "w7")]
    return rows


def plain(chunks, queries, k=20, digits=5):
    return {tuple(r) for r in ops.top_k(ops.bm25(chunks, queries).withColumn("score", F.round("score", digits)), k, positive=True).select("query_id", "scope", "doc_id", "score", "rank").collect()}


@pytest.mark.parametrize("share", [0.0, 0.5, 1.0])
def test_pruned_search_against_the_plain_formula(spark, share):
    rows = zipf_corpus(600)
    chunks = spark.createDataFrame(rows, CHUNKS)
    texts = [r[2] for r in rows[:10]] + ["w0 w0 w1", "w3000 w2 w2", "unknown", "", "w7 w7 w7", "w1 w3999"]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")
    index = pruned.impacts(pruned.counted(chunks))
    found = pruned.search(index, queries, share=share, digits=5)
    assert {tuple(r) for r in found.select("query_id", "scope", "doc_id", "score", "rank").collect()} == plain(chunks, queries)


def test_pruned_search_of_scopes(spark):
    chunks = spark.createDataFrame(zipf_corpus(300), CHUNKS)
    queries = spark.createDataFrame([(1, "w0 w5 w9"), (2, "w1 w2")], "query_id long, query string")
    scopes = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "query_id long, scope string")
    found = {tuple(r) for r in pruned.search(pruned.impacts(pruned.counted(chunks)), queries, scopes=scopes, digits=5).select("query_id", "scope", "doc_id", "score", "rank").collect()}
    assert found == {r for r in plain(chunks, queries) if (r[0], r[1]) in {(1, "a"), (2, "b")}} and found


def test_pruned_search_reads_few_postings(spark):
    """Questions of two rare words and three that most texts have: under a fifth of their postings are read, and few documents scored in full."""
    chunks = spark.createDataFrame(zipf_corpus(6000), CHUNKS).where("scope = 'a'")
    rng = random.Random(3)
    queries = spark.createDataFrame([(i, f"w0 w1 w2 w{rng.randint(300, 900)} w{rng.randint(300, 900)}") for i in range(40)], "query_id long, query string")
    index = pruned.impacts(pruned.counted(chunks))
    asked = ops.query_terms(queries)
    plan = pruned.planned(index, asked, share=1.0)
    read, every = plan.where("read").agg(F.sum("n")).first()[0], plan.agg(F.sum("n")).first()[0]
    seeded = 40 * (pruned.SEEDS + 1)
    assert read < every / 5 and read + seeded < every / 2
    met = pruned.candidates(index, plan).count()
    assert met < ops.bm25(chunks, queries).count() / 5
    found = {tuple(r) for r in pruned.search(index, queries, digits=5).select("query_id", "scope", "doc_id", "score", "rank").collect()}
    assert found == plain(chunks, queries)


def test_pruned_search_of_nothing(spark):
    chunks, queries = spark.createDataFrame([], CHUNKS), spark.createDataFrame([(1, "a")], "query_id long, query string")
    assert pruned.search(pruned.impacts(pruned.counted(chunks)), queries).count() == 0
    some = spark.createDataFrame([("a", 1, "word")], CHUNKS)
    assert pruned.search(pruned.impacts(pruned.counted(some)), queries.where("false")).count() == 0


def clustered(n=3000, centres=30, seed=2):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, 24))
    x = middle[rng.integers(0, centres, n)] + 0.15 * rng.normal(size=(n, 24))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_cells_leave_out_most_vectors_and_stay_exact(spark, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK", 128)
    monkeypatch.setattr(ops, "QUERY_BLOCK", 8)
    x = clustered()
    vectors = spark.createDataFrame([(f"s{i % 2}", i, v.tolist()) for i, v in enumerate(x)], "scope string, doc_id long, embedding array<float>")
    queries = vectors.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "embedding")
    centroids = cells.fit(vectors, cells=40)
    index = cells.build(vectors, centroids)
    true = {tuple(r) for r in ops.dense_top_k(vectors, queries).select("query_id", "scope", "doc_id", "score", "rank").collect()}
    made = spark.sparkContext.accumulator(0)
    found = cells.search(index, queries, centroids, counter=made)
    assert {tuple(r) for r in found.select("query_id", "scope", "doc_id", "score", "rank").collect()} == true
    assert 0 < made.value < 0.5 * queries.count() * vectors.count()
    fast = cells.search(index, queries, centroids, stop=True)
    share = cells.recall(fast, ops.dense_top_k(vectors, queries)).agg(F.avg("recall"), F.count("*")).first()
    assert share[0] >= 0.9 and share[1] == 2 * queries.count()


def test_cells_take_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK", 64)
    x = clustered(400, seed=5)
    rows = [("s", i, v.tolist()) for i, v in enumerate(x)] + [("s", 1000, [float("nan")] * 24), ("s", 1001, [1.0] * 3), ("s", 1002, [0.0] * 24), ("s", 1003, [50.0] * 24), (None, 1004, x[3].tolist()), ("s", 1005, None), ("s", 1006, x[3].tolist())]
    vectors = spark.createDataFrame(rows, "scope string, doc_id long, embedding array<float>")
    queries = spark.createDataFrame([(1, x[0].tolist()), (2, [1.0, 2.0, 3.0]), (3, [0.0] * 24), (4, (7 * x[9]).tolist())], "query_id long, embedding array<float>")
    centroids = cells.fit(vectors)
    found = cells.search(cells.build(vectors, centroids), queries, centroids)
    keys = ["query_id", "scope", "doc_id", "score", "rank"]
    assert {tuple(r) for r in found.select(*keys).collect()} == {tuple(r) for r in ops.dense_top_k(vectors, queries).select(*keys).collect()}


def test_cells_of_nothing(spark):
    vectors = spark.createDataFrame([], "scope string, doc_id long, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<float>")
    centroids = cells.fit(vectors)
    assert len(centroids.matrix) == 0 and cells.search(cells.build(vectors, centroids), queries, centroids).count() == 0


def rows_of(index):
    found = segments.live(index)
    return {name: sorted(tuple(r) for r in t.select(*cols).collect()) for name, t, cols in (("postings", found["postings"], ["scope", "doc_id", "term", "tf"]), ("terms", found["terms"], ["scope", "term", "df", "idf"]), ("lengths", found["lengths"], ["scope", "doc_id", "dl", "avgdl"]))}


def test_segments_equal_a_full_rebuild(spark, tmp_path):
    """Three segments, a replaced document, removals in one and in all segments, and a document that comes back; then compaction and a folder."""
    rows = zipf_corpus(200)
    chunks = lambda part: spark.createDataFrame(part, CHUNKS)
    parts = [[r for i, r in enumerate(rows) if i % 3 == k] for k in range(3)]
    index = segments.joined(*(segments.segment(chunks(p), f"s{k}") for k, p in enumerate(parts)))
    newer = [(r[0], r[1], f"{r[2]} revised w0") for r in parts[0][:20]]
    index = segments.replace(index, segments.segment(chunks(newer), "s3"))
    gone = [r[:2] for r in parts[1][:15]] + [("b", 10_003), ("b", 99_999), newer[0][:2]]
    index = segments.remove(index, spark.createDataFrame(gone, "scope string, doc_id long"))
    index = segments.joined(index, segments.segment(chunks([parts[1][0]]), "s4"))
    kept = {r[:2]: r for p in (rows, newer) for r in p}
    kept = [r for key, r in kept.items() if key not in set(gone)] + [parts[1][0]]
    expected = rows_of(segments.segment(chunks(kept), "all"))
    assert rows_of(index) == expected
    assert set(segments.crowded(index, share=0.15)) == {"s0", "s1"} and segments.crowded(index, share=0.9, fan=5) == []
    smaller = segments.compact(index, segments.crowded(index, share=0.15), "s5")
    assert rows_of(smaller) == expected
    assert smaller.removed.where("segment IN ('s0', 's1', 's5')").count() == 0 and {r[0] for r in smaller.postings.select("segment").distinct().collect()} == {"s2", "s3", "s4", "s5"}
    segments.append(smaller, str(tmp_path / "index"))
    assert rows_of(segments.load(spark, str(tmp_path / "index"), ["s2", "s3", "s4", "s5"], smaller)) == expected


def test_adding_a_segment_counts_only_its_own_text(spark):
    """The counts of earlier segments are read, not their postings, where nothing is removed from them."""
    base = segments.segment(spark.createDataFrame(zipf_corpus(100), CHUNKS), "s0")
    broken = segments.Segments(base.postings.where("raise_error('postings of an old segment are read') IS NULL"), base.lengths, base.terms, base.scopes, base.removed)
    df, n = segments.statistics(broken)
    assert n.count() == 3 and df.where("scope = 'c'").count() == 1


def test_words_of_a_segment_are_counted_where_they_are_read(spark, monkeypatch):
    """Only counts of terms are shuffled, never a row for each term of a document; a document without words has a length and no posting."""
    plans, keep = {}, segments.settled
    monkeypatch.setattr(segments, "settled", lambda df, tag: (plans.update({tag: df._jdf.queryExecution().executedPlan().toString()}), keep(df, tag))[1])
    made = segments.segment(spark.createDataFrame([("a", 1, "b a B c"), ("a", 2, "..."), ("a", 3, None), ("a", 4, "b")], "scope string, doc_id long, text string"), "s")
    assert [tag for tag, plan in plans.items() if "hashpartitioning" in plan] == ["terms"] and not any("doc_id" in line for line in plans["terms"].splitlines() if "hashpartitioning" in line)
    assert {tuple(r) for r in made.postings.collect()} == {("s", "a", 1, "a", 1), ("s", "a", 1, "b", 2), ("s", "a", 1, "c", 1), ("s", "a", 4, "b", 1)}
    assert {tuple(r) for r in made.lengths.collect()} == {("s", "a", 1, 4), ("s", "a", 2, 0), ("s", "a", 3, 0), ("s", "a", 4, 1)}
