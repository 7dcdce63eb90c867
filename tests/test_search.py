"""Searches whose queries grow with the tables, against brute force."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quillstone.operators import blocks, retrieval
from quillstone.plans import retrieval as plans


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """450 vectors (with copies, a broken and a short one) and documents: queries are 0, 100, 200, 300 and 400."""
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(450, 8)).round(3)
    vectors[7] = vectors[200]
    rows = [(i, f"l{i % 3}", [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows[11] = (11, "l2", [float("nan")] * 8)
    rows[12] = (12, "l0", [1.0] * 4)
    words = ["risk", "cloud", "supply", "chain", "business", "and", "of", "bank", "river", "stone"]
    docs = [(i, " ".join(rng.choice(words, size=int(rng.integers(1, 9)))), ("en", "de")[i % 2], "s", 1) for i in range(450)]
    out = str(tmp_path_factory.mktemp("search"))
    spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>").repartition(3).write.parquet(f"{out}/embeddings.parquet")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    return out, rows, docs


def best(rows, k=20):
    """rows (query, scope, doc, score) to (query, scope, doc, rank) of the best k."""
    groups = defaultdict(list)
    for q, scope, doc, score in rows:
        groups[q, scope].append((-score, doc))
    return {(q, scope, doc, n) for (q, scope), g in groups.items() for n, (_, doc) in enumerate(sorted(g)[:k], 1)}


def nearest(rows):
    vec = {i: np.float32(v).astype(float) for i, _, v in rows}
    scored = [(q, label, d, round(float(vec[q] @ vec[d]), 6)) for q in range(0, 450, 100) for d, label, _ in rows if len(vec[d]) == 8 and np.isfinite(vec[d]).all()]
    return best(scored)


def test_dense_search_asks_every_hundredth_vector(spark, tables, monkeypatch):
    out, rows, _ = tables
    expected = nearest(rows)
    assert {q for q, *_ in expected} == {0, 100, 200, 300, 400}
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 64)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    for most, held in ((50_000, 4_000_000), (0, 50)):
        monkeypatch.setattr(retrieval, "BROADCAST_QUERIES", most)
        monkeypatch.setattr(retrieval, "HELD_ROWS", held)
        assert {(r["query_id"], r["scope"], r["doc_id"], r["rank"]) for r in plans.dense_search(spark, out).collect()} == expected


def test_interleave_select(spark, tables):
    out, rows, _ = tables
    turns = defaultdict(list)
    for q, scope, doc, rank in nearest(rows):
        turns[q].append((rank, scope, doc))
    expected = {(q, n, scope, doc) for q, t in turns.items() for n, (_, scope, doc) in enumerate(sorted(t)[:6], 1)}
    assert {(r["query_id"], r["position"], r["scope"], r["doc_id"]) for r in plans.interleave_select(spark, out).collect()} == expected


def test_bm25_search_asks_every_hundredth_document(spark, tables):
    out, _, docs = tables
    words = {i: re.findall("[a-z0-9]+", text) for i, text, *_ in docs}
    scored = []
    for lang in ("en", "de"):
        own = [d[0] for d in docs if d[2] == lang]
        df = Counter(w for i in own for w in set(words[i]))
        raw = {w: round(math.log(len(own) - n + 0.5) - math.log(n + 0.5), 9) for w, n in df.items()}
        mean = sum(raw.values()) / len(raw)
        idf = {w: 0.25 * mean if x < 0 else x for w, x in raw.items()}
        avg = sum(len(words[i]) for i in own) / len(own)
        for q in range(0, 450, 100):
            asked = Counter(words[q])
            for i in own:
                tf = Counter(words[i])
                if asked.keys() & tf.keys():
                    scored.append((q, lang, i, round(sum(round(idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(words[i]) / avg)) * n, 9) for w, n in asked.items() if tf[w]), 5)))
    positive = {(q, s, d) for q, s, d, x in scored if x > 0}
    expected = {r for r in best(scored) if r[:3] in positive}
    assert {(r["query_id"], r["scope"], r["doc_id"], r["rank"]) for r in plans.bm25_search(spark, out).collect()} == expected


def test_hybrid_search_asks_every_hundredth_document(spark, tables):
    assert {r["query_id"] for r in plans.hybrid_search(spark, tables[0]).select("query_id").distinct().collect()} == {0, 100, 200, 300, 400}


def test_retrieve_reranks_windows_of_the_shortlist(spark):
    """The score is the best window's overlap with the expanded query, not the cosine: the words lie in the second window of a far vector."""
    far = " ".join(["filler"] * 380 + ["copper", "mine", "output"])
    chunks = spark.createDataFrame([("s", 1, "Item 9", far), ("s", 2, "Item 9", "nothing of the kind")], "scope string, doc_id long, section string, text string")
    vectors = spark.createDataFrame([("s", 1, [0.0, 1.0]), ("s", 2, [1.0, 0.0])], "scope string, doc_id long, embedding array<float>")
    queries = spark.createDataFrame([(1, "copper mine output", [1.0, 0.0])], "query_id long, query string, embedding array<float>")
    got = [(r["doc_id"], r["score"]) for r in retrieval.retrieve(chunks, vectors, queries).collect()]
    assert got == [(1, round(1 / (1 + math.exp(-4)), 9))]
    from pyspark.sql import functions as F

    other = retrieval.retrieve(chunks, vectors, queries, reranker=lambda q, text: F.when(text.contains("kind"), 2.0).otherwise(-3.0)).collect()
    assert [(r["doc_id"], r["score"]) for r in other] == [(2, round(1 / (1 + math.exp(-2)), 9))]


def test_token_windows_tokenise_a_text_once(spark, tables):
    """The plan splits texts in one place; it did so in a filter and for each window besides."""
    found = plans.token_windows(spark, tables[0])
    assert found._jdf.queryExecution().executedPlan().toString().count("split(") == 1


def test_many_questions_are_scored_in_blocks_with_the_same_results(spark, tables, monkeypatch):
    rows = lambda: {tuple(r) for r in plans.hybrid_search(spark, tables[0]).collect()}
    few, used, whole = rows(), [], blocks.top_k
    monkeypatch.setattr(retrieval, "FEW_QUERIES", 2)
    monkeypatch.setattr(blocks, "top_k", lambda *a, **b: used.append(1) or whole(*a, **b))
    assert few and rows() == few and used == [1]


def test_texts_are_not_dealt_out_to_find_their_vectors(spark, tables):
    chunks, vectors = plans._embedded(spark, tables[0])
    monkey = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert "hashpartitioning" not in chunks._jdf.queryExecution().executedPlan().toString() and chunks.count() == vectors.count() == 450
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", monkey)


def test_overlap_of_words_is_the_reranker_of_texts(spark):
    """The question's words are taken once for a text: the same scores as from every window's text, and no window is a row."""
    long = " ".join(f"w{i % 37}" for i in range(200))
    rows = [(1, "W1 w2, w3 w3 x", "a", 1, "w1 w9 w2 w3"), (1, "W1 w2, w3 w3 x", "a", 2, long), (1, "W1 w2, w3 w3 x", "b", 3, None), (2, "", "a", 1, "w1"), (2, "", "a", 4, " — "), (3, None, "a", 1, "w1"), (3, None, "a", 3, None)]
    short = spark.createDataFrame(rows, "query_id int, query string, scope string, doc_id long, text string")
    both = [retrieval.reranked(short, how, 5) for how in (retrieval.overlap_logit, lambda q, t: retrieval.overlap_logit(q, t))]
    got, plain = ({(r["query_id"], r["scope"], r["doc_id"]): r["score"] for r in b.collect()} for b in both)
    assert got == plain and len(got) == 7 and got[1, "a", 2] > got[1, "b", 3]
    assert "Generate" not in both[0]._jdf.queryExecution().optimizedPlan().toString()


def test_best_of_a_block_by_floors():
    """Ties go to the first rows; what stays under a floor is left out, and what reaches it stays."""
    scores = np.array([[0.5, 0.1], [0.7, -np.inf], [0.5, 0.2], [0.5, 0.3]])
    pick = lambda floor: sorted(zip(*(x.tolist() for x in retrieval._leading(scores, 2, floor)), strict=True))
    assert pick(None) == [(0, 0), (1, 0), (2, 1), (3, 1)] and pick(np.array([0.6, 0.3])) == [(1, 0), (3, 1)]
    best = pa.table({"query_id": [7, 7, 9], "scope": ["a", "a", "a"], "doc_id": [1, 2, 1], "score": [0.7, 0.5, 0.1]})
    assert retrieval.floors_of(best, pa.table({"query_id": [9, 7]}), 2)["a"].tolist() == [-np.inf, 0.5]
