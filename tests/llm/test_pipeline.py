"""The pipeline and the registered queries: brute-force stages, invariants, DuckDB equivalents, and life without this subpackage."""

import os
import subprocess
import sys
from collections import defaultdict
from pathlib import Path

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillstone.llm import line_dedup, registry
from tests.llm.test_operators import clusters, item_words, word_set

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    texts = {i: t for i, t in rows.items() if t and any(c.isalpha() for c in t)}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    sites, first = defaultdict(set), {}
    for i in sorted(texts):
        for p, line in enumerate(texts[i].split("\n")):
            if line.strip(" "):
                sites[line.strip(" ")].add(source[i])
                first.setdefault(line.strip(" "), (i, p))
    cleaned = {}
    for i, t in texts.items():
        kept = "\n".join(x for p, x in enumerate(t.split("\n")) if not x.strip(" ") or len(sites[x.strip(" ")]) < line_dedup.MIN_SITES or first[x.strip(" ")] == (i, p))
        if kept == t or kept.strip(" "):
            cleaned[i] = kept
    component = clusters({i: word_set(t, 5) for i, t in cleaned.items()}, 80)
    single = {i: t for i, t in cleaned.items() if component[i] == i}
    wins = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = item_words(r["text"])
        wins |= {tuple(w[a : a + 10]) for a in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in wins}
    clean = {i: t for i, t in single.items() if not any(tuple(w[a : a + n]) in wins for w in [item_words(t)] for n in sizes for a in range(len(w) - n + 1))}
    expected = [set(texts), set(cleaned), set(single), set(clean)]
    for (name, stage), ids in zip(corpus_pipeline.STAGES[:-1], expected, strict=True):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        assert {r["doc_id"] for r in docs.collect()} == ids, name
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == clean
    assert {r["doc_id"]: r["n_chars"] for r in docs.collect()} == {i: len(t) for i, t in clean.items()}
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in packed} == set(clean) and len(rows) > len(clean) > 50


def test_stages_take_odd_rows(spark):
    """Null ids, texts, languages and sources, repeated rows and long texts go through all stages; extra columns stay until the last."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    kind = docs.schema.simpleString()[len("struct<") : -1].replace(":", " ")
    whole = " ".join(f"plain words number {i} of a long text" for i in range(5_000))
    odd = spark.createDataFrame([(None, "a text without any number stands here for once", None, None, None), (10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, whole, "en", "s", len(whole)), (10**6 + 3, "one row that is there twice, word for word", "en", "s", 9)], kind)
    docs = docs.union(odd).union(odd.where("doc_id = 1000003")).withColumn("label", F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
    kept = [r["doc_id"] for r in docs.collect()]
    assert None in kept and 10**6 + 2 in kept and kept.count(10**6 + 3) == 2 and not {10**6, 10**6 + 1} & set(kept)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert sum(r["start"] == 0 for r in packed) == len(kept)


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), SF).count() == 0, name


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    expected = con.execute(registry.ORACLE_SQL[name]).fetchdf()
    got = registry.QUERIES[name](spark, SF).toPandas()[list(expected.columns)]
    keys = ["word" if "word" in got.columns else "doc_id"]
    plain = lambda frame: (f := frame.sort_values(keys).reset_index(drop=True)).astype(object).where(f.notna(), None).to_numpy().tolist()
    assert plain(got) == plain(expected)


def test_one_query_for_each_operator():
    names = [n.split("_")[0] for n in registry.QUERIES if n.startswith("op")]
    assert sorted(names) == sorted(f"op{i}" for i in range(1, 14)) and "pipeline" in registry.QUERIES
    assert registry.QUERIES.keys() <= entry.queries().keys()


def test_the_rest_lives_without_this_subpackage(tmp_path):
    """Without the pipeline module, and without both folders: the other queries are there, and the other tests import and pass."""
    root = Path(__file__).resolve().parents[2]
    subprocess.run(["cp", "-r", str(root / "quillstone"), str(root / "tests"), str(root / "__spark_entry__.py"), str(tmp_path)], check=True)
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    code = "import __spark_entry__ as e; assert 'metric_ratios' in e.queries() and not any(n.startswith('op') for n in e.queries()), list(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=False).returncode == 0
    subprocess.run(["rm", "-rf", str(tmp_path / "quillstone/llm"), str(tmp_path / "tests/llm")], check=True)
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=False).returncode == 0
    assert "quillstone.llm" not in "".join(p.read_text() for p in (tmp_path / "quillstone").rglob("*.py"))
    ran = lambda *a: subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", *a], cwd=tmp_path, env=env, capture_output=True, text=True, check=False)
    found = ran("tests", "--collect-only")
    assert found.returncode == 0, found.stdout[-2000:]
    some = ran("tests", "-k", "test_numbers or test_prose or test_entry or test_settings or metric_ratios or chat_provider")
    assert some.returncode == 0, some.stdout[-2000:]
