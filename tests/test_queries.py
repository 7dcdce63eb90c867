"""Every registered query that SQL can express, against DuckDB on the smallest tables; the entry points."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from quillstone import registry
from quillstone.operators.text import html_blocks_of, split_text, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    made.execute("SET TimeZone='UTC'")
    for path in Path(SF).glob("*.parquet"):
        made.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return made


def plain(frame):
    frame = frame[sorted(frame.columns)].astype(str).replace({"None": "NULL", "nan": "NULL", "NaT": "NULL", "<NA>": "NULL"})
    return sorted(map(tuple, frame.to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(spark, con, name):
    expected = con.execute(registry.ORACLE_SQL[name]).fetchdf()
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(expected.columns)
    number = lambda v: str(float(v)) if v.removeprefix("-").replace(".", "", 1).isdigit() else v
    assert [tuple(map(number, r)) for r in plain(got)] == [tuple(map(number, r)) for r in plain(expected)]


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.ORACLE_SQL.keys()))
def test_runs(spark, name):
    rows = registry.QUERIES[name](spark, SF).toPandas()
    if name == "hybrid_search":
        assert set(rows["query_id"]) == set(_asked(spark)) and rows["score"].between(0.25, 1).all() and rows.groupby("query_id")["position"].max().le(6).all()
    else:
        assert len(rows) == EXPECTED_ROWS[name](spark)


def _count(name, where="true"):
    return lambda spark: spark.read.parquet(f"{SF}/{name}.parquet").where(where).count()


#: How many rows a query without SQL has; what they hold is in the tests of its operator.
EXPECTED_ROWS = {
    "narrative_documents": _count("conversations"), "normalize_text": _count("documents"), "engine_ask": lambda spark: 9, "decimal38_ratios": lambda spark: registry.QUERIES["metric_ratios"](spark, SF).count(),
    "html_blocks": lambda spark: sum(len(html_blocks_of(r["html"])) for r in spark.read.parquet(f"{SF}/pages.parquet").select("html").collect()),
    "chunk_documents": lambda spark: _chunks(spark),
}


def _asked(spark):
    return [r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 100 = 0").select("doc_id").collect()]


def _chunks(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    return sum(len(list(split_text(t, 200, 40, words))) for t in texts if t)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert registry.ORACLE_SQL.keys() <= registry.QUERIES.keys() and entry.oracle_sql().keys() <= entry.queries().keys()
