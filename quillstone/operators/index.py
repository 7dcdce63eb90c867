"""The retrieval index as tables: built once from chunks, checked, published with checksums, loaded only if these hold.

chunks: (scope, doc_id, section, text, …). An index holds chunks, postings, terms, lengths and vectors; a query reads the postings of
its terms and the texts of its shortlist.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import models
from quillstone.operators import retrieval
from quillstone.operators.checks import all_of, duplicates, require_empty, row_violations, set_difference, term_statistics
from quillstone.sources import artifacts

TABLES = ["chunks", "postings", "terms", "lengths", "vectors"]
#: What an index must have been made with to be used by this code.
POLICY = {"tokens": "lower [a-z0-9]+", "scores": "okapi 1.5 0.75 0.25", "vectors": "unit, mean of windows"}


def document_violations(documents: DataFrame, sources: DataFrame, fields: list[str]) -> DataFrame:
    """Documents against the manifest they are said to come from: one to one, equal in all fields."""
    s = sources.select("document_id", *(F.col(f).alias(f"s_{f}") for f in fields))
    joined = documents.join(s, "document_id")
    differs = reduce(lambda a, b: a | b, (~F.col(f).eqNullSafe(F.col(f"s_{f}")) for f in fields), F.lit(False))
    return all_of(
        duplicates(sources, "source", ["document_id"]), duplicates(documents, "document", ["document_id"]), set_difference(documents, sources, "document", ["document_id"]),
        row_violations(joined, "metadata", F.col("document_id"), [(differs, "differs from its source")]),
    )


def group_violations(chunks: DataFrame) -> DataFrame:
    """Scopes without any token, which no statistics can be made of."""
    sizes = chunks.groupBy("scope").agg(F.sum(F.size(retrieval.lexical(F.col("text")))).alias("n"))
    return row_violations(sizes, "scope", F.col("scope"), [(F.col("n") < 1, "no tokens")])


def vector_violations(vectors: DataFrame, dims: int, tolerance: float = 1e-4) -> DataFrame:
    """Vectors of another length, with numbers that are not finite, or not of unit size."""
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return row_violations(vectors, "vector", F.concat_ws("|", "scope", F.col("doc_id").cast("string")), [(F.coalesce(F.size("embedding"), F.lit(-1)) != dims, "other length"), (~finite, "not finite"), (F.abs(size - 1) > tolerance, "not a unit vector")])


def scopes(chunks: DataFrame) -> DataFrame:
    """The scopes there are, in order."""
    return chunks.select("scope").distinct().orderBy("scope")


def catalogue(chunks: DataFrame) -> DataFrame:
    """(scope, doc_ids in order): what a reviewer may choose from. One row a scope; for review packets, not for whole corpora."""
    return chunks.groupBy("scope").agg(F.sort_array(F.collect_set("doc_id")).alias("doc_ids"))


def build(chunks: DataFrame, encoder: Callable[[str], list[float]] = models.hashed_embedding, window: int = 380) -> dict[str, DataFrame]:
    """The index of chunks (scope, doc_id, section, text, …)."""
    vectors = models.embed(chunks.select("scope", "doc_id", "text"), encoder=encoder, window=window).drop("text")
    return {"chunks": chunks, "postings": retrieval.postings(chunks), "terms": retrieval.term_stats(chunks), "lengths": retrieval.doc_stats(chunks), "vectors": vectors}


def violations(index: dict[str, DataFrame], dims: int) -> DataFrame:
    """Everything that keeps an index from being published."""
    ids = ["scope", "doc_id"]
    statistics = term_statistics(index["terms"], index["postings"]).select("check", "key", "reason")
    aligned = set_difference(index["lengths"], index["chunks"], "lengths", ids).union(set_difference(index["vectors"], index["chunks"], "vectors", ids))
    ranges = row_violations(index["lengths"], "length", F.concat_ws("|", "scope", F.col("doc_id").cast("string")), [(F.col("dl") < 0, "negative"), (~F.coalesce((F.col("avgdl") > 0) & (F.col("avgdl") < float("inf")), F.lit(False)), "mean length is not positive")])
    return all_of(group_violations(index["chunks"]), duplicates(index["chunks"], "chunk", ids), aligned, ranges, statistics, vector_violations(index["vectors"], dims))


def publish(index: dict[str, DataFrame], folder: str, version: str, config: dict, corpus_version: str) -> None:
    """Publishes an index without violations; nothing is replaced before all tables are written and their manifest stands."""
    first = index["vectors"].select(F.size("embedding").alias("n")).first()
    dims = first["n"] if first else 0
    require_empty(violations(index, dims))
    counts = {"documents": index["chunks"].select("scope").distinct().count(), "chunks": index["chunks"].count()}
    artifacts.publish(index, folder, version, {**config, **POLICY, "corpus_version": corpus_version, "dimension": dims, **counts})


def manifest_errors(manifest: dict, config: dict, corpus_version: str) -> list[str]:
    """Why a published index must not be used: made by other rules, with other settings, from another corpus, or empty."""
    have = manifest.get("config", {})
    out = [f"incompatible policy: {k}" for k, v in POLICY.items() if have.get(k) != v]
    out += [f"incompatible configuration: {k}" for k, v in config.items() if have.get(k) != v]
    if have.get("corpus_version") != corpus_version:
        out.append("index and corpus disagree")
    out += [f"invalid {k}" for k in ("dimension", "documents", "chunks") if not isinstance(have.get(k), int) or isinstance(have.get(k), bool) or have[k] < 1]
    return out


def load(spark: SparkSession, folder: str, config: dict, corpus_version: str, version: str | None = None) -> dict[str, DataFrame]:
    """The tables of a published index, after its manifest and then the checksums of its files have been compared."""
    found = artifacts.manifest(spark, folder, version)
    if why := manifest_errors(found, config, corpus_version):
        raise ValueError("; ".join(why))
    tables, error = artifacts.load_guarded(spark, folder, TABLES, found["version"])
    if error:
        raise ValueError(error)
    return tables


def search(index: dict[str, DataFrame], queries: DataFrame, only: DataFrame | None = None, encoder: Callable[[str], list[float]] = models.hashed_embedding, window: int = 380, prefix: str = "", **how: object) -> DataFrame:
    """`retrieval.retrieve` over an index, of questions (query_id, query): their expanded text is encoded, too."""
    expanded = queries.select("query_id", "query", retrieval.expand_query(F.col("query")).alias("expanded"))
    asked = models.embed(expanded, "expanded", encoder, window=window, prefix=prefix).select("query_id", "query", "embedding")
    return retrieval.retrieve(index["chunks"], index["vectors"], asked, scopes=only, index=index, **how)
