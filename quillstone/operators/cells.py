"""A vector index: vectors in cells around centroids, and cells left out by a bound on the angle, so that the best k stay exact.

Centroids are unit vectors, fitted by spherical k-means on at most ``SAMPLE`` vectors and ``SAMPLE_BYTES`` bytes; every vector is then put into the
cell of its nearest centroid. A vector v of a cell with centroid c is a * c plus a rest of length w at a right angle to it. For a
query q with share s = q * c, the product is at most a * s + sqrt(|q|^2 - s^2) * w: the triangle inequality on the sphere. Cells are cut into
rings of w, and each run of one cell and ring in a block keeps the least and greatest a and the greatest w.

A search visits the cells nearest to a query first (`probes` of them); the k-th score of a scope is its threshold. Then cells whose bound
reaches the threshold are visited; no other vector can change the answer. With `stop` a search ends after the first step: then it is
approximate, and `recall` measures how much it finds. Blocks of queries are ordered by nearest cell, as are blocks of vectors, so that a
task compares what belongs together. Vectors of another length than the centroids, or that are not finite, are in a cell of their own that is always visited.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions.shipping import ship
from quillstone.operators import retrieval as ops
from quillstone.session import settled

SAMPLE, SAMPLE_BYTES, ROUNDS, MOST_CELLS, RINGS, PROBES = 20_000, 64_000_000, 8, 1024, 8, 2
#: Vectors of a block, and what rounding may hide of a bound.
BLOCK, MARGIN = 4096, 1e-5
_CELL = "struct<cell: int, start: int, end: int, low: double, high: double, rest: double>"


@dataclass
class Centroids:
    """Unit centroids as rows, of vectors of one length."""

    matrix: np.ndarray

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, share along its centroid, length of the rest) of each row; cell -1 for rows that are not finite or of another length."""
        n = len(x)
        cell, share, rest = np.full(n, -1, np.int32), np.zeros(n), np.zeros(n)
        if n and x.shape[1] == self.matrix.shape[1] and len(self.matrix):
            good = np.isfinite(x).all(1)
            dots = x[good] @ self.matrix.T
            cell[good] = dots.argmax(1)
            share[good] = dots.max(1)
            rest[good] = np.sqrt(np.maximum(0, np.square(x[good]).sum(1) - share[good] ** 2))
        return cell, share, rest


def fit(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE, seed: int = 7) -> Centroids:
    """Centroids of vectors (doc_id, embedding): by default as many as the root of their number, MOST_CELLS at most."""
    usual = vectors.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if usual is None:
        return Centroids(np.zeros((0, 0)))
    size, most = usual["size"], max(1, min(sample, SAMPLE_BYTES // (8 * usual["size"])))
    some = vectors.where(F.size("embedding") == size).select("embedding").orderBy(F.xxhash64("embedding")).limit(most).toArrow()
    x = ops.matrix_of(some, "embedding")
    x = x[np.isfinite(x).all(1) & (np.square(x).sum(1) > 0)] if len(x) else x.reshape(0, size)
    x = x / np.sqrt(np.square(x).sum(1, keepdims=True))
    cells = min(len(x), cells or min(MOST_CELLS, max(1, int(usual["count"] ** 0.5))))
    centroids = x[np.random.default_rng(seed).permutation(len(x))[:cells]]
    for _ in range(ROUNDS if cells else 0):
        own = (x @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        length = np.sqrt(np.square(sums).sum(1, keepdims=True))
        centroids = np.where(length > 0, sums / np.where(length > 0, length, 1), centroids)
    return Centroids(centroids)


def build(vectors: DataFrame, centroids: Centroids) -> DataFrame:
    """(scope, cells, block): blocks of at most BLOCK vectors (scope, doc_id, embedding) of one scope, in order of cells."""
    spark = vectors.sparkSession
    ship(spark)
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("scope", "doc_id", "embedding")}
    size, rings = BLOCK, RINGS

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            cell, share, rest = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for _, rows, x in ops.matrices(table, "embedding"):
                cell[rows], share[rows], rest[rows] = centroids.place(x)
            length = np.hypot(share, rest)
            ring = np.minimum((rest / np.where(length > 0, length, 1) * rings).astype(np.int32), rings - 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kinds), *map(pa.array, (cell, ring, share, rest))], names=[*kinds, "cell", "ring", "share", "rest"])

    placed = vectors.select(*kinds).mapInArrow(place, ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", cell int, ring int, share double, rest double")
    order = ["scope", "cell", "ring", "doc_id"]
    dealt = settled(placed, "placed").repartitionByRange(max(2, spark.sparkContext.defaultParallelism), *order).sortWithinPartitions(*order)
    runs = ops.packed(dealt, size, "scope")

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for scope, block in zip(batch.column("scope"), batch.column("block"), strict=True):
                rows = pa.ipc.open_stream(block.as_buffer()).read_all()
                cell, ring, share, rest = (rows.column(c).to_numpy() for c in ("cell", "ring", "share", "rest"))
                cuts = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (ring[1:] != ring[:-1])]))
                cells = [{"cell": int(cell[a]), "start": int(a), "end": int(b), "low": float(share[a:b].min()), "high": float(share[a:b].max()), "rest": float(rest[a:b].max())} for a, b in zip(cuts, np.append(cuts[1:], len(cell)), strict=True)]
                out = pa.BufferOutputStream()
                kept = rows.select(["scope", "doc_id", "embedding"])
                with pa.ipc.new_stream(out, kept.schema) as stream:
                    stream.write_table(kept)
                kind = pa.list_(pa.struct([(n, pa.int32() if n in ("cell", "start", "end") else pa.float64()) for n in cells[0]]))
                yield pa.RecordBatch.from_arrays([pa.array([scope.as_py()], batch.schema.field("scope").type), pa.array([cells], kind), pa.array([out.getvalue().to_pybytes()])], names=["scope", "cells", "block"])

    return settled(runs.mapInArrow(head, f"scope {kinds['scope']}, cells array<{_CELL}>, block binary"), "cells")


def _asked(queries: DataFrame, centroids: Centroids, thresholds: DataFrame | None) -> DataFrame:
    """Blocks of queries (query_id, embedding, thetas) in order of their nearest cell."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.full(batch.num_rows, -1, np.int32)
            for _, rows, x in ops.matrices(pa.Table.from_batches([batch]), "embedding"):
                cell[rows] = centroids.place(x)[0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    kind = ", ".join(f"{c} {queries.schema[c].dataType.simpleString()}" for c in ("query_id", "embedding")) + ", cell int"
    near_by = queries.select("query_id", "embedding").mapInArrow(near, kind)
    if thresholds is None:
        near_by = near_by.withColumn("thetas", F.array().cast("array<struct<scope: string, theta: double>>"))
    else:
        of = thresholds.groupBy("query_id").agg(F.collect_list(F.struct(F.col("scope").cast("string").alias("scope"), "theta")).alias("thetas"))
        near_by = near_by.join(of, "query_id", "left")
    blocks = max(1, -(-queries.count() // ops.QUERY_BLOCK))
    return ops.packed(near_by.repartitionByRange(blocks, "cell", "query_id").sortWithinPartitions("cell", "query_id"), ops.QUERY_BLOCK).withColumnRenamed("block", "asked")


def bounds(x: np.ndarray, centroids: Centroids, cells: list[dict]) -> np.ndarray:
    """The greatest product that a vector in each of the cells may have with each query; infinite in the cell of vectors that are not placed."""
    of = np.array([c["cell"] for c in cells])
    low, high, rest = (np.array([c[k] for c in cells]) for k in ("low", "high", "rest"))
    if not len(centroids.matrix) or x.shape[1] != centroids.matrix.shape[1]:
        return np.full((len(x), len(cells)), np.inf)
    share = x @ centroids.matrix[of].T
    apart = np.sqrt(np.maximum(0, np.square(x).sum(1)[:, None] - np.square(share)))
    most = np.maximum(low * share, high * share) + apart * rest
    most[:, of < 0] = np.inf
    return np.where(np.isnan(most), np.inf, most)


def _visited(index: DataFrame, queries: DataFrame, centroids: Centroids, k: int, probes: int | None, thresholds: DataFrame | None, counter: Accumulator | None) -> DataFrame:
    """The best k of each query and scope among the cells that are visited: the `probes` nearest, or those that reach a threshold."""
    spark = index.sparkSession
    ship(spark)
    asked = _asked(queries, centroids, thresholds)
    pairs = index.select("scope", "cells", "block").crossJoin(F.broadcast(asked) if queries.count() <= ops.BROADCAST_QUERIES else asked)
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, scope {index.schema['scope'].dataType.simpleString()}, doc_id long, score double"

    def wanted(of: pa.Table, scope: object, cells: list[dict]) -> np.ndarray:
        """Which cell each query of the block visits."""
        out = np.zeros((of.num_rows, len(cells)), bool)
        numbers = np.array([c["cell"] for c in cells])
        for _, rows, x in ops.matrices(of, "embedding"):
            if probes is not None and len(centroids.matrix) and x.shape[1] == centroids.matrix.shape[1]:
                dots = x @ centroids.matrix.T
                least = np.partition(dots, -min(probes, dots.shape[1]), 1)[:, -min(probes, dots.shape[1])]
                out[rows] = (dots[:, numbers] >= least[:, None]) | (numbers < 0)
            elif probes is not None:
                out[rows] = numbers < 0
            else:
                theta = np.array([next((t["theta"] for t in ts or () if t["scope"] == scope), -np.inf) for ts in of.column("thetas").take(pa.array(rows)).to_pylist()])
                out[rows] = bounds(x, centroids, cells) >= theta[:, None] - MARGIN
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("scope").cast(pa.string()).to_pylist()
            for scope, cells, block, asks in zip(texts, batch.column("cells").to_pylist(), batch.column("block"), batch.column("asked"), strict=True):
                of = pa.ipc.open_stream(asks.as_buffer()).read_all()
                visits = wanted(of, scope, cells)
                who, which = np.flatnonzero(visits.any(1)), np.flatnonzero(visits.any(0))
                if not len(who):
                    continue
                rows = pa.ipc.open_stream(block.as_buffer()).read_all()
                if len(which) < len(cells):
                    rows = rows.take(pa.array(np.concatenate([np.arange(cells[c]["start"], cells[c]["end"]) for c in which])))
                if counter is not None:
                    counter.add(len(who) * rows.num_rows)
                found = list(ops.best_of_blocks(rows.sort_by("doc_id"), of.take(pa.array(who)), k))
                if found:
                    best = ops.best_rows(found, k)
                    yield from best.set_column(2, "doc_id", best.column("doc_id").cast(pa.int64())).combine_chunks().to_batches()

    return pairs.mapInArrow(run, schema)


def search(index: DataFrame, queries: DataFrame, centroids: Centroids, k: int = ops.TOP_K, probes: int = PROBES, stop: bool = False, counter: Accumulator | None = None) -> DataFrame:
    """(query_id, scope, doc_id, score, rank 1..k) of queries (query_id, embedding) over an index of whole-numbered documents.

    With `stop`, of the nearest cells alone; else exact. counter is told how many products were made."""
    first = ops.top_k(_visited(index, queries, centroids, k, probes, None, counter), k)
    if stop:
        return first
    thresholds = settled(first.where(F.col("rank") == k).select("query_id", "scope", F.col("score").alias("theta")), "thresholds")
    return ops.top_k(_visited(index, queries, centroids, k, None, thresholds, counter), k)


def recall(found: DataFrame, true: DataFrame) -> DataFrame:
    """(query_id, scope, recall): the share of the true rows (query_id, scope, doc_id) that are found."""
    keys = ["query_id", "scope"]
    hits = true.select(*keys, "doc_id").join(found.select(*keys, "doc_id", F.lit(1).alias("hit")), [*keys, "doc_id"], "left")
    return hits.groupBy(*keys).agg((F.count("hit") / F.count("*")).alias("recall"))
