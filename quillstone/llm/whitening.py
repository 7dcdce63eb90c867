"""Embedding whitening through a tiled covariance.

Entries become whole numbers, x = floor(SCALE * c) + OFFSET. The fit list holds each distinct vector of x once: copies meet in an
aggregation on the vector, combined before the shuffle. Its covariance is summed in tiles:

1. Dimensions are cut into blocks of ``TILE``, and pairs of blocks (i <= j) are tile keys. Rows are taken ``ROW_BLOCK`` at a time; each
   row-block is cut into its column blocks, and a column block goes to every tile that needs it, as the smallest whole numbers
   that hold its distance from a whole number near the mean.
2. Tiles meet their pair of column blocks by (tile, slice, row-block). A task subtracts the mean, multiplies the pair and adds the
   product to the tile's sum; it holds two column blocks and one tile, whatever the number of rows or dimensions is. A tile is dealt
   to several slices of row-blocks, so that many rows of few dimensions still fill a cluster.
3. Partial sums of a tile are added. The driver assembles the matrix, whose size depends on the dimensions alone, and takes the
   eigenvectors.

Every row is then projected on the leading components in its task. The covariance of the whitened fit list goes the same tiled way and
gives the identity error.

Defined results: rows whose vector is null, empty, or holds a null or a number that is not finite are left out, so are rows whose length is not
the most frequent one (the longest of several such); whole numbers are held to +-2**52; repeated rows and null ids stay; components
without variance (under DIMS * 2**-52 of the largest) give no rows, as nothing can be projected on them; a deviation that no long holds is null.
Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.shared import map_arrow, map_groups, materialize, prepare, table

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
TILE, ROW_BLOCK = 32, 2048
_MOST = 2.0**52


@dataclass
class Whitening:
    """What a fit gives: rows and sums of the fit list, eigenvalues (falling) and eigenvectors (columns), the trace, the identity error."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the usable rows of vectors (vec_id, embedding)."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    good = vectors.select("vec_id", "embedding").where((F.size("embedding") > 0) & finite)
    usual = good.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    x = F.transform("embedding", lambda c: F.floor(F.greatest(F.lit(-_MOST), F.least(F.lit(_MOST), c.cast("double") * SCALE))) + OFFSET)
    return good.where(F.size("embedding") == (usual["size"] if usual else 0)).select("vec_id", x.alias("x"))


def matrix(batch: pa.RecordBatch | pa.Table, column: str) -> np.ndarray:
    """The vectors of a column, which all have one length, as rows."""
    flat = batch.column(column)
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def moments(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and exact sums of each dimension of fit (x); each task hands on sums of the high and low 32 bits."""
    prepare(fit.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, 0, 0
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch, "x")
                n, high, low = n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([high], pa.list_(pa.int64())), pa.array([low], pa.list_(pa.int64()))], names=("n", "high", "low"))

    parts = fit.select("x").mapInArrow(run, "n long, high array<long>, low array<long>")
    dims = parts.select("n", F.posexplode(F.arrays_zip("high", "low")).alias("dim", "s"))
    found = dims.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("s.high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("s.low").cast("decimal(38,0)")).alias("low")).orderBy("dim").collect()
    return (found[0]["n"] if found else 0), [int(r["high"]) * 2**32 + int(r["low"]) for r in found]


def narrowed(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest type that holds them; others as they are."""
    if x.dtype.kind != "i" or not x.size:
        return x
    low, high = x.min(), x.max()
    return x.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def tiled_covariance(rows: DataFrame, block: Callable[[pa.RecordBatch], np.ndarray], mean: np.ndarray, n: int, tile: int | None = None, row_block: int | None = None) -> np.ndarray:
    """The covariance, divisor n, of the matrices that block makes of record batches, around their mean; a tile of dimension pairs at a time."""
    spark, d = rows.sparkSession, len(mean)
    tile, row_block = tile or TILE, row_block or ROW_BLOCK
    prepare(spark)
    cuts = [(lo, min(lo + tile, d)) for lo in range(0, d, tile)]
    tiles = [(i, j) for i in range(len(cuts)) for j in range(i, len(cuts))]
    setting = spark.conf.get("spark.sql.shuffle.partitions", "200")
    parts = int(setting) if setting.isdigit() else 200
    slices = max(1, min(-(-n // row_block), 2 * parts // len(tiles)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo in range(0, batch.num_rows, row_block):
                z = block(batch.slice(lo, row_block))
                parts = [narrowed(z[:, a:b]) for a, b in cuts]
                for i, j in tiles:
                    sides = [0] if i == j else [0, 1]
                    held = [parts[(i, j)[s]] for s in sides]
                    columns = [[i] * len(sides), [j] * len(sides), [hash(number) % slices] * len(sides), [number] * len(sides), sides, [h.dtype.str for h in held], [h.tobytes() for h in held]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.binary()), strict=True)], names=("i", "j", "slice", "number", "side", "kind", "data"))
                number += 1

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total, left = None, np.zeros(0), np.zeros(0)
        done = lambda: pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=("i", "j", "data"))
        for batch in batches:
            for i, j, side, kind, data in zip(*(batch.column(c).to_pylist() for c in ("i", "j", "side", "kind", "data")), strict=True):
                if (i, j) != at:
                    if at is not None:
                        yield done()
                    at, total = (i, j), np.zeros((cuts[i][1] - cuts[i][0], cuts[j][1] - cuts[j][0]))
                lo, hi = cuts[j if side else i]
                centred = np.frombuffer(data, kind).reshape(-1, hi - lo).astype(np.float64) - mean[lo:hi]
                if i == j:
                    total += centred.T @ centred
                elif side == 0:
                    left = centred
                else:
                    total += left.T @ centred
        if at is not None:
            yield done()

    def add(group: pa.Table) -> dict:
        return {"i": [group.column("i")[0].as_py()], "j": [group.column("j")[0].as_py()], "data": [sum(np.frombuffer(x, np.float64) for x in group.column("data").to_pylist()).tobytes()]}

    dealt = rows.mapInArrow(deal, "i int, j int, slice int, number long, side int, kind string, data binary").repartition("i", "j", "slice").sortWithinPartitions("i", "j", "slice", "number", "side")
    out = np.zeros((d, d))
    for r in map_groups(dealt.mapInArrow(multiply, "i int, j int, data binary"), ["i", "j"], add, "i int, j int, data binary").collect():
        (a, b), (c, e) = cuts[r["i"]], cuts[r["j"]]
        part = np.frombuffer(r["data"], np.float64).reshape(b - a, e - c) / n
        out[a:b, c:e], out[c:e, a:b] = part, part.T
    return out


def off_mean(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly: as longs where they fit, else as Python's whole numbers."""
    most = n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + max(map(abs, sums), default=0)
    kind = np.int64 if most < 2**62 else object
    return n * x.astype(kind) - np.array(sums, kind)


def project(x: np.ndarray, model: Whitening, k: int) -> np.ndarray:
    return (off_mean(x, model.n, model.sums) / model.n).astype(np.float64) @ (model.vectors[:, :k] / np.sqrt(model.values[:k]))


def fit(rows: DataFrame, k: int = COMPONENTS, tile: int | None = None, row_block: int | None = None) -> Whitening | None:
    """The whitening of the distinct vectors of rows (x), None without any."""
    distinct = materialize(rows.select("x").distinct(), "distinct")
    n, sums = moments(distinct)
    if not n:
        return None
    base = [(2 * s + n) // (2 * n) for s in sums]
    mean = np.array([(s - n * b) / n for s, b in zip(sums, base, strict=True)])
    near = np.array(base, np.int64)
    v = tiled_covariance(distinct, lambda batch: matrix(batch, "x") - near, mean, n, tile, row_block)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    good = int((values > len(values) * 2.0**-52 * values[0]).sum()) if values[0] > 0 else 0
    model = Whitening(n, sums, values[:good], np.ascontiguousarray(vectors[:, :good]), float(np.trace(v)))
    if k := min(k, good):
        of = lambda batch: project(matrix(batch, "x"), model, k)
        white = tiled_covariance(distinct, of, _mean(distinct, of, n, k), n, tile, row_block)
        model.identity_error = float(np.abs(white - np.eye(k)).max())
    return model


def _mean(rows: DataFrame, block: Callable[[pa.RecordBatch], np.ndarray], n: int, k: int) -> np.ndarray:
    """The mean of the matrices that block makes, from one row of sums a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k)
        for batch in batches:
            if batch.num_rows:
                total = total + block(batch).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=("s",))

    dims = rows.mapInArrow(run, "s array<double>").select(F.posexplode("s").alias("dim", "s")).groupBy("dim").agg(F.sum("s").alias("s"))
    return np.array([r["s"] for r in dims.orderBy("dim").collect()]) / n


def whitened(rows: DataFrame, model: Whitening, k: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of rows (vec_id, x) and the first k components."""
    k = min(k, len(model.values))
    most = 2**63 - 1

    def run(batch: pa.RecordBatch) -> dict:
        x = matrix(batch, "x")
        off = off_mean(x, model.n, model.sums)
        if off.dtype != object and (np.square(off.astype(np.float64)).sum(1) > 2.0**62).any():
            off = off.astype(object)
        deviation = [int(s) if s <= most else None for s in np.square(off).sum(1)]
        rows = np.repeat(np.arange(len(x)), k)
        return {
            "vec_id": batch.column("vec_id").take(pa.array(rows)), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), "n": np.full(len(rows), model.n),
            "deviation": pa.array(deviation, pa.int64()).take(pa.array(rows)), "whitened": project(x, model, k).ravel(), "explained": np.tile(model.values[:k] / model.trace, len(x)),
            "identity_error": np.full(len(rows), model.identity_error),
        }

    kind = rows.schema["vec_id"].dataType.simpleString()
    return map_arrow(rows, run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sixteen whitened components of every usable vector."""
    rows = whole_numbers(table(spark, sf_dir, "embeddings"))
    model = fit(rows)
    if model is None or not len(model.values):
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return whitened(rows, model)
