"""What the training-data operators share: tables, Arrow mapping, durable intermediate results, grouping and components.

Nothing here keeps state on one machine: intermediate tables go to the shared folder named by ``spark.checkpoint.dir``,
so a lost executor costs a recomputation of its tasks and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from quillstone.functions.shipping import ship
from quillstone.session import settled as materialize
from quillstone.session import shared_dir, sweep, table

__all__ = ["as_batch", "ascii_lower", "components", "forest", "map_arrow", "map_groups", "materialize", "maybe_broadcast", "parsed", "prepare", "shared_dir", "sorted_groups", "sweep", "table", "whole_runs"]

#: Rows of small keys that a broadcast may hold; beyond it the same join is a shuffled one.
BROADCAST_ROWS = 400_000
#: Rows of which a worker holds Python objects at once.
SLICE_ROWS = 1024
#: Bytes of rows that go to a worker at once, unless the session says otherwise; whole texts may be long.
BATCH_BYTES = "8m"


def maybe_broadcast(df: DataFrame, rows: int, most: int | None = None) -> DataFrame:
    """A broadcast hint behind a count of the rows; without it Spark shuffles and splits skewed partitions."""
    return F.broadcast(df) if rows <= (BROADCAST_ROWS if most is None else most) else df


def prepare(spark: SparkSession) -> None:
    """Makes the package importable in workers and bounds the batches that they get."""
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """Maps record batches by fn, which returns a list or Arrow array for each column of schema."""
    prepare(df.sparkSession)
    arrow = to_arrow_schema(parsed(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE_ROWS):
                yield as_batch(fn(batch.slice(lo, SLICE_ROWS)), arrow)

    return df.mapInArrow(run, schema)


def parsed(schema: str) -> StructType:
    return _parse_datatype_string(schema)


def as_batch(columns: dict, arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x := columns[f.name], pa.Array) and x.type == f.type else pa.array(x, f.type) for f in arrow], schema=arrow)


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of rows with equal keys, from batches in which they stand together; a group may span batches."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        cols = [rows.column(k).to_pylist() for k in keys]
        start = 0
        for i, key in enumerate(zip(*cols, strict=True)):
            if last is not None and key != last:
                if i > start:
                    held.append(rows.slice(start, i - start))
                yield pa.concat_tables(held)
                held, start = [], i
            last = key
        if rows.num_rows > start:
            held.append(rows.slice(start))
    if held:
        yield pa.concat_tables(held)


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], dict], schema: str, order: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """fn over the rows of each key, held one group at a time. Groups must be bounded by how the keys are made."""
    prepare(df.sparkSession)
    arrow = to_arrow_schema(parsed(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for group in sorted_groups(batches, keys):
            held.append(as_batch(fn(group), arrow))
            n += held[-1].num_rows
            if n >= 4096:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    dealt = df.repartition(partitions, *keys) if partitions else df.repartition(*keys)
    return dealt.sortWithinPartitions(*keys, *(order or [])).mapInArrow(run, schema)


def whole_runs(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of rows with equal keys, from batches in which they stand together, of about `rows` rows; with the places where groups start.

    A task holds that many rows and one group more. Keys hold no nulls."""

    def of(held: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        found = pa.Table.from_batches(held).combine_chunks()
        new = np.zeros(found.num_rows, bool)
        new[0] = True
        for k in keys:
            column = found.column(k)
            new[1:] |= pc.not_equal(column.slice(1), column.slice(0, found.num_rows - 1)).to_numpy()
        return found, np.flatnonzero(new)

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= rows:
            found, starts = of(held)
            cut = int(starts[-1])
            if cut:
                yield found.slice(0, cut), starts[:-1]
            held, n = found.slice(cut).to_batches(), found.num_rows - cut
    if n:
        yield of(held)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone, as lower() also maps other letters."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


#: Edges of which a task holds arrays at once, and neighbours beyond which a node's edges are not gathered by a join.
EDGE_ROWS, HUB_EDGES = 1_000_000, 100_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node that the edges reach from it) of each node of the edges."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, label = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return nodes, nodes[label]
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (label != (jumped := label[label])).any():
            label = jumped


def _contracted(edges: DataFrame) -> DataFrame:
    """(u, v) stars with the connections of the edges within each task, roots with themselves; a task holds EDGE_ROWS edges at a time."""
    prepare(edges.sparkSession)

    def star(held: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        return forest(*(np.concatenate(x) for x in zip(*held, strict=True)))

    def batches_of(u: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(u), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(u[lo : lo + 65536]), pa.array(v[lo : lo + 65536])], names=("u", "v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)))
            n += batch.num_rows
            if n >= EDGE_ROWS:
                held = [star(held)]
                n = len(held[0][0])
                if 2 * n >= EDGE_ROWS:
                    yield from batches_of(*held[0])
                    held, n = [], 0
        if n:
            yield from batches_of(*star(held))

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def components(edges: DataFrame, tag: str = "components", rounds: int = 60) -> DataFrame:
    """Connected components of (a, b) edges of longs: (node, component), component being the least node reachable.

    Tasks first contract the edges they hold to stars, EDGE_ROWS at a time, without a shuffle. Where that took several tasks,
    large-star and small-star alternate with it until the edges are stars: every node with its neighbours is linked to the least
    of them, by a grouped minimum that is combined before the shuffle and a join; the edges of nodes with more than HUB_EDGES
    neighbours stay where they are, as the minima of these few nodes are broadcast. Each round is written to the shared folder;
    the driver gets a few numbers a round. Nodes without an edge are not returned; edges may repeat.
    """
    edges = materialize(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), tag)
    for _ in range(rounds):
        parts = max(1, -(-edges.count() // EDGE_ROWS))
        edges = materialize(_contracted(edges.coalesce(parts)), tag)
        if parts == 1:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        edges = edges.where("u <> v")
        if not _unsettled(edges):
            break
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("c"))
        large = _joined(both, least, tag).where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
        small = _joined(large, least, tag)
        edges = materialize(small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v"), F.col("m"))).distinct(), tag)
    else:
        raise RuntimeError("components did not settle")
    found = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    return materialize(found, tag)


def _joined(edges: DataFrame, least: DataFrame, tag: str) -> DataFrame:
    """Edges (u, v) with the least `m` of their node u, out of least (u, m, c); hubs by a broadcast, all others by a join."""
    hubs = materialize(least.where(F.col("c") > HUB_EDGES).select("u", "m"), tag)
    n = hubs.count()
    if not 0 < n <= BROADCAST_ROWS:
        return edges.join(least.select("u", "m"), "u")
    rest = edges.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(least.where(F.col("c") <= HUB_EDGES).select("u", "m"), "u")
    return rest.unionByName(edges.join(F.broadcast(hubs), "u"))


def _unsettled(edges: DataFrame) -> int:
    """Nodes that are linked to two others, or linked and linked to."""
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("of")).union(edges.select(F.col("v"), F.lit(None)))
    odd = ends.groupBy("node").agg(F.min("of").alias("low"), F.max("of").alias("high"), F.count_if(F.col("of").isNull()).alias("linked"))
    return odd.where("low IS NOT NULL AND (low <> high OR linked > 0)").count()
