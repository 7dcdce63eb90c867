"""SimHash near-duplicate detection with bit-sliced comparison of fingerprints.

A document's fingerprint has a bit set where over half of its word shingles' hashes (XXH64, repeats included) have it. Documents
with equal fingerprints are one class, found by a grouped minimum, so copies cost nothing further. Classes meet in buckets:

1. Two fingerprints within the radius agree in one of radius + 1 runs of bits. A bucket is a mask of such bits and their values.
2. A bucket of more than ``LEAF`` fingerprints is split again: its free bits are cut into radius + 1 runs, and each fingerprint goes to
   the bucket of each. A pair within the radius still agrees in one of them. As fingerprints of a bucket differ in its free bits alone,
   a bucket with f free bits holds at most 2**f of them, so splitting ends without a cap, and a hot bucket costs a bounded number of
   copies of its rows instead of the square of their number.
3. Buckets are compared in blocks of whole buckets, at most LEAF fingerprints each. A block is stored as vertical bit planes: bit i of 64
   fingerprints is one word. A fingerprint meets 64 others in one operation: three planes of differences at a time are added by a
   carry-save adder to bitwise counters that start so that a carry out of the top says "over the radius". Words in which
   all 64 lanes are over are abandoned. Planes in which the block agrees are left out, balanced planes come first.
4. A block hands on a spanning forest of its links, never all pairs. Components come from contraction in tasks and star contraction.

Defined results: null or empty text has the fingerprint zero and is linked like any other; rows of one doc_id are one document, which
links whatever fingerprints they have; a row with a null doc_id has its fingerprint and no component; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.near_dup import words
from quillstone.llm.shared import components, forest, map_arrow, materialize, maybe_broadcast, prepare, table, whole_runs

WIDTH, RADIUS, SEED = 3, 2, 42
#: Fingerprints of a block, those that are compared with it at once, planes before the first look for abandoned words.
LEAF, PROBES, DENSE = 4096, 512, 12
_ALL = np.uint64(2**64 - 1)


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The majority bits of the hashes of a text's shingles; of the whole sequence where it is shorter; 0 without words."""
    found = words(text)
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    n = max(1, len(found) - width + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1])
    hashes = (xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[len(ends) - n :].tolist(), strict=True))
    counts = np.zeros(64, np.int64)
    for lo in range(0, n, 65536):
        size = min(65536, n - lo)
        part = np.fromiter(islice(hashes, size), ">u8", size)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, fp) of every row, fp as the signed long of its 64 bits."""

    def run(batch: pa.RecordBatch) -> dict:
        found = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64)
        return {"doc_id": batch.column(0), "fp": found.view(np.int64)}

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, fp long")


def planes_of(prints: np.ndarray) -> np.ndarray:
    """The vertical bit planes of uint64 fingerprints: row i holds bit i (from the highest), 64 fingerprints a word."""
    bits = np.unpackbits(np.ascontiguousarray(prints, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    lanes = np.zeros((64, -(-len(prints) // 64) * 64), np.uint8)
    lanes[:, : len(prints)] = bits.T
    return np.packbits(lanes, axis=1, bitorder="little").view("<u8")


def within(prints: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) with i < j of the fingerprints (uint64) that differ in at most radius >= 1 bits, some probes at a time."""
    n = len(prints)
    planes = planes_of(prints)
    spare = np.zeros(planes.shape[1], np.uint64)
    if n % 64:
        spare[-1] = ~((np.uint64(1) << np.uint64(n % 64)) - np.uint64(1))
    ones = np.bitwise_count(planes).sum(1).astype(np.int64)
    order = np.argsort(np.abs(2 * ones - n), kind="stable")
    order = order[(ones[order] > 0) & (ones[order] < n)]
    for lo in range(0, n, PROBES):
        yield _probed(prints[lo : lo + PROBES], planes, spare, order, lo, radius)


def _probed(probes: np.ndarray, planes: np.ndarray, spare: np.ndarray, order: np.ndarray, lo: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    first = lo // 64
    shape = (len(probes), planes.shape[1] - first)
    levels = radius.bit_length()
    start = 2**levels - 1 - radius
    counters = [np.full(shape, _ALL if start >> i & 1 else 0, np.uint64) for i in range(levels)]
    over = np.broadcast_to(spare[first:], shape).copy()
    marks = np.where(probes[None, :] >> (63 - order[:, None]).astype(np.uint64) & np.uint64(1), _ALL, np.uint64(0))
    at = None
    for k in range(0, len(order), 3):
        if k >= DENSE:
            alive = np.nonzero(over != _ALL)
            at = alive if at is None else tuple(x[alive[0]] for x in at)
            counters, over = [c[alive] for c in counters], over[alive]
            if not len(over):
                break
        if at is None:
            off = [planes[order[p], None, first:] ^ marks[p][:, None] for p in range(k, min(k + 3, len(order)))]
        else:
            off = [planes[order[p]][first + at[1]] ^ marks[p][at[0]] for p in range(k, min(k + 3, len(order)))]
        a, b, c = (off + [np.uint64(0)] * 2)[:3]
        unit, pair = a ^ b ^ c, a & b | c & (a ^ b)  # the carry-save adder: three differences as a unit and a pair
        carry = counters[0] & unit
        counters[0] ^= unit
        if levels == 1:
            over |= carry | pair
            continue
        old = counters[1]
        counters[1] = old ^ pair ^ carry
        carry = old & pair | carry & (old ^ pair)
        for i in range(2, levels):
            carry, counters[i] = counters[i] & carry, counters[i] ^ carry
        over |= carry
    if at is None:
        at = np.nonzero(over != _ALL)
        over = over[at]
    lanes = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    word, lane = np.nonzero(lanes)
    i, j = lo + at[0][word], 64 * (first + at[1][word]) + lane
    return i[i < j], j[i < j]


def _runs(free: int, parts: int) -> list[int]:
    """The bits of `free` in `parts` masks of neighbouring bits."""
    bits = [b for b in range(64) if free >> b & 1]
    return [sum(1 << int(b) for b in run) for run in np.array_split(bits, parts) if len(run)]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _compared(rows: DataFrame, radius: int) -> DataFrame:
    """(a, b): spanning forests of the links within blocks of whole buckets of rows (mask, value, rep, fp)."""
    prepare(rows.sparkSession)
    most = LEAF

    def linked(reps: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        held: tuple = (np.zeros(0, np.int64),) * 2
        for i, j in within(prints, radius):
            if len(i):
                held = forest(np.concatenate([held[0], reps[i]]), np.concatenate([held[1], reps[j]]))
        return held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, starts in whole_runs(batches, ["mask", "value"], 16 * most):
            reps, prints = part.column("rep").to_numpy(), part.column("fp").to_numpy().view(np.uint64)
            ends = np.append(starts[1:], len(reps))
            lo = 0
            while lo < len(reps):
                last = np.searchsorted(ends, lo + most, "right") - 1
                hi = int(ends[last]) if last >= 0 and ends[last] > lo else int(ends[np.searchsorted(ends, lo, "right")])
                a, b = linked(reps[lo:hi], prints[lo:hi])
                lo = hi
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=("a", "b"))

    dealt = rows.select("mask", "value", "rep", "fp").repartition("mask", "value").sortWithinPartitions("mask", "value", "fp")
    return dealt.mapInArrow(run, "a long, b long")


def links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) that connect what is within the radius, of classes (rep, fp) with distinct fingerprints."""
    spark = classes.sparkSession
    rows, level, found = classes.select("rep", "fp", F.lit(0).cast("long").alias("mask")), [0], None
    while True:
        steps = sorted({(_signed(m), _signed(m | run)) for m in level for run in _runs(~m & (2**64 - 1), radius + 1)})
        level = sorted({m % 2**64 for _, m in steps})
        rows = rows.join(F.broadcast(spark.createDataFrame(steps, "mask long, next long")), "mask").select("rep", "fp", F.col("next").alias("mask"))
        rows = rows.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = materialize(rows.groupBy("mask", "value").agg(F.count("*").alias("c")).where("c > 1"), "sizes")
        leaves, hot = sizes.where(F.col("c") <= LEAF).drop("c"), sizes.where(F.col("c") > LEAF).drop("c")
        part = _compared(rows.join(maybe_broadcast(leaves, leaves.count()), ["mask", "value"]), radius)
        found = part if found is None else found.union(part)
        n_hot = hot.count()
        if not n_hot:
            return found
        rows = materialize(rows.join(maybe_broadcast(hot, n_hot), ["mask", "value"]).select("rep", "fp", "mask"), "hot")


def near_duplicates(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs (doc_id, text): the least doc_id that links of at most `radius` bits reach."""
    prints = materialize(fingerprints(docs, width), "prints")
    known = prints.where("doc_id IS NOT NULL")
    classes = materialize(known.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    n = classes.count()
    of = maybe_broadcast(classes, n)
    several = materialize(known.groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high").select("doc_id"), "several")
    own = known.join(maybe_broadcast(several, several.count()), "doc_id").join(of, "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    joined = materialize(components(links(classes, radius).union(own), "alike"), "joined")
    placed = classes.join(maybe_broadcast(joined, joined.count()), F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component"))
    placed = maybe_broadcast(materialize(placed, "placed"), n)
    return prints.join(placed, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at two bits over three-word shingles, as its contract has it."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
