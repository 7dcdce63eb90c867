"""Repeated passages by sparse suffix arrays.

Of all suffixes (starting at any word of any document) those at minimiser positions are retained: of every ``SPAN`` consecutive
runs of GRAM words the one of least hash, so that equal content selects equal positions. Any passage of MIN_WORDS words
holds such a position among its first SPAN, with at least PREFIX words of the passage after it. Retained suffixes are sorted
by their first LETTERS bytes, equal ones by a hash of their first PREFIX words, and compared with their neighbours: those whose common prefix
reaches PREFIX words survive. Around the survivors matches are extended to the left and right word by word: the runs of MIN_WORDS words that start up to SPAN - 1 words
before a survivor which is their minimiser are sorted and compared with their neighbours in turn. A word is repeated if it lies in a run of MIN_WORDS
words that occurs twice in the corpus, in one document or in two.

Sorting is by ranges of (letters, hash, document, place), so that a passage in a third of all documents is spread over tasks;
rows at the ends of ranges, two a task, are compared once more among themselves. Documents with equal word sequences are
represented by one of them. Runs are compared by 64-bit hashes.

Words stand between ASCII white space; A-Z are lower-cased. Defined results: null, empty and short texts have no repeats;
rows of one doc_id count as one document, so that repeated rows repeat nothing (texts that differ under one doc_id share its places and are reported as
one); where a passage starts twice, both places are repeats, and ties of minimisers go to the left; rows with null doc_id are left out;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.near_dup import words
from quillstone.llm.shared import BROADCAST_ROWS, map_arrow, materialize, maybe_broadcast, prepare, table

MIN_WORDS, GRAM, SPAN = 50, 10, 25
PREFIX = MIN_WORDS - SPAN + 1
SORT_ROWS = 400_000
LETTERS = 8

_M = 0x9E3779B97F4A7C15
_INVERSE = pow(_M, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Hashes of all runs of any number of words of one text."""

    def __init__(self, found: list[bytes]):
        self.n = len(found)
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, self.n)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(_M, self.n), dtype=np.uint64)])
        self.back = _powers(_INVERSE, self.n)

    def runs(self, width: int) -> np.ndarray:
        count = self.n - width + 1
        out = (self.sums[width:] - self.sums[:-width]) * self.back[:count]
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(30))


def minimiser_of(grams: np.ndarray) -> np.ndarray:
    """For each start of SPAN consecutive grams, the place of the least (the leftmost of equals)."""
    return np.lib.stride_tricks.sliding_window_view(grams, SPAN).argmin(1) + np.arange(len(grams) - SPAN + 1)


def beginnings(found: list[bytes], at: np.ndarray) -> np.ndarray:
    """The first LETTERS bytes of the suffixes at these words, as longs whose order is that of the letters."""
    data = np.frombuffer(b" ".join(found) + bytes(LETTERS), np.uint8)
    starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)])[at]
    out = data[starts[:, None] + np.arange(LETTERS)].view(">u8")[:, 0] if len(at) else np.zeros(0, np.uint64)
    return (out.astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def suffixes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, d1, d2, at, head, key): sizes, digests and the retained suffixes of every document."""

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_words", "d1", "d2", "at", "head", "key")}
        for text in batch.column(1).to_pylist():
            found = words(text)
            digest = xxhash.xxh3_128_digest(b" ".join(found))
            at = head = key = np.zeros(0, np.int64)
            if len(found) >= MIN_WORDS:
                rolling = Rolling(found)
                at = np.unique(minimiser_of(rolling.runs(GRAM)))
                at = at[at + PREFIX <= len(found)]
                key = rolling.runs(PREFIX)[at].view(np.int64)
                head = beginnings(found, at)
            for k, v in zip(out, (len(found), int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True), at, head, key), strict=True):
                out[k].append(v)
        return {"doc_id": batch.column(0)} | out

    return map_arrow(docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_words int, d1 long, d2 long, at array<int>, head array<long>, key array<long>")


def equal_neighbours(rows: DataFrame, tag: str, order: tuple[str, ...] = ("key",)) -> DataFrame:
    """The (doc_id, at) of rows (key, doc_id, at) whose key another place has, by a range sort and a look at the neighbours.

    Rows with equal keys must be equal in all columns of `order`. Repeated rows are one place."""
    prepare(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("key", "doc_id", "at", "edge")
        held, matched, first = None, False, True

        def batch(columns: list[np.ndarray], edge: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(np.full(len(columns[0]), edge))], names=names)

        for part in batches:
            if not part.num_rows:
                continue
            columns = [part.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            if first:
                yield batch([c[:1] for c in columns], True)
                first = False
            if held is not None:
                columns = [np.concatenate([h, c]) for h, c in zip(held, columns, strict=True)]
            new = np.ones(len(columns[0]), bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
            columns = [c[new] for c in columns]
            same = columns[0][1:] == columns[0][:-1]
            dup = np.zeros(len(columns[0]), bool)
            dup[0] = matched
            dup[:-1] |= same
            dup[1:] |= same
            held, matched = [c[-1:] for c in columns], bool(dup[-1])
            keep = np.nonzero(dup[:-1])[0]
            if len(keep):
                yield batch([c[keep] for c in columns], False)
        if held is not None:
            yield batch(held, True)
            if matched:
                yield batch(held, False)

    parts = max(1, -(-rows.count() // SORT_ROWS))
    dealt = rows.select("key", "doc_id", F.col("at").cast("long").alias("at"), *(c for c in order if c != "key"))
    dealt = dealt.repartitionByRange(parts, *order, "doc_id", "at").sortWithinPartitions(*order, "doc_id", "at").select("key", "doc_id", "at")
    found = materialize(dealt.mapInArrow(run, "key long, doc_id long, at long, edge boolean"), tag)
    edges = found.where("edge").select("key", "doc_id", "at").distinct()
    shared = edges.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    return found.where("NOT edge").select("doc_id", "at").union(edges.join(shared, "key").select("doc_id", "at"))


def _extended(rows: DataFrame) -> DataFrame:
    """(key, doc_id, at): runs of MIN_WORDS words around survivors, of rows (doc_id, text, places)."""

    def run(batch: pa.RecordBatch) -> dict:
        keys, ids, ats = [], [], []
        for doc, text, places in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            found = words(text)
            if len(found) < MIN_WORDS:
                continue
            rolling = Rolling(found)
            whole = rolling.runs(MIN_WORDS)
            own = minimiser_of(rolling.runs(GRAM))[: len(whole)]
            at = np.nonzero(np.isin(own, np.array(places)))[0]
            keys.append(whole[at].view(np.int64))
            ats.append(at)
            ids.append(np.full(len(at), doc, np.int64))
        empty = [np.zeros(0, np.int64)]
        return {"key": pa.array(np.concatenate(keys or empty), pa.int64()), "doc_id": pa.array(np.concatenate(ids or empty), pa.int64()), "at": pa.array(np.concatenate(ats or empty).astype(np.int32), pa.int32())}

    return map_arrow(rows.select("doc_id", "text", "places"), run, "key long, doc_id long, at int")


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, repeated_words, spans) of every document with a repeated passage; spans are [start, end) in words."""
    every = materialize(suffixes(docs), "suffixes")
    classes = every.where(F.col("n_words") >= MIN_WORDS).groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count_distinct("doc_id").alias("copies"))
    classes = materialize(classes.where("copies > 1"), "classes")
    member = every.where(F.col("n_words") >= MIN_WORDS).select("doc_id", "n_words", "d1", "d2").join(maybe_broadcast(classes, classes.count()), ["d1", "d2"])
    copied = materialize(member.select("doc_id", "n_words", "rep"), "copied")
    others = copied.where("doc_id <> rep").select("doc_id")
    others = maybe_broadcast(others, others.count())
    rows = every.join(others, "doc_id", "left_anti").select("doc_id", F.explode(F.arrays_zip("head", "key", "at")).alias("s")).select("s.head", "s.key", "doc_id", "s.at")
    kept = materialize(equal_neighbours(rows, "anchors", ("head", "key")).distinct(), "kept")
    places = materialize(kept.groupBy("doc_id").agg(F.collect_list("at").alias("places")), "places")
    n_kept, n_docs = kept.count(), places.count()
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    if n_kept > BROADCAST_ROWS:  # the places are dealt out with the texts, of documents that have any
        texts = texts.join(maybe_broadcast(places.select("doc_id"), n_docs), "doc_id", "left_semi")
    texts = texts.join(maybe_broadcast(places, n_kept), "doc_id")
    runs = materialize(_extended(texts), "runs")
    again = equal_neighbours(runs, "repeats")
    starts = again.groupBy("doc_id").agg(F.array_sort(F.collect_set("at")).alias("at"))

    def merge(batch: pa.RecordBatch) -> dict:
        spans = []
        for at in batch.column(2).to_pylist():
            at = np.array(at)
            cut = np.nonzero(np.diff(at) > MIN_WORDS)[0]
            begin, end = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])] + MIN_WORDS
            spans.append([{"start": int(a), "end": int(b)} for a, b in zip(begin, end, strict=True)])
        return {"doc_id": batch.column(0), "n_words": batch.column(1), "repeated_words": [sum(x["end"] - x["start"] for x in s) for s in spans], "spans": spans}

    schema = "doc_id long, n_words int, repeated_words long, spans array<struct<start:int,end:int>>"
    sizes = every.groupBy("doc_id").agg(F.max("n_words").alias("n_words"))
    partly = map_arrow(starts.join(sizes, "doc_id").select("doc_id", "n_words", "at").join(copied.select("doc_id"), "doc_id", "left_anti"), merge, schema)
    wholly = copied.groupBy("doc_id").agg(F.max("n_words").alias("n_words")).select("doc_id", "n_words", F.col("n_words").cast("long").alias("repeated_words"), F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").alias("end"))).alias("spans"))
    return partly.union(wholly)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with repeated passages; spans as text: start-end, in words, joined by commas."""
    text = F.array_join(F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return repeats(table(spark, sf_dir, "documents")).withColumn("spans", text)


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 50], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS c FROM g) WHERE c > 1),
k AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM f)),
s AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM k GROUP BY doc_id, k.k)
SELECT s.doc_id, CAST(max(len(w)) AS INTEGER) AS n_words, CAST(sum(b - a) AS BIGINT) AS repeated_words, string_agg(a || '-' || b, ',' ORDER BY a) AS spans FROM s JOIN d ON s.doc_id = d.doc_id GROUP BY s.doc_id
"""
