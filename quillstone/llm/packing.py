"""Packing along a Hilbert curve: neighbouring documents fill sequences together.

Each document is tokenised once. Its token counts are hashed into ``BUCKETS`` dimensions, damped, normalised and projected to
``DIMS`` dimensions, whose cells are numbered along a Hilbert curve. Documents are cut into rows of at most LENGTH tokens, so that
no row is large and ranges of equal rows are of equal size; these are range-sorted by that number (and by id and place, so that copies
of one text and long documents spread over partitions) and laid end to end; the stream of each partition is cut at every LENGTH
tokens. The last tokens of a partition form sequences of power-of-two lengths, so nothing needs padding.

The token table is written once to the shared folder; the range sort then carries ids as 16-bit numbers where they fit. No
count or order is gathered on the driver but one sum, for the number of partitions.

Ids are those of the tokenizers library for the given file. Texts of Latin-1 characters without a special token's string go
through the same vocabulary as tiktoken ranks, several times faster with the same ids; all other texts through tokenizers.

A null text is empty: only the end id. Null and repeated ids: every row is packed as a document of its own.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quillstone.llm.shared import map_arrow, materialize, parsed, prepare, table

LENGTH, BUCKETS, DIMS, BITS = 2048, 256, 4, 12
PARTITION_TOKENS = 4_000_000
END_ID = 1

_encoders: dict[str, tuple] = {}


def _encoder(json_path: str | None) -> tuple:
    """(tokenizer, rank twin or None, strings of special tokens), loaded once a worker."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = json_path or public_tokenizers.path("byte_bpe_50k.json")
    if path not in _encoders:
        tokenizer, twin = Tokenizer.from_file(path), None
        ranks = os.path.splitext(path)[0] + ".tiktoken"
        if os.path.exists(ranks):
            import tiktoken

            with open(ranks, "rb") as f:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            twin = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        special = [x.content for x in tokenizer.get_added_tokens_decoder().values()]
        _encoders[path] = (tokenizer, twin, special)
    return _encoders[path]


def encode(text: str, json_path: str | None = None) -> np.ndarray:
    tokenizer, twin, special = _encoder(json_path)
    if twin is not None and not any(s in text for s in special):
        try:
            text.encode("latin-1")
            return twin.encode_to_numpy(text, disallowed_special=())
        except UnicodeEncodeError:
            pass
    return np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of rows of cell numbers below 2**bits (Skilling's transposition)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << bits - 1
    while q > 1:
        p = q - 1
        for i in range(n):
            high = x[i] & q != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, t)
            x[i] ^= np.where(high, 0, t) if i else 0
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << bits - 1
    while q > 1:
        t ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | x[i] >> b & 1
    return key


def _projection() -> np.ndarray:
    return np.random.default_rng(20).standard_normal((BUCKETS, DIMS))


def curve_keys(ids: list[np.ndarray]) -> np.ndarray:
    """Hilbert keys of documents given as token ids."""
    counts = np.zeros((len(ids), BUCKETS))
    for i, x in enumerate(ids):
        hashed = (x.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(24)
        counts[i] = np.bincount(hashed, minlength=BUCKETS)
    counts = np.sqrt(counts)
    counts /= np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-12)
    place = counts @ _projection()
    cells = np.clip((np.tanh(place) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1)
    return hilbert_key(cells.astype(np.int64))


def tokenised(docs: DataFrame, json_path: str | None = None, length: int = LENGTH) -> DataFrame:
    """(doc_id, hkey, crc, n, start, wide, ids): each document's ids with the end id in rows of at most `length`, little-endian,
    of 16 bits or, where wide, of 32; crc is of all its ids."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        ids = [np.append(encode(x or "", json_path), np.uint32(END_ID)).astype("<u4") for x in batch.column(1).to_pylist()]
        names = batch.column(0).to_pylist()
        out: dict[str, list] = {k: [] for k in ("doc_id", "hkey", "crc", "n", "start", "wide", "ids")}
        for name, x, key in zip(names, ids, curve_keys(ids).tolist(), strict=True):
            wide, crc = bool(x.max() > 65535), zlib.crc32(x)
            for start in range(0, len(x), length):
                part = x[start : start + length]
                for k, v in zip(out, (name, key, crc, len(x), start, wide, (part if wide else part.astype("<u2")).tobytes()), strict=True):
                    out[k].append(v)
        return out

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, hkey long, crc long, n long, start long, wide boolean, ids binary")


_PIECE = "doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(docs: DataFrame, length: int = LENGTH, json_path: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row for each piece of a document in a sequence; ``ids`` holds its ids as unsigned 32-bit little-endian numbers."""
    spark = docs.sparkSession
    prepare(spark)
    tokens = materialize(tokenised(docs, json_path, length), "tokens")
    total = tokens.agg(F.sum(F.when(F.col("start") == 0, F.col("n")))).first()[0] or 0
    schema = _PIECE.format(kind=docs.schema["doc_id"].dataType.simpleString())
    if not with_ids:
        schema = schema.removesuffix(", ids binary")
    arrow = to_arrow_schema(parsed(schema))
    top = 1 << length.bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36, 0
        out: dict[str, list] = {f.name: [] for f in arrow}
        open_rows: list[list] = []  # pieces of the sequence that is not full yet
        filled = 0

        def put(rows: list[list]) -> None:
            nonlocal number
            at = 0
            for doc, start, ids, n in joined(rows):
                row = {"doc_id": doc, "start": start, "length": len(ids), "ids_crc32": zlib.crc32(ids), "doc_tokens": n, "sequence_id": base + number, "offset": at, "ids": ids.tobytes() if with_ids else b""}
                at += len(ids)
                for k in out:
                    out[k].append(row[k])
            number += 1

        def joined(rows: list[list]) -> list[list]:
            """Pieces of a document that follow one another as one piece."""
            out: list[list] = []
            for doc, start, ids, n in rows:
                if out and out[-1][0] == doc and out[-1][3] == n and out[-1][1] + len(out[-1][2]) == start:
                    out[-1][2] = np.concatenate([out[-1][2], ids])
                else:
                    out.append([doc, start, ids, n])
            return out

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
            for x in out.values():
                x.clear()
            return made

        for rows in batches:
            for doc, n, first, wide, raw in zip(*(rows.column(k).to_pylist() for k in ("doc_id", "n", "start", "wide", "ids")), strict=True):
                ids = np.frombuffer(raw, "<u4" if wide else "<u2").astype("<u4")
                done = 0
                while done < len(ids):
                    take = min(length - filled, len(ids) - done)
                    open_rows.append([doc, first + done, ids[done : done + take], n])
                    done, filled = done + take, filled + take
                    if filled == length:
                        put(open_rows)
                        open_rows, filled = [], 0
                        if len(out["doc_id"]) >= 4096:
                            yield batch()
        size = top
        while filled:  # the rest in powers of two
            if filled < size:
                size >>= 1
                continue
            part, left = [], size
            while left:
                doc, start, ids, n = open_rows[0]
                take = min(left, len(ids))
                part.append([doc, start, ids[:take], n])
                open_rows[0] = [doc, start + take, ids[take:], n]
                left -= take
                if take == len(ids):
                    open_rows.pop(0)
            put(part)
            filled -= size
        if out["doc_id"]:
            yield batch()

    parts = max(1, -(-total // PARTITION_TOKENS))
    order = ("hkey", "doc_id", "crc", "start")
    return tokens.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "n", "start", "wide", "ids").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False)
