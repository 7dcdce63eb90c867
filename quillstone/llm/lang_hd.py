"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1 in ``DIM`` dimensions, made from its code point. A letter n-gram is bound by
multiplying its letters' vectors, each rotated by its place; a text bundles (sums) its n-gram vectors, and a language is the
bundle of its training texts, each of unit length. A text gets the language whose prototype has the greatest cosine.

Training uses at most ``TRAIN_ROWS`` different labelled texts of each language, whole: in each of TRAIN_PARTS parts by hashed doc_id those
of least hash, so that a language with most of the documents is not ranked in one task; their bundles are
summed by Spark, dimension by dimension, so that the driver gets only one vector a language, of at most TRAIN_LANGS languages (an error beyond).
Prediction reads whole texts.

The pipeline's stage rejects a document where no learned language is recognised: its text has no letter, or it has at least LEAST_GRAMS
different n-grams and its cosine to the nearest prototype is under SIGMAS standard deviations of the cosine of unrelated texts, which is
one over the root of DIM. Texts of fewer n-grams give too little to reject them for. Where nothing could be learned, a letter suffices.

A null text or one without a letter is ``und`` with score 0; where nothing could be learned, so is every text. Of prototypes at the same
cosine the first by name wins. Each row gives one row, whatever its id or its repetitions; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.llm.shared import map_arrow, materialize, maybe_broadcast, table

DIM, GRAM, TRAIN_ROWS, TRAIN_PARTS, TRAIN_LANGS, SPACE = 1024, 3, 1536, 64, 1000, 32
BLOCK = 2048
LEAST_GRAMS, SIGMAS = 50, 3.0


@functools.cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([0xD800 <= c < 0xE000 or chr(c).isalpha() for c in range(0x110000)])


@functools.cache
def _letter_vector(code: int) -> np.ndarray:
    return np.random.default_rng([7, int(code)]).choice(np.array([-1, 1], np.int8), DIM)


_gram_rows: dict[int, int] = {}
_gram_vectors = np.zeros((0, DIM), np.int8)
_GRAM_MOST = 30_000


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """Bound vectors of n-grams given as packed code points; kept for the worker, up to a bound."""
    global _gram_vectors
    new = [g for g in grams.tolist() if g not in _gram_rows]
    if len(_gram_rows) + len(new) > _GRAM_MOST:
        _gram_rows.clear()
        new, _gram_vectors = grams.tolist(), np.zeros((0, DIM), np.int8)
    if new:
        made = np.ones((len(new), DIM), np.int8)
        codes = np.array(new, np.int64)
        for place in range(GRAM):
            part = codes >> 21 * place & 0x1FFFFF
            for c in np.unique(part):
                made[part == c] *= np.roll(_letter_vector(int(c)), place)
        _gram_rows.update(zip(new, range(len(_gram_vectors), len(_gram_vectors) + len(new)), strict=True))
        _gram_vectors = np.concatenate([_gram_vectors, made])
    return _gram_vectors[[_gram_rows[g] for g in grams.tolist()]].astype(np.float32)


def _codes(text: str) -> np.ndarray | None:
    """Lower-case letters with one space for whatever stands between them; None without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes = np.where(letter, codes, SPACE)[keep]
    return np.concatenate([[SPACE], codes, [SPACE]]).astype(np.int64)


def bundles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Unit bundles of texts, and which of them have a letter."""
    return _bundles(texts)[:2]


def _bundles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    has, distinct = np.zeros(len(texts), bool), np.zeros(len(texts), np.int64)
    found, counts, rows = [], [], []
    for i, text in enumerate(texts):
        codes = _codes(text) if text else None
        if codes is None:
            continue
        has[i] = True
        grams = codes[:-2] | codes[1:-1] << 21 | codes[2:] << 42 if len(codes) > 2 else codes[:1]
        g, c = np.unique(grams, return_counts=True)
        distinct[i] = len(g)
        found.append(g)
        counts.append(c)
        rows.append(np.full(len(g), i))
    out = np.zeros((len(texts), DIM), np.float32)
    if found:
        grams, at = np.unique(np.concatenate(found), return_inverse=True)
        counts, rows = np.concatenate(counts).astype(np.float32), np.concatenate(rows)
        for lo in range(0, len(grams), BLOCK):  # blocks of the vocabulary, so that the count matrix stays small
            inside = (at >= lo) & (at < lo + BLOCK)
            matrix = np.zeros((len(texts), min(BLOCK, len(grams) - lo)), np.float32)
            matrix[rows[inside], at[inside] - lo] = counts[inside]
            out += matrix @ gram_vectors(grams[lo : lo + BLOCK])
        out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
    return out, has, distinct


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, unit prototypes) from at most `rows` labelled texts of each language that are not held out."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", F.xxhash64("text").alias("text_hash")).distinct()
    spread = labelled.withColumn("h", F.xxhash64("doc_id")).withColumn("part", F.pmod("h", F.lit(TRAIN_PARTS)))
    order = Window.partitionBy("lang", "part").orderBy("h", "doc_id", "text_hash")
    chosen = spread.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= -(-rows // TRAIN_PARTS)).select("doc_id", "lang", "text_hash").distinct()
    chosen = materialize(chosen, "chosen")
    n = chosen.count()
    if chosen.select("lang").distinct().count() > TRAIN_LANGS:
        raise ValueError(f"more than {TRAIN_LANGS} values of lang; give train() a column of languages")
    known = docs.select("doc_id", "lang", "text", F.xxhash64("text").alias("text_hash")).where("lang IS NOT NULL AND text IS NOT NULL")
    texts = known.join(maybe_broadcast(chosen, n), ["doc_id", "lang", "text_hash"], "left_semi").dropDuplicates(["doc_id", "lang", "text_hash"])

    def run(batch: pa.RecordBatch) -> dict:
        langs, texts = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist()
        sums: dict[str, np.ndarray] = {}
        for lo in range(0, len(texts), 128):
            made, _ = bundles(texts[lo : lo + 128])
            for lang in set(langs[lo : lo + 128]):
                sums[lang] = sums.get(lang, 0) + made[langs[lo : lo + 128] == lang].sum(0)
        return {"lang": list(sums), "bundle": [x.astype(np.float64).round(6).tolist() for x in sums.values()]}

    parts = map_arrow(texts.select("lang", "text"), run, "lang string, bundle array<double>")
    total = parts.select("lang", F.posexplode("bundle").alias("dim", "x")).groupBy("lang", "dim").agg(F.sum(F.col("x").cast("decimal(20,6)")).cast("double").alias("x"))
    found = total.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("v")).orderBy("lang").collect()
    langs = [r["lang"] for r in found]
    matrix = np.array([[x["x"] for x in r["v"]] for r in found]).reshape(len(langs), -1) if langs else np.zeros((0, DIM))
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
    return langs, matrix.astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str] | None = None) -> DataFrame:
    """doc_id (or the columns of `keep`), lang_pred and score for each row of docs; only the text is looked at."""
    keep = keep or ["doc_id"]
    return _predicted(docs, model, keep).select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "lang_pred", "score")


def _predicted(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str]) -> DataFrame:
    """The columns of `keep` as k0, k1, ..., so that none of them clashes, with lang_pred, score and n_grams, how many different n-grams there are."""
    langs, matrix = model

    def run(batch: pa.RecordBatch) -> dict:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        pred, score, grams = [], [], []
        for lo in range(0, len(texts), 128):
            made, has, n = _bundles(texts[lo : lo + 128])
            cos = made @ matrix.T if langs else np.zeros((len(made), 1))
            best = cos.argmax(1)
            pred += [langs[b] if h and langs else "und" for b, h in zip(best, has, strict=True)]
            score += [float(min(1, max(0, cos[i, b]))) if has[i] and langs else 0.0 for i, b in enumerate(best)]
            grams += n.tolist()
        return {f"k{i}": batch.column(i) for i in range(len(keep))} | {"lang_pred": pred, "score": score, "n_grams": grams}

    schema = ", ".join(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    named = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col("text").alias("of"))
    return map_arrow(named, run, schema + ", lang_pred string, score double, n_grams long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in which a learned language is recognised, with all their columns."""
    return recognised(docs, train(docs))


def recognised(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """The rows of docs whose language the model knows, by the rule above."""
    scored = _predicted(docs, model, docs.columns)
    near = (F.col("score") >= SIGMAS / DIM**0.5) | (F.col("n_grams") < LEAST_GRAMS) if model[0] else F.lit(True)
    return scored.where((F.col("n_grams") > 0) & near).select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)))
