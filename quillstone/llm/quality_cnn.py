"""A byte-level convolutional network in numpy that scores the quality of texts.

Bytes are embedded; ``FILTERS`` learned filters of WIDTH bytes move in steps of STRIDE over chunks of CHUNK bytes that overlap by
WIDTH bytes and cover the whole document; each filter's rectified output is max-pooled within a chunk. The maxima over all chunks and the mean of
the chunks' maxima are combined by a logistic unit into one probability.

Training reads at most ``TRAIN_ROWS`` labelled documents of each label, those of least hashed doc_id among texts of at most
TRAIN_LONGEST bytes, whole, one text for each doc_id, until TRAIN_BYTES are full; they are chosen by sizes alone, so that no more than that
reaches the driver. Rows whose crc32(doc_id) mod 4 is 2 are never among them. Because labels are balanced this way, the bias is set back to the true rate.
Scoring is one pass over Arrow batches with the few thousand weights in the task's closure.

Null or empty text is scored as a chunk of zero bytes; without two labels to learn from every score is the known rate (or 0.5).
Each row gives one row, whatever its id or its repetitions; an empty table gives none; where labels of one doc_id differ the greater counts;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.llm.lang_hd import held_out
from quillstone.llm.shared import map_arrow, materialize, maybe_broadcast, table

EMBED, WIDTH, STRIDE, FILTERS, CHUNK = 6, 16, 4, 24, 4096
TRAIN_ROWS, TRAIN_BYTES, TRAIN_LONGEST, EPOCHS, BATCH = 1500, 8_000_000, 200_000, 12, 32
THRESHOLD = 0.7
HELD_BYTES = 128_000


def chunks(data: bytes) -> list[np.ndarray]:
    """Byte chunks of CHUNK bytes with overlaps, which cover the whole text; the last is padded to a whole step."""
    view = np.frombuffer(data, np.uint8)
    step = CHUNK - WIDTH
    out = []
    for lo in range(0, max(1, len(view) - WIDTH), step):
        part = view[lo : lo + CHUNK]
        short = max(WIDTH - len(part), -(len(part) - WIDTH) % STRIDE)
        out.append(np.concatenate([part, np.zeros(short, np.uint8)]) if short else part)
    return out


def _windows(chunk: np.ndarray) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(chunk, WIDTH)[::STRIDE]


def start(seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {
        "embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), "filters": rng.normal(0, (2 / (WIDTH * EMBED)) ** 0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32),
        "shift": np.zeros(FILTERS, np.float32), "out": rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), "bias": np.zeros(1, np.float32),
    }


def forward(model: dict, data: bytes) -> tuple[float, list]:
    """The logit of a text, and for each chunk its windows, maxima and where they stand."""
    kept = []
    for chunk in chunks(data):
        windows = _windows(chunk)
        x = model["embed"][chunk]
        x = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=0)[::STRIDE].transpose(0, 2, 1).reshape(len(windows), -1)
        y = x @ model["filters"] + model["shift"]
        at = y.argmax(0)
        kept.append((windows, x, at, np.maximum(y[at, np.arange(FILTERS)], 0)))
    pooled = np.array([k[3] for k in kept])
    features = np.concatenate([pooled.max(0), pooled.mean(0)])
    return float(features @ model["out"] + model["bias"][0]), [kept, pooled, features]


def gradients(model: dict, state: list, error: float, into: dict) -> None:
    kept, pooled, features = state
    into["out"] += error * features
    into["bias"] += error
    top = pooled.argmax(0)
    for c, (windows, x, at, value) in enumerate(kept):
        g = error * (model["out"][:FILTERS] * (top == c) + model["out"][FILTERS:] / len(kept)) * (value > 0)
        live = np.nonzero(g)[0]
        if not len(live):
            continue
        chosen = x[at[live]]
        into["filters"][:, live] += chosen.T * g[live]
        into["shift"] += g
        back = (model["filters"][:, live] * g[live]).T.reshape(len(live), WIDTH, EMBED)
        np.add.at(into["embed"], windows[at[live]], back)


def forward_all(model: dict, texts: list[bytes]) -> tuple[np.ndarray, dict]:
    """Logits of several texts by one matrix product, with what their gradients need."""
    parts = [chunks(t) for t in texts]
    counts = np.array([len(p) for p in parts])
    flat = [c for p in parts for c in p]
    data, sizes = np.concatenate(flat), np.array([len(c) for c in flat])
    windows = (sizes - WIDTH) // STRIDE + 1
    begins, firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.concatenate([[0], np.cumsum(windows)[:-1]])
    starts = np.repeat(begins - STRIDE * firsts, windows) + STRIDE * np.arange(windows.sum())
    x = np.lib.stride_tricks.sliding_window_view(model["embed"][data].reshape(-1), WIDTH * EMBED)[starts * EMBED]
    y = x @ model["filters"] + model["shift"]
    pooled = np.maximum(np.maximum.reduceat(y, firsts, axis=0), 0)
    ends = np.concatenate([[0], np.cumsum(counts)[:-1]])
    features = np.concatenate([np.maximum.reduceat(pooled, ends, axis=0), np.add.reduceat(pooled, ends, axis=0) / counts[:, None]], axis=1)
    return features @ model["out"] + model["bias"][0], {"x": x, "y": y, "data": data, "starts": starts, "firsts": firsts, "windows": windows, "pooled": pooled, "ends": ends, "counts": counts, "features": features}


def gradients_all(model: dict, state: dict, errors: np.ndarray) -> dict:
    """The sums of the texts' gradients for the errors of their logits."""
    pooled, counts, ends = state["pooled"], state["counts"], state["ends"]
    at = np.array([state["y"][a : a + n].argmax(0) + a for a, n in zip(state["firsts"], state["windows"], strict=True)])
    top = np.concatenate([np.arange(n)[:, None] == pooled[a : a + n].argmax(0) for a, n in zip(ends, counts, strict=True)])
    error = np.repeat(errors, counts)[:, None]
    g = (error * (model["out"][:FILTERS] * top + model["out"][FILTERS:] / np.repeat(counts, counts)[:, None]) * (pooled > 0)).astype(state["x"].dtype)
    embed = np.zeros_like(model["embed"])
    back = (model["filters"].T[None] * g[:, :, None]).reshape(-1, EMBED)
    np.add.at(embed, state["data"][state["starts"][at][:, :, None] + np.arange(WIDTH)].reshape(-1), back)
    return {"embed": embed, "filters": np.einsum("cfk,cf->kf", state["x"][at], g), "shift": g.sum(0), "out": errors @ state["features"], "bias": np.array([errors.sum()])}


def fit(texts: list[str], labels: list[int], rate: float, epochs: int = EPOCHS) -> dict:
    """Adam over shuffled mini-batches; the bias is moved from the sample's rate of label 1 to the given one."""
    model = start()
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.items()}
    data, y = [t.encode("utf-8", "surrogatepass") for t in texts], np.array(labels)
    rng, n = np.random.default_rng(6), 0
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        for lo in range(0, len(order), BATCH):
            part = order[lo : lo + BATCH]
            logits, state = forward_all(model, [data[i] for i in part])
            grads = gradients_all(model, state, 1 / (1 + np.exp(-np.clip(logits, -30, 30))) - y[part])
            n += 1
            for k, g in grads.items():
                g = (g / len(part)).astype(model[k].dtype)
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                model[k] -= 0.004 * (1 - epoch / epochs) * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.999**n)) + 1e-8)
    own = y.mean()
    model["bias"] = model["bias"] + np.float32(np.log(rate / (1 - rate)) - np.log(own / (1 - own)))
    return model


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> dict:
    """A model from at most `rows` documents of each label, or {'rate': r} where there are not two labels."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    rate = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    if len(counts) < 2:
        return {"rate": float(rate)}
    # Sizes first, without texts: rows by hash, one text for each id, until a label's rows or bytes are used up. Then the texts of these alone.
    cut = F.when(F.col("quality") == 1, F.lit(min(1.0, 1.2 * rows / counts[1] + 1e-6))).otherwise(F.lit(min(1.0, 1.2 * rows / counts[0] + 1e-6)))
    few = materialize(known.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)).where(F.col("h") <= cut), "few")  # about 1.2 times `rows` of each label
    sized = docs.select("doc_id", F.octet_length("text").alias("size"), F.xxhash64("text").alias("of")).where(F.col("size") <= TRAIN_LONGEST).join(maybe_broadcast(few, few.count()), "doc_id")
    sized = sized.groupBy("doc_id", "quality", "h").agg(F.min(F.struct("size", "of")).alias("t")).select("doc_id", "quality", "h", "t.*")
    order = Window.partitionBy("quality").orderBy("h", "doc_id")
    placed = sized.withColumns({"n": F.row_number().over(order), "sum": F.sum("size").over(order)}).where((F.col("n") <= rows) & (F.col("sum") <= TRAIN_BYTES))
    chosen = materialize(placed.select("doc_id", "quality", "h", "of"), "chosen")
    texts_ = docs.select("doc_id", "text", F.xxhash64("text").alias("of")).join(maybe_broadcast(chosen, 2 * rows), ["doc_id", "of"]).dropDuplicates(["doc_id"])
    got = sorted(texts_.select("doc_id", "quality", "h", "text").collect(), key=lambda r: (r["quality"], r["h"], r["doc_id"]))  # at most 2 * TRAIN_BYTES
    texts, ys = [r["text"] for r in got], [r["quality"] for r in got]
    return fit(texts, ys, rate) if 0 < sum(ys) < len(ys) else {"rate": float(rate)}


def _logits(model: dict, texts: list[bytes]) -> list[float]:
    """Logits of texts together where they are short, each on its own, chunk by chunk, where they are not."""
    if not texts:
        return []
    return forward_all(model, texts)[0].tolist() if sum(map(len, texts)) <= 2 * HELD_BYTES else [forward(model, t)[0] for t in texts]


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) of every document from its whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        if "rate" in model:
            return {"doc_id": batch.column(0), "score": [model["rate"]] * batch.num_rows}
        logits, held = [], []
        for t in batch.column(1).to_pylist():
            held.append((t or "").encode("utf-8", "surrogatepass"))
            if len(held) == BATCH or sum(map(len, held)) > HELD_BYTES:
                logits, held = [*logits, *_logits(model, held)], []
        logits = np.array([*logits, *_logits(model, held)])
        return {"doc_id": batch.column(0), "score": (1 / (1 + np.exp(-np.clip(logits, -30, 30)))).tolist()}

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
