"""Near-duplicate detection with SetSketch registers.

A document's set holds its distinct word shingles. Each of ``REGISTERS`` registers keeps the least of exponentially
distributed values of the set's elements, as its rounded-down logarithm to base ``BASE`` (exponentially spaced, truncated to
0..Q). Registers of a union are the maxima of the parts' registers, so sketches merge, and equal registers are the likelier
the more two sets have in common. ``BANDS`` bands of ``ROWS`` registers each give candidates: at a Jaccard similarity of 0.85
a pair shares no band with probability under 1e-7, at 0.8 under 2e-5. The base is so near 1 that sets without common elements
share a band with a probability under 1e-16, which keeps clusters apart in corpora of billions of documents.

How it stays linear where many documents resemble each other:

1. Documents with equal sets form a class, by a grouped minimum over a 128-bit digest; one representative goes on.
2. Each member of a band's bucket is joined with the bucket's least member only; components of these edges are clusters of
   candidates, within which every candidate pair lies.
3. Each cluster's texts meet once, in blocks of at most about ``BLOCK_ROWS`` texts or ``BLOCK_SHINGLES`` shingles. Within a
   block, pairs in different components are compared until none is left: registers first, estimating similarity jointly with the known
   sizes by likelihood, then full sets. Pairs that are already connected need no look, so a block of copies costs one comparison each.
4. In clusters of several blocks, a few pivots of the cluster visit every block.
5. Buckets whose members are still in several components are looked at by registers alone: members outside the bucket's largest
   component against all of it, in blocks of at most ``SKETCH_ROWS``. A pair is judged at the first band that it shares. Only the texts of
   pairs that the registers leave plausible are sent, to be compared as in step 3. Texts that merely share a template stop here.

Links are confirmed on full sets of 64-bit shingle hashes. Components come from contraction in tasks and star contraction.

Defined results: null or empty text has no shingle and is linked with nothing; rows of one doc_id count as one document;
a null doc_id is its own component (null) and in no group, so the stage keeps its row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from quillstone.llm.shared import components, map_arrow, map_groups, materialize, maybe_broadcast, table

BANDS, ROWS = 28, 5
REGISTERS = BANDS * ROWS
BASE, RATE, Q = 1.001, 20.0, 2**16 - 2
BLOCK_ROWS, BLOCK_SHINGLES, SKETCH_ROWS, PIVOTS = 256, 400_000, 1024, 8
#: A pair is dropped on its registers only where the likelihood of the threshold is under e**-LEAST of the greatest.
LEAST = 12.0

_rng = np.random.default_rng(10)
_MUL = _rng.integers(0, 2**64, REGISTERS, np.uint64) | np.uint64(1)
_XOR = _rng.integers(0, 2**64, REGISTERS, np.uint64)
_MIX = _rng.integers(0, 2**64, 64, np.uint64) | np.uint64(1)


def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of k-word shingles; of the whole sequence where it is shorter."""
    found = words(text)
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), 1)], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = len(h) - k + 1
    out = h[:n] * _MIX[0]
    for i in range(1, k):
        out = (out ^ (out >> np.uint64(29))) * _MIX[i] + h[i : n + i]
    out = (out ^ (out >> np.uint64(32))) * _MIX[63]
    return np.unique(out ^ (out >> np.uint64(29)))


def registers(hashes: np.ndarray) -> np.ndarray:
    """SetSketch registers of a non-empty set."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(hashes), 512):
        part = (hashes[None, lo : lo + 512] ^ _XOR[:, None]) * _MUL[:, None]
        np.minimum(least, part.min(1), out=least)
    x = -np.log1p(-(least.astype(np.float64) + 1) / 2.0**64.0001) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, Q + 1).astype(np.int64)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each band's number and registers."""
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX[62]
    for i in range(ROWS):
        out = (out ^ (out >> np.uint64(31))) * _MIX[i] + regs.reshape(BANDS, ROWS)[:, i].astype(np.uint64)
    out = (out ^ (out >> np.uint64(32))) * _MIX[63]
    return (out ^ (out >> np.uint64(29))).view(np.int64)


def _collision(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)


def plausible(one: np.ndarray, others: np.ndarray, size: int, sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Which others may reach the threshold, by the joint likelihood of registers and known set sizes.

    Pairs whose equal registers alone are over seven standard deviations below the threshold are not weighed any further.
    """
    out = (others == one).sum(1) >= REGISTERS * threshold - 7 * np.sqrt(REGISTERS * threshold * (1 - threshold))
    out &= np.minimum(size, sizes) >= (threshold - 1e-9) * np.maximum(size, sizes)
    out[out] = _likely(one, others[out], size, sizes[out], threshold)
    return out


def _likely(one: np.ndarray, others: np.ndarray, size: int, sizes: np.ndarray, threshold: float) -> np.ndarray:
    more, fewer = (one > others).sum(1), (one < others).sum(1)
    equal = REGISTERS - more - fewer
    u = size / (size + sizes)
    v = 1 - u
    top = np.minimum(u / v, v / u)
    j = top[:, None] * np.linspace(0, 1, 65)
    up, down = _collision(u[:, None] - v[:, None] * j), _collision(v[:, None] - u[:, None] * j)
    rest = np.clip(1 - up - down, 1e-12, 1)
    fit = more[:, None] * np.log(up) + fewer[:, None] * np.log(down) + equal[:, None] * np.log(rest)
    high = np.where(j >= np.minimum(threshold, top[:, None]) - 1 / 64, fit, -np.inf).max(1)
    return fit.max(1) - high <= LEAST


def links_within(ids: list, sets: list[np.ndarray], labels: list, probes: list[bool], percent: int) -> list[tuple]:
    """Links (id, id) that connect what is linked among the pairs with a probe, leaving out pairs that are connected already."""
    n = len(ids)
    label = np.unique(np.array(labels), return_inverse=True)[1]
    sizes = np.array([len(s) for s in sets])
    regs = np.array([registers(s) for s in sets]) if n > 6 else None
    out = []
    everyone = all(probes)
    for i in range(n):
        if not probes[i]:
            continue
        against = np.nonzero(label[: i if everyone else n] != label[i])[0]
        small, large = np.minimum(sizes[against], sizes[i]), np.maximum(sizes[against], sizes[i])
        against = against[100 * small >= percent * large]
        if regs is not None and len(against):
            equal = (regs[against] == regs[i]).sum(1)
            order = np.argsort(-equal, kind="stable")
            against = against[order][plausible(regs[i], regs[against[order]], int(sizes[i]), sizes[against[order]], percent / 100)]
        for j in against.tolist():
            if label[j] == label[i]:
                continue
            x, y = (sets[i], sets[j]) if len(sets[i]) <= len(sets[j]) else (sets[j], sets[i])
            common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            if 100 * common >= percent * (len(x) + len(y) - common):
                label[label == label[j]] = label[i]
                out.append((ids[i], ids[j]))
    return out


def _linked(rows: DataFrame, keys: list[str], k: int, percent: int) -> DataFrame:
    """(a, b) links of each group of rows (doc_id, text, label, probe)."""

    def run(group: pa.Table) -> dict:
        ids = group.column("doc_id").to_pylist()
        sets = [shingles(t, k) for t in group.column("text").to_pylist()]
        found = links_within(ids, sets, group.column("label").to_pylist(), group.column("probe").to_pylist(), percent)
        return {"a": [x for x, _ in found], "b": [y for _, y in found]}

    return map_groups(rows.select(*keys, "doc_id", "text", "label", "probe"), keys, run, "a long, b long")


def sketched(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, d1, d2, bands): size, digest and band keys of each document's set."""

    def run(batch: pa.RecordBatch) -> dict:
        n, d1, d2, bands = [], [], [], []
        for text in batch.column(1).to_pylist():
            found = shingles(text, k)
            n.append(len(found))
            digest = xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None
            d1.append(int.from_bytes(digest[:8], "big", signed=True) if digest else None)
            d2.append(int.from_bytes(digest[8:], "big", signed=True) if digest else None)
            bands.append(band_keys(registers(found)) if len(found) else None)
        return {"doc_id": batch.column(0), "n": n, "d1": d1, "d2": d2, "bands": bands}

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n long, d1 long, d2 long, bands array<long>")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): documents linked where 100 * intersection >= percent * union."""
    sketches = materialize(sketched(docs, k), "sketches")
    some = sketches.where("n > 0 AND doc_id IS NOT NULL")
    copies = materialize(some.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1").select("d1", "d2", "rep"), "copies")
    of_copies = maybe_broadcast(copies, copies.count())
    reps = materialize(some.join(of_copies, ["d1", "d2"], "left").where("rep IS NULL OR rep = doc_id").select("doc_id", "n", "bands"), "representatives")
    keyed = reps.select("doc_id", F.explode("bands").alias("key"))
    least = materialize(keyed.groupBy("key").agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("most")).where("b <> most").select("key", "b"), "buckets")
    edges = keyed.join(maybe_broadcast(least, least.count()), "key").where("doc_id <> b").select(F.col("doc_id").alias("a"), "b")
    clusters = components(edges, "candidates")
    members = clusters.count()
    clusters = reps.select(F.col("doc_id").alias("node"), "n").join(maybe_broadcast(clusters, members), "node")
    sums = clusters.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = clusters.join(sums, "component").select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"), "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    placed = materialize(placed, "placed")
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(maybe_broadcast(placed, members), "doc_id")
    texts = materialize(texts.withColumns({"label": F.col("doc_id"), "probe": F.lit(True)}), "texts")
    found = components(_linked(texts, ["cluster", "block"], k, percent), "linked")
    large = texts.where("blocks > 1")
    if not large.isEmpty():
        labelled = _labelled(large, found)
        found = _with(found, _linked(_pivots(labelled), ["cluster", "block"], k, percent))
        labelled = _labelled(large, found)
        met = _meetings(labelled, reps, k, percent)
        if met is not None:
            found = _with(found, _linked(met, ["key", "block", "turn"], k, percent))
    found = found.select(F.col("node").alias("rep"), F.col("component").alias("component_id"))
    joined = sketches.select("doc_id", "n", "d1", "d2").join(of_copies, ["d1", "d2"], "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep"))
    return (
        joined.join(maybe_broadcast(found, found.count()), "rep", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "rep").alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def _with(found: DataFrame, links: DataFrame) -> DataFrame:
    return components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links), "linked")


def _labelled(large: DataFrame, found: DataFrame) -> DataFrame:
    """The members of clusters of several blocks, labelled with their components so far."""
    found = maybe_broadcast(found, found.count())
    return large.drop("label", "probe").join(found, large["doc_id"] == found["node"], "left").select("cluster", "blocks", "block", "doc_id", "text", F.coalesce("component", "doc_id").alias("label"))


def _pivots(labelled: DataFrame) -> DataFrame:
    """Every block with the cluster's pivots: the PIVOTS members of least hashed id, found from each block's own least."""
    low = labelled.groupBy("cluster", "block").agg(F.min(F.struct(F.xxhash64("doc_id").alias("h"), "doc_id")).alias("m"))
    low = low.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy("m"))).where(F.col("rank") <= PIVOTS)
    low = materialize(low.select("cluster", "m.doc_id"), "pivots")
    pivots = labelled.join(maybe_broadcast(low, low.count()), ["cluster", "doc_id"], "left_semi")
    sent = pivots.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cols = ["cluster", "block", "doc_id", "text", "label"]
    return sent.select(*cols, F.lit(True).alias("probe")).union(labelled.select(*cols, F.lit(False)))


def _meetings(labelled: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame | None:
    """(key, block, turn, doc_id, text, label, probe): the texts to compare in buckets with several components, None without such a bucket.

    A bucket's probes are its members outside its largest component; they meet all members. Registers alone decide who is sent."""
    labels = materialize(labelled.select("doc_id", "label").distinct(), "labels")
    n_labels = labels.count()
    keyed = reps.join(maybe_broadcast(labels, n_labels), "doc_id").select("doc_id", "label", F.explode("bands").alias("key"))
    counts = keyed.groupBy("key", "label").agg(F.count("*").alias("c"))
    mixed = counts.groupBy("key").agg(F.max(F.struct("c", "label")).alias("m"), F.sum("c").alias("all"), F.count("*").alias("several")).where("several > 1")
    mixed = mixed.select("key", F.col("m.label").alias("main"), F.ceil(F.col("all") / SKETCH_ROWS).cast("int").alias("blocks"), F.ceil((F.col("all") - F.col("m.c")) / SKETCH_ROWS).cast("int").alias("turns"))
    mixed = materialize(mixed, "mixed")
    n_mixed = mixed.count()
    if not n_mixed:
        return None
    rows = materialize(keyed.join(maybe_broadcast(mixed, n_mixed), "key"), "rows")
    ids = materialize(rows.select("doc_id").distinct(), "sketched")
    n_ids = ids.count()
    regs = labelled.select("doc_id", "text").join(maybe_broadcast(ids, n_ids), "doc_id", "left_semi")
    regs = materialize(_registers_of(regs, k), "registers")
    placed = rows.withColumns({"own": F.pmod(F.xxhash64("doc_id", "key"), F.col("blocks")).cast("int"), "at": F.pmod(F.xxhash64("key", "doc_id"), F.col("turns")).cast("int")})
    cols = ["key", "block", "turn", "doc_id", "label"]
    probes = placed.where("label <> main").withColumns({"turn": F.col("at"), "block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))})
    base = placed.withColumns({"block": F.col("own"), "turn": F.explode(F.sequence(F.lit(0), F.col("turns") - 1))})
    both = probes.select(*cols, F.lit(True).alias("probe")).union(base.select(*cols, F.lit(False)))
    sent = materialize(_plausible_rows(both.join(maybe_broadcast(regs, n_ids, 100_000), "doc_id"), percent), "sent")
    few = sent.select("doc_id").distinct()
    wanted = labelled.select("doc_id", "text").join(few, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return sent.join(wanted, "doc_id")


def _registers_of(rows: DataFrame, k: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> dict:
        sets = [shingles(t, k) for t in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), "n": [len(s) for s in sets], "regs": [registers(s).astype(np.uint16).tobytes() for s in sets]}

    return map_arrow(rows, run, "doc_id long, n long, regs binary")


def _plausible_rows(rows: DataFrame, percent: int) -> DataFrame:
    """The rows that have a plausible partner of another component in their group, and share no earlier band with it."""

    def run(group: pa.Table) -> dict:
        label, n = (group.column(c).to_numpy() for c in ("label", "n"))
        probe, ids = np.array(group.column("probe").to_pylist()), group.column("doc_id").to_numpy()
        regs = np.frombuffer(b"".join(group.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        key = group.column("key")[0].as_py()
        band = int(np.nonzero(band_keys(regs[0].astype(np.int64)) == key)[0][0])
        wanted = np.zeros(len(ids), bool)
        for i in np.nonzero(probe)[0].tolist():
            against = np.nonzero(label != label[i])[0]
            if band:
                earlier = (regs[against, : band * ROWS] == regs[i, : band * ROWS]).reshape(-1, band, ROWS).all(2).any(1)
                against = against[~earlier]
            against = against[plausible(regs[i], regs[against], int(n[i]), n[against], percent / 100)]
            wanted[against] = True
            wanted[i] |= len(against) > 0
        return {c: group.column(c).filter(pa.array(wanted)).combine_chunks() for c in ("key", "block", "turn", "doc_id", "label", "probe")}

    return map_groups(rows.select("key", "block", "turn", "doc_id", "label", "probe", "n", "regs"), ["key", "block", "turn"], run, "key long, block int, turn int, doc_id long, label long, probe boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at 0.85 over 3-word shingles, as its contract has it."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five-word shingles, 0.8), with all its columns."""
    dropped = materialize(near_duplicates(docs).where("NOT kept").select("doc_id").distinct(), "dropped")
    return docs.join(maybe_broadcast(dropped, dropped.count()), "doc_id", "left_anti").select(*docs.columns)


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 3 THEN [array_to_string(w[i + 1 : i + 3], ' ') FOR i IN range(0, len(w) - 2)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = d.doc_id
"""
