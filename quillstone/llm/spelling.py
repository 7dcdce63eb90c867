"""Spelling variants: words that are one edit apart, found by merging the light subtrees of errata tries.

Two words that are one inserted, deleted or replaced code point apart leave a trie at one node: behind it their rests are equal once a
character is replaced or skipped. In a trie with a heavy path (at each node, the child with most words is heavy) it suffices to look at
words of light children: at each such node a word is merged with one character replaced by the heavy child's, one skipped, or the heavy child's inserted,
and light children are merged among themselves by what follows them. A word lies in light children of at most log2(words) nodes. Where a
merged path ends at another word's terminal, the two are a pair; each pair is met once, at the node where they part.

How it is dealt out:

1. Words are counted by a grouped sum, combined before the shuffle. The vocabulary, not the corpus, goes on.
2. Pairs of words of equal length m, and of lengths m and m + 1, part at some depth of a range [low, high). They share the first ``low``
   characters and the last ``m - high`` (or one more), so these, with m, are the key of a trie. A trie of more than ``LEAF`` words is split in the
   middle of its range, into tries that share more at the front and tries that share more at the back. At one depth a key leaves one character open, so a
   trie then holds no more words than there are characters: splitting ends without a cap, whatever the words have in common.
3. A task takes whole tries and merges many at once in arrays. It hands on, for each word, the number of its partners and the best of
   them: as each pair is in one trie, numbers add up and the best of the best is the best.
4. Forms are followed to their roots by doubling, a written table a round; as counts at least double on the way, a few rounds do.

Defined results: null or empty text has no words; a null doc_id counts as an empty string in the hash that deletes letters; repeated rows count
again; other columns are ignored; an empty table gives no rows. Words may be of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.shared import ascii_lower, materialize, maybe_broadcast, prepare, table, whole_runs

LEAST_LENGTH, LEAST_COUNT, ERRATA = 5, 3, 97
#: Words and bytes of a trie that is not split, and rows of tries that a task merges at once.
LEAF, LEAF_BYTES, MERGED_ROWS = 2048, 8_000_000, 16_384

_rng = np.random.default_rng(11)
_CODE = _rng.integers(1, 2**63, 256, np.uint64)
_CODE[0] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_OF_TRIE = np.uint64(0xD6E8FEB86659FD93)


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, errata: int | None = ERRATA) -> DataFrame:
    """(word, n) of docs (doc_id, text); with `errata`, runs whose crc32 with their doc_id it divides lose a letter."""
    runs = docs.select("doc_id", F.explode(F.split(ascii_lower(F.col("text")), "[^a-zÀ-ÿ]+")).alias("run")).where(F.char_length("run") >= least_length)
    if errata:
        runs = runs.withColumn("h", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary")))
        at = F.pmod("h", F.char_length("run")).cast("int")
        less = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.char_length("run")))
        runs = runs.select(F.when(F.col("h") % errata == 0, less).otherwise(F.col("run")).alias("run")).where(F.char_length("run") >= least_length)
    return runs.groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


class Tries:
    """Tries of one chunk of rows sorted by (trie, word): characters as Latin-1 bytes, hashes of words, shared prefixes of neighbours."""

    def __init__(self, words: list[str], trie: np.ndarray) -> None:
        data = [w.encode("latin-1") for w in words]
        self.length = np.fromiter(map(len, data), np.int64, len(data))
        width = int(self.length.max()) + 2
        self.cells = np.array(data, f"S{width}").view(np.uint8).reshape(len(data), width)
        self.trie = trie
        self.power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(width, _BASE)]))
        self.hash = self.prefix(np.zeros(len(data), np.uint64), 0, width)
        self.salt = trie.astype(np.uint64) * _OF_TRIE
        keys = self.hash + self.salt
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.shared = self._shared()

    def prefix(self, so_far: np.ndarray, start: int, end: int) -> np.ndarray:
        """Hashes of the first `end` characters, out of those of the first `start`."""
        step = max(1, 2_000_000 // max(1, len(self.cells)))
        for lo in range(start, end, step):
            part = self.cells[:, lo : min(end, lo + step)]
            so_far = so_far + (_CODE[part] * self.power[lo : lo + part.shape[1]]).sum(1, dtype=np.uint64)
        return so_far

    def _shared(self) -> np.ndarray:
        """Shared leading characters of each row and the next one of its trie, -1 where there is none."""
        out = np.full(len(self.cells), -1, np.int64)
        step = max(1, 4_000_000 // self.cells.shape[1])
        for lo in range(0, len(self.cells) - 1, step):
            hi = min(len(self.cells) - 1, lo + step)
            out[lo:hi] = (self.cells[lo:hi] != self.cells[lo + 1 : hi + 1]).argmax(1)
        out[:-1][self.trie[1:] != self.trie[:-1]] = -1
        return out

    def find(self, rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position among rows, row of the word) of the hashes that a word of the same trie has."""
        want = hashes + self.salt[rows]
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == want)
        return hit, self.order[at[hit]]

    def same(self, a: np.ndarray, b: np.ndarray, i: int, skip_a: int, skip_b: int) -> np.ndarray:
        """Which words a and b are equal but for a character at place i that is left out on the sides given."""
        x, y = self.cells[a], self.cells[b]
        width = x.shape[1]
        end = width - i - 1
        return (x[:, :i] == y[:, :i]).all(1) & (x[:, i + skip_a : i + skip_a + end] == y[:, i + skip_b : i + skip_b + end]).all(1) & (self.trie[a] == self.trie[b])


def pairs_of(tries: Tries, low: np.ndarray, high: np.ndarray, same_length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (a, b) of words one edit apart that part at a depth in [low, high): by replacement in tries of one length, else by a skip."""
    reached, depth = np.zeros(len(low), np.uint64), 0
    for i in np.unique(tries.shared[tries.shared >= 0]).tolist():
        reached, depth = tries.prefix(reached, depth, i), i
        node = np.concatenate([[0], np.cumsum(tries.shared[:-1] < i)])
        child = np.concatenate([[0], np.cumsum(tries.shared[:-1] <= i)])
        size, first = np.bincount(child), np.flatnonzero(np.concatenate([[True], child[1:] != child[:-1]]))
        by_size = np.lexsort((-size, node[first]))
        lead = np.concatenate([[True], np.diff(node[first][by_size]) > 0])
        heavy = np.zeros(int(node[-1]) + 1, np.int64)
        heavy[node[first][by_size[lead]]] = by_size[lead]
        light = np.flatnonzero((heavy[node] != child) & (low <= i) & (i < high))
        if not len(light):
            continue
        own, main = tries.cells[light, i], tries.cells[first[heavy[node[light]]], i]
        head, rest = reached[light], tries.hash[light] - reached[light]
        after = rest - _CODE[own] * tries.power[i]
        replaced = same_length[light]
        with_heavy = np.flatnonzero(replaced & (own > 0) & (main > 0))
        yield _met(tries, light[with_heavy], head[with_heavy] + after[with_heavy] + _CODE[main[with_heavy]] * tries.power[i], i, 1, 1)
        yield from _merged(tries, light[replaced & (own > 0)], node, after[replaced & (own > 0)], i)
        skipped = np.flatnonzero(~replaced & (own > 0) & (tries.cells[light, i + 1] != own))
        yield _met(tries, light[skipped], head[skipped] + after[skipped] * _BACK, i, 1, 0)
        inserted = np.flatnonzero(~replaced & (main > 0))
        yield _met(tries, light[inserted], head[inserted] + _CODE[main[inserted]] * tries.power[i] + rest[inserted] * _BASE, i, 0, 1)


def _met(tries: Tries, rows: np.ndarray, hashes: np.ndarray, i: int, skip_a: int, skip_b: int) -> tuple[np.ndarray, np.ndarray]:
    hit, other = tries.find(rows, hashes)
    a = rows[hit]
    good = tries.same(a, other, i, skip_a, skip_b)
    return a[good], other[good]


def _merged(tries: Tries, rows: np.ndarray, node: np.ndarray, after: np.ndarray, i: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs among light children whose rests are equal; at most one word a character has the same rest."""
    order = np.lexsort((after, node[rows]))
    rows, key, at = rows[order], after[order], node[rows][order]
    for step in range(1, 256):
        equal = np.flatnonzero((key[step:] == key[:-step]) & (at[step:] == at[:-step])) if step < len(rows) else np.zeros(0, np.int64)
        if not len(equal):
            return
        a, b = rows[equal], rows[equal + step]
        good = tries.same(a, b, i, 1, 1)
        yield a[good], b[good]


def near(words: DataFrame) -> DataFrame:
    """(word, n_near, best): the number of words one edit away, and the one of largest n (then least) with its n as (less, word), less = -n;
    of words (word, n). Words without such a word give no row."""
    prepare(words.sparkSession)
    sized = words.select("word", "n", F.char_length("word").alias("length"))
    kinds = F.array(*(F.struct((F.col("length") - less).alias("m"), F.lit(equal).alias("equal"), F.lit(0).alias("low"), (F.col("length") - less + (0 if equal else 1)).alias("high")) for less, equal in ((0, True), (0, False), (1, False))))
    rows = sized.select("word", "n", "length", F.explode(kinds).alias("k")).select("word", "n", "length", "k.*").where("m > 0")
    found = None
    while True:
        shared = F.col("m") - F.col("high") + F.when(F.col("equal"), 0).otherwise(1)
        front, back = F.col("word").substr(F.lit(1), F.col("low")), F.col("word").substr(F.col("length") - shared + 1, shared)
        keyed = rows.withColumn("key", F.concat_ws("|", "m", "equal", "low", "high", front, back))
        sizes = keyed.groupBy("key", "low", "high", "m").agg(F.count("*").alias("c")).where("c > 1")
        sizes = materialize(sizes.select("key", ((F.col("high") - F.col("low") > 1) & ((F.col("c") > LEAF) | (F.col("c") * F.col("m") > LEAF_BYTES))).alias("hot")), "sizes")
        leaves, hot = sizes.where("NOT hot").select("key"), sizes.where("hot").select("key")
        n_hot = hot.count()
        part = _merge_tries(keyed.join(maybe_broadcast(leaves, leaves.count()), "key"))
        found = part if found is None else found.union(part)
        if not n_hot:
            break
        rows = keyed.join(maybe_broadcast(hot, n_hot), "key").drop("key")
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        ranges = F.array(F.struct("low", middle.alias("high")), F.struct(middle.alias("low"), "high"))
        rows = materialize(rows.withColumn("r", F.explode(ranges)).select("word", "n", "length", "m", "equal", "r.low", "r.high"), "split")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def _merge_tries(rows: DataFrame) -> DataFrame:
    """(word, n_near, best) within each trie of rows (key, word, n, m, equal, low, high)."""
    size, size_bytes = MERGED_ROWS, 4 * LEAF_BYTES

    def merged(part: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        words, n = part.column("word").to_pylist(), part.column("n").to_numpy()
        trie = np.zeros(len(words), np.int64)
        trie[starts[1:]] = 1
        get = lambda name: part.column(name).to_numpy()
        met = list(pairs_of(Tries(words, np.cumsum(trie)), get("low"), get("high"), get("equal")))
        a, b = (np.concatenate([np.concatenate((x[k], x[1 - k])) for x in met] or [np.zeros(0, np.int64)]) for k in (0, 1))
        place = np.empty(len(words), np.int64)
        place[pc.sort_indices(part.column("word")).to_numpy()] = np.arange(len(words))
        order = np.lexsort((place[b], -n[b], a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
        counts = np.diff(np.append(first, len(a)))
        best = pa.StructArray.from_arrays([pa.array(-n[b[first]]), part.column("word").take(pa.array(b[first])).combine_chunks()], ["less", "word"])
        return pa.RecordBatch.from_arrays([part.column("word").take(pa.array(a[first])).combine_chunks(), pa.array(counts), best], names=("word", "n_near", "best"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, starts in whole_runs(batches, ["key"], size):
            widths, lo = pc.binary_length(part.column("word")).to_numpy(), 0
            ends = np.append(starts[1:], part.num_rows)
            while lo < len(starts):  # whole tries whose rows, all as wide as the widest, stay within a bound
                hi, wide = lo + 1, int(widths[starts[lo] : ends[lo]].max())
                while hi < len(starts) and (ends[hi] - starts[lo]) * max(wide, int(widths[starts[hi]]) + 1) <= size_bytes:
                    wide, hi = max(wide, int(widths[starts[hi] : ends[hi]].max())), hi + 1
                base = int(starts[lo])
                yield merged(part.slice(base, int(ends[hi - 1]) - base).combine_chunks(), starts[lo:hi] - base)
                lo = hi

    dealt = rows.select("key", "m", "word", "n", "low", "high", "equal").repartition("key").sortWithinPartitions("m", "key", "word")
    return dealt.mapInArrow(run, "word string, n_near long, best struct<less: long, word: string>")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form), each word's last form; forms must not go in circles."""
    links = materialize(forms.select("word", F.col("form").alias("root")), "links")
    while True:
        known = maybe_broadcast(links.select(F.col("word").alias("root"), F.col("root").alias("further")), links.count())
        links = materialize(links.join(known, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "links")
        if not links.where("moved").limit(1).count():
            return links.select("word", "root")
        links = links.drop("moved")


def variants(words: DataFrame, times: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n): a word's form is its near word of largest n, if that is `times` its own."""
    words = materialize(words, "words")
    total = words.count()
    best = materialize(near(words), "near")
    placed = words.join(maybe_broadcast(best, best.count()), "word", "left")
    strong = -F.col("best.less") >= times * F.col("n")
    placed = materialize(placed.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best.word")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n")), "forms")
    ends = roots(placed.where("form IS NOT NULL"))
    return placed.join(maybe_broadcast(ends, total), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variants of all words of at least five letters that occur three times."""
    return variants(vocabulary(table(spark, sf_dir, "documents").select("doc_id", "text")))


ORACLE = r"""
WITH RECURSIVE byte AS (SELECT list(list_reduce(list_prepend(i::UBIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
tok AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
run AS (SELECT doc_id, run, count(*) AS c, coalesce(doc_id::VARCHAR, '') || ':' || run AS s FROM tok WHERE length(run) >= 5 GROUP BY ALL),
crc AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(strlen(s)), lambda i: ('0x' || substr(hex(s), 2 * i + 1, 2))::UBIGINT)), lambda h, b: xor(h >> 8, t[(xor(h, b) & 255)::INT + 1])), 4294967295::UBIGINT) AS h FROM run, byte),
w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(c)::BIGINT AS n FROM crc GROUP BY 1 HAVING length(word) >= 5 AND n >= 3),
cut AS (SELECT word, n, i, substr(word, 1, i) AS a, substr(word, i + 2) AS b FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
pair AS (SELECT x.word, y.word AS other, y.n AS m FROM cut x JOIN cut y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT cut.word, w.word, w.n FROM cut JOIN w ON w.word = a || b UNION SELECT w.word, cut.word, cut.n FROM cut JOIN w ON w.word = a || b),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, encode(other))) AS other, max(m) AS m FROM pair GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN other END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM w LEFT JOIN best USING (word)),
r AS (SELECT word, word AS at FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.at AS root, f.n, f.n_near, f.form_n FROM f JOIN r ON r.word = f.word JOIN f e ON e.word = r.at AND e.form IS NULL
"""
