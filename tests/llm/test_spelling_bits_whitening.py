"""Spelling variants, bit-sliced fingerprints and whitening against brute force, on small fixtures with awkward rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillstone.llm import bit_sliced, registry, spelling, whitening
from tests.llm.test_operators import DOCS, corpus

SF = "/root/testdata/sf0.001"


def counted(docs):
    """Words of (doc_id, text) rows, by the contract's wording."""
    found = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_of(words):
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in words}
    form = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in near.items() if vs}
    form = {w: f for w, f in form.items() if words[f] >= 2 * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), words[w], len(near[w]), words.get(form.get(w))) for w in words}


def told(frame):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in frame.collect()}


def some_words():
    """Dense words over three letters, runs of one letter, words inside words, and chains of forms."""
    rng = random.Random(2)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(5, 8))): rng.randint(3, 400) for _ in range(700)}
    words |= {"x" * n + end: rng.randint(3, 400) for n in range(5, 30) for end in ("", "a", "b", "ab")}
    words |= {"chain" + "e" * i: 3 * 2**i for i in range(12)}
    words |= {"z" * 4000 + end: 5 for end in ("a", "b", "ba")}
    return words


@pytest.mark.parametrize(("leaf", "rows"), [(2048, 16384), (20, 200), (1, 1)])
def test_variants_against_all_pairs(spark, monkeypatch, leaf, rows):
    """Whatever the size of a trie is, from all words of a length down to one open character."""
    monkeypatch.setattr(spelling, "LEAF", leaf)
    monkeypatch.setattr(spelling, "MERGED_ROWS", rows)
    words = some_words()
    got = told(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    expected = variants_of(words)
    assert got == expected
    assert got["chain"][1] == "chain" + "e" * 11 and max(v[3] for v in got.values()) > 5


def test_a_hot_front_is_split_without_emitting_pairs(spark, monkeypatch):
    """3,000 words that share their front half: tries stay small, and what tasks hand on grows with the words."""
    rng = random.Random(4)
    words = {"common" + "".join(rng.choice("abcdefghij") for _ in range(6)): rng.randint(3, 50) for _ in range(3000)}
    monkeypatch.setattr(spelling, "LEAF", 64)
    seen, merge = [], spelling._merge_tries

    def watched(rows):
        seen.append(rows.groupBy("key").count().agg(F.max("count"), F.sum("count")).first())
        return merge(rows)

    monkeypatch.setattr(spelling, "_merge_tries", watched)
    assert told(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"))) == variants_of(words)
    assert all((most or 0) <= 64 for most, _ in seen) and sum(n or 0 for _, n in seen) < 30 * len(words)


def test_vocabulary_and_query_against_brute_force(spark, tmp_path):
    rows = [(i, t) for i, t, *_ in corpus()]
    rows += [(900, "École école ECOLE " * 4), (None, "nameless nameless nameless words words words"), (901, "a1b2 cafés-cafés_cafés " * 3), (902, "abcde" * 50_000 + " " + "longer " * 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit("clash"), "n": F.lit(1), "run": F.lit("clash")})
    words = {r["word"]: r["n"] for r in spelling.vocabulary(docs).collect()}
    assert words == counted(rows) and "école" in words
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert told(spelling.query(spark, str(tmp_path))) == variants_of(words)


def test_variants_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.vocabulary(empty)).count() == 0
    assert spelling.variants(spelling.vocabulary(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"))).count() == 0


def print_of(text):
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked_components(prints, radius=2):
    """{id: least id reachable} of (id, fingerprint) rows; rows of one id are one node."""
    parent = {i: i for i, _ in prints}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, x in prints:
        for b, y in prints:
            if a < b and (x ^ y).bit_count() <= radius:
                u, v = find(a), find(b)
                parent[max(u, v)] = min(u, v)
    return {i: find(i) for i in parent}


@pytest.mark.parametrize("radius", [1, 2, 3, 6])
def test_planes_against_all_distances(radius):
    rng = np.random.default_rng(radius)
    for n in (1, 2, 63, 64, 65, 700):
        prints = rng.integers(0, 2**64, n, np.uint64)
        for _ in range(n // 2):
            x = prints[rng.integers(n)]
            for bit in rng.integers(0, 64, rng.integers(0, radius + 3)):
                x ^= np.uint64(1) << np.uint64(bit)
            prints[rng.integers(n)] = x
        got = {(int(i), int(j)) for a, b in bit_sliced.within(prints, radius) for i, j in zip(a, b, strict=True)}
        apart = np.bitwise_count(prints[:, None] ^ prints[None, :])
        assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(apart <= radius), strict=True) if i < j}


def test_fingerprint_links_against_brute_force(spark):
    """Near copies of long texts, nulls, empty and short texts, repeated rows, one id with two texts, a row without an id, clashing columns."""
    rng, rows = random.Random(9), [r[:2] for r in corpus()]
    for k in range(30):
        base = (rows[k][1] or "").split() * 12
        base[rng.randrange(len(base))] = "changed"
        rows.append((1000 + k, " ".join(base)))
        base[rng.randrange(len(base))] = "again"
        rows.append((2000 + k, " ".join(base)))
    rows += [(5, rows[20][1]), (7, rows[7][1])]
    docs = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string")
    for name in ("fp", "rep", "mask", "value", "component", "node", "c"):
        docs = docs.withColumn(name, F.lit("clash"))
    got = bit_sliced.near_duplicates(docs).collect()
    prints = {t: print_of(t) for _, t in rows}
    expected = linked_components([(i, prints[t]) for i, t in rows])
    assert Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got) == Counter([*((i, prints[t], expected[i]) for i, t in rows), (None, prints[rows[0][1]], None)])
    assert len(set(expected.values())) < len(expected) - 30


@pytest.mark.parametrize("leaf", [4096, 16, 2])
def test_links_of_a_crowded_ball(spark, monkeypatch, leaf):
    """Fingerprints that differ in few bits fill all buckets; split ones give the same components."""
    monkeypatch.setattr(bit_sliced, "LEAF", leaf)
    rng = np.random.default_rng(5)
    centre, rows = int(rng.integers(0, 2**63)), set()
    while len(rows) < 300:
        x = centre
        for bit in rng.integers(0, 64, rng.integers(0, 9)):
            x ^= 1 << int(bit)
        rows.add(x)
    prints = list(enumerate(sorted(rows)))
    signed = [(i, x - 2**64 if x >= 2**63 else x) for i, x in prints]
    found = bit_sliced.components(bit_sliced.links(spark.createDataFrame(signed, "rep long, fp long")), "ball").collect()
    got = {i: i for i, _ in prints} | {r["node"]: r["component"] for r in found}
    assert got == linked_components(prints)


def test_crowded_buckets_cost_rows_not_squares(spark, monkeypatch):
    """20,000 fingerprints that agree in 44 bits: buckets are split, and rows compared stay within a fixed multiple."""
    monkeypatch.setattr(bit_sliced, "LEAF", 256)
    rng = np.random.default_rng(6)
    signed = [(i, int(x)) for i, x in enumerate(rng.choice(2**20, 20_000, replace=False))]
    seen, compared = [], bit_sliced._compared

    def watched(rows, radius):
        seen.append(rows.groupBy("mask", "value").count().agg(F.max("count"), F.sum("count")).first())
        return compared(rows, radius)

    monkeypatch.setattr(bit_sliced, "_compared", watched)
    bit_sliced.links(spark.createDataFrame(signed, "rep long, fp long")).count()
    assert max(m or 0 for m, _ in seen) <= 256 and sum(n or 0 for _, n in seen) < 81 * len(signed)


def test_fingerprints_of_nothing(spark):
    assert bit_sliced.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def brute_whitening(vectors):
    x = np.floor(np.array(vectors, np.float64) * 64).astype(np.int64) + 1_000_000
    once = np.unique(x, axis=0)
    n, sums = len(once), once.sum(0)
    centred = (n * once - sums) / n
    cov = centred.T @ centred / n
    values, found = np.linalg.eigh(cov)
    return x, n, sums, values[::-1], found[:, ::-1], np.trace(cov)


@pytest.mark.parametrize(("tile", "block"), [(32, 2048), (3, 7), (1, 50)])
def test_whitening_against_numpy(spark, monkeypatch, tile, block):
    """Copies, nulls, broken and short vectors, repeated and nameless rows; whole tiles and ragged ones."""
    monkeypatch.setattr(whitening, "TILE", tile)
    monkeypatch.setattr(whitening, "ROW_BLOCK", block)
    rng = np.random.default_rng(8)
    good = (rng.normal(size=(300, 20)) * np.linspace(3, 0.2, 20)).astype(np.float32).astype(float).tolist()
    rows = [*enumerate(good), (900, good[3]), (3, good[3]), (None, good[4])] + [(1000 + i, good[0]) for i in range(100)]
    broken = [(2000, None), (2001, []), (2002, [1.0] * 19), (2003, [float("nan"), *good[0][1:]]), (2004, [float("inf"), *good[0][1:]]), (2005, [None, *good[0][1:]])]
    frame = spark.createDataFrame(rows + broken, "vec_id long, embedding array<float>").repartition(5).withColumns({"n": F.lit(1), "x": F.lit("clash"), "component": F.lit(1)})
    usable = whitening.whole_numbers(frame)
    model = whitening.fit(usable)
    got = whitening.whitened(usable, model).toPandas()
    x, n, sums, values, found, trace = brute_whitening([v for _, v in rows])
    assert len(got) == 16 * len(rows) and set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-9
    off = {tuple(v): int(((n * v - sums) ** 2).sum()) for v in x}
    white = ((n * x - sums) / n) @ found[:, :16] / np.sqrt(values[:16])
    for c in range(16):
        part = got[got["component"] == c + 1]
        assert np.allclose(part["explained"], values[c] / trace, rtol=1e-9)
        mine, theirs = np.sort(part["whitened"].to_numpy()), np.sort(white[:, c])
        assert np.allclose(mine, theirs, atol=1e-8) or np.allclose(-mine[::-1], theirs, atol=1e-8)
    assert Counter(got[got["component"] == 1]["deviation"]) == Counter(off[tuple(v)] for v in x)


def test_whitening_of_flat_empty_and_huge_vectors(spark):
    kind = "vec_id long, embedding array<double>"
    empty = whitening.whole_numbers(spark.createDataFrame([], kind))
    assert empty.count() == 0 and whitening.fit(empty) is None
    same = whitening.whole_numbers(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], kind))
    model = whitening.fit(same)
    assert (model.n, len(model.values)) == (1, 0) and whitening.whitened(same, model).count() == 0
    flat = whitening.whole_numbers(spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0]) for i in range(40)], kind))
    model = whitening.fit(flat)
    assert len(model.values) == 1 and model.identity_error < 1e-9 and whitening.whitened(flat, model).count() == 40
    huge = whitening.whole_numbers(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.5, 2.0])], kind))
    model = whitening.fit(huge)
    assert model.n == 3 and {r["deviation"] for r in whitening.whitened(huge, model).collect()} == {None, 40960}
    assert {int(abs(r["x"][0])) for r in huge.where("vec_id < 3").collect()} == {2**52 + 10**6, 2**52 - 10**6}


def test_whitening_query_of_broken_rows(spark, tmp_path):
    spark.createDataFrame([(1, None), (2, [])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert registry.QUERIES["op13_tiled_whitening"](spark, str(tmp_path)).count() == 0
