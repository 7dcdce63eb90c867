"""Operators against brute-force versions, round trips and held-out accuracy, on small fixtures with awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import decontaminate, html_text, lang_hd, license_scan, line_dedup, media_audio, near_dup, packing, quality_cnn, suffix_dedup

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def vocabulary(n=400, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def sentence(rng, n, vocab):
    return " ".join(rng.choice(vocab) for _ in range(n))


def corpus(seed=3, n=60):
    """Plain texts, exact and near copies, shared passages, nulls, empty, short and long texts, repeated rows."""
    rng, vocab = random.Random(seed), vocabulary()
    texts = [sentence(rng, rng.randint(60, 160), vocab) for _ in range(n)]
    for i in range(0, n, 4):
        words = texts[i].split()
        for _ in range(3):
            near = list(words)
            for _ in range(rng.randint(0, max(1, len(near) // 40))):
                near[rng.randrange(len(near))] = rng.choice(vocab)
            texts.append(" ".join(near))
    passage = sentence(rng, 57, vocab)
    texts += [sentence(rng, 30, vocab) + " " + passage + " " + sentence(rng, 25, vocab) for _ in range(5)]
    texts += [None, "", " \n\t ", "one", "one", "two words", "Two  WORDS", sentence(rng, 5000, vocab), "ééé ÀÀÀ ß ÿ", texts[0].upper(), texts[0]]
    rows = [(i, t, "en", f"s{i % 5}", len(t or "")) for i, t in enumerate(texts)]
    return rows


def clusters(sets, percent):
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def word_set(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.mark.parametrize(("k", "percent", "block"), [(3, 85, 256), (5, 80, 256), (3, 85, 2)])
def test_near_duplicates(spark, monkeypatch, k, percent, block):
    """Blocks of two rows force clusters over several blocks, with pivots and outsiders."""
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", block)
    monkeypatch.setattr(near_dup, "PIVOTS", 2)
    rows = corpus()
    got = {r["doc_id"]: r for r in near_dup.near_duplicates(spark.createDataFrame(rows, DOCS), k, percent).collect()}
    sets = {r[0]: word_set(r[1], k) for r in rows}
    expected = clusters(sets, percent)
    assert {i: r["component_id"] for i, r in got.items()} == expected
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (expected[i] == i) for i, r in got.items())


def test_near_duplicates_chain(spark, monkeypatch):
    """Texts that drift word by word: only neighbours are alike, and all are one component over many blocks."""
    monkeypatch.setattr(near_dup, "BLOCK_ROWS", 4)
    monkeypatch.setattr(near_dup, "PIVOTS", 1)
    rng, vocab = random.Random(5), vocabulary(3000)
    words, rows = sentence(rng, 200, vocab).split(), []
    for i in range(40):
        rows.append((i, " ".join(words), "en", "s", 0))
        at = (i * 37) % 200
        words[at : at + 6] = [rng.choice(vocab) for _ in range(6)][: len(words[at : at + 6])]
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, DOCS), 3, 85).collect()}
    assert got == clusters({r[0]: word_set(r[1], 3) for r in rows}, 85)


def test_near_duplicates_of_a_template(spark, monkeypatch):
    """5,000 texts share a template and nothing else (similarity 0.5): one cluster, no link, and texts sent in proportion to rows.
    Every tenth has a copy with a changed word, so links must still be found among them."""
    rng, vocab = random.Random(6), vocabulary(20_000, seed=7)
    template = sentence(rng, 62, vocab).split()
    rows = [(i, " ".join(template + rng.sample(vocab, 32)), "en", "s", 0) for i in range(4_500)]
    for i in range(0, 4_500, 9):
        words = rows[i][1].split()
        words[-2] = "changed"
        rows.append((10_000 + i, " ".join(words), "en", "s", 0))
    sent, linked = [], near_dup._linked

    def counted(rows, keys, k, percent):
        sent.append(rows.count())
        return linked(rows, keys, k, percent)

    monkeypatch.setattr(near_dup, "_linked", counted)
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(8), 3, 85).collect()}
    assert got == {i: i % 10_000 if i >= 10_000 else i for i, *_ in rows}
    assert sent[0] > 4_900 and sum(sent) < 3 * len(rows)


def test_near_duplicates_finds_the_links_there_are(spark):
    """Of 600 pairs around the threshold, all links that exact sets have are found."""
    rng, vocab = random.Random(12), vocabulary(30_000, seed=8)
    rows = []
    for i in range(600):
        words = rng.sample(vocab, 160)
        other = list(words)
        for at in rng.sample(range(0, 156, 4), rng.randint(3, 6)):
            other[at] = rng.choice(vocab)
        rows += [(2 * i, " ".join(words), "en", "s", 0), (2 * i + 1, " ".join(other), "en", "s", 0)]
    sets = {r[0]: word_set(r[1], 3) for r in rows}
    there = {i for i in range(600) if 100 * len(sets[2 * i] & sets[2 * i + 1]) >= 80 * len(sets[2 * i] | sets[2 * i + 1])}
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, DOCS), 3, 80).collect()}
    found = {i for i in range(600) if got[2 * i + 1] == 2 * i}
    assert 100 < len(there) < 600 and found <= there and len(found) >= 0.999 * len(there)


def test_near_duplicates_odd_rows(spark):
    """A null doc_id is in no group, whatever its text; extra columns with clashing names are ignored; repeated rows stay."""
    text = "a b c d e f g h"
    docs = spark.createDataFrame([(None, text, "en", "s", 1), (5, text, "en", "s", 1), (7, text.upper(), "en", "s", 1), (7, text.upper(), "en", "s", 1), (9, None, "en", "s", 1)], DOCS)
    for name in ("label", "rep", "n", "bands", "component_id", "key"):
        docs = docs.withColumn(name, F.lit("clash"))
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(docs, 3, 85).collect())
    assert got == [(0, 6, None, True), (5, 6, 5, True), (7, 6, 5, False), (7, 6, 5, False), (9, 0, 9, True)]
    kept = near_dup.stage(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 5, 9]


def test_setsketch_estimates():
    rng = np.random.default_rng(0)
    for share in (0.3, 0.85, 0.97):
        a = rng.integers(0, 2**63, 2000).astype(np.uint64)
        m = int(2000 * 2 * share / (1 + share))
        b = np.concatenate([a[:m], rng.integers(0, 2**63, 2000 - m).astype(np.uint64)])
        ra, rb = near_dup.registers(a), near_dup.registers(b)
        assert (near_dup.registers(np.concatenate([a, b])) == np.maximum(ra, rb)).all()  # sketches merge
        assert near_dup.plausible(ra, rb[None], 2000, np.array([2000]), 0.85)[0] == (share > 0.5)


def test_near_duplicates_empty(spark):
    assert near_dup.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    one = near_dup.near_duplicates(spark.createDataFrame([(None, "a b c d e f", "en", "s", 1), (3, None, None, None, None), (4, "x y", "en", "s", 1), (4, "x y", "en", "s", 1)], DOCS)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in one) == [(False, 3, 0, 3, True), (False, 4, 1, 4, True), (False, 4, 1, 4, True), (True, 0, 2, None, True)]


def test_suffix_repeats(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SORT_ROWS", 50)  # many ranges, so that equal keys lie across their ends
    rows = corpus(seed=9, n=24)
    texts = {r[0]: (r[1] or "").encode().lower().split() for r in rows}
    seen = Counter(tuple(w[i : i + 50]) for w in texts.values() for i in range(len(w) - 49))
    expected = {}
    for i, w in texts.items():
        if covered := {p for a in range(len(w) - 49) if seen[tuple(w[a : a + 50])] > 1 for p in range(a, a + 50)}:
            expected[i] = covered
    got = {r["doc_id"]: r for r in suffix_dedup.repeats(spark.createDataFrame(rows, DOCS)).collect()}
    assert {i: {p for s in r["spans"] for p in range(s["start"], s["end"])} for i, r in got.items()} == expected
    assert all(r["repeated_words"] == len(expected[i]) and r["n_words"] == len(texts[i]) for i, r in got.items())
    assert suffix_dedup.repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_suffix_repeats_of_repeated_rows_and_ties(spark):
    """A row that occurs twice repeats nothing; a text of one word over and over repeats itself at every place; clashing columns are ignored."""
    rng, vocab = random.Random(2), vocabulary()
    one, tie = sentence(rng, 80, vocab), " ".join(["same"] * 130)
    docs = spark.createDataFrame([(1, one, "en", "s", 0)] * 2 + [(2, tie, "en", "s", 0)] * 3 + [(3, sentence(rng, 5000, vocab), "en", "s", 0), (None, one, "en", "s", 0)], DOCS)
    for name in ("key", "at", "rep", "edge", "places", "n_words"):
        docs = docs.withColumn(name, F.lit("clash"))
    assert [(r["doc_id"], r["repeated_words"], [tuple(s) for s in r["spans"]]) for r in suffix_dedup.repeats(docs).collect()] == [(2, 130, [(0, 130)])]


def test_suffix_order_is_that_of_letters():
    words = [b"b", b"a", b"\xc3\xa9t\xc3\xa9", b"ab", b"a" * 40, b"z"]
    heads = suffix_dedup.beginnings(words, np.arange(len(words)))
    assert heads.argsort(kind="stable").tolist() == sorted(range(len(words)), key=lambda i: b" ".join(words[i:])[:8].ljust(8, b"\0"))
    assert not len(suffix_dedup.beginnings([], np.zeros(0, np.int64)))


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def test_decontamination(spark):
    rng, vocab = random.Random(2), [*vocabulary(60), "ÉTÉ", "Über", "ΑΣ"]
    items = [(i, sentence(rng, n, vocab)) for i, n in enumerate([30, 12, 10, 9, 3, 2, 1, 25])] + [(8, None), (9, "..."), (None, sentence(rng, 11, vocab)), (10, "Same item here, twice over and over again in the test"), (11, "same ITEM here twice over and over again in the test")]
    texts = [sentence(rng, 80, vocab) for _ in range(10)] + [f"{sentence(rng, 9, vocab)}. {(items[i][1] or '').upper()}! {sentence(rng, 9, vocab)}" for i in range(len(items))] + [None, "", items[6][1], items[11][1], items[0][1] + " " + items[0][1], " ".join(items[0][1].split()[5:17])]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(0, texts[0], "en", "s", 0), (None, items[1][1], "en", "s", 0)]
    wins = defaultdict(set)
    for i, t in items:
        w = item_words(t)
        for a in range(max(1, len(w) - 9) if w else 0):
            wins[tuple(w[a : a + 10])].add(i)
    expected = []
    for r in rows:
        w, hit, found = item_words(r[1]), set(), set()
        for win, owners in wins.items():
            for a in range(len(w) - len(win) + 1):
                if tuple(w[a : a + len(win)]) == win:
                    hit |= set(range(a, a + len(win)))
                    found |= owners
        ids = sorted(str(x) for x in found if x is not None)
        expected.append((r[0] is None, r[0] or 0, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    docs = spark.createDataFrame(rows, DOCS).withColumn("item_id", F.lit("clash")).withColumn("window", F.lit(1))
    out = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string"))
    got = [(r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in out.collect()]
    assert sorted(got) == sorted(expected)
    clean = decontaminate.contamination(docs, spark.createDataFrame([], "item_id long, text string")).collect()
    assert len(clean) == len(rows) and not any(r["contaminated"] for r in clean)
    assert decontaminate.contamination(spark.createDataFrame([], DOCS), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_decontamination_above_the_broadcast_bound(spark, monkeypatch):
    """Where no side may be broadcast, positions travel with the words around them: the same rows, also at both ends of long texts."""
    rng, vocab = random.Random(12), vocabulary(80)
    items = [(i, sentence(rng, n, vocab)) for i, n in enumerate([30, 10, 9, 3, 2, 1, 14])]
    texts = [sentence(rng, 60, vocab) for _ in range(6)] + [f"{items[i][1]} {sentence(rng, 20, vocab)} {items[i][1]}" for i in range(len(items))] + [sentence(rng, 20_000, vocab) + " " + items[0][1], None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    run = lambda: sorted((r["doc_id"], r["n_hit"], r["items_sha256"], [tuple(x) for x in r["hit_windows"] or []]) for r in decontaminate.contamination(docs, bench).collect())
    expected = run()
    assert sum(n > 0 for _, n, *_ in expected) >= 8
    monkeypatch.setattr("quillstone.llm.shared.BROADCAST_ROWS", 0)
    assert run() == expected


def test_line_dedup(spark):
    rng, vocab = random.Random(4), vocabulary()
    common = [sentence(rng, 5, vocab) for _ in range(6)]
    rows = []
    for i in range(150):
        ls = [sentence(rng, 6, vocab) for _ in range(3)] + [c for j, c in enumerate(common) if rng.random() < 0.15 * (j + 1)] + [""]
        rng.shuffle(ls)
        rows.append((i, "\n".join(ls), "en", f"s{i % 12}" if i % 3 else "hot", 0))
    rows += [(500, None, "en", "s1", 0), (501, "", "en", "s1", 0), (502, common[5] + "\n\n" + common[5], "en", None, 0), (503, "\n\n", "en", "s1", 0), (504, common[4], "en", "s9", 0)]
    nameless = (None, "own line of a nameless text\n" + common[4] + "\n" + common[5], "en", "s3", 0)
    sites, first = defaultdict(set), {}
    for d, text, _, site, _ in sorted(rows, key=lambda r: r[0]):
        for p, line in enumerate((text or "").split("\n")):
            if line.strip(" "):
                first.setdefault(line.strip(" "), (d, p))
                sites[line.strip(" ")] |= {site} - {None}
    docs = spark.createDataFrame(rows, DOCS).withColumn("line", F.lit("clash")).withColumn("h", F.lit(0))
    got = {r["doc_id"]: r for r in line_dedup.cleaned(docs).collect()}
    for d, text, *_ in rows:
        ls = text.split("\n") if text is not None else []
        kept = [x for p, x in enumerate(ls) if not (x.strip(" ") and len(sites[x.strip(" ")]) >= line_dedup.MIN_SITES and first[x.strip(" ")] != (d, p))]
        assert (got[d]["q_text"], got[d]["q_lines"], got[d]["q_removed"]) == ("\n".join(kept) if text is not None else None, len(ls), len(ls) - len(kept))
    assert sum(r["q_removed"] for r in got.values()) > 50
    repeated = {r["doc_id"]: r["q_text"] for r in line_dedup.cleaned(docs.union(docs.where("doc_id < 30"))).collect()}
    assert {d: repeated[d] for d in got} == {d: r["q_text"] for d, r in got.items()} and line_dedup.cleaned(docs.union(docs.where("doc_id < 30"))).count() == len(rows) + 30
    long = "\n".join(f"line {i}" for i in range(30_000))
    whole = line_dedup.cleaned(docs.limit(0).union(spark.createDataFrame([(1, long, "en", "s", 0), (None, long, "en", "t", 0)], DOCS).withColumn("line", F.lit("")).withColumn("h", F.lit(0)))).collect()
    assert [r["q_text"] for r in whole] == [long, long]
    after = line_dedup.cleaned(docs.union(spark.createDataFrame([(*nameless[:4], nameless[4], "clash", 0)], docs.schema))).where("doc_id IS NULL").collect()
    assert len(after) == 1 and after[0]["q_text"].startswith("own line") and after[0]["q_lines"] == 3  # a null id comes first: its lines are first occurrences
    stage = line_dedup.stage(spark, docs, "")
    assert stage.columns == docs.columns and {r["doc_id"] for r in stage.collect()} == {d for d, text, *_ in rows if got[d]["q_removed"] == 0 or got[d]["q_text"].strip()}
    assert line_dedup.cleaned(spark.createDataFrame([], DOCS)).count() == 0


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, None, "s", 0), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, "123 !!", "en", "s", 0), (10**6 + 3, "x", None, None, None), (None, "und die der", "de", "s", 0), (10**6 + 4, "the and " * 20000, None, "s", 0)], DOCS)
    both = docs.unionByName(odd)
    got = lang_hd.predict(both, lang_hd.train(both), keep=["doc_id", "lang"]).collect()
    assert len(got) == both.count()
    by = {r["doc_id"]: r for r in got}
    assert [by[10**6 + i]["lang_pred"] for i in range(3)] == ["und"] * 3 and by[10**6]["score"] == 0 and by[None]["lang_pred"] == "de" and by[10**6 + 4]["lang_pred"] == "en"
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 10**6 and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(held) > 200 and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    none = lang_hd.predict(odd, lang_hd.train(odd.where("false"))).collect()
    assert {r["lang_pred"] for r in none} == {"und"}
    kept = lang_hd.stage(spark, both.withColumn("score", F.lit("clash")), "")
    assert kept.count() == both.count() - 3 and kept.columns == [*both.columns, "score"]


def test_language_stage_follows_the_model(spark):
    """Texts of a language that was not learned go, whatever their column lang says; with a model that knows it they stay."""
    rng = random.Random(4)
    greek, latin = "αβγδεζηθικλμνξοπρστυφχψω", vocabulary(60, seed=2)
    words = ["".join(rng.choice(greek) for _ in range(rng.randint(3, 8))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(latin) for _ in range(80)), "la", "s", 0) for i in range(60)] + [(100 + i, " ".join(rng.choice(words) for _ in range(80)), None, "s", 0) for i in range(20)] + [(200, words[0], None, "s", 0), (201, "12 !", "la", "s", 0), (202, None, None, "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    assert sorted(r["doc_id"] for r in lang_hd.stage(spark, docs, "").collect()) == [*range(60), 200]  # one word is too little to reject
    both = docs.withColumn("lang", F.when((F.col("doc_id") >= 100) & (F.col("doc_id") < 110), "gr").otherwise(F.col("lang")))
    assert sorted(r["doc_id"] for r in lang_hd.stage(spark, both, "").collect()) == [*range(60), *range(100, 120), 200]
    unknown = (docs.withColumn("lang", F.lit(None).cast("string")))
    assert lang_hd.stage(spark, unknown, "").count() == len(rows) - 2


def test_language_ties_repeats_and_bundles_by_hand(spark):
    """Prediction against a plain version, gram by gram; equal prototypes tie by name; repeated rows teach once and each get a row."""
    rng, vocab = random.Random(5), vocabulary(40, seed=3)
    rows = [(i, sentence(rng, 30, vocab), "bb" if i % 2 else "aa", "s", 0) for i in range(40)]
    docs = spark.createDataFrame(rows + rows[:5], DOCS).withColumn("lang_pred", F.lit("clash"))
    langs, matrix = lang_hd.train(docs)

    def plain(text):
        codes = [32, *(ord(c) if c.isalpha() else 32 for c in text.lower()), 32]
        total = np.zeros(lang_hd.DIM)
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            total += lang_hd._letter_vector(a).astype(float) * np.roll(lang_hd._letter_vector(b), 1) * np.roll(lang_hd._letter_vector(c), 2)
        return total / np.linalg.norm(total)

    taught = {}
    for i, t, lang, *_ in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            taught[lang] = taught.get(lang, 0) + plain(t)
    expected = np.array([taught[x] / np.linalg.norm(taught[x]) for x in langs])
    assert langs == ["aa", "bb"] and np.abs(expected - matrix).max() < 1e-4
    got = lang_hd.predict(docs, (langs, matrix)).collect()
    assert len(got) == len(rows) + 5
    by = {r["doc_id"]: r for r in got}
    for i, t, *_ in rows:
        cos = expected @ plain(t)
        assert by[i]["score"] == pytest.approx(max(0, cos.max()), abs=1e-3) and (abs(cos[0] - cos[1]) < 1e-3 or by[i]["lang_pred"] == langs[int(cos.argmax())])
    tied = lang_hd.predict(docs, (["x", "y"], np.stack([matrix[0], matrix[0]]))).collect()
    assert {r["lang_pred"] for r in tied} == {"x"} and lang_hd.predict(docs.limit(0), (langs, matrix)).count() == 0


def test_language_never_learns_from_held_out_rows(spark):
    docs = spark.createDataFrame([(i, "aaa bbb", "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else "yy", "s", 0) for i in range(50)], DOCS)
    assert lang_hd.train(docs)[0] == ["yy"]


def test_quality(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    odd = spark.createDataFrame([(10**6, None, None, "s", 0), (10**6 + 1, "", "en", "s", 0), (None, "word " * 30000, None, None, None)], DOCS)
    model = quality_cnn.train(docs, labels, rows=300)
    held = labels.where(lang_hd.held_out(F.col("doc_id"))).withColumnRenamed("quality", "truth")
    got = quality_cnn.score(docs.join(held, "doc_id").unionByName(odd, allowMissingColumns=True), model).join(held, "doc_id", "left").collect()
    assert all(0 <= r["score"] <= 1 for r in got) and len(got) == held.count() + 3
    good, bad = ([r["score"] for r in got if r["truth"] == t] for t in (1, 0))
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert auc > 0.9
    assert quality_cnn.train(docs, labels.where("quality = 1")) == {"rate": 1.0}
    assert quality_cnn.train(docs, labels.where("false")) == {"rate": 0.5}


def test_quality_network_window_by_window(spark):
    """The score against a plain version that goes window by window; odd rows get rows, an empty table none."""
    model = {k: v.astype(np.float64) for k, v in quality_cnn.start(2).items()}

    def plain(data):
        tops = []
        for chunk in quality_cnn.chunks(data):
            best = [0.0] * quality_cnn.FILTERS
            for lo in range(0, len(chunk) - quality_cnn.WIDTH + 1, quality_cnn.STRIDE):
                x = [v for b in chunk[lo : lo + quality_cnn.WIDTH] for v in model["embed"][b]]
                for f in range(quality_cnn.FILTERS):
                    best[f] = max(best[f], sum(a * w for a, w in zip(x, model["filters"][:, f])) + model["shift"][f])
            tops.append(best)
        pooled = np.array(tops)
        return 1 / (1 + np.exp(-float(np.concatenate([pooled.max(0), pooled.mean(0)]) @ model["out"] + model["bias"][0])))

    texts = ["short", "x" * 300, "bytes é 日本 " * 400, "", None]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(0, "short", "en", "s", 0)], DOCS).withColumn("score", F.lit("clash"))
    got = quality_cnn.score(docs, model).collect()
    assert len(got) == len(texts) + 1 and quality_cnn.score(docs.limit(0), model).count() == 0
    for r in got:
        assert r["score"] == pytest.approx(plain((texts[r["doc_id"]] or "").encode()), abs=1e-9)


def test_quality_sample_is_bounded_before_the_driver(spark, monkeypatch):
    """Rows of repeated doc_ids count once, and what is collected stays within the bounds on rows and bytes."""
    rows = [(i, f"text number {i} " * 20, "en", "s", 0) for i in range(200)]
    docs = spark.createDataFrame(rows * 3 + [(500, "long " * 100_000, "en", "s", 0)], DOCS).withColumn("quality", F.lit("clash"))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(500, 1, 0), (3, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(quality_cnn, "fit", lambda texts, ys, rate: seen.append((texts, ys)) or {"rate": rate})
    quality_cnn.train(docs, labels, rows=30)
    texts, ys = seen.pop()
    assert 30 <= len(texts) <= 60 and len(set(texts)) == len(texts) and 0 < sum(ys) < len(ys)
    monkeypatch.setattr(quality_cnn, "TRAIN_BYTES", 2_000)
    quality_cnn.train(docs, labels, rows=30)
    texts, ys = seen.pop()
    assert all(sum(len(t) for t, y in zip(texts, ys) if y == label) <= 2_000 for label in (0, 1))


def test_quality_chunks_cover_whole_texts():
    for n in (0, 1, 15, 16, 17, 4095, 4096, 4097, 9000):
        data = bytes(i % 251 for i in range(n))
        covered = sum(len(c) for c in quality_cnn.chunks(data)) - 16 * (len(quality_cnn.chunks(data)) - 1)
        assert covered >= n
    model, text = quality_cnn.start(), b"a" * 9000
    assert quality_cnn.forward(model, text)[0] != quality_cnn.forward(model, text[:-1] + b"Z" * 60)[0]


def test_quality_texts_together_are_those_one_by_one():
    model = {k: v.astype(np.float64) for k, v in quality_cnn.start(3).items()}
    rng = random.Random(1)
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 15, 16, 17, 300, 4096, 9001)]
    logits, state = quality_cnn.forward_all(model, texts)
    errors = np.array([rng.uniform(-1, 1) for _ in texts])
    got = quality_cnn.gradients_all(model, state, errors)
    expected = {k: np.zeros_like(v) for k, v in model.items()}
    for t, logit, error in zip(texts, logits, errors):
        one, kept = quality_cnn.forward(model, t)
        assert one == pytest.approx(logit, abs=1e-9)
        quality_cnn.gradients(model, kept, error, expected)
    assert all(np.allclose(got[k], expected[k], atol=1e-9) for k in model)


def test_quality_gradient():
    model = quality_cnn.start(1)
    model = {k: v.astype(np.float64) for k, v in model.items()}
    text = bytes(range(30, 130)) * 60
    logit, state = quality_cnn.forward(model, text)
    grads = {k: np.zeros_like(v) for k, v in model.items()}
    quality_cnn.gradients(model, state, 1.0, grads)
    for key, at in (("filters", (3, 5)), ("embed", (60, 2)), ("out", (4,)), ("shift", (7,))):
        moved = {k: v.copy() for k, v in model.items()}
        moved[key][at] += 1e-6
        assert (quality_cnn.forward(moved, text)[0] - logit) / 1e-6 == pytest.approx(grads[key][at], rel=1e-3, abs=1e-5)


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = corpus() + [(900, "the <|endoftext|> end", None, None, 0), (901, "日本語 text 😀", None, None, 0), (902, "tail  \n\n  spaces \t", None, None, 0), (None, "null id", None, None, 0)]
    out = packing.pack(spark.createDataFrame(rows, DOCS)).collect()
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in out:
        docs[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append(r)
    assert docs.keys() == {r[0] for r in rows}
    for i, text, *_ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        pieces = sorted(docs[i], key=lambda r: r["start"])
        assert b"".join(p["ids"] for p in pieces) == ids.tobytes() and all(p["doc_tokens"] == len(ids) for p in pieces)
        at = 0
        for p in pieces:
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
    for pieces in seqs.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == 2048 or at & (at - 1) == 0
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


def test_packing_of_repeated_rows_and_clashing_columns(spark):
    """Each row is packed, repeated ones too; columns named as the operator's own are ignored."""
    docs = spark.createDataFrame([(1, "same words here", "en", "s", 0)] * 3 + [(2, "ids " * 3000, "en", "s", 0), (None, None, None, None, None)], DOCS)
    for name in ("n", "ids", "start", "sequence_id", "offset", "length", "doc_tokens"):
        docs = docs.withColumn(name, F.lit("clash"))
    out = packing.pack(docs).collect()
    assert sum(r["doc_id"] == 1 and r["start"] == 0 for r in out) == 3
    of = {r["doc_id"]: r["doc_tokens"] for r in out}
    assert of[None] == 1 and sum(r["length"] for r in out) == 3 * of[1] + of[2] + 1


def test_hilbert_curve_is_continuous_and_complete():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.array(np.meshgrid(*[range(1 << bits)] * dims)).reshape(dims, -1).T
        keys = packing.hilbert_key(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[keys.argsort()], axis=0)).sum(1) == 1).all()


def test_audio_round_trip(spark):
    texts = [None, "", "a", "x" * 575, "x" * 576, "x" * 577, "é" * 5000, "ÿû" * 900, None, "a"]
    rows = [(i if i else None, t, "en", "s", 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("media", F.lit("clash"))
    got = {r["doc_id"]: r for r in media_audio.digest_audio(media_audio.encode_texts(docs)).collect()}
    for i, text, *_ in rows:
        raw = (text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert got[2]["media_sha256"] == got[9]["media_sha256"] and got[None]["feature"] == got[1]["feature"]


def test_audio_resynchronises():
    rng = np.random.default_rng(3)
    payload = b"".join(rng.choice([b"\xff\xf2\xd8\xc4", b"\xff\xff\xff\xff", b"abcd"]) for _ in range(144 * 40))  # sync words all over
    media = media_audio.payload_frames(payload, len(payload))
    index = media_audio.index_stream(media)
    assert media_audio.payload_of(media, index) == payload and index["frames"] == 40 and index["bad"] == 0 == index["skipped"]
    assert index["samples"] / index["rate"] == 40 * 576 / 16000 and index["vbr"]["frames"] == 40 and index["tags"] == {"unpadded_bytes": str(len(payload))}
    start = int(index["offsets"][0])
    broken = media[: start + 648 * 10] + b"junk\xff\xf2" * 7 + media[start + 648 * 10 :] + b"TAG" + b"Title".ljust(125, b"\0")
    again = media_audio.index_stream(broken)
    assert again["frames"] == 40 and again["skipped"] == 42 and again["tags"]["title"] == "Title"
    damaged = bytearray(media)
    damaged[start + 648 * 5 + 8] ^= 1  # in the side information, which the checksum covers
    after = media_audio.index_stream(bytes(damaged))
    assert after["bad"] >= 1 and after["frames"] == 39 and set(index["offsets"]) - set(after["offsets"]) == {start + 648 * 5}
    assert media_audio.index_stream(b"")["frames"] == 0 == media_audio.index_stream(b"\xff" * 999)["frames"]


def test_audio_headers():
    assert media_audio.header(b"\xff\xfb\x90\x00") == {"version": 3, "layer": 3, "kbps": 128, "rate": 44100, "samples": 1152, "length": 417, "mono": False, "side": 32, "protected": False, "bound": 32}
    assert media_audio.header(b"\xff\xfb\xf0\x00") is None and media_audio.header(b"\xff\xe2") is None
    frames = b"".join(h + bytes(media_audio.header(h)["length"] - 4) for h in (b"\xff\xfb\x90\x00", b"\xff\xfb\x92\x00", b"\xff\xfb\xb0\x00") * 3)  # padding and bitrates vary
    index = media_audio.index_stream(frames)
    assert index["frames"] == 9 and index["kbps"] == [128, 192] and index["skipped"] == 0


def test_audio_index_of_long_streams_is_linear():
    """44.1 kHz frames whose padding bit alternates change their header at every frame; 100,000 of them take under two seconds."""
    import time

    plain, wide = (h + bytes(media_audio.header(h)["length"] - 4) for h in (b"\xff\xfb\x90\x00", b"\xff\xfb\x92\x00"))
    media = (plain + wide) * 50_000
    began = time.process_time()
    index = media_audio.index_stream(media)
    assert time.process_time() - began < 6 and index["frames"] == 100_000 and index["skipped"] == 0
    assert index["seconds"] == pytest.approx(100_000 * 1152 / 44100, abs=1e-9) and index["offsets"][1] == len(plain)


def test_audio_index_of_damaged_streams_is_linear():
    """Forty thousand protected frames with wrong checksums: each is looked at a few times, not as often as there are frames."""
    import time

    frame = bytearray(media_audio.payload_frames(b"q" * 576, 576)[-648:])
    frame[8] ^= 1
    began = time.process_time()
    index = media_audio.index_stream(bytes(frame) * 40_000)
    assert time.process_time() - began < 60 and index["bad"] >= 40_000 - 1 and index["frames"] < 5


def test_audio_rate_changes_within_a_stream():
    frames = {h: h + bytes(media_audio.header(h)["length"] - 4) for h in (b"\xff\xfb\x90\x00", b"\xff\xfb\x94\x00")}
    a, b = frames.values()
    index = media_audio.index_stream(a * 10 + b * 20)
    assert index["frames"] == 30 and index["skipped"] == 0 and index["seconds"] == pytest.approx(10 * 1152 / 44100 + 20 * 1152 / 48000)


def test_audio_tags_of_all_versions():
    size = lambda n: bytes(n >> s & 0x7F for s in (21, 14, 7, 0))
    body = b"TT2" + (6).to_bytes(3, "big") + b"\0Title"
    assert media_audio.id3v2(b"ID3\x02\0\0" + size(len(body)) + body) == (10 + len(body), {"TT2": "Title"})
    raw = "\ufeffé".encode("utf-16-le")
    frame = b"TIT2" + (len(raw) + 1).to_bytes(4, "big") + b"\0\0\x01" + raw
    sent = frame.replace(b"\xff", b"\xff\x00")
    assert media_audio.id3v2(b"ID3\x03\0\x80" + size(len(sent)) + sent)[1] == {"TIT2": "é"}
    extended = (6).to_bytes(4, "big") + bytes(6) + b"TIT2" + (2).to_bytes(4, "big") + b"\0\0\0x"
    assert media_audio.id3v2(b"ID3\x03\0\x40" + size(len(extended)) + extended)[1] == {"TIT2": "x"}


@pytest.mark.parametrize(("second", "third", "fourth"), [(0xFC, 0xA0, 0x00), (0xFC, 0xA0, 0x50), (0xFC, 0x40, 0xC0), (0xFC, 0x24, 0x00), (0xF4, 0x80, 0x40), (0xFC, 0x18, 0xC0)])
def test_audio_checksums_of_layer_two(second, third, fourth):
    """Frames with random allocations, checked bit by bit in a plain version; a bit changed in what the checksum covers is found."""
    rng = random.Random(second + third + fourth)
    head = bytes([0xFF, second, third, fourth])
    h = media_audio.header(head)
    per = h["kbps"] // (1 if h["mono"] else 2)
    key = "low" if h["version"] != 3 else ("d" if h["rate"] == 32000 else "c") if per < 56 else "a" if h["rate"] == 48000 or per <= 80 else "b"
    frames, covered = [], []
    for _ in range(12):
        body = "".join(rng.choice("0001") for _ in range(8 * (h["length"] - 6)))
        at = n = 0
        for band, width in enumerate(media_audio._ALLOCATION[key]):
            fields = 1 if h["mono"] or band >= h["bound"] else 2
            for _ in range(fields):
                if "1" in body[at : at + width]:
                    n += 2 * (1 if h["mono"] or fields == 2 else 2)
                at += width
        stream = "".join(f"{b:08b}" for b in head[2:]) + body[: at + n]
        crc = 0xFFFF
        for bit in stream:
            high = crc >> 15 ^ int(bit)
            crc = (crc << 1 & 0xFFFF) ^ (0x8005 if high else 0)
        frames.append(head + crc.to_bytes(2, "big") + int(body, 2).to_bytes(len(body) // 8, "big"))
        covered.append(at + n)
    assert h["layer"] == 2 and h["protected"]
    media = b"".join(frames)
    index = media_audio.index_stream(media)
    assert (index["frames"], index["checked"], index["bad"]) == (12, 12, 0)
    damaged = bytearray(media)
    damaged[5 * h["length"] + 6 + (covered[5] - 1) // 8] ^= 0x80 >> (covered[5] - 1) % 8
    assert media_audio.index_stream(bytes(damaged))["frames"] < 12


def test_audio_of_an_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert media_audio.digest_audio(media_audio.encode_texts(empty)).count() == 0 == media_audio.index_audio(media_audio.encode_texts(empty)).count()


def test_audio_index_of_a_table(spark):
    media = media_audio.payload_frames(b"z" * 576 * 3, 1728)
    rows = media_audio.index_audio(spark.createDataFrame([(1, bytearray(media)), (2, None)], "doc_id long, media binary")).collect()
    one = next(r for r in rows if r["doc_id"] == 1)
    assert one["frames"] == 3 and one["seconds"] == 3 * 576 / 16000 and len(one["seek_offsets"]) == 3 and one["tags"] == {"unpadded_bytes": "1728"}


PAGES = [
    ("<html><head><title>t</title></head><body><nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>One\n two<br>three<p>Four</article><footer>f</footer></body></html>", "A & B\nOne two three\nFour"),
    ("<div class='site-header'>Logo</div><div id=content><h1>T</h1><p>Hello <b>big</b> world</p><aside>side</aside><form>f<input></form><div class=comments><p>nasty</div><p>End</div><div class='cookie-notice'>We use</div>", "T\nHello big world\nEnd"),
    (None, ""), ("", ""), ("<p>", ""), ("plain &lt;text&gt;", "plain <text>"), ("<article><p>a<script>var x='</p>';</script>b</p><!-- <p>no</p> --></article>", "ab"), ("<article>x<div class='ad'><div>buy</div></div><p>y</article>", "x\ny"),
    ("<div class='with-sidebar ad-free-content'><h1>H</h1><p>P</p><div class='entry-footer'>tags</div><div id='post-comments'>c</div><div class='sidebarLeft'>s</div></div><div class='wrap'>w</div>", "H\nP"),
    ("<body class='has-menu'><div class='page-header'>x</div><div class='entry-content'><div class='entry-header'>Title</div><p>Body</p></div><ul><li>after</ul></body>", "Title\nBody"),
    ("<main><ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table></main>", "one\ntwo\nc1\nc2"), ("<article><header><h1>Title</h1></header><p style='display:none'>hid</p><p>&nbsp; x&#160;y </p></article>", "Title\nx y"),
]


def test_html_main_text(spark):
    rows = [(i, f"u{i}", page) for i, (page, _) in enumerate(PAGES)] + [(0, None, PAGES[0][0]), (None, "u", None)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    assert len(got) == len(rows)
    for r in got:
        expected = PAGES[r["page_id"]][1] if r["page_id"] is not None else ""
        assert (r["page_id"], r["text"], r["n_chars"]) == (r["page_id"], expected, len(expected))
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_long_page_is_whole():
    page = "<article>" + "".join(f"<p>Paragraph number {i}.</p>" for i in range(5000)) + "</article>"
    assert html_text.main_text(page) == "\n".join(f"Paragraph number {i}." for i in range(5000))


def test_html_unmarked_page_keeps_short_spans():
    """No article is marked: adverts split the text, and what stands after or between them is short beside the rest."""
    long, closing, link = "Long words. " * 70, "A closing paragraph of some twenty words stands here.", "<p>See <a href='x'>the full report of the committee</a></p>"
    menu = "".join(f"<div><a href='{i}'>Entry {i}</a></div>" for i in range(5))
    ad = "<div class='ad'>buy</div>"
    page = f"<body>{menu}<h1>Title</h1><p>{long}</p>{ad}<p>Short.</p>{ad}{link}<p>{long}</p>{ad}<p>{closing}</p><div><a href='y'>Top</a></div></body>"
    assert html_text.main_text(page) == "\n".join(["Title", long.strip(), "Short.", "See the full report of the committee", long.strip(), closing])
    assert html_text.main_text(f"<h1>Title</h1><p>{'x' * 800}</p>{ad}<p>{'y' * 100}</p>") == "\n".join(["Title", "x" * 800, "y" * 100])


@pytest.mark.parametrize("inner", ["<p class=promo>A</p>", "<p class='notice'>A</p>", "<blockquote class=comment>A</blockquote>", "<section id=discussion><p>A</p></section>", "<section id='related-work'><h2>A</h2></section>", "<form><p>A</p></form>", "<form action=x><input type=hidden><p>A</p></form>"])
def test_html_running_text_stays(inner):
    assert html_text.main_text(f"<article><h1>T</h1><p>Plain.</p>{inner}<p>End.</p></article>") == "T\nPlain.\nA\nEnd."


def test_html_furniture_within_a_page_of_a_blog():
    page = """<body class="home blog"><header class="site-header"><p>Logo</p></header><a class="skip-link" href="#c">Skip</a><div id="page"><main id="c"><article class="post">
      <header class="entry-header"><h1>Title &mdash; one</h1></header><div class="entry-content"><p>First <em>text</em>.</p><figure><img src=x><figcaption>A caption</figcaption></figure><blockquote>Quoted</blockquote>
      <div class="advert">buy</div><ul><li>one<li>two</ul><div class="share-buttons">Share</div><table class="data"><tr><td>c1<td>c2</table><pre>code  here</pre></div><footer class="entry-footer">Tags</footer></article>
      <section class="related-posts"><h2>More</h2></section><div id="comments" class="comments-area"><h2>2 thoughts</h2><ol class="comment-list"><li class="comment"><p>Nice</p></ol><div id="respond"><form><input><p>Leave a reply</p></form></div></div></main>
      <aside class="widget-area">Side</aside></div><div class="cookie-notice">We use cookies</div><footer>End</footer></body>"""
    assert html_text.main_text(page) == "Title — one\nFirst text.\nA caption\nQuoted\none\ntwo\nc1\nc2\ncode here"


def test_html_forms_and_bodies():
    form = "<form><p>Get our news</p><label>Mail</label><input><button>Go</button></form>"
    assert html_text.main_text(f"<article><h1>T</h1>{form}<div class=ad>b</div><ol class=comments><li>c</ol><p>End.</p></article>") == "T\nEnd."
    assert html_text.main_text("<article><p>Teaser</p></article><div class='post-body'><p>Body</p></div><div>no</div>") == "Teaser\nBody"
    whole = "x" * 300
    assert html_text.main_text(f"<form id=page><input name=q><div id=content><h1>T</h1><p>{whole}</p></div></form>") == "T\n" + whole


N = 40_000
HOSTILE = {
    "open tags": "<a " * N, "wrong ends": "<b>" * N + "</i>" * N, "cdata": "<![CDATA[" * N, "quotes": "<a b='\">" * N, "open quote": '<a b="' * N + ">", "paragraphs": "<b>" * N + "<p></p>" * N, "items": "<b>" * N + "<li>x" * N,
    "lists": "<ul>" * N + "</b>x" * N, "titles": "<title>" * N, "angles": "<" * 5 * N, "ampersands": "&" * 5 * N, "comments": "<!--" * N, "furniture": '<div class="ad">' * N, "forms": "<form><input>" * N + "</form>" * N, "spaces": "<a " + " " * 5 * N + ">x", "equals": "<a " + "=    " * N,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_html_hostile_pages_take_linear_time(name):
    """Twenty times the page may take forty times as long, not four hundred."""
    import time

    def took(page):
        began = time.process_time()
        html_text.main_text(page)
        return time.process_time() - began

    page = HOSTILE[name]
    small = page[: len(page) // 20] if "<p>" not in page and "</" not in page and "<li>" not in page else None
    whole = took(page)
    assert whole < 4 * len(page) / 1e6 + 1
    assert small is None or whole < 40 * max(took(small), 0.01)


def test_line_block_spans_against_brute_force():
    """Sums are those of the lines ahead; a span starts at a line that carries the surge and ends at the dive."""
    rng = random.Random(1)
    for _ in range(500):
        weight = [rng.choice((0, 0, 0, 5, 30, 90, 200)) for _ in range(rng.randint(0, 25))]
        running = [rng.random() < 0.3 for _ in weight]
        sums = [sum(weight[i : i + html_text.WINDOW]) for i in range(len(weight))]
        least = min(html_text.THRESHOLD, max(sums, default=0) / 2)
        inside, runs = set(), "".join("x" if s and s >= least else " " for s in sums)
        for m in re.finditer("x+", runs):
            starts = [i for i in range(*m.span()) if weight[i] and (running[i] or weight[i] >= least)]
            inside |= set(range(starts[0], m.end())) if starts else set()
        assert {i for a, b in html_text.spans(weight, running) for i in range(a, b)} == inside
    assert html_text.spans([], []) == [] and html_text.spans([0, 0], [True, True]) == [] and html_text.spans([3], [False]) == [(0, 1)]


BODY = "".join(f"<p>Paragraph {i} of the story has a good many words in it, so that it is dense.</p>" for i in range(4))
BODY_TEXT = "\n".join(f"Paragraph {i} of the story has a good many words in it, so that it is dense." for i in range(4))


@pytest.mark.parametrize(
    ("before", "after", "text"),
    [
        ("<div><a>Home</a> | Contact us</div>", "<div>(c) 2020 Example Ltd. All rights reserved. Terms and privacy</div>", BODY_TEXT),
        ("<h1>Title</h1>", "<p>The end.</p><div>Example Ltd, Main Street</div>", f"Title\n{BODY_TEXT}\nThe end."),
        ("", "<p><a href=x>Read the whole report that this story rests on here</a></p>", f"{BODY_TEXT}\nRead the whole report that this story rests on here"),
        ("<p><a href=x>First of all, read what was said before</a></p>", "<div><a href=y>Top</a></div>", f"First of all, read what was said before\n{BODY_TEXT}"),
        ("<ul>" + "".join(f"<li><a href=x>A rather long entry of a menu, number {i}</a></li>" for i in range(8)) + "</ul>", "<p>Copyright 2021 by the makers of this page</p>", BODY_TEXT),
        ("".join(f"<p><a href=x>Link {i}</a></p>" for i in range(5)), "<div>Terms</div><div>Privacy</div><div>Imprint</div>", BODY_TEXT),
    ],
)
def test_html_density_decides_on_unmarked_pages(before, after, text, monkeypatch):
    page = f"<body>{before}{BODY}{after}</body>"
    assert html_text.main_text(page) == text
    monkeypatch.setattr(html_text, "spans", lambda weight, running: [(0, len(weight))] if weight else [])
    monkeypatch.setattr(html_text, "weights", lambda lines: [len(t) for t, *_ in lines])
    assert (html_text.main_text(page) == text) == (text.count("\n") + 1 == page.count("</p>") + page.count("</h1>") + page.count("</div>") + page.count("</li>"))


def test_html_density_without_paragraphs():
    """Text in boxes and cells alone: dense boxes stay, short ones around them go, short ones between them stay."""
    long = "Words of a story that stand in a box of their own, with no paragraph around them at all, as some pages have it."
    page = f"<div>Home</div><div>News</div><div>{long}</div><div>Figure 1</div><div>{long}</div><div>Contact</div>"
    assert html_text.main_text(page) == f"{long}\nFigure 1\n{long}"
    assert html_text.main_text("<div>no</div>") == "no" and html_text.main_text("<div><a href=x>only a link</a></div>") == ""


@pytest.mark.parametrize("name", ["class=social-history", "id=advertising", "class=menu-items"])
def test_html_names_in_an_article_must_consist_of_furniture(name):
    assert html_text.main_text(f"<article><h1>T</h1><div {name}><p>Plain.</p></div><div class='ad-slot'>b</div><div class='social share-buttons'>c</div></article>") == "T\nPlain."


def test_licences(spark):
    rows = [
        (1, "a/LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
        (2, "a/b/c/x.py", "print(1)"), (3, "a/b/LICENSE.txt", "Licensed under the Apache License, Version 2.0"), (4, "z/y.py", "x = 2"), (5, "a/b/c/y.py", "# SPDX-License-Identifier: GPL-3.0-or-later\ncode code code code"),
        (6, None, "Released under the MIT License."), (7, "a/q.py", None), (8, "a/r.py", ""), (9, "ab/r.py", "a licence of no known kind whatsoever, sold by someone"), (2, "a/b/c/x.py", "print(1)"), (None, "a/b/n.py", "n"), (11, "top.py", "t"),
    ]
    got = license_scan.scan(spark.createDataFrame(rows, "file_id long, path string, text string").withColumn("licence", F.lit("clash"))).collect()
    assert len(got) == len(rows)
    by = {r["file_id"]: (r["stated"], r["inherited"], r["inherited_from"], r["licence"], r["is_licence_file"]) for r in got}
    assert by == {
        1: ("MIT", None, None, "MIT", True), 2: (None, "Apache-2.0", "a/b", "Apache-2.0", False), 3: ("Apache-2.0", None, None, "Apache-2.0", True), 4: (None, None, None, None, False), 5: ("GPL", None, None, "GPL", False),
        6: ("MIT", None, None, "MIT", False), 7: (None, "MIT", "a", "MIT", False), 8: (None, "MIT", "a", "MIT", False), 9: (None, None, None, None, False), None: (None, "Apache-2.0", "a/b", "Apache-2.0", False), 11: (None, None, None, None, False),
    }
    assert license_scan.scan(spark.createDataFrame([], "file_id long, path string, text string")).count() == 0


NOTICES = {
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "LGPL": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.",
    "GPL": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:",
}


def test_licence_file_titles_ties_and_long_texts(spark):
    """Titles of licence files, a folder with two licence files, a text of two hundred thousand words, clashing columns."""
    lgpl = "                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n\n  This version of the GNU Lesser General Public License incorporates\nthe terms and conditions of version 3 of the GNU General Public\nLicense, supplemented by the additional permissions listed below."
    mpl = "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n--------------\n\n1.1. \"Contributor\"\n    means each individual or legal entity that creates, contributes to\n    the creation of, or owns Covered Software."
    rows = [("lgpl", "a/COPYING.LESSER", lgpl), ("mpl", "b/LICENSE", mpl), ("bsd", "c/LICENSE.md", "BSD 3-Clause License\n\nCopyright (c) 2020, A"), ("mit1", "d/LICENSE", "Released under the MIT License"), ("mit2", "d/LICENSE.apache", "Licensed under the Apache License, Version 2.0"), ("d", "d/x/y.c", "int x;"), ("long", "e/f.txt", "word " * 200_000), ("twice", "a/z.c", "int y;"), ("twice", "a/z.c", "int y;")]
    files = spark.createDataFrame(rows, "file_id string, path string, text string")
    for name in ("term", "digest", "folder", "stated", "segments", "template"):
        files = files.withColumn(name, F.lit("clash"))
    out = license_scan.scan(files).collect()
    got = {r["file_id"]: (r["stated"], r["inherited"]) for r in out}
    assert len(out) == len(rows) and got == {"lgpl": ("LGPL", None), "mpl": ("MPL-2.0", None), "bsd": ("BSD-3-Clause", None), "mit1": ("MIT", None), "mit2": ("Apache-2.0", None), "d": (None, "Apache-2.0"), "long": (None, None), "twice": (None, "LGPL")}


def test_wrapped_licence_notices(spark):
    """Standard notices wrap: as line comments, as a block comment without marks inside, and between lines of code."""
    code = "\n".join(f"value_{i} = compute({i}, other_{i})" for i in range(60))
    forms = {
        "line": lambda t: "#!/bin/sh\n# " + t.replace("\n", "\n# ") + "\n\n" + code,
        "block": lambda t: "/*\n" + t + "\n*/\n" + code,
        "inside": lambda t: code + "\n// " + t.replace("\n", "\n// ") + "\n" + code,
    }
    rows = [(f"{licence} {form}", f"a/b/{licence}.{form}", make(t)) for licence, t in NOTICES.items() for form, make in forms.items()]
    rows += [("top", "a/LICENSE", "Licensed under the Apache License, Version 2.0"), ("mit", "c/x.c", "/* Permission is\n * hereby granted, free of charge, to any person obtaining a copy of this\n * software and associated documentation files (the Software), to deal in\n * the Software without restriction */\n" + code)]
    rows += [("whole", "d/COPYING", NOTICES["MPL-2.0"]), ("under", "d/e.py", code)]
    got = {r["file_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "file_id string, path string, text string")).collect()}
    assert {k: r["stated"] for k, r in got.items()} == {f"{x} {form}": x for x in NOTICES for form in forms} | {"top": "Apache-2.0", "mit": "MIT", "whole": "MPL-2.0", "under": None}
    assert got["under"]["inherited"] == "MPL-2.0" and not got["MPL-2.0 line"]["is_licence_file"] and got["whole"]["is_licence_file"]


@pytest.mark.parametrize(("edge_rows", "hub"), [(1_000_000, 100_000), (20, 100_000), (20, 3)])
def test_components(spark, monkeypatch, edge_rows, hub):
    """Few edges a task force rounds of star contraction between the tasks, with and without hubs."""
    from quillstone.llm import shared
    monkeypatch.setattr(shared, "EDGE_ROWS", edge_rows)
    monkeypatch.setattr(shared, "HUB_EDGES", hub)
    components = shared.components

    rng = random.Random(8)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 30)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(5, 5), (7, 3), (3, 7), (None, 4), (900, 901)]
    parent = {x: x for p in pairs if None not in p and p[0] != p[1] for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a in parent and b in parent and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {x: find(x) for x in parent} and len(got) == len(parent)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


NEAR_MISSES = {
    "eupl": ("/*\n * Licensed under the EUPL, Version 1.2\n */\nint x;", "EUPL"), "mit style": ("// Code governed by an MIT-style license\nint x;", "MIT"),
    "agpl": ("# " + NOTICES["GPL"].replace("GNU General", "GNU Affero General").replace("\n", "\n# ") + "\nx = 1", "AGPL"),
    "agpl copying": ("                    GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.\n\n  13. Use with the GNU General Public License.\n", "AGPL"),
    "bsl": ("// SPDX-License-Identifier: BSL-1.0\nint x;", "BSL-1.0"), "zlib": ("// SPDX-License-Identifier: Zlib\nint x;", "Zlib"), "gpl plus": ("// SPDX-License-Identifier: GPL-2.0+\nint x;", "GPL"),
    "unknown id": ("// SPDX-License-Identifier: Foo-1.0\nint x;", None), "unknown style": ("// Use of this source code is governed by a Foo-style license that can be found in the LICENSE file.\nint x;", None),
    "unknown version": ("Licensed under the Foo License, Version 2.0", None), "apache 1": ("Licensed under the Apache License, Version 1.1", "Apache-1.1"), "bsd and rights": ("Copyright (c) 2020\nAll rights reserved.\n\nBSD 2-Clause License", "BSD-2-Clause"),
}


def test_licence_near_misses(spark):
    """Licences near one another are told apart, unknown ones state nothing, and a source file is no licence file for its header's sake."""
    rows = [(k, f"{k}/{'COPYING' if k == 'agpl copying' else 'x.c'}", text) for k, (text, _) in NEAR_MISSES.items()] + [(f"{k} below", f"{k}/d/y.c", "int y;") for k in NEAR_MISSES]
    got = {r["file_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "file_id string, path string, text string")).collect()}
    assert {k: got[k]["stated"] for k in NEAR_MISSES} == {k: v for k, (_, v) in NEAR_MISSES.items()}
    assert {k for k, r in got.items() if r["is_licence_file"]} == {"agpl copying"} and {k for k, r in got.items() if r["inherited"]} == {"agpl copying below"}


def test_licence_cosines_against_brute_force(spark):
    """Every template as a segment, whole, without its last word, and with two foreign words, against plain arithmetic."""
    import re
    from collections import Counter
    from math import log, sqrt

    cut = lambda t: Counter(re.findall(r"[a-z0-9][a-z0-9+.\-]*[a-z0-9+]|[a-z0-9]", t.lower()))
    made = [(licence, cut(text)) for licence, text in license_scan.TEMPLATES]
    n, df = len(made), Counter(w for _, c in made for w in c)
    held = {w: {re.sub("-[0-9].*$", "", licence) for licence, c in made if w in c} for w in df}
    idf = {w: log((1 + n) / (1 + d)) + 1 for w, d in df.items()}
    segments = [s for _, t in license_scan.TEMPLATES for s in (t, t.rsplit(" ", 1)[0], t + " unheard words")]
    want = {}
    for i, c in enumerate(map(cut, segments)):
        norm, best = sqrt(sum((k * idf.get(w, log((1 + n) / 2) + 1)) ** 2 for w, k in c.items())), {}
        for licence, t in made:
            own = [w for w in t if len(held[w]) == 1]
            size = lambda ws, t=t: sum((t[w] * idf[w]) ** 2 for w in ws)
            if size([w for w in own if w in c]) >= license_scan.NAMED * size(own) - 1e-6:
                best[licence] = max(best.get(licence, 0), sum(c[w] * k * idf[w] ** 2 for w, k in t.items()) / norm / sqrt(size(t)))
        ranked = sorted(((v, k) for k, v in best.items()), reverse=True) + [(0, "")]
        if ranked[0][0] >= license_scan.THRESHOLD and ranked[0][0] - ranked[1][0] >= license_scan.MARGIN:
            want[i] = (ranked[0][1], pytest.approx(ranked[0][0], abs=1e-5))
    rows = spark.createDataFrame(list(enumerate(segments)), "seg int, line string").select("seg", license_scan.terms(F.col("line")).alias("terms"))
    got = {r["seg"]: (r["licence"], r["cosine"]) for r in license_scan.stated(rows, ["seg"]).collect()}
    assert got == want and all(got[3 * i][0] == licence for i, (licence, _) in enumerate(license_scan.TEMPLATES) if 3 * i in got) and len([i for i in got if i % 3 == 0]) > 0.95 * n
