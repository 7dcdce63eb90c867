"""Many aliases in many texts, against a pattern for each."""

import random
import re

import pytest

from quillstone.operators import aliases


def plain(texts, table):
    out = set()
    for key, text in texts:
        for alias, value, turn in table:
            if alias and text and re.search(r"(?<!\w)" + re.escape(alias.lower()) + r"(?!\w)", text.lower()):
                out.add((key, alias, value, turn))
    return out


@pytest.mark.parametrize("most", [400_000, 0])
def test_occurrences_against_patterns(spark, monkeypatch, most):
    """Broadcast and dealt out: nested, overlapping, marked and repeated aliases, double spaces, letters and digits at the ends."""
    monkeypatch.setattr(aliases, "BROADCAST_ROWS", most)
    rng = random.Random(5)
    words = ["net", "sales", "cash", "&", "free", "flow", "margin", "eps", "q1", "café", "a_b", "R&D", "-", "(x)", "ß"]
    table = [(" ".join(rng.choices(words, k=rng.randint(1, 3))), f"v{i}", i) for i in range(120)] + [("net", "again", 500), ("", "empty", 501), ("& c", "mark", 502), ("é", "letter", 503)]
    texts = [(i, rng.choice([" ", "  ", ", "]).join(rng.choices([*words, "Netted", "CASH", "eps2", "xnet", "café's"], k=rng.randint(0, 9)))) for i in range(150)] + [(900, None), (901, ""), (902, "net" * 50), (903, "net sales " * 2000), (900, "eps")]
    frame = spark.createDataFrame(texts, "doc int, text string")
    rows = spark.createDataFrame(table, "alias string, value string, turn int")
    got = {(r["doc"], r["alias"], r["value"], r["turn"]) for r in aliases.occurrences(frame, rows, "doc").collect()}
    assert got == plain(texts, table) and len(got) > 300
    first = {r["doc"]: (r["value"], r["n_aliases"]) for r in aliases.first_values(frame.where("doc < 900"), rows, "doc").collect()}
    for doc in range(150):
        mine = sorted((turn, value) for key, _, value, turn in got if key == doc)
        assert first.get(doc) == ((mine[0][1], len(mine)) if mine else None)


def test_metrics_by_first_declaration(spark):
    texts = spark.createDataFrame([(1, "FCF margin and revenue"), (2, "Revenues grew"), (3, "the assets-to-debt view"), (4, "epsilon")], "id int, text string")
    assert {r["id"]: r["value"] for r in aliases.first_values(texts, aliases.metric_aliases(spark), "id").collect()} == {1: "fcf_margin", 2: "revenue", 3: "assets"}


def test_aliases_of_nothing(spark):
    none = spark.createDataFrame([], "alias string, value string, turn int")
    assert aliases.occurrences(spark.createDataFrame([(1, "a")], "id int, text string"), none, "id").count() == 0
