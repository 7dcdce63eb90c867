"""Guards of nested JSON, table rows of spans and the scope of chunks, by examples."""

from pyspark.sql import functions as F

from quillstone.operators import guards, text

BLOCK = "document_id string, ord int, text string, location string, section string, subsection string, page int, is_table boolean"


def test_guards_tell_absent_null_and_wrong_apart(spark):
    texts = ['{"a": {"n": 5}}', '{"a": {"n": null}}', '{"a": {}}', '{"a": 3}', '{"a": {"n": "5"}}', '{"a": {"n": 5.5}}', "[]", "nothing", None, '{"a": {"n": 99999999999}}', '{"a": {"n": true}}', '{"a": {"n": 1}, "a": 2}']
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, j string")
    got = {r["id"]: (r["n_state"], r["n"]) for r in guards.guarded(rows, "j", {"n": ("$.a.n", "whole", "int")}).collect()}
    states = ["ok", "null", "absent", "absent", "wrong type", "wrong type", "absent", "no document", "no document", "out of range", "wrong type", "no document"]
    assert [got[i][0] for i in range(12)] == states and [got[i][1] for i in range(12)] == [5] + [None] * 11
    bad = {(r["key"], r["path"], r["state"]) for r in guards.violations(rows.where("id < 4"), "j", "id", {"a": ("$.a", "object"), "n": ("$.a.n", "number")}).collect()}
    assert bad == {("1", "$.a.n", "null"), ("2", "$.a.n", "absent"), ("3", "$.a", "wrong type"), ("3", "$.a.n", "absent")}


def spans(spark, rows, size, overlap):
    found = text.chunk(spark.createDataFrame(rows, BLOCK), size, overlap).orderBy("document_id", "run", "n").collect()
    return [(r["text"], [s.asDict() for s in r["source_spans"]]) for r in found]


def test_table_rows_of_a_cut_after_a_newline(spark):
    got = spans(spark, [("d", 0, "r1 a b\nr2 c d\nr3 e f", "t", "s", None, None, True)], 3, 0)
    assert [(x, [(s["table_row_start"], s["table_row_end"], s["starts_mid_row"], s["ends_mid_row"]) for s in ss]) for x, ss in got] == [("r1 a b\n", [(1, 1, False, False)]), ("r2 c d\n", [(2, 2, False, False)]), ("r3 e f", [(3, 3, False, False)])]
    got = spans(spark, [("d", 0, "r1 a b\nr2 c d\nr3 e f", "t", "s", None, None, True)], 4, 0)
    assert [[(s["table_row_start"], s["table_row_end"], s["starts_mid_row"], s["ends_mid_row"]) for s in ss] for _, ss in got] == [[(1, 2, False, True)], [(2, 3, True, True)], [(3, 3, True, False)]]


def test_chunks_stay_within_section_subsection_page_and_table(spark):
    rows = [
        ("d", 0, "a b", "l0", "s", None, 1, False), ("d", 1, "c d", "l1", "s", None, 1, False), ("d", 2, "e f", "l2", "s", None, 2, False), ("d", 3, "g h", "l3", "s", "x", 2, False),
        ("d", 4, "t1 u\nt2 v", "l4", "s", "x", 2, True), ("d", 5, "t3 w", "l5", "s", "x", 2, True), ("d", 6, "i j", "l6", "s", "x", 2, False), ("d", 7, "k l", "l7", "z", "x", 2, False),
    ]
    got = spans(spark, rows, 100, 0)
    assert [x for x, _ in got] == ["a b\nc d", "e f", "g h", "t1 u\nt2 v", "t3 w", "i j", "k l"]
    assert got[0][1] == [{"location": f"l{i}", "character_start": 0, "character_end": 3, "page": 1, "table": False, "table_row_start": None, "table_row_end": None, "starts_mid_row": None, "ends_mid_row": None} for i in (0, 1)]
    plain = text.chunk(spark.createDataFrame(rows, BLOCK).drop("subsection", "page"), 100, 0)
    assert plain.count() == 5 and plain.where(F.col("is_table")).count() == 2
