"""Facts: exact decimals, resolution, reconciliation, calculations, growth and ranks, by examples."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quillstone.functions import decimals
from quillstone.operators import facts

D = datetime.date


def test_decimal_examples():
    d = Decimal
    assert decimals.growth(d(100), d(120)) == 20 and decimals.growth(d(2), d(3)) == 50
    assert decimals.ratio_percent(d(30), d(120)) == 25 and decimals.ratio_percent(d(-3), d(120)) == d("-2.5")
    assert abs(decimals.cagr(d(100), d(121), 2) - 10) < d("1e-25")
    assert decimals.growth(d(0), d(5)) is None and decimals.cagr(d(1), d(-1), 2) is None
    assert decimals.plain(decimals.ratio_percent(d(120), d(7))).startswith("1714.2857142857142857142857142857142857")
    assert [decimals.exact(x) for x in (True, "NaN", "Infinity", "", None, "x")] == [None] * 6 and decimals.exact("1e3") == 1000


def test_ranks_of_values_that_begin_alike(spark):
    rows = spark.createDataFrame([(v,) for v in ("804.00", "804.16", "804.1", "80", "-804", "-804.16")], "value string").withColumns({"entity": F.col("value"), "y": F.lit(1)})
    assert {r["entity"]: r["rank"] for r in facts.rank_competition(rows, ["y"]).collect()} == {"804.16": 1, "804.1": 2, "804.00": 3, "80": 4, "-804": 5, "-804.16": 6}


def test_order_key(spark):
    values = ["-1e3", "-2", "-1.5", "0", "0.001", "0.5", "1", "9007199254740992", "9007199254740993", "1" + "0" * 60]
    rows = spark.createDataFrame([(v,) for v in reversed(values)], "v string")
    assert [r["v"] for r in rows.orderBy(decimals.order_key(F.col("v"))).collect()] == values
    same = spark.createDataFrame([("1", "1.000"), ("1e3", "1000"), ("-0", "0"), (".5", "0.50")], "a string, b string")
    assert same.where(decimals.order_key(F.col("a")) == decimals.order_key(F.col("b"))).count() == 4
    bad = spark.createDataFrame([("",), ("0x1",), ("NaN",), ("Infinity",), (None,)], "v string")
    assert bad.where(decimals.order_key(F.col("v")).isNotNull()).count() == 0


def test_udfs_give_38_digits(spark):
    row = spark.createDataFrame([("120", "7", 2), (None, "1", 1), ("x", "1", 1)], "a string, b string, n int").select(decimals.ratio38(F.col("a"), F.col("b")).alias("r"), decimals.cagr38(F.col("b"), F.col("a"), F.col("n")).alias("c")).collect()
    assert row[0]["r"] == "1714.2857142857142857142857142857142857" and row[0]["c"].startswith("314.03933") and row[1]["r"] is None and row[2]["r"] is None


OBS = "val string, start string, end string, fy int, fp string, form string, accn string, dimensions map<string,string>"
GOOD = ("100", "2024-01-01", "2024-12-31", 2024, "FY", "10-K", "A-1", None)


def resolved(spark, *seen, metric="revenue"):
    rows = [(1, concept, "USD", *obs) for concept, obs in seen]
    dim = facts.metric_dimension(spark)
    reports = spark.createDataFrame([("D", "AAPL", 1, 2024, "10-K", "A-1", "2024-12-31")], "document_id string, ticker string, cik long, fiscal_year int, filing_type string, accession_number string, period_end string")
    found = facts.annual_candidates(spark.createDataFrame(rows, f"cik long, concept string, unit string, {OBS}"), reports, dim)
    slots = spark.createDataFrame([("D", metric)], "document_id string, metric string")
    return facts.resolve(found, slots).first()


def change(**kw):
    names = [x.split()[0] for x in OBS.split(", ")]
    return tuple(kw.get(n, v) for n, v in zip(names, GOOD, strict=True))


def test_resolver(spark):
    assert resolved(spark, ("Revenues", GOOD))["text"] == "100"
    both = resolved(spark, ("Revenues", change(val="100.0")), ("SalesRevenueNet", GOOD))
    assert both["concept"] == "SalesRevenueNet" and both["agreeing"] == 2 and both["reason"] is None
    assert resolved(spark, ("Revenues", GOOD), ("Revenues", change(val="101")))["reason"] == "conflicting observations"
    for bad in (change(fy=2023), change(fp="Q4"), change(form="10-K/A"), change(accn="A-2"), change(end="2024-11-30"), change(start="2024-06-01"), change(start=None)):
        assert resolved(spark, ("Revenues", bad))["reason"] == "no annual observation"
    assert resolved(spark, ("Revenues", change(val="-1")))["reason"] == "negative value for a nonnegative metric"
    assert resolved(spark, ("Revenues", change(val="NaN")))["reason"] == "value is not a finite decimal"
    assert resolved(spark, ("Revenues", change(dimensions={"a": "b"})))["reason"] == "dimensional observation"
    assert resolved(spark, ("Assets", change(start=None)), metric="assets")["text"] == "100"
    assert resolved(spark, ("Assets", GOOD), metric="assets")["reason"] == "no annual observation"


CTX = ("1", "instant", None, D(2024, 12, 31), False)


@pytest.mark.parametrize(
    ("seen", "status"),
    [
        ([("parsed", 100, "USD", False, CTX)], "matched"),
        ([("parsed", 100, "USD", True, CTX)], "not_verified"),
        ([("parsed", 101, "USD", True, CTX)], "conflict"),
        ([("parsed", 100, "USD", False, CTX), ("parsed", 101, "USD", False, CTX)], "conflict"),
        ([("parsed", 100, "USD", False, CTX), ("unresolved", None, None, False, None)], "not_verified"),
        ([("parsed", 100, "USD", False, CTX), ("unresolved", None, None, False, ("1", "instant", None, D(2023, 12, 31), False))], "matched"),
        ([("parsed", 100, "USD", False, CTX), ("parsed", 5, "shares", False, CTX)], "not_verified"),
        ([("parsed", 5, "USD", False, ("1", "instant", None, D(2024, 12, 31), True))], "not_verified"),
        ([("parsed", 5, "USD", False, ("2", "instant", None, D(2024, 12, 31), False)), ("parsed", 100, "USD", False, CTX)], "matched"),
        ([], "not_verified"),
    ],
)
def test_reconciliation_ladder(spark, seen, status):
    fact = spark.createDataFrame([("D", "assets", "Assets", Decimal(100), "USD", "1", "instant", None, D(2024, 12, 31))], "document_id string, metric string, concept string, value decimal(38,2), unit string, cik string, kind string, period_start date, period_end date")
    rows = [("D", "Assets", s, None if v is None else Decimal(v), u, h, c) for s, v, u, h, c in seen]
    obs = spark.createDataFrame(rows, "document_id string, concept string, status string, value decimal(38,2), unit string, hidden boolean, context struct<cik:string,kind:string,period_start:date,period_end:date,dimensional:boolean>")
    assert facts.reconcile(fact, obs).first()["status"] == status


def fact(metric, value, year=2024, **kw):
    row = {"ticker": "AAPL", "cik": "1", "metric": metric, "value": value, "unit": "USD", "fiscal_year": year, "period_start": D(year, 1, 1), "period_end": D(year, 12, 31), "accession_number": f"A-{year}"} | kw
    return tuple(row.values())


@pytest.mark.parametrize(
    ("metric", "inputs", "value", "error"),
    [
        ("free_cash_flow", [fact("operating_cash_flow", "60"), fact("capex", "10")], 50, None),
        ("fcf_margin", [fact("operating_cash_flow", "60"), fact("capex", "10"), fact("revenue", "200")], 25, None),
        ("operating_margin", [fact("operating_income", "30"), fact("revenue", "120")], 25, None),
        ("growth", [fact("revenue", "100", 2023), fact("revenue", "120")], 20, None),
        ("cagr", [fact("revenue", "100", 2022), fact("revenue", "121")], 10, None),
        ("growth", [fact("revenue", "120"), fact("revenue", "100", 2023)], None, "years must ascend"),
        ("growth", [fact("revenue", "0", 2023), fact("revenue", "100")], None, "base must be positive"),
        ("operating_margin", [fact("revenue", "120"), fact("operating_income", "30")], None, "roles disagree"),
        ("operating_margin", [fact("operating_income", "30", 2023), fact("revenue", "120")], None, "inputs of several periods"),
        ("free_cash_flow", [fact("operating_cash_flow", "60"), fact("capex", "-1")], None, "capex must be a nonnegative outflow"),
        ("growth", [fact("revenue", "1", 2023, cik="2"), fact("revenue", "2")], None, "inputs of several companies"),
        ("growth", [fact("revenue", "1", 2023, period_start=D(2023, 6, 1)), fact("revenue", "2")], None, "input is not annual"),
        ("other", [fact("revenue", "1")], None, "unsupported calculation"),
        ("growth", [], None, "no inputs"),
    ],
)
def test_calculations(spark, metric, inputs, value, error):
    kind = "array<struct<ticker:string,cik:string,metric:string,value:string,unit:string,fiscal_year:int,period_start:date,period_end:date,accession_number:string>>"
    got = facts.calculate(spark.createDataFrame([(metric, inputs)], f"metric string, inputs {kind}")).first()
    assert got["error"] == error and (value is None or abs(Decimal(got["value"]) - value) < Decimal("1e-25"))


def test_growth_needs_the_year_before(spark):
    rows = [("a", 2020, "m", Decimal(10)), ("a", 2022, "m", Decimal(20)), ("a", 2023, "m", Decimal(30)), ("b", 2020, "m", Decimal(-1)), ("b", 2021, "m", Decimal(4))]
    out = facts.growth(spark.createDataFrame(rows, "entity string, fiscal_year int, metric string, value decimal(20,2)"), base_year=2020)
    got = {(r["entity"], r["fiscal_year"]): (r["growth"], r["growth_reason"], r["cagr_reason"]) for r in out.collect()}
    assert got["a", 2022][1] == "no value for the year before" and got["a", 2023][0] == 50 and got["b", 2021][1:] == ("base is not positive", "values are not positive")


def test_competition_ranks(spark):
    rows = [("a", "10"), ("b", "10.0"), ("c", "9"), ("d", None)]
    out = facts.rank_competition(spark.createDataFrame(rows, "entity string, value string").withColumn("y", F.lit(1)), ["y"])
    assert {r["entity"]: r["rank"] for r in out.collect()} == {"a": 1, "b": 1, "c": 3}
    assert facts.leaders(spark.createDataFrame(rows, "entity string, value string").withColumn("y", F.lit(1)), ["y"]).first()["leaders"] == "a, b"


def test_issues_block_by_document_or_year(spark):
    f = spark.createDataFrame([("D1", "A", 2024, "m"), ("D2", "B", 2024, "m"), ("D3", "C", 2024, "m")], "document_id string, ticker string, fiscal_year int, metric string")
    issues = spark.createDataFrame([("D1", None, None, "m"), ("X", "B", 2024, "m"), ("D3", "C", 2024, "n")], "document_id string, ticker string, fiscal_year int, metric string")
    assert [r["document_id"] for r in facts.unblocked(f, issues).collect()] == ["D3"]


def test_display(spark):
    rows = spark.createDataFrame([("118550000000", "USD"), ("-5000000000", "USD"), ("1245", "USD"), ("999", "USD"), ("12.345", "percentage"), ("6.08", "USD/shares")], "v string, u string")
    assert [r[0] for r in rows.select(facts.display(F.col("v"), F.col("u"))).collect()] == ["$118.55B", "$-5.00B", "$1.24K", "$999.00", "12.34%", "6.08 USD/shares"]
