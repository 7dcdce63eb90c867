"""Long division over limbs against decimal arithmetic with a precision of 38, string for string."""

import random
from decimal import Decimal

from pyspark.sql import functions as F

from quillstone.functions import decimals, long_division


def _cases():
    rng = random.Random(11)
    for la, lb in [(1, 1), (4, 2), (18, 18), (19, 19), (19, 20), (20, 19), (37, 38), (38, 38), (38, 1), (1, 38), (25, 3)]:
        for _ in range(6):
            yield rng.choice([1, -1]) * rng.randrange(10 ** (la - 1), 10**la), rng.randrange(10 ** (lb - 1), 10**lb)
    top = 10**38 - 1
    yield from [(0, 5), (5, 0), (5, -2), (-5, 2), (1, 3), (2, 3), (top, top), (top, 1), (1, top), (top - 1, top), (10**37, 1), (10**37, 2**120), (1, 2**100), (100, 4), (400, 100), (12500, 100), (10**19, 10**19 - 1), (10**19 - 1, 10**19)]


def test_ratios_are_those_of_decimal_arithmetic(spark):
    for sa, sb in [(4, 4), (0, 0), (6, 2), (2, 6), (38, 0)]:
        pairs = [(i, Decimal(a).scaleb(-sa, context=decimals._context()), Decimal(b).scaleb(-sb, context=decimals._context())) for i, (a, b) in enumerate(_cases())]
        frame = spark.createDataFrame(pairs, f"i int, a decimal(38,{sa}), b decimal(38,{sb})").repartition(4)
        out = frame.select("i", F.col("a").cast("string").alias("s"), F.col("b").cast("string").alias("t"), long_division.ratio38(F.col("a"), F.col("b")).alias("r"))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
        for r in out.collect():
            assert r["r"] == decimals.plain(decimals.ratio_percent(Decimal(r["s"]), Decimal(r["t"]))), (r["s"], r["t"])


def test_growth_nulls_and_signs(spark):
    rows = [(Decimal("100.00"), Decimal("150.00")), (Decimal("3.00"), Decimal("1.00")), (Decimal("0.00"), Decimal("1.00")), (Decimal("-2.00"), Decimal("1.00")), (None, Decimal("1.00")), (Decimal("1.00"), None), (Decimal("7.00"), Decimal("7.00"))]
    got = spark.createDataFrame(rows, "a decimal(38,2), b decimal(38,2)").select(long_division.growth38(F.col("a"), F.col("b")).alias("g")).collect()
    assert [r["g"] for r in got] == [decimals.plain(decimals.growth(*x)) if None not in x else None for x in rows]
