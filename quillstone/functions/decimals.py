"""Exact decimals of 38 significant digits, half-even, as strings; Spark's own DECIMAL has a fixed scale.

Values at rest are decimal strings. Native DECIMAL(38, s) serves sums and comparisons; ratios and roots with 38 significant
digits are Arrow UDFs over columns.
"""

from __future__ import annotations

import decimal
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.shipping import ship

NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def exact(value: object) -> decimal.Decimal | None:
    """The finite decimal that a number or string states; None for booleans, blanks, NaN, infinities and other text."""
    if value is None or isinstance(value, bool):
        return None
    try:
        out = decimal.Decimal(str(value).strip())
    except decimal.InvalidOperation:
        return None
    return out if out.is_finite() else None


def plain(value: decimal.Decimal | None) -> str | None:
    return None if value is None else format(value, "f")


def _context() -> decimal.Context:
    return decimal.Context(prec=38, rounding=decimal.ROUND_HALF_EVEN)


def ratio_percent(a: decimal.Decimal, b: decimal.Decimal) -> decimal.Decimal | None:
    """a / b * 100 for positive b."""
    with decimal.localcontext(_context()):
        return a / b * 100 if b > 0 else None


def growth(base: decimal.Decimal, end: decimal.Decimal) -> decimal.Decimal | None:
    with decimal.localcontext(_context()):
        return (end - base) / base * 100 if base > 0 else None


def cagr(base: decimal.Decimal, end: decimal.Decimal, years: int) -> decimal.Decimal | None:
    with decimal.localcontext(_context()):
        return ((end / base) ** (decimal.Decimal(1) / decimal.Decimal(int(years))) - 1) * 100 if base > 0 and end > 0 and years > 0 else None


def _udf(fn: Callable, names: int) -> Callable[..., Column]:
    def series(*columns: pd.Series) -> pd.Series:
        return pd.Series([plain(fn(*args)) if all(x is not None for x in args) else None for args in zip(*([exact(x) for x in c] for c in columns[:names]), *(list(c) for c in columns[names:]), strict=True)], dtype=object)

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return series(a, b)

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return series(a, b, c)

    made = []

    def apply(*columns: Column) -> Column:
        ship(SparkSession.active())
        if not made:
            made.append(F.pandas_udf(two if len(columns) == 2 else three, "string"))
        return made[0](*columns)

    return apply


ratio38 = _udf(ratio_percent, 2)
growth38 = _udf(growth, 2)
cagr38 = _udf(cagr, 2)


def native(value: Column, scale: int = 6) -> Column:
    """A decimal string as DECIMAL(38, scale), null where it is none: for sums, order and equality by value."""
    return F.when(value.rlike(NUMBER), value.try_cast(f"decimal(38,{scale})"))


def order_key(value: Column) -> Column:
    """A sortable string for decimal strings of any length: sign, magnitude and digits; null where it is no number.

    Equal for equal values (1, 1.000 and 1e0; 0 and -0), and ordered as the numbers are, beyond 38 digits too.
    """
    text = F.lower(F.trim(value))
    mantissa, exponent = F.regexp_extract(text, r"^[+-]?([\d.]+)", 1), F.coalesce(F.regexp_extract(text, r"e([+-]?\d+)$", 1).try_cast("int"), F.lit(0))
    whole, part = F.regexp_extract(mantissa, r"^(\d*)", 1), F.regexp_extract(mantissa, r"\.(\d*)$", 1)
    digits = F.concat(whole, part)
    lead = F.length(digits) - F.length(F.regexp_replace(digits, "^0+", ""))
    stripped = F.regexp_replace(F.regexp_replace(digits, "^0+", ""), "0+$", "")
    magnitude = F.length(whole) + exponent - lead
    up = F.concat(F.lpad((magnitude + 50000).cast("string"), 6, "0"), F.lit(":"), stripped)  # what ends first is less: 804 before 804.16
    flipped = F.translate(F.concat(up, F.lit(":")), "0123456789:", "9876543210;")
    negative = text.startswith("-")
    key = F.when(stripped == "", F.lit("1")).when(negative, F.concat(F.lit("0"), flipped)).otherwise(F.concat(F.lit("2"), up))
    return F.when(text.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?$"), key)
