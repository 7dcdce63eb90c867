"""Percentages with 38 significant digits, half-even, as column expressions over DECIMAL: no Python in the plan.

Long division, digit by digit: the remainder and the nine multiples of the divisor are two limbs of 19 digits each, as the
remainder times ten has up to 39 digits, one more than DECIMAL holds. Dividends of up to 32 digits and divisors of up to 19, as sums of money are, take three steps of 19 digits.
Strings have the digits that decimal arithmetic with a precision of 38 gives: an exact quotient keeps as many places as the dividend's
scale exceeds the divisor's, and no fewer than it needs.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS, LIMB, SHORT = 38, 19, 32
_LIMB = "decimal(21,0)"


def _whole(value: Column) -> Column:
    """The digits of a DECIMAL without sign, point and leading zeros; empty for zero. (Spark's abs keeps 34 digits only.)"""
    return F.regexp_replace(F.regexp_replace(value.cast("string"), "[-.]", ""), "^0+", "")


def _places(value: Column) -> Column:
    return F.length(F.regexp_extract(value.cast("string"), r"\.(\d*)$", 1))


def _limbs(high: Column, low: Column) -> Column:
    return F.struct(high.cast(_LIMB).alias("h"), low.cast(_LIMB).alias("l"))


def _carried(high: Column, low: Column) -> Column:
    """Limbs of a high part and a low one of up to LIMB + 2 digits."""
    base = F.lit(Decimal(10**LIMB)).cast(_LIMB)
    rest = low % base
    return _limbs(high + ((low - rest) / base).cast(_LIMB), rest)


def _let(value: Column, use) -> Column:
    """use(value), where the value is computed once: as the argument of a lambda over one element."""
    return F.transform(F.array(value), use)[0]


def _quotient(dividend: Column, divisor: Column) -> Column:
    """(q, exact, zeros): the digits of dividend / divisor, both strings of digits, with leading zeros, whether nothing is left over, and how many zeros were put behind the dividend."""
    padded = F.lpad(divisor, 2 * LIMB, "0")
    limbs = F.struct(F.substring(padded, 1, LIMB).cast(_LIMB).alias("h"), F.substring(padded, LIMB + 1, LIMB).cast(_LIMB).alias("l"))
    multiples = lambda x: F.array(*(_carried(x["h"] * i, x["l"] * i) for i in range(10)))
    return _let(limbs, lambda x: _let(multiples(x), lambda many: _digits(dividend, divisor, many)))


def _digits(dividend: Column, divisor: Column, many: Column) -> Column:
    def step(state: Column, digit: Column) -> Column:
        now = _carried(state["h"] * 10, state["l"] * 10 + digit.cast(_LIMB))
        fits = lambda n: F.size(F.filter(many, lambda m: (n["h"] > m["h"]) | ((n["h"] == m["h"]) & (n["l"] >= m["l"])))) - 1
        picked = lambda n: F.struct(n.alias("n"), fits(n).alias("d"))
        less = lambda t: _let(F.get(many, t["d"]), lambda m: F.struct((t["n"]["h"] - m["h"]).alias("h"), (t["n"]["l"] - m["l"]).alias("l"), t["d"].alias("d")))
        lent = lambda x: F.struct((x["h"] - F.when(x["l"] < 0, 1).otherwise(0)).cast(_LIMB).alias("h"), (x["l"] + F.when(x["l"] < 0, F.lit(Decimal(10**LIMB)).cast(_LIMB)).otherwise(0)).cast(_LIMB).alias("l"), F.concat(state["q"], x["d"].cast("string")).alias("q"))
        return _let(_let(_let(now, picked), less), lent)

    zero = F.struct(F.lit(0).cast(_LIMB).alias("h"), F.lit(0).cast(_LIMB).alias("l"), F.lit("").alias("q"))
    fed = F.split(F.rpad(dividend, F.length(divisor) + DIGITS + 1, "0"), "")
    zeros = F.length(divisor) + DIGITS + 1 - F.length(dividend)
    return F.aggregate(fed, zero, step, lambda s: F.struct(s["q"].alias("q"), ((s["h"] == 0) & (s["l"] == 0)).alias("exact"), zeros.alias("zeros")))


def _short(dividend: Column, divisor: Column) -> Column:
    """The same for a dividend of at most SHORT digits and a divisor of at most LIMB: the remainder times ten to the LIMB fits DECIMAL, so three steps do."""
    d = divisor.cast(f"decimal({LIMB},0)")
    whole = lambda x: ((x - x % d) / d).cast("decimal(38,0)")
    fed = lambda x: ((x % d).cast(f"decimal({LIMB},0)") * F.lit(Decimal(10**LIMB)).cast("decimal(20,0)")).cast("decimal(38,0)")
    piece = lambda x: F.lpad(whole(x).cast("string"), LIMB, "0")
    all_of = lambda x0, x1, x2, x3: F.struct(F.concat(whole(x0).cast("string"), piece(x1), piece(x2), piece(x3)).alias("q"), (x3 % d == 0).alias("exact"), F.lit(3 * LIMB).alias("zeros"))
    return _let(dividend.cast("decimal(38,0)"), lambda x0: _let(fed(x0), lambda x1: _let(fed(x1), lambda x2: _let(fed(x2), lambda x3: all_of(x0, x1, x2, x3)))))


def _with_point(digits: Column, places: Column) -> Column:
    """Digits as a plain number with so many places; zeros follow where places are negative."""
    long = F.lpad(digits, F.greatest(F.length(digits), places + 1), "0")
    cut = F.length(long) - places
    return F.when(places <= 0, F.concat(digits, F.repeat(F.lit("0"), -places))).otherwise(F.concat(F.substring(long, F.lit(1), cut), F.lit("."), F.substring(long, cut + 1, places)))


def ratio38(a: Column, b: Column) -> Column:
    """a / b * 100 as a string, for DECIMAL columns; null unless b is positive."""
    return _let(F.struct(_whole(a).alias("a"), _whole(b).alias("b")), lambda x: _percent(a, b, x["a"], x["b"]))


def _percent(a: Column, b: Column, dividend: Column, divisor: Column) -> Column:
    kept = _places(a) - _places(b)  # the places of an exact quotient, if it needs no more

    def shown(found: Column) -> Column:
        return _let(F.regexp_replace(found["q"], "^0+", ""), lambda digits: written(found, digits))

    def written(found: Column, digits: Column) -> Column:
        fed = found["zeros"]
        tail, head = F.substring(digits, F.lit(DIGITS + 1), F.length(digits)), F.substring(digits, 1, DIGITS)
        half = F.rpad(F.lit("5"), F.length(tail), "0")  # of the same length, so that strings compare as numbers do
        up = (tail > half) | ((tail == half) & (~found["exact"] | (F.substring(head, -1, 1).cast("int") % 2 == 1)))
        all_nines = head == F.lit("9" * DIGITS)
        rounded = F.when(~up, head).when(all_nines, F.lit("1" + "0" * (DIGITS - 1))).otherwise((head.cast("decimal(38,0)") + 1).cast("decimal(38,0)").cast("string"))
        places = fed + kept - (F.length(digits) - DIGITS) - F.when(up & all_nines, 1).otherwise(0)
        # Exact: without the zeros at its end, then with those that its scale asks for, as far as 38 digits go.
        bare = F.regexp_replace(digits, "0+$", "")
        bare_places = fed + kept - (F.length(digits) - F.length(bare))
        more = F.greatest(F.lit(0), F.least(kept - bare_places, DIGITS - F.length(bare)))
        hundred = F.least(F.lit(2), DIGITS - F.length(bare) - more)  # zeros of the percentage that fit; others go to the exponent
        exact = _with_point(F.concat(bare, F.repeat(F.lit("0"), more + hundred)), bare_places + more + hundred - 2)
        return F.when(found["exact"] & (F.length(bare) <= DIGITS), exact).otherwise(_with_point(rounded, places - 2))

    short = (F.length(dividend) <= SHORT) & (F.length(divisor) <= LIMB)
    number = _let(F.when(short, _short(dividend, divisor)).otherwise(_quotient(dividend, divisor)), shown)
    zero = F.concat(F.lit("0"), F.when(kept > 0, F.concat(F.lit("."), F.repeat(F.lit("0"), kept))).otherwise(""))
    below = lambda x: x.cast("string").startswith("-")
    return F.when(b.isNotNull() & (divisor != "") & ~below(b), F.when(dividend == "", zero).when(a.isNotNull(), F.concat(F.when(below(a), "-").otherwise(""), number)))


def growth38(base: Column, end: Column) -> Column:
    """(end - base) / base * 100 as a string, for DECIMAL columns; null unless base is positive."""
    return ratio38(end - base, base)
