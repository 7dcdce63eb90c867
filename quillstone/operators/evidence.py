"""Evidence, citations, context budgets and the guard over generated prose."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.shipping import ship
from quillstone.session import settled, small


def register(records: DataFrame, request: str = "request_id", order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """Evidence ids EVIDENCE_{request}_{001..} in input order within a request."""
    n = F.row_number().over(Window.partitionBy(request).orderBy(*order))
    return records.withColumn("evidence_id", F.concat(F.lit("EVIDENCE_"), F.col(request), F.lit("_"), F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string"))))


def append_once(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Violations of an append: ids that exist already or occur twice in the batch. An empty result allows the whole append."""
    twice = batch.groupBy("evidence_id").agg(F.count("*").alias("n")).where("n > 1").select("evidence_id", F.lit("occurs twice").alias("reason"))
    known = batch.select("evidence_id").distinct().join(existing.select("evidence_id"), "evidence_id", "left_semi").select("evidence_id", F.lit("exists").alias("reason"))
    blank = batch.where(F.trim(F.coalesce("text", F.lit(""))) == "").select("evidence_id", F.lit("no text").alias("reason")) if "text" in batch.columns else twice.where("false")
    return twice.union(known).union(blank)


def citation_errors(claims: DataFrame, registry: DataFrame) -> DataFrame:
    """(request_id, claim, reason) of claims (request_id, claim, text, citation_ids): one bad citation rejects its request."""
    cited = claims.select("request_id", "claim", F.explode("citation_ids").alias("evidence_id"))
    unknown = cited.join(registry.select("request_id", "evidence_id"), ["request_id", "evidence_id"], "left_anti").select("request_id", "claim", F.concat(F.lit("unknown citation "), F.col("evidence_id")).alias("reason"))
    empty = claims.where((F.trim(F.coalesce("text", F.lit(""))) == "") | (F.coalesce(F.size("citation_ids"), F.lit(0)) < 1)).select("request_id", "claim", F.lit("no text or no citation").alias("reason"))
    return unknown.union(empty)


def uncovered(requested: DataFrame, claims: DataFrame, registry: DataFrame) -> DataFrame:
    """The (request_id, ticker, fiscal_year) asked for that no cited evidence belongs to."""
    cited = claims.select("request_id", F.explode("citation_ids").alias("evidence_id")).join(registry, ["request_id", "evidence_id"])
    return requested.join(cited.select("request_id", "ticker", "fiscal_year").distinct(), ["request_id", "ticker", "fiscal_year"], "left_anti")


def fit_budget(records: DataFrame, budget: int, by: list[str], group: list[str], size: Column, relevance: str = "score", protected: Column | None = None) -> DataFrame:
    """Drops the least relevant optional records until the sizes fit the budget.

    The best record of each group, and those `protected`, always stay; `fits` is false where these alone are too large. Removal goes by
    relevance, then id; a running sum from the most relevant end finds how many optional records stay.
    """
    best = F.row_number().over(Window.partitionBy(*by, *group).orderBy(F.desc(relevance), "doc_id")) == 1
    rows = records.withColumn("size", size).withColumn("kept_always", best if protected is None else best | protected)
    fixed = F.sum(F.when(F.col("kept_always"), F.col("size")).otherwise(0)).over(Window.partitionBy(*by))
    rows = rows.withColumn("fixed", fixed)
    upto = F.sum("size").over(Window.partitionBy(*by, "kept_always").orderBy(F.desc(relevance), F.desc("doc_id")).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("upto", upto).withColumn("fits", F.col("fixed") <= budget)
    return rows.where(F.col("kept_always") | (F.col("fixed") + F.col("upto") <= budget)).drop("fixed", "upto")


# The words of the guard, after folding.
ADDRESS_ENDINGS = frozenset("com org net gov edu io co invalid".split())
CURRENCY_WORDS = frozenset("dollar dollars euro euros rupee rupees usd eur inr gbp jpy".split())
SHARE_WORDS = frozenset("percent percents percentage percentages bps ratio ratios".split())
MAGNITUDES = frozenset("hundred thousand million billion trillion".split())
MULTIPLES = frozenset("double doubled doubling triple tripled tripling halve halved halving twice thrice half halves quarter quarters thirds fourths".split())
COUNTS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety dozen dozens".split()
EXTREMES = frozenset("highest lowest largest smallest majority minority exceeded outpaced outstripped".split())
AMOUNTS = frozenset("revenue revenues sales income profit profits margin margins cash assets liabilities equity eps earnings capex".split())
MOVEMENTS = frozenset("increased decreased grew rose fell declined higher lower growth increase decrease".split())
BEFORE_YEARS = frozenset("in during for since through between and to".split())

_MEASURES = CURRENCY_WORDS | SHARE_WORDS | MAGNITUDES | MULTIPLES
_TIMES = frozenset(COUNTS[1:13])


class Prose:
    """Folded text as words and marks, with what lies next to each."""

    def __init__(self, text: str):
        self.text = " ".join(unicodedata.normalize("NFKC", text).casefold().split())
        self.tokens = [(m.group(), m.start(), m.end()) for m in re.finditer(r"\w+|[^\w\s]", self.text)]

    def word(self, i: int) -> str:
        return self.tokens[i][0] if 0 <= i < len(self.tokens) else ""

    def touching(self, i: int) -> bool:
        """Whether token i + 1 follows token i without a space."""
        return 0 <= i < len(self.tokens) - 1 and self.tokens[i][2] == self.tokens[i + 1][1]

    def reads(self, i: int, *words: str, glued: bool = False) -> bool:
        return all(self.word(i + k) == w for k, w in enumerate(words)) and (not glued or all(self.touching(i + k) for k in range(len(words) - 1)))

    def next_to(self, i: int) -> str:
        """The mark or first letter that touches token i on the right."""
        return self.word(i + 1)[0] if self.touching(i) else ""

    def before(self, i: int) -> str:
        return self.word(i - 1)[-1] if self.touching(i - 1) else ""

    def has_address(self) -> bool:
        for i, (token, *_) in enumerate(self.tokens):
            if token == "/" and self.reads(i, "/", "/", glued=True):
                scheme = self.word(i - 1) == ":" and self.word(i - 2)[:1].isalnum()
                if scheme or not _wordy(self.before(i)) and (_wordy(self.word(i + 2)[:1]) or self.word(i + 2) == "["):
                    return True
            if token == "www" and self.word(i + 1) == "." or token == "]" and self.word(i + 1) == "(" and ")" in (t for t, *_ in self.tokens[i + 2 :]):
                return True
            if token in ADDRESS_ENDINGS and self.word(i - 1) == "." and self.touching(i - 1) and self.touching(i - 2) and (self.word(i - 2).isascii() and _wordy(self.word(i - 2)) or self.word(i - 2) == "-"):
                return True
        return False

    def has_measure(self) -> bool:
        for i, (token, *_) in enumerate(self.tokens):
            if token in _MEASURES or token in "%‰‱" or unicodedata.category(token[0]) == "Sc" or len(token) > 4 and token.endswith("fold"):
                return True
            if token == "basis" and self.word(i + 1) in ("point", "points") or token == "times" and (self.word(i - 1) in _TIMES or self.word(i - 1).isdecimal()):
                return True
            if token in ":/–—" and self.word(i - 1)[-1:].isdecimal() and self.word(i + 1)[:1].isdecimal():
                return True
        return False

    def compares(self) -> bool:
        for i, (token, *_) in enumerate(self.tokens):
            if token in EXTREMES or token in ("more", "less", "greater") and self.word(i + 1) == "than":
                return True
            if token == "record" and (self.word(i + 1) in ("high", "low") or self.reads(i, "record", "-", glued=True) and self.word(i + 2) in ("high", "low")):
                return True
        return False

    def tells_change(self) -> bool:
        words = [t for t, *_ in self.tokens]
        amount = not AMOUNTS.isdisjoint(words) or any(self.reads(i, "capital", "expenditure") for i in range(len(words)))
        return amount and not MOVEMENTS.isdisjoint(words)

    def _form(self, i: int) -> int:
        """How many tokens from i on name an annual report's form; 0 if none."""
        at = i + 1 if self.word(i) == "form" else i
        if not self.reads(at, "10", "-", "k", glued=True) or self.next_to(at + 2) == "-":
            return 0
        return at + 3 - i

    def references(self) -> tuple[set[int], set[int]]:
        """The tokens whose digits only refer to something, and the years named by them."""
        known: set[int] = set()
        years: set[int] = set()
        for i, (token, *_) in enumerate(self.tokens):
            free = self.before(i) != "."
            bare = token[2:] if token.startswith("fy") else token
            if bare != token and free and _year(bare):
                known.add(i)
                years.add(int(bare))
            if token == "fy" and free and _year(self.word(i + 1)):
                known.add(i + 1)
                years.add(int(self.word(i + 1)))
            if _year(token):
                after_fiscal = self.word(i - 1) in ("year", "years") and self.word(i - 2) == "fiscal"
                ahead = self.word(i - 1) in BEFORE_YEARS or after_fiscal
                if free and not self.touching(i) and self._form(i + 1) or ahead and not self.touching(i - 1) and self.next_to(i) != ".":
                    known.add(i)
                    years.add(int(token))
            if free and (length := self._form(i)):
                known.update(range(i, i + length))
            if token in ("item", "items") and free and not self.touching(i) and _item(self.word(i + 1)):
                ahead = self.next_to(i + 1)
                if ahead != "-" and not (ahead == "." and self.next_to(i + 2).isdecimal()):
                    known.add(i + 1)
            if free and self.reads(i, "covid", "-", "19", glued=True) and self.next_to(i + 2) != "-":
                known.add(i + 2)
        return known, years


def _wordy(c: str) -> bool:
    return bool(c) and all(x.isalnum() or x == "_" for x in c)


def _year(word: str) -> bool:
    return len(word) == 4 and word.isdecimal() and word[:2] in ("19", "20")


def _item(word: str) -> bool:
    digits = word[:-1] if word[-1:].isalpha() and word.isascii() else word
    return 1 <= len(digits) <= 2 and digits.isdecimal()


def _unreadable(c: str) -> bool:
    """Characters that hide from a reader, and numerals that are no decimal digits."""
    kind = unicodedata.category(c)
    return kind in ("Cf", "Cs") or kind == "Cc" and c not in "\n\r\t" or c.isnumeric() and not c.isdecimal()


def narrative_category(text: object, allowed_years: set[int]) -> str:
    """qualitative_or_reference, quantitative, ambiguous or prohibited_external_reference.

    Addresses weigh more than measures, these more than comparisons, number words and changes of amounts; digits are allowed
    only in references to allowed years, forms and items.
    """
    if not isinstance(text, str) or not text.strip() or any(map(_unreadable, text)):
        return "ambiguous"
    prose = Prose(text)
    if prose.has_address():
        return "prohibited_external_reference"
    if prose.has_measure():
        return "quantitative"
    known, years = prose.references()
    open_digits = any(i not in known and any(c.isnumeric() for c in token) for i, (token, *_) in enumerate(prose.tokens))
    counted = not {t for t, *_ in prose.tokens}.isdisjoint(COUNTS)
    unsure = open_digits or counted or not years <= set(allowed_years) or prose.compares() or prose.tells_change()
    return "ambiguous" if unsure else "qualitative_or_reference"


def narrative(claims: DataFrame) -> DataFrame:
    """`category` of claims (text, allowed_years array<int>) by an Arrow UDF, as it needs Unicode categories."""
    ship(claims.sparkSession)

    @F.pandas_udf("string")
    def run(texts: pd.Series, years: pd.Series) -> pd.Series:
        return pd.Series([narrative_category(t, set() if y is None else {int(x) for x in y}) for t, y in zip(texts, years, strict=True)], dtype=object)

    return claims.withColumn("category", run("text", "allowed_years"))


def unsafe_requests(claims: DataFrame) -> DataFrame:
    """(request_id, reason): requests of which a claim is not plain prose, or whose claims together tell a measured change.

    Each text is judged once for the years allowed, however many claims say it."""
    key = F.struct("text", "allowed_years")
    judged = narrative(claims.select("text", "allowed_years").distinct())
    words = F.split(F.lower("text"), r"[^\p{L}\p{N}_]+")
    has = lambda some: F.arrays_overlap(words, F.array(*(F.lit(w) for w in sorted(some))))
    amount = has(AMOUNTS) | F.contains(F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")), F.lit(" capital expenditure "))
    marked = judged.withColumns({"_amount": F.coalesce(amount, F.lit(False)), "_moved": F.coalesce(has(MOVEMENTS), F.lit(False))})
    marked = settled(marked.select(key.alias("said"), "category", "_amount", "_moved"), "judged")
    marked = claims.select("request_id", key.alias("own")).join(small(marked), F.col("own").eqNullSafe(F.col("said")))
    bad = marked.groupBy("request_id").agg((F.bool_or(F.col("category") != "qualitative_or_reference") | (F.bool_or("_amount") & F.bool_or("_moved"))).alias("bad"))
    return bad.where("bad").select("request_id", F.lit("narrative holds numbers, changes or addresses").alias("reason"))
