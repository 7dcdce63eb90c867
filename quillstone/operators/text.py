"""Text of filings: normalisation, HTML blocks, sections, scopes, chunks with source spans.

Blocks are rows (document_id, ord, text, location, is_table). Order is always carried in `ord`.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions import markup
from quillstone.functions.shipping import ship
from quillstone.session import lean

_BLOCKS = frozenset(["p", "div", "table", "h1", "h2", "h3", "h4"])
_NOISE = frozenset(["script", "style", "nav", "header", "footer"])
_BLOCK_SCHEMA = "array<struct<ord:int,text:string,location:string,is_table:boolean>>"


def html_blocks_of(page: str | bytes | None) -> list[dict]:
    """Leaf paragraphs, divisions, headings and whole tables, once each, without noise, hidden parts and immediate repeats."""
    if not page:
        return []
    root = markup.parse(page)
    for e in list(root.walk()):
        if e.parent is not None and (e.full in _NOISE or e.full == "ix:header" or re.search(r"display:\s?none", e.attrs.get("style", ""))):
            e.parent.children.remove(e)
    out: list[dict] = []
    candidates = [e for e in root.walk() if e.full in _BLOCKS]
    for n, e in enumerate(candidates):
        if any(x.full == "table" for x in e.up() if x is not e):
            continue
        if e.full == "table":
            rows = [x for x in e.walk() if x.full == "tr"]
            text = "\n".join(" | ".join(markup.normalize(c.text()) for c in r.walk() if c.full in ("td", "th")) for r in rows)
        elif any(x.full in _BLOCKS for x in e.walk() if x is not e):
            continue
        else:
            text = markup.normalize(e.text())
        if text and (not out or out[-1]["text"] != text):
            out.append({"ord": n, "text": text, "location": f"html-block-{n}", "is_table": e.full == "table"})
    return out


def html_blocks(pages: DataFrame, key: str, column: str) -> DataFrame:
    """(document_id, ord, text, location, is_table) rows of a column of HTML."""
    ship(pages.sparkSession)

    @F.pandas_udf(_BLOCK_SCHEMA)
    def blocks(pages: pd.Series) -> pd.Series:
        return pages.map(html_blocks_of)

    return pages.select(F.col(key).alias("document_id"), F.explode(blocks(F.col(column))).alias("b")).select("document_id", "b.*")


def page_blocks(files: DataFrame, key: str, column: str, reader: Callable[[bytes], list[str]]) -> DataFrame:
    """(document_id, ord, text, location, is_table): one block for each page with text of paged documents; `reader` gives the pages' texts."""
    ship(files.sparkSession)

    @F.pandas_udf(_BLOCK_SCHEMA)
    def read(raw: pd.Series) -> pd.Series:
        def one(content: bytes | None) -> list[dict]:
            texts = [markup.normalize(t or "") for t in reader(bytes(content))] if content else []
            return [{"ord": i, "text": t, "location": f"page-{i + 1}", "is_table": False} for i, t in enumerate(texts) if t]

        return raw.map(one)

    return files.select(F.col(key).alias("document_id"), F.explode(read(F.col(column))).alias("b")).select("document_id", "b.*")


def normalize(text: Column) -> Column:
    """NFKC by an Arrow UDF, as there is no built-in."""
    ship(SparkSession.active())
    lean(SparkSession.active())

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(markup.normalize, na_action="ignore")

    return run(text)


def collapse_space(text: Column) -> Column:
    """Runs of ASCII white space as one space, trimmed; all in the JVM."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))


def heading(text: Column) -> Column:
    """`Item 1A — Title` for a block that states an item heading, else null; pipes of table cells count as spaces."""
    cleaned = F.trim(F.regexp_replace(F.translate(text, "|", " "), r"\s+", " "))
    starts = cleaned.rlike(r"(?i)^ITEM\s+\d+[A-C]?")
    number = F.upper(F.regexp_extract(cleaned, r"(?i)^ITEM\s+(\d+[A-C]?)", 1))
    title = F.trim(F.regexp_extract(cleaned, r"(?i)^ITEM\s+\d+[A-C]?\s*[.\-–:]?\s*(.*)", 1))
    named = F.concat(F.lit("Item "), number, F.lit(" — "), F.when(F.length(title) < 120, title).otherwise(""))
    return F.when(starts & (F.length(cleaned) < 250), named)


def carry_sections(blocks: DataFrame, first: str = "Front matter") -> DataFrame:
    """`section`: the last heading seen in the document, the heading's own block included."""
    own = Window.partitionBy("document_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("section", F.coalesce(F.last(heading(F.col("text")), ignorenulls=True).over(own), F.lit(first)))


def islands(rows: DataFrame, by: list[str], order: list[str], scope: list[str], name: str = "island") -> DataFrame:
    """Numbers the maximal runs of equal scope in order, from 1."""
    own = Window.partitionBy(*by).orderBy(*order)
    new = F.when(F.row_number().over(own) == 1, 1).when(F.struct(*scope).eqNullSafe(F.lag(F.struct(*scope)).over(own)), 0).otherwise(1)
    return rows.withColumn("_new", new).withColumn(name, F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def without_repeats(rows: DataFrame, by: list[str], order: list[str], column: str) -> DataFrame:
    """Rows whose value differs from that of the row before."""
    own = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_before", F.lag(column).over(own)).withColumn("_n", F.row_number().over(own)).where((F.col("_n") == 1) | ~F.col("_before").eqNullSafe(F.col(column))).drop("_before", "_n")


def split_text(text: str, size: int, overlap: int, count: Callable[[str], int]) -> Iterator[tuple[int, int]]:
    """Character ranges of at most `size` tokens each, cut at white space where it lies in the latter half, with up to `overlap`
    tokens of the range before; every range goes further than the one before and none holds overlap alone."""
    for start, end, _ in _ranges(text, size, overlap, count):
        yield start, end


def _counter(text: str, count: Callable[[str], int]) -> Callable[[int, int], int]:
    """The tokens of text[a:b]; words are looked up among those of the whole text, which is read once."""
    if count is not words:
        return lambda a, b: count(text[a:b])
    found = [m.span() for m in re.finditer(r"\S+", text)]
    starts, ends = [a for a, _ in found], [b for _, b in found]
    return lambda a, b: bisect.bisect_left(starts, b) - bisect.bisect_right(ends, a) if a < b else 0


def _ranges(text: str, size: int, overlap: int, count: Callable[[str], int]) -> Iterator[tuple[int, int, int]]:
    """The ranges with their tokens."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be nonnegative and less than size")
    tokens = _counter(text, count)
    n, start = len(text), 0
    ends = [m.end() for m in re.finditer(r"\s+", text)]
    starts = {0, *ends}
    reach = 8 * size  # characters looked at, doubled until they exceed the budget: never the whole rest for each range
    while start < n:
        most = min(n, start + reach)
        while most < n and tokens(start, most) <= size:
            reach *= 2
            most = min(n, start + reach)
        if most == n and tokens(start, n) <= size:
            end = n
        else:
            fits = bisect.bisect_right(range(start + 1, most + 1), size, key=lambda e: tokens(start, e)) + start
            if fits == start:
                raise ValueError("a character exceeds the token budget")
            low = start + max(1, (fits - start) // 2)
            end = next((e for e in reversed(ends[bisect.bisect_left(ends, low) : bisect.bisect_right(ends, fits)]) if tokens(start, e) <= size), fits)
        if text[start:end].strip():
            yield start, end, tokens(start, end)
        if end >= n:
            return
        after = end
        if overlap:
            after = bisect.bisect_left(range(start + 1, end), True, key=lambda s: tokens(s, end) <= overlap) + start + 1
            if after not in starts:
                after = next((e for e in ends[bisect.bisect_left(ends, after) :] if e <= end), end)
        start = max(after, start + 1)


#: What a chunk never crosses; own_table is the location of a block that is a table.
SCOPE = ("section", "subsection", "page", "own_table", "is_table")


def words(text: str) -> int:
    return len(text.split())


def chunk(blocks: DataFrame, size: int = 700, overlap: int = 100, count: Callable[[str], int] = words, scope: tuple[str, ...] = SCOPE) -> DataFrame:
    """Chunks of blocks (document_id, ord, text, location, section, is_table[, subsection, page]), never across a change of scope: by
    default a section, subsection, page, or table.

    Runs of equal scope are joined by newlines in the JVM; only the cutting is a UDF, over one run at a time. source_spans name the
    blocks that a chunk touches, with their page, character ranges in them and, for tables, the rows; chunk_id is a digest of all that.
    A row belongs to a span from its first character on, the newline that ends it included.
    """
    ship(blocks.sparkSession)
    lean(blocks.sparkSession)
    absent = {name: F.lit(None).cast(kind) for name, kind in (("subsection", "string"), ("page", "int")) if name not in blocks.columns}
    blocks = blocks.withColumns(absent | {"own_table": F.when(F.col("is_table"), F.col("location"))})

    @F.pandas_udf("array<struct<first:int,last:int,tokens:int>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"first": a, "last": b, "tokens": n} for a, b, n in _ranges(t, size, overlap, count)])

    runs = islands(blocks, ["document_id"], ["ord"], list(scope), "run")
    own = Window.partitionBy("document_id", "run").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    placed = runs.withColumn("at", F.coalesce(F.sum(F.char_length("text") + 1).over(own), F.lit(0)).cast("int"))
    part = F.struct("ord", "at", "text", "location", "page", "is_table")
    of_run = [F.first(c).alias(c) for c in ("section", "subsection", "page")] + [F.bool_and("is_table").alias("is_table")]
    joined = placed.groupBy("document_id", "run").agg(*of_run, F.array_sort(F.collect_list(part)).alias("parts")).withColumn("text", F.array_join(F.transform("parts", lambda p: p["text"]), "\n"))
    cuts = joined.select("document_id", "run", "section", "subsection", "page", "is_table", "parts", "text", F.posexplode(cut(F.col("text"))).alias("n", "c"))

    def span(p: Column) -> Column:
        left = F.greatest(F.col("c.first"), p["at"]) - p["at"]
        right = F.least(F.col("c.last"), p["at"] + F.char_length(p["text"])) - p["at"]
        rows = lambda upto: F.char_length(F.substring(p["text"], F.lit(1), upto)) - F.char_length(F.replace(F.substring(p["text"], F.lit(1), upto), F.lit("\n"), F.lit(""))) + 1
        return F.struct(
            p["location"].alias("location"), left.alias("character_start"), right.alias("character_end"), p["page"].alias("page"), p["is_table"].alias("table"),
            F.when(p["is_table"], rows(left)).alias("table_row_start"), F.when(p["is_table"], rows(F.greatest(left, right - 1))).alias("table_row_end"),
            F.when(p["is_table"], (left > 0) & (F.substring(p["text"], left, F.lit(1)) != "\n")).alias("starts_mid_row"),
            F.when(p["is_table"], (right < F.char_length(p["text"])) & (F.substring(p["text"], right, F.lit(1)) != "\n")).alias("ends_mid_row"),
        )

    touched = F.filter("parts", lambda p: (p["at"] < F.col("c.last")) & (p["at"] + F.char_length(p["text"]) > F.col("c.first")) & (p["text"] != ""))
    spans = F.transform(touched, span)
    body = F.substring(F.col("text"), F.col("c.first") + 1, F.col("c.last") - F.col("c.first"))
    out = cuts.select("document_id", "run", "n", "section", "subsection", "page", "is_table", body.alias("text"), F.col("c.tokens").alias("token_count"), spans.alias("source_spans"))
    out = out.where(F.size("source_spans") > 0).withColumn("location", F.array_join(F.array_distinct(F.transform("source_spans", lambda s: s["location"])), ", "))
    return out.withColumn("chunk_id", F.left(F.sha2(F.to_json(F.struct("document_id", "n", "run", "section", "source_spans", "text")), 256), F.lit(24)))
