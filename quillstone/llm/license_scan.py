"""Licence scans: TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest directory.

Segments of a file are its leading comment and, for files with a name of ``FILE_NAMES``, the whole text; and from elsewhere in a file each
line that holds a term of ``TRIGGERS``, all these lines together, the lines around each (up to ``BEFORE`` and ``AFTER`` of its paragraph, in
every combination) and each paragraph with a trigger, which may wrap within it. Segments and templates are sparse vectors of term
counts times inverse document frequency over the templates; terms of a segment that no template has count with the weight of a term
that one template has. Equal segments of all files are scored once.

A template counts for a segment at a cosine of at least ``THRESHOLD``, and only if the segment holds at least ``NAMED`` of the weight
of those terms that no other licence's template has (`apache`, `affero`, `mit-style`; versions aside): a notice of a licence without a template states
none. A segment states the licence of the best template if that of no other licence comes within ``MARGIN`` of it; else none.
A file states the licence of its best segment; a reservation of all rights gives way to a licence, ties go to the first by name.

A file is a *licence file* where its name is one of ``FILE_NAMES``, or where its name has no extension and its trigger lines or the
segment of the stated licence make up most of its words: a source file never is one for its header's sake.

A file without a stated licence inherits that of its nearest ancestor directory with a licence file: paths are joined with
directories, from the deepest. A directory with several licence files has the one of best cosine, then first by name.

All of it is DataFrame operations; templates are a fixed table. Files without a trigger are never exploded into terms, only
counted. The directories with licence files are broadcast if their counted number allows, else Spark shuffles and splits.

Defined results: null text states nothing; a null path has no directory and no licence file; every row gives one row.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.license_templates import TEMPLATES
from quillstone.llm.shared import materialize, maybe_broadcast, table

THRESHOLD, NAMED, MARGIN = 0.6, 0.5, 0.02
TRIGGERS = r"(?i)licen[cs]|copyright|all rights reserved|spdx|public domain|permission is (?:hereby )?granted|redistribution and use|warrant"
FILE_NAMES = r"(?i)^(?:un)?(?:licen[cs]e|copying|notice)(?:[._-].*)?$"

#: Lines before and after a trigger line that may belong to its notice, as notices wrap.
BEFORE, AFTER = 2, 3
#: The triggers where white space and comment marks may stand between their words.
WRAPPED = TRIGGERS.replace(" ", r"[\W_]+")
#: An empty line, but for marks, after any line.
_BLANK = r"\n[^\p{L}\p{N}\n]*(?=\n)"
#: What follows a licence's name and does not make it another one.
VERSION = "-[0-9].*$"
#: A name with an extension.
_EXTENSION = r".\.[^.]*$"
#: A leading comment between marks, and lines that are comments.
_OPEN_COMMENT = r"(?s)^\s*(?:/\*.*?\*/|<!--.*?-->|\"\"\".*?\"\"\"|\'\'\'.*?\'\'\'|\(\*.*?\*\))"
_COMMENT_LINE = r"^\s*(?:#|//|;|--|%|\*|'|!|dnl\b|rem\b|REM\b|\.\\\"|$)"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9][a-z0-9+.\-]*[a-z0-9+]|[a-z0-9]"), F.lit(0))


def _weighed(segments: DataFrame, keys: list[str], idf: DataFrame, rare: float) -> DataFrame:
    """keys, term, weight and norm of each segment."""
    counted = segments.select(*keys, F.explode("terms").alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))
    weighed = counted.join(F.broadcast(idf), "term", "left").select(*keys, "term", (F.col("tf") * F.coalesce("idf", F.lit(rare))).alias("weight"))
    return weighed


def _idf(templates: DataFrame, n: int) -> DataFrame:
    return templates.select("template", F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.round(F.log((1.0 + n) / (1.0 + F.count("*"))) + 1.0, 9).alias("idf"))


def stated(segments: DataFrame, keys: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """(keys, licence, cosine): the licence that each segment (keys, terms) states by the rules above."""
    spark = segments.sparkSession
    templates = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(TEMPLATES)], "template int, licence string, text string").withColumn("terms", terms(F.col("text")))
    idf = _idf(templates, len(TEMPLATES))
    rare = round(log((1.0 + len(TEMPLATES)) / 2.0) + 1.0, 9)
    of = _weighed(templates, ["template", "licence"], idf, rare)
    own_terms = of.groupBy("term").agg((F.count_distinct(F.regexp_replace("licence", VERSION, "")) == 1).alias("names"))
    of = of.join(own_terms, "term").select("template", "licence", "term", F.col("weight").alias("t_weight"), F.when(F.col("names"), F.col("weight") ** 2).otherwise(0.0).alias("named"))
    of = of.join(of.groupBy("template").agg(F.sqrt(F.sum(F.col("t_weight") ** 2)).alias("size"), F.sum("named").alias("of_named")), "template")
    of = materialize(of, "templates")  # some thousand rows, whatever is scanned
    dealt = segments.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys)  # once, as short texts; all sums below are of one segment
    own = _weighed(dealt, keys, idf, rare)
    norms = own.groupBy(*keys).agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("own"))
    dots = own.join(F.broadcast(of), "term").groupBy(*keys, "template", "licence", "size", "of_named").agg(F.sum(F.col("weight") * F.col("t_weight")).alias("dot"), F.sum("named").alias("named"))
    named = F.round("named", 6) >= F.round(NAMED * F.col("of_named"), 6)
    scored = dots.where(named).join(norms, keys).select(*keys, "licence", F.round(F.col("dot") / (F.col("size") * F.col("own")), 6).alias("cosine")).where(F.col("cosine") >= threshold - MARGIN)
    each = scored.groupBy(*keys, "licence").agg(F.max("cosine").alias("cosine"))
    best = each.groupBy(*keys).agg(F.max(F.struct("cosine", "licence")).alias("b"), F.array_sort(F.collect_list("cosine")).alias("cosines"))  # at most one for each licence that has a template
    second = F.when(F.size("cosines") > 1, F.element_at("cosines", -2)).otherwise(0.0)
    return best.where((F.col("b.cosine") >= threshold) & (F.round(F.col("b.cosine") - second, 6) >= MARGIN)).select(*keys, "b.licence", "b.cosine")


def n_words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)))


def _leading_comment(text: Column) -> Column:
    """The comment that a text begins with, after a line `#!`; empty if it begins with none."""
    body = F.regexp_replace(text, r"^#![^\n]*\n", "")
    lines = F.split(body, "\n")
    end = F.array_position(F.transform(lines, lambda x: ~x.rlike(_COMMENT_LINE)), True)
    marked = F.regexp_extract(body, _OPEN_COMMENT, 0)
    return F.when(marked != "", marked).otherwise(F.array_join(F.slice(lines, 1, F.when(end > 0, end - 1).otherwise(F.size(lines)).cast("int")), "\n"))


def _around(paragraph: Column) -> Column:
    """The lines around each trigger line of a paragraph: up to BEFORE lines before and AFTER after it."""
    lines = F.split(paragraph, "\n")
    at = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: F.element_at(lines, i).rlike(TRIGGERS))
    ranges = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(BEFORE + 1) for b in range(AFTER + 1) if a + b))
    cut = lambda i: F.transform(F.filter(ranges, lambda r: (i > r["a"]) & (i + r["b"] <= F.size(lines))), lambda r: F.array_join(F.slice(lines, i - r["a"], r["a"] + r["b"] + 1), "\n"))
    return F.flatten(F.transform(at, cut))


def segments(text: Column, path: Column, lines: Column) -> Column:
    """The distinct segments of a text whose trigger lines are given. Header comments and licence files need no trigger."""
    name = F.coalesce(F.element_at(F.split(path, "/"), -1), F.lit(""))
    paragraphs = F.filter(F.split(text, _BLANK), lambda p: p.rlike(WRAPPED))
    whole = F.array_distinct(F.filter(F.array(_leading_comment(text), F.when(name.rlike(FILE_NAMES), text).otherwise("")), lambda x: x.rlike(r"[\p{L}\p{N}]")))
    own = F.when(F.size(lines) > 0, F.array_append(lines, F.array_join(lines, "\n"))).otherwise(F.array().cast("array<string>"))
    found = F.array_distinct(F.concat(own, F.flatten(F.transform(paragraphs, _around)), paragraphs, whole))
    return F.when(text.rlike(WRAPPED), found).otherwise(whole)


def scan(files: DataFrame, path: str = "path", text: str = "text", key: str = "file_id") -> DataFrame:
    """(file_id, path, stated, cosine, is_licence_file, inherited, inherited_from, licence) for every file."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(TRIGGERS))
    head = files.select(F.col(key).alias("file_id"), F.col(path).alias("path"), F.xxhash64(text, path).alias("digest"), lines.alias("lines"), n_words(whole).alias("n_words"), whole.alias("text"))
    head = head.select("file_id", "path", "digest", segments(F.col("text"), F.col("path"), F.col("lines")).alias("segments"), "n_words", n_words(F.array_join("lines", "\n")).alias("n_head"))
    head = materialize(head, "headers")
    some = head.where(F.size("segments") > 0).select("file_id", "digest", "segments").dropDuplicates(["file_id", "digest"])
    parts = some.select(F.coalesce(F.col("file_id").cast("string"), F.lit("")).alias("f"), "digest", F.explode("segments").alias("line")).withColumn("of", F.unhex(F.md5("line")))
    # Each distinct segment is scored once, however many files hold it; few state a licence.
    found = materialize(stated(parts.select("of", "line").dropDuplicates(["of"]).select("of", terms(F.col("line")).alias("terms")), ["of"]), "segments")
    found = parts.select("f", "digest", "of", n_words(F.col("line")).alias("words")).join(maybe_broadcast(found, found.count()), "of")
    best = found.groupBy("f", "digest").agg(F.min(F.struct((F.col("licence") == "proprietary").alias("rights"), (-F.col("cosine")).alias("n"), "licence", (-F.col("words")).alias("words"))).alias("b"))
    best = materialize(best.select("f", F.col("digest").alias("f_digest"), F.col("b.licence").alias("stated"), (-F.col("b.n")).alias("cosine"), (-F.col("b.words")).alias("n_stated")), "stated")
    name, folder = F.element_at(F.split("path", "/"), -1), F.regexp_replace("path", "/?[^/]*$", "")
    files_ = head.join(maybe_broadcast(best, best.count()), (F.coalesce(F.col("file_id").cast("string"), F.lit("")) == F.col("f")) & (F.col("digest") == F.col("f_digest")), "left")
    is_file = F.coalesce(F.col("stated").isNotNull() & F.col("path").isNotNull() & (name.rlike(FILE_NAMES) | (~name.rlike(_EXTENSION) & (2 * F.greatest("n_head", "n_stated") > F.col("n_words")))), F.lit(False))
    files_ = files_.select("file_id", "digest", "path", folder.alias("folder"), "stated", "cosine", is_file.alias("is_licence_file"))
    files_ = materialize(files_, "scanned")
    folders = files_.where("is_licence_file").groupBy("folder").agg(F.min(F.struct((-F.col("cosine")).alias("n"), F.col("stated").alias("licence"))).alias("b")).select(F.col("folder").alias("from_folder"), F.col("b.licence").alias("inherited"))
    folders = materialize(folders, "folders")
    parts_ = F.split("folder", "/")
    chain = files_.where("stated IS NULL AND folder IS NOT NULL").select("folder").distinct()
    chain = chain.select("folder", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts_)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts_, 1, i), "/").alias("above")))).alias("a")).select("folder", "a.depth", "a.above")
    nearest = chain.join(maybe_broadcast(folders, folders.count()), F.col("above") == F.col("from_folder")).groupBy("folder").agg(F.max(F.struct("depth", "from_folder", "inherited")).alias("b"))
    nearest = nearest.select(F.col("folder").alias("n_folder"), "b.inherited", F.col("b.from_folder").alias("inherited_from"))
    nearest = materialize(nearest, "nearest")
    out = files_.join(maybe_broadcast(nearest, nearest.count()), (F.col("folder") == F.col("n_folder")) & F.col("stated").isNull(), "left")
    return out.select("file_id", "path", "stated", "cosine", "is_licence_file", "inherited", "inherited_from", F.coalesce("stated", "inherited").alias("licence"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files source/thousand/hundred/doc_id: which licence each states, or inherits along that path."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.col("source"), F.floor(F.col("doc_id") / 1000).cast("string"), F.floor(F.col("doc_id") / 100).cast("string"), F.col("doc_id").cast("string"))
    return scan(docs.select("doc_id", "text", path.alias("path")), key="doc_id").withColumnRenamed("file_id", "doc_id")


_TEMPLATES_SQL = ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(TEMPLATES))
_TERM_SQL = r"regexp_extract_all(lower({}), '[a-z0-9][a-z0-9+.\-]*[a-z0-9+]|[a-z0-9]')"

ORACLE = f"""
WITH t AS (SELECT template, licence, unnest({_TERM_SQL.format('text')}) AS term FROM (VALUES {_TEMPLATES_SQL}) AS v(template, licence, text)),
idf AS (SELECT term, round(ln({len(TEMPLATES) + 1.0} / (1.0 + count(DISTINCT template))) + 1.0, 9) AS idf FROM t GROUP BY term),
tw AS (SELECT template, licence, term, count(*) * any_value(idf) AS w FROM t JOIN idf USING (term) GROUP BY ALL),
names AS (SELECT term FROM t GROUP BY term HAVING count(DISTINCT regexp_replace(licence, '{VERSION}', '')) = 1),
ts AS (SELECT template, sqrt(sum(w * w)) AS size, coalesce(sum(w * w) FILTER (term IN (SELECT term FROM names)), 0) AS of_named FROM tw GROUP BY template),
d AS (SELECT doc_id, concat_ws('/', source, CAST(doc_id // 1000 AS VARCHAR), CAST(doc_id // 100 AS VARCHAR), CAST(doc_id AS VARCHAR)) AS path, len(regexp_extract_all(coalesce(text, ''), '\\S+')) AS n_words,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{TRIGGERS}')) AS ls FROM documents),
seg AS (SELECT doc_id, unnest(range(0, len(ls) + 1)) AS seg, unnest(list_append(ls, array_to_string(ls, chr(10)))) AS line FROM d WHERE len(ls) > 0),
st AS (SELECT doc_id, seg, term, count(*) * coalesce(any_value(idf), round(ln({len(TEMPLATES) + 1.0} / 2.0) + 1.0, 9)) AS w FROM (SELECT doc_id, seg, unnest({_TERM_SQL.format('line')}) AS term FROM seg) LEFT JOIN idf USING (term) GROUP BY ALL),
ss AS (SELECT doc_id, seg, sqrt(sum(w * w)) AS own FROM st GROUP BY ALL),
c AS (SELECT doc_id, seg, licence, round(sum(st.w * tw.w) / (any_value(size) * any_value(own)), 6) AS cosine FROM st JOIN tw USING (term) JOIN ts USING (template) JOIN ss USING (doc_id, seg) GROUP BY doc_id, seg, template, licence
  HAVING round(coalesce(sum(tw.w * tw.w) FILTER (term IN (SELECT term FROM names)), 0), 6) >= round({NAMED} * any_value(of_named), 6)),
e AS (SELECT doc_id, seg, licence, max(cosine) AS cosine FROM c GROUP BY ALL),
s AS (SELECT doc_id, licence, cosine, coalesce(lead(cosine) OVER (PARTITION BY doc_id, seg ORDER BY cosine DESC), 0) AS second, row_number() OVER (PARTITION BY doc_id, seg ORDER BY cosine DESC) AS r FROM e),
b AS (SELECT doc_id, licence AS stated, cosine FROM s WHERE r = 1 AND cosine >= {THRESHOLD} AND round(cosine - second, 6) >= {MARGIN} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY licence = 'proprietary', cosine DESC, licence) = 1),
f AS (SELECT d.doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS folder, stated, cosine, stated IS NOT NULL AND 2 * len(regexp_extract_all(array_to_string(ls, chr(10)), '\\S+')) > n_words AS is_licence_file FROM d LEFT JOIN b ON b.doc_id = d.doc_id),
o AS (SELECT folder AS from_folder, stated AS inherited FROM f WHERE is_licence_file QUALIFY row_number() OVER (PARTITION BY folder ORDER BY cosine DESC, stated) = 1),
h AS (SELECT f.doc_id, inherited, from_folder AS inherited_from FROM f JOIN o ON stated IS NULL AND (folder = from_folder OR starts_with(folder, from_folder || '/') OR from_folder = '') QUALIFY row_number() OVER (PARTITION BY f.doc_id ORDER BY length(from_folder) DESC) = 1)
SELECT f.doc_id, path, stated, cosine, is_licence_file, inherited, inherited_from, coalesce(stated, inherited) AS licence FROM f LEFT JOIN h ON h.doc_id = f.doc_id
"""
