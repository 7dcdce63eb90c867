"""A batch of questions answered in one plan: routing, exact facts and calculations, retrieval, evidence, prose checks, responses.

Every question gets one row. A question that cannot be answered in full abstains with a reason; nothing is answered in part.
facts: (ticker, cik, fiscal_year, metric, value string, unit, period_start, period_end, accession_number, concept).
chunks: (ticker, fiscal_year, doc_id, section, text); vectors: (ticker, fiscal_year, doc_id, embedding).
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import models
from quillstone.functions.shipping import ship
from quillstone.operators import context, evidence, routing, views
from quillstone.operators import facts as fact_ops
from quillstone.operators import retrieval as find
from quillstone.operators.index import build as build_of
from quillstone.session import settled, small

_FACT = ("ticker", "cik", "metric", "value", "unit", "fiscal_year", "period_start", "period_end", "accession_number")


def inputs_of(routes: DataFrame) -> DataFrame:
    """(query_id, ticker, fiscal_year, role, metric): the facts that structured and mixed routes need, in order of role."""
    roles = F.create_map(*(x for k, v in fact_ops.ROLES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    wanted = routes.where(F.col("path").isin("structured", "mixed")).select("query_id", "tickers", "years", F.coalesce(roles[F.col("metric")], F.array("metric")).alias("needs"))
    cells = wanted.select("query_id", F.explode("tickers").alias("ticker"), "years", "needs").select("query_id", "ticker", F.explode("years").alias("fiscal_year"), "needs")
    return cells.select("query_id", "ticker", "fiscal_year", F.posexplode("needs").alias("role", "metric"))


def structured(routes: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts used, calculations, failures) of a batch; a missing fact or a failed calculation fails its question.

    The facts are read once, cut to what the batch needs."""
    found = settled(inputs_of(routes).join(facts, ["ticker", "fiscal_year", "metric"], "left"), "inputs")
    missing = found.where("value IS NULL").groupBy("query_id").agg(F.min(F.concat_ws(" ", "ticker", "fiscal_year", "metric")).alias("m")).select("query_id", F.concat(F.lit("unavailable: "), "m").alias("reason"))
    used = found.where("value IS NOT NULL")
    asked = routes.select("query_id", F.col("metric").alias("asked"), "operation")
    joined = used.join(small(asked), "query_id")
    one = F.struct(*_FACT)
    grown = joined.where("operation IS NOT NULL AND role = 0").groupBy("query_id", "ticker", "operation").agg(F.transform(F.array_sort(F.collect_list(F.struct("fiscal_year", one.alias("f")))), lambda x: x["f"]).alias("inputs"), F.max("fiscal_year").alias("fiscal_year"))
    grown = grown.select("query_id", "ticker", "fiscal_year", F.col("operation").alias("metric"), "inputs")
    made = joined.where(F.col("asked").isin(*fact_ops.ROLES) & F.col("operation").isNull()).groupBy("query_id", "ticker", "fiscal_year", "asked").agg(F.transform(F.array_sort(F.collect_list(F.struct("role", one.alias("f")))), lambda x: x["f"]).alias("inputs"))
    made = made.select("query_id", "ticker", "fiscal_year", F.col("asked").alias("metric"), "inputs")
    refused = routes.where(F.col("operation").isNotNull() & F.col("metric").isin(*fact_ops.ROLES)).select("query_id", F.lit("growth of derived metrics is unsupported").alias("reason"))
    calculations = settled(fact_ops.calculate(grown.union(made)), "calculations")
    failed = calculations.where("error IS NOT NULL").groupBy("query_id").agg(F.min("error").alias("reason"))
    return used, calculations, refused.union(missing).union(failed).groupBy("query_id").agg(F.min("reason").alias("reason"))


def lines(used: DataFrame, calculations: DataFrame, routes: DataFrame) -> DataFrame:
    """(query_id, lines): facts, then calculations, then who leads a growth of several companies."""
    spoken = lambda m: F.replace(m, F.lit("_"), F.lit(" "))
    one = used.select("query_id", F.lit(0).alias("kind"), "ticker", "fiscal_year", F.concat("ticker", F.lit(" · FY"), F.col("fiscal_year").cast("string"), F.lit(" · "), spoken(F.col("metric")), F.lit(": "), fact_ops.display(F.col("value"), F.col("unit"))).alias("line"))
    good = calculations.where("error IS NULL")
    two = good.select("query_id", F.lit(1).alias("kind"), "ticker", "fiscal_year", F.concat("ticker", F.lit(" · "), spoken(F.col("metric")), F.lit(": "), fact_ops.display(F.col("value"), F.col("unit"))).alias("line"))
    many = routes.where(F.col("operation").isNotNull() & (F.size("tickers") > 1)).select("query_id", "operation")
    top = fact_ops.leaders(good.join(small(many), "query_id"), ["query_id", "operation", "unit"], "ticker")
    three = top.select("query_id", F.lit(2).alias("kind"), F.lit("").alias("ticker"), F.lit(0).alias("fiscal_year"), F.concat(F.lit("Highest "), "operation", F.lit(": "), "leaders", F.lit(" ("), fact_ops.display(F.col("value"), F.col("unit")), F.lit(").")).alias("line"))
    every = one.union(two).union(three)
    return every.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("kind", "ticker", "fiscal_year", "line"))), lambda x: x["line"]).alias("lines"))


def scopes_of(routes: DataFrame) -> DataFrame:
    """(query_id, ticker, fiscal_year, scope): the filings that retrieval routes ask for."""
    cells = routes.where(F.col("path").isin("rag", "mixed")).select("query_id", F.explode("tickers").alias("ticker"), "years")
    return cells.select("query_id", "ticker", F.explode("years").alias("fiscal_year")).withColumn("scope", _scope()).distinct()


def _scope() -> Column:
    return F.concat_ws(":", "ticker", F.col("fiscal_year").cast("string"))


def narrative(routes: DataFrame, chunks: DataFrame, vectors: DataFrame, index: dict[str, DataFrame] | None = None, **how: object) -> tuple[DataFrame, DataFrame]:
    """(evidence, failures) of retrieval routes: chunks for every company and year asked for, or none. Questions that cannot be searched fail."""
    scopes = settled(scopes_of(routes), "scopes")
    asked = routes.where(F.col("path").isin("rag", "mixed")).select("query_id", F.col("question").alias("query"))
    known = (index["lengths"] if index is not None else chunks.withColumn("scope", _scope())).select("scope").distinct()
    errors = settled(find.question_errors(asked, scopes, known).where("reason <> 'unknown scope'"), "errors")  # an unknown scope has no evidence, which is said below
    queries = models.embed(asked.join(small(errors.select("query_id")), "query_id", "left_anti"), "query")
    scoped = chunks.withColumn("scope", _scope()) if "scope" not in chunks.columns else chunks
    found = find.retrieve(scoped, vectors if "scope" in vectors.columns else vectors.withColumn("scope", _scope()), queries, scopes=scopes.select("query_id", "scope"), index=index, **how)
    found = settled(found.join(scopes, ["query_id", "scope"]), "found")
    picked = scoped.select("scope", "doc_id", "section", "text").join(small(found), ["scope", "doc_id"])
    bare = scopes.join(found.select("query_id", "scope").distinct(), ["query_id", "scope"], "left_anti").groupBy("query_id").agg(F.min("scope").alias("s")).select("query_id", F.concat(F.lit("no evidence for "), "s").alias("reason"))
    return picked, errors.union(bare).groupBy("query_id").agg(F.min("reason").alias("reason"))


def extractive(records: DataFrame) -> DataFrame:
    """The stand-in for a text provider: for each question and scope one claim that names the section of its best evidence."""
    texts = records.where("fact_id IS NULL")
    best = texts.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "ticker", "fiscal_year").orderBy("ord"))).where("n = 1")
    said = F.concat(F.lit("The filing discusses this under "), F.regexp_replace(F.coalesce("section", F.lit("its text")), "[^A-Za-z ]", ""), F.lit("."))
    return best.select("query_id", F.col("ord").alias("claim"), said.alias("text"), F.array("evidence_id").alias("citation_ids"))


def by_provider(provider: models.WithFallback) -> Callable[[DataFrame], DataFrame]:
    """A synthesis by a text provider: one call a question, with its evidence and calculations as data. Failures come as rows with a category."""

    def synthesize(records: DataFrame) -> DataFrame:
        ship(records.sparkSession)
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "record"))), lambda x: x["record"])
        grouped = records.groupBy("query_id").agg(F.first("question").alias("question"), F.first("calculations").alias("calculations"), ordered.alias("evidence"))
        asked = grouped.select("query_id", views.messages(context.INSTRUCTIONS, F.col("question"), F.col("evidence"), F.col("calculations")).alias("messages"))

        @F.pandas_udf("struct<claims:array<struct<text:string,citation_ids:array<string>>>,failure:string>")
        def call(messages: pd.Series) -> pd.DataFrame:
            out = []
            for m in messages:
                try:
                    claims, _ = provider.generate(json.loads(m))
                    out.append((claims, None))
                except models.ProviderFailure as failure:
                    out.append((None, failure.category))
            return pd.DataFrame(out, columns=["claims", "failure"], dtype=object)

        answers = asked.select("query_id", call("messages").alias("a")).select("query_id", F.posexplode_outer("a.claims").alias("claim", "c"), F.col("a.failure").alias("failure"))
        return answers.select("query_id", F.coalesce("claim", F.lit(0)).alias("claim"), F.col("c.text").alias("text"), F.col("c.citation_ids").alias("citation_ids"), "failure")

    return synthesize


def evidence_of(used: DataFrame, picked: DataFrame) -> DataFrame:
    """Facts, then chunks, as records of one kind with their order in each question (`ord`) and evidence ids."""
    facts = views.fact_records(used.drop("role").dropDuplicates(["query_id", "ticker", "fiscal_year", "metric"]))
    facts = facts.withColumns({"fact_id": F.concat_ws("|", "ticker", F.col("fiscal_year").cast("string"), "metric"), "kind_": F.lit(0), "score": F.lit(1.0), "at": F.lit(0)})
    chunks = picked.withColumns({"kind_": F.lit(1), "at": F.col("position").cast("int"), "doc_id": F.col("doc_id").cast("string")}).drop("position", "scope", "how")
    both = facts.withColumn("doc_id", F.col("fact_id")).unionByName(chunks, allowMissingColumns=True)
    own = Window.partitionBy("query_id").orderBy("kind_", "at", "ticker", "fiscal_year", F.coalesce("metric", F.lit("")), "doc_id")
    placed = both.withColumns({"ord": F.row_number().over(own), "request_id": F.col("query_id").cast("string")}).drop("kind_", "at")
    return evidence.register(placed, "request_id", ("ord",))


def ask(questions: DataFrame, facts: DataFrame, chunks: DataFrame, vectors: DataFrame, synthesize: Callable[[DataFrame], DataFrame] = extractive, characters: int = 24_000, tokens: int = 28_720, index: dict[str, DataFrame] | None = None, **how: object) -> DataFrame:
    """(query_id, question_type, path, answer, abstained, reason, grounding_status, grounded, n_facts, n_calculations, evidence_ids, citations).

    Facts used are evidence, as retrieved chunks are. What a provider writes is kept only if every citation is known, the prose states no numbers
    and the cited evidence covers every company and year asked for. With `index`, chunks and vectors are those of the index.
    Tables of a few rows for each question are written to the shared folder, so that each is computed once and nothing stays in memory;
    `session.sweep` removes them. how: what `retrieval.retrieve` takes (reranker, min_score, below)."""
    routes = settled(routing.route(questions), "routes")
    used, calculations, failed = structured(routes, facts)
    failed = settled(failed, "failed")
    picked, bare = narrative(routes.join(small(failed.select("query_id")), "query_id", "left_anti"), chunks, vectors, index, **how)
    whole = settled(evidence_of(used, picked), "evidence")
    rag = F.col("path").isin("rag", "mixed")
    said = views.compact(calculations.where("error IS NULL"), ("query_id",))
    made = said.groupBy("query_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct(*(c for c in said.columns if c != "query_id"))))).alias("calculations"))
    asked = settled(routes.where(rag).join(made, "query_id", "left").select("query_id", "question", F.coalesce("calculations", F.lit("[]")).alias("calculations"), "years"), "asked")
    prepared = context.prepare(whole, asked, characters, tokens).join(asked, "query_id")
    over = context.summary(prepared, asked, characters, tokens).where("reason IS NOT NULL").select("query_id", "reason")
    over = settled(over, "over")
    prepared = settled(prepared.join(over, "query_id", "left_anti").where(F.col("fits")), "prepared")
    claims = synthesize(prepared)
    claims = claims if "failure" in claims.columns else claims.withColumn("failure", F.lit(None).cast("string"))
    claims = settled(claims.select(F.col("query_id").cast("string").alias("request_id"), "claim", "text", "citation_ids", "failure"), "claims")
    told_by = claims.where("failure IS NULL")
    registry = prepared.select("request_id", "evidence_id", "ticker", "fiscal_year")
    years = told_by.select("request_id", F.explode("citation_ids").alias("evidence_id")).join(registry, ["request_id", "evidence_id"]).groupBy("request_id").agg(F.collect_set("fiscal_year").alias("cited"))
    years = years.join(asked.select(F.col("query_id").cast("string").alias("request_id"), "years"), "request_id").select("request_id", F.array_intersect(F.transform("cited", lambda y: y.cast("int")), F.transform("years", lambda y: y.cast("int"))).alias("allowed_years"))
    judged = told_by.join(years, "request_id", "left").withColumn("allowed_years", F.coalesce("allowed_years", F.array().cast("array<int>")))
    requested = scopes_of(routes).select(F.col("query_id").cast("string").alias("request_id"), "ticker", "fiscal_year")
    asked_ids = told_by.select("request_id").distinct()
    gaps = settled(evidence.uncovered(requested.join(asked_ids, "request_id", "left_semi"), told_by, registry), "gaps").groupBy("request_id").agg(F.min(F.concat_ws(":", "ticker", F.col("fiscal_year").cast("string"))).alias("g"))
    first = lambda df, n: df.select("request_id", F.struct(F.lit(n).alias("n"), F.col("why")).alias("w"))
    rejected = (
        first(claims.where("failure IS NOT NULL").select("request_id", F.concat(F.lit("provider: "), "failure").alias("why")), 0)
        .union(first(evidence.citation_errors(told_by, registry).select("request_id", F.col("reason").alias("why")), 1))
        .union(first(evidence.unsafe_requests(judged).select("request_id", F.col("reason").alias("why")), 2))
        .union(first(gaps.select("request_id", F.concat(F.lit("citations do not cover "), "g").alias("why")), 3))
    )
    rejected = settled(rejected.groupBy("request_id").agg(F.min("w").alias("w")).select(F.col("request_id").alias("r_id"), F.col("w.why").alias("f3")), "rejected")
    told = told_by.groupBy(F.col("request_id").alias("t_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("claim", "text"))), lambda x: x["text"]).alias("claims"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("citation_ids")))).alias("cited"))
    told = settled(told, "told")
    ids = whole.join(routes.where(~rag).select("query_id"), "query_id", "left_semi").select("query_id", "evidence_id").union(prepared.select("query_id", "evidence_id"))
    ids = settled(ids.groupBy("query_id").agg(F.array_sort(F.collect_list("evidence_id")).alias("evidence_ids")), "ids")
    counts = used.groupBy("query_id").agg(F.count("*").alias("n_facts")).join(calculations.groupBy("query_id").agg(F.count("*").alias("n_calculations")), "query_id", "full_outer")
    counts = settled(counts, "counts")
    bare = settled(bare, "bare")
    fail = lambda df, name: df.select("query_id", F.col("reason").alias(name))
    out = routes.join(fail(failed, "f1"), "query_id", "left").join(fail(bare, "f2"), "query_id", "left").join(fail(over, "f4"), "query_id", "left").join(rejected, F.col("query_id").cast("string") == F.col("r_id"), "left")
    out = out.join(settled(lines(used, calculations, routes), "lines"), "query_id", "left").join(told, F.col("query_id").cast("string") == F.col("t_id"), "left").join(ids, "query_id", "left").join(counts, "query_id", "left")
    reason = F.coalesce("reason", "f1", "f2", "f4", F.when(rag, F.col("f3")), F.when(rag & F.col("claims").isNull(), F.lit("nothing was written")))
    out = out.withColumn("why", reason).withColumn("abstained", reason.isNotNull())
    kept = lambda c, other: F.when(~F.col("abstained"), c).otherwise(other)
    empty = F.array().cast("array<string>")
    answer = F.array_join(F.concat(F.coalesce("lines", empty), F.when(rag, F.coalesce("claims", empty)).otherwise(empty)), "\n")
    status: Column = F.when(F.col("abstained"), "abstained").when(F.col("path") == "structured", "facts_validated").otherwise("citations_validated_semantics_unverified")
    citations = F.when(rag, F.coalesce("cited", empty)).otherwise(F.coalesce("evidence_ids", empty))
    return out.select(
        "query_id", "question_type", "path", kept(answer, F.lit("Unable to provide a validated answer.")).alias("answer"), "abstained", F.col("why").alias("reason"), status.alias("grounding_status"),
        (~F.col("abstained") & (F.col("path") == "structured")).alias("grounded"), kept(F.coalesce("n_facts", F.lit(0)), F.lit(0)).cast("long").alias("n_facts"), kept(F.coalesce("n_calculations", F.lit(0)), F.lit(0)).cast("long").alias("n_calculations"),
        kept(F.coalesce("evidence_ids", empty), empty).alias("evidence_ids"), kept(citations, empty).alias("citations"),
    )


def resolve_reports(seen: DataFrame, reports: DataFrame, inline: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, issues) of all reports: every metric resolved from company facts, then reconciled with the filing's own observations.

    Facts that are not matched become issues of their stage; a fact is only what matched.
    """
    spark = seen.sparkSession
    dimension = fact_ops.metric_dimension(spark)
    grid = reports.select("document_id", F.col("ticker").alias("s_ticker"), F.col("fiscal_year").alias("s_year"), F.lpad(F.col("cik").cast("string"), 10, "0").alias("s_cik")).crossJoin(F.broadcast(dimension.select("metric").distinct()))  # documents by eleven metrics
    resolved = fact_ops.resolve(fact_ops.annual_candidates(seen, reports, dimension), grid)
    good = resolved.where("reason IS NULL").select("document_id", "metric", F.concat(F.lit("us-gaap:"), "concept").alias("concept"), "value", "unit", F.col("s_cik").alias("cik"), "kind", "period_start", "period_end")
    checked = fact_ops.reconcile(good, inline)
    joined = resolved.join(checked.withColumnRenamed("reason", "c_reason").select("document_id", "metric", "status", "c_reason"), ["document_id", "metric"], "left")
    keys = ["document_id", F.col("s_ticker").alias("ticker"), F.col("s_year").alias("fiscal_year"), "metric"]
    facts = joined.where("status = 'matched'").select(*keys, F.col("s_cik").alias("cik"), "concept", F.col("text").alias("value"), "unit", "kind", "period_start", "period_end", "accession_number")
    issues = joined.where("status IS NULL OR status <> 'matched'").select(*keys, F.when(F.col("reason").isNotNull(), "resolution").otherwise("reconciliation").alias("stage"), F.coalesce("status", F.lit("unresolved")).alias("status"), F.coalesce("reason", "c_reason").alias("reason"))
    return facts, issues


def build_index(chunks: DataFrame) -> dict[str, DataFrame]:
    """The tables of a retrieval index of chunks (ticker, fiscal_year, doc_id, section, text), which `ask` takes as index."""
    return build_of(chunks.withColumn("scope", _scope()))


def prepare_references(questions: DataFrame, facts: DataFrame, version: str) -> DataFrame:
    """Expected answers of questions (query_id, question, tickers, years, annotation_status, reviewed_version): reviewed ones of this
    corpus stay, unsupported ones expect abstention, structured ones what the facts give, all else is unresolved."""
    routes = settled(routing.route(questions), "routes")
    used, calculations, failed = structured(routes, facts)
    values = used.select("query_id", F.struct("ticker", "fiscal_year", "metric", "value", "unit").alias("x")).union(calculations.where("error IS NULL").select("query_id", F.struct("ticker", "fiscal_year", "metric", "value", "unit")))
    expected = values.groupBy("query_id").agg(F.array_sort(F.collect_list("x")).alias("expected"))
    joined = routes.join(questions.select("query_id", "annotation_status", "reviewed_version"), "query_id").join(failed.withColumnRenamed("reason", "failed"), "query_id", "left").join(expected, "query_id", "left")
    state = F.when((F.col("annotation_status") == "reviewed") & (F.col("reviewed_version") == version), "reviewed").when(F.col("question_type") == "UNSUPPORTED", "policy").when((F.col("path") == "structured") & F.col("failed").isNull() & F.col("expected").isNotNull(), "derived").otherwise("unresolved")
    return joined.select("query_id", "question_type", state.alias("reference"), F.when(state == "derived", F.col("expected")).alias("expected"))


def review_packet(questions: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Candidates for human labels: what retrieval offers for each narrative question, unlabelled, with the ids in scope."""
    picked, _ = narrative(settled(routing.route(questions), "routes"), chunks, vectors)
    return picked.select("query_id", "position", "ticker", "fiscal_year", "doc_id", "section", "text", F.lit(None).cast("boolean").alias("relevant"))
