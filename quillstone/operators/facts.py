"""Annual financial facts: resolution, reconciliation, derived metrics, growth, availability and ranking.

All inputs are batches. A metric that cannot be given is a null value with a reason, never a zero. Facts are rows
(entity, fiscal_year, metric, value) with value a decimal string or DECIMAL; keys can be renamed by parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.functions import long_division
from quillstone.functions.decimals import cagr38, growth38, native, order_key, ratio38

# Metric, concepts in order of priority, unit, kind, whether negative values are refused.
METRICS = [
    ("revenue", ["RevenueFromContractWithCustomerExcludingAssessedTax", "SalesRevenueNet", "Revenues"], "USD", "duration", True),
    ("gross_profit", ["GrossProfit"], "USD", "duration", False),
    ("operating_income", ["OperatingIncomeLoss"], "USD", "duration", False),
    ("net_income", ["NetIncomeLoss"], "USD", "duration", False),
    ("eps", ["EarningsPerShareDiluted"], "USD/shares", "duration", False),
    ("assets", ["Assets"], "USD", "instant", True),
    ("liabilities", ["Liabilities"], "USD", "instant", False),
    ("equity", ["StockholdersEquity"], "USD", "instant", False),
    ("cash", ["CashAndCashEquivalentsAtCarryingValue"], "USD", "instant", True),
    ("operating_cash_flow", ["NetCashProvidedByUsedInOperatingActivities"], "USD", "duration", False),
    ("capex", ["PaymentsToAcquirePropertyPlantAndEquipment"], "USD", "duration", True),
]
ANNUAL_DAYS = (350, 380)


def metric_dimension(spark: SparkSession) -> DataFrame:
    """(metric, concept, priority, unit, kind, nonnegative): eleven metrics, one row for each concept."""
    rows = [(m, c, i, unit, kind, low) for m, concepts, unit, kind, low in METRICS for i, c in enumerate(concepts)]
    return spark.createDataFrame(rows, "metric string, concept string, priority int, unit string, kind string, nonnegative boolean")


def is_annual(start: Column, end: Column) -> Column:
    return F.datediff(end, start).between(*ANNUAL_DAYS)


def observations(companyfacts: DataFrame) -> DataFrame:
    """Company-facts documents (cik, facts.`us-gaap` map of concept to units to observations) as rows."""
    concepts = companyfacts.select("cik", F.explode(F.col("facts")["us-gaap"]).alias("concept", "body"))
    units = concepts.select("cik", "concept", F.explode("body.units").alias("unit", "seen"))
    return units.select("cik", "concept", "unit", F.posexplode("seen").alias("ord", "o")).select("cik", "concept", "unit", "ord", "o.*")


def annual_candidates(seen: DataFrame, reports: DataFrame, dimension: DataFrame) -> DataFrame:
    """Observations of each report's own filing, period and year, one row for each metric, with `error` where one is unusable.

    seen: (cik, concept, unit, val, start, end, fy, fp, form, accn, dimensions). reports: (document_id, ticker, cik, fiscal_year,
    filing_type, accession_number, period_end, period_start?).
    """
    report = reports.select("document_id", "ticker", F.col("cik").cast("long").alias("r_cik"), "fiscal_year", "filing_type", "accession_number", F.col("period_end").cast("date").alias("r_end"), *([F.col("period_start").cast("date").alias("r_start")] if "period_start" in reports.columns else [F.lit(None).cast("date").alias("r_start")]))
    joined = seen.join(F.broadcast(dimension).withColumnRenamed("unit", "m_unit"), "concept").join(report, (F.col("cik").cast("long") == F.col("r_cik")) & (F.col("accn") == F.col("accession_number")))
    start, end = F.col("start").try_cast("date"), F.col("end").try_cast("date")
    own = (F.col("form") == F.col("filing_type")) & (F.col("fy") == F.col("fiscal_year")) & (F.col("fp") == "FY") & (end == F.col("r_end")) & (F.col("unit") == F.col("m_unit"))
    timed = F.when(F.col("kind") == "duration", is_annual(start, end) & (F.col("r_start").isNull() | (start == F.col("r_start")))).otherwise(start.isNull())
    dimensional = F.coalesce(F.size(F.map_keys("dimensions")) > 0, F.lit(False)) if "dimensions" in seen.columns else F.lit(False)
    value = native(F.col("val"))
    error = F.when(dimensional, "dimensional observation").when(value.isNull(), "value is not a finite decimal").when(F.col("nonnegative") & (value < 0), "negative value for a nonnegative metric")
    return joined.where(own & timed).select("document_id", "ticker", "fiscal_year", "metric", "concept", "priority", "unit", "kind", "accession_number", F.col("val").alias("text"), value.alias("value"), start.alias("period_start"), end.alias("period_end"), error.alias("error"))


def resolve(candidates: DataFrame, slots: DataFrame) -> DataFrame:
    """One row for each (document, metric) slot: the agreed value, or why there is none.

    All candidates must agree on (value, start, end) across concepts; conflict is never settled by picking the latest.
    The representative is of the first concept by priority, then the least digest.
    """
    same = F.struct("value", "period_start", "period_end")
    digest = F.sha2(F.to_json(F.struct("concept", "period_end", "period_start", "text", "unit")), 256)
    agreed = candidates.groupBy("document_id", "metric").agg(
        F.min("error").alias("error"), F.size(F.collect_set(same)).alias("n"), F.count("*").alias("agreeing"),
        F.min_by(F.struct("concept", "text", "value", "unit", "kind", "period_start", "period_end", "accession_number"), F.struct("priority", digest.alias("digest"))).alias("pick"),
    )
    reason = F.when(F.col("agreeing").isNull(), "no annual observation").when(F.col("error").isNotNull(), F.col("error")).when(F.col("n") > 1, "conflicting observations")
    out = slots.join(agreed, ["document_id", "metric"], "left").withColumn("reason", reason)
    good = F.col("reason").isNull()
    return out.select(*slots.columns, *(F.when(good, F.col(f"pick.{c}")).alias(c) for c in ("concept", "text", "value", "unit", "kind", "period_start", "period_end", "accession_number")), F.coalesce("agreeing", F.lit(0)).alias("agreeing"), "reason")


def reconcile(facts: DataFrame, seen: DataFrame) -> DataFrame:
    """Facts against the filing's own inline observations: matched, conflict or not_verified, with the reason.

    facts: (document_id, metric, concept, value, unit, cik, kind, period_start, period_end). seen: (document_id, concept, status,
    value, unit, hidden, context struct<cik, kind, period_start, period_end, dimensional>). Periods are compared null-safely,
    as instants have no start.
    """
    f, o = facts.alias("f"), seen.alias("o")
    joined = f.join(o, (F.col("f.document_id") == F.col("o.document_id")) & (F.col("f.concept") == F.col("o.concept")), "left")
    ctx = F.col("o.context")
    scoped = ctx["cik"].eqNullSafe(F.col("f.cik")) & ctx["kind"].eqNullSafe(F.col("f.kind")) & ctx["period_start"].eqNullSafe(F.col("f.period_start")) & ctx["period_end"].eqNullSafe(F.col("f.period_end"))
    number = F.col("o.value")
    role = (
        F.when(F.col("o.document_id").isNull(), "absent")
        .when(F.col("o.status") != "parsed", F.when(ctx.isNull() | scoped, "blocker").otherwise("ignored"))
        .when(ctx.isNull(), "blocker").when(~scoped, "ignored").when(F.coalesce(ctx["dimensional"], F.lit(False)), "ignored")
        .when(~F.col("o.unit").eqNullSafe(F.col("f.unit")), "blocker").when(number.isNull(), "blocker").otherwise("eligible")
    )
    keyed = joined.select("f.*", role.alias("role"), (number != F.col("f.value")).alias("differs"), (F.col("o.hidden") == F.lit(False)).alias("visible"))
    eligible = F.col("role") == "eligible"
    summed = keyed.groupBy("document_id", "metric").agg(
        F.count_if(eligible).alias("eligible"), F.count_if(F.col("role") == "blocker").alias("blockers"),
        F.coalesce(F.bool_or(eligible & F.col("differs")), F.lit(False)).alias("conflicts"), F.coalesce(F.bool_or(eligible & F.col("visible")), F.lit(False)).alias("seen_visible"),
    )
    status = F.when(F.col("conflicts"), "conflict").when((F.col("blockers") > 0) | (F.col("eligible") == 0) | ~F.col("seen_visible"), "not_verified").otherwise("matched")
    reason = F.when(F.col("conflicts"), "inline value differs").when(F.col("blockers") > 0, "observation in scope cannot be compared").when(F.col("eligible") == 0, "no observation in scope").when(~F.col("seen_visible"), "only hidden observations agree")
    return summed.select("document_id", "metric", "eligible", "blockers", status.alias("status"), reason.alias("reason"))


def unblocked(facts: DataFrame, issues: DataFrame) -> DataFrame:
    """Facts without an issue for their metric in the same document, or the same entity and year: two anti-joins, no OR."""
    one = facts.join(issues.select("document_id", "metric").distinct(), ["document_id", "metric"], "left_anti")
    return one.join(issues.select("ticker", "fiscal_year", "metric").where("ticker IS NOT NULL").distinct(), ["ticker", "fiscal_year", "metric"], "left_anti")


def wide(facts: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """One row for each key with a column for each metric; a cell with several values is null."""
    pick = lambda m: F.when(F.count_if(F.col("metric") == m) == 1, F.max(F.when(F.col("metric") == m, F.col("value"))))
    return facts.groupBy(*keys).agg(*(pick(m).alias(m) for m in metrics))


def derived(table: DataFrame) -> DataFrame:
    """Free cash flow and margins (doubles, in percent) of a wide table; null without a positive revenue or an input."""
    d = lambda c: F.col(c).cast("double")
    percent = lambda x: F.when(d("revenue") > 0, x / d("revenue") * 100)
    return table.withColumns({
        "free_cash_flow": F.col("operating_cash_flow") - F.col("capex"),
        "operating_margin": percent(d("operating_income")), "net_margin": percent(d("net_income")), "fcf_margin": percent((F.col("operating_cash_flow") - F.col("capex")).cast("double")),
    })


def derived38(table: DataFrame) -> DataFrame:
    """The same margins as decimal strings of 38 significant digits, without Python; the metrics are DECIMAL columns."""
    percent = lambda x: long_division.ratio38(x, F.col("revenue"))
    return table.withColumns({"operating_margin": percent(F.col("operating_income")), "net_margin": percent(F.col("net_income")), "fcf_margin": percent(F.col("operating_cash_flow") - F.col("capex"))})


def growth(facts: DataFrame, entity: str = "entity", base_year: int | None = None, precise: bool = False) -> DataFrame:
    """Growth on the year before (and CAGR since base_year) of each (entity, metric), with a reason where there is none."""
    own = Window.partitionBy(entity, "metric").orderBy("fiscal_year")
    out = facts.withColumn("b_year", F.lag("fiscal_year").over(own)).withColumn("b_value", F.lag("value").over(own))
    base = F.when(F.col("b_year") == F.col("fiscal_year") - 1, F.col("b_value"))
    typed = dict(facts.dtypes)["value"].startswith("decimal")  # strings may have more digits than DECIMAL
    exact = long_division.growth38(base, F.col("value")) if typed else growth38(base.cast("string"), F.col("value").cast("string"))
    pct = exact if precise else F.when(base > 0, (F.col("value").cast("double") - base.cast("double")) / base.cast("double") * 100)
    out = out.withColumn("growth", pct).withColumn("growth_reason", F.when(F.col("value").isNull(), "value unavailable").when(base.isNull(), "no value for the year before").when(base <= 0, "base is not positive"))
    if base_year is not None:
        first = facts.where(F.col("fiscal_year") == base_year).select(F.col(entity).alias("b_entity"), F.col("metric").alias("b_metric"), F.col("value").alias("c_base"))
        out = out.join(first, (F.col(entity) == F.col("b_entity")) & (F.col("metric") == F.col("b_metric")), "left")
        years = F.col("fiscal_year") - base_year
        root = cagr38(F.col("c_base").cast("string"), F.col("value").cast("string"), years) if precise else F.when((F.col("c_base") > 0) & (F.col("value") > 0) & (years > 0), (F.pow(F.col("value").cast("double") / F.col("c_base").cast("double"), 1 / years) - 1) * 100)
        out = out.withColumn("cagr", root).withColumn("cagr_reason", F.when(years <= 0, "not after the base year").when(F.col("c_base").isNull(), "no value for the base year").when((F.col("c_base") <= 0) | (F.col("value") <= 0), "values are not positive")).drop("b_entity", "b_metric", "c_base")
    return out.drop("b_year", "b_value")


def availability(grid: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """The full grid of (keys, metric), each with its value or the reason why it is unavailable."""
    return grid.join(facts, [*keys, "metric"], "left").withColumn("reason", F.when(F.col("value").isNull(), F.lit("not reported")))


def analytics(cells: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key: map of values, map of reasons, and a status."""
    entry = lambda when, v: F.map_from_entries(F.array_sort(F.collect_list(F.when(when, F.struct("metric", v)))))
    has = F.col("value").isNotNull()
    out = cells.groupBy(*keys).agg(entry(has, F.col("value").cast("string").alias("v")).alias("values"), entry(~has, F.col("reason").alias("v")).alias("unavailable_metrics"))
    return out.withColumn("status", F.when(F.size("unavailable_metrics") == 0, "complete").when(F.size("values") == 0, "unavailable").otherwise("partial"))


def rank_competition(facts: DataFrame, by: list[str], entity: str = "entity") -> DataFrame:
    """Ranks 1, 1, 3 by value, greatest first; missing values have no rank. Strings are compared as exact decimals."""
    key = order_key(F.col("value")) if dict(facts.dtypes)["value"] == "string" else F.col("value")
    ranked = facts.withColumn("k", key).where(F.col("k").isNotNull())
    return ranked.withColumn("rank", F.rank().over(Window.partitionBy(*by).orderBy(F.desc("k")))).drop("k")


def leaders(facts: DataFrame, by: list[str], entity: str = "entity") -> DataFrame:
    """All entities that share the greatest value, joined by commas in order of name."""
    top = rank_competition(facts, by, entity).where(F.col("rank") == 1)
    return top.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set(entity)), ", ").alias("leaders"), F.max("value").alias("value"))


#: Inputs of derived metrics, in the order that they must have.
ROLES = {"free_cash_flow": ["operating_cash_flow", "capex"], "operating_margin": ["operating_income", "revenue"], "net_margin": ["net_income", "revenue"], "fcf_margin": ["operating_cash_flow", "capex", "revenue"]}


def input_error(metric: Column, inputs: Column) -> Column:
    """The first rule that an array of input facts breaks for a calculation, or null.

    inputs: array<struct<ticker, cik, metric, value string, unit, fiscal_year int, period_start date, period_end date, accession_number>>.
    """
    every = lambda f: F.forall(inputs, f)
    alike = lambda f: F.size(F.array_distinct(F.transform(inputs, f))) == 1
    roles = F.create_map(*(x for k, v in ROLES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    role = roles[metric]
    first, last = F.get(inputs, 0), F.get(inputs, 1)
    number = lambda x: native(x["value"])
    return (
        F.when(inputs.isNull() | (F.size(inputs) == 0), "no inputs")
        .when(~metric.isin(*ROLES, "growth", "cagr"), "unsupported calculation")
        .when(~every(lambda x: x["fiscal_year"].isNotNull() & (F.coalesce(x["accession_number"], F.lit("")) != "") & x["period_end"].isNotNull()), "input lacks its scope")
        .when(~every(lambda x: x["period_start"].isNull() | is_annual(x["period_start"], x["period_end"])), "input is not annual")
        .when(~alike(lambda x: F.struct(x["ticker"], x["cik"])), "inputs of several companies")
        .when(~alike(lambda x: x["unit"]) | ~every(lambda x: F.coalesce(x["unit"].isin("USD", "USD/shares"), F.lit(False))), "units disagree or are unsupported")
        .when(role.isNotNull() & ~F.transform(inputs, lambda x: x["metric"]).eqNullSafe(role), "roles disagree")
        .when(role.isNotNull() & (first["unit"] != "USD"), "margins and free cash flow need USD")
        .when(role.isNotNull() & (~alike(lambda x: F.struct(x["fiscal_year"], x["period_start"], x["period_end"], x["accession_number"])) | first["period_start"].isNull()), "inputs of several periods")
        .when(role.isNull() & ((F.size(inputs) != 2) | ~alike(lambda x: x["metric"])), "growth needs two values of one metric")
        .when(role.isNull() & (first["fiscal_year"] >= last["fiscal_year"]), "years must ascend")
        .when(role.isNull() & (first["period_end"] >= last["period_end"]), "period ends must ascend")
        .when(role.isNull() & (first["period_start"].isNull() != last["period_start"].isNull()), "instant and duration mixed")
        .when(~every(lambda x: number(x).isNotNull()), "value is not a finite decimal")
        .when(~every(lambda x: (x["metric"] != "capex") | (number(x) >= 0)), "capex must be a nonnegative outflow")
        .when(role.isNotNull() & (metric != "free_cash_flow") & ~F.coalesce(number(F.element_at(inputs, -1)) > 0, F.lit(False)), "revenue must be positive")
        .when(role.isNull() & ~F.coalesce(number(first) > 0, F.lit(False)), "base must be positive")
        .when((metric == "cagr") & ~F.coalesce(number(last) > 0, F.lit(False)), "end must be positive")
    )


def calculate(requests: DataFrame) -> DataFrame:
    """requests (metric, inputs): error, or the value as a decimal string of 38 digits, with unit and an id over all inputs."""
    checked = requests.withColumn("error", input_error(F.col("metric"), F.col("inputs")))
    v = lambda i: F.when(F.col("error").isNull(), F.get("inputs", i)["value"])
    less = F.when(F.col("error").isNull(), (native(v(0)) - native(v(1))).cast("string"))
    m = F.col("metric")
    value = (
        F.when(m == "free_cash_flow", less).when(m == "fcf_margin", ratio38(less, v(2))).when(m.isin("operating_margin", "net_margin"), ratio38(v(0), v(1)))
        .when(m == "growth", growth38(v(0), v(1))).when(m == "cagr", cagr38(v(0), v(1), F.get("inputs", 1)["fiscal_year"] - F.get("inputs", 0)["fiscal_year"]))
    )
    return checked.select("*", F.when(F.col("error").isNull(), value).alias("value"), F.when(m == "free_cash_flow", "USD").otherwise("percentage").alias("unit"), F.left(F.sha2(F.to_json(F.struct("inputs", "metric")), 256), F.lit(24)).alias("calculation_id"))


def display(value: Column, unit: Column) -> Column:
    """Money as $x.xxB, M, K or plain, percentages with a sign, per-share amounts; half-even at two digits."""
    v = value.cast("decimal(24,6)")
    cut = lambda x: F.bround(x.cast("decimal(30,10)"), 2).cast("decimal(38,2)").cast("string")
    scaled = lambda by, tag: F.concat(F.lit("$"), cut(v / by), F.lit(tag))
    money = F.when(F.abs(v) >= 1_000_000_000, scaled(1_000_000_000, "B")).when(F.abs(v) >= 1_000_000, scaled(1_000_000, "M")).when(F.abs(v) >= 1000, scaled(1000, "K")).otherwise(scaled(1, ""))
    two = cut(v)
    return F.when(unit == "USD", money).when(unit == "percentage", F.concat(two, F.lit("%"))).otherwise(F.concat_ws(" ", two, unit))
