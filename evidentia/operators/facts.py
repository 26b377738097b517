"""Choosing reported figures: annual facts, original filings, tag preferences.

Choices among duplicates are min/max aggregates over an ordering struct, so
they combine on the map side and a company with very many facts does not land
in one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.sources.tables import METRICS

# The label each reported tag stands for.
TAG_LABELS = {
    "RevenueFromContractWithCustomerExcludingAssessedTax": "total revenue",
    "Revenues": "total revenue",
    "CostOfGoodsAndServicesSold": "cost of revenue",
    "CostOfRevenue": "cost of revenue",
    "OperatingIncomeLoss": "operating income",
    "ResearchAndDevelopmentExpense": "research and development expense",
    "OperatingExpenses": "total operating expenses",
}
# Tags to try for a field, best first.
FIELD_TAGS = {
    "revenue": ["RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues"],
    "cost": ["CostOfGoodsAndServicesSold", "CostOfRevenue"],
    "rnd": ["ResearchAndDevelopmentExpense"],
}
ANNUAL_FORMS = ["10-K", "10-K/A"]
FAR = "9999-99-99"


def usable_fact(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("val").isNotNull() & (F.coalesce(F.col("end").cast("string"), F.lit("")) != ""))


def is_annual(form: str = "form", start: str = "start", end: str = "end") -> Column:
    """On an annual form and spanning about a year; a date that does not parse is not annual."""
    days = F.datediff(F.to_date(F.try_to_timestamp(F.col(end).cast("string"), F.lit("yyyy-MM-dd"))),
                      F.to_date(F.try_to_timestamp(F.col(start).cast("string"), F.lit("yyyy-MM-dd"))))
    return F.col(form).isin(*ANNUAL_FORMS) & F.coalesce(days.between(330, 400), F.lit(False))


def original_filing(facts: DataFrame, by: list[str] = ["ticker", "tag"]) -> DataFrame:
    """Latest annual period per key and, within it, the filing that reported it first."""
    rest = [c for c in facts.columns if c not in by]
    first = F.struct(-F.unix_date(F.col("end").cast("date")), F.coalesce(F.col("filed").cast("string"), F.lit(FAR)), F.col("accn"))
    return facts.filter(is_annual()).groupBy(*by).agg(F.min_by(F.struct(*rest), first).alias("f")).select(*by, "f.*")


def original_by_year(facts: DataFrame, by: list[str] = ["ticker", "tag"]) -> DataFrame:
    """Earliest annual filing per key and fiscal year; facts without a year are dropped."""
    rest = [c for c in facts.columns if c not in (*by, "fy")]
    first = F.struct(F.coalesce(F.col("filed").cast("string"), F.lit(FAR)), F.col("accn"))
    annual = facts.filter(is_annual() & F.col("fy").isNotNull())
    return annual.groupBy(*by, "fy").agg(F.min_by(F.struct(*rest), first).alias("f")).select(*by, "fy", "f.*")


def tag_table(spark: SparkSession, fields: dict[str, list[str]] = FIELD_TAGS) -> DataFrame:
    rows = [(f, t, k) for f, tags in fields.items() for k, t in enumerate(tags)]
    return spark.createDataFrame(rows, "field string, tag string, priority int")


def tag_fallback(facts: DataFrame, fields: dict[str, list[str]] = FIELD_TAGS) -> DataFrame:
    """Per company and field all facts under the first preferred tag that has any; whether one is annual is decided afterwards."""
    prefs = F.broadcast(tag_table(facts.sparkSession, fields))
    named = facts.join(prefs, "tag")
    chosen = named.groupBy("ticker", "field").agg(F.min("priority").alias("priority"))
    return named.join(chosen, ["ticker", "field", "priority"]).drop("priority")


def label_column(tag: str = "tag") -> Column:
    out = None
    for t, label in TAG_LABELS.items():
        out = F.when(F.col(tag) == t, label) if out is None else out.when(F.col(tag) == t, label)
    return out


def label_tags(by_year: DataFrame) -> DataFrame:
    """Give facts their label; of two tags with one label the one with more years stays, then the first by name.

    Facts are read once; the list of a company's tag is bounded by its fiscal years.
    """
    named = by_year.withColumn("label", label_column()).filter(F.col("label").isNotNull() & F.col("ticker").isNotNull())
    rest = [c for c in named.columns if c not in ("ticker", "label", "tag")]
    years = named.groupBy("ticker", "label", "tag").agg(F.count(F.lit(1)).alias("n_years"), F.collect_list(F.struct(*rest)).alias("facts"))
    best = years.groupBy("ticker", "label").agg(F.min_by(F.struct("tag", "facts"), F.struct(-F.col("n_years"), F.col("tag"))).alias("b"))
    return best.select("ticker", "label", "b.tag", F.explode("b.facts").alias("f")).select("ticker", "label", "tag", "f.*")


def metric_cells(labelled: DataFrame) -> DataFrame:
    """One row per company: its (metric position, fiscal year, value, tag, accession) cells and its recent years.

    The cells of a company are bounded by the metrics times its fiscal years.
    """
    pos = F.array_position(F.array(*[F.lit(m) for m in METRICS]), F.col("label")).cast("int")
    return labelled.groupBy("ticker").agg(
        F.sort_array(F.collect_list(F.struct(pos.alias("pos"), F.col("fy").alias("fy"), F.col("val").alias("val"),
                                             F.col("tag").alias("tag"), F.col("accn").alias("accn")))).alias("cells")
    ).withColumn("years", F.array_sort(F.array_distinct(F.col("cells.fy"))))


def recent_years(cells: DataFrame) -> DataFrame:
    """Companies with their last two fiscal years (a, b)."""
    y = F.col("years")
    return cells.filter(F.size(y) >= 2).withColumn("a", F.element_at(y, -2)).withColumn("b", F.element_at(y, -1))


def skipped_companies(cells: DataFrame) -> DataFrame:
    return cells.filter(F.size("years") < 2).select("ticker", F.lit("fewer than two fiscal years").alias("reason"))


def company_provenance(cells: DataFrame) -> DataFrame:
    """Fiscal years shown, metrics reported and absent, number of cells per company."""
    all_metrics = F.array(*[F.lit(m) for m in METRICS])
    reported = F.array_distinct(F.transform("cells", lambda c: F.element_at(all_metrics, c["pos"])))
    return recent_years(cells).select(
        "ticker", "a", "b", F.array_join(reported, ", ").alias("reported"),
        F.array_join(F.array_except(all_metrics, reported), ", ").alias("absent"), F.size("cells").alias("n_cells"))
