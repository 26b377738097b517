"""From concept documents to derived metrics whose digits can be checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions.text import sha16
from evidentia.operators import facts as O
from evidentia.operators import lineage as K
from evidentia.sources.readers import parse_concepts


def located_fields(documents: DataFrame) -> DataFrame:
    """(ticker, field, tag, doc_id, tracked): original annual figures with the span of their digits.

    ``documents`` is (ticker, tag, doc_id, text). Figures whose digits cannot
    be found in their document are left out.
    """
    facts = O.original_filing(O.tag_fallback(O.usable_fact(parse_concepts(documents))), by=["ticker", "field"])
    j = facts.join(documents.select("ticker", "tag", "doc_id", "text"), ["ticker", "tag"])
    at = K.find_span(F.col("text"), F.col("val").cast("string"), F.col("accn"), F.col("end").cast("string"))
    j = j.withColumn("at", at).filter(F.col("at").isNotNull())
    note = F.concat_ws(" ", "tag", F.col("fy").cast("string"), "form")
    t = K.Tracked.at(F.col("val"), F.col("doc_id"), F.col("at.start"), F.col("at.end"), sha16(F.col("text")), note)
    return j.select("ticker", "field", "tag", "doc_id", "fy", t.column().alias("tracked"))


def company_row(fields: DataFrame) -> DataFrame:
    """One row per company with its fields as tracked columns; absent fields are null."""
    pick = lambda f: F.first(F.when(F.col("field") == f, F.col("tracked")), ignorenulls=True).alias(f)
    return fields.groupBy("ticker").agg(pick("revenue"), pick("cost"), pick("rnd"))


def metric_definitions() -> dict[str, K.Tracked]:
    revenue, cost, rnd = (K.Tracked.leaf(f) for f in ("revenue", "cost", "rnd"))
    gross = revenue - cost
    return {"revenue": revenue, "gross_profit": gross, "gross_margin": gross / revenue, "rnd_intensity": rnd / revenue}


def derive_metrics(row: DataFrame) -> DataFrame:
    """(ticker, metric, tracked) in long form; a metric lacking an input is absent."""
    made = F.array(*[F.struct(F.lit(k).alias("metric"), t.column().alias("tracked")) for k, t in metric_definitions().items()])
    return row.filter(F.col("revenue").isNotNull()).select("ticker", F.explode(made).alias("m")).select(
        "ticker", "m.*").filter(F.col("tracked").isNotNull())


def headline(metrics: DataFrame) -> DataFrame:
    """The gross margin of each company, or its revenue where there is none."""
    order = F.when(F.col("metric") == "gross_margin", 0).when(F.col("metric") == "revenue", 1)
    return metrics.filter(order.isNotNull()).groupBy("ticker").agg(
        F.min_by(F.struct("metric", "tracked"), order).alias("h")).select("ticker", "h.*")
