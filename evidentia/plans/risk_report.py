"""The full risk report for many portfolios in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.operators import risk as R
from evidentia.session import stage


def risk_report(positions: DataFrame, returns: DataFrame, betas: DataFrame, alpha: float = 0.95) -> DataFrame:
    """One row per portfolio: measures, concentration and stress, rounded for presentation."""
    held = stage(R.align_portfolios(positions, returns, betas), "held")
    return _report(held, R.portfolio_paths(held, returns), alpha)


def _report(held: DataFrame, series: DataFrame, alpha: float) -> DataFrame:
    measures = R.return_measures(series, alpha).drop("mean", "sd", "skew", "kurt")
    moves = held.groupBy("portfolio_id").agg(
        F.round(F.sum(F.col("weight") * F.col("beta")) * -0.10, 6).alias("shock_10"),
        F.round(F.sum(F.col("weight") * F.col("beta")) * -0.20, 6).alias("shock_20"))
    return (
        measures.join(R.concentration(held), "portfolio_id").join(moves, "portfolio_id")
        .withColumn("alpha", F.lit(alpha))
    )


def full_report(positions: DataFrame, returns: DataFrame, betas: DataFrame, alpha: float = 0.95) -> DataFrame:
    """The report with its sorted contributions and findings nested in each row; ``checks`` is empty where there are none.

    The nested lists are bounded by the positions of a portfolio and by the
    five rules. Positions, daily returns and measures are made once.
    """
    held = stage(R.align_portfolios(positions, returns, betas), "held")
    series = stage(R.portfolio_paths(held, returns), "daily")
    report = stage(_report(held, series, alpha), "report")
    parts = stage(R.risk_contributions(held, returns, series), "contributions")
    checks = R.risk_checks(report, parts).groupBy("portfolio_id").agg(
        F.array_sort(F.collect_list(F.struct("level", "code", "detail"))).alias("checks"))
    nested = parts.groupBy("portfolio_id").agg(F.sort_array(F.collect_list(F.struct(
        "position", "ticker", "weight", "risk_contribution", "risk_share"))).alias("contributions"))
    none = F.array().cast("array<struct<level:string,code:string,detail:string>>")
    return report.join(nested, "portfolio_id").join(checks, "portfolio_id", "left").withColumn("checks", F.coalesce("checks", none))
