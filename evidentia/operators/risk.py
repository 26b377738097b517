"""Portfolio risk over many portfolios at once.

Inputs are long tables: positions (portfolio_id, ticker, weight, as_of),
returns (ticker, d, r) on common dates, betas (ticker, beta). Positions are
clustered by portfolio, and every later step groups or windows by portfolio,
so a report needs that one shuffle when the returns panel is small enough for
Spark to broadcast, and a shuffle join on the ticker when it is not.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import measures as M
from evidentia.functions import paths as A
from evidentia.functions.normal import bernoulli_ll, chi2_sf
from evidentia.session import path_batches, stage, task_count

DEFAULT_ALPHA = 0.95
#: Portfolios whose sums a task holds at once, positions of one portfolio added in one task, assets in one tile of a covariance matrix.
HELD, SALT, TILE = 512, 1024, 256


# --- requests --------------------------------------------------------------

def validate_portfolios(requests: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(portfolio_id, tickers, weights, ok, error): the first rule broken, or none."""
    w, t = F.col("weights"), F.col("tickers")
    total = F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
    broken = F.exists(w, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # The wording of the errors.
    error = (
        F.when(t.isNull() | w.isNull(), F.lit("missing field"))
        .when(F.size(t) != F.size(w), F.lit("tickers and weights have different lengths"))
        .when(F.size(t) == 0, F.lit("portfolio is empty"))
        .when(F.size(F.array_distinct(t)) != F.size(t), F.lit("duplicate tickers"))
        .when(broken, F.lit("weights contain NaN or inf"))
        .when(F.abs(total - 1) > tolerance, F.concat(F.lit("weights sum to "), F.format_string("%.6f", total), F.lit(", not 1.0")))
    )
    return requests.select("portfolio_id", "tickers", "weights", error.isNull().alias("ok"), error.alias("error"))


def positions_of(validated: DataFrame) -> DataFrame:
    """Sound requests as one row per position."""
    return (
        validated.filter("ok")
        .select("portfolio_id", F.explode(F.arrays_zip("tickers", "weights")).alias("p"))
        .select("portfolio_id", F.col("p.tickers").alias("ticker"), F.col("p.weights").alias("weight"))
    )


def unmatched_positions(positions: DataFrame, returns: DataFrame) -> DataFrame:
    """Portfolios naming a ticker without market data, with the tickers at fault."""
    known = returns.select("ticker").distinct()
    return positions.join(known, "ticker", "left_anti").groupBy("portfolio_id").agg(
        F.sort_array(F.collect_set("ticker")).alias("missing"))


def align_portfolios(positions: DataFrame, returns: DataFrame, betas: DataFrame | None = None) -> DataFrame:
    """Positions of fully covered portfolios with their betas; a gap rejects the whole portfolio."""
    tickers = returns.select("ticker").distinct().withColumn("_known", F.lit(1))
    marked = positions.join(tickers, "ticker", "left")
    if betas is None:
        marked = marked.withColumn("beta", F.lit(1.0))
    else:
        marked = marked.join(betas.select("ticker", "beta"), "ticker", "left").withColumn(
            "beta", F.coalesce("beta", F.lit(1.0)))
    whole = Window.partitionBy("portfolio_id")
    covered = F.count("_known").over(whole) == F.count(F.lit(1)).over(whole)
    return marked.withColumn("_ok", covered).filter("_ok").drop("_ok", "_known")


# --- measures --------------------------------------------------------------

def paths(series: DataFrame, key: str, value: str = "r") -> DataFrame:
    """(key, days, path): a whole series per row, in order of its days. Its length is bounded by the calendar; days without a value are left out."""
    rows = series.filter(F.col(value).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("d", value))).alias("p"))
    return rows.select(key, F.col("p.d").alias("days"), F.col("p")[value].alias("path"))


def as_paths(series: DataFrame) -> DataFrame:
    """Portfolio series as paths, whether given as rows (portfolio_id, d, r) or as paths already."""
    return series if "path" in series.columns else paths(series, "portfolio_id")


def lists(column: pa.Array) -> list[np.ndarray]:
    """Each list of a column as a numpy array."""
    values, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *np.diff(column.offsets.to_numpy())])
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:])]


def list_column(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    values = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(values, kind))


def weighted_sums(rows: DataFrame) -> DataFrame:
    """(portfolio_id, days, path) from (portfolio_id, weight, days, path): vectors added up as they pass.

    A task holds the sums of HELD portfolios and sends on the longest held one when
    there are more, so a portfolio may leave in several parts; where the rows come
    in order of the portfolio it leaves in one.
    """
    def add(held: dict, key, weight: float, days: np.ndarray, path: np.ndarray) -> None:
        if key not in held:
            held[key] = (days, weight * path)
            return
        have, total = held[key]
        if np.array_equal(have, days):
            total += weight * path
            return
        both = np.union1d(have, days)
        merged = np.zeros(len(both))
        merged[np.searchsorted(both, have)] += total
        merged[np.searchsorted(both, days)] += weight * path
        held[key] = (both, merged)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kinds = {}, None

        def sent(items: list) -> pa.RecordBatch:
            keys, sums = zip(*items)
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, kinds[0]), list_column([d for d, _ in sums], kinds[1]), list_column([x for _, x in sums], pa.float64())],
                ["portfolio_id", "days", "path"])

        for batch in batches:
            kinds = kinds or (batch.column(0).type, batch.column(2).type.value_type)
            for key, weight, days, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), lists(batch.column(2)), lists(batch.column(3))):
                add(held, key, weight, days, path)
            if len(held) > HELD:
                old = list(held)[: len(held) - HELD]
                yield sent([(k, held.pop(k)) for k in old])
        if held:
            yield sent(list(held.items()))

    path_batches(rows.sparkSession)
    ordered = rows.select("portfolio_id", F.col("weight").cast("double").alias("weight"), "days", F.col("path").cast("array<double>").alias("path"))
    kind = {f.name: f.dataType.simpleString() for f in ordered.schema.fields}
    return ordered.mapInArrow(run, f"portfolio_id {kind['portfolio_id']}, days {kind['days']}, path array<double>")


def portfolio_paths(positions: DataFrame, returns: DataFrame) -> DataFrame:
    """(portfolio_id, days, path): the weighted sum of asset returns per date as one vector per portfolio.

    Positions meet their asset's whole path in one row, and vectors are added:
    first for up to about SALT positions of a portfolio, then those sums, so no row
    per position and day is formed and a portfolio that holds most positions is
    spread over tasks. A date counts where one asset has a return; positions
    without a weight do not count.
    """
    own = positions.filter("weight IS NOT NULL").select("portfolio_id", "ticker", "weight")
    parts = own.groupBy(F.col("portfolio_id").alias("_of")).agg(F.ceil(F.count("*") / SALT).alias("_parts"))
    own = own.join(parts, F.col("portfolio_id").eqNullSafe(F.col("_of"))).repartition(
        task_count(own), "portfolio_id", F.pmod(F.xxhash64("ticker"), F.col("_parts"))).sortWithinPartitions("portfolio_id")
    held = own.join(stage(paths(returns, "ticker"), "asset-paths"), "ticker")
    parts = weighted_sums(held).withColumn("weight", F.lit(1.0))
    return weighted_sums(parts.repartition(task_count(parts), "portfolio_id").sortWithinPartitions("portfolio_id"))


def portfolio_returns(positions: DataFrame, returns: DataFrame) -> DataFrame:
    """(portfolio_id, d, r): weighted sum of asset returns per date, one row each."""
    rows = portfolio_paths(positions, returns).select("portfolio_id", F.explode(F.arrays_zip("days", "path")).alias("x"))
    return rows.select("portfolio_id", F.col("x.days").alias("d"), F.col("x.path").alias("r"))


FIGURES = {"n": "long", "mean": "double", "sd": "double", "skew": "double", "kurt": "double", "cut": "double", "shortfall": "double",
           "fall": "double", "run_return": "double", "run_start": "long"}


def path_figures(series: DataFrame, share: float, run: int) -> DataFrame:
    """portfolio_id and the FIGURES of each path, which never leaves its row."""
    path_batches(series.sparkSession)
    own = as_paths(series).select("portfolio_id", "path")
    kinds = {"long": pa.int64(), "double": pa.float64()}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            figures = [A.path_figures(r, share, run) for r in lists(batch.column(1))]
            columns = [pa.array([f[i] for f in figures], kinds[t]) for i, t in enumerate(FIGURES.values())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["portfolio_id", *FIGURES])

    return own.mapInArrow(rows, f"portfolio_id {own.schema['portfolio_id'].dataType.simpleString()}, " + ", ".join(f"{k} {t}" for k, t in FIGURES.items()))


def return_measures(series: DataFrame, alpha: float = DEFAULT_ALPHA, run: int = 20) -> DataFrame:
    """Volatility, the three value-at-risk forms, shortfall, drawdown and worst run per portfolio, from rows or paths.

    Running peak starts at the first point of the curve, not at the initial 1. Of
    equal worst runs the first counts.
    """
    mean, sd = F.col("mean"), F.col("sd")
    return path_figures(series, 1 - alpha, run).select(
        "portfolio_id", F.col("n").alias("observations"), "mean", "sd", "skew", "kurt",
        F.round(sd * (M.PERIODS ** 0.5), 6).alias("annualised_volatility"),
        F.round(-F.col("cut"), 6).alias("var_historical"),
        F.round(-(mean - M.z_value(alpha) * sd), 6).alias("var_gaussian"),
        F.round(M.cornish_fisher_var_of(mean, sd, F.col("skew"), F.col("kurt"), alpha), 6).alias("var_cornish_fisher"),
        F.round("shortfall", 6).alias("expected_shortfall"),
        F.round("fall", 6).alias("max_drawdown"),
        F.round(F.coalesce(-F.col("run_return"), F.lit(0.0)), 6).alias("worst_run_loss"),
        F.coalesce(F.col("run_start").cast("int"), F.lit(0)).alias("worst_run_start"),
    )


def value_at_risk(series: DataFrame, alpha: float = DEFAULT_ALPHA) -> DataFrame:
    """The three value-at-risk forms and volatility per portfolio, from rows or paths."""
    mean, sd = F.col("mean"), F.col("sd")
    return path_figures(series, 1 - alpha, 1).select(
        "portfolio_id", F.round(-F.col("cut"), 6).alias("var_historical"),
        F.round(-(mean - M.z_value(alpha) * sd), 6).alias("var_gaussian"),
        F.round(M.cornish_fisher_var_of(mean, sd, F.col("skew"), F.col("kurt"), alpha), 6).alias("var_cornish_fisher"),
        F.round(sd * (M.PERIODS ** 0.5), 6).alias("volatility"), F.col("n").alias("observations"))


def risk_contributions(positions: DataFrame, returns: DataFrame, series: DataFrame) -> DataFrame:
    """Euler split of portfolio volatility: w * cov(asset, portfolio) / sd(portfolio).

    Adds up to the volatility. Uses the covariance of each held asset with its
    portfolio, so no asset-by-asset matrix is formed. Each path becomes one
    array bounded by the calendar; a position's two paths meet in its row and
    are reduced to a covariance there, over the days that both have.
    """
    named = lambda df, key: df.select(key, F.col("days").alias(f"{key}_days"), F.col("path").alias(f"{key}_path"))
    held = (
        positions.select("portfolio_id", "ticker", "weight").repartition(task_count(positions), "portfolio_id")
        .join(named(as_paths(series), "portfolio_id"), "portfolio_id").join(named(paths(returns, "ticker"), "ticker"), "ticker")
    )
    # where the calendars differ, both paths are cut to their common days first
    common = F.map_from_arrays("ticker_days", "ticker_path")
    same = F.col("ticker_days") == F.col("portfolio_id_days")
    both = F.when(same, F.arrays_zip(F.col("portfolio_id_path").alias("a"), F.col("ticker_path").alias("b"))).otherwise(F.filter(
        F.transform(F.arrays_zip(F.col("portfolio_id_days").alias("d"), F.col("portfolio_id_path").alias("a")),
                    lambda x: F.struct(x["a"].alias("a"), F.try_element_at(common, x["d"]).alias("b"))), lambda x: x["b"].isNotNull()))
    # one pass over the days: their number, both sums, and the sum of products
    start = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "a", "b", "ab")])
    sums = F.aggregate(both, start, lambda s, x: F.struct(
        (s["n"] + 1).alias("n"), (s["a"] + x["a"]).alias("a"), (s["b"] + x["b"]).alias("b"), (s["ab"] + x["a"] * x["b"]).alias("ab")),
        lambda s: F.try_divide(s["ab"] - F.try_divide(s["a"] * s["b"], s["n"]), s["n"] - 1))
    parts = held.select("portfolio_id", "ticker", "weight", sums.alias("cov"))
    whole = Window.partitionBy("portfolio_id")
    total = F.sqrt(F.greatest(F.lit(1e-30), F.sum(F.col("weight") * F.col("cov")).over(whole)))
    raw = parts.withColumn("total", total).withColumn("c", F.col("weight") * F.col("cov") / F.col("total"))
    rank = F.row_number().over(whole.orderBy(F.desc(F.abs(F.round("c", 12))), "ticker"))
    return raw.select(
        "portfolio_id", rank.alias("position"), "ticker", F.round("weight", 5).alias("weight"),
        F.round("c", 8).alias("risk_contribution"), F.round(F.col("c") / F.col("total"), 5).alias("risk_share"))


def covariance_matrix(returns: DataFrame, tile: int = TILE) -> DataFrame:
    """Sample covariance of every pair of assets with a common day, upper triangle; the output is the pair table itself.

    Paths are dealt into tiles of about ``tile`` assets by a hash of the name. A
    tile goes once to each tile it meets, as one row, and a pair of tiles is one
    product of matrices, so neither a row per pair and day nor a join of all rows is
    formed. Of a pair with one common day the covariance is null.
    """
    assets = stage(paths(returns, "ticker"), "asset-paths")
    kind = assets.schema["ticker"].dataType.simpleString()
    tiles = max(1, math.ceil(assets.count() / tile))
    mine = F.pmod(F.xxhash64("ticker"), F.lit(tiles)).cast("int")
    rows = assets.groupBy(mine.alias("tile")).agg(F.collect_list(F.struct("ticker", "days", "path")).alias("own"))
    met = rows.select("tile", "own", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("other"))
    sides = met.groupBy(F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high")).agg(
        F.sort_array(F.collect_list(F.struct("tile", "own"))).alias("side"))

    def matrix(side: pa.Array, calendar: np.ndarray) -> np.ndarray:
        out = np.full((len(side), len(calendar)), np.nan)
        for i, (days, path) in enumerate(zip(lists(side.field("days")), lists(side.field("path")))):
            out[i, np.searchsorted(calendar, days)] = path
        return out

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                both = batch.column(0).slice(i, 1).flatten().field("own")
                own = [both.slice(k, 1).flatten() for k in range(len(both))]
                if len(own) == 1 and batch.column(1)[i].as_py() != batch.column(2)[i].as_py():
                    continue  # the other tile is empty
                a, b = own[0], own[-1]
                calendar = np.unique(np.concatenate([d for x in own for d in lists(x.field("days"))]))
                n, cov = A.covariances(matrix(a, calendar), matrix(b, calendar))
                names_a, names_b = a.field("ticker").to_pylist(), b.field("ticker").to_pylist()
                found = [(names_a[j], names_b[k], None if np.isnan(cov[j, k]) else float(cov[j, k])) for j, k in zip(*np.nonzero(n))
                         if len(own) == 2 or names_a[j] <= names_b[k]]
                x, y, c = zip(*((min(p[:2]), max(p[:2]), p[2]) for p in found)) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(x, a.field("ticker").type), pa.array(y, a.field("ticker").type), pa.array(c, pa.float64())],
                                                 ["ticker_a", "ticker_b", "cov"])

    return sides.select("side", "low", "high").mapInArrow(pairs, f"ticker_a {kind}, ticker_b {kind}, cov double")


def betas(returns: DataFrame, benchmark: DataFrame | None = None) -> DataFrame:
    """(ticker, beta) against a benchmark (d, b), or the cross-sectional mean without one.

    A benchmark that does not move gives a null beta, which the caller treats
    as an error.
    """
    if benchmark is None:
        benchmark = returns.groupBy("d").agg(F.avg("r").alias("b"))
    joined = returns.join(benchmark, "d")
    slope = F.try_divide(F.covar_pop("r", "b"), F.var_pop("b"))
    return joined.groupBy("ticker").agg(slope.alias("beta"))


def concentration(positions: DataFrame, top: int = 3) -> DataFrame:
    """Herfindahl index, effective positions and top-3 share on absolute weights."""
    whole = Window.partitionBy("portfolio_id")
    w = F.abs(F.col("weight"))
    ranked = positions.select(
        "portfolio_id", F.try_divide(w, F.sum(w).over(whole)).alias("p"),
        F.row_number().over(whole.orderBy(w.desc(), "ticker")).alias("k"))
    hhi = F.coalesce(F.sum(F.col("p") * F.col("p")), F.lit(0.0))
    return ranked.groupBy("portfolio_id").agg(
        F.count(F.lit(1)).alias("n_positions"),
        F.round(hhi, 5).alias("hhi"),
        F.round(F.coalesce(F.try_divide(F.lit(1.0), hhi), F.lit(0.0)), 2).alias("effective_positions"),
        F.round(F.coalesce(F.sum(F.when(F.col("k") <= top, F.col("p"))), F.lit(0.0)), 4).alias("top3_share"))


def stress(positions: DataFrame, shocks: tuple[float, ...] = (-0.10, -0.20)) -> DataFrame:
    """Move of each portfolio under factor shocks, through position betas."""
    moved = positions.groupBy("portfolio_id").agg(F.sum(F.col("weight") * F.col("beta")).alias("wb"))
    return moved.select("portfolio_id", F.explode(F.array(*[F.lit(s) for s in shocks])).alias("shock"), "wb").select(
        "portfolio_id", "shock", F.round(F.col("wb") * F.col("shock"), 6).alias("move"))


def high_beta_tilt(beta_table: DataFrame, top_weight: float = 0.40, portfolio_id: str = "HIGH-BETA-TILT",
                   as_of: str = "") -> DataFrame:
    """A portfolio holding ``top_weight`` of the highest beta and equal parts of the rest."""
    best = beta_table.agg(F.max_by("ticker", F.struct("beta", "ticker")).alias("best"), F.count(F.lit(1)).alias("n"))
    rest = (1 - F.lit(top_weight)) / (F.col("n") - 1)
    return beta_table.join(F.broadcast(best)).select(
        F.lit(portfolio_id).alias("portfolio_id"), "ticker",
        F.when(F.col("ticker") == F.col("best"), F.lit(top_weight)).otherwise(rest).alias("weight"),
        F.lit(as_of).alias("as_of"))


# --- checks ----------------------------------------------------------------

def risk_checks(report: DataFrame, contributions: DataFrame) -> DataFrame:
    """Findings per portfolio, from the rounded figures of the report."""
    share, weight = F.col("risk_share"), F.col("weight")
    mismatch = (weight > 0.02) & (F.try_divide(share, weight) > 1.4)
    tops = contributions.groupBy("portfolio_id").agg(
        F.min_by(F.struct("ticker", "weight", "risk_share"), "position").alias("top"),
        F.min_by(F.when(mismatch, F.struct("ticker", "weight", "risk_share")),
                 F.when(mismatch, F.col("position"))).alias("mis"))
    r = report.join(tops, "portfolio_id")
    spread = F.try_divide(F.col("effective_positions"), F.col("n_positions"))
    gap = F.col("var_cornish_fisher") - F.col("var_gaussian")

    def finding(when, level, code, detail):
        return F.when(when, F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"), detail.alias("detail")))

    # The codes, limits and wording of the findings.
    found = F.array_compact(F.array(
        finding(spread < 0.55, "warn", "concentrated", F.format_string(
            "%.1f effective positions across %d holdings (%.0f%% of equal weighting)",
            "effective_positions", "n_positions", spread * 100)),
        finding(F.col("top.risk_share") > 0.40, "warn", "risk_concentration", F.format_string(
            "%s is %.0f%% of risk on %.0f%% of capital", "top.ticker",
            F.col("top.risk_share") * 100, F.col("top.weight") * 100)),
        finding(F.col("mis").isNotNull(), "warn", "risk_capital_mismatch", F.format_string(
            "%s carries %.2fx its capital share in risk", "mis.ticker",
            F.try_divide(F.col("mis.risk_share"), F.col("mis.weight")))),
        finding((F.col("var_gaussian") > 0) & (F.try_divide(gap, F.col("var_gaussian")) > 0.05), "info",
                "non_normal_tail", F.format_string(
                    "Cornish-Fisher VaR exceeds Gaussian by %.0f%%", F.try_divide(gap, F.col("var_gaussian")) * 100)),
        finding(F.col("observations") < 250, "warn", "short_history", F.format_string(
            "%d observations is too few for a stable 95%% historical VaR", "observations")),
    ))
    return r.select("portfolio_id", F.explode(found).alias("f")).select("portfolio_id", "f.*")


# --- backtests -------------------------------------------------------------

def rolling_var(series: DataFrame, alphas: tuple[float, ...] = (0.95, 0.99), window: int = 250) -> DataFrame:
    """(portfolio_id, alpha, d, r, var, hit): the quantile loss of the previous ``window`` returns, and whether the day's loss is beyond it.

    The window keeps its exact size; days without a full one are left out. All
    quantiles of a path are read off one structure of counts over ranks, whose cost
    per day does not depend on the window.
    """
    own = as_paths(series).select("portfolio_id", "days", "path").filter(F.size("path") > window)
    kind = {f.name: f.dataType.simpleString() for f in own.schema.fields}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [A.rolling_quantiles(r, window, [1 - a for a in alphas]) for r in lists(batch.column(2))]
            for k, alpha in enumerate(alphas):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([alpha] * batch.num_rows, pa.float64()), batch.column(1), batch.column(2),
                     list_column([f[k] for f in found], pa.float64())], ["portfolio_id", "alpha", "days", "path", "cuts"])

    cuts = own.mapInArrow(rows, f"portfolio_id {kind['portfolio_id']}, alpha double, days {kind['days']}, path array<double>, cuts array<double>")
    later = lambda c: F.slice(c, window + 1, F.size(c))
    each = cuts.select("portfolio_id", "alpha", F.explode(F.arrays_zip(later("days").alias("d"), later("path").alias("r"), F.col("cuts").alias("cut"))).alias("x"))
    return each.select("portfolio_id", "alpha", "x.d", "x.r", (-F.col("x.cut")).alias("var"), (F.col("x.r") < F.col("x.cut")).cast("int").alias("hit"))


def rolling_var_hits(series: DataFrame, alphas: tuple[float, ...] = (0.95, 0.99), window: int = 250) -> DataFrame:
    """(portfolio_id, alpha, d, hit) of the days with a full window."""
    return rolling_var(series, alphas, window).select("portfolio_id", "alpha", "d", "hit")


def hit_counts(hits: DataFrame) -> DataFrame:
    """Hits and the four transition counts per portfolio and level."""
    prev = F.lag("hit").over(Window.partitionBy("portfolio_id", "alpha").orderBy("d"))
    h = hits.withColumn("prev", prev)

    def moved(a, b):
        return F.sum(F.when((F.col("prev") == a) & (F.col("hit") == b), 1).otherwise(0))

    return h.groupBy("portfolio_id", "alpha").agg(
        F.count("hit").alias("n"), F.sum("hit").alias("x"),
        moved(0, 0).alias("n00"), moved(0, 1).alias("n01"), moved(1, 0).alias("n10"), moved(1, 1).alias("n11"))


def coverage_tests(counts: DataFrame, window: int = 250) -> DataFrame:
    """Kupiec and Christoffersen tests on hit counts, both ratios floored at zero."""
    c = F.col
    p, pi = 1 - c("alpha"), c("x") / c("n")
    c0, c1 = c("n00") + c("n01"), c("n10") + c("n11")
    pi01 = F.coalesce(F.try_divide(c("n01"), c0), F.lit(0.0))
    pi11 = F.coalesce(F.try_divide(c("n11"), c1), F.lit(0.0))
    pooled = F.coalesce(F.try_divide(c("n01") + c("n11"), c0 + c1), F.lit(0.0))
    step1 = counts.withColumn("lr_uc", F.greatest(
        F.lit(0.0), -2 * (bernoulli_ll(c("x"), c("n"), p) - bernoulli_ll(c("x"), c("n"), pi))))
    split = bernoulli_ll(c("n01"), c0, pi01) + bernoulli_ll(c("n11"), c1, pi11)
    whole = bernoulli_ll(c("n01") + c("n11"), c0 + c1, pooled)
    step2 = step1.withColumn("lr_ind", F.greatest(F.lit(0.0), -2 * (whole - split)))
    return step2.withColumn("lr_cc", c("lr_uc") + c("lr_ind")).select(
        "portfolio_id", "alpha", F.lit(window).alias("window"), c("n").alias("test_observations"),
        F.round(p * c("n"), 2).alias("expected_exceptions"), c("x").alias("observed_exceptions"),
        F.round(pi, 5).alias("exception_rate"),
        F.round("lr_uc", 4).alias("kupiec_lr"), F.round(chi2_sf(c("lr_uc"), 1), 4).alias("kupiec_p"),
        F.round("lr_ind", 4).alias("independence_lr"), F.round(chi2_sf(c("lr_ind"), 1), 4).alias("independence_p"),
        F.round("lr_cc", 4).alias("cc_lr"), F.round(chi2_sf(c("lr_cc"), 2), 4).alias("cc_p"))


def var_backtest(series: DataFrame, alphas: tuple[float, ...] = (0.95, 0.99), window: int = 250) -> DataFrame:
    """Coverage tests per portfolio and level, from rows or paths; portfolios with too little history get ``tested`` = false."""
    own = stage(as_paths(series), "paths")
    tested = coverage_tests(hit_counts(rolling_var_hits(own, alphas, window)), window).withColumn("tested", F.lit(True))
    sizes = own.select("portfolio_id", F.size("path").cast("long").alias("n_returns"))
    wanted = sizes.select("portfolio_id", "n_returns", F.explode(F.array(*[F.lit(a) for a in alphas])).alias("alpha"))
    enough = F.col("n_returns") > window + 1
    out = wanted.join(tested, ["portfolio_id", "alpha"], "left")
    measured = [F.when(enough, F.col(k)).alias(k) for k in tested.columns if k not in ("portfolio_id", "alpha", "tested", "window")]
    return out.select("portfolio_id", "alpha", "n_returns", enough.alias("tested"), *measured)
