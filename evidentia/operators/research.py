"""Checks on research results: lookahead, survivorship, label overlap, selection."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import measures as M
from evidentia.operators import series as T
from evidentia.session import stage, task_count

MIN_PAIRS = 8
FLAT_SD = 1e-12


def guarded_corr(a: Column, b: Column) -> Column:
    """Correlation of rows where both are present; zero for few rows or a flat side.

    Written out of central moments, since the built-in raises on a flat side.
    """
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    raw = F.try_divide(F.covar_pop(x, y), sx * sy)
    return F.when((F.count(x) < MIN_PAIRS) | (sx < FLAT_SD) | (sy < FLAT_SD), F.lit(0.0)).otherwise(raw)


def detect_lookahead(features: DataFrame, by: list[str], names: list[str], target: str = "y", t: str = "t",
                     max_lag: int = 3, threshold: float = 0.50) -> DataFrame:
    """Flag features tied implausibly to the target of their own or a later period.

    ``features`` has one column per feature. All lags of the target are added
    once, features are stacked, and every correlation of a feature comes out of
    a single aggregate. A feature's missing values count as zero.
    """
    w = Window.partitionBy(*by).orderBy(t)
    ahead = [F.lead(target, k).over(w).alias(f"_f{k}") for k in range(0, max_lag + 1)]
    behind = [F.lag(target, k).over(w).alias(f"_b{k}") for k in range(1, max_lag + 1)]
    base = features.select(*by, *[F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in names], *ahead, *behind)
    keep = by + [f"_f{k}" for k in range(max_lag + 1)] + [f"_b{k}" for k in range(1, max_lag + 1)]
    long = base.unpivot(keep, names, "feature", "x")
    x = F.col("x")
    forward = F.array(*[F.abs(guarded_corr(x, F.col(f"_f{k}"))) for k in range(max_lag + 1)])
    backward = F.array(*[F.abs(guarded_corr(x, F.col(f"_b{k}"))) for k in range(1, max_lag + 1)])
    c = long.groupBy(*by, "feature").agg(forward.alias("fwd"), backward.alias("bwd"))
    best = F.array_max("fwd")
    return c.select(
        *by, "feature", F.round(best, 5).alias("max_forward_corr"),
        (F.array_position("fwd", best) - 1).cast("int").alias("lag_of_max"),
        F.round(F.array_max("bwd"), 5).alias("max_backward_corr"),
        (best > threshold).alias("contaminated"))


def lookahead_cases(series: DataFrame, by: list[str], t: str = "t", y: str = "y") -> tuple[DataFrame, list[str]]:
    """Named feature constructions over a return series, leaking ones and properly lagged ones."""
    shift = lambda c: F.lag(c, 1).over(Window.partitionBy(*by).orderBy(t))
    made = series.select(
        *by, t, y,
        T.roll(y, -1, by, t).alias("copies next period"),
        F.col(y).alias("copies this period"),
        T.centred_mean(y, 3, by, t).alias("centred mean 3"),
        T.centred_mean(y, 9, by, t).alias("centred mean 9"),
        T.roll(y, 1, by, t).alias("momentum"),
        T.trailing_mean_full(y, 5, by, t).alias("_trail"),
        T.realised_vol(y, 20, by, t).alias("_vol"),
    )
    made = made.withColumn("trailing mean, lagged", shift("_trail")).withColumn(
        "realised volatility, lagged", shift("_vol")).drop("_trail", "_vol")
    return made, [c for c in made.columns if c not in (*by, t, y)]


LAGGED_CASES = ["momentum", "trailing mean, lagged", "realised volatility, lagged"]
COPY_CASES = ["copies next period", "copies this period"]


def false_positive_audit(findings: DataFrame, by: list[str]) -> DataFrame:
    """Flags raised, leaks caught among the copies, lagged features flagged by mistake."""
    flagged = F.col("contaminated")
    return findings.groupBy(*by).agg(
        F.sum(flagged.cast("int")).alias("n_flagged"),
        F.sum((flagged & F.col("feature").isin(*COPY_CASES)).cast("int")).alias("true_leaks_caught"),
        F.sum((flagged & F.col("feature").isin(*LAGGED_CASES)).cast("int")).alias("lagged_falsely_flagged"))


def dilution_sweep(series: DataFrame, by: list[str], windows: tuple[int, ...] = (3, 5, 9, 21, 63),
                   t: str = "t", y: str = "y") -> DataFrame:
    """How a centred window's leak fades with its width, against the theoretical 1/sqrt(width)."""
    names = {f"w{w}": w for w in windows}
    made = series.select(*by, t, y, *[T.centred_mean(y, w, by, t).alias(n) for n, w in names.items()])
    found = detect_lookahead(made, by, list(names), y, t)
    nxt = F.lead(y, 1).over(Window.partitionBy(*by).orderBy(t))
    long = made.withColumn("_next", nxt).unpivot([*by, "_next"], list(names), "feature", "x")
    corr = long.groupBy(*by, "feature").agg(guarded_corr(F.col("x"), F.col("_next")).alias("corr"))
    width = F.substring("feature", 2, 9).cast("int")
    return found.join(corr, [*by, "feature"]).select(
        *by, width.alias("window"), F.round("corr", 4).alias("correlation_with_next"),
        F.round(1 / F.sqrt(width.cast("double")), 4).alias("theoretical"), F.col("contaminated").alias("detected"))


def detection_floor(sweep: DataFrame, by: list[str]) -> DataFrame:
    """Widest detected window and the widths that were missed (bounded by the sweep's widths)."""
    return sweep.groupBy(*by).agg(
        F.max(F.when(F.col("detected"), F.col("window"))).alias("detection_floor"),
        F.array_join(F.sort_array(F.collect_list(F.when(~F.col("detected"), F.col("window")))), ",").alias("missed"))


def audit_universe(returns: DataFrame, alive: DataFrame) -> DataFrame:
    """What keeping only the survivors does to the mean return, in one pass over the cells."""
    joined = returns.join(alive, "name")
    per_name = joined.groupBy("name").agg(F.sum("r").alias("s"), F.count("r").alias("k"), F.max("alive").alias("alive"))
    a = F.col("alive")
    t = per_name.agg(
        F.count(F.lit(1)).alias("n_universe"), F.sum(a.cast("int")).alias("n_survivors"),
        F.try_divide(F.sum("s"), F.sum("k")).alias("all_mean"),
        F.try_divide(F.sum(F.when(a, F.col("s"))), F.sum(F.when(a, F.col("k")))).alias("surv_mean"))
    return t.select(
        "n_universe", "n_survivors", (F.col("n_universe") - F.col("n_survivors")).alias("n_delisted"),
        F.round(F.try_divide(F.col("n_survivors"), F.col("n_universe")), 4).alias("survivor_share"),
        (F.col("n_survivors") < F.col("n_universe")).alias("biased"),
        F.round("all_mean", 6).alias("mean_return_all"), F.round("surv_mean", 6).alias("mean_return_survivors"),
        F.round((F.col("surv_mean") - F.col("all_mean")) * 10000, 2).alias("bias_bps"))


# --- folds -----------------------------------------------------------------

def fold_table(sizes: DataFrame, by: list[str], n_splits: int = 5) -> DataFrame:
    """(by, n, fold, a, b): contiguous test blocks [a, b) over n positions."""
    if n_splits < 2:
        raise ValueError("n_splits must be at least 2")
    step = F.col("n") / F.lit(float(n_splits))
    edge = lambda i: F.when(i == n_splits, F.col("n")).otherwise(F.floor(i * step))
    folds = sizes.select(*by, F.col("n").cast("bigint").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("fold"))
    return folds.select(*by, "n", "fold", edge(F.col("fold")).cast("bigint").alias("a"),
                        edge(F.col("fold") + 1).cast("bigint").alias("b"))


def positions_in_series(df: DataFrame, by: list[str], t: str) -> DataFrame:
    """Zero-based position of every row in its series."""
    return df.select(*by, t, (F.row_number().over(Window.partitionBy(*by).orderBy(t)) - 1).cast("bigint").alias("i"))


def purged_kfold(df: DataFrame, by: list[str], t: str = "t", n_splits: int = 5, label_span: int = 1,
                 embargo: int = 0) -> DataFrame:
    """(by, fold, t, i, role): test, train, or dropped.

    Train leaves out [max(0, a - span), b) and the embargo after b. The folds
    are a handful of rows per series, joined on the series key.
    """
    rows = positions_in_series(df, by, t)
    folds = fold_table(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), by, n_splits)
    i, a, b = F.col("i"), F.col("a"), F.col("b")
    role = (
        F.when((i >= a) & (i < b), F.lit("test"))
        .when((i >= F.greatest(F.lit(0).cast("bigint"), a - label_span)) & (i < b), F.lit("purged"))
        .when((i >= b) & (i < b + embargo), F.lit("embargoed"))
        .otherwise(F.lit("train"))
    )
    return rows.join(folds, by).select(*by, "fold", t, "i", role.alias("role"), "a", "b", "n")


def embargo(df: DataFrame, by: list[str], t: str, start: int, end: int, width: int) -> DataFrame:
    """Rows right after a test block [start, end)."""
    i = F.col("i")
    return positions_in_series(df, by, t).filter((i >= end) & (i < end + width))


def label_overlap(folds: DataFrame, label_span: int) -> DataFrame:
    """Train rows whose label window reaches the test block: a - span < i < a, in closed form."""
    return folds.filter((F.col("role") == "train") & (F.col("i") < F.col("a")) & (F.col("i") > F.col("a") - label_span)
                        & (F.col("b") > F.col("a")))


def leakage_check(folds: DataFrame, by: list[str], label_span: int) -> DataFrame:
    """Per fold: rows in train and test, rows dropped, train rows still overlapping."""
    over = (F.col("role") == "train") & (F.col("i") < F.col("a")) & (F.col("i") > F.col("a") - label_span)
    count = lambda c: F.sum(c.cast("int"))
    return folds.groupBy(*by, "fold").agg(
        count(F.col("role") == "train").alias("n_train"), count(F.col("role") == "test").alias("n_test"),
        count(F.col("role").isin("purged", "embargoed")).alias("n_dropped"), count(over).alias("n_overlap"))


# --- selection -------------------------------------------------------------

def crossover_returns(prices: DataFrame, fast: tuple[int, ...] = tuple(range(2, 22, 2)),
                      slow: tuple[int, ...] = tuple(range(20, 220, 10)), by: list[str] = ["ticker"], t: str = "d",
                      px: str = "px") -> DataFrame:
    """(by, fast, slow, r) for every moving-average rule with fast < slow.

    Each distinct width's average is worked out once per row, from differences
    of a running sum, and staged; the rules are then stacked from plain columns
    and spread over all tasks, as their sums need no order. Warm-up
    rows stay, with a return of zero, since a missing average never exceeds
    another.
    """
    w = Window.partitionBy(*by).orderBy(t)
    total = prices.select(*by, t, px, F.sum(px).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_c"),
                          F.row_number().over(w).alias("_i"), F.lead(px).over(w).alias("_next"))
    widths = sorted(set(fast) | set(slow))
    means = [F.when(F.col("_i") >= k, (F.col("_c") - F.coalesce(F.lag("_c", k).over(w), F.lit(0.0))) / k).alias(f"_m{k}")
             for k in widths]
    wide = total.select(*by, "_next", px, *means).filter(F.col("_next").isNotNull()).select(
        *by, (F.col("_next") / F.col(px) - 1).alias("_r"), *[f"_m{k}" for k in widths])
    wide = stage(wide, "means").repartition(task_count(prices))
    held = lambda ks: F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_m{k}").alias("m")) for k in ks])
    one = wide.select(*by, "_r", F.explode(held(fast)).alias("_a"), held(slow).alias("_bs"))
    pairs = one.select(*by, "_r", "_a", F.explode("_bs").alias("_b")).filter(F.col("_a.k") < F.col("_b.k"))
    rising = F.coalesce(F.col("_a.m") > F.col("_b.m"), F.lit(False))
    return pairs.select(*by, F.col("_a.k").alias("fast"), F.col("_b.k").alias("slow"),
                        F.when(rising, F.col("_r")).otherwise(F.lit(0.0)).alias("r"))


def score_rules(rule_returns: DataFrame, by: list[str] = ["ticker"], min_obs: int = 250) -> DataFrame:
    """Moments and Sharpe ratio per rule; rules with too few observations are left out."""
    m = rule_returns.groupBy(*by, "fast", "slow").agg(*M.moments("r")).filter(F.col("n") >= min_obs)
    return m.withColumn("sharpe", F.round(M.period_sharpe(F.col("mean"), F.col("sd")) * math.sqrt(M.PERIODS), 4))


def deflate_best(scored: DataFrame, by: list[str] = ["ticker"]) -> DataFrame:
    """Best rule per series, spread of the ratios, and the best one deflated by the number tried.

    Equal ratios go to the earlier rule of the grid.
    """
    key = F.struct(F.col("sharpe"), -F.col("fast"), -F.col("slow"))
    top = scored.groupBy(*by).agg(
        F.max_by(F.struct("fast", "slow", "n", "mean", "sd", "skew", "kurt", "sharpe"), key).alias("b"),
        F.count(F.lit(1)).alias("n_tried"), F.max("sharpe").alias("sharpe_max"),
        F.median("sharpe").alias("sharpe_median"), F.min("sharpe").alias("sharpe_min"))
    n, mean, sd, skew, kurt = (F.col(f"b.{k}") for k in ("n", "mean", "sd", "skew", "kurt"))
    noise = M.expected_max_sharpe(F.col("n_tried").cast("double"), 1 / n)
    out = top.withColumn("noise", noise)
    psr = lambda b: M.probabilistic_sharpe_of(n, mean, sd, skew, kurt, b)
    return out.select(
        *by, "n_tried", F.col("b.fast").alias("fast"), F.col("b.slow").alias("slow"), n.alias("n_obs"),
        F.col("b.sharpe").alias("best_sharpe"), "sharpe_max", F.round("sharpe_median", 4).alias("sharpe_median"), "sharpe_min",
        F.round(psr(0.0), 4).alias("probabilistic_sharpe"),
        F.round("noise", 4).alias("expected_max_from_noise"),
        F.round(psr(F.col("noise")), 5).alias("deflated_prob"),
        F.coalesce(psr(F.col("noise")) > 0.95, F.lit(False)).alias("survives"))


def deflated_by_trials(stats: DataFrame, by: list[str], trials: tuple[int, ...] = (1, 10, 50, 200)) -> DataFrame:
    """One row of moments per series against several assumed numbers of tries."""
    grid = stats.withColumn("n_trials", F.explode(F.array(*[F.lit(k) for k in trials])))
    n, mean, sd, skew, kurt = (F.col(k) for k in ("n", "mean", "sd", "skew", "kurt"))
    grid = grid.withColumn("noise", M.expected_max_sharpe(F.col("n_trials").cast("double"), 1 / n))
    p = M.probabilistic_sharpe_of(n, mean, sd, skew, kurt, F.col("noise"))
    return grid.select(
        *by, "n_trials", F.round(M.period_sharpe(mean, sd) * math.sqrt(M.PERIODS), 4).alias("observed_sharpe"),
        F.round("noise", 4).alias("expected_max_from_noise"), F.round(p, 5).alias("deflated_prob"),
        F.coalesce(p > 0.95, F.lit(False)).alias("survives"))


def audit_verdict(findings: DataFrame, deflated: DataFrame, verified: DataFrame | None = None) -> DataFrame:
    """One row: does any feature leak, does every series survive deflation and, with ``verified`` (ok), does every value still describe its sources.

    Without any value to verify nothing has failed.
    """
    leak = findings.agg(F.bool_or("contaminated").alias("any_contaminated"))
    lives = deflated.agg(F.bool_and("survives").alias("all_survive"))
    out = leak.join(F.broadcast(lives))
    passed = ~F.col("any_contaminated") & F.col("all_survive")
    if verified is None:
        return out.select("any_contaminated", "all_survive", passed.alias("passed"))
    held = verified.agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("all_verified"), F.count_if(~F.col("ok")).alias("n_failed"))
    return out.join(F.broadcast(held)).select(
        "any_contaminated", "all_survive", "all_verified", "n_failed", (passed & F.col("all_verified")).alias("passed"))
