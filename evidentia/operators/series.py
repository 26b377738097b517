"""Operators over dated series in long form.

Windows are always partitioned by a series id; a series holds one row per date
after aggregation, so a partition is bounded by the calendar, not by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(by: list[str], t: str):
    return Window.partitionBy(*by).orderBy(t)


def date_range(df: DataFrame, start: str | None = None, end: str | None = None, date: str = "d") -> DataFrame:
    """Rows between two dates, both included; either side may be open.

    The bounds are literals of the column's own type, so they reach the file
    scan; on a timestamp column the last day counts in full.
    """
    kind = dict(df.dtypes)[date]
    if start is not None:
        df = df.filter(F.col(date) >= F.lit(start).cast("date").cast(kind))
    if end is not None:
        day = F.lit(end).cast("date")
        df = df.filter(F.col(date) <= day if kind == "date" else F.col(date) < F.date_add(day, 1).cast(kind))
    return df


def align(series: DataFrame, name: str = "name", date: str = "d", value: str = "value",
          order: str | None = None) -> DataFrame:
    """Keep the dates that every series has.

    A date repeated within a series keeps its last value by ``order``. Rows are
    first reduced to one per date and series, then one shuffle on the date
    counts the series present; their number comes from a one-row aggregate.
    """
    agg = F.max_by(value, order) if order else F.max(value)
    total = series.agg(F.count_distinct(name).alias("_n"))
    one = series.groupBy(date, name).agg(agg.alias(value))
    counted = one.withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy(date)))
    return counted.join(F.broadcast(total)).filter("_k = _n").select(name, date, value)


def common_dates(series: DataFrame, name: str = "name", date: str = "d") -> DataFrame:
    """The intersection of all calendars."""
    total = series.agg(F.count_distinct(name).alias("_n"))
    held = series.groupBy(date).agg(F.count_distinct(name).alias("_k"))
    return held.join(F.broadcast(total)).filter("_k = _n").select(date)


def tail_dates(df: DataFrame, k: int, date: str = "d") -> DataFrame:
    """Rows on the last k distinct dates."""
    last = df.select(date).distinct().orderBy(F.desc(date)).limit(k)
    return df.join(F.broadcast(last.agg(F.min(date).alias("_from")))).filter(F.col(date) >= F.col("_from")).drop("_from")


def join_factor(returns: DataFrame, factor: DataFrame | None, lookback: int = 2600,
                ticker: str = "ticker", date: str = "d", value: str = "r", factor_value: str = "b") -> DataFrame:
    """Returns beside a benchmark on shared dates, last ``lookback`` dates only.

    Without a benchmark the cross-sectional mean of each date takes its place
    and ``benchmark`` says so.
    """
    if factor is None:
        bench = returns.groupBy(date).agg(F.avg(value).alias(factor_value))
        label = "cross-sectional mean"
    else:
        bench, label = factor, "factor"
    joined = returns.join(bench.select(date, factor_value), date)
    return tail_dates(joined, lookback, date).select(
        ticker, date, value, factor_value, F.lit(label).alias("benchmark"))


def require_history(df: DataFrame, min_days: int, date: str = "d") -> DataFrame:
    """One row saying whether the panel is long enough."""
    n = df.agg(F.count_distinct(date).alias("n_days"))
    return n.select("n_days", F.lit(min_days).alias("required"), (F.col("n_days") >= min_days).alias("ok"),
                    F.when(F.col("n_days") < min_days, F.concat(F.lit("only "), F.col("n_days").cast("string"),
                           F.lit(f" overlapping days; need {min_days}"))).alias("reason"))


def series_status(requested: DataFrame, parsed: DataFrame, name: str = "name", value: str = "value",
                  min_points: int = 2) -> DataFrame:
    """Usable or the reason why not, for every requested series."""
    counts = parsed.filter(F.col(value).isNotNull()).groupBy(name).agg(
        F.count(F.lit(1)).alias("n_points"), F.min("d").alias("first"), F.max("d").alias("last"))
    joined = requested.select(name).join(counts, name, "left")
    n = F.coalesce("n_points", F.lit(0))
    return joined.select(
        name, n.alias("n_points"), "first", "last",
        F.when(n == 0, F.lit("unusable: no data")).when(n < min_points, F.lit(f"unusable: fewer than {'two' if min_points == 2 else min_points} values"))
        .otherwise(F.lit("ok")).alias("status"))


def to_returns(prices: DataFrame, value: str = "px", by: list[str] = ["ticker"], date: str = "d") -> DataFrame:
    """Simple returns; the first row of each series has none and is dropped."""
    prev = F.lag(value).over(_w(by, date))
    return (prices.withColumn("_p", prev).filter(F.col("_p").isNotNull())
            .select(*by, date, (F.col(value) / F.col("_p") - 1).alias("r")))


def shift_safe(value: str | Column, k: int, by: list[str], t: str) -> Column:
    """Delay a feature by k periods (advance it for negative k); the gap is null."""
    w = _w(by, t)
    if k > 0:
        return F.lag(value, k).over(w)
    if k < 0:
        return F.lead(value, -k).over(w)
    return F.col(value) if isinstance(value, str) else value


def sma(value: str, width: int, by: list[str], t: str) -> Column:
    """Trailing mean, null until ``width`` rows have been seen."""
    w = _w(by, t)
    frame = w.rowsBetween(-(width - 1), 0)
    return F.when(F.count(value).over(frame) >= width, F.avg(value).over(frame))


def centred_mean(value: str, width: int, by: list[str], t: str) -> Column:
    """Centred mean with zero-padded edges: what is there, over the full width."""
    return F.sum(value).over(_w(by, t).rowsBetween(-(width // 2), width - 1 - width // 2)) / width


def trailing_mean_full(value: str, width: int, by: list[str], t: str) -> Column:
    """Trailing mean with zero-padded start."""
    return F.sum(value).over(_w(by, t).rowsBetween(-(width - 1), 0)) / width


def realised_vol(value: str, width: int, by: list[str], t: str) -> Column:
    """Root mean square over a trailing, zero-padded window."""
    v = F.col(value)
    return F.sqrt(F.sum(v * v).over(_w(by, t).rowsBetween(-(width - 1), 0)) / width)


def roll(value: str, k: int, by: list[str], t: str) -> Column:
    """Circular shift by k periods; rows pushed off one end come in at the other."""
    if k == 0:
        return F.col(value)
    w = _w(by, t)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n, i = F.count(F.lit(1)).over(whole), F.row_number().over(w)
    shifted = F.lag(value, k).over(w) if k > 0 else F.lead(value, -k).over(w)
    # the |k| values that come in at the other end, counted from there: no row holds more of its series
    far = Window.partitionBy(*by).orderBy(F.desc(t)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing) if k > 0 else whole
    ends = F.array(*[F.nth_value(value, j).over(far) for j in range(1, abs(k) + 1)])
    place = F.pmod(F.lit(k) - i, n) if k > 0 else F.pmod(i - 1 - k, n)
    inside = (i > k) if k > 0 else (i <= n + k)
    return F.when(inside, shifted).otherwise(F.get(ends, place.cast("int")))


def price_index(returns: DataFrame, value: str = "r", by: list[str] = ["ticker"], date: str = "d",
                base: float = 100.0) -> DataFrame:
    """Price path cumulated from returns, using nothing later than its own date."""
    w = _w(by, date).rowsBetween(Window.unboundedPreceding, 0)
    return returns.select(*by, date, (F.product(1 + F.col(value)).over(w) * base).alias("px"))


def panel_to_long(wide: DataFrame, date: str = "d", name: str = "ticker", value: str = "r") -> DataFrame:
    """Columns of a panel stacked into rows; empty cells are left out."""
    cols = [c for c in wide.columns if c != date]
    return wide.unpivot([date], cols, name, value).filter(F.col(value).isNotNull())


#: Columns that a panel may have; more names are an error, never left out.
MOST_COLUMNS = 10_000


def long_to_panel(long: DataFrame, names: list[str] | None = None, date: str = "d", name: str = "ticker",
                  value: str = "r") -> DataFrame:
    """Rows pivoted to one column per name, those in the data unless given; over MOST_COLUMNS of them raise ValueError."""
    if names is None:
        names = [r[0] for r in long.select(name).filter(F.col(name).isNotNull()).distinct().limit(MOST_COLUMNS + 1).collect()]
        if len(names) > MOST_COLUMNS:
            raise ValueError(f"more than {MOST_COLUMNS} names for the columns of a panel")
    return long.groupBy(date).pivot(name, sorted(names)).agg(F.first(value))
