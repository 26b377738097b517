import datetime
import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.functions import measures as M
from evidentia.functions import normal as N
from evidentia.operators import risk as R

D0 = datetime.date(2020, 1, 1)


def series(spark, values, pid="P"):
    rows = [(pid, D0 + datetime.timedelta(days=i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "portfolio_id string, d date, r double")


def panel(spark, matrix):
    return spark.createDataFrame([(k, D0 + datetime.timedelta(days=i), float(v)) for k, vs in matrix.items() for i, v in enumerate(vs)],
                                 "ticker string, d date, r double")


def test_normal_functions(spark):
    xs = [-38.0, -9.0, -7.5, -1.0, 0.0, 0.3, 2.5, 8.0, 40.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", N.norm_cdf(F.col("x")).alias("p")).collect():
        assert abs(r.p - 0.5 * math.erfc(-r.x / math.sqrt(2))) < 1e-15
    ps = [1e-6, 0.01, 0.3, 0.5, 0.9, 0.995, 1 - 1e-6]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    for r in df.select("p", N.norm_ppf(F.col("p")).alias("z")).collect():
        assert abs(r.z - NormalDist().inv_cdf(r.p)) < 1e-9


def test_chi_square_and_likelihood(spark):
    r = spark.range(1).select(
        N.chi2_sf(F.lit(3.841458820694124), 1).alias("a"), N.chi2_sf(F.lit(5.991464547107979), 2).alias("b"), N.chi2_sf(F.lit(-1.0), 1).alias("c"),
        N.bernoulli_ll(F.lit(0), F.lit(10), F.lit(0.0)).alias("d"), N.bernoulli_ll(F.lit(1), F.lit(10), F.lit(0.0)).alias("e")).first()
    assert abs(r.a - 0.05) < 1e-12 and abs(r.b - 0.05) < 1e-12 and r.c == 1.0 and r.d == 0.0 and r.e == -math.inf
    with pytest.raises(ValueError):
        N.chi2_sf(F.lit(1.0), 3)


def test_historical_var_is_the_interpolated_quantile(spark):
    v = np.linspace(-0.1, 0.1, 201)
    got = series(spark, v).agg(M.historical_var("r").alias("v")).first().v
    assert abs(got + np.quantile(v, 0.05)) < 1e-12


def test_measures_against_numpy(spark):
    rng = np.random.default_rng(1)
    r = rng.standard_t(3, 600) * 0.01
    m = R.return_measures(series(spark, r)).first()
    cut = np.quantile(r, 0.05)
    curve = np.cumprod(1 + r)
    runs = [np.prod(1 + r[i:i + 20]) - 1 for i in range(len(r) - 19)]
    assert abs(m.var_historical + cut) < 1e-6 and abs(m.expected_shortfall + r[r <= cut].mean()) < 1e-6
    assert abs(m.max_drawdown - np.max(1 - curve / np.maximum.accumulate(curve))) < 1e-6
    assert abs(m.worst_run_loss + min(runs)) < 1e-6 and m.worst_run_start == int(np.argmin(runs))


def test_first_point_is_the_first_peak(spark):
    assert R.return_measures(series(spark, [0.0, -0.5, 0.0])).first().max_drawdown == 0.5
    assert R.return_measures(series(spark, [-0.5, 0.0, 0.0])).first().max_drawdown == 0.0


def test_short_series_has_no_worst_run(spark):
    m = R.return_measures(series(spark, [0.01, -0.02])).first()
    assert m.worst_run_loss == 0.0 and m.worst_run_start == 0


def test_left_tail_raises_cornish_fisher(spark):
    rng = random.Random(3)
    r = [rng.gauss(0.0005, 0.01) - (0.06 if rng.random() < 0.02 else 0) for _ in range(2000)]
    m = R.value_at_risk(series(spark, r)).first()
    assert m.var_cornish_fisher > m.var_gaussian


def test_contributions_add_up(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 0.01, (300, 3))
    p = panel(spark, {"a": x[:, 0], "b": x[:, 1] + x[:, 0], "c": 2 * x[:, 2]})
    w = {"a": 0.5, "b": 0.3, "c": 0.2}
    pos = spark.createDataFrame([("P", k, v, "") for k, v in w.items()], "portfolio_id string, ticker string, weight double, as_of string")
    s = R.portfolio_returns(pos, p)
    parts = R.risk_contributions(pos, p, s).collect()
    sd = s.agg(F.stddev_samp("r").alias("sd")).first().sd
    assert abs(sum(r.risk_contribution for r in parts) - sd) < 1e-7 and abs(sum(r.risk_share for r in parts) - 1) < 1e-4
    assert [r.position for r in sorted(parts, key=lambda r: -abs(r.risk_contribution))] == [1, 2, 3]


def test_unknown_ticker_rejects_the_portfolio(spark):
    p = panel(spark, {"a": [0.1, 0.2], "b": [0.0, 0.1]})
    pos = spark.createDataFrame([("P", "a", 0.5), ("P", "zz", 0.5), ("Q", "b", 1.0)], "portfolio_id string, ticker string, weight double")
    assert {r.portfolio_id for r in R.align_portfolios(pos, p).collect()} == {"Q"}
    assert R.unmatched_positions(pos, p).first().missing == ["zz"]


def test_validation_order(spark):
    rows = [("len", ["a"], [0.5, 0.5]), ("empty", [], []), ("dup", ["a", "a"], [0.5, 0.5]), ("nan", ["a"], [float("nan")]),
            ("sum", ["a"], [0.9]), ("none", None, None), ("ok", ["a", "b"], [0.4, 0.6])]
    got = {r.portfolio_id: r.error for r in R.validate_portfolios(
        spark.createDataFrame(rows, "portfolio_id string, tickers array<string>, weights array<double>")).collect()}
    assert got["ok"] is None and got["len"].endswith("different lengths") and got["empty"] == "portfolio is empty"
    assert got["dup"] == "duplicate tickers" and got["nan"] == "weights contain NaN or inf" and got["sum"] == "weights sum to 0.900000, not 1.0"
    assert got["none"] == "missing field"


def test_backtest_counts_match_a_replay(spark):
    rng = np.random.default_rng(9)
    r = rng.normal(0, 0.01, 700)
    got = R.hit_counts(R.rolling_var_hits(series(spark, r), (0.95,))).first()
    hits = [int(r[t] < np.quantile(r[t - 250:t], 1 - 0.95)) for t in range(250, 700)]
    assert got.n == 450 and got.x == sum(hits)
    assert got.n11 == sum(a and b for a, b in zip(hits, hits[1:])) and got.n00 + got.n01 + got.n10 + got.n11 == 449


def test_backtest_rejects_rising_volatility_and_reports_short_history(spark):
    rng = np.random.default_rng(2)
    calm = rng.normal(0, 0.01, 800)
    ramp = rng.normal(0, 0.01, 800) * np.linspace(1, 6, 800)
    s = series(spark, calm, "calm").union(series(spark, ramp, "ramp")).union(series(spark, calm[:100], "short"))
    got = {r.portfolio_id: r for r in R.var_backtest(s, (0.95,)).collect()}
    assert got["calm"].kupiec_p > 0.05 and got["ramp"].kupiec_p < 0.01
    assert not got["short"].tested and got["short"].kupiec_p is None


def test_concentration_and_tilt(spark):
    pos = spark.createDataFrame([("P", k, 0.25) for k in "abcd"], "portfolio_id string, ticker string, weight double")
    c = R.concentration(pos).first()
    assert c.hhi == 0.25 and c.effective_positions == 4.0 and c.top3_share == 0.75
    t = {r.ticker: r.weight for r in R.high_beta_tilt(spark.createDataFrame([("a", 0.4), ("b", 2.0), ("c", 1.0)], "ticker string, beta double")).collect()}
    assert t["b"] == 0.40 and abs(sum(t.values()) - 1) < 1e-12


def test_contributions_add_up_where_calendars_differ(spark):
    """Days that only one side has are left out; paths are never matched by position."""
    import datetime

    import numpy as np

    rng = np.random.default_rng(3)
    day = lambda i: datetime.date(2020, 1, 1) + datetime.timedelta(days=int(i))
    path = {"A": {day(i): float(x) for i, x in enumerate(rng.normal(0, 0.01, 200))}, "B": {day(i + 50): float(x) for i, x in enumerate(rng.normal(0, 0.02, 200))}}
    returns = spark.createDataFrame([(t, d, r) for t, p in path.items() for d, r in p.items()], "ticker string, d date, r double")
    positions = spark.createDataFrame([("p", "A", 0.4), ("p", "B", 0.6)], "portfolio_id string, ticker string, weight double")
    both = sorted(set(path["A"]) & set(path["B"]))
    total = [0.4 * path["A"][d] + 0.6 * path["B"][d] for d in both]
    series = spark.createDataFrame([("p", d, r) for d, r in zip(both, total)], "portfolio_id string, d date, r double")
    got = {r["ticker"]: r["risk_contribution"] for r in R.risk_contributions(positions, returns, series).collect()}
    assert abs(sum(got.values()) - np.std(total, ddof=1)) < 1e-7


@pytest.mark.parametrize("held, salt", [(512, 1024), (1, 2)])
def test_portfolio_vectors_against_a_plain_sum(spark, monkeypatch, held, salt):
    """Unequal calendars, a portfolio of most positions, repeated assets, one without a name, weights and assets that are missing."""
    monkeypatch.setattr(R, "HELD", held)
    monkeypatch.setattr(R, "SALT", salt)
    rng = np.random.default_rng(4)
    days = {f"t{i}": range(i % 5, 40 - i % 3) for i in range(12)}
    rows = [(t, D0 + datetime.timedelta(days=d), float(rng.normal())) for t, own in days.items() for d in own] + [("t0", D0 + datetime.timedelta(days=99), None)]
    held_rows = [("big", f"t{i % 12}", float(rng.normal())) for i in range(40)] + [(f"p{i}", f"t{i % 12}", 1.0 + i) for i in range(9)]
    held_rows += [(None, "t3", 2.0), ("p1", "t2", None), ("gone", "zz", 1.0)]
    want = {}
    for p, t, w in held_rows:
        for name, d, r in rows:
            if name == t and r is not None and w is not None:
                want[p, d] = want.get((p, d), 0.0) + w * r
    returns = spark.createDataFrame(rows, "ticker string, d date, r double")
    positions = spark.createDataFrame(held_rows, "portfolio_id string, ticker string, weight double")
    got = {(x.portfolio_id, x.d): x.r for x in R.portfolio_returns(positions.repartition(5), returns).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert R.portfolio_returns(positions.filter("false"), returns).count() == 0


@pytest.mark.parametrize("tile", [256, 3, 1])
def test_covariance_by_tiles(spark, tile):
    rng = np.random.default_rng(6)
    rows = [(f"t{i}", D0 + datetime.timedelta(days=d), float(rng.normal())) for i in range(8) for d in range(i, 30)]
    rows += [("late", D0 + datetime.timedelta(days=29), 0.5), ("apart", D0 + datetime.timedelta(days=500), 0.1)]
    by = {}
    for t, d, r in rows:
        by.setdefault(t, {})[d] = r
    got = {(x.ticker_a, x.ticker_b): x["cov"] for x in R.covariance_matrix(spark.createDataFrame(rows, "ticker string, d date, r double"), tile).collect()}
    want = {}
    for a in by:
        for b in by:
            both = sorted(set(by[a]) & set(by[b]))
            if a <= b and both:
                want[a, b] = np.cov([by[a][d] for d in both], [by[b][d] for d in both])[0, 1] if len(both) > 1 else None
    assert got.keys() == want.keys()
    assert all(got[k] is None if want[k] is None else abs(got[k] - want[k]) < 1e-12 for k in want)


@pytest.mark.parametrize("window", [1, 5, 250])
def test_rolling_quantiles_do_not_depend_on_how_they_are_found(spark, window):
    rng = np.random.default_rng(window)
    flat = {"ties": rng.choice([-0.02, 0.0, 0.01], 400), "wide": rng.standard_t(2, 400), "short": rng.normal(size=window)}
    s = None
    for k, v in flat.items():
        s = series(spark, v, k) if s is None else s.union(series(spark, v, k))
    got = {(r.portfolio_id, r.alpha, (r.d - D0).days): (r["var"], r.hit) for r in R.rolling_var(s.repartition(3), (0.95, 0.6), window).collect()}
    assert len(got) == 2 * 2 * (400 - window)
    for (k, a, i), (var, hit) in got.items():
        cut = np.quantile(flat[k][i - window:i], 1 - a)
        assert abs(var + cut) < 1e-12 and (hit == int(flat[k][i] < cut) or abs(flat[k][i] - cut) < 1e-12)


def test_no_rows_per_position_and_day(spark):
    """Positions and assets meet as vectors: nothing is exploded before the sums."""
    p = panel(spark, {"a": [0.1, 0.2], "b": [0.0, 0.1]})
    pos = spark.createDataFrame([("P", "a", 0.5), ("P", "b", 0.5)], "portfolio_id string, ticker string, weight double")
    plan = R.portfolio_paths(pos, p)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("MapInArrow") == 2
    assert "Window" not in R.rolling_var(series(spark, [0.1] * 300))._jdf.queryExecution().optimizedPlan().toString()


def test_whole_paths_go_to_python_a_few_at_a_time(spark):
    """Batches of 10,000 paths once filled the workers."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, "10000")
    rows = spark.range(3).select(F.col("id").alias("portfolio_id"), F.array(*[F.lit(x) for x in (0.1, -0.2, 0.3)]).alias("path"))
    try:
        for asked, got in (("10000", 256), ("0", 256), ("7", 7)):
            spark.conf.set(key, asked)
            assert R.value_at_risk(rows).count() == 3 and int(spark.conf.get(key)) == got
    finally:
        spark.conf.set(key, before)
