import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.functions import measures as M
from evidentia.operators import research as Q
from evidentia.operators import series as T


def frame(spark, y, sid="s"):
    return spark.createDataFrame([(sid, i, float(v)) for i, v in enumerate(y)], "sid string, t bigint, y double")


def test_lookahead_direction(spark):
    y = np.random.default_rng(0).normal(0, 0.011, 900)
    made, names = Q.lookahead_cases(frame(spark, y), ["sid"])
    got = {r.feature: r for r in Q.detect_lookahead(made, ["sid"], names).collect()}
    assert got["copies next period"].contaminated and got["copies next period"].lag_of_max == 1
    assert got["copies this period"].contaminated and got["copies this period"].lag_of_max == 0
    assert not got["momentum"].contaminated and got["momentum"].max_backward_corr > 0.99
    assert not got["trailing mean, lagged"].contaminated and got["centred mean 3"].contaminated
    audit = Q.false_positive_audit(Q.detect_lookahead(made, ["sid"], names), ["sid"]).first()
    assert (audit.n_flagged, audit.true_leaks_caught, audit.lagged_falsely_flagged) == (3, 2, 0)


def test_flat_feature_is_clear(spark):
    df = frame(spark, np.random.default_rng(1).normal(0, 1, 50)).withColumn("flat", F.lit(1.0))
    r = Q.detect_lookahead(df, ["sid"], ["flat"]).first()
    assert r.max_forward_corr == 0.0 and r.lag_of_max == 0 and not r.contaminated


def test_detection_floor(spark):
    y = np.random.default_rng(4).normal(0, 1, 4000)
    f = Q.detection_floor(Q.dilution_sweep(frame(spark, y), ["sid"]), ["sid"]).first()
    assert f.detection_floor == 3 and f.missed == "5,9,21,63"


@pytest.mark.parametrize("span,embargo,dropped,overlap", [
    (20, 0, [0, 20, 20, 20, 20], 0), (20, 20, [20, 40, 40, 40, 20], 0), (1, 0, [0, 1, 1, 1, 1], 18)])
def test_folds(spark, span, embargo, dropped, overlap):
    folds = Q.purged_kfold(frame(spark, [0.0] * 1000), ["sid"], "t", 5, span, embargo)
    rows = sorted(Q.leakage_check(folds, ["sid"], 20).collect(), key=lambda r: r.fold)
    assert [r.n_dropped for r in rows] == dropped and all(r.n_test == 200 for r in rows)
    assert [r.n_overlap for r in rows] == [0] + [overlap] * 4
    tests = folds.filter("role = 'test'")
    assert tests.count() == tests.select("t").distinct().count() == 1000


def test_one_split_is_refused(spark):
    with pytest.raises(ValueError):
        Q.purged_kfold(frame(spark, [0.0]), ["sid"], "t", 1)


def test_survivorship(spark):
    r = spark.createDataFrame([("a", 1, 0.02), ("a", 2, 0.04), ("b", 1, -0.03), ("b", 2, None)], "name string, d int, r double")
    alive = spark.createDataFrame([("a", True), ("b", False)], "name string, alive boolean")
    f = Q.audit_universe(r, alive).first()
    assert (f.n_universe, f.n_survivors, f.n_delisted, f.biased) == (2, 1, 1, True)
    assert f.mean_return_all == 0.01 and f.mean_return_survivors == 0.03 and f.bias_bps == 200.0


def test_sharpe_family_against_numpy(spark):
    r = np.random.default_rng(7).normal(0.0005, 0.01, 750)
    m = frame(spark, r).groupBy("sid").agg(*M.moments("y"))
    got = m.select("skew", "kurt", M.period_sharpe(F.col("mean"), F.col("sd")).alias("sr")).first()
    z = (r - r.mean()) / r.std(ddof=1)
    assert abs(got.skew - np.mean(z ** 3)) < 1e-9 and abs(got.kurt - np.mean(z ** 4)) < 1e-9
    assert abs(got.sr - r.mean() / r.std(ddof=1)) < 1e-12
    rows = {d.n_trials: d for d in Q.deflated_by_trials(m, ["sid"]).collect()}
    assert rows[1].expected_max_from_noise == 0.0 and rows[200].deflated_prob < rows[10].deflated_prob < rows[1].deflated_prob


def test_best_of_many_noise_rules_does_not_survive(spark):
    rng = np.random.default_rng(7)
    paths = rng.normal(0, 0.01, (60, 750))
    rows = [("s", k, k + 1, float(v)) for k, p in enumerate(paths) for v in p]
    scored = Q.score_rules(spark.createDataFrame(rows, "ticker string, fast int, slow int, r double"))
    best = Q.deflate_best(scored).first()
    assert best.n_tried == 60 and best.expected_max_from_noise > 0 and not best.survives


def test_crossover_matches_a_replay(spark):
    px = 100 * np.cumprod(1 + np.random.default_rng(3).normal(0.0004, 0.01, 400))
    d0 = datetime.date(2020, 1, 1)
    df = spark.createDataFrame([("x", d0 + datetime.timedelta(days=i), float(v)) for i, v in enumerate(px)], "ticker string, d date, px double")
    got = {(r.fast, r.slow): r for r in Q.crossover_returns(df, (2, 10), (20, 30)).groupBy("fast", "slow").agg(
        F.count("r").alias("n"), F.sum("r").alias("s")).collect()}
    mean = lambda w: np.array([np.nan if i < w - 1 else px[i - w + 1:i + 1].mean() for i in range(400)])
    for f, s in [(2, 20), (10, 30)]:
        with np.errstate(invalid="ignore"):
            signal = (mean(f) > mean(s)).astype(float)
        want = signal[:-1] * (px[1:] / px[:-1] - 1)
        assert got[(f, s)].n == 399 and abs(got[(f, s)].s - want.sum()) < 1e-9


def test_alignment_keeps_shared_dates_and_last_duplicate(spark):
    d = [datetime.date(2020, 1, k) for k in (1, 2, 3)]
    rows = [("a", d[0], 1.0, 0), ("a", d[1], 2.0, 1), ("a", d[1], 9.0, 2), ("a", d[2], 3.0, 3), ("b", d[1], 5.0, 0), ("b", d[2], 6.0, 1)]
    s = spark.createDataFrame(rows, "name string, d date, value double, seq int")
    got = sorted(T.align(s, order="seq").collect(), key=lambda r: (r.name, r.d))
    assert [(r.name, r.value) for r in got] == [("a", 9.0), ("a", 3.0), ("b", 5.0), ("b", 6.0)]
    assert T.common_dates(s).count() == 2
    assert not T.require_history(s, 5).first().ok


def test_window_features_against_numpy(spark):
    y = np.arange(1.0, 8.0)
    df = frame(spark, y)
    got = df.select("t", T.centred_mean("y", 3, ["sid"], "t").alias("c"), T.centred_mean("y", 4, ["sid"], "t").alias("c4"),
                    T.roll("y", 2, ["sid"], "t").alias("r2"), T.roll("y", -2, ["sid"], "t").alias("r_2"),
                    T.shift_safe("y", 0, ["sid"], "t").alias("same")).orderBy("t").collect()
    assert np.allclose([r.c for r in got], np.convolve(y, np.ones(3) / 3, mode="same"))
    assert np.allclose([r.c4 for r in got], np.convolve(y, np.ones(4) / 4, mode="same"))
    assert [r.r2 for r in got] == list(np.roll(y, 2)) and [r.r_2 for r in got] == list(np.roll(y, -2)) and [r.same for r in got] == list(y)
