"""Series, research-check and selection queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from evidentia.catalogue import sqltext as S
from evidentia.catalogue.lineage import DOCS
from evidentia.catalogue.risk import panel
from evidentia.functions import measures as M
from evidentia.functions.normal import z_value
from evidentia.operators import lineage as K
from evidentia.operators import research as Q
from evidentia.operators import series as T
from evidentia.plans import company_lineage as C
from evidentia.session import stage, task_count
from evidentia.sources import tables as V

BY = ["ticker"]


def _series(spark, sf_dir, p=None):
    """(ticker, t, y): the return panel, clustered by series."""
    p = p or panel(spark, sf_dir)
    return p.select("ticker", F.col("d").alias("t"), F.col("r").alias("y")).repartition(task_count(p), "ticker")


def _prices(spark, sf_dir):
    p = panel(spark, sf_dir)
    return T.price_index(p.repartition(task_count(p), "ticker"), by=BY)


def align(spark, sf_dir):
    return panel(spark, sf_dir).select("ticker", "d", F.round("r", 9).alias("r"))


def common(spark, sf_dir):
    return T.common_dates(V.asset_returns(spark, sf_dir), name="ticker")


def in_range(spark, sf_dir):
    """The benchmark over some years; the range reaches the file scan."""
    lines = T.date_range(V.table(spark, sf_dir, "lineitem"), "1996-03-01", "1999-09-30", "l_shipdate")
    return V.market_of(V.discount_sums_of(lines)).select("d", F.round("b", 9).alias("b"))


def factor(spark, sf_dir):
    sums = stage(V.discount_sums(spark, sf_dir), "sums")
    out = T.join_factor(V.returns_of(sums), V.market_of(sums), lookback=1500)
    return out.groupBy("ticker", "benchmark").agg(F.count("r").alias("n"), F.min("d").alias("first"), F.max("d").alias("last"),
                                                  F.round(F.avg(F.col("r") - F.col("b")), 9).alias("mean_excess"))


def factor_proxy(spark, sf_dir):
    out = T.join_factor(panel(spark, sf_dir), None, lookback=1500)
    return out.groupBy("ticker", "benchmark").agg(F.count("r").alias("n"), F.round(F.avg(F.col("r") - F.col("b")), 9).alias("mean_excess"))


def index_and_returns(spark, sf_dir):
    prices = _prices(spark, sf_dir)
    back = T.to_returns(prices)
    return prices.join(back, ["ticker", "d"], "left").select(
        "ticker", "d", F.round("px", 6).alias("px"), F.round("r", 9).alias("r"))


def window_features(spark, sf_dir):
    s = _series(spark, sf_dir)
    out = s.select(
        "ticker", "t", T.shift_safe("y", 2, BY, "t").alias("delay"), T.shift_safe("y", -1, BY, "t").alias("advance"),
        T.sma("y", 20, BY, "t").alias("sma20"), T.centred_mean("y", 9, BY, "t").alias("centred9"),
        T.trailing_mean_full("y", 5, BY, "t").alias("trailing5"), T.realised_vol("y", 20, BY, "t").alias("vol20"),
        T.roll("y", 1, BY, "t").alias("roll1"), T.roll("y", -1, BY, "t").alias("rollm1"), T.roll("y", 5, BY, "t").alias("roll5"))
    return out.select("ticker", "t", *[F.round(c, 9).alias(c) for c in out.columns if c not in ("ticker", "t")])


def wide_panel(spark, sf_dir):
    wide = T.long_to_panel(panel(spark, sf_dir))
    return wide.select("d", *[F.round(c, 9).alias(c) for c in wide.columns if c != "d"])


def back_to_long(spark, sf_dir):
    wide = T.long_to_panel(V.asset_returns(spark, sf_dir))
    return T.panel_to_long(wide).groupBy("ticker").agg(F.count("r").alias("n"), F.round(F.sum("r"), 6).alias("total"))


def history(spark, sf_dir):
    return T.require_history(panel(spark, sf_dir), 500)


def status(spark, sf_dir):
    """Every part as a requested series; months with a single line are too thin to use."""
    returns, _ = V.name_universe(spark, sf_dir)
    wanted = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("name"))
    return T.series_status(wanted, returns, value="r", min_points=20).groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_points").alias("points"))


def sharpe(spark, sf_dir):
    m = panel(spark, sf_dir).groupBy("ticker").agg(*M.moments("r"), F.round(M.sharpe("r"), 4).alias("sharpe"))
    n, mean, sd, skew, kurt = (F.col(k) for k in ("n", "mean", "sd", "skew", "kurt"))
    return m.select("ticker", "n", "sharpe", F.round("skew", 6).alias("skew"), F.round("kurt", 6).alias("kurt"),
                    F.round(M.probabilistic_sharpe_of(n, mean, sd, skew, kurt), 5).alias("psr"),
                    F.round(M.min_track_record_of(n, mean, sd, skew, kurt), 1).alias("min_track_record"))


def deflated(spark, sf_dir):
    m = panel(spark, sf_dir).groupBy("ticker").agg(*M.moments("r"))
    return Q.deflated_by_trials(m, BY)


def _findings(spark, sf_dir, p=None):
    made, names = Q.lookahead_cases(_series(spark, sf_dir, p), BY)
    return Q.detect_lookahead(made, BY, names)


def lookahead(spark, sf_dir):
    return _findings(spark, sf_dir)


def lookahead_audit(spark, sf_dir):
    return Q.false_positive_audit(_findings(spark, sf_dir), BY)


def dilution(spark, sf_dir):
    return Q.dilution_sweep(_series(spark, sf_dir), BY)


def floor(spark, sf_dir):
    return Q.detection_floor(Q.dilution_sweep(_series(spark, sf_dir), BY), BY)


def universe(spark, sf_dir):
    return Q.audit_universe(*V.name_universe(spark, sf_dir))


def _folds(spark, sf_dir, **kw):
    return Q.purged_kfold(_series(spark, sf_dir), BY, **kw)


def purged(spark, sf_dir):
    return _folds(spark, sf_dir, label_span=20, embargo=20).select("ticker", "fold", "t", "role")


def leakage(spark, sf_dir):
    """Three schemes over one staged series."""
    out, series = None, stage(_series(spark, sf_dir), "series")
    for label, span, emb in (("purged", 20, 0), ("embargoed", 20, 20), ("plain", 1, 0)):
        part = Q.leakage_check(Q.purged_kfold(series, BY, label_span=span, embargo=emb), BY, 20).withColumn("scheme", F.lit(label))
        out = part if out is None else out.unionByName(part)
    return out


def embargoed(spark, sf_dir):
    return Q.embargo(_series(spark, sf_dir), BY, "t", 400, 600, 25).select("ticker", "t")


def overlap(spark, sf_dir):
    return Q.label_overlap(_folds(spark, sf_dir, label_span=1), 20).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))


def _scored(spark, sf_dir):
    return Q.score_rules(Q.crossover_returns(_prices(spark, sf_dir)))


def sweep_rules(spark, sf_dir):
    return _scored(spark, sf_dir).select("ticker", "fast", "slow", "n", "sharpe")


def sweep(spark, sf_dir):
    return Q.deflate_best(stage(_scored(spark, sf_dir), "rules"))


def verdict(spark, sf_dir):
    """The three checks over one panel and the companies' headline values, as recorded and with some sources changed."""
    p = panel(spark, sf_dir)
    findings = stage(_findings(spark, sf_dir, p), "findings")
    deflated_ = Q.deflated_by_trials(p.groupBy("ticker").agg(*M.moments("r")), BY, (200,))
    docs = stage(V.concept_documents(V.company_facts(spark, sf_dir)), "concepts", "ticker")
    values = stage(C.headline(C.derive_metrics(C.company_row(C.located_fields(docs)))), "headline")
    changed = docs.withColumn("text", F.when(F.col("tag") == "CostOfRevenue", F.concat("text", F.lit(" "))).otherwise(F.col("text")))
    out = None
    for sources, label in ((docs, "recorded"), (changed, "changed")):
        part = Q.audit_verdict(findings, deflated_, K.verify_against(values, sources, ["ticker", "metric"])).withColumn("sources", F.lit(label))
        out = part if out is None else out.unionByName(part)
    return out


QUERIES = {
    "series_align": align, "series_common_dates": common, "series_date_range": in_range,
    "series_join_factor": factor, "series_join_proxy": factor_proxy, "series_price_index": index_and_returns,
    "series_window_features": window_features, "series_panel_wide": wide_panel, "series_panel_long": back_to_long,
    "series_require_history": history, "series_status": status,
    "sharpe_ratios": sharpe, "sharpe_deflated": deflated,
    "lookahead_findings": lookahead, "lookahead_audit": lookahead_audit, "lookahead_dilution": dilution,
    "lookahead_detection_floor": floor, "survivorship_audit": universe,
    "folds_purged": purged, "folds_leakage": leakage, "folds_embargo": embargoed, "folds_label_overlap": overlap,
    "sweep_rules": sweep_rules, "sweep_selection": sweep, "audit_verdict": verdict,
}

_Y = "y AS (SELECT ticker, d AS t, r AS y FROM panel)"
_W = "WINDOW w AS (PARTITION BY ticker ORDER BY t)"


def _mean(lo: int, hi: int) -> str:
    return f"sum(y) OVER (w ROWS BETWEEN {lo} PRECEDING AND {hi} FOLLOWING) / {lo + hi + 1}"


_ROLL = {
    1: "coalesce(lag(y) OVER w, last_value(y) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))",
    -1: "coalesce(lead(y) OVER w, first_value(y) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))",
}


def _lookahead_sql(features: dict[str, str], extra: str = "") -> str:
    cols = ", ".join(f"{e} AS f{i}" for i, e in enumerate(features.values()))
    lags = ", ".join([f"lead(y, {k}) OVER w AS a{k}" for k in (1, 2, 3)] + [f"lag(y, {k}) OVER w AS b{k}" for k in (1, 2, 3)])
    stack = " UNION ALL ".join(
        f"SELECT ticker, '{n}' AS feature, coalesce(f{i}, 0) AS x, y AS a0, a1, a2, a3, b1, b2, b3 FROM made"
        for i, n in enumerate(features))
    corr = ", ".join(f"abs(corr(x, {c})) AS {c}" for c in ("a0", "a1", "a2", "a3", "b1", "b2", "b3"))
    return f"""staged AS (SELECT ticker, t, y, {_mean(4, 0)} AS trail,
  sqrt(sum(y * y) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) / 20) AS vol FROM y {_W}),
made AS (SELECT ticker, y, {cols}, {lags} FROM staged {_W}),
stacked AS ({stack}),
cor AS (SELECT ticker, feature, {corr} FROM stacked GROUP BY ticker, feature),
found AS (SELECT ticker, feature, round(greatest(a0, a1, a2, a3), 5) AS max_forward_corr,
  CASE greatest(a0, a1, a2, a3) WHEN a0 THEN 0 WHEN a1 THEN 1 WHEN a2 THEN 2 ELSE 3 END AS lag_of_max,
  round(greatest(b1, b2, b3), 5) AS max_backward_corr, greatest(a0, a1, a2, a3) > 0.5 AS contaminated, a1 FROM cor)"""


_CASES = {
    "copies next period": _ROLL[-1], "copies this period": "y", "centred mean 3": _mean(1, 1),
    "centred mean 9": _mean(4, 4), "momentum": _ROLL[1], "trailing mean, lagged": "lag(trail) OVER w",
    "realised volatility, lagged": "lag(vol) OVER w",
}
_FIND = f"WITH {S.PANEL}, {_Y}, {_lookahead_sql(_CASES)}"
_WIDTHS = (3, 5, 9, 21, 63)
_DILUTE = f"WITH {S.PANEL}, {_Y}, {_lookahead_sql({f'w{w}': _mean(w // 2, w // 2) for w in _WIDTHS})}"
_SIGNED = "signed AS (SELECT ticker, feature, corr(x, a1) AS c FROM stacked GROUP BY ticker, feature)"

_NOISE = {n: 0.0 if n < 2 else ((1 - M.EULER_GAMMA) * z_value(1 - 1 / n)
                                + M.EULER_GAMMA * z_value(1 - 1 / (n * math.e))) * math.sqrt(252)
          for n in (1, 10, 50, 199, 200)}
_PSR_ARG = ("(mean / sd - ({b}) / sqrt(252)) / sqrt(greatest(1e-12,"
            " (1 - skew * (mean / sd) + (kurt - 1) / 4 * (mean / sd) * (mean / sd)) / (n - 1)))")


def _deflated_sql(trials) -> str:
    rows = ", ".join(f"({n}, CAST({_NOISE[n]!r} AS DOUBLE))" for n in trials)
    return f"""m AS {S.moment_table('panel', 'ticker')},
grid AS (SELECT *, unit / sqrt(n) AS noise FROM m, (VALUES {rows}) AS v(n_trials, unit)),
z AS (SELECT *, {_PSR_ARG.format(b='noise')} AS z FROM grid),
deflated AS (SELECT ticker, CAST(n_trials AS INT) AS n_trials, {S.rnd('mean / sd * sqrt(252)', 4)} AS observed_sharpe,
  round(noise, 4) AS expected_max_from_noise, round({S.phi('z')}, 5) AS deflated_prob, {S.phi('z')} > 0.95 AS survives FROM z)"""


_FOLD = """pos AS (SELECT ticker, t, row_number() OVER (PARTITION BY ticker ORDER BY t) - 1 AS i,
                count(*) OVER (PARTITION BY ticker) AS n FROM y),
edges AS (SELECT fold, ticker, t, i, CAST(floor(fold * (n / 5)) AS BIGINT) AS a,
                 CASE WHEN fold = 4 THEN n ELSE CAST(floor((fold + 1) * (n / 5)) AS BIGINT) END AS b
          FROM pos, (SELECT CAST(unnest([0, 1, 2, 3, 4]) AS INT) AS fold))"""


def _roles(span: int, emb: int) -> str:
    return (f"SELECT *, CASE WHEN i >= a AND i < b THEN 'test' WHEN i >= greatest(0, a - {span}) AND i < b THEN 'purged'"
            f" WHEN i >= b AND i < b + {emb} THEN 'embargoed' ELSE 'train' END AS role FROM edges")


def _leak(label: str, span: int, emb: int) -> str:
    return f"""SELECT ticker, fold, count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'test') AS n_test,
  count(*) FILTER (role IN ('purged', 'embargoed')) AS n_dropped,
  count(*) FILTER (role = 'train' AND i < a AND i + 20 > a) AS n_overlap, '{label}' AS scheme
FROM ({_roles(span, emb)}) GROUP BY ticker, fold"""


_FAST, _SLOW = range(2, 22, 2), range(20, 220, 10)
_INDEX = """prices AS (SELECT ticker, d AS t, 100 * product(1 + r) OVER (PARTITION BY ticker ORDER BY d ROWS UNBOUNDED PRECEDING) AS px
  FROM panel)"""
_MEANS = f"""{_INDEX},
means AS (SELECT ticker, lead(px) OVER w / px - 1 AS r, row_number() OVER w AS i,
  {', '.join(f'avg(px) OVER (w ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS m{k}' for k in sorted(set(_FAST) | set(_SLOW)))}
  FROM prices {_W})"""


def _rules_sql() -> str:
    parts = " UNION ALL ".join(
        f"SELECT ticker, {f} AS fast, {s} AS slow, CASE WHEN i >= {s} AND m{f} > m{s} THEN r ELSE 0.0 END AS r FROM means WHERE r IS NOT NULL"
        for f in _FAST for s in _SLOW if f < s)
    moments = S.moment_table("rules", "ticker, fast, slow")
    return f"""{_MEANS}, rules AS ({parts}), m AS {moments},
scored AS (SELECT *, CASE WHEN sd < 1e-15 THEN 0 ELSE round(mean / sd * sqrt(252), 4) END AS sharpe FROM m WHERE n >= 250)"""


_SELECT = f"""best AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY sharpe DESC, fast, slow) AS k,
  count(*) OVER (PARTITION BY ticker) AS n_tried FROM scored),
spread AS (SELECT ticker, max(sharpe) AS hi, median(sharpe) AS mid, min(sharpe) AS lo FROM scored GROUP BY ticker),
z AS (SELECT *, CASE n_tried WHEN 199 THEN {_NOISE[199]!r} END / sqrt(n) AS noise FROM best WHERE k = 1),
zz AS (SELECT *, {_PSR_ARG.format(b='0')} AS z0, {_PSR_ARG.format(b='noise')} AS z1 FROM z)"""

ORACLE = {
    "series_align": f"WITH {S.PANEL} SELECT ticker, d, {S.rnd('r', 9)} AS r FROM panel",
    "series_common_dates": f"WITH {S.PANEL} SELECT DISTINCT d FROM panel",
    "series_date_range": f"""WITH {S.MARKET} SELECT d, {S.rnd('b', 9)} AS b FROM market
WHERE d >= DATE '1996-03-01' AND d <= DATE '1999-09-30'""",
    "series_join_factor": f"""WITH {S.PANEL}, {S.MARKET}, j AS (SELECT ticker, d, r, b FROM ret JOIN market USING (d)),
last AS (SELECT DISTINCT d FROM j ORDER BY d DESC LIMIT 1500)
SELECT ticker, 'factor' AS benchmark, count(*) AS n, min(d) AS first, max(d) AS last, {S.rnd('avg(r - b)', 9)} AS mean_excess
FROM j WHERE d IN (SELECT d FROM last) GROUP BY ticker""",
    "series_join_proxy": f"""WITH {S.PANEL}, mb AS (SELECT d, avg(r) AS b FROM panel GROUP BY d),
last AS (SELECT DISTINCT d FROM panel ORDER BY d DESC LIMIT 1500)
SELECT ticker, 'cross-sectional mean' AS benchmark, count(*) AS n, {S.rnd('avg(r - b)', 9)} AS mean_excess
FROM panel JOIN mb USING (d) WHERE d IN (SELECT d FROM last) GROUP BY ticker""",
    "series_price_index": f"""WITH {S.PANEL}, {_INDEX}
SELECT ticker, t AS d, {S.rnd('px', 6)} AS px, {S.rnd('px / lag(px) OVER w - 1', 9)} AS r FROM prices {_W}""",
    "series_window_features": f"""WITH {S.PANEL}, {_Y}, whole AS (SELECT ticker, list(y ORDER BY t) AS ys FROM y GROUP BY ticker)
SELECT ticker, t, {S.rnd('lag(y, 2) OVER w', 9)} AS delay, {S.rnd('lead(y) OVER w', 9)} AS advance,
  CASE WHEN row_number() OVER w >= 20 THEN {S.rnd(_mean(19, 0), 9)} END AS sma20, {S.rnd(_mean(4, 4), 9)} AS centred9,
  {S.rnd(_mean(4, 0), 9)} AS trailing5, {S.rnd('sqrt(sum(y * y) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) / 20)', 9)} AS vol20,
  {S.rnd(_ROLL[1], 9)} AS roll1, {S.rnd(_ROLL[-1], 9)} AS rollm1,
  {S.rnd('ys[1 + ((row_number() OVER w - 6 + len(ys)) % len(ys))]', 9)} AS roll5
FROM y JOIN whole USING (ticker) {_W}""",
    "series_panel_wide": f"""WITH {S.PANEL} SELECT d, {', '.join(
        f"{S.rnd(f'''max(r) FILTER (ticker = '{c}')''', 9)} AS {c}" for c in ['AF', 'AO', 'NF', 'NO', 'RF', 'RO'])} FROM panel GROUP BY d""",
    "series_panel_long": f"WITH {S.PANEL} SELECT ticker, count(*) AS n, {S.rnd('sum(r)', 6)} AS total FROM ret GROUP BY ticker",
    "series_require_history": f"""WITH {S.PANEL} SELECT count(DISTINCT d) AS n_days, 500 AS required, count(DISTINCT d) >= 500 AS ok,
CASE WHEN count(DISTINCT d) < 500 THEN 'only ' || count(DISTINCT d) || ' overlapping days; need 500' END AS reason FROM panel""",
    "series_status": """WITH m AS (SELECT l_partkey AS name, count(DISTINCT date_trunc('month', l_shipdate)) AS k FROM lineitem GROUP BY 1)
SELECT CASE WHEN coalesce(k, 0) = 0 THEN 'unusable: no data' WHEN k < 20 THEN 'unusable: fewer than 20 values' ELSE 'ok' END AS status,
  count(*) AS n, CAST(sum(coalesce(k, 0)) AS BIGINT) AS points FROM part LEFT JOIN m ON p_partkey = name GROUP BY 1""",
    "sharpe_ratios": f"""WITH {S.PANEL}, m AS {S.moment_table('panel', 'ticker')},
z AS (SELECT *, {_PSR_ARG.format(b='0')} AS z, mean / sd AS sr FROM m)
SELECT ticker, n, {S.rnd('sr * sqrt(252)', 4)} AS sharpe, {S.rnd('skew', 6)} AS skew, {S.rnd('kurt', 6)} AS kurt,
  {S.rnd(S.phi('z'), 5)} AS psr,
  {S.rnd(f'1 + (1 - skew * sr + (kurt - 1) / 4 * sr * sr) * ({z_value(0.95)!r} / sr) * ({z_value(0.95)!r} / sr)', 1)} AS min_track_record
FROM z""",
    "sharpe_deflated": f"WITH {S.PANEL}, {_deflated_sql((1, 10, 50, 200))} SELECT * FROM deflated",
    "lookahead_findings": f"{_FIND} SELECT ticker, feature, max_forward_corr, CAST(lag_of_max AS INT) AS lag_of_max, max_backward_corr, contaminated FROM found",
    "lookahead_audit": f"""{_FIND} SELECT ticker, count(*) FILTER (contaminated) AS n_flagged,
  count(*) FILTER (contaminated AND feature LIKE 'copies%') AS true_leaks_caught,
  count(*) FILTER (contaminated AND (feature LIKE '%lagged' OR feature = 'momentum')) AS lagged_falsely_flagged FROM found GROUP BY ticker""",
    "lookahead_dilution": f"""{_DILUTE}, {_SIGNED} SELECT ticker, CAST(substr(feature, 2) AS INT) AS "window", {S.rnd('c', 4)} AS correlation_with_next,
  round(1 / sqrt(CAST(substr(feature, 2) AS DOUBLE)), 4) AS theoretical, contaminated AS detected FROM found JOIN signed USING (ticker, feature)""",
    "lookahead_detection_floor": f"""{_DILUTE}, wide AS (SELECT ticker, CAST(substr(feature, 2) AS INT) AS k, contaminated FROM found)
SELECT ticker, max(k) FILTER (contaminated) AS detection_floor,
  coalesce(string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) FILTER (NOT contaminated), '') AS missed FROM wide GROUP BY ticker""",
    "survivorship_audit": f"""WITH cells AS (SELECT l_partkey AS name, date_trunc('month', l_shipdate) AS d,
  CAST(sum(CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) / count(*) - 0.05 AS r FROM lineitem GROUP BY 1, 2),
alive AS (SELECT l_partkey AS name, date_diff('day', CAST(max(l_shipdate) AS DATE), (SELECT CAST(max(l_shipdate) AS DATE) FROM lineitem)) <= 180 AS alive
  FROM lineitem GROUP BY 1),
t AS (SELECT count(DISTINCT name) AS n, count(DISTINCT name) FILTER (alive) AS k, avg(r) AS m, avg(r) FILTER (alive) AS s FROM cells JOIN alive USING (name))
SELECT n AS n_universe, k AS n_survivors, n - k AS n_delisted, round(k / n, 4) AS survivor_share, k < n AS biased,
  {S.rnd('m', 6)} AS mean_return_all, {S.rnd('s', 6)} AS mean_return_survivors, {S.rnd('(s - m) * 10000', 2)} AS bias_bps FROM t""",
    "folds_purged": f"WITH {S.PANEL}, {_Y}, {_FOLD} SELECT ticker, fold, t, role FROM ({_roles(20, 20)})",
    "folds_leakage": f"""WITH {S.PANEL}, {_Y}, {_FOLD} {_leak('purged', 20, 0)} UNION ALL {_leak('embargoed', 20, 20)}
UNION ALL {_leak('plain', 1, 0)}""",
    "folds_embargo": f"WITH {S.PANEL}, {_Y}, {_FOLD} SELECT ticker, t FROM pos WHERE i >= 600 AND i < 625",
    "folds_label_overlap": f"""WITH {S.PANEL}, {_Y}, {_FOLD}, tr AS (SELECT * FROM ({_roles(1, 0)}) WHERE role = 'train')
SELECT ticker, count(*) AS n FROM tr WHERE EXISTS (SELECT 1 FROM edges e WHERE e.ticker = tr.ticker AND e.fold = tr.fold
  AND e.i >= e.a AND e.i < e.b AND e.i >= tr.i AND e.i < tr.i + 20) GROUP BY ticker""",
    "sweep_rules": f"WITH {S.PANEL}, {_rules_sql()} SELECT ticker, fast, slow, n, sharpe FROM scored",
    "sweep_selection": f"""WITH {S.PANEL}, {_rules_sql()}, {_SELECT}
SELECT ticker, n_tried, fast, slow, n AS n_obs, sharpe AS best_sharpe, hi AS sharpe_max, round(mid, 4) AS sharpe_median, lo AS sharpe_min,
  round({S.phi('z0')}, 4) AS probabilistic_sharpe, round(noise, 4) AS expected_max_from_noise, round({S.phi('z1')}, 5) AS deflated_prob,
  {S.phi('z1')} > 0.95 AS survives FROM zz JOIN spread USING (ticker)""",
    "audit_verdict": f"""{_FIND}, {_deflated_sql((200,))}, {DOCS},
held AS (SELECT 'recorded' AS sources, 0 AS bad UNION ALL SELECT 'changed', count(*) FROM head WHERE len(list_filter(ds, lambda x: x LIKE '%:CostOfRevenue')) > 0)
SELECT any_contaminated, all_survive, bad = 0 AS all_verified, bad AS n_failed, NOT any_contaminated AND all_survive AND bad = 0 AS passed, sources
FROM (SELECT bool_or(contaminated) AS any_contaminated FROM found), (SELECT bool_and(survives) AS all_survive FROM deflated), held""",
}
