"""Portfolio risk queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.catalogue import sqltext as S
from evidentia.functions import measures as M
from evidentia.functions.normal import z_value
from evidentia.operators import risk as R
from evidentia.operators import series as T
from evidentia.plans import risk_report as P
from evidentia.session import stage
from evidentia.sources import tables as V

Z95, Z05 = z_value(0.95), z_value(1 - 0.95)


def panel_and_market(spark: SparkSession, sf_dir: str, grain: str = "day") -> tuple[DataFrame, DataFrame]:
    """Asset returns on common dates, and the benchmark.

    The fact table is read once for both; its small aggregate is staged, and
    the panel again after the alignment, so that Spark knows its size when it
    plans the joins.
    """
    sums = stage(V.discount_sums(spark, sf_dir, grain), "sums")
    return stage(T.align(V.returns_of(sums), name="ticker", value="r"), "panel"), V.market_of(sums)


def panel(spark: SparkSession, sf_dir: str, grain: str = "day") -> DataFrame:
    return panel_and_market(spark, sf_dir, grain)[0]


def _positions(spark, sf_dir, by="supplier"):
    return stage(V.supplier_positions(spark, sf_dir, by), "positions")


def _nation_series(spark, sf_dir):
    return R.portfolio_paths(_positions(spark, sf_dir, "nation"), panel(spark, sf_dir))


def validate(spark, sf_dir):
    checked = R.validate_portfolios(V.portfolio_requests(spark, sf_dir))
    return checked.select("portfolio_id", F.coalesce(F.size("tickers"), F.lit(-1)).alias("n_tickers"), "ok", "error")


def rejected(spark, sf_dir):
    requests = R.positions_of(R.validate_portfolios(V.portfolio_requests(spark, sf_dir)))
    missing = R.unmatched_positions(requests, V.asset_returns(spark, sf_dir))
    return missing.select("portfolio_id", F.array_join("missing", ",").alias("missing"))


def aligned_positions(spark, sf_dir):
    p, market = panel_and_market(spark, sf_dir)
    bt = R.betas(p, market)
    requests = R.positions_of(R.validate_portfolios(V.portfolio_requests(spark, sf_dir)))
    out = R.align_portfolios(requests, p, bt)
    return out.select("portfolio_id", "ticker", F.round("weight", 9).alias("weight"), F.round("beta", 6).alias("beta"))


def portfolio_daily(spark, sf_dir):
    s = R.portfolio_returns(_positions(spark, sf_dir), panel(spark, sf_dir))
    return s.select("portfolio_id", "d", F.round("r", 9).alias("r"))


def var_methods(spark, sf_dir):
    return R.value_at_risk(R.portfolio_paths(_positions(spark, sf_dir), panel(spark, sf_dir)))


def var_aggregates(spark, sf_dir):
    """The aggregate forms, per asset."""
    return panel(spark, sf_dir).groupBy("ticker").agg(
        F.round(M.historical_var("r"), 6).alias("var_historical"), F.round(M.gaussian_var("r"), 6).alias("var_gaussian"),
        F.round(M.cornish_fisher_var("r"), 6).alias("var_cornish_fisher"), F.round(M.volatility("r"), 6).alias("volatility"))


def shortfall(spark, sf_dir):
    m = R.return_measures(_nation_series(spark, sf_dir))
    return m.select("portfolio_id", "var_historical", "expected_shortfall")


def drawdown(spark, sf_dir):
    m = R.return_measures(_nation_series(spark, sf_dir))
    return m.select("portfolio_id", "max_drawdown", "worst_run_loss", F.col("worst_run_start").cast("bigint").alias("worst_run_start"))


def contributions(spark, sf_dir):
    p = panel(spark, sf_dir)
    pos = _positions(spark, sf_dir)
    return R.risk_contributions(pos, p, R.portfolio_paths(pos, p)).select(
        "portfolio_id", "ticker", "weight", "risk_contribution", "risk_share")


def covariance(spark, sf_dir):
    return R.covariance_matrix(panel(spark, sf_dir)).select("ticker_a", "ticker_b", F.round("cov", 9).alias("cov"))


def beta_table(spark, sf_dir):
    p, market = panel_and_market(spark, sf_dir)
    against = R.betas(p, market).select("ticker", F.round("beta", 6).alias("beta_market"))
    proxy = R.betas(p).select("ticker", F.round("beta", 6).alias("beta_mean"))
    return against.join(proxy, "ticker")


def concentration(spark, sf_dir):
    return R.concentration(V.supplier_positions(spark, sf_dir))


def stress(spark, sf_dir):
    p, market = panel_and_market(spark, sf_dir)
    held = R.align_portfolios(_positions(spark, sf_dir), p, R.betas(p, market))
    return R.stress(held)


def tilt(spark, sf_dir):
    p, market = panel_and_market(spark, sf_dir)
    bt = R.betas(p, market)
    both = R.high_beta_tilt(bt).unionByName(R.high_beta_tilt(bt, 0.18, "HIDDEN-RISK"))
    return both.select("portfolio_id", "ticker", F.round("weight", 6).alias("weight"))


def report(spark, sf_dir, grain="day"):
    p, market = panel_and_market(spark, sf_dir, grain)
    bt = R.betas(p, market)
    out = P.risk_report(_positions(spark, sf_dir), p, bt)
    return out.select(
        "portfolio_id", "n_positions", "observations", "annualised_volatility", "var_historical", "var_gaussian",
        "var_cornish_fisher", "expected_shortfall", "max_drawdown", "worst_run_loss", "hhi", "effective_positions",
        "top3_share", "shock_10", "shock_20")


def _tilted(spark, sf_dir):
    """Nations' portfolios and two tilted ones, with the panel and betas."""
    p, market = panel_and_market(spark, sf_dir)
    bt = R.betas(p, market)
    pos = (V.supplier_positions(spark, sf_dir, "nation")
           .unionByName(R.high_beta_tilt(bt)).unionByName(R.high_beta_tilt(bt, 0.7, "CONCENTRATED")))
    return stage(pos, "positions"), p, bt


def nested(spark, sf_dir):
    """Whole reports: contributions in order of risk and findings in each row."""
    out = P.full_report(*_tilted(spark, sf_dir))
    return out.select(
        "portfolio_id", "n_positions", "var_historical", "hhi", F.size("contributions").alias("n_contributions"),
        F.array_join("contributions.ticker", ",").alias("by_risk"), F.round(F.get("contributions", F.lit(0))["risk_share"], 5).alias("top_share"),
        F.array_join(F.transform("checks", lambda c: F.concat_ws(":", c["level"], c["code"])), ",").alias("checks"))


def checks(spark, sf_dir):
    pos, p, bt = _tilted(spark, sf_dir)
    rep = P.risk_report(pos, p, bt)
    parts = R.risk_contributions(pos, p, R.portfolio_paths(pos, p))
    return R.risk_checks(rep, parts).select("portfolio_id", "level", "code")


def backtest(spark, sf_dir):
    out = R.var_backtest(_nation_series(spark, sf_dir))
    return out.select("portfolio_id", "alpha", "tested", "test_observations", "expected_exceptions",
                      "observed_exceptions", "exception_rate", "kupiec_lr", "kupiec_p", "independence_lr",
                      "independence_p", "cc_lr", "cc_p")


def backtest_hits(spark, sf_dir):
    return R.hit_counts(R.rolling_var_hits(_nation_series(spark, sf_dir), (0.95,)))


QUERIES = {
    "portfolio_validate": validate,
    "portfolio_rejected": rejected,
    "portfolio_aligned": aligned_positions,
    "portfolio_returns": portfolio_daily,
    "risk_var_methods": var_methods,
    "risk_var_aggregates": var_aggregates,
    "risk_expected_shortfall": shortfall,
    "risk_drawdown": drawdown,
    "risk_contributions": contributions,
    "risk_covariance": covariance,
    "risk_betas": beta_table,
    "risk_concentration": concentration,
    "risk_stress": stress,
    "risk_high_beta_tilt": tilt,
    "risk_report": report,
    "risk_report_nested": nested,
    "risk_checks": checks,
    "var_backtest": backtest,
    "var_backtest_hits": backtest_hits,
}

_REQUESTS = """request AS (
  SELECT portfolio_id || ':' || v AS portfolio_id, v,
         CASE v WHEN 'unknown' THEN ['ZZ'] WHEN 'twice' THEN list_concat(t, t) WHEN 'missing' THEN NULL
                WHEN 'empty' THEN [] ELSE t END AS tickers,
         CASE v WHEN 'scaled' THEN list_transform(w, lambda x: x * 0.9) WHEN 'short' THEN w[1:1]
                WHEN 'unknown' THEN [1.0] WHEN 'twice' THEN list_transform(list_concat(w, w), lambda x: x * 0.5)
                WHEN 'nan' THEN list_transform(w, lambda x: CAST('nan' AS DOUBLE)) WHEN 'missing' THEN NULL
                WHEN 'empty' THEN [] ELSE w END AS weights
  FROM (SELECT portfolio_id, list(ticker ORDER BY ticker) AS t, list(weight ORDER BY ticker) AS w
        FROM positions GROUP BY portfolio_id),
       unnest(['sound','scaled','short','unknown','twice','nan','missing','empty']) AS u(v)),
checked AS (
  SELECT *, CASE
    WHEN tickers IS NULL OR weights IS NULL THEN 'missing field'
    WHEN len(tickers) <> len(weights) THEN 'tickers and weights have different lengths'
    WHEN len(tickers) = 0 THEN 'portfolio is empty'
    WHEN len(list_distinct(tickers)) <> len(tickers) THEN 'duplicate tickers'
    WHEN len(list_filter(weights, lambda x: isnan(x) OR isinf(x))) > 0 THEN 'weights contain NaN or inf'
    WHEN abs(list_sum(weights) - 1) > 1e-6 THEN 'weights sum to ' || printf('%.6f', list_sum(weights)) || ', not 1.0'
  END AS error FROM request)"""

_CUT = "cut AS (SELECT portfolio_id, quantile_cont(r, 0.05) AS q FROM series GROUP BY portfolio_id)"

_CURVE = f"""curve AS (
  SELECT portfolio_id, d, r, row_number() OVER w - 1 AS i,
         product(1 + r) OVER (w ROWS UNBOUNDED PRECEDING) AS c,
         product(1 + r) OVER (w ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) - 1 AS run,
         count(*) OVER (w ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS k
  FROM series WINDOW w AS (PARTITION BY portfolio_id ORDER BY d)),
falls AS (
  SELECT portfolio_id, max((peak - c) / peak) AS dd FROM (
    SELECT portfolio_id, c, max(c) OVER (PARTITION BY portfolio_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS peak FROM curve)
  GROUP BY portfolio_id),
runs AS (
  SELECT portfolio_id, -min(run) AS loss, arg_min(i, run) AS start FROM curve WHERE k = 20 GROUP BY portfolio_id)"""

_TAIL = """tail AS (
  SELECT portfolio_id, -avg(r) AS es FROM series JOIN cut USING (portfolio_id) WHERE r <= q GROUP BY portfolio_id)"""

_CF = ("-(mean + (z + (z*z - 1) * skew / 6 + (z*z*z - 3*z) * (kurt - 3) / 24"
       " - (2*z*z*z - 5*z) * skew * skew / 36) * sd)")

_CONC = """conc AS (
  SELECT portfolio_id, count(*) AS n_positions, sum(p * p) AS hhi, sum(p) FILTER (k <= 3) AS top3 FROM (
    SELECT portfolio_id, abs(weight) / sum(abs(weight)) OVER (PARTITION BY portfolio_id) AS p,
           row_number() OVER (PARTITION BY portfolio_id ORDER BY abs(weight) DESC, ticker) AS k FROM positions)
  GROUP BY portfolio_id)"""

_CONTRIB = """parts AS (
  SELECT positions.portfolio_id, positions.ticker, any_value(weight) AS weight, covar_samp(panel.r, series.r) AS cov
  FROM positions JOIN panel USING (ticker) JOIN series ON series.portfolio_id = positions.portfolio_id AND series.d = panel.d
  GROUP BY 1, 2),
shares AS (
  SELECT portfolio_id, ticker, weight, weight * cov / total AS c, weight * cov / (total * total) AS share
  FROM (SELECT *, sqrt(sum(weight * cov) OVER (PARTITION BY portfolio_id)) AS total FROM parts))"""

_HITS = """ranked AS (
  SELECT portfolio_id, d, r, row_number() OVER w AS i,
         quantile_cont(r, 1 - 0.95) OVER f AS q95, quantile_cont(r, 1 - 0.99) OVER f AS q99
  FROM series WINDOW w AS (PARTITION BY portfolio_id ORDER BY d),
       f AS (PARTITION BY portfolio_id ORDER BY d ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING)),
hits AS (
  SELECT portfolio_id, 0.95 AS alpha, d, CAST(r < q95 AS INT) AS hit FROM ranked WHERE i > 250
  UNION ALL SELECT portfolio_id, 0.99, d, CAST(r < q99 AS INT) FROM ranked WHERE i > 250),
counts AS (
  SELECT portfolio_id, CAST(alpha AS DOUBLE) AS alpha, count(*) AS n, sum(hit) AS x,
         count(*) FILTER (prev = 0 AND hit = 0) AS n00, count(*) FILTER (prev = 0 AND hit = 1) AS n01,
         count(*) FILTER (prev = 1 AND hit = 0) AS n10, count(*) FILTER (prev = 1 AND hit = 1) AS n11
  FROM (SELECT *, lag(hit) OVER (PARTITION BY portfolio_id, alpha ORDER BY d) AS prev FROM hits)
  GROUP BY 1, 2)"""

_ll = S.bernoulli_ll
_TESTS = f"""rates AS (
  SELECT *, 1 - alpha AS p, x / n AS pi, CASE WHEN n00 + n01 > 0 THEN n01 / (n00 + n01) ELSE 0 END AS pi01,
         CASE WHEN n10 + n11 > 0 THEN n11 / (n10 + n11) ELSE 0 END AS pi11,
         (n01 + n11) / (n00 + n01 + n10 + n11) AS pooled FROM counts),
ratios AS (
  SELECT *, greatest(0.0, -2 * ({_ll('x', 'n', 'p')} - {_ll('x', 'n', 'pi')})) AS uc,
         greatest(0.0, -2 * ({_ll('(n01 + n11)', '(n00 + n01 + n10 + n11)', 'pooled')}
           - {_ll('n01', '(n00 + n01)', 'pi01')} - {_ll('n11', '(n10 + n11)', 'pi11')})) AS ind FROM rates),
roots AS (SELECT *, -sqrt(uc) AS zu, -sqrt(ind) AS zi FROM ratios)"""

_TILT = """order_b AS (SELECT ticker, row_number() OVER (ORDER BY beta DESC, ticker DESC) AS k, count(*) OVER () AS n FROM betas)"""


def _tilt(name: str, top: float) -> str:
    return (f"SELECT '{name}' AS portfolio_id, ticker, CASE WHEN k = 1 THEN {top} ELSE (1 - {top}) / (n - 1) END AS weight"
            " FROM order_b")


_REPORT_TABLES = ", ".join([S.SERIES, _CUT, _TAIL, _CURVE, _CONC,
                            f"m AS (SELECT *, CAST({Z05!r} AS DOUBLE) AS z FROM {S.moment_table('series', 'portfolio_id')})"])

_REPORT_COLUMNS = f"""
  {S.rnd('sd * sqrt(252)', 6)} AS annualised_volatility, {S.rnd('-q', 6)} AS var_historical,
  {S.rnd(f'-(mean - {Z95!r} * sd)', 6)} AS var_gaussian, {S.rnd(_CF, 6)} AS var_cornish_fisher,
  {S.rnd('es', 6)} AS expected_shortfall, {S.rnd('dd', 6)} AS max_drawdown,
  {S.rnd('loss', 6)} AS worst_run_loss, {S.rnd('hhi', 5)} AS hhi,
  {S.rnd('1 / hhi', 2)} AS effective_positions, {S.rnd('top3', 4)} AS top3_share"""

_REPORT_FROM = """m JOIN cut USING (portfolio_id) JOIN tail USING (portfolio_id) JOIN falls USING (portfolio_id)
  JOIN runs USING (portfolio_id) JOIN conc USING (portfolio_id)"""

_FINDINGS = f"""WITH {S.NATION_POSITIONS.replace('positions AS', 'nation_positions AS')}, {S.PANEL}, {S.MARKET}, {S.BETAS}, {_TILT},
positions AS (SELECT portfolio_id, ticker, weight FROM nation_positions
  UNION ALL {_tilt('HIGH-BETA-TILT', 0.40)} UNION ALL {_tilt('CONCENTRATED', 0.7)}),
{_REPORT_TABLES}, {_CONTRIB},
rep AS (SELECT portfolio_id, n_positions, n AS observations, {_REPORT_COLUMNS} FROM {_REPORT_FROM}),
shown AS (SELECT portfolio_id, round(weight, 5) AS weight, round(share, 5) AS share,
                 row_number() OVER (PARTITION BY portfolio_id ORDER BY abs(round(c, 12)) DESC, ticker) AS k, ticker FROM shares),
found AS (SELECT portfolio_id, 'warn' AS level, 'concentrated' AS code FROM rep WHERE effective_positions / n_positions < 0.55
UNION ALL SELECT portfolio_id, 'warn', 'risk_concentration' FROM shown WHERE k = 1 AND share > 0.40
UNION ALL SELECT DISTINCT portfolio_id, 'warn', 'risk_capital_mismatch' FROM shown WHERE weight > 0.02 AND share / weight > 1.4
UNION ALL SELECT portfolio_id, 'info', 'non_normal_tail' FROM rep
  WHERE var_gaussian > 0 AND (var_cornish_fisher - var_gaussian) / var_gaussian > 0.05
UNION ALL SELECT portfolio_id, 'warn', 'short_history' FROM rep WHERE observations < 250)"""

ORACLE = {
    "portfolio_validate": f"""WITH {S.SUPPLIER_POSITIONS}, {_REQUESTS}
SELECT portfolio_id, CAST(coalesce(len(tickers), -1) AS INT) AS n_tickers, error IS NULL AS ok, error FROM checked""",
    "portfolio_rejected": f"""WITH {S.SUPPLIER_POSITIONS}, {_REQUESTS}
SELECT portfolio_id, string_agg(DISTINCT t, ',' ORDER BY t) AS missing
FROM (SELECT portfolio_id, unnest(tickers) AS t FROM checked WHERE error IS NULL)
WHERE t NOT IN (SELECT l_returnflag || l_linestatus FROM lineitem) GROUP BY portfolio_id""",
    "portfolio_aligned": f"""WITH {S.SUPPLIER_POSITIONS}, {_REQUESTS}, {S.PANEL}, {S.MARKET}, {S.BETAS},
spread AS (SELECT portfolio_id, len(tickers) AS n, unnest(tickers) AS ticker, unnest(weights) AS weight FROM checked WHERE error IS NULL),
priced AS (SELECT spread.*, beta, count(beta) OVER (PARTITION BY portfolio_id) AS k FROM spread LEFT JOIN betas ON betas.ticker = spread.ticker)
SELECT portfolio_id, ticker, {S.rnd('weight', 9)} AS weight, {S.rnd('beta', 6)} AS beta FROM priced WHERE k = n""",
    "portfolio_returns": f"""WITH {S.SUPPLIER_POSITIONS}, {S.PANEL}, {S.SERIES}
SELECT portfolio_id, d, {S.rnd('r', 9)} AS r FROM series""",
    "risk_var_methods": f"""WITH {S.SUPPLIER_POSITIONS}, {S.PANEL}, {S.SERIES}, {_CUT},
m AS (SELECT *, CAST({Z05!r} AS DOUBLE) AS z FROM {S.moment_table('series', 'portfolio_id')})
SELECT portfolio_id, {S.rnd('-q', 6)} AS var_historical, {S.rnd(f'-(mean - {Z95!r} * sd)', 6)} AS var_gaussian,
       {S.rnd(_CF, 6)} AS var_cornish_fisher, {S.rnd('sd * sqrt(252)', 6)} AS volatility, n AS observations
FROM m JOIN cut USING (portfolio_id)""",
    "risk_var_aggregates": f"""WITH {S.PANEL}, cut AS (SELECT ticker, quantile_cont(r, 0.05) AS q FROM panel GROUP BY ticker),
m AS (SELECT *, CAST({Z05!r} AS DOUBLE) AS z FROM {S.moment_table('panel', 'ticker')})
SELECT ticker, {S.rnd('-q', 6)} AS var_historical, {S.rnd(f'-(mean - {Z95!r} * sd)', 6)} AS var_gaussian,
       {S.rnd(_CF, 6)} AS var_cornish_fisher, {S.rnd('sd * sqrt(252)', 6)} AS volatility FROM m JOIN cut USING (ticker)""",
    "risk_expected_shortfall": f"""WITH {S.NATION_POSITIONS}, {S.PANEL}, {S.SERIES}, {_CUT}, {_TAIL}
SELECT portfolio_id, {S.rnd('-q', 6)} AS var_historical, {S.rnd('es', 6)} AS expected_shortfall
FROM cut JOIN tail USING (portfolio_id)""",
    "risk_drawdown": f"""WITH {S.NATION_POSITIONS}, {S.PANEL}, {S.SERIES}, {_CURVE}
SELECT portfolio_id, {S.rnd('dd', 6)} AS max_drawdown, {S.rnd('loss', 6)} AS worst_run_loss, start AS worst_run_start
FROM falls JOIN runs USING (portfolio_id)""",
    "risk_contributions": f"""WITH {S.SUPPLIER_POSITIONS}, {S.PANEL}, {S.SERIES}, {_CONTRIB}
SELECT portfolio_id, ticker, {S.rnd('weight', 5)} AS weight, {S.rnd('c', 8)} AS risk_contribution,
       {S.rnd('share', 5)} AS risk_share FROM shares""",
    "risk_covariance": f"""WITH {S.PANEL}
SELECT a.ticker AS ticker_a, b.ticker AS ticker_b, {S.rnd('covar_samp(a.r, b.r)', 9)} AS cov
FROM panel a JOIN panel b USING (d) WHERE a.ticker <= b.ticker GROUP BY 1, 2""",
    "risk_betas": f"""WITH {S.PANEL}, {S.MARKET}, {S.BETAS},
mean_b AS (SELECT d, avg(r) AS b FROM panel GROUP BY d),
proxy AS (SELECT ticker, covar_pop(r, b) / var_pop(b) AS beta FROM panel JOIN mean_b USING (d) GROUP BY ticker)
SELECT ticker, {S.rnd('betas.beta', 6)} AS beta_market, {S.rnd('proxy.beta', 6)} AS beta_mean
FROM betas JOIN proxy USING (ticker)""",
    "risk_concentration": f"""WITH {S.SUPPLIER_POSITIONS}, {_CONC}
SELECT portfolio_id, n_positions, {S.rnd('hhi', 5)} AS hhi, {S.rnd('1 / hhi', 2)} AS effective_positions,
       {S.rnd('top3', 4)} AS top3_share FROM conc""",
    "risk_stress": f"""WITH {S.SUPPLIER_POSITIONS}, {S.PANEL}, {S.MARKET}, {S.BETAS}
SELECT portfolio_id, shock, {S.rnd('sum(weight * beta) * shock', 6)} AS move
FROM positions JOIN betas USING (ticker), unnest([CAST(-0.1 AS DOUBLE), CAST(-0.2 AS DOUBLE)]) AS u(shock)
GROUP BY portfolio_id, shock""",
    "risk_high_beta_tilt": f"""WITH {S.PANEL}, {S.MARKET}, {S.BETAS}, {_TILT}
SELECT portfolio_id, ticker, {S.rnd('CAST(weight AS DOUBLE)', 6)} AS weight
FROM ({_tilt('HIGH-BETA-TILT', 0.40)} UNION ALL {_tilt('HIDDEN-RISK', 0.18)})""",
    "risk_report": f"""WITH {S.SUPPLIER_POSITIONS}, {S.PANEL}, {S.MARKET}, {S.BETAS}, {_REPORT_TABLES},
moved AS (SELECT portfolio_id, sum(weight * beta) AS wb FROM positions JOIN betas USING (ticker) GROUP BY portfolio_id)
SELECT portfolio_id, n_positions, n AS observations, {_REPORT_COLUMNS},
       {S.rnd('wb * -0.10', 6)} AS shock_10, {S.rnd('wb * -0.20', 6)} AS shock_20
FROM {_REPORT_FROM} JOIN moved USING (portfolio_id)""",
    "risk_checks": f"{_FINDINGS} SELECT * FROM found",
    "risk_report_nested": f"""{_FINDINGS},
in_order AS (SELECT portfolio_id, count(*) AS n, string_agg(ticker, ',' ORDER BY k) AS by_risk, max(share) FILTER (k = 1) AS top_share FROM shown GROUP BY portfolio_id),
told AS (SELECT portfolio_id, string_agg(level || ':' || code, ',' ORDER BY level, code) AS checks FROM found GROUP BY portfolio_id)
SELECT portfolio_id, n_positions, var_historical, hhi, n AS n_contributions, by_risk, top_share, coalesce(checks, '') AS checks
FROM rep JOIN in_order USING (portfolio_id) LEFT JOIN told USING (portfolio_id)""",
    "var_backtest": f"""WITH {S.NATION_POSITIONS}, {S.PANEL}, {S.SERIES}, {_HITS}, {_TESTS}
SELECT portfolio_id, alpha, true AS tested, n AS test_observations, {S.rnd('p * n', 2)} AS expected_exceptions,
       CAST(x AS BIGINT) AS observed_exceptions, {S.rnd('pi', 5)} AS exception_rate,
       {S.rnd('uc', 4)} AS kupiec_lr, {S.rnd('least(1.0, 2 * ' + S.phi('zu') + ')', 4)} AS kupiec_p,
       {S.rnd('ind', 4)} AS independence_lr, {S.rnd('least(1.0, 2 * ' + S.phi('zi') + ')', 4)} AS independence_p,
       {S.rnd('uc + ind', 4)} AS cc_lr, {S.rnd('exp(-(uc + ind) / 2)', 4)} AS cc_p
FROM roots""",
    "var_backtest_hits": f"""WITH {S.NATION_POSITIONS}, {S.PANEL}, {S.SERIES}, {_HITS}
SELECT portfolio_id, alpha, n, CAST(x AS BIGINT) AS x, n00, n01, n10, n11 FROM counts WHERE alpha = 0.95""",
}
