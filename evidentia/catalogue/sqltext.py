"""Pieces of SQL shared by the counterparts: derived tables and closed-form functions."""

from __future__ import annotations

from evidentia.functions import normal as N

PANEL = """ret AS (
  SELECT l_returnflag || l_linestatus AS ticker, CAST(l_shipdate AS DATE) AS d,
         CAST(sum(CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) / count(*) - 0.05 AS r
  FROM lineitem GROUP BY 1, 2),
panel AS (
  SELECT ticker, d, r FROM ret WHERE d IN (
    SELECT d FROM ret GROUP BY d
    HAVING count(DISTINCT ticker) = (SELECT count(DISTINCT ticker) FROM ret)))"""

MARKET = """market AS (
  SELECT CAST(l_shipdate AS DATE) AS d,
         CAST(sum(CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) / count(*) - 0.05 AS b
  FROM lineitem GROUP BY 1)"""


def positions(owner: str = "'S' || printf('%09d', l_suppkey)", source: str = "lineitem") -> str:
    return f"""held AS (
  SELECT {owner} AS portfolio_id, l_returnflag || l_linestatus AS ticker,
         sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS v
  FROM {source} GROUP BY 1, 2),
positions AS (
  SELECT portfolio_id, ticker,
         CAST(v AS DOUBLE) / CAST(sum(v) OVER (PARTITION BY portfolio_id) AS DOUBLE) AS weight
  FROM held)"""


SUPPLIER_POSITIONS = positions()
NATION_POSITIONS = positions("'N' || printf('%02d', s_nationkey)", "lineitem JOIN supplier ON l_suppkey = s_suppkey")

SERIES = """series AS (
  SELECT portfolio_id, d, sum(weight * r) AS r
  FROM positions JOIN panel USING (ticker) GROUP BY portfolio_id, d)"""

BETAS = """betas AS (
  SELECT ticker, covar_pop(r, b) / var_pop(b) AS beta
  FROM panel JOIN market USING (d) GROUP BY ticker)"""


def rnd(expr: str, digits: int) -> str:
    """Rounded, with a negative zero turned positive."""
    return f"round({expr}, {digits}) + 0.0"


def moments(r: str = "r") -> str:
    n = f"count({r})"
    m = f"avg({r})"
    return (f"{n} AS n, {m} AS mean, stddev_samp({r}) AS sd")


MOMENT_TABLE = """(
  SELECT {keys}, any_value(n) AS n, any_value(mean) AS mean, any_value(sd) AS sd,
         avg(power((r - mean) / sd, 3)) AS skew, avg(power((r - mean) / sd, 4)) AS kurt
  FROM (SELECT *, count(r) OVER w AS n, avg(r) OVER w AS mean, stddev_samp(r) OVER w AS sd
        FROM {source} WINDOW w AS (PARTITION BY {keys}))
  GROUP BY {keys})"""


def moment_table(source: str, keys: str) -> str:
    """Moments by the definition: standardise each value, then average its powers."""
    return MOMENT_TABLE.format(source=source, keys=keys)


def _horner(coefficients, x: str) -> str:
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def phi(x: str) -> str:
    """Normal distribution function of a column (pass a plain name)."""
    a = f"abs({x})"
    e = f"exp(-{a} * {a} / 2)"
    near = f"{e} * {_horner(N.CDF_NUM, a)} / {_horner(N.CDF_DEN, a)}"
    frac = f"({a} + 0.65)"
    for k in (4, 3, 2, 1):
        frac = f"({a} + {k} / {frac})"
    far = f"{e} / {frac} / {N.CDF_TAIL_SCALE!r}"
    tail = f"(CASE WHEN {a} > 37 THEN 0 WHEN {a} < {N.CDF_SPLIT!r} THEN {near} ELSE {far} END)"
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


def bernoulli_ll(k: str, n: str, p: str) -> str:
    return (f"(CASE WHEN {k} > 0 THEN {k} * ln({p}) ELSE 0 END"
            f" + CASE WHEN {n} - ({k}) > 0 THEN ({n} - ({k})) * ln(1 - ({p})) ELSE 0 END)")
