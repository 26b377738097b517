"""Ledger queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evidentia.operators import ledger as L
from evidentia.session import shared_folder
from evidentia.sources import tables as V
from evidentia.sources.ledger_pages import read_ledger, write_ledger
from evidentia.sources.sinks import ledger_stream, read_batches
from evidentia.streaming.messages import read_stream

# Keyword rules of this catalogue: the built-in ones, then some for part names.
RULES = {**L.CATEGORY_KEYWORDS, "Kitchen": ["plate"], "Hardware": ["bolt", "gear", "rod"], "Jewellery": ["ring"]}


def _plain(df):
    """Money as doubles for output."""
    return df.select(*[F.col(n).cast("double").alias(n) if t.startswith("decimal") else F.col(n) for n, t in df.dtypes])


def _typed(spark, sf_dir):
    """Entries without a category, for what does not ask for one."""
    return L.entry_type_amount(V.ledger_entries(spark, sf_dir))


def _cells(spark, sf_dir):
    return L.category_cells(V.ledger_entries(spark, sf_dir), RULES)


def _over(fn, *args):
    return lambda spark, sf_dir: _plain(fn(_cells(spark, sf_dir), *args))


def _over_typed(fn, *args):
    return lambda spark, sf_dir: _plain(fn(_typed(spark, sf_dir), *args))


def types(spark, sf_dir):
    return _plain(_cells(spark, sf_dir).groupBy("category", "type").agg(F.sum("n").alias("n"), F.sum("amount").alias("amount")))


def labelled(spark, sf_dir):
    """Recorded labels: descriptions of the larger parts carry the part's brand."""
    part = V.table(spark, sf_dir, "part")
    labels = part.filter(F.col("p_size") > 45).select(
        F.concat_ws(" ", "p_type", "p_name").alias("description"), F.col("p_brand").alias("category"))
    out = L.classify(V.ledger_entries(spark, sf_dir), RULES, labels)
    return _plain(out.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum("payment").alias("payment")))


def validated(spark, sf_dir):
    v = L.validate_entries(V.ledger_entries(spark, sf_dir))
    return v.groupBy(F.array_join("errors", "; ").alias("errors")).agg(F.count(F.lit(1)).alias("n"))


def recategorised(spark, sf_dir):
    e = L.classify(V.ledger_entries(spark, sf_dir), {"Kitchen": ["plate"]})
    out = L.recategorise(e, RULES)
    return out.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("updated").cast("int")).alias("updated"))


def rollup(spark, sf_dir):
    out = L.type_first_sort(L.category_rollup(_cells(spark, sf_dir)))
    return _plain(out.withColumn("accounts", F.array_join("accounts", ", ")))


def anomalies(spark, sf_dir):
    out = L.anomalies(V.ledger_entries(spark, sf_dir), 2.0, RULES)
    return _plain(out.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount")))


def anomalies_top(spark, sf_dir):
    out = L.anomalies(V.ledger_entries(spark, sf_dir), 2.0, RULES)
    return _plain(out.select("entry_id", "category", "amount").orderBy(F.desc("amount"), "entry_id").limit(10))


def insights(spark, sf_dir):
    return _plain(L.spending_insights(_typed(spark, sf_dir)).withColumn(
        "avg_daily_expense", F.round("avg_daily_expense", 4)))


def top_categories(spark, sf_dir):
    return _plain(L.top_categories(_cells(spark, sf_dir)).withColumn("avg", F.round("avg", 4)))


def trends(spark, sf_dir):
    return _plain(L.trend_stats(_typed(spark, sf_dir)).withColumn("mean", F.round("mean", 4)))


def running(spark, sf_dir):
    out = L.running_total(V.ledger_entries(spark, sf_dir), ["account"])
    return _plain(out.select("entry_id", "account", "date", "payment", "cumulative"))


def paged(spark, sf_dir):
    """The ledger as pages, read back for four months: pages outside them are not opened."""
    path = f"{shared_folder(spark)}/evidentia/ledger-{uuid.uuid4().hex}"
    write_ledger(V.ledger_entries(spark, sf_dir), path)
    out = read_ledger(spark, path).filter(F.col("date").between(F.lit("1995-03-01").cast("date"), F.lit("1995-06-30").cast("date")))
    return _plain(out.withColumn("entry_id", F.col("entry_id").cast("bigint")))


def replayed(spark, sf_dir):
    """Entries streamed into a ledger and streamed again after the checkpoint was lost, by category."""
    base = f"{shared_folder(spark)}/evidentia/replay-{uuid.uuid4().hex}"
    entries = V.ledger_entries_of(read_stream(spark, sf_dir, "lineitem"), V.table(spark, sf_dir, "part"))
    for attempt in ("first", "second"):
        ledger_stream(entries, f"{base}/ledger", f"{base}/{attempt}")
    out = read_batches(spark, f"{base}/ledger")
    return _plain(out.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum("payment").alias("payment")))


QUERIES = {
    "ledger_paged": paged,
    "ledger_replayed": replayed,
    "ledger_dashboard": lambda s, d: _plain(L.dashboard(V.ledger_entries(s, d), RULES)),
    "ledger_types": types,
    "ledger_labelled": labelled,
    "ledger_validate": validated,
    "ledger_recategorise": recategorised,
    "ledger_category_summary": _over(L.category_summary),
    "ledger_time_buckets": _over_typed(L.time_buckets),
    "ledger_account_summary": _over_typed(L.account_summary),
    "ledger_merchant_top": _over_typed(L.merchant_top),
    "ledger_balance": _over_typed(L.balance),
    "ledger_insights": insights,
    "ledger_top_categories": top_categories,
    "ledger_anomalies": anomalies,
    "ledger_anomalies_top": anomalies_top,
    "ledger_by_month": _over_typed(L.income_expense_by_period, "yyyy-MM"),
    "ledger_by_day": _over_typed(L.income_expense_by_period, "yyyy-MM-dd"),
    "ledger_share_category": _over(L.share_by_type, "category", "Uncategorized"),
    "ledger_share_account": _over_typed(L.share_by_type, "account", "Other"),
    "ledger_category_rollup": rollup,
    "ledger_summary_cards": lambda s, d: _plain(L.summary_cards(L.category_summary(_cells(s, d)))),
    "ledger_distinct_descriptions": lambda s, d: L.distinct_by_category(V.ledger_entries(s, d), RULES),
    "ledger_running_total": running,
    "ledger_daily_running_total": _over_typed(L.daily_running_total),
    "ledger_trend_stats": trends,
    "ledger_last_days": _over_typed(L.last_n_periods),
    "ledger_date_extent": _over_typed(L.date_extent),
}


def _case(rules: dict[str, list[str]], text: str = "lower(description)") -> str:
    arms = " ".join(
        "WHEN " + " OR ".join(f"contains({text}, '{w}')" for w in words) + f" THEN '{c}'" for c, words in rules.items())
    return f"CASE {arms} ELSE 'Uncategorized' END"


_BASE = """raw AS (
  SELECT l_orderkey * 8 + l_linenumber AS entry_id,
         CASE WHEN CAST(l_discount AS DECIMAL(4,2)) < 0.10 THEN CAST(l_shipdate AS DATE) END AS date,
         p_type || ' ' || p_name AS description,
         CAST(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2))
              ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS DECIMAL(18,2)) AS payment,
         CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END AS deposit,
         CASE WHEN l_linestatus = 'O' THEN p_brand ELSE '' END AS account
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

_E = f"""WITH {_BASE}, e AS (
  SELECT *, CASE WHEN deposit > 0 AND payment = 0 THEN 'Income' ELSE 'Expense' END AS type,
         CASE WHEN deposit > 0 AND payment = 0 THEN deposit ELSE payment END AS amount,
         {_case(RULES)} AS category FROM raw)"""


def _d(expr: str, name: str) -> str:
    return f"CAST({expr} AS DOUBLE) AS {name}"


_STATS = f"""stats AS (SELECT category, sum(amount) AS total, count(*) AS count,
  CAST(sum(amount) AS DOUBLE) / count(*) AS avg FROM e WHERE type = 'Expense' GROUP BY category)"""
_SUMMARY = """SELECT category, sum(amount) AS total, count(*) AS count,
  coalesce(sum(deposit) FILTER (type = 'Income'), 0) AS income,
  coalesce(sum(payment) FILTER (type = 'Expense' AND payment > 0), 0) AS expense FROM e GROUP BY category"""


def _period(fmt: str) -> str:
    return f"""{_E} SELECT strftime(date, '{fmt}') AS period, {_d("coalesce(sum(amount) FILTER (type = 'Income'), 0)", 'income')},
  {_d("coalesce(sum(amount) FILTER (type = 'Expense'), 0)", 'expense')} FROM e WHERE date IS NOT NULL GROUP BY 1"""


def _share(dim: str, blank: str) -> str:
    return f"""{_E} SELECT type, name, {_d('total', 'total')}, count,
  round(CAST(total AS DOUBLE) / CAST(sum(total) OVER (PARTITION BY type) AS DOUBLE), 4) AS share
  FROM (SELECT type, coalesce(nullif({dim}, ''), '{blank}') AS name, sum(amount) AS total, count(*) AS count FROM e GROUP BY 1, 2)"""


_CARD = "coalesce(sum(amount) FILTER (type = 'Income'), 0)::DOUBLE AS income, coalesce(sum(amount) FILTER (type = 'Expense'), 0)::DOUBLE AS expense, count(*) AS count FROM e"

ORACLE = {
    "ledger_dashboard": f"""{_E}
SELECT 'category' AS card, category AS name, {_CARD} GROUP BY 2 UNION ALL SELECT 'account', coalesce(nullif(account, ''), 'Other'), {_CARD} GROUP BY 2
UNION ALL SELECT 'month', strftime(date, '%Y-%m'), {_CARD} WHERE date IS NOT NULL GROUP BY 2
UNION ALL SELECT 'weekday', CAST(dayofweek(date) + 1 AS VARCHAR), {_CARD} WHERE date IS NOT NULL GROUP BY 2 UNION ALL SELECT 'all', 'balance', {_CARD}""",
    "ledger_replayed": f"""WITH {_BASE} SELECT {_case(L.CATEGORY_KEYWORDS)} AS category, count(*) AS n, {_d('sum(payment)', 'payment')} FROM raw GROUP BY 1""",
    "ledger_paged": f"""WITH {_BASE} SELECT entry_id, date, description, {_d('payment', 'payment')}, {_d('deposit', 'deposit')}, account FROM raw
WHERE date BETWEEN DATE '1995-03-01' AND DATE '1995-06-30'""",
    "ledger_types": f"{_E} SELECT category, type, count(*) AS n, {_d('sum(amount)', 'amount')} FROM e GROUP BY 1, 2",
    "ledger_labelled": f"""WITH {_BASE}, labels AS (SELECT p_type || ' ' || p_name AS description, min(p_brand) AS label
  FROM part WHERE p_size > 45 GROUP BY 1)
SELECT coalesce(label, {_case(RULES)}) AS category, count(*) AS n, {_d('sum(payment)', 'payment')}
FROM raw LEFT JOIN labels USING (description) GROUP BY 1""",
    "ledger_validate": f"""WITH {_BASE} SELECT concat_ws('; ', CASE WHEN trim(description) = '' THEN 'Description is required' END,
  CASE WHEN payment <= 0 THEN 'Payment must be greater than 0' END, CASE WHEN account = '' THEN 'Account is required' END,
  CASE WHEN date IS NULL THEN 'Date is required' END) AS errors, count(*) AS n FROM raw GROUP BY 1""",
    "ledger_recategorise": f"""WITH {_BASE}, c AS (SELECT CASE WHEN contains(lower(description), 'plate') THEN 'Kitchen' ELSE 'Uncategorized' END AS old,
  {_case(RULES)} AS new FROM raw)
SELECT CASE WHEN old = 'Uncategorized' AND new <> 'Uncategorized' THEN new ELSE old END AS category, count(*) AS n,
  count(*) FILTER (old = 'Uncategorized' AND new <> 'Uncategorized') AS updated FROM c GROUP BY 1""",
    "ledger_category_summary": f"""{_E} SELECT category, count, {_d('total', 'total')}, {_d('income', 'income')}, {_d('expense', 'expense')}
FROM ({_SUMMARY})""",
    "ledger_time_buckets": f"""{_E}, d AS (SELECT date, payment FROM e WHERE date IS NOT NULL)
SELECT 'day' AS grain, CAST(date AS VARCHAR) AS bucket, {_d('sum(payment)', 'payment')} FROM d GROUP BY 2
UNION ALL SELECT 'week', CAST(CAST(date - CAST(dayofweek(date) AS INT) AS DATE) AS VARCHAR), CAST(sum(payment) AS DOUBLE) FROM d GROUP BY 2
UNION ALL SELECT 'month', strftime(date, '%Y-%m'), CAST(sum(payment) AS DOUBLE) FROM d GROUP BY 2""",
    "ledger_account_summary": f"""{_E} SELECT coalesce(nullif(account, ''), 'Other') AS account, {_d('sum(payment)', 'total')}, count(*) AS count
FROM e GROUP BY 1""",
    "ledger_merchant_top": f"""{_E} SELECT description, {_d('sum(payment)', 'total')}, count(*) AS count FROM e GROUP BY 1
ORDER BY sum(payment) DESC, description LIMIT 20""",
    "ledger_balance": f"""{_E} SELECT {_d('i', 'income')}, {_d('x', 'expense')}, {_d('i - x', 'balance')} FROM (
  SELECT sum(deposit) FILTER (type = 'Income') AS i, sum(payment) FILTER (type = 'Expense' AND payment > 0) AS x FROM e)""",
    "ledger_insights": f"""{_E} SELECT {_d('i', 'income')}, {_d('x', 'expense')}, {_d('i - x', 'balance')}, entries,
  round(CAST(x AS DOUBLE) / greatest(1, dates), 4) AS avg_daily_expense FROM (
  SELECT sum(amount) FILTER (type = 'Income') AS i, sum(amount) FILTER (type = 'Expense') AS x, count(*) AS entries,
         count(DISTINCT coalesce(CAST(date AS VARCHAR), '')) AS dates FROM e)""",
    "ledger_top_categories": f"{_E}, {_STATS} SELECT category, {_d('total', 'total')}, count, round(avg, 4) AS avg FROM stats ORDER BY total DESC, category LIMIT 5",
    "ledger_anomalies": f"""{_E}, {_STATS} SELECT category, count(*) AS n, {_d('sum(amount)', 'amount')} FROM e JOIN stats USING (category)
WHERE type = 'Expense' AND CAST(amount AS DOUBLE) > avg * 2.0 GROUP BY 1""",
    "ledger_anomalies_top": f"""{_E}, {_STATS} SELECT entry_id, category, {_d('amount', 'amount')} FROM e JOIN stats USING (category)
WHERE type = 'Expense' AND CAST(amount AS DOUBLE) > avg * 2.0 ORDER BY e.amount DESC, entry_id LIMIT 10""",
    "ledger_by_month": _period("%Y-%m"),
    "ledger_by_day": _period("%Y-%m-%d"),
    "ledger_share_category": _share("category", "Uncategorized"),
    "ledger_share_account": _share("account", "Other"),
    "ledger_category_rollup": f"""{_E}, r AS (SELECT category, sum(amount) AS total, coalesce(sum(amount) FILTER (type = 'Income'), 0) AS income,
  coalesce(sum(amount) FILTER (type = 'Expense'), 0) AS expense, count(*) FILTER (type = 'Income') AS income_count,
  count(*) FILTER (type = 'Expense') AS expense_count,
  string_agg(DISTINCT account, ', ' ORDER BY account) FILTER (account <> '') AS accounts,
  string_agg(DISTINCT type, ', ' ORDER BY type) AS types FROM e GROUP BY category),
p AS (SELECT *, CASE WHEN income >= expense THEN 'Income' ELSE 'Expense' END AS primary_type FROM r)
SELECT category, {_d('total', 'total')}, {_d('income', 'income')}, {_d('expense', 'expense')}, income_count, expense_count, accounts, types,
  primary_type, CAST(row_number() OVER (ORDER BY primary_type, p.total DESC, category) AS INT) AS rank FROM p""",
    "ledger_summary_cards": f"""{_E}, s AS ({_SUMMARY}) SELECT {_d('sum(total)', 'total')}, CAST(sum(count) AS BIGINT) AS count, count(*) AS categories,
  arg_max(category, total) FILTER (total > 0) AS top_category FROM s""",
    "ledger_distinct_descriptions": f"""WITH {_BASE}, d AS (SELECT DISTINCT description, {_case(RULES)} AS category FROM raw)
SELECT category, description, count(*) OVER (PARTITION BY category) AS n_in_category FROM d""",
    "ledger_running_total": f"""WITH {_BASE} SELECT entry_id, account, date, {_d('payment', 'payment')}, {_d('''sum(payment) OVER (
  PARTITION BY account ORDER BY date, entry_id, payment ROWS UNBOUNDED PRECEDING)''', 'cumulative')} FROM raw WHERE date IS NOT NULL""",
    "ledger_daily_running_total": f"""WITH {_BASE}, d AS (SELECT date, sum(payment) AS p FROM raw WHERE date IS NOT NULL GROUP BY 1)
SELECT date, {_d('p', 'payment')}, {_d('sum(p) OVER (ORDER BY date)', 'cumulative')} FROM d""",
    "ledger_trend_stats": f"""WITH {_BASE} SELECT count(*) AS rows, round(CAST(sum(payment) AS DOUBLE) / count(*), 4) AS mean, {_d('max(payment)', 'highest')},
  {_d('sum(payment)', 'total')} FROM raw WHERE date IS NOT NULL""",
    "ledger_last_days": f"""WITH {_BASE} SELECT date, {_d('sum(payment)', 'payment')} FROM raw WHERE date IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 30""",
    "ledger_date_extent": f"WITH {_BASE} SELECT min(date) AS first, max(date) AS last FROM raw",
}
