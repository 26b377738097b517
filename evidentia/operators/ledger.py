"""Ledger analytics over (entry_id, date, description, payment, deposit, account)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.session import stage

UNCATEGORIZED = "Uncategorized"

# Category keywords, in the order they are tried.
CATEGORY_KEYWORDS = {
    "Income1": ["income1"],
    "Income2": ["income2"],
    "Income3": ["income3"],
    "Income4": ["income4"],
    "Income5": ["income5"],
    "Food & Dining": ["grocery", "geocery", "starbucks", "coffee", "stsrbucks", "dinner", "lunch", "cafe", "wee",
                      "trade joe", "h mart", "lamian", "ice cream", "snacks", "dish", "gum", "mocha",
                      "purple drinks", "ice coffee"],
    "Transportation": ["uber", "bus", "subway", "ticket", "air", "ny-boston", "travel-taxi", "travel bus"],
    "Shopping": ["shein", "scarf", "socks", "case", "clothes", "cloth", "decoration", "tv", "mount", "stand", "spray",
                 "mop", "glue", "file", "headphone", "iphone", "laptop", "laplop", "mask", "lighting", "plant",
                 "battery", "map", "item"],
    "Entertainment": ["tennis", "card", "big head", "headshot", "boost", "swimming", "pool"],
    "Health & Wellness": ["yoga", "nail", "tail", "white", "body"],
    "Utilities & Bills": ["spectrum", "equipment", "membership", "cursor", "ieee", "mint", "mobile", "apple care",
                          "ai tools"],
    "Travel": ["travel", "visa", "hotel", "airbnb", "chicago", "boston", "ohio", "back home", "chicago to boston"],
    "Services": ["logistic", "application", "opt", "editing", "set up", "mounting"],
    "Other": ["daily expense", "expense"],
}


def keyword_category(description: Column, rules: dict[str, list[str]] = CATEGORY_KEYWORDS) -> Column:
    """First category, in declared order, one of whose keywords the text contains.

    One alternation per category keeps the expression small enough to be
    compiled.
    """
    low = F.lower(description)
    out = F.when(description.isNull() | (description == ""), UNCATEGORIZED)
    for category, words in rules.items():
        out = out.when(F.rlike(low, F.lit("|".join(re.escape(w) for w in words))), category)
    return out.otherwise(UNCATEGORIZED)


def classify(entries: DataFrame, rules: dict[str, list[str]] = CATEGORY_KEYWORDS,
             labels: DataFrame | None = None) -> DataFrame:
    """Add ``category``: a recorded label for the description if there is one, else the keyword rule.

    ``labels`` is (description, category). Descriptions repeat a great deal, so
    the rules run once per distinct description; that table is staged, and its
    measured size decides how it is joined back.
    """
    kinds = description_categories(entries, rules)
    if labels is not None:
        known = labels.groupBy(F.col("description").alias("_text")).agg(F.min("category").alias("_label"))
        kinds = kinds.join(known, "_text", "left").select("_text", F.coalesce("_label", "_category").alias("_category"))
    return _with_kinds(entries, kinds).withColumnRenamed("_category", "category")


def description_categories(entries: DataFrame, rules: dict[str, list[str]] = CATEGORY_KEYWORDS) -> DataFrame:
    """(_text, _category): the keyword rules' answer per distinct description, staged."""
    kinds = entries.select(F.col("description").alias("_text")).distinct()
    return stage(kinds.withColumn("_category", keyword_category(F.col("_text"), rules)), "descriptions")


def _with_kinds(entries: DataFrame, kinds: DataFrame) -> DataFrame:
    return entries.join(kinds, F.col("description").eqNullSafe(F.col("_text")), "left").drop("_text")


def entry_type_amount(entries: DataFrame) -> DataFrame:
    """Add ``type`` and ``amount``: income only when there is a deposit and no payment."""
    income = (F.col("deposit") > 0) & (F.col("payment") == 0)
    return entries.withColumn("type", F.when(income, "Income").otherwise("Expense")).withColumn(
        "amount", F.when(income, F.col("deposit")).otherwise(F.col("payment")))


def drop_undated(entries: DataFrame) -> DataFrame:
    return entries.filter(F.col("date").isNotNull())


def validate_entries(entries: DataFrame) -> DataFrame:
    """Add ``errors``: every rule an entry breaks."""
    rule = lambda bad, text: F.when(bad, F.lit(text))
    # The four messages.
    return entries.withColumn("errors", F.array_compact(F.array(
        rule(F.coalesce(F.trim("description"), F.lit("")) == "", "Description is required"),
        rule(F.coalesce(F.col("payment") <= 0, F.lit(True)), "Payment must be greater than 0"),
        rule(F.coalesce("account", F.lit("")) == "", "Account is required"),
        rule(F.col("date").isNull(), "Date is required"))))


def recategorise(entries: DataFrame, rules: dict[str, list[str]] = CATEGORY_KEYWORDS) -> DataFrame:
    """Fill missing categories where a rule matches; ``updated`` marks the rows changed."""
    bare = F.col("category").isNull() | (F.col("category") == UNCATEGORIZED)
    e = _with_kinds(entries, description_categories(entries, rules))
    changed = bare & (F.col("_category") != UNCATEGORIZED)
    return e.withColumn("updated", changed).withColumn(
        "category", F.when(F.col("updated"), F.col("_category")).otherwise(F.col("category"))).drop("_category")


# --- cells -----------------------------------------------------------------

def category_cells(entries: DataFrame, rules: dict[str, list[str]] = CATEGORY_KEYWORDS, labels: DataFrame | None = None) -> DataFrame:
    """(category, description, account, type, amount, deposit, payment, n): sums of the entries that agree in what cards ask for, staged.

    Entries are added up by description before they have a category, so they are
    read once and never sent by category; the rules run once per distinct
    description of the cells. Every function below that groups by category takes
    cells as it takes entries. ``payment`` adds the positive ones.
    """
    zero = F.lit(0).cast("decimal(18,2)")
    cells = entry_type_amount(entries).groupBy("description", "account", "type").agg(
        F.sum("amount").alias("amount"), F.sum("deposit").alias("deposit"), F.sum(F.when(F.col("payment") > 0, F.col("payment")).otherwise(zero)).alias("payment"),
        F.count(F.lit(1)).alias("n"))
    return classify(stage(cells, "cells"), rules, labels)


def rows_in(df: DataFrame) -> Column:
    """Entries behind a row: its ``n`` for cells, else the row itself."""
    return F.sum("n") if "n" in df.columns else F.count(F.lit(1))


def category_summary(entries: DataFrame) -> DataFrame:
    income = F.col("type") == "Income"
    zero = F.lit(0).cast("decimal(18,2)")
    return entries.groupBy("category").agg(
        F.sum("amount").alias("total"), rows_in(entries).alias("count"),
        F.sum(F.when(income, F.col("deposit")).otherwise(zero)).alias("income"),
        F.sum(F.when(~income & (F.col("payment") > 0), F.col("payment")).otherwise(zero)).alias("expense"))


def week_start(d: Column) -> Column:
    """The Sunday on or before a date."""
    return F.date_sub(d, F.dayofweek(d) - 1)


def time_buckets(entries: DataFrame) -> DataFrame:
    """(grain, bucket, payment) per day, week and month.

    Days are totalled first, so weeks and months are built from one row per day.
    """
    days = drop_undated(entries).groupBy("date").agg(F.sum("payment").alias("payment"))
    d = F.col("date")
    kinds = F.array(
        F.struct(F.lit("day").alias("grain"), d.cast("string").alias("bucket")),
        F.struct(F.lit("week").alias("grain"), week_start(d).cast("string").alias("bucket")),
        F.struct(F.lit("month").alias("grain"), F.date_format(d, "yyyy-MM").alias("bucket")))
    return days.select("payment", F.explode(kinds).alias("k")).groupBy("k.grain", "k.bucket").agg(
        F.sum("payment").alias("payment"))


def account_summary(entries: DataFrame) -> DataFrame:
    account = F.coalesce(F.nullif("account", F.lit("")), F.lit("Other"))
    return entries.groupBy(account.alias("account")).agg(F.sum("payment").alias("total"), F.count(F.lit(1)).alias("count"))


def merchant_top(entries: DataFrame, k: int = 20) -> DataFrame:
    """The k descriptions with the largest payments; equal totals go by name."""
    return entries.groupBy("description").agg(
        F.sum("payment").alias("total"), F.count(F.lit(1)).alias("count")).orderBy(F.desc("total"), "description").limit(k)


def balance(entries: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("decimal(18,2)")
    income = F.sum(F.when(F.col("type") == "Income", F.col("deposit")).otherwise(zero))
    spent = F.sum(F.when((F.col("type") == "Expense") & (F.col("payment") > 0), F.col("payment")).otherwise(zero))
    return entries.agg(income.alias("income"), spent.alias("expense"), (income - spent).alias("balance"))


def expense_stats(entries: DataFrame) -> DataFrame:
    return entries.filter(F.col("type") == "Expense").groupBy("category").agg(
        F.sum("amount").alias("total"), rows_in(entries).alias("count"),
        (F.sum("amount").cast("double") / rows_in(entries)).alias("avg"))


def spending_insights(entries: DataFrame) -> DataFrame:
    """Totals and the mean expense per distinct date, where a missing date counts as one."""
    per_day = entries.groupBy("date").agg(
        F.sum(F.when(F.col("type") == "Income", F.col("amount"))).alias("income"),
        F.sum(F.when(F.col("type") == "Expense", F.col("amount"))).alias("expense"), F.count(F.lit(1)).alias("n"))
    t = per_day.agg(F.sum("income").alias("income"), F.sum("expense").alias("expense"),
                    F.sum("n").alias("entries"), F.count(F.lit(1)).alias("dates"))
    return t.select("income", "expense", (F.col("income") - F.col("expense")).alias("balance"), "entries",
                    (F.col("expense").cast("double") / F.greatest(F.col("dates"), F.lit(1))).alias("avg_daily_expense"))


def top_categories(entries: DataFrame, k: int = 5) -> DataFrame:
    return expense_stats(entries).orderBy(F.desc("total"), "category").limit(k)


def anomalies(entries: DataFrame, factor: float = 3.0, rules: dict[str, list[str]] = CATEGORY_KEYWORDS) -> DataFrame:
    """Expenses above ``factor`` times their category's mean; entries need no category yet.

    Means come from cells. Their limits go back to the descriptions, one row each,
    and entries meet that table by description, as a broadcast where its measured
    size allows one; no entry is sent by category.
    """
    cells = category_cells(entries, rules)
    limits = cells.select("description", "category").distinct().join(expense_stats(cells).select("category", "avg"), "category")
    limits = stage(limits.select(F.col("description").alias("_text"), "category", "avg"), "limits")
    spent = entry_type_amount(entries.drop("category")).filter(F.col("type") == "Expense")
    return spent.join(limits, F.col("description").eqNullSafe(F.col("_text"))).drop("_text").filter(F.col("amount").cast("double") > F.col("avg") * factor)


def income_expense_by_period(entries: DataFrame, fmt: str = "yyyy-MM") -> DataFrame:
    part = lambda k: F.coalesce(F.sum(F.when(F.col("type") == k, F.col("amount"))), F.lit(0))
    return drop_undated(entries).groupBy(F.date_format("date", fmt).alias("period")).agg(
        part("Income").alias("income"), part("Expense").alias("expense"))


def share_by_type(entries: DataFrame, dim: str, blank: str) -> DataFrame:
    """Totals, counts and share of a dimension within Income and within Expense."""
    name = F.coalesce(F.nullif(F.col(dim), F.lit("")), F.lit(blank)).alias("name")
    g = entries.groupBy("type", name).agg(F.sum("amount").alias("total"), rows_in(entries).alias("count"))
    whole = F.sum("total").over(Window.partitionBy("type"))
    return g.withColumn("share", F.round(F.try_divide(F.col("total").cast("double"), whole.cast("double")), 4))


def category_rollup(entries: DataFrame) -> DataFrame:
    """Totals and counts by type per category, its accounts and its primary type.

    Accounts are reduced to distinct values before they are listed.
    """
    part = lambda k, v: F.sum(F.when(F.col("type") == k, v).otherwise(0))
    each = F.col("n") if "n" in entries.columns else F.lit(1)
    cells = entries.groupBy("category", "account").agg(
        F.sum("amount").alias("total"), part("Income", F.col("amount")).alias("income"),
        part("Expense", F.col("amount")).alias("expense"), part("Income", each).alias("n_income"),
        part("Expense", each).alias("n_expense"))
    r = cells.groupBy("category").agg(
        F.sum("total").alias("total"), F.sum("income").alias("income"), F.sum("expense").alias("expense"),
        F.sum("n_income").alias("income_count"), F.sum("n_expense").alias("expense_count"),
        F.array_sort(F.collect_set(F.nullif("account", F.lit("")))).alias("accounts"))
    return r.withColumn("types", F.array_join(F.array_compact(F.array(
        F.when(F.col("expense_count") > 0, F.lit("Expense")), F.when(F.col("income_count") > 0, F.lit("Income")))), ", ")
    ).withColumn("primary_type", F.when(F.col("income") >= F.col("expense"), "Income").otherwise("Expense"))


def type_first_sort(rollup: DataFrame, field: str = "total", ascending: bool = False) -> DataFrame:
    """Expense categories before income ones, then by a chosen field; adds ``rank`` over the few categories."""
    key = F.col(field).asc() if ascending else F.col(field).desc()
    return rollup.withColumn("rank", F.row_number().over(Window.orderBy("primary_type", key, "category")))


def summary_cards(summary: DataFrame) -> DataFrame:
    """Grand total, count, number of categories and the top category (above zero)."""
    best = F.max_by(F.when(F.col("total") > 0, F.col("category")), F.when(F.col("total") > 0, F.col("total")))
    return summary.agg(F.sum("total").alias("total"), F.sum("count").alias("count"),
                       F.count(F.lit(1)).alias("categories"), best.alias("top_category"))


def dashboard(entries: DataFrame, rules: dict[str, list[str]] = CATEGORY_KEYWORDS) -> DataFrame:
    """(card, name, income, expense, count) of all cards from one scan: categories, accounts, months, weekdays and the balance.

    One aggregate with two grouping sets adds entries up by description, account
    and type, and by date and type; every card is made from its staged result.
    """
    typed = entry_type_amount(entries).withColumn("_when", F.coalesce(F.col("date").cast("string"), F.lit("none")))
    sums = typed.groupingSets([["description", "account", "type"], ["_when", "type"]], "description", "account", "_when", "type").agg(
        F.grouping("_when").cast("int").alias("by_text"), F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("n"))
    sums = stage(sums, "dashboard")
    by_text = classify(sums.filter("by_text = 1"), rules)
    by_day = sums.filter("by_text = 0 AND _when <> 'none'").withColumn("d", F.col("_when").cast("date"))
    zero = F.lit(0).cast("decimal(28,2)")

    def card(rows: DataFrame, kind: str, name: Column) -> DataFrame:
        part = lambda t: F.sum(F.when(F.col("type") == t, F.col("amount")).otherwise(zero))
        return rows.groupBy(name.alias("name")).agg(part("Income").alias("income"), part("Expense").alias("expense"), F.sum("n").alias("count")).select(
            F.lit(kind).alias("card"), "name", "income", "expense", "count")

    account = F.coalesce(F.nullif("account", F.lit("")), F.lit("Other"))
    cards = [card(by_text, "category", F.col("category")), card(by_text, "account", account), card(by_day, "month", F.date_format("d", "yyyy-MM")),
             card(by_day, "weekday", F.dayofweek("d").cast("string")), card(by_text, "all", F.lit("balance"))]
    out = cards[0]
    for c in cards[1:]:
        out = out.unionByName(c)
    return out


def distinct_by_category(entries: DataFrame, rules: dict[str, list[str]] = CATEGORY_KEYWORDS) -> DataFrame:
    """Distinct non-empty descriptions with their category and the category's size."""
    d = entries.select("description").filter(F.col("description") != "").distinct()
    d = d.withColumn("category", keyword_category(F.col("description"), rules))
    sizes = d.groupBy("category").agg(F.count(F.lit(1)).alias("n_in_category"))
    return d.join(sizes, "category")


def running_total(entries: DataFrame, by: list[str], id_bucket: int = 65536) -> DataFrame:
    """Cumulative payment in (date, entry id) order, one row per dated entry.

    Two passes: totals per date and id bucket give each bucket its opening
    balance, then a local window adds up inside the bucket. A window partition
    therefore holds at most ``id_bucket`` ids however large the account is.
    """
    e = drop_undated(entries).withColumn("_b", F.floor(F.col("entry_id") / id_bucket))
    keys = [*by, "date", "_b"]
    totals = e.groupBy(*keys).agg(F.sum("payment").alias("_s"))
    day = totals.groupBy(*by, "date").agg(F.sum("_s").alias("_d"))
    before = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    opening_day = day.withColumn("_open_d", F.coalesce(F.sum("_d").over(before), F.lit(0))).drop("_d")
    in_day = Window.partitionBy(*by, "date").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    opening = totals.withColumn("_open_b", F.coalesce(F.sum("_s").over(in_day), F.lit(0))).drop("_s").join(
        opening_day, [*by, "date"])
    local = Window.partitionBy(*keys).orderBy("entry_id", "payment").rowsBetween(Window.unboundedPreceding, 0)
    return e.join(opening, keys).withColumn(
        "cumulative", F.col("_open_d") + F.col("_open_b") + F.sum("payment").over(local)
    ).drop("_b", "_open_d", "_open_b")


def daily_running_total(entries: DataFrame) -> DataFrame:
    """(date, payment, cumulative) per day over the whole ledger; one row per calendar day enters the window."""
    days = drop_undated(entries).groupBy("date").agg(F.sum("payment").alias("payment"))
    return days.withColumn("cumulative", F.sum("payment").over(
        Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))


def trend_stats(entries: DataFrame) -> DataFrame:
    """Dated rows, mean and largest payment, closing total."""
    return drop_undated(entries).agg(
        F.count(F.lit(1)).alias("rows"), (F.sum("payment").cast("double") / F.count(F.lit(1))).alias("mean"),
        F.max("payment").alias("highest"), F.sum("payment").alias("total"))


def last_n_periods(entries: DataFrame, n: int = 30) -> DataFrame:
    """Payments of the last n days that have any."""
    days = drop_undated(entries).groupBy("date").agg(F.sum("payment").alias("payment"))
    return days.orderBy(F.desc("date")).limit(n).orderBy("date")


def date_extent(entries: DataFrame) -> DataFrame:
    return entries.agg(F.min("date").alias("first"), F.max("date").alias("last"))
