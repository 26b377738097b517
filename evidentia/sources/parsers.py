"""Parsing of price, factor, industry, chart and macro files from rows of (name, body), apart from how the files are opened.

A file is one row and its lines are an array of that row, so parsing needs no
shuffle. Each kind has a status function with one row per file: usable, or why not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names and marks by which the files are told apart, and the value from which an observation is missing.
NO_DATA, PAGE_MARK, FACTOR_HEADER, SECOND_FACTOR, FIRST_INDUSTRY, MISSING = "no data", "<html", "Mkt-RF", "SMB", "nodur", -99.0


def _lines(body: Column) -> Column:
    return F.split(body, "\r\n|\n|\r")


def _cells(line: Column) -> Column:
    return F.transform(F.split(line, ","), lambda c: F.trim(c))


def _after(lines: Column, n: Column | int) -> Column:
    """The lines behind the first n."""
    start = F.lit(n) if isinstance(n, int) else n
    return F.slice(lines, start + 1, F.greatest(F.size(lines) - start, F.lit(0)))


def _status(files: DataFrame, counts: DataFrame, reasons: list[tuple[Column, str]]) -> DataFrame:
    """name, n_values, first, last, sha256, status: the first reason that holds, else ok."""
    joined = files.select("name", "body").join(counts, "name", "left").withColumn("n_values", F.coalesce("n_values", F.lit(0)))
    status = F.lit("ok")
    for holds, reason in reversed(reasons):
        status = F.when(holds, f"unusable: {reason}").otherwise(status)
    return joined.select("name", "n_values", "first", "last", F.substring(F.sha2("body", 256), 1, 16).alias("sha256"), status.alias("status"))


def _count(rows: DataFrame, d: str = "d") -> DataFrame:
    return rows.groupBy("name").agg(F.count_distinct(d).alias("n_values"), F.min(d).alias("first"), F.max(d).alias("last"))


# --- prices ----------------------------------------------------------------

def parse_prices(files: DataFrame) -> DataFrame:
    """(name, d, close): columns by the header's names; rows without a date or a close are dropped."""
    head = _cells(F.get(F.col("lines"), F.lit(0)))
    found = files.select("name", _lines(F.trim("body")).alias("lines")).select(
        "name", F.array_position(head, "Date").alias("d_at"), F.array_position(head, "Close").alias("c_at"), _after(F.col("lines"), 1).alias("rest"))
    rows = found.filter("d_at > 0 AND c_at > 0").select("name", "d_at", "c_at", F.explode("rest").alias("line"))  # the header is read once per file
    cell = lambda at: F.get(_cells(F.col("line")), (F.col(at) - 1).cast("int"))
    return rows.select(
        "name", cell("d_at").try_cast("date").alias("d"), cell("c_at").try_cast("double").alias("close")).filter("d IS NOT NULL AND close IS NOT NULL")


def price_status(files: DataFrame, min_closes: int = 2) -> DataFrame:
    body = F.lower(F.trim("body"))
    blocked = (body == "") | F.startswith(body, F.lit(NO_DATA)) | F.contains(F.substring(body, 1, 200), F.lit(PAGE_MARK))
    no_close = F.array_position(_cells(F.get(_lines(F.trim("body")), F.lit(0))), "Close") == 0
    return _status(files, _count(parse_prices(files)), [
        (blocked, "no data for this symbol"), (no_close, "no column of closes"), (F.col("n_values") < min_closes, "fewer than two usable closes")])


# --- research factors and industries ---------------------------------------

def _daily_block(files: DataFrame, is_header) -> DataFrame:
    """(name, header, cells): rows of days from the first header to the first line that is none; no row without a header."""
    found = files.select("name", _lines(F.col("body")).alias("lines")).withColumn("at", F.array_position(F.transform("lines", is_header), True).cast("int"))
    found = found.filter("at > 0").select("name", _cells(F.get(F.col("lines"), F.col("at") - 1)).alias("header"), _after(F.col("lines"), F.col("at")).alias("rest"))
    day = lambda line: F.rlike(F.get(_cells(line), F.lit(0)), F.lit("^[0-9]{8}$"))
    found = found.withColumn("stop", F.array_position(F.transform("rest", day), False).cast("int"))
    block = F.when(F.col("stop") > 0, F.slice("rest", F.lit(1), F.col("stop") - 1)).otherwise(F.col("rest"))
    return found.select("name", "header", F.explode(block).alias("line")).select("name", "header", _cells(F.col("line")).alias("cells"))


def _stacked(block: DataFrame) -> DataFrame:
    """(name, series, d, value): percent turned to fractions; the header names the cells after the date."""
    names = F.when(F.get("header", F.lit(0)) == "", _after(F.col("header"), 1)).otherwise(F.col("header"))
    pairs = F.arrays_zip(names.alias("series"), _after(F.col("cells"), 1).alias("v"))
    rows = block.select("name", F.to_date(F.get("cells", F.lit(0)), "yyyyMMdd").alias("d"), F.explode(pairs).alias("x"))
    value = F.col("x.v").try_cast("double") / 100
    return rows.select("name", F.col("x.series").alias("series"), "d", value.alias("value")).filter(
        F.col("value").isNotNull() & (F.coalesce("series", F.lit("")) != ""))


def _factor_header(line: Column) -> Column:
    return F.startswith(F.lower(F.trim(line)), F.lit(FACTOR_HEADER.lower())) | (F.contains(line, F.lit(FACTOR_HEADER)) & F.contains(line, F.lit(SECOND_FACTOR)))


def _industry_header(line: Column) -> Column:
    cells = _cells(line)
    return F.coalesce((F.get(cells, F.lit(0)) == "") & F.startswith(F.lower(F.get(cells, F.lit(1))), F.lit(FIRST_INDUSTRY)), F.lit(False))


def parse_factors(files: DataFrame) -> DataFrame:
    """(name, series, d, value) of the daily block, whether or not the header has an empty cell over the dates."""
    return _stacked(_daily_block(files, _factor_header))


def parse_industries(files: DataFrame) -> DataFrame:
    """As the factors, first block only; a day with a missing observation of any industry is dropped."""
    gone = F.exists(_after(F.col("cells"), 1), lambda v: F.coalesce(v.try_cast("double") <= MISSING, F.lit(False)))
    return _stacked(_daily_block(files, _industry_header).filter(~gone))


def block_status(files: DataFrame, kind: str) -> DataFrame:
    """Of files of research factors (``kind`` factor) or of industries (industry)."""
    parse, header = {"factor": (parse_factors, _factor_header), "industry": (parse_industries, _industry_header)}[kind]
    headless = ~F.exists(_lines(F.col("body")), header)
    return _status(files, _count(parse(files)), [(headless, f"no {kind} header"), (F.col("n_values") == 0, "no daily rows")])


# --- charts and macro series -----------------------------------------------

def parse_charts(files: DataFrame) -> DataFrame:
    """(name, d, value) from ``prices: [[ms, price], ...]``."""
    prices = F.from_json("body", "prices array<array<double>>")["prices"]
    return files.select("name", F.explode(prices).alias("x")).select(
        "name", F.to_date(F.timestamp_millis(F.get("x", F.lit(0)).cast("bigint"))).alias("d"), F.get("x", F.lit(1)).alias("value"))


def chart_status(files: DataFrame) -> DataFrame:
    keyless = F.from_json("body", "prices array<array<double>>")["prices"].isNull()
    return _status(files, parse_charts(files).groupBy("name").agg(F.count("*").alias("n_values"), F.min("d").alias("first"), F.max("d").alias("last")), [
        (keyless, "no prices in the document"), (F.col("n_values") < 2, "fewer than two prices")])


def parse_macro(files: DataFrame) -> DataFrame:
    """(name, d, value) from two columns under a header; a dot or an empty cell is a missing day."""
    rows = files.select("name", F.explode(_after(_lines(F.col("body")), 1)).alias("line")).select("name", _cells(F.col("line")).alias("c"))
    v = F.coalesce(F.get("c", F.lit(1)), F.lit(""))
    return rows.filter(~v.isin(".", "")).select("name", F.get("c", F.lit(0)).try_cast("date").alias("d"), v.try_cast("double").alias("value")).filter(
        "d IS NOT NULL AND value IS NOT NULL")


def macro_status(files: DataFrame) -> DataFrame:
    return _status(files, _count(parse_macro(files)), [(F.trim("body") == "", "empty file"), (F.col("n_values") == 0, "no usable observations")])
