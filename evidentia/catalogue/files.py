"""File parsers over bodies written from the given tables; their SQL states what went into the bodies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.session import stage
from evidentia.sources import parsers as P
from evidentia.sources import tables as V


NAMES = ["AIR", "FOB", "MAIL", "RAIL", "REG", "SHIP", "TRUCK"]


def _daily(spark, sf_dir) -> DataFrame:
    """(name, d, n, total): lines shipped per supplier and day; a file is a supplier's year, so files grow with the table."""
    li = V.table(spark, sf_dir, "lineitem")
    kind = F.get(F.array(*map(F.lit, NAMES)), F.pmod("l_suppkey", F.lit(len(NAMES))).cast("int"))
    name = F.format_string("%s-%d-%d", kind, "l_suppkey", F.year("l_shipdate"))
    return li.groupBy(name.alias("name"), F.col("l_shipdate").cast("date").alias("d")).agg(
        F.count("*").alias("n"), F.sum("l_linenumber").alias("total"))


def _days(spark, sf_dir) -> DataFrame:
    """The daily rows, staged by name: files of several kinds are written from one scan, a file with no further shuffle."""
    return stage(_daily(spark, sf_dir), "daily", "name")


def _bodies(rows: DataFrame, line, head, tail="") -> DataFrame:
    """One body per name: a head, the lines by date, a tail. A file holds a year at most."""
    lines = F.sort_array(F.collect_list(F.struct("d", line.alias("line"))))
    held = rows.groupBy("name").agg(lines.alias("x"))
    return held.select("name", F.concat(head, F.array_join(F.transform("x", lambda r: r["line"]), "\n"), F.lit(tail)).alias("body"))


def _price_files(daily):
    """Closes missing on some days; columns in another order for some names, no closes for one, an error page for another."""
    other = F.col("name") < "M"
    n, total = F.col("n").cast("string"), F.col("total").cast("string")
    close = F.when(F.dayofmonth("d") == 13, "").when(F.dayofmonth("d") == 14, "N/A").otherwise(total)
    line = F.when(other, F.concat_ws(",", F.col("d").cast("string"), close, n)).otherwise(F.concat_ws(",", F.col("d").cast("string"), n, n, n, close, n))
    head = F.when(F.startswith("name", F.lit("RAIL")), "Date,Open\n").when(other, "Date,Close,Open\n").otherwise("Date,Open,High,Low,Close,Volume\n")
    files = _bodies(daily, line, head, "\n")
    return files.withColumn("body", F.when(F.startswith("name", F.lit("SHIP")), "<html>none</html>").otherwise(F.col("body")))


def _block_files(daily, first, second, missing):
    """Two columns in percent, an annual block behind; one name with a header there only. Some days hold the mark of a missing value."""
    text = F.when((F.dayofmonth("d") == 13) & F.lit(missing), "-99.99").otherwise(F.col("n").cast("string"))
    line = F.concat_ws(",", F.date_format("d", "yyyyMMdd"), text, F.col("total").cast("string"))
    bare = F.startswith("name", F.lit("AIR")) & F.lit(first == "Mkt-RF")
    head = F.when(F.startswith("name", F.lit("RAIL")), "notes\n\n").when(bare, f"notes\n\n{first},{second}\n").otherwise(f"notes\n\n,{first},{second}\n")
    return _bodies(daily, line, head, f"\n\n Annual\n,{first},{second}\n1995,5,5\n")


def _charts(daily):
    line = F.concat(F.lit("["), (F.unix_date("d").cast("bigint") * 86_400_000).cast("string"), F.lit(", "), F.col("total").cast("string"), F.lit("]"))
    files = _bodies(daily, F.concat(line, F.lit(",")), F.lit('{"prices": ['))
    key = F.when(F.startswith("name", F.lit("RAIL")), "values").otherwise("prices")
    return files.withColumn("body", F.concat(F.replace(F.regexp_replace("body", ",$", ""), F.lit("prices"), key), F.lit("]}")))


def _macro(daily):
    value = F.when(F.dayofmonth("d") == 13, ".").when(F.dayofmonth("d") == 14, "").when(F.startswith("name", F.lit("RAIL")), ".").otherwise(F.col("total").cast("string"))
    return _bodies(daily, F.concat_ws(",", F.col("d").cast("string"), value), F.lit("DATE,VALUE\n"), "\n")


def prices(spark, sf_dir):
    return P.parse_prices(_price_files(_daily(spark, sf_dir)))


def factors(spark, sf_dir):
    out = P.parse_factors(_block_files(_daily(spark, sf_dir), "Mkt-RF", "SMB", False))
    return out.select("name", "series", "d", F.round("value", 6).alias("value"))


def industries(spark, sf_dir):
    out = P.parse_industries(_block_files(_daily(spark, sf_dir), "NoDur", "Durbl", True))
    return out.select("name", "series", "d", F.round("value", 6).alias("value"))


def charts(spark, sf_dir):
    return P.parse_charts(_charts(_daily(spark, sf_dir)))


def macro(spark, sf_dir):
    return P.parse_macro(_macro(_daily(spark, sf_dir)))


def statuses(spark, sf_dir):
    """Every file of every kind: usable, or why not."""
    daily = _days(spark, sf_dir)
    found = {"price": P.price_status(_price_files(daily)), "factor": P.block_status(_block_files(daily, "Mkt-RF", "SMB", False), "factor"),
             "industry": P.block_status(_block_files(daily, "NoDur", "Durbl", True), "industry"), "chart": P.chart_status(_charts(daily)),
             "macro": P.macro_status(_macro(daily))}
    return reduce(DataFrame.unionByName, (df.select(F.lit(k).alias("kind"), "name", "n_values", "first", "last", "status") for k, df in found.items()))


QUERIES = {"files_prices": prices, "files_factors": factors, "files_industries": industries, "files_charts": charts, "files_macro": macro, "files_status": statuses}

_DAILY = f"""daily AS (SELECT {NAMES}[l_suppkey % {len(NAMES)} + 1] || '-' || l_suppkey || '-' || year(l_shipdate) AS name, CAST(l_shipdate AS DATE) AS d, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem GROUP BY 1, 2),
sound AS (SELECT * FROM daily WHERE name[1:4] NOT IN ('RAIL', 'SHIP')), headed AS (SELECT * FROM daily WHERE name[1:4] <> 'RAIL'),
whole AS (SELECT * FROM headed WHERE day(d) <> 13), filled AS (SELECT * FROM daily WHERE day(d) NOT IN (13, 14))"""
_STACK = "SELECT name, '{a}' AS series, d, round(n / 100.0, 6) AS value FROM {t} UNION ALL SELECT name, '{b}', d, round(total / 100.0, 6) FROM {t}"


def _state(kind: str, rows: str, bad: str) -> str:
    return f"""SELECT '{kind}' AS kind, name, coalesce(k, 0) AS n_values, first, last, CASE {bad} ELSE 'ok' END AS status
FROM (SELECT DISTINCT name FROM daily) LEFT JOIN (SELECT name, count(*) AS k, min(d) AS first, max(d) AS last FROM {rows} GROUP BY name) USING (name)"""


ORACLE = {
    "files_prices": f"WITH {_DAILY} SELECT name, d, CAST(total AS DOUBLE) AS close FROM sound WHERE day(d) NOT IN (13, 14)",
    "files_factors": f"WITH {_DAILY} {_STACK.format(a='Mkt-RF', b='SMB', t='headed')}",
    "files_industries": f"WITH {_DAILY} {_STACK.format(a='NoDur', b='Durbl', t='whole')}",
    "files_charts": f"WITH {_DAILY} SELECT name, d, CAST(total AS DOUBLE) AS value FROM headed",
    "files_macro": f"WITH {_DAILY} SELECT name, d, CAST(total AS DOUBLE) AS value FROM filled WHERE name[1:4] <> 'RAIL'",
    "files_status": f"WITH {_DAILY} " + " UNION ALL ".join([
        _state("price", "(SELECT * FROM filled WHERE name[1:4] NOT IN ('RAIL', 'SHIP'))",
               "WHEN name[1:4] = 'SHIP' THEN 'unusable: no data for this symbol' WHEN name[1:4] = 'RAIL' THEN 'unusable: no column of closes'"),
        _state("factor", "headed", "WHEN name[1:4] = 'RAIL' THEN 'unusable: no daily rows'"),
        _state("industry", "whole", "WHEN name[1:4] = 'RAIL' THEN 'unusable: no daily rows'"),
        _state("chart", "headed", "WHEN name[1:4] = 'RAIL' THEN 'unusable: no prices in the document'"),
        _state("macro", "(SELECT * FROM filled WHERE name[1:4] <> 'RAIL')", "WHEN name[1:4] = 'RAIL' THEN 'unusable: no usable observations'")]),
}
