"""Readers for price, factor, industry, chart, macro, filing and word-list files."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.sources import parsers as P

FACT = ("struct<val:decimal(38,10),start:string,end:string,fy:int,fp:string,form:string,filed:string,accn:string,frame:string>")


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")


# --- prices and series -----------------------------------------------------

def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, body) of each text file, named by its stem."""
    return spark.read.text(path, wholetext=True).select(_stem(F.col("_metadata.file_path")).alias("name"), F.col("value").alias("body"))


def read_prices_csv(spark: SparkSession, path: str) -> DataFrame:
    """(name, d, close) from daily price files; ``price_file_status`` names those without any."""
    return P.parse_prices(whole_files(spark, path))


def price_file_status(spark: SparkSession, path: str, min_closes: int = 2) -> DataFrame:
    """One row per file: usable, or why not."""
    return P.price_status(whole_files(spark, path), min_closes).withColumnRenamed("n_values", "n_closes")


def unzipped_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, body) of the first CSV in each archive; plain files are taken as they are, an archive without one is empty."""

    def unzip(batches):
        for pdf in batches:
            bodies = []
            for content in pdf["content"]:
                if zipfile.is_zipfile(io.BytesIO(content)):
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        first = next((n for n in z.namelist() if n.lower().endswith(".csv")), None)
                        content = z.read(first) if first else b""
                bodies.append(content.decode("utf-8", errors="replace"))
            yield pd.DataFrame({"name": pdf["name"], "body": bodies})

    files = spark.read.format("binaryFile").load(path).select(_stem(F.col("path")).alias("name"), "content")
    return files.mapInPandas(unzip, "name string, body string")


def read_factor_file(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, d, value): the daily block of a research-factor file."""
    return P.parse_factors(unzipped_files(spark, path)).toDF("file", "name", "d", "value")


def read_industry_file(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, d, value): the first block of an industry file."""
    return P.parse_industries(unzipped_files(spark, path)).toDF("file", "name", "d", "value")


def read_market_chart_json(spark: SparkSession, path: str) -> DataFrame:
    """(name, d, value) from chart documents."""
    return P.parse_charts(whole_files(spark, path))


def read_macro_csv(spark: SparkSession, path: str) -> DataFrame:
    """(name, d, value) from macro series."""
    return P.parse_macro(whole_files(spark, path))


def read_series_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Named columns of a CSV as doubles."""
    return spark.read.option("header", True).csv(path).select(*[F.col(c).try_cast("double").alias(c) for c in columns])


# --- filings ---------------------------------------------------------------

def parse_concepts(documents: DataFrame) -> DataFrame:
    """Facts of concept documents (ticker, tag, doc_id, text): USD if there, else the first unit by name."""
    units = F.from_json("text", f"units map<string,array<{FACT}>>")["units"]
    d = documents.select("ticker", "tag", "doc_id", units.alias("u"))
    unit = F.when(F.map_contains_key("u", F.lit("USD")), F.lit("USD")).otherwise(F.array_min(F.map_keys("u")))
    return d.withColumn("unit", unit).select("ticker", "tag", "unit", F.inline(F.try_element_at("u", F.col("unit")))).select(
        "ticker", "tag", "unit", F.col("val"), "start", "end", "fy", "fp", "form", "filed", "accn")


def read_concepts(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, tag, doc_id, text) of concept files laid out as <ticker>/<tag>.json, text kept whole."""
    raw = spark.read.text(path, wholetext=True)
    f = F.col("_metadata.file_path")
    return raw.select(F.upper(F.regexp_extract(f, r"([^/]+)/[^/]+$", 1)).alias("ticker"), _stem(f).alias("tag"), F.col("value").alias("text")).withColumn(
        "doc_id", F.concat_ws(":", "ticker", "tag"))


def parse_filings_index(documents: DataFrame, form: str = "10-K", limit: int = 2) -> DataFrame:
    """First ``limit`` filings of exactly this form per (ticker, text) index, with their url and target file.

    An index lists its filings as parallel arrays; each is zipped and cut where it stands.
    """
    recent = F.from_json("text", "cik string, filings struct<recent:struct<form:array<string>,filingDate:array<string>,"
                                 "accessionNumber:array<string>,primaryDocument:array<string>>>")
    d = documents.select(F.upper("ticker").alias("ticker"), recent.alias("j")).select(
        "ticker", F.lpad(F.col("j.cik"), 10, "0").alias("cik"), F.col("j.filings.recent").alias("r"))
    zipped = F.arrays_zip("r.form", "r.filingDate", "r.accessionNumber", "r.primaryDocument")
    wanted = F.filter(zipped, lambda x: (x["form"] == form) & (F.coalesce(x["primaryDocument"], F.lit("")) != ""))
    e = d.select("ticker", "cik", F.posexplode(F.slice(wanted, 1, limit)).alias("rank", "x"))
    acc = F.col("x.accessionNumber")
    return e.select(
        "ticker", "cik", "rank", F.col("x.form").alias("form"), F.col("x.filingDate").alias("filed"), acc.alias("accession"),
        F.col("x.primaryDocument").alias("primary_doc"),
        F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), F.regexp_replace("cik", "^0+", ""), F.lit("/"),
                 F.regexp_replace(acc, "-", ""), F.lit("/"), F.col("x.primaryDocument")).alias("url"),
        F.concat(F.lower("ticker"), F.lit("/"), F.regexp_replace("x.form", "/", "-"), F.lit("-"), F.col("x.filingDate"), F.lit(".htm")).alias("dest"))


def filings_shortfall(documents: DataFrame, filings: DataFrame, limit: int = 2) -> DataFrame:
    """Companies with fewer filings than asked for."""
    n = filings.groupBy("ticker").agg(F.count(F.lit(1)).alias("found"))
    return documents.select(F.upper("ticker").alias("ticker")).join(n, "ticker", "left").select(
        "ticker", F.coalesce("found", F.lit(0)).alias("found"), F.lit(limit).alias("needed")).filter(F.col("found") < limit)


def read_ticker_map(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, cik) from a JSON object keyed by row number; cik padded to ten digits."""
    raw = spark.read.text(path, wholetext=True)
    rows = F.map_values(F.from_json("value", "map<string,struct<cik_str:bigint,ticker:string>>"))
    return raw.select(F.inline(rows)).select(F.upper("ticker").alias("ticker"), F.lpad(F.col("cik_str").cast("string"), 10, "0").alias("cik"))


# --- other inputs ----------------------------------------------------------

def read_preference_pairs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(complete pairs, rejected records) from a JSON array of prompt, chosen, rejected."""
    from evidentia.operators.preference import require_fields

    raw = spark.read.option("multiLine", True).schema("prompt string, chosen string, rejected string").json(path)
    return require_fields(raw)


def read_ledger_pages(pages: DataFrame) -> DataFrame:
    """Flat entries from nested ledger pages, newest first."""
    p = "properties."
    return pages.select(
        F.col("id").alias("entry_id"), F.to_date(p + "Date.date.start").alias("date"),
        F.coalesce(F.get(F.col(p + "Description.title"), F.lit(0))["plain_text"], F.lit("")).alias("description"),
        F.coalesce(p + "Payment.number", F.lit(0.0)).cast("decimal(18,2)").alias("payment"),
        F.coalesce(p + "Deposit.number", F.lit(0.0)).cast("decimal(18,2)").alias("deposit"),
        F.coalesce(p + "Account.select.name", F.lit("")).alias("account")).orderBy(F.desc("date"))


def read_wordlist(spark: SparkSession, path: str) -> DataFrame:
    """(word) one per line, trimmed, blanks dropped."""
    return spark.read.text(path).select(F.trim("value").alias("word")).filter("word <> ''")


def read_keyword_map(spark: SparkSession, path: str) -> DataFrame:
    """(keyword, reply) from ``{"keyword": {...}}``."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "keyword map<string,string>")["keyword"]).alias("keyword", "reply"))


def scan_raw(spark: SparkSession, root: str) -> DataFrame:
    """(dest, sha256, bytes) of every file below a folder."""
    base = root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(F.regexp_replace("path", "^.*" + base.replace(".", r"\."), "").alias("dest"),
                        F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))
