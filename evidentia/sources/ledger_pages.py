"""A ledger kept as pages, read as a table: one task per page, date limits applied to the list of pages and inside them.

A folder holds ``pages`` (JSON lines, gzipped by ``write_ledger``, one nested entry each, newest first over all
pages) and ``index`` (file, first and last date, number of entries of each page).
"""

from __future__ import annotations

import datetime
import gzip
import json
from collections.abc import Iterator
from decimal import Decimal
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull,
                                    LessThan, LessThanOrEqual)

from evidentia.session import stage

NAME = "ledger_pages"
SCHEMA = "entry_id string, date date, description string, payment decimal(18,2), deposit decimal(18,2), account string"
TYPES = pa.schema([("entry_id", pa.string()), ("date", pa.date32()), ("description", pa.string()), ("payment", pa.decimal128(18, 2)),
                   ("deposit", pa.decimal128(18, 2)), ("account", pa.string())])
#: Entries of a page, and of an Arrow batch.
PAGE, BATCH = 5000, 4096
DAY = datetime.timedelta(days=1)


def opened(path: str):
    """A file of any store that Arrow knows, for reading."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return open(path, "rb")
    if path.startswith("file:"):
        return open("/" + path.removeprefix("file:").lstrip("/"), "rb")
    store, inside = fs.FileSystem.from_uri(path)
    return store.open_input_stream(inside)


def flat(entry: dict) -> tuple:
    """A nested entry as a row: the first title's text or none, absent numbers as zero, an absent account as an empty name."""
    p = entry.get("properties") or {}
    get = lambda *keys: reduce(lambda x, k: (x or {}).get(k), keys, p)
    start, title = get("Date", "date", "start"), get("Description", "title") or []
    money = lambda k: Decimal(str(get(k, "number") or 0)).quantize(Decimal("0.01"))
    return (entry.get("id"), datetime.date.fromisoformat(start[:10]) if start else None, (title[0].get("plain_text") if title else None) or "",
            money("Payment"), money("Deposit"), get("Account", "select", "name") or "")


class Page(InputPartition):
    def __init__(self, file: str):
        super().__init__(file)
        self.file = file


class PageReader(DataSourceReader):
    """Takes limits on the date: pages that lie outside are not opened, entries outside are not handed over."""

    def __init__(self, path: str, index: list[str]):
        self.path, self.index = path, index
        self.low, self.high, self.dated = datetime.date.min, datetime.date.max, False

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) != ("date",):
                yield f
                continue
            value = getattr(f, "value", None)
            if isinstance(f, IsNotNull):
                pass
            elif isinstance(f, (GreaterThanOrEqual, GreaterThan, EqualTo)) and isinstance(value, datetime.date):
                self.low = max(self.low, value + DAY if isinstance(f, GreaterThan) else value)
                self.high = min(self.high, value) if isinstance(f, EqualTo) else self.high
            elif isinstance(f, (LessThanOrEqual, LessThan)) and isinstance(value, datetime.date):
                self.high = min(self.high, value - DAY if isinstance(f, LessThan) else value)
            else:
                yield f
                continue
            self.dated = True

    def partitions(self) -> list[Page]:
        """One page each; the index has a line per page, as a file listing has."""
        out = []
        for line in self.index:
            page = json.loads(line)
            first, last = (datetime.date.fromisoformat(page[k]) if page.get(k) else None for k in ("first", "last"))
            outside = first is None or last < self.low or first > self.high
            if not (self.dated and outside):
                out.append(Page(page["file"]))
        return out

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        rows = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES.types)], schema=TYPES)

        with opened(partition.file) as lines:
            body = lines.read()
            for line in (gzip.decompress(body) if partition.file.endswith(".gz") else body).splitlines():
                row = flat(json.loads(line))
                if not self.dated or row[1] is not None and self.low <= row[1] <= self.high:
                    rows.append(row)
                if len(rows) == BATCH:
                    yield batch()
                    rows = []
        if rows:
            yield batch()


class LedgerPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(self.options["path"], json.loads(self.options["index"]))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Entries (entry_id, date, description, payment, deposit, account) of a paged ledger; filters on the date reach the pages."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LedgerPages)
    index = [r["value"] for r in spark.read.text(f"{path}/index").collect()]
    return spark.read.format(NAME).option("path", path).option("index", json.dumps(index)).load()


def write_ledger(entries: DataFrame, path: str, page: int = PAGE) -> None:
    """Entries (entry_id, date, description, payment, deposit, account) as pages of about ``page``, newest first, and their index."""
    text = lambda c: F.when(F.col(c) != "", F.col(c))
    nested = F.struct(
        F.col("entry_id").cast("string").alias("id"), F.struct(
            F.struct(F.when(F.col("date").isNotNull(), F.struct(F.col("date").cast("string").alias("start"))).alias("date")).alias("Date"),
            F.struct(F.when(text("description").isNotNull(), F.array(F.struct(F.col("description").alias("plain_text")))).otherwise(
                F.array().cast("array<struct<plain_text:string>>")).alias("title")).alias("Description"),
            F.struct(F.col("payment").cast("string").alias("number")).alias("Payment"), F.struct(F.col("deposit").cast("string").alias("number")).alias("Deposit"),
            F.struct(F.when(text("account").isNotNull(), F.struct(F.col("account").alias("name"))).alias("select")).alias("Account")).alias("properties"))
    # Plain columns are staged and shuffled; an entry gets its nested form in the page, whose names repeat and so pack well.
    plain = stage(entries.select("entry_id", "date", "description", "payment", "deposit", "account"), "entries")
    pages = max(1, -(-plain.count() // page))
    order = [F.desc_nulls_last("date"), F.xxhash64(F.col("entry_id").cast("string"))]
    plain.repartitionByRange(pages, *order).sortWithinPartitions(*order).select(F.to_json(nested).alias("value")).write.option(
        "compression", "gzip").text(f"{path}/pages")
    spark = entries.sparkSession
    dates = spark.read.text(f"{path}/pages").select(
        F.input_file_name().alias("file"), F.get_json_object("value", "$.properties.Date.date.start").alias("day"))
    dates.groupBy("file").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count(F.lit(1)).alias("n")).select(
        F.to_json(F.struct("file", "first", "last", "n")).alias("value")).coalesce(1).write.text(f"{path}/index")
