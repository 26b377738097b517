"""Reading the parquet tables, and views that give them the shapes the operators take.

The views stand in for vendor files: returns, portfolios, company facts,
ledgers and messages are all derived by Spark from the star-schema tables, so
they grow with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.session import stage, task_count

# The metric names a filing may report, in order of preference.
METRICS = ["total revenue", "cost of revenue", "operating income",
           "research and development expense", "total operating expenses"]
# Order priorities stand for the reported tags, one to one with METRICS.
PRIORITY_TAGS = {"1-URGENT": "Revenues", "2-HIGH": "CostOfRevenue", "3-MEDIUM": "OperatingIncomeLoss",
                 "4-NOT SPECIFIED": "ResearchAndDevelopmentExpense", "5-LOW": "OperatingExpenses"}
AMENDED_TAGS = {"1-URGENT": "RevenueFromContractWithCustomerExcludingAssessedTax", "2-HIGH": "CostOfGoodsAndServicesSold"}
STATUS_FORMS = {"F": "10-K", "P": "10-K/A", "O": "10-Q"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapped(col: str, values: dict[str, str]) -> Column:
    """A small fixed mapping as a CASE expression."""
    out = None
    for k, v in values.items():
        out = F.when(F.col(col) == k, v) if out is None else out.when(F.col(col) == k, v)
    return out


def discount_sums(spark: SparkSession, sf_dir: str, grain: str = "day") -> DataFrame:
    return discount_sums_of(table(spark, sf_dir, "lineitem"), grain)


def discount_sums_of(lines: DataFrame, grain: str = "day") -> DataFrame:
    """(ticker, d, s, n): exact sums and counts of the discount, from which asset and market returns both follow."""
    return (
        lines
        .select(
            F.concat("l_returnflag", "l_linestatus").alias("ticker"),
            F.to_date(F.date_trunc(grain, "l_shipdate")).alias("d"),
            F.col("l_discount").cast("decimal(4,2)").alias("x"),
        )
        .groupBy("ticker", "d")
        .agg(F.sum("x").alias("s"), F.count("x").alias("n"))
    )


def returns_of(sums: DataFrame) -> DataFrame:
    """(ticker, d, r): mean discount per flag and status, less its centre of 5 %."""
    return sums.select("ticker", "d", (F.col("s").cast("double") / F.col("n") - 0.05).alias("r"))


def market_of(sums: DataFrame) -> DataFrame:
    """(d, b): the benchmark series, over all rows of a day."""
    return sums.groupBy("d").agg((F.sum("s").cast("double") / F.sum("n") - 0.05).alias("b"))


def asset_returns(spark: SparkSession, sf_dir: str, grain: str = "day") -> DataFrame:
    return returns_of(discount_sums(spark, sf_dir, grain))


def market_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market_of(discount_sums(spark, sf_dir))


def asset_prices(returns: DataFrame) -> DataFrame:
    from evidentia.operators.series import price_index

    return price_index(returns, value="r", by=["ticker"])


def supplier_positions(spark: SparkSession, sf_dir: str, by: str = "supplier") -> DataFrame:
    """(portfolio_id, ticker, weight, as_of): a supplier's (or its nation's) mix of revenue."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("ticker"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("v"))
    if by == "supplier":
        li = li.withColumn("portfolio_id", F.format_string("S%09d", "l_suppkey"))
    else:
        sup = table(spark, sf_dir, "supplier").select("s_suppkey", F.format_string("N%02d", "s_nationkey").alias("portfolio_id"))
        li = li.groupBy("l_suppkey", "ticker").agg(F.sum("v").alias("v")).join(
            sup, F.col("l_suppkey") == F.col("s_suppkey"))
    held = li.groupBy("portfolio_id", "ticker").agg(F.sum("v").alias("v"))
    held = held.repartition(task_count(held), "portfolio_id")
    total = F.sum("v").over(Window.partitionBy("portfolio_id"))
    return held.select(
        "portfolio_id", "ticker", (F.col("v").cast("double") / total.cast("double")).alias("weight"),
        F.lit("2001-11-04").alias("as_of"))


def portfolio_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Array-form requests per supplier, each in one sound and seven faulty variants."""
    held = (
        supplier_positions(spark, sf_dir)
        .groupBy("portfolio_id")
        .agg(F.sort_array(F.collect_list(F.struct("ticker", "weight"))).alias("p"))
        .select("portfolio_id", F.col("p.ticker").alias("t"), F.col("p.weight").alias("w"))
    )
    none_s, none_d = F.lit(None).cast("array<string>"), F.lit(None).cast("array<double>")
    cases = [
        ("sound", F.col("t"), F.col("w")),
        ("scaled", F.col("t"), F.transform("w", lambda x: x * 0.9)),
        ("short", F.col("t"), F.slice("w", 1, 1)),
        ("unknown", F.array(F.lit("ZZ")), F.array(F.lit(1.0))),
        ("twice", F.concat("t", "t"), F.transform(F.concat("w", "w"), lambda x: x * 0.5)),
        ("nan", F.col("t"), F.transform("w", lambda x: F.lit(float("nan")))),
        ("missing", none_s, none_d),
        ("empty", F.array().cast("array<string>"), F.array().cast("array<double>")),
    ]
    variants = F.array(*[F.struct(F.lit(k).alias("variant"), t.alias("tickers"), w.alias("weights"))
                         for k, t, w in cases])
    return (
        held.select("portfolio_id", F.explode(variants).alias("v"))
        .select(F.concat_ws(":", "portfolio_id", "v.variant").alias("portfolio_id"), "v.tickers", "v.weights")
    )


def name_universe(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """((name, d, r) per month, (name, alive)): a part is alive if it shipped in the last 180 days. The lines are read once."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("name"), F.to_date("l_shipdate").alias("ship"),
        F.col("l_discount").cast("decimal(4,2)").alias("x"))
    cells = stage(li.groupBy("name", F.trunc("ship", "month").alias("d")).agg(F.sum("x").alias("s"), F.count("x").alias("n"), F.max("ship").alias("last")), "cells")
    returns = cells.select("name", "d", (F.col("s").cast("double") / F.col("n") - 0.05).alias("r"))
    end = cells.agg(F.max("last").alias("end"))
    alive = cells.groupBy("name").agg(F.max("last").alias("last")).join(F.broadcast(end)).select("name", (F.datediff("end", "last") <= 180).alias("alive"))
    return returns, alive


def company_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported figures: one per company, tag, fiscal year and form.

    A company is a customer, a tag an order priority, a form an order status;
    amended filings use the newer tag for revenue and cost.
    Amounts are scaled up so that they still have digits in millions.
    """
    o = table(spark, sf_dir, "orders").select(
        F.format_string("C%09d", "o_custkey").alias("ticker"),
        F.coalesce(F.when(F.col("o_orderstatus") == "P", mapped("o_orderpriority", AMENDED_TAGS)),
                   mapped("o_orderpriority", PRIORITY_TAGS)).alias("tag"),
        F.year("o_orderdate").alias("fy"),
        mapped("o_orderstatus", STATUS_FORMS).alias("form"),
        F.to_date("o_orderdate").alias("filed"),
        F.format_string("%010d", "o_orderkey").alias("accn"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("v"),
    )
    return (
        o.groupBy("ticker", "tag", "fy", "form")
        .agg((F.sum("v") * 10000).cast("bigint").alias("val"), F.min("filed").alias("filed"), F.min("accn").alias("accn"))
        .select(
            "ticker", "tag", F.lit("USD").alias("unit"), "val",
            F.make_date("fy", F.lit(1), F.lit(1)).alias("start"),
            F.make_date("fy", F.lit(12), F.lit(31)).alias("end"),
            "fy", F.lit("FY").alias("fp"), "form", "filed", "accn",
        )
    )


def ledger_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entry_id, date, description, payment, deposit, account) from shipped lines.

    Returned lines are deposits, with their tax as a payment beside it; rows at
    the highest discount carry no date; closed lines name no account.
    """
    return ledger_entries_of(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part"))


def ledger_entries_of(lines: DataFrame, parts: DataFrame) -> DataFrame:
    """The same from given rows; the lines may be a stream."""
    li = lines.select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate",
        F.col("l_extendedprice").cast("decimal(18,2)").alias("price"),
        F.col("l_tax").cast("decimal(4,2)").alias("tax"),
        F.col("l_discount").cast("decimal(4,2)").alias("disc"))
    part = parts.select("p_partkey", "p_name", "p_type", "p_brand")
    back = F.col("l_returnflag") == "R"
    zero = F.lit(0).cast("decimal(18,2)")
    return li.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("entry_id"),
        F.when(F.col("disc") < F.lit("0.10").cast("decimal(4,2)"), F.to_date("l_shipdate")).alias("date"),
        F.concat_ws(" ", "p_type", "p_name").alias("description"),
        F.when(back, (F.col("price") * F.col("tax")).cast("decimal(18,2)")).otherwise(F.col("price")).alias("payment"),
        F.when(back, F.col("price")).otherwise(zero).alias("deposit"),
        F.when(F.col("l_linestatus") == "O", F.col("p_brand")).otherwise(F.lit("")).alias("account"),
    )


def concept_documents(facts: DataFrame) -> DataFrame:
    """(ticker, tag, doc_id, text): the JSON a filing service would answer with, per company and tag.

    A document lists at most one fact per fiscal year and form.
    """
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    fact = F.concat(
        F.lit('{"start":"'), day("start"), F.lit('","end":"'), day("end"), F.lit('","val":'), F.col("val").cast("string"),
        F.lit(',"accn":"'), F.col("accn"), F.lit('","fy":'), F.col("fy").cast("string"), F.lit(',"fp":"FY","form":"'),
        F.col("form"), F.lit('","filed":"'), day("filed"), F.lit('"}'))
    listed = facts.groupBy("ticker", "tag").agg(F.sort_array(F.collect_list(F.struct("fy", "form", fact.alias("j")))).alias("fs"))
    return listed.select("ticker", "tag", F.concat_ws(":", "ticker", "tag").alias("doc_id"), F.concat(
        F.lit('{"tag":"'), F.col("tag"), F.lit('","units":{"USD":['), F.array_join(F.col("fs.j"), ","), F.lit("]}}")).alias("text"))


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages_of(table(spark, sf_dir, "conversations"))


def messages_of(c: DataFrame) -> DataFrame:
    """(msg_id, conv_id, turn, role, create_time, content, ids, group fields) from conversations.

    Odd conversations are group rooms; every fifth turn calls the bot by name,
    every seventh quotes an earlier message.
    """
    content = (
        F.when(F.col("turn") % 5 == 0, F.concat(F.lit("bot "), "text"))
        .when(F.col("turn") % 5 == 3, F.concat(F.lit("@helper "), "text"))
        .when(F.col("turn") % 7 == 6, F.concat(F.lit("「"), "text", F.lit("」\n- - - - - - -\nok"))).otherwise(F.col("text")))
    return c.select(
        F.format_string("%d-%d", "conv_id", "turn").alias("msg_id"), "conv_id", "turn", "role",
        F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 613 + F.col("turn") * 37).alias("create_time"),
        content.alias("content"), F.when(F.col("role") == "assistant", "BOT").otherwise(F.format_string("U%03d", F.col("conv_id") % 50)).alias("from_user_id"),
        F.format_string("P%03d", F.col("conv_id") % 50).alias("other_user_id"), F.format_string("U%03d", F.col("conv_id") % 50).alias("actual_user_id"),
        (F.col("conv_id") % 2 == 1).alias("is_group"), F.format_string("room %d", F.col("conv_id") % 7).alias("group_name"),
        F.format_string("G%d", F.col("conv_id") % 7).alias("group_id"), (F.col("turn") % 3 == 0).alias("is_at"))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(paper_id, topic, title, authors, summary, link): bibliographic records read off the documents."""
    d = table(spark, sf_dir, "documents").withColumn("w", F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "))
    word = lambda i: F.coalesce(F.get("w", F.lit(i)), F.lit("x"))
    authors = (F.when(F.col("n_chars") % 3 == 0, F.array(F.concat_ws(" ", word(0), word(1), word(2))))
               .when(F.col("n_chars") % 3 == 1, F.array(F.concat_ws(" ", word(0), word(1)), word(2)))
               .otherwise(F.array(F.concat_ws(" ", word(0), word(1)), word(2), F.concat_ws(" ", word(3), word(4)))))
    year = F.when(F.col("lang") != "es", F.concat(F.lit(", "), (F.lit(1990) + F.col("n_chars") % 30).cast("string"))).otherwise(F.lit(""))
    return d.select(
        F.col("doc_id").alias("paper_id"), F.concat_ws("-", "source", "lang").alias("topic"),
        F.concat(word(5), F.lit(" "), word(6), F.lit(": "), F.lower(word(7)), F.lit(" "), word(8)).alias("title"), authors.alias("authors"),
        F.when(F.col("lang") == "de", F.concat(word(9), year)).otherwise(F.concat(word(9), F.lit(" - "), "source", year, F.lit(" - web"))).alias("summary"),
        F.concat(F.lit("https://example.com/"), F.col("doc_id").cast("string")).alias("link"), "text")


def reply_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair_id, prompt, chosen, rejected): a user turn, the reply after it, and the turn two later."""
    c = table(spark, sf_dir, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.when(F.col("role") == "assistant", F.col("text")).alias("chosen"))
    far = c.select("conv_id", (F.col("turn") - 3).alias("turn"), F.when(F.col("role") == "assistant", F.col("text")).alias("rejected"))
    return c.filter("role = 'user'").join(nxt, ["conv_id", "turn"], "left").join(far, ["conv_id", "turn"], "left").select(
        F.format_string("%d-%d", "conv_id", "turn").alias("pair_id"), F.col("text").alias("prompt"), "chosen", "rejected")


def filings_documents(facts: DataFrame) -> DataFrame:
    """(ticker, text): filing indexes with parallel arrays, newest first, from a company's reported facts.

    A company's facts are bounded by its tags, fiscal years and forms.
    """
    listed = facts.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("filed", "accn", "form")), asc=False).alias("f"))
    quoted = lambda fn: F.concat(F.lit("["), F.array_join(F.transform("f", lambda x: F.concat(F.lit('"'), fn(x), F.lit('"'))), ","), F.lit("]"))
    return listed.select("ticker", F.concat(
        F.lit('{"cik":"'), F.regexp_replace("ticker", "^C0*", ""), F.lit('","filings":{"recent":{"form":'), quoted(lambda x: x["form"]),
        F.lit(',"filingDate":'), quoted(lambda x: x["filed"].cast("string")), F.lit(',"accessionNumber":'), quoted(lambda x: F.concat_ws("-", x["accn"], F.lit("1"))),
        F.lit(',"primaryDocument":'), quoted(lambda x: F.concat(x["accn"], F.lit(".htm"))), F.lit("}}}")).alias("text"))
