"""What readers and sinks leave and find: files are written from the given tables and read back; their SQL states what went in."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.catalogue.chat import _PAIRS
from evidentia.session import shared_folder
from evidentia.sources import readers as R
from evidentia.sources import sinks as W
from evidentia.sources import tables as V


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/evidentia/{name}-{uuid.uuid4().hex}"


def one_file_each(bodies: DataFrame, path: str) -> None:
    """(name, body): a text file per name, in a folder of that name."""
    bodies.repartition("name").write.partitionBy("name").text(path)


def ticker_map(spark, sf_dir):
    """A company map per nation: an object keyed by row number."""
    c = V.table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey")
    entry = F.concat(F.lit('{"cik_str": '), F.col("c_custkey").cast("string"), F.lit(', "ticker": "c'), F.col("c_custkey").cast("string"), F.lit('"}'))
    listed = c.groupBy(F.col("c_nationkey").alias("name")).agg(F.sort_array(F.collect_list(entry)).alias("e"))
    keyed = F.array_join(F.transform("e", lambda x, i: F.concat(F.lit('"'), i.cast("string"), F.lit('": '), x)), ", ")
    path = folder(spark, "tickers")
    one_file_each(listed.select("name", F.concat(F.lit("{"), keyed, F.lit("}")).alias("body")), path)
    return R.read_ticker_map(spark, f"{path}/*")


def series_csv(spark, sf_dir):
    """Orders as a CSV whose price is missing or a word on some rows; two columns of it come back as numbers."""
    o = V.table(spark, sf_dir, "orders")
    price = F.when(F.col("o_orderkey") % 7 == 0, "n/a").when(F.col("o_orderkey") % 7 == 1, "").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    path = folder(spark, "series")
    o.select("o_orderstatus", price.alias("price"), "o_orderkey").write.option("header", True).csv(path)
    got = R.read_series_csv(spark, path, ["o_orderkey", "price"])
    return got.agg(F.count(F.lit(1)).alias("n"), F.count("price").alias("prices"), F.sum("o_orderkey").alias("keys"), F.round(F.sum("price"), 2).alias("total"))


def word_list(spark, sf_dir):
    """Part names, some with blanks around them, some blank, as a word list."""
    p = V.table(spark, sf_dir, "part")
    line = F.when(F.col("p_partkey") % 5 == 0, "   ").when(F.col("p_partkey") % 5 == 1, F.concat(F.lit("  "), "p_name", F.lit(" "))).otherwise(F.col("p_name"))
    path = folder(spark, "words")
    p.select(line.alias("value")).write.text(path)
    return R.read_wordlist(spark, path).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def keyword_map(spark, sf_dir):
    """A map of keywords to replies per brand."""
    p = V.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name"), "p_name").agg(F.max("p_type").alias("reply"))
    listed = p.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("p_name", "reply"))).alias("keyword"))
    path = folder(spark, "keywords")
    one_file_each(listed.select(F.regexp_replace("name", "#", "-").alias("name"), F.to_json(F.struct("keyword")).alias("body")), path)
    return R.read_keyword_map(spark, f"{path}/*").groupBy("keyword").agg(F.count(F.lit(1)).alias("n"), F.max("reply").alias("reply"))


def raw_files(spark, sf_dir):
    """Hash and size of every file below a folder: the customers of a nation, a line each."""
    c = V.table(spark, sf_dir, "customer")
    listed = c.groupBy(F.col("c_nationkey").alias("name")).agg(F.array_join(F.sort_array(F.collect_list(F.col("c_custkey"))).cast("array<string>"), ",").alias("body"))
    path = folder(spark, "raw")
    one_file_each(listed, path)
    found = R.scan_raw(spark, path).filter(F.contains("dest", F.lit("part-")))
    return found.select(F.regexp_extract("dest", "name=([0-9]+)/", 1).cast("int").alias("nation"), "sha256", "bytes")


def results(spark, sf_dir):
    """Result rows with the metadata of their run, written twice: the later ones stay."""
    r = V.table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    path = folder(spark, "results")
    for run in ("first", "second"):
        W.write_results(r, path, run, False, "orders")
    back = spark.read.json(path)
    return back.select("run_id", "is_synthetic", "data_source", "o_orderstatus", "n", F.col("generated_at").isNotNull().alias("dated"))


def runs(spark, sf_dir):
    """Runs per model and suite: a later run of some models replaces their rows and no others'."""
    o = V.table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("answerer"), F.col("o_orderstatus").alias("suite")).agg(F.count(F.lit(1)).alias("n"))
    path = folder(spark, "runs")
    W.write_run(o, path)
    W.write_run(o.filter("answerer LIKE '1%'").withColumn("n", -F.col("n")), path)
    return spark.read.parquet(path).select("slug", F.col("suite").cast("string").alias("suite"), "n")


def transcripts(spark, sf_dir):
    """Turns as transcripts of their speakers, read back by folder."""
    t = V.table(spark, sf_dir, "conversations").select(F.col("role").alias("answerer"), "conv_id", "text")
    path = folder(spark, "transcripts")
    W.write_transcripts(t, path)
    return spark.read.parquet(path).groupBy("answerer").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def preference_pairs(spark, sf_dir):
    """Pairs as JSON arrays, a file per tenth of the conversations; records that lack a field come back as rejected."""
    p = V.reply_pairs(spark, sf_dir)
    name = F.pmod(F.split("pair_id", "-")[0].cast("bigint"), F.lit(10)).alias("name")
    listed = p.groupBy(name).agg(F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct("prompt", "chosen", "rejected"))), ","), F.lit("]")).alias("body"))
    path = folder(spark, "pairs")
    one_file_each(listed, path)
    whole, rejected = R.read_preference_pairs(spark, f"{path}/*")
    chars = lambda *c: sum((F.coalesce(F.length(x), F.lit(0)) for x in c), F.lit(0))
    return whole.select(F.lit(True).alias("ok"), chars("prompt", "chosen", "rejected").alias("n")).unionByName(
        rejected.select(F.lit(False).alias("ok"), chars("prompt", "chosen", "rejected").alias("n"))).groupBy("ok").agg(
        F.count(F.lit(1)).alias("pairs"), F.sum("n").cast("bigint").alias("chars"))


QUERIES = {"stored_preference_pairs": preference_pairs, "stored_ticker_map": ticker_map, "stored_series_csv": series_csv, "stored_word_list": word_list, "stored_keyword_map": keyword_map,
           "stored_raw_files": raw_files, "stored_results": results, "stored_runs": runs, "stored_transcripts": transcripts}

ORACLE = {
    "stored_preference_pairs": f"""WITH {_PAIRS} SELECT chosen IS NOT NULL AND rejected IS NOT NULL AS ok, count(*) AS pairs,
  CAST(sum(length(prompt) + coalesce(length(chosen), 0) + coalesce(length(rejected), 0)) AS BIGINT) AS chars FROM pairs GROUP BY 1""",
    "stored_ticker_map": "SELECT 'C' || c_custkey AS ticker, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik FROM customer",
    "stored_series_csv": """SELECT count(*) AS n, count(*) FILTER (o_orderkey % 7 > 1) AS prices, CAST(sum(o_orderkey) AS DOUBLE) AS keys,
  round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderkey % 7 > 1) AS DOUBLE), 2) AS total FROM orders""",
    "stored_word_list": "SELECT p_name AS word, count(*) AS n FROM part WHERE p_partkey % 5 <> 0 GROUP BY 1",
    "stored_keyword_map": """SELECT p_name AS keyword, count(*) AS n, max(reply) AS reply FROM (
  SELECT p_brand, p_name, max(p_type) AS reply FROM part GROUP BY 1, 2) GROUP BY 1""",
    "stored_raw_files": """SELECT CAST(c_nationkey AS INT) AS nation, sha256(b || chr(10)) AS sha256, CAST(strlen(b) + 1 AS BIGINT) AS bytes
FROM (SELECT c_nationkey, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) AS b FROM customer GROUP BY 1)""",
    "stored_results": "SELECT 'second' AS run_id, false AS is_synthetic, 'orders' AS data_source, o_orderstatus, count(*) AS n, true AS dated FROM orders GROUP BY 4",
    "stored_runs": """SELECT trim(regexp_replace(lower(o_orderpriority), '[^a-z0-9]+', '-', 'g'), '-') AS slug, o_orderstatus AS suite,
  CASE WHEN o_orderpriority LIKE '1%' THEN -count(*) ELSE count(*) END AS n FROM orders GROUP BY o_orderpriority, o_orderstatus""",
    "stored_transcripts": "SELECT role AS answerer, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1",
}
