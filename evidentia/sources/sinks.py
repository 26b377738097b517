"""Writing results: runs, ledger entries, manifests, transcripts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import ledger as L
from evidentia.operators import manifest as M


def slug(name: Column) -> Column:
    """Lower case, runs of other characters as one dash, no dash at the ends."""
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))


def write_results(df: DataFrame, path: str, run_id: str, is_synthetic: bool, data_source: str) -> None:
    """Result rows as JSON, each with the metadata of its run."""
    df.select(F.lit(run_id).alias("run_id"), F.current_timestamp().alias("generated_at"),
              F.lit(is_synthetic).alias("is_synthetic"), F.lit(data_source).alias("data_source"), *df.columns
              ).write.mode("overwrite").json(path)


def categorised(entries: DataFrame) -> DataFrame:
    """Entries without a category get the keyword classifier's."""
    given = F.col("category") if "category" in entries.columns else F.lit(None).cast("string")
    return entries.withColumn("category", F.coalesce(F.nullif(given, F.lit("")), L.keyword_category(F.col("description"))))


def append_ledger(entries: DataFrame, path: str) -> None:
    """Append entries; one without a category gets the keyword classifier's."""
    categorised(entries).write.mode("append").parquet(path)


# --- writes that may be repeated -------------------------------------------
#
# A numbered batch is written under ``entries`` and then marked under ``commits``.
# Readers go by the marks, so a batch counts from one moment on and whole; a batch
# that is marked is not written again, one that broke off is written over.

def marks(spark: SparkSession, path: str) -> DataFrame | None:
    """(batch) of the marked batches; None where nothing was ever written."""
    try:
        return spark.read.schema("batch bigint").json(f"{path}/commits")
    except AnalysisException:
        return None


def write_batch(df: DataFrame, path: str, batch: int) -> None:
    """Write a numbered batch unless it is marked already; one writer at a time."""
    spark = df.sparkSession
    done = marks(spark, path)
    if done is not None and done.filter(F.col("batch") == batch).take(1):
        return
    df.write.mode("overwrite").parquet(f"{path}/entries/batch={batch}")
    spark.range(1).select(F.lit(batch).cast("bigint").alias("batch")).coalesce(1).write.mode("append").json(f"{path}/commits")


def append_batch(entries: DataFrame, path: str, batch: int) -> None:
    """Append a numbered batch of entries; repeating it changes nothing. Serves as ``foreachBatch`` of a stream."""
    write_batch(categorised(entries), path, batch)


def read_batches(spark: SparkSession, path: str) -> DataFrame | None:
    """The entries of all marked batches."""
    done = marks(spark, path)
    return None if done is None else spark.read.parquet(f"{path}/entries").join(done.distinct(), "batch", "left_semi").drop("batch")


def ledger_stream(entries: DataFrame, path: str, checkpoint: str) -> None:
    """Process what a stream of entries holds now; a replay, with or without its checkpoint, leaves the same ledger."""
    entries.writeStream.foreachBatch(lambda batch, number: append_batch(batch, path, number)).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def switch_manifest(fresh: DataFrame, path: str, version: int) -> None:
    """The current manifest with fresh records in place of those of the same file, as a new version; repeating it changes nothing."""
    now = current_manifest(fresh.sparkSession, path)
    write_batch(fresh if now is None else M.upsert_manifest(now, fresh), path, version)


def current_manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """The records of the last marked version."""
    done = marks(spark, path)
    last = None if done is None else done.agg(F.max("batch")).first()[0]
    return None if last is None else spark.read.parquet(f"{path}/entries/batch={last}")


def write_manifest(manifest: DataFrame, fresh: DataFrame, path: str) -> None:
    """Upserted manifest under a new path, so that the one being read stays whole."""
    M.upsert_manifest(manifest, fresh).write.mode("errorifexists").parquet(path)


def write_run(df: DataFrame, path: str, model: str = "answerer", suite: str = "suite") -> None:
    """One partition per model and suite; a later model replaces only its own."""
    (df.withColumn("slug", slug(F.col(model))).withColumn("suite", F.col(suite))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slug", "suite").parquet(path))


def write_transcripts(transcripts: DataFrame, path: str) -> None:
    transcripts.write.mode("overwrite").partitionBy("answerer").parquet(path)
