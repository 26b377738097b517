"""Session settings and staging of small intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "*", shuffle_partitions: int = 8, app: str = "evidentia") -> SparkSession:
    """A session for tests and the bench; a cluster job passes its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.driver.host", "localhost")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.sessionWindow.merge.sessions.in.local.partition", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Where the setting is absent a local master gets a temporary folder; a
    cluster must name one, since a machine-local folder would not survive the
    loss of that machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="evidentia-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stage(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back, clustered ``by`` a column if one is given.

    For aggregates that several branches of one plan read: the big scan behind
    them runs once, the lineage is cut at durable files, and the files' size
    lets Spark choose a broadcast or a shuffle join on a measured figure.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/evidentia/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    return staged.repartition(task_count(staged), by) if by else staged


def task_count(df: DataFrame) -> int:
    """Tasks for work that is heavy per row though small in bytes.

    A repartition by name alone would be merged to one task by adaptive
    execution, which goes by bytes.
    """
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def path_batches(spark: SparkSession, rows: int = 256) -> None:
    """Send at most ``rows`` rows at a time to Python workers, for rows that hold whole series, unless the session asks for fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
