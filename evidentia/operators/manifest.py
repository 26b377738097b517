"""Cached raw files against their manifest: (dest, sha256, bytes, request_fingerprint, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def verify_manifest(manifest: DataFrame, scan: DataFrame) -> DataFrame:
    """Recorded files that are missing or whose bytes differ."""
    j = manifest.select("dest", F.col("sha256").alias("recorded")).join(
        scan.select("dest", F.col("sha256").alias("found")), "dest", "left")
    # The two findings.
    issue = F.when(F.col("found").isNull(), "recorded in manifest but missing on disk").when(
        F.col("found") != F.col("recorded"), "on-disk bytes do not match recorded sha256")
    return j.select("dest", issue.alias("issue")).filter(F.col("issue").isNotNull())


def plan_refresh(wanted: DataFrame, manifest: DataFrame, scan: DataFrame) -> DataFrame:
    """(dest, needs_fetch): a file is reused only if present, recorded, intact and answering the same request."""
    m = manifest.select("dest", F.col("sha256").alias("recorded"), F.col("request_fingerprint").alias("_fp"))
    j = wanted.select("dest", "request_fingerprint").join(m, "dest", "left").join(
        scan.select("dest", F.col("sha256").alias("found")), "dest", "left")
    good = (F.col("found") == F.col("recorded")) & (F.col("_fp") == F.col("request_fingerprint"))
    return j.select("dest", (~F.coalesce(good, F.lit(False))).alias("needs_fetch"))


def require(wanted: DataFrame, scan: DataFrame) -> DataFrame:
    """Requested inputs that are not cached."""
    return wanted.select("dest").join(scan.select("dest"), "dest", "left_anti")


def upsert_manifest(manifest: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fresh records replace those of the same file; the rest stay."""
    kept = manifest.join(fresh.select("dest"), "dest", "left_anti")
    return kept.unionByName(fresh)
