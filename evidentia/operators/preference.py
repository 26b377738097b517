"""Preference pairs: completeness, texts, reproducible split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ["prompt", "chosen", "rejected"]


def require_fields(pairs: DataFrame, fields: list[str] = FIELDS) -> tuple[DataFrame, DataFrame]:
    """(complete records, records missing a field)."""
    whole = F.lit(True)
    for f in fields:
        whole = whole & F.col(f).isNotNull()
    return pairs.filter(whole), pairs.filter(~whole)


def preference_text(pairs: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Add the two texts, prompt followed by answer; cut only where a length is asked for."""
    text = lambda answer: F.concat("prompt", F.lit("\n\n回答："), answer)
    cut = (lambda c: c) if max_chars is None else (lambda c: F.substring(c, 1, max_chars))
    return pairs.withColumn("chosen_text", cut(text("chosen"))).withColumn("rejected_text", cut(text("rejected")))


def split_bucket(key: Column, seed: int = 0, buckets: int = 1000) -> Column:
    """Stable bucket of a record: the first eight hex digits of a hash, modulo."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{seed}"))), 1, 8), 16, 10).cast("bigint") % buckets


def preference_dataset(pairs: DataFrame, key: str, test_size: float = 0.1, seed: int = 0) -> DataFrame:
    """Texts with ``part`` = train or test; a size of zero or less puts every record in both."""
    whole, _ = require_fields(pairs)
    t = preference_text(whole)
    if test_size <= 0:
        return t.withColumn("part", F.explode(F.array(F.lit("train"), F.lit("test"))))
    return t.withColumn("part", F.when(split_bucket(F.col(key), seed) < int(test_size * 1000), "test").otherwise("train"))
