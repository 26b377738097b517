"""Small tables with the awkward rows that every operator has to bear."""

import re

from pyspark.sql import functions as F

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode())


def documents(spark, rows, extra=True):
    """Rows of (doc_id, text) or (doc_id, text, source), with columns whose names clash with the operators' own."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        for name in ("score", "gone", "fp", "mix", "rank", "u", "row", "size", "count", "bucket", "part"):
            df = df.withColumn(name, F.lit("x"))
    return df


def odd_texts():
    base = " ".join(f"w{i}" for i in range(40))
    return [(1, base), (2, base), (2, base), (3, base + " more words at the end"), (4, ""), (5, None), (6, " \n\t "), (None, base),
            (7, "one"), (8, "é ü – 字 字 字"), (9, " ".join(f"x{i % 50}" for i in range(30000))), (10, "a b c d " * 10), (11, "a b c d " * 10)]
