"""Quality rules with risk-controlled thresholds, in built-in functions only.

Every text gets counts, and from them a score: the sum, over a few rates cut into
bins, of the log odds that labelled documents of the fitting fold with that bin
are bad. A cutoff per stratum is then chosen on the other fold, the holdout. For
each candidate from the highest down the hypothesis that it rejects over ``RISK``
of the good documents is tested by the exact binomial tail of the false
rejections seen; testing stops at the first candidate that fails (a fixed
sequence, which needs no correction along it) and each stratum has its share of
``MISTAKE`` (Bonferroni). With probability 1 - MISTAKE no stratum's cutoff rejects
more than RISK of its good documents; a stratum with too few labels gets none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import in_fold, words

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW, LEAST_WORDS, MOST_REPEATS = 8, 20, 30
#: Share of good documents that a stratum may lose, and the chance that any stratum's cutoff breaks that.
RISK, MISTAKE = 0.02, 0.05
#: Candidate cutoffs of the score, highest first, and bins of a rate (0 to BINS).
CANDIDATES = [12.25 - 0.5 * i for i in range(24)]
BINS = 20


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def repeated_words(hashes: Column, n_words: Column, window: int = REPEAT_WINDOW) -> Column:
    """Hashes of the windows of ``window`` words, in order; none for shorter texts."""
    return F.when(n_words >= window, F.transform(F.sequence(F.lit(1), n_words - window + 1), lambda i: F.xxhash64(F.slice(hashes, i, window)))).otherwise(
        F.array().cast("array<bigint>"))


def counted(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper, n_bangs; null texts count as empty.

    Each step is a column of its own where the next reads it more than once, so
    that no array is built again per element.
    """
    text = F.col("text")
    own = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("w", words(text)).withColumn("lines", F.filter(F.split(text, "\n"), lambda x: without(x, SPACES) != ""))
    own = own.withColumn("h", F.transform("w", lambda x: F.xxhash64(x))).withColumn("n_words", F.size("w"))
    own = own.withColumn("win", repeated_words(F.col("h"), F.size("h")))
    again = F.size(F.array_distinct("win")) < F.size("win")
    own = own.withColumn("s", F.when(again, F.array_sort(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    s = F.col("s")
    same = lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
    own = own.withColumn("p", F.array_sort(F.transform(F.filter(s, same), lambda x: x["i"])))
    reach = F.transform("p", lambda p, i: F.least(F.lit(REPEAT_WINDOW), F.coalesce(F.get(F.col("p"), i + 1) - p, F.lit(REPEAT_WINDOW))))
    length = lambda c: F.length(c).cast("long")
    return own.select(
        *keep, F.col("n_words").cast("long").alias("n_words"), length(without(text, SPACES)).alias("word_chars"),
        (length(text) - length(without(text, SYMBOLS))).alias("n_symbols"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"), (length(text) - length(without(text, "!"))).alias("n_bangs"))


def rates() -> dict[str, Column]:
    """Rates by name, each cut to a whole number from 0 to BINS."""
    per = lambda a, b, times: F.least(F.floor(F.coalesce(F.try_divide(times * F.col(a), F.col(b)), F.lit(0))), F.lit(BINS)).cast("int")
    return {
        "symbols": per("n_symbols", "n_words", 5), "upper": per("n_upper", "word_chars", BINS), "bangs": per("n_bangs", "n_words", 10),
        "lines": per("n_dup_lines", "n_lines", BINS), "repeats": per("n_repeat_words", "n_words", BINS), "letters": per("word_chars", "n_words", 1),
    }


def log_odds(fitting: DataFrame) -> dict[str, list[float]]:
    """By rate, the log odds of bad against good in each bin, smoothed; at most rates times bins rows reach the driver."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("rate"), c.alias("bin")) for n, c in rates().items()])).alias("x")
    rows = fitting.select("good", pairs).groupBy("x.rate", "x.bin").agg(
        F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad")).collect()
    seen = {(r["rate"], r["bin"]): (r["bad"], r["good"]) for r in rows}
    out = {}
    for name in rates():
        own = [seen.get((name, b), (0, 0)) for b in range(BINS + 1)]
        bad, good = (sum(x[i] for x in own) + 0.5 * (BINS + 1) for i in (0, 1))
        out[name] = [math.log((b + 0.5) / bad) - math.log((g + 0.5) / good) for b, g in own]
    return out


def tail(n: Column, k: Column, rate: float) -> Column:
    """Chance of at most ``k`` of ``n`` at ``rate``; 1 without looking where k is no less than expected."""
    start = F.struct((n * math.log1p(-rate)).cast("double").alias("log"), F.lit(0.0).alias("sum"))
    step = lambda a, j: F.struct(
        (a["log"] + F.log((n - j).cast("double")) - F.log((j + 1).cast("double")) + math.log(rate / (1 - rate))).alias("log"), (a["sum"] + F.exp(a["log"])).alias("sum"))
    terms = F.aggregate(F.sequence(F.lit(0).cast("long"), k), start, step, lambda a: a["sum"])
    return F.when(k >= n * rate, F.lit(1.0)).otherwise(terms)


def cutoffs(holdout: DataFrame, stratum: str, risk: float = RISK, mistake: float = MISTAKE) -> DataFrame:
    """stratum, cutoff: the lowest candidate before the first that fails its test, for strata that have one.

    One row per stratum and candidate, summed before the shuffle.
    """
    good = holdout.filter("good").groupBy(stratum).agg(
        F.count("*").alias("n"), F.array(*[F.sum((F.col("quality_score") > c).cast("long")) for c in CANDIDATES]).alias("lost"))
    strata = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    good = good.withColumn("strata", F.count("*").over(strata))
    each = good.select(stratum, "n", "strata", F.posexplode("lost").alias("at", "k"))
    fails = (tail(F.col("n"), F.col("k"), risk) > mistake / F.col("strata")).cast("int")
    so_far = F.sum(fails).over(Window.partitionBy(stratum).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    passed = each.withColumn("failed", so_far).filter("failed = 0").groupBy(stratum).agg(F.max("at").alias("at"))
    return passed.select(stratum, F.array(*map(F.lit, CANDIDATES))[F.col("at")].alias("cutoff"))


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, mistake: float = MISTAKE) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality_score of every row.

    A document labelled both ways counts as good; rows and labels without an id are
    not learned from. A null stratum is one of its own. Without labels the base
    rules alone decide; a text without words fails them.
    """
    features = stage(counted(docs, ["doc_id", stratum]), "features")
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg((F.max("quality") > 0).alias("good"))
    labelled = stage(features.join(known, "doc_id"), "labelled")
    odds = log_odds(labelled.filter(in_fold(F.col("doc_id"), 2, 0)))
    score = sum((F.array(*map(F.lit, odds[name]))[c] for name, c in rates().items()), F.lit(0.0))
    found = stage(cutoffs(labelled.filter(in_fold(F.col("doc_id"), 2, 1)).withColumn("quality_score", score), stratum, risk, mistake), "cutoffs")
    found = found.withColumnRenamed(stratum, "of_stratum")
    base_failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATS * F.col("n_words"))
    joined = features.withColumn("quality_score", score).join(found, F.col(stratum).eqNullSafe(F.col("of_stratum")), "left")
    kept = ~base_failed & (F.col("cutoff").isNull() | (F.col("quality_score") <= F.col("cutoff")))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), kept.alias("kept"),
                         "quality_score")
