"""Mixing sources to target weights by Pareto order sampling, in built-in functions only.

A document's expected copies are its source's level times the weight of its length
(LENGTHS), held at MOST; the level is the one at which a source's expected words
meet its target. The whole part of the expected copies is certain, the fraction is
an inclusion probability, unequal within a source. Documents are ranked by random
odds over inclusion odds, and the first of that order are taken until their words
come nearest to what is left of the target. The order is cut by two-step sums
(buckets of the rank, then rows of the one bucket in which the cut falls), so no
task sorts a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import WORD

#: Fixed values of the mix: weights by rank of the source, words to take over all words, most copies.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: How readily a document is drawn: those of at most so many words weigh so much, longer ones REMAINING.
LENGTHS, REMAINING = ((100, 2), (1000, 3)), 1
BUCKETS = 4096
SEED = "mix"
#: 52 random bits out of a digest.
BITS = 52


def size_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def chance(doc_id: Column, seed: str = SEED) -> Column:
    """A number between 0 and 1 that depends on the id alone; never 0 or 1."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("double") + 0.5) / float(1 << BITS)


def length_class(size: Column) -> Column:
    """Place of a document's weight in ``class_weights``."""
    out = F.lit(len(LENGTHS))
    for i, (most, _) in reversed(list(enumerate(LENGTHS))):
        out = F.when(size <= most, i).otherwise(out)
    return out


def class_weights() -> list[int]:
    return [w for _, w in LENGTHS] + [REMAINING]


def level_of(target: Column, words: list[Column], most: int) -> Column:
    """The level at which sums of least(most, level * weight) * words are the target.

    With the heaviest classes held at ``most`` the rest gives one candidate; holding
    a class that need not be held gives less, so the largest candidate is the level.
    """
    order = sorted(range(len(words)), key=lambda k: -class_weights()[k])
    found = []
    for held in range(len(order)):
        left = target - sum((float(most) * words[k] for k in order[:held]), F.lit(0.0))
        found.append(F.try_divide(left, sum((float(class_weights()[k]) * words[k] for k in order[held:]), F.lit(0.0))))
    return F.greatest(*found)


def pareto_rank(u: Column, odds: Column) -> Column:
    """Odds of the random number over odds of inclusion; null where nothing is left to draw."""
    return F.when(odds > 0, u / (1 - u) * (1 - odds) / odds)


def rank_bucket(rank: Column) -> Column:
    return F.least(F.floor(rank / (1 + rank) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target, from (source, size): one row per source.

    Sources by code point, null last, take the weights in turn. A target stops at
    ``most`` times its source's size; what is over goes to the others by weight
    until none is above, which is one level of target per weight for all that
    stay below. Windows run over one row per source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.array(*[F.lit(float(w)) for w in weights])[(rank % len(weights)).cast("int")]
    all_rows = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = by_source.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    ranked = ranked.withColumn("at", F.col("cap") / F.col("weight")).withColumn("all", F.lit(share) * F.sum("source_size").over(all_rows))
    by_level = Window.orderBy("at", F.col("source").isNull(), "source")
    full = F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    ranked = ranked.withColumn("level", (F.col("all") - full) / rest)
    level = F.min(F.when(F.col("level") <= F.col("at"), F.struct("at", "source", "level"))).over(all_rows)["level"]
    ranked = ranked.withColumn("found", level)
    return ranked.select("source", "source_size", F.least("cap", F.coalesce(F.col("found") * F.col("weight"), F.col("cap"))).alias("target"))


def cuts(docs: DataFrame, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: mix_source, source_size, target, expected copies by class of length, and the bucket, rank and id at which the sample ends."""
    size = size_of(F.col("text"))
    sized = stage(docs.select("doc_id", "source", size.alias("size"), length_class(size).alias("kind"), chance(F.col("doc_id"), seed).alias("u")), "sized")
    n = len(class_weights())
    cells = stage(sized.groupBy("source", "kind").agg(F.sum("size").alias("size")), "cells")
    wanted = targets(cells.select("source", "size"), weights, share, most)
    by_kind = cells.groupBy(F.col("source").alias("of")).agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("size"))), F.lit(0)).alias(f"w{k}") for k in range(n)])
    wanted = wanted.join(by_kind, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    words = [F.col(f"w{k}") for k in range(n)]
    wanted = wanted.withColumn("level", F.coalesce(level_of(F.col("target"), words, most), F.lit(0.0)))
    wanted = wanted.withColumn("expected", F.array(*[F.least(F.lit(float(most)), F.col("level") * float(w)) for w in class_weights()]))
    certain = [F.floor(F.col("expected")[k]) for k in range(n)]
    rest = F.col("target") - sum((c * w for c, w in zip(certain, words)), F.lit(0.0))
    wanted = stage(wanted.withColumn("rest", F.greatest(F.lit(0.0), rest)).select("source", "source_size", "target", "expected", "rest"), "targets")
    named = wanted.withColumnRenamed("source", "mix_source")
    ranked = sized.join(named.filter("rest > 0"), F.col("source").eqNullSafe(F.col("mix_source")))
    expected = F.get("expected", F.col("kind"))
    ranked = ranked.withColumn("rank", pareto_rank(F.col("u"), expected - F.floor(expected))).filter("rank IS NOT NULL")
    ranked = ranked.withColumn("bucket", rank_bucket(F.col("rank"))).select("mix_source", "doc_id", "size", "rank", "bucket", "rest")
    sums = ranked.groupBy("mix_source", "rest", "bucket").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("ends", F.sum("words").over(Window.partitionBy("mix_source").orderBy("bucket")))
    ended = sums.filter(F.col("ends") > F.col("rest")).groupBy("mix_source").agg(
        F.min("bucket").alias("last"), F.min(F.struct("bucket", (F.col("ends") - F.col("words")).alias("before")))["before"].alias("before"))
    ended = stage(ended.withColumnRenamed("mix_source", "last_source"), "ended")
    at_end = ranked.join(ended, F.col("mix_source").eqNullSafe(F.col("last_source")) & (F.col("bucket") == F.col("last")))
    ordered = Window.partitionBy("mix_source").orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.col("before") + F.sum("size").over(ordered) - F.col("size") / 2
    kept = at_end.withColumn("middle", middle).filter(F.col("middle") <= F.col("rest"))
    edge = kept.groupBy("mix_source").agg(F.max(F.struct("rank", "doc_id")).alias("edge")).withColumnRenamed("mix_source", "edge_source")
    out = named.join(ended.select("last_source", "last"), F.col("mix_source").eqNullSafe(F.col("last_source")), "left")
    out = out.join(edge, F.col("mix_source").eqNullSafe(F.col("edge_source")), "left")
    return stage(out.select("mix_source", "source_size", "target", "expected", "last", "edge"), "cuts")


def copies(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` with a column ``mix``: a struct of source_size, target and copies.

    Joined on the source with the one-row-per-source cuts; no other shuffle of
    the rows. Rows with the same id share their random number and are taken
    together. A null id counts as one id, a null source as a source of its own.
    """
    where = cuts(docs, **settings)
    names = {c: f"{c}_{'_'.join(docs.columns)}" for c in where.columns}
    where = where.select(*[F.col(c).alias(n) for c, n in names.items()])
    seed = settings.get("seed", SEED)
    of = {c: F.col(n) for c, n in names.items()}

    def mix_of(own: Column) -> Column:
        """The mix of a document from its size and random number."""
        expected = F.get(of["expected"], length_class(own["size"]))
        rank = pareto_rank(own["u"], expected - F.floor(expected))
        bucket = rank_bucket(rank)
        before = of["last"].isNull() | (bucket < of["last"])
        on_edge = (bucket == of["last"]) & F.coalesce(F.struct(rank.alias("rank"), own["doc_id"].alias("doc_id")) <= of["edge"], F.lit(False))
        taken = F.when(rank.isNotNull(), (before | on_edge).cast("int")).otherwise(0)
        return F.struct(of["source_size"].alias("source_size"), of["target"].alias("target"), (F.floor(expected).cast("int") + taken).alias("copies"))

    # as one list entry, so that a text is counted once however often the result is used
    own = F.struct(size_of(F.col("text")).alias("size"), chance(F.col("doc_id"), seed).alias("u"), F.col("doc_id").alias("doc_id"))
    mix = F.transform(F.array(own), mix_of)[0]
    name = f"mix_{'_'.join(docs.columns)}" if "mix" in docs.columns else "mix"
    joined = docs.join(where, F.col("source").eqNullSafe(of["mix_source"]))
    return joined.select(*[docs[c] for c in docs.columns], mix.alias(name))


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row."""
    size = size_of(F.col("text"))
    own = copies(docs.select("doc_id", "source", "text"), **settings)
    return own.select("doc_id", size.alias("size"), "mix.source_size", "mix.target", (size * F.col("mix.copies")).alias("taken"))


def drawn(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    own = copies(docs, **settings)
    n = own.columns[-1]
    return own.filter(F.col(n)["copies"] > 0).withColumn(n, F.explode(F.array_repeat(F.lit(0), F.col(n)["copies"].cast("int")))).drop(n)


def _levels_sql() -> str:
    weights = class_weights()
    order = sorted(range(len(weights)), key=lambda k: -weights[k])
    part = lambda held: (f"(target - ({' + '.join(['0.0::DOUBLE'] + [f'{MOST}.0::DOUBLE * w[{k + 1}]' for k in order[:held]])}))"  # noqa: E731
                         f" / nullif({' + '.join(['0.0::DOUBLE'] + [f'{weights[k]}.0::DOUBLE * w[{k + 1}]' for k in order[held:]])}, 0)")
    return ", ".join(part(held) for held in range(len(weights)))


MIXED_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
         (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, {BITS // 4}))::BIGINT::DOUBLE + 0.5) / {1 << BITS}::DOUBLE AS u
  FROM documents),
kinds AS (SELECT *, CASE {' '.join(f'WHEN size <= {most} THEN {i}' for i, (most, _) in enumerate(LENGTHS))} ELSE {len(LENGTHS)} END AS kind FROM sized),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
r AS (SELECT *, [{', '.join(f'{w}.0::DOUBLE' for w in WEIGHTS)}][((row_number() OVER (ORDER BY source IS NULL, source)) - 1) % {len(WEIGHTS)} + 1] AS weight,
             {MOST}.0::DOUBLE * source_size AS cap, {SHARE}::DOUBLE * (SELECT sum(source_size)::DOUBLE FROM s) AS whole FROM s),
l AS (SELECT *, cap / weight AS brim,
             (whole - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM l WHERE level <= brim ORDER BY brim, source IS NULL, source LIMIT 1) * weight, cap)) AS target FROM l),
k AS (SELECT source, [{', '.join(f'coalesce(sum(size) FILTER (kind = {i}), 0)::DOUBLE' for i in range(len(LENGTHS) + 1))}] AS w FROM kinds GROUP BY source),
e AS (SELECT t.*, w, coalesce(greatest({_levels_sql()}), 0) AS level FROM t JOIN k ON t.source IS NOT DISTINCT FROM k.source),
x AS (SELECT *, [{', '.join(f'least({MOST}.0::DOUBLE, level * {w}.0::DOUBLE)' for w in class_weights())}] AS expected FROM e),
c AS (SELECT *, greatest(0.0::DOUBLE, target - ({' + '.join(f'floor(expected[{i + 1}]) * w[{i + 1}]' for i in range(len(LENGTHS) + 1))})) AS rest FROM x),
f AS (SELECT d.*, c.source_size, c.target, c.rest, floor(expected[kind + 1])::INT AS certain, expected[kind + 1] - floor(expected[kind + 1]) AS odds
      FROM kinds d JOIN c ON d.source IS NOT DISTINCT FROM c.source),
g AS (SELECT *, CASE WHEN odds > 0 THEN u / (1 - u) * (1 - odds) / odds END AS rank FROM f),
o AS (SELECT *, sum(CASE WHEN rank IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM g)
SELECT doc_id, size, source_size, target,
       (size * (certain + CASE WHEN rank IS NOT NULL AND rest > 0 AND upto - size / 2 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM o
"""
