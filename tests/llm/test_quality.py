import math
import random

from pyspark.sql import functions as F
from tests.llm.helpers import documents, odd_texts, words

from evidentia.llm import quality


def brute(text):
    w = words(text)
    where = {}
    for i in range(len(w) - 7):
        where.setdefault(tuple(w[i : i + 8]), []).append(i)
    lost = {j for at in where.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(lost),
            len(w) < 20 or 100 * len(lost) > 30 * len(w))


def random_rows():
    rng = random.Random(6)
    rows = []
    for i in range(150):
        lines = [" ".join(rng.choice(["aa", "b#", "é|", "D!"]) for _ in range(rng.randrange(12))) for _ in range(6)]
        rows.append((i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 12))) + rng.choice(["", "\n", "\t\n \n"])))
    return rows


def test_counts_against_brute_force(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    for rows in (random_rows(), odd_texts()):
        got = quality.judged(documents(spark, rows).repartition(3), none).collect()
        assert sorted((tuple(r)[:7] for r in got), key=repr) == sorted(((d, *brute(t)) for d, t in rows), key=repr)
        assert all(r["kept"] == (not r["base_failed"]) for r in got)


def test_tail_is_exact(spark):
    for n, k, p in ((100, 0, 0.02), (400, 3, 0.02), (1000, 5, 0.01), (50, 4, 0.05), (5000, 60, 0.02)):
        want = sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)) if k < n * p else 1.0
        (got,) = spark.range(1).select(quality.tail(F.lit(n).cast("long"), F.lit(k).cast("long"), p)).first()
        assert abs(got - want) < 1e-9 * max(1, want)


def test_strata_lose_few_good_documents(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(3000):
        bad = rng.random() < 0.3
        w = [rng.choice("abcdefghijklmnop") * rng.randrange(1, 9) + str(rng.randrange(9999)) for _ in range(30)]
        rows.append((i, " ".join(x + ("%%%" if bad else "") for x in w)))
        labels.append((i, 0 if bad else 1))
    docs = documents(spark, rows).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, None).when(F.col("doc_id") < 100, "few").otherwise("many"))
    got = quality.judged(docs, spark.createDataFrame(labels, "doc_id long, quality int")).join(docs.select("doc_id", "lang"), "doc_id").collect()
    good = dict(labels)
    for lang in (None, "many"):
        own = [r for r in got if r["lang"] == lang]
        assert sum(not r["kept"] for r in own if good[r["doc_id"]]) <= 0.02 * sum(good[r["doc_id"]] for r in own)
        assert sum(r["kept"] for r in own if not good[r["doc_id"]]) == 0
    assert all(r["kept"] for r in got if r["lang"] == "few")


def test_no_rule_without_evidence(spark):
    """Too few labels to bound the false rejections: only the base rules decide."""
    rows = [(i, " ".join(f"w{j}{'%%%' if i % 2 else ''}" for j in range(30))) for i in range(60)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)] + [(None, 0), (1, None)], "doc_id long, quality int")
    assert all(r["kept"] for r in quality.judged(documents(spark, rows), labels).collect())
    assert quality.judged(documents(spark, []), labels).count() == 0


def test_plan_has_no_python(spark):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    plan = quality.judged(documents(spark, odd_texts()), labels)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
