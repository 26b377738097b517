import os
import random
import sys

import duckdb
import pytest
from pyspark.sql import functions as F
from tests.llm.helpers import documents, odd_texts, words

from evidentia.llm import mixing

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def random_rows(sources, n=600):
    rng = random.Random(len(sources))
    return [(i, "w " * rng.choice([0, 3, 10, 50, 400 if i % 97 == 0 else 5]), rng.choices(sources, range(1, len(sources) + 1))[0]) for i in range(n)]


@pytest.mark.parametrize("sources", [["a"], ["a", "b"], [None, "z", "é", "Z", "a", "字"], [f"s{i}" for i in range(12)]])
def test_against_sql(spark, monkeypatch, sources):
    monkeypatch.setattr(mixing, "BUCKETS", 8)
    rows = random_rows(sources)
    df = documents(spark, rows)
    got = sorted(tuple(r) for r in mixing.mixed(df.repartition(3)).collect())
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text", "source").toPandas().astype({"source": object}))
    con.execute("CREATE TABLE d AS SELECT * FROM documents")
    want = sorted(con.execute(mixing.MIXED_SQL.replace("FROM documents", "FROM d")).fetchall())
    assert [tuple(round(x, 6) for x in r) for r in got] == [tuple(round(x, 6) for x in r) for r in want]


def test_words_taken_come_near_targets(spark):
    rows = random_rows([f"s{i}" for i in range(7)], 3000)
    got = mixing.mixed(documents(spark, rows)).collect()
    source = {r[0]: r[2] for r in rows}
    taken, target, size = {}, {}, {}
    for r in got:
        s = source[r["doc_id"]]
        taken[s] = taken.get(s, 0) + r["taken"]
        size[s] = size.get(s, 0) + r["size"]
        target[s] = r["target"]
        assert r["taken"] <= 2 * r["size"] and r["source_size"] > 0
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6 * sum(size.values())
    for s in target:
        assert target[s] <= 2 * size[s] + 1e-9 and abs(taken[s] - target[s]) <= 400


def test_odd_rows_and_copies(spark):
    df = documents(spark, odd_texts())
    got = mixing.mixed(df).collect()
    assert len(got) == df.count() and sorted(r["size"] for r in got) == sorted(len(words(t)) for _, t in odd_texts())
    drawn = mixing.drawn(df)
    assert drawn.columns == df.columns
    assert sum(len(words(r["text"])) for r in drawn.collect()) == sum(r["taken"] for r in got)


def test_empty_table(spark):
    assert mixing.mixed(documents(spark, [])).count() == 0 and mixing.drawn(documents(spark, [])).count() == 0


def test_the_rank_decides(spark, monkeypatch):
    """With the random number in place of the Pareto rank other documents are drawn; sums still come near the targets."""
    rows = [(i, "w " * (20 if i % 3 == 0 else 300 if i % 3 == 1 else 1500), "ab"[i % 2]) for i in range(900)]
    df = documents(spark, rows)
    taken = {r["doc_id"]: r["taken"] for r in mixing.mixed(df).collect()}
    monkeypatch.setattr(mixing, "pareto_rank", lambda u, odds: F.when(odds > 0, u))
    other = {r["doc_id"]: r["taken"] for r in mixing.mixed(df).collect()}
    assert sum(taken[i] != other[i] for i in taken) > 30


def test_draws_follow_the_weights(spark):
    """Expected copies of a length class are its weight times the source's level; drawn shares come near them, and none passes MOST."""
    rows = [(i, "w " * (50 if i % 4 < 2 else 500 if i % 4 == 2 else 2000), "abc"[i % 3]) for i in range(6000)]
    got = mixing.mixed(documents(spark, rows)).collect()
    where = {r["mix_source"]: r for r in mixing.cuts(documents(spark, rows)).collect()}
    source = {i: s for i, _, s in rows}
    for s in "abc":
        for kind, size in enumerate((50, 500, 2000)):
            own = [r for r in got if source[r["doc_id"]] == s and r["size"] == size]
            mean = sum(r["taken"] / r["size"] for r in own) / len(own)
            assert abs(mean - where[s]["expected"][kind]) < 0.12 and max(r["taken"] for r in own) <= 2 * size
        words = sum(r["taken"] for r in got if source[r["doc_id"]] == s)
        assert abs(words - where[s]["target"]) <= 2000
