import zlib

from conftest import SF
from tests.llm.helpers import documents, odd_texts

from evidentia.llm import toxicity


def test_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = toxicity.toxicity(docs, labels)
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    toxic = [r["score"] for r in rows if r["toxic"] == 1]
    clean = [r["score"] for r in rows if r["toxic"] == 0]
    assert sum(a > b for a in toxic for b in clean) + sum(a == b for a in toxic for b in clean) / 2 > 0.9 * len(toxic) * len(clean)
    assert sum(s >= 0.7 for s in clean) <= 0.02 * len(clean)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got.collect())


def test_patterns_of_a_clause():
    g = toxicity.Grammar(dict.fromkeys(toxicity.INSULTS, 1.0))

    def seen(text):
        return {p: n for p, n in zip(toxicity.PATTERNS, g.patterns(text)) if n}

    assert seen("You are an idiot, moron.") == {("insult", 1, 0, 0): 2}
    assert seen("This is not an idiot") == {("insult", 0, 1, 0): 1}
    assert seen("the paper wrote scum. Scum") == {("insult", 0, 0, 1): 1, ("insult", 0, 0, 0): 1}
    assert seen("I will kill you") == {("threat", 1, 0, 0): toxicity.KNOWN}
    assert seen("subscum and trance") == {} == seen("")


def test_stems_are_learned(spark):
    clean = [(i, f"plain words number {i} blorp{i}") for i in range(150)]
    toxic = [(1000 + i, f"plain words w{i} zarg{'abc'[i % 3]} number {i}") for i in range(60)]
    docs = documents(spark, clean + toxic)
    labels = spark.createDataFrame([(d, int(d >= 1000)) for d, _ in clean + toxic], "doc_id long, toxic int")
    stems, _ = toxicity.learn(docs, labels)
    assert "zarg" in stems and not any(s.startswith("blor") for s in stems)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs, labels).collect()}
    assert got == {d: int(d >= 1000) for d, _ in clean + toxic}
    left = toxicity.without_toxic(docs, labels)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == sorted(d for d, _ in clean)


def test_fixed_phrases_count_in_full_and_copies_once(spark):
    clean = [(i, f"plain words number {i} blorp{i} some of them are said again") for i in range(150)]
    phrase = [(1000 + i, f"plain words w{i} number {i} and you muppet there v{i}") for i in range(60)]
    copies = [(2000 + i, "plain words with quellish flurn and so on") for i in range(60)]
    rows = clean + phrase + copies
    labels = spark.createDataFrame([(d, int(d >= 1000)) for d, _ in rows], "doc_id long, toxic int")
    stems, _ = toxicity.learn(documents(spark, rows), labels)
    assert any(s.startswith("mupp") for s in stems) and not any(s.startswith(("quel", "flur")) for s in stems)


def test_odd_rows_and_no_labels(spark):
    docs = documents(spark, odd_texts())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(None, 1), (1, None), (2, 1), (2, 0)], "doc_id long, toxic int")
    for labels in (none, odd):
        got = toxicity.toxicity(docs, labels).collect()
        assert len(got) == len(odd_texts()) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.toxicity(documents(spark, []), none).count() == 0
