"""The pipeline against a brute-force version over plain lists, and its stages' contract."""

import os
import subprocess
import sys
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tests.llm.test_simhash import brute as components
from tokenizers import Tokenizer

import corpus_pipeline
from evidentia.llm import mixing, repeats, toxicity

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def small_tables(spark, folder):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = docs.filter("doc_id < 40").withColumn("doc_id", F.col("doc_id") + 5000).withColumn("text", F.concat("text", F.lit(" one more")))
    odd = spark.createDataFrame([(9000, None, None, None, None), (9001, "", "en", "src1", 0), (9002, "you idiot moron scum", "en", None, 20)], docs.schema)
    docs.unionByName(extra).unionByName(odd).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def brute(spark, docs, labels):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    stems, weights = toxicity.learn(docs, labels)
    grammar = toxicity.Grammar(stems)
    score = lambda t: float((toxicity.features(np.array([grammar.patterns(t or "")])) @ weights)[0])
    rows = [r for r in rows if 1 / (1 + np.exp(-score(r[1]))) < toxicity.CUTOFF]
    stay = {c for _, _, c in components([r[:2] for r in rows])}
    rows = sorted(r for r in rows if r[0] in stay)
    first, cut = {}, []
    for doc, text, _ in rows:
        w = (text or "").encode().split()
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), doc)
    for doc, text, source in rows:
        spans = [m.span() for m in repeats.SPAN.finditer((text or "").encode())]
        raw = (text or "").encode()
        w = [raw[a:b] for a, b in spans]
        lost = [False] * len(w)
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < doc:
                lost[i : i + 13] = [True] * 13
        if any(lost):
            runs, now = [], None
            for (a, b), out in zip(spans, lost):
                if out:
                    now = None
                elif now is None:
                    runs.append(now := [a, b])
                else:
                    now[1] = b
            text = b" ".join(raw[a:b] for a, b in runs).decode()
        cut.append((doc, text, source))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", cut)
    sql = mixing.MIXED_SQL.replace("(size * (certain", "((certain")  # copies in place of words
    copies = {r[0]: r[4] for r in con.execute(sql).fetchall()}
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = Counter()
    for doc, text, _ in cut:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        at, k, length = 0, 0, len(ids) % 1024 or 1024
        while at < len(ids):
            out[doc, k, at, length, zlib.crc32(np.array(ids[at : at + length], "<u4").tobytes())] += copies[doc]
            at, k, length = at + length, k + 1, 1024
    return +out


def test_run_against_brute_force(spark, tmp_path):
    docs, labels = small_tables(spark, tmp_path)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(tuple(r)[:5] for r in got) == brute(spark, docs, labels)
    at = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= 1024


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    docs, _ = small_tables(spark, tmp_path)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_duplicates", "substrings", "mixing", "packing"]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0


def test_entry_points_work_without_the_text_operators(tmp_path):
    """What remains when the two folders and the pipeline are gone."""
    for name in ("__spark_entry__.py",):
        os.symlink(f"{REPO}/{name}", tmp_path / name)
    os.mkdir(tmp_path / "evidentia")
    for name in os.listdir(f"{REPO}/evidentia"):
        if name not in ("llm", "__pycache__"):
            os.symlink(f"{REPO}/evidentia/{name}", tmp_path / "evidentia" / name)
    code = (f"import sys; sys.path.insert(0, {str(tmp_path)!r}); sys.dont_write_bytecode = True\n"
            "import importlib.util; s = importlib.util.spec_from_file_location('e', sys.path[0] + '/__spark_entry__.py')\n"
            "import os; os.path.abspath = lambda p, a=os.path.abspath: a(p)\n"
            "e = importlib.util.module_from_spec(s); s.loader.exec_module(e)\n"
            "q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') or n == 'pipeline' for n in q), sorted(q)[:5]; assert set(e.oracle_sql()) <= set(q)")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, timeout=120)
