import math
import random
import zlib
from collections import Counter

import numpy as np
from conftest import SF
from tests.llm.helpers import documents, odd_texts, words

from evidentia.llm import suffix_tree


def base_scores(rows):
    out = lambda doc: doc is not None and zlib.crc32(str(doc).encode()) % 5 == 1
    tokens = lambda t: [w.lower() for w in words(t)] + [None]
    seen = Counter(w for doc, t in rows if not out(doc) for w in tokens(t))
    n, v = sum(seen.values()), len(seen)
    return sorted(((doc, out(doc), len(tokens(t)), sum(seen[w] > 0 for w in tokens(t)), n,
                    round(sum(math.log10((seen[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for doc, t in rows), key=repr)


def test_counts_and_base(spark, monkeypatch):
    rows = odd_texts() + [(100 + i, f"The the word{i % 7} of x{i} Ünd") for i in range(60)]
    for frequent in (suffix_tree.FREQUENT, 0.05):
        monkeypatch.setattr(suffix_tree, "FREQUENT", frequent)
        monkeypatch.setattr(suffix_tree, "SYMBOL", max(frequent, suffix_tree.SYMBOL))
        got = suffix_tree.score(documents(spark, rows).repartition(3)).collect()
        assert sorted(((*tuple(r)[:5], round(r["base_score"], 6)) for r in got), key=repr) == base_scores(rows)
        assert all(-1e6 < r["score"] <= 1e-9 for r in got), [r["score"] for r in got]


def test_held_out_texts_are_likelier_than_under_the_base(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = suffix_tree.score(docs).filter("held_out").collect()
    assert len(rows) > 100
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
    assert sum(r["score"] > r["base_score"] for r in rows) > 0.8 * len(rows)


def tree_of(spark, texts, symbols):
    coded = [np.array([suffix_tree.START, *t, suffix_tree.END], "<u2").tobytes() for t in texts]
    return suffix_tree.grown_tree(spark.createDataFrame([(c,) for c in coded], "ids binary"), suffix_tree.FIRST + symbols, sum(map(len, coded)) // 2)


def context(*symbols):
    h = np.zeros(1, np.uint64)
    for s in symbols:
        h = suffix_tree.longer(h, np.array([s]))
    return h


def test_contexts_are_kept_only_where_they_tell_something(spark):
    """After 10 always comes 11, after 5 10 always 12; the rest is even."""
    rng = random.Random(4)
    texts = []
    for _ in range(400):
        t = []
        while len(t) < 40:
            x = rng.randrange(3, 10)
            t += [x, 10, 12 if x == 5 else 11] if rng.random() < 0.3 else [x]
        texts.append(t)
    tree = tree_of(spark, texts, 10)
    assert tree.find(1, context(10))[0] > 0 and tree.find(2, context(5, 10))[0] > 0
    assert tree.find(2, context(4, 10))[0] > 0  # here 12 never follows
    assert tree.find(2, context(3, 11))[0] < 0
    assert abs(tree.chance(tree.find(2, context(5, 10)), np.array([12]))[0] - 1) < 0.05
    p = 10 ** tree.log_p([np.array([0, 5, 10, y, 1], "<u2").tobytes() for y in (12, 11)])
    assert p[0] > 20 * p[1]
    for state in range(len(tree.back_off)):
        assert abs(tree.chance(np.full(13, state), np.arange(13)).sum() - 1) < 1e-9


def test_longest_kept_suffix_is_the_state():
    p = suffix_tree.Positions([np.array([0, 7, 8, 1], "<u2").tobytes(), np.array([0, 1], "<u2").tobytes()], 2)
    by_depth = {k: (here.tolist(), h.tolist()) for k, here, h, _ in p.contexts()}
    assert p.symbol.tolist() == [7, 8, 1, 1] and p.text.tolist() == [0, 0, 0, 1]
    assert by_depth[1] == ([0, 1, 2, 3], [int(context(x)[0]) for x in (0, 7, 8, 0)])
    assert by_depth[2] == ([1, 2], [int(context(0, 7)[0]), int(context(7, 8)[0])])
    assert suffix_tree.parent(context(7, 8), np.array([7]), 2)[0] == context(8)[0]


def test_shares_of_rare_words_sum_to_one(spark):
    counts = [1] * 50 + [2] * 20 + [3] * 10 + [4] * 6 + [9] * 3 + [100000]
    shares = suffix_tree.Shares(spark.createDataFrame([(f"w{i}", n) for i, n in enumerate(counts)], "word string, n long"), 7)
    rare = np.array(counts[:-1])
    assert shares.tokens == sum(counts) + 7 and shares.kinds == len(counts) + 1
    p = (10 ** shares.log_rare(rare)).sum() + 10 ** shares.log_rare(np.array([0]))[0]
    assert 0.99 < p <= 1 + 1e-9


def test_empty_tables(spark):
    assert suffix_tree.score(documents(spark, [])).count() == 0
    only_held_out = [(d, "some text") for d in range(50) if zlib.crc32(str(d).encode()) % 5 == 1]
    got = suffix_tree.score(documents(spark, only_held_out)).collect()
    assert len(got) == len(only_held_out) and all(r["n_known"] == 0 and math.isfinite(r["score"]) for r in got)


def test_every_context_and_edge_counts(spark):
    """Scores equal those of a tree grown in plain Python from all contexts, those seen once among them; held-out texts meet unseen ones."""
    rng = random.Random(9)
    rows = [(d, " ".join(rng.choice("abcde") for _ in range(rng.randrange(9)))) for d in range(60)]
    out = lambda doc: zlib.crc32(str(doc).encode()) % 5 == 1
    texts = {d: ["<", *t.split(), ">"] for d, t in rows}
    seen = {}
    for d, t in texts.items():
        for i in range(1, len(t)):
            for k in range(min(i, 3) + 1):
                seen.setdefault(tuple(t[i - k:i]), Counter())[t[i]] += not out(d)
    alphabet = suffix_tree.FIRST + 5

    def chance(context, symbol):
        counts = +seen.get(context, Counter())
        if not context:
            n = sum(counts.values())
            return max(counts[symbol] - 0.75, 0) / n + 0.75 * len(counts) / n / alphabet
        below, n = chance(context[1:], symbol), sum(counts.values())
        gain = sum(c * math.log(c / n / chance(context[1:], s)) for s, c in counts.items())
        if not n or gain <= 0.5 * len(counts) * math.log(n + 1):
            return below
        return max(counts[symbol] - 0.75, 0) / n + 0.75 * len(counts) / n * below

    want = {d: sum(math.log10(chance(tuple(t[max(0, i - 3):i]), t[i])) for i in range(1, len(t))) for d, t in texts.items()}
    got = {r["doc_id"]: r["score"] for r in suffix_tree.score(documents(spark, rows).repartition(3)).collect()}
    assert any(out(d) for d in got) and got.keys() == want.keys()
    assert all(abs(got[d] - want[d]) < 1e-9 for d in want)


def test_a_chunk_asks_once_for_an_edge_and_any_dealing_gives_the_same_scores(spark, monkeypatch):
    """Copies of a text in a chunk ask for no more than one; scores do not depend on chunks, buckets or how a frequent suffix is dealt."""
    rng = random.Random(3)
    rows = [(d, " ".join(rng.choice("aab") for _ in range(rng.randrange(12)))) for d in range(40)] + [(d, "a b a a") for d in range(100, 140)]
    docs = documents(spark, rows).coalesce(1)
    whole = {r["doc_id"]: r["score"] for r in suffix_tree.score(docs).collect()}
    monkeypatch.setattr(suffix_tree, "SYMBOLS_AT_ONCE", 30)
    monkeypatch.setattr(suffix_tree, "BUCKET_TOKENS", 3)
    dealt = {r["doc_id"]: r["score"] for r in suffix_tree.score(docs).collect()}
    assert dealt.keys() == whole.keys() and all(abs(dealt[d] - whole[d]) < 1e-9 for d in whole)
    ids = np.array([suffix_tree.START, 3, 4, 3, 3, suffix_tree.END], "<u2").tobytes()
    dealing = suffix_tree.Dealing(3, 7, np.array([4 << 16 | 3], np.uint64), np.array([5], np.uint64))
    edge, bucket, order, at, text = dealing.kinds(ids * 9)
    assert len(edge) == len(bucket) == len(order) == 5 and len(at) == 45 and text.max() == 8
