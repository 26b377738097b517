import random

import numpy as np
import xxhash
from tests.llm.helpers import documents, odd_texts, words

from evidentia.llm import simhash


def plain_fingerprint(text):
    w = [x.lower() for x in words(text)]
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4 and comp[i] != comp[j]:
                comp = [comp[j] if c == comp[i] else c for c in comp]
    least = {}
    for (doc, _), c in zip(rows, comp):
        if doc is not None:
            least[c] = min(least.get(c, doc), doc)
    return sorted(((doc, f"{fp:016x}", least.get(c)) for (doc, _), fp, c in zip(rows, fps, comp)), key=repr)


def near_copies():
    rng = random.Random(3)
    rows, doc = [], 0
    for _ in range(12):
        base = [f"{rng.choice('abcdefghij')}{rng.randrange(300)}" for _ in range(rng.randrange(150, 400))]
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = "CHANGED"
            doc += 1
            rows.append((1000 - doc, " ".join(w)))
    return rows


def test_against_brute_force(spark):
    for rows in (near_copies(), odd_texts()):
        for split in (simhash.SPLIT, 2):
            got = simhash.near_duplicates(documents(spark, rows).repartition(3), split=split).collect()
            assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_index_finds_every_link():
    rng = np.random.default_rng(1)
    for n, spread in ((1, 1), (2, 2), (700, 3), (1500, 8)):
        centres = rng.integers(0, 2**63, 5, dtype=np.uint64)
        x = rng.choice(centres, n)
        for _ in range(spread):
            x ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
        x = np.unique(np.r_[x, rng.integers(0, 2**63, n, dtype=np.uint64)])
        near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 4
        want = np.arange(len(x))
        while True:
            new = np.where(near, want[None, :], len(x)).min(axis=1)
            if (new == want).all():
                break
            want = new
        assert (simhash.joined(x) == want).all()


def test_one_of_each_group_stays(spark):
    rows = near_copies() + odd_texts()
    got = simhash.one_of_each(documents(spark, rows))
    want = {c for doc, _, c in brute(rows)}
    assert got.columns == documents(spark, rows).columns
    ids = [r["doc_id"] for r in got.collect()]
    assert ids.count(None) == 1 and sorted(i for i in ids if i is not None) == sorted(want)


def test_empty_table(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
