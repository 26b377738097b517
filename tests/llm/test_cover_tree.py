import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import cover_tree as ct


def brute(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error, label_error, digest) by comparing every part with every entry in plain whole numbers."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    own = width // parts
    whole = [[math.floor(4096 * x) for x in v] + [0] * (width - len(v)) for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))
    cut = lambda x, p: x[p * own : (p + 1) * own]
    books = [[cut(whole[k], p) for k in order[:entries]] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda x, p: min(range(len(books[p])), key=lambda e: (gap(cut(x, p), books[p][e]), e))
    for _ in range(rounds):
        codes = [[nearest(x, p) for p in range(parts)] for x in whole]
        for p in range(parts):
            for e in range(len(books[p])):
                own_parts = [cut(x, p) for x, c in zip(whole, codes) if c[p] == e]
                if own_parts:
                    books[p] = books[p][:e] + [[sum(c) // len(own_parts) for c in zip(*own_parts)]] + books[p][e + 1 :]
    codes = [[nearest(x, p) for p in range(parts)] for x in whole]
    errors = [sum(gap(cut(x, p), books[p][c[p]]) for p in range(parts)) for x, c in zip(whole, codes)]
    by_label = {}
    for (_, _, lab), e in zip(kept, errors):
        by_label[lab] = by_label.get(lab, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for entry in b for x in entry).encode()).hexdigest()
    return sorted(((i, "".join(f"{c:02x}" for c in code), e, by_label[lab], digest) for (i, _, lab), code, e in zip(kept, codes, errors)), key=repr)


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for name in ("code", "error", "ids", "labels", "trees", "part", "entry", "n", "of_label"):
        df = df.withColumn(name, F.lit("x"))
    return df


def random_rows(n=700, width=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, width))
    rows = [(int(i), [float(np.float32(x)) for x in centres[i % 9] + rng.normal(scale=0.2 + 0.3 * (i % 3), size=width)], [None, 1, 2][i % 3]) for i in rng.permutation(n)]
    return rows + [rows[5], (5, rows[7][1], 1), (None, rows[9][1], None)]


def odd_rows():
    return [(1, None, 1), (2, [0.5, None] * 8, 1), (3, [float("nan")] * 16, 1), (4, [float("inf")] * 16, None), (6, [], 7), (7, [1.0], 7)]


def got(df):
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block, leaf, fan", [(4096, 24, 64), (100, 4, 5), (50, 1, 2)])
def test_against_brute_force(spark, monkeypatch, block, leaf, fan):
    monkeypatch.setattr(ct, "BLOCK", block)
    monkeypatch.setattr(ct.planted, "__defaults__", (leaf, fan))
    rows = random_rows(300) + odd_rows()
    assert got(ct.compressed(vectors(spark, rows).repartition(3))) == brute(rows)


def test_few_equal_and_no_vectors(spark):
    few = [(i, [0.1 * i] * 8, None) for i in range(5)]
    assert got(ct.compressed(vectors(spark, few))) == brute(few)
    equal = [(i, [0.25] * 8, 1) for i in range(40)]
    assert got(ct.compressed(vectors(spark, equal))) == brute(equal)
    blank = [(i, [], 1) for i in range(3)]
    assert got(ct.compressed(vectors(spark, blank))) == brute(blank)
    for none in ([], odd_rows()[:4]):
        out = ct.compressed(vectors(spark, none))
        assert out.count() == 0 and out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_tree_covers_and_separates():
    rng = np.random.default_rng(1)
    points = np.floor(rng.normal(size=(900, 3)) * 400).astype(np.int64)
    tree = ct.build(points, leaf=3, fan=10**6)
    assert (points[tree.order] == tree.points).all() and sorted(tree.order.tolist()) == list(range(900))
    for i in range(len(tree.low)):
        own = tree.points[tree.low[i] : tree.high[i]]
        assert np.sqrt(((own - own[0]) ** 2).sum(1)).max() <= tree.radius[i] + 1e-9
        kids = range(tree.below[i], tree.below[i] + tree.fan[i])
        if kids:
            centres = tree.points[tree.low[list(kids)]]
            assert (centres[0] == own[0]).all() and tree.low[kids[0]] == tree.low[i] and tree.high[kids[-1]] == tree.high[i]
            apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2))[np.triu_indices(len(centres), 1)]
            assert (apart > tree.radius[i] / 2 - 1e-9).all() and all(tree.radius[k] <= tree.radius[i] / 2 + 1e-9 for k in kids)


def test_subtrees_spare_comparisons_and_ties_go_down():
    rng = np.random.default_rng(2)
    centres = rng.integers(-9000, 9000, size=(16, 4))
    points = centres[rng.integers(0, 16, 3000)] + rng.integers(-60, 60, size=(3000, 4))
    codes, compared = ct.assign(ct.build(points), centres)
    assert compared < 300 and len(codes) == 3000
    line = np.arange(-50, 51).reshape(-1, 1) * 2
    tree = ct.build(line, leaf=2)
    entries = np.array([[10], [-10], [10]])
    assert ct.assign(tree, entries)[0].tolist() == [0 if x >= 0 else 1 for x in tree.points[:, 0]]


def test_far_components_stay_in_bounds():
    x = ct.whole_numbers([np.array([3e38, -3e38, 1.5])], 8)
    assert x[0, 2] == 6144 and 0 < x[0, 0] < 2**31 and 4 * 8 * int(x[0, 0]) ** 2 <= 2**63
