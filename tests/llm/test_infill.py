import hashlib
import random
import re

import numpy as np
import pytest
from tests.llm.helpers import documents, odd_texts

from evidentia.llm import infill

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def brute(doc, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc, len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return doc, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def rows():
    rng = random.Random(4)
    alphabet = "ab Zé字\U0001f600\n\t<>PSM9-"
    out = [(i, "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 2, 3, 17, 200])))) for i in range(400)]
    return out + odd_texts() + [(500, "a<P>b"), (501, "<S>"), (502, "x<M"), (503, "<" * 9), (504, "z" * 70000), (505, "é" * 3000)]


@pytest.mark.parametrize("run_bytes", [64, 1 << 22])
def test_against_brute_force(spark, monkeypatch, run_bytes):
    monkeypatch.setattr(infill.runs, "__defaults__", (run_bytes,))
    df = documents(spark, rows()).repartition(3)
    got = sorted((tuple(r) for r in infill.fill_in_middle(df).collect()), key=repr)
    assert got == sorted((brute(*r) for r in rows()), key=repr)
    forms = {r[2] for r in got}
    assert forms == {"plain", "psm", "spm"}


def test_digests_and_round_trip(spark):
    got = sorted((tuple(r) for r in infill.digests(documents(spark, rows())).collect()), key=repr)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = [(*b[:5], sha(b[5]), sha(t)) for (i, t) in rows() for b in [brute(i, t)]]
    assert got == sorted(want, key=repr)


def test_wavelet_matrix_ranks():
    rng = np.random.default_rng(0)
    for n, bits in ((0, 2), (1, 1), (63, 2), (64, 3), (1000, 4)):
        symbols = rng.integers(0, 1 << bits, n).astype(np.uint8)
        matrix = infill.WaveletMatrix(symbols, bits)
        at = np.arange(n + 1)
        for s in range(1 << bits):
            assert matrix.rank(s, at).tolist() == [int((symbols[:i] == s).sum()) for i in at]


def test_own_shares_and_columns(spark):
    df = documents(spark, rows()).withColumnRenamed("doc_id", "n")
    out = infill.fill_in_middle(df.withColumnRenamed("n", "key"), key="key", cut=100, spm=100).collect()
    assert len(out) == len(rows()) and {r["form"] for r in out} == {"plain", "spm"}
    assert infill.digests(documents(spark, [])).count() == 0
