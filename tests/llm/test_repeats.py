import hashlib
import random

import pytest
from tests.llm.helpers import documents, odd_texts, words

from evidentia.llm import repeats


def brute(rows, window):
    first = {}
    for doc, text in rows:
        w = words(text)
        for i in range(len(w) - window + 1):
            if doc is not None:
                key = tuple(w[i : i + window])
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in rows:
        w = words(text)
        lost = [False] * len(w)
        for i in range(len(w) - window + 1):
            if doc is not None and first[tuple(w[i : i + window])] < doc:
                lost[i : i + window] = [True] * window
        kept = [x for x, gone in zip(w, lost) if not gone]
        out.append((doc, len(w), sum(lost), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


def random_rows():
    rng = random.Random(5)
    passage = [" ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(30)) for _ in range(4)]
    rows = []
    for doc in range(120):
        parts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(20))) for _ in range(3)]
        if doc % 3 == 0:
            parts.insert(1, rng.choice(passage))
        rows.append((rng.randrange(100), "\n".join(parts)))
    return rows


@pytest.mark.parametrize("window", [1, 3, 13])
def test_against_brute_force(spark, monkeypatch, window):
    monkeypatch.setattr(repeats, "BUCKET_WINDOWS", 300)
    for rows in (random_rows(), odd_texts()):
        got = sorted((tuple(r) for r in repeats.digest(documents(spark, rows).repartition(3), window).collect()), key=repr)
        assert got == brute(rows, window)


def test_empty_table(spark):
    assert repeats.digest(documents(spark, [])).count() == 0
    assert repeats.without_repeats(documents(spark, [])).count() == 0


def test_kept_text_keeps_its_white_space(spark):
    passage = " ".join(f"p{i}" for i in range(15))
    rows = [(1, passage), (2, f"one\n two {passage}  three\tfour"), (3, " as  it\nwas "), (4, None), (5, passage)]
    out = {r["doc_id"]: r for r in repeats.without_repeats(documents(spark, rows)).collect()}
    assert [out[i]["text"] for i in range(1, 6)] == [passage, "one\n two three\tfour", " as  it\nwas ", None, ""]
    assert [out[i]["n_chars"] for i in range(1, 6)] == [len(passage), 19, 12, None, 0]
    assert out[1].asDict().keys() == documents(spark, rows).first().asDict().keys()


def test_packed_hashes_come_back():
    import numpy as np

    for h in (np.array([0, 1, 2**63, 2**64 - 1], np.uint64), np.array([7], np.uint64), np.arange(0, 10**6, 1000, dtype=np.uint64)):
        assert (repeats.unpack_sorted(repeats.pack_sorted(h)) == h).all()
