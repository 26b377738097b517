import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tests.llm.helpers import documents, odd_texts
from tokenizers import Tokenizer

from evidentia.llm import packing


def test_pieces_are_the_tokenizers_and_fill_sequences_without_gaps(spark):
    rng = random.Random(2)
    rows = odd_texts() + [(100 + i, " ".join(rng.choice(["the", "moin", "été", "x y"]) for _ in range(rng.randrange(1, 700)))) for i in range(200)]
    rows.append((999, "a <|endoftext|> b  c\n\n d"))
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for doc, text in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        k = -(-len(ids) // 1024)
        cuts = [0] + [len(ids) - 1024 * (k - 1 - i) for i in range(k)]
        for i in range(k):
            own = ids[cuts[i] : cuts[i + 1]]
            want[doc, i, cuts[i], len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    got = packing.pack(documents(spark, rows).repartition(4)).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r["length"] for r in got)
    assert len(sequences) <= -(-total // 1024) + 2


def test_plan_uses_every_piece_once():
    rng = random.Random(7)
    for capacity in (8, 64, 1024):
        for _ in range(8):
            counts = Counter(rng.randrange(1, capacity + 1) for _ in range(rng.choice([0, 1, 30, 3000])))
            used = Counter()
            for lengths, m in packing.plan(dict(counts), capacity):
                assert sum(lengths) <= capacity and m > 0
                for x in lengths:
                    used[x] += m
            assert used == counts


def test_two_dominant_lengths_fill_open_sequences():
    for counts, best in (({600: 100, 100: 1000}, 160), ({600: 10, 130: 35}, 11)):
        planned = packing.plan(counts, 1024)
        used = Counter()
        for lengths, m in planned:
            assert sum(lengths) <= 1024 and m > 0
            for x in lengths:
                used[x] += m
        assert used == counts and sum(m for _, m in planned) == best


def test_exact_complements_come_first():
    planned = packing.plan({700: 3, 324: 3, 500: 2, 300: 2, 224: 2, 400: 1, 200: 2, 424: 0, 24: 0}, 1024)
    filled = [lengths for lengths, _ in planned if sum(lengths) == 1024]
    assert (700, 324) in filled and any(len(x) == 3 for x in filled)


def test_many_pieces_of_one_length_are_numbered_in_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 20)
    got = packing.pack(documents(spark, [(i, "same text") for i in range(300)])).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == 300


def test_empty_table(spark):
    assert packing.pack(documents(spark, [])).count() == 0
