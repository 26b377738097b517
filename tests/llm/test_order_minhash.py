import hashlib
import random

from tests.llm.helpers import documents, odd_texts

from evidentia.llm import order_minhash


def brute_numbers(text, k=6):
    """Equality pattern of numbered k-mers, from their text."""
    k = min(k, len(text)) or 1
    seen, out = {}, []
    for i in range(len(text) - k + 1 if text else 0):
        m = text[i : i + k]
        out.append((m, seen.get(m, 0)))
        seen[m] = seen.get(m, 0) + 1
    return out


def test_numbers_tell_occurrences_apart():
    rng = random.Random(1)
    for text in ("", "a", "abcdef", "aaaaaaaaaa", "".join(rng.choice("ab") for _ in range(400)), "é字" * 30):
        h = order_minhash.numbered(text).tolist()
        want = brute_numbers(text)
        assert len(h) == len(want) and len(set(h)) == len(set(want)) == len(want)
    first = dict(zip(brute_numbers("abcdefxabcdef"), order_minhash.numbered("abcdefxabcdef").tolist()))
    assert first["abcdef", 0] == order_minhash.numbered("abcdef").tolist()[0] != first["abcdef", 1]


def brute_signature(text):
    """Bins, the two smallest in each, text order; hashed as the operator does."""
    import numpy as np

    h = order_minhash.numbered(text).tolist()
    out = []
    for b in range(64):
        two = sorted(sorted((x, i) for i, x in enumerate(h) if x >> 58 == b)[:2], key=lambda p: p[1])
        value = np.zeros(1, np.uint64)
        for j in range(2):
            x = two[j][0] if j < len(two) else 0
            value = order_minhash.mixed(value * order_minhash.POLY + np.uint64(x) + np.uint64(j + 1))
        out.append(max(1, int(value[0]) >> 48) if two else 0)
    return out


def test_signature_against_brute_force():
    rng = random.Random(2)
    for n in (0, 1, 5, 6, 7, 50, 1000, 9000):
        text = "".join(rng.choice("abcdefgh ") for _ in range(n))
        assert order_minhash.signature(text).tolist() == brute_signature(text)


def test_order_matters():
    rng = random.Random(3)
    half = ["".join(rng.choice("abcdefghijklmnop") for _ in range(1500)) for _ in range(2)]
    whole, turned = half[0] + half[1], half[1] + half[0]
    small = whole[:1000] + "X" + whole[1001:]
    sig = [order_minhash.signature(t) for t in (whole, small, turned)]
    assert order_minhash.likeness(sig[0], sig[1]) > 0.9 > order_minhash.likeness(sig[0], sig[2]) + 0.2


def test_rows_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i * 7 % 501, "".join(rng.choice("abc 字") for _ in range(rng.randrange(60)))) for i in range(500)] + odd_texts()
    for some in (rows, rows[:1], rows[:2], [(None, "x"), (1, None)]):
        import xxhash

        tie = lambda t: 42 if t is None else xxhash.xxh64_intdigest(t.encode(), 42)
        signed = lambda h: h - (1 << 64) if h >> 63 else h
        order = sorted(some, key=lambda r: (r[0] is not None, r[0] or 0, signed(tie(r[1]))))
        want = []
        for (doc, text), (_, after) in zip(order, order[1:] + order[:1]):
            text, after = text or "", after or ""
            half = len(text) // 2
            new = text[: len(text) - half] + after[:half]
            sig = [order_minhash.signature(t) for t in (text, new, after)]
            want.append((doc, len(text), hashlib.sha256(new.encode()).hexdigest(), sig[0].astype(">u2").tobytes().hex(), sig[1].astype(">u2").tobytes().hex(),
                         order_minhash.likeness(sig[0], sig[1]), order_minhash.likeness(sig[0], sig[2])))
        got = [tuple(r) for r in order_minhash.fingerprints(documents(spark, some).repartition(3)).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_empty_table(spark):
    assert order_minhash.fingerprints(documents(spark, [])).count() == 0
