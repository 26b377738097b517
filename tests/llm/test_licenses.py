import random
import re

import duckdb
import pytest
from tests.llm.helpers import documents, odd_texts

from evidentia.llm import licenses as lic

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by\n# the Free Software Foundation"
MIT = next(t for f, _, t in lic.TEMPLATES if f == "mit" and len(t) > 100)


def low(text):
    return (text or "").translate(str.maketrans(lic.UPPER, lic.LOWER))


def brute_row(text, templates, threshold, width):
    t = low(text)
    words = WORD.findall(t)
    places = [(i, lab) for p, lab in lic.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    labels, held = set(), 0.0
    grams = lambda w: {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
    for block in re.split(r"\n[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]*\n", t):
        own, best = grams(WORD.findall(block)), {}
        for family, label, text_ in templates:
            want = grams(WORD.findall(low(text_)))
            if want and len(own & want) >= threshold * len(want) - 1e-9:
                best.setdefault(family, []).append((len(own & want) / len(want), label))
        for found in best.values():
            top = max(found)[0]
            labels |= {lab for c, lab in found if c == top}
            held = max(held, top)
    base = {lab for _, lab in places}
    return (len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted(base)),
            ",".join(sorted(base | labels)), 1.0 if places else held)


def rows():
    rng = random.Random(8)
    vocabulary = [w for _, _, t in lic.TEMPLATES for w in WORD.findall(low(t))] + ["mit license", "cc by", "Apache  License", "gnu general public license", "字é", "\n\n", "\n * \n"]
    out = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60)))) for i in range(150)]
    for i in range(150):
        words = rng.choice(lic.TEMPLATES)[2].split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "changed"
        around = " ".join(rng.choice("abcdef") * 3 for _ in range(rng.randrange(400)))
        out.append((200 + i, f"{around}\n{' '.join(words).upper()}\n\n{around}"))
    return out + odd_texts() + [(400, GPL), (401, MIT.replace(" ", "\n")), (402, "mit license " * 3), (403, "mit licenses; submit license; accc by"), (404, "cc\n\nby")]


@pytest.mark.parametrize("threshold, width", [(0.8, 2), (0.5, 1), (1.0, 3)])
def test_against_brute_force(spark, threshold, width):
    got = sorted((tuple(r) for r in lic.scanned(documents(spark, rows()).repartition(3), None, threshold, width).collect()), key=repr)
    assert got == sorted(((i, *brute_row(t, lic.TEMPLATES, threshold, width)) for i, t in rows()), key=repr)


def test_against_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows())
    cols = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    got = sorted((tuple(r[c] for c in cols) for r in lic.scanned(documents(spark, rows())).collect()), key=repr)
    assert got == sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({lic.oracle()})").fetchall(), key=repr)


def test_notices_and_families(spark):
    text = f"one two\nthree\n\n  ** \n{GPL}\n\nReleased under the MIT License."
    got = {(r["block"], r["first"], r["label"], r["containment"]) for r in lic.notices(documents(spark, [(1, text), (2, "none")])).collect()}
    # the affero notice shares 25 of 27 pairs with the general one, and is passed over
    assert got == {(1, 3, "gpl", 1.0), (2, 3 + len(WORD.findall(low(GPL))), "mit", 1.0)}


def test_copies_hot_tokens_and_no_rows(spark):
    many = [(i % 3, "Licensed under the Apache License, Version 2.0.") for i in range(500)]
    got = lic.scanned(documents(spark, many)).collect()
    assert len(got) == 500 and {(r["labels"], r["score"]) for r in got} == {("apache,apache-2.0", 1.0)}
    assert lic.scanned(documents(spark, [])).count() == 0
    assert {r["score"] for r in lic.scanned(documents(spark, odd_texts()), templates=[("x", "x", "word")]).collect()} == {0.0}


def test_no_python_in_the_plan(spark):
    plan = lic.scanned(documents(spark, many := [(1, GPL)]).filter("doc_id > 0"))._jdf.queryExecution().toString()
    assert many and not re.search(r"Python|Pandas|Arrow", plan.split("== Physical Plan ==")[1])
