"""Occurrences of any number of words in one pass over a text, without Python.

The words' prefix tree is written as one pattern that the JVM's matcher walks from
each place: a letter per edge, wide branchings halved by ranges of code points, so
that a place costs a few comparisons however many words there are. A text is cut
where a word starts; what words start there is then asked of those places alone.
Batch and stream alike.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: List length up to which plain searches first set clean texts aside; branches that are tried one by one; entries gathered before they are set aside.
FEW, BRANCHES, GATHERED = 64, 4, 1024


def letter(c: str) -> str:
    """A letter as the pattern spells it, in one character where it can be: a plan holds the pattern as often as it is printed or sent."""
    return c if c.isascii() and c.isalnum() else f"\\x{{{ord(c):x}}}"


@lru_cache(maxsize=64)
def word_pattern(words: tuple[str, ...]) -> str:
    """A pattern for the longest word at a place; empty words match nothing, and an empty list never matches."""
    children, ends = [{}], [False]
    for word in words:
        node = 0
        for c in word:
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
                ends.append(False)
            node = children[node][c]
        ends[node] = node > 0
    order = [0]
    for node in order:
        order.extend(children[node].values())
    written = [""] * len(children)

    def branches(kids: list[tuple[str, int]]) -> str:
        if len(kids) <= BRANCHES:
            return "|".join(letter(c) + written[kid] for c, kid in kids)
        half = len(kids) // 2
        return f"(?=[{letter(kids[0][0])}-{letter(kids[half - 1][0])}])(?:{branches(kids[:half])})|(?:{branches(kids[half:])})"

    for node in reversed(order):
        kids = sorted(children[node].items())
        if kids:
            alone = len(kids) == 1 and not ends[node]
            written[node] = branches(kids) if alone else f"(?:{branches(kids)}){'?' if ends[node] else ''}"
    return written[0] or "(?!)"


def contains_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w)) if w else out
    return out


def has_word(text: Column, words: list[str]) -> Column:
    """Whether a text holds any of the words; a null text does not."""
    found = contains_any(text, words) if len(words) <= FEW else F.rlike(text, F.lit(word_pattern(tuple(words))))
    return F.coalesce(found, F.lit(False))


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, wherever the optimizer moves the expression."""
    return F.transform(F.array(value), body)[0]


def gathered(items: Column, state: Column, step) -> Column:
    """A list made from left to right: ``step(state, item)`` gives the next state and an entry.

    Entries are kept in lists of GATHERED, so that a long list is not copied at
    each entry.
    """
    entry = lambda s, x: step(s, x)[1]
    kind = F.slice(F.transform(items, lambda x: entry(state, x)), 1, 0)
    first = F.struct(state.alias("state"), kind.alias("some"), F.slice(F.array(kind), 1, 0).alias("all"))

    def one(acc: Column, x: Column) -> Column:
        more = F.concat(acc["some"], F.array(entry(acc["state"], x)))
        full = F.size(acc["some"]) + 1 >= GATHERED
        return F.struct(step(acc["state"], x)[0].alias("state"), F.when(full, kind).otherwise(more).alias("some"),
                        F.when(full, F.concat(acc["all"], F.array(more))).otherwise(acc["all"]).alias("all"))

    return F.aggregate(items, first, one, lambda acc: F.concat(F.flatten(acc["all"]), acc["some"]))


def pieces(text: Column, words: list[str], group: int = 0) -> Column:
    """A text cut before each place where a word starts; the first piece starts the text. Texts without a word have none.

    With ``group`` 1, the longest word at each piece's start instead.
    """
    word = word_pattern(tuple(words))
    cut = F.regexp_extract_all(text, F.lit(f"(?s)(?=({word})?).(?:(?!{word}).)*+"), F.lit(group))
    return F.when(has_word(text, words), cut).otherwise(F.array().cast("array<string>"))


def reach(words: list[str]) -> int:
    return max((len(w) for w in words), default=0)


def ahead(own: Column, i: Column, words: list[str]) -> Column:
    """The text from a piece on, as far as a word may reach."""
    return F.substring(F.array_join(F.slice(own, i + 1, F.lit(max(reach(words), 1))), ""), 1, reach(words))


def occurrences(df: DataFrame, words: list[str], text: str, keep: list[str]) -> DataFrame:
    """(keep, keyword, start, end, index) of all occurrences of all words, overlaps included, ends inclusive.

    ``index`` is the word's place in the list; repeated words count once each. A
    place where a word starts is looked up in the list by each length that words
    have. The list is what is broadcast, as it came from the driver: a small file
    of texts may hold many more places than words.
    """
    spark = df.sparkSession
    listed = [(w, i) for i, w in enumerate(words) if w]
    sizes = sorted({len(w) for w, _ in listed}) or [1]
    names = spark.createDataFrame(listed, "keyword string, index int")

    def places(own: Column) -> Column:
        starts = gathered(own, F.lit(0), lambda at, p: (at + F.length(p), at))
        return let(starts, lambda at: F.transform(at, lambda s, i: F.struct(s.alias("start"), ahead(own, i, words).alias("ahead"))))

    # outer, so that no condition on the list is moved below and worked out twice
    found = df.select(*keep, F.explode_outer(let(pieces(F.col(text), words), places)).alias("p")).filter("p IS NOT NULL")
    tried = found.select(*keep, "p.start", "p.ahead", F.explode(F.array(*map(F.lit, sizes))).alias("size")).filter("length(ahead) >= size")
    tried = tried.withColumn("keyword", F.substr("ahead", F.lit(1), F.col("size")))
    return tried.join(F.broadcast(names), "keyword").select(*keep, "keyword", "start", (F.col("start") + F.col("size") - 1).alias("end"), "index")


def masked(text: Column, words: list[str], mark: str = "*") -> Column:
    """The text with every character of every occurrence replaced; a null text stays null.

    A piece is covered from its start as far as the longest word there reaches, or
    as words that started before it do.
    """
    sized = F.zip_with(pieces(text, words), pieces(text, words, 1), lambda p, hit: F.struct(p.alias("p"), F.length(p).alias("n"), F.length(hit).alias("hit")))

    def cover(own: Column) -> Column:
        def step(carry: Column, x: Column) -> tuple[Column, Column]:
            covered = F.greatest(carry, x["hit"])
            stars = F.least(covered, x["n"])
            return F.greatest(covered - x["n"], F.lit(0)), F.concat(F.repeat(F.lit(mark), stars), F.substr(x["p"], stars + 1, x["n"]))

        return F.array_join(gathered(own, F.lit(0), step), "")

    return F.when(has_word(text, words), let(sized, cover)).otherwise(text)
