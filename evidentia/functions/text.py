"""Text functions as Column expressions: numbers, citations, sentences, rendering."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wording and patterns that decide a grade.
REFUSAL_PHRASES = [
    "not stated", "not provided", "does not", "cannot", "can't", "no information", "not available", "not disclosed",
    "not in the", "unable to", "not mentioned", "insufficient", "not specified", "i don't have", "do not have",
]
STOP_WORDS = [
    "what", "was", "were", "the", "a", "an", "in", "of", "for", "is", "are", "did", "does", "have", "has", "had",
    "how", "much", "many", "that", "this", "there", "they", "company", "companys", "fiscal", "year", "during", "from",
    "came", "end", "total", "and", "per", "its", "their", "at", "as", "by", "with", "s", "today", "current",
    "currently",
]
CITATION = r"\[([A-Za-z0-9_\-]+)\]"
NUMBER = r"-?[0-9][0-9,]*(?:\.[0-9]+)?%?"
FIGURE_OR_MENTION = r"(?i)fiscal\s+[0-9]{4}[0-9,]*(?:\.[0-9]+)?|[0-9][0-9,]*(?:\.[0-9]+)?"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it; a lambda's body repeats whatever stands in it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sha16(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def fingerprint(url: Column, body: Column) -> Column:
    """Identity of a request: hash over its JSON with sorted keys; a missing body is null."""
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    return sha16(F.concat(F.lit('{"body": '), F.coalesce(quoted(body), F.lit("null")), F.lit(', "url": '), quoted(url), F.lit("}")))


def text_slice(text: Column, start: Column, end: Column) -> Column:
    """Characters [start, end), counted from zero."""
    return F.substring(text, start + 1, end - start)


def strip_citations(text: Column) -> Column:
    return F.regexp_replace(text, CITATION, " ")


def numbers(text: Column) -> Column:
    """Distinct numbers of a text, without separators and percent signs; citations are not read."""
    found = _all(strip_citations(text), NUMBER)
    return F.array_distinct(F.transform(found, lambda m: F.regexp_replace(F.regexp_replace(m, "%+$", ""), ",", "")))


def cites(text: Column) -> Column:
    return F.array_sort(F.array_distinct(_all(text, CITATION, 1)))


def is_refusal(answer: Column) -> Column:
    low = F.lower(answer)
    out = F.lit(False)
    for p in REFUSAL_PHRASES:
        out = out | F.contains(low, F.lit(p))
    return out


def year_of(question: Column) -> Column:
    found = F.regexp_extract(question, r"(?i)(?:fiscal|FY)\s*([0-9]{4})", 1)
    return F.nullif(found, F.lit("")).try_cast("int")


def terms(question: Column) -> Column:
    """Content words naming the metric asked about."""
    cut = F.locate("'s ", question)
    body = F.when(cut > 0, F.substring(question, cut + 3, F.length(question))).otherwise(question)
    body = F.regexp_replace(body, r"(?i)\bin fiscal\s+[0-9]{4}\b", " ")
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(_all(F.lower(body), "[a-z&]+"), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w))


def sentences(text: Column) -> Column:
    """Sentences after line wrapping has been undone."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.filter(F.split(flat, r"(?<=\.)\s+"), lambda s: s != "")


def figures_by_year(sentence: Column) -> Column:
    """array<struct(year, figure)>: each figure goes to the fiscal year mentioned nearest to it.

    Mentions and figures are matched in one pass; lengths of the matches and of
    the text between them give the positions. Earlier mentions win ties and the
    first figure of a year is kept. The arrays are per sentence.
    """
    found, between = _all(sentence, FIGURE_OR_MENTION), F.split(sentence, FIGURE_OR_MENTION)
    size = lambda parts: F.aggregate(parts, F.lit(0), lambda a, x: a + F.length(x))
    placed = lambda s: F.transform(s["found"], lambda m, i: F.struct(
        (size(F.slice(s["between"], 1, i + 1)) + size(F.slice(s["found"], 1, i))).alias("at"), m.alias("m"),
        F.nullif(F.regexp_extract(m, r"(?i)^fiscal\s+([0-9]{4})", 1), F.lit("")).cast("int").alias("y")))
    split = lambda p: F.struct(
        F.filter(p, lambda t: t["y"].isNotNull()).alias("mentions"), F.filter(p, lambda t: t["y"].isNull()).alias("figures"))
    assigned = lambda p: F.transform(p["figures"], lambda f: F.struct(
        F.array_min(F.transform(p["mentions"], lambda t, i: F.struct(F.abs(f["at"] - t["at"]).alias("gap"), i.alias("i"), t["y"].alias("y"))))["y"].alias("year"),
        f["m"].alias("figure")))
    first = lambda kept: F.filter(kept, lambda x, i: ~F.exists(F.slice(kept, 1, i), lambda e: e["year"] == x["year"]))
    parts = bound(F.struct(found.alias("found"), between.alias("between")), placed)
    return bound(F.filter(bound(bound(parts, split), assigned), lambda x: x["year"].isNotNull()), first)


def fmt_millions(value: Column) -> Column:
    """Millions with thousands separators, halves to even."""
    return F.format_number(F.bround(value.cast("decimal(38,6)") / F.lit(1000000).cast("decimal(10,0)"), 0), 0)


def capitalise(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, F.lit(2), F.length(text))))
