"""Question suites over rendered documents, stand-in answerers and lexical grading."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions import text as X
from evidentia.operators.facts import recent_years
from evidentia.session import stage
from evidentia.sources.tables import METRICS

NOT_STATED = "That figure is not stated in the provided documents."
NOT_STATED_SHORT = "Not stated in the documents."
OVER_REFUSAL = "I cannot determine that from the provided documents."


# --- documents and suite ---------------------------------------------------

def render_documents(cells: DataFrame) -> DataFrame:
    """(ticker, doc_order, doc_id, fy, text) for the two years shown of each company."""
    c = recent_years(cells).select("ticker", "cells", F.posexplode(F.array("a", "b")).alias("doc_order", "fy"))
    line = F.transform(
        F.filter("cells", lambda x: x["fy"] == F.col("fy")),
        lambda x: F.concat(X.capitalise(F.element_at(F.array(*[F.lit(m) for m in METRICS]), x["pos"])),
                           F.lit(" for fiscal "), F.col("fy").cast("string"), F.lit(" was "), X.fmt_millions(x["val"]), F.lit(".")))
    head = F.concat("ticker", F.lit(" — selected financial data, fiscal "), F.col("fy").cast("string"),
                    F.lit(" (in millions of US dollars)."))
    return c.select("ticker", "doc_order", F.concat_ws("-", "ticker", F.col("fy").cast("string")).alias("doc_id"), "fy",
                    F.array_join(F.concat(F.array(head), line), "\n").alias("text"))


def build_suite(cells: DataFrame) -> DataFrame:
    """(ticker, ord, category, text, answer, correct_source, trap_value, note), seven generators in order.

    Everything a company's questions need is in its one row of cells, so the
    generators are array expressions and the suite needs no further shuffle.
    The registrant named in the last generator comes from the two smallest
    names.
    """
    first2 = cells.select("ticker").orderBy("ticker").limit(2)
    names = first2.agg(F.min("ticker").alias("t1"), F.max("ticker").alias("t2"))
    c = recent_years(cells).join(F.broadcast(names))
    tic, a, b = F.col("ticker"), F.col("a"), F.col("b")
    metric = lambda pos: F.element_at(F.array(*[F.lit(m) for m in METRICS]), pos)
    ask = lambda who, what, fy: F.concat(F.lit("What was "), who, F.lit("'s "), what, F.lit(" in fiscal "), fy.cast("string"), F.lit("?"))
    doc = lambda fy: F.concat_ws("-", tic, fy.cast("string"))
    none = F.lit(None).cast("string")

    def q(ord_, category, text, answer=none, source=none, trap=none, note=F.lit("")):
        return F.struct(ord_.alias("ord"), F.lit(category).alias("category"), text.alias("text"), answer.alias("answer"),
                        source.alias("correct_source"), trap.alias("trap_value"), note.alias("note"))

    reported = F.array_sort(F.array_distinct(F.col("cells.pos")))
    c = c.withColumn("rep", reported)
    rep = F.col("rep")
    missing = F.array_except(F.array(*[F.lit(k + 1) for k in range(len(METRICS))]), rep)
    at = lambda pos, fy: F.get(F.filter("cells", lambda x: (x["pos"] == pos) & (x["fy"] == fy)), F.lit(0))
    lead = F.get(rep, F.lit(0))
    other = F.when(tic == F.col("t1"), F.when(F.col("t2") != F.col("t1"), F.col("t2"))).otherwise(F.col("t1"))

    answerable = F.transform(F.filter("cells", lambda x: x["fy"] == b), lambda x: q(
        F.lit(100) + x["pos"], "answerable", ask(tic, metric(x["pos"]), b), X.fmt_millions(x["val"]), doc(b),
        note=F.concat(x["tag"], F.lit(", accession "), x["accn"])))
    absent = F.transform(missing, lambda p: q(F.lit(200) + p, "unanswerable", ask(tic, metric(p), b), note=F.lit("never tagged")))
    fixed = F.array_compact(F.array(
        F.when(F.size(rep) > 0, q(F.lit(300), "unanswerable", ask(tic, metric(lead), b + 1), note=F.lit("year after"))),
        F.when(F.size(rep) > 0, q(F.lit(400), "unanswerable", ask(tic, metric(lead), a - 1), note=F.lit("year before"))),
        F.when(F.array_contains(rep, 1) & F.array_contains(rep, 2),
               q(F.lit(500), "unanswerable", ask(tic, F.lit("gross margin percentage"), b), note=F.lit("derivable, not stated")))))
    traps = F.transform(
        F.filter(F.slice(rep, 1, 2), lambda p: at(p, a).isNotNull() & at(p, b).isNotNull()),
        lambda p: q(F.lit(600) + p, "trap", ask(tic, metric(p), b), X.fmt_millions(at(p, b)["val"]), doc(b),
                    X.fmt_millions(at(p, a)["val"]), F.lit("adjacent year")))
    stranger = F.array_compact(F.array(F.when(
        other.isNotNull() & (F.size(rep) > 0),
        q(F.lit(700), "unanswerable", ask(other, metric(lead), b), note=F.lit("other registrant")))))
    return c.select("ticker", F.explode(F.concat(answerable, absent, fixed, traps, stranger)).alias("q")).select("ticker", "q.*")


def number_in_order(df: DataFrame, order: list[str], fmt: str = "R%03d", name: str = "qid") -> DataFrame:
    """Consecutive ids over a total order, without gathering the rows.

    Rows are range-sorted and written once with their place inside their
    partition; partition sizes, one row each, give the offsets.
    """
    local = stage(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()), "numbered")
    part, at = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    sizes = local.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_p", before.alias("_o"))
    return (local.withColumn("_p", part).withColumn("_at", at).join(F.broadcast(offsets), "_p")
            .withColumn(name, F.format_string(fmt, F.col("_o") + F.col("_at"))).drop("_m", "_p", "_at", "_o"))


def suite_stats(suite: DataFrame, documents: DataFrame) -> DataFrame:
    n_docs = documents.agg(F.count_distinct("doc_id").alias("n_sources"))
    return suite.groupBy("category").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(n_docs))


def suite_audit(suite: DataFrame, documents: DataFrame) -> DataFrame:
    """Counts of questions breaking a rule of the suite: all should be zero."""
    texts = documents.groupBy("ticker").agg(F.array_join(F.collect_list("text"), "\n").alias("shown"))
    j = suite.join(texts, "ticker")
    needs = F.col("category").isin("answerable", "trap")
    bad = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return j.agg(
        F.count(F.lit(1)).alias("n"),
        bad(needs & ~F.coalesce(F.contains("shown", "answer"), F.lit(False))).alias("answer_not_shown"),
        bad(~needs & F.col("answer").isNotNull()).alias("answer_to_unanswerable"),
        bad(F.col("trap_value").isNotNull() & ~F.contains("shown", "trap_value")).alias("trap_not_shown"))


def render_prompt(suite: DataFrame, documents: DataFrame) -> DataFrame:
    """The documents a question shows, then the question; two documents per company."""
    block = F.concat(F.lit("--- DOCUMENT "), F.col("doc_id"), F.lit(" ---\n"), F.trim("text"))
    shown = documents.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("doc_order", block.alias("block")))).alias("d"))
    return suite.join(shown, "ticker").select(
        "ticker", "ord", F.concat(F.array_join(F.col("d.block"), "\n\n"), F.lit("\n\n--- QUESTION ---\n"), F.col("text")).alias("prompt"))


# --- reading the documents -------------------------------------------------

def document_figures(documents: DataFrame) -> DataFrame:
    """(ticker, doc_order, sent_no, doc_id, low, year, figure): every dated figure of every sentence."""
    s = documents.select("ticker", "doc_order", "doc_id", F.posexplode(X.sentences(F.col("text"))).alias("sent_no", "sentence"))
    f = s.select("ticker", "doc_order", "doc_id", "sent_no", F.lower("sentence").alias("low"),
                 F.explode(X.figures_by_year(F.col("sentence"))).alias("f"))
    return f.select("ticker", "doc_order", "doc_id", "sent_no", "low", "f.year", F.rtrim(F.col("f.figure"), F.lit(",")).alias("figure"))


def company_reading(documents: DataFrame) -> DataFrame:
    """Per company, in one row: all numbers shown, the latest year mentioned, the first long run of digits and its document, all dated figures.

    A company shows two documents, which bounds the lists.
    """
    mention = F.regexp_extract_all("text", F.lit(r"(?i)fiscal\s+([0-9]{4})"), F.lit(1))
    run = F.nullif(F.regexp_extract("text", "([0-9,]{4,})", 1), F.lit(""))
    stated = F.transform(X.sentences(F.col("text")), lambda s, i: F.transform(X.figures_by_year(s), lambda f: F.struct(
        F.col("doc_order").alias("doc_order"), i.alias("sent_no"), F.lower(s).alias("low"), f["year"].alias("year"),
        F.rtrim(f["figure"], F.lit(",")).alias("v"), F.col("doc_id").alias("d"))))
    return documents.groupBy("ticker").agg(
        F.array_distinct(F.flatten(F.collect_list(X.numbers(F.col("text"))))).alias("source_numbers"),
        F.max(F.array_max(F.transform(mention, lambda y: y.cast("int")))).alias("latest"),
        F.min_by(F.when(run.isNotNull(), F.struct(run.alias("v"), F.col("doc_id").alias("d"))),
                 F.when(run.isNotNull(), F.col("doc_order"))).alias("first_number"),
        F.flatten(F.collect_list(F.flatten(stated))).alias("figures"))


def lookup(suite: DataFrame, documents: DataFrame) -> DataFrame:
    """Suite rows with ``asked`` and ``blind``: the figure the documents state for the asked and for the latest year.

    A sentence must hold the last term; among those the one sharing most terms
    wins, then the earlier document, sentence and figure. A question meets all
    figures of its company in one row, so the suite is joined once.
    """
    q = suite.withColumnRenamed("answer", "answer_key").withColumn("terms", X.terms(F.col("text"))).withColumn("year", X.year_of(F.col("text")))
    j = q.join(company_reading(documents), "ticker")
    last = F.try_element_at("terms", F.lit(-1))

    def stated(year: Column) -> Column:
        fits = F.filter("figures", lambda f: F.contains(f["low"], last) & (f["year"] == year))
        shared = lambda f: F.size(F.filter("terms", lambda t: F.contains(f["low"], t)))
        ranked = F.transform(fits, lambda f, i: F.struct(shared(f), -f["doc_order"], -f["sent_no"], -i, f["v"].alias("v"), f["d"].alias("d")))
        return X.bound(F.array_max(ranked), lambda best: F.when(
            (F.size("terms") > 0) & best.isNotNull(), F.struct(best["v"].alias("v"), best["d"].alias("d"))))

    return j.withColumn("asked", stated(F.col("year"))).withColumn("blind", stated(F.col("latest"))).drop("figures")


# --- answerers -------------------------------------------------------------

def _cited(hit: Column) -> Column:
    return F.concat(hit["v"], F.lit(" ["), hit["d"], F.lit("]"))


def careful() -> Column:
    return F.coalesce(_cited(F.col("asked")), F.lit(NOT_STATED))


def eager() -> Column:
    return F.coalesce(_cited(F.col("asked")), _cited(F.col("first_number")), F.lit("0 [A]"))


def year_blind() -> Column:
    return F.coalesce(_cited(F.col("blind")), F.lit(NOT_STATED_SHORT))


def over_refuser() -> Column:
    return F.lit(OVER_REFUSAL)


def uncited() -> Column:
    return F.coalesce(F.col("asked.v"), F.lit(NOT_STATED_SHORT))


ANSWERERS: dict[str, Callable[[], Column]] = {
    "careful": careful, "eager": eager, "year-blind": year_blind, "over-refuser": over_refuser, "uncited": uncited,
}


def answer_all(looked_up: DataFrame, answerers: dict[str, Callable[[], Column]] = ANSWERERS) -> DataFrame:
    """Every answerer over every question: one column each, then stacked, so nothing is shuffled."""
    rows = F.array(*[F.struct(F.lit(k).alias("answerer"), F.lit(i).alias("answerer_order"), fn().alias("answer"))
                     for i, (k, fn) in enumerate(answerers.items())])
    return looked_up.withColumn("a", F.explode(rows)).select(*looked_up.columns, "a.*")


def attach_replies(looked_up: DataFrame, replies: DataFrame, answerer: str) -> DataFrame:
    """Recorded replies (ticker, ord, reply) as one more answerer; a missing one is the empty answer."""
    return looked_up.join(replies, ["ticker", "ord"], "left").withColumn(
        "answer", F.coalesce("reply", F.lit(""))).drop("reply").withColumn("answerer", F.lit(answerer)).withColumn(
        "answerer_order", F.lit(len(ANSWERERS)))


# --- grading ---------------------------------------------------------------

def grade(answered: DataFrame) -> DataFrame:
    """Lexical grade of every answer, in one projection."""
    nums = X.numbers(F.col("answer"))
    g = answered.withColumn("nums", nums).withColumn("refused", X.is_refusal(F.col("answer"))).withColumn(
        "cited", X.cites(F.col("answer")))
    has = lambda c: F.coalesce(F.array_contains("nums", F.regexp_replace(c, ",", "")), F.lit(False))
    n, refused = F.size("nums"), F.col("refused")
    stated = F.col("category").isin("answerable", "trap")
    g = g.withColumn("correct_value", has("answer_key")).withColumn(
        "took_trap", has("trap_value") & ~F.col("correct_value")).withColumn(
        "fabricated", F.array_sort(F.array_except("nums", "source_numbers")))
    ok = F.when(stated, F.col("correct_value") & ~refused).otherwise(refused & (n == 0))
    failure = (
        F.when(stated & refused & ~F.col("correct_value"), "refused an answerable question")
        .when(stated & F.col("took_trap"), "took the trap value")
        .when(~stated & (n > 0) & ~refused, "answered an unanswerable question")
        .when(ok, "")
        .when(stated, "wrong or missing value").otherwise("did not refuse cleanly"))
    source = F.coalesce("correct_source", F.lit(""))
    return g.withColumn("ok", ok).withColumn("failure", failure).withColumn(
        "citation_correct", (source == "") | F.array_contains("cited", source))


def score(graded: DataFrame) -> DataFrame:
    """Accuracy, fabrication and citation rates per answerer, overall and per category (null = overall)."""
    yes = lambda c: F.sum(c.cast("int"))
    made_up = F.size("fabricated") > 0
    n = F.count(F.lit(1))
    return graded.groupingSets([["answerer"], ["answerer", "category"]], "answerer", "category").agg(
        n.alias("n"), yes(F.col("ok")).alias("ok"), yes(F.col("took_trap")).alias("traps_taken"),
        yes(made_up).alias("fabrications"), F.round(yes(F.col("ok")) / n, 4).alias("accuracy"),
        F.round(yes(made_up) / n, 4).alias("fabrication_rate"),
        F.round(yes(F.col("citation_correct")) / n, 4).alias("citation_accuracy"))


def separation(graded: DataFrame) -> DataFrame:
    """Best and worst answerer and the spread; the earlier answerer wins ties."""
    acc = graded.groupBy("answerer", "answerer_order").agg(F.round(F.avg(F.col("ok").cast("int")), 4).alias("accuracy"))
    a, o = F.col("accuracy"), F.col("answerer_order")
    return acc.agg(F.max_by("answerer", F.struct(a, -o)).alias("best"), F.min_by("answerer", F.struct(a, o)).alias("worst"),
                   F.round(F.max(a) - F.min(a), 4).alias("spread"))


def transcripts(graded: DataFrame) -> DataFrame:
    return graded.select("answerer", "ticker", "ord", F.col("text").alias("question"), "answer", "category", "ok", "failure")


def call_log_summary(calls: DataFrame, width: float = 0.1) -> DataFrame:
    """Calls, failures and exact upper median latency of (answerer, latency, error).

    Latencies are counted in bands first; the running count over the bands
    names the one holding the median, and only its values are ranked. An
    answerer with very many calls is thus never sorted as a whole.
    """
    band = F.floor(F.col("latency") / width).alias("band")
    bands = calls.groupBy("answerer", band).agg(F.count(F.lit(1)).alias("k"), F.count("error").alias("bad"))
    w = Window.partitionBy("answerer")
    below = F.coalesce(F.sum("k").over(w.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = bands.withColumn("below", below).withColumn("n", F.sum("k").over(w)).withColumn("failed", F.sum("bad").over(w))
    rank = F.floor(F.col("n") / 2)
    target = placed.filter((F.col("below") <= rank) & (rank < F.col("below") + F.col("k"))).select("answerer", "band", "below", "n", "failed")
    inside = calls.select("answerer", "latency", band).join(target, ["answerer", "band"]).groupBy(
        "answerer", "latency").agg(F.count(F.lit(1)).alias("k"), F.max("below").alias("below"), F.max("n").alias("n"), F.max("failed").alias("failed"))
    seen = F.col("below") + F.sum("k").over(w.orderBy("latency").rowsBetween(Window.unboundedPreceding, 0))
    return inside.withColumn("seen", seen).filter(F.col("seen") > F.floor(F.col("n") / 2)).groupBy("answerer").agg(
        F.max("n").alias("calls"), F.max("failed").alias("failed"), F.min("latency").alias("median_latency"))


def model_against_stubs(graded: DataFrame, model: str) -> DataFrame:
    """Accuracy of one answerer beside the best of the others (first on ties)."""
    acc = graded.groupBy("answerer", "answerer_order").agg(F.round(F.avg(F.col("ok").cast("int")), 4).alias("accuracy"))
    rest = F.col("answerer") != model
    return acc.agg(
        F.max(F.when(~rest, F.col("accuracy"))).alias("model_accuracy"),
        F.max_by(F.when(rest, F.col("answerer")), F.when(rest, F.struct("accuracy", -F.col("answerer_order")))).alias("best_stub"),
        F.max(F.when(rest, F.col("accuracy"))).alias("best_stub_accuracy"))
