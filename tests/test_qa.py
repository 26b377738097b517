from pyspark.sql import functions as F

from evidentia.functions import text as X
from evidentia.operators import facts as O
from evidentia.operators import qa as Q

A = ("Net sales for fiscal 2024 were 2,345,600, against 1,987,000 in fiscal\n2023. Cost of sales was 812,300 in fiscal 2024.\n"
     "Depreciation expense was 51,200 in fiscal 2024 and 48,900 in fiscal 2023.")
B = "One customer made up 37 percent of orders during fiscal 2024, compared with 29 percent in fiscal 2023."
QUESTIONS = [  # ord, category, text, answer, source, trap
    (1, "answerable", "What were net sales in fiscal 2024?", "2,345,600", "A", None),
    (2, "answerable", "What was depreciation expense in fiscal 2023?", "48,900", "A", None),
    (3, "trap", "What were net sales in fiscal 2023?", "1,987,000", "A", "2,345,600"),
    (4, "trap", "What share of orders in fiscal 2023?", "29", "B", "37"),
    (5, "unanswerable", "What was operating income in fiscal 2024?", None, None, None),
    (6, "stale", "What were net sales in fiscal 2025?", None, None, "2,345,600"),
]


def graded(spark):
    suite = spark.createDataFrame([("S", *q[:4], *q[4:], "") for q in QUESTIONS],
                                  "ticker string, ord int, category string, text string, answer string, correct_source string, trap_value string, note string")
    docs = spark.createDataFrame([("S", 0, "A", A), ("S", 1, "B", B)], "ticker string, doc_order int, doc_id string, text string")
    return suite, docs, Q.grade(Q.answer_all(Q.lookup(suite, docs)))


def test_answerers_separate(spark):
    suite, docs, g = graded(spark)
    acc = {r.answerer: r.accuracy for r in Q.score(g).filter("category IS NULL").collect()}
    assert acc["careful"] == acc["uncited"] == 1.0 and acc["over-refuser"] == round(2 / 6, 4)
    assert acc["eager"] == round(4 / 6, 4) and acc["year-blind"] < acc["careful"]
    s = Q.separation(g).first()
    assert s.best == "careful" and s.worst == "year-blind"  # the earlier of two equal ones
    fail = {(r.answerer, r.ord): r.failure for r in g.collect()}
    assert fail[("year-blind", 3)] == "took the trap value" and fail[("over-refuser", 1)] == "refused an answerable question"
    assert fail[("eager", 6)] == "answered an unanswerable question" and fail[("careful", 5)] == ""
    assert not any(r.citation_correct for r in g.filter("answerer = 'uncited' AND category = 'answerable'").collect())
    a = Q.suite_audit(suite, docs).first()
    assert (a.answer_not_shown, a.answer_to_unanswerable, a.trap_not_shown) == (0, 0, 0)


def test_recorded_replies_default_to_empty(spark):
    suite, docs, _ = graded(spark)
    looked = Q.lookup(suite, docs)
    replies = spark.createDataFrame([("S", 1, "2,345,600 [A]"), ("S", 5, "It is not stated, but 9,999.")], "ticker string, ord int, reply string")
    g = {r.ord: r for r in Q.grade(Q.attach_replies(looked, replies, "m")).collect()}
    assert g[1].ok and g[2].answer == "" and g[2].failure == "wrong or missing value"
    assert g[5].fabricated == ["9999"] and g[5].failure == "did not refuse cleanly"


def test_citation_id_is_not_a_number(spark):
    r = spark.createDataFrame([("1,234.50% [ACME-2025] and -7",)], "t string").select(X.numbers(F.col("t")).alias("n"), X.cites(F.col("t")).alias("c")).first()
    assert r.n == ["1234.50", "-7"] and r.c == ["ACME-2025"]


def test_figures_go_to_the_nearest_year(spark):
    got = lambda s: {x.year: x.figure for x in spark.createDataFrame([(s,)], "s string").select(X.figures_by_year(F.col("s")).alias("f")).first().f}
    assert got("It was 141,200 in fiscal 2024 and 128,900 in fiscal 2023.") == {2024: "141,200", 2023: "128,900"}
    assert got("Sales for fiscal 2025 were 416,161.") == {2025: "416,161"}
    assert got("No year here, 12 only.") == {}
    assert got("In fiscal 2024, 5 of 7 sites.") == {2024: "5"}


def test_line_wrap_terms_and_year(spark):
    r = spark.createDataFrame([("What was ACME's cost of revenue in FY 2023?", "a b in fiscal\n2023. Next  one.")], "q string, t string").select(
        X.terms(F.col("q")).alias("terms"), X.year_of(F.col("q")).alias("y"), X.sentences(F.col("t")).alias("s")).first()
    assert r.terms == ["cost", "revenue", "fy"] and r.y == 2023 and r.s == ["a b in fiscal 2023.", "Next one."]


def test_annual_rule_and_originals(spark):
    rows = [("X", "Revenues", 100, "2023-01-01", "2023-12-31", 2023, "10-K", "2024-02-01", "a"),
            ("X", "Revenues", 110, "2023-01-01", "2023-12-31", 2023, "10-K/A", "2024-05-01", "b"),
            ("X", "Revenues", 30, "2023-10-01", "2023-12-31", 2023, "10-K", "2023-01-01", "c"),
            ("X", "Revenues", 40, "bad", "2023-12-31", 2023, "10-K", "2023-01-01", "d"),
            ("X", "Revenues", 50, "2023-01-01", "2023-12-31", None, "10-K", None, "e")]
    f = spark.createDataFrame(rows, "ticker string, tag string, val bigint, start string, end string, fy int, form string, filed string, accn string")
    assert [r.accn for r in f.filter(O.is_annual()).collect()] == ["a", "b", "e"]
    assert O.original_filing(f).first().accn == "a"
    assert [(r.fy, r.accn) for r in O.original_by_year(f).collect()] == [(2023, "a")]


def test_millions_round_half_to_even(spark):
    r = spark.createDataFrame([(1500000, 2500000, 1234567890000)], "a bigint, b bigint, c bigint").select(
        *[X.fmt_millions(F.col(k)).alias(k) for k in "abc"]).first()
    assert (r.a, r.b, r.c) == ("2", "2", "1,234,568")


def test_call_log_upper_median(spark):
    rows = [("m", x, None) for x in (0.4, 0.1, 0.9, 0.2)] + [("n", 5.0, "timeout")]
    got = {r.answerer: r for r in Q.call_log_summary(spark.createDataFrame(rows, "answerer string, latency double, error string")).collect()}
    assert got["m"].median_latency == 0.4 and got["m"].calls == 4 and got["n"].failed == 1


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_sentence_is_matched_once_for_all_its_figures(spark):
    """The plan names each match of the sentence once, so a figure costs no further match (suite_recorded)."""
    df = spark.createDataFrame([("Up 1 and 2 in fiscal 2024, 3 in fiscal 2023.",)], "s string").select(X.figures_by_year(F.col("s")).alias("f"))
    assert plan(df).count("regexp_extract_all(") == 1 and plan(df).count("split(") == 1
    assert [(x.year, x.figure) for x in df.first().f] == [(2024, "1"), (2023, "3")]


def test_labels_read_the_facts_once(spark):
    rows = [("A", t, fy, i) for i, (t, fy) in enumerate([
        ("Revenues", 2020), ("RevenueFromContractWithCustomerExcludingAssessedTax", 2020), ("RevenueFromContractWithCustomerExcludingAssessedTax", 2021),
        ("CostOfRevenue", 2020), ("CostOfGoodsAndServicesSold", 2021), ("Other", 2020), ("OperatingExpenses", 2020), ("OperatingExpenses", 2020)])]
    facts = spark.createDataFrame([*rows, (None, "Revenues", 2020, 9)], "ticker string, tag string, fy int, val int")
    got = O.label_tags(facts)
    assert got.columns == ["ticker", "label", "tag", "fy", "val"]
    assert sorted(tuple(r)[2:] for r in got.collect()) == [
        ("CostOfGoodsAndServicesSold", 2021, 4), ("OperatingExpenses", 2020, 6), ("OperatingExpenses", 2020, 7),
        ("RevenueFromContractWithCustomerExcludingAssessedTax", 2020, 1), ("RevenueFromContractWithCustomerExcludingAssessedTax", 2021, 2)]
    assert "Join" not in plan(got)
