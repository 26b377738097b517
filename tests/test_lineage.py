import hashlib

import pytest
from pyspark.sql import functions as F

from evidentia.operators import lineage as K
from evidentia.plans import company_lineage as C

TEXT = "Sales came to 1,250 and outlays to 400 in FY2024."


def docs(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "doc_id string, text string")


def figure(spark, before, name, text=TEXT):
    e = K.extract(docs(spark, D1=text), before, "[0-9,]+")
    t = K.Tracked.at(F.col("value"), F.col("doc_id"), F.col("start"), F.col("end"), F.col("doc_sha"), F.lit(before))
    return e.select(F.lit("k").alias("k"), t.column().alias(name))


@pytest.fixture
def row(spark):
    made = figure(spark, "came to ", "sales").join(figure(spark, "outlays to ", "outlays"), "k")
    return spark.createDataFrame(made.collect(), made.schema)


def test_span_holds_the_digits(spark):
    r = K.extract(docs(spark, D1=TEXT), "CAME to ", "[0-9,]+").first()
    assert TEXT[r.start:r.end] == "1,250" == r.raw and r.value == 1250.0
    assert r.doc_sha == hashlib.sha256(TEXT.encode()).hexdigest()[:16]
    assert K.extract(docs(spark, D1=TEXT), "profit of ", "[0-9,]+").count() == 0
    p = K.extract_pattern(docs(spark, D1=TEXT, D2="none"), r"outlays to ([\d,]+)").collect()
    assert [(x.doc_id, x.start, x.end) for x in p] == [("D1", r.start + 21, r.start + 24)]


def test_arithmetic_keeps_spans(row):
    a, b = K.Tracked.leaf("sales"), K.Tracked.leaf("outlays")
    r = row.select(((a - b) / a).column().alias("m"), (a + a).column().alias("twice"), (2 * a + 1).column().alias("lin"),
                   (-b).column().alias("neg"), a.apply(lambda c: F.sqrt(c), "root").column().alias("root"), (b < a).alias("less"),
                   a.same_as(1250).alias("same")).first()
    assert abs(r.m.value - 850 / 1250) < 1e-12 and len(r.m.spans) == 2 and r.m.op == "div"
    assert r.twice.value == 2500 and len(r.twice.spans) == 1 and r.lin.value == 2501 and r.neg.value == -400
    assert r.root.op == "root" and len(r.root.spans) == 1 and r.less and r.same


def test_graph_and_walk(row):
    a, b = K.Tracked.leaf("sales"), K.Tracked.leaf("outlays")
    g = K.derivation_graph(row, ["k"], (a - b) / a)
    s = K.graph_stats(*g, ["k"]).first()
    assert (s.n_nodes, s.n_edges, s.depth, s.n_leaves, s.ops) == (4, 4, 2, 2, "div,extract,sub")
    walk = K.explain(*g, ["k"]).orderBy("path").collect()
    assert [(list(w.path), w.op, w.value) for w in walk] == [
        ([], "div", 0.68), ([0], "sub", 850.0), ([0, 0], "extract", 1250.0), ([0, 1], "extract", 400.0), ([1], "extract", 1250.0)]
    assert walk[0].leaf_spans is None and len(walk[2].leaf_spans) == 1
    assert K.explain(*g, ["k"], max_depth=1).count() == 3
    lines = [r.line for r in K.to_dot(g[0], g[1], ["k"]).orderBy("section").collect()]
    assert lines[0].startswith("digraph") or "digraph lineage {" in lines[:3]
    assert len(lines) == 12 and lines[-1] == "}"
    assert K.graph_stats(*K.derivation_graph(row, ["k"], a + a), ["k"]).first().n_edges == 2


def test_verification_names_the_first_problem(spark, row):
    a, b = K.Tracked.leaf("sales"), K.Tracked.leaf("outlays")
    v = row.select("k", (a - b).column().alias("tracked"))
    assert K.verify_against(v, docs(spark, D1=TEXT), ["k"]).first().ok
    changed = K.verify_against(v, docs(spark, D1=TEXT + " "), ["k"]).first()
    assert not changed.ok and changed.first_issue == "document has changed" and changed.n_checked == 2
    missing = K.verify_against(v, docs(spark, D2=TEXT), ["k"]).first()
    assert missing.first_issue == "source not supplied" and missing.n_checked == 0
    tampered = K.tamper_probe(v, docs(spark, D1=TEXT), ["k"]).first()
    assert not tampered.ok and tampered.n_problems == 2
    loose = v.withColumn("tracked", F.col("tracked").withField("spans", F.transform(
        F.col("tracked.spans"), lambda s: s.withField("end", F.lit(9999)))))
    assert K.verify_against(loose, docs(spark, D1=TEXT), ["k"]).first().first_issue == "span out of bounds"
    want = spark.createDataFrame([("D1", TEXT.index("400"), TEXT.index("400") + 3, "401")], "doc_id string, start int, end int, expected string")
    assert K.verify_against(v, docs(spark, D1=TEXT), ["k"], expected=want).first().first_issue == "text mismatch"


def concept(tag, *facts):
    body = ",".join('{"start":"%s","end":"%s","val":%s,"accn":"%s","fy":%d,"fp":"%s","form":"%s","filed":"%s"}' % f for f in facts)
    return '{"tag":"%s","units":{"USD":[%s]}}' % (tag, body)


def test_company_lineage_picks_the_original_filing(spark):
    revenue = concept(
        "Revenues", ("2022-10-01", "2023-09-30", 1000, "a-1", 2023, "FY", "10-K", "2023-11-03"),
        ("2023-10-01", "2024-09-30", 2000, "a-2", 2024, "FY", "10-K", "2024-11-01"),
        ("2023-10-01", "2024-09-30", 2100, "a-3", 2025, "FY", "10-K", "2025-11-01"),
        ("2024-07-01", "2024-09-30", 600, "a-4", 2024, "Q4", "10-Q", "2024-10-20"))
    cost = concept("CostOfRevenue", ("2023-10-01", "2024-09-30", 1500, "c-2", 2024, "FY", "10-K", "2024-11-01"))
    d = spark.createDataFrame([("X", "Revenues", "X:Revenues", revenue), ("X", "CostOfRevenue", "X:CostOfRevenue", cost)],
                              "ticker string, tag string, doc_id string, text string")
    fields = C.located_fields(d)
    at = {r.field: r.tracked for r in fields.collect()}
    s = at["revenue"].spans[0]
    assert at["revenue"].value == 2000 and revenue[s.start:s.end] == "2000" and s.start > revenue.index("a-1")
    m = {r.metric: r.tracked for r in C.derive_metrics(C.company_row(fields)).collect()}
    assert m["gross_margin"].value == 0.25 and {x.doc_id for x in m["gross_margin"].spans} == {"X:Revenues", "X:CostOfRevenue"}
    assert "rnd_intensity" not in m


def test_operands_and_depth_are_not_lost(row):
    a = K.Tracked.leaf("sales")
    s = K.graph_stats(*K.derivation_graph(row, ["k"], (a + 1) * (a + 2)), ["k"]).first()
    assert (s.n_nodes, s.n_edges, s.depth, s.n_leaves) == (4, 4, 2, 1)
    deep = a
    for i in range(9):
        deep = deep + i
    s = K.graph_stats(*K.derivation_graph(row, ["k"], deep), ["k"]).first()
    assert (s.n_nodes, s.depth) == (10, 9)
    assert K.graph_stats(*K.derivation_graph(row, ["k"], a), ["k"]).first().n_edges == 0
    assert row.select((a / (a - a)).column().alias("none")).first().none is None


def test_first_problem_is_that_of_the_first_span(spark):
    other = "Outlays came to 400."
    both = figure(spark, "came to ", "sales").join(
        K.extract(docs(spark, D2=other), "came to ", "[0-9,]+").select(F.lit("k").alias("k"), K.Tracked.at(
            F.col("value"), F.col("doc_id"), F.col("start"), F.col("end"), F.col("doc_sha")).column().alias("outlays")), "k")
    v = both.select("k", (K.Tracked.leaf("sales") - K.Tracked.leaf("outlays")).column().alias("tracked"))
    changed = docs(spark, D1=TEXT + "!")
    assert K.verify_against(v, changed, ["k"]).first().first_issue == "document has changed"
    rows = K.span_problems(v, changed, ["k"]).orderBy("span_no").collect()
    assert [(r.span_no, r.doc_id, r.issue, r.actual) for r in rows] == [
        (0, "D1", "document has changed", "1,250"), (1, "D2", "source not supplied", None)]
    assert rows[0].recorded_sha != rows[0].current_sha


def test_fractions_survive_and_tag_comes_before_year(spark):
    first = concept("RevenueFromContractWithCustomerExcludingAssessedTax", ("2024-07-01", "2024-09-30", 600, "a-4", 2024, "Q4", "10-Q", "2024-10-20"))
    second = concept("Revenues", ("2023-10-01", "2024-09-30", 2000, "a-2", 2024, "FY", "10-K", "2024-11-01"))
    cost = concept("CostOfRevenue", ("2023-10-01", "2024-09-30", "1.53", "c-2", 2024, "FY", "10-K", "2024-11-01"))
    d = spark.createDataFrame([("X", t, f"X:{t}", x) for t, x in (("RevenueFromContractWithCustomerExcludingAssessedTax", first), ("Revenues", second),
                                                                 ("CostOfRevenue", cost))], "ticker string, tag string, doc_id string, text string")
    got = {r.field: r.tracked for r in C.located_fields(d).collect()}
    assert "revenue" not in got  # the preferred tag has no annual figure
    s = got["cost"].spans[0]
    assert got["cost"].value == 1.53 and cost[s.start:s.end] == "1.53"


def test_shared_nodes_do_not_multiply(spark):
    """Twenty doublings have a million paths and twenty-one nodes."""
    nodes = spark.createDataFrame([("k", f"n{i}", "add" if i else "extract", 1.0, "", []) for i in range(21)],
                                  f"k string, node_id string, op string, value double, note string, spans array<{K.SPAN_TYPE}>")
    edges = spark.createDataFrame([("k", f"n{i}", f"n{i + 1}", p) for i in range(20) for p in (0, 1)], "k string, src string, dst string, pos int")
    roots = spark.createDataFrame([("k", "n20")], "k string, node_id string")
    s = K.graph_stats(nodes, edges, roots, ["k"]).first()
    assert (s.n_nodes, s.n_edges, s.depth, s.n_leaves) == (21, 40, 20, 1)
    assert K.explain(nodes, edges, roots, ["k"], max_depth=3).count() == 15


def test_planning_a_walk_runs_no_job(spark, row):
    a, b = K.Tracked.leaf("sales"), K.Tracked.leaf("outlays")
    g = K.derivation_graphs(row, ["k"], {"m": (a - b) / a, "s": a + b, "leaf": a})
    spark.sparkContext.setJobGroup("planning", "planning")
    walk, stats = K.explain(*g, ["k", "metric"]), K.graph_stats(*g, ["k", "metric"])
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("planning")
    spark.sparkContext.setJobGroup("after", "after")
    assert {r.metric: (r.n_nodes, r.n_edges, r.depth) for r in stats.collect()} == {"m": (4, 4, 2), "s": (3, 2, 1), "leaf": (1, 0, 0)}
    assert walk.count() == 5 + 3 + 1


@pytest.mark.parametrize("block", [1, 4096])
def test_spans_join_the_blocks_they_touch(spark, monkeypatch, block):
    monkeypatch.setattr(K, "BLOCK", block)
    text = "é🎈 one 字\n two three four five"
    places = [(0, 1), (0, len(text)), (5, 13), (3, 3), (len(text) - 1, len(text)), (2, len(text) + 5), (-2, 3)]
    span = lambda d, a, b, sha="": {"doc_id": d, "start": a, "end": b, "doc_sha": sha}
    whole = hashlib.sha256(text.encode()).hexdigest()[:16]
    rows = [("a", {"value": 1.0, "spans": [span("D", a, b, whole) for a, b in places], "op": "x", "note": ""}),
            ("b", {"value": 1.0, "spans": [span("none", 0, 3)], "op": "x", "note": ""}), ("c", {"value": 1.0, "spans": [span("empty", 0, 1), span("D", 1, 2, "old")], "op": "x", "note": ""})]
    values = spark.createDataFrame(rows, f"k string, tracked {K.TRACKED_TYPE}")
    sources = docs(spark, D=text, empty="", null=None)
    got = {(r.k, r.span_no): r.evidence for r in K.evidence(values, sources, ["k"]).collect()}
    want = {("a", i): text[max(a, 0):b] for i, (a, b) in enumerate(places)} | {("b", 0): None, ("c", 0): "", ("c", 1): text[1:2]}
    assert got == want
    issues = {(r.k, r.span_no): r.issue for r in K.span_problems(values, sources, ["k"]).collect()}
    bad = "span out of bounds"
    assert issues == {("a", 3): bad, ("a", 5): bad, ("a", 6): bad, ("b", 0): "source not supplied", ("c", 0): bad, ("c", 1): "document has changed"}
    probe = {r.k: (r.n_spans, r.n_problems, r.ok) for r in K.tamper_probe(values.filter("k = 'a'"), sources, ["k"]).collect()}
    assert probe == {"a": (7, 7, False)}


def test_no_whole_text_is_sent(spark, row):
    """Below a shuffle there are blocks and hashes, never the column of whole texts."""
    values = row.select("k", F.col("sales").alias("tracked"))
    plan = K.tamper_probe(values, docs(spark, D1=TEXT), ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan
    for line in plan.splitlines():
        if "Join" in line:
            assert "text#" not in line


def test_several_derivations_read_the_rows_once(spark):
    """Each value's nodes and edges are those of its own derivation; one scan, whatever the number of values."""
    span = "array<struct<doc_id:string,start:int,end:int,doc_sha:string>>"
    row = spark.createDataFrame([("A", (4.0, [("d", 0, 1, "s")], "extract", "n"), (1.0, [("e", 2, 3, "t")], "extract", "")), ("B", (4.0, [("d", 0, 1, "s")], "extract", "n"), None)],
                                f"ticker string, a struct<value:double,spans:{span},op:string,note:string>, b struct<value:double,spans:{span},op:string,note:string>")
    a, b = K.Tracked.leaf("a"), K.Tracked.leaf("b")
    derived = {"a": a, "gap": a - b, "share": (a - b) / a, "twice": a + a}
    many = K.derivation_graphs(row, ["ticker"], derived)
    for i, got in enumerate(many):
        want = [(r["ticker"], n, *r[1:]) for n, root in derived.items() for r in K.derivation_graph(row, ["ticker"], root)[i].collect()]
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and want
        assert got._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
    stats = {(r.ticker, r.metric): (r.n_nodes, r.n_edges, r.depth, r.n_leaves, r.ops) for r in K.graph_stats(*many, ["ticker", "metric"]).collect()}
    assert stats == {("A", "a"): (1, 0, 0, 1, "extract"), ("B", "a"): (1, 0, 0, 1, "extract"), ("A", "gap"): (3, 2, 1, 2, "extract,sub"),
                     ("A", "share"): (4, 4, 2, 2, "div,extract,sub"), ("A", "twice"): (2, 2, 1, 1, "add,extract"), ("B", "twice"): (2, 2, 1, 1, "add,extract")}
