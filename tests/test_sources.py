import datetime
import json
import zipfile

from pyspark.sql import functions as F

from evidentia.operators import manifest as M
from evidentia.operators import preference as P
from evidentia.sources import ledger_pages as LP
from evidentia.sources import parsers as PA
from evidentia.sources import readers as R
from evidentia.sources import sinks as S


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf8")


def test_price_files(spark, tmp_path):
    head = "Date,Open,High,Low,Close,Volume\n"
    write(tmp_path / "spy.us.csv", head + "2024-01-02,1,1,1,10.5,9\n2024-01-03,1,1,1,,9\n2024-01-04,1,1,1,N/A,9\n2024-01-05,1,1,1,11,9\n")
    write(tmp_path / "bad.csv", "No data\n")
    write(tmp_path / "page.csv", "<!doctype html>\n<HTML><body>check</body></html>\n")
    write(tmp_path / "one.csv", head + "2024-01-02,1,1,1,3,9\n")
    rows = R.read_prices_csv(spark, str(tmp_path)).filter("name = 'spy.us'").orderBy("d").collect()
    assert [r.close for r in rows] == [10.5, 11.0]
    status = {r.name: r.status for r in R.price_file_status(spark, str(tmp_path)).collect()}
    assert status == {"spy.us": "ok", "bad": "unusable: no data for this symbol", "page": "unusable: no data for this symbol",
                      "one": "unusable: fewer than two usable closes"}


def archive(path, text):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("data.CSV", text)


def test_factor_file_stops_before_the_annual_block(spark, tmp_path):
    archive(tmp_path / "ff.zip", "Preamble\nlines\n\n,Mkt-RF,SMB,HML,RF\n20240102,  1.00, -0.50,0.1,0.02\n20240103,-2.00,0.5,0.1,0.02\n\nAnnual\n,Mkt-RF,SMB,HML,RF\n2024,20.0,1,1,1\n")
    rows = R.read_factor_file(spark, str(tmp_path)).collect()
    m = {r.d: r.value for r in rows if r.name == "Mkt-RF"}
    assert m == {datetime.date(2024, 1, 2): 0.01, datetime.date(2024, 1, 3): -0.02} and len(rows) == 8


def test_industry_file_drops_marked_days(spark, tmp_path):
    archive(tmp_path / "ind.zip", "Title\n\n  Average Value Weighted Returns\n,NoDur,Durbl\n20240102,1.0,2.0\n20240103,-99.99,2.0\n20240104,3.0,4.0\n\n Equal\n,NoDur,Durbl\n20240102,50,50\n")
    rows = R.read_industry_file(spark, str(tmp_path)).filter("name = 'NoDur'").orderBy("d").collect()
    assert [(r.d.day, r.value) for r in rows] == [(2, 0.01), (4, 0.03)]


def test_chart_macro_and_series(spark, tmp_path):
    write(tmp_path / "c/btc.json", json.dumps({"prices": [[1704067200000, 10.0], [1704153600000, 11.5]]}))
    assert [(str(r.d), r.value) for r in R.read_market_chart_json(spark, str(tmp_path / "c")).orderBy("d").collect()] == [("2024-01-01", 10.0), ("2024-01-02", 11.5)]
    write(tmp_path / "m/rate.csv", "DATE,RATE\n2024-01-01,.\n2024-01-02,5.25\n2024-01-03,\n")
    assert [(r.name, str(r.d), r.value) for r in R.read_macro_csv(spark, str(tmp_path / "m")).collect()] == [("rate", "2024-01-02", 5.25)]
    write(tmp_path / "s/x.csv", "t,a,b\n1,0.5,z\n2,,y\n")
    assert [r.a for r in R.read_series_csv(spark, str(tmp_path / "s"), ["a"]).collect()] == [0.5, None]


def test_filing_inputs(spark, tmp_path):
    write(tmp_path / "x/acme/Revenues.json", '{"tag":"Revenues","units":{"EUR":[{"val":7,"start":"2023-01-01","end":"2023-12-31","fy":2023,"form":"10-K","filed":"2024-01-01","accn":"q"}]}}')
    d = R.read_concepts(spark, str(tmp_path / "x/*"))
    f = R.parse_concepts(d).first()
    assert (f.ticker, f.tag, f.unit, f.val) == ("ACME", "Revenues", "EUR", 7)
    recent = {"form": ["10-K", "10-K/A", "10-K", "10-K"], "filingDate": ["2024-02-01", "2023-03-01", "2023-02-01", "2022-02-01"],
              "accessionNumber": ["1-2-3", "1-2-2", "1-2-1", "1-2-0"], "primaryDocument": ["a.htm", "b.htm", "", "d.htm"]}
    idx = spark.createDataFrame([("acme", json.dumps({"cik": "320193", "filings": {"recent": recent}})), ("none", '{"cik":"1","filings":{"recent":{"form":[],"filingDate":[],"accessionNumber":[],"primaryDocument":[]}}}')], "ticker string, text string")
    got = R.parse_filings_index(idx).orderBy("rank").collect()
    assert [g.accession for g in got] == ["1-2-3", "1-2-0"] and got[0].cik == "0000320193"
    assert got[0].url.endswith("/320193/123/a.htm") and got[0].dest == "acme/10-K-2024-02-01.htm"
    assert [r.ticker for r in R.filings_shortfall(idx, R.parse_filings_index(idx)).collect()] == ["NONE"]
    write(tmp_path / "t.json", '{"0":{"cik_str":320193,"ticker":"aapl","title":"x"},"1":{"cik_str":5,"ticker":"B","title":"y"}}')
    assert {(r.ticker, r.cik) for r in R.read_ticker_map(spark, str(tmp_path / "t.json")).collect()} == {("AAPL", "0000320193"), ("B", "0000000005")}


def test_words_pairs_and_pages(spark, tmp_path):
    write(tmp_path / "w.txt", " one \n\ntwo\n")
    assert [r.word for r in R.read_wordlist(spark, str(tmp_path / "w.txt")).collect()] == ["one", "two"]
    write(tmp_path / "k.json", '{"keyword": {"hi": "hello"}}')
    assert R.read_keyword_map(spark, str(tmp_path / "k.json")).first().reply == "hello"
    write(tmp_path / "p.json", '[{"prompt":"p","chosen":"c","rejected":"r"},{"prompt":"p","chosen":"c"}]')
    good, bad = R.read_preference_pairs(spark, str(tmp_path / "p.json"))
    assert good.count() == 1 and bad.count() == 1
    both = P.preference_dataset(good, "prompt", 0.0)
    assert {r.part for r in both.collect()} == {"train", "test"} and both.first().chosen_text == "p\n\n回答：c"
    page = spark.createDataFrame([("1", (((("2024-01-02",),)), ([("coffee",)],), (5.0,), (None,), ((None,),)))],
                                 "id string, properties struct<Date:struct<date:struct<start:string>>,Description:struct<title:array<struct<plain_text:string>>>,"
                                 "Payment:struct<number:double>,Deposit:struct<number:double>,Account:struct<select:struct<name:string>>>")
    r = R.read_ledger_pages(page).first()
    assert (r.description, float(r.payment), float(r.deposit), r.account) == ("coffee", 5.0, 0.0, "")


def test_manifest_round(spark, tmp_path):
    write(tmp_path / "raw/a/x.txt", "one")
    write(tmp_path / "raw/b.txt", "two")
    scan = R.scan_raw(spark, str(tmp_path / "raw"))
    assert {r.dest for r in scan.collect()} == {"a/x.txt", "b.txt"}
    man = scan.withColumn("request_fingerprint", F.lit("f"))
    gone = spark.createDataFrame([("c.txt", "00", 1, "f")], "dest string, sha256 string, bytes bigint, request_fingerprint string")
    assert [r.dest for r in M.verify_manifest(man.unionByName(gone), scan).collect()] == ["c.txt"]
    wanted = spark.createDataFrame([("b.txt", "f"), ("a/x.txt", "other"), ("c.txt", "f")], "dest string, request_fingerprint string")
    assert {r.dest: r.needs_fetch for r in M.plan_refresh(wanted, man, scan).collect()} == {"b.txt": False, "a/x.txt": True, "c.txt": True}
    assert [r.dest for r in M.require(wanted, scan).collect()] == ["c.txt"]
    S.write_manifest(man, gone, str(tmp_path / "m2"))
    assert spark.read.parquet(str(tmp_path / "m2")).count() == 3


def test_sinks(spark, tmp_path):
    runs = spark.createDataFrame([("Model A:7b", "real", 1), ("model-b", "real", 2)], "answerer string, suite string, n int")
    S.write_run(runs, str(tmp_path / "runs"))
    S.write_run(spark.createDataFrame([("model-b", "real", 3)], "answerer string, suite string, n int"), str(tmp_path / "runs"))
    assert {(r.slug, r.n) for r in spark.read.parquet(str(tmp_path / "runs")).collect()} == {("model-a-7b", 1), ("model-b", 3)}
    e = spark.createDataFrame([("morning coffee", None), ("coffee", "Gift"), ("zzz", None)], "description string, category string")
    S.append_ledger(e, str(tmp_path / "led"))
    S.append_ledger(e.limit(1), str(tmp_path / "led"))
    got = [(r.description, r.category) for r in spark.read.parquet(str(tmp_path / "led")).collect()]
    assert got.count(("morning coffee", "Food & Dining")) == 2 and ("coffee", "Gift") in got and ("zzz", "Uncategorized") in got
    S.write_results(runs, str(tmp_path / "res"), "r1", False, "filed")
    assert spark.read.json(str(tmp_path / "res")).first().is_synthetic is False


def test_columns_go_by_name_and_bad_files_have_a_reason(spark, tmp_path):
    write(tmp_path / "p/a.csv", "Date,Close,Open\n2024-01-02,10.5,1\n2024-01-03,11,2\n")
    write(tmp_path / "p/b.csv", "Date,Open\n2024-01-02,1\n")
    assert sorted((r.name, r.close) for r in R.read_prices_csv(spark, str(tmp_path / "p")).collect()) == [("a", 10.5), ("a", 11.0)]
    assert {r.name: r.status for r in R.price_file_status(spark, str(tmp_path / "p")).collect()} == {"a": "ok", "b": "unusable: no column of closes"}
    files = spark.createDataFrame([
        ("bare", "x\nMkt-RF,SMB,HML\n20240102,1,2,3\n20240103,4,5,6\n"), ("empty", ",Mkt-RF,SMB\n\n20240102,1,2\n"), ("none", "nothing")], "name string, body string")
    got = {(r.series, r.d.day): r.value for r in PA.parse_factors(files).collect()}
    assert got == {("Mkt-RF", 2): 0.01, ("SMB", 2): 0.02, ("HML", 2): 0.03, ("Mkt-RF", 3): 0.04, ("SMB", 3): 0.05, ("HML", 3): 0.06}
    assert {r.name: r.status for r in PA.block_status(files, "factor").collect()} == {
        "bare": "ok", "empty": "unusable: no daily rows", "none": "unusable: no factor header"}
    charts = spark.createDataFrame([("k", "{}"), ("one", '{"prices": [[0, 1.0]]}'), ("two", '{"prices": [[0, 1.0], [86400000, 2.0]]}')], "name string, body string")
    assert {r.name: r.status for r in PA.chart_status(charts).collect()} == {
        "k": "unusable: no prices in the document", "one": "unusable: fewer than two prices", "two": "ok"}
    macro = spark.createDataFrame([("e", ""), ("n", "d,v\n2024-01-01,.\n"), ("y", "d,v\n2024-01-01,1\n")], "name string, body string")
    assert {r.name: r.status for r in PA.macro_status(macro).collect()} == {"e": "unusable: empty file", "n": "unusable: no usable observations", "y": "ok"}


def test_files_of_several_lines_are_read_whole(spark, tmp_path):
    write(tmp_path / "acme/Revenues.json", '{"tag": "Revenues",\n "units": {"USD": [\n{"val": 1.53, "start": "2023-01-01", "end": "2023-12-31", "fy": 2023, "form": "10-K"}]}}\n')
    (fact,) = R.parse_concepts(R.read_concepts(spark, str(tmp_path / "*"))).collect()
    assert float(fact.val) == 1.53
    write(tmp_path / "t.json", '{"0":\n{"cik_str": 5, "ticker": "b"}}\n')
    assert [(r.ticker, r.cik) for r in R.read_ticker_map(spark, str(tmp_path / "t.json")).collect()] == [("B", "0000000005")]


def test_paged_ledger(spark, tmp_path):
    """Dates reach the pages: those outside are neither tasks nor opened, and the plan has no filter left for them."""
    import datetime
    from decimal import Decimal

    day = lambda i: datetime.date(2024, 1, 1) + datetime.timedelta(days=i)
    rows = [(str(i), day(i // 4) if i % 9 else None, "" if i % 5 == 0 else f"text {i} \u00e9", Decimal(i), Decimal("0.50"), "" if i % 2 else "cash") for i in range(400)]
    entries = spark.createDataFrame(rows, LP.SCHEMA)
    path = str(tmp_path / "ledger")
    LP.write_ledger(entries, path, page=40)
    whole = LP.read_ledger(spark, path)
    assert sorted(tuple(r) for r in whole.collect()) == sorted(rows) and whole.rdd.getNumPartitions() == 10
    low, high = F.lit(day(30)), F.lit(day(40))
    some = LP.read_ledger(spark, path).filter(F.col("date").between(low, high) & (F.col("account") == "cash"))
    assert sorted(r.entry_id for r in some.collect()) == sorted(r[0] for r in rows if r[1] and day(30) <= r[1] <= day(40) and r[5] == "cash")
    plan = spark._jvm.PythonSQLUtils.explainString(some._jdf.queryExecution(), "formatted")
    pushed = plan.split("PushedFilters")[1].splitlines()[0]
    assert "GreaterThanOrEqual(date" in pushed and "LessThanOrEqual(date" in pushed and "(date" not in plan.split("Condition")[1] and some.rdd.getNumPartitions() <= 3
    assert LP.read_ledger(spark, path).filter(F.col("date") == F.lit(day(33))).count() == sum(r[1] == day(33) for r in rows)
    assert LP.read_ledger(spark, path).filter("date IS NULL").count() == sum(r[1] is None for r in rows)
    assert LP.read_ledger(spark, path).filter(F.col("date") > F.lit(day(98))).count() == sum(bool(r[1]) and r[1] > day(98) for r in rows)


def test_pages_with_missing_parts():
    assert LP.flat({"id": "a", "properties": {}})[1:] == (None, "", 0, 0, "")
    nested = {"id": "b", "properties": {"Date": {"date": {"start": "2024-05-06T10:00"}}, "Description": {"title": []}, "Payment": {"number": None}, "Account": {"select": None}}}
    assert str(LP.flat(nested)[1]) == "2024-05-06" and LP.flat(nested)[2:] == ("", 0, 0, "")


def test_replayed_batches_leave_the_same_ledger(spark, tmp_path):
    e = lambda *texts: spark.createDataFrame([(t, None) for t in texts], "description string, category string")
    path = str(tmp_path / "ledger")
    assert S.read_batches(spark, path) is None
    S.append_batch(e("coffee", "zzz"), path, 0)
    S.append_batch(e("coffee", "zzz"), path, 0)
    S.append_batch(e("uber"), path, 1)
    e("half").withColumn("category", F.lit("x")).write.parquet(f"{path}/entries/batch=2")
    assert sorted((r.description, r.category) for r in S.read_batches(spark, path).collect()) == [
        ("coffee", "Food & Dining"), ("uber", "Transportation"), ("zzz", "Uncategorized")]
    S.append_batch(e("whole"), path, 2)
    assert sorted(r.description for r in S.read_batches(spark, path).collect()) == ["coffee", "uber", "whole", "zzz"]


def test_manifest_versions_switch_whole(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "dest string, sha256 string")
    path = str(tmp_path / "manifest")
    S.switch_manifest(rows(("a", "1"), ("b", "1")), path, 0)
    S.switch_manifest(rows(("b", "2"), ("c", "2")), path, 1)
    S.switch_manifest(rows(("b", "2"), ("c", "2")), path, 1)
    rows(("z", "9")).write.parquet(f"{path}/entries/batch=2")
    assert sorted(tuple(r) for r in S.current_manifest(spark, path).collect()) == [("a", "1"), ("b", "2"), ("c", "2")]
    S.switch_manifest(rows(("a", "3")), path, 2)
    assert sorted(tuple(r) for r in S.current_manifest(spark, path).collect()) == [("a", "3"), ("b", "2"), ("c", "2")]


def test_pages_take_less_room_than_their_text(spark, tmp_path):
    """Every entry names all its fields again, which plain text would write out."""
    e = spark.range(2000).selectExpr("id AS entry_id", "date_add(date '2024-01-01', cast(id % 300 AS int)) AS date", "concat('thing ', id) AS description",
                                     "cast(id AS decimal(18,2)) AS payment", "cast(0 AS decimal(18,2)) AS deposit", "'bank' AS account")
    LP.write_ledger(e, str(tmp_path / "ledger"), page=500)
    text = sum(len(r.value) for r in spark.read.text(str(tmp_path / "ledger" / "pages")).collect())
    assert sum(f.stat().st_size for f in (tmp_path / "ledger" / "pages").glob("part-*")) < 0.3 * text
    assert sorted(map(tuple, LP.read_ledger(spark, str(tmp_path / "ledger")).selectExpr("cast(entry_id AS long) AS entry_id", "date", "description", "payment", "deposit", "account").collect())) == sorted(map(tuple, e.collect()))


def test_statuses_of_all_kinds_come_from_one_scan(spark, tmp_path, monkeypatch):
    from evidentia.catalogue import files

    days = [f"({s}L, {n}, TIMESTAMP_NTZ'1995-0{m}-02')" for s in (7, 8) for m in (1, 2, 3) for n in (1, 2)]
    spark.sql(f"SELECT * FROM VALUES {', '.join(days)} AS t(l_suppkey, l_linenumber, l_shipdate)").write.parquet(f"{tmp_path}/lineitem.parquet")
    scans, own = [], files._daily
    monkeypatch.setattr(files, "_daily", lambda *a: scans.append(a) or own(*a))
    got = {(r["kind"], r["name"]): (r["n_values"], str(r["first"]), str(r["last"]), r["status"]) for r in files.statuses(spark, str(tmp_path)).collect()}
    assert len(scans) == 1
    assert got == {(k, n): (3, "1995-01-02", "1995-03-02", "ok") for k in ("price", "factor", "industry", "chart", "macro") for n in ("AIR-7-1995", "FOB-8-1995")}
