import datetime
import os

from pyspark.sql import functions as F

from evidentia.operators import ledger as L
from evidentia.streaming import messages as S

T0 = datetime.datetime(2024, 1, 1)


def stream_of(spark, tmp_path, df):
    df.write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))


def test_tables_of_one_file_and_of_several_are_followed(spark, tmp_path):
    """A stream over a folder of part files once saw none of them."""
    from evidentia.catalogue import streams as Q

    c = spark.createDataFrame([(k, t, "assistant" if t % 2 else "user", f"word {k} {t}") for k in range(6) for t in range(8)], "conv_id long, turn long, role string, text string")
    c.coalesce(1).write.parquet(str(tmp_path / "one"))
    os.makedirs(tmp_path / "file")
    os.rename(next((tmp_path / "one").glob("part-*")), tmp_path / "file" / "conversations.parquet")
    c.repartition(3).write.parquet(str(tmp_path / "folder" / "conversations.parquet"))
    for query in (Q.route_live, Q.state_live, Q.resets_live):
        rows = [sorted(query(spark, str(tmp_path / at)).collect()) for at in ("file", "folder")]
        assert rows[0] == rows[1] and rows[0]


def at(*minutes):
    return [T0 + datetime.timedelta(minutes=m) for m in minutes]


def test_each_sighting_restarts_the_clock(spark):
    rows = [(i, k, t) for i, (k, t) in enumerate([("a", m) for m in at(0, 50, 100, 161, 230)] + [("b", m) for m in at(0, 0.5)])]
    df = spark.createDataFrame(rows, "n int, msg_id string, create_time timestamp")
    assert {r.n for r in S.dedup_batch(df, ["msg_id"]).collect()} == {0, 3, 4, 5}


def test_live_duplicates(spark, tmp_path):
    df = spark.createDataFrame([(k, t) for k, t in zip("aab", at(0, 10, 20))], "msg_id string, create_time timestamp")
    live = S.run_available(S.dedup_stream(stream_of(spark, tmp_path, df), ["msg_id"]), "dup")
    assert sorted(r.msg_id for r in live.collect()) == ["a", "b"]


def test_live_sessions_equal_the_batch(spark, tmp_path):
    df = spark.createDataFrame([(u, t) for u in "xy" for t in at(0, 10, 70, 75)], "user string, create_time timestamp")
    live = S.run_available(S.sessions(stream_of(spark, tmp_path, df), "user", delay="1 minute"), "ses", "complete")
    assert sorted(live.collect()) == sorted(S.sessions(df, "user").collect()) and live.count() == 4


def test_live_sessions_hold_the_open_ones_too(spark, tmp_path):
    from evidentia.catalogue import streams as Q

    e = spark.createDataFrame([(u, t) for u in (1, 2, None) for t in at(0, 10, 300, 700)] + [(3, at(695)[0]), (4, None)], "user_id long, ts timestamp_ntz")
    e.repartition(2).write.parquet(str(tmp_path / "events.parquet"))
    rows = sorted(map(tuple, Q.sessions_live(spark, str(tmp_path)).collect()), key=str)
    assert rows == sorted(map(tuple, Q.sessions(spark, str(tmp_path)).collect()), key=str) and len(rows) == 10


def test_late_rows(spark):
    df = spark.createDataFrame([(t,) for t in at(0, 9, 9.5)], "create_time timestamp")
    assert S.drop_late(df, F.lit(at(10)[0])).count() == 2


def test_rate(spark):
    df = spark.createDataFrame([("k", t) for t in at(0, 0.1, 0.2, 1.5)], "key string, create_time timestamp")
    r = S.rate_audit(df, ["key"], 2).collect()
    assert len(r) == 1 and r[0].n == 3 and r[0].over == 1


def test_live_clock_restarts(spark, tmp_path):
    rows = [(i, k, t) for i, (k, t) in enumerate([("a", m) for m in at(0, 50, 100, 161, 230)] + [("b", m) for m in at(0, 0.5)] + [(None, m) for m in at(1, 2)])]
    df = spark.createDataFrame(rows, "n int, msg_id string, create_time timestamp").repartition(3)
    live = S.run_available(S.dedup_restarting(stream_of(spark, tmp_path, df), ["msg_id"]), "again")
    assert live.columns == df.columns and {r.n for r in live.collect()} == {0, 3, 4, 5, 7}


def test_live_clock_over_several_triggers(spark, tmp_path):
    """The clock is kept between triggers, one file each."""
    for i, minute in enumerate((0, 40, 80, 120, 200)):
        spark.createDataFrame([("a", at(minute)[0])], "msg_id string, create_time timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema("msg_id string, create_time timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = sorted(r.create_time for r in S.run_available(S.dedup_restarting(live, ["msg_id"]), "again").collect())
    assert got == at(0, 200)


def test_session_state(spark, tmp_path):
    """Order of arrival does not count; prompt change, clear command and silence start over; the last delay is not answered yet."""
    rows = [("s", "1", "user", "x" * 30, None), ("s", "2", "assistant", "y" * 30, None), ("s", "3", "user", "z" * 30, None),
            ("s", "4", "user", "new", "other prompt"), ("s", "5", "user", S.CLEAR_COMMAND, None), ("s", "6", "user", "w" * 500, None),
            ("s", "7", "user", "later", None), ("t", "8", "assistant", "v" * 500, None), ("t", "9", "user", None, None), ("s", "10", "user", "same time", None),
            ("z", "end", "user", "", None)]
    df = spark.createDataFrame([(*r, t) for r, t in zip(rows, at(0, 1, 2, 3, 4, 5, 70, 0, 1, 70, 90))],
                               "session_id string, msg_id string, role string, content string, system_prompt string, create_time timestamp")
    live = S.run_available(S.session_state(stream_of(spark, tmp_path, df.orderBy(F.desc("create_time"))), budget=90), "st")
    got = {r.msg_id: (r.n_kept, (r.first_kept or "")[:3]) for r in live.collect()}
    assert got == {"1": (1, "xxx"), "2": (2, "xxx"), "3": (2, "yyy"), "4": (1, "new"), "5": (0, ""), "6": (1, "www"), "10": (1, "sam"), "7": (2, "sam"),
                   "8": (0, ""), "9": (1, "")}


def test_ledger_rules(spark):
    d = datetime.date(2024, 1, 3)
    rows = [(1, d, "Morning Coffee", 5.0, 0.0, "cash", None), (2, d, "income3 pay", 0.0, 100.0, "bank", None), (3, None, "", 0.0, 0.0, "", "Uncategorized"),
            (4, d, "both", 7.0, 9.0, "bank", "Gift")]
    e = spark.createDataFrame(rows, "entry_id bigint, date date, description string, payment double, deposit double, account string, category string")
    typed = {r.entry_id: (r.type, float(r.amount), r.category) for r in L.entry_type_amount(L.classify(e.drop("category"))).collect()}
    assert typed[1] == ("Expense", 5.0, "Food & Dining") and typed[2] == ("Income", 100.0, "Income3")
    assert typed[3] == ("Expense", 0.0, "Uncategorized") and typed[4][:2] == ("Expense", 7.0)
    assert {r.entry_id: len(r.errors) for r in L.validate_entries(e).collect()} == {1: 0, 2: 1, 3: 4, 4: 0}
    assert {r.entry_id: (r.category, r.updated) for r in L.recategorise(e).collect()} == {
        1: ("Food & Dining", True), 2: ("Income3", True), 3: ("Uncategorized", False), 4: ("Gift", False)}
    assert spark.range(1).select(L.week_start(F.lit(d)).alias("w")).first().w == datetime.date(2023, 12, 31)


def test_running_total_over_a_hot_account(spark):
    df = spark.range(3000).select(F.col("id").alias("entry_id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 3).cast("int")).alias("date"),
                                  F.lit("a").alias("account"), F.lit(1).cast("decimal(18,2)").alias("payment"))
    got = L.running_total(df, ["account"], id_bucket=16)
    assert got.count() == 3000 and got.filter(F.col("cumulative") != (F.col("entry_id") % 3) * 1000 + F.floor(F.col("entry_id") / 3) + 1).count() == 0


def test_cells_and_cards_equal_the_entries(spark):
    rows = [(i, datetime.date(2024, 1, 1 + i % 28) if i % 7 else None, ["Morning coffee", "uber", "", None, "income3"][i % 5], float(i % 4), float(i % 3) if i % 4 == 0 else 0.0,
             ["", "cash", None][i % 3]) for i in range(300)]
    e = spark.createDataFrame(rows, "entry_id bigint, date date, description string, payment double, deposit double, account string")
    e = e.withColumn("payment", F.col("payment").cast("decimal(18,2)")).withColumn("deposit", F.col("deposit").cast("decimal(18,2)"))
    whole, cells = L.entry_type_amount(L.classify(e)), L.category_cells(e)
    same = lambda f: sorted(map(str, f(whole).collect())) == sorted(map(str, f(cells).collect()))
    assert same(L.category_summary) and same(L.expense_stats) and same(L.category_rollup) and same(lambda x: L.share_by_type(x, "category", "none"))
    means = {r.category: r.avg for r in L.expense_stats(whole).collect()}
    want = {r.entry_id for r in whole.collect() if r.type == "Expense" and float(r.amount) > 1.5 * means[r.category]}
    assert {r.entry_id for r in L.anomalies(e, 1.5).collect()} == want and want
    cards = {(r.card, r.name): (float(r.income), float(r.expense), r["count"]) for r in L.dashboard(e).collect()}
    total = lambda t: sum(float(r.amount) for r in whole.collect() if r.type == t)
    assert cards["all", "balance"] == (total("Income"), total("Expense"), 300)
    assert sum(n for (c, _), (_, _, n) in cards.items() if c == "month") == sum(1 for r in rows if r[1]) and cards["account", "Other"][2] == 200
