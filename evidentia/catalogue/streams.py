"""Stream operators over events and conversations, live and as batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidentia.catalogue import chat as K
from evidentia.operators import chat as C
from evidentia.sources import tables as V
from evidentia.streaming import messages as S


def _events(spark, sf_dir):
    return V.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _ntz(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


def dedup(spark, sf_dir):
    return S.dedup_batch(_events(spark, sf_dir), ["user_id", "event_type"], "ts", 6 * 3600).select("event_id")


def late(spark, sf_dir):
    """Each event arrives ``value`` seconds after its time; older than a minute is skipped."""
    e = _events(spark, sf_dir)
    arrival = F.col("ts") + F.make_dt_interval(secs=F.col("value").cast("decimal(18,6)"))
    return S.drop_late(e, arrival, 60, "ts").select("event_id")


def sessions(spark, sf_dir):
    return _ntz(S.sessions(_events(spark, sf_dir), "user_id", "ts", "2 hours"), "start", "end")


def sessions_live(spark, sf_dir):
    """All sessions: those that the watermark has closed leave once, and their state with them; those still open follow from the state."""
    e = S.read_stream(spark, sf_dir, "events", "ts")
    live = S.sessions(e, "user_id", "ts", "2 hours", "10 minutes")
    return _ntz(S.run_available(live, "sessions", held=lambda state: S.open_sessions(state, "user_id")), "start", "end")


def rate(spark, sf_dir):
    return _ntz(S.rate_audit(_events(spark, sf_dir), ["event_type"], 3, "ts", "10 minutes"), "start")


def rate_live(spark, sf_dir):
    """Windows that the watermark has closed."""
    e = S.read_stream(spark, sf_dir, "events", "ts")
    return _ntz(S.run_available(S.rate_audit(e, ["event_type"], 3, "ts", "10 minutes", "10 minutes"), "rate"), "start")


def dedup_live(spark, sf_dir):
    """The same rule as in ``dedup``, on the stream: repeats inside the pause are dropped, and each sighting restarts it."""
    e = S.read_stream(spark, sf_dir, "events", "ts")
    return S.run_available(S.dedup_restarting(e, ["user_id", "event_type"], "ts", "6 hours"), "dedup").select("event_id")


def _live_messages(spark, sf_dir):
    """The message view, read as a stream."""
    live = S.read_stream(spark, sf_dir, "conversations")
    return V.messages_of(live)


def route_live(spark, sf_dir):
    return S.run_available(C.route_messages(_live_messages(spark, sf_dir), K.RULES), "route").select("msg_id", "content", "session_id", "is_group")


def state_live(spark, sf_dir):
    """Context of each conversation after each message that the watermark has passed."""
    m = _live_messages(spark, sf_dir).select(
        F.col("conv_id").cast("string").alias("session_id"), "msg_id", "turn", "role", "content", "create_time",
        F.lit(None).cast("string").alias("system_prompt"))
    return S.run_available(S.session_state(m), "state").select("session_id", "msg_id", "n_kept", "tokens")


def resets_live(spark, sf_dir):
    """Users' sessions over all their conversations: a new prompt every six turns, a clear command now and then, silence between conversations."""
    m = _live_messages(spark, sf_dir).select(
        F.col("other_user_id").alias("session_id"), "msg_id", "role", "create_time",
        F.when(F.col("turn") % 11 == 7, S.CLEAR_COMMAND).otherwise(F.col("content")).alias("content"),
        F.concat(F.lit("prompt "), F.floor(F.col("turn") / 6).cast("string")).alias("system_prompt"))
    return S.run_available(S.session_state(m), "resets").select("session_id", "msg_id", "n_kept", "tokens")


QUERIES = {
    "stream_dedup": dedup, "stream_late": late, "stream_sessions": sessions, "stream_sessions_live": sessions_live,
    "stream_rate_audit": rate, "stream_rate_audit_live": rate_live, "stream_dedup_live": dedup_live,
    "stream_route_live": route_live, "stream_session_state_live": state_live,
    "stream_session_resets_live": resets_live,
}

_SESSIONS = """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k"""
_RATE = """SELECT event_type, time_bucket(INTERVAL 10 MINUTE, ts) AS start, count(*) AS n, count(*) - 3 AS over
FROM events GROUP BY 1, 2 HAVING count(*) > 3"""
_CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"

ORACLE = {
    "stream_dedup": """SELECT event_id FROM (SELECT event_id, ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS gap FROM events)
WHERE gap IS NULL OR gap > INTERVAL 6 HOUR""",
    "stream_late": "SELECT event_id FROM events WHERE value <= 60",
    "stream_sessions": _SESSIONS, "stream_sessions_live": _SESSIONS,
    "stream_rate_audit": _RATE, "stream_rate_audit_live": f"SELECT * FROM ({_RATE}) WHERE start + INTERVAL 10 MINUTE <= {_CLOSED}",
    "stream_dedup_live": """SELECT event_id FROM (SELECT event_id, ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS gap FROM events)
WHERE gap IS NULL OR gap > INTERVAL 6 HOUR""",
    "stream_route_live": K.ORACLE["chat_route"],
    "stream_session_state_live": f"""WITH {K._M},
m AS (SELECT *, length(content) + 4 AS cost, count(*) OVER w AS n, sum(length(content) + 4) OVER w AS run FROM messages
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
fit AS (SELECT b.msg_id, b.conv_id, b.role, b.cost, count(*) FILTER (b.run - a.run + a.cost + 7 <= 1000) AS k,
  coalesce(max(b.run - a.run + a.cost) FILTER (b.run - a.run + a.cost + 7 <= 1000), 0) AS t
  FROM m b JOIN m a ON a.conv_id = b.conv_id AND a.n <= b.n GROUP BY 1, 2, 3, 4)
SELECT CAST(conv_id AS VARCHAR) AS session_id, msg_id, CAST(CASE WHEN k = 0 AND role <> 'assistant' THEN 1 ELSE k END AS INT) AS n_kept,
  CAST(CASE WHEN k = 0 AND role <> 'assistant' THEN cost ELSE t END + 7 AS INT) AS tokens FROM fit
JOIN (SELECT msg_id FROM messages WHERE create_time < (SELECT max(create_time) FROM messages) - INTERVAL 10 MINUTE) USING (msg_id)""",
    "stream_session_resets_live": f"""WITH {K._M},
marked AS (SELECT *, turn % 11 = 7 AS cleared, 'prompt ' || (turn // 6) AS prompt FROM messages),
cut AS (SELECT *, CASE WHEN cleared OR lag(cleared) OVER w OR prompt <> lag(prompt) OVER w OR create_time - lag(create_time) OVER w > INTERVAL 1 HOUR THEN 1 ELSE 0 END AS c
  FROM marked WINDOW w AS (PARTITION BY other_user_id ORDER BY create_time)),
part AS (SELECT *, sum(c) OVER (PARTITION BY other_user_id ORDER BY create_time) AS part FROM cut),
m AS (SELECT *, length(content) + 4 AS cost, count(*) OVER w AS n, sum(length(content) + 4) OVER w AS run FROM part
  WINDOW w AS (PARTITION BY other_user_id, part ORDER BY create_time)),
fit AS (SELECT b.msg_id, b.role, b.cost, length(b.prompt) + 7 AS base, count(*) FILTER (b.run - a.run + a.cost + length(b.prompt) + 7 <= 1000) AS k,
  coalesce(max(b.run - a.run + a.cost) FILTER (b.run - a.run + a.cost + length(b.prompt) + 7 <= 1000), 0) AS t
  FROM m b JOIN m a ON a.other_user_id = b.other_user_id AND a.part = b.part AND a.n <= b.n WHERE NOT b.cleared GROUP BY ALL)
SELECT other_user_id AS session_id, msg_id, CAST(CASE WHEN cleared THEN 0 WHEN k = 0 AND f.role <> 'assistant' THEN 1 ELSE k END AS INT) AS n_kept,
  CAST(CASE WHEN cleared THEN 7 WHEN k = 0 AND f.role <> 'assistant' THEN f.cost + base ELSE t + base END AS INT) AS tokens
FROM m LEFT JOIN fit f USING (msg_id) WHERE create_time < (SELECT max(create_time) FROM messages) - INTERVAL 10 MINUTE""",
}
