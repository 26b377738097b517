"""Message streams: duplicates, late rows, sessions, rates and session state.

Each operator is one function for streams and, where the semantics need a
different plan, a batch twin over the same columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from evidentia.session import shared_folder


def read_stream(spark: SparkSession, folder: str, name: str, ts: str | None = None) -> DataFrame:
    """A table, one file or a folder of files, followed as a stream; timestamps get the session's zone so that watermarks accept them."""
    path = f"{folder}/{name}.parquet"
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema)
    # A stream follows folders: that of a table's files, or for a table of one file the folder it lies in.
    alone = all(f.split("/")[-2:] == path.split("/")[-2:] for f in table.inputFiles())
    s = reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder) if alone else reader.parquet(path)
    return s.withColumn(ts, F.col(ts).cast("timestamp")) if ts else s


def run_available(stream: DataFrame, name: str, mode: str = "append", held: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Process what is there, into files of the shared folder, and read those back.

    With ``held``, rows that the stream still keeps follow, read by that function
    from its state store (key, value, partition_id).
    """
    import uuid

    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/evidentia/stream-{name}-{uuid.uuid4().hex}"

    def put(batch: DataFrame, batch_id: int) -> None:
        # One folder per batch (one in all for complete output), so a repeated batch replaces itself.
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={0 if mode == 'complete' else batch_id}")

    query = (stream.writeStream.outputMode(mode).foreachBatch(put)
             .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    out = spark.read.schema(stream.schema).parquet(f"{base}/out").select(*stream.columns)
    return out.unionByName(held(spark.read.format("statestore").load(f"{base}/checkpoint"))) if held else out


# --- duplicates and late rows ---------------------------------------------

def dedup_stream(messages: DataFrame, keys: list[str], ts: str = "create_time", ttl: str = "1 hour") -> DataFrame:
    """Drop repeats of a message id seen within the watermark delay."""
    return messages.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(keys)


def keyed_state(spark: SparkSession) -> None:
    """State processors need a store that can hold several states and timers per key."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def micros(moment) -> int:
    """A row's timestamp in microseconds since 1970."""
    return round(moment.timestamp() * 1_000_000)


class Sightings(StatefulProcessor):
    """Passes a row whose key was not sighted within ``ttl`` microseconds; every sighting restarts the clock."""

    def __init__(self, ts: str, ttl: int):
        self.ts, self.ttl = ts, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last = self.last.get()[0] if self.last.exists() else None
        if last is not None:
            self.handle.deleteTimer((last + self.ttl) // 1000 + 1)
        for row in sorted(rows, key=lambda r: r[self.ts]):
            now = micros(row[self.ts])
            if last is None or now - last > self.ttl:
                yield row
            last = now if last is None else max(now, last)
        self.last.update((last,))
        self.handle.registerTimer((last + self.ttl) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def dedup_restarting(messages: DataFrame, keys: list[str], ts: str = "create_time", ttl: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Drop repeats of a message id within ``ttl`` of its last sighting, dropped ones included: the live twin of ``dedup_batch``.

    One number per id is kept, until the watermark is past its time to live. A
    trigger's rows of one id are put in order, so an id's share of one trigger has
    to fit a task; the source's rate limits bound it.
    """
    keyed_state(messages.sparkSession)
    wide = pd.Timedelta(ttl) // pd.Timedelta("1us")
    return messages.withWatermark(ts, delay).groupBy(*keys).transformWithState(Sightings(ts, wide), messages.schema, "append", "eventtime")


def dedup_batch(messages: DataFrame, keys: list[str], ts: str = "create_time", ttl_seconds: int = 3600) -> DataFrame:
    """Keep a message unless its id was sighted within the time to live; each sighting restarts the clock.

    The previous sighting is looked for in the row's own time bucket and, at
    the bucket's edge, in the newest row of the bucket before. A bucket is as
    wide as the time to live, so anything older has expired, and one id that
    fills the table is still spread over its buckets.
    """
    m = messages.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn(
        "_b", F.floor(F.col("_us") / (ttl_seconds * 1_000_000)))
    before = m.groupBy(*keys, (F.col("_b") + 1).alias("_b")).agg(F.max("_us").alias("_edge"))
    inside = F.lag("_us").over(Window.partitionBy(*keys, "_b").orderBy("_us"))
    j = m.join(before, [*keys, "_b"], "left").withColumn("_prev", F.coalesce(inside, F.col("_edge")))
    fresh = F.col("_prev").isNull() | (F.col("_us") - F.col("_prev") > ttl_seconds * 1_000_000)
    return j.filter(fresh).select(*messages.columns)


def drop_late(messages: DataFrame, now, seconds: int = 60, ts: str = "create_time") -> DataFrame:
    """Skip messages older than ``seconds`` at ``now`` (a column or a timestamp literal)."""
    return messages.filter(F.col(ts).cast("timestamp") >= now - F.make_dt_interval(secs=F.lit(seconds)))


# --- sessions and rates ----------------------------------------------------

def sessions(messages: DataFrame, key: str, ts: str = "create_time", gap: str = "30 minutes", delay: str | None = None) -> DataFrame:
    """(key, start, end, n): activity sessions closed by a pause. For streams pass a watermark ``delay``.

    With spark.sql.sessionWindow.merge.sessions.in.local.partition on, a busy
    key is merged before the shuffle.
    """
    m = messages.withWatermark(ts, delay) if delay else messages
    g = m.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def open_sessions(state: DataFrame, key: str) -> DataFrame:
    """(key, start, end, n) of the sessions in the state of ``sessions`` over a stream: those that its watermark has not closed."""
    w = F.col("value.session_window")
    return state.select(F.col("key")[key].alias(key), w["start"].alias("start"), w["end"].alias("end"), F.col("value.count").alias("n"))


def rate_audit(messages: DataFrame, key: list[str], capacity: int, ts: str = "create_time", width: str = "1 minute",
               delay: str | None = None) -> DataFrame:
    """Tumbling windows in which a key made more requests than its capacity."""
    m = messages.withWatermark(ts, delay) if delay else messages
    g = m.groupBy(*key, F.window(ts, width).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.filter(F.col("n") > capacity).select(*key, F.col("w.start").alias("start"), "n", (F.col("n") - capacity).alias("over"))


# --- session state ---------------------------------------------------------

STATE_OUTPUT = "session_id string, msg_id string, n_kept int, tokens int, first_kept string"
CLEAR_COMMAND = "#清除记忆"
#: Messages of one millisecond, as lists side by side.
WAITING = "us array<bigint>, msg_id array<string>, role array<string>, content array<string>, system_prompt array<string>"


class Contexts(StatefulProcessor):
    """A session's context, one message at a time in order of event time.

    A message waits under its millisecond until the watermark has passed it; a
    timer then hands over what waits there. What is kept is the prompt and a list of
    turns that the budget bounds; a second kind of timer forgets a silent session.
    """

    def __init__(self, budget: int, per_message: int, priming: int, expires: int):
        self.budget, self.per_message, self.priming, self.expires = budget, per_message, priming, expires

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ms long", WAITING)
        self.prompt = handle.getValueState("prompt", "prompt string, us long")
        self.turns = handle.getListState("turns", "role string, content string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in rows:
            at = micros(r["create_time"])
            ms = at // 1000 + 1
            held = [list(x) for x in self.waiting.getValue((ms,))] if self.waiting.containsKey((ms,)) else [[], [], [], [], []]
            if not held[0]:
                self.handle.registerTimer(ms)
            for column, value in zip(held, (at, r["msg_id"], r["role"], r["content"], r["system_prompt"])):
                column.append(value)
            self.waiting.updateValue((ms,), tuple(held))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        ms = expiredTimerInfo.getExpiryTimeInMs()
        if self.waiting.containsKey((ms,)):
            due = sorted(zip(*self.waiting.getValue((ms,))), key=lambda m: m[:2])
            self.waiting.removeKey((ms,))
            for m in due:
                yield self.taken(key[0], *m)
        elif self.prompt.exists() and (self.prompt.get()[1] + self.expires) // 1000 < ms:
            self.forget()

    def forget(self) -> None:
        self.prompt.clear()
        self.turns.clear()

    def taken(self, session: str, at: int, msg_id: str, role: str, content: str, system_prompt: str | None) -> Row:
        prompt, last = tuple(self.prompt.get()) if self.prompt.exists() else ("", None)
        turns = [tuple(t) for t in self.turns.get()] if self.turns.exists() else []
        if last is not None:
            self.handle.deleteTimer((last + self.expires) // 1000 + 1)
        if content == CLEAR_COMMAND or (last is not None and at - last > self.expires):
            prompt, turns = "", []
        size = lambda: sum(len(t) + self.per_message for _, t in turns) + len(prompt) + self.per_message + self.priming
        if content != CLEAR_COMMAND:
            if system_prompt is not None and system_prompt != prompt:
                prompt, turns = system_prompt, []
            turns.append((role, content or ""))
            while size() > self.budget and (len(turns) > 1 or turns[:1] and turns[0][0] == "assistant"):
                turns.pop(0)
        self.prompt.update((prompt, at))
        self.turns.clear() if not turns else self.turns.put(turns)
        self.handle.registerTimer((at + self.expires) // 1000 + 1)
        return Row(session_id=session, msg_id=msg_id, n_kept=len(turns), tokens=size(), first_kept=turns[0][1] if turns else None)

    def close(self) -> None:
        pass


def session_state(messages: DataFrame, budget: int = 1000, per_message: int = 4, priming: int = 3,
                  expires: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Running session context of a stream of (session_id, msg_id, role, content, system_prompt, create_time).

    Each message is appended and the oldest turns are dropped until the budget
    holds; a new system prompt starts over, the clear command forgets the session,
    as does silence. A message is answered once the watermark is past it, in order
    of time whatever the order of arrival; messages of one instant go by their id.
    """
    keyed_state(messages.sparkSession)
    wide = pd.Timedelta(expires) // pd.Timedelta("1us")
    own = messages.select("session_id", "msg_id", "role", "content", "system_prompt", "create_time")
    return own.withWatermark("create_time", delay).groupBy("session_id").transformWithState(
        Contexts(budget, per_message, priming, wide), STATE_OUTPUT, "append", "eventtime")
