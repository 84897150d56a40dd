"""Streaming counterparts of the event-log operators.

Sources are append-only folders of Parquet files.  Times without zone become
timestamps before any watermark.  Stateful results are checked against their
batch versions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import dml
from ..operators import sessions as ordered_events
from ..sources.scratch import cut, fresh_path
from ..sources.tables import micros

_STREAK_OUT = "event_id long, user_id long, streak long"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """A folder (or file pattern) of event files as a stream, ``ts`` as a timestamp."""
    schema = spark.read.parquet(path).schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def gap_sessions(events: DataFrame, gap: str = "6 hours", late: str | None = None) -> DataFrame:
    """Sessions per user; with a watermark ``late`` they can be appended as they close."""
    e = events.withWatermark("ts", late) if late else events
    g = e.groupBy("user_id", F.session_window("ts", gap))
    return g.agg(F.count(F.lit(1)).alias("frame_count"), F.count_if(F.col("event_type") == "error").alias("failed_count"), F.min("ts").alias("started"), F.max("ts").alias("ended")).drop("session_window")


def throughput(events: DataFrame, late: str | None = "1 day") -> DataFrame:
    """Tumbling half hours."""
    e = events.withWatermark("ts", late) if late else events
    return e.groupBy(F.window("ts", "30 minutes").alias("w")).agg(F.count_if(F.col("event_type") == "purchase").alias("completed"), F.count_if(F.col("event_type") == "error").alias("failed")).select(F.col("w.start").alias("start"), "completed", "failed")


def _streak(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Consecutive failures per user; a purchase starts over.  The state is one number."""
    n = state.get[0] if state.exists else 0
    rows = pd.concat(list(pdfs)).sort_values(["ts", "event_id"])
    failed, over = (rows["event_type"] == "error").cumsum(), rows["event_type"] == "purchase"
    since = failed.where(over).ffill()  # failures before the last purchase
    streak = (failed - since.fillna(-n)).astype("int64")
    state.update((int(streak.iloc[-1]),))
    yield pd.DataFrame({"event_id": rows["event_id"], "user_id": key[0], "streak": streak})


def streaks(events: DataFrame) -> DataFrame:
    """The state is one number a user and is kept: a streak has no end but the next purchase."""
    return events.groupBy("user_id").applyInPandasWithState(_streak, _STREAK_OUT, "n long", "append", GroupStateTimeout.NoTimeout)


def without_repeats(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Exact repeats within the watermark dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def run_once(df: DataFrame, name: str, mode: str, each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Process all that is there and return the result.

    Append mode writes Parquet with exactly-once commits; complete mode keeps
    the last whole result.
    """
    spark = df.sparkSession
    out, marks = fresh_path(spark, f"{name}-out"), fresh_path(spark, f"{name}-marks")

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    writer = df.writeStream.outputMode(mode).option("checkpointLocation", marks).trigger(availableNow=True)
    started = writer.format("parquet").option("path", out).start() if mode == "append" and each is None else writer.foreachBatch(each or replace).start()
    started.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def run_updates(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Process all that is there in update mode, each batch's rows replacing those of their keys, and return the table.

    With a watermark the state holds open windows only; closed ones live in the
    table, whose versions are numbered by batch.
    """
    spark, out, last = df.sparkSession, fresh_path(df.sparkSession, name), [-1]

    def each(batch: DataFrame, number: int) -> None:
        before = spark.read.parquet(f"{out}/v={number - 1}") if number else spark.createDataFrame([], batch.schema)
        dml.upsert(before, batch, keys).write.mode("overwrite").parquet(f"{out}/v={number}")
        last[0] = number

    df.writeStream.outputMode("update").option("checkpointLocation", f"{out}/marks").trigger(availableNow=True).foreachBatch(each).start().awaitTermination()
    return spark.read.parquet(f"{out}/v={last[0]}") if last[0] >= 0 else spark.createDataFrame([], df.schema)


def tail(events: DataFrame, cursor: int, sink: Callable[[DataFrame, int], None], marks: str):
    """Hand every micro-batch of events after ``cursor`` to ``sink``, in order of id."""
    return events.filter(F.col("event_id") > cursor).writeStream.option("checkpointLocation", marks).trigger(availableNow=True).foreachBatch(lambda b, n: sink(b.orderBy("event_id"), n)).start()


def verdicts(tallies: DataFrame, known: DataFrame, now_us: int, settle_us: int = 3_600_000_000, floor_s: float = 900.0) -> DataFrame:
    """The verdict table after a batch of fresh tallies.

    Keys that have not settled wait, and a verdict that newer frames contradict
    is withdrawn: their rows replace the known ones, the others stay.
    """
    usable = (F.col("good") + F.col("rescued")) * 300.0
    verdict = F.when(F.lit(now_us) - F.col("newest") < settle_us, "waiting").when(usable >= floor_s, "keep").otherwise("scrap")
    fresh = tallies.select("user_id", "night", usable.alias("usable_s"), verdict.alias("verdict"))
    return dml.upsert(known, fresh, ["user_id", "night"])


def simulate(spark: SparkSession, nights: int, ticks: int, seed: int = 1) -> DataFrame:
    """Deterministic synthetic frames: a target per night and hour, failures by a hash."""
    n = spark.range(nights * ticks)
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed))).cast("binary")), 1, 8), 16, 10).cast("long") % 1000
    return n.select(
        F.col("id").alias("event_id"), F.expr(f"cast(id div {ticks} as long)").alias("night"), (F.expr(f"(id % {ticks}) div 60") % 5).alias("user_id"),
        F.expr(f"timestamp_seconds(1704067200 + (id div {ticks}) * 86400 + (id % {ticks}) * 60)").alias("ts"),
        F.when(h < 150, "error").when(h < 200, "purchase").otherwise("view").alias("event_type"), (h / 10).alias("value"),
    )


def _latch(ttl_s: float):
    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(pdfs)).sort_values(["ts", "event_id"])
        out = []
        for event, ts in zip(rows["event_id"], rows["ts"], strict=True):
            at = ts.timestamp()
            if last is None or at - last >= ttl_s:
                out.append((event, *key))
                last = at
        state.update((last,))
        yield pd.DataFrame(out, columns=["event_id", "user_id", "event_type"])

    return run


def alerts_once(events: DataFrame, ttl_s: float) -> DataFrame:
    """The first event of each (user, type), and then no other for ``ttl_s`` seconds."""
    return events.groupBy("user_id", "event_type").applyInPandasWithState(_latch(ttl_s), "event_id long, user_id long, event_type string", "last double", "append", GroupStateTimeout.NoTimeout)


class Sessions:
    """Sessions of a growing event log that keep their ids: every batch re-clusters the users that it touches.

    The folder holds the frames seen (appended) and numbered versions of the
    assignment ``event_id, user_id, session``; the last version is the state, so a
    batch that fails half-way is done again from the one before.  A late frame may
    move a session's start or join two; a cluster keeps the id of the session that
    it shares most frames with, one to one, and others get new ids.
    """

    def __init__(self, spark: SparkSession, root: str, gap_us: int) -> None:
        self.spark, self.root, self.gap = spark, root, gap_us

    def _version(self, n: int) -> DataFrame:
        if n < 0:
            return self.spark.createDataFrame([], "event_id long, user_id long, session long")
        return self.spark.read.parquet(f"{self.root}/sessions/v={n}")

    def step(self, batch: DataFrame, number: int) -> None:
        batch = batch.select("event_id", "user_id", micros("ts").alias("at_us"))
        batch.write.mode("overwrite").parquet(f"{self.root}/frames/batch={number}")
        seen = self.spark.read.parquet(*(f"{self.root}/frames/batch={i}" for i in range(number + 1)))
        users, known = cut(batch.select("user_id").distinct()), self._version(number - 1)
        own = ordered_events.number_gaps(seen.join(users, "user_id", "left_semi").dropDuplicates(["event_id"]), ["user_id"], "at_us", "event_id", self.gap)
        first = own.groupBy("user_id", "session_no").agg(F.min("event_id").alias("cluster"))  # names the cluster in this batch
        own = cut(own.join(first, ["user_id", "session_no"]).select("event_id", "user_id", "cluster"))
        overlap = own.join(known.select("event_id", F.col("session").alias("old")), "event_id").groupBy("cluster", "old").agg(F.count(F.lit(1)).alias("overlap"))
        kept = cut(ordered_events.stable_ids(overlap))
        top = known.agg(F.coalesce(F.max("session"), F.lit(-1)).alias("top"))  # one row
        fresh = own.select("cluster").distinct().join(kept, "cluster", "left_anti")
        fresh = fresh.crossJoin(F.broadcast(top)).select("cluster", (F.col("top") + F.row_number().over(Window.orderBy("cluster"))).alias("session"))  # one row a new session of a batch
        ids = kept.select("cluster", F.col("old").alias("session")).unionByName(fresh)
        now = own.join(ids, "cluster").select("event_id", "user_id", "session")
        known.join(users, "user_id", "left_anti").unionByName(now).write.mode("overwrite").parquet(f"{self.root}/sessions/v={number}")

    def run(self, events: DataFrame) -> DataFrame:
        """All that is there, batch by batch; the assignment after the last."""
        last = [-1]

        def each(batch: DataFrame, number: int) -> None:
            self.step(batch, number)
            last[0] = number

        events.writeStream.option("checkpointLocation", f"{self.root}/marks").trigger(availableNow=True).foreachBatch(each).start().awaitTermination()
        return self._version(last[0])
