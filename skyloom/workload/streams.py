"""Streaming queries: ``events`` replayed as a file stream, held against the batch results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..streaming import jobs
from ..sources.scratch import fresh_path
from ..sources.tables import table
from .events import _EV, _GAP_SQL, _NUM, GAP


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.read_events(spark, f"{sf_dir}/events.parquet*")


@query("stream_gap_sessions", f"SELECT user_id, frame_count, failed_count, started_at, ended_at FROM ({_GAP_SQL})")
def stream_gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    # an exactly six-hour gap merges in both
    out = jobs.run_once(jobs.gap_sessions(_events(spark, sf_dir)), "gap-sessions", "complete")
    return out.select("user_id", "frame_count", "failed_count", F.unix_micros("started").alias("started_at"), F.unix_micros("ended").alias("ended_at"))


@query("stream_throughput", f"SELECT CAST(floor(at_us / 1800000000) * 1800 AS BIGINT) AS start, CAST(count(*) FILTER (event_type = 'purchase') AS BIGINT) AS completed, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS failed FROM ({_EV}) GROUP BY 1")
def stream_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half hours by updates; the watermark lets go of those that are a year old."""
    out = jobs.run_updates(jobs.throughput(_events(spark, sf_dir), "365 days"), "throughput", ["start"])
    return out.select(F.unix_seconds("start").alias("start"), "completed", "failed")


@query("stream_streaks", f"""WITH e AS ({_EV}), i AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY at_us, event_id ROWS UNBOUNDED PRECEDING) AS isl FROM e)
SELECT event_id, user_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, isl ORDER BY at_us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM i""")  # fmt: skip
def stream_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.run_once(jobs.streaks(_events(spark, sf_dir)), "streaks", "append")


@query("stream_without_repeats", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT event_id, user_id, event_type FROM events) GROUP BY ALL")
def stream_without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    out = jobs.run_once(jobs.without_repeats(e.unionByName(e), ["event_id"], "100 days").select("event_id", "user_id", "event_type"), "repeats", "append")
    return out.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("stream_recluster", f"""WITH {_NUM}, c AS (SELECT user_id, session_no, count(*) AS frames, min(event_id) AS least FROM s GROUP BY ALL) SELECT s.event_id, c.frames, c.least FROM s JOIN c ON c.user_id = s.user_id AND c.session_no = s.session_no""")
def stream_recluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of events that come in three batches out of order: each event with its session's frames, and the ids that these have."""
    root = fresh_path(spark, "recluster")
    for k in range(3):
        table(spark, sf_dir, "events").filter(F.col("event_id") % 3 == k).write.mode("append").parquet(f"{root}/src")
    got = jobs.Sessions(spark, f"{root}/state", GAP).run(jobs.read_events(spark, f"{root}/src", 1))
    per = got.groupBy("session").agg(F.count(F.lit(1)).alias("frames"), F.min("event_id").alias("least"))
    return got.join(per, "session").select("event_id", "frames", "least")


@query("scheduler_sim", """WITH e AS (SELECT i // 480 AS night, ((i % 480) // 60) % 5 AS user_id, CAST('0x' || substr(md5(CAST(i AS VARCHAR) || ':1'), 1, 8) AS BIGINT) % 1000 AS h FROM (SELECT unnest(range(0, 2400)) AS i))
SELECT night, user_id, CAST(count(*) FILTER (h < 150) AS BIGINT) AS error, CAST(count(*) FILTER (h >= 150 AND h < 200) AS BIGINT) AS purchase, CAST(count(*) FILTER (h >= 200) AS BIGINT) AS view FROM e GROUP BY ALL""")  # fmt: skip
def scheduler_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simulated nights, counted by target and outcome."""
    s = jobs.simulate(spark, 5, 480)
    return s.groupBy("night", "user_id").pivot("event_type", ["error", "purchase", "view"]).count().na.fill(0)
