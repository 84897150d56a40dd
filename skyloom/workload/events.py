"""Event log queries: ``events`` as frames (user = configuration, error = failed) and as a job log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import sessions as op
from ..registry import query
from ..sources.tables import micros, table

HOUR = 3_600_000_000
GAP = 6 * HOUR

_EV = "SELECT event_id, user_id, event_type, value, props, epoch_us(ts) AS at_us FROM events"
_NUM = f"""
e AS ({_EV}),
g AS (SELECT *, CASE WHEN lag(at_us) OVER w IS NULL OR at_us - lag(at_us) OVER w > {GAP} THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY at_us, event_id)),
s AS (SELECT * EXCLUDE (new), CAST(sum(new) OVER (PARTITION BY user_id ORDER BY at_us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM g)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props", micros("ts").alias("at_us"))


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.number_gaps(frames(spark, sf_dir), ["user_id"], "at_us", "event_id", GAP)


def gap_sessions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.session_summary(numbered(spark, sf_dir), ["user_id", "session_no"], "at_us", F.col("event_type") == "error", F.col("value"))


_GAP_SQL = f"""WITH {_NUM}
SELECT user_id, session_no, count(*) AS frame_count, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS failed_count,
       greatest(0, count(*) - count(*) FILTER (event_type = 'error')) AS usable, min(at_us) AS started_at, max(at_us) AS ended_at,
       nullif(round(coalesce(sum(value) FILTER (event_type <> 'error'), 0), 6), 0) AS integration
FROM s GROUP BY user_id, session_no"""


@query("gap_sessions", _GAP_SQL)
def gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gap_sessions_of(spark, sf_dir)


@query("user_rollup", f"""WITH x AS ({_GAP_SQL})
SELECT user_id, count(*) AS sessions, CAST(sum(frame_count) AS BIGINT) AS frames, CAST(sum(usable) AS BIGINT) AS usable, max(ended_at) AS last_at,
       round(coalesce(sum(integration), 0), 4) AS integration FROM x GROUP BY user_id""")  # fmt: skip
def user_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions and their per-user rollup: both aggregates keep the sessions' partitioning by user."""
    return gap_sessions_of(spark, sf_dir).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("sessions"), F.sum("frame_count").alias("frames"), F.sum("usable").alias("usable"), F.max("ended_at").alias("last_at"),
        F.round(F.coalesce(F.sum("integration"), F.lit(0.0)), 4).alias("integration"),
    )


@query("renumber_sequence", f"WITH {_NUM} SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY session_no, at_us, event_id) AS BIGINT) AS idx FROM s")
def renumber_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("session_no", "at_us", "event_id")
    return numbered(spark, sf_dir).select("event_id", "user_id", F.row_number().over(w).cast("long").alias("idx"))


_NIGHT_SQL = "CAST(CAST(DATE '1970-01-01' + CAST(floor((at_us - 43200000000) / 86400000000.0) AS INTEGER) AS DATE) AS VARCHAR)"
_TALLY = f"""t AS (SELECT user_id, {_NIGHT_SQL} AS night, CAST(count(*) FILTER (event_type IN ('view', 'click')) AS BIGINT) AS good, CAST(count(*) FILTER (event_type = 'purchase') AS BIGINT) AS rescued,
       CAST(count(*) FILTER (event_type = 'signup') AS BIGINT) AS untriaged, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS junk, max(at_us) AS newest FROM ({_EV}) GROUP BY ALL)"""


def tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return frames(spark, sf_dir).withColumn("night", op.night(F.col("at_us"))).groupBy("user_id", "night").agg(
        F.count_if(kind.isin("view", "click")).alias("good"), F.count_if(kind == "purchase").alias("rescued"), F.count_if(kind == "signup").alias("untriaged"),
        F.count_if(kind == "error").alias("junk"), F.max("at_us").alias("newest"),
    )


@query("night_totals", f"WITH {_TALLY} SELECT night, CAST(sum(good) AS BIGINT) AS good, CAST(sum(junk) AS BIGINT) AS junk, count(*) AS users FROM t GROUP BY night")
def night_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tallies(spark, sf_dir).groupBy("night").agg(F.sum("good").alias("good"), F.sum("junk").alias("junk"), F.count(F.lit(1)).alias("users"))


NOW = 1_706_500_000_000_000  # 2024-01-29T03:46:40Z


@query("night_verdicts", f"""WITH {_TALLY}
SELECT user_id, night, (good + rescued) * 3e2 AS usable_s,
       CASE WHEN {NOW} - newest < 3600000000 OR untriaged > 2 THEN 'waiting' WHEN (good + rescued) * 3e2 >= 9e2 THEN 'keep' ELSE 'scrap' END AS verdict FROM t""")  # fmt: skip
def night_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled per night: keep with enough usable time, wait while frames are fresh or untriaged, else scrap."""
    usable = (F.col("good") + F.col("rescued")) * 300.0
    waits = (F.lit(NOW) - F.col("newest") < HOUR) | (F.col("untriaged") > 2)
    return tallies(spark, sf_dir).select("user_id", "night", usable.alias("usable_s"), F.when(waits, "waiting").when(usable >= 900.0, "keep").otherwise("scrap").alias("verdict"))


@query("folder_all_kept", f"""WITH {_TALLY}, v AS (SELECT user_id, user_id % 20 AS folder, CASE WHEN good + rescued >= 3 THEN 'keep' ELSE 'scrap' END AS verdict FROM t)
SELECT folder, bool_and(verdict = 'keep') AS all_kept, bool_and(verdict = 'scrap') AS all_scrap, count(*) AS nights FROM v GROUP BY folder""")  # fmt: skip
def folder_all_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = tallies(spark, sf_dir).select((F.col("user_id") % 20).alias("folder"), F.when(F.col("good") + F.col("rescued") >= 3, "keep").otherwise("scrap").alias("verdict"))
    return v.groupBy("folder").agg(F.every(F.col("verdict") == "keep").alias("all_kept"), F.every(F.col("verdict") == "scrap").alias("all_scrap"), F.count(F.lit(1)).alias("nights"))


@query("fail_streaks", f"""WITH e AS ({_EV}), i AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY at_us, event_id ROWS UNBOUNDED PRECEDING) AS isl FROM e)
SELECT event_id, user_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, isl ORDER BY at_us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM i""")  # fmt: skip
def fail_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return op.streaks(frames(spark, sf_dir), ["user_id"], ["at_us", "event_id"], kind == "error", kind == "purchase").select("event_id", "user_id", "streak")


@query("stall_detection", f"""WITH e AS ({_EV}), c AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN at_us END AS ch FROM e WINDOW w AS (PARTITION BY user_id ORDER BY at_us, event_id))
SELECT event_id, at_us - last_value(ch IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY at_us, event_id ROWS UNBOUNDED PRECEDING) > 43200000000 AS stalled FROM c""")  # fmt: skip
def stall_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.stalled(frames(spark, sf_dir), ["user_id"], ["at_us", "event_id"], "at_us", F.col("event_type"), 12 * HOUR).select("event_id", "stalled")


@query("counter_rate", f"""WITH e AS ({_EV}) SELECT event_id, round(CASE WHEN at_us - lag(at_us) OVER w > 0 THEN greatest(0.0, (value - lag(value) OVER w) / ((at_us - lag(at_us) OVER w))) END * 3.6e9, 6) AS rate
FROM e WINDOW w AS (PARTITION BY user_id ORDER BY at_us, event_id)""")  # fmt: skip
def counter_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.rate(frames(spark, sf_dir), ["user_id"], ["at_us", "event_id"], "at_us", "value").select("event_id", F.round(F.col("rate") * 3.6e9, 6).alias("rate"))


@query("progress_running_max", f"WITH e AS ({_EV}) SELECT event_id, user_id, event_type, max(value) OVER (PARTITION BY user_id, event_type ORDER BY at_us, event_id ROWS UNBOUNDED PRECEDING) AS progress FROM e")
def progress_running_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.running_max(frames(spark, sf_dir), ["user_id", "event_type"], ["at_us", "event_id"], "value", "progress").select("event_id", "user_id", "event_type", "progress")


@query("job_progress", f"""WITH e AS ({_EV}), c AS (SELECT user_id, max_by(event_type, at_us) AS current, count(DISTINCT event_type) FILTER (event_type <> 'error') AS done FROM e GROUP BY user_id)
SELECT c.user_id, c.current, c.done, max(e.value) AS fraction FROM c JOIN e ON e.user_id = c.user_id AND e.event_type = c.current GROUP BY ALL""")  # fmt: skip
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct finished steps, the current step and the largest fraction it reported: one pass per job."""
    e = frames(spark, sf_dir)
    steps = e.groupBy("user_id", "event_type").agg(F.max("at_us").alias("last"), F.max("value").alias("fraction"))
    return steps.groupBy("user_id").agg(F.max_by("event_type", "last").alias("current"), F.count_if(F.col("event_type") != "error").alias("done"), F.max_by("fraction", "last").alias("fraction"))


@query("throughput_30m", f"""WITH b AS (SELECT unnest(range(0, 12)) AS slot), e AS (SELECT CAST(floor((at_us - ({NOW} - 6 * {HOUR})) / 1800000000.0) AS BIGINT) AS slot, event_type FROM ({_EV}))
SELECT b.slot, CAST(count(*) FILTER (event_type = 'purchase') AS BIGINT) AS completed, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS failed FROM b LEFT JOIN e USING (slot) GROUP BY b.slot""")  # fmt: skip
def throughput_30m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six hours before now in half hours, empty ones included."""
    e = frames(spark, sf_dir).filter((F.col("at_us") >= NOW - 6 * HOUR) & (F.col("at_us") < NOW))
    counts = e.groupBy(F.floor((F.col("at_us") - (NOW - 6 * HOUR)) / F.lit(1.8e9)).cast("long").alias("slot")).agg(F.count_if(F.col("event_type") == "purchase").alias("completed"), F.count_if(F.col("event_type") == "error").alias("failed"))
    return spark.range(12).withColumnRenamed("id", "slot").join(counts, "slot", "left").na.fill(0)


@query("status_counts", "SELECT s.status, count(e.event_id) AS n FROM (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view'), ('cancelled')) s(status) LEFT JOIN events e ON e.event_type = s.status GROUP BY 1")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([(x,) for x in ("click", "error", "purchase", "signup", "view", "cancelled")], "status string")
    n = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return known.join(n, "status", "left").na.fill(0)


@query("metrics_exposition", "SELECT 'jobs{status=\"' || event_type || '\"} ' || CAST(count(*) AS VARCHAR) AS line FROM events GROUP BY event_type")
def metrics_exposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.format_string('jobs{status="%s"} %d', "event_type", "n").alias("line"))


@query("rescue_share", "SELECT user_id, CASE WHEN count(*) FILTER (event_type IN ('error', 'purchase')) >= 5 THEN round(avg(CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'error' THEN 0.0 END), 9) END AS share FROM events GROUP BY user_id")
def rescue_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = F.when(F.col("event_type") == "purchase", 1.0).when(F.col("event_type") == "error", 0.0)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.when(F.count(judged) >= 5, F.round(F.avg(judged), 9)).alias("share"))


@query("version_diff", f"""WITH e AS ({_EV}), v AS (SELECT event_id, user_id, at_us, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type FROM e),
l AS (SELECT v.*, lag(k) OVER w AS pk, lag(event_type) OVER w AS pt FROM v WINDOW w AS (PARTITION BY user_id ORDER BY at_us, event_id))
SELECT event_id, concat_ws(', ', CASE WHEN pk IS DISTINCT FROM k THEN 'k: ' || coalesce(CAST(pk AS VARCHAR), 'none') || ' -> ' || CAST(k AS VARCHAR) END,
  CASE WHEN pt IS DISTINCT FROM event_type THEN 'type: ' || coalesce(pt, 'none') || ' -> ' || event_type END) AS label FROM l""")  # fmt: skip
def version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed against the previous entry of the same history."""
    w = Window.partitionBy("user_id").orderBy("at_us", "event_id")
    now = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("type"), F.col("event_type"))
    rows = frames(spark, sf_dir).withColumn("now", now).withColumn("old", F.lag("now").over(w))
    part = lambda key: F.when(~F.col("now")[key].eqNullSafe(F.col("old")[key]), F.concat(F.lit(f"{key}: "), F.coalesce(F.col("old")[key], F.lit("none")), F.lit(" -> "), F.col("now")[key]))
    return rows.select("event_id", F.concat_ws(", ", part("k"), part("type")).alias("label"))


@query("warning_phrases", "SELECT event_id, event_type, props FROM events WHERE regexp_matches(lower(event_type || ' ' || props), 'error|\"k\": 1[0-3]}')")
def warning_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "event_type", "props").filter(F.lower(F.concat_ws(" ", "event_type", "props")).rlike('error|"k": 1[0-3]\\}'))


@query("night_pivot", f"WITH e AS (SELECT *, {_NIGHT_SQL} AS night FROM ({_EV})) SELECT night, CAST(count(*) FILTER (event_type = 'click') AS BIGINT) AS click, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS error, CAST(count(*) FILTER (event_type = 'view') AS BIGINT) AS view FROM e GROUP BY night")
def night_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).withColumn("night", op.night(F.col("at_us"))).groupBy("night").pivot("event_type", ["click", "error", "view"]).count().na.fill(0)


@query("confusion_counts", "SELECT value > 50 AS predicted, event_type = 'error' AS actual, count(*) AS n FROM events GROUP BY ALL")
def confusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy((F.col("value") > 50).alias("predicted"), (F.col("event_type") == "error").alias("actual")).agg(F.count(F.lit(1)).alias("n"))


@query("collapse_interrupted", f"WITH e AS ({_EV}), l AS (SELECT *, lead(1) OVER (PARTITION BY user_id ORDER BY at_us, event_id) AS nx FROM e) SELECT event_id, user_id FROM l WHERE NOT (event_type IN ('click', 'view') AND nx IS NOT NULL)")
def collapse_interrupted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.collapse_runs(frames(spark, sf_dir), ["user_id"], ["at_us", "event_id"], F.col("event_type").isin("click", "view")).select("event_id", "user_id")


@query("event_tail", f"WITH e AS ({_EV}), n AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY at_us, event_id) - 1 AS BIGINT) AS seq FROM e) SELECT user_id, seq, event_id, event_type FROM n WHERE seq > 20")
def event_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events after a cursor; sequence numbers are dense from 0."""
    w = Window.partitionBy("user_id").orderBy("at_us", "event_id")
    return frames(spark, sf_dir).select("user_id", (F.row_number().over(w) - 1).cast("long").alias("seq"), "event_id", "event_type").filter("seq > 20")


@query("seq_assign", f"WITH e AS ({_EV}) SELECT event_id, CAST(coalesce(m.top, -1) + row_number() OVER (PARTITION BY e.user_id ORDER BY at_us, event_id) AS BIGINT) AS seq FROM e LEFT JOIN (SELECT user_id, max(event_id) % 7 AS top FROM events GROUP BY user_id) m ON m.user_id = e.user_id WHERE e.event_type = 'view'")
def seq_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New events continue each log's sequence: COALESCE(MAX(seq), -1) + 1, 2, ..."""
    e = frames(spark, sf_dir)
    top = e.groupBy("user_id").agg((F.max("event_id") % 7).alias("top"))
    w = Window.partitionBy("user_id").orderBy("at_us", "event_id")
    return e.filter("event_type = 'view'").join(top, "user_id", "left").select("event_id", (F.coalesce("top", F.lit(-1).cast("long")) + F.row_number().over(w)).alias("seq"))


@query("spread_sample", f"""WITH e AS ({_EV}), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY at_us, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM e)
SELECT event_id, user_id FROM r WHERE n <= 12 OR list_contains(list_transform(range(0, 12), lambda x: x * n // 12), i)""")  # fmt: skip
def spread_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.spread_sample(frames(spark, sf_dir), ["user_id"], ["at_us", "event_id"], 12).select("event_id", "user_id")


@query("reference_medians", f"""WITH e AS ({_EV}), g AS (SELECT * FROM e WHERE event_type <> 'error'), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY at_us, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM g),
s AS (SELECT * FROM r WHERE n <= 12 OR list_contains(list_transform(range(0, 12), lambda x: x * n // 12), i))
SELECT user_id, CASE WHEN count(*) < 3 THEN CAST('inf' AS DOUBLE) ELSE round(median(value), 6) END AS reference FROM s GROUP BY user_id""")  # fmt: skip
def reference_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median of at most 12 evenly spread good frames; fewer than 3 set a bar that nothing reaches."""
    good = op.spread_sample(frames(spark, sf_dir).filter("event_type <> 'error'"), ["user_id"], ["at_us", "event_id"], 12)
    return good.groupBy("user_id").agg(F.when(F.count(F.lit(1)) < 3, F.lit(float("inf"))).otherwise(F.round(F.median("value"), 6)).alias("reference"))


@query("rescue_rule", f"""WITH m AS (SELECT user_id, median(value) AS ref FROM events GROUP BY user_id) SELECT e.event_id, value >= 0.5 * ref AND value >= 5.0 AND (CAST(json_extract_string(props, '$.k') AS BIGINT) <= 90) AS rescued
FROM events e JOIN m USING (user_id) WHERE event_type = 'error'""")  # fmt: skip
def rescue_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three thresholds against the group's reference: relative, absolute and size (missing passes)."""
    e = table(spark, sf_dir, "events")
    ref = e.groupBy("user_id").agg(F.median("value").alias("ref"))
    size = F.get_json_object("props", "$.k").try_cast("long")
    ok = (F.col("value") >= 0.5 * F.col("ref")) & (F.col("value") >= 5.0) & F.coalesce(size <= 90, F.lit(True))
    return e.filter("event_type = 'error'").join(ref, "user_id").select("event_id", ok.alias("rescued"))


@query("skymap_cells", f"""WITH e AS (SELECT *, {_NIGHT_SQL} AS night, CAST(floor(value / 5) * 5 AS BIGINT) AS alt, CAST(floor(((user_id * 37) % 360) / 5) * 5 AS BIGINT) AS az FROM ({_EV})),
c AS (SELECT alt, az, CAST(count(*) FILTER (event_type <> 'error') AS BIGINT) AS good, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS failed, list_sort(list(DISTINCT night)) AS nights FROM e GROUP BY alt, az)
SELECT CAST(alt AS VARCHAR) || '/' || CAST(az AS VARCHAR) AS cell, good, failed, array_to_string(list_slice(nights, greatest(1, len(nights) - 9), len(nights)), ',') AS nights,
       CASE WHEN good + failed < 5 THEN 'unknown' WHEN failed >= 0.5 * (good + failed) THEN 'blocked' ELSE 'open' END AS verdict FROM c""")  # fmt: skip
def skymap_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-degree cells with counts and at most their last ten nights."""
    from ..functions.sphere import cell_key

    e = frames(spark, sf_dir).select("event_type", op.night(F.col("at_us")).alias("night"), cell_key(F.col("value"), (F.col("user_id") * 37).cast("double")).alias("cell"))
    cells = e.groupBy("cell").agg(F.count_if(F.col("event_type") != "error").alias("good"), F.count_if(F.col("event_type") == "error").alias("failed"), F.array_sort(F.collect_set("night")).alias("all"))
    tail = F.slice("all", F.greatest(F.lit(1), F.size("all") - 9), 10)
    n = F.col("good") + F.col("failed")
    verdict = F.when(n < 5, "unknown").when(F.col("failed") >= 0.5 * n, "blocked").otherwise("open")
    return cells.select("cell", "good", "failed", F.concat_ws(",", tail).alias("nights"), verdict.alias("verdict"))


@query("overlap_assign", f"""WITH {_NUM}, c AS (SELECT user_id * 10000 + session_no AS cluster, user_id * 10000 + (at_us // (2 * 86400000000)) % 1000 AS old, count(*) AS overlap FROM s GROUP BY ALL)
SELECT cluster, max_by(old, overlap * 100000000 + (100000000 - 1 - old)) AS best_old, max(overlap) AS overlap FROM c GROUP BY cluster""")  # fmt: skip
def overlap_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each new cluster the old session with which it shares most frames; ties to the smaller id."""
    s = numbered(spark, sf_dir).select((F.col("user_id") * 10_000 + F.col("session_no")).alias("cluster"), (F.col("user_id") * 10_000 + F.expr("at_us div 172800000000") % 1000).alias("old"))
    n = s.groupBy("cluster", "old").agg(F.count(F.lit(1)).alias("overlap"))
    return n.groupBy("cluster").agg(F.max_by("old", F.struct("overlap", -F.col("old"))).alias("best_old"), F.max("overlap").alias("overlap"))


@query("stable_session_ids", f"""WITH RECURSIVE {_NUM}, c AS (SELECT user_id, user_id * 10000 + session_no AS cluster, user_id * 10000 + (at_us // (2 * 86400000000)) % 1000 AS old, count(*) AS overlap FROM s GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY overlap DESC, old, cluster) AS i FROM c),
r AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS cs, CAST([] AS BIGINT[]) AS os FROM o UNION ALL
SELECT r.user_id, o.i, CASE WHEN list_contains(cs, cluster) OR list_contains(os, old) THEN cs ELSE list_append(cs, cluster) END, CASE WHEN list_contains(cs, cluster) OR list_contains(os, old) THEN os ELSE list_append(os, old) END
FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)
SELECT unnest(cs) AS cluster, unnest(os) AS old FROM r WHERE i = (SELECT max(i) FROM o WHERE o.user_id = r.user_id)""")  # fmt: skip
def stable_session_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New clusters keep the id of the old session that they share most frames with, one to one."""
    s = numbered(spark, sf_dir).select((F.col("user_id") * 10_000 + F.col("session_no")).alias("cluster"), (F.col("user_id") * 10_000 + F.expr("at_us div 172800000000") % 1000).alias("old"))
    return op.stable_ids(s.groupBy("cluster", "old").agg(F.count(F.lit(1)).alias("overlap")))
