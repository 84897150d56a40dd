"""What to observe next, and the dataflow planner on the nations' graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sphere as sp
from ..functions import values as va
from ..operators import scheduling
from ..operators import sessions as op
from ..plans import dag, jobs, nodes  # noqa: F401  (registers the bodies)
from ..registry import query
from ..sources.tables import micros, table
from .sky import _ALT, _GRID, _LST, _TGT, DUSK, LAT, LON, _grid, targets


@query("planner_rank", f"""WITH {_TGT}, {_GRID}, v AS (SELECT tid, count(*) FILTER (alt >= 30) * 5 / 60.0e0 AS hours, max(alt) AS best FROM a GROUP BY tid),
s AS (SELECT v.*, CASE WHEN c_acctbal > 8000 THEN 3 WHEN c_mktsegment = 'BUILDING' THEN 2 ELSE 1 END * (0.3e0 + 0.7e0 * least(1.0e0, hours / 4)) AS score FROM v JOIN customer ON c_custkey = tid WHERE hours > 0)
SELECT CAST(row_number() OVER (ORDER BY round(score, 9) DESC, hours DESC, round(best, 6) DESC, tid) AS INTEGER) AS pos, tid, round(score, 6) AS score FROM s QUALIFY pos <= 100""")  # fmt: skip
def planner_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appeal times session factor, among what rises high enough tonight; the best hundred."""
    v = _grid(spark, targets(spark, sf_dir).select("tid", "ra", "dec")).groupBy("tid").agg((F.count_if(F.col("alt") >= 30) * 5 / F.lit(60.0)).alias("hours"), F.max("alt").alias("best")).filter("hours > 0")
    c = table(spark, sf_dir, "customer")
    appeal = F.when(F.col("c_acctbal") > 8000, 3).when(F.col("c_mktsegment") == "BUILDING", 2).otherwise(1)
    s = v.join(c, F.col("tid") == F.col("c_custkey")).withColumn("score", appeal * (0.3 + 0.7 * F.least(F.lit(1.0), F.col("hours") / 4)))
    top = s.orderBy(F.desc(F.round("score", 9)), F.desc("hours"), F.desc(F.round("best", 6)), "tid").limit(100)
    w = Window.orderBy(F.desc(F.round("score", 9)), F.desc("hours"), F.desc(F.round("best", 6)), "tid")
    return top.select(F.row_number().over(w).alias("pos"), "tid", F.round("score", 6).alias("score"))


@query("pick_next_target", f"""WITH {_TGT}, g AS (SELECT *, {_LST.format(t=DUSK, lon=LON)} AS lst FROM tgt), a AS (SELECT tid, {_ALT.format(lat=LAT)} AS alt FROM g),
s AS (SELECT tid, alt, (1 - sqrt((1 + abs(c_acctbal)) / (1 + abs(c_acctbal) + 3600))) * power(sin(radians(alt)), 2) AS score FROM a JOIN customer ON c_custkey = tid WHERE alt >= 25)
SELECT tid, round(score, 9) AS score FROM s ORDER BY tid = 42 DESC, s.score DESC, tid LIMIT 1""")  # fmt: skip
def pick_next_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The incumbent while it is usable, else the most gain times the square of the altitude's sine."""
    alt = sp.altitude(F.col("ra"), F.col("dec"), F.lit(LAT), sp.sidereal(F.lit(DUSK), F.lit(LON)))
    gain = va.noise_drop(1 + F.abs("bal"), F.lit(3600.0))
    s = targets(spark, sf_dir).withColumn("alt", alt).filter("alt >= 25").withColumn("score", gain * F.pow(F.sin(F.radians("alt")), 2))
    return s.orderBy(F.desc(F.col("tid") == 42), F.desc("score"), "tid").limit(1).select("tid", F.round("score", 9).alias("score"))


@query("usable_targets", f"""WITH {_TGT}, g0 AS (SELECT *, {_LST.format(t=DUSK, lon=LON)} AS lst FROM tgt), a0 AS (SELECT tid, ra, dec, {_ALT.format(lat=LAT)} AS alt0 FROM g0),
g1 AS (SELECT tid, ra, dec, alt0, {_LST.format(t=DUSK + 1200000000, lon=LON)} AS lst FROM a0), a1 AS (SELECT tid, ra, dec, alt0, {_ALT.format(lat=LAT)} AS alt1 FROM g1)
SELECT tid FROM a1 WHERE alt0 >= 20 AND alt1 >= 20 AND CAST(floor(alt0 / 5) * 5 AS BIGINT) % 15 <> 0 AND degrees(acos(greatest(-1, least(1, sin(radians(dec)) * sin(radians(20.0e0)) + cos(radians(dec)) * cos(radians(20.0e0)) * cos(radians(ra - 100.0e0)))))) >= 10""")  # fmt: skip
def usable_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High enough now and in twenty minutes, not in a blocked cell, not near the moon."""
    at = lambda t: sp.altitude(F.col("ra"), F.col("dec"), F.lit(LAT), sp.sidereal(F.lit(t), F.lit(LON)))
    moon = sp.cosine_separation(F.col("ra"), F.col("dec"), F.lit(100.0), F.lit(20.0))
    x = targets(spark, sf_dir).withColumn("a0", at(DUSK)).withColumn("a1", at(DUSK + 1_200_000_000))
    blocked = (F.floor(F.col("a0") / 5) * 5).cast("long") % 15 == 0
    return x.filter((F.col("a0") >= 20) & (F.col("a1") >= 20) & ~blocked & (moon >= 10)).select("tid")


@query("more_time", "SELECT o_orderkey, CASE WHEN CASE WHEN o_orderpriority LIKE '5%' THEN NULL ELSE o_totalprice / 100000 END IS NULL THEN o_orderstatus = 'O' ELSE o_orderstatus <> 'F' AND CASE WHEN o_orderpriority LIKE '5%' THEN NULL ELSE o_totalprice / 100000 END > 0.5 END AS needs FROM orders")
def more_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a plan, what remains of it decides; without one, the verdict."""
    plan = F.when(~F.col("o_orderpriority").startswith("5"), F.col("o_totalprice") / 100_000)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(plan.isNull(), F.col("o_orderstatus") == "O").otherwise((F.col("o_orderstatus") != "F") & (plan > 0.5)).alias("needs"))


@query("weather_outlook", "WITH h AS (SELECT user_id % 10 AS site, hour(ts) AS hour, value FROM events) SELECT site, round(max(value), 6) AS worst, round(avg(value), 6) AS mean, round(sum(CASE WHEN hour >= 18 THEN value ELSE 0 END), 4) AS evening, CASE WHEN max(value) > 99 THEN 'rain' WHEN avg(value) > 50 THEN 'cloud' ELSE 'clear' END AS reason FROM h GROUP BY site")
def weather_outlook(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("site"), F.hour("ts").alias("hour"), "value")
    return e.groupBy("site").agg(
        F.round(F.max("value"), 6).alias("worst"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.sum(F.when(F.col("hour") >= 18, F.col("value")).otherwise(0.0)), 4).alias("evening"),
        F.when(F.max("value") > 99, "rain").when(F.avg("value") > 50, "cloud").otherwise("clear").alias("reason"),
    )


_EDGES = "e AS (SELECT n_nationkey AS dst, n_nationkey // 2 AS src FROM nation WHERE n_nationkey > 0 UNION SELECT n_nationkey, n_nationkey // 3 FROM nation WHERE n_nationkey > 2)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("dst"))
    a = n.filter("dst > 0").withColumn("src", F.expr("dst div 2"))
    return a.unionByName(n.filter("dst > 2").withColumn("src", F.expr("dst div 3"))).distinct()


@query("dag_levels", f"WITH RECURSIVE {_EDGES}, l AS (SELECT CAST(0 AS BIGINT) AS node, CAST(0 AS BIGINT) AS level UNION SELECT CAST(e.dst AS BIGINT), l.level + 1 FROM l JOIN e ON e.src = l.node) SELECT node, max(level) AS level FROM l GROUP BY node")
def dag_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest path from a source."""
    return dag.levels(_edges(spark, sf_dir))


@query("dag_successors", f"WITH {_EDGES} SELECT CAST(src AS BIGINT) AS src, array_to_string(list_sort(list(DISTINCT dst)), ',') AS dsts FROM e GROUP BY src")
def dag_successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).groupBy("src").agg(F.array_join(F.array_sort(F.collect_set("dst")), ",").alias("dsts"))


@query("dag_must_run", f"WITH RECURSIVE {_EDGES}, m AS (SELECT CAST(n_nationkey AS BIGINT) AS node FROM nation WHERE n_nationkey IN (17, 23) AND n_nationkey % 5 <> 0 UNION SELECT CAST(e.src AS BIGINT) FROM m JOIN e ON e.dst = m.node WHERE e.src % 5 <> 0) SELECT node FROM m")
def dag_must_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misses that an output needs: walked backwards from the outputs, stopping at cache hits."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("node"))
    return dag.must_run(_edges(spark, sf_dir), n.filter("node % 5 <> 0"), n.filter("node IN (17, 23)"))


_EX = """e(id, port, src, out, wide, src_wide) AS (VALUES ('convert', 'lights', 'input', 'lights', TRUE, FALSE), ('calibrate', 'sequence', 'convert', 'sequence', TRUE, TRUE), ('stack', 'sequence', 'calibrate', 'sequence', TRUE, TRUE),
('combine', 'images', 'stack', 'image', FALSE, TRUE), ('crop', 'image', 'combine', 'image', FALSE, FALSE), ('stretch', 'image', 'crop', 'image', FALSE, FALSE)), k(k) AS (VALUES ('night1'), ('night2'))"""


@query("dag_hashes", """WITH k(k) AS (VALUES ('night1'), ('night2')), a AS (SELECT k, sha256('{"inputs":{"lights":"input:lights@' || k || '"},"kind":"convert_lights","params":{},"version":1}') AS a FROM k),
b AS (SELECT k, sha256('{"inputs":{"sequence":"' || a || ':sequence"},"kind":"calibrate","params":{"exclude_uncalibratable":false},"version":2}') AS b FROM a),
c AS (SELECT k, sha256('{"inputs":{"sequence":"' || b || ':sequence"},"kind":"seq_stack","params":{"method":"rej","norm":"addscale","rejection_type":"w","sigma_high":3.0,"sigma_low":3.0},"version":1}') AS c FROM b),
d AS (SELECT sha256('{"inputs":{"images":[' || string_agg('"' || c || ':image"', ',' ORDER BY c) || ']},"kind":"combine_stacks","params":{"min_for_rejection":5,"weight":"noise"},"version":5}') AS d FROM c),
f AS (SELECT sha256('{"inputs":{"image":"' || d || ':image"},"kind":"crop","params":{"enabled":true,"height":0.0,"padding":0,"rotation":0.0,"threshold":0.001,"width":0.0,"x":0.0,"y":0.0},"version":5}') AS f FROM d),
g AS (SELECT sha256('{"inputs":{"image":"' || f || ':image"},"kind":"stretch","params":{"asinh_offset":0.0,"asinh_stretch":10.0,"auto_bg_max":0.15,"auto_bg_min":0.08,"auto_object":0.4,"linked":true,"method":"autostretch","mtf_highlights":1.0,"mtf_midtones":0.25,"mtf_shadows":0.0,"saturation":1.0,"shadows_clip":-2.8,"target_bg":0.25},"version":2}') AS g FROM f)
SELECT 'convert@' || k AS node, a AS hash FROM a UNION ALL SELECT 'calibrate@' || k, b FROM b UNION ALL SELECT 'stack@' || k, c FROM c UNION ALL SELECT 'combine', d FROM d UNION ALL SELECT 'crop', f FROM f UNION ALL SELECT 'stretch', g FROM g""")  # fmt: skip
def dag_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle hashes of the standard template, planned on the driver."""
    spec = dag.Template.from_dict(dag.EXAMPLE)
    hashes = dag.hashes(dag.expand(spec, ["night1", "night2"]))
    return spark.createDataFrame(sorted(hashes.items()), "node string, hash string")


@query("dag_expand", f"""WITH {_EX} SELECT id || '@' || k AS node, port, CASE WHEN src_wide THEN src || '@' || k || '.' || out ELSE src || '.' || out || '@' || k END AS source FROM e, k WHERE wide
UNION ALL SELECT id, port, src || '@' || k || '.' || out FROM e, k WHERE NOT wide AND src_wide UNION ALL SELECT id, port, src || '.' || out FROM e WHERE NOT wide AND NOT src_wide""")  # fmt: skip
def dag_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-session fan-out and fan-in of the template's edges."""
    wide = dag.expand(dag.Template.from_dict(dag.EXAMPLE), ["night1", "night2"])
    rows = [(n.id, port, f"{src}.{out}") for n in dag.order(wide) for port, refs in sorted(n.inputs.items()) for src, out in refs]
    return spark.createDataFrame(rows, "node string, port string, source string")


@query("param_catalog")
def param_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered node kinds and their parameters."""
    return spark.createDataFrame([(k, p, repr(d)) for k, spec in sorted(dag.KINDS.items()) for p, d in sorted(spec.params.items())], "kind string, param string, default_value string")


@query("target_churn", "SELECT user_id, CAST(sum(CASE WHEN event_type IS DISTINCT FROM prev THEN 1 ELSE 0 END) AS BIGINT) AS switches FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) GROUP BY user_id")
def target_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the scheduler's job changed."""
    e = table(spark, sf_dir, "events").withColumn("at_us", micros("ts"))
    w = op.ordered(["user_id"], ["at_us", "event_id"])
    return e.withColumn("prev", F.lag("event_type").over(w)).groupBy("user_id").agg(F.count_if(~F.col("event_type").eqNullSafe(F.col("prev"))).alias("switches"))


_REP = """n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT event_id, user_id, ts, event_type, n, CAST(n // 6 AS BIGINT) AS job, 'T' || CAST(n // 9 AS VARCHAR) AS target, row_number() OVER (PARTITION BY user_id, n // 6 ORDER BY n) AS captured,
  CAST(count(*) FILTER (event_type IN ('error', 'view')) OVER (PARTITION BY user_id, n // 6 ORDER BY n ROWS UNBOUNDED PRECEDING) AS BIGINT) AS failed, CASE WHEN user_id % 3 = 0 THEN 0.6e0 ELSE 0.1e0 END AS share FROM n),
l AS (SELECT *, lag(target) OVER o AS t0, coalesce(lag(captured) OVER o, 0) AS c0, coalesce(lag(failed) OVER o, 0) AS f0, lag(job) OVER o AS j0 FROM r WINDOW o AS (PARTITION BY user_id ORDER BY n)),
b AS (SELECT *, coalesce(target <> t0, FALSE) AS other, captured < c0 OR coalesce(job <> j0, FALSE) AS began FROM l),
d AS (SELECT *, failed - CASE WHEN began THEN 0 WHEN other THEN failed ELSE f0 END AS lost, captured - CASE WHEN began THEN 0 WHEN other THEN captured ELSE c0 END AS more FROM b),
w AS (SELECT *, more - lost AS won, more - lost > 0 OR (lost > 0 AND share >= 0.5) AS ends FROM d),
g AS (SELECT *, sum(CASE WHEN other THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY n) + coalesce(sum(CASE WHEN ends THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM w),
a AS (SELECT event_id, user_id, ts, event_type, target, CAST(lost AS BIGINT) AS fresh_failed, CAST(won AS BIGINT) AS accepted, CAST(greatest(0, won + round_even(lost * share, 0)) AS BIGINT) AS credit,
  CAST(CASE WHEN ends THEN 0 ELSE sum(lost) OVER (PARTITION BY user_id, run ORDER BY n ROWS UNBOUNDED PRECEDING) END AS BIGINT) AS streak FROM g)"""


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user is a scope whose events are status reports: six to a job, nine to a target."""
    e = table(spark, sf_dir, "events").withColumn("n", F.row_number().over(op.ordered(["user_id"], ["ts", "event_id"])))
    job = F.expr("cast(n div 6 as long)")
    w = op.ordered(["user_id", "job"], ["n"])
    e = e.withColumn("job", job).withColumn("captured", F.row_number().over(w).cast("long")).withColumn("failed", F.count_if(F.col("event_type").isin("error", "view")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.select("event_id", "user_id", "ts", "event_type", "n", "job", F.concat(F.lit("T"), F.expr("cast(n div 9 as string)")).alias("target"), "captured", "failed", F.when(F.col("user_id") % 3 == 0, 0.6).otherwise(0.1).alias("share"))


@query("target_accounting", f"WITH {_REP} SELECT event_id, target, fresh_failed, accepted, credit, streak FROM a")
def target_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New frames, credit and failed frames in a row of every status report."""
    return scheduling.account(_reports(spark, sf_dir), "user_id", ["n"]).select("event_id", "target", "fresh_failed", "accepted", "credit", "streak")


@query("scheduler_decisions", f"""WITH {_REP}, s AS (SELECT *, extract(hour FROM ts) AS h FROM a)
SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'wait' WHEN NOT (h >= 18 OR h < 6) THEN CASE WHEN event_type <> 'purchase' THEN 'stop' ELSE 'park' END WHEN event_id % 13 = 0 THEN 'stop'
 WHEN event_type <> 'purchase' THEN CASE WHEN streak >= 3 OR event_id % 19 = 0 OR event_id % 11 = 0 THEN 'leave' ELSE 'capture' END ELSE 'pick' END AS step FROM s""")  # fmt: skip
def scheduler_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scheduler's step at every status report."""
    r = scheduling.account(_reports(spark, sf_dir), "user_id", ["n"])
    hour, k = F.hour("ts"), F.col("event_id")
    facts = {"in_window": (hour >= 18) | (hour < 6), "busy": k % 17 == 0, "job_failed": k % 13 == 0, "capturing": F.col("event_type") != "purchase", "usable": k % 11 != 0, "done": k % 19 == 0}
    return scheduling.decide(r.withColumns(facts), fail_streak=3).select("event_id", "step")


_JOB = """li AS (SELECT l_suppkey AS session, count(*) FILTER (l_returnflag <> 'A') AS lights FROM lineitem GROUP BY l_suppkey), s AS (SELECT s_suppkey AS session, s_nationkey FROM supplier),
ok AS (SELECT session, s_nationkey FROM s JOIN li USING (session) WHERE lights >= 3)"""


@query("job_inputs", f"""WITH {_JOB} SELECT 'convert@' || CAST(session AS VARCHAR) || '.lights' AS key, 'lights/' || CAST(session AS VARCHAR) AS source FROM ok
UNION ALL SELECT 'calibrate@' || CAST(session AS VARCHAR) || '.' || k.kind, 'master/' || k.kind || '/' || CAST(CASE k.kind WHEN 'dark' THEN s_nationkey ELSE s_nationkey + 100 END AS VARCHAR) FROM ok, (VALUES ('dark'), ('flat')) k(kind) WHERE k.kind = 'dark' OR s_nationkey % 2 = 0""")  # fmt: skip
def job_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inputs of a job over all suppliers as sessions: their lights, and the darks and flats matched to them."""
    s = table(spark, sf_dir, "supplier")
    sessions = s.select(F.col("s_suppkey").alias("session"), F.lit("DWARF 3").alias("instrument"), F.lit(30.0).alias("exptime"), F.lit(60).alias("gain"), F.lit(1).alias("binning"))
    lights = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("session"), F.when(F.col("l_returnflag") == "A", "failed").otherwise("good").alias("quality"), F.lit(False).alias("rescued"))
    n = F.col("s_nationkey")
    kind = lambda k, no, path: s.select(F.col("s_suppkey").alias("session"), F.lit(k).alias("kind"), F.concat(F.lit(f"master/{k}/"), no.cast("string")).alias("path"))
    matches = kind("dark", n, "").unionByName(kind("flat", n + 100, "").filter("cast(substring_index(path, '/', -1) as int) % 2 = 0"))
    return jobs.inputs(dag.Template.from_dict(dag.EXAMPLE), sessions, lights, matches)
