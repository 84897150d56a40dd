"""Edit histories, labels and small functions: orders as versions of a customer's project."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import values as va
from ..registry import query
from ..sources.tables import micros, table


@query("preview_pick", """WITH h AS (SELECT o_custkey AS project, o_orderkey AS seq, o_orderstatus = 'F' AS rendered, o_orderkey % 50 = 0 AS cover, max(o_orderkey) OVER (PARTITION BY o_custkey) AS newest FROM orders)
SELECT project, arg_min(seq, CASE WHEN cover THEN 0 WHEN seq = newest THEN 1 ELSE 2 END * 10000000 + (newest - seq)) AS pick FROM h WHERE rendered GROUP BY project""")  # fmt: skip
def preview_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cover if it is rendered, else the current version, else the newest rendered one."""
    o = table(spark, sf_dir, "orders")
    newest = F.max("o_orderkey").over(Window.partitionBy("o_custkey"))
    h = o.withColumn("newest", newest).filter("o_orderstatus = 'F'")
    rank = F.struct(F.when(F.col("o_orderkey") % 50 == 0, 0).when(F.col("o_orderkey") == F.col("newest"), 1).otherwise(2), F.col("newest") - F.col("o_orderkey"))
    return h.groupBy(F.col("o_custkey").alias("project")).agg(F.min_by("o_orderkey", rank).alias("pick"))


@query("render_update", """WITH h AS (SELECT o_custkey, o_orderkey, o_orderpriority, lag(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous FROM orders)
SELECT o_custkey, max(o_orderkey) AS newest, arg_max(coalesce(previous, -1), o_orderkey) AS previous FROM h WHERE NOT starts_with(o_orderpriority, '5') GROUP BY o_custkey""")  # fmt: skip
def render_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest entry that touches a session, and the last render before it."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    done = F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))
    h = table(spark, sf_dir, "orders").withColumn("previous", F.lag(done, 1).over(w)).withColumn("previous", F.last(done, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return h.filter(~F.col("o_orderpriority").startswith("5")).groupBy("o_custkey").agg(F.max("o_orderkey").alias("newest"), F.max_by(F.coalesce("previous", F.lit(-1).cast("long")), "o_orderkey").alias("previous"))


@query("layered_params", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'id' WHEN p_size > 10 THEN 'kind' ELSE 'default' END AS mode, CASE WHEN p_size > 10 THEN '2' ELSE '1' END AS sigma FROM part")
def layered_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults under the kind's layer under the node's."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    lit = lambda **kv: F.create_map(*(F.lit(x) for p in kv.items() for x in p))
    kind = F.when(F.col("p_size") > 10, lit(mode="kind", sigma="2")).otherwise(none)
    own = F.when(F.col("p_partkey") % 2 == 0, lit(mode="id")).otherwise(none)
    return table(spark, sf_dir, "part").withColumn("m", va.layered(lit(mode="default", sigma="1"), kind, own)).select("p_partkey", F.col("m")["mode"].alias("mode"), F.col("m")["sigma"].alias("sigma"))


@query("migrate_params", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'old_gain' ELSE '' END AS dropped, CAST(CASE WHEN p_size % 3 = 0 THEN 1 ELSE 2 END AS INTEGER) AS kept FROM part")
def migrate_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overrides that the new schema does not know are dropped and named."""
    live = F.array(F.lit("mode"), F.lit("sigma"))
    m = F.when(F.col("p_size") % 3 == 0, F.create_map(F.lit("mode"), F.lit("a"), F.lit("old_gain"), F.lit("7"))).otherwise(F.create_map(F.lit("mode"), F.lit("a"), F.lit("sigma"), F.lit("3")))
    x = table(spark, sf_dir, "part").withColumn("m", m)
    kept = F.map_filter("m", lambda k, v: F.array_contains(live, k))
    return x.select("p_partkey", F.array_join(F.array_except(F.map_keys("m"), live), ",").alias("dropped"), F.size(F.map_keys(kept)).alias("kept"))


@query("legacy_map", "SELECT o_custkey, max(CASE WHEN r = 1 THEN o_orderkey END) AS a, max(CASE WHEN r = 2 THEN o_orderkey END) AS b FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) GROUP BY o_custkey")
def legacy_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of values by position as a map by name."""
    ids = F.array(F.lit("a"), F.lit("b"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")  # as many of each as there are names
    x = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("r")).filter("r <= 2")
    x = x.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("l"))
    n = F.least(F.size("l"), F.lit(2))
    m = F.map_from_arrays(F.slice(ids, F.lit(1), n), F.slice("l", F.lit(1), n))
    return x.withColumn("m", m).select("o_custkey", F.try_element_at("m", F.lit("a")).alias("a"), F.try_element_at("m", F.lit("b")).alias("b"))


@query("orphans_by_scan", "SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' AND o_orderstatus <> 'P'")
def orphans_by_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows under the scanned root that this scan did not touch."""
    return table(spark, sf_dir, "orders").filter((micros("o_orderdate") < 820_454_400_000_000) & (F.col("o_orderstatus") != "P")).select("o_orderkey")


@query("scan_breakdown", "SELECT CASE WHEN o_orderstatus = 'F' THEN 'added' WHEN o_orderstatus = 'O' THEN 'unchanged' ELSE 'updated' END AS action, o_orderpriority AS scope, count(*) AS n FROM orders GROUP BY ALL")
def scan_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.when(F.col("o_orderstatus") == "F", "added").when(F.col("o_orderstatus") == "O", "unchanged").otherwise("updated")
    return table(spark, sf_dir, "orders").groupBy(action.alias("action"), F.col("o_orderpriority").alias("scope")).agg(F.count(F.lit(1)).alias("n"))


@query("best_gain_first", "SELECT o_orderkey, round(1 - sqrt(o_totalprice / (o_totalprice + 7200)), 9) AS gain FROM orders ORDER BY 1 - sqrt(o_totalprice / (o_totalprice + 7200)) DESC, o_orderkey LIMIT 25")
def best_gain_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By what two more hours would bring."""
    gain = F.element_at(va.advice(F.col("o_totalprice")), 2)["noise_drop"]
    return table(spark, sf_dir, "orders").select("o_orderkey", gain.alias("g")).orderBy(F.desc("g"), "o_orderkey").limit(25).select("o_orderkey", F.round("g", 9).alias("gain"))


@query("local_midnight", "SELECT event_id, CAST(floor((epoch_us(ts) - CAST(121.3 / 15 * 3600e6 AS BIGINT) + 43200000000 - 1) / 86400e6) * 86400000000 + CAST(121.3 / 15 * 3600e6 AS BIGINT) AS BIGINT) AS midnight FROM events")
def local_midnight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest midnight by the longitude's solar time; at noon the earlier one."""
    shift = round(121.3 / 15 * 3600e6)
    day = F.floor((micros("ts") - shift + 43_200_000_000 - 1) / F.lit(86_400e6)).cast("long")
    return table(spark, sf_dir, "events").select("event_id", (day * 86_400_000_000 + shift).alias("midnight"))


@query("settled_gate", "SELECT user_id, 1706500000000000 - max(epoch_us(ts)) >= 3600000000 AS settled, 1706500000000000 - max(epoch_us(ts)) < 120000000 AS alive FROM events GROUP BY user_id")
def settled_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = F.lit(1_706_500_000_000_000) - F.max(micros("ts"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg((age >= 3_600_000_000).alias("settled"), (age < 120_000_000).alias("alive"))


@query("content_keys", "SELECT p_partkey, sha256(p_name || '|' || p_type) AS key, md5(p_brand) AS brand_key FROM part")
def content_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.sha2(F.concat_ws("|", "p_name", "p_type"), 256).alias("key"), F.md5("p_brand").alias("brand_key"))


@query("plan_order", "SELECT CAST(row_number() OVER (ORDER BY p_type, coalesce(CASE WHEN p_size > 5 THEN p_brand END, ''), p_partkey) AS INTEGER) AS pos, p_partkey FROM part QUALIFY pos <= 100")
def plan_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stable order by target and filter, an unknown filter first; the first page."""
    order = ["p_type", F.coalesce(F.when(F.col("p_size") > 5, F.col("p_brand")), F.lit("")), "p_partkey"]
    page = table(spark, sf_dir, "part").orderBy(*order).limit(100)
    return page.select(F.row_number().over(Window.orderBy(*order)).alias("pos"), "p_partkey")
