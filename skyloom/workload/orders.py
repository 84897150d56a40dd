"""Relational catalog queries: customers as targets, orders as sessions, line items as frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import dml
from ..registry import query
from ..sources.tables import micros, table

_KEEP = "o_orderstatus = 'F'"


def _t(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [table(spark, sf_dir, n) for n in names]


@query("target_rollup", f"""SELECT c_custkey, count(DISTINCT o_orderkey) AS sessions, CAST(count(*) AS BIGINT) AS frames, max(epoch_us(o_orderdate)) AS last_at,
 round(sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity * 30 END), 4) AS integration_s, round(sum(l_extendedprice), 2) AS bytes
FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE {_KEEP} GROUP BY c_custkey""")  # fmt: skip
def target_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target: distinct sessions, frames, last date, conditional integration, bytes.

    Line items are summed per order first, so the second shuffle is one row per session.
    """
    c, o, li = _t(spark, sf_dir, "customer", "orders", "lineitem")
    per = li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("l_returnflag") != "R", F.col("l_quantity") * 30)).alias("s"), F.sum("l_extendedprice").alias("b"))
    kept = o.filter(_KEEP).select("o_orderkey", "o_custkey", micros("o_orderdate").alias("at_us"))
    x = kept.join(per, kept.o_orderkey == per.l_orderkey).join(c.select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    return x.groupBy("c_custkey").agg(
        F.count_distinct("o_orderkey").alias("sessions"), F.sum("n").alias("frames"), F.max("at_us").alias("last_at"), F.round(F.sum("s"), 4).alias("integration_s"), F.round(F.sum("b"), 2).alias("bytes")
    )


@query("session_target_left", "SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 LEFT JOIN nation ON n_nationkey = c_nationkey")
def session_target_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = _t(spark, sf_dir, "orders", "customer", "nation")
    rich = c.filter("c_acctbal > 0")
    return o.join(rich, o.o_custkey == rich.c_custkey, "left").join(n, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("o_orderkey", "c_name", "n_name")


@query("junction_join", "SELECT o_orderstatus, p_brand, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_size > 25 GROUP BY ALL")
def junction_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li, p = _t(spark, sf_dir, "orders", "lineitem", "part")
    x = li.join(p.filter("p_size > 25").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return x.groupBy("o_orderstatus", "p_brand").agg(F.count(F.lit(1)).alias("n"))


@query("target_session_count", "SELECT c_custkey, count(o_orderkey) AS sessions FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def target_session_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = _t(spark, sf_dir, "customer", "orders")
    n = o.groupBy("o_custkey").agg(F.count("o_orderkey").alias("sessions"))
    return c.join(n, c.c_custkey == n.o_custkey, "left").select("c_custkey", F.coalesce("sessions", F.lit(0).cast("long")).alias("sessions"))


@query("compound_on_join", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey AND o_totalprice > c_acctbal * 20 AND c_mktsegment <> 'BUILDING'")
def compound_on_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = _t(spark, sf_dir, "orders", "customer")
    return o.join(c, (c.c_custkey == o.o_custkey) & (o.o_totalprice > c.c_acctbal * 20) & (c.c_mktsegment != "BUILDING")).select("o_orderkey", "c_mktsegment")


@query("kept_semi", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def kept_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = _t(spark, sf_dir, "customer", "orders")
    return c.join(o.filter("o_totalprice > 300000"), c.c_custkey == o.o_custkey, "left_semi").select("c_custkey", "c_name")


@query("orphan_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def orphan_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = _t(spark, sf_dir, "customer", "orders")
    return dml.orphans(c.select("c_custkey"), o.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("scalar_subquery_bytes", "SELECT o_orderkey, (SELECT round(sum(l_extendedprice), 2) FROM lineitem WHERE l_orderkey = o_orderkey) AS bytes, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS failed FROM orders")
def scalar_subquery_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = _t(spark, sf_dir, "orders", "lineitem")
    a = li.groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("bytes"), F.count_if(F.col("l_returnflag") == "R").alias("failed"))
    return o.join(a, o.o_orderkey == a.l_orderkey, "left").select("o_orderkey", "bytes", F.coalesce("failed", F.lit(0).cast("long")).alias("failed"))


@query("mode_exposure", "SELECT l_suppkey, l_quantity AS exposure, n FROM (SELECT l_suppkey, l_quantity, count(*) AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_quantity) AS r FROM lineitem GROUP BY l_suppkey, l_quantity) WHERE r = 1")
def mode_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_quantity").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("l_suppkey").agg(F.max(F.struct("n", (-F.col("l_quantity")).alias("q"))).alias("b"))
    return best.select("l_suppkey", (-F.col("b.q")).alias("exposure"), F.col("b.n").alias("n"))


@query("capture_aggregate", "SELECT o_custkey, min(epoch_us(o_orderdate)) AS first_at, max(epoch_us(o_orderdate)) AS last_at, round(sum(o_totalprice), 2) AS total, min_by(o_orderpriority, epoch_us(o_orderdate) * 1000 + o_orderkey % 1000) AS first_priority FROM orders GROUP BY o_custkey")
def capture_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("at_us", micros("o_orderdate"))
    return o.groupBy("o_custkey").agg(
        F.min("at_us").alias("first_at"), F.max("at_us").alias("last_at"), F.round(F.sum("o_totalprice"), 2).alias("total"),
        F.min_by("o_orderpriority", F.struct("at_us", F.col("o_orderkey") % 1000)).alias("first_priority"),
    )


@query("distinct_names_joined", "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY o_custkey")
def distinct_names_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set("o_orderpriority")), ", ").alias("priorities"))


@query("swap_aggregate", "SELECT CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders WHERE o_orderkey IN (1, 2, 3, 5, 8, 13, 21, 34, 55)")
def swap_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderkey").isin(1, 2, 3, 5, 8, 13, 21, 34, 55))
    return o.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))


@query("session_summary", """SELECT o_orderkey, CAST(greatest(0, count(*) - 2 * count(*) FILTER (l_returnflag = 'R')) AS BIGINT) AS usable, nullif(round(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END), 4), 0) AS integration,
 CASE WHEN o_orderstatus = 'O' THEN max(l_linestatus) END AS resolved FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus""")  # fmt: skip
def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable frames never negative; no integration is null; a payload only for one kind of resolution."""
    o, li = _t(spark, sf_dir, "orders", "lineitem")
    a = li.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("bad"), F.sum(F.when(F.col("l_returnflag") == "N", F.col("l_quantity")).otherwise(0)).alias("s"), F.max("l_linestatus").alias("m"))
    return o.join(a, o.o_orderkey == a.l_orderkey).select("o_orderkey", F.greatest(F.lit(0).cast("long"), F.col("n") - 2 * F.col("bad")).alias("usable"), F.nullif(F.round("s", 4), F.lit(0.0)).alias("integration"), F.when(F.col("o_orderstatus") == "O", F.col("m")).alias("resolved"))


@query("in_list_semi", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%')")
def in_list_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = _t(spark, sf_dir, "lineitem", "orders")
    return li.join(o.filter(F.col("o_orderpriority").startswith("1")), li.l_orderkey == o.o_orderkey, "left_semi").select("l_orderkey", "l_linenumber")


@query("prefix_scope", "SELECT p_partkey, p_type FROM part WHERE substr(p_type, 1, 3) = 'ECO' OR substr(p_type, 1, 5) = 'SMALL'")
def prefix_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path-prefix scope; the prefix tests reach the Parquet scan."""
    return table(spark, sf_dir, "part").filter(F.col("p_type").startswith("ECO") | F.col("p_type").startswith("SMALL")).select("p_partkey", "p_type")


@query("overlay_left", "SELECT s_suppkey, s.s_name, x.n FROM supplier s LEFT JOIN (SELECT lower(trim(c_name)) AS k, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1) x ON x.k = replace(lower(trim(s.s_name)), 'supplier', 'customer')")
def overlay_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c, o = _t(spark, sf_dir, "supplier", "customer", "orders")
    n = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    x = c.join(n, c.c_custkey == n.o_custkey).groupBy(F.lower(F.trim("c_name")).alias("k")).agg(F.sum("n").alias("n"))
    return s.join(x, F.replace(F.lower(F.trim("s_name")), F.lit("supplier"), F.lit("customer")) == F.col("k"), "left").select("s_suppkey", "s_name", "n")


@query("table_counts", "SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'customer', count(*) FROM customer")
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, n).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")) for n in ("orders", "lineitem", "customer")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("fifo_oldest", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 1")
def fifo_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").orderBy("o_orderdate", "o_orderkey").limit(1).select("o_orderkey")


@query("topk_lists", "SELECT o_custkey, o_orderkey, r FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS r FROM orders) WHERE r <= 10")
def topk_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("r", F.row_number().over(w)).filter("r <= 10").select("o_custkey", "o_orderkey", "r")


@query("newest_first", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", "o_custkey")


@query("nulls_last_sort", "SELECT CAST(row_number() OVER (ORDER BY CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END DESC NULLS LAST, lower(c_name)) AS INTEGER) AS pos, c_custkey FROM customer QUALIFY pos <= 200")
def nulls_last_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls sink whichever the direction; names without case.  The page is cut before its rows are numbered."""
    order = [F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).desc_nulls_last(), F.lower("c_name")]
    page = table(spark, sf_dir, "customer").orderBy(*order).limit(200)
    return page.select(F.row_number().over(Window.orderBy(*order)).alias("pos"), "c_custkey")


@query("newest_group", "SELECT c_custkey, arg_max(o_orderkey, epoch_us(o_orderdate) * 1000 + o_orderkey % 1000) AS newest FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA' GROUP BY c_custkey")
def newest_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o, n, r = _t(spark, sf_dir, "customer", "orders", "nation", "region")
    nations = n.join(r.filter("r_name = 'ASIA'"), n.n_regionkey == r.r_regionkey)
    who = c.join(nations, c.c_nationkey == n.n_nationkey)
    return who.join(o, who.c_custkey == o.o_custkey).groupBy("c_custkey").agg(F.max_by("o_orderkey", F.struct(micros("o_orderdate"), F.col("o_orderkey") % 1000)).alias("newest"))


@query("suggest_additions", "SELECT a.o_orderkey AS suggestion, p.project FROM orders a JOIN (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS project FROM orders GROUP BY ALL) p ON p.o_custkey = a.o_custkey AND p.o_orderpriority = a.o_orderpriority WHERE a.o_orderkey <> p.project AND a.o_orderstatus <> 'F'")
def suggest_additions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of the same group and settings that the project does not have yet."""
    o = table(spark, sf_dir, "orders")
    p = o.groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("project"))
    x = o.filter("o_orderstatus <> 'F'").join(p, ["o_custkey", "o_orderpriority"])
    return x.filter(F.col("o_orderkey") != F.col("project")).select(F.col("o_orderkey").alias("suggestion"), "project")


@query("master_groups", "SELECT o_custkey, o_orderpriority, array_to_string(list_sort(list(o_orderkey)), ',') AS sessions, max(epoch_us(o_orderdate)) AS newest FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL")
def master_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").filter(_KEEP)
    return o.groupBy("o_custkey", "o_orderpriority").agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")), ",").alias("sessions"), F.max(micros("o_orderdate")).alias("newest"))


@query("master_plan", """WITH g AS (SELECT o_custkey, list(o_orderkey) AS ids, list(o_orderkey) FILTER (o_orderkey % 3 = 0) AS seen FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey),
d AS (SELECT o_custkey, len(ids) AS n, CAST(len(list_filter(ids, lambda x: NOT list_contains(coalesce(seen, []), x))) AS INTEGER) AS waiting FROM g)
SELECT o_custkey, waiting, CASE WHEN waiting = 0 THEN 'none' WHEN waiting = n THEN 'create' WHEN waiting >= 2 THEN 'extend' ELSE 'wait' END AS action FROM d""")  # fmt: skip
def master_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to do with each group: nothing new, a first master, an extension, or wait for more."""
    g = table(spark, sf_dir, "orders").filter(_KEEP).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderkey") % 3 != 0).cast("int").alias("waiting"))
    action = F.when(F.col("waiting") == 0, "none").when(F.col("waiting") == F.col("n"), "create").when(F.col("waiting") >= 2, "extend").otherwise("wait")
    return g.select("o_custkey", "waiting", action.alias("action"))


@query("folder_bytes", "SELECT substr(p_type, 1, instr(p_type || ' ', ' ') - 1) AS folder, count(*) AS files, CAST(sum(l_quantity) AS DOUBLE) AS bytes FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def folder_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p = _t(spark, sf_dir, "lineitem", "part")
    per = li.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("b"))
    return per.join(p, per.l_partkey == p.p_partkey).groupBy(F.substring_index("p_type", " ", 1).alias("folder")).agg(F.sum("n").alias("files"), F.sum("b").alias("bytes"))


@query("cascade_delete", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice < 100000)")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = _t(spark, sf_dir, "orders", "lineitem")
    gone = o.filter("o_orderstatus = 'F' AND o_totalprice < 100000").select(F.col("o_orderkey").alias("l_orderkey"))
    return dml.cascade(o.withColumnRenamed("o_orderkey", "l_orderkey"), li, gone, "l_orderkey")[1].select("l_orderkey", "l_linenumber")


@query("purge_tombstones", "SELECT o_custkey AS name, round(sum(o_totalprice), 2) AS bytes, CAST(count(*) AS BIGINT) AS sessions FROM orders GROUP BY o_custkey HAVING bool_and(o_orderstatus <> 'P')")
def purge_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders all of whose sessions may go, as tombstones."""
    o = table(spark, sf_dir, "orders")
    g = o.groupBy(F.col("o_custkey").alias("name")).agg(F.round(F.sum("o_totalprice"), 2).alias("bytes"), F.count(F.lit(1)).alias("sessions"), F.every(F.col("o_orderstatus") != "P").alias("all"))
    return g.filter("all").drop("all")


@query("preserve_user_edit", "SELECT n.o_orderkey, coalesce(e.o_custkey, n.o_custkey + 1) AS target FROM orders n LEFT JOIN (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 4 = 0) e USING (o_orderkey)")
def preserve_user_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    edited = o.filter("o_orderkey % 4 = 0").select("o_orderkey", F.col("o_custkey").alias("target"))
    return dml.refresh_keeping(edited, o.select("o_orderkey", (F.col("o_custkey") + 1).alias("target")), ["o_orderkey"], ["target"])


@query("upsert_by_key", "SELECT o_orderkey, o_totalprice AS price FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, round(o_totalprice * 2, 2) FROM orders WHERE o_orderkey % 3 = 0")
def upsert_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"))
    return dml.upsert(old, old.filter("o_orderkey % 3 = 0").withColumn("price", F.round(F.col("price") * 2, 2)), ["o_orderkey"])


@query("upsert_unless_overridden", "SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'kept' ELSE 'matched' END AS quality FROM orders")
def upsert_unless_overridden(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "orders").select("o_orderkey", F.lit("kept").alias("quality"), F.col("o_orderpriority").startswith("1").alias("overridden"))
    new = old.select("o_orderkey", F.lit("matched").alias("quality"), F.lit(False).alias("overridden"))
    return dml.upsert_unless(old, new, ["o_orderkey"], "overridden").drop("overridden")


@query("reassign_target", "SELECT o_orderkey, CASE WHEN o_custkey = 7 THEN 8 ELSE o_custkey END AS target FROM orders")
def reassign_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_custkey") == 7, F.lit(8).cast("long")).otherwise(F.col("o_custkey")).alias("target"))


@query("merge_duplicates", """WITH d AS (SELECT c_custkey, c_nationkey AS canonical, count(o_orderkey) AS n, c_name = 'Customer#000000007' AS named FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
r AS (SELECT *, first_value(c_custkey) OVER (PARTITION BY canonical ORDER BY named DESC, n DESC, c_custkey) AS keeper FROM d)
SELECT c_custkey, keeper, CAST(keeper AS VARCHAR) || '|' || CAST(canonical AS VARCHAR) AS key FROM r""")  # fmt: skip
def merge_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One keeper per canonical object: its own name, then most sessions, then the smallest id; keys are rewritten."""
    c, o = _t(spark, sf_dir, "customer", "orders")
    n = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    d = c.join(n, c.c_custkey == n.o_custkey, "left").select("c_custkey", F.col("c_nationkey").alias("canonical"), F.coalesce("n", F.lit(0).cast("long")).alias("n"), (F.col("c_name") == "Customer#000000007").alias("named"))
    e = dml.elect(d, "canonical", [F.col("named"), F.col("n"), -F.col("c_custkey")], "c_custkey")
    return e.select("c_custkey", "keeper", F.concat_ws("|", F.col("keeper").cast("string"), F.col("canonical").cast("string")).alias("key"))


@query("compat_gate", "SELECT o_custkey, count(DISTINCT coalesce(o_orderpriority, '?')) <= 1 AND count(DISTINCT o_orderstatus) <= 1 AS compatible FROM orders GROUP BY o_custkey")
def compat_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of a bundle agree; min = max needs no distinct sets."""
    same = lambda c: F.min(c) == F.max(c)
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg((same(F.coalesce("o_orderpriority", F.lit("?"))) & same(F.col("o_orderstatus"))).alias("compatible"))


@query("list_filter", "SELECT c_custkey FROM customer WHERE (lower(c_name) LIKE '%99%' OR lower(c_mktsegment) LIKE '%mach%') AND c_nationkey = 3 ORDER BY c_custkey LIMIT 20")
def list_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").filter((F.lower("c_name").contains("99") | F.lower("c_mktsegment").contains("mach")) & (F.col("c_nationkey") == 3))
    return c.orderBy("c_custkey").limit(20).select("c_custkey")


@query("name_precedence", "SELECT c_custkey, coalesce(s_name, c_name) AS library_name, coalesce(c_mktsegment, s_name) AS planner_name FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def name_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = _t(spark, sf_dir, "customer", "supplier")
    return c.join(s, c.c_custkey == s.s_suppkey, "left").select("c_custkey", F.coalesce("s_name", "c_name").alias("library_name"), F.coalesce("c_mktsegment", "s_name").alias("planner_name"))


@query("mask_columns", "SELECT c_custkey, 'redacted' AS c_name, r FROM (SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INTEGER) AS r FROM customer) WHERE r <= 5")
def mask_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redacted samples: sensitive header values masked, at most five files of each folder."""
    header = F.create_map(F.lit("c_name"), F.col("c_name"), F.lit("c_mktsegment"), F.col("c_mktsegment"))
    masked = F.transform_values(header, lambda k, v: F.when(k.isin("c_name"), F.lit("redacted")).otherwise(v))
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    return table(spark, sf_dir, "customer").withColumn("r", F.row_number().over(w)).filter("r <= 5").select("c_custkey", masked["c_name"].alias("c_name"), "r")


@query("grade_vs_median", """WITH v AS (SELECT o_custkey, o_orderkey, o_totalprice AS noise, median(o_totalprice) OVER (PARTITION BY o_custkey) AS m, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_orderkey, CASE WHEN n < 2 THEN NULL WHEN noise < 0.9 * m THEN 'better' WHEN noise > 1.1 * m THEN 'worse' ELSE 'typical' END AS grade FROM v""")  # fmt: skip
def grade_vs_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each version against its own project's median, with ten percent bands."""
    o = table(spark, sf_dir, "orders")
    m = o.groupBy("o_custkey").agg(F.median("o_totalprice").alias("m"), F.count(F.lit(1)).alias("n"))
    x = o.join(m, "o_custkey")
    noise = F.col("o_totalprice")
    return x.select("o_orderkey", F.when(F.col("n") >= 2, F.when(noise < 0.9 * F.col("m"), "better").when(noise > 1.1 * F.col("m"), "worse").otherwise("typical")).alias("grade"))


@query("selection_diff", """SELECT CAST(sum(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END - CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS d_sessions,
 round(sum(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice ELSE 0 END) - sum(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE 0 END), 2) AS d_integration FROM orders""")  # fmt: skip
def selection_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a new selection adds and drops against the old one."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    new, old = o.filter("o_orderkey % 3 = 0").withColumn("in_new", F.lit(1)), o.filter("o_orderkey % 2 = 0").withColumn("in_old", F.lit(1))
    x = new.join(old, ["o_orderkey", "o_totalprice"], "full_outer")
    sign = F.coalesce("in_new", F.lit(0)) - F.coalesce("in_old", F.lit(0))
    return x.agg(F.sum(sign).cast("long").alias("d_sessions"), F.round(F.sum(sign * F.col("o_totalprice")), 2).alias("d_integration"))


@query("array_sets", """WITH g AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderkey % 10)) AS a, list_sort(list(DISTINCT o_orderkey % 7)) AS b FROM orders GROUP BY o_custkey)
SELECT o_custkey, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS both, array_to_string(list_filter(a, lambda x: NOT list_contains(b, x)), ',') AS fresh,
 CAST(len(list_intersect(a, b)) AS INTEGER) AS common, len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 AS subset FROM g""")  # fmt: skip
def array_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, difference, intersection size and subset test of id sets."""
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set(F.col("o_orderkey") % 10)).alias("a"), F.array_sort(F.collect_set(F.col("o_orderkey") % 7)).alias("b"))
    return g.select(
        "o_custkey", F.array_join(F.array_sort(F.array_union("a", "b")), ",").alias("both"), F.array_join(F.array_except("a", "b"), ",").alias("fresh"),
        F.size(F.array_intersect("a", "b")).alias("common"), (F.size(F.array_except("b", "a")) == 0).alias("subset"),
    )


@query("bounded_tail", "SELECT o_custkey, array_to_string(list_slice(list(o_orderkey ORDER BY o_orderkey), -5, -1), ',') AS tail FROM orders GROUP BY o_custkey")
def bounded_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five of each: all but five of a key's rows go before the shuffle, so no list is longer."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderkey"))
    last = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("r")).filter("r <= 5")
    return last.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")), ",").alias("tail"))


@query("morning_summary", f"""SELECT c_nationkey AS target, CAST(count(*) AS BIGINT) AS sessions, round(sum(o_totalprice), 2) AS usable, count(DISTINCT o_custkey) AS masters, bool_or(o_orderkey % 5 = 0) AS has_update
FROM orders JOIN customer ON c_custkey = o_custkey WHERE {_KEEP} GROUP BY c_nationkey""")  # fmt: skip
def morning_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = _t(spark, sf_dir, "orders", "customer")
    x = o.filter(_KEEP).join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return x.groupBy(F.col("c_nationkey").alias("target")).agg(F.count(F.lit(1)).alias("sessions"), F.round(F.sum("o_totalprice"), 2).alias("usable"), F.count_distinct("o_custkey").alias("masters"), F.bool_or(F.col("o_orderkey") % 5 == 0).alias("has_update"))


@query("copy_worklist", "SELECT o_orderkey FROM orders n WHERE NOT EXISTS (SELECT 1 FROM orders d WHERE d.o_orderkey = n.o_orderkey AND CASE WHEN d.o_orderkey % 9 = 0 THEN d.o_totalprice + 1 ELSE d.o_totalprice END = n.o_totalprice AND d.o_orderkey % 4 <> 0)")
def copy_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that the destination does not have in the same size."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("size"))
    there = o.filter("o_orderkey % 4 <> 0").withColumn("size", F.when(F.col("o_orderkey") % 9 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return o.join(there, ["o_orderkey", "size"], "left_anti").select("o_orderkey")


@query("snapshot_retention", "SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') >= '1997-01-01'")
def snapshot_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots to keep, by name."""
    return table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).filter("day >= '1997-01-01'").distinct()


@query("target_image_pointer", "SELECT c_nationkey AS canonical, arg_max(c_custkey, struct_pack(b := c_acctbal, k := -c_custkey)) AS project_id FROM customer WHERE c_nationkey <> 5 GROUP BY c_nationkey")
def target_image_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One image per object: upserted, or deleted when taken back (object 5)."""
    c = table(spark, sf_dir, "customer")
    old = c.select(F.col("c_nationkey").alias("canonical"), F.lit(-1).cast("long").alias("project_id")).distinct()
    new = c.groupBy(F.col("c_nationkey").alias("canonical")).agg(F.max_by("c_custkey", F.struct("c_acctbal", -F.col("c_custkey"))).alias("project_id"))
    return dml.upsert(old, new, ["canonical"]).filter("canonical <> 5")
