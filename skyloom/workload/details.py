"""Classification, names, settings, merges and boxes in full, over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import frames as fr
from ..functions import sphere as sp
from ..functions import text as tx
from ..operators import dml
from ..registry import query
from ..sources.tables import table


@query("classify_headers", """WITH p AS (SELECT p_partkey AS k, p_partkey % 8 AS s, p_partkey % 7 AS t, p_partkey % 11 AS n, p_partkey % 13 AS d, p_size FROM part),
c AS (SELECT k, CASE WHEN s IN (0, 1) THEN 'dwarf3' WHEN s IN (2, 3) THEN 'seestar' WHEN s = 4 THEN 'asiair' WHEN s = 5 THEN 'nina' END AS scope,
 CASE t WHEN 0 THEN 'LIGHT' WHEN 1 THEN 'DARK' WHEN 2 THEN 'FLAT' WHEN 3 THEN 'BIAS' WHEN 4 THEN NULL ELSE CASE WHEN s IN (0, 1) THEN CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN 'DARK' ELSE 'LIGHT' END END END AS image_type,
 CASE WHEN n = 0 THEN 'failed' ELSE 'ok' END AS quality, n IN (1, 2, 3) OR d IN (0, 1) AS skip FROM p)
SELECT k AS p_partkey, scope, image_type, quality FROM c WHERE NOT skip AND scope IS NOT NULL AND image_type IS NOT NULL""")  # fmt: skip
def classify_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scope by five header cards, type by card or folder, by-products and derived files out, quality by name."""
    k = F.col("p_partkey")
    pick = lambda n, *values: F.element_at(F.array(*(F.lit(v) for v in values)), (k % n).cast("int") + 1)
    cards = {
        "TELESCOP": pick(8, " DwarfIII mini", None, None, None, None, None, "EQ6", None), "ORIGIN": pick(8, None, "DWARFLAB", None, None, None, None, None, None),
        "CREATOR": pick(8, None, None, "ZWO Seestar S50", "x", "zwo ASIAIR Plus", None, None, None), "INSTRUME": pick(8, None, None, None, "Seestar S50", "ZWO 2600", None, None, None),
        "SWCREATE": pick(8, None, None, None, None, None, "N.I.N.A. 3.2", "n.i.n", None), "IMAGETYP": pick(7, "Light Frame", "DARKS", " flat", "Offset", "snapshot", None, "  "),
        "STACKCNT": pick(13, "2", None, "1", "many", None, None, None, None, None, None, None, None, None), "PROGRAM": pick(13, None, "Siril 1.2", "x siril", None, None, None, None, None, None, None, None, None, None),
    }
    header = F.map_filter(F.create_map(*(x for key, v in cards.items() for x in (F.lit(key), v))), lambda _, v: v.isNotNull())
    folder = F.element_at(F.array(F.lit("a/CALI_FRAME/dark/"), F.lit("a/DWARF_DARK/"), F.lit("a/")), (F.col("p_size") % 3).cast("int") + 1)
    name = pick(11, "failed_raw.fits", "stacked-1.fits", "img_1.fits", "raw.PNG", *["raw.fits"] * 7)
    x = table(spark, sf_dir, "part").select("p_partkey", fr.classified(header, F.concat(folder, name)).alias("c")).filter("c IS NOT NULL")
    return x.select("p_partkey", "c.scope", "c.image_type", "c.quality")


@query("light_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'N' AND l_partkey % 10 <> 0 AND l_suppkey % 10 <> 1")
def light_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Light frames with an object and a date."""
    f = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "N", "LIGHT").otherwise("DARK").alias("image_type"),
        F.when(F.col("l_partkey") % 10 != 0, F.lit("M 1")).alias("object"), F.when(F.col("l_suppkey") % 10 != 1, F.col("l_shipdate")).alias("date"),
    )
    return f.filter("image_type = 'LIGHT' AND object IS NOT NULL AND date IS NOT NULL").select("l_orderkey", "l_linenumber")


@query("tonight_gate", "SELECT c_custkey FROM customer WHERE CASE WHEN c_nationkey % 2 = 0 THEN greatest(0, c_acctbal) > 0 ELSE c_custkey % 90 >= 25 END")
def tonight_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a night ahead what has hours in it, by day what is high enough now."""
    night, hours, altitude = F.col("c_nationkey") % 2 == 0, F.greatest(F.lit(0.0), F.col("c_acctbal")), F.col("c_custkey") % 90
    return table(spark, sf_dir, "customer").filter(F.when(night, hours > 0).otherwise(altitude >= 25)).select("c_custkey")


@query("capture_defaults", """SELECT p_partkey, CASE WHEN p_partkey % 4 = 1 THEN 'vis' WHEN p_type LIKE 'PROMO%' OR p_type LIKE 'LARGE%' THEN 'duo' ELSE 'astro' END AS filter,
 CASE WHEN p_partkey % 3 = 0 AND p_size <> 10 THEN CAST(p_size - 10 AS DOUBLE) ELSE 30.0e0 END AS exposure, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 60 END AS gain FROM part""")  # fmt: skip
def capture_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target's own settings, else those of its type."""
    k = F.col("p_partkey")
    s = fr.capture_settings(F.substring_index("p_type", " ", 1), F.when(k % 4 == 1, "vis").when(k % 4 == 2, ""), F.when(k % 3 == 0, F.col("p_size") - 10).cast("double"), F.when(k % 5 == 0, 0), ("PROMO", "LARGE"), 30.0, 60)
    return table(spark, sf_dir, "part").select("p_partkey", s.alias("s")).select("p_partkey", "s.*")


@query("common_name_lookup", """WITH c AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer)
SELECT k AS c_custkey, CASE k % 5 WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE 'Name ' || CAST(n AS VARCHAR) END AS name FROM c""")  # fmt: skip
def common_name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with and without the blank after the catalog's prefix; the unknown and empty to null."""
    n = F.col("c_nationkey").cast("string")
    names = table(spark, sf_dir, "nation").select(F.explode(F.array(F.concat(F.lit("M "), F.col("n_nationkey").cast("string")), F.concat(F.lit("Sh2- "), F.col("n_nationkey").cast("string")))).alias("key"), F.concat(F.lit("Name "), F.col("n_nationkey").cast("string")).alias("name"))
    raw = F.get(F.array(F.concat(F.lit(" M  "), n), F.concat(F.lit("M"), n), F.concat(F.lit("Sh2-"), n), F.concat(F.lit("MX "), n), F.lit("")), (F.col("c_custkey") % 5).cast("int"))
    c = table(spark, sf_dir, "customer").select("c_custkey", tx.spaced_name(tx.normalize_target(raw)).alias("key"))
    return c.join(names, "key", "left").select("c_custkey", "name")


@query("safe_names", r"""WITH p AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'a"b\' || p_brand WHEN 2 THEN 'plain' || CAST(p_size AS VARCHAR) ELSE 'x' || chr(10) || 'y''z' END AS raw FROM part)
SELECT p_partkey, regexp_replace(trim(raw, ' '), '[^A-Za-z0-9._-]+', '_', 'g') AS safe, replace(replace(replace(raw, '\', '\\'), chr(10), '\n'), '"', '\"') AS label,
 CASE WHEN regexp_matches(raw, '[\s"'']') THEN '"' || replace(raw, '"', '\"') || '"' ELSE raw END AS quoted FROM p""")  # fmt: skip
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names, metric labels and quoted paths of awkward texts."""
    k = F.col("p_partkey")
    raw = F.when(k % 4 == 0, F.col("p_name")).when(k % 4 == 1, F.concat(F.lit('a"b\\'), F.col("p_brand"))).when(k % 4 == 2, F.concat(F.lit("plain"), F.col("p_size").cast("string"))).otherwise("x\ny'z")
    return table(spark, sf_dir, "part").select("p_partkey", tx.safe_name(raw).alias("safe"), tx.label_value(raw).alias("label"), tx.quoted(raw).alias("quoted"))


@query("tile_paths", "SELECT c_custkey, 'Norder3/Dir' || CAST(c_custkey * 97 // 10000 * 10000 AS VARCHAR) || '/Npix' || CAST(c_custkey * 97 AS VARCHAR) || '.jpg' AS path FROM customer")
def tile_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", sp.tile_path(3, F.col("c_custkey") * 97).alias("path"))


@query("file_keys", "SELECT p_partkey, sha1(p_name) AS sha1, sha256(p_name) AS sha256, md5(p_name) AS md5 FROM part")
def file_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.sha1("p_name").alias("sha1"), F.sha2("p_name", 256).alias("sha256"), F.md5("p_name").alias("md5"))


@query("display_boxes", "SELECT p_partkey, p_size * 1.5e0 AS cx, CAST(100 - p_size AS DOUBLE) AS cr, round(-radians(p_partkey % 900 - 300.0e0), 9) AS theta, CAST(p_size AS DOUBLE) AS cy, round((p_partkey % 900 - 300.0e0) - 360 * floor((p_partkey % 900 - 300.0e0) / 360), 6) % 360 AS angle FROM part")
def display_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes from the display to the canvas and back; angles come back wrapped."""
    size, turn = F.col("p_size").cast("double"), F.col("p_partkey") % 900 - 300.0
    x = table(spark, sf_dir, "part").withColumn("box", sp.canvas_box(F.lit(100.0), size * 1.5, size, F.lit(3.0), F.lit(4.0), turn))
    x = x.withColumn("shown", sp.display_box(F.lit(100.0), F.col("box")))
    return x.select("p_partkey", "box.cx", "box.cr", F.round("box.theta", 9).alias("theta"), "shown.cy", (F.round("shown.angle", 6) % 360).alias("angle"))


@query("sky_boxes", """WITH c AS (SELECT c_custkey, radians(c_custkey % 20 / 10.0e0 - 1) AS d, radians(40 + c_custkey % 30 / 10.0e0) AS a, radians(41.0e0) AS b, radians(c_nationkey * 10.0e0) AS t FROM customer),
p AS (SELECT *, sin(b) * sin(a) + cos(b) * cos(a) * cos(d) AS k FROM c), q AS (SELECT *, degrees(cos(a) * sin(d) / k) AS x, degrees((cos(b) * sin(a) - sin(b) * cos(a) * cos(d)) / k) AS y FROM p)
SELECT c_custkey, round(500 + (-x * cos(t) + y * sin(t)) / 0.002e0, 6) AS cx, round(400 + (x * sin(t) + y * cos(t)) / 0.002e0, 6) AS cr FROM q""")  # fmt: skip
def sky_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions on a turned canvas."""
    k = F.col("c_custkey")
    x, y = sp.canvas_of_sky(F.lit(100.0) + (k % 20 / 10 - 1), 40 + k % 30 / 10, F.lit(100.0), F.lit(41.0), F.lit(0.002), F.col("c_nationkey") * 10.0, F.lit(500.0), F.lit(400.0))
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(x, 6).alias("cx"), F.round(y, 6).alias("cr"))


@query("master_upsert", "SELECT p_partkey AS path, CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 ELSE p_size END AS size, CASE WHEN p_partkey % 3 = 0 OR p_partkey % 7 = 0 THEN 'new' ELSE 'old' END AS scan FROM part")
def master_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masters refreshed by a scan; those of the same size keep the row they had, and new ones come."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("size"))
    old = p.filter("path % 7 <> 0").withColumn("scan", F.lit("old"))
    new = p.withColumn("size", F.when(F.col("path") % 3 == 0, F.col("size") + 1).otherwise(F.col("size"))).withColumn("scan", F.lit("new"))
    return dml.upsert_changed(old, new, ["path"], ["size"])


@query("settings_json", """SELECT n_name AS key, CASE WHEN n_nationkey % 2 = 0 THEN '{"on":true,"n":' || CAST(n_nationkey AS VARCHAR) || '}' ELSE '[1,"' || n_name || '"]' END AS value_json FROM nation""")
def settings_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings as JSON by key; an odd one is a list that was set before, an even one is replaced."""
    n = table(spark, sf_dir, "nation")
    old = n.select(F.col("n_name").alias("key"), F.to_json(F.array(F.lit("1"), "n_name")).alias("value_json")).withColumn("value_json", F.replace("value_json", F.lit('"1"'), F.lit("1")))
    new = n.filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("key"), F.to_json(F.struct(F.lit(True).alias("on"), F.col("n_nationkey").alias("n"))).alias("value_json"))
    return dml.upsert(old, new, ["key"])


@query("export_outputs", "SELECT o_orderkey AS job, 'Customer ' || CAST(o_custkey AS VARCHAR) AS project, unnest(['final', 'preview']) AS port, unnest(['/c/' || CAST(o_orderkey AS VARCHAR) || '.png', '/c/' || CAST(o_orderkey AS VARCHAR) || '.jpg']) AS path FROM orders WHERE o_orderstatus = 'F'")
def export_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outputs of finished jobs, from their JSON, with their projects."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey").cast("string")
    jobs = o.select(F.col("o_orderkey").alias("job"), F.col("o_orderstatus").alias("status"), F.to_json(F.create_map(F.lit("final"), F.concat(F.lit("/c/"), k, F.lit(".png")), F.lit("preview"), F.concat(F.lit("/c/"), k, F.lit(".jpg")))).alias("outputs_json"))
    projects = o.select(F.col("o_orderkey").alias("job"), F.col("o_custkey").alias("id")).join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("Customer "), F.col("c_custkey").cast("string")).alias("project")), "id")
    done = jobs.filter("status = 'F'").join(projects, "job")
    return done.select("job", "project", F.explode(F.from_json("outputs_json", "map<string,string>")).alias("port", "path"))


@query("morning_overlap", """WITH s AS (SELECT c_nationkey AS target, list(DISTINCT o_orderkey) AS ids FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 5 <> 0 GROUP BY c_nationkey),
h AS (SELECT l_suppkey AS project, list(DISTINCT l_orderkey) AS ids FROM lineitem GROUP BY l_suppkey)
SELECT target, project, CAST(len(list_intersect(s.ids, h.ids)) AS INTEGER) AS shared FROM s JOIN h ON len(list_intersect(s.ids, h.ids)) > 0""")  # fmt: skip
def morning_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets with the projects whose history holds some of the night's sessions: an equi-join on sessions, not of sets."""
    o = table(spark, sf_dir, "orders").filter("o_orderkey % 5 <> 0").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("c_nationkey").alias("target"), F.col("o_orderkey").alias("session")).distinct()
    h = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("project"), F.col("l_orderkey").alias("session")).distinct()
    return o.join(h, "session").groupBy("target", "project").agg(F.count(F.lit(1)).cast("int").alias("shared"))


@query("ordered_distinct", "SELECT l_orderkey, string_agg(CAST(s AS VARCHAR), ',' ORDER BY first, s) AS suppliers FROM (SELECT l_orderkey, l_suppkey % 3 AS s, min(l_linenumber) AS first FROM lineitem GROUP BY ALL) GROUP BY l_orderkey")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values in the order in which they come first."""
    values = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_suppkey") % 3).alias("s")))), lambda x: x["s"])  # an order's lines
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_distinct(values), ",").alias("suppliers"))


_MOVE = """t AS (SELECT n_nationkey AS target, n_name AS name FROM nation), s AS (SELECT c_custkey AS session, c_nationkey AS target FROM customer),
m AS (SELECT c_custkey AS session, CASE WHEN c_nationkey < 3 THEN 'INDIA' ELSE 'NEW ' || CAST(c_nationkey AS VARCHAR) END AS name FROM customer WHERE c_nationkey < 5),
x AS (SELECT name, 24 + row_number() OVER (ORDER BY name) AS target FROM (SELECT DISTINCT name FROM m) WHERE name NOT IN (SELECT name FROM t)), e AS (SELECT target, name FROM t UNION ALL SELECT target, name FROM x),
r AS (SELECT session, coalesce(e.target, s.target) AS target FROM s LEFT JOIN m USING (session) LEFT JOIN e ON e.name = m.name)"""


@query("reassign_sessions", f"WITH {_MOVE} SELECT session, CAST(target AS BIGINT) AS target FROM r")
def reassign_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions moved to a target that exists, or to one that is made for them."""
    return dml.reassign(*_moves(spark, sf_dir))[0].select("session", F.col("target").cast("long").alias("target"))


@query("reassign_targets", f"WITH {_MOVE} SELECT CAST(target AS BIGINT) AS target, name FROM e WHERE target IN (SELECT target FROM r) OR target NOT IN (SELECT target FROM s)")
def reassign_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets after the move: new ones are there, those left empty are gone."""
    return dml.reassign(*_moves(spark, sf_dir))[1].select(F.col("target").cast("long").alias("target"), "name")


def _moves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c, k = table(spark, sf_dir, "customer"), F.col("c_nationkey")
    moves = c.filter(k < 5).select(F.col("c_custkey").alias("session"), F.when(k < 3, "INDIA").otherwise(F.concat(F.lit("NEW "), k.cast("string"))).alias("name"))
    return c.select(F.col("c_custkey").alias("session"), k.alias("target")), table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("target"), F.col("n_name").alias("name")), moves


@query("merge_keys", """WITH m AS (SELECT DISTINCT o_custkey AS target, o_custkey % 4 AS recipe FROM orders), k AS (SELECT *, target // 10 * 10 AS keeper FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY keeper, recipe ORDER BY target <> keeper, target) AS i FROM k)
SELECT CAST(keeper AS VARCHAR) || '|r' || CAST(recipe AS VARCHAR) AS key, keeper AS target, target AS was FROM r WHERE i = 1""")  # fmt: skip
def merge_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of merged targets rewritten to the keeper's; of those that collide one stays."""
    t = F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").select(F.concat(t.cast("string"), F.lit("|r"), (t % 4).cast("string")).alias("key"), t.alias("target"), t.alias("was")).distinct()
    keepers = rows.select("target").distinct().select("target", F.expr("target div 10 * 10").alias("keeper"))
    return dml.merge_keys(rows, keepers, "key", "target")
