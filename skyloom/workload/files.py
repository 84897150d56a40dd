"""Files and catalogs as queries: images and headers written and read again, listings, masters, aliases, lookups, migrations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..sources import catalogs, fits
from ..sources.tables import table


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding is an 8x8 frame with the settings of its label."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("img"), F.lit(1).alias("c"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.col("embedding").alias("px"),
        F.concat(F.lit("M "), F.col("label").cast("string")).alias("object"), (30.0 * (F.col("label") + 1)).alias("exptime"), (F.col("label") * 10).alias("gain"),
    )


def _files(spark: SparkSession, sf_dir: str, kind: str = "fits") -> DataFrame:
    made = fits.encode_images(_frames(spark, sf_dir), {"OBJECT": "object", "EXPTIME": "exptime", "GAIN": "gain"} if kind == "fits" else None, kind)
    return made.select(F.concat(F.lit("night/"), "img", F.lit(f".{kind}")).alias("path"), "content")


@query("fits_headers", """SELECT 'night/' || CAST(vec_id AS VARCHAR) || '.fits' AS path, CAST(CASE WHEN vec_id % 3 = 0 THEN 2880 ELSE 5760 END AS BIGINT) AS length, vec_id % 3 <> 0 AS complete,
 'M ' || CAST(label AS VARCHAR) AS object, 30.0e0 * (label + 1) AS exptime, CAST(label * 10 AS INTEGER) AS gain, CAST(8 AS INTEGER) AS width, CAST(NULL AS VARCHAR) AS filter FROM embeddings""")  # fmt: skip
def fits_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers written with each frame and read back; every third file lost its last block."""
    cut = F.when(F.regexp_extract("path", r"(\d+)", 1).cast("long") % 3 == 0, F.substring(F.col("content"), 1, 2880)).otherwise(F.col("content"))
    files = _files(spark, sf_dir).withColumn("content", cut).withColumn("length", F.length("content").cast("long"))
    h = F.col("header")
    return fits.header_rows(files).select(
        "path", "length", "complete", h["OBJECT"].alias("object"), h["EXPTIME"].try_cast("double").alias("exptime"), h["GAIN"].try_cast("int").alias("gain"), h["NAXIS1"].try_cast("int").alias("width"), h["FILTER"].alias("filter"),
    )


@query("fits_images", """WITH s AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings), m AS (SELECT vec_id, e, list_min(e) AS lo, list_max(e) AS hi FROM s),
x AS (SELECT vec_id, list_transform(e, lambda v: CAST(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0 END AS FLOAT)) AS u FROM m)
SELECT 'night/' || CAST(vec_id AS VARCHAR) || '.fits' AS path, 0 AS idx, 8 AS height, 8 AS width, 1 AS channels, round(list_sum(list_transform(u, lambda v: CAST(v AS DOUBLE))), 5) AS total,
 CAST(len(list_filter(u, lambda v: v > 0.5)) AS INTEGER) AS bright FROM x""")  # fmt: skip
def fits_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels written and read back, from the least to the greatest."""
    px = F.transform("px", lambda v: v.cast("double"))
    return fits.image_rows(_files(spark, sf_dir)).select("path", "idx", "height", "width", "channels", F.round(F.aggregate(px, F.lit(0.0), lambda s, v: s + v), 5).alias("total"), F.size(F.filter("px", lambda v: v > 0.5)).alias("bright"))


@query("png_images", """WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(floor(greatest(CAST(0 AS FLOAT), least(CAST(1 AS FLOAT), CAST(v AS FLOAT))) * CAST(65535 AS FLOAT) + CAST(0.5 AS FLOAT)) AS BIGINT)) AS q FROM embeddings)
SELECT 'night/' || CAST(vec_id AS VARCHAR) || '.png' AS path, 8 AS height, 8 AS width, 1 AS channels, CAST(list_sum(q) AS BIGINT) AS total, CAST(list_max(q) AS BIGINT) AS most FROM x""")  # fmt: skip
def png_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16-bit PNG files written and read back."""
    level = F.transform("px", lambda v: F.round(v * 65535).cast("long"))
    return fits.image_rows(_files(spark, sf_dir, "png")).select("path", "height", "width", "channels", F.aggregate(level, F.lit(0).cast("long"), lambda s, v: s + v).alias("total"), F.array_max(level).alias("most"))


@query("changed_files", """SELECT o_orderkey AS path FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 11 = 0""")
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scan must read: new files, other sizes or times, and files without a hash."""
    found = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_custkey").alias("length"), F.unix_timestamp("o_orderdate").alias("modified"))
    known = found.filter("path % 3 <> 0").select("path", F.when(F.col("path") % 7 == 0, F.col("length") + 1).otherwise(F.col("length")).alias("length"), F.when(F.col("path") % 11 == 0, F.col("modified") - 1).otherwise(F.col("modified")).alias("modified"), F.when(F.col("path") % 5 != 0, "h").alias("hash"))
    return fits.changed(found, known).select("path")


@query("frame_listing", """WITH f AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'failed_raw_' WHEN 1 THEN 'RAW_' WHEN 2 THEN 'raw_' WHEN 3 THEN 'stacked_' ELSE 'thumb_' END || CAST(p_partkey AS VARCHAR) || CASE WHEN p_size > 25 THEN '_20C.fits' ELSE '_20C_x.FIT' END AS name FROM part)
SELECT 'a/raw_b/' || name AS path FROM f WHERE starts_with(lower(name), 'raw_') AND (lower(name) LIKE '%!_20c.fits' ESCAPE '!')""")  # fmt: skip
def frame_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames by prefix and suffix of their names, without the instrument's by-products."""
    k = F.col("p_partkey")
    prefix = F.element_at(F.array(*map(F.lit, ("failed_raw_", "RAW_", "raw_", "stacked_", "thumb_"))), (k % 5).cast("int") + 1)
    files = table(spark, sf_dir, "part").select(F.concat(F.lit("a/raw_b/"), prefix, k.cast("string"), F.when(F.col("p_size") > 25, "_20C.fits").otherwise("_20C_x.FIT")).alias("path"))
    return fits.frame_listing(files, "raw_", "_20C")


@query("factory_masters", """SELECT 'file:/r/TELE/dark/dark_exp_' || CAST(p_size AS VARCHAR) || '.500000_gain_' || CAST(p_size * 2 AS VARCHAR) || '_bin_1_' || CAST(p_partkey % 40 - 10 AS VARCHAR) || 'C_stack_' || CAST(p_partkey AS VARCHAR) || '.fits' AS path,
 'TELE' AS camera, 'dark' AS kind, p_size + 0.5e0 AS exposure, CAST(p_size * 2 AS INTEGER) AS gain, CAST(1 AS INTEGER) AS binning, CAST(p_partkey % 40 - 10 AS INTEGER) AS temp, CAST(p_partkey AS INTEGER) AS stack FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT 'file:/r/WIDE/flat/flat_gain_' || CAST(p_size AS VARCHAR) || '_bin_2_ir_0.fits', 'WIDE', 'flat', NULL, CAST(p_size AS INTEGER), CAST(2 AS INTEGER), NULL, NULL FROM part WHERE p_partkey % 6 = 1""")  # fmt: skip
def factory_masters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masters three folders deep, with the settings that their names state."""
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    dark = F.concat(F.lit("file:/r/TELE/dark/dark_exp_"), s, F.lit(".500000_gain_"), (F.col("p_size") * 2).cast("string"), F.lit("_bin_1_"), (k % 40 - 10).cast("string"), F.lit("C_stack_"), k.cast("string"), F.lit(".fits"))
    flat = F.concat(F.lit("file:/r/WIDE/flat/flat_gain_"), s, F.lit("_bin_2_ir_0.fits"))
    path = F.when(k % 2 == 0, dark).when(k % 6 == 1, flat).otherwise(F.concat(F.lit("file:/r/x"), k.cast("string"), F.lit(".fits")))
    return catalogs.factory_masters(table(spark, sf_dir, "part").select(path.alias("path")), "file:/r")


@query("dark_headers", """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '60' ELSE '7' END AS gain, '15.0' AS exptime, CASE WHEN p_size > 25 THEN CAST(p_size AS VARCHAR) END AS temp FROM part""")
def dark_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a dark's header lacks comes from its file's name; what it has stays."""
    name = F.concat(F.lit("dark_exp_15.000000_gain_60_bin_1_"), F.when(F.col("p_size") > 25, F.concat(F.col("p_size").cast("string"), F.lit("C_"))).otherwise(""), F.lit("stack_10.fits"))
    header = F.when(F.col("p_partkey") % 2 == 0, F.create_map(F.lit("CAMERA"), F.lit("TELE"))).otherwise(F.create_map(F.lit("GAIN"), F.lit("7")))
    h = fits.enrich(header, name)
    return table(spark, sf_dir, "part").select("p_partkey", h["GAIN"].alias("gain"), h["EXPTIME"].alias("exptime"), h["DET-TEMP"].alias("temp"))


@query("catalog_positions", """WITH c AS (SELECT c_custkey AS k, c_custkey % 7840 + 1 AS n, c_custkey % 24 AS h, c_custkey % 60 AS m, c_custkey % 50 AS s, c_custkey % 80 AS d FROM customer)
SELECT k AS source_no, 'NGC ' || CAST(n AS VARCHAR) || CASE WHEN k % 9 = 0 THEN ' A' ELSE '' END AS canonical, CASE WHEN k % 11 <> 0 THEN round((h + m / 60.0e0 + (s + 0.5e0) / 3600) * 15, 6) END AS ra,
 round(CASE WHEN k % 2 = 0 THEN -1 ELSE 1 END * (d + m / 60.0e0 + s / 3600.0e0), 6) AS dec, CASE WHEN k % 7 <> 0 THEN s / 4.0e0 END AS magnitude, CASE WHEN k % 3 = 0 THEN 'Name ' || CAST(k AS VARCHAR) END AS common_name FROM c""")  # fmt: skip
def catalog_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rows of text: canonical names, sexagesimal positions, the first common name; what is malformed is null."""
    k = F.col("c_custkey")
    h, m, s, d = ((k % n).cast("int") for n in (24, 60, 50, 80))
    raw = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("NGC"), F.lpad((k % 7840 + 1).cast("string"), 4, "0"), F.when(k % 9 == 0, "A").otherwise("")).alias("name"), F.when(k % 11 == 0, "bad").otherwise(F.format_string("%02d:%02d:%02d.5", h, m, s)).alias("ra"),
        F.concat(F.when(k % 2 == 0, "-").otherwise("+"), F.format_string("%02d:%02d:%02d", d, m, s)).alias("dec"), F.when(k % 7 == 0, "?").otherwise((s / 4).cast("string")).alias("mag"),
        F.when(k % 3 == 0, F.concat(F.lit("Name "), k.cast("string"), F.lit(",Other"))).otherwise("").alias("common"), k.alias("source_no"),
    )
    e = catalogs.catalog_entries(raw, "name", "ra", "dec", "mag", "common")
    return e.select("source_no", "canonical", F.round("ra", 6).alias("ra"), F.round("dec", 6).alias("dec"), "magnitude", "common_name")


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog entries from nations: NGC numbers, some in other catalogs too, with lists of foreign identifiers."""
    k = F.col("n_nationkey")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("NGC "), (k * 7 + 500).cast("string")).alias("canonical"), F.when(k % 2 == 0, pad(k + 19, 3)).alias("m"), F.when(k % 5 == 0, pad(k + 1, 4)).otherwise("").alias("ic"),
        F.concat(F.lit("2MASX J1,C 0"), pad(k, 2), F.lit(", Sh2-"), (k + 100).cast("string"), F.lit(",LBN 0"), pad(k + 300, 3), F.lit("A,PGC 9")).alias("identifiers"), k.alias("source_no"),
    )


@query("catalog_aliases", """WITH n AS (SELECT n_nationkey AS k, CAST(n_nationkey AS VARCHAR) AS s, CAST(n_nationkey * 7 + 500 AS VARCHAR) AS ngc FROM nation),
a AS (SELECT k, ngc, unnest(['ngc ' || ngc, 'ngc' || ngc, 'ngc 0' || ngc, 'ngc0' || ngc]) AS alias FROM n
UNION SELECT k, ngc, unnest(['m ' || lpad(CAST(k + 19 AS VARCHAR), 3, '0'), 'm' || lpad(CAST(k + 19 AS VARCHAR), 3, '0'), 'm ' || CAST(k + 19 AS VARCHAR), 'm' || CAST(k + 19 AS VARCHAR)]) FROM n WHERE k % 2 = 0
UNION SELECT k, ngc, unnest(['ic ' || lpad(CAST(k + 1 AS VARCHAR), 4, '0'), 'ic' || lpad(CAST(k + 1 AS VARCHAR), 4, '0'), 'ic ' || CAST(k + 1 AS VARCHAR), 'ic' || CAST(k + 1 AS VARCHAR)]) FROM n WHERE k % 5 = 0
UNION SELECT k, ngc, unnest(['c 0' || lpad(s, 2, '0'), 'c0' || lpad(s, 2, '0'), 'c ' || s, 'c' || s]) FROM n
UNION SELECT k, ngc, unnest(['sh2-' || CAST(k + 100 AS VARCHAR), 'sh 2-' || CAST(k + 100 AS VARCHAR), 'sh2-' || CAST(k + 100 AS VARCHAR)]) FROM n
UNION SELECT k, ngc, unnest(['lbn 0' || CAST(k + 300 AS VARCHAR) || 'a', 'lbn0' || CAST(k + 300 AS VARCHAR) || 'a', 'lbn ' || CAST(k + 300 AS VARCHAR) || 'a', 'lbn' || CAST(k + 300 AS VARCHAR) || 'a']) FROM n)
SELECT alias, 'NGC ' || arg_min(ngc, k) AS canonical FROM a GROUP BY alias""")  # fmt: skip
def catalog_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name that an entry is found by: its own spellings, cross-identifications and foreign identifiers."""
    return catalogs.alias_table(_objects(spark, sf_dir))


@query("alias_resolve", """SELECT c_custkey, CASE WHEN c_custkey % 6 = 5 THEN NULL WHEN c_custkey % 6 = 3 AND c_nationkey % 2 = 1 THEN NULL ELSE 'NGC ' || CAST(c_nationkey * 7 + 500 AS VARCHAR) END AS canonical FROM customer""")
def alias_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as people type them (``NGC 0598``, ``ngc598``, ``M 33``, ``C 14``) to their entry; the unknown to null."""
    from ..functions.text import lookup_key

    n, k = (F.col("c_nationkey") * 7 + 500).cast("string"), F.col("c_nationkey")
    typed = F.array(F.concat(F.lit("NGC 0"), n), F.concat(F.lit("ngc"), n), F.concat(F.lit(" NGC   "), n), F.concat(F.lit("M "), (k + 19).cast("string")), F.concat(F.lit("C"), k.cast("string")), F.lit("nowhere"))
    c = table(spark, sf_dir, "customer").select("c_custkey", lookup_key(F.get(typed, (F.col("c_custkey") % 6).cast("int"))).alias("alias"))
    return c.join(catalogs.alias_table(_objects(spark, sf_dir)), "alias", "left").select("c_custkey", "canonical")


@query("ranked_names", "SELECT n_regionkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS INTEGER) AS rank, n_name AS name FROM nation")
def ranked_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lists as ranked names."""
    lists = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.to_json(F.array_sort(F.collect_list("n_name"))).alias("names"))  # as long as a region
    return catalogs.ranked(lists, "names", "n_regionkey")


@query("named_entries", "SELECT n_regionkey, CAST(n_nationkey AS VARCHAR) AS key, n_name AS name FROM nation")
def named_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON objects as names by key."""
    pair = F.struct(F.col("n_nationkey").cast("string"), F.col("n_name"))
    objects = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.to_json(F.map_from_entries(F.collect_list(pair))).alias("names"))
    return catalogs.named(objects, "names", "n_regionkey")


@query("sequence_sizes", "SELECT l_orderkey AS seq, CAST(sum(l_quantity) AS DOUBLE) AS bytes, count(*) AS frames, CAST(arg_min(CASE WHEN l_partkey % 2 = 0 THEN 16 ELSE -32 END, l_linenumber) FILTER (l_linenumber >= 2) AS INTEGER) AS depth FROM lineitem GROUP BY l_orderkey")
def sequence_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and frames of each sequence, and the depth of its first frame that tells it.

    Frames of one number go by their places in the table's files.
    """
    told = F.when(F.col("l_linenumber") >= 2, F.create_map(F.lit("BITPIX"), F.when(F.col("l_partkey") % 2 == 0, "16").otherwise("-32"))).otherwise(F.create_map(F.lit("GAIN"), F.lit("1")))
    frames = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("seq"), F.struct("l_linenumber", "_metadata.file_path", "_metadata.row_index").alias("path"), F.col("l_quantity").alias("length"), told.alias("header"))
    return catalogs.sequence_size(frames).select("seq", F.col("bytes").cast("double").alias("bytes"), "frames", "depth")


@query("schema_migration", "SELECT s_suppkey AS id, s_name AS name, n_name AS site, CAST(2 AS INTEGER) AS version FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal > 0")
def schema_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered steps from version 0: a column gets a table of its own, then rows without a balance leave."""
    tables = {"scopes": table(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "id").withColumnRenamed("s_name", "name"), "sites": table(spark, sf_dir, "nation")}
    steps = [
        lambda t: t | {"scopes": t["scopes"].join(t["sites"].select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("site")), "s_nationkey").drop("s_nationkey")},
        lambda t: {"scopes": t["scopes"].filter("s_acctbal > 0").drop("s_acctbal")},
    ]
    got, version = catalogs.migrate(tables, 0, steps)
    return got["scopes"].select("id", "name", "site", F.lit(version).alias("version"))
