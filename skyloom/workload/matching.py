"""Calibration matching: line items as frames and orders as sessions against ``part`` as masters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import matching as op
from ..registry import query
from ..sources.scratch import cut
from ..sources.tables import micros, table

#: Rows of picks up to which they are broadcast: two to three MB.
PICKS = 1 << 16

_SESSION = "s AS (SELECT o_orderkey AS sid, 'Brand#' || CAST(1 + o_orderkey % 5 AS VARCHAR) || CAST(1 + o_custkey % 5 AS VARCHAR) AS instrument, CAST(o_orderkey % 60 AS DOUBLE) - 5 AS temp, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE p.camera END AS camera FROM orders CROSS JOIN (SELECT 'cam' AS camera) p)"
_MASTER = "m AS (SELECT p_partkey AS mid, p_brand AS instrument, CAST(p_size AS DOUBLE) - 5 AS temp, CAST(floor(p_retailprice) AS BIGINT) AS depth, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE 'cam' END AS camera FROM part)"


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    brand = F.concat(F.lit("Brand#"), (1 + F.col("o_orderkey") % 5).cast("string"), (1 + F.col("o_custkey") % 5).cast("string"))
    return o.select(F.col("o_orderkey").alias("sid"), brand.alias("instrument"), ((F.col("o_orderkey") % 60).cast("double") - 5).alias("temp"), F.when(F.col("o_orderkey") % 11 != 0, F.lit("cam")).alias("camera"), micros("o_orderdate").alias("at_us"))


def masters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("mid"), F.col("p_brand").alias("m_instrument"), (F.col("p_size").cast("double") - 5).alias("m_temp"), F.floor("p_retailprice").alias("depth"), F.when(F.col("p_partkey") % 7 != 0, F.lit("cam")).alias("m_camera"), F.col("p_type"))


def _settings():
    return (F.col("instrument") == F.col("m_instrument")) & op.wildcard_equal(F.col("camera"), F.col("m_camera"))


@query("nearest_master", f"""WITH {_SESSION}, {_MASTER}, c AS (SELECT s.sid, m.mid, abs(s.temp - m.temp) AS delta, row_number() OVER (PARTITION BY s.sid ORDER BY floor(abs(s.temp - m.temp) / 2.0), m.depth DESC, m.mid) AS r
FROM s JOIN m ON s.instrument = m.instrument AND (s.camera = m.camera OR s.camera IS NULL OR m.camera IS NULL) AND abs(s.temp - m.temp) <= 5.0)
SELECT s.sid, c.mid, c.delta, CASE WHEN c.mid IS NULL THEN 'none' WHEN c.delta <= 2.0 THEN 'exact' ELSE 'approx' END AS quality FROM s LEFT JOIN c ON c.sid = s.sid AND c.r = 1""")  # fmt: skip
def nearest_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = op.nearest_by_temperature(sessions(spark, sf_dir), masters(spark, sf_dir), "sid", _settings(), "temp", "m_temp", "depth", "mid", ["m_instrument", "m_camera"])
    quality = F.when(F.col("best").isNull(), "none").when(F.col("best.delta") <= 2.0, "exact").otherwise("approx")
    return x.select("sid", F.col("best.id").alias("mid"), F.col("best.delta").alias("delta"), quality.alias("quality"))


@query("binned_master_fallback", f"""WITH {_SESSION}, {_MASTER}, b AS (SELECT instrument, (CAST(trunc(temp / 4.0) AS INTEGER) + 0.5) * 4.0 AS bin, count(*) AS frames FROM s GROUP BY ALL),
c AS (SELECT b.instrument, b.bin, m.mid, abs(b.bin - m.temp) AS delta, row_number() OVER (PARTITION BY b.instrument, b.bin ORDER BY abs(b.bin - m.temp) > 5.0, floor(abs(b.bin - m.temp) / 2.0), m.depth DESC, m.mid) AS r FROM b JOIN m ON b.instrument = m.instrument)
SELECT b.instrument, CAST(b.bin AS DOUBLE) AS bin, b.frames, c.mid, coalesce(c.delta > 5.0, FALSE) AS fallback FROM b LEFT JOIN c ON c.instrument = b.instrument AND c.bin = b.bin AND c.r = 1""")  # fmt: skip
def binned_master_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temperature buckets, each with the nearest master, in tolerance if there is one."""
    b = sessions(spark, sf_dir).groupBy("instrument", op.temperature_bin(F.col("temp"), 4.0).alias("bin")).agg(F.count(F.lit(1)).alias("frames"))
    b = b.withColumn("key", F.concat_ws("|", "instrument", F.col("bin").cast("string")))
    x = op.nearest_by_temperature(b, masters(spark, sf_dir), "key", F.col("instrument") == F.col("m_instrument"), "bin", "m_temp", "depth", "mid", ["m_instrument"], fallback=True)
    return x.select("instrument", "bin", "frames", F.col("best.id").alias("mid"), F.coalesce("best.fallback", F.lit(False)).alias("fallback"))


@query("dark_preview", f"""WITH {_SESSION}, {_MASTER}, b AS (SELECT instrument, (CAST(trunc(temp / 4.0) AS INTEGER) + 0.5) * 4.0 AS bin, count(*) AS frames FROM s GROUP BY ALL),
c AS (SELECT b.frames, m.mid, abs(b.bin - m.temp) AS delta, row_number() OVER (PARTITION BY b.instrument, b.bin ORDER BY abs(b.bin - m.temp) > 5.0, floor(abs(b.bin - m.temp) / 2.0), m.depth DESC, m.mid) AS r FROM b LEFT JOIN m ON b.instrument = m.instrument)
SELECT CAST(sum(frames) AS BIGINT) AS total, CAST(sum(CASE WHEN mid IS NOT NULL THEN frames ELSE 0 END) AS BIGINT) AS matched, CAST(sum(CASE WHEN mid IS NULL THEN frames ELSE 0 END) AS BIGINT) AS unmatched,
 CAST(sum(CASE WHEN delta > 5.0 THEN frames ELSE 0 END) AS BIGINT) AS fallback, count(DISTINCT mid) AS darks FROM c WHERE r = 1""")  # fmt: skip
def dark_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = binned_master_fallback(spark, sf_dir)
    n = lambda cond: F.sum(F.when(cond, F.col("frames")).otherwise(0))
    return x.agg(F.sum("frames").alias("total"), n(F.col("mid").isNotNull()).alias("matched"), n(F.col("mid").isNull()).alias("unmatched"), n(F.col("fallback")).alias("fallback"), F.count_distinct("mid").alias("darks"))


@query("latest_flat", f"""WITH {_SESSION}, {_MASTER} SELECT s.sid, max_by(m.mid, m.depth * 1000000 - m.mid) AS mid FROM s JOIN m ON s.instrument = m.instrument GROUP BY s.sid""")
def latest_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest date, then the deepest, then the smallest id.  Masters are reduced per setting before the join."""
    m = masters(spark, sf_dir).groupBy("m_instrument").agg(F.max_by("mid", F.struct("depth", -F.col("mid"))).alias("mid"))
    return sessions(spark, sf_dir).join(m, F.col("instrument") == F.col("m_instrument")).select("sid", "mid")


@query("deepest_bias", f"WITH {_SESSION}, {_MASTER} SELECT s.sid, max(m.depth) AS depth FROM s LEFT JOIN m ON s.instrument = m.instrument GROUP BY s.sid")
def deepest_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = masters(spark, sf_dir).groupBy("m_instrument").agg(F.max("depth").alias("depth"))
    return sessions(spark, sf_dir).join(m, F.col("instrument") == F.col("m_instrument"), "left").select("sid", "depth")


@query("frame_dark_pick", """WITH f AS (SELECT l_orderkey * 10 + l_linenumber AS frame, CAST(l_quantity AS BIGINT) % 10 AS gain, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END AS temp FROM lineitem),
d AS (SELECT min(p_partkey) AS pos, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_partkey % 10 END AS gain, CAST(p_size AS DOUBLE) AS temp FROM part GROUP BY 2, 3),
r AS (SELECT f.frame, d.pos, row_number() OVER (PARTITION BY f.frame ORDER BY coalesce(abs(f.temp - d.temp), CAST('inf' AS DOUBLE)), d.pos) AS r FROM f JOIN d ON d.gain = f.gain OR d.gain IS NULL)
SELECT frame, pos FROM r WHERE r = 1""")  # fmt: skip
def frame_dark_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-frame dark: equal gain (an unknown one fits all), nearest temperature, first seen.

    Darks and frames are each reduced to one per gain and temperature before they
    meet.  The wildcard is a value of the equi-join key, so there is no theta join.
    What was found goes back to the frames as a broadcast if it has no more than
    ``PICKS`` rows; frames of one number take the best of theirs.
    """
    f = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("frame"), (F.rint("l_quantity").cast("long") % 10).alias("gain"), F.when(F.col("l_linenumber") != 7, F.col("l_quantity")).alias("temp"))
    d = table(spark, sf_dir, "part").groupBy(F.when(F.col("p_partkey") % 13 != 0, F.col("p_partkey") % 10).alias("d_gain"), F.col("p_size").cast("double").alias("d_temp")).agg(F.min("p_partkey").alias("pos"))
    d = d.withColumn("key", F.coalesce(F.col("d_gain").cast("string"), F.lit("*")))
    asked = f.select("gain", "temp").distinct().withColumn("key", F.explode(F.array(F.col("gain").cast("string"), F.lit("*"))))
    rank = F.struct(F.coalesce(F.abs(F.col("temp") - F.col("d_temp")), op.infinity()).alias("far"), F.col("pos"))
    picks = cut(asked.join(d, "key").groupBy(F.col("gain").alias("p_gain"), F.col("temp").alias("p_temp")).agg(F.min(rank).alias("best")))
    picks = F.broadcast(picks) if picks.count() <= PICKS else picks
    x = f.join(picks, F.col("gain").eqNullSafe(F.col("p_gain")) & F.col("temp").eqNullSafe(F.col("p_temp")))
    return x.groupBy("frame").agg(F.min("best").alias("best")).select("frame", F.col("best.pos").alias("pos"))


@query("master_by_kind", "SELECT o_orderkey AS sid, p_partkey AS mid, p_name AS path FROM orders JOIN part ON p_partkey = o_custkey WHERE p_size = 10")
def master_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, p = table(spark, sf_dir, "orders"), table(spark, sf_dir, "part").filter("p_size = 10")
    return o.join(p, o.o_custkey == p.p_partkey).select(F.col("o_orderkey").alias("sid"), F.col("p_partkey").alias("mid"), F.col("p_name").alias("path"))


_RECIPE = "CASE WHEN p_type LIKE '%NEBULA%' OR p_type LIKE 'PROMO%' THEN CASE WHEN p_size % 2 = 0 THEN 'hoo' ELSE 'nebula' END WHEN p_type LIKE 'LARGE%' THEN 'galaxy' ELSE 'default' END"


@query("recipe_choice", f"SELECT p_partkey, {_RECIPE} AS recipe, CASE WHEN p_size % 2 = 0 THEN 'duo' ELSE 'broad' END AS template, coalesce(CASE WHEN p_size > 40 THEN 60.0e0 END, CASE WHEN p_type LIKE 'PROMO%' THEN 30.0e0 ELSE 15.0e0 END) AS exposure FROM part")
def recipe_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipe by object type and filter; capture defaults unless overridden."""
    kind, duo = F.col("p_type"), F.col("p_size") % 2 == 0
    nebula = kind.contains("NEBULA") | kind.startswith("PROMO")
    recipe = F.when(nebula, F.when(duo, "hoo").otherwise("nebula")).when(kind.startswith("LARGE"), "galaxy").otherwise("default")
    exposure = F.coalesce(F.when(F.col("p_size") > 40, 60.0), F.when(kind.startswith("PROMO"), 30.0).otherwise(15.0))
    return table(spark, sf_dir, "part").select("p_partkey", recipe.alias("recipe"), F.when(duo, "duo").otherwise("broad").alias("template"), exposure.alias("exposure"))
