"""Sky queries: suppliers and customers at positions derived from their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sphere as sp
from ..functions import values as va
from ..operators import spatial
from ..registry import query
from ..sources.tables import table

# positions that both engines compute alike: whole hundredths of degrees
_POS = "CAST((k * 7919) % 36000 AS DOUBLE) / 100 AS ra, CAST((k * 104729) % 16001 AS DOUBLE) / 100 - 80 AS dec"
_CAT = f"cat AS (SELECT id, name, {_POS} FROM (SELECT s_suppkey AS id, s_name AS name, s_suppkey * 13 + 5 AS k FROM supplier))"
_TGT = f"tgt AS (SELECT tid, {_POS} FROM (SELECT c_custkey AS tid, c_custkey * 3 + 1 AS k FROM customer))"
_SEP = "degrees(atan2(sqrt(power(cos(radians({d2})) * sin(radians({r2} - {r1})), 2) + power(cos(radians({d1})) * sin(radians({d2})) - sin(radians({d1})) * cos(radians({d2})) * cos(radians({r2} - {r1})), 2)), sin(radians({d1})) * sin(radians({d2})) + cos(radians({d1})) * cos(radians({d2})) * cos(radians({r2} - {r1}))))"
_S = _SEP.format(r1="t.ra", d1="t.dec", r2="c.ra", d2="c.dec")


def _position(key):
    return ((key * 7919) % 36000).cast("double") / 100, ((key * 104729) % 16001).cast("double") / 100 - 80


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    ra, dec = _position(F.col("s_suppkey") * 13 + 5)
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), ra.alias("c_ra"), dec.alias("c_dec"), F.col("s_acctbal").alias("weight"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ra, dec = _position(F.col("c_custkey") * 3 + 1)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tid"), ra.alias("ra"), dec.alias("dec"), F.col("c_nationkey").alias("grp"), F.col("c_acctbal").alias("bal"))


@query("nearest_sky", f"""WITH {_CAT}, {_TGT}, p AS (SELECT t.tid, c.id, {_S} AS sep FROM tgt t JOIN cat c ON abs(t.dec - c.dec) <= 8 AND {_S} <= 8.0),
b AS (SELECT tid, id, sep, row_number() OVER (PARTITION BY tid ORDER BY sep, id) AS r FROM p)
SELECT t.tid, b.id AS nearest, round(b.sep, 6) AS separation FROM tgt t LEFT JOIN b ON b.tid = t.tid AND b.r = 1""")  # fmt: skip
def nearest_sky(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spatial.nearest(targets(spark, sf_dir).select("tid", "ra", "dec"), catalog(spark, sf_dir).select("id", "c_ra", "c_dec"), "tid", ("ra", "dec"), ("c_ra", "c_dec"), "id", 8.0)
    return x.select("tid", "nearest", F.round("separation", 6).alias("separation"))


@query("nearby_topk", f"""WITH {_CAT}, {_TGT}, p AS (SELECT t.tid, c.id, c.name, {_S} AS sep FROM tgt t JOIN cat c ON {_S} <= 12.0)
SELECT tid, id, r FROM (SELECT tid, id, CAST(row_number() OVER (PARTITION BY tid ORDER BY round_even(sep * 60, 0), id % 3 = 0, sep, id) AS INTEGER) AS r FROM p) WHERE r <= 5""")  # fmt: skip
def nearby_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything within the tolerance: by whole arcminute (half to even), named first, distance, id."""
    order = [F.rint(F.col("separation") * 60), F.col("id") % 3 == 0, "separation", "id"]
    x = spatial.first_within(targets(spark, sf_dir), catalog(spark, sf_dir).select("id", "c_ra", "c_dec"), "tid", ("ra", "dec"), ("c_ra", "c_dec"), 12.0, 5, order, slack=1 / 60 + 1e-9)
    return x.select("tid", "id", "r")


@query("resolve_cascade", f"""WITH {_CAT}, {_TGT}, n AS (SELECT t.*, s.s_suppkey AS by_name FROM tgt t LEFT JOIN supplier s ON s.s_suppkey = t.tid AND s.s_suppkey % 2 = 0),
p AS (SELECT t.tid, c.id, row_number() OVER (PARTITION BY t.tid ORDER BY {_S}, c.id) AS r FROM n t JOIN cat c ON t.by_name IS NULL AND {_S} <= 5.0)
SELECT n.tid, coalesce(n.by_name, p.id) AS canonical, CASE WHEN n.by_name IS NOT NULL THEN 'name' WHEN p.id IS NOT NULL THEN 'position' END AS source FROM n LEFT JOIN p ON p.tid = n.tid AND p.r = 1""")  # fmt: skip
def resolve_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By name first; positions only of those without one."""
    t, c = targets(spark, sf_dir).select("tid", "ra", "dec"), catalog(spark, sf_dir)
    names = c.filter("id % 2 = 0").select(F.col("id").alias("by_name"))
    named = t.join(spatial.shuffled(names), F.col("tid") == F.col("by_name"), "left")
    found = spatial.nearest(named.filter("by_name IS NULL").select("tid", "ra", "dec"), c.select("id", "c_ra", "c_dec"), "tid", ("ra", "dec"), ("c_ra", "c_dec"), "id", 5.0).select("tid", "nearest")
    x = named.join(spatial.shuffled(found), "tid", "left")
    return x.select("tid", F.coalesce("by_name", "nearest").alias("canonical"), F.when(F.col("by_name").isNotNull(), "name").when(F.col("nearest").isNotNull(), "position").alias("source"))


@query("reassign_candidates", f"""WITH {_CAT}, {_TGT}, p AS (SELECT t.tid, c.id, {_S} AS sep FROM tgt t JOIN cat c ON {_S} <= 20.0)
SELECT tid, id, r FROM (SELECT tid, id, CAST(row_number() OVER (PARTITION BY tid ORDER BY sep, id) AS INTEGER) AS r FROM p) WHERE r <= 10""")  # fmt: skip
def reassign_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spatial.first_within(targets(spark, sf_dir), catalog(spark, sf_dir).select("id", "c_ra", "c_dec"), "tid", ("ra", "dec"), ("c_ra", "c_dec"), 20.0, 10, ["separation", "id"])
    return x.select("tid", "id", "r")


@query("circular_centroid", f"WITH {_TGT}, g AS (SELECT tgt.*, c_nationkey AS grp FROM tgt JOIN customer ON c_custkey = tid) SELECT grp, CASE WHEN count(*) >= 3 THEN round((degrees(atan2(avg(sin(radians(ra))), avg(cos(radians(ra))))) + 360) % 360, 6) END AS ra, CASE WHEN count(*) >= 3 THEN round(median(dec), 6) END AS dec FROM g GROUP BY grp")
def circular_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circular mean of right ascension, median declination; fewer than three positions give none."""
    n = F.count(F.lit(1)) >= 3
    return targets(spark, sf_dir).groupBy("grp").agg(F.when(n, F.round(sp.mean_ra(F.col("ra")), 6)).alias("ra"), F.when(n, F.round(F.median("dec"), 6)).alias("dec"))


@query("target_envelope", f"""WITH {_TGT}, g AS (SELECT tgt.*, c_nationkey AS grp, abs(c_acctbal) / 5000 AS fov FROM tgt JOIN customer ON c_custkey = tid),
m AS (SELECT grp, (degrees(atan2(avg(sin(radians(ra))), avg(cos(radians(ra))))) + 360) % 360 AS ra, median(dec) AS dec FROM g GROUP BY grp)
SELECT t.grp, round(max({_S}) + 0.5 * list_sort(list(t.fov))[count(*) // 2 + 1], 6) AS radius FROM g t JOIN m c ON c.grp = t.grp GROUP BY t.grp""")  # fmt: skip
def target_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest distance from the centre plus half the upper median of the fields of view."""
    t = targets(spark, sf_dir).withColumn("fov", F.abs("bal") / 5000)
    centre = t.groupBy("grp").agg(sp.mean_ra(F.col("ra")).alias("m_ra"), F.median("dec").alias("m_dec"))
    x = t.join(centre, "grp")
    fovs = F.array_sort(F.collect_list("fov"))
    far = F.max(sp.separation(F.col("ra"), F.col("dec"), F.col("m_ra"), F.col("m_dec")))
    return x.groupBy("grp").agg(far.alias("far"), fovs.alias("fovs")).select("grp", F.round(F.col("far") + 0.5 * F.element_at("fovs", (F.floor(F.size("fovs") / 2) + 1).cast("int")), 6).alias("radius"))


_LST = "((280.46061837 + 360.98564736629 * ({t} / 86400e6 - 10957.5) + ({lon})) % 360 + 360) % 360"
_ALT = "degrees(asin(greatest(-1, least(1, sin(radians({lat})) * sin(radians(dec)) + cos(radians({lat})) * cos(radians(dec)) * cos(radians(lst - ra))))))"
LAT, LON, DUSK, STEP = 37.4, -121.3, 1_704_078_000_000_000, 300_000_000  # 2024-01-01T03:00Z, five minutes


def _grid(spark: SparkSession, t: DataFrame) -> DataFrame:
    """Every target at 97 samples of the night; the grid is a literal array, exploded where the target is."""
    steps = t.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(96)))).withColumn("at_us", F.lit(DUSK) + F.col("i").cast("long") * F.lit(STEP))
    lst = sp.sidereal(F.col("at_us"), F.lit(LON))
    return steps.withColumn("alt", sp.altitude(F.col("ra"), F.col("dec"), F.lit(LAT), lst))


_GRID = f"g AS (SELECT tid, i, ra, dec, {_LST.format(t=f'({DUSK} + i * {STEP})', lon=LON)} AS lst FROM tgt, (SELECT unnest(range(0, 97)) AS i)), a AS (SELECT *, {_ALT.format(lat=LAT)} AS alt FROM g)"


@query("visibility_grid", f"WITH {_TGT}, {_GRID} SELECT tid, round(count(*) FILTER (alt >= 30) * 5 / 60.0, 6) AS hours, round(max(alt), 5) AS best, arg_max(i, alt) AS transit_i FROM a GROUP BY tid")
def visibility_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours above 30 degrees, the highest altitude and when: one aggregate over the exploded grid."""
    a = _grid(spark, targets(spark, sf_dir).select("tid", "ra", "dec"))
    return a.groupBy("tid").agg(F.round(F.count_if(F.col("alt") >= 30) * 5 / F.lit(60.0), 6).alias("hours"), F.round(F.max("alt"), 5).alias("best"), F.max_by("i", "alt").cast("long").alias("transit_i"))


@query("zero_crossing", f"WITH {_TGT}, {_GRID}, l AS (SELECT tid, i, alt, lead(alt) OVER (PARTITION BY tid ORDER BY i) AS nx FROM a) SELECT tid, round(min(i + (30 - alt) / (nx - alt)), 5) AS rises FROM l WHERE alt < 30 AND nx >= 30 GROUP BY tid")
def zero_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First upward crossing of a threshold, interpolated linearly."""
    a = _grid(spark, targets(spark, sf_dir).select("tid", "ra", "dec"))
    x = a.withColumn("nx", F.lead("alt").over(Window.partitionBy("tid").orderBy("i"))).filter("alt < 30 AND nx >= 30")
    return x.groupBy("tid").agg(F.round(F.min(F.col("i") + (30 - F.col("alt")) / (F.col("nx") - F.col("alt"))), 5).alias("rises"))


@query("up_window", f"WITH {_TGT}, {_GRID} SELECT tid, min(i) FILTER (alt >= 30) AS first_up, max(i) FILTER (alt >= 30) AS last_up FROM a GROUP BY tid")
def up_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _grid(spark, targets(spark, sf_dir).select("tid", "ra", "dec"))
    up = F.when(F.col("alt") >= 30, F.col("i").cast("long"))
    return a.groupBy("tid").agg(F.min(up).alias("first_up"), F.max(up).alias("last_up"))


@query("alt_az_now", f"WITH {_TGT}, g AS (SELECT *, {_LST.format(t=DUSK, lon=LON)} AS lst FROM tgt) SELECT tid, round({_ALT.format(lat=LAT)}, 5) AS alt, round((degrees(atan2(-cos(radians(dec)) * sin(radians(lst - ra)), sin(radians(dec)) * cos(radians({LAT})) - cos(radians(dec)) * sin(radians({LAT})) * cos(radians(lst - ra)))) + 360) % 360, 4) AS az FROM g")
def alt_az_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    lst = sp.sidereal(F.lit(DUSK), F.lit(LON))
    return targets(spark, sf_dir).select("tid", F.round(sp.altitude(F.col("ra"), F.col("dec"), F.lit(LAT), lst), 5).alias("alt"), F.round(sp.azimuth(F.col("ra"), F.col("dec"), F.lit(LAT), lst), 4).alias("az"))


@query("mag_gate", "SELECT c_custkey FROM customer WHERE CASE WHEN c_acctbal < 0 THEN c_name LIKE '%7%' ELSE c_acctbal <= 4000 END")
def mag_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown magnitudes need a name; known ones a limit."""
    mag = F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))
    return table(spark, sf_dir, "customer").filter(F.when(mag.isNull(), F.col("c_name").contains("7")).otherwise(mag <= 4000)).select("c_custkey")


@query("sky_cells", f"WITH {_TGT} SELECT CAST(CAST(floor(dec / 5) * 5 AS BIGINT) AS VARCHAR) || '/' || CAST(CAST(floor(ra / 5) * 5 AS BIGINT) AS VARCHAR) AS cell, count(*) AS n FROM tgt GROUP BY 1")
def sky_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets(spark, sf_dir).groupBy(sp.cell_key(F.col("dec"), F.col("ra")).alias("cell")).agg(F.count(F.lit(1)).alias("n"))


@query("sexagesimal", r"""WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'bad' ELSE CASE WHEN p_partkey % 2 = 0 THEN '-' ELSE '+' END || lpad(CAST(p_partkey % 3 AS VARCHAR), 2, '0') || ':' || lpad(CAST(p_size AS VARCHAR), 2, '0') || ':30.0' END AS t FROM part)
SELECT p_partkey, round(CASE WHEN t <> 'bad' THEN (abs(CAST(split_part(t, ':', 1) AS DOUBLE)) + CAST(split_part(t, ':', 2) AS DOUBLE) / 60 + CAST(split_part(t, ':', 3) AS DOUBLE) / 3600) * CASE WHEN t LIKE '-%' THEN -1 ELSE 1 END END, 9) AS degrees FROM s""")  # fmt: skip
def sexagesimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    text = F.when(F.col("p_partkey") % 9 == 0, "bad").otherwise(F.concat(F.when(F.col("p_partkey") % 2 == 0, "-").otherwise("+"), two(F.col("p_partkey") % 3), F.lit(":"), two(F.col("p_size")), F.lit(":30.0")))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(sp.sexagesimal(text, 1.0), 9).alias("degrees"))


@query("fov_tolerance", """WITH f AS (SELECT p_partkey, CASE WHEN p_size % 10 <> 0 THEN p_size * 10.0e0 END AS focal FROM part), d AS (SELECT p_partkey, CASE WHEN focal > 0 THEN sqrt(power(2 * degrees(atan(3008 * 2.0e0 / 1000 / 2 / focal)), 2) + power(2 * degrees(atan(2008 * 2.0e0 / 1000 / 2 / focal)), 2)) END AS fov FROM f)
SELECT p_partkey, round(fov, 6) AS fov, round(CASE WHEN fov IS NULL THEN 1.0e0 ELSE least(3.0e0, greatest(0.3e0, fov)) END, 6) AS auto_tol, round(CASE WHEN fov IS NULL THEN 2.0e0 ELSE least(5.0e0, greatest(0.5e0, 1.5e0 * fov)) END, 6) AS suggest_tol FROM d""")  # fmt: skip
def fov_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    focal = F.when(F.col("p_size") % 10 != 0, F.col("p_size") * 10.0)
    fov = sp.fov_diagonal(focal, F.lit(2.0), F.lit(None).cast("double"), F.lit(3008), F.lit(2008))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(fov, 6).alias("fov"), F.round(sp.auto_tolerance(fov), 6).alias("auto_tol"), F.round(sp.suggest_tolerance(fov), 6).alias("suggest_tol"))


@query("noise_advice", "SELECT o_orderkey, h.hours, round(1 - sqrt(o_totalprice / (o_totalprice + h.hours * 3600)), 9) AS noise_drop FROM orders, (VALUES (1.0e0), (2.0e0), (4.0e0), (8.0e0)) h(hours)")
def noise_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(va.advice(F.col("o_totalprice"))).alias("o"))
    return x.select("o_orderkey", "o.hours", F.round("o.noise_drop", 9).alias("noise_drop"))


@query("healpix_bucket", f"""WITH {_TGT}, a AS (SELECT tid, sin(radians(dec)) AS z, (ra - 360 * floor(ra / 360)) / 90 AS q FROM tgt),
l AS (SELECT tid, z, q, CAST(floor(16 * (0.5 + q) - 12 * z) AS BIGINT) AS p, CAST(floor(16 * (0.5 + q) + 12 * z) AS BIGINT) AS m, least(3, CAST(floor(q) AS BIGINT)) AS c, 16 * sqrt(3 * (1 - abs(z))) AS s FROM a),
f AS (SELECT *, least(15, CAST(floor((q - c) * s) AS BIGINT)) AS jp, least(15, CAST(floor((1 - (q - c)) * s) AS BIGINT)) AS jm FROM l),
b AS (SELECT tid, CASE WHEN abs(z) > 2.0e0 / 3 THEN CASE WHEN z >= 0 THEN c ELSE c + 8 END WHEN p // 16 = m // 16 THEN (p // 16) % 4 + 4 WHEN p // 16 < m // 16 THEN p // 16 ELSE m // 16 + 8 END AS face,
  CASE WHEN abs(z) > 2.0e0 / 3 THEN CASE WHEN z >= 0 THEN 15 - jm ELSE jp END ELSE m % 16 END AS x, CASE WHEN abs(z) > 2.0e0 / 3 THEN CASE WHEN z >= 0 THEN 15 - jp ELSE jm END ELSE 15 - p % 16 END AS y FROM f)
SELECT tid, CAST(face * 256 + """ + " + ".join(f"((x >> {i}) & 1) * {1 << (2 * i)} + ((y >> {i}) & 1) * {1 << (2 * i + 1)}" for i in range(4)) + " AS BIGINT) AS code FROM b")  # fmt: skip
def healpix_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested HEALPix index of each position, sixteen pixels a side."""
    return targets(spark, sf_dir).select("tid", sp.healpix(F.col("ra"), F.col("dec"), 4).alias("code"))
