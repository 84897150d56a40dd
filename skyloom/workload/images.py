"""Image queries: each embedding is an 8x8 image, each label a sequence of frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as va
from ..operators import pixels as px
from ..registry import query
from ..sources.tables import table

W = H = 8
_P = "p AS (SELECT vec_id, label, (i - 1) // 8 AS y, (i - 1) % 8 AS x, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i))"


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("px"))


def pixel_rows(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    im = images(spark, sf_dir)
    rows = px.explode_pixels(im.withColumn("k", F.struct("vec_id", *more)), "k", "px", W)
    return rows.select("k.*", "y", "x", "v")


@query("channel_stats", f"WITH {_P} SELECT vec_id, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(stddev_pop(v), 6) AS std, round(quantile_cont(v, 0.01), 6) AS p1, round(quantile_cont(v, 0.99), 6) AS p99, round(avg(CASE WHEN v <= -0.2 THEN 1.0 ELSE 0.0 END), 6) AS clipped FROM p GROUP BY vec_id")
def channel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statistics inside the image's row: no pixel is shuffled."""
    a = F.col("px")
    r = lambda c: F.round(c, 6)
    low = F.size(F.filter(a, lambda v: v <= -0.2)) / F.size(a)
    return images(spark, sf_dir).select("vec_id", r(px.mean_of(a)).alias("mean"), r(px.quantile(a, 0.5)).alias("median"), r(px.std_of(a)).alias("std"), r(px.quantile(a, 0.01)).alias("p1"), r(px.quantile(a, 0.99)).alias("p99"), r(low).alias("clipped"))


@query("background_clip", f"""WITH {_P}, q AS (SELECT vec_id, quantile_cont(v, 0.3) AS m0 FROM p GROUP BY vec_id), a AS (SELECT p.* FROM p JOIN q USING (vec_id) WHERE v <= m0 + 1),
s1 AS (SELECT vec_id, median(v) AS m, stddev_pop(v) AS s FROM a GROUP BY vec_id), b AS (SELECT a.* FROM a JOIN s1 USING (vec_id) WHERE s <= 0 OR abs(v - m) <= 1.5 * s),
s2 AS (SELECT vec_id, median(v) AS m, stddev_pop(v) AS s FROM b GROUP BY vec_id), c AS (SELECT b.* FROM b JOIN s2 USING (vec_id) WHERE s <= 0 OR abs(v - m) <= 1.5 * s)
SELECT vec_id, round(median(v), 6) AS level, round(stddev_pop(v), 6) AS sigma, count(*) AS n FROM c GROUP BY vec_id""")  # fmt: skip
def background_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sky level and noise: what is near the 30th percentile, clipped round after round."""
    low = px.let(px.quantile(F.col("px"), 0.3), lambda m: F.filter("px", lambda v: v <= m + 1))
    im = images(spark, sf_dir).withColumn("a", low)
    for _ in range(2):
        im = im.withColumn("a", px.near_median(F.col("a"), 1.5))
    return im.select("vec_id", F.round(px.quantile(F.col("a"), 0.5), 6).alias("level"), F.round(px.std_of(F.col("a")), 6).alias("sigma"), F.size("a").cast("long").alias("n"))


@query("color_balance", f"WITH {_P}, m AS (SELECT vec_id, avg(v) FILTER (x % 2 = 0 AND y % 2 = 0) AS r, avg(v) FILTER ((x + y) % 2 = 1) AS g, avg(v) FILTER (x % 2 = 1 AND y % 2 = 1) AS b FROM p GROUP BY vec_id) SELECT vec_id, round(r / g, 4) AS rg, round(b / g, 4) AS bg, abs(r / g - 1) > 0.1 OR abs(b / g - 1) > 0.1 AS warn FROM m WHERE abs(g) > 0.01")
def color_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel means by Bayer parity, and their ratios."""
    p = pixel_rows(spark, sf_dir)
    mean = lambda c: F.avg(F.when(c, F.col("v")))
    x, y = F.col("x") % 2, F.col("y") % 2
    m = p.groupBy("vec_id").agg(mean((x == 0) & (y == 0)).alias("r"), mean((F.col("x") + F.col("y")) % 2 == 1).alias("g"), mean((x == 1) & (y == 1)).alias("b")).filter("abs(g) > 0.01")
    rg, bg = F.col("r") / F.col("g"), F.col("b") / F.col("g")
    return m.select("vec_id", F.round(rg, 4).alias("rg"), F.round(bg, 4).alias("bg"), ((F.abs(rg - 1) > 0.1) | (F.abs(bg - 1) > 0.1)).alias("warn"))


@query("laplacian_var", f"""WITH {_P}, l AS (SELECT vec_id, x, y, lag(v) OVER r + lead(v) OVER r + lag(v) OVER c + lead(v) OVER c - 4 * v AS d FROM p WINDOW r AS (PARTITION BY vec_id, y ORDER BY x), c AS (PARTITION BY vec_id, x ORDER BY y))
SELECT vec_id, round(var_pop(d), 6) AS sharpness FROM l WHERE d IS NOT NULL GROUP BY vec_id""")  # fmt: skip
def laplacian_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).withColumn("d", px.laplacian(F.col("px"), H, W)).select("vec_id", F.round(F.pow(px.std_of(F.col("d")), 2), 6).alias("sharpness"))


@query("mad_noise", f"WITH {_P}, d AS (SELECT vec_id, lead(v) OVER (PARTITION BY vec_id, y ORDER BY x) - v AS d FROM p), m AS (SELECT vec_id, median(d) AS m FROM d GROUP BY vec_id) SELECT vec_id, round(1.4826 / sqrt(2) * median(abs(d - m)), 6) AS noise FROM d JOIN m USING (vec_id) WHERE d IS NOT NULL GROUP BY vec_id")
def mad_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise from neighbour differences, robust against stars."""
    return images(spark, sf_dir).withColumn("d", px.neighbour_differences(F.col("px"), H, W)).select("vec_id", F.round(1.4826 / F.sqrt(F.lit(2.0)) * px.mad_of(F.col("d")), 6).alias("noise"))


@query("block_median", f"WITH {_P}, b AS (SELECT vec_id, y // 2 AS by, x // 2 AS bx, median(v) AS m FROM p GROUP BY ALL) SELECT vec_id, round(quantile_cont(m, 0.995), 6) AS signal, round(min(m), 6) AS floor FROM b GROUP BY vec_id")
def block_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = px.blocks(F.col("px"), H, W, 2, lambda a: px.quantile(a, 0.5))
    return images(spark, sf_dir).withColumn("m", m).select("vec_id", F.round(px.quantile(F.col("m"), 0.995), 6).alias("signal"), F.round(F.array_min("m"), 6).alias("floor"))


@query("star_list", f"WITH {_P}, b AS (SELECT vec_id, median(v) AS m, stddev_pop(v) AS s FROM p GROUP BY vec_id), n AS (SELECT a.vec_id, a.y, a.x, a.v, max(c.v) AS top FROM p a JOIN p c ON c.vec_id = a.vec_id AND abs(c.x - a.x) <= 1 AND abs(c.y - a.y) <= 1 GROUP BY ALL) SELECT n.vec_id AS key, CAST(n.y AS INTEGER) AS y, CAST(n.x AS INTEGER) AS x, round(n.v, 6) AS v FROM n JOIN b USING (vec_id) WHERE n.v = n.top AND n.v > m + 1.5 * s")
def star_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local maxima over the background."""
    return px.local_maxima(images(spark, sf_dir), "vec_id", "px", W, 1, 1.5).withColumn("v", F.round("v", 6))


@query("star_medians", f"WITH {_P}, b AS (SELECT vec_id, median(v) AS m, stddev_pop(v) AS s FROM p GROUP BY vec_id), n AS (SELECT a.vec_id, a.y, a.x, a.v, max(c.v) AS top FROM p a JOIN p c ON c.vec_id = a.vec_id AND abs(c.x - a.x) <= 1 AND abs(c.y - a.y) <= 1 GROUP BY ALL), t AS (SELECT n.vec_id, n.v FROM n JOIN b USING (vec_id) WHERE n.v = n.top AND n.v > m + 1.5 * s AND n.v < 0.35) SELECT vec_id AS key, CASE WHEN count(*) >= 3 THEN round(median(v), 6) END AS brightness, count(*) AS n FROM t GROUP BY vec_id")
def star_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians over stars that are not saturated; fewer than three give none."""
    s = px.local_maxima(images(spark, sf_dir), "vec_id", "px", W, 1, 1.5).filter("v < 0.35")
    return s.groupBy("key").agg(F.when(F.count(F.lit(1)) >= 3, F.round(F.median("v"), 6)).alias("brightness"), F.count(F.lit(1)).alias("n"))


for _name, _how in (("mean", "avg"), ("median", "median"), ("max", "max"), ("min", "min"), ("sum", "sum")):

    @query(f"stack_{_name}", f"WITH {_P} SELECT label, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round({_how}(v), 6) AS v FROM p GROUP BY label, y, x")
    def _stack(spark: SparkSession, sf_dir: str, how: str = _name) -> DataFrame:
        return px.stack(pixel_rows(spark, sf_dir, "label"), ["label"], how).withColumn("v", F.round("v", 6))


_CLIP = "SELECT a.* FROM {a} a JOIN (SELECT label, y, x, median(v) AS m, stddev_pop(v) AS s FROM {a} GROUP BY label, y, x) s USING (label, y, x) WHERE s.s <= 0 OR abs(a.v - s.m) <= 2.0 * s.s"


@query("stack_sigma_clip", f"WITH {_P}, c1 AS ({_CLIP.format(a='p')}), c2 AS ({_CLIP.format(a='c1')}) SELECT label, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(avg(v), 6) AS v FROM c2 GROUP BY label, y, x")
def stack_sigma_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px.stack_sigma_clip(pixel_rows(spark, sf_dir, "label"), ["label"], 2.0, 2).withColumn("v", F.round("v", 6))


@query("noise_weighted_combine", f"WITH {_P}, n AS (SELECT vec_id, 1 / (0.01 + var_pop(v)) AS w FROM p GROUP BY vec_id) SELECT label, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(sum(w * v) / sum(w), 6) AS v FROM p JOIN n USING (vec_id) GROUP BY label, y, x")
def noise_weighted_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image's weight is in its row before its pixels are exploded: no join."""
    im = images(spark, sf_dir).withColumn("w", 1 / (0.01 + F.pow(px.std_of(F.col("px")), 2)))
    rows = px.explode_pixels(im.withColumn("k", F.struct("label", "w")), "k", "px", W).select("k.*", "y", "x", "v")
    return rows.groupBy("label", "y", "x").agg(F.round(F.sum(F.col("w") * F.col("v")) / F.sum("w"), 6).alias("v"))


@query("palette_compose", f"""WITH {_P}, s AS (SELECT vec_id, median(v) AS med FROM p GROUP BY vec_id), d AS (SELECT vec_id, median(abs(v - med)) AS mad FROM p JOIN s USING (vec_id) GROUP BY vec_id),
t AS (SELECT p.vec_id, x, y, v, med, mad FROM p JOIN s USING (vec_id) JOIN d USING (vec_id))
SELECT h.vec_id, CAST(h.y AS INTEGER) AS y, CAST(h.x AS INTEGER) AS x, round(h.v, 6) + 0e0 AS r, round(o.v * h.mad / o.mad - h.mad / o.mad * o.med + h.med, 5) + 0e0 AS g FROM t h JOIN t o ON o.vec_id = h.vec_id + 1 AND o.x = h.x AND o.y = h.y""")  # fmt: skip
def palette_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image and the next as narrowband channels of one palette, the second matched in median and spread: a join of images, not of pixels."""
    im = images(spark, sf_dir).select("vec_id", "px", px.quantile(F.col("px"), 0.5).alias("med"), px.mad_of(F.col("px")).alias("mad"))
    h = im
    o = im.select((F.col("vec_id") - 1).alias("vec_id"), F.col("px").alias("o_px"), F.col("med").alias("o_med"), F.col("mad").alias("o_mad"))
    both = h.join(o, "vec_id")
    g = F.transform("o_px", lambda v: px.normalize_to(v, F.col("o_med"), F.col("o_mad"), F.col("med"), F.col("mad")))
    rows = both.select("vec_id", F.posexplode(F.arrays_zip(F.col("px").alias("r"), g.alias("g"))).alias("i", "z"))
    return rows.select("vec_id", F.expr("cast(i div 8 as int)").alias("y"), F.expr("cast(i % 8 as int)").alias("x"), (F.round("z.r", 6) + 0.0).alias("r"), (F.round("z.g", 5) + 0.0).alias("g"))


@query("blend_screen", f"WITH {_P}, n AS (SELECT *, 1 / (1 + exp(-v)) AS u FROM p) SELECT vec_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(1 - (1 - u) * (1 - power(u, 2.0)), 6) AS v FROM n")
def blend_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixel_rows(spark, sf_dir).withColumn("u", 1 / (1 + F.exp(-F.col("v"))))
    return p.select("vec_id", "y", "x", F.round(px.recombine(F.col("u"), F.col("u"), "screen", 0.5), 6).alias("v"))


@query("scnr_green", "SELECT vec_id, round(g + 0.8e0 * (least(g, (r + b) / 2) - g), 6) AS green FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS r, CAST(embedding[2] AS DOUBLE) AS g, CAST(embedding[3] AS DOUBLE) AS b FROM embeddings)")
def scnr_green(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("px")
    return images(spark, sf_dir).select("vec_id", F.round(px.scnr(F.get(a, F.lit(0)), F.get(a, F.lit(1)), F.get(a, F.lit(2)), 0.8), 6).alias("green"))


@query("auto_mtf", f"""WITH {_P}, n AS (SELECT vec_id, 1 / (1 + exp(-v)) AS u FROM p), s AS (SELECT vec_id, median(u) AS m FROM n GROUP BY vec_id), b AS (SELECT vec_id, m * (0.25 - 1) / (2 * m * 0.25 - 0.25 - m) AS k FROM s)
SELECT n.vec_id, round(max(b.k), 6) AS midtones, round(avg(CASE WHEN u <= 0 THEN 0 WHEN u >= 1 THEN 1 ELSE (k - 1) * u / ((2 * k - 1) * u - k) END), 6) AS mean FROM n JOIN b USING (vec_id) GROUP BY n.vec_id""")  # fmt: skip
def auto_mtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The midtones balance that takes the median to a quarter, applied."""
    u = F.transform("px", lambda v: 1 / (1 + F.exp(-v)))

    def stretched(b):
        return px.let(va.midtones_for(px.quantile(b, 0.5), F.lit(0.25)), lambda k: F.struct(k.alias("midtones"), px.mean_of(F.transform(b, lambda v: va.mtf(v, k))).alias("mean")))

    im = images(spark, sf_dir).withColumn("s", px.let(u, stretched))
    return im.select("vec_id", F.round("s.midtones", 6).alias("midtones"), F.round("s.mean", 6).alias("mean"))


@query("black_point", f"WITH {_P}, q AS (SELECT vec_id, quantile_cont(v, 0.01) AS lo, max(v) AS hi FROM p GROUP BY vec_id) SELECT p.vec_id, round(avg(greatest(0.0, (v - lo) / (hi - lo))), 6) AS mean FROM p JOIN q USING (vec_id) GROUP BY p.vec_id")
def black_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.struct(px.quantile(F.col("px"), 0.01).alias("lo"), F.array_max("px").alias("hi"))
    mean = px.let(ends, lambda e: px.mean_of(F.transform("px", lambda v: F.greatest(F.lit(0.0), (v - e["lo"]) / (e["hi"] - e["lo"])))))
    return images(spark, sf_dir).select("vec_id", F.round(mean, 6).alias("mean"))


@query("auto_trim_bbox", f"WITH {_P} SELECT vec_id, CAST(min(y) AS INTEGER) AS top, CAST(max(y) AS INTEGER) AS bottom, CAST(min(x) AS INTEGER) AS lft, CAST(max(x) AS INTEGER) AS rgt FROM p WHERE v > 0.2 GROUP BY vec_id")
def auto_trim_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixel_rows(spark, sf_dir).filter("v > 0.2")
    return p.groupBy("vec_id").agg(F.min("y").alias("top"), F.max("y").alias("bottom"), F.min("x").alias("lft"), F.max("x").alias("rgt"))


@query("crop_box", f"WITH {_P} SELECT vec_id, CAST(y - 2 AS INTEGER) AS y, CAST(x - 1 AS INTEGER) AS x, round(v, 6) AS v FROM p WHERE y BETWEEN 2 AND 5 AND x BETWEEN 1 AND 6")
def crop_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixel_rows(spark, sf_dir).filter("y BETWEEN 2 AND 5 AND x BETWEEN 1 AND 6")
    return p.select("vec_id", (F.col("y") - 2).alias("y"), (F.col("x") - 1).alias("x"), F.round("v", 6).alias("v"))


@query("downscale_2x", f"WITH {_P} SELECT vec_id, CAST(y // 2 AS INTEGER) AS y, CAST(x // 2 AS INTEGER) AS x, round(avg(v), 6) AS v FROM p GROUP BY ALL")
def downscale_2x(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area mean of 2x2 blocks within each image's row."""
    m = px.blocks(F.col("px"), H, W, 2, px.mean_of)
    rows = images(spark, sf_dir).select("vec_id", F.posexplode(m).alias("i", "v"))
    return rows.select("vec_id", F.expr("cast(i div 4 as int)").alias("y"), F.expr("cast(i % 4 as int)").alias("x"), F.round("v", 6).alias("v"))


@query("pedestal_offset", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) + 100)), 4) AS total FROM embeddings")
def pedestal_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).select("vec_id", F.round(F.aggregate(F.transform("px", lambda v: v + 100), F.lit(0.0), lambda s, v: s + v), 4).alias("total"))


@query("bayer_split", f"WITH {_P} SELECT vec_id, round(avg(v) FILTER (y % 2 = 0 AND x % 2 = 0), 6) AS ha, round(avg(v) FILTER (NOT (y % 2 = 0 AND x % 2 = 0)), 6) AS oiii FROM p GROUP BY vec_id")
def bayer_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    red = F.filter("px", lambda v, i: (i % 2 == 0) & (F.floor(i / 8) % 2 == 0))
    rest = F.filter("px", lambda v, i: ~((i % 2 == 0) & (F.floor(i / 8) % 2 == 0)))
    return images(spark, sf_dir).select("vec_id", F.round(px.mean_of(red), 6).alias("ha"), F.round(px.mean_of(rest), 6).alias("oiii"))


@query("calibrate_frames", "SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, d.embedding, f.embedding), lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) / (2.0e0 + abs(CAST(z[3] AS DOUBLE))))), 4) AS total FROM embeddings a JOIN embeddings d ON d.vec_id = a.label JOIN embeddings f ON f.vec_id = a.label + 10")
def calibrate_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(light - dark) / flat, with the masters found by the frame's settings."""
    im = images(spark, sf_dir)
    d = im.select(F.col("vec_id").alias("d_id"), F.col("px").alias("dark"))
    f = im.select((F.col("vec_id") - 10).alias("f_id"), F.col("px").alias("flat"))
    x = im.join(d, F.col("label") == F.col("d_id")).join(f, F.col("label") == F.col("f_id"))
    lit = F.zip_with("px", "dark", lambda a, b: a - b)
    out = F.zip_with(lit, F.transform("flat", lambda v: 2.0 + F.abs(v)), lambda a, b: a / b)
    return x.select("vec_id", F.round(F.aggregate(out, F.lit(0.0), lambda s, v: s + v), 4).alias("total"))


@query("align_shift", f"""WITH {_P}, d AS (SELECT vec_id, y, x, v - avg(v) OVER (PARTITION BY vec_id) AS v FROM p), s AS (SELECT unnest(range(0, 8)) AS dy), t AS (SELECT unnest(range(0, 8)) AS dx),
c AS (SELECT a.vec_id, dy, dx, round(sum(a.v * b.v), 9) AS c FROM d a, s, t, d b WHERE b.vec_id = a.vec_id + 1 AND b.y = (a.y - dy + 8) % 8 AND b.x = (a.x - dx + 8) % 8 GROUP BY ALL),
m AS (SELECT vec_id, arg_max(struct_pack(dy := dy, dx := dx), struct_pack(c := c, i := -(dy * 8 + dx))) AS w FROM c GROUP BY vec_id)
SELECT vec_id AS key, CAST(CASE WHEN w.dy <= 4 THEN w.dy ELSE w.dy - 8 END AS INTEGER) AS dy, CAST(CASE WHEN w.dx <= 4 THEN w.dx ELSE w.dx - 8 END AS INTEGER) AS dx FROM m""")  # fmt: skip
def align_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-pixel shifts between neighbouring images by FFT cross-correlation."""
    im = images(spark, sf_dir)
    other = im.select((F.col("vec_id") - 1).alias("vec_id"), F.col("px").alias("other"))
    return px.align_pairs(im.join(other, "vec_id"), "vec_id", "px", "other", W)
