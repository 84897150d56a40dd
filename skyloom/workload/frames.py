"""The image nodes as queries: each embedding is an 8x8 frame, all of them one sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import dag, nodes
from ..registry import query
from ..sources.scratch import fresh_path
from ..sources.tables import table

_P = "p AS (SELECT vec_id, label, (i - 1) // 8 AS y, (i - 1) % 8 AS x, embedding[i] AS f, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i))"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("img"), F.col("vec_id").cast("int").alias("idx"), F.lit(1).alias("c"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.col("embedding").alias("px"),
        (F.col("label") - 10.0).alias("temp"), F.lit(30.0).alias("exptime"), F.lit(60).alias("gain"),
    )


def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Red the frame, green its squares, blue one less it."""
    px = F.concat("px", F.transform("px", lambda v: v * v), F.transform("px", lambda v: F.lit(1).cast("float") - v))
    return frames(spark, sf_dir).withColumn("c", F.lit(3)).withColumn("px", px)


_RGB = f"{_P}, rgb AS (SELECT vec_id, y, x, CAST(f AS DOUBLE) AS r, CAST(f * f AS DOUBLE) AS g, CAST(CAST(1 AS FLOAT) - f AS DOUBLE) AS b FROM p)"


def run(kind: str, **args: object) -> dict[str, DataFrame]:
    """A node's body with the kind's defaults for the parameters that are not given."""
    spec = dag.KINDS[kind]
    return spec.body(**dag.resolved(spec, {k: v for k, v in args.items() if k in spec.params}), **{k: v for k, v in args.items() if k not in spec.params})


def pixels(images: DataFrame) -> DataFrame:
    """``img, k, y, x, v`` of every value, planes by ``k``."""
    rows = images.select("img", "h", "w", F.posexplode("px").alias("i", "v"))
    size = F.col("h") * F.col("w")
    at = lambda e: F.expr(f"cast({e} as int)")
    return rows.select("img", at("i div (h * w)").alias("k"), at("(i % (h * w)) div w").alias("y"), at("i % w").alias("x"), F.round(F.col("v").cast("double"), 6).alias("v"), size.alias("size"))


def _out(images: DataFrame, *more: str) -> DataFrame:
    return pixels(images).select(F.col("img").cast("long").alias("vec_id"), *more, "y", "x", "v")


def _image(images: DataFrame, *more: str) -> DataFrame:
    return pixels(images).select(*more, "y", "x", "v")


def _sql(value: str, source: str = "p", more: str = "") -> str:
    """The SQL's rows of one plane: values become floats, as images hold them."""
    return f"SELECT vec_id, {more}CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(CAST(CAST({value} AS FLOAT) AS DOUBLE), 6) AS v FROM {source}"


def _kept(base: str, low: float = 3.0, high: float = 3.0) -> str:
    """CTEs of three rounds of sigma rejection of ``base`` (y, x, v); the last is ``k3`` with ``keep``."""
    out = [f"k0 AS (SELECT y, x, v, TRUE AS keep FROM {base})"]
    for i in range(3):
        out.append(f"m{i} AS (SELECT y, x, median(v) AS mid, stddev_pop(v) AS sd FROM k{i} WHERE keep GROUP BY y, x)")
        out.append(f"k{i + 1} AS (SELECT k{i}.y, k{i}.x, v, keep AND (sd = 0 OR (v >= mid - {low}e0 * sd AND v <= mid + {high}e0 * sd)) AS keep FROM k{i} JOIN m{i} ON k{i}.y = m{i}.y AND k{i}.x = m{i}.x)")
    return ", ".join(out)


def _one(value: str, source: str) -> str:
    return f"SELECT CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(CAST(CAST({value} AS FLOAT) AS DOUBLE), 6) AS v FROM {source}"


@query("node_convert_lights", "SELECT vec_id, CAST(row_number() OVER (ORDER BY CAST(vec_id AS VARCHAR)) AS INTEGER) AS idx FROM embeddings WHERE vec_id % 5 <> 0")
def node_convert_lights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole frames in the order of their names; every fifth lost pixels."""
    short = frames(spark, sf_dir).withColumn("px", F.when(F.col("idx") % 5 == 0, F.slice("px", 1, 60)).otherwise(F.col("px")))
    return run("convert_lights", lights=short)["sequence"].select(F.col("img").cast("long").alias("vec_id"), "idx")


@query("node_calibrate", f"""WITH {_P}, d AS (SELECT y, x, CAST(avg(v) FILTER (label < 5) AS FLOAT) AS cold, CAST(avg(v) FILTER (label >= 5) AS FLOAT) AS warm, CAST(2 + avg(abs(v)) AS FLOAT) AS flat FROM p GROUP BY y, x), m AS (SELECT avg(CAST(flat AS DOUBLE)) AS mean FROM d),
c AS (SELECT vec_id, p.y, p.x, CAST(f - CASE WHEN label <= 5 THEN cold ELSE warm END AS DOUBLE) / (flat / mean) AS v FROM p JOIN d ON p.y = d.y AND p.x = d.x, m) {_sql("v", "c")}""")  # fmt: skip
def node_calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame less the dark of the nearest temperature (-9 or 1; of two as near the first), by the flat."""
    f = frames(spark, sf_dir)

    def mean(rows: DataFrame, name: str, temp: float, value=lambda v: v) -> DataFrame:
        p = rows.select(F.posexplode("px").alias("i", "v")).groupBy("i").agg(value(F.avg(F.abs("v") if name == "flat" else F.col("v").cast("double"))).cast("float").alias("v"))
        px = p.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("px"))  # one image
        return px.select(F.lit(name).alias("img"), F.lit(0).alias("idx"), F.lit(1).alias("c"), F.lit(8).alias("h"), F.lit(8).alias("w"), "px", F.lit(temp).alias("temp"), F.lit(30.0).alias("exptime"), F.lit(60).alias("gain"))

    dark = [mean(f.filter("temp < -5"), "a", -9.0), mean(f.filter("temp >= -5"), "b", -1.0)]
    return _out(run("calibrate", sequence=f, dark=dark, flat=mean(f, "flat", 0.0, lambda v: 2 + v), bias=None)["sequence"])


@query("node_seq_offset", f"WITH {_P} {_sql('v + 0.25e0')}")
def node_seq_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(run("seq_offset", sequence=frames(spark, sf_dir), pedestal=0.25)["sequence"])


@query("node_seq_resample", f"""WITH {_P}, t(d, wt) AS (VALUES (-1, -0.0625e0), (0, 0.5625e0), (1, 0.5625e0), (2, -0.0625e0)), o AS (SELECT unnest(range(0, 4)) AS o),
r AS (SELECT vec_id, o.o AS y, p.x, sum(wt * v) AS v FROM p, o, t WHERE p.y = greatest(0, least(7, 2 * o.o + d)) GROUP BY ALL),
c AS (SELECT vec_id, y, o.o AS x, sum(wt * v) AS v FROM r, o, t WHERE r.x = greatest(0, least(7, 2 * o.o + d)) GROUP BY ALL) {_sql("v", "c")}""")  # fmt: skip
def node_seq_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the size by the cubic kernel."""
    return _out(run("seq_resample", sequence=frames(spark, sf_dir), enabled=True)["sequence"])


@query("node_seq_bg_extract", f"WITH {_P} {_sql('v')}")
def node_seq_bg_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One block has no slope to take away."""
    return _out(run("seq_bg_extract", sequence=frames(spark, sf_dir))["sequence"])


@query("node_seq_register", f"""WITH {_P}, g AS (SELECT y, x, CASE WHEN y = 9 AND x = 9 THEN 1.0 ELSE 0.0 END AS v FROM (SELECT unnest(range(0, 24)) AS y), (SELECT unnest(range(0, 24)) AS x))
SELECT vec_id, CAST(9 AS INTEGER) AS y, CAST(9 AS INTEGER) AS x FROM embeddings""")  # fmt: skip
def node_seq_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with one star each, moved about by their number: after registration all have it where the first has."""
    dy, dx = F.col("idx") % 4, (F.col("idx") % 3) * 2
    at = F.transform(F.sequence(F.lit(0), F.lit(575)), lambda i: F.exp(-0.5 * (F.pow(F.floor(i / 24) - 9 - dy, 2) + F.pow(i % 24 - 9 - dx, 2))).cast("float"))
    moved = frames(spark, sf_dir).withColumn("h", F.lit(24)).withColumn("w", F.lit(24)).withColumn("px", at)
    peak = run("seq_register", sequence=moved)["sequence"].select(F.col("img").cast("long").alias("vec_id"), (F.array_position(F.transform("px", lambda v: F.round(v, 3)), F.round(F.array_max("px"), 3)) - 1).alias("i"))
    return peak.select("vec_id", F.expr("cast(i div 24 as int)").alias("y"), F.expr("cast(i % 24 as int)").alias("x"))


@query("node_stack_median", f"WITH {_P}, s AS (SELECT y, x, median(v) AS v FROM p GROUP BY y, x) {_one('v', 's')}")
def node_stack_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _image(run("seq_stack", sequence=frames(spark, sf_dir), method="median", norm="no")["image"])


@query("node_stack_rejected", f"WITH {_P}, {_kept('p', 2.0, 2.5)}, s AS (SELECT y, x, avg(v) FILTER (keep) AS v FROM k3 GROUP BY y, x) {_one('v', 's')}")
def node_stack_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of what three rounds of sigma rejection leave."""
    return _image(run("seq_stack", sequence=frames(spark, sf_dir), method="rej", rejection_type="s", sigma_low=2.0, sigma_high=2.5, norm="no")["image"])


@query("node_combine_stacks", f"WITH {_P}, n AS (SELECT label, y, x, CAST(CAST(avg(v) AS FLOAT) AS DOUBLE) AS v FROM p GROUP BY ALL), {_kept('n')}, s AS (SELECT y, x, avg(v) FILTER (keep) AS v FROM k3 GROUP BY y, x) {_one('v', 's')}")
def node_combine_stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The means of the labels as nights, combined without weights."""
    p = frames(spark, sf_dir).select(F.col("temp").alias("night"), F.posexplode("px").alias("i", "v")).groupBy("night", "i").agg(F.avg(F.col("v").cast("double")).cast("float").alias("v"))
    px = p.groupBy("night").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("px"))  # 64 values
    whole = px.select(F.col("night").cast("string").alias("img"), F.lit(1).alias("idx"), F.lit(1).alias("c"), F.lit(8).alias("h"), F.lit(8).alias("w"), "px", F.lit(0.0).alias("temp"), F.lit(30.0).alias("exptime"), F.lit(60).alias("gain"), "night")
    nights = [whole.filter(F.col("night") == k - 10.0) for k in range(10)]
    return _image(run("combine_stacks", images=nights, weight="none")["image"])


@query("node_crop", f"WITH {_P}, c AS (SELECT vec_id, y - 2 AS y, x - 1 AS x, v FROM p WHERE y BETWEEN 2 AND 5 AND x BETWEEN 1 AND 3) {_sql('v', 'c')}")
def node_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(run("crop", image=frames(spark, sf_dir), x=0.125, y=0.25, width=0.375, height=0.5)["image"])


@query("node_crop_trim", f"""WITH {_P}, b AS (SELECT vec_id, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM p WHERE v > CAST(CAST(0.2 AS FLOAT) AS DOUBLE) - 1e-9 AND v > 0.2 GROUP BY vec_id),
c AS (SELECT p.vec_id, y - coalesce(y0, 0) AS y, x - coalesce(x0, 0) AS x, v FROM p LEFT JOIN b USING (vec_id) WHERE y BETWEEN coalesce(y0, 0) AND coalesce(y1, 7) AND x BETWEEN coalesce(x0, 0) AND coalesce(x1, 7)) {_sql("v", "c")}""")  # fmt: skip
def node_crop_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the border that no bright pixel is in; a frame without any stays whole."""
    return _out(run("crop", image=frames(spark, sf_dir), threshold=0.2)["image"])


@query("node_stretch_mtf", f"WITH {_P}, u AS (SELECT *, greatest(0.0e0, least(1.0e0, (v + 0.25e0) / 0.75e0)) AS u FROM p) {_sql('CASE WHEN u <= 0 THEN 0 WHEN u >= 1 THEN 1 ELSE (0.3e0 - 1) * u / ((2 * 0.3e0 - 1) * u - 0.3e0) END', 'u')}")
def node_stretch_mtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(run("stretch", image=frames(spark, sf_dir), method="mtf", mtf_shadows=-0.25, mtf_midtones=0.3, mtf_highlights=0.5)["image"])


@query("node_stretch_asinh", f"WITH {_P} {_sql('asinh(10.0e0 * greatest(0.0e0, least(1.0e0, v + 0.1e0))) / asinh(10.0e0)')}")
def node_stretch_asinh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(run("stretch", image=frames(spark, sf_dir), method="asinh", asinh_offset=-0.1)["image"])


_CLIP = "least(0.999e0, greatest(1e-6, {}))"


@query("node_stretch_auto", f"""WITH {_P}, l AS (SELECT vec_id, v FROM p WHERE y % 4 = 0 AND x % 4 = 0), a AS (SELECT vec_id, max(v) > 0 AS lit FROM l GROUP BY vec_id), q AS (SELECT l.vec_id, v FROM l JOIN a USING (vec_id) WHERE v > 0 OR NOT lit),
s AS (SELECT vec_id, median(v) AS sky FROM q GROUP BY vec_id), n AS (SELECT q.vec_id, any_value(sky) AS sky, greatest(0.0e0, any_value(sky) - 2.8e0 * 1.4826e0 * median(abs(v - sky))) AS black FROM q JOIN s USING (vec_id) GROUP BY q.vec_id),
b AS (SELECT vec_id, black, greatest(1 - black, 1e-6) AS span, {_CLIP.format("(sky - black) / greatest(1 - black, 1e-6)")} AS xb FROM n),
m AS (SELECT vec_id, black, span, least(0.999e0, greatest(1e-6, xb * (0.15e0 - 1) / (2 * xb * 0.15e0 - xb - 0.15e0))) AS mid FROM b),
u AS (SELECT p.vec_id, y, x, mid, greatest(0.0e0, least(1.0e0, (v - black) / span)) AS u FROM p JOIN m USING (vec_id))
{_sql("CASE WHEN u <= 0 THEN 0 WHEN u >= 1 THEN 1 ELSE (mid - 1) * u / ((2 * mid - 1) * u - mid) END", "u")}""")  # fmt: skip
def node_stretch_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames too small for extended light: their sky goes to the top of its range."""
    return _out(run("stretch", image=frames(spark, sf_dir), method="auto")["image"])


@query("node_auto_bp_shift", f"""WITH {_RGB}, c AS (SELECT vec_id, 0 AS k, y, x, r AS v FROM rgb UNION ALL SELECT vec_id, 1, y, x, g FROM rgb UNION ALL SELECT vec_id, 2, y, x, b FROM rgb),
s AS (SELECT vec_id, k, quantile_cont(v, 0.3) AS sky FROM c GROUP BY vec_id, k), n AS (SELECT c.vec_id, c.k, y, x, v - sky + min(sky) OVER (PARTITION BY c.vec_id) AS v FROM c JOIN s ON c.vec_id = s.vec_id AND c.k = s.k),
b AS (SELECT vec_id, quantile_cont(v, 0.01) AS lo, max(v) AS hi FROM n GROUP BY vec_id), o AS (SELECT n.vec_id, k, y, x, greatest(0.0e0, least(1.0e0, (v - lo) / greatest(hi - lo, 1e-12))) AS v FROM n JOIN b USING (vec_id)) {_sql("v", "o", "CAST(k AS INTEGER) AS k, ")}""")  # fmt: skip
def node_auto_bp_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(run("auto_bp_shift", image=colours(spark, sf_dir))["image"], "k")


_MAD = "greatest(1e-12, median(abs({v} - {m})))"


@query("node_channel_map", f"""WITH {_RGB}, o AS (SELECT vec_id, y, x, r AS h, (g + b) / 2 AS o FROM rgb), m AS (SELECT vec_id, median(h) AS mh, median(o) AS mo FROM o GROUP BY vec_id),
d AS (SELECT o.vec_id, any_value(mh) AS mh, any_value(mo) AS mo, {_MAD.format(v="h", m="mh")} AS dh, {_MAD.format(v="o", m="mo")} AS d_o FROM o JOIN m USING (vec_id) GROUP BY o.vec_id),
s AS (SELECT o.vec_id, y, x, (o - mo) * dh / d_o * 1.4e0 + mh AS v FROM o JOIN d USING (vec_id)), t(d) AS (VALUES (-1), (0), (1)),
f AS (SELECT a.vec_id, a.y, a.x, median(b.v) AS v FROM s a, t i, t j, s b WHERE b.vec_id = a.vec_id AND b.y = greatest(0, least(7, a.y + i.d)) AND b.x = greatest(0, least(7, a.x + j.d)) GROUP BY ALL),
z AS (SELECT vec_id, 0 AS k, y, x, h AS v FROM o UNION ALL SELECT vec_id, 1, y, x, v FROM f UNION ALL SELECT vec_id, 2, y, x, v FROM f) {_sql("v", "z", "CAST(k AS INTEGER) AS k, ")}""")  # fmt: skip
def node_channel_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(run("channel_map", image=colours(spark, sf_dir), enabled=True)["image"], "k")


@query("node_color_balance", f"WITH {_RGB}, z AS (SELECT vec_id, 0 AS k, y, x, r AS v FROM rgb UNION ALL SELECT vec_id, 1, y, x, g + 0.85e0 * (least(g, (r + b) / 2) - g) FROM rgb UNION ALL SELECT vec_id, 2, y, x, b FROM rgb) {_sql('v', 'z', 'CAST(k AS INTEGER) AS k, ')}")
def node_color_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(run("color_balance", image=colours(spark, sf_dir))["image"], "k")


@query("node_starnet_recombine", f"WITH {_P}, u AS (SELECT vec_id, y, x, v, greatest(0.0e0, v * v) AS s FROM (SELECT vec_id, y, x, v FROM p)) {_sql('1 - (1 - v) * (1 - power(CAST(CAST(s AS FLOAT) AS DOUBLE), 2.0e0))', 'u')}")
def node_starnet_recombine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stars (the squares) shrunk to half and screened over the frame."""
    f = frames(spark, sf_dir)
    stars = f.withColumn("px", F.transform("px", lambda v: (v.cast("double") * v.cast("double")).cast("float")))
    return _out(run("starnet_recombine", starless=f, stars=stars, blend="screen", amount=0.5)["image"])


@query("node_narrowband_extract", f"""WITH {_P}, e AS (SELECT vec_id, y // 2 AS y, x // 2 AS x, max(v) FILTER (y % 2 = 0 AND x % 2 = 0) AS h, (max(v) FILTER (y % 2 = 0 AND x % 2 = 1) + max(v) FILTER (y % 2 = 1 AND x % 2 = 0) + max(v) FILTER (y % 2 = 1 AND x % 2 = 1)) / 3 AS o FROM p GROUP BY vec_id, p.y // 2, p.x // 2),
ha AS (WITH b AS (SELECT y, x, CAST(CAST(h AS FLOAT) AS DOUBLE) AS v FROM e), {_kept("b")} SELECT y, x, avg(v) FILTER (keep) AS v FROM k3 GROUP BY y, x), ox AS (WITH b AS (SELECT y, x, CAST(CAST(o AS FLOAT) AS DOUBLE) AS v FROM e), {_kept("b")} SELECT y, x, avg(v) FILTER (keep) AS v FROM k3 GROUP BY y, x),
z AS (SELECT 'ha' AS line, y, x, v FROM ha UNION ALL SELECT 'oiii', y, x, v FROM ox) SELECT line, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, round(CAST(CAST(v AS FLOAT) AS DOUBLE), 6) AS v FROM z""")  # fmt: skip
def node_narrowband_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = run("narrowband_extract", sequence=frames(spark, sf_dir))
    return _image(out["ha"]).withColumn("line", F.lit("ha")).unionByName(_image(out["oiii"]).withColumn("line", F.lit("oiii")))


@query("node_narrowband_compose", f"""WITH {_P}, o AS (SELECT vec_id, y, x, v AS h, CAST(CAST(3 * v * v + 1 AS FLOAT) AS DOUBLE) AS o FROM p), m AS (SELECT vec_id, median(h) AS mh, median(o) AS mo FROM o GROUP BY vec_id),
d AS (SELECT o.vec_id, any_value(mh) AS mh, any_value(mo) AS mo, {_MAD.format(v="h", m="mh")} / {_MAD.format(v="o", m="mo")} AS scale FROM o JOIN m USING (vec_id) GROUP BY o.vec_id), s AS (SELECT o.vec_id, y, x, h, o * scale - scale * mo + mh AS o FROM o JOIN d USING (vec_id)),
z AS (SELECT vec_id, 0 AS k, y, x, h AS v FROM s UNION ALL SELECT vec_id, 1, y, x, 0.7e0 * h + 0.3e0 * o FROM s UNION ALL SELECT vec_id, 2, y, x, o FROM s) {_sql("v", "z", "CAST(k AS INTEGER) AS k, ")}""")  # fmt: skip
def node_narrowband_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    oxygen = f.withColumn("px", F.transform("px", lambda v: (3 * v.cast("double") * v.cast("double") + 1).cast("float")))
    return _out(run("narrowband_compose", ha=f, oiii=oxygen, mode="hso")["image"], "k")


@query("node_narrowband_pack", "SELECT vec_id, CAST(9 AS INTEGER) AS y, CAST(9 AS INTEGER) AS x FROM embeddings")
def node_narrowband_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oxygen's star, two lines and a column away, lands on hydrogen's."""
    star = lambda y, x: F.transform(F.sequence(F.lit(0), F.lit(575)), lambda i: F.exp(-0.5 * (F.pow(F.floor(i / 24) - y, 2) + F.pow(i % 24 - x, 2))).cast("float"))
    f = frames(spark, sf_dir).withColumn("h", F.lit(24)).withColumn("w", F.lit(24))
    out = run("narrowband_pack", ha=f.withColumn("px", star(9, 9)), oiii=f.withColumn("px", star(11, 8)))["image"]
    oxygen = F.transform(F.slice("px", 577, 576), lambda v: F.round(v, 3))
    i = out.select(F.col("img").cast("long").alias("vec_id"), (F.array_position(oxygen, F.array_max(oxygen)) - 1).alias("i"))
    return i.select("vec_id", F.expr("cast(i div 24 as int)").alias("y"), F.expr("cast(i % 24 as int)").alias("x"))


@query("node_downscale", f"WITH {_P}, d AS (SELECT vec_id, y // 2 AS y, x // 2 AS x, avg(v) AS v FROM p GROUP BY vec_id, p.y // 2, p.x // 2) {_sql('v', 'd')}")
def node_downscale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(run("downscale", image=frames(spark, sf_dir), target_size_px=4)["image"])


@query("node_save_image", f"WITH {_P}, q AS (SELECT vec_id, y, x, floor(greatest(0.0e0, least(1.0e0, v)) * 65535 + 0.5e0) / 65535 AS v FROM p) {_sql('v', 'q')}")
def node_save_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that each frame's PNG file holds."""
    return _out(run("save_image", image=frames(spark, sf_dir))["image"])


_TEMPLATE = {
    "name": "two_nights",
    "nodes": [
        {"id": "convert", "kind": "convert_lights", "inputs": {"lights": "input.lights"}, "per_session": True},
        {"id": "stack", "kind": "seq_stack", "params": {"method": "median", "norm": "no"}, "inputs": {"sequence": "convert.sequence"}, "per_session": True},
        {"id": "combine", "kind": "combine_stacks", "params": {"weight": "none"}, "inputs": {"images": ["stack.image"]}},
    ],
    "outputs": {"final": "combine.image"},
}


@query("template_run", f"""WITH {_P}, n AS (SELECT label < 5 AS night, y, x, CAST(CAST(median(v) AS FLOAT) AS DOUBLE) AS v FROM p GROUP BY ALL), s AS (SELECT y, x, avg(v) AS v FROM n GROUP BY y, x),
e(event, n) AS (VALUES ('node_cached', 5), ('node_done', 5), ('node_started', 5)) SELECT o.*, (SELECT string_agg(event || '=' || CAST(n AS VARCHAR), ',' ORDER BY event) FROM e) AS events FROM ({_one("v", "s")}) o""")  # fmt: skip
def template_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template over two nights: its first run makes all five nodes, its second finds them in the store."""
    f, store, seen = frames(spark, sf_dir), dag.Store(spark, fresh_path(spark, "store")), []
    t = dag.expand(dag.Template.from_dict(_TEMPLATE), ["a", "b"])
    lights = {"lights@a": f.filter("temp < -5"), "lights@b": f.filter("temp >= -5")}
    for _ in range(2):
        out = dag.run(t, store, lights, {"lights@a": "a", "lights@b": "b"}, events=seen.append)
    kinds = sorted({e["type"] for e in seen})
    return _image(out["final"]).withColumn("events", F.lit(",".join(f"{k}={sum(e['type'] == k for e in seen)}" for k in kinds)))


@query("node_by_address", f"WITH {_P}, d AS (SELECT vec_id, y // 2 AS y, x // 2 AS x, avg(v) AS v FROM p GROUP BY vec_id, p.y // 2, p.x // 2) SELECT *, 'false,true' AS hits FROM ({_sql('v', 'd')})")
def node_by_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One node by itself, twice: made, then found by its address."""
    store, f = dag.Store(spark, fresh_path(spark, "store")), frames(spark, sf_dir)
    runs = [dag.run_node("downscale", store, {"image": f}, {"image": "frames"}, {"target_size_px": 4}) for _ in range(2)]
    return _out(runs[-1][2]["image"]).withColumn("hits", F.lit(",".join(str(hit).lower() for _, hit, _ in runs)))
