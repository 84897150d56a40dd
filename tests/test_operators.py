"""Semantics that the driver's tables do not show: nulls, ties, boundaries."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.functions import sphere, text, values
from skyloom.operators import dml, matching, pixels, sessions, spatial, storage

MIN = 60_000_000


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_gap_is_strict_and_nulls_cut(spark):
    at = [0, 15 * MIN, 75 * MIN, 136 * MIN, None, None]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(at)], "k int, id int, at long")
    got = [r.session_no for r in sessions.number_gaps(df, ["k"], "at", "id", 60 * MIN).orderBy("id").collect()]
    assert got == [1, 1, 1, 2, 3, 4]


def test_night_by_longitude(spark):
    at = [1_794_531_600_000_000, 1_794_576_600_000_000]  # 2026-11-13 01:00Z and 13:30Z
    assert [one(spark, sessions.night(F.lit(t), -121.3)) for t in at] == ["2026-11-12", "2026-11-12"]


def test_streak_stall_and_rate(spark):
    df = spark.createDataFrame([(1, i, i * 10, k, float(v)) for i, (k, v) in enumerate([("e", 1), ("e", 5), ("ok", 3), ("e", 9)])], "k int, id int, at int, kind string, v double")
    assert [r.streak for r in sessions.streaks(df, ["k"], ["id"], F.col("kind") == "e", F.col("kind") == "ok").orderBy("id").collect()] == [1, 2, 0, 1]
    assert [r.rate for r in sessions.rate(df, ["k"], ["id"], "at", "v").orderBy("id").collect()] == [None, 0.4, 0.0, 0.6]
    assert [r.stalled for r in sessions.stalled(df, ["k"], ["id"], "at", F.col("kind"), 5).orderBy("id").collect()] == [False, True, False, False]


def test_spread_sample_is_int_of_i_count_over_n(spark):
    for count in (0, 5, 12, 13, 40):
        df = spark.range(count).select(F.lit(1).alias("k"), "id")
        got = sorted(r.id for r in sessions.spread_sample(df, ["k"], ["id"], 12).collect())
        assert got == (list(range(count)) if count <= 12 else [int(i * count / 12) for i in range(12)])


@pytest.mark.parametrize(
    ("t", "masters", "want", "delta"),
    [(22, [(1, 22, 10), (2, 20, 20)], 1, 0.0), (22, [(1, 23, 8), (2, 19, 20)], 1, 1.0), (22, [(1, 24, 3), (2, 20, 20)], 2, 2.0), (22, [(1, 40, 3)], None, None), (None, [(1, 22, 3)], None, None)],
)
def test_nearest_master(spark, t, masters, want, delta):
    s = spark.createDataFrame([(7, "a", None if t is None else float(t))], "sid int, inst string, t double")
    m = spark.createDataFrame([(i, "a", float(x), d) for i, x, d in masters], "mid int, m_inst string, mt double, depth int")
    on = F.col("inst") == F.col("m_inst")
    r = matching.nearest_by_temperature(s, m, "sid", on, "t", "mt", "depth", "mid", ["m_inst"]).first()
    assert (r.best.id, r.best.delta) == (want, delta) if want else r.best is None
    far = matching.nearest_by_temperature(s, m, "sid", on, "t", "mt", "depth", "mid", ["m_inst"], fallback=True).first()
    assert far.best.id == (want or 1) and far.best.fallback == (want is None)


def test_frame_dark_pick_is_its_sql(spark, tmp_path, monkeypatch):
    """Unknown and negative gains meet the darks of unknown gain; frames of one number; frames and darks that are alike."""
    import duckdb

    from skyloom.queries import ORACLE, QUERIES
    from skyloom.workload import matching as workload

    duckdb.sql(f"COPY (SELECT range % 40 AS l_orderkey, CAST(1 + range % 7 AS INTEGER) AS l_linenumber, CASE WHEN range % 11 <> 0 THEN CAST(range % 60 AS DOUBLE) - 10.5 END AS l_quantity FROM range(400)) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    duckdb.sql(f"COPY (SELECT range AS p_partkey, CAST(range % 9 * 5 AS INTEGER) AS p_size FROM range(120)) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    c = duckdb.connect()
    for t in ("lineitem", "part"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    want = sorted(c.sql(ORACLE["frame_dark_pick"]).fetchall())
    assert len(want) == 280
    for most in (workload.PICKS, 0):
        monkeypatch.setattr(workload, "PICKS", most)
        assert sorted(tuple(r) for r in QUERIES["frame_dark_pick"](spark, str(tmp_path)).collect()) == want


def test_temperature_bins_truncate(spark):
    assert [one(spark, matching.temperature_bin(F.lit(x), 2.0)) for x in (-1.0, 1.0, 2.0, -2.5)] == [1.0, 1.0, 3.0, -1.0]


def test_radius_join_is_brute_force(spark):
    rng = np.random.default_rng(1)
    a = [(i, float(rng.uniform(0, 360)), float(np.degrees(np.arcsin(rng.uniform(-1, 1))))) for i in range(150)] + [(900, 0.01, 0.0), (901, 12.0, 89.9), (902, 200.0, -90.0)]
    b = [(i, float(rng.uniform(0, 360)), float(np.degrees(np.arcsin(rng.uniform(-1, 1))))) for i in range(150)] + [(900, 359.95, 0.0), (901, 190.0, 89.8), (902, 10.0, -89.5)]
    x, y = spark.createDataFrame(a, "a int, ra double, dec double"), spark.createDataFrame(b, "b int, r double, d double")

    def sep(p, q):
        u, v = (np.array([math.cos(math.radians(d)) * math.cos(math.radians(r)), math.cos(math.radians(d)) * math.sin(math.radians(r)), math.sin(math.radians(d))]) for _, r, d in (p, q))
        return math.degrees(math.atan2(np.linalg.norm(np.cross(u, v)), u @ v))

    for tol in (0.3, 3.0, 11.0):
        got = sorted((r.a, r.b) for r in spatial.radius_join(x, y, ("ra", "dec"), ("r", "d"), tol).select("a", "b").collect())
        assert got == sorted((p[0], q[0]) for p in a for q in b if sep(p, q) <= tol)


def test_first_within_is_brute_force(spark):
    """Sparse and dense places, poles, the seam, equal positions, equal keys, nulls; few cells' pairs are made."""
    rng = np.random.default_rng(2)
    sky = lambda n: list(zip(rng.uniform(0, 360, n), np.degrees(np.arcsin(rng.uniform(-1, 1, n))), strict=True))
    knot = lambda n, ra, dec, wide: list(zip((ra + rng.normal(0, wide, n)) % 360, np.clip(dec + rng.normal(0, wide, n), -90, 90), strict=True))
    places = lambda: sky(150) + knot(150, 0.0, 5.0, 0.4) + knot(100, 80.0, 89.5, 0.5) + knot(60, 200.0, -89.9, 0.05) + [(10.0, 10.0)] * 12 + [(0.0, 90.0), (77.0, -90.0)]
    a, b = [(i % 470, float(r), float(d)) for i, (r, d) in enumerate(places())], [(i, float(r), float(d)) for i, (r, d) in enumerate(places())]
    x, y = spark.createDataFrame([*a, (999, None, 1.0), (None, 5.0, 5.0)], "a int, ra double, dec double"), spark.createDataFrame([*b, (999, 1.0, None)], "b int, r_ double, d_ double")
    pairs = x.crossJoin(y).withColumn("sep", sphere.separation(F.col("ra"), F.col("dec"), F.col("r_"), F.col("d_"))).select("a", "b", "sep").collect()
    for tol, k, minutes in ((20.0, 10, False), (8.0, 1, False), (12.0, 5, True)):
        rank = (lambda p: (float(np.rint(p.sep * 60)), p.b % 3 == 0, p.sep, p.b)) if minutes else (lambda p: (p.sep, p.b))
        order = [*([F.rint(F.col("separation") * 60), F.col("b") % 3 == 0] if minutes else []), "separation", "b"]
        got = spatial.first_within(x, y, "a", ("ra", "dec"), ("r_", "d_"), tol, k, order, 1 / 60 + 1e-9 if minutes else 0.0)
        of: dict = {}
        for p in pairs:
            if p.sep is not None and p.sep <= tol:
                of.setdefault(p.a, []).append(p)
        want = [(str(key), n + 1, p.b) for key, own in of.items() for n, p in enumerate(sorted(own, key=rank)[:k])]
        assert sorted((str(r.a), r.r, r.b) for r in got.collect()) == sorted(want)


def test_sky_joins_broadcast_nothing(spark, monkeypatch):
    """Copies for cells and levels are not in Spark's estimates, by which it would take them for small."""
    from skyloom.queries import QUERIES
    from tests.conftest import SF

    monkeypatch.setattr(spatial, "cut", lambda df: df)  # else the plan ends at the checkpoint
    plan = QUERIES["resolve_cascade"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_first_within_makes_few_pairs(spark):
    """A dense sky: pairs are made within the nearest cells, not within the tolerance."""
    place = lambda n, step: spark.range(n).select(F.col("id"), (F.col("id") * 137.508 % 360).alias("ra"), (F.col("id") * step / n - 60).alias("dec"))
    x, y = place(2000, 119.0).withColumnRenamed("id", "a"), place(20000, 120.0).toDF("b", "r_", "d_")
    seen = spark.sparkContext.accumulator(0)

    def count(rows):
        for r in rows:
            seen.add(len(r))
            yield r

    real = spatial._pairs

    def counted(*args):
        pairs = real(*args)
        return pairs.mapInArrow(count, pairs.schema)

    spatial._pairs = counted
    try:
        got = spatial.first_within(x, y, "a", ("ra", "dec"), ("r_", "d_"), 20.0, 10, ["separation", "b"]).collect()
    finally:
        spatial._pairs = real
    assert len(got) == 20000 and seen.value < 2000 * 200  # some 600 of 20000 are within 20 degrees


def test_sphere(spark):
    assert one(spark, sphere.cell_key(F.lit(37.2), F.lit(121.9))) == "35/120"
    assert one(spark, sphere.cell_key(F.lit(10.0), F.lit(-0.1))) == "10/355"
    assert one(spark, sphere.sexagesimal(F.lit("-00:30:00"), 1.0)) == -0.5
    assert one(spark, sphere.sexagesimal(F.lit("1:2"), 1.0)) is None
    assert 3.5 < one(spark, sphere.fov_diagonal(F.lit(100.0), F.lit(2.0), F.lit(None).cast("double"), F.lit(3008), F.lit(2008))) < 5.0
    ra = spark.createDataFrame([(359.95,), (0.05,)], "ra double").select(sphere.mean_ra(F.col("ra")).alias("x")).first().x
    assert min(ra, 360 - ra) < 1e-9


def test_text(spark):
    names = {"NGC0007": "NGC 7", "m31": "M 31", "NGC 4038A": "NGC 4038 A", "Moon": "Moon"}
    assert {k: one(spark, text.canonical_id(F.lit(k))) for k in names} == names
    assert one(spark, text.normalize_target(F.lit("  M   33 (2) "))) == "M 33"
    assert one(spark, text.canonical_filter(F.lit(" Ha-OIII "))) == "HaOIII" and one(spark, text.canonical_filter(F.lit("  "))) is None
    assert one(spark, text.canonical_instrument(F.lit("Dwarf III"))) == "DWARF3"
    assert one(spark, text.progress(F.lit("done 140%"))) == 1.0 and one(spark, text.progress(F.lit("x"))) is None
    assert one(spark, text.parse_overrides(F.lit("a.x = 1, b.y=two"))) == {"a.x": "1", "b.y": "two"}
    assert one(spark, text.first_set(F.lit(0.0), F.lit(None).cast("double"), F.lit(3.0))) == 3.0


def test_values(spark):
    assert one(spark, values.tail(F.array(*map(F.lit, range(5))), 10)) == [0, 1, 2, 3, 4]
    assert one(spark, values.tail(F.array(*map(F.lit, range(5))), 2)) == [3, 4]
    k = one(spark, values.midtones_for(F.lit(0.1), F.lit(0.25)))
    assert one(spark, values.mtf(F.lit(0.1), F.lit(k))) == pytest.approx(0.25)


def test_dml(spark):
    old = spark.createDataFrame([(1, "a", True), (2, "b", None), (3, "c", False)], "id int, v string, locked boolean")
    new = spark.createDataFrame([(1, "x", False), (2, "y", False), (4, "z", False)], "id int, v string, locked boolean")
    assert {r.id: r.v for r in dml.upsert(old, new, ["id"]).collect()} == {1: "x", 2: "y", 3: "c", 4: "z"}
    assert {r.id: r.v for r in dml.upsert_unless(old, new, ["id"], "locked").collect()} == {1: "a", 2: "y", 3: "c", 4: "z"}


def test_evict_stops_after_the_budget(spark):
    e = spark.createDataFrame([(i, 10) for i in range(10)], "id int, size long")
    got = sorted(r.id for r in storage.evict(e, [F.col("id")], "size", F.lit(25), ["id"], 10).collect())
    assert got == [0, 1, 2]
    assert storage.evict(e, [F.col("id")], "size", F.lit(0), ["id"], 10).count() == 0


def test_pixels(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(3, 64))
    a[2] = 1.0
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(a)], "id int, px array<double>")
    for q in (0.0, 0.01, 0.3, 0.5, 0.995, 1.0):
        got = [r.x for r in df.orderBy("id").select(pixels.quantile(F.col("px"), q).alias("x")).collect()]
        assert np.allclose(got, np.quantile(a, q, axis=1))
    got = [r.x for r in df.orderBy("id").select(pixels.std_of(F.col("px")).alias("x")).collect()]
    assert np.allclose(got, a.std(axis=1))
    img = rng.normal(size=(8, 8))
    assert pixels.best_shift(img, np.roll(img, (2, -3), (0, 1))) == (-2, 3)
    assert (pixels.box_max(img, 1)[3, 3] == img[2:5, 2:5].max())
    p = spark.createDataFrame([(1, 0, 0, v) for v in [1.0] * 20 + [100.0]], "k int, y int, x int, v double")
    assert pixels.stack_sigma_clip(p, ["k"], 3.0, 2).first().v == 1.0


def test_alias_keys_and_wildcards(spark):
    assert one(spark, text.alias_keys(F.lit("NGC0007")))[0] == "ngc0007"
    assert one(spark, matching.wildcard_equal(F.lit("a"), F.lit(None).cast("string"))) is True


def test_healpix_is_equal_area_and_nested(spark):
    rng = np.random.default_rng(5)
    n = 48_000
    pos = [(float(a), float(b)) for a, b in zip(rng.uniform(0, 360, n), np.degrees(np.arcsin(rng.uniform(-1, 1, n))), strict=True)]
    df = spark.createDataFrame(pos, "ra double, dec double").select(sphere.healpix(F.col("ra"), F.col("dec"), 0).alias("p0"), sphere.healpix(F.col("ra"), F.col("dec"), 1).alias("p1"), sphere.healpix(F.col("ra"), F.col("dec"), 2).alias("p2"))
    for c, pixels_ in (("p0", 12), ("p1", 48), ("p2", 192)):
        counts = {r[c]: r["count"] for r in df.groupBy(c).count().collect()}
        assert set(counts) == set(range(pixels_)) and max(counts.values()) < 1.4 * n / pixels_ and min(counts.values()) > 0.6 * n / pixels_
    assert df.filter("p1 div 4 <> p0 OR p2 div 4 <> p1").count() == 0
    assert one(spark, sphere.healpix(F.lit(45.0), F.lit(89.0), 0)) == 0 and one(spark, sphere.healpix(F.lit(0.0), F.lit(0.0), 0)) == 4


def test_tangent_plane_round_trip(spark):
    df = spark.createDataFrame([(10.0, 20.0), (11.5, 19.0), (359.0, 22.0)], "ra double, dec double")
    x, y = sphere.tangent_plane(F.col("ra"), F.col("dec"), F.lit(10.0), F.lit(20.0))
    ra, dec = sphere.from_tangent_plane(F.col("x"), F.col("y"), F.lit(10.0), F.lit(20.0))
    for r in df.withColumn("x", x).withColumn("y", y).withColumn("r2", ra).withColumn("d2", dec).collect():
        assert r.r2 == pytest.approx(r.ra) and r.d2 == pytest.approx(r.dec)
    assert one(spark, sphere.tangent_plane(F.lit(190.0), F.lit(-20.0), F.lit(10.0), F.lit(20.0))[0]) is None


def test_stable_ids_are_greedy(spark):
    rng = np.random.default_rng(9)
    pairs = {(int(a), int(b)): int(n) for a, b, n in zip(rng.integers(0, 12, 60), rng.integers(0, 9, 60), rng.integers(1, 5, 60), strict=True)}
    want, seen = {}, set()
    for (c, o), _ in sorted(pairs.items(), key=lambda kv: (-kv[1], kv[0][1], kv[0][0])):
        if c not in want and o not in seen:
            want[c] = o
            seen.add(o)
    df = spark.createDataFrame([(c, o, n) for (c, o), n in pairs.items()], "cluster long, old long, overlap long")
    assert {r.cluster: r.old for r in sessions.stable_ids(df).collect()} == want
    assert sessions.stable_ids(df.limit(0)).count() == 0


def test_sun_and_boxes(spark):
    ra, dec = sphere.sun(F.lit(1_718_916_660_000_000))  # the June solstice of 2024
    assert one(spark, dec) == pytest.approx(23.44, abs=0.01) and one(spark, ra) == pytest.approx(90, abs=0.05)
    assert one(spark, sphere.sun_altitude(F.lit(1_718_884_800_000_000), F.lit(0.0), F.lit(0.0))) == pytest.approx(90 - 23.44, abs=0.7)
    a = np.arange(20.0).reshape(4, 5)
    assert pixels.box_mean(a, 3)[0, 0] == a[:3, :3].mean() and pixels.box_mean(a, 3).shape == (2, 3)
