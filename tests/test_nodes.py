import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.plans import dag, nodes
from skyloom.sources import catalogs, png


def frames(spark, arrays, **meta):
    out = [(f"f{i:02}", i, a.shape[0], a.shape[1], a.shape[2], [float(x) for x in a.ravel()], meta.get("temp"), meta.get("exptime"), meta.get("gain")) for i, a in enumerate(arrays)]
    return spark.createDataFrame(out, nodes.SCHEMA)


def image(df):
    r = df.first()
    return np.array(r.px).reshape(r.c, r.h, r.w)


def test_stacks(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(10, 1, (9, 1, 4, 5)).astype(np.float32)
    a[3, 0, 2, 2] = 900
    seq = frames(spark, a)
    for how, f in (("median", np.median), ("max", np.max), ("min", np.min), ("sum", np.sum)):
        assert np.allclose(image(nodes.seq_stack(seq, how, 3, 3, "n", "no")["image"]), f(a, axis=0), rtol=1e-5)
    assert np.allclose(image(nodes.seq_stack(seq, "mean", 3, 3, "w", "no")["image"]), a.mean(0), rtol=1e-5)
    for kind in "swm":
        clipped = image(nodes.seq_stack(seq, "rej", 2.0, 2.0, kind, "no")["image"])
        assert abs(clipped[0, 2, 2] - np.delete(a, 3, 0).mean(0)[0, 2, 2]) < 1.0
    # frames of other levels and spreads are brought together
    apart = frames(spark, [a[0] * k + b for k, b in ((1, 0), (2, 5), (3, -4))])
    flat = image(nodes.seq_stack(apart, "mean", 3, 3, "n", "addscale")["image"])
    assert np.allclose((flat - np.median(flat)) / flat.std(), (a[0] - np.median(a[0])) / a[0].std(), atol=1e-3)
    with pytest.raises(NotImplementedError):
        dag.KINDS["graxpert"].body(image=seq, enabled=True)
    assert dag.KINDS["graxpert"].body(image=seq, enabled=False)["image"] is seq


def test_calibrate_takes_the_nearest_dark(spark):
    light = frames(spark, [np.full((1, 2, 2), 10.0)], temp=22.0, exptime=30.0, gain=60)
    dark = lambda name, t, v: spark.createDataFrame([(name, 0, 1, 2, 2, [v] * 4, t, 30.0, 60)], nodes.SCHEMA)
    flat = frames(spark, [np.array([[[1.0, 2.0], [2.0, 3.0]]])])
    out = nodes.calibrate(light, [dark("a", 20.0, 4.0), dark("b", 23.0, 2.0)], flat, None, True)["sequence"]
    assert np.allclose(image(out), 8.0 / (np.array([[1, 2], [2, 3]]) / 2))
    assert nodes.calibrate(frames(spark, [np.ones((1, 2, 2))], exptime=99.0), [dark("a", 20.0, 4.0)], None, None, True)["sequence"].count() == 0


def test_kernels(spark):
    rng = np.random.default_rng(2)
    a = rng.random((3, 8, 8)).astype(np.float32)
    im = frames(spark, [a])
    assert image(nodes.seq_resample(im, True, "area")["sequence"]).shape == (3, 4, 4)
    go = lambda method: image(nodes.stretch(im, method, True, -2.8, 0.25, 1.0, 0.0, 0.25, 1.0, 10.0, 0.0)["image"])
    assert abs(np.median(go("autostretch")) - 0.25) < 0.05 and go("mtf").max() <= 1 and go("asinh").min() >= 0
    assert 0.08 <= np.median(go("auto")) <= 0.15
    g = image(nodes.color_balance(im, True, 1.0)["image"])
    assert (g[1] <= (a[0] + a[2]) / 2 + 1e-6).all()
    b = np.zeros((1, 6, 6), np.float32)
    b[0, 2:5, 1:4] = 1
    assert image(nodes.crop(frames(spark, [b]), True, 0, 0, 0, 0, 0, 0.001, 0)["image"]).shape == (1, 3, 3)
    assert image(nodes.crop(im, True, 0.125, 0.25, 0.375, 0.5, 0, 0, 0)["image"]).tolist() == a[:, 2:6, 1:4].tolist()
    turned = nodes.rotated(a, 3.5, 3.5, 8, 8, 90.0)
    assert np.allclose(turned, np.rot90(a, -1, (1, 2))) or np.allclose(turned, np.rot90(a, 1, (1, 2)))
    stars = nodes.starnet_extract(im, False)
    assert np.allclose(image(nodes.starnet_recombine(stars["starless"], stars["stars"], True, "screen", 1.0)["image"]), a)
    ramp = np.tile(np.linspace(0, 1, 32), (32, 1))[None] + rng.normal(0, 0.001, (1, 32, 32))
    assert image(nodes.seq_bg_extract(frames(spark, [ramp]), 1)["sequence"]).std() < 0.01
    h = star_field(48, 0, 0)[None]
    o = star_field(48, -2.4, 1.3)[None] * 3 + 0.2
    packed = image(nodes.narrowband_pack(frames(spark, [h]), frames(spark, [o]))["image"])
    assert abs(packed[1] - (3 * h[0] + 0.2))[6:-6, 6:-6].max() < 0.05 and (packed[1][:2] == 0).all() and (packed[1][:, -1] == 0).all()
    h = rng.random((1, 8, 8))
    composed = image(nodes.narrowband_compose(frames(spark, [h]), frames(spark, [3 * h + 1]), "hoo")["image"])
    assert np.allclose(composed[0], composed[1], atol=1e-5)
    assert image(nodes.downscale(im, 4)["image"]).shape == (3, 4, 4)
    for f in (lambda: nodes.channel_map(im, True, 1.4), lambda: nodes.auto_bp_shift(im, True, True, 0.01)):
        assert np.isfinite(image(f()["image"])).all()
    mask = np.array([[1, 1, 0], [0, 0, 1], [1, 0, 1]], bool)
    assert nodes.components(mask).tolist() == [[1, 1, 0], [0, 0, 6], [7, 0, 6]]
    assert nodes.coverage(rng.random((16, 16))).shape == (2, 2)


def star_field(n, dy, dx):
    """Five stars on an empty sky, moved."""
    y, x = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
    at = [(14, 17), (20, 30), (27, 21), (33, 33), (24, 12)]
    return sum(np.exp(-((y - a - dy) ** 2 + (x - b - dx) ** 2) / 4.5) for a, b in at)


def test_frames_are_registered(spark):
    shifts = [(0, 0), (1.5, -2.25), (-3, 0.75)]
    seq = frames(spark, [np.stack([star_field(48, *s)] * 3) for s in shifts])
    out = {r.idx: np.array(r.px).reshape(3, 48, 48) for r in dag.KINDS["seq_register"].body(sequence=seq, enabled=True, method="star", transform="shift", framing="first")["sequence"].collect()}
    for a in out.values():
        assert abs(a - star_field(48, 0, 0))[:, 6:-6, 6:-6].max() < 0.02
    assert nodes.seq_register(seq, False, "star", "shift", "first")["sequence"] is seq
    assert nodes.offset(np.zeros((9, 9)), np.ones((9, 9))) == (0.0, 0.0)


def test_auto_levels():
    rng = np.random.default_rng(5)
    sky = 0.1 + rng.normal(0, 0.004, (3, 256, 256))
    faint, strong = sky.copy(), sky.copy()
    faint[:, 64:192, 64:192] += 0.01
    strong[:, 64:192, 64:192] += 0.5
    for a, shown in ((faint, 0.15), (strong, 0.08)):
        black, mid = nodes.auto_levels(a, 0.4, 0.08, 0.15)
        assert 0.085 < black < 0.095
        assert abs(float(nodes.transfer(np.float64((np.median(a[:, :32]) - black) / (1 - black)), mid)) - shown) < 0.02


def test_halving_kernels():
    a = np.tile(np.arange(16.0), (16, 1))[None]
    for interp in ("area", "bilinear", "cubic", "lanczos2", "lanczos3", "nogrid"):
        assert np.allclose(nodes.halve(a, interp)[0, 3, 2:6], [4.5, 6.5, 8.5, 10.5], atol=0.06), interp
    assert nodes.halve(a, "nearest")[0, 0].tolist() == list(range(0, 16, 2))
    with pytest.raises(ValueError):
        nodes.half_taps("other")


def test_saved_images(spark):
    rng = np.random.default_rng(6)
    a = rng.random((3, 5, 4)).astype(np.float32)
    r = nodes.save_image(frames(spark, [a]))["image"].first()
    assert np.allclose(png.decode(bytes(r.content)), a, atol=1e-5) and np.allclose(np.array(r.px).reshape(3, 5, 4), a, atol=1e-5)


def test_png_filters():
    import struct
    import zlib

    rng = np.random.default_rng(7)
    v = rng.integers(0, 256, (5, 6, 4), dtype=np.uint8)
    raw, above = b"", np.zeros((6, 4), int)
    for how, line in enumerate(v.astype(int)):
        left, corner = (np.vstack([np.zeros((1, 4), int), x[:-1]]) for x in (line, above))
        p = left + above - corner
        d = np.stack([abs(p - left), abs(p - above), abs(p - corner)])
        near = np.choose(d.argmin(0), [left, above, corner])
        raw += bytes([how]) + (line - [0, left, above, (left + above) // 2, near][how]).astype(np.uint8).tobytes()
        above = line
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    data = png.MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", 6, 5, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    assert np.allclose(png.decode(data), v[:, :, :3].transpose(2, 0, 1) / 255)


def test_template_end_to_end(spark, tmp_path):
    rng = np.random.default_rng(3)
    lights = {f"lights@{k}": frames(spark, 5 + rng.random((3, 1, 6, 6))) for k in ("a", "b")}
    t = dag.expand(dag.Template.from_dict(dag.EXAMPLE), ["a", "b"])
    out = dag.run(t, dag.Store(spark, str(tmp_path)), lights, {"lights@a": "1", "lights@b": "2"})
    r = out["final"].first()
    assert (r.c, r.h, r.w) == (1, 6, 6) and 0 <= min(r.px) and max(r.px) <= 1
    assert {k for k, v in dag.KINDS.items() if v.body is None} <= {"test_add"}
    assert len(set(dag.KINDS) - {"test_add"}) == 22


def test_catalog_files(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("Name;RA;Dec;Mag;Common\nNGC0224;00:42:44.3;+41:16:09;3.4;Andromeda Galaxy,x\nIC1;bad;-00:30:00;;\n")
    raw = catalogs.read_catalog(spark, [str(p), str(tmp_path / "none.csv")], ["Name", "RA", "Dec", "Mag", "Common"])
    e = catalogs.catalog_entries(raw, "Name", "RA", "Dec", "Mag", "Common")
    got = {r.canonical: r for r in e.collect()}
    assert got["NGC 224"].common_name == "Andromeda Galaxy" and abs(got["NGC 224"].ra - 10.684583) < 1e-5
    assert got["IC 1"].ra is None and got["IC 1"].dec == -0.5 and got["IC 1"].magnitude is None and got["IC 1"].common_name is None
    assert {r.alias: r.canonical for r in catalogs.alias_table(e).collect()}["ngc224"] == "NGC 224"
    (tmp_path / "l.json").write_text('["M 31", "M 42"]')
    (tmp_path / "n.json").write_text('{"M 31": "Andromeda"}')
    assert [tuple(r) for r in catalogs.ranked_list(spark, str(tmp_path / "l.json")).orderBy("rank").collect()] == [(0, "M 31"), (1, "M 42")]
    assert catalogs.name_table(spark, str(tmp_path / "n.json")).first().name == "Andromeda"
    (tmp_path / "t.yaml").write_text("name: x\n---\nname: y\n")
    assert [d["name"] for d in catalogs.read_yaml(tmp_path)] == ["x", "y"]
    w = spark.createDataFrame([('{"hourly": {"time": ["a", "b"], "cloud_cover": [10, 90], "rain": [0, 1], "snowfall": [0, 0]}}',)], "r string")
    hours = w.select(F.inline(catalogs.hourly(F.col("r")))).collect()
    assert [(h.time, h.cloud_cover) for h in hours] == [("a", 10.0), ("b", 90.0)]


def test_masters_sizes_migrations_png(spark):
    files = spark.createDataFrame([("file:/r/TELE/dark/dark_exp_15.0_gain_60_bin_1_38C_stack_10.fits", 5), ("file:/r/x.fits", 1)], "path string, length long")
    m = catalogs.factory_masters(files, "file:/r").collect()
    assert len(m) == 1 and (m[0].camera, m[0].kind, m[0].gain, m[0].stack) == ("TELE", "dark", 60, 10)
    seq = spark.createDataFrame([("s", "a", 10, {}), ("s", "b", 20, {"BITPIX": "16"})], "seq string, path string, length long, header map<string,string>")
    assert tuple(catalogs.sequence_size(seq).first()) == ("s", 30, 2, 16)
    steps = [lambda t: t | {"b": t["a"]}, lambda t: {k: v for k, v in t.items() if k != "a"}]
    got, version = catalogs.migrate({"a": seq}, 0, steps)
    assert list(got) == ["b"] and version == 2 and catalogs.migrate(got, 2, steps)[0] == got
    with pytest.raises(ValueError):
        catalogs.migrate({}, 3, steps)
    assert png.encode(np.zeros((2, 3)))[:8] == b"\x89PNG\r\n\x1a\n"


def test_sequence_sizes_by_storage(spark, tmp_path):
    """Frames of one number go by file and row, whatever the order in which files are read (large ones first)."""
    import duckdb

    from skyloom.queries import ORACLE, QUERIES

    (tmp_path / "lineitem.parquet").mkdir()
    rows = "SELECT range // 4 AS l_orderkey, CAST(1 + range % 2 * 2 AS INTEGER) AS l_linenumber, range * {k} + {odd} AS l_partkey, 1.0e0 AS l_quantity FROM range({n})"
    for name, k, odd, n in (("part-0", 2, 0, 40), ("part-1", 2, 1, 4000)):
        duckdb.sql(f"COPY ({rows.format(k=k, odd=odd, n=n)}) TO '{tmp_path}/lineitem.parquet/{name}.parquet' (FORMAT parquet)")
    c = duckdb.connect()
    c.sql("SET threads = 1")
    c.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = sorted(c.sql(ORACLE["sequence_sizes"]).fetchall())
    assert [r[3] for r in want[:11]] == [16] * 10 + [-32]
    assert sorted(tuple(r) for r in QUERIES["sequence_sizes"](spark, str(tmp_path)).collect()) == want
