import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.sources import fits
from skyloom.streaming import jobs


def files(tmp_path):
    a = np.arange(12, dtype=np.float32).reshape(3, 4)
    (tmp_path / "night").mkdir()
    (tmp_path / "night" / "a.FITS").write_bytes(fits.write_fits(a, {"OBJECT": "M 33", "EXPTIME": 30.0, "NOTE": "it's"}))
    (tmp_path / "b.fit").write_bytes(fits.write_fits(np.zeros((2, 2), np.uint16) + 7, {"GAIN": 60}))
    (tmp_path / "cut.fits").write_bytes(fits.write_fits(a)[:-2880])
    (tmp_path / "junk.fits").write_bytes(b"nothing")
    (tmp_path / "c.txt").write_text("no")
    return a


def test_fits_round_trip(spark, tmp_path):
    a = files(tmp_path)
    h = {r.path.rsplit("/", 1)[1]: r for r in fits.read_headers(spark, str(tmp_path)).collect()}
    assert h["a.FITS"].header["OBJECT"] == "M 33" and h["a.FITS"].header["NOTE"] == "it's" and h["a.FITS"].complete
    assert h["b.fit"].header["GAIN"] == "60" and "OBJECT" not in h["b.fit"].header
    assert not h["cut.fits"].complete and h["junk.fits"].header is None and len(h) == 4
    im = {r.path.rsplit("/", 1)[1]: r for r in fits.read_images(spark, str(tmp_path)).collect()}
    assert np.allclose(np.array(im["a.FITS"].px).reshape(3, 4), a / 11) and set(im["b.fit"].px) == {0.0}


def test_heads_alone(spark, tmp_path):
    files(tmp_path)
    whole = {r.path: (r.header, r.complete) for r in fits.read_headers(spark, str(tmp_path)).collect()}
    heads = fits.read_headers(spark, str(tmp_path), hashed=False)
    assert {r.path: (r.header, r.complete) for r in heads.collect()} == whole
    assert "sha256" not in heads.columns and fits.head_of(str(tmp_path / "b.fit")) == (tmp_path / "b.fit").read_bytes()[:2880]


def test_files_are_written_whole_and_once(spark, tmp_path):
    rows = spark.createDataFrame([("a.bin", b"12"), ("b.bin", b"")], "name string, content binary")
    out = tmp_path / "out"
    assert sorted((r.path.rsplit("/", 1)[1], r.length) for r in fits.write_files(rows, str(out)).collect()) == [("a.bin", 2), ("b.bin", 0)]
    at = (out / "a.bin").stat().st_mtime_ns
    fits.write_files(rows, str(out)).collect()
    assert (out / "a.bin").stat().st_mtime_ns == at and sorted(p.name for p in out.iterdir()) == ["a.bin", "b.bin"]


def test_scratch(spark):
    import gc
    import os
    import time

    from skyloom.sources import scratch

    df = scratch.cut(spark.range(10))
    place = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get().split(":", 1)[1]
    assert os.path.isdir(place) and df.count() == 10
    del df
    for _ in range(40):  # the files go once nothing refers to them
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
        if not os.path.isdir(place):
            break
    assert not os.path.isdir(place)


def test_listing_and_incremental(spark, tmp_path):
    files(tmp_path)
    found = fits.listing(spark, str(tmp_path))
    assert found.count() == 4
    known = found.withColumn("hash", F.when(~F.col("path").contains("b.fit"), "x")).withColumn("length", F.when(F.col("path").contains("cut"), 1).otherwise(F.col("length")))
    assert sorted(r.path.rsplit("/", 1)[1] for r in fits.changed(found, known).collect()) == ["b.fit", "cut.fits"]
    assert "content" not in found._jdf.queryExecution().executedPlan().toString()


def test_master_names(spark):
    r = spark.range(1).select(fits.master_fields(F.lit("dark_exp_15.000000_gain_60_bin_1_38C_stack_10.fits")).alias("m")).first().m
    assert (r.kind, r.exposure, r.gain, r.binning, r.temp, r.stack, r.ir) == ("dark", 15.0, 60, 1, 38, 10, None)
    h = spark.range(1).select(fits.enrich(F.create_map(F.lit("GAIN"), F.lit("2")), F.lit("dark_exp_15.000000_gain_60_bin_1_38C_stack_10.fits")).alias("h")).first().h
    assert h == {"EXPTIME": "15.0", "GAIN": "2", "DET-TEMP": "38"}


def test_bad_header():
    with pytest.raises(ValueError):
        fits.parse_header(b" " * 2880)


def test_stream_state_survives_batches(spark, tmp_path):
    src = str(tmp_path / "src")
    sim = jobs.simulate(spark, 2, 300).select("event_id", "user_id", "ts", "event_type", "value").cache()
    for k in range(3):
        sim.filter((F.col("event_id") >= 200 * k) & (F.col("event_id") < 200 * (k + 1))).coalesce(1).write.mode("append").parquet(src)
    got = jobs.run_once(jobs.streaks(jobs.read_events(spark, src, 1)), "t-streaks", "append")
    from skyloom.operators.sessions import streaks

    want = streaks(sim, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", F.col("event_type") == "purchase")
    assert sorted((r.event_id, r.streak) for r in got.collect()) == sorted((r.event_id, r.streak) for r in want.collect())
    closed = jobs.run_once(jobs.gap_sessions(jobs.read_events(spark, src, 1), "1 hour", "10 minutes"), "t-gaps", "append")
    assert closed.count() >= 1
    half = jobs.run_once(jobs.throughput(jobs.read_events(spark, src, 1), None), "t-half", "complete")
    assert half.agg(F.sum("failed")).first()[0] == sim.filter("event_type = 'error'").count()


def test_tail_and_verdicts(spark, tmp_path):
    src = str(tmp_path / "src")
    jobs.simulate(spark, 1, 100).select("event_id", "user_id", "ts", "event_type", "value").write.parquet(src)
    seen = []
    jobs.tail(jobs.read_events(spark, src), 90, lambda b, n: seen.extend(r.event_id for r in b.collect()), str(tmp_path / "marks")).awaitTermination()
    assert seen == list(range(91, 100))
    known = spark.createDataFrame([(1, "n1", 0.0, "scrap"), (2, "n1", 900.0, "keep")], "user_id long, night string, usable_s double, verdict string")
    fresh = spark.createDataFrame([(1, "n1", 4, 0, 100), (3, "n1", 9, 0, 4_000_000_000)], "user_id long, night string, good int, rescued int, newest long")
    got = {r.user_id: r.verdict for r in jobs.verdicts(fresh, known, 4_100_000_000).collect()}
    assert got == {1: "keep", 2: "keep", 3: "waiting"}


def test_alerts_come_once_per_ttl(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = [(i, 1, s, "error") for i, s in enumerate([0, 10, 50, 70, 200])]
    spark.createDataFrame(rows, "event_id long, user_id long, s long, event_type string").select("event_id", "user_id", F.timestamp_seconds("s").alias("ts"), "event_type").write.parquet(src)
    got = jobs.run_once(jobs.alerts_once(jobs.read_events(spark, src), 60), "t-alerts", "append")
    assert sorted(r.event_id for r in got.collect()) == [0, 3, 4]


def test_images_encode_to_fits(spark, tmp_path):
    a = files(tmp_path)
    im = spark.createDataFrame([("x", 1, 3, 4, [float(v) for v in a.ravel()])], "img string, c int, h int, w int, px array<float>")
    header, data = next(fits.units(fits.encode_images(im).first().content))
    assert header["NAXIS"] == "2" and np.allclose(data, a)


def test_accounts_in_the_stream(spark, tmp_path):
    """The stream's account of status reports is the batch's, over several batches."""
    from skyloom.operators import scheduling
    from skyloom.workload.planning import _reports
    from tests.conftest import SF

    columns = ["event_id", "user_id", "n", "job", "target", "captured", "failed", "share"]
    r = _reports(spark, SF).select(*columns)
    src = str(tmp_path / "src")
    for k in range(3):
        r.filter((F.col("n") > 5 * k) & (F.col("n") <= 5 * (k + 1))).coalesce(1).write.mode("append").parquet(src)
    kind = "event_id long, user_id long, n int, job long, target string, captured long, failed long, share double"
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(src)
    got = jobs.run_once(scheduling.account_stream(stream, "user_id", ["n"], kind), "t-account", "append")
    want = scheduling.account(r.filter("n <= 15"), "user_id", ["n"])
    pick = ["event_id", *scheduling.ACCOUNT]
    assert sorted(map(tuple, got.select(*pick).collect())) == sorted(map(tuple, want.select(*pick).collect()))


def test_sessions_keep_their_ids(spark, tmp_path):
    """A late frame that joins two sessions leaves the larger one's id; sessions of untouched users stay."""
    minute = 60
    state = jobs.Sessions(spark, str(tmp_path), 10 * minute * 1_000_000)

    def step(number, rows):
        state.step(spark.createDataFrame(rows, "event_id long, user_id long, s long").select("event_id", "user_id", F.timestamp_seconds("s").alias("ts")), number)
        return {r.event_id: r.session for r in state._version(number).collect()}

    one = step(0, [(0, 1, 0), (1, 1, minute), (2, 1, 18 * minute), (3, 2, 0)])
    assert one[0] == one[1] and len({one[0], one[2], one[3]}) == 3
    two = step(1, [(4, 1, 9 * minute), (5, 1, 90 * minute)])
    assert two[0] == two[1] == two[2] == two[4] == one[0] and two[3] == one[3] and two[5] not in one.values()
    three = step(2, [(6, 2, -5 * minute)])
    assert three[6] == three[3] == one[3] and all(three[k] == v for k, v in two.items())
    assert step(2, [(6, 2, -5 * minute)]) == three  # a batch that is done again
