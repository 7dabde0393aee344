"""Operators on small tables against direct loops."""

import math
import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulsegrid.config import COMMAND, DIAGNOSTIC, LIBRARY, Analysis, Band, Simulation
from pulsegrid.functions import columns as C
from pulsegrid.operators import kernels, pulse, quantiles, regions, scan, series, spectrum
from pulsegrid.plans import analysis, diagnostic, reports
from pulsegrid.plans.linear_maps import detrend_map
from pulsegrid.sources import faces, history, recordings
from pulsegrid.sources.datasource import SimulatedPulse
from pulsegrid.streaming.monitor import Monitor


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def recording():
    return simulate(72)


def simulate(bpm, **given):
    return recordings.simulate(Simulation(bpm=bpm, **given))


@pytest.fixture(scope="module")
def frames(spark, recording):
    return spark.createDataFrame(recording.assign(session=1))


def test_configuration_is_checked():
    assert LIBRARY.window_s == 10 and COMMAND.window_s == 25 and DIAGNOSTIC.band == Band(0.75, 3.3)
    assert COMMAND.band.low_hz == 0.75 and LIBRARY.having(algorithm="ica").algorithm == "ica"
    for bad in (lambda: Band(2, 1), lambda: Analysis(window_s=0), lambda: Simulation(bpm=0), lambda: Simulation(width=8)):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize("n,size,step", [(40, 10, 3), (40, 10, 25), (9, 10, 1), (30, 30, 30)])
def test_count_windows_equal_a_ring_buffer(spark, n, size, step):
    got = series.count_windows(spark.range(n).select(F.lit("a").alias("session"), F.col("id").alias("i")), size, step)
    found = {r.window_id: (r.a, r.b, r.c, r.k) for r in got.groupBy("window_id").agg(F.min("i").alias("a"), F.max("i").alias("b"), F.count("*").alias("c"), F.max("k").alias("k")).collect()}
    expected, since = {}, 0
    for i in range(n):
        since += 1
        if i + 1 >= size and since >= step:
            expected[len(expected)] = (i - size + 1, i, size, size - 1)
            since = 0
    assert found == expected


def test_pos_equals_the_loop(frames, recording):
    c = recording[["r", "g", "b"]].to_numpy().T
    size, out = 48, np.zeros(c.shape[1])
    for j in range(c.shape[1] - size + 1):
        r, g, b = kernels.normalise(c[:, j : j + size])
        s1, s2 = g - b, g + b - 2 * r
        h = s1 + s1.std() / s2.std() * s2
        out[j : j + size] += (h - h.mean()) / h.std()
    got = pulse.pos(frames, 30.0).orderBy("i").toPandas()["pulse"].to_numpy()
    assert np.allclose(got, out, atol=1e-8)
    few = pulse.pos(frames.filter("i < 20"), 30.0).orderBy("i").toPandas()["pulse"].to_numpy()
    r, g, b = kernels.normalise(c[:, :20])
    h = (g - b) + (g - b).std() / (g + b - 2 * r).std() * (g + b - 2 * r)
    assert np.allclose(few, (h - h.mean()) / h.std(), atol=1e-8)


def test_spectra_equal_numpy(frames, recording):
    band = Band()
    got = spectrum.periodogram(frames, "g", 30.0, band).orderBy("bin").toPandas()
    hz, power = kernels.spectrum(recording["g"].to_numpy(), 30.0)
    inside = (hz >= band.low_hz) & (hz <= band.high_hz)
    assert np.allclose(got["hz"], hz[inside]) and np.allclose(got["power"], power[inside], rtol=1e-6)
    peak = spectrum.dominant(spectrum.periodogram(frames, "g", 30.0, band), band).first()
    assert abs(peak.bpm - 72) < 1 and peak.snr_db == pytest.approx(kernels.dominant(recording["g"].to_numpy(), 30.0, band)[1], abs=0.05)


def test_spectral_bandpass_equals_a_masked_transform(frames, recording):
    x = recording["g"].to_numpy()
    z = np.fft.fft(x - x.mean(), 1024)
    hz = np.abs(np.fft.fftfreq(1024, 1 / 30))
    z[(hz < 0.7) | (hz > 4)] = 0
    got = pulse.spectral_bandpass(frames, ["g"], 30.0, Band(), 600).orderBy("i").toPandas()["g"].to_numpy()
    assert np.allclose(got, np.fft.ifft(z).real[:600], atol=1e-8)


@pytest.mark.parametrize("n", [6, 20, 200])
def test_rectification_equals_least_squares(spark, n):
    rng = np.random.default_rng(n)
    bg = rng.normal(0, 1, n).cumsum() + 50
    x = 100 + 3 * bg + rng.normal(0, 0.3, n)
    df = spark.createDataFrame(pd.DataFrame({"session": 1, "i": range(n), "x": x, "bg": bg}))
    clean = kernels.rectify(x, bg)
    expected = x if clean is None else clean + x.mean()
    got = pulse.rectified(df, "x", "bg").orderBy("i").toPandas()
    assert np.allclose(got["rectified"], expected, atol=1e-6)
    flat = pulse.rectified(df.withColumn("bg", F.lit(1.0)), "x", "bg").orderBy("i").toPandas()
    assert np.allclose(flat["rectified"], x) and (flat["removed"] == 0).all()
    doubled = pulse.rectified(df.withColumn("bg", F.lit(1.0)), "x", "bg", double_level=True).orderBy("i").toPandas()
    assert np.allclose(doubled["rectified"], x + x.mean())
    assert np.allclose(pulse.rectified(df.withColumn("bg", F.when(F.col("i") != 2, F.col("bg"))), "x", "bg").orderBy("i").toPandas()["rectified"], x)


def test_resampling_equals_interpolation(spark):
    rng = random.Random(2)
    t = sorted(rng.uniform(0, 20) for _ in range(80))
    v = [math.sin(x) for x in t]
    rows = list(zip([1] * 80, t, v, strict=True))
    rng.shuffle(rows)
    got = series.resampled(table(spark, rows, "session int, t double, x double"), ["x"], 5.0).orderBy("k").toPandas()
    count = round((t[-1] - t[0]) * 5) + 1
    grid = np.linspace(t[0], t[-1], count)
    assert len(got) == count and np.allclose(got["t"], grid) and np.allclose(got["x"], np.interp(grid, t, v), atol=1e-9)


def test_moving_average_repeats_the_ends(spark):
    x = np.random.default_rng(3).normal(size=30)
    df = spark.createDataFrame(pd.DataFrame({"session": 1, "i": range(30), "x": x}))
    got = series.moving_average(df, "x", 6, "m").orderBy("i").toPandas()["m"]
    assert np.allclose(got, np.convolve(np.pad(x, 3, "edge"), np.ones(7) / 7, "valid"))


def test_rates_of_irregular_times(spark):
    rows = [(1, x) for x in (0.0, 0.1, 0.2, 0.2, 0.9)] + [(2, 5.0)]
    df = table(spark, rows, "session int, t double")
    assert {r.session: round(r.fps, 6) for r in series.effective_fps(df).collect()} == {1: 10.0, 2: 0.0}
    assert {r.session: r.fps for r in series.effective_fps_upper(df).collect()} == {1: 30.0, 2: 30.0}


def test_smoothing(spark):
    df = table(spark, [(1, k, float(v)) for k, v in enumerate([10, 20, 30])], "session int, i int, x double")
    assert [round(r.y, 6) for r in series.smoothed(df, "x", 0.5, "y").orderBy("i").collect()] == [10, 15, 22.5]
    assert [r.y for r in series.smoothed(df, "x", 7, "y").orderBy("i").collect()] == [10, 20, 30]


def test_rectangles(spark):
    row = spark.range(1).select(C.rect(F.lit(10), F.lit(20), F.lit(30), F.lit(40)).alias("a"), C.rect(F.lit(25), F.lit(40), F.lit(30), F.lit(40)).alias("b"))
    got = row.select(C.overlap(F.col("a"), F.col("b")).alias("o"), C.clip_rect(F.col("a"), 30, 30).alias("c"), C.scale_rect(F.col("a"), 0.5).alias("s"), C.part_rect(F.col("a"), 0.0, 0.5, 1.0, 1.0).alias("p"), C.blend_rect(F.col("a"), F.col("b"), 0.5).alias("m")).first()
    assert got.o == pytest.approx(300 / 2100) and tuple(got.c) == (10, 20, 20, 10) and tuple(got.s) == (18, 30, 15, 20) and tuple(got.p) == (10, 40, 30, 20) and tuple(got.m) == (18, 30, 30, 40)
    with pytest.raises(ValueError):
        C.part_rect(F.col("a"), 0.5, 0, 0.5, 1)


def test_powers_of_two_and_guards(spark):
    df = table(spark, [(1,), (2,), (3,), (1024,), (1025,)], "n int")
    assert [r[0] for r in df.select(C.power_of_two(F.col("n"))).collect()] == [1, 2, 4, 1024, 2048]
    fps = table(spark, [(30.0,), (7.0,), (0.0,)], "fps double")
    assert [tuple(r) for r in fps.select(C.nyquist_error(F.col("fps"), Band()), C.band_error(F.col("fps"), Band())).collect()] == [(None, None), ("fps_invalido", "banda_invalida"), ("fps_invalido", "banda_invalida")]
    levels = table(spark, [(6.0,), (5.9,), (0.0,), (-0.1,), (float("-inf"),)], "s double").select(C.confidence(F.col("s")))
    assert [r[0] for r in levels.collect()] == ["alta", "média", "baixa", "descartada", "descartada"]


def test_eyes_anchor_regions(spark):
    point = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    got = spark.range(1).select(regions.eye_regions(point(100, 100), point(160, 100), 320, 240).alias("r"), regions.plausible_eyes(point(100, 100), point(160, 100), F.lit(150)).alias("ok"), regions.plausible_eyes(point(100, 100), point(110, 100), F.lit(150)).alias("near")).first()
    assert [tuple(r) for r in got.r] == [(97, 40, 66, 30), (82, 123, 31, 34), (147, 123, 31, 34)] and got.ok and not got.near


def test_tracker_refuses_jumps_and_holds_its_box():
    t = regions.Tracker(tolerance=2)
    assert t.update((10, 10, 40, 40)) == (10, 10, 40, 40)
    assert t.update((14, 10, 40, 40)) == (11, 10, 40, 40)
    assert t.update((200, 200, 40, 40)) == (11, 10, 40, 40) and t.refused == 1
    assert t.update(None) == (11, 10, 40, 40) and t.update(None) is None
    assert t.update(None) is None and t.update((5, 5, 40, 40)) == (5, 5, 40, 40)


def test_sessions_are_tracked_in_order_batch_by_batch(spark):
    rng = random.Random(7)
    faces = [(rng.randrange(60), rng.randrange(60), rng.randrange(40, 70), 50) if rng.random() < 0.7 else (None,) * 4 for _ in range(131)]
    rows = [(session, i, *faces.pop()) for session, n in (("a", 90), ("b", 1), (None, 40)) for i in range(n)]
    expected = []
    for session in ("a", "b", None):
        own = regions.Tracker(tolerance=2)
        for r in (r for r in rows if r[0] == session):
            box = own.update(None if r[2] is None else r[2:])
            expected.append((session, r[1], *(box or (None,) * 4), box is None))
    rng.shuffle(rows)
    made = regions.tracked(table(spark, rows, "session string, i long, x int, y int, w int, h int"), tolerance=2)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = [tuple(r) for r in made.collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(got, key=str) == sorted(expected, key=str) and {r[-1] for r in got} == {True, False}
    # no data frame of its own for each session, which took most of the time
    assert "FlatMapGroups" not in made._jdf.queryExecution().toString()


def test_pulses_of_stacked_windows_equal_each_windows_own(spark):
    names, lengths = list(kernels.ALGORITHMS), {"a": 130, "b": 70, "c": 20, None: 64}
    rng = np.random.default_rng(5)
    colours = {s: 100 + rng.normal(0, 3, (3, n)) for s, n in lengths.items()}
    config, size, step = Analysis(), 64, 32
    parts = {(s, w): colours[s][:, w * step : w * step + size] for s, n in lengths.items() for w in range((n - size) // step + 1)}
    whole = {(s, 0): c for s, c in colours.items()}
    rows = [(s, 0, i, *map(float, c[:, i])) for s, c in colours.items() for i in range(c.shape[1])]
    random.Random(5).shuffle(rows)
    frames = table(spark, rows, "session string, window_id long, i long, r double, g double, b double")
    chunks = series.count_chunks(frames, size, step, analysis.CHUNK)
    made = {
        "sliding": (analysis.pulses(chunks, 30.0, config, ["session", "chunk"], algorithms=names, sliding=(size, step)), "k", parts),
        "whole": (analysis.pulses(frames, 30.0, config, order="i", algorithms=names), "i", whole),
    }
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for df, order, windows in made.values():
            got = {(r.session, r.window_id, r[order]): [r[a] for a in names] for r in df.collect()}
            assert len(got) == sum(c.shape[1] for c in windows.values()) == df.count()
            for (s, w), c in windows.items():
                long = c.shape[1] >= kernels.least_samples(config.order)
                expected = [kernels.algorithm(a)(c, 30.0, config.band, config.order, config.detrend) if long else [None] * c.shape[1] for a in names]
                found = [[got[s, w, k][j] for k in range(c.shape[1])] for j in range(len(names))]
                assert np.allclose(found, expected, atol=1e-9) if long else found == expected
            # no data frame of its own for each window, which took most of the time
            assert "FlatMapGroups" not in df._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("n", [64, 1100])
def test_kernels_take_stacks(n):
    c = 100 + np.random.default_rng(n).normal(0, 3, (3, 4, n))
    for extract in kernels.STACKED:
        stack = extract(c, 30.0, Band(), 4, 100.0)
        assert np.allclose(stack, [extract(c[:, w], 30.0, Band(), 4, 100.0) for w in range(4)], atol=1e-9)


def test_analysis_finds_the_rate_and_refuses_short_windows(spark, frames):
    found = analysis.sessions(frames, 30.0, Analysis(background=False)).collect()
    assert len(found) == 11 and all(abs(r.bpm - 72) < 1 and r.error_code is None for r in found)
    short = analysis.analysed(frames.filter("i < 20").withColumn("k", F.col("i")).withColumn("window_id", F.lit(0)), 30.0, Analysis(background=False)).first()
    assert short.error_code == "janela_insuficiente" and short.bpm is None


def test_stream_state_equals_the_batch(recording):
    config = Analysis(background=False, smoothing=1.0)
    own = Monitor(30.0, config)
    rows = []
    for r in recording.itertuples():
        own = Monitor(30.0, config, own.saved())  # as a new trigger would find it
        assert (own.progress(r.i) is None) == (len(own.buffer) == 300)
        if (found := own.push(r.i, [None, r.r, r.g, r.b], False)) is not None:
            rows.append(found)
    direct = [analysis.analyse(recording[["r", "g", "b"]].to_numpy()[i - 299 : i + 1].T, 30.0, config)["bpm"] for i in range(299, 600, 30)]
    assert [x[0] for x in rows] == list(range(299, 600, 30)) and np.allclose([x[2] for x in rows], direct)
    last = own.last_bpm
    for k in range(30):  # a flat window fails and keeps the last good analysis
        found = Monitor(30.0, config.having(least_snr_db=1e9), own.saved()).push(600 + k, [None, 1, 2, 3], False) or found
        own.push(600 + k, [None, *recording[["r", "g", "b"]].iloc[k]], False)
    assert found[2] is None and found[5] is not None and found[7] == last
    own.push(700, [None, 1, 2, 3], True)
    assert own.buffer == [] and own.segment == 1 and own.shown is None and own.last_bpm is None


@pytest.mark.parametrize(("fps", "jitter"), [(20.0, 0.0), (50.0, 0.0), (30.0, 0.012)])
def test_windows_are_resampled_at_their_own_rate_in_batch_and_stream(spark, fps, jitter):
    """Analysed as 30 frames a second, whatever the capture's rate: a stream finds what the batch does."""
    made = recordings.simulate(Simulation(bpm=72, duration_s=26, fps=fps, seed=5, jitter_s=jitter))
    config = Analysis(window_s=10.0, step_s=2.0, background=False, smoothing=1.0)
    frames = spark.createDataFrame(made[["i", "t", "r", "g", "b"]].assign(session=1))
    rows = sorted(analysis.sessions(frames, 30.0, config).collect(), key=lambda r: r.window_id)
    assert rows and all(r.error_code is None and abs(r.bpm - 72) < 1.5 for r in rows)
    own = Monitor(30.0, config)
    live = [x for r in made.itertuples() if (x := own.push(r.i, [r.t, r.r, r.g, r.b], False)) is not None]
    assert np.allclose([x[2] for x in live], [r.bpm for r in rows])


def test_windows_do_not_reach_across_lost_faces(spark, recording):
    frames = spark.createDataFrame(recording[["i", "r", "g", "b"]].assign(session=1))
    gone = frames.withColumn("lost", F.col("i").between(280, 283) | (F.col("i") == 20))
    config = Analysis(window_s=4.0, step_s=1.0, background=False, patience=3)
    found = analysis.sessions(gone, 30.0, config).collect()
    own, live = Monitor(30.0, config), []
    for r in recording.itertuples():
        if (x := own.push(r.i, [None, r.r, r.g, r.b], r.i == 20 or 280 <= r.i <= 283)) is not None:
            live.append(x)
    assert [(r.segment, r.window_id) for r in sorted(found, key=lambda r: (r.segment, r.window_id))] == [(0, k) for k in range(6)] + [(1, k) for k in range(7)]
    assert [x[6] for x in live] == [0] * 6 + [1] * 7
    assert analysis.sessions(frames, 30.0, config, limit=150).count() == 2


def test_live_sessions_use_their_background(recording):
    config = Analysis(window_s=10.0, step_s=2.0, algorithm="verde")
    wave = 20 * np.sin(2 * np.pi * 1.9 * np.arange(len(recording)) / 30)  # a white balance that swings
    own, plain = Monitor(30.0, config), Monitor(30.0, config)
    for k, r in enumerate(recording.itertuples()):
        frame = [None, r.r + 0.8 * wave[k], r.g + 0.28 * wave[k], r.b + 0.9 * wave[k]]
        own.push(r.i, [*frame, 100 + 0.8 * wave[k], 100 + 0.28 * wave[k], 100 + 0.9 * wave[k]], False)
        plain.push(r.i, frame, False)
    assert abs(own.last_bpm - 72) < 1 and (plain.last_bpm is None or abs(plain.last_bpm - 72) > 1)


def test_the_grid_skips_windows_without_a_whole_background(spark, recording):
    frames = spark.createDataFrame(recording[["i", "r", "g", "b"]].assign(session=1, variant="a"))
    rows = frames.select("*", *(F.when(F.col("i") != 100, F.lit(90.0) + F.sin("i")).alias(f"bg_{c}") for c in "rgb"))
    found = diagnostic.grid(rows, 30.0, Analysis(window_s=4.0, step_s=2.0, least_snr_db=-100.0), algorithms=["pos"]).collect()
    assert {r.window_id for r in found if not r.with_background} == set(range(9))
    assert {r.window_id for r in found if r.with_background} == set(range(2, 9))


def test_reports(spark):
    rows = [(1, k, 70.0 + k, s, c) for k, (s, c) in enumerate([(7.0, "alta"), (3.0, "média"), (3.0, "média"), (8.0, "alta"), (float("-inf"), "descartada")])]
    df = table(spark, rows, "session int, window_id int, bpm double, snr_db double, confidence string")
    got = reports.session_report(df).first()
    assert (got.windows, got.usable, got.median_bpm, got.median_snr_db) == (5, 4, 71.5, 5.0)
    assert reports.predominant(df, "confidence", "window_id").first().confidence == "alta"
    assert "| 71.50 |" in reports.markdown(reports.session_report(df))


def test_history_store(spark, tmp_path):
    lines = table(spark, [('{"id":"a","instante":5,"pessoa":" Ana ","bpm":70.5}',), ('{"id":"b","instante":9,"pessoa":"Ana","bpm":80.5}',), ("broken",)], "value string")
    records = history.parse(lines).filter("id is not null")
    history.append(records, str(tmp_path / "h"))
    stored = history.read(spark, str(tmp_path / "h"))
    assert [r.id for r in history.listed(stored, 1).collect()] == ["b"]
    assert [r.id for r in history.without(stored, table(spark, [("a",)], "id string")).collect()] == ["b"]
    shown = reports.people(stored.withColumnsRenamed({"pessoa": "person", "instante": "instant"})).first()
    assert (shown.person, shown.records, shown.last, shown.mean_bpm) == ("Ana", 2, 9, 75.5)


def test_exports(spark, tmp_path):
    rows = [("x", 86_400_000, "Ana;B", 72.25, 3.5, "alta", "a\nb")]
    df = table(spark, rows, "id string, instant long, person string, bpm double, snr_db double, confidence string, note string")
    reports.write_history(df, str(tmp_path / "out"))
    text = b"".join(sorted(p.read_bytes() for p in (tmp_path / "out").glob("part-*")))
    assert text.startswith("\ufeffdata;".encode()) and b"02/01/1970;00:00:00;Ana B;72,3;3,5;alta;a b\r\n" in text
    capture = table(spark, [(0, 0.0, "testa", 1.0, 2.0, 3.0, 5)], "i int, t double, variant string, r double, g double, b double, px int")
    wide = reports.capture_wide(capture, ["testa", "centro"]).first()
    assert wide.testa_r == 1.0 and wide.centro_r is None


def test_pixels_by_hand(spark):
    rows = [("a", 0, 200, 150, 120)] * 60 + [("a", 1, 200, 150, 120)] * 49 + [("b", 0, 10, 250, 10)] * 210
    df = table(spark, rows, "frame string, region int, r int, g int, b int")
    assert {r.frame: r.pixels for r in regions.spatial_means(df, ["frame"]).collect()} == {"a": 60, "b": 210}
    assert {r.frame: r.bg_g for r in regions.background_means(df, ["frame"]).collect()} == {"a": None, "b": 250.0}
    assert {r.frame: r.share for r in regions.skin_share(df, ["frame"]).collect()} == {"a": 1.0, "b": 0.0}


def test_videos_need_a_decoder(spark, tmp_path):
    (tmp_path / "v.bin").write_bytes(bytes(range(6)))
    got = recordings.videos(spark, str(tmp_path / "v.bin"), lambda raw: [(k / 30, *map(float, raw[k : k + 3])) for k in range(0, len(raw), 3)]).orderBy("i").collect()
    assert [(r.i, r.r, r.b) for r in got] == [(0, 0.0, 2.0), (1, 3.0, 5.0)]


def test_data_source_in_batches_and_streams(spark, tmp_path):
    spark.dataSource.register(SimulatedPulse)
    options = {"sessions": "3", "seconds": "2", "rows_per_batch": "25", "partitions": "2"}
    batch = spark.read.format("simulated_pulse").options(**options).load()
    assert batch.count() == 180
    stream = spark.readStream.format("simulated_pulse").options(**options).load()
    query = stream.writeStream.format("memory").queryName("pulses").option("checkpointLocation", str(tmp_path / "c")).start()
    for _ in range(100):
        if spark.table("pulses").count() == 180:
            break
        query.processAllAvailable()
    query.stop()
    assert spark.table("pulses").exceptAll(batch).count() == 0 and spark.table("pulses").count() == 180


def test_rendered_faces_give_back_their_rate(spark):
    """From pixels over skin and regions to the rate."""
    s = Simulation(bpm=90, duration_s=12, fps=15, width=64, height=48, noise=1.0, pulse=0.03)
    colours = spark.createDataFrame(recordings.simulate(s).assign(session=7)).repartition(4)
    frames = faces.rendered(colours, s)
    boxes = frames.select("session", "frame", C.rect(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("box"))
    parts = regions.regions_of(boxes, "rosto_central", width=64, height=48)
    pixels = faces.pixels_in(frames, parts, 48, 64)
    skin = pixels.filter(C.is_skin(F.col("r"), F.col("g"), F.col("b")))
    means = regions.spatial_means(regions.trimmed(skin, ["session", "frame", "region"]), ["session", "frame"])
    series_ = means.select("session", F.col("frame").alias("i"), "r", "g", "b")
    found = analysis.sessions(series_, 15.0, Analysis(background=False)).collect()
    assert len(found) == 3 and all(abs(r.bpm - 90) < 3 for r in found)


def test_commands():
    from pulsegrid.__main__ import parser

    args = parser().parse_args(["simulate", "--bpm", "80"])
    assert (args.window, args.bpm_min, args.algorithm) == (25.0, 45.0, "pos")
    with pytest.raises(SystemExit):
        parser().parse_args(["simulate", "--algorithm", "none"])


def test_captures_are_written_with_background_and_box(spark, tmp_path):
    rows = [(i, i / 30, v, 1.0 + i, 2.0, 3.0, 60, None if i == 1 else 9.5, 9.0, 8.0, 4, 5, 40, 50) for i in range(3) for v in ("brow", "cheeks")]
    capture = table(spark, rows, "i long, t double, variant string, r double, g double, b double, px int, bg_r double, bg_g double, bg_b double, box_x int, box_y int, box_w int, box_h int")
    reports.write_capture(capture, ["brow", "cheeks"], str(tmp_path / "c"))
    lines = sorted(line for f in (tmp_path / "c").glob("*.csv") for line in f.read_text().splitlines())
    header = next(x for x in lines if x.startswith("i;"))
    assert header.split(";") == ["i", "t", *(f"{v}_{c}" for v in ("brow", "cheeks") for c in ("r", "g", "b", "px")), "bg_r", "bg_g", "bg_b", "box_x", "box_y", "box_w", "box_h"]
    assert len(set(lines) - {header}) == 3 and ";;9.0;8.0;4;5;40;50" in next(x for x in lines if x.startswith("1;"))
    with pytest.raises(ValueError):
        reports.markdown(capture, rows=5)


def test_morphology_deals_frames_once(spark):
    mask = spark.range(400).select((F.col("id") % 4).alias("frame"), (F.col("id") % 10).alias("y"), F.floor(F.col("id") / 40).alias("x"), (F.col("id") % 3 == 0).cast("int").alias("on"))
    plan = regions.opened_and_closed(mask, ["frame"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_failed_reads_are_dropped_and_thirty_end_a_session(spark):
    failed = {3, 4, *range(10, 39), *range(50, 80)}
    frames = table(spark, [(1, i, i in failed) for i in range(100)], "session int, i int, failed boolean")
    assert [r.i for r in series.read_frames(frames).orderBy("i").collect()] == [i for i in range(50) if i not in failed]


def test_eyes_are_held_and_looked_for_again(spark):
    rng = random.Random(1)
    point = "struct<x:double,y:double>"
    rows, expected, held = [], [], None
    for i in range(200):
        eyes = None if i < 7 or rng.random() < 0.3 else ((float(i), 1.0), (i + 9.0, 1.0))
        if held is None or i % 60 == 0:  # the rule itself
            held = eyes or held
        expected.append(held and held[0][0])
        rows.append((1, i, *(eyes or (None, None))))
    got = regions.held_eyes(table(spark, rows, f"session int, i int, left {point}, right {point}")).orderBy("i").collect()
    assert [r.left and r.left.x for r in got] == expected
    eyes, fractions = F.array(*map(F.lit, (1, 2))), F.array(F.lit(9))
    assert spark.range(1).select(regions.anchored_or_fraction(eyes, fractions).alias("r")).first().r == [9]


@pytest.mark.parametrize(("n", "size", "step", "windows"), [(0, 5, 2, 3), (4, 5, 2, 3), (5, 5, 2, 3), (57, 5, 2, 3), (57, 3, 7, 2), (40, 10, 10, 1)])
def test_chunks_hold_the_windows(spark, n, size, step, windows):
    frames = spark.range(n).select(F.lit("a").alias("session"), F.col("id").alias("i"))
    expected = defaultdict(list)
    for r in series.count_windows(frames, size, step).orderBy("k").collect():
        expected[r.window_id].append(r.i)
    chunks = defaultdict(list)
    for r in series.count_chunks(frames, size, step, windows).orderBy("k").collect():
        assert r.k == len(chunks[r.chunk])
        chunks[r.chunk].append(r.i)
    got = {c * windows + j: rows[j * step : j * step + size] for c, rows in chunks.items() for j in range((len(rows) - size) // step + 1)}
    assert got == dict(expected)


def test_groups_go_on_over_batches():
    rows = pa.RecordBatch.from_pydict({"a": [1, 1, None, None, 2, 2, 2], "b": ["x", "x", "x", None, None, None, None]})
    for size in (1, 2, 3, 7):
        found = []
        for table, starts in analysis.whole_groups((rows.slice(k, size) for k in range(0, 7, size)), ["a", "b"]):
            ends = [*starts[1:], table.num_rows]
            found += [(table["a"][int(s)].as_py(), table["b"][int(s)].as_py(), int(e - s)) for s, e in zip(starts, ends, strict=True)]
        assert found == [(1, "x", 2), (None, "x", 1), (None, None, 1), (2, None, 3)]


def test_missing_clocks_count_frames(spark):
    rows = table(spark, [(0, 0.0, 25.0), (1, 0.04, 25.0), (2, None, 25.0), (3, -1.0, 0.0), (6, None, None)], "i long, t double, fps double")
    got = [r.t for r in rows.orderBy("i").select(C.frame_time(F.col("t"), F.col("i"), F.col("fps")).alias("t")).collect()]
    assert got == [0.0, 0.04, 2 / 25, 3 / 30, 6 / 30]


def test_analyses_are_due_by_time(spark):
    rng = random.Random(3)
    rows = []
    for session in ("a", "b", None):
        t = 0.0
        for _ in range(400):
            t += rng.uniform(0.02, 0.2) if rng.random() > 0.02 else 6.0  # no ties: ranges are read to the microsecond
            rows.append((session, t))
    expected = []
    for session in ("a", "b", None):
        kept, last = [], None
        for t in (t for s, t in rows if s == session):
            kept.append(t)
            while len(kept) > 2 and t - kept[0] > 1.3 * 4.0:
                kept.pop(0)
            if t - kept[0] >= 4.0 and (last is None or t - last > 1.0):
                last = t
                expected.append((session, t, len(kept), len(kept) >= 20))
    rng.shuffle(rows)
    got = [tuple(r) for r in series.due_analyses(table(spark, rows, "session string, t double"), 4.0, 1.0, 20).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str) and {r[3] for r in got} == {True, False}


def test_times_a_hair_apart_are_kept_apart(spark):
    # hours: one frame has left the window, another comes after the one that is due, both by half a millisecond
    hair = 0.0005 / 3600
    rows = [("a", t) for t in (0.0, 20.0, 90.0, 130.0 + hair, 200.0, 200.0 + hair)]
    got = series.due_analyses(table(spark, rows, "session string, t double"), 100.0, 24.0, 4).collect()
    assert sorted((r.t, r.retained, r.enough) for r in got) == [(130.0 + hair, 3, False), (200.0, 3, False)]


@pytest.mark.parametrize("place", ["r", "g", "b", "t"])
@pytest.mark.parametrize("value", [None, float("nan"), float("inf")])
def test_a_missing_colour_or_time_is_refused_in_batch_and_stream(spark, recording, place, value):
    own = recording.iloc[:420][["i", "t", "r", "g", "b"]].astype(object)
    own.loc[350, place] = value
    rows = [(1, int(r.i), *(None if v is None else float(v) for v in (r.t, r.r, r.g, r.b))) for r in own.itertuples()]
    frames = spark.createDataFrame(rows, "session long, i long, t double, r double, g double, b double")
    config = Analysis(background=False, smoothing=0.5)
    found = {r.window_id: r for r in analysis.sessions(frames, 30.0, config).collect()}
    live, own = [], Monitor(30.0, config)
    for _, i, *frame in rows:
        if (x := own.push(i, frame, False)) is not None:
            live.append(x)
    assert len(found) == len(live) == 5
    for k, x in enumerate(live):
        refused = k * 30 <= 350 < k * 30 + 300
        assert (found[k].error_code == "sinal_sem_qualidade") == refused == (x[5] == "sinal_sem_qualidade")
        assert (found[k].bpm is None) == refused and (refused or abs(found[k].bpm - 72) < 1 and abs(x[2] - 72) < 1)
        assert x[3] is None or abs(x[3] - 72) < 1  # what is shown never takes up a refused window


@pytest.mark.parametrize("name", list(kernels.ALGORITHMS))
def test_no_algorithm_judges_what_is_missing(recording, name):
    channels = recording[["r", "g", "b"]].to_numpy()[:300].T.copy()
    times = np.arange(300) / 30.0
    config = Analysis(background=False, algorithm=name)
    assert analysis.analyse(channels, 30.0, config, times=np.full(300, np.nan))["bpm"] == analysis.analyse(channels, 30.0, config)["bpm"]
    times[7] = np.nan
    assert analysis.analyse(channels, 30.0, config, times=times).get("bpm") is None
    for c in range(3):
        bad = channels.copy()
        bad[c, 100] = np.nan
        assert analysis.analyse(bad, 30.0, config) == {"algorithm": name, "error_code": "sinal_sem_qualidade"}
    huge = channels.copy() * 1e305
    assert analysis.analyse(huge, 30.0, config).get("confidence") != "alta" or name == "verde"


def test_quantiles_by_refinement_equal_a_sort(spark):
    rng = np.random.default_rng(7)
    parts = {0: rng.standard_normal(5000), 1: np.exp(rng.standard_normal(3000) * 20), 2: np.round(rng.standard_normal(4000)), 3: np.full(2000, 5.0), None: rng.standard_normal(1000) * 2e307, 4: np.array([1.5])}
    rows = [(k, float(x)) for k, xs in parts.items() for x in xs] + [(0, None), (0, float("nan")), (1, float("inf")), (5, None)]
    df = spark.createDataFrame(rows, "key int, v double").repartition(5)
    wanted = {"a": (F.col("v"), 0.05), "b": (F.col("v"), 0.5), "c": (-F.col("v"), 0.95), "d": (F.col("v"), 1.0)}
    for gather in (2, 900, 10**6):
        found = {r.key: r for r in quantiles.quantiles(df, ["key"], wanted, gather).collect()}
        assert set(found) == {*parts, 5} and found[5].a is None
        for k, xs in parts.items():
            for name, sign, p in (("a", 1, 0.05), ("b", 1, 0.5), ("c", -1, 0.95), ("d", 1, 1.0)):
                assert np.isclose(found[k][name], np.quantile(sign * xs, p), rtol=1e-12, atol=1e-300), (gather, k, name)


def test_smoothing_and_filters_scan_long_sessions_in_many_tasks(spark):
    n = 200_000
    rng = np.random.default_rng(8)
    x = np.cumsum(rng.standard_normal(n))
    frames = spark.createDataFrame(pd.DataFrame({"session": 1, "i": np.arange(n), "x": x})).unionByName(
        spark.createDataFrame([(2, i, float(i * i % 7)) for i in range(40)] + [(3, i, 1.0) for i in range(5)], "session long, i long, x double")
    )
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        runs = scan.dealt(frames, ["session"], "i").filter("session = 1").groupBy("_run").count().collect()
        assert len(runs) >= 4 and max(r["count"] for r in runs) < n / 2
        smooth = series.smoothed(frames, "x", 0.2, "y").filter("session = 1").orderBy("i").toPandas().y.to_numpy()
        made = scan.bandpassed(frames, "x", 30.0, Band(), "y").orderBy("session", "i").toPandas()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    expected = [x[0]]
    for v in x[1:]:
        expected.append(expected[-1] + 0.2 * (v - expected[-1]))
    assert np.allclose(smooth, expected, rtol=1e-12, atol=1e-9)
    for session, own in made.groupby("session"):
        if session == 3:
            assert own.y.isna().all() and len(own) == 5
        else:
            own_x = x if session == 1 else np.array([float(i * i % 7) for i in range(40)])
            assert np.abs(own.y.to_numpy() - kernels.bandpass(own_x, 30.0, Band())).max() < 1e-8


def test_trends_of_long_sessions_are_solved_run_by_run(spark):
    rng = np.random.default_rng(9)
    series_of = {1: np.cumsum(rng.standard_normal(20_000)), 2: rng.standard_normal(5000), 3: rng.standard_normal(3), 4: rng.standard_normal(4), 5: rng.standard_normal(600), 6: rng.standard_normal(1)}
    rows = pd.concat([pd.DataFrame({"session": k, "i": np.arange(len(x)), "x": x}) for k, x in series_of.items()])
    frames = spark.createDataFrame(rows).repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for strength in (100.0, 2.0):
            made = scan.detrended(frames, "x", "y", strength).orderBy("session", "i").toPandas()
            for k, own in made.groupby("session"):
                expected = kernels.detrend(series_of[k], strength) if len(series_of[k]) != 5000 else detrend_map(5000, strength) @ series_of[k]
                assert np.abs(own.y.to_numpy() - expected).max() < 1e-8, (k, strength)
        flat = scan.detrended(frames, "x", "y", 0.0).filter("session = 5").orderBy("i").toPandas().y
        assert np.allclose(flat, series_of[5] - series_of[5].mean())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_frozen_pixels_are_renewed_with_the_shape(spark):
    rng = random.Random(3)
    rows = []
    for f in range(40):
        w = 5 if f < 9 or f >= 21 else 7
        rows += [(1, f, p, w, rng.randrange(256)) for p in range(1, 61)]
    df = spark.createDataFrame(rows, "session long, frame long, place long, w int, g int")
    found = {(r.frame, r.place) for r in regions.frozen_by_shape(df, F.col("g") > 100, "place", ["w"], every=15, least=10).collect()}
    chosen, before, expected = None, None, set()
    for f in range(40):
        own = [(p, w, g) for _, at, p, w, g in rows if at == f]
        if before != own[0][1] or f % 15 == 0:
            chosen, before = {p for p, _, g in own if g > 100}, own[0][1]
        expected |= {(f, p) for p, _, _ in own if p in chosen}
    assert found == expected
    assert regions.frozen_by_shape(df, F.col("g") > 254, "place", ["w"], every=15).count() == 0  # too few are chosen


def test_extremes_and_fixed_regions(spark):
    df = spark.createDataFrame([(1, float(k)) for k in range(100)] + [(2, 1.0), (3, None)], "session long, v double")
    kept = regions.without_extremes(df, "v")
    assert {r.v for r in kept.filter("session = 1").collect()} == set(map(float, range(5, 95))) and kept.filter("session > 1").count() == 2
    assert regions.without_extremes(df.limit(0), "v").count() == 0 and regions.without_extremes(df, "v", 0.0).count() == 102
    with pytest.raises(ValueError):
        regions.without_extremes(df, "v", 50.0)
    frames = spark.createDataFrame([(640, 480), (100, 90), (50, 40)], "width int, height int")
    found = [r.box for r in regions.fixed_region(frames, (60, 50, 100, 80)).orderBy(F.desc("width")).collect()]
    assert [tuple(b) if b else None for b in found] == [(60, 50, 100, 80), (60, 50, 40, 40), None]
    with pytest.raises(ValueError):
        regions.fixed_region(frames, (0, 0, 0, 5))


@pytest.mark.parametrize(("size", "step"), [(3, 2), (2, 5), (1, 1)])
def test_bounds_of_windows_equal_their_frames(spark, size, step):
    frames = spark.createDataFrame([(s, i) for s in (1, 2) for i in range(11 * s)], "session long, i long")
    whole = series.count_windows(frames, size, step).groupBy("session", "window_id").agg(F.min("i").alias("first_i"), F.max("i").alias("last_i"), F.count("*").alias("n"))
    assert sorted(map(tuple, series.window_bounds(frames, size, step).collect())) == sorted(map(tuple, whole.collect()))


def test_windows_of_a_grid_begin_with_the_session(spark):
    frames = spark.createDataFrame([(1, i) for i in range(30)], "session long, i long")
    for at_once, first in ((True, 0), (False, 6)):
        made = series.count_chunks(frames, 4, 10, 2, at_once=at_once).collect()
        begins = sorted({r.i for r in made if r.k % 10 == 0})
        assert begins == list(range(first, 30, 10))
