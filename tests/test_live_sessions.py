"""Live sessions on list states against batches: over many triggers, out of order, with control rows and failed reads."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.config import Analysis, Simulation
from pulsegrid.plans import analysis
from pulsegrid.sources import recordings
from pulsegrid.streaming import monitor, sessions

CONFIG = Analysis(window_s=4.0, step_s=1.0, background=False, smoothing=1.0, least_snr_db=-10.0)


@pytest.fixture(scope="module")
def recording():
    made = recordings.simulate(Simulation(bpm=72, duration_s=16, seed=4))[["i", "t", "r", "g", "b"]]
    return made.assign(session=1, when=pd.Timestamp("2024-01-01") + pd.to_timedelta(made.t, unit="s"))


def run(spark, tmp_path, parts, **given):
    """The rows of a stream that finds one part a trigger."""
    kinds = {"i": "long", "session": "long", "when": "timestamp", "lost": "boolean", "failed": "boolean", "algorithm": "string"}
    fields = ", ".join(f"`{c}` {kinds.get(c, 'double')}" for c in parts[0].columns)
    for k, part in enumerate(parts):
        rows = [tuple(None if pd.isna(v) else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in r) for r in part.astype(object).itertuples(index=False, name=None)]
        spark.createDataFrame(rows, fields).coalesce(1).write.parquet(f"{tmp_path}/in/{k:03d}")
    schema = spark.read.parquet(f"{tmp_path}/in/000").schema
    stream = monitor.frame_stream(spark, f"{tmp_path}/in/*", schema, files_per_batch=1)
    return monitor.drained(sessions.live(stream, 30.0, CONFIG, **given), "live", str(tmp_path))


def in_batch(spark, frames, config=CONFIG):
    rows = analysis.sessions(spark.createDataFrame(frames[["session", "i", "t", "r", "g", "b"]]), 30.0, config).orderBy("window_id").collect()
    return [r.bpm for r in rows]


def estimates(df):
    return df.filter("session = 1 AND progress = 1").orderBy("i").collect()


def test_many_triggers_give_what_a_batch_does(spark, recording, tmp_path):
    cuts = [0, 17, 130, 131, 300, 480]
    found = run(spark, tmp_path, [recording.iloc[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    rows = estimates(found)
    assert [r.i for r in rows] == list(range(119, 480, 30)) and np.allclose([r.bpm for r in rows], in_batch(spark, recording))
    waiting = found.filter("progress < 1").orderBy("i").collect()
    assert [r.i for r in waiting] == [16] and waiting[0].progress == pytest.approx(17 / 120) and waiting[0].bpm is None


def test_late_frames_are_put_in_order(spark, recording, tmp_path):
    rng = np.random.default_rng(1)
    # every frame comes up to two seconds late
    shuffled = recording.iloc[np.argsort(recording.t.to_numpy() + rng.uniform(0, 2, len(recording)))]
    parts = [shuffled.iloc[k : k + 80] for k in range(0, len(shuffled), 80)]
    ends = [recording.iloc[:1].assign(session=9, when=pd.Timestamp("2024-01-02") + pd.Timedelta(hours=k)) for k in range(3)]
    rows = estimates(run(spark, tmp_path, [*parts, *ends], event_time="when", late="3 seconds"))
    assert [r.i for r in rows] == list(range(119, 480, 30)) and np.allclose([r.bpm for r in rows], in_batch(spark, recording))


def test_control_rows_switch_the_algorithm_of_a_running_session(spark, recording, tmp_path):
    control = recording.iloc[:1].assign(i=240, r=None, g=None, b=None, t=None, algorithm="chrom")
    frames = recording.assign(algorithm=None)
    later = frames.iloc[240:].assign(i=frames.i.iloc[240:] + 1)
    every = pd.concat([frames.iloc[:240], control, later]).astype({"r": float, "g": float, "b": float, "t": float, "algorithm": object})
    rows = estimates(run(spark, tmp_path, [every.iloc[:200], every.iloc[200:]]))
    expected = in_batch(spark, recording.iloc[:240]) + in_batch(spark, recording.iloc[240:], CONFIG.having(algorithm="chrom"))
    assert np.allclose([r.bpm for r in rows], expected)
    assert [(r.algorithm, r.segment) for r in rows] == [("pos", 0)] * 5 + [("chrom", 1)] * 5


def test_a_run_without_a_face_goes_on_over_a_control_row(spark, recording, tmp_path):
    frames = recording.assign(i=recording.i + recording.i.ge(201), lost=recording.i.isin((200, 201)), algorithm=None)
    control = frames.iloc[[0]].assign(i=201, algorithm="chrom")
    every = pd.concat([frames.iloc[:201], control, frames.iloc[201:]])
    rows = estimates(run(spark, tmp_path, [every.iloc[:201], every.iloc[201:]]))
    assert [(r.segment, r.i) for r in rows] == [(0, 119), (0, 149), (0, 179)] + [(2, k) for k in range(322, 481, 30)]


def test_failed_reads_are_dropped_and_thirty_in_a_row_end_the_session(spark, recording, tmp_path):
    failed = recording.iloc[[0]].assign(r=np.nan, g=np.nan, b=np.nan, failed=True)
    frames = recording.assign(failed=False)
    some, many = (pd.concat([failed] * n) for n in (29, 30))
    every = pd.concat([frames.iloc[:150], some, frames.iloc[150:300], many, frames.iloc[300:]]).assign(i=range(480 + 59))
    found = run(spark, tmp_path, [every.iloc[:160], every.iloc[160:340], every.iloc[340:]])
    rows = estimates(found.filter("error_code IS NULL"))
    assert np.allclose([r.bpm for r in rows], in_batch(spark, recording.iloc[:300]))
    last = found.filter("error_code IS NOT NULL").collect()
    assert [(r.i, r.error_code) for r in last] == [(358, "fonte_indisponivel")]


def test_missing_colours_are_refused_and_lost_faces_begin_segments(spark, recording, tmp_path):
    frames = recording.assign(lost=recording.i.between(200, 203))
    frames.loc[frames.i == 100, "g"] = np.nan
    rows = estimates(run(spark, tmp_path, [frames.iloc[:150], frames.iloc[150:]]))
    assert [r.error_code for r in rows[:3]] == ["sinal_sem_qualidade"] * 3 and rows[0].shown_bpm is None
    assert [(r.segment, r.i) for r in rows] == [(0, 119), (0, 149), (0, 179)] + [(1, k) for k in range(323, 480, 30)]
    assert all(abs(r.bpm - 72) < 1.5 for r in rows[3:])
