"""Numeric kernels: against direct formulas, and the accuracy battery against its targets."""

import numpy as np
import pytest

from pulsegrid.config import Band, Simulation
from pulsegrid.operators import kernels as K
from pulsegrid.plans import linear_maps
from pulsegrid.plans.analysis import analyse
from pulsegrid.config import Analysis
from pulsegrid.sources.recordings import BATTERY_BPM, CONDITIONS, simulate


def recordings():
    for bpm in BATTERY_BPM:
        up = bpm / 60 + 0.7
        hz = min(3.9, max(0.75, bpm / 60 - 0.7 if up > 3.8 else up))
        for given in CONDITIONS.values():
            made = simulate(Simulation(bpm=bpm, seed=int(bpm), tremor_hz=hz if given.get("tremor") else 0.2, **given))
            yield bpm, made[["r", "g", "b"]].to_numpy().T


def test_battery_reaches_the_published_accuracy():
    errors = {name: [] for name in K.ALGORITHMS}
    for bpm, channels in recordings():
        for name, extract in K.ALGORITHMS.items():
            pulse = extract(channels, 30.0, Band(), 4, 100.0)
            errors[name].append(abs(K.dominant(pulse, 30.0, Band())[0] * 60 - bpm))
    mae = {name: np.mean(e) for name, e in errors.items()}
    hit = {name: np.mean(np.array(e) <= 3) for name, e in errors.items()}
    assert mae["chrom"] == pytest.approx(0.025, abs=0.001) and mae["pos"] == pytest.approx(0.019, abs=0.001)
    assert mae["verde"] == pytest.approx(12.012, abs=0.001) and mae["ica"] == pytest.approx(12.01, abs=0.05)
    assert hit["chrom"] == hit["pos"] == 1 and hit["verde"] == pytest.approx(40 / 56)


@pytest.mark.parametrize("bpm", np.arange(45, 221, 12.5))
def test_pure_sines_are_found(bpm):
    t = np.arange(360) / 30
    hz, snr = K.dominant(np.sin(2 * np.pi * bpm / 60 * t), 30.0, Band())
    assert abs(hz * 60 - bpm) < 1 and snr > 6


def test_filter_passes_its_band_and_stops_the_rest():
    t = np.arange(600) / 30
    for hz, low, high in ((1.5, 0.9, 1.1), (0.2, 0, 0.05), (8, 0, 0.05)):
        out = K.bandpass(np.sin(2 * np.pi * hz * t), 30.0, Band(), 4)[100:-100]
        assert low <= np.abs(out).max() <= high
    hz, gain = K.response(30.0, Band(), 4)
    assert gain[np.argmin(np.abs(hz - 1.7))] == pytest.approx(1, abs=1e-3)


def test_matrices_equal_the_loops(monkeypatch):
    x = np.random.default_rng(1).normal(size=300).cumsum()
    fast = K.bandpass(x, 30.0, Band(), 4), K.detrend(x, 100.0)
    monkeypatch.setattr(K, "MATRIX_SAMPLES", 0)
    assert np.allclose(fast[0], K.bandpass(x, 30.0, Band(), 4), atol=1e-8) and np.allclose(fast[1], K.detrend(x, 100.0), atol=1e-8)


def test_a_short_series_is_refused():
    with pytest.raises(ValueError, match="janela_insuficiente"):
        K.bandpass(np.zeros(27), 30.0, Band(), 4)
    assert len(K.bandpass(np.arange(28.0), 30.0, Band(), 4)) == 28


def test_detrend_removes_ramps():
    assert np.abs(K.detrend(np.arange(300.0) * 0.3)).max() < 1e-6
    assert K.detrend(np.array([1.0, 2.0, 3.0])).tolist() == [-1, 0, 1]


def test_peaks_by_distance_and_prominence():
    x = np.array([0, 1, 0, 3, 0, 2, 2, 0, 0.2, 0])
    assert K.peaks(x, 1, 0.5).tolist() == [1, 3, 5]
    assert K.peaks(x, 3, 0.5).tolist() == [3]
    assert K.heart_beats(np.zeros(50), 30.0, Band()).tolist() == []


def test_variability_of_constant_intervals():
    assert K.variability(np.full(5, 800.0)) == {"mean_ms": 800.0, "sdnn": 0.0, "rmssd": 0.0, "pnn50": 0.0}
    assert np.isnan(K.variability(np.array([800.0]))["sdnn"])
    assert K.plausible(np.array([800.0, 810, 790, 2000])).tolist() == [800, 810, 790]


@pytest.mark.parametrize("name", list(K.ALGORITHMS))
@pytest.mark.parametrize("level", [0.0, 128.0, 255.0])
def test_constant_light_is_refused(name, level):
    found = analyse(np.full((3, 300), level), 30.0, Analysis(algorithm=name))
    assert found["error_code"] == "sinal_sem_qualidade"


def test_unknown_algorithms_are_refused_and_names_are_trimmed():
    assert K.algorithm(" POS ") is K.pos
    with pytest.raises(ValueError, match="verde, chrom, pos, ica"):
        K.algorithm("other")


@pytest.mark.parametrize("bpm", [60, 72, 84, 96, 108])
def test_background_rescues_oscillating_white_balance(bpm):
    t = np.arange(720) / 30
    light = np.sin(2 * np.pi * 1.1 * t + 0.4)
    rng = np.random.default_rng(bpm)
    pulse = np.sin(2 * np.pi * bpm / 60 * t)
    face = np.array([base * (1 + gain * light + 0.012 * share * pulse) + rng.normal(0, 0.05, 720) for base, gain, share in ((205, 0.020, 0.3), (175, 0.008, 1.0), (150, 0.030, 0.55))])
    wall = np.array([120 * (1 + gain * light) + rng.normal(0, 0.05, 720) for gain in (0.020, 0.008, 0.030)])
    config = Analysis(window_s=24, background=True)
    assert abs(analyse(face, 30.0, config, wall)["bpm"] - bpm) < 3


@pytest.mark.parametrize("n", [28, 64, 300])
def test_filters_equal_their_dense_matrices(n):
    x = np.random.default_rng(n).normal(100, 5, n)
    assert np.allclose(linear_maps.bandpass_map(n, 30.0, 0.7, 4.0) @ x, K.bandpass(x, 30.0, Band()), atol=1e-7)
    assert np.allclose(linear_maps.detrend_map(n, 100.0) @ x, K.detrend(x, 100.0), atol=1e-7)
