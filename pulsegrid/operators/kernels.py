"""Small numpy kernels for what is inherently sequential: recursive filters, pentadiagonal solves, greedy peaks, ICA.

They work on one window at a time inside grouped maps; Spark partitions the windows. Filters, trends, green and chrominance
take stacks of windows of one length too, with the frames along the last axis.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from ..config import Band


@lru_cache(maxsize=64)
def bandpass_design(low: float, high: float, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Sections (b, a) of a Butterworth band-pass; `low` and `high` as shares of half the frame rate.

    Poles of the analogue low-pass go to the band by s -> (s^2 + w0^2) / (bw s), then to z by the bilinear map; each pole
    pairs with its conjugate, and every section has one zero at 1 and one at -1.
    """
    w1, w2 = (4 * np.tan(np.pi * w / 2) for w in (low, high))
    width, centre = w2 - w1, w1 * w2
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order)) * width / 2
    root = np.sqrt(poles**2 - centre)
    s = np.concatenate([poles + root, poles - root])
    z = (4 + s) / (4 - s)
    upper = z[z.imag > 1e-14]
    real = np.sort(z[np.abs(z.imag) <= 1e-14].real)
    dens = [np.array([1, -2 * p.real, abs(p) ** 2]) for p in upper] + [np.array([1, -(a + b), a * b]) for a, b in zip(real[::2], real[1::2])]
    nums = [np.array([1.0, 0.0, -1.0]) for _ in dens]
    at = np.exp(1j * 2 * np.arctan(np.sqrt(w1 * w2) / 4))  # unit gain at the centre
    gain = 1.0
    for b, a in zip(nums, dens, strict=True):
        gain *= abs(np.polyval(b, at) / np.polyval(a, at))
    nums[0] = nums[0] / gain
    return np.array(nums), np.array(dens)


def least_samples(order: int) -> int:
    """A forward-backward filter of this order needs as many samples."""
    return 3 * (2 * order + 1) + 1


def run_sections(nums: np.ndarray, dens: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cascaded sections, each started as if its first input had lasted for ever."""
    for b, a in zip(nums, dens, strict=True):
        level = x[0] * b.sum() / a.sum()
        s1, s2 = level - b[0] * x[0], b[2] * x[0] - a[2] * level
        out = np.empty(len(x))
        b0, b1, b2, a1, a2 = b[0], b[1], b[2], a[1], a[2]
        for i, v in enumerate(x.tolist()):
            y = b0 * v + s1
            s1, s2 = b1 * v - a1 * y + s2, b2 * v - a2 * y
            out[i] = y
        x = out
    return x


@lru_cache(maxsize=16)
def bandpass_matrix(n: int, low: float, high: float, order: int) -> np.ndarray:
    """The zero-phase filter of n samples as a matrix: windows of one length share it, and a product replaces loops."""
    nums, dens = bandpass_design(low, high, order)
    pad = least_samples(order) - 1
    eye = np.eye(n)
    x = np.concatenate([2 * eye[0] - eye[pad:0:-1], eye, 2 * eye[-1] - eye[-2 : -pad - 2 : -1]])
    for _ in range(2):
        for b, a in zip(nums, dens, strict=True):
            level = x[0] * b.sum() / a.sum()
            s1, s2 = level - b[0] * x[0], b[2] * x[0] - a[2] * level
            out = np.empty_like(x)
            for i, v in enumerate(x):
                y = b[0] * v + s1
                s1, s2 = b[1] * v - a[1] * y + s2, b[2] * v - a[2] * y
                out[i] = y
            x = out
        x = x[::-1]
    return np.ascontiguousarray(x[pad:-pad])


@lru_cache(maxsize=16)
def detrend_matrix(n: int, strength: float) -> np.ndarray:
    second = np.diff(np.eye(n), 2, axis=0)
    return np.eye(n) - np.linalg.inv(np.eye(n) + strength**2 * second.T @ second)


#: Series up to this length use matrices; longer ones are filtered sample by sample.
MATRIX_SAMPLES = 1024


def mapped(matrix: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The matrix applied to a series or to each of a stack."""
    return matrix @ x if x.ndim == 1 else x @ matrix.T


def bandpass(x: np.ndarray, fps: float, band: Band, order: int = 4) -> np.ndarray:
    """Zero-phase band-pass with odd extension at both ends; needs `least_samples(order)` samples."""
    pad, n = least_samples(order) - 1, x.shape[-1]
    if n <= pad:
        raise ValueError("janela_insuficiente")
    low, high = band.low_hz / (fps / 2), band.high_hz / (fps / 2)
    if not 0 < low < high < 1:
        raise ValueError("banda_invalida")
    if n <= MATRIX_SAMPLES:
        return mapped(bandpass_matrix(n, low, high, order), x)
    if x.ndim > 1:
        return np.array([bandpass(v, fps, band, order) for v in x])
    nums, dens = bandpass_design(low, high, order)
    longer = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    return run_sections(nums, dens, run_sections(nums, dens, longer)[::-1])[::-1][pad:-pad]


def response(fps: float, band: Band, order: int = 4, points: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and the gain of the double pass, |H|^2."""
    nums, dens = bandpass_design(band.low_hz / (fps / 2), band.high_hz / (fps / 2), order)
    hz = np.arange(points) * fps / 2 / points
    z = np.exp(2j * np.pi * hz / fps)
    gain = np.ones(points)
    for b, a in zip(nums, dens, strict=True):
        gain *= np.abs(np.polyval(b, z) / np.polyval(a, z)) ** 2
    return hz, gain


@lru_cache(maxsize=32)
def trend_factor(n: int, strength: float) -> tuple[np.ndarray, ...]:
    """LDL' factors of I + strength^2 D'D for second differences D: diagonal and two lower bands."""
    main, one, two = np.ones(n), np.zeros(n), np.zeros(n)
    q = strength**2
    for k, w in ((0, 1.0), (1, 4.0), (2, 1.0)):
        main[k : n - 2 + k] += q * w
    one[: n - 2] -= 2 * q
    one[1 : n - 1] -= 2 * q
    two[: n - 2] += q
    d, e, f = np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(n):
        before = f[i - 2] if i > 1 else 0.0
        last = e[i - 1] if i > 0 else 0.0
        d[i] = main[i] - (d[i - 1] * last**2 if i > 0 else 0.0) - (d[i - 2] * before**2 if i > 1 else 0.0)
        e[i] = (one[i] - (d[i - 1] * last * f[i - 1] if i > 0 else 0.0)) / d[i]
        f[i] = two[i] / d[i]
    return d, e, f


def detrend(x: np.ndarray, strength: float = 100.0) -> np.ndarray:
    """Less its smooth trend; only the mean goes under 4 samples or without strength."""
    n = x.shape[-1]
    if n < 4 or strength <= 0:
        return x - x.mean(-1, keepdims=True) if n else x.copy()
    if n <= MATRIX_SAMPLES:
        return mapped(detrend_matrix(n, float(strength)), x)
    if x.ndim > 1:
        return np.array([detrend(v, strength) for v in x])
    d, e, f = (v.tolist() for v in trend_factor(n, float(strength)))
    y = x.tolist()
    for i in range(1, n):
        y[i] -= e[i - 1] * y[i - 1] + (f[i - 2] * y[i - 2] if i > 1 else 0.0)
    y = [v / w for v, w in zip(y, d, strict=True)]
    for i in range(n - 2, -1, -1):
        y[i] -= e[i] * y[i + 1] + (f[i] * y[i + 2] if i < n - 2 else 0.0)
    return x - np.array(y)


def standardise(x: np.ndarray) -> np.ndarray:
    sd = x.std()
    return (x - x.mean()) / sd if sd > 1e-12 else np.zeros_like(x)


def peaks(x: np.ndarray, distance: int, prominence: float) -> np.ndarray:
    """Local maxima (the middle of a plateau), no two nearer than `distance` (higher ones first), of some prominence."""
    found, i, n = [], 1, len(x)
    while i < n - 1:
        if x[i - 1] < x[i]:
            j = i + 1
            while j < n - 1 and x[j] == x[i]:
                j += 1
            if x[j] < x[i]:
                found.append((i + j - 1) // 2)
                i = j
        i += 1
    at = np.array(found, int)
    keep = np.ones(len(at), bool)
    for k in np.argsort(x[at], kind="stable")[::-1]:
        if keep[k]:
            close = np.abs(at - at[k]) < distance
            close[k] = False
            keep &= ~close
    out = []
    for p in at[keep]:
        higher = np.flatnonzero(x[:p] > x[p])
        left = x[(higher[-1] if len(higher) else 0) : p + 1].min()
        higher = np.flatnonzero(x[p + 1 :] > x[p])
        right = x[p : (p + 1 + higher[0] if len(higher) else n - 1) + 1].min()
        if x[p] - max(left, right) >= prominence:
            out.append(p)
    return np.array(out, int)


def heart_beats(x: np.ndarray, fps: float, band: Band, hint_hz: float | None = None, relative: float = 0.3) -> np.ndarray:
    """Places of beats in a pulse signal; a hint of its frequency widens the least distance."""
    if len(x) < 3:
        return np.zeros(0, int)
    z = standardise(x)
    distance = max(1, int(0.7 * fps / hint_hz)) if hint_hz and hint_hz > 0 else max(1, int(fps / band.high_hz))
    prominence = relative * z.std()
    return peaks(z, distance, prominence) if prominence > 0 else np.zeros(0, int)


def plausible(intervals: np.ndarray, tolerance: float = 0.3) -> np.ndarray:
    """Intervals within a share of their median; all of them under 3."""
    middle = np.median(intervals) if len(intervals) else 0.0
    return intervals if len(intervals) < 3 or middle <= 0 else intervals[np.abs(intervals - middle) / middle <= tolerance]


def variability(intervals: np.ndarray) -> dict[str, float]:
    """Mean, SDNN, RMSSD and pNN50 of intervals in ms; NaN where they are too few."""
    nan = float("nan")
    if len(intervals) < 2:
        return {"mean_ms": nan, "sdnn": nan, "rmssd": nan, "pnn50": nan}
    steps = np.diff(intervals)
    return {"mean_ms": float(intervals.mean()), "sdnn": float(intervals.std(ddof=1)), "rmssd": float(np.sqrt((steps**2).mean())), "pnn50": float((np.abs(steps) > 50).mean())}


def spectrum(x: np.ndarray, fps: float, padding: int = 8) -> tuple[np.ndarray, np.ndarray]:
    n = len(x)
    if n < 2:
        return np.zeros(0), np.zeros(0)
    w = np.hanning(n)
    size = 1 << (n * padding - 1).bit_length()
    return np.fft.rfftfreq(size, 1 / fps), np.abs(np.fft.rfft((x - x.mean()) * w, size)) ** 2 / ((w**2).sum() * fps)


def snr_db(hz: np.ndarray, power: np.ndarray, peak: float, band: Band) -> float:
    inside = (hz >= band.low_hz) & (hz <= band.high_hz)
    signal = ((np.abs(hz - peak) <= 0.1) | (np.abs(hz - 2 * peak) <= 0.2)) & inside
    s, n = power[signal].sum(), power[inside & ~signal].sum()
    return float("-inf") if s <= 1e-20 else 60.0 if n <= 1e-20 else min(60.0, 10 * float(np.log10(s / n)))


def dominant(x: np.ndarray, fps: float, band: Band) -> tuple[float, float]:
    """Refined frequency of the strongest bin in the band and its SNR."""
    hz, power = spectrum(x, fps)
    inside = np.flatnonzero((hz >= band.low_hz) & (hz <= band.high_hz))
    if len(x) < 8 or not len(inside):
        raise ValueError("janela_insuficiente" if len(x) < 8 else "banda_invalida")
    if not np.isfinite(power[inside]).all():
        raise ValueError("sinal_sem_qualidade")
    k = int(inside[np.argmax(power[inside])])
    peak = hz[k]
    if 0 < k < len(hz) - 1 and power[k - 1 : k + 2].min() > 0:
        a, b, c = np.log(power[k - 1 : k + 2])
        if abs(a - 2 * b + c) >= 1e-18:
            peak += np.clip(0.5 * (a - c) / (a - 2 * b + c), -0.5, 0.5) * (hz[k + 1] - hz[k])
    peak = float(np.clip(peak, band.low_hz, band.high_hz))
    return peak, snr_db(hz, power, peak, band)


def normalise(c: np.ndarray) -> np.ndarray:
    """Rows over their means, over 1 where these are 0."""
    m = c.mean(-1, keepdims=True)
    return c / np.where(np.abs(m) < 1e-12, 1.0, m)


def finish(x: np.ndarray, fps: float, band: Band, order: int, strength: float) -> np.ndarray:
    return bandpass(detrend(x, strength), fps, band, order)


def green(c: np.ndarray, fps: float, band: Band, order: int, strength: float) -> np.ndarray:
    return finish(-c[1], fps, band, order, strength)


def chrom(c: np.ndarray, fps: float, band: Band, order: int, strength: float) -> np.ndarray:
    r, g, b = normalise(c)
    x, y = bandpass(3 * r - 2 * g, fps, band, order), bandpass(1.5 * r + g - 1.5 * b, fps, band, order)
    sd = y.std(-1, keepdims=True)
    return finish(x - np.where(sd > 1e-12, x.std(-1, keepdims=True) / np.where(sd > 1e-12, sd, 1.0), 0.0) * y, fps, band, order, strength)


def pos(c: np.ndarray, fps: float, band: Band, order: int, strength: float) -> np.ndarray:
    """All sub-windows at once, as views; overlap-added by their place."""
    n, size = c.shape[1], max(2, round(1.6 * fps))
    views = np.lib.stride_tricks.sliding_window_view(c, min(size, n), axis=1).transpose(1, 0, 2)
    mean = views.mean(2, keepdims=True)
    r, g, b = (views / np.where(np.abs(mean) < 1e-12, 1.0, mean)).transpose(1, 0, 2)
    s1, s2 = g - b, g + b - 2 * r
    sd = s2.std(1, keepdims=True)
    h = s1 + np.where(sd > 1e-12, s1.std(1, keepdims=True) / np.where(sd > 1e-12, sd, 1), 0.0) * s2
    h = h - h.mean(1, keepdims=True)
    over = h.std(1, keepdims=True)
    h = h / np.where(over > 1e-12, over, 1.0)
    place = np.arange(h.shape[0])[:, None] + np.arange(h.shape[1])
    return finish(np.bincount(place.ravel(), h.ravel(), n), fps, band, order, strength)


def ica(c: np.ndarray, fps: float, band: Band, order: int, strength: float, rounds: int = 400, tolerance: float = 1e-4, seed: int = 0) -> np.ndarray:
    """Symmetric FastICA (log cosh) of three standardised channels; the component of the highest SNR, first of equals."""
    x = np.array([standardise(v) for v in c])
    x -= x.mean(1, keepdims=True)
    values, vectors = np.linalg.eigh(x @ x.T / x.shape[1])
    if values.min() < 1e-12:
        raise ValueError("sinal_sem_qualidade")
    white = (vectors / np.sqrt(values)).T @ x
    w = np.linalg.qr(np.random.RandomState(seed).normal(size=(3, 3)))[0]
    for _ in range(rounds):
        t = np.tanh(w @ white)
        new = t @ white.T / x.shape[1] - (1 - t**2).mean(1, keepdims=True) * w
        u, _, v = np.linalg.svd(new)
        new = u @ v
        done = np.abs(np.abs((new * w).sum(1)) - 1).max() < tolerance
        w = new
        if done:
            break
    best, most = None, float("-inf")
    for s in w @ white:
        out = finish(s, fps, band, order, strength)
        hz, power = spectrum(out, fps)
        inside = np.flatnonzero((hz >= band.low_hz) & (hz <= band.high_hz))
        value = snr_db(hz, power, hz[inside[np.argmax(power[inside])]], band)
        if best is None or value > most:
            best, most = out, value
    return best


#: In the order in which they are listed to users.
ALGORITHMS = {"verde": green, "chrom": chrom, "pos": pos, "ica": ica}
#: Those that take a stack of windows, (3, windows, frames), at once.
STACKED = (green, chrom)


def algorithm(name: str):
    """An extractor by name, whatever its case and surrounding blanks."""
    found = ALGORITHMS.get(name.strip().lower())
    if found is None:
        raise ValueError(f"unknown algorithm {name!r}; there are {', '.join(ALGORITHMS)}")
    return found


def effective_rate(t: np.ndarray) -> float:
    """Frames a second by the median of positive time differences; 0 where there is none."""
    gaps = np.diff(np.sort(t))
    gaps = gaps[gaps > 0]
    return float(1.0 / np.median(gaps)) if len(gaps) else 0.0


def uniform(channels: np.ndarray, t: np.ndarray, fps: float) -> np.ndarray:
    """Channels on an even grid of round(duration * fps) + 1 points, at least 2, linear between frames in any order."""
    if len(t) < 2:
        return channels
    order = np.argsort(t, kind="stable")
    t = t[order]
    grid = np.linspace(t[0], t[-1], max(2, round((t[-1] - t[0]) * fps) + 1))
    return np.array([np.interp(grid, t, c[order]) for c in channels])


def rectify(x: np.ndarray, background: np.ndarray, most_lags: int = 3, most_gain: float = 3.0) -> np.ndarray | None:
    """The centred signal without what lags of the background explain; None where it stays as it is."""
    sd, own = background.std(), x.std()
    if sd < 1e-12 or own < 1e-12:
        return None
    z = (background - background.mean()) / sd
    k = max(1, min(most_lags, max(1, len(x) // 8)))
    lagged = np.array([np.concatenate([np.zeros(j), z[: len(z) - j]]) for j in range(k)]).T
    centred = x - x.mean()
    factors = np.linalg.lstsq(lagged, centred, rcond=None)[0]
    if not np.isfinite(factors).all() or np.abs(factors).max() > most_gain * own:
        return None
    return centred - lagged @ factors
