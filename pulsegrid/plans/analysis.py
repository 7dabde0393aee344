"""From windows of colour to heart rate: the whole chain in one pass over sorted groups, with failures as rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import LIBRARY, Analysis
from ..operators import kernels, pulse, spectrum
from ..operators.series import changes, count_chunks, face_segments

RESULT = (
    "bpm double, hz double, snr_db double, confidence string, algorithm string, window_s double, peak_bpm double, disagreement double, "
    "mean_ms double, sdnn double, rmssd double, pnn50 double, beats int, error_code string"
)


def level(snr: float) -> str:
    return "alta" if snr >= 6 else "média" if snr >= 2 else "baixa" if snr >= 0 else "descartada"


def analyse(channels: np.ndarray, fps: float, config: Analysis, background: np.ndarray | None = None, gate: bool = True, times: np.ndarray | None = None) -> dict:
    """One series of three channels; an error code instead of numbers where it can't be judged.

    With `times` the series is put on an even grid at the rate that they show, or at `fps` where they show none; a series
    without any time is taken as even. A colour or a single time that is null or not finite makes it unfit to judge: a
    filter would spread it over the whole window, and a spectrum of it has a peak like any other.
    """
    extract = kernels.algorithm(config.algorithm)
    if background is not None and not np.isfinite(background).all():
        background = None
    timed = times is not None and not np.isnan(times).all()
    if not np.isfinite(channels).all() or timed and not np.isfinite(times).all():
        return {"algorithm": config.algorithm.strip().lower(), "error_code": "sinal_sem_qualidade"}
    if timed:
        fps = kernels.effective_rate(times) or fps
        rows = channels if background is None else np.concatenate([channels, background])
        rows = kernels.uniform(rows, times, fps)
        channels, background = rows[:3], None if background is None else rows[3:]
    failed = {"algorithm": config.algorithm.strip().lower(), "window_s": channels.shape[1] / fps if fps > 0 else None}
    if fps <= 0 or not 0 < config.band.low_hz < config.band.high_hz < fps / 2:
        return failed | {"error_code": "banda_invalida"}
    if channels.shape[1] < kernels.least_samples(config.order):
        return failed | {"error_code": "janela_insuficiente"}
    if config.background and background is not None:
        clean = []
        for c, b in zip(channels, background, strict=True):
            found = kernels.rectify(c, b)
            clean.append((c + c.mean() if config.double_level else c) if found is None else found + c.mean())
        channels = np.array(clean)
    try:
        pulse = extract(channels, fps, config.band, config.order, config.detrend)
        if not np.isfinite(pulse).all() or pulse.std() < 1e-9 * max(1.0, float(np.abs(channels.mean(1)).mean())):
            return failed | {"error_code": "sinal_sem_qualidade"}
        hz, snr = kernels.dominant(pulse, fps, config.band)
    except ValueError as e:
        return failed | {"error_code": str(e)}
    if gate and snr < config.least_snr_db:
        return failed | {"snr_db": snr, "error_code": "sinal_sem_qualidade"}
    beats = kernels.heart_beats(pulse, fps, config.band, hz)
    intervals = kernels.plausible(np.diff(beats) * 1000.0 / fps)
    rate = 60000.0 / float(np.median(intervals)) if len(intervals) >= 2 else float("nan")
    if not config.band.low_hz <= rate / 60 <= config.band.high_hz:
        rate = float("nan")
    return failed | {"bpm": hz * 60, "hz": hz, "snr_db": snr, "confidence": level(snr), "peak_bpm": rate, "disagreement": abs(hz * 60 - rate), "beats": len(beats)} | kernels.variability(intervals)


ARROW = {"double": pa.float64(), "string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "bigint": pa.int64()}
#: Windows of one chunk of a session.
CHUNK = 64


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with the row at which each begins, from rows sorted by `keys`.

    The last group of a batch waits for the next, which may go on with it.
    """
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if not table.num_rows:
            continue
        starts = np.append(0, np.flatnonzero(changes(table, keys)) + 1)
        if len(starts) > 1:
            yield table.slice(0, starts[-1]), starts[:-1]
        held = table.slice(starts[-1])
    if held is not None:
        yield held, np.zeros(1, int)


def analysed(
    windows: DataFrame, fps: float, config: Analysis = LIBRARY, keys: Sequence[str] = ("session", "window_id"), order: str = "k", algorithms: Sequence[str] | None = None,
    times: str | None = None, uses: Sequence[bool] | None = None, sliding: tuple[int, int] | None = None,
) -> DataFrame:
    """A row for each window (and algorithm): `windows` has keys, order, r, g, b and bg_r, bg_g, bg_b if it is rectified.

    `times`: a column of seconds, by which each window is resampled at its own rate. `uses`: both uses of the background
    from one pass, told by with_background; a window whose background isn't whole gives no row that uses it. `sliding`:
    size and step of the windows in groups that are chunks of `CHUNK` of them; the last key, the chunk, is window_id in
    the result. Groups are dealt by all their keys and read in order, batch by batch: a hot session's go to many tasks.
    """
    names = algorithms or (config.algorithm,)
    columns = [f.name for f in windows.schema.fields]
    has_background = "bg_r" in columns and (config.background if uses is None else True in uses)
    kinds = dict(windows.dtypes)
    result = [x.split() for x in (RESULT if uses is None else f"{RESULT}, with_background boolean").split(", ")]
    channels = ["r", "g", "b", *(("bg_r", "bg_g", "bg_b") if has_background else ())]
    named = list(keys) if sliding is None else [*keys[:-1], "window_id"]

    def judged(rows: np.ndarray, t: np.ndarray | None) -> Iterator[dict]:
        background = rows[3:] if has_background else None
        for use in (None,) if uses is None else uses:
            if use and (background is None or not np.isfinite(background).all()):
                continue
            for a in names:
                found = analyse(rows[:3], fps, config.having(algorithm=a, background=config.background if use is None else use), background, times=t)
                yield found | {"with_background": use}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, keys):
            held = np.array([table[c].to_numpy() for c in channels], float)
            t = table[times].to_numpy().astype(float) if times else None
            at, place, out = [], [], []
            for start, end in zip(starts, np.append(starts[1:], table.num_rows), strict=True):
                size, step = sliding or (end - start, 1)
                for j in range((end - start - size) // step + 1):
                    own = slice(start + j * step, start + j * step + size)
                    for found in judged(held[:, own], None if t is None else t[own]):
                        at.append(start)
                        place.append(j)
                        out.append(found)
            of_keys = [table[k].take(pa.array(at, pa.int64())).combine_chunks() for k in keys]
            if sliding is not None:
                of_keys[-1] = pc.add(pc.multiply(of_keys[-1].cast(pa.int64()), CHUNK), pa.array(place, pa.int64()))
            values = [pa.array([r.get(name) for r in out], ARROW[kind], from_pandas=True) for name, kind in result]
            yield pa.RecordBatch.from_arrays([*of_keys, *values], [*named, *(name for name, _ in result)])

    quoted = [F.col(f"`{c}`") for c in dict.fromkeys([*keys, order, *channels, *((times,) if times else ())])]
    by = [F.col(f"`{k}`") for k in keys]
    schema = ", ".join([*(f"`{name}` {'bigint' if name != k else kinds[k]}" for name, k in zip(named, keys, strict=True)), *(f"{name} {kind}" for name, kind in result)])
    return windows.select(*quoted).repartition(*by).sortWithinPartitions(*by, order).mapInArrow(run, schema)


def pulses(
    windows: DataFrame, fps: float, config: Analysis = LIBRARY, keys: Sequence[str] = ("session", "window_id"), order: str = "k", algorithms: Sequence[str] = ("pos",),
    sliding: tuple[int, int] | None = None,
) -> DataFrame:
    """(keys, order, a column for each algorithm): the pulse signals themselves, null in a window too short to filter.

    `sliding`: as in `analysed`; the order column then counts a window's frames from 0. Windows of one length that a batch
    holds, of any group, are filtered together.
    """
    kinds = dict(windows.dtypes)
    named = list(keys) if sliding is None else [*keys[:-1], "window_id"]

    def signal(name: str, stack: np.ndarray) -> np.ndarray:
        extract, rest = kernels.algorithm(name), (fps, config.band, config.order, config.detrend)
        if stack.shape[-1] < kernels.least_samples(config.order):
            return np.full(stack.shape[1:], np.nan)
        return extract(stack, *rest) if extract in kernels.STACKED else np.array([extract(stack[:, w], *rest) for w in range(stack.shape[1])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, keys):
            held = np.array([table[c].to_numpy() for c in "rgb"], float)
            lengths = np.diff(np.append(starts, table.num_rows))
            size, step = sliding or (lengths, 1)
            counts = np.maximum(0, (lengths - size) // step + 1)
            of = np.repeat(starts, counts)  # where the group of each window begins
            place = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
            sizes = np.repeat(np.broadcast_to(size, len(starts)), counts)
            for n in np.unique(sizes):
                own = sizes == n
                at = (of[own] + place[own] * step)[:, None] + np.arange(n)
                stack = held[:, at]
                rows = pa.array(at.ravel() if sliding is None else np.repeat(of[own], n))
                of_rows = [table[c].take(rows).combine_chunks() for c in (keys if sliding else [*keys, order])]
                if sliding is not None:
                    of_rows[-1] = pc.add(pc.multiply(of_rows[-1].cast(pa.int64()), CHUNK), pa.array(np.repeat(place[own], n)))
                    of_rows.append(pa.array(np.tile(np.arange(n, dtype=np.int32), own.sum())))
                signals = [pa.array(signal(a, stack).ravel(), pa.float64(), from_pandas=True) for a in algorithms]
                yield pa.RecordBatch.from_arrays([*of_rows, *signals], [*named, order, *algorithms])

    quoted = [F.col(f"`{c}`") for c in dict.fromkeys([*keys, order, "r", "g", "b"])]
    by = [F.col(f"`{k}`") for k in keys]
    of_order = kinds[order] if sliding is None else "int"
    schema = ", ".join([*(f"`{name}` {'bigint' if name != k else kinds[k]}" for name, k in zip(named, keys, strict=True)), f"`{order}` {of_order}", *(f"{a} double" for a in algorithms)])
    return windows.select(*quoted).repartition(*by).sortWithinPartitions(*by, order).mapInArrow(run, schema)


def finger(frames: DataFrame, fps: float, config: Analysis = LIBRARY, length: int = 1024, keys: Sequence[str] = ("session",), order: str = "i") -> DataFrame:
    """A fingertip over the lens: green alone, band-passed by its transform, without rectification or detrending."""
    signal = pulse.spectral_bandpass(pulse.green(frames), ["pulse"], fps, config.band, length, keys, order)
    return spectrum.dominant(spectrum.periodogram(signal, "pulse", fps, config.band, keys, order), config.band, keys)


def sessions(frames: DataFrame, fps: float, config: Analysis = LIBRARY, keys: Sequence[str] = ("session",), order: str = "i", limit: int | None = None) -> DataFrame:
    """Sliding windows of each session, analysed.

    Seconds in a column `t` put each window on an even grid at its own rate. Where a column `lost` tells frames without a
    face, no window reaches across more of them in a row than the configuration's patience, and segments are told apart.
    `limit`: frames of a session that are read at most.
    """
    if limit is not None:
        frames = frames.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter(F.col("_place") <= limit).drop("_place")
    by = list(keys)
    if "lost" in frames.columns:
        frames = face_segments(frames, config.patience, keys, order)
        by.append("segment")
    sliding = config.frames_in_window(fps), config.frames_in_step(fps)
    chunks = count_chunks(frames, *sliding, CHUNK, by, order)
    return analysed(chunks, fps, config, [*by, "chunk"], times="t" if "t" in frames.columns else None, sliding=sliding)
