"""Operators on ordered series: windows by count, segments, smoothing, normalisation, resampling, rates.

A series is a table with a session, an order column and channels. All window operators partition by session (and
segment), so one exchange serves a chain of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import quantiles
from .scan import smoothed as smoothed


def count_windows(frames: DataFrame, size: int, step: int, keys: Sequence[str] = ("session",), order: str = "i") -> DataFrame:
    """A row for each frame of each emitted window, with window_id and the frame's place k in it.

    A window is emitted at frame n (from 1) when it is full and at least `step` frames have come since the last one, so
    first at max(size, step) and then every `step` frames. Each frame finds its own windows by arithmetic: no join.
    """
    if size < 1 or step < 1:
        raise ValueError("size and step must be positive")
    first = max(size, step)
    each = Window.partitionBy(*keys)
    n = F.row_number().over(each.orderBy(order))
    total = F.count("*").over(each)
    known = frames.withColumn("_n", n).withColumn("_total", total).filter(F.col("_total") >= first)
    # window w ends at first + w * step and begins size - 1 before; -((a) // b) is a quotient rounded up
    low = F.greatest(F.lit(0), F.ceil((F.col("_n") - first) / step)).cast("long")
    high = F.least(F.floor((F.col("_total") - first) / step), F.floor((F.col("_n") + (size - 1) - first) / step)).cast("long")
    met = known.withColumn("_low", low).withColumn("_high", high).filter("_low <= _high")
    met = met.withColumn("window_id", F.explode(F.sequence("_low", "_high")))
    return met.withColumn("k", (F.col("_n") - 1 - (first + F.col("window_id") * step - size)).cast("int")).drop("_n", "_total", "_low", "_high")


def window_bounds(frames: DataFrame, size: int, step: int, keys: Sequence[str] = ("session",), order: str = "i") -> DataFrame:
    """(keys, window_id, first_<order>, last_<order>, n) of the windows of `count_windows`, without copying frames.

    A frame ends one window at most, and what is `size` - 1 before it begins that: a lag tells it.
    """
    if size < 1 or step < 1:
        raise ValueError("size and step must be positive")
    first = max(size, step)
    w = Window.partitionBy(*keys).orderBy(order)
    ends = frames.select(*keys, order, F.row_number().over(w).alias("_n"), F.lag(order, size - 1).over(w).alias(f"first_{order}"))
    ends = ends.filter((F.col("_n") >= first) & ((F.col("_n") - first) % step == 0))
    return ends.select(*keys, F.floor((F.col("_n") - first) / step).cast("long").alias("window_id"), f"first_{order}", F.col(order).alias(f"last_{order}"), F.lit(size).cast("long").alias("n"))


def count_chunks(frames: DataFrame, size: int, step: int, windows: int = 64, keys: Sequence[str] = ("session",), order: str = "i", at_once: bool = False) -> DataFrame:
    """A row for each frame of each chunk, a run of `windows` of the windows of `count_windows`, with its place k there.

    Window j of a chunk has the number chunk * `windows` + j and begins at k = j * `step`; it is emitted if it is full.
    Chunks overlap by less than a window, so hardly a frame is copied, and the chunks of one long session part. `at_once`:
    the first window begins with the session, also where a step is longer than a window.
    """
    if size < 1 or step < 1:
        raise ValueError("size and step must be positive")
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1 - (0 if at_once else max(size, step) - size)
    span = windows * step
    low = F.greatest(F.lit(0), F.ceil((F.col("_n") - (span - step + size - 1)) / span)).cast("long")
    met = frames.withColumn("_n", n).filter("_n >= 0").withColumn("_low", low).withColumn("_high", F.floor(F.col("_n") / span).cast("long")).filter("_low <= _high")
    met = met.withColumn("chunk", F.explode(F.sequence("_low", "_high")))
    return met.withColumn("k", (F.col("_n") - F.col("chunk") * span).cast("int")).drop("_n", "_low", "_high")


def spaced(frames: DataFrame, apart: float, keys: Sequence[str] = ("session",), t: str = "t") -> DataFrame:
    """The first frame of each session and then each that comes more than `apart` after the last one taken.

    What is taken depends on what was, so frames are read in order; a task remembers one time. Frames without a time go.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last = None, 0.0
        for batch in batches:
            taken = []
            for row, (key, at) in enumerate(zip(zip(*(batch.column(k).to_pylist() for k in keys)), batch.column(t).to_pylist(), strict=True)):
                if key != own or at - last > apart:
                    taken.append(row)
                    own, last = key, at
            yield batch.take(pa.array(taken, pa.int64()))

    by = [F.col(f"`{k}`") for k in keys]
    return frames.filter(F.col(t).isNotNull()).repartition(*by).sortWithinPartitions(*by, t).mapInArrow(run, frames.schema)


def due_analyses(frames: DataFrame, window: float, apart: float = 1.0, least: int = 64, keys: Sequence[str] = ("session",), t: str = "t") -> DataFrame:
    """The frames at which a window kept by time is analysed, with `retained` (frames kept) and `enough` of them.

    Kept are frames of the last 1.3 windows, those of the same time included, and two at least. An analysis is due once they span a
    window, and more than `apart` after the last one due; with fewer than `least` frames it gives nothing, but counts for the cadence.
    """
    each = Window.partitionBy(*keys).orderBy(t)
    # times stay as they are: Window.rangeBetween takes whole numbers alone, and times rounded to some would meet
    near = f"OVER (PARTITION BY {', '.join(f'`{k}`' for k in keys)} ORDER BY CAST(`{t}` AS DOUBLE) RANGE BETWEEN {1.3 * window!r}D PRECEDING AND CURRENT ROW)"
    kept = frames.withColumn("retained", F.greatest(F.expr(f"count(*) {near}"), F.least(F.lit(2), F.rank().over(each)).cast("long")))
    kept = kept.withColumn("_from", F.least(F.expr(f"min(`{t}`) {near}"), F.lag(t).over(each)))
    due = kept.filter(F.col(t) - F.col("_from") >= window).drop("_from").withColumn("enough", F.col("retained") >= least)
    return spaced(due, apart, keys, t)


def changes(rows: pa.Table | pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """Whether each row but the first has other keys than the row before it; nulls are one key."""
    new = np.zeros(rows.num_rows - 1, bool)
    for k in keys:
        column = rows.column(k)
        differ = pc.fill_null(pc.not_equal(column[1:], column[:-1]), False)
        new |= np.asarray(differ) | (np.asarray(column[1:].is_null()) != np.asarray(column[:-1].is_null()))
    return new


def segments(frames: DataFrame, reset: Column, keys: Sequence[str] = ("session",), order: Sequence[str] = ("i",)) -> DataFrame:
    """`segment` counts the resets up to a row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return frames.withColumn("segment", F.sum(F.when(reset, 1).otherwise(0)).over(w))


def face_segments(frames: DataFrame, patience: int = 0, keys: Sequence[str] = ("session",), order: str = "i", lost: str = "lost") -> DataFrame:
    """The frames with a face, with their segment: one begins where more than `patience` frames in a row have none."""
    w = Window.partitionBy(*keys).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    gone = F.coalesce(F.col(lost), F.lit(False))
    placed = frames.withColumn("_gone", gone).withColumn("_place", F.row_number().over(w))
    run = placed.withColumn("_run", F.col("_place") - F.coalesce(F.max(F.when(~F.col("_gone"), F.col("_place"))).over(upto), F.lit(0)))
    counted = run.withColumn("segment", F.sum(F.when(F.col("_gone") & (F.col("_run") == patience + 1), 1).otherwise(0)).over(upto).cast("int"))
    return counted.filter(~F.col("_gone")).drop("_gone", "_place", "_run")


def read_frames(frames: DataFrame, most: int = 30, keys: Sequence[str] = ("session",), order: str = "i", failed: str = "failed") -> DataFrame:
    """The frames that a capture gives: failed reads are dropped, and `most` of them in a row end its session."""
    return face_segments(frames, most - 1, keys, order, failed).filter("segment = 0").drop("segment")


def sessions_by_gap(frames: DataFrame, gap: float, keys: Sequence[str] = ("session",), t: str = "t") -> DataFrame:
    """(keys, part, start, end, n): runs of frames with no pause above `gap`."""
    w = Window.partitionBy(*keys).orderBy(t)
    pause = F.col(t) - F.lag(t).over(w)
    cut = frames.withColumn("_new", F.when(pause > gap, 1).otherwise(0)).withColumn("part", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return cut.groupBy(*keys, "part").agg(F.min(t).alias("start"), F.max(t).alias("end"), F.count("*").alias("n"))


def effective_fps(frames: DataFrame, t: str = "t", keys: Sequence[str] = ("session",)) -> DataFrame:
    """Frames a second: 1 over the median of positive time differences, 0 with fewer than two frames or none of them."""
    w = Window.partitionBy(*keys).orderBy(t)
    gaps = frames.select(*keys, (F.col(t) - F.lag(t).over(w)).alias("gap"))
    middle = F.percentile(F.when(F.col("gap") > 0, F.col("gap")), F.lit(0.5))
    return gaps.groupBy(*keys).agg(F.coalesce(1 / middle, F.lit(0.0)).alias("fps"))


def effective_fps_upper(frames: DataFrame, t: str = "t", keys: Sequence[str] = ("session",), least: int = 10, fallback: float = 30.0) -> DataFrame:
    """The browser's rule: the upper median of positive differences; `fallback` below `least` frames."""
    w = Window.partitionBy(*keys).orderBy(t)
    gaps = frames.select(*keys, (F.col(t) - F.lag(t).over(w)).alias("gap"))
    ranked = Window.partitionBy(*keys).orderBy("gap")
    positive = gaps.filter("gap > 0").withColumn("r", F.row_number().over(ranked)).withColumn("n", F.count("*").over(Window.partitionBy(*keys)))
    middle = positive.filter(F.col("r") == F.floor(F.col("n") / 2) + 1).select(*keys, (1 / F.col("gap")).alias("rate"))
    counts = frames.groupBy(*keys).agg(F.count("*").alias("frames"))
    return counts.join(middle, list(keys), "left").select(*keys, F.when(F.col("frames") < least, fallback).otherwise(F.coalesce("rate", F.lit(fallback))).alias("fps"))


def moving_average(frames: DataFrame, column: str, size: int, out: str, keys: Sequence[str] = ("session",), order: str = "i") -> DataFrame:
    """A centred mean over `size` frames (an even size counts one more) with the ends repeated beyond the edges."""
    size += 1 - size % 2
    h = size // 2
    w = Window.partitionBy(*keys).orderBy(order)
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = w.rowsBetween(-h, h)
    n, r = F.count("*").over(every), F.row_number().over(w)
    before, after = F.greatest(F.lit(0), h + 1 - r), F.greatest(F.lit(0), r + h - n)
    total = F.sum(column).over(near) + before * F.first(column).over(every) + after * F.last(column).over(every)
    return frames.withColumn(out, total / float(size))


def standardised(frames: DataFrame, column: str, out: str, keys: Sequence[str] = ("session",)) -> DataFrame:
    """z-scores with the population deviation; 0 throughout a constant series."""
    w = Window.partitionBy(*keys)
    sd = F.stddev_pop(column).over(w)
    return frames.withColumn(out, F.when(sd > 1e-12, (F.col(column) - F.avg(column).over(w)) / F.nullif(sd, F.lit(0.0))).otherwise(0.0))


def mean_normalised(frames: DataFrame, column: str, out: str, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Divided by the mean, by 1 where that is 0."""
    mean = F.avg(column).over(Window.partitionBy(*keys))
    return frames.withColumn(out, F.col(column) / F.when(F.abs(mean) < 1e-12, 1.0).otherwise(mean))


def lags(frames: DataFrame, column: str, count: int, keys: Sequence[str] = ("session",), order: str = "i") -> DataFrame:
    """lag0 ... of a column, 0 before the start."""
    w = Window.partitionBy(*keys).orderBy(order)
    return frames.select("*", *((F.coalesce(F.lag(column, k).over(w), F.lit(0.0)) if k else F.col(column)).alias(f"lag{k}") for k in range(count)))


def running_max(frames: DataFrame, column: str, out: str, keys: Sequence[str] = ("session",), order: str = "i") -> DataFrame:
    return frames.withColumn(out, F.max(column).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def time_window(frames: DataFrame, reach: int, aggregates: dict[str, Column], keys: Sequence[str] = ("session",), us: str = "us") -> DataFrame:
    """`frames` with aggregates over the frames of the last `reach` microseconds, equal times included."""
    w = Window.partitionBy(*keys).orderBy(us).rangeBetween(-reach, 0)
    return frames.withColumns({name: value.over(w) for name, value in aggregates.items()})


def completeness(frames: DataFrame, column: str, keys: Sequence[str] = ("session",)) -> DataFrame:
    """(keys, complete, mean): a column counts only where none of its values is missing."""
    whole = F.bool_and(F.col(column).isNotNull())
    return frames.groupBy(*keys).agg(whole.alias("complete"), F.when(whole, F.avg(column)).alias("mean"))


def intervals(events: DataFrame, t: str, scale: float, out: str = "gap", keys: Sequence[str] = ("session",)) -> DataFrame:
    """`events` with the time since the one before, times `scale`; the first of each session goes."""
    gap = F.col(t) - F.lag(t).over(Window.partitionBy(*keys).orderBy(t))
    return events.withColumn(out, gap * scale).filter(F.col(out).isNotNull())


def plausible(gaps: DataFrame, column: str = "gap", tolerance: float = 0.3, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Intervals within a share of their session's median; all of them where they are under 3 or the median isn't positive."""
    bounds = gaps.groupBy(*keys).agg(F.count("*").alias("_n")).join(quantiles(gaps, keys, {"_middle": (F.col(column), 0.5)}), list(keys))
    near = F.abs(F.col(column) - F.col("_middle")) <= tolerance * F.col("_middle")
    return gaps.join(bounds, list(keys)).filter((F.col("_n") < 3) | (F.col("_middle") <= 0) | near).drop("_n", "_middle")


def variability(gaps: DataFrame, column: str = "gap", limit: float = 50.0, keys: Sequence[str] = ("session",), order: str = "i") -> DataFrame:
    """(keys, beats, mean, sdnn, rmssd, pnn) of intervals, for sessions with two of them or more.

    `limit`: a difference of successive intervals counts for pnn beyond it.
    """
    step = F.col(column) - F.lag(column).over(Window.partitionBy(*keys).orderBy(order))
    rows = gaps.withColumn("_step", step)
    over = F.when(F.col("_step").isNotNull(), F.when(F.abs("_step") > limit, 1.0).otherwise(0.0))
    made = rows.groupBy(*keys).agg(
        F.count("*").alias("beats"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("sdnn"), F.sqrt(F.avg(F.col("_step") * F.col("_step"))).alias("rmssd"), F.avg(over).alias("pnn")
    )
    return made.filter("beats >= 2")


def resampled(frames: DataFrame, columns: Sequence[str], fps: float | DataFrame, keys: Sequence[str] = ("session",), t: str = "t") -> DataFrame:
    """(keys, k, t, columns) on a uniform grid of round(duration * fps) + 1 points, linear between neighbours.

    `fps`: one rate, or a table (keys, fps) as `effective_fps` gives; a rate of 0 leaves the first point.

    Grid points and frames are put in one order and each grid point takes the frame before and after it, so no range
    join is needed. Frames may come in any order; of equal times the last counts before and the first after.
    """
    span = frames.groupBy(*keys).agg(F.min(t).alias("_a"), F.max(t).alias("_b"))
    # rounds halves to even, as the length of a recording is
    span = span.join(fps.select(*keys, F.col("fps").alias("_fps")), list(keys)) if isinstance(fps, DataFrame) else span.withColumn("_fps", F.lit(float(fps)))
    count = F.bround((F.col("_b") - F.col("_a")) * F.col("_fps")).cast("long")
    grid = span.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), count)))
    grid = grid.select(*keys, "k", (F.col("_a") + F.when(count > 0, (F.col("_b") - F.col("_a")) * F.col("k") / F.nullif(count, F.lit(0))).otherwise(0.0)).alias("_t"))
    rows = frames.select(*keys, F.lit(None).cast("long").alias("k"), F.col(t).alias("_t"), F.struct(F.col(t).alias("_t"), *columns).alias("_s"))
    both = rows.unionByName(grid.withColumn("_s", F.lit(None).cast(rows.schema["_s"].dataType)))
    w = Window.partitionBy(*keys)
    back = w.orderBy("_t", F.col("k").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    ahead = w.orderBy(F.desc("_t"), F.col("k").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("_p", F.last("_s", True).over(back)).withColumn("_q", F.last("_s", True).over(ahead)).filter(F.col("k").isNotNull())
    gap = F.col("_q._t") - F.col("_p._t")
    share = F.when(gap > 0, (F.col("_t") - F.col("_p._t")) / F.nullif(gap, F.lit(0.0))).otherwise(0.0)
    blend = [F.coalesce(F.col(f"_p.{c}") + share * (F.col(f"_q.{c}") - F.col(f"_p.{c}")), F.col(f"_p.{c}"), F.col(f"_q.{c}")).alias(c) for c in columns]
    return met.select(*keys, "k", F.col("_t").alias(t), *blend)
