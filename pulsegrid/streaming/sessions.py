"""Live sessions on list and value states: frames are appended, never rewritten with the rest of their window.

A session's state is a list of frames and one row of what is shown. A trigger appends its frames to the list and reads it
only where a window is due; once it holds two windows it is cut back to one, so a frame is written twice at most. Rows
with an algorithm are control rows: the session starts anew with it, without a restart of the query; they are no frames,
so a run of frames without a face goes on over them. Rows whose read failed are dropped, and so many of them in a row end
the session.

With a watermark frames wait, by their time, until it has passed them: those that come out of order, but not later than
it allows, give what a batch over all frames gives. A timer wakes a session whose frames wait while others go on.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..config import LIBRARY, Analysis
from ..plans.analysis import analyse

OUTPUT = (
    "session long, i long, progress double, bpm double, shown_bpm double, snr_db double, error_code string, segment int, last_bpm double, "
    "last_snr_db double, algorithm string"
)
FRAME = "i long, t double, r double, g double, b double, bg_r double, bg_g double, bg_b double"
WAITING = f"at long, {FRAME}, lost boolean, failed boolean, algorithm string"
SHOWN = "held int, since int, missing int, failed int, segment int, ended boolean, shown double, last_bpm double, last_snr_db double, algorithm string"
COLUMNS = [c.split()[0] for c in WAITING.split(", ")]
#: Failed reads in a row that end a session.
MOST_FAILED = 30
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LiveSession(StatefulProcessor):
    """The rows of one session, in order; see the module for what is kept."""

    def __init__(self, fps: float, config: Analysis, waits: bool = False, idle_ms: int | None = None):
        self.fps, self.config, self.waits, self.idle_ms = fps, config, waits, idle_ms
        self.size, self.step = config.frames_in_window(fps), config.frames_in_step(fps)

    def init(self, handle) -> None:
        self.handle = handle
        self.frames = handle.getListState("frames", FRAME, self.idle_ms)
        self.state = handle.getValueState("shown", SHOWN, self.idle_ms)
        if self.waits:
            self.waiting = handle.getListState("waiting", WAITING)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = [r for pdf in rows for r in pdf[COLUMNS].astype(object).where(pdf[COLUMNS].notna(), None).itertuples(index=False, name=None)]
        if self.waits:
            yield from self.due(key, came, timerValues.getCurrentWatermarkInMs())
        else:
            yield from self.judged(key, sorted(came, key=lambda r: (r[1], r[-1] is None)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self.due(key, [], timerValues.getCurrentWatermarkInMs())

    def due(self, key, came: list[tuple], watermark: int) -> Iterator[pd.DataFrame]:
        """Takes what waits and the watermark has passed, by time."""
        every = sorted([*map(tuple, self.waiting.get()), *came], key=lambda r: (r[0], r[1], r[-1] is None))
        ready = [r for r in every if r[0] < watermark]
        rest = every[len(ready) :]
        if ready or came:
            self.waiting.put(rest) if rest else self.waiting.clear()
        if rest:
            self.handle.registerTimer(rest[0][0] + 1)
        yield from self.judged(key, ready)

    def judged(self, key, rows: Iterable[tuple]) -> Iterator[pd.DataFrame]:
        now = self.state.get() if self.state.exists() else (0, 0, 0, 0, 0, False, None, None, None, self.config.algorithm)
        held, since, missing, failures, segment, ended, shown, last_bpm, last_snr, algorithm = now
        kept: list[tuple] | None = None  # what the list holds, once it has been read
        fresh: list[tuple] = []
        out, anew, last = [], False, None
        for _, *frame, lost, failed, named in rows:
            if ended:
                break
            last = frame[0]
            if named is not None or lost:
                missing += named is None
                if named is not None or missing == self.config.patience + 1:
                    held, since, shown, last_bpm, last_snr, segment = 0, 0, None, None, None, segment + 1
                    kept, fresh, anew, algorithm = [], [], True, named or algorithm
                continue
            if failed:
                failures += 1
                if failures >= MOST_FAILED:
                    ended = True
                    out.append((key[0], last, min(1.0, held / self.size), None, shown, None, "fonte_indisponivel", segment, last_bpm, last_snr, algorithm))
                continue
            missing, failures = 0, 0
            fresh.append(tuple(frame))
            held, since = held + 1, since + 1
            if held < self.size or since < self.step:
                continue
            since = 0  # a failed window counts for the cadence too
            if kept is None:
                kept = list(map(tuple, self.frames.get()))
            window = np.array([*kept, *fresh][-self.size :], float)  # None becomes NaN
            background = window[:, 5:8].T if np.isfinite(window[:, 5:8]).all() else None
            found = analyse(window[:, 2:5].T, self.fps, self.config.having(algorithm=algorithm), background, times=window[:, 1])
            bpm = found.get("bpm")
            if bpm is not None:
                a = min(max(self.config.smoothing, 0.0), 1.0)
                shown = bpm if shown is None else shown + a * (bpm - shown)
                last_bpm, last_snr = bpm, found["snr_db"]
            out.append((key[0], last, 1.0, bpm, shown, found.get("snr_db"), found.get("error_code"), segment, last_bpm, last_snr, algorithm))
        if last is not None and not out and held < self.size and not ended:
            out.append((key[0], last, held / self.size, None, shown, None, None, segment, last_bpm, last_snr, algorithm))
        if anew:
            self.frames.clear()
        if held > 2 * self.size:
            whole = [*(kept if kept is not None else map(tuple, self.frames.get())), *fresh][-self.size :]
            self.frames.put(whole)
            held = self.size
        elif fresh:
            self.frames.appendList(fresh)
        if last is not None:
            self.state.update((held, since, missing, failures, segment, ended, shown, last_bpm, last_snr, algorithm))
        if out:
            floats = dict.fromkeys(("progress", "bpm", "shown_bpm", "snr_db", "last_bpm", "last_snr_db"), float)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")]).astype({**floats, "error_code": object})

    def close(self) -> None:
        pass


def live(frames: DataFrame, fps: float, config: Analysis = LIBRARY, event_time: str | None = None, late: str = "10 seconds", idle_ms: int | None = None) -> DataFrame:
    """Estimates of a stream of frames (session, i, r, g, b; t, bg_r, bg_g, bg_b, lost, failed and algorithm if there are).

    A row comes for each window that is due, and one of progress for each trigger that ends while a window fills.
    `event_time`: a timestamp column by which frames are put in order, as late as `late`; without it a trigger's rows go
    by `i`. `idle_ms`: how long a silent session's state is kept, for streams that run on.
    """
    spark = frames.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != STORE:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)  # list states and timers need it
    if event_time and idle_ms:
        raise ValueError("states expire by processing time, which orders by event time do not have")
    kinds = dict(x.split() for x in WAITING.split(", "))
    known = set(frames.columns)
    false = {"lost", "failed"}
    at = F.unix_millis(F.col(event_time).cast("timestamp")) if event_time else F.lit(0).cast("long")
    columns = [at.alias("at")]
    for c in COLUMNS[1:]:
        value = F.col(c).cast(kinds[c]) if c in known else F.lit(None).cast(kinds[c])
        columns.append((F.coalesce(value, F.lit(False)) if c in false else value).alias(c))
    if event_time:
        frames = frames.withColumn("_at", F.col(event_time).cast("timestamp")).withWatermark("_at", late)
        columns.append(F.col("_at"))
    processor = LiveSession(fps, config, bool(event_time), idle_ms)
    mode = "EventTime" if event_time else "ProcessingTime" if idle_ms else "none"
    return frames.select(F.col("session").cast("long").alias("session"), *columns).groupBy("session").transformWithStateInPandas(processor, OUTPUT, "Append", mode)
