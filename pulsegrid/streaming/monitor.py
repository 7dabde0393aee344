"""Live sessions as a stateful stream: count windows, resets, smoothing and the last good analysis.

Each session's state holds the frames of one window at most and can go when the session falls silent, so that memory follows
the number of live sessions. The same functions analyse batches, and a stream over the same rows gives the same estimates.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..config import LIBRARY, Analysis
from ..plans.analysis import analyse

OUTPUT = "session long, i long, progress double, bpm double, shown_bpm double, snr_db double, error_code string, segment int, last_bpm double, last_snr_db double"
STATE = "buffer string, since int, shown double, segment int, missing int, last_bpm double, last_snr_db double"


def frame_stream(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet", files_per_batch: int = 1000) -> DataFrame:
    """A stream of the files that come into a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).load(folder)


class Monitor:
    """One session's state between frames; `push` returns a row when a window is due, `progress` one while it fills.

    A frame is (t, r, g, b) with or without its background's three colours. Each window is resampled at the rate that its
    times show. A failed window keeps the last good analysis and counts for the cadence. More frames without a face in a
    row than the configuration's patience begin a new segment, with nothing kept.
    """

    def __init__(self, fps: float, config: Analysis, saved: tuple | None = None):
        self.fps, self.config = fps, config
        self.size, self.step = config.frames_in_window(fps), config.frames_in_step(fps)
        text, self.since, self.shown, self.segment, self.missing, self.last_bpm, self.last_snr_db = saved or ("[]", 0, None, 0, 0, None, None)
        self.buffer: list[list[float | None]] = json.loads(text)

    def saved(self) -> tuple:
        return json.dumps(self.buffer), self.since, self.shown, self.segment, self.missing, self.last_bpm, self.last_snr_db

    def reset(self) -> None:
        self.buffer, self.since, self.shown, self.last_bpm, self.last_snr_db = [], 0, None, None, None
        self.segment += 1

    def row(self, i: int, bpm: float | None = None, snr: float | None = None, error: str | None = None) -> tuple:
        return i, min(1.0, len(self.buffer) / self.size), bpm, self.shown, snr, error, self.segment, self.last_bpm, self.last_snr_db

    def progress(self, i: int) -> tuple | None:
        """What is known while the window fills."""
        return self.row(i) if len(self.buffer) < self.size else None

    def push(self, i: int, frame: list[float | None], lost: bool) -> tuple | None:
        if lost:
            self.missing += 1
            if self.missing == self.config.patience + 1:
                self.reset()
            return None
        self.missing = 0
        self.buffer = [*self.buffer[1 - self.size :], frame]
        self.since += 1
        if len(self.buffer) < self.size or self.since < self.step:
            return None
        self.since = 0  # a failed window counts for the cadence too
        held = np.array(self.buffer, float)  # None becomes NaN
        found = analyse(held[:, 1:4].T, self.fps, self.config, held[:, 4:7].T if held.shape[1] == 7 else None, times=held[:, 0])
        bpm = found.get("bpm")
        if bpm is not None:
            a = min(max(self.config.smoothing, 0.0), 1.0)
            self.shown = bpm if self.shown is None else self.shown + a * (bpm - self.shown)
            self.last_bpm, self.last_snr_db = bpm, found["snr_db"]
        return self.row(i, bpm, found.get("snr_db"), found.get("error_code"))


def monitored(frames: DataFrame, fps: float, config: Analysis = LIBRARY, idle: str | None = None) -> DataFrame:
    """Estimates of a stream of frames (session, i, r, g, b, lost; t and bg_r, bg_g, bg_b if there are), by frame order
    within each trigger, and a row of progress for each trigger that ends while a window fills.

    `idle`, such as "10 minutes": the state of a session goes once nothing has come for so long, so memory follows the
    sessions that live. It is for streams that run on: one that ends with what is available would wait for it for ever.
    """
    number, unit = (idle or "0 seconds").split()
    idle_ms = int(float(number) * {"second": 1, "minute": 60, "hour": 3600}[unit.rstrip("s")] * 1000)
    has_background = "bg_r" in frames.columns

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        own = Monitor(fps, config, state.get if state.exists else None)
        rows = []
        colours = ["t", "r", "g", "b", *(("bg_r", "bg_g", "bg_b") if has_background else ())]
        pdf = pd.concat(batches).sort_values("i", kind="stable")
        values = pdf[colours].astype(object).where(pdf[colours].notna(), None).values.tolist()
        for i, frame, lost in zip(pdf.i.tolist(), values, pdf.lost.tolist(), strict=True):
            if (found := own.push(int(i), frame, bool(lost))) is not None:
                rows.append((key[0], *found))
        if len(pdf) and not rows and (found := own.progress(int(pdf.i.iloc[-1]))) is not None:
            rows.append((key[0], *found))
        state.update(own.saved())
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        if rows:
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in OUTPUT.split(", ")])
            yield out.astype({"bpm": float, "shown_bpm": float, "snr_db": float, "last_bpm": float, "last_snr_db": float, "error_code": object})

    t = F.col("t").cast("double") if "t" in frames.columns else F.lit(None).cast("double")
    background = [F.col(f"bg_{c}").cast("double").alias(f"bg_{c}") for c in "rgb"] if has_background else []
    wanted = frames.select("session", "i", t.alias("t"), "r", "g", "b", *background, F.coalesce("lost", F.lit(False)).alias("lost"))
    return wanted.groupBy("session").applyInPandasWithState(run, OUTPUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def sliding_means(events: DataFrame, time: str, value: str, length: str = "10 minutes", step: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Event-time windows with a watermark, for streams that carry wall-clock times."""
    stamped = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return stamped.groupBy(F.window("_t", length, step)).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("window.start").alias("start"), "n", "mean")


def drained(stream: DataFrame, name: str, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns its rows, written under `folder` with its progress."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/{name}/rows").option("checkpointLocation", f"{folder}/{name}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/{name}/rows")
