"""Simulated recordings as a Spark data source, for batches and streams.

    spark.dataSource.register(SimulatedPulse)
    spark.read.format("simulated_pulse").option("sessions", 100).option("bpm", 72).load()
    spark.readStream.format("simulated_pulse").option("rows_per_batch", 30).load()
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..config import Simulation
from .recordings import simulate

SCHEMA = "session long, i long, t double, r double, g double, b double"


class Part(InputPartition):
    """Frames from `start` up to `end` of sessions from `first` up to `last`."""

    def __init__(self, first: int, last: int, start: int, end: int):
        self.first, self.last, self.start, self.end = first, last, start, end


class Settings:
    def __init__(self, options: dict):
        self.sessions, self.partitions = int(options.get("sessions", 1)), int(options.get("partitions", 4))
        self.bpm, self.seconds, self.fps = float(options.get("bpm", 72)), float(options.get("seconds", 20)), float(options.get("fps", 30))
        self.seed, self.rows_per_batch = int(options.get("seed", 0)), int(options.get("rows_per_batch", 30))
        if self.sessions < 1 or self.partitions < 1 or self.rows_per_batch < 1:
            raise ValueError("sessions, partitions and rows_per_batch must be positive")

    @property
    def frames(self) -> int:
        return round(self.seconds * self.fps)

    def parts(self, start: int, end: int) -> list[Part]:
        n = min(self.partitions, self.sessions)
        edges = [self.sessions * k // n for k in range(n + 1)]
        return [Part(a, b, start, end) for a, b in zip(edges, edges[1:])]

    def rows(self, part: Part) -> Iterator[tuple]:
        """A session's seed follows its number, so any part of it can be made again."""
        for session in range(part.first, part.last):
            made = simulate(Simulation(bpm=self.bpm, duration_s=self.seconds, fps=self.fps, seed=self.seed + session))
            for r in made.iloc[part.start : part.end].itertuples(index=False):
                yield session, int(r.i), float(r.t), float(r.r), float(r.g), float(r.b)


class Reader(DataSourceReader):
    def __init__(self, settings: Settings):
        self.settings = settings

    def partitions(self) -> list[Part]:
        return self.settings.parts(0, self.settings.frames)

    def read(self, partition: Part) -> Iterator[tuple]:
        return self.settings.rows(partition)


class StreamReader(DataSourceStreamReader):
    """Offsets count frames; a trigger gets the next `rows_per_batch` frames of every session until recordings end."""

    def __init__(self, settings: Settings):
        self.settings = settings
        self.at = 0

    def initialOffset(self) -> dict:
        return {"frame": 0}

    def latestOffset(self) -> dict:
        self.at = min(self.settings.frames, self.at + self.settings.rows_per_batch)
        return {"frame": self.at}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return self.settings.parts(start["frame"], end["frame"]) if start["frame"] < end["frame"] else []

    def read(self, partition: Part) -> Iterator[tuple]:
        return self.settings.rows(partition)

    def commit(self, end: dict) -> None:
        """Nothing is held back: frames can be made again."""


class SimulatedPulse(DataSource):
    @classmethod
    def name(cls) -> str:
        return "simulated_pulse"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(Settings(self.options))

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(Settings(self.options))
