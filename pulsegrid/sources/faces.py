"""Simulated faces as pixel tables: an ellipse of skin over a wall, both under one light."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CHANNEL_GAINS, Simulation

WALL = {"r": 96.0, "g": 104.0, "b": 112.0}


def box_at(s: Simulation, t: float) -> tuple[int, int, int, int]:
    """The face's box, swaying sideways."""
    w, h = s.width * 2 // 5, s.height * 3 // 5
    x = (s.width - w) // 2 + round(s.move_px * np.sin(2 * np.pi * s.move_hz * t))
    return x, (s.height - h) // 2, w, h


def rendered(recordings: DataFrame, s: Simulation) -> DataFrame:
    """Frames (session, frame, t, x, y, w, h, image) from colours (session, i, t, r, g, b) of skin.

    Sensor noise is drawn for each pixel from the session and frame, so that a frame can be made again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yy, xx = np.mgrid[0 : s.height, 0 : s.width]
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                x, y, w, h = box_at(s, r.t)
                face = ((xx - x - w / 2) / (w / 2)) ** 2 + ((yy - y - h / 2) / (h / 2)) ** 2 <= 1
                noise = np.random.default_rng([int(r.session), int(r.i), s.seed]).normal(0, s.noise, (3, s.height, s.width))
                image = np.stack([np.where(face, getattr(r, c), WALL[c]) for c in CHANNEL_GAINS]) + noise
                out.append((r.session, r.i, r.t, x, y, w, h, np.clip(np.rint(image), 0, 255).astype(np.uint8).tobytes()))
            yield pd.DataFrame(out, columns=["session", "frame", "t", "x", "y", "w", "h", "image"])

    return recordings.select("session", "i", "t", "r", "g", "b").mapInPandas(run, "session long, frame long, t double, x int, y int, w int, h int, image binary")


def pixels_in(frames: DataFrame, regions: DataFrame, height: int, width: int, keys=("session", "frame")) -> DataFrame:
    """Pixels (keys, region, y, x, r, g, b) of the regions (keys, region, rect) of each frame.

    Regions are gathered by frame, of which each has a few; a frame is opened where it lies.
    """
    per_frame = regions.groupBy(*keys).agg(F.collect_list(F.struct("region", "rect.x", "rect.y", "rect.w", "rect.h")).alias("regions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                image = np.frombuffer(r.image, np.uint8).reshape(3, height, width)
                for q in r.regions:
                    x0, y0, x1, y1 = max(q["x"], 0), max(q["y"], 0), min(q["x"] + q["w"], width), min(q["y"] + q["h"], height)
                    if x1 <= x0 or y1 <= y0:
                        continue
                    yy, xx = np.mgrid[y0:y1, x0:x1]
                    cut = image[:, y0:y1, x0:x1].reshape(3, -1).astype(np.int32)
                    yield pd.DataFrame({keys[0]: getattr(r, keys[0]), keys[1]: getattr(r, keys[1]), "region": int(q["region"]), "y": yy.ravel().astype(np.int32), "x": xx.ravel().astype(np.int32), "r": cut[0], "g": cut[1], "b": cut[2]}).astype({"region": np.int32})

    return frames.join(per_frame, list(keys)).select(*keys, "image", "regions").mapInPandas(run, f"{keys[0]} long, {keys[1]} long, region int, y int, x int, r int, g int, b int")
