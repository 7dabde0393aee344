"""Diagnostic grids: one capture, read once, through every variant, algorithm and use of the background."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DIAGNOSTIC, Analysis
from ..operators.series import count_chunks
from .analysis import CHUNK, analysed

#: ICA is left out of the grid.
GRID = ("pos", "chrom", "verde")


def stacked(capture: DataFrame, variants: Sequence[str], keys: Sequence[str] = ("session",)) -> DataFrame:
    """A row for each frame and variant of a capture with columns r_<variant>, g_<variant>, b_<variant>: one scan."""
    rows = F.array(*(F.struct(F.lit(v).alias("variant"), *(F.col(f"{c}_{v}").alias(c) for c in "rgb")) for v in variants))
    kept = [c for c in ("bg_r", "bg_g", "bg_b") if c in capture.columns]
    return capture.select(*keys, "i", *kept, F.explode(rows).alias("v")).select(*keys, "i", *kept, "v.*")


def grid(capture: DataFrame, fps: float, config: Analysis = DIAGNOSTIC, keys: Sequence[str] = ("session",), algorithms: Sequence[str] = GRID) -> DataFrame:
    """Estimates of every window of every variant by every algorithm, with and without the background.

    Windows of max(64, window) frames start every step, and the gate on noise is the configuration's. Both uses of the
    background come from one pass over the windows; one without a whole background is judged only without it.
    """
    size = max(64, config.frames_in_window(fps))
    step = config.frames_in_step(fps)
    chunks = count_chunks(capture, size, step, CHUNK, [*keys, "variant"], at_once=True)
    found = analysed(chunks, fps, config, [*keys, "variant", "chunk"], algorithms=algorithms, uses=(True, False), sliding=(size, step))
    return found.filter(F.col("error_code").isNull())
