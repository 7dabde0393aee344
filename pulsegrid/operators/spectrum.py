"""Spectra of series as tables (keys, bin, hz, power): in-band transforms, peaks, signal-to-noise.

Only bins inside the band are computed. A series of n frames makes n times bins products that are summed on the map
side, so what is shuffled is one row for each series, bin and task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Band
from ..functions.columns import confidence, power_of_two

PADDING = 8
SNR_WIDTH_HZ = 0.1
SNR_MOST_DB = 60.0


def periodogram(series: DataFrame, value: str, fps: float, band: Band, keys: Sequence[str] = ("session",), order: str = "i", periodic: bool = False, double: bool = False) -> DataFrame:
    """Power of the mean-removed, Hann-windowed series padded to a power of two of 8 times its length, within the band.

    |transform|^2 / (sum of squared weights * fps), one-sided; `double` counts both sides. Under 2 frames: no rows;
    of 2 frames both weights are 0, and so is the power.
    """
    each = Window.partitionBy(*keys)
    n = F.count("*").over(each)
    base = series.select(*keys, (F.row_number().over(each.orderBy(order)) - 1).alias("_i"), n.alias("_n"), (F.col(value) - F.avg(value).over(each)).alias("_x")).filter("_n >= 2")
    weight = 0.5 - 0.5 * F.cos(2 * math.pi * F.col("_i") / (F.col("_n") - (0 if periodic else 1)))
    base = base.withColumn("_w", weight).withColumn("_size", power_of_two(F.col("_n") * PADDING).cast("long"))
    low = F.greatest(F.lit(0), F.ceil(F.lit(band.low_hz) * F.col("_size") / fps - 1e-9)).cast("long")
    high = F.least(F.floor(F.lit(band.high_hz) * F.col("_size") / fps + 1e-9), F.floor(F.col("_size") / 2)).cast("long")
    bins = base.filter(low <= high).withColumn("bin", F.explode(F.sequence(low, high)))
    # the angle's whole turns are taken away as integers, so that it stays small and exact
    angle = F.pmod(F.col("_i").cast("long") * F.col("bin"), F.col("_size")) * (2 * math.pi) / F.col("_size")
    x = F.col("_x") * F.col("_w")
    sums = bins.groupBy(*keys, "bin", "_size").agg(F.sum(x * F.cos(angle)).alias("re"), F.sum(x * F.sin(angle)).alias("im"), F.sum(F.col("_w") * F.col("_w")).alias("gain"))
    power = F.coalesce((F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (F.nullif(F.col("gain"), F.lit(0.0)) * fps), F.lit(0.0))
    return sums.select(*keys, "bin", (F.col("bin") * fps / F.col("_size")).alias("hz"), (power * (2.0 if double else 1.0)).alias("power"))


def welch(series: DataFrame, value: str, fps: float, band: Band, keys: Sequence[str] = ("session",), order: str = "i", parts: int = 3) -> DataFrame:
    """Mean periodogram of segments of max(8, n / parts) frames that overlap by half; under 8 frames no rows.

    A frame finds its segments by arithmetic; the window is the periodic Hann and both sides count.
    """
    each = Window.partitionBy(*keys)
    base = series.select(*keys, value, (F.row_number().over(each.orderBy(order)) - 1).alias("_p"), F.count("*").over(each).alias("_all")).filter("_all >= 8")
    size = F.greatest(F.lit(8), F.floor(F.col("_all") / parts)).cast("long")
    base = base.withColumn("_len", size).withColumn("_hop", size - F.floor(size / 2))
    last = F.floor((F.col("_all") - F.col("_len")) / F.col("_hop"))
    low = F.greatest(F.lit(0), F.ceil((F.col("_p") - F.col("_len") + 1) / F.col("_hop"))).cast("long")
    high = F.least(last, F.floor(F.col("_p") / F.col("_hop"))).cast("long")
    cut = base.filter(low <= high).withColumn("_segment", F.explode(F.sequence(low, high)))
    spectra = periodogram(cut, value, fps, band, [*keys, "_segment"], "_p", periodic=True, double=True)
    return spectra.groupBy(*keys, "bin", "hz").agg(F.avg("power").alias("power"))


def normalised(spectrum: DataFrame, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Power over its maximum, 0 where that isn't positive."""
    top = F.max("power").over(Window.partitionBy(*keys))
    return spectrum.withColumn("power", F.when(top > 0, F.col("power") / F.nullif(top, F.lit(0.0))).otherwise(0.0))


def dominant(spectrum: DataFrame, band: Band, keys: Sequence[str] = ("session",)) -> DataFrame:
    """(keys, hz, bpm, snr_db, confidence): the strongest bin, the first of equals, refined by a parabola of logarithms.

    Signal is what lies within 0.1 Hz of the peak or 0.2 Hz of its double; -inf without signal, 60 dB at most.
    """
    each = Window.partitionBy(*keys)
    ordered = each.orderBy("bin")
    near = spectrum.withColumn("_before", F.lag("power").over(ordered)).withColumn("_after", F.lead("power").over(ordered)).withColumn("_next", F.lead("hz").over(ordered))
    # the peak by a window over the same keys: the spectrum is made once and joined with nothing
    top = near.withColumn("p", F.max(F.struct("power", (-F.col("bin")).alias("_turn"), "hz", "_before", "_after", "_next")).over(each))
    positive = (F.col("p._before") > 0) & (F.col("p.power") > 0) & (F.col("p._after") > 0)
    log = {n: F.log(F.when(F.col(f"p.{n}") > 0, F.col(f"p.{n}"))) for n in ("_before", "power", "_after")}
    bend = log["_before"] - 2 * log["power"] + log["_after"]
    shift = F.greatest(F.lit(-0.5), F.least(F.lit(0.5), 0.5 * (log["_before"] - log["_after"]) / F.nullif(bend, F.lit(0.0))))
    hz = F.when(positive & (F.abs(bend) >= 1e-18), F.col("p.hz") + shift * (F.col("p._next") - F.col("p.hz"))).otherwise(F.col("p.hz"))
    met = top.select(*keys, "hz", "power", F.greatest(F.lit(band.low_hz), F.least(F.lit(band.high_hz), hz)).alias("peak_hz"))
    is_signal = (F.abs(F.col("hz") - F.col("peak_hz")) <= SNR_WIDTH_HZ) | (F.abs(F.col("hz") - 2 * F.col("peak_hz")) <= 2 * SNR_WIDTH_HZ)
    sums = met.groupBy(*keys, "peak_hz").agg(F.sum(F.when(is_signal, F.col("power")).otherwise(0.0)).alias("s"), F.sum(F.when(is_signal, 0.0).otherwise(F.col("power"))).alias("n"))
    ratio = 10 * F.log10(F.when(F.col("s") > 1e-20, F.col("s")) / F.when(F.col("n") > 1e-20, F.col("n")))
    snr = F.when(F.col("s") <= 1e-20, F.lit(float("-inf"))).when(F.col("n") <= 1e-20, SNR_MOST_DB).otherwise(F.least(F.lit(SNR_MOST_DB), ratio))
    return sums.select(*keys, F.col("peak_hz").alias("hz"), (F.col("peak_hz") * 60).alias("bpm"), snr.alias("snr_db")).withColumn("confidence", confidence(F.col("snr_db")))
