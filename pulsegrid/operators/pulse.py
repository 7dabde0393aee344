"""Pulse signals from colour: green, chrominance (with a spectral band-pass), plane orthogonal to skin, rectification.

Everything here is Column expressions over windows of one partitioning; numpy variants are in `kernels`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Band
from .series import lags, mean_normalised


def green(frames: DataFrame, out: str = "pulse") -> DataFrame:
    return frames.withColumn(out, -F.col("g"))


def pos(frames: DataFrame, fps: float, keys: Sequence[str] = ("session",), order: str = "i", out: str = "pulse") -> DataFrame:
    """Plane orthogonal to skin by two stacked row windows.

    In a sub-window of L frames the projection is A r + B g + C b with factors of its means, variances and covariances
    alone, and its mean is 0. So the first window gives each sub-window's factors over its deviation, and the second adds
    up the factors of all sub-windows that hold a frame: overlap-add without exploding. Up to L frames are one block.
    """
    size = max(2, round(1.6 * fps))
    w = Window.partitionBy(*keys).orderBy(order)
    whole = Window.partitionBy(*keys)
    n = F.count("*").over(whole)
    short = F.col("_n") <= size

    def of(window, prefix):
        r, g, b = F.col("r"), F.col("g"), F.col("b")
        pairs = (("rr", r, r), ("gg", g, g), ("bb", b, b), ("rg", r, g), ("rb", r, b), ("gb", g, b))
        return [*(F.avg(c).over(window).alias(f"{prefix}m{c}") for c in "rgb"), *(F.covar_pop(x, y).over(window).alias(f"{prefix}{name}") for name, x, y in pairs)]

    base = frames.withColumn("_n", n)
    base = base.select("*", F.row_number().over(w).alias("_row"), *of(w.rowsBetween(-(size - 1), 0), "_w"), *of(whole, "_a"))

    def factors(df, p):
        """Adds the factors of r, g and b, step by step so that no expression is written out twice."""
        mean = [F.when(F.abs(F.col(f"{p}m{c}")) < 1e-12, 1.0).otherwise(F.col(f"{p}m{c}")).alias(f"{p}n{c}") for c in "rgb"]
        df = df.select("*", *mean)
        df = df.select("*", *((F.col(p + x + y) / (F.col(f"{p}n{x}") * F.col(f"{p}n{y}"))).alias(f"{p}v{x}{y}") for x, y in ("rr", "gg", "bb", "rg", "rb", "gb")))
        rr, gg, bb, rg, rb, gb = (F.col(f"{p}v{n}") for n in ("rr", "gg", "bb", "rg", "rb", "gb"))
        df = df.select("*", F.sqrt(F.greatest(F.lit(0.0), gg + bb - 2 * gb)).alias(f"{p}s1"), F.sqrt(F.greatest(F.lit(0.0), 4 * rr + gg + bb - 4 * rg - 4 * rb + 2 * gb)).alias(f"{p}s2"))
        df = df.withColumn(f"{p}q", F.when(F.col(f"{p}s2") > 1e-12, F.col(f"{p}s1") / F.nullif(F.col(f"{p}s2"), F.lit(0.0))).otherwise(0.0))
        a, b, c = -2 * F.col(f"{p}q"), 1 + F.col(f"{p}q"), F.col(f"{p}q") - 1
        df = df.withColumn(f"{p}sd", F.sqrt(F.greatest(F.lit(0.0), a * a * rr + b * b * gg + c * c * bb + 2 * a * b * rg + 2 * a * c * rb + 2 * b * c * gb)))
        over = F.when(F.col(f"{p}sd") > 1e-12, F.col(f"{p}sd")).otherwise(1.0)
        return df.select("*", *((x / (F.col(f"{p}n{ch}") * over)).alias(f"{p}f{ch}") for x, ch in zip((a, b, c), "rgb", strict=True)))

    full = F.col("_row") >= size
    each = factors(factors(base, "_w"), "_a").select("*", *(F.when(full, F.col(f"_wf{c}")).otherwise(0.0).alias(f"_f{c}") for c in "rgb"))
    ahead = w.rowsBetween(0, size - 1)
    added = sum((F.col(c) * F.sum(f"_f{c}").over(ahead) for c in "rgb"), F.lit(0.0))
    # every sub-window's projection is centred: its mean is (a + b + c) / deviation = 0, as channels are mean-normalised
    single = sum((F.col(c) * F.col(f"_af{c}") for c in "rgb"), F.lit(0.0))
    return each.withColumn(out, F.when(short, single).otherwise(added)).select(*frames.columns, out)


def spectral_bandpass(frames: DataFrame, columns: Sequence[str], fps: float, band: Band, length: int, keys: Sequence[str] = ("session",), order: str = "i") -> DataFrame:
    """Columns filtered by dropping all bins outside the band of a transform padded to a power of two.

    `length`: the frames of a session (or window) at most. Only bins in the band are computed, by sums over frames and
    then over bins; each side of the product is small, and both are grouped by the session.
    """
    size = 1 << max(1, (length - 1).bit_length())
    low, high = math.ceil(band.low_hz * size / fps - 1e-12), min(math.floor(band.high_hz * size / fps + 1e-12), size // 2)
    each = Window.partitionBy(*keys)
    spot = frames.select(*keys, order, (F.row_number().over(each.orderBy(order)) - 1).alias("_i"), *((F.col(c) - F.avg(c).over(each)).alias(c) for c in columns))
    bins = spot.withColumn("_k", F.explode(F.sequence(F.lit(low), F.lit(high))))
    angle = F.col("_i") * F.col("_k") * (2 * math.pi / size)
    parts = bins.groupBy(*keys, "_k").agg(*(x for c in columns for x in (F.sum(F.col(c) * F.cos(angle)).alias(f"_re_{c}"), F.sum(F.col(c) * F.sin(angle)).alias(f"_im_{c}"))))
    packed = parts.groupBy(*keys).agg(F.collect_list(F.struct("_k", *(f"_{x}_{c}" for c in columns for x in ("re", "im")))).alias("_bins"))
    back = spot.select(*keys, order, "_i").join(packed, list(keys))

    def value(c):
        def term(acc, b):
            turn = F.col("_i") * b["_k"] * (2 * math.pi / size)
            # a bin and its mirror image; the middle one is its own
            both = F.when(b["_k"] * 2 == size, 1.0).otherwise(2.0)
            return acc + both * (b[f"_re_{c}"] * F.cos(turn) + b[f"_im_{c}"] * F.sin(turn))

        return F.aggregate("_bins", F.lit(0.0), term) / float(size)

    return back.select(*keys, order, *(value(c).alias(c) for c in columns))


def chrom_spectral(frames: DataFrame, fps: float, band: Band, length: int, keys: Sequence[str] = ("session",), order: str = "i", out: str = "pulse") -> DataFrame:
    """Chrominance: X = 3r - 2g and Y = 1.5r + g - 1.5b of normalised channels, both band-passed, X - (sx / sy) Y."""
    base = frames
    for c in "rgb":
        base = mean_normalised(base, c, f"_{c}", keys)
    base = base.select(*keys, order, (3 * F.col("_r") - 2 * F.col("_g")).alias("x"), (1.5 * F.col("_r") + F.col("_g") - 1.5 * F.col("_b")).alias("y"))
    both = spectral_bandpass(base, ["x", "y"], fps, band, length, keys, order)
    each = Window.partitionBy(*keys)
    sy = F.stddev_pop("y").over(each)
    ratio = F.when(sy > 1e-12, F.stddev_pop("x").over(each) / F.nullif(sy, F.lit(0.0))).otherwise(0.0)
    return both.select(*keys, order, (F.col("x") - ratio * F.col("y")).alias(out))


def rectified(frames: DataFrame, signal: str, background: str, keys: Sequence[str] = ("session",), order: str = "i", out: str = "rectified", double_level: bool = False) -> DataFrame:
    """A channel without what three lags of the standardised background explain, its mean put back.

    Nine sums a session and a closed 3 x 3 solve; under 24 frames there are fewer lags, one for each 8 frames. The channel
    stays as it is for a constant background or signal, for equations without a solution and for a factor above three
    deviations of the signal. A session whose background
    is null anywhere has none. `removed` is the share of the variance taken away.
    """
    each = Window.partitionBy(*keys)
    sd, n = F.stddev_pop(background).over(each), F.count("*").over(each)
    base = frames.select("*", ((F.col(background) - F.avg(background).over(each)) / F.when(sd >= 1e-12, sd)).alias("_z"), (F.col(signal) - F.avg(signal).over(each)).alias("_x"), F.avg(signal).over(each).alias("_mean"))
    base = base.withColumn("_n", n).withColumn("_whole", F.count(background).over(each) == n)
    base = lags(base, "_z", 3, keys, order)
    # a short series has fewer lags: the others become unknowns that are 0
    used = F.least(F.lit(3), F.greatest(F.lit(1), F.floor(F.col("_n") / 8)))
    base = base.select(*(c for c in base.columns if not c.startswith("lag")), *(F.when(F.lit(j) < used, F.col(f"lag{j}")).otherwise(0.0).alias(f"lag{j}") for j in range(3)))
    names = [(a, b) for a in range(3) for b in range(a, 3)]
    sums = {(a, b): F.sum(F.col(f"lag{a}") * F.col(f"lag{b}")).over(each) + (F.when(F.lit(a) < used, 0.0).otherwise(1.0) if a == b else F.lit(0.0)) for a, b in names}
    base = base.select("*", *(c.alias(f"_s{a}{b}") for (a, b), c in sums.items()), *(F.sum(F.col(f"lag{a}") * F.col("_x")).over(each).alias(f"_t{a}") for a in range(3)))
    m = {(a, b): F.col(f"_s{min(a, b)}{max(a, b)}") for a in range(3) for b in range(3)}
    det = det3([[m[a, b] for b in range(3)] for a in range(3)])
    solved = [det3([[F.col(f"_t{a}") if b == j else m[a, b] for b in range(3)] for a in range(3)]) / F.nullif(det, F.lit(0.0)) for j in range(3)]
    base = base.select("*", *(c.alias(f"_c{j}") for j, c in enumerate(solved)), F.stddev_pop("_x").over(each).alias("_sd"))
    largest = F.greatest(*(F.abs(F.col(f"_c{j}")) for j in range(3)))
    good = F.col("_whole") & (F.col("_sd") >= 1e-12) & F.coalesce(largest <= 3 * F.col("_sd"), F.lit(False))
    fit = sum((F.col(f"_c{j}") * F.col(f"lag{j}") for j in range(3)), F.lit(0.0))
    kept = F.col(signal) + (F.col("_mean") if double_level else F.lit(0.0))
    base = base.withColumn(out, F.when(good, F.col("_x") - fit + F.col("_mean")).otherwise(kept))
    ratio = F.var_pop(out).over(each) / F.nullif(F.var_pop(signal).over(each), F.lit(0.0))
    removed = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - ratio)), F.lit(0.0))
    return base.withColumn("removed", removed).select(*frames.columns, out, "removed")


def det3(m):
    (a, b, c), (d, e, f), (g, h, i) = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
