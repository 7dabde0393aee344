"""Column expressions: bands, confidence, skin, rectangles, text. All stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CONFIDENCES, Band


def zero(c: Column, digits: int = 6) -> Column:
    """Rounded, without negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def in_band(hz: Column, band: Band) -> Column:
    return hz.between(band.low_hz, band.high_hz)


def nyquist_error(fps: Column, band: Band) -> Column:
    """The code of a frame rate too low for the band, or null."""
    return F.when(fps < 2 * band.high_hz, F.lit("fps_invalido"))


def band_error(fps: Column, band: Band) -> Column:
    """The code of a band that isn't inside (0, fps / 2), or null."""
    half = fps / 2
    fits = (half > 0) & (F.lit(band.low_hz) / F.nullif(half, F.lit(0.0)) < 1) & (F.lit(band.high_hz) / F.nullif(half, F.lit(0.0)) < 1)
    return F.when(~F.coalesce(fits, F.lit(False)), F.lit("banda_invalida"))


def confidence(snr: Column) -> Column:
    """The name of the highest level that an SNR in dB reaches."""
    (high, a), (medium, b), (low, c), (none, _) = CONFIDENCES
    return F.when(snr >= a, high).when(snr >= b, medium).when(snr >= c, low).otherwise(none)


def usable(level: Column) -> Column:
    return level != CONFIDENCES[-1][0]


def is_skin(r: Column, g: Column, b: Column) -> Column:
    """Skin by luma 40-250, red difference 133-173 and blue difference 77-127."""
    y = 0.299 * r + 0.587 * g + 0.114 * b
    return y.between(40, 250) & (0.713 * (r - y) + 128).between(133, 173) & (0.564 * (b - y) + 128).between(77, 127)


def is_finger(r: Column, g: Column, b: Column) -> Column:
    """A fingertip over the lens."""
    return (r > 60) & (r > 1.6 * g) & (r > 1.6 * b)


def rect(x, y, w, h) -> Column:
    return F.struct(*(F.greatest(F.lit(0), c).cast("int").alias(n) if n in "wh" else c.cast("int").alias(n) for n, c in zip("xywh", (x, y, w, h), strict=True)))


def area(a: Column) -> Column:
    return a["w"].cast("long") * a["h"]


def clip_rect(a: Column, width: int, height: int) -> Column:
    """The part of a rectangle inside an image."""
    x0, y0 = F.least(F.greatest(a["x"], F.lit(0)), F.lit(width)), F.least(F.greatest(a["y"], F.lit(0)), F.lit(height))
    x1, y1 = F.least(F.greatest(a["x"] + a["w"], F.lit(0)), F.lit(width)), F.least(F.greatest(a["y"] + a["h"], F.lit(0)), F.lit(height))
    return rect(x0, y0, x1 - x0, y1 - y0)


def scale_rect(a: Column, factor: float) -> Column:
    """Grown or shrunk about its centre, halves to even."""
    w, h = F.bround(a["w"] * factor), F.bround(a["h"] * factor)
    return rect(F.bround(a["x"] + a["w"] / 2 - w / 2), F.bround(a["y"] + a["h"] / 2 - h / 2), w, h)


def part_rect(a: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """The part of a rectangle between fractions of its sides."""
    if not (0 <= x0 < x1 <= 1 and 0 <= y0 < y1 <= 1):
        raise ValueError("fractions must rise within 0 to 1")
    return rect(F.bround(a["x"] + x0 * a["w"]), F.bround(a["y"] + y0 * a["h"]), F.bround((x1 - x0) * a["w"]), F.bround((y1 - y0) * a["h"]))


def blend_rect(a: Column, b: Column, weight: float) -> Column:
    """From `a` (weight 0) to `b` (weight 1), halves to even."""
    return rect(*(F.bround(a[n] + (b[n] - a[n]) * weight) for n in "xywh"))


def centre_box(width: int, height: int, share: float = 0.5) -> Column:
    """A box about the image's centre, for recordings without a detector."""
    w, h = round(width * share), round(height * share)
    return rect(F.lit((width - w) // 2), F.lit((height - h) // 2), F.lit(w), F.lit(h))


def frame_time(t: Column, i: Column, fps: Column) -> Column:
    """A frame's own time in seconds where its container gives one above 0, or else its number over the nominal rate.

    A nominal rate that is missing or not above 0 counts as 30.
    """
    return F.when(t > 0, t).otherwise(i / F.when(fps > 0, fps).otherwise(30.0))


def frame_error(image: Column, channels: int, width: Column, height: Column) -> Column:
    """The code of an image that is missing or not of its declared size, or null."""
    wrong = image.isNull() | (width <= 0) | (height <= 0) | (F.octet_length(image) != channels * width * height)
    return F.when(F.coalesce(wrong, F.lit(True)), F.lit("regiao_invalida"))


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where both are empty."""
    w = F.greatest(F.lit(0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    h = F.greatest(F.lit(0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    both = w.cast("double") * h
    union = area(a) + area(b) - both
    return F.when(union > 0, both / F.nullif(union, F.lit(0.0))).otherwise(0.0)


def power_of_two(n: Column) -> Column:
    """The least power of two that isn't less; doubling a start of 1 is exact where log2 isn't."""
    out = F.lit(1 << 30)
    for k in reversed(range(30)):
        out = F.when(n <= (1 << k), F.lit(1 << k)).otherwise(out)
    return out


def without_accents(text: Column) -> Column:
    return F.translate(text, "áàâãäéèêëíìîïóòôõöúùûüçñÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑ", "aaaaaeeeeiiiiooooouuuucnAAAAAEEEEIIIIOOOOOUUUUCN")


def decimal_comma(x: Column, digits: int) -> Column:
    return F.translate(F.format_string(f"%.{digits}f", x.cast("double")), ".", ",")


def scrub(text: Column) -> Column:
    """Delimiters and line ends become blanks."""
    return F.regexp_replace(text, r"[;\r\n]+", " ")
