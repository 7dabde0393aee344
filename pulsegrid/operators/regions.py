"""Pixels, boxes and regions: skin, spatial means, trimming, region sets, background strips, jitter, tracking."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clip_rect, is_skin, overlap, part_rect, rect, scale_rect
from .quantiles import met, quantiles
from .series import changes

#: Region sets as fractions (x0, y0, x1, y1) of a face box.
FOREHEAD = (0.24, 0.12, 0.76, 0.32)
LEFT_CHEEK = (0.08, 0.50, 0.38, 0.80)
RIGHT_CHEEK = (0.62, 0.50, 0.92, 0.80)
CENTRE = (0.15, 0.15, 0.85, 0.85)
REGION_SETS = {"testa": (FOREHEAD,), "bochechas": (LEFT_CHEEK, RIGHT_CHEEK), "testa_e_bochechas": (FOREHEAD, LEFT_CHEEK, RIGHT_CHEEK), "rosto_central": (CENTRE,)}
LEAST_PIXELS = 50
LEAST_BACKGROUND = 200


def skin_share(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, pixels, skin, share) of skin by colour."""
    mask = is_skin(F.col("r"), F.col("g"), F.col("b")).cast("int")
    return pixels.groupBy(*keys).agg(F.count("*").alias("pixels"), F.sum(mask).alias("skin"), F.avg(mask).alias("share"))


def opened_and_closed(mask: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A mask (keys, y, x, on) after an opening and a closing by the cross of five pixels.

    Each pass takes the least or largest of a pixel and its four neighbours: two windows, along rows and along columns.
    Pixels beyond the image never decide. Frames are dealt once, so all eight windows share one exchange.
    """
    mask = mask.repartition(*keys)

    def passed(df, pick):
        row = Window.partitionBy(*keys, "y").orderBy("x").rangeBetween(-1, 1)
        column = Window.partitionBy(*keys, "x").orderBy("y").rangeBetween(-1, 1)
        across = df.withColumn("_a", pick("on").over(row)).withColumn("_b", pick("on").over(column))
        both = F.least if pick is F.min else F.greatest
        return across.withColumn("on", both("_a", "_b")).drop("_a", "_b")

    for pick in (F.min, F.max, F.max, F.min):
        mask = passed(mask, pick)
    return mask


def trimmed(pixels: DataFrame, keys: Sequence[str], low: float = 0.05, high: float = 0.95, least: int = LEAST_PIXELS) -> DataFrame:
    """Pixels whose green lies between two percentiles of their region, all channels by one choice.

    A region keeps all its pixels where fewer than `least` would be left.
    """
    bounds = quantiles(pixels, keys, {"_lo": (F.col("g"), low), "_hi": (F.col("g"), high)})
    near = met(pixels, bounds, keys).withColumn("_in", F.col("g").between(F.col("_lo"), F.col("_hi")))
    left = near.groupBy(*keys).agg(F.count_if("_in").alias("_left"))
    return met(near, left, keys).filter(F.col("_in") | (F.col("_left") < least)).drop("_lo", "_hi", "_in", "_left")


def without_extremes(values: DataFrame, column: str, percent: float = 5.0, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Rows between two percentiles of their group; a group that would be left empty keeps its rows, an empty table stays empty."""
    if not 0.0 <= percent < 50.0:
        raise ValueError("a percentile lies from 0 to 50")
    if percent == 0.0:
        return values
    bounds = quantiles(values, keys, {"_lo": (F.col(column), percent / 100), "_hi": (F.col(column), 1 - percent / 100)})
    near = met(values, bounds, keys).withColumn("_in", F.coalesce(F.col(column).between(F.col("_lo"), F.col("_hi")), F.lit(False)))
    left = near.groupBy(*keys).agg(F.count_if("_in").alias("_left"))
    return met(near, left, keys).filter(F.col("_in") | (F.col("_left") == 0)).drop("_lo", "_hi", "_in", "_left")


def fixed_region(frames: DataFrame, region: tuple[int, int, int, int], width: str = "width", height: str = "height") -> DataFrame:
    """`frames` with one region for all of them, cut to each frame; null where nothing of it is left. An empty region is refused."""
    if region[2] <= 0 or region[3] <= 0:
        raise ValueError("a fixed region must not be empty")
    own = clip_rect(rect(*(F.lit(v) for v in region)), F.col(width), F.col(height))
    return frames.withColumn("box", own).withColumn("box", F.when((F.col("box.w") > 0) & (F.col("box.h") > 0), F.col("box")))


def spatial_means(pixels: DataFrame, frame: Sequence[str], region: str = "region", least: int = LEAST_PIXELS, least_region: int | None = None) -> DataFrame:
    """(frame, r, g, b, pixels): the mean over all regions that have enough pixels, for frames that have enough."""
    sums = [F.sum(c).alias(f"_{c}") for c in "rgb"]
    each = pixels.groupBy(*frame, region).agg(*sums, F.count("*").alias("n")).filter(F.col("n") >= (least if least_region is None else least_region))
    added = each.groupBy(*frame).agg(*(F.sum(f"_{c}").alias(c) for c in "rgb"), F.sum("n").alias("pixels"))
    return added.filter(F.col("pixels") >= least).select(*frame, *((F.col(c) / F.col("pixels")).alias(c) for c in "rgb"), "pixels")


def weighted_means(pixels: DataFrame, frame: Sequence[str], region: str = "region", least: int = 30) -> DataFrame:
    """The browser's rule: region means of skin, weighted by skin pixels, of regions with at least `least` of them."""
    skin = pixels.filter(is_skin(F.col("r"), F.col("g"), F.col("b")))
    each = skin.groupBy(*frame, region).agg(*(F.avg(c).alias(f"_{c}") for c in "rgb"), F.count("*").alias("n")).filter(F.col("n") >= least)
    return each.groupBy(*frame).agg(*((F.sum(F.col(f"_{c}") * F.col("n")) / F.sum("n")).alias(c) for c in "rgb"), F.sum("n").alias("pixels"))


def background_means(pixels: DataFrame, frame: Sequence[str], least: int = LEAST_BACKGROUND) -> DataFrame:
    """Means of the pixels that aren't skin; null where they are fewer than `least`."""
    mask = ~is_skin(F.col("r"), F.col("g"), F.col("b"))
    count = F.sum(mask.cast("int"))
    return pixels.groupBy(*frame).agg(*(F.when(count >= least, F.avg(F.when(mask, F.col(c)))).alias(f"bg_{c}") for c in "rgb"), count.alias("pixels"))


def frozen_choice(pixels: DataFrame, keep: Column, place: Sequence[str], session: Sequence[str] = ("session",), frame: str = "frame", every: int = 30) -> DataFrame:
    """Pixels chosen in the first frame of each epoch of `every` frames, kept for the whole epoch."""
    epoch = F.floor(F.col(frame) / every)
    first = F.min(frame).over(Window.partitionBy(*session, "epoch"))
    marked = pixels.withColumn("epoch", epoch).withColumn("_first", first)
    chosen = marked.filter((F.col(frame) == F.col("_first")) & keep).select(*session, "epoch", *place).distinct()
    return marked.join(chosen, [*session, "epoch", *place], "left_semi").drop("_first")


def shape_epochs(frames: DataFrame, shape: Sequence[str], session: Sequence[str] = ("session",), frame: str = "frame", every: int = 30) -> DataFrame:
    """`frames`, one row each, with `epoch`: one begins where the shape isn't that of the frame before, and at every so many frames."""
    w = Window.partitionBy(*session).orderBy(frame)
    before = F.lag(F.struct(*shape)).over(w)
    begins = before.isNull() | ~before.eqNullSafe(F.struct(*shape)) | (F.col(frame) % every == 0)
    return frames.withColumn("_b", begins.cast("long")).withColumn("epoch", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_b")


def frozen_by_shape(pixels: DataFrame, keep: Column, place: str, shape: Sequence[str], session: Sequence[str] = ("session",), frame: str = "frame", every: int = 30, least: int = LEAST_PIXELS) -> DataFrame:
    """Pixels, with their epoch, whose place was chosen in the epoch's first frame; an epoch of fewer than `least` chosen gives none.

    A choice is a bitmap for each epoch (a row for 32,768 places), and each pixel tests its own bit: nothing is joined by
    pixel. `place` numbers a region's pixels from 1; `shape` is that of the region in a frame.
    """
    frames = pixels.select(*session, frame, *shape).groupBy(*session, frame).agg(*(F.min(c).alias(c) for c in shape))
    epochs = shape_epochs(frames, shape, session, frame, every).select(*session, frame, "epoch")
    first = epochs.groupBy(*session, "epoch").agg(F.min(frame).alias("_first"))
    marked = pixels.join(epochs.join(first, [*session, "epoch"]), [*session, frame]).withColumn("_bucket", F.bitmap_bucket_number(place))
    bits = marked.filter((F.col(frame) == F.col("_first")) & keep).groupBy(*session, "epoch", "_bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bits"))
    enough = bits.groupBy(*session, "epoch").agg(F.sum(F.bitmap_count("_bits")).alias("_n")).filter(F.col("_n") >= least).drop("_n")
    tested = marked.join(bits.join(enough, [*session, "epoch"]), [*session, "epoch", "_bucket"])
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.expr("shiftright(_byte, _at)").bitwiseAND(F.lit(1))
    return tested.withColumn("_byte", byte).withColumn("_at", (at % 8).cast("int")).filter(bit == 1).drop("_first", "_bucket", "_bits", "_byte", "_at")


def regions_of(boxes: DataFrame, region_set: str, box: str = "box", width: int | None = None, height: int | None = None) -> DataFrame:
    """A row for each region of the set, by fractions of the box."""
    parts = [part_rect(F.col(box), *f) for f in REGION_SETS[region_set]]
    if width and height:
        parts = [clip_rect(p, width, height) for p in parts]
    return boxes.select("*", F.posexplode(F.array(*parts)).alias("region", "rect"))


def eye_regions(left: Column, right: Column, width: int, height: int) -> Column:
    """Forehead and cheeks from two eye points, in units of their distance; empty ones are left out."""
    d = F.hypot(right["x"] - left["x"], right["y"] - left["y"])
    line, centre = (left["y"] + right["y"]) / 2, (left["x"] + right["x"]) / 2

    def between(x0, y0, x1, y1):
        return clip_rect(rect(F.bround(x0), F.bround(y0), F.bround(x1 - x0), F.bround(y1 - y0)), width, height)

    found = F.array(
        between(centre - 0.55 * d, line - d, centre + 0.55 * d, line - 0.5 * d),
        between(left["x"] - 0.30 * d, line + 0.38 * d, left["x"] + 0.22 * d, line + 0.95 * d),
        between(right["x"] - 0.22 * d, line + 0.38 * d, right["x"] + 0.30 * d, line + 0.95 * d),
    )
    return F.filter(found, lambda r: (r["w"] > 0) & (r["h"] > 0))


def plausible_eyes(left: Column, right: Column, face_width: Column) -> Column:
    """Eyes 0.22 to 0.75 of the face's width apart and tilted by 0.35 at most."""
    dx = right["x"] - left["x"]
    d = F.hypot(dx, right["y"] - left["y"])
    return (dx > 0) & (d / face_width).between(0.22, 0.75) & (F.abs(right["y"] - left["y"]) <= 0.35 * d)


def held_eyes(frames: DataFrame, keys: Sequence[str] = ("session",), order: str = "i", every: int = 60) -> DataFrame:
    """`frames` with the eyes (left, right) that hold at each: looked for until some are found, then every so many frames.

    A look that finds none leaves the eyes as they were. The order column counts a session's frames from 0.
    """
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    found = F.when(F.col("left").isNotNull() & F.col("right").isNotNull(), F.struct("left", "right"))
    seen = frames.withColumn("_found", found).withColumn("_before", F.count("_found").over(upto) - F.col("_found").isNotNull().cast("int"))
    looked = F.when((F.col(order) % every == 0) | (F.col("_before") == 0), F.col("_found"))
    held = seen.withColumn("_looked", looked).withColumn("_held", F.last("_looked", True).over(upto))
    return held.withColumn("left", F.col("_held.left")).withColumn("right", F.col("_held.right")).drop("_found", "_before", "_looked", "_held")


def anchored_or_fraction(eyes: Column, fractions: Column) -> Column:
    """The three regions by the eyes, where all lie in the image; for the set of forehead and cheeks alone."""
    return F.when(F.size(eyes) == 3, eyes).otherwise(fractions)


def anchored(frames: DataFrame, width: int, height: int, keys: Sequence[str] = ("session",), order: str = "i", every: int = 60) -> DataFrame:
    """`frames` (box, left, right) with a row for each region: forehead and cheeks by the eyes that hold, else by the box.

    Eyes that no face could have count as not found. `anchored` tells which it was.
    """
    points = F.col("left").isNotNull() & F.col("right").isNotNull() & plausible_eyes(F.col("left"), F.col("right"), F.col("box")["w"])
    seen = held_eyes(frames.withColumn("_ok", F.coalesce(points, F.lit(False))).withColumn("left", F.when(F.col("_ok"), F.col("left"))), keys, order, every)
    by_box = F.array(*(clip_rect(part_rect(F.col("box"), *f), width, height) for f in REGION_SETS["testa_e_bochechas"]))
    by_eyes = F.when(F.col("left").isNotNull(), eye_regions(F.col("left"), F.col("right"), width, height)).otherwise(F.array().cast("array<struct<x:int,y:int,w:int,h:int>>"))
    found = seen.withColumn("_eyes", by_eyes).withColumn("anchored", F.size("_eyes") == 3)
    return found.select("*", F.posexplode(anchored_or_fraction(F.col("_eyes"), by_box)).alias("region", "rect")).drop("_eyes", "_ok")


def background_strips(face: Column, width: int, height: int, share: float = 0.14, grown: float = 1.35) -> Column:
    """The strips at both sides of the image that don't touch the grown face."""
    w = max(8, int(width * share))
    strips = F.array(rect(F.lit(0), F.lit(0), F.lit(w), F.lit(height)), rect(F.lit(width - w), F.lit(0), F.lit(w), F.lit(height)))
    wide = clip_rect(scale_rect(face, grown), width, height)
    return F.filter(strips, lambda s: overlap(s, wide) == 0)


def largest(boxes: DataFrame, most: int = 2, keys: Sequence[str] = ("session",), order: str = "i") -> DataFrame:
    """The `most` largest boxes of each session, by area and then order, placed from left to right; `largest` marks the first."""
    by = Window.partitionBy(*keys)
    top = boxes.withColumn("_k", F.row_number().over(by.orderBy(F.desc(F.col("w") * F.col("h")), order))).filter(F.col("_k") <= most)
    return top.withColumn("place", F.row_number().over(by.orderBy("x", order))).withColumn("largest", F.col("_k") == 1).drop("_k")


def pixel_variation(pixels: DataFrame, frame: Sequence[str] = ("frame",), region: Sequence[str] = ("region",)) -> DataFrame:
    """(region, median_pixels, variation): the median of a region's pixels in a frame, and their deviation in per cent."""
    counts = pixels.groupBy(*frame, *region).agg(F.count("*").alias("_n"))
    middle = quantiles(counts, region, {"median_pixels": (F.col("_n"), 0.5)})
    return met(counts.groupBy(*region).agg((100 * F.stddev_pop("_n") / F.avg("_n")).alias("variation")), middle, region)


def box_jitter(boxes: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(keys, jitter, drift): the 95th percentile of the centre's moves and how far it strays in all."""
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    w = Window.partitionBy(*keys).orderBy(*order)
    moved = boxes.select(*keys, cx.alias("cx"), cy.alias("cy"), F.hypot(cx - F.lag(cx).over(w), cy - F.lag(cy).over(w)).alias("move"))
    return moved.groupBy(*keys).agg(F.coalesce(F.percentile("move", F.lit(0.95)), F.lit(0.0)).alias("jitter"), F.hypot(F.stddev_pop("cx"), F.stddev_pop("cy")).alias("drift"))


#: A box that there is not.
LOST = (None, None, None, None)


class Tracker:
    """One session's box: smoothed by a quarter, jumps refused, held over a number of missed detections."""

    def __init__(self, smoothing: float = 0.25, tolerance: int = 15, jump: float = 0.35, every: int = 1):
        if not 0 < smoothing <= 1 or every < 1:
            raise ValueError("smoothing must be in (0, 1] and the interval at least 1")
        self.smoothing, self.tolerance, self.jump, self.every = smoothing, tolerance, jump, every
        self.box: tuple[int, int, int, int] | None = None
        self.misses = self.seen = self.refused = 0

    def jumps(self, new) -> bool:
        x, y, w, h = self.box
        dx, dy = new[0] + new[2] / 2 - x - w / 2, new[1] + new[3] / 2 - y - h / 2
        return (dx * dx + dy * dy) ** 0.5 > self.jump * max(1.0, w) or not 0.625 <= new[2] / max(1.0, w) <= 1.6

    def update(self, found) -> tuple[int, int, int, int] | None:
        """The box after a frame with this detection (None: no face), or None where the face is lost."""
        turn = self.seen % self.every == 0 or self.box is None
        self.seen += 1
        if not turn:
            return self.box
        odd = found is not None and self.box is not None and self.jumps(found)
        if found is None or odd:
            self.misses += 1
            self.refused += odd
            if self.box is not None and self.misses <= self.tolerance:
                return self.box
            if found is None:
                self.box = None
                return None
        self.misses = 0
        if self.box is None:
            self.box = tuple(found)
        else:
            self.box = tuple(round(a + (b - a) * self.smoothing) for a, b in zip(self.box, found, strict=True))
        return self.box


def tracked(boxes: DataFrame, keys: Sequence[str] = ("session",), order: str = "i", **settings) -> DataFrame:
    """(keys, order, x, y, w, h, lost): a fold over each session's detections (a null in one: none).

    Sessions are read in order, batch by batch; a task remembers one tracker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, key = Tracker(**settings), None
        for batch in batches:
            if not batch.num_rows:
                continue
            begins = np.append(key is None or key != [batch.column(k)[0].as_py() for k in keys], changes(batch, keys)).tolist()
            key = [batch.column(k)[-1].as_py() for k in keys]
            faces = np.logical_and.reduce([batch.column(n).is_valid() for n in "xywh"]).tolist()
            found = zip(*(batch.column(n).fill_null(0).to_numpy().tolist() for n in "xywh"))
            out = []
            for first, face, box in zip(begins, faces, found, strict=True):
                if first:
                    own = Tracker(**settings)
                out.append(own.update(box if face else None) or LOST)
            sides = [pa.array(side, pa.int32()) for side in zip(*out)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (*keys, order)), *sides, pc.is_null(sides[0])], [*keys, order, *"xywh", "lost"])

    kinds = dict(boxes.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in (*keys, order)), *(f"{n} int" for n in "xywh"), "lost boolean"])
    by = [F.col(f"`{k}`") for k in keys]
    sides = (F.when(~F.isnan(n), F.col(n)).cast("int").alias(n) for n in "xywh")
    return boxes.select(*by, F.col(f"`{order}`"), *sides).repartition(*by).sortWithinPartitions(*by, F.asc_nulls_last(f"`{order}`")).mapInArrow(run, schema)
