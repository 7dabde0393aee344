"""Where series come from: simulations, videos through a decoder, and the tables bound as recordings."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import CHANNEL_GAINS, Simulation
from ..functions import columns as C

#: The conditions of the accuracy battery and what they set.
CONDITIONS = {
    "ideal": {"pulse": 0.02, "noise": 1.0},
    "pulso fraco": {"pulse": 0.005, "noise": 3.0},
    "ruído alto": {"pulse": 0.008, "noise": 14.0},
    "deriva de iluminação": {"pulse": 0.015, "noise": 2.0, "drift": 0.25},
    "interferência na banda": {"pulse": 0.015, "noise": 2.0, "tremor": 0.02},
    "interferência forte": {"pulse": 0.012, "noise": 2.0, "tremor": 0.06},
    "captura irregular": {"pulse": 0.015, "noise": 2.0, "jitter_s": 0.015},
}
BATTERY_BPM = (48.0, 60.0, 72.0, 84.0, 96.0, 120.0, 150.0, 180.0)


def interferer_hz(bpm: Column) -> Column:
    """A frequency in the band 0.7 Hz above the pulse, or below it where 3.8 Hz would be passed; within 0.75 to 3.9."""
    up = bpm / 60 + 0.7
    return F.greatest(F.lit(0.75), F.least(F.lit(3.9), F.when(up > 3.8, bpm / 60 - 0.7).otherwise(up)))


def scenarios(rates: DataFrame) -> DataFrame:
    """Every condition for each rate (bpm): the battery's table of parameters."""
    settings = ("pulse", "noise", "drift", "tremor", "jitter_s")
    rows = F.array(*(F.struct(F.lit(name).alias("scenario"), *(F.lit(float(given.get(s, 0.0))).alias(s) for s in settings)) for name, given in CONDITIONS.items()))
    each = rates.select("bpm", F.explode(rows).alias("c")).select("bpm", "c.*")
    return each.withColumn("tremor_hz", F.when(F.col("tremor") > 0, interferer_hz(F.col("bpm"))).otherwise(0.2)).withColumn("seed", F.floor("bpm").cast("int"))


def waveform(t: Column, hz: Column, phase: Column | float = 0.0, harmonics=(1.0, 0.35, 0.12)) -> Column:
    """The sum of harmonics, not yet scaled."""
    return sum((a * F.sin(2 * math.pi * (k + 1) * hz * t + phase) for k, a in enumerate(harmonics)), F.lit(0.0))


def clean_series(recordings: DataFrame, fps: float = 30.0, frames: int = 600, base=(205.0, 175.0, 150.0)) -> DataFrame:
    """Series without noise for recordings (session, bpm, pulse, drift, tremor, tremor_hz), as column expressions.

    The waveform is scaled to a largest magnitude of 1, drift runs over the recording, all channels share the light.
    """
    t = F.col("i") / fps
    each = Window.partitionBy("session")
    rows = recordings.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(frames - 1)))).withColumn("t", t)
    rows = rows.withColumn("_w", waveform(F.col("t"), F.col("bpm") / 60))
    top = F.max(F.abs(F.col("_w"))).over(each)
    wave = F.when(top > 1e-12, F.col("_w") / F.nullif(top, F.lit(0.0))).otherwise(F.col("_w"))
    light = 1.0 + F.col("drift") * F.col("t") / ((frames - 1) / fps) + F.col("tremor") * F.sin(2 * math.pi * F.col("tremor_hz") * F.col("t"))
    rows = rows.withColumn("_wave", wave).withColumn("_light", light)
    channels = [(b * F.col("_light") * (1 + F.col("pulse") * g * F.col("_wave"))).alias(c) for (c, g), b in zip(CHANNEL_GAINS.items(), base, strict=True)]
    return rows.select("session", "i", "t", *channels)


def simulate(s: Simulation) -> pd.DataFrame:
    """One noisy recording with the seed's generators: times, then noise for red, green and blue."""
    n = round(s.duration_s * s.fps)
    t = np.arange(n) / s.fps
    if s.jitter_s > 0:
        moved = t + np.random.default_rng(s.seed + 977).normal(0.0, s.jitter_s, n)
        moved[0] = t[0]
        t = np.maximum.accumulate(moved)
    wave = sum(a * np.sin(2 * np.pi * (k + 1) * s.bpm / 60 * t + s.phase) for k, a in enumerate(s.harmonics))
    top = np.abs(wave).max()
    wave = wave / top if top > 1e-12 else wave
    light = np.ones(n)
    if s.drift:
        light += s.drift * (t - t[0]) / max(1e-9, t[-1] - t[0])
    if s.tremor:
        light += s.tremor * np.sin(2 * np.pi * s.tremor_hz * t)
    noise = np.random.default_rng(s.seed)
    out = {"i": np.arange(n), "t": t}
    for (c, gain), base in zip(CHANNEL_GAINS.items(), reversed(s.skin_bgr), strict=True):
        out[c] = base * light * (1 + s.pulse * gain * wave) + noise.normal(0.0, s.noise / 40, n)
    return pd.DataFrame(out)


def simulated(table: DataFrame, duration_s: float = 20.0, fps: float = 30.0) -> DataFrame:
    """(scenario, bpm, i, t, r, g, b) of each row of `scenarios`; a recording is made where its row lies."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                made = simulate(Simulation(bpm=r.bpm, duration_s=duration_s, fps=fps, pulse=r.pulse, noise=r.noise, drift=r.drift, tremor=r.tremor, tremor_hz=r.tremor_hz, jitter_s=r.jitter_s, seed=int(r.seed)))
                made.insert(0, "bpm", r.bpm)
                made.insert(0, "scenario", np.full(len(made), r.scenario, object))
                yield made

    return table.mapInPandas(run, "scenario string, bpm double, i long, t double, r double, g double, b double")


def videos(spark: SparkSession, path: str, decode: Callable[[bytes], Iterator[tuple]], schema: str = "t double, r double, g double, b double", fps: float | str = 0.0) -> DataFrame:
    """Frames of video files by a given decoder of a file's bytes; there is none here, as decoding needs a library.

    Where the decoder gives no time `t` above 0, a frame has its number over `fps`, a rate or a column of the decoder's.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in schema.split(", ")]
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                made = pd.DataFrame(decode(r.content), columns=names)
                made.insert(0, "i", range(len(made)))
                made.insert(0, "session", r.path)
                yield made

    made = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"session string, i long, {schema}")
    if "t" not in made.columns:
        return made
    return made.withColumn("t", C.frame_time(F.col("t"), F.col("i"), F.col(fps) if isinstance(fps, str) else F.lit(float(fps))))


def frames_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as recordings: a supplier is a session, its items in order of shipping are frames.

    Quantity, price and discount stand for red, green and blue, tax for the background.
    """
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    order = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return items.select(
        F.col("l_suppkey").alias("session"), (F.row_number().over(order) - 1).cast("long").alias("i"), (F.col("l_quantity") + 100).alias("r"),
        (F.col("l_extendedprice") / 1000 + 80).alias("g"), (F.col("l_discount") * 500 + 60).alias("b"), (F.col("l_tax") * 1000 + 40).alias("bg"),
    )


def events_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as irregular recordings: a user is a session, hours since its first event are times."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    hours = (micros - F.min(micros).over(Window.partitionBy("user_id"))) / 3.6e9
    return events.select(F.col("user_id").alias("session"), "event_id", micros.alias("us"), hours.alias("t"), "event_type", "value", "props")


def pixels_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as pixels: an order's month is a frame, the line number a region, colours follow from the keys."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return items.select(
        F.date_format("l_shipdate", "yyyy-MM").alias("frame"), F.col("l_linenumber").cast("int").alias("region"), (F.col("l_partkey") % 96 + 130).cast("int").alias("r"),
        (F.col("l_orderkey") % 80 + 90).cast("int").alias("g"), (F.col("l_suppkey") % 70 + 70).cast("int").alias("b"),
    )


def boxes_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as face boxes in an image of 320 x 240: a customer is a session."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(
        F.col("o_custkey").alias("session"), F.col("o_orderkey").alias("i"), (F.col("o_orderkey") % 200).cast("int").alias("x"), (F.col("o_orderkey") % 150).cast("int").alias("y"),
        (F.floor(F.col("o_totalprice")).cast("long") % 90 + 40).cast("int").alias("w"), (F.floor(F.col("o_totalprice")).cast("long") % 70 + 50).cast("int").alias("h"),
    )
