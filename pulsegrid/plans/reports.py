"""Reports over estimates: sessions, accuracy batteries, diagnostic grids, history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import decimal_comma, scrub, usable
from ..operators.quantiles import met, quantiles
from ..sources.shared import written

INF = float("inf")


def finite(c):
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < INF), c)


def session_report(estimates: DataFrame, keys: Sequence[str] = ("session",)) -> DataFrame:
    """Windows, usable ones, exact median and population deviation of bpm, median of finite SNR."""
    good = usable(F.col("confidence"))
    bpm = F.when(good, F.col("bpm"))
    return estimates.groupBy(*keys).agg(
        F.count("*").alias("windows"), F.sum(good.cast("int")).cast("long").alias("usable"), F.percentile(bpm, F.lit(0.5)).alias("median_bpm"),
        F.when(F.count(bpm) >= 2, F.stddev_pop(bpm)).alias("bpm_sd"), F.percentile(finite(F.col("snr_db")), F.lit(0.5)).alias("median_snr_db"),
    )


def predominant(estimates: DataFrame, value: str, order: str, keys: Sequence[str] = ("session",)) -> DataFrame:
    """The most frequent value of each session; of equals the one seen first."""
    counts = estimates.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct("n", -F.col("_first"))).alias(value))


def detection_rate(frames: DataFrame, keys: Sequence[str] = ("session",), face: str = "face") -> DataFrame:
    return frames.groupBy(*keys).agg(F.avg(F.col(face).cast("int")).alias("detection_rate"))


def accuracy(results: DataFrame, keys: Sequence[str], tolerance: float = 3.0) -> DataFrame:
    """Errors of estimates against the truth; failed ones (null error) count against the hit rate alone."""
    e = F.col("error")
    return results.groupBy(*keys).agg(
        F.count("*").alias("total"), F.sum(e.isNull().cast("int")).cast("long").alias("failures"), F.avg(e).alias("mae"), F.max(e).alias("max_error"),
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(finite(F.col("snr_db"))).alias("mean_snr_db"),
        (F.sum(F.when(e <= tolerance, 1).otherwise(0)) / F.count("*")).alias("hit_rate"),
    )


def error_pivot(results: DataFrame, row: str, column: str, values: Sequence[str], error: str = "error") -> DataFrame:
    """Mean errors: a row for each value of `row`, a column for each of `values`; null where there is none."""
    e = F.col(error)
    return results.groupBy(row).agg(*(F.avg(F.when(F.col(column) == v, e)).alias(v) for v in values))


def diagnostic_ranking(estimates: DataFrame, config: Sequence[str], show: int = 14) -> DataFrame:
    """Configurations in order: enough windows first, then less dispersion, then more SNR; the first `show`.

    Enough is 5 windows, or 40 % of the most that any has. The list is a report, so its limit is its meaning.
    """
    own = written(estimates.select(*config, "bpm", "snr_db"))  # read more than once
    spread = own.groupBy(*config).agg(F.stddev_pop("bpm").alias("dispersion"), F.count("*").alias("windows"))
    middle = quantiles(own, config, {"median_bpm": (F.col("bpm"), 0.5), "median_snr_db": (F.col("snr_db"), 0.5)})
    each = met(spread, middle, config)
    most = each.agg(F.greatest(F.lit(5), F.floor(0.4 * F.max("windows"))).alias("least"))
    ranked = each.crossJoin(F.broadcast(most)).withColumn("few", F.col("windows") < F.col("least"))
    return ranked.orderBy("few", "dispersion", F.desc("median_snr_db"), *config).limit(show).drop("least")


def agreement(ranked: DataFrame, least: int = 4, spread: float = 6.0) -> DataFrame:
    """Whether the middle half of the best configurations' medians lies within `spread` bpm."""
    q = F.percentile("median_bpm", F.array(F.lit(0.25), F.lit(0.75)))
    return ranked.agg(F.count("*").alias("configurations"), (F.element_at(q, 2) - F.element_at(q, 1)).alias("iqr")).withColumn("agree", (F.col("configurations") >= least) & (F.col("iqr") < spread))


def recent(estimates: DataFrame, keys: Sequence[str] = ("session",), order: str = "window_id", last: int = 60, least: int = 3) -> DataFrame:
    """Median and population deviation of bpm over the last estimates of each session, from `least` of them on."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    rows = estimates.withColumn("_place", place).filter(F.col("_place") <= last)
    enough = F.count("*") >= least
    return rows.groupBy(*keys).agg(F.when(enough, F.percentile("bpm", F.lit(0.5))).alias("median_bpm"), F.when(enough, F.stddev_pop("bpm")).alias("bpm_sd"))


def newest(history: DataFrame, most: int = 500, time: str = "instant", tie: str = "id") -> DataFrame:
    """The newest records, at most `most`: the cap of a stored history."""
    return history.orderBy(F.desc(time), F.desc(tie)).limit(most)


def people(history: DataFrame, person: str = "person", time: str = "instant", value: str = "bpm") -> DataFrame:
    """Records, last use and, from two records on, mean, least and largest value of each trimmed name."""
    name = F.trim(F.col(person))
    several = F.count("*") >= 2
    return history.filter(name != "").groupBy(name.alias("person")).agg(
        F.count("*").alias("records"), F.max(time).alias("last"), *(F.when(several, f(value)).alias(f"{n}_bpm") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max)))
    )


def history_lines(history: DataFrame) -> DataFrame:
    """Lines of a semicolon-separated export with decimal commas: date, time, person, bpm, SNR, confidence, note."""
    at = F.timestamp_millis(F.col("instant"))
    cells = (F.date_format(at, "dd/MM/yyyy"), F.date_format(at, "HH:mm:ss"), scrub(F.col("person")), decimal_comma(F.col("bpm"), 1), decimal_comma(F.col("snr_db"), 1), F.col("confidence"), scrub(F.col("note")))
    return history.select("id", F.concat_ws(";", *cells).alias("line"))


def write_history(history: DataFrame, path: str) -> None:
    """Export files with CRLF line ends; a byte-order mark starts each file's header line."""
    header = "﻿data;hora;pessoa;bpm;snr;confianca;observacao"
    history_lines(history).select("line").withColumnRenamed("line", header).write.mode("overwrite").option("header", True).option("lineSep", "\r\n").option("quote", "").option("sep", "\x1f").csv(path)


def write_estimates(estimates: DataFrame, path: str) -> None:
    """Estimates as comma-separated files: bpm with 3, hz with 5 and SNR with 3 decimals."""
    shown = estimates.select("window_id", *(F.format_string(f"%.{d}f", c).alias(c) for c, d in (("bpm", 3), ("hz", 5), ("snr_db", 3))), "confidence", "algorithm", "window_s")
    shown.write.mode("overwrite").option("header", True).csv(path)


def capture_wide(capture: DataFrame, variants: Sequence[str]) -> DataFrame:
    """A row for each frame with r, g, b and px of every variant side by side, and the background's colours and the box
    where the capture has them; these are the frame's, not a variant's."""
    of_variant = (F.first(F.when(F.col("variant") == v, F.col(c)), True).alias(f"{v}_{c}") for v in variants for c in ("r", "g", "b", "px"))
    of_frame = (F.first(c, True).alias(c) for c in ("bg_r", "bg_g", "bg_b", "box_x", "box_y", "box_w", "box_h") if c in capture.columns)
    return capture.groupBy("i", "t").agg(*of_variant, *of_frame)


def write_capture(capture: DataFrame, variants: Sequence[str], path: str) -> None:
    capture_wide(capture, variants).write.mode("overwrite").option("header", True).option("sep", ";").option("nullValue", "").csv(path)


def markdown(report: DataFrame, rows: int = 10_000) -> str:
    """A small report as a Markdown table; one of more than `rows` rows is refused, not cut."""
    names = report.columns
    lines = [f"| {' | '.join(names)} |", f"|{'---|' * len(names)}"]
    found = report.limit(rows + 1).collect()
    if len(found) > rows:
        raise ValueError(f"a report of more than {rows} rows is for a table, not for Markdown")
    for r in found:
        lines.append(f"| {' | '.join(f'{v:.2f}' if isinstance(v, float) else '' if v is None else str(v) for v in r)} |")
    return "\n".join(lines)


def evenly(series: DataFrame, points: int, keys: Sequence[str] = ("session",), order: str = "i") -> DataFrame:
    """At most `points` evenly spaced rows of each session, for drawing."""
    each = Window.partitionBy(*keys)
    n, r = F.count("*").over(each), F.row_number().over(each.orderBy(order)) - 1
    spaced = series.withColumn("_n", n).withColumn("_r", r)
    first = F.floor(F.col("_r") * points / F.col("_n")) != F.floor((F.col("_r") - 1) * points / F.col("_n"))
    return spaced.filter((F.col("_n") <= points) | first).drop("_n", "_r")
