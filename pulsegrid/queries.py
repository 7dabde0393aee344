"""Registered queries of the engine's own operators, over whole tables, each with its SQL where DuckDB has it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import Analysis, Band
from .functions import columns as C
from .operators import pulse, regions, scan, series, spectrum
from .operators.kernels import ALGORITHMS, bandpass_design
from .plans import analysis, diagnostic, reports
from .plans.linear_maps import bandpass_map, detrend_map, matrix_sql
from .sources import recordings
from .sources.shared import folder
from .streaming import monitor, sessions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
FPS, BAND, BLOCK = 30.0, Band(), 64
PERIOD = 6.283185307179586
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")

FRAMES = """f AS (SELECT l_suppkey AS session, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber,
  l_partkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS i, l_quantity + 100 AS r, l_extendedprice / 1000 + 80 AS g,
  l_discount * 500 + 60 AS b, l_tax * 1000 + 40 AS bg FROM lineitem)"""
EVENTS = """e AS (SELECT user_id AS session, event_id, epoch_us(ts) AS us, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 3.6e9 AS t,
  event_type, value, props FROM events)"""
PIXELS = """p AS (SELECT strftime(l_shipdate, '%Y-%m') AS frame, CAST(l_linenumber AS INTEGER) AS region, l_partkey % 96 + 130 AS r,
  l_orderkey % 80 + 90 AS g, l_suppkey % 70 + 70 AS b FROM lineitem),
  s AS (SELECT *, 0.299e0 * r + 0.587e0 * g + 0.114e0 * b AS lum FROM p),
  px AS (SELECT *, lum BETWEEN 40 AND 250 AND 0.713e0 * (r - lum) + 128 BETWEEN 133 AND 173 AND 0.564e0 * (b - lum) + 128 BETWEEN 77 AND 127 AS skin FROM s)"""
BOXES = """q AS (SELECT o_custkey AS session, o_orderkey AS i, CAST(o_orderkey % 200 AS INTEGER) AS x, CAST(o_orderkey % 150 AS INTEGER) AS y,
  CAST(CAST(floor(o_totalprice) AS BIGINT) % 90 + 40 AS INTEGER) AS w, CAST(CAST(floor(o_totalprice) AS BIGINT) % 70 + 50 AS INTEGER) AS h FROM orders)"""
ESTIMATES = """x AS (SELECT *, value / 8 - 1 AS snr_db FROM e), z AS (SELECT *, CASE WHEN snr_db >= 6 THEN 'alta' WHEN snr_db >= 2 THEN 'média'
  WHEN snr_db >= 0 THEN 'baixa' ELSE 'descartada' END AS confidence FROM x)"""


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


frames, events, pixels, boxes = recordings.frames_table, recordings.events_table, recordings.pixels_table, recordings.boxes_table


def estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as window estimates: value is bpm and sets the SNR."""
    rows = events(spark, sf_dir).withColumn("snr_db", F.col("value") / 8 - 1)
    return rows.withColumn("confidence", C.confidence(F.col("snr_db"))).withColumn("bpm", F.col("value"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames in blocks of 64, the unit of the spectral queries; a session's last block is what is left."""
    return frames(spark, sf_dir).withColumn("block", F.floor(F.col("i") / BLOCK)).withColumn("k", F.col("i") % BLOCK)


def long_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the 8 frames at least that a dominant frequency needs."""
    rows = blocks(spark, sf_dir).withColumn("_n", F.count("*").over(Window.partitionBy("session", "block")))
    return rows.filter("_n >= 8").drop("_n")


KEYS = ["session", "block"]
BLOCKS = FRAMES + """, k0 AS (SELECT *, i // 64 AS block, i % 64 AS k, count(*) OVER (PARTITION BY session, i // 64) AS n FROM f),
  bl AS (SELECT * FROM k0)"""


@query(f"""WITH {FRAMES}, c AS (SELECT session, count(*) AS n FROM f GROUP BY 1)
  SELECT session, w AS window_id, w * 30 AS first_i, w * 30 + 299 AS last_i, CAST(300 AS BIGINT) AS n
  FROM (SELECT session, unnest(range(0, (n - 300) // 30 + 1)) AS w FROM c WHERE n >= 300)""")
def count_sliding_windows(spark, sf_dir):
    return series.window_bounds(frames(spark, sf_dir), 300, 30).select("session", "window_id", "first_i", "last_i", "n")


@query(f"""WITH {EVENTS}, g AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY event_id) AS segment FROM e)
  SELECT session, CAST(segment AS BIGINT) AS segment, min(event_id) AS first_event, count(*) AS n, round(sum(value), 4) AS total FROM g GROUP BY 1, 2""")
def segment_resets(spark, sf_dir):
    cut = series.segments(events(spark, sf_dir), F.col("event_type") == "error", order=("event_id",))
    return cut.groupBy("session", "segment").agg(F.min("event_id").alias("first_event"), F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"""WITH {EVENTS}, d AS (SELECT session, t - lag(t) OVER (PARTITION BY session ORDER BY t) AS gap FROM e)
  SELECT session, round(coalesce(1 / quantile_cont(CASE WHEN gap > 0 THEN gap END, 0.5), 0), 6) AS fps FROM d GROUP BY 1""")
def effective_fps(spark, sf_dir):
    return series.effective_fps(events(spark, sf_dir)).withColumn("fps", F.round("fps", 6))


@query(f"""WITH {EVENTS}, d AS (SELECT session, t - lag(t) OVER (PARTITION BY session ORDER BY t) AS gap FROM e),
  l AS (SELECT session, list_sort(list(gap)) AS g FROM d WHERE gap > 0 GROUP BY 1), c AS (SELECT session, count(*) AS n FROM e GROUP BY 1)
  SELECT c.session, round(CASE WHEN n < 10 THEN 30.0e0 ELSE coalesce(1 / g[len(g) // 2 + 1], 30.0e0) END, 6) AS fps FROM c LEFT JOIN l USING (session)""")
def effective_fps_upper(spark, sf_dir):
    return series.effective_fps_upper(events(spark, sf_dir)).withColumn("fps", F.round("fps", 6))


@query(f"""WITH {EVENTS}, s AS (SELECT session, min(t) AS a, max(t) AS b, CAST(round_even((max(t) - min(t)) * 0.25e0, 0) AS BIGINT) AS n FROM e GROUP BY 1),
  g0 AS (SELECT session, a, b, n, unnest(range(0, n + 1)) AS k FROM s), g AS (SELECT session, k, a + CASE WHEN n > 0 THEN (b - a) * k / n ELSE 0 END AS t FROM g0),
  m AS (SELECT g.session, g.k, g.t, p.t AS pt, p.value AS pv FROM g ASOF LEFT JOIN e AS p ON g.session = p.session AND g.t >= p.t),
  o AS (SELECT m.*, q.t AS qt, q.value AS qv FROM m ASOF LEFT JOIN e AS q ON m.session = q.session AND m.t <= q.t)
  SELECT session, k, round(t, 6) AS t, round(coalesce(pv + CASE WHEN qt - pt > 0 THEN (t - pt) / (qt - pt) ELSE 0 END * (qv - pv), pv, qv), 5) AS value FROM o""")
def resample_uniform(spark, sf_dir):
    made = series.resampled(events(spark, sf_dir), ["value"], 0.25)
    return made.select("session", "k", F.round("t", 6).alias("t"), F.round("value", 5).alias("value"))


@query(f"""WITH {FRAMES}, a AS (SELECT session, i, g, row_number() OVER w AS r, count(*) OVER (PARTITION BY session) AS n,
    sum(g) OVER (PARTITION BY session ORDER BY i ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS s,
    first_value(g) OVER w AS fg, last_value(g) OVER (PARTITION BY session ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lg
    FROM f WINDOW w AS (PARTITION BY session ORDER BY i)),
  m AS (SELECT session, i, g, (s + greatest(0, 8 - r) * fg + greatest(0, r + 7 - n) * lg) / 15 AS mean FROM a)
  SELECT session, i, round(mean, 5) AS mean, round(g - mean, 5) + 0e0 AS rest FROM m""")
def moving_average_edge(spark, sf_dir):
    made = series.moving_average(frames(spark, sf_dir), "g", 14, "mean")
    return made.select("session", "i", F.round("mean", 5).alias("mean"), C.zero(F.col("g") - F.col("mean"), 5).alias("rest"))


@query(f"""WITH {FRAMES} SELECT session, i, round(CASE WHEN stddev_pop(g) OVER w > 1e-12 THEN (g - avg(g) OVER w) / stddev_pop(g) OVER w ELSE 0 END, 5) + 0e0 AS z,
  round(r / CASE WHEN abs(avg(r) OVER w) < 1e-12 THEN 1 ELSE avg(r) OVER w END, 6) AS nr FROM f WINDOW w AS (PARTITION BY session)""")
def normalised_channels(spark, sf_dir):
    made = series.mean_normalised(series.standardised(frames(spark, sf_dir), "g", "z"), "r", "nr")
    return made.select("session", "i", C.zero(F.col("z"), 5).alias("z"), F.round("nr", 6).alias("nr"))


@query(f"""WITH {FRAMES} SELECT session, i, round(bg, 4) AS lag0, round(coalesce(lag(bg) OVER w, 0), 4) AS lag1, round(coalesce(lag(bg, 2) OVER w, 0), 4) AS lag2
  FROM f WINDOW w AS (PARTITION BY session ORDER BY i)""")
def lag_matrix(spark, sf_dir):
    made = series.lags(frames(spark, sf_dir), "bg", 3)
    return made.select("session", "i", *(F.round(f"lag{k}", 4).alias(f"lag{k}") for k in range(3)))


@query(f"""WITH {FRAMES} SELECT session, i, max(g) OVER (PARTITION BY session ORDER BY i) AS top FROM f""")
def running_maximum(spark, sf_dir):
    return series.running_max(frames(spark, sf_dir), "g", "top").select("session", "i", "top")


DET = "({0} * ({4} * {8} - {5} * {7}) - {1} * ({3} * {8} - {5} * {6}) + {2} * ({3} * {7} - {4} * {6}))"
M = ["s00", "s01", "s02", "s01", "s11", "s12", "s02", "s12", "s22"]


def cramer(j: int) -> str:
    swapped = [f"t{k // 3}" if k % 3 == j else m for k, m in enumerate(M)]
    return f"{DET.format(*swapped)} / nullif({DET.format(*M)}, 0)"


@query(f"""WITH {FRAMES}, a AS (SELECT *, avg(g) OVER p AS mean, stddev_pop(g) OVER p AS sd, count(*) OVER p AS n,
    (bg - avg(bg) OVER p) / nullif(CASE WHEN stddev_pop(bg) OVER p >= 1e-12 THEN stddev_pop(bg) OVER p ELSE 0 END, 0) AS z FROM f WINDOW p AS (PARTITION BY session)),
  l AS (SELECT *, g - mean AS x, z AS l0, coalesce(lag(z) OVER o, 0) AS l1, coalesce(lag(z, 2) OVER o, 0) AS l2 FROM a WINDOW o AS (PARTITION BY session ORDER BY i)),
  s AS (SELECT session, sum(l0 * l0) AS s00, sum(l0 * l1) AS s01, sum(l0 * l2) AS s02, sum(l1 * l1) AS s11, sum(l1 * l2) AS s12, sum(l2 * l2) AS s22,
    sum(l0 * x) AS t0, sum(l1 * x) AS t1, sum(l2 * x) AS t2 FROM l GROUP BY 1),
  c AS (SELECT session, {", ".join(f"{cramer(j)} AS c{j}" for j in range(3))} FROM s),
  o AS (SELECT l.session, i, g, CASE WHEN greatest(abs(c0), abs(c1), abs(c2)) <= 3 * sd THEN x - c0 * l0 - c1 * l1 - c2 * l2 + mean ELSE g END AS y FROM l JOIN c USING (session))
  SELECT session, i, round(y, 4) AS rectified, round(greatest(0, least(1, 1 - var_pop(y) OVER w / nullif(var_pop(g) OVER w, 0))), 5) + 0e0 AS removed
  FROM o WINDOW w AS (PARTITION BY session)""")
def rectify_background(spark, sf_dir):
    made = pulse.rectified(frames(spark, sf_dir), "g", "bg")
    return made.select("session", "i", F.round("rectified", 4).alias("rectified"), C.zero(F.col("removed"), 5).alias("removed"))


@query(f"""WITH {FRAMES}, m AS (SELECT *, row_number() OVER o AS n, avg(r) OVER w AS mr, avg(g) OVER w AS mg, avg(b) OVER w AS mb, covar_pop(r, r) OVER w AS rr0,
    covar_pop(g, g) OVER w AS gg0, covar_pop(b, b) OVER w AS bb0, covar_pop(r, g) OVER w AS rg0, covar_pop(r, b) OVER w AS rb0, covar_pop(g, b) OVER w AS gb0
    FROM f WINDOW o AS (PARTITION BY session ORDER BY i), w AS (PARTITION BY session ORDER BY i ROWS BETWEEN 47 PRECEDING AND CURRENT ROW)),
  v AS (SELECT *, rr0 / (mr * mr) AS rr, gg0 / (mg * mg) AS gg, bb0 / (mb * mb) AS bb, rg0 / (mr * mg) AS rg, rb0 / (mr * mb) AS rb, gb0 / (mg * mb) AS gb FROM m),
  a AS (SELECT *, sqrt(greatest(0e0, gg + bb - 2 * gb)) AS s1, sqrt(greatest(0e0, 4 * rr + gg + bb - 4 * rg - 4 * rb + 2 * gb)) AS s2 FROM v),
  t AS (SELECT *, CASE WHEN s2 > 1e-12 THEN s1 / nullif(s2, 0) ELSE 0 END AS q FROM a),
  h AS (SELECT *, sqrt(greatest(0e0, 4 * q * q * rr + (1 + q) * (1 + q) * gg + (q - 1) * (q - 1) * bb - 4 * q * (1 + q) * rg - 4 * q * (q - 1) * rb + 2 * (1 + q) * (q - 1) * gb)) AS sd FROM t),
  c AS (SELECT session, i, r, g, b, CASE WHEN n >= 48 THEN -2 * q / mr / CASE WHEN sd > 1e-12 THEN sd ELSE 1 END ELSE 0 END AS fr,
    CASE WHEN n >= 48 THEN (1 + q) / mg / CASE WHEN sd > 1e-12 THEN sd ELSE 1 END ELSE 0 END AS fg, CASE WHEN n >= 48 THEN (q - 1) / mb / CASE WHEN sd > 1e-12 THEN sd ELSE 1 END ELSE 0 END AS fb FROM h)
  SELECT session, i, round(r * sum(fr) OVER x + g * sum(fg) OVER x + b * sum(fb) OVER x, 4) + 0e0 AS pulse
  FROM c WINDOW x AS (PARTITION BY session ORDER BY i ROWS BETWEEN CURRENT ROW AND 47 FOLLOWING)""")
def pos(spark, sf_dir):
    return pulse.pos(frames(spark, sf_dir), FPS).select("session", "i", C.zero(F.col("pulse"), 4).alias("pulse"))


@query(f"""WITH {FRAMES} SELECT session, i, round(-g, 5) + 0e0 AS pulse FROM f""")
def green(spark, sf_dir):
    return pulse.green(frames(spark, sf_dir)).select("session", "i", C.zero(F.col("pulse"), 5).alias("pulse"))


# 64 frames at 30 a second: bins 2 to 8 of 64 lie in 0.7 to 4 Hz
def dft_sql(x: str) -> str:
    return f"""s AS (SELECT session, block, bin, sum({x} * cos(k * bin * {PERIOD} / 64)) AS re, sum({x} * sin(k * bin * {PERIOD} / 64)) AS im
      FROM d, (SELECT unnest(range(2, 9)) AS bin) GROUP BY 1, 2, 3)"""


@query(f"""WITH {BLOCKS}, d AS (SELECT session, block, k, g - avg(g) OVER (PARTITION BY session, block) AS x FROM bl), {dft_sql("x")}
  SELECT d.session, d.block, d.k, round(sum(2 * (re * cos(k * bin * {PERIOD} / 64) + im * sin(k * bin * {PERIOD} / 64))) / 64, 4) + 0e0 AS g
  FROM d JOIN s USING (session, block) GROUP BY 1, 2, 3""")
def spectral_bandpass(spark, sf_dir):
    made = pulse.spectral_bandpass(blocks(spark, sf_dir), ["g"], FPS, BAND, BLOCK, KEYS, "k")
    return made.select(*KEYS, "k", C.zero(F.col("g"), 4).alias("g"))


@query(f"""WITH {BLOCKS}, n0 AS (SELECT session, block, k, r / avg(r) OVER w AS r, g / avg(g) OVER w AS g, b / avg(b) OVER w AS b FROM bl WINDOW w AS (PARTITION BY session, block)),
  xy AS (SELECT session, block, k, 3 * r - 2 * g AS x0, 1.5e0 * r + g - 1.5e0 * b AS y0 FROM n0),
  d AS (SELECT session, block, k, x0 - avg(x0) OVER w AS x, y0 - avg(y0) OVER w AS y FROM xy WINDOW w AS (PARTITION BY session, block)),
  s AS (SELECT session, block, bin, sum(x * cos(k * bin * {PERIOD} / 64)) AS xr, sum(x * sin(k * bin * {PERIOD} / 64)) AS xi,
    sum(y * cos(k * bin * {PERIOD} / 64)) AS yr, sum(y * sin(k * bin * {PERIOD} / 64)) AS yi FROM d, (SELECT unnest(range(2, 9)) AS bin) GROUP BY 1, 2, 3),
  u AS (SELECT d.session, d.block, d.k, sum(2 * (xr * cos(k * bin * {PERIOD} / 64) + xi * sin(k * bin * {PERIOD} / 64))) / 64 AS x,
    sum(2 * (yr * cos(k * bin * {PERIOD} / 64) + yi * sin(k * bin * {PERIOD} / 64))) / 64 AS y FROM d JOIN s USING (session, block) GROUP BY 1, 2, 3)
  SELECT session, block, k, round(x - CASE WHEN stddev_pop(y) OVER w > 1e-12 THEN stddev_pop(x) OVER w / stddev_pop(y) OVER w ELSE 0 END * y, 5) + 0e0 AS pulse
  FROM u WINDOW w AS (PARTITION BY session, block)""")
def chrom_spectral(spark, sf_dir):
    made = pulse.chrom_spectral(blocks(spark, sf_dir), FPS, BAND, BLOCK, KEYS, "k")
    return made.select(*KEYS, "k", C.zero(F.col("pulse"), 5).alias("pulse"))


def periodogram_sql(rows: str, value: str, least: int = 2) -> str:
    """The least power of two of 8 frames a frame; bins from 0.7 to 4 Hz; a block whose weights are all 0 has no power."""
    return f"""d AS (SELECT session, block, k, ({value} - avg({value}) OVER w) * (0.5e0 - 0.5e0 * cos({PERIOD} * k / (count(*) OVER w - 1))) AS x,
      0.5e0 - 0.5e0 * cos({PERIOD} * k / (count(*) OVER w - 1)) AS w, CAST(power(2, ceil(log2(8 * count(*) OVER w - 0.5e0))) AS BIGINT) AS size
      FROM (SELECT * FROM {rows} WHERE n >= {least}) WINDOW w AS (PARTITION BY session, block)),
    db AS (SELECT *, unnest(range(CAST(ceil(0.7e0 * size / 30 - 1e-9) AS BIGINT), CAST(floor(4.0e0 * size / 30 + 1e-9) AS BIGINT) + 1)) AS bin FROM d),
    sp AS (SELECT session, block, bin, bin * 30.0e0 / size AS hz, CASE WHEN sum(w * w) > 0 THEN (power(sum(x * cos((k * bin % size) * {PERIOD} / size)), 2)
      + power(sum(x * sin((k * bin % size) * {PERIOD} / size)), 2)) / (sum(w * w) * 30) ELSE 0 END AS power FROM db GROUP BY session, block, bin, size)"""


PERIODOGRAM, LONG_PERIODOGRAM = periodogram_sql("bl", "g"), periodogram_sql("bl", "g", 8)
DOMINANT = """v AS (SELECT *, lag(power) OVER w AS pb, lead(power) OVER w AS pa, lead(hz) OVER w AS hn,
    row_number() OVER (PARTITION BY session, block ORDER BY power DESC, bin) AS rk FROM sp WINDOW w AS (PARTITION BY session, block ORDER BY bin)),
  t AS (SELECT *, ln(CASE WHEN pb > 0 THEN pb END) AS l, ln(CASE WHEN power > 0 THEN power END) AS m, ln(CASE WHEN pa > 0 THEN pa END) AS u FROM v WHERE rk = 1),
  pk AS (SELECT session, block, greatest(0.7e0, least(4.0e0, CASE WHEN abs(l - 2 * m + u) >= 1e-18
    THEN hz + greatest(-0.5e0, least(0.5e0, 0.5e0 * (l - u) / nullif(l - 2 * m + u, 0))) * (hn - hz) ELSE hz END)) AS peak FROM t),
  g AS (SELECT session, block, peak, sum(CASE WHEN abs(hz - peak) <= 0.1e0 OR abs(hz - 2 * peak) <= 0.2e0 THEN power ELSE 0 END) AS s,
    sum(CASE WHEN abs(hz - peak) <= 0.1e0 OR abs(hz - 2 * peak) <= 0.2e0 THEN 0 ELSE power END) AS n FROM sp JOIN pk USING (session, block) GROUP BY 1, 2, 3),
  o AS (SELECT session, block, peak * 60 AS bpm, CASE WHEN s <= 1e-20 THEN CAST('-inf' AS DOUBLE) WHEN n <= 1e-20 THEN 60e0 ELSE least(60e0, 10 * log10(s / n)) END AS snr_db FROM g)
  SELECT session, block, round(bpm, 4) AS bpm, round(snr_db, 4) + 0e0 AS snr_db,
    CASE WHEN snr_db >= 6 THEN 'alta' WHEN snr_db >= 2 THEN 'média' WHEN snr_db >= 0 THEN 'baixa' ELSE 'descartada' END AS confidence FROM o"""


@query(f"""WITH {BLOCKS}, {PERIODOGRAM} SELECT session, block, bin, round(hz, 6) AS hz, round(power, 4) + 0e0 AS power FROM sp""")
def periodogram(spark, sf_dir):
    made = spectrum.periodogram(blocks(spark, sf_dir), "g", FPS, BAND, KEYS, "k")
    return made.select(*KEYS, "bin", F.round("hz", 6).alias("hz"), C.zero(F.col("power"), 4).alias("power"))


@query(f"""WITH {BLOCKS}, {PERIODOGRAM} SELECT session, block, bin,
  round(CASE WHEN max(power) OVER w > 0 THEN power / max(power) OVER w ELSE 0 END, 6) + 0e0 AS power FROM sp WINDOW w AS (PARTITION BY session, block)""")
def spectrum_normalised(spark, sf_dir):
    made = spectrum.normalised(spectrum.periodogram(blocks(spark, sf_dir), "g", FPS, BAND, KEYS, "k"), KEYS)
    return made.select(*KEYS, "bin", C.zero(F.col("power"), 6).alias("power"))


@query(f"""WITH {BLOCKS}, {LONG_PERIODOGRAM}, {DOMINANT}""")
def dominant_frequency(spark, sf_dir):
    made = spectrum.dominant(spectrum.periodogram(long_blocks(spark, sf_dir), "g", FPS, BAND, KEYS, "k"), BAND, KEYS)
    return made.select(*KEYS, F.round("bpm", 4).alias("bpm"), C.zero(F.col("snr_db"), 4).alias("snr_db"), "confidence")


# segments of max(8, n / 3) frames that overlap by half, padded to a power of two of 8 times their length
@query(f"""WITH {BLOCKS}, z AS (SELECT *, greatest(8, n // 3) AS len FROM bl WHERE n >= 8), y AS (SELECT *, len - len // 2 AS hop, CAST(power(2, ceil(log2(8 * len - 0.5e0))) AS BIGINT) AS size FROM z),
  sg0 AS (SELECT *, unnest(range(0, (n - len) // hop + 1)) AS s FROM y), sg AS (SELECT *, k - s * hop AS j FROM sg0 WHERE k - s * hop BETWEEN 0 AND len - 1),
  d AS (SELECT session, block, s, j, size, (g - avg(g) OVER (PARTITION BY session, block, s)) * (0.5e0 - 0.5e0 * cos({PERIOD} * j / len)) AS x, 0.5e0 - 0.5e0 * cos({PERIOD} * j / len) AS w FROM sg),
  db AS (SELECT *, unnest(range(CAST(ceil(0.7e0 * size / 30 - 1e-9) AS BIGINT), CAST(floor(4.0e0 * size / 30 + 1e-9) AS BIGINT) + 1)) AS bin FROM d),
  pw AS (SELECT session, block, s, bin, 2 * (power(sum(x * cos((j * bin % size) * {PERIOD} / size)), 2) + power(sum(x * sin((j * bin % size) * {PERIOD} / size)), 2)) / (sum(w * w) * 30) AS power
    FROM db GROUP BY 1, 2, 3, 4)
  SELECT session, block, bin, round(avg(power), 4) + 0e0 AS power FROM pw GROUP BY 1, 2, 3""")
def welch(spark, sf_dir):
    made = spectrum.welch(blocks(spark, sf_dir), "g", FPS, BAND, KEYS, "k")
    return made.select(*KEYS, "bin", C.zero(F.col("power"), 4).alias("power"))


@query(f"""WITH {EVENTS}, l AS (SELECT session, list(event_id ORDER BY event_id) AS o, list(value ORDER BY event_id) AS v FROM e GROUP BY 1),
  u AS (SELECT session, o, v, unnest(range(1, len(v) + 1)) AS k FROM l)
  SELECT session, o[k] AS event_id, round(list_reduce(v[1:k], lambda a, x: a + (x - a) / 3), 5) AS shown FROM u""")
def ema_smooth(spark, sf_dir):
    made = series.smoothed(events(spark, sf_dir), "value", 1 / 3, "shown", order="event_id")
    return made.select("session", "event_id", F.round("shown", 5).alias("shown"))


def sections_sql(name: str, source: str, x: str) -> str:
    """A table of a band-pass's outputs, value by value: each step knows the states that the one before left."""
    nums, dens = bandpass_design(BAND.low_hz / (FPS / 2), BAND.high_hz / (FPS / 2), 4)
    states = [f"{s}{k}" for k in range(len(nums)) for s in "uw"]
    inner = f"SELECT o.session, o.p, o.{x} AS v0, {', '.join(f'r.{s}' for s in states)} FROM {name} AS r JOIN {source} AS o ON o.session = r.session AND o.p = r.p + 1"
    for k, b in enumerate(nums):
        inner = f"SELECT *, {b[0]:.17e} * v{k} + u{k} AS v{k + 1} FROM ({inner})"
    after = [f"{b[1]:.17e} * v{k} - ({a[1]:.17e}) * v{k + 1} + w{k}, {b[2]:.17e} * v{k} - ({a[2]:.17e}) * v{k + 1}" for k, (b, a) in enumerate(zip(nums, dens, strict=True))]
    # zeros at 1 let nothing of a constant through, so only the first section's states differ from 0 at the start
    start = ", ".join([f"-({nums[0][0]:.17e}) * {x}", f"{nums[0][2]:.17e} * {x}", *["0e0"] * (len(states) - 2)])
    return f"""{name}(session, p, y, {', '.join(states)}) AS (SELECT session, p - 1, 0e0, {start} FROM (SELECT *, min(p) OVER (PARTITION BY session) AS least FROM {source}) WHERE p = least
      UNION ALL SELECT session, p, v{len(nums)}, {', '.join(after)} FROM ({inner}))"""


@query(f"""WITH RECURSIVE {FRAMES}, n AS (SELECT session, i, g, count(*) OVER (PARTITION BY session) AS n, first_value(g) OVER (PARTITION BY session ORDER BY i) AS head,
    first_value(g) OVER (PARTITION BY session ORDER BY i DESC) AS tail FROM f),
  x AS (SELECT session, i AS p, g AS v, n FROM n WHERE n > 27 UNION ALL SELECT session, -i, 2 * head - g, n FROM n WHERE n > 27 AND i BETWEEN 1 AND 27
    UNION ALL SELECT session, 2 * (n - 1) - i, 2 * tail - g, n FROM n WHERE n > 27 AND i BETWEEN n - 28 AND n - 2),
  {sections_sql("forth", "x", "v")}, y AS (SELECT x.session, n + 26 - x.p AS p, forth.y AS v, n FROM forth JOIN x USING (session, p)), {sections_sql("back", "y", "v")},
  z AS (SELECT back.session, n + 26 - back.p AS i, back.y FROM back JOIN y USING (session, p))
  SELECT session, i, round(z.y, 4) + 0e0 AS pulse FROM n LEFT JOIN z USING (session, i)""")
def recording_bandpass(spark, sf_dir):
    """Whole recordings through the recursive band-pass, forwards and backwards, whatever their length."""
    made = scan.bandpassed(frames(spark, sf_dir), "g", FPS, BAND, "pulse")
    return made.select("session", "i", C.zero(F.col("pulse"), 4).alias("pulse"))


@query(f"""WITH RECURSIVE {FRAMES}, n AS (SELECT session, i, g, count(*) OVER (PARTITION BY session) AS n FROM f),
  lu(session, i, n, d1, d2, e1, f1, f2, z1, z2) AS (SELECT DISTINCT session, CAST(-1 AS BIGINT), n, 0e0, 0e0, 0e0, 0e0, 0e0, 0e0, 0e0 FROM n WHERE n >= 4
    UNION ALL SELECT session, i, n, d, d1, CASE WHEN i <= n - 2 THEN (-2e4 * (CASE WHEN i <= n - 3 THEN 1 ELSE 0 END + CASE WHEN i BETWEEN 1 AND n - 2 THEN 1 ELSE 0 END) - d1 * e1 * f1) / d ELSE 0 END,
      CASE WHEN i <= n - 3 THEN 1e4 / d ELSE 0 END, f1, g - e1 * z1 - f2 * z2, z1
    FROM (SELECT n.*, l.* EXCLUDE (session, i, n), 1 + 1e4 * (CASE WHEN n.i <= n.n - 3 THEN 1 ELSE 0 END + CASE WHEN n.i BETWEEN 1 AND n.n - 2 THEN 4 ELSE 0 END + CASE WHEN n.i >= 2 THEN 1 ELSE 0 END)
      - d1 * e1 * e1 - d2 * f2 * f2 AS d FROM lu AS l JOIN n ON n.session = l.session AND n.i = l.i + 1)),
  lm AS MATERIALIZED (SELECT * FROM lu),
  up(session, i, y1, y2) AS (SELECT DISTINCT session, n, 0e0, 0e0 FROM n WHERE n >= 4
    UNION ALL SELECT l.session, l.i, l.z1 / l.d1 - l.e1 * y1 - l.f1 * y2, y1 FROM up JOIN lm AS l ON l.session = up.session AND l.i = up.i - 1 AND l.i >= 0)
  SELECT n.session, n.i, round(CASE WHEN n >= 4 THEN g - y1 ELSE g - avg(g) OVER (PARTITION BY n.session) END, 4) + 0e0 AS rest FROM n LEFT JOIN up ON up.session = n.session AND up.i = n.i""")
def recording_detrend(spark, sf_dir):
    """Whole recordings less their smooth trend, solved run by run."""
    return scan.detrended(frames(spark, sf_dir), "g", "rest").select("session", "i", C.zero(F.col("rest"), 4).alias("rest"))


@query(f"""WITH {EVENTS}, {ESTIMATES} SELECT session, count(*) AS windows, CAST(sum(CASE WHEN confidence <> 'descartada' THEN 1 ELSE 0 END) AS BIGINT) AS usable,
  round(quantile_cont(CASE WHEN confidence <> 'descartada' THEN value END, 0.5), 5) AS median_bpm,
  round(CASE WHEN count(CASE WHEN confidence <> 'descartada' THEN value END) >= 2 THEN stddev_pop(CASE WHEN confidence <> 'descartada' THEN value END) END, 5) AS bpm_sd,
  round(quantile_cont(snr_db, 0.5), 6) + 0e0 AS median_snr_db FROM z GROUP BY 1""")
def session_report(spark, sf_dir):
    made = reports.session_report(estimates(spark, sf_dir))
    return made.select("session", "windows", "usable", *(C.zero(F.col(c), 5).alias(c) for c in ("median_bpm", "bpm_sd")), C.zero(F.col("median_snr_db"), 6).alias("median_snr_db"))


@query(f"""WITH {EVENTS}, {ESTIMATES}, c AS (SELECT session, confidence, count(*) AS n, min(event_id) AS first FROM z GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY n DESC, first) AS k FROM c) SELECT session, confidence FROM r WHERE k = 1""")
def predominant_confidence(spark, sf_dir):
    return reports.predominant(estimates(spark, sf_dir), "confidence", "event_id")


@query(f"""WITH {EVENTS}, {ESTIMATES} SELECT event_id, confidence, confidence <> 'descartada' AS usable FROM z""")
def confidence_bucket(spark, sf_dir):
    return estimates(spark, sf_dir).select("event_id", "confidence", C.usable(F.col("confidence")).alias("usable"))


GAPS = """d AS (SELECT session, event_id, (t - lag(t) OVER (PARTITION BY session ORDER BY t)) * 3.6e0 AS gap FROM e), g AS (SELECT * FROM d WHERE gap IS NOT NULL)"""


def gaps(spark, sf_dir):
    """Kiloseconds between the events of a user."""
    return series.intervals(events(spark, sf_dir), "t", 3.6).select("session", "event_id", "gap")


@query(f"""WITH {EVENTS}, {GAPS}, m AS (SELECT *, quantile_cont(gap, 0.5) OVER (PARTITION BY session) AS mid, count(*) OVER (PARTITION BY session) AS n FROM g)
  SELECT session, event_id, round(gap, 5) AS gap FROM m WHERE n < 3 OR mid <= 0 OR abs(gap - mid) / mid <= 0.3e0""")
def rr_filter(spark, sf_dir):
    return series.plausible(gaps(spark, sf_dir)).select("session", "event_id", F.round("gap", 5).alias("gap"))


@query(f"""WITH {EVENTS}, {GAPS}, s AS (SELECT *, gap - lag(gap) OVER (PARTITION BY session ORDER BY event_id) AS step FROM g)
  SELECT session, count(*) AS beats, round(avg(gap), 4) AS mean_gap, round(stddev_samp(gap), 4) AS sdnn, round(sqrt(avg(step * step)), 4) AS rmssd,
  round(avg(CASE WHEN step IS NOT NULL THEN CASE WHEN abs(step) > 5 THEN 1e0 ELSE 0e0 END END), 6) AS pnn FROM s GROUP BY 1 HAVING count(*) >= 2""")
def hrv(spark, sf_dir):
    made = series.variability(gaps(spark, sf_dir), limit=5.0, order="event_id")
    return made.select("session", "beats", F.round("mean", 4).alias("mean_gap"), F.round("sdnn", 4).alias("sdnn"), F.round("rmssd", 4).alias("rmssd"), F.round("pnn", 6).alias("pnn"))


@query(f"""WITH {PIXELS}, bd AS (SELECT frame, region, quantile_cont(g, 0.05) AS lo, quantile_cont(g, 0.95) AS hi FROM px GROUP BY 1, 2),
  n AS (SELECT px.*, g BETWEEN lo AND hi AS inside FROM px JOIN bd USING (frame, region)),
  k AS (SELECT *, sum(CASE WHEN inside THEN 1 ELSE 0 END) OVER (PARTITION BY frame, region) AS remaining FROM n)
  SELECT frame, region, count(*) AS n, round(avg(g), 5) AS mean_g FROM k WHERE inside OR remaining < 50 GROUP BY 1, 2""")
def percentile_trim(spark, sf_dir):
    kept = regions.trimmed(pixels(spark, sf_dir), ["frame", "region"])
    return kept.groupBy("frame", "region").agg(F.count("*").alias("n"), F.round(F.avg("g"), 5).alias("mean_g"))


@query(f"""WITH {PIXELS} SELECT frame, count(*) AS pixels, CAST(sum(CASE WHEN skin THEN 1 ELSE 0 END) AS BIGINT) AS skin, round(avg(CASE WHEN skin THEN 1e0 ELSE 0e0 END), 6) AS share FROM px GROUP BY 1""")
def skin_mask(spark, sf_dir):
    return regions.skin_share(pixels(spark, sf_dir), ["frame"]).withColumn("share", F.round("share", 6))


@query(f"""WITH {PIXELS}, x AS (SELECT frame, region, sum(r) AS r, sum(g) AS g, sum(b) AS b, count(*) AS n FROM px GROUP BY 1, 2 HAVING count(*) >= 50)
  SELECT frame, round(CAST(sum(r) AS DOUBLE) / sum(n), 5) AS r, round(CAST(sum(g) AS DOUBLE) / sum(n), 5) AS g, round(CAST(sum(b) AS DOUBLE) / sum(n), 5) AS b, CAST(sum(n) AS BIGINT) AS pixels FROM x GROUP BY 1 HAVING sum(n) >= 50""")
def spatial_mean(spark, sf_dir):
    return regions.spatial_means(pixels(spark, sf_dir), ["frame"]).select("frame", *(F.round(c, 5).alias(c) for c in "rgb"), "pixels")


@query(f"""WITH {PIXELS}, x AS (SELECT frame, region, avg(r) AS r, avg(g) AS g, avg(b) AS b, count(*) AS n FROM px WHERE skin GROUP BY 1, 2 HAVING count(*) >= 10)
  SELECT frame, round(sum(r * n) / sum(n), 5) AS r, round(sum(g * n) / sum(n), 5) AS g, round(sum(b * n) / sum(n), 5) AS b, CAST(sum(n) AS BIGINT) AS pixels FROM x GROUP BY 1""")
def weighted_region_mean(spark, sf_dir):
    return regions.weighted_means(pixels(spark, sf_dir), ["frame"], least=10).select("frame", *(F.round(c, 5).alias(c) for c in "rgb"), "pixels")


@query(f"""WITH {PIXELS} SELECT frame, {", ".join(f"round(CASE WHEN count(*) FILTER (NOT skin) >= 200 THEN avg({c}) FILTER (NOT skin) END, 5) AS bg_{c}" for c in "rgb")},
  count(*) FILTER (NOT skin) AS pixels FROM px GROUP BY 1""")
def background_mean(spark, sf_dir):
    made = regions.background_means(pixels(spark, sf_dir), ["frame"])
    return made.select("frame", *(F.round(f"bg_{c}", 5).alias(f"bg_{c}") for c in "rgb"), F.col("pixels").cast("long").alias("pixels"))


def cross_sql(name: str, source: str, pick: str) -> str:
    both = "least" if pick == "min" else "greatest"
    return f"""{name} AS (SELECT frame, y, x, {both}({pick}(v) OVER (PARTITION BY frame, y ORDER BY x RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING),
      {pick}(v) OVER (PARTITION BY frame, x ORDER BY y RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)) AS v FROM {source})"""


@query(f"""WITH {PIXELS}, m0 AS (SELECT frame, CAST(b % 12 AS INTEGER) AS y, CAST(r % 12 AS INTEGER) AS x, max(CASE WHEN skin THEN 1 ELSE 0 END) AS v FROM px GROUP BY 1, 2, 3),
  {cross_sql("m1", "m0", "min")}, {cross_sql("m2", "m1", "max")}, {cross_sql("m3", "m2", "max")}, {cross_sql("m4", "m3", "min")}
  SELECT frame, y, x, CAST(v AS INTEGER) AS "on" FROM m4""")
def skin_morphology(spark, sf_dir):
    rows = pixels(spark, sf_dir).withColumn("on", C.is_skin(F.col("r"), F.col("g"), F.col("b")).cast("int"))
    mask = rows.groupBy("frame", (F.col("b") % 12).alias("y"), (F.col("r") % 12).alias("x")).agg(F.max("on").alias("on"))
    return regions.opened_and_closed(mask, ["frame"])


@query(f"""WITH {PIXELS}, m AS (SELECT region, CAST(frame[1:4] AS INTEGER) * 12 + CAST(frame[6:7] AS INTEGER) AS fr, r, g FROM px),
  e AS (SELECT *, CAST(floor(fr / 30) AS BIGINT) AS epoch FROM m), w AS (SELECT *, min(fr) OVER (PARTITION BY region, epoch) AS first FROM e),
  c AS (SELECT DISTINCT region, epoch, r FROM w WHERE fr = first AND g > 110)
  SELECT region, epoch, count(*) AS n, CAST(sum(g) AS BIGINT) AS total FROM w JOIN c USING (region, epoch, r) GROUP BY 1, 2""")
def frozen_selection(spark, sf_dir):
    month = F.substring("frame", 1, 4).cast("int") * 12 + F.substring("frame", 6, 2).cast("int")
    rows = pixels(spark, sf_dir).withColumn("fr", month)
    kept = regions.frozen_choice(rows, F.col("g") > 110, ["r"], ["region"], "fr", 30)
    return kept.groupBy("region", "epoch").agg(F.count("*").alias("n"), F.sum("g").alias("total"))


@query(f"""WITH {PIXELS}, m AS (SELECT region, CAST(frame[1:4] AS INTEGER) * 12 + CAST(frame[6:7] AS INTEGER) AS fr, r, g FROM px),
  f AS (SELECT DISTINCT region, fr, 4 + fr // 7 % 3 AS w FROM m),
  sh AS (SELECT region, fr, w, CASE WHEN w IS DISTINCT FROM lag(w) OVER o OR fr % 30 = 0 THEN 1 ELSE 0 END AS begins FROM f WINDOW o AS (PARTITION BY region ORDER BY fr)),
  e AS (SELECT region, fr, CAST(sum(begins) OVER (PARTITION BY region ORDER BY fr) AS BIGINT) AS epoch FROM sh),
  n AS (SELECT m.*, epoch, min(fr) OVER (PARTITION BY region, epoch) AS first FROM m JOIN e USING (region, fr)),
  c AS (SELECT DISTINCT region, epoch, r FROM n WHERE fr = first AND g > 110),
  k AS (SELECT region, epoch, r FROM c QUALIFY count(*) OVER (PARTITION BY region, epoch) >= 10)
  SELECT region, epoch, min(fr) AS first, count(*) AS n, CAST(sum(g) AS BIGINT) AS total FROM n JOIN k USING (region, epoch, r) GROUP BY 1, 2""")
def frozen_epochs(spark, sf_dir):
    """Pixels frozen from where a region's shape changes, or for 30 months; shapes of regions last seven months."""
    month = F.substring("frame", 1, 4).cast("int") * 12 + F.substring("frame", 6, 2).cast("int")
    rows = pixels(spark, sf_dir).withColumn("fr", month).withColumn("width", 4 + F.floor(F.col("fr") / 7) % 3)
    kept = regions.frozen_by_shape(rows, F.col("g") > 110, "r", ["width"], ["region"], "fr", 30, 10)
    return kept.groupBy("region", "epoch").agg(F.min("fr").alias("first"), F.count("*").alias("n"), F.sum("g").alias("total"))


@query(f"""WITH {PIXELS} SELECT frame, count(*) FILTER (r > 60 AND r > 1.2e0 * g AND r > 1.2e0 * b) AS like_finger, count(*) FILTER (r > 60 AND r > 1.6e0 * g AND r > 1.6e0 * b) AS finger FROM px GROUP BY 1""")
def finger_frames(spark, sf_dir):
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    like = (r > 60) & (r > 1.2 * g) & (r > 1.2 * b)
    return pixels(spark, sf_dir).groupBy("frame").agg(F.count(F.when(like, 1)).alias("like_finger"), F.count(F.when(C.is_finger(r, g, b), 1)).alias("finger"))


def parts_sql(x0, y0, x1, y1) -> str:
    return f"[round_even(x + {x0}e0 * w, 0), round_even(y + {y0}e0 * h, 0), round_even({x1 - x0}e0 * w, 0), round_even({y1 - y0}e0 * h, 0)]"


@query(f"""WITH {BOXES}, s AS (SELECT *, CAST(round_even(w * 1.35e0, 0) AS INTEGER) AS sw, CAST(round_even(h * 1.35e0, 0) AS INTEGER) AS sh FROM q),
  c AS (SELECT *, least(greatest(x, 0), 220) AS cx0, least(greatest(y, 0), 180) AS cy0, least(greatest(x + w, 0), 220) AS cx1, least(greatest(y + h, 0), 180) AS cy1,
    greatest(0, least(x + w, 160) - greatest(x, 100)) AS ow, greatest(0, least(y + h, 140) - greatest(y, 80)) AS oh FROM s)
  SELECT i, CAST(w AS BIGINT) * h AS area, CAST(round_even(x + w / 2 - sw / 2, 0) AS INTEGER) AS scaled_x, CAST(round_even(y + h / 2 - sh / 2, 0) AS INTEGER) AS scaled_y, sw AS scaled_w, sh AS scaled_h,
    greatest(0, cx1 - cx0) * greatest(0, cy1 - cy0) AS clipped, CAST(round_even(x + (100 - x) * 0.25e0, 0) AS INTEGER) AS blended_x,
    round(CAST(ow AS DOUBLE) * oh / (CAST(w AS BIGINT) * h + 3600 - CAST(ow AS DOUBLE) * oh), 6) + 0e0 AS overlap FROM c""")
def rect_ops(spark, sf_dir):
    box, other = C.rect(F.col("x"), F.col("y"), F.col("w"), F.col("h")), C.rect(F.lit(100), F.lit(80), F.lit(60), F.lit(60))
    scaled, cut, blend = C.scale_rect(box, 1.35), C.clip_rect(box, 220, 180), C.blend_rect(box, other, 0.25)
    return boxes(spark, sf_dir).select(
        "i", C.area(box).alias("area"), *(scaled[n].alias(f"scaled_{n}") for n in "xywh"), (cut["w"] * cut["h"]).alias("clipped"), blend["x"].alias("blended_x"), C.zero(C.overlap(box, other)).alias("overlap")
    )


@query(f"""WITH {BOXES}, p AS (SELECT i, unnest([0, 1, 2]) AS region, unnest([{", ".join(parts_sql(*f) for f in regions.REGION_SETS["testa_e_bochechas"])}]) AS v FROM q)
  SELECT i, CAST(region AS INTEGER) AS region, CAST(v[1] AS INTEGER) AS x, CAST(v[2] AS INTEGER) AS y, CAST(v[3] AS INTEGER) AS w, CAST(v[4] AS INTEGER) AS h FROM p""")
def roi_expand(spark, sf_dir):
    rows = boxes(spark, sf_dir).select("i", C.rect(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("box"))
    return regions.regions_of(rows, "testa_e_bochechas").select("i", "region", "rect.*")


def clipped_sql(x0: str, y0: str, x1: str, y1: str) -> str:
    """Corners of a rounded rectangle cut to an image of 400 by 300."""
    x, y, w, h = (f"round_even({v}, 0)" for v in (x0, y0, f"({x1}) - ({x0})", f"({y1}) - ({y0})"))
    return f"[least(greatest({x}, 0), 400), least(greatest({y}, 0), 300), least(greatest({x} + greatest({w}, 0), 0), 400), least(greatest({y} + greatest({h}, 0), 0), 300)]"


EYES = (("(lx + rx) / 2 - 0.55e0 * d", "(ly + ry) / 2 - d", "(lx + rx) / 2 + 0.55e0 * d", "(ly + ry) / 2 - 0.5e0 * d"), ("lx - 0.3e0 * d", "(ly + ry) / 2 + 0.38e0 * d", "lx + 0.22e0 * d", "(ly + ry) / 2 + 0.95e0 * d"),
  ("rx - 0.22e0 * d", "(ly + ry) / 2 + 0.38e0 * d", "rx + 0.3e0 * d", "(ly + ry) / 2 + 0.95e0 * d"))


def fraction_sql(f) -> str:
    x, y, w, h = f"round_even(x + {f[0]}e0 * w, 0)", f"round_even(y + {f[1]}e0 * h, 0)", f"round_even({f[2] - f[0]}e0 * w, 0)", f"round_even({f[3] - f[1]}e0 * h, 0)"
    return f"[least(greatest({x}, 0), 400), least(greatest({y}, 0), 300), least(greatest({x} + {w}, 0), 400), least(greatest({y} + {h}, 0), 300)]"


@query(f"""WITH {BOXES}, o AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY i) - 1 AS f, x + 0.3e0 * w AS lx, y + 0.4e0 * h AS ly, x + (0.3e0 + i % 60 / 100e0) * w AS rx, y + 0.4e0 * h + (i % 7 - 3) AS ry FROM q),
  e AS (SELECT *, sqrt((rx - lx) * (rx - lx) + (ry - ly) * (ry - ly)) AS d FROM o),
  k AS (SELECT *, i % 4 <> 0 AND rx > lx AND d / w BETWEEN 0.22e0 AND 0.75e0 AND abs(ry - ly) <= 0.35e0 * d AS ok FROM e),
  b AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY session ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k),
  l AS (SELECT session, i, f, x, y, w, h, last_value(CASE WHEN ok AND (f % 3 = 0 OR before = 0) THEN [lx, ly, rx, ry, d] END IGNORE NULLS) OVER (PARTITION BY session ORDER BY f) AS held FROM b),
  v AS (SELECT *, held[1] AS lx, held[2] AS ly, held[3] AS rx, held[4] AS ry, held[5] AS d FROM l),
  a AS (SELECT *, list_filter([{", ".join(clipped_sql(*c) for c in EYES)}], lambda r: r[3] > r[1] AND r[4] > r[2]) AS eyes, [{", ".join(fraction_sql(f) for f in regions.REGION_SETS["testa_e_bochechas"])}] AS parts FROM v),
  c AS (SELECT i, held IS NOT NULL AND len(eyes) = 3 AS anchored, CASE WHEN held IS NOT NULL AND len(eyes) = 3 THEN eyes ELSE parts END AS rects FROM a),
  u AS (SELECT i, anchored, unnest(rects) AS r, unnest([0, 1, 2]) AS region FROM c)
  SELECT i, anchored, CAST(region AS INTEGER) AS region, CAST(r[1] AS INTEGER) AS x, CAST(r[2] AS INTEGER) AS y, CAST(r[3] - r[1] AS INTEGER) AS w, CAST(r[4] - r[2] AS INTEGER) AS h FROM u""")
def anchored_regions(spark, sf_dir):
    """Forehead and cheeks of every box, by eyes looked for at every third frame of a session and held between."""
    i, x, y, w, h = (F.col(c) for c in "ixywh")
    left = F.struct((x + 0.3 * w).alias("x"), (y + 0.4 * h).alias("y"))
    right = F.struct((x + (0.3 + i % 60 / 100.0) * w).alias("x"), (y + 0.4 * h + (i % 7 - 3)).alias("y"))
    rows = boxes(spark, sf_dir).withColumn("f", F.row_number().over(Window.partitionBy("session").orderBy("i")) - 1)
    rows = rows.select("session", "i", "f", C.rect(x, y, w, h).alias("box"), F.when(i % 4 != 0, left).alias("left"), right.alias("right"))
    return regions.anchored(rows, 400, 300, order="f", every=3).select("i", "anchored", "region", "rect.*")


@query(f"""WITH {BOXES}, s AS (SELECT *, CAST(round_even(w * 1.35e0, 0) AS INTEGER) AS sw, CAST(round_even(h * 1.35e0, 0) AS INTEGER) AS sh FROM q),
  g AS (SELECT i, CAST(round_even(x + w / 2 - sw / 2, 0) AS INTEGER) AS gx, sw FROM s),
  t AS (SELECT i, greatest(gx, 0) AS x0, least(gx + sw, 320) AS x1 FROM g)
  SELECT i, u.x AS strip_x FROM t, (SELECT unnest([0, 276]) AS x) u WHERE least(u.x + 44, x1) - greatest(u.x, x0) <= 0""")
def iou_antijoin(spark, sf_dir):
    face = C.rect(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    return boxes(spark, sf_dir).select("i", F.explode(regions.background_strips(face, 320, 240)).alias("s")).select("i", F.col("s.x").alias("strip_x"))


@query(f"""WITH {BOXES}, c AS (SELECT session, i, x + w / 2 AS cx, y + h / 2 AS cy FROM q),
  m AS (SELECT *, sqrt(power(cx - lag(cx) OVER w, 2) + power(cy - lag(cy) OVER w, 2)) AS move FROM c WINDOW w AS (PARTITION BY session ORDER BY i))
  SELECT session, round(coalesce(quantile_cont(move, 0.95), 0), 5) AS jitter, round(sqrt(var_pop(cx) + var_pop(cy)), 5) AS drift FROM m GROUP BY 1""")
def box_jitter(spark, sf_dir):
    made = regions.box_jitter(boxes(spark, sf_dir), ["session"], ["i"])
    return made.select("session", F.round("jitter", 5).alias("jitter"), F.round("drift", 5).alias("drift"))


@query(f"""WITH {BOXES}, r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY w * h DESC, i) AS k FROM q),
  t AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY x, i) AS place FROM r WHERE k <= 2) SELECT session, CAST(place AS INTEGER) AS place, i, x, k = 1 AS largest FROM t""")
def largest_boxes(spark, sf_dir):
    return regions.largest(boxes(spark, sf_dir)).select("session", "place", "i", "x", "largest")


@query(f"""WITH {EVENTS}, {ESTIMATES}, r AS (SELECT session % 7 AS scenario, CASE WHEN event_type <> 'error' THEN abs(value - 50) END AS err, snr_db FROM z)
  SELECT scenario, count(*) AS total, count(*) FILTER (err IS NULL) AS failures, round(avg(err), 5) AS mae, round(max(err), 5) AS max_error, round(sqrt(avg(err * err)), 5) AS rmse,
  round(avg(snr_db), 5) + 0e0 AS mean_snr_db, round(CAST(count(*) FILTER (err <= 3) AS DOUBLE) / count(*), 6) AS hit_rate FROM r GROUP BY 1""")
def benchmark_metrics(spark, sf_dir):
    rows = estimates(spark, sf_dir).select((F.col("session") % 7).alias("scenario"), F.when(F.col("event_type") != "error", F.abs(F.col("value") - 50)).alias("error"), "snr_db")
    made = reports.accuracy(rows, ["scenario"])
    return made.select("scenario", "total", "failures", *(C.zero(F.col(c), 5).alias(c) for c in ("mae", "max_error", "rmse", "mean_snr_db")), F.round("hit_rate", 6).alias("hit_rate"))


@query(f"""WITH {EVENTS} SELECT session % 7 AS scenario, {", ".join(f"round(avg(abs(value - 50)) FILTER (event_type = '{a}'), 5) AS {a}" for a in EVENT_TYPES)} FROM e GROUP BY 1""")
def benchmark_pivot(spark, sf_dir):
    rows = events(spark, sf_dir).select((F.col("session") % 7).alias("scenario"), "event_type", F.abs(F.col("value") - 50).alias("error"))
    return reports.error_pivot(rows, "scenario", "event_type", EVENT_TYPES).select("scenario", *(F.round(c, 5).alias(c) for c in EVENT_TYPES))


RANKING = f"""{EVENTS}, {ESTIMATES}, c AS (SELECT event_type, session % 5 AS variant, quantile_cont(value, 0.5) AS m, stddev_pop(value) AS d, quantile_cont(snr_db, 0.5) AS s, count(*) AS n FROM z GROUP BY 1, 2),
  l AS (SELECT greatest(5, floor(0.4e0 * max(n))) AS least FROM c), r AS (SELECT c.*, n < least AS few, row_number() OVER (ORDER BY n < least, d, s DESC, event_type, variant) AS k FROM c, l)"""


def ranking(spark, sf_dir, show):
    return reports.diagnostic_ranking(estimates(spark, sf_dir).withColumn("variant", F.col("session") % 5), ["event_type", "variant"], show)


@query(f"""WITH {RANKING} SELECT event_type, variant, round(m, 5) AS median_bpm, round(d, 5) AS dispersion, round(s, 6) + 0e0 AS median_snr_db, n AS windows, few FROM r WHERE k <= 14""")
def diagnostic_rank(spark, sf_dir):
    made = ranking(spark, sf_dir, 14)
    return made.select("event_type", "variant", *(C.zero(F.col(c), 5).alias(c) for c in ("median_bpm", "dispersion")), C.zero(F.col("median_snr_db"), 6).alias("median_snr_db"), "windows", "few")


@query(f"""WITH {RANKING} SELECT count(*) AS configurations, round(quantile_cont(m, 0.75) - quantile_cont(m, 0.25), 5) AS iqr,
  count(*) >= 4 AND quantile_cont(m, 0.75) - quantile_cont(m, 0.25) < 6 AS agree FROM r WHERE k <= 8""")
def iqr_agreement(spark, sf_dir):
    return reports.agreement(ranking(spark, sf_dir, 8)).withColumn("iqr", F.round("iqr", 5))


@query(f"""WITH {FRAMES}, k0 AS (SELECT session, i // 8 AS block, CASE WHEN bg > 40 THEN bg END AS bg FROM f)
  SELECT session, block, count(bg) = count(*) AS complete, round(CASE WHEN count(bg) = count(*) THEN avg(bg) END, 5) AS mean_bg FROM k0 GROUP BY 1, 2""")
def completeness(spark, sf_dir):
    rows = frames(spark, sf_dir).select("session", F.floor(F.col("i") / 8).alias("block"), F.when(F.col("bg") > 40, F.col("bg")).alias("bg"))
    return series.completeness(rows, "bg", ["session", "block"]).select("session", "block", "complete", F.round("mean", 5).alias("mean_bg"))


@query(f"""WITH {PIXELS}, c AS (SELECT frame, region, count(*) AS n FROM px GROUP BY 1, 2)
  SELECT region, quantile_cont(n, 0.5) AS median_pixels, round(100 * stddev_pop(n) / avg(n), 5) AS variation FROM c GROUP BY 1""")
def pixel_variation(spark, sf_dir):
    return regions.pixel_variation(pixels(spark, sf_dir)).select("region", "median_pixels", F.round("variation", 5).alias("variation"))


@query(f"""WITH {EVENTS} SELECT session, round(avg(CASE WHEN event_type <> 'error' THEN 1e0 ELSE 0e0 END), 6) AS detection_rate FROM e GROUP BY 1""")
def detection_rate(spark, sf_dir):
    return reports.detection_rate(events(spark, sf_dir).withColumn("face", F.col("event_type") != "error")).withColumn("detection_rate", F.round("detection_rate", 6))


@query(f"""WITH {EVENTS} SELECT session, event_id, count(*) OVER w AS retained, round(avg(value) OVER w, 5) AS mean FROM e
  WINDOW w AS (PARTITION BY session ORDER BY us RANGE BETWEEN 117000000000 PRECEDING AND CURRENT ROW)""")
def time_retention(spark, sf_dir):
    made = series.time_window(events(spark, sf_dir), 117_000_000_000, {"retained": F.count("*"), "mean": F.avg("value")})  # 1.3 times 25 hours
    return made.select("session", "event_id", "retained", F.round("mean", 5).alias("mean"))


@query(f"""WITH RECURSIVE {EVENTS}, k0 AS (SELECT session, t, greatest(count(*) OVER w, least(2, rank() OVER o)) AS retained, least(min(t) OVER w, lag(t) OVER o) AS since
    FROM e WINDOW o AS (PARTITION BY session ORDER BY t), w AS (PARTITION BY session ORDER BY t RANGE BETWEEN 130 PRECEDING AND CURRENT ROW)),
  due AS (SELECT DISTINCT session, t, retained FROM k0 WHERE t - since >= 100),
  s AS (SELECT session, min(t) AS t FROM due GROUP BY 1 UNION ALL SELECT s.session, min(due.t) FROM s JOIN due ON due.session = s.session AND due.t - s.t > 24 GROUP BY 1)
  SELECT session, round(t, 5) AS t, CAST(retained AS BIGINT) AS retained, retained >= 8 AS enough FROM s JOIN due USING (session, t)""")
def analysis_cadence(spark, sf_dir):
    """When windows of 100 hours, kept by time, are analysed: at most once a day, and in earnest from 8 events on."""
    made = series.due_analyses(events(spark, sf_dir).select("session", "t"), 100.0, 24.0, 8)
    return made.select("session", F.round("t", 5).alias("t"), "retained", "enough")


@query(f"""WITH {EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY event_id DESC) AS k FROM e)
  SELECT session, round(CASE WHEN count(*) >= 3 THEN quantile_cont(value, 0.5) END, 5) AS median_bpm, round(CASE WHEN count(*) >= 3 THEN stddev_pop(value) END, 5) AS bpm_sd FROM r WHERE k <= 60 GROUP BY 1""")
def recent_median(spark, sf_dir):
    made = reports.recent(estimates(spark, sf_dir), order="event_id")
    return made.select("session", F.round("median_bpm", 5).alias("median_bpm"), F.round("bpm_sd", 5).alias("bpm_sd"))


@query(f"""WITH {EVENTS}, p AS (SELECT session, t, CASE WHEN t - lag(t) OVER (PARTITION BY session ORDER BY t) > 24 THEN 1 ELSE 0 END AS cut FROM e),
  q AS (SELECT session, t, sum(cut) OVER (PARTITION BY session ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS part FROM p)
  SELECT session, CAST(part AS BIGINT) AS part, round(min(t), 6) + 0e0 AS start, round(max(t), 6) + 0e0 AS "end", count(*) AS n FROM q GROUP BY 1, 2""")
def session_gaps(spark, sf_dir):
    made = series.sessions_by_gap(events(spark, sf_dir), 24.0)
    return made.select("session", F.col("part").cast("long").alias("part"), C.zero(F.col("start")).alias("start"), C.zero(F.col("end")).alias("end"), "n")


def as_history(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    instant = F.unix_millis(F.col("ts").cast("timestamp"))
    return rows.select(
        F.col("event_id").alias("id"), instant.alias("instant"), F.concat(F.lit(" p"), (F.col("user_id") % 40).cast("string"), F.lit(" ")).alias("person"), F.col("value").alias("bpm"),
        (F.col("value") / 8 - 1).alias("snr_db"), F.col("event_type").alias("confidence"), F.col("props").alias("note"),
    )


HISTORY = """h AS (SELECT event_id AS id, epoch_us(ts) // 1000 AS instant, ' p' || CAST(user_id % 40 AS VARCHAR) || ' ' AS person, value AS bpm, value / 8 - 1 AS snr_db, event_type AS confidence, props AS note, ts FROM events)"""


@query(f"""WITH {HISTORY} SELECT id, instant, bpm FROM h ORDER BY instant DESC, id DESC LIMIT 500""")
def history_topn(spark, sf_dir):
    return reports.newest(as_history(spark, sf_dir)).select("id", "instant", "bpm")


@query(f"""WITH {HISTORY} SELECT trim(person) AS person, count(*) AS records, max(instant) AS last, {", ".join(f"round(CASE WHEN count(*) >= 2 THEN {f}(bpm) END, 5) AS {n}_bpm" for n, f in (("mean", "avg"), ("min", "min"), ("max", "max")))} FROM h GROUP BY 1""")
def history_people(spark, sf_dir):
    made = reports.people(as_history(spark, sf_dir))
    return made.select("person", "records", "last", *(F.round(f"{n}_bpm", 5).alias(f"{n}_bpm") for n in ("mean", "min", "max")))


HISTORY_LINES = f"""WITH {HISTORY}, c AS (SELECT *, CAST(bpm AS DECIMAL(18, 6)) AS d, CAST(bpm * 2 AS DECIMAL(18, 6)) AS d2 FROM h)
  SELECT id, strftime(ts, '%d/%m/%Y;%H:%M:%S;') || person || ';' || replace(CAST(round(d, 1) AS VARCHAR), '.', ',') || ';' || replace(CAST(round(d2, 1) AS VARCHAR), '.', ',') || ';' || confidence || ';' || regexp_replace(note, '[;\\r\\n]+', ' ', 'g') AS line FROM c"""


@query(HISTORY_LINES)
def history_csv(spark, sf_dir):
    """Every record of the history; halves of the last shown digit go up, as decimals do in both engines."""
    return reports.history_lines(as_history(spark, sf_dir).withColumn("snr_db", F.col("bpm") * 2))


SNR_LINES = HISTORY_LINES.replace("CAST(bpm * 2 AS", "CAST(CAST(snr_db AS VARCHAR) AS").replace("AS DECIMAL(18, 6)) AS d2", "AS DECIMAL(30, 20)) AS d2").replace("replace(CAST(round(d2, 1) AS VARCHAR), '.', ',')", "CASE WHEN d2 < 0 AND round(d2, 1) = 0 THEN '-0,0' ELSE replace(CAST(round(d2, 1) AS VARCHAR), '.', ',') END")


@query(SNR_LINES)
def history_csv_whole(spark, sf_dir):
    """Every record with its own signal-to-noise ratio."""
    return reports.history_lines(as_history(spark, sf_dir))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def history_json(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("""WITH r AS (SELECT DISTINCT CAST(40 + c_custkey % 140 AS DOUBLE) AS bpm FROM customer), c(scenario, pulse, noise, drift, tremor, jitter_s) AS (VALUES ('ideal', 0.02e0, 1e0, 0e0, 0e0, 0e0),
    ('pulso fraco', 0.005e0, 3e0, 0e0, 0e0, 0e0), ('ruído alto', 0.008e0, 14e0, 0e0, 0e0, 0e0), ('deriva de iluminação', 0.015e0, 2e0, 0.25e0, 0e0, 0e0),
    ('interferência na banda', 0.015e0, 2e0, 0e0, 0.02e0, 0e0), ('interferência forte', 0.012e0, 2e0, 0e0, 0.06e0, 0e0), ('captura irregular', 0.015e0, 2e0, 0e0, 0e0, 0.015e0))
  SELECT bpm, c.*, round(CASE WHEN tremor > 0 THEN greatest(0.75e0, least(3.9e0, CASE WHEN bpm / 60 + 0.7e0 > 3.8e0 THEN bpm / 60 - 0.7e0 ELSE bpm / 60 + 0.7e0 END)) ELSE 0.2e0 END, 6) AS tremor_hz,
  CAST(floor(bpm) AS INTEGER) AS seed FROM r, c""")
def scenario_table(spark, sf_dir):
    return recordings.scenarios(rates(spark, sf_dir)).withColumn("tremor_hz", F.round("tremor_hz", 6))


def rates(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select((F.lit(40) + F.col("c_custkey") % 140).cast("double").alias("bpm")).distinct()


@query(f"""WITH r AS (SELECT c_custkey AS session, CAST(40 + c_custkey % 140 AS DOUBLE) AS bpm, unnest(range(0, 90)) AS i FROM customer), t AS (SELECT *, i / 30.0e0 AS t FROM r),
  w AS (SELECT *, sin({PERIOD} * (bpm / 60) * t) + 0.35e0 * sin(2 * {PERIOD} * (bpm / 60) * t) + 0.12e0 * sin(3 * {PERIOD} * (bpm / 60) * t) AS w FROM t),
  n AS (SELECT *, w / max(abs(w)) OVER (PARTITION BY session) AS v, 1 + 0.25e0 * t / (89 / 30.0e0) + 0.02e0 * sin({PERIOD} * 1.9e0 * t) AS light FROM w)
  SELECT session, i, round(205 * light * (1 + 0.02e0 * 0.3e0 * v), 5) AS r, round(175 * light * (1 + 0.02e0 * v), 5) AS g, round(150 * light * (1 + 0.02e0 * 0.55e0 * v), 5) AS b FROM n""")
def synthetic_pulse_series(spark, sf_dir):
    people = spark.read.parquet(f"{sf_dir}/customer.parquet")
    rows = people.select(F.col("c_custkey").alias("session"), (F.lit(40) + F.col("c_custkey") % 140).cast("double").alias("bpm"), F.lit(0.02).alias("pulse"), F.lit(0.25).alias("drift"), F.lit(0.02).alias("tremor"), F.lit(1.9).alias("tremor_hz"))
    made = recordings.clean_series(rows, FPS, 90)
    return made.select("session", F.col("i").cast("long").alias("i"), *(F.round(c, 5).alias(c) for c in "rgb"))


@query(f"""WITH {FRAMES}, n AS (SELECT session, i, g, count(*) OVER (PARTITION BY session) AS n FROM f)
  SELECT session, i, g FROM n WHERE n <= 40 OR floor(i * 40 / n) <> floor((i - 1) * 40 / n)""")
def drawn_points(spark, sf_dir):
    return reports.evenly(frames(spark, sf_dir), 40).select("session", "i", "g")


# Kernels, state and streams have no SQL.
SHORT = Analysis(window_s=64 / FPS, step_s=32 / FPS, background=False)


FILTER = bandpass_map(BLOCK, FPS, BAND.low_hz, BAND.high_hz)


@query(f"""WITH {FRAMES}, {matrix_sql("fl", FILTER)}, {matrix_sql("fd", FILTER @ detrend_map(BLOCK, 100.0))}, c AS (SELECT session, count(*) AS n FROM f GROUP BY 1),
  u AS (SELECT f.*, unnest(range(0, (n - 64) // 32 + 1)) AS window_id FROM f JOIN c USING (session) WHERE n >= 64),
  w AS (SELECT session, window_id, i - window_id * 32 AS k, r, g, b FROM u WHERE i BETWEEN window_id * 32 AND window_id * 32 + 63),
  m AS (SELECT *, r / avg(r) OVER x AS nr, g / avg(g) OVER x AS ng, b / avg(b) OVER x AS nb FROM w WINDOW x AS (PARTITION BY session, window_id)),
  xy AS (SELECT session, window_id, fl.i AS k, sum(v * (3 * nr - 2 * ng)) AS x, sum(v * (1.5e0 * nr + ng - 1.5e0 * nb)) AS y FROM m JOIN fl ON k = j GROUP BY 1, 2, 3),
  s AS (SELECT session, window_id, k, x - CASE WHEN stddev_pop(y) OVER o > 1e-12 THEN stddev_pop(x) OVER o / stddev_pop(y) OVER o ELSE 0 END * y AS s FROM xy WINDOW o AS (PARTITION BY session, window_id))
  SELECT w.session, w.window_id, CAST(fd.i AS INTEGER) AS k, round(sum(-v * g), 3) + 0e0 AS verde, round(sum(v * s), 4) + 0e0 AS chrom
  FROM w JOIN s ON w.session = s.session AND w.window_id = s.window_id AND w.k = s.k JOIN fd ON w.k = j GROUP BY 1, 2, 3""")
def pulse_signals(spark, sf_dir):
    """Sliding windows through the recursive band-pass and the smooth trend: green's and chrominance's pulse signals."""
    size, step = BLOCK, BLOCK // 2
    chunks = series.count_chunks(frames(spark, sf_dir), size, step, analysis.CHUNK)
    made = analysis.pulses(chunks, FPS, Analysis(), ["session", "chunk"], algorithms=["verde", "chrom"], sliding=(size, step))
    return made.select("session", "window_id", "k", C.zero(F.col("verde"), 3).alias("verde"), C.zero(F.col("chrom"), 4).alias("chrom"))


def middle_sql(x: str) -> str:
    return f"(list_sort({x})[(len({x}) + 1) // 2] + list_sort({x})[len({x}) // 2 + 1]) / 2"


# windows of 64 frames, 32 apart: lags of the background regressed out of each channel, 17 stacked windows of 48 frames,
# trend and band-pass as one matrix, bins 11 to 69 of 512 (12 to 68 lie in the band), and beats of what passes the gate
CHAIN = f"""WITH {FRAMES}, {matrix_sql("fd", FILTER @ detrend_map(BLOCK, 100.0))}, c AS (SELECT session, count(*) AS n FROM f GROUP BY 1),
  u AS (SELECT f.*, unnest(range(0, (n - 64) // 32 + 1)) AS window_id FROM f JOIN c USING (session) WHERE n >= 64),
  w AS (SELECT session, window_id, i - window_id * 32 AS k, r, g, b, bg FROM u WHERE i BETWEEN window_id * 32 AND window_id * 32 + 63),
  z AS (SELECT *, (bg - avg(bg) OVER x) / nullif(stddev_pop(bg) OVER x, 0) AS z FROM w WINDOW x AS (PARTITION BY session, window_id)),
  l AS (SELECT session, window_id, k, z AS l0, coalesce(lag(z) OVER o, 0) AS l1, coalesce(lag(z, 2) OVER o, 0) AS l2, unnest(['r', 'g', 'b']) AS ch, unnest([r, g, b]) AS v FROM z WINDOW o AS (PARTITION BY session, window_id ORDER BY k)),
  m AS (SELECT *, avg(v) OVER x AS mean, stddev_pop(v) OVER x AS sd FROM l WINDOW x AS (PARTITION BY session, window_id, ch)),
  s AS (SELECT session, window_id, ch, sum(l0 * l0) AS s00, sum(l0 * l1) AS s01, sum(l0 * l2) AS s02, sum(l1 * l1) AS s11, sum(l1 * l2) AS s12, sum(l2 * l2) AS s22,
    sum(l0 * (v - mean)) AS t0, sum(l1 * (v - mean)) AS t1, sum(l2 * (v - mean)) AS t2 FROM m GROUP BY 1, 2, 3),
  k3 AS (SELECT session, window_id, ch, {", ".join(f"{cramer(j)} AS c{j}" for j in range(3))} FROM s),
  y AS (SELECT session, window_id, k, ch, CASE WHEN greatest(abs(c0), abs(c1), abs(c2)) <= 3 * sd THEN v - c0 * l0 - c1 * l1 - c2 * l2 ELSE v END AS y FROM m JOIN k3 USING (session, window_id, ch)),
  rgb AS (SELECT session, window_id, k, {", ".join(f"max(y) FILTER (ch = '{c}') AS {c}" for c in "rgb")} FROM y GROUP BY 1, 2, 3),
  a0 AS (SELECT *, unnest(range(greatest(0, k - 47), least(k, 16) + 1)) AS a FROM rgb),
  a1 AS (SELECT session, window_id, k, a, {", ".join(f"{c} / avg({c}) OVER x AS {c}" for c in "rgb")} FROM a0 WINDOW x AS (PARTITION BY session, window_id, a)),
  a2 AS (SELECT session, window_id, k, a, g - b AS s1, g + b - 2 * r AS s2 FROM a1),
  a3 AS (SELECT session, window_id, k, a, s1 + stddev_pop(s1) OVER x / stddev_pop(s2) OVER x * s2 AS h FROM a2 WINDOW x AS (PARTITION BY session, window_id, a)),
  a4 AS (SELECT session, window_id, k, (h - avg(h) OVER x) / stddev_pop(h) OVER x AS h FROM a3 WINDOW x AS (PARTITION BY session, window_id, a)),
  a5 AS (SELECT session, window_id, k, sum(h) AS h FROM a4 GROUP BY 1, 2, 3),
  p AS (SELECT session, window_id, fd.i AS k, sum(v * h) AS x FROM a5 JOIN fd ON k = j GROUP BY 1, 2, 3),
  d AS (SELECT session, window_id, k, 0.5e0 - 0.5e0 * cos({PERIOD} * k / 63) AS w, (x - avg(x) OVER o) * (0.5e0 - 0.5e0 * cos({PERIOD} * k / 63)) AS x FROM p WINDOW o AS (PARTITION BY session, window_id)),
  sp AS (SELECT session, window_id, bin, bin * 30.0e0 / 512 AS hz, bin BETWEEN 12 AND 68 AS inside, (power(sum(x * cos((k * bin % 512) * {PERIOD} / 512)), 2) + power(sum(x * sin((k * bin % 512) * {PERIOD} / 512)), 2)) / (sum(w * w) * 30) AS power
    FROM d, (SELECT unnest(range(11, 70)) AS bin) GROUP BY 1, 2, 3),
  v AS (SELECT *, ln(lag(power) OVER o) AS pb, ln(power) AS pm, ln(lead(power) OVER o) AS pa FROM sp WINDOW o AS (PARTITION BY session, window_id ORDER BY bin)),
  t AS (SELECT * FROM v WHERE inside QUALIFY row_number() OVER (PARTITION BY session, window_id ORDER BY power DESC, bin) = 1),
  pk AS (SELECT session, window_id, greatest(0.7e0, least(4.0e0, hz + CASE WHEN abs(pb - 2 * pm + pa) >= 1e-18 THEN greatest(-0.5e0, least(0.5e0, 0.5e0 * (pb - pa) / (pb - 2 * pm + pa))) * 30.0e0 / 512 ELSE 0 END)) AS peak FROM t),
  n AS (SELECT session, window_id, peak, least(60e0, 10 * log10(sum(power) FILTER (abs(hz - peak) <= 0.1e0 OR abs(hz - 2 * peak) <= 0.2e0) / sum(power) FILTER (NOT (abs(hz - peak) <= 0.1e0 OR abs(hz - 2 * peak) <= 0.2e0)))) AS snr
    FROM sp JOIN pk USING (session, window_id) WHERE inside GROUP BY 1, 2, 3),
  xs AS (SELECT session, window_id, list(x ORDER BY k) AS xs, stddev_pop(x) AS sd FROM p GROUP BY 1, 2),
  q0 AS (SELECT n.session, n.window_id, peak, snr, xs, sd, greatest(1, CAST(floor(0.7e0 * 30 / peak) AS BIGINT)) AS far, list_filter(range(2, 64), lambda i: xs[i] > xs[i - 1] AND xs[i] > xs[i + 1]) AS tops FROM n JOIN xs USING (session, window_id) WHERE snr >= 0),
  q1 AS (SELECT *, list_transform(list_reverse_sort(list_transform(tops, lambda i: [xs[i], i])), lambda e: [CAST(e[2] AS BIGINT)]) AS ranked FROM q0),
  q2 AS (SELECT *, CASE WHEN len(ranked) > 0 THEN list_reduce(ranked, lambda kept, e: CASE WHEN len(list_filter(kept, lambda o: abs(o - e[1]) < far)) = 0 THEN list_concat(kept, e) ELSE kept END) ELSE [] END AS kept FROM q1),
  q3 AS (SELECT *, list_sort(list_filter(kept, lambda i: xs[i] - greatest(list_min(xs[coalesce(list_max(list_filter(range(1, i), lambda j: xs[j] > xs[i])), 1):i]),
    list_min(xs[i:coalesce(list_min(list_filter(range(i + 1, 65), lambda j: xs[j] > xs[i])), 64)])) >= 0.3e0 * sd)) AS beats FROM q2),
  q4 AS (SELECT *, list_transform(range(1, len(beats)), lambda i: (beats[i + 1] - beats[i]) * 1000.0e0 / 30.0e0) AS every FROM q3),
  q5 AS (SELECT *, {middle_sql("every")} AS middle FROM q4),
  q6 AS (SELECT *, CASE WHEN len(every) < 3 THEN every ELSE list_filter(every, lambda e: abs(e - middle) / middle <= 0.3e0) END AS gaps FROM q5),
  q7 AS (SELECT *, list_transform(range(1, len(gaps)), lambda i: gaps[i + 1] - gaps[i]) AS steps, CASE WHEN len(gaps) >= 2 THEN 60000.0e0 / ({middle_sql("gaps")}) END AS found FROM q6),
  q8 AS (SELECT *, CASE WHEN found / 60 BETWEEN 0.7e0 AND 4.0e0 THEN found END AS rate, len(gaps) >= 2 AS enough FROM q7)
  SELECT n.session, n.window_id, round(q8.peak * 60, 3) AS bpm, round(q8.peak, 5) AS hz, round(n.snr, 3) + 0e0 AS snr_db,
    CASE WHEN n.snr >= 6 THEN 'alta' WHEN n.snr >= 2 THEN 'média' WHEN n.snr >= 0 THEN 'baixa' END AS confidence, 'pos' AS algorithm, round(64 / 30.0e0, 6) AS window_s,
    round(rate, 3) AS peak_bpm, round(abs(q8.peak * 60 - rate), 3) AS disagreement, CASE WHEN enough THEN round(list_avg(gaps), 3) END AS mean_ms,
    CASE WHEN enough THEN round(list_stddev_samp(gaps), 3) END AS sdnn, CASE WHEN enough THEN round(sqrt(list_avg(list_transform(steps, lambda e: e * e))), 3) END AS rmssd,
    CASE WHEN enough THEN round(list_avg(list_transform(steps, lambda e: CASE WHEN abs(e) > 50 THEN 1e0 ELSE 0e0 END)), 6) END AS pnn50, CAST(len(beats) AS INTEGER) AS beats,
    CASE WHEN n.snr < 0 THEN 'sinal_sem_qualidade' END AS error_code
  FROM n LEFT JOIN q8 USING (session, window_id)"""


@query(CHAIN)
def pulse_estimates(spark, sf_dir):
    """Sliding windows of every session through rectification, detrending, band-pass, spectrum, gate and beats."""
    rows = frames(spark, sf_dir).select("session", "i", "r", "g", "b", *(F.col("bg").alias(f"bg_{c}") for c in "rgb"))
    made = analysis.sessions(rows, FPS, SHORT.having(background=True))
    digits = {"bpm": 3, "hz": 5, "snr_db": 3, "window_s": 6, "peak_bpm": 3, "disagreement": 3, "mean_ms": 3, "sdnn": 3, "rmssd": 3, "pnn50": 6}
    return made.select(*(C.zero(F.col(c), digits[c]).alias(c) if c in digits else c for c in made.columns))


def unfit(df):
    """Events as frames with a red, green, blue or time that is missing here and there."""
    e = F.col("event_id")
    colours = {"r": e * 7 % 50 + 100.0, "g": F.col("value") * 0.7 + 90, "b": e * 13 % 30 + 80.0, "t": F.col("t") / 300}
    lost = {"r": e % 211 == 0, "g": e % 223 == 0, "b": e % 227 == 0, "t": e % 229 == 0}
    gaps = {"r": F.lit(None), "g": F.lit(float("nan")), "b": F.lit(float("inf")), "t": F.lit(None)}
    return df.select("session", e.alias("i"), *(F.when(lost[c], gaps[c]).otherwise(v).cast("double").alias(c) for c, v in colours.items()))


@query(f"""WITH {EVENTS}, o AS (SELECT session, row_number() OVER (PARTITION BY session ORDER BY event_id) AS n, count(*) OVER (PARTITION BY session) AS total,
    event_id % 211 = 0 OR event_id % 223 = 0 OR event_id % 227 = 0 OR event_id % 229 = 0 AS bad FROM e),
  w AS (SELECT *, unnest(range(0, (total - 40) // 10 + 1)) AS window_id FROM o WHERE total >= 40)
  SELECT session, window_id, bool_or(bad) AS refused, NOT bool_or(bad) AS judged FROM w WHERE n BETWEEN window_id * 10 + 1 AND window_id * 10 + 40 GROUP BY 1, 2""")
def refused_windows(spark, sf_dir):
    """Windows that hold a colour or time that is missing get neither a rate nor a level of noise; all others are judged."""
    made = analysis.sessions(unfit(events(spark, sf_dir)), FPS, SHORT.having(window_s=40 / FPS, step_s=10 / FPS))
    nothing = (F.col("error_code") == "sinal_sem_qualidade") & F.col("bpm").isNull() & F.col("snr_db").isNull() & F.col("confidence").isNull()
    return made.select("session", "window_id", nothing.alias("refused"), F.coalesce(F.col("snr_db").isNotNull() | (F.col("error_code") == "banda_invalida"), F.lit(False)).alias("judged"))


@query()
def algorithm_grid(spark, sf_dir):
    """Every algorithm over the same blocks of frames, read once."""
    return analysis.analysed(blocks(spark, sf_dir).select(*KEYS, "k", "r", "g", "b"), FPS, SHORT, KEYS, "k", list(ALGORITHMS))


@query()
def accuracy_battery(spark, sf_dir):
    """Simulated recordings for the customers' rates in every condition, by every algorithm, against the truth."""
    table = recordings.scenarios(rates(spark, sf_dir))
    made = recordings.simulated(table.repartition("bpm", "scenario"))
    truth = made.withColumnRenamed("bpm", "truth")
    found = analysis.analysed(truth, FPS, Analysis(background=False), ["scenario", "truth"], "i", list(ALGORITHMS))
    errors = found.select("scenario", "algorithm", F.abs(F.col("bpm") - F.col("truth")).alias("error"), "snr_db")
    return reports.accuracy(errors, ["scenario", "algorithm"])


WIDE = bandpass_map(128, FPS, 0.75, 3.3)
W4 = "session, window_id, variant, used"


# windows of 128 frames end to end, in two variants, with and without what the background explains, by three algorithms;
# of 1024 bins 26 to 112 lie in 0.75 to 3.3 Hz
@query(f"""WITH {FRAMES}, {matrix_sql("fl", WIDE)}, {matrix_sql("fd", WIDE @ detrend_map(128, 100.0))}, c AS (SELECT session, count(*) AS n FROM f GROUP BY 1),
  w AS (SELECT session, i // 128 AS window_id, i % 128 AS k, r, g, b, bg FROM f JOIN c USING (session) WHERE i // 128 < n // 128),
  z AS (SELECT *, (bg - avg(bg) OVER x) / nullif(stddev_pop(bg) OVER x, 0) AS z FROM w WINDOW x AS (PARTITION BY session, window_id)),
  l AS (SELECT *, z AS l0, coalesce(lag(z) OVER o, 0) AS l1, coalesce(lag(z, 2) OVER o, 0) AS l2 FROM z WINDOW o AS (PARTITION BY session, window_id ORDER BY k)),
  lv AS (SELECT session, window_id, k, l0, l1, l2, unnest(['plain', 'plain', 'plain', 'mixed', 'mixed', 'mixed']) AS variant, unnest(['r', 'g', 'b', 'r', 'g', 'b']) AS ch,
    unnest([r, g, b, r * 0.9e0 + bg * 0.1e0, g * 0.9e0 + bg * 0.1e0, b * 0.9e0 + bg * 0.1e0]) AS v FROM l),
  m AS (SELECT *, avg(v) OVER x AS mean, stddev_pop(v) OVER x AS sd FROM lv WINDOW x AS (PARTITION BY session, window_id, variant, ch)),
  s AS (SELECT session, window_id, variant, ch, sum(l0 * l0) AS s00, sum(l0 * l1) AS s01, sum(l0 * l2) AS s02, sum(l1 * l1) AS s11, sum(l1 * l2) AS s12, sum(l2 * l2) AS s22,
    sum(l0 * (v - mean)) AS t0, sum(l1 * (v - mean)) AS t1, sum(l2 * (v - mean)) AS t2 FROM m GROUP BY 1, 2, 3, 4),
  k3 AS (SELECT session, window_id, variant, ch, {", ".join(f"{cramer(j)} AS c{j}" for j in range(3))} FROM s),
  y AS (SELECT session, window_id, variant, k, ch, unnest([true, false]) AS used, unnest([CASE WHEN greatest(abs(c0), abs(c1), abs(c2)) <= 3 * sd THEN v - c0 * l0 - c1 * l1 - c2 * l2 ELSE v END, v]) AS y
    FROM m JOIN k3 USING (session, window_id, variant, ch)),
  rgb AS (SELECT {W4}, k, {", ".join(f"max(y) FILTER (ch = '{c}') AS {c}" for c in "rgb")} FROM y GROUP BY ALL),
  nm AS (SELECT {W4}, k, {", ".join(f"{c} / avg({c}) OVER x AS {c}" for c in "rgb")} FROM rgb WINDOW x AS (PARTITION BY {W4})),
  xy AS (SELECT {W4}, fl.i AS k, sum(v * (3 * r - 2 * g)) AS x, sum(v * (1.5e0 * r + g - 1.5e0 * b)) AS y FROM nm JOIN fl ON k = j GROUP BY ALL),
  a0 AS (SELECT *, unnest(range(greatest(0, k - 47), least(k, 80) + 1)) AS a FROM rgb),
  a1 AS (SELECT {W4}, k, a, {", ".join(f"{c} / avg({c}) OVER x AS {c}" for c in "rgb")} FROM a0 WINDOW x AS (PARTITION BY {W4}, a)),
  a2 AS (SELECT {W4}, k, a, g - b AS s1, g + b - 2 * r AS s2 FROM a1),
  a3 AS (SELECT {W4}, k, a, s1 + stddev_pop(s1) OVER x / stddev_pop(s2) OVER x * s2 AS h FROM a2 WINDOW x AS (PARTITION BY {W4}, a)),
  a4 AS (SELECT {W4}, k, (h - avg(h) OVER x) / stddev_pop(h) OVER x AS h FROM a3 WINDOW x AS (PARTITION BY {W4}, a)),
  raw AS (SELECT {W4}, k, 'verde' AS algorithm, -g AS h FROM rgb UNION ALL SELECT {W4}, k, 'pos', sum(h) FROM a4 GROUP BY ALL
    UNION ALL SELECT {W4}, k, 'chrom', x - stddev_pop(x) OVER o / stddev_pop(y) OVER o * y FROM xy WINDOW o AS (PARTITION BY {W4})),
  p AS (SELECT {W4}, algorithm, fd.i AS k, sum(v * h) AS x FROM raw JOIN fd ON k = j GROUP BY ALL),
  d AS (SELECT {W4}, algorithm, k, 0.5e0 - 0.5e0 * cos({PERIOD} * k / 127) AS w, (x - avg(x) OVER o) * (0.5e0 - 0.5e0 * cos({PERIOD} * k / 127)) AS x FROM p WINDOW o AS (PARTITION BY {W4}, algorithm)),
  waves AS (SELECT k, bin, cos((k * bin % 1024) * {PERIOD} / 1024) AS re, sin((k * bin % 1024) * {PERIOD} / 1024) AS im FROM (SELECT unnest(range(0, 128)) AS k), (SELECT unnest(range(25, 114)) AS bin)),
  sp AS (SELECT {W4}, algorithm, bin, bin * 30.0e0 / 1024 AS hz, bin BETWEEN 26 AND 112 AS inside, (power(sum(x * re), 2) + power(sum(x * im), 2)) / (sum(w * w) * 30) AS power FROM d JOIN waves USING (k) GROUP BY ALL),
  v AS (SELECT *, ln(lag(power) OVER o) AS pb, ln(power) AS pm, ln(lead(power) OVER o) AS pa FROM sp WINDOW o AS (PARTITION BY {W4}, algorithm ORDER BY bin)),
  t AS (SELECT * FROM v WHERE inside QUALIFY row_number() OVER (PARTITION BY {W4}, algorithm ORDER BY power DESC, bin) = 1),
  pk AS (SELECT {W4}, algorithm, greatest(0.75e0, least(3.3e0, hz + CASE WHEN abs(pb - 2 * pm + pa) >= 1e-18 THEN greatest(-0.5e0, least(0.5e0, 0.5e0 * (pb - pa) / (pb - 2 * pm + pa))) * 30.0e0 / 1024 ELSE 0 END)) AS peak FROM t),
  e AS (SELECT {W4}, algorithm, peak * 60 AS bpm, least(60e0, 10 * log10(sum(power) FILTER (abs(hz - peak) <= 0.1e0 OR abs(hz - 2 * peak) <= 0.2e0) / sum(power) FILTER (NOT (abs(hz - peak) <= 0.1e0 OR abs(hz - 2 * peak) <= 0.2e0)))) AS snr
    FROM sp JOIN pk USING ({W4}, algorithm) WHERE inside GROUP BY {W4}, algorithm, peak),
  g AS (SELECT variant, algorithm, used, quantile_cont(bpm, 0.5) AS median_bpm, stddev_pop(bpm) AS dispersion, quantile_cont(snr, 0.5) AS median_snr_db, count(*) AS windows FROM e WHERE snr >= -60 GROUP BY 1, 2, 3)
  SELECT variant, algorithm, used AS with_background, round(median_bpm, 3) AS median_bpm, round(dispersion, 3) AS dispersion, round(median_snr_db, 3) + 0e0 AS median_snr_db, windows, windows < greatest(5, floor(0.4e0 * max(windows) OVER ())) AS few FROM g""")
def diagnostic_grid(spark, sf_dir):
    """Two colour variants of every session through the grid, ranked; the capture is read once."""
    rows = frames(spark, sf_dir)
    wide = rows.select("session", "i", *(F.col(c).alias(f"{c}_plain") for c in "rgb"), *((F.col(c) * 0.9 + F.col("bg") * 0.1).alias(f"{c}_mixed") for c in "rgb"), *(F.col("bg").alias(f"bg_{c}") for c in "rgb"))
    # orders have no pulse, so the gate on noise is open here; `pulse_estimates` and `algorithm_grid` keep it
    config = Analysis(window_s=128 / FPS, step_s=128 / FPS, band=Band(0.75, 3.3), least_snr_db=-60.0)
    found = diagnostic.grid(diagnostic.stacked(wide, ["plain", "mixed"]), FPS, config)
    by = ["variant", "algorithm", "with_background"]
    made = reports.diagnostic_ranking(found, by)
    return made.select(*by, *(C.zero(F.col(c), 3).alias(c) for c in ("median_bpm", "dispersion", "median_snr_db")), "windows", "few")


@query(f"""WITH {BLOCKS}, d AS (SELECT session, block, k, avg(g) OVER (PARTITION BY session, block) - g AS x FROM bl WHERE n >= 8), {dft_sql("x")},
  y AS (SELECT d.session, d.block, d.k, sum(2 * (re * cos(k * bin * {PERIOD} / 64) + im * sin(k * bin * {PERIOD} / 64))) / 64 AS y FROM d JOIN s USING (session, block) GROUP BY 1, 2, 3),
  yn AS (SELECT *, count(*) OVER (PARTITION BY session, block) AS n FROM y), x AS (WITH {periodogram_sql("yn", "y")} SELECT * FROM sp), sp AS (SELECT * FROM x), {DOMINANT}""")
def finger_mode(spark, sf_dir):
    """Blocks of frames as a fingertip's."""
    made = analysis.finger(long_blocks(spark, sf_dir), FPS, SHORT, BLOCK, KEYS, "k")
    return made.select(*KEYS, F.round("bpm", 4).alias("bpm"), C.zero(F.col("snr_db"), 4).alias("snr_db"), "confidence")


@query(f"""WITH RECURSIVE {BOXES}, o AS (SELECT session, i, row_number() OVER (PARTITION BY session ORDER BY i) AS n, i % 5 <> 0 AS face, x, y, w, h FROM q),
  t AS (SELECT session, i, n, CASE WHEN face THEN x END AS x, CASE WHEN face THEN y END AS y, CASE WHEN face THEN w END AS w, CASE WHEN face THEN h END AS h, CASE WHEN face THEN 0 ELSE 1 END AS misses FROM o WHERE n = 1
  UNION ALL SELECT session, i, n, CASE what WHEN 'held' THEN bx WHEN 'new' THEN x WHEN 'moved' THEN CAST(round_even(bx + (x - bx) * 0.25e0, 0) AS INTEGER) END,
    CASE what WHEN 'held' THEN "by" WHEN 'new' THEN y WHEN 'moved' THEN CAST(round_even("by" + (y - "by") * 0.25e0, 0) AS INTEGER) END,
    CASE what WHEN 'held' THEN bw WHEN 'new' THEN w WHEN 'moved' THEN CAST(round_even(bw + (w - bw) * 0.25e0, 0) AS INTEGER) END,
    CASE what WHEN 'held' THEN bh WHEN 'new' THEN h WHEN 'moved' THEN CAST(round_even(bh + (h - bh) * 0.25e0, 0) AS INTEGER) END,
    CASE WHEN what IN ('held', 'gone') THEN misses + 1 ELSE 0 END
    FROM (SELECT *, CASE WHEN (NOT face OR odd) AND bx IS NOT NULL AND misses + 1 <= 15 THEN 'held' WHEN NOT face THEN 'gone' WHEN bx IS NULL THEN 'new' ELSE 'moved' END AS what
      FROM (SELECT o.*, t.x AS bx, t.y AS "by", t.w AS bw, t.h AS bh, t.misses, t.x IS NOT NULL AND (sqrt(power(o.x + o.w / 2e0 - t.x - t.w / 2e0, 2) + power(o.y + o.h / 2e0 - t.y - t.h / 2e0, 2)) > 0.35e0 * greatest(1, t.w)
        OR NOT o.w / CAST(greatest(1, t.w) AS DOUBLE) BETWEEN 0.625e0 AND 1.6e0) AS odd FROM o JOIN t ON o.session = t.session AND o.n = t.n + 1)))
  SELECT session, i, x, y, w, h, x IS NULL AS lost FROM t""")
def box_tracking(spark, sf_dir):
    """Boxes of each session through the tracker; every fifth order has no face."""
    rows = boxes(spark, sf_dir)
    return regions.tracked(rows.select("session", "i", *(F.when(F.col("i") % 5 != 0, F.col(n)).alias(n) for n in "xywh")))


@query(f"""WITH {EVENTS}, o AS (SELECT session, t, value, row_number() OVER (PARTITION BY session ORDER BY event_id) AS n, count(*) OVER (PARTITION BY session) AS total FROM e),
  w AS (SELECT session, window_id, t, value FROM (SELECT *, unnest(range(0, (total - 20) // 10 + 1)) AS window_id FROM o WHERE total >= 20) WHERE n BETWEEN window_id * 10 + 1 AND window_id * 10 + 20),
  g0 AS (SELECT *, t - lag(t) OVER (PARTITION BY session, window_id ORDER BY t) AS gap FROM w), r AS (SELECT session, window_id, coalesce(1 / quantile_cont(gap, 0.5) FILTER (gap > 0), 0) AS fps, min(t) AS a, max(t) AS b FROM g0 GROUP BY 1, 2),
  c AS (SELECT *, CAST(round_even((b - a) * fps, 0) AS BIGINT) AS points FROM r), p AS (SELECT *, unnest(range(0, points + 1)) AS k FROM c), q AS (SELECT session, window_id, fps, points, k, a + (b - a) * k / nullif(points, 0) AS s FROM p),
  l AS (SELECT session, window_id, t, value, lead(t) OVER o AS t2, lead(value) OVER o AS v2 FROM w WINDOW o AS (PARTITION BY session, window_id ORDER BY t)),
  m AS (SELECT q.session, q.window_id, q.fps, q.points, CASE WHEN l.t2 > l.t THEN l.value + (least(q.s, l.t2) - l.t) / (l.t2 - l.t) * (l.v2 - l.value) ELSE l.value END AS v FROM q ASOF JOIN l ON q.session = l.session AND q.window_id = l.window_id AND q.s >= l.t)
  SELECT session, window_id, round(any_value(fps), 4) AS fps, any_value(points) + 1 AS points, round(avg(v), 3) AS mean FROM m GROUP BY 1, 2""")
def window_resampling(spark, sf_dir):
    """Count windows over events at their irregular times, each put on an even grid at the rate that its times show."""
    windows = series.count_windows(events(spark, sf_dir).select("session", "event_id", "t", "value"), 20, 10, order="event_id")
    by = ["session", "window_id"]
    rates = series.effective_fps(windows, "t", by)
    made = series.resampled(windows, ["value"], rates, by)
    sums = made.groupBy(*by).agg(F.count("*").alias("points"), F.avg("value").alias("mean"))
    return sums.join(rates, by).select(*by, F.round("fps", 4).alias("fps"), "points", F.round("mean", 3).alias("mean"))


@query()
def stream_monitor(spark, sf_dir):
    """Events as a live stream of frames: windows by count, reset by errors, smoothed."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = monitor.frame_stream(spark, sf_dir, schema, "events.parquet")
    v = F.col("value")
    live = stream.select(F.col("user_id").alias("session"), F.col("event_id").alias("i"), (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9 / 300).alias("t"), (F.col("event_id") * 7 % 50 + 100.0).alias("r"), (v * 0.7 + 90).alias("g"), (F.col("event_id") * 13 % 30 + 80.0).alias("b"), (F.col("event_id") % 997 == 0).alias("lost"))
    return monitor.drained(monitor.monitored(live, FPS, SHORT.having(window_s=40 / FPS, step_s=10 / FPS)), "monitor", folder(spark, "stream"))


LIVE = 40
LIVE_FILTER = bandpass_map(LIVE, FPS, BAND.low_hz, BAND.high_hz)


# a face lost or a control row begins a segment; windows of 40 frames, 10 apart, in each; of 512 bins 12 to 68 lie in the band
@query(f"""WITH {EVENTS}, {matrix_sql("fl", LIVE_FILTER)}, {matrix_sql("fd", LIVE_FILTER @ detrend_map(LIVE, 100.0))},
  m AS (SELECT session, event_id AS i, event_id % 97 = 0 AS lost, CASE WHEN event_id % 151 = 0 THEN CASE WHEN event_id // 151 % 2 = 1 THEN 'chrom' ELSE 'verde' END END AS named,
    event_id * 7 % 50 + 100e0 AS r, value * 0.7e0 + 90 AS g, event_id * 13 % 30 + 80e0 AS b FROM e),
  s AS (SELECT *, coalesce(lost AND NOT lag(lost, 1, false) OVER o, false) AS first_lost FROM (SELECT * FROM m WHERE named IS NULL) WINDOW o AS (PARTITION BY session ORDER BY i)),
  x AS (SELECT m.*, coalesce(s.first_lost, false) OR m.named IS NOT NULL AS cut FROM m LEFT JOIN s USING (session, i)),
  y AS (SELECT *, CAST(sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY i) AS INTEGER) AS segment,
    coalesce(last_value(named IGNORE NULLS) OVER (PARTITION BY session ORDER BY i), 'verde') AS algorithm FROM x),
  f AS (SELECT *, row_number() OVER p AS n, count(*) OVER (PARTITION BY session, segment) AS total FROM y WHERE NOT lost AND named IS NULL WINDOW p AS (PARTITION BY session, segment ORDER BY i)),
  w AS (SELECT session, segment, algorithm, w0 AS w, n - w0 * 10 - 1 AS k, i, r, g, b FROM (SELECT *, unnest(range(0, (total - 40) // 10 + 1)) AS w0 FROM f WHERE total >= 40) WHERE n BETWEEN w0 * 10 + 1 AND w0 * 10 + 40),
  c0 AS (SELECT session, segment, w, k, {", ".join(f"{c} / avg({c}) OVER p AS {c}" for c in "rgb")} FROM w WHERE algorithm = 'chrom' WINDOW p AS (PARTITION BY session, segment, w)),
  c1 AS (SELECT session, segment, w, fl.i AS k, sum(v * (3 * r - 2 * g)) AS x, sum(v * (1.5e0 * r + g - 1.5e0 * b)) AS y FROM c0 JOIN fl ON k = j GROUP BY ALL),
  h AS (SELECT session, segment, w, k, -g AS h FROM w WHERE algorithm = 'verde' UNION ALL SELECT session, segment, w, k, x - stddev_pop(x) OVER p / stddev_pop(y) OVER p * y FROM c1 WINDOW p AS (PARTITION BY session, segment, w)),
  p AS (SELECT session, segment, w, fd.i AS k, sum(v * h) AS x FROM h JOIN fd ON k = j GROUP BY ALL),
  d AS (SELECT session, segment, w, k, 0.5e0 - 0.5e0 * cos({PERIOD} * k / 39) AS u, (x - avg(x) OVER o) * (0.5e0 - 0.5e0 * cos({PERIOD} * k / 39)) AS x FROM p WINDOW o AS (PARTITION BY session, segment, w)),
  sp AS (SELECT session, segment, w, bin, bin * 30.0e0 / 512 AS hz, bin BETWEEN 12 AND 68 AS inside, (power(sum(x * cos((k * bin % 512) * {PERIOD} / 512)), 2) + power(sum(x * sin((k * bin % 512) * {PERIOD} / 512)), 2)) / (sum(u * u) * 30) AS power
    FROM d, (SELECT unnest(range(11, 70)) AS bin) GROUP BY ALL),
  v AS (SELECT *, ln(lag(power) OVER o) AS pb, ln(power) AS pm, ln(lead(power) OVER o) AS pa FROM sp WINDOW o AS (PARTITION BY session, segment, w ORDER BY bin)),
  t AS (SELECT * FROM v WHERE inside QUALIFY row_number() OVER (PARTITION BY session, segment, w ORDER BY power DESC, bin) = 1),
  pk AS (SELECT session, segment, w, greatest(0.7e0, least(4.0e0, hz + CASE WHEN abs(pb - 2 * pm + pa) >= 1e-18 THEN greatest(-0.5e0, least(0.5e0, 0.5e0 * (pb - pa) / (pb - 2 * pm + pa))) * 30.0e0 / 512 ELSE 0 END)) AS peak FROM t),
  r AS (SELECT session, segment, w, peak * 60 AS bpm, least(60e0, 10 * log10(sum(power) FILTER (abs(hz - peak) <= 0.1e0 OR abs(hz - 2 * peak) <= 0.2e0) / sum(power) FILTER (NOT (abs(hz - peak) <= 0.1e0 OR abs(hz - 2 * peak) <= 0.2e0)))) AS snr
    FROM sp JOIN pk USING (session, segment, w) WHERE inside GROUP BY session, segment, w, peak),
  q AS (SELECT *, CASE WHEN snr >= 0 THEN bpm END AS good FROM r),
  z AS (SELECT *, list(good) FILTER (good IS NOT NULL) OVER (PARTITION BY session, segment ORDER BY w) AS upto FROM q)
  SELECT z.session, max(w.i) AS i, z.segment, any_value(w.algorithm) AS algorithm, round(any_value(good), 3) AS bpm, round(any_value(snr), 3) + 0e0 AS snr_db,
    CASE WHEN any_value(snr) < 0 THEN 'sinal_sem_qualidade' END AS error_code, round(any_value(list_reduce(upto, lambda a, x: a + (x - a) * 0.35e0)), 3) AS shown_bpm
  FROM z JOIN w USING (session, segment, w) GROUP BY z.session, z.segment, z.w""")
def stream_sessions(spark, sf_dir):
    """Events as live sessions on list states: faces lost begin segments, and control rows switch the algorithm."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = monitor.frame_stream(spark, sf_dir, schema, "events.parquet")
    e = F.col("event_id")
    named = F.when(e % 151 == 0, F.when(F.floor(e / 151) % 2 == 1, "chrom").otherwise("verde"))
    rows = stream.select(F.col("user_id").alias("session"), e.alias("i"), (e * 7 % 50 + 100.0).alias("r"), (F.col("value") * 0.7 + 90).alias("g"), (e * 13 % 30 + 80.0).alias("b"), (e % 97 == 0).alias("lost"), named.alias("algorithm"))
    config = SHORT.having(window_s=LIVE / FPS, step_s=10 / FPS, algorithm="verde", patience=0, smoothing=0.35)
    made = monitor.drained(sessions.live(rows, FPS, config), "sessions", folder(spark, "stream"))
    digits = {"bpm": 3, "snr_db": 3, "shown_bpm": 3}
    columns = ("session", "i", "segment", "algorithm", "bpm", "snr_db", "error_code", "shown_bpm")
    return made.filter("progress = 1").select(*(C.zero(F.col(c), digits[c]).alias(c) if c in digits else c for c in columns))


@query("""WITH w AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 5 MINUTE * k AS start, value FROM events, (SELECT unnest([0, 1]) AS k))
  SELECT start, count(*) AS n, round(avg(value), 5) AS mean FROM w GROUP BY 1 HAVING start + INTERVAL 10 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_sliding_means(spark, sf_dir):
    """Event-time windows that the watermark has closed."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = monitor.frame_stream(spark, sf_dir, schema, "events.parquet")
    made = monitor.drained(monitor.sliding_means(stream, "ts", "value"), "means", folder(spark, "stream"))
    return made.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("mean", 5).alias("mean"))
