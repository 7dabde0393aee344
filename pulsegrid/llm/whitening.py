"""Whitening of embeddings by spectrum slicing.

Components become long integers x = floor(scale * c) + offset. One pass adds up n and the sums S; a second adds up
products of x less its rounded mean, in exact integers, so the covariance is the nearest double to the true one, however
rows are dealt. Its leading eigenpairs are then found apart, each in a task: the inertia of LDL' factors of the shifted
covariance counts eigenvalues above a shift, bisection by these counts closes in on eigenvalue i until no other shares
the slice, and Rayleigh quotient iteration converges cubically from its middle. Counts on both sides of what is found
certify that it is eigenvalue i; where they don't, bisection goes on. Eigenvalues too close to tell apart share a slice,
whose vectors are found together by inverse iteration on a block. A last pass projects all rows, a pass before it adds
up the covariance of what it will write.

Cases: vectors that are null, empty or hold null or non-finite components take no part and get no rows; a null id keeps
its row; vectors must have one length, at most `MOST_DIMENSIONS`, and components below 2^40 in size, else ValueError;
a component without variance (fewer rows or dimensions than components) gets whitened null and is left out of
identity_error; repeated rows and ids count each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The covariance, its square in doubles, goes to the driver and to every task: 128 MB at most.
MOST_DIMENSIONS = 4096
LARGEST = 2.0**40
#: Eigenvalues below this part of the largest one are rounding.
RANK = 1e-13
BATCH = 4096


@dataclass(frozen=True)
class Settings:
    components: int = 32
    scale: int = 64
    offset: int = 1_000_000


@dataclass(frozen=True)
class Fit:
    """What the rows say: n, exact sums, covariance; and its leading eigenpairs, vectors in columns."""

    n: int
    sums: tuple[int, ...]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    rank: int


def fit_rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of the vectors that take part."""
    fit = (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.coalesce(fit, F.lit(False))).select("vec_id", F.col("embedding").cast("array<double>").alias("c"))


def integers(column: pa.Array, settings: Settings) -> np.ndarray:
    """Rows of x. ``column`` holds lists of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return np.floor(settings.scale * flat).astype(np.int64) + settings.offset


def pieces(batches):
    """Batches of at most `BATCH` rows, so that what a task holds doesn't grow with the size of Spark's batches."""
    for batch in batches:
        for k in range(0, batch.num_rows, BATCH):
            yield batch.slice(k, BATCH)


def moments(rows: DataFrame, settings: Settings) -> tuple[int, tuple[int, ...]] | None:
    """n and the exact sums of x; None without rows."""
    shape = rows.agg(F.count("*").alias("n"), F.min(F.size("c")).alias("low"), F.max(F.size("c")).alias("high"), F.max(F.array_max(F.transform("c", F.abs))).alias("size")).first()
    if not shape.n:
        return None
    if shape.low != shape.high or shape.high > MOST_DIMENSIONS:
        raise ValueError(f"vectors have {shape.low} to {shape.high} components; one length, at most {MOST_DIMENSIONS}, is needed")
    if shape.size >= LARGEST:
        raise ValueError(f"a component is as large as {shape.size}; the bound is {LARGEST}")

    def run(batches):
        total = None
        for batch in pieces(batches):
            part = integers(batch.column(0), settings).astype(object).sum(0) if shape.size > 2**20 else integers(batch.column(0), settings).sum(0).astype(object)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(total)), pa.int32()), "s": pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0))})

    parts = rows.select("c").mapInArrow(run, "i int, s decimal(38,0)")
    sums = {r.i: int(r.s) for r in parts.groupBy("i").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect()}
    return shape.n, tuple(sums[i] for i in range(shape.high))


def products(values: np.ndarray) -> np.ndarray:
    """values' values in exact integers."""
    most = int(np.abs(values).max(initial=0))
    if most * most * len(values) < 2**53:  # sums that doubles hold exactly, by BLAS
        return (values.T.astype(float) @ values.astype(float)).astype(np.int64).astype(object)
    if most * most * len(values) < 2**62:
        return (values.T @ values).astype(object)
    return values.T.astype(object) @ values.astype(object)


def covariance(rows: DataFrame, n: int, sums: tuple[int, ...], settings: Settings) -> np.ndarray:
    """The covariance of x with divisor n: exact sums of products about the rounded means, rounded once at the end."""
    d = len(sums)
    centre = np.array([round(Fraction(s, n)) for s in sums], np.int64)

    def run(batches):
        total = None
        for batch in pieces(batches):
            part = products(integers(batch.column(0), settings) - centre)
            total = part if total is None else total + part
        if total is not None:
            for i in range(d):  # a row of the matrix at a time
                yield pa.RecordBatch.from_pydict(
                    {"i": pa.array(np.full(d - i, i), pa.int32()), "j": pa.array(range(i, d), pa.int32()), "q": pa.array([Decimal(int(v)) for v in total[i, i:]], pa.decimal128(38, 0))}
                )

    parts = rows.select("c").mapInArrow(run, "i int, j int, q decimal(38,0)")
    left = [s - n * int(c) for s, c in zip(sums, centre, strict=True)]
    found = np.zeros((d, d))
    for r in parts.groupBy("i", "j").agg(F.sum("q").cast("decimal(38,0)").alias("q")).toLocalIterator():
        found[r.i, r.j] = found[r.j, r.i] = float(Fraction(n * int(r.q) - left[r.i] * left[r.j], n * n))
    return found


def above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix exceed `shift`: the positive pivots of LDL' of the shifted matrix.

    Pivots are single or pairs, chosen by their size as Bunch and Kaufman do; by Sylvester's law of inertia their signs
    are those of the eigenvalues less the shift. A pair has one pivot of each sign.
    """
    a = matrix - shift * np.eye(len(matrix))
    grow, positive, k, d = (1 + np.sqrt(17)) / 8, 0, 0, len(a)
    while k < d:
        if k == d - 1:
            return positive + int(a[k, k] > 0)
        column = np.abs(a[k + 1 :, k])
        r = k + 1 + int(column.argmax())
        most, own, step = column[r - k - 1], abs(a[k, k]), 1
        if most > 0 and own < grow * most:
            row = np.abs(a[r, k:])
            row[r - k] = 0
            other = row.max()
            if own * other < grow * most * most:
                step = 1 if abs(a[r, r]) >= grow * other else 2
                to = k + step - 1
                a[[to, r]] = a[[r, to]]
                a[:, [to, r]] = a[:, [r, to]]
        rest = slice(k + step, d)
        if step == 1:
            positive += int(a[k, k] > 0)
            if a[k, k] != 0:
                a[rest, rest] -= np.outer(a[rest, k], a[rest, k] / a[k, k])
        else:
            positive += 1
            pivot = a[k : k + 2, k : k + 2]
            a[rest, rest] -= a[rest, k : k + 2] @ np.linalg.solve(pivot, a[rest, k : k + 2].T)
        k += step
    return positive


def bounds(matrix: np.ndarray) -> tuple[float, float]:
    """Below and above all eigenvalues, by Gershgorin's discs."""
    radius = np.abs(matrix).sum(1) - np.abs(np.diag(matrix))
    low, high = float((np.diag(matrix) - radius).min()), float((np.diag(matrix) + radius).max())
    room = 1e-3 * max(high - low, abs(high), 1e-300)
    return low - room, high + room


def solved(matrix: np.ndarray, shift: float, b: np.ndarray) -> np.ndarray:
    """The solution for the shifted matrix; where that is singular to the last bit, for a shift next to it."""
    size = max(float(np.abs(matrix).max()), 1e-300)
    for nudge in (0.0, 1e-16, 4e-16, 1e-14):
        try:
            x = np.linalg.solve(matrix - (shift + nudge * size) * np.eye(len(matrix)), b)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(x).all():
            return x
    return b


def slice_of(matrix: np.ndarray, i: int, low: float, high: float, tight: float) -> tuple[float, float, int, int]:
    """A slice (low, high] with eigenvalue i, by bisection, and the first and last number of the eigenvalues in it.

    It ends with eigenvalue i alone in it, or as narrow as `tight`.
    """
    least, most = len(matrix), 0  # eigenvalues above low, above high
    while (least - most > 1) and high - low > tight:
        middle = (low + high) / 2
        count = above(matrix, middle)
        low, high, least, most = (middle, high, count, most) if count >= i else (low, middle, least, count)
    return low, high, most + 1, least


def eigenpair(matrix: np.ndarray, i: int) -> tuple[float, np.ndarray, int, int]:
    """Eigenvalue i, counted from the largest as 1, a unit vector and the numbers of those in its slice."""
    d = len(matrix)
    low, high = bounds(matrix)
    size = max(abs(low), abs(high))
    tight = 64 * d * np.finfo(float).eps * size
    low, high, first, last = slice_of(matrix, i, low, high, tight)
    if last > first:  # too close to tell apart: the block of the slice, and the vector of that rank in it
        block = np.random.default_rng(last).standard_normal((d, last - first + 1))
        for _ in range(4):
            block, _ = np.linalg.qr(solved(matrix, (low + high) / 2, block))
        _, turn = np.linalg.eigh(block.T @ matrix @ block)
        vector = block @ turn[:, ::-1][:, i - first]
        return float(vector @ matrix @ vector), vector, first, last
    start = np.random.default_rng(i).standard_normal(d)
    while True:
        shift, vector = (low + high) / 2, start / np.linalg.norm(start)
        for _ in range(12):
            x = solved(matrix, shift, vector)
            vector = x / np.linalg.norm(x)
            value = float(vector @ matrix @ vector)
            if np.linalg.norm(matrix @ vector - value * vector) <= tight:
                break
            shift = value if low <= value <= high else (low + high) / 2
        # the counts on both sides say whether it is number i
        if (above(matrix, value - tight) >= i > above(matrix, value + tight) and low - tight <= value <= high + tight) or high - low <= tight:
            return value, vector, i, i
        middle = (low + high) / 2
        low, high = (middle, high) if above(matrix, middle) >= i else (low, middle)


def eigenpairs(rows: DataFrame, matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues and their unit vectors (columns), each found by a task of its own."""
    spark = rows.sparkSession

    def run(pdfs):
        for pdf in pdfs:
            found = [(int(i), *eigenpair(matrix, int(i))) for i in pdf.i]
            yield pd.DataFrame({"i": [f[0] for f in found], "value": [f[1] for f in found], "vector": [f[2].tolist() for f in found], "first": [f[3] for f in found], "last": [f[4] for f in found]})

    each = spark.range(1, k + 1, numPartitions=min(k, 32)).withColumnRenamed("id", "i")
    found = sorted(each.mapInPandas(run, "i int, value double, vector array<double>, first int, last int").collect(), key=lambda r: r.i)
    values, vectors = np.array([r.value for r in found]), np.array([r.vector for r in found]).T
    # one block's vectors come from different tasks: made orthogonal here, the values by their quotients
    for r in found:
        if r.last > r.first and r.i > r.first:
            others = vectors[:, r.first - 1 : r.i - 1]
            own = vectors[:, r.i - 1] - others @ (others.T @ vectors[:, r.i - 1])
            vectors[:, r.i - 1] = own / np.linalg.norm(own)
            values[r.i - 1] = vectors[:, r.i - 1] @ matrix @ vectors[:, r.i - 1]
    return values, vectors


def fitted(rows: DataFrame, settings: Settings) -> Fit | None:
    """The fit over all `rows` (c); None without rows."""
    got = moments(rows, settings)
    if got is None:
        return None
    matrix = covariance(rows, *got, settings)
    values, vectors = eigenpairs(rows, matrix, min(settings.components, len(matrix)))
    rank = int((values > RANK * max(values[0], 0)).sum())
    return Fit(*got, matrix, values, vectors, rank)


def projected(x: np.ndarray, fit: Fit, map_: np.ndarray) -> np.ndarray:
    """Whitened rows: (n x - S) / n, the numerator exact, on the scaled vectors."""
    if int(np.abs(x).max(initial=0)) * fit.n >= 2**62:
        return ((x.astype(object) * fit.n - np.array(fit.sums, object)).astype(float) / fit.n) @ map_
    return ((x * fit.n - np.array(fit.sums, np.int64)).astype(float) / fit.n) @ map_


def deviations(x: np.ndarray, fit: Fit) -> list[int]:
    """The exact sum of (n x - S)^2 of each row."""
    y = x.astype(object) * fit.n - np.array(fit.sums, object) if int(np.abs(x).max(initial=0)) * fit.n >= 2**62 else x * fit.n - np.array(fit.sums, np.int64)
    most = int(np.abs(y).max(initial=0))
    return [int(v) for v in ((y * y).sum(1) if most * most * y.shape[1] < 2**62 else (y.astype(object) ** 2).sum(1))]


def scaled_vectors(fit: Fit) -> np.ndarray:
    return fit.vectors[:, : fit.rank] / np.sqrt(fit.values[: fit.rank])


def identity_error(rows: DataFrame, fit: Fit, settings: Settings) -> float:
    """The largest entry, in size, of the covariance of the whitened rows less the identity.

    Tasks centre their rows before multiplying, and parts are merged with what their means differ by.
    """
    map_, k = scaled_vectors(fit), fit.rank
    if not k:
        return 0.0

    def run(batches):
        n, mean, about = 0, np.zeros(k), np.zeros((k, k))
        for batch in pieces(batches):
            w = projected(integers(batch.column(0), settings), fit, map_)
            m = w.mean(0)
            gap, centred = m - mean, w - m
            about += centred.T @ centred + np.outer(gap, gap) * (n * len(w) / (n + len(w)))
            n, mean = n + len(w), mean + gap * (len(w) / (n + len(w)))
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "mean": [mean.tolist()], "about": [about.ravel().tolist()]})

    parts = rows.select("c").mapInArrow(run, "n long, mean array<double>, about array<double>")
    overall = parts.select(F.posexplode("mean").alias("i", "m"), "n").groupBy("i").agg((F.sum(F.col("m") * F.col("n")) / fit.n).alias("m")).collect()
    mean = np.zeros(k)
    for r in overall:
        mean[r.i] = r.m
    # about the overall mean: what a part's own mean differs by comes on top
    lit = F.array(*map(F.lit, mean.tolist()))
    gaps = parts.select("n", "about", F.zip_with("mean", lit, lambda x, y: x - y).alias("gap"))
    entries = gaps.select("n", "gap", F.posexplode("about").alias("at", "v"))
    i, j = F.floor(F.col("at") / k).cast("int"), (F.col("at") % k).cast("int")
    entry = F.col("v") + F.col("n") * F.get("gap", i) * F.get("gap", j)
    total = entries.select("at", entry.alias("v")).groupBy("at").agg((F.sum("v") / fit.n).alias("v"))
    same = F.when(F.floor(F.col("at") / k) == F.col("at") % k, 1.0).otherwise(0.0)
    return float(total.agg(F.max(F.abs(F.col("v") - same))).first()[0])


def whiten(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """vec_id, component, n, deviation (decimal), whitened, explained and identity_error."""
    schema = f"vec_id {dict(vectors.dtypes)['vec_id']}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    rows = fit_rows(vectors)
    fit = fitted(rows, settings)
    if fit is None:
        return vectors.sparkSession.createDataFrame([], schema)
    error, map_, k = identity_error(rows, fit, settings), scaled_vectors(fit), len(fit.values)
    trace = float(np.trace(fit.covariance))
    explained = (np.maximum(fit.values, 0) / trace) if trace > 0 else np.full(k, np.nan)

    def run(batches):
        for batch in pieces(batches):
            x = integers(batch.column(1), settings)
            w = np.full((len(x), k), np.nan)
            w[:, : fit.rank] = projected(x, fit, map_)
            each = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), fit.n, np.int64)),
                    pa.array([Decimal(v) for v in deviations(x, fit)], pa.decimal128(38, 0)).take(each), pa.array(w.ravel(), from_pandas=True),
                    pa.array(np.tile(explained, len(x)), from_pandas=True), pa.array(np.full(len(each), error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.select("vec_id", "c").mapInArrow(run, schema)
