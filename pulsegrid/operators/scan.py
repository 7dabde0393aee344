"""Linear recurrences over ordered series as a parallel scan: exponential means and recursive filters of any length.

A recurrence keeps a state s; a value x makes y = C s + D x and then s = A s + B x. A run of values acts on the state as
one affine map, s -> A^n s + e. Frames are dealt by ranges of session and order, so a long session spreads over many
tasks; each task finds the maps of its runs, these are composed run by run (a row for each task and session, no frames),
and a second pass starts every run from the state that reaches it. No session is held or numbered in one task. Factors of
a banded matrix change along a series, so its two substitutions carry the product of their steps as a run's matrix.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..config import Band
from ..sources.shared import drop, written
from .kernels import bandpass_design, least_samples, trend_factor
from .quantiles import joined

#: Values that one product of matrices takes on.
STEP = 64


@dataclass(frozen=True)
class Recurrence:
    """Matrices of a recurrence, and the state at rest for a constant input of 1, from which a series starts."""

    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    d: float
    rest: np.ndarray

    @staticmethod
    def smoothing(alpha: float) -> Recurrence:
        """An exponential mean; an alpha of 1 or more leaves values, 0 or less the first one."""
        alpha = min(max(alpha, 0.0), 1.0)
        return Recurrence(np.array([[1 - alpha]]), np.array([alpha]), np.array([1 - alpha]), alpha, np.ones(1))

    @staticmethod
    def bandpass(fps: float, band: Band, order: int) -> Recurrence:
        """The sections of a Butterworth band-pass, one after the other, as one recurrence of two states a section."""
        low, high = band.low_hz / (fps / 2), band.high_hz / (fps / 2)
        if not 0 < low < high < 1:
            raise ValueError("banda_invalida")
        a, b, c, d = np.zeros((0, 0)), np.zeros(0), np.zeros(0), 1.0
        for num, den in zip(*bandpass_design(low, high, order), strict=True):
            own = np.array([[-den[1], 1.0], [-den[2], 0.0]])
            into = np.array([num[1] - den[1] * num[0], num[2] - den[2] * num[0]])
            k = len(a)
            a = np.block([[a, np.zeros((k, 2))], [np.outer(into, c), own]])
            b = np.concatenate([b, into * d])
            c, d = np.concatenate([num[0] * c, [1.0, 0.0]]), num[0] * d
        return Recurrence(a, b, c, d, np.linalg.solve(np.eye(len(a)) - a, b))

    def powers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What a state and `STEP` values give: outputs by state and by values, the next state by state and by values."""
        k, m = len(self.b), STEP
        by_state, reach = np.empty((m, k)), np.empty((k, m))
        row, column = self.c.copy(), self.b.copy()
        for i in range(m):
            by_state[i], reach[:, m - 1 - i] = row, column
            row, column = row @ self.a, self.a @ column
        answer = np.concatenate([[self.d], by_state[: m - 1] @ self.b])
        lag = np.subtract.outer(np.arange(m), np.arange(m))
        return by_state, np.where(lag >= 0, answer[np.maximum(lag, 0)], 0.0), np.linalg.matrix_power(self.a, m), reach

    def start(self, first: float) -> np.ndarray:
        return self.rest * first

    def matrix(self, n: int) -> np.ndarray:
        """What n values of 0 make of a state."""
        return np.linalg.matrix_power(self.a, n)

    def run(self, x: np.ndarray, state: np.ndarray, outputs: bool = True) -> tuple[np.ndarray | None, np.ndarray]:
        """Outputs of a run, if wanted, and the state after it."""
        by_state, by_value, power, reach = self.powers()
        whole = len(x) // STEP * STEP
        blocks = x[:whole].reshape(-1, STEP)
        before = np.empty((len(blocks), len(state)))
        into = blocks @ reach.T
        for k in range(len(blocks)):
            before[k] = state
            state = power @ state + into[k]
        y = np.empty(len(x)) if outputs else None
        if outputs:
            y[:whole] = (before @ by_state.T + blocks @ by_value.T).ravel()
        for k in range(whole, len(x)):
            if outputs:
                y[k] = self.c @ state + self.d * x[k]
            state = self.a @ state + self.b * x[k]
        return y, state


@dataclass(frozen=True)
class Substitution:
    """Solves L z = x, then z / d (forwards), or L' y = z (backwards), for the factors L d L' of I + strength^2 D'D.

    Along a series the factors settle; `table` has them up to there and for the last rows. Rows are told by their place.
    """

    strength: float
    forwards: bool

    @property
    def b(self) -> np.ndarray:
        return np.zeros(2)

    def start(self, first: float) -> np.ndarray:
        return np.zeros(2)

    def factors(self, place: np.ndarray, total: int) -> tuple[np.ndarray, ...]:
        """d and the weights of the two rows before (or after) each place."""
        settled, (d, e, f) = settled_factors(self.strength)
        if total <= len(d):
            d, e, f = trend_factor(total, self.strength)
            at = place
        else:
            at = np.where(place < settled, place, np.where(place >= total - 4, place - total + len(d), settled))
        if not self.forwards:
            return d[at], e[at], f[at]
        return d[at], np.where(at > 0, e[np.maximum(at - 1, 0)], 0.0), np.where(at > 1, f[np.maximum(at - 2, 0)], 0.0)

    def parts(self, place: np.ndarray, total: int) -> Iterator[tuple[slice, bool]]:
        """Pieces of a run, and whether their factors are settled."""
        settled, (d, _, _) = settled_factors(self.strength)
        same = (place >= settled + 2) & (place < total - 4) & (total > len(d))
        at = [0, *(np.flatnonzero(np.diff(same)) + 1).tolist(), len(place)]
        for start, end in zip(at[:-1], at[1:], strict=True):
            yield slice(start, end), bool(same[start])

    def constant(self) -> tuple[float, Recurrence]:
        settled, (d, e, f) = settled_factors(self.strength)
        row = np.array([-e[settled], -f[settled]])
        return d[settled], Recurrence(np.array([row, [1.0, 0.0]]), np.array([1.0, 0.0]), row, 1.0, np.zeros(2))

    def run(self, x: np.ndarray, state: np.ndarray, outputs: bool = True, place: np.ndarray | None = None, total: int = 0):
        y = np.empty(len(x))
        for own, same in self.parts(place, total):
            if same:
                d, constant = self.constant()
                made, state = constant.run(x[own], state)
                y[own] = made / d if self.forwards else made
                continue
            d, one, two = self.factors(place[own], total)
            (a, b), made = state.tolist(), []
            for v, p, q in zip(x[own].tolist(), one.tolist(), two.tolist(), strict=True):
                a, b = v - p * a - q * b, a
                made.append(a)
            state = np.array([a, b])
            y[own] = np.array(made) / d if self.forwards else made
        return y, state

    def product(self, place: np.ndarray, total: int) -> np.ndarray:
        """What values of 0 at these places make of a state."""
        made = np.eye(2)
        for own, same in self.parts(place, total):
            if same:
                made = self.constant()[1].matrix(own.stop - own.start) @ made
                continue
            _, one, two = self.factors(place[own], total)
            for p, q in zip(one.tolist(), two.tolist(), strict=True):
                made = np.array([-p * made[0] - q * made[1], made[0]])
        return made


@lru_cache(maxsize=8)
def settled_factors(strength: float) -> tuple[int, tuple[np.ndarray, ...]]:
    """From which row on the factors stay as they are, and a table of some rows beyond it."""
    n = 512
    while True:
        d, e, f = trend_factor(n, strength)
        # rows of the same matrix, a quarter of it apart
        if abs(e[n - 5] - e[n // 2]) <= 1e-15 * abs(e[n - 5]) and abs(d[n - 5] - d[n // 2]) <= 1e-15 * abs(d[n - 5]):
            return n - 6, (d, e, f)
        n *= 2


def dealt(frames: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """`frames` by ranges of keys and order, with `_run`, the range: written, so that later passes see the same ranges."""
    return written(frames.repartitionByRange(*keys, order).withColumn("_run", F.spark_partition_id()))


def _groups(batches: Iterator[pa.RecordBatch], by: Sequence[str]) -> Iterator[tuple[pa.Table, bool]]:
    """Pieces of sorted rows that lie in one group, and whether a piece begins its group."""
    last = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        new = np.zeros(table.num_rows - 1, bool)
        for k in by:
            column = table[k]
            differ = pc.fill_null(pc.not_equal(column[1:], column[:-1]), False)
            new |= np.asarray(differ) | (np.asarray(column[1:].is_null()) != np.asarray(column[:-1].is_null()))
        at = [0, *(np.flatnonzero(new) + 1).tolist(), table.num_rows]
        for start, end in zip(at[:-1], at[1:], strict=True):
            key = tuple(table[k][start].as_py() for k in by)
            yield table.slice(start, end - start), key != last
            last = key


def recurred(
    runs: DataFrame, column: str, recurrence: Recurrence | Substitution, out: str, keys: Sequence[str] = ("session",), order: str = "i", backwards: bool = False
) -> DataFrame:
    """`runs`, as `dealt` gives them, with `out`, what the recurrence makes of a column, from its last row on if `backwards`.

    Nulls make all later values null. The runs of a session meet as one row each. A substitution reads `_place`, `_total`.
    """
    by, k = [*keys, "_run"], len(recurrence.b)
    varies = isinstance(recurrence, Substitution)
    turn = F.desc if backwards else F.asc
    kinds = dict(runs.dtypes)
    types = {f.name: to_arrow_type(f.dataType) for f in runs.schema.fields if f.name in by}
    used = list(dict.fromkeys([*by, order, column, *(("_place", "_total") if varies else ())]))

    def where(piece: pa.Table) -> tuple:
        return (piece["_place"].to_numpy(), piece["_total"][0].as_py()) if varies else ()

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for piece, new in _groups(batches, by):
            x = piece[column].to_numpy().astype(float)
            if new:
                if held is not None:
                    yield _batch(held)
                held = [[piece[b][0].as_py() for b in by], 0, float(x[0]), np.zeros(k), np.eye(k)]
            held[1] += len(x)
            held[3] = recurrence.run(x, held[3], False, *where(piece))[1]
            if varies:
                held[4] = recurrence.product(*where(piece)) @ held[4]
        if held is not None:
            yield _batch(held)

    def _batch(held) -> pa.RecordBatch:
        key, n, first, state, product = held
        columns = {b: pa.array([v], types[b]) for b, v in zip(by, key, strict=True)}
        matrix = product if varies else recurrence.matrix(n)
        return pa.RecordBatch.from_pydict({**columns, "_first": [first], "_e": [state.tolist()], "_a": [matrix.ravel().tolist()]})

    of_keys = ", ".join(f"`{b}` {kinds[b]}" for b in by)
    sorted_ = runs.select(*used).repartition(*by).sortWithinPartitions(*by, turn(order))
    summed = sorted_.mapInArrow(maps, f"{of_keys}, _first double, _e array<double>, _a array<double>")

    def composed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_run", ascending=not backwards)
        state, before = recurrence.start(pdf["_first"].iloc[0]), []
        for a, e in zip(pdf["_a"], pdf["_e"], strict=True):
            before.append(state.tolist())
            state = np.asarray(a).reshape(k, k) @ state + np.asarray(e)
        return pdf[by].assign(_state=before)

    states = written(summed.groupBy(*keys).applyInPandas(composed, f"{of_keys}, _state array<double>"))
    started = joined(runs, states, by)

    def outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for piece, new in _groups(batches, by):
            if new:
                state = np.array(piece["_state"][0].as_py())
            y, state = recurrence.run(piece[column].to_numpy().astype(float), state, True, *where(piece))
            yield from piece.drop_columns(["_state"]).append_column(out, pa.array(y, from_pandas=True)).combine_chunks().to_batches()

    columns = [c for c in runs.columns if c != out]
    return started.repartition(*by).sortWithinPartitions(*by, turn(order)).select(*columns, "_state").mapInArrow(outputs, ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), f"`{out}` double"]))


def smoothed(frames: DataFrame, column: str, alpha: float, out: str, keys: Sequence[str] = ("session",), order: str = "i") -> DataFrame:
    """(keys, order, out): exponential smoothing that starts at the first value; alpha of 1 or more leaves values."""
    runs = dealt(frames.select(*keys, order, F.col(column).cast("double").alias("_x")), keys, order)
    return recurred(runs, "_x", Recurrence.smoothing(alpha), out, keys, order).select(*keys, order, out)


def placed(frames: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """`frames`, as `dealt` gives them, with `_place`, their number in the session from 0, and `_total`, how many it has.

    Counts of runs are added up before it, so frames are numbered run by run.
    """
    by = [*keys, "_run"]
    counts = frames.groupBy(*by).agg(F.count("*").alias("_c"))
    each = Window.partitionBy(*keys)
    counts = counts.select(*by, (F.sum("_c").over(each.orderBy("_run")) - F.col("_c")).alias("_before"), F.sum("_c").over(each).alias("_total"))
    return joined(frames, counts, by).withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1 + F.col("_before")).drop("_before")


def bandpassed(frames: DataFrame, column: str, fps: float, band: Band, out: str, filter_order: int = 4, keys: Sequence[str] = ("session",), order: str = "i") -> DataFrame:
    """(keys, order, out): the zero-phase band-pass of whole sessions, extended oddly at both ends.

    Sessions with fewer frames than the filter needs get null.
    """
    recurrence, pad = Recurrence.bandpass(fps, band, filter_order), least_samples(filter_order) - 1
    first = dealt(frames.select(*keys, F.col(order).alias("_o"), F.col(column).cast("double").alias("_x")), keys, "_o")
    known = written(placed(first, keys, "_o"))
    long = known.filter(F.col("_total") > pad)
    ends = long.filter((F.col("_place") == 0) | (F.col("_place") == F.col("_total") - 1)).groupBy(*keys).agg(F.min_by("_x", "_place").alias("_head"), F.max_by("_x", "_place").alias("_tail"))
    near = long.filter(F.col("_place").between(1, pad) | F.col("_place").between(F.col("_total") - 1 - pad, F.col("_total") - 2))
    near = joined(near, ends, keys)
    head = near.filter(F.col("_place") <= pad).select(*keys, (-F.col("_place")).alias("_place"), (2 * F.col("_head") - F.col("_x")).alias("_x"))
    tail = near.filter(F.col("_place") >= F.col("_total") - 1 - pad).select(*keys, (2 * (F.col("_total") - 1) - F.col("_place")).alias("_place"), (2 * F.col("_tail") - F.col("_x")).alias("_x"))
    none = F.lit(None)
    longer = long.select(*keys, "_place", "_x", "_o", F.lit(True).alias("_own"))
    for more in (head, tail):
        longer = longer.unionByName(more.select("*", none.cast(frames.schema[order].dataType).alias("_o"), F.lit(False).alias("_own")))
    runs = dealt(longer, keys, "_place")
    forth = written(recurred(runs, "_x", recurrence, "_y", keys, "_place"))
    back = recurred(forth, "_y", recurrence, "_z", keys, "_place", backwards=True).filter("_own").select(*keys, F.col("_o").alias(order), F.col("_z").alias(out))
    short = known.filter(F.col("_total") <= pad).select(*keys, F.col("_o").alias(order), none.cast("double").alias(out))
    drop(first, runs)
    return back.unionByName(short)


def detrended(frames: DataFrame, column: str, out: str, strength: float = 100.0, keys: Sequence[str] = ("session",), order: str = "i") -> DataFrame:
    """(keys, order, out): whole sessions less their smooth trend; only the mean goes under 4 frames or without strength."""
    first = dealt(frames.select(*keys, F.col(order).alias("_o"), F.col(column).cast("double").alias("_x")), keys, "_o")
    if strength <= 0:
        means = first.groupBy(*keys).agg(F.avg("_x").alias("_m"))
        return joined(first, means, keys).select(*keys, F.col("_o").alias(order), (F.col("_x") - F.col("_m")).alias(out))
    known = written(placed(first, keys, "_o"))
    drop(first)
    forth = written(recurred(known.filter("_total >= 4"), "_x", Substitution(strength, True), "_w", keys, "_place"))
    back = recurred(forth, "_w", Substitution(strength, False), "_y", keys, "_place", backwards=True)
    few = known.filter("_total < 4")
    short = joined(few, few.groupBy(*keys).agg(F.avg("_x").alias("_y")), keys)
    return back.select(*keys, "_o", "_x", "_y").unionByName(short.select(*keys, "_o", "_x", "_y")).select(*keys, F.col("_o").alias(order), (F.col("_x") - F.col("_y")).alias(out))
