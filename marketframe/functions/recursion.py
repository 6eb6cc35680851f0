"""Recursions along a series, in blocks inside tasks.

``e_t = x_t - sum(theta_j * e_(t-j))`` has no window form, as every value needs the one
before. Series are dealt by symbol and sorted; a task goes through its rows batch by
batch and carries the last values, so a series of any length needs bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DateType, DoubleType, StringType, StructField, StructType

from ..config import DATE, SYMBOL

BLOCK = 64


def inverse_filter(x: np.ndarray, theta: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """The solution ``e`` for the columns of ``x``; ``before`` has the values ahead of the
    first, newest first (zeros without it)."""
    q, n = len(theta), len(x)
    if not q or not n:
        return x.copy()
    shape = (n + q, *x.shape[1:])
    e = np.zeros(shape)
    if before is not None:
        e[:q] = before[::-1]
    size = min(BLOCK, n)
    response = np.zeros(size)
    response[0] = 1.0
    for t in range(1, size):
        k = min(t, q)
        response[t] = -np.dot(theta[:k], response[t - k : t][::-1])
    at = np.arange(size)
    square = np.where(at[:, None] >= at, response[np.abs(at[:, None] - at)], 0.0)
    for start in range(0, n, size):
        end = min(start + size, n)
        known = x[start:end].copy()
        for t in range(min(q, end - start)):
            # What values before the block add to its first places.
            for j in range(t + 1, q + 1):
                known[t] -= theta[j - 1] * e[q + start + t - j]
        e[q + start : q + end] = square[: end - start, : end - start] @ known
    return e[q:]


@dataclass
class State:
    """A model and where its series stands: last level, last ``p`` values and ``q`` innovations, newest first."""

    d: int
    const: float
    phi: np.ndarray
    theta: np.ndarray
    level: float = np.nan
    z: np.ndarray = field(default_factory=lambda: np.empty(0))
    e: np.ndarray = field(default_factory=lambda: np.empty(0))

    def next_value(self) -> float:
        """The expected next level; values that do not exist yet count as 0."""
        step = self.const + float(self.phi[: len(self.z)] @ self.z) + float(self.theta[: len(self.e)] @ self.e)
        enough = len(self.z) >= min(len(self.phi) + len(self.theta), 1)
        if self.d:
            return self.level + step if enough else np.nan
        return step if enough and not np.isnan(self.level) else np.nan

    def advance(self, y: np.ndarray) -> np.ndarray:
        """Take new levels; returns what was expected of each."""
        expected = np.empty(len(y))
        p, q, done = len(self.phi), len(self.theta), 0
        # One by one until p values are there; innovations before that are 0.
        while done < len(y) and (len(self.z) < max(p, 1) or np.isnan(self.level)):
            expected[done] = self.next_value()
            z = y[done] - self.level if self.d else y[done]
            self.level = y[done]
            if not np.isnan(z):
                innovation = z - (self.const + float(self.phi @ self.z) + float(self.theta[: len(self.e)] @ self.e)) if len(self.z) >= p else 0.0
                self.z, self.e = np.append(z, self.z)[: max(p, 1)], np.append(innovation, self.e)[:q]
            done += 1
        rest = y[done:]
        if len(rest):
            z = np.diff(np.append(self.level, rest)) if self.d else rest
            past = np.concatenate([self.z[::-1], z])
            first = len(self.z)
            linear = np.full(len(z), self.const)
            for i, f in enumerate(self.phi, 1):
                linear += f * past[first - i : len(past) - i]
            before = np.zeros(q)
            before[: len(self.e)] = self.e
            e = inverse_filter(z - linear, self.theta, before)
            levels = np.append(self.level, rest[:-1]) if self.d else 0.0
            expected[done:] = levels + z - e
            self.level = float(rest[-1])
            self.z, self.e = past[::-1][: max(p, 1)].copy(), np.concatenate([before[::-1], e])[::-1][:q].copy()
        return expected


def _array(column: pa.Array, row: int) -> np.ndarray:
    value = column[row].as_py()
    return np.array(value if value is not None else [], float)


def _opened(batch: pa.RecordBatch, row: int) -> State:
    """The state that a row names, or the start of a series."""
    get = lambda c: batch.column(c)[row].as_py()
    state = State(int(get("d")), float(get("const")), _array(batch.column("phi"), row), _array(batch.column("theta"), row))
    if "last_y" in batch.schema.names and get("last_y") is not None:
        state.level, state.z, state.e = float(get("last_y")), _array(batch.column("_zs"), row), _array(batch.column("_es"), row)
    return state


def _runs(batches: Iterator[pa.RecordBatch]):
    """``batch, start, end, state``: rows of one symbol, with its state as it stands."""
    symbol, state = None, None
    for batch in batches:
        names = np.array(batch.column(SYMBOL).to_pylist(), dtype=object)
        cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)] if len(names) else [0]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if state is None or names[a] != symbol:
                symbol, state = names[a], _opened(batch, a)
            yield batch, a, b, state


def _taken(state: State, y: np.ndarray) -> np.ndarray:
    """Expected levels of rows, of which those without a level are skipped by the series."""
    out = np.full(len(y), np.nan)
    missing = np.isnan(y)
    start = 0
    for at in [*np.flatnonzero(missing).tolist(), len(y)]:
        out[start:at] = state.advance(y[start:at])
        if at < len(y):
            out[at] = state.next_value()
        start = at + 1
    return out


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition(SYMBOL).sortWithinPartitions(SYMBOL, DATE)


def expected_levels(rows: DataFrame) -> DataFrame:
    """The rows with ``_next``, the level expected from the rows before.

    Rows have ``_y`` (null: no level) and their model ``d, const, phi, theta``, and may have
    the state a series starts from in ``last_y, _zs, _es``.
    """

    def run(batches):
        waiting: list[np.ndarray] = []
        for batch, a, b, state in _runs(batches):
            y = batch.column("_y").slice(a, b - a).to_numpy(zero_copy_only=False).astype(float)
            waiting.append(_taken(state, y))
            if b == batch.num_rows:
                values = np.concatenate(waiting)
                column = pa.array(values, pa.float64(), mask=np.isnan(values))
                yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, "_next"])
                waiting = []

    return _sorted(rows).mapInArrow(run, StructType([*rows.schema.fields, StructField("_next", DoubleType())]))


STATE = StructType(
    [
        StructField(SYMBOL, StringType()), StructField("last_date", DateType()), StructField("last_y", DoubleType()),
        StructField("_zs", ArrayType(DoubleType())), StructField("_es", ArrayType(DoubleType())),
    ]
)


def last_states(rows: DataFrame) -> DataFrame:
    """The state of each symbol behind its last row: ``last_date, last_y, _zs, _es``."""

    def run(batches):
        ends: dict = {}
        open_symbol = None

        def closed(name):
            day, state = ends.pop(name)
            level = None if np.isnan(state.level) else float(state.level)
            row = [name], [day], [level], [state.z.tolist()], [state.e.tolist()]
            kinds = [pa.string(), pa.date32(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], STATE.names)

        for batch, a, b, state in _runs(batches):
            _taken(state, batch.column("_y").slice(a, b - a).to_numpy(zero_copy_only=False).astype(float))
            name = batch.column(SYMBOL)[a].as_py()
            if ends and name != open_symbol:
                yield closed(open_symbol)
            open_symbol = name
            ends[name] = (batch.column(DATE)[b - 1].as_py(), state)
        if ends:
            yield closed(open_symbol)

    return _sorted(rows).mapInArrow(run, STATE)
