"""Recursions with unbounded memory, run by blocks, and bounded units that only a loop can decode.

A ``Scan`` is a recursion whose effect over a whole block is a function with a few
numbers. Blocks are summed up in parallel, and so are groups of ``CHAIN`` blocks; the
groups' summaries are chained per key (one short row for CHAIN * BLOCK samples), and
the blocks run again from the states that reach them. No task sees a whole key's samples.

Tasks hold the blocks of an Arrow batch as matrices, time by block, and step through
time for all blocks at once, so many short keys cost no more than one long one.

Order columns are integers, unique within a key; a null sample counts as zero.
Columns made on the way begin with an underscore. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.operators.ordered import BLOCK

#: Blocks whose summaries are chained in one row.
CHAIN = 4096
#: Cells of a matrix that a task steps through at once, about.
CELLS = 1 << 21


@dataclass(frozen=True)
class Scan:
    """start: the first state; step: one sample of each row (or several values of it, row x value) and their states (row x number) to outputs and next states;
    origins: the states whose images under a block sum it up, one after another; carry: a summary, the block's number of
    samples and a state to the next state; compose: a summary, the next one and its number of samples to that of both."""

    start: Sequence[float]
    step: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    origins: Sequence[Sequence[float]]
    carry: Callable[[np.ndarray, int, np.ndarray], np.ndarray]
    compose: Callable[[np.ndarray, np.ndarray, int], np.ndarray]

    def run(self, x: np.ndarray, s: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Outputs and last states of rows, longest first; x is time by row (by value), live the number of rows at each time."""
        y, s = np.zeros(x.shape[:2]), np.array(s, float)
        for k, m in enumerate(live):
            y[k, :m], s[:m] = self.step(x[k, :m], s[:m])
        return y, s

    def summarise(self, x: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Row by number: the images of the origins."""
        return np.concatenate([self.run(x, np.tile(np.asarray(o, float), (x.shape[1], 1)), live)[1] for o in self.origins], axis=1)


def linear(a, b, c, d: float) -> Scan:
    """The linear system s' = a s + b x, y = c s + d x; zero at first."""
    a, b, c = (np.asarray(m, float) for m in (a, b, c))

    def step(x: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return s @ c + d * x, s @ a.T + x[:, None] * b

    def carry(own: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
        return np.linalg.matrix_power(a, n) @ s + own

    zero = [0.0] * len(b)
    return Scan(zero, step, [zero], carry, lambda first, then, n: carry(then, n, first))


def affine(start: Sequence[float], step: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> Scan:
    """A system whose next state is a matrix times the state plus a vector, both made from the sample at hand.

    A block is summed up by the product of its matrices: the images of zero and of the
    unit vectors. Coefficients may depend on the data in any way, but not on the state.
    """
    d = len(start)

    def parts(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        images = own.reshape(d + 1, d)
        return images[0], (images[1:] - images[0]).T

    def carry(own: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
        moved, turn = parts(own)
        return turn @ s + moved

    def compose(first: np.ndarray, then: np.ndarray, n: int) -> np.ndarray:
        return np.concatenate([carry(then, n, image) for image in first.reshape(d + 1, d)])

    return Scan(start, step, [[0.0] * d, *np.eye(d).tolist()], carry, compose)


def smoothing(keep: float) -> Scan:
    """One-pole smoothing: y = keep * y + (1 - keep) * x."""
    return linear([[keep]], [1 - keep], [keep], 1 - keep)


def biquad(b0: float, b1: float, b2: float, a1: float, a2: float) -> Scan:
    """A second-order section, transposed direct form II."""
    return linear([[-a1, 1], [-a2, 0]], [b1 - a1 * b0, b2 - a2 * b0], [1, 0], b0)


def cascade(sections: Sequence[tuple[float, float, float, float, float]]) -> Scan:
    """Second-order sections one behind another, as one linear system of two numbers a section."""
    a, b, c, d = np.zeros((0, 0)), np.zeros(0), np.zeros(0), 1.0
    for b0, b1, b2, a1, a2 in sections:
        n = len(b)
        own_a, own_b = np.array([[-a1, 1], [-a2, 0]]), np.array([b1 - a1 * b0, b2 - a2 * b0])
        a = np.block([[a, np.zeros((n, 2))], [np.outer(own_b, c), own_a]])
        b, c, d = np.concatenate([b, own_b * d]), np.concatenate([b0 * c, [1.0, 0.0]]), b0 * d
    return linear(a, b, c, d)


def low_pass(cutoff: float, q: float = 0.7071067811865476) -> tuple[float, float, float, float, float]:
    """b0, b1, b2, a1, a2 of the textbook low-pass; cutoff as a share of the sample rate."""
    w = 2 * np.pi * cutoff
    alpha, cos = np.sin(w) / (2 * q), np.cos(w)
    return tuple(float(v / (1 + alpha)) for v in ((1 - cos) / 2, 1 - cos, (1 - cos) / 2, -2 * cos, 1 - alpha))


def all_pass(cutoff: float, q: float = 0.7071067811865476) -> tuple[float, float, float, float, float]:
    """b0, b1, b2, a1, a2 of the textbook all-pass: the phase turns around cutoff, the level stays."""
    w = 2 * np.pi * cutoff
    alpha, cos = np.sin(w) / (2 * q), np.cos(w)
    return tuple(float(v / (1 + alpha)) for v in (1 - alpha, -2 * cos, 1 + alpha, -2 * cos, 1 - alpha))


def peaking(centre: float, gain_db: float, q: float = 1.0) -> tuple[float, float, float, float, float]:
    """b0, b1, b2, a1, a2 of the textbook peaking equaliser."""
    w, up = 2 * np.pi * centre, 10 ** (gain_db / 40)
    alpha, cos = np.sin(w) / (2 * q), np.cos(w)
    return tuple(float(v / (1 + alpha / up)) for v in (1 + alpha * up, -2 * cos, 1 - alpha * up, -2 * cos, 1 - alpha / up))


def envelope(release: float) -> Scan:
    """Instant attack, exponential release: y = max(|x|, release * y)."""

    def step(x: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = np.maximum(np.abs(x), s[:, 0] * release)
        return y, y[:, None]

    def carry(own: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
        return np.maximum(own, s * release**n)

    return Scan([0.0], step, [[0.0]], carry, lambda first, then, n: carry(then, n, first))


def steered_centre(fast: float, slow: float, level: float) -> Scan:
    """What two channels (left, right) have in common: their mid, weighed by its share in the energy of mid and side.

    Both energies are smoothed, by fast where the louder channel passes the level and by
    slow elsewhere; where both are zero the centre is zero.
    """

    def step(x: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mid, side = (x[:, 0] + x[:, 1]) / 2, (x[:, 0] - x[:, 1]) / 2
        keep = np.where(np.abs(x).max(axis=1) > level, fast, slow)[:, None]
        energy = keep * s + (1 - keep) * np.stack([mid * mid, side * side], axis=1)
        total = energy.sum(axis=1)
        return mid * np.divide(energy[:, 0], total, out=np.zeros_like(total), where=total > 0), energy

    return affine([0.0, 0.0], step)


def released_gain(keep: float) -> Scan:
    """A gain that drops at once to its target and recovers: g = min(target, keep * g + (1 - keep)); 1 at first."""

    def step(x: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = np.minimum(x, keep * s[:, 0] + (1 - keep))
        return y, y[:, None]

    def carry(own: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
        return np.minimum(own, 1 - keep**n + keep**n * s)

    return Scan([1.0], step, [[np.inf]], carry, lambda first, then, n: carry(then, n, first))


def gate(level: float, up: int, down: int, top: int) -> Scan:
    """A gate's opening: up a step where |x| passes the level, down a step elsewhere, within 0 and top; closed at first.

    The openings are a machine's states.
    """

    def step(x: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = np.clip(s[:, 0] + np.where(np.abs(x) > level, up, -down), 0, top)
        return y, y[:, None]

    return machine(top + 1, 0, step)


def machine(states: int, start: int, step: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> Scan:
    """A machine of a few states, numbered from 0: a block is the map from each state to the one behind it."""

    def at(own: np.ndarray, s: np.ndarray) -> np.ndarray:
        return own[s.astype(int)]

    return Scan([float(start)], step, [[float(k)] for k in range(states)], lambda own, n, s: at(own, s), lambda first, then, n: at(then, first))


def _packed(df: DataFrame, key: list[str], order: str, columns: list[str]) -> DataFrame:
    """key and _rows: order and columns of each unit's rows, in order."""
    return df.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(order, *columns))).alias("_rows"))


def _grids(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Places of units, longest first, in groups that fill matrices of about CELLS cells."""
    places = np.argsort(-lengths, kind="stable")
    at = 0
    while at < len(places):
        n = max(1, CELLS // max(1, int(lengths[places[at]])))
        yield places[at : at + n]
        at += n


def _units(rows: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, list[pa.Array], tuple[np.ndarray, np.ndarray], np.ndarray]]:
    """Groups of units of a list column: their places, lengths, flat fields, (time, row) of each flat sample, and rows at each time."""
    lengths = pc.list_value_length(rows).to_numpy(zero_copy_only=False)
    for places in _grids(lengths):
        own = rows.take(pa.array(places))
        n = lengths[places]
        ends = np.cumsum(n)
        row = np.repeat(np.arange(len(n)), n)
        time = np.arange(int(ends[-1])) - np.repeat(ends - n, n)
        yield places, n, own.flatten().flatten(), (time, row), np.bincount(time, minlength=int(n[0]) if len(n) else 0)


def _grid(field: pa.Array, at: tuple[np.ndarray, np.ndarray], shape: tuple[int, int], kind=float) -> np.ndarray:
    out = np.zeros(shape, kind)
    out[at] = pc.fill_null(field.cast(pa.float64() if kind is float else pa.int64()), 0).to_numpy(zero_copy_only=False)
    return out


def _samples(fields: list[pa.Array], at: tuple[np.ndarray, np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """One field as time by row, or several as time by row by field."""
    return _grid(fields[0], at, shape) if len(fields) == 1 else np.stack([_grid(f, at, shape) for f in fields], axis=2)


def scan(df: DataFrame, key: str, order: str, value: str | Sequence[str], how: Scan, name: str = "y", block: int = BLOCK) -> DataFrame:
    """key, order, value (or several) and name: the recursion's output at each row."""
    kinds = dict(df.dtypes)
    key_type = f"`{key}` {kinds[key]}"
    values = [value] if isinstance(value, str) else list(value)
    cut = df.select(key, order, *values, F.floor(F.col(order) / block).cast("long").alias("_blk"))
    packed = _packed(cut, [key, "_blk"], order, values)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, n, fields, at, live in _units(batch.column(2)):
                own = how.summarise(_samples(fields[1:], at, (int(n[0]), len(n))), live)
                kept = batch.take(pa.array(places))
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(n, pa.int64()), pa.array(list(own), pa.list_(pa.float64()))], [key, "_blk", "_n", "_own"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = []
            for rows in batch.column(2).to_pylist():
                own, n = np.asarray(rows[0]["_own"]), rows[0]["_n"]
                for r in rows[1:]:
                    own, n = how.compose(own, np.asarray(r["_own"]), r["_n"]), n + r["_n"]
                whole.append((n, own))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([n for n, _ in whole], pa.int64()), pa.array([list(o) for _, o in whole], pa.list_(pa.float64()))], [key, "_sup", "_n", "_own"])

    def chain(place: str, first: bool):
        """The state before each row of _rows, from the start, or from the one in the last column."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column(1).to_pylist()
                begin = [how.start] * len(lists) if first else batch.column(2).to_pylist()
                at, places, states = [], [], []
                for k, rows in enumerate(lists):
                    s = np.asarray(begin[k], float)
                    for r in rows:
                        at.append(k)
                        places.append(r[place])
                        states.append(list(s))
                        s = how.carry(np.asarray(r["_own"]), r["_n"], s) if len(rows) > 1 else s
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(places, pa.int64()), pa.array(states, pa.list_(pa.float64()))], [key, place, "_state"])

        return run

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, n, fields, at, live in _units(batch.column(1)):
                states = np.array(batch.column(2).take(pa.array(places)).to_pylist(), float).reshape(len(n), -1)
                y, _ = how.run(_samples(fields[1:], at, (int(n[0]), len(n))), states, live)
                keys = batch.column(0).take(pa.array(np.repeat(places, n)))
                yield pa.RecordBatch.from_arrays([keys, *fields, pa.array(y[at])], [key, order, *values, name])

    own = packed.mapInArrow(summarise, f"{key_type}, _blk long, _n long, _own array<double>")
    sups = own.groupBy(key, F.floor(F.col("_blk") / CHAIN).cast("long").alias("_sup")).agg(F.sort_array(F.collect_list(F.struct("_blk", "_n", "_own"))).alias("_rows"))
    tops = sups.mapInArrow(merge, f"{key_type}, _sup long, _n long, _own array<double>")
    tops = tops.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_sup", "_n", "_own"))).alias("_rows")).mapInArrow(chain("_sup", True), f"{key_type}, _sup long, _state array<double>")
    tops = tops.withColumnRenamed(key, "_key").withColumnRenamed("_sup", "_top")
    met = sups.join(tops, sups[key].eqNullSafe(tops["_key"]) & (sups["_sup"] == tops["_top"])).select(key, "_rows", "_state")
    states = met.mapInArrow(chain("_blk", False), f"{key_type}, _blk long, _state array<double>").withColumnRenamed(key, "_key").withColumnRenamed("_blk", "_at")
    met = packed.join(states, packed[key].eqNullSafe(states["_key"]) & (packed["_blk"] == states["_at"])).select(key, "_rows", "_state")
    return met.mapInArrow(run, ", ".join([key_type, *(f"`{c}` {kinds[c]}" for c in (order, *values)), f"`{name}` double"]))


def decode_units(df: DataFrame, key: list[str], order: str, columns: dict[str, str], decode: Callable[[dict[str, np.ndarray], np.ndarray], dict[str, np.ndarray]]) -> DataFrame:
    """df's key and order with columns (name -> type long or boolean) decoded from each unit, in order.

    Units are of bounded length, such as a frame number's quotient. decode takes matrices
    of 64-bit integers, time by unit, for all other columns and the order column, and the
    number of units at each time; units are in order of length, longest first.
    """
    kinds = dict(df.dtypes)
    given = [c for c in df.columns if c not in (*key, order)]
    fields = ", ".join([*(f"`{c}` {kinds[c]}" for c in [*key, order]), *(f"`{n}` {t}" for n, t in columns.items())])
    types = {"long": pa.int64(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, n, flat, at, live in _units(batch.column(len(key))):
                made = decode({c: _grid(f, at, (int(n[0]), len(n)), int) for c, f in zip([order, *given], flat, strict=True)}, live)
                keys = batch.select(range(len(key))).take(pa.array(np.repeat(places, n)))
                yield pa.RecordBatch.from_arrays([*keys.columns, flat[0], *(pa.array(made[c][at]).cast(types[t]) for c, t in columns.items())], [*key, order, *columns])

    return _packed(df, key, order, given).mapInArrow(run, fields)


def spectrum(df: DataFrame, key: list[str], order: str, value: str, size: int = 32) -> DataFrame:
    """key, blk, bin, energy: |FFT|^2 of each whole block of size samples, bins 0 to size / 2."""
    rows = df.groupBy(*key, F.floor(F.col(order) / size).cast("long").alias("blk")).agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("_s"))
    whole = rows.filter(F.size("_s") == size).select(*key, "blk", F.transform("_s", lambda s: s[value].cast("double")).alias("_x"))

    def run(batches):
        for pdf in batches:
            found = np.fft.rfft(np.stack(pdf["_x"])) if len(pdf) else np.zeros((0, size // 2 + 1))
            yield pdf.drop(columns="_x").assign(energy=list(found.real**2 + found.imag**2))

    kinds = ", ".join(f"`{n}` {t}" for n, t in whole.dtypes[:-1])
    return whole.mapInPandas(run, f"{kinds}, energy array<double>").select(*key, "blk", F.posexplode("energy").alias("bin", "energy"))
