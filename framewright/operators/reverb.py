"""Feedback delay networks: delay lines whose outputs are mixed and fed back into all of them.

A network's state is as long as its delay lines, too long for a ``Scan``. But a network
that decays forgets: what a state adds falls by the mixing matrix's norm with every
pass through a line. So a stretch of a key is run from silence, ``memory`` samples ahead
of its own: what came before them is below ``LEAST`` times its size by then, under the
rounding of doubles. Stretches need nothing from each other, and no task has a whole key.

Inside a stretch, as many samples as the shortest line holds are worked out at once.
Order columns are integers, unique within a key; a null sample and a missing order
value count as zero; output is given at the signal's own rows. A network that does not
decay is an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.operators.ordered import with_halo

#: What an old state may still add, as a share of its size.
LEAST = 1e-18


@dataclass(frozen=True)
class Network:
    """delays in samples; matrix: what each line takes (rows) from each line's output; into and out of: gains of the lines."""

    delays: Sequence[int]
    matrix: Sequence[Sequence[float]]
    into: Sequence[float]
    out: Sequence[float]

    @property
    def memory(self) -> int:
        """Samples after which a state is forgotten."""
        norm = float(np.linalg.norm(np.asarray(self.matrix, float), 2))
        if norm >= 1 or min(self.delays) < 1:
            raise ValueError(f"the network does not decay: its matrix has norm {norm:.3f}, its shortest line {min(self.delays)} samples")
        return max(self.delays) * (1 + math.ceil(math.log(LEAST) / math.log(norm)) if norm else 1)

    def run(self, x: np.ndarray) -> np.ndarray:
        """The outputs of one stretch, from silence."""
        matrix, into, out = (np.asarray(m, float) for m in (self.matrix, self.into, self.out))
        longest, step = max(self.delays), min(self.delays)
        lines = np.zeros((len(self.delays), longest + len(x)))
        y = np.zeros(len(x))
        for t in range(0, len(x), step):
            n = min(step, len(x) - t)
            heard = np.stack([own[longest + t - d : longest + t - d + n] for own, d in zip(lines, self.delays, strict=True)])
            lines[:, longest + t : longest + t + n] = into[:, None] * x[t : t + n] + matrix @ heard
            y[t : t + n] = out @ heard
        return y


def hadamard(lines: int, gain: float) -> list[list[float]]:
    """An even mixing of lines (a power of two) that keeps their energy, times gain."""
    made = np.array([[1.0]])
    while len(made) < lines:
        made = np.block([[made, made], [made, -made]])
    if len(made) != lines:
        raise ValueError("the number of lines is not a power of two")
    return (gain * made / math.sqrt(lines)).tolist()


def reverberate(df: DataFrame, key: list[str], order: str, value: str, network: Network, name: str = "y") -> DataFrame:
    """key, order and name: the network's output. A stretch has four times as many samples as the memory ahead of it."""
    kinds, memory = dict(df.dtypes), network.memory
    stretch = max(4 * memory, 4096)
    cut = with_halo(df.select(*key, order, value), order, before=memory, block=stretch)
    rows = cut.groupBy(*key, "_blk").agg(F.collect_list(F.struct(order, F.col(value).cast("double").alias("_x"), "_own")).alias("_rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                place, x, own = batch.column(len(key) + 1).slice(k, 1).flatten().flatten()
                own = own.to_numpy(zero_copy_only=False)
                if not own.any():
                    continue
                at = place.to_numpy(zero_copy_only=False) - (batch.column(len(key))[k].as_py() * stretch - memory)
                first = int(at.min())  # nothing sounds before
                grid = np.zeros(int(at.max()) + 1 - first)
                grid[at - first] = pc.fill_null(x, 0.0).to_numpy(zero_copy_only=False)
                made = network.run(grid)[at[own] - first]
                keys = [batch.column(j).take(pa.array(np.full(len(made), k))) for j in range(len(key))]
                yield pa.RecordBatch.from_arrays([*keys, place.filter(pa.array(own)), pa.array(made)], [*key, order, name])

    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in [*key, order]), f"`{name}` double"]))
