"""Long convolutions by blocks: overlap-save over partitions of the response.

The response is cut into partitions of ``PART`` taps, each transformed once. A unit of
work is a stretch of whole blocks of one key with a halo of earlier blocks as long as
the response, so units need nothing from each other. Inside a unit every block is
transformed once; an output block is the sum of the blocks before it times the
partitions, transformed back. This takes log(PART) operations a sample and partition
where the direct sum takes PART, and memory for one unit.

A unit has four times as many blocks as its halo, so at most a quarter of the rows is
copied. Order columns are integers, unique within a key; a null sample and a
missing order value count as zero, and output is given at the signal's own rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.operators.ordered import with_halo

#: Taps of a partition, and samples of a block.
PART = 4096


class Response:
    """The transformed partitions of a response, for blocks of size samples."""

    def __init__(self, taps: Sequence[float], size: int = PART):
        self.size, taps = size, np.asarray(taps, float)
        self.parts = max(1, -(-len(taps) // size))
        cut = np.zeros((self.parts, size))
        cut.ravel()[: len(taps)] = taps
        self.spectra = np.fft.rfft(cut, 2 * size, axis=1)

    def apply(self, blocks: np.ndarray) -> np.ndarray:
        """Blocks (block by sample) convolved; the first ones lack what comes before them."""
        before = np.vstack([np.zeros((1, self.size)), blocks[:-1]])
        spectra = np.fft.rfft(np.hstack([before, blocks]), axis=1)
        out = np.zeros_like(spectra)
        for k, part in enumerate(self.spectra[: len(blocks)]):
            out[k:] += spectra[: len(blocks) - k] * part
        return np.fft.irfft(out, axis=1)[:, self.size :]


def convolve(df: DataFrame, key: list[str], order: str, value: str, taps: dict[str, Sequence[float]], size: int = PART) -> DataFrame:
    """key, order and, for each name in taps, the sum of tap k times the value k rows back.

    Several responses share the transforms of the signal.
    """
    kinds = dict(df.dtypes)
    responses = {n: Response(t, size) for n, t in taps.items()}
    halo = max(r.parts for r in responses.values())
    unit = 4 * halo * size
    told = df.sparkSession.sparkContext.broadcast(responses)
    cut = with_halo(df.select(*key, order, value), order, before=halo * size, block=unit)
    rows = cut.groupBy(*key, "_blk").agg(F.collect_list(F.struct(order, F.col(value).cast("double").alias("_x"), "_own")).alias("_rows"))
    names = [*key, order, *taps]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                place, x, own = batch.column(len(key) + 1).slice(k, 1).flatten().flatten()
                own = own.to_numpy(zero_copy_only=False)
                if not own.any():
                    continue
                first = batch.column(len(key))[k].as_py() * unit - halo * size
                at = place.to_numpy(zero_copy_only=False) - first
                grid = np.zeros(halo * size + unit)
                grid[at] = pc.fill_null(x, 0.0).to_numpy(zero_copy_only=False)
                blocks, own_at = grid.reshape(-1, size), at[own]
                made = [pa.array(r.apply(blocks).ravel()[own_at]) for r in told.value.values()]
                keys = [batch.column(j).take(pa.array(np.full(len(own_at), k))) for j in range(len(key))]
                yield pa.RecordBatch.from_arrays([*keys, place.filter(pa.array(own)), *made], names)

    fields = ", ".join([*(f"`{c}` {kinds[c]}" for c in [*key, order]), *(f"`{n}` double" for n in taps)])
    return rows.mapInArrow(run, fields)
