"""What a Python worker keeps between tasks: the tables of one operator at a time.

Workers are used again by later stages. An operator that asks for its store empties
those of the others, and a task gives freed memory back when it ends, so a pipeline
needs no more memory than its largest stage.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

_stores: dict[str, dict] = {}

#: Rows of an Arrow batch that are taken out of it at a time.
ROWS = 1024


def store(owner: str) -> dict:
    """The dict of an operator; emptied once another operator asks for its own."""
    others = [x for name, x in _stores.items() if name != owner and x]
    for other in others:
        other.clear()
    if others:
        release()
    return _stores.setdefault(owner, {})


def release() -> None:
    """Give memory that is free, but still held by this process, back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that handles at most ROWS rows of a batch at a time and releases memory when its task ends."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                yield batch.slice(start, ROWS)

    @functools.wraps(run)
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(parts(batches))
        release()

    return own
