"""Structured Streaming forms of the stateful operators.

State is bounded per key: a re-blocker holds less than one unit, a lock one number,
and with ``timeout_ms`` both drop a key's state after so long without input (such
streams need a running trigger: one that ends with its input would wait). Input order within
a key is restored inside a micro-batch; rows of a later batch must come later.
Empty batches change nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SIGNAL = "channel string, frame long, x long"


def _gathered(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(batches), ignore_index=True).sort_values("frame")


def _timeout(timeout_ms: int | None) -> str:
    return GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout


def reblock(stream: DataFrame, size: int = 1024, timeout_ms: int | None = None) -> DataFrame:
    """channel, start, n, total of each whole unit of size rows; a shorter one when a channel falls silent for timeout_ms."""

    def run(key, batches, state: GroupState) -> Iterator[pd.DataFrame]:
        frames, samples = state.get if state.exists else ([], [])
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"channel": [key[0]], "start": [frames[0]], "n": [len(frames)], "total": [sum(samples)]})
            return
        new = _gathered(batches)
        frames, samples = [*frames, *new["frame"].tolist()], [*samples, *new["x"].tolist()]
        whole = len(frames) // size * size
        units = range(0, whole, size)
        yield pd.DataFrame({"channel": key[0], "start": [frames[k] for k in units], "n": size, "total": [sum(samples[k : k + size]) for k in units]})
        if whole < len(frames):
            state.update((frames[whole:], samples[whole:]))
            if timeout_ms:
                state.setTimeoutDuration(timeout_ms)
        elif state.exists:
            state.remove()

    return stream.groupBy("channel").applyInPandasWithState(
        run, "channel string, start long, n long, total long", "frames array<long>, samples array<long>", "append", _timeout(timeout_ms)
    )


def lock(stream: DataFrame, length: int = 5, divisor: int = 5, timeout_ms: int | None = None) -> DataFrame:
    """channel, frame of each packet's last row: a packet starts at a sync sample and has length rows; the lock is lost after timeout_ms."""

    def run(key, batches, state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        at, ends = state.get[0] if state.exists else -1, []
        for frame, x in _gathered(batches)[["frame", "x"]].itertuples(index=False):
            at = at + 1 if 0 <= at < length - 1 else 0 if x % divisor == 0 else -1
            if at == length - 1:
                ends.append(frame)
        state.update((at,))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame({"channel": key[0], "frame": ends})

    return stream.groupBy("channel").applyInPandasWithState(run, "channel string, frame long", "place int", "append", _timeout(timeout_ms))


def windowed(stream: DataFrame, time: str, key: str, value: str, width: str, late: str) -> DataFrame:
    """key, start, n, total per tumbling window; rows later than late are dropped with their window's state."""
    grouped = stream.withWatermark(time, late).groupBy(key, F.window(time, width).alias("_w"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(key, F.col("_w.start").alias("start"), "n", "total")


def sessions(stream: DataFrame, time: str, key: str, gap: str, late: str) -> DataFrame:
    """key, start, end, n of each session that gap ends."""
    grouped = stream.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("_w"))
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(key, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n")


def write_once(stream: DataFrame, path: str, checkpoint: str, change: Callable[[DataFrame], DataFrame] = lambda df: df):
    """A query that writes each micro-batch under its number, so that a batch done again replaces itself."""

    def put(df: DataFrame, number: int) -> None:
        change(df).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
