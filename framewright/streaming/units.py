"""Units of a stream that has an identity: encoded whole or not at all, each once, the tail when its key falls silent.

``encode_units`` keeps, for every channel, its identity (the configuration that its first
row states), the samples of the unit that is not full yet, and an event-time timer. Its state is less than one
unit. Rows of another configuration are refused: they are given back as such and leave
the unit untouched. When the watermark passes a channel's last time by ``silence``, the rest
is padded with zeros and given as a last unit; then the channel is forgotten, so it may come back as
another stream.

``write_units`` puts what a micro-batch gives under the batch's number. A unit is one row, and a
batch counts once its files are committed; one that is done again after a
crash replaces itself from the same state. ``committed`` reads what is complete.

Needs Spark's RocksDB state store: ``spark.sql.streaming.stateStore.providerClass``.
Input order within a channel is restored inside a micro-batch; rows of a later batch
come later. Null samples count as zero.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from framewright.sources.wav import located, pcm

INPUT = "channel string, rate int, layout int, frame long, x long, ts timestamp"
#: kind is unit, tail or refused; payload holds the samples, the padding's included, as 24-bit PCM.
OUTPUT = "channel string, kind string, rate int, layout int, start long, n long, padded long, payload binary"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class UnitEncoder(StatefulProcessor):
    def __init__(self, size: int, silence_ms: int):
        self.size, self.silence = size, silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.identity = handle.getValueState("identity", "rate int, layout int")
        self.rest = handle.getValueState("rest", "frames array<long>, xs array<long>")
        self.due = handle.getValueState("due", "at long")

    def _row(self, channel: str, kind: str, shape: tuple[int, int], frames: list[int], xs: list[int]) -> tuple:
        payload = None
        if kind != "refused":
            payload = pcm(pd.Series(xs + [0] * (self.size - len(xs))).to_numpy("int64"), 3)
        return (channel, kind, *shape, frames[0], len(frames), self.size - len(frames) if payload is not None else 0, payload)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[x.split()[0] for x in OUTPUT.split(", ")])

    def _drained(self, channel: str) -> list[tuple]:
        """The padded rest of a channel, which is then forgotten."""
        frames, xs = map(list, self.rest.get())
        out = [self._row(channel, "tail", tuple(self.identity.get()), frames, xs)] if frames else []
        for state in (self.identity, self.rest, self.due):
            state.clear()
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        if self.due.exists() and self.due.get()[0] <= timerValues.getCurrentWatermarkInMs():  # rows come before the timers of their batch
            self.handle.deleteTimer(self.due.get()[0])
            out = self._drained(key[0])
        new = pd.concat(list(rows), ignore_index=True).sort_values("frame", kind="stable")
        shape = tuple(self.identity.get()) if self.identity.exists() else (int(new["rate"].iloc[0]), int(new["layout"].iloc[0]))
        own = (new["rate"] == shape[0]) & (new["layout"] == shape[1])
        out += [self._row(key[0], "refused", (int(r.rate), int(r.layout)), [int(r.frame)], []) for r in new[~own].itertuples()]
        if own.any():
            self.identity.update(shape)
            frames, xs = map(list, self.rest.get()) if self.rest.exists() else ([], [])
            frames += new.loc[own, "frame"].tolist()
            xs += new.loc[own, "x"].fillna(0).astype("int64").tolist()
            whole = len(frames) // self.size * self.size
            out += [self._row(key[0], "unit", shape, frames[k : k + self.size], xs[k : k + self.size]) for k in range(0, whole, self.size)]
            self.rest.update((frames[whole:], xs[whole:]))
            at = int(new.loc[own, "ts"].max().timestamp() * 1000) + self.silence
            if self.due.exists():
                at = max(at, self.due.get()[0])
                self.handle.deleteTimer(self.due.get()[0])
            self.due.update((at,))
            self.handle.registerTimer(at)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._frame(self._drained(key[0]))


def encode_units(stream: DataFrame, size: int = 1024, silence: str = "10 seconds", late: str = "1 second") -> DataFrame:
    """OUTPUT of a stream with the columns of INPUT; silence in event time ends a channel."""
    spark = stream.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKS:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKS}")
    silence_ms = int(pd.Timedelta(silence).total_seconds() * 1000)
    grouped = stream.withWatermark("ts", late).groupBy("channel")
    return grouped.transformWithStateInPandas(UnitEncoder(size, silence_ms), OUTPUT, "append", "eventTime")


def write_units(units: DataFrame, path: str, checkpoint: str, **trigger):
    """A running query that writes units under path, each micro-batch once; trigger as for ``DataStreamWriter.trigger``."""

    def put(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return units.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def committed(spark: SparkSession, path: str) -> DataFrame:
    """The units of all batches that are complete."""
    from pyarrow import fs

    store, inner = located(path)
    found = store.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True))
    done = sorted(x.path.rsplit("/", 2)[-2] for x in found if x.base_name == "_SUCCESS")
    if not done:
        return spark.createDataFrame([], OUTPUT)
    return spark.read.schema(OUTPUT).parquet(*[f"{path}/{d}" for d in done])


def units_of(signal: DataFrame, size: int = 1024) -> DataFrame:
    """channel, start, n, padded and payload of a whole table (channel, frame, x), as the stream gives them: the batch form."""
    sample = lambda x: F.concat(*[F.lpad(F.hex(F.shiftright(x, 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(3)])
    blocks = signal.groupBy("channel", F.floor(F.col("frame") / size).alias("_unit")).agg(F.sort_array(F.collect_list(F.struct("frame", F.coalesce("x", F.lit(0).cast("long")).alias("x")))).alias("_rows"))
    n = F.size("_rows")
    text = F.concat(F.array_join(F.transform("_rows", lambda r: sample(r["x"])), ""), F.repeat(F.lit("000000"), size - n))
    return blocks.select("channel", F.element_at("_rows", 1)["frame"].alias("start"), n.cast("long").alias("n"), (size - n).cast("long").alias("padded"), F.unhex(text).alias("payload"))
