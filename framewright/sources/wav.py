"""PCM in WAV files as a Spark data source.

``read_wav`` gives (path, channel, frame, x) of many files: tasks read their headers from
a prefix, and ranges of ``frames_per_task`` frames are dealt to tasks anew, so one long
file is spread over many, and the driver opens none. The data source "wav_pcm" (after
``spark.dataSource.register(WavSource)``) does the same for a few files named in the option
"path", separated by commas or, for any names, as a JSON list; there the driver reads the headers. Paths go to pyarrow's file systems, so
stores that it knows can be read as well as shared folders.

``write_wav`` takes (channel, frame, x) with channels from 0: a task writes each unit of
``frames_per_file`` frames to a file of its own, named by its first frame, in RIFF, or RF64
beyond 4 GB. The number of frames is counted first, so a file's header is written before
its samples and these batch by batch, whatever the file's size. Files get their names when
the whole job commits; a job that fails leaves none. What a commit is to do is written
down before it begins; ``finish_commits`` goes on with one that was cut off, and so does the next write.

Little-endian 16- and 24-bit integer PCM is read, in RIFF or RF64. Anything else
raises ``ValueError``. A data chunk cut short gives the whole frames that are there.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

PREFIX = 1 << 16
SCHEMA = "path string, channel int, frame long, x long"


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def header(data: bytes, file_size: int) -> tuple[int, int, int, int, int] | None:
    """begin, length, channels, rate and bytes a sample of the data chunk; None if the prefix ends before it."""
    if data[:4] not in (b"RIFF", b"RF64") or data[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, shape, large = 12, None, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        body = at + 8
        if name == b"ds64":
            large = struct.unpack_from("<Q", data, body + 8)[0]
        elif name == b"fmt " and body + 16 <= len(data):
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, body)
            if kind not in (1, 0xFFFE) or bits not in (16, 24) or not channels:
                raise ValueError(f"format {kind} of {bits} bits is not read")
            shape = channels, rate, bits // 8
        elif name == b"data":
            if shape is None:
                raise ValueError("samples before their format")
            length = large if size == 0xFFFFFFFF and large is not None else size
            return body, min(length, file_size - body), *shape
        at = body + size + size % 2
    return None


def samples(raw: bytes, width: int) -> np.ndarray:
    """Signed integers of little-endian PCM."""
    if width == 2:
        return np.frombuffer(raw, "<i2").astype(np.int64)
    parts = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int64)
    value = parts[:, 0] | parts[:, 1] << 8 | parts[:, 2] << 16
    return np.where(value >= 1 << 23, value - (1 << 24), value)


class Range(InputPartition):
    def __init__(self, path: str, begin: int, first: int, n: int, channels: int, width: int):
        self.path, self.begin, self.first, self.n, self.channels, self.width = path, begin, first, n, channels, width


def ranges(path: str, frames: int) -> list[Range]:
    """A file in ranges of frames, by its header."""
    store, inner = located(path)
    size, found, prefix = store.get_file_info(inner).size, None, PREFIX
    while found is None:
        with store.open_input_file(inner) as f:
            found = header(f.read(prefix), size)
        if found is None and prefix >= size:
            raise ValueError(f"no samples in {path}")
        prefix *= 4
    begin, length, channels, _, width = found
    total = length // (channels * width)
    return [Range(path, begin, k, min(frames, total - k), channels, width) for k in range(0, total, frames)]


def read_range(part: Range) -> Iterator[pa.RecordBatch]:
    """path, channel, frame, x of a range."""
    store, inner = located(part.path)
    step = part.channels * part.width
    with store.open_input_file(inner) as f:
        for first in range(part.first, part.first + part.n, 65_536):
            n = min(65_536, part.first + part.n - first)
            f.seek(part.begin + first * step)
            x = samples(f.read(n * step), part.width)
            channel = np.tile(np.arange(part.channels, dtype=np.int32), n)
            frame = np.repeat(np.arange(first, first + n), part.channels)
            yield pa.RecordBatch.from_arrays([pa.array([part.path] * len(x)), pa.array(channel), pa.array(frame), pa.array(x)], ["path", "channel", "frame", "x"])


def read_wav(spark: SparkSession, paths: list[str] | DataFrame, frames_per_task: int = 1 << 20, tasks: int | None = None) -> DataFrame:
    """path, channel, frame, x of files, given as a list or a column of paths; headers and ranges are read by so many tasks."""
    tasks = tasks or 4 * spark.sparkContext.defaultParallelism
    files = paths.toDF("path") if isinstance(paths, DataFrame) else spark.createDataFrame([(p,) for p in paths], "path string")
    names = ["path", "begin", "first", "n", "channels", "width"]

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for path in batch.column(0).to_pylist() for r in ranges(path, frames_per_task)]
            yield pa.RecordBatch.from_arrays([pa.array([getattr(r, n) for r in rows], pa.string() if n == "path" else pa.int64()) for n in names], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield from read_range(Range(**r))

    planned = files.repartition(tasks, "path").mapInArrow(plan, "path string, begin long, first long, n long, channels long, width long")
    return planned.repartition(tasks, "path", "first").mapInArrow(read, SCHEMA)


class WavReader(DataSourceReader):
    def __init__(self, paths: list[str], frames: int):
        self.paths, self.frames = paths, frames

    def partitions(self) -> list[Range]:
        return [r for path in self.paths for r in ranges(path, self.frames)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        return read_range(part)


def riff_header(channels: int, rate: int, width: int, length: int) -> bytes:
    """What stands before the samples of a file with so many bytes of them; RF64 where RIFF's sizes end."""
    form = b"fmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * channels * width, channels * width, 8 * width)
    if length + 64 < 1 << 32:
        return b"RIFF" + struct.pack("<I", 36 + length + length % 2) + b"WAVE" + form + b"data" + struct.pack("<I", length)
    sizes = b"ds64" + struct.pack("<IQQQI", 28, 72 + length + length % 2, length, length // (channels * width), 0)
    return b"RF64" + struct.pack("<I", 0xFFFFFFFF) + b"WAVE" + sizes + form + b"data" + struct.pack("<I", 0xFFFFFFFF)


def pcm(x: np.ndarray, width: int) -> bytes:
    """Little-endian PCM of signed integers; out of range is an error."""
    rail = 1 << (8 * width - 1)
    if len(x) and (x.min() < -rail or x.max() >= rail):
        raise ValueError(f"samples do not fit {8 * width} bits")
    return x.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class Unit:
    """One file of a task: its header, then samples in order as they come."""

    def __init__(self, store: fs.FileSystem, aside: str, first: int, frames: int, channels: int, width: int, rate: int):
        self.first, self.total, self.channels, self.width, self.at = first, frames * channels, channels, width, 0
        self.file = store.open_output_stream(aside)
        self.file.write(riff_header(channels, rate, width, self.total * width))

    def take(self, rows: np.ndarray) -> None:
        """More rows: channel, frame and x."""
        place = self.at + np.arange(rows.shape[1])
        self.at += rows.shape[1]
        if self.at > self.total or (rows[0] != place % self.channels).any() or (rows[1] != self.first + place // self.channels).any():
            raise ValueError(f"frames from {self.first} on are not whole, or not in order")
        self.file.write(pcm(rows[2], self.width))

    def close(self) -> None:
        if self.at != self.total:
            raise ValueError(f"frames from {self.first} on are not whole, or not in order")
        self.file.write(b"\0" * (self.total * self.width % 2))
        self.file.close()


class WavWriter(DataSourceArrowWriter):
    """Rows of a task, in order of frame and channel, to one file a unit; total is the number of frames of all files."""

    def __init__(self, path: str, channels: int, width: int, rate: int, frames: int, total: int):
        self.path, self.channels, self.width, self.rate, self.frames, self.total, self.job = path, channels, width, rate, frames, total, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, inner = located(self.path)
        store.create_dir(inner)
        done: list[tuple[str, str]] = []
        unit = None
        for batch in batches:
            rows = np.stack([batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("channel", "frame", "x")])
            for part in np.split(rows, np.flatnonzero(np.diff(rows[1] // self.frames)) + 1, axis=1):
                if not part.shape[1]:
                    continue
                first = int(part[1, 0] // self.frames) * self.frames
                if unit is None or first != unit.first:
                    if unit:
                        unit.close()
                    aside = f"{inner}/_{self.job}-{uuid.uuid4().hex}"
                    done.append((aside, f"{inner}/frames-{first:015d}.wav"))
                    unit = Unit(store, aside, first, min(self.frames, self.total - first), self.channels, self.width, self.rate)
                unit.take(part)
        if unit:
            unit.close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        store, inner = located(self.path)
        store.create_dir(inner)
        with store.open_output_stream(f"{inner}/_{self.job}.moves.part") as f:
            f.write(json.dumps([x for m in messages if m for x in m.files]).encode())
        store.move(f"{inner}/_{self.job}.moves.part", f"{inner}/_{self.job}.moves")
        finish_commits(self.path)

    def abort(self, messages: list[Written | None]) -> None:
        store, inner = located(self.path)
        for found in store.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
            if found.base_name.startswith(f"_{self.job}-"):
                store.delete_file(found.path)


def finish_commits(path: str) -> int:
    """Carry out the moves of every commit of a folder that is written down; the number of files that got their names."""
    store, inner = located(path)
    moved = 0
    for found in store.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
        if not found.base_name.endswith(".moves"):
            continue
        with store.open_input_file(found.path) as f:
            moves = json.loads(f.read())
        for aside, final in moves:
            if store.get_file_info(aside).type == fs.FileType.File:
                store.move(aside, final)
                moved += 1
        store.delete_file(found.path)
    return moved


def write_wav(df: DataFrame, path: str, channels: int, width: int = 3, rate: int = 48000, frames_per_file: int = 1 << 20) -> None:
    """Write (channel, frame, x) to WAV files of frames_per_file frames, one task or more for each group of files.

    Frames go from 0 without gaps; the last file may be shorter.
    """
    finish_commits(path)
    df.sparkSession.dataSource.register(WavSource)
    total = (df.agg(F.max("frame")).first()[0] or 0) + 1
    dealt = df.select(F.col("channel").cast("int"), "frame", "x").repartition(F.floor(F.col("frame") / frames_per_file)).sortWithinPartitions("frame", "channel")
    options = {"channels": channels, "width": width, "rate": rate, "frames_per_file": frames_per_file, "frames": total}
    dealt.write.format("wav_pcm").mode("append").options(**options).save(path)


def wav_files(path: str) -> list[str]:
    """The files that write_wav left in a folder, in order of their frames."""
    store, inner = located(path)
    names = sorted(x.base_name for x in store.get_file_info(fs.FileSelector(inner)) if x.base_name.endswith(".wav"))
    return [f"{path}/{n}" for n in names]


def first_frame(path: Column | str) -> Column:
    """The first frame of a file that write_wav has named."""
    return F.regexp_extract(path, r"frames-(\d+)\.wav$", 1).cast("long")


class WavSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav_pcm"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WavReader:
        path = self.options["path"]
        return WavReader(json.loads(path) if path.startswith("[") else path.split(","), int(self.options.get("frames_per_task", 1 << 20)))

    def writer(self, schema, overwrite: bool) -> WavWriter:
        o = self.options
        return WavWriter(o["path"], int(o["channels"]), int(o.get("width", 3)), int(o.get("rate", 48000)), int(o.get("frames_per_file", 1 << 20)), int(o["frames"]))
