"""Samples in files of nested boxes: an index of byte ranges, planned and read by tasks.

A file is a row of boxes: a size of 32 bits (1: a size of 64 bits follows; 0: to the end of
the file), a type of four letters, and content, which in containers is boxes again. A
track's sample table says how many samples each chunk has (runs), where chunks begin, and
how large samples are; ``sample_ranges`` joins the three.

``read_samples`` walks files in tasks, box head by box head, by ranges: contents are skipped but
for the tables. Each task gives the samples' ranges in rows of ``samples_per_task``; these are dealt anew, and
other tasks read the bytes. The driver opens no file.

A box that says less than its head, or more than its container, an unknown form of a table, or tables that do not
agree raise ``ValueError``. A file without a track has no samples.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from framewright.sources.wav import located

# Types of boxes that hold boxes on the way to a sample table, and the tables.
CONTAINERS = frozenset({b"moov", b"trak", b"mdia", b"minf", b"stbl"})
RUNS, SIZES, OFFSETS, LONG_OFFSETS = b"stsc", b"stsz", b"stco", b"co64"
SCHEMA = "path string, track int, sample long, offset long, size long, data binary"


@dataclass
class Track:
    """The tables of a track: runs of (first chunk from 1, samples a chunk), sizes, and offsets of chunks."""

    runs: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def walk(file, begin: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, first byte of the content, end) of every box between two places, one after another; only heads are read."""
    at = begin
    while at < end:
        file.seek(at)
        head = file.read(min(16, end - at))
        if len(head) < 8:
            raise ValueError(f"a box at {at} is cut short")
        size, kind = struct.unpack(">I4s", head[:8])
        content = at + 8
        if size == 1:
            if len(head) < 16:
                raise ValueError(f"a box at {at} is cut short")
            size, content = struct.unpack(">Q", head[8:])[0], at + 16
        stop = end if size == 0 else at + size
        if stop < content or stop > end:
            raise ValueError(f"a box at {at} says {size} bytes")
        yield kind, content, stop
        at = stop


def _table(data: bytes, kind: bytes) -> np.ndarray:
    """The numbers of a table: its content without version and flags."""
    if len(data) < 8 or data[0]:
        raise ValueError(f"table {kind!r} is not of a known form")
    if kind == SIZES:
        one, n = struct.unpack(">II", data[4:12])
        if one:
            return np.full(n, one, np.int64)
        form, width, skip = ">u4", 4, 12
    else:
        n = struct.unpack(">I", data[4:8])[0]
        form, width, skip = {RUNS: (">u4", 12, 8), OFFSETS: (">u4", 4, 8), LONG_OFFSETS: (">u8", 8, 8)}[kind]
    if len(data) < skip + n * width:
        raise ValueError(f"table {kind!r} is cut short")
    return np.frombuffer(data, form, n * width // int(form[-1]), skip).astype(np.int64)


def tracks(file, size: int) -> list[Track]:
    """The tracks of a file."""
    found: list[Track] = []
    open_boxes = [walk(file, 0, size)]
    while open_boxes:
        box = next(open_boxes[-1], None)
        if box is None:
            open_boxes.pop()
            continue
        kind, content, end = box
        if kind in CONTAINERS:
            if kind == b"trak":
                found.append(Track())
            open_boxes.append(walk(file, content, end))
        elif kind in (RUNS, SIZES, OFFSETS, LONG_OFFSETS) and found:
            file.seek(content)
            table = _table(file.read(end - content), kind)
            if kind == RUNS:
                found[-1].runs = table.reshape(-1, 3)[:, :2]
            elif kind == SIZES:
                found[-1].sizes = table
            else:
                found[-1].offsets = table
    return found


def sample_ranges(track: Track) -> tuple[np.ndarray, np.ndarray]:
    """Offset and size of each sample: the run at or before a chunk says how many samples it has, and they follow each other in it."""
    chunks, n = len(track.offsets), len(track.sizes)
    if not n:
        return np.zeros(0, np.int64), track.sizes
    if not len(track.runs) or track.runs[0, 0] != 1 or (np.diff(track.runs[:, 0]) <= 0).any():
        raise ValueError("runs of chunks do not begin at the first or do not ascend")
    run = np.searchsorted(track.runs[:, 0], np.arange(1, chunks + 1), "right") - 1
    count = track.runs[run, 1]
    if count.sum() != n:
        raise ValueError(f"{n} samples in chunks of {count.sum()}")
    before = np.cumsum(track.sizes) - track.sizes
    first = np.cumsum(count) - count
    chunk = np.repeat(np.arange(chunks), count)
    return track.offsets[chunk] + before - before[first[count > 0]][np.cumsum(count > 0)[chunk] - 1], track.sizes


def read_samples(spark: SparkSession, paths: list[str] | DataFrame, samples_per_task: int = 1 << 16, tasks: int | None = None) -> DataFrame:
    """path, track, sample, offset, size and data of every sample of files, given as a list or a column of paths."""
    tasks = tasks or 4 * spark.sparkContext.defaultParallelism
    files = paths.toDF("path") if isinstance(paths, DataFrame) else spark.createDataFrame([(p,) for p in paths], "path string")

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, inner = located(path)
                with store.open_input_file(inner) as f:
                    found = tracks(f, store.get_file_info(inner).size)
                for number, track in enumerate(found):
                    offsets, sizes = sample_ranges(track)
                    for k in range(0, len(sizes), samples_per_task):
                        part = slice(k, k + samples_per_task)
                        yield pa.RecordBatch.from_pylist([{"path": path, "track": number, "first": k, "offsets": offsets[part].tolist(), "sizes": sizes[part].tolist()}], PLAN)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                store, inner = located(r["path"])
                with store.open_input_file(inner) as f:
                    for at in range(0, len(r["sizes"]), 1024):
                        rows = []
                        for k in range(at, min(at + 1024, len(r["sizes"]))):
                            offset, size = r["offsets"][k], r["sizes"][k]
                            f.seek(offset)
                            data = f.read(size)
                            if len(data) < size:
                                raise ValueError(f"{r['path']}: sample {r['first'] + k} ends behind the file")
                            rows.append((r["path"], r["track"], r["first"] + k, offset, size, data))
                        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                        yield pa.RecordBatch.from_arrays(columns, ["path", "track", "sample", "offset", "size", "data"])

    planned = files.repartition(tasks, "path").mapInArrow(plan, "path string, track int, first long, offsets array<long>, sizes array<long>")
    return planned.repartition(tasks, "path", "track", "first").mapInArrow(read, SCHEMA)


PLAN = pa.schema([("path", pa.string()), ("track", pa.int32()), ("first", pa.int64()), ("offsets", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))])


def box(kind: bytes, *content: bytes) -> bytes:
    """One box."""
    body = b"".join(content)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def file_of(samples: list[bytes], runs: list[tuple[int, int]], gap: int = 0) -> bytes:
    """A file of one track: samples in chunks as runs (first chunk from 1, samples a chunk) say, gap bytes behind each chunk."""
    data, offsets, counts, k = bytearray(), [], [], 0
    while k < len(samples):
        n = min(len(samples) - k, [m for first, m in runs if first <= len(offsets) + 1][-1])
        offsets.append(24 + len(data))
        counts.append(n)
        data += b"".join(samples[k : k + n]) + b"\0" * gap
        k += n
    told = [(c + 1, n) for c, n in enumerate(counts) if not c or n != counts[c - 1]]
    last = len(samples)
    head = lambda n: struct.pack(">II", 0, n)
    each = struct.pack(f">{3 * len(told)}I", *[x for first, n in told for x in (first, n, 1)])
    table = box(b"stbl", box(RUNS, head(len(told)), each), box(SIZES, struct.pack(">III", 0, 0, last), struct.pack(f">{last}I", *map(len, samples))), box(OFFSETS, head(len(offsets)), struct.pack(f">{len(offsets)}I", *offsets)))
    return box(b"ftyp", b"isom\0\0\0\0") + box(b"mdat", bytes(data)) + box(b"moov", box(b"mvhd", b"\0" * 100), box(b"trak", box(b"tkhd", b"\0" * 84), box(b"mdia", box(b"minf", table))))
