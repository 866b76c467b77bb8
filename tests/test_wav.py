"""WAV files written by hand, read by ranges."""

import json
import os
import struct
import tempfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from framewright.sources.wav import WavSource, WavWriter, finish_commits, first_frame, header, pcm, read_wav, riff_header, wav_files, write_wav


def wav(values, channels, width, extra=b""):
    body = b"".join(v.to_bytes(width, "little", signed=True) for v in values)
    form = struct.pack("<HHIIHH", 1, channels, 48000, 48000 * channels * width, channels * width, 8 * width)
    chunks = b"fmt " + struct.pack("<I", 16) + form + extra + b"data" + struct.pack("<I", len(body)) + body
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


@pytest.mark.parametrize("width", [2, 3])
def test_read(spark, width):
    rail = 1 << (8 * width - 1)
    values = [(k * 7919) % (2 * rail) - rail for k in range(600)] + [-rail, rail - 1, -1]
    path = tempfile.mkdtemp(prefix="framewright-wav-") + "/a.wav"
    with open(path, "wb") as f:
        f.write(wav(values, 3, width, b"LIST" + struct.pack("<I", 5) + b"abcde\0"))
    spark.dataSource.register(WavSource)
    df = spark.read.format("wav_pcm").option("path", path).option("frames_per_task", 64).load()
    assert df.rdd.getNumPartitions() == 4
    got = {(r["frame"], r["channel"]): r["x"] for r in df.collect()}
    assert got == {(k // 3, k % 3): v for k, v in enumerate(values)}


def test_bad_headers():
    with pytest.raises(ValueError):
        header(b"nothing at all", 14)
    assert header(wav([], 1, 2)[:20], 100) is None


@pytest.mark.parametrize("width", [2, 3])
def test_write(spark, width):
    rail = 1 << (8 * width - 1)
    values = [(k * 7919) % (2 * rail) - rail for k in range(2100)] + [-rail, rail - 1, -1]
    rows = [(k % 3, k // 3, v) for k, v in enumerate(values)]
    path = tempfile.mkdtemp(prefix="framewright-wav-")
    write_wav(spark.createDataFrame(rows, "channel int, frame long, x long").repartition(4), path, 3, width, frames_per_file=100)
    names = [x.rsplit("/", 1)[1] for x in wav_files(path)]
    assert names == [f"frames-{k:015d}.wav" for k in range(0, 701, 100)] and sorted(os.listdir(path)) == names
    with open(f"{path}/{names[0]}", "rb") as f:
        assert f.read() == wav(values[:300], 3, width)
    spark.dataSource.register(WavSource)
    back = spark.read.format("wav_pcm").option("path", ",".join(wav_files(path))).load()
    assert spark.read.format("wav_pcm").option("path", json.dumps(wav_files(path))).load().count() == back.count()
    got = back.withColumn("frame", F.col("frame") + first_frame("path")).select("channel", "frame", "x")
    assert sorted(map(tuple, got.collect())) == sorted(rows)
    back = read_wav(spark, wav_files(path), frames_per_task=64, tasks=3)
    assert sorted((r["channel"], r["frame"] + int(r["path"][-19:-4]), r["x"]) for r in back.collect()) == sorted(rows)


def test_a_failed_write_leaves_no_file(spark):
    path = tempfile.mkdtemp(prefix="framewright-wav-")
    for rows in ([(0, 0, 1), (1, 0, 2), (0, 1, 3)], [(0, 0, 1 << 23), (1, 0, 0)]):
        with pytest.raises(Exception, match="not whole|do not fit"):
            write_wav(spark.createDataFrame(rows, "channel int, frame long, x long"), path, 2)
    assert wav_files(path) == []


def test_samples_are_written_as_they_come(spark, monkeypatch):
    """A file's samples pass in batches, never all at once; a frame may end in the next batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        path = tempfile.mkdtemp(prefix="framewright-wav,")
        rows = [(k % 3, k // 3, k) for k in range(999)]
        write_wav(spark.createDataFrame(rows, "channel int, frame long, x long"), path, 3)
        assert sorted((r["channel"], r["frame"], r["x"]) for r in read_wav(spark, spark.createDataFrame([(x,) for x in wav_files(path)], "p string")).collect()) == sorted(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    writer = WavWriter(path, 2, 2, 48000, 100, 150)
    batches = [pa.RecordBatch.from_pydict({"channel": [k % 2 for k in own], "frame": [k // 2 for k in own], "x": list(own)}) for own in (range(0, 33), range(33, 201), range(201, 300))]
    sizes = []
    monkeypatch.setattr("framewright.sources.wav.pcm", lambda x, width: sizes.append(len(x)) or pcm(x, width))
    done = writer.write(iter(batches))
    assert sizes == [33, 167, 1, 99] and [os.path.getsize(a) for a, _ in done.files] == [44 + 400, 44 + 200]
    writer.abort([done])


def test_a_commit_that_was_cut_off_is_finished(spark, monkeypatch):
    path = tempfile.mkdtemp(prefix="framewright-wav-")
    rows = spark.createDataFrame([(0, k, k) for k in range(40)], "channel int, frame long, x long")
    with monkeypatch.context() as m:
        m.setattr("framewright.sources.wav.finish_commits", lambda path: 0)
        writer = WavWriter(path, 1, 3, 48000, 10, 40)
        batches = [pa.RecordBatch.from_pydict({"channel": [0] * 40, "frame": list(range(40)), "x": list(range(40))})]
        writer.commit([writer.write(iter(batches)), None])
        assert wav_files(path) == []
    files = sorted(x for x in os.listdir(path) if not x.endswith(".moves"))
    os.rename(f"{path}/{files[0]}", f"{path}/{[b for a, b in json.loads(open(path + '/' + [x for x in os.listdir(path) if x.endswith('.moves')][0]).read()) if a.endswith(files[0])][0].rsplit('/', 1)[1]}")
    assert finish_commits(path) == 3 and len(wav_files(path)) == 4 and len(os.listdir(path)) == 4
    write_wav(rows, path, 1, frames_per_file=40)


def test_headers_of_large_files():
    small, large = riff_header(2, 48000, 3, 600), riff_header(2, 48000, 3, 6 * 10**9)
    assert header(small, len(small) + 600) == (44, 600, 2, 48000, 3)
    assert large[:4] == b"RF64" and header(large, len(large) + 6 * 10**9) == (len(large), 6 * 10**9, 2, 48000, 3)
