"""Streams run to the end of what is there, against the batch results."""

import tempfile

import pytest

from framewright.streaming import stateful


@pytest.fixture
def files(spark):
    """A stream of three files, frames in order."""
    where = tempfile.mkdtemp(prefix="framewright-stream-")
    rows = [(c, k, k * 7 % 23) for k in range(90) for c in ("a", "b")]
    for part in range(3):
        made = spark.createDataFrame(rows[part * 60 : part * 60 + 60], stateful.SIGNAL).withColumnRenamed("x", "x")
        made.coalesce(1).write.mode("append").parquet(where)
    return spark.readStream.schema(stateful.SIGNAL).option("maxFilesPerTrigger", 1).parquet(where), rows


def run(df, mode="append"):
    name = "t" + tempfile.mkdtemp(prefix="")[-8:].replace("-", "_").replace("_", "x")
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return sorted(map(tuple, df.sparkSession.table(name).collect()))


def test_reblock(files):
    stream, rows = files
    got = run(stateful.reblock(stream, 16))
    want = []
    for c in ("a", "b"):
        x = [v for ch, _, v in rows if ch == c]
        want += [(c, k, 16, sum(x[k : k + 16])) for k in range(0, 80, 16)]
    assert got == want


def test_lock(files):
    stream, rows = files
    want = []
    for c in ("a", "b"):
        at = -1
        for ch, frame, x in rows:
            if ch == c:
                at = at + 1 if 0 <= at < 4 else 0 if x % 5 == 0 else -1
                want += [(c, frame)] if at == 4 else []
    assert run(stateful.lock(stream)) == want


def test_windows_and_sessions(files):
    stream, _ = files
    timed = stream.selectExpr("channel", "x", "timestamp_seconds(frame) as t")
    got = run(stateful.windowed(timed, "t", "channel", "x", "10 seconds", "1 second"))
    assert [r[2] for r in got] == [10] * len(got) and len(got) >= 14
    gaps = stream.filter("frame % 30 < 20").selectExpr("channel", "timestamp_seconds(frame) as t")
    assert [r[3] for r in run(stateful.sessions(gaps, "t", "channel", "5 seconds", "1 second"))] == [20] * 4


def test_write_once(spark, files):
    stream, rows = files
    out, mark = tempfile.mkdtemp(prefix="framewright-out-"), tempfile.mkdtemp(prefix="framewright-mark-")
    for _ in range(2):
        stateful.write_once(stream, out, mark).awaitTermination()
    assert spark.read.parquet(out).count() == len(rows)
