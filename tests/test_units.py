"""Units of a stream against the batch form: tails, refused rows, and a stream that is killed and started again."""

import tempfile

import pytest
from pyspark.sql import functions as F

from framewright.streaming import units

SIZE = 16


@pytest.fixture(autouse=True)
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, units.ROCKS)
    spark.conf.set("spark.sql.shuffle.partitions", 3)
    yield
    spark.conf.set(name, before)
    spark.conf.set("spark.sql.shuffle.partitions", 8)


LENGTHS = {"a": 100, "b": 64, "c": 5}


def rows_of(channel, low, high, rate=48):
    return [(channel, rate, 3, k, (k * 7919) % 1000 - 500, float(k)) for k in range(low, high)]


def put(spark, where, rows):
    made = spark.createDataFrame(rows, "channel string, rate int, layout int, frame long, x long, t double")
    made.withColumn("ts", F.timestamp_seconds(F.col("t") + 1000)).drop("t").coalesce(1).write.mode("append").parquet(where)


def stream(spark, where):
    return spark.readStream.schema(units.INPUT).option("maxFilesPerTrigger", 1).parquet(where)


def run(spark, where, out, mark):
    units.write_units(units.encode_units(stream(spark, where), SIZE, "20 seconds", "1 second"), out, mark).awaitTermination()
    return [r.asDict() for r in units.committed(spark, out).collect()]


def folders():
    return [tempfile.mkdtemp(prefix=f"framewright-{n}-") for n in ("in", "out", "mark")]


def batch(spark, lengths):
    made = spark.createDataFrame([r[:1] + r[3:5] for c, n in lengths.items() for r in rows_of(c, 0, n)], "channel string, frame long, x long")
    return sorted((r["channel"], r["start"], r["n"], r["padded"], bytes(r["payload"])) for r in units.units_of(made, SIZE).collect())


def key(done, kinds=("unit", "tail")):
    return sorted((r["channel"], r["start"], r["n"], r["padded"], bytes(r["payload"])) for r in done if r["kind"] in kinds and r["channel"] != "z")


def test_the_stream_is_the_batch_with_its_tails(spark):
    where, out, mark = folders()
    for k in range(0, 100, 13):
        put(spark, where, [r for c, n in LENGTHS.items() for r in rows_of(c, min(k, n), min(k + 13, n))])
    put(spark, where, [("z", 1, 1, 0, 0, 1000.0)])
    put(spark, where, [("z", 1, 1, 1, 0, 1001.0)])
    done = run(spark, where, out, mark)
    assert key(done) == batch(spark, LENGTHS)
    assert {r["channel"] for r in done if r["kind"] == "tail"} == {"a", "c"}


def test_another_configuration_is_refused(spark):
    where, out, mark = folders()
    put(spark, where, rows_of("a", 0, 10))
    put(spark, where, [*rows_of("a", 10, 13, rate=96), *rows_of("a", 10, 40)])
    put(spark, where, [("z", 1, 1, 0, 0, 500.0)])
    put(spark, where, rows_of("a", 600, 616, rate=96))
    put(spark, where, [("z", 1, 1, 1, 0, 900.0)])
    put(spark, where, [("z", 1, 1, 2, 0, 901.0)])
    done = run(spark, where, out, mark)
    assert sorted((r["start"], r["rate"]) for r in done if r["kind"] == "refused") == [(10, 96), (11, 96), (12, 96)]
    own = [r for r in done if r["channel"] == "a" and r["kind"] != "refused"]
    assert key([r for r in own if r["start"] < 600]) == batch(spark, {"a": 40})
    assert [(r["start"], r["rate"], r["n"]) for r in own if r["start"] >= 600] == [(600, 96, 16)]  # silent long enough to be another stream


def test_killed_in_mid_unit(spark, monkeypatch):
    """A batch fails after its rows were read and part of it was written; the next start gives every unit once."""
    where, out, mark = folders()
    for k in range(0, 100, 25):
        put(spark, where, rows_of("a", k, k + 25))
    fails = {2}

    def put_or_fail(df, number):
        df.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if number in fails:
            fails.discard(number)
            raise RuntimeError("killed")

    encoded = units.encode_units(stream(spark, where), SIZE, "20 seconds", "1 second")
    query = encoded.writeStream.foreachBatch(put_or_fail).option("checkpointLocation", mark).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="killed"):
        query.awaitTermination()
    put(spark, where, [("z", 1, 1, 0, 0, 1000.0)])
    put(spark, where, [("z", 1, 1, 1, 0, 1001.0)])
    assert key(run(spark, where, out, mark)) == batch(spark, {"a": 100})


def test_an_unfinished_batch_is_not_read(spark):
    out = tempfile.mkdtemp(prefix="framewright-out-")
    assert units.committed(spark, out).count() == 0
    df = spark.createDataFrame([("a", "unit", 1, 1, 0, 1, 0, b"x")], units.OUTPUT)
    df.write.parquet(f"{out}/batch=0")
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{out}/batch=1")
    assert units.committed(spark, out).count() == 1


def test_the_state_store_is_checked(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    with pytest.raises(ValueError, match="RocksDB"):
        units.encode_units(spark.createDataFrame([], units.INPUT))
