"""The bit cursor and its units against a reader that goes bit by bit."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import bitstream
from framewright.operators.bitstream import FIXED, MARK, RICE


def bits_of(x, n):
    return "".join(str(x >> k & 1) for k in range(n))


def number(x, kind, size):
    if kind == FIXED:
        return bits_of(x, size)
    if kind == MARK:
        return ("0", "10", "11")[x]
    return "1" * (x >> size) + "0" + bits_of(x & ((1 << size) - 1), size)


def head(kind, size):
    return bits_of(kind, 2) + (("1" + bits_of(size - 1, 5) if size else "0") if kind == FIXED else "" if kind == MARK else bits_of(size, 4))


def code(values, kind, size, runs):
    if not runs:
        return "0" + head(kind, size) + "".join(number(x, kind, size) for x in values)
    out, zeros = "11" + head(kind, size) + head(*runs), 0
    for x in values:
        if x:
            out += number(zeros, *runs) + number(x - 1, kind, size)
        zeros = 0 if x else zeros + 1
    return out + (number(zeros, *runs) if zeros else "")


def some_unit(draw):
    n = int(draw.integers(0, 70))
    kind = int(draw.choice([FIXED, MARK, RICE, 3]))
    size = 0 if kind == MARK else int(draw.integers(0, 33 if kind == FIXED else 13))
    top = {FIXED: 1 << size, MARK: 3}.get(kind, 200 << size)
    values = [int(x) for x in draw.integers(0, top, n)]
    if draw.random() < 0.5:
        return [*values], kind, size, None
    values = [min(x + 1, top) if draw.random() < 0.4 else 0 for x in values]
    if kind == FIXED and size == 32:
        values = [min(x, 1 << 31) for x in values]
    longest = max([0, *map(len, "".join("0" if not x else "1" for x in values).split("1"))])
    runs = (MARK, 0) if longest < 3 and draw.random() < 0.5 else [(RICE, int(draw.integers(0, 5))), (FIXED, max(1, longest.bit_length()))][int(draw.integers(0, 2))]
    return values, kind, size, runs


def pack(text):
    return np.packbits(np.array(list(map(int, text)), np.uint8), bitorder="little").tobytes() if text else b""


@pytest.mark.parametrize("seed", range(5))
def test_units_in_one_stream(spark, seed):
    draw = np.random.default_rng(seed)
    streams, want = [], {}
    for s in range(20):
        text, index = "", []
        for u in range(int(draw.integers(0, 12))):
            values, *make = some_unit(draw)
            index.append((len(text), len(values)))
            own = code(values, *make)
            want[s, u] = (len(text), len(text) + len(own), True, values)
            text += own
        streams.append((s, pack(text), index))
    df = spark.createDataFrame(streams, "s int, data binary, at array<struct<start: long, count: int>>").repartition(4)
    got = {(r["s"], r["unit"]): (r["start_bit"], r["end_bit"], r["ok"], r["values"]) for r in bitstream.decode(df, ["s"], "data", "at").collect()}
    assert got == want


def test_units_that_end_early(spark):
    """A truncated unit, one with a run that is too long, and one that starts behind the end fail alone."""
    whole = code([5, 0, 0, 9], RICE, 2, (RICE, 1))
    long_run = "11" + head(FIXED, 4) + head(FIXED, 5) + bits_of(9, 5) + bits_of(1, 4)
    rows = [(1, pack(whole), [(0, 4)]), (2, pack(whole)[:2], [(0, 4)]), (3, pack(long_run), [(0, 4)]), (4, pack(whole), [(400, 4)]), (5, b"", [(0, 1)]), (6, None, [(0, 1)]), (7, pack(whole), None), (8, pack("1" * 200), [(0, 3)])]
    df = spark.createDataFrame(rows, "s int, data binary, at array<struct<start: long, count: int>>").coalesce(1)
    got = {r["s"]: (r["ok"], r["values"]) for r in bitstream.decode(df, ["s"], "data", "at").collect()}
    assert got.pop(1) == (True, [5, 0, 0, 9])
    assert all(x == (False, None) for x in got.values()) and {2, 3, 4, 5, 8} <= set(got)


def test_long_quotients():
    """Ones over many words."""
    for ones in (0, 1, 55, 56, 57, 63, 64, 65, 113, 500):
        for shift in range(9):
            data = np.frombuffer(pack("0" * shift + "1" * ones + "0" + "1"), np.uint8)
            own = bitstream.Cursor(data, np.array([shift]), np.array([shift + ones + 2]))
            assert own.ones(np.array([0]))[0] == ones and own.at[0] == shift + ones


def test_a_million_units_in_steps():
    """Steps go over all units at once: the time is that of the longest unit, not of all values."""
    values = [3, 0, 0, 1, 0, 7, 0, 2]
    text = code(values, RICE, 2, (RICE, 1))
    text += "0" * (-len(text) % 8)
    data, n = np.tile(np.frombuffer(pack(text), np.uint8), 1_000_000), len(text)
    start = np.arange(1_000_000) * n
    began = time.process_time()
    cursor = bitstream.Cursor(data, start, start + n)
    out = bitstream.read_units(cursor, np.full(1_000_000, len(values)))
    assert cursor.ok.all() and (out == values).all() and time.process_time() - began < 30


def test_written_by_spark(spark):
    """The writer's bits are the reader's."""
    draw = np.random.default_rng(9)
    for kind, size, runs in ((RICE, 3, None), (FIXED, 7, (RICE, 2)), (MARK, 0, (FIXED, 6)), (FIXED, 0, None)):
        values = [int(x) for x in draw.integers(0, {FIXED: max(1, 1 << size), MARK: 3}.get(kind, 90), 40)]
        df = spark.createDataFrame([(values,)], "v array<long>")
        told = df.select(bitstream.unit_code(F.col("v"), kind, size, runs).alias("c")).withColumn("b", bitstream.packed(F.col("c"))).first()
        assert told["c"] == code(values, kind, size, runs) and bytes(told["b"]) == pack(told["c"])


def test_packed_lengths(spark):
    """Bits of every length around a word's and a byte's ends, packed and absent."""
    draw = np.random.default_rng(3)
    texts = ["".join(map(str, draw.integers(0, 2, n))) for n in range(140)] + ["1" * n for n in (63, 64, 65, 128, 5000)] + [None]
    done = spark.createDataFrame(list(enumerate(texts)), "k long, c string").withColumn("b", bitstream.packed(F.col("c"))).collect()
    for r in done:
        assert r["b"] is None if r["c"] is None else bytes(r["b"]) == pack(r["c"])
