"""Blocks of records against a parser that goes bit by bit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import records
from framewright.plans.registry import ORACLES, QUERIES
from tests.compare import connect, differences
from tests.test_bitstream import pack


def high(x, n):
    return f"{x:0{n}b}" if n else ""


def slow_parse(bits, grammar):
    """(tag, records, bits read) of the block at the start of a text of bits; None if it is not whole."""
    at = 0

    def take(n):
        nonlocal at
        at += n
        if at > len(bits):
            raise EOFError
        return int(bits[at - n : at], 2)

    try:
        tag, out = take(8), []
        while op := take(8):
            if op not in grammar:
                return None
            numbers = [take(n) for n in grammar[op]]
            out.append((op, numbers[0] if numbers else None, numbers[1] if len(numbers) > 1 else None))
        return tag, out, at
    except EOFError:
        return None


def some_block(draw, grammar):
    own = [(op, *(int(draw.integers(0, 1 << n)) for n in grammar[op])) for op in draw.choice(sorted(grammar), int(draw.integers(0, 9))).tolist()]
    text = high(int(draw.integers(0, 256)), 8) + "".join(high(r[0], 8) + "".join(high(x, n) for x, n in zip(r[1:], grammar[r[0]], strict=True)) for r in own) + "0" * 8
    damage = draw.random()
    if damage < 0.1:
        return text[: int(draw.integers(1, len(text)))]
    if damage < 0.2:
        return text[:8] + high(0xFF, 8) + text[16:]
    return text


GRAMMAR = records.METADATA | {7: (), 9: (5, 32), 10: (1,)}


@pytest.mark.parametrize("seed", range(4))
def test_blocks(spark, seed):
    draw = np.random.default_rng(seed)
    streams, want = [], {}
    for s in range(25):
        text, index = "", []
        for u in range(int(draw.integers(0, 8))):
            index.append((len(text),))
            own = some_block(draw, GRAMMAR)
            text += own
            want[s, u] = (index[-1][0], own)
        streams.append((s, pack(text), index, text))
    # a block's bits end where the next one's begin
    df = spark.createDataFrame([x[:3] for x in streams], "s int, data binary, at array<struct<start: long>>").repartition(3)
    done = records.parse(df, ["s"], "data", "at", GRAMMAR).collect()
    assert len(done) == len(want)
    for r in done:
        start, own = want[r["s"], r["unit"]]
        found = slow_parse(own, GRAMMAR)
        if (r["s"], r["unit"] + 1) not in want:  # the last block also has the bits that fill its byte
            found = slow_parse(own + "0" * (-(start + len(own)) % 8), GRAMMAR)
        assert r["ok"] == (found is not None)
        if found:
            assert (r["tag"], [tuple(x) for x in r["records"]], r["end_bit"]) == (found[0], found[1], start + found[2])


def test_writer(spark):
    rows = [(5, [(2, 200, None), (0x40, 1, 255), (0x80, 4_000_000_000, None)]), (0, [])]
    df = spark.createDataFrame(rows, "tag long, rs array<struct<opcode: long, value: long, second: long>>")
    codes = [r[0] for r in df.select(records.block_code(F.col("tag"), F.col("rs"))).collect()]
    assert [slow_parse(c, records.METADATA)[:2] for c in codes] == [(5, rows[0][1]), (0, [])]
    assert all(slow_parse(c, records.METADATA)[2] == len(c) for c in codes)


def test_turned():
    for n in range(33):
        for x in {0, 1, (1 << n) - 1 if n else 0, (1 << n) // 3}:
            assert records.turned(np.array([x]), np.array([n]))[0] == int(high(x, n)[::-1] or "0", 2)


def test_carried_fields(spark):
    """Fields of the index go with their block, damaged or not."""
    texts = [high(5, 8) + high(2, 8) + high(200, 8) + "0" * 8, high(6, 8) + high(0xFF, 8), high(7, 8) + "0" * 8]
    starts = [sum(map(len, texts[:k])) for k in range(3)]
    df = spark.createDataFrame([(1, pack("".join(texts)), list(zip(starts, "abc", strict=True)))], "s int, data binary, at array<struct<start: long, name: string>>")
    done = records.parse(df, ["s"], "data", "at", carried=["name"])
    assert done.columns[-1] == "name"
    assert sorted((r["name"], r["ok"], r["tag"]) for r in done.collect()) == [("a", True, 5), ("b", False, None), ("c", True, 7)]


def _lines(spark, path):
    rows = [(o, 10 * n + 1, 7 * n, n) for o in (-130, -65, -64, -1, 0, 1, 63, 64, 200, None) for n in range(1, 8) if (o or 3) % (n + 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{path}/lineitem.parquet")


def test_query_of_odd_orders(spark, tmp_path):
    """Orders below zero share a stream as in SQL, and lines without an order are in none."""
    _lines(spark, tmp_path)
    assert differences(QUERIES["tagged_records"](spark, str(tmp_path)), connect(str(tmp_path)), ORACLES["tagged_records"]) == []


def test_query_deals_lines_once(spark, tmp_path):
    """No join of what was parsed with what was written, and one shuffle for lines, orders and streams."""
    _lines(spark, tmp_path)
    plan = QUERIES["tagged_records"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("Join"), plan.count("Exchange")) == (0, 1)
