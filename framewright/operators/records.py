"""Blocks of tagged records: a grammar run over packed bits, side by side for all blocks, and its writer.

A block is a tag of 8 bits, then records, then the opcode 0. A record is an opcode of 8
bits and the numbers that the grammar gives it, each the highest bit first. Blocks lie
in a stream one behind another, found by an index of first bits, as in ``bitstream``.

An opcode that the grammar does not know, or a block cut short, makes its block not ok,
with null records; others are not touched by it.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.operators.bitstream import Cursor, cut_units, laid_out

END = 0


def spans(of: Mapping[tuple[int, ...], Sequence[int | tuple[int, int]]]) -> dict[int, tuple[int, ...]]:
    """A grammar (opcode to widths of its numbers) from widths to opcodes, single or first and last."""
    return {op: widths for widths, ops in of.items() for x in ops for op in (range(x[0], x[1] + 1) if isinstance(x, tuple) else (x,))}


# The widths of the numbers that opcodes of programme metadata carry.
METADATA = spans(
    {
        (8,): [2, 4, 0x1E, 0x1F, 0x41, 0x47, (0x50, 0x58)],
        (8, 8): [0x40],
        (16,): [1, 3, (0x5A, 0x62)],
        (24,): [(0x64, 0x6C)],
        (32,): [0x0E, 0x46, (0x6E, 0x76), (0x80, 0x85), (0x8C, 0x90)],
    }
)


def turned(value: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Numbers of so many bits (0 to 32) with their bits in the other order."""
    x = value.astype(np.uint64)
    for shift, mask in ((1, 0x55555555), (2, 0x33333333), (4, 0x0F0F0F0F), (8, 0x00FF00FF), (16, 0x0000FFFF)):
        x = ((x >> np.uint64(shift)) & np.uint64(mask)) | ((x & np.uint64(mask)) << np.uint64(shift))
    return (x >> (32 - width).astype(np.uint64)).astype(np.int64)


def read_blocks(cursor: Cursor, n: int, grammar: Mapping[int, tuple[int, ...]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The tags of n blocks, and all their records in order: block, opcode, and two numbers, -1 where a record has none."""
    widths = np.zeros((2, 256), np.int64)
    known = np.zeros(256, bool)
    known[END] = True
    for op, own in grammar.items():
        known[op] = True
        widths[: len(own), op] = own
    rows = np.arange(n)
    eight = np.full(n, 8)
    tags = turned(cursor.take(rows, eight), eight)
    found: list[list[np.ndarray]] = [[], [], [], []]
    live = rows[cursor.ok]
    while len(live):
        op = turned(cursor.take(live, 8), np.full(len(live), 8))
        cursor.ok[live] &= known[op]
        going = cursor.ok[live] & (op != END)
        live, op = live[going], op[going]
        numbers = []
        for wide in widths[:, op]:
            value = turned(cursor.take(live, wide), wide)
            numbers.append(np.where(wide > 0, value, -1))
        for column, part in zip(found, (live, op, *numbers), strict=True):
            column.append(part)
        live = live[cursor.ok[live]]
    flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in found]
    order = np.argsort(flat[0], kind="stable")
    return tags, [x[order] for x in flat]


def parse(streams: DataFrame, key: list[str], data: str, index: str, grammar: Mapping[int, tuple[int, ...]] = METADATA, carried: Sequence[str] = ()) -> DataFrame:
    """key, unit, start_bit, end_bit, ok, tag, records (array of opcode, value, second) and the carried fields of every block.

    data is a column of bytes, index one of arrays of structs with start, the first bit of a block, ascending; further
    fields of it that carried names go with their block, so what is known of a block need not be joined to it.
    """
    cut = cut_units(streams, key, data, index, carried)
    kinds = dict(cut.dtypes)
    names = [*key, "unit", "start_bit", "end_bit", "ok", "tag", "records", *carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cursor, shift = laid_out(batch)
            tags, (block, op, value, second) = read_blocks(cursor, batch.num_rows, grammar)
            sizes = np.bincount(block, minlength=batch.num_rows)
            absent = lambda x: pa.array(x, mask=x < 0)
            rows = pa.StructArray.from_arrays([pa.array(op), absent(value), absent(second)], ["opcode", "value", "second"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), rows, mask=pa.array(~cursor.ok))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in (*key, "unit")), batch.column("_first"), pa.array(cursor.at - shift), pa.array(cursor.ok), pa.array(tags, mask=~cursor.ok), lists, *(batch.column(n) for n in carried)], names)

    typed = lambda columns: [f"`{c}` {kinds[c]}" for c in columns]
    own = "unit long, start_bit long, end_bit long, ok boolean, tag long, records array<struct<opcode: long, value: long, second: long>>"
    return cut.mapInArrow(run, ", ".join([*typed(key), own, *typed(carried)]))


def block_code(tag: Column, records: Column, grammar: Mapping[int, tuple[int, ...]] = METADATA) -> Column:
    """The bits of a block, as text; records is an array of structs of opcode, value and second."""
    # two digits for each opcode: a literal that is cheaper to plan than a map
    wide = [F.lit("".join(f"{(*grammar.get(op, ()), 0, 0)[k]:02d}" for op in range(256))) for k in (0, 1)]
    high = lambda x, n: F.when(n > 0, F.lpad(F.bin(x), n, F.lit("0"))).otherwise("")

    def code(r: Column) -> Column:
        n = [F.substring(w, r["opcode"].cast("int") * 2 + 1, F.lit(2)).cast("int") for w in wide]
        return F.concat(high(r["opcode"], F.lit(8)), high(r["value"], n[0]), high(F.coalesce(r["second"], F.lit(0).cast("long")), n[1]))

    return F.concat(high(tag, F.lit(8)), F.array_join(F.transform(records, code), ""), F.lit("0" * 8))
