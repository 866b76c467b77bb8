"""Bit streams whose next place depends on what was read, decoded side by side.

A stream is a binary value with units packed one behind another, not on byte borders,
and an index of the bits at which they start. ``decode`` cuts every unit's bytes out of
its stream by that index, so units are decoded anywhere, and steps through all units of
an Arrow batch at once: one step reads one symbol of every unit that still has one, at
its own place. There is no loop over values of a unit, and none over units.

Bits are read from the low end of each byte. A unit has a head and symbols:

* one bit: whether values come as runs; if so, one more bit that is 1;
* a kind of symbol: two bits, then what it needs. ``FIXED``: a bit, and if it is 1 five
  bits for the width less one, else width 0 (the number is 0 and takes no bits).
  ``MARK``: nothing; the numbers 0, 1, 2 are the bits 0, 10, 11. ``RICE`` (2 or 3): four
  bits for k; a number is its quotient by 2 ** k in ones, a zero, and k low bits;
* with runs, a second kind. Numbers of the second kind, how many zeros follow, and of
  the first, a value less one, then take turns until the unit's count is reached;
* without runs, every value is a number of the first kind.

A unit that ends before its last symbol, or whose run is longer than what is left, has
``ok`` false and null values; others are not touched by it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.fixed import as_column

FIXED, MARK, RICE = 0, 1, 2
#: Bits of a word that are surely read, wherever in a byte it starts.
SURE = 57


class Cursor:
    """A place in each of many units: reading moves it on."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        """data: bytes of all units; start and end: first bit of each unit in it, and the one behind its last."""
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        self.words = np.lib.stride_tricks.sliding_window_view(padded, 8)
        self.at, self.end = start.astype(np.int64), end.astype(np.int64)
        self.ok = self.at <= self.end

    def _ahead(self, rows: np.ndarray) -> np.ndarray:
        """The bits at each row's place, the next one lowest; SURE of them are right, those behind the end are zero."""
        at = np.minimum(self.at[rows], self.end[rows])
        word = np.ascontiguousarray(self.words[at >> 3]).view("<u8").ravel() >> (at & 7).astype(np.uint64)
        left = np.minimum(self.end[rows] - at, 63).astype(np.uint64)
        return word & ((np.uint64(1) << left) - np.uint64(1))

    def take(self, rows: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        """A number of width bits (0 to 32) of each row; a row without so many fails."""
        width = np.broadcast_to(np.asarray(width, np.int64), rows.shape)
        value = self._ahead(rows) & ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1))
        self.ok[rows] &= self.at[rows] + width <= self.end[rows]
        self.at[rows] += width
        return value.astype(np.int64)

    def ones(self, rows: np.ndarray) -> np.ndarray:
        """The ones up to each row's next zero, or its end; the zero is not read."""
        total = np.zeros(len(rows), np.int64)
        going = np.arange(len(rows))
        while len(going):
            word = self._ahead(rows[going])
            run = np.minimum(np.bitwise_count(word & ~(word + np.uint64(1))).astype(np.int64), SURE - 1)
            self.at[rows[going]] += run
            total[going] += run
            going = going[run == SURE - 1]
        return total

    def number(self, rows: np.ndarray, kind: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A number of each row's kind; size is the width or k."""
        out = np.zeros(len(rows), np.int64)
        for k in np.unique(kind):
            own = kind == k
            these, wide = rows[own], size[own]
            if k == FIXED:
                out[own] = self.take(these, wide)
            elif k == MARK:
                first = self.take(these, 1)
                out[own] = np.where(first, 1 + self.take(these, first), 0)
            else:
                quotient = self.ones(these)
                self.take(these, 1)
                low = self.take(these, wide)
                self.ok[these] &= quotient < np.int64(1) << np.maximum(0, 31 - wide)
                out[own] = (np.where(self.ok[these], quotient, 0) << wide) | low
        return out

    def kinds(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A kind and its size, of each row."""
        kind = self.take(rows, 2)
        fixed = kind == FIXED
        wide = self.take(rows, np.where(fixed, 1, np.where(kind == MARK, 0, 4)))
        more = fixed & (wide == 1)
        raw = self.take(rows, np.where(more, 5, 0))
        return kind, np.where(fixed, np.where(more, raw + 1, 0), wide)


def read_units(cursor: Cursor, count: np.ndarray) -> np.ndarray:
    """Values of all units, unit by place, zeros behind a unit's count; the cursor ends behind their last symbols."""
    rows = np.arange(len(count))
    out = np.zeros((len(count), int(count.max(initial=0))), np.int64)
    runs = cursor.take(rows, 1) == 1
    turns = cursor.take(rows[runs], 1)
    cursor.ok[rows[runs]] &= turns == 1
    kind, size = cursor.kinds(rows)
    run_kind, run_size = np.zeros_like(kind), np.zeros_like(size)
    run_kind[runs], run_size[runs] = cursor.kinds(rows[runs])
    place = np.zeros(len(count), np.int64)
    live = rows[(count > 0) & cursor.ok]
    while len(live):
        turning = live[runs[live]]
        jump = cursor.number(turning, run_kind[turning], run_size[turning])
        cursor.ok[turning] &= jump <= count[turning] - place[turning]
        place[turning] += np.where(cursor.ok[turning], jump, 0)
        live = live[cursor.ok[live] & (place[live] < count[live])]
        value = cursor.number(live, kind[live], size[live]) + runs[live]
        out[live, place[live]] = value
        place[live] += 1
        live = live[cursor.ok[live] & (place[live] < count[live])]
    return out


def cut_units(streams: DataFrame, key: list[str], data: str, index: str, carried: Sequence[str] = ()) -> DataFrame:
    """key, unit, _bytes, _first, _end, _count and the carried fields of every unit that the index (array of structs with start, count if it has one, and the carried fields) names."""
    stream = F.coalesce(data, F.lit(b""))
    whole = F.octet_length(stream).cast("long") * 8
    each = streams.select(*key, stream.alias("_data"), F.col(index).alias("_index"), whole.alias("_whole"), F.posexplode(index).alias("_unit", "_at"))
    end = F.coalesce(F.try_element_at("_index", F.col("_unit") + 2)["start"].cast("long"), F.col("_whole"))
    first = F.col("_at.start").cast("long")
    start = F.shiftright(first, 3)
    length = F.greatest(F.lit(0), F.shiftright(end + 7, 3) - start)
    counted = "count" in streams.schema[index].dataType.elementType.fieldNames()
    count = F.col("_at.count").cast("long") if counted else F.lit(0).cast("long")
    return each.select(*key, F.col("_unit").cast("long").alias("unit"), F.substring("_data", (start + 1).cast("int"), length.cast("int")).alias("_bytes"), first.alias("_first"), end.alias("_end"), count.alias("_count"), *[F.col(f"_at.{c}").alias(c) for c in carried])


def laid_out(batch: pa.RecordBatch) -> tuple[Cursor, np.ndarray]:
    """A cursor over the bytes of a batch of units, and what to add to a bit's number in its stream to get its place there."""
    cut = batch.column("_bytes")
    lengths = pc.binary_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
    base = 8 * (np.cumsum(lengths) - lengths)
    data = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(cut)], pa.int32()), cut), b"")[0].as_buffer(), np.uint8)
    first, end = (batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("_first", "_end"))
    shift = base - (first >> 3 << 3)
    return Cursor(data, first + shift, np.minimum(end, (first >> 3 << 3) + 8 * lengths) + shift), shift


def decode(streams: DataFrame, key: list[str], data: str, index: str) -> DataFrame:
    """key, unit, start_bit, end_bit, ok and values (array) of every unit.

    data is a column of bytes; index one of arrays of structs (start, count): a unit's first
    bit, ascending, and its number of values. A unit's bytes end where the next one's
    begin; only these go to the task that decodes it. end_bit is where its symbols end. A
    null index has no units; the units of a null or empty stream fail.
    """
    kinds = dict(streams.dtypes)
    names = [*key, "unit", "start_bit", "end_bit", "ok", "values"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cursor, shift = laid_out(batch)
            count = batch.column("_count").to_numpy(zero_copy_only=False).astype(np.int64)
            values = read_units(cursor, count)
            inside = np.arange(values.shape[1]) < count[:, None]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(values[inside]), mask=pa.array(~cursor.ok))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in (*key, "unit")), batch.column("_first"), pa.array(cursor.at - shift), pa.array(cursor.ok), lists], names)

    fields = ", ".join(f"`{k}` {kinds[k]}" for k in key)
    return cut_units(streams, key, data, index).mapInArrow(run, f"{fields}, unit long, start_bit long, end_bit long, ok boolean, values array<long>")


def low_first(value, width) -> Column:
    """A number as so many bits, the lowest first, as text."""
    width = as_column(width)
    return F.when(width > 0, F.reverse(F.lpad(F.bin(as_column(value)), width.cast("int"), F.lit("0")))).otherwise("")


def number_code(value, kind: int, size) -> Column:
    """The bits of a number of a kind, as text."""
    value, size = as_column(value), as_column(size)
    if kind == FIXED:
        return low_first(value, size)
    if kind == MARK:
        return F.when(value == 0, "0").when(value == 1, "10").otherwise("11")
    ones = F.repeat(F.lit("1"), F.call_function("shiftright", value, size.cast("int")).cast("int"))
    low = value.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), size.cast("int")) - 1)
    return F.concat(ones, F.lit("0"), low_first(low, size))


def kind_code(kind: int, size) -> Column:
    """The bits that state a kind and its size, as text."""
    size = as_column(size)
    if kind == FIXED:
        return F.concat(F.lit("00"), F.when(size > 0, F.concat(F.lit("1"), low_first(size - 1, F.lit(5)))).otherwise("0"))
    return F.lit("10") if kind == MARK else F.concat(low_first(F.lit(kind), F.lit(2)), low_first(size, F.lit(4)))


def unit_code(values: Column, kind: int, size, runs: tuple[int, object] | None = None) -> Column:
    """The bits of a unit, as text: values (array, none negative) as numbers of a kind, or as runs of zeros (kind, size) and values less one in turn."""
    if runs is None:
        body = F.array_join(F.transform(values, lambda x: number_code(x, kind, size)), "")
        return F.concat(F.lit("0"), kind_code(kind, size), body)
    start = F.struct(F.lit("").alias("code"), F.lit(0).cast("long").alias("zeros"))

    def step(s: Column, x: Column) -> Column:
        told = F.concat(s["code"], number_code(s["zeros"], *runs), number_code(x - 1, kind, size))
        return F.when(x == 0, F.struct(s["code"].alias("code"), (s["zeros"] + 1).alias("zeros"))).otherwise(F.struct(told.alias("code"), F.lit(0).cast("long").alias("zeros")))

    body = F.aggregate(values, start, step, lambda s: F.when(s["zeros"] > 0, F.concat(s["code"], number_code(s["zeros"], *runs))).otherwise(s["code"]))
    return F.concat(F.lit("11"), kind_code(kind, size), kind_code(*runs), body)


def packed(bits: Column) -> Column:
    """Bits as text to bytes, the first bit lowest; the last byte is filled with zeros."""
    words = F.regexp_extract_all(bits, F.lit(".{1,64}"), F.lit(0))  # one pass: a substring by place would start anew for each word
    text = F.array_join(F.transform(words, lambda w: F.lpad(F.conv(F.reverse(F.rpad(w, 64, "0")), 2, 16), 16, "0")), "")
    text = F.regexp_replace(text, "(..)" * 8, "$8$7$6$5$4$3$2$1")  # words have their last byte first
    return F.substring(F.unhex(text), 1, F.shiftright(F.length(bits) + 7, 3))
