"""Bit-field, bit-string and checksum column expressions over BIGINT and STRING."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framewright.functions.fixed import as_column


def mask_of(bit) -> Column:
    """2^bit."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), as_column(bit).cast("int"))


def has_all(mask, need) -> Column:
    """Whether all bits of need are in mask."""
    return as_column(mask).bitwiseAND(as_column(need)) == as_column(need)


def only(mask, allowed) -> Column:
    """Whether mask has no bit outside allowed."""
    return as_column(mask).bitwiseAND(F.bitwise_not(as_column(allowed))) == 0


def set_bits(mask, width: int = 31) -> Column:
    """The places of the bits that are set, ascending."""
    return F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.call_function("shiftright", as_column(mask), i).bitwiseAND(F.lit(1)) == 1)


def field(word, shift: int, bits: int) -> Column:
    """An unsigned field of a word."""
    return F.shiftright(as_column(word), shift).bitwiseAND(F.lit((1 << bits) - 1))


def binary(x, width: int) -> Column:
    """x in so many binary digits."""
    return F.lpad(F.bin(as_column(x)), width, "0")


def rice_code(v, k: int) -> Column:
    """Golomb-Rice code of a non-negative number: quotient in unary, a zero, k low bits."""
    v = as_column(v)
    ones = F.repeat(F.lit("1"), F.shiftright(v, k).cast("int"))
    tail = binary(v.bitwiseAND(F.lit((1 << k) - 1)), k) if k else F.lit("")
    return F.concat(ones, F.lit("0"), tail)


def rice_decode(code, k: int) -> Column:
    """The number of one Golomb-Rice code."""
    ones = F.length(F.regexp_extract(as_column(code), "^1*", 0))
    tail = F.substring(as_column(code), ones + 2, F.lit(k)) if k else None
    low = F.conv(tail, 2, 10).cast("long") if k else F.lit(0).cast("long")
    return ones.cast("long") * F.lit(1 << k) + low


def crc16(values, start: int = 0xFFFF) -> Column:
    """CRC-16 with polynomial 0x1021 over an array of byte values: a fold over their bits."""
    bits = F.flatten(F.transform(as_column(values), lambda b: F.transform(F.sequence(F.lit(7), F.lit(0), F.lit(-1)), lambda i: F.call_function("shiftright", b, i).bitwiseAND(F.lit(1)))))

    def step(crc: Column, bit: Column) -> Column:
        shifted = F.shiftleft(crc, 1).bitwiseAND(F.lit(0xFFFF))
        return shifted.bitwiseXOR(F.shiftright(crc, 15).bitwiseXOR(bit) * F.lit(0x1021))

    return F.aggregate(bits, F.lit(start).cast("long"), step)
