"""Fixed-point and decibel column expressions.

Integers are BIGINT throughout; 32-bit wrapping is written out, since ANSI mode
raises on overflow. A null in any operand gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Q23, RAIL = 8388608, 8388608
#: Levels that stand for silence, in dB.
MSE_FLOOR, EMPTY_FLOOR = -144.0, -3000.0


def as_column(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def trunc_div(a, b) -> Column:
    """Integer quotient toward zero."""
    return F.call_function("div", as_column(a), as_column(b))


def clear_low_bits(x, bits: int) -> Column:
    """x with its low bits cleared toward zero, not by mask: -3 with one bit gives -2."""
    return trunc_div(x, F.lit(1 << bits)) * F.lit(1 << bits)


def wrap32(x) -> Column:
    """x modulo 2^32, as a signed 32-bit number."""
    return F.pmod(as_column(x) + F.lit(2147483648), F.lit(4294967296)) - F.lit(2147483648)


def clamp(x, low, high) -> Column:
    """x held between low and high."""
    return F.greatest(as_column(low), F.least(as_column(high), as_column(x)))


def sat_add(a, b, low: int = -RAIL, high: int = RAIL - 1) -> Column:
    """a + b, held within the rails."""
    return clamp(as_column(a) + as_column(b), low, high)


def q23_mul(a, b) -> Column:
    """Product of an integer and a Q23 number, toward zero."""
    return trunc_div(as_column(a) * as_column(b), F.lit(Q23))


def q23_mul_biased(a, b) -> Column:
    """The same by adding 2^23 - 1 to negative products before an arithmetic shift."""
    product = as_column(a) * as_column(b)
    return F.shiftright(product + F.when(product < 0, F.lit(Q23 - 1)).otherwise(F.lit(0)), 23)


def zigzag_decode(u) -> Column:
    """0, 1, 2, 3, ... to 0, -1, 1, -2, ..."""
    u = as_column(u)
    return F.shiftright(u, 1).bitwiseXOR(-(u.bitwiseAND(F.lit(1))))


def zigzag_encode(x) -> Column:
    """0, -1, 1, -2, ... to 0, 1, 2, 3, ..."""
    x = as_column(x)
    return F.when(x < 0, -2 * x - 1).otherwise(2 * x)


def sign_extend(x, bits: int) -> Column:
    """An unsigned field of so many bits as a two's complement number."""
    x = as_column(x)
    return F.when(x >= (1 << (bits - 1)), x - F.lit(1 << bits)).otherwise(x)


def round_half_away(x) -> Column:
    """Nearest integer, halves away from zero."""
    x = as_column(x)
    return (F.signum(x) * F.floor(F.abs(x) + 0.5)).cast("long")


def db_to_linear(db) -> Column:
    """10^(dB/20)."""
    return F.pow(F.lit(10.0), as_column(db) / 20.0)


def linear_to_db(x, floor: float = EMPTY_FLOOR) -> Column:
    """20 log10 of a level; the floor where it is not positive."""
    x = as_column(x)
    return F.when(x > 0, F.greatest(F.lit(floor), 20.0 * F.log10(x))).otherwise(F.lit(floor))


def power_to_db(x, floor: float = MSE_FLOOR) -> Column:
    """10 log10 of a power; never below the floor."""
    x = as_column(x)
    return F.when(x > 0, F.greatest(F.lit(floor), 10.0 * F.log10(x))).otherwise(F.lit(floor))
