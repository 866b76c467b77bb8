"""Frames predicted by filters that change from unit to unit: order and coefficients come with each unit.

Coefficients are fixed-point numbers of 23 fractional bits, stated as reflection
coefficients; ``stepped_up`` turns those of all units to filters at once. Products
are divided toward zero, sums wrap to 32 bits. ``restore`` is a decoder for
``recursions.decode_units``: it steps through time for all units of a batch.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.fixed import trunc_div, wrap32
from framewright.operators.recursions import decode_units

ORDERS, ONE = 16, 1 << 23


def toward_zero(x: np.ndarray) -> np.ndarray:
    """Products of two fixed-point numbers, as one."""
    return np.where(x < 0, -(-x >> 23), x >> 23)


def wrapped(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).astype(np.uint32).astype(np.int32).astype(np.int64)


def stepped_up(reflections: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Filters from reflection coefficients, unit by place; the first order places of a unit hold, the oldest sample's first."""
    out = np.zeros_like(reflections)
    if not out.shape[1]:
        return out
    out[:, 0] = reflections[:, 0]
    for n in range(1, out.shape[1]):
        going = order > n
        k = reflections[going, n]
        turned = wrapped(out[going, :n] - toward_zero(k[:, None] * out[going, n - 1 :: -1][:, :n]))
        out[going, :n] = turned
        out[going, n] = k
    return np.where(np.arange(out.shape[1]) < order[:, None], out, 0)


def restore(grids: dict[str, np.ndarray], live: np.ndarray) -> dict[str, np.ndarray]:
    """Samples from residual, order, scale and k0, k1, ... of each unit; nothing is heard before a unit's start. choice is handed on."""
    residual = grids["residual"]
    x = np.zeros_like(residual)
    if not len(live):
        return {"choice": grids["choice"], "residual": residual, "x": x}
    order = grids["order"][0]
    reflections = np.stack([grids[f"k{n}"][0] for n in range(sum(c[0] == "k" and c[1:].isdigit() for c in grids))], axis=1)
    filters = stepped_up(reflections, order)
    width = filters.shape[1]
    aligned = np.zeros_like(filters)  # the newest sample's coefficient last
    for n in range(1, width + 1):
        own = order == n
        aligned[own, width - n :] = filters[own, :n]
    heard = np.zeros((len(order), width), np.int64)
    for t, m in enumerate(live):
        guess = toward_zero((aligned[:m] * heard[:m]).sum(axis=1))
        x[t, :m] = wrapped(grids["scale"][t, :m] * residual[t, :m] + guess)
        heard[:m] = np.concatenate([heard[:m, 1:], x[t, :m, None]], axis=1)
    return {"choice": grids["choice"], "residual": residual, "x": x}


def residuals(samples: DataFrame, key: list[str], order: str, value: str, filters: list[list[int]], window) -> DataFrame:
    """samples with r0, r1, ...: what each filter (the oldest sample's coefficient first) leaves of value within window."""

    def left(taps: list[int]) -> Column:
        n = len(taps)
        total = sum((F.lit(c).cast("long") * F.lag(value, n - k, 0).over(window) for k, c in enumerate(taps)), F.lit(0).cast("long"))
        return wrap32(F.col(value) - trunc_div(total, F.lit(ONE)))

    return samples.select("*", *[left(t).alias(f"r{k}") for k, t in enumerate(filters)])


def coded(samples: DataFrame, key: list[str], order: str, value: str, reflections: list[list[int]], window) -> DataFrame:
    """key, order, choice, residual and the parameters that ``restore`` takes: each unit (key) with the filter that leaves least.

    window is over the key, by order; units are of bounded length.
    """
    width = max(1, *map(len, reflections))
    table = [k + [0] * (width - len(k)) for k in reflections]
    made = stepped_up(np.array(table, np.int64), np.array([len(k) for k in reflections]))
    filters = [made[n, : len(k)].tolist() for n, k in enumerate(reflections)]
    tried = residuals(samples, key, order, value, filters, window)
    sums = tried.groupBy(*key).agg(*[F.sum(F.abs(f"r{n}")).alias(f"s{n}") for n in range(len(filters))])
    best = F.array_min(F.array(*[F.struct(F.col(f"s{n}").alias("s"), F.lit(n).alias("n")) for n in range(len(filters))]))["n"]
    chosen = sums.select(*key, best.alias("choice"))
    met = tried.join(chosen, key)
    pick = lambda xs: F.element_at(F.array(*xs), F.col("choice") + 1)
    told = [pick([F.lit(k[n]).cast("long") for k in table]).alias(f"k{n}") for n in range(width)]
    residual = pick([F.col(f"r{n}") for n in range(len(filters))]).alias("residual")
    return met.select(*key, order, "choice", residual, F.lit(1).cast("long").alias("scale"), pick([F.lit(len(k)).cast("long") for k in reflections]).alias("order"), *told)


def restored(frames: DataFrame, key: list[str], order: str) -> DataFrame:
    """key, order, choice, residual and x of what ``coded`` gives, or of units read from a stream with the same columns."""
    return decode_units(frames, key, order, {"choice": "long", "residual": "long", "x": "long"}, restore)
