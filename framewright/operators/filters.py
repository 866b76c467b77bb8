"""Finite filters, carries of absolute and differential updates, and sparse convolutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.operators import ordered
from framewright.operators.mixing import literals
from framewright.operators.ordered import BLOCK, neighbours


def fir_terms(value: str, taps: list[int], window) -> Column:
    """Sum of tap k times the value k rows back; zero before the first row."""
    total = F.lit(0).cast("long")
    for k, tap in enumerate(taps):
        if tap:
            total = total + F.lit(tap).cast("long") * (F.lag(value, k, 0).over(window) if k else F.col(value))
    return total


def absolute_delta(df: DataFrame, key: list[str], order: str, tracks: list[tuple[str, str, str]], block: int = BLOCK) -> DataFrame:
    """key, order and, per track (absolute, delta, name), the value: the last absolute plus the deltas since.

    All tracks are carried together, in one pass. With a running sum S of the deltas, the value
    is S minus S at the last absolute row plus that absolute; both begin anew in each block, and
    what a block takes from those before it comes from block summaries, in two levels. Null
    before the first absolute.
    """
    return ordered.restarted_sums(df, key, order, {n: (F.col(a), F.col(d)) for a, d, n in tracks}, block)


def upsample(df: DataFrame, key: list[str], order: str, value: str, taps: list[int], factor: int) -> DataFrame:
    """Polyphase interpolation: output phase p adds taps[p + factor * k] times the value k rows back."""
    depth = len(taps) // factor
    phases = lambda w: F.array(*[fir_terms(value, [taps[p + factor * k] for k in range(depth)], w) for p in range(factor)])
    made = neighbours(df, key, order, {"_y": phases}, before=depth - 1)
    split = made.select(*key, order, F.posexplode("_y").alias("_p", "y"))
    return split.select(*key, (F.col(order) * factor + F.col("_p")).alias(order), "y")


def spread(signal: DataFrame, taps: list[tuple[int, int]]) -> DataFrame:
    """channel, frame, y: each sample's share at each frame it reaches through the taps (lag, gain)."""
    each = signal.select("channel", "frame", "x", F.explode(literals(taps, ["lag", "gain"])).alias("t"))
    return each.select("channel", (F.col("frame") + F.col("t.lag").cast("long")).alias("frame"), (F.col("x") * F.col("t.gain").cast("long")).alias("y"))


def scatter(signal: DataFrame, taps: list[tuple[int, int]]) -> DataFrame:
    """channel, frame, y for the signal's own frames: the sparse filter's output."""
    own = signal.select("channel", "frame", F.lit(0).cast("long").alias("y"), F.lit(1).alias("_own"))
    reached = spread(signal, taps).withColumn("_own", F.lit(0))
    return own.unionByName(reached).groupBy("channel", "frame").agg(F.sum("y").alias("y"), F.max("_own").alias("_own")).filter("_own = 1").drop("_own")
