"""Mixing: matrices of (source, destination, gain) applied to a long signal.

A signal has channel, frame and an integer sample x; (channel, frame) is unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions import fixed


def literals(rows: list[tuple], names: list[str]) -> Column:
    """A short table written out in the program, as an array of rows."""
    return F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(r, names, strict=True)]) for r in rows])


def mix(signal: DataFrame, rules: list[tuple[str, str, int]]) -> DataFrame:
    """Sum over rules (src, dst, q23) of each product, truncated one by one. Channels without a rule vanish; nothing is joined."""
    own = {src: literals([r[1:] for r in rules if r[0] == src], ["dst", "q23"]) for src, *_ in rules}
    told = F.create_map(*[x for src, found in own.items() for x in (F.lit(src), found)])
    q23 = F.col("r.q23").cast("long")
    parts = signal.select("frame", "x", F.explode(F.try_element_at(told, F.col("channel"))).alias("r"))
    return parts.groupBy(F.col("r.dst").alias("channel"), "frame").agg(F.sum(fixed.q23_mul("x", q23)).alias("x"))


def rescale(signal: DataFrame, scalers: list[tuple[str, float]]) -> DataFrame:
    """Samples divided by their channel's scaler, toward zero; channels with no positive scaler vanish."""
    usable = [(c, s) for c, s in scalers if s > 0]
    own = F.try_element_at(F.create_map(*[F.lit(x) for pair in usable for x in pair]), F.col("channel"))
    return signal.withColumn("_s", own).filter("_s is not null").select("channel", "frame", (F.col("x") / F.col("_s")).cast("long").alias("x"))


def side_by_side(signal: DataFrame, names: dict[str, str]) -> DataFrame:
    """frame and a column for each channel (name -> channel), null where it has no sample: one pass and one shuffle by frame."""
    wide = [F.max(F.when(F.col("channel") == ch, F.col("x"))).alias(n) for n, ch in names.items()]
    return signal.filter(F.col("channel").isin(*names.values())).groupBy("frame").agg(*wide)


def crossfade(old: DataFrame, new: DataFrame, length: int) -> DataFrame:
    """frame, x: old fades out while new fades in over length frames; each product is truncated."""
    t = F.col("frame") / float(length)
    joined = new.select("frame", F.col("x").alias("n")).join(old.select("frame", F.col("x").alias("o")), "frame")
    return joined.select("frame", ((F.col("n") * t).cast("long") + (F.col("o") * (1.0 - t)).cast("long")).alias("x"))
