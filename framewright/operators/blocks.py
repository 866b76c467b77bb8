"""Aggregates over fixed blocks of a signal, and quality figures.

Sums of squares are exact integers while a block has at most 2^16 samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions import fixed


def block_of(frame: str = "frame", size: int = 32) -> Column:
    return fixed.trunc_div(frame, F.lit(size).cast("long"))


def block_energy(signal: DataFrame, size: int = 32) -> DataFrame:
    """channel, blk, energy, peak, n."""
    x = F.col("x")
    return signal.groupBy("channel", block_of(size=size).alias("blk")).agg(F.sum(x * x).alias("energy"), F.max(F.abs(x)).alias("peak"), F.count(F.lit(1)).alias("n"))


def ring_sum(blocks: DataFrame, value: str, name: str, ring: int = 16, span: int = 4096) -> DataFrame:
    """blocks with the sum of value over the last ring blocks; windows hold one span of blocks and a halo."""
    from framewright.operators.ordered import neighbours

    frame = lambda w: F.sum(value).over(w.rowsBetween(-(ring - 1), 0))
    return neighbours(blocks, ["channel"], "blk", {name: frame}, before=ring - 1, block=span)


def quality(pairs: DataFrame, key: list[str]) -> DataFrame:
    """key, n, sum_sq (of a - b), peak; the parts of a mean squared error that can be added up."""
    d = F.col("a") - F.col("b")
    return pairs.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum(d * d).alias("sum_sq"), F.max(F.abs(d)).alias("peak"))


def pearson(pairs: DataFrame, key: list[str]) -> DataFrame:
    """key, r: correlation of a and b from six integer sums; null if either does not vary."""
    a, b = F.col("a").cast("decimal(38,0)"), F.col("b").cast("decimal(38,0)")
    sums = pairs.groupBy(*key).agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(e).cast("double").alias(k) for k, e in (("sa", a), ("sb", b), ("saa", a * a), ("sbb", b * b), ("sab", a * b))])
    va, vb = F.col("n") * F.col("saa") - F.col("sa") ** 2, F.col("n") * F.col("sbb") - F.col("sb") ** 2
    r = (F.col("n") * F.col("sab") - F.col("sa") * F.col("sb")) / F.sqrt(va * vb)
    return sums.select(*key, F.when((va > 0) & (vb > 0), r).alias("r"))


def keep_best_and_neighbours(df: DataFrame, key: list[str], order: str, score: str) -> DataFrame:
    """Rows next to, or at, the first row of the highest score of each key. A key's rows are a short candidate list."""
    w = Window.partitionBy(*key).orderBy(order)
    ranked = df.withColumn("_at", F.row_number().over(w)).withColumn("_best", F.max(F.struct(F.col(score), -F.col("_at"))).over(Window.partitionBy(*key)))
    return ranked.filter(F.abs(F.col("_at") + F.col("_best.col2")) <= 1).drop("_at", "_best")
