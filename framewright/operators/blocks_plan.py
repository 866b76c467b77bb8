"""Schedules of blocks of several sizes, and timers over blocks."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sizes that a block may have.
SIZES = [*(s for s in range(256, 1025, 16) if s != 992), 1000]
FULL = 1024
#: Parts that a key's rows are dealt to when they meet its plan.
PARTS = 64


@lru_cache(None)
def tail_plans() -> list[tuple[int, int, int, int]]:
    """(tail, ord, start, size) for every tail up to two full blocks: least padding, then fewest, then larger blocks first."""
    sums = [(s, 1, -s, (s,)) for s in SIZES] + [(a + b, 2, -a, (a, b)) for a in SIZES for b in SIZES if b <= a]
    sums.sort()
    out, at = [], 0
    for tail in range(1, 2 * FULL):
        while sums[at][0] < tail:
            at += 1
        start = 0
        for k, size in enumerate(sums[at][3]):
            out.append((tail, k, start, size))
            start += size
    return out


def scheduled(df: DataFrame, key: str, order: str) -> DataFrame:
    """df with block and size: full blocks first, then the plan of what is left of the key's length.

    A key's plan has three rows at most; it is repeated for each of PARTS, so that a key with most rows meets it in many tasks.
    """
    spark = df.sparkSession
    length = df.groupBy(F.col(key).alias("_key")).agg((F.max(order) + 1).alias("_length"))
    full = F.greatest(F.lit(0), F.floor(F.col("_length") / FULL) - 1).cast("long")
    sized = length.withColumn("_full", full).withColumn("_tail", F.col("_length") - full * FULL)
    # Of fixed size: at most two rows for each of 2047 tails.
    plans = F.broadcast(spark.createDataFrame(tail_plans(), "_tail long, _ord long, _start long, size long"))
    early = sized.withColumn("_ord", F.lit(-1).cast("long")).select("_key", "_full", "_ord", F.lit(0).cast("long").alias("_start"), F.lit(FULL).cast("long").alias("size")).filter("_full > 0")
    late = sized.join(plans, "_tail").select("_key", "_full", "_ord", (F.col("_full") * FULL + F.col("_start")).alias("_start"), "size")
    spans = early.unionByName(late).withColumn("_stop", F.when(F.col("_ord") < 0, F.col("_full") * FULL).otherwise(F.col("_start") + F.col("size")))
    at = F.col(order)
    spans = spans.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    part = F.pmod(F.floor(at / FULL), F.lit(PARTS))
    met = df.join(spans, F.col(key).eqNullSafe(F.col("_key")) & (part == F.col("_part")) & (at >= F.col("_start")) & (at < F.col("_stop")))
    block = F.when(F.col("_ord") < 0, F.floor(at / FULL)).otherwise(F.col("_full") + F.col("_ord")).cast("long")
    return met.select(*df.columns, block.alias("block"), "size")


def timers(units: DataFrame, periods: dict[str, int], size: int) -> DataFrame:
    """units' columns and timer for each emission: a timer that fired in a unit is armed again period - 1 after the unit's end.

    With units of one size it fires in every (1 + (period - 1) div size)-th unit. The timers are a short literal list.
    """
    fired = F.array(*[F.when(F.col("unit") % (1 + (p - 1) // size) == 0, F.lit(n)) for n, p in periods.items()])
    return units.select(*units.columns, F.explode(F.array_compact(fired)).alias("timer"))
