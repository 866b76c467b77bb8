"""Routes of channels from layout to layout: rules are followed until a channel of the target is reached.

A rule sends a channel to others with gains. What a source channel gives to a target
channel is the sum over all ways of the products along them. Rules are a short list
without cycles, so the depth of the search is known and the closure is as many narrow
steps; only the last one sums. Rules that form a cycle are an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions import bits
from framewright.operators.mixing import literals


def depth(rules: list[tuple[int, int, float]]) -> int:
    """The longest way along rules."""
    below: dict[int, set[int]] = {}
    for src, dst, _ in rules:
        below.setdefault(src, set()).add(dst)
    reach, way = set(below), 0
    while reach:
        way += 1
        reach = {d for s in reach for d in below.get(s, ()) if d in below}
        if way > len(below):
            raise ValueError("the rules form a cycle")
    return way


def closure(pairs: DataFrame, source: str, target: str, rules: list[tuple[int, int, float]]) -> DataFrame:
    """pairs with src, dst and gain: for layouts (masks of channels) source and target, the gain of each channel of one into one of the other.

    A channel that the target has goes to itself with gain 1; one without a way to the
    target vanishes.
    """
    step = F.create_map(*[x for s in sorted({r[0] for r in rules}) for x in (F.lit(s), literals([(r[1], r[2]) for r in rules if r[0] == s], ["dst", "gain"]))])
    inside: Column = bits.has_all(target, bits.mask_of(F.col("dst")))
    found = pairs.withColumn("src", F.explode(bits.set_bits(source))).withColumns({"dst": F.col("src"), "gain": F.lit(1.0)})
    for _ in range(depth(rules)):
        own = F.array(F.struct(F.col("dst"), F.lit(1.0).alias("gain")))
        ways = F.when(inside, own).otherwise(F.coalesce(F.try_element_at(step, F.col("dst")), F.array()))
        moved = found.withColumn("_w", F.explode(ways))
        found = moved.select(*pairs.columns, "src", F.col("_w.dst").alias("dst"), (F.col("gain") * F.col("_w.gain")).alias("gain"))
    return found.filter(inside).groupBy(*pairs.columns, "src", "dst").agg(F.sum("gain").alias("gain"))
