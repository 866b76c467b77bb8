"""Lookup joins: small dimensions, defaults, division, ranges and grids.

A dimension is broadcast only if the optimizer's own size check allows it; hints are
used for literal tables alone, whose size is the program's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def literal(df: DataFrame) -> DataFrame:
    """A table written out in the program, as broadcast side of a join."""
    return F.broadcast(df)


def lookup_or(df: DataFrame, dimension: DataFrame, on: list[str], defaults: dict[str, Column]) -> DataFrame:
    """df with the dimension's columns; a default where no row matches. Dimension keys are unique."""
    joined = df.join(dimension, on, "left")
    return joined.select(*df.columns, *[F.coalesce(n, d).alias(n) for n, d in defaults.items()])


def first_match(df: DataFrame, candidates: DataFrame, on: list[str], order: list, columns: list[str]) -> DataFrame:
    """df left-joined with the first candidate of each key in order; map-side combined, no window."""
    best = candidates.groupBy(*on).agg(F.min(F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], *columns)).alias("_b"))
    return df.join(best, on, "left").select(*df.columns, *[F.col(f"_b.{c}").alias(c) for c in columns])


def divides(members: DataFrame, key: str, item: str, required: DataFrame) -> DataFrame:
    """Keys that hold every required item (relational division); all keys if nothing is required."""
    need = required.select(item).distinct()
    wanted = need.agg(F.count(F.lit(1)).alias("_need"))
    have = members.join(need, item, "left_semi").groupBy(key).agg(F.countDistinct(item).alias("_have"))
    keys = members.select(key).distinct().join(have, key, "left")
    return keys.join(F.broadcast(wanted), F.coalesce("_have", F.lit(0)) == F.col("_need")).select(key)  # one row


def interval_members(points: DataFrame, spans: DataFrame, at: str, low: str, high: str, width: int) -> DataFrame:
    """Points joined to the half-open spans that hold them, by equal buckets of a given width."""
    cells = spans.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width))))
    return points.withColumn("_cell", F.floor(F.col(at) / width)).join(cells, "_cell").filter((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_cell")


def bilinear(points: DataFrame, grid: DataFrame, x: str, y: str, value: str, step_x: int, step_y: int) -> DataFrame:
    """points with value interpolated from the four corners of a regular integer grid (gx, gy, value)."""
    cx, cy = F.floor(F.col(x) / step_x), F.floor(F.col(y) / step_y)
    fx, fy = F.col(x) / step_x - cx, F.col(y) / step_y - cy
    corners = points.withColumn("_id", F.struct(*points.columns)).select(
        "*",
        F.explode(
            F.array(
                *[
                    F.struct((cx + i).cast("long").alias("gx"), (cy + j).cast("long").alias("gy"), ((fx if i else 1 - fx) * (fy if j else 1 - fy)).alias("w"))
                    for i in (0, 1)
                    for j in (0, 1)
                ]
            )
        ).alias("c"),
    )
    met = corners.select("_id", "c.*").join(grid, ["gx", "gy"])
    return met.groupBy("_id").agg(F.sum(F.col("w") * F.col(value)).alias(value)).select("_id.*", value)


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")


def priority_first(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row of each key: the first in order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_rn = 1").drop("_rn")
