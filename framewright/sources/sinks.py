"""Sinks that account for what they wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_checked(df: DataFrame, path: str, part: str) -> DataFrame:
    """Write df by part; per part the rows declared, the rows the sink now holds, and whether they agree."""
    df.write.partitionBy(part).parquet(path)
    held = df.sparkSession.read.parquet(path).groupBy(part).agg(F.count(F.lit(1)).alias("written"))
    declared = df.groupBy(part).agg(F.count(F.lit(1)).alias("declared"))
    same = declared[part].eqNullSafe(held[part])
    written = F.coalesce("written", F.lit(0))
    return declared.join(held, same, "left").select(declared[part], "declared", written.alias("written"), (F.col("declared") == written).alias("complete"))
