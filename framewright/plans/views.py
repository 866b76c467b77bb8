"""Canonical views over the given tables, and their DuckDB text.

``sig`` is the long form of a multichannel signal: one row per channel and frame
with a signed 24-bit sample. ``frame`` numbers a channel's rows in time order. The
numbering goes by minutes: rows are ranked within a minute and a running sum over the
counts of a channel's minutes, some half a million a year, gives the offsets, so no
task sees a whole channel.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.session import table

RAIL = 8388608


class Views:
    """Lazy access to the tables of one data directory and the views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return table(self.spark, self.sf_dir, name)

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        """Spark SQL over frames given by name; only for this call."""
        return self.spark.sql(text, **frames)

    @cached_property
    def sig(self) -> DataFrame:
        """channel, frame, x: events by type."""
        return signal(self.events, "event_type")

    @cached_property
    def usig(self) -> DataFrame:
        """channel, frame, x: events by user, for operators that run one group per task."""
        return signal(self.events, "user_id")

    @cached_property
    def vec(self) -> DataFrame:
        """vec_id, label, i, v: embedding components as integers of a thousandth."""
        return self.embeddings.select("vec_id", F.col("label").cast("long").alias("label"), F.posexplode("embedding").alias("i", "e")).select(
            "vec_id", "label", F.col("i").cast("long").alias("i"), F.floor(F.col("e").cast("double") * 1000).cast("long").alias("v")
        )


def signal(events: DataFrame, channel: str) -> DataFrame:
    """The long form of a signal whose channels are a column of events."""
    bucket = F.unix_timestamp("ts").cast("long")
    keyed = events.select(F.col(channel).alias("channel"), "ts", "event_id", "value", F.floor(bucket / 60).alias("_bucket"))
    counts = keyed.groupBy("channel", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    running = F.sum("_n").over(Window.partitionBy("channel").orderBy("_bucket")) - F.col("_n")
    offsets = counts.select("channel", "_bucket", running.alias("_offset"))
    rank = F.row_number().over(Window.partitionBy("channel", "_bucket").orderBy("ts", "event_id")) - 1
    x = F.greatest(F.lit(-RAIL), F.least(F.lit(RAIL - 1), F.floor((F.col("value") - 250.0) * 32768.0)))
    return (
        keyed.withColumn("_rank", rank)
        .join(offsets, ["channel", "_bucket"])
        .select("channel", (F.col("_offset") + F.col("_rank")).cast("long").alias("frame"), x.cast("long").alias("x"))
    )


def _sig_sql(channel: str) -> str:
    return (
        f"select {channel} as channel, row_number() over (partition by {channel} order by ts, event_id) - 1 as frame, "
        "greatest(-8388608, least(8388607, cast(floor((value - 250.0) * 32768.0) as bigint))) as x from events"
    )


DUCKDB_VIEWS = {
    "sig": _sig_sql("event_type"),
    "usig": _sig_sql("user_id"),
    "vec": "select vec_id, cast(label as bigint) as label, cast(i - 1 as bigint) as i, cast(floor(cast(e as double) * 1000) as bigint) as v "
    "from (select vec_id, label, unnest(embedding) as e, generate_subscripts(embedding, 1) as i from embeddings)",
}


def duckdb(body: str) -> str:
    """body with the views it names in front; it may begin with further CTEs (name as (...), ...) before its select."""
    used = [f"{n} as ({text})" for n, text in DUCKDB_VIEWS.items() if f" {n} " in f" {body} ".replace("\n", " ").replace(")", " ").replace(",", " ")]
    body = body.strip()
    if body.lower().startswith("select"):
        return (f"with {', '.join(used)} " if used else "") + body
    recursive = "recursive " if body.startswith("recursive ") else ""
    body = body.removeprefix("recursive ")
    return f"with {recursive}" + ", ".join([*used, body])
