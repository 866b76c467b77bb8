"""Filling capacity: the i-th item of a payload goes to the i-th place that can take one.

Carrier rows have room for so many items each; both sides are numbered by blocks, and
items meet places in a join on their number. So no task sees a whole key, and a key that
holds most rows is spread by its numbers.

``plan`` gives the bit lines of a carrier's samples in the order in which they are filled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.operators.ordered import running_sum

#: Samples at a unit's start that are filled line by line.
HEAD = 16


def plan(unit: int, lines: int) -> list[list[tuple[int, int]]]:
    """For each sample of a unit, its (place in the order of filling, bit line) pairs.

    The first HEAD samples take the three lowest lines, one line after another, and
    then, sample by sample, their other lines from the top. All later samples take their lines from the top;
    every HEAD-th one leaves out its lowest.
    """
    if unit < HEAD or not 3 <= lines <= 16:
        raise ValueError("a unit needs at least 16 samples and 3 to 16 bit lines")
    low = [(sample, line) for line in range(3) for sample in range(HEAD)]
    high = [(sample, line) for sample in range(HEAD) for line in range(lines - 1, 2, -1)]
    rest = [(sample, line) for sample in range(HEAD, unit) for line in range(lines - 1, -1 if sample % HEAD else 0, -1)]
    out: list[list[tuple[int, int]]] = [[] for _ in range(unit)]
    for place, (sample, line) in enumerate([*low, *high, *rest]):
        out[sample].append((place, line))
    return out


def slots(sample: Column, unit: int, lines: int) -> Column:
    """The (place, line) pairs of a sample of a unit, as an array of structs."""
    made = plan(unit, lines)
    pair = lambda place, line: F.struct(place.cast("int").alias("place"), line.cast("int").alias("line"))
    head = F.array(*[F.array(*[pair(F.lit(p), F.lit(b)) for p, b in own]) for own in made[:HEAD]])
    # beyond the head a sample's first place and lines follow from its number
    before = F.lit(HEAD * lines) + (sample - HEAD) * lines - F.floor((sample - 1) / HEAD)
    last = F.when(sample % HEAD == 0, 1).otherwise(0)
    rest = F.transform(F.sequence(F.lit(0), F.lit(lines - 1) - last), lambda k: pair(before + k, F.lit(lines - 1) - k))
    return F.when(sample < HEAD, F.element_at(head, F.least(sample, F.lit(HEAD - 1)).cast("int") + 1)).otherwise(rest)


def numbered(df: DataFrame, key: list[str], order: str, name: str = "rank") -> DataFrame:
    """df with name: the row's number within its key, from 0, by order."""
    return running_sum(df, key, order, F.lit(1).cast("long"), name).withColumn(name, F.col(name) - 1)


def fill(places: DataFrame, payload: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows of places that got an item, with its columns; both have key and order, unique within a key.

    Items beyond the last place are left over; ``numbered`` tells which.
    """
    items = numbered(payload, key, order, "_rank").drop(order)
    return numbered(places, key, order, "_rank").join(items, [*key, "_rank"]).drop("_rank")
