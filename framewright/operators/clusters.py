"""Summaries that add up, merge costs, and a greedy online learner per group."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Clusters up to which pairs are made, and a list is sorted in one task.
MOST = 4096


def short(clusters: DataFrame, most: int = MOST) -> DataFrame:
    """clusters, counted; more than most are an error."""
    if clusters.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} clusters: their pairs grow with the square, and their order takes one task")
    return clusters


def summary(points: DataFrame, key: list[str], value: str) -> DataFrame:
    """key, n, s (sum), ss (sum of squares)."""
    return points.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss"))


def ward_costs(clusters: DataFrame) -> DataFrame:
    """a, b, cost of merging each pair of a short list of clusters (id, n, s); more than MOST are an error."""
    clusters = short(clusters)
    left = clusters.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("s").cast("double").alias("sa"))
    right = clusters.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("s").cast("double").alias("sb"))
    energy = lambda s, n: s * s / n
    cost = energy(F.col("sa"), F.col("na")) + energy(F.col("sb"), F.col("nb")) - energy(F.col("sa") + F.col("sb"), F.col("na") + F.col("nb"))
    return left.join(right, F.col("a") < F.col("b")).select("a", "b", cost.alias("cost"))


def bins(signal: DataFrame, shift: int, half_bins: int = 100) -> DataFrame:
    """signal with bin: samples rounded to steps of 2^shift, counted from -half_bins."""
    offset = F.lit(half_bins * (1 << shift) + (1 << (shift - 1))).cast("long")
    return signal.withColumn("bin", F.shiftright(F.col("x") + offset, shift))


def bin_codes(binned: DataFrame, n_bins: int = 201) -> DataFrame:
    """bin, n, code: bins in range by falling count, the higher bin first on ties. At most n_bins rows reach the sort."""
    counts = binned.filter(F.col("bin").between(0, n_bins - 1)).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(F.desc("n"), F.desc("bin"))
    return counts.withColumn("code", (F.row_number().over(order) - 1).cast("long"))


def by_population(clusters: DataFrame) -> DataFrame:
    """A short list of clusters (label, n) with pos, from 1, by falling population; more than MOST are an error."""
    return short(clusters).withColumn("pos", F.row_number().over(Window.orderBy(F.desc("n"), "label")).cast("long"))


#: Points of a key that one task learns from at a time, and units whose clusters are learned together.
UNIT, TOGETHER = 4096, 64


def learn(points: list[tuple[int, int]], limit: int) -> list[tuple[int, int]]:
    """(n, sum) of at most limit clusters: each point (n, sum) starts one, and the cheapest pair is merged when there are too many.

    Pairs wait in a heap by (cost, older, younger); entries of clusters that have
    since been merged are skipped.
    """
    live: dict[int, tuple[int, int]] = {}
    heap: list[tuple[float, int, int]] = []
    new = 0

    def add(n: int, s: int) -> None:
        nonlocal new
        for other, (m, t) in live.items():
            cost = s * s / n + t * t / m - (s + t) ** 2 / (n + m)
            heapq.heappush(heap, (cost, other, new))
        live[new] = (n, s)
        new += 1

    for n, s in points:
        add(n, s)
        while len(live) > limit:
            _, a, b = heapq.heappop(heap)
            if a in live and b in live:
                (n, s), (m, t) = live.pop(a), live.pop(b)
                add(n + m, s + t)
        if len(heap) > 64 * limit * limit:
            heap = [x for x in heap if x[1] in live and x[2] in live]
            heapq.heapify(heap)
    return list(live.values())


def _units(points: DataFrame, key: str, order: str, value: str, unit: int) -> DataFrame:
    """key, _unit and _xs: the values of each unit, in order."""
    cut = points.select(key, order, value, F.floor(F.col(order) / unit).cast("long").alias("_unit"))
    return cut.groupBy(key, "_unit").agg(F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda r: r[value]).alias("_xs"))


def online(points: DataFrame, key: str, order: str, value: str, limit: int, unit: int = UNIT) -> DataFrame:
    """key, cluster, n, s: the learner over each unit of a key's points, in order, and then over the units' clusters.

    Units are merged as a tree: TOGETHER units that follow each other are learned as one, in their order, until a key
    has no more than TOGETHER; a task sees limit * TOGETHER clusters. Of one unit, its clusters are those of the unit.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [learn([(1, x) for x in xs], limit) for xs in batch.column(2).to_pylist()]
            made = pa.array([[{"n": n, "s": s} for n, s in x] for x in found], pa.list_(pa.struct([("n", pa.int64()), ("s", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), made], [key, "_unit", "_found"])

    def then(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rank, clusters = [], [], []
            for k, units in enumerate(batch.column(1).to_pylist()):
                found = [(c["n"], c["s"]) for u in units for c in u["_found"]]
                found = sorted(learn(found, limit) if len(units) > 1 else found, key=lambda c: -c[0])
                at += [k] * len(found)
                rank += range(len(found))
                clusters += found
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(rank, pa.int64()), *(pa.array([c[j] for c in clusters], pa.int64()) for j in (0, 1))], [key, "cluster", "n", "s"])

    kind = dict(points.dtypes)[key]
    learned = _units(points, key, order, value, unit).mapInArrow(first, f"`{key}` {kind}, _unit long, _found array<struct<n: bigint, s: bigint>>")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [learn([(c["n"], c["s"]) for u in units for c in u["_found"]], limit) if len(units) > 1 else [(c["n"], c["s"]) for c in units[0]["_found"]] for units in batch.column(2).to_pylist()]
            made = pa.array([[{"n": n, "s": s} for n, s in x] for x in found], pa.list_(pa.struct([("n", pa.int64()), ("s", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), made], [key, "_unit", "_found"])

    ends = points.agg(F.min(order), F.max(order)).first()
    units = 0 if ends[0] is None else ends[1] // unit - ends[0] // unit + 1
    while units > TOGETHER:
        grouped = learned.groupBy(key, F.floor(F.col("_unit") / TOGETHER).alias("_more")).agg(F.sort_array(F.collect_list(F.struct("_unit", "_found"))).alias("_units"))
        learned = grouped.mapInArrow(merge, f"`{key}` {kind}, _unit long, _found array<struct<n: bigint, s: bigint>>")
        units = -(-units // TOGETHER)
    whole = learned.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_unit", "_found"))).alias("_units"))
    return whole.mapInArrow(then, f"`{key}` {kind}, cluster long, n long, s long")


def search(points: DataFrame, key: str, order: str, value: str, max_error: float, start: int = 4, grow: int = 30, most: int = 256, unit: int = UNIT) -> DataFrame:
    """key, unit, k, error: per unit of a key's points, the least number of clusters tried whose relative error fits; grows by steps, then shrinks by one."""

    def fitting(x: list[int]) -> tuple[int, float]:
        energy = float(sum(float(v) ** 2 for v in x)) or 1.0
        seen: dict[int, float] = {}

        def error(k: int) -> float:
            if k not in seen:
                seen[k] = 1 - sum(s * s / n for n, s in learn([(1, v) for v in x], k)) / energy
            return seen[k]

        k = min(start, len(x))
        while error(k) > max_error and k < min(most, len(x)):
            k = min(k + grow, most, len(x))
        while k > 1 and error(k) <= max_error and error(k - 1) <= max_error:
            k -= 1
        return k, round(error(k), 9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fitting(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([k for k, _ in found], pa.int64()), pa.array([e for _, e in found], pa.float64())], [key, "unit", "k", "error"])

    kind = dict(points.dtypes)[key]
    return _units(points, key, order, value, unit).mapInArrow(run, f"`{key}` {kind}, unit long, k long, error double")
