"""Ordered operators that never bring a whole key into one task.

Each key's rows are cut into blocks of consecutive order values. Work that needs a
few neighbours copies a halo of rows into the adjoining block; work that needs all
earlier rows carries one summary row per block, and one for every ``CHAIN`` blocks.
Only windows over one block, over the blocks of one chain and over a key's chains, one
row for CHAIN * BLOCK order values, are sorted.

Order columns are integers and unique within a key, unless said otherwise. Rows
with a null order value are not supported; a null key is a key of its own. Columns
made on the way begin with an underscore.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

BLOCK = 4096
#: Blocks whose summaries are carried together.
CHAIN = 4096


def _block(order: str, block: int) -> Column:
    return F.floor(F.col(order) / block).cast("long")


def with_halo(df: DataFrame, order: str, before: int = 0, after: int = 0, block: int = BLOCK) -> DataFrame:
    """df with _blk and _own: each row in its block, and again in blocks it is a neighbour of.

    before and after count order values, so lags reach that far back and leads ahead.
    """
    own = _block(order, block)
    reach = F.sequence(_shift(order, -after, block), _shift(order, before, block))
    return df.withColumn("_blk", F.explode(reach)).withColumn("_own", F.col("_blk") == own)


def _shift(order: str, by: int, block: int) -> Column:
    return F.floor((F.col(order) + by) / block).cast("long")


def halo_window(key: list[str], order: str):
    """The window over one key's block in order."""
    return Window.partitionBy(*key, "_blk").orderBy(order)


def neighbours(df: DataFrame, key: list[str], order: str, columns: dict, before: int = 0, after: int = 0, block: int = BLOCK) -> DataFrame:
    """df with columns computed from lags of up to before rows and leads of up to after.

    columns maps a name to a function of the window that gives a Column.
    """
    spread = with_halo(df, order, before, after, block)
    w = halo_window(key, order)
    made = spread.select("*", *[f(w).alias(n) for n, f in columns.items()])
    return made.filter("_own").drop("_own", "_blk")


def _keyed(df: DataFrame, key: list[str], order: str, block: int) -> DataFrame:
    """df with _key, all of the key in one value that is never null, and _blk."""
    return df.withColumn("_key", F.struct(*key) if key else F.struct(F.lit(0))).withColumn("_blk", _block(order, block))


def _before(tops: DataFrame, columns: list[str], whole: Callable[[str], Column], scan: Callable[[str, WindowSpec], Column], join: Callable[[Column, Column], Column]) -> DataFrame:
    """_key, _blk and what stands before each block of the summaries in columns.

    whole sums up a column over a chain, scan gives what stands before a row of a window,
    join puts what is before a chain in front of what is before a block in it.
    """
    chained = tops.withColumn("_chain", F.floor(F.col("_blk") / CHAIN))
    chains = chained.groupBy("_key", "_chain").agg(*[whole(c).alias(c) for c in columns])
    far = chains.select("_key", "_chain", *[scan(c, Window.partitionBy("_key").orderBy("_chain")).alias(f"_f{k}") for k, c in enumerate(columns)])
    near = chained.select("_key", "_blk", "_chain", *[scan(c, Window.partitionBy("_key", "_chain").orderBy("_blk")).alias(c) for c in columns])
    return near.join(far, ["_key", "_chain"]).select("_key", "_blk", *[join(F.col(f"_f{k}"), F.col(c)).alias(c) for k, c in enumerate(columns)])


def running_sum(df: DataFrame, key: list[str], order: str, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """df with name: the sum of value over the key's rows up to and including this one."""
    cut = _keyed(df, key, order, block).withColumn("_v", value)
    totals = cut.groupBy("_key", "_blk").agg(F.coalesce(F.sum("_v"), F.lit(0)).alias("_before"))
    offsets = _before(totals, ["_before"], F.sum, lambda c, w: F.sum(c).over(w) - F.col(c), lambda far, near: far + near)
    inside = F.coalesce(F.sum("_v").over(Window.partitionBy("_key", "_blk").orderBy(order)), F.lit(0))
    met = cut.withColumn("_inside", inside).join(offsets, ["_key", "_blk"])
    return met.withColumn(name, F.col("_before") + F.col("_inside")).drop("_key", "_blk", "_v", "_inside", "_before")


def last_known(df: DataFrame, key: list[str], order: str, columns: dict[str, Column], block: int = BLOCK, tie: str | None = None) -> DataFrame:
    """df with each column's last non-null value at or before the row; null before the first."""
    cut = _keyed(df, key, order, block).select("*", *[c.alias(f"_k_{n}") for n, c in columns.items()])
    by = [order, *([tie] if tie else [])]
    names = [f"_e_{n}" for n in columns]
    tops = cut.groupBy("_key", "_blk").agg(*[F.max_by(f"_k_{n}", F.when(F.col(f"_k_{n}").isNotNull(), F.struct(*by))).alias(f"_e_{n}") for n in columns])
    carried = _before(
        tops,
        names,
        lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_blk"))),
        lambda c, w: F.last(c, True).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        lambda far, near: F.coalesce(near, far),
    )
    w = Window.partitionBy("_key", "_blk").orderBy(*by)
    inside = cut.select("*", *[F.last(f"_k_{n}", True).over(w).alias(f"_i_{n}") for n in columns]).join(carried, ["_key", "_blk"])
    made = inside.select("*", *[F.coalesce(f"_i_{n}", f"_e_{n}").alias(n) for n in columns])
    return made.drop("_key", "_blk", *[f"{p}{n}" for n in columns for p in ("_k_", "_i_", "_e_")])


def restarted_sums(df: DataFrame, key: list[str], order: str, columns: dict[str, tuple[Column, Column]], block: int = BLOCK) -> DataFrame:
    """key, order and, per name (start, step), the last non-null start at or before the row plus the steps since; null before the first.

    The step of a row with a start does not count. The columns are carried together: df is shuffled
    once, by block, and the summaries of all columns are one row a block.
    """
    ks = range(len(columns))
    cut = _keyed(df, key, order, block).select(
        "_key", "_blk", order, *[c.alias(f"_{p}{k}") for k, (start, step) in enumerate(columns.values()) for p, c in (("a", start), ("d", F.coalesce(step, F.lit(0))))]
    )
    w = Window.partitionBy("_key", "_blk").orderBy(order)
    summed = cut.select("*", *[F.sum(f"_d{k}").over(w).alias(f"_s{k}") for k in ks])
    base = lambda k: F.when(F.col(f"_a{k}").isNotNull(), F.col(f"_a{k}") - F.col(f"_s{k}"))
    inside = summed.select("_key", "_blk", order, *[f"_s{k}" for k in ks], *[F.last(base(k), True).over(w).alias(f"_b{k}") for k in ks])

    # a block's end: its sum, and its last start less the sum up to there; the same for a chain, counted from where it begins
    ends = inside.groupBy("_key", "_blk").agg(F.max_by(F.struct(*[f"_{p}{k}" for k in ks for p in "sb"]), order).alias("_end"))
    ends = ends.select("_key", "_blk", F.floor(F.col("_blk") / CHAIN).alias("_chain"), "_end.*")
    near = _carried(ends, Window.partitionBy("_key", "_chain").orderBy("_blk"), ks)
    last = lambda k: F.max_by(f"_e{k}", F.when(F.col(f"_e{k}").isNotNull(), F.col("_blk")))
    chains = near.groupBy("_key", "_chain").agg(*[c for k in ks for c in (F.sum(f"_s{k}").alias(f"_s{k}"), last(k).alias(f"_b{k}"))])
    far = _carried(chains, Window.partitionBy("_key").orderBy("_chain"), ks)
    far = far.select("_key", "_chain", *[(F.col(f"_c{k}") + F.col(f"_p{k}")).alias(f"_f{k}") for k in ks])
    before = near.join(far, ["_key", "_chain"]).select("_key", "_blk", *[(F.coalesce(f"_c{k}", f"_f{k}") + F.col(f"_p{k}")).alias(f"_v{k}") for k in ks])
    met = inside.join(before, ["_key", "_blk"])
    return met.select(*[F.col(f"_key.{c}") for c in key], order, *[(F.coalesce(f"_b{k}", f"_v{k}") + F.col(f"_s{k}")).alias(n) for k, n in enumerate(columns)])


def _carried(rows: DataFrame, w: WindowSpec, ks: range) -> DataFrame:
    """rows of sums _s and bases _b with _p, the sum of the rows before, _e, the base counted from the window's first row, and _c, the last _e before."""
    summed = rows.select("*", *[(F.sum(f"_s{k}").over(w) - F.col(f"_s{k}")).alias(f"_p{k}") for k in ks])
    based = summed.select("*", *[(F.col(f"_b{k}") - F.col(f"_p{k}")).alias(f"_e{k}") for k in ks])
    return based.select("*", *[F.last(f"_e{k}", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_c{k}") for k in ks])


def asof(left: DataFrame, right: DataFrame, on: str, key: list[str] | None = None, columns: list[str] | None = None, forward: bool = False, block: int = BLOCK) -> DataFrame:
    """left with the right row of the greatest on at or before it (forward: the least at or after); nulls if none.

    Right rows are unique in key and on. Both sides are shuffled once, by key and block.
    """
    key = key or []
    columns = columns or [c for c in right.columns if c not in key]
    sign = -1 if forward else 1
    a = left.select(F.struct(*left.columns).alias("_row"), *key, (sign * F.col(on)).alias("_on"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(F.struct(*columns).alias("_r")).schema["_r"].dataType).alias("_r"))
    b = right.select(F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), *key, (sign * F.col(on)).alias("_on"), F.lit(0).alias("_side"), F.struct(*columns).alias("_r"))
    known = last_known(a.unionByName(b), key, "_on", {"_match": F.col("_r")}, block, tie="_side")
    return known.filter("_side = 1").select("_row.*", *[F.col(f"_match.{c}").alias(f"right_{c}") for c in columns])


def islands(df: DataFrame, key: list[str], order: str, inside: Column, least: int, block: int = BLOCK) -> DataFrame:
    """key, start, end, length of each run of at least least consecutive rows where inside holds."""
    marked = df.withColumn("_in", F.coalesce(inside, F.lit(False)))
    edged = neighbours(
        marked,
        key,
        order,
        {"_prev": lambda w: F.coalesce(F.lag("_in").over(w), F.lit(False)), "_next": lambda w: F.coalesce(F.lead("_in").over(w), F.lit(False))},
        1,
        1,
        block,
    ).filter("_in")
    starts = edged.filter("not _prev").select(*key, F.col(order).alias("start"))
    ends = edged.filter("not _next").select(*key, F.col(order).alias("end"))
    paired = asof(starts.withColumn("_at", F.col("start")), ends.withColumn("_at", F.col("end")), "_at", key, ["end"], forward=True, block=block)
    length = F.col("right_end") - F.col("start") + 1
    return paired.select(*key, "start", F.col("right_end").alias("end"), length.alias("length")).filter(F.col("length") >= least)
