"""Balanced label propagation: linked documents move to the shard that most of their neighbours are in.

Documents of one group are linked with each other. The links of a group are not
written out as pairs: a document's neighbours in a shard are the group's count
there. Each round

1. counts every group's documents per shard (a map-side combined aggregate),
2. picks for every group the shard where most of it is, and lets the documents of
   its smaller cells ask to move there,
3. grants moves by hash, with a Spark join, up to the share of the asks at which no
   shard takes more than its quota has room for and what leaves it in exchange
   (small groups move whole, large ones in part).

A last step makes the counts exact (they differ by one at most): every shard's
documents are numbered without gaps, linked ones first, and what is beyond the
shard's quota takes the free numbers of the others. Numbering goes by blocks, so
no task sees a whole shard. Groups larger than ``SALT_ROWS`` are salted in every
join and window. The driver sees k * k numbers a round, k the number of shards.

Only DataFrame functions are used.

Defined cases: a null text has size 1 and the checksum of no bytes; null texts are
one group. Null or repeated ids are allowed, each row gets its own slot; rows are spread
by their id and the number that they are written with, so no id is a hot key. With no
rows the result is empty; with fewer rows than shards some shards stay empty.
Group ties are broken by hash. Only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.scratch import Tables, drop_path, write_table

#: Rows of a group, or of a numbering block, that may meet in one task.
SALT_ROWS, BLOCK_ROWS = 5_000, 10_000
#: Groups up to this size are moved whole.
WHOLE = 64


def _unit(*columns) -> Column:
    """A hash in [0, 1)."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / float(1 << 30)


def _by_shard(values: dict[int, float], column: str) -> Column:
    """A number for each shard, as an expression."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col(column))


def balanced_shards(nodes: DataFrame, shards: int = 8, rounds: int = 5) -> DataFrame:
    """nodes (id, group, other columns) with shard, slot: each shard's rows numbered from 0; counts at most one apart."""
    keep = nodes.columns
    sizes = nodes.groupBy("group").agg(F.count(F.lit(1)).alias("_n"))
    sizes, sizes_path = write_table(sizes.filter("_n > 1"), "shard-groups")  # written, so that the join can split a hot group
    sized = nodes.join(sizes, "group", "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
    sized = sized.withColumn("_tag", F.xxhash64("id", F.monotonically_increasing_id()))
    rows, _ = write_table(sized.withColumn("_shard", F.pmod(F.xxhash64("_tag", F.lit("start")), F.lit(shards)).cast("int")), "shard-rows")
    rows = rows.withColumn("_salt", F.pmod(F.col("_tag"), F.ceil(F.col("_n") / SALT_ROWS)))
    drop_path(nodes.sparkSession, sizes_path)
    total = rows.count()
    quota = {s: total // shards + (s < total % shards) for s in range(shards)}

    linked, path, tables = rows.filter("_n > 1"), None, Tables(nodes.sparkSession)
    for k in range(rounds):
        moves = _asks(linked, quota, k, tables)
        if moves is None:
            break
        salted = moves.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_n") / SALT_ROWS) - 1))).drop("_n")
        moved = linked.join(salted, ["group", "_shard", "_salt"], "left")
        granted = F.when(F.col("_n") <= WHOLE, _unit("group", F.lit(k))).otherwise(_unit("_tag", "group", F.lit(k))) < F.col("_grant")
        linked_new, new_path = write_table(moved.withColumn("_shard", F.when(granted, F.col("_to")).otherwise(F.col("_shard"))).select(rows.columns), "shard-labels")
        if path:
            drop_path(nodes.sparkSession, path)
        linked, path = linked_new, new_path
        tables.close()
    tables.close()
    return _numbered(linked.unionByName(rows.filter("_n = 1")), quota, total).select(*keep, "shard", "slot")


def grants(flows: dict[tuple[int, int], int], room: dict[int, int]) -> dict[tuple[int, int], float]:
    """The share of each flow (from, to) to grant, so that no shard takes more than its room and what leaves it.

    All is granted at first; flows into shards that would overflow are scaled down
    until none does. Shares only fall, so this ends; it takes k * k numbers.
    """
    share = dict.fromkeys(flows, 1.0)
    for _ in range(200):
        worst = 0.0
        for s in room:
            taken = sum(n * share[f] for f, n in flows.items() if f[1] == s)
            left = sum(n * share[f] for f, n in flows.items() if f[0] == s)
            if taken and taken - left - room[s] > 0.5:
                worst = max(worst, taken - left - room[s])
                less = max(0.0, (left + room[s]) / taken)
                share |= {f: x * less for f, x in share.items() if f[1] == s}
        if not worst:
            break
    return share


def _asks(linked: DataFrame, quota: dict[int, int], k: int, tables: Tables) -> DataFrame | None:
    """group, _shard, _n, _to, _grant: the cells that ask to move and the share of asks to grant; None if none does."""
    cells = tables.write(linked.groupBy("group", "_shard").agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n")), "shard-cells")
    load = {r[0]: r[1] for r in cells.groupBy("_shard").agg(F.sum("_c")).collect()}
    room = {s: q - (load.get(s) or 0) for s, q in quota.items()}
    weight = F.struct("_c", F.xxhash64("group", "_shard", F.lit(k)).alias("h"), F.col("_shard").alias("s"))
    weighed = cells.withColumn("_w", weight)
    best = weighed.groupBy("group").agg(F.max("_w").alias("_best"))
    asks = weighed.join(best, "group").filter(F.col("_best") > F.col("_w")).select("group", "_shard", "_n", "_c", F.col("_best.s").alias("_to"))
    flows = {(r[0], r[1]): r[2] for r in asks.groupBy("_shard", "_to").agg(F.sum("_c")).collect()}
    share = {f: x for f, x in grants(flows, room).items() if x > 0}
    if not share:
        return None
    told = F.create_map(*[F.lit(x) for (s, t), g in share.items() for x in (s * len(quota) + t, g)])
    return asks.select("group", "_shard", "_n", "_to", F.coalesce(F.try_element_at(told, F.col("_shard") * len(quota) + F.col("_to")), F.lit(0.0)).alias("_grant"))


def _numbered(rows: DataFrame, quota: dict[int, int], total: int) -> DataFrame:
    """shard and slot: numbers within quotas stay, those beyond take the free slots of other shards."""
    blocks = total // (len(quota) * BLOCK_ROWS) + 1
    order = F.when(F.col("_n") > 1, F.xxhash64("group", "_salt")).otherwise(F.xxhash64("_tag", "group"))
    placed = rows.withColumn("_order", order).withColumn("_single", (F.col("_n") == 1).cast("int")).withColumn("_block", F.pmod("_order", F.lit(blocks)))
    place = ["_shard", "_single", "_block"]
    counts = placed.groupBy(*place).agg(F.count(F.lit(1)).alias("_rows"))
    offsets = counts.withColumn("_offset", F.sum("_rows").over(Window.partitionBy("_shard").orderBy("_single", "_block")) - F.col("_rows")).drop("_rows")
    have = {r[0]: r[1] for r in counts.groupBy("_shard").agg(F.sum("_rows")).collect()}
    numbered = (
        placed.withColumn("_at", F.row_number().over(Window.partitionBy(*place).orderBy("_order", "_tag")) - 1)
        .join(offsets, place)
        .withColumn("_rank", F.col("_offset") + F.col("_at"))
    )
    over, start = 0, {}
    for s, q in quota.items():
        start[s] = over
        over += max(0, have.get(s, 0) - q)
    free, at = [], 0
    for s, q in quota.items():
        gap = max(0, q - have.get(s, 0))
        free.append((at, at + gap, s, have.get(s, 0)))
        at += gap
    beyond = F.col("_rank") >= _by_shard(quota, "_shard")
    spare = _by_shard(start, "_shard") + F.col("_rank") - _by_shard(quota, "_shard")
    to, slot = F.lit(None).cast("int"), F.lit(None).cast("long")
    for low, high, s, used in free:
        inside = (spare >= low) & (spare < high)
        to = F.when(inside, F.lit(s)).otherwise(to)
        slot = F.when(inside, spare - low + used).otherwise(slot)
    return numbered.withColumn("shard", F.when(beyond, to).otherwise(F.col("_shard")).cast("int")).withColumn("slot", F.when(beyond, slot).otherwise(F.col("_rank")).cast("long"))


def shard_documents(docs: DataFrame, shards: int = 8, rounds: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its id, size, text_crc32, law, shard, slot and grown_shard (null: the law is ``rows``).

    Documents of equal texts are linked.
    """
    text = F.col(text_col)
    nodes = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.md5(text.cast("binary")), F.lit("null")).alias("group"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    done = balanced_shards(nodes, shards, rounds)
    return done.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
