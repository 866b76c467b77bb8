"""A Merkle manifest of a dataset: a leaf for every row, a tree for every group of rows, a root over the groups.

Leaves of a group stand in order; every two nodes that follow each other, and a last one
alone, are hashed to one, level by level, until one remains, the group's subroot. The
subroots, in order of the groups, make the root in the same way. A row's path, the nodes
beside its own way up, proves that it belongs to the root.

Leaves are hashed by Spark where the texts are; only digests are moved. They are numbered
by a range sort: a row's place is its place in its sorted partition and the number of the
group's rows in the partitions before. Aligned buckets of ``2 ** LEVELS`` leaves then go
to tasks as Arrow tables, many at a time, where DuckDB works out the levels inside them
with ordered ``string_agg`` and ``sha256``. The buckets' roots are the leaves of the next
tier, which has ``2 ** LEVELS`` times fewer rows, and so on; Spark joins the paths above a
bucket to its rows. No task holds a group, and a hot group is many buckets. The driver sees
one number, the size of the largest group.

Defined cases: a null value is written as ``-``, the null group comes first and is one of
its own. Rows of equal order value go by their leaf; equal rows each have a place and a
path of their own. An empty table gives an empty result. Texts of any length are hashed in
one expression. Only the columns named are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from framewright.scratch import Tables

#: Levels inside a bucket: 2 ** LEVELS nodes.
LEVELS = 8
#: Rows, in whole buckets, that a task hands to DuckDB at a time.
ROWS_AT_A_TIME = 1 << 14

PATH = "array<struct<is_left: boolean, node: string>>"


def written(column: str | Column) -> Column:
    """A value as its UTF-8 byte count, a colon and the value; null as a hyphen."""
    text = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: Sequence[str | Column]) -> Column:
    """The digest of a row's values, in lowercase hex."""
    return F.sha2(F.concat(*map(written, columns)), 256)


def folded(node: Column, path: Column) -> Column:
    """The root that a leaf and the nodes of its path lead to."""
    return F.aggregate(path, node, lambda own, s: F.sha2(F.when(s["is_left"], F.concat(s["node"], own)).otherwise(F.concat(own, s["node"])), 256))


def _levels_sql() -> str:
    """DuckDB: rows of whole buckets (_tree, _bucket, _n, _pos, _node, others) with _path, the siblings in them, and _top, the bucket's root at its first row.

    A level exists for a tree while it has more than one node, so a bucket of a tree of
    several buckets is hashed LEVELS times, however few nodes it holds. A node without a
    sibling is hashed alone and adds nothing to a path.
    """
    levels = ["l0 as materialized (select _tree, _bucket, _n, _pos, _node from nodes)"]
    for k in range(LEVELS):
        joined = "string_agg(_node, '' order by _pos)"
        levels.append(f"l{k + 1} as materialized (select _tree, _bucket, any_value(_n) as _n, _pos >> 1 as _pos, case when any_value(_n) > {1 << k} then sha256({joined}) else {joined} end as _node from l{k} group by _tree, _bucket, _pos >> 1)")
    way, joins = [], []
    for k in range(LEVELS):
        # a node hashed alone has no sibling, but its hash is on the way: the path marks it by an empty node
        way.append(f"case when r._n > {1 << k} then {{'is_left': coalesce((r._pos >> {k}) & 1 = 1, false), 'node': coalesce(s{k}._node, '')}} end")
        joins.append(f"left join l{k} s{k} on s{k}._tree = r._tree and s{k}._bucket = r._bucket and s{k}._pos = xor(r._pos >> {k}, 1)")
    top = f"left join l{LEVELS} top on top._tree = r._tree and top._bucket = r._bucket and (r._pos & {(1 << LEVELS) - 1}) = 0"
    return f"with {', '.join(levels)} select r.*, list_filter([{', '.join(way)}], lambda x: x is not null) as _path, top._node as _top from nodes r {' '.join(joins)} {top}"


def whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted batches as tables that end where a bucket ends."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            kept.append(batch)
        if sum(x.num_rows for x in kept) < ROWS_AT_A_TIME:
            continue
        table = pa.Table.from_batches(kept).combine_chunks()
        same = pc.and_(pc.equal(table["_tree"], table["_tree"][-1]), pc.equal(table["_bucket"], table["_bucket"][-1]))
        last = int(np.argmax(same.to_numpy()))  # the last bucket may go on
        if last:
            yield table.slice(0, last)
        kept = table.slice(last).to_batches()
    if kept:
        yield pa.Table.from_batches(kept)


def _bucket_levels(fields: pa.Schema):
    sql = _levels_sql()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""}) as engine:
            for table in whole_buckets(batches):
                engine.register("nodes", table)
                yield from engine.sql(sql).to_arrow_table().select(fields.names).cast(fields).to_batches()
                engine.unregister("nodes")

    return run


def _in_buckets(nodes: DataFrame) -> DataFrame:
    """nodes (_tree, _n, _pos, _node, others) with _bucket, _path and _top."""
    cut = nodes.withColumn("_bucket", F.shiftright("_pos", LEVELS))
    made = f"{', '.join(f'`{n}` {t}' for n, t in cut.dtypes)}, _path {PATH}, _top string"
    dealt = cut.repartition("_tree", "_bucket").sortWithinPartitions("_tree", "_bucket", "_pos")
    return dealt.mapInArrow(_bucket_levels(to_arrow_schema(StructType.fromDDL(made))), made)


def numbered(rows: DataFrame, order: Sequence[str], tables: Tables) -> DataFrame:
    """rows (_tree, others) with _pos, the place in the tree from 0 by order, and _n, the tree's rows; rows are written already."""
    by = ["_tree", *order, "_tie"]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie")
    placed = tables.write(dealt.withColumn("_at", F.monotonically_increasing_id()), "merkle-sorted")
    part = F.shiftright("_at", 33)
    counts = placed.groupBy("_tree", part.alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_c"))
    tree = Window.partitionBy("_tree")
    before = F.sum("_c").over(tree.orderBy("_part")) - F.col("_c")
    starts = tables.write(counts.select("_tree", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_c").over(tree).alias("_n")), "merkle-starts")
    met = placed.withColumn("_part", part).join(starts, ["_tree", "_part"])
    return met.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("_pos"), "_n")


def _up(nodes: DataFrame, tables: Tables) -> tuple[list[DataFrame], DataFrame]:
    """The tiers of trees, lowest first, and (_tree, _root)."""
    tiers, most = [], None
    while True:
        tiers.append(tables.keep(_in_buckets(nodes), "merkle-tier"))
        tops = tiers[-1].filter("_top is not null")
        if most is None:
            most = tiers[0].agg(F.max("_n")).first()[0] or 0
        if most <= 1 << LEVELS:
            return tiers, tops.select("_tree", F.col("_top").alias("_root"))
        most = -(-most // (1 << LEVELS))
        above = F.shiftright(F.col("_n") + ((1 << LEVELS) - 1), LEVELS)
        nodes = tops.select("_tree", above.alias("_n"), F.col("_bucket").alias("_pos"), F.col("_top").alias("_node"))


def _down(tiers: list[DataFrame], above: DataFrame, carried: Sequence[str]) -> DataFrame:
    """Rows of the lowest tier with _path up to the roots; above has _tree, _path and the carried columns of whole trees."""
    above = above.withColumn("_bucket", F.lit(0).cast("long"))
    for tier in reversed(tiers):
        over = above.select("_tree", "_bucket", F.col("_path").alias("_over"), *carried)
        rows = tier.join(over, ["_tree", "_bucket"]).withColumn("_path", F.concat("_path", "_over")).drop("_over", "_top")
        above = rows.select("_tree", F.col("_pos").alias("_bucket"), "_path", *carried)
    return rows


def manifest(docs: DataFrame, node: Column, tree: str, order: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """order, the columns of extra, leaf (node's value), path, subroot and root of every row.

    tree is the column of the groups, ordered as text by its UTF-8 bytes, null first.
    A path's nodes go from the leaf to the root; is_left says that the node stands to
    the left. A node that is hashed alone has an empty node beside it.
    """
    tables, extra = Tables(docs.sparkSession), extra or {}
    group = F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit(""))
    leaves = docs.select(group.alias("_tree"), F.col(order).alias("_order"), node.alias("_node"), *[c.alias(f"_x_{n}") for n, c in extra.items()])
    tiers, subroots = _up(numbered(tables.write(leaves, "merkle-leaves"), ["_order", "_node"], tables), tables)
    forest = tables.write(subroots.select(F.lit("").alias("_tree"), F.col("_tree").alias("_group"), F.col("_root").alias("_node")), "merkle-subroots")
    upper, roots = _up(numbered(forest, ["_group"], tables), tables)
    nothing = F.array().cast(PATH)
    groups = _down(upper, roots.withColumn("_path", nothing), ["_root"]).select(F.col("_group").alias("_tree"), "_path", F.col("_node").alias("_subroot"), "_root")
    rows = _down(tiers, tables.keep(groups, "merkle-groups"), ["_subroot", "_root"])
    tables.close()
    return rows.select(F.col("_order").alias(order), *[F.col(f"_x_{n}").alias(n) for n in extra], F.col("_node").alias("leaf"), F.col("_path").alias("path"), F.col("_subroot").alias("subroot"), F.col("_root").alias("root"))


def proof_digest(path: Column) -> Column:
    """The digest of a path's nodes, from the leaf to the root."""
    return F.sha2(F.array_join(F.transform(path, lambda s: s["node"]), ""), 256)


def verified(manifest_rows: DataFrame, node: Column) -> DataFrame:
    """Rows of a manifest with folded_root, what node and the path lead to, and verified, whether it is the root."""
    return manifest_rows.withColumn("folded_root", folded(node, F.col("path"))).withColumn("verified", F.col("folded_root") == F.col("root"))
