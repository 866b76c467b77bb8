"""Queries of aggregates, quality figures, top-k and clusters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framewright.functions import fixed
from framewright.operators import blocks, clusters
from framewright.plans.registry import query
from framewright.plans.views import Views

_c = F.col

_BLK = """blk as (select channel, cast(floor(frame/32.0) as bigint) as blk, sum(x*x) as energy, max(abs(x)) as peak, count(*) as n
        from sig group by channel, cast(floor(frame/32.0) as bigint))"""


@query(
    "block_energy_ring",
    _BLK
    + """ select channel, blk, cast(energy as bigint) as energy, cast(peak as bigint) as peak, n,
       cast(sum(energy) over (partition by channel order by blk rows between 15 preceding and current row) as double) / 70368744177664.0 as ring_fs from blk""",
)
def _(v: Views):
    ring = blocks.ring_sum(blocks.block_energy(v.sig), "energy", "ring")
    return ring.withColumn("ring_fs", _c("ring").cast("double") / float(fixed.RAIL) ** 2).drop("ring")


_PAIR_SQL = "pair as (select a.channel, a.frame, a.x as a, (a.x // 256) * 256 as b from sig a)"


def _pairs(v: Views):
    return v.sig.select("channel", "frame", _c("x").alias("a"), fixed.clear_low_bits("x", 8).alias("b"))


@query(
    "quality_mse_peak",
    _PAIR_SQL
    + """ select channel, round(greatest(-144.0, 10 * log10(sum((a-b)*(a-b)) / count(*) / 70368744177664.0)), 6) as mse_db,
    round(greatest(-144.0, 20 * log10(max(abs(a-b)) / 8388608.0)), 6) as peak_db, round(max(abs(a-b)) / sqrt(sum((a-b)*(a-b)) / count(*)), 6) as crest from pair group by channel""",
)
def _(v: Views):
    q = blocks.quality(_pairs(v), ["channel"])
    mean = _c("sum_sq") / _c("n")
    return q.select(
        "channel",
        F.round(fixed.power_to_db(mean / float(fixed.RAIL) ** 2), 6).alias("mse_db"),
        F.round(fixed.linear_to_db(_c("peak") / float(fixed.RAIL), -144.0), 6).alias("peak_db"),
        F.round(_c("peak") / F.sqrt(mean), 6).alias("crest"),
    )


@query(
    "quality_accumulate",
    _PAIR_SQL
    + """, blkq as (select frame // 32 as blk, sum((a-b)*(a-b)) as ss, count(*) as n, max(abs(a-b)) as peak from pair group by 1)
    select cast(sum(n) as bigint) as n, cast(max(peak) as bigint) as peak, round(coalesce(10 * log10(sum(ss) / sum(n) / 70368744177664.0), -3000.0), 6) as rms_db from blkq""",
)
def _(v: Views):
    """Per-block figures, then their sum: the same as over all samples at once."""
    parts = blocks.quality(_pairs(v).withColumn("blk", blocks.block_of()), ["blk"])
    total = parts.agg(F.sum("n").alias("n"), F.max("peak").alias("peak"), F.sum("sum_sq").alias("ss"))
    db = fixed.power_to_db(_c("ss") / _c("n") / float(fixed.RAIL) ** 2, fixed.EMPTY_FLOOR)
    return total.select("n", "peak", F.round(F.coalesce(db, F.lit(fixed.EMPTY_FLOOR)), 6).alias("rms_db"))


@query(
    "pearson_pair",
    "select a.channel as ch_a, b.channel as ch_b, round(corr(a.x, b.x), 6) as r from sig a join sig b on a.frame = b.frame and a.channel < b.channel group by 1, 2",
)
def _(v: Views):
    """Pairs are made within a frame, of which there are few channels; nothing is joined."""
    at = F.sort_array(F.collect_list(F.struct("channel", "x")))
    later = lambda p, k: F.transform(F.slice("at", k + 2, F.greatest(F.size("at") - k - 1, F.lit(0))), lambda q: F.struct(p["channel"].alias("ch_a"), q["channel"].alias("ch_b"), p["x"].alias("a"), q["x"].alias("b")))
    both = v.sig.groupBy("frame").agg(at.alias("at")).select(F.inline(F.flatten(F.transform("at", later))))
    return blocks.pearson(both, ["ch_a", "ch_b"]).withColumn("r", F.round("r", 6))


@query("nonempty_nonsilent", "select channel, count(*) as n, bool_or(x <> 0) as sounds from usig group by channel")
def _(v: Views):
    return v.usig.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.bool_or(_c("x") != 0).alias("sounds"))


@query("count_star", "select count(*) as n from lineitem")
def _(v: Views):
    return v.lineitem.agg(F.count(F.lit(1)).alias("n"))


@query(
    "content_digest",
    """b as (select channel, frame // 1024 as blk, sha256(string_agg(frame || ':' || x, ',' order by frame)) as d from sig group by 1, 2),
    c as (select channel, blk // 1024 as sup, sha256(string_agg(blk || ':' || d, ',' order by blk)) as d from b group by 1, 2)
    select channel, sha256(string_agg(sup || ':' || d, ',' order by sup)) as digest from c group by channel""",
)
def _(v: Views):
    """Order-sensitive digest by blocks of blocks: no row gathers more than 1,024 digests but the last, with one for 2^20 frames."""
    ordered = lambda at, text: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(at, text))), lambda r: F.concat(r[at].cast("string"), F.lit(":"), r[text].cast("string"))), ",")
    block = v.sig.groupBy("channel", blocks.block_of(size=1024).alias("blk")).agg(F.sha2(ordered("frame", "x"), 256).alias("d"))
    block = block.groupBy("channel", blocks.block_of("blk", 1024).alias("sup")).agg(F.sha2(ordered("blk", "d"), 256).alias("d"))
    return block.groupBy("channel").agg(F.sha2(ordered("sup", "d"), 256).alias("digest"))


@query("fold_digest", "select channel, cast(bit_xor((frame * 2654435761 + x * 40503) & 4294967295) as bigint) as digest from sig group by channel")
def _(v: Views):
    """A digest that may be folded in any order: place and value go into each term."""
    term = (_c("frame") * 2654435761 + _c("x") * 40503).bitwiseAND(F.lit(4294967295))
    return v.sig.groupBy("channel").agg(F.bit_xor(term).alias("digest"))


@query(
    "dedup_count",
    """select l_returnflag, l_linestatus, l_linenumber, l_discount, l_tax, l_suppkey, l_quantity > 25 as large, min(l_orderkey) as first_order, count(*) as occurrences
    from lineitem group by 1, 2, 3, 4, 5, 6, 7""",
)
def _(v: Views):
    keys = ["l_returnflag", "l_linestatus", "l_linenumber", "l_discount", "l_tax", "l_suppkey", (_c("l_quantity") > 25).alias("large")]
    return v.lineitem.groupBy(*keys).agg(F.min("l_orderkey").alias("first_order"), F.count(F.lit(1)).alias("occurrences"))


@query(
    "rice_cost",
    """v as (select channel, case when x < 0 then -2 * (x // 65536) - 1 else 2 * (x // 65536) end as u from sig)
    select channel, k, cast(sum((u >> k) + 1 + k) as bigint) as cost from v, range(0, 8) t(k) group by channel, k""",
)
def _(v: Views):
    u = fixed.zigzag_encode(fixed.trunc_div("x", F.lit(65536)))
    u = F.when(_c("x") < 0, -2 * fixed.trunc_div("x", F.lit(65536)) - 1).otherwise(u)
    sums = [F.sum(F.shiftright("u", k) + (1 + k)).alias(f"{k}") for k in range(8)]
    wide = v.sig.select("channel", u.alias("u")).groupBy("channel").agg(*sums)
    return wide.select("channel", F.posexplode(F.array(*[_c(f"`{k}`") for k in range(8)])).alias("k", "cost")).select("channel", _c("k").cast("long").alias("k"), "cost")


@query(
    "rice_best_mode",
    """n as (select channel, count(*) as n from usig group by channel), w as (select channel, n, m, unnest(range(0, n)) as i from n, range(1, 8) t(m)),
    c as (select channel, m, cast(sum(m + i // (1 << (m - 1))) as bigint) as cost from w group by channel, m)
    select channel, cost, m as mode from (select *, row_number() over (partition by channel order by cost, m) as rn from c) where rn = 1""",
)
def _(v: Views):
    """Width starts at w and grows by one every 2^(w-1) levels; the lowest mode wins ties. The sum has a closed form."""
    n = v.usig.groupBy("channel").agg(F.count(F.lit(1)).alias("n"))

    def cost(w: int):
        period = F.lit(1 << (w - 1)).cast("long")
        full = fixed.trunc_div("n", period)
        return _c("n") * w + fixed.trunc_div(full * (full - 1), F.lit(2)) * period + full * (_c("n") - full * period)

    best = F.array_min(F.array(*[F.struct(cost(w).alias("cost"), F.lit(w).cast("long").alias("mode")) for w in range(1, 8)]))
    return n.select("channel", best.alias("b")).select("channel", "b.cost", "b.mode")


@query("budget_filter", "b as (select l_orderkey, count(*) as n from lineitem group by 1) select l_orderkey, n * 20 - ((n - 1) >> 4) - 48 as budget from b where n * 20 - ((n - 1) >> 4) - 48 > 0")
def _(v: Views):
    n = v.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return n.select("l_orderkey", (_c("n") * 20 - F.shiftright(_c("n") - 1, 4) - 48).alias("budget")).filter("budget > 0")


_WIDTHS = [("A", 5), ("N", 12), ("R", 9)]


@query(
    "dim_weighted_sum",
    "w(flag, width) as (values ('A', 5::bigint), ('N', 12::bigint), ('R', 9::bigint)) select l_orderkey, cast((case when max(l_tax) > 0.05 then 72 else 32 end | 16) + sum(8 + width) as bigint) as cost from lineitem join w on l_returnflag = flag group by l_orderkey",
)
def _(v: Views):
    width = F.broadcast(v.spark.createDataFrame(_WIDTHS, "l_returnflag string, width long"))
    base = F.when(F.max("l_tax") > 0.05, 72).otherwise(32).bitwiseOR(F.lit(16))
    return v.lineitem.join(width, "l_returnflag").groupBy("l_orderkey").agg((base + F.sum(8 + _c("width"))).alias("cost"))


@query(
    "vote_across_channels",
    """f as (select frame, bit_or(x & 1) as any_bit, bit_and(x & 1) as all_bit, count(*) as n from sig group by frame)
    select frame, any_bit, all_bit, any_bit + 2 * coalesce(lag(any_bit, 1) over (order by frame), 0) + 4 * coalesce(lag(any_bit, 2) over (order by frame), 0) as history from f""",
)
def _(v: Views):
    from framewright.operators.ordered import neighbours

    bit = _c("x").bitwiseAND(F.lit(1))
    votes = v.sig.groupBy("frame").agg(F.bit_or(bit).alias("any_bit"), F.bit_and(bit).alias("all_bit"))
    before = lambda w, n: F.coalesce(F.lag("any_bit", n).over(w), F.lit(0))
    return neighbours(votes, [], "frame", {"history": lambda w: _c("any_bit") + 2 * before(w, 1) + 4 * before(w, 2)}, before=2)


@query("row_peak", "select frame, cast(max(abs(x)) as bigint) as peak from sig group by frame")
def _(v: Views):
    return v.sig.groupBy("frame").agg(F.max(F.abs("x")).alias("peak"))


@query("weighted_vector_sum", "select label, i, cast(sum(v * (1 + vec_id % 5)) as bigint) as total from vec group by label, i")
def _(v: Views):
    return v.vec.groupBy("label", "i").agg(F.sum(_c("v") * (1 + _c("vec_id") % 5)).alias("total"))


@query("pivot_planar", "select frame, " + ", ".join(f"cast(max(x) filter (where channel = '{c}') as bigint) as {c}" for c in ("click", "error", "purchase", "signup", "view")) + " from sig group by frame")
def _(v: Views):
    return v.sig.groupBy("frame").pivot("channel", ["click", "error", "purchase", "signup", "view"]).agg(F.max("x"))


# Sorts and choices.


@query("order_by", "select c_custkey, c_acctbal from customer order by c_acctbal desc, c_custkey limit 100")
def _(v: Views):
    return v.customer.select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(100)


@query(
    "topk_with_neighbors",
    """r as (select l_orderkey, l_partkey, l_quantity, row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_quantity) as pos from lineitem),
    b as (select l_orderkey, min(pos) as top from r join (select l_orderkey, max(l_quantity) as q from r group by 1) m using (l_orderkey) where l_quantity = q group by 1)
    select r.l_orderkey, r.pos, r.l_quantity from r join b using (l_orderkey) where abs(pos - top) <= 1""",
)
def _(v: Views):
    order = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_quantity")
    ranked = v.lineitem.select("l_orderkey", "l_quantity", F.row_number().over(order).cast("long").alias("pos"))
    return blocks.keep_best_and_neighbours(ranked, ["l_orderkey"], "pos", "l_quantity")


@query(
    "bracket_check",
    """r as (select l_orderkey, l_quantity as q, row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_quantity) as pos from lineitem),
    w as (select *, lag(q) over (partition by l_orderkey order by pos) as lo, lead(q) over (partition by l_orderkey order by pos) as hi from r)
    select l_orderkey, pos, case when lo is null or hi is null then 'open' when q >= lo and q > hi then 'peak' when lo <= q then 'rising' else 'falling' end as state from w""",
)
def _(v: Views):
    order = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_quantity")
    q, lo, hi = _c("l_quantity"), F.lag("l_quantity").over(order), F.lead("l_quantity").over(order)
    state = F.when(lo.isNull() | hi.isNull(), "open").when((q >= lo) & (q > hi), "peak").when(lo <= q, "rising").otherwise("falling")
    return v.lineitem.select("l_orderkey", F.row_number().over(order).cast("long").alias("pos"), state.alias("state"))


@query("argmin_constrained", "select l_orderkey, first(l_partkey order by l_discount, l_partkey) as best, count(*) as eligible from lineitem where l_extendedprice <= 60000 group by l_orderkey")
def _(v: Views):
    return v.lineitem.filter("l_extendedprice <= 60000").groupBy("l_orderkey").agg(F.min_by("l_partkey", F.struct("l_discount", "l_partkey")).alias("best"), F.count(F.lit(1)).alias("eligible"))


@query(
    "priority_schedule",
    """d as (select l_orderkey, l_linenumber, case l_returnflag when 'R' then 1 when 'A' then 2 else 3 end as priority, cast(l_quantity as bigint) as period from lineitem)
    select l_orderkey, first(l_linenumber order by priority, period, l_linenumber) as line, min(priority)::bigint as priority from d where period > 10 group by l_orderkey""",
)
def _(v: Views):
    """Of the items that are due, the first by priority."""
    priority = F.when(_c("l_returnflag") == "R", 1).when(_c("l_returnflag") == "A", 2).otherwise(3).cast("long")
    due = v.lineitem.select("l_orderkey", "l_linenumber", priority.alias("priority"), _c("l_quantity").cast("long").alias("period")).filter("period > 10")
    return due.groupBy("l_orderkey").agg(F.min_by("l_linenumber", F.struct("priority", "period", "l_linenumber")).alias("line"), F.min("priority").alias("priority"))


# Clusters and codes.


@query("cluster_summary", "select label, count(*) as n, cast(sum(v) as bigint) as s, cast(sum(v * v) as bigint) as ss from vec group by label")
def _(v: Views):
    """Singletons (1, v, v^2) added up."""
    return clusters.summary(v.vec, ["label"], "v")


@query(
    "ward_cost_pairs",
    """c as (select label, count(*) as n, sum(v) as s from vec group by label)
    select a.label as a, b.label as b, round(a.s * a.s / a.n::double + b.s * b.s / b.n::double - (a.s + b.s) * (a.s + b.s) / (a.n + b.n)::double, 3) as cost from c a join c b on a.label < b.label""",
)
def _(v: Views):
    return clusters.ward_costs(clusters.summary(v.vec, ["label"], "v").select(_c("label").alias("id"), "n", "s")).withColumn("cost", F.round("cost", 3))


@query("center_quantize", "c as (select label, sum(v) / count(*)::double as m from vec group by label) select label, case when abs(m) = (select min(abs(m)) from c) then 0 else cast(trunc(m) as bigint) end as center from c")
def _(v: Views):
    """Centres truncated; the one nearest to the origin becomes zero."""
    centers = clusters.summary(v.vec, ["label"], "v").select("label", (_c("s") / _c("n")).alias("m"))
    nearest = F.broadcast(centers.agg(F.min(F.abs("m")).alias("least")))  # one row
    return centers.join(nearest).select("label", F.when(F.abs("m") == _c("least"), F.lit(0).cast("long")).otherwise(_c("m").cast("long")).alias("center"))


_BIN_SQL = """q as (select channel, frame, (x + 100 * 131072 + 65536) >> 17 as bin from sig), c as (select bin, count(*) as n from q where bin between 0 and 200 group by bin),
    r as (select bin, row_number() over (order by n desc, bin desc) - 1 as code from c)"""


@query("shift_binning", _BIN_SQL + " select bin, code from r")
def _(v: Views):
    return clusters.bin_codes(clusters.bins(v.sig, 17)).select("bin", "code")


@query("codebook_index", _BIN_SQL + " select q.channel, q.frame, coalesce(r.code, 201) as code from q left join r using (bin)")
def _(v: Views):
    """Each sample's code; samples out of range share one code of their own."""
    binned = clusters.bins(v.sig, 17)
    codes = F.broadcast(clusters.bin_codes(binned))  # at most 201 rows
    return binned.join(codes, "bin", "left").select("channel", "frame", F.coalesce("code", F.lit(201).cast("long")).alias("code"))


@query(
    "cluster_rank",
    "c as (select label, count(*) as n from embeddings group by label) select cast(label as bigint) as label, n, row_number() over (order by n desc, label) as pos from c",
)
def _(v: Views):
    """Clusters by population; ties in given order. The list of clusters is short."""
    n = v.embeddings.groupBy(_c("label").cast("long").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return clusters.by_population(n)


@query("online_cluster")
def _(v: Views):
    return clusters.online(v.usig, "channel", "frame", "x", limit=8)


@query("cluster_search")
def _(v: Views):
    return clusters.search(v.usig, "channel", "frame", "x", max_error=0.02)


