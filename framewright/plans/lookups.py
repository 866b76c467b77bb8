"""Queries of joins, lookups, sources and sinks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from framewright.functions import bits, fixed
from framewright.operators import lookups, ordered
from framewright.plans.registry import query
from framewright.plans.views import Views
from framewright.scratch import new_path, write_table
from framewright.sources import boxes, sinks, wav

_c = F.col
_CHANNELS = [(0, "signup", "L"), (1, "purchase", "R"), (2, "error", "C"), (3, "view", "LFE"), (4, "click", "LS"), (5, "extra", "RS")]
_CHANNEL_SQL = "dim(id, channel, alias) as (values " + ", ".join(f"({i}::bigint, '{n}', '{a}')" for i, n, a in _CHANNELS) + ")"


def _dim(v: Views):
    return lookups.literal(v.spark.createDataFrame(_CHANNELS, "id long, channel string, alias string"))


@query(
    "first_match_limit1",
    "select p_partkey, p_name, p_size from part where p_size in (7, 11, 13) and p_type like '%A%' or p_size = 21 order by p_partkey limit 1",
)
def _(v: Views):
    wanted = (_c("p_size").isin(7, 11, 13) & _c("p_type").like("%A%")) | (_c("p_size") == 21)
    return v.part.filter(wanted).orderBy("p_partkey").limit(1).select("p_partkey", "p_name", "p_size")


_RUNS = "runs as (select o_orderkey as first_chunk, 1 + o_orderkey % 7 as per_chunk from orders where o_orderkey % 100 = 1)"


@query(
    "asof_chunk_offset",
    _RUNS
    + """, s as (select l_orderkey, l_linenumber, sum(cast(l_quantity as bigint)) over (partition by l_orderkey order by l_linenumber) - cast(l_quantity as bigint) as at from lineitem)
    select s.l_orderkey, s.l_linenumber, cast(s.at as bigint) as at, r.first_chunk, r.per_chunk from s asof left join runs r on s.l_orderkey >= r.first_chunk""",
)
def _(v: Views):
    """Each sample's offset in its chunk, and the run of chunks that its chunk belongs to."""
    from pyspark.sql import Window

    size = _c("l_quantity").cast("long")
    at = F.sum(size).over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")) - size
    samples = v.lineitem.select("l_orderkey", "l_linenumber", at.alias("at"), _c("l_orderkey").alias("chunk"))
    runs = v.orders.filter("o_orderkey % 100 = 1").select(_c("o_orderkey").alias("first_chunk"), (1 + _c("o_orderkey") % 7).alias("per_chunk"), _c("o_orderkey").alias("chunk"))
    found = ordered.asof(samples, runs, "chunk", columns=["first_chunk", "per_chunk"])
    return found.select("l_orderkey", "l_linenumber", "at", _c("right_first_chunk").alias("first_chunk"), _c("right_per_chunk").alias("per_chunk"))


@query("asof_next", "b as (select o_orderkey as boundary from orders where o_orderkey % 64 = 0) select p_partkey, b.boundary from part asof left join b on p_partkey < b.boundary")
def _(v: Views):
    """The first frame boundary after each cursor."""
    cursor = v.part.select("p_partkey", (_c("p_partkey") + 1).alias("at"))
    ends = v.orders.filter("o_orderkey % 64 = 0").select(_c("o_orderkey").alias("boundary"), _c("o_orderkey").alias("at"))
    return ordered.asof(cursor, ends, "at", columns=["boundary"], forward=True).select("p_partkey", _c("right_boundary").alias("boundary"))


@query("frame_end_join", "select s.channel, s.frame, o.o_orderkey, s.x from sig s join orders o on s.frame = o.o_orderkey + o.o_custkey % 10")
def _(v: Views):
    ends = v.orders.select("o_orderkey", (_c("o_orderkey") + _c("o_custkey") % 10).alias("frame"))
    return v.sig.join(ends, "frame").select("channel", "frame", "o_orderkey", "x")


@query("lookup_join", _CHANNEL_SQL + " select s.channel, s.frame, d.id, d.alias from sig s join dim d on upper(trim(' ' || s.channel || ' ')) = upper(d.channel)")
def _(v: Views):
    token = F.upper(F.trim(F.concat(F.lit(" "), "channel", F.lit(" "))))
    dim = lookups.literal(v.spark.createDataFrame(_CHANNELS, "id long, name string, alias string"))
    return v.sig.join(dim, token == F.upper("name")).select("channel", "frame", "id", "alias")


@query("bit_or_agg", _CHANNEL_SQL + " select s.frame // 1000 as part, cast(bit_or(1 << d.id) as bigint) as mask from sig s join dim d using (channel) group by 1")
def _(v: Views):
    part = fixed.trunc_div("frame", F.lit(1000)).alias("part")
    return v.sig.join(_dim(v), "channel").groupBy(part).agg(F.bit_or(bits.mask_of("id")).alias("mask"))


@query("left_join_default", _CHANNEL_SQL + " select e.event_id, coalesce(d.id, -1) as id from events e left join dim d on d.channel = e.event_type and d.id % 2 = 0")
def _(v: Views):
    even = _dim(v).filter("id % 2 = 0").select(_c("channel").alias("event_type"), "id")
    return lookups.lookup_or(v.events.select("event_id", "event_type"), even, ["event_type"], {"id": F.lit(-1).cast("long")}).select("event_id", "id")


_SOURCES = [("AUTOMOBILE", 0, 1), ("AUTOMOBILE", 1, 2), ("BUILDING", 0, 3), ("FURNITURE", 2, 4), ("FURNITURE", 2, 5), ("FURNITURE", 2, 6), ("MACHINERY", 1, 7)]


@query(
    "one_to_many_join",
    "src(segment, layout, source) as (values "
    + ", ".join(f"('{a}', {b}, {c}::bigint)" for a, b, c in _SOURCES)
    + ") select c_custkey, source from customer join src on c_mktsegment = segment and c_custkey % 3 = layout",
)
def _(v: Views):
    src = lookups.literal(v.spark.createDataFrame(_SOURCES, "segment string, layout int, source long"))
    return v.customer.join(src, (_c("c_mktsegment") == _c("segment")) & (_c("c_custkey") % 3 == _c("layout"))).select("c_custkey", "source")


@query(
    "join_sort_fallback",
    """m as (select l_orderkey, l_linenumber, case when l_quantity < 45 then l_partkey % 32 end as bit from lineitem),
    g as (select l_orderkey, count(bit) < count(*) or count(distinct bit) < count(*) as broken from m group by l_orderkey)
    select m.l_orderkey, m.l_linenumber, row_number() over (partition by m.l_orderkey order by case when g.broken then m.l_linenumber else m.bit end, m.l_linenumber) as pos from m join g using (l_orderkey)""",
)
def _(v: Views):
    """Sorted by speaker bit, unless one is missing or double: then as given."""
    from pyspark.sql import Window

    mapped = v.lineitem.select("l_orderkey", "l_linenumber", F.when(_c("l_quantity") < 45, _c("l_partkey") % 32).alias("bit"))
    whole = Window.partitionBy("l_orderkey")
    broken = (F.count("bit").over(whole) < F.count(F.lit(1)).over(whole)) | (F.size(F.collect_set("bit").over(whole)) < F.count(F.lit(1)).over(whole))
    by = F.when(_c("broken"), _c("l_linenumber")).otherwise(_c("bit"))
    return mapped.withColumn("broken", broken).select("l_orderkey", "l_linenumber", F.row_number().over(whole.orderBy(by, "l_linenumber")).cast("long").alias("pos"))


@query(
    "fallback_join",
    "e(event_type, bed) as (values ('view', 10::bigint), ('click', 20::bigint)) select v.event_id, coalesce(e.bed, v.event_id % 8) as bed from events v left join e using (event_type)",
)
def _(v: Views):
    explicit = lookups.literal(v.spark.createDataFrame([("view", 10), ("click", 20)], "event_type string, bed long"))
    return lookups.lookup_or(v.events.select("event_id", "event_type"), explicit, ["event_type"], {"bed": _c("event_id") % 8}).select("event_id", "bed")


@query(
    "left_join_first",
    """f as (select l_orderkey, first(l_extendedprice order by l_linenumber, l_extendedprice) as price from lineitem where l_discount > 0.05 group by l_orderkey)
    select o_orderkey, coalesce(f.price, -1.0) as price from orders left join f on o_orderkey = l_orderkey""",
)
def _(v: Views):
    rows = v.lineitem.filter("l_discount > 0.05").select(_c("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_extendedprice")
    found = lookups.first_match(v.orders.select("o_orderkey"), rows, ["o_orderkey"], [_c("l_linenumber")], ["l_extendedprice"])
    return found.select("o_orderkey", F.coalesce("l_extendedprice", F.lit(-1.0)).alias("price"))


@query(
    "conditional_join",
    """select o.o_orderkey, case when o.o_orderstatus = 'O' then c.c_acctbal else n.n_regionkey end as gain
    from orders o left join customer c on o.o_custkey = c.c_custkey and o.o_orderstatus = 'O' left join nation n on n.n_nationkey = o.o_custkey % 25 and o.o_orderstatus <> 'O'""",
)
def _(v: Views):
    """Gains of a program, or of a switch group, by what the row belongs to."""
    o = v.orders.select("o_orderkey", F.when(_c("o_orderstatus") == "O", _c("o_custkey")).alias("program"), F.when(_c("o_orderstatus") != "O", _c("o_custkey") % 25).alias("grp"))
    program = v.customer.select(_c("c_custkey").alias("program"), "c_acctbal")
    group = v.nation.select(_c("n_nationkey").cast("long").alias("grp"), _c("n_regionkey").cast("double").alias("g"))
    return o.join(program, "program", "left").join(group, "grp", "left").select("o_orderkey", F.coalesce("c_acctbal", "g").alias("gain"))


@query(
    "relative_gain",
    """select l.l_orderkey, l.l_linenumber, cast(p.p_size as bigint) - cast(coalesce(s.s_nationkey, 0) as bigint) as value, l.l_partkey % 5 <> 0 as selected
    from lineitem l left join part p on l.l_partkey = p.p_partkey left join supplier s on l.l_suppkey = s.s_suppkey and s.s_acctbal > 0""",
)
def _(v: Views):
    object_gain = v.part.select(_c("p_partkey").alias("l_partkey"), _c("p_size").cast("long").alias("obj"))
    bed_gain = v.supplier.filter("s_acctbal > 0").select(_c("s_suppkey").alias("l_suppkey"), _c("s_nationkey").cast("long").alias("bed"))
    joined = v.lineitem.join(object_gain, "l_partkey", "left").join(bed_gain, "l_suppkey", "left")
    return joined.select("l_orderkey", "l_linenumber", (_c("obj") - F.coalesce("bed", F.lit(0))).alias("value"), (_c("l_partkey") % 5 != 0).alias("selected"))


@query("semi_join", "select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 250000)")
def _(v: Views):
    large = v.orders.filter("o_totalprice > 250000").select(_c("o_custkey").alias("c_custkey"))
    return v.customer.join(large, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query(
    "relational_division",
    """need as (select distinct o_orderpriority from orders) select o_custkey from orders join need using (o_orderpriority)
    group by o_custkey having count(distinct o_orderpriority) = (select count(*) from need)""",
)
def _(v: Views):
    return lookups.divides(v.orders, "o_custkey", "o_orderpriority", v.orders)


@query(
    "first_hit",
    """select l_orderkey, first(l_suppkey order by l_returnflag <> 'A', l_linenumber, l_suppkey) as s_suppkey from lineitem where l_quantity > 20 group by l_orderkey""",
)
def _(v: Views):
    """The primary program first, then the others by index; the first that has it."""
    order = F.struct(_c("l_returnflag") != "A", "l_linenumber", "l_suppkey")
    return v.lineitem.filter("l_quantity > 20").groupBy("l_orderkey").agg(F.min_by("l_suppkey", order).alias("s_suppkey"))


# Mixing matrices.

_RULES = [("view", "signup", 5931642), ("view", "purchase", 5931642), ("click", "signup", 4194304), ("error", "purchase", 8388608), ("error", "click", -2097152), ("signup", "signup", 8388608)]
_RULE_SQL = "rules(src, dst, q23) as (values " + ", ".join(f"('{a}', '{b}', {g}::bigint)" for a, b, g in _RULES) + ")"


@query("downmix_matrix", _RULE_SQL + " select r.dst as channel, s.frame, cast(sum((s.x * r.q23) // 8388608) as bigint) as x from sig s join rules r on s.channel = r.src group by 1, 2")
def _(v: Views):
    from framewright.operators import mixing

    return mixing.mix(v.sig, _RULES)


@query(
    "gain_join_scale",
    """g(channel, scaler) as (values ('view', 0.5), ('click', 1.0), ('error', 2.0), ('signup', 1.25), ('purchase', 0.0))
    select channel, frame, cast(trunc(x / scaler) as bigint) as y from sig join g using (channel) where scaler > 0""",
)
def _(v: Views):
    from framewright.operators import mixing

    gains = [("view", 0.5), ("click", 1.0), ("error", 2.0), ("signup", 1.25), ("purchase", 0.0)]
    return mixing.rescale(v.sig, gains).select("channel", "frame", _c("x").alias("y"))


@query(
    "crossfade_join",
    """o as (select frame, x from sig where channel = 'view' and frame < 64), n as (select frame, x from sig where channel = 'click' and frame < 64)
    select n.frame, cast(trunc(n.x * (n.frame / 64.0::double)) as bigint) + cast(trunc(o.x * (1.0 - n.frame / 64.0::double)) as bigint) as x from n join o using (frame)""",
)
def _(v: Views):
    from framewright.operators import mixing

    head = v.sig.filter("frame < 64")
    return mixing.crossfade(head.filter("channel = 'view'"), head.filter("channel = 'click'"), 64)


@query(
    "bilinear_grid_join",
    """grid as (select l as gx, r as gy, l * l * 10.0 + r * 7.0 as h from range(0, 12) t(l), range(0, 8) u(r)),
    p as (select event_id, cast(floor(value) as bigint) % 300 as ax, event_id % 140 as ay from events),
    q as (select *, ax // 30 as cx, ay // 20 as cy, (ax % 30) / 30.0 as fx, (ay % 20) / 20.0 as fy from p),
    k as (select q.*, i, j, (case when i = 1 then fx else 1 - fx end) * (case when j = 1 then fy else 1 - fy end) as w from q, range(0, 2) a(i), range(0, 2) b(j))
    select event_id, ax, ay, round(sum(w * h), 6) as h from k join grid on gx = cx + i and gy = cy + j group by event_id, ax, ay""",
)
def _(v: Views):
    grid = v.spark.range(96).select(F.floor(_c("id") / 8).cast("long").alias("gx"), (_c("id") % 8).alias("gy")).withColumn("h", _c("gx") * _c("gx") * 10.0 + _c("gy") * 7.0)
    points = v.events.select("event_id", (F.floor("value").cast("long") % 300).alias("ax"), (_c("event_id") % 140).alias("ay"))
    return lookups.bilinear(points, lookups.literal(grid), "ax", "ay", "h", 30, 20).withColumn("h", F.round("h", 6))


@query(
    "bit_merge_join",
    "p as (select l_orderkey as frame, sum(l_linenumber) % 8 as bits from lineitem group by 1) select s.channel, s.frame, s.x - (s.x & 7) + cast(p.bits as bigint) as x, true as upper_same from sig s join p using (frame)",
)
def _(v: Views):
    """Payload bits into the low bits of each sample; upper_same states that no other bit changed."""
    payload = v.lineitem.groupBy(_c("l_orderkey").alias("frame")).agg((F.sum("l_linenumber") % 8).alias("bits"))
    merged = v.sig.join(payload, "frame").withColumn("y", _c("x").bitwiseAND(F.lit(-8)).bitwiseOR(_c("bits")))
    return merged.select("channel", "frame", _c("y").alias("x"), (_c("x").bitwiseXOR(_c("y")).bitwiseAND(F.lit(-8)) == 0).alias("upper_same"))


@query(
    "full_outer_diff",
    """a as (select o_custkey as id, count(*) as n from orders where o_orderstatus = 'O' group by 1), b as (select o_custkey as id, count(*) as n from orders where o_orderstatus = 'F' group by 1)
    select coalesce(a.id, b.id) as id, case when a.id is null then 'missing' when b.id is null then 'new' when a.n = b.n then 'same' else 'changed' end as state from a full outer join b on a.id = b.id""",
)
def _(v: Views):
    count = lambda s, n: v.orders.filter(_c("o_orderstatus") == s).groupBy(_c("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias(n))
    state = F.when(_c("now").isNull(), "missing").when(_c("base").isNull(), "new").when(_c("now") == _c("base"), "same").otherwise("changed")
    return count("O", "now").join(count("F", "base"), "id", "full_outer").select("id", state.alias("state"))


@query(
    "positional_diff",
    """b as (select channel, frame, case when frame % 97 = 13 then x + 1 else x end as y from sig)
    select s.channel, count(*) filter (where s.x <> b.y) as n_diff, min(s.frame) filter (where s.x <> b.y) as first_frame, cast(max(abs(s.x - b.y)) as bigint) as max_abs from sig s join b using (channel, frame) group by s.channel""",
)
def _(v: Views):
    other = v.sig.select("channel", "frame", F.when(_c("frame") % 97 == 13, _c("x") + 1).otherwise(_c("x")).alias("y"))
    differs = _c("x") != _c("y")
    return v.sig.join(other, ["channel", "frame"]).groupBy("channel").agg(
        F.count(F.when(differs, 1)).alias("n_diff"), F.min(F.when(differs, _c("frame"))).alias("first_frame"), F.max(F.abs(_c("x") - _c("y"))).alias("max_abs")
    )


_PAIRS = [(0, 3), (1, 4), (2, 5), (4, 0), (5, 1)]


@query(
    "pair_rule_join",
    "rule(hi, lo) as (values " + ", ".join(f"({a}::bigint, {b}::bigint)" for a, b in _PAIRS) + ") select o_orderkey, hi, lo from orders join rule on (o_orderkey >> hi) & 1 = 1 and (o_custkey >> lo) & 1 = 1",
)
def _(v: Views):
    rule = lookups.literal(v.spark.createDataFrame(_PAIRS, "hi long, lo long"))
    has = lambda m, b: F.call_function("shiftright", _c(m), _c(b).cast("int")).bitwiseAND(F.lit(1)) == 1
    return v.orders.join(rule, has("o_orderkey", "hi") & has("o_custkey", "lo")).select("o_orderkey", "hi", "lo")


@query(
    "collect_group_members",
    "select r_name, cast(count(*) as bigint) as n, string_agg(n_name, ',' order by n_nationkey) as members from region join nation on r_regionkey = n_regionkey group by r_name",
)
def _(v: Views):
    joined = v.region.join(v.nation, _c("r_regionkey") == _c("n_regionkey"))
    members = F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda m: m["n_name"])
    return joined.groupBy("r_name").agg(F.count(F.lit(1)).alias("n"), F.array_join(members, ",").alias("members"))


@query(
    "full_coverage_join",
    "select p_partkey, cast(count(l_partkey) as bigint) as carriers, count(l_partkey) = 1 as once from part left join lineitem on p_partkey = l_partkey and l_linenumber = 1 group by p_partkey",
)
def _(v: Views):
    """How many groups carry each channel; a plan is sound if every one is carried once."""
    carriers = v.lineitem.filter("l_linenumber = 1").groupBy(_c("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    return v.part.join(carriers, "p_partkey", "left").select("p_partkey", n.alias("carriers"), (n == 1).alias("once"))


@query(
    "angle_mix",
    """a as (select event_id, event_id % 360 as angle, cast(floor(value * 100) as bigint) as src from events), n as (select count(*) as n from region)
    select event_id, case when angle % 2 = 0 then (src * (1000 + angle)) // 1000 else cast(floor(src * (1000 + angle) / 1000.0 + 0.5) as bigint) end as y from a""",
)
def _(v: Views):
    """Gain by angle; plain truncation for even angles, rounding for odd ones."""
    angle, src = _c("event_id") % 360, F.floor(_c("value") * 100)
    product = src * (1000 + angle)
    y = F.when(angle % 2 == 0, fixed.trunc_div(product, F.lit(1000).cast("long"))).otherwise(F.floor(product / 1000.0 + 0.5))
    return v.events.select("event_id", y.cast("long").alias("y"))


# Sinks and reports.


@query("sink_count_check", "select o_orderstatus, count(*) as declared, count(*) as written, true as complete from orders group by 1")
def _(v: Views):
    """Rows written per part against rows declared, from what the sink holds."""
    path = new_path(v.spark, "sink-orders")
    return sinks.write_checked(v.orders, path, "o_orderstatus")


@query("partitioned_write", "select channel, count(*) as n, cast(sum(x) as bigint) as total from sig group by channel")
def _(v: Views):
    path = new_path(v.spark, "sink-channels")
    v.sig.repartition("channel", F.floor(_c("frame") / (1 << 20))).write.partitionBy("channel").parquet(path)
    back = v.spark.read.parquet(path)
    return back.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total"))


@query(
    "box_samples",
    """s as (select c_nationkey, c_custkey // 4096 as part, c_name, row_number() over (partition by c_nationkey, c_custkey // 4096 order by c_custkey) - 1 as sample, length(c_name) as size from customer),
    c as (select *, case when sample < 6 then sample // 3 else 2 + (sample - 6) // 2 end as chunk from s)
    select c_nationkey, part, sample, cast(24 + sum(size) over (partition by c_nationkey, part order by sample) - size + 5 * chunk as bigint) as "offset", cast(size as bigint) as size, c_name as data from c""",
)
def _(v: Views):
    """A nation's customers, 4096 numbers a file, as samples in nested boxes, chunks of three and then two with gaps; found again by the files' tables."""
    path = new_path(v.spark, "boxes")
    def write(batches):
        store, inner = wav.located(path)
        store.create_dir(inner)
        for batch in batches:
            told = []
            for key, part, samples in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name = f"nation-{key}-{part}.boxes"
                with store.open_output_stream(f"{inner}/{name}") as f:
                    f.write(boxes.file_of([x.encode() for x in samples], [(1, 3), (3, 2)], gap=5))
                told.append(f"{path}/{name}")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(told, pa.string())], ["c_nationkey", "part", "path"])

    names = F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", "c_name"))), lambda r: r["c_name"])
    files, _ = write_table(v.customer.groupBy("c_nationkey", F.floor(_c("c_custkey") / 4096).alias("part")).agg(names.alias("names")).mapInArrow(write, "c_nationkey int, part long, path string"), "box-files")
    found = boxes.read_samples(v.spark, files.select("path"), samples_per_task=100, tasks=8)
    return found.join(files, "path").select("c_nationkey", "part", "sample", "offset", "size", _c("data").cast("string").alias("data"))


def _little_sql(x: str, width: int) -> str:
    """A number's bytes in hex, the lowest first."""
    return " || ".join(f"lpad(lower(to_hex((({x}) >> {8 * k}) & 255)), 2, '0')" for k in range(width))


@query(
    "wav_roundtrip",
    f"""p as (select a.frame, a.x as l, b.x as r from sig a join sig b on a.frame = b.frame and b.channel = 'click' where a.channel = 'view'),
    files as (select frame // 4096 as file, string_agg({_little_sql("l", 3)} || {_little_sql("r", 3)}, '' order by frame) as body, count(*) * 6 as n from p group by 1),
    told as (select file, sha256(unhex('52494646' || {_little_sql("36 + n", 4)} || '57415645666d742010000000' || '0100' || '0200' || {_little_sql("48000", 4)} || {_little_sql("288000", 4)} || '0600' || '1800' || '64617461' || {_little_sql("n", 4)} || body)) as file_sha256 from files)
    select k::int as channel, frame, case k when 0 then l else r end as x, file_sha256 from p join told on file = frame // 4096, range(0, 2) t(k)""",
)
def _(v: Views):
    """A pair of channels to 24-bit WAV files of 4096 frames, and back by ranges of 1000; with the digest of each file's bytes."""
    from framewright.operators import mixing

    pair = mixing.side_by_side(v.sig, {"x": "view", "r": "click"}).dropna()
    path = new_path(v.spark, "wav")
    long = pair.select("frame", F.posexplode(F.array("x", "r")).alias("channel", "x"))
    wav.write_wav(long, path, 2, frames_per_file=4096)
    back = wav.read_wav(v.spark, wav.wav_files(path), frames_per_task=1000, tasks=8)
    bytes_of = v.spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path)
    digests = bytes_of.select(wav.first_frame("path").alias("first"), F.sha2("content", 256).alias("file_sha256"))
    return back.withColumn("first", wav.first_frame("path")).join(digests, "first").select("channel", (_c("frame") + _c("first")).alias("frame"), "x", "file_sha256")


@query(
    "channel_map_report",
    r"""select n_nationkey, '<ROW>' || chr(10) || '    <id>' || n_nationkey || '</id>' || chr(10) || '    <name>' || n_name || '</name>' || chr(10) || '</ROW>' as xml from nation""",
)
def _(v: Views):
    return v.nation.select("n_nationkey", F.to_xml(F.struct(_c("n_nationkey").alias("id"), _c("n_name").alias("name"))).alias("xml"))


@query("probe_report", """select r_regionkey, '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' as report from region""")
def _(v: Views):
    return v.region.select("r_regionkey", F.to_json(F.struct("*")).alias("report"))


