"""Queries of projections, predicates, channel sets, strings, fixed point and bits."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.functions import bits, fixed, strings
from framewright.plans.registry import query
from framewright.plans.views import Views

_c = F.col


@query("scan_frame_range", "select channel, frame, x from sig where frame between 100 and 299")
def _(v: Views):
    return v.sig.filter(_c("frame").between(100, 299))


@query("scan_full", "select channel, frame, x from sig")
def _(v: Views):
    return v.sig


@query("project_reorder", "select l_shipdate, l_linenumber, l_orderkey, l_quantity from lineitem")
def _(v: Views):
    order = [10, 3, 0, 4]
    line = v.lineitem
    return line.select(*[line.columns[k] for k in order])


@query("project_one", "select vec_id, cast(embedding[8] as double) as v from embeddings")
def _(v: Views):
    return v.embeddings.select("vec_id", F.element_at("embedding", 8).cast("double").alias("v"))


@query(
    "lsb_clear_to_zero",
    "select channel, frame, (x // 8) * 8 as cleared, x - (x // 8) * 8 as lost from sig",
)
def _(v: Views):
    cleared = fixed.clear_low_bits("x", 3)
    return v.sig.select("channel", "frame", cleared.alias("cleared"), (_c("x") - cleared).alias("lost"))


@query(
    "bitdepth_normalize",
    "select channel, frame, x * 256 as wide, (case when x < 0 then x + 255 else x end) >> 8 as narrow from sig",
)
def _(v: Views):
    narrow = F.shiftright(F.when(_c("x") < 0, _c("x") + 255).otherwise(_c("x")), 8)
    return v.sig.select("channel", "frame", F.shiftleft("x", 8).alias("wide"), narrow.alias("narrow"))


@query("trunc_toward_zero", "select channel, frame, cast(trunc(x / 256.0) as bigint) as s16 from sig")
def _(v: Views):
    return v.sig.select("channel", "frame", fixed.trunc_div("x", F.lit(256)).alias("s16"))


@query(
    "clip_count",
    """g as (select channel, x * 1.5 as y, x * 1.5 / 256 as y16 from sig)
    select channel, sum(case when y > 8388607 or y < -8388608 then 1 else 0 end)::bigint as clipped24,
           sum(cast(trunc(greatest(-8388608.0, least(8388607.0, y))) as bigint))::bigint as total24,
           sum(case when y16 > 32767 or y16 < -32768 then 1 else 0 end)::bigint as clipped16,
           sum(cast(trunc(greatest(-32768.0, least(32767.0, y16))) as bigint))::bigint as total16
    from g group by channel""",
)
def _(v: Views):
    y = _c("x") * F.lit(1.5)

    def held(y, low, high, name):
        clipped = F.sum(((y > high) | (y < low)).cast("long")).alias(f"clipped{name}")
        return clipped, F.sum(fixed.clamp(y, float(low), float(high)).cast("long")).alias(f"total{name}")

    return v.sig.groupBy("channel").agg(*held(y, -8388608, 8388607, "24"), *held(y / 256, -32768, 32767, "16"))


@query(
    "silent_groups",
    "select channel, cast(frame // 32 as bigint) as blk, max(abs(x)) < 4000000 as silent from sig group by 1, 2",
)
def _(v: Views):
    return v.sig.groupBy("channel", fixed.trunc_div("frame", F.lit(32)).alias("blk")).agg((F.max(F.abs("x")) < 4000000).alias("silent"))


@query(
    "range_check_group",
    "select channel, bool_and(x between -8000000 and 8000000) as fits, min(x) as low, max(x) as high from sig group by channel",
)
def _(v: Views):
    return v.sig.groupBy("channel").agg(F.bool_and(_c("x").between(-8000000, 8000000)).alias("fits"), F.min("x").alias("low"), F.max("x").alias("high"))


@query("mask_subset", "select o_orderkey, (o_orderkey & 31) as mask, ((o_orderkey & 31) & ~13) = 0 as allowed from orders")
def _(v: Views):
    mask = _c("o_orderkey").bitwiseAND(F.lit(31))
    return v.orders.select("o_orderkey", mask.alias("mask"), bits.only(mask, F.lit(13).cast("long")).alias("allowed"))


@query(
    "mask_superset",
    """select o_orderkey, ((o_orderkey & 63) & 5) = 5 and ((o_orderkey & 63) & ~(5 | 18)) = 0 as compatible from orders""",
)
def _(v: Views):
    mask = _c("o_orderkey").bitwiseAND(F.lit(63))
    return v.orders.select("o_orderkey", (bits.has_all(mask, F.lit(5).cast("long")) & bits.only(mask, F.lit(5 | 18).cast("long"))).alias("compatible"))


@query("filter_in", "select p_partkey, p_size from part where p_size in (1, 8, 16, 32, 44, 48)")
def _(v: Views):
    return v.part.filter(_c("p_size").isin(1, 8, 16, 32, 44, 48)).select("p_partkey", "p_size")


@query(
    "filter_mod_range",
    "select o_orderkey from orders where (o_orderkey between 256 and 1024 and o_orderkey % 16 = 0 and o_orderkey <> 992) or o_orderkey = 1000",
)
def _(v: Views):
    k = _c("o_orderkey")
    return v.orders.filter((k.between(256, 1024) & (k % 16 == 0) & (k != 992)) | (k == 1000)).select("o_orderkey")


@query(
    "case_ladder",
    """select l_orderkey, l_linenumber, case when l_quantity < 5 then 1 when l_discount > 0.08 then 2 when l_tax = 0 then 3
       when l_returnflag = 'R' then 4 else 0 end as status from lineitem""",
)
def _(v: Views):
    status = F.when(_c("l_quantity") < 5, 1).when(_c("l_discount") > 0.08, 2).when(_c("l_tax") == 0, 3).when(_c("l_returnflag") == "R", 4).otherwise(0)
    return v.lineitem.select("l_orderkey", "l_linenumber", status.alias("status"))


@query(
    "coalesce_defaults",
    """select event_id, coalesce(case when value > 100 then value end, 48000.0) as rate,
       coalesce(nullif(event_type, 'view'), 'default') as kind, coalesce(cast(json_extract_string(props, '$.gain') as bigint), -3) as gain from events""",
)
def _(v: Views):
    gain = F.get_json_object("props", "$.gain").cast("long")
    return v.events.select(
        "event_id",
        F.coalesce(F.when(_c("value") > 100, _c("value")), F.lit(48000.0)).alias("rate"),
        F.coalesce(F.nullif("event_type", F.lit("view")), F.lit("default")).alias("kind"),
        F.coalesce(gain, F.lit(-3).cast("long")).alias("gain"),
    )


@query("shift_right", "select channel, frame, x >> 5 as y from sig")
def _(v: Views):
    return v.sig.select("channel", "frame", F.shiftright("x", 5).alias("y"))


@query("shift_left", "select channel, frame, ((x * 4096 + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 as y from sig")
def _(v: Views):
    return v.sig.select("channel", "frame", fixed.wrap32(F.shiftleft("x", 12)).alias("y"))


@query("bit_count", "select o_orderkey, cast(bit_count(o_orderkey) as bigint) as n from orders")
def _(v: Views):
    return v.orders.select("o_orderkey", F.bit_count("o_orderkey").cast("long").alias("n"))


# Channel sets.


@query(
    "set_except",
    """m as (select o_orderkey, o_orderkey & 255 as requested, (o_orderkey >> 2) & 255 as input, (o_orderkey >> 4) & 255 as produced from orders)
    select o_orderkey, requested & ~(input | produced) as missing from m""",
)
def _(v: Views):
    k = _c("o_orderkey")
    low = F.lit(255)
    produced = F.shiftright(k, 2).bitwiseAND(low).bitwiseOR(F.shiftright(k, 4).bitwiseAND(low))
    return v.orders.select("o_orderkey", k.bitwiseAND(low).bitwiseAND(F.bitwise_not(produced)).alias("missing"))


@query(
    "mask_case",
    """select o_orderkey, case o_orderkey % 3 when 0 then (o_orderkey & 3) = 3 when 1 then (o_orderkey & 12) <> 0 and (o_orderkey & 3) = 0
       else (o_orderkey & 16) = 0 end as consistent from orders""",
)
def _(v: Views):
    k = _c("o_orderkey")
    bit = lambda m: k.bitwiseAND(F.lit(m))
    rule = F.when(k % 3 == 0, bit(3) == 3).when(k % 3 == 1, (bit(12) != 0) & (bit(3) == 0)).otherwise(bit(16) == 0)
    return v.orders.select("o_orderkey", rule.alias("consistent"))


_LAYOUTS = [(1, "eleven", 4095), (2, "seven", 255), (3, "five", 63), (4, "stereo", 3), (5, "mono", 1)]
_LAYOUT_SQL = "layout(priority, name, need) as (values " + ", ".join(f"({p}, '{n}', {m}::bigint)" for p, n, m in _LAYOUTS) + ")"


def _layouts(v: Views):
    return v.spark.createDataFrame(_LAYOUTS, "priority int, name string, need long")


@query(
    "priority_rule_match",
    _LAYOUT_SQL
    + """, req as (select o_orderkey, (o_orderkey * 37) & 4095 as mask from orders)
    select o_orderkey, arg_min(name, priority) as layout from req join layout on (mask & need) = need group by o_orderkey""",
)
def _(v: Views):
    req = v.orders.select("o_orderkey", (_c("o_orderkey") * 37).bitwiseAND(F.lit(4095)).alias("mask"))
    found = req.join(F.broadcast(_layouts(v)), bits.has_all("mask", "need"))  # five literal rows
    return found.groupBy("o_orderkey").agg(F.min_by("name", "priority").alias("layout"))


@query(
    "copy_or_zero",
    """ch(channel, bit) as (values ('signup', 0), ('purchase', 1), ('error', 2), ('view', 3), ('click', 4))
    select s.channel, s.frame, case when c.bit in (0, 2, 4) then s.x else 0 end as x from sig s left join ch c using (channel)""",
)
def _(v: Views):
    kept = v.spark.createDataFrame([("signup",), ("error",), ("click",)], "channel string").withColumn("kept", F.lit(True))
    return v.sig.join(F.broadcast(kept), "channel", "left").select("channel", "frame", F.when(_c("kept"), _c("x")).otherwise(F.lit(0)).alias("x"))


@query(
    "set_union",
    """select 0::bigint as part, c_custkey as id, c_name as name from customer where c_custkey <= 50
    union all select 1::bigint, s_suppkey, s_name from supplier union all select 2::bigint, p_partkey, p_name from part where p_size < 5""",
)
def _(v: Views):
    part = lambda k, df, i, n: df.select(F.lit(k).cast("long").alias("part"), _c(i).alias("id"), _c(n).alias("name"))
    beds = part(0, v.customer.filter("c_custkey <= 50"), "c_custkey", "c_name")
    return beds.unionByName(part(1, v.supplier, "s_suppkey", "s_name")).unionByName(part(2, v.part.filter("p_size < 5"), "p_partkey", "p_name"))


# Strings.


@query(
    "str_normalize",
    r"""n as (select p_partkey, translate(lower(p_type || ' 7.1.4+' || p_name), '+ ', '') as s from part)
    select p_partkey, case when instr(s, '.') = 0 then s else split_part(s, '.', 1) || '.' || regexp_replace(regexp_extract(s, '^[^.]*\.(.*)$', 1), '\.([0-9])', '_\1', 'g') end as name from n""",
)
def _(v: Views):
    return v.part.select("p_partkey", strings.layout_name(F.concat("p_type", F.lit(" 7.1.4+"), "p_name")).alias("name"))


@query("str_lower", "select n_nationkey, lower(n_name) as name from nation")
def _(v: Views):
    return v.nation.select("n_nationkey", F.lower("n_name").alias("name"))


@query("str_translate", "select p_partkey, translate(lower(p_brand || '+' || p_type || '-x'), '+-', '__') as name from part")
def _(v: Views):
    return v.part.select("p_partkey", strings.symbol_name(F.concat("p_brand", F.lit("+"), "p_type", F.lit("-x"))).alias("name"))


@query(
    "parse_coalesce",
    _LAYOUT_SQL
    + """, arg as (select o_orderkey, case o_orderkey % 4 when 0 then 'stereo' when 1 then '0x' || printf('%x', o_orderkey) when 2 then cast(o_orderkey as varchar) else 'auto' end as a from orders)
    select o_orderkey, coalesce(l.need, case when starts_with(a, '0x') then cast(a as bigint) end, try_cast(a as bigint), 0) as mask
    from arg left join layout l on l.name = arg.a""",
)
def _(v: Views):
    k = _c("o_orderkey")
    text = F.when(k % 4 == 0, "stereo").when(k % 4 == 1, F.concat(F.lit("0x"), F.lower(F.hex(k)))).when(k % 4 == 2, k.cast("string")).otherwise("auto")
    arg = v.orders.select("o_orderkey", text.alias("a"))
    hexed = F.when(F.startswith("a", F.lit("0x")), F.conv(F.substring("a", 3, 16), 16, 10).cast("long"))
    found = arg.join(F.broadcast(_layouts(v).select("name", "need")), _c("a") == _c("name"), "left")
    return found.select("o_orderkey", F.coalesce("need", hexed, F.expr("try_cast(a as bigint)"), F.lit(0).cast("long")).alias("mask"))


@query("try_cast", "select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k, try_cast(event_type as bigint) as none from events")
def _(v: Views):
    return v.events.select("event_id", F.expr("try_cast(get_json_object(props, '$.k') as bigint) as k"), F.expr("try_cast(event_type as bigint) as none"))


@query("string_agg", "select n_regionkey, string_agg(n_name, ',' order by n_name) as names, cast(count(*) as bigint) as n from nation group by n_regionkey")
def _(v: Views):
    return v.nation.groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("names"), F.count(F.lit(1)).alias("n"))


@query(
    "xml_escape",
    """select p_partkey, replace(replace(replace(replace(replace('<' || p_name || ' & "x" ''y''>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') as xml from part""",
)
def _(v: Views):
    return v.part.select("p_partkey", strings.xml_escape(F.concat(F.lit("<"), "p_name", F.lit(" & \"x\" 'y'>"))).alias("xml"))


@query("file_ext", "select page_id, lower(regexp_extract(url, '\\.([^./\\\\]*)$', 1)) as ext from pages")
def _(v: Views):
    return v.pages.select("page_id", strings.extension("url").alias("ext"))


@query(
    "hex_label",
    "select o_orderkey, case when o_orderkey % 2 = 0 then o_orderstatus else 'custom' end || ' (0x' || printf('%x', o_orderkey) || ', ' || cast(bit_count(o_orderkey) as varchar) || ' ch)' as label from orders",
)
def _(v: Views):
    name = F.when(_c("o_orderkey") % 2 == 0, _c("o_orderstatus"))
    return v.orders.select("o_orderkey", strings.layout_label(name, "o_orderkey").alias("label"))


@query("map_lookup", "select event_id, case event_type when 'view' then 'L' when 'click' then 'R' when 'purchase' then 'C' else 'none' end as name from events")
def _(v: Views):
    names = F.create_map(*map(F.lit, ["view", "L", "click", "R", "purchase", "C"]))
    return v.events.select("event_id", F.coalesce(F.try_element_at(names, _c("event_type")), F.lit("none")).alias("name"))


# Fixed point and decibels. Doubles are rounded on both sides: logarithms may differ in the last bit.


@query("db_to_linear", "select event_id, round(case when value < 1 then 0.0 else power(10.0, -value / 100.0 / 20.0) end, 9) as y from events")
def _(v: Views):
    return v.events.select("event_id", F.round(F.when(_c("value") < 1, 0.0).otherwise(fixed.db_to_linear(-_c("value") / 100.0)), 9).alias("y"))


@query("linear_to_db", "select channel, frame, round(case when x <> 0 then greatest(-3000.0, 20.0 * log10(abs(x) / 8388608.0)) else -3000.0 end, 6) as db from sig")
def _(v: Views):
    return v.sig.select("channel", "frame", F.round(fixed.linear_to_db(F.abs("x") / float(fixed.RAIL)), 6).alias("db"))


@query("db_floor", "select channel, frame, round(case when x <> 0 then greatest(-144.0, 10.0 * log10(cast(x as double) * x / 70368744177664.0)) else -144.0 end, 6) as db from sig")
def _(v: Views):
    x = _c("x").cast("double")
    return v.sig.select("channel", "frame", F.round(fixed.power_to_db(x * x / float(fixed.RAIL) ** 2), 6).alias("db"))


@query(
    "gain_code",
    """recursive code(c, g) as (select 0, 8388608::bigint union all select c + 1, g * 8289200 // 8388608 from code where c < 255)
    select e.event_id, case when e.event_id % 17 = 0 then 0 else k.g end as q23 from events e join code k on k.c = e.event_id % 256""",
)
def _(v: Views):
    """A code is so many steps of a fixed Q23 factor below one, each truncated; a selector other than 0 is silence."""
    steps = F.aggregate(F.sequence(F.lit(1), (_c("event_id") % 256).cast("int")), F.lit(fixed.Q23).cast("long"), lambda g, _i: fixed.q23_mul(g, F.lit(8289200)))
    gain = F.when(_c("event_id") % 256 == 0, F.lit(fixed.Q23).cast("long")).otherwise(steps)
    return v.events.select("event_id", F.when(_c("event_id") % 17 == 0, F.lit(0).cast("long")).otherwise(gain).alias("q23"))


@query("q23_mul", "select channel, frame, (x * 5931642) // 8388608 as y from sig")
def _(v: Views):
    return v.sig.select("channel", "frame", fixed.q23_mul("x", F.lit(5931642).cast("long")).alias("y"))


@query("q23_mul_round", "select channel, frame, cast(trunc((x * 5931642) / 8388608.0::double) as bigint) as y from sig")
def _(v: Views):
    return v.sig.select("channel", "frame", fixed.q23_mul_biased("x", F.lit(5931642).cast("long")).alias("y"))


@query("wrap_add", "select channel, frame, ((x * 300 + 2000000000 + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 as y from sig")
def _(v: Views):
    return v.sig.select("channel", "frame", fixed.wrap32(_c("x") * 300 + 2000000000).alias("y"))


@query("zigzag", "select o_orderkey as u, case when o_orderkey & 1 = 1 then -((o_orderkey + 1) // 2) else o_orderkey // 2 end as x, o_orderkey as back from orders")
def _(v: Views):
    x = fixed.zigzag_decode("o_orderkey")
    return v.orders.select(_c("o_orderkey").alias("u"), x.alias("x"), fixed.zigzag_encode(x).alias("back"))


@query("sign_extend", "select o_orderkey, case when o_orderkey % 1024 >= 512 then o_orderkey % 1024 - 1024 else o_orderkey % 1024 end as x from orders")
def _(v: Views):
    return v.orders.select("o_orderkey", fixed.sign_extend(_c("o_orderkey") % 1024, 10).alias("x"))


@query("round_half_away", "select event_id, cast(round((value - 250) / 2, 0) as bigint) + case event_type when 'view' then 4 else 0 end as code from events where abs(value - 250) < 200")
def _(v: Views):
    code = fixed.round_half_away((_c("value") - 250) / 2) + F.when(_c("event_type") == "view", 4).otherwise(0)
    return v.events.filter(F.abs(_c("value") - 250) < 200).select("event_id", code.alias("code"))


@query("trunc_div", "select channel, frame, (3 * x + frame) // 4 as y from sig")
def _(v: Views):
    return v.sig.select("channel", "frame", fixed.trunc_div(3 * _c("x") + _c("frame"), F.lit(4)).alias("y"))


@query("even_round", "select channel, frame, (x // 2) * 2 as y from sig")
def _(v: Views):
    x = _c("x")
    return v.sig.select("channel", "frame", (x + F.when(x < 0, 1).otherwise(0)).bitwiseAND(F.lit(-2)).alias("y"))


@query("scaler_from_db", "select event_id, round(case when value >= 144 then 0.0 else power(10.0, -value / 20.0) end, 9) as scaler from events")
def _(v: Views):
    return v.events.select("event_id", F.round(F.when(_c("value") >= 144, 0.0).otherwise(fixed.db_to_linear(-_c("value"))), 9).alias("scaler"))


@query(
    "array_lookup",
    "select o_orderkey, round(case when o_orderkey % 20 = 0 then 0.0 when o_orderkey % 20 > 15 then 1.0 else power(10.0, ([-30, -27, -24, -21, -18, -15, -12, -10, -8, -6, -5, -4, -3, -2, -1])[(o_orderkey % 20)] / 20.0) end, 9) as strength from orders",
)
def _(v: Views):
    levels = F.array(*[F.lit(x) for x in (-30, -27, -24, -21, -18, -15, -12, -10, -8, -6, -5, -4, -3, -2, -1)])
    k = _c("o_orderkey") % 20
    listed = fixed.db_to_linear(F.try_element_at(levels, F.greatest(k, F.lit(1)).cast("int")))
    return v.orders.select("o_orderkey", F.round(F.when(k == 0, 0.0).when(k > 15, 1.0).otherwise(listed), 9).alias("strength"))


@query("bit_length", "select o_orderkey, cast(length(bin(o_orderkey)) as bigint) as width from orders")
def _(v: Views):
    return v.orders.select("o_orderkey", F.length(F.bin("o_orderkey")).cast("long").alias("width"))


@query(
    "sat_add",
    "select channel, frame, greatest(-8388608, least(8388607, x + 3000000)) as y from sig",
)
def _(v: Views):
    return v.sig.select("channel", "frame", fixed.sat_add("x", F.lit(3000000)).alias("y"))


def _unit(seed: int, place: str) -> str:
    """A number from 0 to 255 from a seed, a channel and a frame, in SQL of either engine."""
    mixed = f"((frame * 69069 + ascii(channel) * 40503 + length(channel) * 30011 + {seed}) & 2147483647)"
    return f"(((({mixed} * 48271) % 2147483647) >> 9) & 255)" if place == "duckdb" else f"(shiftright((({mixed} * 48271) % 2147483647), 9) & 255)"


@query("seeded_noise", f"select channel, frame, greatest(-8388608, least(8388607, x + (({_unit(11, 'duckdb')} + {_unit(1013, 'duckdb')} - 255) >> 7))) as y from sig")
def _(v: Views):
    """Triangular dither of two least steps, from a seed and the place alone, added without wrapping."""
    step = F.shiftright(F.expr(_unit(11, "spark")) + F.expr(_unit(1013, "spark")) - 255, 7)
    return v.sig.select("channel", "frame", fixed.sat_add("x", step.cast("long")).alias("y"))


# Bits, codes and checksums.


@query("unary_len", "select o_orderkey, cast(length(regexp_extract(bin(o_orderkey), '^1*')) as bigint) as n from orders")
def _(v: Views):
    return v.orders.select("o_orderkey", F.length(F.regexp_extract(F.bin("o_orderkey"), "^1*", 0)).cast("long").alias("n"))


@query(
    "rice_encode_str",
    "select o_orderkey, repeat('1', cast((o_orderkey % 200) >> 4 as bigint)) || '0' || lpad(bin((o_orderkey % 200) & 15), 4, '0') as code from orders",
)
def _(v: Views):
    return v.orders.select("o_orderkey", bits.rice_code(_c("o_orderkey") % 200, 4).alias("code"))


@query(
    "rice_roundtrip",
    """select o_orderkey, repeat('1', cast((o_orderkey % 1000) >> 5 as int)) || '0' || lpad(bin((o_orderkey % 1000) & 31), 5, '0') as code, o_orderkey % 1000 as back, cast(((o_orderkey % 1000) >> 5) + 6 as bigint) as n_bits from orders""",
)
def _(v: Views):
    coded = v.orders.withColumn("code", bits.rice_code(_c("o_orderkey") % 1000, 5))
    return coded.select("o_orderkey", "code", bits.rice_decode("code", 5).alias("back"), F.length("code").cast("long").alias("n_bits"))


@query(
    "vlq_roundtrip",
    """k as (select o_orderkey, o_orderkey * 977 as k, (length(bin(o_orderkey * 977)) + 6) // 7 as n from orders)
    select o_orderkey, list_aggregate(list_transform(range(n), lambda g: case when g < n - 1 then '1' else '0' end || lpad(bin((k >> (7 * (n - 1 - g))) & 127), 7, '0')), 'string_agg', '') as code, k as back, cast(n as bigint) as n_groups from k""",
)
def _(v: Views):
    """Seven bits a group, high group first, a leading one on all groups but the last."""
    k = _c("o_orderkey") * 977
    digits = F.bin(k)
    groups = F.floor((F.length(digits) + 6) / 7).cast("int")
    padded = v.orders.select("o_orderkey", groups.alias("n"), F.lpad(digits, groups * 7, "0").alias("bits"))
    coded = F.array_join(F.transform(F.sequence(F.lit(1), _c("n")), lambda g: F.concat(F.when(g < _c("n"), "1").otherwise("0"), F.substring(_c("bits"), (g - 1) * 7 + 1, F.lit(7)))), "")
    coded = padded.withColumn("code", coded)
    read = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length("code") / 8).cast("int") - 1), lambda g: F.substring(_c("code"), g * 8 + 2, F.lit(7))), "")
    return coded.select("o_orderkey", "code", F.conv(read, 2, 10).cast("long").alias("back"), F.floor(F.length("code") / 8).cast("long").alias("n_groups"))


@query(
    "pack_word",
    "select l_orderkey, sum((l_linenumber & 15) * power(16, 7 - l_linenumber)::bigint)::bigint as word from lineitem where l_linenumber <= 7 group by l_orderkey",
)
def _(v: Views):
    """Up to seven 4-bit fields, first field highest, in one word; absent fields are zero."""
    line = v.lineitem.filter("l_linenumber <= 7")
    shifted = F.call_function("shiftleft", _c("l_linenumber").cast("long").bitwiseAND(F.lit(15)), (7 - _c("l_linenumber")) * 4)
    return line.groupBy("l_orderkey").agg(F.sum(shifted).alias("word"))


@query("unpack_word", "select o_orderkey, (o_orderkey >> 8) & 255 as hi, (o_orderkey >> 4) & 15 as mid, o_orderkey & 15 as lo from orders")
def _(v: Views):
    return v.orders.select("o_orderkey", bits.field("o_orderkey", 8, 8).alias("hi"), bits.field("o_orderkey", 4, 4).alias("mid"), bits.field("o_orderkey", 0, 4).alias("lo"))


@query("sign_magnitude", "select channel, frame, case when x < 0 then 8388608 + (abs(x) & 8388607) else x end as code from sig")
def _(v: Views):
    return v.sig.select("channel", "frame", F.when(_c("x") < 0, F.lit(8388608) + F.abs("x").bitwiseAND(F.lit(8388607))).otherwise(_c("x")).alias("code"))


_CRC_SQL = """data as (select o_orderkey, [(o_orderkey >> 8) & 255, o_orderkey & 255] as b from orders),
    steps(o_orderkey, b, crc, n) as (
      select o_orderkey, b, 65535::bigint, 0 from data
      union all
      select o_orderkey, b, xor((crc * 2) & 65535, xor((crc >> 15) & 1, (b[n // 8 + 1] >> (7 - n % 8)) & 1) * 4129), n + 1 from steps where n < 16
    )"""


@query("crc16_fold", "recursive " + _CRC_SQL + " select o_orderkey, crc from steps where n = 16")
def _(v: Views):
    data = F.array(bits.field("o_orderkey", 8, 8), bits.field("o_orderkey", 0, 8))
    return v.orders.select("o_orderkey", bits.crc16(data).alias("crc"))


@query(
    "crc_filter",
    "recursive " + _CRC_SQL + " select o_orderkey from steps where n = 16 and (o_orderkey % 5 <> 0 or crc % 4 = 1)",
)
def _(v: Views):
    """Rows whose header word differs, or whose checksum agrees."""
    crc = bits.crc16(F.array(bits.field("o_orderkey", 8, 8), bits.field("o_orderkey", 0, 8)))
    return v.orders.withColumn("crc", crc).filter((_c("o_orderkey") % 5 != 0) | (_c("crc") % 4 == 1)).select("o_orderkey")


@query(
    "bit_address",
    """select frame, channel, case when frame < 16 then 0 when frame < 32 then 1 when frame < 48 then 2 else (frame - 48) // 6 end as word,
       case when frame < 48 then frame % 16 else (frame - 48) % 6 end as bit from sig""",
)
def _(v: Views):
    f = _c("frame")
    word = F.when(f < 16, 0).when(f < 32, 1).when(f < 48, 2).otherwise(fixed.trunc_div(f - 48, F.lit(6)))
    return v.sig.select("frame", "channel", word.cast("long").alias("word"), F.when(f < 48, f % 16).otherwise((f - 48) % 6).alias("bit"))


@query("set_bit", "select channel, frame, x - (x & 1) + (frame % 3 = 0)::int as y from sig")
def _(v: Views):
    return v.sig.select("channel", "frame", (_c("x").bitwiseAND(F.lit(-2)).bitwiseOR((_c("frame") % 3 == 0).cast("long"))).alias("y"))


@query(
    "tagged_union",
    """select o_orderkey, case when o_orderkey % 4 = 0 then o_orderkey >> 4 end as gain, case when o_orderkey % 4 = 1 then (o_orderkey >> 4) & 15 end as high,
       case when o_orderkey % 4 = 1 then o_orderkey & 15 end as low, case when o_orderkey % 4 = 2 then o_orderstatus end as label from orders""",
)
def _(v: Views):
    k = _c("o_orderkey")
    code = k % 4
    return v.orders.select(
        "o_orderkey",
        F.when(code == 0, F.shiftright(k, 4)).alias("gain"),
        F.when(code == 1, bits.field(k, 4, 4)).alias("high"),
        F.when(code == 1, bits.field(k, 0, 4)).alias("low"),
        F.when(code == 2, _c("o_orderstatus")).alias("label"),
    )


# Arrays and nested values.


@query("json_extract", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def _(v: Views):
    return v.events.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query(
    "nested_explode",
    """n as (select l_orderkey, list({'n': l_linenumber, 'q': l_quantity}) as groups from lineitem group by l_orderkey)
    select l_orderkey, g.n as l_linenumber, g.q as l_quantity from (select l_orderkey, unnest(groups) as g from n) where g.q > 25""",
)
def _(v: Views):
    """Programs hold groups, groups hold members: nested once, filtered inside, and flattened again."""
    nested = v.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_quantity")).alias("groups"))
    loud = nested.select("l_orderkey", F.filter("groups", lambda g: g["l_quantity"] > 25).alias("groups"))
    return loud.select("l_orderkey", F.explode("groups").alias("g")).select("l_orderkey", "g.l_linenumber", "g.l_quantity")


@query("nested_max", "select vec_id, cast(greatest(list_max(embedding[1:16]), list_max(embedding[17:32]), list_max(embedding[33:64])) as double) as top from embeddings")
def _(v: Views):
    part = lambda a, n: F.array_max(F.slice("embedding", a, n))
    return v.embeddings.select("vec_id", F.greatest(part(1, 16), part(17, 16), part(33, 32)).cast("double").alias("top"))


@query("array_slice", "select vec_id, cast(list_sum(list_transform(embedding[5:12], lambda e: floor(cast(e as double) * 1000))) as bigint) as total from embeddings")
def _(v: Views):
    cut = F.transform(F.slice("embedding", 5, 8), lambda e: F.floor(e.cast("double") * 1000))
    return v.embeddings.select("vec_id", F.aggregate(cut, F.lit(0).cast("long"), lambda a, b: a + b).alias("total"))


@query(
    "bitset_to_indices",
    """b as (select o_orderkey, unnest(range(0, 16)) as bit from orders), s as (select * from b where (o_orderkey >> bit) & 1 = 1)
    select o_orderkey, bit, row_number() over (partition by o_orderkey order by bit) - 1 as stream from s""",
)
def _(v: Views):
    flags = v.orders.select("o_orderkey", F.posexplode(bits.set_bits(_c("o_orderkey"), 16)).alias("stream", "bit"))
    return flags.select("o_orderkey", _c("bit").cast("long").alias("bit"), _c("stream").cast("long").alias("stream"))


@query(
    "split_lengths",
    """o as (select o_orderkey, o_orderkey % 5000 + 1 as total from orders), p as (select *, least(total, 300) as head from o),
    q as (select *, (total - head) // 512 as fulls, (total - head) % 512 as rest from p)
    select o_orderkey, cast(1 + fulls + case when rest > 0 and (fulls = 0 or 3 * rest > 512) then 1 else 0 end as bigint) as parts,
           cast(case when rest = 0 then case when fulls > 0 then 512 else head end when fulls = 0 or 3 * rest > 512 then rest else 512 + rest end as bigint) as last from q""",
)
def _(v: Views):
    """First part up to a cap, then full parts; a rest of over a third of a part is one by itself, else it joins the last."""
    total = _c("o_orderkey") % 5000 + 1
    head = F.least(total, F.lit(300))
    left = v.orders.select("o_orderkey", head.alias("head"), (total - head).alias("left"))
    fulls = fixed.trunc_div("left", F.lit(512))
    rest = _c("left") % 512
    own = (rest > 0) & ((fulls == 0) | (3 * rest > 512))
    sizes = F.concat(F.array("head"), F.array_repeat(F.lit(512).cast("long"), fulls.cast("int")), F.when(own, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    made = left.select("o_orderkey", sizes.alias("sizes"), F.when(own, F.lit(0).cast("long")).otherwise(rest).alias("extra"))
    return made.select("o_orderkey", F.size("sizes").cast("long").alias("parts"), (F.element_at("sizes", -1) + _c("extra")).alias("last"))


@query(
    "cumulative_cap",
    """r as (select l_orderkey, l_linenumber, cast(l_quantity as bigint) as n, sum(cast(l_quantity as bigint)) over (partition by l_orderkey order by l_linenumber) as upto from lineitem)
    select l_orderkey, l_linenumber, cast(greatest(0, least(n, 100 - (upto - n))) as bigint) as kept from r""",
)
def _(v: Views):
    from pyspark.sql import Window

    n = _c("l_quantity").cast("long")
    upto = F.sum(n).over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    return v.lineitem.select("l_orderkey", "l_linenumber", F.greatest(F.lit(0), F.least(n, F.lit(100) - (upto - n))).alias("kept"))


@query("search_step", "select o_orderkey, case o_orderkey % 4 when 1 then greatest(o_orderkey % 300 - 1, 1) when 3 then least(o_orderkey % 300 + 30, 256) else o_orderkey % 300 end as k from orders")
def _(v: Views):
    k = _c("o_orderkey") % 300
    status = _c("o_orderkey") % 4
    return v.orders.select("o_orderkey", F.when(status == 1, F.greatest(k - 1, F.lit(1))).when(status == 3, F.least(k + 30, F.lit(256))).otherwise(k).alias("k"))
