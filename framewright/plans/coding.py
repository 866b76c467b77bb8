"""Queries of packed values, checksums over samples, and three sources in one carrier."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from framewright.functions import bits, fixed
from framewright.operators import bitstream, mixing, prediction, records, recursions
from framewright.plans.registry import query
from framewright.plans.views import Views

_c = F.col


@query(
    "raw_bits_roundtrip",
    """select l_orderkey, cast(length(bin(max(l_suppkey))) as bigint) as width, cast(count(*) * length(bin(max(l_suppkey))) as bigint) as n_bits,
    string_agg(lpad(bin(l_suppkey), cast(w as int), '0'), '' order by l_linenumber, l_suppkey) as code, string_agg(l_suppkey, ',' order by l_linenumber, l_suppkey) as back
    from lineitem join (select l_orderkey, length(bin(max(l_suppkey))) as w from lineitem group by 1) using (l_orderkey) group by l_orderkey""",
)
def _(v: Views):
    """A block's values in as many bits as its largest needs, one after another, and read back by place."""
    rows = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda r: r["l_suppkey"])
    packed = v.lineitem.groupBy("l_orderkey").agg(rows.alias("xs")).withColumn("width", F.length(F.bin(F.array_max("xs"))))
    packed = packed.withColumn("code", F.array_join(F.transform("xs", lambda x: F.lpad(F.bin(x), _c("width"), F.lit("0"))), ""))
    read = F.transform(F.sequence(F.lit(0), F.size("xs") - 1), lambda k: F.conv(F.substring("code", k * _c("width") + 1, _c("width")), 2, 10))
    return packed.select("l_orderkey", "code", _c("width").cast("long").alias("width"), F.length("code").cast("long").alias("n_bits"), F.array_join(read, ",").alias("back"))


@query(
    "lsb_bit_writer",
    """w as (select l_orderkey, l_linenumber, cast(l_linenumber as bigint) as q, length(bin(l_linenumber)) as n from lineitem),
    o as (select *, sum(n) over (partition by l_orderkey order by q rows between unbounded preceding and current row) - n as place from w)
    select l_orderkey, cast(sum(n) as bigint) as n_bits, cast(sum(q << cast(place as bigint)) as bigint) as word from o group by l_orderkey""",
)
def _(v: Views):
    """Values of their own widths, the low bit first, written into bytes and read as one little-endian word."""
    rows = F.transform(F.sort_array(F.collect_list(F.struct(_c("l_linenumber").cast("long").alias("q")))), lambda r: F.reverse(F.bin(r["q"])))
    written = v.lineitem.groupBy("l_orderkey").agg(F.array_join(rows, "").alias("stream"))
    byte = lambda k: F.conv(F.reverse(F.substring("stream", k * 8 + 1, F.lit(8))), 2, 10).cast("long")
    octets = F.transform(F.sequence(F.lit(0), F.floor((F.length("stream") - 1) / 8).cast("int")), byte)
    word = F.aggregate(F.reverse(octets), F.lit(0).cast("long"), lambda w, b: w * 256 + b)
    return written.select("l_orderkey", F.length("stream").cast("long").alias("n_bits"), word.alias("word"))


@query(
    "crc16_pcm",
    """b as (select channel, frame // 32 as blk, x & 16777215 as u, row_number() over (partition by channel, frame // 32 order by frame) - 1 as k from sig),
    o as (select channel, blk, 3 * k + j as n, case when j = 0 and k < 16 then u & 253 else (u >> (8 * j)) & 255 end as v from b, range(0, 3) t(j)),
    d as (select channel, blk, list((v >> (7 - i)) & 1 order by n, i) as bits from o, range(0, 8) s(i) group by 1, 2)
    select channel, blk, 65535 - list_reduce(list_prepend(0::bigint, bits), lambda c, d: xor((c << 1) & 65535, xor(c >> 15, d) * 4129)) as crc from d""",
)
def _(v: Views):
    """The complemented CRC of a block's 24-bit samples; the bits that hold it, one in each of the first 16, count as zero."""
    samples = F.transform(F.sort_array(F.collect_list(F.struct("frame", "x"))), lambda r: r["x"].bitwiseAND(F.lit(16777215)))
    blocks = v.sig.groupBy("channel", F.floor(_c("frame") / 32).cast("long").alias("blk")).agg(samples.alias("xs"))

    def octets(x, k):
        low = F.when(k < 16, x.bitwiseAND(F.lit(253))).otherwise(x.bitwiseAND(F.lit(255)))
        return F.array(low, bits.field(x, 8, 8), bits.field(x, 16, 8))

    return blocks.select("channel", "blk", (F.lit(65535) - bits.crc16(F.flatten(F.transform("xs", octets)), 0)).alias("crc"))


@query(
    "clip_peak_stats",
    """w as (select frame, max(x) filter (where channel = 'view') as l, max(x) filter (where channel = 'click') as r, max(x) filter (where channel = 'error') as a, max(x) filter (where channel = 'purchase') as b from sig group by frame),
    p as (select frame // 32 as blk, cast(greatest(max(greatest(abs(coalesce(l, 0)), abs(coalesce(r, 0)))), max((abs(coalesce(a, 0)) + abs(coalesce(b, 0))) // 2)) as bigint) as peak from w group by 1)
    select s.channel, s.frame // 32 as blk, p.peak, count(*) filter (where abs(s.x) >= 8388607) as clipped from sig s join p on p.blk = s.frame // 32 group by 1, 2, 3""",
)
def _(v: Views):
    """A block's peak over the front pair and the weighted surrounds, told to every channel, with its own clipped samples."""
    one = lambda ch: F.coalesce(F.max(F.when(_c("channel") == ch, F.abs("x"))), F.lit(0).cast("long"))
    block = F.floor(_c("frame") / 32).cast("long")
    wide = v.sig.groupBy("frame").agg(F.greatest(one("view"), one("click")).alias("front"), F.shiftright(one("error") + one("purchase"), 1).alias("around"))
    peaks = wide.groupBy(block.alias("blk")).agg(F.greatest(F.max("front"), F.max("around")).alias("peak"))
    clipped = v.sig.groupBy("channel", block.alias("blk")).agg(F.count(F.when(F.abs("x") >= 8388607, 1)).alias("clipped"))
    return clipped.join(peaks, "blk").select("channel", "blk", "peak", "clipped")


def _unmixed(grids: dict, live: np.ndarray) -> dict:
    """Each frame states two of three sources by their residuals, in turn; the third is what the carrier leaves."""
    carrier, frame = grids["carrier"], grids["frame"]
    out = [np.zeros_like(carrier) for _ in range(3)]
    for k, m in enumerate(live):
        guess = [2 * x[k - 1, :m] - x[k - 2, :m] if k > 1 else x[0, :m] if k else np.zeros(m, np.int64) for x in out]
        derived = frame[k, :m] % 3
        stated = [guess[j] + np.where((derived + 1) % 3 == j, grids["r1"][k, :m], grids["r2"][k, :m]) for j in range(3)]
        total = sum(np.where(derived == j, 0, stated[j]) for j in range(3))
        for j in range(3):
            out[j][k, :m] = np.where(derived == j, carrier[k, :m] - total, stated[j])
    return {"a": out[0], "b": out[1], "c": out[2], "r1": grids["r1"], "r2": grids["r2"]}


@query(
    "mix3_unmix",
    """m as (select a.frame, a.frame // 833 as unit, a.x as a, b.x as b, c.x as c from sig a join sig b on a.frame = b.frame and b.channel = 'click' join sig c on a.frame = c.frame and c.channel = 'error' where a.channel = 'view'),
    p as (select *, row_number() over w as k, lag(a) over w as a1, lag(a, 2) over w as a2, lag(b) over w as b1, lag(b, 2) over w as b2, lag(c) over w as c1, lag(c, 2) over w as c2 from m window w as (partition by unit order by frame)),
    r as (select *, a - case k when 1 then 0 when 2 then a1 else 2 * a1 - a2 end as ra, b - case k when 1 then 0 when 2 then b1 else 2 * b1 - b2 end as rb, c - case k when 1 then 0 when 2 then c1 else 2 * c1 - c2 end as rc from p)
    select frame, a, b, c, a + b + c as carrier, case frame % 3 when 0 then rb when 1 then rc else ra end as r1, case frame % 3 when 2 then rb when 0 then rc else ra end as r2 from r""",
)
def _(v: Views):
    """Three sources in one carrier and two residuals a frame, taken apart again; units of 833 frames start anew."""
    all3 = mixing.side_by_side(v.sig, {"a": "view", "b": "click", "c": "error"}).dropna().withColumn("unit", F.floor(_c("frame") / 833).cast("long"))
    w = Window.partitionBy("unit").orderBy("frame")
    place = F.row_number().over(w)
    residual = lambda n: _c(n) - F.when(place > 2, 2 * F.lag(n, 1).over(w) - F.lag(n, 2).over(w)).when(place == 2, F.lag(n, 1).over(w)).otherwise(0)
    stated = all3.select("unit", "frame", (_c("a") + _c("b") + _c("c")).alias("carrier"), *[residual(n).alias(f"_{n}") for n in "abc"])
    turn = _c("frame") % 3
    pick = lambda k: F.when(turn == k, _c("_b")).when(turn == (k + 1) % 3, _c("_c")).otherwise(_c("_a"))
    coded = stated.select("unit", "frame", "carrier", pick(0).alias("r1"), pick(2).alias("r2"))
    done = recursions.decode_units(coded, ["unit"], "frame", {n: "long" for n in ("a", "b", "c", "r1", "r2")}, _unmixed)
    return done.select("frame", "a", "b", "c", "r1", "r2", (_c("a") + _c("b") + _c("c")).alias("carrier"))


def _low_sql(x: str, n: int) -> str:
    return f"reverse(lpad(bin({x}), {n}, '0'))"


def _rice_sql(x: str, k: int) -> str:
    return f"repeat('1', cast({x} >> {k} as int)) || '0' || {_low_sql(f'({x} & {(1 << k) - 1})', k)}"


def _mark_sql(x: str) -> str:
    return f"case {x} when 0 then '0' when 1 then '10' else '11' end"


def _bits_sql(at: str, n: str) -> str:
    return f"coalesce(list_sum(list_transform(range({n}), lambda i: case when substr(code, cast({at} + i + 1 as bigint), 1) = '1' then 1::bigint << i else 0 end)), 0)::bigint"


def _bits_high(at: str, n: str) -> str:
    return f"coalesce(list_sum(list_transform(range({n}), lambda i: case when substr(code, cast({at} + i + 1 as bigint), 1) = '1' then 1::bigint << ({n} - 1 - i) else 0 end)), 0)::bigint"


#: Heads of the five makes of units: runs and kinds.
_HEADS = ["11" + "01" + "1100" + "01" + "0100", "11" + "00" + "1" + "10100" + "00" + "1" + "01100", "0" + "01" + "0010", "0" + "10", "11" + "10" + "10"]

_BITSTREAM_SQL = f"""recursive u as (
      select channel, frame // 64 as unit, frame % 64 as pos, (frame // 64) % 5 as mode, frame, case when x & 3 = 0 then (case when x < 0 then -2 * floor(x / 262144.0) - 1 else 2 * floor(x / 262144.0) end)::bigint else 0 end as z from sig
    ), v as (select *, case mode when 3 then z % 3 when 4 then case when frame % 3 = 1 then 0 else 1 + z % 3 end else z end as v from u),
    w as (select *, pos - 1 - coalesce(max(case when v > 0 then pos end) over (partition by channel, unit order by pos rows between unbounded preceding and 1 preceding), -1) as zeros,
      count(*) over (partition by channel, unit) as n from v),
    coded as (select channel, unit, any_value(mode) as mode, any_value(n) as n, any_value([{", ".join(f"'{h}'" for h in _HEADS)}][mode + 1]) as head,
      coalesce(string_agg(case when mode = 0 and v > 0 then {_rice_sql("zeros", 2)} || {_rice_sql("(v - 1)", 3)} when mode = 1 and v > 0 then {_low_sql("zeros", 7)} || {_low_sql("(v - 1)", 6)}
        when mode = 2 then {_rice_sql("v", 4)} when mode = 3 then {_mark_sql("v")} when mode = 4 and v > 0 then {_mark_sql("zeros")} || {_mark_sql("(v - 1)")} end, '' order by pos), '') as body,
      any_value(n) - 1 - coalesce(max(case when v > 0 then pos end), -1) as tail from w group by channel, unit),
    units as (select channel, unit, mode, n, length(head) as head, head || body || case when tail = 0 then '' when mode = 0 then {_rice_sql("tail", 2)} when mode = 1 then {_low_sql("tail", 7)} when mode = 4 then {_mark_sql("tail")} else '' end as code from coded),
    placed as (select *, cast(coalesce(sum(length(code)) over (partition by channel, unit // 16 order by unit rows between unbounded preceding and 1 preceding), 0) as bigint) as start_bit from units),
    streams as (select channel, unit // 16 as stream, sha256(unbin(list_aggregate(list_transform(range(cast(ceil(length(s) / 8.0) as bigint)), lambda k: reverse(rpad(substr(s, k * 8 + 1, 8), 8, '0'))), 'string_agg', ''))) as stream_sha256
      from (select channel, unit, string_agg(code, '' order by unit) over (partition by channel, unit // 16) as s from units) group by channel, unit // 16, s),
    step as (
      select channel, unit, mode, n, code, head as spot, 0::bigint as idx, case when mode in (0, 1, 4) then 0 else 1 end as phase, null::bigint as place, null::bigint as value from units
      union all
      select channel, unit, mode, n, code, spot + len, case when phase = 0 then idx + num else idx + 1 end, case when phase = 0 or mode in (2, 3) then 1 else 0 end,
        case when phase = 1 then idx end, case when phase = 1 then num + (mode in (0, 1, 4))::bigint end
      from (select *, case kind when 0 then {_bits_sql("spot", "size")} when 1 then case when first = '0' then 0 else 1 + {_bits_sql("spot + 1", "1")} end else (ones << size) + {_bits_sql("spot + ones + 1", "size")} end as num,
          case kind when 0 then size when 1 then case when first = '0' then 1 else 2 end else ones + 1 + size end as len
        from (select *, substr(code, cast(spot + 1 as bigint), 1) as first, length(regexp_extract(substr(code, cast(spot + 1 as bigint)), '^1*'))::bigint as ones,
            case when phase = 0 then case mode when 0 then 2 when 1 then 0 else 1 end else case mode when 0 then 2 when 1 then 0 when 2 then 2 else 1 end end as kind,
            case when phase = 0 then case mode when 0 then 2 when 1 then 7 else 0 end else case mode when 0 then 3 when 1 then 6 when 2 then 4 else 0 end end as size
          from step where idx < n)) ),
    ends as (select channel, unit, max(spot) as last from step group by channel, unit),
    back as (select w.channel, w.unit, string_agg(coalesce(s.value, 0), ',' order by w.pos) as vals from w left join step s on s.channel = w.channel and s.unit = w.unit and s.place = w.pos group by w.channel, w.unit)
    select p.channel, p.unit, p.start_bit, cast(p.start_bit + e.last as bigint) as end_bit, true as ok, b.vals as "values", s.stream_sha256
    from placed p join ends e using (channel, unit) join back b using (channel, unit) join streams s on s.channel = p.channel and s.stream = p.unit // 16"""


@query("bitstream_decode", _BITSTREAM_SQL)
def _(v: Views):
    """Units of 64 values as bits of five makes, 16 of them packed in a stream, decoded side by side from their restart points."""
    y = F.floor(_c("x") / 262144)
    z = F.when(_c("x").bitwiseAND(F.lit(3)) == 0, F.when(y < 0, -2 * y - 1).otherwise(2 * y)).otherwise(F.lit(0).cast("long"))
    unit = F.floor(_c("frame") / 64).cast("long")
    sampled = v.sig.select("channel", "frame", unit.alias("unit"), (unit % 5).alias("mode"), z.alias("z"))
    made = F.when(_c("mode") == 3, _c("z") % 3).when(_c("mode") == 4, F.when(_c("frame") % 3 == 1, 0).otherwise(1 + _c("z") % 3)).otherwise(_c("z"))
    units = sampled.groupBy("channel", "unit", "mode").agg(F.transform(F.sort_array(F.collect_list(F.struct("frame", made.alias("v")))), lambda r: r["v"]).alias("vs"))
    makes = [(bitstream.RICE, 3, (bitstream.RICE, 2)), (bitstream.FIXED, 6, (bitstream.FIXED, 7)), (bitstream.RICE, 4, None), (bitstream.MARK, 0, None), (bitstream.MARK, 0, (bitstream.MARK, 0))]
    code = F.lit(None).cast("string")
    for mode, (kind, size, runs) in enumerate(makes):
        code = F.when(_c("mode") == mode, bitstream.unit_code(_c("vs"), kind, size, runs)).otherwise(code)
    coded = units.select("channel", F.floor(_c("unit") / 16).cast("long").alias("stream"), "unit", code.alias("code"), F.size("vs").alias("n"))
    rows = coded.groupBy("channel", "stream").agg(F.sort_array(F.collect_list(F.struct("unit", "code", "n"))).alias("us"))
    starts = F.transform("us", lambda u, k: F.struct(F.aggregate(F.slice("us", 1, k), F.lit(0).cast("long"), lambda s, e: s + F.length(e["code"])).alias("start"), u["n"].alias("count")))
    whole = rows.withColumn("bits", F.array_join(F.transform("us", lambda u: u["code"]), ""))
    streams = whole.select("channel", "stream", bitstream.packed(_c("bits")).alias("bytes"), starts.alias("index"))
    told = streams.withColumn("stream_sha256", F.sha2("bytes", 256))
    done = bitstream.decode(told, ["channel", "stream", "stream_sha256"], "bytes", "index")
    return done.select("channel", (_c("stream") * 16 + _c("unit")).alias("unit"), "start_bit", "end_bit", "ok", F.array_join("values", ",").alias("values"), "stream_sha256")


_OPCODES = [2, 3, 0x40, 0x66, 0x80, 0x5B, 0x41]  # by line number
_WIDTHS = [records.METADATA[op] for op in _OPCODES]


@query(
    "tagged_records",
    f"""recursive line as (select l_orderkey, l_linenumber, [{", ".join(map(str, _OPCODES))}][l_linenumber] as op, [{", ".join(str(w[0]) for w in _WIDTHS)}][l_linenumber] as w1, [{", ".join(str(w[1] if len(w) > 1 else 0) for w in _WIDTHS)}][l_linenumber] as w2,
      (l_partkey * 7919 + l_suppkey) as v from lineitem),
    coded as (select l_orderkey, '00000001' || string_agg(lpad(bin(op), 8, '0') || lpad(bin(v & ((1::bigint << w1) - 1)), w1, '0') || case when w2 > 0 then lpad(bin((v >> 3) & ((1::bigint << w2) - 1)), w2, '0') else '' end, '' order by l_linenumber, v & ((1::bigint << w1) - 1), (v >> 3) & ((1::bigint << w2) - 1)) || '00000000' as code from line group by 1),
    placed as (select l_orderkey, code, coalesce(sum(length(code)) over (partition by l_orderkey // 64 order by l_orderkey rows between unbounded preceding and 1 preceding), 0)::bigint as start_bit from coded),
    step as (select l_orderkey, code, 8::bigint as spot, 0 as k, null::bigint as op, null::bigint as v1, null::bigint as v2, false as over from coded
      union all select l_orderkey, code, spot + 8 + w1 + w2, k + 1, o, case when w1 > 0 then {_bits_high("spot + 8", "w1")} end, case when w2 > 0 then {_bits_high("spot + 8 + w1", "w2")} end, o = 0
      from (select *, case when o = 0 then 0 when o in (2, 4, 30, 31, 65, 71) or o between 80 and 88 or o = 64 then 8 when o in (1, 3) or o between 90 and 98 then 16 when o between 100 and 108 then 24 else 32 end as w1, case o when 64 then 8 else 0 end as w2
        from (select *, {_bits_high("spot", "8")} as o from step where not over))),
    back as (select l_orderkey, max(spot) as last, string_agg(op || ':' || v1 || coalesce(':' || v2, ''), ',' order by k) filter (where op > 0) as records from step group by 1)
    select p.l_orderkey, p.start_bit, (p.start_bit + b.last)::bigint as end_bit, true as ok, 1::bigint as tag, b.records, p.code from placed p join back b using (l_orderkey)""",
)
def _(v: Views):
    """An order's lines as a block of records, blocks of 64 order numbers in a stream, parsed side by side; bits and records both."""
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), _c("l_linenumber"))
    number = _c("l_partkey") * 7919 + _c("l_suppkey")
    low = lambda x, w: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), w) - 1)
    second = pick([w[1] if len(w) > 1 else 0 for w in _WIDTHS])
    r = F.struct(pick(_OPCODES).cast("long").alias("opcode"), low(number, pick([w[0] for w in _WIDTHS])).alias("value"), F.when(second > 0, low(F.shiftright(number, 3), second)).alias("second"))
    stream = fixed.trunc_div("l_orderkey", F.lit(64).cast("long"))
    # dealt by stream once: lines meet in orders, and orders in streams, where they are
    line = v.lineitem.filter("l_orderkey is not null").select(stream.alias("stream"), "l_orderkey", "l_linenumber", r.alias("r")).repartition("stream")
    blocks = line.groupBy("stream", "l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "r"))), lambda x: x["r"]).alias("rs"))
    coded = blocks.select("stream", "l_orderkey", records.block_code(F.lit(1).cast("long"), _c("rs")).alias("code"))
    start = F.coalesce(F.sum(F.length("code")).over(Window.partitionBy("stream").orderBy("l_orderkey").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    rows = coded.withColumn("start", start).groupBy("stream").agg(F.sort_array(F.collect_list(F.struct("l_orderkey", "start", "code"))).alias("bs"))
    streams = rows.withColumn("bits", F.array_join(F.transform("bs", lambda b: b["code"]), "")).select("stream", bitstream.packed(_c("bits")).alias("bytes"), "bs")
    done = records.parse(streams, ["stream"], "bytes", "bs", carried=["l_orderkey", "code"])
    told = F.array_join(F.transform("records", lambda r: F.concat_ws(":", r["opcode"], r["value"], r["second"])), ",")
    return done.select("l_orderkey", "start_bit", "end_bit", "ok", "tag", told.alias("records"), "code")


#: Reflection coefficients of five filters: silence, the last value, a line, a parabola, and one that rounds.
_FILTERS = [[], [1 << 23], [1 << 23, 1 << 24], [1 << 23, 0, 3 << 23], [6291457, -4194307]]


def _frame_sql() -> str:
    one = 1 << 23
    c = 6291457 - -((4194307 * 6291457) // one)  # the last filter's older coefficient: k0 less k1 * k0, toward zero
    guesses = ["0", "x1", "2 * x1 - x2", "3 * x1 - 3 * x2 + x3", f"({c} * x2 - 4194307 * x1) // {one}"]
    tried = ", ".join(f"x - ({g}) as r{n}" for n, g in enumerate(guesses))
    order = " ".join(f"when s.s{n} = least(s.s0, s.s1, s.s2, s.s3, s.s4) then {n}" for n in range(5))
    return f"""l as (select channel, frame, x, frame // 256 as unit, coalesce(lag(x, 1) over w, 0) as x1, coalesce(lag(x, 2) over w, 0) as x2, coalesce(lag(x, 3) over w, 0) as x3 from sig window w as (partition by channel, frame // 256 order by frame)),
    t as (select *, {tried} from l), s as (select channel, unit, {", ".join(f"sum(abs(r{n})) as s{n}" for n in range(5))} from t group by 1, 2),
    c as (select t.*, cast(case {order} end as bigint) as choice from t join s using (channel, unit))
    select channel, frame, choice, [r0, r1, r2, r3, r4][choice + 1]::bigint as residual, x from c"""


@query("prediction_frame", _frame_sql())
def _(v: Views):
    """Units of 256 samples, each coded by the one of five filters that leaves least, and restored with the filter that comes with it."""
    unit = F.floor(_c("frame") / 256).cast("long")
    samples = v.sig.filter("channel is not null").withColumn("unit", unit)
    window = Window.partitionBy("channel", "unit").orderBy("frame")
    frames = prediction.coded(samples, ["channel", "unit"], "frame", "x", _FILTERS, window)
    return prediction.restored(frames, ["channel", "unit"], "frame").drop("unit")
