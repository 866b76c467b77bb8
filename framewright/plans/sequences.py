"""Queries of window and sequence operators: prefix sums, carries, filters, runs, fades."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.functions import fixed
from framewright.operators import filters, mixing, ordered
from framewright.operators.ordered import neighbours
from framewright.plans.registry import query
from framewright.plans.views import Views
from framewright.scratch import write_table

_c = F.col
_W = "over (partition by channel order by frame)"
_KEY = ["channel"]


@query("prefix_sum", f"s as (select channel, frame, cast(sum(x) {_W} as bigint) as t from sig) select channel, frame, ((t + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 as total from s")
def _(v: Views):
    return ordered.running_sum(v.sig, _KEY, "frame", _c("x"), "t").select("channel", "frame", fixed.wrap32("t").alias("total"))


_SUB_SQL = """sub as (select channel, frame, case when frame % 8 = 0 then x end as absolute, case when frame % 8 <> 0 and frame % 3 = 0 then x % 1000 end as delta from sig),
    seg as (select *, count(absolute) over (partition by channel order by frame) as g from sub)"""


def _sub(v: Views):
    absolute = F.when(_c("frame") % 8 == 0, _c("x"))
    delta = F.when((_c("frame") % 8 != 0) & (_c("frame") % 3 == 0), F.call_function("mod", _c("x"), F.lit(1000).cast("long")))
    return v.sig.select("channel", "frame", absolute.alias("absolute"), delta.alias("delta"))


@query(
    "absolute_delta_ffill",
    _SUB_SQL + " select channel, frame, cast(first_value(absolute) over (partition by channel, g order by frame) + coalesce(sum(delta) over (partition by channel, g order by frame), 0) as bigint) as value from seg",
)
def _(v: Views):
    return filters.absolute_delta(_sub(v), _KEY, "frame", [("absolute", "delta", "value")])


@query(
    "absolute_delta_ffill3",
    _SUB_SQL
    + """ select channel, frame, cast(first_value(absolute) over w + coalesce(sum(delta) over w, 0) as bigint) as px,
    cast(2 * first_value(absolute) over w + coalesce(sum(-delta) over w, 0) as bigint) as py, cast(-first_value(absolute) over w + coalesce(sum(3 * delta) over w, 0) as bigint) as pz
    from seg window w as (partition by channel, g order by frame)""",
)
def _(v: Views):
    sub = _sub(v).select("channel", "frame", *[e.alias(n) for n, e in (("ax", _c("absolute")), ("dx", _c("delta")), ("ay", 2 * _c("absolute")), ("dy", -_c("delta")), ("az", -_c("absolute")), ("dz", 3 * _c("delta")))])
    return filters.absolute_delta(sub, _KEY, "frame", [("ax", "dx", "px"), ("ay", "dy", "py"), ("az", "dz", "pz")])


@query("ffill", f"select channel, frame, last_value(case when frame % 5 = 2 then x end ignore nulls) {_W} as spread from sig")
def _(v: Views):
    return ordered.last_known(v.sig, _KEY, "frame", {"spread": F.when(_c("frame") % 5 == 2, _c("x"))}).select("channel", "frame", "spread")


@query(
    "run_length_islands",
    """r as (select channel, frame, frame - row_number() over (partition by channel order by frame) as g from sig where x % 2 <> 0)
    select channel, min(frame) as start, max(frame) as "end", count(*) as length from r group by channel, g having count(*) >= 4""",
)
def _(v: Views):
    return ordered.islands(v.sig, _KEY, "frame", _c("x") % 2 != 0, 4)


_TAPS = [3, -9, 21, -44, 85, -160, 320, 1024, 1024, 320, -160, 85, -44, 21, -9, 3]


@query("fir_lag_sum", "select channel, frame, (" + " + ".join(f"({t}) * coalesce(lag(x, {k}) {_W}, 0)" for k, t in enumerate(_TAPS)) + ") >> 11 as y from sig")
def _(v: Views):
    y = lambda w: F.shiftright(filters.fir_terms("x", _TAPS, w), 11)
    return neighbours(v.sig, _KEY, "frame", {"y": y}, before=15).select("channel", "frame", "y")


@query("lag_delay", f"select channel, frame, coalesce(lag(x, 23) {_W}, 0) as y from sig")
def _(v: Views):
    return neighbours(v.sig, _KEY, "frame", {"y": lambda w: F.lag("x", 23, 0).over(w)}, before=23).select("channel", "frame", "y")


@query(
    "interleave_2x",
    f"""l as (select channel, frame, x, x + ((coalesce(lag(x, 1) {_W}, 0) + coalesce(lead(x, 1) {_W}, 0)) >> 2) as odd from sig)
    select channel, 2 * frame + i as frame, case when i = 0 then x else odd end as y from l, range(0, 2) t(i)""",
)
def _(v: Views):
    odd = lambda w: _c("x") + F.shiftright(F.lag("x", 1, 0).over(w) + F.lead("x", 1, 0).over(w), 2)
    lifted = neighbours(v.sig, _KEY, "frame", {"odd": odd}, 1, 1)
    return lifted.select("channel", "frame", F.posexplode(F.array("x", "odd")).alias("i", "y")).select("channel", (2 * _c("frame") + _c("i")).alias("frame"), "y")


@query("bounded_lag", "b as (select channel, frame // 32 as blk, max(abs(x)) as peak from sig group by 1, 2) select channel, blk, coalesce(lag(peak, 3) over (partition by channel order by blk), 0) as y from b")
def _(v: Views):
    from framewright.operators.blocks import block_of

    peaks = v.sig.groupBy("channel", block_of().alias("blk")).agg(F.max(F.abs("x")).alias("peak"))
    return neighbours(peaks, _KEY, "blk", {"y": lambda w: F.lag("peak", 3, 0).over(w)}, before=3).select("channel", "blk", "y")


@query("multi_lag", f"select channel, frame, (coalesce(lag(x, 7) {_W}, 0) * 5 + coalesce(lag(x, 19) {_W}, 0) * -3 + coalesce(lag(x, 31) {_W}, 0)) // 8 as y from sig")
def _(v: Views):
    tap = lambda w, n: F.lag("x", n, 0).over(w)
    y = lambda w: fixed.trunc_div(tap(w, 7) * 5 + tap(w, 19) * -3 + tap(w, 31), F.lit(8).cast("long"))
    return neighbours(v.sig, _KEY, "frame", {"y": y}, before=31).select("channel", "frame", "y")


@query(
    "gain_ramp",
    """b as (select channel, frame // 32 as blk, max(abs(x)) as peak from sig group by 1, 2),
    a as (select s.channel, s.frame // 32 as blk, max(s.frame % 32) as "at" from sig s join b on s.channel = b.channel and s.frame // 32 = b.blk and abs(s.x) = b.peak group by 1, 2)
    select channel, blk, "at", peak, round(least(1.0, 6000000.0 / greatest(peak, 1)), 9) as target,
           round(coalesce(lag(least(1.0, 6000000.0 / greatest(peak, 1))) over (partition by channel order by blk), 1.0), 9) as start from a join b using (channel, blk)""",
)
def _(v: Views):
    """Per block the last place of its peak, and the gains its ramp goes between."""
    from framewright.operators.blocks import block_of

    place = F.struct(F.abs("x").alias("peak"), (_c("frame") % 32).alias("at"))
    top = v.sig.groupBy("channel", block_of().alias("blk")).agg(F.max(place).alias("m")).select("channel", "blk", "m.at", "m.peak")
    gain = F.least(F.lit(1.0), 6000000.0 / F.greatest(_c("peak"), F.lit(1)))
    ramp = neighbours(top.withColumn("target", gain), _KEY, "blk", {"start": lambda w: F.lag("target", 1, 1.0).over(w)}, before=1)
    return ramp.withColumn("target", F.round("target", 9)).withColumn("start", F.round("start", 9))


@query(
    "second_difference",
    f"select channel, frame, case when frame < 2 then x when frame % 2 = 0 then x - 2 * lag(x, 1) {_W} + lag(x, 2) {_W} else x - lag(x, 1) {_W} end as d from sig",
)
def _(v: Views):
    back = lambda w, n: F.lag("x", n).over(w)
    d = lambda w: F.when(_c("frame") < 2, _c("x")).when(_c("frame") % 2 == 0, _c("x") - 2 * back(w, 1) + back(w, 2)).otherwise(_c("x") - back(w, 1))
    return neighbours(v.sig, _KEY, "frame", {"d": d}, before=2).select("channel", "frame", "d")


@query(
    "pair_delta",
    """p as (select a.frame, case when a.frame % 2 = 1 then a.x else b.x end as x from sig a join sig b using (frame) where a.channel = 'view' and b.channel = 'click')
    select frame, case when lag(x) over w is null or lead(x) over w is null then 0 else x - (((lag(x) over w // 2) * 2 + (lead(x) over w // 2) * 2) >> 1) end as d from p window w as (order by frame)""",
)
def _(v: Views):
    mixed = mixing.side_by_side(v.sig, {"a": "view", "b": "click"}).dropna().select("frame", F.when(_c("frame") % 2 == 1, _c("a")).otherwise(_c("b")).alias("x"))
    even = lambda e: fixed.clear_low_bits(e, 1)

    def d(w):
        before, after = F.lag("x").over(w), F.lead("x").over(w)
        return F.when(before.isNull() | after.isNull(), 0).otherwise(_c("x") - F.shiftright(even(before) + even(after), 1))

    return neighbours(mixed, [], "frame", {"d": d}, 1, 1).select("frame", "d")


@query(
    "phase_delta",
    f"select channel, frame, case frame % 3 when 0 then x when 1 then x - (3 * coalesce(lag(x) {_W}, 0) + coalesce(lead(x) {_W}, 0)) // 4 else x - (coalesce(lag(x, 2) {_W}, 0) + 3 * coalesce(lead(x) {_W}, 0)) // 4 end as d from sig",
)
def _(v: Views):
    """Groups of three: the first as it is, the others less a weighted mean of the firsts around them."""

    def d(w):
        at = lambda n: F.lag("x", n, 0).over(w)
        ahead = F.lead("x", 1, 0).over(w)
        four = F.lit(4).cast("long")
        return F.when(_c("frame") % 3 == 0, _c("x")).when(_c("frame") % 3 == 1, _c("x") - fixed.trunc_div(3 * at(1) + ahead, four)).otherwise(_c("x") - fixed.trunc_div(at(2) + 3 * ahead, four))

    return neighbours(v.sig, _KEY, "frame", {"d": d}, 2, 1).select("channel", "frame", "d")


@query("linear_ramp", "select channel, frame, cast(trunc(x * least(1.0, frame / 480.0::double)) as bigint) as y from sig")
def _(v: Views):
    return v.sig.select("channel", "frame", (_c("x") * F.least(F.lit(1.0), _c("frame") / 480.0)).cast("long").alias("y"))


_POLY = [1, -4, 12, 30, 12, -4, 1, 0, 16]


@query(
    "polyphase_up",
    "p(phase, a, b, c) as (values (0, 1, 30, 1), (1, -4, 12, 0), (2, 12, -4, 16)) select channel, 3 * frame + phase as frame, a * x + b * coalesce(x1, 0) + c * coalesce(x2, 0) as y from "
    f"(select *, lag(x, 1) {_W} as x1, lag(x, 2) {_W} as x2 from sig), p",
)
def _(v: Views):
    return filters.upsample(v.sig, _KEY, "frame", "x", _POLY, 3)


_HALF = [1, 0, -5, 0, 20, 32, 20, 0, -5, 0, 1]


@query("decimate_2x", "f as (select channel, frame, (" + " + ".join(f"({t}) * coalesce(lag(x, {k}) {_W}, 0)" for k, t in enumerate(_HALF)) + ") // 64 as y from sig) select channel, frame // 2 as frame, y from f where frame % 2 = 0")
def _(v: Views):
    y = lambda w: fixed.trunc_div(filters.fir_terms("x", _HALF, w), F.lit(64).cast("long"))
    done = neighbours(v.sig, _KEY, "frame", {"y": y}, before=len(_HALF) - 1).filter("frame % 2 = 0")
    return done.select("channel", fixed.trunc_div("frame", F.lit(2).cast("long")).alias("frame"), "y")


_FAR = [(3, 5), (17, -2), (64, 7), (129, 1), (300, -4)]
_FAR_SQL = "tap(lag, gain) as (values " + ", ".join(f"({a}::bigint, {b}::bigint)" for a, b in _FAR) + ")"


@query("sparse_fir_join", _FAR_SQL + " select s.channel, s.frame, cast(coalesce(sum(p.x * t.gain), 0) as bigint) as y from sig s cross join tap t left join sig p on p.channel = s.channel and p.frame = s.frame - t.lag group by 1, 2")
def _(v: Views):
    """Taps far apart: every sample is sent to the places it is heard at, then added up; no long windows."""
    return filters.scatter(v.sig, _FAR)


@query("fir_convolve_join", "ir(lag, gain) as (values (0::bigint, 8::bigint), (1::bigint, 4::bigint), (2::bigint, 2::bigint), (3::bigint, 1::bigint)) select s.frame, cast(sum(p.x * t.gain) as bigint) as y from (select distinct frame from sig) s cross join ir t join sig p on p.frame = s.frame - t.lag group by 1")
def _(v: Views):
    """All channels through one impulse response, added; the tail beyond the last frame is cut."""
    own = v.sig.groupBy("frame").agg(F.sum("x").alias("x")).select(F.lit("all").alias("channel"), "frame", "x")
    return filters.scatter(own, [(0, 8), (1, 4), (2, 2), (3, 1)]).select("frame", "y")


@query(
    "interval_split",
    """b as (select channel, frame // 100 as blk, min(frame) as lo, max(frame) + 1 as hi from sig group by 1, 2), c as (select channel, blk, lo, hi, unnest([lo, (lo + hi) // 2 - (lo + hi) // 2 % 7, hi]) as edge from b),
    d as (select distinct channel, blk, edge from c where edge between lo and hi)
    select channel, blk, edge as start, lead(edge) over w as "end" from d window w as (partition by channel, blk order by edge) qualify lead(edge) over w is not null""",
)
def _(v: Views):
    """Each block cut at its frame boundary into segments that follow on each other."""
    span = v.sig.groupBy("channel", fixed.trunc_div("frame", F.lit(100).cast("long")).alias("blk")).agg(F.min("frame").alias("lo"), (F.max("frame") + 1).alias("hi"))
    mid = fixed.trunc_div(_c("lo") + _c("hi"), F.lit(2).cast("long"))
    edges = span.select("channel", "blk", F.array_sort(F.array_distinct(F.filter(F.array("lo", mid - mid % 7, "hi"), lambda e: e.between(_c("lo"), _c("hi"))))).alias("e"))
    pairs = F.arrays_zip(F.slice("e", 1, F.size("e") - 1).alias("start"), F.slice("e", 2, F.size("e") - 1).alias("end"))
    return edges.select("channel", "blk", F.explode(pairs).alias("s")).select("channel", "blk", "s.start", "s.end")


@query(
    "fill_if_silent",
    """m as (select channel, frame // 32 as blk, max(abs(x)) < 6000000 as silent from sig group by 1, 2), a as (select frame, cast(sum(x) as bigint) // count(*) as mean from sig group by 1)
    select s.channel, s.frame, case when m.silent then a.mean else s.x end as x from sig s join m on s.channel = m.channel and s.frame // 32 = m.blk join a using (frame)""",
)
def _(v: Views):
    """Blocks of a silent channel take the mean of all channels."""
    from framewright.operators.blocks import block_of

    sig, _ = write_table(v.sig, "numbered")  # read three times
    silent = sig.groupBy("channel", block_of().alias("blk")).agg((F.max(F.abs("x")) < 6000000).alias("silent"))
    mean = sig.groupBy("frame").agg(fixed.trunc_div(F.sum("x"), F.count(F.lit(1))).alias("mean"))
    joined = sig.withColumn("blk", block_of()).join(silent, ["channel", "blk"]).join(mean, "frame")
    return joined.select("channel", "frame", F.when(_c("silent"), _c("mean")).otherwise(_c("x")).alias("x"))


_FOLD = [("view", 501), ("click", 708), ("error", -250)]


@query("weighted_fold", "w(channel, g) as (values ('view', 501::bigint), ('click', 708::bigint), ('error', -250::bigint)) select frame, cast(sum(x * g) // 1000 as bigint) as y from sig join w using (channel) group by frame")
def _(v: Views):
    weight = F.try_element_at(F.create_map(*[F.lit(x) for pair in _FOLD for x in pair]), _c("channel")).cast("long")
    return v.sig.withColumn("g", weight).filter("g is not null").groupBy("frame").agg(fixed.trunc_div(F.sum(_c("x") * _c("g")), F.lit(1000).cast("long")).alias("y"))


@query("mirror_fold", "select event_id, case event_id % 4 when 0 then 2000 - v when 1 then -v when 2 then 2 * 500 - v else v end as px from (select event_id, cast(floor(value) as bigint) as v from events)")
def _(v: Views):
    """A source mirrored at one of the walls of a room."""
    at, wall = F.floor("value").cast("long"), _c("event_id") % 4
    return v.events.select("event_id", F.when(wall == 0, 2000 - at).when(wall == 1, -at).when(wall == 2, 1000 - at).otherwise(at).alias("px"))


@query(
    "center_extract",
    """p as (select a.frame, a.x as l, b.x as r from sig a join sig b using (frame) where a.channel = 'view' and b.channel = 'click'),
    e as (select frame // 32 as blk, sum((l + r) * (l + r))::bigint as mid, sum((l - r) * (l - r))::bigint as side from p group by 1),
    g as (select blk, cast(sum(mid) over w as double) as mid, cast(sum(side) over w as double) as side from e window w as (order by blk rows between 15 preceding and current row))
    select blk, round(case when mid + side > 0 then mid / (mid + side) else 0.5 end, 9) as ratio, mid > 2 * side as centered from g""",
)
def _(v: Views):
    pair = mixing.side_by_side(v.sig, {"l": "view", "r": "click"}).dropna()
    mid, side = _c("l") + _c("r"), _c("l") - _c("r")
    blk = fixed.trunc_div("frame", F.lit(32).cast("long"))
    energy = pair.groupBy(blk.alias("blk")).agg(F.sum(mid * mid).alias("mid"), F.sum(side * side).alias("side"))
    ring = lambda n: lambda w: F.sum(n).over(w.rowsBetween(-15, 0)).cast("double")
    sums = neighbours(energy, [], "blk", {"m": ring("mid"), "s": ring("side")}, before=15)
    ratio = F.when(_c("m") + _c("s") > 0, _c("m") / (_c("m") + _c("s"))).otherwise(0.5)
    return sums.select("blk", F.round(ratio, 9).alias("ratio"), (_c("m") > 2 * _c("s")).alias("centered"))


@query("pair_mix", "select a.frame, (a.x + b.x) // 2 + (case when c.x is null then 0 else c.x >> 8 end) as x from sig a join sig b on a.frame = b.frame and b.channel = 'click' left join sig c on c.frame = a.frame and c.channel = 'error' where a.channel = 'view'")
def _(v: Views):
    """Two sources and a small residual in one carrier."""
    both = mixing.side_by_side(v.sig, {"a": "view", "b": "click", "r": "error"}).dropna(subset=["a", "b"])
    return both.select("frame", (fixed.trunc_div(_c("a") + _c("b"), F.lit(2).cast("long")) + F.coalesce(F.shiftright("r", 8), F.lit(0).cast("long"))).alias("x"))


@query(
    "triple_mix",
    "select a.frame, case a.frame % 3 when 0 then a.x + (b.x + c.x) // 4 when 1 then b.x + (a.x + c.x) // 4 else c.x + (a.x + b.x) // 4 end as x from sig a join sig b on a.frame = b.frame and b.channel = 'click' join sig c on a.frame = c.frame and c.channel = 'error' where a.channel = 'view'",
)
def _(v: Views):
    three = mixing.side_by_side(v.sig, {"a": "view", "b": "click", "c": "error"}).dropna()
    four = F.lit(4).cast("long")
    phase = _c("frame") % 3
    x = F.when(phase == 0, _c("a") + fixed.trunc_div(_c("b") + _c("c"), four)).when(phase == 1, _c("b") + fixed.trunc_div(_c("a") + _c("c"), four)).otherwise(_c("c") + fixed.trunc_div(_c("a") + _c("b"), four))
    return three.select("frame", x.alias("x"))


@query(
    "sparse_to_dense",
    "o as (select l_orderkey, max(l_linenumber) as top from lineitem group by 1), d as (select l_orderkey, unnest(range(1, top + 1)) as pos from o), s as (select l_orderkey, l_linenumber as pos, sum(l_quantity) as q from lineitem where l_quantity > 25 group by 1, 2) select d.l_orderkey, d.pos, coalesce(s.q, 0.0) as q from d left join s using (l_orderkey, pos)",
)
def _(v: Views):
    """Places that carry nothing become zero."""
    places = v.lineitem.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("top")).select("l_orderkey", F.explode(F.sequence(F.lit(1), "top")).alias("pos"))
    marks = v.lineitem.filter("l_quantity > 25").groupBy("l_orderkey", _c("l_linenumber").alias("pos")).agg(F.sum("l_quantity").alias("q"))
    return places.join(marks, ["l_orderkey", "pos"], "left").select("l_orderkey", _c("pos").cast("long").alias("pos"), F.coalesce("q", F.lit(0.0)).alias("q"))


@query(
    "hierarchical_default",
    f"select channel, frame, case when frame % 16 = 3 then 100 + x % 10 when frame % 4 = 1 then x % 10 else coalesce(last_value(case when frame % 16 = 3 then 100 + x % 10 when frame % 4 = 1 then x % 10 end ignore nulls) {_W}, -1) end as value from sig",
)
def _(v: Views):
    """The group's value if present, else the object's; carried on; a default before the first."""
    last = F.call_function("mod", _c("x"), F.lit(10).cast("long"))
    present = F.when(_c("frame") % 16 == 3, 100 + last).when(_c("frame") % 4 == 1, last)
    return ordered.last_known(v.sig, _KEY, "frame", {"value": present}).select("channel", "frame", F.coalesce("value", F.lit(-1).cast("long")).alias("value"))


@query(
    "schema_ffill",
    "select user_id, ts, event_id, last_value(case when event_type = 'signup' then value end ignore nulls) over w as template, last_value(case when event_type in ('signup', 'view') then event_id end ignore nulls) over w as latest from events window w as (partition by user_id order by ts, event_id)",
)
def _(v: Views):
    """A full first unit, then deltas: every field keeps its last stated value; by blocks of a day."""
    day = 86_400_000_000
    template, latest = F.when(_c("event_type") == "signup", _c("value")), F.when(_c("event_type").isin("signup", "view"), _c("event_id"))
    timed = v.events.select("user_id", "ts", "event_id", "event_type", "value", F.unix_micros(_c("ts").cast("timestamp")).alias("us"))
    done = ordered.last_known(timed, ["user_id"], "us", {"template": template, "latest": latest}, day, tie="event_id")
    return done.select("user_id", "ts", "event_id", "template", "latest")
