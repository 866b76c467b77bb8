"""Queries of long responses, reverberation, steering, and of routes and capacity."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.operators import capacity, convolve, mixing, recursions, reverb, routes
from framewright.plans.registry import query
from framewright.plans.views import Views

_c = F.col


@query(
    "fft_convolve",
    """t as (select k, (k * k + 3 * k) % 201 - 100 as long_tap, (5 * k * k + k) % 97 - 48 as short_tap from range(4096) r(k))
    select s.channel, s.frame, sum(t.long_tap * p.x)::bigint as long_y, coalesce(sum(t.short_tap * p.x) filter (where t.k < 100), 0)::bigint as short_y
    from sig s join sig p on p.channel = s.channel and p.frame between s.frame - 4095 and s.frame join t on t.k = s.frame - p.frame group by 1, 2""",
)
def _(v: Views):
    """A response of 4096 taps and one of 100 over the same transforms, exact in whole numbers."""
    taps = {"long_y": [(k * k + 3 * k) % 201 - 100 for k in range(4096)], "short_y": [(5 * k * k + k) % 97 - 48 for k in range(100)]}
    done = convolve.convolve(v.sig, ["channel"], "frame", "x", taps, size=1024)
    return done.select("channel", "frame", *[F.round(n).cast("long").alias(n) for n in taps])


@query(
    "centre_steer",
    """recursive w as materialized (select frame, max(x) filter (where channel = 'view')::double as l, max(x) filter (where channel = 'click')::double as r from sig where channel in ('view', 'click') group by frame having count(*) = 2),
    s as (select frame, l, r, 0.125::double * ((l + r) / 2) * ((l + r) / 2) as m, 0.125::double * ((l - r) / 2) * ((l - r) / 2) as d from w where frame = 0 and greatest(abs(l), abs(r)) > 6000000
      union all select frame, l, r, 0.03125::double * ((l + r) / 2) * ((l + r) / 2), 0.03125::double * ((l - r) / 2) * ((l - r) / 2) from w where frame = 0 and greatest(abs(l), abs(r)) <= 6000000
      union all select w.frame, w.l, w.r, k * s.m + (1 - k) * ((w.l + w.r) / 2) * ((w.l + w.r) / 2), k * s.d + (1 - k) * ((w.l - w.r) / 2) * ((w.l - w.r) / 2)
      from s join (select *, case when greatest(abs(l), abs(r)) > 6000000 then 0.875::double else 0.96875::double end as k from w) w on w.frame = s.frame + 1)
    select frame, round(case when m + d > 0 then (l + r) / 2 * m / (m + d) else 0 end, 2) as centre from s""",
)
def _(v: Views):
    """What two channels share, steered by their smoothed energies; how fast follows the level."""
    pair = mixing.side_by_side(v.sig, {"l": "view", "r": "click"}).dropna().withColumn("pair", F.lit("front"))
    done = recursions.scan(pair, "pair", "frame", ["l", "r"], recursions.steered_centre(0.875, 0.96875, 6_000_000), "centre")
    return done.select("frame", F.round("centre", 2).alias("centre"))


_DELAYS, _INTO, _OUT = [29, 37, 41, 53], [0.5, -0.5, 0.25, 0.125], [1.0, 0.5, -0.5, 0.25]
_NETWORK = reverb.Network(_DELAYS, reverb.hadamard(4, 0.5), _INTO, _OUT)


def _network_sql() -> str:
    heard = ", ".join(f"coalesce(u{i}[{d}], 0.0) as h{i}" for i, d in enumerate(_DELAYS))
    fed = lambda i: f"{_INTO[i]}::double * x + " + " + ".join(f"({m!r}::double) * h{j}" for j, m in enumerate(_NETWORK.matrix[i]))
    keep = ", ".join(f"list_slice(list_prepend({fed(i)}, u{i}), 1, {d}) as u{i}" for i, d in enumerate(_DELAYS))
    out = " + ".join(f"({o}::double) * h{i}" for i, o in enumerate(_OUT))
    none = ", ".join(f"cast([] as double[]) as u{i}" for i in range(4))
    return f"""recursive s as materialized (select channel, frame, x::double as x from sig),
    r as (select channel, -1::bigint as frame, {none}, 0.0::double as y from (select distinct channel from s)
      union all select channel, frame, {keep}, {out} from (select s.channel, s.frame, s.x, u0, u1, u2, u3, {heard} from r join s on s.channel = r.channel and s.frame = r.frame + 1))
    select channel, frame, round(y, 2) as y from r where frame >= 0"""


@query("late_reverb", _network_sql())
def _(v: Views):
    """Four delay lines fed back through an even mixing."""
    done = reverb.reverberate(v.sig, ["channel"], "frame", "x", _NETWORK)
    return done.select("channel", "frame", F.round("y", 2).alias("y"))


_LINES, _UNIT = 8, 256


@query(
    "mux_payload",
    f"""carrier as (select frame, frame // {_UNIT} as unit, frame % {_UNIT} as s, x, (x // 256 - (x < 0 and x % 256 <> 0)::int) * 256 as cleared from sig where channel = 'view'),
    plan as (select s, line, row_number() over (order by part, a, b) - 1 as place from (
      select s, line, 0 as part, line as a, s as b from range(16) t(s), range(3) l(line)
      union all select s, line, 1, s, -line from range(16) t(s), range(3, {_LINES}) l(line)
      union all select s, line, 2, s, -line from range(16, {_UNIT}) t(s), range({_LINES}) l(line) where not (s % 16 = 0 and line = 0))),
    slot as (select frame, cleared, line, row_number() over (order by unit, place) as rank from carrier join plan using (s) where abs(x) < 8000000),
    bit as (select x & 1 as bit, row_number() over (order by frame, part) as rank from (select frame, 0 as part, x from sig where channel = 'click' union all select frame, 1, x >> 1 from sig where channel = 'click')),
    met as (select frame, sum(bit << line)::bigint as own, count(*) as n from slot join bit using (rank) group by frame)
    select c.frame, case when m.n is null then c.x else c.cleared + m.own end as word, coalesce(m.n, 0)::bigint as n_bits from carrier c left join met m using (frame)""",
)
def _(v: Views):
    """Two bits of each sample of one channel, in the low bit lines of another's samples that are not near the rails."""
    carrier = v.sig.filter("channel = 'view'").select(F.lit("view").alias("stream"), "frame", "x")
    places = F.explode(capacity.slots(_c("frame") % _UNIT, _UNIT, _LINES)).alias("p")
    size = capacity.HEAD * _LINES + (_UNIT - capacity.HEAD) * _LINES - (_UNIT // capacity.HEAD - 1)
    slots = carrier.filter(F.abs("x") < 8_000_000).select("stream", "frame", places).select("stream", "frame", (F.floor(_c("frame") / _UNIT) * size + _c("p.place")).alias("at"), _c("p.line").alias("line"))
    two = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.shiftright("x", k).bitwiseAND(F.lit(1)).alias("bit")) for k in (0, 1)]))
    payload = v.sig.filter("channel = 'click'").select(F.lit("view").alias("stream"), "frame", two.alias("b")).select("stream", (_c("frame") * 2 + _c("b.k")).alias("at"), _c("b.bit").alias("bit"))
    met = capacity.fill(slots, payload, ["stream"], "at").groupBy("frame").agg(F.sum(_c("bit") * F.call_function("shiftleft", F.lit(1).cast("long"), _c("line"))).alias("own"), F.count(F.lit(1)).alias("n"))
    cleared = F.floor(_c("x") / 256) * 256
    done = carrier.join(met, "frame", "left")
    return done.select("frame", F.when(_c("n").isNull(), _c("x")).otherwise(cleared + _c("own")).alias("word"), F.coalesce("n", F.lit(0).cast("long")).alias("n_bits"))


#: Channels 1 to 7 folded towards 1: (source, destination, gain).
_FOLD = [(7, 5, 0.5), (7, 6, 0.5), (6, 4, 0.75), (6, 2, 0.25), (5, 4, 0.5), (5, 3, 0.5), (4, 2, 0.5), (4, 3, 0.5), (3, 1, 0.75), (2, 1, 0.75), (3, 2, 0.125)]


@query(
    "route_gains",
    f"""recursive layouts as (select distinct layout from (select l_orderkey, bit_or(1::bigint << l_linenumber) as layout from lineitem where l_returnflag <> 'N' group by 1)),
    rules(s, d, g) as (values {", ".join(f"({s}, {d}, {g}::double)" for s, d, g in _FOLD)}),
    way as (select a.layout as source, b.layout as target, c as src, c as dst, 1.0::double as gain, (b.layout >> c) & 1 = 1 as done from layouts a, layouts b, range(1, 8) t(c) where (a.layout >> c) & 1 = 1
      union all select source, target, src, r.d, gain * r.g, (target >> r.d) & 1 = 1 from way join rules r on r.s = way.dst where not done)
    select source, target, src, dst, sum(gain) as gain from way where done group by 1, 2, 3, 4""",
)
def _(v: Views):
    """The gain matrix of every pair of layouts; a layout is the set of line numbers of an order's returned or billed lines."""
    lines = v.lineitem.filter("l_returnflag <> 'N'").groupBy("l_orderkey").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), _c("l_linenumber"))).alias("layout"))
    layouts = lines.select("layout").distinct()  # at most one for each set of seven line numbers
    pairs = layouts.select(F.col("layout").alias("source"), F.lit(1).alias("_k")).join(layouts.select(F.col("layout").alias("target"), F.lit(1).alias("_k")), "_k").drop("_k")
    done = routes.closure(pairs, "source", "target", _FOLD)
    return done.select("source", "target", _c("src").cast("long").alias("src"), _c("dst").cast("long").alias("dst"), "gain")
