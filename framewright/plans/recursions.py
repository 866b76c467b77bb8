"""Queries of recursions: smoothing, filters, envelopes, gates, predictors, spectra."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from framewright.operators import mixing, recursions
from framewright.operators.ordered import neighbours
from framewright.plans.registry import query
from framewright.plans.views import Views

_c = F.col


def _recursive(first: str, step: str, state: str, out: str) -> str:
    """A recursion over usig in SQL; r is the row before, u the row at hand."""
    return f"""recursive u as materialized (select channel, frame, x from usig ), r as (
      select channel, frame, x, {first} from u where frame = 0
      union all select u.channel, u.frame, u.x, {step} from r join u on u.channel = r.channel and u.frame = r.frame + 1)
    select channel, frame, {out} from r"""


@query("ema", _recursive("0.25::double * x as y", "0.75::double * r.y + 0.25::double * u.x", "y", "round(y, 3) as y"))
def _(v: Views):
    return recursions.scan(v.usig, "channel", "frame", "x", recursions.smoothing(0.75)).select("channel", "frame", F.round("y", 3).alias("y"))


@query("envelope_follow", _recursive("abs(x)::double as y", "greatest(abs(u.x)::double, 0.875::double * r.y)", "y", "round(y, 3) as y"))
def _(v: Views):
    return recursions.scan(v.usig, "channel", "frame", "x", recursions.envelope(0.875)).select("channel", "frame", F.round("y", 3).alias("y"))


_B = recursions.low_pass(0.1)
_b0, _b1, _b2, _a1, _a2 = (f"({x!r}::double)" for x in _B)


@query(
    "biquad_lpf",
    _recursive(
        f"{_b0} * x as y, {_b1} * x - {_a1} * ({_b0} * x) as z1, {_b2} * x - {_a2} * ({_b0} * x) as z2",
        f"{_b0} * u.x + r.z1, {_b1} * u.x - {_a1} * ({_b0} * u.x + r.z1) + r.z2, {_b2} * u.x - {_a2} * ({_b0} * u.x + r.z1)",
        "y",
        "round(y, 2) as y",
    ),
)
def _(v: Views):
    return recursions.scan(v.usig, "channel", "frame", "x", recursions.biquad(*_B)).select("channel", "frame", F.round("y", 2).alias("y"))


@query(
    "gate_fsm",
    _recursive(
        "case when abs(x) > 4000000 then 4 else 0 end as level, 0 as was",
        "case when abs(u.x) > 4000000 then least(8, r.level + 4) else greatest(0, r.level - 1) end, r.level",
        "level",
        "level::bigint as level, case when level = 0 then 'closed' when level = 8 then 'open' when abs(x) > 4000000 then 'opening' else 'closing' end as state",
    ),
)
def _(v: Views):
    """Fast opening, slow closing."""
    done = recursions.scan(v.usig, "channel", "frame", "x", recursions.gate(4_000_000, 4, 1, 8), "level")
    state = F.when(_c("level") == 0, "closed").when(_c("level") == 8, "open").when(F.abs("x") > 4_000_000, "opening").otherwise("closing")
    return done.select("channel", "frame", _c("level").cast("long").alias("level"), state.alias("state"))


@query(
    "limit_gain",
    """recursive p as (select a.frame // 32 as blk, max(abs(a.x + b.x))::bigint as peak from sig a join sig b on a.frame = b.frame and b.channel = 'click' where a.channel = 'view' group by 1),
    r as (select blk, peak, least(1.0::double, least(1.0::double, 8000000.0::double / peak)) as gain from p where blk = 0
      union all select p.blk, p.peak, least(least(1.0::double, 8000000.0::double / p.peak), 0.75::double * r.gain + 0.25::double) from r join p on p.blk = r.blk + 1)
    select blk, peak, round(gain, 9) as gain from r""",
)
def _(v: Views):
    """The gain that keeps the sum of two sources below a ceiling, by block, with smooth release."""
    peaks = mixing.side_by_side(v.sig, {"a": "view", "b": "click"}).dropna().groupBy(F.floor(_c("frame") / 32).cast("long").alias("blk")).agg(F.max(F.abs(_c("a") + _c("b"))).alias("peak"))
    target = peaks.select(F.lit("sum").alias("pair"), "blk", "peak", F.least(F.lit(1.0), F.lit(8000000.0) / F.nullif(_c("peak"), F.lit(0).cast("long"))).alias("target"))
    gains = recursions.scan(target.drop("peak"), "pair", "blk", "target", recursions.released_gain(0.75), "gain")
    return peaks.join(gains.select("blk", "gain"), "blk").select("blk", "peak", F.round("gain", 9).alias("gain"))


_TAPS = [7, -5, 2]  # predictor in quarters


def _predicted(grids: dict, live: np.ndarray) -> dict:
    """Samples from residuals: each adds the prediction from the three samples before it; a unit's first row brings its own."""
    out = np.zeros_like(grids["residual"])
    past = [grids[f"back{k}"][0].copy() for k in (1, 2, 3)]
    for k, m in enumerate(live):
        guess = sum(t * p[:m] for t, p in zip(_TAPS, past, strict=True)) >> 2
        out[k, :m] = grids["residual"][k, :m] + guess
        past = [np.concatenate([out[k, :m], past[0][m:]]), past[0], past[1]]
    return {"residual": grids["residual"], "x": out}


@query(
    "lpc_predict",
    "select channel, frame, x - ((7 * coalesce(lag(x, 1) over w, 0) - 5 * coalesce(lag(x, 2) over w, 0) + 2 * coalesce(lag(x, 3) over w, 0)) >> 2) as residual, x from usig window w as (partition by channel order by frame)",
)
def _(v: Views):
    """Residuals of a linear predictor, and the samples that the decoder gets back from them; units of 4096 frames carry the three samples before them."""
    zero = F.lit(0).cast("long")
    guess = lambda w: sum((F.lit(t).cast("long") * F.lag("x", k + 1, 0).over(w) for k, t in enumerate(_TAPS)), zero)
    back = {f"back{k}": (lambda w, k=k: F.lag("x", k, 0).over(w)) for k in (1, 2, 3)}
    coded = neighbours(v.usig, ["channel"], "frame", {"_guess": guess, **back}, before=3).select("channel", "frame", (_c("x") - F.shiftright("_guess", 2)).alias("residual"), *back)
    coded = coded.withColumn("unit", F.floor(_c("frame") / 4096).cast("long"))
    return recursions.decode_units(coded, ["channel", "unit"], "frame", {"residual": "long", "x": "long"}, _predicted).drop("unit")


def _unmixed(grids: dict, live: np.ndarray) -> dict:
    """Even rows predict a, odd rows b, by twice the last value less the one before; the other is what the carrier leaves."""
    carrier, residual, frame = grids["carrier"], grids["residual"], grids["frame"]
    a, b = np.zeros_like(carrier), np.zeros_like(carrier)
    for k, m in enumerate(live):
        guess = [2 * x[k - 1, :m] - x[k - 2, :m] if k > 1 else 2 * x[0, :m] if k else np.zeros(m, np.int64) for x in (a, b)]
        even = frame[k, :m] % 2 == 0
        a[k, :m] = np.where(even, residual[k, :m] + guess[0], carrier[k, :m] - residual[k, :m] - guess[1])
        b[k, :m] = carrier[k, :m] - a[k, :m]
    return {"a": a, "b": b, "carrier": carrier, "complete": a + b == carrier, "residual": residual}


@query(
    "unmix_roundtrip",
    """m as (select a.frame, a.frame // 832 as unit, a.x as a, b.x as b from sig a join sig b on a.frame = b.frame and b.channel = 'click' where a.channel = 'view')
    select frame, a, b, a + b as carrier, true as complete, case when frame % 2 = 0 then a - 2 * lag(a, 1, 0) over w + lag(a, 2, 0) over w else b - 2 * lag(b, 1, 0) over w + lag(b, 2, 0) over w end as residual from m window w as (partition by unit order by frame)""",
)
def _(v: Views):
    """Two sources in one carrier and a residual, taken apart again; units of 832 frames start anew."""
    both = mixing.side_by_side(v.sig, {"a": "view", "b": "click"}).dropna().withColumn("unit", F.floor(_c("frame") / 832).cast("long"))
    from pyspark.sql import Window

    w = Window.partitionBy("unit").orderBy("frame")
    residual = lambda n: _c(n) - 2 * F.lag(n, 1, 0).over(w) + F.lag(n, 2, 0).over(w)
    coded = both.select("unit", "frame", (_c("a") + _c("b")).alias("carrier"), F.when(_c("frame") % 2 == 0, residual("a")).otherwise(residual("b")).alias("residual"))
    return recursions.decode_units(coded, ["unit"], "frame", {"a": "long", "b": "long", "carrier": "long", "complete": "boolean", "residual": "long"}, _unmixed).drop("unit")


@query(
    "fft_energy",
    """b as (select channel, frame // 32 as blk, frame % 32 as n, x from sig ), whole as (select channel, blk from b group by 1, 2 having count(*) = 32)
    select channel, blk, k::bigint as bin, round((power(sum(x * cos(2 * pi() * k * n / 32)), 2) + power(sum(x * sin(2 * pi() * k * n / 32)), 2)) / 70368744177664.0, 6) as energy
    from b join whole using (channel, blk), range(0, 17) t(k) group by 1, 2, 3""",
)
def _(v: Views):
    done = recursions.spectrum(v.sig, ["channel"], "frame", "x")
    return done.select("channel", "blk", _c("bin").cast("long").alias("bin"), F.round(_c("energy") / 70368744177664.0, 6).alias("energy"))


_COS, _SIN = math.cos(0.5), math.sin(0.5)
_MIXED = ["click", "error", "purchase", "view"]


@query(
    "butterfly_mix",
    f"""w as (select frame, max(x) filter (where channel = 'click') as a, max(x) filter (where channel = 'error') as b, max(x) filter (where channel = 'purchase') as c, max(x) filter (where channel = 'view') as d from sig group by frame),
    one as (select frame, {_COS!r}::double * a - {_SIN!r}::double * b as a, {_SIN!r}::double * a + {_COS!r}::double * b as b, {_COS!r}::double * c - {_SIN!r}::double * d as c, {_SIN!r}::double * c + {_COS!r}::double * d as d from w where a is not null and b is not null and c is not null and d is not null),
    two as (select frame, {_COS!r}::double * a - {_SIN!r}::double * c as a, {_COS!r}::double * b - {_SIN!r}::double * d as b, {_SIN!r}::double * a + {_COS!r}::double * c as c, {_SIN!r}::double * b + {_COS!r}::double * d as d from one)
    select frame, round(a, 3) as a, round(b, 3) as b, round(c, 3) as c, round(d, 3) as d from two""",
)
def _(v: Views):
    """Plane rotations in two levels, as in a Walsh-Hadamard transform; map-side combined pivot, then plain columns."""
    names = ["a", "b", "c", "d"]
    wide = v.sig.filter(_c("channel").isin(_MIXED)).groupBy("frame").agg(*[F.max(F.when(_c("channel") == ch, _c("x"))).alias(n) for n, ch in zip(names, _MIXED, strict=True)]).dropna()
    for pairs in ((("a", "b"), ("c", "d")), (("a", "c"), ("b", "d"))):
        turned = {}
        for p, q in pairs:
            turned |= {p: F.lit(_COS) * _c(p) - F.lit(_SIN) * _c(q), q: F.lit(_SIN) * _c(p) + F.lit(_COS) * _c(q)}
        wide = wide.select("frame", *[turned[n].alias(n) for n in names])
    return wide.select("frame", *[F.round(n, 3).alias(n) for n in names])
