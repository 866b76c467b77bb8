"""Queries of filter chains: equaliser, crossover, all-pass, wall filter, prediction coefficients."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from framewright.operators import recursions
from framewright.plans.registry import query
from framewright.plans.views import Views

_c = F.col


def _cascade_sql(sections) -> str:
    """Sections one behind another as a recursion over usig in SQL; y<k> is the output of the k-th."""

    def outputs(x: str, state) -> list[str]:
        out, sums = x, []
        for k, (b0, *_) in enumerate(sections):
            out = f"({b0!r}::double * {out} + {state(k, 1)})"
            sums.append(out)
        return sums

    def row(x: str, state) -> str:
        ys, parts = outputs(x, state), []
        for k, (_, b1, b2, a1, a2) in enumerate(sections):
            before = x if k == 0 else ys[k - 1]
            parts += [f"{b1!r}::double * {before} - {a1!r}::double * {ys[k]} + {state(k, 2)} as z{k}_1", f"{b2!r}::double * {before} - {a2!r}::double * {ys[k]} as z{k}_2"]
        return f"{ys[-1]} as y, " + ", ".join(parts)

    first, step = row("x", lambda k, n: "0::double"), row("u.x", lambda k, n: f"r.z{k}_{n}")
    return f"""recursive u as materialized (select channel, frame, x from usig ), r as (
      select channel, frame, x, {first} from u where frame = 0
      union all select u.channel, u.frame, u.x, {step} from r join u on u.channel = r.channel and u.frame = r.frame + 1)"""


_BANDS = [recursions.peaking(0.02, 4.0), recursions.peaking(0.1, -6.0, 0.8), recursions.peaking(0.3, 3.0, 1.4)]
_LOW = [recursions.low_pass(0.08)] * 2


@query("equalizer_cascade", _cascade_sql(_BANDS) + " select channel, frame, round(y, 2) as y from r")
def _(v: Views):
    """Three bands, one behind another, as one linear system run by blocks."""
    done = recursions.scan(v.usig, "channel", "frame", "x", recursions.cascade(_BANDS))
    return done.select("channel", "frame", F.round("y", 2).alias("y"))


@query("crossover_bands", _cascade_sql(_LOW) + " select channel, frame, round(y, 2) as low, round(x - y, 2) as high from r")
def _(v: Views):
    """A fourth-order low band, and what it leaves; the two add up to the signal."""
    done = recursions.scan(v.usig, "channel", "frame", "x", recursions.cascade(_LOW))
    return done.select("channel", "frame", F.round("y", 2).alias("low"), F.round(_c("x") - _c("y"), 2).alias("high"))


def _one_pole(keep: float) -> tuple[float, float, float, float, float]:
    return 1 - keep, 0.0, 0.0, -keep, 0.0


_WALL = [_one_pole(0.5), _one_pole(0.25), _one_pole(0.125)]


@query("wall_filter", _cascade_sql(_WALL) + " select channel, frame, round(y, 2) as y from r")
def _(v: Views):
    """What a wall takes from the high end: one-pole sections in a chain."""
    done = recursions.scan(v.usig, "channel", "frame", "x", recursions.cascade(_WALL))
    return done.select("channel", "frame", F.round("y", 2).alias("y"))


_DELAY, _GAIN = 5, 0.5


def _schroeder(delay: int, gain: float) -> recursions.Scan:
    """v[n] = x[n] + gain v[n - delay], y[n] = v[n - delay] - gain v[n]; the state is the last delay values of v, newest first."""
    a = np.eye(delay, k=-1)
    a[0, -1] = gain
    b, c = np.zeros(delay), np.zeros(delay)
    b[0], c[-1] = 1.0, 1 - gain * gain
    return recursions.linear(a, b, c, -gain)


@query(
    "allpass_diffuse",
    f"""recursive u as materialized (select channel, frame, x from usig ), r as (
      select channel, frame, x::double as v, {-_GAIN}::double * x as y from u where frame < {_DELAY}
      union all select u.channel, u.frame, u.x + {_GAIN}::double * r.v, r.v - {_GAIN}::double * (u.x + {_GAIN}::double * r.v) from r join u on u.channel = r.channel and u.frame = r.frame + {_DELAY})
    select channel, frame, round(y, 3) as y from r""",
)
def _(v: Views):
    """A Schroeder all-pass: echoes thicken, the level of every frequency stays."""
    done = recursions.scan(v.usig, "channel", "frame", "x", _schroeder(_DELAY, _GAIN))
    return done.select("channel", "frame", F.round("y", 3).alias("y"))


@query(
    "reflection_to_lpc",
    """recursive k as (select vec_id, list(v order by i) as ks from vec where i < 16 group by vec_id),
    r as (select vec_id, ks, 0 as n, []::bigint[] as lpc from k
      union all select vec_id, ks, n + 1, list_append(list_transform(range(1, n + 1), lambda j: lpc[j] - ((ks[n + 1] * lpc[n + 1 - j]) >> 10)), ks[n + 1]) from r where n < 16)
    select vec_id, array_to_string(lpc, ',') as lpc from r where n = 16""",
)
def _(v: Views):
    """The step-up recursion of order 16, in fixed point: a fold over a vector's own sixteen numbers."""
    ks = v.vec.filter("i < 16").groupBy("vec_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda r: r["v"]).alias("ks"))

    def step(lpc, k):
        turned = F.zip_with(lpc, F.reverse(lpc), lambda own, other: own - F.shiftright(k * other, 10))
        return F.concat(turned, F.array(k))

    lpc = F.aggregate("ks", F.array().cast("array<bigint>"), step)
    return ks.select("vec_id", F.array_join(lpc.cast("array<string>"), ",").alias("lpc"))
