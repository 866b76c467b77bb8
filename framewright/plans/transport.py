"""Queries of blocking, schedules, locks, sessions and timers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from framewright.operators import blocks_plan, recursions
from framewright.plans.registry import query
from framewright.plans.views import Views
from framewright.streaming import units

_c = F.col


@query(
    "reblock_tumbling",
    "select channel, frame // 1024 as unit, count(*) as n, min(frame // 832) as first_host, max(frame // 832) as last_host, cast(sum(x) as bigint) as total, count(*) = 1024 as whole from sig group by 1, 2",
)
def _(v: Views):
    """Host blocks of 832 frames dealt anew to units of 1024."""
    host = F.floor(_c("frame") / 832).cast("long")
    grouped = v.sig.groupBy("channel", F.floor(_c("frame") / 1024).cast("long").alias("unit"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.min(host).alias("first_host"), F.max(host).alias("last_host"), F.sum("x").alias("total"), (F.count(F.lit(1)) == 1024).alias("whole"))


@query(
    "block_schedule_join",
    """sizes as (select s from range(256, 1025, 16) t(s) where s <> 992 union all select 1000),
    sums as (select s as total, 1 as n, s as a, 0 as b from sizes union all select p.s + q.s, 2, p.s, q.s from sizes p join sizes q on q.s <= p.s),
    len as (select channel, max(frame) + 1 as l from sig group by 1), tails as (select channel, greatest(0, l // 1024 - 1) as nfull, l - 1024 * greatest(0, l // 1024 - 1) as tail from len),
    plan as (select t.channel, t.nfull, s.a, s.b from tails t join sums s on s.total >= t.tail qualify row_number() over (partition by t.channel order by s.total, s.n, s.a desc) = 1),
    placed as (select s.channel, s.frame, s.x, case when s.frame < 1024 * p.nfull then s.frame // 1024 when s.frame < 1024 * p.nfull + p.a then p.nfull else p.nfull + 1 end as block,
        case when s.frame < 1024 * p.nfull then 1024 when s.frame < 1024 * p.nfull + p.a then p.a else p.b end as size from sig s join plan p using (channel))
    select channel, block::bigint as block, size::bigint as size, count(*) as n, cast(sum(x) as bigint) as total from placed group by 1, 2, 3""",
)
def _(v: Views):
    return blocks_plan.scheduled(v.sig, "channel", "frame").groupBy("channel", "block", "size").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total"))


def _lock_step(x: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unlocked until a sync sample; then five frames, the last of which ends the packet. State k + 1 is place k."""
    at = s[:, 0] - 1
    new = np.where((at >= 0) & (at < 4), at + 1, np.where(x % 5 == 0, 0, -1))
    return new, (new + 1)[:, None]


@query(
    "fsm_lock",
    """recursive u as materialized (select channel, frame, x from usig ), r as (select channel, frame, case when x % 5 = 0 then 0 else -1 end as place from u where frame = 0
      union all select u.channel, u.frame, case when r.place between 0 and 3 then r.place + 1 when u.x % 5 = 0 then 0 else -1 end from r join u on u.channel = r.channel and u.frame = r.frame + 1)
    select channel, frame, place::bigint as place, case when place < 0 then 'unlocked' when place = 4 then 'done' else 'locked' end as state from r""",
)
def _(v: Views):
    """A machine of six states, run by blocks; the streaming form keeps one number per key."""
    done = recursions.scan(v.usig, "channel", "frame", "x", recursions.machine(6, 0, _lock_step), "place")
    state = F.when(_c("place") < 0, "unlocked").when(_c("place") == 4, "done").otherwise("locked")
    return done.select("channel", "frame", _c("place").cast("long").alias("place"), state.alias("state"))


@query(
    "session_timeout",
    """g as (select user_id, ts, case when ts < lag(ts) over w + interval 6 hour then 0 else 1 end as new from events window w as (partition by user_id order by ts, event_id)),
    s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows between unbounded preceding and current row) as k from g)
    select user_id, epoch_us(min(ts))::bigint as start_us, (epoch_us(max(ts)) + 21600000000)::bigint as end_us, count(*) as n from s group by user_id, k""",
)
def _(v: Views):
    """A stream's lock is dropped when nothing comes for six hours."""
    timed = v.events.select("user_id", _c("ts").cast("timestamp").alias("ts"))
    found = timed.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return found.select("user_id", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n")


_PERIODS = {"config": 500, "gain": 1, "loudness": 96, "name": 33, "position": 64}


@query(
    "periodic_emit",
    "recursive p(timer, period) as (values "
    + ", ".join(f"('{n}', {p})" for n, p in _PERIODS.items())
    + """), len as (select channel, max(frame) // 32 as top from sig group by 1),
    r as (select channel, timer, period, 0::bigint as unit, true as fired, (32 + period - 1)::bigint as due, top from len, p
      union all select channel, timer, period, unit + 1, due < 32 * (unit + 2), case when due < 32 * (unit + 2) then 32 * (unit + 2) + period - 1 else due end, top from r where unit < top)
    select channel, unit, timer from r where fired""",
)
def _(v: Views):
    units = v.sig.select("channel", F.floor(_c("frame") / 32).cast("long").alias("unit")).distinct()
    return blocks_plan.timers(units, _PERIODS, 32)


@query(
    "unit_encode",
    """u as (select channel, frame // 1024 as unit, min(frame) as start, count(*) as n, string_agg(lpad(lower(to_hex(x & 255)), 2, '0') || lpad(lower(to_hex((x >> 8) & 255)), 2, '0') || lpad(lower(to_hex((x >> 16) & 255)), 2, '0'), '' order by frame) as body from sig group by 1, 2)
    select channel, start, n, 1024 - n as padded, sha256(unhex(body || repeat('000000', cast(1024 - n as int)))) as payload_sha256 from u""",
)
def _(v: Views):
    """Units of 1024 samples as bytes, the last one of a channel padded; a test holds the stream's units against them."""
    done = units.units_of(v.sig, 1024)
    return done.select("channel", "start", "n", "padded", F.sha2("payload", 256).alias("payload_sha256"))
