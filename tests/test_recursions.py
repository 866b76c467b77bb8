"""Blocked recursions against one loop, for any block size; schedules; unit decoders."""

import numpy as np
import pytest

from framewright.operators import blocks_plan, recursions

CASES = {
    "smoothing": recursions.smoothing(0.9),
    "biquad": recursions.biquad(*recursions.low_pass(0.05)),
    "envelope": recursions.envelope(0.97),
    "gate": recursions.gate(500, 3, 1, 8),
    "cascade": recursions.cascade([recursions.low_pass(0.05), recursions.all_pass(0.1), recursions.peaking(0.2, 6)]),
}


def one_loop(how, x):
    """A recursion over one row, sample by sample."""
    s, y = np.asarray(how.start, float)[None], []
    for v in x:
        out, s = how.step(np.array([v], float), s)
        y.append(out[0])
    return y


@pytest.mark.parametrize("name", sorted(CASES))
@pytest.mark.parametrize(("block", "chain"), [(1, 5), (7, 2), (4096, 4096)])
def test_scan_does_not_depend_on_blocks(spark, monkeypatch, name, block, chain):
    monkeypatch.setattr(recursions, "CHAIN", chain)
    monkeypatch.setattr(recursions, "CELLS", 100)
    draw = np.random.default_rng(4)
    rows = [(c, k, int(draw.integers(-1000, 1000)) if k % 9 else None) for c in ("a", "b", None) for k in range(60)]
    df = spark.createDataFrame(rows, "channel string, frame long, x long")
    how, got = CASES[name], {}
    for r in recursions.scan(df, "channel", "frame", "x", how, block=block).collect():
        got[r["channel"], r["frame"]] = r["y"]
    for c in ("a", "b", None):
        want = one_loop(how, [x or 0 for ch, _, x in rows if ch == c])
        np.testing.assert_allclose([got[c, k] for k in range(60)], want, rtol=1e-9, atol=1e-9)
    assert recursions.scan(df.limit(0), "channel", "frame", "x", how, block=block).count() == 0


def test_a_cascade_is_its_sections_one_behind_another():
    x = np.random.default_rng(2).normal(size=200)
    sections = [recursions.low_pass(0.1), recursions.peaking(0.3, -4), recursions.all_pass(0.2)]
    y = x
    for section in sections:
        y = one_loop(recursions.biquad(*section), y)
    np.testing.assert_allclose(one_loop(recursions.cascade(sections), x), y, atol=1e-9)


def test_released_gain(spark):
    x = np.random.default_rng(1).random(50)
    df = spark.createDataFrame([("p", k, float(v)) for k, v in enumerate(x)], "pair string, blk long, target double")
    got = [r["g"] for r in recursions.scan(df, "pair", "blk", "target", recursions.released_gain(0.8), "g", 6).orderBy("blk").collect()]
    want, g = [], 1.0
    for v in x:
        g = min(v, 0.8 * g + 0.2)
        want.append(g)
    np.testing.assert_allclose(got, want)


def test_tail_plans_cover_with_least_padding():
    plans = {}
    for tail, k, start, size in blocks_plan.tail_plans():
        plans.setdefault(tail, []).append((k, start, size))
    sums = sorted({*blocks_plan.SIZES, *(a + b for a in blocks_plan.SIZES for b in blocks_plan.SIZES)})
    for tail in range(1, 2048):
        total = sum(s for *_, s in plans[tail])
        assert total == next(s for s in sums if s >= tail)
