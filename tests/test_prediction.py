"""Frames restored by filters of their own, against one loop a unit."""

import numpy as np
import pytest
from pyspark.sql import Window

from framewright.operators import prediction


def div(a):
    return -(-a >> 23) if a < 0 else a >> 23


def wrap(a):
    return (a + (1 << 31)) % (1 << 32) - (1 << 31)


def slow_filter(k):
    out = k[:1]
    for n in range(1, len(k)):
        out = [wrap(out[j] - div(k[n] * out[n - 1 - j])) for j in range(n)] + [k[n]]
    return out


def slow_restore(residual, taps, scale):
    x = []
    for r in residual:
        heard = ([0] * len(taps) + x)[len(x) :] if taps else []
        x.append(wrap(scale * r + div(sum(c * h for c, h in zip(taps, heard, strict=True)))))
    return x


def test_filters():
    draw = np.random.default_rng(1)
    order = draw.integers(0, 17, 200)
    k = draw.integers(-(1 << 23), 1 << 23, (200, 16))
    made = prediction.stepped_up(k, order)
    for n in range(200):
        want = slow_filter(k[n, : order[n]].tolist())
        assert made[n].tolist() == want + [0] * (16 - len(want))


@pytest.mark.parametrize("seed", range(3))
def test_units_of_their_own_orders(spark, seed):
    draw = np.random.default_rng(seed)
    rows, want = [], {}
    for unit in range(40):
        order, scale = int(draw.integers(0, 5)), int(draw.integers(1, 4))
        k = [int(v) for v in draw.integers(-(1 << 22), 1 << 22, order)]
        residual = [int(v) for v in draw.integers(-5000, 5000, int(draw.integers(1, 60)))]
        want[unit] = slow_restore(residual, slow_filter(k), scale)
        rows += [(unit, f, 0, r, scale, order, *k, *[0] * (4 - order)) for f, r in enumerate(residual)]
    df = spark.createDataFrame(rows, "unit int, frame long, choice long, residual long, scale long, order long, k0 long, k1 long, k2 long, k3 long").repartition(4)
    done = prediction.restored(df, ["unit"], "frame").orderBy("unit", "frame").collect()
    got = {}
    for r in done:
        got.setdefault(r["unit"], []).append(r["x"])
    assert got == want


def test_the_best_filter_is_chosen_and_undone(spark):
    """A ramp, a constant, noise and silence each take the filter that suits them, and come back."""
    draw = np.random.default_rng(5)
    signals = {"flat": [700] * 50, "ramp": [3 * f - 40 for f in range(50)], "bend": [f * f for f in range(50)], "none": [0] * 50, "noise": draw.integers(-(1 << 30), 1 << 30, 50).tolist()}
    rows = [(name, f, x) for name, xs in signals.items() for f, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "name string, frame long, x long").repartition(3)
    frames = prediction.coded(df, ["name"], "frame", "x", [[], [1 << 23], [1 << 23, 1 << 24], [1 << 23, 0, 3 << 23]], Window.partitionBy("name").orderBy("frame"))
    done = prediction.restored(frames, ["name"], "frame").collect()
    assert {(r["name"], r["frame"], r["x"]) for r in done} == set(rows)
    assert {r["name"]: r["choice"] for r in done} == {"flat": 1, "ramp": 2, "bend": 3, "none": 0, "noise": 0}
    assert sum(r["residual"] != 0 for r in done if r["name"] in ("flat", "ramp", "bend")) <= 7
