"""Long responses, networks, steering, filling and routes against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import capacity, convolve, recursions, reverb, routes


def signal(spark, seed, spans):
    """Two keys of their own lengths, gaps and a null among them; rows shuffled."""
    draw = np.random.default_rng(seed)
    rows = [(key, int(f), float(draw.normal())) for key, first, n in spans for f in range(first, first + n) if f % 11]
    rows.append(("a", spans[0][1] + spans[0][2] + 5, None))
    return spark.createDataFrame(rows, "key string, f long, x double").repartition(5), rows


def dense(rows, key):
    own = {f: x or 0.0 for k, f, x in rows if k == key}
    first, last = min(own), max(own)
    return first, np.array([own.get(f, 0.0) for f in range(first, last + 1)])


@pytest.mark.parametrize("taps", [1, 15, 16, 17, 100])
def test_convolution(spark, taps):
    df, rows = signal(spark, taps, [("a", 3, 700), ("b", -900, 400), ("b", 5000, 50)])
    h, g = np.random.default_rng(1).normal(size=taps), [2.0]
    done = convolve.convolve(df, ["key"], "f", "x", {"y": h, "z": g}, size=16).collect()
    assert len(done) == len(rows)
    for key in "ab":
        first, x = dense(rows, key)
        want = np.convolve(x, h)
        own = [r for r in done if r["key"] == key]
        assert np.allclose([r["y"] for r in own], [want[r["f"] - first] for r in own], atol=1e-9)
        assert np.allclose([r["z"] for r in own], [2 * x[r["f"] - first] for r in own], atol=1e-9)


def test_a_long_response_to_a_millionth(spark):
    """4096 taps over 100,000 samples, against the direct sum."""
    draw = np.random.default_rng(2)
    x, h = draw.normal(size=100_000) * 8e6, draw.normal(size=4096)
    df = spark.createDataFrame([(0, k, float(v)) for k, v in enumerate(x)], "key int, f long, x double").repartition(4)
    done = convolve.convolve(df, ["key"], "f", "x", {"y": h}).orderBy("f").collect()
    want = np.convolve(x, h)[: len(x)]
    assert np.abs(np.array([r["y"] for r in done]) - want).max() <= 1e-6 * np.abs(want).max()


def slow_network(network, x):
    lines = [np.zeros(d) for d in network.delays]
    out = []
    for t, v in enumerate(x):
        heard = np.array([own[t % d] for own, d in zip(lines, network.delays, strict=True)])
        fed = np.array(network.into) * v + np.array(network.matrix) @ heard
        for own, d, f in zip(lines, network.delays, fed, strict=True):
            own[t % d] = f
        out.append(np.array(network.out) @ heard)
    return np.array(out)


@pytest.mark.parametrize("gain", [0.0, 0.5, 0.9])
def test_network(spark, gain):
    network = reverb.Network([3, 5, 8, 13], reverb.hadamard(4, gain), [1.0, -1.0, 0.5, 0.25], [1.0, 1.0, -1.0, 0.5])
    df, rows = signal(spark, 4, [("a", 2, 15_000), ("b", 100, 300)])
    done = reverb.reverberate(df, ["key"], "f", "x", network).collect()
    assert len(done) == len(rows)
    for key in "ab":
        first, x = dense(rows, key)
        want = slow_network(network, x)
        own = [r for r in done if r["key"] == key]
        assert np.abs(np.array([r["y"] for r in own]) - np.array([want[r["f"] - first] for r in own])).max() < 1e-12


def test_networks_that_do_not_decay():
    with pytest.raises(ValueError, match="does not decay"):
        _ = reverb.Network([3, 4], [[1.0, 0.0], [0.0, 0.5]], [1, 1], [1, 1]).memory
    with pytest.raises(ValueError, match="power of two"):
        reverb.hadamard(3, 0.5)


@pytest.mark.parametrize("block", [4, 64, 4096])
def test_steering_by_blocks_is_the_plain_loop(spark, monkeypatch, block):
    monkeypatch.setattr(recursions, "CHAIN", 3)
    draw = np.random.default_rng(5)
    x = draw.normal(size=(500, 2)) * np.where(np.arange(500) % 50 < 25, 1.0, 0.1)[:, None]
    x[:7] = 0
    df = spark.createDataFrame([("k", f, float(a), float(b)) for f, (a, b) in enumerate(x)], "key string, f long, l double, r double").repartition(3)
    done = recursions.scan(df, "key", "f", ["l", "r"], recursions.steered_centre(0.5, 0.9, 1.0), "c", block=block).orderBy("f").collect()
    energy, want = np.zeros(2), []
    for a, b in x:
        keep, mid, side = (0.5 if max(abs(a), abs(b)) > 1 else 0.9), (a + b) / 2, (a - b) / 2
        energy = keep * energy + (1 - keep) * np.array([mid * mid, side * side])
        want.append(mid * energy[0] / energy.sum() if energy.sum() else 0.0)
    assert np.allclose([r["c"] for r in done], want, atol=1e-12)


def test_affine_systems_with_matrices_from_the_data(spark, monkeypatch):
    monkeypatch.setattr(recursions, "CHAIN", 2)

    def step(x, s):
        turned = np.stack([np.cos(x[:, 0]) * s[:, 0] - np.sin(x[:, 0]) * s[:, 1] + x[:, 0], np.sin(x[:, 0]) * s[:, 0] + 0.5 * np.cos(x[:, 0]) * s[:, 1] - 1], axis=1)
        return turned[:, 0], turned

    x = np.random.default_rng(6).normal(size=200)
    df = spark.createDataFrame([("k", f, float(v), 0.0) for f, v in enumerate(x)], "key string, f long, x double, z double")
    done = recursions.scan(df, "key", "f", ["x", "z"], recursions.affine([1.0, 2.0], step), block=8).orderBy("f").collect()
    s, want = np.array([[1.0, 2.0]]), []
    for v in x:
        y, s = step(np.array([[v, 0.0]]), s)
        want.append(y[0])
    assert np.allclose([r["y"] for r in done], want, atol=1e-9)


@pytest.mark.parametrize(("unit", "lines"), [(16, 3), (40, 8), (256, 16), (49, 5)])
def test_slots_are_the_plan(spark, unit, lines):
    made = capacity.plan(unit, lines)
    assert sorted(p for own in made for p, _ in own) == list(range(sum(map(len, made))))
    done = spark.range(unit).select("id", capacity.slots(F.col("id"), unit, lines).alias("s")).orderBy("id").collect()
    assert [[(p["place"], p["line"]) for p in r["s"]] for r in done] == made
    with pytest.raises(ValueError, match="at least"):
        capacity.plan(15, 3)


def test_filling(spark):
    places = [(k, o, f"p{k}{o}") for k in "ab" for o in range(0, 9000, 3)]
    items = [("a", o * o, o) for o in range(2000)] + [("b", o, o) for o in range(4000)] + [("c", 1, 1)]
    done = capacity.fill(spark.createDataFrame(places, "k string, at long, p string").repartition(4), spark.createDataFrame(items, "k string, at long, item int").repartition(3), ["k"], "at").collect()
    assert len(done) == 2000 + 3000 and all(r["p"] == f"{r['k']}{r['item'] * 3}".join(["p", ""]) for r in done)


def test_routes(spark):
    rules = [(3, 2, 0.5), (3, 1, 0.25), (2, 1, 0.5)]
    pairs = spark.createDataFrame([(0b1110, 0b0010), (0b1000, 0b0100), (0b1010, 0b1000), (0, 2), (2, 0)], "a long, b long")
    got = {(r["a"], r["b"], r["src"], r["dst"]): r["gain"] for r in routes.closure(pairs, "a", "b", rules).collect()}
    assert got == {(14, 2, 1, 1): 1.0, (14, 2, 2, 1): 0.5, (14, 2, 3, 1): 0.5, (8, 4, 3, 2): 0.5, (10, 8, 3, 3): 1.0}
    with pytest.raises(ValueError, match="cycle"):
        routes.closure(pairs, "a", "b", [(1, 2, 1.0), (2, 1, 1.0)])
