"""The online learner and the search over k against plain loops over all pairs."""

import numpy as np
import pytest

from framewright.operators import clusters


def brute_learn(points, limit):
    """Merge the cheapest pair, of equal ones the oldest, by looking at all pairs each time."""
    live, new = [], 0
    for n, s in points:
        live.append((new, n, s))
        new += 1
        while len(live) > limit:
            best = min((a[2] ** 2 / a[1] + b[2] ** 2 / b[1] - (a[2] + b[2]) ** 2 / (a[1] + b[1]), a[0], b[0], a, b) for k, a in enumerate(live) for b in live[k + 1 :])
            live = [x for x in live if x not in best[3:]] + [(new, best[3][1] + best[4][1], best[3][2] + best[4][2])]
            new += 1
    return [(n, s) for _, n, s in live]


@pytest.mark.parametrize("unit", [4096, 20])
def test_online(spark, unit):
    draw = np.random.default_rng(6)
    rows = [(c, k, int(draw.integers(-5000, 5000))) for c in ("a", "b", None) for k in range(int(draw.integers(3, 70)))]
    got = {}
    for r in clusters.online(spark.createDataFrame(rows, "channel string, frame long, x long"), "channel", "frame", "x", 5, unit).collect():
        got.setdefault(r["channel"], []).append((r["cluster"], r["n"], r["s"]))
    for c in ("a", "b", None):
        x = [v for ch, _, v in rows if ch == c]
        parts = [brute_learn([(1, v) for v in x[k : k + unit]], 5) for k in range(0, len(x), unit)]
        want = sorted(brute_learn([y for p in parts for y in p], 5) if len(parts) > 1 else parts[0], key=lambda y: -y[0])
        assert sorted(got[c]) == [(k, n, s) for k, (n, s) in enumerate(want)]


def test_units_merge_in_a_tree(spark, monkeypatch):
    """A task sees the clusters of three units at most, whatever a key's length."""
    monkeypatch.setattr(clusters, "TOGETHER", 3)
    draw = np.random.default_rng(7)
    rows = [(c, k, int(draw.integers(-5000, 5000))) for c, n in (("a", 100), ("b", 12), (None, 3)) for k in range(n)]
    got = {}
    for r in clusters.online(spark.createDataFrame(rows, "channel string, frame long, x long"), "channel", "frame", "x", 2, 5).collect():
        got.setdefault(r["channel"], []).append((r["cluster"], r["n"], r["s"]))
    for c in ("a", "b", None):
        x = [v for ch, _, v in rows if ch == c]
        parts, units = {k // 5: brute_learn([(1, v) for v in x[k : k + 5]], 2) for k in range(0, len(x), 5)}, 20
        while True:
            last = units <= 3
            groups = {}
            for k, found in sorted(parts.items()):
                groups.setdefault(0 if last else k // 3, []).append(found)
            parts = {k: brute_learn([y for p in g for y in p], 2) if len(g) > 1 else g[0] for k, g in groups.items()}
            if last:
                break
            units = -(-units // 3)
        assert sorted(got[c]) == [(k, n, s) for k, (n, s) in enumerate(sorted(parts[0], key=lambda y: -y[0]))]


def test_long_lists_are_refused(spark):
    many = spark.range(30).selectExpr("id", "id as label", "1L as n", "id as s")
    assert clusters.by_population(clusters.short(many, 30)).count() == 30
    with pytest.raises(ValueError, match="more than 29"):
        clusters.short(many, 29)


def test_search(spark):
    draw = np.random.default_rng(8)
    x = [int(v) for v in draw.choice([-4000, 10, 900, 5000, 20_000], 60) + draw.integers(-20, 20, 60)]
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate(x)], "channel string, frame long, x long")
    energy = sum(v * v for v in x)
    errors = {k: 1 - sum(s * s / n for n, s in brute_learn([(1, v) for v in x], k)) / energy for k in range(1, 61)}
    for most in (0.5, 0.01, 1e-6):
        (r,) = clusters.search(df, "channel", "frame", "x", most).collect()
        k = next(k for k in [4, 34, 60] if errors[k] <= most or k == 60)
        while k > 1 and errors[k] <= most and errors[k - 1] <= most:
            k -= 1
        assert (r["unit"], r["k"]) == (0, k) and abs(r["error"] - errors[k]) < 1e-8
