"""Carries in two levels against plain loops, null keys among them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import filters, ordered


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(1)
    keys = [None, "a", "b"]
    return [(k, int(o), None if draw.random() < 0.2 else int(draw.integers(-9, 9)), int(draw.integers(0, 5))) for k in keys for o in sorted(draw.choice(2000, 300 if k != "b" else 1, replace=False) - 700)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k string, o long, v long, u long").repartition(6)


@pytest.mark.parametrize(("block", "chain"), [(1, 2), (7, 3), (64, 1), (4096, 4096)])
@pytest.mark.parametrize("keyed", [True, False])
def test_carries(df, rows, monkeypatch, block, chain, keyed):
    monkeypatch.setattr(ordered, "CHAIN", chain)
    key = ["k"] if keyed else []
    if not keyed:
        df, rows = df.filter("k = 'a'"), [r for r in rows if r[0] == "a"]
    sums = ordered.running_sum(df, key, "o", F.col("v"), "s", block).collect()
    last = ordered.last_known(df, key, "o", {"l": F.col("v"), "m": F.when(F.col("u") == 3, F.col("o"))}, block).collect()
    assert len(sums) == len(last) == len(rows)
    for k in {r[0] for r in rows}:
        total, seen, mark, want = 0, None, None, []
        for _, o, v, u in sorted(r for r in rows if r[0] == k):
            total, seen, mark = total + (v or 0), seen if v is None else v, o if u == 3 else mark
            want.append((o, total, seen, mark))
        assert [(r["o"], r["s"]) for r in sorted(sums, key=lambda r: r["o"]) if r["k"] == k] == [w[:2] for w in want]
        assert [(r["o"], r["l"], r["m"]) for r in sorted(last, key=lambda r: r["o"]) if r["k"] == k] == [(o, s, m) for o, _, s, m in want]


@pytest.mark.parametrize("forward", [False, True])
def test_asof_without_a_key(df, monkeypatch, forward):
    monkeypatch.setattr(ordered, "CHAIN", 2)
    left, right = df.filter("k = 'a'").select("o", "u"), df.filter("k is null").select("o", "v")
    done = ordered.asof(left, right, "o", columns=["o", "v"], forward=forward, block=16).collect()
    own = sorted((r["o"], r["v"]) for r in right.collect())
    assert len(done) == 300
    for r in done:
        found = [x for x in own if (x[0] >= r["o"] if forward else x[0] <= r["o"])]
        assert (r["right_o"], r["right_v"]) == ((found[0] if forward else found[-1]) if found else (None, None))


def test_no_window_over_a_whole_key(df):
    """Rows meet only windows of a block, its chain or a key's chains."""
    plan = ordered.running_sum(df, ["k"], "o", F.col("v"), "s")._jdf.queryExecution().optimizedPlan().toString()
    assert "_chain" in plan and "_blk" in plan


@pytest.mark.parametrize(("block", "chain"), [(1, 2), (7, 3), (64, 1), (4096, 4096)])
@pytest.mark.parametrize("keyed", [True, False])
def test_restarted_sums(df, rows, monkeypatch, block, chain, keyed):
    """Two tracks with starts at different rows, some rows with both a start and a step, one track that hardly ever starts."""
    monkeypatch.setattr(ordered, "CHAIN", chain)
    if not keyed:
        df, rows = df.filter("k = 'a'"), [r for r in rows if r[0] == "a"]
    first, second = F.when(F.col("u") == 3, F.col("v")), F.when(F.col("o") % 97 == 0, 10 * F.col("o"))
    df = df.select("k", "o", first.alias("a"), "v", second.alias("b"), F.col("u").alias("w"))
    done = filters.absolute_delta(df, ["k"] if keyed else [], "o", [("a", "v", "x"), ("b", "w", "y")], block)
    assert done.columns == [*(["k"] if keyed else []), "o", "x", "y"]
    done = done.collect()
    assert len(done) == len(rows)
    for k in {r[0] for r in rows}:
        x, y, want = None, None, []
        for _, o, v, u in sorted(r for r in rows if r[0] == k):
            x = v if u == 3 and v is not None else x if x is None else x + (v or 0)
            y = 10 * o if o % 97 == 0 else y if y is None else y + u
            want.append((o, x, y))
        assert [tuple(r[-3:]) for r in sorted(done, key=lambda r: r["o"]) if not keyed or r["k"] == k] == want


def test_tracks_are_carried_together(spark, tmp_path):
    """The plan reads its input as often for three tracks as for one."""
    spark.range(64).selectExpr("id % 2 as k", "id as o", "id as a", "id as d").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    plan = lambda n: filters.absolute_delta(df, ["k"], "o", [("a", "d", f"v{i}") for i in range(n)])._jdf.queryExecution().optimizedPlan().toString()
    assert [plan(n).count("Relation [") for n in (1, 3)] == [3, 3]
