"""Whitening against a plain computation with numpy and whole numbers of any size."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.llm import whitening
from framewright.llm.queries import op13_whitening

INF, NAN = float("inf"), float("nan")


def brute(rows, keep=4):
    usable = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in usable})
    n = len(fit)
    sums = [sum(x[d] for x in fit) for d in range(len(fit[0]))]
    offsets = {x: [n * c - s for c, s in zip(x, sums, strict=True)] for x in fit}
    centred = np.array([[o / n for o in offsets[x]] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    out = []
    for i, x in usable:
        for c in range(min(keep, len(x))):
            e, u = values[-1 - c], vectors[:, -1 - c]
            out.append((i, c + 1, n, sum(o * o for o in offsets[tuple(x)]), np.array(offsets[tuple(x)]) / n @ u / math.sqrt(e), e / values.sum()))
    return out


def compare(done, want):
    ours = sorted(((r["vec_id"], r["component"], r["n"], r["deviation"] and int(r["deviation"]), r["explained"], r["whitened"]) for r in done), key=repr)
    theirs = sorted(((i, c, n, d if d < 10**38 else None, x, w) for i, c, n, d, w, x in want), key=repr)
    assert [r[:4] for r in ours] == [r[:4] for r in theirs]
    assert np.allclose([r[4] for r in ours], [r[4] for r in theirs], rtol=1e-9)
    for c in {r[1] for r in ours}:
        a, b = (np.array([r[5] for r in x if r[1] == c]) for x in (ours, theirs))
        sign = np.sign(a @ b)
        assert np.allclose(a, sign * b, atol=1e-8)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, component int, n long, _x string, v int, whitened int")


def test_given_table(spark, sf_dir):
    done = op13_whitening(spark, sf_dir).collect()
    given = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    compare(done, brute(given))
    assert max(r["identity_error"] for r in done) < 1e-9


def test_odd_vectors(spark):
    draw = np.random.default_rng(1)
    rows = [(k, draw.normal(size=6).astype(np.float32).tolist()) for k in range(300)]
    rows += [(7, rows[0][1])] * 40 + [(None, rows[1][1]), (400, [0.0, -0.0, 1e-30, -1e-30, 2.5, -2.5])]
    bad = [(500, None), (501, []), (502, [None, 1.0, 2.0, 3.0, 4.0, 5.0]), (503, [NAN] * 6), (504, [INF, 1.0, 2.0, 3.0, 4.0, 5.0]), (505, [-INF] * 6)]
    docs = frame(spark, [(*r, 1, 2, 3, "x", 4, 5) for r in rows + bad]).repartition(4)
    done = whitening.whiten(docs).collect()
    compare(done, brute([r for r in rows]))
    assert done[0]["n"] == 301


@pytest.mark.parametrize("factor", [1e6, 1e15])
def test_sums_beyond_64_bits(spark, factor):
    draw = np.random.default_rng(2)
    rows = [(k, (draw.normal(size=3) * factor).astype(np.float32).tolist()) for k in range(50)]
    done = whitening.whiten(frame(spark, [(*r, 1, 2, 3, "x", 4, 5) for r in rows])).collect()
    compare([r for r in done], brute(rows))


def test_fewer_directions_than_dimensions(spark):
    rows = [(k, [float(k), 2.0 * k, 5.0]) for k in range(20)]
    done = whitening.whiten(frame(spark, [(*r, 1, 2, 3, "x", 4, 5) for r in rows])).collect()
    assert len(done) == 60 and all((r["whitened"] is None) == (r["component"] > 1) for r in done)
    assert all(r["explained"] == pytest.approx(1.0 if r["component"] == 1 else 0.0) and r["identity_error"] < 1e-9 for r in done)
    one = whitening.whiten(frame(spark, [(1, [1.0, 2.0], 1, 2, 3, "x", 4, 5)] * 3)).collect()
    assert len(one) == 6 and all(r["n"] == 1 and r["deviation"] == 0 and r["whitened"] is None and r["explained"] == 0 for r in one)


def test_nothing_and_lengths(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None, 1, 2, 3, "x", 4, 5), (2, [], 1, 2, 3, "x", 4, 5)])).count() == 0
    with pytest.raises(ValueError, match="one length"):
        whitening.whiten(frame(spark, [(1, [1.0], 1, 2, 3, "x", 4, 5), (2, [1.0, 2.0], 1, 2, 3, "x", 4, 5)]))


def test_a_vector_that_a_third_of_the_rows_share(spark):
    draw = np.random.default_rng(3)
    own = [draw.normal(size=4).astype(np.float32).tolist() for _ in range(40)]
    rows = [(k, own[0] if k % 3 == 0 else own[k % 40]) for k in range(1200)]
    done = whitening.whiten(frame(spark, [(*r, 1, 2, 3, "x", 4, 5) for r in rows]).repartition(5)).collect()
    compare(done, brute(rows))


def test_gramian_in_parts(spark):
    x = np.random.default_rng(4).normal(size=(100, 5))
    rows = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").repartition(6)
    assert np.allclose(whitening.gramian(rows.select(F.col("v"))), x.T @ x)
