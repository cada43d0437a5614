"""Whitening against plain numpy on exact integers."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import whitening

ROWS = "vec_id long, embedding array<float>, label int"


def whole(v):
    """The contract's numbers of a vector, or None if it takes no part."""
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(64 * float(x)) + 1_000_000 for x in v]


def plain(rows, most=16):
    """{vec_id: (deviation, whitened by component)}, n and explained, from one matrix of exactly centred rows."""
    kept = [(i, x) for i, v in rows if (x := whole(v))]
    fit = sorted({tuple(x) for _, x in kept})
    n, d = len(fit), len(fit[0])
    sums = [sum(c) for c in zip(*fit)]
    c = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums)] for x in fit])  # exact before it is rounded once
    _, e, v = np.linalg.svd(c, full_matrices=False)
    e, v = e**2 / n, v.T
    assert e.sum() == pytest.approx(float(Fraction(sum((n * a - s) ** 2 for x in fit for a, s in zip(x, sums)), n**3)), rel=1e-12)
    mean = np.array([s / n for s in sums])
    out = {}
    for i, x in kept:
        y = (np.array(x) - mean) @ v[:, :most] / np.sqrt(e[:most])
        out.setdefault(i, []).append((sum((n * a - s) ** 2 for a, s in zip(x, sums)), y))
    return out, n, e[:most] / e.sum()


def compare(rows, got):
    """got: rows of the query. Equal up to a sign of each component, one for all rows."""
    want, n, explained = plain(rows)
    own = {}
    for r in got:
        own.setdefault(r["vec_id"], []).append(r)
    assert own.keys() == want.keys()
    k = len(explained)
    signs = {}
    for i, rs in own.items():
        assert len(rs) == k * len(want[i]) and all(r["n"] == n and r["identity_error"] <= 1e-4 for r in rs)
        for r in rs:
            c = r["component"]
            assert r["deviation"] in [dev for dev, _ in want[i]] and r["explained"] == pytest.approx(explained[c - 1], rel=1e-8)
            value = want[i][0][1][c - 1]
            if abs(value) > 1e-3:
                signs.setdefault(c, np.sign(value * r["whitened"]))
            assert r["whitened"] * signs.get(c, 1) == pytest.approx(value, rel=1e-5, abs=1e-5)


@pytest.fixture(scope="module")
def query(spark, tmp_path_factory):
    def run(rows):
        folder = str(tmp_path_factory.mktemp("vectors"))
        spark.createDataFrame([(i, v, 0) for i, v in rows], ROWS).repartition(7).write.parquet(f"{folder}/embeddings.parquet")
        return whitening.op11(spark, folder).collect()

    return run


def test_contract_on_repeats_ties_and_unfit_rows(query):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=5) * [9, 5, 3, 2, 0.2]).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)]  # a third of all rows is one vector: fitted once
    rows += [(5, rows[5][1]), (2000, None), (2001, [1.0, None, 1.0, 1.0, 1.0]), (2002, [math.nan] * 5), (2003, [math.inf, 1.0, 1.0, 1.0, 1.0])]
    compare(rows, query(rows))


def test_small_components_keep_their_precision(query):
    rng = np.random.default_rng(4)
    rows = [(i, [float(a), float(a + 1 / 64 * b), float(c)]) for i, (a, b, c) in enumerate(zip(rng.integers(-9000, 9000, 300), rng.integers(-2, 3, 300), rng.integers(-3, 4, 300)))]
    compare(rows, query(rows))


def test_no_variance_no_rows_and_clashing_names(spark, query):
    assert query([]) == [] and query([(1, None), (2, [])]) == []
    one = query([(1, [0.5, 0.25]), (2, [0.5, 0.25])])
    assert len(one) == 4 and all(r["n"] == 1 and r["deviation"] == 0 and r["whitened"] is None and r["explained"] is None for r in one)
    flat = query([(i, [float(i), 3.0]) for i in range(50)])
    assert {r["component"]: r["whitened"] is None for r in flat} == {1: False, 2: True} and max(r["identity_error"] for r in flat) < 1e-9
    df = spark.createDataFrame([(k, [float(k), float(k * k % 7)], "x", 1.0) for k in range(20)], "numbers long, embedding array<double>, result string, whitened double")
    out = whitening.whiten(df, whitening.learn(df))
    assert out.columns == ["numbers", "embedding", "result", "deviation", "whitened"] and out.count() == 20
    assert whitening.whiten(df.limit(0), whitening.learn(df)).count() == 0 and whitening.whiten(df, None).count() == 0


def test_other_lengths_and_large_entries_take_no_part(spark):
    df = spark.createDataFrame([(k, [float(k), float(k % 5)]) for k in range(30)] + [(90, [1.0]), (91, [1e300, 0.0])], "vec_id long, embedding array<double>")
    w = whitening.learn(df)
    assert w.n == 30 and {r["vec_id"] for r in whitening.whiten(df, w).collect()} == set(range(30))


def test_deviations_are_exact_or_null():
    w = whitening.Whitening(10**9, [10**15 + 7, 10**15], np.array([1.0, 1.0]), np.eye(2))
    small, large = np.array([[1_000_000, 1_000_001]]), np.array([[1_000_900, 1_000_000], [2_000_000_000, 0]])
    assert w.deviations(small) == [49 + 10**18] and w.deviations(large) == [None, None]


def test_factors_merge_level_by_level(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(900_000, 1_100_000, (900, 4))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>").repartition(70)
    sums = [int(s) for s in x.sum(axis=0)]
    r = whitening.last_factor(df, 4, 900, sums)
    c = x - x.mean(axis=0)
    assert np.allclose(r.T @ r, c.T @ c, rtol=1e-12) and df.select(F.spark_partition_id()).distinct().count() > whitening.FAN**2
