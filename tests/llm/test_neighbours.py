import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>"


def exact(rows, q, k):
    own = [(i, np.array(v, dtype=np.float64)) for i, v in rows]
    query = dict(own)[q]
    return sorted(((-float(v @ query), i) for i, v in own if i != q))[:k]


@pytest.mark.parametrize("scale", [False, True])
def test_recall_and_scores(spark, monkeypatch, scale):
    monkeypatch.setattr(neighbours, "SHARD", 1500)
    monkeypatch.setattr(neighbours, "QUERIES", 40)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((4000, 24)) + 2 * rng.standard_normal((8, 24))[rng.integers(0, 8, 4000)]
    if not scale:
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, [float(np.float32(a)) for a in v]) for i, v in enumerate(x)]
    got = neighbours.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, 20, enough=1500).collect()
    found, total = 0, 0
    for q in range(0, 4000, 50):
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r[0] for r in own] == list(range(1, 21)) and q not in {r[1] for r in own}
        want = exact(rows, q, 20)
        found += len({r[1] for r in own} & {i for _, i in want})
        total += 20
        assert all(abs(s - float(np.array(rows[i][1]) @ np.array(rows[q][1]))) < 1e-9 for _, i, s in own)
        assert [(-s, i) for _, i, s in own] == sorted((-s, i) for _, i, s in own)
    assert found / total >= 0.9


def test_odd_vectors(spark):
    v = [1.0, 0.0]
    rows = [(0, v), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, v), (5, v), (6, [float("inf"), 0.0]), (7, [0.5, 0.5]), (8, [1.0]), (9, []), (20, [0.0, 2.0]), (None, v)]
    got = neighbours.nearest(spark.createDataFrame(rows, SCHEMA), F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False))).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 5), (0, 2, 5), (0, 3, 7), (0, 4, 20), (20, 1, 7), (20, 2, 0), (20, 3, 5), (20, 4, 5)]


def test_no_rows_and_no_queries(spark):
    assert neighbours.nearest(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0
    assert neighbours.nearest(spark.createDataFrame([(1, [1.0])], SCHEMA), F.lit(False)).count() == 0
    assert neighbours.nearest(spark.createDataFrame([(1, [1.0])], SCHEMA), F.lit(True)).count() == 0
