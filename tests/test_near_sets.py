"""Sets that are near each other, against all pairs."""

import random

import pytest

from tidewell.operators import stories


def brute(sets, least):
    out = {}
    for a in sets:
        for b in sets:
            if a < b and sets[a] | sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                out[a, b] = (len(sets[a] & sets[b]), round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 9))
    return out


def rows_of_joins(plan):
    """The most rows that a join of a plan has made, its query stages included."""
    most, todo = 0, [plan]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        todo += [node.children().apply(k) for k in range(node.children().size())]
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        if "QueryStage" in name:
            todo.append(node.plan())
        if "Join" in name and node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
    return most


@pytest.mark.parametrize("least", [0.3, 0.7, 1.0])
def test_near_sets_match_all_pairs(spark, monkeypatch, least):
    """Equal sets in groups of more than one chunk, near ones and others; of repeated rows one counts."""
    monkeypatch.setattr(stories, "CHUNK", 7)
    rng = random.Random(3)
    kinds = [frozenset(rng.sample(range(25), rng.randint(1, 9))) for _ in range(20)]
    kinds += [k ^ {rng.randrange(25)} for k in kinds]
    sets = {i: k for i, k in enumerate(rng.choice(kinds[: 4 if i % 3 else 40]) for i in range(150)) if k}
    rows = [(i, v) for i, k in sets.items() for v in k]
    df = spark.createDataFrame(rows + rows[:40], "cluster_key long, tok long")
    got = stories.near_sets(df, "tok", least).collect()
    assert {(r["a"], r["b"]): (r["shared"], round(r["jaccard"], 9)) for r in got} == brute(sets, least) and len(got) == len(brute(sets, least)) > 100


def test_joins_of_equal_sets_make_no_row_for_each_pair(spark):
    rows = [(i, f"w{k}") for i in range(300) for k in range(8)]
    found = stories.near_sets(spark.createDataFrame(rows, "cluster_key long, tok string"), "tok", 0.7)
    assert len(found.collect()) == 300 * 299 // 2
    assert rows_of_joins(found._jdf.queryExecution().executedPlan()) <= 300
