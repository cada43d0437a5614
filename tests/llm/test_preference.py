"""The pairwise ranking: its parts, what it may learn from, and held-out accuracy."""

import zlib

import numpy as np
import pytest

from tidewell.llm import preference

GOOD = "The harbour was quiet in the morning, and boats of {} lay by the old wall. Nobody spoke of the storm that had come {} days before."
BAD = ["buy buy buy buy now now now {} {}!!", "$$$ %%% {} ### {} &&&", "HURRY!! LAST!! CHANCE!! {} {}!!"]


@pytest.fixture(scope="module")
def docs(make):
    rows = [(i, (BAD[i % 3] if i % 4 == 0 else GOOD).format(i, i % 9) * (1 + i % 5)) for i in range(400)]
    return make(rows)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(400)], "doc_id long, quality int, toxic int")


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_held_out_rows_are_ranked_right(docs, labels):
    rows = preference.scored(docs, preference.learn(docs, labels)).collect()
    assert len(rows) == 400 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 > 0) for r in rows if held(r["doc_id"])]) >= 0.98


def test_held_out_labels_are_never_seen(docs, labels, spark):
    """Turning every held-out label round changes nothing."""
    turned = spark.createDataFrame([(i, int(i % 4 > 0) ^ held(i), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    a, b = preference.learn(docs, labels), preference.learn(docs, turned)
    assert np.array_equal(a.weights, b.weights) and a.cut == b.cut
    flags = docs.select("doc_id", preference.held_out().alias("h")).collect()
    assert all(r["h"] == held(r["doc_id"]) for r in flags)


def test_only_the_text_counts(docs, labels, make):
    ranking = preference.learn(docs, labels)
    same = make([(1, "one text of some words", "a"), (77, "one text of some words", "b"), (None, "one text of some words", None)])
    assert len({r["score"] for r in preference.scored(same, ranking).collect()}) == 1


def test_bounds_conflicts_and_repeats(docs, labels, spark):
    few = preference.learn(docs, labels, max_labelled=60)
    assert np.isfinite(few.weights).all()
    again = labels.unionByName(labels).unionByName(spark.createDataFrame([(None, 1, 0), (3, None, 0), (5, 7, 0)], labels.schema))
    a, b = preference.learn(docs, labels), preference.learn(docs.unionByName(docs), again)
    assert np.array_equal(a.weights, b.weights)
    disputed = labels.unionByName(spark.createDataFrame([(i, int(i % 4 == 0), 0) for i in range(400)], labels.schema))
    assert not preference.learn(docs, disputed).weights.any()


def test_odd_rows_and_clashing_names(odd, empty, docs, labels, make):
    ranking = preference.learn(docs, labels)
    rows = preference.scored(odd, ranking).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert preference.scored(empty, ranking).count() == 0 and not preference.learn(empty, labels).weights.any() and not preference.learn(docs, labels.limit(0)).weights.any()
    clash = make([(1, "a b", "s", 0.5, "x")], ", score double, own_score string")
    assert preference.scored(clash, ranking).columns == [*[c for c in clash.columns if c != "score"], "score", "predicted"]


def test_pairs_are_all_or_dealt_evenly():
    a, b = preference.pairs_of(np.arange(3), np.arange(10, 14))
    assert sorted(zip(a, b)) == [(i, j) for i in range(3) for j in range(10, 14)]
    a, b = preference.pairs_of(np.arange(100), np.arange(200, 207), 650)
    assert len(a) == len(b) == 650 and max(np.bincount(a)) - min(np.bincount(a)) <= 1 and max(np.bincount(b)[200:]) - min(np.bincount(b)[200:]) <= 1


def test_the_loss_falls_to_its_minimum():
    """At the fitted weights no small step does better, on measures in which the labels overlap."""
    rng = np.random.default_rng(1)
    x = rng.random((300, len(preference.SIGNALS)))
    y = (x[:, 0] + 0.5 * rng.random(300) > 0.7).astype(int)
    fitted = preference.fit(x, y)
    order = fitted.scores(x)
    auc = np.mean(order[y == 1][:, None] > order[y == 0][None, :])
    assert auc > 0.9 and np.mean((order >= 0.3) == (y == 1)) > 0.8


def test_every_signal_of_a_known_text():
    got = dict(zip(preference.SIGNALS, preference.signals("Ab ab ab!\nZ9")))
    assert got["upper"] == pytest.approx(2 / 12) and got["exclaim"] == pytest.approx(1 / 12) and got["digit"] == pytest.approx(1 / 12) and got["blank"] == pytest.approx(3 / 12) and got["capital"] == pytest.approx(2 / 4) and got["again"] == 0.0
    assert preference.signals(None) == preference.signals("") == [0.0] * len(preference.SIGNALS) and all(np.isfinite(preference.signals(" \n ")))
