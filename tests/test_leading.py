"""Leader clustering by blocks against one article after the other."""

import random

import numpy as np
import pytest

from tidewell import catalogue
from tidewell.operators import greedy, leading
from tidewell.params import Params

WORDS = ["olympics", "gold", "swim", "market", "stock", "storm", "election", "vote", "iran", "talks"]
ARTICLES = "edition long, id string, title string, description string, content string, published_at long, ord long"


def by_edition(df, p, block):
    out = {}
    for r in sorted(leading.preclustered(df, p, block).collect(), key=lambda r: (r["edition"], r["cluster_key"])):
        own = out.setdefault(r["edition"], [])
        assert r["cluster_key"] == len(own)
        own.append((r["cluster_title"], list(r["article_ids"])))
    return out


def one_by_one(df, p):
    rows = {}
    for r in df.select("edition", *greedy.ARTICLE).collect():
        rows.setdefault(r["edition"], []).append(r.asDict())
    out = {e: greedy.lead(sorted(own, key=lambda r: r["ord"]), p.precluster_threshold, p.precluster_min_size, p.precluster_max_group) for e, own in rows.items()}
    return {e: own for e, own in out.items() if own}


@pytest.mark.parametrize(("block", "most", "threshold"), [(25, 3, 0.42), (40, 60, 0.42), (40, 60, 0.2), (2048, 60, 0.7)])
def test_as_one_after_the_other(spark, block, most, threshold):
    """Editions of several blocks: full stories, stories that go on growing, articles without text or time, many alike."""
    rng = random.Random(block + most)
    rows = [(e, f"{e}-{k}", " ".join(rng.choices(WORDS, k=rng.randint(0, 6))) or None, None, "", None if k % 13 == 0 else k // 2, k) for e, n in ((-3, 80), (4, 30), (9, 1)) for k in range(n)]
    rows += [(4, f"same-{k}", "storm vote market", "", None, 5, 100 + k) for k in range(30)]
    df = spark.createDataFrame(rows, ARTICLES)
    p = Params(precluster_max_group=most, precluster_min_size=1, precluster_threshold=threshold)
    assert by_edition(df, p, block) == one_by_one(df, p)


def test_blocks_of_the_given_articles(spark):
    df = catalogue.timed(catalogue.editions(spark, "/root/testdata/sf0.001")).cache()
    want = one_by_one(df, Params())
    assert any(want.values()) and by_edition(df, Params(), 70) == want


def test_odd_rows(spark):
    assert leading.preclustered(spark.createDataFrame([], ARTICLES)).collect() == []
    rows = [(0, "a", "gold swim", None, None, None, 0), (0, "a", "gold swim", None, None, None, 0), (0, None, None, None, None, None, 1), (0, "b", "", "", "", 3, 2)]
    got = leading.preclustered(spark.createDataFrame(rows, ARTICLES), Params(precluster_min_size=1), 2).orderBy("cluster_key").collect()
    assert [(r["cluster_title"], r["article_ids"]) for r in got] == [("", ["b"]), ("gold swim", ["a", "a"]), ("", [None])]


@pytest.mark.parametrize("rare", [1, 3, 64])
def test_inner_products(rare):
    rng = np.random.default_rng(2)
    x = rng.random((40, 30)) * (rng.random((40, 30)) < rng.random(30))
    at, term = np.nonzero(x)
    assert np.allclose(leading._gram(at, term, x[at, term], 40, 4, rare), x @ x.T)
