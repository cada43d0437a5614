"""Merges in rounds of joins, against the same passes one cluster after the other."""

import random

import pytest

from tidewell.operators import greedy, merging
from tidewell.operators.numbering import components, numbered
from tidewell.params import Params

CLUSTERS = "edition long, cluster_key long, cluster_title string, article_ids array<string>"
ARTICLES = "edition long, id string, title string, description string, content string, published_at long, ord long"
WORDS = ["Olympic", "gold", "swim", "market", "stock", "storm", "Election", "vote", "Iran", "talks", "summit", "leaders"]
NAMES = ["Port Avela", "Lake Morrin", "Selby Harbour", "Anna Tervo", "NATO", "Paris 2024"]


def drawn(seed, editions=24, most=16, few=6):
    """Clusters that overlap much, with like titles of different lengths, chains of them, equal titles, and titles without words."""
    rng, out, articles = random.Random(seed), {}, {}
    for e in range(editions):
        rows = [{"id": f"a{k}", "title": " ".join([rng.choice(NAMES), *rng.sample(WORDS, rng.randint(1, 4)), "with", rng.choice(NAMES)]), "description": "", "content": "", "published_at": k, "ord": k} for k in range(14)]
        articles[e] = rows
        words = rng.sample(WORDS, few)
        out[e] = []
        for _ in range(rng.randint(1, most)):
            title = " ".join(rng.sample(words, rng.randint(few - 3, few))) + rng.choice(["", "", "!", " of the", " !!!"]) if rng.random() > 0.1 else rng.choice(["", "of the"])
            ids = rng.sample([r["id"] for r in rows], rng.choice([1, 2, 2, 3, 4, 6, 9]))
            out[e].append((title if rng.random() > 0.3 else f"{rng.choice(NAMES)} and {rng.choice(NAMES)} {title}", ids + (["gone"] if rng.random() > 0.9 else [])))
    return out, articles


def frames(spark, clusters, articles):
    c = spark.createDataFrame([(e, 3 * k, t, ids) for e, own in clusters.items() for k, (t, ids) in enumerate(own)], CLUSTERS).repartition(5)
    a = spark.createDataFrame([(e, r["id"], r["title"], r["description"], r["content"], r["published_at"], r["ord"]) for e, rows in articles.items() for r in rows], ARTICLES).repartition(5)
    return c, a


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["edition"], r["cluster_key"])):
        out.setdefault(r["edition"], []).append((r["cluster_title"], r["article_ids"]))
        assert r["cluster_key"] == len(out[r["edition"]]) - 1
    return out


@pytest.mark.parametrize("jaccard", [0.2, 0.4, 0.6])
def test_by_overlap(spark, jaccard):
    clusters, articles = drawn(int(jaccard * 10))
    got = result(merging.merged_by_overlap(frames(spark, clusters, articles)[0], jaccard))
    assert got == {e: greedy.by_overlap(own, jaccard) for e, own in clusters.items()}
    assert any(len(got[e]) < len(clusters[e]) for e in got)


@pytest.mark.parametrize("threshold", [0.4, 0.7])
def test_by_title(spark, threshold):
    clusters, articles = drawn(int(threshold * 10))
    got = result(merging.merged_by_title(frames(spark, clusters, articles)[0], threshold))
    assert got == {e: greedy.by_title(own, threshold) for e, own in clusters.items()}
    assert any(len(got[e]) < len(clusters[e]) for e in got)


@pytest.mark.parametrize(("shared", "coherence", "sample"), [(1, 0.05, 20), (2, 0.2, 20), (1, 0.12, 3)])
def test_by_entity(spark, shared, coherence, sample):
    clusters, articles = drawn(7 + sample, editions=14)
    p = Params(cluster_entity_min_shared=shared, cluster_entity_min_coherence=coherence, similarity_sample=sample)
    got = result(merging.merged_by_entity(*frames(spark, clusters, articles), p))
    want = {e: greedy.by_entity(own, {r["id"]: r for r in articles[e]}, shared, p.cluster_entity_min_length, coherence, sample) for e, own in clusters.items()}
    assert got == want and any(len(got[e]) < len(clusters[e]) for e in got)


def test_a_third_of_the_clusters_have_one_title_and_one_article(spark):
    clusters = {0: [("Olympic gold swim" if k % 3 else f"{k} market storm", ["same"] if k % 3 else [f"x{k}"]) for k in range(300)]}
    c, _ = frames(spark, clusters, {})
    assert result(merging.merged_by_title(c))[0] == greedy.by_title(clusters[0], 0.7)
    assert result(merging.merged_by_overlap(c, 0.3))[0] == greedy.by_overlap(clusters[0], 0.3)


def test_nothing_to_merge(spark):
    none, articles = spark.createDataFrame([], CLUSTERS), spark.createDataFrame([], ARTICLES)
    assert result(merging.merged_by_overlap(none)) == result(merging.merged_by_title(none)) == result(merging.merged_by_entity(none, articles)) == {}
    one = spark.createDataFrame([(5, 9, None, []), (5, 11, "", ["a"])], CLUSTERS)
    for merged in (merging.merged_by_overlap(one), merging.merged_by_title(one), merging.merged_by_entity(one, articles)):
        assert result(merged) == {5: [("", []), ("", ["a"])]}


def test_numbers_and_components(spark):
    rows = [(k % 3 if k % 7 else None, (k * 37) % 200) for k in range(200)]
    got = numbered(spark.createDataFrame(rows, "s int, v int").repartition(9), ["s"], ["v"], "place").collect()
    for s in (None, 0, 1, 2):
        assert [r["place"] for r in sorted((r for r in got if r["s"] == s), key=lambda r: r["v"])] == list(range(sum(x == s for x, _ in rows)))
    edges = [(k, k + 1) for k in range(20)] + [(40, 30), (31, 40)]
    assert {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == {k: 0 for k in range(21)} | dict.fromkeys((30, 31, 40), 30)
