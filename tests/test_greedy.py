"""The order-dependent passes against plain models, and their invariants."""

import math
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.operators import greedy, leading, merging
from tidewell.params import Params

WORDS = ["olympics", "gold", "swim", "market", "stock", "storm", "election", "vote", "iran", "talks"]
texts = st.lists(st.sampled_from(WORDS), min_size=0, max_size=6).map(" ".join)
corpora = st.lists(texts, min_size=1, max_size=14)
clusterings = st.lists(st.tuples(texts, st.lists(st.sampled_from("abcdefgh"), min_size=1, max_size=5, unique=True)), min_size=1, max_size=8)


def article(k, text):
    return {"id": f"a{k}", "title": text, "description": "", "content": "", "published_at": k // 2, "ord": k}


def plain_lead(rows, threshold, least, most):
    """Every centroid against every article, norms anew each time."""
    n, counts = len(rows), [Counter(greedy.tokens(r["title"])) for r in rows]
    df = Counter(t for c in counts for t in c)
    vec = {r["id"]: {t: (1 + math.log(k)) * math.log(1 + n / (1 + df[t])) for t, k in c.items()} for r, c in zip(rows, counts)}
    seeds = []
    for r in sorted(rows, key=lambda r: (-r["published_at"], r["ord"])):
        v, best, top = vec[r["id"]], None, 0.0
        for s in seeds:
            dot = sum(w * s["c"].get(t, 0) for t, w in v.items())
            sim = dot / ((math.sqrt(sum(w * w for w in v.values())) or 1) * (math.sqrt(sum(w * w for w in s["c"].values())) or 1))
            if sim > top + 1e-12:
                best, top = s, sim
        if best is None or top < threshold or len(best["ids"]) >= most:
            best = {"c": Counter(), "ids": [], "title": r["title"]}
            seeds.append(best)
        best["ids"].append(r["id"])
        for t, w in v.items():
            best["c"][t] += w
    return [(s["title"], s["ids"]) for s in seeds if len(s["ids"]) >= least]


@settings(max_examples=150, deadline=None)
@given(corpora, st.sampled_from([0.2, 0.42, 0.7]), st.integers(1, 3), st.integers(2, 5))
def test_leader_clustering(corpus, threshold, least, most):
    rows = [article(k, t) for k, t in enumerate(corpus)]
    assert greedy.lead(rows, threshold, least, most) == plain_lead(rows, threshold, least, most)


@settings(max_examples=150, deadline=None)
@given(clusterings)
def test_merges_lose_no_ids(clusters):
    ids = {i for _, own in clusters for i in own}
    for merged in (greedy.by_overlap(clusters, 0.4), greedy.by_title(clusters, 0.7)):
        assert {i for _, own in merged for i in own} == ids and len(merged) <= len(clusters)
        if all(len(own) == len(set(own)) for _, own in clusters):
            assert all(len(own) == len(set(own)) for _, own in merged)


@settings(max_examples=100, deadline=None)
@given(corpora)
def test_split_keeps_all_articles_or_gives_up(corpus):
    rows = [article(k, t) for k, t in enumerate(corpus)]
    parts = greedy.split(("t", [r["id"] for r in rows]), rows, 0.54, 2)
    assert not parts or sorted(i for _, own in parts for i in own) == sorted(r["id"] for r in rows)


def test_overlap_cases():
    assert greedy.by_overlap([("A", ["1", "2", "3"]), ("B", ["2", "3", "4"])], 0.45) == [("A", ["1", "2", "3", "4"])]
    assert len(greedy.by_overlap([("A", ["1", "2", "3"]), ("B", ["4", "5", "6"])], 0.5)) == 2
    assert greedy.by_overlap([("Short", ["1"]), ("A Much Longer Title Here", ["1"])], 0.5)[0][0] == "A Much Longer Title Here"


def test_title_cases():
    assert greedy.by_title([("Winter Olympics", ["1", "2"]), ("Winter Olympics", ["3", "4"])], 0.7) == [("Winter Olympics", ["1", "2", "3", "4"])]
    assert len(greedy.by_title([("Winter Olympics Medal Count", ["1"]), ("Winter Olympics Medal Count Update", ["2"])], 0.7)) == 1
    assert len(greedy.by_title([("Winter Olympics", ["1"]), ("Stock Market Crash Today", ["2"])], 0.7)) == 2
    assert len(greedy.by_title([("the of", ["1"]), ("the of", ["2"])], 0.7)) == 2


def test_entity_cases():
    rows = {f"a{k}": article(k, t) for k, t in enumerate(["Swimmer wins Olympic gold in Paris", "Paris Olympic swimming gold for Swimmer", "Apple unveils the iPhone", "Climate talks"])}
    swim = [("Swimmer takes Olympic gold", ["a0"]), ("New Olympic gold for Swimmer", ["a1"])]
    assert len(greedy.by_entity(swim, rows, 1, 3, 0.05)) == 1
    assert len(greedy.by_entity([("A deal by Apple and Samsung", ["a2"]), ("A talk of Apple and Samsung", ["a3"])], rows, 1, 3, 0.5)) == 2


def test_entities():
    found = greedy.entities
    assert "the_white_house" in found("The White House issued a statement today") and {"ukraine", "russia"} <= found("Talks between Ukraine and Russia continue today")
    assert "today" not in found("Today is a good day") and {"nato", "fbi", "un"} <= found("NATO and the FBI met at the UN headquarters")
    assert "paris_2024" in found("Athletes head to Paris 2024 for the Games") and not found("") and not found("all lower case here")


def test_editions_stay_apart(spark):
    rows = [(e, f"{e}-{k}", "storm vote market" if k % 2 else "olympics gold swim", "", "", k, k) for e in range(3) for k in range(6)]
    df = spark.createDataFrame(rows, "edition long, id string, title string, description string, content string, published_at long, ord long")
    out = leading.preclustered(df, Params()).collect()
    assert len(out) == 6 and all({i.split("-")[0] for i in r["article_ids"]} == {str(r["edition"])} for r in out)
    kept = merging.merged_by_title(leading.preclustered(df)).select(F.explode("article_ids").alias("i")).distinct().count()
    assert kept == 18


def test_long_seeds_are_chunked_in_order():
    rows = [article(k, "x") for k in range(80)]
    parts = greedy.chunked([("t", [f"a{k}" for k in range(79, -1, -1)]), ("u", ["a1", "a0"])], rows, Params())
    assert [len(i) for _, i in parts] == [35, 35, 26, 2] and parts[0][1][0] == "a0" and parts[1][1][0] == "a27" and parts[-1][1] == ["a1", "a0"]


def plain_absorb(clusters, near):
    """All pairs."""
    out, gone = [], set()
    for i, base in enumerate(clusters):
        if i in gone:
            continue
        for j in range(i + 1, len(clusters)):
            if j not in gone and near(i, j, base):
                base = (base[0] if len(base[0]) >= len(clusters[j][0]) else clusters[j][0], greedy.union(base[1], clusters[j][1]))
                gone.add(j)
        out.append(base)
    return out


@settings(max_examples=150, deadline=None)
@given(clusterings, st.sampled_from([0.2, 0.4, 0.7]))
def test_merges_by_lookup_are_those_of_all_pairs(clusters, threshold):
    own = [set(c[1]) for c in clusters]
    assert greedy.by_overlap(clusters, threshold) == plain_absorb(clusters, lambda i, j, base: sum(x in own[i] for x in clusters[j][1]) / (len(set(base[1]) | own[j]) or 1) >= threshold)
    words = lambda t: set(greedy.tokens(t))
    if len(clusters) > 1:
        assert greedy.by_title(clusters, threshold) == plain_absorb(clusters, lambda i, j, base: len(words(base[0]) & words(clusters[j][0])) / (len(words(base[0]) | words(clusters[j][0])) or 1) >= threshold)


def test_a_model_refines_seeds_and_what_they_leave():
    p = Params(cluster_seed_chunk=3, cluster_seed_overlap=1, cluster_uncovered_chunk=4)
    rows, calls = [article(k, f"t{k}") for k in range(12)], []
    ids = [r["id"] for r in rows]

    def refine(part):
        calls.append([r["id"] for r in part])
        if len(calls) == 2:
            raise ValueError("no answer")
        return [(f"call {len(calls)}", [r["id"] for r in part]), ("", ids[:2]), ("single", ids[:1])]

    out = greedy.asked([("a", ids[:2]), ("b", ids[2:4]), ("c", ids[4:9])], rows, p, refine)
    assert calls == [ids[:2], ids[2:4], ids[4:7], ids[6:9], ids[2:4] + ids[9:11], ids[11:]]
    assert out == [("call 1", ids[:2]), ("call 3", ids[4:7]), ("call 4", ids[6:9]), ("call 5", ids[2:4] + ids[9:11])]


def test_a_model_at_its_limit_leaves_the_seeds():
    rows = [article(k, f"t{k}") for k in range(8)]
    ids, left = [r["id"] for r in rows], [2]

    def refine(part):
        left[0] -= 1
        if left[0] < 0:
            raise greedy.Limited
        return [("told", [r["id"] for r in part])]

    seeds = [("a", ids[:2]), ("b", ids[2:4])]
    assert greedy.asked([*seeds, ("c", ids[4:6])], rows, Params(), refine) == [*seeds, ("c", ids[4:6])]
    left[0] = 2
    assert greedy.asked(seeds, rows, Params(), refine) == [("told", ids[:2]), ("told", ids[2:4])]


def test_groups_of_a_model():
    clusters = [("one", ["1"]), ("two", ["2"]), ("third one", ["3", "1"]), ("four", ["4"])]
    assert greedy.grouped(clusters, lambda c: [[2, 0, 9], [0, 1], [-1]]) == [("third one", ["1", "3"]), ("two", ["2"]), ("four", ["4"])]
    assert greedy.grouped(clusters, lambda c: 1 / 0) == clusters


def test_splitting_cluster_by_cluster(spark):
    """As split_all does one after the other; ids without an article stay only in clusters that don't fall apart."""
    rows = [{**article(k, " ".join(WORDS[(k % 3) * 3 : (k % 3) * 3 + 3])), "edition": 0} for k in range(12)]
    clusters = [("mixed", [r["id"] for r in rows]), ("like", ["a0", "a3", "a6"]), ("gone", ["x", "y"]), ("single", ["a1"]), ("none", [])]
    df = spark.createDataFrame([(0, 2 * k, t, i) for k, (t, i) in enumerate(clusters)], greedy.CLUSTERS)
    articles = spark.createDataFrame([tuple(r[c] for c in ["edition", *greedy.ARTICLE]) for r in rows], "edition long, id string, title string, description string, content string, published_at long, ord long")
    got = sorted(greedy.coherent(df, articles, Params()).collect(), key=lambda r: r["cluster_key"])
    assert [(r["cluster_title"], r["article_ids"]) for r in got] == greedy.split_all(clusters, rows, Params())


def test_chunks_of_long_seeds_in_spark(spark):
    rows = [article(k, "x") for k in range(80)]
    seeds = [("t", [f"a{k}" for k in range(79, -1, -1)]), ("u", ["a1", "a0"]), ("v", [f"a{k}" for k in range(28)] * 2)]
    df = spark.createDataFrame([(4, k, t, i) for k, (t, i) in enumerate(seeds)], greedy.CLUSTERS)
    articles = spark.createDataFrame([(4, r["id"], r["ord"]) for r in rows], "edition long, id string, ord long")
    got = sorted(merging.chunked(df, articles).collect(), key=lambda r: r["cluster_key"])
    assert [(r["cluster_title"], r["article_ids"]) for r in got] == greedy.chunked(seeds, rows, Params())
