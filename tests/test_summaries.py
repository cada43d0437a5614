"""Summaries and severities from a model: what is asked, once, and what is kept."""

import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from tidewell.operators.greedy import Limited
from tidewell.params import Params
from tidewell.plans import summaries
from tidewell.sources.store import KeyValue

AS_OF = "2024-01-02 00:00:00"
ARTICLE = "id string, title string, description string, content string, url string, source_name string, published_at timestamp_ntz, ord long"


@pytest.fixture
def articles(spark):
    rows = [(f"a{k}", f"T{k}", f"d{k}", f"content {k}", f"u{k}", f"s{k}", k) for k in range(6)]
    df = spark.createDataFrame(rows, "id string, title string, description string, content string, url string, source_name string, ord long")
    return df.withColumn("published_at", F.timestamp_add("MINUTE", F.col("ord").cast("int"), F.lit("2024-01-01 20:00:00").cast("timestamp_ntz")))


@pytest.fixture
def stories(spark):
    rows = [(0, "One", ["a1", "a0"], 1, None), (0, "Two", ["a2", "a3"], 2, "A summary of its own."), (0, "Three", ["a4", "gone"], 3, "Summary not available"), (0, "Four", ["a5"], 4, None)]
    return spark.createDataFrame(rows, "edition int, cluster_title string, article_ids array<string>, rank long, summary string")


def model(folder, rule):
    """A model that notes each call as a file, as calls come from tasks."""

    def call(purpose, content):
        with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
            f.write(purpose)
        return rule(purpose, content)

    return call


def calls(folder):
    return sorted((folder / n).read_text() for n in os.listdir(folder))


def now():
    return F.lit(AS_OF).cast("timestamp")


def test_a_second_run_asks_for_nothing(spark, tmp_path, articles, stories):
    folder = tmp_path / "calls"
    folder.mkdir()
    store = KeyValue(spark, f"{tmp_path}/kv", ["x:"])
    call = model(folder, lambda purpose, content: f"  {purpose}: {content.count('Source: ')}  ")
    out = {r["key"]: (r["value"], r["reason"]) for r in summaries.generate(store, stories, articles, call, now(), most_stories=3, most_articles=2).collect()}
    assert out == {
        "Summary-v2-cluster-cluster-a0-a1": ("cluster: 2", None), "Summary-v2-cluster-cluster-a2-a3": ("A summary of its own.", None), "Summary-v2-cluster-cluster-a4-gone": ("cluster: 1", None),
        "Summary-v1-article-a5": ("article: 0", None), "Summary-v1-article-a4": ("article: 0", None),
    }
    assert calls(folder) == ["article", "article", "cluster", "cluster"]
    assert {r["key"]: r["value"] for r in store.get(now()).collect()} == {k: v for k, (v, _) in out.items()}
    assert summaries.generate(store, stories, articles, call, now(), most_stories=3, most_articles=2).collect() == [] and len(calls(folder)) == 4
    later = F.lit("2024-01-03 00:00:00").cast("timestamp")
    assert summaries.generate(store, stories, articles, call, later, most_stories=3, most_articles=2).count() == 5  # they have expired


def test_failures_are_left_for_the_next_run(spark, tmp_path, articles, stories):
    store = KeyValue(spark, f"{tmp_path}/kv", ["x:"])

    def failing(purpose, content):
        if "T0" in content:
            raise ValueError("no answer")
        return " Summary could not be generated. " if purpose == "article" else "fine"

    out = {r["key"]: (r["value"], r["reason"]) for r in summaries.generate(store, stories, articles, failing, now(), most_articles=1).collect()}
    assert out["Summary-v2-cluster-cluster-a0-a1"] == (None, "ValueError: no answer") and out["Summary-v1-article-a5"] == (None, "no summary")
    again = {r["key"] for r in summaries.generate(store, stories, articles, lambda *_: "now", now(), most_articles=1).collect()}
    assert again == {"Summary-v2-cluster-cluster-a0-a1", "Summary-v1-article-a5"}


def test_calls_and_limits(spark, tmp_path, articles, stories):
    folder = tmp_path / "calls"
    folder.mkdir()

    def limited(purpose, content):
        raise Limited

    wanted = summaries.requests(stories, articles, 4, 3)
    few = summaries.made(wanted, model(folder, lambda *_: "ok"), most_calls=2).collect()
    assert sorted(r["key"] for r in few if r["value"] == "ok") == ["Summary-v2-cluster-cluster-a0-a1", "Summary-v2-cluster-cluster-a4-gone"]
    assert [r["reason"] for r in few if not r["value"]] == [summaries.LATER] * 4 and len(calls(folder)) == 2
    stopped = summaries.made(wanted, model(folder, limited), callers=1).collect()
    assert sorted(r["reason"] or "" for r in stopped) == ["", *[summaries.LIMIT] * 6] and len(calls(folder)) == 3  # one call met it, none came after
    kept = {r["key"]: r["value"] for r in summaries.made(wanted, limited, Params(summary_fallback_on_limit=True)).collect()}
    assert kept["Summary-v2-cluster-cluster-a0-a1"] == "T1 • T0" and kept["Summary-v1-article-a3"] == "content 3"


def test_empty_inputs(spark, articles, stories):
    assert summaries.requests(stories.limit(0), articles.limit(0)).collect() == []
    assert summaries.made(summaries.requests(stories.limit(0), articles.limit(0)), lambda *_: "x").collect() == []


def test_short_summaries(spark):
    texts = ["One  sentence. Two.", "x" * 150, "y" * 50 + ".z" + "w" * 150, "no.end" + "v" * 200, "", None]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(summaries.short_summary(F.col("t"))).collect()]
    assert got == ["One sentence.", "x" * 140, "y" * 50 + ".", ("no.end" + "v" * 200)[:140], "", None]


def test_severities(spark, articles):
    clusters = spark.createDataFrame([(1, "War", ["a0", "a1"]), (2, "Odd", ["a2"]), (3, "Bad", ["a3"]), (4, "None", ["gone"])], "cluster_key long, cluster_title string, article_ids array<string>")

    def judge(purpose, content):
        asked = json.loads(content)
        assert purpose == "severity" and asked["size"] == (2 if asked["title"] == "War" else 1)
        if asked["title"] == "War":
            return 'Here: {"level": 5, "label": "War/Conflict", "reasons": ["a", "b", "c", "d", "e"]} so'
        if asked["title"] == "Odd":
            return '{"level": "high", "label": 7}'
        if asked["title"] == "Bad":
            raise OSError
        return json.dumps({"level": 2, "label": f"{len(asked['headlines'])} headlines"})

    got = {r["cluster_key"]: (r["level"], r["label"], r["reasons"]) for r in summaries.severities(clusters, articles, judge).collect()}
    assert got == {1: (5, "War/Conflict", ["a", "b", "c", "d"]), 2: (0, "Other", []), 3: (0, "Other", []), 4: (2, "0 headlines", [])}


def test_the_digest_of_a_category(spark):
    rows = [(k, f"Story {k} of the day", f"What story {k} is about.", "Other", [(f"a{k}{j}", f"Title {k}{j}") for j in range(3)]) for k in range(6)]
    stories = spark.createDataFrame(rows, "ord long, title string, summary string, label string, articles array<struct<id: string, title: string>>")
    none = spark.createDataFrame([], "key string, value string")
    plain = summaries.category_digest(stories, "World", none).collect()
    assert len(plain) == 1 and not plain[0]["hit"] and plain[0]["content"].count("Articles: ") == 4
    live = spark.createDataFrame([(plain[0]["key"], '{"lede": "All of it.", "takeaways": ["x", "y"]}')], "key string, value string")
    told = summaries.category_digest(stories, "World", live).first()
    assert (told["lede"], told["takeaways"], told["hit"]) == ("All of it.", ["x", "y"], True)
    assert summaries.category_digest(stories.limit(0), "World", none).collect() == []
