"""The refresh entry: one run at a time, its states, and the edition that it stores."""

import pytest
from pyspark.sql import functions as F

from tidewell import refresh
from tidewell.sources.store import LOG, KeyValue, latest_snapshot

AS_OF = "2024-01-02 00:00:00"
TITLES = ["Storm Ciara floods Dublin harbour and closes schools", "Dublin harbour floods as Storm Ciara closes schools", "Parliament votes on the budget", "Storm Ciara floods Dublin harbour"]


@pytest.fixture
def store(spark, tmp_path):
    spark.createDataFrame([], LOG).write.parquet(f"{tmp_path}/store")
    return KeyValue(spark, f"{tmp_path}/store", ["main:"])


@pytest.fixture(scope="module")
def articles(spark):
    rows = [(f"a{k}", t, t, f"https://site{k}.example/{k}", "Politics", k) for k, t in enumerate(TITLES)]
    df = spark.createDataFrame(rows, "id string, title string, description string, url string, category string, ord long")
    at = F.timestamp_add("MINUTE", F.col("ord").cast("int"), F.lit("2024-01-01 20:00:00").cast("timestamp_ntz"))
    return df.select("*", F.lit("").alias("content"), F.lit("Site").alias("source_name"), F.lit("").alias("source_url"), at.alias("published_at"), F.lit("").alias("url_to_image"), F.lit(0).alias("image_width"), F.lit(0).alias("image_height"))


def state(store, key):
    rows = store.get(F.lit(AS_OF).cast("timestamp")).where(F.col("key") == key).collect()
    return rows[0]["value"] if rows else None


def test_a_run_stores_its_edition_and_states(spark, store, articles, tmp_path):
    assert refresh.Refresh(spark, store, AS_OF).run(articles, f"{tmp_path}/out", AS_OF)
    assert state(store, refresh.STATUS) == "complete:100" and not refresh.Refresh(spark, store, AS_OF).lock.taken()
    assert {"a0", "a1"} <= set(latest_snapshot(spark, f"{tmp_path}/out").first()["article_ids"])


def test_one_run_at_a_time_and_errors(spark, store, articles, tmp_path):
    first, second = refresh.Refresh(spark, store, AS_OF), refresh.Refresh(spark, store, AS_OF)
    assert first.lock.acquire() and not second.run(articles, f"{tmp_path}/out", AS_OF)
    first.lock.release()
    with pytest.raises(Exception):
        second.run(articles.drop("title"), f"{tmp_path}/out", AS_OF)
    assert state(store, refresh.STATUS) == "error:0" and not second.lock.taken()


def test_parallel_runs_make_one_edition(spark, store, articles, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    runs = [refresh.Refresh(spark, store, AS_OF) for _ in range(2)]
    with ThreadPoolExecutor(2) as pool:
        made = list(pool.map(lambda r: r.run(articles, f"{tmp_path}/out", AS_OF), runs))
    assert sorted(made) == [False, True]
    stories = latest_snapshot(spark, f"{tmp_path}/out").select("id").collect()
    assert len(stories) == len({r["id"] for r in stories})


def test_the_blocklist_reads_the_feeds_address(spark, store, articles, tmp_path):
    rows = articles.withColumn("feed", F.when(F.col("ord") < 2, "https://blocked.example/rss").otherwise("https://fine.example/rss"))
    assert refresh.Refresh(spark, store, AS_OF).run(rows, f"{tmp_path}/out", AS_OF, refresh.Params(feed_blocklist="blocked.example"), feed_url="feed")
    assert {i for r in latest_snapshot(spark, f"{tmp_path}/out").collect() for i in r["article_ids"]}.isdisjoint({"a0", "a1"})


def test_one_of_many_gets_the_lock(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from tidewell.sources.lock import Lock

    locks = [Lock(spark, f"{tmp_path}/lock", 600) for _ in range(12)]
    with ThreadPoolExecutor(12) as pool:
        got = list(pool.map(lambda k: k.acquire(), locks))
    assert sum(got) == 1
    owner = locks[got.index(True)]
    assert owner.holds() and owner.taken() and not Lock(spark, f"{tmp_path}/lock", 600).acquire()
    owner.release()
    later = Lock(spark, f"{tmp_path}/lock", 600)
    assert later.acquire() and later.generation == 2


def test_a_late_owner_is_overtaken(spark, tmp_path):
    import time

    from tidewell.sources.lock import Lock

    slow, next_one = Lock(spark, f"{tmp_path}/lock", 1), Lock(spark, f"{tmp_path}/lock", 1)
    assert slow.acquire() and not next_one.acquire()
    time.sleep(1.6)
    assert next_one.acquire() and not slow.holds() and next_one.holds()
    slow.release()
    assert next_one.taken()  # the late owner lets go of its own generation only


def test_a_model_writes_summaries_before_the_edition_is_stored(spark, store, articles, tmp_path):
    run = refresh.Refresh(spark, store, AS_OF)
    assert run.run(articles, f"{tmp_path}/out", AS_OF, model=refresh.Model(summarise=lambda purpose, content: f"a summary of {purpose}"))
    kept = {r["key"]: r["value"] for r in store.get(F.lit(AS_OF).cast("timestamp")).collect()}
    ids = latest_snapshot(spark, f"{tmp_path}/out").first()["article_ids"]
    assert kept["Summary-v2-cluster-cluster-" + "-".join(sorted(ids))] == "a summary of cluster" and kept["Summary-v1-article-a3"] == "a summary of article"
    assert {"stories:50", "summaries:90", "stored:95"} <= {r["value"] for r in store.log().collect()}
