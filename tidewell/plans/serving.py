"""What is answered from stored results: the page, its topics, summaries and the store's entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import digest
from ..functions.text import headlines
from ..functions.times import millis
from ..functions.topics import keyword_score
from ..operators import stories, topics

MODES = ["request-generate", "background", "manual"]


def page_answer(rows: DataFrame, saved_at: Column, refreshing: Column, mode: Column, as_of: Column) -> DataFrame:
    """rows with status, from_cache, age_minutes, retry_after: the stored page with its age; without one 503, soon to be asked again if it is being made, or
    made on request if the mode says so."""
    have = saved_at.isNotNull()
    status = F.when(have | (~refreshing & (mode == "request-generate")), 200).otherwise(503)
    age = F.floor((millis(as_of) - millis(saved_at)) / 60_000).cast("long")
    return rows.withColumns({"status": status, "from_cache": have, "age_minutes": age, "retry_after": F.when(have, None).when(refreshing, 10).when(mode != "request-generate", 60)})


def topic_page(members: DataFrame, alias: DataFrame, topic: str | None, order: str = "pos") -> DataFrame:
    """(cluster_key, keyword_score, rank): the clusters whose dominant category stands for the topic, by the keywords in their titles, ties in order; all of them without a topic."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.coalesce("title", F.lit("")).alias("title")))), lambda x: x["title"]), " ")
    own = members.groupBy("cluster_key").agg(text.alias("text"))
    if topic:
        own = topics.of_topic(own.join(stories.dominant(members, ["cluster_key"], "category", order), "cluster_key"), "category", alias, topic)
    score = keyword_score(F.col("text"), topic).cast("long") if topic else F.lit(0).cast("long")
    rank = F.row_number().over(Window.orderBy(F.desc("keyword_score"), "cluster_key")).cast("long")  # a page's clusters
    return own.select("cluster_key", score.alias("keyword_score")).withColumn("rank", rank)


def summaries(requests: DataFrame, cached: DataFrame) -> DataFrame:
    """(id, key, summary, hit, store) for requests (id, purpose, content, titles, length): the stored summary, else one without a model.

    purpose: article, cluster or category; a short one of a cluster has a key of its own. store tells whether what was made is worth keeping.
    """
    ident = F.when((F.col("purpose") == "cluster") & (F.col("length") == "short"), F.concat(F.col("id"), F.lit(":short"))).otherwise(F.col("id"))
    key = F.coalesce(*[F.when(F.col("purpose") == p, digest.summary_key(p, ident)) for p in ("cluster", "category")], digest.summary_key("article", ident))
    made = F.when((F.col("purpose") == "cluster") & (F.size("titles") > 0), headlines(F.col("titles"))).when(F.col("purpose") == "category", digest.digest_fallback(F.col("content"))).otherwise(digest.article_summary(F.col("content")))
    store = cached.select(F.col("key").alias("_k"), F.nullif("value", F.lit("")).alias("_v"))
    out = requests.withColumn("key", key).join(store, F.col("key") == F.col("_k"), "left")
    return out.select("id", "key", F.coalesce("_v", made).alias("summary"), F.col("_v").isNotNull().alias("hit"), (F.col("_v").isNull() & digest.cacheable(made)).alias("store"))


def entries(log: DataFrame, as_of: Column) -> DataFrame:
    """(ns, key, size, seconds_left): the latest write of each key that hasn't expired, by its length and the time it has left."""
    latest = log.groupBy("ns", "key").agg(F.max_by(F.struct("value", "expires_at"), F.struct("written_at", "seq")).alias("v"))
    left = F.floor((millis(F.col("v.expires_at")) - millis(as_of)) / 1000).cast("long")
    return latest.select("ns", "key", F.length("v.value").cast("long").alias("size"), left.alias("seconds_left")).where("seconds_left > 0")
