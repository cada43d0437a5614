"""Topics of articles and clusters: trends, fallbacks, the topic bar and the view of one topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import TOPIC_KEYWORDS
from ..functions.times import recency_weight
from ..functions.topics import keyword_score, matches


def hits(rows: DataFrame, text: Column, weight: Column) -> DataFrame:
    """(topic, topic_ord, w) for every topic that a row's text matches. All patterns are tested in one pass over the rows, without a join."""
    found = F.array(*[F.when(matches(text, t), F.struct(F.lit(i).alias("topic_ord"), F.lit(t).alias("topic"))) for i, t in enumerate(TOPIC_KEYWORDS)])
    return rows.select(F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x"), weight.alias("w")).select("x.topic", "x.topic_ord", "w")


def trending(articles: DataFrame, clusters: DataFrame, as_of: Column, most: int = 10) -> DataFrame:
    """(topic, score): articles by recency, clusters (text, latest) twice."""
    a = hits(articles, F.concat_ws(" ", "title", F.coalesce("description", F.lit(""))), recency_weight(F.col("published_at"), as_of))
    c = hits(clusters, F.col("text"), recency_weight(F.col("latest"), as_of) * 2)
    sums = a.unionAll(c).groupBy("topic", "topic_ord").agg(F.sum("w").alias("score"))
    return sums.orderBy(F.desc(F.round("score", 9)), "topic_ord").limit(most).select("topic", "score")


def fallback(articles: DataFrame, members: DataFrame, most: int = 10) -> DataFrame:
    """(category, n): the most frequent categories of articles and clusters' members together."""
    both = articles.select("category", "ord").unionAll(members.select("category", "ord")).where("category <> ''")
    return both.groupBy("category").agg(F.count("*").alias("n"), F.min("ord").alias("first")).orderBy(F.desc("n"), "first").limit(most).select("category", "n")


def present(articles: DataFrame, members: DataFrame) -> DataFrame:
    return articles.select("category").unionAll(members.select("category")).where("category <> ''").distinct()


def of_topic(rows: DataFrame, category: str, alias: DataFrame, topic: str) -> DataFrame:
    """Rows whose category stands for the topic, by name or alias; a topic without aliases stands for itself."""
    names = alias.where(F.col("topic") == topic).select("category_lc").unionAll(alias.sparkSession.createDataFrame([(topic.lower(),)], "category_lc string")).distinct()
    return rows.where(F.col(category) != "").withColumn("_lc", F.lower(category)).join(names, F.col("_lc") == F.col("category_lc"), "left_semi").drop("_lc")


def view(rows: DataFrame, category: str, text: Column, alias: DataFrame, topic: str) -> DataFrame:
    """of_topic() with keyword_score, which the view is ordered by."""
    return of_topic(rows, category, alias, topic).withColumn("keyword_score", keyword_score(text, topic).cast("long"))


def bar(rows: DataFrame, category: str, published: str, alias: DataFrame, as_of: Column, activity: float = 1.0, recency: float = 1.0, tau: float = 24.0) -> DataFrame:
    """(topic, n, score): topics of the alias table by the number of rows and their ages; topics without rows are left out."""
    met = rows.withColumn("_lc", F.lower(category)).join(alias, F.col("_lc") == F.col("category_lc"))
    out = met.groupBy("topic").agg(F.count("*").alias("n"), F.sum(recency_weight(F.col(published), as_of, tau)).alias("fresh"))
    return out.select("topic", "n", (F.lit(activity) * F.col("n") + F.lit(recency) * F.col("fresh")).alias("score"))
