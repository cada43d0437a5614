"""Severity, scores and the order of stories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dims import SEVERITY_MULTIPLIERS
from ..functions.times import millis
from ..functions.urls import host
from ..params import Params
from .stories import dominant


def severity(members: DataFrame, meta: DataFrame) -> DataFrame:
    """(cluster_key, level, label, reason, ambiguous) from members with category and pos. Unknown categories are ambiguous.

    The number of categories is small, so the dimension is left for Spark to broadcast by its size.
    """
    keys = members.select("cluster_key").distinct()
    dom = dominant(members, ["cluster_key"], "category", "pos")
    out = keys.join(dom, "cluster_key", "left").join(meta, "category", "left")
    return out.select("cluster_key", F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("label", F.lit("Other")).alias("label"), F.when(F.col("label").isNotNull(), F.col("category")).alias("reason"), F.col("label").isNull().alias("ambiguous"))


def multiplier(label: Column, multipliers: dict[str, float] = SEVERITY_MULTIPLIERS) -> Column:
    out = F.lit(1.0)
    for name, value in multipliers.items():
        out = F.when(label == name, value).otherwise(out)
    return out


def coverage(members: DataFrame, as_of: Column, hours: float) -> DataFrame:
    """(cluster_key, n, domains, recent): articles, distinct hosts, and articles of the last hours; times to come count as recent, missing ones don't."""
    recent = millis(as_of) - millis(F.col("published_at")) <= int(hours * 3_600_000)
    return members.groupBy("cluster_key").agg(F.count("*").alias("n"), F.count_distinct(F.nullif(host(F.col("url")), F.lit(""))).alias("domains"), F.count_if(recent).alias("recent"))


def score(n: Column, domains: Column, images: Column, recent: Column, label: Column, p: Params = Params()) -> Column:
    bonus = F.when(images >= 2, p.score_image_bonus_ge2).when(images >= 1, p.score_image_bonus_ge1).otherwise(p.score_image_penalty_none)
    speed = F.when(n > 0, recent / n).otherwise(0.0) * F.log1p(recent.cast("double"))
    base = p.score_w_articles * F.log1p(n.cast("double")) + p.score_w_domains * F.log1p(domains.cast("double")) + p.score_w_images * bonus + p.score_w_velocity * speed
    return base * multiplier(label)


def scored(members: DataFrame, images: DataFrame, meta: DataFrame, as_of: Column, p: Params = Params()) -> DataFrame:
    """(cluster_key, n, domains, recent, images, level, label, ambiguous, score); images: (cluster_key, image_urls)."""
    out = coverage(members, as_of, p.score_velocity_window_hours).join(severity(members, meta), "cluster_key").join(images.select("cluster_key", F.size("image_urls").alias("images")), "cluster_key", "left")
    out = out.withColumn("images", F.coalesce("images", F.lit(0)).cast("long"))
    return out.withColumn("score", score(F.col("n"), F.col("domains"), F.col("images"), F.col("recent"), F.col("label"), p))


def to_assess(scores: DataFrame, most: int = 8, scope: list[str] | None = None) -> DataFrame:
    """The ambiguous among the first `most` by score, of all or of each group of scope."""
    w = Window.partitionBy(*(scope or [])).orderBy(F.desc("score"), "cluster_key")
    return scores.withColumn("place", F.row_number().over(w)).where((F.col("place") <= most) & F.col("ambiguous")).drop("place")


def reassessed(scores: DataFrame, answers: DataFrame, most: int = 8, p: Params = Params(), scope: list[str] | None = None) -> DataFrame:
    """Scores with the answers (cluster_key, level, label) for those to_assess(), scored again. Others, and those without an answer, keep theirs."""
    found = answers.select("cluster_key", F.col("level").alias("_level"), F.col("label").alias("_label")).join(to_assess(scores, most, scope).select("cluster_key"), "cluster_key", "left_semi")
    out = scores.join(found, "cluster_key", "left").withColumns({"level": F.coalesce("_level", "level"), "label": F.coalesce("_label", "label")}).drop("_level", "_label")
    return out.withColumn("score", score(F.col("n"), F.col("domains"), F.col("images"), F.col("recent"), F.col("label"), p))
