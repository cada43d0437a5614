"""Members of a cluster as they are shown: no duplicates, no dominating host, and the images worth showing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.images import inferred_dims, is_useful, large_enough
from ..functions.urls import canonical_key, resolved_host
from ..params import Params
from .ingest import first_by_key


def resolved() -> Column:
    return resolved_host(F.col("url"), F.col("source_url"), F.col("source_name"))


def deduped(members: DataFrame, within: str = "cluster_key") -> DataFrame:
    """Without repeated addresses, then without repeated headlines of one host, within each cluster; the first stays."""
    once = first_by_key(members, canonical_key(F.col("url"), F.col("source_url"), F.col("title"), lower=False), F.col("pos"), within=[within])
    return first_by_key(once, F.concat(resolved(), F.lit("|"), F.lower(F.trim(F.coalesce("title", F.lit(""))))), F.col("pos"), within=[within])


def order() -> list[Column]:
    return [F.desc_nulls_last("published_at"), F.desc(is_useful(F.col("url_to_image")).cast("int")), F.col("pos")]


def diverse(members: DataFrame, per_host: int = 8, most: int = 50, within: str = "cluster_key") -> DataFrame:
    """At most `per_host` of each host, and `most` in all, newest first; articles without a host aren't limited. `shown` is the place."""
    hosted = members.withColumn("_host", resolved())
    rank = F.row_number().over(Window.partitionBy(within, "_host").orderBy(*order()))
    kept = hosted.withColumn("_rank", rank).where((F.col("_host") == "") | (F.col("_rank") <= per_host))
    shown = F.row_number().over(Window.partitionBy(within).orderBy(*order()))
    return kept.withColumn("shown", shown).where(F.col("shown") <= most).drop("_host", "_rank")


def images(shown: DataFrame, before: DataFrame, p: Params = Params(), most: int = 4) -> DataFrame:
    """(cluster_key, image_urls): the first distinct images that are useful and not too small; from the members before the limits if none of the shown has one."""
    both = shown.select("cluster_key", F.col("shown").alias("at"), "url_to_image", "image_width", "image_height", F.lit(0).alias("late"))
    both = both.unionAll(before.select("cluster_key", F.col("pos").alias("at"), "url_to_image", "image_width", "image_height", F.lit(1).alias("late"))).where(is_useful(F.col("url_to_image")))
    told = inferred_dims(F.col("url_to_image"))
    known = lambda c: F.when(c > 0, c)
    w, h = F.coalesce(known(F.col("image_width")), told["width"]), F.coalesce(known(F.col("image_height")), told["height"])
    first = both.groupBy("cluster_key").agg(F.min("late").alias("use"))
    fine = both.join(first, "cluster_key").where("late = use").where(large_enough(w, h, p.min_image_width, p.min_image_height))
    once = fine.groupBy("cluster_key", "url_to_image").agg(F.min("at").alias("at"))
    return once.groupBy("cluster_key").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("at", "url_to_image"))), lambda x: x["url_to_image"]), 1, most).alias("image_urls"))


def valid(members: DataFrame, least: int = 2, within: str = "cluster_key") -> DataFrame:
    """Members of the clusters that have enough of them."""
    keys = members.groupBy(within).count().where(F.col("count") >= least).select(within)
    return members.join(keys, within, "left_semi")
