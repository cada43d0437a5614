"""What the page shows of stories: pictures, payloads for summaries, related stories, cached summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import short_hash
from ..functions.images import inferred_dims, is_useful, large_enough
from ..functions.text import strip_html, truncated
from ..params import Params


# The wording of payloads in category_payload(), and the error texts in is_rate_limit().


def hero(members: DataFrame, expanded: bool = False, p: Params = Params(), order: str = "pos") -> DataFrame:
    """(cluster_key, hero): the first member's useful image; small ones only while the story is folded."""
    fits = F.lit(True) if not expanded else large_enough(F.col("image_width"), F.col("image_height"), p.min_image_width, p.min_image_height)
    fine = members.where(is_useful(F.col("url_to_image")) & fits)
    return fine.groupBy("cluster_key").agg(F.min(F.struct(order, "url_to_image")).alias("m")).select("cluster_key", F.col("m.url_to_image").alias("hero"))


def last_by_image(members: DataFrame, order: str = "pos") -> DataFrame:
    """(cluster_key, url_to_image, id, image_width, image_height): of the members with one image, the last."""
    best = F.max(F.struct(order, "id", "image_width", "image_height")).alias("m")
    return members.where(is_useful(F.col("url_to_image"))).groupBy("cluster_key", "url_to_image").agg(best).select("cluster_key", "url_to_image", "m.id", "m.image_width", "m.image_height")


def collage(pictures: DataFrame, members: DataFrame, p: Params = Params(), most: int = 4) -> DataFrame:
    """(cluster_key, urls): a cluster's images without those known or told to be too small."""
    each = pictures.select("cluster_key", F.posexplode("image_urls").alias("at", "url_to_image")).join(last_by_image(members), ["cluster_key", "url_to_image"], "left")
    told = inferred_dims(F.col("url_to_image"))
    fits = large_enough(F.col("image_width"), F.col("image_height"), p.min_image_width, p.min_image_height) & large_enough(told["width"], told["height"], p.min_image_width, p.min_image_height)
    return each.where(fits).groupBy("cluster_key").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("at", "url_to_image"))), lambda x: x["url_to_image"]), 1, most).alias("urls"))


def grid_cell(count: Column, index: Column, first: Column, second: Column) -> Column:
    """Columns x rows that an image of so many takes, by the ratios of the first two."""
    wide = F.when((first > 1.2) & (second > 1.2), "2x1").otherwise("1x2")
    three = F.when(first > 1.2, F.when(index == 0, "2x1").otherwise("1x1")).otherwise(F.when(index == 0, "1x2").otherwise("1x1"))
    return F.when(count == 1, "2x2").when(count == 2, wide).when(count == 3, three).otherwise("1x1")


def related_titles(links: DataFrame, clusters: DataFrame) -> DataFrame:
    """Links with the related cluster's title and number of members; links to unknown clusters are dropped."""
    return links.join(clusters.select(F.col("cluster_key").alias("related_key"), F.col("cluster_title").alias("related_title"), F.size("article_ids").alias("related_size")), "related_key")


def hydrated(clusters: DataFrame, cached: DataFrame, key: Column) -> DataFrame:
    """Clusters with `summary` filled from (key, value) where it is missing."""
    store = cached.select(F.col("key").alias("_k"), "value")
    return clusters.withColumn("_key", key).join(store, F.col("_key") == F.col("_k"), "left").withColumn("summary", F.coalesce(F.nullif(F.col("summary"), F.lit("")), "value")).drop("_key", "_k", "value")


def wants_summary(content: Column, manual: bool) -> Column:
    return F.coalesce(F.length(content) > (30 if manual else 100), F.lit(False))


def has_server_summary(summary: Column, least: int = 160) -> Column:
    return F.length(strip_html(F.coalesce(summary, F.lit("")))) >= least


def is_rate_limit(message: Column, code: Column, status: Column) -> Column:
    """Whether an error says that a model may not be asked just now."""
    low = F.lower(F.coalesce(message, F.lit("")))
    said = F.regexp_like(F.coalesce(message, F.lit("")), F.lit("rate_limit_exceeded|429|Rate limit reached")) | F.regexp_like(low, F.lit("spend_limit_reached|spend limit"))
    return said | F.coalesce(code.isin("rate_limit_exceeded", "spend_limit_reached"), F.lit(False)) | F.coalesce(status == 429, F.lit(False))


def is_valid_cluster(title: Column, ids: Column) -> Column:
    return F.coalesce((title != "") & (F.size(ids) >= 2), F.lit(False))


def category_payload(stories: DataFrame, loose: DataFrame, label: str, most: int = 4, per_story: int = 3, most_loose: int = 4) -> DataFrame:
    """One row (id, content, article_count): what a category's digest is written from; no row if there is too little.

    stories: (ord, title, summary, label, articles array<struct<id, title>>) of a category; loose: (ord, id, title, source_name, description).
    Both are cut to a few rows by a top-k before anything is gathered.
    """
    label = label.strip() or "Trending"
    top = stories.orderBy("ord").limit(most).withColumn("few", F.slice("articles", 1, max(1, per_story)))
    clean = F.filter(F.transform("few", lambda a: strip_html(F.coalesce(a["title"], F.lit("")))), lambda t: t != "")
    cue = F.when(F.coalesce("summary", F.lit("")) != "", truncated(strip_html(F.col("summary")), 240)).otherwise(truncated(F.array_join(F.slice(clean, 1, 2), " | "), 200))
    rows = F.array_sort(F.collect_list(F.struct("ord", "title", F.size("articles").alias("n"), F.coalesce("label", F.lit("Other")).alias("label"), cue.alias("cue"), F.transform("few", lambda a: a["id"]).alias("ids"))))
    s = top.agg(rows.alias("s"))
    section = lambda x, i: F.concat_ws("\n", F.concat((i + 1).cast("string"), F.lit(". "), x["title"]), F.concat(F.lit("Articles: "), x["n"].cast("string")), F.when(x["label"] != "Other", F.concat(F.lit("Weight: "), x["label"])), F.when(x["cue"] != "", F.concat(F.lit("Cue: "), x["cue"])))
    s = s.select(F.array_distinct(F.flatten(F.transform("s", lambda x: x["ids"]))).alias("story_ids"), F.array_join(F.transform("s", section), "\n\n").alias("sections"))
    # of the loose articles as many may be in the stories as these have, so that many more are taken along
    text = truncated(strip_html(F.coalesce(F.nullif("description", F.lit("")), F.lit("No description provided."))), 220)
    line = F.concat(F.lit("- "), F.col("title"), F.when(F.col("source_name") != "", F.concat(F.lit(" ("), F.col("source_name"), F.lit(")"))).otherwise(""), F.lit(": "), text)
    more = loose.orderBy("ord").limit(most_loose + most * max(1, per_story)).agg(F.array_sort(F.collect_list(F.struct("ord", "id", line.alias("line")))).alias("l"))
    both = s.crossJoin(more)  # a row each
    both = both.withColumn("l", F.slice(F.filter("l", lambda x: ~F.array_contains("story_ids", x["id"])), 1, most_loose) if most_loose else F.filter("l", lambda x: F.lit(False)))
    both = both.withColumn("ids", F.array_union("story_ids", F.transform("l", lambda x: x["id"])))
    head = "Top clusters (use these to infer the dominant day-level themes, not to restate each headline):\n"
    content = F.concat_ws("\n\n", F.lit(f"Topic: {label}"), F.when(F.col("sections") != "", F.concat(F.lit(head), "sections")), F.when(F.size("l") > 0, F.concat(F.lit("Additional headlines:\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"))))
    ident = F.concat(F.lit("category-"), short_hash(F.concat(F.lit(f"{label}|"), F.array_join("ids", "|"))))
    return both.select(ident.alias("id"), content.alias("content"), F.size("ids").cast("long").alias("article_count")).where("article_count > 0 and length(content) >= 40")
