"""From feeds and items to the list of articles: registry, limits, duplicates, order, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import canonical_key, is_aggregator


def flat_feeds(registry: DataFrame) -> DataFrame:
    """(source_key, source_name, feed_id, category, url, ord) from (source_key, name, feeds array<struct<id, category, url>>)."""
    out = registry.select("source_key", F.col("name"), F.posexplode("feeds").alias("pos", "f"))
    return out.select("source_key", F.concat_ws(" ", "name", "f.category").alias("source_name"), F.col("f.id").alias("feed_id"), "f.category", "f.url", F.col("pos").alias("ord"))


def categories(rows: DataFrame, ord_col: str = "ord") -> DataFrame:
    """Distinct categories with the place where each is first seen."""
    return rows.where("category <> ''").groupBy("category").agg(F.min(ord_col).alias("first_seen"))


def feeds_by_category(feeds: DataFrame) -> DataFrame:
    return feeds.groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "url"))), lambda f: f["url"]).alias("urls"))


def source_summary(feeds: DataFrame) -> DataFrame:
    return feeds.groupBy("source_key").agg(F.count("*").alias("feeds"), F.count_distinct("category").alias("categories"), F.array_sort(F.collect_set("category")).alias("names"))


def lookups(feeds: DataFrame, category: str) -> DataFrame:
    """(source_key, has_feed, has_category, urls): whether a source has a feed of a category, whatever its case, and exactly so; and its feeds in order."""
    one = F.col("category")
    lists = F.transform(F.array_sort(F.collect_list(F.struct("ord", "url"))), lambda f: f["url"])
    found = [F.coalesce(F.bool_or(x), F.lit(False)) for x in (F.lower(one) == category.lower(), one == category)]
    return feeds.groupBy("source_key").agg(found[0].alias("has_feed"), found[1].alias("has_category"), lists.alias("urls"))


def without_blocked(rows: DataFrame, blocklist: str, url: Column) -> DataFrame:
    """Rows whose address contains none of the comma-separated texts."""
    blocked = [b.strip() for b in blocklist.split(",") if b.strip()]
    hit = F.lit(False)
    for b in blocked:
        hit = hit | F.contains(url, F.lit(b))
    return rows.where(~F.coalesce(hit, F.lit(False)))


def per_feed_cap(rows: DataFrame, feed: str, order: str, most: int = 25, aggregator_most: int = 100, feed_url: str | None = None) -> DataFrame:
    """The first rows of each feed; an aggregator's feeds may have more."""
    limit = F.when(is_aggregator(F.col(feed_url)), aggregator_most).otherwise(most) if feed_url else F.lit(most)
    rank = F.row_number().over(Window.partitionBy(feed).orderBy(order))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= max(most, aggregator_most)).where(F.col("_rank") <= limit).drop("_rank")


def titled(articles: DataFrame) -> DataFrame:
    return articles.where("title is not null and title <> ''")


def first_by_key(articles: DataFrame, key: Column, *order: Column, within: list[str] | None = None) -> DataFrame:
    """One row for each key, the first by order. Only the keys of rows are compared, so the shuffle is on the key."""
    rank = F.row_number().over(Window.partitionBy(*(within or []), "_key").orderBy(*order))
    return articles.withColumn("_key", key).withColumn("_rank", rank).where("_rank = 1").drop("_key", "_rank")


def latest_unique(articles: DataFrame) -> DataFrame:
    """One article for each canonical address, the newest; ties by order of arrival."""
    return first_by_key(titled(articles), canonical_key(F.col("url"), F.col("source_url"), F.col("title")), F.desc_nulls_last("published_at"), F.col("ord"))


def newest(articles: DataFrame, most: int = 2000) -> DataFrame:
    """The newest articles; a top-k, not a full sort."""
    return articles.orderBy(F.desc_nulls_last("published_at"), "ord").limit(most)


def page(rows: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """The rows of a page with total_results and total_pages; a number below 1 gives none.

    Only the rows up to the page's end are sorted, and the total is a count of its own.
    """
    total = rows.agg(F.count("*").alias("total_results"))
    total = total.withColumn("total_pages", F.ceil(F.col("total_results") / size).cast("long"))
    shown = rows.orderBy(*order).offset((number - 1) * size).limit(size) if number >= 1 else rows.limit(0)
    return shown.crossJoin(F.broadcast(total))  # the total is one row


def chunks(rows: DataFrame, group: str, pos: str, size: int, overlap: int = 0) -> DataFrame:
    """rows with `chunk`: runs of `size` within each group, each starting `size - overlap` after the last. A row is in every chunk that covers it."""
    step = size - overlap
    last = F.floor(F.col(pos) / step)
    first = F.greatest(F.lit(0), F.floor((F.col(pos) - size) / step) + 1)
    return rows.withColumn("chunk", F.explode(F.sequence(first, last)))


def split_top(rows: DataFrame, pos: str, most: int = 4) -> DataFrame:
    return rows.withColumn("is_top", F.col(pos) < most)
