"""From the items of all feeds to the list of articles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import image_or_placeholder
from ..operators import ingest
from ..params import Params


def all_news(rows: DataFrame, feed: str, p: Params = Params(), feed_url: str | None = None) -> DataFrame:
    """The newest articles, each once: of feeds that aren't blocked, so many of each, with a title; pictures where there are none.

    feed: the column that tells a row's feed; feed_url: its address, which the blocklist reads and by which aggregators may have more rows.
    """
    rows = ingest.without_blocked(rows, p.feed_blocklist, F.col(feed_url)) if feed_url else rows
    few = ingest.per_feed_cap(rows, feed, "ord", p.feed_items_per_feed, p.aggregator_feed_items_limit, feed_url)
    out = ingest.newest(ingest.latest_unique(few), p.news_global_limit)
    return out.withColumn("url_to_image", image_or_placeholder(F.col("url_to_image"), F.col("source_name")))
