"""Feeds: the registry, feed files, and the projection of their items to articles. No network: files are read as they have been fetched."""

from __future__ import annotations

import html
import itertools
import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..dims import AGGREGATOR_HOST
from ..functions.hashing import short_hash
from ..functions.images import first_img, inferred_dims, picked
from ..functions.text import blank, slug
from ..functions.titles import source_name, without_publisher
from ..functions.urls import decoded_aggregator_url, hostname, is_aggregator
from ..operators.numbering import numbered
from .scratch import saved

FEEDS = "map<string, struct<name: string, feeds: array<struct<id: string, category: string, url: string>>>>"
ITEM = """title string, link string, guid string, pubDate string, isoDate string, source struct<_VALUE: string, _url: string>, description string, `content:encoded` string, content string, contentSnippet string,
 `media:thumbnail` struct<_url: string, _width: int, _height: int>, `media:content` struct<_url: string, _width: int, _height: int>, enclosure struct<_url: string, _type: string>"""


def registry(spark: SparkSession, path: str) -> DataFrame:
    """(source_key, name, feeds) from a JSON file that maps keys to sources."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", FEEDS)).alias("source_key", "s")).select("source_key", "s.name", "s.feeds")


FRAGMENT = re.compile(r"<(?:item|entry)(?:\s[^<>]*)?/>|<(item|entry)(?=[\s>])(?:<!\[CDATA\[.*?\]\]>|[^<]++|<(?!/?\1[\s>/]))*(</\1\s*>)?", re.S)
PREFIX = re.compile(r"[<\s/]([A-Za-z_][\w.-]*):[A-Za-z_]")
ENTITY = re.compile(r"<!\[CDATA\[.*?\]\]>|&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9A-Fa-f]+);)(\w+);", re.S)
READ = f"feed_file string, item int, {ITEM}, reason string, raw string, opens boolean"


def _element(fragment: str) -> ElementTree.Element:
    """The element of an item that stands alone: its prefixes are declared as themselves, and names for characters that XML doesn't know are read as HTML has them."""
    declared = "".join(f' xmlns:{p}="{p}"' for p in sorted(set(PREFIX.findall(fragment)) - {"xml", "xmlns"}))
    try:
        return ElementTree.fromstring(f"<x{declared}>{fragment}</x>")[0]
    except ElementTree.ParseError:
        plain = ENTITY.sub(lambda m: html.escape(html.unescape(m.group())) if m.group(1) else m.group(), fragment)
        return ElementTree.fromstring(f"<x{declared}>{plain}</x>")[0]


def _fields(e: ElementTree.Element) -> dict:
    """An item's columns. Names come without the namespace that a feed declares as its default."""
    by: dict[str, ElementTree.Element] = {}
    for child in e:
        uri, _, name = child.tag.rpartition("}")
        by.setdefault(f"{uri[1:]}:{name}" if uri else name, child)

    def text(*names: str) -> str | None:
        return next(("".join(by[n].itertext()).strip() for n in names if n in by), None)

    def media(name: str) -> dict | None:
        a = by[name].attrib if name in by else {}
        number = lambda v: int(v) if (v or "").isdigit() and len(v) < 10 else None
        return {"_url": a["url"], "_width": number(a.get("width")), "_height": number(a.get("height"))} if "url" in a else None

    source, enclosure, link = by.get("source"), by.get("enclosure"), by.get("link")
    return {
        "title": text("title"), "link": text("link") or (link.get("href") if link is not None else None), "guid": text("guid", "id"), "pubDate": text("pubDate"), "isoDate": text("isoDate", "published", "updated", "dc:date"),
        "source": {"_VALUE": "".join(source.itertext()).strip(), "_url": source.get("url")} if source is not None else None, "description": text("description", "summary"), "content:encoded": text("content:encoded"), "content": text("content"), "contentSnippet": text("contentSnippet"),
        "media:thumbnail": media("media:thumbnail"), "media:content": media("media:content"), "enclosure": {"_url": enclosure.get("url"), "_type": enclosure.get("type")} if enclosure is not None else None,
    }


def parsed(path: str, content: bytes | None) -> Iterator[dict]:
    """A READ row for each item of a feed file, with the reason where it can't be used; a file without items gives one row, of item -1. `opens` marks the first item that can be used."""
    told = re.search(rb"<\?xml[^>]*encoding=[\"']([\w.-]+)", (content or b"")[:200])
    try:
        text = (content or b"").decode(told.group(1).decode() if told else "utf-8-sig")
    except (LookupError, UnicodeDecodeError) as e:
        yield {"feed_file": path, "item": -1, "reason": f"encoding: {e}"[:200]}
        return
    number, opens = -1, True
    for number, m in enumerate(FRAGMENT.finditer(text)):
        row = {"feed_file": path, "item": number}
        if m.group(1) and not m.group(2):
            yield row | {"reason": "not closed", "raw": m.group()}
            continue
        try:
            usable = _fields(_element(m.group()))
            yield row | usable | {"opens": opens}
            opens = False
        except ElementTree.ParseError as e:
            yield row | {"reason": f"malformed: {e}", "raw": m.group()}
    if number < 0:
        page = re.search(r"<(!doctype )?html", text[:1000], re.I)
        yield {"feed_file": path, "item": -1, "reason": "empty" if not text.strip() else "a page, not a feed" if page else "no items"}


def read_items(files: DataFrame) -> DataFrame:
    """READ rows from (path, content) of feed files, every item once: with its columns, or with the reason why not and what stood there. A file's items are read one by one in its task, so a bad one spoils no other."""
    schema = files.sparkSession.createDataFrame([], READ).schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for b in batches:
            for path, content in zip(b.column(0), b.column(1)):
                rows = parsed(path.as_py(), content.as_py())
                while part := list(itertools.islice(rows, 1000)):
                    yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in part], schema=arrow)

    return files.select("path", "content").mapInArrow(run, schema)


def landed(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, feed_no) of the feed files under a path, numbered in the order of their names; any store that Spark reads. Spark leaves out files of no bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    order = numbered(files.select("path"), [], ["path"], "feed_no").withColumnRenamed("path", "_file")
    return files.join(order, F.col("path") == F.col("_file")).select("path", "content", "feed_no")


def outcomes() -> list[Column]:
    """Aggregates over READ rows: feeds, those with a usable item, usable items, rejects, and rejects by what is wrong. Each feed has one row of item 0 or below."""
    wrong = F.coalesce(F.split("reason", ":")[0], F.lit(""))
    kinds = {"not_closed": "not closed", "malformed": "malformed", "encoding": "encoding", "empty": "empty", "not_a_feed": "a page, not a feed", "no_items": "no items"}
    each = [F.count_if(wrong == said).alias(name) for name, said in kinds.items()]
    return [F.count_if(F.col("item") <= 0).alias("feeds"), F.count_if("opens").alias("feeds_ok"), F.count_if(F.col("reason").isNull()).alias("items"), F.count_if(F.col("reason").isNotNull()).alias("rejects"), *each]


def counted(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(items, rejects, counts) of feed files, read once: items with feed_file, feed_no and item, their place in the feed; rejects with feed_file, item, reason and raw; outcomes(), taken while the items are written."""
    files = saved(landed(spark, path))
    order = files.select(F.col("path").alias("feed_file"), "feed_no")
    seen, counts = Observation(), outcomes()
    rows = saved(read_items(files).observe(seen, *counts))
    usable = rows.where("reason is null").drop("reason", "raw", "opens").join(order, "feed_file")
    return usable, rows.where("reason is not null").select("feed_file", "item", "reason", "raw"), {k: int(v or 0) for k, v in seen.get.items()}


def quarantined(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The items and rejects of feed files; counted() also tells how many there were."""
    return counted(spark, path)[:2]


def failed_feeds(items: DataFrame, rejects: DataFrame) -> DataFrame:
    """(feed_file, rejects, reason) of the feeds without a usable item, with the first reason."""
    own = rejects.join(items.select("feed_file").distinct(), "feed_file", "left_anti")
    return own.groupBy("feed_file").agg(F.count("*").alias("rejects"), F.min_by("reason", "item").alias("reason"))


def items(spark: SparkSession, path: str) -> DataFrame:
    """The usable items of feed files; quarantined() also gives the others."""
    return quarantined(spark, path)[0]


def published(c: Column) -> Column:
    """A time from ISO or mail dates; null if it can't be read. The weekday of mail dates is dropped first."""
    clean = F.regexp_replace(F.trim(c), r"^[A-Za-z]{3,9},\s*", "")
    mail = [F.try_to_timestamp(clean, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss")]
    return F.coalesce(F.try_to_timestamp(F.trim(c)), *mail)


def to_articles(rows: DataFrame, category: Column, feed_name: Column, feed_url: Column, as_of: Column) -> DataFrame:
    """Articles from items. The id hashes the raw title, the article has the clean one; it ends with the item's place in its feed, and feeds follow each other in the order of their numbers, so reruns agree."""
    raw = F.trim(F.coalesce("title", F.lit("")))
    agg = is_aggregator(feed_url)
    title = F.when(agg, without_publisher(raw)).otherwise(raw)
    name = F.when(agg, source_name(F.coalesce("source._VALUE", "source._url"), raw, feed_name)).otherwise(feed_name)
    content = F.coalesce(blank(F.col("content:encoded")), blank(F.col("content")), blank(F.col("contentSnippet")), F.lit(""))
    html = first_img(F.coalesce(blank(F.col("content:encoded")), blank(F.col("content")), F.col("description")))
    image = picked(F.col("media:thumbnail._url"), F.col("enclosure._url"), F.col("media:content._url"), html["src"])
    told = inferred_dims(image)
    width = F.coalesce(F.col("media:thumbnail._width"), F.col("media:content._width"), told["width"], html["width"])
    height = F.coalesce(F.col("media:thumbnail._height"), F.col("media:content._height"), told["height"], html["height"])
    when = F.coalesce("pubDate", "isoDate")
    at, order = F.col("item"), F.col("feed_no") * (1 << 24) + F.col("item")
    return rows.select(
        F.concat_ws("-", slug(category), short_hash(raw), short_hash(name), at.cast("string")).alias("id"), title.alias("title"), F.coalesce("description", "contentSnippet", F.lit("")).alias("description"), content.alias("content"),
        F.coalesce("link", "guid", F.lit("")).alias("url"), image.alias("url_to_image"), width.alias("image_width"), height.alias("image_height"), when.alias("published_at_raw"),
        F.when(when.isNull(), as_of).otherwise(published(when)).alias("published_at"), name.alias("source_name"), F.coalesce("source._url", feed_url).alias("source_url"), category.alias("category"), order.alias("ord"),
    )


def with_decoded_urls(articles: DataFrame, decoded: DataFrame | None = None) -> DataFrame:
    """Aggregators' links replaced by what they stand for: read from the link, or from a table (url, real_url). A missing or aggregator's source address follows."""
    out = articles.withColumn("_real", F.when(F.contains("url", F.lit(f"{AGGREGATOR_HOST}/rss/articles/")), decoded_aggregator_url(F.col("url"))))
    if decoded is not None:
        table = decoded.where(~F.coalesce(F.regexp_like(hostname(F.col("real_url")), F.lit(r"(?:^|\.)google\.[a-z.]+$")), F.lit(False)))
        out = out.join(table.select(F.col("url").alias("_url"), F.col("real_url")), F.col("url") == F.col("_url"), "left").withColumn("_real", F.coalesce("real_url", "_real")).drop("_url", "real_url")
    origin = F.regexp_extract("_real", r"^(https?://[^/?#]+)", 1)
    vague = (F.coalesce("source_url", F.lit("")) == "") | is_aggregator(F.col("source_url"))
    out = out.withColumn("source_url", F.when(F.col("_real").isNotNull() & vague, origin).otherwise(F.col("source_url")))
    return out.withColumn("url", F.coalesce("_real", "url")).drop("_real")
