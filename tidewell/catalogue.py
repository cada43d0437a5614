"""The queries over the test tables by name, each with the SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dims
from .dims import STOPWORDS
from .fixtures import AS_OF, CLUSTERS, HOST_SQL, KEY_SQL, SQL, articles, articles_of, as_of, clusters, members, table, table_stream
from .functions import digest, entities, hashing, images, text, times, titles, topics, urls
from .operators import enrich, greedy, ingest, leading, merging, ranking, state, stories, tfidf
from .operators import topics as topic_ops
from .plans import summaries
from .sources.scratch import dropped, saved, swept

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def sql_values(rows: list[tuple], names: str) -> str:
    def one(v) -> str:
        return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") v({names})"


def long(c: Column) -> Column:
    return c.cast("long")


STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def sql_tokens(c: str) -> str:
    clean = f"regexp_replace(regexp_replace(lower({c}), 'https?://[^ \\t\\n\\r\\f\\v]+', ' ', 'g'), '[^a-z0-9 \\t\\n\\r\\f\\v]', ' ', 'g')"
    return f"list_filter(regexp_split_to_array({clean}, '[ \\t\\n\\r\\f\\v]+'), lambda t: length(t) > 2 AND NOT list_contains({STOP}, t))"


def sql_entities(c: str) -> str:
    joined = "regexp_replace(lower(x), '[ \\t\\n\\r\\f\\v]+', '_', 'g')"
    return f"""list_distinct(list_concat(
      list_transform(regexp_extract_all({c}, '[A-Z][a-zA-Z'']*(?:[ \\t\\n\\r\\f\\v]+[A-Z][a-zA-Z'']*)+'), lambda x: replace({joined}, '''', '')),
      list_transform(list_filter(flatten(list_transform(regexp_split_to_array({c}, '[.!?][ \\t\\n\\r\\f\\v]+'), lambda s: regexp_split_to_array(s, '[ \\t\\n\\r\\f\\v]+')[2:])), lambda w: regexp_full_match(w, '[A-Z][a-zA-Z'']*') AND length(w) >= 3), lambda w: replace(lower(w), '''', '')),
      list_transform(regexp_extract_all({c}, '\\b[A-Z]{{2,6}}\\b'), lambda x: lower(x)),
      list_transform(regexp_extract_all({c}, '[A-Z][a-zA-Z]*[ \\t\\n\\r\\f\\v]*[0-9]{{2,4}}'), lambda x: {joined})))"""


def of_articles(select: str, extra: str = "") -> str:
    return f"WITH {SQL}{extra} {select}"


HOURS = f"((epoch_us(TIMESTAMP '{AS_OF}') // 1000) - (epoch_us(published_at) // 1000)) / 3.6e6"
RESOLVED_SQL = f"{HOST_SQL}"

# --- intake -----------------------------------------------------------------------------------------------------------------------

UNIQUE_SQL = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {KEY_SQL.replace("|| CASE", "|| lower(CASE", 1)}) ORDER BY published_at DESC, ord) AS rk FROM articles WHERE title <> '') WHERE rk = 1"""


@query("news_page", of_articles(f""", u AS ({UNIQUE_SQL}), n AS (SELECT * FROM u ORDER BY published_at DESC, ord LIMIT 2000), c AS (SELECT * FROM n WHERE category = 'Politics')
SELECT id, title, (SELECT count(*) FROM c) AS total_results, CAST(ceil((SELECT count(*) FROM c) / 10.0) AS BIGINT) AS total_pages FROM c ORDER BY published_at DESC, ord LIMIT 10 OFFSET 10"""))
def news_page(spark, sf_dir):
    rows = ingest.newest(ingest.latest_unique(articles(spark, sf_dir))).where("category = 'Politics'")
    return ingest.page(rows, 2, 10, F.desc("published_at"), F.col("ord")).select("id", "title", "total_results", "total_pages")


@query("dedupe_latest", of_articles(f"SELECT id, url FROM ({UNIQUE_SQL})"))
def dedupe_latest(spark, sf_dir):
    return ingest.latest_unique(articles(spark, sf_dir)).select("id", "url")


@query("top_articles", of_articles("SELECT id, CAST(ord AS BIGINT) AS ord FROM articles ORDER BY published_at DESC, ord LIMIT 200"))
def top_articles(spark, sf_dir):
    return ingest.newest(articles(spark, sf_dir), 200).select("id", "ord")


@query("drop_untitled", of_articles("SELECT id FROM articles WHERE title IS NOT NULL AND title <> ''"))
def drop_untitled(spark, sf_dir):
    return ingest.titled(articles(spark, sf_dir)).select("id")


@query("per_feed_limit", of_articles("SELECT id, source_name FROM (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY ord) AS rk FROM articles) WHERE rk <= 25"))
def per_feed_limit(spark, sf_dir):
    return ingest.per_feed_cap(articles(spark, sf_dir), "source_name", "ord").select("id", "source_name")


@query("blocklist", "SELECT page_id FROM pages WHERE NOT contains(url, 'blog.') AND NOT contains(url, '/fr/')")
def blocklist(spark, sf_dir):
    return ingest.without_blocked(table(spark, sf_dir, "pages"), "blog. , /fr/,,", F.col("url")).select("page_id")


LANG_SQL = "CASE lang WHEN 'en' THEN 'World' WHEN 'de' THEN 'technology' WHEN 'fr' THEN 'Technology' ELSE 'Politics' END"
FLAT_SQL = f"(SELECT source AS source_key, upper(source) || ' ' || category AS source_name, lang AS feed_id, category, 'https://' || source || '.example/' || lang AS url, CAST(row_number() OVER (PARTITION BY source ORDER BY lang) - 1 AS INTEGER) AS ord FROM (SELECT DISTINCT source, lang, {LANG_SQL} AS category FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL)) f"


def feeds(spark, sf_dir):
    """A registry of the documents' sources, with a feed for each of their languages."""
    each = table(spark, sf_dir, "documents").where("source is not null and lang is not null").select("source", "lang").distinct()
    category = F.when(F.col("lang") == "en", "World").when(F.col("lang") == "de", "technology").when(F.col("lang") == "fr", "Technology").otherwise("Politics")
    feed = F.struct(F.col("lang").alias("id"), category.alias("category"), F.concat(F.lit("https://"), "source", F.lit(".example/"), "lang").alias("url"))
    return ingest.flat_feeds(each.groupBy(F.col("source").alias("source_key"), F.upper("source").alias("name")).agg(F.array_sort(F.collect_list(feed)).alias("feeds")))


@query("flatten_feeds", f"SELECT * FROM {FLAT_SQL}")
def flatten_feeds(spark, sf_dir):
    return feeds(spark, sf_dir)


@query("feeds_by_category", f"SELECT category, list(url ORDER BY ord, url) AS urls FROM {FLAT_SQL} GROUP BY category")
def feeds_by_category(spark, sf_dir):
    return ingest.feeds_by_category(feeds(spark, sf_dir))


@query("source_summary", f"SELECT source_key, count(*) AS feeds, count(DISTINCT category) AS categories, list_sort(list(DISTINCT category)) AS names FROM {FLAT_SQL} GROUP BY source_key")
def source_summary(spark, sf_dir):
    return ingest.source_summary(feeds(spark, sf_dir))


@query("feed_categories", of_articles("SELECT category, min(ord) AS first_seen FROM articles GROUP BY category"))
def feed_categories(spark, sf_dir):
    return ingest.categories(articles(spark, sf_dir))


@query("orders_page", "SELECT o_orderkey, count(*) OVER () AS total_results, CAST(ceil(count(*) OVER () / 50.0) AS BIGINT) AS total_pages FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def orders_page(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return ingest.page(rows, 3, 50, F.desc("o_totalprice"), F.col("o_orderkey")).select("o_orderkey", "total_results", "total_pages")


@query("chunk_overlap", of_articles(""", s AS (SELECT cluster_key, count(*) AS n FROM members GROUP BY cluster_key), c AS (SELECT cluster_key, unnest(generate_series(0, n - 1, 5)) AS start, n FROM s)
SELECT c.cluster_key, c.start // 5 AS chunk, m.id FROM c JOIN members m ON m.cluster_key = c.cluster_key AND m.pos >= c.start AND m.pos < c.start + 8"""))
def chunk_overlap(spark, sf_dir):
    return ingest.chunks(members(spark, sf_dir), "cluster_key", "pos", 8, 3).select("cluster_key", "chunk", "id")


@query("chunk_fixed", of_articles("SELECT cluster_key, pos // 60 AS chunk, count(*) AS n FROM members GROUP BY ALL"))
def chunk_fixed(spark, sf_dir):
    return ingest.chunks(members(spark, sf_dir), "cluster_key", "pos", 60).groupBy("cluster_key", "chunk").agg(F.count("*").alias("n"))


@query("top_split", of_articles("SELECT cluster_key, pos < 4 AS is_top, count(*) AS n FROM members GROUP BY ALL"))
def top_split(spark, sf_dir):
    return ingest.split_top(members(spark, sf_dir), "pos").groupBy("cluster_key", "is_top").agg(F.count("*").alias("n"))


# --- addresses, markup, images ----------------------------------------------------------------------------------------------------


@query("url_parts", f"SELECT page_id, {HOST_SQL} AS host, {HOST_SQL} = 'news.google.com' AS aggregator FROM pages")
def url_parts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("host"), urls.is_aggregator(F.col("url")).alias("aggregator"))


@query("canonical_key", f"SELECT page_id, lower({KEY_SQL}) AS key FROM pages")
def canonical_key(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical_key(F.col("url"), F.lit(""), F.lit("")).alias("key"))


@query("page_hosts", f"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'news.google.com:site ' || page_id % 7 ELSE {HOST_SQL} END AS host FROM pages")
def page_hosts(spark, sf_dir):
    """Hosts of pages; every third comes through an aggregator and goes by its source's name."""
    rows = table(spark, sf_dir, "pages").withColumn("through", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://news.google.com/rss/articles/"), F.col("page_id").cast("string"))).otherwise(F.col("url")))
    return rows.select("page_id", urls.resolved_host(F.col("through"), F.lit(""), F.concat(F.lit("Site "), (F.col("page_id") % 7).cast("string"))).alias("host"))


@query("document_titles", "WITH d AS (SELECT doc_id, source, trim(regexp_extract(regexp_replace(text, '[^A-Za-z ]', '', 'g'), '^.{0,60}')) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 8 THEN t ELSE t || ' | ' || source END AS clean, source AS publisher FROM d WHERE t <> ''")
def document_titles(spark, sf_dir):
    """The beginnings of documents as titles with their source behind a bar, and behind a dash."""
    begin = F.trim(F.regexp_extract(F.regexp_replace("text", "[^A-Za-z ]", ""), "^.{0,60}", 0))
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", begin.alias("t")).where("t <> ''")
    return rows.select("doc_id", titles.clean(F.concat("t", F.lit(" | "), "source")).alias("clean"), titles.publisher(F.concat("t", F.lit(" - "), "source")).alias("publisher"))


FEED_SQL = "SELECT doc_id, doc_id // 50 AS feed, row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id) - 1 AS item, trim(regexp_extract(regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g'), '^.{0,80}')) AS t FROM documents"


@query("feed_quarantine", f"SELECT feed, item, CASE WHEN doc_id % 17 <> 0 THEN t END AS title, CASE WHEN doc_id % 17 <> 0 THEN 'https://feeds.example/' || doc_id END AS link, doc_id % 17 = 0 AS rejected FROM ({FEED_SQL})")
def feed_quarantine(spark, sf_dir):
    """Feeds of 50 documents each as they might have landed, one item in 17 malformed: every item is read or rejected."""
    from .sources import feeds as landed

    title = F.trim(F.regexp_extract(F.regexp_replace("text", "[^A-Za-z0-9 ]", ""), "^.{0,80}", 0))
    end = F.when(F.col("doc_id") % 17 == 0, "</titel></item>").otherwise(F.concat(F.lit("</title><link>https://feeds.example/"), F.col("doc_id").cast("string"), F.lit("</link><description>a&nbsp;b</description></item>")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 50).cast("string").alias("path"), F.concat(F.lit("<item><title>"), title, end).alias("x"))
    files = rows.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "x"))), lambda r: r["x"]), "\n").alias("x"))
    got = landed.read_items(files.select("path", F.encode(F.concat(F.lit("<rss><channel>"), "x", F.lit("</channel></rss>")), "UTF-8").alias("content")))
    return got.select(F.col("feed_file").cast("long").alias("feed"), F.col("item").cast("long").alias("item"), "title", "link", F.col("reason").isNotNull().alias("rejected"))


@query("resolve_host", f"SELECT page_id, CASE page_id % 4 WHEN 2 THEN 'news.google.com:site ' || page_id % 7 WHEN 3 THEN '' ELSE {HOST_SQL} END AS host FROM pages")
def resolve_host(spark, sf_dir):
    """Pages told by their source's address, by their own, by their source's name where both are an aggregator's, and by nothing."""
    way, link = F.col("page_id") % 4, F.lit("https://news.google.com/rss/articles/q")
    url = F.when(way == 1, F.col("url")).when(way == 3, "no address").otherwise(link)
    source = F.when(way == 0, F.col("url")).when(way == 1, "").when(way == 2, link).otherwise("none either")
    return table(spark, sf_dir, "pages").select("page_id", urls.resolved_host(url, source, F.concat(F.lit("Site "), (F.col("page_id") % 7).cast("string"))).alias("host"))


@query("html_strip", r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')) AS text FROM pages""")
def html_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.strip_html(F.col("html")).alias("text"))


IMG_SQL = """html || CASE WHEN page_id % 3 = 0 THEN '<img alt=''none''>' ELSE '' END || '<IMG class=''c'' src="https://i.example/' || page_id || '.png" width="' || page_id % 900 || '" height=' || page_id % 700 || '>'"""


@query("html_first_img", rf"""WITH t AS (SELECT page_id, regexp_extract({IMG_SQL}, '(?i)<img[^>]*>') AS tag FROM pages)
SELECT page_id, nullif(regexp_extract(tag, '(?i)\ssrc\s*=\s*"([^"]+)"', 1), '') AS src, TRY_CAST(regexp_extract(tag, '(?i)\swidth\s*=\s*"?([0-9]+)', 1) AS INTEGER) AS width, TRY_CAST(regexp_extract(tag, '(?i)\sheight\s*=\s*"?([0-9]+)', 1) AS INTEGER) AS height FROM t""")
def html_first_img(spark, sf_dir):
    """Pages with an image at their end; before every third of them stands one without a source."""
    none = F.when(F.col("page_id") % 3 == 0, "<img alt='none'>").otherwise("")
    tag = F.format_string("<IMG class='c' src=\"https://i.example/%d.png\" width=\"%d\" height=%d>", "page_id", F.col("page_id") % 900, F.col("page_id") % 700)
    rows = table(spark, sf_dir, "pages").select("page_id", images.first_img(F.concat("html", none, tag)).alias("i"))
    return rows.select("page_id", "i.*")


W_PX, H_PX = "(page_id % 9 + 1) * 80", "(page_id % 7 + 1) * 60"
IMAGE_SQL = f"""CASE page_id % 5 WHEN 0 THEN 'https://ichef.bbci.co.uk/ace/standard/' || W || '/cps/' || page_id || '.jpg' WHEN 1 THEN 'https://ichef.bbci.co.uk/news/' || W || '/' || page_id || '.jpg'
  WHEN 2 THEN 'https://ichef.bbci.co.uk/images/ic/' || W || '/p.jpg' WHEN 3 THEN 'https://i.guim.co.uk/img/m.jpg?width=' || {W_PX} || '&quality=85' ELSE url END"""


@query("image_dims", f"""WITH d AS (SELECT page_id, {IMAGE_SQL.replace("W ||", "CASE WHEN page_id % 5 = 2 THEN '976x976' ELSE '976' END ||")} AS better, CASE WHEN page_id % 5 < 4 THEN CAST({W_PX} AS INTEGER) END AS width, CASE WHEN page_id % 5 = 2 THEN CAST({H_PX} AS INTEGER) END AS height FROM pages)
SELECT *, NOT coalesce(width < 320, false) AND NOT coalesce(height < 200, false) AS fits FROM d""")
def image_dims(spark, sf_dir):
    """Addresses that tell a width, both sizes or none."""
    w, h = (F.expr(x).cast("string") for x in (W_PX, H_PX))
    way, bbc, n = F.col("page_id") % 5, F.lit("https://ichef.bbci.co.uk/"), F.concat(F.col("page_id").cast("string"), F.lit(".jpg"))
    url = F.when(way == 0, F.concat(bbc, F.lit("ace/standard/"), w, F.lit("/cps/"), n)).when(way == 1, F.concat(bbc, F.lit("news/"), w, F.lit("/"), n)).when(way == 2, F.concat(bbc, F.lit("images/ic/"), w, F.lit("x"), h, F.lit("/p.jpg")))
    url = url.when(way == 3, F.concat(F.lit("https://i.guim.co.uk/img/m.jpg?width="), w, F.lit("&quality=85"))).otherwise(F.col("url"))
    rows = table(spark, sf_dir, "pages").select("page_id", url.alias("url")).withColumn("d", images.inferred_dims(F.col("url")))
    return rows.select("page_id", images.normalized(F.col("url")).alias("better"), "d.width", "d.height", images.large_enough(F.col("d.width"), F.col("d.height"), 320, 200).alias("fits"))


@query("image_pick", of_articles("SELECT id, CASE WHEN url_to_image = '' THEN 'https://placehold.co/600x400?text=' || source_name ELSE url_to_image END AS image, url_to_image <> '' AND NOT contains(url_to_image, 'placehold.co') AS useful FROM articles"))
def image_pick(spark, sf_dir):
    image = F.col("url_to_image")
    return articles(spark, sf_dir).select("id", F.coalesce(images.picked(image), urls.image_or_placeholder(image, F.col("source_name"))).alias("image"), images.is_useful(image).alias("useful"))


# --- titles -----------------------------------------------------------------------------------------------------------------------

BEGIN_SQL = "SELECT doc_id, source, trim(regexp_extract(regexp_replace(text, '[^A-Za-z ]', '', 'g'), '^.{0,60}')) AS t FROM documents WHERE source IS NOT NULL"


def begins(spark, sf_dir):
    """(doc_id, source, t): the letters that documents begin with."""
    begin = F.trim(F.regexp_extract(F.regexp_replace("text", "[^A-Za-z ]", ""), "^.{0,60}", 0))
    return table(spark, sf_dir, "documents").where("source is not null").select("doc_id", "source", begin.alias("t")).where("t <> ''")


@query("title_clean", f"""SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN t || ' - ' || source ELSE CASE WHEN length(t) > 8 THEN t WHEN doc_id % 4 = 0 THEN t || ' – ' || source WHEN doc_id % 4 = 1 THEN t || ' | ' || source WHEN length(t) > 1 THEN t || ' – News' ELSE t || ' – News | ' || source END END AS clean,
CASE WHEN doc_id % 4 = 3 THEN source END AS publisher FROM ({BEGIN_SQL}) WHERE t <> ''""")
def title_clean(spark, sf_dir):
    """Beginnings of documents with their source behind a dash, a bar, both, or a hyphen."""
    way = F.col("doc_id") % 4
    mark = F.when(way == 0, " – ").when(way == 1, " | ").when(way == 2, " – News | ").otherwise(" - ")
    title = F.concat("t", mark, "source")
    return begins(spark, sf_dir).select("doc_id", titles.clean(title).alias("clean"), titles.publisher(title).alias("publisher"))


@query("publisher_name", f"SELECT doc_id, CASE doc_id % 5 WHEN 2 THEN upper(source[1]) || source[2:] WHEN 4 THEN 'Google News' ELSE source END AS name FROM ({BEGIN_SQL}) WHERE t <> ''")
def publisher_name(spark, sf_dir):
    """Items that name their source, whose title does, whose address does, without a name, and with the aggregator's alone."""
    way = F.col("doc_id") % 5
    name = F.when(way == 0, F.col("source")).when(way == 2, F.concat(F.lit("https://www."), "source", F.lit(".example/a"))).when(way != 3, "Google News")
    title = F.when(way.isin(1, 3), F.concat("t", F.lit(" - "), "source")).otherwise(F.col("t"))
    return begins(spark, sf_dir).select("doc_id", titles.source_name(name, title, F.lit("Google News")).alias("name"))


@query("short_hash", r"""SELECT doc_id, list_reduce(list_prepend(CAST(0 AS HUGEINT), list_transform(string_split(text, ''), lambda c: CAST(unicode(c) AS HUGEINT))), lambda h, c: (h * 31 + c + 2147483648) % 4294967296 - 2147483648 + CASE WHEN (h * 31 + c + 2147483648) % 4294967296 < 0 THEN 4294967296 ELSE 0 END)::BIGINT AS hash FROM documents""")
def short_hash(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", hashing.short_hash(F.col("text")).alias("h"), F.col("text").alias("c"))
    # back to the signed number: base 36 loses the sign, so it is taken from the fold itself
    value = F.aggregate(F.filter(F.split("c", ""), lambda x: x != ""), F.lit(0).cast("long"), lambda h, x: F.pmod(h * 31 + F.ascii(x) + (1 << 31), F.lit(1 << 32)) - (1 << 31))
    return rows.where(F.conv("h", 36, 10).cast("long") == F.abs(value)).select("doc_id", value.alias("hash"))


HASH_SQL = "list_reduce(list_prepend(CAST(0 AS HUGEINT), list_transform(string_split(TEXT, ''), lambda c: CAST(unicode(c) AS HUGEINT))), lambda h, c: ((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)"


@query("cluster_id", of_articles(f"""SELECT cluster_key, 'cluster-' || lower(to_base(CAST(abs({HASH_SQL.replace("TEXT", "array_to_string(ids, '|')")}) AS BIGINT), 36)) AS id, 'cluster-' || array_to_string(ids, '-') AS summary_id FROM (SELECT cluster_key, list(id ORDER BY id) AS ids FROM members GROUP BY ALL)"""))
def cluster_id(spark, sf_dir):
    return clusters(members(spark, sf_dir)).select("cluster_key", hashing.set_id(F.col("article_ids")).alias("id"), digest.cluster_summary_id(F.col("article_ids"), F.col("cluster_title")).alias("summary_id"))


# --- text, TF-IDF, similarity -----------------------------------------------------------------------------------------------------

TF_SQL = f"tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({sql_tokens('text')}) AS term FROM documents) GROUP BY ALL)"
W_SQL = f"{TF_SQL}, df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), w AS (SELECT doc_id, tf.term, tf, (1 + ln(tf)) * ln(1 + (SELECT count(*) FROM documents) / (1.0 + df)) AS w FROM tf JOIN df USING (term)), nm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id)"


def postings(spark, sf_dir):
    return tfidf.weights(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))


def saved_postings(spark, sf_dir):
    """(doc_id, term, w), written down. Terms are counted once, and what leads to the table is deleted, so that disk holds it alone."""
    docs = table(spark, sf_dir, "documents")
    tf = saved(tfidf.term_freq(docs, "doc_id", F.col("text")))
    swept(spark)
    p = saved(tfidf.weighed(tf, docs, "doc_id").select("doc_id", "term", "w"))
    dropped(tf)
    swept(spark)
    return p


@query("tokenize", f"SELECT doc_id, array_to_string({sql_tokens('text')}, ' ') AS tokens FROM documents")
def tokenize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.tokens(F.col("text")), " ").alias("tokens"))


@query("title_tokens", of_articles(f"SELECT id, array_to_string(list_sort(list_distinct({sql_tokens('title')})), ' ') AS tokens FROM articles"))
def title_tokens(spark, sf_dir):
    return articles(spark, sf_dir).select("id", F.array_join(F.array_sort(text.title_tokens(F.col("title"))), " ").alias("tokens"))


@query("term_freq", f"WITH {TF_SQL} SELECT * FROM tf")
def term_freq(spark, sf_dir):
    return tfidf.term_freq(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))


@query("doc_freq", f"WITH {TF_SQL} SELECT term, count(*) AS df FROM tf GROUP BY term")
def doc_freq(spark, sf_dir):
    return tfidf.doc_freq(tfidf.term_freq(table(spark, sf_dir, "documents"), "doc_id", F.col("text")))


@query("tfidf_weights", f"WITH {W_SQL} SELECT doc_id, term, tf, round(w, 4) AS w FROM w")
def tfidf_weights(spark, sf_dir):
    return postings(spark, sf_dir).select("doc_id", "term", "tf", F.round("w", 4).alias("w"))


@query("tfidf_norms", f"WITH {W_SQL} SELECT doc_id, round(norm, 4) AS norm FROM nm")
def tfidf_norms(spark, sf_dir):
    return tfidf.norms(postings(spark, sf_dir), "doc_id").select("doc_id", F.round("norm", 4).alias("norm"))


@query("cosine_pairs", f"WITH {W_SQL}, u AS (SELECT doc_id, term, w / norm AS u FROM w JOIN nm USING (doc_id)) SELECT a.doc_id AS a, b.doc_id AS b, round(least(1.0, sum(a.u * b.u)), 4) AS sim FROM u a JOIN u b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY ALL HAVING round(least(1.0, sum(a.u * b.u)), 4) >= 0.42")
def cosine_pairs(spark, sf_dir):
    sim = F.round("sim", 4)
    p = saved_postings(spark, sf_dir)
    own = tfidf.vectors(p, "doc_id")
    dropped(p)
    swept(spark)
    return tfidf.near_vectors(own, 0.4199).select("a", "b", sim.alias("sim")).where("sim >= 0.42")


CENTRE_SQL = f"{W_SQL}, c AS (SELECT doc_id % {CLUSTERS} AS g, term, sum(w) AS w FROM w GROUP BY ALL), cn AS (SELECT g, sqrt(sum(w * w)) AS norm FROM c GROUP BY g)"


def groups(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % CLUSTERS).alias("g"))


@query("centroids", f"WITH {CENTRE_SQL} SELECT g, term, round(w, 4) AS w FROM c")
def centroids(spark, sf_dir):
    return tfidf.centroids(postings(spark, sf_dir), groups(spark, sf_dir), "doc_id", "g").select("g", "term", F.round("w", 4).alias("w"))


@query("nearest_centroid", f"WITH {CENTRE_SQL}, s AS (SELECT doc_id, g, sum(w.w * c.w) / any_value(nm.norm) / any_value(cn.norm) AS sim FROM w JOIN c USING (term) JOIN nm USING (doc_id) JOIN cn USING (g) GROUP BY doc_id, g) SELECT doc_id, round(max(sim), 4) AS sim, arg_min(g, (-round(sim, 9), g)) AS g FROM s GROUP BY doc_id")
def nearest_centroid(spark, sf_dir):
    p = saved_postings(spark, sf_dir)  # norms, centres and similarities all read them
    sims = tfidf.to_centroids(p, saved(tfidf.centroids(p, groups(spark, sf_dir), "doc_id", "g")), "doc_id", "g")
    return tfidf.nearest(sims.withColumn("sim", F.round("sim", 9)), "doc_id", "g").select("doc_id", F.round("sim", 4).alias("sim"), "g")


@query("entities", f"SELECT doc_id, array_to_string(list_sort({sql_entities('text')}), ' ') AS entities FROM documents")
def entities_query(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(entities.entities(F.col("text"))), " ").alias("entities"))


ENTITY_SQL = f""", ct AS (SELECT cluster_key, array_to_string(list_prepend((list(title ORDER BY pos))[1], list(title ORDER BY pos) FILTER (pos < 10 AND title <> '')), '. ') AS text FROM members GROUP BY cluster_key),
ce AS (SELECT cluster_key, entity FROM (SELECT cluster_key, unnest({sql_entities('text')}) AS entity FROM ct) WHERE length(entity) >= 4)"""


@query("cluster_entities", of_articles("SELECT * FROM ce", ENTITY_SQL))
def cluster_entities(spark, sf_dir):
    m = members(spark, sf_dir)
    return stories.cluster_entities(clusters(m), m.select("cluster_key", "pos", "id"), m)


@query("jaccard_entities", of_articles(", z AS (SELECT cluster_key, count(*) AS n FROM ce GROUP BY ALL) SELECT a.cluster_key AS a, b.cluster_key AS b, count(*) AS shared, round(count(*) / (any_value(za.n) + any_value(zb.n) - count(*)), 6) AS jaccard FROM ce a JOIN ce b ON a.entity = b.entity AND a.cluster_key < b.cluster_key JOIN z za ON za.cluster_key = a.cluster_key JOIN z zb ON zb.cluster_key = b.cluster_key GROUP BY a.cluster_key, b.cluster_key", ENTITY_SQL))
def jaccard_entities(spark, sf_dir):
    return stories.jaccards(cluster_entities(spark, sf_dir), "entity").withColumn("jaccard", F.round("jaccard", 6))


@query("jaccard_titles", of_articles(f""", t AS (SELECT DISTINCT doc_id AS cluster_key, unnest({sql_tokens('title')}) AS tok FROM articles), z AS (SELECT cluster_key, count(*) AS n FROM t GROUP BY ALL), p AS (SELECT a.cluster_key AS a, b.cluster_key AS b, count(*) AS shared FROM t a JOIN t b ON a.tok = b.tok AND a.cluster_key < b.cluster_key GROUP BY ALL)
SELECT a, b, shared, round(shared / (za.n + zb.n - shared), 6) AS jaccard FROM p JOIN z za ON za.cluster_key = a JOIN z zb ON zb.cluster_key = b WHERE shared / (za.n + zb.n - shared) >= 0.7"""))
def jaccard_titles(spark, sf_dir):
    sets = articles(spark, sf_dir).select(F.col("doc_id").alias("cluster_key"), F.explode(text.title_tokens(F.col("title"))).alias("tok"))
    return stories.jaccards(sets, "tok", 0.7).withColumn("jaccard", F.round("jaccard", 6))


@query("jaccard_members", """WITH s AS (SELECT DISTINCT o_custkey % 50 AS k, o_orderdate::DATE AS d FROM orders), z AS (SELECT k, count(*) AS n FROM s GROUP BY k)
SELECT a.k AS a, b.k AS b, count(*) AS shared, round(count(*) / (any_value(za.n) + any_value(zb.n) - count(*)), 6) AS jaccard FROM s a JOIN s b ON a.d = b.d AND a.k < b.k JOIN z za ON za.k = a.k JOIN z zb ON zb.k = b.k GROUP BY a.k, b.k""")
def jaccard_members(spark, sf_dir):
    sets = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("cluster_key"), F.to_date("o_orderdate").alias("d")).distinct()
    return stories.jaccards(sets, "d").withColumn("jaccard", F.round("jaccard", 6))


# --- members, pairs of clusters ---------------------------------------------------------------------------------------------------


@query("members_semi", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def members_semi(spark, sf_dir):
    docs, marks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return stories.members_of(docs, marks).select(F.col("id").alias("doc_id"))


@query("unclustered_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unclustered_anti(spark, sf_dir):
    docs, marks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return stories.unclustered(docs, marks).select(F.col("id").alias("doc_id"))


@query("customers_without_orders", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')")
def customers_without_orders(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_orderstatus = 'P' and o_orderpriority = '1-URGENT'").select("o_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("cluster_lookup", of_articles("SELECT cluster_key, pos, id, title FROM members"))
def cluster_lookup(spark, sf_dir):
    m = members(spark, sf_dir)
    found = stories.lookup(stories.exploded(clusters(m)), articles(spark, sf_dir))
    return found.select("cluster_key", long(F.col("pos")).alias("pos"), "id", "title")


@query("dominant_category", of_articles("SELECT cluster_key, category FROM (SELECT cluster_key, category, row_number() OVER (PARTITION BY cluster_key ORDER BY count(*) DESC, min(pos)) AS r FROM members GROUP BY cluster_key, category) WHERE r = 1"))
def dominant_category(spark, sf_dir):
    return stories.dominant(members(spark, sf_dir), ["cluster_key"], "category", "pos")


@query("dominant_segment", "SELECT c_nationkey, c_mktsegment FROM (SELECT c_nationkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, min(c_custkey)) AS r FROM customer GROUP BY c_nationkey, c_mktsegment) WHERE r = 1")
def dominant_segment(spark, sf_dir):
    return stories.dominant(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_mktsegment", "c_custkey")


AW_SQL = f""", atf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({sql_tokens("title || ' ' || description || ' ' || substring(content, 1, 500)")}) AS term FROM articles) GROUP BY ALL), adf AS (SELECT term, count(*) AS df FROM atf GROUP BY term),
aw AS (SELECT id, atf.term, (1 + ln(tf)) * ln(1 + (SELECT count(*) FROM articles) / (1.0 + df)) AS w FROM atf JOIN adf USING (term)), au AS (SELECT id, term, w, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS u FROM aw)"""


def article_postings(rows):
    return tfidf.weights(rows, "id", text.doc_text(F.col("title"), F.col("description"), F.col("content")))


CROSS_SQL = """, x AS (SELECT p.a, p.b, ma.id AS x, mb.id AS y FROM p JOIN members ma ON ma.cluster_key = p.a JOIN members mb ON mb.cluster_key = p.b JOIN (SELECT cluster_key, count(*) AS nb FROM members GROUP BY ALL) n ON n.cluster_key = p.b WHERE ma.pos * nb + mb.pos < 20),
xs AS (SELECT a, b, x, y, coalesce((SELECT sum(l.u * r.u) FROM au l JOIN au r ON l.term = r.term WHERE l.id = x AND r.id = y), 0) AS dot FROM x), sims AS (SELECT a, b, avg(dot) AS sim FROM xs GROUP BY a, b)"""


@query("cross_cluster_sim", of_articles("SELECT a, b, round(sim, 6) AS sim FROM sims", AW_SQL + f", k AS (SELECT unnest(range(0, {CLUSTERS})) AS k), p AS (SELECT l.k AS a, r.k AS b FROM k l JOIN k r ON l.k < r.k)" + CROSS_SQL))
def cross_cluster_sim(spark, sf_dir):
    m = members(spark, sf_dir)
    pairs = spark.range(CLUSTERS).select(F.col("id").alias("a"), F.explode(F.sequence(F.col("id") + 1, F.lit(CLUSTERS))).alias("b")).where(F.col("b") < CLUSTERS)
    return stories.cross_similarity(pairs, m.select("cluster_key", "pos", "id"), article_postings(m)).withColumn("sim", F.round("sim", 6))


@query("related_links", of_articles("""SELECT cluster_key, related_key, round(sim, 6) AS sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster_key ORDER BY round(sim, 9) DESC, least(cluster_key, related_key), greatest(cluster_key, related_key)) AS rank
  FROM (SELECT a AS cluster_key, b AS related_key, sim FROM sims WHERE sim >= 0.03 UNION ALL SELECT b, a, sim FROM sims WHERE sim >= 0.03)) WHERE rank <= 5""", ENTITY_SQL + AW_SQL + ", p AS (SELECT a.cluster_key AS a, b.cluster_key AS b FROM ce a JOIN ce b ON a.entity = b.entity AND a.cluster_key < b.cluster_key GROUP BY ALL HAVING count(*) >= 2)" + CROSS_SQL))
def related_links(spark, sf_dir):
    m = members(spark, sf_dir)
    out = stories.related(clusters(m), m.select("cluster_key", "pos", "id"), articles(spark, sf_dir))
    return out.select("cluster_key", "related_key", F.round("sim", 6).alias("sim"), long(F.col("rank")).alias("rank"))


@query("expand_members", of_articles(f""", g AS (SELECT cluster_key, id, category, published_at, pos FROM members), c AS (SELECT cluster_key, term, sum(w) AS w FROM g JOIN aw USING (id) GROUP BY ALL), cu AS (SELECT cluster_key, term, w / sqrt(sum(w * w) OVER (PARTITION BY cluster_key)) AS u FROM c),
s AS (SELECT cluster_key, id, least(1.0, sum(au.u * cu.u)) AS sim FROM au JOIN cu USING (term) GROUP BY ALL HAVING least(1.0, sum(au.u * cu.u)) >= 0.18), d AS (SELECT cluster_key, category FROM (SELECT cluster_key, category, row_number() OVER (PARTITION BY cluster_key ORDER BY count(*) DESC, min(pos)) AS r FROM g GROUP BY cluster_key, category) WHERE r = 1),
l AS (SELECT cluster_key, max(published_at) AS latest FROM g GROUP BY ALL), f AS (SELECT s.*, a.ord FROM s JOIN articles a USING (id) JOIN d ON d.cluster_key = s.cluster_key AND d.category = a.category JOIN l ON l.cluster_key = s.cluster_key AND abs((epoch_us(latest) // 1000) - (epoch_us(a.published_at) // 1000)) <= 48 * 3600000 WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.cluster_key = s.cluster_key AND g.id = s.id))
SELECT cluster_key, id, round(sim, 6) AS sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster_key ORDER BY round(sim, 9) DESC, ord) AS rank FROM f) WHERE rank <= 15""", AW_SQL))
def expand_members(spark, sf_dir):
    rows = articles(spark, sf_dir)
    out = stories.expanded(members(spark, sf_dir).select("cluster_key", "pos", "id"), rows, article_postings(rows), 0.18)
    return out.select("cluster_key", "id", F.round("sim", 6).alias("sim"), long(F.col("rank")).alias("rank"))


@query("llm_groups_apply", of_articles("""SELECT "group", array_to_string(list(id ORDER BY cluster_key, pos), ',') AS ids FROM (SELECT *, CASE WHEN cluster_key % 3 < 2 THEN cluster_key // 3 ELSE -1 - cluster_key END AS "group" FROM members) GROUP BY ALL"""))
def llm_groups_apply(spark, sf_dir):
    """Of each three clusters the first two belong together."""
    own = clusters(members(spark, sf_dir))
    groups = own.where("cluster_key % 3 < 2").select(F.floor(F.col("cluster_key") / 3).alias("group"), "cluster_key")
    return stories.apply_groups(own, groups).select("group", F.array_join("ids", ",").alias("ids"))


# --- enrichment, scores -----------------------------------------------------------------------------------------------------------

DEDUPED_SQL = f""", d1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_key, {KEY_SQL} ORDER BY pos) AS r1 FROM members) WHERE r1 = 1),
d2 AS (SELECT * FROM (SELECT *, {HOST_SQL} AS host, row_number() OVER (PARTITION BY cluster_key, {HOST_SQL}, lower(trim(title)) ORDER BY pos) AS r2 FROM d1) WHERE r2 = 1)"""
SHOWN_SQL = """, d3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_key, host ORDER BY published_at DESC, pos) AS r3 FROM d2) WHERE r3 <= 2),
d4 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_key ORDER BY published_at DESC, pos) AS shown FROM d3) WHERE shown <= 10)"""
IMAGES_SQL = """, i1 AS (SELECT cluster_key, shown AS place, url_to_image, image_width, 0 AS late FROM d4 UNION ALL SELECT cluster_key, pos, url_to_image, image_width, 1 FROM d2),
i2 AS (SELECT * FROM i1 WHERE url_to_image <> '' AND NOT contains(url_to_image, 'placehold.co')), i3 AS (SELECT cluster_key, url_to_image, min(place) AS place FROM i2 JOIN (SELECT cluster_key, min(late) AS use FROM i2 GROUP BY ALL) USING (cluster_key) WHERE late = use AND image_width >= 320 GROUP BY ALL),
im AS (SELECT cluster_key, (list(url_to_image ORDER BY place, url_to_image))[1:4] AS image_urls FROM i3 GROUP BY cluster_key)"""


def shown_of(spark, sf_dir):
    once = enrich.deduped(enrich.valid(members(spark, sf_dir)))
    return once, enrich.diverse(once, 2, 10)


@query("enrich_dedupe", of_articles("SELECT cluster_key, id FROM d2", DEDUPED_SQL))
def enrich_dedupe(spark, sf_dir):
    return shown_of(spark, sf_dir)[0].select("cluster_key", "id")


@query("domain_cap", of_articles("SELECT cluster_key, id, shown FROM d4", DEDUPED_SQL + SHOWN_SQL))
def domain_cap(spark, sf_dir):
    return shown_of(spark, sf_dir)[1].select("cluster_key", "id", long(F.col("shown")).alias("shown"))


@query("enrich_images", of_articles("SELECT cluster_key, array_to_string(image_urls, ' ') AS image_urls FROM im", DEDUPED_SQL + SHOWN_SQL + IMAGES_SQL))
def enrich_images(spark, sf_dir):
    once, shown = shown_of(spark, sf_dir)
    return enrich.images(shown, once).select("cluster_key", F.array_join("image_urls", " ").alias("image_urls"))


META_SQL = "(VALUES ('Sports', 0, 'Other'), ('Technology', 1, 'Tech/Business'), ('Business', 2, 'Economy/Markets'), ('Politics', 3, 'National Politics')) m(category, level, label)"
DOM_SQL = ", dom AS (SELECT cluster_key, category FROM (SELECT cluster_key, category, row_number() OVER (PARTITION BY cluster_key ORDER BY count(*) DESC, min(pos)) AS r FROM members GROUP BY cluster_key, category) WHERE r = 1)"
SEV_SQL = DOM_SQL + f", sev AS (SELECT cluster_key, coalesce(level, 0) AS level, coalesce(label, 'Other') AS label, CASE WHEN label IS NOT NULL THEN category END AS reason, label IS NULL AS ambiguous FROM dom LEFT JOIN {META_SQL} USING (category))"


@query("severity", of_articles("SELECT * FROM sev", SEV_SQL))
def severity(spark, sf_dir):
    return ranking.severity(members(spark, sf_dir), dims.category_meta(spark))


SCORE_SQL = SEV_SQL + f""", cov AS (SELECT cluster_key, count(*) AS n, count(DISTINCT nullif({HOST_SQL}, '')) AS domains, count(*) FILTER ((epoch_us(TIMESTAMP '{AS_OF}') // 1000) - (epoch_us(published_at) // 1000) <= 14400000) AS recent FROM members GROUP BY ALL),
sc AS (SELECT cluster_key, n, domains, recent, label, (0.6::DOUBLE * ln(1 + n) + 0.8::DOUBLE * ln(1 + domains) + 0.4::DOUBLE * (CASE WHEN coalesce(len(image_urls), 0) >= 2 THEN 2 WHEN len(image_urls) >= 1 THEN 1 ELSE -2 END) + 1.5::DOUBLE * (recent / n) * ln(1 + recent)) * (CASE label WHEN 'National Politics' THEN 1.15 WHEN 'Economy/Markets' THEN 1.1 WHEN 'Tech/Business' THEN 1.05 ELSE 1 END)::DOUBLE AS score FROM cov JOIN sev USING (cluster_key) LEFT JOIN im USING (cluster_key))"""


def scores(spark, sf_dir):
    once, shown = shown_of(spark, sf_dir)
    return ranking.scored(members(spark, sf_dir), enrich.images(shown, once), dims.category_meta(spark), as_of())


@query("cluster_score", of_articles("SELECT cluster_key, n, domains, recent, label, round(score, 6) AS score FROM sc", DEDUPED_SQL + SHOWN_SQL + IMAGES_SQL + SCORE_SQL))
def cluster_score(spark, sf_dir):
    return scores(spark, sf_dir).select("cluster_key", "n", "domains", "recent", "label", F.round("score", 6).alias("score"))


@query("ranked_clusters", of_articles("SELECT cluster_key, round(score, 6) AS score FROM sc ORDER BY round(score, 6) DESC, cluster_key LIMIT 10", DEDUPED_SQL + SHOWN_SQL + IMAGES_SQL + SCORE_SQL))
def ranked_clusters(spark, sf_dir):
    return scores(spark, sf_dir).select("cluster_key", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "cluster_key").limit(10)


@query("llm_align_defaults", of_articles(", top AS (SELECT cluster_key, ambiguous FROM sc JOIN sev USING (cluster_key) ORDER BY score DESC, cluster_key LIMIT 8) SELECT cluster_key, CASE WHEN t.ambiguous AND cluster_key % 2 = 0 THEN 'War/Conflict' ELSE label END AS label FROM sc LEFT JOIN top t USING (cluster_key)", DEDUPED_SQL + SHOWN_SQL + IMAGES_SQL + SCORE_SQL))
def llm_align_defaults(spark, sf_dir):
    answers = spark.range(0, CLUSTERS, 2).select(F.col("id").alias("cluster_key"), F.lit(5).alias("level"), F.lit("War/Conflict").alias("label"))
    return ranking.reassessed(scores(spark, sf_dir), answers).select("cluster_key", "label")


# --- topics -----------------------------------------------------------------------------------------------------------------------

PATTERNS = {t: [p.replace(topics.WORD_START, r'\b').replace(topics.WORD_END, r'\b') for p in topics.patterns(t)] for t in dims.TOPIC_KEYWORDS}


def sql_score(c: str, topic: str) -> str:
    return "(" + " + ".join(f"CAST(regexp_matches({c}, '{p}') AS INT)" for p in PATTERNS[topic]) + ")"


@query("keyword_score", "SELECT doc_id, " + ", ".join(f"CAST({sql_score('text', t)} AS BIGINT) AS t{i}" for i, t in enumerate(PATTERNS)) + " FROM documents")
def keyword_score(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *[long(topics.keyword_score(F.col("text"), t)).alias(f"t{i}") for i, t in enumerate(PATTERNS)])


@query("topic_match", "SELECT p_partkey, " + sql_score("p_name", "Technology") + " > 0 AS tech FROM part")
def topic_match(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", topics.matches(F.col("p_name"), "Technology").alias("tech"))


HITS_SQL = " UNION ALL ".join(f"SELECT {i} AS o, '{t}' AS topic, w FROM x WHERE {sql_score('t', t)} > 0" for i, t in enumerate(PATTERNS))


@query("trending_topics", of_articles(f""", x AS (SELECT title || ' ' || coalesce(description, '') AS t, exp(-greatest(0, {HOURS}) / 24) AS w FROM articles UNION ALL
SELECT any_value(ct.t), 2 * exp(-greatest(0, any_value({HOURS})) / 24) FROM members JOIN (SELECT cluster_key, string_agg(title, ' ' ORDER BY pos) AS t FROM members GROUP BY ALL) ct USING (cluster_key) WHERE pos = 0 GROUP BY cluster_key), h AS ({HITS_SQL})
SELECT topic, round(sum(w), 6) AS score FROM h GROUP BY topic, o ORDER BY round(sum(w), 9) DESC, o LIMIT 10"""))
def trending_topics(spark, sf_dir):
    m = members(spark, sf_dir).groupBy("cluster_key").agg(F.array_sort(F.collect_list(F.struct("pos", "title", "published_at"))).alias("m"))
    c = m.select(F.array_join(F.transform("m", lambda x: x["title"]), " ").alias("text"), F.col("m")[0]["published_at"].alias("latest"))
    return topic_ops.trending(articles(spark, sf_dir), c, as_of()).withColumn("score", F.round("score", 6))


@query("fallback_topics", of_articles("SELECT category, count(*) AS n FROM (SELECT category, ord FROM articles UNION ALL SELECT category, ord FROM members) GROUP BY category ORDER BY n DESC, min(ord) LIMIT 4"))
def fallback_topics(spark, sf_dir):
    return topic_ops.fallback(articles(spark, sf_dir), members(spark, sf_dir), 4)


@query("categories_present", of_articles("SELECT DISTINCT category FROM articles"))
def categories_present(spark, sf_dir):
    return topic_ops.present(articles(spark, sf_dir), members(spark, sf_dir))


@query("filter_by_topic", of_articles(f"SELECT id, CAST({sql_score('''title || ' ' || coalesce(description, '')''', 'World')} AS BIGINT) AS keyword_score FROM articles WHERE category = 'World News'"))
def filter_by_topic(spark, sf_dir):
    line = F.concat_ws(" ", "title", F.coalesce("description", F.lit("")))
    return topic_ops.view(articles(spark, sf_dir), "category", line, dims.category_alias(spark), "World").select("id", "keyword_score")


ALIAS_SQL = sql_values(sorted({(t, a.lower()) for t, names in dims.CATEGORY_ALIASES.items() for a in [*names, t]}), "topic, category_lc")


@query("topic_bar", of_articles(f"SELECT topic, count(*) AS n, round(count(*) + sum(exp(-greatest(0, {HOURS}) / 24)), 6) AS score FROM articles JOIN {ALIAS_SQL} ON lower(category) = category_lc GROUP BY topic"))
def topic_bar(spark, sf_dir):
    return topic_ops.bar(articles(spark, sf_dir), "category", "published_at", dims.category_alias(spark), as_of()).withColumn("score", F.round("score", 6))


@query("recency_weight", "SELECT event_id, round(exp(-greatest(0, ((epoch_us(TIMESTAMP '2024-01-15') // 1000) - (epoch_us(ts) // 1000)) / 3.6e6) / 24), 6) AS w FROM events")
def recency_weight(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(times.recency_weight(F.col("ts"), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")), 6).alias("w"))


@query("hours_between", "SELECT event_id, abs((epoch_us(TIMESTAMP '2024-01-15') // 1000) - (epoch_us(ts) // 1000)) / 3.6e6 AS hours FROM events")
def hours_between(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", times.hours_between(F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"), F.col("ts")).alias("hours"))


# --- state ------------------------------------------------------------------------------------------------------------------------


@query("feed_health", """SELECT count(*) AS total, count(*) FILTER (event_type <> 'error') AS ok, round(count(*) FILTER (event_type <> 'error') * 100.0 / count(*), 6)::DOUBLE AS ok_percent, round(avg(user_id) FILTER (event_type <> 'error'), 6) AS mean_items,
round(avg(value) FILTER (event_type <> 'error'), 6) AS mean_ms, count(*) FILTER (event_type <> 'error' AND user_id = 0) AS empty, count(*) FILTER (value > 5000) AS slow FROM events""")
def feed_health(spark, sf_dir):
    out = state.health(table(spark, sf_dir, "events"), "user_id", F.col("user_id"), F.col("value"), F.when(F.col("event_type") == "error", "timeout"))
    return out.select("total", "ok", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("ok_percent", "mean_items", "mean_ms")], "empty", "slow")


@query("error_classes", "SELECT CASE event_type WHEN 'error' THEN 'timeout' WHEN 'click' THEN 'not found' ELSE 'other' END AS class, count(*) AS n FROM events GROUP BY 1")
def error_classes(spark, sf_dir):
    message = F.when(F.col("event_type") == "error", "Request TIMEOUT").when(F.col("event_type") == "click", "Status code 404").otherwise("odd")
    return table(spark, sf_dir, "events").groupBy(state.error_class(message).alias("class")).agg(F.count("*").alias("n"))


LOG_SQL = "log AS (SELECT CASE user_id % 2 WHEN 0 THEN 'main:' ELSE 'old:' END AS ns, event_type || '-' || user_id // 4 AS key, CAST(event_id AS VARCHAR) AS value, ts, ts + CASE WHEN event_id % 3 = 0 THEN INTERVAL 1 HOUR ELSE INTERVAL 20 DAY END AS expires_at, event_id AS seq FROM events)"


def cache_log(spark, sf_dir):
    hours = F.when(F.col("event_id") % 3 == 0, 1).otherwise(480)
    return table(spark, sf_dir, "events").select(
        F.when(F.col("user_id") % 2 == 0, "main:").otherwise("old:").alias("ns"), F.concat_ws("-", "event_type", F.floor(F.col("user_id") / 4).cast("string")).alias("key"), F.col("event_id").cast("string").alias("value"),
        F.col("ts").alias("written_at"), F.timestamp_add("HOUR", hours, F.col("ts")).alias("expires_at"), F.col("event_id").alias("seq"),
    )


@query("cache_read", f"WITH {LOG_SQL}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ns, key ORDER BY ts DESC, seq DESC) AS r FROM log) WHERE r = 1 AND expires_at > TIMESTAMP '2024-01-25') SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ns) AS r2 FROM l) WHERE r2 = 1")
def cache_read(spark, sf_dir):
    return state.cache_read(cache_log(spark, sf_dir), ["main:", "old:"], F.lit("2024-01-25 00:00:00").cast("timestamp_ntz"))


@query("cache_clear_pattern", f"WITH {LOG_SQL} SELECT count(*) FILTER (contains(key, 'click')) AS deleted, count(*) AS entries FROM log")
def cache_clear_pattern(spark, sf_dir):
    return state.cleared(cache_log(spark, sf_dir), "click")


def breaker_sql(events: str, key: str, as_of: str) -> str:
    """Failures in turn: up to three count, the third opens for 30 minutes, in which nothing counts."""
    return f"""WITH RECURSIVE f AS (SELECT {key}, (epoch_us(ts) // 1000) AS ms, row_number() OVER (PARTITION BY {key} ORDER BY ts) AS k FROM {events}),
s AS (SELECT {key}, k, CAST(1 AS BIGINT) AS n, ms AS last FROM f WHERE k = 1 UNION ALL
  SELECT f.{key}, f.k, CASE WHEN n < 3 THEN n + 1 WHEN ms - last < 1800000 THEN n ELSE 1 END, CASE WHEN n >= 3 AND ms - last < 1800000 THEN last ELSE ms END FROM s JOIN f ON f.{key} = s.{key} AND f.k = s.k + 1),
e AS (SELECT {key}, arg_max(n, k) AS n, (epoch_us(TIMESTAMP '{as_of}') // 1000) - arg_max(last, k) AS age FROM s GROUP BY {key})
SELECT {key}, CASE WHEN n >= 3 AND age >= 1800000 THEN 0 ELSE n END AS failures, n >= 3 AND age < 1800000 AS skip FROM e"""


BREAKER_SQL = breaker_sql("(SELECT * FROM events WHERE event_type = 'error')", "user_id", "2024-01-31")


@query("circuit_breaker", BREAKER_SQL)
def circuit_breaker(spark, sf_dir):
    return state.breaker(table(spark, sf_dir, "events"), "user_id", "ts", F.col("event_type") == "error", F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"))


@query("breaker_cases", breaker_sql("(SELECT user_id, date_trunc('minute', ts) - INTERVAL (event_id % 5 * 30) MINUTE AS ts FROM events WHERE event_type <> 'view')", "user_id", "2024-01-16"))
def breaker_cases(spark, sf_dir):
    """Dense failures on whole minutes, so that pauses end exactly and times coincide, seen from the middle of them."""
    back = F.make_dt_interval(mins=(F.col("event_id") % 5 * 30).cast("int"))
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", (F.date_trunc("minute", "ts") - back).alias("ts"))
    return state.breaker(rows, "user_id", "ts", F.col("event_type") != "view", F.lit("2024-01-16 00:00:00").cast("timestamp_ntz"))


@query("refresh_status", "SELECT event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'idle' WHEN 'purchase' THEN 'idle' ELSE 'refreshing' END AS state, value > 360 AS stale, 50 + CAST(floor((event_id % 11) / 10.0 * 40) AS BIGINT) AS progress FROM events")
def refresh_status(spark, sf_dir):
    kind = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "complete").when(F.col("event_type") != "purchase", F.col("event_type"))
    rows = state.refresh_status(table(spark, sf_dir, "events"), kind, F.col("value"))
    return rows.select("event_id", "state", "stale", state.progress(F.col("event_id") % 11, F.lit(10)).alias("progress"))


@query("backoff_ladder", "SELECT event_id, CAST(least(5000 * 2 ** (event_id % 10), 60000) AS BIGINT) AS ms, CASE WHEN value < 300 THEN 30.0 WHEN value < 330 THEN 5.0 WHEN value < 360 THEN 2.0 ELSE 1.0 END::DOUBLE AS idle, CASE WHEN value < 300 THEN 15.0 WHEN value < 330 THEN 2.0 WHEN value < 360 THEN 1.0 ELSE 0.5 END::DOUBLE AS waiting FROM events")
def backoff_ladder(spark, sf_dir):
    age = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", times.backoff_ms(F.col("event_id") % 10 + 1, 5000, 60000).alias("ms"), times.idle_minutes(age).alias("idle"), times.idle_minutes(age, True).alias("waiting"))


# --- summaries --------------------------------------------------------------------------------------------------------------------


@query("first_sentence", r"SELECT conv_id, turn, CASE WHEN regexp_extract(text, '^(.+?[.!?])([ \t\n\r\f\v]|$)', 1) <> '' THEN regexp_extract(text, '^(.+?[.!?])([ \t\n\r\f\v]|$)', 1) ELSE substring(text, 1, 140) END AS first FROM conversations")
def first_sentence(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.first_sentence(F.col("text")).alias("first"))


SPLIT_SQL = r"list_filter(string_split(regexp_replace(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"


@query("digest_parse", f"SELECT conv_id, turn, coalesce(({SPLIT_SQL})[1], '') AS lede, array_to_string(({SPLIT_SQL})[2:3], '|') AS takeaways FROM conversations")
def digest_parse(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", digest.parsed(F.col("text")).alias("d")).select("conv_id", "turn", "d.lede", F.array_join("d.takeaways", "|").alias("takeaways"))


@query("digest_json", "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN trim(coalesce(text, '')) WHEN 1 THEN '{bad ' || role || '.' ELSE '' END AS lede, CASE turn % 3 WHEN 0 THEN role || '|b|c' WHEN 1 THEN 'Yes.|No!' ELSE '' END AS takeaways FROM conversations")
def digest_json(spark, sf_dir):
    """Turns as digests in JSON, as something that only begins like it, and missing."""
    whole = F.to_json(F.struct(F.concat(F.lit(" "), "text", F.lit(" ")).alias("lede"), F.array(F.concat("role", F.lit(" ")), F.lit(" b "), F.lit(""), F.lit("c"), F.lit("d")).alias("takeaways")))
    s = F.when(F.col("turn") % 3 == 0, whole).when(F.col("turn") % 3 == 1, F.concat(F.lit("{bad "), "role", F.lit(". Yes. No! More.")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", digest.parsed(s).alias("d"))
    return rows.select("conv_id", "turn", "d.lede", F.array_join("d.takeaways", "|").alias("takeaways"))


@query("summary_fallback_article", r"""WITH c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN instr(t, '.') > 41 THEN substring(t, 1, instr(t, '.')) ELSE substring(t, 1, 150) END AS summary FROM c""")
def summary_fallback_article(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", digest.article_summary(F.col("text")).alias("summary"))


@query("summary_fallback_cluster", of_articles("SELECT cluster_key, string_agg(title, ' • ' ORDER BY pos) AS summary FROM (SELECT *, row_number() OVER (PARTITION BY cluster_key ORDER BY pos) AS r FROM members WHERE title <> '') WHERE r <= 3 GROUP BY cluster_key"))
def summary_fallback_cluster(spark, sf_dir):
    m = members(spark, sf_dir).groupBy("cluster_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "title"))), lambda x: x["title"]).alias("titles"))
    return m.select("cluster_key", text.headlines(F.col("titles")).alias("summary"))


@query("digest_payload", of_articles("SELECT id, CASE WHEN trim(title) = '' THEN description ELSE title || chr(10) || chr(10) || description END AS payload, CASE WHEN length(description) <= 100 THEN description ELSE substring(description, 1, 97) || '...' END AS short FROM articles WHERE trim(description) <> ''"))
def digest_payload(spark, sf_dir):
    rows = articles(spark, sf_dir).where(F.trim("description") != "")
    return rows.select("id", text.payload(F.col("title"), F.col("description")).alias("payload"), text.truncated(F.col("description"), 100).alias("short"))


@query("summary_keys", "SELECT conv_id, turn, 'Summary-v2-cluster-' || conv_id AS key, trim(lower(text)) <> '' AS cacheable FROM conversations")
def summary_keys(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", digest.summary_key("cluster", F.col("conv_id").cast("string")).alias("key"), digest.cacheable(F.col("text")).alias("cacheable"))


# --- order-dependent passes: rows only here, held against a plain model in the tests -----------------------------------------------


def editions(spark, sf_dir):
    """Editions of 1000 articles, as a batch of the news has."""
    return articles(spark, sf_dir).withColumn("edition", F.floor(F.col("doc_id") / 1000).cast("long"))


def timed(rows):
    return rows.withColumn("published_at", F.unix_micros(F.col("published_at").cast("timestamp")))


@query("precluster")
def precluster(spark, sf_dir):
    return leading.preclustered(timed(editions(spark, sf_dir)))


def seeds(spark, sf_dir):
    grouped = members(spark, sf_dir).withColumn("edition", F.floor(F.col("doc_id") / 1000).cast("long"))
    lists = grouped.groupBy("edition", "cluster_key").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "title"))).alias("m"))
    return lists.select("edition", "cluster_key", F.col("m")[0]["title"].alias("cluster_title"), F.transform("m", lambda x: x["id"]).alias("article_ids"))


@query("merge_overlap")
def merge_overlap(spark, sf_dir):
    return merging.merged_by_overlap(seeds(spark, sf_dir))


@query("merge_title")
def merge_title(spark, sf_dir):
    return merging.merged_by_title(seeds(spark, sf_dir))


@query("merge_entity")
def merge_entity(spark, sf_dir):
    return merging.merged_by_entity(seeds(spark, sf_dir), timed(editions(spark, sf_dir)))


@query("split_incoherent")
def split_incoherent(spark, sf_dir):
    return greedy.coherent(seeds(spark, sf_dir), timed(editions(spark, sf_dir)))


@query("story_pipeline")
def story_pipeline(spark, sf_dir):
    from .plans.stories import ranked_stories

    return ranked_stories(editions(spark, sf_dir), dims.category_meta(spark), as_of())


# --- streams ----------------------------------------------------------------------------------------------------------------------


def stored(mode: str, make: Callable[[DataFrame], DataFrame]) -> Query:
    """A stream over the events, its results read back from the files that it wrote."""

    def run(spark, sf_dir):
        from .sources.scratch import new_folder
        from .streaming import durable, events

        return durable.stored(make(events.read_events(spark, sf_dir, "60 days")), mode, new_folder(spark, "stream"))

    return run


def _streams() -> None:
    from .streaming import events as s

    query("stream_dedupe", "SELECT count(DISTINCT (user_id, event_type)) AS n FROM events")(lambda spark, d: stored("append", lambda e: s.unique(e, "user_id", "event_type"))(spark, d).agg(F.count("*").alias("n")))
    velocity = "SELECT CAST(epoch(start) AS BIGINT) AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('hour', ts) - INTERVAL 3 HOUR, date_trunc('hour', ts) - INTERVAL 2 HOUR, date_trunc('hour', ts) - INTERVAL 1 HOUR, date_trunc('hour', ts)]) AS start FROM events) GROUP BY ALL"
    query("stream_velocity", velocity)(lambda spark, d: stored("complete", s.velocity)(spark, d).select(F.unix_seconds("start").alias("start"), "event_type", "n"))
    query("stream_tumbling", "SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")(lambda spark, d: stored("complete", s.tumbling)(spark, d).select(F.unix_seconds("start").alias("start"), "event_type", "n"))
    session = "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 12 HOUR THEN 1 ELSE 0 END AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), r AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM g) SELECT user_id, count(*) AS n FROM r GROUP BY user_id, run"
    query("stream_session", session)(lambda spark, d: stored("complete", lambda e: s.sessions(e, "12 hours"))(spark, d).select("user_id", "n"))
    query("stream_breaker", BREAKER_SQL)(stream_breaker)


def stream_breaker(spark, sf_dir):
    """The last update of each key, as of the same time as circuit_breaker."""
    from .streaming import events

    last = stored("update", events.breaker)(spark, sf_dir).groupBy("user_id").agg(F.max_by(F.struct("failures", "open", "at_ms"), F.struct("at_ms", "failures")).alias("s")).select("user_id", "s.*")
    cool = F.lit(1706659200000) - F.col("at_ms") >= 1_800_000
    return last.select("user_id", F.when(F.col("open") & cool, 0).otherwise(F.col("failures")).cast("long").alias("failures"), (F.col("open") & ~cool).alias("skip"))


@query("stream_articles_once", of_articles(f"SELECT id, url FROM ({UNIQUE_SQL})"))
def stream_articles_once(spark, sf_dir):
    """Articles as documents arrive, each address once, over two runs that read all of them: the second adds nothing."""
    from .functions.urls import canonical_key
    from .sources.scratch import new_folder
    from .streaming import durable

    rows = ingest.titled(articles_of(table_stream(spark, sf_dir, "documents"), spark, sf_dir)).drop("content", "description")
    key, order = canonical_key(F.col("url"), F.col("source_url"), F.col("title")), [F.desc_nulls_last("published_at"), F.col("ord")]
    folder = new_folder(spark, "articles")
    durable.once_only(rows, key, order, folder, "first")
    return durable.once_only(rows, key, order, folder, "second").select("id", "url")


_streams()


# --- the page ---------------------------------------------------------------------------------------------------------------------


def _page() -> None:
    from .operators import page

    @query("hero_image", of_articles("SELECT cluster_key, arg_min(url_to_image, pos) AS hero FROM members WHERE url_to_image <> '' AND NOT contains(url_to_image, 'placehold.co') AND image_width >= 320 GROUP BY cluster_key"))
    def hero_image(spark, sf_dir):
        return page.hero(members(spark, sf_dir), expanded=True)

    @query("image_lookup", of_articles("SELECT cluster_key, url_to_image, arg_max(id, pos) AS id FROM members WHERE url_to_image <> '' AND NOT contains(url_to_image, 'placehold.co') GROUP BY ALL"))
    def image_lookup(spark, sf_dir):
        return page.last_by_image(members(spark, sf_dir)).select("cluster_key", "url_to_image", "id")

    @query("collage", of_articles(""", u AS (SELECT cluster_key, url_to_image, min(pos) AS place, arg_max(image_width, pos) AS w FROM members WHERE url_to_image <> '' AND NOT contains(url_to_image, 'placehold.co') GROUP BY ALL)
SELECT cluster_key, array_to_string((list(url_to_image ORDER BY place))[1:4], ' ') AS urls FROM u WHERE w >= 320 GROUP BY cluster_key"""))
    def collage(spark, sf_dir):
        m = members(spark, sf_dir)
        once = m.where(images.is_useful(F.col("url_to_image"))).groupBy("cluster_key", "url_to_image").agg(F.min("pos").alias("at"))
        pictures = once.groupBy("cluster_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "url_to_image"))), lambda x: x["url_to_image"]).alias("image_urls"))
        return page.collage(pictures, m).select("cluster_key", F.array_join("urls", " ").alias("urls"))

    @query("image_grid", "WITH g AS (SELECT doc_id, doc_id % 5 + 1 AS c, doc_id // 5 % (doc_id % 5 + 1) AS i, doc_id % 7 <> 0 AS wide FROM documents) SELECT doc_id, CASE WHEN c = 1 THEN '2x2' WHEN c = 2 THEN CASE WHEN wide THEN '2x1' ELSE '1x2' END WHEN c = 3 THEN CASE WHEN i > 0 THEN '1x1' WHEN wide THEN '2x1' ELSE '1x2' END ELSE '1x1' END AS cell FROM g")
    def image_grid(spark, sf_dir):
        """Articles as cells of grids of one to five images, by the ratio of their own."""
        n, ratio = F.col("doc_id") % 5 + 1, F.col("image_width") / F.col("image_height")
        return articles(spark, sf_dir).select("doc_id", page.grid_cell(n, F.floor(F.col("doc_id") / 5) % n, ratio, ratio).alias("cell"))

    @query("related_lookup", "SELECT k AS cluster_key, k + 1 AS related_key, doc_n AS related_size FROM (SELECT unnest(range(0, 40)) AS k) JOIN (SELECT doc_id % 37 AS g, count(*) AS doc_n FROM documents GROUP BY ALL) ON g = k + 1")
    def related_lookup(spark, sf_dir):
        links = spark.range(40).select(F.col("id").alias("cluster_key"), (F.col("id") + 1).alias("related_key"))
        return page.related_titles(links, clusters(members(spark, sf_dir))).select("cluster_key", "related_key", long(F.col("related_size")).alias("related_size"))

    @query("summary_hydration", "WITH e AS (SELECT user_id, event_type, CASE WHEN event_id % 4 = 0 THEN 'own' ELSE '' END AS s, event_id FROM events) SELECT event_id, CASE WHEN s <> '' THEN s WHEN event_type = 'view' THEN 'cached' END AS summary FROM e")
    def summary_hydration(spark, sf_dir):
        rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("event_id") % 4 == 0, "own").otherwise("").alias("summary"))
        cached = values(spark, [("Summary-v2-cluster-view", "cached")], "key string, value string")
        return page.hydrated(rows, cached, digest.summary_key("cluster", F.col("event_type"))).select("event_id", "summary")

    @query("summary_wanted", "SELECT conv_id, turn, length(text) > 30 AS manual, length(text) > 100 AS auto, length(trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))) >= 160 AS server FROM conversations")
    def summary_wanted(spark, sf_dir):
        c = F.col("text")
        return table(spark, sf_dir, "conversations").select("conv_id", "turn", page.wants_summary(c, True).alias("manual"), page.wants_summary(c, False).alias("auto"), page.has_server_summary(c).alias("server"))

    @query("rate_limit_errors", "SELECT event_id, event_type IN ('error', 'click') OR contains(coalesce(props, ''), '429') OR user_id % 4 = 0 OR event_id % 7 = 0 AS limited FROM events")
    def rate_limit_errors(spark, sf_dir):
        """Errors that tell a limit by their message, in either spelling, by a code, a status, or not."""
        message = F.when(F.col("event_type") == "error", "Error 429: slow down").when(F.col("event_type") == "click", "Spend Limit hit").otherwise(F.col("props"))
        code, status = F.when(F.col("user_id") % 4 == 0, "rate_limit_exceeded"), F.when(F.col("event_id") % 7 == 0, 429).when(F.col("event_id") % 7 < 3, 403)
        return table(spark, sf_dir, "events").select("event_id", page.is_rate_limit(message, code, status).alias("limited"))

    @query("llm_valid_clusters", of_articles("SELECT cluster_key, cluster_key % 4 < 2 AND arg_min(title, pos) <> '' AND count(*) FILTER (cluster_key % 3 > 0 OR pos = 0) >= 2 AS ok FROM members GROUP BY cluster_key"))
    def llm_valid_clusters(spark, sf_dir):
        """Clusters of which some have lost their title and some all members but one."""
        title = F.when(F.col("cluster_key") % 4 < 2, F.col("cluster_title")).when(F.col("cluster_key") % 4 == 2, "")
        ids = F.when(F.col("cluster_key") % 3 == 0, F.slice("article_ids", 1, 1)).otherwise(F.col("article_ids"))
        return clusters(members(spark, sf_dir)).select("cluster_key", page.is_valid_cluster(title, ids).alias("ok"))

    @query("feed_lookups", f"SELECT source_key, bool_or(lower(category) = 'technology') AS has_feed, bool_or(category = 'Technology') AS has_category, list(url ORDER BY ord) AS urls FROM {FLAT_SQL} GROUP BY source_key")
    def feed_lookups(spark, sf_dir):
        return ingest.lookups(feeds(spark, sf_dir), "Technology")

    @query("published_labels", "SELECT event_id, strftime(ts, '%b %-d, %-I:%M %p') AS label, CASE WHEN (epoch_us(TIMESTAMP '2024-01-31') // 1000 - epoch_us(ts) // 1000) / 3.6e6 < 1 THEN 'new' ELSE CAST(floor((epoch_us(TIMESTAMP '2024-01-31') // 1000 - epoch_us(ts) // 1000) / 3.6e6) AS BIGINT) || 'h' END AS age FROM events")
    def published_labels(spark, sf_dir):
        age = times.age_label(F.col("ts"), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"))
        return table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "MMM d, h:mm a").alias("label"), F.when(F.endswith(age, F.lit("m")), "new").otherwise(age).alias("age"))

    @query("category_payload", of_articles(""", m AS (SELECT cluster_key, count(*) AS n, list(title ORDER BY pos) AS titles FROM members GROUP BY ALL ORDER BY cluster_key LIMIT 4)
SELECT 'Topic: World' || chr(10) || chr(10) || 'Top clusters (use these to infer the dominant day-level themes, not to restate each headline):' || chr(10) || string_agg((cluster_key + 1) || '. ' || titles[1] || chr(10) || 'Articles: ' || n || chr(10) || 'Cue: ' || CASE WHEN length(titles[1] || ' | ' || titles[2]) <= 200 THEN titles[1] || ' | ' || titles[2] ELSE substring(titles[1] || ' | ' || titles[2], 1, 197) || '...' END, chr(10) || chr(10) ORDER BY cluster_key) AS content, CAST(8 AS BIGINT) AS article_count FROM m"""))
    def category_payload(spark, sf_dir):
        m = members(spark, sf_dir).groupBy("cluster_key").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "title"))).alias("m"))
        rows = m.select(F.col("cluster_key").alias("ord"), F.col("m")[0]["title"].alias("title"), F.lit("").alias("summary"), F.lit("Other").alias("label"), F.transform("m", lambda x: F.struct(x["id"].alias("id"), x["title"].alias("title"))).alias("articles"))
        loose = articles(spark, sf_dir).select("ord", "id", "title", "source_name", "description")
        return page.category_payload(rows, loose, "World", 4, 2, 0).select("content", "article_count")


_page()


# --- plans and answers ------------------------------------------------------------------------------------------------------------


def _answers() -> None:
    from .params import Params
    from .plans import intake, serving

    few = "few AS (SELECT * EXCLUDE (rk) FROM (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY ord) AS rk FROM articles WHERE NOT contains(url, 'blog.')) WHERE rk <= 25)"

    @query("all_news", of_articles(f"SELECT id, CASE WHEN url_to_image = '' THEN 'https://placehold.co/600x400?text=' || source_name ELSE url_to_image END AS image FROM ({UNIQUE_SQL.replace('FROM articles', 'FROM few')}) ORDER BY published_at DESC, ord LIMIT 300", f", {few}"))
    def all_news(spark, sf_dir):
        p = Params(feed_blocklist="blog.", news_global_limit=300)
        rows = articles(spark, sf_dir)
        return intake.all_news(rows, "source_name", p, "url").select("id", F.col("url_to_image").alias("image"))

    @query("publish_range", of_articles("SELECT cluster_key, strftime(min(published_at), '%Y-%m-%dT%H:%M:%S.%gZ') || '–' || strftime(max(published_at), '%Y-%m-%dT%H:%M:%S.%gZ') AS range FROM members GROUP BY cluster_key"))
    def publish_range(spark, sf_dir):
        return stories.publish_range(members(spark, sf_dir))

    @query("slow_feeds", "SELECT event_id, dense_rank() OVER (ORDER BY value DESC) AS place FROM events WHERE event_type <> 'error' AND value > 150")
    def slow_feeds(spark, sf_dir):
        return state.slow(table(spark, sf_dir, "events"), F.col("value"), F.when(F.col("event_type") == "error", "x"), 150).select("event_id", "place")

    @query("empty_feeds", "SELECT event_id FROM events WHERE event_type <> 'error' AND event_id % 7 = 0")
    def empty_feeds(spark, sf_dir):
        return state.empty(table(spark, sf_dir, "events"), F.col("event_id") % 7, F.when(F.col("event_type") == "error", "x")).select("event_id")

    alias = f"alias AS (SELECT * FROM {ALIAS_SQL})"
    dom = "dom AS (SELECT cluster_key, category FROM (SELECT cluster_key, category, row_number() OVER (PARTITION BY cluster_key ORDER BY count(*) DESC, min(pos)) AS r FROM members GROUP BY cluster_key, category) WHERE r = 1)"
    text_of = "tx AS (SELECT cluster_key, string_agg(title, ' ' ORDER BY pos) AS text FROM members GROUP BY cluster_key)"

    @query("topic_page", of_articles(f"SELECT cluster_key, {sql_score('text', 'World')}::BIGINT AS keyword_score, row_number() OVER (ORDER BY {sql_score('text', 'World')} DESC, cluster_key) AS rank FROM tx JOIN dom USING (cluster_key) WHERE lower(category) IN (SELECT category_lc FROM alias WHERE topic = 'World')", f", {alias}, {dom}, {text_of}"))
    def topic_page(spark, sf_dir):
        return serving.topic_page(members(spark, sf_dir), dims.category_alias(spark), "World")

    asked = "r AS (SELECT concat('c', conv_id, '-', turn) AS id, CASE turn % 3 WHEN 0 THEN 'article' WHEN 1 THEN 'cluster' ELSE 'category' END AS purpose, '- ' || replace(text, '. ', chr(10) || '- ') AS content, CASE WHEN conv_id % 2 = 0 THEN 'short' ELSE 'long' END AS length FROM conversations)"
    made = "CASE purpose WHEN 'cluster' THEN 'One • Two • Three' WHEN 'category' THEN array_to_string(list_transform(list_filter(string_split(content, chr(10)), lambda x: starts_with(x, '- '))[1:3], lambda x: substring(x, 3)), ' • ') ELSE CASE WHEN instr(t, '.') > 41 THEN substring(t, 1, instr(t, '.')) ELSE substring(t, 1, 150) END END"
    keyed = "k AS (SELECT *, 'Summary-' || CASE purpose WHEN 'cluster' THEN 'v2-cluster-' || id || CASE length WHEN 'short' THEN ':short' ELSE '' END ELSE 'v1-' || purpose || '-' || id END AS key, " + r"trim(regexp_replace(regexp_replace(content, '<[^>]+>', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')) AS t FROM r)"
    sentinels = ", ".join(f"'{x}'" for x in digest.SENTINELS)

    @query("summary_served", f"WITH {asked}, {keyed}, m AS (SELECT *, {made} AS made, CASE WHEN ends_with(id, '-2') OR ends_with(id, '-3') THEN 'stored ' || id END AS stored FROM k) SELECT id, key, coalesce(stored, made) AS summary, stored IS NOT NULL AS hit, stored IS NULL AND trim(lower(made)) <> '' AND trim(lower(made)) NOT IN ({sentinels}) AS store FROM m")
    def summary_served(spark, sf_dir):
        turn = F.col("turn") % 3
        rows = table(spark, sf_dir, "conversations").select(
            F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("id"), F.when(turn == 0, "article").when(turn == 1, "cluster").otherwise("category").alias("purpose"), F.concat(F.lit("- "), F.replace("text", F.lit(". "), F.lit("\n- "))).alias("content"),
            F.array(*[F.lit(t) for t in ("One", "Two", "Three", "Four")]).alias("titles"), F.when(F.col("conv_id") % 2 == 0, "short").otherwise("long").alias("length"),
        )
        ident = F.when((F.col("purpose") == "cluster") & (F.col("length") == "short"), F.concat("id", F.lit(":short"))).otherwise(F.col("id"))
        kept = rows.where(F.endswith("id", F.lit("-2")) | F.endswith("id", F.lit("-3"))).select(F.concat(F.when(F.col("purpose") == "cluster", "Summary-v2-").otherwise("Summary-v1-"), "purpose", F.lit("-"), ident).alias("key"), F.concat(F.lit("stored "), "id").alias("value"))
        return serving.summaries(rows, kept)

    @query("cache_entries", f"WITH {LOG_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY ns, key ORDER BY ts DESC, seq DESC) AS r FROM log) SELECT ns, key, length(value) AS size, (epoch_us(expires_at) // 1000 - epoch_us(TIMESTAMP '2024-01-25') // 1000) // 1000 AS seconds_left FROM l WHERE r = 1 AND expires_at >= TIMESTAMP '2024-01-25 00:00:01'")
    def cache_entries(spark, sf_dir):
        return serving.entries(cache_log(spark, sf_dir), F.lit("2024-01-25 00:00:00").cast("timestamp_ntz"))

    @query("home_answer", "SELECT event_id, CASE WHEN event_type IN ('view', 'click') OR (user_id % 2 = 0 AND user_id % 3 = 0) THEN 200 ELSE 503 END AS status, event_type IN ('view', 'click') AS from_cache, CASE WHEN event_type IN ('view', 'click') THEN (epoch_us(TIMESTAMP '2024-01-31') // 1000 - epoch_us(ts) // 1000) // 60000 END AS age_minutes, CASE WHEN event_type IN ('view', 'click') THEN NULL WHEN user_id % 2 = 1 THEN 10 WHEN user_id % 3 <> 0 THEN 60 END AS retry_after FROM events")
    def home_answer(spark, sf_dir):
        mode = F.element_at(F.array(*[F.lit(m) for m in serving.MODES]), (F.col("user_id") % 3 + 1).cast("int"))
        at = F.when(F.col("event_type").isin("view", "click"), F.col("ts"))
        out = serving.page_answer(table(spark, sf_dir, "events"), at, F.col("user_id") % 2 == 1, mode, F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"))
        return out.select("event_id", "status", "from_cache", "age_minutes", "retry_after")

    @query("feed_title", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Feed ' || page_id WHEN 1 THEN 'About ' || page_id WHEN 2 THEN lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)) ELSE 'Unknown Source' END AS title FROM pages")
    def feed_title(spark, sf_dir):
        """Pages as feeds with a title, a description, an address, or nothing to go by."""
        way, n = F.col("page_id") % 4, F.col("page_id").cast("string")
        name, about = F.when(way == 0, F.concat(F.lit("Feed "), n)).when(way == 1, ""), F.when(way < 2, F.concat(F.lit("About "), n))
        return table(spark, sf_dir, "pages").select("page_id", titles.feed_title(name, about, F.when(way == 3, "junk").otherwise(F.col("url"))).alias("title"))


_answers()


# --- what a model is asked for ----------------------------------------------------------------------------------------------------


@query("short_summary", r"""WITH f AS (SELECT conv_id, turn, trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')) AS t FROM conversations), s AS (SELECT *, regexp_extract(t, '(.+?[.!?])( |$)', 1) AS one, t[:140] AS cut FROM f)
SELECT conv_id, turn, CASE WHEN one <> '' THEN one WHEN contains(cut, '.') AND length(cut) - instr(reverse(cut), '.') + 1 > 41 THEN cut[:length(cut) - instr(reverse(cut), '.') + 1] ELSE cut END AS short FROM s""")
def short_summary(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", summaries.short_summary(F.col("text")).alias("short"))


SOURCES_SQL = "'Source: ' || source_name || chr(10) || 'Title: ' || title || chr(10) || 'Summary: ' || description || chr(10) || 'Content: ' || content || chr(10) || 'Published: ' || CAST(published_at AS VARCHAR) || chr(10) || 'URL: ' || url || chr(10) || chr(10)"


@query("summary_requests", of_articles(f"""SELECT 'Summary-v2-cluster-cluster-' || array_to_string(list(id ORDER BY id), '-') AS key, 'cluster' AS purpose, cluster_key + 1 AS place, md5(array_to_string((list({SOURCES_SQL} ORDER BY pos))[:50], '--- ' || chr(10))) AS content, array_to_string((list(title ORDER BY pos))[:50], '|') AS titles FROM members WHERE cluster_key < 10 GROUP BY cluster_key
UNION ALL SELECT 'Summary-v1-article-' || id, 'article', place + 10, md5(content), title FROM (SELECT *, row_number() OVER (ORDER BY published_at DESC, ord) AS place FROM articles) WHERE place <= 15 AND NOT (doc_id % 2 = 0 AND doc_id % 3 > 0)"""))
def summary_requests(spark, sf_dir):
    """What the first clusters and the newest articles lack, where the store has every second article's summary and of these each third an empty one."""
    rows = articles(spark, sf_dir)
    firsts = clusters(members(spark, sf_dir)).select(F.lit(0).alias("edition"), "cluster_title", "article_ids", (F.col("cluster_key") + 1).alias("rank"), F.lit("").alias("summary"))
    live = rows.where("doc_id % 2 = 0").select(digest.summary_key("article", F.col("id")).alias("key"), F.when(F.col("doc_id") % 3 == 0, "").otherwise("kept").alias("value"))
    out = summaries.missing(summaries.requests(firsts, rows), live)
    return out.select("key", "purpose", "place", F.md5("content").alias("content"), F.array_join("titles", "|").alias("titles"))


@query("refresh_trigger", "SELECT event_id, user_id % 3 > 0 AND coalesce(event_type = 'error' OR epoch_us(TIMESTAMP '2024-01-16') // 1000 - epoch_us(ts) // 1000 > 21600000, true) AS starts FROM events")
def refresh_trigger(spark, sf_dir):
    """Events as requests in the three modes, for pages stored at their time or, for errors, at none."""
    mode = F.element_at(F.array(*[F.lit(m) for m in ("cron-only", "request-refresh", "request-generate")]), (F.col("user_id") % 3 + 1).cast("int"))
    at = F.when(F.col("event_type") != "error", F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", summaries.wants_refresh(at, mode, F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")).alias("starts"))
