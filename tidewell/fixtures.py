"""Articles and clusters over the test tables, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATEGORIES = ["Politics", "Business", "Technology", "Sports", "World News", "Middle East"]
#: Names that some titles get, so that clusters have names in common.
NAMES = ["Port Avela", "Lake Morrin", "Selby Harbour", "Anna Tervo", "Mount Keld", "Oru Valley", "Karst Institute", "Dana Whitlock", "Bay of Ness", "Velm Council", "Tomas Ruiz"]
AS_OF = "2024-01-02 00:00:00"
CLUSTERS = 37


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream, whether it is a file or a folder of files.

    A stream of a path wants a folder, so the table's name goes in as a pattern that only it matches.
    """
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles, with the addresses of pages, so that addresses repeat."""
    return articles_of(table(spark, sf_dir, "documents"), spark, sf_dir)


def articles_of(docs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles of some documents, which may be a stream."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    n = F.broadcast(pages.agg(F.count("*").alias("n")))  # one row
    d = docs.crossJoin(n).withColumn("at", F.col("doc_id") % F.col("n"))
    d = d.join(pages, d["at"] == pages["page_id"])
    category = F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (F.col("doc_id") % 6 + 1).cast("int"))
    image = F.when(F.col("doc_id") % 5 == 0, "").when(F.col("doc_id") % 5 == 1, "https://placehold.co/600x400?text=x").otherwise(F.concat(F.lit("https://img.example.com/"), (F.col("doc_id") % 11).cast("string"), F.lit(".jpg")))
    title, name = F.trim(F.regexp_extract("text", r"^[^.!?\n]{1,160}", 0)), F.element_at(F.array(*[F.lit(n) for n in NAMES]), (F.col("doc_id") * F.col("doc_id") % len(NAMES) + 1).cast("int"))
    return d.select(
        "doc_id",
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"),
        F.when((F.col("doc_id") % 3 == 0) & (title != ""), F.concat(title, F.lit(" in "), name)).otherwise(title).alias("title"),
        F.substring("text", 1, 200).alias("description"),
        F.col("text").alias("content"),
        F.col("source").alias("source_name"),
        F.lit("").alias("source_url"),
        category.alias("category"),
        F.timestamp_add("MINUTE", F.col("doc_id").cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("published_at"),
        F.col("doc_id").alias("ord"),
        "url",
        image.alias("url_to_image"),
        F.when(F.col("doc_id") % 7 == 0, 200).otherwise(800).alias("image_width"),
        F.lit(600).alias("image_height"),
    )


TITLE_SQL = "trim(regexp_extract(d.text, '^[^.!?\\n]{1,160}', 0))"
SQL = f"""articles AS (
  SELECT d.doc_id, concat('doc-', d.doc_id) AS id, CASE WHEN d.doc_id % 3 = 0 AND {TITLE_SQL} <> '' THEN {TITLE_SQL} || ' in ' || ({NAMES}::VARCHAR[])[d.doc_id * d.doc_id % {len(NAMES)} + 1] ELSE {TITLE_SQL} END AS title, substring(d.text, 1, 200) AS description, d.text AS content,
    d.source AS source_name, '' AS source_url, CASE d.doc_id % 6 WHEN 0 THEN 'Politics' WHEN 1 THEN 'Business' WHEN 2 THEN 'Technology' WHEN 3 THEN 'Sports' WHEN 4 THEN 'World News' ELSE 'Middle East' END AS category,
    TIMESTAMP '2024-01-01 00:00:00' + d.doc_id * INTERVAL '1' MINUTE AS published_at, d.doc_id AS ord, p.url,
    CASE d.doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'https://placehold.co/600x400?text=x' ELSE concat('https://img.example.com/', d.doc_id % 11, '.jpg') END AS url_to_image,
    CASE WHEN d.doc_id % 7 = 0 THEN 200 ELSE 800 END AS image_width
  FROM documents d CROSS JOIN (SELECT count(*) AS n FROM pages) c JOIN pages p ON p.page_id = d.doc_id % c.n
), members AS (
  SELECT *, CAST(doc_id % {CLUSTERS} AS BIGINT) AS cluster_key, row_number() OVER (PARTITION BY doc_id % {CLUSTERS} ORDER BY doc_id) - 1 AS pos FROM articles
)"""

HOST_SQL = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)), '^www\\.', '')"
KEY_SQL = "lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1)) || CASE WHEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1) END"


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles in CLUSTERS groups; pos is the place in the group.

    Groups are residues of doc_id and so a member's place is doc_id div CLUSTERS: no sort is needed.
    """
    return articles(spark, sf_dir).withColumn("cluster_key", F.col("doc_id") % CLUSTERS).withColumn("pos", F.floor(F.col("doc_id") / CLUSTERS).cast("long"))


def clusters(rows: DataFrame) -> DataFrame:
    """(cluster_key, cluster_title, article_ids) of members; the title is the first member's."""
    lists = rows.groupBy("cluster_key").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "title"))).alias("m"))
    return lists.select("cluster_key", F.col("m")[0]["title"].alias("cluster_title"), F.transform("m", lambda x: x["id"]).alias("article_ids"))
