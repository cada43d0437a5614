"""Relations between clusters and articles: members, categories, pairs of clusters, related and wider stories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.entities import cluster_text, entities
from ..functions.text import doc_text
from ..functions.times import hours_between, millis
from ..sources.scratch import saved
from . import tfidf


def exploded(clusters: DataFrame, ids: str = "article_ids") -> DataFrame:
    """(cluster_key, pos, id)"""
    return clusters.select("cluster_key", F.posexplode(ids).alias("pos", "id"))


def lookup(members: DataFrame, articles: DataFrame) -> DataFrame:
    """Members with their articles; ids without an article are dropped, pos keeps the order."""
    return members.join(articles, "id")


def members_of(articles: DataFrame, members: DataFrame) -> DataFrame:
    return articles.join(members.select("id").distinct(), "id", "left_semi")


def unclustered(articles: DataFrame, members: DataFrame) -> DataFrame:
    return articles.join(members.select("id"), "id", "left_anti")


def dominant(rows: DataFrame, group: list[str], value: str, pos: str) -> DataFrame:
    """(group, value): the most frequent value that isn't blank, ties to the one seen first. Two hash aggregates, no window."""
    counts = rows.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(*group, value).agg(F.count("*").alias("n"), F.min(pos).alias("first"))
    return counts.groupBy(*group).agg(F.min(F.struct((-F.col("n")).alias("n"), "first", F.col(value).alias("v"))).alias("b")).select(*group, F.col("b.v").alias(value))


def publish_range(members: DataFrame) -> DataFrame:
    """(cluster_key, range): the first and last time of publication, as ISO texts with a dash between; empty without any."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    ends = members.groupBy("cluster_key").agg(F.min("published_at").alias("a"), F.max("published_at").alias("b"))
    return ends.select("cluster_key", F.coalesce(F.concat(iso(F.col("a")), F.lit("–"), iso(F.col("b"))), F.lit("")).alias("range"))


def cluster_entities(clusters: DataFrame, members: DataFrame, articles: DataFrame, least: int = 4, scope: str | None = None) -> DataFrame:
    """(cluster_key, entity), each once: names in the title and the first ten members' titles, of a least length.

    With scope, a column of clusters, its value stands before the names, so that only clusters of one scope have names in common.
    """
    titles = members.where("pos < 10").join(articles.select("id", "title"), "id").groupBy("cluster_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "title"))), lambda x: x["title"]).alias("titles"))
    text = cluster_text(F.col("cluster_title"), F.coalesce("titles", F.array().cast("array<string>")))
    return clusters.join(titles, "cluster_key", "left").select("cluster_key", *([scope] if scope else []), F.explode(F.filter(entities(text), lambda e: F.length(e) >= least)).alias("entity")).select("cluster_key", (F.concat_ws(":", scope, "entity") if scope else F.col("entity")).alias("entity"))


def sharing(sets: DataFrame, value: str, least: int = 1) -> DataFrame:
    """(a, b, shared), a < b: pairs of clusters that have values in common. An equi-join on the value, not a join of all pairs."""
    a, b = sets.select(F.col("cluster_key").alias("a"), value), sets.select(F.col("cluster_key").alias("b"), value)
    return a.join(b, value).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def jaccards(sets: DataFrame, value: str, least: float = 0.0) -> DataFrame:
    """(a, b, shared, jaccard), a < b, for clusters with a value in common."""
    if least > 0:
        return near_sets(sets, value, least)
    sizes = sets.groupBy("cluster_key").agg(F.count("*").alias("size"))
    pairs = sharing(sets, value).join(sizes.select(F.col("cluster_key").alias("a"), F.col("size").alias("sa")), "a").join(sizes.select(F.col("cluster_key").alias("b"), F.col("size").alias("sb")), "b")
    return pairs.withColumn("jaccard", F.col("shared") / (F.col("sa") + F.col("sb") - F.col("shared"))).select("a", "b", "shared", "jaccard")


#: near_sets(): about so many clusters of equal sets are paired in one row. It only steers the work.
CHUNK = 512


def near_sets(sets: DataFrame, value: str, least: float) -> DataFrame:
    """(a, b, shared, jaccard), a < b, of a similarity of at least `least` > 0, exactly.

    Equal sets are one in the search. Values have one order, rare ones first. Sets that are so much alike share one of the first of each, as many as may be missing and one more, and are met under the first
    that they share, where what stands from there on must make up the shared part; frequent values hardly do. The clusters of each pair of sets come at the end, in chunks that are dealt out,
    so that many equal sets cost as much as the rows that they give and a large group lies in no single task.
    """
    own = saved(sets.groupBy("cluster_key").agg(F.array_sort(F.collect_set(value)).alias("s")))
    kinds = saved(own.groupBy("s").agg(F.min("cluster_key").alias("kind"), F.count("*").alias("times")))
    each = kinds.select("kind", F.explode("s").alias("v"))
    rated = each.join(each.groupBy("v").agg(F.count("*").alias("df")), "v").groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("s"))
    lists = saved(rated.select("kind", F.transform("s", lambda x: x["v"]).alias("s")))
    head = lists.select("kind", F.size("s").alias("n"), F.posexplode(F.slice("s", F.lit(1), (F.size("s") - F.ceil(F.size("s") * least - 1e-9) + 1).cast("int"))).alias("i", "v"))
    one, other = (head.select("v", F.col("kind").alias(k), F.col("n").alias(f"n{k}"), F.col("i").alias(f"i{k}")) for k in "xy")
    shared = (F.col("nx") + F.col("ny")) * (least / (1 + least)) - 1e-9
    fits = (F.least("nx", "ny") >= least * F.greatest("nx", "ny") - 1e-9) & (F.least(F.col("nx") - F.col("ix"), F.col("ny") - F.col("iy")) >= shared)
    pairs = one.join(other.hint("merge"), "v").where((F.col("x") < F.col("y")) & fits).select("x", "y").distinct()
    both = pairs.join(lists.select(F.col("kind").alias("x"), F.col("s").alias("sx")), "x").join(lists.select(F.col("kind").alias("y"), F.col("s").alias("sy")), "y")
    both = both.select("x", "y", F.size(F.array_intersect("sx", "sy")).cast("long").alias("shared"), (F.size("sx") + F.size("sy")).alias("n"))
    both = both.withColumn("jaccard", F.col("shared") / (F.col("n") - F.col("shared"))).where(F.col("jaccard") >= least).drop("n")
    alike = kinds.where("times > 1").select(F.col("kind").alias("x"), F.col("kind").alias("y"), F.size("s").cast("long").alias("shared"), F.lit(1.0).alias("jaccard"))
    found = both.unionByName(alike)
    members = own.join(kinds, "s").select("kind", "cluster_key", F.pmod(F.xxhash64("cluster_key"), F.ceil(F.col("times") / CHUNK)).alias("chunk"))
    members = saved(members.groupBy("kind", "chunk").agg(F.collect_list("cluster_key").alias("keys")))
    left, right = (members.select(F.col("kind").alias(k), F.col("chunk").alias(f"c{k}"), F.col("keys").alias(f"k{k}")) for k in "xy")
    met = found.join(left, "x").join(right, "y").where("x <> y or cx <= cy").withColumn("own", (F.col("x") == F.col("y")) & (F.col("cx") == F.col("cy")))
    met = met.repartition(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))).select("shared", "jaccard", "own", "ky", F.explode("kx").alias("p"))
    met = met.select("shared", "jaccard", "own", "p", F.explode("ky").alias("q")).where("not own or p < q")
    return met.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "shared", "jaccard")


def sampled_pairs(pairs: DataFrame, members: DataFrame, sample: int = 20) -> DataFrame:
    """(a, b, x, y): for each pair of clusters the first `sample` pairs of members, row by row.

    Only a cluster's first `sample` members can be in it, so no more of them are joined; the count of b's members then gives the cut.
    """
    sizes = members.groupBy("cluster_key").agg(F.count("*").alias("nb"))
    few = members.where(F.col("pos") < sample)
    left = few.select(F.col("cluster_key").alias("a"), F.col("pos").alias("pa"), F.col("id").alias("x"))
    right = few.select(F.col("cluster_key").alias("b"), F.col("pos").alias("pb"), F.col("id").alias("y"))
    cut = F.col("pa") * F.col("nb") + F.col("pb") < sample
    return pairs.join(sizes.withColumnRenamed("cluster_key", "b"), "b").join(left, "a").where(F.col("pa") * F.col("nb") < sample).join(right, "b").where(cut).select("a", "b", "x", "y")


def cross_similarity(pairs: DataFrame, members: DataFrame, postings: DataFrame, sample: int = 20) -> DataFrame:
    """(a, b, sim): the mean cosine of the sampled pairs of members; 0 without any."""
    u = tfidf.unit(postings, "id").select("id", "term", "u")
    met = sampled_pairs(pairs, members, sample)
    dots = met.select("x", "y").distinct().join(u.select(F.col("id").alias("x"), "term", F.col("u").alias("ux")), "x").join(u.select(F.col("id").alias("y"), "term", F.col("u").alias("uy")), ["y", "term"])
    dots = dots.groupBy("x", "y").agg(F.sum(F.col("ux") * F.col("uy")).alias("dot"))
    means = met.join(dots, ["x", "y"], "left").groupBy("a", "b").agg(F.avg(F.coalesce("dot", F.lit(0.0))).alias("sim"))
    return pairs.join(means, ["a", "b"], "left").withColumn("sim", F.coalesce("sim", F.lit(0.0)))


def referenced(members: DataFrame, articles: DataFrame) -> DataFrame:
    return articles.join(members.select("id").distinct(), "id", "left_semi")


def related(clusters: DataFrame, members: DataFrame, articles: DataFrame, shared: int = 2, length: int = 4, coherence: float = 0.03, most: int = 5, scope: str | None = None) -> DataFrame:
    """(cluster_key, related_key, sim, rank): links in both directions, the `most` nearest of each cluster.

    With scope, a column of clusters and articles, links stay within it, and so do the weights of terms.
    """
    pairs = saved(sharing(cluster_entities(clusters, members, articles, length, scope), "entity", shared))
    own = referenced(members, articles)
    postings = saved(tfidf.weights(own, "id", doc_text(F.col("title"), F.col("description"), F.col("content")), within=[scope] if scope else None))
    near = cross_similarity(pairs, members, postings).where(F.col("sim") >= coherence)
    both = near.select(F.col("a").alias("cluster_key"), F.col("b").alias("related_key"), "sim").unionAll(near.select("b", "a", "sim"))
    rank = F.row_number().over(Window.partitionBy("cluster_key").orderBy(F.desc(F.round("sim", 9)), F.least("cluster_key", "related_key"), F.greatest("cluster_key", "related_key")))
    return both.withColumn("rank", rank).where(F.col("rank") <= most)


def around(units: DataFrame, centres: DataFrame, articles: DataFrame, last: DataFrame, hours: float) -> DataFrame:
    """(id, cluster_key, sim) of articles and centres that share a term and may be so many hours apart: spans of that length have numbers, and a centre meets its own and those beside it.

    Articles without a time meet all centres, as a span of their own, and centres without one all articles.
    """
    at = lambda c: F.floor(millis(c) / (hours * 3_600_000)).cast("long")
    none = F.lit(-(1 << 60))
    p = units.join(articles.select("id", F.coalesce(at(F.col("published_at")), none).alias("span")), "id").select("id", "term", "span", F.col("u").alias("pu"))
    c = centres.join(last.select("cluster_key", at(F.col("latest")).alias("own")), "cluster_key", "left").select("cluster_key", "term", "own", F.col("u").alias("cu"))
    spans = F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1, none))
    timed = p.join(c.where("own is not null").select("cluster_key", "term", "cu", spans.alias("span")), ["term", "span"]).select("id", "cluster_key", "pu", "cu")
    untimed = p.join(c.where("own is null"), "term").select("id", "cluster_key", "pu", "cu")
    return timed.unionByName(untimed).groupBy("id", "cluster_key").agg(F.least(F.lit(1.0), F.sum(F.col("pu") * F.col("cu"))).alias("sim"))


def expanded(members: DataFrame, articles: DataFrame, postings: DataFrame, similarity: float = 0.65, most: int = 15, hours: float = 48.0, strict: bool = True) -> DataFrame:
    """(cluster_key, id, sim): articles to add to each cluster, on its own: near its centroid, of its category, published around its latest member.

    Candidates must share a term with the centroid and lie in a span of time that its latest member can reach, so the join is on both; category and the exact time are tested on the pairs that come out of it.
    """
    own = lookup(members, articles)
    dom = dominant(own, ["cluster_key"], "category", "ord").withColumnRenamed("category", "dom")
    last = own.groupBy("cluster_key").agg(F.max("published_at").alias("latest"))
    centres = tfidf.centroids(postings, members, "id", "cluster_key")
    near = around(tfidf.unit(postings, "id"), tfidf.unit(centres, "cluster_key"), articles, last, hours).where(F.col("sim") >= similarity)
    found = near.join(members.select("cluster_key", "id"), ["cluster_key", "id"], "left_anti").join(articles.select("id", "category", "published_at", "ord"), "id")
    found = found.join(dom, "cluster_key", "left").join(last, "cluster_key")
    if strict:
        found = found.where(~F.coalesce((F.col("category") != "") & (F.col("category") != F.col("dom")), F.lit(False)))
    found = found.where(~F.coalesce(hours_between(F.col("latest"), F.col("published_at")) > hours, F.lit(False)))
    rank = F.row_number().over(Window.partitionBy("cluster_key").orderBy(F.desc(F.round("sim", 9)), "ord"))
    return found.withColumn("rank", rank).where(F.col("rank") <= most).select("cluster_key", "id", "sim", "rank")


def apply_groups(clusters: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, ids): clusters joined as (group, cluster_key) says, the others alone; ids once each, in order."""
    named = clusters.join(groups, "cluster_key", "left").withColumn("group", F.coalesce("group", -1 - F.col("cluster_key")))
    each = named.select("group", "cluster_key", F.posexplode("article_ids").alias("pos", "id"))
    first = each.groupBy("group", "id").agg(F.min(F.struct("cluster_key", "pos")).alias("at"))
    return first.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("ids"))
