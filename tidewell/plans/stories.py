"""From articles to ranked stories: the passes of clustering, then enrichment, scores and links."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import set_id
from ..functions.text import doc_text, headlines
from ..operators import enrich, greedy, leading, merging, ranking, stories, tfidf
from ..params import Params
from ..sources.scratch import saved


def _keyed(clusters: DataFrame) -> DataFrame:
    """One number for an edition's cluster, so that clusters of all editions go through the relational operators together."""
    return clusters.withColumn("local_key", F.col("cluster_key")).withColumn("cluster_key", F.col("edition") * (1 << 32) + F.col("local_key"))


def expanded(clusters: DataFrame, articles: DataFrame, p: Params) -> DataFrame:
    """Clusters with the articles that belong to them as well, judged within their edition."""
    keyed = _keyed(clusters)
    members = keyed.select("edition", "cluster_key", F.posexplode("article_ids").alias("pos", "id"))
    postings = tfidf.weights(articles, "id", doc_text(F.col("title"), F.col("description"), F.col("content")), within=["edition"])
    postings = postings.withColumn("term", F.concat_ws(":", "edition", "term")).drop("edition")  # articles meet the clusters of their edition only
    more = stories.expanded(members.drop("edition"), articles, postings, p.cluster_expand_sim, p.cluster_expand_max_add, p.cluster_expand_time_hours, p.cluster_expand_category_strict)
    lists = more.groupBy("cluster_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("added"))
    out = keyed.join(lists, "cluster_key", "left").withColumn("article_ids", F.array_union("article_ids", F.coalesce("added", F.array().cast("array<string>"))))
    return out.select("edition", F.col("local_key").alias("cluster_key"), "cluster_title", "article_ids")


@dataclass(frozen=True)
class Model:
    """What a language model may do in the plan; each part may be missing, and a deterministic rule stands in its place.

    refine and merge are called within an edition (operators.greedy.Refine, Merge). assess gets the clusters of unclear severity among the first of each edition
    (edition, cluster_key, cluster_title, article_ids, label, ...) and answers with (cluster_key, level, label) for those it can judge; plans.summaries.severities asks about one at a time. summarise
    is asked for the summaries of the first stories and articles (plans.summaries.generate) once an edition stands.
    """

    refine: greedy.Refine | None = None
    merge: greedy.Merge | None = None
    assess: Callable[[DataFrame], DataFrame] | None = None
    summarise: Callable[[str, str], str] | None = None


def raw_clusters(articles: DataFrame, p: Params = Params(), refine: bool = True, model: Model = Model()) -> DataFrame:
    """greedy.CLUSTERS for articles with `edition`: seeds, refinement, merges, split, expansion, split, merge. Without refine: the seeds."""
    timed = articles.withColumn("at", F.col("published_at")).withColumn("published_at", F.unix_micros(F.col("published_at").cast("timestamp")))
    seeds = leading.preclustered(timed, p)
    if not refine:
        return seeds
    told = saved(greedy.asked_of(seeds, timed, p, model.refine) if model.refine else merging.chunked(seeds, timed, p))
    joined = merging.merged_by_title(saved(merging.merged_by_overlap(told, p.cluster_jaccard_merge)), p.cluster_title_merge)
    named = saved(merging.merged_by_entity(saved(joined), timed, p))
    whole = saved(merging.merged_by_title(saved(greedy.coherent(named, timed, p)), p.cluster_title_merge))
    if model.merge and p.cluster_llm_merge:
        whole = saved(greedy.grouped_by(whole, timed, model.merge))
    wide = saved(expanded(whole, timed.withColumn("published_at", F.col("at")).drop("at"), p))
    return merging.merged_by_title(saved(greedy.coherent(wide, timed, p)), p.cluster_title_merge)


def ranked_stories(articles: DataFrame, meta: DataFrame, as_of: Column, p: Params = Params(), model: Model = Model()) -> DataFrame:
    """(edition, id, cluster_title, article_ids, n, domains, image_urls, label, score, rank, summary, related_ids) of the stories of each edition, best first.

    articles: id, title, description, content, url, source_name, source_url, category, published_at, ord, url_to_image, image_width, image_height, edition.
    """
    clusters = _keyed(saved(raw_clusters(articles, p, model=model)))
    members = clusters.select("edition", "cluster_key", F.posexplode("article_ids").alias("pos", "id"))
    full = stories.lookup(members.drop("edition"), articles)
    once = saved(enrich.deduped(enrich.valid(full)))
    shown = saved(enrich.valid(enrich.diverse(once, p.cluster_per_domain_max, p.cluster_display_cap)))
    pictures = saved(enrich.images(shown, once, p))
    scores = ranking.scored(shown.withColumn("pos", F.col("shown")), pictures, meta, as_of, p)
    if model.assess:
        scores = saved(scores.join(clusters.select("edition", "cluster_key", "cluster_title", "article_ids"), "cluster_key"))
        answers = model.assess(ranking.to_assess(scores, p.severity_llm_top_n, ["edition"]))
        scores = ranking.reassessed(scores, answers, p.severity_llm_top_n, p, ["edition"]).drop("edition", "cluster_title", "article_ids")
    links = saved(stories.related(clusters, members.drop("edition"), articles, p.related_min_shared, p.related_min_length, p.related_min_coherence, p.related_max, scope="edition"))
    named = clusters.withColumn("id", set_id(F.col("article_ids")))
    near = links.join(named.select(F.col("cluster_key").alias("related_key"), F.col("id").alias("related_id")), "related_key")
    near = near.groupBy("cluster_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "related_id"))), lambda x: x["related_id"]).alias("related_ids"))
    titles = shown.groupBy("cluster_key").agg(headlines(F.transform(F.array_sort(F.collect_list(F.struct("shown", "title"))), lambda x: x["title"])).alias("summary"))
    out = named.join(scores, "cluster_key").join(pictures, "cluster_key", "left").join(titles, "cluster_key", "left").join(near, "cluster_key", "left")
    rank = F.row_number().over(Window.partitionBy("edition").orderBy(F.desc("score"), "local_key")).cast("long")
    return out.withColumn("rank", rank).select("edition", "id", "cluster_title", "article_ids", "n", "domains", "image_urls", "label", "score", "rank", "summary", "related_ids")
