"""What a language model writes about single stories and articles: summaries, kept in the store, and severities.

A model is a function from (purpose, text) to its answer. It raises operators.greedy.Limited where it may not be asked just now; any other exception is a failure of that one question.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import digest
from ..functions.text import headlines
from ..functions.times import millis
from ..operators import ingest, page
from ..operators.greedy import Limited
from ..params import Params
from ..sources.scratch import saved
from ..sources.store import KeyValue

Ask = Callable[[str, str], str]
LIMIT, LATER = "limit", "left for the next run"

# The labels in sources_text() and brief().


def asked(rows: DataFrame, call: Ask, callers: int = 4) -> DataFrame:
    """rows (key, purpose, content, ...) with `answer`, and `reason` where there is none. So many tasks ask at once; one that meets the model's limit asks no more.

    Write the result down before it is used twice, as the model is asked anew each time. A task that is lost asks again.
    """
    schema = rows.withColumns({"answer": F.lit(None).cast("string"), "reason": F.lit(None).cast("string")}).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limited = False
        for batch in batches:
            answers: list[str | None] = []
            reasons: list[str | None] = []
            for purpose, content in zip(batch["purpose"], batch["content"]):
                answer, reason = None, LIMIT if limited else None
                if not limited:
                    try:
                        answer = call(purpose, content)
                    except Limited:
                        limited, reason = True, LIMIT
                    except Exception as e:  # the model's own: told in the row, and the next question is asked
                        reason = f"{type(e).__name__}: {e}"[:200]
                answers.append(answer)
                reasons.append(reason)
            yield batch.assign(answer=pd.Series(answers, dtype=object, index=batch.index), reason=pd.Series(reasons, dtype=object, index=batch.index))

    return rows.repartition(callers).mapInPandas(run, schema)


def sources_text(source: Column, title: Column, description: Column, content: Column, published: Column, url: Column) -> Column:
    parts = (("Source", source), ("Title", title), ("Summary", description), ("Content", content), ("Published", published.cast("string")), ("URL", url))
    lines = [F.concat(F.lit(f"{name}: "), F.coalesce(c, F.lit(""))) for name, c in parts]
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n\n"))


def requests(stories: DataFrame, articles: DataFrame, most_stories: int = 10, most_articles: int = 15, p: Params = Params()) -> DataFrame:
    """(key, purpose, place, existing, content, titles): what to ask for the first stories of each edition and the newest articles.

    stories: edition, cluster_title, article_ids, rank, summary. A story's content is that of the articles it shows, in their order; a key comes once.
    """
    top = stories.where(F.col("rank") <= most_stories).withColumn("key", digest.summary_key("cluster", digest.cluster_summary_id(F.col("article_ids"), F.col("cluster_title"))))
    each = top.select("key", F.col("rank").cast("long").alias("place"), F.col("summary").alias("existing"), F.posexplode(F.slice("article_ids", 1, p.cluster_display_cap)).alias("pos", "id"))
    text = sources_text(*[F.col(c) for c in ("source_name", "title", "description", "content", "published_at", "url")])
    found = each.join(articles.select("id", F.coalesce("title", F.lit("")).alias("title"), text.alias("text")), "id")
    lists = found.groupBy("key").agg(F.min("place").alias("place"), F.first("existing", True).alias("existing"), F.array_sort(F.collect_set(F.struct("pos", "title", "text"))).alias("l"))
    of_stories = lists.select("key", F.lit("cluster").alias("purpose"), "place", "existing", F.array_join(F.transform("l", lambda x: x["text"]), "--- \n").alias("content"), F.transform("l", lambda x: x["title"]).alias("titles"))
    newest = ingest.newest(articles, most_articles)
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("published_at"), "ord")).cast("long") + most_stories  # of these few rows
    none = F.lit(None).cast("string")
    of_articles = newest.select(digest.summary_key("article", F.col("id")).alias("key"), F.lit("article").alias("purpose"), place.alias("place"), none.alias("existing"), F.coalesce("content", F.lit("")).alias("content"), F.array(F.coalesce("title", F.lit(""))).alias("titles"))
    return of_stories.unionByName(of_articles)


def missing(wanted: DataFrame, live: DataFrame) -> DataFrame:
    """The requests whose key has no value, or an empty one."""
    return wanted.join(live.where("value <> ''").select("key"), "key", "left_anti")


def short_summary(c: Column) -> Column:
    """The first sentence of an answer; without one its first 140 characters, up to the last full stop if that leaves more than 40."""
    flat = F.trim(F.regexp_replace(c, r"\s+", " "))
    sentence = F.regexp_extract(flat, r"(.+?[.!?])(\s|$)", 1)
    cut = F.substring(flat, 1, 140)
    dot = F.length(cut) - F.instr(F.reverse(cut), ".") + 1
    return F.when(sentence != "", sentence).when((F.instr(cut, ".") > 0) & (dot > 41), F.substring(cut, F.lit(1), dot)).otherwise(cut)


def made(wanted: DataFrame, call: Ask, p: Params = Params(), most_calls: int | None = None, short: bool = False, callers: int = 4) -> DataFrame:
    """wanted with `value` to store, null with a `reason` where there is none.

    A story's own summary is kept without asking. Only the first `most_calls` others are asked for by place; with the fallback allowed, a limit gives titles or the text's beginning instead.
    """
    own = digest.cacheable(F.col("existing")) & (F.col("purpose") == "cluster")
    place = F.row_number().over(Window.orderBy("place", "key"))  # of the few that are wanted
    rest = wanted.where(~own)
    if most_calls is not None:
        rest = saved(rest.withColumn("_nth", place))
        later = rest.where(F.col("_nth") > most_calls).drop("_nth").withColumns({"answer": F.lit(None).cast("string"), "reason": F.lit(LATER)})
        answers = asked(rest.where(F.col("_nth") <= most_calls).drop("_nth"), call, callers).unionByName(later)
    else:
        answers = asked(rest, call, callers)
    given = short_summary(F.col("answer")) if short else F.trim("answer")
    without = F.when(F.col("purpose") == "cluster", headlines(F.col("titles"))).otherwise(digest.article_summary(F.col("content")))
    value = F.when((F.col("reason") == LIMIT) & F.lit(p.summary_fallback_on_limit), without).when(F.col("reason").isNull(), given)
    fine = digest.cacheable(F.col("value"))
    answers = answers.withColumn("value", value).withColumns({"value": F.when(fine, F.col("value")), "reason": F.when(~fine, F.coalesce("reason", F.lit("no summary")))}).drop("answer")
    return wanted.where(own).withColumns({"value": F.col("existing"), "reason": F.lit(None).cast("string")}).unionByName(answers)


def generate(store: KeyValue, stories: DataFrame, articles: DataFrame, call: Ask, as_of: Column, p: Params = Params(), most_stories: int = 10, most_articles: int = 15, most_calls: int | None = None) -> DataFrame:
    """(key, purpose, value, reason) of the summaries that were missing; those with a value are in the store now, so the next run asks only for the others."""
    wanted = saved(missing(requests(stories, articles, most_stories, most_articles, p), store.get(as_of)))
    out = saved(made(wanted, call, p, most_calls).select("key", "purpose", "value", "reason"))
    store.put(out.where("value is not null").select("key", "value"), p.cache_ttl_seconds, as_of)
    return out


def brief(clusters: DataFrame, articles: DataFrame, most: int = 6) -> DataFrame:
    """(key, purpose, content) for (cluster_key, cluster_title, article_ids): a story's title, size and first headlines as JSON, which its severity is judged by."""
    each = clusters.select("cluster_key", F.posexplode(F.slice("article_ids", 1, most)).alias("pos", "id")).join(articles, "id")
    line = F.struct(F.col("source_name").alias("source"), "title", F.substring(F.coalesce("description", F.lit("")), 1, 200).alias("desc"), F.col("published_at").cast("string").alias("date"))
    lines = each.groupBy("cluster_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]).alias("headlines"))
    whole = F.struct(F.col("cluster_title").alias("title"), F.size("article_ids").alias("size"), F.coalesce("headlines", F.array().cast("array<struct<source: string, title: string, desc: string, date: string>>")).alias("headlines"))
    return clusters.join(lines, "cluster_key", "left").select(F.col("cluster_key").alias("key"), F.lit("severity").alias("purpose"), F.to_json(whole).alias("content"))


def severity_answer(c: Column) -> Column:
    """struct<level, label, reasons> of an answer in JSON, or with JSON in it; level 0, Other and no reasons for what is missing or has another type."""
    text = digest.json_text(c)
    level = F.get_json_object(text, "$.level").try_cast("double")
    fields = F.from_json(text, "map<string, string>")
    label = F.when(F.regexp_like(text, F.lit(r'"label"\s*:\s*"')), fields["label"])
    reasons = F.from_json(F.get_json_object(text, "$.reasons"), "array<string>")
    return F.struct(
        F.coalesce(F.when(~F.isnan(level), level), F.lit(0.0)).cast("int").alias("level"),
        F.coalesce(label, F.lit("Other")).alias("label"),
        F.coalesce(F.slice(reasons, 1, 4), F.array().cast("array<string>")).alias("reasons"),
    )


def severities(clusters: DataFrame, articles: DataFrame, call: Ask, callers: int = 4) -> DataFrame:
    """(cluster_key, level, label, reasons) for each of the clusters; a question that fails counts as Other. Fits plans.stories.Model.assess once articles and call are given."""
    answers = asked(brief(clusters, articles), call, callers)
    return answers.select(F.col("key").alias("cluster_key"), severity_answer(F.col("answer")).alias("a")).select("cluster_key", "a.*")


def wants_refresh(saved_at: Column, mode: Column, as_of: Column, hours: int = 6) -> Column:
    """Whether a request for a stored page starts a refresh: in the modes that let requests do so, if the page is older; a page without a time is."""
    old = F.coalesce(millis(as_of) - millis(saved_at) > hours * 3_600_000, F.lit(True))
    return mode.isin("request-refresh", "request-generate") & old


def category_digest(stories: DataFrame, label: str, live: DataFrame) -> DataFrame:
    """(id, key, content, lede, takeaways, hit): the digest of a category from its first four stories, two articles of each: the stored summary, or the first lines of its payload."""
    told = page.category_payload(stories, stories.select("ord", F.lit("").alias("id"), "title", F.lit("").alias("source_name"), F.lit("").alias("description")).limit(0), label, 4, 2, 0)
    rows = told.withColumn("key", digest.summary_key("category", F.col("id"))).join(live.where("value <> ''").select("key", "value"), "key", "left")
    d = digest.parsed(F.coalesce("value", digest.digest_fallback(F.col("content"))))
    return rows.select("id", "key", "content", d["lede"].alias("lede"), d["takeaways"].alias("takeaways"), F.col("value").isNotNull().alias("hit"))
