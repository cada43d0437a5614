"""Summaries without a model, and digests read from JSON or plain text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_html

# Answers that say that there is no summary.
SENTINELS = ["summary not available", "summary could not be generated.", "an error occurred while generating the cluster summary."]


def json_text(c: Column) -> Column:
    """The text from the first { to the last }, if the whole isn't JSON."""
    first = F.instr(c, "{")
    last = F.length(c) - F.instr(F.reverse(c), "}") + 1
    cut = F.when((first > 0) & (last > first), F.substring(c, first, last - first + 1))
    valid = lambda x: F.get_json_object(x, "$").isNotNull()
    return F.when(valid(c), c).when(valid(cut), cut)


def parsed(c: Column) -> Column:
    """struct<lede, takeaways>: from JSON, else the first sentence and the two after it."""
    clean = F.trim(F.coalesce(c, F.lit("")))
    lede = F.trim(F.coalesce(F.get_json_object(clean, "$.lede"), F.lit("")))
    items = F.coalesce(F.from_json(F.get_json_object(clean, "$.takeaways"), "array<string>"), F.array().cast("array<string>"))
    items = F.slice(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")), 1, 3)
    parts = F.filter(F.split(F.trim(F.regexp_replace(clean, r"\s+", " ")), r"(?<=[.!?])\s+"), lambda x: x != "")
    from_json = F.startswith(clean, F.lit("{")) & ((lede != "") | (F.size(items) > 0))
    return F.struct(
        F.when(from_json, lede).when(F.size(parts) > 0, F.get(parts, F.lit(0))).otherwise(clean).alias("lede"),
        F.when(from_json, items).otherwise(F.slice(parts, 2, 2)).alias("takeaways"),
    )


def article_summary(c: Column, most: int = 150) -> Column:
    """The first sentence if it is longer than 40 characters, else the beginning."""
    clean = strip_html(F.coalesce(c, F.lit("")))
    dot = F.instr(clean, ".")
    return F.when(dot > 41, F.substring(clean, F.lit(1), dot)).otherwise(F.substring(clean, 1, min(most, 200)))


def digest_fallback(c: Column) -> Column:
    """The first three list lines, as one line."""
    lines = F.filter(F.split(c, "\n"), lambda x: F.startswith(x, F.lit("- ")))
    return F.array_join(F.slice(F.transform(lines, lambda x: F.substring(x, F.lit(3), F.length(x))), 1, 3), " • ")


def cacheable(c: Column) -> Column:
    low = F.trim(F.lower(F.coalesce(c, F.lit(""))))
    return (low != "") & ~low.isin(SENTINELS)


def summary_key(purpose: str, ident: Column) -> Column:
    """The cache key of a summary of an article, cluster or category."""
    name = F.coalesce(F.nullif(F.trim(F.coalesce(ident, F.lit(""))), F.lit("")), F.lit("unknown"))
    return F.concat(F.lit(f"Summary-{'v2' if purpose == 'cluster' else 'v1'}-{purpose}-"), name)


def cluster_summary_id(ids: Column, title: Column) -> Column:
    key = F.array_join(F.array_sort(F.filter(ids, lambda x: x != "")), "-")
    other = F.coalesce(F.nullif(F.trim(title), F.lit("")), F.lit("unknown"))
    return F.concat(F.lit("cluster-"), F.when(key != "", key).otherwise(other))
