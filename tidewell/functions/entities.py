"""Names in a text: runs of capitalised words, capitalised words within a sentence, acronyms, and names with a number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# The four patterns of names are those that results depend on.


def entities(c: Column) -> Column:
    """Distinct names, lower-cased and joined by _."""
    c = F.coalesce(c, F.lit(""))
    joined = lambda x: F.regexp_replace(F.lower(x), r"\s+", "_")
    plain = lambda x: F.replace(x, F.lit("'"), F.lit(""))
    runs = F.transform(F.regexp_extract_all(c, F.lit(r"[A-Z][a-zA-Z']*(?:\s+[A-Z][a-zA-Z']*)+"), 0), lambda x: plain(joined(x)))
    inner = F.flatten(F.transform(F.split(c, r"[.!?]\s+"), lambda s: F.slice(F.split(s, r"\s+"), 2, 1 << 30)))
    single = F.transform(F.filter(inner, lambda w: F.regexp_like(w, F.lit(r"^[A-Z][a-zA-Z']*$")) & (F.length(w) >= 3)), lambda w: plain(F.lower(w)))
    acronyms = F.transform(F.regexp_extract_all(c, F.lit(r"(?<![A-Za-z0-9_])[A-Z]{2,6}(?![A-Za-z0-9_])"), 0), F.lower)
    numbered = F.transform(F.regexp_extract_all(c, F.lit(r"[A-Z][a-zA-Z]*\s*\d{2,4}"), 0), joined)
    return F.array_distinct(F.concat(runs, single, acronyms, numbered))


def cluster_text(title: Column, titles: Column, most: int = 10) -> Column:
    """A cluster's title and its first members' titles, each a sentence of its own."""
    return F.array_join(F.concat(F.array(F.coalesce(title, F.lit(""))), F.filter(F.slice(titles, 1, most), lambda t: t != "")), ". ")
