"""Text functions: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import STOPWORDS

# The patterns in tokens(), strip_html(), first_sentence() and slug() are those that results depend on.


def blank(c: Column) -> Column:
    """Null instead of an empty or blank text."""
    return F.when(F.trim(c) != "", c)


def tokens(c: Column, stopwords: list[str] = STOPWORDS) -> Column:
    """Lower-case ASCII words of three letters or more that aren't stop words; links are dropped. Null: empty."""
    clean = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"https?://\S+", " "), r"[^a-z0-9\s]", " ")
    return F.filter(F.split(clean, r"\s+"), lambda t: (F.length(t) > 2) & ~t.isin(stopwords))


def title_tokens(c: Column) -> Column:
    return F.array_distinct(tokens(c))


def doc_text(title: Column, description: Column, content: Column | None = None) -> Column:
    """What an article is compared by: title, description and the first 500 characters of the content."""
    parts = [title, description, F.substring(content if content is not None else F.lit(""), 1, 500)]
    return F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts])


def strip_html(c: Column) -> Column:
    """Text without styles, scripts and tags, white space folded."""
    for pattern in (r"(?i)<style[^>]*>[\s\S]*?</style>", r"(?i)<script[^>]*>[\s\S]*?</script>", r"<[^>]+>", r"\s+"):
        c = F.regexp_replace(c, pattern, " ")
    return F.trim(c)


def truncated(c: Column, most: int) -> Column:
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most - 3), F.lit("...")))


def first_sentence(c: Column, most: int = 140) -> Column:
    """The first sentence; without one, the beginning of the text."""
    found = F.regexp_extract(c, r"^(.+?[.!?])(\s|$)", 1)
    return F.when(found != "", found).otherwise(F.substring(c, 1, most))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def headlines(titles: Column, most: int = 3) -> Column:
    """The first titles that aren't blank, as one line."""
    return F.array_join(F.slice(F.filter(titles, lambda t: F.trim(t) != ""), 1, most), " • ")


def payload(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*[F.coalesce(p, F.lit("")) for p in parts]), lambda x: F.trim(x) != ""), "\n\n")
