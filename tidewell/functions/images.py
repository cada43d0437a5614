"""Image addresses: better sizes, sizes told by the address, and the first image of markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import hostname, is_valid

_SIZED = "struct<width: int, height: int>"


def _ends(c: Column, suffix: str) -> Column:
    return F.coalesce(F.endswith(hostname(c), F.lit(suffix)), F.lit(False))


def _int(c: Column) -> Column:
    return c.try_cast("int")


def normalized(c: Column, width: int = 976) -> Column:
    """The larger version of an image of a provider that writes the size into the path; only the first place is changed."""
    better = c
    for pattern, new in ((r"/ace/standard/\d+/", f"/ace/standard/{width}/"), (r"/news/\d+/", f"/news/{width}/"), (r"/images/ic/\d+x\d+/", f"/images/ic/{width}x{width}/")):
        better = F.regexp_replace(better, "^(.*?)" + pattern, "$1" + new)
    return F.when(_ends(c, "ichef.bbci.co.uk"), better).otherwise(c)


def inferred_dims(c: Column) -> Column:
    """struct<width, height> as far as the address tells."""
    size = lambda w, h=F.lit(None): F.struct(w.cast("int").alias("width"), h.cast("int").alias("height"))
    query = _int(F.regexp_extract(c, r"[?&]width=(\d+)", 1))
    standard, news = _int(F.regexp_extract(c, r"/ace/standard/(\d+)/", 1)), _int(F.regexp_extract(c, r"/news/(\d+)/", 1))
    w, h = _int(F.regexp_extract(c, r"/images/ic/(\d+)x(\d+)/", 1)), _int(F.regexp_extract(c, r"/images/ic/(\d+)x(\d+)/", 2))
    bbc = F.when(standard > 0, size(standard)).when(news > 0, size(news)).when(w.isNotNull(), size(w, h))
    found = F.when(_ends(c, "i.guim.co.uk") & (query > 0), size(query)).when(_ends(c, "ichef.bbci.co.uk"), bbc).when(_ends(c, "techmeme.com"), size(F.lit(120)))
    return F.coalesce(found, F.lit(None).cast(_SIZED))


def large_enough(w: Column, h: Column, min_w: int, min_h: int) -> Column:
    """Unknown sizes pass."""
    return ~F.coalesce((w > 0) & (w < min_w), F.lit(False)) & ~F.coalesce((h > 0) & (h < min_h), F.lit(False))


def is_useful(c: Column) -> Column:
    return F.coalesce((F.trim(c) != "") & ~F.contains(c, F.lit("placehold.co")), F.lit(False))


def first_img(html: Column) -> Column:
    """struct<src, width, height> of the first img tag; src null if that tag has none."""
    tag = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)<img[^>]*>", 0)
    attr = lambda name, value: F.regexp_extract(tag, rf"(?i)\s{name}\s*=\s*[\"']?({value})", 1)
    src = F.regexp_extract(tag, r"(?i)\ssrc\s*=\s*[\"']([^\"']+)[\"']", 1)
    return F.struct(F.nullif(src, F.lit("")).alias("src"), _int(attr("width", r"\d+")).alias("width"), _int(attr("height", r"\d+")).alias("height"))


def picked(*candidates: Column) -> Column:
    """The first candidate that is an address, in its better size."""
    return F.coalesce(*[F.when(is_valid(c), normalized(c)) for c in candidates])
