"""Address functions. Addresses that can't be parsed give null or an empty host and never fail."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import AGGREGATOR_HOST, PLACEHOLDER

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)"


def is_valid(c: Column) -> Column:
    return F.coalesce(F.regexp_like(c, F.lit(_PARTS)), F.lit(False))


def hostname(c: Column) -> Column:
    """Lower-case host without port; null if there is none."""
    return F.when(is_valid(c), F.lower(F.regexp_replace(F.regexp_extract(c, _PARTS, 2), r"^[^@]*@|:\d+$", "")))


def host(c: Column) -> Column:
    """hostname() without a leading www."""
    return F.regexp_replace(hostname(c), r"^www\.", "")


def is_aggregator(c: Column) -> Column:
    return F.coalesce(hostname(c) == AGGREGATOR_HOST, F.lit(False))


def resolved_host(url: Column, source_url: Column, source_name: Column) -> Column:
    """The publisher's host: the source's, else the article's; an aggregator's is told apart by the source's name."""
    found = host(F.coalesce(F.when(source_url != "", source_url), url))
    return F.coalesce(F.when(found == AGGREGATOR_HOST, F.concat(found, F.lit(":"), F.lower(F.coalesce(source_name, F.lit(""))))).otherwise(found), F.lit(""))


def origin_and_path(c: Column) -> Column:
    """Scheme, host and path, without query and fragment; a bare host has path /."""
    scheme, port = F.lower(F.regexp_extract(c, _PARTS, 1)), F.regexp_extract(c, r"^[^/]*//[^/?#]*?(:\d+)?(?:[/?#]|$)", 1)
    default = ((scheme == "http") & (port == ":80")) | ((scheme == "https") & (port == ":443"))
    path = F.regexp_extract(c, _PARTS, 3)
    return F.when(is_valid(c), F.concat(scheme, F.lit("://"), hostname(c), F.when(default, "").otherwise(port), F.when(path == "", "/").otherwise(path)))


def canonical_key(url: Column, source_url: Column, title: Column, lower: bool = True) -> Column:
    """What makes two articles the same: address without query, else the source's host and the title."""
    key = origin_and_path(url)
    other = F.concat(F.coalesce(host(source_url), F.lit("")), F.lit("|"), F.lower(F.trim(F.coalesce(title, F.lit("")))))
    return F.coalesce(F.lower(key) if lower else key, other)


def url_component(c: Column) -> Column:
    """Percent-encoded as part of an address; blanks become %20 and ! ~ ' ( ) stay."""
    out = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%7E", "~"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def image_or_placeholder(image: Column, name: Column) -> Column:
    return F.when(is_valid(image), image).otherwise(F.concat(F.lit(PLACEHOLDER), url_component(F.coalesce(name, F.lit("")))))


def decoded_aggregator_url(c: Column, prefix: str = f"https://{AGGREGATOR_HOST}/rss/articles/") -> Column:
    """The address that an aggregator's link holds in base64; null if none can be read."""
    code = F.regexp_replace(F.split(F.replace(c, F.lit(prefix), F.lit("")), r"\?")[0], r"[^A-Za-z0-9+/_-]", "")
    code = F.translate(code, "-_", "+/")
    whole = F.rpad(code, (F.ceil(F.length(code) / 4) * 4).cast("int"), "=")
    text = F.decode(F.try_to_binary(whole, F.lit("base64")), "ISO-8859-1")
    return F.when(F.startswith(c, F.lit(prefix)), F.nullif(F.regexp_extract(text, r"(https?://[^\x00-\x1f\s\"<>\x7f-￿]+)", 1), F.lit("")))
